"""Per-file helpers for what Spark expressions cannot parse.

Python needs the ``ast`` module, HTML a tag tokenizer, CSS a scan of its braces;
block ends need a next-smaller-value search.  Each helper handles one text and
returns plain rows; all scoring, joining and grouping is done by Spark.
"""
from __future__ import annotations

import ast
import re
import warnings
from bisect import bisect_left, bisect_right
from html.parser import HTMLParser

import numpy as np

from srcgraph.functions.fixed import (
    ASSET_ATTRIBUTE, EXTERNAL_PREFIXES, STRUCTURAL_TAGS, VOID_TAGS,
)


def symbol(name, kind, start, end, nesting, branches, calls=(), docstring=None,
           top=0, sub=0, parent=None, depth=0, unclosed=False):
    return dict(top_ord=top, sub_ord=sub, parent_sub=parent, depth=depth, name=name, kind=kind,
                line_start=start, line_end=end, nesting_depth=nesting, branch_count=branches,
                calls=sorted(set(calls)), docstring=docstring, unclosed=unclosed)


# --- Python -----------------------------------------------------------------
BRANCH_NODES = frozenset((ast.If, ast.For, ast.While, ast.Try, ast.TryStar, ast.ExceptHandler, ast.With,
                          ast.Match))
FUNCTION_NODES = frozenset((ast.FunctionDef, ast.AsyncFunctionDef))


#: Fields that hold no node, or only nodes without a name, a call, a branch or an import.
PLAIN_FIELDS = frozenset(("ctx", "op", "ops", "attr", "names", "module", "level", "type_comment", "kind"))
PLAIN, BRANCH, CALL, FUNCTION, CLASS, NAME, ATTRIBUTE, IMPORT, IMPORT_FROM = range(9)
MEANINGS = {**dict.fromkeys(BRANCH_NODES, BRANCH), **dict.fromkeys(FUNCTION_NODES, FUNCTION), ast.Call: CALL, ast.ClassDef: CLASS,
            ast.Name: NAME, ast.Attribute: ATTRIBUTE, ast.Import: IMPORT, ast.ImportFrom: IMPORT_FROM}
#: Per kind of node: what it means, and the fields that may hold others.
NODE_KINDS: dict[type, tuple[int, tuple[str, ...]]] = {}


def node_kind(kind: type) -> tuple[int, tuple[str, ...]]:
    fields = () if kind is ast.Name else tuple(f for f in kind._fields if f not in PLAIN_FIELDS)
    found = NODE_KINDS[kind] = MEANINGS.get(kind, PLAIN), fields
    return found


def tree_nodes(tree) -> dict[str, list]:
    """Symbols, imports, bindings and references to what these bind, from one walk in the order of ``ast.walk``.

    Constants and names that no import binds are passed over.
    """
    bindings = list(python_bindings(tree))
    local_names = {b["local"] for b in bindings}
    nodes, parents = [tree], [-1]
    inside, counting = [], []   # per node, for its children: the function or method they lie in, the last node that counts branches
    calls: dict[int, set[str]] = {}
    members: dict[int, list[int]] = {}  # of classes and functions of the module; a function has none
    counted: list[tuple[int, int, bool]] = []   # (node, the next one above, whether it is a branch)
    imported, references = [], []
    for at, node in enumerate(nodes):  # grows on the way
        kind = type(node)
        meaning, fields = NODE_KINDS.get(kind) or node_kind(kind)
        above = parents[at]
        own, count = (inside[above], counting[above]) if at else (-1, -1)
        if meaning:
            if meaning == NAME:
                references.append(dict(base=node.id, attr=None, line=node.lineno))
            elif meaning == CALL:
                if own >= 0:
                    name = getattr(node.func, "id", None) or getattr(node.func, "attr", None)
                    if name:
                        calls[own].add(name)
            elif meaning == BRANCH:
                counted.append((at, count, True))
                count = at
            elif meaning == ATTRIBUTE:
                if type(node.value) is ast.Name and node.value.id in local_names:
                    references.append(dict(base=node.value.id, attr=node.attr, line=node.lineno))
            elif meaning == IMPORT:
                imported += [alias.name for alias in node.names]
            elif meaning == IMPORT_FROM:
                if node.level or node.module:
                    imported.append(relative_path(node.level, node.module) if node.level else node.module)
            else:
                method = meaning == FUNCTION and above in members and type(nodes[above]) is ast.ClassDef
                if above == 0:
                    members[at] = []
                elif method:
                    members[above].append(at)
                if above == 0 or method:
                    counted.append((at, count, False))
                    count = at
                    if meaning == FUNCTION:
                        own, calls[at] = at, set()
        inside.append(own)
        counting.append(count)
        for field in fields:
            value = getattr(node, field, None)
            if type(value) is list:
                for item in value:
                    kind = type(item)
                    if kind is ast.Name:
                        if item.id in local_names:
                            nodes.append(item)
                            parents.append(at)
                    elif kind is not ast.Constant and isinstance(item, ast.AST):
                        nodes.append(item)
                        parents.append(at)
            else:
                kind = type(value)
                if kind is ast.Name:
                    if value.id in local_names:
                        nodes.append(value)
                        parents.append(at)
                elif kind is not ast.Constant and isinstance(value, ast.AST):
                    nodes.append(value)
                    parents.append(at)
    # branches below each counting node and the deepest chain of them, from the last one up
    total, deepest = {-1: 0}, {-1: 0}
    total.update((at, 0) for at, _, _ in counted)
    deepest.update(total)
    for at, above, branch in reversed(counted):
        total[at] += branch
        deepest[at] += branch
        total[above] += total[at]
        deepest[above] = max(deepest[above], deepest[at])

    def shaped(at, kind, **place):
        node = nodes[at]
        return symbol(node.name, kind, node.lineno, node.end_lineno or node.lineno, deepest[at], total[at],
                      calls.get(at, ()), ast.get_docstring(node), **place)
    out = []
    for i, (at, methods) in enumerate(members.items()):
        out.append(shaped(at, "class" if type(nodes[at]) is ast.ClassDef else "function", top=i))
        out += [shaped(m, "method", top=i, sub=j, parent=0, depth=1) for j, m in enumerate(methods, 1)]
    return dict(symbols=out, imports=imported, bindings=bindings, references=references)


def relative_path(level: int, module: str | None) -> str:
    """A relative import as a path: one dot is the folder itself, each further one a step up."""
    steps = ["."] if level == 1 else [".."] * (level - 1)
    return "/".join(steps + (module.split(".") if module else []))


def python_bindings(tree):
    """Module-level names bound by an import: (form, module, level, name, local)."""
    for node in tree.body:
        if isinstance(node, ast.ImportFrom):
            for alias in node.names:
                if alias.name != "*":
                    yield dict(form="from", module=node.module or "", level=node.level or 0,
                               name=alias.name, local=alias.asname or alias.name)
        elif isinstance(node, ast.Import):
            for alias in node.names:
                yield dict(form="import", module=alias.name, level=0, name=None,
                           local=alias.asname or alias.name.split(".")[0])


def parse_python(text: str) -> dict:
    out = dict(status="ok", line_count=text.count("\n") + 1, symbols=[], imports=[],
               bindings=[], references=[])
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return {**out, "status": "syntax_error"}
    return {**out, **tree_nodes(tree)}


# --- HTML -------------------------------------------------------------------
class Tags(HTMLParser):
    """The flat list of tags: (tag, attributes or None for an end tag, line)."""

    def __init__(self):
        super().__init__()
        self.events = []

    def handle_starttag(self, tag, attrs):
        self.events.append((tag, attrs, self.getpos()[0]))

    def handle_endtag(self, tag):
        self.events.append((tag, None, self.getpos()[0]))


def node_name(tag, attrs) -> str | None:
    """Name of an element that counts as a symbol: one with an id, or a structural one."""
    own = dict(attrs).get("id")
    return f"#{own} ({tag})" if own else f"<{tag}>" if tag in STRUCTURAL_TAGS else None


def html_nodes(events, last_line: int) -> list[dict]:
    """Tracked elements with parents and ends, by a fold over the tags with a stack of open ones.

    An end tag closes the innermost open element of its name and all inside it;
    what no end tag closes runs to the last line.
    """
    nodes, path, level, sizes = [], [], 0, []
    for tag, attrs, line in events:
        if tag in VOID_TAGS:
            continue
        if attrs is None:
            level = max(0, level - 1)
            inner = next((i for i in reversed(range(len(path))) if path[i][0] == tag), len(path))
            for _, node in path[inner:]:
                node.update(line_end=line, unclosed=False)
            del path[inner:]
            continue
        level += 1
        name = node_name(tag, attrs)
        if name is None:
            continue
        above = path[-1][1] if path else None
        if above is None:
            sizes.append(0)
            place = dict(top=len(sizes) - 1)
        else:
            sizes[above["top_ord"]] += 1
            place = dict(top=above["top_ord"], sub=sizes[above["top_ord"]], parent=above["sub_ord"], depth=above["depth"] + 1)
        node = symbol(name, "html_node", line, last_line, level, len(attrs), unclosed=True, **place)
        nodes.append(node)
        path.append((tag, node))
    return nodes


def parse_html(text: str) -> dict:
    lines = len(text.splitlines())
    tags = Tags()
    try:
        tags.feed(text)
        tags.close()
    except Exception:  # malformed markup: keep what was collected so far
        pass
    assets = [dict(attrs).get(ASSET_ATTRIBUTE.get(tag, "")) for tag, attrs, _ in tags.events if attrs is not None]
    return dict(status="ok", line_count=lines, symbols=html_nodes(tags.events, lines),
                imports=[a for a in assets if a and not a.startswith(EXTERNAL_PREFIXES)], bindings=[], references=[])


# --- CSS --------------------------------------------------------------------
CSS_TOKEN = re.compile(r"""/\*.*?(?:\*/|\Z)|"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?|[{};\n]""", re.S)
# At-rules that hold rules; all others hold declarations or frames.
CSS_GROUPS = ("@media", "@supports", "@layer", "@container", "@document", "@scope", "@starting-style")


def parse_css(text: str) -> dict:
    """Rules by braces: comments and strings are skipped, rules inside grouping at-rules count, nested ones belong to their rule."""
    found, blocks, head, at, line = [], [], [], 0, 1
    for token in CSS_TOKEN.finditer(text):
        mark = token.group()
        head.append(text[at:token.start()] + (mark if mark[0] in "\"'" else " " if mark == "\n" or mark[0] == "/" else ""))
        at = token.end()
        line += mark.count("\n")
        outer = next((b for b in blocks if b["kind"] == "rule"), None)
        if mark == "{":
            name = " ".join("".join(head).split())
            kind = "group" if name.startswith(CSS_GROUPS) else "other" if name.startswith("@") or not name else "rule"
            if any(b["kind"] == "other" for b in blocks):
                kind = "other"
            blocks.append(dict(kind=kind, name=name, start=line, parts=0))
        elif mark == ";" and outer:
            outer["parts"] += 1
        elif mark == "}" and blocks:
            block = blocks.pop()
            if block is outer:
                found.append(symbol(block["name"], "css_rule", block["start"], line, 0, block["parts"], top=len(found)))
        if mark in "{};":
            head = []
    return dict(status="ok", line_count=len(text.splitlines()), symbols=found, imports=[], bindings=[], references=[])


TREE_PARSERS = {"python": parse_python, "html": parse_html, "css": parse_css}


# --- block ends -------------------------------------------------------------
def block_layout(mode, net, opens, marks, starts, roles) -> dict:
    """End line of every block, and which members each container line span holds.

    ``net``/``opens``/``marks`` hold one value per line: opened minus closed
    blocks, opened blocks, and whether the mode's special token occurs.  All
    lines are 0-based.  One right-to-left sweep keeps the lines that are nearer
    than any line at their level or below, so a block end is one binary search.
    """
    n = len(net)
    level, total = [0], 0
    for value in net:
        total += value
        level.append(total)
    closing = [i for i in range(n) if (marks[i] if mode == "statement" else net[i] < 0)]
    opening = [i for i in range(n) if opens[i] > 0]

    def plan(start):
        """(line to search from, highest level that ends the block) or an end line."""
        start = min(start, n - 1)
        base = level[start]
        if (mode == "arrow" and marks[start]) or (mode == "inline" and not opens[start]):
            return start, None
        if mode == "after":
            return start + 1, min(base, level[start + 1])
        if mode == "statement":
            return start, base
        at = bisect_left(opening, start)
        return (opening[at], base) if at < len(opening) else (n, base)

    ends, searches = [n - 1] * len(starts), []
    for k, start in enumerate(starts):
        begin, limit = plan(start)
        if limit is None:
            ends[k] = begin
        elif begin < n and mode != "statement" and level[begin + 1] <= limit:
            ends[k] = begin
        else:
            searches.append((begin, limit, k))
    near_level, near_line = [], []
    for begin, limit, k in sorted(searches, reverse=True):
        while closing and closing[-1] >= begin:
            line = closing.pop()
            while near_level and near_level[-1] >= level[line + 1]:
                near_level.pop()
                near_line.pop()
            near_level.append(level[line + 1])
            near_line.append(line)
        at = bisect_right(near_level, limit)
        if at:
            ends[k] = near_line[at - 1]

    members = [s for s, role in zip(starts, roles) if role in ("member", "loose")]
    low = [bisect_left(members, s) for s in starts]
    high = [bisect_right(members, e) for e in ends]
    covered = sorted((s, e) for s, e, role in zip(starts, ends, roles) if role == "container")
    keep, reach, at = [], -1, 0
    for s, e, role in zip(starts, ends, roles):
        if role == "loose":
            while at < len(covered) and covered[at][0] <= s:
                reach = max(reach, covered[at][1])
                at += 1
            keep.append(s > reach)
            reach = max(reach, e) if s > reach else reach
        else:
            keep.append(role != "member" and not (role == "bodied" and e == n - 1 and not opens[min(s, n - 1)]))
    return dict(ends=ends, low=low, high=high, keep=keep)


def deepest(net, starts, ends) -> np.ndarray:
    """Greatest depth of each block of lines that counts from 0 at its start and never drops below 0.

    That is the greatest rise of the running sum between two places of the block;
    a tree of (least, greatest, rise) answers all blocks at once.
    """
    level = np.r_[0, np.cumsum(net)]
    size = 1 << int(len(level) - 1).bit_length() if len(level) > 1 else 1
    far = 1 << 40
    low, high, rise = np.full(2 * size, far), np.full(2 * size, -far), np.zeros(2 * size, np.int64)
    low[size:size + len(level)] = high[size:size + len(level)] = level
    at = size
    while at > 1:
        left, right, half = slice(at, 2 * at, 2), slice(at + 1, 2 * at, 2), slice(at // 2, at)
        low[half] = np.minimum(low[left], low[right])
        high[half] = np.maximum(high[left], high[right])
        rise[half] = np.maximum(np.maximum(rise[left], rise[right]), high[right] - low[left])
        at //= 2
    first, last = np.array(starts, np.int64) + size, np.array(ends, np.int64) + 2 + size
    none = np.zeros(len(first), np.int64)
    front, back = [none + far, none - far, none], [none + far, none - far, none]
    while (first < last).any():
        node = np.where((first < last) & (first & 1 == 1), first, 0)
        here = [np.where(node > 0, low[node], far), np.where(node > 0, high[node], -far), np.where(node > 0, rise[node], 0)]
        front = [np.minimum(front[0], here[0]), np.maximum(front[1], here[1]),
                 np.maximum(np.maximum(front[2], here[2]), here[1] - front[0])]
        node_end = np.where((first < last) & (last & 1 == 1), last - 1, 0)
        here = [np.where(node_end > 0, low[node_end], far), np.where(node_end > 0, high[node_end], -far),
                np.where(node_end > 0, rise[node_end], 0)]
        back = [np.minimum(back[0], here[0]), np.maximum(back[1], here[1]),
                np.maximum(np.maximum(back[2], here[2]), back[1] - here[0])]
        first, last = (first + (node > 0)) >> 1, (last - (node_end > 0)) >> 1
    return np.maximum(np.maximum(front[2], back[2]), back[1] - front[0])


def called_in(lines, names, starts, ends, wanted) -> list[list[str]]:
    """Sorted distinct names that occur in each wanted block: for every name, the blocks its next place falls into."""
    out: list[list[str]] = [[] for _ in starts]
    blocks = np.flatnonzero(wanted)
    if not len(blocks) or not len(names):
        return out
    begin, end = np.array(starts)[blocks], np.array(ends)[blocks]
    order = np.argsort(names, kind="stable")
    lines, names = np.asarray(lines)[order], np.asarray(names)[order]
    cuts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]]).tolist() + [len(names)]
    for a, b in zip(cuts, cuts[1:]):
        place = np.searchsorted(lines[a:b], begin)
        found = np.flatnonzero((place < b - a) & (lines[a:b][np.minimum(place, b - a - 1)] <= end))
        for k in found.tolist():
            out[blocks[k]].append(names[a])
    return out

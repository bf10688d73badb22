"""Small documents with every awkward case, and plain versions of what the operators do."""
import hashlib
import random
import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "bucket int, kind string, spans string, rep long, passages string, row string, key long, cluster int")


def words(text):
    return WORD.findall((text or "").encode())


def awkward(seed=1, n=60):
    """(doc_id, text): shared passages, copies, near copies, nulls, blanks, ties, one long text."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeéß", k=rng.randint(1, 7))) for _ in range(300)]
    text = lambda k: " ".join(rng.choices(vocabulary, k=k))
    passages = [text(k) for k in (12, 13, 14, 40, 90)]
    rows = []
    for i in range(n):
        parts = [text(rng.randint(0, 60)) for _ in range(3)]
        for p in rng.sample(passages, rng.randint(0, 2)):
            parts.insert(rng.randint(0, 3), p)
        rows.append("\n".join(parts) if i % 3 else "  ".join(parts))
    rows += [rows[3], rows[3], rows[5].replace("a", "b", 1), rows[7] + " more", passages[3], passages[4] + " " + passages[4],
             None, None, "", " \t\n", "x", "one two three", "one two three", "ONE two three", "a b c", "w " * 40, "w " * 41,
             text(4000), "\n".join([passages[4]] * 3)]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return list(zip(ids, rows))


def table(spark, rows, parts=3):
    """The rows with more columns whose names the operators use themselves."""
    full = [(i, t, "en", "s", None if t is None else len(t), 1, "k", "s", 2, "p", "r", 3, 4) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def removed(rows, unit, window, join):
    """What ops 1 and 3 must remove, from a dictionary of all windows."""
    items = {i: unit(t) for i, t in rows}
    first = {}
    for i in sorted(items):
        for k in range(len(items[i]) - window + 1):
            first.setdefault(join(items[i][k:k + window]), i)
    out = {}
    for i, u in items.items():
        gone = bytearray(len(u))
        for k in range(len(u) - window + 1):
            if first[join(u[k:k + window])] < i:
                gone[k:k + window] = b"\1" * window
        kept = join([x for x, g in zip(u, gone) if not g])
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i] = (len(u), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def shingles(text, k):
    w = [bytes(x) for x in words((text or "").encode().lower().decode())]
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def linked(rows, k=4, percent=80):
    """doc_id -> smallest doc_id reachable over pairs of similar sets."""
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    holds = {}
    for i, s in sets.items():
        for x in s:
            holds.setdefault(x, []).append(i)
    pairs = {(a, b) for ids in holds.values() for a in ids for b in ids if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}

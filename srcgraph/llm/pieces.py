"""SentencePiece ids of whole texts, and texts of ids, by vectorised merge rounds.

A text is cut where no piece holds the two characters side by side, so merging
never crosses a cut; equal blank-led words of a slice are encoded once.  The
symbols of all words lie in one flat array.  A round finds the best ranked pair
of every word (a segmented minimum), merges all its leftmost occurrences at
once and drops the symbols that are gone, until no pair is left.  The library
merges one pair at a time, the best one first and of equal ones the leftmost.
Rounds give the same result: if a merge makes a neighbour pair that is no worse
than the pair itself, its word takes only the leftmost merge of that round.
Words of more than ``LONG`` symbols, which would need as many rounds, take
their merges from a heap instead.

Only models with byte fallback, a leading blank and no other normalisation are
read.  Null and empty texts have no ids.  Repeated rows and ties of doc_id are
separate rows, other columns are ignored, an empty table gives an empty one.
Long texts are encoded in slices of ``SLICE`` characters between cuts.
"""
from __future__ import annotations

import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from srcgraph.llm.tables import map_arrow

BLANK = "▁"
SLICE = 1 << 19
LONG = 400
NONE = np.int32(1 << 30)
_models: dict[str, "PieceModel"] = {}


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def groups(sizes) -> list[tuple[int, int]]:
    """Ranges of rows of about ``SLICE`` in size, a larger row alone."""
    out, start, held = [], 0, 0
    for n, size in enumerate(sizes):
        held += int(size)
        if held >= SLICE:
            out.append((start, n + 1))
            start, held = n + 1, 0
    return out + [(start, len(sizes))] if start < len(sizes) else out


def model(path: str) -> "PieceModel":
    """One model per worker process and vocabulary."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


class PieceModel:
    """Tables of one vocabulary: symbols of characters, pairs that merge, characters that touch in a piece."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        library = SentencePieceProcessor(model_file=path)
        if library.normalize("ﬁ  x ") != f"{BLANK}ﬁ{BLANK}{BLANK}x{BLANK}":
            raise ValueError(f"{path}: only models that add a leading blank and change nothing else")
        size = len(library)
        names = [library.id_to_piece(i) for i in range(size)]
        self.byte_ids = np.full(256, -1, np.int32)
        strings, texts, self.kinds = {}, [], np.zeros(size, np.int8)
        for i, name in enumerate(names):
            if library.is_byte(i):
                value = int(name[1:-1], 16)
                self.byte_ids[value], self.kinds[i] = i, 2
                texts.append(bytes([value]))
            elif library.is_control(i):
                self.kinds[i] = 1
                texts.append(b"")
            elif library.is_unknown(i):
                texts.append(" ⁇ ".encode())
            elif library.is_unused(i):
                raise ValueError(f"{path}: models with unused pieces are not read")
            else:
                strings[name.replace(BLANK, " ")] = i
                self.kinds[i] = 3 if name.startswith(BLANK) else 0
                texts.append(name.replace(BLANK, " ").encode())
        if (self.byte_ids < 0).any():
            raise ValueError(f"{path}: only models with byte fallback")
        self.text_sizes = np.array([len(t) for t in texts], np.int64)
        self.text_starts = np.cumsum(self.text_sizes) - self.text_sizes
        self.texts = np.frombuffer(b"".join(texts), np.uint8)
        self.decimals = [str(i) for i in range(size)]
        scores = sorted({library.get_score(i) for i in strings.values()}, reverse=True)
        rank_of = {score: n for n, score in enumerate(scores)}
        # Symbols: pieces, then characters that are only part of pieces, then all other characters.
        inner = sorted({c for s in strings for c in s} - set(strings))
        symbols = {**strings, **{c: size + n for n, c in enumerate(inner)}}
        self.size, self.base = size, size + len(inner)
        self.characters = np.array([ord(c) for c in inner], np.int32)
        self.symbol_of = np.arange(self.base, self.base + 0x110000, dtype=np.int32)
        for c, n in symbols.items():
            if len(c) == 1:
                self.symbol_of[ord(c)] = n
        pairs, touching = {}, set()
        for s, i in strings.items():
            for k in range(1, len(s)):
                touching.add(ord(s[k - 1]) << 21 | ord(s[k]))
                left, right = symbols.get(s[:k]), symbols.get(s[k:])
                if left is not None and right is not None:
                    pairs[left * self.base + right] = (rank_of[library.get_score(i)], i)
        self.touching = np.array(sorted(touching) or [-1], np.int64)
        self.keys = np.array(sorted(pairs) or [-1], np.int64)
        self.ranks = np.array([pairs[k][0] if pairs else 0 for k in self.keys.tolist()], np.int32)
        self.merged = np.array([pairs[k][1] if pairs else 0 for k in self.keys.tolist()], np.int32)

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of pairs; rank NONE where they do not merge."""
        known = (left < self.base) & (right < self.base)
        key = np.where(known, left.astype(np.int64) * self.base + right, -2)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], NONE), self.merged[at]

    def touch(self, points: np.ndarray) -> np.ndarray:
        """Whether some piece holds characters i and i + 1 side by side, for all but the last."""
        key = points[:-1].astype(np.int64) << 21 | points[1:]
        at = np.minimum(np.searchsorted(self.touching, key), len(self.touching) - 1)
        return self.touching[at] == key

    # --- merging -------------------------------------------------------------
    def merge(self, points: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words after all merges and the word of each, in text order."""
        symbol = self.symbol_of[points]
        if not len(symbol):
            return symbol, word
        joined = self.touch(points) & (word[1:] == word[:-1])
        segment = np.cumsum(np.r_[0, ~joined])
        owner = word[np.r_[True, ~joined]]
        sizes = np.bincount(segment)
        done = [(np.zeros(0, np.int32), np.zeros(0, np.int64))]
        if sizes.max() > LONG:
            starts = np.cumsum(sizes) - sizes
            for n in np.flatnonzero(sizes > LONG).tolist():
                out = self.one_by_one(symbol[starts[n]:starts[n] + sizes[n]])
                done.append((out, np.full(len(out), n)))
            short = (sizes <= LONG)[segment]
            symbol, segment = symbol[short], segment[short]
        done += self.rounds(symbol, segment)
        segment = np.concatenate([d[1] for d in done])
        order = np.argsort(segment, kind="stable")
        return np.concatenate([d[0] for d in done])[order], owner[segment[order]]

    def rounds(self, symbol: np.ndarray, segment: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Merge all segments at once, round by round; returns finished (symbols, segments)."""
        done = []
        rank, new = self.neighbours(symbol, segment, np.arange(len(symbol)))
        while len(symbol):
            first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(symbol)]))
            live = least < NONE
            if not live.all():
                done.append((symbol[~live], segment[~live]))
                symbol, segment, rank, new, least = (a[live] for a in (symbol, segment, rank, new, least))
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == least)
            run = np.maximum.accumulate(np.where(np.r_[True, np.diff(at) > 1], at, 0))
            at = at[(at - run) % 2 == 0]  # overlapping pairs: the leftmost, then every other one
            at = self.in_turn(symbol, segment, rank, new, at)
            symbol[at] = new[at]
            stays = np.ones(len(symbol), bool)
            stays[at + 1] = False
            symbol, segment, rank, new = (a[stays] for a in (symbol, segment, rank, new))
            at = at - np.arange(len(at))
            near = np.unique(np.r_[at, np.maximum(at - 1, 0)])
            rank[near], new[near] = self.neighbours(symbol, segment, near)
        return done

    def neighbours(self, symbol, segment, at) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of the pairs that start at these places."""
        after = np.minimum(at + 1, len(symbol) - 1)
        rank, new = self.pair(symbol[at], symbol[after])
        return np.where((after > at) & (segment[after] == segment[at]), rank, NONE), new

    def in_turn(self, symbol, segment, rank, new, at) -> np.ndarray:
        """Leave only the first merge of segments where a merge would be followed by another pair than the next one."""
        own = segment[at]
        more = np.r_[own[1:] == own[:-1], False]  # another merge of the segment follows
        i = np.flatnonzero(more)
        if not len(i):
            return at
        here = at[i]
        behind = here + 2
        inside = np.minimum(behind, len(symbol) - 1)
        right = np.where((behind < len(symbol)) & (segment[inside] == segment[here]), self.pair(new[here], symbol[inside])[0], NONE)
        was_merged = (i > 0) & (at[np.maximum(i - 1, 0)] == here - 2) & (here > 1)
        before = np.where(was_merged, new[np.maximum(here - 2, 0)], symbol[np.maximum(here - 1, 0)])
        left = np.where((here > 0) & (segment[np.maximum(here - 1, 0)] == segment[here]), self.pair(before, new[here])[0], NONE)
        late = np.minimum(left, right) <= rank[here]
        if not late.any():
            return at
        first = np.r_[True, own[1:] != own[:-1]]
        return at[first | ~np.isin(own, own[i[late]])]

    def one_by_one(self, symbol: np.ndarray) -> np.ndarray:
        """The same merges for one long segment, from a heap of pairs by rank and place."""
        rank, new = self.neighbours(symbol, np.zeros(len(symbol), np.int8), np.arange(len(symbol)))
        values = symbol.tolist()
        n = len(values)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        cache = {}
        at = np.flatnonzero(rank < NONE)
        heap = list(zip(rank[at].tolist(), at.tolist(), symbol[at].tolist(), symbol[np.minimum(at + 1, n - 1)].tolist(),
                        new[at].tolist()))
        heapify(heap)

        def push(i, j):
            pair = (values[i], values[j])
            if pair not in cache:
                r, m = self.pair(np.array([pair[0]]), np.array([pair[1]]))
                cache[pair] = (int(r[0]), int(m[0]))
            r, m = cache[pair]
            if r < NONE:
                heappush(heap, (r, i, *pair, m))

        while heap:
            _, i, left, right, merged = heappop(heap)
            j = after[i]
            if values[i] != left or j >= n or values[j] != right:
                continue
            values[i], values[j] = merged, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        out = np.array(values, np.int32)
        return out[out >= 0]

    # --- texts to ids ----------------------------------------------------------
    def ids_of(self, symbol: np.ndarray, word: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols, characters without a piece as bytes; and the number of ids per word."""
        odd = np.flatnonzero(symbol >= self.size)
        if len(odd):
            point = symbol[odd].astype(np.int64) - self.base
            point = np.where(point < 0, self.characters[np.minimum(symbol[odd] - self.size, len(self.characters) - 1)]
                             if len(self.characters) else 0, point)
            spelled = [chr(p).encode("utf-8", "surrogatepass") for p in point.tolist()]
            times = np.ones(len(symbol), np.int64)
            times[odd] = [len(s) for s in spelled]
            ids = np.repeat(symbol, times)
            ids[np.repeat(symbol >= self.size, times)] = self.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
            return ids, np.bincount(np.repeat(word, times), minlength=words)
        return symbol, np.bincount(word, minlength=words)

    def encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of normalised parts of texts, one after the other, and the number of ids of each part."""
        raw = [p.encode() for p in parts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(parts), np.int64)
        ends = np.cumsum([len(r) for r in raw])
        blank = data == 32
        begins = np.r_[True, blank[1:] & ~blank[:-1]]
        begins[ends[ends < len(data)]] = True
        offsets = np.r_[np.flatnonzero(begins), len(data)].astype(np.int32)
        coded = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        index = coded.indices.to_numpy()
        unique = coded.dictionary.to_pylist()
        points = np.frombuffer("".join(unique).encode("utf-32-le"), np.int32)
        word = np.repeat(np.arange(len(unique)), [len(u) for u in unique])
        ids, sizes = self.ids_of(*self.merge(points, word), len(unique))
        starts = np.cumsum(sizes) - sizes
        taken = sizes[index]
        place = np.cumsum(taken) - taken
        flat = ids[np.repeat(starts[index] - place, taken) + np.arange(taken.sum())]
        total = np.r_[0, np.cumsum(taken)]
        part_end = total[np.searchsorted(offsets, ends)]
        return flat, np.diff(np.r_[0, part_end])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the number of ids of each."""
        flat, counts = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
        parts, owners, held = [], [], 0

        def flush():
            ids, sizes = self.encode_parts(parts)
            flat.append(ids)
            np.add.at(counts, owners, sizes)
            parts.clear()
            owners.clear()

        for n, text in enumerate(texts):
            if not text:
                continue
            text = " " + text.replace(BLANK, " ")
            at = 0
            while at < len(text):
                cut = self.cut(text, at)
                parts.append(text[at:cut])
                owners.append(n)
                held += cut - at
                at = cut
                if held >= SLICE:
                    flush()
                    held = 0
        flush()
        return np.concatenate(flat), counts

    def cut(self, text: str, at: int) -> int:
        """End of the slice that starts at ``at``: the last place in reach that no piece crosses, else the first after it."""
        reach = at + SLICE
        while reach < len(text):
            points = np.frombuffer(text[at:reach + 1].encode("utf-32-le"), np.int32)
            free = np.flatnonzero(~self.touch(points))
            if len(free):
                return at + int(free[-1]) + 1
            reach += reach - at
        return len(text)

    # --- ids to texts ----------------------------------------------------------
    def decode(self, flat: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of ids: pieces joined, blanks restored, the leading blank left out, runs of byte pieces read as UTF-8."""
        if len(flat) and (flat.min() < 0 or flat.max() >= self.size):
            raise ValueError("an id outside the vocabulary")
        ends = np.r_[0, np.cumsum(counts)]
        return [text for a, b in groups(counts) for text in self.decode_rows(flat[ends[a]:ends[b]], counts[a:b])]

    def decode_rows(self, flat: np.ndarray, counts: np.ndarray) -> list[str]:
        sizes, begin = self.text_sizes[flat], self.text_starts[flat].copy()
        kind = self.kinds[flat]
        ends = np.cumsum(counts)
        row = np.repeat(np.arange(len(counts)), counts)
        said = np.flatnonzero(kind != 1)  # the first piece of a text that is no control piece may lose its blank
        first = said[np.r_[True, row[said][1:] != row[said][:-1]]] if len(said) else said
        first = first[kind[first] == 3]
        begin[first] += 1
        sizes[first] -= 1
        place = np.cumsum(sizes) - sizes
        data = self.texts[np.repeat(begin - place, sizes) + np.arange(sizes.sum())].tobytes()
        total = np.r_[0, np.cumsum(sizes)]
        out = []
        parted = np.isin(np.arange(len(counts)), row[kind == 1])  # control pieces part runs of bytes
        for n, (a, b) in enumerate(zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())):
            if parted[n]:
                out.append(self.broken(data[total[a]:total[b]], sizes[a:b], kind[a:b] == 2))
                continue
            try:
                out.append(data[total[a]:total[b]].decode())
            except UnicodeDecodeError:
                out.append(self.broken(data[total[a]:total[b]], sizes[a:b], kind[a:b] == 2))
        return out

    @staticmethod
    def broken(data: bytes, sizes: np.ndarray, is_byte: np.ndarray) -> str:
        """A text whose byte pieces are no UTF-8: every byte that does not decode becomes one U+FFFD."""
        out, at = [], 0
        turns = np.flatnonzero(np.r_[True, is_byte[1:] != is_byte[:-1]]).tolist() + [len(sizes)]
        for a, b in zip(turns, turns[1:]):
            end = at + int(sizes[a:b].sum())
            while at < end:
                try:
                    out.append(data[at:end].decode())
                    at = end
                except UnicodeDecodeError as e:
                    out.append(data[at:at + e.start].decode() + "�")
                    at += e.start + 1
        return "".join(out)


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids) of every document."""
    path = vocabulary or default_path()

    def run(batch):
        flat, counts = model(path).encode(batch.column(1).to_pylist())
        ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(flat, pa.int32()))
        yield pa.record_batch([batch.column(0).cast(pa.int64()), ids], ["doc_id", "ids"])
    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give the empty text."""
    path = vocabulary or default_path()

    def run(batch):
        lists = batch.column(1)
        counts = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        texts = model(path).decode(lists.flatten().to_numpy().astype(np.int64), counts)
        yield pa.record_batch([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])
    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text encoded, its ids decoded, both as digests."""
    path = vocabulary or default_path()

    def digest(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def run(batch):
        pieces, column = model(path), batch.column(1)
        said = pieces.decimals
        lengths = np.nan_to_num(pc.binary_length(column).to_numpy(zero_copy_only=False))
        for a, b in groups(lengths):
            flat, counts = pieces.encode(column[a:b].to_pylist())
            ends = np.cumsum(counts).tolist()
            ids = [digest(",".join([said[i] for i in flat[end - n:end].tolist()])) for end, n in zip(ends, counts.tolist())]
            texts = [digest(text) for text in pieces.decode(flat, counts)]
            yield pa.record_batch([batch.column(0)[a:b].cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.string()),
                                   pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

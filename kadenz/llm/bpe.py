"""Byte-level BPE by merge replay over the distinct pieces of a slice of the corpus.

A text is split by the vocabulary's pattern into pieces, and each piece is encoded by itself, so a slice of
the corpus needs every distinct piece once. All pieces that are new stand in one array of symbols; an inverted
index leads from a pair's rank to its positions. The merges are replayed in rank order, each at all of its
positions at once, and only the neighbours of merged pairs are looked at again. No shuffle is needed: a slice is
what one task reads, and its results are kept, up to a bound, for the task's later rows.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Pieces whose ids a task remembers, characters of a slice, and pieces of a longer text that are looked up at once.
REMEMBERED = 150_000
SLICE = 1_000_000
CHUNK = 100_000
#: Bytes above which a piece is replayed by itself: in a long one, repeats of one pair may have to merge one after the other.
ALONE = 512
#: Ranks, as a power of two, whose positions stand under one key of the index.
WINDOW = 9


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of a token's bytes and its rank, which is its id, in each line."""
    with open(path, "rb") as f:
        return ranks_from(f.read())


def ranks_from(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


class Merges:
    """Rank of each pair of tokens that merges, as sorted keys; ids and ranks are the same numbers."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = sorted((ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks)
        self.keys = np.array([k for k, _ in pairs], np.int64)
        self.made = np.array([r for _, r in pairs], np.int64)
        # tokens that can stand in a pair of lower rank than their own: equal pairs that make them merge one at a time
        parts = np.stack([self.keys >> 32, self.keys & 0xFFFFFFFF])
        self.turns = np.zeros(max(ranks.values()) + 1, bool)
        self.turns[parts[parts > self.made]] = True

    @cached_property
    def pairs(self) -> dict[int, int]:
        """The same as a dictionary, for pieces that are replayed by themselves."""
        return dict(zip(self.keys.tolist(), self.made.tolist(), strict=True))

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it does not merge."""
        if not len(self.keys):
            return np.full(len(a), -1)
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], -1)


def _apart(at: list[int], after: np.ndarray) -> list[int]:
    """Of positions in order, those whose pair does not overlap the one taken before."""
    out, barred = [], -1
    for i in at:
        if i != barred:
            out.append(i)
            barred = int(after[i])
    return out


class Index:
    """Positions by the window of their pair's rank, with the windows in order."""

    def __init__(self):
        self.held: dict[int, list] = {}
        self.queue: list[int] = []

    def add(self, positions: np.ndarray, ranks: np.ndarray) -> None:
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        positions, window = positions[order], ranks[order] >> WINDOW
        heads = np.concatenate([[0], np.flatnonzero(np.diff(window)) + 1]).tolist()
        for a, b in zip(heads, [*heads[1:], len(window)], strict=True):
            w = int(window[a])
            if w not in self.held:
                self.held[w] = []
                heapq.heappush(self.queue, w)
            self.held[w].append(positions[a:b])

    def least(self) -> tuple[int, np.ndarray]:
        w = heapq.heappop(self.queue)
        found = self.held.pop(w)
        return w, _distinct(np.concatenate(found) if len(found) > 1 else found[0])


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def replay(pieces: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the pieces one after the other, and how many each has.

    A piece that is a token is that token; else pairs merge, lowest rank and leftmost first.
    """
    apart = [i for i, p in enumerate(pieces) if len(p) > ALONE and p not in merges.ranks]
    if not apart:
        return _together(pieces, merges)
    there = set(apart)
    ids, counts = _together([b"" if i in there else p for i, p in enumerate(pieces)], merges)
    ends, parts, begun = np.cumsum(counts), [], 0
    for i in apart:
        one = _alone(pieces[i], merges)
        parts += [ids[begun : ends[i]], one]
        begun, counts[i] = ends[i], len(one)
    return np.concatenate([*parts, ids[begun:]]), counts


def _alone(piece: bytes, merges: Merges) -> np.ndarray:
    """Ids of one long piece; the index is a heap of (rank, position), so each merge costs a step or two, whatever repeats."""
    pairs, n = merges.pairs, len(piece)
    sym = merges.single[np.frombuffer(piece, np.uint8)].tolist()
    after, before = array("q", range(1, n + 1)), array("q", range(-1, n))
    heap = [r << 40 | i for i in range(n - 1) if (r := pairs.get(sym[i] << 32 | sym[i + 1], -1)) >= 0]
    heapq.heapify(heap)
    place = (1 << 40) - 1
    while heap:
        top = heapq.heappop(heap)
        r, i = top >> 40, top & place
        j = after[i]
        if sym[i] < 0 or j >= n or pairs.get(sym[i] << 32 | sym[j], -1) != r:
            continue  # a neighbour has merged since
        sym[i], sym[j] = r, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (new := pairs.get(r << 32 | sym[k], -1)) >= 0:
                heapq.heappush(heap, new << 40 | i)
        h = before[i]
        if h >= 0 and (new := pairs.get(sym[h] << 32 | r, -1)) >= 0:
            heapq.heappush(heap, new << 40 | h)
    return np.array([s for s in sym if s >= 0], np.int64)


def _together(pieces: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Short pieces, all in one array."""
    whole = np.array([-1 if p not in merges.ranks else merges.ranks[p] for p in pieces], np.int64)
    sizes = np.array([len(p) if w < 0 else 1 for p, w in zip(pieces, whole.tolist(), strict=True)], np.int64)
    ends = np.cumsum(sizes)
    first = (ends - sizes)[whole >= 0]
    raw = np.frombuffer(b"".join(p if w < 0 else b"\0" for p, w in zip(pieces, whole.tolist(), strict=True)), np.uint8)
    sym, n = merges.single[raw], len(raw)
    sym[first] = whole[whole >= 0]
    piece = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    some = sizes > 0
    after[ends[some] - 1], before[(ends - sizes)[some]] = -1, -1
    # rank of the pair that begins at each position; the index holds the positions of each window of ranks
    pair = np.full(n, -1)
    inner = np.flatnonzero(after >= 0).astype(np.int32)
    pair[inner] = merges.rank(sym[inner], sym[inner + 1])
    there = inner[pair[inner] >= 0]
    index = Index()
    index.add(there, pair[there])
    while index.queue:
        w, at = index.least()
        ranks = pair[at]
        live = ranks >> WINDOW == w  # else a neighbour has merged since
        at, ranks = at[live], ranks[live]
        if not len(at):
            continue
        # all lower windows are empty, so a piece's lowest rank is the lowest that it has here; the others wait
        owner = piece[at]
        same = owner[1:] == owner[:-1]
        if same.any():
            heads = np.flatnonzero(np.concatenate([[True], ~same]))
            lowest = np.repeat(np.minimum.reduceat(ranks, heads), np.diff(np.append(heads, len(at))))
            now = ranks == lowest
            index.add(at[~now], ranks[~now])
            at, ranks = at[now], ranks[now]
            again = np.concatenate([[False], piece[at[1:]] == piece[at[:-1]]]) & merges.turns[ranks]
            index.add(at[again], ranks[again])
            at, ranks = at[~again], ranks[~again]
            if (after[at[:-1]] == at[1:]).any():
                at = np.array(_apart(at.tolist(), after), np.int32)
                ranks = pair[at]
        gone = after[at]
        beyond = after[gone]
        sym[at], sym[gone] = ranks, -1
        pair[at], pair[gone], after[at] = -1, -1, beyond
        right = beyond >= 0
        before[beyond[right]] = at[right]
        left = before[at]
        touched = _distinct(np.concatenate([at[right], left[left >= 0]]))
        new = merges.rank(sym[touched], sym[after[touched]])
        pair[touched] = new
        fits = new >= 0
        index.add(touched[fits], new[fits])
    living = np.flatnonzero(sym >= 0)
    return sym[living], np.bincount(piece[living], minlength=len(pieces))


class Runs:
    """Runs of numbers, one for each code from 0 on, that grow at the end."""

    def __init__(self, kind):
        self.flat, self.start, self.size = np.empty(0, kind), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, flat: np.ndarray, size: np.ndarray) -> None:
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, flat.astype(self.flat.dtype)])

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes' runs one after the other, and where each ends."""
        size = self.size[codes]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.start[codes] - (ends - size), size) + np.arange(size.sum())], ends


class Codes(dict):
    """piece -> code in order of arrival; remembers which are new."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        code = self[piece] = len(self)
        self.new.append(piece)
        return code


def _ends(ends: np.ndarray, counts: list[int]) -> np.ndarray:
    """Where each of several consecutive groups ends, given where each member ends."""
    return np.concatenate([[0], ends])[np.cumsum(counts)]


class Encoder:
    """Ids of texts, and the bytes that ids stand for."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.merges, self.pattern = Merges(ranks), regex.compile(pattern)
        self.known, self.ids = Codes(), Runs(np.uint32)
        self.bytes = Runs(np.uint8)
        tokens = {i: t for t, i in ranks.items()}
        held = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.bytes.add(np.frombuffer(b"".join(held), np.uint8), np.array([len(t) for t in held]))

    def _ids(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.known.new:
            self.ids.add(*replay([p.encode() for p in self.known.new], self.merges))
            self.known.new.clear()
        found = self.ids.of(codes)
        if len(self.known) > REMEMBERED:
            self.known, self.ids = Codes(), Runs(np.uint32)
        return found

    def slice(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text ends."""
        if len(texts) == 1 and len(texts[0]) > SLICE:
            return self._long(texts[0])
        parts = [np.fromiter(map(self.known.__getitem__, ps), np.int32, len(ps)) for ps in map(self.pattern.findall, texts)]
        ids, ends = self._ids(np.concatenate(parts))
        return ids, _ends(ends, [len(p) for p in parts])

    def _long(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """A text that is a slice of its own never stands in memory as pieces."""
        found, out = self.pattern.finditer(text), [np.empty(0, np.uint32)]
        while len(codes := np.fromiter((self.known[m[0]] for m in islice(found, CHUNK)), np.int32)):
            out.append(self._ids(codes)[0])
        ids = np.concatenate(out)
        return ids, np.array([len(ids)])

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of several texts one after the other, and where each text ends."""
        got, at = self.bytes.of(ids)
        return got, np.concatenate([[0], at])[ends]


@lru_cache(maxsize=2)
def _encoder(raw: bytes, pattern: str) -> Encoder:
    """A Python worker keeps its encoder for the tasks that follow."""
    return Encoder(ranks_from(raw), pattern)


def sliced(batch: pa.RecordBatch, name: str, size: int = SLICE) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Consecutive rows whose texts have about `size` characters together, and these texts; null counts as empty.

    A longer text is a slice of its own."""
    column, part, n, begun = batch.column(name), [], 0, 0
    for at in range(0, batch.num_rows, 256):
        for t in column.slice(at, 256).to_pylist():
            if part and n + len(t or "") > size:
                yield batch.slice(begun, len(part)), part
                begun, part, n = begun + len(part), [], 0
            part.append(t or "")
            n += len(part[-1])
    if part:
        yield batch.slice(begun, len(part)), part


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Consecutive runs of values as binaries, without a Python object for each."""
    offsets = np.concatenate([[0], ends * values.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _with(df: DataFrame, column: str, columns: list[str] | None, new: list[str], run) -> DataFrame:
    """df with binary columns added by `run`, which makes a function from (rows, name of the column) to (rows, arrays)."""
    kept = [c for c in columns or df.columns if c not in new]
    inner = [f"__k{i}" for i in range(len(kept))]

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = run()
        for b in found:
            for rows, made in use(b, "__in"):
                yield pa.RecordBatch.from_arrays([*[rows.column(i) for i in inner], *made], names=[*inner, *[f"__m{i}" for i in range(len(new))]])

    kinds = dict(df.dtypes)
    wide = df.select(*[df[f"`{c}`"].alias(i) for c, i in zip(kept, inner, strict=True)], df[f"`{column}`"].alias("__in"))
    schema = [*[f"{i} {kinds[c]}" for c, i in zip(kept, inner, strict=True)], *[f"__m{i} binary" for i in range(len(new))]]
    return wide.mapInArrow(batches, ", ".join(schema)).toDF(*kept, *new)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out_col: str = "ids", decoded_col: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Adds the ids of each text, packed as little-endian unsigned 32-bit integers.

    decoded_col: also adds the bytes that these ids stand for, in the same pass. columns: input columns to return
    (all, if not given). A null or empty text has no ids. Special tokens have no meaning in a text. Rows may
    repeat; other columns stay, whatever they are called, but one called like a result is replaced. Every byte
    must be in the vocabulary, as it is in byte-level ones. An empty table gives an empty result.
    """
    with open(ranks_path, "rb") as f:
        raw = f.read()

    def run():
        encoder = _encoder(raw, pattern)

        def use(batch: pa.RecordBatch, name: str) -> Iterator:
            for rows, texts in sliced(batch, name):
                ids, ends = encoder.slice(texts)
                yield rows, [_binary(ids, ends), *([_binary(*encoder.decode(ids, ends))] if decoded_col else [])]

        return use

    return _with(docs, text_col, columns, [out_col, *([decoded_col] if decoded_col else [])], run)


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the bytes that the ids stand for; null ids give no bytes."""
    with open(ranks_path, "rb") as f:
        raw = f.read()

    def run():
        encoder = _encoder(raw, "")

        def use(batch: pa.RecordBatch, name: str) -> Iterator:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                parts = [np.frombuffer(x or b"", "<u4") for x in rows.column(name).to_pylist()]
                yield rows, [_binary(*encoder.decode(np.concatenate(parts), np.cumsum([len(p) for p in parts])))]

        return use

    return _with(encoded, ids_col, None, [out_col], run)

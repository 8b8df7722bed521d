"""Best-fit packing with certified bin counts and exchange between partitions.

Texts become pieces of at most `capacity` tokens. Pieces are dealt over partitions, and each packs its own by
best-fit decreasing. Dual feasible functions over the partition's size histogram give a lower bound of its
bin count. Where bins and bound agree the count is certified as least possible; partitions with gaps give up
the documents of their emptiest bins, as many as the gap could save, exchange them within groups of FAN partitions, and
repack them. The groups grow round by round until one is left, and a member never gives more than OPEN / FAN pieces, its
emptiest bins first, so a group is bounded whatever the size of the table.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kadenz.llm import tokens as T
from kadenz.llm import words as W
from kadenz.llm.staging import stage

CAPACITY = 2048
#: The id after each document.
END = 0
#: Pieces of a partition on average, and partitions that exchange with each other.
PIECES = 50_000
FAN = 16
#: Pieces of the open bins of a group, at most (a member's emptiest bin is always among them).
OPEN = 2 * PIECES
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _piece_rows(ids: np.ndarray, capacity: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc). Only the first piece of a long document is shorter than the capacity."""
    n, k = len(ids), -(-len(ids) // capacity)
    ends = [n - capacity * (k - 1 - i) for i in range(k)]
    starts = [0, *ends[:-1]]
    return [(i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(starts, ends, strict=True))]


def ranks_of(tokenizer_path: str) -> dict[bytes, int]:
    """Bytes and id of each token of a byte-level tokenizer file, whose merges must stand in the order of their ids.

    Then its ids are those that merging by lowest rank gives, which runs much faster over whole texts. The file's
    strings show a byte as its Latin-1 character where that is printable, and as the next of U+0100 on where not.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    parts = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [model["vocab"]["".join(m)] for m in parts]
    if made != sorted(set(made)):
        raise ValueError(f"{tokenizer_path}: merges are not in the order of their ids")
    tokens = {t: i for t, i in model["vocab"].items() if len(t) == 1 or i >= made[0]}
    return {bytes(byte[c] for c in t): i for t, i in tokens.items() if all(c in byte for c in t) and (len(t) == 1 or i <= made[-1])}


def added_tokens(tokenizer_path: str) -> dict[str, int]:
    """Content and id of the tokens that a tokenizer file finds in a text before it splits the rest."""
    with open(tokenizer_path, encoding="utf-8") as f:
        found = json.load(f).get("added_tokens") or []
    if odd := [t["content"] for t in found if t.get("single_word") or t.get("lstrip") or t.get("rstrip")]:
        raise ValueError(f"{tokenizer_path}: added tokens with rules about their neighbours: {odd}")
    return {t["content"]: t["id"] for t in found if t["content"]}


def pieces(docs: DataFrame, tokenizer_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32.

    A document is the ids of its text, then id END; null text counts as empty, so every row has a piece at
    least. No special tokens are put around a text, but added tokens of the file that stand in it get their ids.
    """
    ranks, added = ranks_of(tokenizer_path), added_tokens(tokenizer_path)
    # the longest of those that start at a place; without added tokens a pattern that never fits
    split = "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) or r"(?!)"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinary = T.ordinary(ranks, pattern)
        at_added = re.compile(f"({split})")

        def encode(text: str) -> list[int]:
            parts = at_added.split(text)
            ids = ordinary(parts[0])
            for token, rest in zip(parts[1::2], parts[2::2], strict=True):
                ids.append(added[token])
                ids += ordinary(rest)
            return ids

        for batch in batches:
            rows = []
            for d, t in zip(W.column(batch, "__id"), W.column(batch, "__text"), strict=True):
                ids = np.array([*encode(t or ""), END], "<u4")
                rows += [(d, *r) for r in _piece_rows(ids, capacity)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text")).mapInArrow(run, PIECE)


def least_space(counts: np.ndarray, capacity: int) -> int:
    """Space that sizes 1..capacity, counts[size] of each, need at least, by two families of dual feasible functions.

    The first raises sizes above capacity - t to a whole bin, and drops those below t. The second rounds
    size * (k + 1) / capacity down to multiples of capacity / k, but keeps whole multiples.
    """
    sizes = np.arange(capacity + 1)
    total = np.cumsum(counts)
    weight = np.cumsum(counts * sizes)
    t = np.arange(capacity // 2 + 1)
    large = total[-1] - total[capacity - t]
    between = weight[capacity - t] - weight[np.maximum(t - 1, 0)]
    best = int(max(large * capacity + between))
    for k in range(1, 65):
        scaled = sizes * (k + 1)
        whole = scaled % capacity == 0
        # in units of 1 / k: k * size where whole, else the rounded number of parts times capacity
        value = np.where(whole, sizes * k, scaled // capacity * capacity)
        best = max(best, int(-(-int((counts * value).sum()) // k)))
    return best


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that these sizes need at least."""
    return -(-least_space(counts, capacity) // capacity)


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin of each item and fill of each bin; lengths fall. The fullest bin that fits is found in a bit set of free sizes."""
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    there, place, fill = 0, [], []
    for n in lengths:
        fits = there >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                there &= ~(1 << r)
        else:
            b, r = len(fill), capacity
            fill.append(0)
        fill[b] += n
        free[r - n].append(b)
        there |= 1 << (r - n)
        place.append(b)
    return place, fill


STATE = f"{PIECE}, grp long, bin long, offset long, open boolean, counts binary, bins long"


def _repack(capacity: int, number: int, most: int):
    """A round over one group: its open pieces and its members' summaries (rows without a length). It leaves `most` pieces open at most."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        grp = key[0].as_py()
        cols = {n: np.array(table.column(n).to_pylist(), object) for n in table.column_names}
        summary = np.array([x is not None for x in cols["counts"]], bool)
        counts = np.zeros(capacity + 1, np.int64)
        for x in cols["counts"][summary]:
            counts += np.frombuffer(x, np.int64)
        bins = int(sum(cols["bins"][summary]))
        item = {n: cols[n][~summary] for n in ("doc_id", "piece", "start", "length", "ids_crc32", "bin", "grp")}
        length = item["length"].astype(np.int64)
        if number == 0:
            counts = np.bincount(length, minlength=capacity + 1).astype(np.int64)
        ids = np.array([-(1 << 63) if d is None else d for d in item["doc_id"]], np.int64)
        order = np.lexsort((item["ids_crc32"].astype(np.int64), item["piece"].astype(np.int64), ids, -length))
        old = list(zip(item["grp"][order], item["bin"][order], strict=True))
        length = length[order]
        before = len(set(old)) if number else 0
        least = least_space(counts, capacity)
        place, fill = None, []
        if number == 0 or bins > -(-least // capacity):  # else certified: nothing to gain
            place, fill = best_fit(length.tolist(), capacity)
        if number and (place is None or len(fill) >= before):
            names = {b: i for i, b in enumerate(dict.fromkeys(old))}
            place = [names[b] for b in old]
            fill = np.bincount(place, weights=length, minlength=len(names)).astype(int).tolist() if names else []
        bins = len(fill) if number == 0 else bins - before + len(fill)
        place, fill = np.array(place, np.int64), np.array(fill, np.int64)
        # the emptiest bins stay open, as many as hold the space beyond what the sizes need; where they need all, none
        spare = bins * capacity - least
        emptiest = np.argsort(fill, kind="stable")
        room = np.cumsum((capacity - fill)[emptiest])
        n_open = min(len(fill), int(np.searchsorted(room, spare, side="left")) + 1) if spare else 0
        if n_open:
            n_open = min(n_open, max(1, int(np.searchsorted(np.cumsum(np.bincount(place, minlength=len(fill))[emptiest]), most, side="right"))))
        is_open = np.zeros(len(fill), bool)
        is_open[emptiest[:n_open]] = True
        by_bin = np.argsort(place, kind="stable")
        run_start = np.cumsum(length[by_bin]) - length[by_bin]
        first = np.searchsorted(place[by_bin], np.arange(len(fill)))
        offset = np.empty(len(length), np.int64)
        offset[by_bin] = run_start - (run_start[first][place[by_bin]] if len(length) else 0)
        pick = lambda n: [item[n][i] for i in order]
        # round and group keep the numbers of bins apart
        label = place + ((np.int64(number) << np.int64(56)) + (np.int64(grp) << np.int64(24)))
        out = {
            "doc_id": pa.array([*pick("doc_id"), None], pa.int64()), "piece": pa.array([*pick("piece"), None], pa.int32()),
            "start": pa.array([*pick("start"), None], pa.int64()), "length": pa.array([*length.tolist(), None], pa.int64()),
            "ids_crc32": pa.array([*pick("ids_crc32"), None], pa.int64()), "grp": pa.array([grp] * (len(length) + 1), pa.int64()),
            "bin": pa.array([*label.tolist(), None], pa.int64()), "offset": pa.array([*offset.tolist(), None], pa.int64()),
            "open": pa.array([*(is_open[place].tolist() if len(length) else []), True], pa.bool_()),
            "counts": pa.array([*[None] * len(length), counts.tobytes()], pa.binary()), "bins": pa.array([*[None] * len(length), bins], pa.int64()),
        }
        return pa.table(out)

    return run


def pack(cut: DataFrame, capacity: int = CAPACITY, per_partition: int = PIECES, fan: int = FAN, open_pieces: int = OPEN) -> DataFrame:
    """Adds sequence_id and offset to pieces (columns as in PIECE, lengths from 1 to capacity).

    Sequences are filled without gaps from 0. Rows may repeat: each is a piece of its own. A null doc_id is
    packed like any other. An empty table gives an empty result. The pieces of a partition are bounded by
    per_partition on average, and what a group of `fan` exchanges by open_pieces.
    """
    cut = stage(cut, "pieces")
    parts = max(1, -(-cut.count() // per_partition))
    dealt = F.pmod(F.xxhash64("doc_id", "piece", "start", "length", "ids_crc32"), F.lit(parts)) if parts > 1 else F.lit(0)
    state = cut.select("*", dealt.cast("long").alias("grp"), F.lit(None).cast("long").alias("bin"), F.lit(None).cast("binary").alias("counts"), F.lit(None).cast("long").alias("bins"))
    done, number = [], 0
    while True:
        state = stage(state.groupBy("grp").applyInArrow(_repack(capacity, number, max(1, open_pieces // fan)), STATE), f"packed-{number}")
        placed = state.where("length IS NOT NULL")
        if parts == 1 or placed.where("open").isEmpty():  # one group, or nothing open
            done.append(placed)
            break
        done.append(placed.where(~F.col("open")))
        parts, number = -(-parts // fan), number + 1
        state = state.where("open").withColumn("grp", F.floor(F.col("grp") / fan))
        state = state.select("doc_id", "piece", "start", "length", "ids_crc32", "grp", "bin", "counts", "bins")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(bins, bound, gap): sequences of a packing, what its sizes need at least, and the difference. Sizes are counted first."""
    sizes = packed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per size
    counts = np.zeros(capacity + 1, np.int64)
    for r in sizes:
        counts[r.length] = r.n
    bound = lower_bound(counts, capacity)
    return packed.agg(F.count_distinct("sequence_id").alias("bins")).select("bins", F.lit(bound).cast("long").alias("bound"), (F.col("bins") - bound).alias("gap"))

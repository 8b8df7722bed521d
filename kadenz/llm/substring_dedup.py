"""Substring dedup with difference-cover anchors.

Only positions p with p mod PERIOD in COVER are hashed at first, over runs of window - PERIOD + 1 words (the
anchors). For any two positions there is a shift below PERIOD that brings both into the cover, so two equal
windows always share an aligned anchor. Anchors that occur once rule out every window around them. What is
left extends to whole windows, which are compared by 128-bit hashes: of equal windows the one that starts
first stays, and the words of the others go.

Anchors and windows travel packed, one row per Arrow batch and bucket. Those that repeat within a batch are
settled there, and one witness goes on, so a passage in a third of all documents costs one entry per batch.
There are as many buckets as the text's bytes ask for, so a task's share stays the same on larger inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kadenz.llm import words as W

#: Words of a window.
WINDOW = 20
#: Perfect difference covers: every difference modulo the period occurs between two members. Fixed values.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
#: Words that an anchor has at least, if the window has that many.
ANCHOR = 8
#: Rows with a null id sort before all others.
NULL_ID = -(1 << 63)
PACKED = "bucket int, ids binary, tags binary, sizes binary, pos binary, h1 binary, h2 binary"
FLAGS = "__id long, __tag long, found binary"
#: Bytes of text whose anchors or windows make up a bucket, and whose texts make up a task's share of the joins.
BUCKET, SHARE = 16 << 20, 64 << 20


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The largest period that leaves anchors of ANCHOR words; for short windows every position counts."""
    fits = [p for p in COVERS if window - p + 1 >= min(ANCHOR, window)]
    return (max(fits), COVERS[max(fits)]) if fits else (1, (0,))


class Batch:
    """All words of an Arrow batch in one array, with the documents' offsets."""

    def __init__(self, batch, cache: W.WordHashes):
        self.ids = np.array(W.column(batch, "__id"), np.int64)
        self.tags = np.array(W.column(batch, "__tag"), np.int64)
        parts = [W.hashes(W.split(t), cache) for t in W.column(batch, "__text")]
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.words = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.doc = np.repeat(np.arange(len(parts), dtype=np.int32), self.sizes)
        self.pos = np.concatenate([np.arange(n, dtype=np.int32) for n in self.sizes.tolist()]) if parts else np.empty(0, np.int32)

    def inside(self, m: int) -> np.ndarray:
        """Positions where m words of one document begin."""
        n = max(0, len(self.words) - m + 1)
        return np.flatnonzero(self.pos[:n] + m <= self.sizes[self.doc[:n]])


def _packed(bucket: int, b: Batch, at: np.ndarray, h1: np.ndarray, h2: np.ndarray | None) -> dict:
    """One row for the entries `at` (positions in the batch, ascending) of a bucket; bucket -1 holds settled ones."""
    doc, first = np.unique(b.doc[at], return_index=True)
    sizes = np.diff(np.append(first, len(at)))
    return {
        "bucket": bucket, "ids": W.planes(b.ids[doc]), "tags": W.planes(b.tags[doc]), "sizes": W.planes(sizes.astype(np.int32)),
        "pos": W.planes(b.pos[at].astype(np.int32)), "h1": h1.tobytes(), "h2": b"" if h2 is None else h2.tobytes(),
    }


def _rows(rows: list[dict]) -> pa.RecordBatch:
    names = [("bucket", pa.int32()), *((n, pa.binary()) for n in ("ids", "tags", "sizes", "pos", "h1", "h2"))]
    return pa.RecordBatch.from_pydict({n: [r[n] for r in rows] for n, _ in names}, schema=pa.schema(names))


def _by_bucket(b: Batch, at: np.ndarray, h1: np.ndarray, h2: np.ndarray | None, dealt: np.ndarray, buckets: int) -> list[dict]:
    """dealt: the hash whose remainder is the bucket."""
    bucket = (dealt % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    return [_packed(int(bucket[o[0]]), b, at[o], h1[o], None if h2 is None else h2[o]) for o in np.split(order, cuts) if len(o)]


def _groups(order: np.ndarray, differs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted entries: the group number of each, and each group's size."""
    group = np.concatenate([[0], np.cumsum(differs)])
    return group, np.bincount(group)


def _settled(b: Batch, at: np.ndarray, salt: int, buckets: int) -> list[dict]:
    """Positions known to count travel with a negative bucket, spread over the tasks."""
    if not len(at):
        return []
    none = np.empty(0, np.uint64)
    return [_packed(-1 - salt % buckets, b, np.sort(at), none, none)]


def anchors(window: int, buckets: int):
    period, cover = cover_for(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = W.WordHashes()
        for k, batch in enumerate(batches):
            b = Batch(batch, cache)
            m = window - period + 1
            at = b.inside(m)
            at = at[np.isin(b.pos[at] % period, cover) & (b.sizes[b.doc[at]] >= window)]
            if not len(at):
                continue
            full = W.runs(b.words, m)[at]
            order = np.argsort(full, kind="stable")
            group, size = _groups(order, np.diff(full[order]) != 0)
            again = size[group] > 1
            lead = np.concatenate([[True], np.diff(group) > 0])
            # lowest bit: known to repeat. The bucket comes from the upper half, the entry keeps the lower half
            sent = order[lead]
            marked = (full[sent].astype(np.uint32) & np.uint32(0xFFFFFFFE)) | again[lead].astype(np.uint32)
            resort = np.argsort(sent)
            sent, marked = sent[resort], marked[resort]
            rows = _by_bucket(b, at[sent], marked, None, full[sent] >> np.uint64(32), buckets)
            yield _rows(rows + _settled(b, at[order[again]], int(b.ids[0]) + k, buckets))

    return run


def _unpack(table: pa.Table, kind) -> dict[str, np.ndarray]:
    def joined(name: str, dtype) -> np.ndarray:
        return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype)

    def merged(name: str, dtype) -> np.ndarray:
        return np.concatenate([W.from_planes(x, dtype) for x in table.column(name).to_pylist()])

    sizes = merged("sizes", np.int32)
    return {"ids": np.repeat(merged("ids", np.int64), sizes), "tags": np.repeat(merged("tags", np.int64), sizes), "pos": merged("pos", np.int32), "h1": joined("h1", kind), "h2": joined("h2", np.uint64)}


def _flagged(ids: np.ndarray, tags: np.ndarray, pos: np.ndarray, buckets: int) -> pa.Table:
    """Positions packed again, this time by the documents' buckets. They are fewer bytes, so a quarter of the buckets do."""
    buckets = -(-buckets // 4)
    dealt = (W.mix(ids.view(np.uint64) ^ tags.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((pos, tags, ids, dealt))
    dealt, ids, tags, pos = dealt[order], ids[order], tags[order], pos[order].astype(np.int32)
    rows = []
    for part in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(dealt)) + 1):
        if len(part):
            i, t = ids[part], tags[part]
            first = np.concatenate([[0], np.flatnonzero((np.diff(i) != 0) | (np.diff(t) != 0)) + 1])
            sizes = np.diff(np.append(first, len(part))).astype(np.int32)
            rows.append({"bucket": int(dealt[part[0]]), "ids": W.planes(i[first]), "tags": W.planes(t[first]), "sizes": W.planes(sizes), "pos": W.planes(pos[part]), "h1": b"", "h2": b""})
    return pa.Table.from_batches([_rows(rows)])


def by_document(table: pa.Table) -> pa.Table:
    """One row per document of a bucket, with its positions in order."""
    e = _unpack(table, np.uint32)
    order = np.lexsort((e["pos"], e["tags"], e["ids"]))
    ids, tags, pos = e["ids"][order], e["tags"][order], e["pos"][order]
    cuts = np.flatnonzero((np.diff(ids) != 0) | (np.diff(tags) != 0)) + 1
    heads = np.concatenate([[0], cuts]).astype(np.int64)
    return pa.table({"__id": pa.array(ids[heads], pa.int64()), "__tag": pa.array(tags[heads], pa.int64()), "found": W.binary(np.split(pos, cuts))})


def repeated_anchors(buckets: int):
    """Positions of the anchors of a bucket that occur twice or more. A chance hit of the short hash only costs work."""

    def run(table: pa.Table) -> pa.Table:
        e = _unpack(table, np.uint32)
        if table.column("bucket")[0].as_py() < 0:
            return _flagged(e["ids"], e["tags"], e["pos"], buckets)
        key = e["h1"] >> np.uint32(1)
        _, group, size = np.unique(key, return_inverse=True, return_counts=True)
        known = np.zeros(len(size), bool)
        known[group[(e["h1"] & np.uint32(1)) > 0]] = True
        hit = (size[group] > 1) | known[group]
        return _flagged(e["ids"][hit], e["tags"][hit], e["pos"][hit], buckets)

    return run


def windows(window: int, buckets: int):
    """Of documents with repeated anchors: the windows that hold one. Batch-wise, later ones of equal windows are settled."""
    period, _ = cover_for(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = W.WordHashes()
        for k, batch in enumerate(batches):
            b = Batch(batch, cache)
            mark = np.zeros(len(b.words) + 1, np.int32)
            for d, found in enumerate(W.column(batch, "found")):
                p = np.frombuffer(found, np.int32).astype(np.int64)
                np.add.at(mark, b.starts[d] + np.maximum(0, p - period + 1), 1)
                np.add.at(mark, b.starts[d] + np.minimum(b.sizes[d], p + 1), -1)
            at = b.inside(window)
            at = at[np.cumsum(mark, dtype=np.int32)[at] > 0]
            if not len(at):
                continue
            h1, h2 = W.runs(b.words, window)[at], W.runs(b.words, window, W.BASES[1])[at]
            ids, pos = b.ids[b.doc[at]], b.pos[at]
            order = np.lexsort((pos, ids, h2, h1))
            s1, s2, si, sp = h1[order], h2[order], ids[order], pos[order]
            group, _ = _groups(order, (np.diff(s1) != 0) | (np.diff(s2) != 0))
            head = np.searchsorted(group, group)
            later = (si != si[head]) | (sp != sp[head])
            sent = np.sort(order[~later])
            rows = _by_bucket(b, at[sent], h1[sent], h2[sent], h1[sent] >> np.uint64(32), buckets)
            yield _rows(rows + _settled(b, at[order[later]], int(b.ids[0]) + k, buckets))

    return run


def later_windows(buckets: int):
    """Of the equal windows of a bucket, all that do not start first."""

    def run(table: pa.Table) -> pa.Table:
        e = _unpack(table, np.uint64)
        if table.column("bucket")[0].as_py() < 0:
            return _flagged(e["ids"], e["tags"], e["pos"], buckets)
        order = np.lexsort((e["pos"], e["ids"], e["h2"], e["h1"]))
        h1, h2, ids, tags, pos = (e[c][order] for c in ("h1", "h2", "ids", "tags", "pos"))
        group, _ = _groups(order, (np.diff(h1) != 0) | (np.diff(h2) != 0))
        head = np.searchsorted(group, group)
        later = (ids != ids[head]) | (pos != pos[head])
        return _flagged(ids[later], tags[later], pos[later], buckets)

    return run


def removed(window: int, names: list[str], tidy: bool):
    """Replaces the text by its kept words, and adds the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, total, gone = [], [], []
            for text, found in zip(W.column(batch, "__text"), W.column(batch, "found"), strict=True):
                ws = W.split(text)
                cover = np.zeros(len(ws) + 1, np.int64)
                p = np.frombuffer(found or b"", np.int32).astype(np.int64)
                np.add.at(cover, p, 1)
                np.add.at(cover, np.minimum(len(ws), p + window), -1)
                out = np.cumsum(cover[:-1]) > 0
                n = int(out.sum())
                kept = [w for w, x in zip(ws, out.tolist(), strict=True) if not x] if n else ws
                texts.append(b" ".join(kept).decode() if tidy or n else text or "")
                total.append(len(ws))
                gone.append(n)
            made = {"__kept": pa.array(texts, pa.string()), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(gone, pa.int64())}
            yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(n) for n in names], names=names)

    return run


def _gathered(packed: DataFrame, buckets: int):
    """Packed rows by bucket, in as many tasks as there are buckets."""
    return packed.repartition(buckets, "bucket").groupBy("bucket")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, tidy: bool = True) -> DataFrame:
    """Removes each word that lies in a window whose words also start earlier; adds n_words and n_removed.

    The text becomes its kept words, joined by one space; unless tidy, a text that loses nothing stays as it is.
    Earlier means a smaller id, or the same id and an
    earlier start; windows are judged on the input. Other columns stay; input columns named n_words or
    n_removed are replaced.

    A null or blank text has no words and becomes an empty text. Texts shorter than the window lose nothing.
    Rows with a null id count as one document before all others. Rows that repeat an id are one document:
    an equal window at the same start of both is not earlier in either. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets, shares = max(least, -(-size // BUCKET)), max(least, -(-size // SHARE))
    rest = [c for c in docs.columns if c not in (id_col, text_col, "n_words", "n_removed")]
    held = {f"__c{i}": c for i, c in enumerate(rest)}
    base = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("__id"), F.xxhash64(text_col).alias("__tag"),
        F.col(text_col).alias("__text"), *[F.col(f"`{c}`").alias(h) for h, c in held.items()],
    )
    slim = base.select("__id", "__tag", "__text")
    first = _gathered(slim.mapInArrow(anchors(window, buckets), PACKED), buckets).applyInArrow(repeated_anchors(buckets), PACKED)
    spread = base.repartition(shares, "__id", "__tag")  # one shuffle of the texts serves both joins
    found = _gathered(first, -(-buckets // 4)).applyInArrow(by_document, FLAGS)
    second = spread.join(found.repartition(shares, "__id", "__tag"), ["__id", "__tag"]).select("__id", "__tag", "__text", "found")
    second = _gathered(second.mapInArrow(windows(window, buckets), PACKED), buckets).applyInArrow(later_windows(buckets), PACKED)
    out = _gathered(second, -(-buckets // 4)).applyInArrow(by_document, FLAGS).repartition(shares, "__id", "__tag")
    ready = spread.join(out, ["__id", "__tag"], "left")
    names = ["__id", "__kept", *held, "n_words", "n_removed"]
    kinds = dict(base.dtypes) | {"__kept": "string", "n_words": "long", "n_removed": "long"}
    done = ready.mapInArrow(removed(window, names, tidy), ", ".join(f"`{n}` {kinds[n]}" for n in names))
    kind = dict(docs.dtypes)[id_col]
    made = {
        id_col: F.when(F.col("__id") != NULL_ID, F.col("__id")).cast(kind).alias(id_col), text_col: F.col("__kept").alias(text_col),
        **{c: F.col(h).alias(c) for h, c in held.items()},
    }
    return done.select(*[made[c] for c in docs.columns if c in made], "n_words", "n_removed")

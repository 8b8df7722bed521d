"""Importance resampling towards a target distribution, on hashed word runs with a head-tail vocabulary.

Features are the runs of one to three consecutive words; a feature's bucket is its CRC-32 modulo the number of buckets.
Few words and pairs make up most of a corpus. The head, words and pairs that are one HEAD-th of all words or more in what
the tasks count, cannot have more than HEAD of either, so both are safe to broadcast: each word with the CRC state after it,
each pair with that of both. Features of the tail, which nobody has seen before, take their CRC directly. A CRC goes on
from a state, so a run of words costs one step from the state of the run before. Head and tail meet in exact totals per
bucket, of the corpus and of the target; a bucket's gain is the log of their ratio. What is in the head decides how fast a
feature's bucket is found, never which it is.

A task reads texts in blocks of many short ones or part of a long one, so a long one costs no more memory. Counts are summed within tasks
before they are shuffled; bucket totals have a fixed number of rows. The draw is a global order over small rows, by sampled
ranges, without a task that sees all of them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kadenz.llm.staging import stage
from kadenz.operators.ordering import numbered

#: The head has words and pairs that are at least one HEAD-th of all words; so many there can be at most.
HEAD = 65_536
#: Bytes of a word of the head at most; longer words and steps over longer words take the plain CRC.
LONG = 64
#: Bytes of a slice of text; words and distinct words that a task counts together.
SLICE, CHUNK, HELD = 1 << 20, 4_000_000, 500_000
#: Words whose features are worked out together.
WORDS = 200_000
BUCKETS = 10_000
LEAST_WORDS = 20
#: Bytes 0-9, a-z and those of other alphabets stand for themselves, A-Z are lowered, all others part words.
SPLIT = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Columns of a score, after those of the input.
SCORED = ["n_words", "n_features", "weight", "score"]


def slices(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in slices of about SLICE bytes, which end between words."""
    raw = (text or "").encode().translate(SPLIT)
    at = 0
    while at < len(raw):
        end = len(raw) if len(raw) - at <= SLICE else raw.find(b" ", at + SLICE)
        end = len(raw) if end < 0 else end
        if found := raw[at:end].split():
            yield found
        at = end


@lru_cache(maxsize=256)
def _step(length: int) -> np.ndarray:
    """What `length` more bytes make of each byte of a CRC, as four tables."""
    zeros = bytes(length)
    start = zlib.crc32(zeros)
    return np.array([[zlib.crc32(zeros, b << 8 * k) ^ start for b in range(256)] for k in range(4)], np.uint32)


def after(states: np.ndarray, tails: np.ndarray, lengths: np.ndarray, word) -> np.ndarray:
    """CRC-32 of texts whose first part has the given CRC and whose rest is a blank and a word, of CRC `tails` and so many bytes."""
    out = np.empty(len(states), np.uint32)
    order = np.argsort(lengths, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        n = int(lengths[at[0]]) if len(at) else 0
        if n > LONG:
            out[at] = [zlib.crc32(b" " + word(i), s) for i, s in zip(at.tolist(), states[at].tolist(), strict=True)]
        elif len(at):
            s, step = states[at], _step(n)
            out[at] = step[0][s & 255] ^ step[1][s >> 8 & 255] ^ step[2][s >> 16 & 255] ^ step[3][s >> 24] ^ tails[at]
    return out


class Head:
    """Frequent words with the CRC states that a run of words begins or goes on with, and frequent pairs with their buckets."""

    def __init__(self, words: list[bytes], pairs: list[tuple[bytes, bytes]], buckets: int = BUCKETS):
        self.buckets = buckets
        self.number = {w: i for i, w in enumerate(words)}
        self.states = np.array([zlib.crc32(w) for w in words], np.uint32)
        self.tails = np.array([zlib.crc32(b" " + w) for w in words], np.uint32)
        self.lengths = np.array([len(w) + 1 for w in words], np.int64)
        keys = np.array([self.number[a] << 32 | self.number[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.pairs = np.array([zlib.crc32(a + b" " + b) for a, b in pairs], np.uint32)[order]

    def words(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number (-1 for words of the tail), state, state as a tail and length with the blank, of each word."""
        number = np.fromiter((self.number.get(w, -1) for w in found), np.int64, len(found))
        tail = np.flatnonzero(number < 0)
        code = {}
        new = np.fromiter((code.setdefault(found[i], len(code)) for i in tail.tolist()), np.int64, len(tail))
        out = []
        for head, of in ((self.states, zlib.crc32), (self.tails, lambda w: zlib.crc32(b" " + w)), (self.lengths, lambda w: len(w) + 1)):
            values = np.zeros(len(found), head.dtype)
            if len(head):
                values = head[number]  # the tail's are put in next
            values[tail] = np.fromiter(map(of, code), head.dtype, len(code))[new]
            out.append(values)
        return number, *out

    def features(self, found: list[bytes]) -> list[np.ndarray]:
        """Buckets of all single words, pairs and triples, each in the order of their last word."""
        number, states, tails, lengths = self.words(found)
        pair = np.empty(max(0, len(found) - 1), np.uint32)
        known = np.zeros(len(pair), bool)
        if len(self.keys) and len(pair):
            key = np.where((number[:-1] >= 0) & (number[1:] >= 0), number[:-1] << 32 | number[1:], -1)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[at] == key
            pair[known] = self.pairs[at[known]]
        new = np.flatnonzero(~known)
        pair[new] = after(states[new], tails[new + 1], lengths[new + 1], lambda i: found[new[i] + 1])
        triple = after(pair[:-1], tails[2:], lengths[2:], lambda i: found[i + 2])
        return [x.astype(np.int64) % self.buckets for x in (states, pair, triple)]

    def blocks(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Consecutive texts in blocks of about WORDS words: the text's number of each word, and of each feature, and its bucket.

        A block may hold many texts or part of one; runs over the border of two blocks are in the second, and runs over the
        border of two texts are none.
        """
        words: list[bytes] = []
        numbers, sizes, held, carried = [], [], 0, 0

        def block() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            of = np.repeat(numbers, sizes)
            one, two, three = self.features(words)
            pairs, triples = of[1:] == of[:-1], of[2:] == of[:-2]
            pairs[: max(0, carried - 1)] = False  # both words came along
            return of[carried:], np.concatenate([of[carried:], of[1:][pairs], of[2:][triples]]), np.concatenate([one[carried:], two[pairs], three[triples]])

        for number, text in enumerate(texts):
            for found in slices(text):
                words += found
                numbers.append(number)
                sizes.append(len(found))
                held += len(found)
                if held >= WORDS:
                    yield block()
                    last = np.repeat(numbers, sizes)[-2:].tolist()
                    words, numbers, sizes, carried = words[-2:], last, [1] * len(last), len(last)
                    held = carried
        if held > carried:
            yield block()


def _texts(batches: Iterator[pa.RecordBatch], name: str = "__text") -> Iterator[str | None]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            yield from batch.column(name).slice(at, 64).to_pylist()


def _frequent(keys: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    found, n = np.unique(keys, return_counts=True)
    return found[n >= least], n[n >= least]


def head(docs: DataFrame, text_col: str = "text", size: int = HEAD, buckets: int = BUCKETS) -> Head:
    """Frequent words and pairs of a corpus.

    A task counts some million words together and hands on those of which one in `size` is the same; what is one in
    `size` of all words is so in some part at least. Sums of these counts are no more than the true ones, so at most
    `size` words and pairs reach one in `size` of all, and only these come to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code: dict[bytes, int] = {}
        runs: list[np.ndarray] = []

        def handed_on() -> pa.RecordBatch:
            nonlocal code, runs
            n, words = sum(map(len, runs)), list(code)
            least = max(1, -(-n // size))
            one, c1 = _frequent(np.concatenate(runs), least)
            two, c2 = _frequent(np.concatenate([r[:-1] << 32 | r[1:] for r in runs]), least)
            short = lambda *cs: all(len(words[c]) <= LONG for c in cs)
            rows = [(words[c], None, k) for c, k in zip(one.tolist(), c1.tolist(), strict=True) if short(c)]
            rows += [(words[c >> 32], words[c & 0xFFFFFFFF], k) for c, k in zip(two.tolist(), c2.tolist(), strict=True) if short(c >> 32, c & 0xFFFFFFFF)]
            rows.append((None, None, n))
            code, runs = {}, []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["a", "b", "n"])

        held = 0
        for text in _texts(batches):
            for found in slices(text):
                runs.append(np.fromiter((code.setdefault(w, len(code)) for w in found), np.int64, len(found)))
                held += len(found)
                if held >= CHUNK or len(code) >= HELD:
                    yield handed_on()
                    held = 0
        if runs:
            yield handed_on()

    counted = docs.select(F.col(f"`{text_col}`").alias("__text")).mapInArrow(count, "a binary, b binary, n long")
    counted = stage(counted.groupBy("a", "b").agg(F.sum("n").alias("n")), "importance-head")
    total = counted.where("a IS NULL").agg(F.sum("n")).first()[0] or 0
    rows = counted.where((F.col("n") * size >= total) & F.col("a").isNotNull()).orderBy("a", "b").collect()
    words = [bytes(r.a) for r in rows if r.b is None]
    there = set(words)
    pairs = [(bytes(r.a), bytes(r.b)) for r in rows if r.b is not None]
    return Head(words, [(a, b) for a, b in pairs if a in there and b in there], buckets)


def totals(docs: DataFrame, known: Head, text_col: str = "text") -> np.ndarray:
    """How many features of all texts fall in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(known.buckets, np.int64)
        for _, _, bucket in known.blocks(_texts(batches)):
            sums += np.bincount(bucket, minlength=known.buckets)
        there = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(sums[there])], names=["bucket", "n"])

    rows = docs.select(F.col(f"`{text_col}`").alias("__text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(known.buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of how much likelier each bucket is in the target than in the corpus; every bucket counts once more."""
    size, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    ratio = [(t + 1.0) * (s_all + size) / ((s + 1.0) * (t_all + size)) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weigh(docs: DataFrame, known: Head, gain: np.ndarray, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """Adds n_words, n_features and weight, the sum of the gains of a text's features."""
    new = SCORED[:3]
    kept = [c for c in columns or docs.columns if c not in new]
    inner = [f"__k{i}" for i in range(len(kept))]
    kinds = dict(docs.dtypes)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, rows = np.zeros((3, batch.num_rows), np.int64), batch.num_rows
            for word, feature, bucket in known.blocks(_texts(iter([batch]))):
                made[0] += np.bincount(word, minlength=rows)
                made[1] += np.bincount(feature, minlength=rows)
                made[2] += np.bincount(feature, gain[bucket], minlength=rows).astype(np.int64)  # whole numbers below 2^53
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in inner], *map(pa.array, made)], names=[*inner, *[f"__m{i}" for i in range(3)]])

    wide = docs.select(*[docs[f"`{c}`"].alias(i) for c, i in zip(kept, inner, strict=True)], docs[f"`{text_col}`"].alias("__text"))
    schema = [*[f"{i} {kinds[c]}" for c, i in zip(kept, inner, strict=True)], *[f"__m{i} long" for i in range(3)]]
    return wide.mapInArrow(add, ", ".join(schema)).toDF(*kept, *new)


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, size: int = HEAD) -> DataFrame:
    """Adds n_words, n_features, weight, score and rank to documents; the drawn ones, `percent` of those with least_words
    words or more, have ranks 1, 2, 3, ... and the others null.

    The score is the weight plus Gumbel noise from the seed and the id, so the highest scores are a draw without
    replacement in proportion to the weights. Ties go to the smaller id (null last), repeated ids to fewer features; rows
    alike in all of these may share their ranks in any order. Null and empty texts have no features and a weight of
    0; an empty target or corpus counts as one of every bucket. columns: input columns to return (all, if not given),
    the id among them; columns called like a result are replaced. A null id counts as an empty text in the noise. An
    empty table gives an empty result.
    """
    known = head(docs, text_col, size, buckets)
    gain = gains(totals(docs, known, text_col), totals(target, known, text_col))
    columns = [c for c in columns or docs.columns if c not in (*SCORED, "rank")]
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = weigh(docs, known, gain, text_col, columns).withColumn("score", F.col("weight") + noise)
    scored = stage(scored, "importance-scores")
    # the input's columns travel as one, so that they may have any names
    kept = [c for c in scored.columns if c not in SCORED]
    place = {"__down": -F.col("score"), "__null": F.col(f"`{id_col}`").isNull(), "__id": F.col(f"`{id_col}`")}
    small = scored.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row"), *SCORED, *[c.alias(n) for n, c in place.items()])
    enough = small.where(F.col("n_words") >= least_words)
    drawn = percent * enough.count() // 100
    ranked = numbered(enough, [*place, "n_features", "weight"], "rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    both = ranked.unionByName(small.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
    return both.select(*[F.col("__row")[c].alias(c) for c in kept], *SCORED, "rank")

"""Near-duplicate detection with bottom-k sketches of one hash function.

A document's sketch is the k smallest hashes of its word shingles. Documents with equal shingle sets form a
class, and one of each class goes on. Inverted lists of the retained values give the overlaps: a value that
one class alone retains is dropped, and each class enters the lists of its rarest values only, as many as are
needed so that two classes with enough common values meet in a list (prefix filter).

Lists are joined in two steps, so that a group of n near copies does not give n * n pairs. First every member
of a list is paired with the list's most central member. Candidates that the estimate from the union's sketch
lets through are verified on the full shingle sets, and the links give components. Second, members of a list
that are still in different components are paired with each other: short lists by a join, long ones in
blocks of bounded size, where the estimate is taken before a pair leaves the task. Of a long list the members of its
largest component meet those outside it only, so a list that is nearly one component costs little more than its rows.

The sketches are a statistical filter. `exact` takes whole sets in their place: then the prefix that two sets at the
threshold must share follows from their sizes alone, the estimate is the similarity itself, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kadenz.llm import words as W
from kadenz.llm.components import components
from kadenz.llm.staging import stage

#: Hashes of a sketch, and the share of them that two documents at the threshold have in common at least: with
#: k = 48 and a similarity of 0.8 fewer than 0.45 * k common ones have a chance below 1e-7.
K, SHARE = 48, 0.45
#: Standard deviations that an estimate may lie below the threshold: at 0.8 a pair needs 22 of the union's 48 values,
#: and one at the threshold has fewer with a chance of 3.4e-8. With SHARE's a link is lost with less than 1.4e-7.
SLACK = 6.0
#: Members up to which a list is paired by a join; of a longer list's blocks, members and shingles at most on average.
SHORT, BLOCK, SHINGLES = 32, 4096, 2_000_000
#: Ids that may be broadcast, once they are counted.
BROADCAST = 20_000
#: A sketch of this size is the whole set.
WHOLE = 2**31 - 1
#: Fills short sketches; no value reaches it but by a chance of one in 2^64.
PAD = np.iinfo(np.int64).max
SKETCH = "__id long, tag long, n long, s1 long, s2 long, sketch array<long>"


def shingles(text: str | None, size: int, cache: W.WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words; a shorter text is one run; no words, none."""
    w = W.hashes(W.split(text, lower=True), cache)
    if not len(w):
        return np.empty(0, np.int64)
    got = W.runs(w, size) if len(w) >= size else W.mix(W.runs(w, len(w)) + np.uint64(len(w)))
    return np.unique(got.view(np.int64))


def _sketches(size: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = W.WordHashes()
        for batch in batches:
            sets = [shingles(t, size, cache) for t in W.column(batch, "__text")]
            heads = [s[:k] for s in sets]
            offsets = np.concatenate([[0], np.cumsum([len(h) for h in heads])]).astype(np.int32)
            s1 = [int(W.mix(s.view(np.uint64)).sum().view(np.int64)) for s in sets]
            s2 = [int(W.mix(s.view(np.uint64) ^ np.uint64(W.BASES[0])).sum().view(np.int64)) for s in sets]
            values = np.concatenate(heads) if heads else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), batch.column("tag"), pa.array([len(s) for s in sets], pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))],
                names=["__id", "tag", "n", "s1", "s2", "sketch"],
            )

    return run


def _exact(size: int, percent: int):
    """Pairs of texts whose sets meet the threshold exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, last, kept = W.WordHashes(), None, None
        for batch in batches:
            out = []
            for a, b, ta, tb in zip(*(W.column(batch, c) for c in ("a", "b", "ta", "tb")), strict=True):
                if last != tb:  # rows come sorted by b
                    last, kept = tb, shingles(tb, size, cache)
                sa = shingles(ta, size, cache)
                common = len(np.intersect1d(sa, kept, assume_unique=True))
                if 100 * common >= percent * (len(sa) + len(kept) - common) and common:
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def _estimates(a: np.ndarray, others: np.ndarray, k: int, complete: np.ndarray) -> np.ndarray:
    """Similarity of sketch a to each row of others, by the k smallest values of the union; rows are padded with PAD.

    complete: where neither sketch leaves values out, the whole union counts."""
    both = np.sort(np.concatenate([np.broadcast_to(a, (len(others), len(a))), others], axis=1), axis=1)
    twice = np.zeros(both.shape, bool)
    twice[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != PAD)
    rank = np.cumsum(~twice & (both != PAD), axis=1)
    part = np.where(complete, rank[:, -1], np.minimum(rank[:, -1], k))
    return (twice & (rank <= part[:, None])).sum(1) / np.maximum(part, 1)


def _hits(flat: np.ndarray, owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """How many of the values each owner has; flat is sorted."""
    lo, hi = np.searchsorted(flat, values), np.searchsorted(flat, values, side="right")
    size = hi - lo
    at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return np.bincount(owner[at], minlength=n)


def _flat(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    values, owner = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    order = np.argsort(values, kind="stable")
    return values[order], owner[order]


def _blocks(size: int, k: int, percent: int, least: float):
    """Links between members of two blocks of a list that are in different components, one for each member and component.

    A pair is looked at only in the list of its first common value, from rare to frequent. The estimate from the
    union's sketch filters, and the full sets verify, both for a member against its whole block at once.
    """

    def run(table: pa.Table) -> pa.Table:
        v = table.column("v")[0].as_py()
        same = table.column("bi")[0].as_py() == table.column("bj")[0].as_py()
        side = np.array(table.column("side").to_pylist())
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (0 if same else 1))
        out: list[tuple[int, int]] = []
        if len(left) and len(right):
            ids, n, comp = (np.array(table.column(c).to_pylist(), np.int64) for c in ("cid", "n", "comp"))
            cache = W.WordHashes()
            sets = [shingles(t, size, cache) for t in table.column("__text").to_pylist()]
            entries = [np.array(x, np.int64) for x in table.column("entries").to_pylist()]
            sketch = np.full((len(sets), min(k, int(n.max()))), PAD)
            for i, s in enumerate(sets):
                sketch[i, : min(k, len(s))] = s[:k]
            flat, owner = _flat([sets[r] for r in right])
            where = [np.flatnonzero(np.isin(e, v))[0] for e in entries]
            listed, lister = _flat([entries[r] for r in right])
            for x in left:
                # rarer values of x's entries that y has as well mean that another list sees the pair
                before = _hits(listed, lister, entries[x][: where[x]], len(right))
                fit = (before == 0) & (comp[right] != comp[x]) & (100 * np.minimum(n[right], n[x]) >= percent * np.maximum(n[right], n[x]))
                y = np.flatnonzero(fit & (ids[right] > ids[x])) if same else np.flatnonzero(fit)
                if len(y):
                    y = y[_estimates(sketch[x], sketch[right[y]], k, np.maximum(n[right[y]], n[x]) < k) >= least]
                if len(y):
                    common = _hits(flat, owner, sets[x], len(right))[y]
                    y = right[y[100 * common >= percent * (n[x] + n[right[y]] - common)]]
                    y = y[np.unique(comp[y], return_index=True)[1]]
                    out += [(int(ids[x]), int(ids[z])) for z in y]
        return pa.table({"a": pa.array([max(o) for o in out], pa.int64()), "b": pa.array([min(o) for o in out], pa.int64())})

    return run


class NearDuplicates:
    """The job's written tables and steps; near_duplicates() runs them. A class has a number, cid, that its table fixes."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, k: int = K, exact: bool = False):
        k = WHOLE if exact else k
        self.size, self.percent, self.k, self.exact = size, percent, k, exact
        # whole sets have no error but that of the division
        self.least = percent / 100 - (1e-9 if exact else SLACK * ((percent / 100) * (1 - percent / 100) / k) ** 0.5)
        # the tag tells the texts of a repeated id apart
        self.texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).alias("__text"))
        self.all = stage(self.texts.mapInArrow(_sketches(size, k), SKETCH), "sketches")
        self.known = self.all.where("n > 0 AND __id IS NOT NULL")
        # equal sets have equal sketches, so any will do
        of = self.known.groupBy("s1", "s2", "n").agg(F.min(F.struct("__id", "tag")).alias("of"), F.first("sketch").alias("sketch"))
        self.classes = stage(of.select("s1", "s2", "n", F.col("of.__id").alias("rep"), "of.tag", "sketch").withColumn("cid", F.monotonically_increasing_id()), "classes")

    def lists(self) -> DataFrame:
        """(v, cid, n, m, f): entries of the inverted lists; m: retained values that others retain too, f: how many retain v."""
        k = F.least(F.col("n"), F.lit(self.k))
        each = self.classes.select("cid", "n", F.explode("sketch").alias("v"))
        often = each.groupBy("v").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
        shared = each.join(often, "v").groupBy("cid", "n").agg(F.sort_array(F.collect_list(F.struct("f", "v"))).alias("l"))
        # the values no one else has come first in the order from rare to frequent
        common = F.floor((k * self.percent + 99) / 100) if self.exact else F.ceil(k * SHARE)
        take = k - common + 1 - (k - F.size("l"))
        entries = shared.where(take > 0).select("cid", "n", F.size("l").alias("m"), F.explode(F.slice("l", F.lit(1), take.cast("int"))).alias("e"))
        return stage(entries.select(F.col("e.v").alias("v"), "cid", "n", "m", F.col("e.f").alias("f")), "lists")

    def similar_sizes(self, a: str, b: str):
        return 100 * F.least(a, b) >= self.percent * F.greatest(a, b)

    def pairs_with_centres(self, lists: DataFrame) -> DataFrame:
        centre = F.max(F.struct("m", F.negate("cid").alias("i"), F.col("n").alias("cn"))).alias("c")
        centres = lists.groupBy("v").agg(centre, F.count(F.lit(1)).alias("g")).where("g > 1").select("v", F.negate("c.i").alias("centre"), "c.cn")
        met = lists.join(centres, "v").where((F.col("cid") != F.col("centre")) & self.similar_sizes("n", "cn"))
        self.tested = stage(met.select(F.greatest("cid", "centre").alias("a"), F.least("cid", "centre").alias("b")).distinct(), "pairs-with-centres")
        return self.tested

    def passing(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose estimate from the union's sketch is near the threshold or above."""
        a = self.classes.select(F.col("cid").alias("a"), F.col("sketch").alias("sa"))
        b = self.classes.select(F.col("cid").alias("b"), F.col("sketch").alias("sb"))
        both = pairs.join(a, "a").join(b, "b")
        longest = F.greatest(F.size("sa"), F.size("sb"))
        union = F.array_sort(F.array_union("sa", "sb"))
        part = F.when(longest == self.k, F.slice(union, 1, self.k)).otherwise(union)
        common = F.size(F.array_intersect(part, F.array_intersect("sa", "sb")))
        return both.where(common >= self.least * F.size(part)).select("a", "b")

    def texts_of(self, members: DataFrame, few: bool = False) -> DataFrame:
        """(cid, __text): the text of each class in members (cid)."""
        named = self.classes.join(members, "cid", "left_semi").select("cid", F.col("rep").alias("__id"), "tag")
        return self.texts.join(F.broadcast(named) if few else named, ["__id", "tag"]).dropDuplicates(["cid"]).select("cid", "__text")

    def links(self, pairs: DataFrame) -> DataFrame:
        """Of distinct candidate pairs, those that hold on the full sets."""
        found = stage(pairs, "candidates")
        members = stage(found.select(F.col("a").alias("cid")).unionByName(found.select(F.col("b").alias("cid"))).distinct(), "candidate-classes")
        # written, so that both joins read plain tables and the pairs of a hot document can be split over tasks
        texts = stage(self.texts_of(members), "candidate-texts")
        a = texts.select(F.col("cid").alias("a"), F.col("__text").alias("ta"))
        b = texts.select(F.col("cid").alias("b"), F.col("__text").alias("tb"))
        both = found.join(a, "a").join(b, "b").select("a", "b", "ta", "tb")
        return stage(both.mapInArrow(_exact(self.size, self.percent), "a long, b long"), "links")

    def links_across(self, lists: DataFrame, comps: DataFrame) -> DataFrame:
        """Links between members of a list that are in different components."""
        named = lists.join(comps.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("component", "cid")).select("v", "cid", "n", "f", "comp")
        named = stage(named, "named-lists")
        parts = named.groupBy("v", "comp").agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("shingles"))
        lists = parts.groupBy("v").agg(F.count(F.lit(1)).alias("comps"), F.sum("g").alias("g"), F.sum("shingles").alias("shingles"), F.max(F.struct("g", "comp", "shingles")).alias("most"))
        mixed = stage(lists.where("comps > 1 AND g > 2").select("v", "g", "shingles", "most"), "mixed-lists")  # a list of two is its centre's pair
        open_ = named.join(mixed, "v")
        short = open_.where(F.col("g") <= SHORT).select("v", "cid", "n", "comp")
        other = short.select("v", F.col("cid").alias("oid"), F.col("n").alias("on"), F.col("comp").alias("ocomp"))
        met = short.join(other, "v").where((F.col("cid") > F.col("oid")) & (F.col("comp") != F.col("ocomp")) & self.similar_sizes("n", "on"))
        near = self.passing(met.select(F.col("cid").alias("a"), F.col("oid").alias("b")).distinct().join(self.tested, ["a", "b"], "left_anti"))
        blocks = lambda g, shingles: F.greatest(F.lit(1), F.ceil(g / BLOCK), F.ceil(shingles / SHINGLES))
        inside = blocks(F.col("most.g"), F.col("most.shingles"))
        outside = blocks(F.col("g") - F.col("most.g"), F.col("shingles") - F.col("most.shingles"))
        long = stage(open_.where(F.col("g") > SHORT), "long-lists").withColumns({"in": inside, "out": outside, "own": F.col("comp") == F.col("most.comp")})
        # blocks from 0 on hold what is outside the largest component, those behind them its members
        long = long.withColumn("blk", F.when(F.col("own"), F.col("out") + F.pmod(F.xxhash64("cid"), "in")).otherwise(F.pmod(F.xxhash64("cid"), "out")))
        # a block outside meets every block of its list once, as the left or the right side; one inside meets those outside
        long = long.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("own"), F.col("out")).otherwise(F.col("out") + F.col("in")) - 1)))
        long = long.select("v", "cid", "n", "comp", F.least("blk", "o").alias("bi"), F.greatest("blk", "o").alias("bj"), (F.col("blk") > F.col("o")).cast("int").alias("side"))
        members = stage(long.select("cid").distinct(), "long-members")
        entries = named.join(members, "cid", "left_semi").groupBy("cid").agg(F.transform(F.sort_array(F.collect_list(F.struct("f", "v"))), lambda e: e.v).alias("entries"))
        texts = self.texts_of(members, few=members.count() <= BROADCAST)
        long = long.join(stage(entries.join(texts, "cid"), "long-texts"), "cid")
        far = long.groupBy("v", "bi", "bj").applyInArrow(_blocks(self.size, self.k, self.percent, self.least), "a long, b long")
        return self.links(near).unionByName(far)

    def ties(self) -> DataFrame:
        """Links between the classes of an id that has several."""
        several = self.known.groupBy("__id").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi")).where("lo < hi").select("__id")
        each = stage(self.known.join(several, "__id").join(self.classes.select("s1", "s2", "n", "cid"), ["s1", "s2", "n"]).select("__id", "cid").distinct(), "classes-of-ids")
        return each.join(each.groupBy("__id").agg(F.min("cid").alias("b")), "__id").select(F.col("cid").alias("a"), "b")

    def named_classes(self, comps: DataFrame) -> DataFrame:
        """(s1, s2, n, component): the smallest id of all classes that hang together."""
        own = self.classes.select("s1", "s2", "n", "cid", "rep").join(comps.withColumnRenamed("node", "cid"), "cid", "left")
        own = stage(own.select("s1", "s2", "n", "rep", F.coalesce("component", "cid").alias("group")), "class-groups")
        least = own.groupBy("group").agg(F.min("rep").alias("component"))
        return stage(own.join(least, "group").select("s1", "s2", "n", "component"), "class-components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, k: int = K, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row: documents linked by similar shingle sets.

    Words are lowered in A-Z only. A link needs 100 * common shingles >= percent * shingles of either, on the
    full sets (64-bit hashes of shingles); a pair at 80 percent is missed by its sketches with a chance below
    1.4e-7, one above it with less. component_id is the smallest id reachable over links, and the row
    with that id is kept.

    Null, empty and blank texts have no shingles, are linked with nothing and are kept. A null id takes no
    part: component_id is null and the row is kept. Rows that repeat an id are one document, which has the
    links of all its texts. An empty table gives an empty result.
    """
    job = NearDuplicates(docs, id_col, text_col, size, percent, k, exact)
    lists = job.lists()
    first = job.links(job.passing(job.pairs_with_centres(lists)))
    second = job.links_across(lists, components(first))
    comps = components(first.unionByName(second).unionByName(job.ties()))
    named = job.all.join(job.named_classes(comps), ["s1", "s2", "n"], "left")
    component = F.when(F.col("__id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "__id"))
    out = named.select(F.col("__id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

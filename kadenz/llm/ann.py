"""Approximate nearest neighbours over learned partitions.

A bounded sample gets its exact neighbour graph, the graph is cut into balanced partitions with few edges across,
and a small network learns from a vector which partitions its neighbours are in. The network puts every row
into its most probable partition and sends each query to as many as hold most of the probability of its neighbours,
where exact distances rank the rows. There are about as many partitions as rows in one, so both grow with the root
of the table; where one network can't tell that many apart, its partitions are cut again by networks of their own.
Rows and queries of a partition meet in blocks of bounded size, so no partition has to fit into a task.
"""

from __future__ import annotations

import io
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kadenz.llm.staging import stage

#: Rows that one network is fitted on, on average at most, partitions that it tells apart, and levels of networks.
SAMPLE, WIDEST, LEVELS = 16_384, 256, 4
#: Rows of a partition at least, on average. A partition is cut if it has more than twice its share.
SMALLEST = 256
#: Share of a query's neighbours that the partitions it visits should hold, and of the sample that measures it.
MASS, MEASURED = 0.93, 0.125
#: Neighbours in the graph, hidden units, passes over the sample, and how far a partition may exceed its share.
NEIGHBOURS, HIDDEN, EPOCHS, BALANCE = 10, 128, 5, 1.05
#: Rows and queries of a block, rows that are placed at once. Rows that a query meets at least, unless there are fewer.
ROWS, QUERIES, PLACED, LEAST = 4096, 512, 16_384, 500


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T


def graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row."""
    out = []
    for i in range(0, len(x), 128):
        d = squared(x[i : i + 128], x)
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        out.append(np.argpartition(d, min(k, len(x) - 1) - 1, axis=1)[:, :k])
    return np.concatenate(out)


def balanced(x: np.ndarray, near: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Partition of each row: seeded by balanced means, then rows move to where most of their neighbours are, while there is room."""
    n = len(x)
    room = int(np.ceil(BALANCE * n / parts))
    means = x[rng.permutation(n)[:parts]]
    part = np.zeros(n, np.int64)
    for _ in range(8):
        d = squared(x, means)
        best = np.sort(d, axis=1)
        count = np.zeros(parts, np.int64)
        for i in np.argsort(best[:, 0] - best[:, min(1, parts - 1)]):
            part[i] = next(p for p in np.argsort(d[i]) if count[p] < room)
            count[part[i]] += 1
        means = np.array([x[part == p].mean(0) if count[p] else means[p] for p in range(parts)])
    a, b = np.repeat(np.arange(n), near.shape[1]), near.ravel()
    source, target = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.argsort(source, kind="stable")
    links = np.split(target[order], np.cumsum(np.bincount(source, minlength=n))[:-1])
    for _ in range(8):
        moved = 0
        for i in rng.permutation(n):
            votes = np.bincount(part[links[i]], minlength=parts)
            p = int(votes.argmax())
            if votes[p] > votes[part[i]] and count[p] < room:
                count[part[i]] -= 1
                count[p] += 1
                part[i] = p
                moved += 1
        if moved < n / 500:
            break
    return part


def reach(w: list[np.ndarray], x: np.ndarray, held: np.ndarray, near: np.ndarray, mass: float) -> float:
    """Probability up to which a query visits partitions, so that rows not trained on find this share of their neighbours."""
    if mass >= 1:
        return np.inf
    place = logits(w, x).argmax(1)
    p = softmax(logits(w, x[held]))
    order = np.argsort(-p, axis=1, kind="stable")
    ranked = np.take_along_axis(p, order, 1)
    ahead = np.empty_like(p)
    np.put_along_axis(ahead, order, np.cumsum(ranked, 1) - ranked, 1)
    return float(np.nextafter(np.quantile(np.take_along_axis(ahead, place[near[held]], 1), mass, method="higher"), np.inf))


def fit(x: np.ndarray, parts: int, mass: float = MASS, seed: int = 7) -> list[np.ndarray]:
    """Weights of a network with one hidden layer and a direct one, trained on where the rows' neighbours are, and its reach.

    The direct layer starts from the partitions' means. Training is by Adam on cross entropy.
    """
    rng = np.random.default_rng(seed)
    dim = x.shape[1]
    parts = max(1, min(parts, len(x) // 8))
    scale = np.sqrt(np.maximum((x * x).sum(1).mean(), 1e-12) / dim)
    w = [rng.normal(0, dim**-0.5, (dim, HIDDEN)) / scale, np.zeros(HIDDEN), np.zeros((HIDDEN, parts)), np.zeros(parts), np.zeros((dim, parts))]
    if parts == 1:
        return [*w, np.array(np.inf)]
    near = graph(x, min(NEIGHBOURS, len(x) - 1))
    part = balanced(x, near, parts, rng)
    means = np.array([x[part == p].mean(0) if (part == p).any() else np.zeros(dim) for p in range(parts)])
    spread = max(((x - means[part]) ** 2).mean(), 1e-12)
    w[4], w[3] = means.T / spread, -(means**2).sum(1) / (2 * spread)
    labels = np.column_stack([part, part[near]])
    m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    rates = [2e-3 / scale, 2e-3, 2e-3, 2e-3, 2e-3 / scale]
    mixed = rng.permutation(len(x))
    held, used = mixed[: int(np.ceil(MEASURED * len(x)))], mixed[int(np.ceil(MEASURED * len(x))) :]
    for _ in range(EPOCHS):
        order = rng.permutation(used)
        for s in range(0, len(order), 128):
            at = order[s : s + 128]
            xs, ys = x[at], np.zeros((len(at), parts))
            np.add.at(ys, (np.arange(len(at))[:, None], labels[at]), 1 / labels.shape[1])
            h = np.maximum(0, xs @ w[0] + w[1])
            g = (softmax(h @ w[2] + w[3] + xs @ w[4]) - ys) / len(xs)
            gh = (g @ w[2].T) * (h > 0)
            step += 1
            for i, grad in enumerate((xs.T @ gh, gh.sum(0), h.T @ g, g.sum(0), xs.T @ g)):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad**2
                w[i] = w[i] - rates[i] * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-9)
    return [*w, np.array(reach(w, x, held, near, mass))]


def softmax(z: np.ndarray) -> np.ndarray:
    q = np.exp(z - z.max(1, keepdims=True))
    return q / q.sum(1, keepdims=True)


def logits(w: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    return np.maximum(0, x @ w[0] + w[1]) @ w[2] + w[3] + x @ w[4]


def matrix(table: pa.Table) -> np.ndarray:
    """The column v, whose vectors have one length within a partition."""
    flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.float64).reshape(table.num_rows, -1)


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): rows with an id and a finite vector that isn't zero."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False)))


def _fitted(mass: float):
    def run(table: pa.Table) -> pa.Table:
        """One network for a partition, from its sample."""
        order = np.argsort(table.column("vec_id").to_numpy(), kind="stable")  # the same for rows in any order
        out = io.BytesIO()
        np.savez(out, *fit(matrix(table)[order], table.column("k")[0].as_py(), mass))
        return pa.table({"part": table.column("part")[:1], "model": pa.array([out.getvalue()], pa.binary())})

    return run


def _network(models: pa.Table) -> list[np.ndarray]:
    held = np.load(io.BytesIO(models.column("model")[0].as_py()))
    return [held[k] for k in held.files]


def _within(table: pa.Table, part: str, child: np.ndarray) -> pa.Table:
    return table.append_column("part", pa.array([f"{part}/{c}" for c in child.tolist()], pa.string()))


def _placed(rows: pa.Table, models: pa.Table) -> pa.Table:
    """Each row in its most probable partition."""
    kept = rows.select(["vec_id", "v"])
    if not rows.num_rows:
        return _within(kept, "", np.empty(0, np.int64))
    return _within(kept, rows.column("part")[0].as_py(), logits(_network(models), matrix(rows)).argmax(1))


def _routed(queries: pa.Table, models: pa.Table) -> pa.Table:
    """Each query in its most probable partitions, up to the network's reach and the least number of rows."""
    kept = queries.select(["key", "v"])
    if not queries.num_rows:
        return _within(kept, "", np.empty(0, np.int64))
    w = _network(models)
    p = softmax(logits(w, matrix(queries)))
    rows = np.zeros(p.shape[1], np.int64)
    for child, n in models.column("held")[0].as_py():
        rows[int(child)] = n
    order = np.argsort(-p, axis=1, kind="stable")
    ranked = np.take_along_axis(p, order, 1)
    visit = ((np.cumsum(ranked, 1) - ranked < w[5]) | (np.cumsum(rows[order], 1) - rows[order] < LEAST)) & (rows[order] > 0)
    q, at = np.nonzero(visit)
    return _within(kept.take(pa.array(q)), queries.column("part")[0].as_py(), order[q, at])


def _nearest(k: int):
    def run(table: pa.Table) -> pa.Table:
        side = table.column("query").to_numpy()
        ids, v = table.column("id").to_numpy(), matrix(table)
        out: list[tuple[int, int, float]] = []
        if side.any() and not side.all():
            q, r, qi, ri = v[side], v[~side], ids[side], ids[~side]
            rough = squared(q, r)
            # rows that repeat an id count once, so that many more may be ahead
            last = min(k + len(ri) - len(np.unique(ri)), len(r)) - 1
            error = 1e-9 * ((q * q).sum(1) + (r * r).sum(1).max())
            bar = np.partition(rough, last, axis=1)[:, last]
            for i in range(len(q)):
                near = np.flatnonzero(rough[i] <= bar[i] + error[i])
                exact = np.sqrt(((r[near] - q[i]) ** 2).sum(1))
                best = np.lexsort((ri[near], exact))
                best = best[np.sort(np.unique(ri[near][best], return_index=True)[1])[:k]]
                out += [(int(qi[i]), int(ri[near[j]]), float(exact[j])) for j in best]
        return pa.table({"key": pa.array([o[0] for o in out], pa.int64()), "vec_id": pa.array([o[1] for o in out], pa.int64()), "score": pa.array([o[2] for o in out], pa.float64())})

    return run


class Search:
    """The job's written tables and steps; nearest() runs them. A partition's name has its vectors' length and its place on each level."""

    def __init__(self, found: DataFrame, k: int, every: int, sample: int, mass: float):
        self.k, self.sample, self.mass = k, sample, mass
        found = stage(found, "vectors")
        # of equal vectors only the first k + 1 can be among the k nearest, and one search serves all queries with that vector
        copy = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
        length = F.size("v").cast("string").alias("part")
        self.index = stage(found.withColumn("copy", copy).where(F.col("copy") <= k + 1).select("vec_id", "v", length), "index")
        asked = found.where(F.pmod("vec_id", F.lit(every)) == 0)
        searched = stage(asked.select("v").distinct().withColumn("key", F.monotonically_increasing_id()), "searched")
        self.asked = stage(asked.join(searched, "v").select(F.col("vec_id").alias("query_id"), "key"), "asked")
        self.queries = searched.select("key", "v", length)

    def partition(self) -> None:
        """Cuts partitions, level by level, until they have the size that the table asks for."""
        share = max(SMALLEST, isqrt(self.index.count()))
        levels = 1 if share < SMALLEST * WIDEST else 2
        for level in range(LEVELS):
            cut = self.index.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * share)
            cut = stage(cut.withColumn("k", F.least(F.lit(WIDEST), F.ceil(F.col("n") / share)).cast("int")), f"to-cut-{level}")
            if cut.isEmpty():
                break
            every = F.ceil(F.col("n") / self.sample)
            chosen = self.index.join(cut, "part").where(F.pmod(F.xxhash64("vec_id"), every) == 0).select("part", "vec_id", "v", "k")
            models = stage(chosen.groupBy("part").applyInArrow(_fitted(self.mass ** (1 / levels)), "part string, model binary"), f"models-{level}")
            was = self.index
            self.index = stage(self._through(was, "vec_id", models, cut, _placed, "vec_id long, v array<double>, part string"), f"index-{level}")
            parent = F.regexp_replace("part", "/[^/]*$", "")
            sizes = self.index.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("part").contains("/"))
            held = sizes.groupBy(parent.alias("part")).agg(F.collect_list(F.struct(F.regexp_extract("part", "[^/]*$", 0).cast("long"), "n")).alias("held"))
            known = models.join(held.select("part", F.transform("held", lambda h: F.array(h.col1, h.n)).alias("held")), "part")
            self.queries = stage(self._through(self.queries, "key", known, cut, _routed, "key long, v array<double>, part string"), f"routed-{level}")

    def _through(self, rows: DataFrame, id_col: str, models: DataFrame, cut: DataFrame, run, schema: str) -> DataFrame:
        """Rows of the partitions that are cut go through their network, in groups of bounded size; the others stay."""
        own, theirs = (cut.select("part", F.ceil(F.col("n") / PLACED).alias(c)) for c in ("groups", "copies"))
        named = rows.join(own, "part", "left")
        moving = named.where("groups IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64(id_col), "groups"))
        copies = models.join(theirs, "part").withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        moved = moving.groupBy("part", "salt").cogroup(copies.groupBy("part", "slot")).applyInArrow(run, schema)
        return moved.unionByName(named.where("groups IS NULL").select(*moved.columns))

    def found(self) -> DataFrame:
        """(query_id, vec_id, score): the nearest rows of the visited partitions, at least k of them if there are."""
        rows = self.index.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / ROWS).alias("rbs"))
        queries = self.queries.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("qbs"))
        blocks = stage(rows.join(queries, "part"), "blocks")
        all_of = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
        left = self.queries.join(blocks, "part").select(F.col("key").alias("id"), "v", "part", F.pmod(F.xxhash64("key"), "qbs").alias("qb"), all_of("rbs").alias("rb"), F.lit(True).alias("query"))
        right = self.index.join(blocks, "part").select(F.col("vec_id").alias("id"), "v", "part", F.pmod(F.xxhash64("vec_id"), "rbs").alias("rb"), all_of("qbs").alias("qb"), F.lit(False).alias("query"))
        met = left.unionByName(right).groupBy("part", "rb", "qb").applyInArrow(_nearest(self.k + 1), "key long, vec_id long, score double")
        best = first(met.groupBy("key", "vec_id").agg(F.min("score").alias("score")), "key", self.k + 1)
        return best.join(self.asked, "key").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))


def first(found: DataFrame, by: str, k: int) -> DataFrame:
    """The k nearest of each `by`, ties to the smaller id, with their rank."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(rows: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, mass: float = MASS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row whose id is divisible by `every`.

    Nearness is the Euclidean distance in double precision, ties go to the smaller id. Every usable row is
    indexed. mass: the share of its neighbours that a query's partitions should hold; 1 visits all of them.

    Rows with a null id, and vectors that are null, zero, or hold null or non-finite values take no part. Vectors of
    different lengths are never near each other. Rows that repeat an id count once, with the nearest of their
    vectors; a query's own id is no candidate. With fewer than k candidates all are returned; an empty table gives
    an empty result.
    """
    job = Search(usable(rows, id_col, vector_col).distinct(), k, every, sample, mass)
    job.partition()
    return first(job.found(), "query_id", k).select("query_id", "rank", "vec_id", "score")


def read_share(job: Search) -> float:
    """Share of the indexed rows that a query reads, on average."""
    sizes = job.index.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    read = job.queries.join(sizes, "part").agg(F.sum("n")).first()[0] or 0
    return read / max(1, job.queries.select("key").distinct().count() * job.index.count())


def recall(found: list[tuple[int, int]], want: dict[int, set[int]]) -> float:
    """Share of the true neighbours that were found."""
    hit = sum(v in want.get(q, ()) for q, v in found)
    return hit / max(1, sum(map(len, want.values())))

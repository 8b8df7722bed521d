"""Language-model scores by prediction by partial matching (PPM) over bytes.

Training documents give the counts of all byte runs of ORDER + 1, which hold the counts of every shorter context.
A symbol is coded in its longest context; where that context has not seen it, an escape is coded and the next
shorter context follows, without the symbols that the longer one has already ruled out. Each distinct symbol of
a context gives DISCOUNT of its count to the escape. Shorter contexts count a symbol once for each longer
context that it follows (update exclusion). Below order 0 stand all 256 bytes alike. The sum of a document's code
lengths, as log10 of its probability, is its score.

Nothing of the corpus is broadcast but the counts of orders 0 and 1, at most 2^16 numbers. Counts are dealt into cells
by a run's last three context bytes, which all contexts of order 3 and more have in common; the counts of order 2 go to
all cells of the two bytes. Distinct texts form batches; each batch asks every cell for its distinct runs and words,
packed and sorted, and gets the answers packed in the same order. Bytes outside the runs of a batch never travel.
There are as many cells and batches as the text's bytes ask for. A cell that much of the text falls into answers in
several tasks, each with a copy of the cell's counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kadenz.llm import words as W
from kadenz.llm.staging import stage

#: Context bytes. A document is its words with one space between and END behind; it starts after ORDER times END.
ORDER, END = 5, b"\n"
#: What an escape gets of the count of each symbol seen.
DISCOUNT = 0.3
#: Bytes of text of a batch, of a cell, and that are counted at once.
BATCH, CELL, SLICE = 4 << 20, 16 << 20, 4_000_000
#: Share of the cells that the most frequent pairs of context bytes are spread over, and how far a cell's share of the
#: text may exceed the mean before it answers in several tasks.
HOT, HEAVY = 0.04, 4
#: Remainder of crc32 that is held out from training.
HELD_OUT = 1
COUNTS = "cell int, words binary, wcounts binary, runs binary, rcounts binary"
ASKED = "cell int, slot int, batch long, words binary, runs binary"
ANSWERED = "batch long, cell int, counts binary, logs binary"


class Grid:
    """Cells of runs and words: `wide` groups of the last two context bytes, each in `deep` groups of the third."""

    def __init__(self, size: int, least: int):
        n = max(least, -(-size // CELL))
        self.deep = min(128, max(1, -(-int(n * HOT * 100) // 100)))
        self.wide = -(-n // self.deep)
        self.cells = self.wide * self.deep
        self.last_two = (W.mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(self.wide) * np.uint64(self.deep)).astype(np.int32)
        self.third = (W.mix(np.arange(1 << 8, dtype=np.uint64) + np.uint64(1 << 16)) % np.uint64(self.deep)).astype(np.int32)

    def of_runs(self, runs: np.ndarray) -> np.ndarray:
        cell = self.last_two[runs >> 8 & 0xFFFF] + self.third[runs >> 24 & 0xFF]
        return cell.astype(np.uint16) if self.cells < 1 << 16 else cell  # short numbers sort faster

    def of_word(self, word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(word) % self.cells


def symbols(text: str | None) -> tuple[list[bytes], bytes]:
    """Words, A-Z lowered, and the bytes to predict."""
    ws = W.split(text, lower=True)
    return ws, b" ".join(ws) + END


def runs_of(parts: list[bytes]) -> np.ndarray:
    """For every byte of the parts: it and its ORDER predecessors as one number, the byte lowest."""
    raw = np.frombuffer(b"".join(END * ORDER + p for p in parts), np.uint8).astype(np.int64)
    n = len(raw) - ORDER
    key = np.zeros(max(n, 0), np.int64)
    for k in range(ORDER + 1):
        key = key << 8 | raw[k : k + n]
    sizes = np.array([len(p) for p in parts], np.int64)
    starts = np.cumsum(sizes + ORDER) - sizes - ORDER
    return key[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([p[1] for p in parts]), minlength=len(keys)).astype(np.int64)


def _binary(arrays) -> pa.Array:
    return pa.array([W.planes(np.asarray(a, np.int64)) for a in arrays], pa.binary())


def _numbers(raw: bytes | None) -> np.ndarray:
    return W.from_planes(raw or b"", np.int64)


def _pack(cell: list[int], words: list[list[bytes]], wcounts: list, runs: list, rcounts: list) -> pa.RecordBatch:
    cols = [pa.array(cell, pa.int32()), pa.array([b"\n".join(w) for w in words], pa.binary()), *map(_binary, (wcounts, runs, rcounts))]
    return pa.RecordBatch.from_arrays(cols, names=["cell", "words", "wcounts", "runs", "rcounts"])


def _counted(grid: Grid):
    """Counts of the words and byte runs of each record batch, packed by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            found, part, size = [], [], 0
            for text in W.column(batch, "__text"):
                ws, raw = symbols(text)
                seen.update(ws)
                part.append(raw)
                size += len(raw)
                if size >= SLICE:
                    found.append(np.unique(runs_of(part), return_counts=True))
                    part, size = [], 0
            if part:
                found.append(np.unique(runs_of(part), return_counts=True))
            if found:
                runs, c = _merged(found) if len(found) > 1 else found[0]
                rows = [(b, ws, [seen[w] for w in ws], runs[at], c[at]) for b, ws, at in _asks(seen.keys(), runs, grid)]
                yield _pack(*[list(x) for x in zip(*rows, strict=True)])

    return run


def _unpacked(table: pa.Table) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    for ws, *rest in zip(*(table.column(n).to_pylist() for n in ("words", "wcounts", "runs", "rcounts")), strict=True):
        yield (ws.split(b"\n") if ws else [], *map(_numbers, rest))


def gathered(table: pa.Table) -> pa.Table:
    """One row of counts for a cell."""
    known: dict[bytes, int] = {}
    parts = []
    for ws, wc, runs, rc in _unpacked(table):
        for w, c in zip(ws, wc.tolist(), strict=True):
            known[w] = known.get(w, 0) + c
        parts.append((runs, rc))
    runs, rc = _merged(parts)
    return pa.Table.from_batches([_pack([table.column("cell")[0].as_py()], [list(known)], [list(known.values())], [runs], [rc])])


def _second(deep: int):
    """Of each cell the symbols after two bytes, with the distinct bytes before those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.unique(np.unique(runs & 0xFFFFFFFF) & 0xFFFFFF, return_counts=True) for _, _, runs, _ in _unpacked(pa.Table.from_batches([b]))]
            wide = [c // deep for c in b.column("cell").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(wide, pa.int32()), *map(_binary, zip(*rows, strict=True))], names=["wide", "low", "wcounts"])

    return run


def _second_gathered(table: pa.Table) -> pa.Table:
    low, c = _merged([(_numbers(a), _numbers(b)) for a, b in zip(table.column("low").to_pylist(), table.column("wcounts").to_pylist(), strict=True)])
    return pa.table({"wide": table.column("wide")[:1], "low": _binary([low]), "wcounts": _binary([c])})


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The symbols after one byte, with the distinct bytes before that one."""
    for b in batches:
        for low in b.column("low").to_pylist():
            r, c = np.unique(_numbers(low) & 0xFFFF, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(c, pa.int64())], names=["r", "c"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each cell: tokens, distinct words, bytes."""
    for b in batches:
        rows = [(int(wc.sum()), len(wc), int(rc.sum())) for _, wc, _, rc in _unpacked(pa.Table.from_batches([b]))]
        yield pa.RecordBatch.from_arrays([b.column("cell"), *[pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]], names=["cell", "tokens", "kinds", "bytes"])


class Trie:
    """Counts of contexts and symbols of each order; those of low orders may come from elsewhere."""

    def __init__(self, runs: np.ndarray, counts: np.ndarray, low: dict[int, tuple[np.ndarray, np.ndarray]] | None = None):
        self.keys, self.counts = [None] * (ORDER + 1), [None] * (ORDER + 1)
        self.ctx, self.total, self.distinct, self.ruled = ([None] * (ORDER + 1) for _ in range(4))
        self.keys[ORDER], self.counts[ORDER] = runs, counts
        for k in range(ORDER - 1, -1, -1):
            self.keys[k], self.counts[k] = np.unique(self.keys[k + 1] & ((1 << 8 * (k + 1)) - 1), return_counts=True)
            if low and k in low:
                self.keys[k], self.counts[k] = low[k]
        for k in range(ORDER + 1):
            self.ctx[k], first = np.unique(self.keys[k] >> 8, return_index=True)
            self.total[k] = np.add.reduceat(self.counts[k], first) if len(first) else np.empty(0, np.int64)
            self.distinct[k] = np.diff(np.append(first, len(self.keys[k])))
            if k and len(first):
                below = self._at(self.keys[k - 1], self.keys[k] & ((1 << 8 * k) - 1))[0]
                self.ruled[k] = np.add.reduceat(self.counts[k - 1][below], first)

    @staticmethod
    def _at(keys: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(want), np.int64), np.zeros(len(want), bool)
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        return at, keys[at] == want

    def logs(self, runs: np.ndarray) -> np.ndarray:
        """log10 probability of each run's last byte after the others."""
        out = np.zeros(len(runs))
        todo = np.arange(len(runs))
        ruled, gone = np.zeros(len(runs), np.int64), np.zeros(len(runs), np.int64)
        for k in range(ORDER, -1, -1):
            run = runs[todo] & ((1 << 8 * (k + 1)) - 1)
            c, known = self._at(self.ctx[k], run >> 8)
            s, seen = self._at(self.keys[k], run)
            if not len(self.ctx[k]):
                continue
            distinct = np.where(known, self.distinct[k][c], 0)
            free = distinct - gone[todo]
            whole = np.where(known, self.total[k][c] - ruled[todo], 0)
            sure = known & (whole > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                out[todo] += np.where(seen, np.log10((self.counts[k][s] - DISCOUNT) / whole), np.where(sure, np.log10(DISCOUNT * free / whole), 0.0))
            gone[todo] = np.where(known, distinct, gone[todo])
            ruled[todo] = np.where(known, self.ruled[k][c] if k else 0, ruled[todo])
            todo = todo[~seen]
        out[todo] -= np.log10(256 - gone[todo])
        return out


def _asks(ws, runs: np.ndarray, grid: Grid) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """Per cell: sorted words and sorted runs of a batch; always the same for the same batch."""
    by: dict[int, list[bytes]] = {}
    for w in ws:
        by.setdefault(grid.of_word(w), []).append(w)
    dealt = grid.of_runs(runs)
    order = np.argsort(dealt, kind="stable")
    cells, first = np.unique(dealt[order], return_index=True)
    there = dict(zip(cells.tolist(), np.split(order, first[1:]), strict=True)) if len(cells) else {}
    none = np.empty(0, np.int64)
    for b in sorted(by.keys() | there.keys()):
        yield b, sorted(by.get(b, ())), there.get(b, none)


def _distinct_texts(table: pa.Table) -> tuple[pa.Table, list[tuple[list[bytes], bytes]]]:
    """One row of each text of a batch, in the order of their hashes, and their symbols."""
    h1, h2 = (table.column(c).to_numpy() for c in ("h1", "h2"))
    order = np.lexsort((h2, h1))
    keep = order[np.concatenate([[True], (np.diff(h1[order]) != 0) | (np.diff(h2[order]) != 0)])] if len(order) else order
    table = table.take(pa.array(keep))
    return table, [symbols(t) for t in table.column("__text").to_pylist()]


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Without the texts that a record batch repeats, so that a hot text travels once from each."""
    for b in (b for b in batches if b.num_rows):
        _, first = np.unique(np.stack([b.column("h1").to_numpy(), b.column("h2").to_numpy()], axis=1), axis=0, return_index=True)
        yield b.take(pa.array(np.sort(first)))


def _asking(grid: Grid, slots: dict[int, int]):
    """slots: of heavy cells, in how many tasks they answer."""

    def run(table: pa.Table) -> pa.Table:
        batch = table.column("batch")[0].as_py()
        _, both = _distinct_texts(table)
        runs = np.unique(runs_of([raw for _, raw in both]))
        rows = [(b, batch % slots.get(b, 1), batch, b"\n".join(w), W.planes(runs[at])) for b, w, at in _asks({w for ws, _ in both for w in ws}, runs, grid)]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["cell", "slot", "batch", "words", "runs"])

    return run


def _answering(first: tuple[np.ndarray, np.ndarray]):
    def run(counts: pa.Table, asked: pa.Table) -> pa.Table:
        rows = []
        if asked.num_rows:
            known, runs, rc, second = {}, *[np.empty(0, np.int64)] * 2, (np.empty(0, np.int64),) * 2
            for part, low in zip(_unpacked(counts), counts.column("low").to_pylist(), strict=True):
                if low is None:  # the cell's own row, if it has counts
                    ws, wc, runs, rc = part
                    known = dict(zip(ws, wc.tolist(), strict=True))
                else:
                    second = _numbers(low), part[1]
            trie = Trie(runs, rc, {1: first, 2: second})
            for b, n, ws, rs in zip(*(asked.column(x).to_pylist() for x in ("cell", "batch", "words", "runs")), strict=True):
                got = np.array([known.get(w, 0) for w in ws.split(b"\n")] if ws else [], np.int64)
                rows.append((n, b, W.planes(got), trie.logs(_numbers(rs)).tobytes()))
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
        cols = list(zip(*rows, strict=True)) or [()] * 4
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=["batch", "cell", "counts", "logs"])

    return run


SCORED = "h1 long, h2 long, n_tokens long, n_known long, base_score double, score double"


def _scoring(grid: Grid, total: int, distinct: int, documents: int):
    """total, distinct: training tokens and kinds, ends of documents included."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        base, tokens, known, score = [], [], [], np.empty(0)
        docs, both = _distinct_texts(docs)
        if both:
            got = {b: (_numbers(c), np.frombuffer(x, np.float64)) for b, c, x in zip(*(answers.column(n).to_pylist() for n in ("cell", "counts", "logs")), strict=True)}
            each, there = pd.factorize(runs_of([raw for _, raw in both]))
            order = np.argsort(there)
            runs = there[order]
            logs, count = np.zeros(len(runs)), {}
            for b, ws, mine in _asks({w for x, _ in both for w in x}, runs, grid):
                count.update(zip(ws, got[b][0].tolist(), strict=True))
                logs[order[mine]] = got[b][1]
            sizes = np.array([len(raw) for _, raw in both])
            score = np.add.reduceat(logs[each], np.cumsum(sizes) - sizes)
            norm = np.log10(total + 0.5 * (distinct + 1))
            for ws, _ in both:
                c = np.array([*map(count.__getitem__, ws), documents], np.float64)
                base.append(float(np.log10(c + 0.5).sum() - len(c) * norm))
                tokens.append(len(c))
                known.append(int((c > 0).sum()))
        new = {"n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(known, pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(score, pa.float64())}
        return pa.table({"h1": docs.column("h1"), "h2": docs.column("h2")} | new)

    return run


def held_out(id_col: Column, remainder: int = HELD_OUT) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == remainder, F.lit(False))


def score(docs: DataFrame, training: Column, text_col: str = "text", columns: list[str] | None = None, per_batch: int = BATCH) -> DataFrame:
    """Adds n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) to every row.

    training: a boolean column; rows where it is true are learned from, all rows are scored. Tokens are words and
    an end for each document. columns: input columns to return (all but the text, if not given); those named
    like a result are replaced. per_batch: bytes of text that are scored together.

    A null text is an empty one, which is its end alone. Rows may repeat; each counts, and equal texts are scored once.
    Without training rows every byte has the same probability. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    new = ["n_tokens", "n_known", "base_score", "score"]
    keep = [c for c in columns or docs.columns if c not in (*new, "train_tokens", text_col)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashes = [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]
    seen = docs.agg(F.sum(F.octet_length(text) + 1).alias("all"), F.sum(F.when(training, 1)).alias("learned")).first()
    size, documents = seen["all"] or 0, seen.learned or 0
    grid = Grid(size, int(spark.conf.get("spark.sql.shuffle.partitions")))
    batches = max(1, -(-size // per_batch))

    texts = docs.where(training).select(text.alias("__text"))
    counts = texts.mapInArrow(_counted(grid), COUNTS).repartition(grid.cells, "cell").groupBy("cell").applyInArrow(gathered, COUNTS)
    counts = stage(counts, "counts")
    second = counts.mapInArrow(_second(grid.deep), "wide int, low binary, wcounts binary")
    second = stage(second.groupBy("wide").applyInArrow(_second_gathered, "wide int, low binary, wcounts binary"), "counts-of-order-2")
    pairs = sorted((r.r, r.c) for r in second.mapInArrow(_first, "r long, c long").groupBy("r").agg(F.sum("c").alias("c")).collect())  # at most 2^16 rows
    first = (np.array([r for r, _ in pairs], np.int64), np.array([c for _, c in pairs], np.int64))
    sums = stage(counts.mapInArrow(_sums, "cell int, tokens long, kinds long, bytes long"), "cell-sums")
    whole = sums.agg(F.sum("tokens").alias("tokens"), F.sum("kinds").alias("kinds"), F.sum("bytes").alias("bytes")).first()
    total, distinct = (whole.tokens or 0) + documents, (whole.kinds or 0) + (documents > 0)
    # fewer than a HEAVY-th of the cells can be that heavy
    bar = HEAVY * (whole.bytes or 0) / grid.cells
    heavy = stage(sums.where(F.col("bytes") > bar).select("cell", F.ceil(F.col("bytes") / F.lit(max(bar, 1.0))).cast("int").alias("slots")), "heavy-cells")
    slots = {r.cell: r.slots for r in heavy.collect()}

    once = docs.select(*hashes, text.alias("__text")).mapInArrow(_once, "h1 long, h2 long, __text string")
    dealt = once.withColumn("batch", F.pmod("h1", F.lit(batches))).repartition(max(grid.cells, int(spark.conf.get("spark.sql.shuffle.partitions"))), "batch")
    asked = dealt.groupBy("batch").applyInArrow(_asking(grid, slots), ASKED)
    lows = second.withColumn("cell", F.explode(F.sequence(F.col("wide") * grid.deep, F.col("wide") * grid.deep + (grid.deep - 1)))).drop("wide")
    known = counts.unionByName(lows, allowMissingColumns=True).join(heavy, "cell", "left")
    copies = known.withColumn("slot", F.explode(F.sequence(F.lit(0), F.coalesce("slots", F.lit(1)) - 1))).drop("slots")
    tasks = grid.cells + sum(slots.values())
    asked, copies = (df.repartition(tasks, "cell", "slot").groupBy("cell", "slot") for df in (asked, copies))
    answers = copies.cogroup(asked).applyInArrow(_answering(first), ANSWERED)
    scored = dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_scoring(grid, total, distinct, documents), SCORED)
    rows = docs.select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)], *[h.alias(f"__{n}") for h, n in zip(hashes, ("h1", "h2"), strict=True)])
    # a text that several record batches hold has one score
    out = rows.join(scored, (F.col("__h1") == F.col("h1")) & (F.col("__h2") == F.col("h2")))
    return out.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], *new, F.lit(total).cast("long").alias("train_tokens"))

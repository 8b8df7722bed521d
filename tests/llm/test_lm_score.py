import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kadenz.llm import lm_score, queries

SF = "/root/testdata/sf0.001"


class Ppm:
    """PPM with discounts, symbol and update exclusion, symbol by symbol."""

    def __init__(self, texts, order=lm_score.ORDER):
        self.seen, self.order = defaultdict(Counter), order
        for t in texts:
            raw = b"\n" * order + t
            for p in range(order, len(raw)):
                for k in range(order, -1, -1):
                    new = raw[p] not in self.seen[raw[p - k : p]]
                    self.seen[raw[p - k : p]][raw[p]] += 1
                    if not new:
                        break

    def log(self, t):
        raw, total = b"\n" * self.order + t, 0.0
        for p in range(self.order, len(raw)):
            out = set()
            for k in range(self.order, -1, -1):
                here = {s: c for s, c in self.seen.get(raw[p - k : p], {}).items() if s not in out}
                whole = sum(here.values())
                if raw[p] in here:
                    total += math.log10((here[raw[p]] - lm_score.DISCOUNT) / whole)
                    break
                if whole:
                    total += math.log10(lm_score.DISCOUNT * len(here) / whole)
                out |= set(here)
            else:
                total -= math.log10(256 - len(out))
        return total


def brute(docs, learned):
    parts = {i: (t or "").encode().lower().split() for i, t in docs}
    raw = {i: b" ".join(ws) + b"\n" for i, ws in parts.items()}
    count = Counter(w for i in learned for w in parts[i])
    n, v = sum(count.values()) + len(learned), len(count) + bool(learned)
    ppm = Ppm([raw[i] for i in learned])
    out = {}
    for i, ws in parts.items():
        c = [*[count[w] for w in ws], len(learned)]
        out[i] = (len(c), sum(x > 0 for x in c), n, sum(math.log10((x + 0.5) / (n + 0.5 * (v + 1))) for x in c), ppm.log(raw[i]))
    return out


def test_table_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    docs = [(r.doc_id, r.text) for r in rows]
    want = brute(docs, [i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 != 1])
    got = queries.op9_lm_scoring(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        n, known, total, base, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)


def test_many_cells_and_slots_do_not_change_the_result(spark, monkeypatch):
    """Deep cells, heavy ones that answer in several tasks, batches of a few texts, and one text in a third of the rows."""
    monkeypatch.setattr(lm_score, "CELL", 1000)
    monkeypatch.setattr(lm_score, "HEAVY", 1)
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(40).collect()
    docs = [(r.doc_id, (r.text or "")[:400]) for r in rows] + [(10_000 + i, "the same text again and again") for i in range(20)]
    want = brute(docs, [i for i, _ in docs if i % 3])
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.create_map("doc_id", "text")).repartition(5)
    got = lm_score.score(df, F.col("doc_id") % 3 != 0, columns=["doc_id"], per_batch=2000).collect()
    assert lm_score.Grid(14_000, 8).deep == 1 and lm_score.Grid(100_000, 8).deep > 1
    assert {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens) for r in got} == {i: w[:3] for i, w in want.items()} and len(got) == len(docs)
    for r in got:
        assert r.base_score == pytest.approx(want[r.doc_id][3], rel=1e-9) and r.score == pytest.approx(want[r.doc_id][4], rel=1e-9)


def test_probabilities_of_a_context_sum_to_one():
    rng = np.random.default_rng(0)
    runs, counts = np.unique(lm_score.runs_of([bytes(rng.integers(97, 101, 40).tolist()) + b"\n" for _ in range(30)]), return_counts=True)
    trie = lm_score.Trie(runs, counts)
    for ctx in (b"aabca", b"zzzab", b"\n\n\n\n\n", b"zzzzz"):
        every = np.array([int.from_bytes(ctx, "big") << 8 | s for s in range(256)], np.int64)
        assert (10 ** trie.logs(every)).sum() == pytest.approx(1)


def test_better_than_base_on_held_out_texts(spark):
    rows = queries.op9_lm_scoring(spark, "/root/testdata/sf0.1").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert rows.s > rows.b


def test_odd_rows_and_empty_tables(odd, none):
    got = lm_score.score(odd, F.col("doc_id") == 1, per_batch=2).collect()
    assert len(got) == odd.count() and set(got[0].asDict()) == {*odd.columns, "n_tokens", "n_known", "base_score", "score", "train_tokens"} - {"text"}
    assert {(r.n_tokens, r.n_known) for r in got if r.doc_id in (3, 4, 5)} == {(1, 1)}
    assert {r.train_tokens for r in got} == {10}
    plain = lm_score.score(odd, F.lit(False)).where("doc_id = 4").collect()
    assert plain[0].score == pytest.approx(-math.log10(256)) and plain[0].n_known == 0
    assert lm_score.score(none, F.lit(True)).count() == 0

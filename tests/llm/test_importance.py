import hashlib
import math
import zlib

import numpy as np
import pytest
import regex
from hypothesis import given
from hypothesis import strategies as st

from kadenz.llm import importance as I

WORDS = regex.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text):
    ws = WORDS.findall((text or "").encode().lower())
    return len(ws), [b" ".join(ws[i : i + n]) for n in (1, 2, 3) for i in range(len(ws) - n + 1)]


def brute(docs, target, percent=5, seed=42, least=20, size=I.BUCKETS):
    count = lambda texts: np.bincount([zlib.crc32(f) % size for t in texts for f in runs(t)[1]] or [0], minlength=size) - (0 if any(runs(t)[1] for t in texts) else np.eye(1, size, dtype=int)[0])
    s, t = count([t for _, t in docs]), count(target)
    gain = [math.floor(1000 * math.log((b + 1.0) * (s.sum() + size) / ((a + 1.0) * (t.sum() + size)))) for a, b in zip(s.tolist(), t.tolist(), strict=True)]
    rows = []
    for d, text in docs:
        n, fs = runs(text)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        w = sum(gain[zlib.crc32(f) % size] for f in fs)
        rows.append([d, n, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    enough = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    for k, r in enumerate(enough[: percent * len(enough) // 100], 1):
        r[5] = k
    return sorted(map(tuple, rows), key=str)


def result(out):
    return sorted(((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r.rank) for r in out.collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(3)
    words = ["The", "of", "é", "x1", "Ünder", "word" * 30, *[f"w{i}" for i in range(300)]]
    pick = lambda n: " ".join(words[min(int(rng.exponential(12)), len(words) - 1)] for _ in range(n))
    docs = [(i, pick(int(rng.integers(0, 90)))) for i in range(400)]
    docs += [(5, docs[5][1]), (None, pick(40)), (None, None), (400, ""), (401, "--- \n"), (402, "A-B_c" * 50), (403, "q" * 3000 + " " + pick(30)), (404, pick(20_000))]
    return docs, [pick(60) for _ in range(20)] + [None, ""]


def frames(spark, docs, target):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string")


@pytest.mark.parametrize(("size", "cut", "words"), [(65_536, 1 << 20, 200_000), (40, 997, 500), (1, 64, 3)])
def test_against_brute_force(spark, corpus, size, cut, words, monkeypatch):
    """Whatever the head and wherever slices end, the result is the same."""
    docs, target = corpus
    df, goal = frames(spark, docs, target)
    known = I.head(df, size=size)
    assert len(known.number) <= size and len(known.keys) <= size
    assert size == 1 or len(known.number) > 5
    monkeypatch.setattr(I, "SLICE", cut)
    monkeypatch.setattr(I, "WORDS", words)
    found = [[] for _ in docs]
    for _, number, bucket in known.blocks(t for _, t in docs):
        for i, b in zip(number.tolist(), bucket.tolist(), strict=True):
            found[i].append(b)
    assert [sorted(f) for f in found] == [sorted(zlib.crc32(f) % I.BUCKETS for f in runs(t)[1]) for _, t in docs]
    monkeypatch.undo()
    assert result(I.resample(df.repartition(3), goal, size=size)) == brute(docs, target)


def test_odd_rows(spark, odd, none):
    goal = spark.createDataFrame([("quick fox",)], "text string")
    out = I.resample(odd, goal, percent=100, least_words=3)
    assert out.columns == ["doc_id", "text", "lang", "kept", "__id", "n_words", "n_features", "weight", "score", "rank"] and out.count() == odd.count()
    want = brute([(r.doc_id, r.text) for r in odd.collect()], ["quick fox"], percent=100, least=3)
    assert [r[:5] for r in result(out)] == [r[:5] for r in want] and sorted(r[5] or 0 for r in result(out)) == sorted(r[5] or 0 for r in want)
    assert I.resample(none, goal).count() == 0 and I.resample(odd, goal.where("false")).where("rank IS NOT NULL").count() == 0


def test_draws_lean_towards_the_target(spark):
    rng = np.random.default_rng(1)
    make = lambda kind, i: (i, " ".join(f"{kind}{rng.integers(40)}" for _ in range(30)))
    docs = [make("a" if i % 10 else "b", i) for i in range(1000)]
    df, goal = frames(spark, docs, [make("b", 0)[1] for _ in range(50)])
    drawn = I.resample(df, goal, percent=10).where("rank IS NOT NULL").collect()
    assert len(drawn) == 100 and sum(r.doc_id % 10 == 0 for r in drawn) > 90


@given(st.lists(st.binary(min_size=1, max_size=90), min_size=1, max_size=8))
def test_runs_of_words_have_the_crc_of_their_text(words):
    words = [w for w in (x.translate(I.SPLIT).replace(b" ", b"") for x in words) if w]
    head = I.Head(words[::2], [(a, b) for a, b in zip(words, words[1:], strict=False) if a in words[::2] and b in words[::2]][:1], 1 << 32)
    if words:
        one, two, three = head.features(words)
        crc = lambda n: [zlib.crc32(b" ".join(words[i : i + n])) for i in range(len(words) - n + 1)]
        assert one.tolist() == crc(1) and two.tolist() == crc(2) and three.tolist() == crc(3)

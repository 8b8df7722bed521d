import random

import pytest

from kadenz.llm import substring_dedup as S


def brute(docs, window):
    """docs: (id, text) with ids apart. Kept words of each, by the definition."""
    first, words = {}, {i: (t or "").split() for i, t in docs}
    for i in sorted(words):
        for p in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][p : p + window]), (i, p))
    out = {}
    for i, ws in words.items():
        gone = {q for p in range(len(ws) - window + 1) if first[tuple(ws[p : p + window])] != (i, p) for q in range(p, p + window)}
        out[i] = (" ".join(w for q, w in enumerate(ws) if q not in gone), len(ws), len(gone))
    return out


@pytest.mark.parametrize("window", [1, 3, 9, 10, 20, 27, 50])
def test_against_brute_force(spark, window):
    rng = random.Random(window)
    passages = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(5, 70))] for _ in range(12)]
    docs = []
    for i in range(120):
        ws = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(ws))
            ws[at:at] = rng.choice(passages)
        docs.append((i * 7 - 300, " ".join(ws)))
    docs += [(1000, "la " * 300), (1001, "la " * 40), (1002, "")]
    got = S.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), window=window).collect()
    want = brute(docs, window)
    assert {r.doc_id: (r.text, r.n_words, r.n_removed) for r in got} == want


@pytest.mark.parametrize("period", S.COVERS)
def test_covers_reach_every_difference(period):
    c = S.COVERS[period]
    assert {(a - b) % period for a in c for b in c} == set(range(period))


def test_odd_rows(spark, odd, none):
    got = S.substring_dedup(odd, window=3).collect()
    assert len(got) == odd.count() and set(got[0].asDict()) == {*odd.columns, "n_words", "n_removed"}
    texts = sorted(((r.doc_id is not None, r.doc_id or 0, r.text) for r in got))
    assert (False, 0, "the quick brown fox") in texts  # null ids come first, so their words stay
    assert [r.text for r in got if r.doc_id == 1] == ["The", "The"]
    assert {r.n_removed for r in got if r.doc_id == 1} == {3}
    assert [r.n_words for r in got if r.doc_id == 6 and r.text.startswith("x")] == [20000]
    assert S.substring_dedup(none, window=3).count() == 0

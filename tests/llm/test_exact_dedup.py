import pytest

from kadenz.llm import exact_dedup as E


@pytest.mark.parametrize("block", [1, 2, 5, 2048])
def test_against_grouping(spark, block):
    texts = ["a", "A", "", None, "abcde", "ABCDE", "abcdef", "abcdeg", "abcd\nf" * 30, "ABCD\nf" * 30, "abcd\nf" * 29 + "abcd\ng", "É", "é", "ab" * 33, "ba" * 33]
    docs = [(i * 10 % 7 * 100 + i, t) for i, t in enumerate(texts * 2)]
    got = E.exact_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), block=block).collect()
    fold = lambda t: (t or "").encode().lower()
    groups = {}
    for i, t in docs:
        groups.setdefault(fold(t), []).append(i)
    assert len(got) == len(docs)
    for r in got:
        g = groups[fold(r.text)]
        assert (r.keep_id, r.group_size, r.kept) == (max(g), len(g), r.doc_id == max(g))


def test_odd_rows(odd, none):
    got = E.exact_dedup(odd).collect()
    assert len(got) == odd.count() and set(got[0].asDict()) == {"doc_id", "text", "lang", "__id", "keep_id", "group_size", "kept"}
    fox = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got if (r.text or "").lower() == "the quick brown fox"]
    assert sorted(fox, key=str) == [(1, 2, 4, False), (1, 2, 4, False), (2, 2, 4, True), (None, 2, 4, False)]
    empty = {(r.doc_id, r.keep_id, r.group_size) for r in got if not r.text}
    assert empty == {(3, 4, 3), (4, 4, 3), (None, 4, 3)}
    assert E.exact_dedup(none).count() == 0


def test_of_repeated_rows_one_stays(spark):
    rows = [(7, "same", i) for i in range(30)] + [(3, "SAME", 0), (7, "other", 1), (None, "none", 1), (None, "none", 2), (9, "a", 1), (9, "A", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(4)
    got = E.exact_dedup(df).collect()
    assert len(got) == len(rows)
    kept = sorted((r.doc_id or 0, r.text.lower(), r.group_size) for r in got if r.kept)
    assert kept == [(0, "none", 2), (7, "other", 1), (7, "same", 31), (9, "a", 2)]

import hashlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from kadenz.llm import merkle

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
FIELDS = ["doc_id", "source", "text"]


def leaf_of(*values):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def brute_tree(nodes, fanout):
    """Root and, for each leaf, the siblings (before, behind) of each level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for path, i in zip(paths, at, strict=True):
            run, k = runs[i // fanout], i % fanout
            path.append(("".join(run[:k]), "".join(run[k + 1 :])))
        at, nodes = [i // fanout for i in at], [H(*r) for r in runs]
    return nodes[0], paths


def brute(rows, fanout):
    first = lambda v: (v is not None, v if v is not None else 0)
    leaves = sorted(((s, d, leaf_of(d, s, t)) for d, s, t in rows), key=lambda r: (r[0] is not None, (r[0] or "").encode(), first(r[1]), r[2]))
    groups = [list(g) for _, g in groupby(leaves, key=lambda r: r[0])]
    trees = [brute_tree([r[2] for r in g], fanout) for g in groups]
    root, crown = brute_tree([t[0] for t in trees], fanout)
    return sorted((str(d), leaf, sub, root, tuple(path + up)) for g, (sub, paths), up in zip(groups, trees, crown, strict=True) for (_, d, leaf), path in zip(g, paths, strict=True))


def as_rows(out):
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, tuple((s.ahead, s.behind) for s in r.steps)) for r in out.collect())


@pytest.mark.parametrize(("fanout", "sizes"), [(16, [1, 2, 16, 17, 300]), (2, [1, 3, 8]), (3, [28]), (16, [1])])
def test_against_trees_in_memory(spark, fanout, sizes):
    names = [None, "", "b", "é", "z"]
    rows = [(g * 1000 + i * 7 % n, names[g], f"Text {i}") for g, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    assert as_rows(merkle.manifest(df, FIELDS, fanout=fanout)) == brute(rows, fanout)


def test_many_groups_have_a_tree_of_their_own(spark):
    rows = [(i, f"s{i % 40:02}", "x") for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert as_rows(merkle.manifest(df, FIELDS)) == brute(rows, 16)


def test_a_changed_row_folds_to_another_root(spark):
    rows = [(i, "a" if i % 3 else "b", f"Text {i}") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    other = merkle.digest(F.col("doc_id"), F.col("source"), merkle.lowered(F.col("text")))
    out = merkle.manifest(df, FIELDS, claims={"other": F.when(F.col("doc_id") % 2 == 0, other)})
    folded = out.select("doc_id", (merkle.fold(F.coalesce("other", "leaf"), F.col("steps")) == F.col("root")).alias("ok"), merkle.siblings(F.col("steps")).alias("s")).collect()
    assert all(r.ok == (r.doc_id % 2 == 1) for r in folded) and all(len(r.s) % 64 == 0 for r in folded)


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.lang, r.text) for r in odd.collect()]
    out = merkle.manifest(odd, ["doc_id", "lang", "text"], group_col="lang")
    assert out.columns == ["doc_id", "lang", "leaf", "subroot", "root", "steps"]
    assert as_rows(out) == brute(rows, 16)
    assert merkle.manifest(none, ["doc_id", "lang", "text"], group_col="lang").count() == 0


def test_no_python_in_the_plan(spark, odd):
    plan = merkle.manifest(odd, ["doc_id", "text"], group_col="lang")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan

import random
from collections import Counter

import pytest

from kadenz.llm import near_dedup, queries
from kadenz.llm.components import components

SF = "/root/testdata/sf0.01"


def brute(docs, size, percent):
    """docs: (id, text) with ids apart: id -> (set size, smallest id reachable)."""
    sets, index = {}, {}
    for i, t in docs:
        raw = (t or "").encode().lower().split()
        sets[i] = {tuple(raw[p : p + size]) for p in range(len(raw) - size + 1)} if len(raw) >= size else {tuple(raw)} if raw else set()
        for s in sets[i]:
            index.setdefault(s, []).append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        for j, common in Counter(j for x in s for j in index[x] if j < i).items():
            if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_whole_table_against_brute_force(spark):
    rows = queries.op2_minhash_near_dedup(spark, SF).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute(docs, 4, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want and len(rows) == len(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    assert sum(not r.kept for r in rows) > 20


@pytest.mark.parametrize(("short", "exact"), [(near_dedup.SHORT, False), (3, False), (3, True)])
def test_large_groups_and_boilerplate(spark, monkeypatch, short, exact):
    """Groups of near copies, chains of copies, and a passage in many unrelated texts."""
    monkeypatch.setattr(near_dedup, "SHORT", short)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = random.Random(5)
    word = lambda: f"w{rng.randint(0, 3000)}"
    texts, line = [], [word() for _ in range(25)]
    for _ in range(3):
        base = [word() for _ in range(rng.randint(60, 150))]
        for _ in range(60):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(copy)
    chain = [word() for _ in range(100)]
    for k in range(30):
        chain = list(chain)
        chain[3 * k % 100] = word()
        texts.append(chain)
    texts += [line + [word() for _ in range(rng.randint(3, 60))] for _ in range(120)]
    rng.shuffle(texts)
    docs = [(i * 3 + 1, " ".join(t)) for i, t in enumerate(texts)]
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), size=5, exact=exact).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs, 5, 80)


@pytest.mark.parametrize("exact", [False, True])
def test_pairs_right_at_the_threshold(spark, exact):
    """Pairs with 80 of 100 words in common, which are links, and with 79 of 100, which are none."""
    docs = []
    for p in range(400):
        common = 80 - p % 2
        words = [f"p{p}w{i}" for i in range(100)]
        docs += [(2 * p, " ".join(words[: common + 10])), (2 * p + 1, " ".join(words[:common] + words[common + 10 :]))]
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), size=1, exact=exact).collect()
    linked = {r.doc_id // 2 for r in got if not r.kept}
    assert linked == set(range(0, 400, 2))


def test_odd_rows(odd, none):
    got = near_dedup.near_duplicates(odd, size=4).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert by[1] == [(1, 1, True)] * 2 and by[2] == [(1, 1, False)]
    assert all(by[i] == [(0, i, True)] for i in (3, 4, 5))
    assert sorted(by[None]) == [(0, None, True), (1, None, True)]
    assert {c for _, c, _ in by[6]} == {6} and by[7] == [(2, 7, True)]  # a no-break space is a word here
    assert near_dedup.near_duplicates(none).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(400, 470)] + [(7, 7)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 400 for i in [*range(400, 470), 500]}


def test_a_long_path_of_rising_ids_takes_few_rounds(spark, monkeypatch):
    from kadenz.llm import components as module

    rounds = []
    write = module.stage
    monkeypatch.setattr(module, "stage", lambda df, name: rounds.append(name) or write(df, name))
    got = components(spark.createDataFrame([(i, i + 1) for i in range(1000)], "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == dict.fromkeys(range(1001), 0)
    assert rounds.count("parents") <= 15


@pytest.mark.parametrize("short", [near_dedup.SHORT, 3])
def test_ids_that_stand_for_several_texts_in_long_lists(spark, monkeypatch, short):
    """Every third id repeats with a second text, which belongs to another group."""
    monkeypatch.setattr(near_dedup, "SHORT", short)
    monkeypatch.setattr(near_dedup, "SHINGLES", 900)
    rng = random.Random(8)
    word = lambda: f"w{rng.randint(0, 3000)}"
    docs = []
    for g in range(6):
        base = [word() for _ in range(80)]
        for k in range(40):
            copy = list(base)
            copy[rng.randrange(80)] = word()
            docs.append((g * 100 + k, " ".join(copy)))
            if g % 2 and k % 3 == 0 and g < 4:
                docs.append((g * 100 + k - 100, " ".join(reversed(copy))))
    apart = [(n, t) for n, (_, t) in enumerate(docs)]
    linked = {n: c for n, (_, c) in brute(apart, 5, 80).items()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for n, (i, _) in enumerate(docs):
        root[find(("c", linked[n]))] = find(("d", i))
    least = {}
    for i, _ in docs:
        least[find(("d", i))] = min(i, least.get(find(("d", i)), i))
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), size=5).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: r.component_id for r in got} == {i: least[find(("d", i))] for i, _ in docs}


def test_an_estimate_far_below_the_threshold_is_verified(spark):
    """178 of 222 words in common, but 24 of the union's 48 smallest hashes only."""
    cache = near_dedup.W.WordHashes()
    words = sorted((f"w{i}" for i in range(222)), key=lambda w: near_dedup.shingles(w, 1, cache)[0])
    common, left, right = words[:24] + words[48:202], words[24:36] + words[202:212], words[36:48] + words[212:]
    docs = [(1, " ".join(common + left)), (2, " ".join(common + right))]
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), size=1).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs, 1, 80) == {1: (200, 1), 2: (200, 1)}

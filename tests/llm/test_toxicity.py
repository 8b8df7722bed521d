import math
import zlib

import numpy as np
import pytest

from kadenz.llm import queries, toxicity

SF = "/root/testdata/sf0.1"


def test_folding():
    assert toxicity.folded("1D10T, іԁіot Ｆull Ünï") == " idiot idiot full ünï "
    assert toxicity.folded(None) == toxicity.folded(" \n") == " "


def test_signs_are_letters_within_words_only():
    fold = toxicity.folded
    assert fold("you idiot! you id!ot; $hit a$$ @ss") == " you idiot you idiot shit ass ass "
    assert fold("great! it's $5 | or @ noon?") == " great it s s or noon "
    assert fold("!") == fold("$$ @|") == " " and fold("!a") == " a "


def test_letters_that_stand_apart_are_joined():
    assert toxicity.folded("you i.d-i o_t") == " you idiot "
    assert toxicity.folded("a b") == " a b " and toxicity.folded("x a b c yy d e f") == " x a b c yy def ".replace("x a b c", "xabc")


def test_hits_inside_exceptions_do_not_count():
    model = toxicity.Lexicon({" trash ": 3.0, " idiot ": 3.0}, frozenset({" trash can ", " big trash "}))
    found = model.automaton()
    weights = lambda t: toxicity.hit_weights(toxicity.folded(t), found)
    assert weights("you trash") == [3.0] and weights("the TRASH can") == []
    assert weights("big trash can you idiot!") == [3.0]  # two exceptions cover one hit, and no other
    assert weights("big trash, trash, trash can") == [3.0]


def by_hand(docs, labels):
    """The same scores, word by word and without an automaton. docs: id -> text; labels: (id, label)."""
    fold = toxicity.folded
    words = {i: fold(t).split() for i, t in docs.items()}
    rows = [(words[i], y) for i, y in labels if i in docs]
    n0, n1 = (sum(y == v for _, y in rows) for v in (0, 1))
    seen = {}
    for ws, y in rows:
        for w in set(ws):
            for e in [f" {w} ", *(f" {w[:k]}" for k in range(toxicity.STEMS[0], min(toxicity.STEMS[1], len(w)) + 1))]:
                seen.setdefault(e, {0: [], 1: []})[y].append(w)
    odds = {}
    for e, c in seen.items():
        a, b = len(c[0]) + 0.5, len(c[1]) + 0.5
        o = math.log(b / (n1 + 1)) - math.log(a / (n0 + 1))
        if len(c[1]) >= toxicity.SUPPORT and o >= toxicity.ODDS and o / math.sqrt(1 / a + 1 / b) >= toxicity.SURE:
            odds[e] = o
    weights = {}
    for e in sorted(odds, key=len):
        stem = e.rstrip(" ")
        shorter = [stem[:n] for n in range(toxicity.STEMS[0] + 1, len(stem) + (e != stem))]
        if not any(x in weights and odds[x] >= 0.8 * odds[e] for x in shorter):
            weights[e] = odds[e]
    entries = lambda w: [e for e in weights if (w == e[1:-1] if e.endswith(" ") else w.startswith(e[1:]))]
    telling = {w for ws in words.values() for w in ws if entries(w)}
    phrases = {}
    for ws, y in rows:
        for p in {p for k, w in enumerate(ws) if w in telling for p in (tuple(ws[k - 1 : k + 1]), tuple(ws[k : k + 2])) if len(p) == 2}:
            phrases.setdefault(p, [0, 0])[y] += 1
    benign = {p for p, (a, b) in phrases.items() if a >= 5 and a >= 9 * b}

    def measure(ws):
        total = 0.0
        for k, w in enumerate(ws):
            if w in telling and tuple(ws[k - 1 : k + 1]) not in benign and tuple(ws[k : k + 2]) not in benign:
                total += sum(weights[e] for e in entries(w))
        return math.log1p(total), 100 * total / max(20, len(ws))

    curve = toxicity._curve(np.array([measure(ws) for ws, _ in rows]), np.array([float(y) for _, y in rows]))
    return {i: 1 / (1 + math.exp(-(curve[0] + curve[1] * a + curve[2] * b))) for i, ws in words.items() for a, b in [measure(ws)]}, weights, benign


def test_query_against_scores_by_hand(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    want, weights, _ = by_hand(docs, labels)
    rows = queries.op1_toxicity(spark, sf).collect()
    assert weights and len(rows) == len(docs) and {r.doc_id for r in rows} == docs.keys()
    for r in rows:
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-6) and r.predicted == (r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in queries.op1_toxicity(spark, SF).collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(rows[d].held_out for d, _ in labels)
    right = {y: [rows[d].predicted == y for d, t in labels if t == y] for y in (0, 1)}
    assert min(len(v) for v in right.values()) > 20
    # some rows of the table are labelled toxic without any telling word
    assert sum(right[0]) / len(right[0]) > 0.98 and sum(right[1]) / len(right[1]) > 0.9


def test_odd_rows_and_no_labels(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    out = toxicity.score(odd, toxicity.learn(odd, labels)).collect()
    assert len(out) == odd.count() and all(0 <= r.toxicity <= 1 for r in out)
    model = toxicity.learn(odd, labels.where("false"))
    assert {round(r.toxicity, 6) for r in toxicity.score(odd, model).collect()} == {0.0}
    assert toxicity.score(none, model).count() == 0

"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton on folded text.

Folding lowers, maps look-alike letters to Latin ones and digits or signs to the letters they stand for, drops
marks that stand alone, turns the rest into single spaces and joins letters that stand apart. Accented letters stay:
they tell words apart. A sign is a letter only within or before letters, since behind a word it is punctuation.
Lexicon entries are whole words (" idiot ") or word beginnings (" idio"), each with its log-odds in labelled rows;
a hit inside an exception phrase does not count. A text's weight is put in relation to its length, and a logistic
curve turns it into a score.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kadenz.llm import words as W
from kadenz.llm.staging import stage

#: Labelled rows that are learned from, at most. The lexicon has no bound of its own.
LABELLED = 50_000
#: Documents that hold an entry, log-odds and their standard scores, each at least.
SUPPORT, ODDS, SURE = 3, 2.0, 4.0
#: Lengths of word beginnings.
STEMS = (3, 8)
#: Letters of other scripts that look like Latin ones, and digits or signs used for letters.
HOMOGLYPHS = dict(zip("аеорсухівһјѕԁɡɩкмнтзαβεικνορτυχωγѵᴀıļ", "aeopcyxibhjsdgikmhtzabeiknoptuxwgvail", strict=True))
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i"}
SIGN_RUN = re.compile("[@$!|]+")
#: Three or more letters in a folded text, each a word of its own.
LETTERS = re.compile("(?: [^ ]){3,}(?= )")


class Fold(dict):
    """Code point -> folded text, worked out once for each."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        low = unicodedata.normalize("NFKC", c.lower())
        out = "".join(HOMOGLYPHS.get(x, DIGITS.get(x, x)) for x in low if not unicodedata.combining(x))
        if not all(x.isalnum() for x in out):  # a mark of its own is empty, and vanishes
            out = " "
        self[code] = out
        return out


FOLD = Fold()


def _meant(m: re.Match) -> str:
    """Signs that stand for letters: between letters or digits, @ and $ before a letter, and $$ behind one."""
    run, text = m[0], m.string
    before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
    within = before.isalnum() and after.isalnum()
    begins = not before.isalnum() and after.isalpha() and not set(run) - {"@", "$"}
    ends = before.isalpha() and not after.isalnum() and run == "$$"
    return "".join(map(SIGNS.__getitem__, run)) if within or begins or ends else " "


def folded(text: str | None) -> str:
    """Words with one space around each; an empty or null text gives one space."""
    ws = SIGN_RUN.sub(_meant, text or "").translate(FOLD).split()
    if not ws:
        return " "
    return LETTERS.sub(lambda m: " " + m[0].replace(" ", ""), f" {' '.join(ws)} ")


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    #: Intercept and slopes for log(1 + weight) and weight per 100 words.
    curve: tuple[float, float, float] = (-30.0, 0.0, 0.0)

    def automaton(self):
        """Finds (length, weight) of entries and (length, None) of exceptions."""
        import ahocorasick

        found = ahocorasick.Automaton()
        for phrase, w in [*self.weights.items(), *((e, None) for e in self.exceptions)]:
            found.add_word(phrase, (len(phrase), w))
        if len(found):
            found.make_automaton()
        return found


def hit_weights(text: str, automaton) -> list[float]:
    """Weights of the entries in a folded text, without those that lie inside an exception."""
    found = [(end + 1 - n, end + 1, w) for end, (n, w) in automaton.iter(text)] if len(automaton) else []
    excepted = sorted((a, b) for a, b, w in found if w is None)
    if not excepted:
        return [w for _, _, w in found]
    starts, reach = [a for a, _ in excepted], []
    for _, b in excepted:
        reach.append(max(b, reach[-1]) if reach else b)
    out = []
    for a, b, w in found:
        k = bisect_right(starts, a)
        if w is not None and not (k and reach[k - 1] >= b):
            out.append(w)
    return out


def measures(text: str, automaton) -> tuple[float, float, int]:
    """Of a folded text: log(1 + weight), weight per 100 words, hits."""
    hits = hit_weights(text, automaton)
    total = sum(hits)
    return float(np.log1p(total)), 100.0 * total / max(20, text.count(" ") - 1), len(hits)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold a word, by label, per batch."""
    for batch in batches:
        seen = (Counter(), Counter())
        for text, toxic in zip(W.column(batch, "text"), W.column(batch, "toxic"), strict=True):
            seen[toxic].update(set(folded(text).split()))
        words = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_pydict({"word": words, "n0": [seen[0][w] for w in words], "n1": [seen[1][w] for w in words]}, schema=pa.schema([("word", pa.string()), ("n0", pa.int64()), ("n1", pa.int64())]))


def _phrase_counts(weights: dict[str, float]):
    """Documents that hold an entry together with the word before or after it, by label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Lexicon(weights).automaton()
        for batch in batches:
            seen: Counter = Counter()
            for text, toxic in zip(W.column(batch, "text"), W.column(batch, "toxic"), strict=True):
                f, here = folded(text), set()
                for end, _ in automaton.iter(f):
                    a = f.rfind(" ", 0, end) if f[end] == " " else f.rfind(" ", 0, end + 1)
                    b = f.index(" ", a + 1)
                    here |= {f[f.rfind(" ", 0, a) : b + 1]} if a > 0 else set()
                    here |= {f[a : f.index(" ", b + 1) + 1]} if b + 1 < len(f) else set()
                seen.update((p, toxic) for p in here)
            keys = list(seen)
            yield pa.RecordBatch.from_pydict({"phrase": [k[0] for k in keys], "toxic": [k[1] for k in keys], "n": [seen[k] for k in keys]}, schema=pa.schema([("phrase", pa.string()), ("toxic", pa.int32()), ("n", pa.int64())]))

    return run


def _chosen(entries: list) -> dict[str, float]:
    """The shortest beginnings that are as telling as what they begin."""
    odds = {e.entry: e.odds for e in entries}
    kept = {}
    for e in sorted(odds, key=len):
        stem = e.rstrip(" ")
        if not any(stem[:n] in kept and odds[stem[:n]] >= 0.8 * odds[e] for n in range(STEMS[0] + 1, len(stem) + (e != stem))):
            kept[e] = odds[e]
    return kept


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton's method with a small ridge."""
    if not len(y) or y.min() == y.max():
        return (30.0 if len(y) and y[0] else -30.0, 0.0, 0.0)
    a = np.column_stack([np.ones(len(y)), x])
    b = np.zeros(a.shape[1])
    ridge = np.diag([1e-6, 0.5, 0.5])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (y - p) - ridge @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in b)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = LABELLED) -> Lexicon:
    """Learns from labelled rows. Of more than `most` (a documented bound) a fixed sample by hash is used.

    The lexicon and its exceptions hold all that pass the thresholds; as these need several of the sampled rows each,
    their number is bounded by the sample. Rows of labels with a null id or label, or without a document, count for
    nothing. Where ids repeat so that more than `most` texts are labelled, a share of them by hash is used. Without
    labelled rows, or with one label only, the lexicon is empty and every score is 0 or 1 alike.
    """
    sample = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("toxic")).where("__id IS NOT NULL AND toxic IN (0, 1)")
    sample = sample.orderBy(F.xxhash64("__id"), "__id", "toxic").limit(most)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    rows = stage(texts.join(F.broadcast(sample), "__id").select("text", "toxic"), "labelled")  # at most `most` small rows are broadcast
    if (found := rows.count()) > most:
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(-(-found // most))) == 0)
    totals = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    words = rows.mapInArrow(_word_counts, "word string, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    lengths = F.sequence(F.lit(STEMS[0]), F.least(F.lit(STEMS[1]), F.length("word")))
    stems = words.where(F.length("word") >= STEMS[0]).withColumn("k", F.explode(lengths)).groupBy(F.concat(F.lit(" "), F.substring("word", F.lit(1), F.col("k"))).alias("entry"))
    counts = stems.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).unionByName(words.select(F.concat(F.lit(" "), "word", F.lit(" ")).alias("entry"), "n0", "n1"))
    half = lambda c: F.col(c) + 0.5
    counts = counts.where(F.col("n1") >= SUPPORT).withColumn("odds", F.log(half("n1") / (n1 + 1)) - F.log(half("n0") / (n0 + 1)))
    counts = counts.withColumn("sure", F.col("odds") / F.sqrt(1 / half("n0") + 1 / half("n1")))
    best = counts.where((F.col("odds") >= ODDS) & (F.col("sure") >= SURE)).collect()
    model = Lexicon(_chosen(best))
    phrases = rows.mapInArrow(_phrase_counts(model.weights), "phrase string, toxic int, n long").groupBy("phrase") if model.weights else None
    if phrases is not None:
        of = lambda v: F.coalesce(F.sum(F.when(F.col("toxic") == v, F.col("n"))), F.lit(0))
        benign = phrases.agg(of(0).alias("n0"), of(1).alias("n1")).where("n0 >= 5 AND n0 >= 9 * n1")
        model.exceptions = frozenset(r.phrase for r in benign.collect())
    got = rows.mapInArrow(_measured(model), "a double, b double, toxic int").toPandas()  # as many small rows as the bound
    model.curve = _curve(got[["a", "b"]].to_numpy(float), got["toxic"].to_numpy(float))
    return model


def _measured(model: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            got = [measures(folded(t), automaton) for t in W.column(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64()), batch.column("toxic")], names=["a", "b", "toxic"])

    return run


def score(docs: DataFrame, model: Lexicon, text_col: str = "text") -> DataFrame:
    """Adds toxicity (0 to 1) and toxic_hits to every row; other columns stay, those named alike are replaced.

    Null, empty and blank texts have no hits and get the curve's lowest score. Only the text counts.
    """
    kept = [c for c in docs.columns if c not in ("toxicity", "toxic_hits")]
    place = kept.index(text_col)
    inner = [f"__k{i}" for i in range(len(kept))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        b0, b1, b2 = model.curve
        for batch in batches:
            got = [measures(folded(t), automaton) for t in W.column(batch, inner[place])]
            z = np.clip(b0 + b1 * np.array([g[0] for g in got]) + b2 * np.array([g[1] for g in got]), -30, 30)
            new = [pa.array(1 / (1 + np.exp(-z)), pa.float64()), pa.array([g[2] for g in got], pa.int64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in inner], *new], names=[*inner, "toxicity", "toxic_hits"])

    kinds = dict(docs.dtypes)
    wide = docs.select(*[docs[f"`{c}`"].alias(i) for i, c in zip(inner, kept, strict=True)])
    out = wide.mapInArrow(run, ", ".join([*[f"{i} {kinds[c]}" for i, c in zip(inner, kept, strict=True)], "toxicity double, toxic_hits long"]))
    return out.toDF(*kept, "toxicity", "toxic_hits")

from pyspark.sql import functions as F

import corpus_pipeline
from kadenz.llm import toxicity
from tests.llm.test_near_dedup import brute as near
from tests.llm.test_packing_bpe import check_packing
from tests.llm.test_substring_dedup import brute as repeats

SF = "/root/testdata/sf0.001"


def test_pipeline_against_brute_force(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    model = toxicity.learn(docs, labels)
    b0, b1, b2 = model.curve
    found = model.automaton()
    left = {}
    for r in docs.collect():
        m = toxicity.measures(toxicity.folded(r.text), found)
        if b0 + b1 * m[0] + b2 * m[1] < 0:
            left[r.doc_id] = r.text
    assert 0 < len(left) < docs.count()
    last = {}
    for i, t in left.items():
        key = (t or "").encode().lower()
        last[key] = max(i, last.get(key, i))
    left = {i: left[i] for i in last.values()}
    left = {i: left[i] for i, (_, c) in near(left.items(), 5, 80).items() if i == c}
    kept = [(i, t if n else left[i]) for i, (t, _, n) in repeats(left.items(), 20).items()]
    check_packing(rows, kept)


def test_stages_keep_columns_and_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, SF)
        assert out.count() == 0
        if name != "packing":
            assert out.columns == docs.columns
            docs = out


def test_stages_take_nulls_and_repeats(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "a b", "en", "s", 3), (1, "a b", "en", "s", 3), (2, None, None, "s", None), (3, "A B", None, None, 3)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, SF)
    assert docs.count() == 2  # of a b / A B the largest id; of the empty ones the id 2

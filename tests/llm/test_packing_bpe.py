import hashlib
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from kadenz.llm import bpe, packing, queries

SF = "/root/testdata/sf0.001"
RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def test_encoding_is_what_tiktoken_gives_and_round_trips(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    out = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS).collect()
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    assert len(out) == docs.count()
    for r in out:
        assert np.frombuffer(r.ids, "<u4").tolist() == own.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()


def test_clashing_columns_stay(odd, none):
    got = bpe.encode(odd.withColumnRenamed("kept", "__k0"), RANKS, P.PATTERN)
    assert got.columns == ["doc_id", "text", "lang", "__k0", "__id", "ids"] and got.count() == odd.count()
    assert bpe.encode(none, RANKS, P.PATTERN).count() == 0


def naive_bpe(piece, ranks):
    """Merges the leftmost pair of the lowest rank until none is left."""
    parts = [bytes([b]) for b in piece]
    while len(parts) > 1:
        r, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
        if r == 1 << 40:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[piece]] if piece in ranks else [ranks[p] for p in parts]


def test_replay_under_vocabularies_in_any_order():
    rng = np.random.default_rng(11)
    for _ in range(60):
        tokens = {bytes(rng.integers(97, 100, rng.integers(2, 6)).tolist()) for _ in range(25)}
        rest = sorted(tokens)
        rng.shuffle(rest)
        ranks = {t: i for i, t in enumerate([*(bytes([b]) for b in range(256)), *rest])}
        pieces = [bytes(rng.integers(97, 100, rng.integers(0, 30)).tolist()) for _ in range(60)] + [b"a" * 500]
        ids, sizes = bpe.replay(pieces, bpe.Merges(ranks))
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [naive_bpe(p, ranks) if p else [] for p in pieces]


def test_long_texts_and_a_full_memory_give_the_same_ids(monkeypatch):
    ranks = bpe.read_ranks(RANKS)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    monkeypatch.setattr(bpe, "SLICE", 300)
    monkeypatch.setattr(bpe, "CHUNK", 20)
    encoder = bpe.Encoder(ranks, P.PATTERN)
    texts = [*(f"word{i} Wörter {i * i} \n" * (i % 60) for i in range(200)), "", "x" * 3000]
    batch = pa.RecordBatch.from_pydict({"t": [*texts, None]})
    got = [x.tolist() for _, part in bpe.sliced(batch, "t", 300) for ids, ends in [encoder.slice(part)] for x in np.split(ids, ends[:-1])]
    assert got == [own.encode_ordinary(t) for t in [*texts, ""]]


def test_query_gives_the_digests_of_what_tiktoken_gives(spark):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = own.encode_ordinary(r.text or "")
        raw = np.array(ids, "<u4").tobytes()
        want.append((r.doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(own.decode_bytes(ids)).hexdigest()))
    got = queries.op8_byte_bpe(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def check_packing(rows, docs, capacity=packing.CAPACITY):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = defaultdict(int)
    for d, t in docs:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        head = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(head, len(ids) + 1, capacity)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(d, i, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    got = defaultdict(int)
    bins = defaultdict(list)
    for r in rows:
        got[(r.doc_id, r.piece, r.start, r.length, r.ids_crc32)] += 1
        bins[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_of_a_table(spark):
    rows = queries.op3_best_fit_packing(spark, SF).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    n = check_packing(rows, docs)
    counts = np.bincount([r.length for r in rows], minlength=packing.CAPACITY + 1)
    assert n <= packing.lower_bound(counts, packing.CAPACITY) + 1


def test_odd_rows_and_empty_table(odd, none):
    cut = packing.pieces(odd, P.path("byte_bpe_50k.json"), P.PATTERN)
    check_packing(packing.pack(cut).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert packing.pack(packing.pieces(none, P.path("byte_bpe_50k.json"), P.PATTERN)).count() == 0


def test_exchange_saves_bins_and_loses_nothing(spark):
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 900, 3000).tolist()
    cut = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], packing.PIECE)
    one = packing.pack(cut, per_partition=60, fan=4).collect()
    bins = defaultdict(list)
    for r in one:
        bins[r.sequence_id].append((r.offset, r.length))
    assert sorted(r.doc_id for r in one) == list(range(3000))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0, *[n for _, n in parts]])[:-1]) and sum(n for _, n in parts) <= packing.CAPACITY
    least = packing.lower_bound(np.bincount(lengths, minlength=packing.CAPACITY + 1), packing.CAPACITY)
    assert least <= len(bins) <= least + 8  # 50 partitions alone would leave about 50 bins part-filled


def test_lower_bound_counts_large_sizes():
    counts = np.zeros(11, np.int64)
    counts[6] = 5
    assert packing.lower_bound(counts, 10) == 5
    counts = np.zeros(11, np.int64)
    counts[4] = 6
    assert packing.lower_bound(counts, 10) == 3


def test_ranks_are_those_of_the_rank_file():
    assert packing.ranks_of(P.path("byte_bpe_50k.json")) == bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))


def test_added_tokens_in_a_text(spark):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x  <|endoftext|>  \n<|endoftext", "<|endoftext|>" * 3000, "no token"]
    rows = packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), P.path("byte_bpe_50k.json"), P.PATTERN).collect()
    want = []
    for d, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, packing.END], "<u4")
        want += [(d, *r) for r in packing._piece_rows(ids, packing.CAPACITY)]
    assert sorted(tuple(r) for r in rows) == sorted(want)
    assert tokenizer.encode(texts[0], add_special_tokens=False).ids == [64, 220, 50256, 275]


def most_in_a_later_group(monkeypatch, spark, lengths, **sizes):
    """Result of pack(), and for each round how many pieces its largest group leaves for the next."""
    cut = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], packing.PIECE)
    staged = []
    write = packing.stage
    monkeypatch.setattr(packing, "stage", lambda df, name: staged.append((name, write(df, name))) or staged[-1][1])
    rows = packing.pack(cut, **sizes).collect()
    most = [df.where("length IS NOT NULL").groupBy("grp").count().agg({"count": "max"}).first()[0] for name, df in staged if name.startswith("packed-") and name != "packed-0"]
    fill = defaultdict(int)
    for r in rows:
        assert r.offset == fill[r.sequence_id] or len(set(lengths)) > 1
        fill[r.sequence_id] += r.length
    assert sorted((r.doc_id, r.length) for r in rows) == list(enumerate(lengths)) and max(fill.values()) <= packing.CAPACITY
    return len(fill), most


def test_pieces_that_share_no_bin_stay_where_they_are(spark, monkeypatch):
    bins, most = most_in_a_later_group(monkeypatch, spark, [1100] * 900, per_partition=60, fan=4)
    assert bins == 900 and most == []


def test_certified_partitions_close_at_once(spark, monkeypatch):
    """Two pieces of 700 fill a bin as far as any can, so the bound is met; only the odd piece of a partition goes on."""
    bins, most = most_in_a_later_group(monkeypatch, spark, [700] * 900, per_partition=100, fan=4)
    assert bins == 450 and max(most, default=0) <= 4


@pytest.mark.parametrize("sizes", [(1, 900), (600, 1100)])
def test_groups_of_open_pieces_are_bounded_and_rounds_go_on(spark, monkeypatch, sizes):
    """The smaller the groups, the fewer pieces meet, but rounds never end early and no packing gets worse than without them."""
    lengths = np.random.default_rng(3).integers(*sizes, 3000).tolist()
    least = packing.lower_bound(np.bincount(lengths, minlength=packing.CAPACITY + 1), packing.CAPACITY)
    alone = packing.pack(spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], packing.PIECE), per_partition=3000)
    best = alone.select("sequence_id").distinct().count()
    for open_pieces in (100_000, 160, 40):
        bins, most = most_in_a_later_group(monkeypatch, spark, lengths, per_partition=60, fan=4, open_pieces=open_pieces)
        assert len(most) == 3 and max(most) <= max(open_pieces, 160) and least <= bins <= best + 8


def test_certificate(spark):
    cut = spark.createDataFrame([(i, 0, 0, 1500, i) for i in range(5)], packing.PIECE)
    assert packing.certificate(packing.pack(cut)).first() == (5, 5, 0)


@pytest.mark.parametrize("text", ["ab" * 100_000, "abc" * 66_000, "ACGT" * 50_000, "xab" * 60_000, "a" * 200_000, "é" * 100_000, "x" * 513 + " " + "ab" * 300 + " the end"])
def test_repetitive_words_take_time_in_proportion(text):
    encoder = bpe.Encoder(bpe.read_ranks(RANKS), P.PATTERN)
    encoder.slice(["warm up " + "x" * 600])
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    began = time.perf_counter()
    ids, _ = encoder.slice([text])
    assert time.perf_counter() - began < 5
    assert ids.tolist() == own.encode_ordinary(text)


def test_white_space_without_end_can_be_packed(spark):
    docs = spark.createDataFrame([(1, " \n" * 1_000_000), (2, "\n" * 1_500_000 + "end")], "doc_id long, text string")
    cut = packing.pieces(docs, P.path("byte_bpe_50k.json"), P.PATTERN)
    assert cut.groupBy("doc_id").count().count() == 2

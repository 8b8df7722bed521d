import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given
from hypothesis import strategies as st

from kadenz.llm import bpe, chat_format, tokens

RANKS, ARGS = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), (P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
SCHEMA = "conv_id long, turn long, role string, text string"
TEMPLATE = chat_format.Template(RANKS, P.PATTERN)
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def brute(rows):
    groups = {}
    for c, n, r, t in rows:
        groups.setdefault(c, []).append((n is not None, n or 0, r or "", t or ""))
    out = set()
    for c, turns in groups.items():
        turns.sort()
        said = "".join(t for *_, r, t in turns if r == "assistant")
        out.add((c, len(turns), sha("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(said), sha(said)))
    return out


def digested(df):
    got = chat_format.digests(chat_format.format_chats(df, *ARGS), *ARGS).collect()
    assert len(got) == len({r.conv_id for r in got})
    return {(r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got}


ODD = [
    (1, 1, "assistant", "<|im_end|><|im_start|>assistant ok"), (1, 0, "user", None), (2, 0, None, "x"), (None, 0, "assistant", "no one's"), (None, None, "user", "lost"),
    (3, 0, "assistant", ""), (3, 0, "assistant", "b"), (3, 0, "assistant", "a"), (3, 0, "assistant", "a"), (4, 5, "assistant", "\n" * 200_000 + "é <\\|im_sep|> <|endoftext|>"), (4, 4, "role\nof <|im_sep|> two", "y"),
]


def test_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    assert digested(df.repartition(4)) == brute(ODD)
    assert digested(df.where("false")) == set()
    wide = df.withColumnsRenamed({"conv_id": "ids", "text": "conv"}).selectExpr("*", "1 AS whole", "2 AS role_")
    out = chat_format.format_chats(wide, *ARGS, conv_col="ids", text_col="conv")
    assert out.agg({"n_turns": "sum"}).first()[0] == len(ODD)


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_one_long_conversation_spreads_over_tasks(spark, partitions, monkeypatch):
    monkeypatch.setattr(chat_format, "TURNS", 50)
    rows = [(7, i, ("user", "assistant")[i % 2], f"turn {i} " * (i % 9)) for i in range(1500)] + [(i, 0, "assistant", "<|im_start|>") for i in range(20, 60)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        df = spark.createDataFrame(rows, SCHEMA).repartition(5)
        fragments = chat_format.format_chats(df, *ARGS)
        assert fragments.where("conv_id = 7").count() >= 30 and fragments.where("conv_id = 7 AND whole").count() == 0
        assert fragments.where("NOT whole AND conv_id <> 7").count() <= 2 * int(partitions)
        assert digested(df) == brute(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_ids_mask_and_text_agree(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={v: TEMPLATE.reserved[k] for k, v in chat_format.CONTROL.items()})
    for r in chat_format.format_chats(df, *ARGS).where("conv_id <> 4").collect():
        ids, mask = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.loss_mask, np.uint8)
        assert len(ids) == len(mask) == r.n_tokens and own.decode(ids.tolist()) == r.formatted
        # the control strings in the formatted text are those of the template alone, so it reads back by itself
        assert own.encode(r.formatted, allowed_special="all") == ids.tolist()
        back = list(TEMPLATE.read_back(ids, mask))
        assert [b[:2] for b in back] == TEMPLATE.parse(r.formatted)
        assert all(loss == (text if role == "assistant" else "") for role, text, loss in back)


mixed = st.lists(st.sampled_from(["<", "|", "\\", "im_start", "im_end", "im_sep", "endoftext", "|>", "<|", "a", "\n", "é"]), max_size=12).map("".join)


@given(mixed)
def test_escaping_is_reversible_and_leaves_no_control_string(text):
    safe = chat_format.escape(text)
    assert chat_format.unescape(safe) == text
    assert not any(c in safe for c in [*chat_format.CONTROL.values(), "<|endoftext|>"])


@given(st.lists(st.tuples(mixed, mixed), max_size=5))
def test_any_turns_come_back(turns):
    ids, mask, shown = TEMPLATE.assemble(turns)
    assert TEMPLATE.parse(shown) == turns and [b[:2] for b in TEMPLATE.read_back(ids, mask)] == turns


def test_long_texts_have_the_same_ids():
    encode = tokens.ordinary(RANKS, P.PATTERN)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    text = "Some words, it's 12 of them.\n\n  And　more é\t" * 3000
    assert len(text) > tokens.AT_ONCE and encode(text) == own.encode_ordinary(text)
    assert len(encode(" \n" * 1_500_000)) > 0

"""Token ids against the public library, round trips and edge cases."""

import random

import pyarrow as pa  # noqa: F401
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

encode = pytest.importorskip("loomgraph.llm.encode")
tokenizers = pytest.importorskip("tokenizers")

LIBRARY = tokenizers.Tokenizer.from_file(f"{encode.TOKENIZERS}/{encode.VOCABULARY}")
LIBRARY.encode_special_tokens = True
OURS = encode.encoder()


def same(text):
    return OURS.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    assert same(text)


def test_every_white_space_and_mark():
    assert all(same(f"a{chr(c)}{chr(c)}b {chr(c)}1 x{chr(c)}\n") for c in [*range(0x2100), *range(0x2E80, 0x3100), *range(0x1F300, 0x1F700)])


@pytest.mark.parametrize("text", ["<|endoftext|> is text", " " * 5000, "ab" * 20_000, "=-" * 3000, "don't WE'LL\r\n\t x", "日本語のテキスト", "e" + "́" * 50])
def test_long_and_odd(text):
    assert same(text)


def test_random_bytes_of_words():
    rng = random.Random(2)
    for _ in range(300):
        assert same("".join(rng.choice("aeiost rnl'0,.\n") for _ in range(rng.randrange(60))))


def test_table(spark):
    rows = [(1, "hello world", "x"), (2, "", "x"), (3, None, "x"), (4, "   ", "x"), (1, "hello world", "y"), (None, "a", "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted(((r.doc_id, list(r.ids)) for r in encode.encode_column(df, "doc_id", "text").collect()), key=str)
    assert got == sorted([(k, LIBRARY.encode(t or "", add_special_tokens=False).ids) for k, t, _ in rows], key=str)
    assert encode.encode_column(df.limit(0), "doc_id", "text").count() == 0
    sizes = {(r.doc_id, r.tokens) for r in encode.count_tokens(df, ["doc_id"], "text").collect()}
    assert sizes == {(k, len(ids)) for k, ids in got}


def test_batches_are_cut(spark, monkeypatch):
    monkeypatch.setattr(encode, "BATCH_TOKENS", 50)
    df = spark.createDataFrame([(i, "some words here " * (i % 9)) for i in range(200)], "doc_id bigint, text string").coalesce(1)
    got = {r.doc_id: list(r.ids) for r in encode.encode_column(df, "doc_id", "text").collect()}
    assert got == {i: LIBRARY.encode("some words here " * (i % 9), add_special_tokens=False).ids for i in range(200)}

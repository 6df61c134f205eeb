"""Byte-level BPE against the tiktoken library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from veilframe.llm.bytepairs import BytePairs, PerfectHash, Strings, decode_ids, encode_texts, merged, read_ranks

SF = "/root/testdata/sf0.001"
RANKS = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
THEIRS = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return BytePairs(RANKS, public_tokenizers.PATTERN)


def strings(items):
    lengths = np.array([len(x) for x in items], np.int64)
    return Strings(b"".join(items), np.cumsum(lengths) - lengths, lengths)


@pytest.mark.parametrize("count", [0, 1, 2, 3, 50, 5000])
def test_perfect_hash(count):
    random.seed(count)
    keys = list({random.randbytes(random.randint(1, 40)) for _ in range(count)}) + ([b""] if count > 2 else [])
    hashed = PerfectHash.of(keys)
    assert sorted(hashed.order.tolist()) == list(range(len(keys)))  # as many slots as keys
    assert hashed.find(strings(keys)).tolist() == list(range(len(keys)))
    others = [k + b"x" for k in keys if k + b"x" not in keys] + [bytes(200), b"\0"]
    assert (hashed.find(strings(others)) == -1).all()


def test_zero_bytes_are_told_apart():
    keys = [b"a", b"a\0", b"a\0\0", b"12345678", b"12345678\0"]
    assert PerfectHash.of(keys).find(strings([*keys, b"a\0\0\0"])).tolist() == [0, 1, 2, 3, 4, -1]


def test_merged_takes_the_leftmost_of_equal_rank():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 300, b"aaa": 301, b"ab": 302}
    assert merged(b"aaaaa", ranks) == [300, 301]
    assert merged(b"aab", ranks) == [300, 98]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=60), max_size=5))
def test_any_text(codec, texts):
    got = codec.encode(texts)
    assert [g.tolist() for g in got] == [THEIRS.encode_ordinary(t) for t in texts]
    assert [codec.decode(g) for g in got] == [t.encode() for t in texts]


def test_every_space_and_mark(codec):
    texts = [f"a{c}{c}b {c}1{c} {c}" for c in map(chr, [*range(0x400), 0x1680, *range(0x2000, 0x2100), 0x3000, 0xFEFF, 0x1F600])]
    assert [g.tolist() for g in codec.encode(texts)] == [THEIRS.encode_ordinary(t) for t in texts]


def test_long_pretokens(codec):
    random.seed(1)
    texts = ["ab" * 50_000, "".join(random.choices("etaoin", k=100_000)), " " * 50_000 + "x", "ä" * 10_000, "don't " * 400_000]
    assert [g.tolist() for g in codec.encode(texts)] == [THEIRS.encode_ordinary(t) for t in texts]


def test_pattern_that_leaves_characters_out():
    own = BytePairs(RANKS, r"\p{L}+")
    theirs = tiktoken.Encoding("own", pat_str=r"\p{L}+", mergeable_ranks=RANKS, special_tokens={})
    text = "one, two éé\n3 four"
    assert own.encode([text])[0].tolist() == theirs.encode_ordinary(text)


def test_vocabulary_without_all_bytes():
    with pytest.raises(ValueError, match="255 single bytes"):
        BytePairs({b"a": 0}, r".")


def test_odd_rows(spark, codec):
    rows = [(1, "a b"), (1, "a b"), (None, "x"), (2, None), (3, ""), (4, "<|endoftext|>")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "9 as ids", "'y' as n_tokens")
    got = decode_ids(encode_texts(df, codec), codec).collect()
    want = [(i, len(e), np.array(e, "<u4").tobytes(), (t or "").encode()) for i, t in rows for e in [THEIRS.encode_ordinary(t or "")]]
    assert sorted(map(repr, ((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in got))) == sorted(map(repr, want))
    assert encode_texts(df.limit(0), codec).count() == 0
    assert decode_ids(spark.sql("select cast(null as binary) ids, 1 decoded"), codec).first().decoded is None


def test_given_table(spark):
    from veilframe.llm.queries import QUERIES

    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = set()
    for r in rows:
        ids = THEIRS.encode_ordinary(r.text or "")
        want.add((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert {tuple(r) for r in QUERIES["op12_bytepairs"](spark, SF).collect()} == want

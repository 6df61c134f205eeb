import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from veilframe.llm.packing import WordTokenizer, cost, pack, pack_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", "a  b", " a b ", "x\n y", "a \nb", "<|endoftext|> hi", "don't  \n\n stop", "é è  b", "a b  c", "\x1c x", "日本語 テキスト 🎉",
    "word " * 3000, "x" * 9000, "A\tb c\r\nd e", "one", " ", "\n", "I'll we've",
]


def test_ids_are_those_of_the_library():
    plain = Tokenizer.from_file(PATH)
    got = WordTokenizer(PATH).encode(TEXTS)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in TEXTS]


def test_sequences_hold_every_token_once_and_are_full():
    rng = random.Random(1)
    for _ in range(300):
        sizes = [rng.choice([0, 1, 2, 5, 9, 10, 11, 30, 77]) for _ in range(rng.randrange(40))]
        sequences = pack(sizes, 10)
        assert len(sequences) == -(-sum(sizes) // 10)
        assert sum(s.used < 10 for s in sequences) <= 1
        held = sorted((d, start + k) for s in sequences for d, start, length, _ in s.pieces for k in range(length))
        assert held == [(d, k) for d, size in enumerate(sizes) for k in range(size)]
        for s in sequences:
            assert [p[3] for p in s.pieces] == [sum(p[2] for p in s.pieces[:i]) for i in range(len(s.pieces))]
            assert abs(s.price - sum(cost(p[2]) for p in s.pieces)) < 1e-9


def test_cost_is_spread_better_than_in_order():
    rng = random.Random(2)
    sizes = [rng.randrange(20, 1500) for _ in range(600)]
    prices = [s.price for s in pack(sizes)][:-1]
    in_order, room = [0.0], 2048
    for size in sizes:
        while size:
            part = min(size, room)
            in_order[-1] += cost(part)
            size, room = size - part, room - part
            if not room:
                in_order.append(0.0)
                room = 2048
    assert np.std(prices) < np.std(in_order[:-1])


def test_rows(spark):
    texts = [*TEXTS, None]
    rows = [(i if i != 3 else None, t, 5) for i, t in enumerate(texts)] + [(0, "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(3)
    got = pack_documents(docs, PATH).toPandas()
    plain = Tokenizer.from_file(PATH)
    ids = {i if i != 3 else None: [*plain.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    assert got["length"].sum() == sum(map(len, ids.values())) + 1
    assert set(map(len, [p for p in ids.values()])) == set(got["doc_tokens"])
    for r in got.itertuples():
        own = ids[None if np.isnan(r.doc_id) else int(r.doc_id)]
        assert r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]] and s["length"].sum() <= 2048


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_words_behind_line_ends_are_kept_as_others_are():
    """They were encoded anew in each batch, together with the word before them."""
    tokenizer = WordTokenizer(PATH)
    texts = ["one two\nthree four", "five two\nthree", "a)\n(b 12\n13 x", "a\n\nb c\nd", "é\nè it's\n's", "x.\n.y ,\n, z"]
    want = [np.array(tokenizer.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert tokenizer.encode(texts) == want == tokenizer.encode(texts)
    assert "\nthree" in tokenizer.known and "two\nthree" not in tokenizer.known

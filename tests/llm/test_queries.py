"""The registered queries over the smallest tables against plain Python."""

import zlib

import numpy as np
import pytest

from veilframe.llm.queries import ORACLES, QUERIES

from .test_disclosure import plain as plain_spans
from .test_packing import PATH
from .test_ppm import plain_base
from .test_repetition import plain as plain_rules
from .test_simhash import plain_fingerprint, plain_roots
from .test_substring import plain as plain_windows
from .test_substring import rows_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def fold(doc, parts):
    return zlib.crc32(str(doc).encode()) % parts


def test_op2(spark, rows):
    short = {i: t for i, t in rows if len(t or "") < 4000}
    got = {r.doc_id: tuple(r) for r in QUERIES["op2_repetition"](spark, SF).collect()}
    assert len(got) == len(rows) and all(got[i] == (i, *plain_rules(t)) for i, t in short.items())


def test_op4(spark, rows):
    assert rows_of(QUERIES["op4_substring"](spark, SF)) == plain_windows(rows)


def test_op4_sql(rows):
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(db.execute(ORACLES["op4_substring"]).fetchall()) == sorted(plain_windows(rows))


def test_op5(spark, rows):
    import hashlib

    got = {r.doc_id: r for r in QUERIES["op5_private"](spark, SF).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        base = plain_spans(t)
        signs = [f"{k}:{s}:{e}" for k, s, e in base]
        counts = tuple(sum(k == kind for k, _, _ in base) for kind in ("email", "ip", "card", "phone"))
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == counts
        assert r.base_sha256 == hashlib.sha256(",".join(signs).encode()).hexdigest()
        assert set(signs) <= set(r.spans.split(","))


def test_op6(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in vectors]), np.array([r.embedding for r in vectors], float)
    got = QUERIES["op6_neighbours"](spark, SF).toPandas()
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = (x * x[q]).sum(1)
        score[q] = -np.inf
        best = ids[np.lexsort((ids, -score))[:20]]
        own = got[got["query_id"] == ids[q]].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and (np.diff(own["score"]) <= 0).all()
        hits += len(set(best) & set(own["vec_id"]))
    assert hits >= 0.9 * len(got)


def test_op7(spark, rows):
    prints = {i: plain_fingerprint(t) for i, t in rows}
    roots = plain_roots(prints.values(), 4)
    first = {}
    for i in sorted(prints):
        first.setdefault(roots[prints[i]], i)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op7_simhash"](spark, SF).collect()}
    assert got == {i: (f"{f:016x}", first[roots[f]]) for i, f in prints.items()}


def test_op8(spark, rows):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    got = QUERIES["op8_packing"](spark, SF).toPandas()
    sizes = {i: len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in rows}
    assert got.groupby("doc_id")["length"].sum().to_dict() == sizes
    assert got["sequence_id"].nunique() == -(-sum(sizes.values()) // 2048)


def test_op9(spark, rows):
    got = {r.doc_id: r for r in QUERIES["op9_ppm"](spark, SF).collect()}
    for (i, _), (n, known, total, base) in zip(rows, plain_base(rows), strict=True):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(i, 5) == 1, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)


def test_op1_op3_op10_cover_every_row(spark, rows):
    ids = sorted(i for i, _ in rows)
    op1 = QUERIES["op1_toxicity"](spark, SF).collect()
    assert sorted(r.doc_id for r in op1) == ids and all(r.held_out == (fold(r.doc_id, 5) == 0) and r.predicted == (r.score >= 0.5) for r in op1)
    op3 = QUERIES["op3_sentencepieces"](spark, SF).collect()
    assert sorted(r.doc_id for r in op3) == ids and all(r.parity for r in op3)
    op10 = QUERIES["op10_language"](spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in op10 if r.held_out]
    assert sorted(r.doc_id for r in op10) == ids and all(r.held_out == (fold(r.doc_id, 4) == 2) for r in op10)
    assert sum(r.lang_pred in (lang[r.doc_id], "und") for r in held) >= 0.95 * len(held)

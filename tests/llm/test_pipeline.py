import corpus_pipeline
from __spark_entry__ import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert "pipeline" in names and set(oracle_sql()) <= set(names)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), docs.schema)
        assert docs.columns == columns, name
        assert docs.filter("n_chars <> length(text)").count() == 0
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[2] == seen[-1]


def test_run(spark):
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert got["length"].sum() == got.drop_duplicates("doc_id")["doc_tokens"].sum()
    assert (got.groupby("sequence_id")["length"].sum() <= 2048).all()


def test_stages_take_odd_tables(spark):
    rows = [(1, None, "en"), (None, "some text", "en"), (2, "", None), (3, "b " * 3000, "xx"), (3, "b " * 3000, "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for frame in (docs, docs.limit(0)):
        now = frame
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SF)
        now.collect()

"""Files, tables on disk, admission, sinks, streams."""

import json

import pytest
from pyspark.sql import functions as F

from veilframe.functions.sql import expr
from veilframe.operators.anonymize import anonymize_docs
from veilframe.operators.tables import anonymize_nested, anonymize_table, pseudonymize_table
from veilframe.plans.queries import _write_each
from veilframe.sources.files import anonymize_files
from veilframe.sources.formats import admit, admitted, detect_format, rejected
from veilframe.sources.readers import json_text, read_checked_docs, read_csv_table, read_files, read_json_docs, read_text_docs
from veilframe.sources.sinks import write_result
from veilframe.streaming.stream import anonymize_stream, pseudonymize_batches

CSV = "nombre,email\nJuan Perez,juan@acme.com\nAna,ana@x.com\n"


def files(spark, **contents):
    rows = [(f"/in/{k.replace('_', '.')}", v if isinstance(v, bytes) else v.encode()) for k, v in contents.items()]
    return spark.createDataFrame(rows, "path string, content binary")


def rewritten(spark, mode="pseudo", rules=None, **contents):
    done = anonymize_files(files(spark, **contents), mode, rules=rules, hash_key=b"k")
    return {r.path[4:]: r for r in done.accepted.collect()}


def test_csv_keeps_its_shape(spark):
    row = rewritten(spark, a_csv=CSV)["a.csv"]
    assert row.content == "nombre,email\nJuan Perez,«EMAIL_1»\nAna,«EMAIL_2»\n"
    assert row.format == "csv" and row.map == {"«EMAIL_1»": "juan@acme.com", "«EMAIL_2»": "ana@x.com"}
    assert row.summary == {"EMAIL": 2} and row.reversible


def test_csv_quoting_ragged_rows_and_blank_cells(spark):
    content = 'a,"x, juan@acme.com ""q""",\n\none\n" ","line\nbreak 10.0.0.1",b,c\n'
    row = rewritten(spark, a_csv=content)["a.csv"]
    assert row.content == 'a,"x, «EMAIL_1» ""q""",\n\none\n ,"line\nbreak «IP_1»",b,c\n'


def test_json_values_change_and_keys_do_not(spark):
    content = '{"user@x.com":{"email":"a@b.com"},"items":[1,2.50,null,true],"t":["a@b.com","ñ \\u00e9 \\"q\\""],"z":1}'
    row = rewritten(spark, a_json=content)["a.json"]
    data = {"user@x.com": {"email": "«EMAIL_1»"}, "items": [1, 2.5, None, True], "t": ["«EMAIL_1»", 'ñ é "q"'], "z": 1}
    assert row.content == json.dumps(data, ensure_ascii=False, indent=2)


def test_markup_is_text_and_blank_files_stay(spark):
    rows = rewritten(spark, "typed", a_html="<p>a@b.com</p>", b_md=" \n ", c="x\ny@z.com", d_log="")
    assert {k: r.content for k, r in rows.items()} == {"a.html": "<p>[EMAIL]</p>", "b.md": " \n ", "c": "x\n[EMAIL]", "d.log": ""}
    assert rows["c"].format == "txt"


def test_files_with_rules_and_hash(spark):
    rules = {"always": ["Juan"], "patterns": [{"regex": r"(?<=A)na", "placeholder": "X"}]}
    row = rewritten(spark, "typed", rules, a_csv=CSV)["a.csv"]
    assert row.content == "nombre,email\n[DATO] Perez,[EMAIL]\nA[X],[EMAIL]\n"
    assert rewritten(spark, "hash", a_csv=CSV)["a.csv"].content.count("«EMAIL_") == 2


def test_rejected_files(spark):
    given = files(spark, a_txt=bytes.fromhex("fffe0001"), b_txt="x" * 11, c_json="{no", d_csv="a", e_json='{"a": "b"}')
    done = anonymize_files(given, "typed", max_chars=10)
    assert {r.path[4:]: r.reason for r in done.rejected.collect()} == {"a.txt": "encoding", "b.txt": "size", "c.json": "json"}
    assert sorted(r.path[4:] for r in done.accepted.collect()) == ["d.csv", "e.json"]
    with pytest.raises(ValueError):
        anonymize_files(given, "nope")
    with pytest.raises(ValueError):
        anonymize_files(given, rules="{no-json")


def test_admit(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "abcdef"), (3, None), (4, "😀" * 4)], "id int, text string")
    checked = admit(df, max_chars=4)
    assert sorted(r.id for r in admitted(checked).collect()) == [1, 3, 4]
    assert [(r.id, r.reason) for r in rejected(checked).collect()] == [(2, "size")]


def test_detect_format(spark):
    names = ["a.CSV", "a.tar.json", "a", "a.", "a.pdf", ".md"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(expr(detect_format("n"))).collect()] == ["csv", "json", "txt", "txt", "txt", "md"]


def test_files_on_disk(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.csv").write_text(CSV)
    (tmp_path / "b.txt").write_text("juan@\nacme.com y ana@x.com")
    done = anonymize_files(read_files(spark, str(tmp_path)), "typed").accepted
    assert {r.format: r.content for r in done.collect()} == {
        "csv": "nombre,email\nJuan Perez,[EMAIL]\nAna,[EMAIL]\n",
        "txt": "juan@\nacme.com y [EMAIL]",
    }
    docs = read_text_docs(spark, str(tmp_path / "*.txt"))
    assert docs.count() == 1 and "\n" in docs.first().text


def test_csv_table_on_disk(spark, tmp_path):
    (tmp_path / "a.csv").write_text('nombre,email\n"Pe, ""P""",juan@acme.com\n,x\nuno\na,b@x.com,c@x.com\n')
    (tmp_path / "b.csv").write_text("ana,ana@x.com\nJuan,juan@acme.com\n")
    read = read_csv_table(spark, str(tmp_path), 2)
    assert [r.raw for r in read.rejected.collect()] == ["a,b@x.com,c@x.com"]
    rows = read.rows.orderBy("path", "row").collect()
    assert [(r.c0, r.c1) for r in rows][:4] == [("nombre", "email"), ('Pe, "P"', "juan@acme.com"), (None, "x"), ("uno", None)]
    assert len({(r.path, r.row) for r in rows}) == len(rows) == 6
    done = anonymize_table(read.rows, "pseudo", columns=["c0", "c1"], scope=["path"], order_by=["path", "row"])
    got = [r.c1 for r in done.data.orderBy("path", "row").collect()]
    assert got == ["email", "«EMAIL_1»", "x", None, "«EMAIL_1»", "«EMAIL_2»"]


def test_json_lines_on_disk(spark, tmp_path):
    lost = ['{bad', '{"user":{"email":"a@b.com","phone":"1"}}', '{"user":"z@z.com"}', '{"extra":1}', '{"items":["1"]}']
    (tmp_path / "a.jsonl").write_text('{"user":{"email":"a@b.com"},"items":[1,2,3],"n":null}\n\n' + "\n".join(lost) + "\n")
    read = read_json_docs(spark, str(tmp_path), "user struct<email:string>, items array<int>, n string")
    assert sorted(r.raw for r in read.rejected.collect()) == sorted(lost)
    done = anonymize_nested(read.rows, ["value"], "pseudo", scope="row", order_by=["path"]).data
    text = done.select(json_text("value").alias("j")).first().j
    assert text == '{"user":{"email":"«EMAIL_1»"},"items":[1,2,3],"n":null}'
    assert done.columns == ["path", "value"]


def test_a_long_cell_and_a_long_file(spark):
    cell = "x" * 200_000 + " a@b.com"
    files = [("a.csv", bytearray(f"k,{cell}\n".encode())), ("b.txt", bytearray(("word " * 150_000 + "a@b.com").encode()))]
    done = anonymize_files(spark.createDataFrame(files, "path string, content binary"), "typed")
    assert done.rejected.count() == 0
    assert {r.content[-9:].strip() for r in done.accepted.collect()} == {"[EMAIL]", "d [EMAIL]"}


def test_results_are_written_apart(spark, tmp_path):
    df = spark.createDataFrame([(1, "g", "a@b.com"), (2, "h", "nada")], "id int, file string, t string")
    done = pseudonymize_table(df, columns=["t"], order_by=["id"], scope=["file"])
    where = [str(tmp_path / name) for name in ("data", "map", "summary")]
    write_result(done, *where, partition_by=["file"])
    assert [r.t for r in spark.read.parquet(where[0]).orderBy("id").collect()] == ["«EMAIL_1»", "nada"]
    assert spark.read.parquet(where[1]).first().original == "a@b.com"
    assert spark.read.parquet(where[2]).first().n == 1
    with pytest.raises(ValueError):
        write_result(done, where[0], where[0] + "/map", where[2])
    with pytest.raises(ValueError):
        write_result(done, where[1] + "//data", where[1], where[2])
    write_result(done, where[0] + "2", where[0] + "2_map", where[2] + "2")


@pytest.mark.parametrize("mode", ["typed", "pseudo", "hash"])
def test_stream_equals_batch(spark, tmp_path, mode):
    rows = [(i, f"u{i % 5}@x.com y 10.0.0.{i}") for i in range(40)]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "doc_id int, text string").repartition(4).write.parquet(source)
    stream = spark.readStream.schema("doc_id int, text string").option("maxFilesPerTrigger", 1).parquet(source)
    done = anonymize_stream(stream, mode, hash_key=b"k").select("doc_id", "output")
    writer = done.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
    writer.start(str(tmp_path / "out"), format="parquet").awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("doc_id").collect()
    batch = anonymize_docs(spark.read.parquet(source), mode, hash_key=b"k").select("doc_id", "output").orderBy("doc_id")
    assert got == batch.collect()
    with pytest.raises(ValueError):
        anonymize_stream(spark.read.parquet(source))


def test_stream_of_pseudonyms_is_consistent_over_batches(spark, tmp_path):
    tokens, out = str(tmp_path / "tokens"), {}

    def sink(df, batch_id):
        out[batch_id] = {r.doc_id: r.output for r in df.collect()}

    run = pseudonymize_batches(tokens, sink, key=["doc_id"])
    batches = [
        spark.createDataFrame(rows, "doc_id int, text string")
        for rows in ([(1, "b@x.com a@x.com"), (2, "a@x.com 10.0.0.1")], [(3, "c@x.com b@x.com"), (4, "nada"), (5, None)], [])
    ]
    for i, batch in enumerate(batches):
        run(batch, i)
    assert out[0] == {1: "«EMAIL_1» «EMAIL_2»", 2: "«EMAIL_2» «IP_1»"}
    assert out[1] == {3: "«EMAIL_3» «EMAIL_1»", 4: "nada", 5: None}
    run(batches[1], 1)  # a batch that is run again
    assert out[1] == {3: "«EMAIL_3» «EMAIL_1»", 4: "nada", 5: None}
    values = spark.read.parquet(tokens)
    assert values.count() == values.select("value").distinct().count() == 4
    assert values.select(F.countDistinct("token")).first()[0] == 4


def test_row_scope_is_detected_once_for_all_three_outputs(spark, tmp_path):
    rows = [(1, "mail a@x.com and a@x.com", "b@y.org"), (2, "nothing", None), (None, "c@z.net", "")]
    df = spark.createDataFrame(rows, "id long, note string, memo string")
    done = anonymize_table(df, "pseudo", scope="row", order_by=["id"])
    plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in done.split(spark.createDataFrame([], done.combined.schema))]
    assert not any("regexp" in p for p in plans) and "regexp" in done.combined._jdf.queryExecution().optimizedPlan().toString()
    paths = [str(tmp_path / x) for x in ("data", "map", "summary")]
    write_result(done, *paths)
    data, mapping, summary = ({tuple(r) for r in spark.read.parquet(p).collect()} for p in paths)
    assert data == {(1, "mail «EMAIL_1» and «EMAIL_1»", "«EMAIL_2»"), (2, "nothing", None), (None, "«EMAIL_1»", "")}
    assert mapping == {(1, "«EMAIL_1»", "a@x.com"), (1, "«EMAIL_2»", "b@y.org"), (None, "«EMAIL_1»", "c@z.net")}
    assert summary == {(1, "EMAIL", 3), (None, "EMAIL", 1)}
    assert not (tmp_path / "map_work").exists()


def test_files_that_are_no_text_are_rejected(spark, tmp_path):
    contents = {"a.txt": "café a@x.com\nb".encode(), "b.txt": b"\xff\xfe\x00\x01", "c.txt": b"x" * 50, "d.txt": "é".encode("latin-1"), "e.txt": b""}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    read = read_checked_docs(spark, str(tmp_path), max_chars=20)
    assert {r.path[-5:]: r.text for r in read.rows.collect() if r.text} == {"a.txt": "café a@x.com\nb"}
    bad = {r.path[-5:]: (bytes(r.content), r.reason) for r in read.rejected.collect()}
    assert bad == {"b.txt": (contents["b.txt"], "encoding"), "c.txt": (contents["c.txt"], "size"), "d.txt": (contents["d.txt"], "encoding")}
    assert read_checked_docs(spark, str(tmp_path / "c*")).rejected.count() == 0


def test_files_are_written_with_the_map_apart(spark, tmp_path):
    from veilframe.sources.sinks import write_files

    raw = [("a.txt", b"de a@b.com y a@b.com"), ("b.json", b'{"x": "c@d.com"}'), ("c.csv", b"k,a@b.com\n"), ("d.json", b"{bad"), ("e.bin", b"x"), ("f.txt", b"nada"), ("g.txt", b"")]
    files = spark.createDataFrame([(p, bytearray(c)) for p, c in raw], "path string, content binary")
    done = anonymize_files(files, "pseudo")
    where = [str(tmp_path / name) for name in ("data", "map", "summary", "rejected")]
    write_files(done, *where)
    data, mapping, summary, rejected = (spark.read.parquet(w) for w in where)
    want = {r.path: r.content for r in done.accepted.collect()}
    assert {r.path: r.content for r in data.collect()} == want and "map" not in data.columns
    assert {(r.path, r.token, r.original) for r in mapping.collect()} == {
        ("a.txt", "«EMAIL_1»", "a@b.com"), ("b.json", "«EMAIL_1»", "c@d.com"), ("c.csv", "«EMAIL_1»", "a@b.com")}
    assert {(r.path, r.label, r.n) for r in summary.collect()} == {("a.txt", "EMAIL", 2), ("b.json", "EMAIL", 1), ("c.csv", "EMAIL", 1)}
    assert {r.path for r in rejected.collect()} == {p for p, _ in raw} - set(want)
    assert not (tmp_path / "map_work").exists()
    with pytest.raises(ValueError):
        write_files(done, where[1] + "/data", *where[1:])
    with pytest.raises(ValueError):
        write_files(done, *where[:3], where[1] + "/rejected")


def test_one_file_each_is_written_by_many_tasks(spark, tmp_path):
    """A table of one partition would have one task write all its files."""
    rows = spark.range(60).select((F.col("id") % 50).alias("id"), F.concat(F.lit("t"), F.col("id") % 50).alias("text")).coalesce(1)
    _write_each(rows, str(tmp_path / "each"))
    files = [p for p in (tmp_path / "each").glob("id=*/*.txt")]
    assert len(files) == len({p.parent for p in files}) == 50  # rows of one id share a file
    assert len({p.name.split("-")[1] for p in files}) > 1
    read = read_text_docs(spark, f"{tmp_path}/each/*/*.txt")
    assert {(r.text, r.path.split("/")[-2]) for r in read.collect()} == {(f"t{i}\n" * (2 if i < 10 else 1), f"id={i}") for i in range(50)}


def test_json_lines_that_read_back_alike_are_not_compared_in_python(spark, tmp_path, monkeypatch):
    import pandas as pd
    from veilframe.sources import readers

    @F.pandas_udf("boolean")
    def only_others(left: pd.Series, right: pd.Series) -> pd.Series:
        assert not any(a == b for a, b in zip(left, right) if a is not None)
        return pd.Series([b is not None and "x" not in a for a, b in zip(left, right)])

    monkeypatch.setattr(readers, "same_json", only_others)
    (tmp_path / "a.json").write_text('{"id":1,"t":"a"}\n{"id":2,"t":null}\n{"t":"b","id":3}\n\n{"id":4,"x":1}\nno json x\n')
    read = readers.read_json_docs(spark, str(tmp_path), "id bigint, t string")
    assert sorted(r.value.id for r in read.rows.collect()) == [1, 2, 3]
    assert sorted(r.raw for r in read.rejected.collect()) == ["no json x", '{"id":4,"x":1}']

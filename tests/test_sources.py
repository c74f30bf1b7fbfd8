"""Readers, sinks, command line, streaming ingest."""

import pytest
from pyspark.sql import functions as F

from quillgrid import cli
from quillgrid.engine import Collection
from quillgrid.operators import indexes
from quillgrid.sources import books, store, tables
from quillgrid.streaming import ingest


def test_column_choice(spark):
    def chosen(ddl):
        return tables.infer_columns(spark.createDataFrame([], ddl).schema)

    assert chosen("doc_id long, text string") == ("text", "doc_id", None)
    assert chosen("id string, content string, title string") == ("content", "id", "title")
    assert chosen("a string, b string") == ("a", "b", None)
    assert chosen("text string, body string") == ("body", None, None)
    assert chosen("video long, text string") == ("text", "video", None)
    with pytest.raises(ValueError, match="No text column"):
        chosen("x long")


def test_rows_without_text_or_id(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (None, "b"), (None, "c")], "doc_id long, text string")
    rows = tables.read_table(df).collect()
    assert sorted(r.text for r in rows) == ["a", "b", "c"]
    assert len({r.doc for r in rows}) == 3 and {r.doc for r in rows} >= {"1"}
    odd = tables.read_table(spark.createDataFrame([(1.5, "x")], "id double, text string")).head()
    assert odd.doc.startswith("doc_")


def test_inspection(spark):
    df = spark.createDataFrame([(1, "é" * 80, 2.0)], "id long, text string, x double")
    assert [tuple(r) for r in tables.inspect_schema(df).collect()] == [(0, "id", "bigint"), (1, "text", "string"), (2, "x", "double")]
    row = tables.inspect_rows(df).head()
    assert row.asDict() == {"id": 1, "text": "é" * 80 + "..."} or row.text.endswith("...")


BOOK = "<?xml version='1.0' encoding='utf-8'?><FictionBook><title>outside words</title>%s</FictionBook>"


def test_body_texts():
    assert "".join(books.body_texts((BOOK % "<body>first part</body><x>no</x><body>second</body>").encode())) == "first partsecond"
    assert books.body_texts((BOOK % "<body>fo<b>o</b>bar</body>").encode()) == ["fo", "o", "bar"]
    assert books.body_texts((BOOK % "<body>some &nosuch; text</body>").encode()) is None
    assert books.body_texts(b"<a><body>kept words</body><broken") == ["kept words"]
    assert books.body_texts("<a><body>é</body></a>".encode("latin-1")) is None
    assert books.body_texts(b"<a><body>x<![CDATA[hidden]]><!-- c -->y &amp; z</body></a>") == ["x", "y & z"]


def test_books_end_to_end(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.fb2").write_text(BOOK % f"<body>red cat sat {'filler ' * 30}</body>")
    (tmp_path / "in/sub/b.fb2").write_text(BOOK % f"<body>кот red dog {'filler ' * 30}</body>")
    (tmp_path / "in/small.fb2").write_text("<a><body>tiny</body></a>")
    (tmp_path / "in/c.FB2").write_text("<a><body>other</body></a>" * 50)
    docs = books.read_books(spark, str(tmp_path / "in"), min_bytes=100)
    rows = {r.doc: r for r in docs.collect()}
    assert sorted(rows) == ["a.fb2", "b.fb2"] and rows["b.fb2"].words[:3] == ["кот", "red", "dog"]
    assert rows["a.fb2"].n_bytes == (tmp_path / "in/a.fb2").stat().st_size
    assert books.read_books(spark, str(tmp_path / "in")).count() == 0
    assert cli.main(["build", "-i", str(tmp_path / "in"), "-o", str(tmp_path / "out"), "--min-bytes", "100"], spark) == 0
    stored = Collection.open(spark, str(tmp_path / "out"))
    assert [r.doc for r in stored.search("red and not cat").collect()] == ["b.fb2"]
    assert stored.stats.head().collection_bytes == sum(r.n_bytes for r in rows.values())


def test_command_line_on_a_table(spark, tmp_path, capsys):
    path, out = "/root/testdata/sf0.001/documents.parquet", str(tmp_path / "out")
    assert cli.main(["parquet-inspect", "-i", path], spark) == 0
    assert "doc_id" in capsys.readouterr().out
    assert cli.main(["parquet-build", "-i", path, "-o", out, "--spimi"], spark) == 0
    assert cli.main(["search", "-q", "the and not that", "-d", out], spark) == 0
    said = capsys.readouterr().out
    count = Collection(tables.load_documents(spark, path)).search("the and not that").count()
    assert all(f"{index}: {count} documents" in said for index in ("matrix", "inverted", "coordinate"))
    assert cli.main(["search", "-q", "cat dog", "-d", out], spark) == 0
    assert "Unexpected 'dog'" in capsys.readouterr().out


def test_dictionary_sinks(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "red cat red"), ("d2", "cat sat")], "doc string, text string")
    c = Collection(docs)
    report = {r.format: r.bytes for r in store.compare_formats(c.dictionary, c.stats, str(tmp_path), ("text", "json", "binary", "nosuch")).collect()}
    assert set(report) == {"text", "json", "binary"} and all(report.values())
    lines = [r.value for r in spark.read.text(f"{tmp_path}/dictionary_text/part=1").collect()]
    assert lines == ["cat: 2 (docs: 2)", "red: 2 (docs: 1)", "sat: 1 (docs: 1)"]
    assert spark.read.json(f"{tmp_path}/dictionary_json").count() == 3
    from quillgrid.operators import sizes

    packed = [r.value for r in store.packed_report(c.dictionary, c.stats, sizes.packing_stats(c.packed), k=2).collect()]
    assert packed[:2] == ["Front-packed dictionary", "terms: 3"] and packed[-2:] == ["cat: 2", "red: 2"]


def test_document_numbers_by_rank(spark):
    names = ["10", "2", "1", "100", "é", "z", "", "1000", "11"]
    ids = indexes.doc_ids(spark.createDataFrame([(n,) for n in names * 2], "doc string")).collect()
    assert {r.doc: r.id for r in ids} == {n: i for i, n in enumerate(sorted(names, key=lambda n: n.encode()))}


def test_streaming_ingest_counts_each_batch_once(spark, tmp_path):
    folder, index, state = (str(tmp_path / x) for x in ("in", "index", "state"))
    schema = spark.createDataFrame([], "doc_id long, text string").schema
    spark.createDataFrame([(1, "red cat"), (2, "cat cat dog")], schema).write.parquet(folder)
    ingest.ingest(ingest.stream_documents(spark, folder, schema), index, state).awaitTermination()
    spark.createDataFrame([(3, "red dog dog")], schema).write.mode("append").parquet(folder)
    ingest.ingest(ingest.stream_documents(spark, folder, schema), index, state).awaitTermination()
    got = {r.term: (r.tf, r.df) for r in ingest.grown_dictionary(spark, index).collect()}
    assert got == {"red": (2, 2), "cat": (3, 2), "dog": (3, 2)}
    assert ingest.grown_coordinates(spark, index).where(F.col("term") == "cat").count() == 2

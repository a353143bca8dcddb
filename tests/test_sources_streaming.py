import datetime

from pyspark.sql import functions as F

from folioscope.operators.store import Table
from folioscope.sources import files
from folioscope.streaming import watch


def test_markdown(spark):
    text = "preamble\n\n# One\nbody 1\n\n## \nno heading above\n###\tTwo  \nbody 2\n####### seven\n# Last"
    df = spark.createDataFrame([(1, text), (2, "no heading"), (3, ""), (4, None), (5, "# only")], "doc_id bigint, text string")
    got = [(r.doc_id, r.section_order, r.heading, r.text) for r in files.markdown_sections(df).orderBy("doc_id", "section_order").collect()]
    assert got == [(1, 0, None, "preamble"), (1, 1, "One", "body 1\n\n## \nno heading above"), (1, 2, "Two", "body 2\n####### seven"), (1, 3, "Last", ""), (2, 0, None, "no heading"), (5, 0, "only", "")]


def test_items_become_sections(spark):
    items = spark.createDataFrame([("d", 0, "text", "pre", 1), ("d", 1, "section_header", "H", 1), ("d", 2, "text", "a", 2), ("d", 3, "text", "b", 3)], "doc_id string, n int, label string, text string, page int")
    got = [tuple(r) for r in files.items_to_sections(items).orderBy("section_order").collect()]
    assert got == [("d", 0, None, "pre", 1, 1), ("d", 1, "H", "a\nb", 1, 3)]


def test_scanning(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.MD").write_text("hello")
    (tmp_path / "a" / "y.log").write_text("no")
    (tmp_path / "skip").mkdir()
    (tmp_path / "skip" / "z.txt").write_text("no")
    rows = files.scan(spark, [str(tmp_path), "/does/not/exist"], ["*/skip/*"]).collect()
    assert len(rows) == 1 and rows[0].file_path.endswith("x.MD") and rows[0].file_type == "md" and rows[0].content_hash == "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"
    assert files.listing(spark, ["/does/not/exist"]).count() == 0
    broken = spark.createDataFrame([(bytearray(b"caf\xe9"),), (bytearray(b" \n"),), (bytearray("é".encode()),)], "content binary")
    assert [(r.text, r.error) for r in files.texts(broken).collect()] == [("café", None), (" \n", "no text"), ("é", None)]


def _events(spark, rows):
    t = datetime.datetime(2020, 1, 1)
    return spark.createDataFrame([(p, t + datetime.timedelta(seconds=s), k) for p, s, k in rows], "path string, ts timestamp, kind string")


def test_debounce(spark):
    df = _events(spark, [("a", 0, "created"), ("a", 1, "modified"), ("a", 4, "deleted"), ("b", 0, "created"), (None, 0, "x")])
    got = sorted((r.path, r.events, r.last_kind) for r in watch.debounced(df, "2 seconds").collect())
    assert got == [("a", 1, "deleted"), ("a", 2, "modified"), ("b", 1, "created")]


def test_streams_end_up_the_same_when_run_twice(spark, tmp_path):
    df = _events(spark, [("a", 0, "created"), ("a", 1, "modified"), ("b", 5, "created"), ("c", 9, "deleted")])
    df.repartition(3).write.parquet(f"file://{tmp_path}/in")
    feed = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    bursts = Table(spark, f"file://{tmp_path}/bursts", ["path", "started"])
    counts = Table(spark, f"file://{tmp_path}/counts", ["started", "kind"])
    for n in range(2):
        watch.run_once(watch.debounced(feed(), "2 seconds", late="1 day"), f"file://{tmp_path}/a{n}", watch.replace_sink(bursts), mode="complete")
        watch.run_once(watch.windowed_counts(feed(), "10 minutes", late="1 day"), f"file://{tmp_path}/b{n}", watch.upsert_sink(counts))
    rows = lambda x: sorted(map(tuple, x.collect()))
    assert rows(bursts.read()) == rows(watch.debounced(df, "2 seconds"))
    assert rows(counts.read()) == rows(watch.windowed_counts(df, "10 minutes"))


def test_only_known_paths_are_deleted(spark, tmp_path):
    df = _events(spark, [("a", 0, "created"), ("a", 1, "deleted"), ("a", 2, "deleted"), ("b", 0, "deleted")])
    df.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    feed = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")
    out = []
    watch.run_once(watch.known_deletions(feed), f"file://{tmp_path}/ck", lambda b, _: out.extend(map(tuple, b.collect())), mode="append")
    assert sorted(out) == [("a", "created"), ("a", "deleted")]


def test_new_files_are_streamed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("x")
    (tmp_path / "in" / "b.bin").write_text("x")
    out = []
    watch.run_once(watch.file_stream(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/ck", lambda b, _: out.extend(r.file_path for r in b.collect()), mode="append")
    assert [p.rsplit("/", 1)[1] for p in out] == ["a.md"]
    assert watch.windowed_counts(_events(spark, [("a", 0, "x"), ("b", 700, "x")]), "10 minutes").agg(F.sum("events")).head()[0] == 2

import os
import time

import pytest

from folioscope.config import Chunking, Config, Folders, Reranking, load
from folioscope.engine import Engine, Plugins

NOTES = "# Notes\n\n## Revenue\n\nRevenue grew by 12% in the quarter. Costs stayed flat.\n\n## Outlook\n\nThe plan for the migration to a new database is ready.\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    (d / "a").mkdir()
    (d / "a" / "report.md").write_text(NOTES)
    (d / "a" / "twin.md").write_text(NOTES)
    (d / "plain.txt").write_bytes("Un café près du théâtre, sans titre.".encode("latin-1"))
    (d / "empty.txt").write_text("  \n")
    (d / "corrupted.pdf").write_bytes(b"%PDF-nothing")
    (d / "skip.log").write_text("not a supported type")
    return d


def test_index_search_change_delete(spark, folder, tmp_path):
    config = Config(str(tmp_path / "store"), Folders((str(folder),)))
    engine = Engine(spark, config)
    with pytest.raises(LookupError):
        engine.search(["x"], "2030-01-01 00:00:00")
    got = engine.index()
    assert got == {"index": 2, "duplicate": 1, "deleted": 0, "error": 1}
    assert engine.read("points").where("doc_id not in (select 0)").count() == engine.read("points").count() > 4
    twin = engine.read("documents").where("outcome = 'duplicate'").head()
    assert twin.file_path.endswith("twin.md") and twin.original.endswith("report.md")
    found = engine.search(["revenue quarter"], "2030-01-01 00:00:00").collect()
    assert found[0].place == 1 and any("12%" in x.evidence for x in found[:2]) and "report.md" in found[0].label
    assert engine.search(["revenue"], "2030-01-01 00:00:00", folder=str(folder)).where("title = 'report'").count() == 0
    assert engine.search(["revenue"], "2030-01-01 00:00:00", folder=str(folder), subtree=True).where("title = 'report'").count() > 0
    assert {x[1] for x in engine.health()} == {True}
    # nothing changed: the failed file alone is tried again
    assert engine.changes().count() == 0 or {r.event_type for r in engine.changes().collect()} <= {"created"}
    os.remove(folder / "a" / "report.md")
    (folder / "plain.txt").write_text("Quite another text.")
    later = time.time() + 5
    os.utime(folder / "plain.txt", (later, later))
    got = engine.index()
    assert got["deleted"] == 1 and got["index"] >= 1
    docs = {os.path.basename(r.file_path): r for r in engine.read("documents").collect()}
    assert "report.md" not in docs and set(docs) >= {"twin.md", "plain.txt"}
    assert engine.read("sections").where("text like '%another%'").count() == 1
    assert engine.status().count() >= 1


def test_semantic_chunks_and_a_parser(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.pdf").write_bytes(b"HEAD one\nFirst sentence here. Second one there. Third one follows.")
    parse = lambda path, data: [("section_header", "one", 1), ("text", data.decode().split("\n")[1], 2)]
    engine = Engine(spark, Config(str(tmp_path / "s"), Folders((str(tmp_path / "in"),)), Chunking("semantic")), Plugins(parser=parse, scorer=lambda: lambda q, x: [float(len(t)) for t in x]))
    assert engine.index()["index"] == 1
    s = engine.read("sections").head()
    assert (s.heading, s.page_start, s.page_end) == ("one", 1, 2) and s.text.startswith("First")
    assert engine.search(["sentence"], "2030-01-01 00:00:00").head().label.startswith("x.pdf")


def test_hints_failures_plugins_and_lookups(spark, tmp_path):
    base = tmp_path / "in"
    for name in ("alpha", "beta"):
        (base / name).mkdir(parents=True)
        (base / name / "notes.txt").write_text(f"The quarterly revenue of {name} grew. Costs were flat in {name}.")
    (base / "bad.txt").write_text(" ")
    summarize = lambda texts: [None if "beta" in x else "a summary about zebras" for x in texts]
    ask = lambda texts: [["Who feeds the okapi?"] for _ in texts]
    plugins = Plugins(summarizer=summarize, questioner=ask, hypothetical=lambda qs: [None for _ in qs])
    engine = Engine(spark, Config(str(tmp_path / "s"), Folders((str(base),))), plugins)
    assert engine.index() == {"index": 2, "deleted": 0, "error": 1}
    now = "2030-01-01 00:00:00"
    points = engine.read("points")
    assert points.where("record_type = 'document_summary' and text = 'a summary about zebras'").count() == 1
    assert points.where("record_type = 'chunk' and questions[0] = 'Who feeds the okapi?'").count() == points.where("record_type = 'chunk'").count()
    found = engine.search(["find revenue in folder /beta", "okapi"], now)
    assert {r.file_path.split("/")[-2] for r in found.where("query like '%beta'").collect()} == {"beta"}
    assert found.where("query = 'okapi' and record_type = 'chunk'").count() == 2
    assert engine.search(["revenue in folder /nowhere"], now).count() > 0
    assert engine.search(["revenue"], now, since="2999-01-01").count() == 0 and engine.search(["revenue"], now, since="2000-01-01").count() > 0
    assert engine.quick_search(["revenue"], now, folder=str(base / "alpha")).select("title").collect() == [("notes",)]
    assert engine.recent(1).count() == 1 and engine.recent(9).count() == 2
    (chunk,) = engine.read("chunks").where("chunk_text like '%alpha%'").collect()
    assert [r.chunk_id for r in engine.context(chunk.chunk_id).collect()] == [chunk.chunk_id]
    # the failed file waits; when it is tried, its tries are counted until it is given up
    assert engine.changes().count() == 0
    for tries in (2, 3):
        engine.index([str(base / "bad.txt")])
        bad = engine.read("state").where("file_path like '%bad.txt'").head()
        assert (bad.retry_count, bad.process_status) == (tries, "poison" if tries == 3 else "error")
    (base / "beta" / "more.txt").write_text("One more text.")
    engine.watch(f"file://{tmp_path}/checkpoint", until_now=True)
    assert engine.read("documents").where("file_path like '%more.txt'").count() == 1
    assert engine.index([str(base / "beta" / "more.txt"), str(base / "missing.txt")])["index"] == 1


def test_a_parser_that_takes_too_long(spark, tmp_path):
    from pyspark.sql import functions as F

    from folioscope.sources import files

    for n in ("slow.pdf", "quick.pdf"):
        (tmp_path / n).write_bytes(b"x")

    def parse(path, data):
        import time

        time.sleep(5 if "slow" in path else 0)
        return [("text", "found", 1)]

    got = files.parsed(files.scan(spark, [str(tmp_path)]), parse, ["pdf"], F.lit(1))
    assert {(r.file_path.split("/")[-1], r.label) for r in got.collect()} == {("slow.pdf", "error"), ("quick.pdf", "text")}


def test_configuration(tmp_path, monkeypatch):
    f = tmp_path / "c.toml"
    f.write_text('store = "~/idx"\n[folders]\npaths = ["."]\n[chunking]\nstrategy = "semantic"\nmax_chunk_tokens = 512\n')
    c = load(str(f))
    assert c.chunking.max_chunk_tokens == 512 and os.path.isabs(c.folders.paths[0]) and c.reranking.results == 10
    monkeypatch.setenv("FOLIOSCOPE_CONFIG", str(f))
    assert load().chunking.strategy == "semantic"
    for bad in (lambda: Chunking(similarity_threshold=2), lambda: Chunking(max_chunk_tokens=5), lambda: Reranking(5, 6), lambda: Chunking("other")):
        with pytest.raises(ValueError):
            bad()

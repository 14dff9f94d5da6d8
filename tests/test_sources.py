import json

import pytest
from pyspark.sql import functions as F

from citegrain import schemas
from citegrain.operators import ingest
from citegrain.sources import readers, writers
from citegrain.streaming.ingest_stream import ingest_files
from citegrain.streaming.job_stream import track_jobs


def test_papers_from_files(spark, tmp_path):
    (tmp_path / "paper-a.txt").write_text("Abstract\nWe study.\fPage two.", encoding="utf-8")
    (tmp_path / "paper-b.txt").write_bytes(b"\xff\xfe\xff")
    (tmp_path / "other.txt").write_text("ignored")
    rows = readers.read_papers(spark, str(tmp_path)).collect()
    assert {(r.paper_id, r.page) for r in rows} == {("paper-a", 1), ("paper-a", 2), ("paper-b", None)}
    assert [r.error.split(":")[0] for r in rows if r.error] == ["UnicodeDecodeError"]


def test_one_bad_page_keeps_the_others(spark, tmp_path):
    (tmp_path / "paper-a.bin").write_bytes(b"x")

    def broken():
        raise ValueError("page 2")

    rows = readers.read_papers(spark, str(tmp_path), lambda _: [lambda: ("ok", None), broken]).collect()
    assert {(r.page, r.raw_text, r.error) for r in rows} == {(1, "ok", None), (2, None, "ValueError: page 2")}


def test_tolerant_records(spark, tmp_path):
    path = tmp_path / "gold.jsonl"
    path.write_text('﻿{"question_id": "a", "gold_page": 2}\n\nnot json\n{"question_id": "b"}\n', encoding="utf-8")
    good, bad = readers.read_records_tolerant(spark, str(path), schemas.GOLD)
    assert {(r.question_id, r.gold_page) for r in good.collect()} == {("a", 2), ("b", None)}
    assert [r.line for r in bad.collect()] == ["not json"]


def test_last_gold_row_wins_and_manifest_types(spark, tmp_path):
    q, g, m = (tmp_path / n for n in ("q.jsonl", "g.jsonl", "m.csv"))
    q.write_text('{"question_id": "a", "answerable": true}\n')
    g.write_text('{"question_id": "a", "gold_page": 1}\n{"question_id": "a", "gold_page": 2}\n')
    m.write_text("﻿paper_id,title,domain,source_url,pdf_filename,language,license_status,text_extractable,page_count,notes\np,T,d,u,f.pdf,en,ok,true,7,\n", encoding="utf-8")
    questions, gold = readers.read_evaluation(spark, str(q), str(g))
    assert questions.first().answerable is True
    assert [r.gold_page for r in gold.collect()] == [2]
    row = readers.read_manifest(spark, str(m)).first()
    assert (row.paper_id, row.page_count) == ("p", 7)


def test_hashes_and_inventory(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "b.txt").write_text("yy")
    files = readers.file_hashes(spark, str(tmp_path)).cache()
    frozen = files.select("name", F.when(F.col("name") == "a.txt", "0").otherwise(F.col("sha256")).alias("sha256"))
    assert [r.name for r in readers.changed_files(files, frozen).collect()] == ["a.txt"]
    row = readers.inventory(spark, str(tmp_path)).first()
    assert (row.files, row.bytes) == (2, 3)


def test_benchmark_papers_become_chunks(spark):
    docs = spark.createDataFrame(
        [("s", "dev", "authored", [(1, "A", "x " * 900)]), ("r", "dev", "publisher_pdf_extracted_text", [(2, "B", "x " * 900)])],
        "paper_id string, split string, source_kind string, pages array<struct<page int, section string, text string>>",
    )
    rows = readers.page_documents(docs).collect()
    assert sorted(r.chunk_id for r in rows) == ["r-p002-c001", "r-p002-c002", "s-p001-c001"]
    assert {(r.paper_id, r.section_index, r.chunk_index) for r in rows} == {("s", 0, 0), ("r", 1, 0), ("r", 1, 1)}
    assert readers.page_documents(docs, "holdout").count() == 0


def test_upload_checks_keep_their_order(spark):
    rows = [("a.pdf", None, 0, b""), ("a.txt", None, 99999999, b""), ("a.txt", None, 5, b"%PDF-"),
            ("a.pdf", "text/html", 5, b"%PDF-"), ("a.pdf", None, 5, b"HELLO"), ("A.PDF", "application/pdf", 5, b"%PDF-1")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, n string, t string, s long, c binary")
    got = df.orderBy("i").select(readers.upload_problem(*[F.col(c) for c in "ntsc"]).alias("p")).collect()
    assert [r.p for r in got] == ["empty_file", "file_too_large", "invalid_file_type", "invalid_file_type", "invalid_pdf", None]


def raw(spark, rows):
    return spark.createDataFrame(rows, schemas.RAW_PAGE)


def test_publication_is_all_or_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    made = ingest.ingest(raw(spark, [("p", 1, "Some text.", None, None)]))
    writers.publish_ingestion(made, out)
    assert readers.read_chunks(spark, f"{out}/chunks", "p").first().text == "Some text."
    with pytest.raises(writers.OutputRefused):
        writers.publish_ingestion(ingest.ingest(raw(spark, [])), out)
    twice = ingest.ingest(raw(spark, [("p", 1, "A.", None, None), ("p", 1, "B.", None, None)]))
    with pytest.raises(writers.OutputRefused):
        writers.publish_ingestion(twice, out)
    assert readers.read_chunks(spark, f"{out}/chunks").count() == 1
    newer = ingest.ingest(raw(spark, [("q", 1, "New text.", None, None)]))
    writers.publish_ingestion(newer, out)
    assert [r.paper_id for r in readers.read_chunks(spark, f"{out}/chunks").collect()] == ["q"]


def test_a_reader_always_finds_a_version(spark, tmp_path, monkeypatch):
    """Whatever step of a publication a reader looks in between, a whole version is there."""
    path, seen = str(tmp_path / "table"), []
    with pytest.raises(FileNotFoundError):
        writers.published(spark, path)
    first = writers.publish(spark.range(3), path)
    steps = writers._filesystem

    def looking(*args):
        seen.append(spark.read.parquet(writers_published(spark, path)).count())
        return steps(*args)

    def writers_published(session, folder):
        monkeypatch.setattr(writers, "_filesystem", steps)
        try:
            return writers.published(session, folder)
        finally:
            monkeypatch.setattr(writers, "_filesystem", looking)

    monkeypatch.setattr(writers, "_filesystem", looking)
    second = writers.publish(spark.range(5), path)
    monkeypatch.setattr(writers, "_filesystem", steps)
    assert seen and set(seen) <= {3, 5}
    assert spark.read.parquet(writers.published(spark, path)).count() == 5
    # one that has just resolved the version before may still read it
    assert spark.read.parquet(f"{path}/{first}").count() == 3
    third = writers.publish(spark.range(7), path, "json")
    names = {p.name for p in (tmp_path / "table").iterdir() if not p.name.startswith(".")}
    assert names == {second, third, f"_current-{second}", f"_current-{third}"}
    # a publication that dies while it writes leaves the current version alone
    broken = spark.range(4).selectExpr("raise_error('lost') as x")
    with pytest.raises(Exception, match="lost"):
        writers.publish(broken, path)
    assert writers.current_version(spark, path) == third


def test_guards_and_resumed_runs(spark, tmp_path):
    taken = tmp_path / "taken"
    taken.mkdir()
    with pytest.raises(writers.OutputRefused):
        writers.guard(spark, str(taken))
    with pytest.raises(writers.OutputRefused):
        writers.guard(spark, str(tmp_path / "frozen" / "x"), (str(tmp_path / "frozen"),))
    writers.guard(spark, str(tmp_path / "free"))
    path = str(tmp_path / "runs")
    rows = lambda *ids: spark.createDataFrame([(i, "out") for i in ids], "case_id string, output string")
    writers.append_results(rows("a", "b"), path)
    writers.append_results(rows("b", "c"), path)
    assert sorted(r.case_id for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]
    assert [r.case_id for r in writers.remaining(rows("a", "d"), spark.read.parquet(path)).collect()] == ["d"]


def test_search_results_nest(spark):
    ranked = spark.createDataFrame(
        [("q", "p", "What?", 2, "c2", 0.1, "B"), ("q", "p", "What?", 1, "c1", 0.2, "A")],
        "query_id string, paper_id string, question string, rank int, chunk_id string, score double, text string",
    )
    row = writers.search_results(ranked, "bm25", F.struct(F.lit(20).alias("k"))).first()
    assert [r.chunk_id for r in row.results] == ["c1", "c2"] and row.config.k == 20


def test_stream_ingests_each_file_once(spark, tmp_path):
    inbox, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    line = lambda p, t: json.dumps({"paper_id": p, "page": 1, "raw_text": t}) + "\n"
    (tmp_path / "in" / "1.json").write_text(line("a", "First text."))
    ingest_files(spark, inbox, out, state).awaitTermination(120)
    (tmp_path / "in" / "2.json").write_text(line("b", "Second text."))
    ingest_files(spark, inbox, out, state).awaitTermination(120)
    ingest_files(spark, inbox, out, state).awaitTermination(120)
    rows = spark.read.parquet(f"{out}/chunks").collect()
    batch = ingest.ingest(raw(spark, [("a", 1, "First text.", None, None), ("b", 1, "Second text.", None, None)]))
    assert sorted((r.chunk_id, r.text) for r in rows) == sorted((r.chunk_id, r.text) for r in batch.chunks.collect())


def test_stream_tracks_jobs(spark, tmp_path):
    inbox = tmp_path / "events"
    inbox.mkdir()
    at = lambda n: f"2024-01-01T00:00:{n:02d}Z"
    steps = [("queued", 1), ("completed", 2), ("running", 3), ("queued", 4), ("failed", 5), ("queued", 6)]
    (inbox / "1.json").write_text("".join(
        json.dumps({"paper_id": "p", "job_id": f"j{n}", "status": s, "at": at(n)}) + "\n" for s, n in steps
    ))
    stream = track_jobs(spark.readStream.schema(schemas.JOB_EVENT).json(str(inbox)))
    query = stream.writeStream.format("memory").queryName("jobs").option(
        "checkpointLocation", str(tmp_path / "ckpt")
    ).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    rows = spark.sql("SELECT * FROM jobs ORDER BY at").collect()
    assert [(r.status, r.accepted) for r in rows] == [
        ("queued", True), ("queued", False), ("running", True), ("running", False), ("failed", True), ("queued", True),
    ]
    assert {r.job_id for r in rows} == {"j1"}

"""Ingest of folders end to end, and streams against the batch operators."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tidepool.operators import episodes
from tidepool.plans.ingest import Store
from tidepool.sources import files
from tidepool.sources.snapshots import SnapshotTable
from tidepool.streaming import streams

NOW = 1_786_000_000_000_000


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())


def test_ingest_twice_then_change_and_delete(spark, tmp_path):
    folder = tmp_path / "files"
    write(folder / "project" / "qdrant_notes.txt", "Vector search with qdrant is compared to other databases in these notes.")
    write(folder / "project" / "plan.md", "The plan for the next weeks, with a calendar.")
    write(folder / "latin.txt", "caf\xe9 au lait, twice".encode("latin-1"))
    write(folder / "broken.docx", b"no zip")
    write(folder / "ignored.xyz", "nothing")
    store = Store(spark, str(tmp_path / "store"))
    first = store.ingest(str(folder), NOW)
    assert (first["indexed"], first["errors"], first["events"], first["missing"]) == (4, 1, 4, 0) and first["episodes"] > 0 and first["memories"] > 0
    again = store.ingest(str(folder), NOW + 1)
    assert (again["indexed"], again["skipped"], again["events"], again["episodes"]) == (0, 4, 0, first["episodes"])
    found = store.engine().search("qdrant vector", 5).collect()
    assert found[0]["file_name"] == "qdrant_notes.txt" and found[0]["evidence"][0]["confidence_type"] == "FACT"
    ids = {r["file_name"]: r["id"] for r in store.read("artifacts").collect()}
    store.record_feedback("qdrant vector", str(ids["plan.md"]), "pin", NOW // 1000)
    with pytest.raises(ValueError):
        store.record_feedback("q", "1", "like", 0)
    assert store.open_document(ids["plan.md"], NOW + 5)["file_name"] == "plan.md" and store.open_document(999, NOW) is None
    os.remove(folder / "project" / "plan.md")
    write(folder / "project" / "qdrant_notes.txt", "Now about something else entirely, but still a vector.")
    os.utime(folder / "project" / "qdrant_notes.txt", (1_800_000_000, 1_800_000_000))
    changed = store.ingest(str(folder), NOW + 10)
    assert (changed["indexed"], changed["missing"]) == (1, 1)
    kept = {r["file_name"]: (r["id"], r["missing"]) for r in store.read("artifacts").collect()}
    assert kept["plan.md"] == (ids["plan.md"], True) and kept["qdrant_notes.txt"] == (ids["qdrant_notes.txt"], False)
    assert store.read("vector_chunks").filter(F.col("artifact_id") == ids["plan.md"]).count() == 0
    assert store.read("events").filter(F.col("artifact_id") == ids["plan.md"]).count() == 0
    assert store.status()["missing"] == 1
    answer = store.engine().respond({"query": "vector", "k": 3})
    assert [r["file_name"] for r in answer["results"]] == ["qdrant_notes.txt"]


def test_extraction(tmp_path):
    path = tmp_path / "a.docx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="x"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>')
    assert files.extract(".docx", path.read_bytes(), files.OcrEngine()) == ("one\ntwo", None)
    assert files.extract(".png", b"", files.OcrEngine()) == ("", None) and files.extract(".xyz", b"", files.OcrEngine()) == ("", None)

    import zlib

    page = zlib.compress(b"BT /F1 12 Tf 72 700 Td (Hello \\(PDF\\)) Tj 0 -14 Td [(wor) -20 (ld)] TJ T* <41 42> Tj ET")
    objects = [b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj", b"2 0 obj << /Type /Pages /Kids [3 0 R] /Count 1 >> endobj", b"3 0 obj << /Type /Page /Parent 2 0 R /Contents 4 0 R >> endobj", b"4 0 obj << /Filter /FlateDecode /Length %d >> stream\n" % len(page) + page + b"\nendstream endobj"]
    assert files.extract(".pdf", b"%PDF-1.4\n" + b"\n".join(objects), files.OcrEngine()) == ("Hello (PDF)\nworld\nAB", None)
    assert files.extract(".pdf", b"no pdf", files.OcrEngine())[1] is not None

    class Failing(files.OcrEngine):
        def read(self, content):
            raise OSError("lens")

    assert files.extract(".png", b"", Failing())[1] == "OSError: lens"


def test_simulated_events_and_cases(spark):
    df = files.simulated_events(spark, [{"type": "FILE_OPENED", "timestamp": "2026-08-12T10:00:00Z", "payload": {"path": "/a"}}])
    assert df.first()["us"] == 1_786_528_800_000_000
    for bad in ({"type": "X", "timestamp": "2026-08-12"}, {"type": "FILE_OPENED", "timestamp": "later"}, {"type": "FILE_OPENED", "timestamp": "2026-08-12", "event_confidence": 2}):
        with pytest.raises(ValueError):
            files.simulated_events(spark, [bad])
    assert files.recall_cases('cases:\n  - id: a\n    query: "x: y"\n  - id: b\n') == [{"id": "a", "query": "x: y"}, {"id": "b"}]


def test_snapshots_can_be_rewritten_from_themselves(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"), keep=2)
    t.write(spark.range(3))
    for _ in range(3):
        t.write(t.read().withColumn("id", F.col("id") + 1))
    assert sorted(r[0] for r in t.read().collect()) == [3, 4, 5] and len(t.versions()) == 2


EV = "id string, event_type string, ts timestamp_ntz, source string, artifact_id bigint, payload string"


def test_streamed_episodes_like_the_batch(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2026, 5, 1)
    rows = [(f"e{n:03d}", "FILE_MODIFIED", start + timedelta(minutes=n * (40 if n % 10 == 0 else 4)), "dev", n % 3, f'{{"path": "/w/proj{n // 7}/f{n % 3}.txt"}}') for n in range(80)]
    rows += [("end", "FILE_DELETED", start + timedelta(days=30), "other", None, None)] + rows[:9]
    path = str(tmp_path / "activity_events.parquet")
    spark.createDataFrame(rows, EV).write.parquet(path)
    got = streams.run_to_table(streams.stream_episodes(streams.without_repeats(streams.event_stream(spark, path), "10 days")), "t").filter("source = 'dev'")
    events = spark.read.parquet(path).distinct().filter("source = 'dev'").select("id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "artifact_id", F.get_json_object("payload", "$.path").alias("path"), F.lit(None).cast("string").alias("app"))
    want = {(r["start_us"], r["end_us"], tuple(r["event_ids"]), round(r["grouping_confidence"], 9)) for r in episodes.group(events).collect()}
    assert {(r["start_us"], r["end_us"], tuple(r["event_ids"]), round(r["grouping_confidence"], 9)) for r in got.collect()} == want


def test_feedback_stream(spark, tmp_path):
    schema = "query_text string, document_id string, action string, ts_ms bigint"
    spark.createDataFrame([("q", "1", "pin", 1), ("q", "2", "ignore", 2), ("q", "3", "like", 3)], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    streams.record_feedback_stream(stream, str(tmp_path / "fb"), str(tmp_path / "acc"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "fb")).count() == 2 and spark.read.parquet(str(tmp_path / "acc")).count() == 1

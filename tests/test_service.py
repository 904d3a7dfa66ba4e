"""The service, the kept vector index, the acceptance run, event sources, and answers when a part fails."""

import json
import threading
import urllib.error
import urllib.request

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool import acceptance
from tidepool.functions import clock
from tidepool.operators import annindex, metrics, vectors
from tidepool.plans.ingest import Store
from tidepool.service import MOST_BODY, serve
from tidepool.sources import files
from tidepool.streaming import streams


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("service")
    store = Store(spark, str(folder / "store"))
    server = serve(store, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    (folder / "files").mkdir()
    (folder / "files" / "a_note.txt").write_text("A note about the harbour and its cranes.")
    yield folder, store, server
    server.shutdown()


def call(server, method, path, said=None, raw=None):
    data = raw if raw is not None else None if said is None else json.dumps(said).encode()
    try:
        with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.server_address[1]}{path}", data, method=method), timeout=300) as r:
            return r.status, json.loads(r.read())
    except urllib.error.HTTPError as e:
        return e.code, json.loads(e.read())


def test_service_over_http(place):
    folder, store, server = place
    assert call(server, "POST", "/search", {"query": "harbour"})[0] == 503
    assert call(server, "POST", "/index", {"folders": []})[0] == 400 and call(server, "POST", "/index", {"folders": [str(folder / "no")]})[0] == 404
    assert call(server, "POST", "/index", {"folders": [str(folder / "files")]})[0] == 202
    assert call(server, "POST", "/index", {"folders": [str(folder / "files")]})[0] == 409
    assert call(server, "GET", "/index/status")[1]["indexing_in_progress"] is True
    server.service.wait()
    status = call(server, "GET", "/index/status")[1]
    assert (status["progress_percent"], status["last_error"], status["counts"]["indexed"]) == (100, None, 1)
    code, said = call(server, "POST", "/search", {"query": "harbour", "k": 3})
    assert code == 200 and [r["file_name"] for r in said["results"]] == ["a_note.txt"] and isinstance(said["results"][0]["id"], str)
    ident = said["results"][0]["id"]
    assert call(server, "POST", "/search", {"query": " "})[0] == 400 and call(server, "POST", "/search", raw=b"{")[0] == 400 and call(server, "POST", "/search", raw=b"[]")[0] == 400
    assert call(server, "POST", "/feedback", {"query": "harbour", "document_id": ident, "action": "click"})[0] == 200
    assert call(server, "POST", "/feedback", {"query": "harbour", "document_id": ident, "action": "like"})[0] == 400
    assert call(server, "POST", "/feedback", raw=b" " * (MOST_BODY + 1))[0] == 413
    assert [tuple(r) for r in store.read("accesses").select("document_id", "access_type").collect()] == [(ident, "click")]
    assert call(server, "GET", f"/document/{ident}")[1]["file_name"] == "a_note.txt" and call(server, "GET", "/document/999")[0] == 404
    assert store.read("artifacts").first()["last_opened_ms"] is not None
    assert call(server, "GET", "/status")[1]["available"] == 1 and "/document/{id}" in call(server, "GET", "/openapi.json")[1]["paths"]
    for place_, start in (("/", b"<!doctype html>"), ("/page.js", b'"use strict"'), ("/page.css", b"body")):
        with urllib.request.urlopen(f"http://127.0.0.1:{server.server_address[1]}{place_}", timeout=60) as r:
            assert r.status == 200 and r.read().startswith(start)
    assert call(server, "GET", "/static/index.html")[0] == 404 and call(server, "GET", "/../service.py")[0] == 404
    assert call(server, "GET", "/etc/passwd")[0] == 404 and call(server, "GET", "/search")[0] == 405


def test_search_answers_when_a_part_fails(place):
    _, store, server = place
    server.service.wait()
    engine = store.engine()
    engine.events = engine.events.withColumn("us", F.raise_error(F.lit("lost")).cast("bigint"))
    rows = engine.search("harbour", 5).collect()
    assert [r["file_name"] for r in rows] == ["a_note.txt"] and rows[0]["evidence"] == [] and engine.failed == ["evidence"]
    engine = store.engine()
    engine.feedback = engine.feedback.withColumn("ts_ms", F.raise_error(F.lit("lost")).cast("bigint"))
    assert [r["position"] for r in engine.search("harbour", 5, rerank=True).collect()] == [1] and engine.failed == ["feedback"]


def test_acceptance(spark, tmp_path):
    said = acceptance.run(spark, str(tmp_path))
    assert [r["name"][0] for r in said] == list("ABCDEFGHIJK") and all(r["passed"] for r in said), said


def test_kept_vector_index(spark, tmp_path, monkeypatch):
    rows = metrics.synthetic_vectors(spark, 300, 16, seed=3).withColumn("artifact_id", F.floor(F.col("artifact_id") / 3))
    x = np.array([r["embedding"] for r in rows.orderBy("artifact_id", F.length("chunk_id"), "chunk_id").collect()])
    store = annindex.VectorStore(spark, str(tmp_path), "/data/store", lambda: rows)
    probe = [float(v) for v in x[0]]
    exact = [r["chunk_id"] for r in vectors.exact_topk(rows, probe, "synthetic", 5, -1.0).collect()]
    got = [r["chunk_id"] for r in store.search(probe, "synthetic", 5, -1.0).collect()]
    index = store.index("synthetic", 16)
    assert got[0] == exact[0] and len(set(got) & set(exact)) >= 3 and index.count() == 300 and index.contains("s7") and not index.contains("x")
    index.mark_deleted(spark.createDataFrame([(0,)], "id bigint"))
    assert index.count() == 297 and exact[0] not in [r["chunk_id"] for r in index.search(probe, 5).collect()]
    again = annindex.BucketIndex(spark, index.folder, "synthetic", 16)
    assert again.load() and again.count() == 297 and not annindex.BucketIndex(spark, index.folder, "synthetic", 16, bits=6).load()
    again.add(rows.limit(1).withColumn("chunk_id", F.lit("new")).withColumn("embedding", F.lit(probe).cast("array<float>")))
    assert [r["chunk_id"] for r in again.search(probe, 1).collect()] == ["new"]
    labels = [r["label"] for r in again._stored().select("label").distinct().collect()]
    assert len(labels) == 301
    (tmp_path / "x").mkdir()
    with open(f"{index.folder}/meta.json", "w") as f:
        f.write("{ broken")
    for crc in (tmp_path).rglob(".meta.json.crc"):
        crc.unlink()
    fresh = annindex.VectorStore(spark, str(tmp_path), "/data/store", lambda: rows)
    assert fresh.index("synthetic", 16).count() == 300  # what can't be read is made anew
    monkeypatch.setattr(annindex.BucketIndex, "search", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    assert [r["chunk_id"] for r in fresh.search(probe, "synthetic", 5, -1.0).collect()] == exact
    assert [annindex.backed_off(5, n) for n in (9, 5, 4, 2, 1, 0)] == [5, 5, 2, 2, 1, 0]
    assert annindex.index_folder("/r", "/data/store", "a/b c", 3).endswith("/a_b_c-3")


def test_scaling_report(spark, tmp_path):
    said = annindex.scaling(spark, str(tmp_path / "index"), n=500, dimension=16, n_queries=3, k=5)
    assert said["n"] == 500 and said["build_s"] > 0 and 0 < said["recall"] <= 1 and said["index_ms"] > 0


def test_models_and_failures_of_single_texts(spark, tmp_path):
    class Moody(vectors.HashEmbedder):
        def embed(self, texts):
            if any("bad" in t for t in texts):
                raise ValueError("no")
            return super().embed(texts)

    df = spark.createDataFrame([("good text",), ("bad text",), ("other words",)], "text string").coalesce(1)
    got = {r["text"]: len(r["v"]) for r in df.withColumn("v", vectors.embedding(Moody(8))(F.col("text"))).collect()}
    assert got == {"good text": 8, "bad text": 0, "other words": 8}
    assert vectors.validate_model(str(tmp_path))["error"].startswith("missing") and vectors.model_status(str(tmp_path))["available"] is False
    for n in vectors.MODEL_FILES:
        (tmp_path / n).write_text("x")
    assert vectors.install_model(str(tmp_path), str(tmp_path / "there"))["copied"] == list(vectors.MODEL_FILES)
    assert vectors.install_model(str(tmp_path), str(tmp_path / "there"))["copied"] == [] and vectors.validate_model(str(tmp_path / "there"))["valid"] is False
    with pytest.raises(FileNotFoundError):
        vectors.install_model(str(tmp_path / "nowhere"), str(tmp_path / "there"))


def test_model_change(spark, tmp_path):
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.txt").write_text("Some words about a lighthouse and its keeper.")
    Store(spark, str(tmp_path / "store"), vectors.HashEmbedder(16)).ingest(str(tmp_path / "files"), 1)
    later = Store(spark, str(tmp_path / "store"), vectors.HashEmbedder(32))
    assert later.model_changed() == ["hash-16"] and later.reembed() == 1 and later.model_changed() == []


def test_event_sources(spark):
    one = files.SimulatedSource([{"id": "a", "type": "FILE_OPENED", "timestamp": "2026-08-12T10:00:00Z"}, {"type": "FILE_OPENED", "timestamp": "2026-08-12T10:00:00Z"}])
    rows = files.events_of(spark, [one, files.SimulatedSource([{"id": "a", "type": "FILE_OPENED", "timestamp": "2026-08-12T10:00:00Z"}])]).collect()
    assert len(rows) == 2 and sorted(len(r["id"]) for r in rows) == [1, 36] and isinstance(files.default_ocr(), files.OcrEngine)


def test_strict_times(spark):
    df = spark.createDataFrame([("2026-08-12T10:00:00Z",), (None,)], "t string")
    assert [r[0] is None for r in df.select(clock.parse_iso_strict("t")).collect()] == [False, True]
    with pytest.raises(Exception, match="no ISO-8601 time"):
        spark.createDataFrame([("later",)], "t string").select(clock.parse_iso_strict("t")).collect()


def test_feedback_totals_decay_like_the_batch(spark, tmp_path):
    schema = "id bigint, query_text string, document_id string, action string, ts_ms bigint"
    day = 86_400_000
    spark.createDataFrame([(1, "q", "1", "pin", 10 * day), (2, "q", "1", "click", 40 * day), (3, "q", "2", "ignore", 40 * day), (4, "q", None, "pin", day), (5, "q", "3", "like", day)], schema).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        streams.keep_feedback_totals(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 40 * day, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r["document_id"]: (r["n"], r["weight"]) for r in streams.latest_totals(spark, str(tmp_path / "out")).collect()}
    assert got == {"1": (2, 1.0), "2": (1, -1.0)} and abs(streams.decayed(40 * day, 70 * day) - 0.5) < 1e-9

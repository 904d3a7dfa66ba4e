"""Ingest of folders: scan, extract, index, events, episodes, memories, as snapshot tables in one store."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.operators import episodes as episodes_op
from tidepool.operators import memories as memories_op
from tidepool.operators import tables, vectors
from tidepool.operators.annindex import VectorStore
from tidepool.operators.textindex import TextIndex
from tidepool.plans.search import SearchEngine
from tidepool.session import cut
from tidepool.sources import files
from tidepool.sources.snapshots import SnapshotTable

log = logging.getLogger(__name__)
SCHEMAS = {
    "artifacts": "id bigint, path string, file_name string, mime_type string, size bigint, created_at timestamp_ntz, modified_at timestamp_ntz, indexed_at timestamp_ntz, content_hash string, extracted_text string, extract_error string, missing boolean, last_opened_ms bigint",
    "events": "id string, event_type string, us bigint, source string, source_kind string, artifact_id bigint, path string, app string, tags array<string>, event_confidence double, recorded_us bigint, payload string",
    "episodes": "id string, start_us bigint, end_us bigint, event_ids array<string>, artifact_ids array<bigint>, grouping_confidence double, title string",
    "memories": "id string, episode_ids array<string>, event_ids array<string>, artifact_ids array<bigint>, start_us bigint, end_us bigint, title string, topics array<string>, confidence double",
    "vector_chunks": "artifact_id bigint, source_type string, chunk_id string, chunk_index int, start_char int, end_char int, text string, model_id string, dimension int, embedding array<float>",
    "feedback": "query_text string, document_id string, action string, ts_ms bigint, access_type string",
}


class Store:
    """The engine's tables in one folder, and what the service does with them."""

    def __init__(self, spark: SparkSession, folder: str, embedder: vectors.Embedder | None = None, ocr: files.OcrEngine | None = None):
        self.spark, self.embedder, self.ocr = spark, embedder or vectors.HashEmbedder(), ocr or files.default_ocr()
        self.index = TextIndex(spark, f"{folder.rstrip('/')}/text-index")
        self.vectors = VectorStore(spark, f"{folder.rstrip('/')}/vector-index", folder.rstrip("/"), lambda: self.read("vector_chunks"))
        parts = {"vector_chunks": ["model_id", "dimension"]}
        self.tables = {n: SnapshotTable(spark, f"{folder.rstrip('/')}/{n}", parts.get(n)) for n in SCHEMAS}

    def read(self, name: str) -> DataFrame:
        """A table; accesses are the rows of feedback that are accesses."""
        if name == "accesses":
            return self.read("feedback").filter("access_type IS NOT NULL").select("document_id", "access_type", "ts_ms")
        t = self.tables[name]
        rows = t.read() if t.exists() else self.spark.createDataFrame([], SCHEMAS[name])
        return rows.select(*[F.col(f.name).cast(f.dataType) for f in self.spark.createDataFrame([], SCHEMAS[name]).schema])

    def write(self, name: str, rows: DataFrame) -> DataFrame:
        columns = [f.name for f in self.spark.createDataFrame([], SCHEMAS[name]).schema]
        return self.tables[name].write(rows.select(*columns))

    def model_changed(self) -> list[str]:
        """Models of stored chunks other than the embedder's."""
        rows = self.read("vector_chunks").select("model_id").distinct().collect()  # a row a model
        return sorted(r["model_id"] for r in rows if r["model_id"] != self.embedder.model_id)

    def reembed(self) -> int:
        """Embed the texts of all chunks anew by the present model, in place of those of other models; how many there are."""
        rows = self.read("vector_chunks").dropDuplicates(["chunk_id"]).drop("model_id", "dimension", "embedding")
        written = self.write("vector_chunks", vectors.embed_chunks(rows, self.embedder))
        if self.embedder.dimension:
            self.vectors.index(self.embedder.model_id, self.embedder.dimension).rebuild(written)
        return written.count()

    def ingest(self, folder: str, now_us: int, force: bool = False, progress: Callable[[dict], None] | None = None) -> dict:
        """Index what is new or changed below a folder and derive the rest anew; counts of what was done.

        Events come from the catalogue as it was before; what hangs on files that are gone is removed before episodes are
        made. Running it again without changes does nothing new. A progress callback that fails is ignored.
        """

        def tell(stage: str, **more) -> None:
            try:
                if progress:
                    progress({"stage": stage} | more)
            except Exception:  # a listener's failure is not the ingest's
                pass

        folder = folder.rstrip("/")
        if others := self.model_changed():
            log.warning("chunks of other models (%s) are not searched; reembed() brings them to %s", ", ".join(others), self.embedder.model_id)
        before = self.read("artifacts")
        scan = files.scan_folder(self.spark, folder)
        listed = cut(scan.drop("content", "ext"), "listed")
        tell("scanned", files=listed.count())
        due = tables.needs_index(listed, before, force).select("path")
        at = F.timestamp_add("MICROSECOND", F.lit(now_us), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))
        read = cut(files.extract_texts(scan.join(due, "path", "left_semi"), self.ocr).withColumn("created_at", F.col("modified_at")).withColumn("indexed_at", at), "read")
        told = cut(files.folder_events(listed, before, self.read("events"), folder, now_us), "told")
        marked = tables.mark_missing(tables.upsert_artifacts(before, read), listed, folder)
        marked = cut(marked, "marked")
        gone = marked.filter("missing").select("id")
        artifacts = self.write("artifacts", marked)
        counts = {"indexed": read.count(), "skipped": listed.count() - read.count(), "errors": read.filter("extract_error IS NOT NULL").count(), "missing": marked.filter("newly_missing").count()}
        tell("indexed", **counts)
        changed = artifacts.join(read.select("path"), "path", "left_semi").select("id", "mime_type", F.col("extracted_text").alias("text"))
        chunks = vectors.embed_chunks(vectors.chunk_documents(changed), self.embedder)
        kept = tables.without_artifacts(tables.replace_chunks(self.read("vector_chunks"), changed.select("id"), chunks), gone)
        self.write("vector_chunks", kept)
        touched = changed.select("id").unionByName(marked.filter("newly_missing").select("id")).distinct()
        self.index.replace(artifacts.join(touched, "id", "left_semi"))
        if self.embedder.dimension:
            self.vectors.replace(touched, self.read("vector_chunks").join(touched.withColumnRenamed("id", "artifact_id"), "artifact_id", "left_semi"), self.embedder.model_id, self.embedder.dimension)
            self.vectors.flush()
        known = artifacts.select(F.col("id").alias("_id"), F.col("path").alias("_path"))
        named = told.join(known, told["path"] == known["_path"], "left").withColumn("artifact_id", F.coalesce("artifact_id", "_id")).drop("_id", "_path")
        fresh = cut(tables.append_new(self.read("events"), named), "fresh")
        log = self.write("events", tables.without_artifacts(self.read("events").unionByName(fresh), gone))
        counts["events"] = fresh.count()
        found = self.write("episodes", episodes_op.group(log))
        self.write("memories", memories_op.derive(found, log))
        counts["episodes"], counts["memories"] = found.count(), self.read("memories").count()
        tell("done", **counts)
        return counts

    def ingest_all(self, folders: list[str], now_us: int, force: bool = False) -> dict:
        """The sums over folders; episodes and memories are those there are in the end."""
        total: dict = {}
        for f in folders:
            for k, v in self.ingest(f, now_us, force).items():
                total[k] = v if k in ("episodes", "memories") else total.get(k, 0) + v
        return total

    def engine(self) -> SearchEngine:
        return SearchEngine(self.read("artifacts"), self.read("events"), self.read("episodes"), self.read("memories"), self.read("vector_chunks"), self.read("feedback"), self.embedder, index=self.index if self.index.segments() else None)

    def record_feedback(self, query: str, document_id: str, action: str, ts_ms: int) -> None:
        """Append one piece of feedback, in one publication with the access that a click or a pin is too. Other actions raise
        ValueError."""
        if action not in ("click", "ignore", "pin"):
            raise ValueError(f"no such action: {action}")
        access = None if action == "ignore" else action
        one = self.spark.createDataFrame([(query, str(document_id), action, ts_ms, access)], SCHEMAS["feedback"])
        self.write("feedback", self.read("feedback").unionByName(one))

    def open_document(self, artifact_id: int, now_us: int) -> dict | None:
        """The fields of an artifact that may be shown, or None; the opening is written to the log and to its recency."""
        rows = self.read("artifacts").filter(F.col("id") == artifact_id).limit(1).collect()
        if not rows:
            return None
        path = rows[0]["path"]
        event = self.spark.createDataFrame([(f"open_{artifact_id}_{now_us}", "FILE_OPENED", now_us, "service", "simulated", artifact_id, path, None, None, 1.0, now_us, None)], SCHEMAS["events"])
        self.write("events", self.read("events").unionByName(tables.append_new(self.read("events"), event)))
        opened = F.when(F.col("id") == artifact_id, F.lit(now_us // 1000)).otherwise(F.col("last_opened_ms"))
        self.write("artifacts", self.read("artifacts").withColumn("last_opened_ms", opened))
        hidden = {"extracted_text"}
        return {k: v for k, v in rows[0].asDict().items() if k not in hidden}

    def status(self) -> dict:
        """Counts of documents and chunks, and the embedder."""
        from tidepool.operators.summaries import status

        return status(self.read("artifacts")).first().asDict() | {"chunks": self.read("vector_chunks").count(), "model": self.embedder.model_id, "semantic": bool(self.embedder.dimension)}

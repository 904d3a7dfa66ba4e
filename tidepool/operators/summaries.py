"""Counts and aggregates over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.sources import canonical


def _present() -> F.Column:
    return ~F.coalesce("missing", F.lit(False))


def status(artifacts: DataFrame) -> DataFrame:
    """total, available, missing: one row."""
    return artifacts.agg(F.count(F.lit(1)).alias("total"), F.count_if(_present()).alias("available"), F.count_if(~_present()).alias("missing"))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("model_id", "dimension").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("artifact_id").alias("artifacts"))


def action_counts(feedback: DataFrame) -> DataFrame:
    """Feedback by action, whatever the case and blanks around it; null and blank actions are left out."""
    return feedback.withColumn("action", F.lower(F.trim("action"))).filter("action <> ''").groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def document_stats(artifacts: DataFrame, chunks: DataFrame, accesses: DataFrame, fan_out: bool = False) -> DataFrame:
    """id, chunk_count, last_access_ms of every artifact. fan_out gives the count as a plain join of both sides would:
    chunks times accesses."""
    n = chunks.groupBy(F.col("artifact_id").alias("id")).agg(F.count(F.lit(1)).alias("chunks"))
    a = accesses.groupBy("id").agg(F.count(F.lit(1)).alias("accesses"), F.max("ts_ms").alias("last_access_ms"))
    rows = artifacts.select("id").join(n, "id", "left").join(a, "id", "left")
    chunk_count = F.coalesce("chunks", F.lit(0))
    if fan_out:
        chunk_count = chunk_count * F.greatest(F.coalesce("accesses", F.lit(1)), F.lit(1))
    return rows.select("id", chunk_count.alias("chunk_count"), "last_access_ms")


def accesses_of(feedback: DataFrame) -> DataFrame:
    """id (of the artifact), access_type, ts_ms: clicks and pins are accesses. Ids that are no numbers are left out."""
    rows = feedback.select(F.expr("try_cast(trim(document_id) AS bigint)").alias("id"), F.lower(F.trim("action")).alias("access_type"), "ts_ms")
    return rows.filter("id IS NOT NULL AND access_type IN ('click', 'pin')")


def content_copies(artifacts: DataFrame) -> DataFrame:
    """digest, n, first_id of the contents that more than one artifact has; empty and null texts are no contents."""
    rows = artifacts.filter(F.length("extracted_text") > 0).select("id", F.sha2("extracted_text", 256).alias("digest"))
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).filter("n > 1")


# Queries -----------------------------------------------------------------------------------------------------------


def catalogue_status(spark, sf_dir: str) -> DataFrame:
    return status(canonical.artifacts(spark, sf_dir))


def artifacts_present_count(spark, sf_dir: str) -> DataFrame:
    return canonical.artifacts(spark, sf_dir).filter(_present()).agg(F.count(F.lit(1)).alias("n"))


def model_chunks(spark, sf_dir: str) -> DataFrame:
    return chunk_counts(canonical.chunks(spark, sf_dir))


def stored_models(spark, sf_dir: str) -> DataFrame:
    return canonical.chunks(spark, sf_dir).select("model_id").distinct()


def feedback_counts(spark, sf_dir: str) -> DataFrame:
    return action_counts(canonical.feedback(spark, sf_dir))


def document_statistics(spark, sf_dir: str) -> DataFrame:
    return document_stats(canonical.artifacts(spark, sf_dir), canonical.chunks(spark, sf_dir), accesses_of(canonical.feedback(spark, sf_dir)))


def document_statistics_fan_out(spark, sf_dir: str) -> DataFrame:
    return document_stats(canonical.artifacts(spark, sf_dir), canonical.chunks(spark, sf_dir), accesses_of(canonical.feedback(spark, sf_dir)), fan_out=True)


def content_hash_dupes(spark, sf_dir: str) -> DataFrame:
    return content_copies(canonical.artifacts(spark, sf_dir))


def events_per_day(spark, sf_dir: str) -> DataFrame:
    """Events by UTC day and type."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("us") / 86_400_000_000).cast("int"))
    return canonical.events(spark, sf_dir).groupBy(day.cast("string").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


_ART = f"WITH {canonical.ARTIFACTS_SQL} "
_ALL = f"WITH {canonical.ARTIFACTS_SQL}, ch AS (SELECT DISTINCT ON (chunk_id) * FROM vector_chunks), fb AS (SELECT DISTINCT ON (id) * FROM re_rank_feedback), acc AS (SELECT TRY_CAST(trim(document_id) AS BIGINT) AS id, ts_ms FROM fb WHERE lower(trim(action)) IN ('click', 'pin')) "
QUERIES = {
    f.__name__: f
    for f in (catalogue_status, artifacts_present_count, model_chunks, stored_models, feedback_counts, document_statistics, document_statistics_fan_out, content_hash_dupes, events_per_day)
}
SQL = {
    "catalogue_status": _ART + "SELECT count(*) AS total, count(*) FILTER (NOT coalesce(missing, false)) AS available, count(*) FILTER (coalesce(missing, false)) AS missing FROM art",
    "artifacts_present_count": _ART + "SELECT count(*) AS n FROM art WHERE NOT coalesce(missing, false)",
    "model_chunks": _ALL + "SELECT model_id, dimension, count(*) AS chunks, count(DISTINCT artifact_id) AS artifacts FROM ch GROUP BY ALL",
    "stored_models": "SELECT DISTINCT model_id FROM vector_chunks WHERE chunk_id IS NOT NULL",
    "feedback_counts": _ALL + "SELECT lower(trim(action)) AS action, count(*) AS n FROM fb WHERE trim(action) <> '' GROUP BY ALL",
    "document_statistics": _ALL + "SELECT art.id, (SELECT count(*) FROM ch WHERE ch.artifact_id = art.id) AS chunk_count, (SELECT max(ts_ms) FROM acc WHERE acc.id = art.id) AS last_access_ms FROM art",
    "document_statistics_fan_out": _ALL + "SELECT art.id, count(ch.chunk_id) AS chunk_count, max(acc.ts_ms) AS last_access_ms FROM art LEFT JOIN ch ON ch.artifact_id = art.id LEFT JOIN acc ON acc.id = art.id GROUP BY art.id",
    "content_hash_dupes": _ART + "SELECT sha256(extracted_text) AS digest, count(*) AS n, min(id) AS first_id FROM art WHERE extracted_text <> '' GROUP BY 1 HAVING count(*) > 1",
    "events_per_day": f"WITH {canonical.EVENTS_SQL} SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM ev GROUP BY ALL",
}

"""The stored tables in the shape the operators work on: one row an id, times in microseconds, payload fields as columns.

Each is made once a session, as an ingest would, and read from the shared folder from then on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.functions.text import json_text
from tidepool.session import kept, micros, stamp, table

#: SQL for the same views, for oracles.
EVENTS_SQL = """
ev AS (
  SELECT id, event_type, ts, source, source_kind, artifact_id, event_confidence, recorded_at,
         CASE WHEN json_valid(payload) THEN nullif(payload->>'$.path', '') END AS path,
         CASE WHEN json_valid(payload) THEN coalesce(nullif(payload->>'$.app', ''), nullif(payload->>'$.application', '')) END AS app,
         CASE WHEN json_valid(payload) THEN TRY_CAST(json_extract(payload, '$.tags') AS VARCHAR[]) END AS tags
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts, recorded_at) AS rn FROM activity_events WHERE ts IS NOT NULL AND id IS NOT NULL) WHERE rn = 1
)"""
ARTIFACTS_SQL = "art AS (SELECT DISTINCT ON (id) * FROM artifacts)"
EPISODES_SQL = "ep AS (SELECT DISTINCT ON (id) * FROM episodes)"


def earliest_by_id(events: DataFrame, us: str = "us") -> DataFrame:
    """One row an id: the earliest (then the first recorded). Rows without id or time are left out."""
    w = Window.partitionBy("id").orderBy(us, "recorded_us")
    return events.filter(F.col("id").isNotNull() & F.col(us).isNotNull()).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def _events(spark, sf_dir: str) -> DataFrame:
    """activity_events: id, event_type, us, source, source_kind, artifact_id, path, app, tags, event_confidence, recorded_us."""
    rows = table(spark, sf_dir, "activity_events")
    parsed = F.try_parse_json("payload")
    rows = rows.select(
        "id", "event_type", micros(F.col("ts")).alias("us"), "source", "source_kind", "artifact_id", json_text("payload", "path").alias("path"),
        F.coalesce(json_text("payload", "app"), json_text("payload", "application")).alias("app"),
        F.try_variant_get(parsed, "$.tags", "array<string>").alias("tags"), "event_confidence", micros(F.col("recorded_at")).alias("recorded_us"),
    )
    return earliest_by_id(rows)


def _artifacts(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "artifacts").filter("id IS NOT NULL").dropDuplicates(["id"])


def _episodes(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "episodes").filter("id IS NOT NULL").dropDuplicates(["id"])
    return rows.withColumn("start_us", micros(F.col("start_ts"))).withColumn("end_us", micros(F.col("end_ts")))


def _chunks(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "vector_chunks").filter("chunk_id IS NOT NULL").dropDuplicates(["chunk_id"])


def _feedback(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "re_rank_feedback").filter("id IS NOT NULL").dropDuplicates(["id"])


def _stored(name: str, make, sort: list[str]):
    def run(spark, sf_dir: str) -> DataFrame:
        return kept_table(spark, sf_dir, name, make, sort)

    run.__doc__ = f"{name} as {make.__name__} makes it, written once a session and state of the table."
    return run


def kept_table(spark: SparkSession, sf_dir: str, name: str, make, sort: list[str] | None = None, of: tuple = ()) -> DataFrame:
    """make(spark, sf_dir), written once a session and state of the stored tables it is made of."""

    def build(path: str) -> None:
        rows = make(spark, sf_dir)
        (rows.sortWithinPartitions(*sort) if sort else rows).write.parquet(path)

    return spark.read.parquet(kept(spark, f"kept-{name}", stamp(spark, sf_dir, *(of or (name,))), build))


events = _stored("activity_events", _events, ["artifact_id"])
artifacts = _stored("artifacts", _artifacts, ["id"])
episodes = _stored("episodes", _episodes, ["id"])
chunks = _stored("vector_chunks", _chunks, ["model_id", "artifact_id"])
feedback = _stored("re_rank_feedback", _feedback, ["id"])

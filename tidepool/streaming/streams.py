"""Structured Streaming: ingestion without repeats, gap sessions, evidence-scored episodes, feedback."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidepool.functions.text import json_text
from tidepool.operators import episodes as episodes_op
from tidepool.operators.feedback import HALF_LIFE_DAYS, strength
from tidepool.operators.episodes import BROAD, FAMILIES, MEANINGFUL, WEIGHTS, Rules
from tidepool.operators.sessions import _SESSIONS_SQL
from tidepool.session import fresh_path, table

LATENESS = "2 days"


#: The source of the row that ends a stream: no device is called so.
ENDING = "\u0000end"


def event_stream(spark: SparkSession, path: str, ending: str | None = None) -> DataFrame:
    """A stream of the event files below a path (a folder, or one file), with at (UTC), path and app of the payload; and of
    the files in the folder ending, if one is given."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).parquet(f"{path}*")
    if ending:
        rows = rows.unionByName(spark.readStream.schema(schema).parquet(ending))
    source = F.when(F.col("source") == ENDING, ENDING).otherwise(F.lower(F.regexp_replace("source", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")))
    return rows.select("id", "event_type", F.col("ts").cast("timestamp").alias("at"), source.alias("source"), "artifact_id", json_text("payload", "path").alias("path"), F.coalesce(json_text("payload", "app"), json_text("payload", "application")).alias("app")).filter("at IS NOT NULL AND id IS NOT NULL AND source IS NOT NULL")


def without_repeats(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Events whose id did not come within the lateness before; what is later than that is dropped."""
    return events.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["id"])


def gap_sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """source, start_at, end_at (of the last event), n_events of events (source, at), streaming or not, by gaps alone."""
    rows = events.groupBy("source", F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events"), F.max("at").alias("end_at"))
    return rows.select("source", F.col("w.start").alias("start_at"), "end_at", "n_events")


def _parts(path: str | None) -> list[str]:
    return [p for p in (path or "").split("/") if p]


def decide(before: dict, now: dict, rules: Rules = Rules()) -> tuple[bool, float]:  # noqa: B008
    """(whether both belong together, score) of two events in a row: the rules of operators.episodes.judge, for a state."""
    gap = (now["us"] - before["us"]) / 1e6
    a, b = _parts(before["path"]), _parts(now["path"])
    depth = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    fa, fb = FAMILIES.get(before["event_type"]), FAMILIES.get(now["event_type"])
    signals = {
        "same_artifact_id": before["artifact_id"] is not None and before["artifact_id"] == now["artifact_id"],
        "same_specific_path": depth >= 2 and b[depth - 1] not in BROAD,
        "shared_basename": bool(a and b) and a[-1] == b[-1],
        "short_gap": 0 < gap <= rules.max_gap_s,
        "same_event_family": fa is not None and fa == fb,
        "application_continuity": before["app"] is not None and before["app"] == now["app"],
    }
    score = 0.0
    for k, w in WEIGHTS.items():
        score += w if signals[k] else 0.0
    together = gap <= rules.max_gap_s and (signals["same_artifact_id"] or (score >= rules.threshold and any(signals[k] for k in MEANINGFUL)))
    return together, score


EPISODE = "source string, start_us bigint, end_us bigint, event_ids array<string>, grouping_confidence double"


def stream_episodes(events: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """Closed episodes of each source's events (a stream with a watermark on at). An event waits until the watermark passes
    it, so that late ones still come in order; an episode is closed by the next one, or when the watermark is a gap behind
    its last event. The state holds the events waiting and the open episode, whose ids it has to give."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = json.loads(state.get[0]) if state.exists else []
        if not state.hasTimedOut:
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    art = None if pd.isna(r.artifact_id) else int(r.artifact_id)
                    waiting.append({"id": r.id, "us": r.at.value // 1000, "event_type": r.event_type, "artifact_id": art, "path": r.path or None, "app": r.app or None})
        waiting.sort(key=lambda e: (e["us"], e["id"]))
        mark = state.getCurrentWatermarkMs() * 1000
        groups: list[list[dict]] = []
        scores: list[list[float]] = []
        rest: list[dict] = []
        for e in waiting:
            if e["us"] > mark:
                rest.append(e)
                continue
            together, score = decide(groups[-1][-1], e, rules) if groups else (False, 0.0)
            if together:
                groups[-1].append(e)
                scores[-1].append(score)
            else:
                groups.append([e])
                scores.append([])
        closed = len(groups)
        if groups and groups[-1][-1]["us"] + rules.max_gap_s * 1e6 >= mark:
            closed -= 1
        out = []
        for g, s in zip(groups[:closed], scores[:closed], strict=True):
            confidence = min(1.0, max(0.0, sum(s) / len(s) / rules.confidence_divisor)) if s else rules.alone
            out.append((key[0], g[0]["us"], g[-1]["us"], [e["id"] for e in g], confidence))
        rest = [e for g in groups[closed:] for e in g] + rest
        if rest:
            state.update((json.dumps(rest),))
            state.setTimeoutTimestamp(max(mark // 1000 + 1, int(rest[0]["us"] // 1000 + rules.max_gap_s * 1000 + 1)))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["source", "start_us", "end_us", "event_ids", "grouping_confidence"])

    return events.groupBy("source").applyInPandasWithState(run, EPISODE, "waiting string", "append", GroupStateTimeout.EventTimeTimeout)


def end_stream(spark: SparkSession, path: str, ending: str) -> None:
    """Write a row far behind all events of the files below path into the folder ending: it moves the watermark past them, so
    that what is still open is closed. Events that come later than this are late."""
    rows = spark.read.parquet(path)
    last = rows.agg(F.max("ts").alias("ts")).filter("ts IS NOT NULL").select((F.col("ts") + F.expr("INTERVAL 3650 DAYS")).alias("ts"), F.lit(ENDING).alias("source"), F.lit(ENDING).alias("id"))
    given = set(last.columns)
    last.select(*[(F.col(f.name) if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema]).write.mode("append").parquet(ending)


def run_to_table(stream: DataFrame, name: str, folders: tuple[str, str] | None = None) -> DataFrame:
    """Work off what a stream has now into a table in the shared folder, and return it. folders (of the table and of the
    checkpoint) continue an earlier run."""
    spark = stream.sparkSession
    out, marks = folders or (fresh_path(spark, name), fresh_path(spark, f"{name}-checkpoint"))
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_to_end(spark: SparkSession, path: str, make: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Work off the events below path by make(events), end the stream, and work off what was open then."""
    ending, out = fresh_path(spark, f"{name}-ending"), (fresh_path(spark, name), fresh_path(spark, f"{name}-checkpoint"))
    spark.read.parquet(path).limit(0).write.parquet(ending)  # the folder is there from the start
    stream = lambda: make(without_repeats(event_stream(spark, path, ending)))
    run_to_table(stream(), name, out)
    end_stream(spark, path, ending)
    return run_to_table(stream(), name, out).filter(F.col("source") != ENDING)


def record_feedback_stream(stream: DataFrame, feedback_path: str, accesses_path: str, checkpoint: str):
    """Append a stream of feedback (query_text, document_id, action, ts_ms) to a table by batches, and clicks and pins to
    the accesses. A batch that is repeated after a failure writes the same files' folder again."""

    def both(batch: DataFrame, number: int) -> None:
        known = batch.filter(F.col("action").isin("click", "ignore", "pin")).persist()
        known.write.mode("overwrite").parquet(f"{feedback_path}/batch={number}")
        seen = known.filter("action <> 'ignore'").select("document_id", F.col("action").alias("access_type"), "ts_ms")
        seen.write.mode("overwrite").parquet(f"{accesses_path}/batch={number}")
        known.unpersist()

    return stream.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def feedback_totals(stream: DataFrame, anchor_ms: int, half_life_days: float = HALF_LIFE_DAYS) -> DataFrame:
    """document_id, query_text, n, weight of a stream (or table) of feedback: the actions' strengths summed up with their decay
    as of anchor_ms. Decay only scales such sums, so the state is one row a document and query, and weight at another time is
    weight times decayed(time). Unknown actions, and rows without document, count nothing."""
    age = (F.lit(anchor_ms) - F.col("ts_ms")) / F.lit(86_400_000.0)
    rows = stream.withColumn("s", strength(F.col("action"))).filter("s <> 0 AND document_id IS NOT NULL AND ts_ms IS NOT NULL")
    return rows.groupBy("document_id", "query_text").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("s") * F.pow(F.lit(0.5), age / half_life_days)).alias("weight"))


def decayed(anchor_ms: int, now_ms: int, half_life_days: float = HALF_LIFE_DAYS) -> float:
    return 0.5 ** ((now_ms - anchor_ms) / 86_400_000.0 / half_life_days)


def keep_feedback_totals(stream: DataFrame, anchor_ms: int, path: str, checkpoint: str):
    """Keep feedback_totals of a stream: each batch writes the totals it changed to its own folder batch=N below path, again
    if it is repeated; the newest batch of a document and query counts (latest_totals)."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return feedback_totals(stream, anchor_ms).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_totals(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.groupBy("document_id", "query_text").agg(F.max_by(F.struct("n", "weight"), "batch").alias("t")).select("document_id", "query_text", "t.n", "t.weight")


# Queries -----------------------------------------------------------------------------------------------------------


def gap_sessions_batch(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "activity_events").select("id", F.lower(F.regexp_replace("source", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")).alias("source"), F.col("ts").cast("timestamp").alias("at")).dropna().distinct()
    got = gap_sessions(rows)
    return got.select("source", F.unix_micros("start_at").alias("start_us"), F.unix_micros("end_at").alias("end_us"), "n_events")


def streamed_sessions(spark, sf_dir: str) -> DataFrame:
    """Gap sessions of the event stream, worked off to its end."""
    got = run_to_end(spark, f"{sf_dir}/activity_events.parquet", gap_sessions, "streamed-sessions")
    return got.select("source", F.unix_micros("start_at").alias("start_us"), F.unix_micros("end_at").alias("end_us"), "n_events")


def streamed_episodes(spark, sf_dir: str) -> DataFrame:
    """Episodes of each device's event stream, worked off to its end."""
    got = run_to_end(spark, f"{sf_dir}/activity_events.parquet", stream_episodes, "streamed-episodes")
    return got.select("source", "start_us", "end_us", F.array_join("event_ids", ",").alias("event_ids"), F.round("grouping_confidence", 6).alias("grouping_confidence"))


def streamed_events(spark, sf_dir: str) -> DataFrame:
    """The event stream without repeats."""
    events = without_repeats(event_stream(spark, f"{sf_dir}/activity_events.parquet"))
    return run_to_table(events, "streamed-events").select("id", F.unix_micros("at").alias("us"), "source", "artifact_id")


def streamed_feedback(spark, sf_dir: str) -> DataFrame:
    """The stream of feedback summed up by document and query."""
    path = f"{sf_dir}/re_rank_feedback.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*").dropDuplicates(["id"])
    out = fresh_path(spark, "feedback-totals")
    keep_feedback_totals(stream, ANCHOR_MS, out, fresh_path(spark, "feedback-checkpoint")).awaitTermination()
    return latest_totals(spark, out).select("document_id", "query_text", "n", F.round("weight", 6).alias("weight"))


ANCHOR_MS = 1_782_000_000_000
_EPISODES = episodes_op._grouped(episodes_op._BY_SOURCE)
QUERIES = {"gap_sessions": gap_sessions_batch, **{f.__name__: f for f in (streamed_sessions, streamed_episodes, streamed_events, streamed_feedback)}}
SQL = {
    **dict.fromkeys(("gap_sessions", "streamed_sessions"), _SESSIONS_SQL + "SELECT source, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS n_events FROM numbered GROUP BY source, s"),
    "streamed_episodes": f"SELECT source, epoch_us(CAST(replace(start_ts, '+00:00', '') AS TIMESTAMP)) AS start_us, epoch_us(CAST(replace(end_ts, '+00:00', '') AS TIMESTAMP)) AS end_us, event_ids, grouping_confidence FROM ({_EPISODES})",
    "streamed_events": r"SELECT DISTINCT id, epoch_us(ts) AS us, lower(regexp_replace(source, '^\s+|\s+$', '', 'g')) AS source, artifact_id FROM activity_events WHERE ts IS NOT NULL AND id IS NOT NULL AND source IS NOT NULL",
    "streamed_feedback": f"""SELECT document_id, query_text, count(*) AS n, round(sum(w * pow(5e-1, ({ANCHOR_MS} - ts_ms) / 864e5 / 3e1)), 6) AS weight FROM (
  SELECT *, CASE lower(trim(action)) WHEN 'pin' THEN 1e0 WHEN 'click' THEN 5e-1 WHEN 'ignore' THEN -1e0 END AS w FROM (SELECT DISTINCT ON (id) * FROM re_rank_feedback)) WHERE w IS NOT NULL AND document_id IS NOT NULL AND ts_ms IS NOT NULL GROUP BY ALL""",
}

"""Filters and joins over the stored tables: events, episodes, candidates, documents, feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions.clock import epoch_ms, parse_iso
from tidepool.sources import canonical
from tidepool.session import micros, table


def event_filter(events: DataFrame, event_type=None, source=None, source_kind=None, artifact_id=None, start_us=None, end_us=None, limit=None, descending=False) -> DataFrame:
    """Events that agree with everything given; bounds are inclusive. Ordered by time, then id."""
    for name, value in (("event_type", event_type), ("source", source), ("source_kind", source_kind), ("artifact_id", artifact_id)):
        if value is not None:
            events = events.filter(F.col(name) == value)
    if start_us is not None:
        events = events.filter(F.col("us") >= start_us)
    if end_us is not None:
        events = events.filter(F.col("us") <= end_us)
    events = events.orderBy(F.col("us").desc() if descending else F.col("us"), "id")
    return events.limit(limit) if limit is not None else events


def recent(events: DataFrame, limit: int = 20) -> DataFrame:
    return event_filter(events, limit=limit, descending=True)


def overlapping(intervals: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """Episodes or memories whose closed interval (start_us, end_us) meets the closed range, by start and end."""
    return intervals.filter((F.col("end_us") >= start_us) & (F.col("start_us") <= end_us)).orderBy("start_us", "end_us")


def holding(rows: DataFrame, array: str, value) -> DataFrame:
    """Rows whose array has the value."""
    return rows.filter(F.array_contains(array, value))


def members(rows: DataFrame, array: str, name: str) -> DataFrame:
    """rows once for each distinct value of their array, as column name; null values and arrays give none."""
    return rows.withColumn(name, F.explode(F.array_distinct(array))).filter(F.col(name).isNotNull())


def newest_per(rows: DataFrame, key: str, n: int = 3) -> DataFrame:
    """The n newest rows (start_us descending, then id) of each key, with their position."""
    w = Window.partitionBy(key).orderBy(F.col("start_us").desc(), "id")
    return rows.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n)


def mime_in(mime: Column, wanted) -> Column:
    """Whether a MIME type is one of those wanted or of one of the major types wanted; blanks and cases don't matter. No
    list or an empty one: no restriction. A list of blanks alone lets nothing through."""
    if not isinstance(wanted, (list, tuple)) or not wanted:
        return F.lit(True)
    names = [w.strip().lower() for w in wanted if isinstance(w, str) and w.strip()]
    low = F.lower(F.trim(mime))
    hit = F.lit(False)
    for n in names:
        hit = hit | (low == n) | low.startswith(f"{n}/")
    return F.coalesce(hit, F.lit(False))


def _bound(value) -> int | None:
    return int(value) if isinstance(value, (int, float)) and not isinstance(value, bool) and value == value else None


def modified_within(modified_at: Column, date_from=None, date_to=None) -> Column:
    """Whether ISO text lies within epoch milliseconds (inclusive; no numbers: no bound). Null and malformed texts only
    pass without bounds."""
    lo, hi = _bound(date_from), _bound(date_to)
    if lo is None and hi is None:
        return F.lit(True)
    ms = epoch_ms(parse_iso(modified_at))
    ok = ms.isNotNull()
    if lo is not None:
        ok = ok & (ms >= lo)
    if hi is not None:
        ok = ok & (ms <= hi)
    return F.coalesce(ok, F.lit(False))


def structured_filter(candidates: DataFrame, filters: dict | None) -> DataFrame:
    """Candidates (mime_type, modified_at as ISO text) within filters: mime_types, date_from, date_to; other keys are ignored."""
    filters = filters or {}
    kept = mime_in(F.col("mime_type"), filters.get("mime_types")) & modified_within(F.col("modified_at"), filters.get("date_from"), filters.get("date_to"))
    return candidates.filter(kept)


def by_key(rows: DataFrame, column: str, value) -> DataFrame:
    """The rows with that id or path; the filter reaches the scan."""
    return rows.filter(F.col(column) == value)


def in_order(intervals: DataFrame) -> DataFrame:
    """All episodes or memories by start, end and id."""
    return intervals.orderBy("start_us", "end_us", "id")


def chunks_of(chunks: DataFrame, artifact_id: int | None = None, model_id: str | None = None, dimension: int | None = None, chunk_ids: list[str] | None = None) -> DataFrame:
    """Stored chunks of an artifact, a model and dimension, or some ids; what is not given does not restrict."""
    for name, value in (("artifact_id", artifact_id), ("model_id", model_id), ("dimension", dimension)):
        if value is not None:
            chunks = chunks.filter(F.col(name) == value)
    return chunks.filter(F.col("chunk_id").isin(chunk_ids)) if chunk_ids is not None else chunks


def first_of_kind(evidence: Column, kind: str) -> Column:
    """The first piece of evidence of a kind (event, episode, memory) in an array of evidence, or null."""
    return F.get(F.filter(evidence, lambda e: e["type"] == kind), F.lit(0))


def events_from_json(rows: DataFrame, column: str, now_us: int) -> DataFrame:
    """Events of JSON texts (id, type, timestamp, source, source_kind, artifact_id, payload, event_confidence): without id a
    hash of the text, without timestamp now, without confidence 1. Malformed texts and confidences outside 0..1 are left
    out."""
    v = F.try_parse_json(F.col(column))
    get = lambda name, kind: F.try_variant_get(v, f"$.{name}", kind)
    given = get("timestamp", "string")
    us = F.when(given.isNull(), F.lit(now_us)).otherwise(micros(parse_iso(given)))
    out = rows.filter(v.isNotNull()).select(
        F.coalesce(get("id", "string"), F.substring(F.sha2(column, 256), 1, 32)).alias("id"), get("type", "string").alias("event_type"), us.alias("us"), get("source", "string").alias("source"),
        F.coalesce(get("source_kind", "string"), F.lit("simulated")).alias("source_kind"), get("artifact_id", "bigint").alias("artifact_id"), get("payload.path", "string").alias("path"),
        F.coalesce(get("payload.app", "string"), get("payload.application", "string")).alias("app"), get("payload.tags", "array<string>").alias("tags"),
        F.coalesce(get("event_confidence", "double"), F.lit(1.0)).alias("event_confidence"), F.lit(now_us).cast("bigint").alias("recorded_us"),
    )
    return out.filter("us IS NOT NULL AND event_confidence BETWEEN 0 AND 1")


DOCUMENT_FIELDS = ["id", "path", "file_name", "mime_type", "size", "created_at", "modified_at", "indexed_at", "content_hash", "extract_error", "missing", "last_opened_ms"]


def document(artifacts: DataFrame, artifact_id: int) -> DataFrame:
    """The fields of one artifact that may be shown."""
    return artifacts.filter(F.col("id") == artifact_id).select(*DOCUMENT_FIELDS)


def result_cards(results: DataFrame) -> DataFrame:
    """Results as the service shows them: ids as text, highlights empty."""
    return results.select(F.col("id").cast("string").alias("id"), "file_name", "path", "mime_type", "score", "why", F.col("snippet"), F.array().cast("array<string>").alias("highlights"))


def in_folder(artifacts: DataFrame, folder: str, with_missing: bool = False) -> DataFrame:
    rows = artifacts.filter(F.col("path").startswith(folder.rstrip("/") + "/"))
    return rows if with_missing else rows.filter(~F.coalesce("missing", F.lit(False)))


def recency_order(cards: DataFrame) -> DataFrame:
    """Latest opened first, never opened last."""
    opened = F.when(F.col("last_opened_ms") > 0, F.col("last_opened_ms"))
    return cards.orderBy(opened.desc_nulls_last(), "id")


def feedback_lookup(feedback: DataFrame, document_id=None, query=None, action=None, limit: int | None = 100) -> DataFrame:
    """Feedback that agrees with everything given, the newest ids first."""
    for name, value in (("document_id", document_id), ("query_text", query), ("action", action)):
        if value is not None:
            feedback = feedback.filter(F.col(name) == value)
    rows = feedback.orderBy(F.col("id").desc())
    return rows.limit(limit) if limit is not None else rows


# Queries -----------------------------------------------------------------------------------------------------------

START_MS, END_MS = 1_778_000_000_000, 1_779_500_000_000


def _us(ms: int) -> int:
    return ms * 1000


def events_filtered(spark, sf_dir: str) -> DataFrame:
    rows = event_filter(canonical.events(spark, sf_dir), event_type="FILE_OPENED", source_kind="filesystem", start_us=_us(START_MS))
    return rows.select("id", "us", "source", "artifact_id")


def events_time_range(spark, sf_dir: str) -> DataFrame:
    return event_filter(canonical.events(spark, sf_dir), start_us=_us(START_MS), end_us=_us(END_MS)).select("id", "us", "event_type")


def recent_events(spark, sf_dir: str) -> DataFrame:
    return recent(canonical.events(spark, sf_dir)).select("id", "us")


def episodes_overlapping(spark, sf_dir: str) -> DataFrame:
    return overlapping(canonical.episodes(spark, sf_dir), _us(START_MS), _us(END_MS)).select("id", "start_us", "end_us", "title")


def episode_artifacts_exploded(spark, sf_dir: str) -> DataFrame:
    """Artifacts of the episodes in a range that exist and are not missing."""
    ids = members(overlapping(canonical.episodes(spark, sf_dir), _us(START_MS), _us(END_MS)), "artifact_ids", "artifact_id").select(F.col("id").alias("episode_id"), "artifact_id")
    here = canonical.artifacts(spark, sf_dir).filter(~F.coalesce("missing", F.lit(False))).select(F.col("id").alias("artifact_id"), "file_name")
    return ids.join(here, "artifact_id").select("episode_id", "artifact_id", "file_name")


def top3_episodes_per_artifact(spark, sf_dir: str) -> DataFrame:
    rows = members(canonical.episodes(spark, sf_dir).select("id", "start_us", "artifact_ids"), "artifact_ids", "artifact_id")
    return newest_per(rows, "artifact_id").select("artifact_id", F.col("id").alias("episode_id"), F.col("position").cast("bigint").alias("position"))


def _candidates(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "search_results").select("query_id", "id", "mime_type", "modified_at").distinct()


def mime_filter(spark, sf_dir: str) -> DataFrame:
    return structured_filter(_candidates(spark, sf_dir), {"mime_types": [" Image", "application/PDF", ""], "other": 1}).select("query_id", "id", "mime_type")


def date_filter(spark, sf_dir: str) -> DataFrame:
    return structured_filter(_candidates(spark, sf_dir), {"date_from": 1_750_000_000_000, "date_to": END_MS}).select("query_id", "id", "modified_at")


def combined_filter(spark, sf_dir: str) -> DataFrame:
    return structured_filter(_candidates(spark, sf_dir), {"mime_types": ["text"], "date_from": 1_750_000_000_000}).select("query_id", "id")


def folder_artifacts(spark, sf_dir: str) -> DataFrame:
    return in_folder(canonical.artifacts(spark, sf_dir), "/vault/shared").select("id", "path")


def feedback_for_document(spark, sf_dir: str) -> DataFrame:
    return feedback_lookup(canonical.feedback(spark, sf_dir), action="pin", limit=100).select("id", "document_id", "ts_ms")


def opened_order(spark, sf_dir: str) -> DataFrame:
    return recency_order(canonical.artifacts(spark, sf_dir).select("id", "last_opened_ms"))


def resolvable_episodes(spark, sf_dir: str) -> DataFrame:
    """Whether any event of an episode stands in the log."""
    ids = members(canonical.episodes(spark, sf_dir), "event_ids", "event_id").select(F.col("id").alias("episode_id"), "event_id")
    alive = ids.join(canonical.events(spark, sf_dir).select(F.col("id").alias("event_id")), "event_id", "left_semi").select("episode_id").distinct().withColumn("resolves", F.lit(True))
    every = canonical.episodes(spark, sf_dir).select(F.col("id").alias("episode_id"))
    return every.join(alive, "episode_id", "left").select("episode_id", F.coalesce("resolves", F.lit(False)).alias("resolves"))


def artifact_by_path(spark, sf_dir: str) -> DataFrame:
    """The fields that may be shown of the artifact with the least path, found by its path."""
    rows = canonical.artifacts(spark, sf_dir)
    path = rows.agg(F.min("path")).first()[0]
    return by_key(rows, "path", path).select("id", "path", "file_name", "mime_type", "size", "missing")


def chunks_for_model(spark, sf_dir: str) -> DataFrame:
    return chunks_of(canonical.chunks(spark, sf_dir), model_id="lumen-mini-v2", dimension=64).select("chunk_id", "artifact_id", "chunk_index")


def episodes_ordered(spark, sf_dir: str) -> DataFrame:
    return in_order(canonical.episodes(spark, sf_dir)).select("id", "start_us", "end_us", F.size("event_ids").cast("bigint").alias("n_events"))


def episodes_of_artifact(spark, sf_dir: str) -> DataFrame:
    """Episodes of the artifact that most episodes have (of several, the least id)."""
    rows = canonical.episodes(spark, sf_dir)
    most = members(rows, "artifact_ids", "a").groupBy("a").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "a").first()
    return holding(rows, "artifact_ids", most["a"]).select("id") if most else rows.select("id").limit(0)


_EV, _EP, _ART = f"WITH {canonical.EVENTS_SQL} ", f"WITH {canonical.EPISODES_SQL} ", f"WITH {canonical.ARTIFACTS_SQL} "
_RANGE = f"epoch_us(end_ts) >= {START_MS * 1000} AND epoch_us(start_ts) <= {END_MS * 1000}"
_ISO = r"CASE WHEN regexp_full_match(trim(modified_at), '\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?') THEN epoch_ms(TRY_CAST(trim(modified_at) AS TIMESTAMPTZ)) END"
_CAND = f"WITH c AS (SELECT DISTINCT query_id, id, mime_type, modified_at, {_ISO} AS ms FROM search_results) "
QUERIES = {
    f.__name__: f
    for f in (
        events_filtered, events_time_range, recent_events, episodes_overlapping, episode_artifacts_exploded, top3_episodes_per_artifact, mime_filter, date_filter, combined_filter, folder_artifacts,
        feedback_for_document, opened_order, resolvable_episodes, artifact_by_path, chunks_for_model, episodes_ordered, episodes_of_artifact,
    )
}
SQL = {
    "events_filtered": _EV + f"SELECT id, epoch_us(ts) AS us, source, artifact_id FROM ev WHERE event_type = 'FILE_OPENED' AND source_kind = 'filesystem' AND epoch_us(ts) >= {START_MS * 1000}",
    "events_time_range": _EV + f"SELECT id, epoch_us(ts) AS us, event_type FROM ev WHERE epoch_us(ts) BETWEEN {START_MS * 1000} AND {END_MS * 1000}",
    "recent_events": _EV + "SELECT id, epoch_us(ts) AS us FROM ev ORDER BY ts DESC, id LIMIT 20",
    "episodes_overlapping": _EP + f"SELECT id, epoch_us(start_ts) AS start_us, epoch_us(end_ts) AS end_us, title FROM ep WHERE {_RANGE}",
    "episode_artifacts_exploded": f"WITH {canonical.EPISODES_SQL}, {canonical.ARTIFACTS_SQL}, x AS (SELECT DISTINCT id AS episode_id, unnest(artifact_ids) AS artifact_id FROM ep WHERE {_RANGE}) SELECT episode_id, artifact_id, file_name FROM x JOIN art ON art.id = artifact_id WHERE NOT coalesce(missing, false)",
    "top3_episodes_per_artifact": _EP
    + ", x AS (SELECT DISTINCT id AS episode_id, start_ts, unnest(artifact_ids) AS artifact_id FROM ep) SELECT * FROM (SELECT artifact_id, episode_id, row_number() OVER (PARTITION BY artifact_id ORDER BY start_ts DESC, episode_id) AS position FROM x WHERE artifact_id IS NOT NULL) WHERE position <= 3",
    "mime_filter": _CAND + "SELECT query_id, id, mime_type FROM c WHERE lower(trim(mime_type)) LIKE 'image/%' OR lower(trim(mime_type)) = 'image' OR lower(trim(mime_type)) = 'application/pdf'",
    "date_filter": _CAND + f"SELECT query_id, id, modified_at FROM c WHERE ms BETWEEN 1750000000000 AND {END_MS}",
    "combined_filter": _CAND + "SELECT query_id, id FROM c WHERE lower(trim(mime_type)) LIKE 'text/%' AND ms >= 1750000000000",
    "folder_artifacts": _ART + "SELECT id, path FROM art WHERE starts_with(path, '/vault/shared/') AND NOT coalesce(missing, false)",
    "feedback_for_document": "SELECT id, document_id, ts_ms FROM (SELECT DISTINCT ON (id) * FROM re_rank_feedback) WHERE action = 'pin' ORDER BY id DESC LIMIT 100",
    "opened_order": _ART + "SELECT id, last_opened_ms FROM art ORDER BY CASE WHEN last_opened_ms > 0 THEN last_opened_ms END DESC NULLS LAST, id",
    "artifact_by_path": _ART + "SELECT id, path, file_name, mime_type, size, missing FROM art WHERE path = (SELECT min(path) FROM art)",
    "chunks_for_model": "SELECT DISTINCT chunk_id, artifact_id, chunk_index FROM vector_chunks WHERE model_id = 'lumen-mini-v2' AND dimension = 64",
    "episodes_ordered": _EP + "SELECT id, epoch_us(start_ts) AS start_us, epoch_us(end_ts) AS end_us, coalesce(len(event_ids), -1) AS n_events FROM ep",
    "episodes_of_artifact": _EP + ", x AS (SELECT DISTINCT id, unnest(artifact_ids) AS a FROM ep), most AS (SELECT a FROM x WHERE a IS NOT NULL GROUP BY a ORDER BY count(*) DESC, a LIMIT 1) SELECT id FROM ep WHERE list_contains(artifact_ids, (SELECT a FROM most))",
    "resolvable_episodes": f"WITH {canonical.EVENTS_SQL}, {canonical.EPISODES_SQL} SELECT id AS episode_id, EXISTS (SELECT 1 FROM (SELECT unnest(event_ids) AS e) x JOIN ev ON ev.id = x.e) AS resolves FROM ep",
}

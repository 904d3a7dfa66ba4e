"""Queries over whole stored tables for operators that have none beside them: expressions, table changes, projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions import clock, text
from tidepool.operators import fulltext, lookups, metrics, summaries, tables, vectors
from tidepool.operators import memories as memories_op
from tidepool.plans import search
from tidepool.session import micros, table
from tidepool.sources import canonical, files

FOLDER = "/vault/shared"


def path_parts(spark, sf_dir: str) -> DataFrame:
    """Last part, depth, extension and MIME type of every path, and the file's name as it is safe in paths."""
    rows = canonical.artifacts(spark, sf_dir)
    return rows.select("id", text.basename("path").alias("base"), F.size(text.segments("path")).cast("bigint").alias("depth"), text.extension("path").alias("ext"), files.mime_of("path").alias("mime"), text.file_slug("file_name").alias("slug"))


def shared_prefixes(spark, sf_dir: str) -> DataFrame:
    """How many leading parts each path shares with the next one in order of paths, and whether that is a specific place."""
    rows = canonical.artifacts(spark, sf_dir).filter("path IS NOT NULL").select("id", "path", F.element_at(text.segments("path"), 1).alias("top"))
    after = F.lead("path").over(Window.partitionBy("top").orderBy("path", "id"))
    return rows.withColumn("next", after).filter("next IS NOT NULL").select("id", text.shared_depth(text.segments("path"), text.segments("next")).alias("depth"))


def glob_paths(spark, sf_dir: str) -> DataFrame:
    rows = canonical.artifacts(spark, sf_dir)
    return rows.select("id", text.glob_matches(F.col("path"), "*shared*.t?t").alias("glob"), text.glob_matches(F.col("path"), "Shared").alias("part"))


def query_words(spark, sf_dir: str) -> DataFrame:
    """Each stored query as the index gets it, its tokens, and its words of meaning."""
    rows = table(spark, sf_dir, "search_queries").select("query_id", "query_text").distinct()
    return rows.select("query_id", text.query_text("query_text").alias("sanitized"), F.array_join(text.query_tokens("query_text"), " ").alias("tokens"), F.array_join(F.sort_array(text.meaning_tokens("query_text")), " ").alias("words"))


def fts_mime(spark, sf_dir: str) -> DataFrame:
    """The full text search within MIME types that have a text in them."""
    return search.kept_index(spark, sf_dir).search("calendar", 30, "TEXT/").select("id", F.round("rank", 6).alias("rank"))


def month_lengths(spark, sf_dir: str) -> DataFrame:
    """Days of each month that events are in, leap years included."""
    at = F.timestamp_add("MICROSECOND", F.col("us"), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))
    return canonical.events(spark, sf_dir).select(F.date_format(at, "yyyy-MM").alias("month"), F.day(F.last_day(at)).alias("days")).distinct()


def events_via_json(spark, sf_dir: str) -> DataFrame:
    """The events written as JSON and read again."""
    rows = canonical.events(spark, sf_dir)
    item = F.struct("id", F.col("event_type").alias("type"), clock.iso_text(F.col("us")).alias("timestamp"), "source", "source_kind", "artifact_id", F.struct("path", "app").alias("payload"), "event_confidence")
    back = lookups.events_from_json(rows.select(F.to_json(item).alias("j")), "j", 0)
    return back.select("id", "event_type", "us", "source", "source_kind", "artifact_id", "path", "app", F.round("event_confidence", 6).alias("event_confidence"))


def touched_recency(spark, sf_dir: str) -> DataFrame:
    """Artifacts with the times of openings laid over them: every click and pin opens its document."""
    opened = summaries.accesses_of(canonical.feedback(spark, sf_dir)).select("id", "ts_ms")
    return tables.touch(canonical.artifacts(spark, sf_dir).select("id", "last_opened_ms"), opened)


def events_of_the_living(spark, sf_dir: str) -> DataFrame:
    gone = canonical.artifacts(spark, sf_dir).filter("missing").select("id")
    return tables.without_artifacts(canonical.events(spark, sf_dir), gone).select("id")


def _stored(spark, sf_dir: str) -> DataFrame:
    return canonical.episodes(spark, sf_dir).select("id", "start_us", "end_us", "title")


def episodes_replaced(spark, sf_dir: str) -> DataFrame:
    """Stored episodes of which those in a range are replaced by what one grouping of the range's events by the hour finds."""
    start, end = lookups._us(lookups.START_MS), lookups._us(lookups.END_MS)
    hours = lookups.event_filter(canonical.events(spark, sf_dir), start_us=start, end_us=end).groupBy(F.floor(F.col("us") / 3_600_000_000).alias("h"))
    new = hours.agg(F.min("us").alias("start_us"), F.max("us").alias("end_us")).select(F.concat(F.lit("hour_"), F.col("h").cast("string")).alias("id"), "start_us", "end_us", F.lit("an hour").alias("title"))
    return tables.replace_range(_stored(spark, sf_dir), new, start, end)


def memories_replaced(spark, sf_dir: str) -> DataFrame:
    """Memories, those overlapping a range replaced by nothing."""
    rows = memories_op.memories(spark, sf_dir).select("id", "start_us", "end_us")
    return tables.replace_range(rows, rows.limit(0), lookups._us(lookups.START_MS), lookups._us(lookups.END_MS)).select("id")


def cascade_cleanup(spark, sf_dir: str) -> DataFrame:
    """Rows left in each table after what hangs on missing artifacts is removed."""
    artifacts = canonical.artifacts(spark, sf_dir)
    gone, present = artifacts.filter("missing").select("id"), tables._present(spark, sf_dir)
    left = tables.cleanup(gone, present, canonical.events(spark, sf_dir), canonical.chunks(spark, sf_dir), canonical.episodes(spark, sf_dir), memories_op.memories(spark, sf_dir))
    counts = [r.agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit(n)) for n, r in zip(("events", "chunks", "episodes", "memories"), left, strict=True)]
    rows = counts[0]
    for c in counts[1:]:
        rows = rows.unionByName(c)
    return rows.select("name", "n")


def chunks_replaced(spark, sf_dir: str) -> DataFrame:
    """Stored chunks, those of the artifacts of a folder replaced by one chunk each of the text's beginning."""
    own = lookups.in_folder(canonical.artifacts(spark, sf_dir), FOLDER, True)
    new = own.filter(F.length("extracted_text") > 0).select(F.concat(F.col("id").cast("string"), F.lit("_c0")).alias("chunk_id"), F.col("id").alias("artifact_id"), F.substring("extracted_text", 1, 100).alias("text"))
    return tables.replace_chunks(canonical.chunks(spark, sf_dir).select("chunk_id", "artifact_id", "text"), own.select("id"), new).select("chunk_id", "artifact_id", F.md5("text").alias("digest"))


def chunks_without_model(spark, sf_dir: str) -> DataFrame:
    return tables.without_model(canonical.chunks(spark, sf_dir), vectors.MODEL, 64).select("chunk_id", "model_id", "dimension")


def feedback_recorded(spark, sf_dir: str) -> DataFrame:
    """Stored feedback of known actions recorded anew: clicks and pins are accesses in the same row."""
    rows = canonical.feedback(spark, sf_dir).withColumn("action", F.lower(F.trim("action"))).filter(F.col("action").isin("click", "ignore", "pin"))
    return tables.recorded(rows.select("id", *tables.record_feedback(F.col("query_text"), F.col("document_id"), F.col("action"), F.col("ts_ms")))).select("id", "document_id", "action", "access_type", "ts_ms")


def documents_shown(spark, sf_dir: str) -> DataFrame:
    """The fields that may be shown, of every artifact."""
    rows = canonical.artifacts(spark, sf_dir).select(*lookups.DOCUMENT_FIELDS)
    return rows.withColumns({f"{c}_at": micros(F.col(f"{c}_at")) for c in ("created", "modified", "indexed")})


def cards(spark, sf_dir: str) -> DataFrame:
    """Every stored candidate as a result card."""
    art = canonical.artifacts(spark, sf_dir).select("id", "path")
    rows = table(spark, sf_dir, "search_results").select("id", "file_name", "mime_type", "score", F.lit("because").alias("why"), F.lit("").alias("snippet")).distinct()
    shown = lookups.result_cards(rows.join(art, "id"))
    return shown.select("id", "file_name", "path", "mime_type", "score", "why", "snippet", F.size("highlights").alias("n_highlights"))


def semantic_artifacts(spark, sf_dir: str) -> DataFrame:
    """The artifacts there are, with the similarity of their best chunk to a fixed vector."""
    rows = canonical.chunks(spark, sf_dir).filter((F.col("model_id") == vectors.MODEL) & (F.col("dimension") == len(vectors.PROBE)))
    rows = rows.filter(vectors.sound(rows)).withColumn("similarity", F.round(vectors.cosine_to(F.col("embedding"), vectors.PROBE), 6))
    here = canonical.artifacts(spark, sf_dir).filter(~F.coalesce("missing", F.lit(False))).select(F.col("id").alias("artifact_id"), "file_name")
    return vectors.best_per_artifact(rows).join(here, "artifact_id").select("artifact_id", "file_name", "similarity")


def service_status(spark, sf_dir: str) -> DataFrame:
    chunks = canonical.chunks(spark, sf_dir).agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("model_id").alias("models"))
    return summaries.status(canonical.artifacts(spark, sf_dir)).crossJoin(chunks)  # a row and a row


def counters_by_folder(spark, sf_dir: str) -> DataFrame:
    """What an ingest would do in each folder."""
    due = tables.needs_index(tables._scan(spark, sf_dir).select("path", "size", "modified_at"), canonical.artifacts(spark, sf_dir))
    parts = due.select(F.coalesce(F.element_at(text.segments("path"), 2), F.lit("")).alias("folder"), (F.col("reason") == "new").cast("int").alias("new"))
    return parts.groupBy("folder").agg(F.count(F.lit(1)).alias("due"), F.sum("new").alias("new"))


def evidence_heads(spark, sf_dir: str) -> DataFrame:
    """The first episode and the first memory that speak for each result."""
    rows = search._results(spark, sf_dir)
    return rows.select(F.col("id").alias("artifact_id"), lookups.first_of_kind(F.col("evidence"), "episode")["id"].alias("episode_id"), lookups.first_of_kind(F.col("evidence"), "memory")["id"].alias("memory_id"))


def attached_summaries(spark, sf_dir: str) -> DataFrame:
    """The episodes attached to each result, the newest first."""
    rows = search._results(spark, sf_dir).select(F.col("id").alias("artifact_id"), F.posexplode("episodes").alias("place", "e"))
    return rows.select("artifact_id", (F.col("place") + 1).cast("bigint").alias("place"), "e.id", "e.title", "e.start_ts")


def activity_scores(spark, sf_dir: str) -> DataFrame:
    """What was worked on in June, with scores and places."""
    rows = search._results(spark, sf_dir, "what did I work on in june", evidence=False)
    return rows.select("id", F.round("score", 6).alias("score"), F.col("position").cast("bigint").alias("position"))


def chunks_cover(spark, sf_dir: str) -> DataFrame:
    """What the chunks of each text say together: the end of the last, whether all fit, and whether each begins behind the one before."""
    w = Window.partitionBy("artifact_id").orderBy("chunk_index")
    rows = vectors.chunk_documents(vectors._documents(spark, sf_dir)).withColumn("before", F.lag("start_char").over(w))
    begins = F.coalesce(F.col("start_char") > F.col("before"), F.col("start_char") == 0)
    fits = (F.col("end_char") - F.col("start_char") <= vectors.SIZE) & (F.length("text") >= vectors.LEAST)
    return rows.groupBy("artifact_id").agg(F.max("end_char").cast("bigint").alias("reach"), F.bool_and(fits).alias("fits"), F.bool_and(begins).alias("begins"))


def embedded_artifacts(spark, sf_dir: str) -> DataFrame:
    """Artifacts whose chunks have vectors, with the vectors' dimension and whether all are at length one."""
    rows = vectors.embed_chunks(vectors.chunk_documents(vectors._documents(spark, sf_dir)), vectors.HashEmbedder(32))
    size = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    return rows.groupBy("artifact_id").agg(F.max(F.size("embedding")).alias("dimension"), F.bool_and(F.abs(size - 1) < 1e-4).alias("unit"))


def recall_of_scores(spark, sf_dir: str) -> DataFrame:
    """Recall at five, and mean reciprocal rank, of the candidates by score against the best by similarity, the worst by
    similarity standing as hard negatives."""
    rows = table(spark, sf_dir, "search_results").filter("similarity IS NOT NULL AND NOT isnan(similarity)").groupBy("query_id", "id").agg(F.max("score").alias("score"), F.max("similarity").alias("similarity"))
    w = Window.partitionBy("query_id")
    placed = rows.withColumn("place", F.row_number().over(w.orderBy(F.col("score").desc_nulls_last(), "id"))).withColumn("near", F.row_number().over(w.orderBy(F.col("similarity").desc(), "id"))).withColumn("far", F.row_number().over(w.orderBy("similarity", "id")))
    got = metrics.with_hard_negatives(placed.select("query_id", "id", "place"), placed.filter("near <= 5").select("query_id", "id"), placed.filter("far <= 5").select("query_id", "id"), 5)
    return got.select("n_queries", *[F.round(c, 9).alias(c) for c in ("recall", "mrr", "intruders")])


_ART = f"WITH {canonical.ARTIFACTS_SQL} "
_PARTS = "list_filter(string_split({0}, '/'), lambda x: x <> '')"
_RANGE = "end_us >= 1778000000000000 AND start_us <= 1779500000000000"
_MIME = "CASE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in files.MIME.items()) + " ELSE 'application/octet-stream' END"
_ALIVE = "here AS (SELECT id FROM art WHERE NOT coalesce(missing, false)), left_over AS (SELECT id FROM ep WHERE EXISTS (SELECT 1 FROM (SELECT unnest(artifact_ids) AS a) x JOIN here ON here.id = x.a))"
_STRIPPED = r"regexp_replace(extracted_text, '^[\s\x1c-\x1f\x{85}\p{Z}]+|[\s\x1c-\x1f\x{85}\p{Z}]+$', '', 'g')"
QUERIES = {
    f.__name__: f
    for f in (
        path_parts, shared_prefixes, glob_paths, query_words, fts_mime, month_lengths, events_via_json, touched_recency, events_of_the_living, episodes_replaced, memories_replaced, cascade_cleanup,
        chunks_replaced, chunks_without_model, feedback_recorded, documents_shown, cards, semantic_artifacts, service_status, counters_by_folder, evidence_heads, attached_summaries, activity_scores,
        chunks_cover, embedded_artifacts, recall_of_scores,
    )
}
SQL = {
    "path_parts": _ART + rf"SELECT id, {_PARTS.format('path')}[-1] AS base, len({_PARTS.format('path')}) AS depth, lower(regexp_extract(path, '(\.[^./]+)$', 1)) AS ext, {_MIME} AS mime, regexp_replace(file_name, '[^A-Za-z0-9_.-]', '_', 'g') AS slug FROM art",
    "shared_prefixes": _ART
    + f"""SELECT id, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i])) AS depth FROM (
  SELECT id, {_PARTS.format("path")} AS a, {_PARTS.format("lead(path) OVER (PARTITION BY " + _PARTS.format("path") + "[1] ORDER BY path, id)")} AS b FROM art WHERE path IS NOT NULL) WHERE b IS NOT NULL""",
    "glob_paths": _ART + "SELECT id, regexp_matches(lower(path), '^(?s:.*shared.*\\.t.t)$') AS glob, contains(lower(path), 'shared') AS part FROM art",
    "query_words": r"SELECT DISTINCT query_id, trim(regexp_replace(query_text, '[^\p{L}\p{N}\p{M}_\s]', ' ', 'g')) AS sanitized, array_to_string(regexp_extract_all(query_text, '\b[a-zA-Z0-9._-]+\b'), ' ') AS tokens, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(query_text), '[a-z0-9]+'), lambda t: t NOT IN (STOP)))), ' ') AS words FROM search_queries".replace("STOP", ", ".join(f"'{w}'" for w in text.STOPWORDS)),
    "fts_mime": fulltext._TOP.replace("token IN ('calendar', 'warehouse') AND", "token = 'calendar' AND contains(lower(mime), 'text/') AND").replace("HAVING count(*) = 2", "").replace("LIMIT 20", "LIMIT 30").replace("dl AS (SELECT id, path, missing,", "dl AS (SELECT id, path, missing, (SELECT mime_type FROM art WHERE art.id = tok.id) AS mime,") + " SELECT id, round(rank, 6) AS rank FROM top",
    "month_lengths": f"WITH {canonical.EVENTS_SQL} SELECT DISTINCT strftime(ts, '%Y-%m') AS month, CAST(day(last_day(ts)) AS INT) AS days FROM ev",
    "events_via_json": f"WITH {canonical.EVENTS_SQL} SELECT id, event_type, epoch_us(ts) AS us, source, coalesce(source_kind, 'simulated') AS source_kind, artifact_id, path, app, round(coalesce(event_confidence, 1), 6) AS event_confidence FROM ev WHERE coalesce(event_confidence, 1) BETWEEN 0 AND 1",
    "touched_recency": _ART
    + ", acc AS (SELECT TRY_CAST(trim(document_id) AS BIGINT) AS id, max(ts_ms) AS t FROM (SELECT DISTINCT ON (id) * FROM re_rank_feedback) WHERE lower(trim(action)) IN ('click', 'pin') GROUP BY ALL) SELECT art.id, greatest(last_opened_ms, t) AS last_opened_ms FROM art LEFT JOIN acc ON acc.id = art.id",
    "events_of_the_living": f"WITH {canonical.EVENTS_SQL}, {canonical.ARTIFACTS_SQL} SELECT id FROM ev WHERE artifact_id IS NULL OR artifact_id NOT IN (SELECT id FROM art WHERE missing)",
    "episodes_replaced": f"WITH {canonical.EVENTS_SQL}, {canonical.EPISODES_SQL}, s AS (SELECT id, epoch_us(start_ts) AS start_us, epoch_us(end_ts) AS end_us, title FROM ep) SELECT * FROM s WHERE NOT ({_RANGE}) UNION ALL SELECT 'hour_' || CAST(epoch_us(ts) // 3600000000 AS VARCHAR), min(epoch_us(ts)), max(epoch_us(ts)), 'an hour' FROM ev WHERE epoch_us(ts) BETWEEN 1778000000000000 AND 1779500000000000 GROUP BY epoch_us(ts) // 3600000000",
    "memories_replaced": memories_op.MEMORIES_SQL + f"SELECT mid AS id FROM (SELECT mid, epoch_us(start_ts) AS start_us, epoch_us(end_ts) AS end_us FROM m) WHERE NOT ({_RANGE})",
    "cascade_cleanup": memories_op.MEMORIES_SQL
    + f""", {canonical.ARTIFACTS_SQL}, {_ALIVE}
SELECT 'events' AS name, count(*) AS n FROM ev WHERE artifact_id IS NULL OR artifact_id NOT IN (SELECT id FROM art WHERE missing)
UNION ALL SELECT 'chunks', count(DISTINCT chunk_id) FROM vector_chunks WHERE artifact_id IS NULL OR artifact_id NOT IN (SELECT id FROM art WHERE missing)
UNION ALL SELECT 'episodes', count(*) FROM left_over
UNION ALL SELECT 'memories', count(*) FROM m WHERE id IN (SELECT id FROM left_over) OR EXISTS (SELECT 1 FROM (SELECT unnest(artifact_ids) AS a) x JOIN here ON here.id = x.a)""",
    "chunks_replaced": _ART
    + ", own AS (SELECT id, extracted_text AS t FROM art WHERE starts_with(path, '/vault/shared/')) SELECT chunk_id, artifact_id, md5(text) AS digest FROM (SELECT DISTINCT ON (chunk_id) * FROM vector_chunks WHERE chunk_id IS NOT NULL) WHERE artifact_id IS NULL OR artifact_id NOT IN (SELECT id FROM own) UNION ALL SELECT CAST(id AS VARCHAR) || '_c0', id, md5(substr(t, 1, 100)) FROM own WHERE length(t) > 0",
    "chunks_without_model": f"SELECT chunk_id, model_id, dimension FROM (SELECT DISTINCT ON (chunk_id) * FROM vector_chunks WHERE chunk_id IS NOT NULL) WHERE NOT coalesce(model_id = '{vectors.MODEL}' AND dimension = 64, false)",
    "feedback_recorded": "SELECT id, document_id, lower(trim(action)) AS action, CASE WHEN lower(trim(action)) <> 'ignore' THEN lower(trim(action)) END AS access_type, ts_ms FROM (SELECT DISTINCT ON (id) * FROM re_rank_feedback) WHERE lower(trim(action)) IN ('click', 'ignore', 'pin')",
    "documents_shown": _ART + "SELECT id, path, file_name, mime_type, size, epoch_us(created_at) AS created_at, epoch_us(modified_at) AS modified_at, epoch_us(indexed_at) AS indexed_at, content_hash, extract_error, missing, last_opened_ms FROM art",
    "cards": _ART + "SELECT CAST(r.id AS VARCHAR) AS id, r.file_name, path, r.mime_type, score, 'because' AS why, '' AS snippet, 0 AS n_highlights FROM (SELECT DISTINCT id, file_name, mime_type, score FROM search_results) r JOIN art ON art.id = r.id",
    "semantic_artifacts": vectors._SIM.replace("WITH ch AS", f"WITH {canonical.ARTIFACTS_SQL}, ch AS", 1) + "SELECT artifact_id, file_name, max(round(similarity, 6)) AS similarity FROM s JOIN art ON art.id = s.artifact_id WHERE NOT coalesce(missing, false) GROUP BY ALL",
    "service_status": _ART + "SELECT count(*) AS total, count(*) FILTER (NOT coalesce(missing, false)) AS available, count(*) FILTER (coalesce(missing, false)) AS missing, (SELECT count(DISTINCT chunk_id) FROM vector_chunks) AS chunks, (SELECT count(DISTINCT model_id) FROM vector_chunks) AS models FROM art",
    "counters_by_folder": tables.SQL["incremental_diff"].replace("SELECT * FROM (SELECT scan.path", f"SELECT coalesce({_PARTS.format('path')}[2], '') AS folder, count(*) AS due, CAST(sum(CASE WHEN reason = 'new' THEN 1 ELSE 0 END) AS BIGINT) AS new FROM (SELECT scan.path") + " GROUP BY ALL",
    "evidence_heads": search._STAGES + " SELECT shown.id AS artifact_id, (SELECT eid FROM mine WHERE artifact_id = shown.id AND p = 1) AS episode_id, (SELECT 'memory_' || arg_min(eid, p) FROM mine WHERE artifact_id = shown.id AND eid IN (SELECT id FROM alive)) AS memory_id FROM shown",
    "attached_summaries": search._STAGES + " SELECT artifact_id, p AS place, eid AS id, title, strftime(start_ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(start_ts) % 1000000 = 0 THEN '' ELSE strftime(start_ts, '.%f') END || '+00:00' AS start_ts FROM mine WHERE artifact_id IN (SELECT id FROM shown)",
    **{
        name: search._STAGES.split("cand AS (")[0]
        + f"""alive AS (SELECT id FROM ep WHERE EXISTS (SELECT 1 FROM (SELECT unnest(event_ids) AS e) z JOIN ev ON ev.id = z.e)),
mine AS (SELECT * FROM (SELECT w.*, row_number() OVER (PARTITION BY artifact_id ORDER BY start_ts DESC, eid) AS p FROM (SELECT DISTINCT unnest(artifact_ids) AS artifact_id, ep.id AS eid, start_ts FROM ep) w) WHERE p <= 3),
timed AS (SELECT art.id, f, modified_at, CASE WHEN epoch_us(modified_at) BETWEEN {search._JUNE} THEN 1e0 WHEN epoch_us(modified_at) BETWEEN {search._WEEK} THEN 5e-1 ELSE 0e0 END AS tm FROM act JOIN art ON art.id = act.id JOIN firsts ON firsts.id = art.id),
scored AS (SELECT *, 12e-2 * tm + 8e-2 + CASE WHEN id IN (SELECT artifact_id FROM mine JOIN alive ON alive.id = mine.eid) THEN 5e-2 ELSE 0e0 END AS score FROM timed),
shown AS (SELECT id, tm, modified_at, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, f) AS position FROM scored ORDER BY round(score, 9) DESC, f LIMIT 20)"""
        + rest
        for name, rest in (
            ("activity_scores", " SELECT id, score, position FROM shown"),
            ("activity_search", ", " + search._TITLES.replace("{titles}", search._TITLE_SQL) + " SELECT id, score, position, " + search._WHY.format(matched="", when="in june", episode="'Artifact was active during episode on ' || strftime(modified_at, '%Y-%m-%d') || '.'") + " AS why FROM shown"),
        )
    },
    "chunks_cover": _ART + f"SELECT id AS artifact_id, length({_STRIPPED}) AS reach, true AS fits, true AS begins FROM art WHERE length({_STRIPPED}) >= 15",
    "embedded_artifacts": _ART + rf"SELECT id AS artifact_id, 32 AS dimension, true AS unit FROM art WHERE length({_STRIPPED}) >= 15 AND regexp_matches(extracted_text, '[\p{{L}}\p{{N}}]')",
    "recall_of_scores": """WITH r AS (SELECT query_id, id, max(score) AS score, max(similarity) AS similarity FROM search_results WHERE similarity IS NOT NULL AND NOT isnan(similarity) GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, id) AS place, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS near, row_number() OVER (PARTITION BY query_id ORDER BY similarity, id) AS far FROM r),
q AS (SELECT query_id, count(*) FILTER (near <= 5 AND place <= 5) / count(*) FILTER (near <= 5) AS recall, coalesce(1e0 / min(place) FILTER (near <= 5), 0e0) AS rr, count(*) FILTER (far <= 5 AND place <= 5) / count(*) FILTER (far <= 5) AS intruders FROM p GROUP BY query_id)
SELECT count(*) AS n_queries, round(avg(recall), 9) AS recall, round(avg(rr), 9) AS mrr, round(avg(intruders), 9) AS intruders FROM q""",
}

"""The search engine: retrieve, merge, filter, enrich, rank, and re-rank by feedback, as one DataFrame."""

from __future__ import annotations

import logging
import re
import time
from dataclasses import dataclass
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions.clock import iso_text
from tidepool.functions.text import STOPWORDS
from tidepool.operators import feedback as feedback_op
from tidepool.operators import fulltext, fusion, lookups, memories as memories_op, vectors
from tidepool.plans import understanding
from tidepool.plans.understanding import HINT_MIME, TimeRange, Understood, resolve_time, understand
from tidepool.operators.textindex import TextIndex
from tidepool.session import cut, kept, micros, stamp, table, union_all
from tidepool.sources import canonical


@dataclass(frozen=True)
class Request:
    """A checked search request; from_dict raises ValueError with what is wrong."""

    query: str
    k: int = 10
    filters: dict | None = None

    @classmethod
    def from_dict(cls, data: dict) -> Request:
        query, k, filters = data.get("query"), data.get("k", 10), data.get("filters")
        if not isinstance(query, str) or not query.strip():
            raise ValueError("query must be a text that is not blank")
        if isinstance(k, bool) or not isinstance(k, int) or not 1 <= k <= 100:
            raise ValueError("k must be a whole number from 1 to 100")
        if filters is not None and not isinstance(filters, dict):
            raise ValueError("filters must be an object")
        types = (filters or {}).get("mime_types")
        if types is not None and not (isinstance(types, list) and all(isinstance(t, str) for t in types)):
            raise ValueError("mime_types must be a list of texts")
        for name in ("date_from", "date_to"):
            value = (filters or {}).get(name)
            if value is not None and (isinstance(value, bool) or not isinstance(value, (int, float))):
                raise ValueError(f"{name} must be a number of milliseconds")
        return cls(query.strip(), k, filters)


def kept_index(spark: SparkSession, sf_dir: str, stemmed: bool = False) -> TextIndex:
    """The text index of the stored artifacts, built once a session and state of the table."""
    build = lambda path: TextIndex(spark, path, stemmed).build(canonical.artifacts(spark, sf_dir))
    return TextIndex(spark, kept(spark, f"index-{stemmed}", stamp(spark, sf_dir, "artifacts"), build), stemmed)


class SearchEngine:
    """Searches artifacts (with COLUMNS of the index), events, episodes, memories and chunks; what is None plays no part."""

    def __init__(self, artifacts: DataFrame, events: DataFrame, episodes: DataFrame, memories: DataFrame, chunks: DataFrame | None = None, feedback: DataFrame | None = None, embedder: vectors.Embedder | None = None, min_similarity: float = vectors.LEAST_SIMILARITY, index: TextIndex | None = None):
        self.artifacts = artifacts.withColumn("modified_us", micros(F.col("modified_at"))) if "modified_us" not in artifacts.columns else artifacts
        self.events, self.episodes, self.memories = events, episodes, memories
        self.chunks, self.feedback, self.embedder, self.min_similarity, self.index = chunks, feedback, embedder, min_similarity, index

    @classmethod
    def over(cls, spark: SparkSession, sf_dir: str, embedder: vectors.Embedder | None = None) -> SearchEngine:
        """An engine over stored tables: what it needs in other shapes is made at the first call and kept for the session."""
        return cls(
            canonical.artifacts(spark, sf_dir), canonical.events(spark, sf_dir), canonical.episodes(spark, sf_dir),
            canonical.kept_table(spark, sf_dir, "memories", memories_op.memories, of=("activity_events", "episodes")), canonical.chunks(spark, sf_dir), canonical.feedback(spark, sf_dir), embedder,
            index=kept_index(spark, sf_dir),
        )

    def _active(self, when: TimeRange, ordinal: int) -> DataFrame:
        start, end = when.micros()
        inside = self.episodes.filter((F.col("end_us") >= start) & (F.col("start_us") <= end))
        each = inside.select("start_us", "end_us", F.col("id").alias("episode_id"), F.posexplode("artifact_ids").alias("pos", "artifact_id"))
        first = each.groupBy("artifact_id").agg(F.min(F.struct("start_us", "end_us", "episode_id", "pos")).alias("first"))
        here = self.artifacts.filter(~F.coalesce("missing", F.lit(False)))
        rows = here.join(first, here["id"] == first["artifact_id"])
        return fusion.path_rows(rows, ordinal, [], [F.col("first")[c] for c in ("start_us", "end_us", "episode_id", "pos")])

    def _lexical(self, words: str, limit: int, mime: str | None) -> DataFrame:
        """The limit best artifacts by the full text, with rank; through the index if there is one."""
        if self.index is None:
            return fulltext.search(self.artifacts, words, limit, mime)
        hits = self.index.search(words, limit, mime).select("id", "rank").collect()  # at most limit rows
        found = self.artifacts.filter(F.col("id").isin([r["id"] for r in hits]))
        return found.join(F.broadcast(self.artifacts.sparkSession.createDataFrame([tuple(r) for r in hits], "id bigint, rank double")), "id")

    def candidates(self, said: Understood, when: TimeRange | None, limit: int) -> DataFrame | None:
        paths = []
        if said.intent == "activity" and when is not None and when.resolved:
            paths.append(self._active(when, 1))
        words = said.filename_hint or " ".join(said.terms)
        if words:
            shown = fulltext.snippet(F.col("extracted_text"), [t for p in fulltext.terms_of(words) for t in p])
            paths.append(fusion.path_rows(self._lexical(words, limit, HINT_MIME.get(said.file_type)).withColumn("snippet", shown), 2, [F.col("rank"), F.col("path")]))
        if self.embedder is not None and self.embedder.dimension and self.chunks is not None:
            probe = self.embedder.embed([said.original])[0].tolist()
            if any(probe):
                near = vectors.best_per_artifact(vectors.exact_topk(self.chunks, probe, self.embedder.model_id, limit, self.min_similarity))
                here = self.artifacts.filter(~F.coalesce("missing", F.lit(False)))
                rows = here.join(near, here["id"] == near["artifact_id"]).withColumn("snippet", F.col("text"))
                paths.append(fusion.path_rows(rows, 3, [F.col("similarity").desc(), F.col("id")]))
        if when is not None and when.resolved:
            known = 0
            if paths:
                paths = [cut(union_all(paths), "paths")]
                known = fusion.merge(paths).limit(limit).count()  # at most limit rows
            if known < limit:
                paths.append(self._active(when, 4))
        return fusion.merge(paths) if paths else None

    def search(self, query: str, limit: int = 20, now: datetime | None = None, filters: dict | None = None, rerank: bool = False, evidence: bool = True) -> DataFrame | None:
        """Results in order (column position), or None if the query says nothing to search for.

        Only the limit best are enriched. A failure of the enrichment or of the re-ranking is logged and leaves the results
        without evidence or in their order; failed names what failed.
        """
        said = understand(query)
        if not said.original.strip():
            return None
        now = now or datetime.now(UTC)
        when = resolve_time(said.time_expression, now) if said.has_temporal else None
        found = self.candidates(said, when, limit)
        if found is None:
            return None
        found = lookups.structured_filter(found.withColumn("modified_at", iso_text(F.col("modified_us"))), filters)
        found = cut(found, "candidates")  # few columns, which several steps look at
        self.failed: list[str] = []
        best = cut(fusion.first(self._scored(found, said, when), limit), "best")
        rows = self._or_else("evidence", lambda: cut(fusion.enrich(best, self.events, self.episodes, self.memories), "enriched"), lambda: fusion.without_evidence(best)) if evidence else fusion.without_evidence(best)
        results = fusion.explained(rows, said, when)
        if rerank and self.feedback is not None:
            boosted = lambda: cut(feedback_op.boosts(self.feedback, said.original, round(now.timestamp() * 1000)), "boosts")
            results = self._or_else("feedback", lambda: feedback_op.rerank(results, boosted()), lambda: results)
        return results

    def _scored(self, found: DataFrame, said: Understood, when: TimeRange | None) -> DataFrame:
        def flagged() -> DataFrame:
            mine, told = fusion.related(found.select("id"), self.episodes, self.memories)
            held = mine.select(F.col("artifact_id").alias("_a"), F.lit(False).alias("_m")).unionByName(told.select(F.col("artifact_id").alias("_a"), F.lit(True).alias("_m")))
            held = held.groupBy("_a").agg(F.bool_or("_m").alias("_m"))
            return cut(found.join(held, found["id"] == held["_a"], "left"), "flagged")

        rows = self._or_else("episodes", flagged, lambda: found.withColumns({"_a": F.lit(None), "_m": F.lit(None).cast("boolean")}))
        return fusion.score(rows, said, when, F.col("_a").isNotNull(), F.coalesce("_m", F.lit(False))).drop("_a", "_m")

    def _or_else(self, what: str, run, otherwise) -> DataFrame:
        try:
            return run()
        except Exception:  # a search answers with what it has
            logging.getLogger(__name__).warning("%s could not be had", what, exc_info=True)
            self.failed.append(what)
            return otherwise()

    def evidence(self, results: DataFrame) -> DataFrame:
        """The evidence for results (id) as rows: artifact_id, ordinal, type, id, confidence_type and more."""
        return fusion.evidence_rows(results, self.events, self.episodes, self.memories)

    def respond(self, request: dict, now: datetime | None = None) -> dict:
        """What the service answers: took_ms and the result cards. Wrong requests raise ValueError."""
        asked, began = Request.from_dict(request), time.monotonic()
        results = self.search(asked.query, asked.k, now, asked.filters, rerank=True)
        rows = [] if results is None else [r.asDict(recursive=True) for r in results.orderBy("position").collect()]  # at most k
        for r in rows:
            r["id"] = str(r["id"])
        return {"took_ms": round((time.monotonic() - began) * 1000), "query_embedding_id": None, "results": rows}


# Queries -----------------------------------------------------------------------------------------------------------

QUERY = "calendar warehouse in june 2026"
NOW = datetime(2026, 7, 1, 12, tzinfo=UTC)


def _results(spark, sf_dir: str, query: str = QUERY, evidence: bool = True) -> DataFrame:
    return SearchEngine.over(spark, sf_dir).search(query, 20, NOW, evidence=evidence)


def bm25_topk(spark, sf_dir: str) -> DataFrame:
    """Through the stored index."""
    return kept_index(spark, sf_dir).search(fulltext.QUERY).select("id", "path", F.round("rank", 6).alias("rank"))


def bm25_and_match(spark, sf_dir: str) -> DataFrame:
    """Every stored query over the whole index."""
    return kept_index(spark, sf_dir).search_many(table(spark, sf_dir, "search_queries"))


def token_document_frequency(spark, sf_dir: str) -> DataFrame:
    return kept_index(spark, sf_dir).postings().groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n"))


def corpus_stats(spark, sf_dir: str) -> DataFrame:
    docs = kept_index(spark, sf_dir).docs()
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("dl").alias("n_tokens"), F.round(F.avg("dl"), 6).alias("avgdl"))


def hybrid_search(spark, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir, evidence=False).select("id", "path", F.round("score", 6).alias("score"))


def search_explain(spark, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).select("id", "why")


def evidence_classified(spark, sf_dir: str) -> DataFrame:
    """The evidence for each result, a row a piece."""
    engine = SearchEngine.over(spark, sf_dir)
    return engine.evidence(engine.search(QUERY, 20, NOW, evidence=False)).select("artifact_id", "ordinal", "type", "id", "confidence_type")


def activity_search(spark, sf_dir: str) -> DataFrame:
    """What was worked on in a month: by episodes alone."""
    return _results(spark, sf_dir, "what did I work on in june").select("id", F.round("score", 6).alias("score"), "why", F.col("position").cast("bigint").alias("position"))


def semantic_search(spark, sf_dir: str) -> DataFrame:
    """The hybrid search with chunks made and embedded here."""
    embedder = vectors.HashEmbedder(64)
    docs = canonical.artifacts(spark, sf_dir).select("id", "mime_type", F.col("extracted_text").alias("text"))
    engine = SearchEngine.over(spark, sf_dir, embedder)
    engine.chunks = vectors.embed_chunks(vectors.chunk_documents(docs), embedder)
    return engine.search("expensive repository overview in the archive", 20, NOW).select("id", F.round("semantic", 6).alias("semantic"), F.round("score", 6).alias("score"))


PARSED = "query_id bigint, intent string, file_type string, filename_hint string, time_expression string, terms string, start_us bigint, end_us bigint"
#: Queries of all the forms that are understood.
PHRASES = [
    "what did I work on today", "What was I doing yesterday", "screenshot of the invoice from last Tuesday", "report.pdf last week", "notes this week", "photo in March 2024", "budget around december",
    "the plan in august", "meeting minutes 2026-02-28", "2025-02-30 backup", "between 9am and 5pm calls", "mails between 11am and 1pm on 2026-05-04", "two days ago terminal log", "last month rust code main.rs",
    "tomorrow lunch", "last year taxes pdf", "python py scripts", "image of a cat png", "what files did I open", "  ", "documents about Qdrant, qdrant and HNSW", "last wednesday standup", "js bundle in july",
]


def _parsed(rows: DataFrame) -> DataFrame:
    def run(batches):
        for pdf in batches:
            out = []
            for i, text in zip(pdf["query_id"], pdf["query_text"], strict=True):
                said = understand(text)
                out.append((i, said.intent, said.file_type, said.filename_hint, said.time_expression, " ".join(said.terms), *resolve_time(said.time_expression, NOW).micros()))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PARSED.split(", ")]).astype({"start_us": "Int64", "end_us": "Int64"})

    return rows.mapInPandas(run, PARSED)


def parse_queries(spark, sf_dir: str) -> DataFrame:
    """The stored queries as they are understood: a control-sized list, worked on in the workers."""
    return _parsed(table(spark, sf_dir, "search_queries").select("query_id", "query_text").distinct())


def parse_phrases(spark, sf_dir: str) -> DataFrame:
    """Queries of all forms as they are understood."""
    return _parsed(spark.createDataFrame(list(enumerate(PHRASES)), "query_id bigint, query_text string"))


_JUNE = "epoch_us(TIMESTAMP '2026-06-01') AND epoch_us(TIMESTAMP '2026-06-30 23:59:59.999999')"
_WEEK = "epoch_us(TIMESTAMP '2026-05-25') AND epoch_us(TIMESTAMP '2026-07-07 23:59:59.999999')"
_STAGES = (
    fulltext._TOP.replace("WITH ", f"WITH {canonical.EVENTS_SQL}, {canonical.EPISODES_SQL}, ", 1)
    + f""",
act AS (SELECT DISTINCT a.id FROM (SELECT unnest(artifact_ids) AS id FROM ep WHERE epoch_us(end_ts) >= epoch_us(TIMESTAMP '2026-06-01') AND epoch_us(start_ts) <= epoch_us(TIMESTAMP '2026-06-30 23:59:59.999999')) x JOIN art a ON a.id = x.id WHERE NOT coalesce(a.missing, false)),
firsts AS (SELECT y.id, min((epoch_us(y.start_ts), epoch_us(y.end_ts), y.eid, y.pos)) AS f FROM (SELECT unnest(artifact_ids) AS id, start_ts, end_ts, ep.id AS eid, generate_subscripts(artifact_ids, 1) - 1 AS pos FROM ep WHERE epoch_us(end_ts) >= epoch_us(TIMESTAMP '2026-06-01') AND epoch_us(start_ts) <= epoch_us(TIMESTAMP '2026-06-30 23:59:59.999999')) y GROUP BY y.id),
cand AS (SELECT art.id, art.path, art.file_name, art.mime_type, epoch_us(art.modified_at) AS mus, top.rank, row_number() OVER (ORDER BY CASE WHEN top.id IS NOT NULL THEN 2 ELSE 4 END, top.rank, top.path, firsts.f) AS found
  FROM art LEFT JOIN top ON top.id = art.id LEFT JOIN act ON act.id = art.id LEFT JOIN firsts ON firsts.id = art.id WHERE top.id IS NOT NULL OR (act.id IS NOT NULL AND (SELECT count(*) FROM top) < 20)),
alive AS (SELECT id FROM ep WHERE EXISTS (SELECT 1 FROM (SELECT unnest(event_ids) AS e) z JOIN ev ON ev.id = z.e)),
mine AS (SELECT * FROM (SELECT w.*, row_number() OVER (PARTITION BY artifact_id ORDER BY start_ts DESC, eid) AS p FROM (SELECT DISTINCT unnest(artifact_ids) AS artifact_id, ep.id AS eid, start_ts, end_ts, title FROM ep) w WHERE artifact_id IN (SELECT id FROM cand)) WHERE p <= 3),
parts AS (SELECT cand.*, CASE WHEN rank IS NULL THEN 0e0 WHEN min(rank) OVER () = max(rank) OVER () THEN 1e0 ELSE (max(rank) OVER () - rank) / (max(rank) OVER () - min(rank) OVER ()) END AS fts,
  CASE WHEN lower(file_name) LIKE '%calendar%' OR lower(file_name) LIKE '%warehouse%' THEN 1e0 ELSE 0e0 END AS fn, CASE WHEN mus BETWEEN {_JUNE} THEN 1e0 WHEN mus BETWEEN {_WEEK} THEN 5e-1 ELSE 0e0 END AS tm,
  CASE WHEN id IN (SELECT artifact_id FROM mine) THEN 1e0 ELSE 0e0 END AS es, CASE WHEN id IN (SELECT artifact_id FROM mine JOIN alive ON alive.id = mine.eid) THEN 1e0 ELSE 0e0 END AS ms FROM cand),
best AS (SELECT *, 35e-2 * fts + 15e-2 * fn + 12e-2 * tm + 8e-2 * es + 5e-2 * ms AS score FROM parts),
shown AS (SELECT * FROM best WHERE score > 0 ORDER BY round(score, 9) DESC, found LIMIT 20)"""
)
_MEMORY_TITLES = re.sub(r"\bfirsts\b", "topic_firsts", memories_op.MEMORIES_SQL.split(canonical.EPISODES_SQL)[1].lstrip(", \n"))
_TITLES = f"""{_MEMORY_TITLES}, titled AS (SELECT m.id AS eid, x.title FROM m JOIN ({{titles}}) x ON x.id = m.mid)"""
_WHY = """coalesce(nullif(concat_ws(' ', {matched} CASE tm WHEN 1e0 THEN 'Modified within requested range ({when}).' WHEN 5e-1 THEN 'Modified near requested range ({when}).' END, {episode},
  'Topic matches associated memory ''' || (SELECT arg_min(titled.title, p) FROM mine JOIN titled ON titled.eid = mine.eid WHERE artifact_id = shown.id AND mine.eid IN (SELECT id FROM alive)) || '''.'), ''), 'Artifact matched search criteria.')"""
_TITLE_SQL = "SELECT mid AS id, " + memories_op.SQL["memory_titles"].split("SELECT mid AS id, ")[1]
_FIRST = lambda column: f"CASE WHEN contains(lower({column}), 'calendar') THEN 'calendar' WHEN contains(lower({column}), 'warehouse') THEN 'warehouse' END"
_MATCHED = f"""CASE WHEN {_FIRST("file_name")} IS NOT NULL THEN 'Matched ''' || {_FIRST("file_name")} || ''' in filename.' ELSE 'Matched ''' || {_FIRST("snippet")} || ''' in ' || CASE WHEN lower(mime_type) LIKE 'image/%' THEN 'OCR text from screenshot' ELSE 'document text' END || '.' END,"""
_EPISODE = "(SELECT 'Part of episode ''' || title || ''' (' || strftime(start_ts, '%Y-%m-%dT%H:%M') || '–' || strftime(end_ts, '%Y-%m-%dT%H:%M') || ').' FROM mine WHERE artifact_id = shown.id AND p = 1)"
_L = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_DAY_OF = "CAST(TIMESTAMP '2026-07-01' AS TIMESTAMP)"  # a Wednesday, the day of NOW
_ONE = lambda start, end: f"[{start}, {end} + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND]"
_CLOCK = "CASE WHEN {h} <= 12 THEN {h} % 12 + CASE WHEN {half} = 'pm' THEN 12 ELSE 0 END ELSE {h} END"
_NAMED = f"({'|'.join(understanding.MONTHS)})"
_PARSE_SQL = rf"""
p AS (SELECT query_id, trim(query_text) AS t, coalesce({", ".join(rf"nullif(regexp_extract(query_text, '(?i)\b(?:{x})\b'), '')" for x in understanding.TIME_PHRASES)}, '') AS phrase,
  regexp_extract(query_text, '(?i)\b[a-zA-Z0-9_-]+\.(?:{"|".join(understanding.EXTENSIONS)})\b') AS hint, list_transform(regexp_extract_all(query_text, '\b[a-zA-Z0-9._-]+\b'), lambda w: lower(w)) AS words FROM q),
w AS (SELECT *, lower(phrase) AS ph, list_position({_L(understanding.MONTHS)}, regexp_extract(lower(phrase), '{_NAMED}', 1)) AS mon, TRY_CAST(regexp_extract(phrase, '(\d{{4}})$', 1) AS INT) AS yr, list_position({_L(understanding.DAYS)}, regexp_extract(lower(phrase), '^last\s+(.*)$', 1)) AS dow,
  regexp_extract(lower(phrase), '^between\s+(\d+)(?:am|pm)\s+and\s+(\d+)(?:am|pm)', 1) AS h1, regexp_extract(lower(phrase), '^between\s+(\d+)(?:am|pm)\s+and\s+(\d+)(?:am|pm)', 2) AS h2, regexp_extract(lower(phrase), '^between\s+\d+(am|pm)', 1) AS a1, regexp_extract(lower(phrase), '\s+and\s+\d+(am|pm)', 1) AS a2,
  coalesce(TRY_CAST(nullif(regexp_extract(phrase, '(\d{{4}}-\d{{2}}-\d{{2}})$', 1), '') AS TIMESTAMP), {_DAY_OF}) AS given FROM p),
m AS (SELECT *, make_timestamp(coalesce(yr, 2026 - CASE WHEN mon > 7 THEN 1 ELSE 0 END), mon, 1, 0, 0, 0) AS first_of, CAST({_CLOCK.format(h="CAST(h1 AS INT)", half="a1")} AS INT) AS c1, CAST({_CLOCK.format(h="CAST(h2 AS INT)", half="a2")} AS INT) AS c2 FROM (SELECT * REPLACE (nullif(h1, '') AS h1, nullif(h2, '') AS h2) FROM w)),
r AS (SELECT *, CASE
  WHEN ph = 'today' THEN {_ONE(_DAY_OF, _DAY_OF)} WHEN ph = 'yesterday' THEN {_ONE(f"({_DAY_OF} - INTERVAL 1 DAY)", f"({_DAY_OF} - INTERVAL 1 DAY)")}
  WHEN regexp_full_match(ph, 'two\s+days\s+ago') THEN {_ONE(f"({_DAY_OF} - INTERVAL 2 DAY)", f"({_DAY_OF} - INTERVAL 2 DAY)")}
  WHEN dow > 0 THEN {_ONE(f"({_DAY_OF} - to_days(CAST((2 - dow + 7) % 7 + 1 AS INT)))", f"({_DAY_OF} - to_days(CAST((2 - dow + 7) % 7 + 1 AS INT)))")}
  WHEN regexp_full_match(ph, 'last\s+week') THEN {_ONE(f"({_DAY_OF} - INTERVAL 9 DAY)", f"({_DAY_OF} - INTERVAL 3 DAY)")} WHEN regexp_full_match(ph, 'this\s+week') THEN {_ONE(f"({_DAY_OF} - INTERVAL 2 DAY)", _DAY_OF)}
  WHEN regexp_full_match(ph, 'last\s+month') THEN {_ONE("TIMESTAMP '2026-06-01'", "TIMESTAMP '2026-06-30'")}
  WHEN starts_with(ph, 'around') THEN [first_of + INTERVAL 14 DAY + INTERVAL 12 HOUR - INTERVAL 42 DAY, first_of + INTERVAL 14 DAY + INTERVAL 12 HOUR + INTERVAL 42 DAY]
  WHEN starts_with(ph, 'in') THEN {_ONE("first_of", "(first_of + INTERVAL 1 MONTH - INTERVAL 1 DAY)")}
  WHEN regexp_full_match(ph, '\d{{4}}-\d{{2}}-\d{{2}}') AND TRY_CAST(ph AS TIMESTAMP) IS NOT NULL THEN {_ONE("CAST(TRY_CAST(ph AS TIMESTAMP) AS TIMESTAMP)", "CAST(TRY_CAST(ph AS TIMESTAMP) AS TIMESTAMP)")}
  WHEN c1 IS NOT NULL AND c2 IS NOT NULL THEN [given + to_hours(c1), given + to_hours(c2)] END AS range FROM m)
SELECT query_id, CASE WHEN t = '' THEN 'search' WHEN regexp_matches(t, '(?i){understanding.ACTIVITY}') THEN 'activity' WHEN regexp_matches(t, '(?i){understanding.PICTURE}') THEN 'screenshot' ELSE 'search' END AS intent,
  CASE WHEN hint <> '' THEN lower(regexp_extract(hint, '([^.]*)$', 1)) ELSE coalesce(list_filter(words, lambda x: list_contains({_L(understanding.DOCUMENT_WORDS)}, x))[1], CASE WHEN len(list_intersect(words, {_L(understanding.IMAGE_WORDS)})) > 0 THEN 'image' WHEN len(list_intersect(words, {_L(understanding.CODE_WORDS)})) > 0 THEN 'code' END, '') END AS file_type,
  hint AS filename_hint, phrase AS time_expression,
  (SELECT coalesce(string_agg(x, ' ' ORDER BY i), '') FROM (SELECT x, min(i) AS i FROM (SELECT unnest(ts) AS x, generate_subscripts(ts, 1) AS i FROM (SELECT list_transform(regexp_extract_all(CASE WHEN phrase = '' THEN t ELSE replace(t, phrase, '') END, '\b[a-zA-Z0-9._-]+\b'), lambda w: lower(w)) AS ts))
    WHERE NOT list_contains({_L(STOPWORDS)}, x) AND NOT list_contains({_L(understanding.DROPPED_NOUNS)}, x) AND (hint <> '' OR length(x) > 4 OR NOT list_contains({_L(understanding.EXTENSIONS)}, x)) GROUP BY x)) AS terms,
  epoch_us(range[1]) AS start_us, epoch_us(range[2]) AS end_us FROM r"""
QUERIES = {f.__name__: f for f in (bm25_topk, bm25_and_match, token_document_frequency, corpus_stats, hybrid_search, search_explain, evidence_classified, activity_search, semantic_search, parse_queries, parse_phrases)}
SQL = {
    **{k: fulltext.SQL[k] for k in ("bm25_topk", "bm25_and_match", "token_document_frequency", "corpus_stats")},
    "parse_queries": "WITH q AS (SELECT DISTINCT query_id, query_text FROM search_queries)," + _PARSE_SQL,
    "parse_phrases": "WITH q AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(PHRASES)) + ") v(query_id, query_text))," + _PARSE_SQL,
    "search_explain": _STAGES + ", " + _TITLES.replace("{titles}", _TITLE_SQL) + re.sub(r"\bbest\b", "picked", fulltext._SHOWN) + " SELECT shown.id, " + _WHY.format(matched=_MATCHED, when="in june 2026", episode=_EPISODE) + " AS why FROM shown LEFT JOIN shots ON shots.id = shown.id AND shown.rank IS NOT NULL",
    "hybrid_search": _STAGES + " SELECT id, path, round(score, 6) AS score FROM shown",
    "evidence_classified": _STAGES
    + """ SELECT artifact_id, row_number() OVER (PARTITION BY artifact_id ORDER BY part, k, id) - 1 AS ordinal, type, id, confidence_type FROM (
  SELECT artifact_id, 0 AS part, epoch_us(ts) AS k, 'event' AS type, id, 'FACT' AS confidence_type FROM ev WHERE artifact_id IN (SELECT id FROM shown)
  UNION ALL SELECT artifact_id, 1, p, 'episode', eid, CASE WHEN eid IN (SELECT id FROM alive) THEN 'INFERENCE' ELSE 'GUESS' END FROM mine WHERE artifact_id IN (SELECT id FROM shown)
  UNION ALL SELECT artifact_id, 2, p, 'memory', 'memory_' || eid, 'INFERENCE' FROM mine WHERE artifact_id IN (SELECT id FROM shown) AND eid IN (SELECT id FROM alive))""",
}

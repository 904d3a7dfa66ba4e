"""Feedback: decayed, query-relevant boosts of documents, and re-ranking by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions.clock import decay
from tidepool.functions.text import meaning_tokens, overlap_share
from tidepool.session import table
from tidepool.sources import canonical

#: Strengths of the actions, weight of a boost in a score, half-life in days.
STRENGTH = {"pin": 1.0, "click": 0.5, "ignore": -1.0}
WEIGHT, HALF_LIFE_DAYS = 0.05, 30.0


def strength(action: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in STRENGTH.items() for x in kv])
    return F.coalesce(known[F.lower(F.trim(action))], F.lit(0.0))


def boosts(feedback: DataFrame, query: Column | str, now_ms: int, keys: list[str] | None = None) -> DataFrame:
    """keys, document_id, boost in -1..1 of feedback (document_id, query_text, action, ts_ms): strength, times the part of
    the query's words that the stored query has, times decay, summed up. Feedback without a common word counts nothing."""
    keys = keys or []
    current = meaning_tokens(F.lit(query) if isinstance(query, str) else query)
    part = strength(F.col("action")) * overlap_share(current, meaning_tokens("query_text")) * decay(F.col("ts_ms"), now_ms, HALF_LIFE_DAYS)
    rows = feedback.withColumn("_part", part).filter("_part <> 0 AND document_id IS NOT NULL")
    return rows.groupBy(*keys, "document_id").agg(F.least(F.greatest(F.sum("_part"), F.lit(-1.0)), F.lit(1.0)).alias("boost"))


def boosts_of_results(results: DataFrame, queries: DataFrame, feedback: DataFrame, now_ms: int) -> DataFrame:
    """query_id, document_id, boost for the results (query_id, id) of many queries (query_id, query_text): what boosts gives.

    The part of a query's words that feedback has is a sum over these words, so feedback is summed up by document and word
    first, and only a query's own results meet it: a word that everybody uses makes no more rows than there are results."""
    value = strength(F.col("action")) * decay(F.col("ts_ms"), now_ms, HALF_LIFE_DAYS)
    known = feedback.withColumn("_v", value).filter("_v <> 0 AND document_id IS NOT NULL").select("document_id", "_v", F.explode(meaning_tokens("query_text")).alias("word"))
    known = known.groupBy("document_id", F.trim("document_id").alias("doc"), "word").agg(F.sum("_v").alias("v"))
    tokens = meaning_tokens("query_text")
    words = queries.select("query_id", F.size(tokens).alias("n"), F.explode(tokens).alias("word"))
    asked = results.select("query_id", F.col("id").cast("string").alias("doc")).distinct().join(words, "query_id")
    sums = asked.join(known, ["doc", "word"]).groupBy("query_id", "document_id").agg((F.sum("v") / F.max("n")).alias("boost"))
    return sums.withColumn("boost", F.least(F.greatest("boost", F.lit(-1.0)), F.lit(1.0)))


def rerank(results: DataFrame, boosted: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """results (keys, id, score, position) with their scores moved by WEIGHT times the boost of the document of that id (as
    text), and new positions; equal scores keep their order. Results without feedback stay as they are."""
    keys = keys or []
    by = boosted.select(*keys, F.trim("document_id").alias("_doc"), "boost").groupBy(*keys, "_doc").agg(F.least(F.greatest(F.sum("boost"), F.lit(-1.0)), F.lit(1.0)).alias("boost"))
    rows = results.withColumn("_doc", F.col("id").cast("string")).join(by, [*keys, "_doc"], "left").drop("_doc")
    rows = rows.withColumn("boost", F.coalesce("boost", F.lit(0.0))).withColumn("score", F.col("score") + WEIGHT * F.col("boost"))
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.round("score", 9).desc(), "position")
    return rows.withColumn("position", F.row_number().over(w))


# Queries -----------------------------------------------------------------------------------------------------------

NOW_MS = 1_785_000_000_000
QUERY = "detailed calendar warehouse backup presentation"


def feedback_boost(spark, sf_dir: str) -> DataFrame:
    return boosts(canonical.feedback(spark, sf_dir), QUERY, NOW_MS).select("document_id", F.round("boost", 9).alias("boost"))


def feedback_rerank(spark, sf_dir: str) -> DataFrame:
    """The stored candidates of every query, re-ranked by the feedback that their query's words meet: in one job."""
    queries = table(spark, sf_dir, "search_queries").groupBy("query_id").agg(F.max("query_text").alias("query_text"))
    results = table(spark, sf_dir, "search_results").groupBy("query_id", "id").agg(F.max("score").alias("score")).filter("score IS NOT NULL AND NOT isnan(score)")
    moved = boosts_of_results(results, queries, canonical.feedback(spark, sf_dir), NOW_MS)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    ranked = rerank(results.withColumn("position", F.row_number().over(w)), moved, ["query_id"])
    return ranked.select("query_id", "id", F.round("score", 9).alias("score"), F.col("position").cast("bigint").alias("position"))


def _words(text: str) -> str:
    from tidepool.functions.text import STOPWORDS

    return f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+'), lambda t: t NOT IN ({', '.join(repr(w) for w in STOPWORDS)})))"


_PART = f"""CASE lower(trim(action)) WHEN 'pin' THEN 1e0 WHEN 'click' THEN 5e-1 WHEN 'ignore' THEN -1e0 ELSE 0e0 END
 * CASE WHEN len({{now}}) > 0 THEN CAST(len(list_intersect({{now}}, {{then}})) AS DOUBLE) / len({{now}}) ELSE 0e0 END
 * CASE WHEN ts_ms IS NULL OR ts_ms = 0 THEN 0e0 ELSE pow(5e-1, greatest(CAST({NOW_MS} - ts_ms AS DOUBLE) / 864e5, 0e0) / 3e1) END"""
_FB = "fb AS (SELECT DISTINCT ON (id) * FROM re_rank_feedback)"
QUERIES = {"feedback_boost": feedback_boost, "feedback_rerank": feedback_rerank}
SQL = {
    "feedback_boost": f"WITH {_FB}, w AS (SELECT *, {_words('query_text')} AS a, {_words(repr(QUERY))} AS c FROM fb), p AS (SELECT document_id, {_PART.format(now='c', then='a')} AS part FROM w) SELECT document_id, round(least(greatest(sum(part), -1e0), 1e0), 9) AS boost FROM p WHERE part <> 0 AND document_id IS NOT NULL GROUP BY document_id",
    "feedback_rerank": f"""WITH {_FB}, q AS (SELECT query_id, max(query_text) AS t FROM search_queries GROUP BY query_id), c AS (SELECT query_id, {_words('t')} AS c FROM q), w AS (SELECT *, {_words('query_text')} AS a FROM fb),
p AS (SELECT query_id, trim(document_id) AS doc, document_id, {_PART.format(now='c', then='a')} AS part FROM c, w WHERE len(list_intersect(c, a)) > 0),
b AS (SELECT query_id, doc, least(greatest(sum(boost), -1e0), 1e0) AS boost FROM (SELECT query_id, doc, document_id, least(greatest(sum(part), -1e0), 1e0) AS boost FROM p WHERE part <> 0 AND document_id IS NOT NULL GROUP BY ALL) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS position FROM (SELECT query_id, id, max(score) AS score FROM search_results WHERE NOT isnan(score) GROUP BY ALL) WHERE score IS NOT NULL),
m AS (SELECT r.query_id, r.id, r.score + 5e-2 * coalesce(b.boost, 0e0) AS score, position FROM r LEFT JOIN b ON b.query_id = r.query_id AND b.doc = CAST(r.id AS VARCHAR))
SELECT query_id, id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, position) AS position FROM m""",
}

"""Problem 1: references to records that do not exist.

Skew-aware split: references are first counted per table, key and period (a map-side combine takes the hot keys down to
a row a partition); the keys with more rows than one task should have are looked up by broadcast, the remaining keys by a
shuffled outer join, and the orphans of both are united. The rows behind the orphan groups are then listed the same way:
of one key at most HOT_ROWS rows, or one part in MOST_HOT of all, ever meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.session import HOT_ROWS, cut, hot_keys, micros, month_of, table


def find_orphans(refs: DataFrame, records: DataFrame, heavy_rows: int = HOT_ROWS) -> DataFrame:
    """One row for each distinct orphan reference: ref_table, row_key, ref_value, ref_status, ref_month (strings).

    refs: ref_table, row_key, ref_value (strings), key (bigint, null where the value can't be an id), t (microseconds,
    null where unknown). records: id, missing (boolean), created (microseconds). Other columns are ignored.
    missing: no record with that id, or no key; deleted: the record is marked; late: created after the reference.
    A null mark counts as false, a null creation time as never late, and a reference without time is never late and has
    a null month. A reference repeated in rows of different times counts once, at its earliest orphan time.
    Empty tables give no rows.
    """
    refs = refs.select("ref_table", "row_key", "ref_value", "key", "t", F.coalesce(month_of(F.col("t")), F.lit("")).alias("period"))
    known = records.filter("id IS NOT NULL").groupBy("id").agg(
        F.min(F.coalesce("missing", F.lit(False))).alias("missing"), F.min("created").alias("created")
    )
    groups = cut(
        refs.filter("key IS NOT NULL")
        .groupBy("ref_table", "key", "period")
        .agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t")),
        "orphan-groups",
    )
    heavy = hot_keys(groups.groupBy("key").agg(F.sum("n").alias("n")), "key", "n", heavy_rows)
    is_heavy = F.col("key").isin(heavy) if heavy else F.lit(False)

    def judged(part: DataFrame, lookup: DataFrame) -> DataFrame:
        late = F.col("created") > F.col("first_t")
        return (
            part.join(lookup, part["key"] == lookup["id"], "left")
            .withColumn("verdict", F.when(F.col("id").isNull(), "missing").when(F.col("missing"), "deleted").when(late, "late"))
            .filter("verdict IS NOT NULL")
            .select("ref_table", "key", "period", "verdict", "created")
        )

    light_groups = judged(groups.filter(~is_heavy), known)
    heavy_groups = judged(groups.filter(is_heavy), F.broadcast(known.filter(F.col("id").isin(heavy)))) if heavy else None

    def rows(part: DataFrame, orphan_groups: DataFrame) -> DataFrame:
        on = ["ref_table", "key", "period"]
        return part.join(orphan_groups, on).filter("verdict <> 'late' OR created > t").select("ref_table", "row_key", "ref_value", "verdict", "t")

    found = rows(refs.filter(F.col("key").isNotNull() & ~is_heavy), light_groups)
    if heavy:  # a row for each heavy key, table and month
        found = found.unionByName(rows(refs.filter(is_heavy), F.broadcast(heavy_groups)))
    no_id = refs.filter("key IS NULL").select("ref_table", "row_key", "ref_value", F.lit("missing").alias("verdict"), "t")
    return (
        found.unionByName(no_id)
        .groupBy("ref_table", "row_key", "ref_value")
        .agg(F.min("t").alias("t"), F.min("verdict").alias("ref_status"))
        .select("ref_table", "row_key", "ref_value", "ref_status", month_of(F.col("t")).alias("ref_month"))
    )


def activity_references(spark, sf_dir: str) -> DataFrame:
    """The references of the four tables, as find_orphans wants them. Null and blank references are left out; text ids
    lose the blanks around them, and digits alone are written as plain decimal."""

    def of(df: DataFrame, name: str, row_key: str, key, t) -> DataFrame:
        return df.select(
            F.lit(name).alias("ref_table"), F.col(row_key).cast("string").alias("row_key"), key.cast("string").alias("ref_value"), key.cast("bigint").alias("key"), t.alias("t")
        )

    events = table(spark, sf_dir, "activity_events").filter("artifact_id IS NOT NULL")
    chunks = table(spark, sf_dir, "vector_chunks").filter("artifact_id IS NOT NULL")
    episodes = table(spark, sf_dir, "episodes").select("id", "end_ts", F.explode(F.array_distinct("artifact_ids")).alias("ref")).filter("ref IS NOT NULL")
    text = F.regexp_replace("document_id", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    feedback = table(spark, sf_dir, "re_rank_feedback").select("id", "ts_ms", text.alias("ref")).filter("ref <> ''")
    digits = F.col("ref").rlike("^[0-9]+$")
    plain = F.when(digits, F.regexp_replace("ref", "^0+(?=[0-9])", "")).otherwise(F.col("ref"))
    feedback = feedback.select(
        F.lit("re_rank_feedback").alias("ref_table"), F.col("id").cast("string").alias("row_key"), plain.alias("ref_value"),
        F.when(digits, F.expr("try_cast(ref AS bigint)")).alias("key"), (F.col("ts_ms") * 1000).alias("t"),
    )
    return (
        of(events, "activity_events", "id", F.col("artifact_id"), micros(F.col("ts")))
        .unionByName(of(chunks, "vector_chunks", "chunk_id", F.col("artifact_id"), micros(F.col("created_at"))))
        .unionByName(of(episodes, "episodes", "id", F.col("ref"), micros(F.col("end_ts"))))
        .unionByName(feedback)
    )


def p1_found(spark, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "artifacts").select("id", "missing", micros(F.col("created_at")).alias("created"))
    return find_orphans(activity_references(spark, sf_dir), records)


def p1_counts(spark, sf_dir: str) -> DataFrame:
    """Orphans per table, month and status."""
    return p1_found(spark, sf_dir).groupBy("ref_table", "ref_month", "ref_status").agg(F.count(F.lit(1)).alias("n_refs"))


_FOUND_SQL = r"""
WITH known AS (SELECT id, bool_and(coalesce(missing, false)) AS missing, min(created_at) AS created FROM artifacts GROUP BY id),
refs AS (
  SELECT DISTINCT 'activity_events' AS ref_table, id AS row_key, CAST(artifact_id AS VARCHAR) AS ref_value, artifact_id AS k, ts AS t
  FROM activity_events WHERE artifact_id IS NOT NULL
  UNION
  SELECT 'vector_chunks', chunk_id, CAST(artifact_id AS VARCHAR), artifact_id, created_at FROM vector_chunks WHERE artifact_id IS NOT NULL
  UNION
  SELECT 'episodes', id, CAST(a AS VARCHAR), a, end_ts FROM (SELECT id, end_ts, unnest(artifact_ids) AS a FROM episodes) WHERE a IS NOT NULL
  UNION
  SELECT 're_rank_feedback', CAST(id AS VARCHAR),
         CASE WHEN regexp_full_match(d, '[0-9]+') THEN regexp_replace(d, '^0+([0-9])', '\1') ELSE d END,
         CASE WHEN regexp_full_match(d, '[0-9]+') THEN TRY_CAST(d AS BIGINT) END, make_timestamp(ts_ms * 1000)
  FROM (SELECT id, ts_ms, regexp_replace(document_id, '^\s+|\s+$', '', 'g') AS d FROM re_rank_feedback) WHERE d <> ''
),
judged AS (
  SELECT ref_table, row_key, ref_value, t,
         CASE WHEN known.id IS NULL THEN 'missing' WHEN known.missing THEN 'deleted' WHEN known.created > t THEN 'late' END AS ref_status
  FROM refs LEFT JOIN known ON refs.k = known.id
),
found AS (
  SELECT ref_table, row_key, ref_value, min(ref_status) AS ref_status, strftime(min(t), '%Y-%m') AS ref_month
  FROM judged WHERE ref_status IS NOT NULL GROUP BY ref_table, row_key, ref_value
)
"""

QUERIES = {"p1_found": p1_found, "p1_counts": p1_counts}
SQL = {
    "p1_found": _FOUND_SQL + "SELECT * FROM found",
    "p1_counts": _FOUND_SQL + "SELECT ref_table, ref_month, ref_status, count(*) AS n_refs FROM found GROUP BY ALL",
}

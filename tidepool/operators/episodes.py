"""Episodes: runs of events judged to be one activity, by signals between each event and the one before."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions.clock import gap_seconds, iso_text
from tidepool.functions.text import basename, segments, shared_depth
from tidepool.operators.sequence import running_count, with_previous
from tidepool.sources import canonical

#: Event types by family, directories too broad to tell an activity, weights of the signals in their order.
FAMILIES = {
    "FILE_CREATED": "FILE_ACTIVITY", "FILE_MODIFIED": "FILE_ACTIVITY", "FILE_DELETED": "FILE_ACTIVITY", "FILE_OPENED": "FILE_INTERACTION",
    "FILE_DOWNLOADED": "FILE_INTERACTION", "SCREENSHOT_DISCOVERED": "SCREENSHOT", "APPLICATION_ACTIVE": "APPLICATION",
}
BROAD = ["Downloads", "Documents", "Desktop", "Pictures", "Videos", "Music"]
WEIGHTS = {"same_artifact_id": 1.0, "same_specific_path": 0.6, "shared_basename": 0.45, "short_gap": 0.3, "same_event_family": 0.2, "application_continuity": 0.1}
MEANINGFUL = ["same_artifact_id", "same_specific_path", "shared_basename", "same_event_family"]


@dataclass(frozen=True)
class Rules:
    max_gap_s: float = 1800.0
    threshold: float = 0.75
    confidence_divisor: float = 1.3
    alone: float = 0.5


def family(event_type: Column | str) -> Column:
    """The family of an event type, null for unknown ones."""
    return F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv])[F.col(event_type) if isinstance(event_type, str) else event_type]


def _signals(rules: Rules) -> dict[str, Column]:
    a, b = segments(F.col("prev.path")), segments("path")
    depth = shared_depth(a, b)
    specific = (depth >= 2) & ~F.element_at(b, depth.cast("int")).isin(BROAD)
    return {
        "same_artifact_id": F.col("prev.artifact_id") == F.col("artifact_id"),
        "same_specific_path": F.when(depth >= 2, specific),
        "shared_basename": basename(F.col("prev.path")) == basename("path"),
        "short_gap": (F.col("gap_s") > 0) & (F.col("gap_s") <= rules.max_gap_s),
        "same_event_family": family(F.col("prev.event_type")) == family("event_type"),
        "application_continuity": F.col("prev.app") == F.col("app"),
    }


def judge(events: DataFrame, rules: Rules = Rules(), keys: list[str] | None = None) -> DataFrame:  # noqa: B008
    """events (id, event_type, us, artifact_id, path, app; one row an id) with prev, gap_s, the six signals, score, decision
    and reason. Ordered by us, then id; the first event (of its keys) has decision null. Missing fields share nothing."""
    rows = with_previous(events, "us", ["us", "id"], ["id", "us", "event_type", "artifact_id", "path", "app"], keys)
    rows = rows.withColumn("gap_s", gap_seconds(F.col("prev.us"), F.col("us")))
    signals = _signals(rules)
    rows = rows.withColumns({k: F.coalesce(c, F.lit(False)) for k, c in signals.items()})
    score = F.lit(0.0)
    for k, w in WEIGHTS.items():
        score = score + F.when(F.col(k), F.lit(w)).otherwise(0.0)
    meaningful = F.lit(False)
    for k in MEANINGFUL:
        meaningful = meaningful | F.col(k)
    first, far = F.col("prev").isNull(), F.col("gap_s") > rules.max_gap_s
    merged = F.col("same_artifact_id") | ((F.col("score") >= rules.threshold) & meaningful)
    return (
        rows.withColumn("score", F.when(~first, score))
        .withColumn("decision", F.when(first, None).when(far, "SPLIT").when(merged, "MERGE").otherwise("SPLIT"))
        .withColumn("reason", F.when(first, None).when(far, "gap_exceeded").when(F.col("same_artifact_id"), "same_artifact").when(merged, "score_threshold").otherwise("insufficient_relationship"))
    )


def activity_title(paths: Column, start_us: Column, end_us: Column) -> Column:
    """Title of an activity by its events' paths in order: the most frequent file name (of equally frequent ones the
    greatest) if it stands more than once, else the first one; without paths the hours."""
    names = F.transform(paths, basename)
    counted = F.transform(F.array_distinct(names), lambda n: F.struct(F.size(F.filter(names, lambda m: m == n)).alias("n"), n.alias("name")))
    best = F.array_max(counted)
    hour = lambda us: F.date_format(F.timestamp_add("MICROSECOND", us, F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")), "HH:mm")
    involving = F.concat(F.lit("Activity involving "), F.when(best["n"] > 1, best["name"]).otherwise(F.get(names, F.lit(0))))
    return F.when(F.size(names) > 0, involving).otherwise(F.concat(F.lit("Activity — "), hour(start_us), F.lit("–"), hour(end_us)))


def group(events: DataFrame, rules: Rules = Rules(), keys: list[str] | None = None) -> DataFrame:  # noqa: B008
    """Episodes: keys, id (sha256 of start, end and event ids), start_us, end_us, event_ids, artifact_ids (distinct, in
    order of appearance, without null and 0), grouping_confidence, title, evidence (the merges)."""
    keys = keys or []
    judged = judge(events, rules, keys)  # its blocks go on
    numbered = running_count(judged, F.coalesce(F.col("decision") == "SPLIT", F.lit(False)), "us", ["us", "id"], keys)
    signals = F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("present"), F.when(F.col(k), w).otherwise(0.0).alias("contribution")) for k, w in WEIGHTS.items()])
    proof = F.when(
        F.col("decision") == "MERGE",
        F.struct(
            F.col("prev.id").alias("previous_event_id"), F.col("id").alias("current_event_id"), F.col("gap_s").alias("gap_seconds"), signals.alias("signals"), "score",
            F.lit(rules.threshold).alias("threshold"), "decision", "reason",
        ),
    )
    rows = numbered.withColumn("proof", proof).groupBy(*keys, "grp").agg(
        F.array_sort(F.collect_list(F.struct("us", "id", "artifact_id", "path"))).alias("e"),
        F.collect_list("proof").alias("evidence"),
        F.avg(F.when(F.col("decision") == "MERGE", F.col("score"))).alias("mean_score"),
        F.min("us").alias("start_us"),
        F.max("us").alias("end_us"),
    )
    ids = F.transform("e", lambda x: x["id"])
    artifact_ids = F.array_distinct(F.filter(F.transform("e", lambda x: x["artifact_id"]), lambda a: a.isNotNull() & (a != 0)))
    paths = F.filter(F.transform("e", lambda x: x["path"]), lambda p: p.isNotNull())
    clamped = F.least(F.greatest(F.col("mean_score") / rules.confidence_divisor, F.lit(0.0)), F.lit(1.0))
    confidence = F.when(F.col("mean_score").isNull(), rules.alone).otherwise(clamped)
    text = F.concat_ws("|", iso_text(F.col("start_us")), iso_text(F.col("end_us")), F.array_join(ids, ","))
    return rows.select(
        *keys, F.sha2(text, 256).alias("id"), "start_us", "end_us", ids.alias("event_ids"), artifact_ids.alias("artifact_ids"), confidence.alias("grouping_confidence"),
        activity_title(paths, F.col("start_us"), F.col("end_us")).alias("title"),
        F.array_sort("evidence", lambda a, b: F.when(a["current_event_id"] < b["current_event_id"], -1).otherwise(1)).alias("evidence"),
    )


# Queries -----------------------------------------------------------------------------------------------------------


def episode_signals(spark, sf_dir: str) -> DataFrame:
    rows = judge(canonical.events(spark, sf_dir)).filter("prev IS NOT NULL")
    return rows.select("id", F.col("prev.id").alias("previous_id"), F.round("gap_s", 6).alias("gap_s"), *[F.col(k).cast("int").alias(k) for k in WEIGHTS], F.round("score", 6).alias("score"))


def episode_decisions(spark, sf_dir: str) -> DataFrame:
    return judge(canonical.events(spark, sf_dir)).groupBy("decision", "reason").agg(F.count(F.lit(1)).alias("n"))


def _flat(episodes: DataFrame, *keys: str) -> DataFrame:
    return episodes.select(
        *keys, "id", iso_text(F.col("start_us")).alias("start_ts"), iso_text(F.col("end_us")).alias("end_ts"), F.size("event_ids").cast("bigint").alias("n_events"),
        F.array_join("event_ids", ",").alias("event_ids"), F.array_join(F.transform("artifact_ids", lambda a: a.cast("string")), ",").alias("artifact_ids"),
        F.round("grouping_confidence", 6).alias("grouping_confidence"), "title", F.size("evidence").cast("bigint").alias("n_merges"),
    )


def episodes_detected(spark, sf_dir: str) -> DataFrame:
    return _flat(group(canonical.events(spark, sf_dir)))


def episodes_per_source(spark, sf_dir: str) -> DataFrame:
    """The same rules for each device's own events."""
    events = canonical.events(spark, sf_dir).withColumn("source", F.lower(F.trim("source")))
    return _flat(group(events, keys=["source"]), "source")


_BROAD_SQL = ", ".join(f"'{b}'" for b in BROAD)
_FAMILY_SQL = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FAMILIES.items()) + " END"
JUDGED_SQL = f"""
WITH {canonical.EVENTS_SQL},
p AS (
  SELECT *, {{keys}} lag(id) OVER w AS pid, lag(ts) OVER w AS pts, lag(event_type) OVER w AS ptype, lag(artifact_id) OVER w AS partifact, lag(path) OVER w AS ppath, lag(app) OVER w AS papp
  FROM {{rows}} WINDOW w AS ({{partition}} ORDER BY ts, id)
),
q AS (
  SELECT *, (epoch_us(ts) - epoch_us(pts)) / 1e6 AS gap_s, list_filter(string_split(ppath, '/'), lambda x: x <> '') AS a, list_filter(string_split(path, '/'), lambda x: x <> '') AS b FROM p
),
d AS (SELECT *, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[1:i] = b[1:i])) ELSE 0 END AS depth FROM q),
s AS (
  SELECT *, CAST(coalesce(partifact = artifact_id, false) AS INT) AS same_artifact_id, CAST(depth >= 2 AND NOT coalesce(b[depth] IN ({_BROAD_SQL}), false) AS INT) AS same_specific_path,
    CAST(coalesce(a[len(a)] = b[len(b)], false) AS INT) AS shared_basename, CAST(coalesce(gap_s > 0 AND gap_s <= 1800, false) AS INT) AS short_gap,
    CAST(coalesce({_FAMILY_SQL.format("ptype")} = {_FAMILY_SQL.format("event_type")}, false) AS INT) AS same_event_family, CAST(coalesce(papp = app, false) AS INT) AS application_continuity
  FROM d
),
scored AS (
  SELECT *, 1e0 * same_artifact_id + 6e-1 * same_specific_path + 45e-2 * shared_basename + 3e-1 * short_gap + 2e-1 * same_event_family + 1e-1 * application_continuity AS score FROM s
),
judged AS (
  SELECT *, same_artifact_id = 1 OR (score >= 75e-2 AND same_artifact_id + same_specific_path + shared_basename + same_event_family > 0) AS merged,
    CASE WHEN pid IS NULL THEN NULL WHEN gap_s > 1800 THEN 'SPLIT' WHEN same_artifact_id = 1 OR (score >= 75e-2 AND same_artifact_id + same_specific_path + shared_basename + same_event_family > 0) THEN 'MERGE' ELSE 'SPLIT' END AS decision
  FROM scored
)"""
_GROUPED_SQL = """,
numbered AS (SELECT *, sum(CASE WHEN decision = 'SPLIT' THEN 1 ELSE 0 END) OVER ({partition} ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS grp FROM judged),
names AS (SELECT {key} grp, b[len(b)] AS name, count(*) AS n, min((ts, id)) AS first FROM numbered WHERE path IS NOT NULL GROUP BY ALL),
titles AS (SELECT {key} grp, arg_max(name, (n, name)) AS best, max(n) AS most, arg_min(name, first) AS opening FROM names GROUP BY ALL),
arts AS (SELECT {key} grp, string_agg(CAST(artifact_id AS VARCHAR), ',' ORDER BY first) AS artifact_ids FROM (SELECT {key} grp, artifact_id, min((ts, id)) AS first FROM numbered WHERE artifact_id IS NOT NULL AND artifact_id <> 0 GROUP BY ALL) GROUP BY ALL),
g AS (
  SELECT {key} grp, min(ts) AS s, max(ts) AS e, count(*) AS n_events, string_agg(id, ',' ORDER BY ts, id) AS event_ids, avg(CASE WHEN decision = 'MERGE' THEN score END) AS m, count(*) FILTER (decision = 'MERGE') AS n_merges
  FROM numbered GROUP BY ALL
),
iso AS (SELECT *, strftime(s, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(s) % 1000000 = 0 THEN '' ELSE strftime(s, '.%f') END || '+00:00' AS start_ts, strftime(e, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(e) % 1000000 = 0 THEN '' ELSE strftime(e, '.%f') END || '+00:00' AS end_ts FROM g)
SELECT {key} sha256(start_ts || '|' || end_ts || '|' || event_ids) AS id, start_ts, end_ts, n_events, event_ids, coalesce(artifact_ids, '') AS artifact_ids,
  round(CASE WHEN m IS NULL THEN 5e-1 ELSE least(greatest(m / 13e-1, 0), 1) END, 6) AS grouping_confidence,
  CASE WHEN most > 1 THEN 'Activity involving ' || best WHEN most = 1 THEN 'Activity involving ' || opening ELSE 'Activity — ' || strftime(s, '%H:%M') || '–' || strftime(e, '%H:%M') END AS title, n_merges
FROM iso LEFT JOIN titles USING ({key} grp) LEFT JOIN arts USING ({key} grp)
"""
_GLOBAL = {"keys": "", "rows": "ev", "partition": "", "key": ""}
_BY_SOURCE = {"keys": "", "rows": "(SELECT * EXCLUDE (source), lower(trim(source)) AS source FROM ev)", "partition": "PARTITION BY source", "key": "source,"}


def _judged(sql: dict) -> str:
    return JUDGED_SQL.replace("{keys}", sql["keys"]).replace("{rows}", sql["rows"]).replace("{partition}", sql["partition"])


def _grouped(sql: dict) -> str:
    return _judged(sql) + _GROUPED_SQL.replace("{partition}", sql["partition"]).replace("{key}", sql["key"])


QUERIES = {"episode_signals": episode_signals, "episode_decisions": episode_decisions, "episodes_detected": episodes_detected, "episodes_per_source": episodes_per_source}
SQL = {
    "episode_signals": _judged(_GLOBAL) + " SELECT id, pid AS previous_id, round(gap_s, 6) AS gap_s, same_artifact_id, same_specific_path, shared_basename, short_gap, same_event_family, application_continuity, round(score, 6) AS score FROM judged WHERE pid IS NOT NULL",
    "episode_decisions": _judged(_GLOBAL)
    + " SELECT decision, CASE WHEN pid IS NULL THEN NULL WHEN gap_s > 1800 THEN 'gap_exceeded' WHEN same_artifact_id = 1 THEN 'same_artifact' WHEN merged THEN 'score_threshold' ELSE 'insufficient_relationship' END AS reason, count(*) AS n FROM judged GROUP BY ALL",
    "episodes_detected": _grouped(_GLOBAL),
    "episodes_per_source": _grouped(_BY_SOURCE),
}

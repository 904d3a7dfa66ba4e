"""Problem 4: grouping activity into sessions by inactivity gaps, by pointer doubling.

Every event is linked to its predecessor where that lies within the gap. Events are held in blocks: stretches of time, cut
further where a source has many events in one. The pointers inside a block are followed to their roots at once (the latest
root so far), so that what takes part in the self-joins is one row for each unbroken run of a source in a block. Pointers
from a block's first run to the last of the block before are then doubled by self-joins until roots are stable, and runs
are summed up by root. A source that holds a third of all events is spread over its blocks throughout, also in a burst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.operators.sequence import BLOCK_ROWS, with_blocks
from tidepool.session import cut, micros, table

GAP_S = 1800
STRETCH_S = 7200


def double_pointers(links: DataFrame, keys: list[str], max_rounds: int = 64) -> DataFrame:
    """links: keys identify a node, p_<key> the node it points to (never itself, no cycles); roots have no row.

    Returns the nodes with p_<key> pointing to their roots. Each round is a self-join that doubles the length of the
    pointers, so a chain of n nodes takes log2(n) rounds; each round is written to the shared folder.
    """
    ptr = [f"p_{k}" for k in keys]
    current = cut(links.select(*keys, *ptr), "pointers")
    for _ in range(max_rounds):
        target = current.select(*[F.col(k).alias(f"p_{k}") for k in keys], *[F.col(p).alias(f"q_{p}") for p in ptr])
        moved = cut(
            current.join(target, ptr, "left").select(
                *keys, *[F.coalesce(f"q_{p}", p).alias(p) for p in ptr], F.col(f"q_{ptr[0]}").isNotNull().alias("moved")
            ),
            "pointers",
        )
        current = moved.select(*keys, *ptr)
        if not moved.filter("moved").take(1):
            return current
    raise RuntimeError(f"pointers were not stable after {max_rounds} rounds")


def sessionize(events: DataFrame, gap_s: int = GAP_S, stretch_s: int = STRETCH_S, most: int = BLOCK_ROWS) -> DataFrame:
    """Sessions of source, id, t (microseconds): source, first_event_id, last_event_id, n_events, start_us, end_us.

    Events are ordered by t, then id; a session ends where more than gap_s passes without an event of the source (exactly
    gap_s stays together). Rows with equal source, t and id count once; rows with a null in one of the three are left out;
    other columns are ignored; an empty table has no sessions.
    """
    gap = gap_s * 1_000_000
    rows = with_blocks(events.select("source", "id", "t").dropna(subset=["source", "id", "t"]), "t", ["source"], stretch_s * 1_000_000, most)
    rows = rows.select("source", "block", "t", "id").dropDuplicates(["source", "block", "t", "id"])
    w = Window.partitionBy("source", "block").orderBy("t", "id")
    # a pointer to the event before, if that is within the gap; an event without one is the root of a run, and the latest
    # root so far is where the pointers of the events of a block lead
    linked = rows.withColumn("pointer", F.when(F.col("t") - F.lag("t").over(w) <= gap, F.lag(F.struct("t", "id")).over(w)))
    root = F.max(F.when(F.col("pointer").isNull(), F.struct("t", "id"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = cut(
        linked.withColumn("run", root)
        .groupBy("source", "block", "run")
        .agg(F.max(F.struct("t", "id")).alias("last"), F.count(F.lit(1)).alias("n")),
        "runs",
    )
    node = ["source", "block", "run"]
    # the first run of a block points to the last one of the block before; a source has a row a block here
    blocks = runs.groupBy("source", "block").agg(F.min("run").alias("first"), F.max_by(F.struct("run", "last"), "run").alias("e"))
    over = Window.partitionBy("source").orderBy("block")
    before = blocks.select("source", "block", F.col("first").alias("run"), F.lag("block").over(over).alias("p_block"), F.lag("e").over(over).alias("p"))
    links = before.filter(F.col("run.t") - F.col("p.last.t") <= gap).select(*node, F.col("source").alias("p_source"), "p_block", F.col("p.run").alias("p_run"))
    roots = double_pointers(links, node)
    return (
        runs.join(roots, node, "left")
        .groupBy("source", F.coalesce("p_run", "run").alias("root"))
        .agg(F.max("last").alias("last"), F.sum("n").alias("n_events"))
        .select("source", F.col("root.id").alias("first_event_id"), F.col("last.id").alias("last_event_id"), "n_events", F.col("root.t").alias("start_us"), F.col("last.t").alias("end_us"))
    )


def device_events(spark, sf_dir: str) -> DataFrame:
    """activity_events with the device's name without blanks around it and in lower case."""
    name = F.lower(F.regexp_replace("source", r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return table(spark, sf_dir, "activity_events").select(name.alias("source"), "id", micros(F.col("ts")).alias("t"))


def p4_found(spark, sf_dir: str) -> DataFrame:
    return sessionize(device_events(spark, sf_dir)).select("source", "first_event_id", "last_event_id", "n_events")


def p4_sessions(spark, sf_dir: str) -> DataFrame:
    """Start, end, duration in seconds and number of events of each session."""
    epoch = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    at = lambda c: F.timestamp_add("MICROSECOND", F.col(c), epoch)
    return sessionize(device_events(spark, sf_dir)).select(
        "source", "first_event_id", at("start_us").alias("start_ts"), at("end_us").alias("end_ts"),
        ((F.col("end_us") - F.col("start_us")) / 1e6).alias("duration_s"), "n_events",
    )


_SESSIONS_SQL = r"""
WITH e AS (
  SELECT DISTINCT lower(regexp_replace(source, '^\s+|\s+$', '', 'g')) AS source, id, ts FROM activity_events WHERE ts IS NOT NULL AND source IS NOT NULL
),
marked AS (
  SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 1800000000 THEN 1 ELSE 0 END AS starts FROM e WINDOW w AS (PARTITION BY source ORDER BY ts, id)
),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY source ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS s FROM marked)
"""

QUERIES = {"p4_found": p4_found, "p4_sessions": p4_sessions}
SQL = {
    "p4_found": _SESSIONS_SQL + "SELECT source, arg_min(id, (ts, id)) AS first_event_id, arg_max(id, (ts, id)) AS last_event_id, count(*) AS n_events FROM numbered GROUP BY source, s",
    "p4_sessions": _SESSIONS_SQL
    + "SELECT source, arg_min(id, (ts, id)) AS first_event_id, min(ts) AS start_ts, max(ts) AS end_ts, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS duration_s, count(*) AS n_events FROM numbered GROUP BY source, s",
}

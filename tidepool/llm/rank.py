"""Problem 3: one ranking from several differently-scaled scores, by closeness to an ideal point.

In each group a score's extreme values (beyond fences about its quartiles, alike on both sides) are drawn in to the nearest
other value, measured from its worst value, and vector-normalised: divided by the length of the score's vector. An item's
weighted distances to the ideal point (the best of each score) and the anti-ideal point (the worst of each) give its relative
closeness. Quantiles and norms are aggregates that combine before the shuffle; they go to a large group's rows by broadcast,
and the best of a group are first taken in parts of it, so a group that holds a third of all rows is no single task's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.session import HOT_ROWS, cut, hot_keys, join_small, table

#: Values farther than FENCE times the spread (between the quartiles; where these are equal, between the 0.05 and 0.95
#: quantiles) from the nearer quartile are extreme. All of them lie within TAIL of the span of the others, in their order.
#: Up to ACCURACY values a group the quantiles are exact.
QUANTILES = (0.25, 0.75, 0.05, 0.95)
FENCE = 1.5
TAIL = 0.01
ACCURACY = 10_000
PARTS = 256


@dataclass(frozen=True)
class Score:
    name: str
    higher_is_better: bool = True
    weight: float = 1.0


def _inside(value: Column, q: Column) -> Column:
    """Whether value is not extreme; q has the QUANTILES. Where nine tenths of the values are equal, none is."""
    spread = F.when(q[1] > q[0], q[1] - q[0]).when(q[3] > q[2], q[3] - q[2]).otherwise(F.lit(float("inf")))
    return (value >= q[0] - FENCE * spread) & (value <= q[1] + FENCE * spread)


def _drawn_in(value: Column, name: str) -> Column:
    """value, extreme ones within TAIL of the span beyond the ends of the others (name_lo, name_hi), in their order."""
    lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
    beyond = lambda d: TAIL * (hi - lo) * (1 - F.coalesce(F.try_divide(hi - lo, hi - lo + d), F.lit(1.0)))
    return F.when(value > hi, hi + beyond(value - hi)).when(value < lo, lo - beyond(lo - value)).otherwise(value)


def rank_by_closeness(rows: DataFrame, group: str, item: str, scores: list[Score], hot_rows: int = HOT_ROWS) -> DataFrame:
    """group, item, closeness (1 best, 0 worst, to nine digits) of each distinct row of group, item and scores.

    A score that is null or not a number leaves the distances, neither for nor against the item; infinite ones are drawn in
    like other extremes, and are no quantiles. A score with one value in its group says nothing and is left out too. An item
    with no usable score gets 0.5. Rows that repeat count once; if an item has several different rows, its best one counts.
    Null groups or items are left out; other columns are ignored; an empty table gives no rows.
    """
    names = [f"s{i}" for i in range(len(scores))]
    value = lambda s: F.when(F.isnan(s.name), None).otherwise(F.col(s.name).cast("double") * (1.0 if s.higher_is_better else -1.0))
    base = rows.select(F.col(group).alias("g"), F.col(item).alias("i"), *[value(s).alias(n) for s, n in zip(scores, names, strict=True)])
    base = base.filter("g IS NOT NULL AND i IS NOT NULL").distinct()
    finite = lambda n: F.when(F.abs(n) != float("inf"), F.col(n))
    quantiles = base.groupBy("g").agg(F.count(F.lit(1)).alias("rows"), *[F.percentile_approx(finite(n), list(QUANTILES), ACCURACY).alias(f"{n}_q") for n in names])
    quantiles = cut(quantiles, "quantiles")
    hot = hot_keys(quantiles, "g", "rows", hot_rows)
    inside = lambda n: F.when(_inside(finite(n), F.col(f"{n}_q")), F.col(n))
    ends = [f(x).alias(f"{n}_{k}") for n in names for f, x, k in ((F.min, inside(n), "lo"), (F.max, inside(n), "hi"), (F.min, F.col(n), "least"))]
    known = join_small(base, join_small(base, quantiles, "g", hot).groupBy("g").agg(*ends), "g", hot)
    shifted = known.select("g", "i", *[F.when(F.col(n).isNotNull(), _drawn_in(F.col(n), n) - _drawn_in(F.col(f"{n}_least"), n)).alias(n) for n in names])
    # the length of a score's vector, for each value that is there: scores that many items lack would be short otherwise
    norms = shifted.groupBy("g").agg(*[F.sqrt(F.avg(F.col(n) * F.col(n))).alias(f"{n}_norm") for n in names], *[F.max(n).alias(f"{n}_max") for n in names])
    joined = join_small(shifted, norms, "g", hot)
    plus, minus, used = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for s, n in zip(scores, names, strict=True):
        ideal = F.try_divide(F.col(f"{n}_max"), F.col(f"{n}_norm"))  # the anti-ideal is at 0
        here = F.try_divide(F.col(n), F.col(f"{n}_norm"))
        there = here.isNotNull() & (ideal > 0)
        plus += F.when(there, F.pow(s.weight * (ideal - here), F.lit(2.0))).otherwise(0.0)
        minus += F.when(there, F.pow(s.weight * here, F.lit(2.0))).otherwise(0.0)
        used += F.when(there, F.lit(1.0)).otherwise(0.0)
    closeness = F.when(used == 0, F.lit(0.5)).otherwise(F.sqrt(minus) / (F.sqrt(minus) + F.sqrt(plus)))
    best = joined.select("g", "i", closeness.alias("closeness")).groupBy("g", "i").agg(F.round(F.max("closeness"), 9).alias("closeness"))
    return best.select(F.col("g").alias(group), F.col("i").alias(item), "closeness")


def first_of_each(ranked: DataFrame, wanted: DataFrame, group: str, item: str, n: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """ranked with position, only each group's first n by closeness, then item. wanted: group, n (null: none; of repeated
    rows the greatest). The first of each of PARTS parts are taken before the first of the group."""
    ranked = cut(ranked, "ranked")
    hot = hot_keys(ranked.groupBy(group).agg(F.count(F.lit(1)).alias("n")), group, "n", hot_rows)
    limits = wanted.filter(F.col(group).isNotNull()).groupBy(group).agg(F.max(n).alias("_n"))
    order = [F.col("closeness").desc(), F.col(item)]
    parts = Window.partitionBy(group, "_part").orderBy(*order)
    tops = join_small(ranked, limits, group, hot).withColumn("_part", F.pmod(F.xxhash64(item), F.lit(PARTS)))
    tops = tops.withColumn("_at", F.row_number().over(parts)).filter("_at <= _n")
    whole = Window.partitionBy(group).orderBy(*order)
    return tops.withColumn("position", F.row_number().over(whole)).filter("position <= _n").drop("_n", "_part", "_at")


RESULT_SCORES = [Score("bm25_rank", higher_is_better=False), Score("similarity"), Score("score")]


def p3_ranking(spark, sf_dir: str) -> DataFrame:
    """query_id, artifact_id, closeness of every candidate."""
    rows = table(spark, sf_dir, "search_results").withColumnRenamed("id", "artifact_id")
    return rank_by_closeness(rows, "query_id", "artifact_id", RESULT_SCORES)


def p3_found(spark, sf_dir: str) -> DataFrame:
    first = first_of_each(p3_ranking(spark, sf_dir), table(spark, sf_dir, "search_queries"), "query_id", "artifact_id", "n_wanted")
    return first.select("query_id", "artifact_id")


QUERIES = {"p3_found": p3_found, "p3_ranking": p3_ranking}
_CLOSENESS_SQL = """
WITH r AS (SELECT *, row_number() OVER () AS rid FROM (SELECT DISTINCT query_id AS g, id AS i, CASE WHEN NOT isnan(bm25_rank) THEN -bm25_rank END AS a, CASE WHEN NOT isnan(similarity) THEN similarity END AS b, CASE WHEN NOT isnan(score) THEN score END AS c FROM search_results) WHERE g IS NOT NULL AND i IS NOT NULL),
l AS (SELECT * FROM (SELECT rid, g, 1 AS k, a AS v FROM r UNION ALL SELECT rid, g, 2, b FROM r UNION ALL SELECT rid, g, 3, c FROM r) WHERE v IS NOT NULL),
q AS (SELECT g, k, quantile_disc(v, 25e-2) AS q1, quantile_disc(v, 75e-2) AS q3, quantile_disc(v, 5e-2) AS p1, quantile_disc(v, 95e-2) AS p2 FROM l WHERE NOT isinf(v) GROUP BY g, k),
f AS (SELECT g, k, q1, q3, CASE WHEN q3 > q1 THEN q3 - q1 WHEN p2 > p1 THEN p2 - p1 ELSE CAST('inf' AS DOUBLE) END AS spread FROM q),
e AS (SELECT g, k, min(v) FILTER (ok) AS lo, max(v) FILTER (ok) AS hi, min(v) AS least FROM (SELECT l.*, NOT isinf(v) AND v >= q1 - 15e-1 * spread AND v <= q3 + 15e-1 * spread AS ok FROM l LEFT JOIN f USING (g, k)) GROUP BY g, k),
x AS (SELECT rid, g, k, drawn(v, lo, hi) - drawn(least, lo, hi) AS x FROM l JOIN e USING (g, k)),
n AS (SELECT g, k, sqrt(avg(x * x)) AS norm, max(x) AS top FROM x GROUP BY g, k),
d AS (SELECT rid, sqrt(sum(pow(top / norm - x / norm, 2))) AS plus, sqrt(sum(pow(x / norm, 2))) AS minus FROM x JOIN n USING (g, k) WHERE norm > 0 AND top > 0 GROUP BY rid),
ranked AS (SELECT g, i, round(max(coalesce(minus / (minus + plus), 5e-1)), 9) AS closeness FROM r LEFT JOIN d USING (rid) GROUP BY g, i)
"""


def _inlined(sql: str) -> str:
    """sql with drawn(v, lo, hi) written out: v, extreme values within 0.01 of the span beyond lo and hi."""
    span = "(hi - lo)"
    for v in ("v", "least"):
        beyond = lambda d: f"1e-2 * {span} * (1 - coalesce({span} / nullif({span} + {d}, 0), 1))"  # noqa: B023, E731
        sql = sql.replace(f"drawn({v}, lo, hi)", f"CASE WHEN {v} > hi THEN hi + {beyond(f'({v} - hi)')} WHEN {v} < lo THEN lo - {beyond(f'(lo - {v})')} ELSE {v} END")
    return sql


SQL = {
    "p3_ranking": _inlined(_CLOSENESS_SQL) + "SELECT g AS query_id, i AS artifact_id, closeness FROM ranked",
    "p3_found": _inlined(_CLOSENESS_SQL)
    + "SELECT g AS query_id, i AS artifact_id FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY closeness DESC, i) AS place FROM ranked) JOIN (SELECT query_id AS g, max(n_wanted) AS wanted FROM search_queries GROUP BY query_id) USING (g) WHERE place <= wanted",
}

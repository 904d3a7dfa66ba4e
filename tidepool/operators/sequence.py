"""Previous row and running count over an order that may span the whole table: in blocks, then over the blocks.

A block is a stretch of time, or a part of one where many rows are in it. A row's block is worked out once and goes with it,
so that all that is done in blocks shares one shuffle and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.session import cut

#: A stretch of time, rows of one that stay in a block, and blocks of a stretch at most.
STRETCH_US = 3_600_000_000
BLOCK_ROWS, MOST_PARTS = 500_000, 1_000


def with_blocks(rows: DataFrame, us: str, keys: list[str] | None = None, width: int = STRETCH_US, most: int = BLOCK_ROWS) -> DataFrame:
    """rows with block: the stretch of time a row is in, and which part of it where its keys have more than most rows there.

    Parts are cut at quantiles, an aggregate that combines before the shuffle, so that their rows are about as many; rows of
    one microsecond stay together. The cuts, a row for each stretch of more than most rows, are broadcast. Blocks are in the
    order of time."""
    key = [*(keys or []), "stretch"]
    rows = rows.withColumn("stretch", F.floor(F.col(us) / width))
    full = cut(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most), "full-stretches")
    if full.isEmpty():
        return rows.withColumn("block", F.struct("stretch", F.lit(0).alias("part"))).drop("stretch")
    steps = F.least(F.ceil(F.col("n") / most), F.lit(MOST_PARTS)).cast("int")
    inside = rows.join(F.broadcast(full.select(*key, steps.alias("steps"))), key)
    quantiles = [i / MOST_PARTS for i in range(1, MOST_PARTS)]
    cuts = inside.groupBy(*key).agg(F.percentile_approx(us, quantiles, 10_000).alias("q"), F.first("steps").alias("steps"))
    each = F.transform(F.sequence(F.lit(1), F.col("steps") - 1), lambda i: F.element_at("q", (i * MOST_PARTS / F.col("steps")).cast("int")))
    cuts = cut(cuts.select(*key, F.array_distinct(F.when(F.col("steps") > 1, each).otherwise(F.array().cast("array<bigint>"))).alias("cuts")), "cuts")
    part = F.coalesce(F.aggregate("cuts", F.lit(0), lambda n, c: n + (F.col(us) > c).cast("int")), F.lit(0))
    return rows.join(F.broadcast(cuts), key, "left").withColumn("block", F.struct("stretch", part.alias("part"))).drop("cuts", "stretch")


def with_previous(rows: DataFrame, us: str, order: list[str], columns: list[str], keys: list[str] | None = None, width: int = STRETCH_US, most: int = BLOCK_ROWS) -> DataFrame:
    """rows with block and prev: a struct of the columns of the row before in the order (us first), null for the first of its keys."""
    keys = keys or []
    rows = with_blocks(rows, us, keys, width, most)
    inside = F.lag(F.struct(*columns)).over(Window.partitionBy(*keys, "block").orderBy(*order))
    last = rows.groupBy(*keys, "block").agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_last"))
    before = last.withColumn("_before", F.lag("_last").over(Window.partitionBy(*keys).orderBy("block"))).drop("_last")
    joined = rows.withColumn("_in", inside).join(before, [*keys, "block"])
    return joined.withColumn("prev", F.coalesce("_in", "_before")).drop("_in", "_before")


def running_count(rows: DataFrame, flag: Column, us: str, order: list[str], keys: list[str] | None = None, name: str = "grp", width: int = STRETCH_US, most: int = BLOCK_ROWS) -> DataFrame:
    """rows with name: how many rows up to this one have the flag. Rows that have their block keep it."""
    keys = keys or []
    rows = (rows if "block" in rows.columns else with_blocks(rows, us, keys, width, most)).withColumn("_f", flag.cast("bigint"))
    inside = F.sum("_f").over(Window.partitionBy(*keys, "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    sums = rows.groupBy(*keys, "block").agg(F.sum("_f").alias("_n"))
    over = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_n").over(over), F.lit(0))).drop("_n")
    joined = rows.withColumn("_in", inside).join(sums, [*keys, "block"])
    return joined.withColumn(name, F.col("_in") + F.col("_before")).drop("_in", "_before", "_f")

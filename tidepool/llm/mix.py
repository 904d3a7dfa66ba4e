"""Problem 9: mixing sources to target weights, by fitting subset sums.

Documents are counted by source and exact length in tokens. Whole passes over a source are given to all its documents;
the rest of its budget is filled by so many documents of each length: their proportional share first, then a bounded
knapsack by dynamic programming over what is left. Which documents of a length are taken is decided by a seeded hash,
ranked inside hash ranges, so that one length that holds a third of all documents is spread too. The plan has a row for
each length that documents of a source have; only lengths of many documents meet it by broadcast, the others by a shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.encode import count_tokens
from tidepool.session import cut, hot_keys, join_small, table

#: Tokens the dynamic programme runs over; what is more than that is filled greedily before.
DP_TOKENS = 65_536
#: Documents of a length that are ranked together.
RANGE_ROWS = 100_000


def fit_counts(lengths: list[int], counts: list[int], budget: int, seed: int = 0, dp_tokens: int = DP_TOKENS) -> list[int]:
    """How many documents of each length to take: at most counts, together as near below budget as can be reached."""
    sizes, have = np.array(lengths, dtype=np.int64), np.array(counts, dtype=np.int64)
    total = int((sizes * have).sum())
    if budget >= total:
        return have.tolist()
    take = np.array([int(c) * budget // total for c in have.tolist()], dtype=np.int64)  # exact: Python's integers
    left = budget - int((sizes * take).sum())
    order = [int(i) for i in np.random.default_rng(seed).permutation(len(sizes)) if sizes[i] > 0]
    for i in order:
        if left <= dp_tokens:
            break
        n = min(int(have[i] - take[i]), (left - dp_tokens // 2) // int(sizes[i]))
        if n > 0:
            take[i] += n
            left -= n * int(sizes[i])
    for i in order:  # some are given back, so that the programme has a choice: all of them where the budget is small
        n = min(int(take[i]), (min(budget, dp_tokens) - left) // int(sizes[i]))
        if n > 0:
            take[i] -= n
            left += n * int(sizes[i])
    goal, mask = min(left, dp_tokens), (1 << min(left, dp_tokens) + 1) - 1
    reached, steps = 1, []
    for i in order:
        if reached >> goal & 1:
            break
        spare, n = min(int(have[i] - take[i]), goal // int(sizes[i])), 1
        while spare > 0 and not reached >> goal & 1:
            n = min(n, spare)
            steps.append((reached, i, n))
            reached |= reached << n * int(sizes[i]) & mask
            spare -= n
            n *= 2
    at = reached.bit_length() - 1
    for before, i, n in reversed(steps):
        if not before >> at & 1:
            at -= n * int(sizes[i])
            take[i] += n
    return take.tolist()


def plan_budgets(stats: dict[str, int], targets: list[tuple[str, float, int]], total: int | None = None) -> tuple[int, list[dict]]:
    """The total in tokens and, for each target, its budget, whole passes and rest.

    stats: tokens by source. Without a total, the largest is taken at which every source that has tokens can hold its
    share; with one, sources too small for theirs are repeated max_repeats times and stay below it.
    """
    usable = [(s, share, reps) for s, share, reps in targets if share and share > 0 and reps and reps > 0 and stats.get(s, 0) > 0]
    if total is None:
        total = int(min((stats[s] * reps / share for s, share, reps in usable), default=0))
    plans = []
    for s, share, reps in targets:
        have = stats.get(s, 0)
        budget = min(round((share or 0) * total), have * max(reps or 0, 0))
        passes = budget // have if have else 0
        plans.append({"source": s, "target_share": share, "max_repeats": reps, "budget": budget, "passes": passes, "rest": budget - passes * have})
    return total, plans


def mix_sources(sizes: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 0, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, source, n_tokens, copies (at least 1) of the documents in the mix.

    sizes: doc_id (unique), source, n_tokens. Documents whose source is null or has no target are left out; null sizes
    count as 0. A target without documents stays empty. targets: source (null rows are left out; the first of repeated
    ones counts), target_share, max_repeats: a control table of a row a source. Empty tables give an empty mix.
    """
    wanted: dict[str, tuple] = {}
    for r in targets.filter("source IS NOT NULL").select("source", "target_share", "max_repeats").orderBy("source", "target_share", "max_repeats").collect():
        wanted.setdefault(r["source"], (r["source"], r["target_share"], r["max_repeats"]))
    sizes = sizes.filter(F.col("source").isin(list(wanted))).select("doc_id", "source", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"))
    sizes = sizes.withColumn("length", F.concat_ws("\x1f", F.col("n_tokens").cast("string"), "source"))
    by_length = cut(sizes.groupBy("source", "n_tokens", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    stats = {r["source"]: int(r["t"]) for r in by_length.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n")).alias("t")).collect()}
    _, plans = plan_budgets(stats, list(wanted.values()), total)
    rest = {p["source"]: p["rest"] for p in plans}
    passes = {p["source"]: p["passes"] for p in plans}

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:  # a row for each length that documents of a source have
        pdf = pdf.sort_values("n_tokens")
        source = pdf["source"].iloc[0]
        return pdf.assign(take=fit_counts(pdf["n_tokens"].tolist(), pdf["n"].tolist(), rest[source], seed), passes=passes[source])[["length", "n", "take", "passes"]]

    plan = cut(by_length.groupBy("source").applyInPandas(fitted, "length string, n bigint, take bigint, passes bigint"), "plan")
    hot = hot_keys(plan, "length", "n", range_rows)
    # a length is cut into hash ranges of about range_rows documents; most lengths have one
    ranges = F.ceil(F.col("n") / range_rows)
    place = F.floor(F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 40) * ranges / F.lit(1 << 24)).cast("int")
    known = cut(join_small(sizes, plan.hint("merge"), "length", hot).withColumn("range", place), "known")
    key = ["length", "range"]
    some = known.filter("take > 0 AND take < n")
    w = Window.partitionBy("length").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    held = some.groupBy(*key, "take").agg(F.count(F.lit(1)).alias("m")).withColumn("before", F.coalesce(F.sum("m").over(w), F.lit(0)))
    # a range is in as a whole, out as a whole, or the one in which the count is reached
    held = held.select(*key, F.least("m", F.greatest(F.col("take") - F.col("before"), F.lit(0))).alias("taken"))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id"))
    chosen = some.withColumn("rank", rank).join(held.hint("merge"), key).withColumn("more", (F.col("rank") <= F.col("taken")).cast("int"))
    whole = known.filter("take = 0 OR take = n").withColumn("more", (F.col("take") > 0).cast("int"))
    out = ["doc_id", "source", "n_tokens", (F.col("passes") + F.col("more")).cast("int").alias("copies")]
    return whole.select(*out).unionByName(chosen.select(*out)).filter("copies > 0")


def mix_report(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target: tokens, copies and documents in the mix, and the share really reached (0 for an empty mix)."""
    got = mix.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("actual_tokens"), F.sum("copies").alias("n_copies"), F.count(F.lit(1)).alias("n_docs"), F.max("copies").alias("most_copies")
    )
    every = Window.partitionBy(F.lit(0))  # a row a source
    rows = targets.filter("source IS NOT NULL").select("source", "target_share", "max_repeats").dropDuplicates(["source"]).join(got, "source", "left")
    rows = rows.fillna(0, ["actual_tokens", "n_copies", "n_docs", "most_copies"])
    share = F.coalesce(F.try_divide(F.col("actual_tokens").cast("double"), F.sum("actual_tokens").over(every)), F.lit(0.0))
    return rows.withColumn("actual_share", share)


def _sizes(spark, sf_dir: str) -> DataFrame:
    wanted = [r[0] for r in table(spark, sf_dir, "source_targets").select("source").collect()]  # the control table
    docs = table(spark, sf_dir, "documents").filter(F.col("source").isin(wanted)).select("doc_id", "source", "text")
    return cut(count_tokens(docs), "sizes")


def p9_mix(spark, sf_dir: str) -> DataFrame:
    return mix_sources(_sizes(spark, sf_dir), table(spark, sf_dir, "source_targets"))


def p9_shares(spark, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "source_targets")
    return mix_report(mix_sources(_sizes(spark, sf_dir), targets), targets)


QUERIES = {"p9_mix": p9_mix, "p9_shares": p9_shares}
SQL: dict[str, str] = {}

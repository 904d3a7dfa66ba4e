"""Evaluation of retrieval: hit rate, mean reciprocal rank, recall at k."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.operators import vectors
from tidepool.session import table
from tidepool.sources import canonical


def hit_rate_and_mrr(results: DataFrame, relevant: DataFrame, k: int = 3) -> DataFrame:
    """n_cases, hit_rate, mrr: one row. results: case_id, id, position; relevant: case_id, id. Cases without any result
    count as missed; the reciprocal rank is of the first relevant one among the first k."""
    first = results.filter(F.col("position") <= k).join(relevant, ["case_id", "id"], "left_semi").groupBy("case_id").agg(F.min("position").alias("at"))
    cases = relevant.select("case_id").distinct().join(first, "case_id", "left")
    return cases.agg(F.count(F.lit(1)).alias("n_cases"), F.avg(F.col("at").isNotNull().cast("double")).alias("hit_rate"), F.avg(F.coalesce(1.0 / F.col("at"), F.lit(0.0))).alias("mrr"))


def recall_at_k(found: DataFrame, truth: DataFrame) -> DataFrame:
    """n_queries, recall: the mean part of a query's true ids (query_id, id) that were found (query_id, id)."""
    both = truth.distinct().join(found.select("query_id", "id").distinct().withColumn("_hit", F.lit(1.0)), ["query_id", "id"], "left")
    per = both.groupBy("query_id").agg(F.avg(F.coalesce("_hit", F.lit(0.0))).alias("r"))
    return per.agg(F.count(F.lit(1)).alias("n_queries"), F.avg("r").alias("recall"))


def with_hard_negatives(placed: DataFrame, relevant: DataFrame, negatives: DataFrame, k: int = 5) -> DataFrame:
    """n_queries, recall, mrr and intruders of results (query_id, id, place): the mean part of the relevant ids (query_id, id)
    among the first k, the mean reciprocal place of the first of them, and the mean part of the hard negatives among the k."""
    marked = placed.join(relevant.distinct().withColumn("_r", F.lit(1.0)), ["query_id", "id"], "left").join(negatives.distinct().withColumn("_n", F.lit(1.0)), ["query_id", "id"], "left")
    first = (F.col("place") <= k).cast("double")
    per = marked.groupBy("query_id").agg(
        F.try_divide(F.sum(F.col("_r") * first), F.sum("_r")).alias("r"), F.min(F.when(F.col("_r") == 1, F.col("place"))).alias("at"), F.try_divide(F.sum(F.col("_n") * first), F.sum("_n")).alias("n")
    )
    return per.agg(F.count(F.lit(1)).alias("n_queries"), F.avg("r").alias("recall"), F.avg(F.coalesce(1.0 / F.col("at"), F.lit(0.0))).alias("mrr"), F.avg("n").alias("intruders"))


def synthetic_vectors(spark, n: int, dimension: int, seed: int = 0) -> DataFrame:
    """chunk_id, artifact_id, model_id, dimension, embedding of n random vectors at length one, the same for the same seed."""

    def run(batches):
        for pdf in batches:
            x = np.stack([np.random.default_rng([seed, int(i)]).standard_normal(dimension) for i in pdf["id"]]) if len(pdf) else np.zeros((0, dimension))
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
            yield pd.DataFrame({"chunk_id": [f"s{i}" for i in pdf["id"]], "artifact_id": pdf["id"], "model_id": "synthetic", "dimension": dimension, "embedding": list(x.astype(np.float32))})

    return spark.range(n).mapInPandas(run, "chunk_id string, artifact_id bigint, model_id string, dimension int, embedding array<float>")


def write_report(report: DataFrame, path: str) -> None:
    """A report, a few rows, as one JSON file a row in a folder."""
    report.coalesce(1).write.mode("overwrite").json(path)


# Queries -----------------------------------------------------------------------------------------------------------


def hit_at_k_mrr(spark, sf_dir: str) -> DataFrame:
    """The stored candidates by score, against the best candidates by similarity."""
    rows = table(spark, sf_dir, "search_results").select(F.col("query_id").alias("case_id"), "id", "score", "similarity").distinct()
    rows = rows.groupBy("case_id", "id").agg(F.max("score").alias("score"), F.max(F.when(~F.isnan("similarity"), F.col("similarity"))).alias("similarity"))
    w = Window.partitionBy("case_id")
    results = rows.withColumn("position", F.row_number().over(w.orderBy(F.col("score").desc_nulls_last(), "id"))).select("case_id", "id", "position")
    relevant = rows.withColumn("n", F.row_number().over(w.orderBy(F.col("similarity").desc_nulls_last(), "id"))).filter("n <= 3").select("case_id", "id")
    got = hit_rate_and_mrr(results, relevant, 10)
    return got.select("n_cases", F.round("hit_rate", 9).alias("hit_rate"), F.round("mrr", 9).alias("mrr"))


def lsh_recall_at_5(spark, sf_dir: str) -> DataFrame:
    """Recall of the bucketed search against the exact one, for the chunks of artifacts whose id is divisible by 100."""
    chunks = canonical.chunks(spark, sf_dir)
    probes = vectors._probe_set(spark, sf_dir)
    probes = probes.filter(vectors.sound(probes))
    found = vectors.bucketed_topk(chunks, probes, tables=16, bits=4).select("query_id", F.col("chunk_id").alias("id"))
    truth = vectors.nearest(chunks, probes, 5).select("query_id", F.col("chunk_id").alias("id"))
    return recall_at_k(found, truth)


QUERIES = {"hit_at_k_mrr": hit_at_k_mrr, "lsh_recall_at_5": lsh_recall_at_5}
SQL = {
    "hit_at_k_mrr": """WITH r AS (SELECT query_id, id, max(score) AS score, max(CASE WHEN isnan(similarity) THEN NULL ELSE similarity END) AS similarity FROM search_results GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, id) AS position, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC NULLS LAST, id) AS n FROM r),
f AS (SELECT query_id, min(CASE WHEN n <= 3 AND position <= 10 THEN position END) AS found_at FROM p GROUP BY query_id)
SELECT count(*) AS n_cases, round(avg(CASE WHEN found_at IS NULL THEN 0e0 ELSE 1e0 END), 9) AS hit_rate, round(avg(coalesce(1e0 / found_at, 0e0)), 9) AS mrr FROM f"""
}

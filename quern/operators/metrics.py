"""NDCG and recall at a cut-off, with standard errors and macro averages.

Input is long: one row for each query and retrieved document with `rank` (retrieval order), `human` (the label, null for
none) and a score. Everything after the two ranks is one aggregation by query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.scalar import mean_or_nan, stderr_or_nan

NDCG_K = 10
RECALL_K = 20


def _gain(place: str, k: int | None) -> Column:
    gain = F.coalesce(F.col("human"), F.lit(0.0)) / F.log2(F.col(place) + 1)
    return F.sum(gain if k is None else F.when(F.col(place) <= k, gain))


def ndcg_per_query(results: DataFrame, k: int | None = NDCG_K, by: tuple[str, ...] = ("query_id",), score: str = "score") -> DataFrame:
    """`dcg`, `idcg` and `ndcg` of each query; queries without any gain are left out.

    The ideal order is that of the retrieved documents alone. Equal scores keep retrieval order.
    """
    w = Window.partitionBy(*by)
    ranked = results.withColumn("_place", F.row_number().over(w.orderBy(F.desc(score), "rank"))).withColumn("_ideal", F.row_number().over(w.orderBy(F.desc(F.coalesce("human", F.lit(0.0))), "rank")))
    return ranked.groupBy(*by).agg(_gain("_place", k).alias("dcg"), _gain("_ideal", k).alias("idcg")).filter("idcg <> 0").withColumn("ndcg", F.col("dcg") / F.col("idcg"))


def relevant_totals(qrels: DataFrame) -> DataFrame:
    """Sum of the positive scores of each query."""
    return qrels.filter("score > 0").groupBy("query_id").agg(F.sum("score").alias("total"))


def recall_per_query(results: DataFrame, qrels: DataFrame, k: int | None = RECALL_K, by: tuple[str, ...] = ("query_id",), score: str = "score", denominator: str = "sum") -> DataFrame:
    """`found` (documents with a positive label in the first k), `total` and `recall` of each query; 1 where total is 0.

    `total` is the sum of the positive judgments, or with `denominator="count"` their number.
    """
    totals = relevant_totals(qrels if denominator == "sum" else qrels.filter("score > 0").withColumn("score", F.lit(1.0)))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), "rank"))
    ranked = results.withColumn("_place", place)
    hit = F.col("human") > 0 if k is None else (F.col("_place") <= k) & (F.col("human") > 0)
    found = ranked.groupBy(*by).agg(F.coalesce(F.sum(F.when(hit, 1)), F.lit(0)).alias("found"))
    out = found.join(totals, "query_id", "left").withColumn("total", F.coalesce("total", F.lit(0.0)))
    return out.withColumn("recall", F.when(F.col("total") == 0, F.lit(1.0)).otherwise(F.col("found") / F.col("total")))


def summary(per_query: DataFrame, value: str, *by: str) -> DataFrame:
    """`n`, `mean` and `stderr` of a column; over no rows and without groups one row with NaN."""
    aggregates = [F.count(value).alias("n"), mean_or_nan(value).alias("mean"), stderr_or_nan(value).alias("stderr")]
    return per_query.groupBy(*by).agg(*aggregates) if by else per_query.agg(*aggregates)


def macro_average(summaries: DataFrame, *by: str, value: str = "mean") -> DataFrame:
    """Unweighted mean over the datasets of a summary; a NaN among them stays."""
    aggregates = [F.count(value).alias("datasets"), mean_or_nan(value).alias("macro_mean")]
    return summaries.groupBy(*by).agg(*aggregates) if by else summaries.agg(*aggregates)


def report(summaries: DataFrame, name: str, width: int = 25) -> DataFrame:
    """`line`: the name filled up with dots, mean and standard error to five places."""
    label = F.when(F.length(name) >= width, F.col(name)).otherwise(F.rpad(name, width, "."))
    return summaries.select(F.format_string("%s%.5f ± %.5f", label, F.col("mean"), F.col("stderr")).alias("line"))

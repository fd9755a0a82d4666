"""Schemas of the tables that travel between the stages, and the dataset that holds the three input tables.

Order matters to several operators, and a DataFrame has none: every table carries `ord`, the row's place in its source.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES = T.StructType([T.StructField("id", T.StringType(), False), T.StructField("query", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())), T.StructField("ord", T.LongType())])
DOCUMENTS = T.StructType([T.StructField("id", T.StringType(), False), T.StructField("content", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType())), T.StructField("ord", T.LongType())])
QRELS = T.StructType([T.StructField("query_id", T.StringType(), False), T.StructField("document_id", T.StringType(), False), T.StructField("score", T.DoubleType()), T.StructField("ord", T.LongType())])
#: A retrieval result: one row for each query and rank.
CANDIDATES = T.StructType([T.StructField("query_id", T.StringType()), T.StructField("rank", T.IntegerType()), T.StructField("document_id", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("human", T.DoubleType())])
#: A rerank result, long: -1 where the scorer was not called.
RERANKED = T.StructType([T.StructField("query_id", T.StringType()), T.StructField("reranker", T.StringType()), T.StructField("rank", T.IntegerType()), T.StructField("document_id", T.StringType()), T.StructField("human", T.DoubleType()), T.StructField("reranker_score", T.DoubleType())])
NOT_CALLED = -1.0


@dataclass(frozen=True)
class Dataset:
    """Queries, documents and relevance judgments."""

    queries: DataFrame
    documents: DataFrame
    qrels: DataFrame

    def with_(self, **tables: DataFrame) -> "Dataset":
        return replace(self, **tables)


#: Parts into which `dense_ordinal` cuts a table at most, so that the choice of a row's part is a small expression.
PARTS = 96


def dense_ordinal(df: DataFrame, *order: str, name: str = "ord") -> DataFrame:
    """`df` with its gapless place from 0 in the order of `order`, without a window over the whole table.

    Rows are cut into parts by bounds of the first column of `order`; a row's place is its part's offset plus its place there.
    Only the parts' counts meet in one task. The bounds are sampled once and are literals of the plan: a range partitioning
    samples again wherever the plan is evaluated again, and counts of other bounds are wrong offsets. `order` should decide
    the place of every row.
    """
    key = F.col(order[0])
    drawn = df.select(key.alias("k")).filter("k is not null").orderBy(F.rand(7)).limit(100 * PARTS).collect()
    drawn = sorted(r.k for r in drawn)
    bounds = sorted({drawn[len(drawn) * i // PARTS] for i in range(1, PARTS)}) if drawn else []

    def part_of(low: int, high: int) -> Column:
        middle = (low + high) // 2
        return F.lit(low) if low == high else F.when(key < F.lit(bounds[middle]), part_of(low, middle)).otherwise(part_of(middle + 1, high))

    part = df.withColumn("_part", F.when(key.isNull(), F.lit(0)).otherwise(part_of(0, len(bounds))))
    sizes = part.groupBy("_part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return part.withColumn("_own", own).join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_own") + F.col("_before")).cast("bigint")).drop("_part", "_own", "_before")

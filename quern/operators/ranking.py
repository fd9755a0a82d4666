"""Ranks, running places and first-wins choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.schemas import dense_ordinal


def rank_in(df: DataFrame, group: str | list[str], *order: Column, name: str = "rank") -> DataFrame:
    """Places from 1 within each group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*([group] if isinstance(group, str) else group)).orderBy(*order)))


def top_k(df: DataFrame, group: str | list[str], k: int | None, *order: Column, name: str = "rank") -> DataFrame:
    """The first k of each group; Spark cuts to k before the shuffle as well."""
    ranked = rank_in(df, group, *order, name=name)
    return ranked if k is None else ranked.filter(F.col(name) <= k)


def rerank_order(score: str, rank: str = "rank") -> list[Column]:
    """Falling score; equal ones stay in retrieval order."""
    return [F.col(score).desc(), F.col(rank).asc()]


def first_by(df: DataFrame, *keys: str, order: str = "ord") -> DataFrame:
    """The first row by `order` of each key; combines before the shuffle."""
    packed = df.groupBy(*keys).agg(F.min_by(F.struct("*"), order).alias("_row"))
    return packed.select("_row.*")


def last_by(df: DataFrame, *keys: str, order: str = "ord") -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(F.struct("*"), order).alias("_row")).select("_row.*")


def numbered_duplicates(df: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """Second and later rows of a key get `<key>_<ord>`."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("_n", n).withColumn(key, F.when(F.col("_n") > 1, F.concat_ws("_", F.col(key), F.col(order).cast("string"))).otherwise(F.col(key))).drop("_n")


def running_number(df: DataFrame, array: str, order: str = "ord", name: str = "number") -> DataFrame:
    """Elements of all arrays in one numbering from 0: `element`, its place `pos`, and `name`.

    Rows are numbered by range-partitioned offsets, not by a window over the table.
    """
    rows = df.select("*", F.posexplode(array).alias("pos", "element"))
    return dense_ordinal(rows, order, "pos", name=name)


def without(natural: DataFrame, taken: DataFrame, *keys: str) -> DataFrame:
    """The rows of `natural` whose keys are not in `taken`, ranks kept."""
    return natural.join(taken.select(*keys), list(keys), "left_anti")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether both hold the same rows, counted."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()

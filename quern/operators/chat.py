"""Chat messages: merging turns, repairing the first one, taking out the system's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import col

MERGED = "\n\n"


def merge_roles(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", delimiter: str = MERGED) -> DataFrame:
    """Consecutive turns of one role as one, their texts joined: conversation, `turn` from 0, role, text."""
    w = Window.partitionBy(conversation).orderBy(turn)
    change = F.when(F.col("role").eqNullSafe(F.lag("role").over(w)) & F.lag(turn).over(w).isNotNull(), 0).otherwise(1)
    runs = turns.withColumn("_change", change).withColumn("_run", F.sum("_change").over(w) - 1)
    parts = F.transform(F.sort_array(F.collect_list(F.struct(F.col(turn).alias("t"), F.coalesce("text", F.lit("")).alias("x")))), lambda s: s["x"])
    return runs.groupBy(conversation, "_run").agg(F.first("role").alias("role"), F.array_join(parts, delimiter).alias("text")).withColumnRenamed("_run", "turn")


def messages(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """One row for each conversation, with `messages` in order."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(turn).alias("t"), F.struct("role", "text").alias("m"))))
    return turns.groupBy(conversation).agg(F.transform(rows, lambda s: s["m"]).alias("messages"))


def starting_with_user(c: str | Column, text: str = ".") -> Column:
    """Messages with a user turn put first where there is none."""
    c = col(c)
    first = F.struct(F.lit("user").alias("role"), F.lit(text).alias("text"))
    return F.when(F.get(c, 0)["role"] == "user", c).otherwise(F.concat(F.array(first), c))


def system_text(c: str | Column) -> Column:
    """Text of a leading system message, else null."""
    return F.when(F.get(col(c), 0)["role"] == "system", F.get(col(c), 0)["text"])


def without_system(c: str | Column) -> Column:
    c = col(c)
    return F.when(F.get(c, 0)["role"] == "system", F.slice(c, 2, F.greatest(F.lit(0), F.size(c) - 1))).otherwise(c)

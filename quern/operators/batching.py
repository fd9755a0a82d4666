"""Sequential folds over small arrays: batches by size, batches by tokens, byte budgets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import col

PAIR_COST = 20
RERANK_BYTES = 750_000
LISTWISE_BYTES = 50_000
LEAST_BYTES = 100


def pair_cost(query: str | Column, document: str | Column) -> Column:
    """UTF-8 bytes of a query and a document, and a fixed cost."""
    return F.lit(PAIR_COST) + F.octet_length(col(query)) + F.octet_length(col(document))


def size_batches(costs: str | Column, limit: int = RERANK_BYTES) -> Column:
    """Batch number from 0 of each element: a batch is closed once its total exceeds `limit`, so it may go over by one."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("batch"), F.lit(0).cast("bigint").alias("total"))

    def step(acc: Column, cost: Column) -> Column:
        full = acc["total"] > limit
        batch = acc["batch"] + full.cast("int")
        return F.struct(F.concat(acc["out"], F.array(batch)).alias("out"), batch.alias("batch"), (F.when(full, F.lit(0)).otherwise(acc["total"]) + cost).cast("bigint").alias("total"))

    return F.aggregate(col(costs), start, step, lambda acc: acc["out"])


def token_batches(tokens: str | Column, most_tokens: int, most_items: int) -> Column:
    """Batch number from 0 of each element: a batch takes an element only if tokens and count stay within their limits.

    An element above the limit is a batch of its own.
    """
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("batch"), F.lit(0).cast("bigint").alias("total"), F.lit(0).alias("n"))

    def step(acc: Column, cost: Column) -> Column:
        full = (acc["n"] > 0) & ((acc["n"] + 1 > most_items) | (acc["total"] + cost > most_tokens))
        batch = acc["batch"] + full.cast("int")
        total = (F.when(full, F.lit(0)).otherwise(acc["total"]) + cost).cast("bigint")
        return F.struct(F.concat(acc["out"], F.array(batch)).alias("out"), batch.alias("batch"), total.alias("total"), (F.when(full, F.lit(0)).otherwise(acc["n"]) + 1).alias("n"))

    return F.aggregate(col(tokens), start, step, lambda acc: acc["out"])


def first_bytes(text: Column, most: Column) -> Column:
    """The longest beginning of a text within `most` UTF-8 bytes; a character that would be cut is left out."""
    cut = F.make_valid_utf8(F.substring(F.encode(text, "utf-8"), F.lit(1), most.cast("int")).cast("string"))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.rtrim(cut, F.lit("�")))


def byte_pack(texts: str | Column, budget: int = LISTWISE_BYTES, least: int = LEAST_BYTES) -> Column:
    """The texts that fit into a byte budget, in order, the last one cut; none once fewer than `least` bytes are left."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(budget).alias("left"))

    def step(acc: Column, text: Column) -> Column:
        part = first_bytes(text, acc["left"])
        taken = F.struct(F.concat(acc["out"], F.array(part)).alias("out"), (acc["left"] - F.octet_length(part)).cast("int").alias("left"))
        return F.when(acc["left"] < least, acc).otherwise(taken)

    return F.aggregate(col(texts), start, step, lambda acc: acc["out"])


def numbered_prompt(query: str | Column, texts: str | Column) -> Column:
    """A query and numbered documents as one prompt."""
    parts = F.transform(col(texts), lambda t, i: F.concat(F.lit("[Document "), i.cast("string"), F.lit("]\n"), t))
    return F.concat(F.lit("[Query]\n"), col(query), F.lit("\n\n"), F.array_join(parts, "\n\n"))

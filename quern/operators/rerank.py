"""Reranking of candidates by pluggable scorers.

A scorer takes candidates (query_id, document_id, rank, query, content, and what the scorer itself needs) and returns
(query_id, document_id, rank, reranker_score). Rows that need no score are parted before the scorer, not inside it: a
condition around a Python function does not keep it from running.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.scalar import clamp, sigmoid
from quern.functions.text import truncate, without_code_fence, words
from quern.operators.batching import LISTWISE_BYTES, byte_pack, numbered_prompt
from quern.operators.retrieve import dot
from quern.schemas import NOT_CALLED

MAX_TOKENS = 4096
Scorer = Callable[[DataFrame], DataFrame]
SCORERS: dict[str, Scorer] = {}
KEYS = ["query_id", "document_id", "rank"]


def register_scorer(name: str, scorer: Scorer) -> None:
    SCORERS[name] = scorer


def column_scorer(make: Callable[[], Column]) -> Scorer:
    """A scorer that is a column expression."""
    return lambda c: c.select(*KEYS, make().cast("double").alias("reranker_score"))


def pair_scorer(score: Callable[[pd.Series, pd.Series], pd.Series]) -> Scorer:
    """A scorer from a function of query and document series; runs on Arrow batches."""

    @F.pandas_udf("double")
    def run(query: pd.Series, content: pd.Series) -> pd.Series:
        return score(query, content)

    return lambda c: c.select(*KEYS, run("query", "content").alias("reranker_score"))


def listwise_scorer(answer: Callable[[pd.Series], pd.Series], budget: int = LISTWISE_BYTES) -> Scorer:
    """A scorer that asks a model once for each query: prompts in, replies out (JSON text with `results` of index, score)."""

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        return answer(prompts)

    def scorer(candidates: DataFrame) -> DataFrame:
        lists = candidates.groupBy("query_id", "query").agg(F.sort_array(F.collect_list(F.struct("rank", "document_id", "content"))).alias("docs"))
        asked = lists.withColumn("reply", run(numbered_prompt("query", byte_pack(F.transform("docs", lambda d: d["content"]), budget))))
        scores = asked.withColumn("scores", listwise_scores("reply", F.size("docs")))
        rows = scores.select("query_id", F.explode(F.arrays_zip("docs", "scores")).alias("x"))
        return rows.select("query_id", F.col("x.docs.document_id").alias("document_id"), F.col("x.docs.rank").alias("rank"), F.col("x.scores").alias("reranker_score"))

    return scorer


def listwise_scores(reply: str | Column, n: Column) -> Column:
    """Scores of n documents from a model's reply, each held to 0..1; missing ones 0, others' numbers ignored."""
    parsed = F.from_json(without_code_fence(reply), "struct<results:array<struct<index:int,score:double>>>")
    pairs = F.filter(F.coalesce(parsed["results"], F.array().cast("array<struct<index:int,score:double>>")), lambda r: (r["index"] >= 0) & (r["index"] < n))
    last = lambda i: F.element_at(F.filter(pairs, lambda r: r["index"] == i), -1)
    has = lambda i: F.exists(pairs, lambda r: r["index"] == i)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(has(i), F.coalesce(clamp(last(i)["score"], 0.0, 1.0), F.lit(0.0))).otherwise(F.lit(0.0)))


def calibrated(raw: str | Column) -> Column:
    """A raw logit as 0..1, stretched by 5."""
    return sigmoid(raw, 5.0)


register_scorer("vector", column_scorer(lambda: dot("query_vector", "document_vector")))
register_scorer("overlap", column_scorer(lambda: F.coalesce(F.try_divide(F.size(F.array_intersect(words("query"), words("content"))), F.size(F.array_union(words("query"), words("content")))), F.lit(0.0))))


def rerank(candidates: DataFrame, rerankers: list[str], most_tokens: int = MAX_TOKENS, on_error: str = "raise") -> DataFrame:
    """Long results (query_id, reranker, rank, document_id, human, reranker_score) of all named scorers.

    Texts are cut to `most_tokens`. A query without a positive label among its candidates is not sent to the scorers; its
    scores are -1. With `on_error="zero"` a missing score is 0, else it stays null.
    """
    if unknown := [r for r in rerankers if r not in SCORERS]:
        raise KeyError(f"no scorer {unknown}; there are {sorted(SCORERS)}")
    cut = {c: truncate(c, most_tokens) for c in ("query", "content") if c in candidates.columns}
    known = candidates.withColumn("_any", F.max(F.coalesce(F.col("human") > 0, F.lit(False))).over(Window.partitionBy("query_id"))).withColumns(cut)
    called, skipped = known.filter("_any"), known.filter("not _any")
    out = None
    for name in rerankers:
        scored = called.select(*KEYS, "human").join(SCORERS[name](called.drop("_any")), KEYS, "left")
        value = F.coalesce("reranker_score", F.lit(0.0)) if on_error == "zero" else F.col("reranker_score")
        part = scored.select(*KEYS, "human", value.alias("reranker_score")).unionByName(skipped.select(*KEYS, "human", F.lit(NOT_CALLED).alias("reranker_score")))
        part = part.withColumn("reranker", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.select("query_id", "reranker", "rank", "document_id", "human", "reranker_score")


def cache_split(rows: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(hits, misses): rows with their cached columns, and rows that the cache lacks."""
    return rows.join(cache, key), rows.join(cache.select(key), key, "left_anti")


def through_cache(rows: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame], key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(all rows with values, new cache rows): only what the cache lacks is computed, each distinct key once."""
    hits, misses = cache_split(rows, cache, key)
    fresh = compute(misses.dropDuplicates([key])).select(*cache.columns)
    return hits.unionByName(misses.join(fresh, key)), fresh


def embed(texts: DataFrame, encode: Callable[[Iterator[pd.Series]], Iterator[pd.Series]], column: str = "content") -> DataFrame:
    """`texts` with `vector` from an encoder that takes and gives batches (a model is loaded once for each worker)."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from encode(parts)

    return texts.withColumn("vector", run(F.col(column)))

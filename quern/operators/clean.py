"""Cleaning of a dataset: keys, blanks, duplicates, unjudged queries, long texts, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.scalar import map_with, text_hash
from quern.functions.text import MAX_TOKENS, chunk_count, even_chunks, is_blank, titled
from quern.schemas import Dataset


def judged(qrels: DataFrame, queries: DataFrame | None = None, documents: DataFrame | None = None) -> DataFrame:
    """The judgments whose query and document are there."""
    if queries is not None:
        qrels = qrels.join(queries.select(F.col("id").alias("query_id")), "query_id", "left_semi")
    if documents is not None:
        qrels = qrels.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    return qrels


def key_violations(df: DataFrame, *keys: str) -> DataFrame:
    """The keys that more than one row has, with `n`."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def require_keys(data: Dataset) -> None:
    """Fails where an id or a judged pair is there twice."""
    for df, keys in ((data.queries, ["id"]), (data.documents, ["id"]), (data.qrels, ["query_id", "document_id"])):
        if bad := key_violations(df, *keys).limit(3).collect():
            raise ValueError(f"more than one row has the key {[tuple(r) for r in bad]} of {keys}")


def validate(data: Dataset, check_keys: bool = True) -> Dataset:
    """Without dangling judgments; with unique keys, else an error."""
    out = data.with_(qrels=judged(data.qrels, data.queries, data.documents))
    if check_keys:
        require_keys(out)
    return out


def remove_empty_queries(data: Dataset) -> Dataset:
    queries = data.queries.filter(~is_blank("query"))
    return data.with_(queries=queries, qrels=judged(data.qrels, queries))


def remove_nonpositive_queries(data: Dataset) -> Dataset:
    """The queries with a judgment above 0, and all of their judgments."""
    wanted = data.qrels.filter("score > 0").select("query_id").distinct()
    return data.with_(queries=data.queries.join(wanted.withColumnRenamed("query_id", "id"), "id", "left_semi"), qrels=data.qrels.join(wanted, "query_id", "left_semi"))


def first_of_each(df: DataFrame, key: str, ident: str = "id") -> tuple[DataFrame, DataFrame]:
    """(rows, mapping): the first row by `ord` of each `key` value, and every ident with that of its first row.

    The first rows are found by an aggregation that combines before the shuffle, so a value that a third of the rows
    share is no hot task.
    """
    firsts = df.groupBy(F.col(key).alias("_key")).agg(F.min_by(ident, "ord").alias("kept_id"))
    mapping = df.select(F.col(ident).alias("old_id"), F.col(key).alias("_key")).join(firsts, "_key").select("old_id", "kept_id")
    rows = df.join(firsts.select(F.col("kept_id").alias(ident)), ident, "left_semi")
    return rows, mapping


def merge_qrels(qrels: DataFrame) -> DataFrame:
    """One row for each pair: the largest score, the first place."""
    return qrels.groupBy("query_id", "document_id").agg(F.max("score").alias("score"), F.min("ord").alias("ord"))


def remove_duplicates(data: Dataset) -> Dataset:
    """One query for each text and one document for each titled text; judgments move to the first of each."""
    queries, to_query = first_of_each(data.queries.withColumn("_hash", text_hash("query")), "_hash")
    title = F.try_element_at(F.col("metadata"), F.lit("title"))
    documents, to_document = first_of_each(data.documents.withColumn("_hash", text_hash(titled("content", title))), "_hash")
    moved = data.qrels.join(to_query.select(F.col("old_id").alias("query_id"), F.col("kept_id").alias("_q")), "query_id")
    moved = moved.join(to_document.select(F.col("old_id").alias("document_id"), F.col("kept_id").alias("_d")), "document_id")
    return Dataset(queries.drop("_hash"), documents.drop("_hash"), merge_qrels(moved.select(F.col("_q").alias("query_id"), F.col("_d").alias("document_id"), "score", "ord")))


def chunk_documents(documents: DataFrame, most: int = MAX_TOKENS) -> DataFrame:
    """Documents cut into even chunks `<id>-chunk-<i>`, with the whole document's id as `groupby`; short ones as they are."""
    parts = documents.withColumn("_parts", even_chunks("content", most))
    rows = parts.select("*", F.posexplode_outer("_parts").alias("_i", "_part"))
    many = F.size("_parts") > 1
    return rows.select(
        F.when(many, F.concat("id", F.lit("-chunk-"), F.col("_i").cast("string"))).otherwise(F.col("id")).alias("id"),
        F.when(many, F.col("_part")).otherwise(F.col("content")).alias("content"),
        F.when(many, map_with("metadata", "groupby", "id")).otherwise(F.col("metadata")).alias("metadata"),
        "ord", F.col("id").alias("parent_id"), F.coalesce("_i", F.lit(0)).alias("chunk"),
    )


def chunk_long_texts(data: Dataset, most: int = MAX_TOKENS, whole: DataFrame | None = None) -> Dataset:
    """Long queries become their first even chunk; long documents their chunks, each with the document's judgments.

    Chunks of judgments are counted, not cut, on `whole`, a table that holds the documents under the same ids, where one is
    given: behind a join that made the documents, their texts would have to move to be counted.
    """
    queries = data.queries.withColumn("query", F.get(even_chunks("query", most), 0))
    long = (data.documents if whole is None else whole).select(F.col("id").alias("document_id"), chunk_count("content", most).alias("_n")).filter("_n > 1")
    split = long.select("document_id", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_i")).select("document_id", F.concat("document_id", F.lit("-chunk-"), F.col("_i").cast("string")).alias("_chunk"))
    qrels = data.qrels.join(split, "document_id", "left").withColumn("document_id", F.coalesce("_chunk", "document_id")).drop("_chunk")
    return Dataset(queries, chunk_documents(data.documents, most).drop("parent_id", "chunk"), qrels)


def limit_queries(data: Dataset, limit: int | None, seed: int = 0) -> Dataset:
    """`limit` queries by seeded hash, with their judgments; all for None. Documents stay."""
    if limit is None:
        return data
    queries = data.queries.orderBy(F.sha2(F.concat(F.lit(str(seed)), F.lit(":"), F.col("id")), 256), "id").limit(limit)
    return data.with_(queries=queries, qrels=judged(data.qrels, queries))


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """`n` rows without replacement, by seeded hash of `key`."""
    return df.orderBy(F.sha2(F.concat(F.lit(str(seed)), F.lit(":"), F.col(key).cast("string")), 256), key).limit(n)


def clean_dataset(data: Dataset, most: int = MAX_TOKENS, check: bool = True) -> Dataset:
    """Validate, drop blank queries, merge duplicates, drop queries without a positive judgment, cut long texts.

    The judgments, as they come and merged, are persisted until the session's cache is cleared: the checks and the steps ask
    for them a dozen times, and a source may have had to search its texts for them.
    """
    data = data.with_(qrels=data.qrels.persist())
    merged = remove_duplicates(remove_empty_queries(validate(data, check)))
    merged = merged.with_(qrels=merged.qrels.persist())
    # checked ids are unique, so a kept document is the one of its id
    out = chunk_long_texts(remove_nonpositive_queries(merged), most, data.documents if check else None)
    if check and (out.queries.isEmpty() or out.qrels.isEmpty()):
        raise ValueError("nothing is left of the dataset")
    return out

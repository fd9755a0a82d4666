"""The test tables seen as evaluation datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.schemas import Dataset
from quern.sources.shapes import document_rows, qrel_rows, query_rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> Dataset:
    """Every tenth embedding asks for the others of its label."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), "label", F.col("vec_id").alias("ord"))
    q, d = e.filter("ord % 10 = 0"), e.filter("ord % 10 <> 0")
    pairs = q.select(F.col("id").alias("query_id"), "label").join(d.select(F.col("id").alias("document_id"), "label", "ord"), "label")
    return Dataset(q.drop("label"), d.drop("label"), pairs.select("query_id", "document_id", F.lit(1.0).alias("score"), "ord"))


def texts(spark: SparkSession, sf_dir: str) -> Dataset:
    """Benchmark items ask for the documents that hold them. The judgments come from an equality of first words, then a
    substring test, so no pair of all is formed."""
    b, d = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    item = b.select("item_id", "text", F.concat_ws(" ", F.slice(F.split("text", r"\s+"), 1, 3)).alias("head"))
    words = d.select("doc_id", F.split("text", r"\s+").alias("w"))
    three = F.transform("w", lambda x, i: F.concat_ws(" ", x, F.get("w", i + 1), F.get("w", i + 2)))  # fewer at the end
    grams = words.select("doc_id", F.explode(three).alias("head"))
    pairs = grams.join(item.select("item_id", "head"), "head").select("doc_id", "item_id").distinct()
    held = pairs.join(d.select("doc_id", F.col("text").alias("body")), "doc_id").join(b, "item_id").filter(F.contains("body", "text")).select("item_id", "doc_id")
    return Dataset(
        query_rows(b, F.col("item_id"), F.col("text"), F.col("item_id")),
        document_rows(d, F.col("doc_id"), F.col("text"), F.col("doc_id")),
        qrel_rows(held, F.col("item_id"), F.col("doc_id"), F.lit(1.0), F.col("doc_id")),
    )


def orders(spark: SparkSession, sf_dir: str) -> Dataset:
    """Orders ask for their parts; a line's quantity is the judgment."""
    o, p, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    return Dataset(
        query_rows(o, F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderkey")),
        document_rows(p, F.col("p_partkey"), F.col("p_name"), F.col("p_partkey")),
        qrel_rows(li, F.col("l_orderkey"), F.col("l_partkey"), F.col("l_quantity"), F.col("l_orderkey") * 8 + F.col("l_linenumber")),
    )


#: Bytes of a file whose rows one task sorts.
SORTED_BYTES = 4_000_000


def by_size(rows: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """`rows` of the table `source`, cut by `key` into so many parts that what one task sorts does not grow with the table; as
    they are while the session's partitions are enough."""
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = -(-size // SORTED_BYTES)
    return rows.repartition(parts, key) if parts > int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def order_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order as its retrieved documents: by falling price; the quantity is the label."""
    from quern.operators.ranking import rank_in

    li = table(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_orderkey").cast("string").alias("query_id"), F.concat_ws(":", "l_partkey", "l_linenumber").alias("document_id"), F.col("l_extendedprice").alias("score"), F.col("l_quantity").alias("human"), "l_linenumber")
    return rank_in(by_size(rows, li, "query_id"), "query_id", F.desc("score"), F.col("l_linenumber").asc()).drop("l_linenumber")

"""Files: typed JSON lines, split folders, zipped corpora, TSV judgments; nested results, idempotent writes, caches."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.scalar import scores_map, text_hash
from quern.functions.text import is_blank, strip_passage_suffix
from quern.sources.shapes import agreeing_qrels, qrel_rows, union_splits



def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines of a schema; a line that does not fit is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def read_splits(spark: SparkSession, folder: str, fmt: str = "parquet") -> DataFrame:
    """All splits of a dataset folder, with `split`; `dataset_dict.json` lists them, else every subfolder is one."""
    listed = Path(folder, "dataset_dict.json")
    names = json.loads(listed.read_text())["splits"] if listed.exists() else sorted(p.name for p in Path(folder).iterdir() if p.is_dir())
    parts = [spark.read.format(fmt).load(f"{folder}/{n}").withColumn("split", F.lit(n)) for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def zipped_lines(spark: SparkSession, path: str) -> DataFrame:
    """(member, line_no, value): the lines of all text files in zip archives, blank ones left out, read as streams."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        for part in parts:
            for content in part["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in sorted(z.namelist()):
                        rows: list[tuple[str, int, str]] = []
                        with z.open(name) as f:
                            for i, line in enumerate(io.TextIOWrapper(f, "utf-8")):
                                if line.strip():
                                    rows.append((name, i, line.rstrip("\n")))
                                if len(rows) >= 10_000:
                                    yield pd.DataFrame(rows, columns=["member", "line_no", "value"])
                                    rows = []
                        if rows:
                            yield pd.DataFrame(rows, columns=["member", "line_no", "value"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "member string, line_no bigint, value string")


def corpus_lines(lines: DataFrame) -> DataFrame:
    """Documents (id, content, metadata, ord) of JSON lines: `_id` or `document_id`, text, a title moved into metadata."""
    row = F.from_json("value", "struct<_id:string,document_id:string,text:string,title:string,metadata:map<string,string>>")
    r = lines.filter(~is_blank("value")).select("line_no", row.alias("r")).select("line_no", "r.*")
    base = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    fine = F.assert_true(is_blank("title") | F.try_element_at(base, F.lit("title")).isNull(), F.lit("title is given twice"))
    full = F.when(is_blank("title"), base).otherwise(F.map_concat(base, F.create_map(F.lit("title"), F.col("title"))))
    return r.filter(fine.isNull()).select(F.coalesce("_id", "document_id").alias("id"), F.col("text").alias("content"), full.alias("metadata"), F.col("line_no").alias("ord"))


def read_tsv_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Judgments of a TSV with header (query-id, corpus-id, score): passage ids become document ids; a pair counts once."""
    rows = spark.read.schema("`query-id` string, `corpus-id` string, score double").csv(path, sep="\t", header=True).withColumn("ord", F.monotonically_increasing_id())
    return agreeing_qrels(qrel_rows(rows, F.col("`query-id`"), strip_passage_suffix("corpus-id"), F.col("score"), F.col("ord")))


def nested_results(results: DataFrame, queries: DataFrame, method: str) -> DataFrame:
    """One row for each query: query_id, query, documents (document_id, scores of the method and, if judged, human) by rank."""
    listed = F.sort_array(F.collect_list(F.struct("rank", "document_id", "score", "human")))
    lists = results.groupBy("query_id").agg(F.transform(listed, lambda s: F.struct(s["document_id"].alias("document_id"), scores_map(method, s["score"], s["human"]).alias("scores"))).alias("documents"))
    return queries.select(F.col("id").alias("query_id"), "query").join(lists, "query_id")


def long_results(nested: DataFrame, method: str) -> DataFrame:
    """The long form of nested results: query_id, rank, document_id, score, human."""
    rows = nested.select("query_id", F.posexplode("documents").alias("i", "d"))
    return rows.select("query_id", (F.col("i") + 1).alias("rank"), F.col("d.document_id").alias("document_id"), F.try_element_at("d.scores", F.lit(method)).alias("score"), F.try_element_at("d.scores", F.lit("human")).alias("human"))


def write_if_changed(df: DataFrame, path: str, fmt: str = "json") -> bool:
    """Writes `df` unless the same rows are there already; whether it wrote.

    Rows are compared as a multiset by count and order-free hashes, which are two aggregations, not a comparison on the driver.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)

    def sign(x: DataFrame):
        h = F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])))
        return tuple(x.select(h.alias("h")).agg(F.count("h"), F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("h"))).first())

    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        there = spark.read.schema(df.schema).format(fmt).load(path)
        if sign(there) == sign(df):
            return False
    df.write.mode("overwrite").format(fmt).save(path)
    return True


def write_by_reranker(results: DataFrame, path: str) -> None:
    """One folder for each reranker, in one pass."""
    results.write.mode("overwrite").partitionBy("reranker").parquet(path)


def append_cache(fresh: DataFrame, path: str) -> None:
    """New rows of a cache table; nothing is ever evicted."""
    fresh.write.mode("append").parquet(path)


def append_usage(usage: DataFrame, path: str) -> None:
    usage.write.mode("append").csv(path)


def cache_rows(texts: DataFrame, column: str, value: str) -> DataFrame:
    """(key, value) of a cache, by the text's hash."""
    return texts.select(text_hash(column).alias("key"), F.col(value).alias("value")).dropDuplicates(["key"])


def read_ordered(spark: SparkSession, *paths: str, key: str, fmt: str = "parquet") -> DataFrame:
    """Files as splits, in order, with `ord` from a stored key."""
    return union_splits(*[spark.read.format(fmt).load(p).withColumn("ord", F.col(key).cast("bigint")) for p in paths])

"""The stages of an evaluation: ingest, retrieve, rerank, measure; each can be run alone on what the last one wrote."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.clean import limit_queries, validate
from quern.operators.metrics import NDCG_K, RECALL_K, macro_average, ndcg_per_query, recall_per_query, summary
from quern.operators.ranking import rank_in
from quern.operators.rerank import rerank
from quern.operators.retrieve import retrieve
from quern.schemas import Dataset
from quern.sources.io import write_if_changed
from quern.sources.shapes import Source

STAGES = ("ingest", "retrieve", "rerank", "ndcg")


def window(start: str, end: str) -> list[str]:
    """The stages from `start` to `end`."""
    a, b = STAGES.index(start), STAGES.index(end)
    if a > b:
        raise ValueError(f"{start} comes after {end}")
    return list(STAGES[a : b + 1])


@dataclass
class Run:
    """An evaluation of datasets under one folder; tables are Parquet, partitioned by nothing but their path."""

    spark: SparkSession
    folder: str
    method: str = "dense"
    k: int = 100
    include_relevant: bool = False
    rerankers: list[str] = field(default_factory=lambda: ["vector"])
    max_queries: int | None = 100

    def path(self, dataset: str, *parts: str) -> str:
        own = self.method + ("+include_relevant_docs" if self.include_relevant else "")
        return "/".join([self.folder, dataset, *[own if p == "@" else p for p in parts]])

    def exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def ingest(self, source: Source) -> bool:
        """Writes the dataset's three tables where they changed; whether any did."""
        data = limit_queries(validate(source.load(self.spark)), self.max_queries)
        return any([write_if_changed(getattr(data, t), self.path(source.dataset_id(), t), "parquet") for t in ("queries", "documents", "qrels")])

    def dataset(self, name: str) -> Dataset:
        return Dataset(*[self.spark.read.parquet(self.path(name, t)) for t in ("queries", "documents", "qrels")])

    def retrieve(self, name: str) -> None:
        d = self.dataset(name)
        retrieve(d.queries, d.documents, d.qrels, self.method, self.k, self.include_relevant).write.mode("overwrite").parquet(self.path(name, "@", "results"))

    def rerank(self, name: str) -> None:
        d, found = self.dataset(name), self.spark.read.parquet(self.path(name, "@", "results"))
        full = found.join(d.queries.select(F.col("id").alias("query_id"), *[F.col(c).alias("query_vector" if c == "vector" else c) for c in d.queries.columns if c in ("query", "vector")]), "query_id")
        full = full.join(d.documents.select(F.col("id").alias("document_id"), *[F.col(c).alias("document_vector" if c == "vector" else c) for c in d.documents.columns if c in ("content", "vector")]), "document_id")
        rerank(full, self.rerankers).write.mode("overwrite").partitionBy("reranker").parquet(self.path(name, "@", "scores"))

    def _long(self, name: str) -> DataFrame | None:
        """Results of retrieval and of every reranker; None where retrieval has not been run."""
        path = self.path(name, "@", "results")
        if not self.exists(path):
            return None
        found = self.spark.read.parquet(path)
        out = found.select("query_id", F.lit("retrieval").alias("ranker"), "rank", "document_id", "human", (-F.col("rank")).cast("double").alias("score"))
        if self.exists(self.path(name, "@", "scores")):
            scores = self.spark.read.parquet(self.path(name, "@", "scores"))
            out = out.unionByName(scores.join(found.select("query_id", "document_id"), ["query_id", "document_id"]).select("query_id", F.col("reranker").alias("ranker"), "rank", "document_id", "human", F.col("reranker_score").alias("score")))
        return out

    def ndcg(self, *names: str, k: int | None = NDCG_K) -> DataFrame:
        """(dataset, ranker, n, mean, stderr); datasets without results are left out."""
        parts = [summary(ndcg_per_query(r, k, ("query_id", "ranker")), "ndcg", "ranker").withColumn("dataset", F.lit(n)) for n in names if (r := self._long(n)) is not None]
        return _union(self.spark, parts)

    def recall(self, *names: str, k: int | None = RECALL_K) -> DataFrame:
        parts = [summary(recall_per_query(r, self.dataset(n).qrels, k, ("query_id", "ranker")), "recall", "ranker").withColumn("dataset", F.lit(n)) for n in names if (r := self._long(n)) is not None]
        return _union(self.spark, parts)

    def run(self, sources: list[Source], start: str = "ingest", end: str = "ndcg") -> DataFrame | None:
        """The stages of a window over all sources; the macro averages, if the last stage is among them."""
        names = [s.dataset_id() for s in sources]
        for stage in window(start, end):
            if stage == "ingest":
                for s in sources:
                    self.ingest(s)
            elif stage != "ndcg":
                for n in names:
                    getattr(self, stage)(n)
        return macro_average(self.ndcg(*names), "ranker") if end == "ndcg" else None


def _union(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    out = spark.createDataFrame([], "ranker string, n bigint, mean double, stderr double, dataset string")
    for p in parts:
        out = out.unionByName(p)
    return out


def natural_order(results: DataFrame) -> DataFrame:
    """Results with a score that keeps their rank."""
    return rank_in(results, "query_id", F.col("rank").asc(), name="rank").withColumn("score", -F.col("rank").cast("double"))

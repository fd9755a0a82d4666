"""Metrics of result files as they arrive. Each batch is scored once and appended; no state is kept between batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quern.operators.metrics import NDCG_K, ndcg_per_query
from quern.schemas import CANDIDATES


def score_arrivals(spark: SparkSession, source: str, out: str, checkpoint: str, k: int | None = NDCG_K) -> StreamingQuery:
    """Reads Parquet results under `source` and writes NDCG by query under `out`, one folder a batch, so that a batch that
    is run again replaces what it wrote. A query's rows must be in one file."""

    def batch(df: DataFrame, number: int) -> None:
        ndcg_per_query(df, k).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return spark.readStream.schema(CANDIDATES).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Shared helpers of the training-data operators: reading, cutting lineage, hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir`, or a local one where none is named (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", named)
        _remove_at_exit(spark, named)
    return named


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    def remove() -> None:
        sc = spark.sparkContext
        if sc._jsc is None or sc._jsc.sc().isStopped():
            return
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)

    atexit.register(remove)


#: Whether an execution's shuffle files go as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again: later stages do not recompute it, and a lost
    executor loses nothing. Nothing reads the shuffle files of the write again, so they go with it: else they stay until
    the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    _remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


BATCH_ROWS = 1000


def in_batches(df: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """`df`, for a function over Arrow batches of texts: where the session has Spark's default of 10,000 rows a batch, it is
    set to `rows`, since a batch is held several times over, by the executor and by each of its Python workers."""
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))
    return df


def sized_broadcast(df: DataFrame, rows: int, limit: int = 1_000_000) -> DataFrame:
    """`df`, marked for broadcast if its `rows` (counted by the caller, small rows only) are at most `limit`."""
    return F.broadcast(df) if rows <= limit else df


def without_ids(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id is not among those of `gone` (`gone_id`, distinct); a null one there matches null.

    Up to a million ids are broadcast and no text moves; more are joined.
    """
    gone = cut(gone)
    packed = docs.select(F.struct("*").alias("row"))
    return packed.join(sized_broadcast(gone, gone.count()), F.col("row.doc_id").cast("bigint").eqNullSafe(F.col("gone_id")), "left_anti").select("row.*")


def prefilter(df: DataFrame, key: str, wanted: DataFrame, bits: int = 26) -> DataFrame:
    """The rows of `df` whose bigint `key` may be among the keys of `wanted` (a column of the same name), and few others.

    A bit table of 2^bits hash values is broadcast, at most 2^(bits - 6) rows of two numbers whatever the input, so that a
    join after it moves few rows that it will not need. With more keys it lets more rows through, never fewer.
    """
    place = F.pmod(F.xxhash64(F.col(key), F.lit(26)), F.lit(1 << bits))
    words = wanted.select(place.alias("_p")).groupBy(F.shiftright("_p", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_p & 63 as int))")).alias("_mask"))
    kept = df.withColumn("_p", place).withColumn("_word", F.shiftright("_p", 6)).join(F.broadcast(words), "_word").filter(F.expr("shiftright(_mask, cast(_p & 63 as int)) & 1 = 1"))
    return kept.select(*df.columns)


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def stable_order(*cols: str) -> list[Column]:
    """An order without meaning that does not change between runs, to sample by."""
    return [F.xxhash64(*[F.col(c).cast("string") for c in cols]), *[F.col(c) for c in cols]]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5

"""Bounded samples of labelled documents, to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import crc_mod, stable_order


def labelled_ids(labels: DataFrame, column: str, modulus: int, held_out: int, per_class: int) -> DataFrame:
    """(doc_id, label): at most `per_class` ids of each of the labels 0 and 1 outside the held-out fold, by hashed id.

    Rows with a null id or label do not count; an id with both labels is left out.
    """
    usable = labels.filter(f"doc_id is not null and {column} in (0, 1)").filter(crc_mod(F.col("doc_id"), modulus) != held_out)
    one = usable.groupBy("doc_id").agg(F.min(column).alias("label"), F.max(column).alias("most")).filter("label = most").drop("most")
    rows = [(r.doc_id, r.label) for k in (0, 1) for r in one.filter(F.col("label") == k).orderBy(*stable_order("doc_id")).limit(per_class).collect()]
    return labels.sparkSession.createDataFrame(rows, "doc_id bigint, label int")


def labelled_rows(docs: DataFrame, ids: DataFrame) -> list:
    """One row of `docs` for each id of `ids`, the least, with `label`, in the order of the ids. `ids` is bounded, so it is
    broadcast, and what is collected is bounded by it."""
    rest = [c for c in docs.columns if c != "doc_id"]
    one = docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.struct(*rest, "label")).alias("row"))
    return sorted(one.select("doc_id", "row.*").collect(), key=lambda r: r.doc_id)

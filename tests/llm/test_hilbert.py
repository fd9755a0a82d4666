from collections import Counter

import pytest
from conftest_odd import ODD
from pyspark.sql import functions as F

from quern.llm.hilbert import category_step, hilbert_index, hilbert_shards, number_step, op3_hilbert_shards


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_every_cell_by_unit_steps(spark, dims, bits):
    df = spark.range((1 << bits) ** dims).select(*[F.expr(f"cast(shiftright(id, {bits * i}) & {(1 << bits) - 1} as int) as d{i}") for i in range(dims)])
    rows = df.withColumn("h", hilbert_index([F.col(f"d{i}") for i in range(dims)], bits)).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(len(rows)))
    assert all(sum(abs(a[i] - b[i]) for i in range(dims)) == 1 for a, b in zip(rows, rows[1:]))


def check_law(rows, shards):
    count = Counter(r.shard for r in rows)
    sizes = [count.get(s, 0) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(count) <= set(range(shards))
    for s in count:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(count[s]))


def test_query_on_documents(spark, small):
    rows = op3_hilbert_shards(spark, small).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    check_law(rows, 24)
    import zlib

    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {i: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs.items()}
    ordered = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.h_index for r in ordered] == sorted(r.h_index for r in rows)


def test_odd_rows_hot_cell_and_clashing_names(spark, docs_of):
    docs = docs_of([*ODD, (None, None), (3, "one"), *["hot"] * 500]).withColumn("k", F.lit(1)).withColumn("salt", F.lit("a")).withColumn("d0", F.lit(2.0))
    dims = {"lang": category_step(F.col("lang")), "n": number_step(F.col("n_chars"))}
    out = hilbert_shards(docs, "doc_id", dims, shards=7, rows_per_salt=50)
    rows = out.collect()
    assert len(rows) == docs.count() and out.columns == [*docs.columns, "h_index", "shard", "slot"]
    check_law(rows, 7)


def test_empty_and_fewer_rows_than_shards(spark, docs_of):
    dims = {"n": number_step(F.col("n_chars"))}
    assert hilbert_shards(docs_of([]), "doc_id", dims).count() == 0
    check_law(hilbert_shards(docs_of(["a", "b"]), "doc_id", dims, shards=5).collect(), 5)

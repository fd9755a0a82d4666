"""Every query of the catalogue against DuckDB on the smallest tables, and small fixtures with hand-computed results."""

import math

import duckdb
import pytest

from quern.plans import queries as catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 6) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_against_duckdb(spark, duck, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    found = duck.execute(catalogue.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=repr)
    assert got == want


def test_byte_pack_against_the_plain_fold(spark):
    folder = FOLDER
    turns = {}
    for r in spark.read.parquet(f"{folder}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append(r.text)
    for r in catalogue.QUERIES["byte_pack"](spark, folder).collect():
        left, out = 500, []
        for t in turns[r.conv_id]:
            if left < 100:
                break
            part = t.encode()[:left].decode("utf-8", "ignore")
            out.append(part)
            left -= len(part.encode())
        assert (r.texts, r.bytes) == (len(out), sum(len(p.encode()) for p in out))


def test_results_of_a_large_table_are_cut_by_its_size(spark, monkeypatch):
    from quern.operators.ranking import same_rows
    from quern.plans import views

    small = views.order_results(spark, FOLDER)
    assert "REPARTITION_BY_NUM" not in small._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(views, "SORTED_BYTES", 10_000)
    cut = views.order_results(spark, FOLDER)
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and plan.count("Exchange") == 1 and cut.rdd.getNumPartitions() >= 11
    assert same_rows(small, cut)


def test_model_text_of_blank_texts_against_duckdb(spark, tmp_path):
    texts = [None, "", " ", "\t\n", "   ", "plain text", "éighty days", "\U0001f468‍\U0001f469‍\U0001f467 family", "short"]
    rows = spark.createDataFrame([(3 * i + j, t) for i, t in enumerate(texts) for j in (0, 1, 2)], "doc_id bigint, text string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted((tuple(r) for r in catalogue.QUERIES["model_text"](spark, str(tmp_path)).select("doc_id", "reply", "sent").collect()), key=repr)
    assert got == sorted(con.execute(f"select doc_id, reply, sent from ({catalogue.SQL['model_text']})").fetchall(), key=repr)

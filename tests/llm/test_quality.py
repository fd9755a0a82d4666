import zlib

import numpy as np
from conftest_odd import ODD

from quern.llm.labelled import labelled_rows
from quern.llm.quality import FEATURES, BradleyTerry, features, op5_bradley_terry, score_quality, train_quality


def auc(y, s):
    order = np.argsort(s, kind="stable")
    y = np.asarray(y)[order]
    return float((np.cumsum(y == 0)[y == 1]).sum() / ((y == 1).sum() * (y == 0).sum()))


def test_features_are_finite_and_mark_empty_texts():
    for t in ODD:
        f = features(t)
        assert f.shape == (FEATURES,) and np.isfinite(f).all() and f[0] == (not (t or "").split())
    assert features("A B")[2] == 1.0 and features("a b")[2] == 0.0


def test_ranking_of_separable_and_of_one_sided_labels():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, FEATURES))
    y = (x[:, 3] + 0.2 * rng.normal(size=600) > 0.5).astype(int)
    s = BradleyTerry(FEATURES).fit(x, y).score(x)
    assert auc(y, s) > 0.97 and ((s >= 0.5) == y).mean() > 0.93 and (0 <= s).all() and (s <= 1).all()
    assert (BradleyTerry(FEATURES).fit(x, np.ones(600)).score(x) == 0.5).all()


def test_held_out_accuracy_of_the_query(spark):
    folder = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in op5_bradley_terry(spark, folder).collect()}
    labels = [r for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if r.doc_id in rows]
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    held = [r for r in labels if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(rows[r.doc_id].held_out for r in held)
    y, s = [r.quality for r in held], [rows[r.doc_id].score for r in held]
    print("auc", auc(y, s), "accuracy", np.mean([(a >= 0.5) == b for a, b in zip(s, y)]))
    assert auc(y, s) >= 0.95


def test_odd_rows(spark, docs_of):
    docs = docs_of([*ODD, (None, "a b"), (4, "Two words")]).selectExpr("*", "1 as features", "2 as label")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(8)] + [(None, 1, 1), (3, None, None), (2, 1, 0)], "doc_id bigint, quality int, toxic int")
    rows = score_quality(docs, train_quality(docs, labels)).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert {r.score for r in score_quality(docs, train_quality(docs, labels.limit(0))).collect()} == {0.5}
    assert score_quality(docs.limit(0), train_quality(docs.limit(0), labels)).count() == 0


def test_one_row_is_collected_for_a_repeated_id(spark, docs_of):
    docs = docs_of([(1, "b"), (1, "a"), *[(2, "same")] * 50, (3, None), (4, "other")])
    ids = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id bigint, label int")
    got = [(r.doc_id, r.text, r.label) for r in labelled_rows(docs.select("doc_id", "text"), ids)]
    assert got == [(1, "a", 1), (2, "same", 0), (3, None, 0)]

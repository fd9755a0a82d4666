import zlib

import numpy as np
import pytest
from conftest_odd import ODD

from quern.llm.gru import LETTER, BiGRU, document_probabilities, identify, op2_byte_gru, train_language_model, training_sample


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    net = BiGRU(3, hidden=4)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, y = rng.integers(95, 105, (7, 5)), rng.integers(0, 3, 5)
    weight = rng.integers(0, 2, (7, 5)).astype(float)
    _, grad = net.gradients(x, y, weight)
    for k, w in net.w.items():
        for at in [tuple(rng.integers(0, n) for n in w.shape) for _ in range(4)] + [(0, 97) if k[0] == "E" else (0, 0)]:
            old, eps = w[at], 1e-3
            w[at] = old + eps
            up = net.gradients(x, y, weight)[0]
            w[at] = old - eps
            down = net.gradients(x, y, weight)[0]
            w[at] = old
            assert (up - down) / (2 * eps) == pytest.approx(grad[k][at], abs=2e-3)


def test_pooling_is_the_mean_over_all_letters_in_whatever_batches():
    net = BiGRU(2, hidden=4)
    texts = ["abc " * 300, "x", None, "é!é", "long " * 5000]
    one = document_probabilities(net, 2, texts, chunk=7)
    np.testing.assert_allclose(one, document_probabilities(net, 2, texts, chunk=5000), atol=1e-5)
    x = np.full(64, 32, np.uint8)
    x[:4] = np.frombuffer("é!é".encode(), np.uint8)[[0, 1, 2, 3]]
    x[4] = "é!é".encode()[4]
    p = net.probabilities(x[:, None])[:, :, 0]
    np.testing.assert_allclose(one[3], p[LETTER[x]].mean(axis=0), atol=1e-5)
    assert one[2].tolist() == [0, 0] and one.sum(axis=1)[[0, 1, 3, 4]] == pytest.approx(1, abs=1e-4)


def test_held_out_accuracy_of_the_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in op2_byte_gru(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        assert rows[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 5 == 0) and 0 <= rows[d.doc_id].score <= 1
    held = [d for d in docs if rows[d.doc_id].held_out]
    assert np.mean([rows[d.doc_id].lang_pred == d.lang for d in held]) >= 0.97


def test_odd_rows(spark, docs_of):
    docs = docs_of([*ODD, (None, "the and of with"), (4, "Two words")]).selectExpr("*", "1 as score", "2 as lang_pred")
    net, labels = train_language_model([("the cat and the dog of that", "en"), ("der Hund und die Katze", "de")], steps=5)
    rows = identify(docs, net, labels).collect()
    assert len(rows) == docs.count()
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert und == {0, 1, 2, 8} and all(r.score == 0 for r in rows if r.doc_id in und)
    assert identify(docs.limit(0), net, labels).count() == 0
    assert {r.lang_pred for r in identify(docs, *train_language_model([])).collect()} == {"und"}


def test_sample_keeps_the_fold_out_and_its_bound(spark, docs_of):
    docs = docs_of([f"text number {i}" for i in range(400)])
    sample = training_sample(docs, rows=50)
    assert 30 <= len(sample) <= 50
    assert all(zlib.crc32(t.split()[-1].encode()) % 5 for t, _ in sample)
    assert sample == training_sample(docs.repartition(7), rows=50)

import random
import zlib

import numpy as np
import pytest
from conftest_odd import ODD
from test_quality import auc

from quern.llm.toxicity import LexiconAutomaton, ToxicityModel, learn_lexicon, op10_levenshtein_trie, score_toxicity, train_toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain(word, entries):
    hits = []
    for term, (open_, edits) in entries.items():
        least = min(distance(word[:k], term) for k in range(len(word) + 1)) if open_ else distance(word, term)
        if least <= edits:
            hits.append((least, term))
    return min(hits) if hits else None


def test_automaton_against_all_distances():
    rng = random.Random(4)
    entries = {"abcab": (False, 1), "abc": (False, 0), "bbcacab": (False, 2), "cabb": (True, 1), "aaa": (True, 0), "bacba": (False, 2)}
    automaton = LexiconAutomaton(entries)
    for _ in range(4000):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))
        assert automaton.find(w) == plain(w, entries), w


def sample():
    rng = random.Random(1)
    filler = [f"wort{c}{d}" for c in "abcdefgh" for d in "klmnop"]
    clean = [(" ".join(rng.choices(filler, k=30)), 0) for _ in range(200)]
    toxic = [(" ".join(rng.choices(filler, k=20) + ["nincompoop", "zanki" + rng.choice("abcdef")]), 1) for _ in range(60)]
    return clean + toxic


def test_lexicon_of_terms_and_stems():
    lexicon = learn_lexicon(sample())
    assert set(lexicon) == {"nincompoop", "zanki"}
    assert lexicon["nincompoop"][:2] == (False, 2) and lexicon["zanki"][0]


def test_misspelled_and_quoted_terms():
    model = ToxicityModel(learn_lexicon(sample())).fit(sample())
    rest = "worta b " * 10
    plain_ = model.score(f"{rest} nincompoop nincompoop")
    assert plain_ > 0.5 and model.score(f"{rest} nincompop nincompooop") > 0.5
    assert model.score(rest) < 0.5 and model.score(f'{rest} he said "nincompoop"') < plain_
    assert model.score(f"{rest} you nincompoop") > model.score(f'{rest} the word "nincompoop"')


def test_held_out_accuracy_of_the_query(spark):
    folder = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in op10_levenshtein_trie(spark, folder).collect()}
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    held = [r for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(rows[r.doc_id].held_out for r in held)
    y, s = [r.toxic for r in held], [rows[r.doc_id].score for r in held]
    print("auc", auc(y, s), "accuracy", np.mean([(a >= 0.5) == b for a, b in zip(s, y)]))
    assert np.mean([(a >= 0.5) == b for a, b in zip(s, y)]) >= 0.97


def test_odd_rows(spark, docs_of):
    docs = docs_of([*ODD, (None, "a b"), (4, "Two words")]).selectExpr("*", "1 as score", "2 as label")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(8)] + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    model = train_toxicity(docs, labels)
    rows = score_toxicity(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in score_toxicity(docs, train_toxicity(docs, labels.limit(0))).collect()} == {0.5}
    assert score_toxicity(docs.limit(0), model).count() == 0
    assert pytest.approx(model.score(None)) == model.score("")

import random

import numpy as np
from conftest_odd import ODD

from quern.llm.decontaminate import GAP, MATCH, MISMATCH, Items, clean_of_leaks, find_leaks, op7_seed_alignment, slices, smith_waterman, words_of


def plain_alignment(a, b):
    best, table = (0, 0), [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (MATCH if x == y else MISMATCH), table[i - 1][j] + GAP, table[i][j - 1] + GAP)
            best = max(best, (table[i][j], -j))
    return best[0]


def test_alignments_against_the_plain_table():
    rng = random.Random(2)
    pairs = [(np.array(rng.choices(range(6), k=rng.randint(1, 20))), np.array(rng.choices(range(-1, 6), k=rng.randint(1, 30)))) for _ in range(200)]
    for (a, b), (score, start, end, matches) in zip(pairs, smith_waterman(pairs)):
        b = [x if x >= 0 else -9 for x in b.tolist()]
        assert score == plain_alignment(a.tolist(), b)
        if score:
            assert plain_alignment(a.tolist(), b[start:end]) == score and 0 < matches <= end - start
    assert smith_waterman([]) == []


def test_query_against_aligning_everything(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    items = spark.read.parquet(f"{small}/benchmark.parquet").collect()
    own = Items([(r.item_id, r.text) for r in items])
    want = set()
    for d in docs:
        w = own.numbers(d.text)
        for s in range(0, len(own.words), 40):
            for k, (score, *_) in enumerate(smith_waterman([(x, w) for x in own.words[s : s + 40]])):
                if score / (2 * len(own.words[s + k])) >= 0.5:
                    want.add((d.doc_id, own.ids[s + k], score))
    assert want and {(r.doc_id, r.item_id, r.score) for r in op7_seed_alignment(spark, small).collect()} == want


def test_edited_copies_in_hot_and_long_documents(spark, docs_of):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(4000)]
    make = lambda n: rng.choices(vocabulary, k=n)
    items = [make(40) for _ in range(12)]
    texts, want = [], set()
    for i in range(60):
        text = make(rng.choice([30, 300, 4000]))
        if i % 3 == 0:
            k = 0 if i % 2 else i % 12  # item 0 is hot
            copy = list(items[k])
            for _ in range(6):
                at = rng.randrange(len(copy))
                what = rng.randrange(3)
                copy[at : at + 1] = [] if what == 0 else [rng.choice(vocabulary)] if what == 1 else [copy[at], rng.choice(vocabulary)]
            at = rng.randrange(len(text))
            text[at:at] = copy
            want.add((i, 100 + k))
        texts.append(" ".join(text).capitalize().replace(" ", rng.choice([" ", "  ", ", ", "\n"])))
    benchmark = spark.createDataFrame([(100 + k, " ".join(x)) for k, x in enumerate(items)], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in find_leaks(docs_of(texts), benchmark).collect()} == want
    parts = list(slices(benchmark, 100))
    assert len(parts) > 2 and sorted(i for p in parts for i, _ in p) == list(range(100, 112))
    left = {r.doc_id for r in clean_of_leaks(docs_of(texts), benchmark).collect()}
    assert left == set(range(60)) - {d for d, _ in want}


def test_odd_rows(spark, docs_of):
    docs = docs_of([*ODD, (None, "the item of ten words that is looked for everywhere here"), (4, "Two words"), (70, "so two words are there")]).selectExpr("*", "1 as item_id", "2 as leaky", "'r' as row")
    items = [(1, "The item of ten words that is looked for everywhere"), (2, None), (3, ""), (None, "x"), (4, "two words"), (1, "The item of ten words that is looked for everywhere")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "3 as doc_id")
    assert sorted(str((r.doc_id, r.item_id)) for r in find_leaks(docs, benchmark).collect()) == sorted(map(str, [(None, 1), (4, 4), (70, 4)]))
    out = clean_of_leaks(docs, benchmark)
    assert out.columns == docs.columns and out.count() == docs.count() - 4
    assert find_leaks(docs, benchmark.limit(0)).count() == find_leaks(docs.limit(0), benchmark).count() == 0
    assert words_of("A-b c_d") == ["a", "b", "c_d"]


def test_heavily_edited_copies_against_aligning_everything(spark, docs_of):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(3000)]
    items = [rng.choices(vocabulary, k=rng.randint(15, 59)) for _ in range(40)]
    texts = []
    for i in range(200):
        copy = list(items[i % 40])
        if i < 80:
            copy[i % 5 :: 5 + i // 40] = ["changed"] * len(copy[i % 5 :: 5 + i // 40])
        else:
            for at in rng.sample(range(len(copy)), round(len(copy) * rng.uniform(0.2, 0.3))):
                copy[at] = rng.choice(vocabulary)
        texts.append(" ".join([*rng.choices(vocabulary, k=30), *copy, *rng.choices(vocabulary, k=30)]))
    own = Items([(k, " ".join(x)) for k, x in enumerate(items)])
    want = set()
    for d, text in enumerate(texts):
        for k, (score, *_) in enumerate(smith_waterman([(x, own.numbers(text)) for x in own.words])):
            if score / (MATCH * len(own.words[k])) >= 0.5:
                want.add((d, k, score))
    benchmark = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.score) for r in find_leaks(docs_of(texts), benchmark).collect()}
    assert len(want) > 150 and got <= want and len(got) >= 0.99 * len(want)
    assert {w for w in want if w[0] < 80} <= got

"""Edge cases with results computed by hand."""

import math
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.functions import scalar as S
from quern.functions import text as X
from quern.operators import batching, chat, clean, metrics, ranking, rerank, retrieve
from quern.schemas import Dataset, dense_ordinal
from quern.sources import shapes

RESULTS = "query_id string, document_id string, rank int, score double, human double"
QRELS = "query_id string, document_id string, score double, ord bigint"
QUERIES = "id string, query string, metadata map<string,string>, ord bigint"
DOCUMENTS = "id string, content string, metadata map<string,string>, ord bigint"


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {_kind(v)}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def _kind(v):
    if isinstance(v, list):
        return f"array<{_kind(v[0])}>"
    return {str: "string", int: "bigint", float: "double"}[type(v)]


def test_tied_scores_keep_retrieval_order(spark):
    df = spark.createDataFrame([("q", "a", 1, 0.5, 0.0), ("q", "b", 2, 0.5, 1.0)], RESULTS)
    r = metrics.ndcg_per_query(df).first()
    assert r.dcg == pytest.approx(1 / math.log2(3)) and r.idcg == 1.0


def test_queries_without_gain_and_single_queries(spark):
    df = spark.createDataFrame([("q", "a", 1, 1.0, 0.0), ("p", "a", 1, 1.0, None), ("r", "a", 1, 1.0, 2.0)], RESULTS)
    per = metrics.ndcg_per_query(df)
    assert [r.query_id for r in per.collect()] == ["r"]
    s = metrics.summary(per, "ndcg").first()
    assert s.n == 1 and s["mean"] == 1.0 and math.isnan(s.stderr)
    none = metrics.summary(per.limit(0), "ndcg").first()
    assert none.n == 0 and math.isnan(none["mean"])
    assert math.isnan(metrics.macro_average(metrics.summary(per.limit(0), "ndcg")).first().macro_mean)


def test_recall_of_no_judgments_and_of_graded_ones(spark):
    df = spark.createDataFrame([("q", "a", 1, 1.0, 2.0), ("p", "a", 1, 1.0, None)], RESULTS)
    qrels = spark.createDataFrame([("q", "a", 2.0, 0)], QRELS)
    got = {r.query_id: r.recall for r in metrics.recall_per_query(df, qrels).collect()}
    assert got == {"q": 0.5, "p": 1.0}
    assert {r.query_id: r.recall for r in metrics.recall_per_query(df, qrels, denominator="count").collect()}["q"] == 1.0


def test_forced_inclusion(spark):
    found = spark.createDataFrame([("q", "a", 1, 0.5, None), ("q", "b", 2, -0.1, None), ("q", "c", 3, -0.2, None)], RESULTS).drop("human")
    out = retrieve.force_include(found, spark.createDataFrame([("q", "d", 1.0, 0)], QRELS), 3).orderBy("rank").collect()
    assert [(r.document_id, r.score) for r in out] == [("a", 0.5), ("d", 0.0), ("b", -0.1)]
    many = spark.createDataFrame([("q", f"d{i}", 1.0, i) for i in (1, 2, 3)], QRELS)
    assert [r.document_id for r in retrieve.force_include(found, many, 2).orderBy("rank").collect()] == ["d1", "d2"]


def test_fusion_ties_go_by_the_dense_arm(spark):
    arm = lambda *ids: spark.createDataFrame([("q", d, i + 1) for i, d in enumerate(ids)], "query_id string, document_id string, rank int")
    out = retrieve.fuse(arm("a", "b"), arm("b", "a"), 5).orderBy("rank").collect()
    assert [(r.document_id, r.score) for r in out] == [("a", 1.5), ("b", 1.5)]


def plain_bm25(query, docs, k1=1.5, b=0.75, eps=0.25):
    words = [d.lower().split() for d in docs]
    mean = sum(map(len, words)) / len(words)
    df = {}
    for w in words:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    raw = {t: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    average = sum(raw.values()) / len(raw)
    idf = {t: x if x >= 0 else eps * average for t, x in raw.items()}
    return [sum(idf.get(t, 0) * w.count(t) * (k1 + 1) / (w.count(t) + k1 * (1 - b + b * len(w) / mean)) for t in query.lower().split()) for w in words]


def test_bm25_with_every_document_scored(spark):
    rng = random.Random(1)
    docs = [" ".join(rng.choices("alpha beta Gamma delta eps zeta eta theta".split(), k=rng.randint(1, 9))) for _ in range(30)] + ["x y", "unique"]
    queries = ["alpha alpha zeta", "nothing here", "unique BETA"]
    q = spark.createDataFrame([(str(i), t, None, i) for i, t in enumerate(queries)], QUERIES)
    d = spark.createDataFrame([(f"d{i}", t, None, i) for i, t in enumerate(docs)], DOCUMENTS)
    for k in (5, 31, 100):
        got = {}
        for r in retrieve.bm25_topk(q, d, k).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.document_id, round(r.score, 6)))
        for i, t in enumerate(queries):
            score = plain_bm25(t, docs)
            order = sorted(range(len(docs)), key=lambda j: (-round(score[j], 9), j))[:k]
            assert got[str(i)] == [(f"d{j}", round(score[j], 6) + 0.0) for j in order]
    assert retrieve.bm25_topk(q, d.limit(0), 3).count() == 0


def test_dense_search_in_blocks(spark):
    rng = np.random.default_rng(2)
    q, d = rng.normal(size=(7, 4)), rng.normal(size=(50, 4)).round(1)
    dq = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(q)], "id string, vector array<double>")
    dd = spark.createDataFrame([(f"d{i}", i, v.tolist()) for i, v in enumerate(d)] + [("none", 99, None)], "id string, ord bigint, vector array<double>")
    for size in (8, 10**6):
        got = {(r.query_id, r["rank"]): r.document_id for r in retrieve.dense_topk(dq, dd, 5, size).collect()}
        for i in range(7):
            order = np.lexsort((np.arange(50), -(d @ q[i])))[:5]
            assert [got[str(i), k + 1] for k in range(5)] == [f"d{j}" for j in order]
    assert retrieve.dense_topk(dq.limit(0), dd, 5).count() == 0 and retrieve.dense_topk(dq, dd.limit(0), 5).count() == 0


def test_batches(spark):
    assert one(spark, batching.size_batches("a", 10), a=[6, 6, 6]) == [0, 0, 1]
    assert one(spark, batching.token_batches("a", 10, 9), a=[6, 6, 6]) == [0, 1, 2]
    assert one(spark, batching.token_batches("a", 100, 2), a=[1, 1, 1]) == [0, 0, 1]
    assert one(spark, batching.token_batches("a", 10, 9), a=[60, 1]) == [0, 1]


def test_byte_budgets_never_cut_a_character(spark):
    rng = random.Random(3)
    for _ in range(15):
        texts = ["".join(rng.choices("ab é中😀", k=rng.randint(0, 80))) for _ in range(4)]
        left, want = 150, []
        for t in texts:
            if left < 100:
                break
            want.append(t.encode()[:left].decode("utf-8", "ignore"))
            left -= len(want[-1].encode())
        assert one(spark, batching.byte_pack("a", 150), a=texts) == want


def test_even_chunks(spark):
    for n, sizes in ((5000, [2500, 2500]), (4096, [4096]), (8193, [2731, 2731, 2731]), (1, [1])):
        assert [len(c) for c in one(spark, X.even_chunks("a"), a="é" * n)] == sizes


def test_text_functions(spark):
    assert one(spark, X.strip("a"), a="　\x1c a b\n ") == "a b"
    assert one(spark, X.is_blank("a"), a=" \x85 ") is True
    assert one(spark, X.words("a"), a=" A b C ") == ["a", "b", "c"]
    assert one(spark, X.strip_passage_suffix("a"), a="doc-12-0-512") == "doc-12"
    assert one(spark, X.letters_only("a"), a="Ab-C 3_é") == "abc3é"
    assert one(spark, X.without_code_fence("a"), a='```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, X.repaired_input("a", 3), a=" \t") == " " and one(spark, X.repaired_input("a", 3), a="abcd") == "abc"
    assert one(spark, X.titled_variant(F.lit("c"), F.parse_json("a")), a='{"title": "t"}') == "Title: t\nContent: c"
    for m in ('{"title": 3}', '{"title": ""}', "{}"):
        assert one(spark, X.titled_variant(F.lit("c"), F.parse_json("a")), a=m) == "c"


def test_scores_and_contents_of_json(spark):
    for text, want in (('"abc"', 1.0), ('{"relevance": 2}', 2.0), ('{"score": 3, "relevance": 2}', 3.0), ("4.5", 4.5), ('"7"', 7.0), ('{"x": "no", "y": "5"}', 5.0), ("[1]", 1.0), ("{}", 1.0)):
        assert one(spark, S.score_value("a"), a=text) == want, text
    for text, want in (('"abc"', "abc"), ('{"only": "x"}', "x"), ('{"n": 1, "query": "q"}', "q"), ('{"n": 1, "t": "first"}', "first")):
        assert one(spark, S.query_content("a"), a=text) == want, text
    for text, want in (('"abc"', "abc"), ('{"text": "x"}', "x"), ('{"title": "t", "text": "x"}', "t\n\nx"), ("12", "12")):
        assert one(spark, S.document_content("a"), a=text) == want, text


def test_scalars(spark):
    assert one(spark, S.text_hash("a"), a="x") == "2d711642b726b04401627ca9fbac32f5"
    assert one(spark, S.clamp("a", 0.0, 1.0), a=7.0) == 1.0 and math.isnan(one(spark, S.clamp("a", 0.0, 1.0), a=float("nan")))
    with pytest.raises(ValueError):
        S.clamp("a", 2, 1)
    assert one(spark, S.argsort("a"), a=[3, 1, 2, 1]) == [1, 3, 2, 0]
    assert one(spark, S.sorted_by_keys("a", "b"), a=["x", "y", "z"], b=[2, 1, 1]) == ["y", "z", "x"]
    assert one(spark, S.sorted_by_keys("a", "b", True), a=["x", "y", "z"], b=[2, 1, 1]) == ["x", "y", "z"]
    assert one(spark, S.half_floats("a"), a="ADwAwA==") == [1.0, -2.0]
    assert 0 <= one(spark, S.hash_bucket("a", 7), a="x") < 7
    with pytest.raises(Exception, match="no r among"):
        one(spark, S.map_strict(F.create_map(F.lit("h"), F.lit(1.0)), "r"))


LONG = " ".join(map(str, range(2000)))[:5000]


def dirty(spark):
    q = spark.createDataFrame([("1", "same", None, 0), ("2", "same", None, 1), ("3", " 　", None, 2), ("4", "lonely", None, 3), ("5", "l" * 5000, None, 4)], QUERIES)
    d = spark.createDataFrame([("a", "text", None, 0), ("b", "text", {}, 1), ("c", "text", {"title": "T"}, 2), ("d", LONG, {"k": "v", "groupby": "old"}, 3)], DOCUMENTS)
    r = spark.createDataFrame([("1", "a", 1.0, 0), ("2", "b", 3.0, 1), ("3", "a", 1.0, 2), ("4", "a", 0.0, 3), ("5", "d", 1.0, 4), ("9", "a", 1.0, 5), ("1", "zz", 1.0, 6), ("5", "c", -1.0, 7)], QRELS)
    return Dataset(q, d, r)


def test_cleaning(spark):
    out = clean.clean_dataset(dirty(spark))
    assert sorted((r.id, len(r.query)) for r in out.queries.collect()) == [("1", 4), ("5", 2500)]
    docs = {r.id: r for r in out.documents.collect()}
    assert set(docs) == {"a", "c", "d-chunk-0", "d-chunk-1"} and docs["d-chunk-1"].metadata == {"k": "v", "groupby": "d"} and len(docs["d-chunk-1"].content) == 2500
    assert sorted((r.query_id, r.document_id, r.score) for r in out.qrels.collect()) == [("1", "a", 3.0), ("5", "c", -1.0), ("5", "d-chunk-0", 1.0), ("5", "d-chunk-1", 1.0)]
    again = clean.clean_dataset(out)
    assert ranking.same_rows(again.qrels.select("query_id", "document_id", "score"), out.qrels.select("query_id", "document_id", "score"))
    bad = dirty(spark)
    with pytest.raises(ValueError):
        clean.validate(bad.with_(documents=bad.documents.unionByName(bad.documents.limit(1))))
    with pytest.raises(ValueError):
        clean.clean_dataset(bad.with_(qrels=bad.qrels.limit(0)))


def test_cleaning_asks_for_the_judgments_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        read.add(1)
        return x

    data = dirty(spark)
    n = data.qrels.count()
    out = clean.clean_dataset(data.with_(qrels=data.qrels.withColumn("score", counted("score"))))
    want = clean.clean_dataset(data)
    assert ranking.same_rows(out.qrels, want.qrels) and ranking.same_rows(out.queries.select("id", "query"), want.queries.select("id", "query"))
    assert 0 < read.value <= n
    long = spark.createDataFrame([("d", "x" * 9000, None, 0), ("e", "é" * 3000, None, 1), ("f", None, None, 2), ("g", "y", None, 3)], DOCUMENTS)
    qrels = spark.createDataFrame([("q", d, 1.0, i) for i, d in enumerate("defg")], QRELS)
    cut = clean.chunk_long_texts(data.with_(documents=long, qrels=qrels))
    assert {r.document_id for r in cut.qrels.collect()} == {r.id for r in cut.documents.collect()} == {"d-chunk-0", "d-chunk-1", "d-chunk-2", "e", "f", "g"}


def test_sampling_is_seeded(spark):
    data = dirty(spark)
    a, b = (sorted(r.id for r in clean.limit_queries(data, 3, s).queries.collect()) for s in (1, 1))
    assert a == b and len(a) == 3 and clean.limit_queries(data, None).queries.count() == 5


def test_numbering(spark):
    df = spark.createDataFrame([("7", 0), ("7", 1), ("8", 2)], "qid string, ord bigint")
    assert sorted(r.qid for r in ranking.numbered_duplicates(df, "qid").collect()) == ["7", "7_1", "8"]
    wide = spark.range(1000).select((999 - F.col("id")).alias("v")).repartition(9)
    assert all(r.v == r.ord for r in dense_ordinal(wide, "v").collect())
    assert [r.id for r in ranking.last_by(df.withColumnRenamed("ord", "id").withColumn("ord", F.col("id")), "qid").orderBy("id").collect()] == [1, 2]


def test_dense_search_holds_few_scores():
    rng = np.random.default_rng(3)
    q, d = rng.integers(-3, 4, (20_000, 4)).astype(float), rng.integers(-3, 4, (700, 4)).astype(float)
    ids = np.array([str(i) for i in range(len(q))], object)
    place = rng.permutation(len(d))
    batches = [pa.RecordBatch.from_arrays([pa.array([f"d{i}" for i in range(s, s + 100)]), pa.array(place[s : s + 100]), pa.array(d[s : s + 100].tolist())], names=["document_id", "ord", "vector"]) for s in range(0, 700, 100)]
    tracemalloc.start()
    got, rows = {}, []
    for b in retrieve.best_of(ids, q, 10)(iter(batches)):
        rows.append(b.num_rows)
        for i, x in zip(b.column(0).to_pylist()[:200], b.column(1).to_pylist()[:200]):
            got.setdefault(i, []).append(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(rows) == 200_000 and max(rows) <= 50_000 and peak < 130_000_000
    for i, found in got.items():
        score = d @ q[int(i)]
        assert found == [f"d{j}" for j in sorted(range(len(d)), key=lambda j: (-score[j], place[j]))[:10]]
    few = retrieve.best_of(ids[:2], q[:2], 300)(iter(batches[:1]))
    assert sum(b.num_rows for b in few) == 200 and not any(b.num_rows for b in retrieve.best_of(ids[:2], q[:2], 5)(iter([])))


def test_words_of_odd_texts(spark):
    texts = [None, "", " ", "\u2003A\u00a0b\x1cC\n\n d\u3000", "x", "\x85x\x85", "É\tß\u200bz", "a\x00b c"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.words("t").alias("w")).orderBy("i").collect()
    assert [r.w for r in got] == [[w.lower() for w in (t or "").split()] for t in texts]


def test_bm25_moves_words_of_queries_and_no_pairs(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 2) for _ in range(rng.randint(0, 9))) for _ in range(300)]
    asked = ["a b cc", "dd dd", "nothing", "jj a"]
    docs = spark.createDataFrame([(f"d{i}", t, None, i) for i, t in enumerate(texts)], DOCUMENTS)
    queries = spark.createDataFrame([(f"q{i}", t, None, i) for i, t in enumerate(asked)], QUERIES)
    found = retrieve.bm25_topk(queries, docs, 7)
    plan = retrieve.bm25_topk(queries.filter("id in ('q0', 'q3')"), docs, 2)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\((query_id#\d+, ord#\d+L?|ord#\d+L?, term#\d+),", plan)
    words = [t.split() for t in texts]
    n, mean = len(words), sum(map(len, words)) / len(words)
    df = {t: sum(t in w for w in words) for t in {t for w in words for t in w}}
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    idf = {t: v if v >= 0 else 0.25 * sum(raw.values()) / len(raw) for t, v in raw.items()}
    for i, t in enumerate(asked):
        score = [sum(idf.get(x, 0) * w.count(x) * 2.5 / (w.count(x) + 1.5 * (0.25 + 0.75 * len(w) / mean)) for x in t.split()) for w in words]
        want = sorted(range(n), key=lambda j: (-round(score[j], 9), j))[:7]
        got = found.filter(F.col("query_id") == f"q{i}").orderBy("rank").collect()
        assert [r.document_id for r in got] == [f"d{j}" for j in want]
        assert np.allclose([r.score for r in got], [score[j] for j in want])


def test_numbering_of_more_rows_than_a_sample_holds(spark):
    rows = spark.range(60_000).select((F.col("id") * 3).alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("wide")).repartition(7)
    got = dense_ordinal(rows, "v").select("v", "ord", "wide").collect()
    assert len(got) == 60_000 and all(r.v == 3 * r.ord for r in got)
    few = spark.createDataFrame([(None, 1), (5, 2), (5, 1), (2, 9)], "k int, i int")
    assert [(r.k, r.i) for r in dense_ordinal(few, "k", "i").orderBy("ord").collect()] == [(None, 1), (2, 9), (5, 1), (5, 2)]
    assert dense_ordinal(few.limit(0), "k").count() == 0


def test_numbered_arrays_of_many_rows(spark):
    raw = spark.range(30_000).select(F.col("id").alias("ord"), F.array(F.col("id").cast("string"), F.lit("x")).alias("t"))
    d = shapes.array_rows(raw, "ord", "t")
    both = d.qrels.join(d.documents.select(F.col("id").alias("document_id"), "content"), "document_id").collect()
    assert len(both) == 60_000 and all(int(r.document_id) == 2 * int(r.query_id) + (r.content == "x") for r in both)


def candidates(spark):
    rows = [("q", "a", 1, 1.0, "find me", "you find me"), ("q", "b", 2, None, "find me", "nothing"), ("p", "a", 1, None, "other", "you find me")]
    return spark.createDataFrame(rows, "query_id string, document_id string, rank int, human double, query string, content string")


def test_scorers_are_called_only_where_a_label_is(spark):
    calls = spark.sparkContext.accumulator(0)

    def score(query, content):
        calls.add(len(query))
        return content.str.len().astype(float)

    rerank.register_scorer("length", rerank.pair_scorer(score))
    got = {(r.query_id, r.document_id): r.reranker_score for r in rerank.rerank(candidates(spark), ["length"]).collect()}
    assert got == {("q", "a"): 11.0, ("q", "b"): 7.0, ("p", "a"): -1.0} and calls.value == 2
    two = rerank.rerank(candidates(spark), ["length", "overlap"])
    assert {r.reranker for r in two.collect()} == {"length", "overlap"}
    with pytest.raises(KeyError):
        rerank.rerank(candidates(spark), ["unknown"])


def test_listwise_replies(spark):
    reply = '```json\n{"results": [{"index": 1, "score": 7}, {"index": 0, "score": 0.25}, {"index": 9, "score": 1}]}\n```'
    assert one(spark, rerank.listwise_scores("a", F.lit(3)), a=reply) == [0.25, 1.0, 0.0]
    assert one(spark, rerank.listwise_scores("a", F.lit(2)), a="no json") == [0.0, 0.0]
    rerank.register_scorer("listwise", rerank.listwise_scorer(lambda prompts: prompts.map(lambda p: '{"results": [{"index": 0, "score": 0.5}]}')))
    got = {(r.query_id, r.document_id): r.reranker_score for r in rerank.rerank(candidates(spark), ["listwise"]).collect()}
    assert got[("q", "a")] == 0.5 and got[("q", "b")] == 0.0 and got[("p", "a")] == -1.0


def test_cache(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "key string, n int")
    cache = spark.createDataFrame([("a", 10.0)], "key string, value double")
    every, fresh = rerank.through_cache(rows, cache, lambda m: m.withColumn("value", F.lit(5.0)))
    assert sorted((r.n, r.value) for r in every.collect()) == [(1, 10.0), (2, 5.0), (3, 5.0)] and fresh.count() == 1


def test_chat(spark):
    t = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "assistant", "a"), (1, 2, "assistant", "b"), (1, 3, "user", "c"), (2, 0, "user", "d")], "conv_id int, turn int, role string, text string")
    merged = chat.merge_roles(t, delimiter="+").orderBy("conv_id", "turn").collect()
    assert [(r.conv_id, r.turn, r.role, r.text) for r in merged] == [(1, 0, "system", "s"), (1, 1, "assistant", "a+b"), (1, 2, "user", "c"), (2, 0, "user", "d")]
    m = chat.messages(t).orderBy("conv_id")
    got = m.select(chat.system_text("messages").alias("s"), chat.starting_with_user(chat.without_system("messages")).alias("m")).collect()
    assert [r.s for r in got] == ["s", None] and [x.role for x in got[0].m] == ["user", "assistant", "assistant", "user"] and len(got[1].m) == 1


def test_retrieve_dispatch(spark):
    q = spark.createDataFrame([("1", "alpha", None, 0)], QUERIES)
    d = spark.createDataFrame([("a", "alpha beta", None, 0), ("b", "gamma", None, 1), ("c", "delta", None, 2)], DOCUMENTS)
    r = spark.createDataFrame([("1", "c", 1.0, 0), ("1", "b", 0.001, 1)], QRELS)
    got = retrieve.retrieve(q, d, r, "bm25", 2, include_relevant=True).orderBy("rank").collect()
    assert [(x.document_id, x.human) for x in got] == [("a", None), ("c", 1.0)]
    with pytest.raises(KeyError):
        retrieve.retrieve(q, d, r, "none")
    with pytest.raises(ValueError):
        retrieve.retrieve(q, d, r, "bm25", most_queries=0)

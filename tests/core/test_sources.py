"""Source shapes, files, the stage pipeline and incremental scoring."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quern.plans.pipeline import Run, window
from quern.plans.views import vectors
from quern.schemas import CANDIDATES, QUERIES
from quern.sources import io, registry, shapes
from quern.streaming.incremental import score_arrivals


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_three_tables(spark):
    q = spark.createDataFrame([("1", "a", 0), ("2", "b", 1)], "_id string, text string, ord bigint")
    c = spark.createDataFrame([("x", "text", "T", 0), ("y", "other", " ", 1)], "_id string, text string, title string, ord bigint")
    r = spark.createDataFrame([("1", "x", 1, 0)], "`query-id` string, `corpus-id` string, score int, ord bigint")
    d = shapes.three_tables(q, c, r, semi_join_queries=True)
    assert rows(d.queries, "id") == [("1",)] and {x.id: x.metadata for x in d.documents.collect()} == {"x": {"title": "T"}, "y": {}}


def test_pairs_and_zips(spark):
    raw = spark.createDataFrame([("q0", "d0", 0), ("q1", "d1", 1)], "a string, b string, ord bigint")
    d = shapes.paired_rows(raw, "a", "b", None, "q_", "d_")
    assert rows(d.qrels, "query_id", "document_id") == [("q_0", "d_0"), ("q_1", "d_1")]
    nested = raw.select("ord", F.struct(F.col("a").alias("text")).alias("question"), F.struct(F.col("b").alias("text")).alias("document"))
    assert rows(shapes.first_pairs(nested, "question.text", "document.text", 1).documents, "content") == [("d0",)]
    assert shapes.sampled_pairs(raw, "a", "b", 1).qrels.count() == 1
    assert rows(shapes.picked_column(raw.withColumnRenamed("b", "c++").withColumn("id", F.col("ord")), "id", "a", "c++").documents, "content") == [("d0",), ("d1",)]
    side = raw.select("ord", F.col("a").alias("_id"), F.col("b").alias("text"))
    with pytest.raises(ValueError):
        shapes.zipped_rows(side, side.limit(1))


def test_arrays(spark):
    raw = spark.createDataFrame([("7", "q", ["a", "b"], [0, 1], 0), ("8", "r", ["c"], [1], 1)], "qid string, query string, texts array<string>, marks array<int>, ord bigint")
    d = shapes.parallel_arrays(raw, "qid", "query", "texts", "marks")
    assert rows(d.qrels, "query_id", "document_id", "score") == [("7", "0", 0.0), ("7", "1", 1.0), ("8", "2", 1.0)]
    assert rows(d.documents, "id", "content") == [("0", "a"), ("1", "b"), ("2", "c")]
    evidence = spark.createDataFrame([("q", '[{"evidence_text": "a"}, {"evidence_text": "b"}]', 0), ("r", '"c \\u00e9"', 1), ("s", "plain", 2)], "question string, evidence string, ord bigint")
    assert rows(shapes.list_or_scalar(evidence, "question", "evidence").documents, "id", "content") == [("0", "a"), ("1", "b"), ("2", "c é"), ("3", "plain")]


def test_agreement(spark):
    d = spark.createDataFrame([("a", "x", None, 0), ("a", "x", None, 1)], "id string, content string, metadata map<string,string>, ord bigint")
    assert shapes.agreeing_documents(d).count() == 1
    with pytest.raises(Exception, match="documents differ"):
        shapes.agreeing_documents(d.withColumn("content", F.concat("content", F.col("ord").cast("string")))).collect()
    q = spark.createDataFrame([("1", "a", 1.0, 0), ("1", "a", 1.0, 1)], "query_id string, document_id string, score double, ord bigint")
    assert shapes.agreeing_qrels(q).count() == 1
    with pytest.raises(Exception, match="two scores"):
        shapes.agreeing_qrels(q.withColumn("score", F.col("ord").cast("double"))).collect()


def test_mails(spark):
    mail = spark.sql("select * from values ('m1', 's', timestamp'2001-02-03 04:05:06', 'f', array('t', 'u'), array('c'), cast(null as array<string>), 'old', 0), ('m1', 's', timestamp'2001-02-03 04:05:06', 'f', array('t', 'u'), array('c'), cast(null as array<string>), 'new', 1) as t(message_id, subject, date, `from`, `to`, cc, bcc, body, ord)")
    questions = spark.createDataFrame([("q", ["m1", "m9"], 0), ("none", ["m8"], 1)], "question string, message_ids array<string>, ord bigint")
    d = shapes.mails(mail, questions)
    assert d.documents.first().content == "Subject: s\nDate: 2001-02-03 04:05:06\nFrom: f\nTo: t, u\nCc: c\nBcc: \n\nnew"
    assert rows(d.queries, "id", "query") == [("0", "q")] and rows(d.qrels, "query_id", "document_id") == [("0", "m1")]


def test_instructions(spark):
    q = spark.sql("select * from values ('7', 'do \"it\"', 'what', array(named_struct('id', 'a', 'score', -1), named_struct('id', 'a', 'score', 3)), 0L), ('7', 'i', 'q', array(named_struct('id', 'b', 'score', -1)), 1L) as t(qid, instruction, query, labels, ord)")
    d = shapes.instructed(q, spark.createDataFrame([("a", "first", 0), ("a", "second", 1)], "id string, doc string, ord bigint"))
    assert rows(d.qrels, "query_id", "document_id", "score") == [("7", "a", 3.0), ("7_1", "b", 0.0)] and rows(d.documents, "content") == [("first",)]
    texts = q.crossJoin(spark.range(40)).select(shapes.format_instruction("id", "instruction", "query").alias("t")).select("t.*").distinct().collect()
    assert {r.name for r in texts} == {n for n, _ in shapes.TEMPLATES}
    assert all(json.loads(r.text)["query"] in ("what", "q") for r in texts if r.name == "json")


def test_splits(spark):
    f = spark.createDataFrame([("c", "b_queries", "queries"), ("c", "a_queries", "queries"), ("c", "a_docs", "documents"), ("c", "b_docs", "documents")], "config string, name string, kind string")
    assert rows(shapes.splits_of(f), "config", "queries", "documents") == [("c", "a", "a"), ("c", "b", "b")]
    with pytest.raises(Exception, match="splits of queries"):
        shapes.splits_of(f.limit(3)).collect()
    assert [shapes.best_split(w, t) for w, t in (("test", ["dev", "test"]), ("en", ["fr-x", "en-x"]), ("arab", ["dev", "ar_test"]), ("x", ["dev"]), ("x", []))] == ["test", "en-x", "ar_test", "dev", None]


def test_maps_one_level_too_deep_or_not(spark):
    df = lambda *data: spark.createDataFrame([("s", i, json.dumps(x)) for i, x in enumerate(data)], "split string, ord bigint, data string")
    q = shapes.maps_by_split(df({"q1": "one", "q2": "two"}, {"q1": "again"}), "queries")
    assert rows(q, "key", "value") == [("q1", "again"), ("q2", "two")]
    c = shapes.maps_by_split(df({"d1": {"title": "t", "text": "x"}, "d2": "plain"}), "corpus")
    assert rows(c, "key", "value") == [("d1", "t\n\nx"), ("d2", "plain")]
    r = shapes.maps_by_split(df({"q1": {"d1": 1, "d2": 0.5}}, {"deep": {"q2": {"d3": 2}}}), "qrels")
    assert rows(r, "key", "inner", "value") == [("q1", "d1", 1.0), ("q1", "d2", 0.5), ("q2", "d3", 2.0)]


def test_odd_maps_of_judgments(spark):
    texts = [
        '{"a": {"x": 1, "y": "2.5"}, "b": {"x": null, "z": 3}}', '{"s": {"c": {"x": {"z": 7, "score": 4}, "y": {"k": "t", "b": 9, "a": 8}}}}', '{"d": "{\\"x\\": 6}"}', '{"e": {"x": null}}', '{"f": {}, "g": null, "h": 3, "i": [1]}',
        '{"j": {"x": {"q": 1}, "y": 2}}', '{"k": {"x": [1, 2], "y": true, "w": 1e2, "v": "word"}}', '{"s": {"l": {"x": 1}}, "m": {"y": 2}}', "no json", '{"n": {"x": 1}', None, "{}", '{"o": {"p": {"x": 13.0, "y": 12345678901234567890123}, "q": {}}}',
    ]
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)] + [("s", 99, '{"a": {"x": 5}}'), ("t", 0, '{"a": {"x": 6}}')], "split string, ord bigint, data string")
    got = shapes.maps_by_split(df, "qrels")
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.split, r.key, r.inner): r.value for r in got.collect()} == {
        ("s", "a", "x"): 5.0, ("t", "a", "x"): 6.0, ("s", "a", "y"): 2.5, ("s", "b", "x"): 1.0, ("s", "b", "z"): 3.0, ("s", "c", "x"): 4.0, ("s", "c", "y"): 9.0, ("s", "d", "x"): 6.0,
        ("s", "j", "x"): 1.0, ("s", "j", "y"): 2.0, ("s", "k", "x"): 1.0, ("s", "k", "y"): 1.0, ("s", "k", "w"): 100.0, ("s", "k", "v"): 1.0, ("s", "l", "x"): 1.0, ("s", "m", "y"): 2.0,
        ("s", "p", "x"): 13.0, ("s", "p", "y"): 12345678901234567890123.0,
    }


def test_zipped_corpora_and_tsv(spark, tmp_path):
    lines = [{"_id": "a", "text": "x", "title": "T"}, {"document_id": "b", "text": "y", "title": "", "metadata": {"k": "v"}}]
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("corpus.jsonl", "\n".join(json.dumps(x) for x in lines[:1]) + "\n \n" + json.dumps(lines[1]))
    d = io.corpus_lines(io.zipped_lines(spark, str(tmp_path / "c.zip")))
    assert {r.id: (r.content, r.metadata) for r in d.collect()} == {"a": ("x", {"title": "T"}), "b": ("y", {"k": "v"})}
    twice = json.dumps({"_id": "a", "text": "x", "title": "T", "metadata": {"title": "U"}})
    with pytest.raises(Exception, match="given twice"):
        io.corpus_lines(spark.createDataFrame([(0, twice)], "line_no bigint, value string")).collect()
    (tmp_path / "q.tsv").write_text("query-id\tcorpus-id\tscore\n1\tdoc-12-0-512\t1\n1\tdoc-12-512-900\t1\n")
    assert rows(io.read_tsv_qrels(spark, str(tmp_path / "q.tsv")), "query_id", "document_id", "score") == [("1", "doc-12", 1.0)]


def test_json_lines_split_folders_and_idempotent_writes(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"id": "1", "query": "a", "metadata": {}, "ord": 0}\n')
    assert io.read_jsonl(spark, str(tmp_path / "q.jsonl"), QUERIES).first().query == "a" and io.count_lines(spark, str(tmp_path / "q.jsonl")) == 1
    (tmp_path / "bad.jsonl").write_text("{broken\n")
    with pytest.raises(Exception):
        io.read_jsonl(spark, str(tmp_path / "bad.jsonl"), QUERIES).collect()
    df = spark.range(5)
    for s in ("train", "test"):
        df.write.parquet(str(tmp_path / "set" / s))
    (tmp_path / "set" / "dataset_dict.json").write_text('{"splits": ["test"]}')
    assert {r.split for r in io.read_splits(spark, str(tmp_path / "set")).collect()} == {"test"}
    path = str(tmp_path / "out")
    assert io.write_if_changed(df, path) and not io.write_if_changed(df.repartition(3), path) and io.write_if_changed(df.limit(4), path)
    assert spark.read.json(path).count() == 4


def test_stage_windows_and_a_whole_run(spark, tmp_path):
    assert window("retrieve", "ndcg") == ["retrieve", "rerank", "ndcg"]
    with pytest.raises(ValueError):
        window("ndcg", "ingest")
    source = shapes.FrameSource("vec", lambda s: vectors(s, "/root/testdata/sf0.001"), clean=False)
    run = Run(spark, str(tmp_path), k=20, max_queries=30)
    macro = {r.ranker: r.macro_mean for r in run.run([source]).collect()}
    assert macro["retrieval"] == pytest.approx(macro["vector"]) and 0 < macro["vector"] < 1
    assert not run.ingest(source)
    assert {r.ranker for r in run.recall("vec").collect()} == {"retrieval", "vector"} and run.ndcg("missing").count() == 0
    assert run.dataset("vec").queries.count() == 30


def test_arrivals_are_scored_once(spark, tmp_path):
    src = str(tmp_path / "in")
    batch = lambda q: spark.createDataFrame([(q, 1, "a", 1.0, 0.0), (q, 2, "b", 0.5, 1.0)], CANDIDATES).coalesce(1).write.mode("append").parquet(src)
    for q in ("x", "y"):
        batch(q)
        score_arrivals(spark, src, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.query_id for r in got) == ["x", "y"]


def test_registry():
    every = registry.datasets("all")
    assert len(every) == 27 and all(hasattr(shapes, shape) for shape, _ in every.values())
    with pytest.raises(KeyError):
        registry.vector_width("none")


def test_combined_splits(spark):
    q = spark.createDataFrame([("1", "a", None, 0), ("1", "b", None, 1)], QUERIES)
    d = spark.createDataFrame([("x", "t", None, 0)], "id string, content string, metadata map<string,string>, ord bigint")
    r = spark.createDataFrame([("1", "x", 1.0, 0), ("1", "x", 2.0, 1), ("1", "gone", 1.0, 2)], "query_id string, document_id string, score double, ord bigint")
    out = shapes.combined_splits(q, d, r, "Do it.")
    assert rows(out.queries, "query") == [("Do it.\n\na",)] and rows(out.qrels, "document_id", "score") == [("x", 1.0)]

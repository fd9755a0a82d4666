import random
import re
import shutil

import pytest

import corpus_pipeline
from quern.llm.common import cut
from quern.llm.simhash import keep_first_of_near_copies


@pytest.fixture(scope="module")
def words():
    rng = random.Random(12)
    return ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(4000)]


def test_stages_in_order_and_their_columns(spark, small):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "packing"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = cut(stage(spark, docs, small))
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    left = docs.collect()
    items = [" ".join(re.findall(r"\w+", r.text.lower())) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert not any(i in " ".join(re.findall(r"\w+", d.text.lower())) for d in left for i in items)
    packed = corpus_pipeline.packing(spark, docs, small).collect()
    assert {r.doc_id for r in packed} == {d.doc_id for d in left}
    assert corpus_pipeline.run(spark, small).count() == len(packed)


def test_near_copies_of_clean_documents(spark, docs_of, words):
    rng = random.Random(3)
    texts = [rng.choices(words, k=rng.choice([60, 300])) for _ in range(40)]
    for i in range(10):
        copy = list(texts[i])
        if i % 2:
            copy[rng.randrange(len(copy))] = "changed"
        texts.append(copy)
    docs = docs_of([" ".join(t) for t in texts])
    left = {r.doc_id for r in keep_first_of_near_copies(docs).collect()}
    assert set(range(40)) <= left and not left & {40, 42, 44, 46, 48}


def test_odd_rows_through_all_stages(spark, docs_of, tmp_path, words, small):
    rng = random.Random(4)
    good = [" ".join(rng.choices(words, k=80)).capitalize() + "." for _ in range(30)]
    rows = [*enumerate(good), (100, None), (101, ""), (102, good[0]), (3, good[3]), (None, " ".join(rng.choices(words, k=80))), (103, "z" * 150_000)]
    docs = docs_of(rows).selectExpr("*", "1 as score", "2 as component_id", "'c' as leaky")
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, good[7])], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    ids = [r.doc_id for r in corpus_pipeline.run(spark, folder).collect()]
    assert set(range(30)) - set(ids) == {7} and 102 not in ids and ids.count(3) == 1 and None in ids and 103 in ids
    shutil.rmtree(f"{folder}/documents.parquet")
    docs.limit(0).write.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_entry_works_without_the_subpackage():
    import subprocess
    import sys

    code = "import sys, importlib.abc\nclass No(importlib.abc.MetaPathFinder):\n    def find_spec(self, name, path=None, target=None):\n        if name.startswith('quern.llm') or name == 'corpus_pipeline':\n            raise ModuleNotFoundError(name=name)\nsys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nq = e.queries()\nassert q and not any(n.startswith('op') or n == 'pipeline' for n in q), sorted(q)\nassert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd="/root/repo")


def test_line_dedup_links_what_it_meets_and_finds_alike(spark, docs_of):
    """lines alike, whose shingles that begin with one of the first letters are mostly others, are linked where they share a band."""
    rng = random.Random(12)
    texts = []
    for _ in range(200):
        body, shared = "".join(rng.choices("abcefghijklmnpqrstuvwxyz", k=500)), "".join(rng.choices("dododo01234567", k=14))
        texts += [f"{body}{shared}" + "".join(rng.choices("dododo01234567", k=46)) for _ in range(2)]
    kept = {r.doc_id for r in corpus_pipeline.line_dedup(spark, docs_of(texts), "").collect()}
    assert kept >= set(range(0, 400, 2)) and len(kept) < 400

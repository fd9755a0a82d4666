"""First-stage retrieval: exact dense search, BM25, their fusion, forced inclusion, labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import truncate, words
from quern.operators.ranking import top_k
from quern.schemas import dense_ordinal

K = 100
MAX_QUERIES = 10_000
BLOCK_VALUES = 8_000_000
LEAST_LABEL = 0.01


def dot(a: str | Column, b: str | Column) -> Column:
    """Dot product of two arrays in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense_topk(queries: DataFrame, documents: DataFrame, k: int = K, block_values: int = BLOCK_VALUES) -> DataFrame:
    """(query_id, rank, document_id, score): the k documents of largest dot product, equal ones by `ord`.

    Query vectors go to the tasks in blocks of at most `block_values` values, one pass over the documents for each, and a
    task keeps its own best k, so neither all scores nor all queries are ever held in one place.
    """
    sized = queries.select(F.col("id").cast("string").alias("id"), "vector").filter("vector is not null")
    total, width = sized.agg(F.count("id"), F.max(F.size("vector"))).first()
    blocks = max(1, -(-total * (width or 1) // block_values))
    found = None
    for b in range(blocks):
        own = sized if blocks == 1 else sized.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        rows = own.orderBy("id").collect()
        if rows:
            part = _block_topk(rows, documents, k)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return documents.sparkSession.createDataFrame([], "query_id string, rank int, document_id string, score double")
    return top_k(found, "query_id", k, F.desc("score"), F.col("ord").asc()).select("query_id", "rank", "document_id", "score")


#: Scores that a task of dense search has before it at once, and rows of a batch that it gives.
SCORES, GIVEN = 1_000_000, 50_000


def best_of(ids: np.ndarray, q: np.ndarray, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function from (document_id, ord, vector) rows to (query_id, document_id, ord, score) of the best k for each row of `q`.

    Besides the vectors and those k, it holds no more than some `SCORES` scores and a batch. It is a closure, so that
    workers need no module of this package.
    """
    step = max(1, SCORES // len(q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_score, best_ord, best_id = np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0), object)
        for batch in batches:
            for s in range(0, batch.num_rows, step):
                part = batch.slice(s, step)
                own_id, own_ord = np.array(part.column(0).to_pylist(), object), part.column(1).to_numpy()
                score = q @ np.asarray(part.column(2).flatten(), np.float64).reshape(part.num_rows, -1).T
                # only what is not behind the last of a full list is merged
                full = best_score.shape[1] == k
                at, new = np.nonzero(~(score < best_score[:, -1:])) if full and k else (np.repeat(np.arange(len(q)), len(own_id)), np.tile(np.arange(len(own_id)), len(q)))
                if not len(at):
                    continue
                whose = np.unique(at)
                m = best_score.shape[1]
                query = np.concatenate([np.repeat(whose, m), at])
                merged = [np.concatenate([best[whose].ravel(), own]) for best, own in ((best_score, score[at, new]), (best_ord, own_ord[new]), (best_id, own_id[new]))]
                order = np.lexsort((merged[1], -merged[0], query))
                _, first, n = np.unique(query[order], return_index=True, return_counts=True)
                left = min(k, n.min())
                kept = order[first[:, None] + np.arange(left)]
                if full:
                    best_score[whose], best_ord[whose], best_id[whose] = (x[kept] for x in merged)
                else:
                    best_score, best_ord, best_id = (x[kept] for x in merged)
        n = best_score.shape[1]
        for s in range(0, len(q), max(1, GIVEN // max(n, 1))):
            e = s + max(1, GIVEN // max(n, 1))
            cols = [pa.array(np.repeat(ids[s:e], n), pa.string()), pa.array(best_id[s:e].ravel(), pa.string()), pa.array(best_ord[s:e].ravel()), pa.array(best_score[s:e].ravel())]
            yield pa.RecordBatch.from_arrays(cols, names=["query_id", "document_id", "ord", "score"])

    return run


def _block_topk(rows: list, documents: DataFrame, k: int) -> DataFrame:
    ids = np.array([r.id for r in rows], object)
    q = np.array([r.vector for r in rows], np.float64)
    own = documents.filter("vector is not null").select(F.col("id").cast("string").alias("document_id"), F.col("ord").cast("bigint").alias("ord"), F.col("vector").cast("array<double>"))
    return own.mapInArrow(best_of(ids, q, k), "query_id string, document_id string, ord bigint, score double")


#: Distinct query words up to which they are broadcast.
BROADCAST_TERMS = 100_000


def bm25_terms(documents: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(ord, term, length, tf): occurrences of each term in each document by `ord`, and the document's words. With `wanted` (term)
    only of its terms. All terms of a document are in one partition."""
    tokens = documents.select("ord", words("content").alias("w"))
    each = tokens.select("ord", F.size("w").alias("length"), F.explode("w").alias("term"))
    if wanted is not None:
        each = each.join(wanted, "term", "left_semi")
    return each.repartition("ord").groupBy("ord", "term").agg(F.max("length").alias("length"), F.count(F.lit(1)).alias("tf"))


def bm25_vocabulary(documents: DataFrame) -> DataFrame:
    """(term, df, n): documents that hold a term, and its occurrences, added up where the texts are read."""
    tokens = documents.select(words("content").alias("w"))
    each = tokens.select(F.size("w").alias("s"), F.posexplode(F.concat("w", F.array_distinct("w"))).alias("i", "term"))
    return each.groupBy("term").agg(F.count(F.when(F.col("i") >= F.col("s"), 1)).alias("df"), F.count(F.when(F.col("i") < F.col("s"), 1)).alias("n"))


def bm25_idf(documents: DataFrame, n: int, asked: DataFrame, few: bool, epsilon: float = 0.25) -> DataFrame:
    """(term, idf) of the terms `asked` (term): negative ones are a share of the mean over the whole vocabulary. If they are `few`,
    one pass over the texts gives both."""
    vocabulary = documents.select(F.explode(F.array_distinct(words("content"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = vocabulary.withColumn("raw", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    if not few:
        mean = raw.agg(F.avg("raw").alias("mean"))
        return raw.join(asked, "term", "left_semi").crossJoin(F.broadcast(mean)).select("term", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    marked = raw.join(F.broadcast(asked.withColumn("asked", F.lit(True))), "term", "left")
    mean, found = marked.agg(F.avg("raw"), F.collect_list(F.when(F.col("asked"), F.struct("term", "raw")))).first()
    idf = pa.table({"term": pa.array([r.term for r in found], pa.string()), "idf": pa.array([epsilon * mean if r.raw < 0 else r.raw for r in found], pa.float64())})
    return F.broadcast(documents.sparkSession.createDataFrame(idf))


def bm25_topk(queries: DataFrame, documents: DataFrame, k: int = K, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, most: int = 8192) -> DataFrame:
    """(query_id, rank, document_id, score) by BM25 over lower-cased words of at most `most` tokens of each text.

    Every document has a score, 0 where it shares no word, so each query has min(k, documents) rows; equal scores are
    ordered by `ord`. Words that no query asks for leave where the texts are read. If the queries' words are at most
    `BROADCAST_TERMS`, queries go to where a document's words are, and of its scores only the best k of a task move. The best
    k of each query are persisted until the session's cache is cleared.
    """
    docs = documents.select("id", F.col("ord").cast("bigint").alias("ord"), truncate("content", most).alias("content"))
    n, mean_length = docs.select(F.size(words("content")).alias("n")).agg(F.count(F.lit(1)), F.avg("n")).first()
    empty = documents.sparkSession.createDataFrame([], "query_id string, rank int, document_id string, score double")
    if not n:
        return empty
    q = queries.select(F.col("id").alias("query_id"), F.explode(words(truncate("query", most))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    few = q.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    small = F.broadcast if few else (lambda df: df)
    idf = bm25_idf(docs, n, q.select("term").distinct(), few, epsilon)
    weigh = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(float(mean_length or 1.0))))

    def scores(q: DataFrame) -> DataFrame:
        tf = bm25_terms(docs, small(q.select("term").distinct()))
        postings = tf.join(idf, "term").select("term", "ord", (F.col("idf") * weigh).alias("weight"))
        return postings.join(small(q), "term").groupBy("query_id", "ord").agg(F.sum(F.col("times") * F.col("weight")).alias("score"))

    def finished(best: DataFrame) -> DataFrame:
        return best.join(docs.select("ord", F.col("id").alias("document_id")), "ord").select("query_id", "rank", "document_id", "score")

    # A sum's last digits depend on the order of its parts: equal scores are those equal to nine places.
    order = (F.round("score", 9).desc(), F.col("ord").asc())
    best = top_k(scores(q), "query_id", k, *order).persist()  # k rows a query
    whole = best.filter("score > 0").groupBy("query_id").count().filter(F.col("count") >= k).select("query_id")
    short = queries.select(F.col("id").alias("query_id")).join(whole, "query_id", "left_anti")
    if short.isEmpty():
        return finished(best)
    # Too few documents share a word with these: the others have score 0. The first k of them lie among the first
    # k + (shared) places.
    scored = scores(q.join(short, "query_id", "left_semi"))
    shared = short.join(scored.groupBy("query_id").agg(F.count(F.lit(1)).alias("m")), "query_id", "left")
    places = shared.select("query_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.coalesce("m", F.lit(0)) + k, F.lit(n)) - 1)).alias("place"))
    placed = dense_ordinal(docs.select("ord"), "ord", name="place")
    zeros = places.join(placed, "place").select("query_id", "ord").join(scored, ["query_id", "ord"], "left_anti").withColumn("score", F.lit(0.0))
    rest = top_k(scored.unionByName(zeros), "query_id", k, *order)
    return finished(best.join(short, "query_id", "left_anti").unionByName(rest))


def fuse(dense: DataFrame, lexical: DataFrame, k: int = K) -> DataFrame:
    """Reciprocal-rank fusion without a constant: 1/rank of either arm, added; equal sums by dense, then lexical rank."""
    a = dense.select("query_id", "document_id", F.col("rank").alias("r_dense"))
    b = lexical.select("query_id", "document_id", F.col("rank").alias("r_lexical"))
    both = a.join(b, ["query_id", "document_id"], "full_outer")
    score = F.coalesce(1 / F.col("r_dense"), F.lit(0.0)) + F.coalesce(1 / F.col("r_lexical"), F.lit(0.0))
    return top_k(both.withColumn("score", score), "query_id", k, F.desc("score"), F.asc_nulls_last("r_dense"), F.asc("r_lexical")).select("query_id", "rank", "document_id", "score")


def hybrid_topk(queries: DataFrame, documents: DataFrame, k: int = K) -> DataFrame:
    """Dense and BM25 arms of 3k each, fused. Needs `vector` on both sides besides the texts."""
    return fuse(dense_topk(queries, documents, 3 * k), bm25_topk(queries, documents, 3 * k), k)


def usable_labels(qrels: DataFrame, least: float = LEAST_LABEL) -> DataFrame:
    return qrels.filter(F.col("score") >= least)


def force_include(results: DataFrame, qrels: DataFrame, k: int = K, least: float = LEAST_LABEL) -> DataFrame:
    """Results with every relevant document of the query among its k.

    With more than k relevant ones, the first k of them; else they follow the best of the others. A document that was
    not retrieved scores 0. Order is by score; of equal ones the others come first.
    """
    relevant = usable_labels(qrels, least).select("query_id", "document_id", "ord")
    counts = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rel"))
    chosen = top_k(relevant, "query_id", k, F.col("ord").asc(), name="_r").drop("_r")
    others = results.join(relevant.select("query_id", "document_id"), ["query_id", "document_id"], "left_anti").join(counts, "query_id", "left")
    others = top_k(others, "query_id", None, F.col("rank").asc(), name="_n").filter(F.col("_n") <= F.lit(k) - F.coalesce("n_rel", F.lit(0)))
    forced = chosen.join(results.select("query_id", "document_id", "score"), ["query_id", "document_id"], "left")
    merged = others.select("query_id", "document_id", "score", F.lit(0).alias("_rel"), F.col("rank").cast("bigint").alias("_at")).unionByName(
        forced.select("query_id", "document_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.lit(1).alias("_rel"), F.col("ord").cast("bigint").alias("_at"))
    )
    return top_k(merged, "query_id", None, F.desc("score"), F.col("_rel").asc(), F.col("_at").asc()).select("query_id", "rank", "document_id", "score")


def attach_labels(results: DataFrame, qrels: DataFrame, least: float = LEAST_LABEL) -> DataFrame:
    """Results with `human`, null where there is no label of at least `least`."""
    labels = usable_labels(qrels, least).select("query_id", "document_id", F.col("score").alias("human"))
    return results.join(labels, ["query_id", "document_id"], "left")


METHODS: dict[str, Callable[..., DataFrame]] = {"dense": dense_topk, "bm25": bm25_topk, "hybrid": hybrid_topk}


def register_method(name: str, method: Callable[..., DataFrame]) -> None:
    """Adds a retrieval method: (queries, documents, k) -> (query_id, rank, document_id, score)."""
    METHODS[name] = method


def retrieve(queries: DataFrame, documents: DataFrame, qrels: DataFrame, method: str = "dense", k: int = K, include_relevant: bool = False, most_queries: int | None = MAX_QUERIES) -> DataFrame:
    """Candidates of every query by a registered method, with labels."""
    if method not in METHODS:
        raise KeyError(f"no retrieval method {method}; there are {sorted(METHODS)}")
    if most_queries is not None and queries.limit(most_queries + 1).count() > most_queries:
        raise ValueError(f"more than {most_queries} queries")
    found = METHODS[method](queries, documents, k)
    return attach_labels(force_include(found, qrels, k) if include_relevant else found, qrels)

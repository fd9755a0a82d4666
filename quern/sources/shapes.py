"""Raw tables of many shapes as datasets: each source turns its raw frames into queries, documents and judgments."""

from __future__ import annotations

import re
from abc import ABC, abstractmethod
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.scalar import document_content, query_content, score_value
from quern.functions.text import is_blank, mail_text, with_instruction
from quern.operators.clean import clean_dataset, judged, sample_rows
from quern.operators.ranking import first_by, last_by, numbered_duplicates, running_number
from quern.schemas import Dataset

NO_METADATA = "map<string,string>"
TEMPLATES = (
    ("plain", "{i}\n{q}"), ("labelled", "Instruction: {i}\nQuery: {q}"), ("query_first", "{q}\n{i}"), ("tagged", "<instruction>{i}</instruction>\n<query>{q}</query>"),
    ("markdown", "# Instruction\n{i}\n\n# Query\n{q}"), ("json", '{"instruction": {i}, "query": {q}}'), ("brackets", "[{i}] {q}"),
)


class Source(ABC):
    """Something that gives a dataset. Subclasses name it and load it."""

    clean = True

    @abstractmethod
    def dataset_id(self) -> str: ...

    @abstractmethod
    def ingest(self, spark: SparkSession) -> Dataset: ...

    def load(self, spark: SparkSession) -> Dataset:
        data = self.ingest(spark)
        return clean_dataset(data) if self.clean else data


class FrameSource(Source):
    """A source from a function of the session."""

    def __init__(self, name: str, make, clean: bool = True):
        self.name, self.make, self.clean = name, make, clean

    def dataset_id(self) -> str:
        return self.name

    def ingest(self, spark: SparkSession) -> Dataset:
        return self.make(spark)


def query_rows(df: DataFrame, ident: Column, text: Column, order: Column) -> DataFrame:
    return df.select(ident.cast("string").alias("id"), text.cast("string").alias("query"), F.create_map().cast(NO_METADATA).alias("metadata"), order.cast("bigint").alias("ord"))


def document_rows(df: DataFrame, ident: Column, text: Column, order: Column, metadata: Column | None = None) -> DataFrame:
    return df.select(ident.cast("string").alias("id"), text.cast("string").alias("content"), (F.create_map() if metadata is None else metadata).cast(NO_METADATA).alias("metadata"), order.cast("bigint").alias("ord"))


def qrel_rows(df: DataFrame, query: Column, document: Column, score: Column, order: Column) -> DataFrame:
    return df.select(query.cast("string").alias("query_id"), document.cast("string").alias("document_id"), score.cast("double").alias("score"), order.cast("bigint").alias("ord"))


def union_splits(*parts: DataFrame) -> DataFrame:
    """All rows of the splits, with `split_no` and `ord` in the order of the splits; each part has its own `ord`."""
    return reduce(DataFrame.unionByName, [p.withColumn("split_no", F.lit(i)).withColumn("ord", F.lit(i).cast("bigint") * (1 << 40) + F.col("ord")) for i, p in enumerate(parts)])


def paired_rows(df: DataFrame, query: str, document: str, ident: str | None = None, query_prefix: str = "", document_prefix: str = "") -> Dataset:
    """Each row's text is the answer to its query: ids from a column or the row's place."""
    key = F.col(ident or "ord").cast("string")
    q, d = F.concat(F.lit(query_prefix), key), F.concat(F.lit(document_prefix), key)
    return Dataset(query_rows(df, q, F.col(query), F.col("ord")), document_rows(df, d, F.col(document), F.col("ord")), qrel_rows(df, q, d, F.lit(1.0), F.col("ord")))


def sampled_pairs(df: DataFrame, query: str, document: str, n: int = 10_000, seed: int = 0) -> Dataset:
    return paired_rows(sample_rows(df, n, "ord", seed), query, document)


def first_pairs(df: DataFrame, query: str, document: str, n: int = 1000) -> Dataset:
    """The first n rows as pairs; columns may be struct fields."""
    return paired_rows(df.filter(F.col("ord") < n).select("ord", F.col(query).alias("_q"), F.col(document).alias("_d")), "_q", "_d")


def zipped_rows(queries: DataFrame, documents: DataFrame, query_id: str = "_id", document_id: str = "_id", text: str = "text") -> Dataset:
    """The i-th query is answered by the i-th document; both sides are equally long, else an error."""
    a, b = (df.agg(F.count(F.lit(1))).first()[0] for df in (queries, documents))
    if a != b:
        raise ValueError(f"{a} queries and {b} documents")
    pairs = queries.select("ord", F.col(query_id).alias("_q")).join(documents.select("ord", F.col(document_id).alias("_d")), "ord")
    return Dataset(query_rows(queries, F.col(query_id), F.col(text), F.col("ord")), document_rows(documents, F.col(document_id), F.col(text), F.col("ord")), qrel_rows(pairs, F.col("_q"), F.col("_d"), F.lit(1.0), F.col("ord")))


def three_tables(queries: DataFrame, corpus: DataFrame, qrels: DataFrame, semi_join_queries: bool = False) -> Dataset:
    """Queries and corpus (_id, text, perhaps title) and judgments (query-id, corpus-id, score)."""
    title = F.create_map(F.lit("title"), F.col("title")) if "title" in corpus.columns else None
    if title is not None:
        title = F.when(is_blank("title"), F.create_map().cast(NO_METADATA)).otherwise(title)
    out = Dataset(
        query_rows(queries, F.col("_id"), F.col("text"), F.col("ord")),
        document_rows(corpus, F.col("_id"), F.col("text"), F.col("ord"), title),
        qrel_rows(qrels, F.col("`query-id`"), F.col("`corpus-id`"), F.col("score"), F.col("ord")),
    )
    if semi_join_queries:
        out = out.with_(queries=out.queries.join(out.qrels.select(F.col("query_id").alias("id")), "id", "left_semi"))
    return out


def agreeing_documents(documents: DataFrame) -> DataFrame:
    """One row for each id; an error where rows of one id differ in content."""
    one = documents.groupBy("id").agg(F.min_by(F.struct("content", "metadata"), "ord").alias("_r"), F.min("ord").alias("ord"), F.min(F.sha2("content", 256)).alias("_a"), F.max(F.sha2("content", 256)).alias("_b"))
    fine = F.assert_true(F.col("_a").eqNullSafe(F.col("_b")), F.concat(F.lit("documents differ under the id "), F.col("id")))
    return one.filter(fine.isNull()).select("id", "_r.content", "_r.metadata", "ord")


def agreeing_qrels(qrels: DataFrame) -> DataFrame:
    """One row for each pair; an error where its scores differ."""
    one = qrels.groupBy("query_id", "document_id").agg(F.min("score").alias("score"), F.max("score").alias("_most"), F.min("ord").alias("ord"))
    return one.filter(F.assert_true(F.col("score") == F.col("_most"), F.lit("a pair has two scores")).isNull()).drop("_most")


def parallel_arrays(df: DataFrame, query_id: str, query: str, texts: str, marks: str) -> Dataset:
    """Each row holds passages and as many marks; documents are numbered through all rows."""
    rows = running_number(df.withColumn("_pairs", F.arrays_zip(F.col(texts).alias("t"), F.col(marks).alias("m"))), "_pairs")
    return Dataset(
        query_rows(df, F.col(query_id), F.col(query), F.col("ord")),
        document_rows(rows, F.col("number"), F.col("element.t"), F.col("number")),
        qrel_rows(rows, F.col(query_id), F.col("number"), F.col("element.m"), F.col("number")),
    )


def array_rows(df: DataFrame, query: str, texts: str) -> Dataset:
    """Each row's query is answered by all strings of its array; documents are numbered through all rows."""
    rows = running_number(df, texts)
    return Dataset(query_rows(df, F.col("ord"), F.col(query), F.col("ord")), document_rows(rows, F.col("number"), F.col("element"), F.col("number")), qrel_rows(rows, F.col("ord"), F.col("number"), F.lit(1.0), F.col("number")))


def list_or_scalar(df: DataFrame, query: str, evidence: str, field: str = "evidence_text") -> Dataset:
    """Evidence is JSON: a list of objects with a text, or one string."""
    many = F.transform(F.from_json(evidence, f"array<struct<{field}:string>>"), lambda e: e[field])
    single = F.array(F.when(F.col(evidence).rlike(r'^\s*"'), F.get_json_object(F.concat(F.lit('{"v":'), F.col(evidence), F.lit("}")), "$.v")).otherwise(F.col(evidence)))
    return array_rows(df.withColumn("_texts", F.when(F.col(evidence).rlike(r"^\s*\["), many).otherwise(single)), query, "_texts")


def picked_column(df: DataFrame, ident: str, query: str, column: str) -> Dataset:
    """The document is in the column that a parameter names."""
    return paired_rows(df.select("ord", ident, F.col(query).alias("_q"), F.col(f"`{column}`").alias("_d")), "_q", "_d", ident)


def mails(mail: DataFrame, questions: DataFrame) -> Dataset:
    """Mails, the last of each message_id, and questions that name messages; questions without a known message go."""
    text = mail_text(F.col("subject"), F.col("date"), F.col("from"), F.col("to"), F.col("cc"), F.col("bcc"), F.col("body"))
    docs = document_rows(last_by(mail, "message_id").withColumn("_t", text), F.col("message_id"), F.col("_t"), F.col("ord"))
    named = questions.select(F.col("ord").alias("_q"), F.posexplode("message_ids").alias("_pos", "message_id"))
    pairs = named.join(docs.select(F.col("id").alias("message_id")), "message_id")
    queries = query_rows(questions.join(pairs.select(F.col("_q").alias("ord")), "ord", "left_semi"), F.col("ord"), F.col("question"), F.col("ord"))
    return Dataset(queries, docs, qrel_rows(pairs, F.col("_q"), F.col("message_id"), F.lit(1.0), F.col("_q") * 100_000 + F.col("_pos")))


def instructed(queries: DataFrame, documents: DataFrame) -> Dataset:
    """Queries (qid, instruction, query, labels of id and score) and documents (id, doc).

    A repeated qid gets its place appended, of a repeated document the first stays, a pair's score is its largest and at
    least 0.
    """
    unique = numbered_duplicates(queries, "qid")
    text = format_instruction("qid", "instruction", "query")["text"]
    docs = first_by(documents.select(F.col("id").cast("string").alias("id"), "doc", "ord"), "id")
    labels = unique.select("qid", "ord", F.explode("labels").alias("l"))
    pairs = labels.groupBy("qid", F.col("l.id").alias("document_id")).agg(F.greatest(F.lit(0), F.max(F.col("l.score").cast("int"))).alias("score"), F.min("ord").alias("ord"))
    return Dataset(query_rows(unique, F.col("qid"), text, F.col("ord")), document_rows(docs, F.col("id"), F.col("doc"), F.col("ord")), qrel_rows(pairs, F.col("qid"), F.col("document_id"), F.col("score"), F.col("ord")))


def format_instruction(qid: str, instruction: str, query: str) -> Column:
    """(name, text): one of seven templates, chosen by the hash of the query's id."""
    def fill(name: str, template: str) -> Column:
        def value(c: str) -> Column:
            if name != "json":
                return F.coalesce(F.col(c), F.lit(""))
            whole = F.to_json(F.struct(F.coalesce(F.col(c), F.lit("")).alias("v")))  # {"v":"..."}
            return whole.substr(F.lit(6), F.length(whole) - 6)

        return F.concat(*[value({"{i}": instruction, "{q}": query}[p]) if p in ("{i}", "{q}") else F.lit(p) for p in re.split(r"(\{[iq]\})", template) if p])

    choices = F.array(*[F.struct(F.lit(name).alias("name"), fill(name, t).alias("text")) for name, t in TEMPLATES])
    return F.element_at(choices, (F.pmod(F.xxhash64(F.col(qid).cast("string")), F.lit(len(TEMPLATES))) + 1).cast("int"))


def splits_of(files: DataFrame) -> DataFrame:
    """(config, queries, documents): split names of (config, name, kind), the same on both sides, sorted and paired."""
    named = files.groupBy("config").agg(F.array_sort(F.collect_set(F.when(F.col("kind") == "queries", F.regexp_replace("name", "_?queries$", "")))).alias("q"), F.array_sort(F.collect_set(F.when(F.col("kind") == "documents", F.regexp_replace("name", "_?docs$", "")))).alias("d"))
    fine = F.assert_true(F.col("q") == F.col("d"), F.lit("splits of queries and documents differ"))
    return named.filter(fine.isNull()).select("config", F.explode(F.arrays_zip("q", "d")).alias("s")).select("config", F.col("s.q").alias("queries"), F.col("s.d").alias("documents"))


def maps_by_split(rows: DataFrame, kind: str) -> DataFrame:
    """Rows (split, ord, data JSON) of one map each, one level too deep or not, as (split, key, value): the last of a key.

    `kind` is "queries", "corpus" (value a text) or "qrels" (key query, `inner` document, value a score).
    """
    if kind == "qrels":
        return _judged_maps(rows)
    outer = rows.select("split", "ord", F.explode(F.from_json("data", "map<string,string>")).alias("k", "v"))
    deeper = F.from_json("v", "map<string,string>")
    nested = F.col("v").rlike(r"^\s*\{") & F.forall(F.map_values(deeper), lambda x: x.rlike(r"^\s*\{"))
    objects = nested & ~F.col("v").rlike(r'"text"\s*:\s*"')
    flat = outer.filter(~F.coalesce(objects, F.lit(False))).select("split", "ord", F.col("k").alias("key"), F.col("v").alias("value"))
    deep = outer.filter(objects).select("split", "ord", F.explode(deeper).alias("key", "value"))
    out = flat.unionByName(deep).groupBy("split", "key").agg(F.max_by("value", "ord").alias("value"), F.min("ord").alias("ord"))
    quoted = F.when(F.col("value").rlike(r"^\s*[\[{]"), F.col("value")).otherwise(F.to_json(F.struct(F.col("value").alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("value").alias("v")))) - 6))
    return out.withColumn("value", (query_content if kind == "queries" else document_content)(quoted))


def _judged_maps(rows: DataFrame) -> DataFrame:
    """(split, key, inner, value, ord) of judgments in maps, the last score of a pair.

    Every JSON text is parsed once, by one expression over the row: a parse that two branches or a filter ask for is done
    again for each. A text whose values are neither objects nor null is read as a VARIANT, which takes a quarter of the time of
    maps of texts; all others, and those that a VARIANT cannot hold, are read as maps of texts level by level. Scores are
    numbers before they are aggregated, since the last of texts is found by sorting them.
    """
    empty = F.array().cast("array<struct<key:string,inner:string,value:string>>")
    one = lambda value, then: F.get(F.transform(F.array(value), then), 0)  # noqa: E731  evaluates `value` once
    entries = lambda json: F.map_entries(F.from_json(json, "map<string,string>"))
    triples = lambda key, found: F.transform(found, lambda e: F.struct(key.alias("key"), e["key"].alias("inner"), e["value"].alias("value")))
    is_object = lambda json: json.rlike(r"^\s*\{")

    def of_entry(e: Column) -> Column:
        def parsed(found: Column) -> Column:
            deep = F.flatten(F.transform(found, lambda x: F.coalesce(triples(x["key"], entries(x["value"])), empty)))
            nested = is_object(e["value"]) & F.forall(found, lambda x: is_object(x["value"]))
            return F.coalesce(F.when(nested, deep).when(~nested, triples(e["key"], found)), empty)

        return one(entries(e["value"]), parsed)

    plain = lambda m: m.isNotNull() & F.forall(F.map_values(m), lambda x: x.isNotNull() & ~x.rlike(r"^\s*[\[{]"))
    pairs = lambda m: F.flatten(F.transform(F.map_entries(m), lambda e: triples(e["key"], F.map_entries(e["value"]))))
    all_plain = lambda m: F.coalesce(F.forall(F.map_values(m), plain), F.lit(False))
    as_maps = lambda v, kind: F.try_variant_get(v, "$", kind)

    def by_variant(v: Column) -> Column:
        def too_deep(m: Column) -> Column:
            fine = F.coalesce(F.forall(F.map_values(m), lambda x: x.isNotNull() & all_plain(x)), F.lit(False))
            return F.when(fine, F.flatten(F.transform(F.map_values(m), pairs))).otherwise(F.flatten(F.transform(entries(F.col("data")), of_entry)))

        return one(as_maps(v, "map<string,map<string,string>>"), lambda m: F.when(all_plain(m), pairs(m)).otherwise(one(as_maps(v, "map<string,map<string,map<string,string>>>"), too_deep)))

    all_ = rows.select("split", "ord", F.explode(one(F.try_parse_json("data"), by_variant)).alias("t"))
    scored = all_.select("split", "ord", "t.key", "t.inner", score_value("t.value").alias("value"))
    return scored.groupBy("split", "key", "inner").agg(F.coalesce(F.max_by("value", "ord"), F.lit(1.0)).alias("value"), F.min("ord").alias("ord"))


def best_split(wanted: str, there: list[str]) -> str | None:
    """The split itself; a language variant that holds it or is held by it; an Arabic one for `ar`; the first."""
    if wanted in there or not there:
        return wanted if wanted in there else None
    if "-" in there[0]:
        for name in there:
            if wanted in name or name in wanted:
                return name
    if wanted.startswith("ar"):
        for name in there:
            if name.startswith(("ar", "arb")):
                return name
    return there[0]


def combined_splits(queries: DataFrame, documents: DataFrame, qrels: DataFrame, instruction: str | None = None) -> Dataset:
    """All splits of three long tables as one dataset: the first row of an id or pair stays, dangling judgments go."""
    docs = first_by(documents, "id")
    own = first_by(queries, "id")
    if instruction:
        own = own.withColumn("query", with_instruction(F.lit(instruction), F.col("query")))
    return Dataset(own, docs, first_by(judged(qrels, own, docs), "query_id", "document_id"))

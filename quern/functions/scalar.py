"""Hashes, arithmetic, maps and semi-structured values as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import col

BAR = "||||"


def text_hash(c: str | Column) -> Column:
    """The first 32 hex digits of SHA-256."""
    return F.substring(F.sha2(col(c), 256), 1, 32)


def hash_bucket(c: str | Column, buckets: int) -> Column:
    """A bucket from 0 by the leading hex digits of the hash."""
    return F.pmod(F.conv(F.substring(F.sha2(col(c), 256), 1, 15), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")


def vector_key(company: str, model: str, kind: str, text: str | Column) -> Column:
    """Cache key of a vector: who made it, for what use, of which text."""
    return F.concat_ws(BAR, F.lit(company), F.lit(model), F.lit(kind.upper()), F.md5(col(text)))


def rerank_key(model: str, query: str | Column, text: str | Column) -> Column:
    """Cache key of a score: a chain of digests over model, query and text."""
    first = F.md5(F.lit(model))
    second = F.md5(F.concat_ws(BAR, first, F.md5(col(query))))
    return F.md5(F.concat_ws(BAR, second, F.md5(col(text))))


def sigmoid(c: str | Column, scale: float = 1.0) -> Column:
    return 1 / (1 + F.exp(-col(c) / scale))


def clamp(c: str | Column, low: float, high: float) -> Column:
    """`c` held within [low, high]; NaN and null stay."""
    if low > high:
        raise ValueError("low is above high")
    c = col(c)
    return F.when(F.isnan(c.cast("double")), c).otherwise(F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def mean_or_nan(c: str | Column) -> Column:
    """Average, NaN over no rows."""
    return F.coalesce(F.avg(col(c)), F.lit(float("nan")))


def stderr_or_nan(c: str | Column) -> Column:
    """Standard error of the mean; NaN over fewer than two rows."""
    return F.coalesce(F.stddev_samp(col(c)) / F.sqrt(F.count(col(c))), F.lit(float("nan")))


def map_or(c: str | Column, key: str, default: float) -> Column:
    """Value of a map, or `default`."""
    return F.coalesce(F.try_element_at(col(c), F.lit(key)), F.lit(default))


def map_strict(c: str | Column, key: str) -> Column:
    """Value of a map; an error where it is missing."""
    return not_null(F.try_element_at(col(c), F.lit(key)), f"no {key} among the scores")


def scores_map(method: str, score: str | Column, human: str | Column) -> Column:
    """{method: score, human: label}, the label only where there is one."""
    pairs = F.array(F.struct(F.lit(method).alias("k"), col(score).cast("double").alias("v")), F.struct(F.lit("human").alias("k"), col(human).cast("double").alias("v")))
    return F.map_from_entries(F.filter(pairs, lambda e: e["v"].isNotNull()))


def map_with(c: str | Column, key: str, value: str | Column) -> Column:
    """A map with one key set, whether or not it was there."""
    base = F.coalesce(col(c), F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(base, lambda k, _: k != key), F.create_map(F.lit(key), col(value)))


def not_null(c: str | Column, message: str = "value is null") -> Column:
    return F.coalesce(col(c), F.raise_error(F.lit(message)))


def argsort(values: str | Column) -> Column:
    """Places of the values in rising order, equal ones in their own order; places count from 0."""
    marked = F.transform(col(values), lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    return F.transform(F.sort_array(marked), lambda s: s["i"])


def sorted_by_keys(values: str | Column, keys: str | Column, reverse: bool = False) -> Column:
    """The values in the order of their keys, equal ones in their own order."""
    zipped = F.zip_with(col(values), F.transform(col(keys), lambda k, i: F.struct(k.alias("k"), i.alias("i"))), lambda v, s: F.struct(s["k"].alias("k"), (-s["i"] if reverse else s["i"]).alias("i"), v.alias("v")))
    return F.transform(F.sort_array(zipped, not reverse), lambda s: s["v"])


def unzip(c: str | Column, *fields: str) -> list[Column]:
    return [F.transform(col(c), lambda s, f=f: s[f]) for f in fields]


def score_value(json: str | Column) -> Column:
    """A relevance score from a JSON value: a number or a numeric string as it is; of an object `score`, else `relevance`,
    else its first value that reads as a number; 1.0 for all else."""
    j = col(json)
    plain = F.regexp_replace(j, '^"|"$', "").try_cast("double")
    held = F.from_json(j, "map<string,string>")
    first = F.get(F.filter(F.transform(F.map_values(held), lambda v: v.try_cast("double")), lambda v: v.isNotNull()), 0)
    of_object = F.coalesce(F.try_element_at(held, F.lit("score")).try_cast("double"), F.try_element_at(held, F.lit("relevance")).try_cast("double"), first)
    return F.coalesce(F.when(j.rlike(r"^\s*\{"), of_object).otherwise(plain), F.lit(1.0))


def document_content(json: str | Column) -> Column:
    """Text of a document given as a JSON string, or as an object with `text` and perhaps `title`; else the JSON itself."""
    v = F.try_parse_json(col(json))
    kind = F.schema_of_variant(v)
    text, title = F.try_variant_get(v, "$.text", "string"), F.try_variant_get(v, "$.title", "string")
    whole = F.when(F.length(title) > 0, F.concat(title, F.lit("\n\n"), text)).otherwise(text)
    return F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(text.isNotNull(), whole).otherwise(col(json))


def query_content(json: str | Column) -> Column:
    """Text of a query given as JSON: a string; the value of a one-key object; `query`; the first string; the JSON itself."""
    j = col(json)
    v = F.try_parse_json(j)
    held = F.from_json(j, "map<string,string>")
    strings = F.filter(F.map_values(held), lambda x: x.isNotNull() & ~x.rlike(r"^[\[{]|^-?\d+(\.\d+)?$|^(true|false|null)$"))
    of_object = F.coalesce(F.when(F.size(held) == 1, F.get(F.map_values(held), 0)), F.try_element_at(held, F.lit("query")), F.get(strings, 0))
    return F.coalesce(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")), F.when(j.rlike(r"^\s*\{"), of_object), j)


def half_floats(payload: str | Column) -> Column:
    """Vector of half-precision floats in base64, as array<float>."""
    @F.pandas_udf("array<float>")
    def decode(parts: pd.Series) -> pd.Series:
        import base64

        import numpy as np

        return parts.map(lambda p: None if p is None else np.frombuffer(base64.b64decode(p), "<f2").astype(np.float32).tolist())

    return decode(col(payload))

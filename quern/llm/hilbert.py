"""Sharding along a Hilbert curve over metadata, in DataFrame functions only.

Each metadata dimension is quantised to 2^bits steps without looking at the data: numbers by a logarithmic scale,
categories by a hash (an equality on the category still prunes). Counts are taken per curve cell and salt; the cell
table, bounded by the grid, is put in curve order, and every row's place is its cell's offset plus its place inside the
cell. Runs of equal row count along that order are the shards.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import table

SHARDS = 24
BITS = 4
ROWS_PER_SALT = 200_000


@lru_cache
def curve_table(dims: int) -> tuple[tuple[tuple[int, int], ...], ...]:
    """The curve as an automaton: [state][point bits] -> (index bits, next state). A state is (entry corner, axis)."""
    full = (1 << dims) - 1

    def rotl(x: int, k: int) -> int:
        k %= dims
        return ((x << k) | (x >> (dims - k))) & full

    def trailing_ones(x: int) -> int:
        n = 0
        while x & 1:
            x, n = x >> 1, n + 1
        return n

    def ungray(x: int) -> int:
        out = 0
        while x:
            out, x = out ^ x, x >> 1
        return out

    rows = []
    for state in range(dims << dims):
        entry, axis = state % (1 << dims), state >> dims
        row = []
        for point in range(1 << dims):
            turned = rotl(point ^ entry, dims - (axis + 1) % dims)
            w = ungray(turned)
            corner = 0 if w == 0 else ((2 * ((w - 1) // 2)) ^ (2 * ((w - 1) // 2) >> 1))
            step = 0 if w == 0 else trailing_ones(w - 1 if w % 2 == 0 else w) % dims
            row.append((w, ((entry ^ rotl(corner, axis + 1)) & full) | (((axis + step + 1) % dims) << dims)))
        rows.append(tuple(row))
    return tuple(rows)


def hilbert_index(dims: list[Column], bits: int = BITS) -> Column:
    """Index of the cell whose coordinates are `dims` (ints from 0 to 2^bits - 1) along the Hilbert curve, bigint."""
    n = len(dims)
    auto = curve_table(n)
    out = F.array(*[F.lit(w) for row in auto for w, _ in row])
    then = F.array(*[F.lit(s) for row in auto for _, s in row])
    coords = F.array(*[d.cast("int") for d in dims])

    def step(acc: Column, level: Column) -> Column:
        digit = F.aggregate(
            F.transform(coords, lambda c, i: F.call_function("shiftleft", F.call_function("shiftright", c, level).bitwiseAND(1), i)),
            F.lit(0),
            lambda a, x: a.bitwiseOR(x),
        )
        at = acc["state"] * (1 << n) + digit
        return F.struct((acc["index"] * (1 << n) + F.get(out, at)).alias("index"), F.get(then, at).alias("state"))

    start = F.struct(F.lit(0).cast("bigint").alias("index"), F.lit(0).alias("state"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), start, step)["index"]


def category_step(c: Column, bits: int = BITS) -> Column:
    """Step of a category: its hash; null has step 0 with whatever hashes there."""
    return F.when(c.isNull(), 0).otherwise(F.pmod(F.xxhash64(c), F.lit(1 << bits))).cast("int")


def number_step(c: Column, bits: int = BITS, steps_per_octave: float = 1.0) -> Column:
    """Step of a number: the logarithm; null and what is below 1 have step 0, large numbers the last step."""
    return F.greatest(F.lit(0), F.least(F.lit((1 << bits) - 1), F.floor(F.log2(F.greatest(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0)) + 1) * steps_per_octave))).cast("int")


def hilbert_shards(df: DataFrame, key: str, dims: dict[str, Column], shards: int = SHARDS, bits: int = BITS, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """`df` with `h_index` (curve index), `shard` (0 to shards - 1) and `slot` (gapless from 0 in its shard).

    `dims` maps names to step columns. Row counts of shards differ by at most one; a shard is a run of the curve. Inside
    a cell the order is by hashed `key`, then `key`; rows alike in both are interchangeable. A full cell is divided by a
    salt of the hashed key, so that no task orders more than about `rows_per_salt` rows. Nulls are a step or key of their
    own, an empty table gives an empty result, other columns are kept, also those named like the working columns here.
    """
    inner = df.select(F.struct("*").alias("row"), F.col(key).alias("k"), *[c.alias(f"d{i}") for i, c in enumerate(dims.values())])
    names = [f"d{i}" for i in range(len(dims))]
    most = inner.groupBy(*names).count().agg(F.max("count"), F.sum("count")).first()
    salts = max(1, -(-(most[0] or 0) // rows_per_salt))
    inner = inner.withColumn("salt", F.pmod(F.xxhash64(F.col("k"), F.lit("salt")), F.lit(salts)).cast("int"))
    # Bounded: 2^(bits * dims) cells, and the salts that keep their rows within rows_per_salt.
    cells = inner.groupBy(*names, "salt").count().withColumn("h_index", hilbert_index([F.col(n) for n in names], bits))
    before = F.coalesce(F.sum("count").over(Window.orderBy("h_index", "salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("before", before).drop("count")
    order = Window.partitionBy(*names, "salt").orderBy(F.xxhash64("k"), "k")
    placed = inner.withColumn("in_cell", F.row_number().over(order) - 1).join(cells, [*names, "salt"])
    place, total = F.col("before") + F.col("in_cell"), most[1] or 0
    small, longer = divmod(total, shards)  # the first `longer` shards have one row more
    edge = longer * (small + 1)
    shard = F.when(place < edge, F.floor(place / (small + 1))).otherwise(longer + F.floor((place - edge) / max(1, small))).cast("int")
    start = F.col("shard") * small + F.least(F.col("shard"), F.lit(longer))
    return placed.withColumn("shard", shard).select("row.*", "h_index", "shard", (place - start).cast("bigint").alias("slot"))


def op3_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of equal row count, by language, source and length along the curve."""
    docs = table(spark, sf_dir, "documents")
    narrow = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        "lang", "source", "n_chars",
    )
    dims = {"lang": category_step(F.col("lang")), "source": category_step(F.col("source")), "n_chars": number_step(F.col("n_chars"))}
    out = hilbert_shards(narrow, "doc_id", dims)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "h_index")

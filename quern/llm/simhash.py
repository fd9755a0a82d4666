"""SimHash near-duplicates through hierarchical indexes in Gray order.

Fingerprints within `radius` bits agree on one of a few bit masks (the pigeonhole principle), so a group is the
fingerprints that agree on one mask. A group is sorted by Gray rank and indexed: leaves are runs of the order, upper
nodes hold the bits shared by all below them as (mask, value), and the search walks pairs of nodes, dropping a pair as
soon as the differences fixed on its path exceed the radius. A group above `group_rows` is first cut into chunks of the
Gray order; pairs of chunks are pruned by the same shared patterns before any row is sent to them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.candidates import Comparison, bucket_components
from quern.llm.common import cut, in_batches, prefilter, sized_broadcast, table, without_ids
from quern.llm.components import connected_components

GROUP_ROWS = 4096
LEAF = 32
FAN = 8
SKETCH = 32
SHARED = 14


def shingle_digests(text: str | None, width: int) -> np.ndarray:
    """(n, 8) bytes, big-endian: the hashes of the word shingles, repeats included; of fewer words that of the whole sequence."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros((0, 8), np.uint8)
    line = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= width:
        return np.frombuffer(digest(line, 42), np.uint8).reshape(1, 8)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    raw = b"".join([digest(line[s:e], 42) for s, e in zip(starts, ends[width - 1 :].tolist())])
    return np.frombuffer(raw, np.uint8).reshape(-1, 8)


def fingerprint_of(digests: np.ndarray, step: int = 65536) -> bytes:
    """Eight bytes, big-endian. A bit is set if it is in over half of the hashes; none is without any."""
    count = np.zeros(64, np.int64)
    for i in range(0, len(digests), step):
        count += np.unpackbits(digests[i : i + step], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(count * 2 > len(digests)).tobytes()


def distinct_hashes(digests: np.ndarray) -> np.ndarray:
    """The distinct hashes as bigints, ascending."""
    return np.unique(digests.view(">i8").ravel().astype(np.int64))


def fingerprint_bytes(text: str | None, width: int) -> bytes:
    """Eight bytes, big-endian. A bit is set if it is in over half of the hashes of the word shingles."""
    return fingerprint_of(shingle_digests(text, width))


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp bigint) for every row of `docs` (doc_id, text); null and wordless texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b"".join(fingerprint_bytes(t.as_py(), width) for t in b.column(1))
            fp = np.frombuffer(raw, ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fp)], names=["doc_id", "fp"])

    return in_batches(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))).mapInArrow(run, "doc_id bigint, fp bigint")


def gray_rank(fp: Column) -> Column:
    """Place of `fp` in the Gray code, as an unsigned value moved into the order of bigint."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp.bitwiseXOR(F.lit(-(2**63)))


def pigeonhole_masks(rows: int, radius: int, bits: int = 64, wanted: int = 64) -> list[int]:
    """Masks such that two fingerprints within `radius` bits agree on one of them; the more rows the longer masks."""
    for extra in range(1, 5):
        blocks = radius + extra
        edges = [round(i * bits / blocks) for i in range(blocks + 1)]
        own = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
        masks = [sum(c) for c in combinations(own, extra)]
        if rows >> min(m.bit_count() for m in masks) <= wanted:
            break
    return [m - (1 << 64) if m >> 63 else m for m in masks]


class GrayIndex:
    """Fingerprints (uint64, in Gray order) under levels of (start, end, mask, value), the root last."""

    def __init__(self, fp: np.ndarray, leaf: int = LEAF, fan: int = FAN):
        self.fp = fp
        cuts = np.arange(0, len(fp), leaf)
        ones, any_ = np.bitwise_and.reduceat(fp, cuts), np.bitwise_or.reduceat(fp, cuts)
        self.leaves = np.append(cuts, len(fp))
        self.levels = [(~(ones ^ any_), ones)]
        self.children = []
        while len(ones) > 1:
            cuts = np.arange(0, len(ones), fan)
            self.children.append(np.append(cuts, len(ones)))
            ones, any_ = np.bitwise_and.reduceat(ones, cuts), np.bitwise_or.reduceat(any_, cuts)
            self.levels.append((~(ones ^ any_), ones))


def _expand(edges: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = edges[nodes + 1] - edges[nodes]
    owner = np.repeat(np.arange(len(nodes)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(edges[nodes], n)


def index_pairs(a: GrayIndex, b: GrayIndex, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of all fingerprints within `radius` bits; with a is b, each pair once and none with itself."""
    level_a, level_b = len(a.levels) - 1, len(b.levels) - 1
    na, nb = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(na):
        (ma, va), (mb, vb) = a.levels[level_a], b.levels[level_b]
        near = np.bitwise_count((va[na] ^ vb[nb]) & ma[na] & mb[nb]) <= radius
        if a is b and level_a == level_b:
            near &= na <= nb
        na, nb = na[near], nb[near]
        if level_a == level_b == 0:
            break
        if level_a >= level_b:
            owner, na = _expand(a.children[level_a - 1], na)
            nb, level_a = nb[owner], level_a - 1
        else:
            owner, nb = _expand(b.children[level_b - 1], nb)
            na, level_b = na[owner], level_b - 1
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, len(na), 4096):
        owner, x = _expand(a.leaves, na[i : i + 4096])
        owner2, y = _expand(b.leaves, nb[i : i + 4096][owner])
        x = x[owner2]
        hit = np.bitwise_count(a.fp[x] ^ b.fp[y]) <= radius
        if a is b:
            hit &= x < y
        left.append(x[hit])
        right.append(y[hit])
    return np.concatenate(left), np.concatenate(right)


def _forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node reachable."""
    root = np.arange(n)
    while len(x):
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        np.minimum.at(root, before[x], low)
        np.minimum.at(root, before[y], low)
        root = root[root]
        if (root[x] == root[y]).all():
            return root
    return root


def _tree(n: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some of the pairs (x, y) of n nodes, fewer than n, that connect what all of them connect."""
    left, right = [x[:0]], [y[:0]]
    root = np.arange(n)
    while True:
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
        if not len(x):
            return np.concatenate(left), np.concatenate(right)
        # of each component one pair that leaves it by its lesser root: no circles
        low, first = np.unique(np.maximum(root[x], root[y]), return_index=True)
        left.append(x[first])
        right.append(y[first])
        root = _forest(n, root[x[first]], root[y[first]])[root]


def _links(fp: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the links of one unit: of all its fingerprints, or between its sides 0 and 1."""
    if len(fp) < 2:
        return fp[:0], fp[:0]
    if side.any():
        first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(first) or not len(second):
            return fp[:0], fp[:0]
        x, y = index_pairs(GrayIndex(fp[first]), GrayIndex(fp[second]), radius)
        x, y = first[x], second[y]
    elif len(fp) <= 2 * LEAF:
        x, y = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius, 1))
    else:
        x, y = index_pairs(index := GrayIndex(fp), index, radius)
    x, y = _tree(len(fp), x, y)
    return fp[x], fp[y]


def _search(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by unit, then Gray rank. A unit has at most two chunks."""
        held: list[np.ndarray] | None = None
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            change = np.flatnonzero(np.any([np.diff(c) != 0 for c in held[:4]], axis=0)) + 1
            if len(change):
                yield from units(held, np.concatenate([[0], change]))
                held = [c[change[-1] :] for c in held]
        if held is not None and len(held[0]):
            yield from units(held, np.array([0, len(held[0])]))

    def units(cols: list[np.ndarray], cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        us, vs = [], []
        fp, side = cols[5].astype(np.int64).view(np.uint64), cols[4]
        for s, e in zip(cuts[:-1], cuts[1:]):
            if e - s > 1:
                u, v = _links(fp[s:e], side[s:e], radius)
                if len(u):
                    us.append(u)
                    vs.append(v)
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (us, vs)], names=["u", "v"])

    return run


def near_pairs(prints: DataFrame, radius: int = 4, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Edges (u, v) that span all links of at most `radius` bits between the distinct non-null `fp` of `prints`."""
    prints = prints.select("fp").filter("fp is not null").distinct()
    rows = prints.count()
    masks = F.array(*[F.lit(m) for m in pigeonhole_masks(rows, radius)])
    keyed = prints.select("fp", F.posexplode(masks).alias("m", "mask")).select("m", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    keyed = keyed.withColumn("gray", gray_rank(F.col("fp")))
    sizes = keyed.groupBy("m", "key").count()
    large = cut(sizes.filter(F.col("count") > group_rows).select("m", "key"))
    one = [F.lit(0).cast("bigint").alias(c) for c in ("i", "j")] + [F.lit(0).alias("side")]
    if large.isEmpty():
        units = keyed.select("m", "key", *one, "fp", "gray")
    else:
        hot = _chunks(keyed.join(large, ["m", "key"]).withColumn("chunk", F.lit(0).cast("bigint")), group_rows)
        shared = hot.groupBy("m", "key", "chunk").agg(F.bit_and("fp").alias("ones"), F.bit_or("fp").alias("any"))
        shared = shared.select("m", "key", "chunk", "ones", F.bitwise_not(F.col("ones").bitwiseXOR(F.col("any"))).alias("mask"))
        a, b = shared.alias("a"), shared.alias("b")
        differ = F.bit_count(F.col("a.ones").bitwiseXOR(F.col("b.ones")).bitwiseAND(F.col("a.mask")).bitwiseAND(F.col("b.mask")))
        met = a.join(b, (F.col("a.m") == F.col("b.m")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.chunk") <= F.col("b.chunk")) & (differ <= radius))
        met = cut(met.select("a.m", "a.key", F.col("a.chunk").alias("i"), F.col("b.chunk").alias("j")))
        first = met.select("m", "key", F.col("i").alias("chunk"), "i", "j", F.lit(0).alias("side"))
        second = met.filter("i < j").select("m", "key", F.col("j").alias("chunk"), "i", "j", F.lit(1).alias("side"))
        spread = hot.join(first.unionByName(second), ["m", "key", "chunk"]).select("m", "key", "i", "j", "side", "fp", "gray")
        units = keyed.join(large, ["m", "key"], "left_anti").select("m", "key", *one, "fp", "gray").unionByName(spread)
    units = units.repartition("m", "key", "i", "j").sortWithinPartitions("m", "key", "i", "j", "side", "gray").select("m", "key", "i", "j", "side", "fp")
    return units.mapInArrow(_search(radius), "u bigint, v bigint")


def _chunks(hot: DataFrame, group_rows: int, ways: int = 32) -> DataFrame:
    """`hot` with its groups cut into chunks of the Gray order, by quantile sketches, until none is above `group_rows`."""
    while True:
        borders = hot.groupBy("m", "key", "chunk").agg(F.percentile_approx("gray", [i / ways for i in range(1, ways)], 2000).alias("q"), F.count("fp").alias("n"))
        borders = borders.withColumn("q", F.when(F.col("n") > group_rows, F.col("q")).otherwise(F.array().cast("array<bigint>"))).drop("n")
        sub = F.size(F.filter("q", lambda x: x < F.col("gray")))
        hot = cut(hot.join(borders, ["m", "key", "chunk"]).select("m", "key", "fp", "gray", (F.col("chunk") * ways + sub).alias("chunk")))
        if hot.groupBy("m", "key", "chunk").count().filter(F.col("count") > group_rows).isEmpty():
            return hot


def simhash_components(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row of `docs`; component_id is the least doc_id reachable by links.

    Null and wordless texts have fingerprint 0 and are linked like any other; repeated rows get equal results; an empty
    table gives an empty result; rows with a null doc_id take part, and a component of only such rows has a null id.
    Columns other than doc_id and text are not looked at.
    """
    prints = cut(fingerprints(docs, width))
    roots = connected_components(near_pairs(prints, radius)).withColumnRenamed("node", "fp")
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first")).join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    firsts = cut(firsts)
    least = firsts.groupBy("root").agg(F.min("first").alias("component_id"))
    named = firsts.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def word_shingles(text: str | None, width: int) -> set[bytes]:
    """Runs of `width` words, lower-cased as for fingerprints; of fewer words the whole sequence; empty without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def body_hash(text: str | None) -> int:
    """Equal for texts of equal words."""
    return xxhash.xxh64_intdigest(b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()), 11) - (1 << 63)


class TextComparison(Comparison):
    """Jaccard similarity of the word shingles of `texts` (id, text), with `sketches` (id, fp, size, least); with a `radius` the fingerprints have
    to be within it, too.

    `least` are the `SKETCH` least hashes of a text's `size` shingles. Pairs that have fewer than `SHARED` of the least ones of both
    in common are dropped before: at a similarity of 0.8 that is about one pair in a million.
    """

    def __init__(self, sketches: DataFrame, texts: DataFrame, width: int, radius: int | None, similarity: float):
        self.sketches, self.texts, self.width, self.radius, self.similarity = sketches, texts, width, radius, similarity

    def sketched(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.sketches.select("id", F.struct("fp", "size", "least").alias("sketch")), "id")

    def possible(self, x: Column, y: Column) -> Column:
        t = self.similarity
        near = F.lit(True) if self.radius is None else F.bit_count(x["fp"].bitwiseXOR(y["fp"])) <= self.radius
        sizes = F.least(x["size"], y["size"]) >= t * F.greatest(x["size"], y["size"]) - 1e-9
        if t < 0.8:
            return near & sizes
        both = F.array_intersect(x["least"], y["least"])
        first = F.slice(F.sort_array(F.array_union(x["least"], y["least"])), 1, SKETCH)
        return near & sizes & ((F.least(x["size"], y["size"]) < SKETCH) | ((F.size(both) >= SHARED) & (F.size(F.array_intersect(first, both)) >= SHARED)))

    def verify(self, pairs: DataFrame) -> DataFrame:
        width, similarity = self.width, self.similarity

        def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = []
                for x, y in zip(b.column(2), b.column(3)):
                    s, t = word_shingles(x.as_py(), width), word_shingles(y.as_py(), width)
                    both = len(s & t)
                    keep.append(both >= similarity * (len(s) + len(t) - both) - 1e-9)
                mask = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["u", "v"])

        x, y = [self.texts.select(F.col("id").alias(k), F.col("text").alias(n)) for k, n in (("u", "x"), ("v", "y"))]
        return in_batches(pairs.select("u", "v").join(x, "u").join(y, "v").select("u", "v", "x", "y")).mapInArrow(alike, "u bigint, v bigint")

    def finer(self, rows: DataFrame) -> DataFrame:
        """(key, id) for the rows of hot buckets: the first shingles of each text in an order that has the rarest of the bucket first."""
        width, t = self.width, self.similarity

        def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sets = pa.array([distinct_hashes(shingle_digests(x.as_py(), width)) for x in b.column(2)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), sets], names=["key", "id", "tokens"])

        held = in_batches(rows.select("key", "id").join(self.texts.select("id", "text"), "id").select("key", "id", "text"))
        held = cut(held.mapInArrow(tokens, "key bigint, id bigint, tokens array<bigint>").select("key", "id", F.explode("tokens").alias("token")))
        counted = held.join(held.groupBy("key", "token").count(), ["key", "token"])
        order = counted.groupBy("key", "id").agg(F.sort_array(F.collect_list(F.struct("count", "token"))).alias("s"))
        first = F.slice("s", 1, F.size("s") - F.ceil(t * F.size("s") - 1e-9).cast("int") + 1)
        return order.select("key", "id", F.explode(first).alias("t")).filter("t.count > 1").select(F.xxhash64("key", "t.token").alias("key"), "id")


def near_copies(docs: DataFrame, width: int = 5, radius: int = 7, similarity: float = 0.8, every: bool = False) -> DataFrame:
    """(doc_id, component_id) for the rows of `docs` with a doc_id: components of texts of equal words, and of texts
    whose word shingles have a Jaccard similarity of `similarity` and whose fingerprints are within `radius` bits or,
    with `every`, differ in however many.

    First the pairs are compared that span what fingerprints within `radius` link. Then texts of different components that
    share one of their first shingles by hash, as all pairs of that similarity do, so that no link is left out. Null and
    wordless texts are equal.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, ids, sizes, least, first = [], [], [], [], []
            for text in b.column(1).to_pylist():
                digests = shingle_digests(text, width)
                own = distinct_hashes(digests)
                fps.append(fingerprint_of(digests))
                ids.append(body_hash(text))
                sizes.append(len(own))
                least.append(own[:SKETCH])
                first.append(own[: len(own) - math.ceil(similarity * len(own) - 1e-9) + 1])
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (least, first)]
            fp = pa.array(np.frombuffer(b"".join(fps), ">i8").astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.int64()), fp, pa.array(sizes, pa.int32()), *lists], names=["doc_id", "id", "fp", "size", "least", "first"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).filter("doc_id is not null")
    prints = cut(in_batches(rows).mapInArrow(run, "doc_id bigint, id bigint, fp bigint, size int, least array<bigint>, first array<bigint>"))
    bodies = cut(prints.groupBy("id").agg(F.min("doc_id").alias("lead"), F.min("fp").alias("fp"), F.count("fp").alias("n")))
    again = cut(bodies.filter("n > 1").select("id"))
    again = sized_broadcast(again, again.count())
    sole = prints.join(again, "id", "left_anti").unionByName(prints.join(again, "id", "left_semi").dropDuplicates(["id"]))
    keys = sole.select(F.explode("first").alias("key"), "id").withColumn("part", F.shiftrightunsigned("key", 32))
    # most shingles are in one text: half of each tells which are not, before whole rows move
    met = cut(keys.groupBy("part").count().filter("count > 1").select("part"))
    keys = cut(prefilter(keys, "part", met).join(met, "part", "left_semi").select("key", "id"))
    leads = bodies.groupBy("fp").agg(F.min("id").alias("a"))
    edges = near_pairs(bodies, radius)
    across = edges.join(leads.withColumnRenamed("fp", "u"), "u").join(leads.select(F.col("fp").alias("v"), F.col("a").alias("b")), "v").select("a", "b")
    within = bodies.join(leads, "fp").filter("id <> a").select("a", F.col("id").alias("b"))
    tree = cut(across.unionByName(within).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")))

    def comparison(ids: DataFrame) -> TextComparison:
        wanted = cut(bodies.join(ids.distinct(), "id", "left_semi").select("id", F.col("lead").alias("doc_id")))

        def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows repeated under one doc_id may hold other texts than the one of the id."""
            for b in batches:
                yield b.filter(pa.array([i == body_hash(t.as_py()) for i, t in zip(b.column(0).to_pylist(), b.column(1))], pa.bool_()))

        few = sized_broadcast(wanted, wanted.count())
        texts = prefilter(rows, "doc_id", wanted).join(few, "doc_id").select("id", "text")
        texts = cut(in_batches(texts).mapInArrow(named, "id bigint, text string"))
        sketches = prefilter(prints, "id", wanted).join(few, ["id", "doc_id"], "left_semi").select("id", "fp", "size", "least")
        if not texts.groupBy("id").count().filter("count > 1").isEmpty():  # rows repeated
            texts, sketches = cut(texts.dropDuplicates(["id"])), sketches.dropDuplicates(["id"])
        return TextComparison(cut(sketches), texts, width, None if every else radius, similarity)

    links = cut(comparison(tree.select(F.explode(F.array("u", "v")).alias("id"))).verify(tree))
    roots, _ = bucket_components(keys, comparison, known=links)
    named = prints.select("doc_id", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = cut(named)
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "root").select("doc_id", "component_id")


def keep_first_of_near_copies(docs: DataFrame, width: int = 5, radius: int = 7, similarity: float = 0.8, every: bool = False) -> DataFrame:
    """The rows of `docs` but those that `near_copies` puts with one of a smaller doc_id.

    Of rows repeated under one doc_id one stays, and of null and wordless texts the first; rows with a null doc_id stay; an
    empty table gives an empty result.
    """
    found = cut(near_copies(docs, width, radius, similarity, every))
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    left = without_ids(docs, gone)
    repeated = docs.filter("doc_id is not null").groupBy("doc_id").count().filter(F.col("count") > 1)
    return left if repeated.isEmpty() else left.filter("doc_id is null").unionByName(left.filter("doc_id is not null").dropDuplicates(["doc_id"]))


def op9_simhash_gray(spark, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

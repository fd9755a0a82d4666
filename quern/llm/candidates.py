"""Similarity components from bucket keys, without all pairs of a bucket.

Items (hashes of distinct values) come with the keys of the buckets that they fall in. Buckets of the same items count
once. First every item is compared with its bucket's pivot, the least id, which is linear in the rows. Items that are
linked by then need no further comparison, so a bucket whose items are all in one component is done. Of the others those
above `HOT` items are cut by finer keys, if the comparison has such, and go through a round of pivots again, and what is
above `HOT` then is cut once more. In what is not done at last, the pairs of different components are compared, which loses no link: a pair that is not compared is
connected already. Where the comparison tells how far apart sketches are, each item's nearest pair is compared before the
others, most of which are connected by then.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut, prefilter
from quern.llm.components import connected_components

HOT = 4096
#: How often what is still above `HOT` is cut again.
LEVELS = 3


class Comparison:
    """How pairs are compared."""

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The linked ones of distinct pairs (u, v)."""
        raise TypeError("a comparison has to say which pairs are linked")

    def sketched(self, rows: DataFrame) -> DataFrame:
        """`rows` with a column `sketch` of bounded width, by their column `id`."""
        return rows.withColumn("sketch", F.lit(0))

    def possible(self, x: Column, y: Column) -> Column:
        """Whether items of these sketches may be linked."""
        return F.lit(True)

    def gap(self, x: Column, y: Column) -> Column | None:
        """How far apart items of these sketches seem; None where that is not known."""
        return None

    def closer(self, pairs: DataFrame) -> DataFrame:
        """The rows (u, v, ..) of pairs that a closer look than at sketches does not rule out; asked for pairs of one bucket,
        few of which are linked."""
        return pairs

    def sifted(self, pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) that their sketches do not rule out."""
        both = self.sketched(pairs.withColumnRenamed("u", "id")).withColumnRenamed("id", "u").withColumnRenamed("sketch", "s")
        both = self.sketched(both.withColumnRenamed("v", "id")).withColumnRenamed("id", "v").withColumnRenamed("sketch", "t")
        return both.filter(self.possible(F.col("s"), F.col("t"))).select("u", "v")

    def finer(self, rows: DataFrame) -> DataFrame | None:
        """(key, id) rows for the (key, id, n) rows of hot buckets of n items, such that linked items of a bucket share a key
        still; None where there are no finer keys."""
        return None


def _buckets(keys: DataFrame) -> DataFrame:
    """(key, pivot, n, x, weight) of one bucket each for the sets of two items or more of distinct rows (key, id), and how
    many buckets hold that set."""
    # most keys have one item, so nothing would combine before the shuffle, and the sums would only make its rows wider
    sets = keys.select("key", "id").repartition("key").groupBy("key").agg(F.min("id").alias("pivot"), F.count("id").alias("n"), F.bit_xor("id").alias("x")).filter("n > 1")
    return cut(sets.groupBy("pivot", "n", "x").agg(F.min("key").alias("key"), F.count("key").alias("weight")))


def _members(keys: DataFrame, buckets: DataFrame) -> DataFrame:
    """(key, id, pivot, n, weight) of the buckets of more than two."""
    large = buckets.filter("n > 2").select("key", "pivot", "n", "weight")
    return cut(prefilter(keys, "key", large).join(large, "key").select("key", "id", "pivot", "n", "weight"))


def _twos(buckets: DataFrame) -> DataFrame:
    return buckets.filter("n = 2").select(F.col("pivot").alias("u"), F.col("pivot").bitwiseXOR(F.col("x")).alias("v"), "weight")


def _voted(pairs: DataFrame, votes: int) -> DataFrame:
    """Distinct pairs (u, v) of (u, v, weight) rows whose weights reach `votes`; with a `gap`, where the rows have it."""
    if votes == 1:
        return pairs.drop("weight").distinct()
    gap = [F.min("gap").alias("gap")] if "gap" in pairs.columns else []
    return pairs.groupBy("u", "v").agg(F.sum("weight").alias("n"), *gap).filter(F.col("n") >= votes).drop("n")


def _pivot_pairs(buckets: DataFrame, shared: DataFrame, votes: int) -> DataFrame:
    return _voted(_twos(buckets).unionByName(shared.filter("id > pivot").select(F.col("pivot").alias("u"), F.col("id").alias("v"), "weight")), votes)


def _open(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, id, n, weight, root) of the buckets whose items are not all in one component."""
    named = shared.join(roots.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "n", "weight", F.coalesce("root", "id").alias("root"))
    open_ = named.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b").select("key")
    return cut(named.join(open_, "key"))


def _crossing(rest: DataFrame, votes: int, twos: DataFrame | None, how: Comparison) -> DataFrame:
    """Pairs (u, v) of different components that share `votes` of the buckets (key, id, root, weight), or of two-item buckets.
    Pairs that the sketches rule out are dropped where they arise, the others have a `gap` if that is known."""
    rest = cut(how.sketched(rest))
    a = rest.select("key", F.col("id").alias("u"), F.col("root").alias("x"), F.col("sketch").alias("s"), "weight")
    b = rest.select("key", F.col("id").alias("v"), F.col("root").alias("y"), F.col("sketch").alias("t"))
    gap = how.gap(F.col("s"), F.col("t"))
    met = a.join(b, "key").filter("u < v and x <> y").filter(how.possible(F.col("s"), F.col("t")))
    met = met.select("u", "v", "weight", *([] if gap is None else [gap.alias("gap")]))
    return _voted(met if twos is None else met.unionByName(twos, allowMissingColumns=True), votes)


def _nearest(pairs: DataFrame) -> DataFrame:
    """Of the pairs (u, v, gap) those of least gap at one of their ends."""
    ends = pairs.select(F.explode(F.array("u", "v")).alias("id"), F.struct("gap", "u", "v").alias("pair"))
    return ends.groupBy("id").agg(F.min("pair").alias("pair")).select("pair.u", "pair.v").distinct()


def _rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (u, v, ..) of different components, with the roots x and y of their ends."""
    for end, name in (("u", "x"), ("v", "y")):
        pairs = pairs.join(roots.select(F.col("node").alias(end), F.col("root").alias(name)), end, "left").withColumn(name, F.coalesce(name, end))
    return pairs.filter("x <> y")


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of components (node, root) after more links (u, v)."""
    above = connected_components(_rooted(links, roots).select(F.col("x").alias("u"), F.col("y").alias("v")))
    moved = roots.join(above.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    return cut(moved.select("node", F.coalesce("top", "root").alias("root")).unionByName(above))


def bucket_components(keys: DataFrame, prepare: Callable[[DataFrame], Comparison], votes: int = 1, hot: int = HOT, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(components, compared) from distinct rows `keys` (key, id), two bigints; ids must be well-spread 64-bit hashes, since
    buckets of the same items are told by count, least id and exclusive or.

    `prepare` takes the ids (id) that share a bucket with another and says how their pairs are compared. Only pairs that
    share at least `votes` buckets are; two items with a finer key in common have to share as many. `known` are links (u, v) that
    need no comparison. components is (node, root) of the items with a link, compared the pairs (u, v) that were verified. Null keys and ids are
    ignored, an empty table gives empty results.
    """
    keys = keys.filter("key is not null and id is not null")
    buckets = _buckets(keys)
    shared = _members(keys, buckets)
    pairs = cut(_pivot_pairs(buckets, shared, votes))
    how = prepare(shared.select("id").unionByName(_twos(buckets).select(F.explode(F.array("u", "v")).alias("id"))).distinct())
    links = how.verify(how.sifted(pairs))
    links = cut(links if known is None else links.unionByName(known.select("u", "v")))
    roots = connected_components(links)
    rest = _open(shared, roots)
    if rest.isEmpty() and votes == 1:
        return roots, pairs
    large, rest = rest.filter(F.col("n") > hot), rest.filter(F.col("n") <= hot)
    crossing = []
    for _ in range(LEVELS):
        finer = None if large.isEmpty() else how.finer(large.select("key", "id", "n"))
        if finer is None:
            break
        own = cut(finer)
        fine_buckets = _buckets(own)
        fine = _members(own, fine_buckets)
        again = cut(_pivot_pairs(fine_buckets, fine, 1).join(pairs, ["u", "v"], "left_anti"))
        pairs = cut(pairs.unionByName(again))
        links = cut(links.unionByName(how.verify(how.sifted(again))))
        roots = connected_components(links)
        still = _open(fine, roots)
        crossing.append(still.filter(F.col("n") <= hot).drop("root"))
        large = still.filter(F.col("n") > hot)
    if crossing:
        met = reduce(DataFrame.unionByName, crossing, large.drop("root"))
        found = _crossing(_open(rest.drop("root"), roots), votes, _twos(buckets) if votes > 1 else None, how).unionByName(_crossing(_open(met, roots), 1, None, how)).distinct()
    else:
        found = _crossing(rest.unionByName(large), votes, _twos(buckets) if votes > 1 else None, how)
    more = cut(how.closer(cut(found.join(pairs, ["u", "v"], "left_anti"))))
    if "gap" in more.columns:
        best = cut(_nearest(more))
        pairs = pairs.unionByName(best)
        roots = _joined(roots, cut(how.verify(best)))
        more = cut(_rooted(more.join(best, ["u", "v"], "left_anti"), roots))
    more = more.select("u", "v")
    return _joined(roots, cut(how.verify(more))), pairs.unionByName(more)

"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Test items are read into word n-grams, each of which is a seed: which ones an edited copy has kept is not known before. A
pass over the documents finds the seeds and aligns the item with the surroundings of each hit, unless these hold too few of
the item's words for the score that is asked for. A copy is missed only if no `NGRAM` words in a row are left of the item.
Items are sent to the tasks in slices of at most `SLICE_WORDS` words, one pass a slice, so what a task holds is bounded
however large the benchmark is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import cut, in_batches, table, without_ids

NGRAM = 3
SLICE_WORDS = 500_000
MATCH, MISMATCH, GAP = 2, -1, -1
SCORE_SHARE = 0.5
LEAST_WORDS = 8
WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class Items:
    """A slice of test items: their words as numbers, and where each n-gram occurs."""

    def __init__(self, items: list[tuple[int, str]], n: int = NGRAM):
        self.n = n
        self.vocab: dict[str, int] = {}
        self.ids: list[int] = []
        self.words: list[np.ndarray] = []
        for item, text in items:
            own = [self.vocab.setdefault(w, len(self.vocab)) for w in words_of(text)]
            self.ids.append(item)
            self.words.append(np.array(own, np.int32))
        base = len(self.vocab) + 1
        if base**n >= 1 << 63:
            raise ValueError("slice too large for its n-gram numbers")
        self.base = base
        codes, owner, place = [], [], []
        for k, w in enumerate(self.words):
            c = self.codes(w)
            codes.append(c)
            owner.append(np.full(len(c), k))
            place.append(np.arange(len(c)))
        cat = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (codes, owner, place)]
        order = np.argsort(cat[0], kind="stable")
        self.code, self.owner, self.place = (x[order] for x in cat)
        self.distinct = np.unique(self.code)

    def codes(self, w: np.ndarray) -> np.ndarray:
        """Number of the n-gram at each place, -1 where a word is not of the items'."""
        m = max(0, len(w) - self.n + 1)
        out, bad = np.zeros(m, np.int64), np.zeros(m, bool)
        for k in range(self.n):
            part = w[k : k + m]
            out = out * self.base + part
            bad |= part < 0
        out[bad] = -1
        return out

    def numbers(self, text: str | None) -> np.ndarray:
        get = self.vocab.get
        return np.array([get(w, -1) for w in words_of(text)], np.int32)

    def known(self, codes: np.ndarray) -> np.ndarray:
        """For each code its place in `distinct`, or -1."""
        if not len(self.distinct):
            return np.full(len(codes), -1)
        at = np.minimum(np.searchsorted(self.distinct, codes), len(self.distinct) - 1)
        return np.where(self.distinct[at] == codes, at, -1)


def smith_waterman(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, int, int]]:
    """(score, start and end in b, matches) of the best local alignment of each pair (a, b) of word numbers.

    All pairs are aligned together, one anti-diagonal at a time; -1 matches nothing. Of equal scores the first end
    counts, and diagonal steps come before gaps.
    """
    if not pairs:
        return []
    rows, cols = max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    a, b = np.full((len(pairs), rows), -2, np.int32), np.full((len(pairs), cols), -3, np.int32)
    for k, (x, y) in enumerate(pairs):
        a[k, : len(x)] = np.where(x < 0, -2, x)
        b[k, : len(y)] = np.where(y < 0, -3, y)
    zero = np.zeros((len(pairs), rows + 1), np.int64)
    # A cell is packed as score, matches and start, so that the larger score and then more matches win. Index: row + 1.
    one = 1 << 40
    before, last = zero.copy(), zero.copy()
    best, end = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    for d in range(rows + cols - 1):
        low, high = max(0, d - cols + 1), min(rows - 1, d)
        i = np.arange(low, high + 1)
        j = d - i
        same = a[:, i] == b[:, j]
        diagonal = before[:, i]
        fresh = diagonal < one
        diagonal = np.where(fresh, (1 << 20) - 1 - j, diagonal)
        score = diagonal + np.where(same, MATCH * one + (1 << 20), MISMATCH * one)
        up, left = last[:, i] + GAP * one, last[:, i + 1] + GAP * one
        cell = np.maximum(np.maximum(score, up), left)
        cell[cell < one] = 0
        now = zero.copy()
        now[:, i + 1] = cell
        top = cell.max(axis=1)
        better = (top >> 20) > (best >> 20)
        best[better] = top[better]
        end[better] = j[cell.argmax(axis=1)[better]] + 1
        before, last = last, now
    return [(int(s >> 40), (1 << 20) - 1 - int(s & ((1 << 20) - 1)), int(e), int(s >> 20 & ((1 << 20) - 1))) if s else (0, 0, 0, 0) for s, e in zip(best, end)]


def slices(benchmark: DataFrame, slice_words: int = SLICE_WORDS) -> Iterator[list[tuple[int, str]]]:
    """The distinct items with text, in slices of at most about `slice_words` words, brought to the driver one by one."""
    items = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    sized = cut(items.withColumn("n", F.size(F.split("text", r"\s+"))))
    parts = max(1, -(-(sized.agg(F.sum("n")).first()[0] or 0) // slice_words))
    for k in range(parts):
        own = sized.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).orderBy("item_id", "text").collect()
        if own:
            yield [(r.item_id, r.text) for r in own]


def all_seeds(items: Items) -> dict[int, list[tuple[int, int]]]:
    """code -> [(item, place)] of every n-gram of every item."""
    seeds: dict[int, list[tuple[int, int]]] = {}
    for code, k, p in zip(items.code.tolist(), items.owner.tolist(), items.place.tolist()):
        seeds.setdefault(code, []).append((k, p))
    return seeds


def align_document(w: np.ndarray, items: Items, seed_codes: np.ndarray, seeds: dict[int, list[tuple[int, int]]]) -> list[tuple[int, np.ndarray, int]]:
    """(item, window, start of the window) for the places of `w` around its seeds; nearby ones of an item are one."""
    codes = items.codes(w)
    if not len(codes) or not len(seed_codes):
        return []
    at = np.minimum(np.searchsorted(seed_codes, codes), len(seed_codes) - 1)
    spans: dict[int, list[list[int]]] = {}
    for p in np.flatnonzero(seed_codes[at] == codes).tolist():
        for k, q in seeds[int(codes[p])]:
            n = len(items.words[k])
            slack = n // 4 + 4
            low, high = max(0, p - q - slack), min(len(w), p - q + n + slack)
            own = spans.setdefault(k, [])
            if own and low <= own[-1][1] and high - own[-1][0] <= 3 * (n + 2 * slack):
                own[-1] = [min(low, own[-1][0]), max(high, own[-1][1])]
            else:
                own.append([low, high])
    return [(k, w[low:high], low) for k, own in spans.items() for low, high in own]


def find_leaks(docs: DataFrame, benchmark: DataFrame, score_share: float = SCORE_SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, item_id, score, share, start_word, end_word, matches): the best alignment of each item in each document
    where it reaches `score_share` of the score of a full copy.

    An item with fewer than `least_words` words, or less than one n-gram, must be there in full. Null and empty texts
    and items give no rows, repeated rows of a document one row, an empty table an empty result; texts are read whole,
    and columns other than doc_id, item_id and text are not looked at.
    """
    schema = "doc_id bigint, item_id bigint, score int, share double, start_word int, end_word int, matches int"
    texts = docs.filter("text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = docs.sparkSession.createDataFrame([], schema)
    for own in slices(benchmark):
        found = found.unionByName(_slice_leaks(texts, Items(own), score_share, least_words, schema))
    best = F.row_number().over(Window.partitionBy("doc_id", "item_id").orderBy(F.desc("score"), "start_word"))
    return found.withColumn("n", best).filter("n = 1").drop("n")


def _slice_leaks(texts: DataFrame, items: Items, score_share: float, least_words: int, schema: str) -> DataFrame:
    seeds, seed_codes = all_seeds(items), items.distinct
    counted = [np.unique(w, return_counts=True) for w in items.words]
    least = [(score_share if len(w) >= least_words else 1.0) for w in items.words]
    tiny = {k: w for k, w in enumerate(items.words) if 0 < len(w) < items.n}

    def may_reach(k: int, window: np.ndarray) -> bool:
        """False only if the item's words in the window are too few for its score, as each gives `MATCH` at most."""
        kinds, n = counted[k]
        at = np.minimum(np.searchsorted(kinds, window), len(kinds) - 1)
        own = np.bincount(at[kinds[at] == window], minlength=len(kinds))
        return bool(np.minimum(own, n).sum() >= least[k] * len(items.words[k]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray, int]] = []

        def settle() -> pa.RecordBatch:
            held.sort(key=lambda x: len(x[2]) + len(items.words[x[1]]))
            rows: list[tuple] = []
            for s in range(0, len(held), 256):
                part = held[s : s + 256]
                for (doc, k, _, low), (score, start, end, matches) in zip(part, smith_waterman([(items.words[k], w) for _, k, w, _ in part])):
                    share = score / (MATCH * len(items.words[k]))
                    if share >= least[k]:
                        rows.append((doc, items.ids[k], score, share, low + start, low + end, matches))
            held.clear()
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "item_id", "score", "share", "start_word", "end_word", "matches"])

        for b in batches:
            for doc, t in zip(b.column(0).to_pylist(), b.column(1)):
                w = items.numbers(t.as_py())
                held += [(doc, k, win, low) for k, win, low in align_document(w, items, seed_codes, seeds) if may_reach(k, win)]
                for k, x in tiny.items():
                    hit = np.flatnonzero(np.all([w[i : len(w) - len(x) + 1 + i] == x[i] for i in range(len(x))], axis=0)) if len(w) >= len(x) else ()
                    if len(hit):
                        held.append((doc, k, w[hit[0] : hit[0] + len(x)], int(hit[0])))
                if len(held) > 2000:
                    yield settle()
        yield settle()

    return in_batches(texts).mapInArrow(run, schema)


def clean_of_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the documents that hold a benchmark item; of those with a null doc_id all stay or none."""
    return without_ids(docs, find_leaks(docs, benchmark).select(F.col("doc_id").alias("gone_id")).distinct())


def op7_seed_alignment(spark, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

"""Document quality by Bradley-Terry ranking: scores learned from preference pairs, cut at a score quantile."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import crc_mod, in_batches, sigmoid, table
from quern.llm.labelled import labelled_ids, labelled_rows

PER_CLASS = 6000
PAIRS = 60_000
UPPER, LOWER, DIGIT = (np.isin(np.arange(256), np.frombuffer(s, np.uint8)) for s in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"))
MARKS = np.isin(np.arange(256), np.frombuffer(b"#$%&*|@^~<>{}[]\\/_=+", np.uint8))
ENDS = np.isin(np.arange(256), np.frombuffer(b".,;:", np.uint8))
SHOUT = np.isin(np.arange(256), np.frombuffer(b"!?", np.uint8))
HIGH = np.arange(256) >= 128
SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\v\f", np.uint8))
CLASSES = np.stack([UPPER, LOWER, DIGIT, MARKS, ENDS, SHOUT, HIGH, SPACE]).astype(np.float64)
FEATURES = 26


def features(text: str | None) -> np.ndarray:
    """Statistics of a whole text; zeros and a first 1 for a null or wordless one."""
    out = np.zeros(FEATURES)
    text = text or ""
    words = text.split()
    if not words:
        out[0] = 1
        return out
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    kinds = CLASSES @ np.bincount(data, minlength=256)
    upper, lower, digit, marks, ends, shout, high, space = kinds.tolist()
    n = len(words)
    length = np.fromiter(map(len, words), np.int64, n)
    letters = max(1.0, upper + lower + high)
    low = [w.lower() for w in words]
    count = Counter(low)
    pairs = len(set(zip(low, low[1:])))
    lines = [s for s in text.split("\n") if s.strip()]
    common = sorted(count.values(), reverse=True)
    starts = sum(w[0].isupper() for w in words)
    plain = sum(map(str.isalpha, words))
    out[1:] = (
        np.log1p(n), upper / letters, digit / len(data), marks / n, ends / n, shout / n, high / letters, space / len(data),
        length.mean(), length.std(), (length <= 3).mean(), (length >= 12).mean(), len(count) / n, pairs / max(1, n - 1),
        common[0] / n, sum(common[:10]) / n, np.log1p(len(lines)), len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))),
        starts / n, plain / n, np.log1p(len(count)), (length == 1).mean(), min(50.0, n / (1 + text.count("."))), sum(map(str.isupper, words)) / n,
    )
    return out


def expand(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -5, 5)
    return np.concatenate([z, z * z / 5], axis=1)


class BradleyTerry:
    """score(document) = w . features, with P(a preferred to b) = sigmoid(score(a) - score(b))."""

    def __init__(self, width: int):
        self.mean, self.scale, self.w = np.zeros(width), np.ones(width), np.zeros(2 * width)
        self.border, self.spread = 0.0, 1.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return expand(x, self.mean, self.scale) @ self.w

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; 0.5 at the quantile where documents start to be kept."""
        return sigmoid((self.raw(x) - self.border) / self.spread)

    def fit(self, x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, steps: int = 400, seed: int = 3) -> "BradleyTerry":
        """Logistic loss on differences of random preference pairs (label 1 over label 0), then the score quantile that
        parts the labels best. With one label only, all scores are equal."""
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        if not len(good) or not len(bad):
            self.spread = 1.0
            return self
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = expand(x, self.mean, self.scale)
        rng = np.random.default_rng(seed)
        d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
        m, v = np.zeros(d.shape[1]), np.zeros(d.shape[1])
        for step in range(1, steps + 1):
            own = d[rng.integers(0, pairs, 8192)]
            g = -(own * (1 - sigmoid(own @ self.w))[:, None]).mean(axis=0) + 1e-4 * self.w
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            self.w -= 0.1 * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        s = z @ self.w
        order = np.argsort(s, kind="stable")
        # With the k lowest scores rejected: rejected zeros and kept ones, each as a share of its label.
        right = np.r_[0, np.cumsum(y[order] == 0)] / len(bad) + 1 - np.r_[0, np.cumsum(y[order] == 1)] / len(good)
        best = np.flatnonzero(right >= right.max() - 0.002)
        k = int(best[0])  # of quantiles that part the labels alike the one that rejects least
        self.border = float((s[order[max(0, k - 1)]] + s[order[min(k, len(s) - 1)]]) / 2)
        self.spread = float(s.std()) + 1e-9
        return self


def document_features(docs: DataFrame) -> DataFrame:
    """(doc_id, features array<double>) of every row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = _matrix(b.column(1))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, FEATURES), pa.int32()), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), flat], names=["doc_id", "features"])

    return in_batches(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))).mapInArrow(run, "doc_id bigint, features array<double>")


def train_quality(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, per_class: int = PER_CLASS) -> BradleyTerry:
    """Fitted on at most `per_class` documents of each label outside the fold `held_out`; without both labels all scores
    are 0.5."""
    ids = labelled_ids(labels, "quality", modulus, held_out, per_class)
    some = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "text")
    known = labelled_rows(document_features(some), ids)
    x, y = np.array([r.features for r in known]).reshape(-1, FEATURES), np.array([r.label for r in known])
    return BradleyTerry(FEATURES).fit(x, y)


def _matrix(texts: pa.Array) -> np.ndarray:
    return np.array([features(t.as_py()) for t in texts]).reshape(-1, FEATURES)


def score_quality(docs: DataFrame, model: BradleyTerry) -> DataFrame:
    """`doc_id`, `score`, `predicted` for every row of `docs` (doc_id, text).

    Null, empty and wordless texts have features of their own and a score like any other; repeated rows get equal scores;
    an empty table gives an empty result; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(_matrix(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return in_batches(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))).mapInArrow(run, "doc_id bigint, score double, predicted int")


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` with a score of at least 0.5, unchanged; where nothing could be learned, all rows."""
    model, at = train_quality(docs, labels), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.score(_matrix(b.column(at))) >= 0.5))

    return in_batches(docs).mapInArrow(run, docs.schema)


def op5_bradley_terry(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")

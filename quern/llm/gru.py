"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of lower-cased UTF-8 bytes in both directions, labels every position, and a document's
probabilities are the mean over its letter positions. It is trained here, in numpy, by backpropagation through time on a
bounded sample; arrays are laid out (features, batch), so that every step works on long runs of memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import crc_mod, in_batches, stable_order, table

WINDOW = 64
HIDDEN = 8
SAMPLE_DOCS = 1500
SAMPLE_CHARS = 100_000
STEPS = 260
UND = "und"
LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[65:91] = LETTER[128:] = True


class BiGRU:
    """Weights by direction: E (3H, 256) input, U (3H, H) recurrent, b folded into E; V (L, 2H), c (L, 1) on top.

    Gates in E and U: update z, reset r, candidate.
    """

    def __init__(self, labels: int, hidden: int = HIDDEN, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.h = hidden
        self.w = {}
        for d in "fb":
            self.w["E" + d] = rng.normal(0, 0.3, (3 * hidden, 256)).astype(np.float32)
            self.w["U" + d] = rng.normal(0, 0.3, (3 * hidden, hidden)).astype(np.float32)
        self.w["V"] = rng.normal(0, 0.3, (labels, 2 * hidden)).astype(np.float32)
        self.w["c"] = np.zeros((labels, 1), np.float32)

    def _run(self, x: np.ndarray, d: str, keep: bool):
        """x (T, B). Hidden states (T, H, B) in the order of x, and with `keep` what backpropagation needs."""
        e, u, h = self.w["E" + d], self.w["U" + d], self.h
        steps, batch = x.shape
        out = np.empty((steps, h, batch), np.float32)
        state = np.zeros((h, batch), np.float32)
        saved = []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = np.take(e, x[t], axis=1)
            r = u @ state
            gates = g[: 2 * h] + r[: 2 * h]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            cand = gates[h:] * r[2 * h :]
            cand += g[2 * h :]
            np.tanh(cand, out=cand)
            new = cand - state
            new *= gates[:h]
            new += state
            if keep:
                saved.append((t, state, gates, cand, r[2 * h :]))
            state = out[t] = new
        return out, saved

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(T, L, B): the label probabilities of every position of x (T, B)."""
        top = self.w["V"] @ np.concatenate([self._run(x, "f", False)[0], self._run(x, "b", False)[0]], axis=1) + self.w["c"]
        top -= top.max(axis=1, keepdims=True)
        np.exp(top, out=top)
        top /= top.sum(axis=1, keepdims=True)
        return top

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of labels y (B) at all positions with `weight` (T, B), and its gradients."""
        h = self.h
        runs = {d: self._run(x, d, True) for d in "fb"}
        states = np.concatenate([runs["f"][0], runs["b"][0]], axis=1)
        p = self.w["V"] @ states + self.w["c"]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        total = max(1.0, float(weight.sum()))
        at = np.arange(x.shape[1])
        loss = -float((np.log(p[:, y, at] + 1e-9) * weight).sum()) / total
        p[:, y, at] -= 1
        p *= weight[:, None, :] / total
        grad = {"V": np.einsum("tlb,tkb->lk", p, states, optimize=True), "c": p.sum(axis=(0, 2))[:, None]}
        back = self.w["V"].T @ p
        for k, d in enumerate("fb"):
            u = self.w["U" + d]
            ge, gu = np.zeros_like(self.w["E" + d]), np.zeros_like(u)
            flow = np.zeros((h, x.shape[1]), np.float32)
            for t, before, gates, cand, rec in reversed(runs[d][1]):
                dh = back[t, k * h : (k + 1) * h] + flow
                z, r = gates[:h], gates[h:]
                dc = dh * z * (1 - cand * cand)
                dz = dh * (cand - before) * z * (1 - z)
                dr = dc * rec * r * (1 - r)
                dg = np.concatenate([dz, dr, dc])
                du = np.concatenate([dz, dr, dc * r])
                gu += du @ before.T
                flow = dh * (1 - z) + u.T @ du
                order = np.argsort(x[t], kind="stable")
                codes = x[t][order]
                starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
                ge[:, codes[starts]] += np.add.reduceat(dg[:, order], starts, axis=1)
            grad["E" + d], grad["U" + d] = ge, gu
        return loss, grad

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = 192, rate: float = 0.02, seed: int = 6) -> float:
        """Adam over windows x (N, T) with labels y, drawn with equal weight by label. Returns the last loss."""
        rng = np.random.default_rng(seed)
        share = 1 / np.bincount(y)[y]
        share /= share.sum()
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.w.items()}
        loss = 0.0
        for step in range(1, steps + 1):
            own = rng.choice(len(x), batch, p=share)
            xt = np.ascontiguousarray(x[own].T)
            loss, grad = self.gradients(xt, y[own], LETTER[xt].astype(np.float32))
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grad.items():
                g = g * min(1.0, 1 / (norm + 1e-9))
                m[k] += 0.1 * (g - m[k])
                v2[k] += 0.01 * (g * g - v2[k])
                self.w[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return loss


def windows(data: bytes, window: int = WINDOW) -> np.ndarray:
    """(n, window) bytes; the last row is filled up with spaces."""
    n = -(-len(data) // window)
    out = np.full(n * window, 32, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, window)


def prepare(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace")


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def document_probabilities(net: BiGRU, labels: int, texts: list[str | None], chunk: int = 4096) -> np.ndarray:
    """(documents, labels), each the mean over the letter positions of the whole text."""
    total, letters = np.zeros((len(texts), labels)), np.zeros(len(texts))
    rows: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if not rows:
            return
        x, own = np.concatenate(rows), np.concatenate(owner)
        for s in range(0, len(x), chunk):
            xt = np.ascontiguousarray(x[s : s + chunk].T)
            mask = LETTER[xt].astype(np.float32)
            p = np.einsum("tlb,tb->bl", net.probabilities(xt), mask)
            for k in range(labels):
                total[:, k] += np.bincount(own[s : s + chunk], p[:, k], len(texts))
            letters[:] += np.bincount(own[s : s + chunk], mask.sum(axis=0), len(texts))
        rows.clear()
        owner.clear()
        held = 0

    for i, t in enumerate(texts):
        w = windows(prepare(t))
        for s in range(0, len(w), chunk):
            rows.append(w[s : s + chunk])
            owner.append(np.full(len(rows[-1]), i))
            held += len(rows[-1])
            if held >= chunk:
                flush()
    flush()
    return total / np.maximum(letters, 1)[:, None]


def training_sample(docs: DataFrame, modulus: int = 5, held_out: int = 0, rows: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """At most `rows` (text, lang) of texts up to `chars` characters whose crc32(doc_id) mod `modulus` is not `held_out`,
    by hashed id; about equally many of each of the languages (the `rows` most frequent), as far as there are."""
    usable = docs.filter("text is not null and lang is not null and doc_id is not null").filter(F.length("text") <= chars).filter(crc_mod(F.col("doc_id"), modulus) != held_out)
    langs = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(rows).collect()
    if not langs:
        return []
    each = max(1, rows // len(langs))
    # A threshold on the hashed id that about `each` rows of a language pass; the exact cut comes after it.
    share = F.create_map(*[F.lit(v) for r in langs for v in (r.lang, min(1.0, 2 * each / r["count"] + 20 / r["count"]))])
    unit = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) / (1 << 30)
    some = usable.filter(unit < share[F.col("lang")]).select("doc_id", "lang", "text")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*stable_order("doc_id"), "text"))
    return [(r.text, r.lang) for r in some.withColumn("n", rank).filter(F.col("n") <= each).orderBy("lang", "n").limit(rows).collect()]


def train_language_model(sample: list[tuple[str, str]], hidden: int = HIDDEN, window: int = WINDOW, windows_per_doc: int = 8, steps: int = STEPS) -> tuple[BiGRU | None, list[str]]:
    """The network and its labels, sorted; no network for an empty sample."""
    labels = sorted({lang for _, lang in sample})
    xs, ys = [], []
    for text, lang in sample:
        w = windows(prepare(text), window)
        w = w[LETTER[w].sum(axis=1) >= window // 3]
        if len(w):
            w = w[np.unique(np.linspace(0, len(w) - 1, windows_per_doc).astype(int))]
            xs.append(w)
            ys.append(np.full(len(w), labels.index(lang)))
    if not labels:
        return None, []
    net = BiGRU(len(labels), hidden)
    if xs:
        net.fit(np.concatenate(xs), np.concatenate(ys), steps)
    return net, labels


def identify(docs: DataFrame, net: BiGRU | None, labels: list[str]) -> DataFrame:
    """`doc_id`, `lang_pred`, `score` for every row of `docs` (doc_id, text).

    A null text, one without a letter, and any text where nothing could be learned are `und` with score 0; repeated rows
    get equal results; an empty table gives an empty result; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 1000):
                part = b.slice(s, 1000)
                texts = part.column(1).to_pylist()
                known = [bool(t) and net is not None and has_letter(t) for t in texts]
                p = document_probabilities(net, len(labels), [t if k else None for t, k in zip(texts, known)]) if any(known) else np.zeros((len(texts), 1))
                best = p.argmax(axis=1)
                names = [labels[k] if ok else UND for k, ok in zip(best, known)]
                score = [min(1.0, float(p[i, k])) if ok else 0.0 for i, (k, ok) in enumerate(zip(best, known))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return in_batches(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))).mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def op2_byte_gru(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net, labels = train_language_model(training_sample(docs))
    return identify(docs, net, labels).select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")

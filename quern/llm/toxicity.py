"""Toxicity by a lexicon, its misspellings and its contexts.

The lexicon, whole terms and stems of inflected ones, is learned from a bounded labelled sample. A trie of it is
intersected with the Levenshtein automata of its terms by lazy determinisation: a state is a set of (trie node, edits),
a text's words walk it one character at a time, and most die within a few. Hits are weighed by edits, by what the sample
says about the term, and by the window around them (quoted or reported terms count less, addressed ones more); a
logistic model turns a document's hits into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import crc_mod, in_batches, sigmoid, table
from quern.llm.labelled import labelled_ids, labelled_rows

PER_CLASS = 3000
TERMS = 400
CACHE_WORDS = 200_000
WORD = re.compile(r"\w+")
QUOTED = re.compile(r'"[^"\n]{1,300}"|“[^”\n]{1,300}”|„[^“”\n]{1,300}[“”]|«[^»\n]{1,300}»|‘[^’\n]{1,300}’|(?m:^[ \t]*>.*$)')
REPORTING = frozenset("said says say called calls call quote quoted quotes quoting wrote writes word words term terms phrase slur insult insults insulting dit disait mot terme sagte sagt wort begriff dijo dice palabra término".split())
ADDRESSING = frozenset("you your you're u ur du dich dir dein deine ihr euch sie tu te toi ton vous votre tú ti usted ustedes vosotros".split())
NEAR = 5


class LexiconAutomaton:
    """Finds, for a word, the lexicon entry it spells with the fewest edits (insert, delete, replace).

    `entries` maps a term to (open, edits): an open term is a stem, any ending may follow it; at most `edits` edits.
    """

    def __init__(self, entries: dict[str, tuple[bool, int]]):
        self.next: list[dict[str, int]] = [{}]
        self.terms: list[list[tuple[str, bool, int]]] = [[]]
        self.most: list[int] = [0]  # edits that some term below may have
        for term, (open_, edits) in sorted(entries.items()):
            node = 0
            self.most[0] = max(self.most[0], edits)
            for c in term:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.terms.append([])
                    self.most.append(0)
                node = self.next[node][c]
                self.most[node] = max(self.most[node], edits)
            self.terms[node].append((term, open_, edits))
        self.states: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.content: list[frozenset] = []
        self.found: list[tuple[int, str] | None] = []
        self.start = self._state({(0, 0, "")})

    def _state(self, items: set[tuple[int, int, str]]) -> int:
        """Number of the state with these (node, edits, stem already matched), closed under skipped term characters."""
        best: dict[tuple[int, str], int] = {}
        todo = list(items)
        while todo:
            node, e, stem = todo.pop()
            if (node, stem) in best and best[node, stem] <= e:
                continue
            best[node, stem] = e
            if node >= 0:
                for child in self.next[node].values():
                    if e + 1 <= self.most[child]:
                        todo.append((child, e + 1, ""))
                for term, open_, edits in self.terms[node]:
                    if open_ and e <= edits:
                        todo.append((-1, e, term))
        key = frozenset((n, e, s) for (n, s), e in best.items())
        if key not in self.states:
            self.states[key] = len(self.moves)
            self.moves.append({})
            self.content.append(key)
            ends = [(e, s) for n, e, s in key if n < 0] + [(e, t) for n, e, _ in key if n >= 0 for t, _, edits in self.terms[n] if e <= edits]
            self.found.append(min(ends) if ends else None)
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        items = set()
        for node, e, stem in self.content[state]:
            if node < 0:
                items.add((node, e, stem))
                continue
            for d, child in self.next[node].items():
                if e + (d != c) <= self.most[child]:
                    items.add((child, e + (d != c), ""))
            if e + 1 <= self.most[node]:
                items.add((node, e + 1, ""))
        to = self._state(items) if items else -1
        self.moves[state][c] = to
        return to

    def find(self, word: str) -> tuple[int, str] | None:
        """(edits, term), the least, or None."""
        if len(self.moves) > 20_000:  # the determinised part is a cache
            self.states, self.moves, self.content, self.found = {}, [], [], []
            self.start = self._state({(0, 0, "")})
        state = self.start
        for c in word:
            to = self.moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state < 0:
                return None
        return self.found[state]


def learn_lexicon(sample: list[tuple[str, int]], terms: int = TERMS, least_docs: int = 4, least_share: float = 0.02, least_ratio: float = 30.0) -> dict[str, tuple[bool, int, float]]:
    """term -> (is a stem, edits allowed, weight), from (text, label) rows.

    Candidates are the words of the toxic texts and their beginnings of four characters and more, by the ratio of the
    shares of toxic and other texts that hold them; a term of fewer than `least_docs` toxic texts, or of less than
    `least_share` of them, is chance. Of a chain of beginnings the longest that keeps nine tenths of the
    texts of the chain's first stands for it. A term may be misspelled if its misspellings are rare in the other texts.
    """
    n = [0, 0]
    seen: list[Counter] = [Counter(), Counter()]
    words: list[Counter] = [Counter(), Counter()]
    for text, label in sample:
        n[label] += 1
        own = {w for w in WORD.findall(text.lower()) if len(w) >= 3}
        words[label].update(own)
        seen[label].update({w[:k] for w in own for k in range(4, min(len(w), 14) + 1)} | {w for w in own if len(w) == 3})
    if not n[0] or not n[1]:
        return {}

    def ratio(term: str) -> float:
        return ((seen[1][term] + 0.5) / (n[1] + 1)) / ((seen[0][term] + 0.5) / (n[0] + 1))

    least = max(least_docs, least_share * n[1])
    good = {t for t, k in seen[1].items() if k >= least and ratio(t) >= least_ratio}
    heads = [t for t in good if not any(t[:k] in good for k in range(3, len(t)))]
    children: dict[str, list[str]] = {}
    for t in good:
        if len(t) > 4:
            children.setdefault(t[:-1], []).append(t)
    chosen = {}
    for head in sorted(heads, key=lambda t: (-seen[1][t], t))[:terms]:
        term = head
        while longer := [t for t in children.get(term, ()) if seen[1][t] >= 0.9 * seen[1][head]]:
            term = max(longer, key=lambda t: (seen[1][t], t))
        open_ = words[1][term] < 0.9 * seen[1][term] or len(term) == 14
        chosen[term] = (open_, math.log(ratio(term)))
    edits = {t: 0 if len(t) < 5 or o and len(t) < 7 else 1 if len(t) < 9 else 2 for t, (o, _) in chosen.items()}
    # Misspellings that the other texts hold as well are words of their own: fewer edits for these terms.
    while True:
        automaton = LexiconAutomaton({t: (chosen[t][0], edits[t]) for t in chosen})
        clean: Counter = Counter()
        for w, k in words[0].items():
            if (hit := automaton.find(w)) and hit[0]:
                clean[hit[1]] += k
        bad = [t for t, k in clean.items() if edits[t] and k > max(1, 0.001 * n[0])]
        if not bad:
            return {t: (o, edits[t], x) for t, (o, x) in chosen.items()}
        for t in bad:
            edits[t] -= 1


class ToxicityModel:
    """Hits of a text and its score."""

    def __init__(self, lexicon: dict[str, tuple[bool, int, float]]):
        self.weight = {t: x for t, (_, _, x) in lexicon.items()}
        self.automaton = LexiconAutomaton({t: (o, e) for t, (o, e, _) in lexicon.items()})
        self.w = np.zeros(4)
        self.cache: dict[str, tuple[int, str] | None] = {}

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def hits(self, text: str) -> tuple[list[tuple[int, int, int, str, float]], int]:
        """[(start, end, edits, term, weight)], and the number of words."""
        cache, low = self.cache, text.lower()
        words = WORD.findall(low)
        if len(cache) > CACHE_WORDS:
            cache.clear()
        for w in set(words).difference(cache):
            cache[w] = self.automaton.find(w)
        if not any(map(cache.__getitem__, words)):
            return [], len(words)
        spans = list(WORD.finditer(low))
        quoted = np.zeros(len(low) + 1, bool)
        for m in QUOTED.finditer(low):
            quoted[m.start() : m.end()] = True
        out = []
        for i, m in enumerate(spans):
            hit = cache[words[i]]
            if hit:
                around = {*words[max(0, i - NEAR) : i], *words[i + 1 : i + 1 + NEAR]}
                told = quoted[m.start()] or not around.isdisjoint(REPORTING)
                context = 0.25 if told else 1.25 if not around.isdisjoint(ADDRESSING) else 1.0
                out.append((m.start(), m.end(), hit[0], hit[1], self.weight[hit[1]] * 0.8 ** hit[0] * context))
        return out, len(words)

    def features(self, text: str | None) -> np.ndarray:
        found, n = self.hits(text or "")
        total = sum(h[4] for h in found)
        return np.array([1.0, math.log1p(total), math.log1p(1000 * total / (n + 30)), math.log1p(len({h[3] for h in found}))])

    def fit(self, sample: list[tuple[str, int]], steps: int = 60) -> "ToxicityModel":
        """Logistic regression by Newton steps with a ridge; both labels count alike."""
        if len({y for _, y in sample}) < 2:
            return self
        x, y = np.array([self.features(t) for t, _ in sample]), np.array([y for _, y in sample], float)
        share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
        for _ in range(steps):
            p = sigmoid(x @ self.w)
            ridge = np.diag([1e-4] * 4)
            h = (x * (share * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + ridge
            self.w += np.clip(np.linalg.solve(h, x.T @ (share * (y - p)) - ridge @ self.w), -1, 1)
        return self

    def score(self, text: str | None) -> float:
        return float(sigmoid(self.features(text) @ self.w))


def train_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, per_class: int = PER_CLASS) -> ToxicityModel:
    """Fitted on at most `per_class` texts of each label outside the fold `held_out`; without both labels every score is 0.5."""
    rows = labelled_rows(docs.select("doc_id", "text").filter("text is not null"), labelled_ids(labels, "toxic", modulus, held_out, per_class))
    sample = [(r.text, r.label) for r in rows]
    return ToxicityModel(learn_lexicon(sample)).fit(sample)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """`doc_id`, `score`, `predicted`, `n_terms` (distinct terms) for every row of `docs` (doc_id, text).

    A null or empty text has no hits and the score of that; repeated rows get equal scores; an empty table gives an
    empty result; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.zeros((b.num_rows, 4))
            hits = np.zeros(b.num_rows, np.int32)
            for i, t in enumerate(b.column(1)):
                x[i] = model.features(t.as_py())
            hits[:] = np.rint(np.expm1(x[:, 3]))
            s = sigmoid(x @ model.w)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(hits)], names=["doc_id", "score", "predicted", "n_terms"])

    return in_batches(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))).mapInArrow(run, "doc_id bigint, score double, predicted int, n_terms int")


def op10_levenshtein_trie(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score_toxicity(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted", "n_terms")

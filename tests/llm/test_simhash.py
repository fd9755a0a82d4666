import random
import re

import numpy as np
import pytest
import xxhash
from conftest_odd import ODD

import corpus_pipeline
from quern.llm.components import connected_components
from quern.llm.simhash import (
    GrayIndex, _forest, _tree, fingerprint_bytes, index_pairs, keep_first_of_near_copies, near_copies, near_pairs, op9_simhash_gray, pigeonhole_masks, simhash_components, word_shingles,
)


def plain_fingerprint(text, width=4):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_components(ids, prints, radius=4):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(prints))]


def test_fingerprint():
    for t in [*ODD, "a b c d", "A b C d e f G a b c d e", "wort " * 1000, "ÀB àb c d e"]:
        assert int.from_bytes(fingerprint_bytes(t, 4), "big") == plain_fingerprint(t)


def test_query_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    prints = [plain_fingerprint(r.text) for r in docs]
    want = {(d.doc_id, f"{p:016x}", c) for d, p, c in zip(docs, prints, plain_components([d.doc_id for d in docs], prints))}
    assert {tuple(r) for r in op9_simhash_gray(spark, small).collect()} == want


@pytest.mark.parametrize("group_rows", [4096, 40])
def test_near_pairs_in_a_hot_ball(spark, group_rows):
    rng = random.Random(7)
    center = rng.getrandbits(64)
    prints = {center ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 9))) for _ in range(400)} | {rng.getrandbits(64) for _ in range(200)}
    prints = sorted(prints)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp bigint")
    got = {r.node % (1 << 64): r.root % (1 << 64) for r in connected_components(near_pairs(df, 4, group_rows)).collect()}
    want = plain_components(range(len(prints)), prints)
    groups = {}
    for p, c in zip(prints, want):
        groups.setdefault(c, set()).add(got.get(p, p))
    assert all(len(g) == 1 for g in groups.values()) and len({g.pop() for g in groups.values()}) == len(set(want))


def test_index_against_all_pairs():
    rng = np.random.default_rng(1)
    fp = np.unique(rng.integers(0, 1 << 63, 3, dtype=np.uint64)[rng.integers(0, 3, 700)] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (700, 5)).astype(np.uint64), axis=1))
    gray = fp.copy()
    for k in (1, 2, 4, 8, 16, 32):
        gray ^= gray >> np.uint64(k)
    fp = fp[np.argsort(gray)]
    x, y = index_pairs(i := GrayIndex(fp), i, 4)
    want = np.argwhere(np.triu(np.bitwise_count(fp[:, None] ^ fp[None]) <= 4, 1))
    assert {*zip(x.tolist(), y.tolist())} == {*map(tuple, want.tolist())}
    x, y = index_pairs(GrayIndex(fp[::2]), GrayIndex(fp[1::2]), 4)
    want = np.argwhere(np.bitwise_count(fp[::2, None] ^ fp[None, 1::2]) <= 4)
    assert {*zip(x.tolist(), y.tolist())} == {*map(tuple, want.tolist())}


def test_masks_cover_every_near_pair():
    rng = random.Random(3)
    for rows in (10, 10**6, 10**8, 10**10):
        masks = [m % (1 << 64) for m in pigeonhole_masks(rows, 4)]
        for _ in range(500):
            d = sum(1 << k for k in rng.sample(range(64), 4))
            assert any(d & m == 0 for m in masks)


def test_odd_rows(spark, docs_of):
    docs = docs_of([*ODD, (None, "one"), (3, "one"), (None, "alone in its component")]).selectExpr("*", "1 as fp", "2 as u", "'x' as component_id")
    rows = simhash_components(docs).collect()
    ids = [r.doc_id for r in docs.collect()]
    prints = [plain_fingerprint(r.text) for r in docs.collect()]
    want = sorted(map(str, zip(ids, plain_components(ids, prints))))
    assert sorted(str((r.doc_id, r.component_id)) for r in rows) == want
    assert simhash_components(docs_of([])).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 199), (199, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 160)}, 200: 199}


def test_near_copies_share_five_word_shingles(spark, docs_of):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrst", k=rng.randint(3, 8)))
    texts, base_of = [], {}
    for k in range(40):
        base = [word() for _ in range(300)]
        base_of[len(texts)] = k
        texts.append(base)
        for edits in (1, 2, 3, 40):
            copy = list(base)
            for i in rng.sample(range(300), edits):
                copy[i] = word()
            base_of[len(texts)] = k if edits < 40 else -1 - k
            texts.append(copy)
    lines = [" ".join(t) for t in texts] + [" ".join(texts[0]).upper() + " ", None, "", None]
    sets = [word_shingles(t, 5) for t in lines]
    got = {r.doc_id: r.component_id for r in near_copies(docs_of(lines)).collect()}
    assert got[200] == 0 and got[201] == got[202] == got[203] == 201
    close = [(i, j) for i in range(200) for j in range(i) if base_of[i] == base_of[j]]
    assert all(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for i, j in close if j % 5 == 0)
    prints = [int.from_bytes(fingerprint_bytes(t, 5), "big") for t in lines]
    near = np.array([(i, j) for i in range(200) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 7 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    assert [got[i] for i in range(200)] == _forest(200, near[:, 0], near[:, 1]).tolist()
    # what seven of 64 bits can tell of copies of a similarity of 0.9 and more
    assert np.mean([got[i] == got[j] for i, j in close if j % 5 == 0]) >= 0.75
    assert all(got[i] == i for i in range(200) if base_of[i] < 0)  # 40 edits: a similarity of a third
    kept = {r.doc_id for r in keep_first_of_near_copies(docs_of(lines)).collect()}
    assert kept == {i for i, c in got.items() if i == c}


def test_a_tree_of_links_spans_them():
    rng = np.random.default_rng(2)
    for n, m in ((1, 0), (2, 1), (50, 30), (50, 400), (300, 280)):
        x, y = rng.integers(0, n, (2, m))
        x, y = x[x != y], y[x != y]
        a, b = _tree(n, x, y)
        assert (_forest(n, a, b) == _forest(n, x, y)).all() and len(a) == n - len(set(_forest(n, x, y))) and {*zip(a, b)} <= {*zip(x, y)}


def test_no_pair_of_near_copies_is_left_out(spark, docs_of):
    """However far the fingerprints are, and whichever pair of a tree of links fails."""
    rng = random.Random(15)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrst", k=rng.randint(3, 8)))
    texts = []
    for n in (300, 120, 40, 12, 4) * 6:
        base = [word() for _ in range(n)]
        texts.append(base)
        for edits in (1, 2, 4, 6, 8):
            copy = list(texts[-1])
            for i in rng.sample(range(n), min(edits, 1 + n // 50)):
                copy[i] = word()
            texts.append(copy)
    lines = [" ".join(t) for t in texts]
    sets = [word_shingles(t, 5) for t in lines]
    prints = [int.from_bytes(fingerprint_bytes(t, 5), "big") for t in lines]
    alike = np.array([(i, j) for i in range(len(lines)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9])
    bits = np.array([(prints[i] ^ prints[j]).bit_count() for i, j in alike])
    assert (bits > 7).sum() > 20 and (bits <= 7).sum() > 20
    for every, own in ((True, alike), (False, alike[bits <= 7])):
        got = {r.doc_id: r.component_id for r in near_copies(docs_of(lines), every=every).collect()}
        assert [got[i] for i in range(len(lines))] == _forest(len(lines), own[:, 0], own[:, 1]).tolist()
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs_of(lines), "").collect()}
    assert kept == set(_forest(len(lines), alike[:, 0], alike[:, 1]).tolist())
    got = near_copies(docs_of([(1, lines[0]), (1, lines[6]), (2, lines[6]), (3, lines[0]), (None, lines[0])]), every=True).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1)}

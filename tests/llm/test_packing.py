import random
import zlib

import numpy as np
import public_tokenizers
from conftest_odd import ODD
from tokenizers import Tokenizer

from quern.llm.packing import ChunkEncoder, best_fit, op4_swap_packing, pack, pack_documents, swap_search

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, texts, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    by_doc, bins = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    for i, t in texts.items():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        parts = sorted(by_doc.pop(i), key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(-(-len(ids) // capacity)))
        for r in parts:
            own = ids[r.start : r.start + r.length]
            assert r.start == r.piece * capacity and len(own) == r.length and (r.length == capacity or r is parts[-1])
            assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
    assert not by_doc
    for b in bins.values():
        end = 0
        for r in sorted(b, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= capacity
    return len(bins)


def test_query_round_trip(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = op4_swap_packing(spark, small).collect()
    assert check(rows, texts, 4096) == -(-sum(r.length for r in rows) // 4096)


def test_odd_rows(spark, docs_of):
    texts = [*ODD, "It's  don't I'LL 've 's'", "<|endoftext|> a <|startoftext|>", "<|other|>", "İstanbul ﬁ Å é", "１２3 ½ ²", "a b c\u0085d", "ß ẞ ǅ Σς"]
    docs = docs_of(texts).selectExpr("*", "1 as piece", "'a' as packing_group")
    check(pack_documents(docs, PATH, 64).collect(), dict(enumerate(texts)), 64)
    assert pack_documents(docs_of([]), PATH).count() == 0
    twice = pack_documents(docs_of([(1, "same"), (1, "same"), (None, "x")]), PATH).collect()
    assert len(twice) == 3 and len({r.offset for r in twice}) == 3


def test_swaps_empty_a_bin_that_best_fit_needs():
    lengths = np.array([6, 5, 5, 4, 4, 3, 3])  # best fit by falling length: 6+4, 5+5, 4+3+3
    assert len(best_fit(lengths, 10)) == 3
    start = [[0, 5], [1, 3], [2, 4], [6]]  # 9, 9, 9, 3 of 10
    out = swap_search(start, lengths, 10)
    assert sorted(i for b in out for i in b) == list(range(7)) and all(lengths[b].sum() <= 10 for b in out) and len(out) == 3


def test_random_packings_hold_all_and_are_near_the_bound():
    rng = np.random.default_rng(2)
    for high in (30, 60, 100):
        lengths = rng.integers(1, high + 1, 800)
        bin_of, offset = pack(lengths, 100)
        fill = np.bincount(bin_of, lengths)
        assert fill.max() <= 100 and len(fill) <= np.ceil(lengths.sum() / 100) * (1.001 if high < 100 else 1.06) + 1
        for b in range(len(fill)):
            own = np.flatnonzero(bin_of == b)
            own = own[np.argsort(offset[own])]
            assert (offset[own] == np.cumsum(lengths[own]) - lengths[own]).all()
    assert pack(np.zeros(0, np.int64), 10)[0].size == 0


def test_encoder_gives_the_tokenizer_s_ids_for_texts_of_any_script():
    rng = random.Random(1)
    pool = "abcDEFé ß'İıſK 0123९²½ .,!?-_’“” \t\n\xa0　​你好のはп́̈😀ﬁǅ𝒜\x00\x7f\x85'S'tI'm"
    char = lambda: rng.choice(pool) if rng.random() < 0.9 else chr(rng.choice([rng.randrange(0x20, 0xD800), rng.randrange(0xE000, 0x20000)]))
    texts = ["".join(char() for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["<|endoftext|> a", "a\x1cb", ""]
    tokenizer, encoder = Tokenizer.from_file(PATH), ChunkEncoder(PATH, 3000)
    for s in range(0, len(texts), 500):
        want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts[s : s + 500]]
        assert encoder.encode(texts[s : s + 500]) == want

"""Packing documents into fixed-length token sequences: best fit, then local search by swaps.

Tokens are counted where the text is read and only narrow rows are shuffled. Pieces go to packing groups by hash; a
group is packed on its own, so no task holds more than about `group_pieces` pieces. Local search looks for what takes the
place of one document of the emptiest bin, or of two of its `LONGEST` longest ones; it may end above the least number of
sequences.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut, in_batches, table

CAPACITY = 4096
GROUP_PIECES = 60_000
#: Characters that are encoded together.
SLICE_CHARS = 12_000_000
#: Documents of a bin that are tried in pairs, the longest ones.
LONGEST = 40
#: Chunks that a worker keeps, some 200 bytes each.
CACHE_CHUNKS = 700_000


class ChunkEncoder:
    """Ids of a tokenizer that never looks across white space, from a cache of the chunks between it.

    `word_bpe_49k.json` normalises (NFC, white space to one space, lower case), splits by its pattern and then merges
    inside each piece, so a text's ids are its chunks' ids in a row. The distinct chunks of some megabytes of text are looked
    up, new ones are encoded together, and their ids are told apart by the tokens that end a piece. Texts with a
    special string, or with control characters that count as white space here but not there, go to the tokenizer itself.
    The cache keeps the first `cache_chunks` chunks, its ids in one array.
    """

    PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    PIECES = regex.compile(PIECE)
    #: What counts as a letter or a number elsewhere depends on the version of Unicode, and the lower case of U+0130 is two.
    KNOWN = re.compile(r"[\x21-\x7e\u00a0-\u012f\u0131-\u024f\u0300-\u052f\u05d0-\u05ea\u0600-\u06ff\u0900-\u097f\u0e00-\u0e7f\u2010-\u2027\u20a0-\u20bf\u3040-\u30ff\u4e00-\u9fa5\uac00-\ud7a3]+")
    own: dict[str, "ChunkEncoder"] = {}

    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.limit = cache_chunks
        #: Number of a chunk; ids of all in a row, where each begins and how many it has. The empty chunk has none.
        self.cache: dict[str, int] = {"": 0}
        self.flat, self.starts, self.sizes = np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(1, np.int64)

    @classmethod
    def of(cls, path: str, cache_chunks: int) -> "ChunkEncoder":
        """One for each Python worker, kept between its tasks."""
        if path not in cls.own or cls.own[path].limit != cache_chunks:
            cls.own[path] = cls(path, cache_chunks)
        return cls.own[path]

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _new(self, chunks: list[str], known: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks in a row, and how many each has. Those from `known` on are encoded one by one."""
        flat, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for s in range(0, known, 5000):
            part = chunks[s : min(s + 5000, known)]
            array = pa.array(part, pa.string())
            pieces = pc.count_substring_regex(pc.ascii_lower(array), self.PIECE).to_numpy(zero_copy_only=False).astype(np.int64)
            for i in np.flatnonzero(~pc.string_is_ascii(array).to_numpy(zero_copy_only=False)).tolist():
                pieces[i] = len(self.PIECES.findall(unicodedata.normalize("NFC", part[i]).lower()))
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == pieces.sum() and (pieces > 0).all():
                flat.append(ids)
                sizes.append(np.diff(ends[np.cumsum(pieces) - 1], prepend=0))
            else:
                own = [self._ids(c) for c in part]
                flat += own
                sizes.append(np.fromiter(map(len, own), np.int64, len(own)))
        own = [self._ids(c) for c in chunks[known:]]
        return np.concatenate(flat + own), np.concatenate([*sizes, np.fromiter(map(len, own), np.int64, len(own))])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):  # texts of some megabytes together, or one
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) <= SLICE_CHARS:
                size += len(texts[end])
                end += 1
            out += self._encode(texts[at:end])
            at = end
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        odd = ["<|" in t or "\x1c" in t or "\x1d" in t or "\x1e" in t or "\x1f" in t for t in texts]
        words = pc.utf8_split_whitespace(pa.array(["" if o else t for t, o in zip(texts, odd)], pa.large_string()))
        found = words.values.dictionary_encode()
        flat, starts, sizes = self._looked_up(found.dictionary.to_pylist())
        codes = found.indices.to_numpy()
        n = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(n)])
        tokens = flat[np.repeat(starts[codes] - ends[:-1], n) + np.arange(ends[-1])]
        stops = ends[words.offsets.to_numpy()].tolist()
        return [(self._ids(t) if o else tokens[a:b]).tobytes() for t, o, a, b in zip(texts, odd, stops, stops[1:])]

    def _looked_up(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids in a row, and where in it those of each chunk begin and how many they are."""
        at = np.fromiter(map(self.cache.get, chunks, repeat(-1)), np.int64, len(chunks))
        new = np.flatnonzero(at < 0)
        known = np.fromiter((chunks[i].isascii() or self.KNOWN.fullmatch(chunks[i]) is not None for i in new.tolist()), bool, len(new))
        new = np.concatenate([new[known], new[~known]])
        fresh = [chunks[i] for i in new.tolist()]
        own, own_sizes = self._new(fresh, int(known.sum()))
        sizes, starts = self.sizes[at], self.starts[at]
        sizes[new] = own_sizes
        starts[new] = len(self.flat) + np.cumsum(own_sizes) - own_sizes
        flat = np.concatenate([self.flat, own])
        if kept := fresh[: max(0, self.limit - len(self.cache))]:
            self.cache.update(zip(kept, range(len(self.cache), len(self.cache) + len(kept))))
            self.starts, self.sizes = np.concatenate([self.starts, starts[new[: len(kept)]]]), np.concatenate([self.sizes, own_sizes[: len(kept)]])
            self.flat = flat[: len(self.flat) + own_sizes[: len(kept)].sum()].copy()
        return flat, starts, sizes


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 1, cache_chunks: int = CACHE_CHUNKS, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the ids of each text and `end_id`, cut at every `capacity` ids.

    A null text counts as empty, its one piece is the end id alone.
    """

    end, width = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def cut_up(encoder: ChunkEncoder, ids: list, texts: list[str]) -> pa.RecordBatch:
        rows: list[list] = [[], [], [], [], []]
        for doc_id, tokens in zip(ids, encoder.encode(texts)):
            tokens += end
            for piece, at in enumerate(range(0, len(tokens), width)):
                part = tokens[at : at + width]
                for column, value in zip(rows, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part) & 0xFFFFFFFF)):
                    column.append(value)
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder.of(tokenizer_path, cache_chunks)
        ids, texts, size = [], [], 0
        for b in batches:
            ids += b.column(0).to_pylist()
            new = [t or "" for t in b.column(1).to_pylist()]
            texts += new
            size += sum(map(len, new))
            if size >= slice_chars:
                yield cut_up(encoder, ids, texts)
                ids, texts, size = [], [], 0
        if ids:
            yield cut_up(encoder, ids, texts)

    return in_batches(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))).mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: items by falling length, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a bin with room r is there
    for item in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[item])
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[at].append(item)
        else:
            room, at = capacity, len(bins)
            bins.append([item])
        if left := room - n:
            by_room[left].append(at)
            rooms |= 1 << left
    return bins


def swap_search(bins: list[list[int]], lengths: np.ndarray, capacity: int, tries: int = 2000) -> list[list[int]]:
    """Empties bins by moves, one-for-one and two-for-one exchanges between underfull bins.

    The emptiest bin gives: a move takes a document out of it, an exchange takes a longer one (or two) against a shorter
    one. Either raises the sum of squared fills, so the search ends; it stops where the bins are as few as the total
    needs, or after `tries` bins that could give nothing.
    """
    fill = np.array([int(lengths[b].sum()) for b in bins], np.int64)
    least = -(-int(lengths.sum()) // capacity)
    items = np.array([i for b in bins for i in b], np.int64)
    home = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
    size = lengths[items]
    alive, stuck = len(bins), np.zeros(len(bins), bool)
    while alive > least and tries > 0:
        open_ = np.flatnonzero((fill < capacity) & (fill > 0) & ~stuck)
        if len(open_) < 2:
            break
        giver = open_[np.argmin(fill[open_])]
        room = capacity - fill
        room[(fill == 0) | (np.arange(len(fill)) == giver)] = 0
        own = np.flatnonzero(home == giver)
        own = own[np.argsort(-size[own], kind="stable")]
        done = False
        for i in own:  # move
            fitting = np.flatnonzero((room >= size[i]) & (fill + size[i] > fill[giver]))
            if len(fitting):
                to = fitting[np.argmin(room[fitting])]
                home[i] = to
                fill[to] += size[i]
                fill[giver] -= size[i]
                done = True
                break
        if not done:
            others = np.flatnonzero(room[home] > 0)
            gives = [[i] for i in own] + [[i, j] for k, i in enumerate(own[:LONGEST]) for j in own[k + 1 : LONGEST]]
            best, choice = 0, None
            for give in gives:
                gain = int(size[give].sum()) - size[others]
                # raises the squares: the taker ends fuller than the giver was
                good = (gain > best) & (gain <= room[home[others]]) & (fill[home[others]] + gain > fill[giver])
                if good.any():
                    k = np.argmax(np.where(good, gain, 0))
                    best, choice = int(gain[k]), (give, others[k])
            if choice:
                give, take = choice
                to = home[take]
                home[give], home[take] = to, giver
                fill[to] += best
                fill[giver] -= best
                done = True
        if not done:
            stuck[giver] = True
            tries -= 1
        else:
            stuck[:] = False  # what could give nothing may now
            alive -= fill[giver] == 0
    order = np.argsort(home, kind="stable")
    return [b.tolist() for b in np.split(items[order], np.flatnonzero(np.diff(home[order])) + 1)] if len(items) else []


def pack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item."""
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    full = np.flatnonzero(lengths >= capacity)
    bin_of[full] = np.arange(len(full))
    rest = np.flatnonzero(lengths < capacity)
    own = lengths[rest]
    for k, items in enumerate(swap_search(best_fit(own, capacity), own, capacity) if len(rest) else []):
        at = rest[items]
        bin_of[at] = len(full) + k
        offset[at] = np.cumsum(lengths[at]) - lengths[at]
    return bin_of, offset


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 1, group_pieces: int = GROUP_PIECES, cache_chunks: int = CACHE_CHUNKS, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row of `docs` is packed, repeated rows and rows with a null doc_id each on their own; a null or empty text is
    the end id alone; an empty table gives an empty result; columns other than doc_id and text are not looked at.
    """
    pieces = cut(token_pieces(docs, tokenizer_path, capacity, end_id, cache_chunks, slice_chars))
    groups = max(1, -(-pieces.count() // group_pieces))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "ids_crc32", "doc_id", "piece"], kind="stable", ignore_index=True)
        bin_of, offset = pack(rows["length"].to_numpy(), capacity)
        return rows.assign(sequence_id=rows["packing_group"].to_numpy() * (1 << 32) + bin_of, offset=offset)[columns]

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    grouped = pieces.withColumn("packing_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    return grouped.groupBy("packing_group").applyInPandas(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def op4_swap_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

"""Benchmark decontamination by spaced-seed hashing (operator 8).

Texts are words of letters and digits in lower case. A mask picks some of the words of a window and ignores the others;
the hash of the picked ones is looked up among the seeds of all benchmark items. Around a hit the whole diagonal (item and
text laid over each other at that shift) is compared, and the longest stretch with at least IDENTITY equal words counts.
A text overlaps an item if such a stretch has LEAST equal words, or if the stretches on all diagonals together hold
COVER of the item's words (short items, insertions and deletions). An item under SHORTEST words overlaps only a text that
has the same words and no others.

The two masks for items of LEAST words or more meet every stretch that the rule accepts on one diagonal, and the two
for shorter ones meet every item of SHORTEST words or more with IDENTITY equal words. Benchmarks are taken in blocks of
BLOCK words, each one pass over the texts, so what a task holds of them is bounded at any size.

Edge cases: NULL or empty texts and items overlap nothing; items with the same words are
compared once and each is returned; repeated rows are each compared; NULL ids are returned as NULL; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.common import LOWER, mixed, pieces, word_hashes, word_spans

LEAST, IDENTITY, COVER, SHORTEST = 13, 0.8, 0.8, 5
MASKS, SHORT_MASKS = ("111011", "11111"), ("111", "11011")
BLOCK = 2_000_000  # benchmark words that a task holds at a time
_PART = (np.arange(256) >= 128) | np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123)])
_CLEAN = np.where(_PART, LOWER, 32).astype(np.uint8)


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word of the texts."""
    data = _CLEAN[data]
    row, begin, end = word_spans(data, at)
    return row, word_hashes(data, begin, end)


def _seeds(code: np.ndarray, owner: np.ndarray, mask: str, salt: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every window that lies in one text; `known`: only those whose picked words all are."""
    n = len(code) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    picked = [i for i, c in enumerate(mask) if c == "1"]
    ok = owner[:n] == owner[len(mask) - 1 :]
    if known is not None:
        for i in picked:
            ok &= known[i : i + n]
    at = np.flatnonzero(ok)
    h = np.full(len(at), salt, np.uint64)
    for i in picked:
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + code[at + i])
    return at, h


def _whole(code: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash of all its words) of the texts that have some words, but under SHORTEST."""
    some = np.flatnonzero((words > 0) & (words < SHORTEST))
    first = (np.cumsum(words) - words)[some]
    h = words[some].astype(np.uint64)
    for k in range(SHORTEST - 1):
        inside = words[some] > k
        step = code[np.where(inside, first + k, 0)] if len(code) else h
        h = np.where(inside, mixed(h * np.uint64(0x9E3779B97F4A7C15) + step), h)
    return some, h


class Index:
    """Seeds of a block of items: (hash, first word) sorted by hash, the words, and the item of each word."""

    def __init__(self, data: np.ndarray, at: np.ndarray) -> None:
        self.item, self.code = tokens(data, at)
        self.words = np.bincount(self.item, minlength=len(at) - 1)
        self.first = np.concatenate([[0], np.cumsum(self.words)[:-1]])
        self.vocabulary = np.unique(self.code)
        short, h = _whole(self.code, self.words)
        order = np.argsort(h, kind="stable")
        self.short, self.short_hash = short[order], h[order]
        self.seeds = []
        for salt, (masks, long_) in enumerate(((MASKS, True), (SHORT_MASKS, False))):
            use = ((self.words >= LEAST) == long_) & (self.words >= SHORTEST)
            for k, mask in enumerate(masks):
                where, h = _seeds(self.code, self.item, mask, 2 * salt + k)
                mine = use[self.item[where]]
                order = np.argsort(h[mine], kind="stable")
                self.seeds.append((mask, 2 * salt + k, h[mine][order], where[mine][order]))

    def diagonals(self, row: np.ndarray, code: np.ndarray) -> np.ndarray:
        """(item, shift of positions) of every diagonal with a hit, as rows; shift = word of the texts - word of the items."""
        spot = np.minimum(np.searchsorted(self.vocabulary, code), len(self.vocabulary) - 1)
        known = self.vocabulary[spot] == code
        out = []
        for mask, salt, seeds, where in self.seeds:
            at, h = _seeds(code, row, mask, salt, known)
            lo, hi = np.searchsorted(seeds, h, "left"), np.searchsorted(seeds, h, "right")
            n = hi - lo
            pick = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else lo, n) + np.arange(n.sum())
            found = where[pick]
            out.append(np.unique(np.stack([row[np.repeat(at, n)], self.item[found], np.repeat(at, n) - found], 1), axis=0))
        return np.unique(np.concatenate(out), axis=0)


def longest_stretch(equal: np.ndarray, identity: float = IDENTITY) -> tuple[int, int]:
    """Begin and end of the longest run that has at least the share `identity` of equal words."""
    p = np.concatenate([[0.0], np.cumsum(equal - identity)]) + 1e-9 * np.arange(len(equal) + 1)
    best = (0, 0)
    low = np.minimum.accumulate(p)
    high = np.maximum.accumulate(p[::-1])[::-1]
    i = j = 0
    while j < len(p):
        if high[j] >= low[i]:
            if j - i > best[1] - best[0]:
                best = (i, j)
            j += 1
        else:
            i += 1
            j = max(j, i)
    return best


def _stretches(equal: np.ndarray, few: int = SHORTEST) -> list[tuple[int, int]]:
    """Disjoint stretches of `few` equal words or more."""
    out, open_ = [], [(0, len(equal))]
    while open_:
        a, b = open_.pop()
        if equal[a:b].sum() < few:
            continue
        i, j = longest_stretch(equal[a:b])
        i, j = a + i, a + j
        if equal[i:j].sum() >= few:
            out.append((i, j))
            open_ += [(a, i), (j, b)]
    return out


def _few(words: int) -> int:
    """Equal words that make a stretch: SHORTEST, or for the shortest items those that cover them."""
    return min(SHORTEST, int(np.ceil(COVER * words)))


def overlaps(index: Index, data: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(row, item, equal words, first word, end word in the text) of every text and item that overlap."""
    row, code = tokens(data, at)
    if not len(row) or not len(index.code):
        return []
    first = np.searchsorted(row, np.arange(len(at)))
    found: dict[tuple[int, int], list] = {}
    diagonals = index.diagonals(row, code)
    # equal words of each whole diagonal, in blocks: most are chance hits with too few
    for r, i, shift in diagonals.tolist():
        a = max(index.first[i], first[r] - shift)
        b = min(index.first[i] + index.words[i], first[r + 1] - shift)
        equal = index.code[a:b] == code[a + shift : b + shift]
        if equal.sum() >= _few(index.words[i]):
            found.setdefault((r, i), []).append((a, shift, equal))
    out = []
    for (r, i), diagonal in found.items():
        held = np.zeros(index.words[i], bool)
        best, span = 0, []
        if sum(int(e.sum()) for _, _, e in diagonal) < min(LEAST, COVER * index.words[i]):
            continue
        for a, shift, equal in diagonal:
            for x, y in _stretches(equal.astype(np.int64), _few(index.words[i])):
                best = max(best, int(equal[x:y].sum()))
                held[a - index.first[i] + x : a - index.first[i] + y] |= equal[x:y]
                span += [a + shift + x - first[r], a + shift + y - first[r]]
        if best >= LEAST or held.sum() >= COVER * index.words[i]:
            out.append((r, i, int(held.sum()), int(min(span)), int(max(span))))
    some, h = _whole(code, np.bincount(row, minlength=len(at) - 1))
    for r, lo, hi in zip(some.tolist(), np.searchsorted(index.short_hash, h, "left").tolist(), np.searchsorted(index.short_hash, h, "right").tolist(), strict=True):
        out += [(r, i, int(index.words[i]), 0, int(index.words[i])) for i in index.short[lo:hi].tolist()]
    return out


def _find(block: tuple[bytes, np.ndarray, list], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = Index(np.frombuffer(block[0], np.uint8), block[1])
    for batch in batches:
        for first, _, data, at in pieces(batch, "_text"):
            got = [(first + r, block[2][i], n, int(index.words[i]), a, b) for r, i, n, a, b in overlaps(index, data, at)]
            if got:
                cols = list(zip(*got, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("_id").take(pa.array(cols[0], pa.int64())), *[pa.array(c, t) for c, t in zip(cols[1:], (pa.list_(pa.int64()), *[pa.int64()] * 4), strict=True)]], names=["_id", "_items", "words", "item_words", "first_word", "end_word"])


def _clean(block: tuple[bytes, np.ndarray, list], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = Index(np.frombuffer(block[0], np.uint8), block[1])
    for batch in batches:
        left = np.ones(batch.num_rows, bool)
        for first, _, data, at in pieces(batch, "_text"):
            left[[first + r for r, *_ in overlaps(index, data, at)]] = False
        yield batch.filter(pa.array(left))


def blocks_of(benchmark: DataFrame, item_id: str, item_text: str, block: int) -> Iterator[tuple[bytes, np.ndarray, list]]:
    """The items as blocks of about `block` words: texts, offsets, and the ids of each text."""
    items = benchmark.where(F.col(item_text).isNotNull()).groupBy(F.col(item_text).alias("_text")).agg(F.sort_array(F.collect_set(F.col(item_id).cast("long"))).alias("_ids"))
    total = items.agg(F.sum(F.size(F.split("_text", "\\W+")))).first()[0] or 0
    blocks = total // block + 1
    for k in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("_text"), F.lit(blocks)) == k).orderBy("_text").collect()
        texts = [r["_text"].encode() for r in mine]
        yield b"".join(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64), [list(r["_ids"]) for r in mine]


def find(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, words, item_words, first_word, end_word) of every text and benchmark item that overlap.

    words: equal words of the item; first_word, end_word: where in the words of the text.
    """
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    out = [rows.mapInArrow(partial(_find, held), f"_id {kind}, _items array<long>, words long, item_words long, first_word long, end_word long") for held in blocks_of(benchmark, item_id, item_text, block)]
    got = reduce(DataFrame.unionByName, out)
    return got.select(F.col("_id").alias("doc_id"), F.explode_outer("_items").alias("item_id"), "words", "item_words", "first_word", "end_word")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of docs that overlap no benchmark item."""
    rows = docs.select(*[docs[f"`{c}`"].alias(f"_{i}") for i, c in enumerate(docs.columns)], F.col(text).alias("_text"))
    for held in blocks_of(benchmark, item_id, item_text, block):
        rows = rows.mapInArrow(partial(_clean, held), rows.schema)
    return rows.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])

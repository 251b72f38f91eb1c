"""LM scoring by context-tree weighting (operator 7).

A text is its words (A-Z in lower case, one space between) and an end; a byte is eight binary decisions. Each of the 255
decisions of a byte has a context tree over the bytes before it, nearest first, DEPTH deep. A node holds counts of zeros
and ones and the Krichevsky-Trofimov estimate; its weighted probability is half that estimate plus half the product over
its children, and the mixture over all depths follows from those. The score is the base-10 logarithm of the model's
probability of the text; bits_per_byte is its code length.

Counts come from every learned text: n-gram and word counts are summed in tasks, then by key. Every context learned is kept.
Subtrees are built by partitions of the two nearest bytes, some of these contexts at a time; only the 255 * 257 nodes above meet
in the driver. A partition also gives the logarithm of each gram (context and byte) that any text has, learned or not. Grams with
at least 1 / GRAMS of the bytes (at most GRAMS of them) are looked up in tasks, all others by a join. `fit` gives a smaller model
that a task can hold: there contexts with less than 1 / CONTEXTS of the bytes are pooled below their node as one more child.

The base score is that of single words. Words with at least 1 / WORDS of all tokens (at most WORDS of them) are looked up in
tasks, all others by a join on a 64-bit hash of the word.

Edge cases: a NULL text counts as empty and has one token, its end; a NULL id is neither learned from nor held out; with
nothing learned, every bit costs one bit and the base counts are zero; repeated rows are each returned; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.shared import stored
from tapeworks.llm.common import LOWER, SPACES, fields, mixed, padded, pieces, word_hashes, word_spans

DEPTH, CONTEXTS, GRAMS, WORDS = 5, 1 << 18, 1 << 21, 1 << 20
END, WINDOW, HELD = 10, 1 << 20, 1_500_000
SUBTREE = 100_000  # grams whose subtrees a task builds at a time
_TEXT = np.where(SPACES, 32, LOWER).astype(np.uint8)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


class Table:
    """Numbers by a 64-bit key, in arrays: open addressing, half full at most."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.mask = np.uint64((1 << max(4, int(2 * len(keys)).bit_length())) - 1)
        self.keys = np.full(int(self.mask) + 1, _EMPTY, np.uint64)
        self.values = np.zeros(int(self.mask) + 1, values.dtype)
        rest, slot = np.arange(len(keys)), mixed(keys) & self.mask
        while len(rest):
            free = self.keys[slot[rest]] == _EMPTY
            self.keys[slot[rest[free]]] = keys[rest[free]]
            placed = self.keys[slot[rest]] == keys[rest]
            self.values[slot[rest[placed]]] = values[rest[placed]]
            rest = rest[~placed]
            slot[rest] = (slot[rest] + np.uint64(1)) & self.mask

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, value) of each key."""
        slot = mixed(keys) & self.mask
        held = self.keys[slot]
        found = held == keys
        rest = np.flatnonzero(~found & (held != _EMPTY))
        while len(rest):
            slot[rest] = (slot[rest] + np.uint64(1)) & self.mask
            held = self.keys[slot[rest]]
            hit = held == keys[rest]
            found[rest[hit]] = True
            rest = rest[~hit & (held != _EMPTY)]
        return found, np.where(found, self.values[slot], 0)


def byte_stream(data: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts as scored: (bytes, row of each, whether it is scored); `depth` ends stand before each text, one after it."""
    flat, starts = padded(_TEXT[data], at, depth, 1, END)
    row = np.repeat(np.arange(len(at) - 1), np.diff(starts))
    keep = (flat[:-1] != 32) | (flat[1:] != 32)
    keep = np.append(keep, True)
    flat, row = flat[keep], row[keep]
    space = flat == 32
    space[1:] &= (flat[:-1] == END) | np.append(flat[2:] == END, False)
    flat, row = flat[~space], row[~space]
    first = np.searchsorted(row, np.arange(len(at) - 1))
    return flat, row, np.arange(len(flat)) - first[row] >= depth


def grams(flat: np.ndarray, scored: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, gram) of the scored bytes, window by window; a gram is the bytes before and the byte, as one number."""
    for a in range(depth, len(flat), WINDOW):
        b = min(a + WINDOW, len(flat))
        gram = np.zeros(b - a, np.uint64)
        for back in range(depth, -1, -1):
            gram <<= np.uint64(8)
            gram |= flat[a - back : b - back]
        yield np.flatnonzero(scored[a:b]) + a, gram[scored[a:b]]


class Sums:
    """Sums by key that are handed out when there are many."""

    def __init__(self) -> None:
        self.parts, self.n = [], 0

    def add(self, keys: np.ndarray) -> None:
        got = np.unique(keys, return_counts=True)
        self.parts.append(got)
        self.n += len(got[0])
        if self.n > 2 * HELD:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        got = keys[new], np.add.reduceat(n, new) if len(new) else n
        self.parts, self.n = [got], len(new)
        return got

    def out(self, kind: int, least: int) -> Iterator[pa.RecordBatch]:
        if self.n > least:
            keys, n = self.merge()
            if len(keys) > least:
                self.parts, self.n = [], 0
                for a in range(0, len(keys), 1 << 17):
                    k = keys[a : a + (1 << 17)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(k.view(np.int64)), pa.array(n[a : a + (1 << 17)])], names=["kind", "key", "n"])


def _count(depth: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = Sums(), Sums()
    for batch in batches:
        for _, _, data, at in pieces(batch, "_text"):
            flat, _, scored = byte_stream(data, at, depth)
            for _, gram in grams(flat, scored, depth):
                sums[0].add(gram)
            data = LOWER[data]
            _, begin, end = word_spans(data, at)
            sums[1].add(word_hashes(data, begin, end))
            for kind, s in enumerate(sums):
                yield from s.out(kind, HELD)
    for kind, s in enumerate(sums):
        yield from s.out(kind, 0)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    low = np.zeros(len(x))
    for i in range(6):
        low += np.log(x + i)
    y = x + 6
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1.0) - np.log(np.pi)


def next_one(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (b + 0.5) / (a + b + 1.0)


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], *[np.add.reduceat(v[order], new) if len(new) else v[order] for v in values]


def decisions(gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, zeros, ones) of the deepest nodes; a key is the context's bytes, then the bits of the byte so far behind a one."""
    byte, context = gram & np.uint64(255), (gram >> np.uint64(8)) << np.uint64(8)
    keys, ones = [], []
    for j in range(8):
        keys.append(context | np.uint64(1 << j) | (byte >> np.uint64(8 - j)))
        ones.append(n * ((byte >> np.uint64(7 - j)) & np.uint64(1)).astype(np.int64))
    n = np.tile(n, 8)
    ones = np.concatenate(ones)
    return _summed(np.concatenate(keys), n - ones, ones)


class Level:
    """Nodes of one depth: counts, those of the children that are not kept, and the weighted probability."""

    def __init__(self, key: np.ndarray, a: np.ndarray, b: np.ndarray, kept_a: np.ndarray, kept_b: np.ndarray, inner: np.ndarray) -> None:
        self.key, self.a, self.b = key, a, b
        self.rest_a, self.rest_b = a - kept_a, b - kept_b
        kt = log_kt(a.astype(float), b.astype(float))
        inner = inner + log_kt(self.rest_a.astype(float), self.rest_b.astype(float))
        self.log_w = np.logaddexp(kt, inner) - np.log(2)
        self.stop = np.exp(kt - np.log(2) - self.log_w)  # weight of the node's own estimate against its children

    def down(self, carried: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From the mixture above (probability so far, weight left): the same for the children, and the prediction if none is kept."""
        so_far = carried + left * self.stop * next_one(self.a, self.b)
        rest = left * (1 - self.stop)
        return so_far, rest, so_far + rest * next_one(self.rest_a, self.rest_b)


def _parents(key: np.ndarray, a: np.ndarray, b: np.ndarray, log_w: np.ndarray | None, depth: int, least: int) -> tuple[np.ndarray, ...]:
    """Sums of the nodes of `depth` for their parents: key, counts, counts of those kept, and the sum of their probabilities."""
    kept = (a + b) >= least
    up = key & np.uint64((1 << (8 * depth)) - 1)
    return _summed(up, a, b, a * kept, b * kept, np.where(kept, log_w, 0.0))


def subtree(gram: np.ndarray, n: np.ndarray, depth: int, least: int, top: int) -> tuple[list[Level], tuple[np.ndarray, ...]]:
    """Levels from `depth` to `top` of the kept nodes, and the sums for the level above."""
    key, a, b = decisions(gram, n)
    zero = np.zeros(len(key), np.int64)
    level = Level(key, a, b, zero, zero, np.zeros(len(key)))
    levels = []
    for d in range(depth, top, -1):
        levels.append(_kept(level, least))
        level = Level(*_parents(level.key, level.a, level.b, level.log_w, d, least))
    levels.append(_kept(level, least))
    return levels, _parents(level.key, level.a, level.b, level.log_w, top, least)


def _kept(level: Level, least: int) -> Level:
    ok = (level.a + level.b) >= least
    out = object.__new__(Level)
    for name, v in vars(level).items():
        setattr(out, name, v[ok])
    return out


def _whole(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    got = [b for b in batches if b.num_rows]
    if not got:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    t = pa.Table.from_batches(got)
    return t.column("key").to_numpy().view(np.uint64), t.column("n").to_numpy()


def _contexts(gram: np.ndarray) -> Iterator[np.ndarray]:
    """Positions of the grams, some contexts of the two nearest bytes at a time: their subtrees are apart."""
    two = (gram >> np.uint64(8)) & np.uint64(65535)
    order = np.argsort(two, kind="stable")
    ends = np.append(np.flatnonzero(two[order][1:] != two[order][:-1]) + 1, len(order)) if len(order) else order
    a = 0
    while a < len(order):
        b = int(ends[min(np.searchsorted(ends, a + SUBTREE), len(ends) - 1)])
        yield order[a:b]
        a = b


def _up(depth: int, least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    gram, n = _whole(batches)
    for one in _contexts(gram):
        _, sums = subtree(gram[one], n[one], depth, least, 2)
        yield pa.RecordBatch.from_arrays([pa.array(sums[0].view(np.int64)), *map(pa.array, sums[1:])], names=["key", "a", "b", "ka", "kb", "inner"])


def _down(depth: int, least: int, common: int, above: tuple[np.ndarray, np.ndarray, np.ndarray], upper: dict[int, Table], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    gram, n = _whole(batches)
    if not len(gram):
        return
    levels, _ = subtree(gram, n, depth, least, 2)
    key, carried, left = above
    nodes = dict(upper)
    for d, level in zip(range(2, depth + 1), reversed(levels), strict=True):
        spot = np.searchsorted(key, level.key & np.uint64((1 << (8 * d)) - 1))
        so_far, rest, leaf = level.down(carried[spot], left[spot])
        if d == depth:
            leaf = carried[spot] + left[spot] * next_one(level.a, level.b)
        key, carried, left = level.key, so_far, rest
        nodes[d] = Table(key, leaf)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), d, np.int32)), pa.array(key.view(np.int64)), pa.array(leaf)], names=["depth", "key", "p"])
    common = gram[n >= common]
    whole = Model(depth, nodes, Table(gram[:0], np.zeros(0)), None).log10(common)
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(common), -1, np.int32)), pa.array(common.view(np.int64)), pa.array(whole)], names=["depth", "key", "p"])


def _path(gram: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key of the deepest node, whether the bit is one) of each of the eight decisions."""
    byte, context = gram & np.uint64(255), (gram >> np.uint64(8)) << np.uint64(8)
    for j in range(8):
        yield context | np.uint64(1 << j) | (byte >> np.uint64(8 - j)), ((byte >> np.uint64(7 - j)) & np.uint64(1)).astype(bool)


class Model:
    """What a task needs to score: predictions of the kept nodes by depth, whole bytes of common grams, common words."""

    def __init__(self, depth: int, nodes: dict[int, Table], bytes_: Table, words: Table | None) -> None:
        self.depth, self.nodes, self.bytes, self.words = depth, nodes, bytes_, words

    def log10(self, gram: np.ndarray) -> np.ndarray:
        found, out = self.bytes.find(gram)
        out = out.astype(np.float64)
        rest = np.flatnonzero(~found)
        if len(rest):
            rare, back = np.unique(gram[rest], return_inverse=True)
            total = np.zeros(len(rare))
            for key, one in _path(rare):
                p, open_ = np.full(len(rare), 0.5), np.arange(len(rare))
                for d in range(self.depth, -1, -1):
                    hit, v = self.nodes[d].find(key[open_] & np.uint64((1 << (8 * d + 8)) - 1))
                    p[open_[hit]] = v[hit]
                    open_ = open_[~hit]
                    if not len(open_):
                        break
                total += np.log10(np.where(one, p, 1 - p))
            out[rest] = total[back]
        return out


def _learned(docs: DataFrame, learn: Column, text: str, depth: int) -> tuple[DataFrame, dict[str, int]]:
    """The counts (kind 0: grams, 1: words; key, n), and the totals learned: texts, tokens, vocabulary, bytes."""
    if not 2 <= depth <= 6:
        raise ValueError("depth must be from 2 to 6")
    learned = docs.where(learn).select(F.coalesce(F.col(text), F.lit("")).alias("_text"))
    counts = stored(learned.mapInArrow(partial(_count, depth), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    total = {r["kind"]: (r["n"], r["v"]) for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    texts = counts.where((F.col("kind") == 0) & (F.col("key").bitwiseAND(255) == END)).agg(F.sum("n")).first()[0] or 0
    size, words = total.get(0, (0, 0))[0], total.get(1, (0, 0))
    return counts, {"texts": texts, "tokens": words[0] + texts, "vocabulary": words[1] + (texts > 0), "bytes": size}


def _dealt(grams_: DataFrame) -> DataFrame:
    """By the two nearest bytes of context."""
    return grams_.repartition(F.shiftright("key", 8).bitwiseAND(65535))


def _above(table: DataFrame, depth: int, least: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], dict[int, Table]]:
    """What the nodes above the subtrees hand down, and their predictions."""
    up = table.mapInArrow(partial(_up, depth, least), "key long, a long, b long, ka long, kb long, inner double")
    up = up.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("a", "b", "ka", "kb", "inner")]).orderBy("key").toArrow()  # 255 * 256 rows at most
    one = Level(up["key"].to_numpy().view(np.uint64), *[up[c].to_numpy() for c in ("a", "b", "ka", "kb", "inner")])
    root = Level(*_parents(one.key, one.a, one.b, one.log_w, 1, least))
    one = _kept(one, least)
    so_far, rest, leaf0 = root.down(np.zeros(len(root.key)), np.ones(len(root.key)))
    spot = np.searchsorted(root.key, one.key & np.uint64(255))
    above, left, leaf1 = one.down(so_far[spot], rest[spot])
    return (one.key, above, left), {0: Table(root.key, leaf0), 1: Table(one.key, leaf1)}


def _common_words(counts: DataFrame, totals: dict[str, int]) -> tuple[DataFrame, Table]:
    word_counts = counts.where("kind = 1").select("key", "n")
    common = word_counts.where(F.col("n") * WORDS >= totals["tokens"]).toArrow()  # WORDS rows at most
    return word_counts, Table(common["key"].to_numpy().view(np.uint64), common["n"].to_numpy())


def fit(docs: DataFrame, learn: Column, text: str = "text", depth: int = DEPTH) -> tuple[Model, DataFrame, dict[str, int]]:
    """A model that a task can hold, contexts rarer than 1 / CONTEXTS of all bytes pooled (`score` keeps them all); the word counts
    (key, n); and the totals learned."""
    counts, totals = _learned(docs, learn, text, depth)
    least = max(1, -(-totals["bytes"] // CONTEXTS))
    table = _dealt(counts.where("kind = 0").select("key", "n"))
    above, upper = _above(table, depth, least)
    got = table.mapInArrow(partial(_down, depth, least, max(1, -(-totals["bytes"] // GRAMS)), above, upper), "depth int, key long, p double").toArrow()
    of, key, p = got["depth"].to_numpy(), got["key"].to_numpy().view(np.uint64), got["p"].to_numpy()
    nodes = upper | {d: Table(key[of == d], p[of == d].astype(np.float32)) for d in range(2, depth + 1)}
    word_counts, words = _common_words(counts, totals)
    return Model(depth, nodes, Table(key[of == -1], p[of == -1].astype(np.float32)), words), word_counts, totals


def _predict(depth: int, above: tuple[np.ndarray, np.ndarray, np.ndarray], upper: dict[int, Table], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n, p) of each gram of the partition, learned or only asked for: its count in all texts, and its logarithm with all contexts kept."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got)
    gram, n, m = t.column("key").to_numpy().view(np.uint64), t.column("n").to_numpy(), t.column("m").to_numpy()
    for one in _contexts(gram):
        mine, learned, asked = _summed(gram[one], n[one], m[one])
        seen = learned > 0
        levels, _ = subtree(mine[seen], learned[seen], depth, 1, 2)
        key, carried, left = above
        nodes = dict(upper)
        for d, level in zip(range(2, depth + 1), reversed(levels), strict=True):
            spot = np.searchsorted(key, level.key & np.uint64((1 << (8 * d)) - 1))
            so_far, rest, leaf = level.down(carried[spot], left[spot])
            nodes[d] = Table(level.key, carried[spot] + left[spot] * next_one(level.a, level.b) if d == depth else leaf)
            key, carried, left = level.key, so_far, rest
        model = Model(depth, nodes, Table(gram[:0], np.zeros(0)), None)
        for a in range(0, len(mine), 1 << 17):
            part = slice(a, a + (1 << 17))
            yield pa.RecordBatch.from_arrays([pa.array(mine[part].view(np.int64)), pa.array((learned + asked)[part]), pa.array(model.log10(mine[part]))], names=["key", "n", "p"])


def _score(model, totals: dict[str, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    m: Model = model.value
    floor = totals["tokens"] + 0.5 * (totals["vocabulary"] + 1)
    for batch in batches:
        kept = [c for c in batch.schema.names if c != "_text"]
        for first, end, data, at in pieces(batch, "_text"):
            n = end - first
            flat, row, scored = byte_stream(data, at, m.depth)
            score, seldom = np.zeros(n), []
            for where, gram in grams(flat, scored, m.depth):
                found, p = m.bytes.find(gram)
                score += np.bincount(row[where], p, n)
                seldom.append((row[where][~found], gram[~found]))
            of, gram = (np.concatenate(x) for x in zip(*seldom, strict=True)) if seldom else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
            ahead = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))])
            seldom = pa.ListArray.from_arrays(pa.array(ahead, pa.int32()), pa.array(gram.view(np.int64)))
            size = np.bincount(row[scored], minlength=n)
            data = LOWER[data]
            owner, begin, stop = word_spans(data, at)
            h = word_hashes(data, begin, stop)
            found, c = m.words.find(h)
            known = np.bincount(owner, found, n).astype(np.int64) + (totals["texts"] > 0)
            base = np.bincount(owner, np.where(found, np.log10((c + 0.5) / floor), 0), n) + np.log10((totals["texts"] + 0.5) / floor)
            cut = np.concatenate([[0], np.cumsum(np.bincount(owner[~found], minlength=n))])
            rare = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(h[~found].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k).slice(first, n) for k in kept], *map(pa.array, (np.bincount(owner, minlength=n) + 1, known, base, score, size)), rare, seldom],
                names=[*kept, "n_tokens", "_known", "_base", "_score", "_size", "_rare", "_grams"])


def score(docs: DataFrame, learn: Column, keep: dict[str, Column], text: str = "text", depth: int = DEPTH) -> DataFrame:
    """The columns `keep` of every row, with n_tokens, n_known, train_tokens, base_score, score and bits_per_byte."""
    counts, totals = _learned(docs, learn, text, depth)
    learned = counts.where("kind = 0").select("key", "n", F.lit(0).cast("long").alias("m"))
    others = docs.where(~F.coalesce(learn, F.lit(False))).select(F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInArrow(partial(_count, depth), "kind int, key long, n long")
    others = others.where("kind = 0").groupBy("key").agg(F.sum("n").alias("m")).select("key", F.lit(0).cast("long").alias("n"), "m")
    above, upper = _above(_dealt(learned), depth, 1)
    table = stored(_dealt(learned.unionByName(others)).mapInArrow(partial(_predict, depth, above, upper), "key long, n long, p double"))
    size = table.agg(F.sum("n")).first()[0] or 0
    common = table.where(F.col("n") * GRAMS >= size).select("key", "p").toArrow()  # GRAMS rows at most
    counts, words = _common_words(counts, totals)
    model = Model(depth, {}, Table(common["key"].to_numpy().view(np.uint64), common["p"].to_numpy()), words)
    held = docs.sparkSession.sparkContext.broadcast(model)  # GRAMS grams, WORDS words at most
    rows = docs.select(*[c.alias(n) for n, c in keep.items()], F.monotonically_increasing_id().alias("_row"), F.col(text).alias("_text"))
    more = {"n_tokens": "long", "_known": "long", "_base": "double", "_score": "double", "_size": "long", "_rare": "array<long>", "_grams": "array<long>"}
    scored = stored(rows.mapInArrow(partial(_score, held, totals), fields(rows, ("_text",), **more)))
    floor = totals["tokens"] + 0.5 * (totals["vocabulary"] + 1)
    rare = scored.where(F.size("_rare") > 0).select("_row", F.explode("_rare").alias("key")).join(counts, "key", "left")
    rare = rare.groupBy("_row").agg(F.count("n").alias("_more"), F.sum(F.log10((F.coalesce("n", F.lit(0)) + 0.5) / floor)).alias("_less"))
    seldom = table.where(F.col("n") * GRAMS < size).select("key", "p")
    seldom = scored.where(F.size("_grams") > 0).select("_row", F.explode("_grams").alias("key")).join(seldom, "key").groupBy("_row").agg(F.sum("p").alias("_p"))
    out = scored.drop("_rare", "_grams").join(rare, "_row", "left").join(seldom, "_row", "left")
    out = out.withColumn("score", F.col("_score") + F.coalesce("_p", F.lit(0.0)))
    return out.select(*keep, "n_tokens", (F.col("_known") + F.coalesce("_more", F.lit(0))).alias("n_known"), F.lit(totals["tokens"]).cast("long").alias("train_tokens"),
                      (F.col("_base") + F.coalesce("_less", F.lit(0.0))).alias("base_score"), "score", (-F.col("score") / math.log10(2) / F.col("_size")).alias("bits_per_byte"))

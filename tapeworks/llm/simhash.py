"""SimHash near-dedup (operator 9): 64-bit fingerprints, a binary trie self-join within a Hamming budget, components.

Distinct fingerprints are copied once for each of budget + 1 blocks of bits (two that differ in at most `budget` bits agree
on one block), so each block value is the root of a subtree. A task holds many subtrees as one sorted array and
descends all of them together: a frontier of pairs of nodes (two ranges of the array and the bits that differ so far)
is split bit by bit and a pair is dropped when its budget is exceeded. Subtrees above a size are dealt as pairs of their
children eight bits further down, so a block value that many fingerprints share is many tasks. A task returns the links
of a spanning forest, never all pairs. Only distinct fingerprints are joined, so a group of exact copies counts as one.

Edge cases: NULL text counts as empty; a text without words has fingerprint 0 and is linked like any other; rows that
repeat are each returned; a NULL doc_id gets the smallest id that is not NULL in its component, NULL if there is none;
an empty table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.shared import stored
from tapeworks.llm.common import LOWER, mixed, pieces, word_hashes, word_spans

SEED, SHINGLE, BUDGET = 42, 3, 3
SUBTREE = 50_000  # distinct fingerprints of a block value from which its subtree is dealt as pairs of children
FRONTIER = 1 << 17  # pairs of nodes that a task looks at together
RUN_PAIRS = 1 << 18  # near pairs that a task holds before it gives them out


def _fingerprints(n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [_of_texts(n, data, at) for _, _, data, at in pieces(batch, "_text")]
        got = np.concatenate(out) if out else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(got, pa.int64())], names=["_id", "_fp"])


def _of_texts(n: int, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Fingerprints, as signed longs, of the texts in one run of bytes."""
    rows = len(at) - 1
    row, begin, end = word_spans(data, at)
    words = np.bincount(row, minlength=rows)
    # the words of a text, each with one space behind it, as one run of bytes
    sizes = end - begin
    to = np.concatenate([[0], np.cumsum(sizes + 1)])
    flat = np.full(int(to[-1]), 0x20, np.uint8)
    flat[np.repeat(to[:-1] - np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else to[:-1], sizes) + np.arange(sizes.sum())] = LOWER[data[np.repeat(begin - np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else begin, sizes) + np.arange(sizes.sum())]]
    shingles = np.where(words > 0, np.maximum(words - n + 1, 1), 0)
    first_word = np.concatenate([[0], np.cumsum(words)[:-1]])
    starts = np.concatenate([[0], np.cumsum(shingles)])
    k = np.repeat(first_word - starts[:-1], shingles) + np.arange(starts[-1])
    last = np.minimum(k + n, np.repeat(first_word + words, shingles))
    body, digest = flat.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((digest(body[a:b], SEED) for a, b in zip(to[k].tolist(), (to[last] - 1).tolist(), strict=True)), np.uint64, len(k))
    return majority(h, starts[:-1], shingles).view(np.int64)


def majority(h: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of hashes, the bits set in over half of them; an empty run has none.

    Bits are counted eight at a time, in the bytes of one word, over at most 255 hashes; those counts are then summed.
    """
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    chunks = -(-counts[full] // 255)
    first = np.concatenate([[0], np.cumsum(chunks)[:-1]])
    cuts = np.repeat(starts[full], chunks) + 255 * (np.arange(chunks.sum()) - np.repeat(first, chunks))
    ones = np.uint64(0x0101010101010101)
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & ones, cuts).view(np.uint8).reshape(-1, 8)
        total = np.add.reduceat(lanes.astype(np.int64), first, axis=0)
        for j in range(8):
            out[full] |= (2 * total[:, j] > counts[full]).astype(np.uint64) << np.uint64(8 * j + k)
    return out


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint long) of every row: A-Z in lower case, `shingle` words joined by one space, repeats included."""
    kind = docs.schema[doc_id].dataType.simpleString()
    got = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).mapInArrow(partial(_fingerprints, shingle), f"_id {kind}, _fp long")
    return got.select(F.col("_id").alias("doc_id"), F.col("_fp").alias("fingerprint"))


class Forest:
    """Connected components of 0 .. n - 1 under links that come in arrays: the smallest member is the root."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def _flat(self) -> None:
        while True:
            up = self.root[self.root]
            if np.array_equal(up, self.root):
                return
            self.root = up

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            a, b = self.root[a], self.root[b]
            differ = a != b
            if not differ.any():
                return
            a, b = a[differ], b[differ]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            self._flat()


def trie_links(values: np.ndarray, group: np.ndarray, side: np.ndarray, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Positions of links of a spanning forest over all pairs of one group that differ in at most `budget` bits.

    values: uint64; group: int; side: 0 or 1. In a group with both sides, only pairs across are looked at (and equal
    values of a side); else all.
    """
    order = np.lexsort((values, side, group))
    n = len(order)
    if n < 2:
        return order[:0], order[:0]
    first = np.ones(n, bool)
    first[1:] = (values[order][1:] != values[order][:-1]) | (side[order][1:] != side[order][:-1]) | (group[order][1:] != group[order][:-1])
    leaf = order[first]  # one position for each value
    equal = leaf[np.cumsum(first) - 1][~first], order[~first]
    a, b = _trie(values[leaf], group[leaf], side[leaf], budget)
    return np.concatenate([equal[0], leaf[a]]), np.concatenate([equal[1], leaf[b]])


def _trie(v: np.ndarray, g: np.ndarray, s: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for distinct values in the order of group, side and value."""
    n = len(v)
    forest = Forest(n)
    new = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (s[1:] != s[:-1])]))
    end = np.concatenate([new[1:], [n]])
    if len(new) > 1:
        pair = np.flatnonzero((g[new][1:] == g[new][:-1]) & (s[new][1:] != s[new][:-1]))
    else:
        pair = np.zeros(0, np.int64)
    crossed = np.zeros(len(new), bool)
    crossed[pair] = crossed[pair + 1] = True
    alone = np.flatnonzero(~crossed & (end - new > 1))
    # stack of (bit to split next, begin and end of both nodes, differing bits); one-node pairs have equal ranges
    stack = [(63, np.concatenate([new[alone], new[pair]]), np.concatenate([end[alone], end[pair]]), np.concatenate([new[alone], new[pair + 1]]), np.concatenate([end[alone], end[pair + 1]]), np.zeros(len(alone) + len(pair), np.int8))]
    while stack:
        bit, a0, a1, b0, b1, d = stack.pop()
        if not len(a0):
            continue
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            stack += [(bit, a0[half:], a1[half:], b0[half:], b1[half:], d[half:]), (bit, a0[:half], a1[:half], b0[:half], b1[:half], d[:half])]
            continue
        one = (a1 - a0 == 1) & (b1 - b0 == 1)
        if bit < 0:
            one[:] = True
        if one.any():  # two leaves: the remaining bits at once
            x, y = a0[one], b0[one]
            near = (x != y) & (np.bitwise_count(v[x] ^ v[y]) <= budget)
            forest.add(x[near], y[near])
            rest = ~one
            a0, a1, b0, b1, d = a0[rest], a1[rest], b0[rest], b1[rest], d[rest]
        if not len(a0):
            continue
        same = a0 == b0
        a, b = _split(v, a0, a1, bit), _split(v, b0, b1, bit)
        parts = []
        for i in (0, 1):
            for j in (0, 1):
                x0, x1 = (a0, a) if i == 0 else (a, a1)
                y0, y1 = (b0, b) if j == 0 else (b, b1)
                dd = d + (i != j)
                ok = (x1 > x0) & (y1 > y0) & (dd <= budget)
                if (i, j) == (1, 0):
                    ok &= ~same  # the pair of children that (0, 1) already is
                ok &= ~((x0 == y0) & (x1 - x0 == 1))
                parts.append((x0[ok], x1[ok], y0[ok], y1[ok], dd[ok].astype(np.int8)))
        stack.append((bit - 1, *(np.concatenate(c) for c in zip(*parts, strict=True))))
    linked = np.flatnonzero(forest.root != np.arange(n))
    return linked, forest.root[linked]


def _split(v: np.ndarray, begin: np.ndarray, end: np.ndarray, bit: int) -> np.ndarray:
    """Where, in each sorted range of values equal above `bit`, that bit turns to 1."""
    lo, hi = begin.copy(), end.copy()
    b = np.uint64(bit)
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        one = ((v[np.minimum(mid, len(v) - 1)] >> b) & np.uint64(1)).astype(bool)
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)


def _links(budget: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [b for b in batches if b.num_rows]
    if got:
        whole = pa.Table.from_batches(got)
        _, group = np.unique(whole.column("_tree").to_numpy(), return_inverse=True)
        a, b = trie_links(whole.column("_fp").to_numpy().view(np.uint64), group, whole.column("_side").to_numpy(), budget)
        node = whole.column("_node").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])


def links(prints: DataFrame, budget: int = BUDGET, subtree: int = SUBTREE) -> DataFrame:
    """(a, b): links that connect all nodes with fingerprints of one table that differ in at most `budget` bits.

    prints: (node long, table int, fingerprint long), few rows with the same fingerprint of a table.
    """
    blocks = budget + 1
    width = 64 // blocks
    block = lambda k: F.shiftrightunsigned("fingerprint", k * width).bitwiseAND((1 << (width if k < blocks - 1 else 64 - k * width)) - 1)
    rows = prints.select("node", "table", "fingerprint", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), block(k).alias("v")) for k in range(blocks)])).alias("_b"))
    rows = rows.select("node", "fingerprint", "table", "_b.k", "_b.v")
    big = rows.groupBy("table", "k", "v").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > subtree).select("table", "k", "v", F.lit(True).alias("_big"))
    rows = rows.join(F.broadcast(stored(big)), ["table", "k", "v"], "left")  # at most one row for each `subtree` rows of the join
    # a child of a large subtree is named by the eight bits above its block, round the word; it meets the children near it
    child = F.lit(None).cast("long")
    for k in range(blocks):
        child = F.when(F.col("k") == k, F.shiftrightunsigned("fingerprint", (k + 1) * width if k < blocks - 1 else 0).bitwiseAND(255)).otherwise(child)
    near = F.array(*[F.lit(x).cast("long") for x in range(256) if x.bit_count() <= budget])
    no = F.lit(-1).cast("long")
    plain = rows.where("_big is null").select("node", "fingerprint", F.xxhash64("table", "k", "v", no, no).alias("_tree"), F.lit(0).alias("_side"))
    dealt = rows.where("_big").withColumn("_c", child).withColumn("_x", F.explode(near)).withColumn("_o", F.col("_c").bitwiseXOR(F.col("_x")))
    dealt = dealt.select("node", "fingerprint", F.xxhash64("table", "k", "v", F.least("_c", "_o"), F.greatest("_c", "_o")).alias("_tree"), (F.col("_c") > F.col("_o")).cast("int").alias("_side"))
    dealt = plain.unionByName(dealt).select("_tree", F.col("node").alias("_node"), F.col("fingerprint").alias("_fp"), "_side")
    return dealt.repartition("_tree").mapInArrow(partial(_links, budget), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b): the root is the smallest node reachable.

    Each round hangs every neighbour larger than a node on the node's smallest one, then every neighbour that is not larger
    (the large-star and small-star steps), until nothing changes; rounds grow with the logarithm of the nodes.
    Sizes are aggregated before each shuffle, and a node with many neighbours is only ever reduced to a minimum.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("_e")).select("_e.u", "_e.v").where("u <> v").distinct()
        now = stored(small)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id) of every row: linked fingerprints share the smallest doc_id."""
    prints = stored(fingerprints(docs, doc_id, text, shingle))
    distinct = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("_first")))
    roots = components(links(distinct.select(F.col("fingerprint").alias("node"), F.lit(0).alias("table"), "fingerprint"), budget))
    named = distinct.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    first = named.groupBy("root").agg(F.min("_first").alias("component_id"))
    named = named.join(first, "root").select("fingerprint", "component_id")
    return prints.join(named, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


# Groups of near copies for a corpus, where similarity is that of sets of five-word shingles.

WORDS, SIMILAR = 5, 0.8
PARITY = 2  # parity bits for each shingle of a set, rounded up to a power of two: two sets differ in at least as many shingles as bits
SAMPLE, COMMON, MOST = 4000, 3, 1 << 18  # about so many texts, among which a shingle that is there so often (the MOST commonest) is common: last in a prefix
SLICE = 1000  # texts of one shingle that a task compares with as many others


def _shingle_hashes(word: np.ndarray, row: np.ndarray, rows: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first of each text, count of each text) of all runs of n words; a shorter text is one run."""
    words = np.bincount(row, minlength=rows)
    count = np.where(words > 0, np.maximum(words - n + 1, 1), 0)
    first = np.concatenate([[0], np.cumsum(words)[:-1]])
    start = np.concatenate([[0], np.cumsum(count)[:-1]])
    at = np.repeat(first - start, count) + np.arange(count.sum())
    end = np.repeat(first + words, count)
    h = np.full(len(at), n, np.uint64)
    for k in range(n):
        inside = at + k < end
        step = np.where(inside, word[np.minimum(at + k, len(word) - 1)], 0) if len(word) else h
        h = np.where(inside, h * np.uint64(0x9E3779B97F4A7C15) + step, h)
    return mixed(h) >> np.uint64(1), start, count


def _sets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text, in order, and how many each has."""
    rows = len(at) - 1
    data = LOWER[data]
    row, begin, stop = word_spans(data, at)
    h, _, count = _shingle_hashes(word_hashes(data, begin, stop), row, rows, WORDS)
    row = np.repeat(np.arange(rows), count)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    row, h = row[new], h[new]
    return row, h, np.bincount(row, minlength=rows)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values.view(np.int64)))


def _widths(count: np.ndarray) -> np.ndarray:
    """Words of parity bits of sets of these sizes; those of two sets that may be similar differ twofold at most."""
    return 1 << np.ceil(np.log2(np.maximum(PARITY * count, 64) / 64)).astype(np.int64)


def _differ(bits: np.ndarray, first: np.ndarray, width: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Parity bits that differ between the sets x and y; of two widths the larger is folded."""
    out = np.zeros(len(x), np.int64)
    least = np.minimum(width[x], width[y])
    for w in np.unique(least):
        mine = np.flatnonzero(least == w)
        for at in np.array_split(mine, -(-len(mine) * int(w) // (1 << 20))):
            got = np.zeros((len(at), w), np.uint64)
            for side in (x[at], y[at]):
                for fold in range(int((width[side] // w).max())):
                    wide = np.flatnonzero(width[side] // w > fold)
                    got[wide] ^= bits[(first[side[wide]] + fold * w)[:, None] + np.arange(w)]
            out[at] = np.bitwise_count(got).sum(1, dtype=np.int64)
    return out


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, at in pieces(batch, "_text"):
            _, h, count = _sets(data, at)
            yield pa.RecordBatch.from_arrays([batch.column("_key").slice(first, end - first), _lists(h, count)], names=["_key", "s"])


def prefix(count: np.ndarray, similar: float) -> np.ndarray:
    """How many of the first shingles of a text (in an order that holds for all) meet those of every text that is as similar."""
    return np.where(count > 0, count - np.ceil(similar * count - 1e-9).astype(np.int64) + 1, 0)


def _screens(similar: float, common: np.ndarray, often: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text: the size of its set, two sums that stand for the set, its parities, and its prefix without and with common shingles."""
    for batch in batches:
        for first, end, data, at in pieces(batch, "_text"):
            row, h, count = _sets(data, at)
            rows = end - first
            start = np.concatenate([[0], np.cumsum(count)[:-1]])
            full = np.flatnonzero(count)
            parts = []
            for salt in (1, 2):
                total = np.zeros(rows, np.uint64)
                if len(full):
                    total[full] = np.add.reduceat(mixed(h + np.uint64(salt)), start[full])
                parts.append(pa.array(total.view(np.int64)))
            width = _widths(count)
            bit = (mixed(h) & (64 * width[row] - 1).astype(np.uint64)).astype(np.int64)
            odd = np.bincount((64 * (np.cumsum(width) - width))[row] + bit, minlength=64 * int(width.sum())) & 1
            parts.append(_lists(np.packbits(odd.astype(np.uint8)).view(np.int64), width))
            seen = np.zeros(len(h), np.int64)
            if len(common):
                spot = np.minimum(np.searchsorted(common, h), len(common) - 1)
                seen = np.where(common[spot] == h, often[spot], 0)
            order = np.lexsort((h, seen, row))
            ahead = np.arange(len(h)) - start[row] < prefix(count, similar)[row]  # `row` is the same in that order
            pick = order[ahead]
            for mine in (pick[seen[pick] == 0], pick[seen[pick] > 0]):
                parts.append(_lists(h[mine], np.bincount(row[mine], minlength=rows)))
            yield pa.RecordBatch.from_arrays([batch.column("_id").slice(first, rows), batch.column("_key").slice(first, rows), pa.array(count), *parts], names=["_id", "_key", "n", "set1", "set2", "parity", "rare", "common"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose shingle more than one row of the partition has."""
    got = [b for b in batches if b.num_rows]
    if got:
        whole = pa.Table.from_batches(got).combine_chunks()
        h = whole.column("h").to_numpy()
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        more = np.zeros(len(h), bool)
        more[order[1:][same]] = more[order[:-1][same]] = True
        yield from whole.filter(pa.array(more)).to_batches()


def _across(similar: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of one tree with different roots that sizes and parities allow; where a tree has two sides, pairs across only."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    whole = pa.Table.from_batches(got).combine_chunks()
    order = np.argsort(whole.column("_tree").to_numpy(), kind="stable")
    tree, root, side, node, n = (whole.column(c).to_numpy()[order] for c in ("_tree", "root", "_side", "node", "n"))
    lists = whole.column("parity").combine_chunks()
    bits, at = lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy().astype(np.int64)
    first, width = (at[:-1] - at[0])[order], np.diff(at)[order]
    i, ahead, pairs, held = np.arange(len(order)), 1, [], 0
    while True:
        i = i[i + ahead < len(order)]
        i = i[tree[i] == tree[i + ahead]]
        if not len(i):
            break
        j = i + ahead
        ok = (root[i] != root[j]) & ((side[i] != side[j]) | (side[i] == 0)) & (np.minimum(n[i], n[j]) >= (similar - 1e-9) * np.maximum(n[i], n[j]))
        a, b = i[ok], j[ok]
        for c in range(0, len(a), 1 << 18):
            x, y = a[c : c + (1 << 18)], b[c : c + (1 << 18)]
            near = _differ(bits, first, width, x, y) <= (n[x] + n[y]) * ((1 - similar) / (1 + similar)) + 1e-6
            pairs.append(np.stack([np.minimum(node[x[near]], node[y[near]]), np.maximum(node[x[near]], node[y[near]])], 1))
            held += near.sum()
        if held > RUN_PAIRS:
            yield _pairs(pairs)
            pairs, held = [], 0
        ahead += 1
    if pairs:
        yield _pairs(pairs)


def _pairs(parts: list[np.ndarray]) -> pa.RecordBatch:
    got = np.unique(np.concatenate(parts), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])


def row_key(docs: DataFrame):
    """A 64-bit hash of all columns of a row."""
    return F.xxhash64(*[docs[f"`{c}`"] for c in docs.columns])


def _decide(similar: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) of texts whose whole sets have `similar` in common."""
    for batch in batches:
        for first, end, data, at in pieces(batch, "_ta"):
            rows = end - first
            part = batch.slice(first, rows)
            _, _, data_b, at_b = next(pieces(part, "_tb", 1 << 62, rows))
            (row, h, n), (row_b, h_b, n_b) = _sets(data, at), _sets(data_b, at_b)
            row, h = np.concatenate([row, row_b]), np.concatenate([h, h_b])
            order = np.lexsort((h, row))
            row, h = row[order], h[order]
            equal = np.bincount(row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])], minlength=rows)
            yield part.select(["a", "b"]).filter(pa.array(equal >= (n + n_b - equal) * (similar - 1e-12)))


def _fit(similar: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, bits, first = [], [], []
        for c in "ab":
            lists = batch.column(f"p{c}")
            n.append(batch.column(f"n{c}").to_numpy())
            first.append(lists.offsets.to_numpy().astype(np.int64))
            bits.append(lists.flatten().to_numpy().view(np.uint64))
        rows = np.arange(batch.num_rows)
        width = np.concatenate([np.diff(f) for f in first])
        start = np.concatenate([first[0][:-1] - first[0][0], first[1][:-1] - first[1][0] + len(bits[0])])
        differ = _differ(np.concatenate(bits), start, width, rows, rows + batch.num_rows)
        yield batch.select(["a", "b"]).filter(pa.array(differ <= (n[0] + n[1]) * ((1 - similar) / (1 + similar)) + 1e-6))


def near_pairs(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """Of the pairs (a, b) those whose sets have `similar` in common: sizes and parities first, then all shingles of both texts."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("parity").alias(f"p{c}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") >= F.greatest("na", "nb") * (similar - 1e-9))
    left = stored(sized.mapInArrow(partial(_fit, similar), "a long, b long"))
    ends = left.select(F.explode(F.array("a", "b")).alias("_key")).distinct()
    whole = stored(texts.join(ends, "_key", "left_semi"))
    if whole.count() > ends.count():  # rows that repeat
        whole = whole.dropDuplicates(["_key"])
    text = lambda c: whole.select(F.col("_key").alias(c), F.col("_text").alias(f"_t{c}"))
    return stored(left.join(text("a"), "a").join(text("b"), "b").mapInArrow(partial(_decide, similar), "a long, b long"))


def fingerprint_links(texts: DataFrame, named: DataFrame, budget: int) -> DataFrame:
    """(a, b): links that connect all nodes with texts whose fingerprints differ in at most `budget` bits (operator 9)."""
    prints = fingerprints(texts, "_key", "_text").select(F.col("doc_id").alias("_key"), "fingerprint").distinct()
    prints = stored(prints.join(named.select("_key", "node").distinct(), "_key").select("node", "fingerprint").distinct())
    distinct = prints.select("fingerprint").distinct()
    roots = components(links(distinct.select(F.col("fingerprint").alias("node"), F.lit(0).alias("table"), "fingerprint"), budget))
    grouped = prints.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select("node", F.coalesce("root", "fingerprint").alias("_group"))
    first = grouped.groupBy("_group").agg(F.min("node").alias("b"))
    return stored(grouped.join(first, "_group").where("node <> b").select(F.col("node").alias("a"), "b"))


def similar_pairs(nodes: DataFrame, texts: DataFrame, similar: float, slice_: int = SLICE, linked: DataFrame | None = None) -> DataFrame:
    """(a, b): pairs of texts with `similar` of their shingles in common, which connect all that such pairs connect; and those `linked` already.

    Two such texts have a shingle of their prefixes in common. Of each shingle the first text is compared with the others;
    then the texts that are not yet connected are compared, each with each.
    """
    rare = nodes.select("node", F.explode("rare").alias("h")).repartition("h").mapInArrow(_shared, "node long, h long")
    held = stored(rare.unionByName(nodes.select("node", F.explode("common").alias("h"))))
    first = held.groupBy("h").agg(F.min("node").alias("a"))
    stars = held.join(first, "h").where("a <> node").select("a", F.col("node").alias("b")).distinct()
    near = near_pairs(stars, nodes, texts, similar)
    near = near if linked is None else near.unionByName(linked)
    held = held.join(components(near), "node", "left").withColumn("root", F.coalesce("root", "node"))
    held = stored(held)
    apart = held.groupBy("h").agg(F.min("root").alias("_low"), F.max("root").alias("_high"), F.count(F.lit(1)).alias("_n")).where("_low <> _high")
    rows = held.join(apart.select("h", F.ceil(F.col("_n") / slice_).cast("int").alias("_slices")), "h")
    rows = rows.withColumn("_mine", F.pmod(F.xxhash64("node"), "_slices").cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)))
    low, high = F.least("_mine", "_other"), F.greatest("_mine", "_other")
    rows = rows.select("node", "root", F.xxhash64("h", low, high).alias("_tree"), F.when(low == high, 0).when(F.col("_mine") < F.col("_other"), 1).otherwise(2).alias("_side"))
    rows = rows.join(nodes.select("node", "n", "parity"), "node").repartition("_tree")
    more = rows.mapInArrow(partial(_across, similar), "a long, b long").distinct()
    return near.unionByName(near_pairs(more, nodes, texts, similar))


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similar: float = SIMILAR, budget: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(_key) of the rows that are near copies of one that stays, and (_key) of rows that are there more than once.

    Two texts are near copies if they have `similar` of their distinct five-word shingles in common (of those that either
    has); every such pair counts, at any length. With a `budget`, texts whose fingerprints differ in at most so many bits are near copies
    too, as operator 9 links them. Of each group (near copies of near copies included) the row with the
    smallest id stays; NULL ids come last.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("_id"), row_key(docs).alias("_key"), F.col(text).alias("_text"))
    texts = rows.select("_key", "_text")
    rate = SAMPLE / max(docs.count(), 1)
    sample = texts.where(F.pmod(F.xxhash64("_key", F.lit(1)), F.lit(1 << 20)) < rate * (1 << 20)).mapInArrow(_shingles, "_key long, s array<long>")
    often = sample.select(F.explode("s").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= COMMON).orderBy(F.desc("c"), "h").limit(MOST).toArrow().sort_by("h")
    common, often = often["h"].to_numpy().view(np.uint64), often["c"].to_numpy()  # they order prefixes, any order finds the same pairs
    prints = stored(rows.mapInArrow(partial(_screens, similar, common, often), f"_id {kind}, _key long, n long, set1 long, set2 long, parity array<long>, rare array<long>, common array<long>"))
    twice = prints.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_key")
    order = F.struct(F.col("_id").isNull().alias("null"), "_id", "_key")
    sets = prints.groupBy("n", "set1", "set2").agg(F.min(order).alias("_first"), F.min("_key").alias("node"))  # equal sets once
    named = stored(prints.select("_key", "n", "set1", "set2").join(sets, ["n", "set1", "set2"]).select("_key", "node", "_first"))
    nodes = prints.join(named.where("_key = node").select("_key").distinct(), "_key", "left_semi").select(F.col("_key").alias("node"), "n", "parity", "rare", "common")
    if not twice.isEmpty():
        nodes = nodes.dropDuplicates(["node"])
    linked = None if budget is None else fingerprint_links(texts, named, budget)
    roots = components(similar_pairs(stored(nodes), texts, similar, linked=linked))
    groups = named.select("node", "_first").distinct().join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    stays = groups.groupBy("root").agg(F.min("_first").alias("_first")).select(F.col("_first._key").alias("_key"))
    gone = named.select("_key").distinct().join(stays, "_key", "left_anti")
    return gone, twice


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similar: float = SIMILAR, budget: int | None = None) -> DataFrame:
    """The rows of docs without near copies: one of each group stays."""
    gone, twice = repeats(docs, doc_id, text, similar, budget)
    keyed = docs.withColumn("_row_key", row_key(docs))
    left = keyed.join(gone.select(F.col("_key").alias("_row_key")), "_row_key", "left_anti")
    twice = stored(twice.select(F.col("_key").alias("_row_key")))
    if not twice.isEmpty():  # equal rows: one of them
        left = left.join(twice, "_row_key", "left_anti").unionByName(left.join(twice, "_row_key", "left_semi").dropDuplicates(["_row_key"]))
    return left.drop("_row_key")

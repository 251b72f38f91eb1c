"""Token ids in binary blocks with Elias-Fano document boundaries (operator 13).

Texts are dealt by ranges of their id (then of a hash of the text, so that a repeated id spreads) and sorted; a task encodes
its rows with the tokenizers library, puts the end id after each, and writes blocks of about BLOCK_IDS ids through Spark, so a
lost task leaves nothing behind. A block is one value of bytes:

  "EFID", version, bytes of an id (2 or 4), low bits l, 0                     8 bytes
  documents n, ids u, bytes of the low part, of the high part, of the ranks   5 x 8 bytes, little-endian
  low part    the l lowest bits of each of the n + 1 boundaries
  high part   boundary i sets bit (value >> l) + i
  ranks       bits set before each 512 bits of the high part, 4 bytes each
  ids         all ids one after another

Boundary i is the place of the i-th set bit less i, with its low bits: found by a search in the ranks and a count inside 64
bytes, so no table of 64-bit offsets is kept (2 + log2(u / n) bits a document and 1/16 of the high part for the ranks). The
table of blocks holds (shard, part, docs: their ids, n_ids, file: the block); running sums of n_ids by shard give each block
its place in the whole.

A byte-level tokenizer never joins what stands before white space with it, so its texts are cut there, after a character that is
surely no white space, and each distinct piece of a batch is encoded once; a bounded memo keeps pieces from batch to batch. Texts
of any other tokenizer are encoded whole. Strings of special tokens inside a text are ordinary text, unless `special` says otherwise.

Edge cases: a NULL text counts as empty; an empty text is the end id alone; NULL ids come first; rows that repeat an id stand
by the hash of their text; an empty table gives no blocks; a text is never cut, so a block is as long as its last text makes
it; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeworks.functions.shared import folder
from tapeworks.llm.common import SPACES, pieces

END_ID = 0
BLOCK_IDS = 1 << 20
MEMO = 1 << 20  # distinct pieces that a worker remembers
JOINED = 512  # pieces encoded in one call
SUPER = 64  # bytes of the high part for each rank
HEAD = struct.Struct("<4sBBBBQQQQQ")
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_ONES = _BITS.sum(1).astype(np.int64)
_NTH = np.argsort(1 - _BITS, axis=1, kind="stable")  # places of a byte's set bits, in order


# ------------------------------------------------------------------ boundaries


def pack(values: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """(l, low part, high part, ranks) of ascending whole numbers from 0."""
    n = len(values)
    low = max(int(values[-1]) // n, 1).bit_length() - 1
    planes = (values[:, None] >> np.arange(low)) & 1
    high = np.zeros(-(-((int(values[-1]) >> low) + n) // (8 * SUPER)) * 8 * SUPER, np.uint8)
    high[(values >> low) + np.arange(n)] = 1
    ranks = np.concatenate([[0], high.reshape(-1, 8 * SUPER).sum(1, dtype=np.int64).cumsum()[:-1]])
    return low, np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ranks.astype("<u4").tobytes()


def select(low: int, lows: np.ndarray, high: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The values numbered `at` of packed ones."""
    block = np.searchsorted(ranks, at, "right") - 1
    left = at - ranks[block]
    inside = high.reshape(-1, SUPER)[block]
    upto = _ONES[inside].cumsum(1)
    byte = (upto <= left[:, None]).sum(1)
    row = np.arange(len(at))
    own = inside[row, byte]
    left = left - (upto[row, byte] - _ONES[own])
    top = block * 8 * SUPER + byte * 8 + _NTH[own, left] - at
    bit = at[:, None] * low + np.arange(low)
    return (top << low) | (((lows[bit >> 3] >> (bit & 7)) & 1).astype(np.int64) << np.arange(low)).sum(1)


def to_block(sizes: np.ndarray, ids: np.ndarray, width: int) -> bytes:
    low, lows, high, ranks = pack(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
    head = HEAD.pack(b"EFID", 1, width, low, 0, len(sizes), len(ids), len(lows), len(high), len(ranks))
    return b"".join([head, lows, high, ranks, ids.astype(f"<u{width}").tobytes()])


class Block:
    """Documents of one block, read from its bytes."""

    def __init__(self, file: bytes | memoryview):
        mark, version, width, self.low, _, self.n_docs, self.n_ids, *sizes = HEAD.unpack_from(file)
        if mark != b"EFID" or version != 1 or len(file) != HEAD.size + sum(sizes) + width * self.n_ids:
            raise ValueError("not a block of ids")
        at = np.concatenate([[HEAD.size], HEAD.size + np.cumsum(sizes)])
        part = lambda i, kind, n: np.frombuffer(file, kind, n, int(at[i]))
        self.lows, self.high, self.ranks = part(0, np.uint8, sizes[0]), part(1, np.uint8, sizes[1]), part(2, "<u4", sizes[2] // 4).astype(np.int64)
        self.ids = part(3, f"<u{width}", self.n_ids)

    def starts(self, docs: np.ndarray, together: int = 1 << 14) -> np.ndarray:
        """Where documents begin; number n_docs is the end of the last."""
        return np.concatenate([select(self.low, self.lows, self.high, self.ranks, docs[i : i + together]) for i in range(0, len(docs), together)] or [docs])

    def document(self, i: int) -> np.ndarray:
        a, b = self.starts(np.array([i, i + 1]))
        return self.ids[a:b]


# ------------------------------------------------------------------ encoding


class Encoder:
    """Ids of texts by a file of the tokenizers library."""

    def __init__(self, file: str, special: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = not special
        plan = json.loads(self.tokenizer.to_str())
        before = plan.get("pre_tokenizer") or {}
        edges = any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in plan["added_tokens"])
        self.cuts = before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and not plan["normalizer"] and not plan["truncation"] and not edges
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = 2 if max(vocabulary.values(), default=0) < 1 << 16 else 4
        self.n_bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.n_bytes[i] = len(token)  # a byte-level token has a character for each byte
        for t in plan["added_tokens"]:
            self.n_bytes[t["id"]] = len(t["content"].encode())
        self.forget()

    def forget(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.flat, self.begin, self.count = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        self.n_flat = 0

    def _add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        self.begin.append(self.n_flat + np.cumsum(counts) - counts)
        self.count.append(counts)
        self.flat.append(ids)
        self.n_flat += len(ids)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.array([len(x) for x in found], np.int64)
        return np.fromiter((i for x in found for i in x), np.int64, int(counts.sum())), counts

    def _learn(self, new: list[bytes]) -> None:
        """Encode pieces: those that begin with white space in one text, as nothing joins over that place."""
        for i in range(0, len(new), JOINED):
            some = new[i : i + JOINED]
            ends = np.cumsum([len(x) for x in some])
            try:
                ids = np.array(self.tokenizer.encode(b"".join(some).decode(), add_special_tokens=False).ids, np.int64)
                upto = np.cumsum(self.n_bytes[ids])
                last = np.searchsorted(upto, ends)
                if last[-1] >= len(upto) or (upto[last] != ends).any():
                    raise ValueError("pieces do not end with tokens")
                self._add(ids, np.diff(last, prepend=-1))
            except ValueError:  # bytes that are no text: each piece alone
                self._add(*self._whole([x.decode(errors="replace") for x in some]))

    def __call__(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each text) of texts given by their bytes and offsets."""
        if not self.cuts:
            raw = data.tobytes()
            return self._whole([raw[a:b].decode(errors="replace") for a, b in zip(at[:-1], at[1:], strict=True)])
        sure = (data >= 0x21) & (data <= 0x7E)  # no white space: visible ASCII, letters of two bytes from U+00C0 to U+07FF
        sure[1:] |= (data[1:] >= 0x80) & (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = SPACES[data[1:]] & sure[:-1]
        inner = cut.copy()
        cut[at] = True
        place = np.flatnonzero(cut)
        words = pa.Array.from_buffers(pa.large_binary(), len(place) - 1, [None, pa.py_buffer(place.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        names, which = words.dictionary.to_pylist(), words.indices.to_numpy()
        first = np.zeros(len(names), np.int64)
        first[which[::-1]] = np.arange(len(which))[::-1]
        known = self.slot.get
        slot = np.fromiter((known(x, -1) for x in names), np.int64, len(names))
        new = np.flatnonzero(slot < 0)
        if len(self.slot) + len(new) > MEMO and self.slot:
            self.forget()
            new = np.arange(len(names))
        apart = ~(inner[place[first[new]]] & inner[place[first[new] + 1]])  # at an edge of a text
        joined, alone = ([names[i] for i in new[x]] for x in (~apart, apart))
        slot[np.concatenate([new[~apart], new[apart]])] = len(self.slot) + np.arange(len(new))
        self._learn(joined)
        if alone:
            self._add(*self._whole([x.decode(errors="replace") for x in alone]))
        self.slot.update(zip([*joined, *alone], range(len(self.slot), len(self.slot) + len(new)), strict=True))
        for kept in (self.flat, self.begin, self.count):
            kept[:] = [np.concatenate(kept)]
        slot = slot[which]
        n, row = self.count[0][slot], np.searchsorted(at, place[:-1], "right") - 1
        place_of = np.repeat(self.begin[0][slot] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return self.flat[0][place_of], np.bincount(row, n, len(at) - 1).astype(np.int64)


_ENCODERS: dict[tuple[str, bool], Encoder] = {}  # of this worker


def _blocks(file: str, special: bool, end_id: int, block_ids: int, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encode = _ENCODERS.get((file, special)) or _ENCODERS.setdefault((file, special), Encoder(file, special))
    width = encode.width if end_id < 1 << 16 else 4
    shard, part, docs, sizes, ids, n = None, 0, [], [], [], 0

    def block() -> pa.RecordBatch:
        nonlocal part, docs, sizes, ids, n
        names = pa.concat_arrays(docs)
        row = [pa.array([shard], pa.int32()), pa.array([part], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), pa.array([n], pa.int64()),
               pa.array([to_block(np.concatenate(sizes), np.concatenate(ids), width)], pa.binary())]
        part, docs, sizes, ids, n = part + 1, [], [], [], 0
        return pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(row, schema, strict=True)], names=schema.names)

    for batch in batches:
        for first, end, data, at in pieces(batch, "_text", 8 << 20, 8192):
            found, counts = encode(data, at)
            out = np.full(len(found) + len(counts), end_id, np.uint32)
            out[np.arange(len(found)) + np.repeat(np.arange(len(counts)), counts)] = found
            shard = batch.column("_shard")[0].as_py()
            counts = counts + 1
            upto = np.cumsum(counts)
            a = 0
            while a < len(counts):  # whole texts until the block is full
                b = min(int(np.searchsorted(upto, (upto[a - 1] if a else 0) + block_ids - n)) + 1, len(counts))
                docs.append(batch.column("_id").slice(first + a, b - a))
                sizes.append(counts[a:b])
                ids.append(out[upto[a] - counts[a] : upto[b - 1]])
                n += len(ids[-1])
                a = b
                if n >= block_ids:
                    yield block()
    if docs:
        yield block()


def write(docs: DataFrame, file: str, at: str | None = None, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, special: bool = False, block_ids: int = BLOCK_IDS) -> str:
    """Write the ids of all texts in ascending order of their id as a table of blocks; returns its folder."""
    from pyspark.sql.pandas.types import to_arrow_schema

    at = at or folder(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text")).withColumn("_turn", F.xxhash64("_text"))
    order = ["_id", "_turn", F.col("_row")]
    rows = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select("_id", "_text", F.spark_partition_id().alias("_shard"))
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("docs", T.ArrayType(rows.schema["_id"].dataType)),
                           T.StructField("n_ids", T.LongType()), T.StructField("file", T.BinaryType())])
    blocks = rows.mapInArrow(partial(_blocks, file, special, end_id, block_ids, to_arrow_schema(schema)), schema)
    blocks.write.option("compression", "zstd").parquet(at)
    return at


def read(spark: SparkSession, at: str) -> DataFrame:
    """The blocks with the number of ids before each in `base`: running sums inside a shard, and over the list of shards."""
    blocks = spark.read.parquet(at)
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    shards = sums.select("shard", F.coalesce(F.sum("_n").over(before("shard")), F.lit(0)).alias("_base"))
    places = blocks.select("shard", "part", F.coalesce(F.sum("n_ids").over(before("shard", "part")), F.lit(0)).alias("_own")).join(shards, "shard")
    return places.select("shard", "part", (F.col("_base") + F.col("_own")).alias("base"))


def _digests(schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            block = Block(memoryview(batch.column("file")[i].as_buffer()))
            docs = batch.column("docs")[i].values
            starts = block.starts(np.arange(block.n_docs + 1))
            sums = [zlib.crc32(block.ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts[:-1], starts[1:], strict=True)]
            n = block.n_docs
            cols = [pa.repeat(batch.column("shard")[i], n), pa.repeat(batch.column("part")[i], n), docs, pa.array(starts[:-1]), pa.array(np.diff(starts)), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(cols, schema, strict=True)], names=schema.names)


def digest(spark: SparkSession, at: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the blocks alone. Blocks stay where they are; rows of the digest meet their base."""
    from pyspark.sql.pandas.types import to_arrow_schema

    blocks = spark.read.parquet(at)
    kind = blocks.schema["docs"].dataType.elementType
    long = T.LongType()
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("doc_id", kind), *[T.StructField(c, long) for c in ("_at", "n_tokens", "ids_crc32")]])
    rows = blocks.select("shard", "part", "docs", "file").mapInArrow(partial(_digests, to_arrow_schema(schema)), schema)
    return rows.join(read(spark, at), ["shard", "part"]).select("doc_id", (F.col("base") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32")

"""Ranked lexical search over a length-stratified index (operator 11).

Documents with the same normaliser m (a function of their length) form a stratum. A block of the index holds some thousand
documents of neighbouring strata; its postings stand by term, stratum and falling tf, so what a term adds to a score depends on
(stratum, tf) alone and is computed once for each such group. The first group of a term in a stratum gives the term's largest
addition there, and their weighted sum bounds every score of the stratum. A query visits the strata of a block in the order of that
bound and stops at the first that cannot reach its floor: the k-th best of the scores that a first pass took from the best stratum of
each block (some documents of each, as all blocks together give k), or the k-th best of this block. Scores are whole numbers and exact.

The length histogram (by the 8 leading bits of the length, so of bounded size) deals documents out by length and splits a length
that many share; nothing is sorted or sampled. Postings are kept for the terms of the queries if these are at most VOCABULARY
(32 MB in each task), else for all terms; both give the same results. Queries go to the tasks in blocks of about QUERY_TERMS terms.

Terms are told apart by 64-bit hashes: a query term meets another term of the corpus with probability (distinct terms) / 2 ** 64.

Edge cases: a NULL or empty text has no terms and is no document; a NULL doc_id is a document (last among equal scores); rows that
repeat a doc_id are documents of their own; queries that repeat an item_id (or have none) are one query with all their terms; a term of
weight 0 (in every document) adds nothing; an empty table of documents or queries gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeworks.functions.shared import folder, stored
from tapeworks.llm.common import LOWER, pieces, word_hashes, word_spans

TOP = 10
GAPS = np.ones(256, bool)  # bytes outside terms: all of ASCII but digits and letters
GAPS[128:] = GAPS[48:58] = GAPS[65:91] = GAPS[97:123] = False
TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
VOCABULARY = 1 << 22
QUERY_TERMS = 1 << 20
PART_TERMS = 1 << 21  # terms of the texts of one part of the index
DOC_COST = 200  # a document counts as so many terms more when they are dealt out
BLOCK_DOCS, BLOCK_POSTINGS = 8192, 1 << 20
LENGTH_BITS = 8
SCALE = 1_000_000_000


def normaliser(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """m of documents with n terms in a corpus of `docs` documents and `terms` terms."""
    return 100 - 75 + np.array([75 * int(x) * docs // terms for x in n], np.int64)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return SCALE * tf // (1000 * tf + 8 * m)


def _spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every term of the texts."""
    row, begin, end = word_spans(data, at, GAPS)
    return row, word_hashes(LOWER[data], begin, end).view(np.int64)


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, at in pieces(batch, "_text"):
            n = np.bincount(word_spans(data, at, GAPS)[0], minlength=end - first).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(_coarse(n))], names=["n", "bin"])


def _coarse(n: np.ndarray) -> np.ndarray:
    """n with all but its leading bits cleared."""
    drop = np.maximum(np.ceil(np.log2(np.maximum(n, 1) + 1)).astype(np.int64) - LENGTH_BITS, 0)
    return n >> drop << drop


def _counted(row: np.ndarray, h: np.ndarray, vocabulary: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of the distinct terms of each row, only those of the vocabulary if there is one."""
    if vocabulary is None:
        vocabulary, place = np.unique(h, return_inverse=True)
    else:
        place = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1) if len(vocabulary) else np.zeros(len(h), np.int64)
        known = vocabulary[place] == h if len(vocabulary) else np.zeros(len(h), bool)
        row, place = row[known], place[known]
    key, count = np.unique(row.astype(np.int64) * max(len(vocabulary), 1) + place, return_counts=True)
    return key // max(len(vocabulary), 1), vocabulary[key % max(len(vocabulary), 1)] if len(key) else np.zeros(0, np.int64), count


def _forward(vocabulary: np.ndarray | None, bins: np.ndarray, first: np.ndarray, last: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document with a term of the vocabulary: its part of the index, length, terms and their counts."""
    for batch in batches:
        for a, b, data, at in pieces(batch, "_text"):
            row, h = _spans(data, at)
            n = np.bincount(row, minlength=b - a)
            doc, term, tf = _counted(row, h, vocabulary)
            docs, begin = np.unique(doc, return_index=True)
            cell = np.searchsorted(bins, _coarse(n[docs]))
            part = first[cell] + batch.column("_deal").slice(a, b - a).to_numpy()[docs] % (last[cell] - first[cell] + 1)
            ends = pa.array(np.append(begin, len(doc)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(n[docs], pa.int64()), batch.column("_id").slice(a, b - a).take(pa.array(docs)), pa.ListArray.from_arrays(ends, pa.array(term)), pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32()))],
                names=["part", "n", "doc_id", "terms", "tfs"])


def _one(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _block(rows: pa.Table, docs: int, terms: int) -> pa.RecordBatch:
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("doc_id", "ascending")])).combine_chunks()  # NULLs last; ordinals follow the id
    ids, t, f = (rows.column(c).combine_chunks() for c in ("doc_id", "terms", "tfs"))
    own = np.repeat(np.arange(len(rows)), np.diff(t.offsets.to_numpy()))
    term, tf = t.flatten().to_numpy(), f.flatten().to_numpy().astype(np.int64)
    lengths, of = np.unique(rows.column("n").to_numpy(), return_inverse=True)
    m = normaliser(lengths, docs, terms)[of][own]
    order = np.lexsort((own, -tf, m, term))
    own, term, tf, m = own[order], term[order], tf[order], m[order]
    new_term = np.append(True, term[1:] != term[:-1])
    new = new_term | np.append(True, (m[1:] != m[:-1]) | (tf[1:] != tf[:-1]))
    groups, heads = np.flatnonzero(new), np.flatnonzero(new_term)
    term_at = np.append(np.searchsorted(groups, heads), len(groups))
    long, integer = pa.int64(), pa.int32()
    cols = [pa.ListArray.from_arrays(pa.array([0, len(ids)], integer), ids), _one(term[heads], long), _one(np.diff(np.append(heads, len(term))), integer), _one(term_at, integer),
            _one(m[groups], long), _one(tf[groups], integer), _one(np.append(groups, len(term)), integer), _one(own, integer)]
    return pa.RecordBatch.from_arrays(cols, names=["docs", "terms", "dfs", "term_at", "m", "tf", "group_at", "postings"])


def _blocks(docs: int, terms: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows that come by length."""
    held, n_docs, n_postings = [], 0, 0
    for batch in batches:
        sizes = np.cumsum(np.diff(batch.column("terms").offsets.to_numpy()))
        a = 0
        while a < batch.num_rows:
            room = np.searchsorted(sizes, (sizes[a - 1] if a else 0) + BLOCK_POSTINGS - n_postings, "left") + 1
            b = int(min(max(room, a + 1), a + BLOCK_DOCS - n_docs, batch.num_rows))
            held.append(batch.slice(a, b - a))
            n_docs, n_postings = n_docs + b - a, n_postings + int(sizes[b - 1] - (sizes[a - 1] if a else 0))
            a = b
            if n_docs >= BLOCK_DOCS or n_postings >= BLOCK_POSTINGS:
                yield _block(pa.Table.from_batches(held), docs, terms)
                held, n_docs, n_postings = [], 0, 0
    if held:
        yield _block(pa.Table.from_batches(held), docs, terms)


class Index:
    """Blocks of postings (a table of the shared folder), the numbers of documents and terms."""

    def __init__(self, blocks: DataFrame, docs: int, terms: int):
        self.blocks, self.docs, self.terms = blocks, docs, terms


def build(docs: DataFrame, vocabulary: np.ndarray | None = None, doc_id: str = "doc_id", text: str = "text") -> Index:
    """The index of all documents: of the terms whose hashes are in the (sorted) vocabulary, or of all terms."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text"))
    lengths = rows.select("_text").mapInArrow(_lengths, "n long, bin long").where("n > 0")
    bins = sorted(tuple(r) for r in lengths.groupBy("bin").agg(F.count(F.lit(1)), F.sum("n")).collect())  # at most 2 ** LENGTH_BITS rows for each doubling
    n_docs, n_terms = sum(r[1] for r in bins), sum(r[2] for r in bins)
    parts = max(-(-n_terms // PART_TERMS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    upto = np.cumsum([r[2] + DOC_COST * r[1] for r in bins]) if bins else np.ones(1, np.int64)
    first = np.concatenate([[0], upto[:-1]]) * parts // upto[-1]
    last = (upto - 1) * parts // upto[-1]
    kind = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("doc_id", rows.schema["_id"].dataType), T.StructField("terms", T.ArrayType(T.LongType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))])
    dealt = rows.withColumn("_deal", F.pmod(F.xxhash64("_id", F.monotonically_increasing_id()), F.lit(1 << 40)))
    dealt = dealt.mapInArrow(partial(_forward, vocabulary, np.array([r[0] for r in bins], np.int64), first, last), kind)
    dealt = dealt.repartitionById(parts, "part").sortWithinPartitions("n").select("n", "doc_id", "terms", "tfs")
    longs, ints = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())
    block = T.StructType([T.StructField("docs", T.ArrayType(kind["doc_id"].dataType)), *[T.StructField(c, longs if c in ("terms", "m") else ints) for c in ("terms", "dfs", "term_at", "m", "tf", "group_at", "postings")]])
    return Index(stored(dealt.mapInArrow(partial(_blocks, n_docs, n_terms), block)), n_docs, n_terms)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, at in pieces(batch, "_text"):
            row, term, count = _counted(*_spans(data, at), None)
            yield pa.RecordBatch.from_arrays([batch.column("item_id").slice(a, b - a).take(pa.array(row)), pa.array(term, pa.int64()), pa.array(count, pa.int64())], names=["item_id", "term", "count"])


def query_terms(queries: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term, count) of all queries."""
    rows = queries.select(F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("_text"))
    kind = T.StructType([rows.schema["item_id"], T.StructField("term", T.LongType()), T.StructField("count", T.LongType())])
    return stored(rows.mapInArrow(_asked, kind).groupBy("item_id", "term").agg(F.sum("count").alias("count")))


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = end - begin
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class _Block:
    """One block, with what each group adds and the largest addition of each term in each stratum."""

    def __init__(self, row: dict[str, np.ndarray], n_docs: int):
        self.terms, self.term_at, self.group_at, self.postings, self.n_docs = row["terms"], row["term_at"], row["group_at"], row["postings"], n_docs
        self.adds = impact(row["tf"].astype(np.int64), row["m"])
        self.n_strata, self.stratum = (lambda u: (len(u[0]), u[1]))(np.unique(row["m"], return_inverse=True))
        new = np.ones(len(row["m"]), bool)
        new[1:] = row["m"][1:] != row["m"][:-1]
        new[self.term_at[:-1]] = True
        self.lead = np.flatnonzero(new)
        self.lead_at = np.searchsorted(self.lead, self.term_at)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: int, first_only: bool) -> tuple[np.ndarray, np.ndarray, int]:
        """(ordinals, scores) of the k best documents with at least `floor`, by falling score, then ordinal; and how many strata were visited."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        here = self.terms[at] == terms
        at, weights = at[here], weights[here]
        best, score, visits = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        a, b = self.lead_at[at], self.lead_at[at + 1]
        lead = self.lead[_ranges(a, b)]
        bound = np.zeros(self.n_strata, np.int64)
        np.add.at(bound, self.stratum[lead], np.repeat(weights, b - a) * self.adds[lead])
        turn = np.flatnonzero(bound >= max(floor, 1))
        turn = turn[np.argsort(-bound[turn], kind="stable")]
        a, b = self.term_at[at], self.term_at[at + 1]
        group, weight = _ranges(a, b), np.repeat(weights, b - a)
        step = 1
        while visits < len(turn) and not (len(best) == k and bound[turn[visits]] < score[-1]):
            visited = np.zeros(self.n_strata, bool)
            visited[turn[visits : visits + step]] = True
            some = visited[self.stratum[group]]
            g, w = group[some], weight[some]
            total = np.zeros(self.n_docs, np.int64)
            np.add.at(total, self.postings[_ranges(self.group_at[g], self.group_at[g + 1])], np.repeat(w * self.adds[g], self.group_at[g + 1] - self.group_at[g]))
            found = np.flatnonzero(total >= max(floor, 1))
            best, score = np.concatenate([best, found]), np.concatenate([score, total[found]])
            keep = np.lexsort((best, -score))[:k]
            best, score = best[keep], score[keep]
            visits, step = visits + step, 4 * step
            if first_only:
                break
        return best, score, visits


def _search(queries: list[tuple[np.ndarray, np.ndarray]], floors: np.ndarray, k: int, first_only: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].values.to_numpy() for c in ("terms", "term_at", "m", "tf", "group_at", "postings")}
            docs = batch.column("docs")[i].values
            block, who, which, what = _Block(row, len(docs)), [], [], []
            for q, (terms, weights) in enumerate(queries):
                best, score, _ = block.search(terms, weights, k, int(floors[q]), first_only)
                who.append(np.full(len(best), q))
                which.append(best)
                what.append(score)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(who), pa.int32()), docs.take(pa.array(np.concatenate(which))), pa.array(np.concatenate(what))], names=["q", "doc_id", "score"])


def search(index: Index, asked: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each query (item_id, term, count)."""
    spark = asked.sparkSession
    counted = F.explode(F.arrays_zip("terms", "dfs"))
    dfs = index.blocks.select(counted.alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.dfs").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.docs + 2) / (2 * F.col("df") + 1))) * F.col("count")
    packed = stored(asked.join(dfs, "term").withColumn("w", weight).where("w > 0").groupBy("item_id").agg(F.collect_list(F.struct("term", "w")).alias("terms")))  # of one query
    kind = T.StructType([T.StructField("q", T.IntegerType()), T.StructField("doc_id", index.blocks.schema["docs"].dataType.elementType), T.StructField("score", T.LongType())])
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    at, done, n_blocks = folder(spark), 0, max(index.blocks.count(), 1)

    def answer(items: list, queries: list[tuple[np.ndarray, np.ndarray]]) -> None:
        run = lambda floors, each, first: index.blocks.mapInArrow(partial(_search, queries, floors, each, first), kind).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        floors = np.zeros(len(queries), np.int64)
        for r in run(floors, min(max(4 * k // n_blocks, 1), k), True).where(F.col("rank") == k).select("q", "score").collect():
            floors[r[0]] = r[1]
        names = spark.createDataFrame(list(enumerate(items)), T.StructType([T.StructField("q", T.IntegerType()), asked.schema["item_id"]]))
        run(floors, k, False).join(names, "q").select("item_id", "rank", "doc_id", "score").write.parquet(f"{at}/block={done}")

    items, queries, held = [], [], 0
    for r in packed.toLocalIterator():
        items.append(r["item_id"])
        queries.append((np.array([x[0] for x in r["terms"]], np.int64), np.array([x[1] for x in r["terms"]], np.int64)))
        held += len(r["terms"])
        if held >= QUERY_TERMS:
            answer(items, queries)
            items, queries, held, done = [], [], 0, done + 1
    answer(items, queries)
    return spark.read.parquet(at).select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, queries: DataFrame, k: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The k best documents of each query: index of the queries' terms and search."""
    asked = query_terms(queries, item_id, item_text)
    terms = asked.select("term").distinct()
    few = terms.limit(VOCABULARY + 1).count() <= VOCABULARY
    vocabulary = np.sort(terms.toArrow().column("term").to_numpy()) if few else None
    return search(build(docs, vocabulary, doc_id, text), asked, k)


_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = f"""
with d as materialized (select doc_id, row_number() over () as rid, regexp_extract_all(translate(text, '{_UPPER}', '{_LOW}'), '{TERM}') as t from documents where text is not null),
c as materialized (select doc_id, rid, len(t) as n, t from d where len(t) > 0),
k as (select count(*) as docs, cast(sum(n) as bigint) as terms from c),
q as materialized (select item_id, term, count(*) as times from (select item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOW}'), '{TERM}')) as term from benchmark) group by item_id, term),
p as materialized (select rid, term, count(*) as tf from (select rid, unnest(t) as term from c) where term in (select term from q) group by rid, term),
w as (select term, cast(floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)::double)) as bigint) as w from p, k group by term),
s as (select item_id, rid, sum(w * times * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) as score from q join w using (term) join p using (term) join c using (rid), k group by item_id, rid)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id nulls last) as integer) as rank, doc_id, cast(score as bigint) as score from s join c using (rid) where score > 0
qualify row_number() over (partition by item_id order by score desc, doc_id nulls last) <= {TOP}
"""

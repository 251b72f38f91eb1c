"""Vector code compression by product codebooks, fitted by a member-resident Lloyd (operator 12).

Every component becomes floor(scale * x); a vector is cut into equal consecutive parts, each with a codebook of its own. The parts
are members of owners (position, entry, salt): the first assignment deals them out, and an owner's members are written as a file
of the shared folder, where they stay. A round sends the new codebooks (parts x entries whole vectors, of fixed size) to the owners;
each assigns its members again, gives out the sums of those that stay, and only members that change their entry go through the
shuffle, to be written with their new owner as the next generation. Which members of older generations have left follows
from the codebooks of the rounds since, so nothing is written twice and no list of the departed is kept. New entries are the
floors of sum / count over the owners' sums and the arrivals; sums are exact, so results do not depend on the dealing, on
reruns or on lost executors. The salt spreads an entry that holds most members (copies of one vector).

`encode` assigns vectors to given codebooks, without a shuffle.

Edge cases: a vector that is NULL, or holds a NULL or non-finite component, takes no part; a shorter vector counts as ending in
zeros, and zeros fill the last part where the length is no multiple of the parts; fewer kept rows than entries give that many
entries; rows that repeat an id are rows of their own (the first entries take them by id, then vector, NULL ids last); a NULL
label is a label like any other; an empty table gives no rows; other columns are ignored, whatever their names. Squared distances must
fit 64 bits: components below 2 ** 28 in size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.functions.shared import stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096.0
OWNED = 4096  # members for each salt: an entry with all of a position's members is spread over count / OWNED owners
TOGETHER = 1 << 14  # members assigned in one step
MEMBER = "position int, entry int, salt int, n long, v array<long>"


def grid(vectors: DataFrame, embedding: str = "embedding", scale: float = SCALE, **kept: Column) -> DataFrame:
    """`kept` columns and v, floor(scale * x) of each component, of the vectors that take part."""
    e = F.col(embedding)
    usable = e.isNotNull() & F.forall(e, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return vectors.where(usable).select(*[c.alias(k) for k, c in kept.items()], F.transform(e, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as rows that end in zeros."""
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < np.diff(lists.offsets.to_numpy())[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row's nearest entry, the lower of equal ones."""
    entry, square = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for i in range(0, len(x), TOGETHER):
        d = ((x[i : i + TOGETHER, None, :] - book) ** 2).sum(2)
        entry[i : i + TOGETHER], square[i : i + TOGETHER] = d.argmin(1), d.min(1)
    return entry, square


def _members(position: np.ndarray, entry: np.ndarray, salt: np.ndarray, n: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (position, entry, salt)] + [pa.array(n.astype(np.int64)), lists(v)], names=["position", "entry", "salt", "n", "v"])


def _deal(books: np.ndarray, salts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of all vectors with their first entry; n = 0 marks a member."""
    parts, _, width = books.shape
    for batch in batches:
        x = matrix(batch.column("v"), parts * width).reshape(-1, parts, width)
        salt = batch.column("_salt").to_numpy() % salts
        for p in range(parts):
            yield _members(np.full(len(x), p), nearest(x[:, p], books[p])[0], salt, np.zeros(len(x)), x[:, p])


def _move(history: list[np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of one generation, present since history[0] was left behind: those that change their entry with the last codebooks
    (n = 0), and at the end count and sum of those that stay (n > 0). Members that an earlier round sent away are passed over."""
    parts, entries, width = history[-1].shape
    sums, count, some = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64), 0
    for batch in batches:
        position, entry, salt = (batch.column(c).to_numpy() for c in ("position", "entry", "salt"))
        v, out = matrix(batch.column("v"), width), []
        for p in range(parts):
            own = np.flatnonzero(position == p)
            for books in history[:-1]:
                own = own[nearest(v[own], books[p])[0] == entry[own]]
            now = nearest(v[own], history[-1][p])[0]
            stay = now == entry[own]
            gone = own[~stay]
            out.append((np.full(len(gone), p), now[~stay], salt[gone], np.zeros(len(gone)), v[gone]))
            np.add.at(sums[p], now[stay], v[own[stay]])
            count[p] += np.bincount(now[stay], minlength=entries)
        some = int(salt[0]) if len(salt) else some
        yield _members(*[np.concatenate(c) for c in zip(*out, strict=True)])
    p, e = np.nonzero(count)
    yield _members(p, e, np.full(len(p), some), count[p, e], sums[p, e])


def _owners(rows: DataFrame) -> DataFrame:
    return stored(rows.repartition("position", "entry", "salt"))


def _sums(rows: DataFrame, width: int) -> dict[tuple[int, int], tuple[int, np.ndarray]]:
    """(position, entry) -> count and sum; a row for each entry reaches the driver."""
    x = [F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(width)]
    got = rows.groupBy("position", "entry").agg(F.sum(F.greatest("n", F.lit(1))).alias("n"), *x).collect()
    return {(r["position"], r["entry"]): (r["n"], np.array(r[3:], np.int64)) for r in got}


def fit(rows: DataFrame, order: Column | None = None, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, width) of rows (v), starting from the first `entries` rows by `order` and then v."""
    n, longest = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    width = max(-(-(longest or 0) // parts), 1)
    first = rows.orderBy(*([order] if order is not None else []), "v").limit(entries).select("v").collect()
    if not first:
        return np.zeros((parts, 0, width), np.int64)
    flat = np.zeros((len(first), parts * width), np.int64)
    for i, r in enumerate(first):
        flat[i, : len(r[0])] = r[0]
    books = [flat.reshape(-1, parts, width).transpose(1, 0, 2).copy()]
    salts = -(-n * parts // OWNED)
    dealt = rows.select(F.pmod(F.xxhash64("v", F.monotonically_increasing_id()), F.lit(1 << 30)).cast("int").alias("_salt"), "v")
    generations = [_owners(dealt.mapInArrow(partial(_deal, books[0], salts), MEMBER))]
    sums = _sums(generations[0], width)
    for r in range(1, rounds + 1):
        new = books[-1].copy()
        for (p, e), (count, total) in sums.items():
            new[p, e] = np.floor_divide(total, count)
        books.append(new)
        if r == rounds:
            break
        moved = None
        for g, members in enumerate(generations):  # generation g came with books[g]
            some = members.where("n = 0").mapInArrow(partial(_move, books[g + 1 :]), MEMBER)
            moved = some if moved is None else moved.unionByName(some)
        generations.append(_owners(moved))
        sums = _sums(generations[-1], width)
    return books[-1]


def _assign(books: np.ndarray, names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, _, width = books.shape
    digits = np.array([f"{i:02x}" for i in range(books.shape[1])])
    for batch in batches:
        x = matrix(batch.column("v"), parts * width).reshape(-1, parts, width)
        code, error = np.full(len(x), "", "U1"), np.zeros(len(x), np.int64)
        for p in range(parts):
            entry, square = nearest(x[:, p], books[p])
            code, error = np.char.add(code, digits[entry]), error + square
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(code.tolist(), pa.string()), pa.array(error)], names=[*names, "code", "error"])


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """rows with v replaced by code (two hex digits for each part) and error (squared distances summed)."""
    from pyspark.sql import types as T

    names = [c for c in rows.columns if c != "v"]
    schema = T.StructType([*[rows.schema[c] for c in names], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not books.shape[1]:
        return rows.sparkSession.createDataFrame([], schema)
    return rows.mapInArrow(partial(_assign, books, names), schema)


def books_hash(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", scale: float = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector that takes part."""
    rows = stored(grid(vectors, embedding, scale, vec_id=F.col(vec_id), label=F.col(label)))
    books = fit(rows, F.col("vec_id").asc_nulls_last(), parts, entries, rounds)
    coded = stored(encode(rows, books))
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    both = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(books_hash(books)).alias("codebooks_sha256"))


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> str:
    """The same in DuckDB SQL: rounds written out one after another."""
    books, steps = "b0", []
    near = """(select rid, p, e, d from (select x.rid, x.p, b.e, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d
      from x join {} b on x.p = b.p) qualify row_number() over (partition by rid, p order by d, e) = 1)"""
    for r in range(rounds):
        steps.append(f"""a{r} as materialized {near.format(books)}, s{r} as materialized (select a.p, a.e, i, floor(sum(x.v[i]) / count(*)) as v from a{r} a join x on x.rid = a.rid and x.p = a.p, w, range(1, w + 1) t(i) group by a.p, a.e, i),
      b{r + 1} as materialized (select b.p, b.e, coalesce(n.v, b.v) as v from {books} b left join (select p, e, list(cast(v as bigint) order by i) as v from s{r} group by p, e) n on b.p = n.p and b.e = n.e)""")
        books = f"b{r + 1}"
    return f"""
with g as materialized (select *, row_number() over (order by vec_id nulls last, v) as rid from (select vec_id, label, [cast(floor({int(scale)} * cast(x as double)) as bigint) for x in embedding] as v from embeddings
  where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0)),
w as materialized (select cast(greatest(ceil(max(len(v)) / {parts}.0), 1) as bigint) as w from g),
x as materialized (select rid, p, list_transform(range(p * w + 1, p * w + w + 1), lambda i: coalesce(v[i], 0)) as v from g, w, range({parts}) t(p)),
b0 as materialized (select p, rid - 1 as e, v from x where rid <= {entries}), {", ".join(steps)},
f as materialized {near.format(books)},
c as (select rid, string_agg(printf('%02x', e), '' order by p) as code, cast(sum(d) as bigint) as error from f group by rid),
h as (select sha256(string_agg(cast(y as varchar), ',' order by p, e, i)) as codebooks_sha256 from (select p, e, unnest(v) as y, generate_subscripts(v, 1) as i from {books}))
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from g join c using (rid), h
"""

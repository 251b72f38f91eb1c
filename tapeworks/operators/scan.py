"""Ordered scans and as-of lookups that stay parallel when one group holds most of the rows.

A plain window over (day, ticker) puts a whole stock-day into one task. Here every group is cut into
pieces on its own ordering column (row position or clock time); the pieces are summarised by a map-side
aggregate, the small summaries are scanned, and each piece starts from the value carried into it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tapeworks.functions.shared import cut, stored  # noqa: F401

CHUNK_ROWS = 1_000_000  # row positions per piece; a piece holds at most this many rows of a group
SLOT_SECONDS = 900.0  # clock seconds per as-of piece
SLOT_ROWS = 1 << 18  # states per as-of piece, where a slot holds far more


def one_piece(df: DataFrame, seq: str, chunk_rows: int = CHUNK_ROWS) -> bool:
    """Do all rows fall into one piece? One aggregate of one column."""
    lo, hi = df.agg(F.min(seq), F.max(seq)).first()
    return lo is None or lo // chunk_rows == hi // chunk_rows


def _beyond(by: Sequence[str], seq: str) -> WindowSpec:
    """All later rows of the group, nearest last: read backwards, a frame grows by one row a step. The same frame read forwards
    (1 to unboundedFollowing) is gone through anew for every row, which is quadratic in the group."""
    return Window.partitionBy(*by).orderBy(F.desc(seq)).rowsBetween(Window.unboundedPreceding, -1)


def _plain_scan(df: DataFrame, by: list[str], seq: str, sums: dict, lags: dict, leads: dict, ffill: dict, bfill: dict) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(seq)
    upto, beyond = w.rowsBetween(Window.unboundedPreceding, 0), _beyond(by, seq)
    out = {n: F.coalesce(F.sum(e).over(upto), F.lit(0)) for n, e in sums.items()}
    out |= {n: F.lag(e).over(w) for n, e in lags.items()} | {n: F.lead(e).over(w) for n, e in leads.items()}
    out |= {n: F.last(e, ignorenulls=True).over(upto) for n, e in ffill.items()} | {n: F.last(e, ignorenulls=True).over(beyond) for n, e in bfill.items()}
    kept = [x for x in df.columns if x not in out]
    return df.withColumns({f"_out_{n}": e for n, e in out.items()}).select(*kept, *[F.col(f"_out_{n}").alias(n) for n in out])


def ordered_scan(
    df: DataFrame,
    by: Sequence[str],
    seq: str,
    *,
    sums: dict[str, Column] | None = None,
    lags: dict[str, Column] | None = None,
    leads: dict[str, Column] | None = None,
    ffill: dict[str, Column] | None = None,
    bfill: dict[str, Column] | None = None,
    chunk_rows: int = CHUNK_ROWS,
    short: bool | None = None,
) -> DataFrame:
    """Add running values per group `by` in the order of `seq` (an integer, unique within the group).

    sums: running sum including the row. lags / leads: value of the previous / next row.
    ffill: last non-NULL value at or before the row. bfill: first non-NULL value strictly after it.
    short: whether no group has rows in two pieces, so that plain windows do; None: seen from the range of `seq`.
    """
    if one_piece(df, seq, chunk_rows) if short is None else short:
        return _plain_scan(df, list(by), seq, sums or {}, lags or {}, leads or {}, ffill or {}, bfill or {})
    sums, lags, leads = sums or {}, lags or {}, leads or {}
    ffill, bfill = ffill or {}, bfill or {}
    by = list(by)
    keys = [*by, "_piece"]
    temp = {}
    for kind, cols in (("s", sums), ("p", lags), ("n", leads), ("f", ffill), ("b", bfill)):
        for name, e in cols.items():
            temp[f"_{kind}_{name}"] = e
    base = df.withColumns({"_piece": F.floor(F.col(seq) / F.lit(chunk_rows)), **temp})

    agg = [F.sum(f"_s_{n}").alias(f"_s_{n}") for n in sums]
    if lags:
        agg.append(F.max_by(F.struct(*[F.col(f"_p_{n}").alias(n) for n in lags]), seq).alias("_tail"))
    if leads:
        agg.append(F.min_by(F.struct(*[F.col(f"_n_{n}").alias(n) for n in leads]), seq).alias("_head"))
    known = lambda col: F.when(F.col(col).isNotNull(), F.col(seq))
    agg += [F.max_by(f"_f_{n}", known(f"_f_{n}")).alias(f"_f_{n}") for n in ffill]
    agg += [F.min_by(f"_b_{n}", known(f"_b_{n}")).alias(f"_b_{n}") for n in bfill]

    w = Window.partitionBy(*by).orderBy("_piece")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    after = _beyond(by, "_piece")
    carry = [F.sum(f"_s_{n}").over(before).alias(f"_cs_{n}") for n in sums]
    carry += [F.lag("_tail").over(w).alias("_tail")] if lags else []
    carry += [F.lead("_head").over(w).alias("_head")] if leads else []
    carry += [F.last(f"_f_{n}", ignorenulls=True).over(before).alias(f"_cf_{n}") for n in ffill]
    carry += [F.last(f"_b_{n}", ignorenulls=True).over(after).alias(f"_cb_{n}") for n in bfill]
    summary = base.groupBy(*keys).agg(*agg).select(*keys, *carry)

    joined = base.join(summary, keys, "left")
    wi = Window.partitionBy(*keys).orderBy(seq)
    upto = wi.rowsBetween(Window.unboundedPreceding, 0)
    beyond = _beyond(keys, seq)
    out: dict[str, Column] = {}
    for n in sums:
        out[n] = F.coalesce(F.sum(f"_s_{n}").over(upto), F.lit(0)) + F.coalesce(F.col(f"_cs_{n}"), F.lit(0))
    if lags:
        prev = F.lag(F.struct(*[F.col(f"_p_{n}").alias(n) for n in lags])).over(wi)
        out["_prev"] = F.coalesce(prev, F.col("_tail"))
    if leads:
        nxt = F.lead(F.struct(*[F.col(f"_n_{n}").alias(n) for n in leads])).over(wi)
        out["_next"] = F.coalesce(nxt, F.col("_head"))
    for n in ffill:
        out[n] = F.coalesce(F.last(f"_f_{n}", ignorenulls=True).over(upto), F.col(f"_cf_{n}"))
    for n in bfill:
        out[n] = F.coalesce(F.last(f"_b_{n}", ignorenulls=True).over(beyond), F.col(f"_cb_{n}"))
    res = joined.withColumns(out)
    unpack = {n: F.col(f"_prev.{n}") for n in lags} | {n: F.col(f"_next.{n}") for n in leads}
    if unpack:
        res = res.withColumns(unpack)
    keep = [x for x in df.columns if x not in (sums | lags | leads | ffill | bfill)]
    return res.select(*keep, *sums, *lags, *leads, *ffill, *bfill)


CUT_SAMPLES = 16  # sampled states between two cuts of a crowded slot


def _cuts(st: DataFrame, keys: Sequence[str], slot_rows: int) -> DataFrame:
    """(keys, _cuts): for slots with far more than slot_rows states, places (time, seq) that cut them into pieces of about slot_rows.

    Every CUT_SAMPLES-th of a sample of one state in slot_rows / CUT_SAMPLES; the sample is drawn by hash, so reruns agree."""
    sampled = st.where(F.pmod(F.xxhash64("_s", "_t"), F.lit(max(slot_rows // CUT_SAMPLES, 1))) == 0)
    seen = sampled.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_t", "_s"))).alias("_seen"))
    cuts = F.filter("_seen", lambda c, i: (i > 0) & (i % CUT_SAMPLES == 0))
    return seen.where(F.size("_seen") >= 2 * CUT_SAMPLES).select(*keys, cuts.alias("_cuts"))


def asof(
    points: DataFrame,
    states: DataFrame,
    by: Sequence[str],
    at: str,
    time: str,
    seq: str,
    cols: dict[str, str],
    slot: float = SLOT_SECONDS,
    slot_rows: int = SLOT_ROWS,
) -> DataFrame:
    """Last state with `time` <= point's `at`, ties broken by `seq`; NULL columns before the first state.

    `cols` maps output names to state columns. One union and one shuffle on (group, clock slot); the state
    in effect at a slot's start comes from a per-slot aggregate, so no task sees more than one slot. A slot that holds
    far more than `slot_rows` states (half a day's rows in one second) is cut again, by places in the order of (time, seq).
    """
    by = list(by)
    pcols = [x for x in points.columns if x not in by]
    st = states.select(
        *by,
        F.floor(F.col(time) / slot).alias("_slot"),
        F.col(time).cast("double").alias("_t"),
        F.col(seq).cast("long").alias("_s"),
        F.struct(*[F.col(v).alias(k) for k, v in cols.items()]).alias("_st"),
    ).withColumns({"_k": F.lit(0)})
    pt = points.where(F.col(at).isNotNull()).select(
        *by,
        F.floor(F.col(at) / slot).alias("_slot"),
        F.col(at).cast("double").alias("_t"),
        F.lit(1).alias("_k"),
        F.struct(*pcols).alias("_pt"),
    )
    keys = [*by, "_slot", "_part"]
    crowded = _cuts(st.select(*by, "_slot", "_t", "_s"), keys[:-1], slot_rows)
    if crowded.isEmpty():
        u = st.unionByName(pt, allowMissingColumns=True).withColumn("_part", F.lit(0))
    else:
        crowded = stored(crowded)
        none = F.array().cast("array<struct<_t:double,_s:bigint>>")
        place = lambda d, before: d.join(crowded, keys[:-1], "left").withColumn("_part", F.size(F.filter(F.coalesce("_cuts", none), before))).drop("_cuts")
        st = place(st, lambda c: c <= F.struct(F.col("_t").alias("_t"), F.col("_s").alias("_s")))
        pt = place(pt, lambda c: c["_t"] <= F.col("_t"))  # behind all states of its time
        u = st.unionByName(pt, allowMissingColumns=True).repartition(*keys)
    w = Window.partitionBy(*keys).orderBy("_t", "_k", "_s").rowsBetween(Window.unboundedPreceding, 0)
    inside = (
        u.withColumn("_in", F.last("_st", ignorenulls=True).over(w))
        .where("_k = 1")
        .select(*keys, "_pt", "_in")
    )
    ends = u.groupBy(*keys).agg(F.max_by("_st", F.when(F.col("_k") == 0, F.struct("_t", "_s"))).alias("_end"))
    ws = Window.partitionBy(*by).orderBy("_slot", "_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*keys, F.last("_end", ignorenulls=True).over(ws).alias("_carry"))
    res = inside.join(carry, keys, "left").withColumn("_hit", F.coalesce("_in", "_carry"))
    return res.select(*by, *[F.col(f"_pt.{x}").alias(x) for x in pcols], *[F.col(f"_hit.{k}").alias(k) for k in cols])


def avg_rank(value: str, parts: Sequence[str]) -> Column:
    """Average rank of `value` within `parts` (ties share the mean position); NULL stays NULL."""
    w = Window.partitionBy(*parts).orderBy(F.col(value).asc_nulls_last())
    ties = Window.partitionBy(*parts, value)
    r = F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2.0
    return F.when(F.col(value).isNotNull(), r)


def islands(df: DataFrame, by: Sequence[str], seq: str, starts: Column, out: str = "island",
            chunk_rows: int = CHUNK_ROWS, short: bool | None = None) -> DataFrame:
    """Number the runs of a group: a new run begins where `starts` holds."""
    return ordered_scan(df, by, seq, sums={out: F.when(starts, 1).otherwise(0)}, chunk_rows=chunk_rows, short=short)


def with_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table (a global aggregate) to every row; a second row is an error. One row is safe to broadcast."""
    key = "_one_row"
    packed = row.agg(F.count(F.lit(1)).alias("_rows"), F.first(F.struct(*row.columns)).alias("_r"))
    one = packed.where((F.col("_rows") > 0) & F.assert_true(F.col("_rows") <= 1, F.lit("more than one row")).isNull())
    return df.withColumn(key, F.lit(1)).join(F.broadcast(one.select(F.lit(1).alias(key), "_r.*")), key).drop(key)


BINS = 4096


def quantiles(df: DataFrame, by: Sequence[str], value: str, probs: dict[str, float], bins: int = BINS) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per entry of `probs`, without holding a group.

    Values are binned on a monotone scale (asinh, so that outliers do not swallow the bins); only the bins
    that hold a wanted rank are ranked, on value counts.
    """
    by = list(by)
    x = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(
        *by, F.col(value).cast("double").alias("_v")
    )
    one = by or ["_all"]
    if not by:
        x = x.withColumn("_all", F.lit(1))
    span = x.groupBy(*one).agg(
        F.asinh(F.min("_v")).alias("_lo"), F.asinh(F.max("_v")).alias("_hi"), F.count(F.lit(1)).alias("_n")
    )
    width = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    slot = F.coalesce(F.floor((F.asinh("_v") - F.col("_lo")) / width * bins), F.lit(0))
    few = (lambda d: d) if by else F.broadcast  # without groups: one row, and two ranks per wanted quantile
    binned = x.join(few(span), one).select(*one, "_v", F.least(slot, F.lit(bins - 1)).alias("_bin"))
    hist = binned.groupBy(*one, "_bin").agg(F.count(F.lit(1)).alias("_c"))
    wb = Window.partitionBy(*one).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.withColumn("_upto", F.sum("_c").over(wb)).withColumn("_base", F.col("_upto") - F.col("_c"))
    want = span.select(
        *one, "_n",
        F.explode(F.array(*[
            F.struct(F.lit(k).alias("name"), ((F.col("_n") - 1) * F.lit(float(p))).alias("h")) for k, p in probs.items()
        ])).alias("_q"),
    ).select(*one, F.col("_q.name").alias("_name"), F.col("_q.h").alias("_h"))
    want = want.withColumn("_r", F.explode(F.array_distinct(F.array(F.floor("_h"), F.ceil("_h")))))
    rank_in = (F.col("_r") >= F.col("_base")) & (F.col("_r") < F.col("_upto"))
    target = hist.join(want, one).where(rank_in).select(*one, "_bin", "_base", "_name", "_h", "_r")
    needed = target.select(*one, "_bin", "_base").distinct()
    wv = Window.partitionBy(*one, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        binned.join(few(needed), [*one, "_bin"]).groupBy(*one, "_bin", "_base", "_v").agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_end", F.col("_base") + F.sum("_c").over(wv))
    )
    at = ranked.drop("_base").join(target, [*one, "_bin"]).where(
        (F.col("_r") < F.col("_end")) & (F.col("_r") >= F.col("_end") - F.col("_c"))
    )
    part = F.max(F.col("_h") - F.floor("_h"))
    got = at.groupBy(*one, "_name").agg((F.min("_v") + (F.max("_v") - F.min("_v")) * part).alias("_v"))  # of equal neighbours exactly their value
    wide = got.groupBy(*one).agg(*[F.max(F.when(F.col("_name") == k, F.col("_v"))).alias(k) for k in probs])
    return wide if by else wide.drop("_all")

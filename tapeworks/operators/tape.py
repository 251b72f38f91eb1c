"""Order events with their book states: validity intervals, averages, trades, consistency, facts.

A tape row is one message and the book after it: day, ticker, seq (row position), time (seconds), type
(1 submit, 2 cancel, 3 delete, 4 execute, 5 hidden, 6 cross, 7 halt), order_id, size, price, direction,
bid_price, bid_size, ask_price, ask_size, and `bids` / `asks` arrays of struct(price, size), best first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.mathx import div
from tapeworks.operators.scan import CHUNK_ROWS, SLOT_SECONDS, asof, cut, islands, ordered_scan

KEYS = ("day", "ticker")
TICK = 100  # price units per tick (prices are dollars x 10^4)
NO_PRICE = 9_999_999_999  # a missing level's price is plus or minus this
SESSION = (34_500.0, 57_300.0)  # 09:35 to 15:55
OPEN = 34_200.0
SPLIT = 45_900.0  # 12:45
ONE_TICK_SHARE = 0.5  # a stock whose spread is one tick more often than this is "large-tick"
MESSAGE_TYPES = {1: "submit", 2: "cancel", 3: "delete", 4: "execute", 5: "hidden", 6: "cross", 7: "halt"}


def _both_sides() -> Column:
    return (F.abs("bid_price") < NO_PRICE) & (F.abs("ask_price") < NO_PRICE)


def mid() -> Column:
    return F.when(_both_sides(), (F.col("bid_price") + F.col("ask_price")) / 2.0)


def spread() -> Column:
    return F.when(_both_sides(), (F.col("ask_price") - F.col("bid_price")).cast("double"))


def depth_best() -> Column:
    return (F.col("bid_size") + F.col("ask_size")) / 2.0


def in_session(session: Sequence[float], time: str = "time") -> Column:
    return (F.col(time) >= session[0]) & (F.col(time) < session[1])


def depth_at(levels: Column, price: Column) -> Column:
    """Displayed size at `price`, 0 if it is not a level."""
    here = F.filter(levels, lambda x: x["price"] == price)
    return F.aggregate(here, F.lit(0).cast("long"), lambda acc, x: acc + x["size"])


def in_view(levels: Column, side: Column, price: Column) -> Column:
    deepest = F.element_at(levels, -1)["price"]
    return F.when(side > 0, price >= deepest).otherwise(price <= deepest)


def with_durations(tape: DataFrame, session: Sequence[float] = SESSION, by: Sequence[str] = KEYS,
                   chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Seconds each state is in effect inside the session, as column `held`."""
    t = ordered_scan(tape, by, "seq", leads={"next_time": F.col("time")}, chunk_rows=chunk_rows)
    until = F.least(F.coalesce("next_time", F.lit(float(session[1]))), F.lit(float(session[1])))
    return t.withColumn("held", F.greatest(until - F.greatest("time", F.lit(float(session[0]))), F.lit(0.0)))


def weighted(x: Column, w: Column) -> Column:
    """Aggregate: weighted mean over rows with a finite value and a positive weight."""
    ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")) & (w > 0)
    return div(F.sum(F.when(ok, x * w)), F.sum(F.when(ok, w)))


def clock_grid(tape: DataFrame, start: float, last: float, step: float, by: Sequence[str] = KEYS,
               out: str = "t") -> DataFrame:
    """Clock times start, start + step, ... up to `last` for every group of the tape."""
    n = int((last - start) / step + 1e-9)
    return (
        tape.select(*by).distinct()
        .select(*by, F.explode(F.sequence(F.lit(0), F.lit(n))).alias("_i"))
        .select(*by, (F.lit(float(start)) + F.col("_i") * float(step)).alias(out))
    )


def with_area(tape: DataFrame, value: Column, by: Sequence[str] = KEYS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add `value` and `area`, the integral of the step function from the first state to the row."""
    t = ordered_scan(
        tape.withColumn("value", value.cast("double")), by, "seq",
        lags={"_pv": F.col("value"), "_pt": F.col("time")}, chunk_rows=chunk_rows,
    )
    step = F.coalesce(F.col("_pv") * (F.col("time") - F.col("_pt")), F.lit(0.0))
    return ordered_scan(t, by, "seq", sums={"area": step}, chunk_rows=chunk_rows).drop("_pv", "_pt")


def time_average(tape: DataFrame, intervals: DataFrame, value: Column, by: Sequence[str] = KEYS,
                 slot: float = SLOT_SECONDS, out: str = "average") -> DataFrame:
    """Clock-time average of a per-state value over each interval [lo, hi); NULL before the first state."""
    area = cut(with_area(tape, value, by).select(*by, "seq", "time", "value", "area"))
    ends = intervals.select(*by, "lo", "hi", F.explode(F.array("lo", "hi")).alias("t")).distinct()
    at = asof(ends, area, by, "t", "time", "seq", {"_v": "value", "_a": "area", "_from": "time"}, slot)
    filled = at.withColumn("_int", F.col("_a") + F.col("_v") * (F.col("t") - F.col("_from")))
    return filled.groupBy(*by, "lo", "hi").agg(
        div(
            F.max(F.when(F.col("t") == F.col("hi"), F.col("_int")))
            - F.max(F.when(F.col("t") == F.col("lo"), F.col("_int"))),
            F.col("hi") - F.col("lo"),
        ).alias(out)
    )


def consistency(tape: DataFrame, by: Sequence[str] = KEYS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per group and message type: rows that can be replayed against the book, and those that agree."""
    t = ordered_scan(
        tape, by, "seq",
        lags={"prev_bids": F.col("bids"), "prev_asks": F.col("asks")}, chunk_rows=chunk_rows,
    ).where(F.col("type").between(1, 4) & (F.abs("direction") == 1) & F.col("prev_bids").isNotNull())
    buy = F.col("direction") > 0
    now = F.when(buy, F.col("bids")).otherwise(F.col("asks"))
    was = F.when(buy, F.col("prev_bids")).otherwise(F.col("prev_asks"))
    d, p = F.col("direction"), F.col("price")
    t = t.withColumns({"_now": now, "_was": was})
    seen = in_view(F.col("_was"), d, p) & in_view(F.col("_now"), d, p)
    moved = depth_at(F.col("_now"), p) - depth_at(F.col("_was"), p)
    want = F.when(F.col("type") == 1, F.col("size")).otherwise(-F.col("size"))
    t = t.withColumns({"_seen": seen, "_ok": seen & (moved == want)})
    return t.groupBy(*by, "type").agg(
        F.count(F.lit(1)).alias("eligible"),
        F.sum(F.col("_seen").cast("long")).alias("checked"),
        F.sum(F.col("_ok").cast("long")).alias("passed"),
    )


def consistency_summary(checked: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    return checked.groupBy(*by).agg(
        F.sum("eligible").alias("eligible"), F.sum("checked").alias("checked"), F.sum("passed").alias("passed"),
        div(F.sum("passed"), F.sum("checked")).alias("pass_rate"),
        div(F.sum("checked"), F.sum("eligible")).alias("coverage"),
    )


def trades(tape: DataFrame, session: Sequence[float] = SESSION, by: Sequence[str] = KEYS,
           chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Visible executions grouped into trades: adjacent rows of equal time and direction."""
    t = ordered_scan(
        tape, by, "seq",
        lags={"_ptype": F.col("type"), "_ptime": F.col("time"), "_pdir": F.col("direction"), "mid_before": mid()},
        chunk_rows=chunk_rows,
    )
    same = (
        (F.col("_ptype") == 4) & (F.col("_ptime") == F.col("time")) & (F.col("_pdir") == F.col("direction"))
        & in_session(session, "_ptime")
    )
    ex = t.where((F.col("type") == 4) & in_session(session))
    runs = islands(ex, by, "seq", ~F.coalesce(same, F.lit(False)), chunk_rows=chunk_rows)
    return runs.groupBy(*by, "island").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"),
        F.min_by(-F.col("direction"), "seq").alias("sign"),
        F.sum("size").alias("size"),
        (F.sum(F.col("size") * F.col("price").cast("double")) / F.sum("size")).alias("vwap"),
        F.min("time").alias("time"),
        F.min_by("mid_before", "seq").alias("mid_before"),
    )


def autocorrelation(df: DataFrame, by: Sequence[str], order: str, value: str, lags: int = 10) -> DataFrame:
    """Sample autocorrelation at lags 1..lags with one common denominator, per group.

    Rows are numbered once; each row is paired with the next `lags` rows by an equi-join on position, cut
    into pieces by position so that no group sits in one task."""
    cov = lagged_products(df, by, order, value, lags)
    base = cov.where("k = 0").select(*by, F.col("g").alias("_g0"))
    return (
        cov.where("k > 0").join(base, list(by))
        .select(*by, F.col("k").alias("lag"), div("g", "_g0").alias("acf"))
    )


def positions(df: DataFrame, by: Sequence[str], order: str, out: str = "pos", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """0-based position of each row in the order of an integer column, without one task per group."""
    return ordered_scan(df, by, order, sums={"_n": F.lit(1)}, chunk_rows=chunk_rows).withColumn(
        out, F.col("_n") - 1
    ).drop("_n")


def lagged_products(df: DataFrame, by: Sequence[str], order: str, value: str, lags: int,
                    chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Sums g_k of centred products (x_i - m)(x_{i+k} - m), k = 0..lags, per group, with n and the mean.

    Pieces of consecutive positions carry an overlap of `lags` rows, so each product is formed in one piece.
    """
    by = list(by)
    numbered = positions(df.where(F.col(value).isNotNull()), by, order, "_pos", chunk_rows)
    m = numbered.groupBy(*by).agg(F.avg(value).alias("_m"), F.count(F.lit(1)).alias("n"))
    x = numbered.join(m, by).select(*by, "_pos", "n", "_m", (F.col(value) - F.col("_m")).alias("_x"))
    rows = max(chunk_rows, 10 * (lags + 1))
    home = F.floor(F.col("_pos") / rows)
    tail = F.floor((F.col("_pos") - lags) / rows)
    pieces = x.select(
        "*", F.explode(F.array_distinct(F.array(home, F.greatest(tail, F.lit(0))))).alias("_piece")
    ).withColumn("_own", F.col("_piece") == home)
    w = Window.partitionBy(*by, "_piece").orderBy("_pos")
    prods = [
        F.when(F.col("_own"), F.col("_x") * F.lead("_x", k).over(w) if k else F.col("_x") * F.col("_x")).alias(f"_g{k}")
        for k in range(lags + 1)
    ]
    sums = pieces.select(*by, "n", "_m", *prods).groupBy(*by).agg(
        F.first("n").alias("n"), F.first("_m").alias("mean"),
        *[F.coalesce(F.sum(f"_g{k}"), F.lit(0.0)).alias(f"_g{k}") for k in range(lags + 1)],
    )
    stacked = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_g{k}").alias("g")) for k in range(lags + 1)]))
    return sums.select(*by, "n", "mean", stacked.alias("_e")).select(*by, "n", "mean", "_e.k", "_e.g")


def facts(tape: DataFrame, session: Sequence[float] = SESSION, by: Sequence[str] = KEYS) -> DataFrame:
    """Stylised facts per group: clock-weighted price, spread and depth, activity, tick class."""
    t = with_durations(tape, session, by).withColumns({"_mid": mid(), "_spread": spread()})
    w, m, s = F.col("held"), F.col("_mid"), F.col("_spread")
    inside = in_session(session)
    one = F.when(s.isNotNull(), (s == TICK).cast("double")).otherwise(0.0)
    book = t.groupBy(*by).agg(
        (weighted(m, w) / 1e4).alias("mean_price"),
        weighted(div(F.lit(TICK * 1e4), m), w).alias("tick_bps"),
        weighted(s / TICK, w).alias("spread_ticks"),
        weighted(div(s, m) * 1e4, w).alias("spread_bps"),
        weighted(one, w).alias("share_one_tick"),
        weighted(depth_best(), w).alias("depth_best"),
        F.count_if(inside).alias("n_messages"),
        *[F.count_if(inside & (F.col("type") == k)).alias(f"n_{v}") for k, v in MESSAGE_TYPES.items()],
        F.coalesce(F.sum(F.when(inside & (F.col("type") == 4), F.col("size"))), F.lit(0)).alias("volume_visible"),
    )
    n = trades(tape, session, by).groupBy(*by).agg(F.count(F.lit(1)).alias("n_trades"))
    large = F.col("share_one_tick") > ONE_TICK_SHARE
    return (
        book.join(n, list(by), "left").fillna(0, ["n_trades"])
        .withColumn("tick_class", F.when(large, "large-tick").otherwise("small-tick"))
    )

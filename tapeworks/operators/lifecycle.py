"""From decoded exchange events to messages and books: order lifetimes, replace chains, depth, top levels.

Events: day, ticker, seq, ts_ns, msg (A F add, E C execute, X cancel, D delete, U replace, P hidden trade, Q cross,
H trading state), ref, new_ref, side (B/S), shares, price, state."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeworks.functions.shared import stored
from tapeworks.operators.scan import CHUNK_ROWS, cut, one_piece, ordered_scan
from tapeworks.operators.tape import KEYS, NO_PRICE

ALL_SHARES = 1 << 50
BOOK_STEPS = 1 << 17  # steps of a stock-day in one task
BOOK_BLOCK = 256  # messages in one table of sums
REDUCERS = ("E", "C", "X", "D", "U")
SESSION_NS = (34_200 * 10**9, 57_600 * 10**9)
HALT_PRICE = {"H": -1, "P": 0, "Q": 0, "T": 1}


def order_steps(events: DataFrame) -> DataFrame:
    """One row per step of an order: a replace ends the old order and starts the new one. `step` keeps the order."""
    e = events.where(F.col("msg").isin("A", "F", *REDUCERS))
    gives = F.struct(F.lit(0).alias("k"), F.col("ref").alias("ref"), F.lit(False).alias("starts"))
    takes = F.struct(F.lit(1).alias("k"), F.col("new_ref").alias("ref"), F.lit(True).alias("starts"))
    plain = F.struct(F.lit(0).alias("k"), F.col("ref").alias("ref"), F.col("msg").isin("A", "F").alias("starts"))
    arms = F.when(F.col("msg") == "U", F.array(gives, takes)).otherwise(F.array(plain))
    e = e.withColumn("_e", F.explode(arms)).drop("ref")
    take = F.when(F.col("_e.starts"), 0).when(F.col("msg").isin("D", "U"), ALL_SHARES).otherwise(F.col("shares"))
    return e.select("*", F.col("_e.ref").alias("ref"), F.col("_e.starts").alias("starts"), take.cast("long").alias("take"),
                    (F.col("seq") * 2 + F.col("_e.k")).alias("step")).drop("_e")


def lifetimes(events: DataFrame, by: Sequence[str] = ("day",), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Steps with the shares left before them, and the step that started the order (NULL: unknown reference)."""
    steps = stored(order_steps(events))
    return _lifetimes(steps, by, chunk_rows, one_piece(steps, "step", chunk_rows))


def _lifetimes(steps: DataFrame, by: Sequence[str], chunk_rows: int, short: bool) -> DataFrame:
    keys = [*by, "ref"]
    s = ordered_scan(steps, keys, "step", sums={"_cum": F.col("take")}, chunk_rows=chunk_rows, short=short)
    start = F.when(F.col("starts"), F.struct(F.col("shares").alias("shares"), F.col("price").alias("price"), F.col("side").alias("side"),
                                             F.col("_cum").alias("cum"), F.col("step").alias("step")))
    s = ordered_scan(s, keys, "step", ffill={"_start": start}, chunk_rows=chunk_rows, short=short)
    left = F.greatest(F.col("_start.shares") - (F.col("_cum") - F.col("take") - F.col("_start.cum")), F.lit(0))
    return s.withColumns({
        "left_before": F.when(~F.col("starts"), F.coalesce(left, F.lit(0))), "start_step": F.col("_start.step"),
        "order_price": F.col("_start.price"), "order_side": F.col("_start.side"),
    }).withColumn("matched", F.col("starts") | (F.col("left_before") > 0)).drop("_cum", "_start")


def shares_left(events: DataFrame, by: Sequence[str] = ("day",)) -> DataFrame:
    """Shares of each order after each of its steps."""
    s = lifetimes(events, by)
    after = F.when(F.col("starts"), F.col("shares")).otherwise(F.greatest(F.col("left_before") - F.col("take"), F.lit(0)))
    return s.select(*by, "ref", "seq", "msg", after.cast("long").alias("left_after"))


def audit(events: DataFrame, by: Sequence[str] = ("day",), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Per day: references by type to unknown or finished orders, peak live orders, orders left at the end."""
    by = list(by)
    steps = stored(order_steps(events))
    short = one_piece(steps, "step", chunk_rows)
    s = _lifetimes(steps, by, chunk_rows, short)
    done = ~F.col("starts") & F.col("matched") & (F.col("left_before") <= F.col("take"))
    again = F.col("starts") & (F.coalesce(F.col("_pl"), F.lit(0)) > 0)
    live_after = F.when(F.col("starts"), F.col("shares")).otherwise(F.greatest(F.col("left_before") - F.col("take"), F.lit(0)))
    s = ordered_scan(s.withColumn("_la", live_after), [*by, "ref"], "step", lags={"_pl": F.col("_la")}, chunk_rows=chunk_rows, short=short)
    change = F.when(done, -1).when(again, 0).when(F.col("starts"), 1).otherwise(0)
    run = ordered_scan(s.withColumn("_chg", change), by, "step", sums={"_live": F.col("_chg")}, chunk_rows=chunk_rows, short=short)
    miss = lambda k: F.count_if((F.col("msg") == k) & ~F.col("starts") & ~F.col("matched")).alias(f"unmatched_{k}")
    return run.groupBy(*by).agg(
        F.count_if(~F.col("starts")).alias("references"), *[miss(k) for k in REDUCERS],
        F.greatest(F.max("_live"), F.lit(0)).alias("peak_live_orders"), F.sum("_chg").alias("orders_left"))


def audit_rollup(audits: DataFrame, events: DataFrame, by: Sequence[str] = ("day",)) -> DataFrame:
    """Per day: symbols, references, unmatched ones, orders left, peak."""
    n = events.groupBy(*by).agg(F.countDistinct("ticker").alias("symbols"))
    bad = sum((F.col(f"unmatched_{k}") for k in REDUCERS), F.lit(0))
    return audits.join(n, list(by)).select(*by, "symbols", "references", bad.alias("unmatched"), "orders_left", "peak_live_orders")


def _real_orders(s: DataFrame, by: Sequence[str]) -> DataFrame:
    """Starts that exist, with the side they inherit. A replace starts an order only if the one it names was
    alive, so chains are followed back to an add by pointer jumping: each pass halves what is left of them.
    A pass writes the starts it has found and the links still open, nothing twice."""
    by = list(by)
    adds = s.where("starts and msg <> 'U'").select(*by, "step", F.col("side").alias("root_side"))
    ends = s.where("not starts and msg = 'U' and matched").select(*by, (F.col("step") + 1).alias("step"), F.col("start_step").alias("up"))
    known, open_ = adds, stored(ends)
    while True:
        roots = known.select(*by, F.col("step").alias("up"), "root_side")
        jump = open_.select(*by, F.col("step").alias("up"), F.col("up").alias("_far"))
        tried = stored(open_.join(roots, [*by, "up"], "left").join(jump, [*by, "up"], "left"))
        known = known.unionByName(tried.where("root_side is not null").select(*by, "step", "root_side"))
        open_ = tried.where("root_side is null and _far is not null").select(*by, "step", F.col("_far").alias("up"))
        if open_.isEmpty():
            return known


def messages(events: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """Message rows of each stock-day: day, ticker, step, ts_ns, type, order_id, size, price, direction."""
    by = list(by)
    s = cut(lifetimes(events, by))
    real = _real_orders(s, by)
    sign = lambda c: F.when(F.col(c) == "B", 1).otherwise(-1)
    starts = s.where("starts").join(real, [*by, "step"]).select(
        *by, "step", "ts_ns", F.lit(1).alias("type"), F.col("ref").alias("order_id"), F.col("shares").alias("size"), "price",
        sign("root_side").alias("direction"))
    hits = s.where("not starts and matched").join(real.withColumnRenamed("step", "start_step"), [*by, "start_step"])
    kind = F.when(F.col("msg").isin("E", "C"), 4).when((F.col("msg") == "X") & (F.col("shares") < F.col("left_before")), 2).otherwise(3)
    ends = hits.select(*by, "step", "ts_ns", kind.alias("type"), F.col("ref").alias("order_id"), F.least("take", "left_before").alias("size"),
                       F.col("order_price").alias("price"), sign("root_side").alias("direction"))
    state = F.create_map(*[F.lit(x) for kv in HALT_PRICE.items() for x in kv])
    other = events.where((F.col("msg").isin("P", "H")) | ((F.col("msg") == "Q") & (F.col("shares") > 0)))
    halt = F.col("msg") == "H"
    rest = other.select(
        *by, (F.col("seq") * 2).alias("step"), "ts_ns", F.when(F.col("msg") == "P", 5).when(F.col("msg") == "Q", 6).otherwise(7).alias("type"),
        F.lit(0).cast("long").alias("order_id"), F.when(halt, 0).otherwise(F.col("shares")).cast("long").alias("size"),
        F.when(halt, F.coalesce(F.try_element_at(state, F.col("state")), F.lit(0))).otherwise(F.col("price")).cast("long").alias("price"),
        F.when(F.col("msg") == "P", sign("side")).otherwise(-1).alias("direction"))
    return starts.unionByName(ends).unionByName(rest)


def level_changes(msgs: DataFrame) -> DataFrame:
    delta = F.when(F.col("type") == 1, F.col("size")).when(F.col("type").between(2, 4), -F.col("size")).otherwise(0)
    return msgs.withColumn("delta", delta.cast("long"))


def depth(msgs: DataFrame, by: Sequence[str] = KEYS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Displayed shares at the message's own price and side after it."""
    d = level_changes(msgs).where("type between 1 and 4")
    return ordered_scan(d, [*by, "direction", "price"], "step", sums={"depth": F.col("delta")}, chunk_rows=chunk_rows)


def level_intervals(msgs: DataFrame, by: Sequence[str] = KEYS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """When each level stands, and with how many shares: direction, price, size, from_step, until_step (NULL: to the end)."""
    keys = [*by, "direction", "price"]
    d = level_changes(msgs).where("delta <> 0")
    run = ordered_scan(d, keys, "step", sums={"_q": F.col("delta")}, leads={"until_step": F.col("step")}, chunk_rows=chunk_rows)
    return run.where("_q > 0").select(*keys, F.col("_q").alias("size"), F.col("step").alias("from_step"), "until_step")


def _top_levels(price: np.ndarray, delta: np.ndarray, open_price: np.ndarray, open_qty: np.ndarray, levels: int, worse: int) -> tuple[np.ndarray, np.ndarray]:
    """(prices, sizes) of the best levels of one side after each row; prices fall for worse = -1 and rise for worse = 1.

    Rows come a block at a time. Only levels that the block touches change in it, so these and the best `levels` of the others
    make a small table rows x levels of running sums, in which the k-th standing level of a row is read off a running count."""
    n = len(price)
    grid = np.unique(np.concatenate([open_price, price[delta != 0]]) * worse)
    held = np.zeros(len(grid), np.int64)
    held[np.searchsorted(grid, open_price * worse)] = open_qty
    out_p, out_q = np.full((n, levels), worse * NO_PRICE), np.zeros((n, levels), np.int64)
    for a in range(0, n, BOOK_BLOCK):
        d = delta[a : a + BOOK_BLOCK]
        moves = np.flatnonzero(d)
        at = np.searchsorted(grid, price[a + moves] * worse)
        touched = np.zeros(len(grid), bool)
        touched[at] = True
        cols = np.union1d(at, np.flatnonzero((held > 0) & ~touched)[:levels])
        if not len(cols):
            continue
        size = np.zeros((len(d), len(cols)), np.int64)
        size[moves, np.searchsorted(cols, at)] = d[moves]
        size = held[cols] + size.cumsum(0)
        count = (size > 0).cumsum(1)
        for k in range(levels):
            rows = np.flatnonzero(count[:, -1] > k)
            first = (count[rows] > k).argmax(1)
            out_p[a + rows, k], out_q[a + rows, k] = grid[cols[first]] * worse, size[rows, first]
        held[cols] = size[-1]
    return out_p, out_q


def books(msgs: DataFrame, levels: int = 10, by: Sequence[str] = KEYS, chunk_rows: int = BOOK_STEPS) -> DataFrame:
    """Top levels a side after every message. A stock-day is cut into pieces; each piece opens with the levels
    standing at its start (sums of earlier pieces), so no task holds more than one piece and the open levels."""
    by = list(by)
    d = stored(level_changes(msgs).withColumn("_piece", F.floor(F.col("step") / chunk_rows)))
    net = d.where("delta <> 0").groupBy(*by, "_piece", "direction", "price").agg(F.sum("delta").alias("_net"))
    w = Window.partitionBy(*by, "direction", "price").orderBy("_piece")
    run = net.withColumns({"_q": F.sum("_net").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_next": F.lead("_piece").over(w)})
    last = d.groupBy(*by).agg(F.max("_piece").alias("_last"))
    run = run.join(last, by).where("_q > 0")
    until = F.coalesce("_next", "_last")
    opening = run.where(until > F.col("_piece")).withColumn("_p", F.explode(F.sequence(F.col("_piece") + 1, until))).select(
        *by, F.col("_p").alias("_piece"), "direction", "price", F.col("_q").alias("qty"))
    opening = opening.toDF(*opening.columns)  # its own columns, as it is grouped together with the rows it came from
    level = T.ArrayType(T.StructType([T.StructField("price", T.LongType()), T.StructField("size", T.LongType())]))
    cols = [*by, "step", "ts_ns", "type", "order_id", "size", "price", "direction"]
    schema = T.StructType([*[d.schema[k] for k in cols], T.StructField("bids", level), T.StructField("asks", level)])

    def piece(op: pa.Table, ev: pa.Table) -> pa.Table:
        ev = ev.sort_by("step")
        get = lambda t, c: t.column(c).to_numpy().astype(np.int64)
        sides = []
        for side in (1, -1):
            own, mine = get(op, "direction") == side, get(ev, "direction") == side
            p, q = _top_levels(get(ev, "price"), np.where(mine, get(ev, "delta"), 0), get(op, "price")[own], get(op, "qty")[own], levels, -side)
            both = pa.StructArray.from_arrays([pa.array(p.ravel()), pa.array(q.ravel())], names=["price", "size"])
            sides.append(pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * levels, pa.int32()), both))
        return pa.table([*[ev.column(c) for c in cols], *sides], names=[*cols, "bids", "asks"])

    return opening.groupBy(*by, "_piece").cogroup(d.groupBy(*by, "_piece")).applyInArrow(piece, schema)


def visible_rows(book: DataFrame, session: Sequence[int] = SESSION_NS, by: Sequence[str] = KEYS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows a level feed would show: in session, and a trade or a change of the visible levels."""
    b = book.where((F.col("ts_ns") >= session[0]) & (F.col("ts_ns") < session[1]))
    b = ordered_scan(b, by, "step", lags={"_b": F.col("bids"), "_a": F.col("asks")}, chunk_rows=chunk_rows)
    shown = F.col("type") >= 4
    moved = F.col("_b").isNull() | (F.col("bids") != F.col("_b")) | (F.col("asks") != F.col("_a"))
    return b.where(shown | moved).drop("_b", "_a")


def to_tape(rows: DataFrame) -> DataFrame:
    """Book rows in the shape the tape operators take."""
    best = lambda side, f: F.get(F.col(side), F.lit(0))[f]
    return rows.withColumns({"seq": F.col("step"), "time": F.col("ts_ns") / 1e9, "bid_price": best("bids", "price"), "bid_size": best("bids", "size"),
                             "ask_price": best("asks", "price"), "ask_size": best("asks", "size")}).drop("step", "ts_ns")


def conversion_stats(events: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """Per stock-day: events, adds, executions, cancels, deletes, replaces, hidden, crosses, unmatched."""
    by = list(by)
    s = cut(lifetimes(events, by))
    real = _real_orders(s, by).select(*by, F.col("step").alias("start_step"), F.lit(True).alias("_real"))
    e = s.where("not starts").join(real, [*by, "start_step"], "left").withColumn("_ok", F.col("matched") & F.coalesce("_real", F.lit(False)))
    n = lambda cond, name: F.count_if(cond).alias(name)
    ok = F.col("_ok")
    a = e.groupBy(*by).agg(n(ok & F.col("msg").isin("E", "C"), "executions"), n(ok & (F.col("msg") == "X"), "cancels"), n(ok & (F.col("msg") == "D"), "deletes"),
                           n(ok & (F.col("msg") == "U"), "replaces"), n(~ok, "unmatched"))
    m = F.col("msg")
    b = events.groupBy(*by).agg(F.count(F.lit(1)).alias("events"), n(m.isin("A", "F"), "adds"), n(m == "P", "hidden"), n(m == "Q", "crosses"))
    return b.join(a, by, "left").fillna(0)


def missing_tickers(events: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(events.select("ticker").distinct(), ["ticker"], "left_anti")

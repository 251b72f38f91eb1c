"""Would a resting order have filled? Hypothetical orders matched against the later messages of their day.

Every order depends only on its own terms and the messages while it rests. The clock is cut into buckets at least as long as
the longest wait; an order goes to the bucket it is placed in, a message to its own bucket and the one before, so two copies of
the tape are dealt out however many orders rest, and a task's call holds one bucket of one stock with the wait after it, or
several small ones. There all orders are worked on together, as columns:

* the first row that can end an order (a print or the opposite quote beyond its price, its level out of view) is found by
  doubling steps over range maxima;
* the rows at its own price and side are one run of the messages sorted by level;
* the queue models walk these runs in step, the i-th row of every order at once, in the order of the messages.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tapeworks.functions.shared import stored
from tapeworks.operators.scan import SLOT_SECONDS, asof
from tapeworks.operators.tape import KEYS, NO_PRICE, SESSION, clock_grid, depth_at

MODELS = ("touch", "fifo", "through")
ALL_MODELS = (*MODELS, "l2")
BUCKET_SECONDS = 300.0
EVERY, MAX_WAIT, SIZE = 5.0, 60.0, 100
HORIZONS = (0.1, 1.0, 10.0, 60.0)
TRADES = (4, 5)
CALL_ROWS = 1 << 17  # messages worked on together, where buckets are smaller


def sample_orders(tape: DataFrame, every: float = EVERY, max_wait: float = MAX_WAIT, size: int = SIZE,
                  horizon: float = max(HORIZONS), session: Sequence[float] = SESSION,
                  latencies: Sequence[float] = (0.0,), by: Sequence[str] = KEYS,
                  slot: float = SLOT_SECONDS) -> DataFrame:
    """Both sides at the best quotes on a clock grid, one set per latency, all latencies in one job.

    The price is the one seen at the decision; the order reaches the book `latency` later."""
    grid = clock_grid(tape, session[0], session[1] - max_wait - horizon, every, by, "decision_time")
    lat = F.explode(F.array(*[F.lit(float(x)) for x in latencies]))
    quotes = {"bid_price": "bid_price", "ask_price": "ask_price", "_s0": "seq", "_t0": "time"}
    seen = asof(grid, tape, by, "decision_time", "time", "seq", quotes, slot).withColumn("latency", lat)
    fits = F.col("decision_time") <= session[1] - max_wait - horizon - F.col("latency") + 1e-9
    seen = seen.where(fits & F.col("_s0").isNotNull()).withColumn("_at", F.col("decision_time") + F.col("latency"))
    if any(x > 0 for x in latencies):
        seen = asof(seen, tape, by, "_at", "time", "seq", {"place_seq": "seq", "place_time": "time"}, slot)
    else:
        seen = seen.withColumnsRenamed({"_s0": "place_seq", "_t0": "place_time"})
    sides = seen.withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1))))
    step = F.round((F.col("decision_time") - float(session[0])) / float(every)).cast("long")
    return sides.select(
        *by,
        F.concat_ws("/", step.cast("string"), F.col("side").cast("string"), F.col("latency").cast("string")).alias("order"),
        "decision_time", "latency", "place_seq", "side",
        F.when(F.col("side") > 0, F.col("bid_price")).otherwise(F.col("ask_price")).alias("price"),
        F.lit(size).cast("long").alias("size"),
        (F.col("_at") + float(max_wait) - F.col("place_time")).alias("max_wait"),
    )


def check_orders(orders: DataFrame, models: Sequence[str] = MODELS) -> DataFrame:
    """Input rules: known models; side +1 or -1; placement inside the tape. Bad rows raise in the job."""
    bad = [m for m in models if m not in ALL_MODELS]
    if bad:
        raise ValueError(f"unknown fill model {bad}; use some of {ALL_MODELS}")
    fine = F.col("side").isin(1, -1) & (F.col("place_seq") >= 0)
    guard = F.when(F.coalesce(fine, F.lit(False)), F.col("place_seq")).otherwise(
        F.raise_error(F.lit("side must be +1 or -1 and place_seq must point into the tape")).cast("long")
    )
    return orders.withColumn("place_seq", guard)


def place(tape: DataFrame, orders: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """Orders with the book they meet: queue ahead, rejection, deadline."""
    book = tape.select(
        *by, F.col("seq").alias("place_seq"), F.col("time").alias("place_time"), "bids", "asks",
        "bid_price", "ask_price",
    )
    o = orders.drop("place_time").join(book, [*by, "place_seq"])
    buy, p = F.col("side") > 0, F.col("price")
    crossed = F.when(buy, p >= F.col("ask_price")).otherwise(p <= F.col("bid_price"))
    deep_bid, deep_ask = F.element_at("bids", -1)["price"], F.element_at("asks", -1)["price"]
    hidden = F.when(buy, p < deep_bid).otherwise(p > deep_ask)
    return o.withColumns({
        "queue_ahead": depth_at(F.when(buy, F.col("bids")).otherwise(F.col("asks")), p),
        "rejected": crossed | hidden | (F.col("size") <= 0),
        "deadline": F.col("place_time") + F.col("max_wait"),
    }).drop("bids", "asks", "bid_price", "ask_price")


def _first_at_least(z: np.ndarray, start: np.ndarray, level: np.ndarray) -> np.ndarray:
    """For each (start, level) the first i >= start with z[i] >= level, len(z) if there is none: range maxima of doubling length."""
    n = len(z)
    most = [z]
    while 2 << (len(most) - 1) <= n:
        half = 1 << (len(most) - 1)
        most.append(np.maximum(most[-1][:-half], most[-1][half:]))
    at = start.copy()
    for j in range(len(most) - 1, -1, -1):  # runs without a hit are passed, longest first
        room = at + (1 << j) <= n
        skip = np.flatnonzero(room)[most[j][at[room]] < level[room]]
        at[skip] += 1 << j
    return at


def _submitted_at(level: np.ndarray, order_id: np.ndarray, kind: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For rows sorted by level, then row: the row in which the same id was last submitted at that level before, -1 if it
    never was or has been deleted since."""
    turn = np.lexsort((row, order_id, level))
    mark = np.flatnonzero((kind[turn] == 1) | (kind[turn] == 3))
    at = np.zeros(len(turn) + 1, np.int64) - 1
    at[mark + 1] = mark
    last = np.maximum.accumulate(at)[:-1]  # the last mark before each row, of any id
    same = (last >= 0) & (level[turn[last]] == level[turn]) & (order_id[turn[last]] == order_id[turn]) & (kind[turn[last]] == 1)
    out = np.full(len(turn), -1)
    out[turn[same]] = row[turn[last[same]]]
    return out


def _walk(model: str, runs: tuple[np.ndarray, np.ndarray], first: np.ndarray, queue: np.ndarray, size: np.ndarray,
          kind: np.ndarray, shares: np.ndarray, submitted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(filled, last filling row, row that filled the rest) of each order; rows are positions in the level order, -1 for none.

    fifo: only orders placed before ours are ahead of it, so a cancel counts unless its id was submitted after us.
    l2: ids are unknown, a cancel shrinks what is ahead of us and what is behind us pro rata."""
    begin, end = runs
    ahead, behind, left = queue.astype(np.float64 if model == "l2" else np.int64), np.zeros(len(queue)), size.copy()
    last, full = np.full(len(queue), -1), np.full(len(queue), -1)
    live, t = np.flatnonzero(begin < end), 0
    while len(live):
        e = begin[live] + t
        k, q = kind[e], shares[e]
        gone = (k == 2) | (k == 3)
        if model == "fifo":
            gone &= submitted[e] < first[live]
            ahead[live[gone]] = np.maximum(ahead[live[gone]] - q[gone], 0)
        else:
            o, c = live[gone], q[gone].astype(np.float64)
            total = ahead[o] + behind[o]
            o, c, total = o[total > 0], c[total > 0], total[total > 0]
            ahead[o], behind[o] = np.maximum(ahead[o] - c * ahead[o] / total, 0.0), np.maximum(behind[o] - c * behind[o] / total, 0.0)
            behind[live[k == 1]] += q[k == 1]
        hit = k == 4
        o, x = live[hit], q[hit]
        took = np.minimum(ahead[o], x)
        ahead[o] -= took
        got = np.minimum(np.floor(x - took).astype(np.int64), left[o])
        some = got > 0
        o, row = o[some], e[hit][some]
        left[o] -= got[some]
        last[o] = row
        full[o[left[o] == 0]] = row[left[o] == 0]
        t += 1
        live = live[(begin[live] + t < end[live]) & (left[live] > 0)]
    return size - left, last, full


def _places(group_m: np.ndarray, x: np.ndarray, group_o: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many rows (group, x), sorted so, stand at or before each (group, y)."""
    rank = np.unique(np.concatenate([x, y]), return_inverse=True)[1]
    span = np.int64(len(rank) + 1)
    return np.searchsorted(group_m * span + rank[: len(x)], group_o * span + rank[len(x) :], "right")


def _replay(orders: dict[str, np.ndarray], m: dict[str, np.ndarray], models: Sequence[str]) -> list[dict[str, np.ndarray]]:
    """What becomes of orders under each model, from the messages of their groups (a bucket and the next), by group and seq."""
    n, kind, g_m, g_o = len(m["seq"]), m["type"], m["group"], orders["group"]
    side, price, size, queue = (orders[c] for c in ("side", "price", "size", "queue_ahead"))
    buy = side > 0
    none = np.int64(-(1 << 60))
    trade = np.isin(kind, TRADES)
    first = _places(g_m, m["seq"], g_o, orders["place_seq"])
    over = np.maximum(_places(g_m, m["time"], g_o, orders["deadline"]), first)  # the first row after the deadline

    def reach(for_buy: np.ndarray, of_buy: np.ndarray, for_sell: np.ndarray, of_sell: np.ndarray) -> np.ndarray:
        """The first row after each placement at which the quantity of its side reaches the order's."""
        out = np.full(len(side), n)
        out[buy] = _first_at_least(for_buy, first[buy], of_buy[buy])
        out[~buy] = _first_at_least(for_sell, first[~buy], of_sell[~buy])
        return out

    # a print or the opposite quote beyond the order's price; the deepest level in view better than it
    beyond = reach(np.maximum(np.where(trade, -m["price"] - 1, none), -m["ask"]), -price, np.maximum(np.where(trade, m["price"] - 1, none), m["bid"]), price)
    left_view = reach(m["deep_bid"], price + 1, -m["deep_ask"], 1 - price)
    halts = np.append(np.flatnonzero(kind == 7), n)
    halt = halts[np.searchsorted(halts, first)]
    beyond, left_view, halt = (np.where(x < over, x, n) for x in (beyond, left_view, halt))
    stop = np.minimum(np.minimum(halt, beyond + 1), np.minimum(left_view + 1, over))  # rows before it can fill in part

    span = np.int64(n + 1)
    level_of = lambda p, s: 2 * p + (s > 0)
    shown = np.flatnonzero((kind >= 1) & (kind <= 4))
    levels, of = np.unique(np.concatenate([level_of(m["price"][shown], m["direction"][shown]), level_of(price, side)]), return_inverse=True)
    own, mine = g_m[shown] * len(levels) + of[: len(shown)], g_o * len(levels) + of[len(shown) :]
    turn = np.lexsort((shown, own))
    rows, own = shown[turn], own[turn]
    place = own * span + rows
    runs = np.searchsorted(place, mine * span + first), np.searchsorted(place, mine * span + np.maximum(stop, first))
    submitted = _submitted_at(own, m["order_id"][rows], kind[rows], rows) if "fifo" in models else rows

    prints = np.flatnonzero(trade)
    known, at = np.unique(np.concatenate([m["price"][prints], price]), return_inverse=True)
    at = np.concatenate([g_m[prints], g_o]) * len(known) + at
    turned = np.lexsort((prints, at[: len(prints)]))
    print_place = np.append(at[: len(prints)][turned] * span + prints[turned], np.iinfo(np.int64).max)

    out = []
    for model in models:
        got, last, full = np.zeros(len(side), np.int64), np.full(len(side), n), np.full(len(side), n)
        if model == "touch":
            hit = np.searchsorted(print_place, at[len(prints) :] * span + first)
            row = print_place[hit] - at[len(prints) :] * span
            full = np.where(row < stop, row, n)
            last, got = full, np.where(full < n, size, 0)
        elif model != "through":
            got, last, full = _walk(model, runs, first, queue, size, kind[rows], m["size"][rows], submitted)
            last, full = (np.where(x >= 0, np.append(rows, n)[x], n) for x in (last, full))
        whole = np.minimum(np.where(beyond < stop, beyond, n), full)  # the first row that fills all that is left
        out.append({"got": np.where(whole < n, size, got), "fill": np.where(whole < n, whole, last), "whole": whole, "halt": halt, "left": left_view, "over": over})
    return out


def simulate(tape: DataFrame, orders: DataFrame, models: Sequence[str] = MODELS, by: Sequence[str] = KEYS,
             width: float = BUCKET_SECONDS, slot: float = SLOT_SECONDS) -> DataFrame:
    """One row per order and model: filled_qty, fill_seq, fill_time, fill_price, end_seq, end_time, end_reason,
    queue_ahead. End reasons: filled, timeout, level_exit, halt, end_of_data, rejected.

    `width`: seconds of a bucket, the longest wait if that is longer. Small buckets share a task's call, large ones have their own."""
    by = list(by)
    last = tape.groupBy(*by).agg(F.max(F.struct("seq", "time")).alias("_last"), F.count(F.lit(1)).alias("_rows"))
    placed = place(tape, check_orders(orders, models), by).join(last, by)
    placed = stored(placed.withColumns({"last_seq": F.col("_last.seq"), "last_time": F.col("_last.time")}).drop("_last"))
    rows, longest = placed.groupBy(*by).agg(F.first("_rows").alias("_rows"), F.max(F.when(~F.col("rejected"), F.col("max_wait"))).alias("_w")).agg(F.sum("_rows"), F.max("_w")).first()
    width = max(float(width), float(longest or 0.0) + 1e-6)
    calls = -(-2 * (rows or 0) // CALL_ROWS) or 1
    deep = lambda c: F.element_at(c, -1)["price"]
    msg = tape.select(
        *by, "seq", F.col("time").cast("double").alias("time"), "type", F.coalesce("order_id", F.lit(0)).alias("order_id"), "size", "price", "direction",
        F.coalesce("bid_price", F.lit(-NO_PRICE)).alias("bid"), F.coalesce("ask_price", F.lit(NO_PRICE)).alias("ask"),
        F.coalesce(deep("bids"), F.lit(-NO_PRICE)).alias("deep_bid"), F.coalesce(deep("asks"), F.lit(NO_PRICE)).alias("deep_ask"))
    own = F.floor(F.col("time") / width)
    call = F.pmod(F.xxhash64(*by, "_b"), F.lit(calls))
    msg = msg.withColumn("_b", F.explode(F.array(own - 1, own))).withColumn("_call", call)
    live = placed.drop("_rows").withColumn("_b", F.floor(F.col("place_time") / width)).withColumn("_call", call)
    groups = [*by, "_b"]
    extra = [x for x in orders.columns if x not in (*by, "order", "side", "price", "size", "place_seq", "place_time", "max_wait")]
    kept = [*by, "order", *extra]
    longs, whole, num = ("place_seq", "side", "price", "size", "queue_ahead", "last_seq"), T.LongType(), T.DoubleType()
    schema = T.StructType([*[placed.schema[c] for c in kept], T.StructField("model", T.StringType()), *[placed.schema[c] for c in ("place_seq", "side", "price", "size")],
                           *[T.StructField(c, kind) for c, kind in (("filled_qty", whole), ("fill_seq", whole), ("fill_time", num), ("fill_price", whole), ("end_seq", whole), ("end_time", num),
                                                                    ("end_reason", T.StringType()), ("queue_ahead", whole))]])
    names = to_arrow_schema(schema)

    def bucket(o: pa.Table, msgs: pa.Table) -> pa.Table:
        if not o.num_rows:
            return names.empty_table()
        group = np.zeros(o.num_rows + msgs.num_rows, np.int64)
        for c in groups:
            codes = pa.chunked_array([*o.column(c).chunks, *msgs.column(c).chunks]).combine_chunks().dictionary_encode("encode")
            group = np.unique(group * len(codes.dictionary) + codes.indices.to_numpy(), return_inverse=True)[1]
        m = {c: msgs.column(c).to_numpy() for c in msgs.column_names if c not in groups} | {"group": group[o.num_rows :]}
        turn = np.lexsort((m["seq"], m["group"]))
        m = {c: v[turn] if c == "time" else v[turn].astype(np.int64) for c, v in m.items()}
        refused = o.column("rejected").to_numpy()
        terms = {"group": group[: o.num_rows]} | {c: o.column(c).to_numpy().astype(np.int64) for c in longs} | {c: o.column(c).to_numpy() for c in ("deadline", "place_time", "last_time")}
        n = len(m["seq"])
        row = lambda c, at: np.append(m[c], 0)[np.minimum(at, n)]
        out = []
        for model, r in zip(models, _replay(terms, m, models), strict=True):
            filled, late = r["whole"] < n, terms["last_time"] > terms["deadline"]
            halted = (r["halt"] < n) & (r["halt"] <= r["left"])
            why = [refused, filled, halted, r["left"] < n, late]
            reason = np.select(why, ["rejected", "filled", "halt", "level_exit", "timeout"], "end_of_data")
            end = np.select(why, [n, r["whole"], r["halt"], r["left"], np.maximum(r["over"] - 1, 0)], n)
            at_end = [refused, filled | halted | (r["left"] < n), late]
            end_seq = np.select(at_end, [terms["place_seq"], row("seq", end), row("seq", end)], terms["last_seq"])
            end_time = np.select(at_end, [terms["place_time"], row("time", end), terms["deadline"]], terms["last_time"])
            got = np.where(refused, 0, r["got"])
            no_fill = refused | (r["fill"] >= n)
            cols = {"model": pa.array([model] * len(got)), "filled_qty": pa.array(got), "fill_seq": pa.array(row("seq", r["fill"]), mask=no_fill), "fill_time": pa.array(row("time", r["fill"]), mask=no_fill),
                    "fill_price": pa.array(np.where(got > 0, terms["price"], 0)), "end_seq": pa.array(end_seq), "end_time": pa.array(end_time), "end_reason": pa.array(reason.tolist())}
            out.append(pa.table([cols.get(f.name, o.column(f.name) if f.name in o.column_names else None).cast(f.type) for f in names], schema=names))
        return pa.concat_tables(out)

    return live.groupBy("_call").cogroup(msg.groupBy("_call")).applyInArrow(bucket, schema)

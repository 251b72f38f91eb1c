"""What the mid did after an order filled, summaries of it, and the post-or-cross decision rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.mathx import div, uniform
from tapeworks.operators import fills
from tapeworks.operators.fills import EVERY, HORIZONS, MODELS, SIZE
from tapeworks.operators.scan import SLOT_SECONDS, asof, cut, quantiles
from tapeworks.operators.signals import queue_imbalance
from tapeworks.operators.tape import KEYS, SESSION, SPLIT, TICK, clock_grid, mid, trades

QUEUE_EDGES = (0.5, 1.0, 2.0)  # multiples of the median queue
SIGNAL_EDGES = (0.2, 0.4, 0.6, 0.8)
BLOCK_SECONDS = 300.0
TAKER_FEE_TICKS = 0.3
MIN_CELL = 20
DECISION_HORIZON = 30.0


def label(h: float) -> str:
    return f"{h:g}".replace(".", "p")


def mid_after(points: DataFrame, tape: DataFrame, at: str, offsets: dict[str, float], by: Sequence[str] = KEYS,
              slot: float = SLOT_SECONDS) -> DataFrame:
    """Mid in effect at `at` + offset for several offsets: one union and one as-of pass for all of them.

    `points` has a column `point` that names it within its group."""
    arms = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(float(h)).alias("h")) for n, h in offsets.items()]))
    p = points.where(F.col(at).isNotNull()).select(*by, "point", F.col(at).alias("_at"), arms.alias("_e")).select(
        *by, "point", F.col("_e.n").alias("_n"), (F.col("_at") + F.col("_e.h")).alias("_when")
    )
    m = asof(p, tape.withColumn("_mid", mid()), by, "_when", "time", "seq", {"_mid": "_mid"}, slot)
    return m.groupBy(*by, "point").agg(*[F.max(F.when(F.col("_n") == n, F.col("_mid"))).alias(n) for n in offsets])


def queue_bucket(queue: Column, median: Column) -> Column:
    """0..3 by multiples of the median queue; a value on an edge goes up."""
    return sum(((queue >= median * k).cast("int") for k in QUEUE_EDGES), F.lit(0))


def with_queue_bucket(df: DataFrame, queue: str, by: Sequence[str], one_per: str | None = None) -> DataFrame:
    base = df if one_per is None else df.where(F.col("model") == one_per)
    med = base.groupBy(*by).agg(F.percentile(queue, F.lit(0.5)).alias("median_queue"))
    return df.join(med, list(by), "left").withColumn("queue_bucket", queue_bucket(F.col(queue), F.col("median_queue")))


def order_drift(tape: DataFrame, orders: DataFrame, models: Sequence[str] = MODELS,
                horizons: Sequence[float] = HORIZONS, by: Sequence[str] = KEYS, slot: float = SLOT_SECONDS,
                width: float = fills.BUCKET_SECONDS, sets: Sequence[str] = ()) -> DataFrame:
    """Order x model with the mid move after the fill (ticks and bps of the order's own mid) and, as a
    baseline, after an instant fill at the decision time. `sets` adds order columns (such as latency) that
    the queue median is taken within."""
    by = list(by)
    orders = cut(orders)
    out = cut(fills.simulate(tape, orders, models, by, width, slot))
    key = F.concat_ws("|", "model", "order")
    offs = {f"h{label(h)}": h for h in horizons}
    base = orders.select(*by, F.concat_ws("|", F.lit("base"), "order").alias("point"), F.col("decision_time").alias("_at"))
    hit = out.where("filled_qty > 0").select(*by, key.alias("point"), F.col("fill_time").alias("_at"))
    m = mid_after(base.unionByName(hit), tape, "_at", {"h0": 0.0, **offs}, by, slot)
    b = m.select(*by, "point", F.col("h0").alias("mid0"), *[F.col(k).alias(f"_u{k}") for k in offs])
    f = m.select(*by, "point", *[F.col(k).alias(f"_f{k}") for k in offs])
    j = (
        out.withColumn("point", F.concat_ws("|", F.lit("base"), "order")).join(b, [*by, "point"], "left")
        .withColumn("point", key).join(f, [*by, "point"], "left").drop("point")
    )
    bps = div(F.lit(TICK * 1e4), "mid0")
    cols = {"fill_frac": F.col("filled_qty") / F.col("size")}
    for h in horizons:
        k = f"h{label(h)}"
        cols[f"base_{label(h)}"] = F.col("side") * (F.col(f"_u{k}") - F.col("price")) / TICK
        cols[f"drift_{label(h)}"] = F.when(
            F.col("filled_qty") > 0, F.col("side") * (F.col(f"_f{k}") - F.col("price")) / TICK)
    j = j.withColumns(cols)
    j = j.withColumns({f"{n}_bps": F.col(n) * bps for n in cols if n != "fill_frac"})
    j = j.drop(*[f"_u{k}" for k in offs], *[f"_f{k}" for k in offs])
    return with_queue_bucket(j, "queue_ahead", [*by, *sets], models[0])


def qty_mean(x: str) -> Column:
    """Aggregate: mean of x over filled orders, weighted by the filled quantity."""
    ok = F.col(x).isNotNull() & (F.col("filled_qty") > 0)
    return div(F.sum(F.when(ok, F.col(x) * F.col("filled_qty"))), F.sum(F.when(ok, F.col("filled_qty"))))


def summarize(drift: DataFrame, horizons: Sequence[float] = HORIZONS, by: Sequence[str] = KEYS) -> DataFrame:
    cols = []
    for h in horizons:
        for unit in ("", "_bps"):
            cols += [qty_mean(f"drift_{label(h)}{unit}").alias(f"drift_{label(h)}{unit}"),
                     F.avg(f"base_{label(h)}{unit}").alias(f"base_{label(h)}{unit}")]
    return drift.groupBy(*by, "model").agg(
        F.count(F.lit(1)).alias("n_orders"), F.avg((F.col("filled_qty") > 0).cast("double")).alias("p_fill"),
        F.avg("fill_frac").alias("fill_frac"), *cols,
    )


def by_queue(drift: DataFrame, horizon: float = 10.0, by: Sequence[str] = KEYS) -> DataFrame:
    cell = [*by, "model", "queue_bucket"]
    drift = cut(drift.select(*cell, "filled_qty", "queue_ahead", f"drift_{label(horizon)}"))
    return drift.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("filled_qty") > 0).cast("double")).alias("p_fill"),
        qty_mean(f"drift_{label(horizon)}").alias("drift"),
    ).join(quantiles(drift, cell, "queue_ahead", {"median_queue": 0.5}), cell)


def end_counts(outcomes: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    partial = (F.col("filled_qty") > 0) & (F.col("filled_qty") < F.col("size"))
    return outcomes.groupBy(*by, "model", "end_reason").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(partial).alias("partial")
    )


def spread_parts(tape: DataFrame, horizons: Sequence[float] = (5.0, 60.0), session: Sequence[float] = SESSION,
                 by: Sequence[str] = KEYS, slot: float = SLOT_SECONDS, pool: Sequence[str] | None = None) -> DataFrame:
    """Effective spread = realised spread + impact on the tape's own trades, share-weighted, per horizon.

    Trades are grouped within `by`; results are pooled over `pool` (default: the same groups)."""
    tr = trades(tape, (session[0], session[1] - max(horizons)), by).withColumn("point", F.col("island"))
    tr = cut(tr)
    offs = {f"h{label(h)}": h for h in horizons}
    m = mid_after(tr, tape, "time", offs, by, slot)
    arms = F.explode(F.array(*[F.struct(F.lit(float(h)).alias("horizon"), F.col(f"h{label(h)}").alias("mh")) for h in horizons]))
    j = tr.join(m, [*by, "point"]).withColumn("_e", arms).select("*", "_e.horizon", "_e.mh")
    e, px, m0 = F.col("sign"), F.col("vwap"), F.col("mid_before")
    kinds = {"effective": 2 * e * (px - m0), "realized": 2 * e * (px - F.col("mh")), "impact": 2 * e * (F.col("mh") - m0)}
    cols = []
    for k, x in kinds.items():
        cols += [(div(F.sum(x * F.col("size")), F.sum("size")) / TICK).alias(f"{k}_ticks"),
                 div(F.sum(div(x, m0) * 1e4 * F.col("size")), F.sum("size")).alias(f"{k}_bps")]
    return j.where("mid_before is not null and mh is not null").groupBy(*(by if pool is None else pool), "horizon").agg(
        F.count(F.lit(1)).alias("n_trades"), *cols)


def decisions(tape: DataFrame, horizon: float = DECISION_HORIZON, every: float = EVERY,
              session: Sequence[float] = SESSION, models: Sequence[str] = MODELS, by: Sequence[str] = KEYS,
              slot: float = SLOT_SECONDS, width: float = fills.BUCKET_SECONDS) -> DataFrame:
    """Decisions on the imbalance signal: value of crossing, and of posting under each fill model, in ticks."""
    by = list(by)
    st = tape.withColumns({"imbalance": queue_imbalance(), "mid0": mid()})
    cols = {x: x for x in ("imbalance", "mid0", "bid_price", "ask_price", "bid_size", "ask_size")}
    grid = clock_grid(tape, session[0], session[1] - horizon, every, by)
    d = asof(grid, st, by, "t", "time", "seq", {**cols, "place_seq": "seq", "place_time": "time"}, slot)
    d = d.where(F.col("imbalance").isNotNull() & (F.col("imbalance") != 0))
    buy = F.col("imbalance") > 0
    pick = lambda a, b: F.when(buy, F.col(a)).otherwise(F.col(b))
    order = F.round((F.col("t") - float(session[0])) / float(every)).cast("long").cast("string")
    strength = F.abs("imbalance")
    d = d.withColumns({
        "side": F.when(buy, 1).otherwise(-1), "post_price": pick("bid_price", "ask_price"),
        "cross_price": pick("ask_price", "bid_price"), "queue": pick("bid_size", "ask_size"),
        "order": order, "point": order, "strength": strength,
        "signal_bucket": sum(((strength > k).cast("int") for k in SIGNAL_EDGES), F.lit(0)),
    })
    d = cut(d)
    d = d.join(mid_after(d, tape, "t", {"mid_h": horizon}, by, slot), [*by, "point"], "left")
    orders = d.select(*by, "order", "place_seq", "side", F.col("post_price").alias("price"),
                      F.lit(SIZE).cast("long").alias("size"),
                      (F.col("t") + float(horizon) - F.col("place_time")).alias("max_wait"))
    out = fills.simulate(tape, orders, models, by, width, slot).select(
        *by, "order", "model", (F.col("filled_qty") / float(SIZE)).alias("fill_frac"))
    d = with_queue_bucket(cut(d), "queue", by)
    side = F.col("side")
    d = d.withColumns({
        "move": side * (F.col("mid_h") - F.col("mid0")) / TICK,
        "spread": (F.col("ask_price") - F.col("bid_price")) / TICK,
        "tick_bps": div(F.lit(TICK * 1e4), "mid0"),
        "ev_cross": side * (F.col("mid_h") - F.col("cross_price")) / TICK,
    })
    j = d.join(out, [*by, "order"])
    j = j.withColumn("ev_post", F.col("fill_frac") * side * (F.col("mid_h") - F.col("post_price")) / TICK)
    return j.select(
        *by, "order", "model", "t", "side", "imbalance", "strength", "signal_bucket", "queue", "queue_bucket", "spread",
        "tick_bps", "move", "ev_cross", "fill_frac", "ev_post", (F.col("ev_post") - F.col("ev_cross")).alias("diff"),
    )


CELL = ("queue_bucket", "signal_bucket")


def cell_table(dec: DataFrame, by: Sequence[str] = (), min_n: int = MIN_CELL) -> DataFrame:
    """Mean values per cell; `grid` is the mean difference where the cell is large enough."""
    return dec.groupBy(*by, "model", *CELL).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("fill_frac") > 0).cast("double")).alias("p_fill"),
        F.avg("ev_post").alias("ev_post"), F.avg("ev_cross").alias("ev_cross"), F.avg("diff").alias("diff"),
        F.when(F.count(F.lit(1)) >= min_n, F.avg("diff")).alias("grid"),
    )


def best_action(n: Column, post: Column, cross: Column, min_n: int) -> Column:
    """none (0) unless posting or crossing is better; ties keep the order none, post, cross."""
    top = F.greatest(F.lit(0.0), post, cross)
    return F.when((n < min_n) | n.isNull() | (top <= 0), "none").when(post >= top, "post").otherwise("cross")


def choose(train: DataFrame, by: Sequence[str] = (), min_n: int = MIN_CELL, fee: Column | float = 0.0,
           rebate: Column | float = 0.0) -> DataFrame:
    """Best action per cell on the training rows."""
    fee = F.lit(float(fee)) if not isinstance(fee, Column) else fee
    rebate = F.lit(float(rebate)) if not isinstance(rebate, Column) else rebate
    # a mean of zero must not turn on the order of summation
    steady = lambda x: F.round(F.avg(x), 12)
    return train.groupBy(*by, "model", *CELL).agg(
        F.count(F.lit(1)).alias("_n"), steady(F.col("ev_post") + rebate * F.col("fill_frac")).alias("_post"),
        steady(F.col("ev_cross") - fee).alias("_cross")
    ).select(*by, "model", *CELL, best_action(F.col("_n"), F.col("_post"), F.col("_cross"), min_n).alias("action"))


def apply_rule(rule: DataFrame, dec: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Score the rule: `ev` per decision; cells the rule does not know are not traded."""
    j = dec.join(rule, [*by, "model", *CELL], "left").withColumn("action", F.coalesce("action", F.lit("none")))
    a = F.col("action")
    return j.withColumn("ev", F.when(a == "post", F.col("ev_post")).when(a == "cross", F.col("ev_cross")).otherwise(0.0))


def block_bootstrap(df: DataFrame, by: Sequence[str], t: str, x: str, block: float = BLOCK_SECONDS,
                    reps: int = 2000, seed: int = 0) -> DataFrame:
    """95% interval of the mean of x, resampling whole clock blocks. Works on block sums, not on rows."""
    by = list(by)
    t0 = df.groupBy(*by).agg(F.min(t).alias("_t0"))
    blocks = df.join(t0, by).groupBy(*by, F.floor((F.col(t) - F.col("_t0")) / float(block)).alias("_blk")).agg(
        F.sum(x).alias("_s"), F.count(x).alias("_c"))
    w = Window.partitionBy(*by)
    blocks = cut(blocks).withColumns({
        "_i": F.row_number().over(w.orderBy("_blk")) - 1, "_nb": F.count(F.lit(1)).over(w)})
    draws = blocks.select(*by, "_nb", F.col("_i").alias("_j"), F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("_rep"))
    draws = draws.withColumn("_i", F.floor(uniform(seed, *by, "_rep", "_j") * F.col("_nb")).cast("int"))
    means = draws.join(blocks.select(*by, "_i", "_s", "_c"), [*by, "_i"]).groupBy(*by, "_rep").agg(
        div(F.sum("_s"), F.sum("_c")).alias("_m"))
    q = F.percentile("_m", F.array(F.lit(0.025), F.lit(0.975)))
    return means.groupBy(*by).agg(q.alias("_q")).select(*by, F.col("_q")[0].alias("lo"), F.col("_q")[1].alias("hi"))


def rule_scores(dec: DataFrame, by: Sequence[str] = KEYS, split: float = SPLIT, horizon: float = DECISION_HORIZON,
                fee: float = TAKER_FEE_TICKS, min_n: int = MIN_CELL) -> tuple[DataFrame, DataFrame]:
    """(scores, scored decisions after the split) of the rule chosen on decisions that resolve before the split."""
    by = list(by)
    one = [*by, "model"]
    train, test = dec.where(F.col("t") + float(horizon) <= split), dec.where(F.col("t") >= split)
    rule = choose(train, by, min_n)
    ins = apply_rule(rule, train, by).groupBy(*one).agg(F.avg("ev").alias("in_sample"))
    oos = cut(apply_rule(rule, test, by).withColumn("net", F.col("ev") - fee * (F.col("action") == "cross").cast("double")))
    share = lambda a: F.avg((F.col("action") == a).cast("double"))
    perf = oos.groupBy(*one).agg(
        F.avg("ev").alias("out_of_sample"), F.avg(F.col("ev") * F.col("tick_bps")).alias("oos_bps"),
        F.avg("ev_post").alias("always_post"), F.avg("ev_cross").alias("always_cross"),
        share("post").alias("share_post"), share("cross").alias("share_cross"), F.count(F.lit(1)).alias("n_test"),
        F.avg(F.when(F.col("action") != "none", F.col("ev"))).alias("per_trade"), F.avg("net").alias("net_of_fee"),
    )
    return perf.join(ins, one, "left"), oos


def evaluate_rule(dec: DataFrame, by: Sequence[str] = KEYS, split: float = SPLIT, horizon: float = DECISION_HORIZON,
                  fee: float = TAKER_FEE_TICKS, min_n: int = MIN_CELL, reps: int = 2000, block: float = BLOCK_SECONDS,
                  seed: int = 0) -> DataFrame:
    """Choose on decisions that resolve before the split, score on the decisions after it."""
    one = [*by, "model"]
    perf, oos = rule_scores(cut(dec), by, split, horizon, fee, min_n)
    ci = block_bootstrap(oos, one, "t", "ev", block, reps, seed)
    net = block_bootstrap(oos, one, "t", "net", block, reps, seed).withColumnsRenamed({"lo": "net_lo", "hi": "net_hi"})
    return perf.join(ci, one, "left").join(net, one, "left")


def with_morning_median(dec: DataFrame, split: float = SPLIT, horizon: float = DECISION_HORIZON, by: Sequence[str] = KEYS) -> DataFrame:
    """Decisions with queue buckets by the median of those that resolve before the split only, so that the buckets of a day
    do not know its afternoon; a group without a morning has none."""
    known = dec.where((F.col("model") == "fifo") & (F.col("t") + float(horizon) <= split))
    med = known.groupBy(*by).agg(F.percentile("queue", F.lit(0.5)).alias("_m"))
    return dec.join(med, list(by), "left").withColumn("queue_bucket", queue_bucket(F.col("queue"), F.col("_m"))).drop("_m")


def horizon_sensitivity(tape: DataFrame, horizons: Sequence[float] = (10.0, 30.0, 60.0), base: float = DECISION_HORIZON, split: float = SPLIT,
                        rule_by: Sequence[str] = ("ticker",), by: Sequence[str] = KEYS, fee: float = TAKER_FEE_TICKS, min_n: int = MIN_CELL, **how) -> DataFrame:
    """Scores of the rule at several horizons (check "horizon"), and at the base horizon with morning-only queue buckets
    (check "morning_median"). `how` goes to `decisions`."""
    parts = []
    for h in horizons:
        dec = cut(decisions(tape, h, by=by, **how))
        checks = {"horizon": dec} | ({"morning_median": with_morning_median(dec, split, h, by)} if h == base else {})
        for name, d in checks.items():
            scores = rule_scores(d, rule_by, split, h, fee, min_n)[0]
            parts.append(scores.select(F.lit(name).alias("check"), F.lit(float(h)).alias("horizon"), *scores.columns))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def leave_one_day_out(dec: DataFrame, by: Sequence[str] = ("ticker",), day: str = "day", min_n: int = MIN_CELL,
                      fee: float = TAKER_FEE_TICKS) -> DataFrame:
    """Rule for each day chosen on all other days: cell sums over all days minus the day's own, in one pass."""
    by = list(by)
    cell = [*by, "model", *CELL]
    own = dec.groupBy(*cell, day).agg(
        F.count(F.lit(1)).alias("n"), F.sum("ev_post").alias("sp"), F.sum("ev_cross").alias("sc"))
    w = Window.partitionBy(*cell)  # one row per day
    n = F.sum("n").over(w) - F.col("n")
    post, cross = F.sum("sp").over(w) - F.col("sp"), F.sum("sc").over(w) - F.col("sc")
    rule = own.select(*cell, day, n.alias("_n"), F.round(div(post, n), 12).alias("_p"), F.round(div(cross, n), 12).alias("_c")).select(
        *cell, day, best_action(F.col("_n"), F.coalesce("_p", F.lit(0.0)), F.coalesce("_c", F.lit(0.0)), min_n).alias("action"))
    oos = apply_rule(rule, dec, [*by, day])
    share = lambda a: F.avg((F.col("action") == a).cast("double"))
    return oos.groupBy(*by, "model", day).agg(
        F.avg("ev").alias("oos"), F.avg(F.col("ev") - fee * (F.col("action") == "cross").cast("double")).alias("net_of_fee"),
        F.avg("ev_post").alias("always_post"), F.avg("ev_cross").alias("always_cross"),
        share("post").alias("share_post"), share("cross").alias("share_cross"), F.count(F.lit(1)).alias("n"),
    )


def sensitivity(dec: DataFrame, by: Sequence[str] = ("ticker",), split: float = SPLIT, horizon: float = DECISION_HORIZON,
                fee: float = TAKER_FEE_TICKS, rebates: Sequence[float] = (0.0, 0.2, 0.3), min_n: int = MIN_CELL) -> DataFrame:
    """Rule value under maker rebates, with fee and rebate counted before the rule is chosen."""
    d = dec.withColumn("rebate", F.explode(F.array(*[F.lit(float(r)) for r in rebates])))
    one = [*by, "rebate"]
    rule = choose(d.where(F.col("t") + float(horizon) <= split), one, min_n, fee, F.col("rebate"))
    test = apply_rule(rule, d.where(F.col("t") >= split), one)
    a = F.col("action")
    net = F.when(a == "post", F.col("ev_post") + F.col("rebate") * F.col("fill_frac")).when(
        a == "cross", F.col("ev_cross") - fee).otherwise(0.0)
    return test.groupBy(*one, "model").agg(
        F.avg(net).alias("net"), F.avg((a == "post").cast("double")).alias("share_post"),
        F.avg((a == "cross").cast("double")).alias("share_cross"), F.count(F.lit(1)).alias("n_test"))


def verdict(rules: DataFrame, by: Sequence[str] = ("ticker",)) -> DataFrame:
    """Does the signal survive queue-aware fills? One row per group, from the rule's intervals."""
    get = lambda m, x: F.max(F.when(F.col("model") == m, F.col(x)))
    v = rules.groupBy(*by).agg(
        get("fifo", "lo").alias("_lo"), get("fifo", "hi").alias("_hi"), get("fifo", "net_lo").alias("_nlo"),
        get("touch", "lo").alias("_tlo"), get("fifo", "out_of_sample").alias("fifo_oos"),
        get("touch", "out_of_sample").alias("touch_oos"))
    status = F.when(F.col("_lo") > 0, "positive").when(F.col("_hi") < 0, "negative").otherwise("zero")
    v = v.withColumn("status", status)
    clears = F.coalesce((F.col("status") == "positive") & (F.col("_nlo") > 0), F.lit(False))
    v = v.withColumn("clears_fee", clears)
    return v.select(*by, "fifo_oos", "touch_oos", "status", "clears_fee",
                    (F.coalesce(F.col("_tlo") > 0, F.lit(False)) & ~F.col("clears_fee")).alias("touch_illusion"))


def survives(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(F.coalesce(F.bool_or("clears_fee"), F.lit(False)).alias("survives"),
                        F.count_if("touch_illusion").alias("n_touch_illusion"))


def model_agreement(outcomes: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """Per group: how often the size-only estimate and the queue model agree on filled or not."""
    f = outcomes.groupBy(*by, "order").agg(
        F.max(F.when(F.col("model") == "l2", (F.col("filled_qty") > 0).cast("int"))).alias("l2"),
        F.max(F.when(F.col("model") == "fifo", (F.col("filled_qty") > 0).cast("int"))).alias("fifo"))
    share = lambda cond: F.avg(cond.cast("double"))
    return f.groupBy(*by).agg(
        share(F.col("l2") == F.col("fifo")).alias("l2_agrees"),
        share((F.col("l2") == 1) & (F.col("fifo") == 0)).alias("l2_only"),
        share((F.col("fifo") == 1) & (F.col("l2") == 0)).alias("fifo_only"))


def stock_day_cells(drift: DataFrame, facts: DataFrame, horizon: float = 10.0, by: Sequence[str] = KEYS) -> DataFrame:
    """One row per stock-day: fills and drift of every model side by side, gap of touch over fifo, agreement."""
    h = label(horizon)
    s = drift.groupBy(*by, "model").agg(
        F.avg((F.col("filled_qty") > 0).cast("double")).alias("p_fill"), qty_mean(f"drift_{h}").alias("drift"),
        qty_mean(f"drift_{h}_bps").alias("drift_bps"), F.count(F.lit(1)).alias("orders"))
    wide = s.groupBy(*by).agg(F.max("orders").alias("orders"), *[
        F.max(F.when(F.col("model") == m, F.col(x))).alias(f"{x}_{m}")
        for m in fills.ALL_MODELS for x in ("p_fill", "drift", "drift_bps")])
    wide = wide.withColumns({"gap_bps": F.col("drift_bps_touch") - F.col("drift_bps_fifo"),
                             "gap_ticks": F.col("drift_touch") - F.col("drift_fifo")})
    f = facts.select(*by, "mean_price", "tick_bps", "spread_ticks", "share_one_tick", "depth_best", "tick_class")
    return wide.join(model_agreement(drift, by), list(by)).join(f, list(by), "left")


def latency_cells(drift: DataFrame, horizon: float = 10.0, by: Sequence[str] = KEYS) -> DataFrame:
    """Rejections, fills and drift by stock-day, latency and model."""
    return drift.groupBy(*by, "latency", "model").agg(
        F.avg((F.col("end_reason") == "rejected").cast("double")).alias("rejected"),
        F.avg((F.col("filled_qty") > 0).cast("double")).alias("p_fill"),
        qty_mean(f"drift_{label(horizon)}_bps").alias("drift_bps"))


def pool_latency(cells: DataFrame, classes: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """Latency sweep averaged over stock-days per tick class; drift as the change from no delay."""
    zero = cells.where("latency = 0").select(*by, "model", F.col("drift_bps").alias("_d0"))
    j = cells.join(zero, [*by, "model"], "left").join(classes.select("ticker", "tick_class"), ["ticker"])
    j = j.withColumn("class", F.explode(F.array(F.col("tick_class"), F.lit("all"))))
    return j.groupBy("class", "latency", "model").agg(
        F.avg("rejected").alias("rejected"), F.avg("p_fill").alias("p_fill"), F.avg("drift_bps").alias("drift_bps"),
        F.avg(F.col("drift_bps") - F.col("_d0")).alias("change_bps"), F.count(F.lit(1)).alias("stock_days"))


def by_ticker(cells: DataFrame) -> DataFrame:
    """Many-day rollup per ticker; the tick class is the one of most days."""
    return cells.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("days"), F.mode("tick_class", deterministic=True).alias("tick_class"),
        F.avg("mean_price").alias("mean_price"), F.avg("spread_ticks").alias("spread_ticks"),
        F.avg("gap_bps").alias("gap_bps"), F.avg((F.col("gap_bps") > 0).cast("double")).alias("share_gap_positive"),
        *[F.avg(f"p_fill_{m}").alias(f"p_fill_{m}") for m in fills.ALL_MODELS],
        F.avg(100 * (F.col("p_fill_l2") - F.col("p_fill_fifo"))).alias("l2_extra_fills_pp"),
        F.avg(F.col("drift_bps_l2") - F.col("drift_bps_fifo")).alias("l2_drift_error_bps"),
        F.avg("l2_agrees").alias("l2_agrees"),
    )


def pooled_daily(cells: DataFrame) -> DataFrame:
    """Cross-stock mean per day, the series whose days are resampled for the pooled interval."""
    return cells.groupBy("day").agg(
        F.avg("gap_bps").alias("gap_bps"),
        F.avg(100 * (F.col("p_fill_l2") - F.col("p_fill_fifo"))).alias("l2_extra_fills_pp"),
        F.avg(100 * F.abs(F.col("p_fill_l2") - F.col("p_fill_fifo"))).alias("l2_abs_fills_pp"),
        F.avg(F.col("drift_bps_l2") - F.col("drift_bps_fifo")).alias("l2_drift_error_bps"),
        F.avg("l2_agrees").alias("l2_agrees"),
    )

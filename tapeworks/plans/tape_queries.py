"""Queries over the order-event tape: books, signals, price impact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeworks.operators import signals, tape as tp
from tapeworks.operators.scan import asof
from tapeworks.plans.adapters import DAY, tape, tape_view
from tapeworks.plans.registry import query

HOUR = 3600.0
HALF = 43_200.0
SLOT = 7200.0
T = tape_view()
W = "partition by day, ticker order by seq"
MID = "(bid_price + ask_price) / 2.0"
GRID = f"(select day, ticker, cast(h as double) * 3600 as t from (select distinct day, ticker from {T}) g, range(25) r(h))"
FLOW = f"""(select *, case when lag(bid_price) over w is null then 0.0 else
   (case when bid_price >= lag(bid_price) over w then bid_size else 0 end)
 - (case when bid_price <= lag(bid_price) over w then lag(bid_size) over w else 0 end)
 - (case when ask_price <= lag(ask_price) over w then ask_size else 0 end)
 + (case when ask_price >= lag(ask_price) over w then lag(ask_size) over w else 0 end) end as flow,
 {MID} as mid, (bid_size + ask_size) / 2.0 as dep
 from {T} window w as ({W}))"""
AREA = f"""(select *, sum(step) over (partition by day, ticker order by seq rows unbounded preceding) as area,
  sum(flow) over (partition by day, ticker order by seq rows unbounded preceding) as flow_sum
 from (select *, coalesce(lag(dep) over w * (time - lag(time) over w), 0.0) as step from {FLOW} window w as ({W})))"""
LASTROW = "row_number() over (partition by day, ticker, time order by seq desc) = 1"
EDGES = f"""(select g.day, g.ticker, g.t, a.mid / 100 as mid, a.flow_sum, a.area + a.dep * (g.t - a.time) as integral
 from {GRID} g asof left join (select * from {AREA} qualify {LASTROW}) a
   on g.day = a.day and g.ticker = a.ticker and g.t >= a.time)"""
BUCKETS = f"""(select day, ticker, t as start, coalesce(lead(flow_sum) over w, 0) - coalesce(flow_sum, 0) as flow,
  lead(mid) over w - mid as dmid, (lead(integral) over w - integral) / 3600 as depth
 from {EDGES} window w as (partition by day, ticker order by t) qualify lead(t) over w is not null)"""
REGS = "case when regr_sxx(dmid, flow) > 0 then regr_intercept(dmid, flow) end as alpha, case when regr_sxx(dmid, flow) > 0 then regr_slope(dmid, flow) end as beta, case when regr_syy(dmid, flow) > 0 and regr_sxx(dmid, flow) > 0 then regr_r2(dmid, flow) end as r2"


def buckets(spark: SparkSession, sf: str) -> DataFrame:
    return signals.flow_buckets(tape(spark, sf), HOUR, DAY, slot=SLOT)


@query("quotes_mid_spread", f"""select day, ticker, seq, {MID} as mid, cast(ask_price - bid_price as double) as spread,
  cast(bid_size - ask_size as double) / (bid_size + ask_size) as imbalance from {T}""", "mid spread imbalance")
def _(spark, sf):
    return tape(spark, sf).select("day", "ticker", "seq", tp.mid().alias("mid"), tp.spread().alias("spread"),
                                  signals.queue_imbalance().alias("imbalance"))


@query("asof_state", f"""select g.day, g.ticker, g.t, a.seq, a.mid from {GRID} g asof left join
  (select *, {MID} as mid from {T} qualify {LASTROW}) a on g.day = a.day and g.ticker = a.ticker and g.t >= a.time""", "t mid")
def _(spark, sf):
    t = tape(spark, sf).withColumn("mid", tp.mid())
    grid = tp.clock_grid(t, 0.0, DAY[1], HOUR)
    return asof(grid, t, tp.KEYS, "t", "time", "seq", {"seq": "seq", "mid": "mid"}, SLOT)


HELD = f"""(select *, greatest(least(coalesce(lead(time) over w, 86400.0), 86400.0) - greatest(time, 0.0), 0.0) as held
  from {T} window w as ({W}))"""


@query("state_durations", f"select day, ticker, seq, held from {HELD}", "held")
def _(spark, sf):
    return tp.with_durations(tape(spark, sf), DAY).select("day", "ticker", "seq", "held")


@query("depth_time_average", f"""select day, ticker, start as lo, start + 3600 as hi, depth as average from {BUCKETS}""", "lo hi average")
def _(spark, sf):
    t = tape(spark, sf)
    iv = tp.clock_grid(t, 0.0, DAY[1] - HOUR, HOUR, out="lo").withColumn("hi", F.col("lo") + HOUR)
    return tp.time_average(t, iv, tp.depth_best(), slot=SLOT)


def _at(p, side):
    a = ["bid", "ask"][side]
    return (f"(case when {a}_price = {p} then {a}_size else 0 end + case when {a}2 = {p} then {a}2_size else 0 end"
            f" + case when {a}3 = {p} then {a}3_size else 0 end)")


DEPTHS = f"""select day, ticker, seq, case when direction > 0 then {_at('price', 0)} else {_at('price', 1)} end as shown,
  case when direction > 0 then price >= bid3 else price <= ask3 end as visible from {T}"""


@query("depth_at_price", DEPTHS)
def _(spark, sf):
    side = F.when(F.col("direction") > 0, F.col("bids")).otherwise(F.col("asks"))
    return tape(spark, sf).withColumn("_s", side).select(
        "day", "ticker", "seq", tp.depth_at(F.col("_s"), F.col("price")).alias("shown"),
        tp.in_view(F.col("_s"), F.col("direction"), F.col("price")).alias("visible"))


def _lagat(side):
    a = ["bid", "ask"][side]
    f = lambda x: f"lag({x}) over w"
    return "(" + " + ".join(f"case when {f(a + n)} = price then {f(a + s)} else 0 end"
                            for n, s in (("_price", "_size"), ("2", "2_size"), ("3", "3_size"))) + ")"


CHECKED = f"""(select day, ticker, type,
  case when direction > 0 then price >= lag(bid3) over w and price >= bid3
       else price <= lag(ask3) over w and price <= ask3 end as seen,
  case when direction > 0 then {_at('price', 0)} - {_lagat(0)} else {_at('price', 1)} - {_lagat(1)} end
   = case when type = 1 then size else -size end as moved
  from {T} window w as ({W}) qualify lag(seq) over w is not null and type between 1 and 4)"""


@query("book_consistency", f"""select day, ticker, type, count(*) as eligible, cast(sum(case when seen then 1 else 0 end) as bigint) as checked,
  cast(sum(case when seen and moved then 1 else 0 end) as bigint) as passed from {CHECKED} group by all""")
def _(spark, sf):
    return tp.consistency(tape(spark, sf))


TRADES = f"""(select day, ticker, gid, min(seq) as first_seq, max(seq) as last_seq, arg_min(-direction, seq) as sign,
  cast(sum(size) as bigint) as size, sum(size * cast(price as double)) / sum(size) as vwap, min(time) as time, arg_min(m0, seq) as mid_before
 from (select *, sum(case when brk then 1 else 0 end) over ({W} rows unbounded preceding) as gid from (
  select *, not coalesce(lag(type) over w = 4 and lag(time) over w = time and lag(direction) over w = direction, false) as brk,
   lag({MID}) over w as m0 from {T} window w as ({W})) where type = 4) group by day, ticker, gid)"""


@query("trade_groups", f"select day, ticker, first_seq, last_seq, sign, size, vwap, time from {TRADES}", "vwap time")
def _(spark, sf):
    return tp.trades(tape(spark, sf), DAY).select("day", "ticker", "first_seq", "last_seq", "sign", "size", "vwap", "time")


@query("trade_sign_memory", f"""with x as (select ticker, first_seq, sign - avg(sign) over (partition by ticker) as x from {TRADES}),
  p as (select ticker, x{''.join(f', lead(x, {k}) over w as x{k}' for k in range(1, 6))} from x window w as (partition by ticker order by first_seq))
  select ticker, k as lag, sum(x * case k {' '.join(f'when {k} then x{k}' for k in range(1, 6))} end) / (select sum(x * x) from p p2 where p2.ticker = p.ticker) as acf
  from p, range(1, 6) r(k) group by ticker, k""", "acf")
def _(spark, sf):
    return tp.autocorrelation(tp.trades(tape(spark, sf), DAY), ["ticker"], "first_seq", "sign", 5).withColumn(
        "lag", F.col("lag").cast("long"))


FACTS = f"""(select b.*, coalesce(n_trades, 0) as n_trades, case when share_one_tick > 0.5 then 'large-tick' else 'small-tick' end as tick_class from (
  select day, ticker, sum(m * held) / nullif(sum(held), 0) / 1e4 as mean_price, sum(1e6 / m * held) / nullif(sum(held), 0) as tick_bps,
   sum(s / 100 * held) / nullif(sum(held), 0) as spread_ticks, sum(s / m * 1e4 * held) / nullif(sum(held), 0) as spread_bps,
   sum(case when s = 100 then held else 0 end) / nullif(sum(held), 0) as share_one_tick, sum((bid_size + ask_size) / 2.0 * held) / nullif(sum(held), 0) as depth_best,
   count(*) as n_messages, {', '.join(f'count(*) filter (type = {k}) as n_{v}' for k, v in tp.MESSAGE_TYPES.items())},
   cast(coalesce(sum(size) filter (type = 4), 0) as bigint) as volume_visible
  from (select *, {MID} as m, cast(ask_price - bid_price as double) as s from {HELD}) group by day, ticker) b
  left join (select day, ticker, count(*) as n_trades from {TRADES} group by day, ticker) n using (day, ticker))"""


@query("stylised_facts", f"select * from {FACTS}",
       "mean_price tick_bps spread_ticks spread_bps share_one_tick depth_best")
def _(spark, sf):
    return tp.facts(tape(spark, sf), DAY)


@query("order_flow_events", f"select day, ticker, seq, cast(flow as double) as flow from {FLOW}", "flow")
def _(spark, sf):
    return signals.with_flow(tape(spark, sf)).select("day", "ticker", "seq", "flow")


@query("order_flow_buckets", f"select day, ticker, cast(start as double) as start, cast(flow as double) as flow, dmid, depth from {BUCKETS}", "start flow dmid depth")
def _(spark, sf):
    return buckets(spark, sf)


@query("impact_by_symbol", f"""select ticker, count(*) filter (flow is not null and dmid is not null) as n, {REGS} from {BUCKETS} group by ticker""",
       "alpha beta r2")
def impact_by_symbol(spark, sf):
    """How much of the price change does order flow explain, by symbol?"""
    return signals.ols(buckets(spark, sf), ["ticker"], "flow", "dmid")


WINREG = f"""(select day, ticker, cast(floor(start / 21600) as bigint) as "window", count(*) filter (dmid is not null) as n, {REGS},
  avg(depth) as depth, cast(max(abs(flow)) as double) as max_abs_flow, floor(start / 21600) * 21600 as window_start from {BUCKETS} group by day, ticker, floor(start / 21600))"""


def regs(spark, sf):
    return signals.window_regressions(buckets(spark, sf), 21_600.0, 0.0)


@query("impact_by_window", f"select * from {WINREG}", "alpha beta r2 depth max_abs_flow window_start")
def _(spark, sf):
    return regs(spark, sf)


def steady(df):
    """A slope of exactly zero may come out as rounding noise of either sign: make it zero."""
    return df.withColumn("beta", F.when(F.round("beta", 9) != 0, F.col("beta")).otherwise(0.0))


def _slope_sql(group):
    part = f"over (partition by {group})" if group else "over ()"
    return f"""with d as (select ticker, ln(depth) as x, ln(beta) as y from {WINREG} where round(beta, 9) > 0 and depth > 0),
  c as (select *, x - avg(x) {part} as dx, y - avg(y) {part} as dy, count(*) {part} as ng, avg(y) over () as yb from d),
  f as (select sum(dx * dy) / sum(dx * dx) as slope, sum(dx * dx) as sxx from c),
  e as (select c.*, f.*, dy - slope * dx as e, 1.0 / ng + dx * dx / sxx as h from c, f)
  select max(slope) as slope, sqrt(sum((dx * e / (1 - h)) ** 2)) / max(sxx) as se,
   max(slope) - 1.959963984540054 * sqrt(sum((dx * e / (1 - h)) ** 2)) / max(sxx) as lo,
   max(slope) + 1.959963984540054 * sqrt(sum((dx * e / (1 - h)) ** 2)) / max(sxx) as hi,
   1 - sum(e * e) / sum((y - yb) ** 2) as r2, count(*) as n,
   (select count(*) from {WINREG} where not coalesce(round(beta, 9) > 0 and depth > 0, false)) as n_dropped from e"""


@query("depth_slope_pooled", _slope_sql(None), "slope se lo hi r2")
def _(spark, sf):
    return signals.depth_slope(steady(regs(spark, sf))).drop("intercept")


@query("depth_slope_within", _slope_sql("ticker"), "slope se lo hi r2")
def _(spark, sf):
    return signals.depth_slope(steady(regs(spark, sf)), group="ticker").drop("intercept")


def _oos(kind, y, tr, te):
    return f"""select '{kind}' as kind, b.ticker, max(beta) as beta, max(alpha) as alpha, max(n_train) as n_train, count(*) as n_test,
  1 - sum((y - alpha - beta * flow) ** 2) / nullif(sum((y - my) ** 2), 0) as r2_oos,
  1 - sum((y - alpha - beta * flow) ** 2) / nullif(sum(y * y), 0) as r2_oos_zero
  from (select *, {y} as y from nb) b join (select ticker, regr_intercept({y}, flow) as alpha, regr_slope({y}, flow) as beta, avg({y}) as my,
  count(*) as n_train from nb where {tr} and {y} is not null group by ticker) f on f.ticker = b.ticker where {te} and y is not null group by b.ticker"""


@query("impact_out_of_sample", f"""with nb as (select *, lead(dmid) over (partition by day, ticker order by start) as nd from {BUCKETS})
  {_oos('contemporaneous', 'dmid', 'start + 3600 <= 43200', 'start >= 43200')} union all {_oos('lagged', 'nd', 'start + 7200 <= 43200', 'start >= 43200')}""",
       "beta alpha r2_oos r2_oos_zero")
def _(spark, sf):
    b = buckets(spark, sf)
    b = b.withColumn("nd", F.lead("dmid").over(Window.partitionBy("day", "ticker").orderBy("start")))
    end = F.col("start") + HOUR
    same = signals.out_of_sample(b, ["ticker"], "flow", "dmid", end <= HALF, F.col("start") >= HALF)
    nxt = signals.out_of_sample(b, ["ticker"], "flow", "nd", end + HOUR <= HALF, F.col("start") >= HALF)
    return same.withColumn("kind", F.lit("contemporaneous")).unionByName(nxt.withColumn("kind", F.lit("lagged")))


@query("impact_units", f"""select day, ticker, beta * 1000 as beta_per_1000, r2, beta / 100 as beta_usd_per_share, beta * 1000 * tick_bps as beta_bps_per_1000, mb * 1000 as median_window_beta_per_1000,
  case when r2 > 0 then beta * 1000 / sqrt(r2) end as slope_over_root_r2, beta * depth_best as beta_times_depth, depth_best, mean_price
  from (select day, ticker, {REGS} from {BUCKETS} group by day, ticker) join (select day, ticker, mean_price, tick_bps, depth_best from {FACTS}) using (day, ticker)
  left join (select day, ticker, quantile_cont(beta, 0.5) as mb from {WINREG} group by day, ticker) using (day, ticker)""",
       "beta_per_1000 r2 beta_usd_per_share beta_bps_per_1000 median_window_beta_per_1000 slope_over_root_r2 beta_times_depth depth_best mean_price", 5)
def _(spark, sf):
    t = tape(spark, sf)
    return signals.impact_units(buckets(spark, sf), tp.facts(t, DAY), regs(spark, sf))


NEXTMID = f"""(select a.*, b.seq as nseq, b.time as ntime, b.mid as nmid from (select *, {MID} as mid from {T}) a
  asof left join (select * from (select day, ticker, seq, time, {MID} as mid, lag({MID}) over w as pm from {T} window w as ({W})) where pm <> mid) b
  on a.day = b.day and a.ticker = b.ticker and a.seq < b.seq)"""


@query("next_mid_change", f"select day, ticker, seq, nseq as next_mid_seq, ntime as next_mid_time, nmid as next_mid from {NEXTMID}", "next_mid_time next_mid")
def _(spark, sf):
    return signals.with_next_mid(tape(spark, sf)).select("day", "ticker", "seq", "next_mid_seq", "next_mid_time", "next_mid")


GRID24 = GRID.replace("range(25)", "range(24)")
SAMPLES = f"""(select g.day, g.ticker, g.t, (bid_size - ask_size) / cast(bid_size + ask_size as double) as imbalance,
  case when nmid > mid then 1 else 0 end as up, ntime as resolve from {GRID24} g asof join
  (select * from {NEXTMID} qualify {LASTROW}) s on g.day = s.day and g.ticker = s.ticker and g.t >= s.time where nmid is not null)"""


def samples(spark, sf):
    return signals.imbalance_samples(tape(spark, sf), HOUR, DAY, slot=SLOT)


@query("imbalance_samples", f"select * from {SAMPLES}", "t imbalance resolve")
def _(spark, sf):
    return samples(spark, sf)


@query("imbalance_curve", f"""select ticker, cast(greatest(least(floor((imbalance + 1) * 10 / 2), 9), 0) as bigint) as bin, count(*) as n, avg(up) as p_up
  from {SAMPLES} where t >= 43200 group by all""", "p_up")
def _(spark, sf):
    return signals.imbalance_curve(samples(spark, sf), HALF, 10, ["ticker"])


@query("imbalance_auc", f"""with r as (select ticker, up, rank() over (partition by ticker order by imbalance) + (count(*) over (partition by ticker, imbalance) - 1) / 2.0 as rk
  from {SAMPLES} where t >= 43200) select ticker, (sum(case when up = 1 then rk end) - sum(up) * (sum(up) + 1) / 2.0) / nullif(sum(up) * (count(*) - sum(up)), 0) as auc from r group by ticker""", "auc")
def _(spark, sf):
    return signals.auc(samples(spark, sf).where(F.col("t") >= HALF), ["ticker"], "imbalance", "up")


@query("imbalance_logistic", digits=4)
def _(spark, sf):
    return signals.score_imbalance(samples(spark, sf), HALF, ["ticker"])


@query("published_comparison", digits=4)
def _(spark, sf):
    b, t = regs(spark, sf), tape(spark, sf)
    # per ticker over all its days, on hourly samples
    facts = tp.facts(t, DAY).groupBy("ticker").agg(F.mode("tick_class", deterministic=True).alias("tick_class"))
    return signals.against_published(b, signals.score_imbalance(samples(spark, sf), HALF, ["ticker"]),
                                     signals.depth_slope(b, group="ticker"), facts, ["ticker"])

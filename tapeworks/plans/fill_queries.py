"""Queries over hypothetical orders: fills under four models, the mid after them, post-or-cross rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.operators import drift, fills, tape as tp
from tapeworks.plans.adapters import DAY, tape
from tapeworks.plans.registry import query
from tapeworks.plans.tape_queries import FACTS, LASTROW, MID, T, TRADES, _at

SLOT = 7200.0
WIDTH = 600.0
EVERY, WAIT, HORIZON = 1800.0, 3600.0, 3600.0
HORIZONS = (600.0, 3600.0)
LATENCIES = (0.0, 60.0, 600.0)
HALF = 43_200.0


def orders(spark, sf, latencies=(0.0,)):
    return fills.sample_orders(tape(spark, sf), EVERY, WAIT, 300, HORIZON, DAY, latencies, slot=SLOT)


def drifted(spark, sf, models=fills.MODELS):
    t = tape(spark, sf)
    return drift.order_drift(t, orders(spark, sf), models, HORIZONS, slot=SLOT, width=WIDTH)


def decided(spark, sf):
    return drift.decisions(tape(spark, sf), HORIZON, EVERY, DAY, slot=SLOT, width=WIDTH)


GRID = f"(select day, ticker, cast(h as double) * 1800 as t, h from (select distinct day, ticker from {T}) g, range(45) r(h))"
SEEN = f"""(select g.day, g.ticker, g.t, g.h, a.* exclude (day, ticker) from {GRID} g asof join
 (select *, {MID} as mid from {T} qualify {LASTROW}) a on g.day = a.day and g.ticker = a.ticker and g.t >= a.time)"""
ORDERS = f"""(select day, ticker, h || '/' || side || '/0.0' as "order", t as decision_time, seq as place_seq, side,
  case when side > 0 then bid_price else ask_price end as price, 300 as size, t + 3600 - time as max_wait
  from {SEEN}, (values (1), (-1)) s(side))"""


@query("sample_orders", f"select * from {ORDERS}", "decision_time max_wait")
def _(spark, sf):
    return orders(spark, sf).drop("latency")


def fills_sql(orders: str, extra: str = "", models=("touch", "fifo", "through")) -> str:
    """The replay as a plain range join: every order against every later message of its day."""
    px = "(case when side > 0 then {} else {} end)".format
    q = 'o.day, o.ticker, o."order"'
    return f"""(with o0 as (select o.*, t.time as place_time, t.time + max_wait as deadline,
   {px(_at('o.price', 0), _at('o.price', 1))} as queue_ahead,
   {px('o.price >= ask_price or o.price < bid3', 'o.price <= bid_price or o.price > ask3')} as rejected
   from {orders} o join (select day, ticker, seq, time, bid_price, bid_size, ask_price, ask_size, bid2, bid2_size, bid3, bid3_size, ask2, ask2_size, ask3, ask3_size from {T}) t
   on o.day = t.day and o.ticker = t.ticker and o.place_seq = t.seq),
  fin as (select day, ticker, max(seq) as last_seq, arg_max(time, seq) as last_time from {T} group by day, ticker),
  j as (select {q}, o.side, o.price as q, o.size as osize, o.queue_ahead, m.seq, m.time, m.type, m.price as mp, m.size as ms, m.order_id, m.direction,
    (m.type in (4, 5) and {px('m.price < o.price', 'm.price > o.price')}) or {px('m.ask_price <= o.price', 'm.bid_price >= o.price')} as whole,
    {px('m.bid3 > o.price', 'm.ask3 < o.price')} as gone
   from o0 o join {T} m on o.day = m.day and o.ticker = m.ticker and m.seq > o.place_seq and m.time <= o.deadline where not o.rejected),
  e as (select day, ticker, "order", min(seq) filter (type = 7) as halt, min(seq) filter (whole) as all_in, min(seq) filter (gone) as exit_seq,
    max(seq) as to_seq, least(min(seq) filter (type = 7) - 1, min(seq) filter (whole), min(seq) filter (gone)) as stop from j group by all),
  k as (select j.* from j join e using (day, ticker, "order") where stop is null or seq <= stop),
  tch as (select day, ticker, "order", min(seq) as full_seq from k where type in (4, 5) and mp = q group by all),
  lv as (select *, coalesce(last_value(case type when 1 then 1 when 3 then 0 end ignore nulls) over (partition by day, ticker, "order", order_id order by seq rows between unbounded preceding and 1 preceding), 0) as behind
    from k where type between 1 and 4 and mp = q and direction = side),
  dr as (select *, case when type = 4 then ms when type in (2, 3) and behind = 0 then ms else 0 end as dec from lv),
  ah as (select *, greatest(queue_ahead - coalesce(sum(dec) over (partition by day, ticker, "order" order by seq rows between unbounded preceding and 1 preceding), 0), 0) as ahead from dr),
  got as (select *, greatest(ms - ahead, 0) as g, sum(greatest(ms - ahead, 0)) over (partition by day, ticker, "order" order by seq) as cum from ah where type = 4),
  ff as (select day, ticker, "order", least(max(cum), max(osize)) as got, max(seq) filter (g > 0 and cum - g < osize) as last_fill, min(seq) filter (cum >= osize) as full_seq from got where g > 0 group by all),
  l0 as (select day, ticker, "order", max(queue_ahead) as q0, max(osize) as cap, list({{'a': 0e0, 'b': 0e0, 'got': cast(0 as bigint), 'seq': seq, 'type': type, 'sh': cast(ms as double), 'cap': cast(osize as bigint)}} order by seq) as ev from lv group by all),
  lf as (select day, ticker, "order", cap, list_reduce(ev, lambda s, e: {{'a': case when e.type in (2, 3) and s.a + s.b > 0 then greatest(s.a - e.sh * s.a / (s.a + s.b), 0e0) when e.type = 4 then s.a - least(s.a, e.sh) else s.a end,
    'b': case when e.type in (2, 3) and s.a + s.b > 0 then greatest(s.b - e.sh * s.b / (s.a + s.b), 0e0) when e.type = 1 then s.b + e.sh else s.b end,
    'got': s.got + case when e.type = 4 then least(cast(floor(e.sh - least(s.a, e.sh)) as bigint), s.cap - s.got) else 0 end,
    'seq': case when e.type = 4 and least(cast(floor(e.sh - least(s.a, e.sh)) as bigint), s.cap - s.got) > 0 then e.seq else s.seq end, 'type': e.type, 'sh': e.sh, 'cap': s.cap}},
    {{'a': cast(q0 as double), 'b': 0e0, 'got': cast(0 as bigint), 'seq': cast(null as bigint), 'type': 0, 'sh': 0e0, 'cap': cast(cap as bigint)}}) as f from l0),
  a as (select 'through' as model, o.*, null as got, null as last_fill, null as full_seq from o0 o
    union all by name select 'touch' as model, o.*, null as got, null as last_fill, full_seq from o0 o left join tch using (day, ticker, "order")
    union all by name select 'l2' as model, o.*, f.got as got, f.seq as last_fill, case when f.got >= cap then f.seq end as full_seq from o0 o left join lf using (day, ticker, "order")
    union all by name select 'fifo' as model, o.*, got, last_fill, full_seq from o0 o left join ff using (day, ticker, "order")),
  b as (select a.*, halt, exit_seq, to_seq, stop, last_seq, last_time, least(case when all_in <= stop then all_in end, full_seq) as done from a join fin using (day, ticker) left join e using (day, ticker, "order")),
  c as (select *, case when rejected then 'rejected' when done is not null then 'filled' when halt is not null and (exit_seq is null or halt <= exit_seq) then 'halt'
    when exit_seq is not null then 'level_exit' when last_time > deadline then 'timeout' else 'end_of_data' end as end_reason from b)
  select day, ticker, "order", {extra} model, place_seq, side, price, size,
   cast(case when end_reason = 'filled' then size when rejected then 0 else coalesce(got, 0) end as bigint) as filled_qty,
   case when end_reason = 'filled' then done else last_fill end as fill_seq,
   (select time from {T} x where x.seq = case when end_reason = 'filled' then done else last_fill end) as fill_time,
   case when end_reason = 'filled' or coalesce(got, 0) > 0 then price else 0 end as fill_price,
   case end_reason when 'rejected' then place_seq when 'filled' then done when 'halt' then halt when 'level_exit' then exit_seq when 'timeout' then coalesce(to_seq, place_seq) else last_seq end as end_seq,
   case end_reason when 'timeout' then deadline when 'rejected' then place_time when 'end_of_data' then last_time
     else (select time from {T} x where x.seq = case end_reason when 'filled' then done when 'halt' then halt else exit_seq end) end as end_time,
   end_reason, cast(queue_ahead as bigint) as queue_ahead from c where model in ({', '.join(repr(m) for m in models)}))"""


FILLS = fills_sql(ORDERS, "decision_time,")


@query("fills_all_models", f"select * from {FILLS}", "decision_time fill_time end_time")
def _(spark, sf):
    return fills.simulate(tape(spark, sf), orders(spark, sf).drop("latency"), slot=SLOT, width=WIDTH)


def one_model(model):
    @query(f"fills_{model}", f"select * from {fills_sql(ORDERS, 'decision_time,', (model,))}", "decision_time fill_time end_time")
    def _(spark, sf):
        return fills.simulate(tape(spark, sf), orders(spark, sf).drop("latency"), (model,), slot=SLOT, width=WIDTH)


for _m in fills.ALL_MODELS:
    one_model(_m)


L2 = fills_sql(ORDERS, "", ("fifo", "l2"))


@query("fill_model_agreement", f"""select day, ticker, avg(case when l2 = fifo then 1.0 else 0.0 end) as l2_agrees, avg(case when l2 = 1 and fifo = 0 then 1.0 else 0.0 end) as l2_only, avg(case when fifo = 1 and l2 = 0 then 1.0 else 0.0 end) as fifo_only
  from (select day, ticker, "order", max(case when model = 'l2' and filled_qty > 0 then 1 else 0 end) as l2, max(case when model = 'fifo' and filled_qty > 0 then 1 else 0 end) as fifo from {L2} group by 1, 2, 3) group by 1, 2""", "l2_agrees l2_only fifo_only")
def _(spark, sf):
    return drift.model_agreement(fills.simulate(tape(spark, sf), orders(spark, sf), ("fifo", "l2"), slot=SLOT, width=WIDTH))


@query("fill_end_reasons", f"""select model, end_reason, count(*) as n, count(*) filter (filled_qty > 0 and filled_qty < size) as partial
  from {FILLS} group by all""")
def _(spark, sf):
    return drift.end_counts(fills.simulate(tape(spark, sf), orders(spark, sf), slot=SLOT, width=WIDTH), [])


MIDS = f"(select *, {MID} as mid from {T} qualify {LASTROW})"


def _mid_at(src, at):
    return f"(select p.*, a.mid as m from {src} p asof left join {MIDS} a on p.day = a.day and p.ticker = a.ticker and {at} >= a.time)"


def _stack(src):
    s = f"(select *, mid0 as md0 from (select q0.* rename (m as mid0) from {_mid_at(src, 'decision_time')} q0))"
    for h in HORIZONS:
        n = drift.label(h)
        s = f"(select q1.* exclude (m), side * (m - price) / 100.0 as base_{n} from {_mid_at(s, f'decision_time + {h}')} q1)"
        s = f"(select q2.* exclude (m), case when filled_qty > 0 then side * (m - price) / 100.0 end as drift_{n} from {_mid_at(s, f'coalesce(fill_time, 0) + {h}')} q2)"
    cols = [f"{k}_{drift.label(h)}" for h in HORIZONS for k in ("base", "drift")]
    bps = ", ".join(f"{c} * 1e6 / mid0 as {c}_bps" for c in cols)
    return f"""(select z.* exclude (md0), filled_qty / cast(size as double) as fill_frac, {bps}, median_queue,
      (case when queue_ahead >= 0.5 * median_queue then 1 else 0 end) + (case when queue_ahead >= median_queue then 1 else 0 end) + (case when queue_ahead >= 2 * median_queue then 1 else 0 end) as queue_bucket
      from {s} z left join (select day, ticker, quantile_cont(queue_ahead, 0.5) as median_queue from {src} where model = 'touch' group by day, ticker) mq using (day, ticker))"""


DRIFT = _stack(FILLS)
DCOLS = [f"{k}_{drift.label(h)}{u}" for h in HORIZONS for k in ("drift", "base") for u in ("", "_bps")]


@query("order_drift", f"select * from {DRIFT}", "decision_time fill_time end_time mid0 fill_frac median_queue " + " ".join(DCOLS))
def _(spark, sf):
    return drifted(spark, sf).drop("latency").withColumn("queue_bucket", F.col("queue_bucket").cast("long"))


def _agg(c):
    if c.startswith("drift"):
        return f"sum({c} * filled_qty) / nullif(sum(filled_qty) filter ({c} is not null), 0) as {c}"
    return f"avg({c}) as {c}"


@query("drift_summary", f"""select ticker, model, count(*) as n_orders, avg(case when filled_qty > 0 then 1.0 else 0.0 end) as p_fill, avg(fill_frac) as fill_frac,
  {', '.join(_agg(c) for c in DCOLS)} from {DRIFT} group by ticker, model""", "p_fill fill_frac " + " ".join(DCOLS))
def _(spark, sf):
    return drift.summarize(drifted(spark, sf), HORIZONS, ["ticker"])


@query("drift_by_queue", f"""select model, queue_bucket, count(*) as n, avg(case when filled_qty > 0 then 1.0 else 0.0 end) as p_fill,
  sum(drift_600 * filled_qty) / nullif(sum(filled_qty) filter (drift_600 is not null), 0) as drift, quantile_cont(queue_ahead, 0.5) as median_queue from {DRIFT} group by all""",
       "p_fill drift median_queue")
def _(spark, sf):
    return drift.by_queue(drifted(spark, sf), 600.0, [])


def _spread_sql(h):
    tr = f"(select *, 0 as zz from {TRADES} where time < 82800)"
    src = _mid_at(tr, f"p.time + {h}").replace("a.mid as m", "a.mid as mh")
    k = {"effective": "2 * sign * (vwap - mid_before)", "realized": "2 * sign * (vwap - mh)", "impact": "2 * sign * (mh - mid_before)"}
    cols = ", ".join(f"sum({x} * size) / sum(size) / 100 as {n}_ticks, sum({x} / mid_before * 1e4 * size) / sum(size) as {n}_bps" for n, x in k.items())
    return f"select ticker, cast({h} as double) as horizon, count(*) as n_trades, {cols} from {src} where mid_before is not null group by ticker"


@query("spread_parts", " union all ".join(_spread_sql(h) for h in HORIZONS),
       "effective_ticks effective_bps realized_ticks realized_bps impact_ticks impact_bps")
def _(spark, sf):
    # per ticker over its days: trades are grouped within the day, values pooled per ticker
    parts = drift.spread_parts(tape(spark, sf), HORIZONS, DAY, slot=SLOT, pool=["ticker"])
    return parts


def dec_orders_sql(horizon):
    return f"""(select day, ticker, cast(h as varchar) as "order", seq as place_seq, t, imb, mid, ask_price, bid_price, qb, qa,
  case when imb > 0 then 1 else -1 end as side, case when imb > 0 then bid_price else ask_price end as price, 100 as size, t + {horizon} - time as max_wait
  from (select g.*, (bid_size - ask_size) / cast(bid_size + ask_size as double) as imb, bid_size as qb, ask_size as qa from {SEEN.replace('range(45)', f'range({int((86400 - horizon) / EVERY + 1e-9) + 1})')} g) where imb <> 0)"""


def dec_sql(horizon):
    orders = dec_orders_sql(horizon)
    return f"""(select d.day, d.ticker, d."order", f.model, d.t, d.side, imb as imbalance, abs(imb) as strength, signal_bucket, queue,
   (case when queue >= 0.5 * mq then 1 else 0 end) + (case when queue >= mq then 1 else 0 end) + (case when queue >= 2 * mq then 1 else 0 end) as queue_bucket,
   (ask_price - bid_price) / 100.0 as spread, 1e6 / mid as tick_bps, d.side * (m - mid) / 100.0 as move,
   d.side * (m - (case when imb > 0 then ask_price else bid_price end)) / 100.0 as ev_cross, filled_qty / 100.0 as fill_frac,
   filled_qty / 100.0 * d.side * (m - d.price) / 100.0 as ev_post,
   filled_qty / 100.0 * d.side * (m - d.price) / 100.0 - d.side * (m - (case when imb > 0 then ask_price else bid_price end)) / 100.0 as diff
  from (select *, quantile_cont(queue, 0.5) over (partition by day, ticker) as mq from (select *, case when imb > 0 then qb else qa end as queue,
     (case when abs(imb) > 0.2 then 1 else 0 end) + (case when abs(imb) > 0.4 then 1 else 0 end) + (case when abs(imb) > 0.6 then 1 else 0 end) + (case when abs(imb) > 0.8 then 1 else 0 end) as signal_bucket
     from {_mid_at(orders, f't + {horizon}')})) d join {fills_sql('(select day, ticker, "order", place_seq, side, price, size, max_wait from ' + orders + ')', '')} f on d.day = f.day and d.ticker = f.ticker and d."order" = f."order")"""


DEC = dec_sql(3600)


@query("decision_values", f"select * from {DEC}", "t imbalance strength spread tick_bps move ev_cross fill_frac ev_post diff")
def _(spark, sf):
    return decided(spark, sf)


@query("decision_cells", f"""select model, queue_bucket, signal_bucket, count(*) as n, avg(case when fill_frac > 0 then 1.0 else 0.0 end) as p_fill, avg(ev_post) as ev_post,
  avg(ev_cross) as ev_cross, avg(diff) as diff, case when count(*) >= 20 then avg(diff) end as grid from {DEC} group by all""", "p_fill ev_post ev_cross diff grid")
def _(spark, sf):
    return drift.cell_table(decided(spark, sf))


def rule_sql(train, by="ticker, "):
    return f"""(select {by}model, queue_bucket, signal_bucket, case when count(*) < 20 or greatest(0.0, round(avg(ev_post), 12), round(avg(ev_cross), 12)) <= 0 then 'none'
   when round(avg(ev_post), 12) >= round(avg(ev_cross), 12) then 'post' else 'cross' end as action from {DEC} where {train} group by all)"""


RULE = rule_sql("t + 3600 <= 43200")


@query("decision_rule", f"select * from {RULE}")
def _(spark, sf):
    return drift.choose(decided(spark, sf).where(F.col("t") + HORIZON <= HALF), ["ticker"])


SCORED = """(select d.*, coalesce(action, 'none') as action, case action when 'post' then ev_post when 'cross' then ev_cross else 0.0 end as ev
  from {dec} d left join {rule} r on {on} and d.model = r.model and d.queue_bucket = r.queue_bucket and d.signal_bucket = r.signal_bucket)"""


@query("decision_rule_scored", f"""select ticker, model, avg(ev) as ev, avg(ev - 0.3 * (case when action = 'cross' then 1 else 0 end)) as net_of_fee,
  avg(case when action = 'post' then 1.0 else 0.0 end) as share_post, avg(case when action = 'cross' then 1.0 else 0.0 end) as share_cross, count(*) as n_test
  from {SCORED.format(dec=DEC, rule=RULE, on='d.ticker = r.ticker')} where t >= 43200 group by all""", "ev net_of_fee share_post share_cross")
def _(spark, sf):
    d = decided(spark, sf)
    rule = drift.choose(d.where(F.col("t") + HORIZON <= HALF), ["ticker"])
    s = drift.apply_rule(rule, d.where(F.col("t") >= HALF), ["ticker"])
    share = lambda a: F.avg((F.col("action") == a).cast("double"))
    return s.groupBy("ticker", "model").agg(
        F.avg("ev").alias("ev"), F.avg(F.col("ev") - 0.3 * (F.col("action") == "cross").cast("double")).alias("net_of_fee"),
        share("post").alias("share_post"), share("cross").alias("share_cross"), F.count(F.lit(1)).alias("n_test"))


def rules(spark, sf):
    return drift.evaluate_rule(decided(spark, sf), ["ticker"], HALF, HORIZON, reps=500, block=7200.0)


@query("rule_intervals")
def _(spark, sf):
    return rules(spark, sf)


@query("signal_verdict")
def _(spark, sf):
    return drift.verdict(rules(spark, sf))


LODO_RULE = f"""(select day, ticker, model, queue_bucket, signal_bucket, case when n < 20 or greatest(0.0, round(p / n, 12), round(c / n, 12)) <= 0 then 'none' when round(p / n, 12) >= round(c / n, 12) then 'post' else 'cross' end as action
  from (select o.day, o.ticker, o.model, o.queue_bucket, o.signal_bucket, a.n - o.n as n, nullif(a.p - o.p, -1e99) as p, a.c - o.c as c from
  (select day, ticker, model, queue_bucket, signal_bucket, count(*) as n, sum(ev_post) as p, sum(ev_cross) as c from {DEC} group by all) o join
  (select ticker, model, queue_bucket, signal_bucket, count(*) as n, sum(ev_post) as p, sum(ev_cross) as c from {DEC} group by all) a
  using (ticker, model, queue_bucket, signal_bucket)))"""


@query("leave_one_day_out", f"""select ticker, model, day, avg(ev) as oos, avg(ev - 0.3 * (case when action = 'cross' then 1 else 0 end)) as net_of_fee, avg(ev_post) as always_post,
  avg(ev_cross) as always_cross, avg(case when action = 'post' then 1.0 else 0.0 end) as share_post, avg(case when action = 'cross' then 1.0 else 0.0 end) as share_cross, count(*) as n
  from {SCORED.format(dec=DEC, rule=LODO_RULE, on='d.ticker = r.ticker and d.day = r.day')} group by all""", "oos net_of_fee always_post always_cross share_post share_cross")
def _(spark, sf):
    return drift.leave_one_day_out(decided(spark, sf))


REB = f"(select d.*, rebate from {DEC} d, (values (0e0), (2e-1), (3e-1)) v(rebate))"


@query("rebate_sensitivity", f"""with d as materialized (select * from {REB}), rule as (select ticker, rebate, model, queue_bucket, signal_bucket, case when count(*) < 20 or greatest(0.0, round(avg(ev_post + rebate * fill_frac), 12), round(avg(ev_cross - 0.3), 12)) <= 0 then 'none'
   when round(avg(ev_post + rebate * fill_frac), 12) >= round(avg(ev_cross - 0.3), 12) then 'post' else 'cross' end as action from d where t + 3600 <= 43200 group by 1, 2, 3, 4, 5)
  select d.ticker, d.rebate, d.model, avg(case action when 'post' then ev_post + d.rebate * fill_frac when 'cross' then ev_cross - 0.3 else 0.0 end) as net, avg(case when action = 'post' then 1.0 else 0.0 end) as share_post,
   avg(case when action = 'cross' then 1.0 else 0.0 end) as share_cross, count(*) as n_test from d left join rule using (ticker, rebate, model, queue_bucket, signal_bucket) where t >= 43200 group by 1, 2, 3""", "rebate net share_post share_cross")
def _(spark, sf):
    return drift.sensitivity(decided(spark, sf), ["ticker"], HALF, HORIZON)


def _scores_sql(check, horizon, dec):
    rule = rule_sql(f"t + {horizon} <= 43200").replace(DEC, dec)
    score = lambda when: SCORED.format(dec=dec, rule=rule, on="d.ticker = r.ticker") + f" where {when} group by ticker, model"
    return f"""select '{check}' as "check", {horizon}e0 as horizon, * from (select ticker, model, avg(ev) as out_of_sample, avg(ev * tick_bps) as oos_bps, avg(ev_post) as always_post, avg(ev_cross) as always_cross,
   avg(case when action = 'post' then 1.0 else 0.0 end) as share_post, avg(case when action = 'cross' then 1.0 else 0.0 end) as share_cross, count(*) as n_test, avg(ev) filter (action <> 'none') as per_trade,
   avg(ev - 0.3 * (case when action = 'cross' then 1 else 0 end)) as net_of_fee from {score('t >= 43200')}) left join (select ticker, model, avg(ev) as in_sample from {score(f't + {horizon} <= 43200')}) using (ticker, model)"""


MORNING = f"""(select * replace ((case when queue >= 0.5 * mm then 1 else 0 end) + (case when queue >= mm then 1 else 0 end) + (case when queue >= 2 * mm then 1 else 0 end) as queue_bucket) from
  (select d.*, quantile_cont(queue, 0.5) filter (model = 'fifo' and t + 3600 <= 43200) over (partition by day, ticker) as mm from {DEC} d))"""
SWEPT = (600, 3600, 7200)


@query("horizon_sensitivity", " union all ".join([*[_scores_sql("horizon", h, dec_sql(h)) for h in SWEPT], _scores_sql("morning_median", 3600, MORNING)]),
       "horizon out_of_sample oos_bps always_post always_cross share_post share_cross per_trade net_of_fee in_sample", 5)
def _(spark, sf):
    return drift.horizon_sensitivity(tape(spark, sf), [float(h) for h in SWEPT], HORIZON, HALF, ["ticker"], every=EVERY, session=DAY, slot=SLOT, width=WIDTH)


def cells(spark, sf):
    t = tape(spark, sf)
    return drift.stock_day_cells(drifted(spark, sf, fills.ALL_MODELS), tp.facts(t, DAY), 600.0)


_WIDE = ", ".join(f"max({x}) filter (model = '{m}') as {x}_{m}" for m in fills.ALL_MODELS for x in ("p_fill", "drift", "drift_bps"))
_MEAN = "sum({0} * filled_qty) / nullif(sum(filled_qty) filter ({0} is not null), 0)".format
CELLS = f"""(with d as materialized (select * from {_stack(fills_sql(ORDERS, 'decision_time,', fills.ALL_MODELS))}),
 s as (select day, ticker, model, avg(case when filled_qty > 0 then 1e0 else 0e0 end) as p_fill, {_MEAN('drift_600')} as drift, {_MEAN('drift_600_bps')} as drift_bps, count(*) as orders from d group by day, ticker, model),
 w as (select day, ticker, max(orders) as orders, {_WIDE} from s group by day, ticker),
 g as (select day, ticker, avg(case when l2 = fifo then 1e0 else 0e0 end) as l2_agrees, avg(case when l2 = 1 and fifo = 0 then 1e0 else 0e0 end) as l2_only, avg(case when fifo = 1 and l2 = 0 then 1e0 else 0e0 end) as fifo_only
   from (select day, ticker, "order", max(case when filled_qty > 0 then 1 else 0 end) filter (model = 'l2') as l2, max(case when filled_qty > 0 then 1 else 0 end) filter (model = 'fifo') as fifo from d group by all) group by day, ticker)
 select w.*, drift_bps_touch - drift_bps_fifo as gap_bps, drift_touch - drift_fifo as gap_ticks, l2_agrees, l2_only, fifo_only, mean_price, tick_bps, spread_ticks, share_one_tick, depth_best, tick_class
 from w join g using (day, ticker) left join {FACTS} f using (day, ticker))"""
_NUM = [f"{x}_{m}" for m in fills.ALL_MODELS for x in ("p_fill", "drift", "drift_bps")] + "gap_bps gap_ticks l2_agrees l2_only fifo_only mean_price tick_bps spread_ticks share_one_tick depth_best".split()


@query("stock_day_cells", f"select * from {CELLS}", " ".join(_NUM))
def _(spark, sf):
    return cells(spark, sf)


@query("many_days_by_ticker", f"""select ticker, count(*) as days, (select tick_class from {CELLS} y where y.ticker = x.ticker group by tick_class order by count(*) desc, tick_class limit 1) as tick_class, avg(mean_price) as mean_price, avg(spread_ticks) as spread_ticks,
  avg(gap_bps) as gap_bps, avg(case when gap_bps is not null then (case when gap_bps > 0 then 1e0 else 0e0 end) end) as share_gap_positive, {', '.join(f'avg(p_fill_{m}) as p_fill_{m}' for m in fills.ALL_MODELS)},
  avg(100 * (p_fill_l2 - p_fill_fifo)) as l2_extra_fills_pp, avg(drift_bps_l2 - drift_bps_fifo) as l2_drift_error_bps, avg(l2_agrees) as l2_agrees from {CELLS} x group by ticker""",
       "mean_price spread_ticks gap_bps share_gap_positive " + " ".join(f"p_fill_{m}" for m in fills.ALL_MODELS) + " l2_extra_fills_pp l2_drift_error_bps l2_agrees")
def _(spark, sf):
    return drift.by_ticker(cells(spark, sf))


@query("many_days_pooled")
def _(spark, sf):
    from tapeworks.operators import evaluate

    d = drift.pooled_daily(cells(spark, sf))
    d = d.select(F.lit("gap_bps").alias("series"), F.datediff("day", F.lit("2000-01-01")).alias("pos"), F.col("gap_bps").alias("x")).unionByName(
        d.select(F.lit("l2_extra_fills_pp").alias("series"), F.datediff("day", F.lit("2000-01-01")).alias("pos"), F.col("l2_extra_fills_pp").alias("x")))
    return evaluate.bootstrap_ci(d, ["series"], "pos", "x", statistic="mean", reps=500, block=1.0)


LATE_ORDERS = f"""(select s.day, s.ticker, s.h || '/' || side || '/' || latency as "order", s.t as decision_time, latency, p.seq as place_seq, side, case when side > 0 then s.bid_price else s.ask_price end as price, 300 as size, s.t + latency + 3600 - p.time as max_wait
  from (select * from {SEEN}, (values {', '.join(f'({x}::double)' for x in LATENCIES)}) l(latency), (values (1), (-1)) v(side) where t <= {86400 - WAIT - HORIZON} - latency) s asof join (select * from {T} qualify {LASTROW}) p on s.day = p.day and s.ticker = p.ticker and s.t + latency >= p.time)"""
LATE = f"""(select day, ticker, latency, model, avg(case when end_reason = 'rejected' then 1e0 else 0e0 end) as rejected, avg(case when filled_qty > 0 then 1e0 else 0e0 end) as p_fill, {_MEAN('drift_600_bps')} as drift_bps
  from {_stack(fills_sql(LATE_ORDERS, 'decision_time, latency,', ('touch', 'fifo', 'l2')))} group by all)"""


@query("latency_sweep", f"""with c as materialized (select * from {LATE}), k as (select ticker, tick_class from {FACTS} group by ticker, tick_class qualify row_number() over (partition by ticker order by count(*) desc, tick_class) = 1),
  j as (select c.*, z.drift_bps as d0, tick_class from c left join (select day, ticker, model, drift_bps from c where latency = 0) z using (day, ticker, model) join k using (ticker))
  select class, latency, model, avg(rejected) as rejected, avg(p_fill) as p_fill, avg(drift_bps) as drift_bps, avg(drift_bps - d0) as change_bps, count(*) as stock_days from (select *, tick_class as class from j union all select *, 'all' from j) group by class, latency, model""",
       "latency rejected p_fill drift_bps change_bps")
def _(spark, sf):
    t = tape(spark, sf)
    o = orders(spark, sf, LATENCIES)
    d = drift.order_drift(t, o, ("touch", "fifo", "l2"), (600.0,), slot=SLOT, width=WIDTH, sets=["latency"])
    cls = tp.facts(t, DAY).groupBy("ticker").agg(F.mode("tick_class", deterministic=True).alias("tick_class"))
    return drift.pool_latency(drift.latency_cells(d, 600.0), cls)


@query("study_rollup", digits=4)
def _(spark, sf):
    """One row per ticker: replay check, facts, price impact, fills, verdict of the decision rule."""
    from tapeworks.operators.scan import cut
    from tapeworks.plans.tape_queries import regs

    t = tape(spark, sf)
    check = tp.consistency_summary(tp.consistency(t, ["day", "ticker"]), ["ticker"])
    facts = tp.facts(t, DAY).groupBy("ticker").agg(F.avg("spread_ticks").alias("spread_ticks"), F.avg("depth_best").alias("depth_best"), F.sum("n_trades").alias("n_trades"),
                                                   F.mode("tick_class", deterministic=True).alias("tick_class"))
    r2 = regs(spark, sf).groupBy("ticker").agg(F.avg("r2").alias("mean_r2"), F.min("r2").alias("min_r2"), F.percentile("beta", F.lit(0.5)).alias("median_beta"))
    sums = drift.summarize(drifted(spark, sf, ("fifo",)), HORIZONS, ["ticker"]).select("ticker", "n_orders", "p_fill", F.col("drift_600_bps").alias("fifo_drift_bps"))
    out = cut(check).join(cut(facts), "ticker").join(cut(r2), "ticker").join(cut(sums), "ticker")
    return out.join(drift.verdict(rules(spark, sf)), "ticker")


@query("signal_survives")
def _(spark, sf):
    return drift.survives(drift.verdict(rules(spark, sf)))

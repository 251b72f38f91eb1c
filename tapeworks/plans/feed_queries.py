"""Queries over decoded exchange events, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.operators import lifecycle as lc
from tapeworks.operators import proposals as pr
from tapeworks.plans.adapters import event_stream, feed, feed_sql, tape_sql
from tapeworks.plans.match_queries import POOL, REFS, books, refs
from tapeworks.plans.registry import query, table
from tapeworks.plans.tape_queries import T
from tapeworks.streaming import jobs

E = f"({feed_sql('sql')})"
NS = (0, 86_400 * 10**9)


def life_sql(by):
    """Order steps with the shares left before them."""
    p = f"partition by {by}, ref"
    return f"""(select *, case when not starts then greatest(coalesce(s_shares - coalesce(sum(take) over ({p}, start_step order by step rows between unbounded preceding and 1 preceding), 0), 0), 0) end as left_before from (
  select *, max(case when starts then step end) over ({p} order by step) as start_step, first_value(shares) over ({p}, grp order by step) as s_shares0, case when max(case when starts then step end) over ({p} order by step) is not null then first_value(shares) over ({p}, grp order by step) end as s_shares from (
  select *, sum(case when starts then 1 else 0 end) over ({p} order by step) as grp from (
   select day, ticker, seq, ts_ns, msg, side, shares, price, ref, msg in ('A', 'F') as starts, case when msg in ('A', 'F') then 0 when msg in ('D', 'U') then {lc.ALL_SHARES} else shares end as take, seq * 2 as step from {E} where msg in ('A', 'F', 'E', 'C', 'X', 'D', 'U')
   union all select day, ticker, seq, ts_ns, msg, side, shares, price, new_ref as ref, true, 0, seq * 2 + 1 from {E} where msg = 'U'))))"""


LIFE = life_sql("day")


@query("order_shares_left", f"select day, ref, seq, msg, cast(case when starts then shares else greatest(left_before - take, 0) end as bigint) as left_after from {LIFE}")
def _(spark, sf):
    return lc.shares_left(feed(spark, sf))


UN = ", ".join(f"count(*) filter (msg = '{k}' and not starts and left_before = 0) as unmatched_{k}" for k in lc.REDUCERS)
AUD = f"""(select day, count(*) filter (not starts) as "references", {UN}, greatest(max(live), 0) as peak_live_orders, cast(sum(chg) as bigint) as orders_left from (select *, sum(chg) over (partition by day order by step) as live from (
  select *, case when not starts and left_before > 0 and left_before <= take then -1 when starts then 1 else 0 end as chg from {LIFE})) group by day)"""


@query("reference_audit", f"select * from {AUD}")
def _(spark, sf):
    return lc.audit(feed(spark, sf))


@query("reference_audit_rollup", f"""select day, symbols, "references", {' + '.join(f'unmatched_{k}' for k in lc.REDUCERS)} as unmatched, orders_left, peak_live_orders from {AUD} join (select day, count(distinct ticker) as symbols from {E} group by day) using (day)""")
def _(spark, sf):
    f = feed(spark, sf)
    return lc.audit_rollup(lc.audit(f), f)


MSG = f"""(with recursive l as materialized (select * from {life_sql('day, ticker')}),
 real(day, ticker, step, side) as (select day, ticker, step, side from l where starts and msg <> 'U' union all
   select l.day, l.ticker, l.step + 1, r.side from l join real r on l.day = r.day and l.ticker = r.ticker and l.start_step = r.step where l.msg = 'U' and not l.starts and l.left_before > 0),
 pxs as (select day, ticker, step, price from l where starts)
 select l.day, l.ticker, l.step, l.ts_ns, 1 as type, ref as order_id, shares as size, price, case when r.side = 'B' then 1 else -1 end as direction from l join real r using (day, ticker, step) where starts
 union all select l.day, l.ticker, l.step, l.ts_ns, case when msg in ('E', 'C') then 4 when msg = 'X' and shares < left_before then 2 else 3 end, ref, cast(least(take, left_before) as bigint), p.price, case when r.side = 'B' then 1 else -1 end
   from l join real r on l.day = r.day and l.ticker = r.ticker and l.start_step = r.step join pxs p on p.day = l.day and p.ticker = l.ticker and p.step = l.start_step where not starts and left_before > 0
 union all select day, ticker, seq * 2, ts_ns, case msg when 'P' then 5 when 'Q' then 6 else 7 end, 0, case when msg = 'H' then 0 else shares end, case when msg = 'H' then case state when 'H' then -1 when 'T' then 1 else 0 end else price end,
   case when msg = 'P' and side = 'B' then 1 else -1 end from {E} where msg in ('P', 'Q', 'H'))"""


@query("feed_messages", f"select * from {MSG}")
def _(spark, sf):
    return lc.messages(feed(spark, sf))


@query("level_depth", f"""select day, ticker, step, direction, price, cast(sum(case when type = 1 then size else -size end) over (partition by day, ticker, direction, price order by step) as bigint) as depth from {MSG} where type between 1 and 4""")
def _(spark, sf):
    return lc.depth(lc.messages(feed(spark, sf))).select("day", "ticker", "step", "direction", "price", "depth")


LEVELS = 3


def flat(df, levels=LEVELS):
    """The levels of a book row as columns."""
    at = {f"{side}{i + 1}{'' if f == 'price' else '_size'}": F.col(f"{side}s")[i][f] for side in ("bid", "ask") for i in range(levels) for f in ("price", "size")}
    return df.withColumns(at).drop("bids", "asks")


# each level's size from one of its messages to the next, and the best levels of every message among those that stand then
_TOP = ", ".join(
    f"""coalesce(max(l.price) filter (l.direction = {d} and l.place = {i}), {-d * lc.NO_PRICE}) as {side}{i}, coalesce(cast(max(l.q) filter (l.direction = {d} and l.place = {i}) as bigint), 0) as {side}{i}_size"""
    for side, d in (("bid", 1), ("ask", -1)) for i in range(1, LEVELS + 1))
BOOK = f"""(with msgs as materialized (select * from {MSG}),
 runs as (select day, ticker, direction, price, step, sum(case when type = 1 then size else -size end) over w as q, lead(step) over w as until from msgs where type between 1 and 4 and size <> 0 window w as (partition by day, ticker, direction, price order by step)),
 standing as (select m.day, m.ticker, m.step, d.direction, d.price, d.q, row_number() over (partition by m.day, m.ticker, m.step, d.direction order by -d.direction * d.price) as place
   from msgs m join runs d on d.day = m.day and d.ticker = m.ticker and d.step <= m.step and (d.until is null or d.until > m.step) where d.q > 0)
 select m.day, m.ticker, m.step, m.ts_ns, m.type, m.order_id, m.size, m.price, m.direction, {_TOP} from msgs m left join standing l on l.day = m.day and l.ticker = m.ticker and l.step = m.step and l.place <= {LEVELS} group by all)"""


@query("feed_books", f"select * from {BOOK}")
def _(spark, sf):
    return flat(lc.books(lc.messages(feed(spark, sf)), LEVELS))


@query("feed_best_quotes", f"select day, ticker, step, bid1 as best_bid, ask1 as best_ask from {BOOK}")
def _(spark, sf):
    b = lc.books(lc.messages(feed(spark, sf)), 1)
    return b.select("day", "ticker", "step", F.col("bids")[0]["price"].alias("best_bid"), F.col("asks")[0]["price"].alias("best_ask"))


@query("feed_level_intervals", f"""select day, ticker, direction, price, cast(q as bigint) as size, step as from_step, until as until_step from (select *, sum(case when type = 1 then size else -size end) over w as q, lead(step) over w as until
  from {MSG} where type between 1 and 4 and size <> 0 window w as (partition by day, ticker, direction, price order by step)) where q > 0""")
def _(spark, sf):
    return lc.level_intervals(lc.messages(feed(spark, sf)))


_SEEN = [f"{side}{i}{f}" for side in ("bid", "ask") for i in range(1, LEVELS + 1) for f in ("", "_size")]
_NOW = "[" + ", ".join(_SEEN) + "]"


@query("feed_visible_rows", f"""select day, ticker, type, order_id, size, price, direction, step as seq, ts_ns / 1e9 as time, bid1 as bid_price, bid1_size as bid_size, ask1 as ask_price, ask1_size as ask_size, {', '.join(_SEEN)}
  from (select *, lag({_NOW}) over (partition by day, ticker order by step) as before from {BOOK} where ts_ns >= {lc.SESSION_NS[0]} and ts_ns < {lc.SESSION_NS[1]})
  where type >= 4 or before is null or before <> {_NOW}""", "time")
def _(spark, sf):
    return flat(lc.to_tape(lc.visible_rows(lc.books(lc.messages(feed(spark, sf)), LEVELS))))


@query("feed_consistency", f"""select day, ticker, count(*) as eligible, count(*) as checked, count(*) as passed, 1e0 as pass_rate, 1e0 as coverage from (select *, row_number() over (partition by day, ticker order by step) as i from {MSG}) where i > 1 and type between 1 and 4 group by 1, 2""", "pass_rate coverage")
def _(spark, sf):
    from tapeworks.operators import tape as tp

    rows = lc.to_tape(lc.books(lc.messages(feed(spark, sf)), 10))
    return tp.consistency_summary(tp.consistency(rows))


LIFE_T = life_sql("day, ticker")
REAL = f"""(with recursive l as materialized (select * from {LIFE_T}), real(day, ticker, step) as (select day, ticker, step from l where starts and msg <> 'U' union all
   select l.day, l.ticker, l.step + 1 from l join real r on l.day = r.day and l.ticker = r.ticker and l.start_step = r.step where l.msg = 'U' and not l.starts and l.left_before > 0)
 select l.day, l.ticker, l.msg, l.left_before > 0 and r.step is not null as ok from l left join real r on l.day = r.day and l.ticker = r.ticker and l.start_step = r.step where not l.starts)"""
_KINDS = {"executions": "msg in ('E', 'C')", "cancels": "msg = 'X'", "deletes": "msg = 'D'", "replaces": "msg = 'U'"}


@query("feed_stats", f"""select day, ticker, count(*) as events, count(*) filter (msg in ('A', 'F')) as adds, count(*) filter (msg = 'P') as hidden, count(*) filter (msg = 'Q') as crosses, {', '.join(f'coalesce(any_value({k}), 0) as {k}' for k in (*_KINDS, 'unmatched'))}
  from {E} left join (select day, ticker, {', '.join(f'count(*) filter (ok and {c}) as {k}' for k, c in _KINDS.items())}, count(*) filter (ok is distinct from true) as unmatched from {REAL} group by 1, 2) x using (day, ticker) group by day, ticker""")
def _(spark, sf):
    return lc.conversion_stats(feed(spark, sf))


@query("feed_missing_tickers", f"select n_nationkey as ticker from nation where n_nationkey not in (select ticker from {E})")
def _(spark, sf):
    return lc.missing_tickers(feed(spark, sf), table(spark, sf, "nation").select(F.col("n_nationkey").alias("ticker")))


# ------------------------------------------------------------------ streams


@query("stream_order_audit", f"select day, ref, seq, msg from {LIFE} where not starts and left_before = 0")
def _(spark, sf):
    events = spark.sql(feed_sql("spark", "{events}"), events=event_stream(spark, sf))
    return jobs.run_available(jobs.order_audit(lc.order_steps(events)))


STREAM_FLOW = f"""(select ticker, time, day, case when lag(bid_price) over w is null then 0 else (case when bid_price >= lag(bid_price) over w then bid_size else 0 end) - (case when bid_price <= lag(bid_price) over w then lag(bid_size) over w else 0 end)
  - (case when ask_price <= lag(ask_price) over w then ask_size else 0 end) + (case when ask_price >= lag(ask_price) over w then lag(ask_size) over w else 0 end) end as flow from {T} window w as (partition by ticker order by seq))"""


def stream_quotes(spark, sf):
    ev = event_stream(spark, sf)
    ts = F.col("day").cast("timestamp") + F.make_dt_interval(secs=F.col("time").cast("decimal(18,6)"))
    return spark.sql(tape_sql("spark", "{events}"), events=ev).withColumn("ts", ts).select("ticker", "seq", "ts", "bid_price", "bid_size", "ask_price", "ask_size")


@query("stream_flow_events", f"select ticker, cast(flow as double) as flow, count(*) as n from {STREAM_FLOW} group by ticker, flow", "flow")
def _(spark, sf):
    return jobs.run_available(jobs.flow_events(stream_quotes(spark, sf))).groupBy("ticker", "flow").agg(F.count(F.lit(1)).alias("n"))


@query("stream_flow_buckets", f"""select ticker, cast(ceil(s / 3600) - 1 as bigint) as hour, cast(sum(flow) as double) as flow, count(*) as n from (select *, epoch(cast(day as timestamp)) + time as s from {STREAM_FLOW})
  group by 1, 2""", "flow")
def _(spark, sf):
    """The stream emits the buckets that the watermark has closed; the end of the run adds those still open."""
    rows = jobs.run_available(jobs.flow_events(stream_quotes(spark, sf)))
    at = jobs.shared_folder(spark)
    rows.write.parquet(at)
    buckets = jobs.flow_buckets(spark.readStream.schema(rows.schema).parquet(at), "1 hour")
    done = jobs.run_available(buckets.select("ticker", F.col("window.start").alias("start"), "flow", "n"))
    tail = jobs.open_buckets(spark.read.schema(rows.schema).parquet(at), done, "1 hour")
    return done.unionByName(tail).select("ticker", (F.col("start").cast("long") / 3600).cast("long").alias("hour"), "flow", "n")


@query("stream_cool_down", f"""with recursive e as (select *, row_number() over (partition by contract_id order by ts, p) as i from (
    select user_id as contract_id, cast(ts as timestamp) as ts, floor(value / 5e1) / 1e2 + 3e-1 as p, 3e-1 as ask from events)),
  r as (select contract_id, i, ts, p, ask, true as keep, ts as last_ts, p as last_p from e where i = 1
    union all select contract_id, i, ts, p, ask, go, case when go then ts else last_ts end, case when go then p else last_p end from (
      select e.*, r.last_ts, r.last_p, epoch(e.ts) - epoch(r.last_ts) > {pr.COOL_HOURS} * 3600 or abs(e.p - r.last_p) >= cast({pr.MOVE} as double) as go from r join e on e.contract_id = r.contract_id and e.i = r.i + 1))
  select contract_id, ts, p, ask from r where keep""", "p ask")
def _(spark, sf):
    ev = event_stream(spark, sf)
    p = ev.select(F.col("user_id").alias("contract_id"), F.col("ts").cast("timestamp").alias("ts"), (F.floor(F.col("value") / 50) / 100 + 0.3).alias("p"), F.lit(0.3).alias("ask"))
    return jobs.run_available(jobs.cool_down(p))


NEWEST = """(select source, quote_id, quote_id as contract_id, false as invert, (1 + k % 97) / 99.0 as p, 'market' as kind, price as liquidity, price as volume_24h, 10 as n, cast(null as double) as bid, cast(null as double) as ask from (
  select *, row_number() over (partition by source, quote_id order by placed desc, (1 + k % 97) / 99.0 desc, price desc) as i from (
    select case when o_orderkey % 2 = 0 then 'kalshi' else 'polymarket' end as source, o_custkey as quote_id, o_orderdate as placed, o_orderkey as k, o_totalprice as price from orders)) where i = 1 and quote_id in (select c_custkey from customer))"""


@query("stream_quote_intake", f"select contract_id, p, lo, hi, n_refs from {POOL.replace(REFS, NEWEST)}", "p lo hi")
def _(spark, sf):
    schema = table(spark, sf, "orders").schema
    src = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf)
    q = src.select(F.when(F.col("o_orderkey") % 2 == 0, "kalshi").otherwise("polymarket").alias("source"), F.col("o_custkey").alias("quote_id"), F.col("o_orderdate").cast("timestamp").alias("ts"),
                   ((1 + F.col("o_orderkey") % 97) / 99.0).alias("p"), F.lit("market").alias("kind"), F.col("o_totalprice").alias("liquidity"), F.col("o_totalprice").alias("volume_24h"),
                   F.lit(10).alias("n"), F.lit(None).cast("double").alias("bid"), F.lit(None).cast("double").alias("ask"))
    maps = table(spark, sf, "customer").select(F.explode(F.array(F.lit("kalshi"), F.lit("polymarket"))).alias("source"), F.col("c_custkey").alias("quote_id"),
                                               F.col("c_custkey").alias("contract_id"), F.lit(False).alias("invert"))
    at = jobs.shared_folder(spark)
    held = pr.book_columns(books(spark, sf))
    jobs.intake(q, held, maps, at).awaitTermination()
    return jobs.newest(spark, jobs.pooled_table(at, held, q, maps)).select("contract_id", "p", "lo", "hi", "n_refs")

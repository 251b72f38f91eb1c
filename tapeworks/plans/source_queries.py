"""Queries that push the given tables through the formats the sources read and write."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.operators import evaluate
from tapeworks.plans.adapters import chain, series, series_sql, snapshots, snapshots_sql, tape
from tapeworks.plans.registry import query, table
from tapeworks.plans.tape_queries import T
from tapeworks.plans.trial_queries import TRIALS, trials as trial_pnl
from tapeworks.sources import market, trials, venues
from tapeworks.streaming.jobs import shared_folder


@query("tape_store", f"select day, ticker, count(*) as n, cast(sum(size) as bigint) as shares, max(seq) as last_seq, cast(sum(bid_size + bid2_size) as bigint) as two_levels from {T} group by 1, 2")
def _(spark, sf):
    at = shared_folder(spark)
    market.write_tape(tape(spark, sf), at)
    d = spark.read.parquet(at)
    two = F.aggregate(F.slice("bids", 1, 2), F.lit(0).cast("long"), lambda s, x: s + x["size"])
    return d.groupBy("day", F.col("ticker").cast("long").alias("ticker")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shares"), F.max("seq").alias("last_seq"), F.sum(two).alias("two_levels"))


@query("tape_store_days", f"select distinct day, ticker from {T}")
def _(spark, sf):
    at = shared_folder(spark)
    market.write_tape(tape(spark, sf), at)
    return market.available(spark, at).select("day", F.col("ticker").cast("long").alias("ticker"))


@query("auction_store", f"select stock_id, count(*) as n, sum(case when far_price is null then 1 else 0 end) as no_far, sum(matched_size) as matched from ({snapshots_sql('sql')}) s group by 1", "matched")
def _(spark, sf):
    at = shared_folder(spark)
    snapshots(spark, sf).write.option("header", True).csv(f"{at}/csv")
    market.write_auction(market.auction_csv(spark, f"{at}/csv"), f"{at}/parquet")
    d = market.load_auction(spark, f"{at}/parquet", ["stock_id", "far_price", "matched_size"])
    return d.groupBy(F.col("stock_id").cast("long").alias("stock_id")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("far_price").isNull()).alias("no_far"),
                                                                          F.sum(F.col("matched_size").cast("double")).alias("matched"))


@query("feed_file_dates", "select o_orderkey, cast(o_orderdate as date) as day from orders")
def _(spark, sf):
    o = table(spark, sf, "orders")
    long = F.concat(F.lit("/data/"), F.date_format("o_orderdate", "MMddyyyy"), F.lit(".NASDAQ_ITCH50.gz"))
    short = F.concat(F.lit("S"), F.date_format("o_orderdate", "MMddyy"), F.lit("-v50.txt.gz"))
    name = F.when((F.col("o_orderkey") % 2 == 0) | (F.year("o_orderdate") < 2000), long).otherwise(short)
    return o.select("o_orderkey", market.feed_date(name).alias("day"))


@query("index_series_join", f"select symbol, date, spx, cast(vix as double) as vix, cast(case when vix3m > 20 then vix3m end as double) as vix3m from ({series_sql()}) s where vix > 15", "spx vix vix3m")
def _(spark, sf):
    s = series(spark, sf)
    part = lambda c, cond: s.where(cond).select("symbol", "date", F.col(c).alias("close"))
    return market.index_series(part("spx", "true"), part("vix", "vix > 15"), part("vix3m", "vix3m > 20"))


@query("vendor_chain", """select p_partkey, 'C' as kind, cast(100 + p_size as double) as strike, date '2026-01-16' + cast(p_size as integer) as expiry, p_retailprice / 100 as bid from part where p_partkey % 6 <> 0""", "strike bid")
def _(spark, sf):
    p = table(spark, sf, "part")
    day = F.date_format(F.date_add(F.lit("2026-01-16").cast("date"), F.col("p_size")), "yyMMdd")
    root = F.when(F.col("p_partkey") % 6 == 0, "SPY1").otherwise("SPY")
    sym = F.concat(root, day, F.lit("C"), F.lpad(((100 + F.col("p_size")) * 1000).cast("string"), 8, "0"))
    opt = F.struct(sym.alias("option"), (F.col("p_retailprice") / 100).alias("bid"), (F.col("p_retailprice") / 100 + 0.1).alias("ask"), F.lit(1.0).alias("iv"))
    raw = p.select("p_partkey", F.lit("SPY").alias("ticker"), F.to_json(F.struct(F.struct(F.array(opt).alias("options")).alias("data"))).alias("payload"))
    return market.vendor_chain(raw).select("p_partkey", "kind", "strike", "expiry", "bid")


@query("chain_store", "select count(*) as n, max(p_partkey) as last from part")
def _(spark, sf):
    at = shared_folder(spark)
    ch = chain(spark, sf)
    market.save_chain(ch, ch.select("underlying").distinct().withColumn("S", F.lit(500.0)), at, "SPY_20260104")
    market.save_chain(ch, ch.select("underlying").distinct().withColumn("S", F.lit(500.0)), at, "SPY_20260105")
    c, _meta = market.load_chain(spark, at, market.latest_chain(spark, at, "SPY"))
    return c.agg(F.count(F.lit(1)).alias("n"), F.max("contract").alias("last"))


def logged(spark, sf):
    """Every trial of the given tables appended to a log, with a nested config."""
    at = shared_folder(spark)
    pnl = trial_pnl(spark, sf).withColumnRenamed("trial_id", "key")
    cfg = F.to_json(F.struct(F.struct((F.col("key") % 4).alias("group"), F.lit(1.5).alias("cut")).alias("model"), F.col("key").alias("id")))
    t = pnl.groupBy("key").agg(F.sum("pnl").alias("total")).select("key", cfg.alias("config"), F.to_json(F.struct("total")).alias("metrics"), F.lit('{"stage": "research"}').alias("tags"))
    trials.append(trials.log_rows(pnl, t), at)
    return trials.records(spark, at)


@query("trial_log_pnl", f"select trial_id as id, period, pnl from {TRIALS}", "pnl", 4)
def _(spark, sf):
    r = logged(spark, sf)
    ids = r.select("trial_id", F.get_json_object("config", "$.id").cast("long").alias("id"))
    return trials.long_pnl(r).join(ids, "trial_id").select("id", F.col("period").cast("long").alias("period"), "pnl")


@query("trial_log_flat", f"""select trial_id as id, cast(count(*) as integer) as n_obs, cast(trial_id % 4 as varchar) as "group", '1.5' as cut, 'research' as stage from {TRIALS} group by trial_id""")
def _(spark, sf):
    f = trials.columns(trials.flatten(logged(spark, sf)), ["config.id", "config.model.group", "config.model.cut", "tags.stage"])
    return f.select(F.col("`config.id`").cast("long").alias("id"), "n_obs", F.col("`config.model.group`").alias("group"), F.col("`config.model.cut`").alias("cut"), F.col("`tags.stage`").alias("stage"))


@query("config_hashes", """select o_orderkey, sha256('{"a":' || o_custkey || ',"b":"' || o_orderstatus || '"}') as hash from orders""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    text = F.format_string('{ "b": "%s",  "a": %d }', "o_orderstatus", "o_custkey")
    return o.select("o_orderkey", trials.config_hash(text).alias("hash"))


@query("new_trials_only", f"select count(*) as n from (select distinct trial_id from {TRIALS}) where trial_id % 2 = 1")
def _(spark, sf):
    from tapeworks.operators.auction import new_trials

    r = logged(spark, sf)
    seen = r.where("cast(get_json_object(config, '$.id') as long) % 2 = 0")
    return new_trials(r, seen).agg(F.count(F.lit(1)).alias("n"))


@query("trial_log_sharpes", f"select count(*) as n from (select distinct trial_id from {TRIALS})")
def _(spark, sf):
    s = evaluate.series_stats(evaluate.full_calendar(trials.long_pnl(logged(spark, sf))), ["trial_id"])
    return s.agg(F.count("sharpe").alias("n"))


PO = "(1 + (o_orderkey * 37) % 97) / 9.9e1"


@query("polymarket_quotes", f"""select cast(o_orderkey as varchar) as quote_id, outcome, case when outcome = 'Yes' and o_orderkey % 2 = 0 then cast(round({PO}, 4) as double) * 0 + 0.45 when outcome = 'Yes' then round({PO}, 4) else round(1 - round({PO}, 4), 4) end as p, o_totalprice as liquidity
  from orders, (values ('Yes'), ('No')) v(outcome) where o_orderstatus <> 'P'""", "p liquidity")
def _(spark, sf):
    o = table(spark, sf, "orders")
    p = F.round((1 + (F.col("o_orderkey") * 37) % 97) / 99.0, 4)
    q = F.lit('"')
    prices = F.concat(F.lit("["), q, p.cast("string"), q, F.lit(","), q, F.round(1 - p, 4).cast("string"), q, F.lit("]"))
    even = F.col("o_orderkey") % 2 == 0
    raw = o.select(F.to_json(F.struct(
        F.col("o_orderkey").cast("string").alias("id"), F.lit("Will it?").alias("question"), F.lit('["Yes","No"]').alias("outcomes"), prices.alias("outcomePrices"),
        (F.col("o_orderstatus") == "P").alias("closed"), F.when(even, "0.4").alias("bestBid"), F.when(even, "0.5").alias("bestAsk"), F.col("o_totalprice").cast("string").alias("liquidity"))).alias("json"))
    return venues.polymarket(raw).select("quote_id", "outcome", "p", "liquidity")


@query("kalshi_quotes", """select cast(o_orderkey as varchar) as quote_id, case when o_orderkey % 3 = 0 then 0.45 else 0.3 end as p, 'T ' || o_orderstatus as question from orders where o_orderkey % 3 <> 2""", "p")
def _(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey") % 3
    raw = o.select(F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("ticker"), F.lit("T").alias("title"), F.col("o_orderstatus").alias("yes_sub_title"),
                                      F.when(k == 0, "0.4").alias("yes_bid_dollars"), F.when(k == 0, "0.5").alias("yes_ask_dollars"), F.when(k < 2, "0.3").otherwise("0").alias("last_price_dollars"))).alias("json"))
    return venues.kalshi(raw).select("quote_id", "p", "question")


@query("kalshi_event_quotes", """select cast(o_orderkey as varchar) as quote_id, 'E ' || o_custkey as question, case when n = 1 then 'Yes' else 'L' || o_orderkey end as outcome from (select *, count(*) over (partition by o_custkey) as n from orders)""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    n = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    m = F.struct(F.col("o_orderkey").cast("string").alias("ticker"), F.when(F.col("n") > 1, F.concat(F.lit("L"), F.col("o_orderkey"))).alias("yes_sub_title"), F.lit("0.3").alias("last_price_dollars"))
    ev = o.join(n, "o_custkey").groupBy("o_custkey").agg(F.collect_list(m).alias("markets"))  # one event's markets
    raw = ev.select(F.to_json(F.struct(F.concat(F.lit("E "), F.col("o_custkey")).alias("title"), "markets")).alias("json"))
    return venues.kalshi_events(raw).select("quote_id", "question", "outcome")


@query("manifold_quotes", f"""select cast(o_orderkey as varchar) as quote_id, {PO} as p, o_custkey as n, o_orderkey % 4 <> 0 as dated from orders where o_orderstatus <> 'F'""", "p")
def _(spark, sf):
    o = table(spark, sf, "orders")
    raw = o.select(F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("id"), F.lit("Q").alias("question"), F.lit("BINARY").alias("outcomeType"), (F.col("o_orderstatus") == "F").alias("isResolved"),
                                      ((1 + (F.col("o_orderkey") * 37) % 97) / 99.0).alias("probability"), F.when(F.col("o_orderkey") % 4 == 0, 9e18).otherwise(1.8e12).alias("closeTime"), F.col("o_custkey").alias("uniqueBettorCount"))).alias("json"))
    return venues.manifold(raw).select("quote_id", "p", "n", F.col("end").isNotNull().alias("dated"))


@query("probabilities_read", "select o_orderkey, case when o_orderkey % 2 = 0 then (1 + o_orderkey % 98) / 1e2 else (1 + o_orderkey % 98) / 1e2 end as p from orders", "p")
def _(spark, sf):
    x = 1 + F.col("o_orderkey") % 98
    return table(spark, sf, "orders").select("o_orderkey", venues.as_prob(F.when(F.col("o_orderkey") % 2 == 0, x.cast("double")).otherwise(x / 100.0)).alias("p"))


@query("stable_numbers", "select p_partkey, p_retailprice / 7 as x from part", "x", 8)
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", market.stable_number(F.col("p_retailprice") / 7).alias("x"))

"""Views that read the given tables as market data. One SQL text per view, for Spark and for plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.plans.registry import table

DAY = (0.0, 86_400.0)  # the given events run around the clock

JSON_K = {"spark": "get_json_object(props, '$.k')", "sql": "json_extract_string(props, '$.k')"}
SECONDS = "cast(hour(ts) * 3600 + minute(ts) * 60 + second(ts) as double)"


def tape_sql(dialect: str, events: str = "events") -> str:
    return f"""
select day, ticker, seq, time, type, order_id, size, direction, bid_price, bid_size, ask_price, ask_size,
  case when direction = 1 then bid_price - (case when type in (4, 5) then 100 * (case when k % 10 = 9 then 1 else 0 end) else 100 * (k % 2) end)
       else ask_price + (case when type in (4, 5) then 100 * (case when k % 10 = 9 then 1 else 0 end) else 100 * (k % 2) end) end as price, k
from (
  select cast(ts as date) as day, user_id % 8 as ticker, event_id as seq, {SECONDS} as time,
    case when k = 99 then 7 when k = 98 then 6 when event_type = 'view' then 1 when event_type = 'click' then 2
         when event_type = 'signup' then 3 when event_type = 'purchase' then 4 else 5 end as type,
    user_id * 1000 + k % 3 as order_id, 100 * (1 + k % 5) as size,
    case when event_id % 2 = 0 then 1 else -1 end as direction,
    10000 + 100 * cast(floor(value / 60) as bigint) as bid_price, 100 * (1 + k % 9) as bid_size,
    10000 + 100 * cast(floor(value / 60) as bigint) + 100 + (case when event_id % 10 = 0 then 100 else 0 end) as ask_price,
    100 * (1 + event_id % 7) as ask_size, k
  from (select *, cast({JSON_K[dialect]} as bigint) as k from {events}) e0) e1"""


def tape(spark: SparkSession, sf: str) -> DataFrame:
    """Order events with three book levels a side. The text columns are cut before any shuffle."""
    t = spark.sql(tape_sql("spark", "{events}"), events=table(spark, sf, "events"))

    def side(price: str, size: str, step: int):
        k = F.col("k")
        return F.array(
            F.struct(F.col(price).alias("price"), F.col(size).alias("size")),
            F.struct((F.col(price) + step).alias("price"), (100 * (1 + (k + 1) % 9)).alias("size")),
            F.struct((F.col(price) + 2 * step).alias("price"), (100 * (1 + (k + 2) % 9)).alias("size")),
        )

    return t.withColumns({
        "bids": side("bid_price", "bid_size", -100), "asks": side("ask_price", "ask_size", 100),
    }).drop("k")


def tape_view() -> str:
    """The same tape for plain SQL, levels as flat columns."""
    return f"""(select *, bid_price - 100 as bid2, 100 * (1 + (k + 1) % 9) as bid2_size, bid_price - 200 as bid3,
  100 * (1 + (k + 2) % 9) as bid3_size, ask_price + 100 as ask2, 100 * (1 + (k + 1) % 9) as ask2_size,
  ask_price + 200 as ask3, 100 * (1 + (k + 2) % 9) as ask3_size from ({tape_sql('sql')}) tp)"""

DAY_INDEX = {"spark": "datediff(cast(ts as date), date '2024-01-01')", "sql": "datediff('day', date '2024-01-01', cast(ts as date))"}


def snapshots_sql(dialect: str, events: str = "events") -> str:
    """Auction snapshots: one row per stock, day and clock hour (20 auction seconds an hour)."""
    return f"""
select stock_id, date_id, seconds_in_bucket, sk * 10e0 as imbalance_size, se % 3 - 1 as imbalance_buy_sell_flag,
  wap + (sk % 7 - 3) / 1e4 as reference_price, 1e2 * (se % 11) as matched_size,
  case when seconds_in_bucket >= 300 then 1e0 + (se % 9 - 4) / 1e3 end as far_price,
  case when seconds_in_bucket >= 300 then 1e0 + (sk % 9 - 4) / 2e3 end as near_price,
  wap - (1 + n % 3) / 2e4 - (sk % 5 - 2) / 1e5 as bid_price, 1e4 * (1 + sk % 9) as bid_size,
  wap + (1 + n % 3) / 2e4 - (sk % 5 - 2) / 1e5 as ask_price, 1e4 * (1 + se % 7) as ask_size, wap,
  case when se % 17 = 0 then null else (se % 2001 - 1000) / 5e1 end as target, n, sk, se
from (
  select user_id % 12 as stock_id, {DAY_INDEX[dialect]} as date_id, 20 * hour(ts) as seconds_in_bucket,
    count(*) as n, cast(sum(cast({JSON_K[dialect]} as bigint)) as bigint) as sk, cast(sum(event_id) as bigint) as se,
    1e0 + (avg(value) - 5e1) / 1e4 as wap
  from {events} group by user_id % 12, {DAY_INDEX[dialect]}, 20 * hour(ts)) g"""


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(snapshots_sql("spark", "{events}"), events=table(spark, sf, "events"))


def series_sql(orders: str = "orders") -> str:
    """Daily index series of four underlyings from the orders of a date."""
    return f"""
select symbol, cast(o_orderdate as date) as date, 1e3 * exp(2e-2 * (avg(o_totalprice) / 2.5e5 - 1)) as spx,
  1.2e1 + cast(sum(o_custkey) as bigint) % 13 as vix,
  case when cast(o_orderdate as date) >= date '1996-01-01' then 1e1 + cast(sum(o_custkey) as bigint) % 13 + cast(sum(o_orderkey) as bigint) % 5 end as vix3m
from (select *, o_custkey % 4 as symbol from {orders}) o group by symbol, cast(o_orderdate as date)"""


def series(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(series_sql("{orders}"), orders=table(spark, sf, "orders"))


ASOF = "2026-01-05"  # 16:00 in New York that day is 21:00 UTC
TENORS = (7, 14, 30, 60, 91, 180)


def chain_sql(dialect: str, part: str = "part") -> str:
    """Option chains: 82 contracts per expiry, six expiries per underlying, spot 500."""
    div = "div" if dialect == "spark" else "//"
    days = "case (p_partkey " + div + " 82) % 6 " + " ".join(f"when {i} then {d}" for i, d in enumerate(TENORS)) + " end"
    add = f"date_add(date '{ASOF}', {{}})" if dialect == "spark" else f"(date '{ASOF}' + cast({{}} as integer))"
    return f"""
select contract, underlying, {add.format('days')} as expiry, kind, strike, mid0 - half as bid, mid0 + half as ask, mid0 - half > 0 as usable, days, p_size
from (select p_partkey as contract, p_partkey {div} 492 as underlying, {days} as days, case when p_partkey % 2 = 0 then 'C' else 'P' end as kind, 4e2 + 5 * ((p_partkey {div} 2) % 41) as strike,
   2e-2 * (1 + p_size % 3) as half, p_size,
   (case when p_partkey % 2 = 0 then greatest(1e2 - 5 * ((p_partkey {div} 2) % 41), 0) else greatest(5 * ((p_partkey {div} 2) % 41) - 1e2, 0) end)
    + 6e0 * exp(-abs(5e0 * ((p_partkey {div} 2) % 41) - 1e2) / 3e1) * sqrt(({days}) / 3e1) + p_size / 1e2 as mid0
  from {part}) c"""


def chain(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(chain_sql("spark", "{part}"), part=table(spark, sf, "part"))


def chain_meta(ch: DataFrame) -> DataFrame:
    return ch.select("underlying").distinct().select(
        "underlying", F.lit(500.0).alias("S"), F.lit(499.99).alias("s_bid"), F.lit(500.01).alias("s_ask"), F.lit(0.04).alias("r"),
        F.lit(f"{ASOF} 21:00:00").cast("timestamp").alias("quote_time"))


def feed_sql(dialect: str, events: str = "events") -> str:
    """Decoded exchange events: adds carry the row's id as reference, later events name a recent row."""
    div = "div" if dialect == "spark" else "//"
    return f"""
select day, ticker, seq, ts_ns, msg, case when msg in ('A', 'F') then seq when msg in ('P', 'Q', 'H') then 0 else seq - 1 - k % 12 end as ref,
  case when msg = 'U' then seq end as new_ref, case when seq % 2 = 0 then 'B' else 'S' end as side, 100 * (1 + k % 5) as shares,
  case when seq % 2 = 0 then 10000 - 100 * (k % 6) else 10100 + 100 * (k % 6) end as price, case when msg = 'H' then substr('HTP', 1 + cast(seq % 3 as int), 1) end as state
from (select cast(ts as date) as day, (event_id {div} 100) % 8 as ticker, event_id as seq, cast(hour(ts) * 3600 + minute(ts) * 60 + second(ts) as bigint) * 1000000000 as ts_ns, k,
   case when k = 98 then 'H' when k = 97 then 'Q' when k >= 94 then 'P' when event_type in ('view', 'signup') then case when k % 10 = 0 then 'F' else 'A' end
     when event_type = 'click' then case when k % 4 = 0 then 'C' else 'E' end when event_type = 'purchase' then 'U' when k % 2 = 0 then 'X' else 'D' end as msg
  from (select *, cast({JSON_K[dialect]} as bigint) as k from {events}) e0) e1"""


def feed(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(feed_sql("spark", "{events}"), events=table(spark, sf, "events"))


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)

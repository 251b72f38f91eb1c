"""Quotes of other venues from their JSON dumps, bundled references, and the journal file.

All parsers give: source, quote_id, question, outcome, p, kind, bid, ask, liquidity, volume_24h, end, url, n, note."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTE = ("source", "quote_id", "question", "outcome", "p", "kind", "bid", "ask", "liquidity", "volume_24h", "end", "url", "n", "note")
POLY = "id string, question string, title string, slug string, outcomes string, outcomePrices string, closed boolean, bestBid string, bestAsk string, liquidity string, volume24hr string, endDate string"
KALSHI = "ticker string, event_ticker string, title string, yes_sub_title string, yes_bid_dollars string, yes_ask_dollars string, last_price_dollars string, close_time string, expected_expiration_time string, liquidity_dollars string, volume_24h_fp string"
MANIFOLD = "id string, question string, outcomeType string, isResolved boolean, probability double, closeTime double, url string, uniqueBettorCount long"
STATIC = "contract_id string, source string, id string, question string, outcome string, p double, kind string, bid double, ask double, liquidity double, volume_24h double, url string, n long, note string"
JOURNAL = ("date", "market", "category", "side", "p_belief", "price_q", "kelly_fraction", "stake", "bankroll_before", "rationale", "outcome")
NUMERIC = ("p_belief", "price_q", "kelly_fraction", "stake", "bankroll_before", "outcome")


def _num(x: str) -> Column:
    return F.col(x).try_cast("double")


def _time(x: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(x, "Z$", "+00:00"))


def _quote(d: DataFrame, source: str, **cols: Column) -> DataFrame:
    kinds = {"p": "double", "bid": "double", "ask": "double", "liquidity": "double", "volume_24h": "double", "end": "timestamp", "n": "long"}
    full = {"source": F.lit(source), "kind": F.lit("market"), **cols}
    return d.select(*[full.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in QUOTE])


def _two_sided(b: Column, a: Column) -> Column:
    return F.coalesce((b > 0) & (b <= a) & (a < 1), F.lit(False))


def polymarket(raw: DataFrame, json: str = "json") -> DataFrame:
    """One quote per outcome; lists arrive as JSON inside JSON. The mid replaces the last price where the
    first outcome of a binary market has a valid bid and ask."""
    d = raw.select(F.from_json(json, POLY).alias("m")).select("m.*")
    names = F.from_json("outcomes", T.ArrayType(T.StringType()))
    prices = F.transform(F.from_json("outcomePrices", T.ArrayType(T.StringType())), lambda x: x.try_cast("double"))
    d = d.withColumns({"_o": names, "_p": prices}).where("size(_o) > 0 and size(_o) = size(_p) and not coalesce(closed, false) and not exists(_p, x -> x is null)")
    d = d.select("*", F.posexplode(F.arrays_zip("_o", "_p")).alias("_i", "_e")).where("_e._p > 0 and _e._p < 1")
    first = (F.col("_i") == 0) & (F.size("_o") == 2)
    b, a = F.when(first, _num("bestBid")), F.when(first, _num("bestAsk"))
    return _quote(d, "polymarket", quote_id=F.col("id"), question=F.coalesce(F.nullif("question", F.lit("")), "title", F.lit("")), outcome=F.col("_e._o"),
                  p=F.when(_two_sided(b, a), (a + b) / 2).otherwise(F.col("_e._p")), bid=b, ask=a, liquidity=_num("liquidity"), volume_24h=_num("volume24hr"),
                  end=_time(F.col("endDate")), url=F.concat(F.lit("https://polymarket.com/market/"), F.coalesce("slug", F.lit(""))))


def _kalshi(d: DataFrame, question: Column, outcome: Column, event: Column, note: Column) -> DataFrame:
    b, a, last = _num("yes_bid_dollars"), _num("yes_ask_dollars"), _num("last_price_dollars")
    p = F.when(_two_sided(b, a), (a + b) / 2).when((last > 0) & (last < 1), last)
    q = _quote(d, "kalshi", quote_id=F.coalesce("ticker", F.lit("")), question=question, outcome=outcome, p=p, bid=b, ask=a, liquidity=_num("liquidity_dollars"),
               volume_24h=_num("volume_24h_fp"), end=_time(F.coalesce(F.nullif("close_time", F.lit("")), "expected_expiration_time")),
               url=F.concat(F.lit("https://kalshi.com/markets/"), F.lower(F.coalesce(event, F.lit("")))), note=note)
    return q.where("p is not null")


def _joined(a: str, b: str) -> Column:
    return F.trim(F.concat_ws(" ", F.nullif(a, F.lit("")), F.nullif(b, F.lit(""))))


def kalshi(raw: DataFrame, json: str = "json") -> DataFrame:
    """Market dump: the mid of a valid bid and ask, else the last price, else nothing."""
    d = raw.select(F.from_json(json, KALSHI).alias("m")).select("m.*")
    return _kalshi(d, _joined("title", "yes_sub_title"), F.lit("Yes"), F.col("event_ticker"), F.lit(None))


def kalshi_events(raw: DataFrame, json: str = "json") -> DataFrame:
    """Event dump with nested markets: the question is the event's title, the outcome the market's label."""
    schema = f"title string, sub_title string, event_ticker string, category string, markets array<struct<{', '.join(x.replace(' ', ': ', 1) for x in KALSHI.split(', '))}>>"
    e = raw.select(F.from_json(json, schema).alias("e")).select("e.*")
    d = e.select(_joined("title", "sub_title").alias("_q"), F.col("event_ticker").alias("_ev"), F.coalesce("category", F.lit("")).alias("_cat"), F.size("markets").alias("_k"),
                 F.explode("markets").alias("m")).select("_q", "_ev", "_cat", "_k", "m.*")
    label = F.trim(F.coalesce("yes_sub_title", F.lit("")))
    binary = (F.col("_k") == 1) & ((label == "") | F.lower(label).isin("yes") | (F.lower(label) == F.lower("_q")))
    return _kalshi(d, F.col("_q"), F.when(binary | (label == ""), "Yes").otherwise(label), F.col("_ev"), F.col("_cat"))


def manifold(raw: DataFrame, json: str = "json") -> DataFrame:
    """Unresolved binary markets; a close time beyond the calendar is unknown."""
    d = raw.select(F.from_json(json, MANIFOLD).alias("m")).select("m.*")
    d = d.where("outcomeType = 'BINARY' and not coalesce(isResolved, false) and probability > 0 and probability < 1")
    sane = F.when((F.col("closeTime") > 0) & (F.col("closeTime") < 253402300800000.0), F.timestamp_millis(F.col("closeTime").cast("long")))
    return _quote(d, "manifold", quote_id=F.col("id"), question=F.coalesce("question", F.lit("")), outcome=F.lit("Yes"), p=F.col("probability"), end=sane,
                  url=F.coalesce("url", F.lit("")), n=F.coalesce("uniqueBettorCount", F.lit(0)), note=F.lit("play money"))


def bundled(spark: SparkSession, path: str) -> DataFrame:
    """References shipped with a contest file (a JSON array), keyed by contract_id."""
    d = spark.read.schema(STATIC).option("multiLine", True).json(path)
    return d.select(
        "contract_id", F.coalesce("source", F.lit("static")).alias("source"), F.col("id").alias("quote_id"), "question", F.coalesce("outcome", F.lit("Yes")).alias("outcome"),
        "p", F.coalesce("kind", F.lit("market")).alias("kind"), "bid", "ask", "liquidity", "volume_24h", F.lit(None).cast("timestamp").alias("end"), "url", "n", "note")


def as_prob(x: Column) -> Column:
    """A probability in (0, 1); 1 up to 100 is percent; anything else raises."""
    v = F.when((x >= 1) & (x < 100), x / 100).otherwise(x)
    return F.when((v > 0) & (v < 1), v).otherwise(F.raise_error(F.lit("expected a probability or a percent")).cast("double"))


def journal(spark: SparkSession, path: str) -> DataFrame:
    """The journal CSV with numbers parsed, blank outcomes as NULL and sides in capitals."""
    d = spark.read.option("header", True).csv(path)
    gone = [c for c in ("market", "side", *NUMERIC) if c not in d.columns]
    if gone:
        raise ValueError(f"the journal lacks {gone}")
    d = d.withColumns({c: F.nullif(F.trim(c), F.lit("")).cast("double") for c in NUMERIC})
    return d.withColumn("side", F.upper("side"))

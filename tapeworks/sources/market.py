"""Market data in and out: order-event CSV days, auction snapshots, index series, option chains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeworks.operators.tape import KEYS

MESSAGE = "time double, type tinyint, order_id long, size long, price long, direction tinyint"
SNAPSHOT_FLOATS = ("imbalance_size", "reference_price", "matched_size", "far_price", "near_price", "bid_price", "bid_size", "ask_price", "ask_size", "wap", "target")
SNAPSHOT_KEYS = ("stock_id", "date_id", "seconds_in_bucket")
SNAPSHOT_TYPES = {**{k: "short" for k in SNAPSHOT_KEYS}, "imbalance_buy_sell_flag": "byte", **{c: "float" for c in SNAPSHOT_FLOATS}}


def in_file_order(df: DataFrame) -> DataFrame:
    """Add `seq`, the 0-based row position of a single file, without gathering it: the row counter within
    each split plus the rows of the splits before it (one small row per split)."""
    d = df.withColumn("_m", F.monotonically_increasing_id())
    part, row = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    d = d.withColumns({"_part": part, "_row": row})
    n = d.groupBy("_part").agg((F.max("_row") + 1).alias("_n"))
    w = Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = n.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_base"))
    return d.join(base, "_part").withColumn("seq", F.col("_base") + F.col("_row")).drop("_m", "_part", "_row", "_base")


def book_levels(columns: int) -> int:
    if columns == 0 or columns % 4:
        raise ValueError(f"a book row has four columns per level, got {columns}")
    return columns // 4


def read_day_csv(spark: SparkSession, message_csv: str, book_csv: str, day: str, ticker: str) -> DataFrame:
    """One stock-day from its two headerless CSV files, row-aligned. Unequal row counts raise.

    Extra message columns are ignored; the depth comes from the book's width."""
    width = len(spark.read.text(book_csv).first()[0].split(","))
    k = book_levels(width)
    have = len(spark.read.text(message_csv).first()[0].split(","))
    extra = "".join(f", _x{i} string" for i in range(have - 6))
    msg = in_file_order(spark.read.csv(message_csv, schema=MESSAGE + extra).select("time", "type", "order_id", "size", "price", "direction"))
    cols = [f"{f}_{i}" for i in range(1, k + 1) for f in ("ask_price", "ask_size", "bid_price", "bid_size")]
    raw = in_file_order(spark.read.csv(book_csv, schema=", ".join(f"{c} long" for c in cols)))
    level = lambda s: F.array(*[F.struct(F.col(f"{s}_price_{i}").alias("price"), F.col(f"{s}_size_{i}").alias("size")) for i in range(1, k + 1)])
    book = raw.select("seq", level("bid").alias("bids"), level("ask").alias("asks"),
                      *[F.col(f"{c}_1").alias(c) for c in ("bid_price", "bid_size", "ask_price", "ask_size")])
    n, m = msg.count(), book.count()
    if n != m:
        raise ValueError(f"{n} messages but {m} book rows")
    return msg.join(book, "seq").withColumns({"day": F.lit(day).cast("date"), "ticker": F.lit(ticker)})


def write_tape(tape: DataFrame, path: str, mode: str = "overwrite", chunk: int = 5_000_000) -> None:
    """Typed, partitioned by day and ticker, in row order; a busy stock-day becomes several files.

    Only the stock-days at hand are replaced, so converting a day again leaves it as it was."""
    cut = F.floor(F.col("seq") / chunk)
    (tape.withColumn("_c", cut).repartition(*KEYS, "_c").sortWithinPartitions(*KEYS, "seq").drop("_c")
     .write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).option("compression", "zstd").parquet(path))


def load_day(spark: SparkSession, path: str, ticker, day: str, levels: int | None = None) -> DataFrame:
    """One stock-day: the partition filter prunes the files; `levels` trims the book."""
    d = spark.read.parquet(path).where((F.col("ticker") == ticker) & (F.col("day") == F.lit(day).cast("date")))
    return d if levels is None else d.withColumns({s: F.slice(s, 1, levels) for s in ("bids", "asks")})


def available(spark: SparkSession, path: str) -> DataFrame:
    """Stock-days in the store (read from the partitions)."""
    return spark.read.parquet(path).select(*KEYS).distinct()


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def auction_csv(spark: SparkSession, path: str) -> DataFrame:
    """Auction snapshots with their fixed types; columns by header name, others dropped, NaN as NULL."""
    raw = spark.read.option("header", True).csv(path)
    return nan_to_null(raw.select(*[F.col(c).try_cast("double").cast(t).alias(c) for c, t in SNAPSHOT_TYPES.items()]))


def write_auction(df: DataFrame, path: str) -> None:
    df.repartitionByRange(*SNAPSHOT_KEYS).sortWithinPartitions(*SNAPSHOT_KEYS).write.mode("overwrite").option("compression", "zstd").parquet(path)


def load_auction(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    d = spark.read.parquet(path)
    return nan_to_null(d if columns is None else d.select(*columns))


def feed_date(name: Column) -> Column:
    """Trading day in a feed's file name: MMDDYYYY.NASDAQ_ITCH50 or SMMDDYY-v50; another name raises."""
    a = F.regexp_extract(name, r"(?:^|/)(\d{8})\.NASDAQ_ITCH50", 1)
    b = F.regexp_extract(name, r"(?:^|/)S(\d{6})-v50", 1)
    return F.when(a != "", F.to_date(a, "MMddyyyy")).when(b != "", F.to_date(F.concat(F.substring(b, 1, 4), F.lit("20"), F.substring(b, 5, 2)), "MMddyyyy")).otherwise(
        F.raise_error(F.concat(F.lit("no date in "), name)).cast("date"))


def index_series(spx: DataFrame, vix: DataFrame, vix3m: DataFrame, by: Sequence[str] = ("symbol",)) -> DataFrame:
    """(symbol, date, spx, vix, vix3m): days with both price and vol; the longer tenor may be missing."""
    on = [*by, "date"]
    col = lambda d, n: d.select(*on, F.col("close").cast("double").alias(n))
    return col(spx, "spx").join(col(vix, "vix"), on).join(col(vix3m, "vix3m"), on, "left")


def save_chain(chain: DataFrame, meta: DataFrame, folder: str, name: str) -> None:
    """A snapshot is a Parquet table with its metadata as a one-row JSON table beside it."""
    chain.write.mode("errorifexists").parquet(f"{folder}/{name}.parquet")
    meta.write.mode("errorifexists").json(f"{folder}/{name}.meta.json")


def load_chain(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/{name}.parquet"), spark.read.json(f"{folder}/{name}.meta.json")


def latest_chain(spark: SparkSession, folder: str, ticker: str) -> str | None:
    """Name of the newest snapshot of a ticker (names end in their date)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder)
    r = files.select(F.regexp_extract("path", rf"/({ticker}_[^/]*)\.parquet/", 1).alias("n")).where("n <> ''").agg(F.max("n")).first()
    return r[0]


OPTION = T.ArrayType(T.StructType([T.StructField(k, t) for k, t in (
    ("option", T.StringType()), ("bid", T.DoubleType()), ("ask", T.DoubleType()), ("last_trade_price", T.DoubleType()), ("volume", T.DoubleType()),
    ("open_interest", T.DoubleType()), ("last_trade_time", T.StringType()), ("iv", T.DoubleType()))]))


def vendor_chain(payloads: DataFrame, json: str = "payload", root: str = "ticker") -> DataFrame:
    """Chain rows from a vendor's JSON: symbols are root + yymmdd + C/P + strike x 1000; others are dropped."""
    schema = T.StructType([T.StructField("data", T.StructType([T.StructField("options", OPTION)]))])
    d = payloads.withColumn("_o", F.explode(F.from_json(json, schema)["data"]["options"]))
    sym = F.col("_o.option")
    rest = F.substring(sym, F.length(root) + 1, F.length(sym))
    ok = sym.startswith(F.col(root)) & rest.rlike(r"^\d{6}[CP]\d{8}$")
    part = lambda i: F.regexp_extract("_r", r"^(\d{6})([CP])(\d{8})$", i)
    return d.where(ok).withColumn("_r", rest).select(
        *[c for c in payloads.columns if c != json], sym.alias("contract"), F.to_date(part(1), "yyMMdd").alias("expiry"), part(2).alias("kind"),
        (part(3).cast("double") / 1000).alias("strike"), F.col("_o.bid").alias("bid"), F.col("_o.ask").alias("ask"), F.col("_o.last_trade_price").alias("last"),
        F.col("_o.volume").alias("volume"), F.col("_o.open_interest").alias("open_interest"), F.coalesce("_o.last_trade_time", F.lit("")).alias("last_trade_utc"),
        F.col("_o.iv").alias("vendor_iv"))


def numeric_column(df: DataFrame, column: str | None = None) -> str:
    """The named column, or the only numeric one."""
    if column is not None:
        if column not in df.columns:
            raise ValueError(f"no column {column!r}; there are {', '.join(df.columns)}")
        return column
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    if len(num) != 1:
        raise ValueError(f"{len(num)} numeric columns; name one")
    return num[0]


def read_pnl(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """One PnL column from a CSV or Parquet file, as `pnl`."""
    d = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.option("header", True).option("inferSchema", True).csv(path)
    return d.select(F.col(numeric_column(d, column)).cast("double").alias("pnl"))


def stable_number(x: Column, digits: int = 12) -> Column:
    """Rounded to significant digits, NaN and infinity as NULL."""
    ok = ~F.isnan(x) & (F.abs(x) != float("inf"))
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(F.nullif(x, F.lit(0.0))))))
    rounded = F.when(scale < float("inf"), F.rint(x * scale) / scale).otherwise(F.when(x != 0.0, x))  # too small to scale: as it is
    return F.when(ok, F.coalesce(rounded, F.lit(0.0)))


def save_results(df: DataFrame, path: str) -> None:
    """Result rows as JSON lines with stable numbers."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    df.withColumns({c: stable_number(F.col(c).cast("double")) for c in doubles}).write.mode("overwrite").json(path)

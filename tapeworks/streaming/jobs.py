"""Streaming forms: order audit, order-flow buckets, proposal cool-down, quote intake. State is kept by key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from tapeworks.functions.shared import folder as shared_folder
from tapeworks.functions.shared import stored
from tapeworks.operators import proposals

CLOSE_NS = 20 * 3600 * 10**9  # the exchange's last event of a day, 20:00
BUCKETS = 256  # of the references of a day
CONTRACTS = 1024  # buckets of contracts
QUOTE = ["bid_price", "bid_size", "ask_price", "ask_size"]
QUOTES = 65_536  # numbers of a ticker's quotes in a run
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what its source holds now; results are a table in the shared folder."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    at = shared_folder(spark)
    q = (stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state")
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


class OrderAudit(StatefulProcessor):
    """Shares left of the orders of one bucket of a day; emits steps that name an unknown or finished order. Used-up orders are dropped,
    and a timer forgets the bucket once its day has closed behind the watermark."""

    def __init__(self, close_ns: int = CLOSE_NS) -> None:
        self.close_ns = close_ns

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "ref array<long>, left array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["ref", "step"])
        known = self.open.exists()
        held, left = (np.array(x, np.int64) for x in (self.open.get() if known else ((), ())))  # in the order of ref
        ref, starts = pdf["ref"].to_numpy(np.int64), pdf["starts"].to_numpy(bool)
        first = np.append(True, ref[1:] != ref[:-1])
        begins = starts | first  # of a life: an order, or what an earlier batch left of it
        life = begins.cumsum() - 1
        spot = np.searchsorted(held, ref[begins])
        found = np.append(held, ref[-1] + 1)[spot] == ref[begins]
        base = np.where(starts[begins], pdf["shares"].to_numpy()[begins], np.where(found, np.append(left, 0)[spot], 0)).astype(np.int64)
        take = np.where(starts, 0, pdf["take"].to_numpy(np.int64))
        taken = take.cumsum()
        after = base[life] - (taken - (taken - take)[begins][life])
        before = after + take
        last = np.append(first[1:], True)
        other = ~np.isin(held, ref[last])
        now = np.concatenate([held[other], ref[last]]), np.concatenate([left[other], after[last]])
        keep = np.flatnonzero(now[1] > 0)
        keep = keep[np.argsort(now[0][keep])]
        if len(keep):
            self.open.update((now[0][keep].tolist(), now[1][keep].tolist()))
            if not known:
                self.handle.registerTimer(self._closed(key[0]))
        elif known:
            self.open.clear()
        yield pdf.loc[~starts & (before <= 0), ["day", "ref", "seq", "msg"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.open.clear()
        return iter(())

    def _closed(self, day) -> int:
        at = pd.Timestamp(day).tz_localize("UTC")
        return int(at.timestamp() * 1000) + self.close_ns // 1_000_000 + 1

    def close(self) -> None:
        pass


def order_audit(steps: DataFrame, close_ns: int = CLOSE_NS, late: str = "2 hours") -> DataFrame:
    """Unmatched references of a stream of order steps (lifecycle.order_steps), per day and ref. Steps that come later than `late`
    behind the newest of earlier batches are dropped; a day's orders are forgotten once the watermark has passed its close. State
    is kept by BUCKETS buckets of a day's references: a call and a state read for each bucket, not for each order."""
    schema = T.StructType([steps.schema[k] for k in ("day", "ref", "seq", "msg")])
    at = (F.unix_timestamp(F.col("day").cast("timestamp")) + F.col("ts_ns") / 1e9).cast("timestamp")
    timed = steps.withColumns({"at": at, "_bucket": F.pmod(F.xxhash64("ref"), F.lit(BUCKETS))}).withWatermark("at", late)
    return timed.groupBy("day", "_bucket").transformWithStateInPandas(OrderAudit(close_ns), schema, "Append", "EventTime")


def _flow(now: pd.DataFrame, before: pd.DataFrame) -> pd.Series:
    """Order-flow imbalance of quotes from those before them; 0 where there is none."""
    b, a, pb, pa = now["bid_price"], now["ask_price"], before["bid_price"], before["ask_price"]
    e = (now["bid_size"] * (b >= pb) - (before["bid_size"] * (b <= pb)).fillna(0) - now["ask_size"] * (a <= pa) + (before["ask_size"] * (a >= pa)).fillna(0))
    return e.where(pb.notna(), 0.0).astype(float)


class FlowRuns(StatefulProcessor):
    """Flow within the quotes of one run of a batch, QUOTES numbers of a ticker. Its first quote and its last, which other runs need, go on as they are."""

    def init(self, handle) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("seq", ignore_index=True)
        out = pdf.assign(_run=key[1], flow=_flow(pdf, pdf[QUOTE].shift(1)), edge=0)
        ends = out.iloc[[0, -1]].assign(edge=[1, 2])
        yield pd.concat([out.iloc[1:], ends])[["ticker", "_run", "ts", "seq", *QUOTE, "flow", "edge"]]

    def close(self) -> None:
        pass


class FlowEvents(StatefulProcessor):
    """Passes on the flow within runs, and sets that of each run's first quote from the last quote of the run before it, across
    micro-batches; the last quote is kept."""

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "bp long, bs long, ap long, asz long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if not key[2]:
            yield from (x[["ticker", "ts", "flow"]] for x in rows)
            return
        pdf = pd.concat(list(rows)).sort_values(["seq", "edge"], ignore_index=True)  # two rows a run
        prev = pdf[QUOTE].shift(1)
        if self.last.exists():
            prev.iloc[0] = list(self.last.get())
        self.last.update(tuple(int(x) for x in pdf[QUOTE].iloc[-1]))
        yield pdf.assign(flow=_flow(pdf, prev)).loc[pdf["edge"] == 1, ["ticker", "ts", "flow"]]

    def close(self) -> None:
        pass


def flow_events(quotes: DataFrame, run: int = QUOTES) -> DataFrame:
    """(ticker, ts, flow) of a stream of quotes with seq, ts and the best bid and ask. A task holds the quotes of `run` numbers of a ticker, and
    the two ends of each run of a ticker in a batch, never all quotes of a ticker."""
    schema = T.StructType([quotes.schema["ticker"], quotes.schema["ts"], T.StructField("flow", T.DoubleType())])
    kept = [quotes.schema["ticker"], T.StructField("_run", T.LongType()), quotes.schema["ts"], quotes.schema["seq"], *[quotes.schema[x] for x in QUOTE]]
    runs = T.StructType([*kept, T.StructField("flow", T.DoubleType()), T.StructField("edge", T.LongType())])
    cut = quotes.withColumn("_run", F.floor(F.col("seq") / run).cast("long")).select(*[x.name for x in kept])
    parts = cut.groupBy("ticker", "_run").transformWithStateInPandas(FlowRuns(), runs, "Append", "None")
    parts = parts.withColumns({"_ends": F.col("edge") > 0, "_run": F.when(F.col("edge") > 0, F.lit(-1)).otherwise(F.col("_run"))})
    return parts.groupBy("ticker", "_run", "_ends").transformWithStateInPandas(FlowEvents(), schema, "Append", "None")


def flow_buckets(flows: DataFrame, width: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Flow on right-closed buckets (t, t + width]; rows later than the watermark are dropped."""
    w = flows.withColumn("_at", F.col("ts") - F.expr("interval 1 microsecond")).withWatermark("_at", late)
    return w.groupBy("ticker", F.window("_at", width)).agg(F.sum("flow").alias("flow"), F.count(F.lit(1)).alias("n"))


def open_buckets(flows: DataFrame, closed: DataFrame, width: str = "10 seconds") -> DataFrame:
    """(ticker, start, flow, n) of the buckets that a finished run has not emitted, from its whole input."""
    w = flows.groupBy("ticker", F.window(F.col("ts") - F.expr("interval 1 microsecond"), width).alias("window")).agg(F.sum("flow").alias("flow"), F.count(F.lit(1)).alias("n"))
    return w.select("ticker", F.col("window.start").alias("start"), "flow", "n").join(closed.select("ticker", "start"), ["ticker", "start"], "left_anti")


class CoolDown(StatefulProcessor):
    """Lets a contract's proposal through if none went out in the last hours, or the numbers moved; holds the contracts of one bucket.
    What went out last is forgotten by a timer once those hours lie behind the watermark: from then on it can hold nothing back."""

    def __init__(self, kind: str, hours: float = proposals.COOL_HOURS, move: float = proposals.MOVE) -> None:
        self.kind, self.seconds, self.move = kind, hours * 3600.0, move

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", f"id array<{self.kind}>, p array<double>, ask array<double>, at array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["ts", "p"])
        known = self.last.exists()
        out = {c: tuple(v) for c, *v in zip(*self.last.get(), strict=True)} if known else {}
        keep = []
        for i, (c, ts, p, ask) in enumerate(zip(pdf["contract_id"].tolist(), pdf["ts"], pdf["p"].tolist(), pdf["ask"].tolist(), strict=True)):
            last, at = out.get(c), ts.timestamp()
            if last is None or at - last[2] > self.seconds or abs(p - last[0]) >= self.move or abs(ask - last[1]) >= self.move:
                out[c] = (p, ask, at)
                keep.append(i)
        if keep:
            self._hold(out, not known)
        yield pdf.iloc[keep][["contract_id", "ts", "p", "ask"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        if self.last.exists():
            self._hold({c: tuple(v) for c, *v in zip(*self.last.get(), strict=True) if self._over(v[2]) > now}, True)
        return iter(())

    def _hold(self, out: dict, timer: bool) -> None:
        """A bucket that holds anything has a timer: for the contract that can be forgotten first."""
        if not out:
            self.last.clear()
            return
        self.last.update((list(out), *(list(x) for x in zip(*out.values(), strict=True))))
        if timer:
            self.handle.registerTimer(min(self._over(v[2]) for v in out.values()))

    def _over(self, at: float) -> int:
        return int((at + self.seconds) * 1000) + 1000

    def close(self) -> None:
        pass


def cool_down(props: DataFrame, hours: float = proposals.COOL_HOURS, move: float = proposals.MOVE, late: str = "1 hour") -> DataFrame:
    """Proposals (contract_id, ts, p, ask) that go out. Rows that come later than `late` behind the newest of earlier batches are dropped.
    State is kept by CONTRACTS buckets: a call and a state read for each bucket, not for each contract."""
    schema = T.StructType([props.schema[k] for k in ("contract_id", "ts", "p", "ask")])
    timed = props.withColumn("_bucket", F.pmod(F.xxhash64("contract_id"), F.lit(CONTRACTS))).withWatermark("ts", late)
    kind = props.schema["contract_id"].dataType.simpleString()
    return timed.groupBy("_bucket").transformWithStateInPandas(CoolDown(kind, hours, move), schema, "Append", "EventTime")


def _latest(quotes: DataFrame) -> DataFrame:
    """The newest quote of each source and id; of equal times the one that is largest in the other columns, so reruns agree."""
    rest = [c for c in quotes.columns if c not in ("source", "quote_id", "ts")]
    newest = quotes.groupBy("source", "quote_id").agg(F.max(F.struct("ts", *rest)).alias("_q"))
    return newest.select(*[F.col(c) if c in ("source", "quote_id") else F.col(f"_q.{c}").alias(c) for c in quotes.columns])


class Buckets:
    """A table of rows by key in PARTS buckets, one folder for each version of a bucket, and a manifest (bucket, version) for each
    batch. A batch writes the buckets that it touches and a manifest; it reads by the manifest of the batch before, so a batch
    that is run again gives the same table. Versions that no manifest since the batch before names are deleted."""

    PARTS = 64

    def __init__(self, folder: str, keys: list[str], schema: T.StructType, parts: int = PARTS) -> None:
        self.folder, self.keys, self.schema, self.parts = folder, keys, schema, parts

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")

    def manifest(self, spark: SparkSession, number: int) -> dict[int, int]:
        """At most PARTS rows."""
        return {r["bucket"]: r["version"] for r in spark.read.schema("bucket int, version int").parquet(f"{self.folder}/manifest/{number}").collect()} if number >= 0 else {}

    def read(self, spark: SparkSession, number: int, only: set[int] | None = None) -> DataFrame:
        paths = [f"{self.folder}/{b}/{v}" for b, v in sorted(self.manifest(spark, number).items()) if only is None or b in only]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def put(self, spark: SparkSession, number: int, touched: set[int], rows: DataFrame) -> None:
        """The new rows of the touched buckets, all that they hold."""
        at = f"{self.folder}/new/{number}"
        rows.withColumn("_b", self.bucket()).repartition("_b").write.mode("overwrite").partitionBy("_b").parquet(at)
        names = self.manifest(spark, number - 1)
        path = spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        for b in sorted(touched):  # a rename of a folder each; a bucket left without rows is an empty folder
            to = path(f"{self.folder}/{b}/{number}")
            fs.delete(to, True)
            fs.mkdirs(to.getParent())
            fresh = path(f"{at}/_b={b}")
            if not (fs.rename(fresh, to) if fs.exists(fresh) else fs.mkdirs(to)):
                raise OSError(f"could not write {to}")
            for old in fs.listStatus(to.getParent()):
                version = int(old.getPath().getName())
                if version < names.get(b, number) and version != number:
                    fs.delete(old.getPath(), True)
        fs.delete(path(at), True)
        now = [(b, v) for b, v in (names | dict.fromkeys(touched, number)).items()]
        spark.createDataFrame(now, "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/{number}")
        if number >= 2:
            fs.delete(path(f"{self.folder}/manifest/{number - 2}"), True)

    def touched(self, rows: DataFrame) -> set[int]:
        return {r[0] for r in rows.select(self.bucket()).distinct().collect()}


def quote_table(folder: str, quotes: DataFrame) -> Buckets:
    return Buckets(f"{folder}/quotes", ["source", "quote_id"], quotes.schema)


def pooled_table(folder: str, books: DataFrame, quotes: DataFrame, mappings: DataFrame) -> Buckets:
    """Its columns are those that pooling gives."""
    spark = books.sparkSession
    none = spark.createDataFrame([], quotes.schema).join(mappings.select("source", "quote_id", "contract_id", "invert"), ["source", "quote_id"])
    return Buckets(f"{folder}/pooled", ["contract_id"], proposals.pool(books, none).schema)


def intake(quotes: DataFrame, books: DataFrame, mappings: DataFrame, folder: str):
    """Start a quote stream: each micro-batch is merged into the table of latest quotes (one per source and id), and the
    contracts that its quotes serve are pooled again; the others keep their row. Both are tables in buckets under `folder`: a
    batch reads and writes the buckets it touches only."""
    latest, pooled = quote_table(folder, quotes), pooled_table(folder, books, quotes, mappings)

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        links = mappings.select("source", "quote_id", "contract_id", "invert")
        new = stored(_latest(batch))
        hit = latest.touched(new)
        latest.put(spark, number, hit, _latest(latest.read(spark, number - 1, hit).unionByName(new)))
        served = stored(new.select("source", "quote_id").join(links, ["source", "quote_id"]).select("contract_id").distinct())
        wanted = stored(links.join(served, "contract_id", "left_semi"))  # all quotes of the contracts to pool again
        refs = latest.read(spark, number, latest.touched(wanted)).join(wanted, ["source", "quote_id"])
        hit = pooled.touched(served)
        kept = pooled.read(spark, number - 1, hit).join(served, "contract_id", "left_anti")
        pooled.put(spark, number, hit, kept.unionByName(proposals.pool(books, refs)))

    return quotes.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()


def newest(spark: SparkSession, table: Buckets) -> DataFrame:
    """The table as the last finished batch left it."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    at = path(f"{table.folder}/manifest")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [int(x.getPath().getName()) for x in fs.listStatus(at) if fs.exists(path(x.getPath(), "_SUCCESS"))] if fs.exists(at) else []
    return table.read(spark, max(done, default=-1))

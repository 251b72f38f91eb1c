"""The append-only log of backtest trials: JSON lines with config, metrics, tags and PnL by period."""

from __future__ import annotations

import json
import math
import warnings
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = ("trial_id string, timestamp string, config_hash string, config string, metrics string, tags string, pnl_key_type string, "
          "pnl_keys array<string>, pnl_values array<double>")


def _plain(x):
    if isinstance(x, float) and not math.isfinite(x):
        return None
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if isinstance(x, list):
        return [_plain(v) for v in x]
    return x


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """Sorted keys, no spaces, NaN and infinity as null; 1 and 1.0 stay different. One value per trial."""
    return text.map(lambda s: None if s is None else json.dumps(_plain(json.loads(s)), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def config_hash(config: Column) -> Column:
    return F.sha2(canonical_json(config), 256)


def _flat(d: dict, prefix: str, out: dict) -> dict:
    for k, v in d.items():
        if isinstance(v, dict) and v:
            _flat(v, f"{prefix}.{k}", out)
        else:
            out[f"{prefix}.{k}"] = None if v is None else v if isinstance(v, str) else json.dumps(v)
    return out


def dotted(prefix: str):
    @F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
    def flat(text: pd.Series) -> pd.Series:
        return text.map(lambda s: None if s is None else _flat(json.loads(s), prefix, {}))

    return flat


def log_rows(pnl: DataFrame, trials: DataFrame) -> DataFrame:
    """Records to append. pnl: (key, period, pnl), one row per key and period; trials: (key, config, metrics, tags) as JSON.

    Periods are integers, dates or strings; duplicates and infinite values raise; a trial without PnL is kept."""
    kind = {T.DateType: "datetime", T.TimestampType: "datetime", T.StringType: "str"}.get(type(pnl.schema["period"].dataType), "int")
    one = pnl.groupBy("key", "period").agg(F.count(F.lit(1)).alias("_n"), F.max(F.col("pnl").cast("double")).alias("pnl"))
    bad = (F.col("_n") > 1) | (F.abs("pnl") == float("inf"))
    one = one.withColumn("pnl", F.when(bad, F.raise_error(F.lit("duplicate period or infinite PnL")).cast("double")).otherwise(F.nanvl("pnl", F.lit(None).cast("double"))))
    series = one.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("period", "pnl"))).alias("_s"))  # one calendar per trial
    j = trials.join(series, "key", "left")
    empty = F.col("_s").isNull()
    return j.select(
        F.uuid().alias("trial_id"), F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        config_hash(F.col("config")).alias("config_hash"), "config", "metrics", "tags", F.when(~empty, kind).alias("pnl_key_type"),
        F.coalesce(F.transform("_s", lambda e: e["period"].cast("string")), F.array().cast("array<string>")).alias("pnl_keys"),
        F.coalesce(F.transform("_s", lambda e: e["pnl"]), F.array().cast("array<double>")).alias("pnl_values"))


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("ignoreNullFields", False).json(path)


def records(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """Records of the log. Lines that cannot be read are left out, with a warning that counts them."""
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    lines = spark.read.text(path).where(F.trim("value") != "")
    raw = lines.select(F.from_json("value", RECORD + ", _bad string", opts).alias("r")).select("r.*")
    lost = raw.where("_bad is not null").count()
    if lost:
        warnings.warn(f"{lost} unreadable lines in {path} were skipped", stacklevel=2)
    d = raw.where("_bad is null").drop("_bad")
    return d if where is None else d.where(where)


def flatten(recs: DataFrame) -> DataFrame:
    """One row per trial: provenance, n_obs and a map of dotted config, metrics and tags entries."""
    dup = recs.groupBy("trial_id").count().where("count > 1").limit(1).count()
    if dup:
        warnings.warn("the log holds a trial id twice", stacklevel=2)
    parts = [dotted(p)(F.col(p)) for p in ("config", "metrics", "tags")]
    m = F.map_concat(*[F.coalesce(x, F.create_map().cast("map<string,string>")) for x in parts])
    return recs.select("trial_id", F.to_timestamp("timestamp").alias("timestamp"), "config_hash", F.size("pnl_keys").alias("n_obs"), m.alias("entries"))


def columns(flat: DataFrame, keys: Sequence[str]) -> DataFrame:
    return flat.select("trial_id", "timestamp", "config_hash", "n_obs", *[F.try_element_at("entries", F.lit(k)).alias(k) for k in keys])


def long_pnl(recs: DataFrame) -> DataFrame:
    """(trial_id, period, pnl). Trials with different kinds of periods cannot be put on one calendar."""
    kinds = recs.where("pnl_key_type is not null").agg(F.countDistinct("pnl_key_type")).first()[0]
    if kinds > 1:
        raise ValueError("trials use different kinds of period; filter the records")
    return recs.select("trial_id", F.explode(F.arrays_zip("pnl_keys", "pnl_values")).alias("e")).select(
        "trial_id", F.col("e.pnl_keys").alias("period"), F.col("e.pnl_values").alias("pnl"))

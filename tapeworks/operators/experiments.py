"""The experiment grid: several models under several policies, every trial in the log once.

A trial is one model under one policy; its config (model, policy, costs, data) names it by hash. What the log already holds is
neither traded nor logged again, so re-running a report does not inflate the number of trials that later corrections count."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeworks.operators import auction, backtest
from tapeworks.operators.auction import ALL_GROUPS, POLICIES, ModelSpec
from tapeworks.operators.scan import cut
from tapeworks.sources import trials

MODELS = (
    ModelSpec("zero"), ModelSpec("median"), ModelSpec("ridge", ALL_GROUPS, {"alpha": 10.0}),
    ModelSpec("boosted", ("book", "auction", "dynamics"), {"depth": 6}), ModelSpec("boosted", ALL_GROUPS, {"depth": 6}), ModelSpec("boosted", ALL_GROUPS, {"depth": 8}),
)
METRICS = ("sharpe_daily", "sharpe_annualized", "total_pnl_usd", "trades", "hit_rate", "net_bps_per_trade")
COSTS = {"fee_bps_side": backtest.FEE_BPS_SIDE, "hedge_bps": backtest.HEDGE_BPS}


def label(spec: ModelSpec) -> str:
    """How a model is called in tags: its kind, and what tells the variants of one kind apart."""
    parts = ["all" if tuple(spec.groups) == tuple(ALL_GROUPS) else "+".join(spec.groups), *[f"{k} {v}" for k, v in sorted(spec.params.items())]]
    return spec.kind if spec.kind != "boosted" else f"boosted[{', '.join(p for p in parts if p)}]"


def configs(spark: SparkSession, specs: Sequence[ModelSpec], policies: Sequence[dict], data: str) -> DataFrame:
    """(key, model, policy, config, config_hash, tags), one row per model and policy; `data` is the fingerprint of the table."""
    rows = []
    for m, spec in enumerate(specs):
        for p, policy in enumerate(policies):
            config = {"model": asdict(spec), "policy": {**backtest.POLICY, **policy}, "costs": COSTS, "cost_mult": 1.0, "data": data}
            rows.append((f"{m}:{p}", m, p, json.dumps(config), json.dumps({"model": label(spec), "stage": "research", "data": data})))
    plan = spark.createDataFrame(rows, "key string, model int, policy int, config string, tags string")
    return plan.withColumn("config_hash", trials.config_hash(F.col("config")))


def data_fingerprint(market: DataFrame) -> str:
    """Rows, and the sum of their hashes: changes with any value, not with the order of rows."""
    n, h = market.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*sorted(market.columns)).cast("decimal(38,0)"))).first()
    return f"{n}:{h}"


def log_grid(decisions: dict[ModelSpec, DataFrame] | Sequence[tuple[ModelSpec, DataFrame]], days: tuple[int, int], path: str, data: str, policies: Sequence[dict] = POLICIES) -> DataFrame:
    """Trade and log the trials that the log at `path` does not hold; returns the records of the whole grid with `key` model:policy."""
    pairs = list(decisions.items()) if isinstance(decisions, dict) else list(decisions)
    spark = pairs[0][1].sparkSession
    plan = cut(configs(spark, [s for s, _ in pairs], policies, data))
    held = _records(spark, path)
    todo = plan if held is None else auction.new_trials(plan, held)
    for m, (_, dec) in enumerate(pairs):
        wanted = [r["policy"] for r in todo.where(F.col("model") == m).orderBy("policy").collect()]  # at most the list of policies
        if not wanted:
            continue
        _, day, summary = backtest.backtest(dec, [policies[p] for p in wanted], days)
        key = F.concat(F.lit(f"{m}:"), F.element_at(F.array(*[F.lit(str(p)) for p in wanted]), F.split_part("trial_id", F.lit("/"), F.lit(1)).cast("int") + 1))
        results = summary.select(key.alias("key"), F.to_json(F.struct(*METRICS)).alias("metrics"))
        pnl = day.select(key.alias("key"), F.col("date_id").alias("period"), F.col("pnl_usd").alias("pnl"))
        trials.append(trials.log_rows(pnl, plan.select("key", "config", "tags").join(results, "key")), path)
    return _records(spark, path).join(plan.select("key", "config_hash"), "config_hash")


def _records(spark: SparkSession, path: str) -> DataFrame | None:
    """The log, None before its first record."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return trials.records(spark, path) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None


def model_decisions(feat: DataFrame, market: DataFrame, weights: DataFrame, plan: Sequence, specs: Sequence[ModelSpec] = MODELS) -> list[tuple[ModelSpec, DataFrame]]:
    """Decision frames of each model's calibrated walk-forward forecasts."""
    return [(s, auction.edges_for(auction.walk_forward(feat, s, plan, weights), market)) for s in specs]

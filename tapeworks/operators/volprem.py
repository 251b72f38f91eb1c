"""The volatility premium on daily series, one window partition per underlying (one row per trading day)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tapeworks.functions.mathx import div
from tapeworks.operators import chains, evaluate
from tapeworks.operators.scan import cut

H = 21
YEAR = 252.0
ROLLS_PER_YEAR = YEAR / H
RULES = (("always", False, None), ("contango", True, None), ("premium > 0", False, 0.0), ("premium > 25%", False, 0.25),
         ("premium > 0 + contango", True, 0.0))
GRID_POINTS = 2001


def _w(by: Sequence[str], order: str = "date"):
    return Window.partitionBy(*by).orderBy(order)


def log_returns(df: DataFrame, by=("symbol",), price: str = "spx") -> DataFrame:
    return df.withColumn("r", F.ln(price) - F.ln(F.lag(price).over(_w(by))))


def _complete(x: Column, w, n: int, agg) -> Column:
    return F.when(F.count(x).over(w) == n, agg(x).over(w))


def forward_rv(df: DataFrame, h: int = H, by=("symbol",)) -> DataFrame:
    """Annualised realised variance of the next h days; NULL when the window is not complete."""
    sq = F.col("r") * F.col("r")
    return df.withColumn("rv", YEAR / h * _complete(sq, _w(by).rowsBetween(1, h), h, F.sum))


def har_features(df: DataFrame, by=("symbol",)) -> DataFrame:
    sq = YEAR * F.col("r") * F.col("r")
    return df.withColumns({"rv_d": sq, "rv_w": _complete(sq, _w(by).rowsBetween(-4, 0), 5, F.avg),
                           "rv_m": _complete(sq, _w(by).rowsBetween(-21, 0), 22, F.avg)})


@F.pandas_udf(ArrayType(DoubleType()))
def _solve4(g: pd.Series, c: pd.Series) -> pd.Series:
    """Least squares of four coefficients from ten Gram entries and four products, one row per refit."""
    out = []
    iu = np.triu_indices(4)
    for a, b in zip(g, c):
        m = np.zeros((4, 4))
        m[iu] = a
        m = m + np.triu(m, 1).T
        s = np.sqrt(np.where(np.diag(m) > 0, np.diag(m), 1.0))
        out.append((np.linalg.lstsq(m / np.outer(s, s), np.asarray(b) / s, rcond=None)[0] / s).tolist())
    return pd.Series(out)


def har_forecast(df: DataFrame, h: int = H, min_train: int = 750, refit: int = 21, by=("symbol",)) -> DataFrame:
    """Walk-forward forecast of the next h days' variance, column `har`.

    Gram sums run over past rows and lag by the label's horizon, so a fit sees only windows already over."""
    by = list(by)
    d = har_features(forward_rv(df, h, by), by).withColumn("_i", F.row_number().over(_w(by)) - 1)
    x = [F.lit(1.0), F.col("rv_d"), F.col("rv_w"), F.col("rv_m")]
    ok = F.col("rv_m").isNotNull() & F.col("rv_d").isNotNull() & F.col("rv").isNotNull() & (F.col("_i") >= 22)
    past = _w(by).rowsBetween(Window.unboundedPreceding, -h)
    gram = [F.sum(F.when(ok, x[i] * x[j])).over(past) for i in range(4) for j in range(i, 4)]
    prod = [F.sum(F.when(ok, x[i] * F.col("rv"))).over(past) for i in range(4)]
    fit = (F.col("_i") >= min_train + h) & ((F.col("_i") == min_train + h) | (F.col("_i") % refit == 0))
    d = d.withColumns({"_fit": fit, "_g": F.array(*gram), "_c": F.array(*prod)})
    solved = d.where("_fit").select(*by, "date", _solve4("_g", "_c").alias("_b"))
    d = d.drop("_g", "_c").join(solved, [*by, "date"], "left")
    b = F.last("_b", ignorenulls=True).over(_w(by).rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_beta", b)
    f = sum((F.col("_beta")[k] * x[k] for k in range(1, 4)), F.col("_beta")[0])
    return d.withColumn("har", F.when(F.col("rv_m").isNotNull(), F.greatest(f, F.when(f.isNotNull(), 1e-6)))).drop("_i", "_fit", "_b", "_beta")


def frame(df: DataFrame, h: int = H, min_train: int = 750, by=("symbol",)) -> DataFrame:
    """Daily frame: implied and realised variance, the premium, the forecast."""
    d = har_forecast(log_returns(df, by), h, min_train, H, by)
    return d.withColumns({"iv2": (F.col("vix") / 100) ** 2, "rv_vol": 100 * F.sqrt("rv")}).withColumn("vrp", F.col("iv2") - F.col("rv"))


def rule_trades(contango: bool, tau: float | None) -> Column:
    ok = F.lit(True)
    if contango:
        ok = ok & F.coalesce(F.col("vix") < F.col("vix3m"), F.lit(False))
    if tau is not None:
        ok = ok & F.coalesce(F.col("iv2") - F.col("har") > tau * F.col("iv2"), F.lit(False))
    return ok


def rolls(fr: DataFrame, start: str, end: str | None = None, h: int = H, by=("symbol",)) -> DataFrame:
    """Every h-th day with a complete forward window, from the start date."""
    d = fr.where((F.col("date") >= F.lit(start).cast("date")) & F.col("rv").isNotNull())
    d = d if end is None else d.where(F.col("date") <= F.lit(end).cast("date"))
    return d.withColumn("_n", F.row_number().over(_w(by)) - 1).where(F.col("_n") % h == 0).drop("_n")


def short_var_pnl(k: str = "vix", r: str = "rv_vol", cost: float = 0.0) -> Column:
    return div(F.col(k) ** 2 - F.col(r) ** 2, 2 * F.col(k)) - float(cost)


def run_rules(fr: DataFrame, start: str, end: str | None = None, costs: Sequence[float] = (0.5,), rules=RULES, by=("symbol",)) -> DataFrame:
    """PnL of every rule at every cost on every roll, in one frame."""
    r = rolls(fr, start, end, by=by).withColumn("_gross", short_var_pnl())
    arms = [F.struct(F.lit(n).alias("rule"), rule_trades(cgo, tau).alias("traded"), F.lit(float(k)).alias("cost_vol"))
            for n, cgo, tau in rules for k in costs]
    r = r.withColumn("_e", F.explode(F.array(*arms))).select("*", "_e.*").drop("_e")
    return r.withColumn("pnl", F.when(F.col("traded"), F.col("_gross") - F.col("cost_vol")).otherwise(0.0)).drop("_gross")


def stats(res: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sharpe, skew, hit rate on traded rolls, worst date, tail mean, drawdown, total."""
    by = list(by)
    w = Window.partitionBy(*by)
    run = w.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    d = res.withColumns({"_cum": F.sum("pnl").over(run), "_rk": F.row_number().over(w.orderBy("pnl")), "_n": F.count(F.lit(1)).over(w),
                         "_m": F.avg("pnl").over(w)})
    d = d.withColumn("_dd", F.col("_cum") - F.greatest(F.max("_cum").over(run), F.lit(0.0)))
    sd = F.stddev_samp("pnl")
    tail = F.col("_rk") <= F.greatest(F.floor(0.05 * F.col("_n")), F.lit(1))
    return d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rolls"), F.count_if("traded").alias("traded"), F.avg("pnl").alias("mean_pnl"), sd.alias("sd_pnl"),
        F.coalesce(div(F.avg("pnl"), sd) * math.sqrt(ROLLS_PER_YEAR), F.lit(0.0)).alias("sharpe_ann"),
        F.coalesce(div(F.avg((F.col("pnl") - F.col("_m")) ** 3), sd * sd * sd), F.lit(0.0)).alias("skew"),
        F.coalesce(F.avg(F.when(F.col("traded"), (F.col("pnl") > 0).cast("double"))), F.lit(0.0)).alias("hit_rate"),
        F.min("pnl").alias("worst_pnl"), F.min_by("date", F.struct("pnl", "date")).alias("worst_date"),
        F.avg(F.when(tail, F.col("pnl"))).alias("cvar5"), F.min("_dd").alias("max_drawdown"), F.sum("pnl").alias("total"))


def kelly_exact(res: DataFrame, by: Sequence[str], points: int = GRID_POINTS) -> DataFrame:
    """Growth-optimal size over a grid below the ruin bound, next to the continuous mean over variance."""
    by = list(by)
    lim = res.groupBy(*by).agg((0.999 / F.greatest(-F.min("pnl"), F.lit(1e-9))).alias("v_max"), div(F.avg("pnl"), F.var_samp("pnl")).alias("v_continuous"))
    g = res.join(lim, by).select(*by, "pnl", "v_max", "v_continuous", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("_k"))
    v = F.col("_k") * F.col("v_max") / (points - 1)
    g = g.groupBy(*by, "_k").agg(F.avg(F.log1p(v * F.col("pnl"))).alias("_g"), F.first("v_max").alias("v_max"), F.first("v_continuous").alias("v_continuous"))
    best = F.max_by(F.struct((F.col("_k") * F.col("v_max") / (points - 1)).alias("v"), F.col("_g").alias("g")), F.struct(F.col("_g"), -F.col("_k")))
    return g.groupBy(*by).agg(best.alias("_b"), F.first("v_max").alias("v_max"), F.first("v_continuous").alias("v_continuous")).select(
        *by, F.col("_b.v").alias("v_star"), F.col("_b.g").alias("growth_star"), "v_max", "v_continuous")


def wealth_path(res: DataFrame, by: Sequence[str], v: str) -> DataFrame:
    """Wealth after each roll at size v; ruin is absorbing. Adds wealth and its drawdown from the peak."""
    run = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    g = F.greatest(1 + F.col(v) * F.col("pnl"), F.lit(0.0))
    d = res.withColumn("_g", g)
    alive = F.min("_g").over(run) > 0
    d = d.withColumn("wealth", F.when(alive, F.exp(F.sum(F.ln(F.when(F.col("_g") > 0, F.col("_g")))).over(run))).otherwise(0.0))
    return d.withColumn("drawdown", F.col("wealth") / F.greatest(F.max("wealth").over(run), F.lit(1e-300)) - 1).drop("_g")


def kelly_lived_through(res: DataFrame, split: str, by: Sequence[str]) -> DataFrame:
    """Sizes fitted before the split date, lived through from it on; and the size that would have survived."""
    by = list(by)
    res = cut(res)
    at = F.lit(split).cast("date")
    k = kelly_exact(res.where(F.col("date") < at), by)
    sizes = k.withColumn("_e", F.explode(F.array(*[
        F.struct(F.lit(n).alias("sizing"), x.alias("v")) for n, x in (
            ("continuous", F.col("v_continuous")), ("full", F.col("v_star")), ("half", F.col("v_star") / 2), ("quarter", F.col("v_star") / 4))])))
    sizes = sizes.select(*by, "v_star", "_e.sizing", "_e.v")
    post = res.where(F.col("date") >= at)
    w = wealth_path(post.join(sizes, by), [*by, "sizing"], "v")
    out = w.groupBy(*by, "sizing").agg(
        F.first("v").alias("v"), F.max_by("wealth", "date").alias("final_wealth"), F.min("drawdown").alias("max_drawdown"),
        F.min_by("date", F.struct("pnl", "date")).alias("worst_date"), F.min("pnl").alias("worst_pnl"), F.first("v_star").alias("_vs"))
    busted = F.col("final_wealth") <= 0
    survive = div(F.lit(0.999), -F.col("worst_pnl"))
    return out.withColumns({"busted": busted, "max_drawdown": F.when(busted, -1.0).otherwise(F.col("max_drawdown")),
                            "survivable": survive, "survivable_share": div(survive, "_vs")}).drop("_vs")


def straddles(fr: DataFrame, start: str, end: str | None = None, cost: float = 0.5, hedge_bps: float = 1.0,
              shifts: Sequence[float] = (0.0,), h: int = H, by=("symbol",)) -> DataFrame:
    """Every roll: a short at-the-money straddle hedged at each close, and the variance swap on the same month.

    Each roll carries its next h returns (a fixed-width array) and is unfolded into h hedge rows."""
    by = list(by)
    ahead = F.collect_list("r").over(_w(by).rowsBetween(1, h))
    d = rolls(fr.withColumn("_rs", ahead), start, end, h, by).where(F.size("_rs") == h)
    one = [*by, "date", "shift"]
    d = d.withColumn("shift", F.explode(F.array(*[F.lit(float(x)) for x in shifts]))).withColumn("_sg", (F.col("vix") + F.col("shift")) / 100)
    x = d.select(*one, "vix", "rv_vol", "_sg", F.posexplode("_rs").alias("_j", "_r"))
    w = Window.partitionBy(*one).orderBy("_j")
    s1 = F.exp(F.sum("_r").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("_s1", s1).withColumn("_s", F.coalesce(F.lag("_s1").over(w), F.lit(1.0)))
    x = x.withColumn("_tau", (h - F.col("_j")) / YEAR)
    vol = F.col("_sg") * F.sqrt("_tau")
    x = x.withColumn("_d1", F.ln("_s") / vol + vol / 2)
    x = x.withColumns({"_delta": 2 * chains.norm_cdf("_d1") - 1,
                       "_dg": 2 * chains.norm_pdf("_d1") / (F.col("_s") * vol) * F.col("_s") ** 2})
    ds = F.col("_s1") - F.col("_s")
    x = x.withColumns({"_prev": F.coalesce(F.lag("_delta").over(w), F.lit(0.0)), "_ret": ds / F.col("_s"), "_ds": ds})
    last = F.col("_j") == h - 1
    turn = F.abs(F.col("_delta") - F.col("_prev")) * F.col("_s") + F.when(last, F.abs("_delta") * F.col("_s1")).otherwise(0.0)
    dt = 1 / YEAR
    m = x.groupBy(*one).agg(
        F.first("vix").alias("vix"), F.first("rv_vol").alias("rv_vol"), F.first("_sg").alias("_sg"), F.max(F.when(last, F.col("_s1"))).alias("_end"),
        F.sum(F.col("_delta") * F.col("_ds")).alias("_hedge"), F.sum(turn).alias("_turn"),
        F.sum(0.5 * F.col("_dg") * (F.col("_sg") ** 2 * dt - F.col("_ret") ** 2)).alias("_attr"),
        F.sum("_dg").alias("_sdg"), F.sum(F.col("_dg") * F.col("_ret") ** 2).alias("_sdgx"))
    t0 = h / YEAR
    v0 = F.col("_sg") * math.sqrt(t0)
    vega = 2 * chains.norm_pdf(v0 / 2) * math.sqrt(t0)
    premium = 2 * (2 * chains.norm_cdf(v0 / 2) - 1)
    m = m.withColumns({"_vp": vega / 100, "_prem": premium, "_cost": hedge_bps * 1e-4 * F.col("_turn")})
    gross = F.col("_prem") - F.abs(F.col("_end") - 1) + F.col("_hedge")
    return m.select(
        *one, "vix", "rv_vol", ((gross - F.col("_cost")) / F.col("_vp") - cost).alias("straddle"), short_var_pnl(cost=cost).alias("var_swap"),
        (gross / F.col("_vp")).alias("gross"), (F.col("_attr") / F.col("_vp")).alias("attribution"), (F.col("_cost") / F.col("_vp")).alias("hedge_cost"),
        (0.5 * F.col("_sdg") * dt / (F.col("_vp") * 100 / (2 * F.col("_sg")))).alias("exposure"),
        (100 * F.sqrt(F.col("_sdgx") / (F.col("_sdg") * dt))).alias("eff_vol"), (F.col("_prem") / F.col("_vp")).alias("premium_per_vega"))


def instruments(st: DataFrame) -> DataFrame:
    """Straddle and variance swap as two strategies in the shape `stats` expects."""
    arms = F.explode(F.array(*[F.struct(F.lit(n).alias("instrument"), F.col(n).alias("pnl")) for n in ("straddle", "var_swap")]))
    return st.select("symbol", "date", "shift", arms.alias("e")).select("symbol", "date", "shift", "e.instrument", "e.pnl", F.lit(True).alias("traded"))


def straddle_summary(st: DataFrame, by=("symbol", "shift")) -> DataFrame:
    gap = F.col("gross") - F.col("attribution")
    return st.groupBy(*by).agg(
        F.corr("straddle", "var_swap").alias("corr"), (1 - div(F.var_pop(gap), F.var_pop("gross"))).alias("attribution_r2"),
        F.avg("hedge_cost").alias("mean_hedge_cost"), F.count(F.lit(1)).alias("rolls"))


def premium_summary(fr: DataFrame, by=("symbol",)) -> DataFrame:
    v = fr.where("rv is not null").withColumn("_p", F.col("vix") - F.col("rv_vol"))
    return v.groupBy(*by).agg(
        F.count(F.lit(1)).alias("days"), F.avg("_p").alias("mean_premium_vol"), F.percentile("_p", F.lit(0.5)).alias("median_premium_vol"),
        F.avg((F.col("_p") > 0).cast("double")).alias("share_implied_above"), F.corr("vix", "rv_vol").alias("corr_vix_rv"))


def compare_rules(res: DataFrame, by=("symbol",), reps: int = 5000) -> DataFrame:
    """Rule statistics with intervals, and the deflated Sharpe of each given that all rules were tried."""
    one = [*by, "rule"]
    res = cut(res)
    pos = res.withColumn("pos", F.datediff("date", F.lit("1970-01-01")))
    ci = evaluate.bootstrap_ci(pos, one, "pos", "pnl", "sharpe", reps=reps)
    k = math.sqrt(ROLLS_PER_YEAR)
    ci = ci.select(*one, (F.col("lo") * k).alias("sharpe_lo"), (F.col("hi") * k).alias("sharpe_hi"))
    d = evaluate.deflated_sharpe(evaluate.series_stats(res, one), list(by)).select(*one, "dsr", "psr_0")
    return stats(res, one).join(ci, one).join(d, one)


def worst_months(res: DataFrame, by: Sequence[str], k: int = 5) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("pnl", "date")
    return res.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def atm_gap(fr: DataFrame, smiles: DataFrame, by=("symbol",)) -> DataFrame:
    """Index of implied vol minus the at-the-money vol of the expiry nearest 30 days, on the snapshot's date."""
    near = smiles.groupBy(*by, "date").agg(F.min_by(F.struct("days", "atm_iv"), F.struct(F.abs(F.col("days") - 30), "days")).alias("e"))
    return near.join(fr.select(*by, "date", "vix"), [*by, "date"]).select(
        *by, "date", F.col("e.days").alias("days"), (100 * F.col("e.atm_iv")).alias("atm_iv"), "vix", (F.col("vix") - 100 * F.col("e.atm_iv")).alias("gap"))


def published_period(fr: DataFrame, start: str, end: str, lag: int = 30, by=("symbol",)) -> DataFrame:
    """Mean realised minus implied variance and its log ratio over a period, with long-lag t-statistics."""
    by = list(by)
    d = fr.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & F.col("rv").isNotNull() & F.col("iv2").isNotNull() & (F.col("rv") > 0))
    d = cut(d.select(*by, F.datediff("date", F.lit("1970-01-01")).alias("pos"), "rv_vol", "vix", (100 * (F.col("rv") - F.col("iv2"))).alias("rp"),
                     F.ln(F.col("rv") / F.col("iv2")).alias("lrp")))
    a = evaluate.mean_t(d, by, "pos", "rp", lag).select(*by, F.col("mean").alias("rp"), F.col("t").alias("rp_t"), F.col("n").alias("days"))
    b = evaluate.mean_t(d, by, "pos", "lrp", lag).select(*by, F.col("mean").alias("lrp"), F.col("t").alias("lrp_t"))
    return a.join(b, by).join(d.groupBy(*by).agg(F.avg("rv_vol").alias("rv_vol"), F.avg("vix").alias("sw_vol")), by)

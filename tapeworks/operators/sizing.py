"""Bet sizing, calibration, the value of information, and scoring a journal of bets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.mathx import c, div
from tapeworks.operators import backtest
from tapeworks.operators.scan import cut, quantiles, with_row

CLIP = 1e-6
TO_JUDGE = 10


def kelly_yes(p, q) -> Column:
    return F.greatest(div(c(p) - c(q), 1 - c(q)), F.lit(0.0))


def kelly_no(p, q) -> Column:
    return F.greatest(div(c(q) - c(p), q), F.lit(0.0))


def kelly_fraction(p, q, yes: Column) -> Column:
    return F.when(yes, kelly_yes(p, q)).otherwise(kelly_no(p, q))


def best_side(p, q) -> Column:
    return F.when(c(p) >= c(q), "YES").otherwise("NO")


def fractional(f, share: float, cap: float = 1.0) -> Column:
    return F.least(c(f) * share, F.lit(float(cap)))


def payoff_per_unit(yes: Column, q, outcome) -> Column:
    y = c(outcome).cast("double")
    return F.when(yes, div(y, q) - 1).otherwise(div(1 - y, 1 - c(q)) - 1)


def expected_return(p, q, yes: Column) -> Column:
    return payoff_per_unit(yes, q, p)


def growth_rate(f, p, q, yes: Column) -> Column:
    """Expected log growth; -infinity when a loss would take everything, unless the win is certain."""
    f = c(f)
    p1, q1 = F.when(yes, c(p)).otherwise(1 - c(p)), F.when(yes, c(q)).otherwise(1 - c(q))
    win = F.log1p(f * div(1 - q1, q1))
    ruin = f >= 1
    lose = F.log1p(-F.when(~ruin, f))
    return F.when(ruin & (p1 == 1), win).when(ruin, float("-inf")).otherwise(p1 * win + (1 - p1) * lose)


def kelly_columns(bets: DataFrame, p: str = "p_belief", q: str = "price_q", share: float = 0.5, cap: float = 1.0) -> DataFrame:
    yes = F.col(p) >= F.col(q)
    d = bets.withColumns({"best_side": best_side(p, q), "kelly": kelly_fraction(p, q, yes)})
    return d.withColumns({
        "fraction": fractional("kelly", share, cap), "expected_return": expected_return(p, q, yes),
        "growth": growth_rate("kelly", p, q, yes),
    })


def kelly_continuous(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    return df.groupBy(*by).agg(div(F.avg(x), F.var_samp(x)).alias("leverage"))


# ------------------------------------------------------------------ calibration


def slope_through_origin(df: DataFrame, by: Sequence[str]) -> DataFrame:
    ok = F.col("pred").isNotNull() & F.col("target").isNotNull()
    p, t = F.col("pred").cast("double"), F.col("target").cast("double")
    return df.groupBy(*by).agg(F.coalesce(div(F.sum(F.when(ok, p * t)), F.sum(F.when(ok, p * p))), F.lit(0.0)).alias("slope"))


def expanding_slopes(preds: DataFrame, by: Sequence[str] = (), cap: float = 5.0) -> DataFrame:
    """Slope per fold from earlier folds only, clipped to [0, cap]; the first fold gets 0."""
    ok = F.col("pred").isNotNull() & F.col("target").isNotNull()
    p, t = F.col("pred").cast("double"), F.col("target").cast("double")
    s = preds.groupBy(*by, "fold").agg(F.sum(F.when(ok, p * t)).alias("_pt"), F.sum(F.when(ok, p * p)).alias("_pp"))
    w = Window.partitionBy(*(by or [F.lit(1)])).orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)  # one row per fold
    b = F.coalesce(div(F.sum("_pt").over(w), F.sum("_pp").over(w)), F.lit(0.0))
    return s.select(*by, "fold", F.least(F.greatest(b, F.lit(0.0)), F.lit(float(cap))).alias("slope"))


def apply_slopes(preds: DataFrame, slopes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return preds.join(slopes, [*by, "fold"], "left").withColumn("edge", F.col("pred") * F.coalesce("slope", F.lit(0.0))).drop("slope")


def quantile_bins(df: DataFrame, by: Sequence[str], value: str, bins: int, out: str) -> DataFrame:
    """Bin 0..bins-1 by exact quantile edges; a value on an edge goes up, the top value stays in the last bin."""
    probs = {f"_e{i}": i / bins for i in range(1, bins)}
    q = quantiles(df, by, value, probs).withColumn("_edges", F.array(*probs)).drop(*probs)
    j = df.join(q, list(by)) if by else with_row(df, q)
    return j.withColumn(out, F.size(F.filter("_edges", lambda e: e <= F.col(value)))).drop("_edges")


def decile_table(df: DataFrame, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Mean forecast and mean target by forecast decile; a constant forecast gives no rows."""
    d = df.where("pred is not null and target is not null")
    flat = d.groupBy(*by, F.lit(1).alias("_f")).agg(F.min("pred").alias("_lo"), F.max("pred").alias("_hi")).where("_lo < _hi").drop("_lo", "_hi")
    d = d.withColumn("_f", F.lit(1)).join(flat, [*by, "_f"], "left_semi")
    b = quantile_bins(cut(d), by, "pred", bins, "_b")
    return b.groupBy(*by, (F.col("_b") + 1).alias("decile")).agg(
        F.avg("pred").alias("mean_pred_bps"), F.avg(F.col("target").cast("double")).alias("mean_target_bps"), F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ value of information


def with_oracle(dec: DataFrame) -> DataFrame:
    return dec.withColumn("edge", F.col("target").cast("double"))


def with_synthetic(dec: DataFrame, rhos: Sequence[float], seed: int = 0, bins: int = 100) -> DataFrame:
    """Perfectly calibrated forecasts of correlation rho (one copy of the frame per rho): the edge is the mean
    standardised target of the forecast's quantile bin, at the stock's own volatility."""
    y = F.col("target").cast("double")
    tot = dec.agg(F.avg(y).alias("_m"), F.stddev_pop(y).alias("_s"))
    own = dec.groupBy("stock_id").agg(F.stddev_samp(y).alias("_own"))
    d = with_row(dec, tot).join(own, "stock_id")
    d = d.withColumn("_sd", F.when(F.col("_own") > 0, F.col("_own")).otherwise(F.col("_s")))
    d = cut(d.withColumn("_raw", (y - F.col("_m")) / F.col("_sd")))
    d = with_row(d, d.agg(F.stddev_pop("_raw").alias("_kk"))).withColumn("_z", F.col("_raw") / F.col("_kk"))
    noise = F.sqrt(-2 * F.ln(F.greatest(_u(seed, 0), F.lit(1e-300)))) * F.cos(2 * 3.141592653589793 * _u(seed, 1))
    d = d.withColumn("rho", F.explode(F.array(*[F.lit(float(r)) for r in rhos])))
    d = cut(d.withColumn("_f", F.col("rho") * F.col("_z") + F.sqrt(F.greatest(1 - F.col("rho") ** 2, F.lit(0.0))) * noise))
    b = quantile_bins(d, ["rho"], "_f", bins, "_b")
    m = b.groupBy("rho", "_b").agg(F.avg("_z").alias("_mz"))
    j = b.join(m, ["rho", "_b"])
    edge = F.when(F.col("rho") == 0, 0.0).otherwise(F.col("_m") + F.col("_sd") * F.col("_kk") * F.col("_mz"))
    return j.withColumn("edge", edge).drop("_m", "_s", "_own", "_sd", "_raw", "_kk", "_z", "_b", "_mz")


def _u(seed: int, arm: int) -> Column:
    from tapeworks.functions.mathx import uniform

    return uniform(seed, "stock_id", "date_id", "seconds_in_bucket", F.lit(arm))


def top_decile(dec: DataFrame, by: Sequence[str] = (), share: float = 0.10, col: str = "edge") -> DataFrame:
    """The largest |forecast| of each instant, by position (one row per stock)."""
    w = Window.partitionBy(*by, *backtest.INSTANT)
    r = F.row_number().over(w.orderBy(F.abs(F.col(col)).desc(), "stock_id")) / F.count(F.lit(1)).over(w)
    return dec.withColumn("_r", r).where(F.col("_r") <= share).drop("_r")


def voi_curve(dec: DataFrame, days: tuple[int, int], rhos: Sequence[float], mults: Sequence[float] = (1.0, 2.0, 3.0),
              policy: dict | None = None, seed: int = 0) -> DataFrame:
    """Value of a forecast of correlation rho at each cost multiple: rule with threshold, and cost-blind rule."""
    syn = cut(with_synthetic(dec, rhos, seed))
    blind = top_decile(syn, ["rho"], col="_f")
    grid = [(f"{m:g}", m, m) for m in mults]

    def run(d: DataFrame, pol: dict, name: str) -> DataFrame:
        p = backtest.with_policies(d, [pol], grid).withColumn("trial_id", F.concat_ws("|", F.col("rho").cast("string"), "setting"))
        tr = backtest.trades(p)
        ids = dec.sparkSession.createDataFrame([(f"{float(r)}|{m:g}", float(r), float(m)) for r in rhos for m in mults],
                                               "trial_id string, rho double, cost_mult double")
        s = backtest.summarize(backtest.daily(tr, days, ids), tr)
        return s.join(ids, "trial_id").select("rho", "cost_mult", F.col("sharpe_annualized").alias(f"{name}_sharpe_ann"),
                                              F.col("trades_per_day").alias(f"{name}_trades_per_day"),
                                              F.col("net_bps_per_trade").alias(f"{name}_net_bps"))

    base = policy or {}
    return run(syn, base, "threshold").join(run(blind, {**base, "threshold": 0.0, "sizing": "flat"}, "blind"), ["rho", "cost_mult"])


def break_even(curve: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """First x where y crosses from <= 0 to > 0, by linear interpolation; the first x if y starts above 0."""
    w = Window.partitionBy(*by).orderBy(x)
    d = curve.select(*by, x, y, F.lag(x).over(w).alias("_x"), F.lag(y).over(w).alias("_y"), F.row_number().over(w).alias("_i"))
    at = F.when((F.col("_y") <= 0) & (F.col(y) > 0), F.col("_x") - F.col("_y") * div(F.col(x) - F.col("_x"), F.col(y) - F.col("_y")))
    start = F.when((F.col("_i") == 1) & (F.col(y) > 0), F.col(x))
    return d.withColumns({"_at": at, "_st": start}).groupBy(*by).agg(F.coalesce(F.min("_at"), F.max("_st")).alias("break_even"))


# ------------------------------------------------------------------ journal of bets


def record_bets(bets: DataFrame) -> DataFrame:
    """New journal rows: validated stake and bankroll, and the Kelly fraction of the side taken."""
    good = (F.col("stake") >= 0) & (F.col("bankroll_before") > 0) & (F.col("stake") <= F.col("bankroll_before"))
    checked = F.when(F.coalesce(good, F.lit(False)), F.col("stake")).otherwise(
        F.raise_error(F.lit("stake must be between 0 and a positive bankroll")).cast("double"))
    return bets.withColumns({"side": F.upper(F.trim("side")), "stake": checked}).withColumn(
        "kelly_fraction", kelly_fraction("p_belief", "price_q", F.col("side") == "YES"))


def resolve(journal: DataFrame, outcomes: DataFrame, key: str = "market") -> DataFrame:
    """Set the outcome of unresolved rows whose market has one now."""
    o = outcomes.groupBy(key).agg(F.max("outcome").alias("_o"))
    return journal.join(o, key, "left").withColumn("outcome", F.coalesce("outcome", "_o")).drop("_o").select(*journal.columns)


def pnl_columns(journal: DataFrame) -> DataFrame:
    yes = F.col("side") == "YES"
    p, q, s = F.col("p_belief"), F.col("price_q"), F.col("stake")
    return journal.withColumns({
        "pnl": s * payoff_per_unit(yes, "price_q", "outcome"), "pnl_predicted": s * payoff_per_unit(yes, "price_q", "p_belief"),
        "pnl_var": s * s * p * (1 - p) / F.when(yes, q).otherwise(1 - q) ** 2, "frac": div(s, "bankroll_before"),
    })


def calibration_table(df: DataFrame, by: Sequence[str], forecast: str, outcome: str, bins: int = 10) -> DataFrame:
    k = F.least(F.greatest(F.floor(F.col(forecast) * bins + 1e-12), F.lit(0)), F.lit(bins - 1))
    return df.groupBy(*by, k.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(forecast).alias("mean_forecast"),
                                               F.avg(F.col(outcome).cast("double")).alias("observed"))


def score(journal: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All metrics of the resolved rows per forecaster: Brier and log loss against the market with paired errors,
    luck against the predicted PnL, Kelly multiples, hit rate."""
    one = list(by) or ["_all"]
    j = journal if by else journal.withColumn("_all", F.lit(1))
    logged = j.groupBy(*one).agg(F.count(F.lit(1)).alias("n_logged"))
    r = pnl_columns(j.where(F.col("outcome").isin(0, 1)))
    y, p, q = F.col("outcome").cast("double"), F.col("p_belief"), F.col("price_q")
    lim = lambda x: F.least(F.greatest(x, F.lit(CLIP)), F.lit(1 - CLIP))
    ll = lambda x: -(y * F.ln(lim(x)) + (1 - y) * F.ln(1 - lim(x)))
    r = r.withColumns({
        "_by": (p - y) ** 2, "_bm": (q - y) ** 2, "_ly": ll(p), "_lm": ll(q),
        "_ratio": F.when(F.col("kelly_fraction") > 0, div("frac", "kelly_fraction")),
        "_hit": F.when(F.col("side") == "YES", y).otherwise(1 - y),
    }).withColumns({"_db": F.col("_by") - F.col("_bm"), "_dl": F.col("_ly") - F.col("_lm")})
    r = cut(r)
    n = F.count(F.lit(1))
    se = lambda x: F.stddev_samp(x) / F.sqrt(n)
    a = r.groupBy(*one).agg(
        n.alias("n_resolved"), F.countDistinct("market").alias("n_markets"), F.avg("_by").alias("brier_you"), F.avg("_bm").alias("brier_market"),
        (1 - div(F.avg("_by"), F.avg("_bm"))).alias("brier_skill"), F.avg("_db").alias("brier_diff"), se("_db").alias("brier_diff_se"),
        div(F.avg("_db"), se("_db")).alias("brier_diff_t"), F.avg("_ly").alias("logloss_you"), F.avg("_lm").alias("logloss_market"),
        F.avg("_dl").alias("logloss_diff"), se("_dl").alias("logloss_diff_se"), div(F.avg("_dl"), se("_dl")).alias("logloss_diff_t"),
        F.sum("pnl").alias("pnl_realized"), F.sum("pnl_predicted").alias("pnl_predicted"),
        (F.sum("pnl") - F.sum("pnl_predicted")).alias("luck"), F.sqrt(F.sum("pnl_var")).alias("luck_sd"),
        div(F.sum("pnl") - F.sum("pnl_predicted"), F.sqrt(F.sum("pnl_var"))).alias("luck_z"), F.sum("stake").alias("stake_total"),
        div(F.sum("pnl"), F.sum("stake")).alias("return_realized"), div(F.sum("pnl_predicted"), F.sum("stake")).alias("return_predicted"),
        F.avg(F.when(F.col("_ratio").isNotNull(), (F.col("_ratio") > 1).cast("double"))).alias("share_over_kelly"),
        F.count_if((F.col("kelly_fraction") == 0) & (F.col("frac") > 0)).alias("n_against_belief"), F.avg("_hit").alias("hit_rate"))
    m1 = quantiles(r, one, "_ratio", {"median_kelly_multiple": 0.5})
    m2 = quantiles(r, one, "frac", {"median_stake_fraction": 0.5})
    out = a.join(logged, one).join(m1, one, "left").join(m2, one, "left")
    return out if by else out.drop("_all")


def verdict(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    t = F.col("brier_diff_t")
    v = (F.when(F.col("n_resolved") < TO_JUDGE, "too few").when(t.isNull() | (F.abs(t) < 2), "not distinguishable")
         .when(F.col("brier_diff") < 0, "better").otherwise("worse"))
    return scored.select(*by, "n_resolved", "brier_diff", "brier_diff_t", v.alias("verdict"))


def prize_split(board: DataFrame, prizes: Sequence[float], by: Sequence[str] = (), score: str = "score") -> DataFrame:
    """Prize of each player; players level on score share the prizes of the positions they span equally."""
    one = list(by) or ["_all"]
    b = board if by else board.withColumn("_all", F.lit(1))
    levels = b.groupBy(*one, score).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*one).orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.withColumn("_above", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    table = F.array(*[F.lit(float(x)) for x in prizes])
    paid = F.aggregate(F.slice(table, F.col("_above").cast("int") + 1, F.col("_n").cast("int")), F.lit(0.0), lambda acc, x: acc + x)
    levels = levels.withColumns({
        "p_first": F.when(F.col("_above") == 0, 1.0 / F.col("_n")).otherwise(0.0),
        "p_paid": F.least(F.greatest(F.lit(len(prizes)) - F.col("_above"), F.lit(0)), F.col("_n")) / F.col("_n"),
        "prize": F.when(F.col("_above") < len(prizes), paid).otherwise(0.0) / F.col("_n"),
    })
    return b.join(levels.drop("_n", "_above"), [*one, score]).drop("_all")

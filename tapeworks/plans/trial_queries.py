"""Queries over strategy PnL: Sharpe statistics, deflation, overfitting, resampling, clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tapeworks.functions import mathx
from tapeworks.operators import backtest, evaluate
from tapeworks.plans.registry import query, table

TRIALS = """(select l_suppkey % 16 as trial_id, datediff('day', date '1970-01-01', cast(l_shipdate as date)) as period,
  sum(l_extendedprice * (l_discount - 0.05)) as pnl from lineitem group by all)"""
FULL = f"""(select t.trial_id, p.period, p.pos, coalesce(x.pnl, 0.0) as pnl from (select distinct trial_id from {TRIALS}) t,
  (select period, row_number() over (order by period) - 1 as pos from (select distinct period from {TRIALS})) p
  left join {TRIALS} x on x.trial_id = t.trial_id and x.period = p.period)"""
STATS = f"""(select trial_id, count(*) as n, avg(pnl) as mean, stddev_samp(pnl) as sd,
  case when min(pnl) = max(pnl) then case when max(pnl) = 0 then 0.0 end else avg(pnl) / stddev_samp(pnl) end as sharpe,
  avg((pnl - m) ** 3) / avg((pnl - m) ** 2) ** 1.5 as skew, avg((pnl - m) ** 4) / avg((pnl - m) ** 2) ** 2 as kurt
  from (select *, avg(pnl) over (partition by trial_id) as m from {FULL}) group by trial_id)"""


def trials(spark, sf):
    li = table(spark, sf, "lineitem")
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01"))
    return li.groupBy((F.col("l_suppkey") % 16).alias("trial_id"), day.alias("period")).agg(
        F.sum(F.col("l_extendedprice") * (F.col("l_discount") - 0.05)).alias("pnl"))


def full(spark, sf):
    return evaluate.full_calendar(trials(spark, sf))


@query("trial_matrix", f"select * from {FULL}", "pnl", 4)
def _(spark, sf):
    return full(spark, sf)


@query("trial_sharpes", f"select * from {STATS}", "mean sd sharpe skew kurt")
def _(spark, sf):
    return evaluate.series_stats(full(spark, sf), ["trial_id"])


@query("trial_counts", f"select count(distinct trial_id) as n_trials, count(*) as n_rows from {TRIALS}")
def _(spark, sf):
    return trials(spark, sf).agg(F.countDistinct("trial_id").alias("n_trials"), F.count(F.lit(1)).alias("n_rows"))


def _poly(coefs, x):
    out = repr(coefs[0])
    for k in coefs[1:]:
        out = f"({out} * {x} + {k!r})"
    return out


def cdf_sql(z):
    near = f"exp(-{z} * {z} / 2) * {_poly(mathx.HART_NUM, f'abs({z})')} / {_poly(mathx.HART_DEN, f'abs({z})')}"
    a = f"abs({z})"
    far = f"exp(-{z} * {z} / 2) / (({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65))))) * sqrt(2 * pi()))"
    tail = f"(case when {a} > 37 then 0.0 when {a} < 7.07106781186547 then {near} else {far} end)"
    return f"(case when {z} > 0 then 1 - {tail} else {tail} end)"


@query("probabilistic_sharpe", f"select trial_id, z, {cdf_sql('z')} as psr from (select trial_id, sharpe * sqrt(n - 1) / sqrt(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe) as z from {STATS})", "z psr")
def _(spark, sf):
    s = evaluate.series_stats(full(spark, sf), ["trial_id"])
    return s.select("trial_id", evaluate.psr_z("sharpe", 0.0, "n", "skew", "kurt").alias("z"),
                    evaluate.psr("sharpe", 0.0, "n", "skew", "kurt").alias("psr"))


def ppf_sql(p):
    """The rational start without the Newton step: good to nine digits, enough after rounding."""
    tail = lambda u: f"({_poly(mathx.ACKLAM_C, f'sqrt(-2 * ln({u}))')} / {_poly(mathx.ACKLAM_D, f'sqrt(-2 * ln({u}))')})"
    mid = f"({_poly(mathx.ACKLAM_A, f'(({p} - 0.5) * ({p} - 0.5))')} * ({p} - 0.5) / {_poly(mathx.ACKLAM_B, f'(({p} - 0.5) * ({p} - 0.5))')})"
    return f"(case when {p} > 1 - 0.02425 then -{tail(f'(1 - {p})')} else {mid} end)"


@query("deflated_sharpe", f"""select trial_id, sharpe, sr_star, {cdf_sql('z')} as dsr from (select *, (sharpe - sr_star) * sqrt(n - 1) / sqrt(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe) as z from (select *, greatest(sqrt(v) * ((1 - {mathx.EULER_GAMMA}) * {ppf_sql('pa')} + {mathx.EULER_GAMMA} * {ppf_sql('pb')}), 0) as sr_star
  from (select *, 1 - 1e0 / k as pa, 1 - 1e0 / (k * exp(1.0)) as pb from (select *, var_samp(sharpe) over () as v, count(sharpe) over () as k from {STATS}))))""", "sharpe sr_star dsr")
def _(spark, sf):
    s = evaluate.series_stats(full(spark, sf), ["trial_id"]).withColumn("search", F.lit("all"))
    return evaluate.deflated_sharpe(s, ["search"]).select("trial_id", "sharpe", "sr_star", "dsr")


def pbo_sql(s):
    return f"""(with sz as (select max(pos) + 1 as t from {FULL}),
 b as (select f.*, case when pos < (t % {s}) * (t // {s} + 1) then pos // (t // {s} + 1) else (t % {s}) + (pos - (t % {s}) * (t // {s} + 1)) // (t // {s}) end as block,
   avg(pnl) over (partition by trial_id) as c from {FULL} f, sz),
 blk as (select trial_id, block, max(c) as c, count(*) as n, sum(pnl - c) as s1, sum((pnl - c) * (pnl - c)) as s2 from b group by all),
 combos as (select m from range({2 ** s}) r(m) where bit_count(m) = {s // 2}),
 half as (select m, trial_id, ((m >> block) & 1) as side, max(c) as c, sum(n) as n, sum(s1) as s1, sum(s2) as s2 from combos, blk group by all),
 met as (select m, trial_id, side, (s1 / n + c) / sqrt((s2 - s1 * s1 / n) / (n - 1)) as v from half),
 w as (select m, trial_id, max(case when side = 1 then v end) as inside, max(case when side = 0 then v end) as outside from met group by all),
 rk as (select *, max(inside) over (partition by m) as best, (rank() over (partition by m order by outside) + (count(*) over (partition by m, outside) - 1) / 2.0) / (count(*) over (partition by m) + 1.0) as rel from w),
 win as (select *, count(*) over (partition by m) as k from rk where inside >= best - 1e-12 * abs(best)),
 per as (select m, avg(rel) as omega, max(best) as inside, avg(outside) as outside from win group by m)"""


@query("overfitting_probability", pbo_sql(8) + """ select avg(case when omega <= 0.5 + 1e-12 then 1.0 else 0.0 end) as pbo, avg(case when outside < 0 then 1.0 else 0.0 end) as prob_oos_loss,
  regr_slope(outside, inside) as degradation_slope, regr_intercept(outside, inside) as degradation_intercept, count(*) as n_used, 70 - count(*) as n_dropped from per)""",
       "pbo prob_oos_loss degradation_slope degradation_intercept")
def _(spark, sf):
    return evaluate.pbo(full(spark, sf), 8)


@query("overfitting_probability_16", pbo_sql(16) + """ select avg(case when omega <= 0.5 + 1e-12 then 1.0 else 0.0 end) as pbo, avg(case when outside < 0 then 1.0 else 0.0 end) as prob_oos_loss,
  regr_slope(outside, inside) as degradation_slope, regr_intercept(outside, inside) as degradation_intercept, count(*) as n_used, 12870 - count(*) as n_dropped from per)""",
       "pbo prob_oos_loss degradation_slope degradation_intercept")
def _(spark, sf):
    return evaluate.pbo(full(spark, sf), 16)


@query("selection_frequency", pbo_sql(8) + " select trial_id, sum(1.0 / k) / 70 as frequency from win group by trial_id)", "frequency")
def _(spark, sf):
    return evaluate.selection_frequency(full(spark, sf), 8)


MEDIANS = pbo_sql(6)
MEDIANS = MEDIANS[:MEDIANS.index(" half as (")] + """ met as (select m, trial_id, ((m >> block) & 1) as side, quantile_cont(pnl, 0.5) as v from combos, b group by all),
""" + MEDIANS[MEDIANS.index(" w as ("):]


@query("overfitting_by_median", MEDIANS + """ select avg(case when omega <= 0.5 + 1e-12 then 1.0 else 0.0 end) as pbo, avg(case when outside < 0 then 1.0 else 0.0 end) as prob_oos_loss,
  case when max(inside) > min(inside) then regr_slope(outside, inside) end as degradation_slope, case when max(inside) > min(inside) then regr_intercept(outside, inside) end as degradation_intercept,
  count(*) as n_used, 20 - count(*) as n_dropped from per)""", "pbo prob_oos_loss degradation_slope degradation_intercept")
def _(spark, sf):
    return evaluate.pbo(full(spark, sf), 6, lambda v: float(np.median(v)))


@query("sharpe_intervals")
def _(spark, sf):
    return evaluate.bootstrap_ci(full(spark, sf), ["trial_id"], "pos", "pnl", "sharpe", reps=1000)


@query("mean_intervals")
def _(spark, sf):
    return evaluate.bootstrap_ci(full(spark, sf), ["trial_id"], "pos", "pnl", "mean", reps=1000, block=5.0)


@query("block_lengths")
def _(spark, sf):
    return evaluate.auto_block_length(full(spark, sf), ["trial_id"], "pos", "pnl")


def lags_sql(lag):
    pairs = ", ".join(f"lead(e, {k}) over w as e{k}" for k in range(1, lag + 1))
    terms = " + ".join(f"2 * (1 - {k} / {lag + 1}.0) * sum(e * e{k})" for k in range(1, lag + 1))
    return f"""(select trial_id, count(*) as n, max(m) as mean, (sum(e * e) + {terms}) / count(*) as lrv from
  (select *, {pairs} from (select *, pnl - avg(pnl) over (partition by trial_id) as e, avg(pnl) over (partition by trial_id) as m from {FULL})
   window w as (partition by trial_id order by pos)) group by trial_id)"""


@query("long_run_variance", f"select trial_id, n, mean, lrv, 5 as lag from {lags_sql(5)}", "mean lrv", 2)
def _(spark, sf):
    return evaluate.long_run_variance(full(spark, sf), ["trial_id"], "pos", "pnl", 5)


@query("mean_t_statistic", f"select trial_id, mean / sqrt(lrv / n) as t from {lags_sql(30)}", "t")
def _(spark, sf):
    return evaluate.mean_t(full(spark, sf), ["trial_id"], "pos", "pnl", 30).select("trial_id", "t")


def losses(f, shift):
    return f.select("trial_id", "pos", (F.abs(F.col("pnl") - shift) / 1000).alias("loss"))


@query("compare_forecasts", digits=5)
def _(spark, sf):
    f = full(spark, sf)
    return evaluate.compare_forecasts(losses(f, 0.0), losses(f, 100.0), ["trial_id"], "pos")


@query("forecast_comparison_statistic", f"""with d as materialized (select trial_id, pos, (abs(pnl) - abs(pnl - 100)) / 1000 as d from {FULL}),
  m as materialized (select trial_id, count(*) as n, avg(d) as mean, avg(case when d < 0 then 1e0 else 0e0 end) as share_better, cast(floor(4 * power(count(*) / 100e0, 2 / 9e0)) as bigint) as lag from d group by 1),
  e as materialized (select d.trial_id, row_number() over (partition by d.trial_id order by pos) as i, d - mean as e, n, lag from d join m using (trial_id)),
  g as (select a.trial_id, k, sum(a.e * b.e) as g from e a, range(0, 40) r(k), e b where b.trial_id = a.trial_id and b.i = a.i + k and k <= a.lag group by 1, 2),
  v as (select trial_id, sum(g * case when k = 0 then 1 else 2 * (1 - k / (lag + 1e0)) end) / any_value(n) as lrv from g join m using (trial_id) group by 1)
  select trial_id, mean / sqrt(lrv / n) * sqrt((n - 1) / cast(n as double)) as stat, mean as mean_diff, mean / sqrt(lrv / n) as dm, lrv, lag, n, share_better from m join v using (trial_id)""", "stat mean_diff dm lrv share_better", 5)
def _(spark, sf):
    f = full(spark, sf)
    return evaluate.compare_forecasts(losses(f, 0.0), losses(f, 100.0), ["trial_id"], "pos").drop("p_value")


CI = "1.959963984540054"


@query("mean_normal_interval", f"""select trial_id, avg(pnl) as mean, avg(pnl) - {CI} * stddev_samp(pnl) / sqrt(count(*)) as lo,
  avg(pnl) + {CI} * stddev_samp(pnl) / sqrt(count(*)) as hi, count(*) as n from {FULL} group by trial_id""", "mean lo hi", 4)
def _(spark, sf):
    return evaluate.mean_ci(full(spark, sf), ["trial_id"], "pnl")


@query("ratio_interval", f"""select trial_id, r as ratio, se, r - {CI} * se as lo, r + {CI} * se as hi, n from (select trial_id, r,
  sqrt(sum((y - r * x) ** 2) * count(*) / (count(*) - 1)) / abs(sum(x)) as se, count(*) as n from
  (select l_suppkey % 16 as trial_id, l_extendedprice * l_discount as y, l_extendedprice as x, sum(l_extendedprice * l_discount) over (partition by l_suppkey % 16) / sum(l_extendedprice) over (partition by l_suppkey % 16) as r from lineitem)
  group by trial_id, r)""", "ratio se lo hi")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 16).alias("trial_id"), (F.col("l_extendedprice") * F.col("l_discount")).alias("y"),
                                             F.col("l_extendedprice").alias("x"))
    return evaluate.ratio_ci(li, ["trial_id"], "y", "x")


@query("trial_clusters")
def _(spark, sf):
    return evaluate.cluster_trials(full(spark, sf), 0.02)


@query("effective_trials")
def _(spark, sf):
    return evaluate.effective_n(evaluate.cluster_trials(full(spark, sf), 0.02))


@query("search_report")
def _(spark, sf):
    return evaluate.search_report(trials(spark, sf), 8, 500)


@query("kelly_leverage")
def _(spark, sf):
    return backtest.kelly_table(full(spark, sf), ["trial_id"], "pos", "pnl", 1e7, reps=500)

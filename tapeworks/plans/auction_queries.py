"""Queries over auction snapshots: audit, features, calibration, backtest, value of information."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeworks.operators import auction as au
from tapeworks.operators import backtest as bt
from tapeworks.operators import sizing
from tapeworks.operators.scan import quantiles
from tapeworks.plans.adapters import snapshots, snapshots_sql
from tapeworks.plans.registry import query

S = f"({snapshots_sql('sql')})"
COLS = ("far_price", "near_price", "target", "wap")
LAST = f"(select max(date_id) from {S})"
CALENDAR = f"(select unnest(range(0, {LAST} + 1)) as date_id)"  # every day up to the last, traded or not
PATH = "partition by stock_id, date_id order by seconds_in_bucket"
INST = "partition by date_id, seconds_in_bucket"
SPREAD = "(ask_price - bid_price) / ((ask_price + bid_price) / 2) * 1e4"


def days(spark, sf):
    """The first and the last day of the table."""
    return 0, snapshots(spark, sf).agg(F.max("date_id")).first()[0] or 0


def plan(spark, sf):
    return au.blocks(days(spark, sf)[1] + 1)


def weights(df):
    return df.select("stock_id").distinct().withColumn("index_weight", (F.col("stock_id") + 1) / 78.0)


RET = f"(select *, (lead(wap, 6) over ({PATH}) / wap - 1) * 1e4 as ret60 from {S})"


@query("auction_forward_return", f"select stock_id, date_id, seconds_in_bucket, ret60 from {RET}", "ret60")
def _(spark, sf):
    return au.with_forward_return(snapshots(spark, sf)).select(*bt.ID, "ret60")


@query("auction_missingness", f"""select seconds_in_bucket, {', '.join(f'avg(case when {x} is null then 1.0 else 0.0 end) as {x}' for x in COLS)} from {S} group by 1""", " ".join(COLS))
def _(spark, sf):
    return au.missingness(snapshots(spark, sf), COLS)


@query("auction_coverage", f"""select a.*, b.* from (select cast(sum(n) as bigint) as n_rows, count(distinct stock_id) as n_stocks, count(distinct date_id) as n_days, count(*) as stock_days, count(*) filter (n <> 24) as incomplete_stock_days
  from (select stock_id, date_id, count(*) as n from {S} group by all)) a, (select min(s) as stocks_per_day_min, quantile_cont(s, 0.5) as stocks_per_day_median, max(s) as stocks_per_day_max
  from (select date_id, count(*) as s from {S} where seconds_in_bucket = 0 group by all)) b""", "stocks_per_day_median")
def _(spark, sf):
    return au.coverage(snapshots(spark, sf), 24)


def _q(x, name):
    return ", ".join(f"quantile_cont({x}, {p}) as {name}_{k}" for k, p in
                     (("q01", 0.01), ("q05", 0.05), ("q25", 0.25), ("q50", 0.5), ("q75", 0.75), ("q95", 0.95), ("q99", 0.99)))


DIST = [f"{n}_{k}" for n in ("spread", "target") for k in ("q01", "q05", "q25", "q50", "q75", "q95", "q99")]


@query("auction_distributions", f"""select {_q(SPREAD, 'spread')}, {_q('target', 'target')}, avg(target) as target_mean, stddev_pop(target) as target_std, avg(abs(target)) as target_mae_vs_zero,
  avg((target - m) ** 4) / avg((target - m) ** 2) ** 2 - 3 as target_excess_kurtosis, avg(case when abs(target) > 20 then 1.0 when target is not null then 0.0 end) as target_share_abs_gt_20bps,
  avg(case when target is null then 1.0 else 0.0 end) as target_null_share from (select *, avg(target) over () as m from {S})""",
       " ".join(DIST) + " target_mean target_std target_mae_vs_zero target_excess_kurtosis target_share_abs_gt_20bps target_null_share")
def _(spark, sf):
    return au.distributions(snapshots(spark, sf))


@query("auction_reconstruction", f"""select quantile_cont(i, 0.5) as median_std_implied_bps, quantile_cont(r, 0.5) as median_std_ret60_bps, count(*) as n_timestamps, quantile_cont(i, 0.5) / quantile_cont(r, 0.5) as ratio
  from (select stddev_samp(ret60 - target) as i, stddev_samp(ret60) as r from {RET} where ret60 - target is not null group by date_id, seconds_in_bucket having count(*) >= 5)""",
       "median_std_implied_bps median_std_ret60_bps ratio")
def _(spark, sf):
    return au.reconstruction(snapshots(spark, sf))


@query("auction_audit", f"""select (select count(*) from {S}) as n_rows, (select count(distinct stock_id) from {S}) as n_stocks, (select avg(target) from {S}) as target_mean, (select min(seconds_in_bucket) from (select seconds_in_bucket, avg(case when far_price is null then 1.0 else 0.0 end) as m from {S} group by 1) where m < 0.5) as far_first_second,
  (select avg(m) from (select seconds_in_bucket, avg(case when far_price is null then 1.0 else 0.0 end) as m from {S} where seconds_in_bucket < 300 group by 1)) as far_null_before_300""", "target_mean far_null_before_300")
def _(spark, sf):
    return au.audit(snapshots(spark, sf), COLS).select("n_rows", "n_stocks", "target_mean", "far_first_second", "far_null_before_300")


@query("index_weights")
def _(spark, sf):
    return au.index_weights(snapshots(spark, sf), days(spark, sf))


def _clip(x, k):
    return f"(case when {x} is null then null else greatest(least({x}, {k}), -{k}) end)"


BOOK = f"""(select *, {SPREAD} as spread_bps, (bid_size - ask_size) / (bid_size + ask_size + 1e-9) as book_imb, (wap / ((ask_price + bid_price) / 2) - 1) * 1e4 as wap_vs_mid_bps,
  ln(1 + bid_size + ask_size) as log_depth, {_clip('imbalance_buy_sell_flag * imbalance_size / (case when matched_size > 0 then matched_size end)', '10.0')} as imb_ratio,
  imbalance_buy_sell_flag * ln(1 + imbalance_size / (bid_size + ask_size + 1e-9)) as imb_to_depth, ln(1 + matched_size) as log_matched,
  {_clip('(reference_price / wap - 1) * 1e4', '2000.0')} as ref_vs_wap_bps, {_clip('(near_price / wap - 1) * 1e4', '2000.0')} as near_vs_wap_bps, {_clip('(far_price / wap - 1) * 1e4', '2000.0')} as far_vs_wap_bps,
  {_clip('(near_price - far_price) * 1e4', '2000.0')} as near_minus_far_bps, cast(imbalance_buy_sell_flag as double) as imb_flag, case when seconds_in_bucket >= 300 then 1.0 else 0.0 end as is_post300,
  cast(seconds_in_bucket as double) as seconds_f, (wap - 1) * 1e4 as wap_from_open_bps from {S})"""
DYN = f"""(select *, (wap / lag(wap, 1) over w - 1) * 1e4 as wap_ret_1, (wap / lag(wap, 3) over w - 1) * 1e4 as wap_ret_3, (wap / lag(wap, 6) over w - 1) * 1e4 as wap_ret_6,
  imb_ratio - lag(imb_ratio, 1) over w as imb_ratio_d1, imb_ratio - lag(imb_ratio, 3) over w as imb_ratio_d3, {_clip('matched_size / (lag(matched_size, 1) over w + 1e-9) - 1', '10.0')} as matched_chg_1,
  book_imb - lag(book_imb, 1) over w as book_imb_d1 from {BOOK} window w as ({PATH}))"""


def _idx(x):
    return f"(sum(coalesce({x}, 0) * case when {x} is null then 0 else iw end) over ({INST}) / (sum(case when {x} is null then 0 else iw end) over ({INST}) + 1e-9))"


def _rank(x):
    return f"(case when {x} is not null then rank() over ({INST} order by {x} nulls last) + (count(*) over (partition by date_id, seconds_in_bucket, {x}) - 1) / 2.0 end) / count(*) over ({INST})"


XS = f"""(select *, rel_ret_6 / (stddev_samp(rel_ret_6) over ({INST}) + 1e-9) as z_rel_ret_6 from (select *, wap_ret_1 - {_idx('wap_ret_1')} as rel_ret_1, wap_ret_6 - {_idx('wap_ret_6')} as rel_ret_6,
  wap_from_open_bps - {_idx('wap_from_open_bps')} as rel_from_open_bps, {_rank('imb_ratio')} as rank_imb_ratio, {_rank('book_imb')} as rank_book_imb, {_rank('round(ref_vs_wap_bps, 6)')} as rank_ref_vs_wap
  from (select *, (stock_id + 1) / 78.0 as iw from {DYN})))"""
HIST = f"""(select x.*, stock_absret_20d, stock_spread_20d from {XS} x left join (select stock_id, date_id, case when count(a) over w >= 5 then avg(a) over w end as stock_absret_20d,
  case when count(s) over w >= 5 then avg(s) over w end as stock_spread_20d from (select stock_id, date_id, avg(abs(target)) as a, avg(spread_bps) as s from {BOOK} group by all)
  window w as (partition by stock_id order by date_id rows between 20 preceding and 1 preceding)) h using (stock_id, date_id))"""


def features(spark, sf):
    """Features before the cast to float; the reference price is rounded so that equal moves tie."""
    df = snapshots(spark, sf)
    base = au.dynamics(au.book_and_auction(df)).withColumn("ref_vs_wap_bps", F.round("ref_vs_wap_bps", 6))
    return au.history(au.cross_section(base, weights(df)))


def group_query(group):
    cols = au.FEATURES[group]
    src = {"book": BOOK, "auction": BOOK, "dynamics": DYN, "xs": XS, "hist": HIST}[group]
    names = [c for c in cols if c != "wap_from_open_bps"] if group == "dynamics" else list(cols)

    @query(f"features_{group}", f"select stock_id, date_id, seconds_in_bucket, {', '.join(names)} from {src}", " ".join(names), 5)
    def _(spark, sf):
        df = au.book_and_auction(snapshots(spark, sf)) if group in ("book", "auction") else features(spark, sf)
        return df.select(*bt.ID, *names)


for _g in au.FEATURES:
    group_query(_g)


@query("feature_matrix", digits=4)
def _(spark, sf):
    df = snapshots(spark, sf)
    return au.build(df, weights(df)).select(*bt.ID, *au.feature_list())


_PLAN = f"""(select cast(round({au.FIRST_DAYS[1]} * share) as bigint) as a, (cast(round({au.FIRST_DAYS[-1] - 1} * share) as bigint) - cast(round({au.FIRST_DAYS[1]} * share) as bigint) + 1) // {len(au.ROLES) - 2} as n
  from (select {LAST} / {au.DAYS - 1}.0 as share))"""


@query("walk_forward_folds", f"""select date_id, count(*) as n, any_value(k) as fold from {S} left join (select k, a + (k - 1) * n as first, a + k * n - 1 as last from {_PLAN}, range({len(au.ROLES) - 1}) r(k)) on date_id between first and last group by date_id""")
def _(spark, sf):
    return au.assign_folds(snapshots(spark, sf), plan(spark, sf)[:-1]).groupBy("date_id", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("stock_median_baseline", f"select stock_id, quantile_cont(target, 0.5) as pred from {S} where target is not null and date_id <= 14 group by stock_id", "pred")
def _(spark, sf):
    return quantiles(snapshots(spark, sf).where("date_id <= 14"), ["stock_id"], "target", {"pred": 0.5})


# forecasts made from the snapshots themselves: a noisy view of the target, folds of six days
PRED = "(coalesce(target, 0) * 3e-1 + (sk % 101 - 50) / 2.5e1)"
P = f"(select stock_id, date_id, seconds_in_bucket, {PRED} as pred, date_id // 6 as fold, target from {S})"


def preds(spark, sf):
    p = F.coalesce("target", F.lit(0.0)) * 0.3 + (F.col("sk") % 101 - 50) / 25.0
    return snapshots(spark, sf).select(*bt.ID, p.alias("pred"), F.floor(F.col("date_id") / 6).alias("fold"), "target")


NEUT = f"""(select stock_id, date_id, seconds_in_bucket, fold, target, pred - sum(pred * (stock_id + 1) / 78.0) over ({INST}) / (sum((stock_id + 1) / 78.0) over ({INST}) + 1e-12) as pred from {P})"""


def neutral(spark, sf):
    p = preds(spark, sf)
    return au.neutralize(p, weights(p))


@query("neutralized_forecasts", f"select stock_id, date_id, seconds_in_bucket, pred from {NEUT}", "pred")
def _(spark, sf):
    return neutral(spark, sf).select(*bt.ID, "pred")


def err_query(by):
    @query(f"forecast_error_by_{by}", f"select {by}, avg(abs(pred - target)) as mae, count(*) as n_rows from {NEUT} where target is not null group by {by}", "mae")
    def _(spark, sf):
        return au.forecast_errors(neutral(spark, sf).drop("target"), snapshots(spark, sf), [by])


for _b in ("date_id", "seconds_in_bucket", "stock_id"):
    err_query(_b)

RK = lambda x: f"rank() over ({INST} order by {x}) + (count(*) over (partition by date_id, seconds_in_bucket, {x}) - 1) / 2.0"
IC = f"""(select date_id, seconds_in_bucket, corr(a, b) as ic from (select date_id, seconds_in_bucket, {RK('round(pred, 9)')} as a, {RK('target')} as b from {NEUT} where target is not null)
  group by date_id, seconds_in_bucket having min(a) < max(a) and min(b) < max(b))"""


@query("forecast_rank_correlation", f"select * from {IC}", "ic")
def _(spark, sf):
    p = neutral(spark, sf).drop("target").withColumn("pred", F.round("pred", 9))
    return au.rank_correlation(p, snapshots(spark, sf))


@query("forecast_metrics", f"""select (select avg(abs(pred - target)) from {NEUT}) as mae, (select count(*) from {NEUT} where target is not null) as n_rows, (select corr(pred, target) from {NEUT} where target is not null) as ic_pearson_pooled,
  (select avg(ic) from {IC}) as ic_spearman_mean, (select avg(ic) / (stddev_samp(ic) / sqrt(count(*))) from (select avg(ic) as ic from {IC} group by date_id)) as ic_day_tstat""",
       "mae ic_pearson_pooled ic_spearman_mean ic_day_tstat")
def _(spark, sf):
    p = neutral(spark, sf).drop("target").withColumn("pred", F.round("pred", 9))
    return au.forecast_metrics(p, snapshots(spark, sf))


SLOPES = f"""(select fold, least(greatest(coalesce(sum(pt) over w / nullif(sum(pp) over w, 0), 0), 0), 5) as slope from (select fold, sum(pred * target) as pt, sum(case when target is not null then pred * pred end) as pp from {NEUT} group by fold)
  window w as (order by fold rows between unbounded preceding and 1 preceding))"""


@query("calibration_slopes", f"select * from {SLOPES}", "slope")
def _(spark, sf):
    return sizing.expanding_slopes(neutral(spark, sf))


EDGES = f"(select n.*, pred * slope as edge from {NEUT} n join {SLOPES} s using (fold) where fold >= 1)"
DECF = f"""(select e.stock_id, e.date_id, e.seconds_in_bucket, e.pred, e.edge, e.fold, m.target, m.bid_size, m.ask_size, m.sp as spread_entry_bps, coalesce(x.sp, m.sp) as spread_exit_bps
  from {EDGES} e join (select *, {SPREAD} as sp from {S}) m using (stock_id, date_id, seconds_in_bucket)
  left join (select stock_id, date_id, seconds_in_bucket - 60 as seconds_in_bucket, {SPREAD} as sp from {S}) x using (stock_id, date_id, seconds_in_bucket)
  where e.seconds_in_bucket % 60 = 0 and m.target is not null and e.edge is not null)"""


def decisions(spark, sf):
    return au.edges_for(neutral(spark, sf).drop("target"), snapshots(spark, sf))


@query("decision_frame", f"select * from {DECF}", "pred edge target bid_size ask_size spread_entry_bps spread_exit_bps")
def _(spark, sf):
    return decisions(spark, sf)


@query("round_trip_costs", f"select stock_id, date_id, seconds_in_bucket, (spread_entry_bps + spread_exit_bps) / 2 + 1.5 as cost_bps from {DECF}", "cost_bps")
def _(spark, sf):
    return decisions(spark, sf).select(*bt.ID, bt.cost_bps().alias("cost_bps"))


POL = [{"threshold": t, "sizing": s, "max_gross": 100_000.0} for t in (0.5, 1.0) for s in ("flat", "ramp")]
POLS = "(values " + ", ".join(f"('{i}/base', {p['threshold']}, '{p['sizing']}')" for i, p in enumerate(POL)) + ") pol(trial_id, threshold, sizing)"
TRD = f"""(select *, gross_usd - cost_usd as pnl_usd from (select *, notional * side * target / 1e4 as gross_usd, notional * cost_bps / 1e4 as cost_usd from (
  select * replace (raw * least(1.0, 100000.0 / sum(raw) over (partition by trial_id, date_id, seconds_in_bucket)) as notional) from (
  select *, raw as notional from (select *, case sizing when 'ramp' then least(100000.0, 0.1 * touch) * least(greatest((abs(edge) - cost_bps) / cost_bps, 0.0), 1.0) else least(100000.0, 0.1 * touch) end as raw from (
  select *, (spread_entry_bps + spread_exit_bps) / 2 + 1.5 as cost_bps, case when edge > 0 then ask_size else bid_size end as touch, case when edge > 0 then 1.0 else -1.0 end as side from {DECF}, {POLS})
  where abs(edge) > threshold * cost_bps) where raw > 0))))"""


@query("trades", f"select trial_id, stock_id, date_id, seconds_in_bucket, side, notional, gross_usd, cost_usd, pnl_usd from {TRD}", "side notional gross_usd cost_usd pnl_usd")
def _(spark, sf):
    return bt.trades(bt.with_policies(decisions(spark, sf), POL)).select("trial_id", *bt.ID, "side", "notional", "gross_usd", "cost_usd", "pnl_usd")


DAYSQL = f"""(select *, cum_pnl_usd - greatest(max(cum_pnl_usd) over (partition by trial_id order by date_id), 0) as drawdown_usd from (select *, sum(pnl_usd) over (partition by trial_id order by date_id) as cum_pnl_usd from (
  select trial_id, date_id, coalesce(n_trades, 0) as n_trades, coalesce(notional, 0) as notional, coalesce(gross_usd, 0) as gross_usd, coalesce(cost_usd, 0) as cost_usd, coalesce(pnl_usd, 0) as pnl_usd
  from (select trial_id, date_id from {POLS}, {CALENDAR} c) left join (select trial_id, date_id, count(*) as n_trades, sum(notional) as notional, sum(gross_usd) as gross_usd, sum(cost_usd) as cost_usd, sum(pnl_usd) as pnl_usd from {TRD} group by all) t using (trial_id, date_id))))"""


def backtested(spark, sf):
    return bt.backtest(decisions(spark, sf), POL, days(spark, sf))


@query("daily_pnl", f"select * from {DAYSQL}", "notional gross_usd cost_usd pnl_usd cum_pnl_usd drawdown_usd")
def _(spark, sf):
    return backtested(spark, sf)[1]


SUMM = f"""(select *, coalesce(total_pnl_usd * 1e4 / nullif(nn, 0), null) as net_bps_per_trade from (select trial_id, count(*) as days, sum(pnl_usd) as total_pnl_usd, avg(pnl_usd) as mean_daily_pnl_usd, stddev_samp(pnl_usd) as std_daily_pnl_usd, min(drawdown_usd) as max_drawdown_usd,
  case when stddev_samp(pnl_usd) > 0 then avg(pnl_usd) / stddev_samp(pnl_usd) else 0.0 end as sharpe_daily, sum(notional) as nn from {DAYSQL} group by trial_id)
  left join (select trial_id, count(*) as trades, avg(case when pnl_usd > 0 then 1.0 else 0.0 end) as hit_rate, sum(abs(edge) * notional) / sum(notional) as edge_pred_bps, sum(side * target * notional) / sum(notional) as edge_realized_bps from {TRD} group by trial_id) using (trial_id))"""


@query("backtest_summary", f"""select trial_id, days, total_pnl_usd, mean_daily_pnl_usd, std_daily_pnl_usd, max_drawdown_usd, sharpe_daily, coalesce(trades, 0) as trades, coalesce(hit_rate, 0) as hit_rate, edge_pred_bps, edge_realized_bps, net_bps_per_trade from {SUMM}""",
       "total_pnl_usd mean_daily_pnl_usd std_daily_pnl_usd max_drawdown_usd sharpe_daily hit_rate edge_pred_bps edge_realized_bps net_bps_per_trade", 5)
def _(spark, sf):
    return backtested(spark, sf)[2].select("trial_id", "days", "total_pnl_usd", "mean_daily_pnl_usd", "std_daily_pnl_usd", "max_drawdown_usd", "sharpe_daily", "trades",
                                           "hit_rate", "edge_pred_bps", "edge_realized_bps", "net_bps_per_trade")


@query("best_trial", f"select arg_max(trial_id, sharpe_daily) as trial_id, max(sharpe_daily) as sharpe_daily from {SUMM}", "sharpe_daily")
def _(spark, sf):
    return bt.select_best(backtested(spark, sf)[2])


MULTS = [("adapted 1x", 1, 1), ("adapted 2x", 2, 2), ("adapted 3x", 3, 3), ("unadapted 2x", 1, 2), ("unadapted 3x", 1, 3)]


COSTS = "(values " + ", ".join([f"('0/{n}', false, {d}, {c})" for n, d, c in MULTS] + [f"('0/oracle {m}x', true, {m}, {m})" for m in (1, 2, 3)]) + ") v(trial_id, perfect, dm, pm)"
ROBUST = f"""with t0 as (select trial_id, date_id, seconds_in_bucket, cast(target as double) as target, case when perfect then cast(target as double) else edge end as e, bid_size, ask_size, ((spread_entry_bps + spread_exit_bps) / 2 + 1.5) * dm as decide,
    ((spread_entry_bps + spread_exit_bps) / 2 + 1.5) * pm as pay from {DECF}, {COSTS}),
  t1 as (select *, case when e > 0 then 1e0 else -1e0 end as side, least(1e5, 0.1 * case when e > 0 then ask_size else bid_size end) as raw from t0 where abs(e) > {POL[0]['threshold']} * decide),
  t2 as (select *, raw * least(1e0, 1e5 / sum(raw) over (partition by trial_id, date_id, seconds_in_bucket)) as n from t1 where raw > 0),
  tr as (select *, n * side * target / 1e4 as g, n * pay / 1e4 as c from t2),
  dd as (select *, cum - greatest(max(cum) over (partition by trial_id order by date_id), 0) as down from (select *, sum(pnl) over (partition by trial_id order by date_id) as cum from (
    select trial_id, date_id, coalesce(pnl, 0e0) as pnl from (select trial_id, date_id from {COSTS}, {CALENDAR} c) left join (select trial_id, date_id, sum(g - c) as pnl from tr group by all) using (trial_id, date_id)))),
  a as (select trial_id, count(*) as days, sum(pnl) as total_pnl_usd, avg(pnl) as mean_daily_pnl_usd, stddev_samp(pnl) as std_daily_pnl_usd, min(down) as max_drawdown_usd from dd group by 1),
  b as (select trial_id, count(*) as trades, avg(case when g - c > 0 then 1e0 else 0e0 end) as hit_rate, sum(n) as nn, sum(g) as gross_usd, sum(c) as cost_usd, sum(abs(e) * n) as pred, sum(side * target * n) as made from tr group by 1)
  select *, sharpe_daily * sqrt(252.0) as sharpe_annualized from (select trial_id, days, total_pnl_usd, mean_daily_pnl_usd, std_daily_pnl_usd, max_drawdown_usd, coalesce(trades, 0) as trades, coalesce(hit_rate, 0) as hit_rate, coalesce(gross_usd, 0) as gross_usd,
    coalesce(cost_usd, 0) as cost_usd, case when std_daily_pnl_usd > 0 then mean_daily_pnl_usd / std_daily_pnl_usd else 0e0 end as sharpe_daily, coalesce(trades, 0) / cast(days as double) as trades_per_day, 2 * coalesce(nn, 0) / days as turnover_usd_per_day,
    case when gross_usd > 0 then cost_usd / gross_usd end as cost_share_of_gross, pred / nn as edge_pred_bps, made / nn as edge_realized_bps, 1e4 * total_pnl_usd / nn as net_bps_per_trade, mean_daily_pnl_usd / {bt.POLICY['max_gross']} as return_on_capital_daily from a left join b using (trial_id))"""


@query("cost_robustness", ROBUST, "total_pnl_usd mean_daily_pnl_usd std_daily_pnl_usd max_drawdown_usd hit_rate gross_usd cost_usd sharpe_daily sharpe_annualized trades_per_day turnover_usd_per_day cost_share_of_gross edge_pred_bps edge_realized_bps net_bps_per_trade return_on_capital_daily", 4)
def _(spark, sf):
    d = decisions(spark, sf)
    a = bt.backtest(d, POL[:1], days(spark, sf), MULTS)[2]
    o = bt.backtest(sizing.with_oracle(d), POL[:1], days(spark, sf), [(f"oracle {m}x", m, m) for m in (1, 2, 3)])[2]
    return a.unionByName(o)


@query("capacity", f"""select trial_id, peak_gross_usd, share_trades_depth_capped, mean_notional_usd, median_touch_usd from (select trial_id, max(g) as peak_gross_usd from (select trial_id, sum(notional) as g from {TRD} group by trial_id, date_id, seconds_in_bucket) group by trial_id)
  join (select trial_id, avg(case when 0.1 * touch < 100000 then 1.0 else 0.0 end) as share_trades_depth_capped, avg(notional) as mean_notional_usd, quantile_cont(touch, 0.5) as median_touch_usd from {TRD} group by trial_id) using (trial_id)""",
       "peak_gross_usd share_trades_depth_capped mean_notional_usd median_touch_usd")
def _(spark, sf):
    tr, day, _s = backtested(spark, sf)
    return bt.capacity(tr, day).drop("kelly_leverage_on_peak")


@query("prediction_deciles", f"""with e as (select {', '.join(f'quantile_cont(pred, {i / 10}) as e{i}' for i in range(1, 10))} from {NEUT} where target is not null)
  select 1 + {' + '.join(f'(case when pred >= e{i} then 1 else 0 end)' for i in range(1, 10))} as decile, avg(pred) as mean_pred_bps, avg(target) as mean_target_bps, count(*) as n from {NEUT}, e where target is not null group by 1""",
       "mean_pred_bps mean_target_bps")
def _(spark, sf):
    return sizing.decile_table(neutral(spark, sf))


@query("cost_blind_picks", f"""select stock_id, date_id, seconds_in_bucket, edge from (select *, row_number() over ({INST} order by round(abs(edge), 9) desc, stock_id) / cast(count(*) over ({INST}) as double) as r from {DECF}) where r <= 0.3""", "edge")
def _(spark, sf):
    d = decisions(spark, sf).withColumn("_o", F.round(F.abs("edge"), 9))
    return sizing.top_decile(d, share=0.3, col="_o").select(*bt.ID, "edge")


@query("value_of_information")
def _(spark, sf):
    return sizing.voi_curve(decisions(spark, sf), days(spark, sf), (0.0, 0.1, 0.3, 0.6), (1.0, 2.0))


@query("break_even_correlation")
def _(spark, sf):
    return sizing.break_even(sizing.voi_curve(decisions(spark, sf), days(spark, sf), (0.0, 0.1, 0.3, 0.6), (1.0, 2.0)), ["cost_mult"], "rho", "threshold_net_bps")


def feat(spark, sf):
    from tapeworks.operators.scan import cut

    df = snapshots(spark, sf)
    return cut(au.build(df, weights(df))), df


RIDGE = au.ModelSpec("ridge", au.ALL_GROUPS, {"alpha": 10.0})


@query("ridge_walk_forward", digits=3)
def _(spark, sf):
    f, df = feat(spark, sf)
    return au.walk_forward(f, RIDGE, plan(spark, sf), weights(df))


@query("boosted_fold", digits=3)
def _(spark, sf):
    f, df = feat(spark, sf)
    return au.forecasts(f, au.ModelSpec("boosted", ("book", "auction"), {"rounds": 3, "depth": 3, "valid_days": 3}), plan(spark, sf)[-2:-1])


@query("model_comparison", digits=4)
def _(spark, sf):
    f, df = feat(spark, sf)
    a = au.walk_forward(f, au.ModelSpec("median"), plan(spark, sf), weights(df))
    b = au.walk_forward(f, au.ModelSpec("zero"), plan(spark, sf), weights(df))
    return au.compare_models(a, b, df)


@query("experiment_grid", digits=3)
def _(spark, sf):
    return au.experiment_grid({"noisy view": decisions(spark, sf)}, days(spark, sf))[1]


@query("experiment_log", digits=3)
def _(spark, sf):
    """Four models under four policies, logged; the second run of the same grid finds every trial in the log."""
    from tapeworks.functions.shared import folder
    from tapeworks.operators import experiments as ex
    from tapeworks.sources import trials

    f, df = feat(spark, sf)
    specs = [au.ModelSpec("zero"), au.ModelSpec("median"), RIDGE, au.ModelSpec("boosted", ("book", "auction"), {"rounds": 3, "depth": 3, "valid_days": 3})]
    made, at, mark = ex.model_decisions(f, df, weights(df), plan(spark, sf), specs), folder(spark), ex.data_fingerprint(df)
    ex.log_grid(made, days(spark, sf), at, mark, POL)
    again = ex.log_grid(made, days(spark, sf), at, mark, POL)
    entries = trials.flatten(again).join(again.select("trial_id", "key"), "trial_id")
    return entries.select("key", "n_obs", *[F.try_element_at("entries", F.lit(k)).alias(k.replace(".", "_")) for k in ("tags.model", "config.policy.threshold", "config.policy.sizing", "metrics.trades", "metrics.sharpe_daily")])


@query("holdout_score", digits=3)
def _(spark, sf):
    f, df = feat(spark, sf)
    blocks = plan(spark, sf)
    research = preds(spark, sf).where(F.col("date_id") < blocks[-1].first).select(*bt.ID, "pred")
    return au.holdout_score(f, df, weights(df), au.ModelSpec("median"), research, POL[0], blocks)

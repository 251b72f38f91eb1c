import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.operators import auction as au
from tapeworks.operators import backtest as bt
from tapeworks.operators import sizing as sz


def snapshots(stocks=6, days=30, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(days):
        wap = 1 + rng.normal(0, 1e-4, stocks)
        for s in range(0, 541, 20):
            wap = wap + rng.normal(0, 2e-4, stocks)
            for i in range(stocks):
                half = 1e-4 * rng.integers(1, 4)
                late = s >= 300
                rows.append((i, d, s, float(rng.integers(0, 10**6)), int(rng.integers(-1, 2)), float(wap[i] + 1e-4), float(rng.integers(0, 5) * 1e5),
                             float(wap[i] + 1e-3) if late else None, float(wap[i] - 1e-3) if late else None, float(wap[i] - half), float(rng.integers(1, 99) * 100),
                             float(wap[i] + half), float(rng.integers(1, 99) * 100), float(wap[i]), float(rng.normal(0, 5)) if rng.random() > 0.02 else None))
    return rows


SCHEMA = ("stock_id int, date_id int, seconds_in_bucket int, imbalance_size double, imbalance_buy_sell_flag int, reference_price double, matched_size double, far_price double, "
          "near_price double, bid_price double, bid_size double, ask_price double, ask_size double, wap double, target double")


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(snapshots(), SCHEMA).cache()


@pytest.fixture(scope="module")
def weights(spark):
    return spark.createDataFrame([(i, 1 / 6) for i in range(6)], "stock_id int, index_weight double")


def test_features_do_not_see_the_future(spark, df, weights):
    feats = au.feature_list()
    base = au.build(df, weights)
    for day, sec in ((10, 240), (20, 0), (29, 540)):
        later = (F.col("date_id") > day) | ((F.col("date_id") == day) & (F.col("seconds_in_bucket") > sec))
        realised = F.col("date_id") >= day  # targets of the day itself are not known yet
        broken = df.withColumns({c: F.when(later, F.col(c) * 3 + 7).otherwise(F.col(c)) for c in ("wap", "bid_price", "ask_size", "imbalance_size", "matched_size")})
        broken = broken.withColumn("target", F.when(realised, 999.0).otherwise(F.col("target")))
        past = ~later
        a = base.where(past).select(*bt.ID, *feats)
        b = au.build(broken, weights).where(past).select(*bt.ID, *feats)
        assert a.exceptAll(b).count() == 0


def test_planted_index_weights_are_found(spark):
    rng = np.random.default_rng(3)
    w = np.array([0.5, 0.3, 0.2])
    rows = []
    for d in range(8):
        wap = np.ones(3)
        path = [wap]
        for _ in range(28):
            path.append(path[-1] * (1 + rng.normal(0, 1e-3, 3)))
        for k in range(29):
            ret = (path[k + 6] / path[k] - 1) * 1e4 if k + 6 < 29 else None
            for i in range(3):
                rows.append((i, d, 20 * k, float(path[k][i]), None if ret is None else float(ret[i] - w @ ret)))
    x = spark.createDataFrame(rows, "stock_id int, date_id int, seconds_in_bucket int, wap double, target double")
    got = [r["index_weight"] for r in au.index_weights(x, (0, 7)).orderBy("stock_id").collect()]
    assert got == pytest.approx(w.tolist(), abs=1e-6)
    few = au.index_weights(x.where("seconds_in_bucket < 160"), (0, 0))
    assert [r["index_weight"] for r in few.collect()] == pytest.approx([1 / 3] * 3) and not any(r["calibrated"] for r in few.collect())


def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(0, 1, (300, 2))
    y = 2 * X[:, 0] - X[:, 1] + rng.normal(0, 0.5, 300)
    rows = [(i, 0, 0, float(a), float(b), float(t)) for i, ((a, b), t) in enumerate(zip(X, y))]
    d = spark.createDataFrame(rows, "stock_id int, date_id int, seconds_in_bucket int, a double, b double, target double")
    got = np.array([r["pred"] for r in au._ridge(d.withColumn("fold", F.lit(0)), d.withColumn("fold", F.lit(0)), ["a", "b"], 25.0, 0.005).orderBy("stock_id").collect()])
    lo, hi = np.quantile(X, 0.005, axis=0), np.quantile(X, 0.995, axis=0)
    Z = np.clip(X, lo, hi)
    Z = (Z - Z.mean(axis=0)) / (Z.std(axis=0) + 1e-9)
    t = np.clip(y, *np.quantile(y, [0.01, 0.99]))
    b = np.linalg.solve(Z.T @ Z + 25.0 * np.eye(2), Z.T @ (t - t.mean()))
    assert np.allclose(got, t.mean() + Z @ b, atol=1e-6)


def test_blocks_of_days():
    f = au.blocks()
    assert [(b.first, b.last) for b in f] == [(121, 180), (181, 240), (241, 300), (301, 360), (361, 420), (421, 480)]
    assert f[1].train_to == 179 and f[0].role == "calibration" and f[5].role == "holdout"
    s = au.blocks(30)
    assert all(b.train_to < b.first - 1 for b in s) and s[-1].last == 29


def test_ridge_of_several_folds_and_missing_values(spark):
    """Each fold learns from its own rows; a missing value counts as the mean; a feature without values has no part."""
    rng = np.random.default_rng(5)
    rows = [(i, int(i % 30), 0, float(rng.normal()) if rng.random() > 0.2 else None, float("nan") if rng.random() < 0.1 else float(rng.normal(3, 2)), None, float(rng.normal(1, 4))) for i in range(600)]
    d = spark.createDataFrame(rows, "stock_id int, date_id int, seconds_in_bucket int, a double, b double, c double, target double")
    plan = [au.Block(0, "evaluation", 9, 11, 14), au.Block(1, "evaluation", 19, 21, 29)]
    marked = au.assign_folds(d, plan)
    got = au._ridge(marked.withColumn("fold", F.explode("train_folds")), marked.where("fold is not null"), ["a", "b", "c"], 10.0, 0.005)
    got = {r["stock_id"]: r["pred"] for r in got.collect()}
    X = np.array([[np.nan if v is None else v for v in r[3:5]] for r in rows], float)
    y, day = np.array([r[6] for r in rows]), np.array([r[1] for r in rows])
    for b in plan:
        t, e = day <= b.train_to, (day >= b.first) & (day <= b.last)
        lo, hi = np.nanquantile(X[t], 0.005, axis=0), np.nanquantile(X[t], 0.995, axis=0)
        C = np.clip(X, lo, hi)
        m, s = np.nanmean(C[t], axis=0), np.nanstd(C[t], axis=0) + 1e-9
        Z = np.nan_to_num((C - m) / s)
        ty = np.clip(y[t], *np.quantile(y[t], [0.01, 0.99]))
        w = np.linalg.solve(Z[t].T @ Z[t] + 10 * np.eye(2), Z[t].T @ (ty - ty.mean()))
        assert np.allclose([got[i] for i in np.flatnonzero(e)], ty.mean() + Z[e] @ w, atol=1e-6)


def test_boosted_blocks_beat_the_constant(spark):
    rng = np.random.default_rng(6)
    rows = [(i, int(i % 30), 0, float(x), float(5 * np.sign(x) + rng.normal(0, 0.3))) for i, x in enumerate(rng.normal(0, 1, 900))]
    d = spark.createDataFrame(rows, "stock_id int, date_id int, seconds_in_bucket int, x double, target double")
    with pytest.MonkeyPatch.context() as patch:
        patch.setitem(au.FEATURES, "planted", ("x",))
        spec = au.ModelSpec("boosted", ("planted",), {"rounds": 5, "depth": 2, "valid_days": 3})
        got = au.forecasts(d, spec, [au.Block(0, "evaluation", 19, 21, 29)]).join(d, list(bt.ID))
        gain = au.feature_importance(d, spec, au.Block(0, "evaluation", 19, 21, 29)).collect()
    mae = got.agg(F.avg(F.abs(F.col("pred") - F.col("target"))), F.avg(F.abs("target"))).first()
    assert mae[0] < 0.5 * mae[1] and gain[0]["feature"] == "x" and gain[0]["importance"] == pytest.approx(1.0)


def test_slopes_use_earlier_folds_only(spark):
    p = spark.createDataFrame([(0, 1.0, 2.0), (1, 1.0, 9.0), (2, 1.0, 4.0)], "fold int, pred double, target double")
    assert [r["slope"] for r in sz.expanding_slopes(p).orderBy("fold").collect()] == [0.0, 2.0, 5.0]


def test_gross_cap_and_ramp(spark):
    rows = [(i, 0, 0, 10.0, 1.0, 1e7, 1e7, 1.0, 1.0) for i in range(4)]
    d = spark.createDataFrame(rows, "stock_id int, date_id int, seconds_in_bucket int, edge double, target double, bid_size double, ask_size double, spread_entry_bps double, spread_exit_bps double")
    t = bt.trades(bt.with_policies(d, [{"max_gross": 200_000.0}, {"sizing": "ramp", "ramp": 6.0}]))
    a = {r["trial_id"]: r for r in t.groupBy("trial_id").agg(F.sum("notional").alias("n"), F.max("notional").alias("m")).collect()}
    assert a["0/base"]["n"] == pytest.approx(200_000) and a["1/base"]["m"] == pytest.approx(100_000 * (10 - 2.5) / 15)


def test_kelly_growth_peaks_at_the_fraction(spark):
    b = spark.createDataFrame([(0.6, 0.5), (0.3, 0.5)], "p_belief double, price_q double")
    for r in sz.kelly_columns(b).collect():
        p, q = (r["p_belief"], r["price_q"]) if r["best_side"] == "YES" else (1 - r["p_belief"], 1 - r["price_q"])
        g = lambda f: p * math.log1p(f * (1 - q) / q) + (1 - p) * math.log1p(-f)
        assert r["growth"] == pytest.approx(g(r["kelly"])) and g(r["kelly"]) > max(g(r["kelly"] - 0.05), g(r["kelly"] + 0.05))


def test_prizes_are_shared_by_ties(spark):
    b = spark.createDataFrame([("a", 10), ("b", 9), ("c", 9), ("d", 1)], "who string, score int")
    got = {r["who"]: r["prize"] for r in sz.prize_split(b, (100.0, 50.0, 20.0)).collect()}
    assert got == {"a": 100.0, "b": 35.0, "c": 35.0, "d": 0.0}


def test_walk_forward_cache_follows_its_inputs(spark, tmp_path):
    days = [(s, d, 0, float(d), 1.0, float(s + d)) for s in range(3) for d in range(30)]
    feat = spark.createDataFrame(days, "stock_id long, date_id long, seconds_in_bucket long, target double, wap double, x double")
    w = spark.createDataFrame([(s, 1 / 3) for s in range(3)], "stock_id long, index_weight double")
    plan, spec, at = au.blocks(30), au.ModelSpec("zero"), str(tmp_path)
    first = au.walk_forward(feat, spec, plan, w, at).count()
    assert au.walk_forward(feat, spec, plan, w, at).count() == first and len(list(tmp_path.iterdir())) == 1
    au.walk_forward(feat.withColumn("x", F.col("x") + 1), spec, plan, w, at)
    au.walk_forward(feat, spec, plan, w.withColumn("index_weight", F.col("stock_id") / 3), at)
    assert len(list(tmp_path.iterdir())) == 3
    assert au.fingerprint(feat.repartition(3)) == au.fingerprint(feat)


def test_queries_cover_the_days_of_the_table(spark, tmp_path):
    """Days and folds come from the data: events of twenty further days are traded and dealt to folds."""
    from pyspark.sql import functions as F

    from tapeworks.plans import catalog
    from tests.conftest import SF

    ev = spark.read.parquet(f"{SF}/events.parquet")
    later = ev.withColumns({"ts": F.col("ts") + F.expr("interval 20 days"), "event_id": F.col("event_id") + 10**7})
    ev.unionByName(later).write.parquet(str(tmp_path / "events.parquet"))
    folds = {r["date_id"]: r["fold"] for r in catalog.QUERIES["walk_forward_folds"](spark, str(tmp_path)).collect()}
    assert max(folds) == 49 and {f for f in folds.values() if f is not None} == {0, 1, 2, 3, 4} and folds[30] is not None
    days = catalog.QUERIES["daily_pnl"](spark, str(tmp_path)).groupBy("trial_id").agg(F.max("date_id").alias("last"), F.count(F.lit(1)).alias("n"))
    assert {(r["last"], r["n"]) for r in days.collect()} == {(49, 50)}


def test_experiment_grid_logs_every_trial_once(spark, tmp_path):
    """A second run logs nothing; a new model or other data logs its own trials; records hold the traded results."""
    import json

    from pyspark.sql import functions as F

    from tapeworks.operators import backtest, experiments as ex
    from tapeworks.operators.auction import ModelSpec
    from tapeworks.sources import trials

    rng = np.random.default_rng(3)
    rows = [(s, d, 60 * t, float(rng.normal(0, 4)), float(rng.normal(0, 6)), 1e5, 1e5, 1.0, 1.0) for s in range(4) for d in range(8) for t in range(3)]
    dec = spark.createDataFrame(rows, "stock_id int, date_id int, seconds_in_bucket int, edge double, target double, bid_size double, ask_size double, spread_entry_bps double, spread_exit_bps double")
    policies = [{"threshold": 0.5, "sizing": "flat"}, {"threshold": 1.0, "sizing": "ramp"}]
    a, b, c = ModelSpec("zero"), ModelSpec("ridge", ("book",), {"alpha": 1.0}), ModelSpec("boosted", ("book",), {"depth": 3})
    other = dec.withColumn("edge", -F.col("edge"))
    at = str(tmp_path / "log")
    first = ex.log_grid([(a, dec), (b, other)], (0, 7), at, "x", policies)
    assert sorted(r["key"] for r in first.collect()) == ["0:0", "0:1", "1:0", "1:1"]
    ids = {r["config_hash"]: r["trial_id"] for r in first.collect()}
    again = ex.log_grid([(a, dec), (b, other)], (0, 7), at, "x", policies)
    assert {r["config_hash"]: r["trial_id"] for r in again.collect()} == ids and trials.records(spark, at).count() == 4
    ex.log_grid([(c, dec), (b, other)], (0, 7), at, "x", policies)
    assert trials.records(spark, at).count() == 6
    ex.log_grid([(a, dec)], (0, 7), at, "y", policies[:1])
    assert trials.records(spark, at).count() == 7
    want = {r["trial_id"]: r["total_pnl_usd"] for r in backtest.backtest(other, policies, (0, 7))[2].collect()}
    got = {r["key"]: json.loads(r["metrics"])["total_pnl_usd"] for r in first.collect()}
    assert got["1:0"] == pytest.approx(want["0/base"]) and got["1:1"] == pytest.approx(want["1/base"])
    assert {len(r["pnl_values"]) for r in first.collect()} == {8}
    assert ex.label(c) == "boosted[book, depth 3]" and ex.data_fingerprint(dec) == ex.data_fingerprint(dec.repartition(3)) != ex.data_fingerprint(other)

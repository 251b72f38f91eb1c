import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.operators import drift, fills, signals, tape as tp
from tapeworks.operators.scan import asof, avg_rank, ordered_scan, quantiles
from tests.naive import random_day, replay

TAPE = ("day string, ticker string, seq long, time double, type int, order_id long, size long, price long, direction int, "
        "bids array<struct<price:long,size:long>>, asks array<struct<price:long,size:long>>")


def make_tape(spark, days):
    rows = [(d, "X", r["seq"], r["time"], r["type"], r["order_id"], r["size"], r["price"], r["direction"], r["bids"], r["asks"]) for d, rs in days.items() for r in rs]
    t = spark.createDataFrame(rows, TAPE)
    return t.select("*", *[F.col(s)[0][f].alias(f"{s[:-1]}_{f}") for s in ("bids", "asks") for f in ("price", "size")])


@pytest.fixture(scope="module")
def days():
    rng = random.Random(7)
    return {f"2024-01-0{i}": random_day(rng, 220) for i in range(1, 7)}


@pytest.fixture(scope="module")
def tape(spark, days):
    return make_tape(spark, days).cache()


def test_scan_does_not_depend_on_pieces(spark, tape):
    def run(k):
        d = ordered_scan(tape, ["day"], "seq", sums={"s": F.col("size")}, lags={"p": F.col("price")}, leads={"n": F.col("price")},
                         ffill={"f": F.when(F.col("type") == 7, F.col("seq"))}, bfill={"b": F.when(F.col("type") == 3, F.col("seq"))}, chunk_rows=k)
        return sorted(map(tuple, d.select("day", "seq", "s", "p", "n", "f", "b").collect()), key=repr)

    assert run(7) == run(10**6)


def test_next_value_is_not_sought_anew_for_every_row(spark, tape):
    """A frame from the next row to the end of the group is gone through for each row; both forms of the scan read backwards."""
    for k in (7, 10**6):
        d = ordered_scan(tape, ["day"], "seq", bfill={"b": F.when(F.col("type") == 3, F.col("seq"))}, chunk_rows=k)
        assert "unboundedfollowing" not in d._jdf.queryExecution().optimizedPlan().toString().lower()
        for _, g in d.toPandas().groupby("day"):
            g = g.sort_values("seq")
            want = g["seq"].where(g["type"] == 3).shift(-1).bfill()
            assert (g["b"].fillna(-1) == want.fillna(-1)).all()


def test_asof_matches_search(spark, tape, days):
    pts = spark.createDataFrame([(d, float(t)) for d in days for t in np.arange(-5, 320, 3.7)], "day string, t double")
    for slot in (11.0, 1e6):
        got = {(r["day"], r["t"]): r["s"] for r in asof(pts, tape, ["day"], "t", "time", "seq", {"s": "seq"}, slot).collect()}
        for (d, t), s in got.items():
            times = np.array([r["time"] for r in days[d]])
            i = int(np.searchsorted(times, t, side="right")) - 1
            assert s == (None if i < 0 else i)


def test_asof_cuts_crowded_slots(spark):
    """Half of all rows in one second, many at one time: the same answers, and no piece above twice the median."""
    from tapeworks.operators import scan

    rng = random.Random(8)
    times = sorted([rng.uniform(0, 4000) for _ in range(2000)] + [2000 + rng.choice([0.0, 0.25, rng.random()]) for _ in range(2000)])
    states = spark.createDataFrame([("x", t, i, i * 10) for i, t in enumerate(times)], "g string, t double, seq long, v long")
    asked = [rng.uniform(-5, 4100) for _ in range(200)] + [2000.0, 2000.25, 2000.5, 1999.999] * 5
    points = spark.createDataFrame([("x", i, t) for i, t in enumerate(asked)], "g string, id long, at double")
    want = {i: max((j * 10 for j, t in enumerate(times) if t <= a), default=None) for i, a in enumerate(asked)}
    for rows in (64, 10**6):
        got = scan.asof(points, states, ["g"], "at", "t", "seq", {"v": "v"}, slot=1000.0, slot_rows=rows)
        assert {r["id"]: r["v"] for r in got.collect()} == want
    st = states.select("g", F.floor(F.col("t") / 1000).alias("_slot"), F.col("t").alias("_t"), F.col("seq").alias("_s"))
    cuts = {r["_slot"]: [tuple(c) for c in r["_cuts"]] for r in scan._cuts(st, ["g", "_slot"], 256).collect()}
    inside = [i for i, t in enumerate(times) if 2000 <= t < 3000]
    pieces = Counter(sum(c <= (times[i], i) for c in cuts[2]) for i in inside)
    assert len(pieces) >= 5 and max(pieces.values()) <= 2 * sorted(pieces.values())[len(pieces) // 2]


def test_a_quantile_between_equal_values_is_that_value(spark):
    """An edge inside a run of equal values does not move off it by rounding, so that these values stand on the edge."""
    v, n = -3.53538259600654, 49
    edges = quantiles(spark.createDataFrame([(v,)] * n, "v double"), [], "v", {f"e{i}": i / 10 for i in range(1, 10)}).first()
    assert set(edges) == {v}


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.standard_t(2, 500), np.repeat(3.25, 40), [1e9]])
    df = spark.createDataFrame([("a", float(v)) for v in x], "g string, v double")
    got = quantiles(df, ["g"], "v", {"q1": 0.01, "q5": 0.5, "q9": 0.99}, bins=16).first()
    assert np.allclose([got["q1"], got["q5"], got["q9"]], np.quantile(x, [0.01, 0.5, 0.99]))
    assert quantiles(df, [], "v", {"m": 0.5}).first()["m"] == pytest.approx(np.median(x))


def test_average_rank(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (1, None), (1, 1.0)], "g int, v double").withColumn("r", avg_rank("v", ["g"]))
    assert sorted(r["r"] or 0 for r in df.collect()) == [0, 1.0, 2.5, 2.5]


def test_flow_events_by_hand(spark):
    states = [(100, 5, 102, 5), (100, 10, 102, 5), (101, 3, 102, 5), (101, 3, 102, 1), (100, 6, 102, 1)]
    rows = [("d", "X", i, float(i), 1, 0, 1, 100, 1, [(b, x)], [(a, y)]) for i, (b, x, a, y) in enumerate(states)]
    t = make_tape(spark, {}) if False else spark.createDataFrame(rows, TAPE).select("*", *[F.col(s)[0][f].alias(f"{s[:-1]}_{f}") for s in ("bids", "asks") for f in ("price", "size")])
    got = [r["flow"] for r in signals.with_flow(t, chunk_rows=2).orderBy("seq").collect()]
    assert got == [0, 5, 3, 4, -3]


def test_trades_group_adjacent_rows(spark, tape, days):
    n = 0
    for rows in days.values():
        prev = None
        for r in rows:
            if r["type"] == 4:
                if not (prev and prev["type"] == 4 and prev["time"] == r["time"] and prev["direction"] == r["direction"]):
                    n += 1
            prev = r
    assert tp.trades(tape, (0, 1e9)).count() == n


def orders_for(days, rng, per_day=60):
    out = []
    for d, rows in days.items():
        for k in range(per_day):
            i = rng.randrange(0, len(rows) - 1)
            s = rng.choice([1, -1])
            best = rows[i]["bids" if s > 0 else "asks"][0][0]
            out.append(dict(day=d, ticker="X", order=f"{k}", place_seq=i, side=s, price=best - s * 100 * rng.choice([0, 0, 0, 1, 3, -1]),
                            size=rng.choice([1, 100, 250, 0]), max_wait=rng.choice([0.0, 0.25, 5.0, 30.0, 1e6])))
    return out


@pytest.mark.parametrize("width", [2.0, 1000.0])
def test_fills_match_a_sequential_replay(spark, tape, days, width):
    orders = orders_for(days, random.Random(int(width)))
    df = spark.createDataFrame([tuple(o.values()) for o in orders], "day string, ticker string, order string, place_seq long, side int, price long, size long, max_wait double")
    got = {(r["day"], r["order"], r["model"]): r for r in fills.simulate(tape, df, fills.ALL_MODELS, width=width, slot=50.0).collect()}
    assert len(got) == 4 * len(orders)
    seen = set()
    for o in orders:
        for m in fills.ALL_MODELS:
            r = got[(o["day"], o["order"], m)]
            qty, fill, end, when, why, queue = replay(days[o["day"]], o, m)
            assert (r["filled_qty"], r["fill_seq"], r["end_seq"], r["end_reason"], r["queue_ahead"]) == (qty, fill, end, why, queue), (o, m)
            assert r["end_time"] == pytest.approx(when)
            seen.add(why)
    assert {"filled", "timeout", "rejected"} <= seen


def test_fill_models_nest(spark, tape, days):
    orders = orders_for(days, random.Random(3))
    df = spark.createDataFrame([tuple(o.values()) for o in orders], "day string, ticker string, order string, place_seq long, side int, price long, size long, max_wait double")
    q = fills.simulate(tape, df, width=5.0).groupBy("day", "order").pivot("model", list(fills.MODELS)).agg(F.first("filled_qty"))
    assert q.where("through > fifo or fifo > touch").count() == 0


def test_bad_orders_raise(spark, tape):
    df = spark.createDataFrame([("2024-01-01", "X", "a", 3, 2, 9900, 1, 1.0)], "day string, ticker string, order string, place_seq long, side int, price long, size long, max_wait double")
    with pytest.raises(Exception, match="side must be"):
        fills.simulate(tape, df).collect()
    with pytest.raises(ValueError, match="unknown fill model"):
        fills.check_orders(df, ("best",))


def test_latency_keeps_the_decision_price(spark, tape):
    o = fills.sample_orders(tape, 20.0, 10.0, 100, 20.0, (0.0, 200.0), (0.0, 1.0))
    p = o.groupBy("day", "decision_time", "side").agg(F.countDistinct("price").alias("n"), F.count(F.lit(1)).alias("k"))
    assert p.where("n <> 1").count() == 0
    assert o.where("latency > 0").count() > 0


def test_block_bootstrap_covers_the_mean(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(1, float(i), float(v)) for i, v in enumerate(rng.normal(0.5, 1, 600))], "g int, t double, x double")
    r = drift.block_bootstrap(df, ["g"], "t", "x", 10.0, 300).first()
    assert r["lo"] < 0.5 < r["hi"] and r["hi"] - r["lo"] < 0.4


def test_logistic_matches_newton(spark):
    rng = np.random.default_rng(2)
    x = rng.choice(np.linspace(-1, 1, 21), 800)
    y = (rng.random(800) < 1 / (1 + np.exp(-(0.3 + 1.7 * x)))).astype(int)
    df = spark.createDataFrame([(1, float(a), int(b)) for a, b in zip(x, y)], "g int, x double, y int")
    r = signals.fit_logistic(df, ["g"], "x", "y").first()
    b = np.zeros(2)
    X = np.column_stack([np.ones(800), x])
    for _ in range(30):
        p = 1 / (1 + np.exp(-X @ b))
        b += np.linalg.solve(X.T @ (X * (p * (1 - p))[:, None]), X.T @ (y - p))
    assert [r["intercept"], r["coef"]] == pytest.approx(b.tolist(), abs=1e-8)

import datetime as dt

import numpy as np
import pytest

from tapeworks.operators import lifecycle as lc
from tapeworks.streaming import jobs

HOUR = 3600


def batches(spark, path, rows, schema, cuts):
    """Rows as files that a stream reads one at a time, in this order."""
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.parquet(f"{path}/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def run(stream, at):
    q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return q, stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/out")


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, jobs.ROCKS)
    yield
    spark.conf.unset(key)


def test_cool_down_carries_and_forgets_state(spark, rocks, tmp_path):
    rng = np.random.default_rng(2)
    rows = sorted((int(i % 5), float(t), float(np.round(0.3 + 0.01 * rng.integers(0, 4), 2))) for i, t in enumerate(rng.uniform(0, 200 * HOUR, 240)))
    rows = sorted(rows, key=lambda r: r[1])
    rows += [(99, rows[-1][1] + 400 * HOUR, 0.3)]  # lets the watermark pass all others
    start = dt.datetime(2026, 1, 1)
    data = [(c, start + dt.timedelta(seconds=t), p, 0.3) for c, t, p in rows] + [(98, start + dt.timedelta(seconds=rows[-1][1] + 1), 0.3, 0.3)]
    src = batches(spark, str(tmp_path / "in"), data, "contract_id long, ts timestamp, p double, ask double", (60, 120, 180, 241))
    q, out = run(jobs.cool_down(src, hours=12, move=0.02), str(tmp_path / "q"))
    got = sorted((r["contract_id"], r["ts"]) for r in out.collect())
    want, last = [], {}
    for c, ts, p, _ in data:
        if c not in last or (ts - last[c][0]).total_seconds() > 12 * HOUR or abs(p - last[c][1]) >= 0.02:
            last[c] = (ts, p)
            want.append((c, ts))
    assert got == sorted(want)
    ran = [p for p in q.recentProgress if p["numInputRows"]]
    assert len(ran) >= 5 and q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] < max(p["stateOperators"][0]["numRowsTotal"] for p in ran)


def test_flow_events_over_batches_equal_one(spark, rocks, tmp_path):
    rng = np.random.default_rng(3)
    start = dt.datetime(2026, 1, 1)
    rows = [(int(i % 3), i, start + dt.timedelta(seconds=i), int(100 + rng.integers(0, 3)), int(rng.integers(1, 9)), int(104 + rng.integers(0, 3)), int(rng.integers(1, 9))) for i in range(90)]
    schema = "ticker long, seq long, ts timestamp, bid_price long, bid_size long, ask_price long, ask_size long"
    _, one = run(jobs.flow_events(batches(spark, str(tmp_path / "a"), rows, schema, ())), str(tmp_path / "qa"))
    q, many = run(jobs.flow_events(batches(spark, str(tmp_path / "b"), rows, schema, (20, 50, 70))), str(tmp_path / "qb"))
    assert sum(p["numInputRows"] > 0 for p in q.recentProgress) == 4
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect())) and many.count() == 90


def test_flow_events_of_a_ticker_are_cut_into_runs(spark, rocks, tmp_path):
    """Whatever the length of a run, across micro-batches too, flows are those of the whole series."""
    rng = np.random.default_rng(5)
    start = dt.datetime(2026, 1, 1)
    rows = [(int(i % 2), i, start + dt.timedelta(seconds=i), int(100 + rng.integers(0, 3)), int(rng.integers(1, 9)), int(104 + rng.integers(0, 3)), int(rng.integers(1, 9))) for i in range(80)]
    schema = "ticker long, seq long, ts timestamp, bid_price long, bid_size long, ask_price long, ask_size long"
    want, last = [], {}
    for t, _, ts, b, bs, a, as_ in rows:
        pb, pbs, pa, pas = last.get(t, (None,) * 4)
        want.append((t, ts, 0.0 if pb is None else float(bs * (b >= pb) - pbs * (b <= pb) - as_ * (a <= pa) + pas * (a >= pa))))
        last[t] = (b, bs, a, as_)
    _, got = run(jobs.flow_events(batches(spark, str(tmp_path / "a"), rows, schema, (25, 60)), run=7), str(tmp_path / "qa"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_quote_intake_over_batches_equals_one(spark, tmp_path):
    """Later quotes replace earlier ones of their source and id; contracts without a new quote keep their pooled row."""
    rng = np.random.default_rng(4)
    start = dt.datetime(2026, 1, 1)
    rows = [(("kalshi", "polymarket")[int(i % 2)], int(rng.integers(0, 12)) if i < 90 else 3, start + dt.timedelta(hours=int(rng.integers(0, 9))), float(np.round(rng.uniform(0.1, 0.9), 2)), "market", 1e4, 1e3, 5, None, None) for i in range(100)]
    schema = "source string, quote_id long, ts timestamp, p double, kind string, liquidity double, volume_24h double, n int, bid double, ask double"
    books = spark.createDataFrame([(c, 0.4, 0.02) for c in range(6)], "contract_id long, mid double, spread double")
    maps = spark.createDataFrame([(s, q, q % 7, q % 2 == 0) for s in ("kalshi", "polymarket") for q in range(12)], "source string, quote_id long, contract_id long, invert boolean")
    got = []
    for name, cuts in (("a", ()), ("b", (30, 60, 90))):
        src, out = batches(spark, str(tmp_path / name), rows, schema, cuts), str(tmp_path / f"{name}-out")
        jobs.intake(src, books, maps, out).awaitTermination()
        table = jobs.newest(spark, jobs.pooled_table(out, books, src, maps))
        got.append(sorted((r["contract_id"], round(r["p"], 9), round(r["lo"], 9), round(r["hi"], 9), r["n_refs"]) for r in table.collect()))
        assert (tmp_path / f"{name}-out/quotes/manifest/{len(cuts)}/_SUCCESS").exists()
        assert jobs.newest(spark, jobs.quote_table(out, src)).count() == len({(r[0], r[1]) for r in rows})
    assert got[0] == got[1] and len(got[0]) == 6


def test_bucketed_table_writes_what_a_batch_touches(spark, tmp_path):
    """A batch writes its buckets only, can be run again, and versions that nothing names are gone."""
    table = jobs.Buckets(str(tmp_path / "t"), ["k"], spark.createDataFrame([], "k long, v long").schema, parts=8)
    frame = lambda rows: spark.createDataFrame(rows, "k long, v long")
    versions = lambda: sorted((int(p.parent.name), int(p.name)) for p in (tmp_path / "t").glob("[0-9]*/[0-9]*"))
    first = frame([(k, 0) for k in range(200)])
    table.put(spark, 0, table.touched(first), first)
    assert versions() == [(b, 0) for b in range(8)] and table.read(spark, 0).count() == 200
    for number in (1, 2, 2, 3):  # batch 2 is run again
        new = frame([(7, number)])
        hit = table.touched(new)
        before = table.read(spark, number - 1, hit)
        table.put(spark, number, hit, before.where("k <> 7").unionByName(new))
        assert {(r["k"], r["v"]) for r in table.read(spark, number).collect()} == {(k, number if k == 7 else 0) for k in range(200)}
        assert len(versions()) == 9  # the bucket in its last two versions, the others in one
    assert jobs.newest(spark, table).where("k = 7").first()["v"] == 3


def test_order_audit_over_batches_equals_the_batch_operator(spark, rocks, tmp_path):
    """Unmatched references over five micro-batches and three days; orders never used up are forgotten after the close."""
    rng = np.random.default_rng(6)
    rows, start = [], dt.date(2024, 1, 2)
    for day in range(3):
        live = []
        for i in range(80):
            msg = str(rng.choice(list("AAAAEXDU"))) if live else "A"
            ref = int(rng.choice(live[-12:])) if live and msg != "A" else 1000 * day + i
            if rng.random() < 0.1:
                ref = 10**6 + i
            live += [1000 * day + i] if msg in "AU" else []
            rows.append((start + dt.timedelta(days=day), "X", 1000 * day + i, int(34_200 + 10 * i) * 10**9, msg, ref, 1000 * day + i if msg == "U" else None, "B", int(rng.integers(1, 4)) * 100, 10000, None))
    rows.append((start + dt.timedelta(days=9), "X", 99_999, 0, "A", 99_999, None, "B", 100, 10000, None))  # lets the watermark pass all others
    rows.append((start + dt.timedelta(days=9), "X", 99_999 + 1, 0, "A", 99_999 + 1, None, "B", 100, 10000, None))
    schema = "day date, ticker string, seq long, ts_ns long, msg string, ref long, new_ref long, side string, shares long, price long, state string"
    src = batches(spark, str(tmp_path / "in"), rows, schema, (50, 100, 170, 241))
    q, out = run(jobs.order_audit(lc.order_steps(src)), str(tmp_path / "q"))
    life = lc.lifetimes(spark.createDataFrame(rows, schema))
    want = sorted((r["day"], r["ref"], r["seq"], r["msg"]) for r in life.where("not starts and not matched").collect())
    assert sorted(map(tuple, out.collect())) == want and len(want) > 20
    ran = [p for p in q.recentProgress if p["numInputRows"]]
    assert len(ran) == 5 and max(p["stateOperators"][0]["numRowsTotal"] for p in ran) > 20
    assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 6  # two orders and their timers are left


def test_order_audit_keeps_state_by_bucket(spark, rocks, tmp_path):
    """Many open orders of a day are a bounded number of states and timers, and are still there for the next batch."""
    day, n = dt.date(2024, 1, 2), 3000
    rows = [(day, "X", i, 34_200 * 10**9 + i, "A", i, None, "B", 100, 10000, None) for i in range(n)]
    rows += [(day, "X", n + i, 34_300 * 10**9 + i, "E", i, None, "B", 60, 10000, None) for i in range(n)] + [(day, "X", 2 * n + i, 34_400 * 10**9 + i, "E", i, None, "B", 60, 10000, None) for i in range(10)]
    rows += [(day, "X", 3 * n, 34_500 * 10**9, "E", 5, None, "B", 60, 10000, None)]
    schema = "day date, ticker string, seq long, ts_ns long, msg string, ref long, new_ref long, side string, shares long, price long, state string"
    src = batches(spark, str(tmp_path / "in"), rows, schema, (n, 2 * n, 2 * n + 10))
    q, out = run(jobs.order_audit(lc.order_steps(src)), str(tmp_path / "q"))
    assert sorted(map(tuple, out.collect())) == [(day, 5, 3 * n, "E")]
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["numInputRows"]) <= 4 * jobs.BUCKETS < n


def test_cool_down_keeps_state_by_bucket(spark, rocks, tmp_path):
    """Many contracts are a bounded number of states and timers; what went out holds back in the next batch."""
    n, at = 6000, dt.datetime(2026, 1, 1)
    rows = [(c, at, 0.3, 0.3) for c in range(n)] + [(c, at + dt.timedelta(minutes=5), 0.3, 0.3) for c in range(n)] + [(7, at + dt.timedelta(minutes=6), 0.9, 0.3)]
    src = batches(spark, str(tmp_path / "in"), rows, "contract_id long, ts timestamp, p double, ask double", (n, 2 * n))
    q, out = run(jobs.cool_down(src, hours=12, move=0.02), str(tmp_path / "q"))
    assert sorted((r["contract_id"], r["ts"]) for r in out.collect()) == sorted([(c, at) for c in range(n)] + [(7, rows[-1][1])])
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["numInputRows"]) <= 4 * jobs.CONTRACTS < n

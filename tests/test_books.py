import random

import pytest
from pyspark.sql import functions as F

from tapeworks.operators import lifecycle as lc
from tapeworks.operators import tape as tp
from tapeworks.sources import market

EVENTS = "day string, ticker string, seq long, ts_ns long, msg string, ref long, new_ref long, side string, shares long, price long, state string"


def random_feed(seed: int, n: int = 500):
    rng = random.Random(seed)
    rows, refs = [], []
    for i in range(n):
        msg = rng.choice("AAAFECXDUUPQH") if rng.random() < 0.97 else "E"
        ref = rng.choice(refs[-15:]) if refs and rng.random() < 0.9 else 10**6 + i
        new = i if msg == "U" else None
        if msg in "AF":
            ref = i
        if msg in "AFU":
            refs.append(i)
        rows.append(("2024-01-02", "X", i, i * 10**9, msg, ref, new, rng.choice("BS"), rng.choice([0, 100]) if msg == "Q" else rng.choice([100, 200, 300]),
                     rng.choice([9900, 10000, 10100]), rng.choice("HTP") if msg == "H" else None))
    return rows


def walk(rows):
    """Sequential conversion: message rows and the displayed levels after each."""
    live, depth, out, bad = {}, {}, [], 0

    def put(step, typ, ref, size, price, side):
        if typ in (1, 2, 3, 4):
            k = (side, price)
            depth[k] = depth.get(k, 0) + (size if typ == 1 else -size)
        best = lambda s: (max if s > 0 else min)([p for (d, p), q in depth.items() if d == s and q > 0], default=-s * 9_999_999_999)
        out.append((step, typ, ref, size, price, side, best(1), best(-1)))

    for day, tk, seq, ts, msg, ref, new, side, shares, price, state in rows:
        s = 1 if side == "B" else -1
        if msg in "AF":
            live[ref] = [s, price, shares]
            put(2 * seq, 1, ref, shares, price, s)
        elif msg in "ECXDU":
            if ref not in live:
                bad += 1
                continue
            d, p, left = live[ref]
            take = left if msg in "DU" else min(shares, left)
            if take == left:
                del live[ref]
            else:
                live[ref][2] -= take
            put(2 * seq, 4 if msg in "EC" else 2 if msg == "X" and take < left else 3, ref, take, p, d)
            if msg == "U":
                live[new] = [d, price, shares]
                put(2 * seq + 1, 1, new, shares, price, d)
        elif msg == "P":
            put(2 * seq, 5, 0, shares, price, s)
        elif msg == "Q" and shares:
            put(2 * seq, 6, 0, shares, price, -1)
        elif msg == "H":
            put(2 * seq, 7, 0, 0, {"H": -1, "P": 0, "T": 1}[state], -1)
    return out, bad


@pytest.mark.parametrize("seed", [1, 2])
def test_conversion_matches_a_sequential_walk(spark, seed):
    rows = random_feed(seed)
    want, bad = walk(rows)
    df = spark.createDataFrame(rows, EVENTS)
    msgs = lc.messages(df)
    books = lc.books(msgs, 2, chunk_rows=130)
    got = [(r["step"], r["type"], r["order_id"], r["size"], r["price"], r["direction"], r["bids"][0]["price"], r["asks"][0]["price"]) for r in books.orderBy("step").collect()]
    assert got == want
    assert lc.conversion_stats(df).first()["unmatched"] == bad


@pytest.mark.parametrize("block", [256, 7])
def test_books_hold_all_levels(spark, monkeypatch, block):
    """All standing levels after every message, whatever the pieces: deep books, levels that vanish and come back."""
    monkeypatch.setattr(lc, "BOOK_BLOCK", block)
    rng = random.Random(9)
    rows, depth, want = [], {}, []
    for i in range(600):
        side, price = rng.choice([1, -1]), rng.choice(range(9000, 9400, 20))
        q = depth.get((side, price), 0)
        kind = 1 if q == 0 or rng.random() < 0.4 else rng.choice([2, 3, 4])
        size = 100 * rng.randrange(1, 5) if kind == 1 else q if rng.random() < 0.6 else rng.randrange(1, q + 1)
        if rng.random() < 0.1:
            kind, size = 5, 50
        if kind != 5:
            depth[side, price] = q + (size if kind == 1 else -size)
        rows.append(("2024-01-02", "X", 2 * i, i * 10**9, kind, i, size, price, side))
        best = lambda s: [(p, x) for p, x in sorted(((p, x) for (d, p), x in depth.items() if d == s and x > 0), key=lambda e: -s * e[0])][:6]
        want.append(tuple(best(s) + [(-s * 9_999_999_999, 0)] * (6 - len(best(s))) for s in (1, -1)))
    msgs = spark.createDataFrame(rows, "day string, ticker string, step long, ts_ns long, type int, order_id long, size long, price long, direction int")
    for pieces in (90, 10**6):
        got = lc.books(msgs, 6, chunk_rows=pieces).orderBy("step").collect()
        assert [tuple([(x["price"], x["size"]) for x in r[s]] for s in ("bids", "asks")) for r in got] == want
    at = {(r["direction"], r["price"], r["from_step"]): (r["size"], r["until_step"]) for r in lc.level_intervals(msgs, chunk_rows=100).collect()}
    for i, (bids, asks) in enumerate(want):
        standing = {(d, p): s for (d, p, a), (s, b) in at.items() if a <= 2 * i and (b is None or b > 2 * i)}
        for d, levels in ((1, bids), (-1, asks)):
            assert all(standing.get((d, p)) == s for p, s in levels if s)


def test_rebuilt_book_is_consistent(spark):
    rows = lc.to_tape(lc.books(lc.messages(spark.createDataFrame(random_feed(4), EVENTS)), 10))
    r = tp.consistency_summary(tp.consistency(rows)).first()
    assert r["pass_rate"] == 1.0 and r["coverage"] == 1.0


def test_visible_rows_drop_hidden_changes(spark):
    book = lc.books(lc.messages(spark.createDataFrame(random_feed(4), EVENTS)), 1)
    few = lc.visible_rows(book, (100 * 10**9, 400 * 10**9))
    assert 0 < few.count() < book.count()
    assert few.where("ts_ns < 100000000000 or ts_ns >= 400000000000").count() == 0


def test_csv_day(spark, tmp_path):
    msg, book = tmp_path / "m.csv", tmp_path / "b.csv"
    msg.write_text("".join(f"{34200 + i / 10},1,{i},100,10000,1,extra\n" for i in range(2000)))
    book.write_text("".join(f"10100,5,10000,{i},10200,1,9900,2\n" for i in range(2000)))
    d = market.read_day_csv(spark, str(msg), str(book), "2012-06-21", "X")
    assert d.count() == 2000 and d.where("order_id <> seq or bid_size <> seq or size(bids) <> 2 or asks[1].price <> 10200").count() == 0
    out = str(tmp_path / "store")
    market.write_tape(d, out)
    assert market.load_day(spark, out, "X", "2012-06-21", 1).where("size(bids) = 1").count() == 2000
    book.write_text("10100,5,10000,1,10200,1,9900,2\n")
    with pytest.raises(ValueError, match="book rows"):
        market.read_day_csv(spark, str(msg), str(book), "2012-06-21", "X")
    book.write_text("1,2,3\n")
    with pytest.raises(ValueError, match="four columns"):
        market.read_day_csv(spark, str(msg), str(book), "2012-06-21", "X")


def test_file_dates_and_results(spark, tmp_path):
    d = spark.createDataFrame([("01302019.NASDAQ_ITCH50.gz",), ("x/S101819-v50.txt.gz",)], "n string").select(market.feed_date(F.col("n")).cast("string").alias("d"))
    assert [r["d"] for r in d.collect()] == ["2019-01-30", "2019-10-18"]
    with pytest.raises(Exception, match="no date in"):
        spark.createDataFrame([("day.gz",)], "n string").select(market.feed_date(F.col("n"))).collect()
    out = str(tmp_path / "r")
    market.save_results(spark.createDataFrame([(1 / 3, float("nan"))], "a double, b double"), out)
    r = spark.read.schema("a double, b double").json(out).first()
    assert r["a"] == 0.333333333333 and r["b"] is None
    (tmp_path / "pnl.csv").write_text("d,pnl\nx,1.5\ny,2\n")
    assert [q["pnl"] for q in market.read_pnl(spark, str(tmp_path / "pnl.csv")).collect()] == [1.5, 2.0]

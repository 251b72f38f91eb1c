import datetime
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeworks.operators import chains, linkage as lk, proposals as pr, volprem as vp
from tapeworks.sources import trials, venues


def series(spark, n=1000, seed=0, vix=16.0):
    r = np.random.default_rng(seed).normal(0, 0.01, n)
    px = 100 * np.exp(np.cumsum(r))
    return spark.createDataFrame([("s", int(i), float(p), vix, vix + 1) for i, p in enumerate(px)], "symbol string, i int, spx double, vix double, vix3m double").select(
        "symbol", F.date_add(F.lit("2000-01-03").cast("date"), F.col("i")).alias("date"), "spx", "vix", "vix3m")


def test_forecast_does_not_see_the_future(spark):
    d = series(spark)
    cut = F.lit("2002-06-01").cast("date")
    broken = d.withColumn("spx", F.when(F.col("date") > cut, F.col("spx") * (1 + F.dayofmonth("date") / 10)).otherwise(F.col("spx")))
    har = lambda x: vp.har_forecast(vp.log_returns(x), min_train=300).where(F.col("date") <= cut).select("date", "har")
    a = har(d)
    assert a.where("har is not null").count() > 300
    assert a.exceptAll(har(broken)).count() == 0


def test_forecast_equals_least_squares(spark):
    d = vp.har_forecast(vp.log_returns(series(spark)), min_train=300).orderBy("date").toPandas()
    i = 300 + 21  # the first fit; rows 22 .. i - 21 have labels that are over
    x = np.column_stack([np.ones(len(d)), d["rv_d"], d["rv_w"], d["rv_m"]])
    b, *_ = np.linalg.lstsq(x[22 : i - 20], d["rv"].to_numpy()[22 : i - 20], rcond=None)
    assert d["har"][i] == pytest.approx(max(float(x[i] @ b), 1e-6), rel=1e-6)


def test_wealth_stays_at_ruin(spark):
    d = spark.createDataFrame([("s", f"2000-01-0{i + 1}", p) for i, p in enumerate([1.0, -60.0, -60.0, 5.0])], "symbol string, date string, pnl double").withColumn("v", F.lit(0.02))
    assert [r["wealth"] for r in vp.wealth_path(d, ["symbol"], "v").orderBy("date").collect()] == pytest.approx([1.02, 0.0, 0.0, 0.0])


def test_implied_vol_inverts_the_price(spark):
    rows = [(k, kind, v) for k in (80.0, 100.0, 130.0) for kind in "CP" for v in (0.1, 0.35, 1.2)]
    d = spark.createDataFrame(rows, "strike double, kind string, vol double").withColumns({"S": F.lit(100.0), "T": F.lit(0.5), "r": F.lit(0.03), "q": F.lit(0.01)})
    p = chains.with_price(d)
    got = p.withColumn("iv", chains.implied_vol("price", "S", "strike", "T", "r", "q", "kind")).where("price > 1e-4").collect()
    assert len(got) >= 15 and all(r["iv"] == pytest.approx(r["vol"], abs=1e-6) for r in got)
    parity = p.groupBy("strike", "vol").agg((F.max(F.when(F.col("kind") == "C", F.col("price"))) - F.max(F.when(F.col("kind") == "P", F.col("price")))).alias("d")).collect()
    assert all(r["d"] == pytest.approx(100 * math.exp(-0.005) - r["strike"] * math.exp(-0.015)) for r in parity)
    low = d.withColumn("iv", chains.implied_vol(F.lit(0.0), "S", "strike", "T", "r", "q", "kind"))
    assert low.where("iv is not null").count() == 0


def test_ex_dates_avoid_the_holiday(spark):
    s = spark.createDataFrame([("SPY", "2026-01-02", "2026-12-31")], "u string, a string, b string").select("u", F.col("a").cast("date").alias("a"), F.col("b").cast("date").alias("b"))
    assert sorted(str(r["ex_date"]) for r in chains.ex_dates(s, ["u"], "a", "b").collect()) == ["2026-03-20", "2026-06-18", "2026-09-18", "2026-12-18"]


PAIRS = [
    ("Will the Fed cut rates in September?", "Will the Fed raise rates in September?", "different measure"),
    ("Will Brazil win the World Cup?", "Will Brazilian team win the World Cup?", None),
    ("Will Apple close above $250 on October 31?", "Will Apple close above $260 on October 31?", "thresholds differ"),
    ("Will Apple close above $250 on October 31?", "Will Apple close above $250 on October 30?", "dates differ"),
    ("Will Lula win in 2026?", "Will Lula win in 2030?", "years differ"),
    ("Will Madrid beat Sevilla?", "Will Madrid beat Valencia?", "entities missing"),
    ("will it rain?", "Will it rain?", "no named entity"),
]


def test_hard_rules(spark):
    d = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(PAIRS)], "id int, a string, b string")
    s = lambda c: lk.prepare(d.select("id", F.col(c).alias("text")), "text").select("id", F.struct("tok", "num", "thr", "dat", "yr", "ent").alias(c))
    got = [r["why"] for r in s("a").join(s("b"), "id").withColumn("why", lk.hard_reject()).orderBy("id").collect()]
    assert got == [w for _, _, w in PAIRS]


def test_candidates_find_the_same_question(spark):
    ts = "2026-11-05"
    c = spark.createDataFrame([(1, "Will Inácio win the Brazil election?", "No", ts)], "contract_id int, title string, name string, resolves_at string").withColumn("resolves_at", F.col("resolves_at").cast("timestamp"))
    q = spark.createDataFrame([(1, "kalshi", "Will Inacio win the Brazil election?", "Yes", "2026-11-04"), (2, "kalshi", "Will Inacio win the Chile election?", "Yes", ts),
                               (3, "own", "Will Inacio win the Brazil election?", "Yes", ts), (4, "kalshi", "Will Inacio win the Brazil election?", "Yes", "2026-09-01")],
                              "quote_id int, source string, question string, outcome string, end string").withColumn("end", F.col("end").cast("timestamp"))
    got = lk.candidates(c, q, spark.createDataFrame([("own", 3)], "source string, quote_id int")).collect()
    assert [(r["quote_id"], r["invert"]) for r in got] == [(1, True)] and got[0]["score"] > 1.0


def test_price_question(spark):
    d = spark.createDataFrame([("Will Apple (AAPL) close above $1,250.5 on Oct 31?",), ("Will nvidia finish below 90?",), ("Will it rain?",)], "title string")
    got = [(r["ticker"], r["strike"], r["above"]) for r in lk.price_questions(d).collect()]
    assert got == [("AAPL", 1250.5, True), ("NVDA", 90.0, False), (None, None, None)]


def test_price_question_words(spark):
    cases = [("Apple stock end over 1,200.5 by May", ("AAPL", 1200.5, True)), ("$XYZ below 20", ("XYZ", 20.0, False)), ("Does gold trade under $1900 in June", ("GLD", 1900.0, False)),
             ("Will Tesla shares be above 300?", ("TSLA", 300.0, True)), ("Will Nike finish HIGHER than 80", ("NKE", 80.0, True)), ("In 2026, Intel close above $50", ("INTC", 50.0, True)),
             ("Will $AB close above 5 and under 9", ("AB", 5.0, True)), ("Will an unknown firm close above 5", (None, None, None)), ("Over 20 people come", (None, None, None)),
             ("Is Apple above the rest", (None, None, None)), ("Some Firm(QQ.B) above 7.25", ("QQ.B", 7.25, True)), ("", (None, None, None)), (None, (None, None, None))]
    d = spark.createDataFrame([(i, t, "kept") for i, (t, _) in enumerate(cases)], "id int, title string, name string")
    got = [(r["ticker"], r["strike"], r["above"]) for r in lk.price_questions(d).orderBy("id").collect()]
    assert got == [w for _, w in cases]


def test_capitalised_words(spark):
    cases = [("Will Ann Lee win? The Oscars - Best Film", ["Ann", "Lee", "Oscars", "Best", "Film"]), ("How many. O'Neil's AT&T; over", ["O'Neil's", "AT&T"]), ("nothing here", []), (None, [])]
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "id int, t string")
    got = [r["c"] for r in d.select("id", lk.capitalised(F.col("t")).alias("c")).orderBy("id").collect()]
    assert got == [w for _, w in cases]


def test_cash_is_used_in_rank_order(spark):
    rng = np.random.default_rng(4)
    rows = [(1, i, float(k), float(a)) for i, (k, a) in enumerate(zip(rng.random(30), rng.uniform(0.05, 0.9, 30)))]
    c = spark.createDataFrame(rows, "account_id int, contract_id int, kelly double, best_ask double")
    acc = spark.createDataFrame([(1, 700.0, 1500.0, True)], "account_id int, cash double, equity double, in_top3 boolean")
    held = spark.createDataFrame([(1, 3, 200.0), (1, 9, 50.0)], "account_id int, contract_id int, qty double")
    got = {r["contract_id"]: r["policy_stake"] for r in pr.size(c, acc, held, max_stake=300.0).collect()}
    cash, have = 700.0, {3: 200.0, 9: 50.0}
    for _, i, k, a in sorted(rows, key=lambda r: -r[2]):
        own = have.get(i, 0.0) * a
        s = min(max(min(0.5 * k * 1500, 375.0) - own, 0.0), cash, max(300.0 - own, 0.0))
        assert got[i] == pytest.approx(s)
        cash -= s


def test_log_skips_bad_lines_loudly(spark, tmp_path):
    p = str(tmp_path / "log")
    pnl = spark.createDataFrame([("a", 1, 2.0), ("a", 2, float("nan"))], "key string, period int, pnl double")
    t = spark.createDataFrame([("a", '{"x": {"y": 1}}', "{}", "{}"), ("b", '{"x": NaN}', "{}", '{"s": "t"}')], "key string, config string, metrics string, tags string")
    trials.append(trials.log_rows(pnl, t), p)
    (tmp_path / "log" / "more.json").write_text('{"trial_id": broken\n')
    with pytest.warns(UserWarning, match="1 unreadable"):
        r = trials.records(spark, p)
    rows = {x["config"]: x for x in trials.flatten(r).join(r.select("trial_id", "config"), "trial_id").collect()}
    assert len(rows) == 2 and rows['{"x": {"y": 1}}']["entries"]["config.x.y"] == "1" and rows['{"x": {"y": 1}}']["n_obs"] == 2
    h = spark.createDataFrame([('{"b":1,"a":2}',), ('{"a":2, "b":1}',), ('{"a":2,"b":1.0}',)], "c string").select(trials.config_hash(F.col("c")).alias("h")).collect()
    assert h[0]["h"] == h[1]["h"] != h[2]["h"]


def test_journal_and_references(spark, tmp_path):
    f = tmp_path / "j.csv"
    f.write_text("date,market,category,side,p_belief,price_q,kelly_fraction,stake,bankroll_before,rationale,outcome\n2026-01-01,m,x,yes,0.6,0.5,0.2,10,100,why,\n")
    r = venues.journal(spark, str(f)).first()
    assert r["side"] == "YES" and r["outcome"] is None and r["stake"] == 10.0
    b = tmp_path / "refs.json"
    b.write_text('[{"contract_id": "c", "id": "1", "question": "Q", "p": 0.4}]')
    r = venues.bundled(spark, str(b)).first()
    assert (r["source"], r["outcome"], r["kind"], r["p"]) == ("static", "Yes", "market", 0.4)
    with pytest.raises(Exception, match="probability or a percent"):
        spark.range(1).select(venues.as_prob(F.lit(0.0))).collect()


def test_name_pairs_lose_no_match(spark):
    """The blocking finds every pair that the hard rules let through and that shares a word, as an all-pairs comparison does."""
    texts = ["Will Acme Corp close above 90 in 2026?", "Acme Corp to win the award", "Will Bravo win the Acme award in 2026?", "Who wins the election in Freedonia", "Freedonian election: who wins",
             "the rain in may", "Will Acme and Bravo merge?", "Bravo and Acme merge", "Will the Fed cut rates?", "Fed to cut rates", "Fed rates"]
    d = lk.prepare(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "text").drop("text").cache()
    q, p = d.withColumnRenamed("id", "q"), d.withColumnRenamed("id", "p")
    got = {tuple(r) for r in lk.name_pairs(q, p, "q", "p").collect()}
    every = q.select("q", F.struct(*[c for c in d.columns if c != "id"]).alias("a")).crossJoin(p.select("p", F.struct(*[c for c in d.columns if c != "id"]).alias("b")))
    want = {(r["q"], r["p"]) for r in every.where(lk.hard_reject().isNull() & F.arrays_overlap("a.tok", "b.tok")).collect()}
    assert want and want <= got


def word_pool(seed, n, vocabulary=60):
    draw = random.Random(seed)
    return [(i, sorted({f"w{int(draw.paretovariate(0.7)) % vocabulary}" for _ in range(draw.randrange(0, 14))})) for i in range(n)]


@pytest.mark.parametrize("share", [None, 0.2])
def test_shared_information_top_k_equals_brute_force(spark, monkeypatch, share):
    monkeypatch.setattr(lk, "FIRST_STAGE", 1)
    monkeypatch.setattr(lk, "STAGE_GROWTH", 2)
    pool, asked = word_pool(1, 300), word_pool(2, 25)
    df = Counter(t for _, ws in pool for t in ws)
    w = {t: round(math.log(len(pool) / c) * 1e6) for t, c in df.items() if share is None or c <= share * len(pool)}
    want = set()
    for q, ws in asked:
        sums = sorted(((-sum(w.get(t, 0) for t in set(ws) & set(p)), i) for i, p in pool if any(w.get(t, 0) > 0 for t in set(ws) & set(p))))[:7]
        want |= {(q, i, -s) for s, i in sums}
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, tok array<string>")
    got = lk.shared_information(frame(asked, "q"), frame(pool, "p"), "q", "p", 7, share)
    assert {(r["q"], r["p"], round(r["info"] * 1e6)) for r in got.collect()} == want
    assert lk.shared_information(frame(asked, "q"), frame(pool[:0], "p"), "q", "p", 7).count() == 0


def test_shared_information_leaves_common_lists_unread(spark, monkeypatch):
    """Texts of a rare word fill the top; the list of the word that nearly all texts hold is only looked up for them."""
    monkeypatch.setattr(lk, "FIRST_STAGE", 1)
    read = []
    joined = lk.stored
    monkeypatch.setattr(lk, "stored", lambda df: read.append(joined(df)) or read[-1])
    pool = spark.range(5000).selectExpr("id as p", "case when id % 500 = 0 then array('all', 'rare') when id = 7 then array('rare') else array('all') end as tok")
    got = lk.shared_information(spark.createDataFrame([(1, ["all", "rare"])], "q long, tok array<string>"), pool, "q", "p", 5)
    assert [r["p"] for r in got.orderBy("p").collect()] == [0, 500, 1000, 1500, 2000]
    assert max(d.count() for d in read if "info" in d.columns) == 11


def words_of(text):
    return sorted(set(text.split()))


@pytest.mark.parametrize("threshold", [0.4, 0.65, 0.9])
def test_similar_pairs_equal_brute_force(spark, threshold):
    draw = random.Random(5)
    texts = []
    for i in range(60):
        base = draw.choice(texts).split() if texts and draw.random() < 0.6 else [f"x{draw.randrange(80)}" for _ in range(draw.randrange(1, 15))]
        for _ in range(draw.randrange(0, 4)):
            base[draw.randrange(len(base))] = f"x{draw.randrange(80)}"
        texts.append(" ".join(base))
    texts += ["", None, "x1 x2"]
    rows = [(i, t, words_of(t or "")) for i, t in enumerate(texts)]
    first = {}
    for i, t, _ in rows:
        if t is not None:
            first.setdefault(t, i)

    def grams(t):
        x = f"  {t} "
        return Counter(x[i : i + 3] for i in range(len(x) - 2))

    def similarity(a, b):
        u, v, x, y = set(a.split()), set(b.split()), grams(a), grams(b)
        norm = lambda g: math.sqrt(sum(c * c for c in g.values()))
        return 0.7 * len(u & v) / max(len(u | v), 1) + 0.3 * sum(c * y[g] for g, c in x.items()) / (norm(x) * norm(y))

    reps = sorted(first.items(), key=lambda e: e[1])
    want = {(i, j): similarity(s, t) for s, i in reps for t, j in reps if i < j and similarity(s, t) >= threshold}
    want |= {(first[t], i): 1.0 for i, t, _ in rows if t is not None and first[t] != i}
    got = lk.similar_pairs(spark.createDataFrame(rows, "id long, text string, tok array<string>"), "id", threshold).collect()
    assert {(r["x"], r["y"]): pytest.approx(r["similarity"]) for r in got} == want and len(got) == len(want)
    with pytest.raises(ValueError, match="above 0.3"):
        lk.similar_pairs(spark.createDataFrame(rows, "id long, text string, tok array<string>"), "id", 0.3)


def test_references_of_all_kinds_in_one_ranking(spark):
    """Text, price and earnings references of a contract stand in one list; bundled ones stand alone; excluded ones are gone."""
    d = lambda x: F.lit(x).cast("date")
    contracts = spark.createDataFrame([(1, "Will Apple close above $105 by March?", "Yes"), (2, "Will Apple beat earnings estimates and close above $105", "No"), (3, "Will Zebra Corp win the Gold Award?", "Yes"), (4, "Will Zebra Corp win the Gold Award?", "Yes"), (5, "Will Apple close above $105", "No")],
                                      "contract_id long, title string, name string").withColumns({"asof": d("2026-01-05"), "resolves_at": F.lit("2026-02-20").cast("timestamp")})
    quotes = spark.createDataFrame([(10, "kalshi", "Will Zebra Corp win the Gold Award?", "Yes"), (11, "kalshi", "Zebra Corp to win the Gold Award", "Yes"), (12, "polymarket", "Will Apple close above $105 by March?", "Yes"), (13, "kalshi", "Will it rain?", "Yes")],
                                   "quote_id long, source string, question string, outcome string").withColumn("end", F.lit("2026-02-20").cast("timestamp"))
    calls = spark.createDataFrame([("AAPL", "C", k, max(100 - k, 0) + 3.0, max(100 - k, 0) + 3.2) for k in (90.0, 100.0, 110.0, 120.0)], "ticker string, kind string, strike double, bid double, ask double").withColumn("expiry", d("2026-03-20"))
    reports = spark.createDataFrame([("AAPL", i, 1.0, 1.5) for i in range(12)], "ticker string, date int, estimate double, reported double")
    got = lk.references(contracts, quotes, calls, reports, exclude=quotes.where("quote_id = 11"), bundled=spark.createDataFrame([(4, 99)], "contract_id long, quote_id long"), k=2)
    rows = {}
    for r in got.orderBy("contract_id", "place").collect():
        rows.setdefault(r["contract_id"], []).append((r["kind"], r["quote_id"]))
    assert rows[4] == [("bundled", 99)] and rows[3] == [("text", 10)]
    assert rows[1][0] == ("text", 12) and ("price", None) in rows[1] and len(rows[1]) == 2
    assert ("earnings", None) in rows[2] and ("price", None) in rows[5]
    built = {(r["contract_id"], r["kind"]): r for r in got.where("p is not null").collect()}
    assert built[2, "earnings"]["invert"] and not built[1, "price"]["invert"] and built[5, "price"]["invert"] and 0 < built[1, "price"]["p"] < 1
    alone = lk.price_references(contracts, calls).where("contract_id = 1").first()
    assert built[1, "price"]["p"] == alone["p"] and built[1, "price"]["why"] == alone["why"]


def test_numbers_and_dates_in_titles(spark):
    """Prices, fractions and thousands are thresholds; years and days of a month are not; the verb may is no month."""
    cases = {
        "Above $1,000.50 by March 5th, 2026?": (["1000.5"], ["3-5"]), "it may rain, May 3 or Sept. 22nd": ([], ["5-3", "9-22"]), "a5 b.6 7.8.9 x,4": (["4", "7.8"], []),
        "MAY and june": ([], ["5-", "6-"]), "3rd of July": (["3"], ["7-"]), "Jan 2 and Jan 2, then 2": ([], ["1-2"]), "Dec 300": (["300"], ["12-"]), "mid-March 7.50%": (["7.5"], ["3-7"]), "": ([], []),
    }
    d = spark.createDataFrame([(k,) for k in cases], "t string").select("t", lk.thresholds(F.col("t")).alias("thr"), lk.dates(F.col("t")).alias("dat"))
    assert {r["t"]: (r["thr"], r["dat"]) for r in d.collect()} == cases


def test_questions_do_not_meet_a_whole_expiry(spark):
    """Brackets by brute force, several calls at a strike among them; a question is joined with its own strike, not with all of an expiry."""
    rng = random.Random(21)
    day = lambda k: datetime.date(2026, 1, 5) + datetime.timedelta(k)
    listed = [("u", "C", day(e), float(rng.randint(90, 110)), rng.choice([0.0, 1.0, 2.0]), rng.choice([2.0, 3.0])) for e in (7, 30) for _ in range(25)]
    asked = [(i, "u", day(0), day(rng.randint(1, 35)), rng.randint(176, 224) / 2) for i in range(120)]
    calls = spark.createDataFrame(listed, "underlying string, kind string, expiry date, strike double, bid double, ask double")
    out = chains.digital_from_calls(spark.createDataFrame(asked, "question_id long, underlying string, asof date, when date, strike double"), calls)
    want = {}
    for i, _, asof, when, k in asked:
        after = [x for x in listed if x[4] > 0 and x[2] >= when]
        same = [x[3:] for x in after if x[2] == min(y[2] for y in after)]
        low, high = [x for x in same if x[0] < k], [x for x in same if x[0] > k]
        if low and high:
            (kl, bl, al), (kh, bh, ah) = max(low), min(high)
            e = min(y[2] for y in after)
            m = math.exp(0.04 * (e - asof).days / 365) / (kh - kl)
            want[i] = (e, *(min(max(v, 0.005), 0.995) for v in (m * ((bl + al) - (bh + ah)) / 2, m * (bl - ah), m * (al - bh))))
    got = {r["question_id"]: (r["expiry"], r["p"], r["lo"], r["hi"]) for r in out.collect()}
    assert got.keys() == want.keys() and len(want) > 60
    assert all(got[i][0] == want[i][0] and got[i][1:] == pytest.approx(want[i][1:]) for i in want)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any(ln.lstrip(" :+-").startswith("Aggregate") and "question_id" in ln and "max(" in ln for ln in plan.splitlines())


def test_copies_are_matched_once_and_pairs_far_apart_are_not_written(spark):
    """Copies of quotes and contracts get what comparing all rows gives; quotes that share only the name are no pairs."""
    ask = "Will Zorba win the long northern race"
    at = datetime.datetime(2026, 6, 30)
    quotes = [(i, "s", ask + "?", "No", at) for i in range(40)] + [(100 + i, "s", f"Zorba eats {' '.join(f'dish{i}x{j}' for j in range(9))}", "No", at) for i in range(60)]
    contracts = [(i, ask, "Yes", at) for i in (7, 8, 9)]
    q = spark.createDataFrame(quotes, "quote_id long, source string, question string, outcome string, end timestamp")
    c = spark.createDataFrame(contracts, "contract_id long, title string, name string, resolves_at timestamp")
    got = lk.candidates(c, q, k=3)
    assert sorted((r["contract_id"], r["quote_id"], r["invert"]) for r in got.collect()) == [(i, j, True) for i in (7, 8, 9) for j in (0, 1, 2)]
    prepared = lk.prepare(q.withColumn("text", lk.quote_text()), "text"), lk.prepare(c.withColumn("text", lk.contract_text()), "text")
    pairs = lk.name_pairs(prepared[1], prepared[0], "contract_id", "quote_id")
    assert {r["quote_id"] for r in pairs.collect()} == set(range(40))


def test_block_candidates_are_all_documents_that_share_a_word(spark):
    """No best few of a query and no word too common to count: every pair, with the information of all its shared words."""
    from tapeworks.plans import match_queries as mq
    from tapeworks.plans.registry import QUERIES
    from tests.conftest import SF

    words = lambda name, key: {r["id"]: set(r["tok"]) for r in mq.lk.with_tokens(mq.texts(spark, SF, name, key), "text").collect()}
    asked, pool = words("benchmark", "item_id"), words("documents", "doc_id")
    df = Counter(w for t in pool.values() for w in t)
    want = {(q, p): sum(round(math.log(len(pool) / df[w]) * 1e6) for w in a & t) / 1e6 for q, a in asked.items() for p, t in pool.items() if a & t}
    got = {(r["q"], r["p"]): r["info"] for r in QUERIES["block_candidates"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-3 for k in want)
    assert max(df.values()) > 0.2 * len(pool)


def test_few_pairs_are_compared_and_none_is_lost(spark):
    """Texts that share some rarer words, but fewer than they must, are no candidates."""
    draw = random.Random(8)
    sets = [sorted(draw.sample(range(2000), 60)) for _ in range(120)]
    sets += [sorted(set(s[:50]) | set(draw.sample(range(2000), 12))) for s in sets[:15]]
    df = Counter(w for s in sets for w in s)
    rows = [(i, len(s), sorted((w for w in s if df[w] > 1), key=lambda w: (df[w], w))) for i, s in enumerate(sets)]
    got = {(r["x"], r["y"]) for r in lk.pairs_to_compare(spark.createDataFrame(rows, "x long, n int, ids array<long>"), 0.5).collect()}
    want = {(i, j) for j in range(len(sets)) for i in range(j) if len(set(sets[i]) & set(sets[j])) >= 0.5 * len(set(sets[i]) | set(sets[j]))}
    assert len(want) >= 15 and want <= got and len(got) <= 2 * len(want)


def test_folding_needs_no_python_and_equals_nfkd(spark):
    texts = ["café", "½ price… ﬁne №5", "72° in Ünter", "é ẛ̣ 𝐀𝟙 한글 ß漢", "plain", "", None, *("a" + chr(c) + "b" + chr(c) for c in (*range(0xA0, 0x250), *range(0x2000, 0x2200), *range(0xFB00, 0xFB07)))]
    got = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", "text", lk.fold("text").alias("f"))
    assert "Python" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["text"], r["f"]) for r in got.collect() if r["f"] != (None if r["text"] is None else lk._ascii(r["text"]))] == []


@pytest.mark.parametrize("few", [lk.FEW_PROBES, 0])
def test_quotes_that_no_contract_can_match_are_not_written(spark, monkeypatch, few):
    """Only quotes near to a contract leave the place where they are read, whether or not the probes go to all tasks; excluded and equal ones count as before."""
    monkeypatch.setattr(lk, "FEW_PROBES", few)
    held, written = lk.stored, []
    monkeypatch.setattr(lk, "stored", lambda df: written.append(held(df)) or written[-1])
    at = datetime.datetime(2026, 6, 30)
    ask, generic = "Will Zorba win the long northern race", "Will the Federal Party win the Election"
    quotes = [(i, "s", ask, "No", at) for i in range(6)] + [(10, "s", generic, "Yes", at), (11, "s", None, "Yes", at)]
    quotes += [(100 + i, "s", f"Zorba eats {' '.join(f'dish{i}x{j}' for j in range(9))} and pays {i}", "No", at) for i in range(80)]
    quotes += [(200 + i, "s", f"Village {i} sleeps", "No", at) for i in range(80)]
    q = spark.createDataFrame(quotes, "quote_id long, source string, question string, outcome string, end timestamp")
    c = spark.createDataFrame([(1, ask + "?", "Yes", at), (2, generic, "Yes", at), (3, ask, "Yes", at)], "contract_id long, title string, name string, resolves_at timestamp")
    bundled = spark.createDataFrame([(3, 77)], "contract_id long, quote_id long")
    got = lk.candidates(c, q, q.where("quote_id in (0, 2)"), bundled, k=3)
    assert sorted((r["contract_id"], r["quote_id"]) for r in got.collect()) == [(1, 1), (1, 3), (1, 4), (2, 10), (3, 77)]
    assert max(d.count() for d in written if "quote_id" in d.columns) <= 7


@pytest.mark.parametrize("piece, most", [(lk.PIECE, lk.MOST_MET), (300, 50)])
def test_pairs_of_sets_are_counted_in_pieces(spark, monkeypatch, piece, most):
    """However small the pieces, the pairs are those of brute force with their Jaccard; no other pair is written. Sets that come twice and sets without a key change nothing."""
    monkeypatch.setattr(lk, "PIECE", piece)
    monkeypatch.setattr(lk, "MOST_MET", most)
    held, written = lk.stored, []
    monkeypatch.setattr(lk, "stored", lambda df: written.append(held(df)) or written[-1])
    draw = random.Random(3)
    sets = [sorted(draw.sample(range(400), draw.choice([2, 12, 30, 30]))) for _ in range(80)]
    sets += [sorted(set(s[: len(s) * 3 // 4]) | set(draw.sample(range(400), 2))) for s in sets[:40]] + [[], sets[5]]
    df = Counter(w for s in sets for w in s)
    rows = [(f"k{i:03d}", len(s), sorted((w for w in s if df[w] > 1), key=lambda w: (df[w], w))) for i, s in enumerate(sets)]
    frame = spark.createDataFrame([*rows, rows[0], (None, *rows[1][1:])], "x string, n int, ids array<long>")
    got = lk.pairs_to_compare(frame, 0.5).collect()
    jaccard = lambda a, b: len(set(a) & set(b)) / max(len(set(a) | set(b)), 1)
    want = {(f"k{i:03d}", f"k{k:03d}"): jaccard(sets[i], sets[k]) for k in range(len(sets)) for i in range(k) if jaccard(sets[i], sets[k]) >= 0.5}
    assert {(r["x"], r["y"]): r["_j"] for r in got} == want and len(got) == len(want) > 30
    assert (len(written) > 5) == (piece == 300)


def test_words_with_one_hash_are_told_apart(spark, monkeypatch):
    """Where two words have the same hash, another one is taken for all."""
    real, asked = lk.F.xxhash64, []

    def clash(seed, *more):
        asked.append(seed)
        return F.lit(1).cast("long") if len(asked) == 1 else real(seed, *more)

    monkeypatch.setattr(lk.F, "xxhash64", clash)
    h, seed = lk.word_hashes(spark.createDataFrame([("a",), ("b",), ("a",)], "word string"))
    assert seed == 1 and sorted(r["df"] for r in h.collect()) == [1, 2]


def test_grams_are_written_once_a_text(spark, monkeypatch):
    """Cosines of many pairs of few texts, in small pieces, by brute force; a table of grams has a row a text, not a row a pair."""
    monkeypatch.setattr(lk, "PIECE", 200)
    monkeypatch.setattr(lk, "MOST_MET", 100)
    held, written = lk.stored, []
    monkeypatch.setattr(lk, "stored", lambda df: written.append(held(df)) or written[-1])
    sizes = []
    monkeypatch.setattr(lk, "forget", lambda df: sizes.append((df.columns, df.count())))
    draw = random.Random(6)
    texts = [(f"t{i:02d}", " ".join(draw.choice(["Zebra", "émigré", "quick", "ox", "𐐀"]) for _ in range(draw.randrange(1, 30)))) for i in range(20)]
    pairs = [(a, b, 0.5) for i, (a, _) in enumerate(texts) for b, _ in texts[i + 1 :]]
    got = lk.pair_cosines(spark.createDataFrame(pairs, "x string, y string, _j double"), spark.createDataFrame(texts, "x string, text string"), "text").collect()
    grams = {k: Counter(x[i : i + 3] for x in [f"  {t.lower()} "] for i in range(len(x) - 2)) for k, t in texts}
    norm = lambda g: math.sqrt(sum(c * c for c in g.values()))
    want = {(a, b): sum(c * grams[b][g] for g, c in grams[a].items()) / (norm(grams[a]) * norm(grams[b])) for a, b, _ in pairs}
    assert {(r["x"], r["y"]): pytest.approx(r["cosine"]) for r in got} == want and len(got) == len(pairs)
    assert [n for c, n in sizes if "gram" in c] == [20] and len(written) > 3

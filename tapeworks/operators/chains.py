"""Option chains as tables: pricing columns, implied vols, carry, smiles, parity, digital probabilities."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tapeworks.functions.mathx import HART_DEN, HART_NUM, bind, c, div, norm_cdf, norm_pdf
from tapeworks.functions.shared import stored
from tapeworks.operators.scan import cut

TICK = 0.01
SKEW_Z = 1.0
PRIOR = (6.0, 2.0)
VOL_RANGE = (1e-6, 10.0)
YEAR_SECONDS = 365.0 * 86_400.0


def _d(spot, strike, t, r, q, vol) -> tuple[Column, Column, Column]:
    """(total vol, d1, d2) as columns; total vol is NULL where it is not positive."""
    sd = c(vol) * F.sqrt(F.greatest(c(t), F.lit(0.0)))
    sd = F.when(sd > 0, sd)
    d1 = (F.ln(c(spot) / c(strike)) + (c(r) - c(q)) * c(t)) / sd + sd / 2
    return sd, d1, d1 - sd


def with_price(df: DataFrame, spot="S", strike="strike", t="T", r="r", q="q", vol="vol", kind="kind", out="price", greeks: bool = False) -> DataFrame:
    """European price with a dividend yield; zero vol-time gives the discounted intrinsic value."""
    sd, d1, d2 = _d(spot, strike, t, r, q, vol)
    d = df.withColumns({"_sd": sd, "_d1": d1, "_d2": d2})
    d = d.withColumns({"_n1": norm_cdf("_d1"), "_n2": norm_cdf("_d2"), "_ds": c(spot) * F.exp(-c(q) * c(t)), "_dk": c(strike) * F.exp(-c(r) * c(t))})
    call = F.col(kind) == "C"
    sign = F.when(call, 1.0).otherwise(-1.0)
    n1, n2 = F.when(call, F.col("_n1")).otherwise(1 - F.col("_n1")), F.when(call, F.col("_n2")).otherwise(1 - F.col("_n2"))
    flat = F.greatest(sign * (F.col("_ds") - F.col("_dk")), F.lit(0.0))
    new = {out: F.when(F.col("_sd").isNull(), flat).otherwise(sign * (F.col("_ds") * n1 - F.col("_dk") * n2))}
    if greeks:
        pdf = norm_pdf("_d1")
        dq = F.exp(-c(q) * c(t))
        root = F.sqrt(F.when(c(t) > 0, c(t)))
        new |= {
            "delta": sign * dq * n1, "gamma": dq * pdf / (c(spot) * F.col("_sd")), "vega": c(spot) * dq * pdf * root,
            "theta": -c(spot) * dq * pdf * c(vol) / (2 * root) - sign * c(r) * F.col("_dk") * n2 + sign * c(q) * F.col("_ds") * n1,
            "rho": sign * c(t) * F.col("_dk") * n2,
        }
    return d.withColumns(new).drop("_sd", "_d1", "_d2", "_n1", "_n2", "_ds", "_dk")


def with_bounds(df: DataFrame, price: str, spot="S", strike="strike", t="T", r="r", q="q", kind="kind") -> DataFrame:
    """No-arbitrage bounds of a European price, and whether the given price lies inside."""
    ds, dk = c(spot) * F.exp(-c(q) * c(t)), c(strike) * F.exp(-c(r) * c(t))
    call = F.col(kind) == "C"
    d = df.withColumns({"lower": F.greatest(F.when(call, ds - dk).otherwise(dk - ds), F.lit(0.0)), "upper": F.when(call, ds).otherwise(dk)})
    return d.withColumn("inside", (F.col(price) >= F.col("lower")) & (F.col(price) <= F.col("upper")))


def _cdf(x: np.ndarray) -> np.ndarray:
    a = np.abs(x)
    with np.errstate(over="ignore", under="ignore"):
        e = np.exp(-a * a / 2)
        near = e * np.polyval(HART_NUM, a) / np.polyval(HART_DEN, a)
        far = e / ((a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) * np.sqrt(2 * np.pi))
    tail = np.where(a < 7.07106781186547, near, far)
    return np.where(x > 0, 1 - tail, tail)


@F.pandas_udf(DoubleType())
def implied_vol(price: pd.Series, spot: pd.Series, strike: pd.Series, t: pd.Series, r: pd.Series, q: pd.Series, kind: pd.Series) -> pd.Series:
    """Volatility that gives the price, by bisection over the whole batch; NULL when none does."""
    p, s, k, tt, rr, qq = (x.to_numpy(float) for x in (price, spot, strike, t, r, q))
    sign = np.where(kind.to_numpy() == "C", 1.0, -1.0)
    ds, dk, root = s * np.exp(-qq * tt), k * np.exp(-rr * tt), np.sqrt(np.maximum(tt, 0.0))

    def value(v: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            d1 = np.log(ds / dk) / (v * root) + v * root / 2
        return sign * (ds * _cdf(sign * d1) - dk * _cdf(sign * (d1 - v * root)))

    lo, hi = np.full(p.shape, VOL_RANGE[0]), np.full(p.shape, VOL_RANGE[1])
    with np.errstate(invalid="ignore"):
        ok = np.isfinite(p) & (tt > 0) & (s > 0) & (k > 0) & (value(lo) < p) & (p < value(hi))
        for _ in range(60):
            mid = (lo + hi) / 2
            low = value(mid) < p
            lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return pd.Series(np.where(ok, (lo + hi) / 2, np.nan)).astype("Float64").where(ok)


# ------------------------------------------------------------------ carry


def bill_rate(discount_pct: Column, days: int = 91) -> Column:
    """Continuously compounded rate of a bill quoted at a discount."""
    return -F.ln(1 - discount_pct / 100 * days / 360) * 365 / days


def with_bill_rate(meta: DataFrame, bills: DataFrame, days: int = 91) -> DataFrame:
    """meta (with quote_time) with `r`, the rate of the last bill discount on or before the quote's New York date; NULL before
    the first. bills: date, discount_pct; one row per date (the largest discount of a date counts). The dates of both make one ordered list, as
    long as the calendar."""
    asof = F.to_date(F.from_utc_timestamp("quote_time", "America/New_York"))
    quoted = bills.where("discount_pct is not null").groupBy("date").agg(F.max("discount_pct").alias("_d"))
    asked = meta.select(asof.alias("date")).distinct()
    every = quoted.join(asked.withColumn("_asked", F.lit(True)), "date", "full")
    last = F.last("_d", ignorenulls=True).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    rates = every.withColumn("r", bill_rate(last, days)).where("_asked").select(F.col("date").alias("_asof"), "r")
    return meta.drop("r").withColumn("_asof", asof).join(rates, "_asof", "left").drop("_asof")


def ex_dates(spans: DataFrame, by: Sequence[str], after: str, until: str) -> DataFrame:
    """Projected ex-dates in (after, until]: third Fridays of March, June, September, December; June 19 is a
    holiday, so the day before."""
    month = F.explode(F.sequence(F.trunc(after, "month"), F.trunc(until, "month"), F.expr("interval 1 month")))
    d = spans.select(*by, after, until, month.alias("_m")).where(F.month("_m").isin(3, 6, 9, 12))
    friday = F.next_day(F.date_add("_m", -1), "Fri")
    d = d.withColumn("ex_date", F.date_add(friday, 14))
    holiday = (F.month("ex_date") == 6) & (F.dayofmonth("ex_date") == 19)
    d = d.withColumn("ex_date", F.when(holiday, F.date_add("ex_date", -1)).otherwise(F.col("ex_date")))
    return d.where((F.col("ex_date") > F.col(after)) & (F.col("ex_date") <= F.col(until))).select(*by, "ex_date")


def year_fraction(quote: Column, expiry: Column) -> Column:
    """Calendar time, actual over 365, from the quote (UTC) to 16:00 New York on the expiry date."""
    close = F.to_utc_timestamp(F.concat(expiry.cast("string"), F.lit(" 16:00:00")).cast("timestamp"), "America/New_York")
    return (close.cast("double") - quote.cast("double")) / YEAR_SECONDS


def carry(expiries: DataFrame, meta: DataFrame, dividends: DataFrame, by: Sequence[str] = ("underlying",)) -> DataFrame:
    """Time, rate, dividend value, equivalent yield and forward of each (underlying, expiry).

    meta: S, quote_time (UTC timestamp), r. dividends: ex_date, amount; those after the quote and up to the
    expiry count (a range join on a few dates per underlying)."""
    by = list(by)
    e = expiries.select(*by, "expiry").distinct().join(meta, by).withColumn("T", year_fraction(F.col("quote_time"), F.col("expiry")))
    e = e.withColumn("_asof", F.to_date(F.from_utc_timestamp("quote_time", "America/New_York")))
    d = e.select(*by, "expiry", "_asof", "r").join(dividends.select(*by, "ex_date", "amount"), by).where(
        (F.col("ex_date") > F.col("_asof")) & (F.col("ex_date") <= F.col("expiry")))
    pv = d.groupBy(*by, "expiry").agg(F.sum(F.col("amount") * F.exp(-F.col("r") * F.datediff("ex_date", "_asof") / 365.0)).alias("pv_div"))
    e = e.join(pv, [*by, "expiry"], "left").fillna(0.0, ["pv_div"])
    q = F.when(F.col("T") > 0, -F.ln(1 - F.col("pv_div") / F.col("S")) / F.col("T")).otherwise(0.0)
    e = e.withColumn("q", q).withColumn("forward", F.col("S") * F.exp((F.col("r") - F.col("q")) * F.col("T")))
    return e.drop("_asof")


# ------------------------------------------------------------------ quotes


def two_sided() -> Column:
    return F.coalesce((F.col("bid") > 0) & (F.col("ask") > 0) & (F.col("ask") >= F.col("bid")), F.lit(False))


def screen_stale(chain: DataFrame, other: DataFrame | None, keys: Sequence[str] = ("contract",), tol: float = 1e-9) -> DataFrame:
    """Keep `usable` only where a second vendor shows the same quote; without a second vendor nothing changes."""
    if other is None:
        return chain.withColumn("stale", F.lit(False))
    o = other.select(*keys, F.col("bid").alias("_b"), F.col("ask").alias("_a"))
    same = F.coalesce((F.abs(F.col("bid") - F.col("_b")) <= tol) & (F.abs(F.col("ask") - F.col("_a")) <= tol), F.lit(False))
    d = chain.join(o, list(keys), "left").withColumn("_same", same)
    return d.withColumns({"stale": F.col("usable") & ~F.col("_same"), "usable": F.col("usable") & F.col("_same")}).drop("_b", "_a", "_same")


def usability(chain: DataFrame, by: Sequence[str], near: float = 0.05) -> DataFrame:
    u = F.col("usable").cast("double")
    close = F.abs(F.col("strike") / F.col("S") - 1) <= near
    return chain.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(u).alias("share_usable"), F.avg(F.when(close, u)).alias("share_usable_near"))


def pick_expiries(expiries: DataFrame, asof: str, targets: Sequence[int] = (7, 30, 91), by: Sequence[str] = ("underlying",)) -> DataFrame:
    """For each target tenor the nearest listed expiry after `asof` (ties earlier), without repeats."""
    e = expiries.select(*by, asof, "expiry").distinct().where(F.col("expiry") > F.col(asof))
    e = e.withColumn("target", F.explode(F.array(*[F.lit(t) for t in targets])))
    gap = F.abs(F.datediff("expiry", asof) - F.col("target"))
    return e.groupBy(*by, "target").agg(F.min_by("expiry", F.struct(gap, "expiry")).alias("expiry")).groupBy(*by, "expiry").agg(F.min("target").alias("target"))


def pairs(chain: DataFrame, by: Sequence[str] = ("underlying", "expiry")) -> DataFrame:
    side = lambda k, p: chain.where(F.col("kind") == k).select(
        *by, "strike", F.col("bid").alias(f"{p}_bid"), F.col("ask").alias(f"{p}_ask"), F.col("usable").alias(f"{p}_ok"))
    return side("C", "c").join(side("P", "p"), [*by, "strike"])


# ------------------------------------------------------------------ smiles


def interpolate(df: DataFrame, by: Sequence[str], x: str, y: str, at: float, out: str) -> DataFrame:
    """y at x = at by linear interpolation between the nearest points, flat outside the range."""
    p = F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    g = df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).groupBy(*by).agg(
        F.max(F.when(F.col(x) <= at, p)).alias("_l"), F.min(F.when(F.col(x) >= at, p)).alias("_h"), F.count(F.lit(1)).alias("_n"))
    share = div(F.lit(float(at)) - F.col("_l.x"), F.col("_h.x") - F.col("_l.x"))
    v = F.when(F.col("_l").isNull(), F.col("_h.y")).when(F.col("_h").isNull(), F.col("_l.y")).when(
        F.col("_h.x") == F.col("_l.x"), F.col("_l.y")).otherwise(F.col("_l.y") + share * (F.col("_h.y") - F.col("_l.y")))
    return g.select(*by, v.alias(out), "_n")


def smile(chain: DataFrame, cy: DataFrame, by: Sequence[str] = ("underlying", "expiry"), max_z: float = 3.5) -> DataFrame:
    """Out-of-the-money implied vols from mid, bid and ask within a band of at-the-money deviations."""
    by = list(by)
    d = chain.where("usable").join(cy.select(*by, "S", "T", "r", "q", "forward"), by)
    put = F.col("kind") == "P"
    d = d.where((put & (F.col("strike") < F.col("forward"))) | (~put & (F.col("strike") >= F.col("forward"))))
    d = d.withColumns({"mid": (F.col("bid") + F.col("ask")) / 2, "log_moneyness": F.ln(F.col("strike") / F.col("forward"))})
    iv = lambda px: implied_vol(F.col(px), "S", "strike", "T", "r", "q", "kind")
    d = cut(d.withColumns({f"iv_{n}": iv(n) for n in ("mid", "bid", "ask")}))
    atm = interpolate(d, by, "log_moneyness", "iv_mid", 0.0, "atm_iv").drop("_n")
    d = d.join(atm, by).withColumn("z", F.col("log_moneyness") / (F.col("atm_iv") * F.sqrt("T"))).where(F.abs("z") <= max_z)
    return with_price(d, vol="iv_mid", out="_model", greeks=True).drop("_model", "gamma", "vega", "theta", "rho")


def smile_summary(sm: DataFrame, by: Sequence[str] = ("underlying", "expiry")) -> DataFrame:
    by = list(by)
    s = cut(sm.where("iv_mid is not null").withColumn("_w", F.col("iv_ask") - F.col("iv_bid")))
    wing = lambda k, at, n: interpolate(s.where(F.col("kind") == k), by, "delta", "iv_mid", at, n).where("_n > 1").drop("_n")
    near = F.abs("z") <= SKEW_Z
    med = lambda cond: F.percentile(F.when(cond, F.col("_w")), F.lit(0.5))
    g = s.groupBy(*by).agg(
        F.first("atm_iv").alias("atm_iv"), F.count(F.lit(1)).alias("n_strikes"), (F.first("T") * 365).alias("T_days"), F.first("T").alias("_T"),
        F.when(F.count_if(near) >= 3, F.regr_slope(F.when(near, F.col("iv_mid")), F.when(near, F.col("log_moneyness")))).alias("skew_slope"),
        med(F.lit(True)).alias("median_iv_spread"), med(F.abs("z") <= 0.5).alias("iv_spread_atm"), med(F.abs("z") >= 2).alias("iv_spread_wings"))
    g = g.join(wing("C", 0.25, "iv_25d_call"), by, "left").join(wing("P", -0.25, "iv_25d_put"), by, "left")
    return g.withColumns({"rr25": F.col("iv_25d_call") - F.col("iv_25d_put"), "skew_per_10pct": F.col("skew_slope") * F.ln(F.lit(1.1)),
                          "skew_per_sigma": F.col("skew_slope") * F.col("atm_iv") * F.sqrt("_T")}).drop("_T")


# ------------------------------------------------------------------ parity


def implied_forward(pr: DataFrame, cy: DataFrame, n: int = 6, by: Sequence[str] = ("underlying", "expiry")) -> DataFrame:
    """Median forward implied by parity at the strikes nearest the model forward."""
    by = list(by)
    d = pr.where("c_ok and p_ok").join(cy.select(*by, "S", "T", "r", "forward"), by)
    w = Window.partitionBy(*by).orderBy(F.abs(F.col("strike") - F.col("forward")), "strike")  # strikes of one expiry
    d = d.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= n)
    mids = (F.col("c_bid") + F.col("c_ask") - F.col("p_bid") - F.col("p_ask")) / 2
    d = d.withColumn("_f", F.col("strike") + F.exp(F.col("r") * F.col("T")) * mids)
    g = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.first("forward").alias("forward_model"), F.percentile("_f", F.lit(0.5)).alias("forward_implied"), F.first("S").alias("_S"))
    gap = F.col("forward_implied") - F.col("forward_model")
    return g.withColumns({"diff": gap, "diff_bps": 1e4 * gap / F.col("_S")}).drop("_S")


def parity(pr: DataFrame, cy: DataFrame, tol: float = TICK, by: Sequence[str] = ("underlying", "expiry")) -> DataFrame:
    """Parity residuals per strike at the mids and after crossing the spread, with American bands."""
    by = list(by)
    d = pr.where("c_ok and p_ok").join(cy.select(*by, "S", "s_bid", "s_ask", "T", "r", "q"), by)
    K, dq, dr = F.col("strike"), F.exp(-F.col("q") * F.col("T")), F.exp(-F.col("r") * F.col("T"))
    cb, ca, pb, pa = (F.col(x) for x in ("c_bid", "c_ask", "p_bid", "p_ask"))
    d = d.withColumns({
        "residual_mid": (cb + ca - pb - pa) / 2 - (F.col("S") * dq - K * dr),
        "conversion_edge": cb - pa - (F.col("s_ask") * dq - K * dr), "reversal_edge": F.col("s_bid") * dq - K * dr - (ca - pb),
        "american_conv_edge": cb - pa - (F.col("s_ask") - K * dr), "american_rev_edge": F.col("s_bid") * dq - K - (ca - pb),
        "half_band": (ca - cb + pa - pb + F.col("s_ask") - F.col("s_bid")) / 2, "moneyness": K / F.col("S"),
    })
    best = F.greatest("conversion_edge", "reversal_edge")
    return d.withColumns({
        "mid_violation": F.abs("residual_mid") > tol, "spread_violation": best > tol,
        "american_violation": F.greatest("american_conv_edge", "american_rev_edge") > tol,
        "edge_rate": best / (K * dr) / F.col("T"),
    })


def parity_summary(chk: DataFrame, by: Sequence[str] = ("underlying", "expiry"), tol: float = TICK) -> DataFrame:
    itm, conv, rev = F.col("moneyness") > 1, F.col("conversion_edge") > tol, F.col("reversal_edge") > tol
    return chk.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if("mid_violation").alias("mid_violations"), F.count_if("spread_violation").alias("spread_violations"),
        F.count_if(conv).alias("conversion_violations"), F.count_if(rev).alias("reversal_violations"),
        F.count_if(F.col("spread_violation") & itm).alias("violations_itm_put"), F.count_if(rev & itm).alias("reversal_itm_put"),
        F.count_if(conv & ~itm).alias("conversion_below_spot"), F.count_if("american_violation").alias("american_violations"),
        F.percentile(F.abs("residual_mid"), F.lit(0.5)).alias("median_abs_residual_mid"), F.percentile("half_band", F.lit(0.5)).alias("median_half_band"),
        F.max(F.greatest("conversion_edge", "reversal_edge")).alias("max_edge_after_spread"),
        F.max(F.greatest("american_conv_edge", "american_rev_edge")).alias("max_american_edge"),
        F.min(F.when(conv, F.col("moneyness"))).alias("conv_moneyness_lo"), F.max(F.when(conv, F.col("moneyness"))).alias("conv_moneyness_hi"))


def snapshot_report(chain: DataFrame, cy: DataFrame, by: Sequence[str] = ("underlying", "expiry")) -> DataFrame:
    pr = cut(pairs(chain, by))
    return smile_summary(smile(chain, cy, by), by).join(implied_forward(pr, cy, by=by).withColumnRenamed("n", "n_forward"), list(by), "left").join(
        parity_summary(parity(pr, cy, by=by), by), list(by), "left")


# ------------------------------------------------------------------ probabilities


def digital_from_calls(questions: DataFrame, calls: DataFrame, r: float = 0.04, by: Sequence[str] = ("underlying",)) -> DataFrame:
    """P(S_T > K) of each question from the call spread that strictly brackets K on the first expiry at or
    after its date, with a bid/ask band. questions: question_id, asof, strike, when.

    Dates and strikes are looked up once each: asked and listed strikes of an expiry make one ordered list, in which the call
    before and the call behind an asked strike are the last ones seen from either end. No question meets a whole expiry."""
    by = list(by)
    good = calls.where((F.col("kind") == "C") & (F.col("bid") > 0) & (F.col("ask") >= F.col("bid")))
    q = questions.select(*by, "question_id", "asof", "when", F.col("strike").alias("_k")).distinct()
    asked = stored(q.select(*by, "when", "_k").distinct())
    first = asked.select(*by, "when").distinct().join(good.select(*by, "expiry").distinct(), by).where(F.col("expiry") >= F.col("when"))
    first = asked.join(first.groupBy(*by, "when").agg(F.min("expiry").alias("expiry")), [*by, "when"])
    row = F.struct("strike", "bid", "ask")  # of several calls at a strike, the largest counts below and the smallest above
    listed = good.groupBy(*by, "expiry", F.col("strike").alias("_k")).agg(F.max(row).alias("_low"), F.min(row).alias("_high"), F.lit(1).alias("_call"))
    every = first.select(*by, "expiry", "_k").distinct().withColumn("_call", F.lit(0)).unionByName(listed, allowMissingColumns=True)
    seen = lambda x, k: F.last(x, ignorenulls=True).over(  # noqa: E731  # asked strikes stand before the call at their own strike
        Window.partitionBy(*by, "expiry").orderBy(k, "_call").rowsBetween(Window.unboundedPreceding, 0))
    ends = every.select(*by, "expiry", "_k", "_call", seen("_low", F.col("_k")).alias("_l"), seen("_high", F.desc("_k")).alias("_h"))
    ends = ends.where("_call = 0 and _l is not null and _h is not null").drop("_call")
    g = q.join(first.join(ends, [*by, "expiry", "_k"]), [*by, "when", "_k"])
    t = F.greatest(F.datediff("expiry", "asof"), F.lit(1)) / 365.0
    k = F.exp(r * t) / (F.col("_h.strike") - F.col("_l.strike"))
    lim = lambda x: F.least(F.greatest(x, F.lit(0.005)), F.lit(0.995))
    lb, la, hb, ha = (F.col(x) for x in ("_l.bid", "_l.ask", "_h.bid", "_h.ask"))
    return g.select(*by, "question_id", F.col("_k").alias("strike"), "expiry", lim(k * ((lb + la) - (hb + ha)) / 2).alias("p"),
                    lim(k * (lb - ha)).alias("lo"), lim(k * (la - hb)).alias("hi"))


def beat_probability(reports: DataFrame, quarters: int = 12, prior=PRIOR, by: Sequence[str] = ("ticker",)) -> DataFrame:
    """Posterior chance of beating the estimate from the last `quarters` reported quarters."""
    a, b = prior
    w = Window.partitionBy(*by).orderBy(F.col("date").desc())
    past = reports.where("estimate is not null and reported is not null").withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= quarters)
    g = past.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("reported") > F.col("estimate")).alias("beats"))
    return g.withColumn("p", (a + F.col("beats")) / (a + b + F.col("n")))

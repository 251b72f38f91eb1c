"""Queue imbalance, order-flow imbalance and the price-impact regressions on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.mathx import Z_975, div
from tapeworks.operators.scan import CHUNK_ROWS, SLOT_SECONDS, asof, avg_rank, cut, ordered_scan
from tapeworks.operators.tape import KEYS, OPEN, SESSION, SPLIT, TICK, clock_grid, depth_best, mid

BUCKET = 10.0
WINDOW = 1800.0
STEP = 1.0

# Results published by Cont, Kukanov and Stoikov (2014) and Gould and Bonart (2016).
PUBLISHED = (
    ("impact", "mean_r2", 0.65, 0.65),
    ("impact", "depth_exponent", 0.88, 1.08),
    ("auc", "large-tick", 0.752, 0.805),
    ("auc", "small-tick", 0.581, 0.642),
    ("slope", "large-tick", 2.03, 2.73),
    ("slope", "small-tick", 0.50, 0.85),
)


def queue_imbalance(bid_size: str = "bid_size", ask_size: str = "ask_size") -> Column:
    b, a = F.col(bid_size).cast("double"), F.col(ask_size).cast("double")
    return F.when(b + a > 0, (b - a) / F.nullif(b + a, F.lit(0.0))).otherwise(0.0)


def flow_event() -> Column:
    """Order-flow imbalance of one event from the quotes before (prev_*) and after it; 0 on the first row."""
    pb, pa, qb, qa = F.col("bid_price"), F.col("ask_price"), F.col("bid_size"), F.col("ask_size")
    pb0, pa0, qb0, qa0 = (F.col(f"prev_{x}") for x in ("bid_price", "ask_price", "bid_size", "ask_size"))
    gate = lambda cond, q: F.when(cond, q).otherwise(0)
    e = gate(pb >= pb0, qb) - gate(pb <= pb0, qb0) - gate(pa <= pa0, qa) + gate(pa >= pa0, qa0)
    return F.when(pb0.isNull(), 0).otherwise(e).cast("double")


def with_flow(tape: DataFrame, by: Sequence[str] = KEYS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    quotes = ("bid_price", "bid_size", "ask_price", "ask_size")
    t = ordered_scan(tape, by, "seq", lags={f"prev_{q}": F.col(q) for q in quotes}, chunk_rows=chunk_rows)
    return t.withColumn("flow", flow_event()).drop(*[f"prev_{q}" for q in quotes])


def with_next_mid(tape: DataFrame, by: Sequence[str] = KEYS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """For each state the first later state with another mid: next_mid, next_mid_time, next_mid_seq."""
    t = tape.withColumn("mid", mid())
    t = ordered_scan(t, by, "seq", lags={"_pm": F.col("mid"), "_ps": F.col("seq")}, chunk_rows=chunk_rows)
    moved = F.col("_ps").isNotNull() & ~F.col("mid").eqNullSafe(F.col("_pm"))
    hit = F.when(moved, F.struct(F.col("seq").alias("s"), F.col("time").alias("t"), F.col("mid").alias("m")))
    t = ordered_scan(t, by, "seq", bfill={"_nx": hit}, chunk_rows=chunk_rows)
    return t.withColumns(
        {"next_mid_seq": F.col("_nx.s"), "next_mid_time": F.col("_nx.t"), "next_mid": F.col("_nx.m")}
    ).drop("_nx", "_pm", "_ps")


def imbalance_samples(tape: DataFrame, step: float = STEP, session: Sequence[float] = SESSION,
                      by: Sequence[str] = KEYS, slot: float = SLOT_SECONDS) -> DataFrame:
    """Clock-grid samples of the imbalance, labelled by the direction of the next mid change."""
    s = with_next_mid(tape, by).withColumn("imbalance", queue_imbalance())
    s = cut(s.select(*by, "seq", "time", "imbalance", "mid", "next_mid", "next_mid_time"))
    grid = clock_grid(tape, session[0], session[1] - 1e-6, step, by)
    cols = {x: x for x in ("imbalance", "mid", "next_mid", "next_mid_time")}
    at = asof(grid, s, by, "t", "time", "seq", cols, slot)
    return at.where(F.col("next_mid_time") < float(session[1])).select(
        *by, "t", "imbalance", F.when(F.col("next_mid") > F.col("mid"), 1).otherwise(0).alias("up"),
        F.col("next_mid_time").alias("resolve"),
    )


def flow_buckets(tape: DataFrame, width: float = BUCKET, session: Sequence[float] = SESSION,
                 by: Sequence[str] = KEYS, slot: float = SLOT_SECONDS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Flow, mid change (ticks) and clock-weighted depth on right-closed buckets (t, t + width].

    One as-of lookup at the bucket edges reads the running flow, the running depth integral and the mid."""
    quotes = ("bid_price", "bid_size", "ask_price", "ask_size")
    lags = {**{f"prev_{q}": F.col(q) for q in quotes}, "_pt": F.col("time")}
    t = ordered_scan(tape, by, "seq", lags=lags, chunk_rows=chunk_rows)
    dep0 = (F.col("prev_bid_size") + F.col("prev_ask_size")) / 2.0
    step = F.coalesce(dep0 * (F.col("time") - F.col("_pt")), F.lit(0.0))
    t = ordered_scan(t, by, "seq", sums={"flow_sum": flow_event(), "area": step}, chunk_rows=chunk_rows)
    t = t.select(*by, "seq", "time", "flow_sum", "area", depth_best().alias("value"), (mid() / TICK).alias("mid"))
    t = cut(t)  # narrow rows, written once and read by both sides of the lookup
    edges = clock_grid(tape, session[0], session[1] + width * 0.499, width, by)
    at = asof(edges, t, by, "t", "time", "seq",
              {"mid": "mid", "_f": "flow_sum", "_v": "value", "_a": "area", "_from": "time"}, slot)
    at = at.withColumn("_int", F.col("_a") + F.col("_v") * (F.col("t") - F.col("_from")))
    w = Window.partitionBy(*by).orderBy("t")  # one row per edge of the clock grid
    nxt = lambda x: F.lead(x).over(w)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return at.select(
        *by, F.col("t").alias("start"),
        (zero(nxt("_f")) - zero(F.col("_f"))).alias("flow"),
        (nxt("mid") - F.col("mid")).alias("dmid"),
        ((nxt("_int") - F.col("_int")) / float(width)).alias("depth"),
        nxt("t").alias("_end"),
    ).where("_end is not null").drop("_end")


def ols(df: DataFrame, by: Sequence[str], x: str, y: str, *extra: Column) -> DataFrame:
    """y = alpha + beta x per group; r2 is NULL when y does not vary."""
    fx, fy = F.col(x).cast("double"), F.col(y).cast("double")
    ok = fx.isNotNull() & fy.isNotNull()
    return df.groupBy(*by).agg(
        F.count_if(ok).alias("n"),
        F.regr_intercept(fy, fx).alias("alpha"), F.regr_slope(fy, fx).alias("beta"),
        F.when(F.regr_syy(fy, fx) > 0, F.regr_r2(fy, fx)).alias("r2"), *extra,
    )


def window_regressions(buckets: DataFrame, window: float = WINDOW, origin: float = OPEN,
                       by: Sequence[str] = KEYS) -> DataFrame:
    w = buckets.withColumn("window", F.floor((F.col("start") - float(origin)) / float(window)))
    return ols(w, [*by, "window"], "flow", "dmid", F.avg("depth").alias("depth"),
               F.max(F.abs("flow")).alias("max_abs_flow")).withColumn(
        "window_start", float(origin) + F.col("window") * float(window)
    )


def depth_slope(regs: DataFrame, by: Sequence[str] = (), group: str | None = None) -> DataFrame:
    """log(beta) on log(depth) per `by`, with one intercept per `group` if given; HC3 95% interval.

    With x~ the deviation from the group mean, h = 1/n_g + x~^2/Sxx is the leverage, so slope and robust
    variance need only sums; residuals come from one join with the fitted row."""
    one = list(by) or ["_all"]
    regs = cut(regs)  # one row per window, read several times below
    d = regs.withColumn("_all", F.lit(1)) if not by else regs
    good = F.coalesce((F.col("beta") > 0) & (F.col("depth") > 0), F.lit(False))
    dropped = d.groupBy(*one).agg(F.count_if(~good).alias("n_dropped"))
    d = d.where(good).withColumns({"_x": F.ln("depth"), "_y": F.ln("beta")})
    cell = [*one, group] if group else one
    means = d.groupBy(*cell).agg(F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"), F.count(F.lit(1)).alias("_ng"))
    d = d.join(means, cell).withColumns({"_dx": F.col("_x") - F.col("_mx"), "_dy": F.col("_y") - F.col("_my")})
    fit = d.groupBy(*one).agg(
        F.sum(F.col("_dx") * F.col("_dx")).alias("_sxx"),
        div(F.sum(F.col("_dx") * F.col("_dy")), F.sum(F.col("_dx") * F.col("_dx"))).alias("slope"),
        F.avg("_y").alias("_ybar"), F.avg("_x").alias("_xbar"),
    )
    r = d.join(fit, one)
    e = F.col("_dy") - F.col("slope") * F.col("_dx")
    lev = 1 / F.col("_ng") + div(F.col("_dx") * F.col("_dx"), F.col("_sxx"))
    scaled = div(F.col("_dx") * e, 1 - lev)
    out = r.groupBy(*one).agg(
        F.first("slope").alias("slope"), F.first("_ybar").alias("_yb"), F.first("_xbar").alias("_xb"),
        F.count(F.lit(1)).alias("n"),
        div(F.sqrt(F.sum(scaled * scaled)), F.first("_sxx")).alias("se"),
        (1 - div(F.sum(e * e), F.sum((F.col("_y") - F.col("_ybar")) ** 2))).alias("r2"),
    )
    out = out.join(dropped, one, "left").withColumns({
        "lo": F.col("slope") - Z_975 * F.col("se"), "hi": F.col("slope") + Z_975 * F.col("se"),
        "intercept": F.lit(None).cast("double") if group else F.col("_yb") - F.col("slope") * F.col("_xb"),
    })
    return out.select(*by, "slope", "se", "lo", "hi", "intercept", "r2", "n", "n_dropped")


def out_of_sample(df: DataFrame, by: Sequence[str], x: str, y: str, train: Column, test: Column) -> DataFrame:
    """Fit on the training rows, score on the test rows against the training mean and against zero."""
    fit = ols(df.where(train & F.col(x).isNotNull() & F.col(y).isNotNull()), by, x, y, F.avg(y).alias("_mean"))
    t = df.where(test & F.col(x).isNotNull() & F.col(y).isNotNull()).join(
        fit.withColumnRenamed("n", "n_train"), list(by)
    )
    err = F.col(y) - F.col("alpha") - F.col("beta") * F.col(x)
    sse = F.sum(err * err)
    return t.groupBy(*by).agg(
        F.first("beta").alias("beta"), F.first("alpha").alias("alpha"),
        F.first("n_train").alias("n_train"), F.count(F.lit(1)).alias("n_test"),
        (1 - div(sse, F.sum((F.col(y) - F.col("_mean")) ** 2))).alias("r2_oos"),
        (1 - div(sse, F.sum(F.col(y) * F.col(y)))).alias("r2_oos_zero"),
    )


def same_and_next_bucket(buckets: DataFrame, split: float = SPLIT, width: float = BUCKET,
                         by: Sequence[str] = KEYS) -> DataFrame:
    """Flow against the mid change of the same bucket and of the next one; pairs across the split are dropped."""
    w = Window.partitionBy(*by).orderBy("start")
    b = buckets.withColumn("next_dmid", F.lead("dmid").over(w))
    end = F.col("start") + float(width)
    same = out_of_sample(b, by, "flow", "dmid", end <= split, F.col("start") >= split)
    nxt = out_of_sample(b, by, "flow", "next_dmid", end + float(width) <= split, F.col("start") >= split)
    return same.withColumn("kind", F.lit("contemporaneous")).unionByName(nxt.withColumn("kind", F.lit("lagged")))


def impact_units(buckets: DataFrame, facts: DataFrame, regs: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """Whole-day impact slope in several units and its ratios to the informed-trading slope."""
    full = ols(buckets, by, "flow", "dmid")
    med = regs.groupBy(*by).agg(F.percentile("beta", F.lit(0.5)).alias("_mb"))
    j = full.join(facts.select(*by, "mean_price", "tick_bps", "depth_best"), list(by)).join(med, list(by), "left")
    k = F.col("beta") * 1000
    return j.select(
        *by, k.alias("beta_per_1000"), "r2",
        (F.col("beta") * TICK / 1e4).alias("beta_usd_per_share"),
        (k * F.col("tick_bps")).alias("beta_bps_per_1000"),
        (F.col("_mb") * 1000).alias("median_window_beta_per_1000"),
        F.when(F.col("r2") > 0, k / F.sqrt(F.nullif("r2", F.lit(0.0)))).alias("slope_over_root_r2"),
        (k * F.col("depth_best") / 1000).alias("beta_times_depth"), "depth_best", "mean_price",
    )


def auc(df: DataFrame, by: Sequence[str], score: str, label: str) -> DataFrame:
    """Area under the ROC curve by the rank sum with average ranks (groups are clock grids)."""
    r = df.withColumn("_rk", avg_rank(score, by))
    pos, n = F.sum(label), F.count(F.lit(1))
    rank_sum = F.sum(F.when(F.col(label) == 1, F.col("_rk")))
    return r.groupBy(*by).agg(div(rank_sum - pos * (pos + 1) / 2, pos * (n - pos)).alias("auc"))


def fit_logistic(df: DataFrame, by: Sequence[str], x: str, y: str, steps: int = 12) -> DataFrame:
    """Two-parameter logistic fit per group by Newton steps; each step is one grouped aggregate.

    Rows are first folded to counts per distinct x, and only the parameter table is cut between steps."""
    by = list(by)
    folded = cut(df.groupBy(*by, F.col(x).alias("_x")).agg(F.count(F.lit(1)).alias("_n"), F.sum(y).alias("_k")))
    both = folded.groupBy(*by).agg(F.sum("_k").alias("_pos"), F.sum("_n").alias("_all"))
    par = both.where((F.col("_pos") > 0) & (F.col("_pos") < F.col("_all"))).select(
        *by, F.lit(0.0).alias("coef"), F.lit(0.0).alias("intercept")
    )
    for _ in range(steps):
        j = folded.join(par, by)
        p = 1 / (1 + F.exp(-(F.col("intercept") + F.col("coef") * F.col("_x"))))
        j = j.withColumn("_p", p).withColumn("_w", F.col("_n") * F.col("_p") * (1 - F.col("_p")))
        r = F.col("_k") - F.col("_n") * F.col("_p")
        s = j.groupBy(*by).agg(
            F.first("coef").alias("coef"), F.first("intercept").alias("intercept"),
            F.sum(r).alias("_g0"), F.sum(r * F.col("_x")).alias("_g1"),
            F.sum("_w").alias("_h00"), F.sum(F.col("_w") * F.col("_x")).alias("_h01"),
            F.sum(F.col("_w") * F.col("_x") * F.col("_x")).alias("_h11"),
        )
        det = F.col("_h00") * F.col("_h11") - F.col("_h01") * F.col("_h01")
        d0 = div(F.col("_h11") * F.col("_g0") - F.col("_h01") * F.col("_g1"), det)
        d1 = div(F.col("_h00") * F.col("_g1") - F.col("_h01") * F.col("_g0"), det)
        par = cut(s.select(
            *by, (F.col("coef") + F.coalesce(d1, F.lit(0.0))).alias("coef"),
            (F.col("intercept") + F.coalesce(d0, F.lit(0.0))).alias("intercept"),
        ))
    return par


def score_imbalance(samples: DataFrame, split: float = SPLIT, by: Sequence[str] = KEYS) -> DataFrame:
    """P(next mid change is up | imbalance): fit before the split, AUC and Brier after it."""
    samples = cut(samples)
    train = samples.where((F.col("t") < split) & (F.col("resolve") < split))
    test = samples.where(F.col("t") >= split)
    par = fit_logistic(train, by, "imbalance", "up")
    base = train.groupBy(*by).agg(F.avg("up").alias("_base"), F.count(F.lit(1)).alias("n_train"))
    p = 1 / (1 + F.exp(-(F.col("intercept") + F.col("coef") * F.col("imbalance"))))
    scored = test.join(par.join(base, list(by)), list(by)).withColumn("p", p)
    y = F.col("up")
    perf = scored.groupBy(*by).agg(
        F.first("coef").alias("coef"), F.first("intercept").alias("intercept"), F.first("n_train").alias("n_train"),
        F.count(F.lit(1)).alias("n_test"), F.avg(y).alias("base_rate_test"),
        F.avg((F.col("p") - y) ** 2).alias("brier_test"), F.avg((F.col("_base") - y) ** 2).alias("brier_base"),
    )
    return perf.join(auc(test, by, "imbalance", "up"), list(by), "left").join(
        auc(train, by, "imbalance", "up").withColumnRenamed("auc", "auc_train"), list(by), "left"
    )


def imbalance_curve(samples: DataFrame, split: float = SPLIT, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Share of up moves by imbalance bin on the test half."""
    k = F.greatest(F.least(F.floor((F.col("imbalance") + 1) * bins / 2), F.lit(bins - 1)), F.lit(0))
    return samples.where(F.col("t") >= split).groupBy(*by, k.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("up").alias("p_up")
    )


def against_published(regs: DataFrame, scores: DataFrame, slope: DataFrame, facts: DataFrame,
                      by: Sequence[str] = KEYS) -> DataFrame:
    """Ranges of the statistics by tick class next to the published values."""
    cls = facts.select(*by, "tick_class")
    per = regs.groupBy(*by).agg(F.avg("r2").alias("r2"))
    rows = per.select(F.lit("impact").alias("family"), F.lit("mean_r2").alias("item"), F.col("r2").alias("v")).groupBy(
        "family", "item").agg(F.avg("v").alias("here_lo"), F.avg("v").alias("here_hi"))
    expo = slope.select(F.lit("impact").alias("family"), F.lit("depth_exponent").alias("item"),
                        (-F.col("hi")).alias("here_lo"), (-F.col("lo")).alias("here_hi"))
    s = scores.join(cls, list(by))
    both = s.select("tick_class", F.explode(F.array(
        F.struct(F.lit("auc").alias("family"), F.col("auc").alias("v")),
        F.struct(F.lit("slope").alias("family"), F.col("coef").alias("v")))).alias("e"))
    ranges = both.groupBy(F.col("e.family").alias("family"), F.col("tick_class").alias("item")).agg(
        F.min("e.v").alias("here_lo"), F.max("e.v").alias("here_hi"))
    known = F.array(*[F.struct(F.lit(a).alias("family"), F.lit(b).alias("item"), F.lit(float(lo)).alias("published_lo"),
                               F.lit(float(hi)).alias("published_hi")) for a, b, lo, hi in PUBLISHED])
    pub = regs.sparkSession.range(1).select(F.explode(known).alias("e")).select("e.*")
    return rows.unionByName(expo).unionByName(ranges).join(pub, ["family", "item"], "left")

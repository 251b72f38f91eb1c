"""From matched quotes to sized proposals: mapping state, pooled probability, screen, sizing, checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.mathx import div
from tapeworks.operators.sizing import kelly_yes

MIN_EDGE, MIN_BAND, KELLY_SHARE, MAX_FRACTION = 0.03, 0.02, 0.5, 0.25
MIN_MINUTES, TTL_MINUTES, COOL_HOURS, MOVE = 10, 30, 4, 0.03


def usable_mappings(cands: DataFrame, status: DataFrame) -> DataFrame:
    """References of each contract: all confirmed ones, else the best suggestion that was not rejected."""
    j = cands.join(status.select("contract_id", "quote_id", "status"), ["contract_id", "quote_id"], "left")
    j = j.withColumn("status", F.coalesce("status", F.lit("suggested"))).where("status <> 'rejected'")
    w = Window.partitionBy("contract_id")  # at most a handful of candidates
    j = j.withColumns({"confirmed": F.max((F.col("status") == "confirmed").cast("int")).over(w) == 1,
                       "_i": F.row_number().over(w.orderBy(F.col("score").desc(), "quote_id"))})
    return j.where((F.col("confirmed") & (F.col("status") == "confirmed")) | (~F.col("confirmed") & (F.col("_i") == 1))).drop("_i")


def book_columns(books: DataFrame) -> DataFrame:
    """Best quotes, mid (one-sided when only one side is there) and spread of books with `bids`, `asks` arrays."""
    best = lambda side: F.get(F.col(side), F.lit(0))["price"]
    b, a = best("bids"), best("asks")
    return books.withColumns({"best_bid": b, "best_ask": a, "mid": F.when(b.isNotNull() & a.isNotNull(), (a + b) / 2).otherwise(F.coalesce(a, b)),
                              "spread": a - b})


def depth_up_to(asks: Column, price: Column) -> Column:
    return F.aggregate(F.filter(asks, lambda x: x["price"] <= price), F.lit(0.0), lambda s, x: s + x["size"])


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))
    return F.ln(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def source_weight() -> Column:
    """Weight of a quote by its kind, money behind it and number of people."""
    z = lambda x: F.coalesce(F.col(x).cast("double"), F.lit(0.0))
    play = F.least(0.4 + 0.1 * F.log10(1 + z("n")), F.lit(0.9))
    market = F.least(1 + F.log10(1 + z("liquidity") / 1e4) + 0.5 * F.log10(1 + z("volume_24h") / 1e4), F.lit(4.0))
    return (F.when(F.col("source") == "manifold", play).when(F.col("kind") == "market", market).when(F.col("source") == "options", 3.0)
            .when(F.col("source") == "earnings", 0.5 + 0.1 * F.least(z("n"), F.lit(12.0))).otherwise(1.0))


def contest_weight(spread: Column) -> Column:
    return F.when(spread.isNull(), 1.0).otherwise(1 / (1 + F.greatest(spread - 0.02, F.lit(0.0)) / 0.05))


def pool(books: DataFrame, refs: DataFrame, min_band: float = MIN_BAND) -> DataFrame:
    """Log-odds pool of the contest mid and the references; the band comes from the references alone.

    books: contract_id, mid, spread. refs: contract_id, p, invert, source, kind, liquidity, volume_24h, n, bid, ask.
    Contracts without a reference or a mid give no row."""
    p = F.when(F.col("invert"), 1 - F.col("p")).otherwise(F.col("p"))
    r = refs.withColumns({"_p": p, "_w": source_weight()})
    r = r.groupBy("contract_id").agg(
        F.sum("_w").alias("_W"), F.sum(F.col("_w") * logit(F.col("_p"))).alias("_L"), F.sum(F.col("_w") * F.col("_p")).alias("_P"),
        F.sum(F.col("_w") * F.col("_p") * F.col("_p")).alias("_PP"), F.max((F.col("ask") - F.col("bid")) / 2).alias("_half"), F.count(F.lit(1)).alias("n_refs"))
    j = books.where("mid is not null").join(r, "contract_id").withColumn("_cw", contest_weight(F.col("spread")))
    mean = F.col("_P") / F.col("_W")
    spread = F.sqrt(F.greatest(F.col("_PP") / F.col("_W") - mean * mean, F.lit(0.0)))
    j = j.withColumns({"p": sigmoid((F.col("_cw") * logit(F.col("mid")) + F.col("_L")) / (F.col("_cw") + F.col("_W"))),
                       "_b": F.greatest(F.lit(float(min_band)), spread, F.coalesce("_half", F.lit(0.0)))})
    return j.withColumns({"lo": F.greatest(F.col("p") - F.col("_b"), F.lit(0.0)), "hi": F.least(F.col("p") + F.col("_b"), F.lit(1.0))}).drop(
        "_W", "_L", "_P", "_PP", "_half", "_cw", "_b")


def screen(est: DataFrame, now: Column, contest_end: Column, min_edge: float = MIN_EDGE, minutes: int = MIN_MINUTES) -> DataFrame:
    """Contracts worth proposing: still open, an ask inside (0, 1), enough edge, the band above the ask."""
    a = F.col("best_ask")
    d = est.where(F.col("closes_at").isNull() | (F.col("closes_at") >= now + F.expr(f"interval {minutes} minutes")))
    d = d.where((a > 0) & (a < 1)).withColumn("edge", F.col("p") - a).where((F.col("edge") >= min_edge) & (F.col("lo") > a))
    flags = F.array_compact(F.array(F.when(~F.col("confirmed"), "mapping not confirmed"),
                                    F.when(F.col("resolves_at") > contest_end, "resolves after the contest ends")))
    return d.withColumns({"kelly": kelly_yes("p", "best_ask"), "flags": flags})


def size(cands: DataFrame, accounts: DataFrame, held: DataFrame, mode: str = "steady", by: Sequence[str] = ("account_id",),
         share: float = KELLY_SHARE, max_fraction: float = MAX_FRACTION, max_stake: float | None = None) -> DataFrame:
    """Stake of each candidate in order of Kelly fraction; cash is used up in that order.

    Serving wants w1, w2, ... from cash c in order gives min(c, w1 + .. + wi) - min(c, w1 + .. + w(i-1)).
    Prize mode outside the top three puts everything on the first. Kelly is a target, so holdings count."""
    by = list(by)
    j = cands.join(accounts.select(*by, "cash", "equity", "in_top3"), by).join(held.select(*by, "contract_id", "qty"), [*by, "contract_id"], "left")
    cash, eq = F.greatest("cash", F.lit(0.0)), F.greatest("equity", F.lit(0.0))
    have = F.coalesce("qty", F.lit(0.0)) * F.col("best_ask")
    target = share * F.col("kelly") * eq
    if mode == "steady":
        target = F.least(target, max_fraction * eq)
    cap = F.lit(float("inf") if max_stake is None else float(max_stake))
    want = F.least(F.greatest(target - have, F.lit(0.0)), F.greatest(cap - have, F.lit(0.0)))
    w = Window.partitionBy(*by).orderBy(F.col("kelly").desc(), "contract_id")  # candidates of one account
    j = j.withColumns({"_want": want, "rank": F.row_number().over(w)})
    upto = F.sum("_want").over(w.rowsBetween(Window.unboundedPreceding, 0))
    stake = F.least(cash, upto) - F.least(cash, upto - F.col("_want"))
    if mode == "prize":
        allin = F.when(F.col("rank") == 1, F.least(cash, cap)).otherwise(0.0)
        stake = F.when(F.col("in_top3"), stake).otherwise(allin)
    return j.withColumn("policy_stake", stake).drop("_want", "qty", "cash", "equity", "in_top3")


def fill_plan(asks: Column, max_price: Column, budget: Column) -> Column:
    """Walk the asks while the price is good and money remains: struct(qty, cost, limit); whole contracts."""
    start = F.struct(F.lit(0).cast("long").alias("qty"), F.lit(0.0).alias("cost"), F.coalesce(F.get(asks, F.lit(0))["price"], F.lit(0.0)).alias("limit"),
                     F.lit(False).alias("done"))

    def step(s: Column, x: Column) -> Column:
        px = x["price"]
        take = F.least(F.floor(x["size"]).cast("long"), F.floor((budget - s["cost"]) / px).cast("long"))
        stop = s["done"] | (px > max_price + 1e-12) | (budget - s["cost"] < px) | (take <= 0)
        return F.struct(F.when(stop, s["qty"]).otherwise(s["qty"] + take).alias("qty"), F.when(stop, s["cost"]).otherwise(s["cost"] + take * px).alias("cost"),
                        F.when(stop, s["limit"]).otherwise(px).alias("limit"), stop.alias("done"))

    return F.aggregate(asks, start, step)


def build(sized: DataFrame, now: Column, min_edge: float = MIN_EDGE) -> DataFrame:
    """Proposal rows: what the book can fill with edge, the reasoning, and when it expires."""
    d = sized.withColumn("_f", fill_plan(F.col("asks"), F.col("p") - min_edge, F.col("policy_stake")))
    short = (F.col("policy_stake") > 0) & (F.col("_f.qty") < F.floor(F.col("policy_stake") / F.col("best_ask")))
    why = F.format_string("Buy at %.2f: pooled probability %.2f [%.2f, %.2f], edge %.2f, Kelly %.3f of equity", "best_ask", "p", "lo", "hi", "edge", "kelly")
    return d.withColumns({
        "qty": F.col("_f.qty"), "stake": F.col("_f.cost"), "limit_price": F.col("_f.limit"), "rationale": why,
        "flags": F.when(short, F.array_append("flags", F.lit("sized to the book"))).otherwise(F.col("flags")),
        "created": now, "expires": now + F.expr(f"interval {TTL_MINUTES} minutes"), "status": F.lit("pending"),
    }).drop("_f")


def pre_trade_check(props: DataFrame, fresh: DataFrame, accounts: DataFrame, now: Column, by: Sequence[str] = ("account_id",),
                    max_stake: float | None = None, min_edge: float = MIN_EDGE, minutes: int = MIN_MINUTES) -> DataFrame:
    """Reason a proposal may not go out, or "ok"; compared with a fresh book (contract_id, ask_now, closes_now)."""
    j = props.join(fresh.select("contract_id", "ask_now", "closes_now", F.lit(True).alias("_listed")), "contract_id", "left").join(
        accounts.select(*by, F.col("cash").alias("_cash")), list(by), "left")
    over = F.lit(False) if max_stake is None else F.col("stake") > max_stake + 1e-9
    reason = (
        F.when(F.col("_listed").isNull(), "market no longer listed")
        .when(F.col("closes_now") < now + F.expr(f"interval {minutes} minutes"), "market closes too soon")
        .when(~F.coalesce("confirmed", F.lit(False)), "mapping not confirmed").when((F.col("stake") < 0) | (F.col("stake") > F.col("_cash") + 1e-9), "exceeds cash")
        .when(over, "exceeds the position limit").when(F.col("stake") == 0, "forecast only").when(F.col("ask_now").isNull(), "no ask in the book")
        .when(F.col("p") - F.col("ask_now") < min_edge, "edge gone").otherwise("ok"))
    return j.withColumn("reason", reason).withColumn("allowed", F.col("reason").isin("ok", "forecast only")).drop("_listed", "_cash")


def cool_down(new: DataFrame, log: DataFrame, now: Column, hours: int = COOL_HOURS, move: float = MOVE) -> DataFrame:
    """Drop proposals of contracts decided recently unless the probability or the ask moved."""
    done = log.where(F.col("status").isin("executed", "logged", "skipped", "rejected") & (F.col("decided") >= now - F.expr(f"interval {hours} hours")))
    last = done.groupBy("contract_id").agg(F.max_by(F.struct("p", "best_ask"), F.col("created")).alias("_l"))
    j = new.join(last, "contract_id", "left")
    moved = F.col("_l").isNull() | (F.abs(F.col("p") - F.col("_l.p")) >= move) | (F.abs(F.col("best_ask") - F.col("_l.best_ask")) >= move)
    return j.where(moved).drop("_l")


def merge_pending(new: DataFrame, pending: DataFrame, now: Column) -> DataFrame:
    """What happens to each contract's pending proposal: keep, expire, replace, or add a new one."""
    n = new.select("contract_id", F.struct("p", "best_ask", "stake").alias("_n"))
    o = pending.select("contract_id", F.struct("p", "best_ask", "stake", "expires").alias("_o"))
    j = n.join(o, "contract_id", "full")
    same = (F.abs(F.col("_n.best_ask") - F.col("_o.best_ask")) < 1e-9) & (F.abs(F.col("_n.p") - F.col("_o.p")) < 0.005) & (
        F.abs(F.col("_n.stake") - F.col("_o.stake")) < 1e-6) & (F.col("_o.expires") >= now)
    action = F.when(F.col("_o").isNull(), "add").when(F.col("_n").isNull(), "expire").when(F.coalesce(same, F.lit(False)), "keep").otherwise("replace")
    return j.select("contract_id", action.alias("action"))


def positions(held: DataFrame, books: DataFrame, accounts: DataFrame, by: Sequence[str] = ("account_id",)) -> DataFrame:
    """Holdings marked to the mid (to cost without one), with PnL and the account's equity."""
    j = held.join(books.select("contract_id", "mid"), "contract_id", "left").withColumn("mark", F.coalesce("mid", "avg_price"))
    j = j.withColumns({"value": F.col("qty") * F.col("mark"), "pnl": F.col("qty") * (F.col("mark") - F.col("avg_price"))}).drop("mid")
    tot = j.groupBy(*by).agg(F.sum("value").alias("_v"))
    eq = accounts.select(*by, "cash").join(tot, list(by), "left").select(*by, (F.col("cash") + F.coalesce("_v", F.lit(0.0))).alias("equity"))
    return j.join(eq, list(by), "left")

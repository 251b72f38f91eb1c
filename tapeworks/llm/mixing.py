"""Mixing sources to target weights (operator 4) by hash-threshold histograms.

Every row has a place: the first 60 bits of the MD5 of its id and size. A source takes each row a whole number of times
and, for what is left of its target, the rows whose place is below a threshold. The threshold comes from sums of words by
source and place bucket: the first bucket in which the running sum passes the budget is the boundary; only its rows
are summed again by the next digit of their place, until one place is left, which is taken if that brings the sum nearer.
Rows are filtered by the threshold and never sorted. Several budgets of one source give nested selections.

Edge cases: a NULL text has size 0; a NULL source is a source of its own; rows with the same place (repeated rows) are
taken or left together; a source of size 0 has target 0 and takes nothing; an empty table gives no rows; other columns of
the input are ignored. Sums of sizes are exact, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.shared import stored
from tapeworks.llm.common import WORD

PLACE_BITS, DIGIT_BITS = 60, 12
TOTAL, AT_MOST, WEIGHTS = 1.5, 2.0, (3.0, 1.0, 2.0)


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, place) of every row; size counts words."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("size").cast("string"))
    return rows.withColumn("place", F.conv(F.substring(F.md5(key.cast("binary")), 1, PLACE_BITS // 4), 16, 10).cast("long"))


def ranked_weights(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Add a weight to each of a list of sources: `weights` in turn, by code point of the name, NULL last."""
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.array(*map(F.lit, weights))[F.pmod(turn, F.lit(len(weights)))])


def targets(sources: DataFrame, total: float = TOTAL, at_most: float = AT_MOST) -> DataFrame:
    """Add to (source, source_size, weight) the target: `total` times all sizes, shared by weight, no source above `at_most` times its size.

    What a source can't take is shared among the others by weight, until none is above; each round is one sum.
    """
    sources = stored(sources)
    all_sizes = sources.agg(F.sum("source_size")).first()[0] or 0
    most = F.col("source_size") * at_most
    full, free = F.lit(False), (total * all_sizes, 1.0)
    before = -1
    while True:
        s = sources.withColumn("_full", full).agg(F.count(F.when(F.col("_full"), 1)), F.sum(F.when(F.col("_full"), most)), F.sum(F.when(~F.col("_full"), F.col("weight")))).first()
        free = (total * all_sizes - (s[1] or 0.0), s[2] or 1.0)
        if s[0] == before:
            break
        before, full = s[0], full | (F.lit(free[0]) * F.col("weight") / F.lit(free[1]) > most)
    return sources.withColumn("target", F.when(full, most).otherwise(F.lit(free[0]) * F.col("weight") / F.lit(free[1])))


def thresholds(units: DataFrame, budgets: DataFrame) -> DataFrame:
    """Add to (source, budget, ...) the place `below` which the sizes of `units` (source, place, size) come nearest to the budget."""
    names = [c for c in budgets.columns]
    state = budgets.withColumn("_prefix", F.lit(0).cast("long")).withColumn("_base", F.lit(0).cast("long")).withColumn("below", F.lit(None).cast("long"))
    done = None
    units = units.select(F.col("source").alias("_s"), "place", "size")
    for left in range(PLACE_BITS - DIGIT_BITS, -1, -DIGIT_BITS):
        digit = F.shiftright("place", left)
        inside = units.join(state, F.col("_s").eqNullSafe(F.col("source")) & (F.shiftright("place", left + DIGIT_BITS) == F.col("_prefix")))
        sums = inside.groupBy(*names, "_base", digit.alias("_d")).agg(F.sum("size").alias("_n"))
        w = Window.partitionBy(*names).orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)  # at most 2 ** DIGIT_BITS rows
        sums = sums.withColumn("_upto", F.col("_base") + F.sum("_n").over(w))
        over = sums.where(F.col("_upto") > F.col("budget")).groupBy(*names).agg(F.min(F.struct("_d", "_upto", "_n")).alias("_b"))
        near = stored(over.select(*names, F.col("_b._d").alias("_prefix"), (F.col("_b._upto") - F.col("_b._n")).alias("_base"), F.when(2 * F.col("_b._upto") - F.col("_b._n") <= 2 * F.col("budget"), F.col("_b._d") + 1).otherwise(F.col("_b._d")).alias("below")))
        state = near
        done = near if left == 0 else done
    kept = done.select(*[F.col(c).alias(f"_k_{c}") for c in names], "below")
    same = None
    for c in names:
        same = F.col(c).eqNullSafe(F.col(f"_k_{c}")) if same is None else same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return budgets.join(kept, same, "left").select(*names, F.coalesce("below", F.lit(1 << PLACE_BITS)).alias("below"))  # no boundary: all of it fits


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, at_most: float = AT_MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of docs (doc_id, text, source)."""
    units = stored(sized(docs))
    sources = units.groupBy("source").agg(F.sum("size").alias("source_size"))
    planned = targets(ranked_weights(sources, weights), total, at_most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    planned = planned.select("source", "source_size", "target", whole.alias("times"), (F.col("target") - whole * F.col("source_size")).alias("budget"))
    cuts = thresholds(units, planned).select(F.col("source").alias("_s"), "source_size", "target", "times", "below")
    rows = units.join(cuts, F.col("source").eqNullSafe(F.col("_s")))
    taken = F.col("size") * (F.col("times") + (F.col("place") < F.col("below")).cast("long"))
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


_CASES = " ".join(f"when {i} then {w}" for i, w in enumerate(WEIGHTS))
SQL = f"""
with units as (select doc_id, source, size, cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':' || cast(size as varchar)), 1, 15) as bigint) as place
  from (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) as bigint) as size from documents)),
sources as (select source, cast(sum(size) as bigint) as source_size from units group by source),
weighed as (select *, cast(case (row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)} {_CASES} end as double) as w from sources),
capped as (select *, {AT_MOST}::double * source_size < ({TOTAL}::double * sum(source_size) over () - {AT_MOST}::double * coalesce(sum(source_size) over (order by source_size / w, source rows between unbounded preceding and 1 preceding), 0))
    * w / sum(w) over (order by source_size / w, source rows between current row and unbounded following) as is_full from weighed),
planned as (select source, source_size, case when is_full then {AT_MOST}::double * source_size else
    ({TOTAL}::double * sum(source_size) over () - coalesce(sum({AT_MOST}::double * source_size) filter (is_full) over (), 0)) * w / sum(w) filter (not is_full) over () end as target from capped),
budgets as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as times from planned),
groups as (select source, place, sum(size) as own from units group by source, place),
upto as (select *, sum(own) over (partition by source order by place) as upto from groups)
select u.doc_id, u.size, b.source_size, b.target, cast(u.size * (b.times + case when 2 * g.upto - g.own <= 2 * (b.target - b.times * b.source_size) then 1 else 0 end) as bigint) as taken
from units u join budgets b on u.source is not distinct from b.source join upto g on u.source is not distinct from g.source and u.place = g.place
"""

"""URL filters by a temporal list join (operator 2), in DataFrame functions only.

Lists are logs of dated entries (added, removed); consecutive events of an entry become validity intervals. A capture is
tested against the entries that were active on the day it was fetched: its host's suffixes and its path's prefixes, no
longer than the longest entry of each kind, are joined by equality with the entries and the interval picks the version.
Distinct (url, day) are evaluated once, so a page fetched a million times is one row in the join. The most specific active
entry decides: an exact URL before a path prefix before a host, the longer entry first, allow before block.

Edge cases: a NULL or unparsable URL has an empty host, matches no host or prefix entry and gets verdict `none`; a
NULL fetch day matches nothing; an entry added and removed on one day counts as removed; repeated events count once; NULL
entries and dates are ignored; repeated captures are each returned; without entries every verdict is `none`; an empty
table gives no rows; further columns of the captures are kept, those with the name of a column of the result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeworks.llm.common import read

KINDS = ("host", "prefix", "exact")  # less to more specific


def host(url: Column) -> Column:
    """Lower-case host without user, port and last dot; empty if there is none."""
    return F.regexp_replace(F.lower(F.coalesce(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit(""))), "\\.$", "")


def path(url: Column) -> Column:
    """The path, `/` if empty."""
    got = F.coalesce(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.when(got == "", "/").otherwise(got)


def intervals(events: DataFrame) -> DataFrame:
    """(list, action, kind, entry, since, until) from (list, action, kind, entry, day, added): until is excluded, NULL if open."""
    once = events.where(F.col("entry").isNotNull() & F.col("day").isNotNull()).groupBy("list", "action", "kind", "entry", "day").agg(F.min("added").alias("added"))
    w = Window.partitionBy("list", "action", "kind", "entry").orderBy("day")  # a row for a day at most
    spans = once.withColumn("_was", F.lag("added").over(w)).where(~F.col("added").eqNullSafe(F.col("_was")))
    return spans.withColumn("until", F.lead("day").over(w)).where("added").select("list", "action", "kind", "entry", F.col("day").alias("since"), "until")


def screen(captures: DataFrame, events: DataFrame, url: str = "url", day: str = "day") -> DataFrame:
    """Add host, n_active, verdict (block, allow, none), entry and since of the entry that decides to every capture."""
    spans = intervals(events)
    size = F.when(F.col("kind") == "host", F.size(F.split("entry", "\\."))).otherwise(F.size(F.split("entry", "/")) - 1)
    most = spans.where(F.col("kind") != "exact").groupBy("kind").agg(F.max(size).alias("n"))
    depth = {r["kind"]: r["n"] for r in most.collect()}  # two rows at most
    asked = captures.select(F.col(url).alias("_url"), F.col(day).alias("_day")).where("_url is not null and _day is not null").distinct()
    labels, parts = F.split(host(F.col("_url")), "\\."), F.split(path(F.col("_url")), "/")
    hosts = F.when(host(F.col("_url")) != "", F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(depth.get("host", 1), 1)))), lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")))
    above = F.transform(F.sequence(F.lit(1), F.least(F.size(parts) - 1, F.lit(max(depth.get("prefix", 1), 1)))), lambda n: F.concat(host(F.col("_url")), F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))
    prefixes = F.when(host(F.col("_url")) != "", above)
    keyed = lambda kind, keys: F.transform(F.coalesce(keys, F.array().cast("array<string>")), lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("entry")))
    keys = F.concat(keyed("host", hosts), keyed("prefix", prefixes), F.array(F.struct(F.lit("exact").alias("kind"), F.col("_url").alias("entry"))))
    wanted = asked.select("_url", "_day", F.explode(keys).alias("_k")).select("_url", "_day", "_k.kind", "_k.entry")
    active = wanted.join(spans, ["kind", "entry"]).where((F.col("since") <= F.col("_day")) & (F.col("until").isNull() | (F.col("_day") < F.col("until"))))
    rank = F.struct(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("r"), F.length("entry").alias("l"), (F.col("action") == "allow").alias("a"), F.col("entry").alias("entry"), F.col("since").alias("since"), F.col("action").alias("action"))
    verdicts = active.groupBy("_url", "_day").agg(F.count(F.lit(1)).alias("_active"), F.max(rank).alias("_best"))
    out = captures.join(verdicts, (F.col(url) == F.col("_url")) & (F.col(day) == F.col("_day")), "left")
    new = ("host", "n_active", "verdict", "entry", "since")
    return out.select(*[captures[f"`{c}`"] for c in captures.columns if c not in new], host(captures[url]).alias("host"), F.coalesce("_active", F.lit(0)).cast("long").alias("n_active"),
                      F.coalesce("_best.action", F.lit("none")).alias("verdict"), F.col("_best.entry").alias("entry"), F.col("_best.since").alias("since"))


def _offset(key: Column, days: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, 6), 16, 10).cast("int"), F.lit(days))


def lists_of_pages(pages: DataFrame) -> DataFrame:
    """Lists made from the pages' own hosts: each host is blocked for two spells, each registered name allowed and each first
    folder blocked from some day on; the days follow from a hash of the entry."""
    start = F.to_date(F.lit("2024-01-01"))
    urls = pages.where("url is not null").select(host(F.col("url")).alias("h"), path(F.col("url")).alias("p")).where("h <> ''").distinct()
    hosts = urls.select("h").distinct()
    spell = F.explode(F.array(*[F.struct(F.lit(d).alias("after"), F.lit(a).alias("added")) for d, a in ((0, True), (60, False), (120, True), (150, False))]))
    spam = hosts.select(F.lit("spam").alias("list"), F.lit("block").alias("action"), F.lit("host").alias("kind"), F.col("h").alias("entry"), spell.alias("s")).select("list", "action", "kind", "entry", F.date_add(start, _offset(F.col("entry"), 300) + F.col("s.after")).alias("day"), F.col("s.added").alias("added"))
    names = hosts.select(F.substring_index("h", ".", -2).alias("entry")).distinct()
    partners = names.select(F.lit("partners").alias("list"), F.lit("allow").alias("action"), F.lit("host").alias("kind"), "entry", F.date_add(start, _offset(F.col("entry"), 365)).alias("day"), F.lit(True).alias("added"))
    folders = urls.select(F.concat("h", F.lit("/"), F.split("p", "/")[1], F.lit("/")).alias("entry")).where("not endswith(entry, '//')").distinct()
    sections = folders.select(F.lit("sections").alias("list"), F.lit("block").alias("action"), F.lit("prefix").alias("kind"), "entry", F.date_add(start, _offset(F.col("entry"), 700)).alias("day"), F.lit(True).alias("added"))
    return spam.unionByName(partners).unionByName(sections)


def screen_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a capture (a day from its id) against the lists made from the pages."""
    pages = read(spark, sf_dir, "pages")
    day = F.date_add(F.to_date(F.lit("2024-01-01")), F.pmod(F.coalesce("page_id", F.lit(0)) * 7919, F.lit(365)).cast("int"))
    got = screen(pages.select("page_id", "url", day.alias("day")), lists_of_pages(pages))
    return got.select("page_id", "url", F.col("day").cast("string").alias("day"), "host", "n_active", "verdict", "entry", F.col("since").cast("string").alias("since"))


SQL = """
with c as (select page_id, url, date '2024-01-01' + cast(coalesce(page_id, 0) * 7919 % 365 as integer) as day,
    regexp_replace(lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1), '')), '\\.$', '') as host,
    case when coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '') = '' then '/' else regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) end as path from pages),
e as (select distinct 'block' as action, 1 as r, host as entry, 300 as m from c where host <> ''
  union all select distinct 'allow', 1, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.'), 365 from c where host <> ''
  union all select distinct 'block', 2, host || '/' || string_split(path, '/')[2] || '/', 700 from c where host <> '' and string_split(path, '/')[2] <> ''),
d as (select *, date '2024-01-01' + cast(('0x' || substr(md5(entry), 1, 6))::bigint % m as integer) as first from e),
spans as (select action, r, entry, cast(first as date) as since, cast(case when m = 300 then first + 60 end as date) as until from d
  union all select action, r, entry, cast(first + 120 as date), cast(first + 150 as date) from d where m = 300),
active as (select c.page_id, c.url, c.day, s.* from c join spans s on (s.r = 1 and c.host <> '' and (c.host = s.entry or ends_with(c.host, '.' || s.entry)))
    and s.since <= c.day and (s.until is null or c.day < s.until) 
  union all select c.page_id, c.url, c.day, s.* from c join spans s on s.r = 2 and c.host <> '' and c.host || '/' || string_split(c.path, '/')[2] || '/' = s.entry and len(string_split(c.path, '/')) > 2
    and s.since <= c.day and (s.until is null or c.day < s.until)),
best as (select page_id, count(*) as n_active, max(struct_pack(r := r, l := len(entry), a := action = 'allow', entry := entry, since := since, action := action)) as b from active group by page_id)
select c.page_id, c.url, cast(cast(c.day as date) as varchar) as day, c.host, coalesce(n_active, 0) as n_active, coalesce(b.action, 'none') as verdict, b.entry as entry, cast(b.since as varchar) as since
from c left join best using (page_id)
"""

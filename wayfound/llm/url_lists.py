"""URL filtering against dated lists: entries become validity intervals, and every capture is judged by the entries active on its fetch day.
DataFrame functions only."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def host_of(url: Column) -> Column:
    """Lower-case host without port and user; null where the url has none."""
    return F.nullif(F.lower(F.regexp_extract(F.trim(url.cast("string")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)), F.lit(""))


def section_of(url: Column) -> Column:
    """First path segment, empty without one."""
    return F.regexp_extract(F.trim(url.cast("string")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)", 1)


def url_keys(host: Column, section: Column) -> Column:
    """Keys that list entries can name, as array<struct<rank, key>>: host/section (rank 1000), the host (its number of labels), and its parent domains of
    two labels or more. The greatest rank is the most specific."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: F.struct((n - i).alias("rank"), F.array_join(F.slice(labels, i + 1, n), ".").alias("key")))
    return F.concat(F.array(F.struct(F.lit(1000).alias("rank"), F.concat(host, F.lit("/"), section).alias("key"))), domains)


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list, key, action, valid_from, valid_to) from dated entries (list, key, action, change, day).

    ``change`` is 'add' or 'remove'; an entry is active from its 'add' to the day before the next 'remove' (null: still active). Repeated changes count
    once; where one day both adds and removes, the addition stands. Rows with a null list, key, action or day, or another change, are no entries."""
    key = ["list", "key", "action"]
    daily = entries.filter(F.col("change").isin("add", "remove")).dropna(subset=[*key, "day"]).groupBy(*key, "day").agg(F.max(F.col("change") == "add").alias("on"))
    line = W.partitionBy(*key).orderBy("day")
    changes = daily.withColumn("_was", F.lag("on", 1, False).over(line)).filter(F.col("on") != F.col("_was"))
    return changes.withColumn("valid_to", F.lead("day").over(line)).filter("on").select(*key, F.col("day").alias("valid_from"), "valid_to")


def active_entries(probes: DataFrame, intervals: DataFrame) -> DataFrame:
    """As-of join: for each distinct (key, day) of ``probes`` the intervals that hold on that day.

    One line per key, list and action carries interval starts and probes in day order; the last start at or before a probe decides. Probes are
    distinct days, so a host with a third of all captures adds no more than its days."""
    line = ["key", "list", "action"]
    lists = intervals.select(*line).distinct()
    asked = probes.select("key", "day").distinct().join(lists, "key").select(*line, "day", F.lit(True).alias("ask"), F.lit(None).cast("struct<a:date,b:date>").alias("span"))
    starts = intervals.select(*line, F.col("valid_from").alias("day"), F.lit(False).alias("ask"), F.struct(F.col("valid_from").alias("a"), F.col("valid_to").alias("b")).alias("span"))
    upto = W.partitionBy(*line).orderBy("day").rangeBetween(W.unboundedPreceding, W.currentRow)
    seen = asked.unionByName(starts).withColumn("span", F.last("span", True).over(upto)).filter("ask and span is not null")
    return seen.filter("span.b is null or day < span.b").select(*line, "day", F.col("span.a").alias("valid_from"), F.col("span.b").alias("valid_to"))


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Every capture (its columns, with ``url`` and ``day``) plus host, verdict ('block', 'allow' or 'unlisted'), list_key, list_name, active_from and
    n_active (active entries on any of its keys).

    The most specific active entry decides; at the same key 'allow' beats 'block', then the first list name. A url without a host or a null day is
    'unlisted'. Verdicts are found once per distinct host, section and day and joined back, so repeated urls cost nothing; empty tables give
    empty or unlisted results."""
    seen = captures.select(F.struct("*").alias("_row"), host_of(F.col("url")).alias("_host"), F.col("url").alias("_url"), F.col("day").alias("_on"))            # columns of any name
    seen = seen.withColumn("_section", F.when(F.col("_host").isNotNull(), section_of(F.col("_url"))))
    sites = seen.filter("_host is not null and _on is not null").select("_host", "_section", F.col("_on").alias("_day")).distinct()
    keys = sites.withColumn("_k", F.explode(url_keys(F.col("_host"), F.col("_section")))).select("_host", "_section", "_day", F.col("_k.key").alias("key"), F.col("_k.rank").alias("rank"))
    active = active_entries(keys.select("key", F.col("_day").alias("day")), validity_intervals(entries)).withColumnRenamed("day", "_day")
    order = F.struct((-F.col("rank")).alias("r"), F.col("action").alias("a"), F.col("list").alias("l"), F.col("key").alias("k"), F.col("valid_from").alias("f"))
    verdicts = keys.join(active, ["key", "_day"]).groupBy("_host", "_section", "_day").agg(F.min(order).alias("_best"), F.count("*").alias("_n"))
    verdicts = verdicts.select(*[F.col(c).alias("v" + c) for c in ("_host", "_section", "_day")], "_best", "_n")
    on = (F.col("_host") == F.col("v_host")) & (F.col("_section") == F.col("v_section")) & (F.col("_on") == F.col("v_day"))
    out = seen.join(verdicts, on, "left")
    return out.select("_row.*", F.col("_host").alias("host"), F.coalesce("_best.a", F.lit("unlisted")).alias("verdict"), F.col("_best.k").alias("list_key"),
                      F.col("_best.l").alias("list_name"), F.col("_best.f").alias("active_from"), F.coalesce("_n", F.lit(0)).cast("long").alias("n_active"))


# --- the registered query: fetch days and list entries drawn from the pages themselves
START, DAYS = "2024-01-01", 366


def page_captures(pages: DataFrame) -> DataFrame:
    """page_id, url and a fetch day spread over a year by page_id."""
    return pages.select("page_id", "url", F.date_add(F.lit(START).cast("date"), F.pmod(F.col("page_id") * 7919, F.lit(DAYS)).cast("int")).alias("day"))


def page_entries(pages: DataFrame) -> DataFrame:
    """Every fifth page reports its host, section or parent domain to one of two lists on some day: an entry is added or removed."""
    told = pages.filter("page_id % 5 = 0").select("page_id", host_of(F.col("url")).alias("host"), section_of(F.col("url")).alias("section"))
    i = F.col("page_id")
    parent = F.array_join(F.slice(F.split("host", r"\."), 2, 1000), ".")
    key = F.when(i % 3 == 0, F.concat("host", F.lit("/"), "section")).when(i % 3 == 1, F.col("host")).otherwise(parent)
    return told.select(F.when(i % 2 == 0, "abuse").otherwise("review").alias("list"), key.alias("key"), F.when(i % 4 == 3, "allow").otherwise("block").alias("action"),
                       F.when(F.floor(i / 5) % 4 < 2, "add").otherwise("remove").alias("change"),
                       F.date_add(F.lit(START).cast("date"), F.pmod(i * 104729, F.lit(DAYS)).cast("int")).alias("day"))


def judged_pages(pages: DataFrame) -> DataFrame:
    return filter_urls(page_captures(pages), page_entries(pages))


URL_SQL = r"""
with c as (select page_id, url, nullif(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '') as host,
  regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1) as section, date '2024-01-01' + cast((page_id * 7919) % 366 as int) as day from pages),
e as (select case when page_id % 2 = 0 then 'abuse' else 'review' end as list,
  case page_id % 3 when 0 then host || '/' || section when 1 then host else array_to_string(list_slice(string_split(host, '.'), 2, 1000), '.') end as key,
  case when page_id % 4 = 3 then 'allow' else 'block' end as action, (page_id // 5) % 4 < 2 as on_, date '2024-01-01' + cast((page_id * 104729) % 366 as int) as day from c where page_id % 5 = 0),
n as (select list, key, action, day, max(on_) as on_ from e where key is not null group by all),
g as (select *, lag(on_, 1, false) over (partition by list, key, action order by day) as was from n),
i as (select list, key, action, on_, day as valid_from, lead(day) over (partition by list, key, action order by day) as valid_to from g where on_ <> was),
s as (select distinct host, section, day from c where host is not null and day is not null),
k as (select host, section, day, 1000 as rank, host || '/' || section as key from s
  union all select host, section, day, len(string_split(host, '.')) - j, array_to_string(list_slice(string_split(host, '.'), j + 1, 1000), '.')
  from (select host, section, day, unnest(range(0, greatest(len(string_split(host, '.')) - 2, 0) + 1)) as j from s)),
b as (select k.host, k.section, k.day, count(*) as n, min(struct_pack(r := -k.rank, a := i.action, l := i.list, k := i.key, f := i.valid_from)) as best
  from k join i on k.key = i.key and i.on_ and k.day >= i.valid_from and (i.valid_to is null or k.day < i.valid_to) group by all)
select c.page_id, c.url, c.day, c.host, coalesce(best.a, 'unlisted') as verdict, best.k as list_key, best.l as list_name, best.f as active_from, coalesce(n, 0) as n_active
from c left join b on c.host = b.host and c.section = b.section and c.day = b.day"""

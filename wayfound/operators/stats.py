"""Aggregate reports: rates by scope, coverage, counts, dashboards, link context."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions._col import text
from .scale import mode_value, ranked, top_rows


def group_mode(df: DataFrame, by, value: str, out: str = "mode", ignore: Column | None = None) -> DataFrame:
    """Most frequent value per key, the smallest on ties. Rows under ``ignore`` only count for keys that have no others."""
    if ignore is None:
        return mode_value(df, by, value, out)
    plain = mode_value(df.filter(~ignore), by, value, "_a")
    every = mode_value(df, by, value, "_b")
    on = [plain[k].eqNullSafe(every[k]) for k in by]
    return every.join(plain, on, "left").select(*[every[k] for k in by], F.coalesce("_a", "_b").alias(out))


def majority_value(df: DataFrame, by: str, value: str, min_n: int = 3, min_share: float = 0.5) -> DataFrame:
    """(by, value): the top value of groups with enough values and a large enough share."""
    d = df.filter(F.col(value).isNotNull() & F.col(by).isNotNull())
    n = d.groupBy(by, value).agg(F.count("*").alias("n"))
    total = n.groupBy(F.col(by).alias("_b")).agg(F.sum("n").alias("total"))
    best = top_rows(n, [by], [F.desc("n"), F.asc(value)])
    return best.join(total, F.col(by) == F.col("_b")).filter((F.col("total") >= min_n) & (F.col("n") >= min_share * F.col("total"))).select(by, value)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(column))


def match_rates(df: DataFrame, *, group: str, kind: str, region: str, current: Column, any_: Column) -> DataFrame:
    """n and match rates by (group, kind), statewide (region null, scope 'statewide') and per region, in one pass."""
    base = df.select(F.col(group).alias("grp"), F.col(kind).alias("kind"), F.col(region).alias("region"), current.cast("double").alias("c"), any_.cast("double").alias("a"))
    sets = base.groupingSets([["grp", "kind"], ["region", "grp", "kind"]], "region", "grp", "kind")
    out = sets.agg(F.grouping("region").alias("g"), F.count("*").alias("n"), F.round(F.avg("c"), 3).alias("current"), F.round(F.avg("a"), 3).alias("any"))
    return out.filter((F.col("g") == 1) | F.col("region").isNotNull()) \
        .select(F.when(F.col("g") == 1, F.lit("statewide")).otherwise(F.col("region")).alias("scope"), "grp", "kind", "n", "current", "any")


def coverage_report(licenses: DataFrame, listings: DataFrame, by: str, *, found: Column, placed: Column, matched: Column) -> DataFrame:
    """Per area: licenses, share found, share placed; joined to listings and their matched share (null where there are none)."""
    a = licenses.groupBy(by).agg(F.count("*").alias("licenses"), F.round(F.avg(found.cast("double")), 3).alias("found"), F.round(F.avg(placed.cast("double")), 3).alias("placed"))
    b = listings.groupBy(F.col(by).alias("_b")).agg(F.count("*").alias("listings"), F.round(F.avg(matched.cast("double")), 3).alias("matched"))
    return a.join(b, F.col(by) == F.col("_b"), "left").drop("_b")


def mention_counts(reviews: DataFrame, patterns: dict[str, str], *, by: str, text_col="text", rating="rating", prefilter: str | None = None) -> DataFrame:
    """Per business and pattern: matching reviews and the mean rating of just those. One scan; a cheap prefilter drops most rows first."""
    low = F.lower(text(text_col))
    df = reviews.select(F.col(by), low.alias("_t"), F.col(rating).alias("_r"))
    df = df.filter(F.col("_t").rlike(prefilter)) if prefilter else df
    flags = df.select(by, "_r", *[F.col("_t").rlike(rx).alias("h_" + k) for k, rx in patterns.items()])
    flags = flags.filter(F.greatest(*[F.col("h_" + k) for k in patterns]) if len(patterns) > 1 else F.col("h_" + next(iter(patterns))))
    return flags.groupBy(by).agg(*[F.count_if("h_" + k).alias("n_" + k) for k in patterns],
                                 *[F.round(F.avg(F.when(F.col("h_" + k), F.col("_r"))), 3).alias("r_" + k) for k in patterns])


def mention_strength(counts: DataFrame, totals: DataFrame, by: str, columns, out: str = "strong", min_n: int = 3, min_share: float = 0.02) -> DataFrame:
    """Adds whether the (summed) mentions are at least ``min_n`` and ``min_share`` of all reviews."""
    n = F.lit(0)
    for c in columns:
        n = n + F.coalesce(F.col(c), F.lit(0))
    t = totals.select(F.col(by).alias("_b"), F.col("reviews"))
    return counts.join(t, F.col(by) == F.col("_b"), "left").withColumn(out, (n >= min_n) & (n >= min_share * F.coalesce("reviews", F.lit(0)))).drop("_b", "reviews")


def chain_size(df: DataFrame, *, id: str, brand: str, domain: str, first_word: str, store_domains=()) -> DataFrame:
    """Adds chain_n and chain_key: locations per brand; without a brand, per (own domain, first distinctive word) shared by two or more."""
    group = F.when(F.col(brand).isNull() & F.col(domain).isNotNull() & F.col(first_word).isNotNull() & ~F.col(domain).isin(*store_domains or [""]),
                   F.concat_ws("|", domain, first_word))
    d = df.withColumn("_g", group)
    by_brand = d.filter(F.col(brand).isNotNull()).groupBy(F.col(brand).alias("_b")).agg(F.count("*").alias("_nb"))
    by_group = d.filter(F.col("_g").isNotNull()).groupBy(F.col("_g").alias("_gk")).agg(F.count("*").alias("_ng")).filter(F.col("_ng") >= 2)
    j = d.join(by_brand, F.col(brand) == F.col("_b"), "left").join(by_group, F.col("_g") == F.col("_gk"), "left")
    return j.withColumn("chain_n", F.coalesce("_nb", "_ng", F.lit(1)).cast("bigint")).withColumn("chain_key", F.col("_gk")).drop("_g", "_b", "_nb", "_gk", "_ng")


def crosstab(df: DataFrame, by: str, column: str, values) -> DataFrame:
    """Counts per row key with the given values as columns."""
    return df.groupBy(by).pivot(column, list(values)).agg(F.count(F.lit(1))).fillna(0)


def city_dashboard(df: DataFrame, *, city="city", guides: dict[str, Column], group="insp_group", cuisine="cuisine", default_cuisine="", top=10, listed: Column | None = None) -> DataFrame:
    """Per town: restaurants, listed places, places per guide, result groups, and its top cuisines (the default one left out)."""
    d = df.filter(F.col(city).isNotNull())
    base = d.groupBy(city).agg(F.count("*").alias("restaurants"), F.count_if(listed if listed is not None else F.lit(True)).alias("listed"),
                               *[F.count_if(c).alias("g_" + g) for g, c in guides.items()],
                               *[F.count_if(F.col(group) == i).alias(f"group_{i}") for i in (0, 1, 2)])
    n = d.filter(F.col(cuisine) != default_cuisine).groupBy(F.col(city).alias("_c"), cuisine).agg(F.count("*").alias("n"))
    best = top_rows(n, ["_c"], [F.desc("n"), F.asc(cuisine)], top, rank="_rn").groupBy("_c").agg(
        F.array_sort(F.collect_list(F.struct("_rn", cuisine, "n"))).alias("t"))
    best = best.select("_c", F.array_join(F.transform("t", lambda x: F.concat(x[cuisine], F.lit(":"), x["n"].cast("string"))), ", ").alias("top_cuisines"))
    return base.join(best, F.col(city) == F.col("_c"), "left").drop("_c")


def closure_stats(closures: DataFrame, *, key="num", top=3) -> DataFrame:
    """One row: places with closures, closures, reopened within three days, never reopened, first and last day, most common reasons."""
    one = closures.agg(F.count_distinct(key).alias("places"), F.count("*").alias("total"), F.count_if(F.datediff("reopened", "date") <= 3).alias("within_3"),
                       F.count_if(F.col("reopened").isNull()).alias("open_ended"), F.min("date").alias("first"), F.max("date").alias("last"))
    why = closures.filter(F.col("reason").isNotNull()).groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc("reason")).limit(top)
    reasons = why.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "reason"))), lambda x: x["reason"]), " | ").alias("r"))
    return one.withColumn("top_reasons", reasons.scalar())


def global_stats(df: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """One row of totals."""
    return df.agg(*[c.alias(n) for n, c in measures.items()])


def min_listed(df: DataFrame, by: str, least: int = 5) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("listed")).filter(F.col("listed") >= least)


def dish_frequency(df: DataFrame, column: str, *, top: int, separator: str = "; ", at_least: int = 2) -> DataFrame:
    """Most common list items, each counted once per row."""
    items = df.select(F.explode(F.array_distinct(F.filter(F.transform(F.split(text(column), separator), lambda x: F.trim(F.lower(x))), lambda x: x != ""))).alias("item"))
    return items.groupBy("item").agg(F.count("*").alias("n")).filter(F.col("n") >= at_least).orderBy(F.desc("n"), F.asc("item")).limit(top)


def collect_context(df: DataFrame, key: str, columns, n: int = 8) -> DataFrame:
    """Per key up to ``n`` distinct values of each column (the smallest ones) as sorted arrays. Distinct values are cut to ``n`` before they
    are gathered, so no key gathers more."""
    out = df.select(key).distinct()
    for c in columns:
        vals = df.filter(F.col(c).isNotNull() & (F.col(c).cast("string") != "")).select(F.col(key).alias("_k"), F.col(c).alias("_v")).distinct()
        arr = top_rows(vals, ["_k"], [F.asc("_v")], n).groupBy("_k").agg(F.array_sort(F.collect_list("_v")).alias(c))
        out = out.join(arr, F.col(key) == F.col("_k"), "left").drop("_k")
    return out


def ordered_distinct(df: DataFrame, key: str, order: str, value: str, out: str, n: int | None = None) -> DataFrame:
    """Distinct values per key in order of first appearance. With ``n`` the first n of them: values are counted once per key, and every task hands on at most
    n rows of a key, so a key with very many values stays small; ``ordered_rest`` gives the others as rows."""
    first = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(order).alias("_o"))
    if n is not None:
        first = top_rows(first, [key], [F.asc("_o"), F.asc(value)], n)
    return first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_o", value))).alias("_a")).select(key, F.transform("_a", lambda x: x[value]).alias(out))


def ordered_rest(df: DataFrame, key: str, order: str, value: str, n: int) -> DataFrame:
    """(key, value, place): the distinct values behind the first ``n`` of each key with their place in the order, as rows of their own."""
    first = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(order).alias("_o"))
    return ranked(first, [key], ["_o", value, key], "place").filter(F.col("place") > n).select(key, value, "place")


def merge_facts(df: DataFrame, keys, *, least=(), best: dict[str, list] | None = None, lists: dict[str, int] | None = None) -> DataFrame:
    """One row per key with merged facts: the least of each column of ``least``, the value of each ``best`` column from the row with the greatest order columns, and for each
    column of ``lists`` its first n distinct values in ascending order with how many there are (``<column>_n``).

    All of it is added up on the map side: lists pass on at most n values of a key from every task, so a key with a third of the rows costs no more than others. Null values
    are left out; a key without values has an empty list."""
    keys = list(keys)
    aggs = [F.min(c).alias(c) for c in least] + [F.max_by(c, F.struct(*order)).alias(c) for c, order in (best or {}).items()]
    out = df.groupBy(*keys).agg(*(aggs or [F.count("*").alias("_rows")]))
    for c, n in (lists or {}).items():
        values = df.filter(F.col(c).isNotNull()).select(*keys, c).distinct()
        count = values.groupBy(*keys).agg(F.count("*").alias(c + "_n"))
        some = top_rows(values, keys, [F.asc(c)], n).groupBy(*keys).agg(F.array_sort(F.collect_list(c)).alias(c))
        both = count.join(some, [count[k].eqNullSafe(some[k]) for k in keys]).select(*[count[k].alias("_k_" + k) for k in keys], c, c + "_n")
        empty = F.array().cast(some.schema[c].dataType)
        out = out.join(both, [F.col(k).eqNullSafe(F.col("_k_" + k)) for k in keys], "left").withColumns({c: F.coalesce(c, empty), c + "_n": F.coalesce(c + "_n", F.lit(0))}) \
                 .drop(*["_k_" + k for k in keys])
    return out.drop("_rows")


def grouped_report(df: DataFrame, dims, measures: dict[str, Column], *, sets="cube", unknown: str = "unknown", total: str = "all") -> DataFrame:
    """Measures for combinations of the dimensions in one pass: ``sets`` is "cube", "rollup" or a list of lists of dimensions. ``level`` is the grouping id: a bit for
    each dimension that is summed over, the last dimension lowest. A missing value of the data comes out as ``unknown``, a dimension that is summed over as ``total``."""
    dims = list(dims)
    named = df.withColumns({d: F.coalesce(F.col(d).cast("string"), F.lit(unknown)) for d in dims})
    groups = named.cube(*dims) if sets == "cube" else named.rollup(*dims) if sets == "rollup" else named.groupingSets([[F.col(d) for d in s] for s in sets], *dims)
    over = [F.grouping(d).alias("_g_" + d) for d in dims]
    out = groups.agg(F.grouping_id().alias("level"), *over, *[m.alias(n) for n, m in measures.items()])
    return out.select(*[F.when(F.col("_g_" + d) == 1, F.lit(total)).otherwise(F.col(d)).alias(d) for d in dims], "level", *measures)


def ungrouped_values(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """Values in the data that the code table lacks, with counts."""
    n = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return n.join(codes.select(F.col(codes.columns[0]).alias("_c")), F.col(column) == F.col("_c"), "left_anti")


def unusable_sources(cited: DataFrame, *, host="host", reason="reason", name="name", show: int = 12) -> DataFrame:
    """Unusable sources by (host, reason): affected rows and the first names."""
    names = cited.filter(F.col(reason).isNotNull()).select(host, reason, name).distinct()
    n = names.groupBy(host, reason).agg(F.count("*").alias("n"))
    first = top_rows(names, [host, reason], [F.asc(name)], show).groupBy(F.col(host).alias("_h"), F.col(reason).alias("_r")).agg(F.array_join(F.array_sort(F.collect_list(name)), "; ").alias("names"))
    return n.join(first, (F.col(host) == F.col("_h")) & (F.col(reason) == F.col("_r"))).drop("_h", "_r")


def note_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_if(F.trim(text(column)) != "").alias("n"))


def chain_domain_verdict(links: DataFrame, checked: DataFrame, *, domain="domain", url="url", brand="brand", min_links=5, min_share=0.8, samples=3, min_ok=2) -> DataFrame:
    """(url, ok, why) per link. A domain with enough links of one brand is judged by its first three; a brand's own domain whose samples only
    blocked the check passes. ``checked`` carries (url, ok, why); links without a verdict stay null."""
    u = links.select(domain, url, brand, "own_site").distinct()
    size = u.groupBy(F.col(domain).alias("_d")).agg(F.count("*").alias("links"))
    lead = top_rows(u.groupBy(domain, brand).agg(F.count("*").alias("n")), [domain], [F.desc("n"), F.asc(brand)]).select(F.col(domain).alias("_d2"), "n")
    chains = size.join(lead, F.col("_d") == F.col("_d2")).filter((F.col("links") >= min_links) & (F.col("n") >= min_share * F.col("links"))).select("_d")
    v = checked.select(F.col(url).alias("_u"), "ok", "why")
    first = top_rows(u.join(chains, F.col(domain) == F.col("_d"), "left_semi"), [domain], [F.asc(url)], samples).join(v, F.col(url) == F.col("_u"), "left")
    blocked = F.col("why").rlike(r"^(?:http 40[39]|http 429|error: (?:ConnectionError|ConnectTimeout|ReadTimeout))$")
    judged = first.groupBy(F.col(domain).alias("_cd")).agg(F.count_if("ok").alias("n_ok"), F.count("ok").alias("n_seen"), F.bool_and(F.when(F.col("ok").isNotNull(), F.col("ok") | blocked)).alias("fine"),
                                                          F.bool_or("own_site").alias("own"))
    passed, own = F.col("n_ok") >= min_ok, (F.col("n_ok") < min_ok) & F.col("own") & F.coalesce("fine", F.lit(False)) & (F.col("n_seen") > 0)
    judged = judged.select("_cd", (passed | own).alias("c_ok"), F.when(passed, F.lit("chain domain ok")).when(own, F.lit("brand's own site (blocked the check)")).otherwise(F.lit("chain domain failed its samples")).alias("c_why"))
    sampled = first.select(F.col(url).alias("_s")).withColumn("sample", F.lit(True))
    j = u.join(v, F.col(url) == F.col("_u"), "left").join(judged, F.col(domain) == F.col("_cd"), "left").join(sampled, F.col(url) == F.col("_s"), "left")
    own_sample = F.col("sample") & (F.col("c_why") == "brand's own site (blocked the check)")
    use_chain = F.col("_cd").isNotNull() & (F.col("sample").isNull() | own_sample)
    return j.select(url, F.when(use_chain, F.col("c_ok")).otherwise(F.col("ok")).alias("ok"), F.when(use_chain, F.col("c_why")).otherwise(F.col("why")).alias("why"))

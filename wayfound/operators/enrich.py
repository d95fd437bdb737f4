"""Imputation, spelling repair and scores."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .fuzzy import near_text_pairs
from .numbering import pct_rank_avg
from .scale import exact_median, mode_value, top_rows
from .spatial import polygons_holding

# fixed values: sales, margin and honor figures
BASE_SALES = {1: 600_000, 2: 1_000_000, 3: 2_200_000, 4: 3_500_000}
REVIEW_EXPONENT, CHAIN_EXPONENT = 0.764, 0.35
MARGIN = {1: 0.075, 2: 0.05, 3: 0.055, 4: 0.045}
MARGIN_CUISINE = {"Bar & Pub": 0.10, "Steakhouse": 0.09, "Pizza": 0.07, "Coffee & Café": 0.08}
AWARD_POINTS = {5: 70, 4: 62, 3: 52, 2: 36, 1: 22}


def _level(c) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(4), F.bround(c, 0))).cast("int")


def impute_price(df: DataFrame, *, price: str, brand: str, cuisine: str, chain_key: str) -> DataFrame:
    """Adds price_out and price_est: own level, else the brand's median, else the cuisine's, else 2; then brand and chain medians replace
    estimates. Levels are few, so medians are exact and small."""
    own = df.filter(F.col(price).isNotNull())
    med = lambda k, n: own.filter(F.col(k).isNotNull()).groupBy(F.col(k).alias("_" + n)).agg(F.median(price).alias("m_" + n))
    j = df.join(med(brand, "b"), F.col(brand) == F.col("_b"), "left").join(med(cuisine, "c"), F.col(cuisine) == F.col("_c"), "left") \
        .join(med(chain_key, "k"), F.col(chain_key) == F.col("_k"), "left")
    first = _level(F.coalesce(F.col(price), F.col("m_b"), F.col("m_c"), F.lit(2)))
    est = F.col(price).isNull()
    out = F.when(est & F.col("m_k").isNotNull(), _level(F.col("m_k"))).when(est & F.col("m_b").isNotNull(), _level(F.col("m_b"))).otherwise(first)
    return j.withColumn("price_out", out).withColumn("price_est", est).drop("_b", "m_b", "_c", "m_c", "_k", "m_k")


def snap_rare_spelling(df: DataFrame, *, value: str, zip: str, keep=(), common_n=5, zip_ratio=75.0, any_ratio=90.0) -> DataFrame:
    """(value, zip, snapped) for distinct rare spellings: the zip's usual value when close or contained, else the closest common value."""
    n = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    common, rare = n.filter(F.col("n") >= common_n).select(F.col(value).alias("cv")), n.filter(F.col("n") < common_n).select(F.col(value).alias("rv"))
    usual = mode_value(df.join(common, F.col(value) == F.col("cv"), "left_semi"), [zip], value, "usual").withColumnRenamed(zip, "_z")
    rows = df.join(rare, F.col(value) == F.col("rv"), "left_semi").select(value, zip).distinct().join(usual, F.col(zip) == F.col("_z"), "left") \
        .withColumn("bare", F.lower(F.trim(F.regexp_replace(value, r",.*$|\s*\.\s.*$", "")))).withColumn("usual_low", F.lower("usual"))
    from ..functions.similarity import sim_ratio
    by_zip = F.col("usual").isNotNull() & ((F.coalesce(sim_ratio("bare", "usual_low"), F.lit(0.0)) >= zip_ratio) | F.contains(F.lower(value), F.col("usual_low")) | F.contains(F.col("usual_low"), F.lower(value)))
    rows = rows.withColumn("by_zip", by_zip)
    near = near_text_pairs(rows.filter(~F.col("by_zip")), common.withColumn("low", F.lower("cv")), "bare", "low", any_ratio)
    near = near.join(common.withColumn("low", F.lower("cv")), F.col("r_text") == F.col("low"))
    best = top_rows(near, ["l_text"], [F.desc("score"), F.asc("cv")]).select(F.col("l_text").alias("_b"), F.col("cv").alias("closest"))
    out = rows.join(best, F.col("bare") == F.col("_b"), "left")
    kept = F.col(value).isin(*keep) if keep else F.lit(False)
    return out.select(value, zip, F.when(F.col("by_zip"), F.col("usual")).when(~kept, F.col("closest")).alias("snapped")).filter(F.col("snapped").isNotNull() & (F.col("snapped") != F.col(value)))


def flag_far_outlier(df: DataFrame, *, id: str, town: str, max_km=30.0, min_rows=5) -> DataFrame:
    """Adds ``far``: more than ``max_km`` from the town's median point, for towns with enough rows."""
    med = exact_median(df.filter(F.col(town).isNotNull()), [town], ["lat", "lon"]).withColumnRenamed(town, "_t")
    j = df.join(med, F.col(town) == F.col("_t"), "left")
    km = F.sqrt(F.pow((F.col("lat") - F.col("median_lat")) * 111, 2) + F.pow((F.col("lon") - F.col("median_lon")) * 99, 2))
    return j.withColumn("far", F.coalesce((F.col("n_lat") >= min_rows) & (km > max_km), F.lit(False))).drop("_t", "median_lat", "median_lon", "n_lat", "n_lon")


def split_same_name_town(df: DataFrame, *, town: str, county: str, max_km=40.0) -> DataFrame:
    """(town, county, new_town) for towns whose counties lie far from the biggest one."""
    d = df.filter(F.col(town).isNotNull() & F.col(county).isNotNull())
    med = exact_median(d, [town, county], ["lat", "lon"])
    n = d.groupBy(town, county).agg(F.count("*").alias("n"))
    big = top_rows(n, [town], [F.desc("n"), F.asc(county)]).select(F.col(town).alias("_t"), F.col(county).alias("_bc"))
    b = big.join(med.select(F.col(town).alias("_mt"), F.col(county).alias("_mc"), F.col("median_lat").alias("b_lat"), F.col("median_lon").alias("b_lon")), (F.col("_t") == F.col("_mt")) & (F.col("_bc") == F.col("_mc")))
    km = F.sqrt(F.pow((F.col("median_lat") - F.col("b_lat")) * 111, 2) + F.pow((F.col("median_lon") - F.col("b_lon")) * 99, 2))
    return med.join(b, F.col(town) == F.col("_t")).filter(km > max_km).select(town, county, F.concat(F.col(town), F.lit(" ("), F.col(county), F.lit(" Co.)")).alias("new_town"))


def bayes_rating(df: DataFrame, *, rating: str, reviews: str, weight=40, out="bayes") -> DataFrame:
    mean = df.agg(F.avg(rating)).scalar()
    return df.withColumn(out, (F.col(reviews) * F.col(rating) + weight * mean) / (F.col(reviews) + weight))


def _by_level(table: dict, c) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in (kv[0], float(kv[1]))]), F.col(c))


def sales_model(df: DataFrame, *, price: str, reviews: str, bar: Column, chain_n: str, brand: str, cuisine: str, bayes: str, venue: Column, brand_sales: DataFrame) -> DataFrame:
    """Adds rev, rev_src, margin, profit, value_score: sales by price level and relative review volume, chains by their published average,
    margins by level or cuisine and rating percentile."""
    med = df.filter(F.col(reviews).isNotNull() & (F.col(chain_n) < 5)).groupBy(F.col(price).alias("_p")).agg(F.median(reviews).alias("_m"))
    bmed = df.filter(F.col(brand).isNotNull()).groupBy(F.col(brand).alias("_b")).agg(F.median(reviews).alias("_bm"))
    j = df.join(med, F.col(price) == F.col("_p"), "left").join(bmed, F.col(brand) == F.col("_b"), "left").join(brand_sales.select(F.col("brand").alias("_ab"), "auv"), F.col(brand) == F.col("_ab"), "left")
    rel = F.coalesce((F.col(reviews) + 10) / (F.col("_m") + 10), F.lit(0.6))
    model = F.greatest(F.lit(100000.0), F.least(F.lit(40000000.0), _by_level(BASE_SALES, price) * F.when(bar, 1.15).otherwise(1.0) * F.pow(rel, REVIEW_EXPONENT)))
    chain = F.col("auv") * F.greatest(F.lit(0.6), F.least(F.lit(1.5), F.coalesce(F.pow(F.col(reviews) / F.col("_bm"), CHAIN_EXPONENT), F.lit(0.85))))
    j = pct_rank_avg(j, bayes, "_pct")
    cm = F.try_element_at(F.create_map(*[F.lit(x) for kv in MARGIN_CUISINE.items() for x in kv]), F.col(cuisine))
    margin = F.bround(F.coalesce(cm, _by_level(MARGIN, price)) * (0.8 + 0.4 * F.coalesce("_pct", F.lit(40.0)) / 100), 4)
    src = F.when(F.col("auv").isNotNull(), "chain").when(venue, "venue").when(F.col(reviews).isNotNull(), "model").otherwise("model-low")
    return j.withColumn("rev", F.when(F.col("auv").isNotNull(), chain).otherwise(model)).withColumn("rev_src", src).withColumn("margin", margin) \
        .withColumn("profit", F.col("rev") * F.col("margin")).withColumn("value_score", F.col(bayes) - 0.18 * (F.col(price) - 1)) \
        .drop("_p", "_m", "_b", "_bm", "_ab", "auv", "_pct")


def icon_score(df: DataFrame, *, honors: str, award: str, oldest: str, founded: str, reviews: str, honored: Column, year: int) -> DataFrame:
    """Adds ``icon``: honor points, age and review percentile, at most 100; null when not honored."""
    j = pct_rank_avg(df.withColumn("_lr", F.log1p(F.col(reviews))), "_lr", "_pct")
    bit = lambda b: F.coalesce(F.col(honors), F.lit(0)).bitwiseAND(F.lit(b)) != 0
    pts = F.when(bit(1), 40).otherwise(0) + F.when(bit(2), 26).when(bit(4), 14).when(bit(8), 6).otherwise(0) \
        + F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in AWARD_POINTS.items() for x in kv]), F.col(award)), F.lit(0)) + F.when(F.col(oldest), 16).otherwise(0)
    years = F.least(F.greatest(F.coalesce(F.lit(year) - F.col(founded), F.lit(0)), F.lit(0)), F.lit(100))
    score = F.least(F.least(pts, F.lit(70)) + years / 100 * 24 + F.coalesce("_pct", F.lit(0.0)) / 100 * 14, F.lit(100.0))
    return j.withColumn("icon", F.when(honored, score)).drop("_lr", "_pct")


def county_assign(df: DataFrame, tiers, *, id: str, license_county: str, regions: DataFrame | None = None) -> DataFrame:
    """Adds county from the license, else from the first tier that holds the point. A point loses its coordinates when outlines hold it but none of them, in any tier,
    is its license's county: outlines overlap near borders. With ``regions`` (county, region; one row a county) the county's region is added too."""
    held = polygons_holding(df.select(id, "lat", "lon", F.col(license_county).alias("_lic")), tiers, id=id)
    at = held.groupBy(F.col(id).alias("_id")).agg(F.min(F.struct("tier", "name")).alias("_m"), F.collect_set("name").alias("_names"))
    j = df.join(at, F.col(id) == F.col("_id"), "left").withColumn("_at", F.col("_m.name"))
    wrong = F.col(license_county).isNotNull() & F.col("_at").isNotNull() & ~F.array_contains("_names", F.col(license_county))
    cols = [F.when(~F.coalesce(wrong, F.lit(False)), F.col(c)).alias(c) if c in ("lat", "lon") else F.col(c) for c in df.columns]
    out = j.select(*cols, F.coalesce(F.col(license_county), F.col("_at")).alias("county"))
    return out if regions is None else out.join(regions.select("county", "region"), "county", "left").select(*out.columns, "region")

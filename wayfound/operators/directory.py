"""Directory queries: guides, filters, layers and sort orders as composable conditions and orderings.

A place table carries: id, name, city, county, cuisine, brand, chain_n, tier (0 listing, 1 confirmed, 2 licensed), venue, hc (hand-checked), tags
(bit mask), honors (flag bits), award (0-5), jbf, ip (icon points), founded, insp_group, insp_date, hp, im, bs, lat, lon.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.geo import haversine_miles
from ..functions.text import search_normalize, search_text
from .scale import ranked, top_rows

# fixed values: tag bits of the hand-checked guides
TAG_BITS = {"cuban": 0, "stonecrab": 1, "grouper": 2, "keys": 3, "oyster": 4, "fishcamp": 5, "latin": 6, "oldest": 7}
GUIDES = ("cuban", "stonecrab", "grouper", "keys", "oyster", "fishcamp", "latin", "honors", "oldest", "inspections", "nearme", "all")
RANKED_GUIDES = ("oldest",)
PIN_CAP, EVERYTHING_SPAN = 600, 0.3
LAYERS = ("classics", "cuban", "seafood", "honors", "all")


def _yes(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))


def tag(name: str) -> Column:
    return F.coalesce(F.col("tags"), F.lit(0)).bitwiseAND(F.lit(1 << TAG_BITS[name])) != 0


def guide_filter(guide: str) -> Column:
    """Guide membership. Tag guides list hand-checked places only."""
    if guide in TAG_BITS and guide != "oldest":
        return _yes("hc") & tag(guide)
    return {"honors": (F.coalesce(F.col("award"), F.lit(0)) > 0) | F.col("jbf").isNotNull(), "oldest": F.col("founded").isNotNull() & tag("oldest"),
            "inspections": F.col("insp_date").isNotNull()}.get(guide, F.lit(True))


@dataclass(frozen=True)
class Filters:
    """A user's filters; missing ones do not restrict."""
    town: str | None = None
    cuisine: str | None = None
    hide_chains: bool = False
    confirmed_only: bool = False
    include_non_restaurants: bool = False
    bib_gourmand: bool = False

    @property
    def active_count(self) -> int:
        return sum([self.town is not None, self.cuisine is not None, self.hide_chains, self.confirmed_only, self.include_non_restaurants, self.bib_gourmand])

    def condition(self) -> Column:
        out = F.lit(True)
        if not self.include_non_restaurants:
            out = out & ~_yes("venue")
        if self.town is not None:
            out = out & (F.col("city") == self.town)
        if self.cuisine is not None:
            out = out & (F.col("cuisine") == self.cuisine)
        if self.hide_chains:
            out = out & (F.coalesce(F.col("chain_n"), F.lit(1)) < 5)
        if self.confirmed_only:
            out = out & (F.col("tier") > 0)
        if self.bib_gourmand:
            out = out & (F.col("award") == 2)
        return out


def is_classic() -> Column:
    return _yes("hc") & (F.coalesce(F.col("tags"), F.lit(0)) != 0)


def is_honored() -> Column:
    return (F.coalesce(F.col("honors"), F.lit(0)) != 0) | (F.coalesce(F.col("award"), F.lit(0)) > 0)


def map_layer(layer: str) -> Column:
    any_of = lambda *gs: _any([guide_filter(g) for g in gs])
    return {"classics": is_classic(), "cuban": any_of("cuban", "latin"), "seafood": any_of("stonecrab", "grouper", "keys", "oyster", "fishcamp"),
            "honors": guide_filter("honors")}.get(layer, F.lit(True))


def _any(conds):
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def viewport(center_lat: float, center_lon: float, dlat: float, dlon: float, margin: float = 0.25) -> Column:
    """On screen with a margin on each side."""
    half = 0.5 + margin
    return (F.abs(F.col("lat") - center_lat) <= half * dlat) & (F.abs(F.col("lon") - center_lon) <= half * dlon)


def map_view(places: DataFrame, layer: str, filters: Filters, center_lat: float, center_lon: float, dlat: float, dlon: float) -> DataFrame:
    """Pins of a layer in view; the everything layer only at town size, and at most the pin cap."""
    import math
    base = places.filter(map_layer(layer) & filters.condition() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    if layer != "all":
        return base
    if min(dlat, dlon * math.cos(math.radians(center_lat))) > EVERYTHING_SPAN:
        return base.limit(0)
    return capped_viewport(base.filter(viewport(center_lat, center_lon, dlat, dlon)), center_lat, center_lon)


def capped_viewport(df: DataFrame, center_lat: float, center_lon: float, limit: int = PIN_CAP) -> DataFrame:
    """Featured pins first, then nearest to the centre."""
    import math
    k = math.cos(math.radians(center_lat))
    d2 = F.pow(F.col("lat") - center_lat, 2) + F.pow((F.col("lon") - center_lon) * k, 2)
    return df.withColumn("_d2", d2).orderBy(F.desc(is_honored() | is_classic()), F.asc("_d2"), F.asc("id")).limit(limit).drop("_d2")


def in_region_box(lat="lat", lon="lon", box=(24.3, 31.1, -87.7, -79.9)) -> Column:
    return F.col(lat).between(box[0], box[1]) & F.col(lon).between(box[2], box[3])


def promo_ok() -> Column:
    """Never promote a place whose latest result is follow-up or closed; unknown is fine."""
    return ~F.coalesce(F.col("insp_group").isin(1, 2), F.lit(False))


def index_selection() -> Column:
    """Rows worth a system search index: restaurants, honored or hand-checked, no chains."""
    return ~_yes("venue") & (is_honored() | _yes("hc")) & (F.coalesce(F.col("chain_n"), F.lit(1)) < 5)


# --- orders -----------------------------------------------------------------------------------------------------------------------
def sort_keys(order: str, here: tuple[float, float] | None = None) -> list[Column]:
    """Sort keys of an order, all ascending, the id last; without a place to start from, nearest is featured."""
    name, last = [F.col("sort_key"), F.col("id")], lambda c: [F.col(c).isNull()]
    founded = F.coalesce(F.col("founded"), F.lit(9999))
    if order == "nearest" and here is not None:
        return [*last("miles"), F.col("miles"), *name]
    if order in ("featured", "nearest"):
        return [-F.coalesce(F.col("ip").cast("double"), F.lit(-1.0)), founded, *name]
    if order == "oldest":
        return [founded, *name]
    if order == "iconic":
        bit = lambda b: F.coalesce(F.col("honors"), F.lit(0)).bitwiseAND(F.lit(b)) != 0
        level = F.when(bit(1), 4).when(bit(2), 3).when(bit(4), 2).when(bit(8), 1).otherwise(0)
        return [-F.coalesce(F.col("award"), F.lit(0)), -level, *name]
    if order == "recent":
        return [*last("insp_date"), -F.unix_date(F.col("insp_date").cast("date")), *name]
    if order in ("fewest_high", "most_high"):
        rest = F.coalesce(F.col("im"), F.lit(0)) + F.coalesce(F.col("bs"), F.lit(0))
        up = lambda c: c if order == "fewest_high" else -c
        return [*last("hp"), up(F.col("hp")), up(rest) if order == "most_high" else rest, *name]
    return name


def with_sort_columns(df: DataFrame, here: tuple[float, float] | None = None) -> DataFrame:
    out = df if "sort_key" in df.columns else df.withColumn("sort_key", search_normalize("name"))
    return out.withColumn("miles", haversine_miles("lat", "lon", F.lit(float(here[0])), F.lit(float(here[1])))) if here else out


def in_order(df: DataFrame, keys: list[Column], limit: int | None = None, position: str | None = None) -> DataFrame:
    """Rows by ascending keys; with a limit Spark keeps only the top rows of each task. ``position`` adds the place from 1: over the rows of the
    limit, or, without one, over value ranges of the whole table."""
    if position is None:
        out = df.orderBy(*keys)
        return out.limit(limit) if limit is not None else out
    if limit is None:
        return ranked(df, [], keys, position)
    return df.orderBy(*keys).limit(limit).withColumn(position, F.row_number().over(W.orderBy(*keys)))


def sort_places(df: DataFrame, order: str, here=None, limit: int | None = None, offset: int = 0, position: str | None = None) -> DataFrame:
    """Ordered (page of a) list."""
    out, keys = with_sort_columns(df, here), sort_keys(order, here)
    if offset:
        out = out.orderBy(*keys).offset(offset)
        return out.limit(limit) if limit is not None else out
    return in_order(out, keys, limit, position)


def page_rows(df: DataFrame, order: str, page: int, first: int = 100, step: int = 200) -> DataFrame:
    """Rows of page 0 (the first ``first``) or of a later page of ``step``."""
    return sort_places(df, order, limit=first) if page == 0 else sort_places(df, order, limit=step, offset=first + (page - 1) * step)


def random_pick(df: DataFrame, seed: int, last=None, n: int = 1) -> DataFrame:
    """Random row(s), never the last one shown; repeatable for a seed."""
    pool = df if last is None else df.filter(F.col("id") != F.lit(last))
    return pool.orderBy(F.xxhash64(F.lit(seed), F.col("id")), "id").limit(n)


def mark_counts(df: DataFrame, filters: Filters, guides=GUIDES) -> DataFrame:
    """Number of places per guide under the filters, in one pass."""
    one = df.filter(filters.condition()).agg(*[F.count_if(guide_filter(g)).alias(g) for g in guides])
    return one.select(F.explode(F.array(*[F.struct(F.lit(g).alias("guide"), F.col(g).alias("n")) for g in guides])).alias("r")).select("r.guide", "r.n")


def regional_listing(df: DataFrame, regions: list[str], *, region="region", by=("city", "sort_key", "id")) -> DataFrame:
    """Rows in a fixed region order, then by the rest."""
    pos = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(r) for r in regions]), F.col(region)), F.lit(0)), F.lit(len(regions) + 1))
    return df.withColumn("region_ord", pos).orderBy("region_ord", *by)


def sections_by_size(df: DataFrame, column: str, fixed_order: list[str]) -> DataFrame:
    """Non-empty groups by size, then the fixed order."""
    pos = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(v) for v in fixed_order]), F.col(column)), F.lit(0)), F.lit(len(fixed_order) + 1))
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).withColumn("ord", pos).orderBy(F.desc("n"), "ord", column)


def top_k_counts(df: DataFrame, column: str, k: int) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(column)).limit(k)


def with_search_columns(df: DataFrame, extra=("dishes", "aka", "zip"), address="street") -> DataFrame:
    own = [c for c in ("name", "aka", "city", "county", "zip", "cuisine", "brand", "dishes") if c in df.columns]
    return df.withColumn("search_text", search_text(*own, address=address if address in df.columns else None)) \
        .withColumn("name_text", search_text("name", *(["brand"] if "brand" in df.columns else []))).withColumn("sort_key", search_normalize("name"))


def first_per_group(df: DataFrame, by, order, n: int) -> DataFrame:
    return top_rows(df, by, order, n)

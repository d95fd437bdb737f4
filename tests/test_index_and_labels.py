"""Inverted-index search, dense cells, points for unplaced rows, regions and labels."""
import itertools

import pytest
from pyspark.sql import functions as F

from wayfound.functions import records as R
from wayfound.functions.geo import planar_m
from wayfound.operators import enrich as E, matching as M, search as Q, spatial as S

WORDS = "oyster oysters oak ocean grill grille garden bar barn bay st 8th sw town".split()
PARSED = "query_id long, text string, tag string, tag_stem string, town string, town_needle string, tokens array<array<string>>, typed boolean"


def _places(spark, n=240):
    rows = []
    for i in range(n):
        name = " ".join(WORDS[(i * k + k) % len(WORDS)] for k in (1, 3, 5))
        rows.append((i, f"Town {i % 4}", 1 << (i % 8) if i % 3 else None, f" {name} town {i % 4} {i % 9} sw 8th st ", f" {name} "))
    rows.append((n, None, None, None, None))
    rows.append((n + 2, "Town 3", 1, " oak bar town 3 ", " oak bar "))
    rows.append((n + 1, "Town 1", 0, "  ", None))
    return spark.createDataFrame(rows, "id long, city string, tags int, search_text string, name_text string")


ASKED = [(1, "oy", None, None, None, None, [[" oy"]], True), (2, "oak bar", None, None, None, None, [[" oak"], [" bar "]], True),
         (3, "8th st", None, None, None, None, [[" sw 8th ", " 8th st"]], True), (4, "stone crab", "stonecrab", " oyster", None, None, [], True),
         (5, "town 2", None, None, "Town 2", " town 2", [], True), (6, "nothing", None, None, None, None, [[" zzz"], [" o"]], True),
         (7, "", None, None, None, None, [], False), (8, "o town 3", "cuban", None, "Town 3", None, [[" o"]], True), (9, "s", None, None, None, None, [[" s"]], True)]


def _plain(places):
    bits = {"cuban": 1, "stonecrab": 2}
    out = set()
    for q in ASKED:
        if not (q[6] or q[2] or q[4]):
            continue
        for p in places:
            name, text = p.name_text or "", p.search_text
            tag = q[2] is None or ((p.tags or 0) & bits[q[2]]) or (q[3] is not None and q[3] in name)
            town = q[4] is None or p.city == q[4] or (q[5] is not None and q[5] in name)
            if tag and town and (not q[6] or (text is not None and all(any(n in text for n in t) for t in q[6]))):
                out.add((q[0], p.id))
    return out


@pytest.mark.parametrize("most", [7, 1 << 16])
def test_search_by_rarest_part_equals_plain_scan(spark, most):
    places = _places(spark)
    got = [(r.query_id, r.place_id) for r in Q.search_match(places, spark.createDataFrame(ASKED, PARSED), most=most).collect()]
    assert len(got) == len(set(got)) and set(got) == _plain(places.collect())
    assert {q for q, _ in got} == {1, 2, 3, 4, 5, 8, 9}


def test_search_of_empty_tables(spark):
    places, asked = _places(spark), spark.createDataFrame(ASKED, PARSED)
    assert Q.search_match(places.limit(0), asked).count() == 0 and Q.search_match(places, asked.limit(0)).count() == 0


@pytest.mark.parametrize("most", [5, 1 << 16])
def test_dense_cells_give_the_same_pairs(spark, most):
    at = [(i, 25.0 + (0 if i < 60 else (i % 7) * 0.0007), -80.0 + (0 if i < 60 else (i % 5) * 0.0009), "a" if i % 2 else None) for i in range(110)] + [(999, None, -80.0, "a")]
    l = spark.createDataFrame(at, "id long, lat double, lon double, b string")
    r = l.filter("id % 3 = 0")
    every = l.alias("x").crossJoin(r.alias("y"))
    want = {(x.i, x.j) for x in every.filter(planar_m("x.lat", "x.lon", "y.lat", "y.lon") <= 150.0).select(F.col("x.id").alias("i"), F.col("y.id").alias("j")).collect()}
    got = [(x.l_id, x.r_id) for x in S.proximity_join(l, r, radius_m=150.0, most=most).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    blocked = {(x.l_id, x.r_id) for x in S.proximity_join(l, r, radius_m=150.0, block=["b"], most=most).collect()}
    assert blocked == {(i, j) for i, j in want if i % 2 and j % 2}
    box = [(x.l_id, x.r_id) for x in S.box_join(l.filter("lat is not null"), r, dlat=0.001, dlon=0.001, most=most).collect()]
    near = {(a[0], b[0]) for a, b in itertools.product(at[:-1], at[:-1]) if b[0] % 3 == 0 and abs(a[1] - b[1]) < 0.001 and abs(a[2] - b[2]) < 0.001}
    assert len(box) == len(set(box)) and set(box) == near


def test_no_task_meets_more_than_the_limit(spark):
    """100,000 rows at one spot: the cell is cut into slices, and every pair is met once."""
    l = spark.range(100_000).select(F.col("id").alias("id"), F.lit(25.0).alias("lat"), F.lit(-80.0).alias("lon"))
    r = spark.range(3).select(F.col("id").alias("rid"), F.lit(25.0).alias("lat"), F.lit(-80.0).alias("lon"))
    met = S.proximity_join(l, r, radius_m=50.0, most=10_000)
    assert met.count() == 300_000 and met.select("l_id", "r_rid").distinct().count() == 300_000


def test_place_unplaced(spark):
    u = spark.createDataFrame([(1, "t", "RED GRILL", None, "1 Main"), (2, "t", "RED GRILL", None, "2 Main"), (3, "t", "BLUE BAR", None, "3 Main"), (4, "t", "RED GRILL", "9", None),
                               (5, "t", None, None, "3 Main"), (6, None, "RED GRILL", None, None)], "id long, town string, k string, num string, address string")
    p = spark.createDataFrame([(10, "t", "RED GRILLE", "7", 25.0, -80.0), (11, "t", "RED GRILL", None, 25.0005, -80.0), (12, "u", "BLUE BAR", None, 26.0, -81.0)],
                              "pid long, town string, k string, num string, lat double, lon double")
    cached = spark.createDataFrame([("1 Main", 30.0, -85.0), ("1 Main", 29.0, -84.0), ("2 Main", None, None), (None, 1.0, 1.0)], "address string, lat double, lon double")
    placed = M.place_unplaced(u, p, cached)
    got = {r.id: (r.lat, r.lon, r.placed_by) for r in placed.collect()}
    assert got == {1: (29.0, -84.0, "cache"), 2: (25.0, -80.0, "listing"), 3: (None, None, None), 4: (25.0005, -80.0, "listing"), 5: (None, None, None), 6: (None, None, None)}
    assert [r.address for r in M.geocode_todo(placed).collect()] == ["3 Main"]


def test_region_of_county(spark):
    ring = "array<struct<x:double,y:double>>"
    tiers = [spark.createDataFrame([("A", [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)])], f"name string, ring {ring}")]
    df = spark.createDataFrame([(1, 0.5, 0.5, None), (2, 0.5, 0.5, "B"), (3, 5.0, 5.0, None), (4, None, None, "C")], "id long, lat double, lon double, lic string")
    regions = spark.createDataFrame([("A", "North"), ("B", "South")], "county string, region string")
    got = {r.id: (r.county, r.region, r.lat) for r in E.county_assign(df, tiers, id="id", license_county="lic", regions=regions).collect()}
    assert got == {1: ("A", "North", 0.5), 2: ("B", "South", None), 3: (None, None, 5.0), 4: ("C", None, None)}


def test_labels(spark):
    df = spark.createDataFrame([(1, 0, 3, None, True, 1 | 128, 1950, 7, 2, "meta", None), (2, 2, 0, "x", False, 1, None, 1, 0, "meta", "81%"), (3, 0, 0, None, False, 0, None, None, 0, None, None),
                                (4, None, None, None, None, None, None, 5, 1, "research", None), (5, 0, 8, None, True, 128, None, 1, 2, "official", None)],
                               "id int, award int, flags int, jbf string, hc boolean, tags int, founded int, chain int, tier int, src string, rate string")
    chips = R.place_chips(award="award", flags="flags", honors="jbf", hand_checked="hc", tags="tags", founded="founded", chain_n="chain", tier="tier")
    got = {r.id: (r.c, r.k) for r in df.select("id", chips.alias("c"), R.how_we_know("src", "tier", "hc", "rate").alias("k")).collect()}
    assert [got[i][0] for i in range(1, 6)] == [["America's Classic", "Cuban & cafecito", "Since 1950", "Chain · 7"], ["Bib Gourmand", "James Beard (restaurateur)"], ["Listing only"],
                                                ["Chain · 5"], ["James Beard semifinalist"]]
    k = R.KNOWN_BY
    assert [got[i][1] for i in range(1, 6)] == [k["matched"], k["listing"] + k["rate"] % "81%", k["listing"], k["research"], k["official"]]

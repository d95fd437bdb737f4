"""The directory's query side on a ten-row table: guides, filters, orders, search."""
import pytest
from pyspark.sql import functions as F

from wayfound.operators import directory as D, search as Q

COLS = ("id string, name string, city string, county string, cuisine string, brand string, chain_n int, tier int, venue boolean, hc boolean, tags int, honors int, award int, jbf string, ip double, founded int, "
        "insp_group int, insp_date string, hp int, im int, bs int, street string, dishes string, lat double, lon double")
ROWS = [
    ("a", "Vermont Cuban Kitchen", "Miami", "Dade", "Latin", None, 1, 2, False, True, 1, 1, 0, "America's Classic", 60.0, None, 0, "2026-08-01", 1, 2, 3, "3555 SW 8th St", "cuban sandwich; cafecito; croquetas", 25.7653, -80.2526),
    ("b", "Moe's Stone Crab", "Miami Beach", "Dade", "Seafood", None, 1, 2, False, True, 130, 17, 1, None, 75.0, 1918, 0, "2026-05-08", 1, 1, 4, "11 Wilson Ave", None, 25.7690, -80.1342),
    ("c", "Chicken Tropics", "Miami", "Dade", "Latin", "Chicken Tropics", 120, 2, False, False, 0, 0, 0, None, None, None, None, None, None, None, None, None, None, 25.70, -80.30),
    ("d", "Cuban Corner", "Tampa", "Hills", "Latin", None, 1, 0, False, False, 0, 0, 0, None, None, None, None, None, None, None, None, "100 E 7th Ave", None, 27.96, -82.44),
    ("e", "Gas Mart", "Orlando", "Orange", "Other", None, 1, 1, True, False, 0, 0, 0, None, None, None, None, None, None, None, None, None, None, 28.54, -81.38),
    ("f", "Gap in the Wall Seafood", "Bayport", "Frank", "Seafood", None, 1, 2, False, True, 16, 0, 0, None, None, None, None, None, None, None, None, "23 Avenue D", "oysters in season", 29.7255, -84.9830),
    ("g", "Ybarra Grill", "Tampa", "Hills", "Other", None, 1, 2, False, False, 0, 0, 0, None, None, None, 2, "2026-09-10", 2, 1, 1, "1600 E 7th Ave", None, 27.960, -82.437),
    ("h", "Kona Coffee Window", "Miami", "Dade", "Coffee", None, 1, 1, False, False, 0, 0, 0, None, None, None, None, None, None, None, None, "200 SW 8th St", None, 25.765, -80.199),
    ("i", "Castle Snacks", "Orlando", "Orange", "Other", None, 1, 2, True, False, 0, 0, 0, None, None, None, None, None, None, None, None, None, None, 28.4195, -81.5812),
    ("j", "Green Heaven", "Key West", "Monroe", "Seafood", None, 1, 2, False, True, 8, 0, 0, None, None, None, 1, "2026-07-15", 3, 0, 6, "729 Thomas St", "key lime pie; conch fritters", 24.5507, -81.8001)]


@pytest.fixture(scope="module")
def places(spark):
    return D.with_search_columns(spark.createDataFrame(ROWS, COLS)).cache()


def ids(df):
    return [r.id for r in df.select("id").collect()]


def ask(places, text, guide="all", order="name", filters=D.Filters(), here=None):
    return ids(Q.guide_query(places, guide, filters, text, order, here))


def test_guides_and_venues(places):
    assert "e" not in ask(places, "") and "e" in ask(places, "", filters=D.Filters(include_non_restaurants=True))
    assert [ask(places, "", g) for g in ("cuban", "stonecrab", "oyster", "keys", "oldest", "nearme")] == [["a"], ["b"], ["f"], ["j"], ["b"], []]
    assert set(ask(places, "", "honors", "iconic")) == {"a", "b"}


def test_inspection_orders(places):
    assert ask(places, "", "inspections", "recent") == ["g", "a", "j", "b"]
    assert ask(places, "", "inspections", "most_high") == ["j", "g", "b", "a"]
    assert ask(places, "", "inspections", "fewest_high") == ["b", "a", "g", "j"]


def test_nearest(places):
    near = ask(places, "", "nearme", "nearest", here=(25.7655, -80.25))
    assert near[0] == "a" and near.index("b") < near.index("f")


@pytest.mark.parametrize("text,want", [("vermon", ["a"]), ("ermont", []), ("moes", ["b"]), ("southwest 8th street", ["h", "a"]), ("croquetas", ["a"]), ("stone crab", ["b"]), ("key west", ["j"]), ("monroe", ["j"]),
                                       ("\U0001F355", []), ("!!! ?", []), ("cuban corner", ["d"]), ("seafood bayport", ["f"]), ("e 7th ave tampa", ["d", "g"])])
def test_search(places, text, want):
    assert ask(places, text) == want


def test_parse(spark, places):
    towns = Q.town_lookup(places).unionByName(spark.createDataFrame([("melbourne", "Melbourne")], "town_key string, town string"))
    rows = spark.createDataFrame([(1, "stone crab near me"), (2, "croquetas"), (3, "orlando dr"), (4, "brady st"), (5, "the")], "query_id int, text string")
    got = {r.query_id: r for r in Q.parse_queries(rows, towns).collect()}
    assert (got[1].tag, got[1].town, got[1].tokens) == ("stonecrab", None, []) and got[2].tag is None
    assert got[3].town is None and got[4].tokens == [[" brady st ", " brady st"]] and got[5].tokens == [[" the"]]


def test_filters(places):
    assert "c" not in ask(places, "", filters=D.Filters(hide_chains=True)) and "d" not in ask(places, "", filters=D.Filters(confirmed_only=True))
    assert set(ask(places, "", filters=D.Filters(town="Tampa"))) == {"d", "g"} and D.Filters(town="Tampa", bib_gourmand=True).active_count == 2
    assert ask(places, "", filters=D.Filters(bib_gourmand=True)) == []


def test_promo_layers_and_counts(places):
    assert set(ids(places.filter(~D.promo_ok()))) == {"g", "j"}
    assert set(ids(D.map_view(places, "seafood", D.Filters(), 26, -81, 9, 9))) == {"b", "f", "j"}
    assert ids(D.map_view(places, "all", D.Filters(), 26, -81, 9, 9)) == []
    n = {r.guide: r.n for r in D.mark_counts(places, D.Filters()).collect()}
    assert n["cuban"] == 1 and n["all"] == 8 and n["inspections"] == 4
    assert len(ids(D.capped_viewport(places, 25.77, -80.2, limit=3))) == 3 and ids(D.capped_viewport(places, 25.77, -80.2, limit=2)) == ["a", "b"]
    assert ids(D.random_pick(places.filter("tier = 0"), 3, last="d")) == []


def test_name_matches_lead(spark, places):
    hits = spark.createDataFrame([(1, "a", True), (1, "b", False), (2, "a", True)], "query_id int, place_id string, name_hit boolean")
    assert {(r.query_id, r.place_id): r.lead for r in Q.name_first(hits).collect()} == {(1, "a"): 0, (1, "b"): 1, (2, "a"): 1}
    assert ids(Q.saved_places(places, spark.createDataFrame([("j",), ("a",)], "id string"))) == ["j", "a"]
    assert ids(Q.find_by_id(places, "g")) == ["g"] and F is not None

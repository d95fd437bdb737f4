"""Queries that did less than their whole job, on rows of their own."""
import pytest

import __spark_entry__ as entry


@pytest.fixture
def folder(spark, tmp_path):
    """Writes tables as the queries read them: folder(name=(rows, schema), ...) gives the folder."""
    def write(**tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)
    return write


def test_legal_holder_flags_gives_all_four_flags(spark, folder):
    texts = ["Joe's Grill", "Sunrise Hotel", "Gulf Holdings", "Plain words", "Café Hotel Group inc."]
    sf = folder(documents=([(2 * i + 1, t) for i, t in enumerate(texts)] + [(10, "Elks Lodge Diner")], "doc_id long, text string"))
    got = {r["doc_id"]: (r["is_legal"], r["legalish"], r["holder"], r["foodish"]) for r in entry.queries()["legal_holder_flags"](spark, sf).collect()}
    assert got == {1: (False, False, False, True), 3: (False, False, True, False), 5: (False, True, False, False), 7: (False, False, False, False), 9: (True, True, True, True), 10: (True, False, True, True)}


PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
EVENTS = "event_id long, user_id long, ts timestamp, event_type string, value double, props string"
SAME_SPOT = 25 * 997 * 991              # places whose numbers differ by this stand at one spot


def test_flag_adult_venue_takes_near_names_points_of_the_category_and_web_words(spark, folder):
    part = lambda i, name, kind: (i, name, "B", kind, 1, 1.0)
    sf = folder(part=([part(4, "cold ring", "ECONOMY"), part(4 + SAME_SPOT, "old ring", "PROMO"), part(3, "cold ring", "ECONOMY"), part(3 + SAME_SPOT, "old ring", "LARGE"),
                       part(4 + 2 * SAME_SPOT, "blue rod", "ECONOMY"), part(28 + 25 * 90, "small ring", "SMALL"), part(89, "blue rod", "LARGE"), part(5, "red ring", "SMALL")], PART),
                events=([], EVENTS))
    got = {r["id"] for r in entry.queries()["flag_adult_venue"](spark, sf).filter("listed_venue").collect()}
    assert got == {4, 4 + SAME_SPOT, 28 + 25 * 90, 89, 5}

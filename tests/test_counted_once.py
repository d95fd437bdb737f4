"""Work done once per distinct value, results row by row."""
from wayfound.operators import joins as J, quality as Q, spatial as SP


def test_bad_names_of_repeated_ids(spark):
    texts = spark.createDataFrame([(1, "at Joes Grill now"), (2, "at Joes Grill now"), (3, "Joes Grill"), (3, "a Grill"), (4, None), (None, "Joes Grill")], "t long, body string")
    names = spark.createDataFrame([("JOES GRILL",), ("GONE BAR",)], "name string")
    assert sorted(r.t for r in Q.bad_names_in_text(texts, names, text_id="t", body="body").collect()) == [1, 2, 3, 3]


def test_best_match_without_sorting_all_pairs(spark):
    rows = [(1, 5, 2.0), (1, 4, 2.0), (1, 3, 1.0), (2, None, 3.0), (2, 1, 3.0), (3, 9, None), (None, 7, 1.0), (None, 6, 1.0)]
    best = J.best_match_left(spark.createDataFrame(rows, "lid long, rid long, score double"))
    assert sorted((r.lid or 0, r.rid or 0) for r in best.collect()) == [(0, 6), (1, 4), (2, 0), (3, 9)]
    assert "Window" not in best._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[-1]     # pairs are aggregated before they are ranked


def test_only_donor_lends(spark):
    needy = spark.createDataFrame([(1, 10.0, 10.0), (2, 20.0, 20.0), (3, 30.0, 30.0), (4, None, None)], "id long, lat double, lon double")
    donors = spark.createDataFrame([(1, 10.0001, 10.0, "b"), (2, 20.0, 20.0, "x"), (3, 20.0, 20.0, "y"), (1, 50.0, 50.0, "a"), (5, 20.0001, 20.0, "z")], "d long, lat double, lon double, v string")
    got = SP.nearest_unique_borrow(needy, donors, id="id", donor_id="d", value="v")
    assert sorted((r.id, r.v) for r in got.collect()) == [(1, "b"), (2, None), (3, None), (4, None)]

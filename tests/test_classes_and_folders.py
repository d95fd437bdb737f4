"""Streams over tables that are folders; matching by address where many rows share a name."""
from wayfound.operators import matching as M
from wayfound.streaming import streams as ST


def test_stream_reads_a_table_that_is_a_folder(spark, tmp_path):
    spark.range(30).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    ST.run_to_table(ST.read_stream(spark, str(tmp_path), "documents.parquet"), f"{tmp_path}/out", f"{tmp_path}/checkpoint", mode="append")
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(30))


def _rows(spark, ids, names, first):
    return [(first + i, names[i % len(names)], names[i % len(names)], str(i % 2 + 1), "MAIN ST", None if i % 5 == 0 else "c1", 26.0, -80.0 + i) for i in range(ids)]


def _twin_sides(spark, n):
    schema = "id long, name string, k string, num string, street string, county string, lat double, lon double"
    return (spark.createDataFrame(_rows(spark, n, ["OYSTER BARN", "OAK GRILL", "PELICAN DINER"], 0), schema),
            spark.createDataFrame(_rows(spark, n, ["OYSTER BARN", "OAK GRILL"], 10000), schema))


def test_hand_checked_twin_takes_least_of_many_equal_names(spark):
    l, r = _twin_sides(spark, 30)
    got = {x["id"]: x["twin"] for x in M.hand_checked_twin(l, r).collect()}
    rows = r.collect()
    for x in l.collect():
        fits = [y["id"] for y in rows if y["name"] == x["name"] and y["num"] == x["num"] and (x["county"] is None or x["county"] == y["county"])]
        assert got.get(x["id"]) == min(fits, default=None)


def _widest(monkeypatch):
    """Most rows that any scoring step is given."""
    seen, plain = [], M.on_distinct

    def counted(df, cols, values, prepare=None):
        seen.append(df.count())
        return plain(df, cols, values, prepare)
    monkeypatch.setattr(M, "on_distinct", counted)
    return seen


def test_pairs_at_one_address_do_not_grow_with_copies(spark, monkeypatch):
    seen = _widest(monkeypatch)
    for n in (60, 180):
        M.hand_checked_twin(*[d.withColumn("lat", d["id"] * 0.01) for d in _twin_sides(spark, n)]).count()
    assert len(seen) == 8 and seen[0] == seen[4] and seen[1] == seen[5]            # the address side: name pairs, key pairs
    names = ["OYSTER BARN", "OAK GRILL"]
    sizes = []
    for n in (20, 80):
        cur = spark.createDataFrame([(i, [names[i % 2]], "1", ["1"], "MAIN ST", "t", None, False) for i in range(n)],
                                    "cid long, names array<string>, num string, nums array<string>, street string, town string, zip string, chain boolean")
        places = spark.createDataFrame([(i, names[i % 2], "1", ["1"], "MAIN ST", "t", "") for i in range(n)], "pid long, k string, num string, nums array<string>, street string, town string, zip string")
        before = len(seen)
        got = {(x["cid"], x["pid"], x["tier"]) for x in M.curated_match(cur, places).collect()}
        assert got == {(i, i % 2, 1) for i in range(n)}
        sizes.append(seen[before:])
    assert sizes[0] == sizes[1] and sizes[0]

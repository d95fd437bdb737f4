"""Derived views over keys whose powers do not fit 64 bits."""
import pytest

from wayfound.plans.tables import view

KEYS = [None, 0, 1, 19999, 1199999, 7200001, 3_000_000_007, 991 * 10**9, -5]


@pytest.mark.parametrize("table,name,id,columns", [
    ("part", "fx_place", "id", "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
    ("customer", "fx_address", "lic", "c_custkey long")])
def test_points_of_large_keys(spark, tmp_path, table, name, id, columns):
    rows = [(k, "red ring", "Brand#1", "SMALL", 1, 1.0) if table == "part" else (k,) for k in KEYS]
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/{table}.parquet")
    got = {r[id]: (r["lat"], r["lon"]) for r in view(spark, str(tmp_path), name).collect()}
    rest = lambda v, n: abs(v) % n * (1 if v >= 0 else -1)              # the sign of the dividend, as in SQL
    assert got.keys() == set(KEYS) and got[None] == (None, None)
    for k in KEYS[1:]:
        assert got[k][0] == pytest.approx(24.3 + rest(k, 25) * 0.2 + rest(k * k * 7919 + k * 31, 997) / 10000)
        assert got[k][1] == pytest.approx(-87.7 + rest(k, 25) * 0.3 + rest(k * k * k * 13 + k * 104729, 991) / 10000)

"""A slice of the registered queries against their SQL on the smallest tables, and the entry contract."""
import collections
import math

import pytest

duckdb = pytest.importorskip("duckdb")
import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KEYS = ["latest_results_by_region", "current_era", "pct_rank_avg", "export_order", "street_key", "url_strip_tracking", "sim_ratio", "proximity_join", "point_in_polygon_join", "search_match", "sort_nearest",
        "match_rates_multi_scope", "collect_link_context", "keep_rule", "impute_price_cascade", "link_verdict", "snapshot_diff", "scan_csv_union", "stream_latest_state"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else str(int(v)) if v == int(v) else repr(round(v, 6))
    return str(v)


@pytest.mark.parametrize("key", KEYS)
def test_query_equals_sql(spark, con, key):
    df = entry.queries()[key](spark, SF)
    cols = sorted(df.columns)
    got = collections.Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(entry.oracle_sql()[key])
    names = [d[0] for d in cur.description]
    at = sorted(range(len(names)), key=lambda i: names[i])
    assert sorted(names) == cols
    assert got == collections.Counter(tuple(norm(r[i]) for i in at) for r in cur.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["region", "met", "followup", "closed", "ungrouped"] and df.count() > 0


def test_no_crossing_in_any_join_plan(spark):
    """Without broadcasts, matching and search plans hold no nested loops."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for key in ("proximity_join", "similar_name_join", "search_match", "point_in_polygon_join", "blocklist_filter", "curated_match", "snap_rare_spelling", "flag_adult_venue"):
            plan = entry.queries()[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
            assert "NestedLoop" not in plan and "Cartesian" not in plan, key
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)

"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from pyspark.sql import SparkSession  # noqa: E402

from wayfound.plans import CATALOG  # noqa: E402

HEADLINE = ["latest_results_by_region", "latest_visit", "current_era", "inspection_summary", "dedupe_keep_first", "street_key", "norm_name", "sim_ratio", "name_sim", "proximity_join", "similar_name_join",
            "one_to_one_match", "suppress_duplicates_ranked", "point_in_polygon_join", "geocode_cascade", "search_match", "guide_query", "sort_nearest", "match_rates_multi_scope", "mention_counts", "city_dashboard",
            "cuisine_by_rules", "impute_price_cascade", "sales_profit_model", "page_spam_reasons", "blocklist_filter", "snapshot_diff", "stream_latest_state"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.adaptive.enabled", "true").config("spark.wayfound.scanPartitions", cpus)
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    CATALOG["value_counts"][0](spark, sf).collect()                 # JVM warm-up
    CATALOG["sim_ratio"][0](spark, sf).limit(1).collect()           # Python workers up
    seconds = {}
    for key in HEADLINE:
        start = time.perf_counter()
        CATALOG[key][0](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[key] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()

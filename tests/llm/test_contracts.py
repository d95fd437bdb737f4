"""Rows that contracts keep: large vectors and repeated ids in the search, repeated ids in the toxicity sample, columns whose names helpers might use."""
import random

import pytest
from pyspark.sql import functions as F

from wayfound.llm import decontaminate, mixing, near_copies, pivot_search, quality, simhash, toxicity, url_lists

NAMES = ("_text_hash", "_key", "_bytes", "_copy", "_host", "_section", "_id", "_h", "_n", "_d", "_row", "_doc", "_text", "_source", "_from", "_of", "copies", "_on", "_url", "_day", "_best", "key", "h")


def test_large_vectors_and_repeated_ids_equal_all_pairs(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(150)]
    rows += [(200, [70000.0, 0.0, 1.0, 0.0, 0.0]), (220, [100000.0, -2.0, 0.5, 1.0, 1.0]), (221, [-3e9, 1.0, 0.0, 0.0, 2.0]), (240, [1e12, 3.0, 0.0, 0.0, 0.0]), (241, [2.0 ** 47, 1.0 + 2.0 ** -6]), (260, [0.0] * 5)]
    rows += [(20, [5.0, 5.0, 5.0, 5.0, 5.0]), (7, [4.0, 4.0, 4.0, 4.0, 4.0]), rows[7], rows[40], (300, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(map(tuple, pivot_search.nearest_vectors(df).collect()))
    whole = [(i, list(v)) for i, v in {(i, tuple(int((x * 64) // 1) for x in v)) for i, v in rows}]         # rows equal in both count once
    dot = lambda a, b: max(-2 ** 63, min(2 ** 63 - 1, sum(x * y for x, y in zip(a, b))))
    want = []
    for q, v in whole:
        if q % 20 == 0:
            best = sorted((-dot(v, c), i) for i, c in whole if i != q)[:20]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_an_id_on_many_rows_is_learned_once(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(60)] + [(i, f"word {i} vile" if i % 2 else f"word {i}") for i in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)] + [(1, 1)] * 40, "doc_id long, toxic int")
    seen = []
    keep = toxicity.train
    try:
        toxicity.train = lambda docs_, y, language: seen.append(len(docs_)) or keep(docs_, y, language)
        assert toxicity.toxicity_scores(docs, labels).count() == 118
    finally:
        toxicity.train = keep
    assert seen and seen[0] <= 59


@pytest.fixture(scope="module")
def crowded(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcde") for _ in range(4))
    texts = [" ".join(word() for _ in range(40)) for _ in range(12)]
    rows = [(i, t, "s" + str(i % 3)) for i, t in enumerate(texts + texts[:3])] + [(50, None, None), (None, "", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return docs.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in NAMES])


def untouched(out, docs):
    want = {tuple(r) for r in docs.collect()}
    assert out.columns == docs.columns and {tuple(r) for r in out.collect()} <= want


def test_columns_of_any_name_come_through(spark, crowded):
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, crowded.first()["text"])], "item_id long, text string")
    untouched(simhash.keep_one(crowded), crowded)
    untouched(simhash.keep_one(crowded, words=5, groups=near_copies.near_copies), crowded)
    untouched(decontaminate.drop_contaminated(crowded, bench), crowded)
    untouched(mixing.mix_sources(crowded), crowded)
    untouched(quality.drop_low_quality(crowded, labels, decide=0.0), crowded)
    assert mixing.mix_sources(crowded).count() > 0 and quality.drop_low_quality(crowded, labels, decide=0.0).count() == crowded.count()
    pages = crowded.select("*", F.lit("http://a.example/x").alias("url"), F.lit("2024-01-05").cast("date").alias("day"))
    entries = spark.createDataFrame([("l", "a.example", "block", "add", "2024-01-01")], "list string, key string, action string, change string, day string").withColumn("day", F.to_date("day"))
    out = url_lists.filter_urls(pages, entries)
    assert out.columns[:len(pages.columns)] == pages.columns and {tuple(r)[:len(pages.columns)] for r in out.collect()} == {tuple(r) for r in pages.collect()}
    assert out.filter("verdict = 'block'").count() == pages.count()

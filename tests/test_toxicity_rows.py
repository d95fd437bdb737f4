"""The toxicity network learns from every labelled row, whatever its length."""
from wayfound.llm.toxicity import fit, labelled_words


def test_every_labelled_row_teaches(spark):
    rows = [(i, ("x " * 20000 if i % 2 else "") + f"word{i} plain") for i in range(300)] + [(7, None), (None, "nobody")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3 and 1) for i in range(300)] + [(999, 1)], "doc_id long, toxic int")
    got = labelled_words(docs, labels).collect()
    assert len(got) == 300 and sum(r["label"] for r in got) == 200
    assert sum(len(r["words"]) // 8 > 20000 for r in got) == 149           # long texts whole; of id 7's two texts the empty one


def test_one_class_alone(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "")], "doc_id long, text string")
    assert fit(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")).bias == 1.0
    assert fit(docs, spark.createDataFrame([], "doc_id long, toxic int")).bias == -1.0


def test_only_labelled_texts_and_moved_numbers_are_sent(spark):
    import numpy as np
    from pyspark.sql import functions as F
    from wayfound.llm import toxicity as T
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    told = docs.filter("doc_id % 10 = 0").select(F.col("doc_id").alias("_id"), (F.col("doc_id") % 20 / 20).cast("int").alias("label"))
    kept = {r.doc_id for r in T._maybe_told(docs, told).collect()}
    assert kept >= set(range(0, 2000, 10)) and len(kept) < 210
    labels = told.select(F.col("_id").alias("doc_id"), (F.col("_id") / 10 % 2).cast("int").alias("toxic"))
    rows = T.labelled_words(docs, labels).repartition(3, "words").cache()
    seen, n = T._presence(rows)
    net, parts = T.start(seen, n), [p for p in rows.rdd.glom().collect() if p]
    steps = []
    for part in parts:
        d = [np.frombuffer(bytes(r.words), np.uint16).reshape(-1, 1 + len(T.STEMS)).astype(np.int32) for r in part]
        some = [(d[i:i + T.BATCH], np.array([float(r.label) for r in part[i:i + T.BATCH]])) for i in range(0, len(d), T.BATCH)]
        steps.append(T.parameters(T.take_steps(net, some, 0.5)).astype(float) * len(part))
    want = sum(steps) / len(rows.collect())
    assert np.allclose(T.parameters(T._epoch(rows, net, 0.5, 200)), want, atol=1e-7) and int(n.sum()) == 200

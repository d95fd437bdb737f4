"""Registered queries of the operators, and SQL for those that it can express."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _op1(spark, sf):
    from .pivot_search import nearest_vectors
    return nearest_vectors(_table(spark, sf, "embeddings"))


def _op2(spark, sf):
    from .simhash import near_duplicate_digest
    return near_duplicate_digest(_table(spark, sf, "documents"))


def _op3(spark, sf):
    from .decontaminate import contamination_digest
    return contamination_digest(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def _op4(spark, sf):
    from .url_lists import judged_pages
    return judged_pages(_table(spark, sf, "pages"))


def _op5(spark, sf):
    from .lm import language_model_scores
    return language_model_scores(_table(spark, sf, "documents"))


def _op6(spark, sf):
    from .quality import quality_scores
    return quality_scores(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def _op7(spark, sf):
    from .toxicity import toxicity_scores
    return toxicity_scores(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def _op8(spark, sf):
    from .sharding import shard_documents
    return shard_documents(_table(spark, sf, "documents"))


def _op9(spark, sf):
    from .repeats import repeats_digest
    return repeats_digest(_table(spark, sf, "documents"))


def _op10(spark, sf):
    from .mixing import mix_digest
    return mix_digest(_table(spark, sf, "documents"))


def _op11(spark, sf):
    from .packing import packing_digest
    return packing_digest(_table(spark, sf, "documents"))


def _op12(spark, sf):
    from .lexical import ranked_search
    return ranked_search(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def _op13(spark, sf):
    from .spelling import spelling_groups
    return spelling_groups(_table(spark, sf, "documents"))


from .lexical import SEARCH_SQL  # noqa: E402
from .mixing import MIX_SQL  # noqa: E402
from .pivot_search import TOPK_SQL  # noqa: E402
from .url_lists import URL_SQL  # noqa: E402

CATALOG = {"op1_pivot_topk": (_op1, TOPK_SQL), "op2_simhash": (_op2, None),
           "op3_decontamination": (_op3, None), "op4_url_filters": (_op4, URL_SQL), "op5_lm_scoring": (_op5, None), "op6_quality": (_op6, None), "op7_toxicity": (_op7, None),
           "op8_sharding": (_op8, None), "op9_repeats": (_op9, None), "op10_mixing": (_op10, MIX_SQL), "op11_packing": (_op11, None),
           "op12_lexical_search": (_op12, SEARCH_SQL), "op13_spelling": (_op13, None)}

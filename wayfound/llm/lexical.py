"""Ranked lexical search: a stated set of items against all documents, as products of dense blocks.

Items are dealt into blocks of bounded size; a block's distinct terms are its vocabulary. One pass turns every document into its vocabulary codes and counts,
from which document frequencies, lengths and totals follow. Then tiles of documents (rows of impacts) are multiplied with tiles of items (columns of weights)
in float64, one tile of the items' own vocabulary at a time. All numbers are whole, and vocabulary tiles are cut so that no sum can reach 2**53: products are exact
in any order of summation and are added up in 64-bit integers. Each tile keeps its best rows of every item, ties and all decided by doc_id; Spark merges them."""
from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from ..operators.scale import running_total
from .common import as_bytes, stage
from .terms import alphanumeric, pair_counts, term_blocks

ENTRIES = 1 << 17                           # distinct (item, term) pairs of a block: what the driver and every task hold of the items
DOCS, ITEMS, VOCABULARY = 2048, 256, 2048   # rows, columns and inner length of the tiles
SCALE = 1_000_000_000
EXACT = 1 << 53


def _counted(values: pa.Array, vocabulary: pa.Array | None):
    """(words per row, row, code, count): all terms of each row, and counts of the distinct ones; with a vocabulary only its terms, by their place in it."""
    n = np.zeros(len(values), np.int64)
    found, own = [], {}
    for t in term_blocks(values, alphanumeric):
        n += np.bincount(t.row, minlength=n.size)
        if vocabulary is None:
            place = np.array([own.setdefault(w, len(own)) for w in t.words.to_pylist()], np.int64)
        else:
            place = pc.fill_null(pc.index_in(t.words, value_set=vocabulary), -1).to_numpy().astype(np.int64)
        code = place[t.code]
        on = code >= 0
        found.append((t.row[on], code[on]))
    row, code = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
    size = max(1, len(own) if vocabulary is None else len(vocabulary))
    return (n, *pair_counts(row, code, size), list(own))


def _lists(row: np.ndarray, rows: int, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32)), values)


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms, counts, entries, _row) of the items that have terms, staged."""
    slim = items.select("item_id", as_bytes(F.col("text")).alias("text"))

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                b = batch.slice(first, 256)
                n, row, code, count, words = _counted(b.column(1), None)
                on = pa.array(np.flatnonzero(n > 0))
                terms = _lists(row, b.num_rows, pa.array([words[c] for c in code.tolist()], pa.binary()))
                counts = _lists(row, b.num_rows, pa.array(count.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).take(on), terms.take(on), counts.take(on), pa.array(np.bincount(row, minlength=b.num_rows)[n > 0])],
                                                 names=["item_id", "terms", "counts", "entries"])
    kind = slim.schema["item_id"].dataType.simpleString()
    return stage(slim.mapInArrow(run, f"item_id {kind}, terms array<binary>, counts array<long>, entries long").withColumn("_row", F.monotonically_increasing_id()), "items")


def impacts_of(docs: DataFrame, vocabulary: list) -> DataFrame:
    """(doc_id, n, codes, counts) of every document that has a term: n is its number of terms, ``codes`` its terms of the vocabulary."""
    slim = docs.select("doc_id", as_bytes(F.col("text")).alias("text"))

    def run(batches):
        known = pa.array(vocabulary, pa.binary())
        for batch in batches:
            for first in range(0, batch.num_rows, DOCS):
                b = batch.slice(first, DOCS)
                n, row, code, count, _ = _counted(b.column(1), known)
                on = pa.array(np.flatnonzero(n > 0))
                yield pa.RecordBatch.from_arrays([b.column(0).take(on), pa.array(n[n > 0]), _lists(row, b.num_rows, pa.array(code.astype(np.int32))).take(on),
                                                  _lists(row, b.num_rows, pa.array(count.astype(np.int32))).take(on)], names=["doc_id", "n", "codes", "counts"])
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n long, codes array<int>, counts array<int>")


class Tile(NamedTuple):
    """One vocabulary tile of one tile of items: weights at (place, column)."""
    items: int                  # first item of the columns
    codes: np.ndarray           # ascending vocabulary codes of the tile's rows
    place: np.ndarray
    column: np.ndarray
    weight: np.ndarray


def weight_tiles(item: np.ndarray, code: np.ndarray, weight: np.ndarray, items: int, most_impact: int) -> list[Tile]:
    """Cuts (item, code, weight) into tiles in which no item's weights add up to EXACT / most_impact or more, so that every partial sum of a product stays
    below 2**53. A single weight beyond that stands in several tiles in parts."""
    bound = (EXACT - 1) // most_impact
    out = []
    for first in range(0, items, ITEMS):
        on = (item >= first) & (item < first + ITEMS)
        entries = sorted(zip(code[on].tolist(), (item[on] - first).tolist(), weight[on].tolist()))
        used, rows, codes = np.zeros(ITEMS, object), [], []

        def close():
            if rows:
                at, column, w = (np.array(x) for x in zip(*rows))
                out.append(Tile(first, np.array(codes, np.int64), at, column, w.astype(np.float64)))
        for c, i, w in entries:
            while w > 0:
                part = min(w, bound)
                if used[i] + part > bound or (len(codes) == VOCABULARY and codes[-1] != c):
                    close()
                    used, rows, codes = np.zeros(ITEMS, object), [], []
                if not codes or codes[-1] != c:
                    codes.append(c)
                rows.append((len(codes) - 1, i, part))
                used[i] += part
                w -= part
        close()
    return out


def impact(count: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """(10**9 * count) div (1000 * count + 12 * m) with m = 75 + (25 * n * documents) div length."""
    if n.size and 25 * documents * int(n.max()) >= 1 << 63:
        m = np.array([75 + 25 * x * documents // length for x in n.tolist()], np.int64)
    else:
        m = 75 + 25 * documents * n // length
    return SCALE * count // (1000 * count + 12 * m)


def _best(scores: np.ndarray, top: int, floor: np.ndarray):
    """(item, document) of each row's ``top`` highest scores above 0 and not below ``floor``; equal scores by document. ``floor`` rises to the top-th."""
    if scores.shape[1] > top:
        kth = np.partition(scores, scores.shape[1] - top, axis=1)[:, scores.shape[1] - top]
        np.maximum(floor, kth, out=floor)
    item, doc = np.nonzero((scores >= floor[:, None]) & (scores > 0))
    order = np.lexsort((doc, -scores[item, doc], item))
    item, doc = item[order], doc[order]
    within = np.arange(item.size) - np.searchsorted(item, item)
    return item[within < top], doc[within < top]


def _tile_scores(codes, counts, row, n, rows: int, tiles: list[Tile], items: int, documents: int, length: int) -> np.ndarray:
    """Scores (item, document) of one tile of documents."""
    value = impact(counts, n[row], documents, length).astype(np.float64)
    total = np.zeros((items, rows), np.int64)
    for t in tiles:
        at = np.minimum(np.searchsorted(t.codes, codes), t.codes.size - 1)
        on = t.codes[at] == codes
        if on.any():
            left = np.zeros((rows, t.codes.size))
            left[row[on], at[on]] = value[on]
            width = min(ITEMS, items - t.items)
            right = np.zeros((t.codes.size, width))
            right[t.place, t.column] = t.weight
            total[t.items:t.items + width] += (left @ right).T.astype(np.int64)
    return total


def _rank_block(docs: DataFrame, block: DataFrame, top: int) -> DataFrame:
    spark = docs.sparkSession
    rows = block.orderBy("_row").collect()                  # at most ENTRIES terms and the last item's
    vocabulary = sorted({bytes(t) for r in rows for t in r["terms"]})
    place = {t: i for i, t in enumerate(vocabulary)}
    held = stage(impacts_of(docs, vocabulary), "postings")
    documents, length = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(held.select(F.explode("codes").alias("c")).groupBy("c").agg(F.count("*").alias("df")).toPandas().itertuples(index=False, name=None))
    weigh = lambda c: math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(c, 0) + 1)))
    entries = [(i, place[bytes(t)], weigh(place[bytes(t)]) * c) for i, r in enumerate(rows) for t, c in zip(r["terms"], r["counts"])]
    item, code, weight = (np.array(x, object if k == 2 else np.int64) for k, x in enumerate(zip(*entries)))
    # an impact is below 10**9 / 1000; the bound on partial sums follows
    tiles = weight_tiles(item, code, weight, len(rows), SCALE // 1000)

    def run(batches):
        floor = np.zeros(len(rows), np.int64)               # a row below the top-th of an earlier tile of this task can't be among the best
        for batch in batches:
            for first in range(0, batch.num_rows, DOCS):
                b = batch.slice(first, DOCS)
                b = b.take(pc.sort_indices(b.column(0), null_placement="at_end"))
                size = b.column(2).value_lengths().to_numpy().astype(np.int64)
                row = np.repeat(np.arange(size.size), size)
                scores = _tile_scores(b.column(2).flatten().to_numpy().astype(np.int64), b.column(3).flatten().to_numpy().astype(np.int64), row,
                                      b.column(1).to_numpy(), size.size, tiles, len(rows), documents, length)
                i, d = _best(scores, top, floor)
                yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), b.column(0).take(pa.array(d)), pa.array(scores[i, d])], names=["_item", "doc_id", "score"])
    kind = held.schema["doc_id"].dataType.simpleString()
    scored = held.mapInArrow(run, f"_item int, doc_id {kind}, score long")
    rank = F.row_number().over(W.partitionBy("_item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = scored.withColumn("rank", rank).filter(F.col("rank") <= top)
    named = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"_item int, item_id {block.schema['item_id'].dataType.simpleString()}")
    return best.join(named, "_item").select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = 20, entries: int = ENTRIES) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``top`` documents with a score above 0, equal scores by ascending doc_id (null last).

    Items are a stated query set: they are taken in blocks of about ``entries`` distinct terms, each of which reads the documents once more. Repeated terms of an
    item count as often as they occur. Null and empty texts have no terms, on either side; items without terms give no rows. Repeated rows and ids are
    documents (items) of their own. Long texts are cut between terms and their counts added up. Columns other than doc_id, item_id and text are ignored."""
    held = item_terms(items)
    dealt = stage(running_total(held, [], ["_row"], "entries", "_upto").withColumn("_block", F.expr(f"(_upto - entries) div {entries}")), "items")
    found = None
    for (b,) in dealt.select("_block").distinct().orderBy("_block").collect():
        one = _rank_block(docs, dealt.filter(F.col("_block") == b), top)
        found = one if found is None else found.unionByName(one)
    if found is None:
        kinds = f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long"
        found = docs.sparkSession.createDataFrame([], kinds)
    return found


SEARCH_SQL = r"""
with raw as (select row_number() over () as r, doc_id,
  regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as terms from documents),
d as (select r, doc_id, terms, len(terms) as n from raw where len(terms) > 0),
t as (select count(*) as nn, sum(n) as ll from d),
m as (select r, doc_id, 75 + cast((25 * n * nn) // ll as bigint) as m from d, t),
p as (select r, term, count(*) as tf from (select r, unnest(terms) as term from d) group by r, term),
f as (select term, cast(floor(1000 * ln(cast(2 * nn + 2 as double) / cast(2 * df + 1 as double))) as bigint) as w
      from (select term, count(*) as df from p group by term), t),
i as (select q, item_id, term, count(*) as c from (select row_number() over () as q, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as term from benchmark) group by q, item_id, term),
s as (select q, item_id, doc_id, cast(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) as bigint) as score
      from i join f using (term) join p using (term) join m using (r) group by q, item_id, r, doc_id)
select item_id, cast(rank as int) as rank, doc_id, score
from (select *, row_number() over (partition by q order by score desc, doc_id) as rank from s where score > 0) where rank <= 20"""

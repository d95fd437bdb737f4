"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are sets of word shingles that a document must hold whole, so one shingle of each window is enough to find it: the one that is
rarest in the documents. Documents are searched for these only; a hit says where the window must stand, length and position rule out most, and the
words of the window are compared exactly."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import as_bytes, bitmap, in_bitmap, stage
from .words import NOT_ALNUM, shingle_hash, word_groups

WINDOW, SHINGLE, BITS = 10, 3, 23


def _texts(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(F.col(key).cast("string").alias("key"), as_bytes(F.col("text")).alias("text"))


def _strings(data: bytes, start, end) -> list[str]:
    return [data[a:b].decode("utf-8", "replace") for a, b in zip(start.tolist(), end.tolist())]


def item_windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(item, words array, tokens array<long>): every run of ``window`` words; an item of fewer words, but not none, is one window. tokens: hashes of its
    shingles in order."""
    def run(batches):
        for b in batches:
            keys = b.column(0).to_pylist()
            for first, last, w in word_groups(b.column(1), NOT_ALNUM):
                data = w.data.tobytes()
                out = []
                for r in range(first, last):
                    i, j = w.first[r - first], w.first[r - first + 1]
                    words, hashes = _strings(data, w.start[i:j], w.end[i:j]), w.hash[i:j]
                    for at in range(max(1, len(words) - window + 1) if words else 0):
                        part = hashes[at:at + window]
                        out.append((keys[r], words[at:at + window], shingle_hash(part, min(shingle, part.size)).view(np.int64).tolist()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.list_(pa.string())),
                                                      pa.array([o[2] for o in out], pa.list_(pa.int64()))], names=["item", "words", "tokens"])
    return _texts(items, "item_id").mapInArrow(run, "item string, words array<string>, tokens array<long>")


def _shingles(h: np.ndarray, flags: np.ndarray, sizes: list[int]):
    """(position, size, hash) of the shingles whose hash is flagged."""
    for n in sizes:
        s = shingle_hash(h, n)
        at = np.flatnonzero(in_bitmap(flags, s))
        if at.size:
            yield at, n, s[at]


def token_counts(docs: DataFrame, flags: np.ndarray, sizes: list[int]) -> DataFrame:
    """(token, n): how often each flagged shingle stands in all documents."""
    def run(batches):
        for b in batches:
            for _, _, w in word_groups(b.column(0), NOT_ALNUM):
                found = [s for _, _, s in _shingles(w.hash, flags, sizes)]
                if found:
                    token, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], names=["token", "n"])
    return docs.select(as_bytes(F.col("text")).alias("text")).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def document_hits(docs: DataFrame, flags: np.ndarray, sizes: list[int], window: int = WINDOW) -> DataFrame:
    """(doc_id, h, n_words, hits): one row per document, hits being array<struct<at, token, from, around>>: a flagged shingle at word ``at`` and the words
    from ``from`` on that any window over it can cover."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    hit = pa.struct([("at", pa.int32()), ("token", pa.int64()), ("from", pa.int32()), ("around", pa.list_(pa.string()))])

    def run(batches):
        for b in batches:
            for first, last, w in word_groups(b.column(2), NOT_ALNUM):
                data, hits = w.data.tobytes(), [[] for _ in range(last - first)]
                for at, n, token in _shingles(w.hash, flags, sizes):
                    row = np.searchsorted(w.first, at, "right") - 1
                    row_end = w.first[row + 1]
                    inside = at + n <= row_end                              # a shingle does not run on into the next text
                    for p, r, end, t in zip(at[inside].tolist(), row[inside].tolist(), row_end[inside].tolist(), token[inside].view(np.int64).tolist()):
                        begin = int(w.first[r])
                        lo, hi = max(begin, p - window + 1), min(end, p + window)
                        hits[r].append({"at": p - begin, "token": t, "from": lo - begin, "around": _strings(data, w.start[lo:hi], w.end[lo:hi])})
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, last - first), b.column(1).slice(first, last - first), pa.array(np.diff(w.first).astype(np.int64)),
                                                  pa.array(hits, pa.list_(hit))], names=["doc_id", "h", "n_words", "hits"])
    slim = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("h"), as_bytes(F.col("text")).alias("text"))
    return slim.mapInArrow(run, f"doc_id {kind}, h long, n_words long, hits array<struct<at:int,token:long,from:int,around:array<string>>>")


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """Two staged tables: (doc_id, h, n_words, at, len, win) with one row per occurrence of a window in a document (and one with null ``win`` for each
    document row), and (win, item) with the items of each window.

    What goes to every task is a bit map of 2**bits flags, whatever the number of items; it only thins the shingles that are joined."""
    wins = stage(item_windows(items, window, shingle).withColumn("win", F.sha2(F.array_join("words", " "), 256)), "windows")
    sizes = [r[0] for r in wins.select(F.least(F.size("words"), F.lit(shingle)).alias("n")).distinct().collect()]      # at most ``shingle`` values
    distinct = wins.dropDuplicates(["win"]).select("win", "words", "tokens")
    tokens = distinct.select("win", "words", F.posexplode("tokens").alias("offset", "token"))
    flags = bitmap(tokens, "token", bits)
    counts = token_counts(docs, flags, sizes)
    # the rarest shingle of each window; without a count it stands nowhere, and neither does the window
    ranked = tokens.join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = ranked.groupBy("win").agg(F.min(F.struct("n", "token", "offset", "words")).alias("b")).filter("b.n > 0")
    prefix = stage(best.select("win", "b.token", "b.offset", "b.words"), "prefixes")
    flags = bitmap(prefix, "token", bits)
    found = document_hits(docs, flags, sizes, window)
    rows = found.select("doc_id", "h", "n_words", F.posexplode(F.concat(F.array(F.lit(None).cast("struct<at:int,token:long,from:int,around:array<string>>")), F.col("hits"))).alias("i", "hit"))
    # the row that stands for the document itself takes a key of its own, so that these rows spread
    rows = rows.withColumn("token", F.when(F.col("i") == 0, F.xxhash64("doc_id", "h")).otherwise(F.col("hit.token")))
    start = F.col("hit.at") - F.col("offset")
    fits = (F.col("i") > 0) & (start >= 0) & (start + F.size("words") <= F.col("n_words"))
    # slice() wants a start of at least 1 even where the row is ruled out already
    same = F.slice("hit.around", F.greatest(start - F.col("hit.from") + 1, F.lit(1)), F.size("words")) == F.col("words")
    joined = rows.join(prefix, "token", "left").withColumn("ok", F.coalesce(fits & same, F.lit(False))).filter("i = 0 or ok")
    out = joined.select("doc_id", "h", "n_words", F.when(F.col("ok"), start).alias("at"), F.when(F.col("ok"), F.size("words")).alias("len"), F.when(F.col("ok"), F.col("win")).alias("win"))
    return stage(out, "occurrences"), wins.filter("item is not null").select("win", "item").distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One row per document row: doc_id, h (hash of the text), n_words, n_hit (words inside any occurrence), spans (array<struct<at, end>> of hit words),
    items (sorted texts of item ids).

    Null texts have no words; items without words have no window; a document whose row is repeated is counted once and returned as often as it
    stands; empty tables give no hits. Words inside a window of an item without id are hit like any others; the item has no id to list and is not counted in ``items``."""
    found, of_item = occurrences(docs, items, window, shingle, bits)
    key = ["doc_id", "h"]
    base = found.filter("win is null").groupBy(*key).agg(F.max("n_words").alias("n_words"), F.count("*").alias("copies"))
    hits = found.filter("win is not null").select(*key, "at", "len", "win").distinct()
    line = W.partitionBy(*key).orderBy("at", F.desc("len"))
    ends = hits.withColumn("end", F.col("at") + F.col("len")).withColumn("_before", F.max("end").over(line.rowsBetween(W.unboundedPreceding, -1)))
    fresh = F.col("_before").isNull() | (F.col("_before") < F.col("at"))
    runs = ends.withColumn("_run", F.sum(fresh.cast("int")).over(line)).groupBy(*key, "_run").agg(F.min("at").alias("at"), F.max("end").alias("end"))
    spans = runs.groupBy(*key).agg(F.sum(F.col("end") - F.col("at")).cast("long").alias("n_hit"), F.array_sort(F.collect_list(F.struct("at", "end"))).alias("spans"))
    named = hits.select(*key, "win").distinct().join(of_item, "win").groupBy(*key).agg(F.array_sort(F.collect_set("item")).alias("items"))
    tell = spans.join(named, (spans["doc_id"].eqNullSafe(named["doc_id"])) & (spans["h"] == named["h"]), "left").select(
        spans["doc_id"].alias("_d"), spans["h"].alias("_h"), "n_hit", "spans", "items")
    out = base.join(tell, base["doc_id"].eqNullSafe(F.col("_d")) & (base["h"] == F.col("_h")), "left")
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select("doc_id", "h", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("spans", F.array().cast("array<struct<at:int,end:int>>")).alias("spans"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contamination_digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    return contamination(docs, items).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                                             F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents without any window of an item, with or without id; columns as they are. Null texts have no words and stay."""
    found, _ = occurrences(docs, items)
    bad = found.filter("win is not null").select(F.col("doc_id").alias("_d"), F.col("h").alias("_h")).distinct()
    keyed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_doc"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_text"))          # columns of any name
    return keyed.join(bad, F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_text") == F.col("_h")), "left_anti").select("_row.*")

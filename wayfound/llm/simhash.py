"""Near-duplicate documents by SimHash: 64-bit fingerprints of word shingles, linked at few differing bits.

Links are found in the space of segment popcounts: a fingerprint is cut into 32 segments of two bits and mapped to the vector of their bit counts. The
Manhattan distance of two such vectors is never more than the Hamming distance of the fingerprints, so a range join on the grid of vectors finds
every link; the true distance is then checked."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import as_bytes, stage
from .graph import components

SEGMENTS, SEED, CHUNK = 32, 42, 1 << 16


def fingerprint_of(text: bytes, words: int = 3) -> int:
    """SimHash of the shingles of ``words`` words of a UTF-8 text; A-Z lower-cased. Fewer words: the whole sequence is the one shingle; none: 0."""
    parts = text.lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    n = max(1, len(parts) - words + 1)
    starts = np.concatenate([[0], ends[:n - 1] + 1])
    stops = ends[-n:]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):               # a very long text keeps a bounded number of hashes at a time
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts[at:at + CHUNK].tolist(), stops[at:at + CHUNK].tolist())], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fingerprint long) of every row. Null and empty texts have fingerprint 0."""
    def run(batches):
        for b in batches:
            prints = pa.array([fingerprint_of(t.as_py(), words) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), prints], names=["doc_id", "fingerprint"])
    slim = docs.select("doc_id", as_bytes(F.col("text")).alias("text"))
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, fingerprint long")


def popcount_code(fp: Column) -> Column:
    """The 32 segment popcounts (0, 1, 2), each written as 00, 01, 11: the Manhattan distance of two vectors is then the number of differing bits."""
    odd, other = fp.bitwiseAND(F.lit(0x5555555555555555)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(0x5555555555555555))
    return odd.bitwiseOR(other).bitwiseOR(F.shiftleft(odd.bitwiseAND(other), 1))


def close_pairs(prints: DataFrame, most: int = 3) -> DataFrame:
    """(a, b) with a < b for all pairs of distinct fingerprints (column ``fingerprint``) at ``most`` or fewer differing bits.

    The 32 coordinates are dealt to g = most // 2 + 1 parts; within Manhattan distance ``most`` some part has distance 0 or 1. Each part is a grid of
    unit cells: every fingerprint stands in its own cell and looks into that and the next cell up along each axis (the lower ones look up at it), so
    rows per fingerprint are bounded, and no cell is joined with all. Candidates are cut by the whole Manhattan distance, then by the true one."""
    parts = most // 2 + 1
    width = -(-SEGMENTS // parts)
    coded = prints.select("fingerprint").distinct().withColumn("code", popcount_code(F.col("fingerprint")))
    cells = []
    for p in range(parts):
        low, n = p * width * 2, min(width, SEGMENTS - p * width)
        cells.append(F.struct(F.lit(p).alias("part"), F.shiftrightunsigned("code", low).bitwiseAND(F.lit((1 << 2 * n) - 1 if n < 32 else -1)).alias("cell"), F.lit(n).alias("n")))
    placed = coded.withColumn("_c", F.explode(F.array(*cells))).select("fingerprint", "_c.part", "_c.cell", "_c.n")
    up = """concat(array(cell), filter(transform(sequence(0, n - 1), i -> case shiftrightunsigned(cell, 2 * i) & 3
            when 0 then cell | shiftleft(1L, 2 * i) when 1 then cell | shiftleft(2L, 2 * i) end), c -> c is not null))"""
    looking = placed.select(F.col("fingerprint").alias("other"), "part", F.explode(F.expr(up)).alias("cell"))
    pairs = placed.select("fingerprint", "part", "cell").join(looking, ["part", "cell"]).filter("fingerprint <> other")
    lower = F.bit_count(popcount_code(F.col("fingerprint")).bitwiseXOR(popcount_code(F.col("other"))))
    near = pairs.filter(lower <= most).filter(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("other"))) <= most)
    return near.select(F.least("fingerprint", "other").alias("a"), F.greatest("fingerprint", "other").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, most: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component): component is the least doc_id reachable over links, over all rows of the table.

    Copies share a fingerprint and are counted once, so a group of copies of any size is one point of the search. Null texts have fingerprint 0 and
    link like any other; a null doc_id keeps its row and never names a component unless the whole component has none; repeated rows are kept."""
    marked = stage(fingerprints(docs, words), "prints")
    points = stage(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "points")
    roots = components(close_pairs(points, most))
    rooted = points.join(roots, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    lookup = rooted.join(named, "root").select(F.col("fingerprint").alias("_f"), "component")
    return marked.join(lookup, F.col("fingerprint") == F.col("_f")).select("doc_id", "fingerprint", "component")


def near_duplicate_digest(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, words: int = 3, most: int = 3, groups=None) -> DataFrame:
    """One document of each group of near-duplicates, the one of least (doc_id, text hash); ids count before null. ``groups``, a function of (docs, words, groups of the fingerprints)
    that gives doc_id and component, checks these groups and adds what fingerprints miss. Rows that repeat both id and text are copies, of which one stays; rows that share an id but
    not the text are judged apart. Columns are those of ``docs``."""
    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), text_hash.alias("h"))
    slim = docs.select(key.alias("doc_id"), "text")
    found = near_duplicates(slim, words, most).select("doc_id", "component")
    if groups:
        found = groups(slim, words, found)
    kept = found.filter(F.col("doc_id") == F.col("component")).groupBy(F.col("doc_id").alias("_key")).agg(F.count("*").alias("_n"))
    kept = stage(kept.select(F.col("_key.id").alias("_id"), F.col("_key.h").alias("_h"), "_n"), "kept")
    keyed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_doc"), text_hash.alias("_text"))          # columns of any name
    on = (F.col("_text") == F.col("_h")) & F.col("_doc").eqNullSafe(F.col("_id"))
    single = keyed.join(kept.filter("_n = 1"), on, "left_semi")
    many = keyed.join(kept.filter("_n > 1"), on, "left_semi").dropDuplicates(["_doc", "_text"])
    return single.unionByName(many).select("_row.*")

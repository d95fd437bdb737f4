"""Long repeats: every byte covered by a string of ``length`` bytes that starts at another place too.

Anchors chosen by content (least hash in a window) cut each text into pieces whose strings share an anchor, so equal strings lie in pieces of equal anchors. Pieces
that occur twice as a whole are repeats at once, however many copies there are. What is left and could still match goes, string by string, into a family of
sorted arrays: each new batch is sorted by string, merge-scanned against the levels that exist, and levels of equal size are merged, so that there are
logarithmically many."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import as_bytes, bitmap, in_bitmap, shuffle_partitions, stage
from .words import groups_of, prefix_sums, run_hash, split_binary

LENGTH, GRAM, PIECE_BYTES = 400, 128, 1 << 20
ANCHOR_BITS, DOC_BITS = 26, 23            # sizes of the bit maps that thin exchanges, as powers of two
POSITION = np.uint64((1 << 24) - 1)


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of ``width`` values."""
    n = a.size - width + 1
    b = np.full(-(-a.size // width) * width, np.iinfo(np.uint64).max, np.uint64)
    b[:a.size] = a
    b = b.reshape(-1, width)
    left, right = np.minimum.accumulate(b, axis=1).ravel(), np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1:width - 1 + n])


def pieces_of(sums: np.ndarray, lo: int, hi: int, length: int, gram: int):
    """Pieces of the text at bytes lo .. hi: (start within the text, count, anchor's place, its hash). The strings that start at start .. start + count - 1 share the anchor, the
    leftmost run of ``gram`` bytes of least hash inside them; which it is depends on the string alone."""
    n, width = hi - lo - length + 1, length - gram + 1
    at = np.arange(lo, hi - gram + 1)
    h = run_hash(sums, at, at + gram)
    anchor = np.empty(n, np.int64)
    step = 1 << 22                                          # so many positions fit the key beside the hash
    for i in range(0, n, step):
        part = h[i:i + step + width - 1]
        least = sliding_min((part & ~POSITION) | np.arange(part.size, dtype=np.uint64), width)
        anchor[i:i + least.size] = (least & POSITION).astype(np.int64) + i
    start = np.flatnonzero(np.diff(anchor, prepend=-1))
    return start, np.diff(np.append(start, n)), anchor[start], h[anchor[start]]


def _keys(docs: DataFrame) -> DataFrame:
    """doc, h: two 64-bit keys of a row (id and text; text), and its text as bytes. Rows that repeat both id and text share them, and share their result."""
    text = as_bytes(F.col("text"))
    return docs.select("doc_id", F.xxhash64(F.col("doc_id"), text).alias("doc"), F.xxhash64(text).alias("h"), text.alias("text"))


def document_pieces(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc, h, start, count, at, anchor, print): the pieces of every document row; ``at`` is the anchor's place, print the hash of a piece's bytes."""
    kinds = [(c, pa.int64()) for c in ("doc", "h", "start", "count", "at", "anchor", "print")]

    def run(batches):
        for b in batches:
            doc, h = b.column(0).to_numpy(), b.column(1).to_numpy()
            raw, off = split_binary(b.column(2))
            for i, j in groups_of(off, PIECE_BYTES):
                sums = prefix_sums(raw[off[i]:off[j]])
                out = []
                for r in range(i, j):
                    lo, hi = int(off[r] - off[i]), int(off[r + 1] - off[i])
                    if hi - lo >= length:
                        start, count, at, anchor = pieces_of(sums, lo, hi, length, gram)
                        out.append((np.full(start.size, doc[r]), np.full(start.size, h[r]), start, count, at, anchor.view(np.int64),
                                    run_hash(sums, start + lo, start + lo + count + length - 1).view(np.int64)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, (_, t) in zip(zip(*out), kinds)], names=[n for n, _ in kinds])
    return _keys(docs).select("doc", "h", "text").mapInArrow(run, "doc long, h long, start long, count long, at long, anchor long, print long")


def flagged(rows: DataFrame, column: str, flags: np.ndarray) -> DataFrame:
    """Rows whose 64-bit hash in ``column`` is set in the bit map, and a few more."""
    i = rows.columns.index(column)

    def run(batches):
        for b in batches:
            if len(b):
                yield b.filter(pa.array(in_bitmap(flags, b.column(i).to_numpy().view(np.uint64))))
    return rows.mapInArrow(run, rows.schema)


def judged_pieces(pieces: DataFrame) -> DataFrame:
    """(doc, h, start, count, at, state) of the pieces (with a flag ``open``) that matter. 'twice': the whole piece occurs again, so all its strings are repeats. 'open': it
    occurs once, but its anchor stands elsewhere too. 'told': one occurrence of each repeated piece at such an anchor, which open strings may match."""
    classes = pieces.groupBy("anchor", "print").agg(F.count("*").alias("n"), F.min("doc").alias("speaker"), F.max("open").alias("open"))
    single = ((F.col("n") == 1) & F.col("open")).cast("int")
    anchors = classes.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum(single).alias("single"))
    shared = anchors.filter("kinds > 1 and single > 0").select(F.col("anchor").alias("_a"), F.lit(True).alias("shared"))
    of_class = classes.join(shared, F.col("anchor") == F.col("_a"), "left").filter("n > 1 or shared")
    of_class = of_class.select(F.col("anchor").alias("_a"), F.col("print").alias("_p"), "n", "speaker", F.coalesce("shared", F.lit(False)).alias("shared"))
    seen = pieces.join(of_class, (F.col("anchor") == F.col("_a")) & (F.col("print") == F.col("_p")))
    told = F.col("shared") & (F.col("doc") == F.col("speaker"))
    state = F.when((F.col("n") == 1) & F.col("open"), "open").when(told, "told").otherwise("twice")
    return seen.select("doc", "h", "start", "count", "at", state.alias("state"))


def with_pieces(texts: DataFrame, judged: DataFrame) -> DataFrame:
    """(doc, h, text, starts, counts, ats, opens) of the texts that have open or told pieces. A bit map of fixed size keeps most others out of the exchange."""
    listed = judged.filter("state <> 'twice'").groupBy(F.col("doc").alias("_d"), F.col("h").alias("_h")).agg(F.collect_list(F.struct("start", "count", "at", (F.col("state") == "open").alias("open"))).alias("p"))
    few = flagged(texts.select("doc", "h", "text"), "doc", bitmap(judged.filter("state <> 'twice'").select("doc"), "doc", DOC_BITS))
    met = few.join(listed, (F.col("doc") == F.col("_d")) & (F.col("h") == F.col("_h")))
    return met.select("doc", "h", "text", F.col("p.start").alias("starts"), F.col("p.count").alias("counts"), F.col("p.at").alias("ats"), F.col("p.open").alias("opens"))


def _each_text(run):
    """An Arrow function over ``with_pieces`` rows: ``run`` gets doc, h, prefix sums and the four arrays of one text, and returns columns."""
    def over(batches, names):
        for b in batches:
            raw, off = split_binary(b.column(2))
            for r in range(len(b)):
                lists = [b.column(c)[r].values.to_numpy(zero_copy_only=False) for c in (3, 4, 5, 6)]
                cols = run(prefix_sums(raw[off[r]:off[r + 1]]), *lists)
                n = len(cols[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, b.column(0)[r].as_py())), pa.array(np.full(n, b.column(1)[r].as_py())), *[pa.array(c) for c in cols]], names=names)
    return over


def finer_pieces(met: DataFrame, length: int, parts: int = 8, gram: int = GRAM) -> DataFrame:
    """The open and told pieces cut by the anchor's place inside the string into ``parts`` ranges. All strings of a range share all but few of their bytes, and the hash of these is the
    new anchor: it leaves open only what agrees in nearly the whole length."""
    width = -(-(length - gram + 1) // parts)

    def cut(sums, starts, counts, ats, opens):
        j = np.arange(parts)
        first = np.maximum(starts[:, None], ats[:, None] - (j * width + width - 1))
        last = np.minimum(starts[:, None] + counts[:, None] - 1, ats[:, None] - j * width)
        row, k = np.nonzero(first <= last)
        a, z = first[row, k], last[row, k]
        lo, hi = ats[row] - k * width, ats[row] + length - (k * width + width - 1)        # bytes that lie in every string of the range
        common = run_hash(sums, lo, hi) ^ (k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return a, z - a + 1, ats[row], common.view(np.int64), run_hash(sums, a, z + length).view(np.int64), opens[row]
    over = _each_text(cut)
    names = ["doc", "h", "start", "count", "at", "anchor", "print", "open"]
    return met.mapInArrow(lambda batches: over(batches, names), "doc long, h long, start long, count long, at long, anchor long, print long, open boolean")


def open_strings(met: DataFrame, length: int) -> DataFrame:
    """(key, check, doc, h, at, open) for every string of the pieces: key is its 64-bit hash, check another 32 bits."""
    def spell(sums, starts, counts, ats, opens):
        at = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        half = run_hash(sums, at, at + length // 2)
        return run_hash(sums, at, at + length).view(np.int64), (half >> np.uint64(32)).astype(np.uint32).view(np.int32), at.astype(np.int32), np.repeat(opens, counts)
    over = _each_text(spell)
    spelled = met.mapInArrow(lambda batches: over(batches, ["doc", "h", "key", "check", "at", "open"]), "doc long, h long, key long, check int, at int, open boolean")
    return spelled.select("key", "check", "doc", "h", "at", "open")


class Levels:
    """Sorted arrays of strings in geometric sizes. ``add`` takes a batch, returns the rows of it and of earlier batches that are now known to repeat, and keeps one entry per
    string. A level holds columns (key, check, doc, h, at, pending); pending entries have not met their like yet."""

    def __init__(self):
        self.levels: list[list[np.ndarray]] = []

    def add(self, key, check, doc, h, at, open_):
        order = np.lexsort((check, key))                                # the batch's own sorted array
        cols = [c[order] for c in (key, check, doc, h, at, open_)]
        key, check = cols[0], cols[1]
        new = np.ones(key.size, bool)
        new[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, key.size))
        repeated = np.repeat(size > 1, size)
        known = np.zeros(first.size, bool)
        out = []
        for level in self.levels:                                       # merge-scan: both sides are sorted
            where = np.searchsorted(level[0], key[first])
            where[where == level[0].size] = 0
            hit = (level[0][where] == key[first]) & (level[1][where] == check[first]) if level[0].size else np.zeros(first.size, bool)
            known |= hit
            old = where[hit]
            told = old[level[5][old]]
            out.append([c[told] for c in level[2:5]])
            level[5][told] = False
        repeated |= np.repeat(known, size)
        mine = repeated & cols[5]
        out.append([c[mine] for c in cols[2:5]])
        fresh = first[~known]
        entry = [c[fresh] for c in cols]
        entry[5] = entry[5] & ~repeated[fresh]
        if fresh.size:
            self.levels.append(entry)
        while len(self.levels) > 1 and self.levels[-2][0].size <= 2 * self.levels[-1][0].size:
            a, b = self.levels.pop(), self.levels.pop()
            both = [np.concatenate([y, x]) for x, y in zip(a, b)]
            order = np.argsort(both[0], kind="stable")                  # two sorted runs: merged in one pass
            self.levels.append([c[order] for c in both])
        return [np.concatenate(c) for c in zip(*out)]


def matched_strings(strings: DataFrame) -> DataFrame:
    """(doc, h, at) of the open strings that occur at two places or more. Strings are dealt by key; each range of keys has its own family of levels, which keeps one entry per
    string, so a string that occurs very often is one entry too."""
    def run(batches):
        family = Levels()
        for b in batches:
            if len(b):
                doc, h, at = family.add(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy(), b.column(4).to_numpy(), b.column(5).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(h), pa.array(at)], names=["doc", "h", "at"])
    return strings.repartition(shuffle_partitions(strings.sparkSession), "key").mapInArrow(run, "doc long, h long, at int")


def repeat_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc, h, whole array<struct<start, count>>, single array<int>): per document the runs of start positions of repeated strings, and further single positions."""
    if not 0 < gram < length:
        raise ValueError("gram must be shorter than length")
    pieces = stage(document_pieces(docs, length, gram), "pieces")
    again = pieces.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1")
    coarse = stage(judged_pieces(flagged(pieces, "anchor", bitmap(again, "anchor", ANCHOR_BITS)).withColumn("open", F.lit(True))), "coarse")
    met = stage(with_pieces(_keys(docs), coarse), "met")
    fine = stage(judged_pieces(finer_pieces(met, length, gram=gram)), "fine")
    single = matched_strings(open_strings(with_pieces(met, fine), length)).groupBy("doc", "h").agg(F.collect_list("at").alias("single"))
    known = coarse.unionByName(fine).filter("state <> 'open'")
    whole = known.groupBy(F.col("doc").alias("_d"), F.col("h").alias("_h")).agg(F.collect_list(F.struct("start", "count")).alias("whole"))
    both = whole.join(single, (F.col("doc") == F.col("_d")) & (F.col("h") == F.col("_h")), "full")
    return stage(both.select(F.coalesce("doc", "_d").alias("doc"), F.coalesce("h", "_h").alias("h"), "whole", "single"), "repeats")


def _flags(n: int, length: int, starts, counts, single) -> np.ndarray:
    """Removed bytes of a text."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + counts - 1 + length, -1)
    np.add.at(edge, single, 1)
    np.add.at(edge, single + length, -1)
    return np.cumsum(edge[:-1]) > 0


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<start, end>>, kept binary) for every row: the maximal runs of bytes covered by repeated strings, and the text without them.

    Strings are judged on the input, so every copy of a repeat goes; overlapping occurrences count. Texts shorter than ``length`` and null texts (empty) lose nothing; a repeated row is
    a copy like any other; matches never cross documents. Empty tables give no rows."""
    repeats = repeat_spans(docs, length, gram)
    found = repeats.select(F.col("doc").alias("_d"), F.col("h").alias("_h"), F.col("whole.start").alias("starts"), F.col("whole.count").alias("counts"), F.col("single").cast("array<bigint>").alias("single"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    none = F.array().cast("array<bigint>")
    flags = bitmap(repeats, "doc", DOC_BITS)
    marked = _keys(docs)
    i = marked.columns.index("doc")

    def mark(batches):
        for b in batches:
            if len(b):
                yield b.append_column("maybe", pa.array(in_bitmap(flags, b.column(i).to_numpy().view(np.uint64))))
    marked = marked.mapInArrow(mark, f"doc_id {kind}, doc long, h long, text binary, maybe boolean")
    # only texts that may have repeats go through the exchange
    touched = marked.filter("maybe").join(found, (F.col("doc") == F.col("_d")) & (F.col("h") == F.col("_h")), "left")
    clean = marked.filter("not maybe").select("doc_id", "text", *[F.lit(None).cast("array<bigint>").alias(c) for c in ("starts", "counts", "single")])
    met = touched.select("doc_id", "text", "starts", "counts", "single").unionByName(clean).select("doc_id", "text", *[F.coalesce(c, none).alias(c) for c in ("starts", "counts", "single")])
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in batches:
            raw, off = split_binary(b.column(1))
            for i, j in groups_of(off, PIECE_BYTES):
                spans, kept = [], []
                for r in range(i, j):
                    text = raw[off[r]:off[r + 1]]
                    gone = _flags(text.size, length, *(b.column(c)[r].values.to_numpy() for c in (2, 3, 4)))
                    edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                    spans.append([{"start": x, "end": y} for x, y in edges.reshape(-1, 2).tolist()])
                    kept.append(text[~gone].tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(off[i:j + 1])), pa.array(spans, span), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])
    return met.mapInArrow(run, f"doc_id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def repeats_digest(docs: DataFrame) -> DataFrame:
    return without_repeats(docs).select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

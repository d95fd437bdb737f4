"""Toxicity: a convolutional text classifier in numpy. Words are hashed to embeddings (the word and its beginnings of a few lengths, so that inflected forms share
what their stem teaches), filters of several widths run over them, each keeps its maximum over the whole text, and a linear layer scores the maxima. The decision
threshold is calibrated for each language, which is told from the text itself."""
from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import as_bytes, bitmap, id_remainder, in_bitmap, stage
from .words import NOT_ALNUM, Words, prefix_sums, run_hash, split_binary, groups_of, words_of

BUCKETS, DIM, FILTERS, WIDTHS, STEMS = 1 << 16, 8, 8, (1, 2, 3), (4, 5, 6)
EPOCHS, BATCH, WORDS = 3, 64, 1 << 17
EDGE, BINS = 64.0, 1 << 15          # bins of logits
LABEL_BITS = 26                     # size of the bit map of labelled ids, as a power of two
# fixed values: frequent function words by language
FUNCTION_WORDS = {"en": "the and of to in is that for with this was are", "de": "der die das und ist nicht ein eine den mit von zu", "fr": "le les des et est une dans pour que sur du au",
                  "es": "el los las del y en con por una no se que"}
LANGUAGES = [*sorted(FUNCTION_WORDS), "other"]


def _function_hashes() -> list[np.ndarray]:
    out = []
    for name in LANGUAGES[:-1]:
        raw = np.frombuffer(FUNCTION_WORDS[name].encode(), np.uint8)
        out.append(np.sort(words_of(raw, np.array([0, raw.size]), NOT_ALNUM).hash))
    return out


def language_of(w: Words) -> np.ndarray:
    """Index into LANGUAGES per row: the language with the most function words, the first on ties, 'other' without any."""
    rows = w.first.size - 1
    row = np.repeat(np.arange(rows), np.diff(w.first))
    counts = [np.bincount(row[np.isin(w.hash, known)], minlength=rows) for known in _function_hashes()]
    best = np.argmax(counts, axis=0)
    return np.where(np.max(counts, axis=0) > 0, best, len(LANGUAGES) - 1)


def word_buckets(w: Words) -> np.ndarray:
    """(words, 1 + stems) bucket numbers: of the word, and of its first bytes for each length in STEMS (the whole word, if shorter)."""
    sums = prefix_sums(w.data)
    cols = [w.hash] + [run_hash(sums, w.start, np.minimum(w.start + n, w.end)) + np.uint64(n * 0x9E3779B97F4A7C15 % (1 << 64)) for n in STEMS]
    return np.column_stack([(c >> np.uint64(48)) if i == 0 else ((c * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)) for i, c in enumerate(cols)]).astype(np.int64)


class Network(NamedTuple):
    table: np.ndarray           # (BUCKETS, DIM)
    kernels: list               # per width: (width, DIM, FILTERS)
    biases: list                # per width: (FILTERS,)
    out: np.ndarray             # (widths * FILTERS,)
    bias: float
    cuts: np.ndarray            # logit threshold per language
    slope: float


def embed(net: Network, buckets: np.ndarray) -> np.ndarray:
    e = net.table[buckets[:, 0]]
    for j in range(1, buckets.shape[1]):
        e = e + net.table[buckets[:, j]]
    return e


def pooled(net: Network, e: np.ndarray, first: np.ndarray, where: bool = False):
    """Maximum of each filter (after the rectifier) over each row's words; ``where``: also the word at which it stands (-1: nowhere above 0)."""
    rows = first.size - 1
    n, filled = first[-1], np.flatnonzero(np.diff(first) > 0)
    values, places = [], []
    for width, kernel, bias in zip(WIDTHS, net.kernels, net.biases):
        z = np.zeros((n, FILTERS), np.float32)
        for j in range(width):                                  # a filter may run over the end of a text, where there is nothing
            part = e[j:] @ kernel[j]
            z[:n - j] += _own(part, first, j)
        z += bias
        best = np.zeros((rows, FILTERS), np.float32)
        if filled.size:
            best[filled] = np.maximum(np.maximum.reduceat(z, first[filled], axis=0), 0)
        values.append(best)
        if where:
            at = np.full((rows, FILTERS), -1)
            row = np.repeat(np.arange(rows), np.diff(first))
            hit, f = np.nonzero((z == best[row]) & (z > 0))
            at[row[hit], f] = hit
            places.append(at)
    out = np.concatenate(values, axis=1)
    return (out, places) if where else out


def _own(part: np.ndarray, first: np.ndarray, j: int) -> np.ndarray:
    """Zero where word i + j belongs to the next text."""
    if j:
        for k in range(1, j + 1):
            cross = first[1:-1] - k
            part[cross[(cross >= 0) & (cross < len(part))]] = 0
    return part


def logits(net: Network, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
    return pooled(net, embed(net, buckets), first) @ net.out + net.bias


def blank() -> Network:
    return Network(np.zeros((BUCKETS, DIM), np.float32), [np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
                   np.zeros(len(WIDTHS) * FILTERS, np.float32), -1.0, np.zeros(len(LANGUAGES)), 1.0)


def start(seen: np.ndarray, n: np.ndarray, seed: int = 7) -> Network:
    """A network before its first step, from the documents of each class that hold a bucket (``seen``) and all of them (``n``). The first embedding dimension starts as the
    log odds of a bucket's presence in toxic documents, the rest small and random."""
    rng = np.random.default_rng(seed)
    n = np.maximum(n, 1)[:, None]
    odds = np.log((seen[1] + 0.2) / (n[1] + 0.4)) - np.log((seen[0] + 0.2) / (n[0] + 0.4))
    odds = np.where(seen.sum(axis=0) >= 2, np.clip(odds, -3, 6), 0.0)
    table = (rng.normal(0, 0.05, (BUCKETS, DIM))).astype(np.float32)
    table[:, 0] = odds / 4
    kernels = [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for k in kernels:
        k[0, 0, :FILTERS // 2] = np.linspace(0.5, 1.5, FILTERS // 2)
    return Network(table, kernels, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.full(len(WIDTHS) * FILTERS, 0.2, np.float32), -1.0, np.zeros(len(LANGUAGES)), 1.0)


def parameters(net: Network) -> np.ndarray:
    """All that training moves, as one vector."""
    return np.concatenate([net.table.ravel(), *[k.ravel() for k in net.kernels], *[b.ravel() for b in net.biases], net.out.ravel(), [net.bias]]).astype(np.float32)


def with_parameters(net: Network, flat: np.ndarray) -> Network:
    at, out = 0, []
    for p in [net.table, *net.kernels, *net.biases, net.out]:
        out.append(flat[at:at + p.size].reshape(p.shape).astype(np.float32))
        at += p.size
    return net._replace(table=out[0], kernels=out[1:1 + len(WIDTHS)], biases=out[1 + len(WIDTHS):1 + 2 * len(WIDTHS)], out=out[-1], bias=float(flat[at]))


def take_steps(net: Network, batches, share: float) -> Network:
    """Adam steps on the logistic loss over batches (word buckets per document, labels); the classes weigh alike, ``share`` being that of class 1 in all rows."""
    net = with_parameters(net, parameters(net))                 # its own copy
    params = [net.table, *net.kernels, *net.biases, net.out]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    bias = np.float32(net.bias)
    for docs, y in batches:
        weight = np.where(y == 1, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3))
        buckets = np.concatenate(docs)
        first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        net = net._replace(bias=bias)
        e = embed(net, buckets)
        best, places = pooled(net, e, first, where=True)
        z = best @ net.out + bias
        g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / len(y)).astype(np.float32)
        gout = best.T @ g
        gbest = g[:, None] * net.out[None, :]
        gk, gb = [np.zeros_like(k) for k in net.kernels], []
        rows_at, rows_g = [], []
        for wi, (width, kernel, place) in enumerate(zip(WIDTHS, net.kernels, places)):
            r, f = np.nonzero(place >= 0)
            p, gv = place[r, f], gbest[r, wi * FILTERS + f]
            gb.append(np.bincount(f, weights=gv, minlength=FILTERS).astype(np.float32))
            for j in range(width):
                ok = p + j < first[r + 1]
                np.add.at(gk[wi].transpose(0, 2, 1)[j], f[ok], gv[ok, None] * e[p[ok] + j])
                rows_at.append(p[ok] + j)
                rows_g.append(gv[ok, None] * kernel[j].T[f[ok]])
        gt_at = buckets[np.concatenate(rows_at)].ravel()
        gt = np.repeat(np.concatenate(rows_g), buckets.shape[1], axis=0)
        touched, inverse = np.unique(gt_at, return_inverse=True)
        gsum = np.zeros((touched.size, DIM), np.float32)
        np.add.at(gsum, inverse, gt)
        lr = 0.01
        for i, (p, grad) in enumerate(zip(params, [gsum, *gk, *gb, gout])):
            m, v = state[i]
            where = touched if i == 0 else slice(None)
            m[where] = 0.9 * m[where] + 0.1 * grad
            v[where] = 0.99 * v[where] + 0.01 * grad * grad
            p[where] -= lr * m[where] / (np.sqrt(v[where]) + 1e-6)
        bias -= np.float32(lr * g.sum() * 4)
    return net._replace(bias=float(bias))


def calibrate(net: Network, counted: np.ndarray) -> Network:
    """Per language the logit that parts the rows set aside with the fewest balanced errors; with fewer than 20 rows of a class, that of all languages. ``counted`` holds
    their numbers by language, class and bin of the logit."""
    def cut(c):
        n = np.maximum(c.sum(axis=1), 1)
        wrong = np.concatenate([[0], np.cumsum(c[1])]) / n[1] + (c[0].sum() - np.concatenate([[0], np.cumsum(c[0])])) / n[0]
        best = np.flatnonzero(wrong <= wrong.min() + 1e-9)
        return float(best[0] + best[-1]) / BINS * EDGE - EDGE
    every = counted.sum(axis=0)
    overall = cut(every) if every[0].any() and every[1].any() else 0.0
    return net._replace(cuts=np.array([cut(c) if (c.sum(axis=1) >= 20).all() else overall for c in counted]))


def score_words(net: Network, w: Words) -> np.ndarray:
    z = logits(net, word_buckets(w), w.first) - net.cuts[language_of(w)]
    return 1 / (1 + np.exp(-np.clip(z * net.slope, -35, 35)))


def _maybe_told(docs: DataFrame, told: DataFrame) -> DataFrame:
    """The rows whose id may be labelled, so that few others go through the exchange; a bit map of fixed size tells. Ids of two types are left to the join."""
    kind = docs.schema["doc_id"].dataType
    if kind != told.schema["_id"].dataType or kind.typeName() in ("float", "double"):
        return docs
    flags = docs.sparkSession.sparkContext.broadcast(bitmap(told.select(F.xxhash64("_id").alias("h")), "h", LABEL_BITS))

    def run(batches):
        for b in batches:
            if len(b):
                yield b.filter(pa.array(in_bitmap(flags.value, b.column(2).to_numpy().view(np.uint64))))
    rows = docs.withColumn("_h", F.xxhash64("doc_id"))
    return rows.mapInArrow(run, rows.schema).drop("_h")


def labelled_words(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, language, aside, words binary) of every labelled row: buckets of the whole text, 16 bits each. One row in four is kept aside to set the thresholds. An id that
    repeats teaches with one of its texts."""
    told = labels.filter(F.col("toxic").isin(0, 1)).select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("label")).distinct()
    rows = _maybe_told(docs.select("doc_id", "text"), told).join(told, F.col("doc_id") == F.col("_id")).groupBy("doc_id", "label").agg(F.min(as_bytes(F.col("text"))).alias("text"))
    rows = rows.select("label", F.xxhash64("doc_id").alias("h"), "text").sortWithinPartitions("h").select("label", (F.pmod("h", F.lit(4)) == 3).alias("aside"), "text")

    def run(batches):
        for b in batches:
            raw, off = split_binary(b.column(2))
            for i, j in groups_of(off):
                w = words_of(raw[off[i]:off[j]], off[i:j + 1] - off[i], NOT_ALNUM)
                buckets = word_buckets(w).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(language_of(w).astype(np.int32)),
                                                  pa.array([buckets[w.first[r]:w.first[r + 1]].tobytes() for r in range(j - i)], pa.binary())], names=["label", "aside", "language", "words"])
    return rows.mapInArrow(run, "label int, aside boolean, language int, words binary")


def _buckets(words) -> np.ndarray:
    return np.frombuffer(words.as_py(), np.uint16).reshape(-1, 1 + len(STEMS)).astype(np.int32)


def _groups(batches):
    """Documents and labels, at most BATCH documents and about WORDS words at a time."""
    docs, y, n = [], [], 0
    for b in batches:
        for label, words in zip(b.column("label").to_pylist(), b.column("words")):
            docs.append(_buckets(words))
            y.append(float(label))
            n += len(docs[-1])
            if len(docs) == BATCH or n >= WORDS:
                yield docs, np.array(y)
                docs, y, n = [], [], 0
    if docs:
        yield docs, np.array(y)


def _presence(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents of each class that hold a bucket, and all of each class; at most two numbers a bucket reach the driver."""
    def run(batches):
        seen = np.zeros((2, BUCKETS + 1), np.int64)
        for docs, y in _groups(batches):
            for d, t in zip(docs, y):
                seen[int(t), np.unique(d)] += 1
                seen[int(t), BUCKETS] += 1
        k, at = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(seen[k, at])], names=["k", "at", "n"])
    found = rows.select("label", "words").mapInArrow(run, "k int, at int, n long").groupBy("k", "at").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros((2, BUCKETS + 1))
    seen[found.column("k").to_numpy(), found.column("at").to_numpy()] = found.column("n").to_numpy()
    return seen[:, :BUCKETS], seen[:, BUCKETS]


def _epoch(rows: DataFrame, net: Network, share: float, total: int) -> Network:
    """Every task takes steps over its rows from the same network; the results are averaged by rows (``total`` in all), summed by Spark in pieces: one network reaches the
    driver. A task sends only the numbers that it moved."""
    sent = rows.sparkSession.sparkContext.broadcast(net)
    piece = 1 << 12

    def run(batches):
        n = 0

        def counted():
            nonlocal n
            for docs, y in _groups(batches):
                n += len(y)
                yield docs, y
        flat = parameters(take_steps(sent.value, counted(), share))
        moved = flat != parameters(sent.value)
        at = [i for i in range(0, flat.size, piece) if moved[i:i + piece].any()]
        if at:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(at) // piece, pa.int32()), pa.array(np.full(len(at), n)), pa.array([np.packbits(moved[i:i + piece]).tobytes() for i in at], pa.binary()),
                                              pa.array([flat[i:i + piece][moved[i:i + piece]] for i in at], pa.list_(pa.float32()))], names=["at", "n", "moved", "v"])

    def summed(key, parts):
        i = key[0].as_py() * piece
        old = parameters(sent.value)[i:i + piece].astype(float)
        new, rest = np.zeros(old.size), np.full(old.size, float(total))
        for n, bits, v in zip(parts.column("n").to_pylist(), parts.column("moved").to_pylist(), parts.column("v")):
            moved = np.unpackbits(np.frombuffer(bits, np.uint8), count=old.size).astype(bool)
            new[moved] += v.values.to_numpy().astype(float) * n
            rest[moved] -= n
        return pa.table({"at": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([(new + rest * old) / total], pa.list_(pa.float64()))})
    parts = rows.select("label", "words").mapInArrow(run, "at int, n long, moved binary, v array<float>").groupBy("at").applyInArrow(summed, "at int, v array<double>").toArrow()
    flat = parameters(net).astype(float)
    for at, v in zip(parts.column("at").to_pylist(), parts.column("v")):
        flat[at * piece:(at + 1) * piece] = v.values.to_numpy()
    return with_parameters(net, flat)


def _logits(rows: DataFrame, net: Network, languages: int) -> np.ndarray:
    """Rows by language, class and bin of the logit."""
    sent = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for b in batches:
            for some in range(0, b.num_rows, BATCH):
                part = b.slice(some, BATCH)
                docs = [_buckets(w) for w in part.column("words")]
                z = logits(sent.value, np.concatenate(docs), np.concatenate([[0], np.cumsum([len(d) for d in docs])]))
                at = np.clip(((z + EDGE) / (2 * EDGE) * BINS).astype(int), 0, BINS - 1)
                yield pa.RecordBatch.from_arrays([part.column("language"), part.column("label"), pa.array(at.astype(np.int32))], names=["language", "label", "at"])
    found = rows.select("language", "label", "words").mapInArrow(run, "language int, label int, at int").groupBy("language", "label", "at").agg(F.count("*").alias("n")).toArrow()
    counted = np.zeros((languages, 2, BINS))
    counted[tuple(found.column(c).to_numpy() for c in ("language", "label", "at"))] = found.column("n").to_numpy()
    return counted


class Labelled:
    """The table of ``labelled_words``; its length is the number of its rows."""

    def __init__(self, table: DataFrame, rows: int):
        self.table, self.rows = table, rows

    def __len__(self) -> int:
        return self.rows


def train(docs: Labelled, y: dict[int, int], language: list[str], epochs: int = EPOCHS) -> Network:
    """Counts, epochs and the thresholds of each language as passes of tasks over all rows; ``y`` holds the rows of each class."""
    mine = docs.table.filter("not aside")
    seen, n = _presence(mine)
    net = start(seen, n)
    for _ in range(epochs if n.sum() else 0):
        net = _epoch(mine, net, y[1] / (y[0] + y[1]), int(n.sum()))
    return calibrate(net, _logits(docs.table.filter("aside"), net, len(language)))


def fit(docs: DataFrame, labels: DataFrame) -> Network:
    """Learns from the whole texts of all labelled rows; what reaches the driver has a fixed size."""
    table = stage(labelled_words(docs, labels), "words")
    y = {r["label"]: r["n"] for r in table.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(y) < 2:
        return blank()._replace(bias=1.0 if y.get(1) else -1.0)
    return train(Labelled(table, sum(y.values())), y, LANGUAGES)


def toxicity_scores(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, decide: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; learns from rows of ``labels`` (doc_id, toxic 0 or 1) that are not held out.

    Whole texts are scored; null and empty texts get the score of no words at all. Null or other labels are left out; ids that repeat get one row per document
    row. Without labels of both classes all scores are alike."""
    held = F.coalesce(held_out if held_out is not None else id_remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    net = fit(docs.filter(~held), labels)
    sent = docs.sparkSession.sparkContext.broadcast(net)                # a fixed size: BUCKETS x DIM numbers
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            raw, off = split_binary(b.column(2))
            for i, j in groups_of(off):
                score = score_words(sent.value, words_of(raw[off[i]:off[j]], off[i:j + 1] - off[i], NOT_ALNUM))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(score.astype(float)), pa.array((score >= decide).astype(np.int32))],
                                                 names=["doc_id", "held_out", "score", "predicted"])
    return docs.select("doc_id", held.alias("held_out"), as_bytes(F.col("text")).alias("text")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")

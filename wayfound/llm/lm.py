"""Scoring texts with a gated recurrent language model in numpy.

Frequent words are symbols of their own; the rest fall into tail classes by their letters, and within a class a word has its smoothed share. The network predicts the next
symbol by a class and a member of the class (two small softmax layers instead of a large one). It is trained with truncated backpropagation over all training
documents: every task goes on from the last averaged parameters over its own documents. Scoring carries the state across windows, so a text is scored whole."""
from __future__ import annotations

import heapq
import zlib
from collections import Counter
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import as_bytes, id_remainder, stage

MEMBERS, CLASSES, HIDDEN = 32, 32, 16               # 32 classes of 32 frequent symbols, and one class whose members are the tail classes
SYMBOLS = (CLASSES + 1) * MEMBERS
TAIL = CLASSES * MEMBERS                            # first tail symbol
END = 0                                             # the end of a text
KNOWN = 1 << 18                                     # words whose counts every task holds; all others are joined
STREAMS, SCORED, WINDOW, LOOK, ROUNDS, RATE = 512, 512, 16, 32, 3, 0.015       # texts side by side in training and in scoring
FLUSH = 200_000                                     # distinct words a task counts before it hands them on


def tail_class(word: bytes) -> int:
    """0 to 31 by the word's letters: words with a byte beyond ASCII by the first such character, others by their first two bytes."""
    if word.isascii():
        return zlib.crc32(word[:2]) % (MEMBERS // 2)
    at = next(i for i, c in enumerate(word) if c > 127)
    return MEMBERS // 2 + zlib.crc32(word[at:at + 2]) % (MEMBERS // 2)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, n) over all rows: counted per task, then summed by word."""
    def batch(c):
        return pa.RecordBatch.from_arrays([pa.array(list(c.keys()), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])

    def run(batches):
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                seen.update(t.as_py().lower().split())
                if len(seen) > FLUSH:
                    yield batch(seen)
                    seen = Counter()
        if seen:
            yield batch(seen)
    return docs.select(as_bytes(F.col("text")).alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary(NamedTuple):
    known: dict                 # word -> its place in the next two, for the KNOWN most frequent
    symbol: np.ndarray
    count: np.ndarray
    counts: np.ndarray          # training tokens per symbol
    tail_log: np.ndarray        # log10 of each tail class's smoothed mass
    tokens: int                 # all training tokens, ends included
    words: int                  # distinct training tokens, the end included


def vocabulary(counts: DataFrame, documents: int, known: int = KNOWN) -> Vocabulary:
    """The most frequent words with their counts, at most ``known`` of them, and totals over all words. Counts are binned first (64 bins to a doubling), so that only the words of
    the bins that fit reach the driver, from however many tasks."""
    total = counts.agg(F.sum("n"), F.count("*")).first()
    level = F.floor(F.log2("n") * 64)
    fits, least_level = 0, None
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        fits += r["count"]
        if fits > known:
            break
        least_level = r["level"]
    top = [] if least_level is None else sorted(counts.filter(level >= least_level).collect(), key=lambda r: (-r["n"], r["word"]))
    heads = min(TAIL - 1, len(top))
    table = {bytes(r["word"]): i for i, r in enumerate(top)}
    symbol = np.array([i + 1 if i < heads else TAIL + tail_class(w) for w, i in table.items()], np.uint16)
    count, per = np.array([r["n"] for r in top], np.int64), np.zeros(SYMBOLS)
    per[END] = documents
    per[1:heads + 1] = count[:heads]
    least = (top[heads - 1]["n"], bytes(top[heads - 1]["word"])) if heads else (0, b"")

    def run(batches):
        n, distinct = np.zeros(MEMBERS), np.zeros(MEMBERS)
        for b in batches:
            for w, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k < least[0] or (k == least[0] and w > least[1]):
                    c = tail_class(w)
                    n[c] += k
                    distinct[c] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(MEMBERS)), pa.array(n), pa.array(distinct)], names=["at", "n", "d"])
    tail_n, tail_d = np.zeros(MEMBERS), np.zeros(MEMBERS)
    for r in counts.mapInArrow(run, "at long, n double, d double").groupBy("at").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).collect():
        tail_n[r["at"]], tail_d[r["at"]] = r["n"], r["d"]
    per[TAIL:] = tail_n
    return Vocabulary(table, symbol, count, per, np.log10(tail_n + 0.1 * (tail_d + 1)), int((total[0] or 0) + documents), int(total[1] + (documents > 0)))


def encoded(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(row, doc_id, held_out, n_tokens, symbols, n_known, known_log, tail_log, rest, rest_n): every text as symbols (two bytes each, the end last). known_log: sum of log10(count + 0.1)
    over the end and the words of the table; tail_log: the same less the mass of the class, over tail words of the table; rest: its other words with how often they occur."""
    sent = docs.sparkSession.sparkContext.broadcast(vocab)              # at most KNOWN words
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        v = sent.value
        find = v.known.get
        end_log = np.log10(v.counts[END] + 0.1)
        for b in batches:
            cols = [[] for _ in range(8)]
            for t in b.column(2):
                words = t.as_py().lower().split()
                at = np.fromiter(map(find, words, repeat(-1)), np.int64, len(words))
                symbols = np.empty(len(words) + 1, np.uint16)
                symbols[:-1] = v.symbol[at] if v.count.size else 0
                symbols[-1] = END
                count = v.count[at] if v.count.size else np.zeros(len(words), np.int64)
                unknown = np.flatnonzero(at < 0)
                others = [words[i] for i in unknown.tolist()]
                rest = Counter(others)
                symbols[unknown] = TAIL + np.fromiter(map(tail_class, others), np.int64, len(others))
                count[unknown] = 0
                seen = count > 0
                logs = np.log10(count[seen] + 0.1)
                tail = symbols[:-1][seen] >= TAIL
                mass = v.tail_log[symbols[:-1][symbols[:-1] >= TAIL].astype(int) - TAIL].sum()
                row = (symbols.size, symbols.tobytes(), int(seen.sum()) + int(v.counts[END] > 0), logs.sum() + end_log, logs[tail].sum() - mass, list(rest.keys()), list(rest.values()))
                for c, x in zip(cols, row):
                    c.append(x)
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, t) for c, t in zip(cols, kinds)]],
                                             names=["doc_id", "held_out", "n_tokens", "symbols", "n_known", "known_log", "tail_log", "rest", "rest_n"])
    slim = docs.select("doc_id", "held_out", as_bytes(F.col("text")).alias("text"))
    return slim.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, symbols binary, n_known long, known_log double, tail_log double, rest array<binary>, rest_n array<long>") \
               .withColumn("row", F.monotonically_increasing_id())


# --- the network
def initial(counts: np.ndarray, seed: int = 11) -> list[np.ndarray]:
    """Parameters that start as the unigram model: gates per symbol, gates per state, class layer, member layers."""
    rng = np.random.default_rng(seed)
    by_class = (counts + 0.1).reshape(CLASSES + 1, MEMBERS)
    gates = rng.normal(0, 0.1, (SYMBOLS, 3 * HIDDEN))
    gates[:, :HIDDEN] += 1.0                                            # the update gate starts by keeping the state
    return [x.astype(np.float32) for x in (gates, rng.normal(0, 0.2, (HIDDEN, 3 * HIDDEN)), rng.normal(0, 0.05, (HIDDEN, CLASSES + 1)), np.log(by_class.sum(axis=1) / by_class.sum()),
                                            rng.normal(0, 0.05, (CLASSES + 1, HIDDEN, MEMBERS)), np.log(by_class / by_class.sum(axis=1, keepdims=True)))]


def _sigmoid(x):
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def step(p, h, symbols, keep=None):
    """One gated step for all streams; ``keep`` collects what backpropagation needs."""
    g, u = np.take(p[0], symbols, axis=0), h @ p[1]
    zr = _sigmoid(g[:, :2 * HIDDEN] + u[:, :2 * HIDDEN])
    z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
    n = r * u[:, 2 * HIDDEN:]
    n += g[:, 2 * HIDDEN:]
    np.tanh(n, out=n)
    if keep is not None:
        keep.append((h, z, r, n, u[:, 2 * HIDDEN:]))
    new = h - n
    new *= z
    new += n
    return new


def _exponentials(x):
    """Exponentials of the rows, less one maximum for all (logits are small here: states lie in -1 to 1), and their sums; ``x`` is shifted in place."""
    x -= x.max()
    e = np.exp(x)
    return e, e @ np.ones(x.shape[1], x.dtype) + x.dtype.type(1e-37)


def log_likelihood(p, states, symbols, grads=None):
    """Natural log probability of each symbol after its state; with ``grads`` (a list of zeros like p) also adds the gradients of the negative mean and returns that of the states.

    Rows are put in order of their class once, so that every class layer is one product over neighbouring rows."""
    cls = symbols // MEMBERS
    order = np.argsort(cls.astype(np.uint8), kind="stable")
    cls, member, s = cls[order], symbols[order] % MEMBERS, np.take(states, order, axis=0)
    edges = np.searchsorted(cls, np.arange(CLASSES + 2))
    runs = [(c, slice(edges[c], edges[c + 1])) for c in range(CLASSES + 1) if edges[c + 1] > edges[c]]
    lc = s @ p[2]
    lc += p[3]
    lm = np.empty((cls.size, MEMBERS), lc.dtype)
    for c, at in runs:
        np.matmul(s[at], p[4][c], out=lm[at])
        lm[at] += p[5][c]
    rows = np.arange(cls.size)
    ec, sc = _exponentials(lc)
    em, sm = _exponentials(lm)
    out = np.empty(cls.size, lc.dtype)
    out[order] = lc[rows, cls] + lm[rows, member] - np.log(sc) - np.log(sm)
    if grads is None:
        return out, None
    scale = lc.dtype.type(1 / cls.size)
    ec *= (scale / sc)[:, None]
    ec[rows, cls] -= scale
    em *= (scale / sm)[:, None]
    em[rows, member] -= scale
    grads[2] += s.T @ ec
    ones = np.ones(cls.size, lc.dtype)
    grads[3] += ones @ ec
    mine = ec @ p[2].T
    for c, at in runs:
        grads[4][c] += s[at].T @ em[at]
        grads[5][c] += ones[at] @ em[at]
        mine[at] += em[at] @ p[4][c].T
    place = np.empty_like(order)
    place[order] = rows
    return out, np.take(mine, place, axis=0)


def _streams(symbols: np.ndarray, starts: np.ndarray, streams: int):
    """Symbols laid out as (steps, streams), and where texts begin; the rest of the last stream is marked by ``valid``."""
    steps = -(-symbols.size // streams)
    lay = np.zeros(steps * streams, np.int64)
    fresh, valid = np.zeros(steps * streams, bool), np.zeros(steps * streams, bool)
    lay[:symbols.size], valid[:symbols.size] = symbols, True
    fresh[starts] = True
    turn = lambda a: np.ascontiguousarray(a.reshape(streams, steps).T)
    return turn(lay), turn(fresh), turn(valid)


class Trainer:
    """Adam over truncated backpropagation: states are carried on from window to window, gradients are not."""

    def __init__(self, p, rate=RATE):
        self.p, self.rate, self.t, self.tokens = [x.copy() for x in p], rate, 0, 0
        self.m, self.v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]

    def learn(self, symbols, starts):
        streams = int(min(STREAMS, max(1, symbols.size // (2 * WINDOW))))
        lay, fresh, valid = _streams(symbols, starts, streams)
        h = np.zeros((streams, HIDDEN), np.float32)
        for at in range(0, len(lay), WINDOW):
            h = self.window(lay[at:at + WINDOW], fresh[at:at + WINDOW], valid[at:at + WINDOW], h)
        self.tokens += symbols.size

    def window(self, lay, fresh, valid, h):
        p, keep, states = self.p, [], []
        for s, f in zip(lay, fresh):
            if f.any():
                h = np.where(f[:, None], np.float32(0), h)
            states.append(h)
            h = step(p, h, s, keep)
        grads = [np.zeros_like(x) for x in p]
        use = valid.ravel()
        flat = np.concatenate(states)
        _, back = log_likelihood(p, flat if use.all() else flat[use], lay.ravel()[use], grads)
        if not use.all():
            full = np.zeros_like(flat)
            full[use] = back
            back = full
        full = back.reshape(len(lay), -1, HIDDEN)
        dh, gates = np.zeros_like(h), np.empty((len(lay), len(h), 3 * HIDDEN), h.dtype)
        du = np.empty((len(h), 3 * HIDDEN), h.dtype)
        for i in range(len(lay) - 1, -1, -1):
            before, z, r, n, un = keep[i]
            g = gates[i]
            dn, rest = g[:, 2 * HIDDEN:], 1 - z
            np.multiply(dh, rest, out=dn)
            dn *= 1 - n * n
            rest *= z
            rest *= dh
            np.multiply(rest, before - n, out=g[:, :HIDDEN])
            np.multiply(dn * un, r * (1 - r), out=g[:, HIDDEN:2 * HIDDEN])
            du[:, :2 * HIDDEN] = g[:, :2 * HIDDEN]
            np.multiply(dn, r, out=du[:, 2 * HIDDEN:])
            grads[1] += before.T @ du
            dh *= z
            dh += du @ p[1].T
            dh += full[i]
            if fresh[i].any():
                dh[fresh[i]] = 0
        flat_s, flat_g = lay.ravel(), gates.reshape(-1, 3 * HIDDEN)
        order = np.argsort(flat_s.astype(np.uint16), kind="stable")
        s = flat_s[order]
        first = np.flatnonzero(np.diff(s, prepend=-1))
        grads[0][s[first]] = np.add.reduceat(flat_g[order], first, axis=0)
        self.apply(grads)
        return h

    def apply(self, grads):
        self.t += 1
        size = np.sqrt(sum(float((g * g).sum()) for g in grads))
        clip = np.float32(min(1.0, 1.0 / max(size, 1e-9)))
        rate = self.rate * np.sqrt(1 - 0.99 ** self.t) / (1 - 0.9 ** self.t)
        for x, m, v, g in zip(self.p, self.m, self.v, grads):
            g = g * clip
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= np.float32(rate) * m / (np.sqrt(v) + np.float32(1e-7))


def _flat(p) -> np.ndarray:
    return np.concatenate([x.ravel() for x in p])


def _unflat(x: np.ndarray, like) -> list[np.ndarray]:
    cuts = np.cumsum([y.size for y in like])[:-1]
    return [a.reshape(y.shape).astype(np.float32) for a, y in zip(np.split(x, cuts), like)]


def train(texts: DataFrame, p: list[np.ndarray], rounds: int = ROUNDS, fan: int = 16) -> list[np.ndarray]:
    """One pass over all training texts in ``rounds`` growing parts. In each, every task trains on its own texts from the same start; the results are averaged by their tokens, first in at
    most ``fan`` tasks, then on the driver, so what reaches it does not grow with the data."""
    spark = texts.sparkSession
    part = F.pmod(F.xxhash64("doc_id", "symbols"), F.lit((1 << rounds) - 1))
    for r in range(rounds):
        sent = spark.sparkContext.broadcast(p)
        rate = RATE / (1 + r)

        def run(batches):
            trainer = Trainer(sent.value, rate)
            for b in batches:
                texts_ = [np.frombuffer(x, np.uint16) for x in b.column(0).to_pylist()]
                if texts_:
                    sizes = np.array([t.size for t in texts_])
                    trainer.learn(np.concatenate(texts_).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            if trainer.tokens:
                yield pa.RecordBatch.from_arrays([pa.array([trainer.tokens]), pa.array([_flat(trainer.p).tobytes()], pa.binary())], names=["n", "p"])

        def merge(batches):
            total, n = 0.0, 0
            for b in batches:
                for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    total, n = total + k * np.frombuffer(x, np.float32).astype(float), n + k
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], names=["n", "p"])
        mine = texts.filter(~F.col("held_out")).filter((part >= (1 << r) - 1) & (part < (2 << r) - 1)).select("symbols")
        done = mine.mapInArrow(run, "n long, p binary").repartition(fan).mapInArrow(merge, "n long, p binary").collect()
        if done:
            n = sum(x["n"] for x in done)
            p = _unflat(sum(x["n"] / n * np.frombuffer(x["p"], np.float32).astype(float) for x in done), p)
        sent.unpersist()
    return p


def text_scores(p, texts: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each text's symbols. Texts are laid end to end in streams of near equal length; a state starts anew with each text and is carried across windows within it."""
    sizes = np.array([t.size for t in texts])
    streams = int(min(SCORED, len(texts)))
    order, lists = np.argsort(-sizes, kind="stable"), [[] for _ in range(streams)]
    heap = [(0, s) for s in range(streams)]
    for i in order.tolist():
        n, s = heapq.heappop(heap)
        lists[s].append(i)
        heapq.heappush(heap, (n + int(sizes[i]), s))
    load = np.array([sizes[x].sum() for x in lists])
    rank = np.argsort(-load, kind="stable")                             # streams by length, so that those still running are the first ones
    lists, load = [lists[s] for s in rank], load[rank]
    laid = [i for mine in lists for i in mine]                          # all texts, stream by stream; windows are cut from here, so memory follows the symbols
    flat = np.concatenate([texts[i] for i in laid])
    owner = np.repeat(np.array(laid, np.int32), sizes[laid])
    fresh = np.zeros(flat.size, bool)
    fresh[np.cumsum(sizes[laid]) - sizes[laid]] = True
    first = np.cumsum(load) - load
    out, h = np.zeros(len(texts)), np.zeros((streams, HIDDEN), np.float32)
    for at in range(0, int(load[0]), LOOK):
        states, places = [], []
        for t in range(at, min(at + LOOK, int(load[0]))):
            on = int(np.searchsorted(-load, -t, "left"))                # streams with more than t symbols
            place = first[:on] + t
            h = h[:on]
            f = fresh[place]
            if f.any():
                h = np.where(f[:, None], np.float32(0), h)
            states.append(h)
            places.append(place)
            h = step(p, h, flat[place])
        places = np.concatenate(places)
        logs, _ = log_likelihood(p, np.concatenate(states), flat[places].astype(np.int64))
        out += np.bincount(owner[places], weights=logs, minlength=len(texts))
    return out / np.log(10)


def language_model_scores(docs: DataFrame, held_out: Column | None = None, known: int = KNOWN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``; rows that are held out teach nothing.

    Words are runs of bytes other than white space, A-Z lower-cased; each text ends with one end token. Counts cover all training texts; the ``known`` most frequent words go to every
    task, all others are joined by word. Null texts are empty (the end alone); repeated rows are scored each; without training rows every token counts as unseen."""
    held = F.coalesce(held_out if held_out is not None else id_remainder(F.col("doc_id"), 10) == 0, F.lit(False))
    marked = docs.select("doc_id", "text", held.alias("held_out"))
    learned = marked.filter(~F.col("held_out"))
    counts = stage(word_counts(learned), "counts")
    vocab = vocabulary(counts, learned.count(), known)
    texts = stage(encoded(marked, vocab), "texts")
    p = train(texts, initial(vocab.counts))
    sent = docs.sparkSession.sparkContext.broadcast(p)

    def run(batches):
        for b in batches:
            texts_ = [np.frombuffer(x, np.uint16) for x in b.column(1).to_pylist()]
            if texts_:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text_scores(sent.value, texts_))], names=["row", "symbol_score"])
    scored = texts.select("row", "symbols").mapInArrow(run, "row long, symbol_score double")
    rest = texts.select("row", F.explode(F.arrays_zip("rest", "rest_n")).alias("r")).select("row", F.col("r.rest").alias("word"), F.col("r.rest_n").alias("k"))
    met = rest.join(counts, "word", "left")
    more = met.groupBy("row").agg(F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("rest_log"), F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("rest_known"))
    all_log = float(np.log10(vocab.tokens + 0.1 * (vocab.words + 1)))
    out = texts.select("row", "doc_id", "held_out", "n_tokens", "n_known", "known_log", "tail_log").join(scored, "row").join(more, "row", "left")
    rest_log = F.coalesce("rest_log", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rest_known", F.lit(0))).cast("long").alias("n_known"), F.lit(vocab.tokens).cast("long").alias("train_tokens"),
                      (F.col("known_log") + rest_log - F.col("n_tokens") * F.lit(all_log)).alias("base_score"), (F.col("symbol_score") + F.col("tail_log") + rest_log).alias("score"))

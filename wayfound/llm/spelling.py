"""Grouping spelling variants: words at one inserted, deleted or replaced letter, found with FM-indexes in both directions.

A word and its near word agree in one half of the word. The search therefore matches one half exactly, starting at the word's border, and extends across the other half
with one error; the first half is extended to the right, the second to the left. Every step narrows an interval of suffix ranks of the delimited vocabulary, and a
match ends at the next border.

Both directions are kept as families of shards. The first half of a word is an interval of the sorted vocabulary, its second half one of the vocabulary sorted
by reversed words; a family is cut into ranges of bounded size, and a word asks only the shards that its interval touches. As a search never leaves its direction, a shard
needs the index of one direction only: read backwards it extends a match to the right (first family) or to the left (second family)."""
from __future__ import annotations

import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import as_bytes, stage
from .terms import latin_letters, pair_counts, term_blocks

LEAST, OFTEN, FACTOR, EVERY = 6, 5, 5, 199      # code points of a word, its occurrences, how much commoner its form is, one run in so many is damaged
SHARD, ASKING, DRAWN = 8192, 65536, 32          # words of a shard, words that ask it at once, sampled words for each split point
FLUSH = 200_000                                 # distinct words a task counts before it hands them on
LAST = "\U0010FFFF"
STEP = 32                                       # ranks between two counts of the index


# --- words and their counts
def _runs(ids: pa.Array, values: pa.Array, every: int, least: int):
    """(word bytes, count) per block: distinct lower-cased runs of letters, each counted after the damage that a document does to it."""
    start = {}
    for t in term_blocks(values, latin_letters):
        words = t.words.to_pylist()
        points = np.array([len(w) - w.count(0xC3) for w in words], np.int64)
        on = points[t.code] >= least
        row, code, n = pair_counts(t.row[on], t.code[on], max(1, len(words)))
        sums = np.bincount(code, weights=n, minlength=len(words)).astype(np.int64)
        for r in np.unique(row).tolist():
            if r not in start:
                i = ids[r].as_py()
                start[r] = zlib.crc32((("" if i is None else str(i)) + ":").encode())
        if every:
            for r, c, k in zip(row.tolist(), code.tolist(), n.tolist()):
                h = zlib.crc32(words[c], start[r])
                if h % every == 0:
                    sums[c] -= k
                    text = words[c].decode()
                    at = h % len(text)
                    if len(text) > least:
                        yield (text[:at] + text[at + 1:]).encode(), k
        for c in np.flatnonzero(sums).tolist():
            yield words[c], int(sums[c])


def word_counts(docs: DataFrame, every: int = EVERY, least: int = LEAST, often: int = OFTEN) -> DataFrame:
    """(word, n) of the words with at least ``least`` code points and ``often`` occurrences in all documents. ``every``: one pair of document and run in so many
    loses a letter, chosen by checksum (0: none). Null texts have no words; a null id counts as the empty text; repeated rows count again."""
    slim = docs.select("doc_id", as_bytes(F.col("text")).alias("text"))

    def batch(c):
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()).cast(pa.string()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])

    def run(batches):
        seen: Counter = Counter()
        for b in batches:
            for word, n in _runs(b.column(0), b.column(1), every, least):
                seen[word] += n
                if len(seen) >= FLUSH:
                    yield batch(seen)
                    seen = Counter()
        if seen:
            yield batch(seen)
    return slim.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= often)


# --- the index
class Index:
    """FM-index of a delimited vocabulary, read so that a match grows to the right: ``step`` extends intervals of suffix ranks by one letter each.

    The indexed text holds the reversed words, each with a delimiter behind it that sorts below all letters and by the word's place. 0 is the delimiter."""

    def __init__(self, words: np.ndarray, length: np.ndarray, letters: int):
        w, most = words.shape
        size = length + 1
        border = np.cumsum(size)                            # behind each word's delimiter
        total = int(border[-1])
        text = np.zeros(total, np.int64)
        word = np.repeat(np.arange(w), size)
        at = np.arange(total) - np.repeat(border - size, size)
        letter = at < length[word]
        text[letter] = words[word[letter], (length[word] - 1 - at)[letter]]
        rank = np.where(letter, text + w, word)             # delimiters are all different, so suffixes are settled within a word
        reach = 1
        while True:
            ahead = np.zeros(total, np.int64)
            ahead[:-reach] = rank[reach:] + 1 if reach < total else 0
            order = np.lexsort((ahead, rank))
            new = np.zeros(total, np.int64)
            a, b = rank[order], ahead[order]
            new[order] = np.cumsum(np.concatenate([[0], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            rank = new
            if rank.max() == total - 1 or reach > most:
                break
            reach *= 2
        suffix = np.empty(total, np.int64)
        suffix[rank] = np.arange(total)
        before = np.where(suffix > 0, text[suffix - 1], 0)
        self.words, self.letters = w, letters
        blocks = total // STEP + 1
        padded = np.full(blocks * STEP, -1, np.int16)
        padded[:total] = before
        self.bwt = padded.reshape(blocks, STEP)
        counts = np.bincount((np.arange(total) // STEP) * letters + before, minlength=blocks * letters).reshape(blocks, letters)
        self.upto = np.zeros((blocks + 1, letters), np.int32)
        np.cumsum(counts, axis=0, out=self.upto[1:])
        self.first = np.concatenate([[0], np.cumsum(self.upto[-1])[:-1]]).astype(np.int64)
        self.ended = word[suffix[before == 0]]              # the words whose beginning follows each delimiter, by rank

    def occurrences(self, letter: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """How often each letter stands before the suffixes of lower rank."""
        block = rank // STEP
        inside = np.arange(STEP) < (rank % STEP)[:, None]
        here = self.bwt[np.minimum(block, len(self.bwt) - 1)] == letter[:, None]
        return self.upto[block, letter] + (here & inside).sum(axis=1)

    def step(self, letter: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.first[letter] + self.occurrences(letter, low), self.first[letter] + self.occurrences(letter, high)

    def choices(self, low: np.ndarray, high: np.ndarray):
        """(interval, letter, low, high) of all letters that extend each interval: by the letters themselves where there are few, else by trying all."""
        few = high - low <= self.letters
        size = np.where(few, high - low, 0)
        which = np.repeat(np.arange(low.size), size)
        rank = np.arange(which.size) - np.repeat(np.cumsum(size) - size, size) + low[which]
        seen = np.unique(which * self.letters + self.bwt[rank // STEP, rank % STEP])
        many = np.flatnonzero(~few)
        tried = (many[:, None] * self.letters + np.arange(1, self.letters)).ravel()
        both = np.concatenate([seen, tried])
        which, letter = both // self.letters, both % self.letters
        which, letter = which[letter > 0], letter[letter > 0]
        a, b = self.step(letter, low[which], high[which])
        on = b > a
        return which[on], letter[on], a[on], b[on]

    def whole(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval, word) where a word ends at the interval."""
        zero = np.zeros(low.size, np.int64)
        k, end = self.occurrences(zero, low), self.occurrences(zero, high)
        on = np.flatnonzero(end > k)
        return on, self.ended[k[on]]


class _State(NamedTuple):
    asking: np.ndarray
    at: np.ndarray              # letters of the asking word used so far
    low: np.ndarray
    high: np.ndarray

    def take(self, on) -> "_State":
        return _State(*(x[on] for x in self))


def _follow(index: Index, s: _State, words: np.ndarray, until: np.ndarray) -> _State:
    """States after the letters of their own words up to ``until`` without error; those that end are left out."""
    done = []
    while s.asking.size:
        there = s.at >= until[s.asking]
        done.append(s.take(there))
        s = s.take(~there)
        low, high = index.step(words[s.asking, s.at], s.low, s.high)
        s = _State(s.asking, s.at + 1, low, high).take(high > low)
    return _State(*(np.concatenate(x) for x in zip(*done))) if done else s


def one_error(index: Index, words: np.ndarray, length: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(asking, word): all words of the index that begin with the first ``exact`` letters of the asking one and differ in one letter behind them. Each pair once:
    of a run of equal letters only the last is deleted, and no letter is inserted before its like."""
    n = length.size
    clean = _follow(index, _State(np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, index.words)), words, exact)
    wrong = []
    while clean.asking.size:
        more = clean.at < length[clean.asking]
        own = np.where(more, words[clean.asking, np.minimum(clean.at, words.shape[1] - 1)], 0)
        follows = np.where(clean.at + 1 < length[clean.asking], words[clean.asking, np.minimum(clean.at + 1, words.shape[1] - 1)], 0)
        gone = more & (own != follows)
        wrong.append(_State(clean.asking, clean.at + 1, clean.low, clean.high).take(gone))
        which, letter, low, high = index.choices(clean.low, clean.high)
        step = _State(clean.asking[which], clean.at[which], low, high)
        other = letter != own[which]
        wrong.append(step.take(other))                                                                  # inserted
        wrong.append(_State(step.asking, step.at + 1, low, high).take(other & more[which]))             # replaced
        clean = _State(step.asking, step.at + 1, low, high).take(~other & more[which])
    if not wrong:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    end = _follow(index, _State(*(np.concatenate(x) for x in zip(*wrong))), words, length)
    on, found = index.whole(end.low, end.high)
    return end.asking[on], found


def _matrix(texts: list[str], letters: dict) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), max(1, int(length.max(initial=0)))), np.int64)
    flat = np.array([letters[c] for t in texts for c in t], np.int64)
    out[np.arange(out.shape[1]) < length[:, None]] = flat
    return out, length


def _search(key, held: pa.Table, asking: pa.Table) -> pa.Table:
    """Near words in one shard, one row per asking word that has some: (word, near words, the commonest's count, negative, and the commonest)."""
    right = key[0].as_py() == 0
    turn = (lambda t: t) if right else (lambda t: t[::-1])
    names, n = held["word"].to_pylist(), held["n"].to_numpy()
    asks = asking["word"].to_pylist()
    letters = {c: i + 1 for i, c in enumerate(sorted(set("".join(names)) | set("".join(asks))))}
    index = Index(*_matrix([turn(t) for t in names], letters), len(letters) + 1)
    words, length = _matrix([turn(t) for t in asks], letters)
    half = length // 2 if right else length - length // 2
    out = ([], [], [], [])
    for first in range(0, len(asks), SHARD):
        part = slice(first, first + SHARD)
        who, found = one_error(index, words[part], length[part], half[part])
        best: dict = {}
        for a, w in zip(who.tolist(), found.tolist()):
            mine, near = asks[first + a], names[w]
            if not right and near.startswith(mine[:len(mine) // 2]):
                continue                                                # the first half found it
            k, top = best.get(mine, (0, (1, "")))
            best[mine] = (k + 1, min(top, (-int(n[w]), near)) if k else (-int(n[w]), near))
        for mine, (k, (neg, near)) in best.items():
            for c, v in zip(out, (mine, k, neg, near)):
                c.append(v)
    return pa.table({"word": pa.array(out[0], pa.string()), "n_near": pa.array(out[1], pa.int64()), "neg": pa.array(out[2], pa.int64()), "near": pa.array(out[3], pa.string())})


# --- shards
def _points_below(key: Column, points: Column, most: int) -> Column:
    """Number of sorted points at or below the key, by binary search."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(max(1, most).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= F.size(points)) & F.coalesce(F.get(points, at + s - 1) <= key, F.lit(False)), at + s).otherwise(at))


def _family(words: DataFrame, side: int, key: Column, shards: int, asking_limit: int) -> tuple[DataFrame, DataFrame]:
    """(held, asking) with side, shard and part: the words of each shard, and the words whose half is an interval that touches it."""
    half = F.floor(F.length("word") / 2)
    exact = F.col("_key").substr(F.lit(1), half if side == 0 else F.length("word") - half)
    keyed = words.withColumn("_key", key)
    if shards > 1:
        drawn = keyed.select("_key").orderBy(F.xxhash64("_key")).limit(shards * DRAWN)
        points = drawn.agg(F.filter(F.array_sort(F.collect_list("_key")), lambda x, i: (i % DRAWN == 0) & (i > 0)).alias("p")).scalar()
        keyed = keyed.withColumn("_points", points)
        at = lambda k: _points_below(k, F.col("_points"), shards)
        keyed = keyed.select("word", "n", at(F.col("_key")).alias("shard"), at(exact).alias("from"), at(F.concat(exact, F.lit(LAST))).alias("to"))
    else:
        keyed = keyed.select("word", "n", F.lit(0).alias("shard"), F.lit(0).alias("from"), F.lit(0).alias("to"))
    keyed = stage(keyed.withColumn("side", F.lit(side)), "family")
    asking = keyed.select("side", F.explode(F.sequence("from", "to")).alias("shard"), "word")
    # a shard that very many words ask is held once for each part of them
    parts = asking.groupBy("shard").agg(F.ceil(F.count("*") / asking_limit).cast("int").alias("parts"))
    held = keyed.select("side", "shard", "word", "n").join(parts, "shard").select("side", "shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "word", "n")
    asking = asking.join(parts, "shard").select("side", "shard", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int").alias("part"), "word")
    return held, asking


def near_words(words: DataFrame, shard: int = SHARD, asking_limit: int = ASKING) -> DataFrame:
    """(word, n, n_near, near, near_n) for every row of ``words`` (word of at least two letters, distinct; n): the number of words at one inserted, deleted or
    replaced letter and the commonest of them (ties: the first in code point order), null where there is none."""
    words = stage(words, "words")
    shards = max(1, -(-words.count() // shard))
    sides = [_family(words, 0, F.col("word"), shards, asking_limit), _family(words, 1, F.reverse("word"), shards, asking_limit)]
    held, asking = (sides[0][i].unionByName(sides[1][i]) for i in (0, 1))
    keys = ["side", "shard", "part"]
    asking = asking.select(*[F.col(c).alias(c) for c in asking.columns])         # columns of its own: both sides come from one table
    found = held.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(_search, "word string, n_near long, neg long, near string")
    rows = found.select("word", F.lit(None).cast("long").alias("n"), "n_near", F.struct("neg", "near").alias("best")) \
                .unionByName(words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<neg:bigint,near:string>").alias("best")))
    out = rows.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return out.select("word", "n", "n_near", F.col("best.near").alias("near"), (-F.col("best.neg")).alias("near_n"))


def spelling_groups(docs: DataFrame, every: int = EVERY, least: int = LEAST, often: int = OFTEN, factor: int = FACTOR, shard: int = SHARD) -> DataFrame:
    """(word, form, root, n, n_near, form_n): a word's form is its commonest near word where that occurs ``factor`` times as often, and its root is reached by
    following forms to the last. Counts rise along forms, so chains end; each round doubles the distance followed.

    Null and empty texts have no words; an empty table, or one without words, gives no rows; long texts are cut between words; columns other than doc_id and text
    are ignored."""
    near = stage(near_words(word_counts(docs, every, least, often), shard), "near")
    has = F.col("near_n") >= factor * F.col("n")
    formed = near.select("word", "n", "n_near", F.when(has, F.col("near")).alias("form"), F.when(has, F.col("near_n")).alias("form_n"))
    roots = stage(formed.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = roots.select(F.col("word").alias("_word"), F.col("root").alias("_next"))
        new = stage(roots.join(on, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        if new.filter("moved").limit(1).count() == 0:
            break
        roots = new.select("word", "root")
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""Name similarity on candidate pairs (scores 0-100) and the yes/no name tests built on it.

The longest-common-subsequence length needs a loop over characters, which no built-in expression offers at speed, so it runs in one small
Arrow batch function; everything around it is native expressions, and all similarity calls of one select share a single Arrow pass.
"""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from . import vocab as V
from ._col import col, one_of, str_array, text, words
from .text import kind_conflict, name_stems, norm_name


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, with machine-word rows instead of a table."""
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & at.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _score(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * _common(a, b) / total


def _best_window(a: str, b: str) -> float:
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    n, best = len(short), 0.0
    for start in range(1 - n, len(long)):
        window = long[max(start, 0):start + n]
        if 200.0 * len(window) / (n + len(window)) > best:
            best = max(best, _score(short, window))
            if best == 100.0:
                break
    return best


def _pairs(fn, a: pd.Series, b: pd.Series) -> pd.Series:
    seen: dict = {}
    out = []
    for pair in zip(a, b):
        if pair[0] is None or pair[1] is None:
            out.append(None)
            continue
        if pair not in seen:
            seen[pair] = fn(*pair)
        out.append(seen[pair])
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairs(_score, a, b)


@F.pandas_udf(T.DoubleType())
def _partial(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairs(_best_window, a, b)


@F.pandas_udf(T.DoubleType())
def _best_word(a: pd.Series, b: pd.Series) -> pd.Series:
    """Best ratio of any word of the first list with any word of the second (space separated lists)."""
    return _pairs(lambda x, y: max((_score(p, q) for p in x.split() for q in y.split()), default=0.0), a, b)


def sim_ratio(a, b) -> Column:
    """Normalised indel similarity of two texts."""
    return _ratio(col(a), col(b))


def sim_partial(a, b) -> Column:
    """Best similarity of the shorter text with any window of the longer."""
    return _partial(col(a), col(b))


def _sorted_words(c) -> Column:
    return F.array_join(F.array_sort(words(c)), " ")


def sim_token_sort(a, b) -> Column:
    return _ratio(_sorted_words(a), _sorted_words(b))


def sim_token_set(a, b) -> Column:
    """100 when one name's words are all in the other; else the best of the three comparisons of shared and differing words."""
    wa, wb = F.array_distinct(words(a)), F.array_distinct(words(b))
    both = F.array_join(F.array_sort(F.array_intersect(wa, wb)), " ")
    only_a = F.array_join(F.array_sort(F.array_except(wa, wb)), " ")
    only_b = F.array_join(F.array_sort(F.array_except(wb, wa)), " ")
    with_a, with_b = F.trim(F.concat_ws(" ", both, only_a)), F.trim(F.concat_ws(" ", both, only_b))
    subset = (both != "") & ((only_a == "") | (only_b == ""))
    best = F.greatest(_ratio(with_a, with_b), F.when(both != "", _ratio(both, with_a)).otherwise(F.lit(0.0)),
                      F.when(both != "", _ratio(both, with_b)).otherwise(F.lit(0.0)))
    return F.when((F.size(wa) == 0) | (F.size(wb) == 0), F.lit(0.0)).when(subset, F.lit(100.0)).otherwise(best)


def _none(town_words) -> Column:
    return str_array(()) if town_words is None else town_words


def name_sim(a, b, town_words: Column | None = None, stems_a=None, stems_b=None) -> Column:
    """Composite similarity of two name keys. ``town_words`` is an array column of words that name places, not businesses; stems may be
    passed in where they are already columns."""
    a, b, town = col(a), col(b), _none(town_words)
    joined_a, joined_b = F.replace(a, F.lit(" "), F.lit("")), F.replace(b, F.lit(" "), F.lit(""))
    sa, sb = (name_stems(a) if stems_a is None else col(stems_a)), (name_stems(b) if stems_b is None else col(stems_b))
    shared = F.array_intersect(sa, sb)
    ratio = _ratio(a, b)
    ours, theirs = F.array_distinct(words(a)), F.array_distinct(words(b))
    n_both = F.size(F.array_intersect(ours, theirs))
    small, large = F.least(F.size(ours), F.size(theirs)), F.greatest(F.size(ours), F.size(theirs))
    tset = sim_token_set(a, b)
    tset = F.when((n_both < 0.5 * small + 0.5) | (n_both < 0.4 * large), F.least(tset, F.lit(72.0))).otherwise(tset)
    bare = lambda s: F.array_sort(F.filter(s, lambda w: ~one_of(w, V.FILLER)))
    town_only = (F.size(F.array_except(shared, town)) == 0) & (F.array_join(bare(sa), " ") != F.array_join(bare(sb), " ")) & (ratio < 95)
    return F.when((joined_a == joined_b) | (_ratio(joined_a, joined_b) >= 92), F.lit(96.0)) \
            .when((F.size(shared) == 0) & (ratio < 95), F.lit(60.0)).when(town_only, F.lit(60.0)) \
            .when(kind_conflict(a, b), F.lit(70.0)).otherwise(F.greatest(tset, ratio, sim_token_sort(a, b)))


def real_share(stems_a, stems_b, town_words: Column | None = None) -> Column:
    """Do two stem sets share a distinctive word? A town's name counts only when it is the whole name on both sides."""
    a, b = (F.filter(col(s), lambda w: ~one_of(w, V.FILLER)) for s in (stems_a, stems_b))
    both = F.array_intersect(a, b)
    whole = (F.size(both) == F.size(F.array_distinct(a))) & (F.size(both) == F.size(F.array_distinct(b)))
    return (F.size(both) > 0) & ((F.size(F.array_except(both, _none(town_words))) > 0) | whole)


def _long(stems) -> Column:
    return F.array_join(F.filter(stems, lambda w: F.length(w) >= 5), " ")


def close_words(stems_a, stems_b) -> Column:
    """A common word, or two words of five letters or more within a spelling slip."""
    a, b = col(stems_a), col(stems_b)
    return F.arrays_overlap(a, b) | (_best_word(_long(a), _long(b)) >= 85)


_NOTE = r"(?i)\s*\((?!\s*(?:formerly|fka|f/k/a|was)\b)[^)]*\)"


def same_business(a, b, town_words: Column | None = None, brand_a=None, brand_b=None) -> Column:
    """Are two names one business? An empty name key agrees with everything; names that say different things served never agree."""
    return same_key(norm_name(F.regexp_replace(text(a), _NOTE, " ")), norm_name(F.regexp_replace(text(b), _NOTE, " ")), town_words, brand_a, brand_b)


def same_key(ka, kb, town_words: Column | None = None, brand_a=None, brand_b=None) -> Column:
    """:func:`same_business` for name keys."""
    ka, kb = col(ka), col(kb)
    fa, fb = F.replace(ka, F.lit(" "), F.lit("")), F.replace(kb, F.lit(" "), F.lit(""))
    town = _none(town_words)
    wa, wb = F.array_except(name_stems(ka), town), F.array_except(name_stems(kb), town)
    same = fa.contains(fb) | fb.contains(fa) | (_ratio(fa, fb) >= 85) | (sim_token_set(ka, kb) >= 85) \
        | ((F.least(F.length(fa), F.length(fb)) >= 6) & (_partial(fa, fb) >= 88)) | close_words(wa, wb)
    if brand_a is not None and brand_b is not None:
        same = same | F.coalesce(col(brand_a) == col(brand_b), F.lit(False))
    return F.when((ka == "") | (kb == ""), F.lit(True)).when(kind_conflict(ka, kb) & (ka != kb), F.lit(False)).otherwise(same)


def town_word_rows(df, column, extra=V.TOWN_WORD_EXTRAS, generic=V.GENERIC):
    """DataFrame(word): words of four letters or more of all town names, plus the extras, with their stems."""
    base = df.select(F.explode(F.filter(words(norm_name(column)), lambda w: F.length(w) >= 4)).alias("word"))
    if extra:
        base = base.unionByName(df.sparkSession.createDataFrame([(w,) for w in extra], "word string"))
    stem = F.when((F.length("word") > 3) & F.col("word").endswith("S"), F.expr("substr(word, 1, length(word) - 1)")).otherwise(F.col("word"))
    both = base.select(F.explode(F.array(F.col("word"), stem)).alias("word")).distinct()
    return both.filter(~F.col("word").isin(*generic)) if generic else both

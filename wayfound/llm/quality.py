"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""
from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import as_bytes, id_remainder, stage
from .words import SPACE, groups_of, split_binary, words_of

# byte classes: 0 other, 1 a-z, 2 A-Z, 3 digit, 4 plain punctuation, 5 odd symbol, 6 white space but newline, 7 newline, 8 beyond ASCII
CLASS = np.zeros(256, np.int64)
CLASS[97:123], CLASS[65:91], CLASS[48:58] = 1, 2, 3
CLASS[list(b".,;:?'\"()-")] = 4
CLASS[list(b"!#$%&*+/<=>@[\\]^_`{|}~")] = 5
CLASS[SPACE] = 6
CLASS[10] = 7
CLASS[128:] = 8
CLASSES, FEATURES = 9, 15


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One line of ``FEATURES`` transformed statistics per text. An empty text has only zeros."""
    rows = offsets.size - 1
    w = words_of(raw, offsets, SPACE)
    row_of_byte = np.repeat(np.arange(rows), np.diff(offsets))
    kinds = np.bincount(row_of_byte * CLASSES + CLASS[raw], minlength=rows * CLASSES).reshape(rows, CLASSES).astype(float)
    n_bytes, n = np.diff(offsets).astype(float), np.diff(w.first).astype(float)
    row = np.repeat(np.arange(rows), np.diff(w.first))
    some = np.maximum(n, 1)
    per = lambda flag: np.bincount(row, weights=flag, minlength=rows) / some
    length = (w.end - w.start).astype(float)
    again = np.zeros(row.size)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (row[1:] == row[:-1])
    # counts of distinct words, from runs of equal words within a row
    order = np.lexsort((w.hash, row))
    h, r = w.hash[order], row[order]
    fresh = np.ones(h.size, bool)
    fresh[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(fresh)
    runs = np.diff(np.append(at, h.size))
    distinct = np.bincount(r[at], minlength=rows).astype(float)
    most = np.zeros(rows)
    np.maximum.at(most, r[at], runs)
    tail = np.zeros(row.size) if not row.size else (CLASS[raw[w.end - 1]] == 5).astype(float)
    lone = (length == 1) & (tail > 0) if row.size else tail
    mean = per(length)
    spread = np.sqrt(np.maximum(per(length * length) - mean * mean, 0))
    letters, ink = np.maximum(kinds[:, 1] + kinds[:, 2] + kinds[:, 8], 1), np.maximum(n_bytes - kinds[:, 6] - kinds[:, 7], 1)
    root = lambda share: np.sqrt(np.maximum(share, 0))
    out = np.column_stack([
        np.log1p(n_bytes), np.log1p(mean), np.log1p(spread), root(kinds[:, 2] / letters), root(kinds[:, 4] / ink), root(kinds[:, 5] / ink), root(kinds[:, 3] / ink),
        root(kinds[:, 8] / ink), root(per(again)), np.log1p(distinct) / np.log1p(some), root(most / some) * (n > 0), root(per(tail)), root(per(lone)), root(kinds[:, 7] / some), root(kinds[:, 0] / ink)])
    return np.where((n > 0)[:, None], out, 0.0)


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, f array<double>) for every row; null texts count as empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            raw, off = split_binary(b.column(1))
            for i, j in groups_of(off):
                f = statistics(raw[off[i]:off[j]], off[i:j + 1] - off[i])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(np.arange(0, f.size + 1, FEATURES, dtype=np.int32), f.ravel())], names=["doc_id", "f"])
    return docs.select("doc_id", as_bytes(F.col("text")).alias("text")).mapInArrow(run, f"doc_id {kind}, f array<double>")


class Discriminant(NamedTuple):
    mean: np.ndarray            # per class
    factor: np.ndarray          # inverse of the Cholesky factor of each class's covariance
    offset: np.ndarray          # log prior - half the log determinant
    cut: float                  # log-density difference that maps to the decision score
    slope: float
    decide: float               # the decision score

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log density and prior of class 1 less those of class 0, from Mahalanobis distances."""
        side = [self.offset[k] - 0.5 * (((x - self.mean[k]) @ self.factor[k].T) ** 2).sum(axis=1) for k in (0, 1)]
        return side[1] - side[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (self.difference(x) - self.cut) * self.slope + np.log(self.decide / (1 - self.decide))
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sums and sums of products per class over all rows (label, f); summed by Spark, a few hundred numbers reach the driver."""
    def run(batches):
        part: dict = {}
        for b in batches:
            y = b.column(0).to_numpy()
            x = b.column(1).flatten().to_numpy().reshape(-1, FEATURES)
            for k in (0, 1):
                own = np.column_stack([np.ones((y == k).sum()), x[y == k]])
                part[k] = part.get(k, 0) + own.T @ own
        for k, m in part.items():
            n = m.size
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k), pa.int32()), pa.array(np.arange(n), pa.int32()), pa.array(m.ravel())], names=["label", "at", "v"])
    sums = rows.select("label", "f").mapInArrow(run, "label int, at int, v double").groupBy("label", "at").agg(F.sum("v").alias("v")).collect()
    out = {}
    for k in (0, 1):
        m = np.zeros((FEATURES + 1) ** 2)
        for r in sums:
            if r["label"] == k:
                m[r["at"]] = r["v"]
        m = m.reshape(FEATURES + 1, -1)
        out[k] = (m[0, 0], m[0, 1:], m[1:, 1:])
    return out


def fit(rows: DataFrame, shrink: float = 0.1, floor: float = 0.02, decide: float = 0.7) -> Discriminant:
    """Fits all rows (label 0 or 1, f). Class covariances are shrunk towards the pooled one (``shrink``) and then towards a scaled unit matrix (``floor``).

    A second pass counts the log-density differences of both classes in fixed bins; the cut with the fewest balanced errors gets the score ``decide``. With no
    row of a class the classes share what there is, and scores stay near the middle."""
    m = moments(rows)
    total = sum(v[0] for v in m.values())
    eye = np.eye(FEATURES)
    if not total:
        return Discriminant(np.zeros((2, FEATURES)), np.array([eye, eye]), np.zeros(2), 0.0, 1.0, decide)
    all_mean, all_cov = sum(v[1] for v in m.values()) / total, sum(v[2] for v in m.values()) / total
    all_cov = all_cov - np.outer(all_mean, all_mean)
    mean = [m[k][1] / m[k][0] if m[k][0] else all_mean for k in (0, 1)]
    cov = [m[k][2] / m[k][0] - np.outer(mean[k], mean[k]) if m[k][0] else all_cov for k in (0, 1)]
    pooled = sum(m[k][0] * cov[k] for k in (0, 1)) / total
    scale = np.sqrt(np.maximum(np.diag(all_cov), 1e-8))             # the unit matrix is one in the scale of each statistic
    factor, offset = [], []
    for k in (0, 1):
        c = (1 - shrink) * cov[k] + shrink * pooled
        c = (1 - floor) * c + floor * np.diag(scale * scale) + 1e-9 * eye
        low = np.linalg.cholesky((c + c.T) / 2)
        factor.append(np.linalg.inv(low))
        offset.append(np.log((m[k][0] + 1) / (total + 2)) - np.log(np.diag(low)).sum())
    raw = Discriminant(np.array(mean), np.array(factor), np.array(offset), 0.0, 1.0, decide)
    edge, bins = 200.0, 4000

    def run(batches):
        for b in batches:
            y, d = b.column(0).to_numpy(), raw.difference(b.column(1).flatten().to_numpy().reshape(-1, FEATURES))
            at = np.clip(((d + edge) / (2 * edge) * bins).astype(int), 0, bins - 1) + y * bins
            key, n = np.unique(at, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(n.astype(np.int64))], names=["at", "n"])
    counted = np.zeros(2 * bins)
    for r in rows.select("label", "f").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        counted[r["at"]] = r["n"]
    bad, good = counted[:bins], counted[bins:]
    errors = np.cumsum(good) / max(good.sum(), 1) + (bad.sum() - np.cumsum(bad)) / max(bad.sum(), 1)        # cut above bin i
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    cut = (best[len(best) // 2] + 1) / bins * 2 * edge - edge
    return raw._replace(cut=float(cut) if good.sum() and bad.sum() else 0.0, slope=0.25)


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, decide: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; learns from rows of ``labels`` (doc_id, quality 0 or 1) that are not held out.

    Statistics are computed once per document; null and empty texts get a score like any other. Null or other labels are left out; repeated labels all
    count; an id that repeats gets one row per document row."""
    held = F.coalesce(held_out if held_out is not None else id_remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    stats = stage(document_statistics(docs).withColumn("held_out", held), "statistics")
    told = labels.filter(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("label"))
    model = fit(stats.filter(~F.col("held_out")).join(told, F.col("doc_id") == F.col("_id")).select("label", "f"), decide=decide)
    kind = stats.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            score = model.score(b.column(2).flatten().to_numpy().reshape(-1, FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= decide).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])
    return stats.select("doc_id", "held_out", "f").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def drop_low_quality(docs: DataFrame, labels: DataFrame, decide: float = 0.7) -> DataFrame:
    """Documents with a score of ``decide`` or more; columns as they are. The model comes from the labelled rows of ``docs`` that are not held out."""
    held = F.coalesce(id_remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    told = labels.filter(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("label"))
    stats = stage(document_statistics(docs).withColumn("held_out", held), "statistics")
    model = fit(stats.filter(~F.col("held_out")).join(told, F.col("doc_id") == F.col("_id")).select("label", "f"), decide=decide)
    names, at = docs.columns, [c.lower() for c in docs.columns].index("text")

    def run(batches):
        for b in batches:
            raw, off = split_binary(pc.fill_null(b.column(at).cast(pa.string()), "").cast(pa.binary()))
            keep = np.concatenate([model.score(statistics(raw[off[i]:off[j]], off[i:j + 1] - off[i])) >= decide for i, j in groups_of(off)]) if len(b) else np.zeros(0, bool)
            yield b.select(list(range(len(names)))).filter(pa.array(keep))
    return docs.mapInArrow(run, docs.schema)

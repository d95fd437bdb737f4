"""Exact top-k inner-product search by pivot-table elimination.

Every vector keeps its distances to a fixed set of pivots. For a query q and a candidate c the largest |d(q, p) - d(c, p)| over the pivots is a lower bound
of d(q, c), and <q, c> = (|q|^2 + |c|^2 - d^2) / 2 turns it into an upper bound of the score. Candidates are evaluated in the order of their bounds until
no remaining bound reaches the k-th score found. Queries meet all rows in blocks; whole blocks are skipped by the same bound."""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import shuffle_partitions, stage

PIVOTS, SAMPLE, BLOCK, CHUNK = 32, 4096, 1024, 8192
WIDE, APART = float(1 << 52), 4096          # squared length from which sums may pass 2**53, and rows of a meeting of such vectors
SLACK = 1e-5                        # distances are kept in float32; bounds are loosened by more than their rounding


def scaled_vectors(rows: DataFrame, scale: float = 64.0) -> DataFrame:
    """(vec_id, v array<double>): components floor(scale * x). Null vectors and vectors with a null or non-finite component take no part, nor do null ids; all other rows do,
    different vectors of one id too. Rows that are equal in both count once; other columns are left out."""
    x = lambda e: e.cast("double") * scale
    sound = F.forall(F.col("embedding"), lambda e: F.coalesce((F.abs(x(e)) < float("inf")) & ~F.isnan(x(e)), F.lit(False)))
    kept = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(sound)
    # floor() gives whole numbers of 64 bits; from 2**52 on every double is whole already
    whole = lambda e: F.when(F.abs(x(e)) < WIDE, F.floor(x(e)).cast("double")).otherwise(x(e))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", whole).alias("v")).distinct()


def choose_pivots(vectors: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Far-apart vectors of a fixed sample (the ``sample`` rows of least hash): each next pivot is the one farthest from those before. Pivots only steer
    the work; every row is indexed. Only the share of the hash range that is expected to hold twice the sample is looked at, so that the rows sent to the
    driver do not grow with the tasks."""
    share = min(1.0, 2 * sample / max(1, vectors.count()))
    least = F.xxhash64("vec_id") <= F.lit(int(-2 ** 63 + share * (2 ** 64 - 2 ** 12)))
    drawn = vectors.filter(least).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    if not drawn:
        return np.zeros((1, 1))
    x = padded([r["v"] for r in drawn], max(len(r["v"]) for r in drawn))
    chosen = [x[0]]
    far = ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < min(pivots, len(x)):
        chosen.append(x[int(far.argmax())])
        far = np.minimum(far, ((x - chosen[-1]) ** 2).sum(axis=1))
    return np.array(chosen)


def padded(vectors, dim: int) -> np.ndarray:
    """Rows of one length: shorter vectors stand as if filled with zeros."""
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    dim = max(x.shape[1], pivots.shape[1])
    x, p = np.pad(x, ((0, 0), (0, dim - x.shape[1]))), np.pad(pivots, ((0, 0), (0, dim - pivots.shape[1])))
    d2 = (x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] - 2 * (x @ p.T)
    return np.sqrt(np.maximum(d2, 0)).astype(np.float32)


def _flat(v: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lengths = v.value_lengths().to_numpy(zero_copy_only=False).astype(int)
    return v.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])


BLOCKS = "ids binary, dim int, data binary, table binary, extra binary, rows binary"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("ids", pa.binary()), ("dim", pa.int32()), ("data", pa.binary()), ("table", pa.binary()), ("extra", pa.binary()), ("rows", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])


def blocks(vectors: DataFrame, pivots: np.ndarray, block: int = BLOCK) -> DataFrame:
    """Rows of (vec_id, v, asks, _row) packed into blocks of near vectors: ids, dim, data (int32 numbers), table (float32 distances to the pivots) extra (the
    ``asks`` flags) and rows (the rows' own numbers), all but dim as bytes. Vectors are ordered by nearest pivot and the distance to it in one range exchange, then cut; ids break ties, so
    that copies spread."""
    def measure(batches):
        for b in batches:
            flat, off = _flat(b.column(1))
            d = distances(padded([flat[i:j] for i, j in zip(off[:-1], off[1:])], max([1, *np.diff(off)])), pivots)
            near = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(near)), near])], names=["vec_id", "v", "asks", "_row", "cell", "far"])

    def pack(batches):
        for b in batches:
            ids, asks, own = b.column(0).to_numpy(), b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy()
            flat, off = _flat(b.column(1))
            out = []
            for at in range(0, len(ids), block):
                rows = range(at, min(len(ids), at + block))
                x = padded([flat[off[i]:off[i + 1]] for i in rows], max([1, *(off[i + 1] - off[i] for i in rows)]))
                out.append((ids[rows].tobytes(), x.shape[1], x.astype(np.int32).tobytes(), distances(x, pivots).tobytes(), asks[rows].astype(bool).tobytes(), own[rows].tobytes()))
            if out:
                yield _packed(out)
    measured = vectors.select("vec_id", "v", "asks", "_row").mapInArrow(measure, "vec_id long, v array<double>, asks boolean, _row long, cell int, far float")
    order = ["cell", "far", "vec_id", "_row"]
    placed = measured.repartitionByRange(shuffle_partitions(vectors.sparkSession), *order).sortWithinPartitions(*order)
    return placed.select("vec_id", "v", "asks", "_row").mapInArrow(pack, BLOCKS)


def own_block_scores(packed: DataFrame, k: int) -> DataFrame:
    """The queries of each block, packed alike, with extra = the k-th best score (float64) among the rows of their own block; -inf where it has fewer."""
    def run(batches):
        for b in batches:
            out = []
            for one in b.to_pylist():
                side, asks = Side(pd.DataFrame([one])), np.frombuffer(one["extra"], bool)
                at = np.flatnonzero(asks)
                if not at.size:
                    continue
                scores = side.x[at] @ side.x.T
                scores[side.ids[at][:, None] == side.ids] = -np.inf
                floor = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(at.size, -np.inf)
                out.append((side.ids[at].tobytes(), one["dim"], side.x[at].astype(np.int32).tobytes(), side.table[at].tobytes(), floor.tobytes(), side.rows[at].tobytes()))
            if out:
                yield _packed(out)
    return packed.select(*[c.split()[0] for c in BLOCKS.split(", ")]).mapInArrow(run, BLOCKS)


class Side:
    """Blocks of one side of a meeting, as arrays."""

    def __init__(self, rows: pd.DataFrame):
        dims = rows["dim"].tolist()
        dim = max([1, *dims])
        self.ids, self.rows = (np.concatenate([np.frombuffer(x, np.int64) for x in rows[c]]) for c in ("ids", "rows"))
        self.block = np.concatenate([np.full(len(x) // 8, i) for i, x in enumerate(rows["ids"])])
        self.x = np.concatenate([np.pad(np.frombuffer(x, np.int32).reshape(-1, d).astype(float), ((0, 0), (0, dim - d))) for x, d in zip(rows["data"], dims)])
        self.table = np.concatenate([np.frombuffer(x, np.float32).reshape(len(i) // 8, -1) for x, i in zip(rows["table"], rows["ids"])])
        self.norm = (self.x * self.x).sum(axis=1)


def _better(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _search(q: Side, rows: np.ndarray, c: Side, floor: np.ndarray, k: int):
    """Best k of ``c`` for each query row, as far as they reach ``floor`` (a score that k candidates are known to reach). Candidates are evaluated in tranches of
    falling bounds until none left can reach the k-th score. Where the bounds leave more than an eighth of the rows open, these are not picked out one by one:
    the product with all rows of ``c`` is taken for many such queries at once."""
    dim, n = max(q.x.shape[1], c.x.shape[1]), len(c.ids)
    qx, cx = np.pad(q.x, ((0, 0), (0, dim - q.x.shape[1]))), np.pad(c.x, ((0, 0), (0, dim - c.x.shape[1])))
    table, first = np.ascontiguousarray(c.table.T), np.flatnonzero(np.diff(c.block, prepend=-1))
    low, high = np.minimum.reduceat(c.table, first, axis=0), np.maximum.reduceat(c.table, first, axis=0)
    top_norm, edges = np.maximum.reduceat(c.norm, first), np.append(first, n)
    loose = SLACK * (1 + c.table.max(initial=0))
    many = []
    for r in rows.tolist():
        d, norm, me, need = q.table[r], q.norm[r], q.ids[r], floor[r]
        slack = loose + SLACK * d.max()
        gap = np.maximum(np.maximum(low - d, d - high).max(axis=1) - slack, 0).astype(float)
        whole = np.flatnonzero((norm + top_norm - gap * gap) / 2 >= need)
        if not whole.size:
            continue
        every = whole.size == first.size
        at = np.arange(n) if every else np.concatenate([np.arange(edges[b], edges[b + 1]) for b in whole])
        part, gap, apart = table if every else table[:, at], np.zeros(at.size, np.float32), np.empty(at.size, np.float32)
        for p in range(len(d)):                 # the pivot table, column by column
            np.abs(np.subtract(part[p], d[p], out=apart), out=apart)
            np.maximum(gap, apart, out=gap)
        gap = np.maximum(gap - slack, 0).astype(float)
        bound = (norm + c.norm[at] - gap * gap) / 2
        open_ = np.flatnonzero((bound >= need) & (c.ids[at] != me))
        best_s, best_i, step = np.zeros(0), np.zeros(0, np.int64), 4 * k
        while open_.size:
            order = np.argpartition(-bound[open_], step) if open_.size > step else np.arange(open_.size)
            now, later = at[open_[order[:step]]], open_[order[step:]]
            s, i = np.concatenate([best_s, cx[now] @ qx[r]]), np.concatenate([best_i, c.ids[now]])
            keep = _better(s, i, k)
            best_s, best_i = s[keep], i[keep]
            if len(best_s) == k:
                need = max(need, best_s[-1])
            open_, step = later[bound[later] >= need], step * 2
            if open_.size > n / 8:
                many.append((r, need))
                break
        else:
            keep = best_s >= floor[r]
            yield r, best_s[keep], best_i[keep]
    for at in range(0, len(many), 256):
        some = many[at:at + 256]
        for (r, need), s in zip(some, qx[[r for r, _ in some]] @ cx.T):
            hit = np.flatnonzero((s >= need) & (c.ids != q.ids[r]))
            hit = hit[_better(s[hit], c.ids[hit], k)]
            yield r, s[hit], c.ids[hit]


def exact_meetings(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(_row, query_id, vec_id, score) with the ``k`` best rows of each meeting, in whole numbers of any size: for the vectors whose products are too large for doubles. Chunks of
    queries meet groups of rows, both of about APART rows. Scores beyond 64 bits come out as the nearest 64-bit number."""
    n_chunks, n_groups = (max(1, -(-x.count() // APART)) for x in (queries, rows))
    every, part = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))), lambda n: F.pmod(F.xxhash64("_row"), F.lit(n)).cast("int")
    left = queries.select("_row", "vec_id", "v").withColumn("chunk", part(n_chunks)).withColumn("grp", every(n_groups))
    right = rows.select("_row", "vec_id", "v").withColumn("grp", part(n_groups)).withColumn("chunk", every(n_chunks))
    right = right.select(*[F.col(c).alias(c) for c in right.columns])

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(c):
            dim = max(1, max(map(len, c["v"])), max(map(len, q["v"])))
            table = np.array([[int(x) for x in v] + [0] * (dim - len(v)) for v in c["v"]], object)
            ids = c["vec_id"].to_numpy()
            for row, me, v in zip(q["_row"], q["vec_id"], q["v"]):
                scores = np.clip(table[:, :len(v)] @ np.array([int(x) for x in v], object) if len(v) else np.zeros(len(ids), object), -2 ** 63, 2 ** 63 - 1).astype(np.int64)
                at = np.flatnonzero(ids != me)
                at = at[np.lexsort((ids[at], ~scores[at]))[:k]]
                out.append(pd.DataFrame({"_row": row, "query_id": me, "vec_id": ids[at], "score": scores[at]}))
        return pd.concat(out) if out else pd.DataFrame({"_row": [], "query_id": [], "vec_id": [], "score": []}).astype(np.int64)
    return left.groupBy("chunk", "grp").cogroup(right.groupBy("chunk", "grp")).applyInPandas(meet, "_row long, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, k: int = 20, pivots: int = PIVOTS, sample: int = SAMPLE, block: int = BLOCK, chunk: int = CHUNK, group: int = 8) -> DataFrame:
    """(query_id, rank, vec_id, score) for every row whose ``asks`` holds, against all rows of another id of (vec_id, v, asks): the ``k`` greatest inner
    products, ties to the smaller vec_id; all, if there are fewer. Rows that repeat an id each ask and are each found. Shorter vectors count as filled with zeros; empty tables give
    no rows.

    Every block first searches itself for its own queries, which gives each a score that k rows are known to reach. Then chunks of queries meet groups of
    blocks; only what reaches that score goes on to the last ranking, at most k rows per query and group and mostly far fewer. A meeting holds about
    ``chunk`` queries and ``group`` blocks, at every size of the table. Vectors whose products could pass 2**53 (and so be rounded) meet all others apart, in whole numbers."""
    long = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x) >= WIDE
    everything = stage(vectors.withColumn("_row", F.monotonically_increasing_id()).withColumn("_wide", long), "vectors")
    held, wide = everything.filter("not _wide"), everything.filter("_wide")
    packed = stage(blocks(held, choose_pivots(held, pivots, sample), block), "blocks")
    asked = stage(own_block_scores(packed, k), "asked")
    n_blocks, n_asked = packed.count(), asked.agg(F.coalesce(F.sum(F.length("ids") / 8), F.lit(0))).first()[0]
    n_groups, n_chunks = max(1, -(-n_blocks // group)), max(1, -(-int(n_asked) // chunk))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda n: F.pmod(F.xxhash64("rows"), F.lit(n)).cast("int")
    left = asked.withColumn("chunk", part(n_chunks)).withColumn("grp", every(n_groups))
    right = packed.withColumn("grp", part(n_groups)).withColumn("chunk", every(n_chunks))

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(c):
            a, b = Side(q), Side(c)
            floor = np.concatenate([np.frombuffer(x, float) for x in q["extra"]])
            found = [pd.DataFrame({"_row": a.rows[r], "query_id": a.ids[r], "vec_id": i, "score": s.astype(np.int64)}) for r, s, i in _search(a, np.arange(len(a.ids)), b, floor, k)]
        return pd.concat(found) if found else pd.DataFrame({"_row": [], "query_id": [], "vec_id": [], "score": []}).astype(np.int64)

    met = left.groupBy("chunk", "grp").cogroup(right.groupBy("chunk", "grp")).applyInPandas(meet, "_row long, query_id long, vec_id long, score long")
    if wide.count():
        met = met.unionByName(exact_meetings(wide.filter("asks"), everything, k)).unionByName(exact_meetings(held.filter("asks"), wide, k))
    line = W.partitionBy("_row").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(line)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_vectors(embeddings: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """Queries: the rows whose vec_id is divisible by ``every``."""
    return top_k(scaled_vectors(embeddings).withColumn("asks", F.col("vec_id") % every == 0), k)


TOPK_SQL = """
with ok as (select distinct vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.v, c.v) as bigint) as score from ok q join ok c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 20"""

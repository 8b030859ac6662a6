"""Exact top-k search by MaxScore over vectors of small integers.

A dimension is a term and a shard's column of components is its posting list. A bounded, documented sample of the
candidates gives every query a first threshold (its k-th best score there, which the true one cannot be below), and its
first rows are the pivots that similar vectors are put next to. Shards are then met one by one: a shard whose score
bounds stay below the thresholds of all queries of a block is skipped whole; else the terms are split by their bounds,
the essential columns are multiplied, and a candidate is probed in the other columns only while its partial score and
their bounds can still reach the threshold, which rises with every shard. Thresholds and results merge per query.

Queries are a stated set and meet the rows in blocks: both sides are packed where they are read, and every pair of a
query block and a row block, each bounded in bytes, is one group. Nothing but the sample reaches the driver.

Edge cases: vectors that are null or hold a null or non-finite component (or one that is not finite once scaled), and
rows with a null id, take no part; missing trailing components count as 0; ties go to the smaller id; repeated rows are
candidates one by one, and rows with the query's own id are not candidates; a query id that repeats is asked once.
Scores outside 64 bits are clipped to them.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the sample that seeds thresholds, and how many of them are pivots.
SEED_ROWS, PIVOTS = 8_192, 64
#: Bytes of a block of rows and of a block of queries, as 32-bit components.
ROW_BLOCK, QUERY_BLOCK = 32 << 20, 4 << 20
#: Rows of a shard, and queries that meet it at a time.
SHARD_ROWS, QUERY_ROWS = 4_096, 256
#: Part of a threshold that the terms which are not essential may add at most; probes go so many columns at a time.
REST_SHARE, PROBE = 0.5, 8
_NONE = np.iinfo(np.int64)

_PACKED = "block int, ids binary, vectors binary, width int"


def quantise(ids: pa.Array, vectors: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and floor(scale * component) as whole numbers in float64, of the rows that take part."""
    taken = pc.and_(ids.is_valid(), vectors.is_valid())
    ids, vectors = ids.filter(taken), vectors.filter(taken)
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros((0, 0))
    sizes = np.diff(vectors.offsets.to_numpy(zero_copy_only=False))
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.floor(scale * vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False))
    row = np.repeat(np.arange(len(sizes)), sizes)
    good = np.isfinite(values)
    bad = np.zeros(len(sizes), bool)
    bad[row[~good]] = True
    out = np.zeros((len(sizes), int(sizes.max())))
    place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, place] = np.where(good, values, 0)
    return ids.to_numpy(zero_copy_only=False)[~bad], out[~bad]


def _fit(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def _clip(x: int) -> int:
    return max(_NONE.min, min(_NONE.max, x))


class Best:
    """The k best (score, id) of each query so far, and a threshold that the k-th best score cannot be below."""

    def __init__(self, floor: np.ndarray, k: int) -> None:
        self.score = np.full((len(floor), k), _NONE.min)
        self.id = np.full((len(floor), k), _NONE.max)
        self.filled = np.zeros(len(floor), np.int64)
        self.floor, self.k = floor.copy(), k
        self.shards = self.skipped = self.terms = self.multiplied = 0

    def merge(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """q is sorted."""
        touched, count = np.unique(q, return_counts=True)
        allq = np.concatenate([q, np.repeat(touched, self.k)])
        alls = np.concatenate([score, self.score[touched].ravel()])
        alli = np.concatenate([ids, self.id[touched].ravel()])
        by = np.lexsort((alli, -1 - alls, allq))  # -1 - x turns the order of all 64-bit numbers
        take = by[np.searchsorted(allq[by], touched)[:, None] + np.arange(self.k)[None, :]]
        self.score[touched], self.id[touched] = alls[take], alli[take]
        self.filled[touched] = np.minimum(self.filled[touched] + count, self.k)
        full = touched[self.filled[touched] == self.k]
        self.floor[full] = np.maximum(self.floor[full], self.score[full, -1])


class Shard:
    """Vectors with what bounds their scores: extremes of each column, and a ball around their mean."""

    def __init__(self, ids: np.ndarray, v: np.ndarray) -> None:
        self.ids, self.v = ids, v
        self.high, self.low = v.max(axis=0), v.min(axis=0)
        self.centre = v.mean(axis=0)
        self.radius = float(np.sqrt(((v - self.centre) ** 2).sum(axis=1).max()))
        self.norm = float(np.sqrt((v**2).sum(axis=1).max()))


@np.errstate(over="ignore", invalid="ignore")
def _scan(best: Best, qid: np.ndarray, q: np.ndarray, rows: np.ndarray, shard: Shard) -> None:
    """The given queries (places in qid, q and best) against one shard."""
    best.shards += 1
    part = q[rows]
    floor = best.floor[rows].astype(np.float64)
    known = best.floor[rows] > _NONE.min
    # Bounds of the whole score: columns one by one, and the ball; a margin covers rounding.
    upper = np.maximum(part * shard.high, part * shard.low)
    total = upper.sum(axis=1)
    norms = np.sqrt((part**2).sum(axis=1))
    ball = part @ shard.centre + norms * shard.radius
    able = ~known | ~(np.minimum(total, ball) + norms * shard.norm * 1e-9 + 1 < floor)
    if not able.any():
        best.skipped += 1
        return
    rows, part, floor, known, upper, norms = rows[able], part[able], floor[able], known[able], upper[able], norms[able]
    width = part.shape[1]
    # A query's other terms: as many of the least bounds as may add REST_SHARE of its threshold; they are the least it needs.
    order = np.argsort(-(upper - np.minimum(part * shard.high, part * shard.low)), axis=1, kind="stable")
    back = np.take_along_axis(upper, order, 1)[:, ::-1]
    norm2 = np.take_along_axis(part**2, order, 1)[:, ::-1]
    rest = np.minimum(np.cumsum(np.maximum(back, 0), axis=1), np.sqrt(np.cumsum(norm2, axis=1)) * shard.norm)
    n_rest = np.where(known & (floor > 0), (rest <= REST_SHARE * floor[:, None]).sum(axis=1), 0)
    essential = np.zeros(part.shape, bool)
    np.put_along_axis(essential, order, np.arange(width)[None, :] < (width - n_rest)[:, None], 1)
    columns = np.flatnonzero(essential.any(axis=0))  # of the block: a term that is essential to one query is met for all
    others = np.setdiff1d(np.arange(width), columns)
    best.terms += width
    best.multiplied += len(columns)
    largest = np.abs(part).max(), max(np.abs(shard.high).max(), np.abs(shard.low).max())
    size = largest[0] * largest[1] * width
    kind = np.float32 if max(size, *largest) < 2**24 else np.float64
    whole = size < 2**53
    partial = part[:, columns].astype(kind) @ shard.v[:, columns].astype(kind).T
    slack = 0.0 if whole else float(size) * width * 2.0**-50
    left = np.zeros(len(rows))
    if len(others):
        left = np.minimum(np.maximum(upper[:, others], 0).sum(axis=1), np.sqrt((part[:, others] ** 2).sum(axis=1)) * shard.norm) * (1 + 1e-9)
    cut = np.nextafter(np.where(known, floor - left - slack, -np.inf).astype(kind), kind(-np.inf))
    a, b = np.nonzero(~(partial < cut[:, None]))
    score = partial[a, b].astype(np.float64)
    for at in range(0, len(others), PROBE):
        cols = others[at : at + PROBE]
        score = score + (part[a[:, None], cols] * shard.v[b[:, None], cols]).sum(axis=1)
        after = others[at + PROBE :]
        left = np.minimum(np.maximum(upper[:, after], 0).sum(axis=1), np.sqrt((part[:, after] ** 2).sum(axis=1)) * shard.norm) * (1 + 1e-9)
        stay = ~known[a] | ~(score + left[a] + slack < floor[a])
        a, b, score = a[stay], b[stay], score[stay]
    other = qid[rows[a]] != shard.ids[b]
    a, b, score = a[other], b[other], score[other]
    if whole:
        exact = score.astype(np.int64)
    else:
        exact = np.array([_clip(sum(int(x) * int(y) for x, y in zip(part[i], shard.v[j], strict=True))) for i, j in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
    reach = exact >= best.floor[rows[a]]
    if reach.any():
        best.merge(rows[a[reach]], shard.ids[b[reach]], exact[reach])


@np.errstate(over="ignore", invalid="ignore")
def search(best: Best, qid: np.ndarray, q: np.ndarray, vid: np.ndarray, v: np.ndarray, pivots: np.ndarray, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> None:
    """All queries against all vectors; best gathers the results. Vectors of one pivot are neighbours, the longest first."""
    if not len(qid) or not len(vid):
        return
    width = max(q.shape[1], v.shape[1], pivots.shape[1])
    q, v, pivots = _fit(q, width), _fit(v, width), _fit(pivots, width)
    near = lambda m: (m @ pivots.T).argmax(axis=1) if len(pivots) else np.zeros(len(m), int)
    norm = np.sqrt((v**2).sum(axis=1))
    by = np.lexsort((-norm, near(v), -np.floor(np.log2(norm + 1))))
    groups = np.argsort(near(q), kind="stable")
    blocks = [np.sort(groups[i : i + query_rows]) for i in range(0, len(groups), query_rows)]
    for i in range(0, len(by), shard_rows):
        shard = Shard(vid[by[i : i + shard_rows]], v[by[i : i + shard_rows]])
        for rows in blocks:
            _scan(best, qid, q, rows, shard)


def _pack(ids: np.ndarray, m: np.ndarray, block: int, more: dict | None = None) -> pa.RecordBatch:
    kind = np.int16 if not m.size or np.abs(m).max() < 2**15 else np.float64
    row = {"block": pa.array([block], pa.int32()), "ids": pa.array([ids.astype(np.int64).tobytes()], pa.binary()), "vectors": pa.array([m.astype(kind).tobytes()], pa.binary()), "width": pa.array([m.shape[1] * (1 if kind == np.int16 else -1)], pa.int32())}
    return pa.RecordBatch.from_pydict(row | (more or {}))


def _unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids, parts = [], []
    for i, m, w in zip(table["ids"], table["vectors"], table["width"].to_pylist(), strict=True):
        ids.append(np.frombuffer(i.as_buffer(), np.int64))
        parts.append(np.frombuffer(m.as_buffer(), np.int16 if w >= 0 else np.float64).reshape(len(ids[-1]), abs(w)).astype(np.float64))
    width = max((p.shape[1] for p in parts), default=0)
    return (np.concatenate(ids), np.concatenate([_fit(p, width) for p in parts])) if parts else (np.zeros(0, np.int64), np.zeros((0, 0)))


def _pack_rows(batches: Iterator[pa.RecordBatch], blocks: int, scale: int) -> Iterator[pa.RecordBatch]:
    """Shards of this partition, dealt to the blocks in turn."""
    turn = TaskContext.get().partitionId() * 7919
    for batch in batches:
        for a in range(0, batch.num_rows, SHARD_ROWS):
            some = batch.slice(a, SHARD_ROWS)
            ids, v = quantise(some.column(0), some.column(1), scale)
            if len(ids):
                yield _pack(ids, v, turn % blocks)
                turn += 1


def _pack_queries(batches: Iterator[pa.RecordBatch], sample, blocks: int, k: int, scale: int) -> Iterator[pa.RecordBatch]:
    """Queries of this partition with their thresholds over the sample, dealt to the blocks in turn."""
    turn = TaskContext.get().partitionId() * 7919
    sid, seeds = sample.value
    for batch in batches:
        for a in range(0, batch.num_rows, SHARD_ROWS):
            some = batch.slice(a, SHARD_ROWS)
            ids, q = quantise(some.column(0), some.column(1), scale)
            if not len(ids):
                continue
            best = Best(np.full(len(ids), _NONE.min), k)
            search(best, ids, q, sid, seeds, seeds[:PIVOTS])
            yield _pack(ids, q, turn % blocks, {"floor": pa.array([best.floor.tobytes()], pa.binary())})
            turn += 1


def _meet(queries: pa.Table, rows: pa.Table, sample, k: int) -> pa.Table:
    """One block of queries against one block of rows."""
    qid, q = _unpack(queries)
    vid, v = _unpack(rows)
    floor = np.concatenate([np.frombuffer(f.as_buffer(), np.int64) for f in queries["floor"]]) if len(qid) else np.zeros(0, np.int64)
    best = Best(floor, k)
    search(best, qid, q, vid, v, sample.value[1][:PIVOTS])
    i, j = np.nonzero(np.arange(k)[None, :] < best.filled[:, None])
    return pa.table({"query_id": pa.array(qid[i], pa.int64()), "vec_id": pa.array(best.id[i, j], pa.int64()), "score": pa.array(best.score[i, j], pa.int64())})


def maxscore_topk(candidates: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", seed_rows: int = SEED_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates by the integer inner product."""
    spark = candidates.sparkSession
    pick = [F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")]
    whole = "id is not null and vector is not null and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    base = candidates.select(*pick)
    # Sizes for the blocks, and the bounded sample.
    n = base.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("width")).first()
    n_asked = queries.count()
    width = max(n.width, 1)
    taken = base.where(whole).orderBy(F.xxhash64("id"), "id").limit(max(1, min(seed_rows, ROW_BLOCK // (4 * width)))).toArrow()
    sample = spark.sparkContext.broadcast(quantise(*[c.combine_chunks() for c in taken.columns], scale))
    # Enough row blocks for all tasks; more only where their bytes ask for it.
    # The shuffles carry few bytes for much work, so their partitions are named and not merged by size.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = queries.select(*pick).where(whole).repartition(max(1, min(tasks, ceil(n_asked / QUERY_ROWS))), "id").groupBy("id").agg(F.min("vector").alias("vector"))
    row_blocks = max(ceil(4 * n.n * width / ROW_BLOCK), min(tasks, ceil(n.n / SHARD_ROWS)), 1)
    query_blocks = max(ceil(4 * n_asked * width / QUERY_BLOCK), 1)
    rows = base.mapInArrow(lambda it: _pack_rows(it, row_blocks, scale), _PACKED).withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    packed = asked.mapInArrow(lambda it: _pack_queries(it, sample, query_blocks, k, scale), _PACKED + ", floor binary").withColumn("row_block", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    pairs = min(row_blocks * query_blocks, 16 * tasks)
    met = packed.repartition(pairs, "block", "row_block").groupBy("block", "row_block").cogroup(rows.repartition(pairs, "query_block", "block").groupBy("query_block", "block"))
    out = met.applyInArrow(lambda q, r: _meet(q, r, sample, k), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_maxscore_topk(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return maxscore_topk(rows, rows.where("vec_id % 20 = 0"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a, v b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

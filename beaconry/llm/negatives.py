"""Hard negatives by exact integer scores from a residue number system.

Vectors are whole numbers. A matrix product is done once for each of several small primes, on residues around zero and in
float32, over so few columns at a time that every partial sum is a whole number below 2 ** 24 and so exact. As many primes
are taken as make their product exceed twice the largest score that the two blocks can have; the Chinese remainder
theorem (as balanced mixed-radix digits) then gives back the exact signed scores, from which windows are selected.

Two passes. An anchor's positives come from the rows of its label: rows and anchors are packed by label, and blocks of one
label meet. The positives' scores then set the windows, and blocks of anchors meet blocks of all rows. Anchors are a
stated set; a block of either side is bounded in bytes, a label with a third of all rows is many blocks, and every group
returns the few best of each anchor, which merge per anchor. Nothing but four numbers reaches the driver.

Edge cases: rows with a null id or label, a null vector, or a component that is null, not finite, or not finite once
scaled take no part; missing trailing components count as 0; ties go to the smaller id; repeated rows are candidates one
by one, rows with the anchor's own id are none; an anchor id that repeats is asked once, with its least (label, vector);
an anchor without positives, or whose positives score below 0, has no row; scores outside 64 bits are clipped to them.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconry.llm.topk import QUERY_BLOCK, QUERY_ROWS, ROW_BLOCK, SHARD_ROWS, Best, quantise

#: Primes are taken downwards from here; larger ones follow only where all of these do not suffice.
LARGEST_PRIME = 1021
#: float32 holds whole numbers up to here.
EXACT = 1 << 24
_INT64 = np.iinfo(np.int64)
_PACKED = "label long, block int, ids binary, labels binary, vectors binary, width int"


def _primes(below: int) -> list[int]:
    sieve = np.ones(below + 1, bool)
    sieve[:2] = False
    for i in range(2, int(below**0.5) + 1):
        if sieve[i]:
            sieve[i * i :: i] = False
    return np.flatnonzero(sieve).tolist()


def moduli(bound: int) -> list[int]:
    """Odd primes whose product exceeds 2 * bound."""
    product, out = 1, []
    every = _primes(8192)[1:]
    for p in sorted(every, key=lambda p: (p > LARGEST_PRIME, abs(p - LARGEST_PRIME))):
        out.append(p)
        product *= p
        if product > 2 * bound:
            return out
    raise ValueError("scores too large for the residue number system")


def residues(m: np.ndarray, p: int) -> np.ndarray:
    """m modulo p, from -(p - 1) / 2 to (p - 1) / 2, as float32."""
    r = m if not m.size or np.abs(m).max() < 1 << 40 else np.fmod(m, p)
    return (r - p * np.rint(r / p)).astype(np.float32)


def reconstruct(parts: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The whole numbers of these centred residues: float64 where that is exact, else 64-bit integers, clipped."""
    digits: list[np.ndarray] = []
    for i, p in enumerate(primes):
        r = parts[i]
        for q, d in zip(primes, digits, strict=False):
            r = (r - d) * pow(q, -1, p)
            r = r - p * np.rint(r / p)
        digits.append(r)
    span = 1
    for p in primes:
        span *= p
    kind = np.float64 if span < 1 << 53 else np.int64 if span < 1 << 63 else object
    value = digits[-1].astype(np.int64).astype(kind)
    for p, d in zip(primes[-2::-1], digits[-2::-1], strict=True):
        value = value * p + d.astype(np.int64).astype(kind)
    return np.clip(value, int(_INT64.min), int(_INT64.max)).astype(np.int64) if kind is object else value


class Residues:
    """A matrix with its residues, made once for each prime that is asked for."""

    def __init__(self, m: np.ndarray) -> None:
        self.m, self._of = m, {}
        self.largest = int(np.abs(m).max()) if m.size else 0
        with np.errstate(over="ignore"):
            self.norm = float(np.sqrt((m**2).sum(axis=1).max())) if m.size else 0.0

    def modulo(self, p: int) -> np.ndarray:
        if p not in self._of:
            self._of[p] = residues(self.m, p)
        return self._of[p]


def products(a: Residues, b: Residues) -> np.ndarray:
    """All exact inner products of the rows of a and b."""
    width = a.m.shape[1]
    norms = a.norm * b.norm
    bound = int(norms * (1 + 1e-9)) + 2 if norms < 1e15 else a.largest * b.largest * max(width, 1)
    primes = moduli(bound)
    parts = []
    for p in primes:
        columns = max(1, EXACT // ((p - 1) // 2) ** 2)
        x, y, total = a.modulo(p), b.modulo(p), None
        for at in range(0, max(width, 1), columns):
            part = (x[:, at : at + columns] @ y[:, at : at + columns].T).astype(np.float64)
            total = part if total is None else total + part
        parts.append(total - p * np.rint(total / p))
    return reconstruct(parts, primes)


def _keep(best: Best, q: np.ndarray, able: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
    """Merges into best (for its queries q, one a row of score) the entries that are able and reach its thresholds."""
    able = able & (score >= best.floor[q][:, None])
    if able.sum() > 8 * best.k * len(q) and score.shape[1] > best.k:  # many: what the k best of each row cannot hold is left out
        part = np.where(able, score, -np.inf if score.dtype == np.float64 else _INT64.min)
        able &= score >= np.partition(part, -best.k, axis=1)[:, -best.k][:, None]
    i, j = np.nonzero(able)
    if len(i):
        best.merge(q[i], ids[j], score[i, j].astype(np.int64))


def _rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels, parts = [], [], []
    for i, lab, m, w in zip(table["ids"], table["labels"], table["vectors"], table["width"].to_pylist(), strict=True):
        ids.append(np.frombuffer(i.as_buffer(), np.int64))
        labels.append(np.frombuffer(lab.as_buffer(), np.int64))
        parts.append(np.frombuffer(m.as_buffer(), np.int16 if w >= 0 else np.float64).reshape(len(ids[-1]), abs(w)))
    width = max((p.shape[1] for p in parts), default=0)
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 0))
    return np.concatenate(ids), np.concatenate(labels), np.concatenate([np.pad(p.astype(np.float64), ((0, 0), (0, width - p.shape[1]))) for p in parts])


def _meet(anchors: pa.Table, rows: pa.Table):
    """Pairs of a block of anchors and a shard of rows: anchors' places, their ids and labels, the shard's, the scores."""
    aid, alab, a = _rows(anchors)
    rid, rlab, r = _rows(rows)
    if not len(aid) or not len(rid):
        return
    width = max(a.shape[1], r.shape[1])
    a, r = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, r))
    blocks = [(np.arange(i, min(i + QUERY_ROWS, len(aid))), Residues(a[i : i + QUERY_ROWS])) for i in range(0, len(aid), QUERY_ROWS)]
    for at in range(0, len(rid), SHARD_ROWS):
        ids, labels, shard = rid[at : at + SHARD_ROWS], rlab[at : at + SHARD_ROWS], Residues(r[at : at + SHARD_ROWS])
        for q, block in blocks:
            yield q, aid[q], alab[q], ids, labels, products(block, shard)


def _positives(anchors: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The k best other rows of each anchor among rows, all of one label."""
    aid = np.concatenate([np.frombuffer(i.as_buffer(), np.int64) for i in anchors["ids"]]) if anchors.num_rows else np.zeros(0, np.int64)
    best = Best(np.full(len(aid), _INT64.min), k)
    for q, own, _, ids, _, score in _meet(anchors, rows):
        _keep(best, q, own[:, None] != ids[None, :], score, ids)
    i, j = np.nonzero(np.arange(k)[None, :] < best.filled[:, None])
    return pa.table({"anchor_id": pa.array(aid[i], pa.int64()), "positive_id": pa.array(best.id[i, j], pa.int64()), "positive_score": pa.array(best.score[i, j], pa.int64())})


def _negatives(anchors: pa.Table, rows: pa.Table, k: int, low: int, high: int) -> pa.Table:
    """The k best rows of another label within the window of each anchor's positives; a positive is a query."""
    aid = np.concatenate([np.frombuffer(i.as_buffer(), np.int64) for i in anchors["ids"]]) if anchors.num_rows else np.zeros(0, np.int64)
    own = [np.frombuffer(x.as_buffer(), np.int64) for x in anchors["positives"]] if anchors.num_rows else []
    counts = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in anchors["counts"]]) if anchors.num_rows else np.zeros(0, np.int64)
    pairs = np.concatenate([x.reshape(-1, 2) for x in own]) if own else np.zeros((0, 2), np.int64)
    heads = np.cumsum(counts) - counts
    # high * negative <= ... : the window in whole numbers, exact in Python's; an empty one where the score is negative.
    least = np.array([-(-low * s // 100) if s >= 0 else 0 for s in pairs[:, 1].tolist()], np.int64)
    most = np.array([high * s // 100 if s >= 0 else -1 for s in pairs[:, 1].tolist()], np.int64)
    best = Best(least, k)
    for q, _, alab, ids, labels, score in _meet(anchors, rows):
        other = alab[:, None] != labels[None, :]
        for n in range(int(counts[q].max(initial=0))):
            has = np.flatnonzero(counts[q] > n)
            pair = heads[q[has]] + n
            _keep(best, pair, other[has] & (score[has] <= most[pair][:, None]), score[has], ids)
    i, j = np.nonzero(np.arange(k)[None, :] < best.filled[:, None])
    at = np.repeat(aid, counts)[i]
    place = (np.arange(len(pairs)) - np.repeat(heads, counts))[i]
    return pa.table({"anchor_id": pa.array(at, pa.int64()), "place": pa.array(place, pa.int32()), "positive_id": pa.array(pairs[i, 0], pa.int64()), "positive_score": pa.array(pairs[i, 1], pa.int64()), "negative_id": pa.array(best.id[i, j], pa.int64()), "negative_score": pa.array(best.score[i, j], pa.int64())})


def _pack(batches: Iterator[pa.RecordBatch], blocks: int, scale: int, by_label: bool) -> Iterator[pa.RecordBatch]:
    """(id, label, vector, pairs?) as packs of a shard's rows at most, of one label each if by_label, dealt to blocks in turn."""
    turn = TaskContext.get().partitionId() * 7919
    for batch in batches:
        for at in range(0, batch.num_rows, SHARD_ROWS):
            some = batch.slice(at, SHARD_ROWS)
            kept, m = quantise(pa.array(np.arange(some.num_rows)), some.column(2), scale)
            ids, labels = (some.column(c).to_numpy(zero_copy_only=False)[kept].astype(np.int64) for c in (0, 1))
            pairs = some.column(3).take(pa.array(kept)) if some.num_columns > 3 else None
            by = np.lexsort((ids, labels)) if by_label else np.arange(len(ids))
            cuts = [0, *(np.flatnonzero(np.diff(labels[by])) + 1).tolist(), len(by)] if by_label else [0, len(by)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                pick = by[a:b]
                kind = np.int16 if np.abs(m[pick]).max(initial=0) < 2**15 else np.float64
                row = {
                    "label": pa.array([int(labels[pick[0]]) if by_label else 0], pa.int64()), "block": pa.array([turn % blocks], pa.int32()),
                    "ids": pa.array([ids[pick].tobytes()], pa.binary()), "labels": pa.array([labels[pick].tobytes()], pa.binary()),
                    "vectors": pa.array([m[pick].astype(kind).tobytes()], pa.binary()), "width": pa.array([m.shape[1] * (1 if kind == np.int16 else -1)], pa.int32()),
                }
                if pairs is not None:
                    own = pairs.take(pa.array(pick)).to_pylist()
                    row["positives"] = pa.array([np.array([[p["positive_id"], p["positive_score"]] for x in own for p in x], np.int64).tobytes()], pa.binary())
                    row["counts"] = pa.array([np.array([len(x) for x in own], np.int64).tobytes()], pa.binary())
                yield pa.RecordBatch.from_pydict(row)
                turn += 1


def _grouped(anchors: DataFrame, rows: DataFrame, anchor_blocks: int, row_blocks: int, tasks: int, by_label: bool):
    """Every block of anchors with every block of rows (of the same label)."""
    keys = (["label"] if by_label else []) + ["anchor_block", "row_block"]
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = anchors.withColumnRenamed("block", "anchor_block").withColumn("row_block", each(row_blocks))
    r = rows.withColumnRenamed("block", "row_block").withColumn("anchor_block", each(anchor_blocks))
    # The shuffles carry few bytes for much work, so their partitions are named and not merged by size.
    groups = max(1, min(anchor_blocks * row_blocks * (tasks if by_label else 1), 16 * tasks))
    return a.repartition(groups, *keys).groupBy(*keys).cogroup(r.repartition(groups, *keys).groupBy(*keys))


def mine_hard_negatives(
    rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where anchor holds.

    A positive is one of the `positives` best other rows of the anchor's label (labels are whole numbers); its negatives
    are the `negatives` best rows of other labels that score from low to high per cent of it.
    """
    spark = rows.sparkSession
    pick = [F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector")]
    whole = "id is not null and label is not null and vector is not null and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    base = rows.select(*pick).where(whole)
    asked = rows.where(anchor).select(*pick).where(whole).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("least")).select("id", "least.*")
    # Sizes for the blocks.
    per_label = base.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width"))
    size = per_label.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("n"), F.lit(0)).alias("hot"), F.coalesce(F.max("width"), F.lit(1)).alias("width")).first()
    n_asked = rows.where(anchor).count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = max(size.width, 1)
    row_blocks = lambda n: max(1, ceil(4 * n * width / ROW_BLOCK), min(tasks, ceil(n / SHARD_ROWS)))
    anchor_blocks = max(1, ceil(4 * n_asked * width / QUERY_BLOCK))
    pack = lambda df, blocks, by, more="": df.mapInArrow(lambda it: _pack(it, blocks, scale, by), _PACKED + more)

    same = _grouped(pack(asked, anchor_blocks, True), pack(base, row_blocks(size.hot), True), anchor_blocks, row_blocks(size.hot), tasks, True)
    found = same.applyInArrow(lambda a, r: _positives(a, r, positives), "anchor_id long, positive_id long, positive_score long")
    w = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    found = found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= positives)
    own = found.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("pairs"))

    ready = asked.join(own, asked["id"] == own["anchor_id"]).select("id", "label", "vector", "pairs")
    every = _grouped(pack(ready, anchor_blocks, False, ", positives binary, counts binary"), pack(base, row_blocks(size.n), False), anchor_blocks, row_blocks(size.n), tasks, False)
    out = every.applyInArrow(lambda a, r: _negatives(a, r, negatives, low, high), "anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_score long")
    w = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    out = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_rns_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
r AS (SELECT p.*, n.vec_id AS negative_id, n.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank
      FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 5
"""

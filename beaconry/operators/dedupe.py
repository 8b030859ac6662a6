"""Debouncing, chunk de-duplication and first-seen sets: folds over each key's rows in arrival order.

Debouncing cuts a key's time into pieces. What a piece makes of the events before it depends on one number, the time of
the last kept one, so each piece is summed up as a step function of that number; the functions of a key are applied one
after the other, and every piece is then walked on its own. A key with any number of events is spread over tasks by its
pieces, and a piece holds at most as many times as it has milliseconds. The streaming forms use the same folds.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEBOUNCED = ("pageview", "page_leave")
#: Length of a piece of a key's time.
PIECE_MS = 60_000


def counts_for_debounce(columns: list[str]) -> Column:
    """Page events that carry no errors; all others pass and open no window."""
    errors = F.coalesce("has_errors", F.lit(False)) if "has_errors" in columns else F.lit(False)
    return F.coalesce(F.col("event").isin(*DEBOUNCED), F.lit(False)) & ~errors & F.col("received_ms").isNotNull()


def key_url() -> Column:
    return F.coalesce("url", F.lit(""))


def walk(ms: np.ndarray, last: int | None, window: int) -> list[int]:
    """Places of the kept times of a sorted array, after a kept one at `last`: each is a window or more after the one before."""
    kept, i = [], 0 if last is None else int(np.searchsorted(ms, last + window))
    while i < len(ms):
        kept.append(i)
        i = int(np.searchsorted(ms, ms[i] + window))
    return kept


def summary(ms: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """A piece as steps (upto, last): the first kept time being the first at or after t, the last one kept is that of the
    first step with t <= upto; without such a step the piece keeps none."""
    at = np.arange(min(int(np.searchsorted(ms, ms[0] + window)) + 1, len(ms)))
    following = np.searchsorted(ms, ms + window)
    cur = at.copy()
    while len(moving := np.flatnonzero(following[cur] < len(ms))):
        cur[moving] = following[cur[moving]]
    ends = np.flatnonzero(np.r_[np.diff(cur) != 0, True])
    return ms[at[ends]], ms[cur[ends]]


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    return column.offsets.to_numpy() - column.offsets[0].as_py(), column.flatten()


def _summaries(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(visitor, key_url, piece, rows of time and id) with the first time and the steps."""
    for batch in batches:
        ends, rows = _lists(batch.column(3))
        ms = rows.field(0).to_numpy(zero_copy_only=False)
        steps = [summary(ms[a:b], window) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        first = pa.array(ms[ends[:-1]], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], first, pa.array([s[0] for s in steps], pa.list_(pa.int64())), pa.array([s[1] for s in steps], pa.list_(pa.int64()))], names=["visitor", "key_url", "piece", "first", "upto", "last"])


def _entries(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(visitor, key_url, pieces in order with their steps): of the pieces that a kept time before them reaches, that time."""
    for batch in batches:
        ends, rows = _lists(batch.column(2))
        piece, first = (rows.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        (at, upto), (_, last) = _lists(rows.field(2)), _lists(rows.field(3))
        upto, last = upto.to_numpy(zero_copy_only=False), last.to_numpy(zero_copy_only=False)
        owner, out_piece, entry = [], [], []
        for row, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            state = None
            for k in range(a, b):
                steps, exits = upto[at[k] : at[k + 1]], last[at[k] : at[k + 1]]
                if state is None or first[k] - state >= window:
                    state = int(exits[0])
                    continue
                owner.append(row)
                out_piece.append(int(piece[k]))
                entry.append(state)
                s = int(np.searchsorted(steps, state + window))
                state = int(exits[s]) if s < len(exits) else state
        keys = [c.take(pa.array(owner, pa.int64())) for c in batch.columns[:2]]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(out_piece, pa.int64()), pa.array(entry, pa.int64())], names=["visitor", "key_url", "piece", "entry"])


def _walks(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(rows of time and id, entry): the ids of the kept ones."""
    for batch in batches:
        ends, rows = _lists(batch.column(0))
        ms, ids = (rows.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        kept = [a + i for a, b, last in zip(ends[:-1].tolist(), ends[1:].tolist(), batch.column(1).to_pylist(), strict=True) for i in walk(ms[a:b], last, window)]
        yield pa.RecordBatch.from_arrays([pa.array(ids[kept], pa.int64())], names=["request_id"])


def debounce(events: DataFrame, window_ms: int = 5000, piece_ms: int = PIECE_MS) -> DataFrame:
    """`kept` per event: page events of a visitor and URL are dropped within window_ms of the last kept one.

    Of events at the same time the one with the smallest request_id can be kept. Events that carry errors, and events of
    other names, pass and open no window. Request ids are whole numbers and unique.
    """
    counts = counts_for_debounce(events.columns)
    key = ["visitor", "key_url"]
    piece = F.floor(F.col("received_ms") / max(piece_ms, window_ms)).cast("long").alias("piece")
    times = events.where(counts).select("visitor", key_url().alias("key_url"), piece, F.col("received_ms").cast("long").alias("ms"), F.col("request_id").cast("long").alias("request_id"))
    times = times.groupBy(*key, "piece", "ms").agg(F.min("request_id").alias("request_id"))
    pieces = times.groupBy(*key, "piece").agg(F.array_sort(F.collect_list(F.struct("ms", "request_id"))).alias("rows"))
    kinds = f"visitor {events.schema['visitor'].dataType.simpleString()}, key_url string"
    steps = pieces.mapInArrow(lambda it: _summaries(it, window_ms), f"{kinds}, piece long, first long, upto array<long>, last array<long>")
    chains = steps.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("piece", "first", "upto", "last"))).alias("pieces")).where(F.size("pieces") > 1)
    entries = chains.mapInArrow(lambda it: _entries(it, window_ms), f"{kinds}, piece long, entry long")
    p, e = pieces.alias("p"), entries.alias("e")
    met = p.join(e, F.expr("p.visitor <=> e.visitor AND p.key_url = e.key_url AND p.piece = e.piece"), "left").select("p.rows", "e.entry")
    kept = met.mapInArrow(lambda it: _walks(it, window_ms), "request_id long").withColumn("kept_row", F.lit(True))
    out = events.withColumn("counts", counts).join(kept, "request_id", "left")
    return out.withColumn("kept", ~F.col("counts") | F.coalesce("kept_row", F.lit(False))).drop("counts", "kept_row")


class ChunkSet:
    """The kept chunks of a replay stream so far: their batch ids, and the sequences they cover as disjoint ranges in order."""

    def __init__(self, batches: list[str] = (), starts: list[int] = (), ends: list[int] = ()) -> None:
        self.batches, self.starts, self.ends = set(batches), list(starts), list(ends)

    def offer(self, batch_id: str | None, sequence: int | None, first: int | None, last: int | None) -> bool:
        """Whether the chunk is kept: no kept one has its batch id or covers its sequence."""
        if batch_id is not None and batch_id in self.batches:
            return False
        if sequence is not None:
            k = bisect_right(self.starts, sequence) - 1
            if k >= 0 and sequence <= self.ends[k]:
                return False
        if batch_id is not None:
            self.batches.add(batch_id)
        if first is not None and last is not None and first <= last:
            a, b = bisect_left(self.ends, first - 1), bisect_right(self.starts, last + 1)
            if a < b:  # touches ranges a to b
                first, last = min(first, self.starts[a]), max(last, self.ends[b - 1])
            self.starts[a:b], self.ends[a:b] = [first], [last]
        return True


CHUNK_KEY = ["project_id", "session_id", "window_id", "generation"]


#: Chunks whose values a task holds as Python objects at once.
SLICE = 20_000


def _kept_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key columns, rows in order): the chunks that are kept. A stream of any length is walked in slices."""
    names = ("chunk", "batch_id", "sequence", "first_sequence", "last_sequence")
    for batch in batches:
        ends, rows = _lists(batch.column(4))
        fields = [rows.field(n) for n in names]
        row, seen = 0, ChunkSet()
        for start in range(0, len(rows), SLICE):
            owner, chunk = [], []
            for k, x in enumerate(zip(*[f.slice(start, SLICE).to_pylist() for f in fields], strict=True), start):
                while k >= ends[row + 1]:
                    row, seen = row + 1, ChunkSet()
                if seen.offer(*x[1:]):
                    owner.append(row)
                    chunk.append(x[0])
            keys = [c.take(pa.array(owner, pa.int64())) for c in batch.columns[:4]]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(chunk, pa.int64())], names=[*CHUNK_KEY, "chunk"])


def dedupe_chunks(chunks: DataFrame) -> DataFrame:
    """`kept` per chunk: dropped if a kept chunk of the stream has its batch id, or covers its sequence.

    A stream's chunks (a session's window) are folded in arrival order with a set of ids and ordered ranges.
    """
    rows = chunks.groupBy(*CHUNK_KEY).agg(F.array_sort(F.collect_list(F.struct("received_ms", F.col("chunk").cast("long").alias("chunk"), "batch_id", "sequence", "first_sequence", "last_sequence"))).alias("rows"))
    kinds = ", ".join(f"{k} {chunks.schema[k].dataType.simpleString()}" for k in CHUNK_KEY)
    kept = rows.mapInArrow(_kept_chunks, f"{kinds}, chunk long").withColumn("kept", F.lit(True)).alias("k")
    same = F.expr(" AND ".join([*(f"c.{k} <=> k.{k}" for k in CHUNK_KEY), "c.chunk = k.chunk"]))
    return chunks.alias("c").join(kept, same, "left").select("c.*", F.coalesce("k.kept", F.lit(False)).alias("kept"))


def first_for_billing(chunks: DataFrame) -> DataFrame:
    """The first stored chunk of each session."""
    first = F.min_by(F.struct("chunk", "window_id", "received_ms"), F.struct("received_ms", "chunk", "window_id")).alias("f")
    return chunks.groupBy("project_id", "session_id").agg(first).select("project_id", "session_id", "f.chunk", "f.window_id", "f.received_ms")

"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

Each task hashes all windows of its texts and sends them, packed, to the task that counts their bucket. A window's
bucket follows the least hash of the short runs of words in it, so neighbouring windows mostly share one and a repeated
passage comes back as a few runs. Windows that a task itself sees under a smaller id are settled there (so a passage
that many documents share is sent once a chunk). A document's repeated windows come back as runs of word positions and
are merged into maximal removal intervals over its words.

A first pass counts the windows that cells of the anchors' hash space will get. A cell with more than a fair share (a run
of words that much text has around it) is split by the windows' own hashes, so that no bucket follows one anchor.

Edge cases: a null or empty text has no words; a text shorter than the window loses nothing; rows with a null id keep
every word and never cause a removal; rows that share an id are judged separately and never remove each other's words.
Equal hashes stand for equal windows (64 bits: about n * n / 2 ** 65 chance collisions over n windows).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.llm.shared import SPLIT_ON_SPACE, Words, chunks, mix64, pack_ints, pack_longs, rolling, shuffle_buckets, stage, unpack_ints, unpack_longs

_SENT = "bucket int, ids binary, keys binary, hashes binary, rows binary, places binary"
_FOUND = "id long, row_key long, runs binary"
#: Words of the runs whose least hash places a window.
_ANCHOR = 8
#: Cells of the anchors' hash space a bucket.
_CELLS = 64
#: Windows of a cell that a task with more than eight times as many does not report.
_FEW = 128


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minima of every n consecutive elements."""
    width, m = 1, x
    while 2 * width <= n:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    rest = n - width
    return np.minimum(m[:-rest], m[rest:]) if rest else m


def _runs(row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive places of one row, as row, first place and length; the input is ordered by row and place."""
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)])
    return row[new], place[new], np.diff(np.r_[new, len(row)])


@dataclass
class _Open:
    """The windows of a chunk: where they are, their cells and hashes, and which of them the chunk itself settles."""

    words: Words
    row: np.ndarray
    place: np.ndarray
    cell: np.ndarray
    h: np.ndarray
    settled: np.ndarray


def _opened(batches: Iterator[pa.RecordBatch], size: int, cells: int) -> Iterator[tuple[pa.RecordBatch, _Open]]:
    anchor = min(_ANCHOR, size)
    for batch in batches:
        for part in chunks(batch, "text"):
            words = Words(part.column(2), SPLIT_ON_SPACE, lower=False)
            base = words.hashes()
            h = rolling(base, size)
            row = words.row_of_word()
            known = part.column(0).is_valid().to_numpy(zero_copy_only=False)
            at = np.flatnonzero((row[: len(h)] == row[size - 1 :]) & known[row[: len(h)]]) if len(h) else np.zeros(0, int)
            if not len(at):
                continue
            cell = (mix64(_sliding_min(rolling(base, anchor), size - anchor + 1))[at] % np.uint64(cells)).astype(np.int64)
            h, row = h[at], row[at]
            doc = part.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            by = np.argsort(h)
            begin = np.flatnonzero(np.r_[True, h[by[1:]] != h[by[:-1]]])
            least = np.repeat(np.minimum.reduceat(doc[row[by]], begin), np.diff(np.r_[begin, len(h)]))
            settled = np.zeros(len(h), bool)
            settled[by] = doc[row[by]] > least
            yield part, _Open(words, row, at - words.first[row], cell, h, settled)


def _loads(batches: Iterator[pa.RecordBatch], size: int, cells: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Windows of a task (cell -1), and those of the cells that have more than a bucket's mean share of them."""
    held = np.zeros(cells, np.int64)
    for _, o in _opened(batches, size, cells):
        held += np.bincount(o.cell[~o.settled], minlength=cells)
    total = int(held.sum())
    cell = np.flatnonzero(held > max(total // buckets, min(_FEW, total // 8)))
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, cell], pa.int64()), pa.array(np.r_[total, held[cell]], pa.int64())], names=["cell", "n"])


class _Buckets:
    """Buckets of windows: cells modulo the number of buckets; cells with more windows than a limit have buckets of their own."""

    def __init__(self, buckets: int, hot: list[tuple[int, int]], limit: int) -> None:
        hot = sorted(hot)
        self.buckets = buckets
        self.cells = np.array([c for c, _ in hot], np.int64)
        self.parts = np.array([-(-n // limit) for _, n in hot], np.int64)
        self.first = buckets + np.cumsum(self.parts) - self.parts

    def of(self, cell: np.ndarray, h: np.ndarray) -> np.ndarray:
        out = cell % self.buckets
        if len(self.cells):
            at = np.minimum(np.searchsorted(self.cells, cell), len(self.cells) - 1)
            hot = self.cells[at] == cell
            at = at[hot]
            out[hot] = self.first[at] + (mix64(h[hot]) % self.parts[at].astype(np.uint64)).astype(np.int64)
        return out.astype(np.int32)


def _windows(batches: Iterator[pa.RecordBatch], size: int, cells: int, buckets: _Buckets) -> Iterator[pa.RecordBatch]:
    for part, o in _opened(batches, size, cells):
        doc = part.column(0).fill_null(0).to_numpy(zero_copy_only=False)
        key = part.column(1).to_numpy(zero_copy_only=False)
        bucket = buckets.of(o.cell, o.h)
        out: list[tuple] = []
        send = np.flatnonzero(~o.settled)
        send = send[np.argsort(bucket[send], kind="stable")]
        edges = np.flatnonzero(np.r_[True, bucket[send[1:]] != bucket[send[:-1]], True]) if len(send) else [0]
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            take = send[x:y]
            r, first, n = _runs(o.row[take], o.place[take])
            used, local = np.unique(r, return_inverse=True)
            out.append((int(bucket[take[0]]), pack_longs(doc[used]), pack_longs(key[used]), o.h[take].tobytes(), pack_ints(local), pack_ints(np.stack([first, n]).ravel())))
        if o.settled.any():
            r, first, n = _runs(o.row[o.settled], o.place[o.settled])
            used, local = np.unique(r, return_inverse=True)
            # They only have to reach their documents: any bucket will do.
            some = int(key[used[0]] % buckets.buckets)
            out.append((some, pack_longs(doc[used]), pack_longs(key[used]), b"", pack_ints(local), pack_ints(np.stack([first, n]).ravel())))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32()] + [pa.binary()] * 5, strict=True)], names=["bucket", "ids", "keys", "hashes", "rows", "places"])


def _repeated(table: pa.Table) -> pa.Table:
    """The repeated windows of a bucket: those that start under a larger id than their hash's least."""
    hs, docs, keys, places, done = [], [], [], [], []
    for r in table.to_pylist():
        local = unpack_ints(r["rows"])
        doc, key = unpack_longs(r["ids"])[local], unpack_longs(r["keys"])[local]
        first, n = unpack_ints(r["places"]).astype(np.int64).reshape(2, -1)
        if not r["hashes"]:
            done.append((doc, key, first, n))
            continue
        hs.append(np.frombuffer(r["hashes"], np.uint64))
        docs.append(np.repeat(doc, n))
        keys.append(np.repeat(key, n))
        places.append(np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum()))
    if hs:
        h, doc, key, place = (np.concatenate(x) for x in (hs, docs, keys, places))
        by = np.argsort(h)
        begin = np.flatnonzero(np.r_[True, h[by[1:]] != h[by[:-1]]])
        least = np.repeat(np.minimum.reduceat(doc[by], begin), np.diff(np.r_[begin, len(h)]))
        hit = np.zeros(len(h), bool)
        hit[by] = doc[by] > least
        if hit.any():
            # Sent windows are in the order of their texts, so runs of hits are runs of places.
            new = np.flatnonzero(np.r_[True, (doc[hit][1:] != doc[hit][:-1]) | (key[hit][1:] != key[hit][:-1]) | (place[hit][1:] != place[hit][:-1] + 1)])
            done.append((doc[hit][new], key[hit][new], place[hit][new], np.diff(np.r_[new, hit.sum()])))
    if not done:
        return pa.table({"id": pa.array([], pa.int64()), "row_key": pa.array([], pa.int64()), "runs": pa.array([], pa.binary())})
    doc, key, first, n = (np.concatenate(x) for x in zip(*done, strict=True))
    by = np.lexsort((first, key, doc))
    doc, key, runs = doc[by], key[by], np.stack([first[by], n[by]], 1).astype(np.uint32)
    cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])
    return pa.table({"id": pa.array(doc[cut], pa.int64()), "row_key": pa.array(key[cut], pa.int64()), "runs": pa.array([runs[a:b].tobytes() for a, b in zip(cut, np.r_[cut[1:], len(doc)], strict=True)], pa.binary())})


def _cut(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            words = Words(part.column(1), SPLIT_ON_SPACE, lower=False)
            raw = words.raw.tobytes()
            removed, kept, spans = [], [], []
            for i, found in enumerate(part.column(2).to_pylist()):
                a, n = int(words.first[i]), int(words.counts[i])
                gone = np.zeros(n + 1, np.int64)
                if found:
                    runs = np.frombuffer(b"".join(found), np.uint32).astype(np.int64).reshape(-1, 2)
                    np.add.at(gone, runs[:, 0], 1)
                    np.subtract.at(gone, runs.sum(axis=1) + size - 1, 1)
                out = np.cumsum(gone)[:n] > 0
                edges = np.flatnonzero(np.diff(np.r_[False, out, False]))
                spans.append(edges.tolist())
                removed.append(int(out.sum()))
                stay = np.flatnonzero(~out) + a
                kept.append(b" ".join([raw[s:e] for s, e in zip(words.starts[stay].tolist(), words.ends[stay].tolist(), strict=True)]))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.binary())], names=["id", "n_words", "n_removed", "removed_spans", "kept"]
            )


def _bucketed(texts: DataFrame, window: int, buckets: int, cells: int) -> _Buckets:
    """Which cells are split: those that tasks saw with more than two buckets' mean share of all windows.

    Tasks leave out what is below a mean share of their own windows, or few windows, so that they send little; a cell with three
    shares is seen with two. Cells with so much are less than half as many as buckets, and all that the driver gets.
    """
    loads = stage(texts.mapInArrow(lambda it: _loads(it, window, cells, buckets), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")), "repeat_loads")
    total = loads.where("cell < 0").agg(F.sum("n").alias("n")).first().n or 0
    limit = -(-2 * total // buckets) or 1
    return _Buckets(buckets, [(r.cell, r.n) for r in loads.where((F.col("cell") >= 0) & (F.col("n") > limit)).collect()], limit)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """(id, n_words, n_removed, removed_spans, kept): words covered by a window that also starts under a smaller id are removed.

    removed_spans lists start, end (exclusive) word positions of the maximal intervals; kept has the other words' UTF-8
    bytes joined by one space. One row per input row.
    """
    buckets = shuffle_buckets(docs.sparkSession, 2)
    cells = buckets * _CELLS
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).select("id", F.xxhash64("text").alias("row_key"), "text")
    split = _bucketed(texts, window, buckets, cells)
    sent = texts.mapInArrow(lambda it: _windows(it, window, cells, split), _SENT)
    found = sent.groupBy("bucket").applyInArrow(_repeated, _FOUND).groupBy("id", "row_key").agg(F.collect_list("runs").alias("runs"))
    joined = texts.join(found, ["id", "row_key"], "left").select("id", "text", "runs")
    return joined.mapInArrow(lambda it: _cut(it, window), "id long, n_words long, n_removed long, removed_spans array<long>, kept binary")


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, hash(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
least AS (SELECT h, min(doc_id) AS first_doc FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT win.doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN least USING (h) WHERE win.doc_id > first_doc)),
flat AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT flat.doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM flat ANTI JOIN gone ON flat.doc_id = gone.doc_id AND flat.p = gone.p GROUP BY flat.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""

"""Benchmark decontamination with training suffix arrays.

Each task builds the suffix array of its shard of training words (a bounded chunk of whole documents) and
binary-searches every benchmark window in it; the hits are the verbatim matches and their locations. A document's
result needs only its own shard, so nothing is shuffled. The benchmark is the stated query set: it travels in blocks of
bounded size, and the training documents pass through one search per block.

Edge cases: null or word-less texts have no words, no hits and are clean; benchmark rows with a null id or without
words are skipped; repeated benchmark rows count once; an empty benchmark leaves every document clean. Rows that
repeat in the training table are judged one by one. Input columns other than the id and the text pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beaconry.llm.shared import ALNUM_OR_HIGH, SMALL_CHUNK, Words, chunks

#: Text bytes of the benchmark that one broadcast block holds.
BLOCK_BYTES = 16 << 20
#: Bits of a word's number, at least: three words in a key. A block with more different words has fewer in a key.
_ID_BITS = 21


class Keys:
    """How consecutive words are packed into one number: as many as fit into 63 bits, the first one most significant."""

    def __init__(self, vocabulary: int) -> None:
        self.bits = max(_ID_BITS, int(vocabulary).bit_length())
        self.words = 63 // self.bits

    def of(self, ids: np.ndarray) -> np.ndarray:
        n = len(ids) + 1
        a = np.zeros(n + self.words - 1, np.int64)
        a[: len(ids)] = ids
        out = np.zeros(n, np.int64)
        for k in range(self.words):
            out = (out << self.bits) | a[k : n + k]
        return out


class Block:
    """A block of the benchmark: its words as small numbers, and its distinct windows grouped by length."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        words = Words(pa.array([t for _, t in items], pa.string()), ALNUM_OR_HIGH, lower=True)
        h = words.hashes()
        self.vocabulary = np.unique(h)
        self.keys = Keys(len(self.vocabulary))
        ids = np.searchsorted(self.vocabulary, h).astype(np.int64) + 1
        seen: dict[bytes, int] = {}
        owners: list[list[tuple[int, int]]] = []
        texts: dict[int, list[tuple[int, np.ndarray]]] = {}
        for k, n in enumerate(words.counts.tolist()):
            seq = ids[words.first[k] : words.first[k] + n]
            length = min(window, n)
            for j in range(n - length + 1) if n else ():
                w = seq[j : j + length]
                at = seen.setdefault(w.tobytes(), len(owners))
                if at == len(owners):
                    owners.append([])
                    texts.setdefault(length, []).append((at, w))
                owners[at].append((k, j))
        self.items = [i for i, _ in items]
        self.windows = {n: (np.array([a for a, _ in ws]), np.stack([w for _, w in ws])) for n, ws in texts.items()}
        self.owner_first = np.cumsum([0] + [len(x) for x in owners])
        self.owner_item = np.array([k for x in owners for k, _ in x], dtype=np.int64)
        self.owner_start = np.array([j for x in owners for _, j in x], dtype=np.int64)


def suffix_array(ids: np.ndarray, depth: int, keys: Keys) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the suffixes that begin with a benchmark word, sorted by their first depth words, and the keys.

    ids has 0 for words outside the benchmark and between documents. Ties are refined a key of words at a time,
    only among the suffixes that are still tied.
    """
    key = keys.of(ids)
    order = np.flatnonzero(ids)
    order = order[np.argsort(key[order], kind="stable")]
    group = np.r_[0, np.cumsum(key[order[1:]] != key[order[:-1]])] if len(order) else np.zeros(0, np.int64)
    end = len(key) - 1
    for step in range(keys.words, depth, keys.words):
        if len(order) < 2:
            break
        same = group[1:] == group[:-1]
        tied = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
        if not len(tied):
            break
        pos = order[tied]
        nxt = key[np.minimum(pos + step, end)]
        by = np.lexsort((nxt, group[tied]))
        order[tied] = pos[by]
        fresh = np.zeros(len(order), np.int64)
        g, x = group[tied], nxt[by]
        fresh[tied[1:]] = (g[1:] == g[:-1]) & (x[1:] != x[:-1])
        group = np.r_[0, np.cumsum((group[1:] != group[:-1]) | (fresh[1:] > 0))]
    return order, key


def _bound(order: np.ndarray, key: np.ndarray, keys: Keys, windows: np.ndarray, lo: np.ndarray, hi: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of each window (a row of word numbers) in the suffix array between lo and hi."""
    length, per = windows.shape[1], keys.words
    want = np.stack([keys.of(w)[:length:per] for w in windows])
    lo, hi = lo.copy(), hi.copy()
    end = len(key) - 1
    while True:
        live = np.flatnonzero(lo < hi)
        if not len(live):
            return lo
        mid = (lo[live] + hi[live]) // 2
        pos = order[mid]
        less, open_ = np.zeros(len(live), bool), np.ones(len(live), bool)
        for c in range(want.shape[1]):
            shift = keys.bits * max(0, per * (c + 1) - length)
            a = key[np.minimum(pos + per * c, end)] >> shift
            b = want[live, c] >> shift
            less |= open_ & (a < b)
            open_ &= a == b
        go = less | (open_ & right)
        lo[live] = np.where(go, mid + 1, lo[live])
        hi[live] = np.where(go, hi[live], mid)


def search(block: Block, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every occurrence of a window: its word position in the chunk, length, and window number."""
    h = words.hashes()
    if not len(h) or not len(block.vocabulary):
        none = np.zeros(0, np.int64)
        return none, none, none
    at = np.minimum(np.searchsorted(block.vocabulary, h), len(block.vocabulary) - 1)
    known = np.where(block.vocabulary[at] == h, at + 1, 0)
    # One empty place after each document keeps matches inside it.
    shift = words.row_of_word()
    ids = np.zeros(len(h) + len(words.counts) + 1, np.int64)
    spread = np.arange(len(h)) + shift
    ids[spread] = known
    depth = max(block.windows)
    keys = block.keys
    order, key = suffix_array(ids, depth, keys)
    first = key[order]
    found = []
    for length, (number, windows) in block.windows.items():
        low = np.zeros(len(windows), np.int64)
        for k in range(keys.words):
            low = (low << keys.bits) | (windows[:, k] if k < length else 0)
        span = (1 << (keys.bits * max(0, keys.words - length))) - 1
        lo, hi = np.searchsorted(first, low, "left"), np.searchsorted(first, low + span, "right")
        if length > keys.words:
            live = np.flatnonzero(lo < hi)
            number, windows, lo, hi = number[live], windows[live], lo[live], hi[live]
            if len(live):
                lo, hi = _bound(order, key, keys, windows, lo, hi, False), _bound(order, key, keys, windows, lo, hi, True)
        size = np.maximum(hi - lo, 0)
        if size.sum():
            take = np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            found.append((order[take], np.full(len(take), length), np.repeat(number, size)))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    pos, length, number = (np.concatenate(x) for x in zip(*found, strict=True))
    # Back to word positions without the empty places.
    starts = words.first[:-1] + np.arange(len(words.counts))
    row = np.searchsorted(starts, pos, side="right") - 1
    return pos - row, length, number


def _matches(block: Block, words: Words) -> list[tuple[list[int], list[str], list[dict]]]:
    pos, length, number = search(block, words)
    rows = len(words.counts)
    spans: list[list[int]] = [[] for _ in range(rows)]
    items: list[list[str]] = [[] for _ in range(rows)]
    best: list[dict | None] = [None] * rows
    if not len(pos):
        return [(s, i, b) for s, i, b in zip(spans, items, best, strict=True)]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, pos, 1)
    np.subtract.at(edge, pos + length, 1)
    hit = np.cumsum(edge)[:-1] > 0
    row_of = words.row_of_word()
    place = np.flatnonzero(hit)
    begin = np.r_[True, (place[1:] != place[:-1] + 1) | (row_of[place[1:]] != row_of[place[:-1]])]
    heads = place[begin]
    tails = place[np.r_[np.flatnonzero(begin)[1:] - 1, len(place) - 1]] + 1
    for s, e in zip(heads.tolist(), tails.tolist(), strict=True):
        r = int(row_of[s])
        spans[r] += [s - int(words.first[r]), e - int(words.first[r])]
    size = block.owner_first[number + 1] - block.owner_first[number]
    take = np.repeat(block.owner_first[number], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    item, start = block.owner_item[take], block.owner_start[take]
    p, n = np.repeat(pos, size), np.repeat(length, size)
    row = row_of[p]
    for r, k in np.unique(np.stack([row, item], 1), axis=0).tolist():
        items[r].append(block.items[k])
    # Windows that follow each other on one diagonal make one longer verbatim match.
    by = np.lexsort((p, p - start, item, row))
    row, item, start, p, n = row[by], item[by], start[by], p[by], n[by]
    new = np.r_[True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (p[1:] - start[1:] != p[:-1] - start[:-1]) | (p[1:] != p[:-1] + 1)]
    a = np.flatnonzero(new)
    b = np.r_[a[1:], len(p)] - 1
    total = p[b] - p[a] + n[b]
    for i in np.lexsort((p[a], -total)).tolist():
        r = int(row[a[i]])
        if best[r] is None:
            best[r] = {"item_id": block.items[int(item[a[i]])], "item_start": int(start[a[i]]), "doc_start": int(p[a[i]] - words.first[r]), "n_words": int(total[i])}
    return [(s, i, b) for s, i, b in zip(spans, items, best, strict=True)]


_MATCH = pa.struct([("item_id", pa.string()), ("item_start", pa.int64()), ("doc_start", pa.int64()), ("n_words", pa.int64())])


def _joined(spans: list[int]) -> list[int]:
    """The union of intervals given as start, end, start, end..."""
    out: list[int] = []
    for s, e in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def _search_block(batches: Iterator[pa.RecordBatch], block, text: str, names: list[str]) -> Iterator[pa.RecordBatch]:
    b: Block = block.value
    for batch in batches:
        for part in chunks(batch, text, SMALL_CHUNK):
            words = Words(part.column(part.schema.get_field_index(text)), ALNUM_OR_HIGH, lower=True)
            new = _matches(b, words)
            old = zip(*(part.column(part.schema.get_field_index(n)).to_pylist() for n in names[1:]), strict=True)
            spans, items, best = [], [], []
            for (s, i, m), (s0, i0, m0) in zip(new, old, strict=True):
                spans.append(_joined(s0 + s) if s0 and s else s0 or s)
                items.append(sorted(set(i0) | set(i)) if i0 or i else [])
                best.append(m if m0 is None or (m is not None and m["n_words"] > m0["n_words"]) else m0)
            made = [pa.array(words.counts, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string())), pa.array(best, _MATCH)]
            rest = [c for c, n in zip(part.columns, part.schema.names, strict=True) if n not in names]
            yield pa.RecordBatch.from_arrays(rest + made, names=[n for n in part.schema.names if n not in names] + names)
        pa.default_memory_pool().release_unused()


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark in blocks of bounded size; the driver holds one block at a time."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null and t is not null").distinct()
    block, size, some = [], 0, False
    for r in rows.toLocalIterator():
        block.append((r.i, r.t))
        size += len(r.t.encode())
        if size >= block_bytes:
            yield block
            block, size, some = [], 0, True
    if block or not some:
        yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with: n_words, hit_spans (word positions, end exclusive), items (sorted ids as text), longest_match.

    Columns of docs with these names are replaced.
    """
    spark = docs.sparkSession
    names = ["n_words", "hit_spans", "items", "longest_match"]
    types = ["bigint", "array<bigint>", "array<string>", "struct<item_id:string,item_start:bigint,doc_start:bigint,n_words:bigint>"]
    out = docs.select(*[c for c in docs.columns if c not in names], F.lit(0).cast("long").alias(names[0]), *[F.lit(None).cast(t).alias(n) for n, t in zip(names[1:], types[1:], strict=True)])
    out = out.withColumn("hit_spans", F.array().cast(types[1])).withColumn("items", F.array().cast(types[2]))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in out.schema.fields])
    for items in _blocks(benchmark, item_col, item_text_col, block_bytes):
        block = spark.sparkContext.broadcast(Block(items, window))
        out = out.mapInArrow(lambda it, block=block: _search_block(it, block, text_col, names), schema)
    return out


def with_verdict(found: DataFrame, share: int = 20) -> DataFrame:
    """Adds n_hit and contaminated: hit words are at least 1 / share of all words."""
    signed = F.transform("hit_spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    out = found.withColumn("n_hit", F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the contaminated rows; the columns stay as they are."""
    packed = docs.select(F.struct(*docs.columns).alias("doc"), F.col(options.get("text_col", "text")).alias("text"))
    judged = with_verdict(find_contamination(packed, benchmark, **(options | {"text_col": "text"})))
    return judged.where(~F.col("contaminated")).select("doc.*")


def op3_suffix_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = with_verdict(find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    ids = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), "contaminated", F.col("longest_match.n_words").alias("longest_match"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[j:j + n - 1], ' ') AS w, j FROM (SELECT item_id, ws, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS j FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS w FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)),
occ AS (SELECT doc_id, i, dw.n, item_id, j FROM dw JOIN bw ON dw.w = bw.w AND dw.n = bw.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY doc_id),
runs AS (SELECT doc_id, item_id, i - j AS diag, i, n, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS g FROM occ),
longest AS (SELECT doc_id, max(m) AS m FROM (SELECT doc_id, max(i) - min(i) + max(n) AS m FROM runs GROUP BY doc_id, item_id, diag, g) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit > 0 AND 20 * n_hit >= len(ws), false) AS contaminated, CAST(m AS BIGINT) AS longest_match
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN its ON d.doc_id = its.doc_id LEFT JOIN longest ON d.doc_id = longest.doc_id
"""

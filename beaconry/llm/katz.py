"""Katz backoff word model: Good-Turing discounted counts with exactly normalised backoff weights.

Texts are tokenised once into a table of packed batches, bucketed by batch so that it is never shuffled again. Counts
are exchanged with tables partitioned by hash: every batch sends its distinct words, then its distinct word pairs, with
their training counts, and gets back the corpus counts in the order in which it asked. A pair's first training batch
adds the mass that its discount frees and its lower-order probability to its history's sums, from which the history's
backoff weight follows. Each token is then evaluated recursively: the pair's discounted estimate if training has seen
it, else the backoff weight times the word's estimate, else the mass kept for unknown words.

Good-Turing takes its counts of counts from a line fitted to their logarithms (each count of counts spread over the gap
to its neighbours), of slope b over the logarithm of the count: a count r becomes r * (1 + 1 / r) ** (b + 1), one rule
for all counts, so that every history keeps mass to back off with. Turing's estimate needs a slope under -1: flatter
ones are taken as MAX_SLOPE, and fewer than two different counts as NO_SLOPE.

The model is three tables of packed hash ranges (words and pairs with their counts, histories with their weights), by
which other texts can be scored. Hot words and pairs are one entry a batch; sums are taken per hash range, so no task
gathers all of a history.

Edge cases: null is the empty text, which is one end token; rows with a null id are scored but never learned from;
without training rows everything is unknown and the score is 0 a token; repeated rows count as often as they appear.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from beaconry.llm.shared import SPLIT_ON_SPACE, Words, chunks, mix64, pack_ints, pack_longs, pack_sorted, shared_dir, shuffle_buckets, slices, stage, unpack_ints, unpack_longs, unpack_sorted

#: The flattest slope that discounts are taken from, and the slope where counts show none.
MAX_SLOPE, NO_SLOPE = -1.05, -2.0
END = np.uint64(0x7F4A7C15F39CC060)
START = np.uint64(0x1B873593CC9E2D51)
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_TRAIN, _NULL = 1, 2

_BATCHES = "batch long, ids binary, flags binary, lengths binary, stream binary, words binary, train binary"


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part in chunks(batch, "text"):
            words = Words(part.column(2), SPLIT_ON_SPACE, lower=True)
            lengths = words.counts + 1
            h = np.full(int(lengths.sum()), END)
            ends = np.cumsum(lengths) - 1
            inner = np.ones(len(h), bool)
            inner[ends] = False
            h[inner] = words.hashes()
            unique, local = np.unique(h, return_inverse=True)
            known = part.column(0).is_valid().to_numpy(zero_copy_only=False)
            train = part.column(1).fill_null(False).to_numpy(zero_copy_only=False) & known
            counts = np.bincount(local[np.repeat(train, lengths)], minlength=len(unique))
            flags = (train * _TRAIN + ~known * _NULL).astype(np.uint8)
            row = (number, pack_longs(part.column(0).fill_null(0).to_numpy(zero_copy_only=False)), flags.tobytes(), pack_ints(lengths), pack_ints(local), pack_sorted(unique), pack_ints(counts))
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int64()] + [pa.binary()] * 6, strict=True)], names=["batch", "ids", "flags", "lengths", "stream", "words", "train"])


class Batch:
    """An unpacked batch: word places, and its distinct pairs of history and word, sorted by hash."""

    def __init__(self, row: dict) -> None:
        self.lengths = unpack_ints(row["lengths"]).astype(np.int64)
        self.flags = np.frombuffer(row["flags"], np.uint8)
        self.stream = unpack_ints(row["stream"]).astype(np.int64)
        self.words = unpack_sorted(row["words"])
        self.train = np.repeat(self.flags & _TRAIN > 0, self.lengths)
        self.begins = np.cumsum(self.lengths) - self.lengths

    def pairs(self) -> None:
        n = len(self.words)
        before = np.r_[0, self.stream[:-1]]
        before[self.begins] = n  # the start of a text
        code, self.pair_of = np.unique(before * (n + 1) + self.stream, return_inverse=True)
        history, word = code // (n + 1), code % (n + 1)
        h = np.r_[self.words, START]
        hashed = mix64(h[history] * _C1 + mix64(h[word] + _C2))
        by = np.argsort(hashed)
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        self.pair_of = place[self.pair_of]
        self.history, self.word, self.pair_hash = history[by], word[by], hashed[by]
        self.pair_train = np.bincount(self.pair_of[self.train], minlength=len(by))

    def counts(self, answers: list[dict]) -> np.ndarray:
        """Corpus counts of the words, and at the last place those of the start (as often as an end)."""
        c = _joined(answers, "counts", unpack_longs).astype(np.float64)
        end = np.searchsorted(self.words, END)
        return np.r_[c, c[end]]


def _joined(answers: list[dict], column: str, unpack) -> np.ndarray:
    """The answers of all hash ranges in the order of the hashes asked for."""
    return np.concatenate([unpack(a[column]) for a in sorted(answers, key=lambda a: a["bucket"])])


def _ask(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Distinct words of each batch, by hash range."""
    for batch in batches:
        for row in batch.to_pylist():
            words, train = unpack_sorted(row["words"]), unpack_ints(row["train"])
            yield _sent([(b, row["batch"], pack_sorted(words[x:y]), pack_ints(train[x:y])) for b, x, y in slices(words, buckets)])


def _ask_pairs(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            b = Batch(row)
            b.pairs()
            yield _sent([(k, row["batch"], pack_sorted(b.pair_hash[x:y]), pack_ints(b.pair_train[x:y])) for k, x, y in slices(b.pair_hash, buckets)])


_ASKED = "bucket int, batch long, hashes binary, train binary"


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32(), pa.int64(), pa.binary(), pa.binary()], strict=True)], names=["bucket", "batch", "hashes", "train"])


_ANSWERED = "batch long, bucket int, counts binary, owned binary, hashes binary, sizes array<long>, types array<long>"


def _count(table: pa.Table) -> pa.Table:
    """Corpus counts for each batch's hashes, and which of them it is the first to train on; last the range's table.

    The table's row has no batch: its hashes with their counts, and how many have each count.
    """
    rows = sorted(table.to_pylist(), key=lambda r: r["batch"])
    hashes = [unpack_sorted(r["hashes"]) for r in rows]
    train = np.concatenate([unpack_ints(r["train"]) for r in rows]).astype(np.int64)
    sizes = np.array([len(h) for h in hashes])
    h = np.concatenate(hashes)
    by = np.argsort(h, kind="stable")
    new = np.r_[True, h[by[1:]] != h[by[:-1]]]
    group = np.cumsum(new) - 1
    total = np.add.reduceat(train[by], np.flatnonzero(new))
    count = np.empty(len(h), np.int64)
    count[by] = total[group]
    # In each group the first entry with a training count owns it.
    seen = np.flatnonzero(train[by] > 0)
    owner = np.zeros(len(h), bool)
    if len(seen):
        owner[by[seen[np.r_[True, group[seen[1:]] != group[seen[:-1]]]]]] = True
    ends = np.cumsum(sizes)
    known = total > 0
    r, n = np.unique(total[known], return_counts=True)
    k = len(rows)
    return pa.table({
        "batch": pa.array([*(r["batch"] for r in rows), None], pa.int64()),
        "bucket": pa.array([*(r["bucket"] for r in rows), rows[0]["bucket"]], pa.int32()),
        "counts": pa.array([*(pack_longs(count[e - s : e]) for s, e in zip(sizes, ends, strict=True)), pack_longs(total[known])], pa.binary()),
        "owned": pa.array([*(pack_ints(owner[e - s : e]) for s, e in zip(sizes, ends, strict=True)), None], pa.binary()),
        "hashes": pa.array([None] * k + [pack_sorted(h[by[new]][known])], pa.binary()),
        "sizes": pa.array([None] * k + [r.tolist()], pa.list_(pa.int64())),
        "types": pa.array([None] * k + [n.tolist()], pa.list_(pa.int64())),
    })


@dataclass(frozen=True)
class Discounts:
    """Good-Turing discounts of one order: the fitted slope, how many types and tokens there are, and the mass of unseen ones."""

    slope: float
    types: int
    tokens: int
    unseen: float

    def freed(self, c: np.ndarray) -> np.ndarray:
        """What the counts lose: c - c * (1 + 1 / c) ** (slope + 1)."""
        c = np.maximum(c, 1)
        return -c * np.expm1((self.slope + 1) * np.log1p(1 / c))

    def of(self, c: np.ndarray) -> np.ndarray:
        """The counts, discounted; 0 stays 0."""
        return np.where(c > 0, c - self.freed(c), 0.0)


def _discounts(answers: DataFrame) -> Discounts:
    """Fitted over all counts of counts; nothing but the sums of the fit reaches the driver."""
    held = answers.where("batch IS NULL").select(F.explode(F.arrays_zip("sizes", "types")).alias("x")).groupBy(F.col("x.sizes").alias("r")).agg(F.sum("x.types").alias("n"))
    by = Window.orderBy("r")  # different counts are few: about the root of twice the tokens at most
    before, after = F.lag("r", 1, 0).over(by), F.lead("r").over(by)
    near = held.select("r", "n", (F.coalesce(after, 2 * F.col("r") - before) - before).alias("gap"))
    fit = near.select("r", "n", F.log(2.0 * F.col("n") / F.col("gap")).alias("y"), F.log(F.col("r").cast("double")).alias("x"))
    sums = fit.agg(F.regr_slope("y", "x").alias("slope"), F.count("r").alias("k"), F.coalesce(F.sum("n"), F.lit(0)).alias("types"), F.coalesce(F.sum(F.col("r") * F.col("n")), F.lit(0)).alias("tokens"))
    s = sums.first()
    slope = NO_SLOPE if s.k < 2 or s.slope is None else min(float(s.slope), MAX_SLOPE)
    if not s.tokens:
        return Discounts(slope, 0, 0, 1.0)
    lost = -F.col("n") * F.col("r") * F.expm1((slope + 1) * F.log1p(1 / F.col("r")))
    return Discounts(slope, int(s.types), int(s.tokens), float(held.agg(F.sum(lost)).first()[0]) / s.tokens)


def _estimates(b: Batch, row: dict, one: Discounts, two: Discounts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word counts, word estimates, pair counts and discounted pair estimates of a batch."""
    c1 = b.counts(row["words_back"])
    p1 = np.where(c1 > 0, one.of(c1) / max(one.tokens, 1), one.unseen)
    c2 = _joined(row["pairs_back"], "counts", unpack_longs).astype(np.float64)
    return c1, p1, c2, two.of(c2) / np.maximum(c1[b.history], 1)


_WANTED = "bucket int, batch long, hashes binary, left binary, lower binary, want binary"


def _ask_weights(batches: Iterator[pa.RecordBatch], one: Discounts, two: Discounts, buckets: int, learn: bool) -> Iterator[pa.RecordBatch]:
    """The histories that each batch has to back off from and, to learn, the sums of the pairs that it owns by history."""
    for batch in batches:
        for row in batch.to_pylist():
            b = Batch(row)
            b.pairs()
            c1, p1, c2, _ = _estimates(b, row, one, two)
            n = len(b.words) + 1
            owned = _joined(row["pairs_back"], "owned", unpack_ints) > 0 if learn else np.zeros(len(c2), bool)
            left = np.bincount(b.history[owned], two.freed(c2[owned]) / c1[b.history[owned]], n)
            lower = np.bincount(b.history[owned], p1[b.word[owned]], n)
            want = np.zeros(n, bool)
            want[b.history[c2 == 0]] = True
            used = np.flatnonzero((lower > 0) | want)
            h = np.r_[b.words, START][used]
            by = np.argsort(h)
            used, h = used[by], h[by]
            out = [(k, row["batch"], pack_sorted(h[x:y]), left[used[x:y]].tobytes(), lower[used[x:y]].tobytes(), pack_ints(want[used[x:y]])) for k, x, y in slices(h, buckets)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32(), pa.int64()] + [pa.binary()] * 4, strict=True)], names=["bucket", "batch", "hashes", "left", "lower", "want"])


_WEIGHED = "batch long, bucket int, hashes binary, weights binary"


def _weighed(rows: list[tuple]) -> pa.Table:
    return pa.table({n: pa.array(c, t) for n, c, t in zip(["batch", "bucket", "hashes", "weights"], zip(*rows, strict=True), [pa.int64(), pa.int32(), pa.binary(), pa.binary()], strict=True)})


def _weigh(table: pa.Table) -> pa.Table:
    """Backoff weights: what a history's discounts free, over what its seen words leave below. Last the range's table."""
    rows = sorted(table.to_pylist(), key=lambda r: r["batch"])
    hashes = [unpack_sorted(r["hashes"]) for r in rows]
    every, group = np.unique(np.concatenate(hashes), return_inverse=True)
    left, lower = (np.bincount(group, np.concatenate([np.frombuffer(r[k], np.float64) for r in rows])) for k in ("left", "lower"))
    learned = lower > 0  # a history that training has not seen leaves all to the words
    weights = np.where(learned, left / np.maximum(1 - lower, 1e-300), 1.0)
    out, at = [], 0
    for r, h in zip(rows, hashes, strict=True):
        want = unpack_ints(r["want"]) > 0
        out.append((r["batch"], r["bucket"], h[want].tobytes(), weights[group[at : at + len(h)]][want].tobytes()))
        at += len(h)
    return _weighed([*out, (None, rows[0]["bucket"], every[learned].tobytes(), weights[learned].tobytes())])


def _looked_up(asked: pa.Table, held: pa.Table) -> pa.Table:
    """Counts of each batch's hashes in the range's table; 0 for others."""
    known = [(unpack_sorted(r["hashes"]), unpack_longs(r["counts"])) for r in held.to_pylist()]
    h, c = (np.concatenate(x) for x in zip(*known, strict=True)) if known else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    out = []
    for r in asked.to_pylist():
        want = unpack_sorted(r["hashes"])
        at = np.minimum(np.searchsorted(h, want), max(len(h) - 1, 0))
        out.append((r["batch"], r["bucket"], pack_longs(np.where(h[at] == want, c[at], 0) if len(h) else np.zeros(len(want), np.int64))))
    return pa.table({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate((("batch", pa.int64()), ("bucket", pa.int32()), ("counts", pa.binary())))})


def _weights_of(asked: pa.Table, held: pa.Table) -> pa.Table:
    """Weights of the histories that each batch asks for, where training has seen them."""
    known = [(np.frombuffer(r["hashes"], np.uint64), np.frombuffer(r["weights"], np.float64)) for r in held.to_pylist()]
    h, w = (np.concatenate(x) for x in zip(*known, strict=True)) if known else (np.zeros(0, np.uint64), np.zeros(0))
    out = []
    for r in asked.to_pylist():
        want = unpack_sorted(r["hashes"])
        there = np.isin(want, h)
        out.append((r["batch"], r["bucket"], want[there].tobytes(), w[np.searchsorted(h, want[there])].tobytes()))
    return _weighed(out) if out else _weighed([(None, 0, b"", b"")]).slice(0, 0)


def _score(batches: Iterator[pa.RecordBatch], one: Discounts, two: Discounts) -> Iterator[pa.RecordBatch]:
    floor = np.log10(one.tokens + 0.1 * (one.types + 1))
    for batch in batches:
        for row in batch.to_pylist():
            b = Batch(row)
            b.pairs()
            c1, p1, c2, p2 = _estimates(b, row, one, two)
            weight = np.ones(len(b.words) + 1)
            if row["weights_back"]:
                h, w = (np.concatenate([np.frombuffer(a[k], t) for a in row["weights_back"]]) for k, t in (("hashes", np.uint64), ("weights", np.float64)))
                by = np.argsort(h)
                all_h = np.r_[b.words, START]
                at = np.minimum(np.searchsorted(h[by], all_h), len(h) - 1) if len(h) else None
                if at is not None:
                    weight = np.where(h[by][at] == all_h, w[by][at], 1.0)
            pair = np.log10(np.where(c2 > 0, p2, weight[b.history] * p1[b.word]))
            tokens = c1[b.stream]
            base = np.add.reduceat(np.log10(tokens + 0.1) - floor, b.begins)
            ids = pa.array(unpack_longs(row["ids"]), pa.int64(), mask=b.flags & _NULL > 0)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(b.lengths, pa.int64()), pa.array(np.add.reduceat((tokens > 0).astype(np.int64), b.begins), pa.int64()), pa.array(base, pa.float64()), pa.array(np.add.reduceat(pair[b.pair_of], b.begins), pa.float64())],
                names=["id", "n_tokens", "n_known", "base_score", "score"],
            )


_SCORED = "id long, n_tokens long, n_known long, base_score double, score double"


def _per_batch(answers: DataFrame, columns: list[str], name: str) -> DataFrame:
    return answers.where("batch IS NOT NULL").groupBy("batch").agg(F.collect_list(F.struct("bucket", *columns)).alias(name))


class _Batches:
    """Texts as a table of packed batches, for as long as it is used."""

    def __init__(self, docs: DataFrame, train: Column, id_col: str, text_col: str) -> None:
        self.spark = spark = docs.sparkSession
        texts = docs.select(F.col(id_col).cast("long").alias("id"), train.cast("boolean").alias("train"), F.col(text_col).cast("string").alias("text"))
        self.table = f"beaconry_batches_{uuid.uuid4().hex}"
        writer = texts.mapInArrow(_encode, _BATCHES).write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "batch")
        writer.option("path", f"{shared_dir(spark)}/beaconry/{self.table}").saveAsTable(self.table)

    def __enter__(self) -> DataFrame:
        return self.spark.table(self.table)

    def __exit__(self, *_) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def _words(batches: DataFrame, buckets: int) -> DataFrame:
    return batches.select("batch", "words", "train").mapInArrow(lambda it: _ask(it, buckets), _ASKED)


def _pairs(batches: DataFrame, buckets: int) -> DataFrame:
    return batches.mapInArrow(lambda it: _ask_pairs(it, buckets), _ASKED)


def _scores(known: DataFrame, weights: DataFrame, one: Discounts, two: Discounts) -> DataFrame:
    final = known.join(_per_batch(weights, ["hashes", "weights"], "weights_back"), "batch", "left")
    scored = final.mapInArrow(lambda it: _score(it, one, two), _SCORED)
    return scored.withColumn("train_tokens", F.lit(one.tokens).cast("long"))


@dataclass(frozen=True)
class KatzModel:
    """Tables by hash range (bucket): words and pairs (hashes, counts), histories (hashes, weights); and both orders' discounts."""

    buckets: int
    words: DataFrame
    pairs: DataFrame
    weights: DataFrame
    one: Discounts
    two: Discounts

    def save(self, path: str) -> None:
        """Writes the model; its tables are partitioned by ranges of the hash."""
        for name in ("words", "pairs", "weights"):
            getattr(self, name).withColumn("part", (F.col("bucket") % 64).cast("int")).write.partitionBy("part").parquet(f"{path}/{name}")
        rows = [(n, d.slope, d.types, d.tokens, d.unseen, self.buckets) for n, d in ((1, self.one), (2, self.two))]
        self.words.sparkSession.createDataFrame(rows, "n int, slope double, types long, tokens long, unseen double, buckets int").write.parquet(f"{path}/discounts")

    @staticmethod
    def load(spark: SparkSession, path: str) -> KatzModel:
        rows = sorted(spark.read.parquet(f"{path}/discounts").collect())
        one, two = (Discounts(r.slope, r.types, r.tokens, r.unseen) for r in rows)
        return KatzModel(rows[0].buckets, *(spark.read.parquet(f"{path}/{n}") for n in ("words", "pairs", "weights")), one, two)

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """As score_documents, for texts that the model has not learned from."""
        with _Batches(docs, F.lit(False), id_col, text_col) as batches:
            back = []
            for asked, table in ((_words(batches, self.buckets), self.words), (_pairs(batches, self.buckets), self.pairs)):
                found = asked.groupBy("bucket").cogroup(table.groupBy("bucket")).applyInArrow(_looked_up, "batch long, bucket int, counts binary")
                back.append(stage(found, "lm_counts"))
            known = batches.join(_per_batch(back[0], ["counts"], "words_back"), "batch").join(_per_batch(back[1], ["counts"], "pairs_back"), "batch")
            one, two, buckets = self.one, self.two, self.buckets
            asked = known.mapInArrow(lambda it: _ask_weights(it, one, two, buckets, False), _WANTED)
            weights = stage(asked.groupBy("bucket").cogroup(self.weights.groupBy("bucket")).applyInArrow(_weights_of, _WEIGHED), "lm_weights")
            return stage(_scores(known, weights, one, two), "lm_scores")


def learn_and_score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple[KatzModel, DataFrame]:
    """The model of the rows where train holds, and (id, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Scores are log10 probabilities of whole texts, each closed by an end token.
    """
    buckets = shuffle_buckets(docs.sparkSession, 2)
    with _Batches(docs, train, id_col, text_col) as batches:
        words = stage(_words(batches, buckets).groupBy("bucket").applyInArrow(_count, _ANSWERED), "lm_words")
        pairs = stage(_pairs(batches, buckets).groupBy("bucket").applyInArrow(_count, _ANSWERED), "lm_pairs")
        one, two = _discounts(words), _discounts(pairs)
        known = batches.join(_per_batch(words, ["counts"], "words_back"), "batch").join(_per_batch(pairs, ["counts", "owned"], "pairs_back"), "batch")
        asked = known.mapInArrow(lambda it: _ask_weights(it, one, two, buckets, True), _WANTED)
        weights = stage(asked.groupBy("bucket").applyInArrow(_weigh, _WEIGHED), "lm_weights")
        scored = stage(_scores(known, weights, one, two), "lm_scores")
    tables = [t.where("batch IS NULL").select("bucket", "hashes", c) for t, c in ((words, "counts"), (pairs, "counts"), (weights, "weights"))]
    return KatzModel(buckets, *tables, one, two), scored


def score_documents(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The scores of learn_and_score."""
    return learn_and_score(docs, train, id_col, text_col)[1]


def op2_katz_backoff(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    out = score_documents(docs, fold != 0).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


_CRC_BITS = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: list_transform(range(0, 8), lambda i: (CAST(ascii(ch) AS BIGINT) >> i) & 1)))"
_FIT = "SELECT CASE WHEN count(*) < 2 THEN -2.0 ELSE least(regr_slope(ln(2.0 * n / (coalesce(t, 2 * r - q) - q)), ln(r)), -1.05) END + 1 AS b FROM (SELECT r, n, lag(r, 1, 0) OVER (ORDER BY r) AS q, lead(r) OVER (ORDER BY r) AS t FROM (SELECT c AS r, count(*) AS n FROM {0} GROUP BY c))"
ORACLE = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {_CRC_BITS}), lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) % 10, -1) AS fold,
  list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-]+'), ' ') AS ws FROM documents),
t AS (SELECT rid, fold > 0 AS train, unnest(ws) AS w, unnest(list_prepend('', ws[:-2])) AS h FROM d),
c1 AS (SELECT w, count(*) AS c FROM t WHERE train GROUP BY w),
c2 AS (SELECT h, w, count(*) AS c FROM t WHERE train GROUP BY h, w),
s AS (SELECT (SELECT b FROM ({_FIT.format("c1")})) AS b1, (SELECT b FROM ({_FIT.format("c2")})) AS b2, coalesce((SELECT CAST(sum(c) AS BIGINT) FROM c1), 0) AS n, (SELECT count(*) FROM c1) AS v),
p1 AS (SELECT w, c, c * pow(1 + 1.0 / c, b1) / n AS p FROM c1, s),
u AS (SELECT 1 - coalesce(sum(p), 0) AS p FROM p1),
hc AS (SELECT w AS h, c FROM c1 UNION ALL SELECT '', c FROM c1 WHERE w = ' '),
p2 AS (SELECT c2.h, c2.w, c2.c * pow(1 + 1.0 / c2.c, b2) / hc.c AS p, (c2.c - c2.c * pow(1 + 1.0 / c2.c, b2)) / hc.c AS f FROM c2 JOIN hc ON hc.h = c2.h, s),
a AS (SELECT p2.h, sum(p2.f) / (1 - sum(p1.p)) AS a FROM p2 JOIN p1 ON p1.w = p2.w GROUP BY p2.h),
x AS (SELECT rid, count(*) AS n_tokens, count(p1.c) AS n_known, sum(log10((coalesce(p1.c, 0) + 0.1) / (n + 0.1 * (v + 1)))) AS base_score, sum(log10(coalesce(p2.p, coalesce(a.a, 1) * coalesce(p1.p, u.p)))) AS score
  FROM t CROSS JOIN s CROSS JOIN u LEFT JOIN p1 ON p1.w = t.w LEFT JOIN p2 ON p2.h = t.h AND p2.w = t.w LEFT JOIN a ON a.h = t.h GROUP BY rid)
SELECT doc_id, fold = 0 AS held_out, n_tokens, n_known, n AS train_tokens, base_score, score FROM d JOIN x USING (rid), s
"""

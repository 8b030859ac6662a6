"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages and only the document has a label. Every passage is encoded (hashed byte n-grams and a few
shape measures, then a learned layer); gated attention gives each passage of a document a weight, from its encoding alone;
the weighted mean of the encodings is the document's representation, and a logistic layer scores it. Encoder, attention
and classifier are learned together, from document labels only, on a bounded and documented sample of the labelled rows;
every row is then encoded whole and scored in Spark.

Edge cases: a null or wordless text is one passage of nothing and gets that passage's score; rows with a null label or id
are never learned from; an id with several labels gives one example for each, a repeated document likewise; without
labelled rows every score is 0.5; a text of any length is scored whole, its passages encoded a bounded number at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.llm.language import fold
from beaconry.llm.shared import SMALL_CHUNK, SPLIT_ON_SPACE, Words, chunks, mix64

#: Bounds of the fitting sample: labelled ids, bytes of a text in it, and passages in all.
FIT_ROWS, FIT_BYTES, FIT_PASSAGES = 3_000, 256 << 10, 60_000
#: Words of a passage, buckets of its n-grams, sizes of the encoding and of the attention layer.
PASSAGE_WORDS, BUCKETS, ENCODING, ATTENTION = 48, 512, 24, 12
#: Passages that are encoded at a time.
PASSAGE_BLOCK = 4_096
_SHAPES = 8
_CLASS = np.zeros(256, np.int64)
_CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x30:0x3A], _CLASS[0x80:] = 1, 2, 3, 4
for _c in range(0x21, 0x7F):
    if not chr(_c).isalnum():
        _CLASS[_c] = 5


class Passages:
    """The passages of a chunk of texts: which text each is of, and their features."""

    def __init__(self, text: pa.Array) -> None:
        self.words = w = Words(text, SPLIT_ON_SPACE, lower=False)
        per = np.maximum(-(-w.counts // PASSAGE_WORDS), 1)
        self.row = np.repeat(np.arange(len(per)), per)
        nth = np.arange(len(self.row)) - np.repeat(np.cumsum(per) - per, per)
        self.first = np.minimum(w.first[:-1][self.row] + nth * PASSAGE_WORDS, w.first[1:][self.row])
        self.last = np.minimum(self.first + PASSAGE_WORDS, w.first[1:][self.row])
        self.hashes = w.hashes()

    def __len__(self) -> int:
        return len(self.row)

    def counts(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Of passages a to b: n-gram counts (at most 255) by bucket, and shape measures from 0 to 1."""
        w, n = self.words, b - a
        first, last = self.first[a:b], self.last[a:b]
        size = last - first
        grams, shapes = np.zeros((n, BUCKETS), np.uint8), np.zeros((n, _SHAPES), np.float32)
        total = int(size.sum())
        if not total:
            return grams, shapes
        passage = np.repeat(np.arange(n), size)
        word = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(total)
        starts, lens = w.starts[word], w.ends[word] - w.starts[word]
        # The passage's bytes, words parted by one space.
        spaced = lens + 1
        at = np.cumsum(spaced) - spaced
        place = np.repeat(starts - at, spaced) + np.arange(int(spaced.sum()))
        owner = np.repeat(passage, spaced)
        letters = w.raw[np.minimum(place, len(w.raw) - 1)].copy()
        letters[at + lens] = 0x20
        codes = letters.astype(np.uint64)
        tally = np.zeros(n * BUCKETS, np.int64)
        for k in (1, 2, 3):
            h = np.full(len(codes) - k + 1, k, np.uint64)
            for j in range(k):
                h = h * np.uint64(1_000_003) + codes[j : len(codes) - k + 1 + j]
            same = owner[: len(h)] == owner[k - 1 :]
            bucket = (mix64(h) % np.uint64(BUCKETS)).astype(np.int64)
            tally += np.bincount((owner[: len(h)] * BUCKETS + bucket)[same], minlength=n * BUCKETS)
        grams = np.minimum(tally, 255).astype(np.uint8).reshape(n, BUCKETS)
        kinds = np.bincount(owner * 6 + _CLASS[letters], minlength=n * 6).reshape(n, 6)
        length = np.maximum(kinds.sum(axis=1) - size, 1)
        shapes[:, :5] = kinds[:, 1:] / length[:, None]
        by = np.lexsort((self.hashes[word], passage))
        fresh = np.r_[True, (np.diff(self.hashes[word][by].view(np.int64)) != 0) | (np.diff(passage[by]) != 0)]
        shapes[:, 5] = np.bincount(passage[by][fresh], minlength=n) / np.maximum(size, 1)
        shapes[:, 6] = np.minimum(length / np.maximum(size, 1), 20) / 20
        shapes[:, 7] = size / PASSAGE_WORDS
        return grams, shapes


def features(grams: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """Square roots of the n-grams' shares, and the shape measures."""
    x = np.sqrt(grams.astype(np.float32))
    norm = np.sqrt((x**2).sum(axis=1, keepdims=True))
    return np.hstack([4 * x / np.maximum(norm, 1e-6), 2 * shapes])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class GatedAttention:
    """Encoder, gated attention and classifier; W: encoder, V and U: attention and its gate, w: its scale, c: classifier."""

    def __init__(self, seed: int = 7) -> None:
        r = np.random.RandomState(seed)
        wide = BUCKETS + _SHAPES
        scale = lambda *shape: (r.randn(*shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"W": scale(wide, ENCODING), "Wb": np.zeros(ENCODING, np.float32), "V": scale(ENCODING, ATTENTION), "U": scale(ENCODING, ATTENTION), "w": scale(ATTENTION), "c": scale(ENCODING), "cb": np.zeros(1, np.float32)}

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encodings of passages, and their attention before it is made to sum to one within a document."""
        h = np.tanh(x @ self.p["W"] + self.p["Wb"])
        return h, (np.tanh(h @ self.p["V"]) * _sigmoid(h @ self.p["U"])) @ self.p["w"]

    def document(self, h: np.ndarray, e: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Attention weights, representations and scores of documents whose passages begin at heads."""
        n = np.diff(np.r_[heads, len(e)])
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, heads), n))
        a /= np.repeat(np.add.reduceat(a, heads), n)
        z = np.add.reduceat(a[:, None] * h, heads, axis=0)
        return a, z, _sigmoid(z @ self.p["c"] + self.p["cb"])

    def gradients(self, x: np.ndarray, heads: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss."""
        p, n = self.p, np.diff(np.r_[heads, len(x)])
        h = np.tanh(x @ p["W"] + p["Wb"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        a, z, score = self.document(h, (t * s) @ p["w"], heads)
        err = ((score - y) / len(y)).astype(np.float32)
        dz = np.repeat(err[:, None] * p["c"], n, axis=0)
        da = (h * dz).sum(axis=1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, heads), n))
        dt, ds = de[:, None] * p["w"] * s * (1 - t * t), de[:, None] * p["w"] * t * s * (1 - s)
        dh = (a[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "Wb": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": z.T @ err, "cb": err.sum(keepdims=True)}

    def fit(self, grams: np.ndarray, shapes: np.ndarray, counts: np.ndarray, y: np.ndarray, epochs: int = 12, steps: int = 1000, batch: int = 64, rate: float = 0.01, decay: float = 3e-4) -> None:
        """Adam over documents in an order that the seed fixes, for so many epochs and steps at least."""
        epochs = max(epochs, -(-steps * batch // len(y)))
        r = np.random.RandomState(11)
        heads = np.cumsum(counts) - counts
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        step = 0
        for epoch in range(epochs):
            order = r.permutation(len(y))
            for at in range(0, len(order), batch):
                docs = order[at : at + batch]
                take = np.concatenate([np.arange(heads[d], heads[d] + counts[d]) for d in docs])
                own = np.cumsum(counts[docs]) - counts[docs]
                step += 1
                pace = rate * (1 - epoch / epochs)
                for k, g in self.gradients(features(grams[take], shapes[take]), own, y[docs]).items():
                    g = g + decay * self.p[k] if k in ("W", "c") else g
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def _sample_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, place, text): a row a document with its passages' counts."""
    for batch in batches:
        for part in chunks(batch, "text", SMALL_CHUNK):
            passages = Passages(part.column(2))
            grams, shapes = zip(*(passages.counts(a, min(a + PASSAGE_BLOCK, len(passages))) for a in range(0, len(passages), PASSAGE_BLOCK)), strict=True)
            grams, shapes = np.concatenate(grams), np.concatenate(shapes)
            ends = np.searchsorted(passages.row, np.arange(part.num_rows + 1))
            packed = lambda m: pa.array([m[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), packed(grams), packed(shapes), pa.array(np.diff(ends), pa.int64())], names=["label", "place", "grams", "shapes", "passages"])
        pa.default_memory_pool().release_unused()


def _score_batches(batches: Iterator[pa.RecordBatch], model, place: int) -> Iterator[pa.RecordBatch]:
    """batches: struct doc, of which the field at `place` is the text."""
    net: GatedAttention | None = model.value
    for batch in batches:
        texts = batch.column(0).field(place).cast(pa.string())
        for part in chunks(pa.RecordBatch.from_arrays([batch.column(0), texts], names=["doc", "text"]), "text", SMALL_CHUNK):
            passages = Passages(part.column(1))
            heads = np.searchsorted(passages.row, np.arange(part.num_rows))
            n = np.diff(np.r_[heads, len(passages)])
            score, peak = np.full(part.num_rows, 0.5), np.zeros(part.num_rows)
            if net is not None:
                blocks = [net.encode(features(*passages.counts(a, min(a + PASSAGE_BLOCK, len(passages))))) for a in range(0, len(passages), PASSAGE_BLOCK)]
                weights, _, score = net.document(np.concatenate([h for h, _ in blocks]), np.concatenate([e for _, e in blocks]), heads)
                peak = np.maximum.reduceat(weights, heads)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score.astype(np.float64)), pa.array(n, pa.int64()), pa.array(peak.astype(np.float64))], names=["doc", "score", "n_passages", "top_weight"])
        pa.default_memory_pool().release_unused()


class QualityClassifier:
    """Fitted on a bounded sample of labelled rows: labelled has one 0 or 1 an id, docs the texts of those ids."""

    def __init__(self, docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> None:
        spark = docs.sparkSession
        place = F.xxhash64(F.col("id").cast("string"), F.lit("quality"))
        ids = labelled.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
        # At most fit_rows rows are sent to all tasks.
        some = F.broadcast(ids.withColumn("place", place).orderBy("place", "id", "label").limit(fit_rows))
        texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        sample = texts.join(some, "id").where(F.octet_length("text") <= FIT_BYTES).select("label", "place", "text")
        coded = sample.mapInArrow(_sample_batches, "label int, place long, grams binary, shapes binary, passages long")
        # The first documents in the order of the sample, up to FIT_PASSAGES passages; every document has one at least.
        rows = coded.orderBy("place", "label", "grams").limit(min(fit_rows, FIT_PASSAGES)).toArrow()
        counts = rows["passages"].to_numpy().astype(np.int64)
        kept = int(np.searchsorted(np.cumsum(counts), FIT_PASSAGES, side="right"))
        self.model = None
        if kept:
            grams = np.frombuffer(b"".join(rows["grams"].slice(0, kept).to_pylist()), np.uint8).reshape(-1, BUCKETS)
            shapes = np.frombuffer(b"".join(rows["shapes"].slice(0, kept).to_pylist()), np.float32).reshape(-1, _SHAPES)
            self.model = GatedAttention()
            self.model.fit(grams, shapes, counts[:kept], rows["label"].to_numpy()[:kept].astype(np.float32))
        self._sent = spark.sparkContext.broadcast(self.model)

    def predict(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """docs as one struct column doc, with score (0 to 1), n_passages and top_weight (of the passage that counts most)."""
        packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"))
        place, sent = docs.columns.index(text_col), self._sent
        return packed.mapInArrow(lambda it: _score_batches(it, sent, place), f"doc {packed.schema['doc'].dataType.simpleString()}, score double, n_passages bigint, top_weight double")


def op12_attention_mil(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.coalesce(fold() != 2, F.lit(False)))
    held = F.coalesce(fold() == 2, F.lit(False))
    out = QualityClassifier(docs, labels).predict(docs.select("doc_id", held.alias("held_out"), "text"))
    return out.select("doc.doc_id", "doc.held_out", "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "n_passages", "top_weight")

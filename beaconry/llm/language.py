"""Language identification with interpolated Kneser-Ney character models.

Each language has a model over runs of letters (lower case, everything else is one space), fitted on a bounded sample of
its labelled rows. A model is kept as sorted arrays of n-gram hashes with their discounted probabilities and context
weights, and is evaluated recursively from the longest n-gram down to a uniform floor. A text gets the language with the
lowest cross-entropy per character. Texts whose cross-entropy lies beyond what held-back labelled rows of that language
reach are marked as rejected.

Edge cases: a null text, and one without letters, is `und` with score 0 and rejected; rows with a null label or id are
never learned from; without labelled rows everything is `und`; repeated rows are judged one by one.
"""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.llm.shared import SMALL_CHUNK, chunks, mix64, text_bytes

#: Rows a language's model is fitted on, on average (the documented bound of the sample), and rows to calibrate it.
FIT_ROWS, CALIBRATION_ROWS = 600, 300
ORDER = 4
UNKNOWN = "und"
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_CACHE_BITS = 20
_letter: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _letter:
        _letter.append(np.frombuffer(bytes(unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), dtype=np.uint8).astype(bool))
    return _letter[0]


def characters(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts with ORDER - 1 spaces before each, the places of their characters' ends, and letter counts."""
    lowered = pa.compute.utf8_lower(text.cast(pa.large_string()).fill_null(""))
    raw, offsets = text_bytes(lowered)
    starts = (raw & 0xC0) != 0x80
    size = np.diff(np.r_[0, np.cumsum(starts)][offsets])
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    if len(points) != size.sum():  # bytes that are no UTF-8
        texts = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        size = np.array([len(t) for t in texts])
        points = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
    is_letter = _letters()[points]
    row = np.repeat(np.arange(len(size)), size)
    first = np.zeros(len(points), bool)
    at = np.r_[0, np.cumsum(size)[:-1]]
    first[at[size > 0]] = True
    keep = is_letter | (np.r_[False, is_letter[:-1]] & ~first)
    points, row = np.where(is_letter, points, 32)[keep], row[keep]
    count = np.bincount(row, minlength=len(size))
    pad = ORDER - 1
    out = np.full(len(points) + pad * len(size), 32, np.uint32)
    place = np.arange(len(points)) + pad * (row + 1)
    out[place] = points
    letters = np.bincount(row, weights=points != 32, minlength=len(size)).astype(np.int64)
    return out, np.r_[0, np.cumsum(count + pad)], letters


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(columns[0]), len(columns), np.uint64)
    for c in columns:
        h = mix64(h * _BASE + c.astype(np.uint64))
    return h


def gram_counts(texts: list[str]) -> Counter:
    """The n-grams that end at a character of a text; none spans two texts."""
    points, ends, _ = characters(pa.array(texts, pa.string()))
    t = points.astype("<u4").tobytes().decode("utf-32-le")
    return Counter(t[i : i + ORDER] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True) for i in range(a, b - ORDER + 1))


class Model:
    """One language: sorted hashes of n-grams with their discounted probability, and of contexts with their weight."""

    def __init__(self, counts: dict[str, int]) -> None:
        levels: list[dict[str, int]] = [dict(counts)]
        for _ in range(ORDER - 1):  # continuation counts: how many different characters stand before
            lower: dict[str, int] = defaultdict(int)
            for g in levels[-1]:
                lower[g[1:]] += 1
            levels.append(lower)
        self.floor = 1.0 / (len(levels[-1]) + 1)
        self.grams, self.contexts = [], []
        for level in reversed(levels):  # unigrams first
            once, twice = sum(c == 1 for c in level.values()), sum(c == 2 for c in level.values())
            discount = once / (once + 2 * twice) if once and twice else 0.5
            total: dict[str, int] = defaultdict(int)
            kinds: dict[str, int] = defaultdict(int)
            for g, c in level.items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            self.grams.append(self._table({g: (c - discount) / total[g[:-1]] for g, c in level.items()}))
            self.contexts.append(self._table({h: discount * kinds[h] / total[h] for h in total}))

    @staticmethod
    def _table(values: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
        names = list(values)
        width = len(names[0]) if names else 1
        points = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32).reshape(-1, width) if width else np.zeros((1, 0), np.uint32)
        h = _hash(list(points.T)) if width else np.zeros(1, np.uint64)
        by = np.argsort(h)
        return h[by], np.array([values[n] for n in names])[by]

    @staticmethod
    def _look(table: tuple[np.ndarray, np.ndarray], h: np.ndarray, absent: float) -> np.ndarray:
        at = np.minimum(np.searchsorted(table[0], h), len(table[0]) - 1)
        return np.where(table[0][at] == h, table[1][at], absent)

    def log_probability(self, columns: list[np.ndarray]) -> np.ndarray:
        """Natural log of each last character's probability after the ones before it."""
        p = np.full(len(columns[0]), self.floor)
        for k in range(1, ORDER + 1):
            used = columns[ORDER - k :]
            weight = self._look(self.contexts[k - 1], _hash(used[:-1]) if k > 1 else np.zeros(len(p), np.uint64), 1.0)
            p = self._look(self.grams[k - 1], _hash(used), 0.0) + weight * p
        return np.log(p)


class Scorer:
    """All languages' models, with a direct-mapped cache of n-grams seen in this task."""

    def __init__(self, models: dict[str, Model]) -> None:
        self.names = sorted(models)
        self.models = [models[n] for n in self.names]
        self.keys = np.zeros(1 << _CACHE_BITS, np.uint64)
        self.values = np.zeros((len(models), 1 << _CACHE_BITS))

    def entropies(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy per character (rows x languages), characters, and letters of each text."""
        points, ends, letters = characters(text)
        n = np.diff(ends) - (ORDER - 1)
        out = np.zeros((len(n), len(self.models)))
        if len(points) < ORDER or not self.models:
            return out, n, letters
        columns = [points[i : len(points) - ORDER + 1 + i] for i in range(ORDER)]
        place = np.repeat(ends[:-1] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        columns = [c[place] for c in columns]
        code = columns[0].astype(np.uint64)
        for c in columns[1:]:
            code = code * _BASE + c.astype(np.uint64)
        code = mix64(code) | np.uint64(1)
        slot = (code >> np.uint64(64 - _CACHE_BITS)).astype(np.int64)
        held = self.keys[slot] == code
        live = np.flatnonzero(n > 0)
        heads = np.r_[0, np.cumsum(n)[:-1]][live]
        missing = np.flatnonzero(~held)
        fresh, first, inverse = np.unique(code[missing], return_index=True, return_inverse=True)
        sample = [c[missing[first]] for c in columns]
        for k, m in enumerate(self.models):
            v = self.values[k][slot]
            if len(fresh):
                new = m.log_probability(sample)
                v[missing] = new[inverse]
                self.values[k][slot[missing[first]]] = new
            out[live, k] = -np.add.reduceat(v, heads) / n[live]
        self.keys[slot[missing[first]]] = fresh
        return out, n, letters


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            by: dict[str, list[str]] = defaultdict(list)
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                by[lang].append(text)
            rows = [(lang, g, c) for lang, texts in by.items() for g, c in gram_counts(texts).items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.string(), pa.string(), pa.int64()], strict=True)], names=["lang", "gram", "n"])


def _score_batches(batches: Iterator[pa.RecordBatch], models, place: int) -> Iterator[pa.RecordBatch]:
    """batches: struct doc, of which the field at `place` is the text."""
    scorer = Scorer(models.value)
    for batch in batches:
        texts = batch.column(0).field(place).cast(pa.string())
        for part in chunks(pa.RecordBatch.from_arrays([batch.column(0), texts], names=["doc", "text"]), "text", SMALL_CHUNK // 8):
            h, n, letters = scorer.entropies(part.column(part.schema.get_field_index("text")))
            judged = (letters > 0) & bool(scorer.names)
            best = h.argmin(axis=1) if scorer.names else np.zeros(len(n), int)
            low = h[np.arange(len(n)), best] if scorer.names else np.zeros(len(n))
            # Confidence: the posterior over the languages, from at most 40 characters' worth of evidence.
            weight = np.exp(-(h - low[:, None]) * np.minimum(n, 40)[:, None]) if scorer.names else np.ones((len(n), 1))
            score = np.where(judged, 1 / weight.sum(axis=1), 0.0)
            names = [scorer.names[b] if j else UNKNOWN for b, j in zip(best.tolist(), judged.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(low, pa.float64()), pa.array(np.maximum(n, 0), pa.int64())], names=["doc", "lang_pred", "score", "cross_entropy", "n_chars_scored"])
        pa.default_memory_pool().release_unused()


def _scored(docs: DataFrame, models, text_col: str) -> DataFrame:
    packed = docs.select(F.struct(*docs.columns).alias("doc"))
    place = docs.columns.index(text_col)
    return packed.mapInArrow(lambda it: _score_batches(it, models, place), f"doc {packed.schema['doc'].dataType.simpleString()}, lang_pred string, score double, cross_entropy double, n_chars_scored bigint")


def fold(id_col: str = "doc_id", folds: int = 4) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


class LanguageIdentifier:
    """Models and limits fitted on labelled rows."""

    def __init__(self, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS, calibration_rows: int = CALIBRATION_ROWS) -> None:
        spark = labelled.sparkSession
        rows = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
        sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
        self.models: dict[str, Model] = {}
        self.limits: dict[str, tuple[float, float, float]] = {}
        if sizes:
            share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, float(fit_rows + calibration_rows) / n)))])[F.col("lang")]
            place = (F.xxhash64("id", F.lit("language")) % 1_000_003 + 1_000_003) % 1_000_003 / 1_000_003.0
            part = fit_rows / (fit_rows + calibration_rows)
            sample = rows.withColumn("place", place / share).where("place < 1")
            counted = sample.where(F.col("place") < part).select("lang", "text").mapInArrow(_count_batches, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
            counts: dict[str, dict[str, int]] = defaultdict(dict)
            for lang, gram, n in zip(*(c.to_pylist() for c in counted.toArrow().columns), strict=True):
                counts[lang][gram] = n
            self.models = {lang: Model(c) for lang, c in counts.items()}
        self._sent = spark.sparkContext.broadcast(self.models)
        if self.models:
            held = _scored(sample.where(F.col("place") >= part).select("lang", "text"), self._sent, "text")
            self._calibrate(held.where("lang_pred = doc.lang").select("lang_pred", "cross_entropy", "n_chars_scored").collect())

    def _calibrate(self, rows: list) -> None:
        """Limits that every held-back row keeps, with room: mean, excess of long texts, and excess that shrinks with length."""
        for lang in self.models:
            own = [(r.cross_entropy, r.n_chars_scored) for r in rows if r.lang_pred == lang]
            if len(own) < 10:
                self.limits[lang] = (0.0, float("inf"), 0.0)
                continue
            h, n = (np.array(x, float) for x in zip(*own, strict=True))
            mean = float(np.average(h, weights=n))
            over = h - mean
            self.limits[lang] = (mean, 1.5 * float(max(over[n >= 200].max(initial=0), 0)) + 0.3, 1.5 * float((over * np.sqrt(np.minimum(n, 200))).max(initial=0)))

    def predict(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """docs as one struct column doc, with lang_pred, score (0 to 1), cross_entropy and rejected."""
        out = _scored(docs, self._sent, text_col)
        rejected = F.col("lang_pred") == UNKNOWN
        for lang, (mean, long, short) in self.limits.items():
            rejected |= (F.col("lang_pred") == lang) & (F.col("cross_entropy") > mean + long + short / F.sqrt(F.greatest(F.col("n_chars_scored"), F.lit(1))))
        return out.withColumn("rejected", rejected)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(fold() == 2, F.lit(False))
    out = LanguageIdentifier(docs.where(~held)).predict(docs.select("doc_id", held.alias("held_out"), "text").select(F.struct("doc_id", "held_out").alias("k"), "text"))
    return out.select("doc.k.doc_id", "doc.k.held_out", "lang_pred", "score", "rejected")

"""What the text operators share: staged tables, byte-level tokenising, hashing and packed arrays.

The kernels here run inside Spark tasks on bounded chunks of one partition; Spark moves and groups the data.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one kernel call holds at a time; a longer single text is a chunk of its own.
CHUNK_BYTES = 6 << 20
#: The same for kernels that hold many arrays of a chunk and gain nothing from large ones.
SMALL_CHUNK = 2 << 20

# The word classes of the operators' contracts, as byte ranges.
WHITESPACE_BYTES = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]
ALNUM_GAPS = [(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)]

SPLIT_ON_SPACE = np.ones(256, dtype=bool)
SPLIT_ON_SPACE[WHITESPACE_BYTES] = False
ALNUM_OR_HIGH = np.ones(256, dtype=bool)
for _a, _b in ALNUM_GAPS:
    ALNUM_OR_HIGH[_a : _b + 1] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_rng = np.random.RandomState(20240601)
_BYTE_VALUE = _rng.randint(0, 1 << 62, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_WORD_BASE = np.uint64(0xD1342543DE82EF95)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset, the warehouse of a local session.

    Tables that operators stage there stay until whoever runs the jobs removes them: Spark does not know of them.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staged"
    return where.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/beaconry/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Removes the folder of a staged table that nothing reads any more, as one that holds personal data."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/beaconry/"
    name = root.removeprefix("file:").lstrip("/")
    for f in df.inputFiles()[:1]:
        folder = f.partition(name)[0] + name + f.partition(name)[2].partition("/")[0]
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_buckets(spark: SparkSession, per_partition: int = 4) -> int:
    """Buckets for packed shuffles; follows spark.sql.shuffle.partitions, which is sized for the data."""
    return per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int, cache: dict = {}) -> np.ndarray:  # noqa: B006
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = cache.get(int(base))
    if have is None or len(have) < n:
        p = np.full(max(n, 1024), base, dtype=np.uint64)
        p[0] = 1
        have = cache[int(base)] = np.multiply.accumulate(p)
    return have[:n]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about limit bytes."""
    n = batch.num_rows
    if not n:
        return
    text = batch.column(batch.schema.get_field_index(column))
    sizes = np.nan_to_num(pa.compute.binary_length(text).cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < n:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array as one array, and each row's offset; null is empty."""
    arr = text.cast(pa.large_string()).fill_null("")
    arr = pa.concat_arrays([arr]) if arr.offset == 0 else pa.array(arr.to_pylist(), pa.large_string())
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(arr.buffers()[1], dtype=np.int64, count=len(arr) + 1)
    data = arr.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of a chunk of texts: byte spans, 64-bit hashes, and each text's range of words."""

    def __init__(self, text: pa.Array, word_bytes: np.ndarray, lower: bool) -> None:
        raw, self.offsets = text_bytes(text)
        self.raw = LOWER[raw] if lower else raw
        inside = word_bytes[self.raw]
        before = np.zeros(len(raw) + 1, dtype=bool)
        before[1:] = inside
        cuts = self.offsets[:-1]
        before[cuts[cuts < len(raw)]] = False
        begins = inside & ~before[:-1]
        self.starts = np.flatnonzero(begins)
        after = np.zeros(len(raw) + 1, dtype=bool)
        after[:-1] = inside
        after[self.offsets[1:]] = False
        self.ends = np.flatnonzero(inside & ~after[1:]) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)
        self._inside = inside

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        if not len(self):
            return np.zeros(0, np.uint64)
        lens = self.ends - self.starts
        at = np.concatenate(([0], np.cumsum(lens)[:-1]))
        letters = self.raw[self._inside]
        place = np.arange(len(letters)) - np.repeat(at, lens)
        vals = _BYTE_VALUE[letters] * powers(_BYTE_BASE, int(lens.max()))[place]
        return mix64(np.add.reduceat(vals, at) + lens.astype(np.uint64))

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


_INVERSE = np.uint64(pow(int(_WORD_BASE), -1, 1 << 64))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hashes of every k consecutive elements, by prefix sums modulo 2 ** 64 (callers drop those across texts)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * powers(_WORD_BASE, len(h)), out=sums[1:])
    return mix64((sums[k:] - sums[:-k]) * powers(_INVERSE, len(h))[:n])


def pack_longs(values: np.ndarray) -> bytes:
    """64-bit numbers as compressed byte planes."""
    import zstandard

    if not len(values):
        return b""
    v = np.ascontiguousarray(values, dtype=np.int64)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_longs(blob: bytes) -> np.ndarray:
    import zstandard

    if not blob:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel()


def pack_ints(values: np.ndarray) -> bytes:
    """Small non-negative numbers as compressed byte planes."""
    import zstandard

    if not len(values):
        return b""
    v = np.ascontiguousarray(values, dtype=np.uint32)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(v.view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack_ints(blob: bytes) -> np.ndarray:
    import zstandard

    if not blob:
        return np.zeros(0, np.uint32)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """A sorted unsigned array as the compressed byte planes of its differences."""
    return pack_longs(np.diff(values, prepend=np.uint64(0)).view(np.int64)) if len(values) else b""


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack_longs(blob).view(np.uint64), dtype=np.uint64)


def slices(sorted_hashes: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of the non-empty equal ranges of the hash space."""
    edges = (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(np.uint64)
    cuts = np.searchsorted(sorted_hashes, edges)
    return [(b, int(x), int(y)) for b, (x, y) in enumerate(zip(np.r_[0, cuts], np.r_[cuts, len(sorted_hashes)], strict=True)) if x < y]

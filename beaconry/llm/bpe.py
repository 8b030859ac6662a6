"""Byte-level BPE encoding and decoding with a local rank file.

Long texts are cut before the regex sees them, at places where the pattern cannot match across: before a whitespace
character that follows a non-whitespace character. Long whitespace runs, on which a backtracking matcher may overflow,
are merged as the single piece the pattern would make of them.

Edge cases: null is the empty text, with no tokens; decoding works on raw bytes, so ids that end inside a character
decode as well; empty tables give empty results; repeated rows are encoded one by one.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.llm.shared import SMALL_CHUNK, chunks

#: Characters after which a text is cut at the next safe place.
SEGMENT_CHARS = 1 << 16
#: Whitespace runs from this length on are encoded as pieces of their own.
LONG_RUN = 256

# The characters that have the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_RUN = re.compile(f"[{WHITE_SPACE}]{{{LONG_RUN},}}")
_SAFE = re.compile(f"(?<=[^{WHITE_SPACE}])[{WHITE_SPACE}]")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def segments(text: str, limit: int = SEGMENT_CHARS) -> Iterator[str]:
    """Parts of a text that can be encoded on their own."""
    at = 0
    while len(text) - at > limit:
        cut = _SAFE.search(text, at + limit)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def encode(enc, text: str, limit: int = SEGMENT_CHARS) -> list[int]:
    """The ids of a whole text, as encode_ordinary would give them."""
    if len(text) < LONG_RUN:
        return enc.encode_ordinary(text)
    out: list[int] = []
    at = 0
    for run in _RUN.finditer(text):
        for part in segments(text[at : run.start()], limit):
            out += enc.encode_ordinary(part)
        # All of the run but its last character is one piece; that one opens what follows.
        at = run.end() if run.end() == len(text) else run.end() - 1
        out += enc._encode_single_piece(text[run.start() : at])
    for part in segments(text[at:] if at else text, limit):
        out += enc.encode_ordinary(part)
    return out


def decode(enc, ids: list[int]) -> bytes:
    """The raw bytes of ids."""
    return enc.decode_bytes(ids)


def _encode_batches(batches: Iterator[pa.RecordBatch], rank_file: str, pattern: str, outputs: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    enc = encoding(rank_file, pattern)
    decimal = [str(i) for i in range(enc.n_vocab)]
    for batch in batches:
        for part in chunks(batch, "text", SMALL_CHUNK):
            made: dict[str, list] = {n: [] for n in outputs}
            counts = []
            for text in part.column(part.schema.get_field_index("text")):
                ids = encode(enc, text.as_py() or "")
                counts.append(len(ids))
                if "token_ids" in made:
                    made["token_ids"].append(ids)
                if "decoded" in made:
                    made["decoded"].append(decode(enc, ids))
                if "ids_sha256" in made:
                    made["ids_sha256"].append(hashlib.sha256(" ".join([decimal[i] for i in ids]).encode()).hexdigest())
                if "decoded_sha256" in made:
                    made["decoded_sha256"].append(hashlib.sha256(decode(enc, ids)).hexdigest())
            rest = [(n, c) for n, c in zip(part.schema.names, part.columns, strict=True) if n != "text"]
            arrays = [c for _, c in rest] + [pa.array(counts, pa.int64())] + [pa.array(v, _TYPES[n][1]) for n, v in made.items()]
            yield pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in rest] + ["n_tokens", *outputs])
        pa.default_memory_pool().release_unused()


_TYPES = {"token_ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("binary", pa.binary()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text", outputs: tuple[str, ...] = ("token_ids",)) -> DataFrame:
    """docs as one struct column doc, n_tokens, and the outputs asked for.

    outputs: token_ids, decoded (the bytes the ids decode to), and the digests ids_sha256 (of decimal ids joined by one
    space) and decoded_sha256, which are taken from the same ids and bytes without sending those back.
    """
    packed = docs.select(F.struct(*docs.columns).alias("doc"), F.col(text_col).cast("string").alias("text")) if "token_ids" in outputs or "decoded" in outputs else docs.select(F.struct(*[c for c in docs.columns if c != text_col]).alias("doc"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc {packed.schema['doc'].dataType.simpleString()}, n_tokens bigint, " + ", ".join(f"{n} {_TYPES[n][0]}" for n in outputs)
    return packed.mapInArrow(lambda it: _encode_batches(it, rank_file, pattern, outputs), schema)


def _decode_batches(batches: Iterator[pa.RecordBatch], rank_file: str, pattern: str) -> Iterator[pa.RecordBatch]:
    enc = encoding(rank_file, pattern)
    for batch in batches:
        out = [None if ids is None else decode(enc, ids) for ids in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc", "decoded"])


def decode_documents(df: DataFrame, rank_file: str, pattern: str, ids_col: str = "token_ids") -> DataFrame:
    """df as one struct column doc, and decoded: the raw bytes of its ids (null for null)."""
    packed = df.select(F.struct(*df.columns).alias("doc"), F.col(ids_col).alias("ids"))
    return packed.mapInArrow(lambda it: _decode_batches(it, rank_file, pattern), f"doc {packed.schema['doc'].dataType.simpleString()}, decoded binary")


def op8_bpe_codec(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, outputs=("ids_sha256", "decoded_sha256"))
    return out.select("doc.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")

"""Token counts by a compiled finite-state transducer.

A byte-level BPE vocabulary is read as a deterministic transducer over bytes. A state holds the longest suffix of the
input that some token could still extend, and the last token and relative count at every place in that suffix; a
transition carries how the number of emitted tokens changes (it may fall, when a byte merges earlier tokens). At each
place exactly one token can end the encoding: the one that is stable next to the last token where it begins. States and
transitions are compiled when first reached and kept up to a bound.

Texts are cut into chunks. A chunk's state map is what it does to any state it is entered in: between its first and its
last synchronising place (whitespace after non-whitespace, where no pretoken can cross) the count does not depend on the
entry state, so the map is a head that the entry state still has to read, a count, and the open tail. Maps compose
associatively and are folded by a parallel-prefix tree.

Edge cases: null is the empty text, with no bytes and tokens; added tokens of the file are recognised in texts, as the
library's default does; empty tables give empty results; repeated rows are counted one by one.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.llm.bpe import _SAFE, WHITE_SPACE
from beaconry.llm.shared import chunks

#: Characters of a chunk, and compiled transitions and tested pairs of tokens kept at a time.
CHUNK_CHARS, MAX_TRANSITIONS, MAX_PAIRS = 1 << 15, 1_200_000, 1_000_000

# The split pattern of byte-level BPE files that ask for it with use_regex.
PRETOKENS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE_SPACE}\p{{L}}\p{{N}}]+|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]+")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}


class Transducer:
    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], added: list[str]) -> None:
        letters = byte_letters()
        raw = {t: bytes(letters[c] for c in t) for t in vocabulary if all(c in letters for c in t)}
        self.bytes_of = {vocabulary[t]: b for t, b in raw.items()}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.merges = {(vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in enumerate(merges)}
        self.prefixes = {b[:k] for b in self.id_of for k in range(len(b))}
        self.added = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.stable: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        start = (b"", (-1,), (0,))
        self.states = [start]
        self.number = {start: 0}
        self.moves: dict[int, tuple[int, int]] = {}

    def merge(self, data: bytes) -> list[int]:
        """The encoding by its definition: the lowest-ranked adjacent pair first, the leftmost of equals.

        Pairs wait in a heap and tokens are linked, so that n bytes take n log n steps.
        """
        ids = [self.id_of[data[i : i + 1]] for i in range(len(data))]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))

        def pair(i: int) -> tuple[int, int, tuple[int, int]] | None:
            two = (ids[i], ids[after[i]]) if i >= 0 and after[i] < len(ids) else None
            return (self.merges[two][0], i, two) if two in self.merges else None

        waiting = [p for p in map(pair, range(len(ids))) if p]
        heapify(waiting)
        while waiting:
            _, i, two = heappop(waiting)
            j = after[i]
            if j >= len(ids) or (ids[i], ids[j]) != two:
                continue  # one of its tokens has been merged with another
            ids[i], ids[j], after[i] = self.merges[two][1], -1, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for p in (pair(before[i]), pair(i)):
                if p:
                    heappush(waiting, p)
        return [t for t in ids if t >= 0]

    def _stable(self, left: int, token: int) -> bool:
        """Whether token keeps its borders after left (-1: at the start)."""
        known = self.stable.get((left, token))
        if known is None:
            if len(self.stable) >= MAX_PAIRS:
                self.stable.clear()
            want = [token] if left < 0 else [left, token]
            known = self.stable[left, token] = self.merge(b"".join(self.bytes_of[t] for t in want)) == want
        return known

    def _compile(self, state: int, byte: int) -> tuple[int, int] | None:
        suffix, last, count = self.states[state]
        window = suffix + bytes([byte])
        for j in range(len(window)):
            token = self.id_of.get(window[j:])
            if token is not None and self._stable(last[j], token):
                break
        else:
            return None
        new_count = count[j] + 1
        keep = next(k for k in range(len(window) + 1) if window[k:] in self.prefixes)
        counts = (*count, new_count)[keep:]
        made = (window[keep:], (*last, token)[keep:], tuple(c - new_count for c in counts))
        to = self.number.get(made)
        if to is None:
            to = self.number[made] = len(self.states)
            self.states.append(made)
        move = self.moves[state << 8 | byte] = (to, new_count - count[-1])
        return move

    def pretoken(self, data: bytes) -> int:
        """Tokens of one pretoken: the sum over its transitions."""
        if len(self.moves) > MAX_TRANSITIONS:
            self._reset()
        moves, state, total = self.moves, 0, 0
        for b in data:
            move = moves.get(state << 8 | b) or self._compile(state, b)
            if move is None:  # a vocabulary in which no token is stable here
                return len(self.merge(data))
            state, d = move
            total += d
        return total

    def count(self, text: str) -> int:
        return sum(n * self.pretoken(p.encode()) for p, n in Counter(PRETOKENS.findall(text)).items())


class StateMap:
    """What a chunk does to the state it is entered in: head still to read, then a fixed count and an open tail."""

    __slots__ = ("count", "head", "tail")

    def __init__(self, head: str, count: int, tail: str | None) -> None:
        self.head, self.count, self.tail = head, count, tail

    def then(self, other: StateMap, t: Transducer) -> StateMap:
        if self.tail is None:
            return StateMap(self.head + other.head, other.count, other.tail)
        if other.tail is None:
            return StateMap(self.head, self.count, self.tail + other.head)
        return StateMap(self.head, self.count + t.count(self.tail + other.head) + other.count, other.tail)


def cut(text: str) -> tuple[str, str, str | None]:
    """Head, inner text and tail of a chunk; without a synchronising place all of it is head."""
    first = _SAFE.search(text)
    if first is None:
        return text, "", None
    last = first.start()
    for at in range(len(text) - 1, last, -1):
        if text[at] in WHITE_SPACE and text[at - 1] not in WHITE_SPACE:
            last = at
            break
    return text[: first.start()], text[first.start() : last], text[last:]


def compose(maps: list[StateMap], t: Transducer) -> StateMap:
    """The maps' composition as a balanced tree."""
    while len(maps) > 1:
        maps = [maps[i].then(maps[i + 1], t) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


def count_texts(t: Transducer, texts: list[str], size: int = CHUNK_CHARS) -> list[int]:
    """Token counts of texts. Pretokens that repeat among the texts' inner parts run through the transducer once."""
    seen: dict[str, int] = {}

    def inner(part: str) -> int:
        total = 0
        for p in PRETOKENS.findall(part):
            n = seen.get(p)
            if n is None:
                n = seen[p] = t.pretoken(p.encode())
            total += n
        return total

    out = []
    for text in texts:
        total = 0
        plain = [text] if t.added is None else t.added.split(text)
        for part in plain:
            if len(part) <= size:
                total += inner(part)
                continue
            maps = []
            for i in range(0, len(part), size):
                head, middle, tail = cut(part[i : i + size])
                maps.append(StateMap(head, inner(middle), tail))
            whole = compose(maps, t)
            total += t.count(whole.head) + whole.count + (t.count(whole.tail) if whole.tail else 0)
        out.append(total + len(plain) - 1)
    return out


@lru_cache(maxsize=2)
def load(path: str) -> Transducer:
    """A transducer for a byte-level BPE file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["model"]["type"] != "BPE" or spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
        raise ValueError("only byte-level BPE files without normaliser and prefix space")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    return Transducer(spec["model"]["vocab"], merges, [a["content"] for a in spec["added_tokens"]])


def _counted(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    t = load(path)
    for batch in batches:
        for part in chunks(batch, "text"):
            texts = [x or "" for x in part.column(part.schema.get_field_index("text")).to_pylist()]
            sizes = [len(x.encode()) for x in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(count_texts(t, texts), pa.int64())], names=["doc", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, tokenizer_file: str, text_col: str = "text") -> DataFrame:
    """The other columns of docs as one struct column doc, with n_bytes and n_tokens."""
    packed = docs.select(F.struct(*[c for c in docs.columns if c != text_col]).alias("doc"), F.col(text_col).cast("string").alias("text"))
    return packed.mapInArrow(lambda it: _counted(it, tokenizer_file), f"doc {packed.schema['doc'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint")


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc.doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))

"""Fill-in-the-middle transformation over an indexable skip list of each text's units.

A unit is a run of ASCII letters or one other character. Each text is a skip list: its units in order, every link of every
express lane carrying how many units, code points and bytes it spans. A cut by unit rank descends from the text's head
lane by lane, taking a link while the accumulated units do not exceed the rank, and ends at the exact code point and byte
of the cut. The lists of a chunk of texts are built together as arrays and all cuts descend at once.

Edge cases: a null text is empty and stays plain; texts that contain a marker stay plain, so the output can always be
taken apart again; a null id draws as the empty word; repeated rows get the same cuts; a text of any length is one list
(of arrays in the order of its units) in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.llm.shared import SMALL_CHUNK, chunks, mix64, text_bytes

# The markers.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: One unit in LANE_STEP of a lane also stands in the lane above, so lanes shrink by it.
LANE_STEP = 4

_LETTER = np.zeros(256, bool)
for _a, _b in [(0x41, 0x5B), (0x61, 0x7B)]:
    _LETTER[_a:_b] = True
_UNITS, _POINTS, _BYTES = 0, 1, 2


class SkipLists:
    """The skip lists of several texts, one after the other; a text's head stands in all lanes.

    Lane 0 has every unit. `nodes` of a lane are places in the lane below; `widths` say what lies between a node and the
    next of the same lane (units, code points, bytes); the last link of a text reaches its end.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray) -> None:
        texts = len(offsets) - 1
        point = (raw & 0xC0) != 0x80
        letter = _LETTER[raw]
        begins = point.copy()
        begins[1:] &= ~(letter[1:] & letter[:-1])
        heads = offsets[:-1][np.diff(offsets) > 0]
        begins[heads] = True
        starts = np.flatnonzero(begins)
        at_point = np.r_[0, np.cumsum(point)]
        first = np.searchsorted(starts, offsets)
        self.units = np.diff(first)
        # A head node before each text's units, so empty texts have one too.
        rows = np.repeat(np.arange(texts), self.units)
        n = len(starts) + texts
        head = first[:-1] + np.arange(texts)
        node = np.arange(len(starts)) + rows + 1
        edges = np.r_[starts, len(raw)]
        last = np.zeros(len(starts), bool)
        last[(first[1:] - 1)[self.units > 0]] = True
        ends = np.where(last, offsets[1:][rows], edges[1:]) if len(starts) else np.zeros(0, np.int64)
        # The link into a node spans its unit; shifted by one, each node's link spans the next node's unit.
        into = np.zeros((n + 1, 3), np.int64)
        into[node] = np.column_stack([np.ones(len(starts), np.int64), at_point[ends] - at_point[starts], ends - starts])
        is_head = np.zeros(n, bool)
        is_head[head] = True
        self.widths, self.down, self.head = [into[1:]], [np.arange(n)], [head]
        order = np.arange(n)
        while len(order) > texts and (self.units.max(initial=0) >> (2 * (len(self.widths) - 1))) > LANE_STEP:
            tall = is_head[order] | (mix64(order.astype(np.uint64) + np.uint64(len(self.widths) << 40)) % np.uint64(LANE_STEP) == 0)
            up = np.flatnonzero(tall)
            self.widths.append(np.add.reduceat(self.widths[-1], up, axis=0))
            self.down.append(up)
            self.head.append(np.searchsorted(up, self.head[-1]))
            order = order[up]

    def cut(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points and bytes before the unit of this rank, for one rank a text (0 to its number of units)."""
        at, passed = self.head[-1].copy(), np.zeros((len(rank), 3), np.int64)
        live = np.flatnonzero(rank > 0)
        for lane in range(len(self.widths) - 1, -1, -1):
            width, moving = self.widths[lane], live
            while len(moving):
                link = width[at[moving]]
                ahead = passed[moving, _UNITS] + link[:, _UNITS] <= rank[moving]
                moving, link = moving[ahead], link[ahead]
                passed[moving] += link
                at[moving] += 1
                moving = moving[passed[moving, _UNITS] < rank[moving]]
            live = live[passed[live, _UNITS] < rank[live]]
            if lane:
                at[live] = self.down[lane][at[live]]
        return passed[:, _POINTS], passed[:, _BYTES]


def take_apart(output: bytes, form: str) -> bytes:
    """The text that an output was made of; a marker never begins inside another, so the first one found is the one put."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    rest = output[len(first) :]
    one, _, rest = rest.partition(second)
    two, _, middle = rest.partition(MIDDLE)
    return one + middle + two if form == "psm" else two + middle + one


def _transform(batches: Iterator[pa.RecordBatch], field: int) -> Iterator[pa.RecordBatch]:
    """doc (its text is the given field), draws (four numbers), percentages (plain above, spm below)."""
    for batch in batches:
        packed = pa.RecordBatch.from_arrays([*batch.columns, batch.column(0).field(field).cast(pa.string())], names=[*batch.schema.names, "text"])
        for part in chunks(packed, "text", SMALL_CHUNK):
            raw, offsets = text_bytes(part.column(part.num_columns - 1))
            lists = SkipLists(raw, offsets)
            h = np.stack([part.column(1).field(k).to_numpy(zero_copy_only=False) for k in range(4)]).astype(np.int64)
            n = lists.units
            low, high = np.sort(np.stack([h[0] % (n + 1), h[1] % (n + 1)]), axis=0)
            (low_point, low_byte), (high_point, high_byte) = lists.cut(low), lists.cut(high)
            infill, spm = part.column(1).field(4).to_numpy(zero_copy_only=False), part.column(1).field(5).to_numpy(zero_copy_only=False)
            del lists
            forms, outputs, restored, prefix, middle = [], [], [], [], []
            for k in range(part.num_rows):
                text = raw[offsets[k] : offsets[k + 1]].tobytes()
                form = "plain" if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or not infill[k] else "spm" if spm[k] else "psm"
                if form == "plain":
                    out = text
                else:
                    a, b, c = text[: low_byte[k]], text[low_byte[k] : high_byte[k]], text[high_byte[k] :]
                    out = PREFIX + a + SUFFIX + c + MIDDLE + b if form == "psm" else SUFFIX + c + PREFIX + a + MIDDLE + b
                plain = form == "plain"
                forms.append(form)
                outputs.append(out)
                restored.append(take_apart(out, form))
                prefix.append(None if plain else int(low_point[k]))
                middle.append(None if plain else int(high_point[k] - low_point[k]))
            columns = [part.column(0), pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(outputs, pa.binary()), pa.array(restored, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "n", "form", "prefix_chars", "middle_chars", "output", "restored"])
        pa.default_memory_pool().release_unused()


def draws(id_col: Column, seed: int = 1) -> list[Column]:
    """The first four groups of eight hex digits of sha256('seed:id'), as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, infill_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """docs as one struct column doc, with n (units), form, prefix_chars, middle_chars, output and restored (bytes in UTF-8)."""
    h = draws(F.col(id_col), seed)
    packed = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"),
        F.struct(*[x.alias(f"h{k}") for k, x in enumerate(h)], (h[2] % 100 < infill_percent).alias("infill"), (h[3] % 100 < spm_percent).alias("spm")).alias("draws"),
    )
    place = docs.columns.index(text_col)
    schema = f"doc {packed.schema['doc'].dataType.simpleString()}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary, restored binary"
    return packed.mapInArrow(lambda it: _transform(it, place), schema)


def op13_skip_list_fim(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = fill_in_middle(docs)
    return out.select("doc.doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || CAST(doc_id AS VARCHAR)) AS s FROM documents),
h AS (SELECT *, len(u) AS n, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2, CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS x, array_to_string(u[a + 1:b], '') AS y, array_to_string(u[b + 1:], '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""

"""Exact Jaccard join of word-shingle sets by PartEnum signatures, and its connected groups.

Sets are put into size bands. In a band, two sets that are similar enough differ in at most k shingles; the shingle
domain is partitioned at random into groups of three parts, so many that some group has at most one difference, and the
subsets of two parts of each group are enumerated. Similar sets then agree on a whole subset, whose content is hashed
into a signature. Sets that share a signature are candidates and are verified on their shingles.

Equal sets are one node. Within a signature every node is verified against the node that shares the most signatures;
where that leaves a signature's nodes in several groups, the others are verified against all of it, in blocks of bounded
size that report only links between groups. No pair is skipped that could join two groups, none within a group is
spelled out. Groups come from label propagation over written tables.

Edge cases: a text of fewer words than a shingle is one shingle; null and word-less texts have no shingles and link with
nothing; rows that repeat are one node; a null id links like any other but takes no part in the smallest id of its group
(null where a group has no other).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations
from math import comb, exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.llm.shared import SMALL_CHUNK, SPLIT_ON_SPACE, Words, chunks, mix64, pack_ints, rolling, shuffle_buckets, stage, unpack_ints

#: Text bytes of a chunk: every text byte becomes several of signatures.
CHUNK = SMALL_CHUNK // 2
#: Shingles of a verification block on average, and what a node counts besides its own.
BLOCK_SHINGLES, NODE_SHINGLES = 1 << 20, 512
#: Bits of a count sketch's number of cells at least, and shingles of a cell at most.
SKETCH_BITS, CELL_SHINGLES = 8, 8
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


#: Shingles that a subset should hold on average, so that few different sets share one.
MIN_SUBSET = 4.5


@dataclass(frozen=True)
class Scheme:
    """groups of `parts` parts of the shingle domain; signatures are the subsets of all parts but `kept` of a group."""

    groups: int
    parts: int
    kept: int
    spare: int


@dataclass(frozen=True)
class Spec:
    words: int = 3
    percent: int = 90

    def bounds(self, largest: int) -> np.ndarray:
        """Lower bounds of the size bands."""
        out = [1]
        while out[-1] <= largest:
            out.append(max(out[-1] + 1, out[-1] * 5 // 4))
        return np.array([*out, out[-1] * 2])

    def differences(self, size: np.ndarray) -> np.ndarray:
        """The most shingles by which linked sets of at most this size differ."""
        return 2 * size * (100 - self.percent) // (100 + self.percent)

    @cache  # noqa: B019
    def scheme(self, low: int, high: int) -> Scheme:
        """How a band of sizes low to high is partitioned: the fewest signatures that are selective enough.

        With k differences at most and k // (kept + 1) + 1 + spare groups, more than `spare` groups have at most `kept`
        differences, so more than `spare` groups agree on a subset of the other parts. Sets with at most `spare` groups
        that have an empty subset can leave empty ones out; `spare` is such that hardly any set has more.
        """
        k = int(self.differences(np.array(high)))
        best = None
        for kept in (1, 2, 3):
            for parts in range(kept + 2, kept + 5):
                for spare in range(16):
                    groups = k // (kept + 1) + 1 + spare
                    number = groups * comb(parts, kept)
                    if number > max(60, high * 0.6):
                        break
                    held = low * (parts - kept) / (groups * parts)
                    bad = groups * min(1.0, comb(parts, kept) * exp(-held))
                    tail = 1 - sum(exp(-bad) * bad**i / factorial(i) for i in range(spare + 1))
                    rank = (0, number) if tail < 5e-3 and held >= MIN_SUBSET else (1, tail)
                    if best is None or rank < best[0]:
                        best = (rank, Scheme(groups, parts, kept, spare))
        return best[1] if best else Scheme(k // 2 + 2, 3, 1, 1)

    def linked(self, both, a, b):
        """Whether sets of a and b shingles with `both` in common are similar enough; arrays or columns."""
        return 100 * both >= self.percent * (a + b - both)


class Sets:
    """The shingle sets of a chunk: sorted distinct hashes, row by row, and a 128-bit key of each set."""

    def __init__(self, text: pa.Array, spec: Spec) -> None:
        words = Words(text, SPLIT_ON_SPACE, lower=True)
        h = words.hashes()
        grams = rolling(h, spec.words)
        parts = []
        for first, n in zip(words.first[:-1].tolist(), words.counts.tolist(), strict=True):
            if n >= spec.words:
                parts.append(np.unique(grams[first : first + n - spec.words + 1]))
            elif n:
                parts.append(mix64(rolling(h[first : first + n], n) + _C2 * np.array([n], np.uint64)))
            else:
                parts.append(np.zeros(0, np.uint64))
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.all = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.first = np.r_[0, np.cumsum(self.sizes)]
        one, two = (np.r_[np.uint64(0), np.cumsum(mix64(self.all ^ c), dtype=np.uint64)] for c in (_C1, _C2))
        keys = np.stack([x[self.first[1:]] - x[self.first[:-1]] + self.sizes.astype(np.uint64) for x in (one, two)], 1)
        self.keys = np.ascontiguousarray(mix64(keys)).view("S16").ravel() if len(parts) else np.zeros(0, "S16")
        self._raw = keys

    def node(self, i: int) -> bytes:
        return mix64(self._raw[i]).tobytes()

    def refs(self) -> np.ndarray:
        """The first half of each node's key."""
        return mix64(self._raw[:, 0])


def _signatures(s: Sets, rows: np.ndarray, spec: Spec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All signatures of the given rows, as (hash, row), and how many of them each row shares with any set it links to."""
    needs = np.full(len(s.sizes), 255)
    if not len(rows):
        return np.zeros(0, np.uint64), rows, needs
    bounds = spec.bounds(int(s.sizes.max()) * 2)
    own = np.searchsorted(bounds, s.sizes[rows], side="right") - 1
    # A set is in its own band and in each above that a linked set can have.
    above = np.searchsorted(bounds, s.sizes[rows] * 100 // spec.percent, side="right") - own
    row, band = np.repeat(rows, above), np.repeat(own, above) + np.arange(above.sum()) - np.repeat(np.cumsum(above) - above, above)
    most = spec.differences(bounds[band + 1] - 1)
    live = most > 0  # bands without room for a difference hold equal sets only
    row, band, most = row[live], band[live], most[live]
    if not len(row):
        return np.zeros(0, np.uint64), row, needs
    hashes, owners = [], []
    for j in np.unique(band).tolist():
        mine = row[band == j]
        h, o, least = _band_signatures(s, mine, j, spec.scheme(int(bounds[j] * spec.percent // 100), int(bounds[j + 1] - 1)))
        hashes.append(h)
        owners.append(mine[o])
        needs[mine] = np.minimum(needs[mine], least)
    return np.concatenate(hashes), np.concatenate(owners), needs


def _band_signatures(s: Sets, rows: np.ndarray, band: int, scheme: Scheme) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place in rows) of one band's signatures, and how many of them linked sets of the band share at least.

    At least 1 + spare groups agree on a subset; those whose subset is empty in a set are empty in both.
    """
    size = s.sizes[rows]
    cells = scheme.groups * scheme.parts
    u = s.all[np.repeat(s.first[rows] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())]
    seed = mix64(np.array([band], np.uint64) + _C1)[0]
    cell = ((mix64(u ^ seed) >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)).astype(np.int64) + np.repeat(np.arange(len(rows)) * cells, size)
    content = np.zeros(len(rows) * cells, np.uint64)
    np.add.at(content, cell, mix64(u + _C2))
    shape = (len(rows), scheme.groups, scheme.parts)
    filled = np.bincount(cell, minlength=len(content)).reshape(shape) > 0
    content = content.reshape(shape)
    hashes, empty = [], []
    for number, used in enumerate(combinations(range(scheme.parts), scheme.parts - scheme.kept)):
        h = np.broadcast_to(mix64(seed + (np.arange(scheme.groups) * 64 + number).astype(np.uint64)), shape[:2]).copy()
        for p in used:
            h = mix64(h * _C1 + content[:, :, p])
        hashes.append(h)
        empty.append(~filled[:, :, list(used)].any(axis=2))
    # At most `spare` groups with an empty subset: another group must agree on a filled one.
    bad = np.any(empty, axis=0).sum(axis=1)
    many = bad > scheme.spare
    # A partner leaves out what it finds empty, so a set that keeps all of its empty subsets may share only one.
    least = np.where(many, 1, 1 + scheme.spare - bad)
    keep = [~e | many[:, None] for e in empty]
    at = np.broadcast_to(np.arange(len(rows))[:, None], shape[:2])
    return np.concatenate([h[k] for h, k in zip(hashes, keep, strict=True)]), np.concatenate([at[k] for k in keep]), least


def _nodes(batches: Iterator[pa.RecordBatch], spec: Spec) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text", CHUNK):
            s = Sets(part.column(2), spec)
            nodes = [s.node(i) if n else None for i, n in enumerate(s.sizes.tolist())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s.sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(s.refs().view(np.int64), pa.int64()), pa.array(_sketches(s), pa.binary())], names=["id", "row_key", "n_shingles", "node", "ref", "sketch"])
        pa.default_memory_pool().release_unused()


def _send(batches: Iterator[pa.RecordBatch], spec: Spec, buckets: int) -> Iterator[pa.RecordBatch]:
    """Signatures by bucket. Within a bucket four bytes stand for one: two that fall together only make more candidates.

    Half of a node's key, its ref, is sent; only nodes of one signature are told apart by it.
    """
    for batch in batches:
        for part in chunks(batch, "text", CHUNK):
            s = Sets(part.column(2), spec)
            full = np.flatnonzero(s.sizes)
            if not len(full):
                continue
            refs = s.refs()
            _, once = np.unique(refs[full], return_index=True)
            sig, row, needs = _signatures(s, np.sort(full[once]), spec)
            if not len(sig):
                continue
            bucket = (sig >> np.uint64(40)) % np.uint64(buckets)
            by = np.lexsort((row, bucket))
            sig, row, bucket = sig[by], row[by], bucket[by]
            cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            out = []
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                used, n = np.unique(row[a:b], return_counts=True)
                out.append((int(bucket[a]), refs[used].tobytes(), pack_ints(n), needs[used].astype(np.uint8).tobytes(), sig[a:b].astype(np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32()] + [pa.binary()] * 4, strict=True)], names=["bucket", "refs", "counts", "needs", "signatures"])
        pa.default_memory_pool().release_unused()


def _shared(table: pa.Table) -> pa.Table:
    """The bucket's signatures that at least two different nodes have, those of the same nodes as one.

    (signature, ref, need, n): a hash of the nodes stands for n signatures.
    """
    sigs, owners, refs, needs, at = [], [], [], [], 0
    for i in range(table.num_rows):
        r = {c: table[c][i].as_py() for c in ("refs", "counts", "needs", "signatures")}
        sigs.append(np.frombuffer(r["signatures"], np.uint32))
        refs.append(np.frombuffer(r["refs"], np.uint64))
        needs.append(np.frombuffer(r["needs"], np.uint8))
        owners.append(np.repeat(np.arange(at, at + len(refs[-1]), dtype=np.int32), unpack_ints(r["counts"])))
        at += len(refs[-1])
    sig = np.concatenate(sigs)
    del sigs
    by = np.argsort(sig)
    sig = sig[by]
    same = sig[1:] == sig[:-1]
    more = np.r_[same, False] | np.r_[False, same]
    sig, owner = sig[more], np.concatenate(owners)[by[more]]
    del by, owners, same, more
    ref, need = np.concatenate(refs)[owner], np.concatenate(needs)[owner]
    by = np.lexsort((ref, sig))
    sig, ref, need = sig[by], ref[by], need[by]
    n = np.zeros(0, np.int64)
    if len(sig):
        new = np.r_[True, (sig[1:] != sig[:-1]) | (ref[1:] != ref[:-1])]
        sig, ref, need = sig[new], ref[new], need[new]
        same = sig[1:] == sig[:-1]
        more = np.r_[same, False] | np.r_[False, same]
        sig, ref, need = sig[more], ref[more], need[more]
    if len(sig):
        first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        who = np.repeat(mix64(np.add.reduceat(mix64(ref ^ _C1), first)), np.diff(np.r_[first, len(sig)]))
        by = np.lexsort((ref, who))
        who, ref, need = who[by], ref[by], need[by]
        first = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (ref[1:] != ref[:-1])])
        n = np.diff(np.r_[first, len(who)])
        sig, ref, need = who[first], ref[first], need[first]
    return pa.table({"signature": pa.array(sig.astype(np.uint64).view(np.int64), pa.int64()), "ref": pa.array(ref.view(np.int64), pa.int64()), "need": pa.array(need.astype(np.int16), pa.int16()), "n": pa.array(n, pa.int64())})


def _strong(members: DataFrame) -> DataFrame:
    """members without the nodes that share fewer signatures than linked ones do, and without signatures of one node."""
    able = members.groupBy("ref").agg(F.sum("n").alias("all"), F.min("need").alias("need")).where("all >= need").select("ref")
    kept = members.join(able, "ref", "left_semi")
    shared = kept.groupBy("signature").agg(F.count(F.lit(1)).alias("nodes")).where("nodes > 1").select("signature")
    return kept.join(shared, "signature", "left_semi")


_BITS, _BIT_ROWS = 1 << 26, 1 << 15


def _bitmap(rows: DataFrame) -> bytes:
    """A bit for each (id, row_key): at most 8 MB, however many rows there are."""
    place = F.pmod(F.xxhash64("id", "row_key"), F.lit(_BITS))
    parts = rows.select(F.floor(place / _BIT_ROWS).alias("part"), (place % _BIT_ROWS).alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = bytearray(_BITS // 8)
    for r in parts.toLocalIterator():
        out[r.part * _BIT_ROWS // 8 : (r.part + 1) * _BIT_ROWS // 8] = r.bits
    return bytes(out)


def _sketches(s: Sets) -> list[bytes]:
    """How many of a set's shingles fall into each cell, as bytes: two sets differ in no fewer than their sketches do.

    A larger set has more cells, always a power of two and cut by the leading bits of the shingles, so that a sketch
    folds into one of half the cells.
    """
    bits = np.maximum(SKETCH_BITS, np.ceil(np.log2(np.maximum(s.sizes, 1) / CELL_SHINGLES)).astype(np.int64))
    ends = np.cumsum(1 << bits)
    cell = (s.all >> np.repeat(64 - bits, s.sizes).astype(np.uint64)).astype(np.int64) + np.repeat(ends - (1 << bits), s.sizes)
    counts = np.minimum(np.bincount(cell, minlength=int(ends[-1]) if len(ends) else 0), 255).astype(np.uint8)
    return [c.tobytes() for c in np.split(counts, ends[:-1])] if len(ends) else []


def _folded(m: np.ndarray, cells: int) -> np.ndarray:
    return m if m.shape[1] == cells else m.reshape(len(m), cells, -1).sum(axis=2, dtype=m.dtype)


class Sketches:
    """The sketches of a block's nodes by number of cells, each also folded to half of it: linked sizes differ by no more."""

    def __init__(self, values: list[bytes]) -> None:
        self.values, self.cells = values, np.array([len(v) for v in values])
        self.at: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for cells in np.unique(self.cells).tolist():
            own = np.flatnonzero(self.cells == cells)
            m = np.frombuffer(b"".join([values[i] for i in own]), np.uint8).reshape(-1, cells).astype(np.int16)
            self.at[cells] = own, m
        self.halves = {cells // 2: (own, _folded(m, cells // 2)) for cells, (own, m) in self.at.items()}

    def near(self, i: int, able: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The nodes marked in able whose sketches differ from i's in at most as much as most says."""
        mine = np.frombuffer(self.values[i], np.uint8).astype(np.int16)
        cells, out = len(mine), []
        for there, own in ((self.at.get(cells), mine), (self.halves.get(cells), mine), (self.at.get(cells // 2), _folded(mine[None, :], max(cells // 2, 1))[0])):
            if there is not None and (some := able[there[0]]).any():
                who = there[0][some]
                out.append(who[np.abs(there[1][some] - own).sum(axis=1, dtype=np.int64) <= most[who]])
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def _blobs(batches: Iterator[pa.RecordBatch], spec: Spec, bits) -> Iterator[pa.RecordBatch]:
    table = np.frombuffer(bits.value, np.uint8)
    for batch in batches:
        place = batch.column(3).to_numpy(zero_copy_only=False)
        batch = batch.filter(pa.array((table[place >> 3] >> (place & 7)) & 1 > 0))
        for part in chunks(batch, "text", CHUNK):
            s = Sets(part.column(2), spec)
            shingles = pa.ListArray.from_arrays(pa.array(s.first, pa.int32()), pa.array(s.all.view(np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), shingles], names=["id", "row_key", "shingles"])
        pa.default_memory_pool().release_unused()


def _possible(batches: Iterator[pa.RecordBatch], spec: Spec) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose sizes and sketches do not rule a link out."""
    for batch in batches:
        x, y = batch.column(4).to_numpy(), batch.column(5).to_numpy()
        keep = 100 * np.minimum(x, y) >= spec.percent * np.maximum(x, y)
        cells = np.stack([pa.compute.binary_length(batch.column(i)).to_numpy() for i in (2, 3)], 1)
        for one, two in np.unique(cells[keep], axis=0).tolist():
            rows = np.flatnonzero(keep & (cells[:, 0] == one) & (cells[:, 1] == two))
            step = max(1, (1 << 20) // max(one, two))
            for some in (rows[k : k + step] for k in range(0, len(rows), step)):
                a, b = (_folded(np.frombuffer(b"".join(batch.column(i).take(pa.array(some)).to_pylist()), np.uint8).reshape(len(some), -1).astype(np.int16), min(one, two)) for i in (2, 3))
                keep[some] = np.abs(a - b).sum(axis=1, dtype=np.int64) * (100 + spec.percent) <= (x[some] + y[some]) * (100 - spec.percent)
        out = batch.filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays([out.column(0), out.column(1)], names=["node", "pivot"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Whole pairs of blocks (equal in the first four columns) of a partition that is sorted by them, and where each ends."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], 1)
        new = np.flatnonzero(np.r_[last is not None and bool((keys[0] != last).any()), (keys[1:] != keys[:-1]).any(axis=1)])
        last = keys[-1]
        if not len(new):
            held.append(batch)
            continue
        # Up to the last begin all pairs are whole; the rest waits.
        before = sum(b.num_rows for b in held)
        done = [*held, batch.slice(0, int(new[-1]))]
        yield pa.Table.from_batches([b for b in done if b.num_rows], batch.schema), [int(x) + before for x in new]
        held = [batch.slice(int(new[-1]))]
    if held:
        yield pa.Table.from_batches(held), [sum(b.num_rows for b in held)]


def _fixed(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _survivors(batches: Iterator[pa.RecordBatch], spec: Spec) -> Iterator[pa.RecordBatch]:
    """(signature, node): nodes of a pair of blocks with a partner of another group which their sketches do not rule out."""
    for table, ends in _groups(batches):
        size, outer = table["size"].to_numpy(), table["outer"].to_numpy()
        values = table["value"].to_pylist()
        comp = np.unique(_fixed(table["comp"], "S16"), return_inverse=True)[1]
        live = np.zeros(len(size), bool)
        for a, b in zip([0, *ends[:-1]], ends, strict=True):
            n, c, s = size[a:b], comp[a:b], Sketches(values[a:b])
            for i in np.flatnonzero(outer[a:b]).tolist():
                able = (c != c[i]) & (100 * np.minimum(n, n[i]) >= spec.percent * np.maximum(n, n[i]))
                if able.any():
                    near = s.near(i, able, (n + n[i]) * (100 - spec.percent) // (100 + spec.percent))
                    live[a + near] = True
                    live[a + i] |= len(near) > 0
        if live.any():
            out = table.select(["group_id", "node"]).filter(pa.array(live)).combine_chunks()
            yield pa.RecordBatch.from_arrays([c.combine_chunks() for c in out.columns], names=["signature", "node"])


def _block_links(batches: Iterator[pa.RecordBatch], spec: Spec) -> Iterator[pa.RecordBatch]:
    """Links between groups in each pair of blocks, one for each two groups that it joins."""
    for table in (whole.slice(a, b - a) for whole, ends in _groups(batches) for a, b in zip([0, *ends[:-1]], ends, strict=True)):
        rows = table.select(["node", "outer"]).to_pydict()
        lists = table["value"].combine_chunks()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        sets = np.split(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum(sizes)[:-1])
        group = np.unique(_fixed(table["comp"], "S16"), return_inverse=True)[1]
        parent = list(range(int(group.max()) + 1))

        def root(g: int, parent=parent) -> int:
            while parent[g] != g:
                parent[g] = parent[parent[g]]
                g = parent[g]
            return g

        values = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), sizes)
        by = np.argsort(values, kind="stable")
        values, owner = values[by], owner[by]
        out = []
        for i in np.flatnonzero(rows["outer"]).tolist():
            lo, hi = np.searchsorted(values, sets[i], "left"), np.searchsorted(values, sets[i], "right")
            n = hi - lo
            both = np.bincount(owner[np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())], minlength=len(sets))
            for j in np.flatnonzero(spec.linked(both, sizes[i], sizes) & (group != group[i])).tolist():
                x, y = root(int(group[i])), root(int(group[j]))
                if x != y:
                    parent[x] = y
                    out.append((rows["node"][i], rows["node"][j]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())], names=["a", "b"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): each node's smallest reachable node, by label propagation with pointer jumping over written tables."""
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = stage(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    labels = stage(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("comp")), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy("x").agg(F.min("comp").alias("m"))
        low = stage(labels.join(seen, labels.node == seen.x).select("node", F.least("comp", "m").alias("comp"), F.col("comp").alias("old")), "labels")
        jump = low.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        labels = stage(low.join(jump, "comp").select("node", F.col("next").alias("comp"), "old"), "labels")
        if labels.where("comp <> old").isEmpty():
            return labels.select("node", "comp")
        labels = labels.select("node", "comp")


def _dealt(rows: DataFrame, group: str, values: DataFrame) -> DataFrame:
    """rows of each group (node, comp, outer, size, outer_size, inner_size) dealt to pairs of blocks of bounded size, with values.

    Outer nodes meet all nodes of their group, inner ones only outer ones. A row goes to as many pairs as there are
    blocks on the other side.
    """
    blocks = lambda n: F.ceil(F.col(n) / BLOCK_SHINGLES).cast("int")
    own = F.pmod(F.xxhash64("node", group), F.when(F.col("outer"), blocks("outer_size")).otherwise(blocks("inner_size"))).cast("int")
    rows = rows.withColumn("own", own)
    outer = F.sequence(F.lit(0), blocks("outer_size") - 1)
    inner = F.when(F.col("inner_size") > 0, F.sequence(F.lit(0), blocks("inner_size") - 1)).otherwise(F.array().cast("array<int>"))
    mine = F.col("own")
    pair = lambda o, k, n: F.struct(o.alias("o"), F.lit(k).alias("k"), n.alias("n"))
    # A pair is an outer block and another: an outer one with no smaller number (k = 0), or an inner one (k = 1).
    from_outer = F.concat(F.transform(F.filter(outer, lambda j: j >= mine), lambda j: pair(mine, 0, j)), F.transform(F.filter(outer, lambda j: j < mine), lambda j: pair(j, 0, mine)), F.transform(inner, lambda j: pair(mine, 1, j)))
    from_inner = F.transform(outer, lambda j: pair(j, 1, mine))
    spread = rows.select(F.col(group).alias("group_id"), "node", "comp", "outer", "size", F.explode(F.when(F.col("outer"), from_outer).otherwise(from_inner)).alias("p"))
    pairs = ["group_id", "o", "k", "n"]
    dealt = spread.select("group_id", "p.*", "node", "comp", "outer", "size").join(values.toDF("node", "value"), "node")
    return dealt.select(*pairs, "node", "comp", "outer", "size", "value").repartition(*pairs).sortWithinPartitions(*pairs)


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, percent: int = 90) -> DataFrame:
    """(id, row_key, n_shingles, component_id) per row: groups of rows linked at percent / 100 Jaccard similarity or more."""
    if percent <= 67:
        raise ValueError("size bands need a similarity above 2/3")
    spec, spark = Spec(words, percent), docs.sparkSession
    none = F.lit(-(2**63))  # stands for a null id
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), none).alias("id"), F.col(text_col).cast("string").alias("text")).select("id", F.xxhash64("text").alias("row_key"), "text")
    rows = stage(texts.mapInArrow(lambda it: _nodes(it, spec), "id long, row_key long, n_shingles long, node binary, ref long, sketch binary"), "nodes")
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min(F.when(F.col("id") != none, F.col("id"))).alias("least"), F.max("id").alias("id"), F.max_by("row_key", "id").alias("row_key"), F.first("n_shingles").alias("size"), F.first("ref").alias("ref"), F.first("sketch").alias("sketch"))
    nodes = stage(nodes, "node_ids")
    buckets = shuffle_buckets(spark, 8)
    sent = texts.mapInArrow(lambda it: _send(it, spec, buckets), "bucket int, refs binary, counts binary, needs binary, signatures binary")
    shared = sent.groupBy("bucket").applyInArrow(_shared, "signature long, ref long, need short, n long")
    shared = stage(shared.groupBy("signature", "ref").agg(F.min("need").alias("need"), F.sum("n").alias("n")), "shared")
    members = stage(_strong(shared).join(nodes.select("ref", "node"), "ref").select("signature", "node", "need", "n"), "members")
    degrees = members.groupBy("node").agg(F.sum("n").alias("degree"), F.min("need").alias("need"))
    active = stage(degrees.join(nodes, "node").select("node", "degree", "need", "id", "row_key", "size", "sketch"), "active")

    def fetch(wanted: DataFrame, name: str) -> DataFrame:
        """(node, shingles) of the wanted nodes; rows whose bit is not set are none of theirs and stay where they are."""
        few = active.select("id", "row_key", "node").join(wanted, "node", "left_semi")
        bits = spark.sparkContext.broadcast(_bitmap(few))
        held = texts.withColumn("place", F.pmod(F.xxhash64("id", "row_key"), F.lit(_BITS))).mapInArrow(lambda it: _blobs(it, spec, bits), "id long, row_key long, shingles array<long>")
        return stage(few.join(held, ["id", "row_key"]).dropDuplicates(["node"]).select("node", "shingles"), name)

    # Every node against the node of its signature that shares the most signatures, by sketches and then by shingles. Linked
    # nodes that share too few signatures with each other as pivot and node meet in a signature of a third node's, below.
    pivots = stage(members.join(active.select("node", "degree"), "node").groupBy("signature").agg(F.max(F.struct("degree", "node")).alias("p")).select("signature", F.col("p.node").alias("pivot")), "pivots")
    paired = members.join(pivots, "signature").where("node <> pivot").groupBy("node", "pivot").agg(F.sum("n").alias("n"), F.min("need").alias("need")).where("n >= need").select("node", "pivot", "n")
    sized = active.select("node", "sketch", "size")
    other = active.select(F.col("node").alias("pivot"), F.col("sketch").alias("s2"), F.col("size").alias("n2"), F.col("need").alias("need2"))
    pairs = paired.join(other, "pivot").where("n >= need2").join(sized.toDF("node", "s1", "n1"), "node").select("node", "pivot", "s1", "s2", "n1", "n2")
    near = stage(pairs.mapInArrow(lambda it: _possible(it, spec), "node binary, pivot binary"), "near")
    sets = fetch(near.select(F.explode(F.array("node", "pivot")).alias("node")).distinct(), "pivot_sets")
    held = near.join(sets.toDF("node", "s1"), "node").join(sets.toDF("pivot", "s2"), "pivot").withColumn("both", F.size(F.array_intersect("s1", "s2")))
    links = stage(held.where(spec.linked(F.col("both"), F.size("s1"), F.size("s2"))).select(F.col("node").alias("a"), F.col("pivot").alias("b")), "links")
    first = components(links)

    # Where that leaves several groups in a signature: the nodes outside its pivot's group against all of it, in blocks.
    centres = stage(pivots.join(first.withColumnRenamed("node", "pivot"), "pivot", "left").select("signature", "pivot", F.coalesce("comp", "pivot").alias("centre")), "centres")
    placed = members.join(centres, "signature").where("node <> pivot").join(first, "node", "left")
    placed = placed.join(active.select("node", "size"), "node").select("signature", "node", "centre", "size", F.coalesce("comp", "node").alias("comp"))
    placed = stage(placed.withColumn("outer", F.col("comp") != F.col("centre")), "placed")
    total = lambda c, outer: F.sum(F.when(F.col("outer") == outer, F.col(c) + NODE_SHINGLES).otherwise(0))
    split = placed.groupBy("signature", "centre").agg(total("size", True).alias("outer_size"), total("size", False).alias("inner_size"), F.count_if("outer").alias("n_outer"), F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who"))
    # The pivot is done; signatures with the same nodes need one look.
    split = stage(split.where("n_outer > 0 AND n > 1").groupBy("who", "n", "n_outer", "centre", "outer_size", "inner_size").agg(F.min("signature").alias("signature")), "split")
    rest = placed.drop("centre").join(split.select("signature", "outer_size", "inner_size"), "signature")
    alive = _dealt(rest, "signature", sized.select("node", "sketch")).mapInArrow(lambda it: _survivors(it, spec), "signature long, node binary").distinct()
    alive = stage(alive, "alive")
    # Nodes that meet in several signatures are compared once, in the family that their signatures span.
    least = stage(alive.groupBy("signature").agg(F.min("node").alias("root")), "roots")
    family = components(alive.join(least, "signature").where("node <> root").select("node", "root"), "node", "root").withColumnRenamed("comp", "family")
    named = family.join(active.select("node", "size"), "node").join(first, "node", "left").select(F.xxhash64("family").alias("family"), "node", "size", F.coalesce("comp", "node").alias("comp"))
    named = stage(named, "families")
    weigh = stage(named.groupBy("family").agg(F.mode("comp").alias("centre")), "family_centres")
    named = named.join(weigh, "family").withColumn("outer", F.col("comp") != F.col("centre")).drop("centre")
    total_of = named.groupBy("family").agg(total("size", True).alias("outer_size"), total("size", False).alias("inner_size")).where("outer_size > 0")
    named = stage(named.join(total_of, "family"), "dealt")
    more = _dealt(named, "family", fetch(named.select("node").distinct(), "family_sets")).mapInArrow(lambda it: _block_links(it, spec), "a binary, b binary")
    groups = components(links.unionByName(stage(more, "more_links")))

    named = groups.join(nodes, "node")
    least = stage(named.groupBy("comp").agg(F.min("least").alias("component_id")), "least")
    by_node = stage(nodes.join(groups.join(least, "comp").select("node", "component_id"), "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id")), "by_node")
    linked = rows.where("node IS NOT NULL").join(by_node, "node").select("id", "row_key", "n_shingles", "component_id")
    every = linked.unionByName(rows.where("node IS NULL").select("id", "row_key", "n_shingles", F.nullif(F.col("id"), none).alias("component_id")))
    return every.withColumn("id", F.nullif(F.col("id"), none))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group: that of the smallest id (of rows that repeat it, one)."""
    groups = jaccard_groups(docs, id_col, text_col, words, percent)
    number = F.coalesce("id", F.lit(-(2**63)))
    first = stage(groups.where("id = component_id OR id IS NULL").select(number.alias("key"), "row_key").distinct(), "kept_rows")
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("row_key"))
    kept = keyed.select("doc", number.alias("key"), "row_key").join(first, ["key", "row_key"], "left_semi")
    return kept.dropDuplicates(["key", "row_key"]).select("doc.*")


def op7_partenum_jaccard(spark, sf_dir: str) -> DataFrame:
    out = jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, hash(g) AS h FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM pair JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, (SELECT min(y) FROM r WHERE r.x = w.doc_id) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id
"""

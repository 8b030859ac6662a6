"""Hard negatives, quality and fill-in-the-middle against brute force on small tables with the awkward cases."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from beaconry.llm import fim, negatives, quality

INF, NAN = float("inf"), float("nan")


def vectors():
    r = random.Random(5)
    base = [[r.uniform(-1, 1) for _ in range(6)] for _ in range(40)]
    rows = [(i, i % 3, base[i % 40]) for i in range(150)]  # many equal vectors: ties
    rows += [(10, 1, base[3]), (20, 2, base[4])]  # repeated ids, 20 with another label
    rows += [(200, None, base[0]), (201, 1, None), (None, 1, base[0]), (202, 1, [1.0, None]), (203, 1, [NAN]), (204, 1, [INF, 0.0]), (205, 1, [1e308] * 3)]
    rows += [(206, 0, [0.5]), (207, 1, []), (210, 2, [0.25, 0.25])]
    return rows


def brute_negatives(rows, anchors, scale=256, low=80, high=100):
    whole = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) or not math.isfinite(scale * x) for x in v):
            continue
        whole.append((i, label, [math.floor(scale * x) for x in v], v))
    out = []
    asked = {}
    for i, label, q, v in whole:
        if anchors(i):
            asked[i] = min(asked.get(i, (label, v, q)), (label, v, q))
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    for a, (label, _, q) in asked.items():
        scored = sorted((-clip(sum(x * y for x, y in zip(q, w, strict=False))), i, other == label) for i, other, w, _ in whole if i != a)
        for p, pid, _ in [s for s in scored if s[2]][:5]:
            fit = [(-n, i) for n, i, same in scored if not same and low * -p <= 100 * -n <= high * -p][:5]
            out += [(a, pid, k + 1, i, -p, n) for k, (n, i) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("scale", [256, 3_000_000_000_000])
def test_hard_negatives(spark, scale):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("block", F.lit("x")).withColumn("ids", F.lit(1)).repartition(5)
    got = negatives.mine_hard_negatives(df, F.col("vec_id") % 10 == 0, scale=scale)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, lambda i: i % 10 == 0, scale)


def test_hard_negatives_in_small_blocks(spark, monkeypatch):
    for name, v in {"QUERY_ROWS": 3, "SHARD_ROWS": 7, "ROW_BLOCK": 600, "QUERY_BLOCK": 100}.items():
        monkeypatch.setattr(negatives, name, v)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert sorted(map(tuple, negatives.mine_hard_negatives(df, F.col("vec_id") % 10 == 0).collect())) == brute_negatives(rows, lambda i: i % 10 == 0)


def test_hard_negatives_empty(spark):
    df = spark.createDataFrame(vectors(), "vec_id long, label int, embedding array<double>")
    assert negatives.mine_hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert negatives.mine_hard_negatives(df, F.col("vec_id") < 0).count() == 0


@pytest.mark.parametrize("largest,width", [(3, 1), (300, 64), (300, 700), (10**9, 5), (2**52, 3)])
def test_residue_products(largest, width):
    r = np.random.RandomState(width)
    a, b = (np.floor(r.uniform(-largest, largest, (9, width))) for _ in range(2))
    want = [[sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for v in b] for u in a]
    got = negatives.products(negatives.Residues(a), negatives.Residues(b))
    assert [[int(x) for x in row] for row in got] == [[max(-(2**63), min(2**63 - 1, x)) for x in row] for row in want]


TEXTS = {
    1: "ab cd, é!x", 2: None, 3: "", 4: "<P> marked", 5: "x" * 5000, 6: "é" * 700 + "abc", 7: " \n\t", 8: "a<b<S", 9: "has <S> inside", 10: "<M>", 11: "\U0001f600ab\U0001f600", 12: " ".join(f"w{i}x" for i in range(4000)),
    13: "one", 14: "ends <P", 15: "1234567890", 16: "éa\u0000b",
}


def brute_fim(i, text):
    t = text or ""
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    h = [int(hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    x, y, z = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    form = "plain" if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
    out = {"plain": t, "psm": f"<P>{x}<S>{z}<M>{y}", "spm": f"<S>{z}<P>{x}<M>{y}"}[form]
    return (i, len(u), form, None if form == "plain" else len(x), None if form == "plain" else len(y), out.encode(), t.encode())


def test_fill_in_middle(spark):
    rows = [(i + 100 * k, t) for k in range(12) for i, t in TEXTS.items()] + [(None, "null id text"), (1, TEXTS[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select(F.lit("y").alias("form"), "doc_id", "text", F.lit(3).alias("doc")).repartition(3)
    got = [(r.doc.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, bytes(r.output), bytes(r.restored)) for r in fim.fill_in_middle(docs).collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == sorted((brute_fim(*r) for r in rows), key=key)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_skip_lists_reach_every_rank():
    texts = ["", "ab", "é中 a", "word " * 300, "", "\U0001f600" * 70]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
    lists = fim.SkipLists(raw, offsets)
    units = [re.findall(r"[A-Za-z]+|[^A-Za-z]", t) for t in texts]
    assert lists.units.tolist() == [len(u) for u in units]
    assert len(lists.widths) > 2 and all(len(a) > len(b) for a, b in zip(lists.widths, lists.widths[1:], strict=False))
    for rank in range(601):
        ask = np.array([min(rank, len(u)) for u in units])
        points, size = lists.cut(ask)
        before = ["".join(u[:k]) for u, k in zip(units, ask.tolist(), strict=True)]
        assert points.tolist() == [len(x) for x in before] and size.tolist() == [len(x.encode()) for x in before]


def plain_score(net, text):
    """The model's score of one text, passage by passage, in plain Python over its features."""
    passages = quality.Passages(pa.array([text], pa.string()))
    p = {k: v.astype(float) for k, v in net.p.items()}
    h, e = [], []
    for k in range(len(passages)):
        x = quality.features(*passages.counts(k, k + 1))[0]
        enc = [math.tanh(sum(x[i] * p["W"][i, j] for i in range(len(x))) + p["Wb"][j]) for j in range(quality.ENCODING)]
        gate = [math.tanh(sum(enc[i] * p["V"][i, j] for i in range(len(enc)))) / (1 + math.exp(-sum(enc[i] * p["U"][i, j] for i in range(len(enc))))) for j in range(quality.ATTENTION)]
        h.append(enc)
        e.append(math.exp(sum(g * w for g, w in zip(gate, p["w"], strict=True))))
    z = [sum(a * x[j] for a, x in zip(e, h, strict=True)) / sum(e) for j in range(quality.ENCODING)]
    return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(z, p["c"], strict=True)) + p["cb"][0])))


def labelled(spark):
    r = random.Random(3)
    good = ["the", "river", "flows", "past", "old", "stone", "houses"]
    rows = [(i, " ".join(r.choice(good) + ("$$" if i % 3 == 0 else "") for _ in range(r.randint(1, 200)))) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, docs.select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("quality"))


def test_quality(spark):
    docs, labels = labelled(spark)
    more = labels.union(spark.createDataFrame([(None, 1), (1, None), (2, 7), (9999, 1)], "doc_id long, quality int"))
    fitted = quality.QualityClassifier(docs, more.where("doc_id % 2 = 0 OR doc_id IS NULL"))
    asked = docs.where("doc_id % 2 = 1").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n "), (-4, "the old$$ " * 30_000), (None, "river"), (1, "river")], "doc_id long, text string"))
    asked = asked.withColumn("score", F.lit("x")).withColumn("doc", F.lit(1))
    got = fitted.predict(asked).collect()
    assert len(got) == 126 and all(0 <= r.score <= 1 for r in got)
    for r in got:
        assert r.n_passages == max(1, -(-len((r.doc.text or "").split()) // 48))
        if r.doc.doc_id is None or r.doc.doc_id < 60 and r.doc.doc_id != -4:
            assert r.score == pytest.approx(plain_score(fitted.model, r.doc.text or ""), abs=1e-4)
    held = [r for r in got if r.doc.doc_id and r.doc.doc_id > 1]
    assert sum((r.score >= 0.7) == (r.doc.doc_id % 3 != 0) for r in held) >= 0.95 * len(held)
    assert len({r.score for r in got if r.doc.doc_id in (-1, -2, -3)}) == 1
    assert fitted.predict(asked.limit(0)).count() == 0
    again = quality.QualityClassifier(docs.repartition(7), more.where("doc_id % 2 = 0 OR doc_id IS NULL").repartition(3))
    assert all((again.model.p[k] == v).all() for k, v in fitted.model.p.items())


def test_quality_without_labels(spark):
    docs, labels = labelled(spark)
    assert {r.score for r in quality.QualityClassifier(docs, labels.limit(0)).predict(docs).collect()} == {0.5}


def test_quality_gradients():
    net, r = quality.GatedAttention(), np.random.RandomState(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, heads, y = r.rand(7, quality.BUCKETS + 8), np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])

    def loss():
        h, e = net.encode(x)
        s = net.document(h, e, heads)[2]
        return float(-np.mean(y * np.log(s) + (1 - y) * np.log(1 - s)))

    for k, g in net.gradients(x, heads, y).items():
        for i in r.randint(0, g.size, 5):
            at = np.unravel_index(i, g.shape)
            was = net.p[k][at]
            net.p[k][at] = was + 1e-5
            up = loss()
            net.p[k][at] = was - 1e-5
            down = loss()
            net.p[k][at] = was
            assert g[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_quality_held_out(spark):
    """On the shared tables: labels the model has not seen, told apart by the contract's threshold."""
    sf = "/root/testdata/sf0.01"
    from beaconry.llm.registry import queries

    out = queries()["op12_attention_mil"](spark, sf)
    seen = out.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert out.count() == 1000 and len(seen) > 50
    assert sum(r.predicted == r.quality for r in seen) >= 0.93 * len(seen)


def test_pii_rounds_go_on_until_nothing_changes(spark):
    """Default parameters: four stages of contexts, each learned from what the one before has found; a row without an id
    and one with much punctuation before its number; the written tables of strings are gone afterwards."""
    import os

    from beaconry.llm import pii
    from beaconry.llm.shared import shared_dir

    contexts = ["please dial {} now", "kindly ring {} today", "maybe phone {} later", "surely reach {} soon"]
    found = [[f"+1555{n:07d}" for n in range(1200)]] + [[f"55{k} 0{n:06d}" for n in range(m)] for k, m in enumerate([300, 60, 12, 2], 1)]
    texts = [contexts[k].format(x) for k in range(4) for x in found[k] + found[k + 1]]
    texts += ["please dial " + "!" * 100 + " " + found[1][0] + " now"]
    rows = [*enumerate(texts), (None, contexts[0].format(found[1][1])), (None, contexts[3].format(found[4][1])), (-1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    before = set(os.listdir(shared_dir(spark).removeprefix("file:") + "/beaconry")) if os.path.isdir(shared_dir(spark).removeprefix("file:") + "/beaconry") else set()
    out = pii.find_pii(docs)
    got = {(r.id, len(r.base), len(r.added)) for r in out.where("id IS NULL OR size(added) > 0 OR id >= 0").collect()}
    assert len(got) == len(texts) + 1  # the two rows without an id have equal results
    assert all(b + a == 1 for _, b, a in got)
    spans = {r.id: r.added[0] for r in out.where("id = " + str(len(texts) - 1)).collect()}
    assert texts[-1][spans[len(texts) - 1].at : spans[len(texts) - 1].till] == found[1][0]
    after = set(os.listdir(shared_dir(spark).removeprefix("file:") + "/beaconry")) - before
    assert len(after) == 1 and os.listdir(shared_dir(spark).removeprefix("file:") + "/beaconry/" + after.pop()) == ["pii_spans"]


@pytest.mark.parametrize("bits", [31, 40])
def test_contamination_with_many_words(spark, monkeypatch, bits):
    """A vocabulary of which fewer words fit into a key."""
    import test_llm

    from beaconry.llm import decontaminate

    monkeypatch.setattr(decontaminate, "_ID_BITS", bits)
    rows = [(i, t, "x") for i, t in test_llm.TEXTS.items()] + [(2, test_llm.BASE, "x"), (None, "null id " + test_llm.BASE, "x")]
    test_llm.test_contamination(spark, spark.createDataFrame(rows, "doc_id long, text string, n_words string").repartition(3))


def test_sketches_of_sets_of_all_sizes():
    """Sketches never claim more differences than there are, alike or folded, and tell unrelated long sets apart."""
    from beaconry.llm import jaccard

    r = np.random.RandomState(1)

    class Sets:
        def __init__(self, sets):
            self.sizes, self.all = np.array([len(x) for x in sets]), np.concatenate(sets)

    for n in (3, 500, 2040, 2049, 5000, 20_000):
        base = np.unique(r.randint(0, 1 << 62, n, dtype=np.int64).astype(np.uint64) * np.uint64(4))
        near = np.unique(np.r_[base[: int(n * 0.93)], r.randint(0, 1 << 62, max(1, n // 12), dtype=np.int64).astype(np.uint64) * np.uint64(4)])
        far = np.unique(r.randint(0, 1 << 62, n, dtype=np.int64).astype(np.uint64) * np.uint64(4))
        values = jaccard._sketches(Sets([base, near, far]))
        sketches, sets = jaccard.Sketches(values), [base, near, far]
        for i in range(3):
            apart = np.array([len(np.setxor1d(sets[i], x)) for x in sets])
            assert set(sketches.near(i, np.ones(3, bool), apart).tolist()) == {0, 1, 2}
        if n >= 500:
            size = np.array([len(x) for x in sets])
            assert set(sketches.near(0, np.ones(3, bool), (size + size[0]) * 20 // 180).tolist()) == {0, 1}

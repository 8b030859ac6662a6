"""The text operators against brute force on small tables with the awkward cases."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from beaconry.llm import bpe, decontaminate, jaccard, katz, language, pii, repeats, token_counts, topk, warc

WS = re.compile(r"[^\x20\x09-\x0D]+")
random.seed(11)
VOCAB = ["alpha", "Beta", "gamma", "delta", "é", "zeta%", "eta,", "theta", "iota", "kappa", "lam", "mu"]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) + str(r.randint(0, 30)) for _ in range(n))


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


BASE = prose(80, 1)
TEXTS = {
    1: BASE, 2: BASE, 3: BASE + " tail words here", 4: None, 5: "", 6: "   \n\t ", 7: "one", 8: "One two", 9: prose(60, 2),
    10: prose(30, 3) + " " + " ".join(BASE.split()[5:70]) + " " + prose(20, 4), 11: prose(3000, 5), 12: "x" * 20000, 13: "one", 14: prose(60, 2).replace("alpha", "ALPHA"), 15: "a\x1cb c",
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x") for i, t in TEXTS.items()] + [(2, BASE, "x"), (None, "null id " + BASE, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string").repartition(3)


def words(t):
    return WS.findall(t or "")


def test_repeats(docs):
    got = {(r.id, r.n_words): r for r in repeats.remove_repeats(docs, window=20).collect()}
    assert len(got) == 16
    starts = {}
    for i, t in TEXTS.items():
        w = words(t)
        for j in range(len(w) - 19):
            starts.setdefault(tuple(w[j : j + 20]), set()).add(i)
    for i, t in TEXTS.items():
        w, gone = words(t), set()
        for j in range(len(w) - 19):
            if min(starts[tuple(w[j : j + 20])]) < i:
                gone |= set(range(j, j + 20))
        r = got[i, len(w)]
        assert r.n_removed == len(gone)
        assert bytes(r.kept).decode() == " ".join(x for k, x in enumerate(w) if k not in gone)
    assert got[None, 82].n_removed == 0


def test_repeats_around_one_run(spark):
    """A run of words that most windows hold: its windows go to many buckets, equal ones to the same; results as by brute force."""
    rng = random.Random(9)
    runs = [f"these eight words stand in every text {i}" for i in range(500)]
    least = repeats.rolling(repeats.Words(pa.array(runs), repeats.SPLIT_ON_SPACE, lower=False).hashes(), 8)[::8].argmin()
    run, texts = runs[least], []
    for i in range(300):
        a, b = (" ".join(str(rng.randrange(10**6)) for _ in range(8)) for _ in "ab")
        texts.append(f"{a} {run} {b}" if i % 3 else f"{texts[-1] if texts else a} {run} {b}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    size, starts, want = 12, {}, {}
    for i, t in enumerate(texts):
        w, gone = t.split(), set()
        for j in range(len(w) - size + 1):
            if starts.setdefault(tuple(w[j : j + size]), i) < i:
                gone |= set(range(j, j + size))
        want[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    assert any(n for _, n, _ in want.values())
    assert {r.id: (r.n_words, r.n_removed, bytes(r.kept).decode()) for r in repeats.remove_repeats(docs, window=size).collect()} == want
    keyed = docs.selectExpr("doc_id AS id", "xxhash64(text) AS row_key", "text")
    split = repeats._bucketed(keyed, size, 64, 64 * 64)
    assert len(split.cells) and split.parts.max() > 2 and split.parts.sum() <= 64


def test_repeats_empty(docs):
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def test_contamination(spark, docs):
    w = [x for x in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(BASE))]
    items = [(1, " ".join(w[10:40])), (2, "ONE"), (10, " ".join(w[20:26])), (3, None), (4, ""), (2, "ONE"), (None, "one two"), (5, prose(40, 77))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    alnum = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    wins = {}
    for i, t in items:
        x = alnum(t)
        n = min(13, len(x))
        for j in range(len(x) - n + 1) if i is not None and n else ():
            wins.setdefault(tuple(x[j : j + n]), set()).add(str(i))
    for block in (1 << 20, 8):
        out = decontaminate.with_verdict(decontaminate.find_contamination(docs, bench, block_bytes=block)).collect()
        for r in out:
            x, hit, its = alnum(r.text), set(), set()
            for g, ids in wins.items():
                for j in range(len(x) - len(g) + 1):
                    if tuple(x[j : j + len(g)]) == g:
                        hit |= set(range(j, j + len(g)))
                        its |= ids
            assert (r.n_words, r.n_hit, sorted(r["items"])) == (len(x), len(hit), sorted(its)), r.doc_id
            assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(x))
    assert decontaminate.decontaminate(docs, bench).columns == docs.columns
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == docs.count()


def test_jaccard_groups(spark):
    r = random.Random(5)
    base = [f"w{r.randint(0, 4000)}" for _ in range(200)]
    rows = dict(TEXTS)
    for k in range(100, 160):  # a family whose members differ from each other more than from the base
        t = list(base)
        for _ in range(r.randint(0, 8)):
            t[r.randrange(len(t))] = f"z{r.randint(0, 10**6)}"
        rows[k] = " ".join(t)
    for k in range(200, 230):
        rows[k] = " ".join(f"s{r.randint(0, 3)}" for _ in range(r.randint(1, 12)))
    df = spark.createDataFrame([*rows.items(), (100, rows[100]), (None, rows[101]), (None, rows[102] + " extra")], "doc_id long, text string").repartition(3)

    def shingles(t, n):
        w = words(lower(t or ""))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())

    for n, p in ((3, 90), (5, 80)):
        sets = {k: shingles(t, n) for k, t in rows.items()}
        comp = {k: k for k in rows}

        def root(k, comp=comp):
            while comp[k] != k:
                k = comp[k]
            return k

        for a in rows:
            for b in rows:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= p * len(sets[a] | sets[b]):
                    x, y = root(a), root(b)
                    comp[max(x, y)] = min(x, y)
        old, jaccard.BLOCK_SHINGLES = jaccard.BLOCK_SHINGLES, 1500
        got = jaccard.jaccard_groups(df, words=n, percent=p).collect()
        jaccard.BLOCK_SHINGLES = old
        assert len(got) == df.count()
        loose = [r_ for r_ in got if r_.id is None]
        near = [root(k) for k in rows if sets[k] and 100 * len(sets[k] & shingles(rows[102] + " extra", n)) >= p * len(sets[k] | shingles(rows[102] + " extra", n))]
        assert sorted(r_.component_id for r_ in loose) == sorted([root(101), min(near)])
        for r_ in got:
            k = r_.id
            if k is None:
                continue
            assert (r_.n_shingles, r_.component_id) == (len(sets[k]), root(k)), (n, k)
        kept = jaccard.keep_one(df, words=n, percent=p)
        ids = [x.doc_id for x in kept.where("doc_id IS NOT NULL").collect()]
        assert sorted(ids) == sorted(k for k in rows if root(k) == k)


def test_jaccard_empty(docs):
    assert jaccard.jaccard_groups(docs.limit(0)).count() == 0


def test_codec():
    enc = bpe.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for t in [*(x or "" for x in TEXTS.values()), "a" + " " * 3000 + "b", "\n" * 900, "naïve  世界🙂 'll don't", " " * 500 + "　"]:
        assert bpe.encode(enc, t, 50) == enc.encode_ordinary(t)
        assert bpe.decode(enc, bpe.encode(enc, t)) == t.encode()


def test_codec_frames(docs):
    out = bpe.encode_documents(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, outputs=("token_ids", "ids_sha256"))
    back = bpe.decode_documents(out.select("doc.*", "token_ids", "ids_sha256"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert len(back) == 17
    for r in back:
        assert bytes(r.decoded).decode() == (r.doc.text or "")
        assert r.doc.ids_sha256 == hashlib.sha256(" ".join(map(str, r.doc.token_ids)).encode()).hexdigest()


def test_token_counts(docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t = token_counts.load(P.path("byte_bpe_50k.json"))
    r = random.Random(2)
    bits = [" ", "  ", "\n", "'s", "'", "re", "the", "ing", "é", "12", "%%", "<|endoftext|>", "世", "　", "🙂", "X" * 7]
    texts = [x or "" for x in TEXTS.values()] + ["".join(r.choice(bits) for _ in range(r.randint(0, 60))) for _ in range(400)]
    want = [len(x.ids) for x in lib.encode_batch(texts, add_special_tokens=False)]
    assert token_counts.count_texts(t, texts) == want
    assert token_counts.count_texts(t, texts, 7) == want
    got = {r.doc.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, P.path("byte_bpe_50k.json")).collect()}
    assert got[4] == (0, 0) and got[11][0] == len(TEXTS[11].encode())


def test_topk(spark):
    r = random.Random(4)
    rows = [(i, [r.uniform(-1, 1) for _ in range(8)]) for i in range(300)]
    rows += [(400 + i, [0.5] * 8) for i in range(60)] + [(500, None), (501, [1.0, None] + [0.0] * 6), (502, [float("nan")] * 8), (None, [9.0] * 8), (7, rows[7][1]), (600, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    ok = [(i, [math.floor(64 * x) for x in map(float, row.embedding)]) for row in df.collect() for i in [row.vec_id] if i is not None and row.embedding is not None and all(x is not None and math.isfinite(x) for x in row.embedding)]
    got = {}
    for x in topk.maxscore_topk(df, df.where("vec_id % 20 = 0"), k=6).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.score, x.vec_id))
    for q, v in ok:
        if q % 20 == 0:
            best = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q))[:6]
            assert got.pop(q) == [(-s, i) for s, i in best]
    assert not got
    assert topk.maxscore_topk(df.limit(0), df.limit(0)).count() == 0
    assert topk.maxscore_topk(df, df.limit(0)).count() == 0


def test_topk_blocks(spark, monkeypatch):
    """Many blocks and shards, clustered vectors, ties, ragged and huge components, other columns of clashing names."""
    import numpy as np

    monkeypatch.setattr(topk, "ROW_BLOCK", 4 * 12 * 700)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4 * 12 * 40)
    monkeypatch.setattr(topk, "SHARD_ROWS", 64)
    r = random.Random(12)
    centres = [[r.choice([-1, 0, 0, 0, 1]) for _ in range(12)] for _ in range(9)]
    rows = [(i, [float(c + r.choice([0, 0, 0.02])) for c in centres[i % 9]][: r.choice([12, 12, 12, 7])]) for i in range(2000)]
    rows += [(3000, [1e200] * 3), (3020, [1e30, -1e30, 5.0]), (3040, [1e308 * 1.7]), (3041, [])]
    df = spark.createDataFrame([(i, v, i, i) for i, v in rows], "vec_id long, embedding array<double>, block int, score long").repartition(4)
    vectors = {i: [math.floor(64 * x) for x in v] for i, v in rows if i != 3040}
    got = {}
    for x in topk.maxscore_topk(df, df.where("vec_id % 20 = 0"), k=7, seed_rows=100).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.score, x.vec_id))
    clip = lambda x: max(-(2**63), min(2**63 - 1, x))
    for q in [i for i in vectors if i % 20 == 0]:
        best = sorted((-clip(sum(a * b for a, b in zip(vectors[q], w, strict=False))), i) for i, w in vectors.items() if i != q)[:7]
        assert got.pop(q) == [(-s, i) for s, i in best], q
    assert not got
    # Shards whose bounds stay below all thresholds are skipped, and columns without essential terms are not multiplied.
    g = np.random.default_rng(3)
    centre = np.zeros((8, 16))
    centre[np.arange(8), np.arange(8) * 2] = 60
    v = np.floor(centre[g.integers(0, 8, 4000)] + g.integers(-3, 4, (4000, 16)))
    ids, seeds = np.arange(4000), np.floor(centre + 0.0)
    best = topk.Best(np.full(200, np.iinfo(np.int64).min), 10)
    topk.search(best, ids[:200], v[:200], ids, v, seeds, shard_rows=100, query_rows=25)
    assert best.skipped > 0.5 * best.shards and best.multiplied < 0.5 * best.terms
    for i in range(200):
        want = sorted((-int(v[i] @ v[j]), j) for j in range(4000) if j != i)[:10]
        assert [(-s, j) for s, j in zip(best.score[i].tolist(), best.id[i].tolist(), strict=True)] == want


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for k, (kind, p) in enumerate(kinds.items()):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_pii(spark):
    r = random.Random(9)
    bits = ["a.b@c.de", "x@y", "a@b.c_d@e.f", "10.0.0.1", "1.2.3.4.5.6.7.8", "256.1.1.1", "000255.1.1.1", "4539 1488 0343 6467", "4111-1111-1111-1111", "4111111111111112", "+1 (523) 555-1055", "+1-2", "+49 30 1234567 ", "é🙂", "@", "@.", ".", "word", "12", "3" * 30]
    texts = {i: "".join(r.choice(bits) + r.choice(["", " ", ", "]) for _ in range(r.randint(0, 25))) for i in range(300)}
    texts |= {1000: None, 1001: "", 1002: "a" * 50000 + "@b.c", 1003: "9" * 3000, 1004: "a@b" + ".c" * 8000, 1005: "1.1.1.1 " * 700}
    # One context, many seeds: the numbers in it that no base pattern takes are found; others are not.
    good = [n for n in range(4539148803430000, 4539148803430400) if luhn(str(n))][:12]
    for i, n in enumerate(good):
        texts[2020 + i] = f"some text then badge number {n} was read by clerk {i}"
    texts[2010] = "other story badge number 4539148803436468 was read"
    texts[2011] = "other story total amount 4539148803436469 was read"
    df = spark.createDataFrame([(i, t, "e") for i, t in texts.items()] + [(1000, None, "e"), (None, "q@w.er", "e")], "doc_id long, text string, base string").repartition(3)
    old, pii.MIN_SEEDS = pii.MIN_SEEDS, 2
    got = {x.id: x for x in pii.find_pii(df).collect()}
    masked = {x.doc_id: x.text for x in pii.mask_pii(df).collect()}
    pii.MIN_SEEDS = old
    assert len(got) == len(texts) + 1
    for i, t in texts.items():
        assert [tuple(s) for s in got[i].base] == base_spans(t), i
        assert [(s.at, s.till) for s in got[i].added if i != 2010] == [], i
        spans = {(s, e): k for s, e, k in base_spans(t)}
        if not any(a < d and c < b for a, b in spans for c, d in spans if (a, b) != (c, d)) and len(spans) == len(base_spans(t)) and i != 2010:
            want, at = "", 0
            for (s, e), k in sorted(spans.items()):
                want, at = want + t[at:s] + f"[{pii.KINDS[k].upper()}]", e
            assert masked[i] == (want + t[at:] if spans else t), i
    assert [(s.at, s.till, s.kind) for s in got[2010].added] == [(25, 41, 2)]


def test_warc(spark, tmp_path):
    big = "<p>" + "y" * 5000 + "WARC/1.1\r\n\r\nx" + "</p>"
    rows = [(5, "http://a/é", big), (3, "http://b", big), (9, None, big), (1, "u", None), (2, "u", ""), (4, "u", "a\r\n\r\nb"), (4, "u", "a\r\n\r\nb"), (8, "u", "ü"), (None, "u", "n")]
    df = spark.createDataFrame(rows, "id long, url string, payload string").repartition(3)
    path = str(tmp_path / "w")
    warc.write_warc(warc.resolve_revisits(df), path)
    full = warc.read_warc(spark, path)
    assert {(r.id, bytes(r.payload).decode()) for r in full.where("record_type = 'response'").collect()} == {(3, big), (1, ""), (4, "a\r\n\r\nb"), (8, "ü"), (None, "n")}
    got = sorted(((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.with_originals(full).collect()), key=str)
    first = {}
    for i, _, p in rows:
        if i is not None:
            first[p or ""] = min(i, first.get(p or "", i))
    want = []
    for i, _, p in rows:
        b = (p or "").encode()
        f = first.get(p or "")
        back = f is not None and i != f
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if back else "response", f if back else None))
    assert got == sorted(want, key=str)


def test_katz(spark, docs, tmp_path):
    g = random.Random(21)  # words of many frequencies
    zipf = [(600 + i, " ".join(f"z{min(int(g.paretovariate(0.8)), 10**7)}" for _ in range(300)), "x") for i in range(30)]
    docs = docs.unionByName(spark.createDataFrame(zipf, docs.schema))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    train = [t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10 != 0]
    toks = lambda t: [lower(w) for w in words(t)] + ["</s>"]
    uni, bi = Counter(), Counter()
    for t in train:
        x = toks(t)
        uni.update(x)
        bi.update(zip(["<s>"] + x, x))
    n, v = sum(uni.values()), len(uni)

    def good_turing(c):  # a line through the logarithms of the counts of counts, each spread over its gap
        hist = sorted(Counter(c.values()).items())
        r = [x for x, _ in hist]
        z = [2 * m / ((r[i + 1] if i + 1 < len(r) else 2 * x - ([0, *r][i])) - [0, *r][i]) for i, (x, m) in enumerate(hist)]
        xs, ys = [math.log(x) for x in r], [math.log(y) for y in z]
        mx, my = sum(xs) / len(xs), sum(ys) / len(ys)
        slope = sum((x - mx) * (y - my) for x, y in zip(xs, ys, strict=True)) / sum((x - mx) ** 2 for x in xs)
        assert slope < -1.05
        return lambda k: (k + 1) * math.exp(slope * (math.log(k + 1) - math.log(k)))  # (r + 1) S(r + 1) / S(r)

    star1, star2 = good_turing(uni), good_turing(bi)
    assert all(0 < star(k) < k for star in (star1, star2) for k in (1, 2, 3, 10, 1000))
    unseen = 1 - sum(star1(k) for k in uni.values()) / n
    p1 = lambda w: star1(uni[w]) / n if uni[w] else unseen
    ch = Counter(uni) + Counter({"<s>": uni["</s>"]})
    follow = {}
    for (h, w), c in bi.items():
        follow.setdefault(h, {})[w] = star2(c) / ch[h]

    def p2(h, w):
        f = follow.get(h, {})
        return f[w] if w in f else (1 - sum(f.values())) / (1 - sum(map(p1, f))) * p1(w)

    for h in list(follow)[:20]:
        assert abs(sum(p2(h, w) for w in uni) + p2(h, "never seen") - 1) < 1e-9
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    clashing = docs.withColumns({"train": F.lit(1), "batch": F.lit("x"), "hashes": F.lit("y"), "score": F.lit("z")})
    model, scored = katz.learn_and_score(clashing, fold != 0)
    got = {(r.id, r.n_tokens): r for r in scored.collect()}
    for i, t in rows:
        x = toks(t)
        r = got[i, len(x)]
        assert (r.n_known, r.train_tokens) == (sum(uni[w] > 0 for w in x), n)
        assert abs(r.base_score - sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x)) < 1e-6
        assert abs(r.score - sum(math.log10(p2(h, w)) for h, w in zip(["<s>"] + x, x))) < 1e-6, i
    assert katz.score_documents(docs.limit(0), fold != 0).count() == 0
    # Other texts, scored by the stored tables.
    model.save(str(tmp_path / "lm"))
    again = katz.KatzModel.load(spark, str(tmp_path / "lm"))
    other = [(1, TEXTS[3] + " unheard of"), (2, None), (3, prose(200, 41)), (4, "nothing known here"), (5, "one")]
    for r in again.score(spark.createDataFrame(other, "doc_id long, text string")).collect():
        x = toks(dict(other)[r.id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(x), sum(uni[w] > 0 for w in x), n)
        assert abs(r.score - sum(math.log10(p2(h, w)) for h, w in zip(["<s>"] + x, x))) < 1e-6, r.id
    nothing = katz.learn_and_score(docs, F.lit(False))[1]
    assert nothing.where("score <> 0 OR n_known <> 0 OR train_tokens <> 0").count() == 0


def test_katz_discounts(spark):
    """The slope that the tables' own counts show is steep enough for Good-Turing: no discount is a default."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model, _ = katz.learn_and_score(docs, F.lit(True))
    for d in (model.one, model.two):
        assert d.slope < katz.MAX_SLOPE and d.slope != katz.NO_SLOPE and 0 < d.unseen < 1


def test_language(spark):
    langs = {"en": "the of and to in that is was for with house water thing".split(), "fr": "le la les des une est dans pour qui avec maison été forêt".split(), "de": "der die das und ist nicht auf mit für ein haus wäre straße".split()}
    r = random.Random(6)
    rows = [(i, " ".join(r.choice(langs[k]) for _ in range(r.randint(3, 80))), k) for i, k in enumerate(list(langs) * 160)]
    rows += [(1000, None, "en"), (1001, "", None), (1002, "123 %%% 🙂", "fr"), (1003, "the water of the house " * 5000, None), (1004, "zzxqj qqxz jjqx zzqxj xqzj " * 40, None), (None, "le la", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = F.coalesce(language.fold() == 2, F.lit(False))
    model = language.LanguageIdentifier(df.where(~held))
    got = {x.doc.doc_id: x for x in model.predict(df).collect()}
    test = [i for i in range(480) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i].lang_pred == got[i].doc.lang for i in test) >= 0.95 * len(test)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (1000, 1001, 1002))
    assert got[1003].lang_pred == "en" and not got[1003].rejected and 0 <= got[1003].score <= 1
    assert got[1004].rejected
    assert sum(got[i].rejected for i in range(480)) == 0
    # Probabilities after any context sum to one.
    m = model.models["en"]
    import numpy as np

    chars = sorted({c for _, t, k in rows if k == "en" and t for c in t.lower()} | {" "})
    for ctx in ("the", " ho", "zzz"):
        cols = [np.full(len(chars) + 1, ord(c), np.uint32) for c in ctx] + [np.array([ord(c) for c in chars] + [0x4E00], np.uint32)]
        assert np.exp(m.log_probability(cols)).sum() <= 1 + 1e-9
    none = language.LanguageIdentifier(df.limit(0)).predict(df)
    assert none.where("lang_pred <> 'und' OR score <> 0").count() == 0


def test_kneser_ney():
    """A model's probabilities against interpolated Kneser-Ney by its definition; after any context they sum to one."""
    import numpy as np

    r = random.Random(33)
    texts = [" ".join(r.choice(["the", "house", "water", "eau", "été", "of", "thing"]) for _ in range(r.randint(1, 12))) for _ in range(30)]
    four = Counter()
    for t in texts:  # runs of letters after three spaces; what is no letter is a space
        padded = "   " + "".join(c if c.isalpha() else " " for c in t.lower())
        four.update(padded[i : i + 4] for i in range(len(padded) - 3))
    model = language.Model(dict(language.gram_counts(texts)))
    levels = {4: dict(four)}
    for k in (3, 2, 1):  # continuation counts
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    alphabet = sorted(levels[1])

    def p(h, w):
        if h is None:
            return 1 / (len(alphabet) + 1)
        level = levels[len(h) + 1]
        once, twice = sum(c == 1 for c in level.values()), sum(c == 2 for c in level.values())
        d = once / (once + 2 * twice) if once and twice else 0.5
        follow = {g[-1]: c for g, c in level.items() if g[:-1] == h}
        lower = p(h[1:] if h else None, w)
        total = sum(follow.values())
        return lower if not total else max(follow.get(w, d) - d, 0) / total + d * len(follow) / total * lower

    for h in ("the", " ho", "zzz", "eau", "   ", "té "):
        ws = [*alphabet, "\u4e00"]
        cols = [np.full(len(ws), ord(c), np.uint32) for c in h] + [np.array([ord(c) for c in ws], np.uint32)]
        got = np.exp(model.log_probability(cols))
        assert np.allclose(got, [p(h, w) for w in ws], rtol=0, atol=1e-9)
        assert abs(got.sum() - 1) < 1e-9


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == [*docs.columns, "n_tokens", "token_ids", "round_trip"]
    rows = out.collect()
    assert rows and all(r.round_trip and r.n_tokens == len(r.token_ids) for r in rows)
    assert not any(base_spans(r.text) for r in rows)
    held = {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = step(spark, docs, sf)
        assert docs.columns == before.columns
        docs = spark.createDataFrame(docs.collect(), before.schema)
        held[name] = docs.count()
    assert held["language"] >= 0.97 * before.sparkSession.read.parquet(f"{sf}/documents.parquet").where("text RLIKE '[a-z]'").count()
    assert held["personal_data"] == held["decontamination"] == len(rows)


def test_pipeline_near_copies(spark):
    import corpus_pipeline

    r = random.Random(8)
    texts = {}
    for k, (n, edits) in enumerate([(48, 1), (49, 1), (55, 1), (65, 1), (66, 1), (93, 2), (94, 2), (110, 2), (127, 2), (128, 2), (400, 9), (400, 11), (400, 14)]):
        t = [f"w{k}x{r.randint(0, 10**6)}" for _ in range(n)]
        texts[2 * k] = " ".join(t)
        for at in range(edits):
            t[(at + 1) * n // (edits + 1)] += "z"
        texts[2 * k + 1] = " ".join(t)
    texts |= {100: None, 101: "", 102: "one"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    grams = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in texts.items() for w in [words(lower(t or ""))]}
    linked = {i for i in range(1, 26, 2) if 100 * len(grams[i] & grams[i - 1]) >= 80 * len(grams[i] | grams[i - 1])}
    between = {i for i in linked if 100 * len(grams[i] & grams[i - 1]) < 85 * len(grams[i] | grams[i - 1])}
    assert len(between) >= 6 and len(linked) < 13
    kept = [x.doc_id for x in corpus_pipeline.drop_near_copies(spark, df, "").collect()]
    assert sorted(kept) == sorted(set(texts) - linked)


def test_jaccard_bands_below_80(spark):
    sizes = [(8, 11), (10, 14), (11, 15), (12, 17), (14, 20), (30, 42), (30, 43)]
    texts = {2 * k + at: " ".join(f"v{k}x{i}" for i in range(n)) for k, pair in enumerate(sizes) for at, n in enumerate(pair)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    got = {r.id: r.component_id for r in jaccard.jaccard_groups(df, words=1, percent=70).collect()}
    assert got == {2 * k + at: 2 * k + (at if 100 * a < 70 * b else 0) for k, (a, b) in enumerate(sizes) for at in (0, 1)}

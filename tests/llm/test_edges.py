"""Edge cases that hold for every operator: empty tables, repeated rows, nulls, extra columns whose names clash."""

import base64
import hashlib
import math
import random
import unicodedata

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from beaconry.llm import bpe, jaccard, language, token_counts, warc

RANKS, FILE = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
#: Names that the operators use inside or for their results.
CLASHING = ["doc", "n_tokens", "token_ids", "decoded", "ids_sha256", "n_bytes", "lang_pred", "score", "rejected", "id", "key", "row_key", "component_id", "n_shingles", "payload_digest", "original", "n"]


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents with a null, an empty, a long and repeated texts, null ids, and columns with clashing names."""
    texts = [(1, "one two three four"), (2, None), (3, ""), (4, "mille " * 9000), (1, "one two three four"), (None, "one two three four"), (None, None), (7, "one two three five")]
    rows = [(i, t, *[f"{c}{k}" for c in CLASHING]) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {', '.join(c + ' string' for c in CLASHING)}").repartition(3)


def test_codec_edges(clashing):
    out = bpe.encode_documents(clashing, RANKS, P.PATTERN, outputs=("token_ids", "decoded", "ids_sha256")).collect()
    enc = bpe.encoding(RANKS, P.PATTERN)
    assert len(out) == 8 and {r.doc.n_tokens for r in out} == {f"n_tokens{k}" for k in range(8)}
    for r in out:
        ids = enc.encode_ordinary(r.doc.text or "")
        assert r.token_ids == ids and r.n_tokens == len(ids) and bytes(r.decoded).decode() == (r.doc.text or "")
    none = bpe.encode_documents(clashing.limit(0), RANKS, P.PATTERN)
    assert none.collect() == [] and bpe.decode_documents(none.select("token_ids"), RANKS, P.PATTERN).collect() == []


def test_token_counts_edges(clashing):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(FILE)
    out = token_counts.count_tokens(clashing.withColumn("copy", F.col("text")), FILE).collect()
    assert sorted(r.doc.doc for r in out) == [f"doc{k}" for k in range(8)]
    assert all((r.n_bytes, r.n_tokens) == (len((r.doc.copy or "").encode()), len(lib.encode(r.doc.copy or "", add_special_tokens=False).ids)) for r in out)
    assert token_counts.count_tokens(clashing.limit(0), FILE).collect() == []


def test_merges_by_definition():
    """Random vocabularies, in which no token may be stable and many pairs tie or overlap, against the plain loop; bounds reset."""
    r = random.Random(4)
    for _ in range(60):
        tokens, merges = ["a", "b", "c"], []
        for _ in range(r.randint(0, 12)):
            two = r.choice(tokens), r.choice(tokens)
            if two not in merges:
                merges.append(two)
                tokens += [two[0] + two[1]] if two[0] + two[1] not in tokens else []
        t = token_counts.Transducer({x: i for i, x in enumerate(tokens)}, merges, [])
        for _ in range(20):
            data = "".join(r.choice("aab" if r.random() < 0.5 else "abc") for _ in range(r.randint(1, 60)))
            want = list(data)
            while hits := [(merges.index(p), i) for i, p in enumerate(zip(want, want[1:], strict=False)) if p in merges]:
                i = min(hits)[1]
                want[i : i + 2] = [want[i] + want[i + 1]]
            assert [tokens[k] for k in t.merge(data.encode())] == want
    assert len(t.merge(b"ab" * 100_000)) <= 200_000


def test_token_counts_with_small_bounds(monkeypatch):
    t = token_counts.Transducer.__new__(token_counts.Transducer)
    t.__dict__.update(token_counts.load(FILE).__dict__)
    t.stable = {}
    t._reset()
    r = random.Random(9)
    texts = [" ".join("".join(r.choice("etaoinshr") for _ in range(r.randint(1, 12))) for _ in range(30)) for _ in range(20)]
    want = token_counts.count_texts(token_counts.load(FILE), texts)
    monkeypatch.setattr(token_counts, "MAX_PAIRS", 50)
    monkeypatch.setattr(token_counts, "MAX_TRANSITIONS", 40)
    assert token_counts.count_texts(t, texts) == want and len(t.stable) <= 50


def test_warc_edges(spark, clashing, tmp_path):
    rows = clashing.withColumns({"id": F.col("doc_id"), "url": F.lit("u"), "payload": F.col("text")})
    warc.write_warc(warc.resolve_revisits(rows), str(tmp_path / "w"))
    got = sorted(((r.id, r.payload_digest, r.record_type, r.refers_to) for r in warc.with_originals(warc.read_warc(spark, str(tmp_path / "w"))).collect()), key=str)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    one, empty = digest("one two three four"), digest("")
    want = [(1, one, "response", None), (1, one, "response", None), (None, one, "revisit", 1), (2, empty, "response", None), (3, empty, "revisit", 2), (None, empty, "revisit", 2), (4, digest("mille " * 9000), "response", None), (7, digest("one two three five"), "response", None)]
    assert got == sorted(want, key=str)
    warc.write_warc(warc.resolve_revisits(rows.limit(0)), str(tmp_path / "none"))
    assert warc.with_originals(warc.read_warc(spark, str(tmp_path / "none"))).collect() == []


def test_jaccard_edges(clashing):
    kept = jaccard.keep_one(clashing, words=3, percent=90)
    assert kept.columns == clashing.columns
    # Rows without an id stay, one of each text; the repeated row goes.
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == sorted([(1, "one two three four"), (2, ""), (3, ""), (4, "mille " * 9000), (-1, "one two three four"), (-1, ""), (7, "one two three five")])
    assert jaccard.keep_one(clashing.limit(0)).collect() == []


def test_language_predictions(spark, clashing):
    """Languages, cross-entropies and scores against the models read one character at a time; repeated rows, clashing names."""
    import numpy as np

    r = random.Random(16)
    lexicon = {"en": ["the", "of", "house", "water", "thing"], "fr": ["le", "des", "maison", "été", "forêt"], "de": ["der", "und", "straße", "wäre", "haus"]}
    text = lambda k, n: " ".join(r.choice(lexicon[k]) for _ in range(n))
    labelled = spark.createDataFrame([(i, text(k, r.randint(1, 9)), k) for i, k in enumerate(list(lexicon) * 50)], "doc_id long, text string, lang string")
    model = language.LanguageIdentifier(labelled)
    some = [text(k, n) for k in lexicon for n in (1, 2, 30)] + [text("en", 3) + " 12 -- " + text("fr", 3), "Haus! ÉTÉ", "世界 the", "a"] * 2
    rows = [(i, t, "x", "y", "z", "w") for i, t in enumerate(some)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc string, score string, lang_pred string, rejected string").repartition(2)

    def entropy(t, m):
        kept, before = "", ""
        for c in t.lower():
            letter = unicodedata.category(c)[0] == "L"
            if letter or before:
                kept += c if letter else " "
            before = c if letter else ""
        padded = "   " + kept
        steps = [float(m.log_probability([np.array([ord(c)], np.uint32) for c in padded[i : i + 4]])[0]) for i in range(len(kept))]
        return -sum(steps) / len(steps), len(steps)

    out = model.predict(docs).collect()
    assert len(out) == len(some)
    for x in out:
        found = {k: entropy(x.doc.text, m) for k, m in model.models.items()}
        best = min(sorted(found), key=lambda k: found[k][0])
        low, n = found[best]
        assert x.lang_pred == best and math.isclose(x.cross_entropy, low, abs_tol=1e-9) and x.doc.score == "y"
        assert math.isclose(x.score, 1 / sum(math.exp(-(h - low) * min(n, 40)) for h, _ in found.values()), rel_tol=1e-6)
    assert model.predict(docs.limit(0)).collect() == []
    assert len(model.predict(clashing).collect()) == 8


def test_pipeline_edges(spark, tmp_path):
    """Nulls, repeated rows, null ids, clashing names and an empty table, from end to end; the language stage by its own rule."""
    import corpus_pipeline

    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = ["doc", "n_tokens", "token_ids", "round_trip", "score", "rejected", "id", "key", "row_key"]
    some = real.limit(120).withColumns({c: F.lit(c) for c in extra})
    odd = some.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in some.schema])
    twice = some.where("text IS NOT NULL").limit(3)
    nulls = some.limit(2).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 1_000_000)
    for name, table in {"some": some.unionByName(odd).unionByName(twice).unionByName(nulls), "none": some.limit(0)}.items():
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").write.parquet(str(tmp_path / name / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "some" / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "some"))
    rows = out.collect()
    assert out.columns == [*[c for c in docs.columns if c not in ("n_tokens", "token_ids", "round_trip")], "n_tokens", "token_ids", "round_trip"]
    assert rows and all(r.round_trip and r.doc == "doc" and r.text is not None for r in rows)
    assert len({r.doc_id for r in rows}) == len(rows)

    learned = docs.where(F.coalesce(language.fold() != 2, F.lit(False)))
    judged = language.LanguageIdentifier(learned).predict(docs).select("doc.doc_id", "doc.text", "rejected").collect()
    want = sorted((r.doc_id, r.text) for r in judged if not r.rejected)
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert kept.columns == docs.columns and sorted((r.doc_id, r.text) for r in kept.collect()) == want
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []

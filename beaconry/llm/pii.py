"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Base matches of four kinds are the seeds. Identifier-like strings around the same lexical patterns (the two words
before; the word before and the word after) form a graph of patterns and instances. Rounds of scoring go both ways: a
pattern is as good as the instances it extracts, an instance as good as the patterns that extract it. Scores only rise,
and the rounds end when none changes any more (to a millionth). Occurrences of instances without a base match become
spans when both sides are good enough. Candidate strings and the words around them are shuffled, never texts; counts are
combined before each shuffle. The written tables that hold such strings are removed when the spans are found.

Edge cases: null is the empty text, without spans; spans are in code points, end exclusive; an added span that touches
a base span is dropped; rows that repeat get equal results, rows with a null id too; an empty table gives an empty result;
extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.llm.shared import stage, unstage

KINDS = ("email", "ip", "card", "phone")

# The contract's patterns. They are written so that they match the same spans in time linear in the text:
# possessive, and starting only where a run of their first class starts or the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to match at all.
NEEDS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9][\x20().0-9-]"}
#: Identifier-like strings: addresses with spelled-out signs, and numbers with separators.
CANDIDATE = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:@|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++)*+|\+?\(?[0-9](?:[\x20().-]{0,2}[0-9])++"
CANDIDATE_NEEDS = r"@[A-Za-z0-9-]|[(\[]at[)\]]|[0-9](?:[\x20().-]{0,2}[0-9]){7}|[0-9]\.[0-9]++\.[0-9]++\.[0-9]"

#: A pattern is good from this share of good instances and this many different seeds; an instance from this score.
MIN_CONFIDENCE, MIN_SEEDS, MIN_SCORE = 0.8, 3, 0.95


def _found(text: Column, pattern: str, needs: str) -> tuple[Column, Column]:
    """The matches, and the lengths of what lies between them."""
    there = text.rlike(needs)
    matches = F.when(there, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    between = F.when(there, F.transform(F.split(text, pattern, -1), F.length)).otherwise(F.array().cast("array<int>"))
    return matches, between


def _starts(matches: str, between: str) -> Column:
    """Start of each match: sums of lengths, by blocks of the square root of their number."""
    lens = f"transform({matches}, (m, i) -> cast(length(m) + {between}[i] as bigint))"
    size = f"cast(ceil(sqrt(size({matches}))) as int)"
    add = "0L, (a, x) -> a + x"
    blocks = f"transform(sequence(0, cast((size({matches}) - 1) div {size} as int)), k -> aggregate(slice(l.v, k * {size} + 1, {size}), {add}))"
    before = "transform(b.v, (x, k) -> aggregate(slice(b.v, 1, k), 0L, (a, y) -> a + y))"
    # Nested one-element transforms name intermediate arrays once.
    return F.expr(
        f"CASE WHEN size({matches}) = 0 THEN array() ELSE element_at(transform(array(named_struct('v', {lens})), l -> "
        f"element_at(transform(array(named_struct('v', {blocks})), b -> element_at(transform(array(named_struct('v', {before})), p -> "
        f"transform({matches}, (m, i) -> p.v[cast(i div {size} as int)] + aggregate(slice(l.v, cast((i div {size}) * {size} + 1 as int), cast(i % {size} as int)), {add}) + {between}[i])), 1)), 1)), 1) END"
    ).cast("array<bigint>")


_KEEP = {
    "email": "true",
    "ip": "forall(split(s.m, '[.]'), p -> length(ltrim('0', p)) <= 3 AND cast(concat('0', substring(ltrim('0', p), 1, 3)) as int) <= 255)",
    "card": "length(regexp_replace(s.m, '[^0-9]', '')) BETWEEN 14 AND 19 AND aggregate(transform(split(reverse(regexp_replace(s.m, '[^0-9]', '')), ''), (d, i) -> "
    "CASE WHEN i % 2 = 0 THEN cast(d as int) WHEN cast(d as int) > 4 THEN 2 * cast(d as int) - 9 ELSE 2 * cast(d as int) END), 0, (a, x) -> a + coalesce(x, 0)) % 10 = 0",
    "phone": "length(regexp_replace(s.m, '[^0-9]', '')) BETWEEN 10 AND 15",
}
_SPAN = "struct<at:bigint,till:bigint,kind:int>"


def _base_spans() -> Column:
    """All base spans from the staged matches, by start and then kind."""
    parts = []
    for k, kind in enumerate(KINDS):
        spans = f"transform(m_{kind}, (m, i) -> named_struct('m', m, 'at', s_{kind}[i]))"
        parts.append(f"transform(filter({spans}, s -> {_KEEP[kind]}), s -> named_struct('at', s.at, 'till', s.at + length(s.m), 'kind', {k}))")
    return F.expr(f"array_sort(concat({', '.join(parts)}), (x, y) -> CASE WHEN x.at <> y.at THEN sign(x.at - y.at) ELSE x.kind - y.kind END)".replace("sign(x.at - y.at)", "cast(sign(x.at - y.at) as int)")).cast(f"array<{_SPAN}>")


def _scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One pass over the texts, written: id, row_key, base spans, and candidates with the words around them."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t"))
    columns = [F.col("id"), F.xxhash64("t").alias("row_key")]
    for kind in KINDS:
        m, n = _found(F.col("t"), PATTERNS[kind], NEEDS[kind])
        columns += [m.alias(f"m_{kind}"), n.alias(f"n_{kind}")]
    there = F.col("t").rlike(CANDIDATE_NEEDS)
    columns.append(F.when(there, F.regexp_extract_all("t", F.lit(CANDIDATE), F.lit(0))).otherwise(F.array().cast("array<string>")).alias("m_any"))
    # The words at both ends of what lies between candidates: letters only, from whole stretches, in time linear in them.
    bare = F.transform(F.split("t", CANDIDATE, -1), lambda x: F.struct(F.length(x).alias("n"), F.regexp_replace(F.lower(x), r"[^\p{L}\s]++", "").alias("w")))
    end = lambda x, pattern: F.regexp_extract(x["w"], pattern, 1)
    around = F.transform(bare, lambda x: F.struct(x["n"].alias("n"), end(x, r"(?<!\S)(\S++\s++\S++)\s*+$").alias("two"), end(x, r"(?<!\S)(\S++)\s*+$").alias("one"), end(x, r"^\s*+(\S++)").alias("next")))
    columns.append(F.when(there, around).otherwise(F.array().cast("array<struct<n:int,two:string,one:string,next:string>>")).alias("around"))
    raw = stage(rows.select(*columns), "pii_matches")
    placed = raw.withColumn("n_any", F.expr("transform(around, x -> x.n)")).select("*", *[_starts(f"m_{k}", f"n_{k}").alias(f"s_{k}") for k in (*KINDS, "any")])
    placed = placed.withColumn("base", _base_spans())
    candidate = f"""transform(m_any, (m, i) -> named_struct(
        'at', s_any[i], 'till', s_any[i] + length(m), 'instance', lower(m), 'two', around[i].two, 'one', around[i].one, 'next', around[i + 1].next,
        'digits', length(regexp_replace(m, '[^0-9]', '')),
        'seed', get(transform(filter(base, b -> b.at < s_any[i] + length(m) AND b.till > s_any[i]), b -> b.kind), 0)))"""
    kept = f"filter({candidate}, c -> c.digits >= 8 OR c.seed IS NOT NULL OR c.instance LIKE '%@%' OR c.instance LIKE '%at%')"
    scanned = stage(placed.select("id", "row_key", "base", F.expr(kept).alias("candidates")), "pii_scan")
    unstage(raw)
    return scanned


def _edges(scanned: DataFrame) -> DataFrame:
    """One row per candidate occurrence and pattern."""
    one = scanned.select("id", "row_key", F.explode("candidates").alias("c"))
    patterns = F.expr("filter(array(CASE WHEN c.two <> '' THEN concat('L|', c.two) END, CASE WHEN c.one <> '' AND c.next <> '' THEN concat('B|', c.one, '|', c.next) END), p -> p IS NOT NULL)")
    return one.select("id", "row_key", "c.at", "c.till", "c.instance", "c.digits", "c.seed", F.explode(patterns).alias("pattern"))


_FITS = "(kind = 0 AND instance RLIKE '@|[(\\\\[]at[)\\\\]]') OR (kind = 1 AND instance RLIKE '^[0-9]+([.][0-9]+){3,}$') OR (kind = 2 AND digits BETWEEN 12 AND 19) OR (kind = 3 AND digits BETWEEN 8 AND 15)"


def bootstrap(scanned: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(id, row_key, added): the spans that good patterns add to the base spans of the scanned rows; and the tables written."""
    occurrences = _edges(scanned)
    graph = stage(
        occurrences.groupBy("pattern", "instance").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed"), F.max("digits").alias("digits")), "pii_graph"
    )
    seeds = graph.where("seed IS NOT NULL").select("instance", F.col("seed").alias("kind"), "pattern", F.lit(1.0).alias("score"))
    total = graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("all"))
    good, before, written = seeds, None, [graph]
    while True:
        # A pattern's confidence in a kind: the part of what it extracts that is known to be of the kind.
        hits = good.groupBy("pattern", "kind").agg(F.sum("score").alias("hit"), F.count(F.lit(1)).alias("seeds"))
        rated = hits.join(total, "pattern").withColumn("confidence", F.floor(1e6 * F.col("hit") / F.col("all") + 1e-3) / 1e6).where(f"confidence >= {MIN_CONFIDENCE} AND seeds >= {MIN_SEEDS}")
        patterns = stage(rated.select("pattern", "kind", "confidence"), "pii_patterns")
        linked = graph.where("seed IS NULL").join(patterns, "pattern").where(_FITS)
        scored = linked.groupBy("instance", "kind").agg((F.floor(1e6 * (1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999)))))) + 1e-3) / 1e6).alias("score"))
        scores = stage(scored.where(f"score >= {MIN_SCORE}"), "pii_instances")
        written += [patterns, scores]
        # The same patterns and scores as a round ago: nothing can change any more.
        state = [df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)"))).first() for df in (patterns, scores)]
        if state == before:
            break
        before = state
        again = graph.where("seed IS NULL").select("pattern", "instance").join(scores, "instance").select("instance", "kind", "pattern", "score")
        good = seeds.unionByName(again)
    new = occurrences.where("seed IS NULL").join(patterns, "pattern").join(scores.select("instance", "kind"), ["instance", "kind"])
    return new.groupBy("id", "row_key").agg(F.expr("collect_set(named_struct('at', at, 'till', till, 'kind', kind))").cast(f"array<{_SPAN}>").alias("added")), written


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row_key, base, added): spans as structs at, till, kind (a place in KINDS); row_key is xxhash64 of the text."""
    scanned = _scan(docs, id_col, text_col)
    found, written = bootstrap(scanned)
    s, f = scanned.alias("s"), found.alias("f")
    joined = s.join(f, F.expr("s.id <=> f.id AND s.row_key = f.row_key"), "left").select("s.id", "s.row_key", "s.base", F.coalesce("f.added", F.array().cast(f"array<{_SPAN}>")).alias("added"))
    spans = stage(joined, "pii_spans")
    for df in [scanned, *written]:
        unstage(df)
    return spans


def _listed(spans: str) -> Column:
    names = "element_at(array(" + ", ".join(f"'{k}'" for k in KINDS) + "), s.kind + 1)"
    return F.expr(f"array_join(transform({spans}, s -> concat({names}, ':', s.at, ':', s.till)), ',')")


def all_spans(base: str, added: str) -> Column:
    """Base and added spans, by start and then kind; added spans that touch a base span go."""
    fresh = f"filter(coalesce({added}, array()), a -> NOT exists({base}, b -> b.at < a.till AND b.till > a.at))"
    return F.expr(f"array_sort(concat({base}, {fresh}), (x, y) -> CASE WHEN x.at < y.at THEN -1 WHEN x.at > y.at THEN 1 ELSE x.kind - y.kind END)")


def mask_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each span of the text replaced by the name of its kind in brackets; other columns stay as they are."""
    found = find_pii(docs, id_col, text_col).select("id", "row_key", all_spans("base", "added").alias("spans")).where("size(spans) > 0").dropDuplicates(["id", "row_key"])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("row_key"))
    joined = keyed.join(found, (keyed.id.eqNullSafe(found.id)) & (keyed.row_key == found.row_key), "left").select("doc", "spans")
    names = "element_at(array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + "), s.kind + 1)"
    t = f"doc.`{text_col}`"
    masked = f"""aggregate(spans, named_struct('at', cast(0 as bigint), 'out', ''), (a, s) ->
        CASE WHEN s.at < a.at THEN named_struct('at', greatest(a.at, s.till), 'out', a.out)
             ELSE named_struct('at', s.till, 'out', concat(a.out, substring({t}, cast(a.at + 1 as int), cast(s.at - a.at as int)), {names})) END,
        a -> concat(a.out, substring({t}, cast(a.at + 1 as int))))"""
    return joined.select(*[F.when(F.col("spans").isNull(), F.col(t)).otherwise(F.expr(masked)).alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def op1_pii_bootstrap(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("all", all_spans("base", "added"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as bigint)").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("`all`").alias("spans"))

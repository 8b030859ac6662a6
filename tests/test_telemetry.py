"""Golden values, same-or-different group pairs, edge cases of rules, and batch = stream."""

import random

import pytest
from pyspark.sql import functions as F

from beaconry.functions import scalars as fn
from beaconry.operators import admission, agents, dedupe, grouping, mapping, metrics, replay, stacks, web
from beaconry.operators.grouping import Policy


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_hash_golden(spark):
    a, b = (F.lit("-".join([c * 8, c * 4, c * 4, c * 4, c * 12])) for c in "ab")
    assert one(spark, fn.hash_id(a, b)) == "43de3f42-d8de-0da8-1a6c-6c58fcd8b6e0"
    day = 86_400_000
    ids = [one(spark, fn.cookieless_id(F.lit("1.2.3.4"), F.lit("ua"), a, F.lit(ms))) for ms in (0, day - 1, day)]
    assert ids[0] == ids[1] != ids[2]


def group(spark, rows, policy=Policy()):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, language string, kind string, stack string")
    got = grouping.group_errors(df, policy).orderBy("i").collect()
    return [(r.group_hash, r.outcome) for r in got]


def test_fingerprint_golden(spark):
    got = group(spark, [("javascript", "TypeError", "TypeError: bad value\n at load (/app/main.js:8:2)")])
    assert got == [("eg1_b2f284ce142dee20730e700fcbfc987761abecca051a8164fb97774725c27303", "frames:1")]


def test_same_and_different_groups(spark):
    got = [h for h, _ in group(spark, [
        ("javascript", "TypeError", "TypeError: user 123 failed\n at load (/release/a/app.js:10:2)\n at node:internal/main/run_main_module:28:49"),
        ("javascript", "TypeError", "TypeError: user 999 failed\n at load (C:\\release\\b\\app.js:800:40)\n at node:internal/main/run_main_module:99:1"),
        ("javascript", "TypeError", "at load (/app.js:1:2)"), ("javascript", "TypeError", "at save (/app.js:1:2)"),
        ("java", "E", "com.x.A: m\n\tat com.x.A.run(A.java:1)\n\tat com.x.A.run(A.java:9)"), ("java", "E", "com.x.A: other\n\tat com.x.A.run(A.java:2)"),
    ])]
    assert got[0] == got[1] and got[2] != got[3] and got[4] == got[5]


def test_outcomes_and_policies(spark):
    rows = [("java", "E", ""), ("java", "E", "no frames here at all, truly"), ("java", "E", "com.x.A: only a header"), ("java", "E", "é" * 50), ("java", "E", "é" * 50 + "x")]
    got = group(spark, rows)
    assert [o for _, o in got] == ["kind_only:empty", "raw_fallback:unrecognized", "kind_only:no_usable_frames", "raw_fallback:unrecognized", "raw_fallback:unrecognized"]
    assert got[3][0] != got[4][0]
    assert [o for _, o in group(spark, rows[:2], Policy(raw_bytes=None))] == ["kind_only:empty", "kind_only:unrecognized"]
    short = [h for h, _ in group(spark, [("java", "E", "é" * 50 + s + "é" * 50) for s in ("aaaa", "bbbb")], Policy(raw_bytes=21))]
    assert short[0] == short[1]
    trace = ("java", "E", "com.x.A: m\n\tat com.x.A.a(A.java:1)\nCaused by: com.x.B: n\n\tat com.x.B.b(B.java:1)")
    hashes = {p: group(spark, [trace], Policy(segments=p))[0] for p in ("terminal", "root", "root_and_cause", "kind_only")}
    assert len({h for h, _ in hashes.values()}) == 4 and hashes["root_and_cause"][1] == "frames:2" and hashes["kind_only"][1] == "kind_only:policy"
    cut = group(spark, [trace], Policy(segments="root", exclusions=(("prefix", "function", "com.x.A"),)))[0]
    assert cut[1] == "kind_only:no_usable_frames"


def test_legacy_golden(spark):
    rows = [("java", "java.lang.RuntimeException", "\tat plugin-1.2.3.jar//com.example.Plugin.handle(Plugin.java:42)"), ("javascript", "TypeError", ' at fn (https://cdn.example.com/assets/app.abc123.js:1742:19) id="u-42" 0xabc'), ("go", "panic", "x")]
    got = {r.language: r.legacy_hash for r in grouping.legacy_group_hash(spark.createDataFrame(rows, "language string, kind string, stack string")).collect()}
    assert got == {"java": "f06e38f4eff0dc1f77c5408fa596935cd875fe0baea8672153c82d3362337219", "javascript": "cb29e8f23b97bb4d96a3226845d85225cd79c855b0611b9effa9baaebee1c415", "go": None}


def test_nested_shared_frames(spark):
    stack = "a.A: x\n\tat a.A.one(A.java:1)\n\tat a.A.two(A.java:2)\nCaused by: a.B: y\n\tat a.B.b(B.java:1)\n\t... 1 more\nCaused by: a.C: z\n\tat a.C.c(C.java:1)\n\t... 2 more"
    df = stacks.parse_stacks(stacks.stack_dictionary(spark.createDataFrame([("java", stack)], "language string, stack string")), ("java",))
    got = [[f.function for f in s.frames] for s in df.first().segments]
    assert got == [["a.A.one", "a.A.two"], ["a.B.b", "a.A.two"], ["a.C.c", "a.B.b", "a.A.two"]]


def test_mutated_stacks_never_fail(spark):
    import random

    r = random.Random(1)
    seeds = ["com.x.A: m\n\tat com.x.A.a(A.java:1)\n\t... 9 more", "TypeError: x\n at f (a.js:1:2)", 'Traceback (most recent call last):\n  File "a", line 1, in f\nE: x', "#0 a.php(1): f()", "panic: x\n\ngoroutine 1 [r]:\nm.f()\n\ta.go:1", "thread 'm' panicked at a:1:1:\n 0: a::b", "Thread 0 crashed:\n0 0x1 f in m"]
    rows = []
    for i in range(140):
        s = list(r.choice(seeds))
        for _ in range(r.randint(1, 12)):
            s[r.randrange(len(s))] = r.choice(["\n", "(", ")", ":", "é", "\t", "", " at ", "9" * 12])
        rows.append((list(stacks.LANGUAGES)[i % 7], "K", "".join(s)))
    assert all(h.startswith("eg1_") and len(h) == 68 for h, _ in group(spark, rows))


def test_retrace_golden(spark):
    text = 'core.file.FileIO -> a.a.a:\n# {"fileName":"FileIO.java","id":"sourceFile"}\n    92:92:core.file.FileIO reload() -> c\ncom.example.Service -> a:\n    10:20:void first() -> b\n    30:40:void second() -> b'
    lines = spark.createDataFrame([("p", "1", i, t) for i, t in enumerate(text.split("\n"))], "project_id string, build string, line_no long, text string")
    df = spark.createDataFrame([("x", "p", "1", "java.lang.RuntimeException: oops\n\tat a.a.a.c(SourceFile:92)\n\tat a.b(SourceFile:35)\n\tat a.b(Unknown Source)"), ("y", "p", "1", "\tat z.z(Q:1)")], "stack_id string, project_id string, build string, stack string")
    got = mapping.retrace(df, *mapping.mapping_tables(lines)).collect()
    assert [(r.stack_id, r.mapped_stacktrace, r.mapping_used) for r in got] == [("x", "java.lang.RuntimeException: oops\n\tat core.file.FileIO.reload(FileIO.java:92)\n\tat com.example.Service.second(Unknown Source:35)\n\tat com.example.Service.first(Unknown Source)", "r8:1")]


def test_mappings_stay_in_their_project(spark):
    """Two projects with one build name, one release and the same stack: each gets its own mapping, a third gets none."""
    stack = "a.E: m\n\tat a.a.c(S:5)"
    lines = spark.createDataFrame([(p, "1", i, t) for p in "pq" for i, t in enumerate([f"{p}.Real -> a.a:", f"    1:9:void {p}1() -> c"])], "project_id string, build string, line_no long, text string")
    rows = spark.createDataFrame([(i, p, "java", "E", "m", stack, "1") for i, p in enumerate("pqr")], "i int, project_id string, language string, kind string, message string, stack string, release string")
    grouped = grouping.group_errors(rows, languages=("java",)).withColumn("exact_hash", F.lit("x")).withColumn("stack_id", F.sha2("stack", 256))
    known = spark.createDataFrame([("p", "1"), ("q", "1")], "project_id string, release string")
    able = mapping.known_builds(grouped, known).select("stack_id", "project_id", F.col("release").alias("build"), "stack").distinct()
    mapped = mapping.retrace(able, *mapping.mapping_tables(lines))
    got = mapping.enrich_occurrences(grouped, mapped, lambda df: grouping.group_errors(df, languages=("java",))).orderBy("i").collect()
    assert [r.mapped_stacktrace for r in got] == ["a.E: m\n\tat p.Real.p1(Unknown Source:5)", "a.E: m\n\tat q.Real.q1(Unknown Source:5)", None]
    assert len({r.group_hash for r in got}) == 3 and got[2].exact_hash == "x"
    tokens = spark.createDataFrame([(p, "1", "f.js", 0, 0, f"{p}.ts", 4, 0, None) for p in "pq"], "project_id string, build string, file string, line int, col int, source string, src_line int, src_col int, name string")
    js = spark.createDataFrame([("s", p, "1", "at f (/f.js:1:3)") for p in "pqr"], "stack_id string, project_id string, build string, stack string")
    assert sorted((r.project_id, r.mapped_stacktrace) for r in mapping.map_js_frames(js, tokens).collect()) == [("p", "at f (p.ts:5:1)"), ("q", "at f (q.ts:5:1)")]


def test_methods_of_lines(spark):
    """A class of 10,000 ranges, and overlapping, nested, empty and missing ones, against the first match in file order."""
    import random

    r = random.Random(4)
    many = [("m", k, 10 * k, 10 * k + 8, f"m{k}") for k in range(10_000)]
    odd = [("o", k, a, a + r.randint(-2, 300), f"o{k}") for k, a in enumerate(r.randint(0, 1000) for _ in range(200))] + [("o", 500, None, None, "o500"), ("n", 1, None, None, "n1"), ("n", 2, 0, (1 << 32) - 1, "n2")]
    rows = [("p", "1", "c", *x) for x in many + odd]
    methods = spark.createDataFrame(rows, "project_id string, build string, class string, method string, line_no int, lo bigint, hi bigint, original_method string")
    ask = [("m", n) for n in (-1, 0, 8, 9, 55_555, 99_998, 99_999, 4_000_000)] + [("o", n) for n in range(-1, 1400)] + [("n", -1), ("n", 0), ("n", (1 << 32) - 1), ("none", 4)]
    asked = spark.createDataFrame([("p", "1", "c", *x) for x in ask], "project_id string, build string, class string, method string, number bigint")
    got = {(x.method, x.number): x.original_method for x in mapping.methods_of_lines(asked, methods).collect()}

    def first(method, n):
        own = [x for x in many + odd if x[0] == method]
        return next((x[4] for x in own if x[2] is not None and x[2] <= n <= x[3]), own[0][4])

    assert got == {(m, n): first(m, n) for m, n in ask if m != "none"}


@pytest.mark.parametrize(("hosts", "host", "ok"), [([], None, True), (["*"], None, False), (["*"], "x.y", True), (["A.com"], "a.com", True), (["*.a.com"], "a.com", True), (["*.a.com"], "b.a.com", True), (["*.a.com"], "ba.com", False), (["b.com"], "a.com", False)])
def test_hostname(spark, hosts, host, ok):
    patterns = F.array(*map(F.lit, hosts)) if hosts else F.array().cast("array<string>")
    assert one(spark, fn.hostname_allowed(patterns, F.lit(host).cast("string"))) is ok


def test_ip_verdict(spark):
    rules = spark.createDataFrame([("t", "1", True), ("t", "1", False), ("u", "2", True), ("u", "2", True), ("v", "3", False), (None, "1", False)], "token string, ip string, allowed boolean")
    rows = [(0, "t", "1", "IP address blocked"), (1, "t", "9", "IP address not allowed"), (2, "u", "1", "IP address not allowed"), (3, "u", "2", None), (4, "v", "1", None), (5, "v", "3", "IP address blocked"), (6, "w", "1", None), (7, None, "1", None), (8, "u", None, "IP address not allowed")]
    df = spark.createDataFrame(rows, "i int, token string, client_ip string, want string")
    got = admission.attach_ip_rules(df, rules).select("i", "want", admission.ip_verdict().alias("v")).orderBy("i").collect()
    assert [(r.i, r.v) for r in got] == [(r.i, r.want) for r in got] and len(got) == len(rows)


def test_rules_with_bad_patterns(spark):
    rows = [("p", r, i, "string", "scalar", x) for i, (r, x) in enumerate([("a", "(["), ("b", "[0-9]+"), ("c", None), ("d", ""), ("e", "*"), ("b", "x(?:y)")])]
    df = spark.createDataFrame(rows, "project_id string, reference_id string, ord int, data_type string, metric_shape string, regex string")
    df = df.selectExpr("*", "false AS allow_negative", "false AS allow_float", "1D AS min_value", "2D AS max_value")
    assert {r.reference_id: r.regex for r in metrics.usable_rules(df).collect()} == {"a": None, "b": "x(?:y)", "c": None, "d": "", "e": None}


def test_limits_and_null_projects(spark):
    """One stack under the limits of three projects, and without a project."""
    stack = "com.x.A: m\n\tat com.x.A.a(A.java:1)\n\tat com.x.A.b(A.java:2)"
    rows = spark.createDataFrame([(i, p, "java", "E", stack) for i, p in enumerate(["p", "q", "r", None])], "i int, project_id string, language string, kind string, stack string")
    settings = spark.createDataFrame([("p", 2, 8), ("q", 3, 1)], "project_id string, parser_max_lines int, max_frames int").selectExpr(
        "*", "'modern' AS mode", "'terminal_cause_frames' AS segment_selection", "true AS include_error_kind", "'bounded' AS raw_stack_policy", "100 AS raw_stack_max_bytes", "true AS include_function", "true AS include_module", "true AS include_file", "'include' AS runtime_frame_policy", "'keep' AS adjacent_frame_policy"
    )
    none = spark.createDataFrame([], "project_id string, position int, field string, matcher string, pattern string")
    got = grouping.group_errors(rows, languages=("java",), policies=grouping.policies(settings, none)).orderBy("i").collect()
    assert [r.outcome for r in got] == ["raw_fallback:too_many_lines", "frames:1", "frames:2", "frames:2"]
    assert got[2].group_hash == got[3].group_hash and len({r.group_hash for r in got}) == 3


def test_required_literals():
    """Every match of a pattern holds one of the texts."""
    for pattern, want in [
        (r"(Edg)/([0-9]+)", ["edg/"]), (r"(?:ab|CDE)xyz(q)?", ["xyz"]), (r"(abc|defg)", ["abc", "defg"]), (r"\(Foo[(]bar", ["(foo(bar"]), (r"a.*", ["a"]), (r"(?i)(Opera) v", ["opera v"]), (r"(?:x|)", [""]), (r"(?:Mobile)+ S", ["mobile"]), ("([", [""]), ("", [""]),
        (r"(?<name>abcd)\d", ["abcd"]), (r"(?x) a b c", [""]), (r"(?:longer|b)(?:abc|abd)", ["ab"]),
    ]:
        got = agents.required_literals(pattern)
        assert got == want, (pattern, got)


def test_user_agent_rules(spark):
    """Groups that are not groups, first matches of each section, templates, and strings without a rule."""
    rules = [
        ("browser", 5, r"(?:Mozilla|X)/.*\((\w+)\)", None, None, None, False), ("browser", 1, r"(Foo|Foolish)/(?:v|)([0-9]+)?(?:\.([0-9]+))?", "$1 by $1 $2", None, None, False), ("browser", 0, r"Foo/9[)]", "Nine", None, None, False),
        ("os", 0, r"(\(W)(in)", "${2}dows $1", "$2", "", False), ("os", 1, "Lin", "Linux", None, None, False), ("device", 1, "Foo", "Spider", None, None, True), ("device", 0, "Lin", "PC", None, None, False), ("device", 2, r"([", "bad", None, None, True),
    ]
    texts = ["Mozilla/5 (Lin) Foo/v3.4", "Mozilla/5 (abc)", "Foolish/.7", "Foo/9) (Win", "nothing", "", "FOO/1"]
    df = spark.createDataFrame([(t,) for t in [*texts, None, texts[0]]], "user_agent string")
    got = {r.user_agent: (r.browser, r.browser_version, r.os, r.os_version, r.bot) for r in agents.match_rules(agents.ua_dictionary(df), spark.createDataFrame(rules[:-1], agents.RULE_SCHEMA)).collect()}
    assert got == {
        texts[0]: ("Foo by Foo $2", "3.4", "Linux", "", False), texts[1]: ("abc", "", "", "", False), texts[2]: ("Foolish by Foolish $2", "", "", "", True), texts[3]: ("Nine", "", "indows (W", "in", True),
        texts[4]: ("", "", "", "", False), texts[5]: ("", "", "", "", False), texts[6]: ("", "", "", "", False),
    }


def test_user_agent_rules_by_brute_force(spark):
    """1,200 rules against each of their strings: the index loses no match, and the plan has no nested loop."""
    import re

    from beaconry.plans.web import product_rules
    from beaconry.sources.fixtures import load

    rules = product_rules()
    strings = agents.ua_dictionary(load(spark, "/root/testdata/sf0.001", "fx_agents"))
    indexed = agents.index_rules(spark.createDataFrame(rules, agents.RULE_SCHEMA))
    pairs = agents.candidates(strings, indexed).where(F.expr("user_agent RLIKE pattern"))
    got = {(r.user_agent, r.section, r.rule_idx) for r in pairs.collect()}
    compiled = [(r[0], r[1], re.compile(r[2].replace("(?<name>", "(?P<name>"))) for r in rules]
    assert got == {(r.user_agent, section, i) for r in strings.collect() for section, i, p in compiled if p.search(r.user_agent)}
    assert "NestedLoop" not in pairs._jdf.queryExecution().toString() and "Cartesian" not in pairs._jdf.queryExecution().toString()


def test_routes(spark):
    for url, want in [(None, "/"), ("  ", "/"), ("https://a.b/x/y/?q#z", "/x/y"), ("https://a.b", "/"), ("x?y", "/x"), ("/a//#b", "/a"), ("host:80/x", "/80/x")]:
        assert one(spark, fn.normalize_route(F.lit(url).cast("string"))) == want


def test_json_shape(spark):
    for text, depth, nodes in [("5", 0, 1), ("[]", 0, 1), ("[1]", 1, 2), ('{"a":[1,{"b":2}]}', 3, 5), ('{"a":"[[,,{"}', 1, 2)]:
        v = one(spark, F.struct(*[c.alias(n) for c, n in zip(metrics.json_shape(F.lit(text)), "bdn", strict=True)]))
        assert (v.d, v.n) == (depth, nodes)


def test_debounce_fold(spark):
    rows = [(i, "v", "u", "page_leave" if i % 2 else "pageview", t * 1000, False) for i, t in enumerate([0, 3, 5, 6, 11])] + [(9, "v", "u", "pageview", 5500, True), (10, "v", None, "pageview", 100, False), (11, "v", "", "pageview", 200, False), (12, "v", "u", "other", 1, False)]
    df = spark.createDataFrame(rows, "request_id long, visitor string, url string, event string, received_ms long, has_errors boolean")
    assert sorted(r.request_id for r in dedupe.debounce(df).where("kept").collect()) == [0, 2, 4, 9, 10, 12]


def brute_debounce(times, window=5000):
    last, kept = None, []
    for ms, i in sorted(times):
        if last is None or ms - last >= window:
            last = ms
            kept.append(i)
    return kept


def test_debounce_of_busy_keys(spark):
    """Keys without a gap, with ties, and with gaps about a window long, cut into pieces of several lengths."""
    import random

    r = random.Random(2)
    by = {"dense": [i * 7 for i in range(9000)], "ties": [r.randint(0, 60) * 1000 for _ in range(800)], "edge": [i * 5000 + r.randint(-1, 1) for i in range(300)], "sparse": [r.randint(0, 10**7) for _ in range(300)], "one": [1234]}
    rows = [(n, v, ms) for n, (v, ms) in enumerate((v, ms) for v, own in by.items() for ms in own)]
    df = spark.createDataFrame(rows, "request_id long, visitor string, received_ms long").withColumns({"event": F.lit("pageview"), "url": F.lit(None).cast("string")})
    want = sorted(i for v in by for i in brute_debounce([(ms, n) for n, x, ms in rows if x == v]))
    for piece in (5000, 7001, 60_000):
        assert sorted(x.request_id for x in dedupe.debounce(df, piece_ms=piece).where("kept").collect()) == want
    assert dedupe.debounce(df.limit(0)).count() == 0


def test_debounce_of_a_million_events(spark):
    """One key, a million events and no gap: no task holds a piece of more than a minute."""
    df = spark.range(1_000_000).select(F.col("id").alias("request_id"), F.lit("v").alias("visitor"), F.lit("u").alias("url"), F.lit("pageview").alias("event"), (F.col("id") * 3).alias("received_ms"))
    kept = dedupe.debounce(df).where("kept").selectExpr("request_id * 3 AS ms")
    step = -(-5000 // 3) * 3
    assert kept.count() == -(-3_000_000 // step)
    assert kept.where(f"ms % {step} <> 0").count() == 0


def test_chunk_set_by_brute_force():
    import random

    r = random.Random(8)
    for _ in range(60):
        seen, kept = dedupe.ChunkSet(), []
        for _ in range(80):
            lo = r.choice([None, *range(12)])
            c = (r.choice([None, *"abcdefgh"]) if r.random() < 0.3 else None, r.choice([None, *range(14)]), lo, None if r.random() < 0.1 or lo is None else lo + r.randint(-1, 4))
            dup = any((c[0] is not None and k[0] == c[0]) or (c[1] is not None and k[2] is not None and k[3] is not None and k[2] <= c[1] <= k[3]) for k in kept)
            assert seen.offer(*c) is not dup
            if not dup:
                kept.append(c)
        assert all(a <= b for a, b in zip(seen.starts, seen.ends, strict=True)) and all(b + 1 < a for b, a in zip(seen.ends, seen.starts[1:], strict=False))


def test_long_chunk_stream(spark):
    """100,000 chunks in one stream, each sent twice, out of order."""
    n = 100_000
    rows = spark.range(2 * n).select(F.lit("p").alias("project_id"), F.lit("s").alias("session_id"), F.lit("w").alias("window_id"), F.lit("g").alias("generation"), F.col("id").alias("chunk"), F.col("id").alias("received_ms"), F.concat(F.lit("b"), F.col("id") % n * 7 % n).alias("batch_id"), (F.col("id") * 7 % n).alias("sequence"))
    out = dedupe.dedupe_chunks(rows.withColumns({"first_sequence": F.col("sequence"), "last_sequence": F.col("sequence")}))
    assert [tuple(r) for r in out.where("kept").agg(F.count(F.lit(1)), F.max("chunk")).collect()] == [(n, n - 1)]


def test_dedupe_chunks_fold(spark):
    rows = [("p", "s", "w", "g", 1, 1, "b1", 1, 1, 1), ("p", "s", "w", "g", 2, 2, "b1", 2, 2, 2), ("p", "s", "w", "g", 3, 3, "b2", 2, 2, 4), ("p", "s", "w", "g", 4, 4, None, 3, 3, 3)]
    df = spark.createDataFrame(rows, "project_id string, session_id string, window_id string, generation string, received_ms long, chunk long, batch_id string, sequence long, first_sequence long, last_sequence long")
    assert sorted(r.chunk for r in dedupe.dedupe_chunks(df).where("kept").collect()) == [1, 3]


def test_strict_collect(spark):
    from beaconry.sources.requests import parse_request

    bodies = ['{"server_id":"s","data":{}}', '{"server_id":"s","data":{},"odd":1}', "[1]", None, '{"token":"t","server_id":"s","data":{}}', "", "null", "{}"]
    bodies += ['{"server_id":"s","data":{}}' + x for x in ("}", " 1", ",{}", "],[{}", "},{}", "] x")]
    df = spark.createDataFrame(list(enumerate(bodies)), "request_id long, body string")
    assert [r.malformed for r in parse_request(df, "collect").orderBy("request_id").collect()] == [False] + [True] * 13
    good = [' {"server_id":"s","data":{"a":[{"b":1} ]}}\n', '{"server_id":"],[","data":{}}', '{"server_id":"}]","data":{}}']
    df = spark.createDataFrame(list(enumerate(good)), "request_id long, body string")
    assert [r.malformed for r in parse_request(df, "collect").collect()] == [False] * 3


def test_compacted_logs(spark, tmp_path):
    """A log reads the same before and after compactions, batches that are not whole or come twice included."""
    from beaconry.streaming import jobs

    schema = spark.createDataFrame([], "k long, v string, tags array<string>").schema
    path, want = f"{tmp_path}/x", {}
    assert jobs.latest(spark, schema, path, ["k"]).count() == 0 and jobs.compact(spark, schema, path, ["k"]) == -1

    def put(n: int, rows: dict) -> None:
        spark.createDataFrame([(k, v, [v or "-"]) for k, v in rows.items()], schema).write.mode("overwrite").parquet(f"{path}/log/batch={n}")
        want.update(rows)

    def same() -> bool:
        return {r.k: (r.v, r.tags) for r in jobs.latest(spark, schema, path, ["k"]).collect()} == {k: (v, [v or "-"]) for k, v in want.items()}

    rng, upto = random.Random(5), []
    for n in range(7):
        some = {k: rng.choice(["a", "b", None]) for k in rng.sample(range(12), 4)}
        put(n, some)
        assert same()
        if n in (1, 2, 5):
            begun = jobs.latest(spark, schema, path, ["k"])
            upto.append(jobs.compact(spark, schema, path, ["k"]))
            assert begun.count() == len(want) and same()
            assert jobs.compact(spark, schema, path, ["k"]) == upto[-1] and same()
    assert upto == [0, 1, 4] and sorted(p.name for p in (tmp_path / "x/base").iterdir()) == ["batch=1", "batch=4"]
    assert sorted(p.name for p in (tmp_path / "x/log").iterdir()) == [f"batch={n}" for n in range(2, 7)]
    put(6, some)  # the newest batch once more
    # A batch whose writer failed and a base that is not whole do not count.
    spark.createDataFrame([(0, "bad", None)], schema).write.parquet(f"{path}/log/batch=7")
    (tmp_path / "x/log/batch=7/_SUCCESS").unlink()
    spark.createDataFrame([(0, "bad", None, 9)], "k long, v string, tags array<string>, _batch long").write.parquet(f"{path}/base/batch=9")
    (tmp_path / "x/base/batch=9/_SUCCESS").unlink()
    assert same()


def test_replay_faults(spark):
    cases = [(3, 1.0, '{"source":9,"id":1,"type":0,"property":"p","args":[]}', None), (3, 1.0, '{"source":9,"id":1,"type":0,"property":"p"}', "missing commands"), (3, -1.0, "{}", "bad timestamp"), (8, 1.0, "{}", "unknown type"), (3, 1.0, '{"source":0,"texts":{},"attributes":[],"removes":[],"adds":[]}', "missing texts"), (5, 1.0, None, "missing data")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, kind int, ts double, text string, want string")
    for r in df.select("want", replay.event_fault(F.col("kind"), F.col("ts"), F.lit(None).cast("double"), F.try_parse_json("text")).alias("got")).collect():
        assert r.got == r.want


def test_context(spark):
    assert one(spark, web.merge_context(F.lit("{}"), F.lit('{"a":1}'))) == '{"a":1}'
    assert one(spark, web.merge_context(F.lit("1"), F.lit('{"a":1}'))) == '{"a":1,"request":1}'


def _tree(levels):
    node = '{"type":3,"id":1,"textContent":"x"}'
    for _ in range(levels - 1):
        node = f'{{"type":2,"id":1,"tagName":"p","attributes":{{"a":"b","n":1.5,"t":true,"z":null}},"childNodes":[{node}]}}'
    return node


def test_replay_members(spark):
    snap = lambda node, offset='{"top":0,"left":1.5}': f'{{"node":{node},"initialOffset":{offset}}}'
    adds = lambda node: f'{{"source":0,"texts":[{{"id":1,"value":null}}],"attributes":[{{"id":1,"attributes":{{"a":null,"style":{{"x":"1","y":["1","important"],"z":false}}}}}}],"removes":[{{"parentId":1,"id":2}}],"adds":[{{"parentId":1,"nextId":null,"node":{node}}}]}}'
    cases = [
        (2, snap(_tree(3)), None), (2, snap(_tree(3), "{}"), "bad initialOffset"), (2, snap("{}"), "bad node"), (2, snap(_tree(32)), None), (2, snap(_tree(33)), "too_deep"), (2, snap(_tree(9).replace('"x"', "5")), "bad node"),
        (2, snap('{"type":0,"id":1,"childNodes":[{"type":1,"id":2,"name":"html","publicId":"","systemId":""},{"type":4,"id":3,"textContent":""},{"type":5,"id":4,"textContent":"c"}]}'), None),
        (2, snap('{"type":0,"id":1,"childNodes":[{"type":4,"id":3,"textContent":"x"}]}'), "bad node"), (2, snap('{"type":0,"id":1,"childNodes":[null]}'), "bad node"), (2, snap('{"type":6,"id":1}'), "bad node"), (2, snap(_tree(2).replace("true", "false")), "bad node"),
        (3, adds(_tree(2)), None), (3, adds("{}"), "bad adds"), (3, adds(_tree(33)), "too_deep"), (3, adds(_tree(2)).replace('"nextId":null,', ""), "bad adds"), (3, adds(_tree(2)).replace('"value":null', '"valu":1'), "bad texts"), (3, adds(_tree(2)).replace('"z":false', '"z":true'), "bad attributes"), (3, adds(_tree(2)).replace('"parentId":1,"id":2', '"id":2'), "bad removes"),
        (3, '{"source":1,"positions":[{"x":1,"y":2.5,"id":3,"timeOffset":-5}]}', None), (3, '{"source":6,"positions":[{"x":1,"y":2}]}', "bad positions"), (3, '{"source":12,"positions":[{"x":"1","y":2,"id":3,"timeOffset":0}]}', "bad positions"), (3, '{"source":"1","positions":[]}', "unknown source"),
        (3, '{"source":2,"type":10,"id":1,"pointerType":2}', None), (3, '{"source":2,"type":10,"id":1,"pointerType":3}', "bad pointerType"), (3, '{"source":2,"type":"1","id":1}', "bad type"), (3, '{"source":2,"type":1,"id":1,"pointerType":null}', None), (3, '{"source":3,"id":1.5,"x":1,"y":1}', "bad id"), (3, '{"source":4,"width":"1","height":1}', "bad width"),
        (3, '{"source":5,"id":1,"text":"","isChecked":"no"}', "bad isChecked"), (3, '{"source":7,"type":4,"id":1,"muted":1}', "bad muted"), (3, '{"source":8,"adds":[{"rule":"a{}","index":[0,1]}],"removes":[{"index":3}]}', None), (3, '{"source":8,"removes":[{}]}', "bad removes"), (3, '{"source":9,"id":1,"type":0,"commands":[{"property":"p"}]}', "bad commands"),
        (3, '{"source":9,"id":1,"type":0,"commands":[],"property":"p"}', "bad commands"), (3, '{"source":10,"family":"f","fontSource":"s","buffer":0}', "bad buffer"), (3, '{"source":13,"index":[-1]}', "bad index"), (3, '{"source":13,"index":[0],"set":{"property":"p","value":null}}', None), (3, '{"source":14,"ranges":[{"start":1,"startOffset":0,"end":2}]}', "bad ranges"),
        (3, '{"source":15,"id":1,"styleIds":[1],"styles":[{"styleId":1,"rules":[{"rule":"r"}]}]}', None), (3, '{"source":15,"id":1,"styleIds":["1"]}', "bad styleIds"), (3, '{"source":16,"define":{}}', "bad define"), (4, '{"href":1,"width":1,"height":1}', "bad href"), (5, '{"tag":"t","payload":null}', None), (6, '{"plugin":1,"payload":1}', "bad plugin"),
        (7, '{"asset":1}', "missing url"), (7, '{"url":"u","payload":{"rr_type":"CssText","cssTexts":["a"]}}', None), (7, '{"url":"u","payload":{"rr_type":"Blob","data":[]}}', None), (7, '{"url":"u","payload":{"rr_type":"Blob"}}', "bad payload"), (7, '{"url":"u","failed":{"status":404,"message":"m"}}', None), (7, '{"url":"u","failed":{"status":70000,"message":"m"}}', "bad failed"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, kind int, text string, want string")
    got = df.select("text", "want", replay.event_fault(F.col("kind"), F.lit(1.0), F.lit(None).cast("double"), F.try_parse_json("text")).alias("got")).collect()
    assert [(r.text[:80], r.got) for r in got] == [(r.text[:80], r.want) for r in got]


def test_flag_sessions_any_vital(spark):
    from beaconry.plans import sessions
    from beaconry.sources.fixtures import load

    sf, least = "/root/testdata/sf0.01", {"LCP": 4000, "FCP": 3000, "INP": 500, "CLS": 0.25, "TTFB": 1800, "FID": 300}
    rows = load(spark, sf, "fx_vitals").select("request_id", "session_id", "metric", "value", "received_ms").collect()
    gone = {r.request_id for r in rows if r.metric not in least}
    last = {}
    for r in rows:
        if r.request_id not in gone and r.value >= least[r.metric]:
            last[r.session_id] = max(last.get(r.session_id, 0), r.received_ms)
    first = {(r.project_id, r.session_id): r.first_ms for r in sessions.sessions(spark, sf).collect()}
    got = {(r.project_id, r.session_id): r.has_poor_vitals for r in sessions.q_flag_sessions(spark, sf).collect()}
    assert got == {(p, k): p == "p1" and last.get(k, -1) >= at for (p, k), at in first.items()}
    assert sum(got.values()) == 33


def test_filters_of_all_events(spark):
    from beaconry.plans import sessions
    from beaconry.sources.fixtures import load

    sf = "/root/testdata/sf0.001"
    events = load(spark, sf, "fx_web").where("session_id IS NOT NULL").selectExpr("request_id", "received_ms", "'p' || cast(raw_user % 3 AS string) AS project_id", "session_id", "ua_idx").collect()
    by = {}
    for r in sorted(events, key=lambda r: r.received_ms):
        by.setdefault((r.project_id, r.session_id), []).append((r.received_ms, None if r.request_id % 3 == 0 else f"B{r.ua_idx}"))
    at = {(r.project_id, r.session_id, r.chunk): r.received_ms for r in sessions.kept_chunks(spark, sf).collect()}
    got = {(r.project_id, r.session_id, r.chunk): r.browser for r in sessions.q_asof_filter(spark, sf).collect()}
    assert got == {(p, k, c): [b for t, b in by[p, k] if t <= ms][-1] for (p, k, c), ms in at.items()}
    first = {(r.project_id, r.session_id): r.first_ms for r in sessions.sessions(spark, sf).collect()}
    counts = {(r.project_id, r.session_id): r.filter_events for r in sessions.q_filter_events(spark, sf).collect()}
    assert counts == {k: sum(t >= ms for t, _ in by[k]) for k, ms in first.items()}


def test_quarantine_replay_of_dead_letters(spark):
    from beaconry.plans import web as plans
    from beaconry.sources import requests as src

    sf = "/root/testdata/sf0.001"
    dead = sorted((r.received_ms, r.request_id) for r in plans.q_quarantine(spark, sf).collect())
    want = [i for _, i in dead if i % 26][:50]
    assert want and sorted(r.request_id for r in plans.q_quarantine_replay(spark, sf).collect()) == sorted(want)
    held = spark.createDataFrame([(1, 0), (2, 13_600_000), (3, 13_599_999), (4, 90_000_000)], "request_id long, received_ms long").withColumn("created_at", F.timestamp_millis("received_ms"))
    now = spark.createDataFrame([(100_000_000,)], "m long").select(F.timestamp_millis("m").alias("now"))
    assert [r.request_id for r in src.quarantine_replay(held, held.limit(0), now).collect()] == [2, 4]


def test_streams_equal_batches(spark):
    """Debounced events with missing URLs and errors, in batches that go on from a checkpoint, against the batch fold."""
    from beaconry.streaming import jobs

    rows = [(i, "v" if i % 3 else "w", None if i % 4 == 0 else "" if i % 4 == 1 else "u", ["pageview", "page_leave", "other"][i % 5 % 3], i * 900, i % 7 == 0) for i in range(60)]
    df = spark.createDataFrame(rows, "request_id long, visitor string, url string, event string, received_ms long, has_errors boolean").withColumn("received_at", F.timestamp_millis("received_ms"))
    path = jobs.feed(spark, df, "debounce", lambda stream, path: jobs.run_to_end(jobs.debounce_stream(stream), path), batches=3)
    want = sorted(r.request_id for r in dedupe.debounce(df).where("kept").collect())
    assert sorted(r.request_id for r in spark.read.parquet(f"{path}/out").collect()) == want and 0 < len(want) < 60


def test_chunk_objects(spark, tmp_path):
    """Objects come with their names when the whole job has ended; a failing task leaves none, and a second run replaces them."""
    from beaconry.sources import objects

    path = str(tmp_path / "o")
    rows = spark.createDataFrame([(f"g/s{i % 3}/{i}.json.zst", f'[{{"id":{i}}}]') for i in range(40)] + [("g/empty.json.zst", None)], "object_key string, body string").repartition(5)
    bad = rows.union(spark.createDataFrame([("../out", "[]")], "object_key string, body string"))
    with pytest.raises(Exception, match="no object key"):
        objects.write_chunk_objects(bad, path)
    assert not [f for f in (tmp_path / "o").rglob("*") if f.is_file()] and not (tmp_path / "out").exists()
    for _ in range(2):
        objects.write_chunk_objects(rows, path)
        got = {r.object_key: r.body for r in objects.read_chunk_objects(spark, path).collect()}
        assert got == {r.object_key: r.body or "[]" for r in rows.collect()}
    assert not [f for f in (tmp_path / "o").rglob("*") if f.is_file() and not f.name.endswith(".zst")]


def test_person_streams(spark):
    """Replace, unset and clear in three batches, an empty one among them, against the batch folds."""
    from beaconry.operators import persons
    from beaconry.streaming import jobs

    rows = [("p", "e", 1, "a@x", False, {"k": "1", "l": "2"}, False, [], ["d1"]), ("p", "e", 2, None, False, {"k": "3"}, False, ["l"], ["d2"]), ("p", "f", 3, "b@x", False, {"k": "9"}, False, [], ["d1"]),
            ("p", "e", 900, None, True, {"m": "4", "n": "5"}, True, ["n"], []), ("p", "f", 901, None, False, None, False, ["k"], ["d2"]), ("p", "e", 902, "c@x", False, {}, False, [], [])]
    schema = "project_id string, external_id string, seq long, email string, clear_email boolean, traits map<string,string>, replace_traits boolean, unset_traits array<string>, distinct_ids array<string>"
    df = spark.createDataFrame(rows, schema).withColumn("received_at", F.timestamp_millis("seq"))
    folds = lambda x: jobs.person_streams(x, {"email": "clear_email"})

    def run(stream, path):
        for name, (fold, _) in folds(stream).items():
            jobs.run_updates(fold, f"{path}/{name}")

    path = jobs.feed(spark, df, "persons", run, batches=3)
    got = {name: jobs.latest(spark, fold.schema, f"{path}/{name}", key) for name, (fold, key) in folds(df).items()}
    plain = lambda x: sorted(map(tuple, x.collect()))
    traits = plain(persons.current_traits(got["trait_writes"], got["trait_replacements"]))
    assert traits == plain(persons.fold_traits(df)) == [("p", "e", "m", "4")]
    assert plain(got["persons"]) == plain(persons.fold_persons(df, {"email": "clear_email"})) == [("p", "e", "c@x", 4), ("p", "f", "b@x", 2)]
    assert plain(got["aliases"]) == [("p", "d1", "f"), ("p", "d2", "f")]


def test_sinks_and_billing(spark, tmp_path):
    """A batch that is written again replaces its rows; a session that returns days later is not billed again."""
    from beaconry.sources.requests import write_tables
    from beaconry.streaming import jobs

    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "datasource string, request_id long").withColumn("created_at", F.timestamp_millis("request_id"))
    for batch in (rows, rows, rows.where("request_id = 1")):
        write_tables(batch, str(tmp_path / "t"), {"a": ["request_id", "created_at"], "b": ["request_id", "created_at"]}, 7)
    write_tables(rows, str(tmp_path / "t"), {"a": ["request_id", "created_at"]}, 8)
    assert sorted(r.request_id for r in spark.read.json(str(tmp_path / "t/a")).collect()) == [1, 1, 3]
    day = 86_400_000
    chunks = spark.createDataFrame([("p", "s", i, i * 2 * day) for i in range(6)] + [("p", "t", 9, 9 * day), ("p", "t", 8, 8 * day)], "project_id string, session_id string, chunk long, ms long")
    rows = chunks.select("project_id", "session_id", "chunk", F.timestamp_millis("ms").alias("received_at"))
    path = jobs.feed(spark, rows, "billing", lambda stream, path: jobs.run_to_end(jobs.first_billing_stream(stream), path), batches=4)
    assert sorted(r.session_id for r in spark.read.parquet(f"{path}/out").collect()) == ["s", "t"]


def _changes_by_hand(rows, fields, filled):
    """Rows (key, at, side, tie, is_final, values) in order of time, against the rules as a plain loop over one window at a time."""
    out = {}
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: r[1:4])
        first = min((r[1] for r in mine if r[2] == 1), default=None)
        if first is None:
            continue
        latest, state, filters, done = None, dict.fromkeys(fields), 0, None
        for _, at, side, _, is_final, values in mine:
            values = dict(zip(fields, values, strict=True))
            if side == 0:
                latest = values
            elif side == 1:
                values |= {f: values[f] if values[f] is not None else (latest or {}).get(f) for f in filled}
            if at >= first:
                state |= {f: v for f, v in values.items() if v is not None}
                filters += side == 0
                done = at if is_final and done is None else done
        out[key] = (*[state[f] for f in fields], filters, done is not None, done)
    return out


def test_session_changes_out_of_order(spark):
    """Chunks, filters and empty finals: in batch and as a stream whose rows come out of order, against a plain loop.

    Null keys and fields, ties of time, windows without a chunk, a busy window over many pieces, rows without a time.
    """
    import random

    from beaconry.operators import replay
    from beaconry.streaming import jobs

    fields, filled, rnd = ["identifier", "browser"], ["browser"], random.Random(7)
    some = lambda *xs: rnd.choice(xs)
    rows = []
    for i in range(400):
        window = some("w0", "w0", "w0", "w1", None)
        side = some(0, 0, 1, 1, 2) if window != "w1" else some(0, 2)
        values = (None, None) if side == 2 else (some(None, f"i{i}"), some(None, f"b{i}"))
        rows.append((("p", "s", window), 864_000_000 + rnd.randrange(40) * 20_000, side, i if side < 2 else 0, side == 2 or (side == 1 and i % 50 == 0), values))
    want = _changes_by_hand(rows, fields, filled)
    schema = "project_id string, session_id string, window_id string, received_ms long, request_id long, chunk long, is_final boolean, identifier string, browser string"
    table = lambda side: spark.createDataFrame([(*k, at, tie, tie, final, *v) for k, at, s, tie, final, v in rows if s == side] + [("p", "s", "w0", None, 9, 9, True, "x", "x")], schema)
    chunks, filters, finals = table(1), table(0), table(2).select("project_id", "session_id", "window_id", "received_ms")
    df = replay.change_rows(chunks, filters, finals, fields)
    plain = lambda x: {tuple(r[:3]): tuple(r[3:]) for r in x.collect()}
    folded = replay.fold_changes(replay.settle_changes(df, fields, filled), fields)
    assert plain(folded) == want and len(want) == 2

    arrived = df.withColumn("received_at", F.timestamp_millis("at")).withColumn("arrived_at", F.timestamp_millis(F.expr("abs(hash(at, tie, side)) % 1000")))
    end = spark.createDataFrame([(13 * 86_400_000, 1, 0, False)], "at long, side int, tie long, is_final boolean").withColumns({"received_at": F.timestamp_millis("at"), "arrived_at": F.timestamp_millis(F.lit(1999))})
    path = jobs.feed(spark, arrived.unionByName(end, allowMissingColumns=True), "changes", lambda stream, path: jobs.run_changes(stream, path, fields, filled), batches=4, by="arrived_at")
    assert plain(jobs.latest(spark, folded.schema, f"{path}/sessions", jobs.SESSION_KEY)) == want


def test_changes_of_nothing(spark):
    from beaconry.operators import replay

    none = spark.createDataFrame([], "project_id string, session_id string, window_id string, received_ms long, request_id long, chunk long, is_final boolean, browser string")
    folded = replay.fold_changes(replay.settle_changes(replay.change_rows(none, none, none, ["browser"]), ["browser"], ["browser"]), ["browser"])
    assert folded.collect() == []
    held = spark.createDataFrame([("p", "s", None, 3, "own", False)], "project_id string, session_id string, window_id string, event_count long, browser string, is_complete boolean")
    one = none.unionByName(spark.createDataFrame([("p", "s", None, 5, 1, 1, True, "b")], none.schema))
    folded = replay.fold_changes(replay.settle_changes(replay.change_rows(one, none, none, ["browser"]), ["browser"], []), ["browser"])
    row = replay.with_changes(held, folded).first().asDict()
    assert row == {"project_id": "p", "session_id": "s", "window_id": None, "event_count": 3, "browser": "b", "filter_events": 0, "is_complete": True, "finalized_ms": 5}


def test_web_event_rows(spark):
    """Known fields come out of data only; agents go over data unless they say nothing; missing maps are empty."""
    from beaconry.operators import web

    shape = "request_id long, data map<string,string>, properties map<string,string>, project_id string, user_id string, person_id string, external_id string, is_identified boolean, session_id string, country string, cookieless boolean, received_ms long, agent_browser string, agent_browser_version string, agent_device string, agent_os string, agent_os_version string"
    rows = [
        (1, {"event": '"view"', "browser": '"Own"', "device": '"Own"', "page": "7", "session_duration": "2.0", "odd": "1"}, {"event": '"kept"', "odd": "0", "time_on_page": "1.5"}, "p", "u", None, None, None, "s", "DE", True, 5, "Firefox", "", "", None, "1"),
        (2, None, None, "p", "u", "q", "x", True, None, None, None, None, None, None, None, None, None),
    ]
    a, b = web.build_web_event(spark.createDataFrame(rows, shape), keep=["request_id"]).orderBy("request_id").collect()
    assert (a.event, a.browser, a.browser_version, a.device, a.os, a.os_version, a.page, a.session_duration, a.time_on_page) == ("view", "Firefox", None, "Own", None, "1", None, 2, None)
    assert a.properties == '{"event":"kept","odd":1,"session_duration":2.0,"time_on_page":1.5}' and a.is_identified is False
    assert (b.event, b.browser, b.properties, b.is_identified, b.created_at) == (None, None, "{}", True, None)

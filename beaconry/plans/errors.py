"""Queries of errors: stacks, frames, groups and mappings."""

from __future__ import annotations

from pyspark.sql import functions as F

from beaconry.functions import scalars as fn
from beaconry.operators import grouping, mapping, stacks, usage
from beaconry.sources.fixtures import load, oracle

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = oracle(sql)
        return f

    return add


_REL = "coalesce(item_build, request_build, '')"


def occurrences(spark, sf_dir):
    return grouping.build_occurrences(load(spark, sf_dir, "fx_errors"))


@query(f"SELECT request_id, language, {_REL} AS release, coalesce(handled, false) AS handled, cast(greatest(CASE WHEN n < 0 THEN 1 ELSE n END, 0) AS BIGINT) AS count FROM @fx_errors@")
def q_occurrences(spark, sf_dir):
    return occurrences(spark, sf_dir).select("request_id", "language", "release", "handled", "count")


_ID = "sha256(language || chr(31) || stack)"


@query(f"WITH d AS (SELECT DISTINCT language, stack FROM @fx_errors@), l AS (SELECT {_ID} AS stack_id, unnest(string_split(stack, chr(10))) AS raw, unnest(range(0, len(string_split(stack, chr(10))))) AS i FROM d) SELECT stack_id, cast(i AS INTEGER) AS line_no, trim(raw, ' ' || chr(9)) AS line, cast(length(raw) - length(ltrim(raw, ' ' || chr(9))) AS INTEGER) AS indent FROM l")
def q_stack_lines(spark, sf_dir):
    return stacks.split_stack(stacks.stack_dictionary(load(spark, sf_dir, "fx_errors"))).select("stack_id", "line_no", "line", "indent")


# What each language's template parses to, by hand: segment, relation, kind, frame, function (N: the user's digit), module, file.
_EXPECTED = {
    "java": [(1, 0, "java.lang.IllegalStateException", "com.shop.CartN.total", None, "Cart.java"), (1, 0, None, "java.util.ArrayList.forEach", None, "ArrayList.java"), (1, 0, None, "com.shop.Main$1.run", None, "Main.java"), (2, 1, "java.io.IOException", "com.shop.DiskN.read", None, "Disk.java"), (2, 1, None, "java.util.ArrayList.forEach", None, "ArrayList.java"), (2, 1, None, "com.shop.Main$1.run", None, "Main.java")],
    "javascript": [(1, 0, "TypeError", "loadN", None, "/release/src/app-N.js"), (1, 0, None, "Worker", None, "node:internal/workers"), (1, 0, None, "run", None, "https://cdn.example.com/assets/main.0123456789ab.js"), (1, 0, None, "save", None, "https://x.example.com/src/save.js")],
    "python": [(1, 0, "ValueError", "totalN", None, "/srv/app/cart.py"), (1, 0, None, "main", None, "/srv/app/main.py"), (2, 1, "OSError", "read", None, "/srv/app/io.py")],
    "php": [(1, 0, "RuntimeException", "Shop\\Cart->totalN", None, "/var/www/src/Cart.php"), (1, 0, None, "Shop\\Run->call", None, None), (1, 0, None, "{main}", None, None)],
    "go": [(1, 0, "panic", "main.(*Cart).TotalN", None, "/go/src/shop/cart.go"), (1, 0, None, "runtime.main", None, "/usr/local/go/src/runtime/proc.go"), (1, 0, None, "main.start", None, "/go/src/shop/main.go")],
    "rust": [(1, 0, "panic", "std::panicking::begin_panic", None, None), (1, 0, None, "shop::cart::totalN::h0123456789abcdef", None, "/build/src/cart.rs"), (1, 0, None, "shop::main", None, "./src/main.rs")],
    "swift": [(1, 0, "Fatal error", "totalN()", "shop", "/src/shop/Cart.swift"), (1, 0, None, "main", "shop", "/src/shop/main.swift")],
}


def _expected(language: str) -> str:
    quote = lambda s: "NULL" if s is None else "'" + s + "'"
    n = "replace({}, 'N', cast(raw_user % 10 AS string))"
    rows, kind, at, last = [], None, 0, 0
    for seg, rel, k, f, m, file in _EXPECTED[language]:
        at = at + 1 if seg == last else 0
        kind = k or kind
        last = seg
        named = lambda s: "cast(NULL AS string)" if s is None else n.format(quote(s)) if "N" in s.replace("Native", "") else quote(s)
        rows.append(f"SELECT stack_id, {seg} AS seg, {rel} AS relation, {quote(kind)} AS kind, {at} AS frame, {named(f)} AS function, cast({quote(m)} AS string) AS module, {named(file)} AS file FROM d")
    return f"WITH d AS (SELECT DISTINCT {_ID} AS stack_id, raw_user FROM @fx_errors@ WHERE language = '{language}') " + " UNION ALL ".join(rows)


def _frames(language):
    def q(spark, sf_dir):
        lines = stacks.split_stack(stacks.stack_dictionary(load(spark, sf_dir, "fx_errors").where(F.col("language") == language)))
        out = stacks.frame_rows(stacks.PARSERS[language](lines))
        return out.select("stack_id", F.col("seg").cast("int").alias("seg"), "relation", "kind", "frame", "function", "module", "file")

    q.__name__ = {"javascript": "q_frames_js"}.get(language, f"q_frames_{language}")
    return q


for _language in stacks.PARSERS:
    query(_expected(_language))(_frames(_language))


@query("""WITH d AS (SELECT DISTINCT sha256(language || chr(31) || stack) AS stack_id FROM @fx_errors@ WHERE language = 'java') SELECT stack_id, 3 AS frames, 'java.util.ArrayList.forEach' AS shared_first, 'com.shop.Main$1.run' AS shared_last FROM d""")
def q_frames_java_shared(spark, sf_dir):
    lines = stacks.split_stack(stacks.stack_dictionary(load(spark, sf_dir, "fx_errors").where("language = 'java'")))
    cause = stacks.java(lines).where("relation = 1")
    return cause.select("stack_id", F.size("frames").alias("frames"), F.get("frames", F.lit(1))["function"].alias("shared_first"), F.get("frames", F.lit(2))["function"].alias("shared_last"))


# The frames that count for the default policy, normalised by hand: function, module, file.
_USED = {
    "java": [("com.shop.DiskN.read", None, "Disk.java"), ("com.shop.Main$anon.run", None, "Main.java")],
    "javascript": [("loadN", None, "src/app-N.js"), ("run", None, "main.<hash>.js"), ("save", None, "src/save.js")],
    "python": [("read", None, "app/io.py")],
    "php": [("shop\\cart->totalN", None, "src/cart.php"), ("shop\\run->call", None, None), ("{main}", None, None)],
    "go": [("main.(*Cart).TotalN", None, "src/shop/cart.go"), ("main.start", None, "src/shop/main.go")],
    "rust": [("shop::cart::totalN", None, "src/cart.rs"), ("shop::main", None, "src/main.rs")],
    "swift": [("totalN()", "shop", "src/shop/Cart.swift"), ("main", "shop", "src/shop/main.swift")],
}


def _bytes(s: str | None) -> str:
    if s is None:
        return "unhex('00')"
    text = f"replace('{s}', 'N', cast(raw_user % 10 AS string))" if "N" in s else f"'{s}'"
    return f"unhex('01') || unhex(printf('%016x', octet_length(encode({text})))) || encode({text})"


def _hash_sql() -> str:
    parts = []
    for language, frames in _USED.items():
        head = f"unhex(printf('%016x', 29)) || encode('error-grouping/fingerprint/v1') || unhex('{stacks.LANGUAGES[language]:02x}') || unhex('00') || unhex('10') || unhex('00') || unhex('00')"
        body = " || ".join(f"unhex('20') || {_bytes(f)} || {_bytes(m)} || {_bytes(file)}" for f, m, file in frames)
        parts.append(f"WHEN '{language}' THEN 'eg1_' || sha256({head} || {body} || unhex('2f') || unhex('ff'))")
    return "CASE language " + " ".join(parts) + " END"


@query("WITH d AS (SELECT DISTINCT language, raw_user % 10 AS n FROM @fx_errors@) " + " UNION ALL ".join(f"SELECT '{lang}' AS language, n, {i} AS frame, " + ", ".join((f"replace('{x}', 'N', cast(n AS string))" if x and "N" in x else f"'{x}'" if x else "cast(NULL AS string)") + f" AS {c}" for c, x in zip(("function", "module", "file"), f, strict=True)) + f" FROM d WHERE language = '{lang}'" for lang, fs in _USED.items() for i, f in enumerate(fs)))
def q_frames_norm(spark, sf_dir):
    errors = load(spark, sf_dir, "fx_errors")
    parsed = stacks.parse_stacks(stacks.stack_dictionary(errors))
    cause = F.array_max(F.transform(F.filter("segments", lambda s: s["relation"].isin(1, 2)), lambda s: F.struct((-s["depth"]).alias("d"), s["seg"].alias("seg"), s.alias("s"))))["s"]
    df = parsed.withColumn("frames", F.coalesce(cause, F.get("segments", F.lit(0)))["frames"]).withColumn("normal", grouping.normalize_frames(F.col("language"), F.col("frames")))
    used = df.select("language", "stack", F.posexplode(grouping.selected_frames(grouping.policy_column(grouping.Policy()))).alias("frame", "f"))
    digits = errors.select("language", "stack", (F.col("raw_user") % 10).alias("n")).distinct()
    return used.join(digits, ["language", "stack"]).select("language", "n", "frame", "f.function", "f.module", "f.file").distinct()


def grouped(spark, sf_dir):
    return grouping.group_errors(occurrences(spark, sf_dir))


@query(f"SELECT request_id, {_hash_sql()} AS group_hash FROM @fx_errors@")
def q_fingerprint(spark, sf_dir):
    return grouped(spark, sf_dir).select("request_id", "group_hash")


@query("SELECT language, 'frames:' || CASE language WHEN 'java' THEN '2' WHEN 'javascript' THEN '3' WHEN 'python' THEN '1' WHEN 'php' THEN '3' ELSE '2' END AS outcome, count(*) AS n FROM @fx_errors@ GROUP BY 1")
def q_outcomes(spark, sf_dir):
    return grouped(spark, sf_dir).groupBy("language", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH g AS (SELECT *, {_hash_sql()} AS group_hash, sha256(kind || chr(31) || message || chr(31) || stack) AS x, CASE WHEN n < 0 THEN 1 ELSE n END AS c FROM @fx_errors@) SELECT project_id, group_hash, cast(sum(c) AS BIGINT) AS occurrences, count(DISTINCT x) AS variants, min(received_ms) AS first_ms, max(received_ms) AS last_ms FROM g GROUP BY 1, 2")
def q_error_groups(spark, sf_dir):
    return usage.error_groups(grouped(spark, sf_dir))


# Bytes of a fingerprint: its head with the kind, and a segment.
def _kind_bytes(kind: str) -> str:
    return f"unhex('01') || unhex(printf('%016x', octet_length(encode({kind})))) || encode({kind})"


_KIND = "CASE WHEN language = 'php' THEN lower(kind) ELSE kind END"
_HEAD = "unhex(printf('%016x', 29)) || encode('error-grouping/fingerprint/v1') || unhex(CASE language " + " ".join(f"WHEN '{k}' THEN '{v:02x}'" for k, v in stacks.LANGUAGES.items()) + " END)"
_KIND_ONLY = f"'eg1_' || sha256({_HEAD} || {_kind_bytes(_KIND)} || unhex('1000002fff'))"
_RAW = f"'eg1_' || sha256({_HEAD} || {_kind_bytes(_KIND)} || unhex('40') || unhex('0000000000000008') || unhex(printf('%016x', octet_length(encode(stack)))) || unhex(printf('%016x', octet_length(encode(stack)))) || encode(stack) || unhex('ff'))"


@query(f"""SELECT request_id, coalesce(message, '') AS error_message, coalesce(stack, '') AS stacktrace, sha256(kind || chr(31) || coalesce(message, '') || chr(31) || coalesce(stack, '')) AS exact_hash,
 CASE WHEN trim(coalesce(stack, '')) = '' THEN {_KIND_ONLY} WHEN stack = 'not a stack' THEN {_RAW} ELSE {_hash_sql()} END AS group_hash,
 CASE WHEN trim(coalesce(stack, '')) = '' THEN 'kind_only:empty' WHEN stack = 'not a stack' THEN 'raw_fallback:unrecognized' ELSE 'frames:' || CASE language WHEN 'java' THEN '2' WHEN 'javascript' THEN '3' WHEN 'python' THEN '1' WHEN 'php' THEN '3' ELSE '2' END END AS outcome,
 coalesce(session_id, '') AS session_id, '' AS sdk_name FROM @fx_error_gaps@""")
def q_error_gaps(spark, sf_dir):
    out = grouping.group_errors(grouping.build_occurrences(load(spark, sf_dir, "fx_error_gaps")))
    return out.select("request_id", "error_message", "stacktrace", "exact_hash", "group_hash", "outcome", "session_id", "sdk_name")


# Functions of each language's root and terminal cause, normalised by hand, and the cause's kind.
_BOTH = {
    "java": (["com.shop.CartN.total", "com.shop.Main$anon.run"], ["com.shop.DiskN.read", "com.shop.Main$anon.run"], "java.io.IOException"),
    "python": (["totalN", "main"], ["read"], "OSError"),
}


def _functions(names: list[str]) -> str:
    return " || ".join(f"unhex('20') || {_bytes(f)} || unhex('0000')" for f in names)


def _both_sql() -> str:
    parts = []
    for language in _USED:
        root, cause, kind = _BOTH.get(language, ([f for f, _, _ in _USED[language]], None, None))
        more = f" || unhex('1001') || {_bytes(kind)} || {_functions(cause)} || unhex('2f')" if cause else ""
        parts.append(f"WHEN '{language}' THEN 'eg1_' || sha256({_HEAD} || {_kind_bytes(_KIND)} || unhex('100000') || {_functions(root)} || unhex('2f'){more} || unhex('ff'))")
    return "CASE language " + " ".join(parts) + " END"


def _first_sql() -> str:
    return "CASE language " + " ".join(f"WHEN '{k}' THEN 'eg1_' || sha256({_HEAD} || unhex('00') || unhex('100000') || unhex('20') || {_bytes(v[0][0])} || {_bytes(v[0][1])} || {_bytes(v[0][2])} || unhex('2fff'))" for k, v in _USED.items()) + " END"


@query(f"""SELECT request_id, CASE right(project_id, 1) WHEN '0' THEN {_KIND_ONLY} WHEN '1' THEN {_first_sql()} WHEN '2' THEN {_both_sql()} WHEN '3' THEN CASE WHEN language = 'rust' THEN 'eg1_' || sha256({_HEAD} || unhex('00') || unhex('100000') || unhex('20') || {_bytes("shop::cart::totalN")} || {_bytes(None)} || {_bytes("src/cart.rs")} || unhex('2fff')) ELSE {_hash_sql()} END ELSE {_hash_sql()} END AS group_hash FROM @fx_errors@""")
def q_project_grouping(spark, sf_dir):
    chosen = grouping.policies(load(spark, sf_dir, "fx_grouping"), load(spark, sf_dir, "fx_exclusions"))
    return grouping.group_errors(occurrences(spark, sf_dir), policies=chosen).select("request_id", "group_hash")


_D = "cast(raw_user % 10 AS string)"


# What the older hash reads of each template, worked out by hand: the kind, then a line each.
_LEGACY = {
    "java": ["java.lang.illegalstateexception", "at com.shop.cartN.total(cart.java)", "at app//com.shop.main$<num>.run(main.java)", "caused by: java.io.ioexception: io <num>", "at com.shop.diskN.read(disk.java)"],
    "javascript": ["typeerror", "typeerror: bad <num>", "at async loadN app-<num>.js)", "at new worker workers)", "at run (main.<hash>.js)", "save@save.js"],
    "php": ["runtimeexception", "php fatal error: uncaught runtimeexception: bad <num> in /a.php:<num>", "stack trace:", "# <php-frame> cart.php: shop\\cart->totalN(<args>)", "#<num> [internal function]: shop\\run->call()", "#<num> {main}"],
    "rust": ["panic", "bad", "shop::cart::totalN", "at src/cart.rs", "shop::main", "at src/main.rs"],
}


@query("SELECT request_id, CASE language " + " ".join(f"WHEN '{k}' THEN sha256(replace('" + "' || chr(10) || '".join(v) + f"', 'N', {_D}))" for k, v in _LEGACY.items()) + " END AS legacy_hash FROM @fx_errors@")
def q_legacy_group(spark, sf_dir):
    return grouping.legacy_group_hash(load(spark, sf_dir, "fx_errors")).select("request_id", "legacy_hash")


_LEGACY_HASH = "CASE language " + " ".join(f"WHEN '{k}' THEN sha256(replace('" + "' || chr(10) || '".join(v) + f"', 'N', {_D}))" for k, v in _LEGACY.items()) + f" ELSE {_hash_sql()} END"
_FRAMES = "'frames:' || CASE language WHEN 'java' THEN '2' WHEN 'javascript' THEN '3' WHEN 'python' THEN '1' WHEN 'php' THEN '3' ELSE '2' END"


# By project: the older hash; too many lines; too large; a line too long, and no raw stacks; the usual limits, without a setting.
@query(f"""SELECT request_id, CASE right(project_id, 1) WHEN '0' THEN {_LEGACY_HASH} WHEN '1' THEN {_RAW} WHEN '2' THEN {_RAW} WHEN '3' THEN {_KIND_ONLY} ELSE {_hash_sql()} END AS group_hash,
 CASE right(project_id, 1) WHEN '0' THEN CASE WHEN language IN ('java', 'javascript', 'php', 'rust') THEN 'legacy' ELSE {_FRAMES} END WHEN '1' THEN 'raw_fallback:too_many_lines' WHEN '2' THEN 'raw_fallback:input_too_large' WHEN '3' THEN 'kind_only:line_too_long' ELSE {_FRAMES} END AS outcome FROM @fx_errors@""")
def q_parser_limits(spark, sf_dir):
    none = load(spark, sf_dir, "fx_exclusions").where("false")
    chosen = grouping.policies(load(spark, sf_dir, "fx_limits"), none)
    return grouping.group_errors(occurrences(spark, sf_dir), policies=chosen).select("request_id", "group_hash", "outcome")


# Builds have the same names in all projects; one project does not know one of them, and one has mappings of its own.
_BUILDS = ["b0", "r1", "r2"]
_KNOWN = f"({_REL} IN ('b0', 'r1', 'r2') AND NOT ({_REL} = 'r1' AND right(project_id, 1) = '3'))"


def builds(spark, sf_dir):
    known = F.col("release").isin(_BUILDS) & ~((F.col("release") == "r1") & (F.right("project_id", F.lit(1)) == "3"))
    return occurrences(spark, sf_dir).where(known).select("project_id", "release").distinct()


@query(f"SELECT request_id, {_REL} AS release FROM @fx_errors@ WHERE language IN ('java', 'javascript') AND {_KNOWN}")
def q_known_builds(spark, sf_dir):
    return mapping.known_builds(occurrences(spark, sf_dir), builds(spark, sf_dir)).select("request_id", "release")


def _each_build(keys):
    """keys with each project and build, and the name that the project's mappings begin with."""
    projects = F.explode(F.array(*[F.lit(f"00000000-0000-4000-8000-{i:012d}") for i in range(5)]))
    out = keys.withColumn("project_id", projects).withColumn("build", F.explode(F.array(*map(F.lit, _BUILDS))))
    return out.withColumn("alt", F.right("project_id", F.lit(1)) == "1")


def mapping_lines(spark, sf_dir):
    """Mapping text of each build: one class a nation key below ten; the second method of each holds for all later lines there are."""
    keys = _each_build(load(spark, sf_dir, "nation").where("n_nationkey < 10").select(F.col("n_nationkey").alias("k")))
    real = F.when(F.col("alt"), "alt").otherwise("real")
    text = F.concat(real, F.lit(".Cart -> com.shop.Cart"), "k", F.lit(':\n# {"fileName":"RealCart.java","id":"sourceFile"}\n    int count -> a\n    1:5000:void early(int):7:9 -> total\n    5001:4294967295:void late() -> total\n'), real, F.lit(".Disk -> com.shop.Disk"), "k", F.lit(":\n    void read() -> read\n"), real, F.lit(".Oops -> java.io.IOException:"))
    return keys.select("project_id", "build", F.posexplode(F.split(text, "\n")).alias("i", "text"), "k").select("project_id", "build", (F.col("k") * 100 + F.col("i")).alias("line_no"), "text")


def mappable_stacks(spark, sf_dir, language):
    able = mapping.known_builds(occurrences(spark, sf_dir), builds(spark, sf_dir)).where(F.col("language") == language)
    return able.select(F.sha2(F.concat_ws("\x1f", "language", "stack"), 256).alias("stack_id"), "project_id", F.col("release").alias("build"), "stack").distinct()


_REAL = "CASE right(project_id, 1) WHEN '1' THEN 'alt' ELSE 'real' END"
_MAPPED_JAVA = f"""'java.lang.IllegalStateException: bad ' || cast(request_id AS string) || chr(10) || '    at ' || {_REAL} || '.Cart.' || CASE WHEN request_id = 0 THEN 'early' WHEN request_id <= 5000 THEN 'early' ELSE 'late' END || '(RealCart.java:' || cast(request_id AS string) || ')' || chr(10) || '    at java.util.ArrayList.forEach(ArrayList.java:1511)' || chr(10) || '    at app//com.shop.Main$1.run(Main.java:10)' || chr(10)
 || 'Caused by: ' || {_REAL} || '.Oops: io ' || cast(request_id AS string) || chr(10) || '    at ' || {_REAL} || '.Disk.read(Unknown Source:' || cast(request_id AS string) || ')' || chr(10) || '    ... 2 more'"""


@query(f"SELECT DISTINCT {_ID} AS stack_id, project_id, {_REL} AS build, {_MAPPED_JAVA} AS mapped_stacktrace, 'r8:' || {_REL} AS mapping_used FROM @fx_errors@ WHERE language = 'java' AND {_KNOWN}")
def q_retrace(spark, sf_dir):
    return mapping.retrace(mappable_stacks(spark, sf_dir, "java"), *mapping.mapping_tables(mapping_lines(spark, sf_dir)))


def js_tokens(spark, sf_dir):
    """Decoded positions: a named token at column 0 and an unnamed one at column 6 of every fourth line of each script."""
    lines = load(spark, sf_dir, "events").where("event_id % 4 = 0").select((F.col("event_id") - 1).cast("long").alias("line")).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9))))
    base = _each_build(lines.where("line % 10 = k OR line % 5 = 3")).withColumn("file", F.concat(F.lit("app-"), "k", F.lit(".js")))
    source = F.concat(F.when(F.col("alt"), "alt/").otherwise("src/"), "file", F.lit(".ts")).alias("source")
    at = lambda c, name: base.select("project_id", "build", "file", "line", F.lit(c).alias("col"), source, (F.col("line") + 10).alias("src_line"), F.lit(c + 1).alias("src_col"), F.lit(name).cast("string").alias("name"))
    return at(0, "early").unionByName(at(6, None))


_MAPS_JS = "request_id % 4 = 0 AND ((request_id - 1) % 10 = raw_user % 10 OR (request_id - 1) % 5 = 3)"
_MAPPED_JS = f"replace(stack, '/release/src/app-' || {_D} || '.js:' || cast(request_id AS string) || ':7', CASE right(project_id, 1) WHEN '1' THEN 'alt' ELSE 'src' END || '/app-' || {_D} || '.js.ts:' || cast(request_id + 10 AS string) || ':8')"


@query(f"""SELECT DISTINCT {_ID} AS stack_id, project_id, {_REL} AS build, {_MAPPED_JS} AS mapped_stacktrace, 'javascript:' || {_REL} AS mapping_used FROM @fx_errors@ WHERE language = 'javascript' AND {_KNOWN} AND {_MAPS_JS}""")
def q_map_js(spark, sf_dir):
    return mapping.map_js_frames(mappable_stacks(spark, sf_dir, "javascript"), js_tokens(spark, sf_dir))


def _mapped_hash(language: str, frames: list[tuple]) -> str:
    body = " || ".join(f"unhex('20') || {_bytes(f)} || {_bytes(m)} || {_bytes(x)}" for f, m, x in frames)
    return f"'eg1_' || sha256(unhex(printf('%016x', 29)) || encode('error-grouping/fingerprint/v1') || unhex('{stacks.LANGUAGES[language]:02x}') || unhex('00') || unhex('10') || unhex('00') || unhex('00') || {body} || unhex('2f') || unhex('ff'))"


# The frames of the mapped templates that count, by hand: of the project with mappings of its own, and of the others.
_MAPPED_FRAMES = {
    ("java", True): [("alt.Disk.read", None, "Unknown Source"), ("com.shop.Main$anon.run", None, "Main.java")],
    ("java", False): [("real.Disk.read", None, "Unknown Source"), ("com.shop.Main$anon.run", None, "Main.java")],
    ("javascript", True): [("loadN", None, "app-N.js.ts"), ("run", None, "main.<hash>.js"), ("save", None, "src/save.js")],
    ("javascript", False): [("loadN", None, "src/app-N.js.ts"), ("run", None, "main.<hash>.js"), ("save", None, "src/save.js")],
}
_MAPPED_HASH = "CASE " + " ".join(f"WHEN language = '{k}' AND (right(project_id, 1) = '1') = {alt} THEN {_mapped_hash(k, f)}" for (k, alt), f in _MAPPED_FRAMES.items()) + " END"


@query(f"""WITH e AS (SELECT *, {_KNOWN} AND (language = 'java' OR {_MAPS_JS}) AS m, CASE language WHEN 'java' THEN {_MAPPED_JAVA} ELSE {_MAPPED_JS} END AS t, {_REL} AS rel FROM @fx_errors@ WHERE language IN ('java', 'javascript'))
 SELECT request_id, CASE WHEN m THEN {_MAPPED_HASH} ELSE {_hash_sql()} END AS group_hash, sha256(kind || chr(31) || message || chr(31) || CASE WHEN m THEN t ELSE stack END) AS exact_hash, CASE WHEN m THEN t END AS mapped_stacktrace, CASE WHEN m THEN CASE language WHEN 'java' THEN 'r8:' ELSE 'javascript:' END || rel END AS mapping_used FROM e""")
def q_enriched_errors(spark, sf_dir):
    able = ("java", "javascript")
    group = lambda df: grouping.group_errors(df, languages=able)
    rows = group(occurrences(spark, sf_dir).where(F.col("language").isin(*able))).withColumn("stack_id", F.sha2(F.concat_ws("\x1f", "language", "stack"), 256))
    mapped = q_retrace(spark, sf_dir).unionByName(q_map_js(spark, sf_dir))
    return mapping.enrich_occurrences(rows, mapped, group).select("request_id", "group_hash", "exact_hash", "mapped_stacktrace", "mapping_used")

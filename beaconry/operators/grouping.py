"""Error groups: occurrences, normalised frames, fingerprints and the older group hash."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.functions import scalars as fn
from beaconry.operators.web import merge_context
from beaconry.operators.stacks import LANGUAGE_ALIASES, LANGUAGES, MAX_BYTES, MAX_LINE_BYTES, MAX_LINES, default_limits, parse_stacks, stack_dictionary

# The domain and tags of the fingerprint's byte layout.
DOMAIN = "error-grouping/fingerprint/v1"
SEGMENT, FRAME, END_SEGMENT, RAW, END = "10", "20", "2f", "40", "ff"
# Names of runtime frames, by the start of their function (or, where said, file or module).
RUNTIME = {
    "java": r"function RLIKE '^(java|javax|jdk|sun|com\\.sun)\\.'",
    "rust": r"function RLIKE '^(<?(std|core|alloc)::|backtrace::|rustc_demangle::|rust_begin_unwind$|__rust|_rust)' OR function LIKE '% as core::ops::function::%'",
    "javascript": r"file RLIKE '^(node:internal/|internal/)' OR function RLIKE '^node:internal/'",
    "python": r"file LIKE '<frozen %'",
    "php": "false",
    "go": r"function RLIKE '^(runtime\\.|runtime/|testing\\.)'",
    "swift": r"module LIKE 'libswift%' OR function RLIKE '^(Swift\\.|swift_|_assertionFailure)'",
}


@dataclass(frozen=True)
class Policy:
    """What of a trace makes its group. segments: terminal, root, root_and_cause or kind_only; exclusions: (how, field, text)."""

    segments: str = "terminal"
    include_kind: bool = True
    raw_bytes: int | None = 1 << 20
    max_frames: int = 8
    fields: tuple[str, ...] = ("function", "module", "file")
    include_runtime: bool = False
    deduplicate: bool = True
    exclusions: tuple[tuple[str, str, str], ...] = ()


def policy_column(p: Policy) -> Column:
    """A policy as a struct, as policies() has one a project."""
    rules = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("how", "field", "text"), r, strict=True)]) for r in p.exclusions]).cast(_RULES)
    flags = [F.lit(n in p.fields).alias(n) for n in ("function", "module", "file")]
    return F.struct(F.lit(p.segments).alias("segments"), F.lit(p.include_kind).alias("include_kind"), F.lit(p.raw_bytes).cast("int").alias("raw_bytes"), F.lit(p.max_frames).alias("max_frames"), *flags, F.lit(p.include_runtime).alias("include_runtime"), F.lit(p.deduplicate).alias("deduplicate"), rules.alias("exclusions"))


_RULES = "array<struct<how:string,field:string,text:string>>"
# Names of the settings table's choices.
_SEGMENTS = {"terminal_cause_frames": "terminal", "root": "root", "root_and_terminal_cause": "root_and_cause", "error_kind_only": "kind_only"}


def policies(settings: DataFrame, exclusions: DataFrame) -> DataFrame:
    """(project_id, mode, policy, limits) from the settings and the exclusion rows (in order of position) of each project.

    limits are the parser's; those that the settings do not have are the usual ones.
    """
    rules = exclusions.groupBy("project_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "matcher", "field", "pattern"))), lambda r: F.struct(r["matcher"].alias("how"), r["field"].alias("field"), r["pattern"].alias("text"))).alias("rules"))
    segments = F.create_map(*[F.lit(x) for kv in _SEGMENTS.items() for x in kv])[F.col("segment_selection")]
    raw = F.when(F.col("raw_stack_policy") == "bounded", F.when(F.col("raw_stack_max_bytes") > 0, F.col("raw_stack_max_bytes")).otherwise(1 << 20)).cast("int")
    policy = F.struct(
        segments.alias("segments"), F.col("include_error_kind").alias("include_kind"), raw.alias("raw_bytes"), F.greatest("max_frames", F.lit(0)).alias("max_frames"), F.col("include_function").alias("function"), F.col("include_module").alias("module"), F.col("include_file").alias("file"),
        (F.col("runtime_frame_policy") == "include").alias("include_runtime"), (F.col("adjacent_frame_policy") == "deduplicate").alias("deduplicate"), F.coalesce("rules", F.array().cast(_RULES)).alias("exclusions"),
    )
    limit = lambda name, usual: F.coalesce(F.col(name).cast("int"), F.lit(usual)) if name in settings.columns else F.lit(usual)
    limits = F.struct(limit("parser_max_input_bytes", MAX_BYTES).alias("bytes"), limit("parser_max_lines", MAX_LINES).alias("lines"), limit("parser_max_line_bytes", MAX_LINE_BYTES).alias("line_bytes"))
    return settings.join(rules, "project_id", "left").select("project_id", "mode", policy.alias("policy"), limits.alias("limits"))


def build_occurrences(errors: DataFrame) -> DataFrame:
    """Occurrence rows: release is the item's build, else the request's; count is at least 1; unknown languages go.

    A stack given as lines is joined; texts that are missing are empty, and so are columns that errors does not have. The
    context is the request's, merged with the item's.
    """
    lang = F.lower(F.coalesce("language", F.lit("java")))
    named = F.coalesce(F.create_map(*[F.lit(x) for kv in LANGUAGE_ALIASES.items() for x in kv])[lang], lang)
    text = lambda *names: F.coalesce(*[F.col(n) for n in names if n in errors.columns], F.lit(""))
    if dict(errors.dtypes).get("stack", "").startswith("array"):
        errors = errors.withColumn("stack", F.array_join("stack", "\n"))
    out = errors.withColumns({"stack": text("stack"), "message": text("message"), "context": merge_context(text_or(errors, "request_context"), F.col("item_context")) if "item_context" in errors.columns else text_or(errors, "request_context")})
    return out.withColumns({
        "language": named, "release": text("item_build", "request_build"), "handled": F.coalesce("handled", F.lit(False)), "environment": F.lit("prod"),
        "count": F.when(F.coalesce("n", F.lit(1)) < 0, 1).otherwise(F.coalesce("n", F.lit(1))).cast("long"), "exact_hash": fn.exact_hash(F.col("kind"), F.col("message"), F.col("stack")),
        "error_type": F.col("kind"), "error_message": F.col("message"), "stacktrace": F.col("stack"), "mapped_stacktrace": F.lit(None).cast("string"), "mapping_used": F.lit(None).cast("string"),
        "identifier": text("identifier"), "session_id": text("item_session", "session_id"), "window_id": text("window_id"), "sdk_name": text("sdk_name"), "sdk_version": text("sdk_version"),
    }).where(F.col("language").isin(list(LANGUAGES)))


def text_or(df: DataFrame, name: str, default: str = "{}") -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)


def normalize_function(language: Column, f: Column) -> Column:
    t = F.nullif(fn.trimmed(f), F.lit(""))
    java = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\$\$Lambda\$[0-9a-fA-FxX/]*", r"\$\$Lambda"), r"\$Proxy[0-9]+", r"\$Proxy"), r"\$[0-9]+", r"\$anon")
    return F.when(language == "rust", F.regexp_replace(t, "::h[0-9a-fA-F]{16,}$", "")).when(language == "java", java).when(language == "php", F.lower(t)).otherwise(t)


def normalize_file(language: Column, f: Column) -> Column:
    """A path's stable end: from its package root, else its last source root, else its name."""
    t = F.regexp_replace(F.regexp_replace(fn.trimmed(f), "[?#].*$", ""), r"[/\\]+$", "")
    path = F.regexp_replace(F.when(t.contains("\\"), F.lower(F.replace(t, F.lit("\\"), F.lit("/")))).otherwise(t), "^/+", "")
    package = F.regexp_extract(path, "^(?:.*/)?((?:node_modules|packages|crates)/.+)$", 1)
    root = F.regexp_extract(path, "^(?:.*/)?((?:src|tests|test|app|lib|crates|packages)(?:/.*)?)$", 1)
    end = F.when(package != "", package).when(root != "", root).otherwise(F.regexp_extract(path, "([^/]*)$", 1))
    hashed = F.regexp_replace(end, r"(?<![^.-])(?=[0-9a-fA-F]*[0-9])(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{12,}(?![^.-])", "<hash>")
    return F.when(t != "", F.when(language == "php", F.lower(end)).when(language == "javascript", hashed).otherwise(end))


def normalize_frames(language: Column, frames: Column) -> Column:
    """Frames with normalised names and whether they are the runtime's."""
    runtime = "CASE language " + " ".join(f"WHEN '{k}' THEN coalesce({v}, false)" for k, v in RUNTIME.items()) + " ELSE false END"
    for name in ("function", "module", "file"):
        runtime = runtime.replace(f"{name} ", f"f.{name} ")
    marked = F.transform(frames, lambda f: F.struct(normalize_function(language, f["function"]).alias("function"), F.when(language == "php", F.lower(fn.blank_to_null(f["module"]))).otherwise(fn.blank_to_null(f["module"])).alias("module"), normalize_file(language, f["file"]).alias("file")))
    flags = F.expr(f"transform(frames, f -> {runtime})")
    return F.zip_with(marked, flags, lambda m, r: F.struct(m["function"].alias("function"), m["module"].alias("module"), m["file"].alias("file"), r.alias("runtime")))


def _excluded(f: Column, rule: Column) -> Column:
    value = F.when(rule["field"] == "function", f["function"]).when(rule["field"] == "module", f["module"]).otherwise(f["file"])
    text, how = rule["text"], rule["how"]
    return F.coalesce(F.when(how == "exact", value == text).when(how == "prefix", F.startswith(value, text)).when(how == "suffix", F.endswith(value, text)).when(how == "contains", F.contains(value, text)), F.lit(False))


def selected_frames(policy: Column) -> Column:
    """The frames of column `normal` that count: runtime, exclusions, empty identities (then adjacent repeats and the limit)."""
    c = F.col("normal")
    c = F.when(~policy["include_runtime"] & F.exists(c, lambda f: ~f["runtime"]), F.filter(c, lambda f: ~f["runtime"])).otherwise(c)
    c = F.filter(c, lambda f: ~F.exists(policy["exclusions"], lambda rule: _excluded(f, rule)))
    picked = F.transform(c, lambda f: F.struct(*[F.when(policy[n], f[n]).alias(n) for n in ("function", "module", "file")]))
    return F.filter(picked, lambda f: F.coalesce(f["function"], f["module"], f["file"]).isNotNull())


def _field(b: Column) -> Column:
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(b).cast("long")), 16, "0")), b)


def _opt(s: Column) -> Column:
    b = F.encode(s, "UTF-8")
    return F.when(s.isNull(), F.unhex(F.lit("00"))).otherwise(F.concat(F.unhex(F.lit("01")), _field(b)))


def _tag(h: str) -> Column:
    return F.unhex(F.lit(h))


def _segment(relation: Column, kind: Column, frames: Column | None) -> Column:
    body = [_tag(SEGMENT), F.unhex(F.lpad(F.hex(relation.cast("long")), 2, "0")), _opt(kind)]
    if frames is not None:
        body.append(F.aggregate(frames, F.lit(b""), lambda a, f: F.concat(a, _tag(FRAME), _opt(f["function"]), _opt(f["module"]), _opt(f["file"]))))
    return F.concat(*body, _tag(END_SEGMENT))


def fingerprints(stacks: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Parsed stacks (stack_id, language, kind, stack, status, segments) with group_hash and outcome.

    One row a stack and reported kind: its chosen segments' frames, else a bounded part of the raw stack, else the kind.
    A column `policy` (see policies) has each row's own policy.
    """
    own = F.col("policy")
    cause = F.array_max(F.transform(F.filter("segments", lambda s: s["relation"].isin(1, 2)), lambda s: F.struct((-s["depth"]).alias("d"), s["seg"].alias("seg"), s.alias("s"))))["s"]
    df = stacks if "policy" in stacks.columns else stacks.withColumn("policy", policy_column(policy))
    df = df.withColumns({"parsed": (F.col("status") == "ok") & F.col("segments").isNotNull(), "sdk_kind": fn.blank_to_null(F.col("kind")), "cause": cause, "root": F.get("segments", F.lit(0))})
    terminal, both = own["segments"] == "terminal", own["segments"] == "root_and_cause"
    kind_only = (own["segments"] == "kind_only") | ~(own["function"] | own["module"] | own["file"])
    df = df.withColumn("chosen", F.when(terminal, F.coalesce("cause", "root")).otherwise(F.col("root")))

    def kept(df: DataFrame, source: Column, name: str) -> DataFrame:
        none = F.array().cast("array<struct<function:string,module:string,file:string>>")
        out = df.withColumn("frames", F.coalesce(F.when(~kind_only, source["frames"]), none)).withColumn("normal", normalize_frames(F.col("language"), F.col("frames")))
        out = out.withColumn(name, selected_frames(own))
        out = out.withColumn(name, F.expr(f"filter({name}, (f, i) -> NOT policy.deduplicate OR i = 0 OR NOT (f <=> {name}[i - 1]))"))
        return out.withColumn(name, F.slice(name, F.lit(1), own["max_frames"])).drop("frames", "normal")

    df = kept(kept(df, F.col("chosen"), "used"), F.when(both, F.col("cause")), "cause_used")
    lower = lambda c: F.when(F.col("language") == "php", F.lower(fn.blank_to_null(c))).otherwise(fn.blank_to_null(c))
    told = lambda c: F.when(own["include_kind"], lower(c))
    known = F.when(terminal, F.when(F.size(F.col("chosen")["frames"]) == 0, F.coalesce(F.col("chosen")["kind"], "sdk_kind"))).otherwise(F.coalesce("sdk_kind", F.col("root")["kind"]))
    tag = F.create_map(*[F.lit(x) for k, v in LANGUAGES.items() for x in (k, f"{v:02x}")])[F.col("language")]
    head = lambda k: F.concat(_field(F.encode(F.lit(DOMAIN), "UTF-8")), F.unhex(tag), _opt(k))
    nothing = F.lit(None).cast("string")
    empty_root = _segment(F.lit(0), nothing, None)
    body = _segment(F.when(terminal | (own["segments"] == "kind_only"), 0).otherwise(F.col("root")["relation"]), nothing, F.col("used"))
    with_cause = both & F.col("cause").isNotNull()
    body = F.when(with_cause, F.concat(body, _segment(F.col("cause")["relation"], told(F.col("cause")["kind"]), F.col("cause_used")))).otherwise(body)
    count = F.size("used") + F.when(with_cause, F.size("cause_used")).otherwise(0)
    raw, size, most = F.encode("stack", "UTF-8"), F.octet_length(F.encode("stack", "UTF-8")), own["raw_bytes"]
    half = F.expr("cast(policy.raw_bytes div 2 as int)")
    # Cuts move outward from the middle of a character: continuation bytes start with the bits 10.
    tail = size - (most - half)
    ends = F.concat(_field(F.substring(raw, F.lit(1), half - _over(raw, half, -1))), _field(F.substring(raw, tail + _over(raw, tail, 1) + 1, most)))
    raw_part = F.when(most.isNull(), empty_root).otherwise(F.concat(_tag(RAW), _field(F.unhex(F.lpad(F.hex(size.cast("long")), 16, "0"))), F.when(size <= most, _field(raw)).otherwise(ends)))
    sdk = head(told(F.col("sdk_kind")))
    content = F.when(F.col("parsed"), F.concat(head(told(known)), body)).when(F.col("status") == "empty", F.concat(sdk, empty_root)).otherwise(F.concat(sdk, raw_part))
    why = F.when(F.col("status") == "ok", "unrecognized").otherwise(F.col("status"))
    warned = F.when(F.exists("segments", lambda s: F.coalesce(s["warned"], F.lit(False))), ",warned").otherwise("")
    outcome = F.when(F.col("parsed") & (count > 0), F.concat(F.lit("frames:"), count.cast("string"), warned)).when(F.col("parsed"), F.when(kind_only, "kind_only:policy").otherwise("kind_only:no_usable_frames"))
    outcome = outcome.when(F.col("status") == "empty", "kind_only:empty").otherwise(F.concat(F.when(most.isNotNull(), "raw_fallback:").otherwise("kind_only:"), why))
    hashed = F.concat(F.lit("eg1_"), F.sha2(F.concat(content, _tag(END)), 256))
    return df.withColumn("group_hash", hashed).withColumn("outcome", outcome)


def _over(raw: Column, at: Column, way: int) -> Column:
    """How many bytes a cut at this place has to move (backward or forward) to a character's border."""
    byte = lambda i: F.conv(F.hex(F.substring(raw, i + 1, 1)), 16, 10).cast("int")
    inside = lambda i: F.coalesce(byte(i).between(128, 191), F.lit(False))
    return F.when(~inside(at), 0).when(~inside(at + way), 1).when(~inside(at + 2 * way), 2).otherwise(3)


def group_errors(errors: DataFrame, policy: Policy = Policy(), languages: tuple[str, ...] = tuple(LANGUAGES), policies: DataFrame | None = None) -> DataFrame:
    """Occurrences with group_hash and outcome; each distinct stack is parsed once. languages: those that occur.

    policies has the policies and limits of projects; policy and the usual limits hold for the others, and for errors
    without a project. A project in mode `legacy` keeps the older hash for the languages that have one.
    """
    errors = errors.withColumns({"stack": F.coalesce("stack", F.lit("")), "kind": F.coalesce("kind", F.lit(""))})
    keys, place = ["language", "kind", "stack"], ["language", "stack"]
    if policies is not None:
        keys, place = [*keys, "project_id"], [*place, "limits"]
        errors = errors.join(policies.select("project_id", "limits"), "project_id", "left").withColumn("limits", F.coalesce("limits", default_limits()))
    parsed = parse_stacks(stack_dictionary(errors), languages)
    pairs = errors.select(*keys, *place[2:]).distinct().join(parsed, place)
    if policies is not None:
        pairs = pairs.join(policies.select("project_id", "mode", F.col("policy").alias("own")), "project_id", "left").withColumn("policy", F.coalesce("own", policy_column(policy))).drop("own")
    hashed = fingerprints(pairs, policy)
    if policies is not None:
        old = (F.col("mode") == "legacy") & F.col("legacy_hash").isNotNull()
        # Only the stacks of projects that keep it are given the older hash, and from the errors, not from what was parsed.
        keep = policies.where(F.col("mode") == "legacy").select("project_id")
        hashed = hashed.join(legacy_hashes(errors.join(keep, "project_id", "left_semi")), LEGACY_KEY, "left").withColumns({"group_hash": F.when(old, F.col("legacy_hash")).otherwise(F.col("group_hash")), "outcome": F.when(old, "legacy").otherwise(F.col("outcome"))})
    found = hashed.select(*[F.col(k).alias(f"_{k}") for k in keys], "group_hash", "outcome")
    return errors.join(found, F.expr(" AND ".join(f"{k} <=> _{k}" for k in keys)), "left").drop("limits", *[f"_{k}" for k in keys])


# Replacements of the older group hash, in order, and how many lines of each language it reads.
UUID_RE, HEX_RE, HASHISH_RE = r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", r"(?i)\b0x[0-9a-f]+\b", r"(?i)\b[0-9a-f]{12,}\b"
QUOTED_RE, PHP_QUOTED_RE, NUMBER_RE = "\"[^\"]*\"|'[^']*'|`[^`]*`", "\"[^\"]*\"|'[^']*'", r"\b\d+(?:\.\d+)?\b"
PATH_RE, SPACE_RE = r"(?i)(https?://)?([^/\s)]+/)+([^/\s):]+)", r"\s+"
JAR_RE, JAVA_LINE_RE = r"(?i)\b[A-Za-z0-9._+-]+(?:-\d+(?:\.\d+)*(?:[-+][A-Za-z0-9._-]+)?)?\.jar\b", r"\(([^():]+\.java):\d+\)"
LEGACY_LINES = {"java": 80, "javascript": 50, "php": 80, "rust": 120}


def _chain(c: Column, *steps: tuple[str, str]) -> Column:
    for pattern, to in steps:
        c = F.regexp_replace(c, pattern, to)
    return c


_COMMON = [(UUID_RE, "<uuid>"), (HEX_RE, "<hex>"), (HASHISH_RE, "<hash>")]
_TAIL = [(NUMBER_RE, "<num>"), (SPACE_RE, " ")]


def legacy_piece(language: str, c: Column) -> Column:
    """A kind or line of the older hash, normalised; '' is left out."""
    low = F.lower(fn.trimmed(c))
    if language == "java":
        return _chain(low, *_COMMON, (QUOTED_RE, "<quoted>"), (JAR_RE, "<jar>"), (JAVA_LINE_RE, "($1)"), *_TAIL)
    if language == "javascript":
        return _chain(low, *_COMMON, (QUOTED_RE, "<quoted>"), (r":[0-9]+:[0-9]+(?=[) ]|$)", ""), (r":[0-9]+:[0-9]+(\)?)$", "$1"), (PATH_RE, "$3"), *_TAIL)
    if language == "php":
        frame = r"^#\d+\s+(.+?\.php)\((\d+)\):\s*(.+)$"
        t = fn.trimmed(c)
        call = _chain(F.lower(fn.trimmed(F.regexp_extract(t, frame, 3))), (PHP_QUOTED_RE, "<quoted>"), *_COMMON, (r"\([^)]*\)", "(<args>)"), *_TAIL)
        file = F.lower(F.regexp_replace(F.regexp_extract(t, frame, 1), r"^.*[/\\]", ""))
        return F.when(t.rlike(frame), F.concat(F.lit("# <php-frame> "), file, F.lit(": "), call)).otherwise(_chain(low, *_COMMON, (PHP_QUOTED_RE, "<quoted>"), (PATH_RE, "$3"), *_TAIL))
    bare = fn.trimmed(F.regexp_replace(c, r"\x1b\[[0-?]*[ -/]*[@-~]", ""))
    lower = F.lower(bare)
    meta = lower.isin("", "stack backtrace:", "backtrace:", "caused by:") | lower.startswith("note: run with `rust_backtrace=") | (lower.startswith("thread ") & lower.contains(" panicked at "))
    place = F.regexp_replace(fn.trimmed(F.regexp_replace(bare, "^at ", "")), "^[()]+|[()]+$", "")
    unix = F.replace(F.regexp_replace(F.regexp_replace(place, ":[0-9]+:[0-9]+$", ""), ":[0-9]+$", ""), F.lit("\\"), F.lit("/"))
    toolchain = F.lower(F.replace(place, F.lit("\\"), F.lit("/"))).rlike(r"/rustc/|/\.rustup/toolchains/|/library/(std|core|alloc)/src/")
    end = F.regexp_replace(unix, "^.*/", "")
    for root in ("crates/", "benches/", "examples/", "tests/", "src/"):
        end = F.when(unix.contains(root), F.regexp_extract(unix, f"^.*({root}.*)$", 1)).otherwise(end)
    located = F.when(toolchain, "").otherwise(F.concat(F.lit("at "), _chain(F.lower(fn.trimmed(end)), (HASHISH_RE, "<hash>"), (SPACE_RE, " "))))
    frame = F.regexp_replace(F.regexp_replace(bare, r"^[0-9]+:\s*", ""), r"(?i)^(?:0x[0-9a-f]+\s+-\s+|[0-9a-f]{8,}\s+)", "")
    symbol = _chain(F.lower(fn.trimmed(frame)), (r"(?i)::h[0-9a-f]{16,}\b", ""), *_COMMON, (QUOTED_RE, "<quoted>"), *_TAIL)
    return F.when(meta, "").when(bare.startswith("at "), located).otherwise(symbol)


def _legacy_skips(language: str, x: Column) -> Column:
    bare = F.regexp_replace(x, "^at ", "")
    if language == "java":
        return bare.rlike(r"^(java|javax|sun|com\.sun|jdk)\.") | F.startswith(x, F.lit("..."))
    if language == "php":
        return x.isin("{main}", "{closure}")
    if language == "rust":
        return (bare == "<unknown>") | bare.rlike(r"^(<?(std|core|alloc)::|backtrace::|rustc_demangle::|rust_begin_unwind|__rust_|_rust_)")
    return F.lit(False)


def _piece(language: str):
    return lambda x: legacy_piece(language, x)


def _counts(language: str):
    return lambda x: (x != "") & ~_legacy_skips(language, x)


LEGACY_KEY = ["language", "kind", "stack"]


def legacy_hashes(errors: DataFrame) -> DataFrame:
    """(language, kind, stack, legacy_hash): the older hash of the distinct kinds and stacks of the languages that had one."""
    base = errors.select(*LEGACY_KEY).distinct()
    out = None
    for language, limit in LEGACY_LINES.items():
        lines = F.slice(F.split(F.regexp_replace("stack", "\r?\n$", ""), "\r?\n"), 1, limit)
        kept = F.filter(F.transform(lines, _piece(language)), _counts(language))
        text = F.array_join(F.concat(F.array(legacy_piece(language, F.col("kind"))), kept), "\n")
        part = base.where(F.col("language") == language).select("language", "kind", "stack", F.sha2(text, 256).alias("legacy_hash"))
        out = part if out is None else out.unionByName(part)
    return out


def legacy_group_hash(errors: DataFrame) -> DataFrame:
    """Errors with the older group hash (null for languages that never had it)."""
    return errors.join(legacy_hashes(errors), LEGACY_KEY, "left")

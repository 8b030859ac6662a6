"""Stack traces as tables: lines, then frames of segments per language, by regex classes and windows over the lines.

Every parser takes the lines of its language (stack_id, line_no, line, indent) and gives one row a segment: relation
(0 root, 1 cause, 2 context, 3 suppressed), depth, kind, and its frames (function, module, file), crash-nearest first.
Distinct stacks are parsed once and joined back by their callers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconry.functions.scalars import trimmed

# Bounds of a stack, and the number that stands for each language in fingerprints.
MAX_BYTES, MAX_LINES, MAX_LINE_BYTES, MAX_FRAMES, MAX_SEGMENTS = 1 << 20, 16_384, 64 << 10, 256, 64
LANGUAGES = {"java": 1, "rust": 2, "javascript": 3, "python": 4, "php": 5, "go": 6, "swift": 7}
LANGUAGE_ALIASES = {"js": "javascript", "py": "python", "golang": "go", "rs": "rust"}

FRAME = "struct<function:string,module:string,file:string>"


def default_limits() -> Column:
    return F.struct(F.lit(MAX_BYTES).alias("bytes"), F.lit(MAX_LINES).alias("lines"), F.lit(MAX_LINE_BYTES).alias("line_bytes"))


def stack_dictionary(errors: DataFrame) -> DataFrame:
    """Distinct (language, stack) with stack_id and parse status; the first limit that a stack breaks names it.

    A missing stack is an empty one. A column `limits` has each row's own limits; a stack is in the dictionary once for
    each of those that it comes with.
    """
    own = "limits" in errors.columns
    errors = errors.withColumn("stack", F.coalesce("stack", F.lit(""))).withColumn("limits", F.col("limits") if own else default_limits())
    lines, limits = F.split("stack", "\n"), F.col("limits")
    status = (
        F.when(F.octet_length("stack") > limits["bytes"], "input_too_large")
        .when(trimmed(F.col("stack")) == "", "empty")
        .when(F.size(lines) - F.endswith("stack", F.lit("\n")).cast("int") > limits["lines"], "too_many_lines")
        .when(F.exists(lines, lambda x: F.octet_length(x) > limits["line_bytes"]), "line_too_long")
        .otherwise("ok")
    )
    ident = F.sha2(F.concat_ws("\x1f", "language", "stack", F.when(limits != default_limits(), F.to_json(limits))), 256)
    keys = ["language", "stack", *(["limits"] if own else [])]
    return errors.select("language", "stack", "limits").distinct().select(ident.alias("stack_id"), *keys, status.alias("status"))


def split_stack(stacks: DataFrame) -> DataFrame:
    """stack_id, language, line_no, raw, line (trimmed) and indent of the parsable stacks; a last empty line is none."""
    rows = stacks.where("status = 'ok'").select("stack_id", "language", F.posexplode(F.split(F.regexp_replace("stack", "\r?\n$", ""), "\r?\n")).alias("line_no", "raw"))
    line = trimmed(F.col("raw"))
    return rows.withColumns({"line": line, "indent": F.length("raw") - F.length(F.regexp_replace("raw", r"^\s+", ""))})


def _by() -> Window:
    return Window.partitionBy("stack_id").orderBy("line_no")


def _so_far() -> Window:
    return _by().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _part(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def _kind(c: Column) -> Column:
    return F.nullif(trimmed(F.regexp_replace(trimmed(c), "(?s):.*$", "")), F.lit(""))


def source_file(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(trimmed(c), ":[0-9]+$", ""), ":[0-9]+$", "")


def _frames(condition: Column, order: str = "line_no", reverse: bool = False) -> Column:
    """The first (or, reversed, the most recent) frames of a group in order."""
    rows = F.array_sort(F.collect_list(F.when(condition, F.struct(F.col(order).alias("o"), F.struct("function", "module", "file").alias("f")))))
    only = F.transform(rows, lambda r: r["f"])
    kept = F.slice(F.reverse(only), 1, MAX_FRAMES) if reverse else F.slice(only, 1, MAX_FRAMES)
    return kept.cast(f"array<{FRAME}>")


def java(lines: DataFrame) -> DataFrame:
    line = F.col("line")
    thread = _part(line, r'^Exception in thread "[^"]+" (.+)$')
    cause, suppressed = _part(line, "^Caused by: (.+)$"), _part(line, "^Suppressed: (.+)$")
    body = _part(line, "^at (.+)$")
    callable_ = F.regexp_extract(body, r"^(.*)\(([^(]*)\)$", 1)
    source = F.regexp_extract(body, r"^(.*)\(([^(]*)\)$", 2)
    lambda_ = callable_.contains("$$Lambda$")
    function = F.when(lambda_, callable_).otherwise(F.regexp_replace(callable_, "^.*/", ""))
    module = F.when(~lambda_ & callable_.contains("/"), F.nullif(F.regexp_replace(F.regexp_replace(F.regexp_replace(callable_, "/[^/]*$", ""), "^.*/", ""), "@.*$", ""), F.lit("")))
    is_frame = body.rlike(r"^.*\([^(]*\)$") & function.contains(".")
    header = line.rlike(r"^[\p{L}\p{N}._$]+(:|$)") & (line.contains(":") | F.split(line, ":")[0].contains(".") | line.rlike("(Error|Exception|Throwable)$"))
    df = lines.where("line <> ''").withColumns({"function": function, "module": module, "file": F.when(~source.isin("Native Method", "Unknown Source"), source_file(source)), "is_frame": F.coalesce(is_frame, F.lit(False))})
    named = thread.isNotNull() | cause.isNotNull() | suppressed.isNotNull()
    df = df.withColumn("named", named).withColumn("relevant", named | F.col("is_frame") | (header & body.isNull()))
    df = df.withColumn("first", F.col("relevant") & (F.sum(F.col("relevant").cast("int")).over(_so_far()) == 1))
    df = df.withColumn("start", F.col("named") | F.col("first")).withColumn("seg", F.sum(F.col("start").cast("int")).over(_so_far())).where("seg > 0")
    df = df.withColumns({
        "relation": F.when(F.col("start"), F.when(F.col("seg") == 1, 0).when(cause.isNotNull(), 1).when(suppressed.isNotNull(), 3).otherwise(0)),
        "depth": F.when(F.col("start"), F.when(cause.isNotNull() | suppressed.isNotNull(), F.col("indent")).otherwise(0)),
        "kind": F.when(F.col("start") & ~F.col("is_frame"), _kind(F.coalesce(thread, cause, suppressed, line))),
        "shared": F.expr(r"try_cast(nullif(regexp_extract(line, '^[.]{3} ([0-9]+) more$', 1), '') as int)"),
        "bad": body.isNotNull() & ~F.col("is_frame"),
    })
    segments = df.groupBy("stack_id", "seg").agg(F.max("relation").alias("relation"), F.max("depth").alias("depth"), F.max("kind").alias("kind"), _frames(F.col("is_frame")).alias("frames"), F.coalesce(F.sum("shared"), F.lit(0)).cast("int").alias("shared"), F.bool_or("bad").alias("warned"))
    return java_shared_frames(segments)


def java_shared_frames(segments: DataFrame) -> DataFrame:
    """Segments whose `... n more` are filled from the nearest earlier segment of no greater depth (which may be filled itself)."""
    one = "struct<seg:bigint,relation:int,depth:int,kind:string,frames:array<" + FRAME + ">,warned:boolean>"
    rows = segments.groupBy("stack_id").agg(F.array_sort(F.collect_list(F.struct("seg", "relation", "depth", "kind", "frames", "warned", "shared"))).alias("all"))
    parent = "element_at(filter(a, p -> p.depth <= s.depth), -1).frames"
    fill = f"""aggregate(all, cast(array() as array<{one}>), (a, s) -> concat(a, array(cast(named_struct('seg', s.seg, 'relation', s.relation, 'depth', s.depth, 'kind', s.kind, 'frames',
        slice(CASE WHEN s.shared > 0 AND exists(a, p -> p.depth <= s.depth) THEN concat(s.frames, slice({parent}, greatest(1, size({parent}) - s.shared + 1), s.shared)) ELSE s.frames END, 1, {MAX_FRAMES}), 'warned', s.warned) as {one}))))"""
    return rows.select("stack_id", F.inline(F.expr(fill.replace("element_at(", "try_element_at("))))


def _single(df: DataFrame, kind: Column, is_frame: Column) -> DataFrame:
    """One root segment a stack; kind is aggregated by the caller's rule."""
    out = df.groupBy("stack_id").agg(kind.alias("kind"), _frames(is_frame).alias("frames"), F.bool_or("bad").alias("warned"))
    return out.where("kind IS NOT NULL OR size(frames) > 0").select("stack_id", F.lit(1).cast("long").alias("seg"), F.lit(0).alias("relation"), F.lit(0).alias("depth"), "kind", "frames", "warned")


def javascript(lines: DataFrame) -> DataFrame:
    line = F.col("line")
    df = lines.where("line <> ''").withColumn("n", F.row_number().over(_by()))
    kind = trimmed(F.regexp_replace(line, ":.*$", ""))
    header = (F.col("n") == 1) & F.coalesce(F.split(kind, r"\s")[0].endswith("Error"), F.lit(False))
    body = F.regexp_replace(F.regexp_replace(_part(line, "^at (.+)$"), "^async ", ""), "^new ", "")
    paired = body.rlike(r"^.* \(.*\)$")
    function = F.when(paired, F.nullif(F.regexp_extract(body, r"^(.*) \((.*)\)$", 1), F.lit("")))
    location = F.when(paired, F.regexp_extract(body, r"^(.*) \((.*)\)$", 2)).otherwise(body)
    inside = (location == "native") | location.rlike("^index [0-9]+$")
    good = inside | location.rlike(r"[/\\:]") | location.rlike(r"^[<\[]")
    spider = body.isNull() & line.rlike("^[^@]*@.+$")
    df = df.withColumns({
        "header": header, "kind": F.when(header, F.nullif(kind, F.lit(""))), "is_frame": ~header & F.coalesce(good | spider, F.lit(False)), "bad": ~header & body.isNotNull() & ~F.coalesce(good, F.lit(False)),
        "function": F.when(spider, F.nullif(F.regexp_extract(line, "^([^@]*)@", 1), F.lit(""))).otherwise(function), "module": F.lit(None).cast("string"),
        "file": F.when(spider, source_file(F.regexp_replace(line, "^[^@]*@", ""))).when(~inside, source_file(location)),
    })
    return _single(df, F.max("kind"), F.col("is_frame"))


CONTEXT = "During handling of the above exception, another exception occurred:"
CAUSE = "The above exception was the direct cause of the following exception:"


def python(lines: DataFrame) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace(F.col("line"), r"^\+ (Exception Group Traceback )", "$1"), r"^(\| +)+", "")
    inner = F.col("line") != bare
    df = lines.withColumns({"line": trimmed(bare), "indent": F.when(inner, F.length(F.regexp_extract("line", r"^(?:\| )*( *)", 1))).otherwise(F.col("indent"))}).where("line <> ''")
    line = F.col("line")
    chain = F.when(line == CAUSE, 1).when(line == CONTEXT, 2)
    # Children of an exception group are passed over, from its first +-+ to the next chain sentence.
    mark = F.last(F.when(line.startswith("+-+"), 1).when(chain.isNotNull(), 0), ignorenulls=True).over(_so_far())
    df = df.withColumn("skip", F.coalesce(mark == 1, F.lit(False))).where("NOT skip")
    traceback = line.isin("Traceback (most recent call last):", "Exception Group Traceback (most recent call last):")
    is_frame = line.rlike(r'^File ".*", line [0-9]+(, in .*)?$')
    kind = F.when((F.col("indent") == 0) & line.rlike(r"^[\p{L}\p{N}._]+(:|$)") & ~is_frame & ~traceback & chain.isNull(), _kind(line))
    df = df.withColumns({
        "seg": F.sum((traceback | F.lag(chain.isNotNull(), 1, False).over(_by())).cast("int")).over(_so_far()), "chain": chain, "is_frame": is_frame, "traceback": traceback, "kind": kind, "module": F.lit(None).cast("string"),
        "function": F.when(is_frame, _part(line, r'^File ".*", line [0-9]+, in (.*)$')), "file": F.when(is_frame, _part(line, r'^File "(.*?)", line ')),
    })
    seg = df.groupBy("stack_id", "seg").agg(
        F.max("chain").alias("after"), F.max_by("kind", F.when(F.col("kind").isNotNull(), F.col("line_no"))).alias("kind"), _frames(F.col("is_frame"), reverse=True).alias("frames"), F.bool_or("traceback").alias("traced"),
        F.count(F.lit(1)).alias("n"), F.bool_or(F.col("kind").isNotNull() & line.contains(":")).alias("headed"),
    )
    seg = seg.where("kind IS NOT NULL OR size(frames) > 0")
    everything = Window.partitionBy("stack_id")
    seg = seg.withColumns({"any_traced": F.bool_or("traced").over(everything), "lines": F.sum("n").over(everything)}).where("any_traced OR (headed AND lines = 1)")
    # The last one printed is the root; a chain sentence tells what the one before it is to the next.
    back = F.row_number().over(everything.orderBy(F.desc("seg")))
    out = seg.withColumn("back", back)
    return out.select("stack_id", F.col("back").cast("long").alias("seg"), F.when(F.col("back") == 1, 0).otherwise(F.coalesce("after", F.lit(0))).alias("relation"), F.lit(0).alias("depth"), "kind", "frames", F.lit(False).alias("warned"))


def php(lines: DataFrame) -> DataFrame:
    line = F.col("line")
    kind = _kind(_part(line, "^(?:PHP )?(?:Fatal error: )?Uncaught (.+)$"))
    body = trimmed(_part(line, "^#[0-9]+ (.*)$"))
    internal = _part(body, r"^\[internal function\]: (.*)$")
    call = F.when(body == "{main}", body).otherwise(F.coalesce(internal, _part(body, r"^(.*)\([0-9]+\): (.*)$", 2)))
    df = lines.where("line <> '' AND line <> 'Stack trace:'").withColumns({
        "kind": kind, "function": F.nullif(F.regexp_replace(call, r"\(.*$", ""), F.lit("")), "module": F.lit(None).cast("string"), "file": F.when(internal.isNull() & (body != "{main}"), _part(body, r"^(.*)\([0-9]+\): ")), "is_frame": call.isNotNull(), "bad": F.lit(False),
    })
    return _single(df, F.min_by("kind", F.when(F.col("kind").isNotNull(), F.col("line_no"))), F.col("is_frame"))


def _with_files(df: DataFrame, frame: Column, file: Column) -> DataFrame:
    """Frame rows with the file that the lines up to the next frame name last."""
    marked = df.withColumn("is_frame", frame).withColumn("named", file).withColumn("number", F.sum(F.col("is_frame").cast("int")).over(_so_far()))
    until = Window.partitionBy("stack_id", "number").orderBy("line_no").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return marked.withColumn("file", F.last("named", ignorenulls=True).over(until))


def go(lines: DataFrame) -> DataFrame:
    line = F.col("line")
    df = lines.where("line <> ''").withColumn("routines", F.sum(line.rlike(r"^goroutine [0-9]+ \[.*\]:$").cast("int")).over(_so_far())).where("routines < 2")
    kind = F.when(line.rlike("^panic: ."), "panic").when(line.rlike("^fatal error: ."), "fatal error")
    other = kind.isNotNull() | line.rlike(r"^goroutine [0-9]+ \[.*\]:$")
    created = _part(line, "^created by (.*)$")
    place = F.regexp_replace(line, r" \+.*$", "")
    is_file = ~other & created.isNull() & place.rlike(":[0-9]+$")
    is_call = ~other & created.isNull() & ~is_file & line.rlike(r"^[^(\s]*\(.*\)$")
    text = F.when(created.isNotNull(), F.regexp_replace(created, " in goroutine .*$", "")).otherwise(line)
    df = df.withColumns({"kind": kind, "function": F.nullif(F.regexp_replace(text, r"\([^(]*$", ""), F.lit("")), "module": F.lit(None).cast("string"), "bad": F.lit(False)})
    df = _with_files(df, (created.isNotNull() & ~other) | is_call, F.when(is_file, source_file(place)))
    return _single(df, F.max_by("kind", F.when(F.col("kind").isNotNull(), F.col("line_no"))), F.col("is_frame"))


def rust(lines: DataFrame) -> DataFrame:
    line = F.col("line")
    panic = line.rlike(r"^thread '.+?' panicked at (?:'.*', .*|[^'].*:|:)$")
    causes = F.last(F.when(line == "Caused by:", 1).when(F.lower(line) == "stack backtrace:", 0), ignorenulls=True).over(_so_far())
    df = lines.where("line <> ''").withColumn("panic", panic).withColumn("causes", F.coalesce(causes == 1, F.lit(False)))
    body = trimmed(_part(line, r"^\s*[0-9]+\s*:(.*)$"))
    symbolic = (body != "") & (~body.rlike(r"\s") | body.contains(" - ") | body.contains("::"))
    frame = ~F.col("panic") & ~F.col("causes") & F.coalesce(symbolic, F.lit(False))
    place = F.when(~F.col("causes") & ~frame, _part(line, "^at (.+)$"))
    function = F.when(body.contains(" - "), F.nullif(F.regexp_replace(body, "^.*? - ", ""), F.lit(""))).when(~body.startswith("0x"), body)
    df = df.withColumns({"function": function, "module": F.lit(None).cast("string"), "bad": F.lit(False)})
    df = _with_files(df, frame, source_file(place))
    known = F.when(F.bool_or("panic") | (F.count_if("is_frame") > 0), "panic")
    return _single(df, known, F.col("is_frame"))


def swift(lines: DataFrame) -> DataFrame:
    line = F.col("line")
    runtime = F.when(line.startswith("Swift runtime failure:"), "Swift runtime failure")
    for kind in ("Fatal error", "Precondition failed", "Assertion failed"):
        runtime = runtime.when(line.contains(f": {kind}:"), kind)
    crash = F.when(runtime.isNull(), F.nullif(F.regexp_replace(_part(line, "Program crashed: (.*)$"), " at 0x.*$", ""), F.lit("")))
    thread = runtime.isNull() & crash.isNull() & line.rlike("^Thread [0-9]+[ :]")
    crashed = thread & line.rlike(r"(?i)(^|\s)crashed:+(\s|$)")
    df = lines.where("line <> ''").withColumns({"runtime": runtime, "crash": crash, "thread": thread, "here": F.last(F.when(thread, crashed), ignorenulls=True).over(_so_far()), "threads": F.bool_or(thread).over(Window.partitionBy("stack_id"))})
    body = F.regexp_replace(_part(line, r"^[0-9]+\s+(.*)$"), r"^(?:\[[^\]]*\] )+", "")
    lead = F.when(~body.startswith("0x"), _part(body, r"^(.*?)\s+0x"))
    rest = trimmed(F.regexp_replace(F.when(lead.isNotNull(), F.regexp_replace(body, r"^.*?\s(0x)", "$1")).otherwise(body), r"^0x\S*\s+", ""))
    at = rest.rlike(r"^.* at .*:[0-9]+$")
    paren = ~at & rest.rlike(r"^.* \([^()]*:[0-9]+\)$")
    symbol = F.when(at, F.regexp_extract(rest, r"^(.*) at (.*)$", 1)).when(paren, F.regexp_extract(rest, r"^(.*) \((.*)\)$", 1)).otherwise(rest)
    file = F.when(at, source_file(F.regexp_extract(rest, r"^(.*) at (.*)$", 2))).when(paren, source_file(F.regexp_extract(rest, r"^(.*) \((.*)\)$", 2)))
    in_module = symbol.rlike("^.* in .*$")
    name = trimmed(F.regexp_replace(F.when(in_module, F.regexp_extract(symbol, "^(.*) in (.*)$", 1)).otherwise(symbol), r" \+ [0-9]+$", ""))
    df = df.withColumns({"function": F.when((name != "<unknown>") & ~name.startswith("0x"), name), "module": F.when(in_module, _part(symbol, "^(.*) in (.*)$", 2)).otherwise(lead), "file": file, "bad": F.lit(False)})
    is_frame = F.col("runtime").isNull() & F.col("crash").isNull() & ~F.col("thread") & body.isNotNull() & (F.coalesce("function", "module", "file").isNotNull()) & (~F.col("threads") | F.coalesce("here", F.lit(False)))
    first = lambda c, f: f(c, F.when(F.col(c).isNotNull(), F.col("line_no")))
    return _single(df.withColumn("is_frame", is_frame), F.coalesce(first("runtime", F.max_by), first("crash", F.min_by)), F.col("is_frame"))


PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"java": java, "javascript": javascript, "python": python, "php": php, "go": go, "rust": rust, "swift": swift}


def parse_stacks(stacks: DataFrame, languages: tuple[str, ...] = tuple(LANGUAGES)) -> DataFrame:
    """Stacks with their segments in order: array of (seg, relation, depth, kind, frames, warned); empty if nothing was recognised."""
    lines = split_stack(stacks)
    parts = [f(lines.where(F.col("language") == name)) for name, f in PARSERS.items() if name in languages]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    useful = rows.where(f"seg <= {MAX_SEGMENTS}").groupBy("stack_id").agg(F.array_sort(F.collect_list(F.struct("seg", "relation", "depth", "kind", "frames", "warned"))).alias("segments"))
    return stacks.join(useful.where("exists(segments, s -> s.kind IS NOT NULL OR size(s.frames) > 0)"), "stack_id", "left")


def frame_rows(segments: DataFrame) -> DataFrame:
    """The frames table: stack_id, seg, relation, depth, kind, frame, function, module, file."""
    return segments.select("stack_id", "seg", "relation", "depth", "kind", F.posexplode("frames").alias("frame", "f")).select("stack_id", "seg", "relation", "depth", "kind", "frame", "f.*")

"""De-obfuscation joins: retraced Java frames and mapped JavaScript positions, each by the project's own mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconry.functions import scalars as fn

#: Mappings belong to a project's build; builds of different projects may share a name.
KEY = ["project_id", "build"]


def known_builds(errors: DataFrame, builds: DataFrame) -> DataFrame:
    """The errors that may be mapped: Java or JavaScript, with a release and a stack, whose build is known."""
    able = errors.where(F.col("language").isin("java", "javascript") & (F.col("release") != "") & (fn.trimmed(F.col("stack")) != ""))
    return able.join(builds, ["project_id", "release"], "left_semi")


def mapping_tables(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, methods) of mapping text lines (project_id, build, line_no, text): a class line holds until the next."""
    by = Window.partitionBy(*KEY).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    text = F.regexp_replace("text", r"\s+$", "")
    head = ~text.rlike(r"^[\s#]") & (text != "")
    parsed = lines.withColumn("text", text).withColumn("at", F.last(F.when(head, F.col("line_no")), ignorenulls=True).over(by))
    pattern = r"^(.*?) -> (.*):$"
    classes = parsed.groupBy(*KEY, "at").agg(
        F.max(F.when(F.col("line_no") == F.col("at"), fn.blank_to_null(F.regexp_extract("text", pattern, 2)))).alias("class"), F.max(F.when(F.col("line_no") == F.col("at"), fn.blank_to_null(F.regexp_extract("text", pattern, 1)))).alias("original"),
        F.max(F.when(F.col("text").startswith("#"), F.nullif(F.regexp_extract("text", r'"fileName"\s*:\s*"([^"]*)"', 1), F.lit("")))).alias("file"),
    ).where("class IS NOT NULL")
    member = fn.trimmed(F.col("text"))
    left, right = F.regexp_extract(member, "^(.*) -> (.*)$", 1), fn.trimmed(F.regexp_extract(member, "^(.*) -> (.*)$", 2))
    number = lambda g: F.expr(f"try_cast(nullif(regexp_extract(member, '^([0-9]+):([0-9]+):', {g}), '') as bigint)")
    name = F.regexp_replace(F.regexp_extract("member", r"^([^(]*)\(", 1), "^.*[ :]", "")
    methods = parsed.where(F.col("text").rlike(r"^\s.* -> ") & left.contains("(")).select(*KEY, "at", "line_no", left.alias("member"), right.alias("method"))
    methods = methods.select(*KEY, "at", "line_no", "method", number(1).alias("lo"), number(2).alias("hi"), name.alias("original_method"))
    first = classes.groupBy(*KEY, "class").agg(F.min_by("original", "at").alias("original"), F.min_by("file", F.when(F.col("file").isNotNull(), F.col("at"))).alias("file"))
    named = methods.join(classes.select(*KEY, "at", "class"), [*KEY, "at"]).drop("at")
    return first, named


#: Blocks of 2 ** level lines, up to the largest line number there is.
_LEVELS = 32
_BLOCKS = f"""filter(flatten(transform(sequence(0, {_LEVELS}), l -> transform(
    array(named_struct('a', shiftright(lo + shiftleft(1L, l) - 1, l), 'b', shiftright(hi + 1, l), 'left', true), named_struct('a', shiftright(lo + shiftleft(1L, l) - 1, l), 'b', shiftright(hi + 1, l), 'left', false)),
    x -> CASE WHEN x.a < x.b AND x.left AND x.a % 2 = 1 THEN named_struct('level', l, 'block', x.a) WHEN x.a < x.b AND NOT x.left AND x.b % 2 = 1 THEN named_struct('level', l, 'block', x.b - 1) END))), x -> x IS NOT NULL)"""


def methods_of_lines(asked: DataFrame, methods: DataFrame) -> DataFrame:
    """asked (key, class, method, number) with original_method: the first method whose lines hold the number, else the first.

    A method's lines are kept as the few aligned blocks of 2 ** level lines that make them up, and a number lies in one
    block of each level. So a line meets its methods by equality, one row a level, however many overloads and ranges the
    class has and however they overlap; a block that several methods share keeps the first of them.
    """
    key = [*KEY, "class", "method"]
    blocks = methods.where("lo IS NOT NULL AND hi IS NOT NULL AND lo <= hi").select(*key, "line_no", "original_method", F.explode(F.expr(_BLOCKS)).alias("b"))
    blocks = blocks.groupBy(*key, F.col("b.level").alias("level"), F.col("b.block").alias("block")).agg(F.min_by("original_method", "line_no").alias("found"), F.min("line_no").alias("found_at"))
    known = methods.groupBy(*key).agg(F.min_by("original_method", "line_no").alias("first")).join(blocks.groupBy(*key).agg(F.collect_set("level").alias("levels")), key, "left")
    looked = asked.join(known, key).select(*key, "number", "first", F.explode_outer("levels").alias("level"))
    met = looked.withColumn("block", F.expr("shiftright(number, level)")).join(blocks, [*key, "level", "block"], "left")
    return met.groupBy(*key, "number").agg(F.coalesce(F.min_by("found", "found_at"), F.first("first")).alias("original_method"))


def retrace(stacks: DataFrame, classes: DataFrame, methods: DataFrame) -> DataFrame:
    """(stack_id, project_id, build, mapped_stacktrace, mapping_used) of Java stacks (stack_id, project_id, build, stack) that a mapping changes.

    Lines join the classes of their project's build by name. What is asked of a method (its name and a line) is looked up
    once however many frames ask it. Spark broadcasts small mappings and shuffles large ones.
    """
    raw = F.col("raw")
    own = ["stack_id", *KEY]
    lines = stacks.select(*own, F.posexplode(F.split("stack", "\n")).alias("line_no", "raw"))
    indent, rest = F.regexp_extract(raw, r"^(\s*)(.*)$", 1), F.regexp_extract(raw, r"^(\s*)(.*)$", 2)
    call = r"^at ((?:[^(]*/)?)([^(/]*)\.([^(./]*)(\(.*)$"
    is_call = rest.rlike(call)
    before = F.when(rest.startswith("Caused by: "), "Caused by: ").otherwise("")
    thrown = F.regexp_replace(rest, "^Caused by: ", "")
    named = F.regexp_replace(thrown, "(?s): .*$", "")
    number = F.expr("CASE WHEN raw RLIKE ':[0-9]+[)]*$' THEN try_cast(regexp_extract(raw, ':([0-9]+)[)]*$', 1) as bigint) END")
    lines = lines.withColumns({
        "indent": indent, "call": is_call, "lead": F.when(is_call, F.regexp_extract(rest, call, 1)).otherwise(F.concat(before, F.regexp_extract(named, "^(.*/)?", 0))), "class": F.when(is_call, F.regexp_extract(rest, call, 2)).when(~rest.startswith("at "), F.regexp_replace(named, "^.*/", "")),
        "method": F.when(is_call, F.regexp_extract(rest, call, 3)), "suffix": F.when(thrown.contains(": "), F.regexp_extract(thrown, "(?s)^.*?(: .*)$", 1)).otherwise(""), "number": F.when(number < 1 << 32, number),
    })
    hit = lines.join(classes, [*KEY, "class"], "left").withColumn("asked", F.coalesce("number", F.lit(-1)))
    asked = hit.where("call AND original IS NOT NULL").select(*KEY, "class", "method", F.col("asked").alias("number")).distinct()
    picks = methods_of_lines(asked, methods).withColumnRenamed("number", "asked")
    hit = hit.join(picks, [*KEY, "class", "method", "asked"], "left")
    place = F.concat(F.lit("("), F.coalesce("file", F.lit("Unknown Source")), F.when(F.col("number").isNotNull(), F.concat(F.lit(":"), F.col("number").cast("string"))).otherwise(""), F.lit(")"))
    new = F.when(F.col("original").isNull(), raw).when(F.col("call"), F.concat(F.col("indent"), F.lit("at "), F.col("lead"), F.col("original"), F.lit("."), F.coalesce("original_method", "method"), place)).otherwise(F.concat("indent", "lead", "original", "suffix"))
    whole = hit.groupBy(*own).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", new.alias("t")))), lambda x: x["t"]), "\n").alias("mapped_stacktrace"), F.bool_or(new != raw).alias("changed"))
    return whole.where("changed").select(*own, "mapped_stacktrace", F.concat(F.lit("r8:"), "build").alias("mapping_used"))


def js_file_key(raw: Column) -> Column:
    """A script's path without scheme, host, query and fragment."""
    bare = F.regexp_replace(F.regexp_replace(raw, r"\?.*$", ""), "#.*$", "")
    path = F.when(bare.rlike("^.*?://[^/]*/"), F.regexp_replace(bare, "^.*?://[^/]*/", "")).otherwise(bare)
    return F.regexp_replace(path, "^/+", "")


def map_js_frames(stacks: DataFrame, tokens: DataFrame) -> DataFrame:
    """(stack_id, project_id, build, mapped_stacktrace, mapping_used) of JavaScript stacks with a mapped frame.

    tokens (project_id, build, file, line, col, source, src_line, src_col, name; numbers from 0) are joined as of: the
    greatest one of the frame's line at or before its column, by carrying the last token forward in one sorted shuffle.
    Each place that is asked for goes there once, so what a script's line gathers is bounded by the script, not by how
    often it fails. A frame's file is looked up by path, then by its last part.
    """
    own = ["stack_id", *KEY]
    lines = stacks.select(*own, F.posexplode(F.split("stack", "\n")).alias("line_no", "raw"))
    shape = r"^(.*?)([^ (@]+):([0-9]+):([0-9]+)(\)?)$"
    t = F.regexp_replace("raw", r"\s+$", "")
    part = lambda g: F.regexp_extract(t, r"^((?:.*[ (@])?)([^ (@]+):([0-9]+):([0-9]+)(\)?)$", g)
    frames = lines.withColumns({"hit": t.rlike(shape), "lead": part(1), "path": js_file_key(part(2)), "line": part(3).try_cast("long") - 1, "col": part(4).try_cast("long") - 1, "tail": part(5)})
    files = tokens.select(*KEY, F.col("file").alias("path")).distinct().withColumn("known", F.lit(True))
    at = [*KEY, "path", "line", "col"]
    asked = frames.where("hit").select(*at).distinct().join(files, [*KEY, "path"], "left").withColumn("key", F.when(F.col("known"), F.col("path")).otherwise(F.regexp_replace("path", "^.*/", "")))
    token = F.struct("source", "src_line", "src_col", "name")
    sides = asked.select(*KEY, "key", "line", "col", F.lit(1).alias("side"), "path", F.lit(None).cast(tokens.select(token.alias("t")).schema["t"].dataType).alias("t")).unionByName(
        tokens.select(*KEY, F.col("file").alias("key"), "line", "col", F.lit(0).alias("side"), F.lit(None).cast("string").alias("path"), token.alias("t"))
    )
    by = Window.partitionBy(*KEY, "key", "line").orderBy("col", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = sides.withColumn("t", F.last("t", ignorenulls=True).over(by)).where("side = 1 AND t IS NOT NULL").select(*at, "t")
    place = F.concat_ws(":", F.col("t.source"), (F.col("t.src_line") + 1).cast("string"), (F.col("t.src_col") + 1).cast("string"))
    named = F.coalesce(F.col("t.name"), F.lit("")) != ""
    joined = frames.join(found, at, "left")
    new = F.when(~F.col("hit") | F.col("t").isNull(), F.col("raw")).otherwise(F.concat("lead", F.when(named, F.concat(F.col("t.name"), F.lit(" ("), place, F.lit(")"))).otherwise(place), "tail"))
    whole = joined.groupBy(*own).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", new.alias("x")))), lambda r: r["x"]), "\n").alias("mapped_stacktrace"), F.bool_or(F.col("hit") & F.col("t").isNotNull()).alias("changed"))
    return whole.where("changed").select(*own, "mapped_stacktrace", F.concat(F.lit("javascript:"), "build").alias("mapping_used"))


def enrich_occurrences(grouped: DataFrame, mapped: DataFrame, regroup) -> DataFrame:
    """Occurrences whose stack was mapped for their own project, with hashes of the mapped one; the others as they are.

    grouped has project_id, stack_id, release, kind, message, stack, group_hash, exact_hash; regroup groups errors anew.
    """
    joined = grouped.drop("mapped_stacktrace", "mapping_used").join(mapped.withColumnRenamed("build", "release"), ["project_id", "stack_id", "release"], "left")
    plain = joined.where("mapped_stacktrace IS NULL")
    fresh = joined.where("mapped_stacktrace IS NOT NULL").drop("group_hash", "outcome").withColumn("raw_stack", F.col("stack")).withColumn("stack", F.col("mapped_stacktrace"))
    fresh = regroup(fresh).withColumn("exact_hash", fn.exact_hash(F.col("kind"), F.col("message"), F.col("mapped_stacktrace"))).withColumn("stack", F.col("raw_stack")).drop("raw_stack")
    return plain.unionByName(fresh, allowMissingColumns=True)

"""Validation of user-declared metrics, set-based."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.operators.web import json_map, json_string

# Limits of JSON metrics.
MAX_JSON_BYTES, MAX_JSON_DEPTH, MAX_JSON_NODES = 32_768, 8, 256

NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def usable_rules(sources: DataFrame) -> DataFrame:
    """The rule table, last rule per key; patterns that do not compile become null, where they stand and row by row."""
    last = sources.groupBy("project_id", "reference_id").agg(F.max_by(F.struct("data_type", "metric_shape", "regex", "allow_negative", "allow_float", "min_value", "max_value"), "ord").alias("r")).select("project_id", "reference_id", "r.*")
    return last.withColumn("regex", F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.col("regex")))


def number_of(value: Column) -> Column:
    """The number of a JSON number or numeric string; strict, so that ' 42 ' and '1d' are none."""
    text = F.when(value.startswith('"'), json_string(value)).otherwise(value)
    return F.regexp_extract(text, NUMBER, 0).try_cast("double")


def check_number(value: Column) -> Column:
    # A transform of one element, so that the number is made once for all that is asked of it.
    return F.transform(F.array(number_of(value)), _number_reason)[0]


def _number_reason(n: Column) -> Column:
    return (
        F.when(n.isNull(), "expected number")
        .when(~F.col("allow_float") & (n != F.when(n < 0, F.ceil(n)).otherwise(F.floor(n))), "float not allowed")
        .when(~F.col("allow_negative") & (n < 0), "negative not allowed")
        .when(n < F.col("min_value"), "value below minimum")
        .when(n > F.col("max_value"), "value above maximum")
        .when(F.isnan(n) | (F.abs(n) == float("inf")), "NaN/Infinity not allowed")
    )


def check_scalar(value: Column) -> Column:
    """Null, or why a JSON scalar breaks the rule of its row."""
    kind = F.col("data_type")
    is_text = F.transform(F.array(json_string(value)), lambda text: F.when(text.isNull(), "expected string").when(F.col("regex").isNotNull() & ~F.expr("false"), F.when(~F.rlike(text, F.col("regex")), "regex mismatch")))[0]
    is_bool = F.when(~F.coalesce(value.isin("true", "false"), F.lit(False)), "expected boolean")
    return F.when(kind == "string", is_text).when(kind == "boolean", is_bool).when(kind == "number", check_number(value)).otherwise("unsupported data_type")


def json_shape(text: Column) -> tuple[Column, Column, Column]:
    """(bytes, depth of the deepest node below the root, nodes) of compact JSON, from its structure with the strings taken out."""
    bare = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', "s")
    marks = F.regexp_replace(F.regexp_replace(bare, r"\[\]|\{\}", "e"), r"[^\[\]{},]", "")
    steps = F.split(F.regexp_replace(F.regexp_replace(bare, r"\[\]|\{\}", "e"), r"[^\[\]{}]", ""), "")
    walk = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("top")),
        lambda a, c: F.struct((a["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)).alias("now"), F.greatest(a["top"], a["now"] + F.when(c.isin("[", "{"), 1).otherwise(0)).alias("top")),
        lambda a: a["top"],
    )
    nodes = 1 + F.length(F.regexp_replace(marks, r"[^,\[{]", ""))
    return F.octet_length(text), walk, nodes


def check_json(text: Column) -> Column:
    size, depth, nodes = json_shape(text)
    return F.when(size > MAX_JSON_BYTES, "JSON value exceeds 32 KiB").when(depth > MAX_JSON_DEPTH, "JSON value exceeds maximum depth of 8").when(nodes > MAX_JSON_NODES, "JSON value exceeds 256 items")


def validate_metrics(events: DataFrame, rules: DataFrame, key: str = "request_id", keep: Sequence[str] = ()) -> DataFrame:
    """(key, project_id, columns in keep, valid map of JSON texts, warnings map) per event (project_id, data JSON).

    Events are dealt out by what they are grouped by, before they are parsed: a file of few bytes holds many of them, and
    what they cost is spread over all tasks. Members are exploded and joined with their rules, which Spark broadcasts while
    they are small; elements of arrays and maps are checked in place, bad ones go and the first bad one is the warning.
    """
    tasks = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = events.select(key, "project_id", *keep, "data").repartition(tasks, key, "project_id")
    members = dealt.select(key, "project_id", *keep, F.explode_outer(json_map(F.col("data"))).alias("reference_id", "value"))
    ruled = members.join(rules, ["project_id", "reference_id"], "left")
    is_array, is_map = F.col("value").startswith("["), F.col("value").startswith("{")
    elements = F.when(is_array, F.transform(F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>"), lambda v, i: F.struct(i.cast("string").alias("k"), F.coalesce(F.to_json(v), F.lit("null")).alias("v"))))
    entries = F.when(is_map, F.transform(F.sort_array(F.map_entries(json_map(F.col("value")))), lambda e: F.struct(e["key"].alias("k"), F.coalesce(e["value"], F.lit("null")).alias("v"))))
    checked = F.transform(F.when((F.col("metric_shape") == "array") & is_array, elements).when((F.col("metric_shape") == "map") & is_map, entries), lambda e: F.struct(e["k"].alias("k"), e["v"].alias("v"), check_scalar(e["v"]).alias("bad")))
    ruled = ruled.withColumn("checked", F.when(F.col("data_type") != "json", checked))
    good = F.filter("checked", lambda e: e["bad"].isNull())
    first_bad = F.get(F.filter("checked", lambda e: e["bad"].isNotNull()), F.lit(0))
    shape = F.col("metric_shape")
    failed = lambda why: F.concat(F.lit("failed validation: "), why)
    warning = (
        F.when(F.col("reference_id").isNull(), None)
        .when(F.col("data_type").isNull(), "no matching data source")
        .when(F.col("data_type") == "json", failed(check_json(F.col("value"))))
        .when((shape == "array") & ~is_array, "expected array")
        .when((shape == "map") & ~is_map, "expected object")
        .when(shape == "array", F.concat(F.lit("element["), first_bad["k"], F.lit("] failed validation: "), first_bad["bad"]))
        .when(shape == "map", F.concat(F.lit("map key '"), first_bad["k"], F.lit("' failed validation: "), first_bad["bad"]))
        .when(is_array | is_map, "unexpected collection (expected single value)")
        .otherwise(failed(check_scalar(F.col("value"))))
    )
    ruled = ruled.withColumn("warning", warning)
    kept = F.when(F.col("checked").isNotNull(), F.when(shape == "array", F.concat(F.lit("["), F.array_join(F.transform(good, lambda e: e["v"]), ","), F.lit("]"))).otherwise(F.concat(F.lit("{"), F.array_join(F.transform(good, lambda e: F.concat(F.lit('"'), e["k"], F.lit('":'), e["v"])), ","), F.lit("}")))).when(F.col("warning").isNull(), F.col("value"))
    rows = ruled.select(key, "project_id", *keep, "reference_id", "warning", kept.alias("kept"))
    pairs = lambda c: F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull() & F.col("reference_id").isNotNull(), F.struct("reference_id", c)))))
    return rows.groupBy(key, "project_id").agg(*[F.first(c).alias(c) for c in keep], pairs("kept").alias("valid"), pairs("warning").alias("warnings"))


def warning_summary(validated: DataFrame) -> DataFrame:
    return validated.select("project_id", F.explode("warnings").alias("metric", "reason")).groupBy("project_id", "metric", "reason").agg(F.count(F.lit(1)).alias("n"))

"""Queries of declared metrics, web vitals and person identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from beaconry.functions import scalars as fn
from beaconry.operators import metrics, persons, vitals, web
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


def validated(spark, sf_dir, keep=()):
    return metrics.validate_metrics(load(spark, sf_dir, "fx_metrics"), metrics.usable_rules(load(spark, sf_dir, "fx_data_sources")), keep=keep)


# What each member of the fixture is worth under the literal rules: (kept JSON or null, warning or null).
_CASES = """m AS (SELECT request_id, project_id, request_id % 5 AS a, request_id % 7 AS b, request_id % 6 AS c, request_id % 4 AS d, request_id % 3 AS e, size, brand, name FROM @fx_metrics@),
x AS (
 SELECT request_id, project_id, 'size' AS k, CASE a WHEN 0 THEN '"' || cast(size AS string) || '"' ELSE cast(size AS string) END AS v, CASE WHEN a = 1 THEN 'failed validation: float not allowed' WHEN a = 2 AND size > 0 THEN 'failed validation: negative not allowed' WHEN size < 5 THEN 'failed validation: value below minimum' WHEN size > 45 THEN 'failed validation: value above maximum' END AS w FROM m
 UNION ALL SELECT request_id, project_id, 'brand', '"' || brand || '"', CASE WHEN request_id % 11 = 0 THEN 'failed validation: expected string' WHEN NOT regexp_matches(brand, '#[1-3]') THEN 'failed validation: regex mismatch' END FROM m
 UNION ALL SELECT request_id, project_id, 'price', cast(request_id % 2000 AS string) || '.25', CASE WHEN b < 2 THEN 'failed validation: expected number' WHEN request_id % 2000 + 0.25 > 1500 THEN 'failed validation: value above maximum' END FROM m
 UNION ALL SELECT request_id, project_id, 'tags', CASE c WHEN 1 THEN '[]' WHEN 2 THEN '[1,3]' WHEN 3 THEN '[1]' WHEN 0 THEN NULL ELSE '[1,2]' END, CASE c WHEN 0 THEN 'expected array' WHEN 2 THEN 'element[1] failed validation: negative not allowed' WHEN 3 THEN 'element[1] failed validation: expected number' END FROM m
 UNION ALL SELECT request_id, project_id, 'limits', CASE d WHEN 1 THEN '{"a":1}' WHEN 0 THEN NULL ELSE '{"a":2}' END, CASE d WHEN 0 THEN 'expected object' WHEN 1 THEN 'map key ''b'' failed validation: value below minimum' END FROM m
 UNION ALL SELECT request_id, project_id, 'flag', 'true', CASE WHEN e > 0 THEN 'failed validation: expected boolean' END FROM m
 UNION ALL SELECT request_id, project_id, 'blob', CASE e WHEN 1 THEN '{"k":[1,{"q":"},[{"}]}' ELSE '5' END, CASE WHEN e = 0 THEN 'failed validation: JSON value exceeds maximum depth of 8' END FROM m
 UNION ALL SELECT request_id, project_id, 'badre', '"' || name || '"', NULL FROM m
 UNION ALL SELECT request_id, project_id, 'junk', NULL, 'no matching data source' FROM m),
y AS (SELECT *, CASE WHEN w IS NULL OR k IN ('tags', 'limits') THEN v END AS kept FROM x)"""


@query(f"""WITH {_CASES} SELECT request_id, '{{' || string_agg('"' || k || '":' || kept, ',' ORDER BY k) || '}}' AS valid, string_agg(k || '=' || w, '|' ORDER BY k) AS warnings FROM y GROUP BY request_id""")
def q_validate_metrics(spark, sf_dir):
    out = validated(spark, sf_dir)
    return out.select("request_id", web.sorted_json(F.col("valid")).alias("valid"), F.array_join(F.transform(F.array_sort(F.map_entries("warnings")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|").alias("warnings"))


@query(f"WITH {_CASES} SELECT project_id, k AS metric, w AS reason, count(*) AS n FROM y WHERE w IS NOT NULL GROUP BY 1, 2, 3")
def q_warnings(spark, sf_dir):
    return metrics.warning_summary(validated(spark, sf_dir))


@query("""SELECT p_partkey AS request_id, CASE p_partkey % 4 WHEN 0 THEN CASE WHEN p_brand LIKE '%1%' THEN NULL ELSE 'regex mismatch' END WHEN 1 THEN 'expected string' WHEN 2 THEN CASE WHEN p_partkey % 8 = 2 THEN NULL ELSE 'expected boolean' END ELSE 'unsupported data_type' END AS reason FROM @part@""")
def q_check_scalar(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("string", "string", "boolean", "date"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    value = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit('"'), "p_brand", F.lit('"'))).when(F.col("p_partkey") % 8 == 2, "true").otherwise("7")
    null = lambda t: F.lit(None).cast(t)
    df = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("request_id"), kind.alias("data_type"), value.alias("value"), F.lit("1").alias("regex"), null("boolean").alias("allow_float"), null("boolean").alias("allow_negative"), null("double").alias("min_value"), null("double").alias("max_value"))
    return df.select("request_id", metrics.check_scalar(F.col("value")).alias("reason"))


@query("""WITH v AS (SELECT p_partkey, p_partkey % 8 AS k, cast(p_size AS double) AS n FROM @part@)
 SELECT p_partkey AS request_id, CASE WHEN k IN (0, 1) THEN 'expected number' WHEN k = 2 THEN 'float not allowed' WHEN k = 3 AND n > 0 THEN 'negative not allowed' WHEN k <> 3 AND n < 10 THEN 'value below minimum' WHEN k = 3 THEN 'value below minimum' WHEN n > 40 THEN 'value above maximum' END AS reason FROM v""")
def q_number_rules(spark, sf_dir):
    size = F.col("p_size").cast("string")
    value = F.element_at(F.array(F.lit('" 42 "'), F.lit('"1d"'), F.concat(size, F.lit(".5")), F.concat(F.lit("-"), size), size, F.concat(F.lit('"'), size, F.lit('"')), F.concat(size, F.lit(".0")), F.concat(size, F.lit("e0"))), (F.col("p_partkey") % 8 + 1).cast("int"))
    df = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("request_id"), value.alias("value"), F.lit(False).alias("allow_float"), F.lit(False).alias("allow_negative"), F.lit(10.0).alias("min_value"), F.lit(40.0).alias("max_value"))
    return df.select("request_id", metrics.check_number(F.col("value")).alias("reason"))


@query("""SELECT p_partkey AS request_id, 1 + p_size % 10 AS depth, 1 + (p_size % 10) + (CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 1 END) AS nodes, CASE WHEN 1 + p_size % 10 > 8 THEN 'JSON value exceeds maximum depth of 8' END AS reason FROM @part@""")
def q_check_json(spark, sf_dir):
    n = F.col("p_size") % 10
    text = F.concat(F.repeat(F.lit("["), n), F.when(F.col("p_partkey") % 2 == 0, F.lit('{"a,[":{},"b":[],"c":"]}"}')).otherwise(F.lit('{"a":[]}')), F.repeat(F.lit("]"), n))
    _, depth, nodes = metrics.json_shape(text)
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("request_id"), depth.alias("depth"), nodes.alias("nodes"), metrics.check_json(text).alias("reason"))


_MODS = """SELECT request_id, project_id, CASE WHEN request_id % 3 = 0 THEN '1.' || cast(size AS string) WHEN request_id % 3 = 1 THEN type END AS version, CASE WHEN size <= 40 THEN size END AS cores FROM @fx_metrics@"""


def mods_events(spark, sf_dir):
    """Server rows: game_version if it is a string, else minecraft_version; custom is what validation keeps."""
    df = validated(spark, sf_dir, ["size", "type", "received_ms"]).where("request_id IS NOT NULL AND project_id IS NOT NULL")
    fields = F.create_map(
        F.lit("game_version"), F.when(F.col("request_id") % 3 == 0, F.concat(F.lit('"1.'), F.col("size").cast("string"), F.lit('"'))).otherwise(F.lit("7")),
        F.lit("minecraft_version"), F.when(F.col("request_id") % 3 == 2, F.lit("null")).otherwise(F.concat(F.lit('"'), "type", F.lit('"'))), F.lit("core_count"), F.when(F.col("size") <= 40, F.col("size").cast("string")).otherwise(F.lit("70000")),
    )
    df = df.withColumn("f", fields)
    return df.select("request_id", "project_id", F.coalesce(web.json_string(F.col("f")["game_version"]), web.json_string(F.col("f")["minecraft_version"])).alias("minecraft_version"), fn.as_u16(web.json_number(F.col("f")["core_count"])).alias("core_count"), web.sorted_json(F.col("valid")).alias("custom"), F.timestamp_millis("received_ms").alias("created_at"))


@query(f"""WITH {_CASES}, c AS (SELECT request_id, '{{' || string_agg('"' || k || '":' || kept, ',' ORDER BY k) || '}}' AS custom FROM y GROUP BY request_id), r AS ({_MODS}) SELECT r.request_id, project_id, version AS minecraft_version, cast(cores AS INTEGER) AS core_count, custom FROM r JOIN c USING (request_id)""")
def q_mods_events(spark, sf_dir):
    return mods_events(spark, sf_dir).drop("created_at")


@query(f"""WITH {_CASES}, c AS (SELECT request_id, max(CASE WHEN k = 'tags' THEN kept END) AS tags FROM y GROUP BY request_id), r AS ({_MODS}) SELECT r.request_id, version AS game_version, tags FROM r JOIN c USING (request_id)""")
def q_mods_v2(spark, sf_dir):
    out = web.mods_v2(mods_events(spark, sf_dir))
    return out.select("request_id", "game_version", F.to_json(F.try_variant_get("custom", "$.tags", "variant")).alias("tags"))


_DEC = "struct(pos, metric, value, attributes)"


def vital_requests(spark, sf_dir):
    df = load(spark, sf_dir, "fx_vitals")
    return df.groupBy("request_id").agg(F.array_sort(F.collect_list(F.expr(_DEC))).alias("vitals"))


_VALID = "coalesce(value >= 0 AND value <= CASE metric WHEN 'CLS' THEN 100 WHEN 'CUSTOM' THEN NULL ELSE 86400000 END, false)"


@query(f"SELECT request_id, pos, metric, {_VALID} AS valid FROM @fx_vitals@")
def q_vital_valid(spark, sf_dir):
    return load(spark, sf_dir, "fx_vitals").select("request_id", "pos", "metric", fn.valid_vital(F.col("metric"), F.col("value")).alias("valid"))


@query(f"WITH ok AS (SELECT request_id FROM @fx_vitals@ GROUP BY 1 HAVING bool_and({_VALID})) SELECT request_id, pos, metric, coalesce(attributes, '{{}}') AS attributes FROM @fx_vitals@ SEMI JOIN ok USING (request_id)")
def q_vitals(spark, sf_dir):
    return vitals.explode_vitals(vital_requests(spark, sf_dir)).select("request_id", "pos", "metric", "attributes")


@query("""SELECT request_id, pos, coalesce(m_browser, ua_browser, 'Unknown') AS browser, coalesce(m_device, ua_device, 'Unknown') AS device, coalesce(m_os, ua_os, 'Unknown') AS os, nullif(ua_browser_version, '') AS browser_version, nullif(ua_os_version, '') AS os_version FROM @fx_vitals@""")
def q_vital_dims(spark, sf_dir):
    return vitals.vital_dims(load(spark, sf_dir, "fx_vitals")).select("request_id", "pos", "browser", "device", "os", "browser_version", "os_version")


_POOR = "coalesce(value >= CASE metric WHEN 'LCP' THEN 4000 WHEN 'FCP' THEN 3000 WHEN 'INP' THEN 500 WHEN 'CLS' THEN 0.25 WHEN 'TTFB' THEN 1800 WHEN 'FID' THEN 300 END, false)"


@query(f"SELECT request_id, pos, metric, {_POOR} AS poor FROM @fx_vitals@")
def q_poor_vitals(spark, sf_dir):
    return load(spark, sf_dir, "fx_vitals").select("request_id", "pos", "metric", fn.poor_vital(F.col("metric"), F.col("value")).alias("poor"))


_UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)"
_ID_SQL = f"""p0 AS (SELECT *, nullif(trim(external_id), '') AS ext, CASE WHEN alias <> 'no-uuid' THEN sha256(unhex(replace(alias, '-', '')) || unhex(replace(project_id, '-', ''))) END AS h FROM @fx_patches@),
p1 AS (SELECT *, CASE WHEN cookieless THEN 'cookieless project' WHEN ext IS NULL THEN 'external id required' END AS reject_reason, {_UUID} AS distinct_id FROM p0), ok AS (SELECT * FROM p1 WHERE reject_reason IS NULL)"""


def patches(spark, sf_dir):
    df = load(spark, sf_dir, "fx_patches").withColumn("aliases", F.array("alias"))
    return persons.identify_patches(df)


def accepted(spark, sf_dir):
    return patches(spark, sf_dir).where("reject_reason IS NULL")


@query(f"WITH {_ID_SQL} SELECT request_id, ext AS external_id, reject_reason, distinct_id FROM p1")
def q_identify(spark, sf_dir):
    return patches(spark, sf_dir).select("request_id", "external_id", "reject_reason", F.get("distinct_ids", F.lit(0)).alias("distinct_id"))


_PERSONS_SQL = f"""WITH {_ID_SQL} SELECT project_id, ext AS external_id, (arg_max({{'v': CASE WHEN NOT clear_email THEN email END}}, seq) FILTER (clear_email OR email IS NOT NULL)).v AS email, arg_max(name, seq) FILTER (name IS NOT NULL) AS name, count(*) AS patches FROM ok GROUP BY 1, 2"""


def trait_patches(spark, sf_dir):
    df = accepted(spark, sf_dir).withColumn("traits", F.create_map("trait", F.col("trait_value").cast("string")))
    return df.withColumn("unset_traits", F.when(F.col("unset_trait").isNotNull(), F.array("unset_trait")).otherwise(F.array().cast("array<string>")))


@query(_PERSONS_SQL)
def q_persons(spark, sf_dir):
    return persons.fold_persons(accepted(spark, sf_dir), {"email": "clear_email", "name": None})


_TRAITS_SQL = f"""WITH {_ID_SQL}, s AS (SELECT project_id, ext, max(seq) FILTER (replace_traits) AS since FROM ok GROUP BY 1, 2), l AS (SELECT ok.* FROM ok JOIN s ON s.project_id = ok.project_id AND s.ext = ok.ext WHERE since IS NULL OR seq >= since),
 o AS (SELECT project_id, ext, trait, cast(trait_value AS string) AS v, seq * 2 AS o FROM l UNION ALL SELECT project_id, ext, unset_trait, NULL, seq * 2 + 1 FROM l WHERE unset_trait IS NOT NULL),
 r AS (SELECT *, row_number() OVER (PARTITION BY project_id, ext, trait ORDER BY o DESC) AS rn FROM o) SELECT project_id, ext AS external_id, trait, v AS value FROM r WHERE rn = 1 AND v IS NOT NULL"""


@query(_TRAITS_SQL)
def q_traits(spark, sf_dir):
    return persons.fold_traits(trait_patches(spark, sf_dir))


_ALIASES_SQL = f"WITH {_ID_SQL} SELECT project_id, distinct_id, arg_max(ext, seq) AS external_id FROM ok WHERE distinct_id IS NOT NULL GROUP BY 1, 2"


@query(_ALIASES_SQL)
def q_aliases(spark, sf_dir):
    return persons.fold_aliases(accepted(spark, sf_dir))


#: The oracles that the streaming forms of the folds share.
ORACLES_OF = {"persons": _PERSONS_SQL, "traits": _TRAITS_SQL, "aliases": _ALIASES_SQL}

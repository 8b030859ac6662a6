"""Web and server events: properties, visitors, persons and rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beaconry.functions import scalars as fn

# Fields of the rows that are taken out of a request's data.
WEB_FIELDS = ["event", "browser", "browser_version", "device", "os", "os_version", "referrer", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "title", "page", "url", "cookieless"]
SERVER_FIELDS = ["player_count", "online_mode", "client", "plugin_version", "minecraft_version", "game_version", "server_type", "platform_version", "java_version", "java_vendor", "os_name", "os_arch", "os_version", "core_count"]


def member_texts(v: Column) -> Column:
    """The members of a variant that holds an object as a map of JSON texts; null if it is no object."""
    return F.transform_values(F.try_variant_get(v, "$", "map<string,variant>"), lambda _, x: F.to_json(x))


def json_map(text: Column) -> Column:
    """A JSON object's members as a map whose values stay JSON text; null if it is none."""
    return member_texts(F.try_parse_json(text))


def whole_json_map(text: Column) -> Column:
    """json_map of a text that holds one object and nothing but space around it; null if more follows.

    The parser stops where a value ends, so the text is read as the only item of an array, and one that may end that array
    early as an object's only member too. The map is made of that item, so most texts are parsed once.
    """
    items = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    ends_early = text.rlike(r"\}\s*\]") & F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNull()
    # A transform of one element, so that the items are parsed once for all that is asked of them.
    return F.transform(F.array(items), lambda x: F.when((F.size(x) == 1) & ~ends_early, member_texts(F.get(x, F.lit(0)))))[0]


def json_string(value: Column) -> Column:
    """The string of a JSON string value, null for any other value. One without escapes is what its quotes hold; others are parsed."""
    plain = value.rlike(r'^"[^"\\\x00-\x1f]*"\z')
    return F.when(plain, F.btrim(value, F.lit('"'))).when(value.startswith('"'), F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), "v string")["v"])


def json_number(value: Column) -> Column:
    return F.when(value.rlike("^-?[0-9]"), value.cast("double"))


def extract_known(data: Column, fields: list[str]) -> tuple[Column, Column]:
    """(map of the known string fields, the rest of data)."""
    names = F.array(*[F.lit(f) for f in fields])
    known = F.map_filter(data, lambda k, v: F.array_contains(names, k) & v.startswith('"'))
    return F.transform_values(known, lambda _, v: json_string(v)), F.map_filter(data, lambda k, _: ~F.array_contains(names, k))


def merge_maps(under: Column, over: Column) -> Column:
    """Shallow union; over wins."""
    return F.map_concat(F.map_filter(under, lambda k, _: ~F.array_contains(F.map_keys(over), k)), over)


def sorted_json(m: Column) -> Column:
    """A map of JSON texts as one JSON object with sorted keys."""
    return F.concat(F.lit("{"), F.array_join(F.transform(F.sort_array(F.map_entries(m)), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])), ","), F.lit("}"))


def build_web_event(rows: DataFrame, keep: list | None = None) -> DataFrame:
    """The rows of web events, after the columns in keep.

    rows have `data` (the request's other members) and `properties`, maps of JSON texts; user_id, person_id, external_id,
    is_identified, session_id, country, cookieless and received_ms; and what the user agent says: agent_browser,
    agent_browser_version, agent_device, agent_os, agent_os_version. Known fields come out of data, never out of
    properties; what is left of data goes over the properties. What the agent says goes over data, unless it is empty.
    """
    empty = F.create_map().cast("map<string,string>")
    known, rest = extract_known(F.coalesce("data", empty), WEB_FIELDS)
    rows = rows.withColumns({"_known": known, "_properties": merge_maps(F.coalesce("properties", empty), rest)})
    field = lambda n: F.col("_known")[n].alias(n)
    agent = lambda n: F.coalesce(F.when(F.col(f"agent_{n}") != "", F.col(f"agent_{n}")), field(n)).alias(n)
    duration = lambda n: fn.whole_number(json_number(F.col("_properties")[n])).alias(n)
    return rows.select(
        *(keep or []), "project_id", "user_id", "person_id", "external_id", F.coalesce("is_identified", F.lit(False)).alias("is_identified"), "session_id", field("event"),
        *[agent(n) for n in ("browser", "browser_version", "device", "os", "os_version")],
        *[field(n) for n in ("referrer", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "title", "page", "url")],
        "country", "cookieless", duration("time_on_page"), duration("session_duration"), sorted_json(F.col("_properties")).alias("properties"), F.timestamp_millis("received_ms").alias("created_at"),
    )


def visitor_id(cookieless: Column, ident: Column, ip: Column, user_agent: Column, project: Column, ms: Column) -> tuple[Column, Column]:
    """(visitor id or null for a rejected request, whether it is cookieless)."""
    daily, own = fn.cookieless_id(ip, user_agent, project, ms), fn.hash_id(ident, project)
    use_daily = F.coalesce(cookieless, ident.isNull())
    return F.when(use_daily, daily).when(ident.isNotNull(), own), use_daily


def resolve_person(events: DataFrame, aliases: DataFrame, persons: DataFrame) -> DataFrame:
    """Events (project_id, distinct_id) with person_id, external_id and is_identified."""
    linked = events.join(aliases.select("project_id", "distinct_id", F.col("person").alias("alias_person")), ["project_id", "distinct_id"], "left")
    found = linked.join(persons.select("project_id", F.col("person").alias("alias_person"), "external_id"), ["project_id", "alias_person"], "left")
    return found.withColumns({"person_id": F.when(F.col("external_id").isNotNull(), F.col("alias_person")).otherwise(F.col("distinct_id")), "is_identified": F.col("external_id").isNotNull()})


def mods_v2(rows: DataFrame) -> DataFrame:
    """Server rows of the first version in the second's form: renamed game version, native JSON."""
    return rows.withColumnRenamed("minecraft_version", "game_version").withColumn("custom", F.parse_json("custom"))


def merge_context(base: Column, err: Column) -> Column:
    """An error's context over its request's, both JSON texts; objects merge shallowly."""
    b, e = json_map(base), json_map(err)
    return sorted_json(
        F.when(err.isNull(), F.coalesce(b, F.create_map(F.lit("request"), base)))
        .when(b.isNotNull() & e.isNotNull(), merge_maps(b, e))
        .when(b.isNotNull(), merge_maps(b, F.create_map(F.lit("error"), err)))
        .when(e.isNotNull(), merge_maps(e, F.create_map(F.lit("request"), base)))
        .otherwise(F.create_map(F.lit("request"), base, F.lit("error"), err))
    )

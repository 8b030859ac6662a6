"""Queries of the web path: requests, admission, visitors, events, usage."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.functions import scalars as fn
from beaconry.operators import admission as adm
from beaconry.operators import agents as ua
from beaconry.operators import dedupe, usage, web
from beaconry.sources import requests as src
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


_BODY = """'{"token":"' || token || '"' || CASE WHEN user_id IS NULL THEN '' ELSE ',"identifier":"' || user_id || '"' END || ',"event":"' || event || '","sessionId":"' || session_id || '","url":"' || url || '","properties":' || properties || ',"extra":' || cast(request_id AS string) || CASE WHEN request_id % 97 = 0 THEN '' ELSE '}' END"""
# Hosts that projects allow, by group; '' is the empty list.
_HOSTS = "CASE host_group WHEN 0 THEN '' WHEN 1 THEN 'shop.example.com' WHEN 2 THEN '*.Example.com' WHEN 3 THEN '*' ELSE 'other.org,*.b.example.com' END"
_VISITOR_SQL = """
v AS (SELECT w.*, p.project_id, p.cookieless_mode, p.owner_id, p.organization_id, coalesce(p.cookieless_mode, w.user_id IS NULL) AS cookieless,
  sha256(unhex(replace(w.user_id, '-', '')) || unhex(replace(p.project_id, '-', ''))) AS h1,
  sha256(encode(client_ip) || encode(user_agent) || unhex(replace(p.project_id, '-', '')) || encode(strftime(make_timestamp(received_ms * 1000), '%Y-%m-%d'))) AS h2
  FROM @fx_web@ w JOIN @fx_projects@ p ON p.token = w.token),
u AS (SELECT *, CASE WHEN cookieless THEN h2 ELSE h1 END AS h FROM v),
vis AS (SELECT *, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS visitor FROM u)"""
_DEBOUNCE_SQL = """
pg AS (SELECT visitor, url, received_ms, request_id, row_number() OVER (PARTITION BY visitor, url ORDER BY received_ms, request_id) AS i FROM vis WHERE visitor IS NOT NULL AND event IN ('pageview', 'page_leave')),
f AS (SELECT visitor, url, i, received_ms AS last, request_id, true AS kept FROM pg WHERE i = 1
  UNION ALL SELECT n.visitor, n.url, n.i, CASE WHEN n.received_ms - f.last >= 5000 THEN n.received_ms ELSE f.last END, n.request_id, n.received_ms - f.last >= 5000 FROM f JOIN pg n ON n.visitor = f.visitor AND n.url = f.url AND n.i = f.i + 1)"""


# Of the events to debounce some have no URL and some carry errors.
_PAGES_SQL = "(SELECT visitor, event, received_ms, request_id, CASE WHEN request_id % 13 = 0 THEN '' ELSE url END AS url FROM vis WHERE request_id % 17 <> 0)"
_PAGED_SQL = _DEBOUNCE_SQL.replace("FROM vis WHERE", f"FROM {_PAGES_SQL} WHERE")


def with_visitors(spark, sf_dir: str) -> DataFrame:
    """Web requests of known projects with visitor and cookieless."""
    joined = load(spark, sf_dir, "fx_web").join(load(spark, sf_dir, "fx_projects"), "token")
    visitor, cookieless = web.visitor_id(F.col("cookieless_mode"), F.col("user_id"), F.col("client_ip"), F.col("user_agent"), F.col("project_id"), F.col("received_ms"))
    return joined.withColumn("visitor", visitor).withColumn("cookieless", cookieless)


@query(f"SELECT request_id, token, user_agent, client_ip, octet_length(encode({_BODY})) AS body_bytes FROM @fx_web@")
def q_read_requests(spark, sf_dir):
    rows = load(spark, sf_dir, "fx_web").select("request_id", "received_ms", F.lit("web").alias("request_type"), "token", F.expr(_BODY).alias("body"), "client_ip", "user_agent", F.col("origin_header").alias("origin"))
    path = f"{src.shared_dir(spark)}/beaconry/{uuid.uuid4().hex}/requests"
    rows.write.option("compression", "gzip").json(path)
    return src.read_requests(spark, path).select("request_id", "token", "user_agent", "client_ip", F.octet_length("body").cast("long").alias("body_bytes"))


@query(f"""WITH b AS (SELECT *, {_BODY} AS body FROM @fx_web@) SELECT request_id, request_id % 97 = 0 AS malformed, CASE WHEN request_id % 97 <> 0 THEN token END AS token, CASE WHEN request_id % 97 <> 0 THEN user_id END AS user_id,
 CASE WHEN request_id % 97 <> 0 THEN event END AS event, CASE WHEN request_id % 97 <> 0 THEN cast(json_extract(properties, '$.k') AS BIGINT) END AS k,
 CASE WHEN request_id % 97 <> 0 THEN '{{"event":"' || event || '","extra":' || cast(request_id AS string) || ',"url":"' || url || '"}}' END AS data FROM b""")
def q_parse_web(spark, sf_dir):
    parsed = src.parse_request(load(spark, sf_dir, "fx_web").select("request_id", F.expr(_BODY).alias("body")), "web")
    return parsed.select("request_id", "malformed", "token", "user_id", web.json_string(F.col("data")["event"]).alias("event"), F.try_variant_get(F.try_parse_json("properties"), "$.k", "long").alias("k"), web.sorted_json(F.col("data")).alias("data"))


# Bodies of all kinds by case, and what becomes of their envelopes: its fields in order, or None where it is malformed. n is
# the row's number, u the id of a user.
_WEB_CASES = [
    ("""{"token":"t","userId":"' || replace(u, '-', '') || '","properties":{"k":' || n || '},"event":"view"}""", """t|' || u || '|{"k":' || n || '}|-|-|-|-|-|-|-|event"""),
    ("""{"token":"t","userId":"' || u || '","anonymousId":"' || u || '"}""", None),
    ("""{"token":"t","userId":"' || n || '"}""", None),
    ("""{"token":' || n || '}""", None),
    ("""{"token":"t","properties":null}""", None),
    ("""{"errors":[{"count":2,"error":"E","stack":["a","b"]}],"buildId":"b' || n || '"}""", """-|-|-|[{"count":2,"error":"E","stack":["a","b"]}]|-|b' || n || '|-|-|-|-|"""),
    ("""{"errors":[{"message":"m' || n || '"}]}""", None),
    ("""{"errors":[{"error":"E"},{"error":"E","count":3000000000}]}""", None),
    ("""{"token":null,"userId":null,"errors":null,"sessionId":null,"context":null,"windowId":"w' || n || '"}""", """-|-|-|-|-|-|w' || n || '|-|-|-|"""),
    ("""{"errors":[{"error":"E","stack":["a",1]}]}""", None),
    ("""{"sdkName":"web","sdkVersion":"' || n || '","odd":[1],"context":[2],"errors":[]}""", """-|-|-|[]|-|-|-|web|' || n || '|[2]|odd"""),
    ("""{"token":"t","identifier":"{' || upper(u) || '}","sessionId":"s"}""", """t|' || u || '|-|-|s|-|-|-|-|-|"""),
    ("""{"token":"t","sessionId":"s' || n || '"}}""", None),
    ("""{"errors":[{"error":"E","handled":"yes"}]}""", None),
    ("""{"errors":{"error":"E"}}""", None),
]
_COLLECT_CASES = [
    ("""{"server_id":"s' || n || '","data":{"size":' || n || '}}""", """s' || n || '|{"size":' || n || '}|-|-|-"""),
    ("""{"identifier":"s' || n || '","data":{},"project_name":"p","context":{"a":1},"errors":[{"error":"E","handled":true}]}""", """s' || n || '|{}|[{"error":"E","handled":true}]|{"a":1}|p"""),
    ("""{"identifier":"s' || n || '","server_id":"s","data":{}}""", None),
    ("""{"token":"t' || n || '","server_id":"s","data":{}}""", None),
    ("""{"server_id":"s' || n || '"}""", None),
    ("""{"server_id":"s' || n || '","data":[]}""", None),
    ("""{"data":{"size":' || n || '}}""", None),
]
_VITALS_CASES = [
    ("""{"token":"t","vitals":[{"metric":"LCP","value":' || n || '}],"sessionId":"s' || n || '"}""", """t|[{"metric":"LCP","value":' || n || '}]|-|s' || n || '|-"""),
    ("""{"vitals":[{"metric":"LCP","value":"' || n || '"}]}""", None),
    ("""{"token":"t' || n || '"}""", None),
    ("""{"vitals":[],"metadata":{"browser":' || n || '}}""", None),
    ("""{"vitals":[],"metadata":{"browser":"B","odd":' || n || '},"windowId":"w"}""", """-|[]|{"browser":"B","odd":' || n || '}|-|w"""),
    ("""{"vitals":[{"attributes":[' || n || '],"metric":"LCP","value":1}]}""", None),
    ("""{"vitals":[' || n || ']}""", None),
    ("""{"vitals":[{"attributes":{"a":' || n || '},"metric":"CLS","value":0.5}],"metadata":null}""", """-|[{"attributes":{"a":' || n || '},"metric":"CLS","value":0.5}]|-|-|-"""),
]
_REPLAY_CASES = [
    ("""{"token":"t","sessionId":"s","sequence":' || n || ',"url":"u","events":[{"type":2}],"batchId":"b' || n || '","flushReason":"timer","isFinal":true}""", """t|s|-|-|-|true|timer|b' || n || '|' || n || '|u|-|[{"type":2}]"""),
    ("""{"token":"t","sessionId":"s","sequence":' || n || ',"url":"u","events":[],"isFinal":null}""", None),
    ("""{"token":"t","sessionId":"s","sequence":1.5,"url":"u' || n || '","events":[]}""", None),
    ("""{"token":"t","sessionId":"s","sequence":18446744073709551615,"url":"u' || n || '","events":[],"pageId":"v"}""", """t|s|-|v|-|false|-|-|18446744073709551615|u' || n || '|-|[]"""),
    ("""{"token":"t","sessionId":"s","sequence":18446744073709551616,"url":"u' || n || '","events":[]}""", None),
    ("""{"token":"t","sessionId":"s","sequence":' || n || ',"events":[]}""", None),
    ("""{"token":"t","sessionId":"s","sequence":' || n || ',"url":"u","events":[],"anonymousId":"urn:uuid:' || u || '","sessionStart":null}""", """t|s|-|-|-|false|-|-|' || n || '|u|' || u || '|[]"""),
    ("""{"token":"t","sessionId":"s","sequence":-' || n || ',"url":"u","events":[],"sessionStart":-1}""", None),
    ("""{"token":"t","sessionId":"s","sequence":' || n || ',"url":"u","events":[],"sessionStart":' || n || ',"viewId":"v","pageId":"v"}""", None),
    ("""{"token":"t","sessionId":"s","windowId":"w","sequence":0,"url":"u","events":[],"sessionStart":' || n || '}""", """t|s|w|-|' || n || '|false|-|-|0|u|-|[]"""),
]
_IDENTIFY_CASES = [
    ("""{"externalId":"c' || n || '","email":"e","name":"n","phone":"p","avatarUrl":"a","traits":{"k":' || n || '},"replaceTraits":true,"unsetTraits":["x","y"],"clearFields":["email"],"aliases":["' || u || '"]}""", """-|-|c' || n || '|e|n|p|a|{"k":' || n || '}|true|x,y|email|' || u"""),
    ("""{"token":"t' || n || '"}""", None),
    ("""{"externalId":"c' || n || '","unsetTraits":null}""", None),
    ("""{"externalId":"c' || n || '","aliases":["a",null]}""", None),
    ("""{"externalId":"c' || n || '","traits":null,"email":null,"identifier":"' || u || '","odd":1}""", """-|' || u || '|c' || n || '|-|-|-|-|-|false|||"""),
    ("""{"externalId":"c' || n || '","replaceTraits":"true"}""", None),
    ("""{"externalId":"c' || n || '","identifier":"' || u || '0"}""", None),
]
_ERROR_CASES = [
    ("""{"errors":[{"error":"E","message":"m' || n || '"}],"identifier":"i","sdk_name":"web","sdkVersion":"1","language":"js"}""", """[{"error":"E","message":"m' || n || '"}]|i|-|-|-|-|web|1|js"""),
    ("""{"identifier":"i' || n || '"}""", None),
    ("""{"errors":[],"sdkName":"web","sdk_name":"web' || n || '"}""", None),
    ("""{"errors":[],"identifier":' || n || '}""", None),
    ("""{"errors":[],"context":["' || n || '"],"windowId":"w","token":5}""", """[]|-|-|w|-|["' || n || '"]|-|-|-"""),
    ("""{"errors":null,"identifier":"i' || n || '"}""", None),
]
_KIND_CASES = {
    "web": ("fx_web", "request_id", _WEB_CASES), "collect": ("fx_metrics", "request_id", _COLLECT_CASES), "vitals": ("fx_vitals", "request_id * 8 + pos", _VITALS_CASES),
    "replay": ("fx_replay_events", "event_id", _REPLAY_CASES), "identify": ("fx_patches", "request_id", _IDENTIFY_CASES), "error": ("fx_errors", "request_id", _ERROR_CASES),
}
_NUMBERED = "SELECT cast(i AS string) AS n, '00000000-0000-4000-9000-' || lpad(cast(i % 1000000 AS string), 12, '0') AS u, i % {cases} AS pick, i FROM (SELECT {number} AS i FROM {rows}) r"


def _by_case(texts: list[str | None]) -> str:
    close = lambda x: "NULL" if x is None else f"'{x}" + ("" if x.endswith(" || u") else "'")
    return "CASE pick " + " ".join(f"WHEN {i} THEN {close(x)}" for i, x in enumerate(texts)) + " END"


def _kinds_sql() -> str:
    parts = []
    for kind, (view, number, cases) in _KIND_CASES.items():
        rows = _NUMBERED.format(cases=len(cases), number=number, rows=f"@{view}@")
        parts.append(f"SELECT '{kind}' AS kind, i AS request_id, fields IS NULL AS malformed, fields FROM (SELECT i, {_by_case([f for _, f in cases])} AS fields FROM ({rows}) q) e")
    return " UNION ALL ".join(parts)


@query(_kinds_sql())
def q_parse_kinds(spark, sf_dir):
    out = []
    for kind, (view, number, cases) in _KIND_CASES.items():
        load(spark, sf_dir, view).createOrReplaceTempView(f"bk_kind_{kind}")
        rows = spark.sql(_NUMBERED.format(cases=len(cases), number=number, rows=f"bk_kind_{kind}"))
        parsed = src.parse_request(rows.select(F.col("i").alias("request_id"), F.expr(_by_case([b for b, _ in cases])).alias("body")), kind)
        shown = [F.array_join(n, ",") if t == "texts" else F.coalesce(F.col(n).cast("string"), F.lit("-")) for n, (_, t) in src.ENVELOPES[kind].items()]
        shown += [F.array_join(F.array_sort(F.map_keys("data")), ",")] if kind == "web" else []
        out.append(parsed.select(F.lit(kind).alias("kind"), "request_id", "malformed", F.when(~F.col("malformed"), F.concat_ws("|", *shown)).alias("fields")))
    return functools.reduce(DataFrame.unionByName, out)


@query("SELECT request_id, token, organization_id IS NOT NULL AS has_org FROM @fx_web@ JOIN @fx_projects@ USING (token)")
def q_attach_context(spark, sf_dir):
    out = adm.attach_context(load(spark, sf_dir, "fx_web"), load(spark, sf_dir, "fx_projects"))
    return out.where("authorized").select("request_id", "token", F.col("organization_id").isNotNull().alias("has_org"))


@query("""WITH l AS (SELECT project_id, reference_id, arg_max(data_type, ord) AS t FROM @fx_data_sources@ GROUP BY 1, 2), d AS (SELECT project_id, count(*) AS n, string_agg(reference_id || '=' || t, ',' ORDER BY reference_id) AS rules FROM l GROUP BY 1),
 o AS (SELECT organization_id, min(user_id) AS org_owner FROM @fx_members@ WHERE role = 'owner' GROUP BY 1)
 SELECT p.project_id, p.token, coalesce(org_owner, owner_id) AS billing_owner, g.name AS organization, n AS n_sources, rules FROM @fx_projects@ p LEFT JOIN @fx_organizations@ g USING (organization_id) LEFT JOIN o ON o.organization_id = p.organization_id LEFT JOIN d ON d.project_id = p.project_id""")
def q_project_context(spark, sf_dir):
    out = adm.project_context(*[load(spark, sf_dir, f"fx_{n}") for n in ("projects", "data_sources", "organizations", "members")])
    rules = F.array_join(F.transform(F.array_sort(F.map_keys("sources")), lambda k: F.concat(k, F.lit("="), F.col("sources")[k]["data_type"])), ",")
    return out.select("project_id", "token", "billing_owner", F.col("name").alias("organization"), F.size("sources").cast("long").alias("n_sources"), rules.alias("rules"))


@query("""SELECT request_id, coalesce(h_cf, trim(split_part(h_xff, ',', 1)), h_real, CASE WHEN h_fwd LIKE 'for=%' THEN '10.4.0.1]' END, '') AS ip FROM @fx_web@""")
def q_client_ip(spark, sf_dir):
    return load(spark, sf_dir, "fx_web").select("request_id", fn.client_ip(*map(F.col, ("h_cf", "h_xff", "h_real", "h_fwd"))).alias("ip"))


_HOST_SQL = "CASE request_id % 5 WHEN 0 THEN 'shop.example.com' WHEN 1 THEN 'a.b.example.com' WHEN 4 THEN 'evil.org' ELSE CASE request_id % 3 WHEN 0 THEN 'shop.example.com' END END"


@query(f"SELECT request_id, {_HOST_SQL} AS host FROM @fx_web@")
def q_origin(spark, sf_dir):
    return load(spark, sf_dir, "fx_web").select("request_id", fn.request_origin(F.col("origin_header"), F.col("referer_header")).alias("host"))


_ALLOWED_SQL = "coalesce(CASE host_group WHEN 0 THEN true WHEN 1 THEN host = 'shop.example.com' WHEN 2 THEN host = 'example.com' OR host LIKE '%.example.com' WHEN 3 THEN host IS NOT NULL ELSE host = 'other.org' OR host = 'b.example.com' OR host LIKE '%.b.example.com' END, false)"


@query(f"WITH w AS (SELECT request_id, token, {_HOST_SQL} AS host FROM @fx_web@) SELECT request_id, {_ALLOWED_SQL} AS allowed FROM w JOIN @fx_projects@ USING (token)")
def q_hostname(spark, sf_dir):
    df = load(spark, sf_dir, "fx_web").join(load(spark, sf_dir, "fx_projects"), "token")
    hosts = F.filter(F.split(F.expr(_HOSTS), ","), lambda h: h != "")
    return df.select("request_id", fn.hostname_allowed(hosts, fn.request_origin(F.col("origin_header"), F.col("referer_header"))).alias("allowed"))


_IP_SQL = """CASE WHEN EXISTS (SELECT 1 FROM @fx_ip_rules@ r WHERE r.token = w.token AND NOT allowed AND ip = client_ip) THEN 'IP address blocked'
 WHEN EXISTS (SELECT 1 FROM @fx_ip_rules@ r WHERE r.token = w.token AND allowed) AND NOT EXISTS (SELECT 1 FROM @fx_ip_rules@ r WHERE r.token = w.token AND allowed AND ip = client_ip) THEN 'IP address not allowed' END"""


@query(f"SELECT request_id, {_IP_SQL} AS verdict FROM @fx_web@ w")
def q_ip_rules(spark, sf_dir):
    df = adm.attach_ip_rules(load(spark, sf_dir, "fx_web"), load(spark, sf_dir, "fx_ip_rules"))
    return df.select("request_id", adm.ip_verdict().alias("verdict"))


_ROUTE = "CASE request_id % 6 WHEN 0 THEN 'error' WHEN 1 THEN 'vitals' WHEN 2 THEN 'replay' WHEN 3 THEN 'collect' ELSE 'web' END"
_GATE_SQL = "CASE WHEN route = 'error' AND NOT error_tracking_enabled THEN 'error tracking disabled' WHEN route = 'vitals' AND NOT web_vitals_enabled THEN 'web vitals disabled' WHEN route = 'replay' AND NOT replays_enabled THEN 'replays disabled' END"


@query(f"WITH w AS (SELECT request_id, {_ROUTE} AS route, p.* FROM @fx_web@ JOIN @fx_projects@ p USING (token)) SELECT request_id, {_GATE_SQL} IS NULL AS keep, error_tracking_enabled AND {_GATE_SQL} IS NULL AS keep_errors, {_GATE_SQL} AS notice FROM w")
def q_feature_gate(spark, sf_dir):
    df = load(spark, sf_dir, "fx_web").join(load(spark, sf_dir, "fx_projects"), "token").withColumn("route", F.expr(_ROUTE))
    keep, errors, notice = adm.feature_gate(*map(F.col, ("route", "error_tracking_enabled", "web_vitals_enabled", "replays_enabled")))
    return df.select("request_id", keep.alias("keep"), errors.alias("keep_errors"), notice.alias("notice"))


def admitted(spark, sf_dir) -> DataFrame:
    df = adm.attach_ip_rules(adm.attach_context(load(spark, sf_dir, "fx_web"), load(spark, sf_dir, "fx_projects")), load(spark, sf_dir, "fx_ip_rules"))
    hosts = F.filter(F.split(F.expr(_HOSTS), ","), lambda h: h != "")
    return adm.admission(df.withColumns({"route": F.expr(_ROUTE), "hosts": hosts, "host": fn.request_origin(F.col("origin_header"), F.col("referer_header"))}))


@query(f"""WITH w AS (SELECT w.*, {_ROUTE} AS route, {_HOST_SQL} AS host, p.project_id, p.host_group, p.error_tracking_enabled, p.web_vitals_enabled, p.replays_enabled FROM @fx_web@ w LEFT JOIN @fx_projects@ p USING (token)),
 x AS (SELECT route, project_id, CASE WHEN route NOT IN ('collect', 'error') AND NOT {_ALLOWED_SQL} THEN 'Origin not allowed' END AS h, {_IP_SQL} AS ip, {_GATE_SQL} AS g FROM w)
 SELECT route, coalesce(CASE WHEN project_id IS NULL THEN 'Unauthorized' WHEN route IN ('vitals', 'replay') THEN coalesce(h, g, ip) ELSE coalesce(h, ip, g) END, 'admitted') AS reason, count(*) AS n FROM x GROUP BY 1, 2""")
def q_admission(spark, sf_dir):
    return admitted(spark, sf_dir).groupBy("route", F.coalesce("reject_reason", F.lit("admitted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_UUID_SQL = "substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-' || substr({0}, 13, 4) || '-' || substr({0}, 17, 4) || '-' || substr({0}, 21, 12)"


@query(f"WITH {_VISITOR_SQL.strip()} SELECT request_id, {_UUID_SQL.format('h1')} AS id FROM vis WHERE user_id IS NOT NULL")
def q_hash_id(spark, sf_dir):
    df = load(spark, sf_dir, "fx_web").where("user_id IS NOT NULL").join(load(spark, sf_dir, "fx_projects"), "token")
    return df.select("request_id", fn.hash_id(F.col("user_id"), F.col("project_id")).alias("id"))


@query(f"WITH {_VISITOR_SQL.strip()} SELECT request_id, {_UUID_SQL.format('h2')} AS id FROM vis")
def q_cookieless(spark, sf_dir):
    df = load(spark, sf_dir, "fx_web").join(load(spark, sf_dir, "fx_projects"), "token")
    return df.select("request_id", fn.cookieless_id(F.col("client_ip"), F.col("user_agent"), F.col("project_id"), F.col("received_ms")).alias("id"))


@query(f"WITH {_VISITOR_SQL.strip()} SELECT request_id, visitor, cookieless, visitor IS NULL AS rejected FROM vis")
def q_visitor_id(spark, sf_dir):
    return with_visitors(spark, sf_dir).select("request_id", "visitor", "cookieless", F.col("visitor").isNull().alias("rejected"))


@query("SELECT request_id, sha256(kind || chr(31) || message || chr(31) || stack) AS exact_hash FROM @fx_errors@")
def q_exact_hash(spark, sf_dir):
    return load(spark, sf_dir, "fx_errors").select("request_id", fn.exact_hash(F.col("kind"), F.col("message"), F.col("stack")).alias("exact_hash"))


def to_debounce(spark, sf_dir) -> DataFrame:
    rows = with_visitors(spark, sf_dir).where("visitor IS NOT NULL").withColumn("has_errors", F.col("request_id") % 17 == 0)
    return rows.withColumn("url", F.when(F.col("request_id") % 13 != 0, F.col("url")))


def debounced(spark, sf_dir) -> DataFrame:
    return dedupe.debounce(to_debounce(spark, sf_dir))


@query(f"WITH RECURSIVE {_VISITOR_SQL.strip()}, {_PAGED_SQL.strip()} SELECT vis.request_id, vis.visitor, vis.event, coalesce(kept, true) AS kept FROM vis LEFT JOIN f ON f.request_id = vis.request_id WHERE vis.visitor IS NOT NULL")
def q_debounce(spark, sf_dir):
    return debounced(spark, sf_dir).select("request_id", "visitor", "event", "kept")


@query(f"""WITH RECURSIVE {_VISITOR_SQL.strip()}, {_PAGED_SQL.strip()} SELECT project_id, strftime(make_timestamp(vis.received_ms * 1000), '%Y-%m-%d') AS day, count(*) AS suppressed FROM vis JOIN f ON f.request_id = vis.request_id WHERE NOT kept GROUP BY 1, 2""")
def q_debounce_stats(spark, sf_dir):
    return debounced(spark, sf_dir).where("NOT kept").groupBy("project_id", fn.day_of(F.col("received_ms")).alias("day")).agg(F.count(F.lit(1)).alias("suppressed"))


_DATA = """'{"event":"' || event || '","page":' || CASE WHEN request_id % 4 = 0 THEN '7' ELSE '"p' || cast(request_id % 9 AS string) || '"' END || ',"utm_source":"u' || cast(request_id % 3 AS string) || '","time_on_page":' || CASE request_id % 4 WHEN 0 THEN cast(cents AS string) WHEN 1 THEN cast(cents AS string) || '.5' WHEN 2 THEN '-1' ELSE cast(cents AS string) || '.0' END || ',"cores":' || CASE request_id % 3 WHEN 0 THEN '70000' WHEN 1 THEN '8.0' ELSE '"8"' END || ',"k":"data"}'"""


@query("SELECT request_id, event, CASE WHEN request_id % 4 <> 0 THEN 'p' || cast(request_id % 9 AS string) END AS page, 'u' || cast(request_id % 3 AS string) AS utm_source, 3 AS n_rest FROM @fx_web@")
def q_known_fields(spark, sf_dir):
    known, rest = web.extract_known(web.json_map(F.expr(_DATA)), web.WEB_FIELDS)
    out = load(spark, sf_dir, "fx_web").select("request_id", known.alias("known"), rest.alias("rest"))
    return out.select("request_id", *[F.col("known")[c].alias(c) for c in ("event", "page", "utm_source")], F.size("rest").alias("n_rest"))


@query("""SELECT request_id, '{"cores":1,"k":"data"}' AS a, CASE WHEN request_id % 2 = 0 THEN '{"cores":1,"k":"data","z":2}' ELSE '{"cores":1,"k":"data"}' END AS merged, json_extract_string(properties, '$.k') AS k FROM @fx_web@""")
def q_merge_props(spark, sf_dir):
    over = web.json_map(F.lit('{"k":"data","cores":1}'))
    under = F.when(F.col("request_id") % 2 == 0, web.merge_maps(web.json_map(F.col("properties")), web.json_map(F.lit('{"z":2}')))).otherwise(web.json_map(F.col("properties")))
    return load(spark, sf_dir, "fx_web").select("request_id", web.sorted_json(over).alias("a"), web.sorted_json(web.merge_maps(under, over)).alias("merged"), web.json_map(F.col("properties"))["k"].alias("k"))


@query("SELECT request_id, CASE WHEN request_id % 4 IN (0, 3) THEN cents END AS time_on_page FROM @fx_web@")
def q_durations(spark, sf_dir):
    return load(spark, sf_dir, "fx_web").select("request_id", fn.whole_number(web.json_number(web.json_map(F.expr(_DATA))["time_on_page"])).alias("time_on_page"))


@query("SELECT request_id, CASE WHEN request_id % 3 = 1 THEN 8 END AS cores FROM @fx_web@")
def q_u16(spark, sf_dir):
    return load(spark, sf_dir, "fx_web").select("request_id", fn.as_u16(web.json_number(web.json_map(F.expr(_DATA))["cores"])).alias("cores"))


_PERSON_SQL = """al AS (SELECT DISTINCT project_id, visitor AS distinct_id, 'person-' || substr(visitor, 1, 2) AS person FROM vis WHERE visitor IS NOT NULL AND raw_user % 2 = 0),
pe AS (SELECT DISTINCT project_id, person, 'ext-' || substr(person, 8, 2) AS external_id FROM al WHERE substr(person, 8, 1) < 'c')"""


def identity_tables(visitors: DataFrame) -> tuple[DataFrame, DataFrame]:
    aliases = visitors.where("visitor IS NOT NULL AND raw_user % 2 = 0").select("project_id", F.col("visitor").alias("distinct_id"), F.concat(F.lit("person-"), F.substring("visitor", 1, 2)).alias("person")).distinct()
    persons = aliases.where("substr(person, 8, 1) < 'c'").select("project_id", "person", F.concat(F.lit("ext-"), F.substring("person", 8, 2)).alias("external_id")).distinct()
    return aliases, persons


@query(f"WITH {_VISITOR_SQL.strip()}, {_PERSON_SQL} SELECT request_id, coalesce(pe.person, visitor) AS person_id, external_id, external_id IS NOT NULL AS is_identified FROM vis LEFT JOIN al ON al.project_id = vis.project_id AND al.distinct_id = visitor LEFT JOIN pe ON pe.project_id = al.project_id AND pe.person = al.person WHERE visitor IS NOT NULL")
def q_resolve_person(spark, sf_dir):
    v = with_visitors(spark, sf_dir).where("visitor IS NOT NULL")
    return web.resolve_person(v.withColumnRenamed("visitor", "distinct_id"), *identity_tables(v)).select("request_id", "person_id", "external_id", "is_identified")


def agents(spark, sf_dir) -> DataFrame:
    return ua.match_rules(ua.ua_dictionary(load(spark, sf_dir, "fx_web")), ua.rule_table(spark))


# What the short rule table says of each user agent of the fixtures, by index: browser, version, os, os version, device, bot.
_UA_EXPECTED = "(VALUES (0, 'Chrome', '124.0', 'Windows', '10.0', 'Desktop', false), (1, 'Safari', '17.4', 'Mac OS X', '10.15', 'Desktop', false), (2, 'Firefox', '125.0', 'Linux', '', 'Desktop', false), (3, 'Safari', '17.4', 'iOS', '17.4', 'Mobile', false), (4, 'Chrome', '124.0', 'Android', '14', 'Mobile', false), (5, 'Edge', '124.0', 'Windows', '10.0', 'Desktop', false), (6, 'Googlebot', '2.1', '', '', 'Bot', true), (7, 'Chrome', '124.0', 'Android', '13', 'Tablet', false)) AS ua(i, browser, browser_version, os, os_version, device, bot)"


@query("SELECT DISTINCT user_agent FROM @fx_web@")
def q_ua_dict(spark, sf_dir):
    return ua.ua_dictionary(load(spark, sf_dir, "fx_web"))


@query(f"SELECT DISTINCT user_agent, browser, browser_version, os, os_version, bot FROM @fx_web@ JOIN {_UA_EXPECTED} ON i = ua_idx")
def q_ua_rules(spark, sf_dir):
    return agents(spark, sf_dir).select("user_agent", "browser", "browser_version", "os", "os_version", "bot")


def product_rules(n: int = 1200) -> list[tuple]:
    """A rule a product, of six shapes, for browsers; the last one, behind them all, names any product."""
    shapes = [
        ("(Prod{0})/([0-9]+)\\.([0-9]+)", None, None, None), ("Prod{0}(?:Beta|)/([0-9]+)\\.(\\d+)", "Product {0}", "$1", "$2"), ("\\(Prod{0}[(](\\d+)[)]\\)", "Paren {0}", "$1", None),
        ("(?:Other|(Prod{0}))-(\\d+)?(?:\\.(\\d+)|)", None, None, None), ("(?<name>Prod{0}) on (\\w+)", "$1 for $1", "7", "$2"), ("(?i)(prod{0}) v(\\d+)(?:[(](\\d+)[)])?", " ", " ", "x$3"),
    ]
    rules = [("browser", k, *(x and x.format(f"{k:04d}") for x in shapes[k % 6]), False) for k in range(n)]
    return [*rules, ("browser", n, "Prod(\\d+)", "Any $1", "$1-$1x", None, False), ("os", 0, "Sys[ (]([A-Z]+)(?: |[)])", "$1 OS", None, None, False), ("device", 1, "Prod\\d+7\\b", "Spider", None, None, True), ("device", 0, "Prod00\\d+", "Old", None, None, False)]


_PRODUCT = "'Prod' || lpad(cast(k AS string), 4, '0')"


# What the six shapes and the last rule say of each string, worked out by hand; m and s are the numbers in the string.
@query(f"""SELECT DISTINCT user_agent, CASE WHEN k >= 1200 THEN 'Any ' || lpad(cast(k AS string), 4, '0') ELSE CASE k % 6 WHEN 0 THEN {_PRODUCT} WHEN 1 THEN 'Product ' || lpad(cast(k AS string), 4, '0') WHEN 2 THEN 'Paren ' || lpad(cast(k AS string), 4, '0') WHEN 3 THEN {_PRODUCT} WHEN 4 THEN {_PRODUCT} || ' for ' || {_PRODUCT} ELSE ' ' END END AS browser,
 CASE WHEN k >= 1200 THEN lpad(cast(k AS string), 4, '0') || '-' ELSE CASE k % 6 WHEN 0 THEN m || '.' || s WHEN 1 THEN m || '.' || s WHEN 2 THEN m WHEN 3 THEN CASE WHEN s = '3' THEN '' ELSE m || '.' || s END WHEN 4 THEN '7.os' || s ELSE CASE WHEN s = '3' THEN m || '.x' ELSE m || '.x' || s END END END AS browser_version,
 'AB OS' AS os, CASE WHEN k < 100 OR k < 1200 AND (k % 6 = 5 OR k % 6 = 1 AND s < '3') THEN false ELSE k % 10 = 7 END AS bot FROM @fx_agents@""")
def q_ua_rule_engine(spark, sf_dir):
    rules = spark.createDataFrame(product_rules(), ua.RULE_SCHEMA)
    return ua.match_rules(ua.ua_dictionary(load(spark, sf_dir, "fx_agents")), rules).select("user_agent", "browser", "browser_version", "os", "bot")


@query(f"SELECT request_id, device FROM @fx_web@ JOIN {_UA_EXPECTED} ON i = ua_idx")
def q_device(spark, sf_dir):
    return load(spark, sf_dir, "fx_web").select("request_id", fn.classify_device(F.col("user_agent")).alias("device"))


@query("SELECT request_id, ua_idx = 6 AS dropped FROM @fx_web@ WHERE ua_idx <> 6 OR event = 'error'")
def q_bot_filter(spark, sf_dir):
    # Web requests of bots go; kept routes (here: errors) keep theirs.
    df = load(spark, sf_dir, "fx_web").join(agents(spark, sf_dir).select("user_agent", "bot"), "user_agent", "left")
    return df.where("NOT bot OR event = 'error'").select("request_id", F.col("bot").alias("dropped"))


# Data with all kinds of known fields, among them ones of other types, and properties with a name that is known in data.
_EVENT_DATA = f"""replace({_DATA}, ',"cores"', ',"url":"' || url || '","title":"t' || cast(request_id % 5 AS string) || '","referrer":"","utm_medium":5,"utm_term":"x","utm_content":null,"browser":"Own","os":"Own","os_version":"0","session_duration":' || cast(request_id AS string) || ',"cores"')"""
_EVENT_PROPERTIES = """CASE WHEN request_id % 7 = 0 THEN NULL ELSE '{"k":1,"title":"kept","utm_source":"kept","session_duration":-1}' END"""
_COUNTRY = "CASE WHEN request_id % 3 = 0 THEN 'DE' END"


def web_events(spark, sf_dir) -> DataFrame:
    """Admitted, debounced web requests as rows: requests, context, admission, visitor, agents, debounce, person."""
    kept = admitted(spark, sf_dir).where("reject_reason IS NULL AND route = 'web'")
    kept = kept.join(agents(spark, sf_dir), "user_agent", "left").where("NOT coalesce(bot, false)")
    visitor, cookieless = web.visitor_id(F.col("cookieless_mode"), F.col("user_id"), F.col("client_ip"), F.col("user_agent"), F.col("project_id"), F.col("received_ms"))
    kept = kept.withColumn("visitor", visitor).withColumn("cookieless", cookieless).where("visitor IS NOT NULL").withColumn("has_errors", F.col("keep_errors") & (F.col("event") == "error"))
    rows = dedupe.debounce(kept).where("kept").withColumn("distinct_id", F.col("visitor"))
    rows = web.resolve_person(rows, *identity_tables(with_visitors(spark, sf_dir)))
    rows = rows.withColumns({"data": web.json_map(F.expr(_EVENT_DATA)), "properties": web.json_map(F.expr(_EVENT_PROPERTIES)), "country": F.expr(_COUNTRY), "user_id": F.col("distinct_id")})
    rows = rows.withColumnsRenamed({n: f"agent_{n}" for n in ("browser", "browser_version", "device", "os", "os_version")})
    return web.build_web_event(rows, keep=["request_id", "token", "owner_id", "organization_id"])


_EVENTS_SQL = f"""{_VISITOR_SQL.strip().replace("FROM @fx_web@ w JOIN @fx_projects@ p ON p.token = w.token", f"FROM (SELECT w.*, {_ROUTE} AS route, {_HOST_SQL} AS host FROM @fx_web@ w) w JOIN @fx_projects@ p ON p.token = w.token WHERE route = 'web' AND {_ALLOWED_SQL} AND {_IP_SQL} IS NULL AND ua_idx <> 6")},
{_DEBOUNCE_SQL.strip()}"""


# Numbers keep their value, not their spelling: 8.0 is written 8.
_PROPERTIES_SQL = """'{"cores":' || CASE request_id % 3 WHEN 0 THEN '70000' WHEN 1 THEN '8' ELSE '"8"' END || ',"k":"data","session_duration":' || cast(request_id AS string) || ',"time_on_page":' || CASE request_id % 4 WHEN 1 THEN cast(cents AS string) || '.5' WHEN 2 THEN '-1' ELSE cast(cents AS string) END || CASE WHEN request_id % 7 = 0 THEN '' ELSE ',"title":"kept","utm_source":"kept"' END || '}'"""


# Persons come from all visitors, not only from those of the admitted events.
_ALL_PERSONS_SQL = _VISITOR_SQL.strip().replace("v AS (SELECT w.*", "av AS (SELECT w.*").replace("u AS (SELECT *", "au AS (SELECT *").replace("FROM v)", "FROM av)").replace("vis AS (", "avis AS (").replace("FROM u)", "FROM au)") + ", " + _PERSON_SQL.replace("FROM vis", "FROM avis")


@query(f"""WITH RECURSIVE {_EVENTS_SQL}, {_ALL_PERSONS_SQL},
 ev AS (SELECT vis.*, ua.browser, ua.browser_version, ua.os, ua.os_version, ua.device FROM vis JOIN {_UA_EXPECTED} ON i = ua_idx LEFT JOIN f ON f.request_id = vis.request_id WHERE vis.visitor IS NOT NULL AND coalesce(kept, true))
 SELECT request_id, token, owner_id, organization_id, ev.project_id, visitor AS user_id, coalesce(pe.person, visitor) AS person_id, external_id, external_id IS NOT NULL AS is_identified, session_id, event, browser, browser_version, device, coalesce(nullif(os, ''), 'Own') AS os, coalesce(nullif(os_version, ''), '0') AS os_version,
 '' AS referrer, 'u' || cast(request_id % 3 AS string) AS utm_source, cast(NULL AS string) AS utm_medium, cast(NULL AS string) AS utm_campaign, 'x' AS utm_term, cast(NULL AS string) AS utm_content, 't' || cast(request_id % 5 AS string) AS title,
 CASE WHEN request_id % 4 <> 0 THEN 'p' || cast(request_id % 9 AS string) END AS page, url, {_COUNTRY} AS country, cookieless, CASE WHEN request_id % 4 IN (0, 3) THEN cents END AS time_on_page, request_id AS session_duration, {_PROPERTIES_SQL} AS properties, received_ms
 FROM ev LEFT JOIN al ON al.project_id = ev.project_id AND al.distinct_id = visitor LEFT JOIN pe ON pe.project_id = al.project_id AND pe.person = al.person""")
def q_web_events(spark, sf_dir):
    return web_events(spark, sf_dir).withColumn("received_ms", F.unix_millis("created_at")).drop("created_at")


@query("SELECT request_id, CASE WHEN request_id % 5 = 0 THEN '/' ELSE '/p/' || cast(cents % 3 AS string) END AS route FROM @fx_web@")
def q_routes(spark, sf_dir):
    url = F.when(F.col("request_id") % 5 == 0, " ").when(F.col("request_id") % 5 == 1, F.concat(F.regexp_replace("url", "^https://[^/]*/", ""), F.lit("#x"))).otherwise(F.col("url"))
    return load(spark, sf_dir, "fx_web").select("request_id", fn.normalize_route(url).alias("route"))


@query("SELECT page_id, coalesce(nullif(rtrim(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/'), ''), '/') AS route, lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS host FROM @pages@")
def q_page_routes(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", fn.normalize_route(F.col("url")).alias("route"), fn.host_of(F.col("url")).alias("host"))


_CTX = "CASE request_id % 4 WHEN 0 THEN '{\"a\":1,\"b\":2}' WHEN 1 THEN '7' WHEN 2 THEN '{}' ELSE '{\"a\":1}' END"
_ERR = "CASE request_id % 3 WHEN 0 THEN '{\"b\":3,\"c\":4}' WHEN 1 THEN '\"e\"' END"


@query("""SELECT request_id, CASE request_id % 12 WHEN 0 THEN '{"a":1,"b":3,"c":4}' WHEN 4 THEN '{"a":1,"b":2,"error":"e"}' WHEN 8 THEN '{"a":1,"b":2}' WHEN 9 THEN '{"b":3,"c":4,"request":7}' WHEN 1 THEN '{"error":"e","request":7}' WHEN 5 THEN '{"request":7}'
 WHEN 6 THEN '{"b":3,"c":4}' WHEN 10 THEN '{"error":"e"}' WHEN 2 THEN '{}' WHEN 3 THEN '{"a":1,"b":3,"c":4}' WHEN 7 THEN '{"a":1,"error":"e"}' ELSE '{"a":1}' END AS context FROM @fx_web@""")
def q_context(spark, sf_dir):
    return load(spark, sf_dir, "fx_web").select("request_id", web.merge_context(F.expr(_CTX), F.expr(_ERR)).alias("context"))


@query("""SELECT request_id, '{"event":"' || event || '","k":' || json_extract_string(properties, '$.k') || ',"session_id":"' || session_id || '","url":"' || url || '"}' AS context FROM @fx_web@""")
def q_row_context(spark, sf_dir):
    row = web.json_map(F.to_json(F.struct("event", "session_id", "url")))
    return load(spark, sf_dir, "fx_web").select("request_id", web.sorted_json(web.merge_maps(row, web.json_map(F.col("properties")))).alias("context"))


_TAGGED_SQL = f"""t AS (SELECT p.owner_id AS billing_owner, w.token, p.organization_id, w.request_id * 10 AS ord, CASE WHEN w.event = 'error' THEN 'error' WHEN w.request_id % 11 = 0 THEN 'server' ELSE 'web' END AS kind, w.received_ms, w.session_id FROM @fx_web@ w JOIN @fx_projects@ p USING (token)
 UNION ALL SELECT p.owner_id, w.token, p.organization_id, w.request_id * 10 + 1, 'vital', w.received_ms, w.session_id FROM @fx_web@ w JOIN @fx_projects@ p USING (token) WHERE w.request_id % 7 = 0)"""


def tagged(spark, sf_dir) -> DataFrame:
    base = load(spark, sf_dir, "fx_web").join(load(spark, sf_dir, "fx_projects"), "token").withColumn("billing_owner", F.col("owner_id"))
    rows = base.withColumn("ord", F.col("request_id") * 10).withColumn("kind", F.when(F.col("event") == "error", "error").when(F.col("request_id") % 11 == 0, "server").otherwise("web"))
    vitals = base.where("request_id % 7 = 0").withColumn("ord", F.col("request_id") * 10 + 1).withColumn("kind", F.lit("vital"))
    return rows.unionByName(vitals).select("billing_owner", "token", "organization_id", "ord", "kind", "received_ms", "session_id")


_USAGE_SQL = "SELECT billing_owner, count(*) FILTER (kind IN ('web', 'server')) AS events, count(*) FILTER (kind = 'error') AS error_tracking, count(*) FILTER (kind = 'vital') AS web_vitals, arg_min(token, ord) AS token, first(organization_id ORDER BY ord) AS organization_id FROM t GROUP BY 1"


@query(f"WITH {_TAGGED_SQL} {_USAGE_SQL}")
def q_usage(spark, sf_dir):
    return usage.usage(tagged(spark, sf_dir))


@query(f"""WITH {_TAGGED_SQL}, u AS ({_USAGE_SQL}) SELECT * FROM (SELECT billing_owner, 'events' AS metric, events AS units FROM u UNION ALL SELECT billing_owner, 'error_tracking', error_tracking FROM u UNION ALL SELECT billing_owner, 'web_vitals', web_vitals FROM u) WHERE units > 0
 UNION ALL SELECT billing_owner, 'session_replays', 1 FROM (SELECT DISTINCT billing_owner, session_id FROM t)""")
def q_usage_long(spark, sf_dir):
    rows = tagged(spark, sf_dir)
    return usage.usage_events(usage.usage(rows), rows)


@query(f"WITH {_TAGGED_SQL} SELECT received_ms - received_ms % 5000 AS window_ms, billing_owner, count(*) FILTER (kind IN ('web', 'server')) AS events, count(*) FILTER (kind = 'error') AS error_tracking, count(*) FILTER (kind = 'vital') AS web_vitals FROM t GROUP BY 1, 2")
def q_usage_window(spark, sf_dir):
    return usage.usage_by_window(tagged(spark, sf_dir).withColumn("received_at", F.timestamp_millis("received_ms")))


@query("""SELECT request_id, 'web_events' AS datasource, CASE WHEN request_id % 97 = 0 THEN 'malformed body' ELSE 'Unauthorized' END AS last_error, received_ms FROM @fx_web@ WHERE request_id % 97 = 0 OR token = 'tok_none'""")
def q_quarantine(spark, sf_dir):
    parsed = src.parse_request(load(spark, sf_dir, "fx_web").withColumn("body", F.expr(_BODY)), "web", keep=["received_ms", F.col("token").alias("sent_token")])
    known = adm.attach_context(parsed.drop("token").withColumnRenamed("sent_token", "token"), load(spark, sf_dir, "fx_projects").select("token"))
    bad = src.quarantine(known, "web_events", F.when(F.col("malformed"), "malformed body").when(~F.col("authorized"), "Unauthorized"), F.col("received_ms"))
    return bad.select("request_id", "datasource", "last_error", F.unix_millis("created_at").alias("received_ms"))


@query("""WITH q AS (SELECT request_id, received_ms FROM @fx_web@ WHERE request_id % 97 = 0 OR token = 'tok_none'), n AS (SELECT max(received_ms) AS now FROM @fx_web@)
 SELECT request_id, received_ms FROM q, n WHERE received_ms >= now - 86400000 AND request_id % 26 <> 0 ORDER BY received_ms, request_id LIMIT 50""")
def q_quarantine_replay(spark, sf_dir):
    web_rows = load(spark, sf_dir, "fx_web")
    held = q_quarantine(spark, sf_dir).select("request_id", F.timestamp_millis("received_ms").alias("created_at"), "received_ms")
    done = web_rows.where("request_id % 26 = 0").select("request_id")
    now = web_rows.agg(F.max("received_ms").alias("m")).select(F.timestamp_millis("m").alias("now"))
    return src.quarantine_replay(held, done, now, limit=50).select("request_id", "received_ms")


# Three rounds of twenty, of which the second fails at first and is run again.
@query("""WITH q AS (SELECT request_id, received_ms FROM @fx_web@ WHERE request_id % 97 = 0 OR token = 'tok_none'), n AS (SELECT max(received_ms) AS now FROM @fx_web@),
 o AS (SELECT request_id, received_ms, row_number() OVER (ORDER BY received_ms, request_id) - 1 AS i FROM q, n WHERE received_ms >= now - 86400000) SELECT request_id, received_ms, i // 20 AS batch FROM o WHERE i < 60""")
def q_dead_letter_rounds(spark, sf_dir):
    held = q_quarantine(spark, sf_dir).select("request_id", F.timestamp_millis("received_ms").alias("created_at"), "received_ms")
    now = load(spark, sf_dir, "fx_web").agg(F.max("received_ms").alias("m")).select(F.timestamp_millis("m").alias("now"))
    path = f"{src.shared_dir(spark)}/beaconry/{uuid.uuid4().hex}/dead_letters"
    # Dead letters lie in a table of their own: rounds read it, and do not parse the requests again.
    held.write.parquet(f"{path}/held")
    now.write.parquet(f"{path}/now")
    held, now = (spark.read.schema(df.schema).parquet(f"{path}/{name}") for name, df in (("held", held), ("now", now)))
    for fails in (False, True, False, False):
        some = lambda df, fails=fails: df.select("request_id", F.raise_error(F.lit("refused")).cast("long").alias("received_ms") if fails else "received_ms")
        try:
            src.replay_dead_letters(held, now, path, some, limit=20)
        except Exception as e:
            if not fails or "refused" not in str(e):
                raise
    return src.replayed(spark, path, "request_id long, received_ms long")


@query("SELECT project_id, session_id, chunk, generation || '/' || session_id || '/' || window_id || '/' || cast(coalesce(first_ts, 0) AS string) || '-' || CASE WHEN batch_id IS NOT NULL THEN sha256(batch_id) ELSE sha256(encode(window_id) || unhex(printf('%016x', sequence))) END || '.json.zst' AS object_key FROM @fx_chunks@ WHERE sequence >= 0")
def q_replay_key(spark, sf_dir):
    return load(spark, sf_dir, "fx_chunks").where("sequence >= 0").select("project_id", "session_id", "chunk", src.replay_key().alias("object_key"))


@query("SELECT CASE WHEN flush_reason LIKE 'coalesced:%' THEN 'coalesced' WHEN flush_reason = 'interval' THEN 'interval' ELSE 'unknown' END AS label, is_final, count(*) AS chunks, cast(sum(events) AS BIGINT) AS events, cast(sum(bytes) AS BIGINT) AS bytes FROM @fx_chunks@ GROUP BY 1, 2")
def q_flush_reasons(spark, sf_dir):
    label = fn.flush_reason_label(F.coalesce("flush_reason", F.lit("unknown")))
    return load(spark, sf_dir, "fx_chunks").groupBy(label.alias("label"), "is_final").agg(F.count(F.lit(1)).alias("chunks"), F.sum("events").alias("events"), F.sum("bytes").alias("bytes"))

"""Telemetry-shaped views over the benchmark tables, in SQL that Spark and the oracle engine both read.

Names in at-signs are tables or other views. Time is in epoch milliseconds.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages")

# User agents of common clients, by index.
USER_AGENTS = [
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/124.0.0.0 Safari/537.36",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.4 Safari/605.1.15",
    "Mozilla/5.0 (X11; Linux x86_64; rv:125.0) Gecko/20100101 Firefox/125.0",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_4 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.4 Mobile/15E148 Safari/604.1",
    "Mozilla/5.0 (Linux; Android 14; Pixel 8) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/124.0.0.0 Mobile Safari/537.36",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/124.0.0.0 Safari/537.36 Edg/124.0.0.0",
    "Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)",
    "Mozilla/5.0 (Linux; Android 13; Tablet SM-X200) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/124.0.0.0 Safari/537.36",
]


def _pick(index: str, values: list[str]) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1])) + f" ELSE '{values[-1]}' END"


_LANGUAGES = ["java", "javascript", "python", "php", "go", "rust", "swift"]
_N = "' || cast(user_id % 10 as string) || '"
_L = "' || cast(event_id as string) || '"
_NL = "' || chr(10) || '"
_BS, _Q = "' || chr(92) || '", "' || chr(39) || '"
#: One stack of each language: the frame's name changes with the user, line numbers and messages with the event.
_STACKS = [
    f"java.lang.IllegalStateException: bad {_L}{_NL}    at com.shop.Cart{_N}.total(Cart.java:{_L}){_NL}    at java.util.ArrayList.forEach(ArrayList.java:1511){_NL}    at app//com.shop.Main$1.run(Main.java:10){_NL}Caused by: java.io.IOException: io {_L}{_NL}    at com.shop.Disk{_N}.read(Disk.java:{_L}){_NL}    ... 2 more",
    f"TypeError: bad {_L}{_NL}    at async load{_N} (/release/src/app-{_N}.js:{_L}:7){_NL}    at new Worker (node:internal/workers:22:3){_NL}    at run (https://cdn.example.com/assets/main.0123456789ab.js:1:{_L}){_NL}save@https://x.example.com/src/save.js:5:1",
    f"Traceback (most recent call last):{_NL}  File \"/srv/app/io.py\", line {_L}, in read{_NL}    data = f.read(){_NL}OSError: disk {_L}{_NL}{_NL}The above exception was the direct cause of the following exception:{_NL}{_NL}Traceback (most recent call last):{_NL}  File \"/srv/app/main.py\", line {_L}, in main{_NL}  File \"/srv/app/cart.py\", line 7, in total{_N}{_NL}    return x{_NL}ValueError: bad {_L}",
    f"PHP Fatal error: Uncaught RuntimeException: bad {_L} in /var/www/a.php:3{_NL}Stack trace:{_NL}#0 /var/www/src/Cart.php({_L}): Shop{_BS}Cart->total{_N}(1, 2){_NL}#1 [internal function]: Shop{_BS}Run->call(){_NL}#2 {{main}}",
    f"panic: bad {_L}{_NL}{_NL}goroutine 1 [running]:{_NL}main.(*Cart).Total{_N}(0xc000{_L}){_NL}\t/go/src/shop/cart.go:{_L} +0x1d{_NL}runtime.main(){_NL}\t/usr/local/go/src/runtime/proc.go:250 +0x2{_NL}created by main.start in goroutine 5{_NL}\t/go/src/shop/main.go:9 +0x3{_NL}{_NL}goroutine 2 [sleep]:{_NL}main.other(){_NL}\t/go/src/shop/other.go:1",
    f"thread {_Q}main{_Q} panicked at src/cart.rs:{_L}:5:{_NL}bad{_NL}stack backtrace:{_NL}   0: std::panicking::begin_panic{_NL}   1: 0x55{_L} - shop::cart::total{_N}::h0123456789abcdef{_NL}             at /build/src/cart.rs:{_L}:9{_NL}   2: shop::main{_NL}             at ./src/main.rs:4:1",
    f"shop/Cart.swift:{_L}: Fatal error: bad{_NL}Thread 0 crashed:{_NL}0 0x0001 total{_N}() + 44 in shop at /src/shop/Cart.swift:{_L}:9{_NL}1 [ra] 0x0002 main + 12 in shop at /src/shop/main.swift:3:1{_NL}Thread 1:{_NL}0 0x0003 idle() in libsystem",
]
_KINDS = ["java.lang.IllegalStateException", "TypeError", "ValueError", "RuntimeException", "panic", "panic", "Fatal error"]

VIEWS = {
    "fx_projects": """
SELECT '00000000-0000-4000-8000-' || lpad(cast(n_nationkey AS string), 12, '0') AS project_id, 'tok_' || cast(n_nationkey AS string) AS token,
       'usr_' || cast(n_nationkey AS string) AS owner_id, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE 'org_' || cast(n_regionkey AS string) END AS organization_id,
       CASE n_nationkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS cookieless_mode, n_nationkey % 5 <> 4 AS error_tracking_enabled,
       n_nationkey % 5 <> 3 AS web_vitals_enabled, n_nationkey % 5 <> 2 AS replays_enabled, n_nationkey % 5 AS host_group
FROM @nation@""",
    "fx_organizations": "SELECT 'org_' || cast(r_regionkey AS string) AS organization_id, r_name AS name FROM @region@",
    "fx_members": """
SELECT 'org_' || cast(s_nationkey % 5 AS string) AS organization_id, 'usr_s' || cast(s_suppkey AS string) AS user_id,
       CASE WHEN s_suppkey % 10 < 5 AND s_suppkey < 5 THEN 'owner' ELSE 'member' END AS role FROM @supplier@""",
    "fx_data_sources": """
SELECT p.project_id, d.reference_id, d.ord, d.data_type, d.metric_shape, d.regex, d.allow_negative, d.allow_float, d.min_value, d.max_value FROM @fx_projects@ p CROSS JOIN (
SELECT 1 AS ord, 'size' AS reference_id, 'number' AS data_type, 'scalar' AS metric_shape, cast(NULL AS string) AS regex, false AS allow_negative, false AS allow_float, cast(5 AS double) AS min_value, cast(45 AS double) AS max_value
UNION ALL SELECT 2, 'brand', 'string', 'scalar', '#[1-3]', NULL, NULL, NULL, NULL UNION ALL SELECT 3, 'price', 'number', 'scalar', NULL, true, true, NULL, 1500
UNION ALL SELECT 4, 'tags', 'number', 'array', NULL, false, false, NULL, NULL UNION ALL SELECT 5, 'limits', 'number', 'map', NULL, true, true, 0, NULL
UNION ALL SELECT 6, 'flag', 'boolean', 'scalar', NULL, NULL, NULL, NULL, NULL UNION ALL SELECT 7, 'blob', 'json', 'scalar', NULL, NULL, NULL, NULL, NULL
UNION ALL SELECT 8, 'badre', 'string', 'scalar', '([', NULL, NULL, NULL, NULL UNION ALL SELECT 0, 'size', 'string', 'scalar', NULL, NULL, NULL, NULL, NULL) d""",
    "fx_ip_rules": """
SELECT 'tok_' || cast(n_nationkey AS string) AS token, '10.0.0.' || cast(n_nationkey % 30 AS string) AS ip, n_nationkey % 2 = 0 AS allowed FROM @nation@
UNION ALL SELECT 'tok_1', '10.0.0.6', false UNION ALL SELECT 'tok_2', '10.0.0.2', true UNION ALL SELECT 'tok_2', '10.0.0.7', true UNION ALL SELECT 'tok_2', '10.0.0.12', true""",
    "fx_web": """
SELECT event_id AS request_id, 1704067200000 + event_id * 200 AS received_ms, CASE WHEN event_id % 61 = 0 THEN 'tok_none' ELSE 'tok_' || cast(user_id % 5 AS string) END AS token,
       CASE WHEN user_id % 7 = 0 THEN NULL ELSE '00000000-0000-4000-9000-' || lpad(cast(user_id % 10 AS string), 12, '0') END AS user_id,
       CASE event_type WHEN 'view' THEN 'pageview' WHEN 'click' THEN 'page_leave' ELSE event_type END AS event,
       'https://shop.example.com/p/' || cast(cast(floor(value * 100) AS bigint) % 3 AS string) || '/?q=1' AS url, '10.0.0.' || cast(user_id % 30 AS string) AS client_ip,
       event_id % 8 AS ua_idx, 's' || cast(user_id AS string) AS session_id, props AS properties, user_id AS raw_user, cast(floor(value * 100) AS bigint) AS cents,
       """ + _pick("event_id % 8", USER_AGENTS) + """ AS user_agent,
       """ + _pick("event_id % 5", ["https://Shop.Example.com", "http://a.b.example.com:8080", "null", "", "https://evil.org/x"]) + """ AS origin_header,
       """ + _pick("event_id % 3", ["https://shop.example.com/p?x=1", "not a url", ""]) + """ AS referer_header,
       CASE WHEN event_id % 4 = 0 THEN '10.1.0.' || cast(event_id % 9 AS string) END AS h_cf, CASE WHEN event_id % 4 = 1 THEN ' 10.2.0.1 , 10.9.9.9' END AS h_xff,
       CASE WHEN event_id % 8 = 2 THEN '10.3.0.1' END AS h_real, CASE WHEN event_id % 8 = 6 THEN 'for="[10.4.0.1]:80";proto=http' WHEN event_id % 8 = 3 THEN 'proto=http;For=10.5.0.1:99' END AS h_fwd
FROM @events@""",
    "fx_agents": """
WITH p AS (SELECT p_partkey % 1300 AS k, cast(p_size AS string) AS m, cast(p_partkey % 5 AS string) AS s FROM @part@),
n AS (SELECT *, 'Prod' || lpad(cast(k AS string), 4, '0') AS name FROM p)
SELECT k, m, s, 'Mozilla/5.0 (Sys(AB) like) ' || CASE k % 6 WHEN 0 THEN name || '/' || m || '.' || s WHEN 1 THEN name || CASE WHEN s < '3' THEN 'Beta/' ELSE '/' END || m || '.' || s WHEN 2 THEN '(' || name || '(' || m || '))'
       WHEN 3 THEN name || '-' || CASE WHEN s = '3' THEN '' ELSE m END || '.' || s WHEN 4 THEN name || ' on os' || s ELSE upper(name) || ' v' || m || CASE WHEN s = '3' THEN '' ELSE '(' || s || ')' END END
       || CASE WHEN k >= 1200 THEN ' ' || name ELSE '' END AS user_agent FROM n""",
    "fx_errors": f"""
SELECT event_id AS request_id, 1704067200000 + event_id * 200 AS received_ms, '00000000-0000-4000-8000-' || lpad(cast(user_id % 5 AS string), 12, '0') AS project_id,
       {_pick("event_id % 7", _LANGUAGES)} AS language, {_pick("event_id % 7", _KINDS)} AS kind, 'bad ' || cast(event_id AS string) AS message, {_pick("event_id % 7", _STACKS)} AS stack,
       cast(event_id % 5 AS int) - 1 AS n, CASE WHEN event_id % 3 = 0 THEN 'b' || cast(event_id % 6 AS string) END AS item_build, 'r' || cast(user_id % 4 AS string) AS request_build,
       CASE WHEN event_id % 4 = 0 THEN true END AS handled, 's' || cast(user_id AS string) AS session_id, user_id AS raw_user
FROM @events@ WHERE event_type = 'error'""",
    "fx_error_gaps": """
SELECT request_id, project_id, language, kind, CASE WHEN request_id % 3 = 0 THEN NULL ELSE message END AS message, CASE request_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN 'not a stack' ELSE stack END AS stack, n, item_build, request_build,
       handled, CASE WHEN request_id % 7 = 0 THEN NULL ELSE session_id END AS session_id, raw_user FROM @fx_errors@""",
    "fx_grouping": """
SELECT project_id, 'modern' AS mode, CASE right(project_id, 1) WHEN '0' THEN 'error_kind_only' WHEN '2' THEN 'root_and_terminal_cause' ELSE 'terminal_cause_frames' END AS segment_selection, true AS include_error_kind, 'bounded' AS raw_stack_policy, 1048576 AS raw_stack_max_bytes,
       CASE right(project_id, 1) WHEN '1' THEN 1 ELSE 8 END AS max_frames, true AS include_function, right(project_id, 1) <> '2' AS include_module, right(project_id, 1) <> '2' AS include_file, 'exclude_when_application_frame_exists' AS runtime_frame_policy, 'deduplicate' AS adjacent_frame_policy
FROM (SELECT DISTINCT project_id FROM @fx_errors@) WHERE right(project_id, 1) <> '4'""",
    "fx_limits": """
SELECT project_id, CASE right(project_id, 1) WHEN '0' THEN 'legacy' ELSE 'modern' END AS mode, 'terminal_cause_frames' AS segment_selection, true AS include_error_kind, CASE right(project_id, 1) WHEN '3' THEN 'never' ELSE 'bounded' END AS raw_stack_policy, 1048576 AS raw_stack_max_bytes,
       8 AS max_frames, true AS include_function, true AS include_module, true AS include_file, 'exclude_when_application_frame_exists' AS runtime_frame_policy, 'deduplicate' AS adjacent_frame_policy,
       CASE right(project_id, 1) WHEN '2' THEN 40 ELSE 1048576 END AS parser_max_input_bytes, CASE right(project_id, 1) WHEN '1' THEN 2 ELSE 16384 END AS parser_max_lines, CASE right(project_id, 1) WHEN '3' THEN 20 ELSE 65536 END AS parser_max_line_bytes
FROM (SELECT DISTINCT project_id FROM @fx_errors@) WHERE right(project_id, 1) <> '4'""",
    "fx_exclusions": """
SELECT project_id, 1 AS position, 'function' AS field, 'prefix' AS matcher, 'shop::main' AS pattern FROM (SELECT DISTINCT project_id FROM @fx_errors@) WHERE right(project_id, 1) = '3'
UNION ALL SELECT project_id, 2, 'module', 'exact', 'nowhere' FROM (SELECT DISTINCT project_id FROM @fx_errors@) WHERE right(project_id, 1) = '3'""",
    "fx_vitals": """
SELECT l_orderkey AS request_id, 1704067200000 + l_orderkey * 50 AS received_ms, cast(l_linenumber AS int) AS pos,
       """ + _pick("cast(l_linenumber AS int) - 1", ["LCP", "FCP", "INP", "CLS", "TTFB", "FID", "CUSTOM"]) + """ AS metric,
       CASE WHEN l_linenumber = 4 THEN l_discount * 5 ELSE l_extendedprice / 20 END AS value, 's' || cast(l_orderkey % 100 AS string) AS session_id,
       CASE WHEN l_orderkey % 3 = 0 THEN 'Chrome' END AS m_browser, CASE l_orderkey % 4 WHEN 0 THEN 'Desktop' WHEN 1 THEN '' END AS m_device, CASE WHEN l_orderkey % 5 = 0 THEN 'Linux' END AS m_os,
       CASE WHEN l_orderkey % 7 < 5 THEN 'Firefox' WHEN l_orderkey % 7 = 5 THEN '' END AS ua_browser, CASE WHEN l_orderkey % 7 < 5 THEN 'Mobile' WHEN l_orderkey % 7 = 5 THEN '' END AS ua_device, CASE WHEN l_orderkey % 7 < 4 THEN 'Android' END AS ua_os,
       CASE WHEN l_orderkey % 11 < 5 THEN '14.2' WHEN l_orderkey % 11 < 8 THEN '' END AS ua_browser_version, CASE WHEN l_orderkey % 13 < 6 THEN '13' WHEN l_orderkey % 13 < 9 THEN '' END AS ua_os_version, CASE WHEN l_linenumber % 2 = 0 THEN '{"a":1}' END AS attributes
FROM @lineitem@""",
    "fx_patches": """
SELECT o_orderkey AS request_id, '00000000-0000-4000-8000-' || lpad(cast(o_custkey % 7 AS string), 12, '0') AS project_id, o_orderkey AS seq,
       CASE WHEN o_orderkey % 41 = 0 THEN '  ' ELSE ' c' || cast(o_custkey AS string) || ' ' END AS external_id, o_custkey % 7 = 6 AS cookieless,
       CASE WHEN o_orderkey % 3 <> 0 THEN 'u' || cast(o_orderkey AS string) || '@x.org' END AS email, o_orderkey % 11 = 0 AS clear_email,
       CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS name, o_orderpriority AS trait, cast(floor(o_totalprice) AS bigint) AS trait_value, o_orderkey % 13 = 0 AS replace_traits,
       CASE WHEN o_orderkey % 17 = 0 THEN '5-LOW' END AS unset_trait, CASE WHEN o_orderkey % 19 = 0 THEN 'no-uuid' ELSE '00000000-0000-4000-9000-' || lpad(cast(o_orderkey % 500 AS string), 12, '0') END AS alias
FROM @orders@""",
    "fx_metrics": """
SELECT p_partkey AS request_id, '00000000-0000-4000-8000-' || lpad(cast(p_partkey % 5 AS string), 12, '0') AS project_id, 1704067200000 + p_partkey * 1000 AS received_ms,
       cast(p_size AS bigint) AS size, p_brand AS brand, p_retailprice AS price, p_name AS name, p_type AS type,
       '{"size":' || CASE p_partkey % 5 WHEN 0 THEN '"' || cast(p_size AS string) || '"' WHEN 1 THEN cast(p_size AS string) || '.5' WHEN 2 THEN '-' || cast(p_size AS string) ELSE cast(p_size AS string) END
       || ',"brand":' || CASE WHEN p_partkey % 11 = 0 THEN '7' ELSE '"' || p_brand || '"' END || ',"price":' || CASE p_partkey % 7 WHEN 0 THEN '" 42 "' WHEN 1 THEN '"1d"' ELSE cast(p_partkey % 2000 AS string) || '.25' END
       || ',"tags":' || CASE p_partkey % 6 WHEN 0 THEN '5' WHEN 1 THEN '[]' WHEN 2 THEN '[1,-2,"x",3]' WHEN 3 THEN '[1,null,2.5]' ELSE '[1,2]' END
       || ',"limits":' || CASE p_partkey % 4 WHEN 0 THEN '[1]' WHEN 1 THEN '{"a":1,"b":-1}' ELSE '{"a":2}' END
       || ',"flag":' || CASE p_partkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN '"true"' ELSE 'null' END || ',"blob":' || CASE p_partkey % 3 WHEN 0 THEN '[[[[[[[[[1]]]]]]]]]' WHEN 1 THEN '{"k":[1,{"q":"},[{"}]}' ELSE '5' END
       || ',"badre":"' || p_name || '","junk":1}' AS data
FROM @part@""",
    "fx_replay_events": """
SELECT event_id, 'p' || cast(user_id % 3 AS string) AS project_id, 's' || cast(user_id AS string) AS session_id, event_id // 500 AS chunk, event_id % 8 AS type, event_id % 17 AS source,
       CASE WHEN event_id % 23 = 0 THEN NULL ELSE 1704067200000.0 + (event_id - event_id % 3) * 200 + CASE WHEN event_id % 4 = 0 THEN 0.5 ELSE 0.0 END END AS ts,
       CASE WHEN event_id % 5 <> 0 THEN event_id % 100 END AS seq_id, CASE WHEN event_type = 'view' THEN 'https://shop.example.com/r/' || cast(user_id % 4 AS string) || CASE WHEN event_id % 2 = 0 THEN '/?x=1' ELSE '' END END AS href,
       'https://shop.example.com/start/' || cast(user_id % 2 AS string) AS chunk_url, 1704067200000 + event_id * 200 AS received_ms, event_type, value
FROM @events@""".replace("event_id // 500", "cast(floor(event_id / 500) AS bigint)"),
    "fx_chunks": """
SELECT project_id, session_id, session_id AS window_id, 'g' || cast(chunk % 2 AS string) AS generation, chunk, max(received_ms) AS received_ms, CASE WHEN chunk % 5 = 0 THEN chunk - 1 ELSE chunk END AS sequence,
       CASE WHEN chunk % 5 = 0 THEN chunk - 1 ELSE chunk END AS first_sequence, CASE WHEN chunk % 6 = 0 THEN chunk + 1 ELSE CASE WHEN chunk % 5 = 0 THEN chunk - 1 ELSE chunk END END AS last_sequence,
       CASE WHEN chunk % 3 = 0 THEN NULL WHEN chunk % 7 = 0 THEN 'b' || cast(chunk - 1 AS string) ELSE 'b' || cast(chunk AS string) END AS batch_id, chunk % 9 = 8 AS is_final,
       count(*) AS events, min(cast(floor(ts) AS bigint)) AS first_ts, max(cast(floor(ts) AS bigint)) AS last_ts, max(CASE WHEN type = 2 THEN 1 ELSE 0 END) = 1 AS has_full_snapshot, count(*) * 100 AS bytes,
       CASE chunk % 4 WHEN 0 THEN 'coalesced:timer' WHEN 1 THEN 'interval' WHEN 2 THEN 'strange' END AS flush_reason, min(href) AS entry_url, max(href) AS exit_url,
       CASE WHEN chunk % 4 = 1 THEN NULL ELSE session_id || '-' || cast(chunk % 3 AS string) END AS identifier, min(received_ms) - 5000 + chunk % 2 * 9000 AS session_start_ms
FROM @fx_replay_events@ GROUP BY project_id, session_id, chunk""",
    "fx_filters": """
SELECT request_id, 'p' || cast(raw_user % 3 AS string) AS project_id, session_id, session_id AS window_id, received_ms, CASE WHEN request_id % 3 = 0 THEN NULL ELSE 'B' || cast(ua_idx AS string) END AS browser,
       CASE WHEN request_id % 4 = 0 THEN NULL ELSE 'C' || cast(request_id % 5 AS string) END AS country, CASE WHEN request_id % 5 = 0 THEN NULL ELSE 'O' || cast(request_id % 2 AS string) END AS os, url
FROM @fx_web@""",
}
_NAME = re.compile(r"@(\w+)@")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table of the folder, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tag = hashlib.sha256(sf_dir.encode()).hexdigest()[:8]

    def temp(m: re.Match) -> str:
        view = f"bk_{tag}_{m[1]}"
        load(spark, sf_dir, m[1]).createOrReplaceTempView(view)
        return view

    return spark.sql(_NAME.sub(temp, VIEWS[name]))


def oracle(body: str) -> str:
    """body with the views it uses, and the views those use, as common table expressions of the oracle engine."""
    order: list[str] = []

    def visit(text: str) -> None:
        for n in _NAME.findall(text):
            if n in VIEWS and n not in order:
                visit(VIEWS[n])
                order.append(n)

    visit(body)
    clean = lambda t: _NAME.sub(r"\1", t)
    ctes = [f"{n} AS ({clean(VIEWS[n])})" for n in order]
    body = clean(body).strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join([*ctes, body[len("WITH RECURSIVE") :].strip()])
    if body.upper().startswith("WITH"):
        return "WITH " + ", ".join([*ctes, body[4:].strip()])
    return ("WITH " + ", ".join(ctes) + " " if ctes else "") + body

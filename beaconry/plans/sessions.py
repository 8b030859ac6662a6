"""Queries of session replay."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from beaconry.functions import scalars as fn
from beaconry.operators import dedupe, replay, vitals
from beaconry.sources.fixtures import load, oracle
from beaconry.sources.objects import read_chunk_objects, write_chunk_objects
from beaconry.sources.requests import replay_key, shared_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = oracle(sql)
        return f

    return add


_TS = "CASE WHEN ts >= 0 THEN cast(floor(ts + 0.5) AS BIGINT) END"
_ORD = f"ord AS (SELECT *, {_TS} AS event_ts, row_number() OVER (PARTITION BY project_id, session_id, chunk ORDER BY {_TS} ASC NULLS FIRST, seq_id ASC NULLS FIRST, event_id) AS place FROM @fx_replay_events@)"


@query(f"WITH {_ORD} SELECT event_id, event_ts, cast(place AS INTEGER) AS place FROM ord")
def q_replay_order(spark, sf_dir):
    return replay.order_events(load(spark, sf_dir, "fx_replay_events")).select("event_id", "event_ts", "place")


# An event's data: complete for the type and source, except that every eleventh lacks a member, and that some of the
# others have a member of a wrong shape.
_NODE = '{"type":0,"id":1,"childNodes":[{"type":2,"id":2,"tagName":"p","attributes":{"a":"b"},"childNodes":[{"type":3,"id":3,"textContent":"x"}]}]}'
_DATA = """CASE WHEN type = 2 THEN '{"node":' || CASE WHEN event_id % 5 = 0 THEN '{}' ELSE '@node' END || CASE WHEN event_id % 11 = 0 THEN '}' WHEN event_id % 7 = 0 THEN ',"initialOffset":{"top":0}}' ELSE ',"initialOffset":{"top":0,"left":1.5}}' END
 WHEN type = 4 THEN CASE WHEN event_id % 11 = 0 THEN '{"href":"x","width":1}' WHEN event_id % 7 = 0 THEN '{"href":"x","width":"1","height":2}' ELSE '{"href":"x","width":1,"height":2}' END
 WHEN type = 5 THEN CASE WHEN event_id % 11 = 0 THEN '{"tag":"t"}' ELSE '{"tag":"t","payload":{"href":"/a/?x"}}' END WHEN type = 6 THEN '{"plugin":"p","payload":1}'
 WHEN type = 7 THEN CASE WHEN event_id % 11 = 0 THEN '{"asset":1}' WHEN event_id % 7 = 0 THEN '{"url":"u","failed":{"status":70000,"message":"m"}}' ELSE '{"url":"u","payload":{"rr_type":"CssText","cssTexts":["a"]}}' END
 WHEN type = 3 THEN '{"source":' || cast(source AS string) || CASE WHEN event_id % 11 = 0 THEN '' ELSE ',"texts":[],"attributes":[],"removes":[],"adds":[],"positions":[{"x":1,"y":2.5,"id":3' || CASE WHEN event_id % 13 = 0 THEN '' ELSE ',"timeOffset":-5' END || '}],"pointerType":' || cast(event_id % 4 AS string)
  || ',"type":' || cast(event_id % 6 AS string) || ',"id":1,"x":1,"y":2,"width":1,"height":1,"text":"t","isChecked":false,"family":"f","fontSource":"s","buffer":false,"index":[],"ranges":[],"styleIds":[],"commands":[]' END || '}'
 WHEN event_id % 11 = 0 THEN NULL ELSE '{}' END""".replace("@node", _NODE)
_FAULT = """CASE WHEN ts IS NULL THEN 'bad timestamp' WHEN type IN (0, 1) AND event_id % 11 = 0 THEN 'missing data' WHEN type IN (0, 1) THEN NULL
 WHEN type = 2 THEN CASE WHEN event_id % 11 = 0 THEN 'missing initialOffset' WHEN event_id % 7 = 0 THEN 'bad initialOffset' WHEN event_id % 5 = 0 THEN 'bad node' END
 WHEN type = 4 THEN CASE WHEN event_id % 11 = 0 THEN 'missing height' WHEN event_id % 7 = 0 THEN 'bad width' END WHEN type = 5 THEN CASE WHEN event_id % 11 = 0 THEN 'missing payload' END
 WHEN type = 6 THEN NULL WHEN type = 7 THEN CASE WHEN event_id % 11 = 0 THEN 'missing url' WHEN event_id % 7 = 0 THEN 'bad failed' END WHEN source = 11 THEN 'unknown source'
 WHEN event_id % 11 = 0 THEN CASE source WHEN 0 THEN 'missing texts' WHEN 1 THEN 'missing positions' WHEN 2 THEN 'missing type' WHEN 3 THEN 'missing id' WHEN 4 THEN 'missing width' WHEN 5 THEN 'missing id' WHEN 6 THEN 'missing positions' WHEN 7 THEN 'missing type' WHEN 9 THEN 'missing id' WHEN 10 THEN 'missing family' WHEN 12 THEN 'missing positions' WHEN 13 THEN 'missing index' WHEN 14 THEN 'missing ranges' WHEN 15 THEN 'missing id' END
 WHEN source IN (1, 6, 12) AND event_id % 13 = 0 THEN 'bad positions' WHEN source = 2 AND event_id % 4 = 3 THEN 'bad pointerType'
 WHEN source = 7 AND event_id % 6 > 4 THEN 'bad type' WHEN source = 9 AND event_id % 6 > 2 THEN 'bad type' END"""


def with_faults(spark, sf_dir):
    df = load(spark, sf_dir, "fx_replay_events").withColumn("data", F.try_parse_json(F.expr(_DATA)))
    return df.withColumn("fault", replay.event_fault(F.col("type"), F.col("ts").cast("double"), F.lit(None).cast("double"), F.col("data")))


@query(f"SELECT event_id, {_FAULT} AS fault FROM @fx_replay_events@")
def q_replay_quality(spark, sf_dir):
    return with_faults(spark, sf_dir).select("event_id", "fault")


@query(f"""WITH f AS (SELECT *, chunk % 3 = 0 AS is_final, {_FAULT} AS fault FROM @fx_replay_events@), c AS (SELECT project_id, session_id, chunk, is_final, count(*) FILTER (fault IS NULL) AS kept, count(*) FILTER (fault IS NOT NULL) AS dropped FROM f GROUP BY 1, 2, 3, 4)
 SELECT *, CASE WHEN kept > 0 THEN 'stored' WHEN is_final THEN 'completes' ELSE 'rejected' END AS outcome FROM c""")
def q_dropped_events(spark, sf_dir):
    return replay.drop_invalid(with_faults(spark, sf_dir).withColumn("is_final", F.col("chunk") % 3 == 0))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN '/a' WHEN 1 THEN NULL WHEN 2 THEN CASE WHEN href IS NULL THEN NULL ELSE '/r/' || substr(split_part(href, '/r/', 2), 1, 1) END ELSE '/u' END AS route FROM @fx_replay_events@")
def q_event_routes(spark, sf_dir):
    text = F.expr("""CASE event_id % 4 WHEN 0 THEN '{"payload":{"href":"/a/?x"},"href":"/no"}' WHEN 1 THEN '{"href":5,"url":"/no"}' WHEN 2 THEN CASE WHEN href IS NULL THEN '{}' ELSE concat('{"href":"', href, '"}') END ELSE '{"url":"u/#z"}' END""")
    return load(spark, sf_dir, "fx_replay_events").select("event_id", replay.event_route(F.try_parse_json(text)).alias("route"))


_SPANS = _ORD + """, rt AS (SELECT *, CASE WHEN href IS NOT NULL THEN '/r/' || substr(split_part(href, '/r/', 2), 1, 1) END AS route FROM ord),
hd AS (SELECT *, coalesce(last_value(route IGNORE NULLS) OVER (PARTITION BY project_id, session_id, chunk ORDER BY place ROWS UNBOUNDED PRECEDING), '/start/' || right(chunk_url, 1)) AS here FROM rt),
nw AS (SELECT *, CASE WHEN here = lag(here) OVER (PARTITION BY project_id, session_id, chunk ORDER BY place) THEN 0 ELSE 1 END AS new FROM hd),
sp AS (SELECT *, sum(new) OVER (PARTITION BY project_id, session_id, chunk ORDER BY place) AS span FROM nw),
spans AS (SELECT project_id, session_id, chunk, cast(span AS BIGINT) AS span, min(here) AS route, arg_min(event_ts, place) FILTER (event_ts IS NOT NULL) AS from_ms, arg_max(event_ts, place) FILTER (event_ts IS NOT NULL) AS to_ms, count(*) AS events FROM sp GROUP BY 1, 2, 3, 4)"""


def spans(spark, sf_dir):
    df = replay.order_events(load(spark, sf_dir, "fx_replay_events"))
    return replay.route_spans(df.withColumn("route", F.when(F.col("href").isNotNull(), fn.normalize_route(F.col("href")))))


@query(f"WITH {_SPANS} SELECT * FROM spans")
def q_route_spans(spark, sf_dir):
    return spans(spark, sf_dir)


@query(f"WITH {_SPANS}, d AS (SELECT project_id, session_id, chunk, route, min(span) AS s FROM spans GROUP BY 1, 2, 3, 4) SELECT project_id, session_id, chunk, string_agg(route, ',' ORDER BY s) AS routes, (SELECT arg_min(route, span) FROM spans x WHERE x.project_id = d.project_id AND x.session_id = d.session_id AND x.chunk = d.chunk) AS entry_route, (SELECT arg_max(route, span) FROM spans x WHERE x.project_id = d.project_id AND x.session_id = d.session_id AND x.chunk = d.chunk) AS exit_route FROM d GROUP BY 1, 2, 3")
def q_chunk_routes(spark, sf_dir):
    return replay.chunk_routes(spans(spark, sf_dir)).withColumn("routes", F.array_join("routes", ","))


@query(f"WITH {_ORD} SELECT project_id, session_id, chunk, count(*) AS events, min(event_ts) AS first_ts, max(event_ts) AS last_ts, bool_or(type = 2) AS has_full_snapshot FROM ord GROUP BY 1, 2, 3")
def q_chunk_stats(spark, sf_dir):
    return replay.chunk_stats(replay.order_events(load(spark, sf_dir, "fx_replay_events")))


_FOLD = """n AS (SELECT *, row_number() OVER (PARTITION BY project_id, session_id, window_id, generation ORDER BY received_ms, chunk) AS i FROM @fx_chunks@),
g AS (SELECT project_id, session_id, generation, i, chunk, true AS kept, CASE WHEN batch_id IS NULL THEN [] ELSE [batch_id] END AS bs, [first_sequence] AS lo, [last_sequence] AS hi FROM n WHERE i = 1
 UNION ALL SELECT n.project_id, n.session_id, n.generation, n.i, n.chunk, NOT (coalesce(list_contains(g.bs, n.batch_id), false) OR len(list_filter(range(1, len(g.lo) + 1), lambda k: n.sequence BETWEEN g.lo[k] AND g.hi[k])) > 0),
  CASE WHEN NOT (coalesce(list_contains(g.bs, n.batch_id), false) OR len(list_filter(range(1, len(g.lo) + 1), lambda k: n.sequence BETWEEN g.lo[k] AND g.hi[k])) > 0) AND n.batch_id IS NOT NULL THEN list_append(g.bs, n.batch_id) ELSE g.bs END,
  CASE WHEN NOT (coalesce(list_contains(g.bs, n.batch_id), false) OR len(list_filter(range(1, len(g.lo) + 1), lambda k: n.sequence BETWEEN g.lo[k] AND g.hi[k])) > 0) THEN list_append(g.lo, n.first_sequence) ELSE g.lo END,
  CASE WHEN NOT (coalesce(list_contains(g.bs, n.batch_id), false) OR len(list_filter(range(1, len(g.lo) + 1), lambda k: n.sequence BETWEEN g.lo[k] AND g.hi[k])) > 0) THEN list_append(g.hi, n.last_sequence) ELSE g.hi END
 FROM g JOIN n ON n.project_id = g.project_id AND n.session_id = g.session_id AND n.generation = g.generation AND n.i = g.i + 1)"""
_KEPT = _FOLD + ", kc AS (SELECT c.* FROM @fx_chunks@ c JOIN g ON g.project_id = c.project_id AND g.session_id = c.session_id AND g.generation = c.generation AND g.chunk = c.chunk WHERE kept)"


@query(f"WITH RECURSIVE {_FOLD} SELECT project_id, session_id, chunk, kept FROM g")
def q_dedupe_chunks(spark, sf_dir):
    return dedupe.dedupe_chunks(load(spark, sf_dir, "fx_chunks")).select("project_id", "session_id", "chunk", "kept")


def kept_chunks(spark, sf_dir):
    return dedupe.dedupe_chunks(load(spark, sf_dir, "fx_chunks")).where("kept")


@query(f"WITH RECURSIVE {_KEPT} SELECT project_id, session_id, arg_min(chunk, received_ms) AS chunk, min(received_ms) AS received_ms FROM kc GROUP BY 1, 2")
def q_first_billing(spark, sf_dir):
    return dedupe.first_for_billing(kept_chunks(spark, sf_dir)).select("project_id", "session_id", "chunk", "received_ms")


_ASOF = "af AS (SELECT kc.project_id, kc.session_id, kc.chunk, f.browser, f.country, f.os FROM kc ASOF LEFT JOIN (SELECT * FROM @fx_filters@) f ON f.project_id = kc.project_id AND f.session_id = kc.session_id AND kc.received_ms >= f.received_ms)"


def chunk_filters(spark, sf_dir, kept=None):
    return replay.latest_filter(kept_chunks(spark, sf_dir) if kept is None else kept, load(spark, sf_dir, "fx_filters"), ["browser", "country", "os"])


@query(f"WITH RECURSIVE {_KEPT}, {_ASOF} SELECT * FROM af")
def q_asof_filter(spark, sf_dir):
    return chunk_filters(spark, sf_dir).select("project_id", "session_id", "chunk", "browser", "country", "os")


_SESSIONS = f"""{_KEPT}, {_ASOF}, {_SPANS}, ck AS (SELECT project_id, session_id, chunk, arg_min(route, span) AS entry_route, arg_max(route, span) AS exit_route FROM spans GROUP BY 1, 2, 3),
j AS (SELECT kc.*, af.browser, af.country, af.os, ck.entry_route, ck.exit_route FROM kc JOIN af ON af.project_id = kc.project_id AND af.session_id = kc.session_id AND af.chunk = kc.chunk JOIN ck ON ck.project_id = kc.project_id AND ck.session_id = kc.session_id AND ck.chunk = kc.chunk),
ru AS (SELECT project_id, session_id, string_agg(DISTINCT route, ',' ORDER BY route) AS routes, cast(count(DISTINCT route) AS INTEGER) AS route_count FROM spans JOIN (SELECT project_id, session_id, chunk FROM kc) USING (project_id, session_id, chunk) GROUP BY 1, 2),
sj AS (SELECT project_id, session_id, window_id, cast(sum(events) AS BIGINT) AS event_count, count(*) AS chunk_count, cast(sum(bytes) AS BIGINT) AS total_bytes, bool_or(has_full_snapshot) AS has_full_snapshot, bool_or(is_final) AS is_complete, min(first_ts) AS started_ms, max(last_ts) AS ended_ms,
 min(session_start_ms) AS session_start_ms, min(coalesce(first_ts, session_start_ms)) AS started_at_ms, max(coalesce(last_ts, first_ts, session_start_ms)) AS ended_at_ms, arg_min(entry_route, received_ms) AS entry_route, arg_max(exit_route, received_ms) AS exit_route,
 arg_max(identifier, received_ms) FILTER (identifier IS NOT NULL) AS identifier, arg_max(browser, received_ms) FILTER (browser IS NOT NULL) AS browser, arg_max(country, received_ms) FILTER (country IS NOT NULL) AS country, arg_max(os, received_ms) FILTER (os IS NOT NULL) AS os,
 min(received_ms) FILTER (is_final) AS finalized_ms, min(received_ms) AS first_ms FROM j GROUP BY 1, 2, 3),
se AS (SELECT sj.*, ru.routes, ru.route_count, CASE WHEN ended_ms >= started_ms THEN ended_ms - started_ms END AS duration_ms FROM sj JOIN ru ON ru.project_id = sj.project_id AND ru.session_id = sj.session_id)"""


def written_chunks(spark, sf_dir):
    """Kept chunks as a table: they are folded once, whoever reads them how often."""
    path = f"{shared_dir(spark)}/beaconry/{uuid.uuid4().hex}/kept"
    kept = kept_chunks(spark, sf_dir)
    kept.write.parquet(path)
    return spark.read.schema(kept.schema).parquet(path)


def session_chunks(spark, sf_dir, kept=None):
    """Kept chunks (kept, or as they are folded here) with their routes and the latest filter attributes at their time."""
    key = ["project_id", "session_id", "chunk"]
    kept = kept_chunks(spark, sf_dir) if kept is None else kept
    chunks = kept.join(chunk_filters(spark, sf_dir, kept).drop("window_id"), key)
    return chunks.join(replay.chunk_routes(spans(spark, sf_dir)), key)


def sessions(spark, sf_dir):
    return replay.fold_sessions(session_chunks(spark, sf_dir))


@query(f"WITH RECURSIVE {_SESSIONS} SELECT * FROM se")
def q_sessions(spark, sf_dir):
    return sessions(spark, sf_dir).withColumn("routes", F.array_join("routes", ","))


def empty_finals(spark, sf_dir):
    empty = replay.drop_invalid(with_faults(spark, sf_dir).withColumn("is_final", F.col("chunk") % 3 == 0)).where("outcome = 'completes'")
    finals = load(spark, sf_dir, "fx_chunks").join(empty.select(*replay.CHUNK), replay.CHUNK, "left_semi")
    return finals.select("project_id", "session_id", "window_id", "received_ms")


@query(f"""WITH RECURSIVE {_SESSIONS}, fin AS (SELECT project_id, session_id, chunk, max(received_ms) AS received_ms FROM (SELECT *, {_FAULT} AS fault FROM @fx_replay_events@) WHERE chunk % 3 = 0 GROUP BY 1, 2, 3 HAVING count(*) FILTER (fault IS NULL) = 0),
 e AS (SELECT project_id, session_id, min(f.received_ms) AS m FROM se JOIN fin f USING (project_id, session_id) WHERE f.received_ms >= first_ms GROUP BY 1, 2)
 SELECT se.project_id, se.session_id, is_complete OR m IS NOT NULL AS is_complete, least(finalized_ms, m) AS finalized_ms FROM se LEFT JOIN e ON e.project_id = se.project_id AND e.session_id = se.session_id""")
def q_finalize(spark, sf_dir):
    return replay.finalize(sessions(spark, sf_dir), empty_finals(spark, sf_dir)).select("project_id", "session_id", "is_complete", "finalized_ms")


@query(f"""WITH RECURSIVE {_SESSIONS}, e AS (SELECT project_id, session_id, arg_max(f.browser, request_id) FILTER (f.browser IS NOT NULL) AS b, arg_max(f.country, request_id) FILTER (f.country IS NOT NULL) AS c, count(*) AS n FROM se JOIN @fx_filters@ f USING (project_id, session_id) WHERE f.received_ms >= first_ms GROUP BY 1, 2)
 SELECT se.project_id, se.session_id, coalesce(b, browser) AS browser, c AS country, coalesce(n, 0) AS filter_events FROM se LEFT JOIN e ON e.project_id = se.project_id AND e.session_id = se.session_id""")
def q_filter_events(spark, sf_dir):
    return replay.filter_updates(sessions(spark, sf_dir), load(spark, sf_dir, "fx_filters"), ["browser", "country"]).select("project_id", "session_id", "browser", "country", "filter_events")


#: What filter events and chunks set on a session, and what a chunk takes from the latest filter event.
CHANGED, FILLED = ["identifier", "browser", "country", "os"], ["browser", "country", "os"]
_OWN_BROWSER = "CASE WHEN chunk % 4 = 2 THEN 'own' || cast(chunk % 3 AS string) END"
_FILTER_ID = "CASE WHEN request_id % 6 = 0 THEN 'f' || cast(request_id % 4 AS string) END"
CHANGES_SQL = f"""WITH RECURSIVE {_KEPT}, {_ASOF}, fin AS (SELECT project_id, session_id, chunk, max(received_ms) AS received_ms FROM (SELECT *, {_FAULT} AS fault FROM @fx_replay_events@) WHERE chunk % 3 = 0 GROUP BY 1, 2, 3 HAVING count(*) FILTER (fault IS NULL) = 0),
 ex AS (SELECT project_id, session_id, min(received_ms) AS first_ms FROM kc GROUP BY 1, 2),
 u AS (SELECT kc.project_id, kc.session_id, received_ms, 1 AS side, kc.chunk AS tie, is_final, identifier, coalesce({_OWN_BROWSER.replace("chunk", "kc.chunk")}, af.browser) AS browser, af.country, af.os FROM kc JOIN af ON af.project_id = kc.project_id AND af.session_id = kc.session_id AND af.chunk = kc.chunk
  UNION ALL SELECT f.project_id, f.session_id, received_ms, 0, request_id, false, {_FILTER_ID}, browser, country, os FROM @fx_filters@ f JOIN ex ON ex.project_id = f.project_id AND ex.session_id = f.session_id AND received_ms >= first_ms
  UNION ALL SELECT f.project_id, f.session_id, received_ms, 2, 0, true, NULL, NULL, NULL, NULL FROM fin f JOIN ex ON ex.project_id = f.project_id AND ex.session_id = f.session_id AND received_ms >= first_ms),
 numbered AS (SELECT *, row_number() OVER (PARTITION BY project_id, session_id ORDER BY received_ms, side, tie) AS i FROM u)
 SELECT project_id, session_id, arg_max(identifier, i) FILTER (identifier IS NOT NULL) AS identifier, arg_max(browser, i) FILTER (browser IS NOT NULL) AS browser, arg_max(country, i) FILTER (country IS NOT NULL) AS country, arg_max(os, i) FILTER (os IS NOT NULL) AS os,
 count(*) FILTER (side = 0) AS filter_events, bool_or(is_final) AS is_complete, min(received_ms) FILTER (is_final) AS finalized_ms FROM numbered GROUP BY 1, 2"""


def change_rows(spark, sf_dir):
    """Kept chunks, some with a browser of their own, filter events, some with an identifier, and empty final chunks."""
    chunks = kept_chunks(spark, sf_dir).withColumn("browser", F.expr(_OWN_BROWSER))
    filters = load(spark, sf_dir, "fx_filters").withColumn("identifier", F.expr(_FILTER_ID))
    return replay.change_rows(chunks, filters, empty_finals(spark, sf_dir), CHANGED)


@query(CHANGES_SQL)
def q_session_changes(spark, sf_dir):
    return replay.fold_changes(replay.settle_changes(change_rows(spark, sf_dir), CHANGED, FILLED), CHANGED).drop("window_id")


@query("SELECT project_id, session_id, chunk, generation FROM @fx_chunks@ WHERE generation = CASE project_id WHEN 'p0' THEN 'g0' WHEN 'p1' THEN 'g1' END")
def q_generation(spark, sf_dir):
    table = load(spark, sf_dir, "fx_chunks").select("project_id", "generation").distinct().withColumn("state", F.expr("CASE WHEN (project_id = 'p0' AND generation = 'g0') OR (project_id = 'p1' AND generation = 'g1') THEN 'active' ELSE 'old' END"))
    return replay.active_generation(load(spark, sf_dir, "fx_chunks"), table).select("project_id", "session_id", "chunk", "generation")


@query(f"""WITH RECURSIVE {_SESSIONS}, er AS (SELECT 'p' || cast(raw_user % 3 AS string) AS project_id, session_id, max(received_ms) AS m FROM @fx_errors@ GROUP BY 1, 2),
 vi AS (SELECT session_id, max(received_ms) AS m FROM @fx_vitals@
  WHERE value >= CASE metric WHEN 'LCP' THEN 4000 WHEN 'FCP' THEN 3000 WHEN 'INP' THEN 500 WHEN 'CLS' THEN 0.25 WHEN 'TTFB' THEN 1800 WHEN 'FID' THEN 300 END
   AND request_id NOT IN (SELECT request_id FROM @fx_vitals@ WHERE metric = 'CUSTOM' OR value < 0 OR value > CASE WHEN metric = 'CLS' THEN 100 ELSE 86400000 END) GROUP BY 1)
 SELECT se.project_id, se.session_id, coalesce(er.m >= first_ms, false) AS has_errors, coalesce(vi.m >= first_ms AND se.project_id = 'p1', false) AS has_poor_vitals FROM se LEFT JOIN er ON er.project_id = se.project_id AND er.session_id = se.session_id LEFT JOIN vi ON vi.session_id = se.session_id""")
def q_flag_sessions(spark, sf_dir):
    errors = load(spark, sf_dir, "fx_errors").select(F.concat(F.lit("p"), (F.col("raw_user") % 3).cast("string")).alias("project_id"), "session_id", F.lit(None).cast("string").alias("window_id"), "received_ms")
    rows = load(spark, sf_dir, "fx_vitals")
    rejected = rows.where(~fn.valid_vital(F.col("metric"), F.col("value"))).select("request_id")  # a request goes whole
    poor = rows.where(fn.poor_vital(F.col("metric"), F.col("value"))).join(rejected, "request_id", "left_anti")
    poor = poor.select(F.lit("p1").alias("project_id"), "session_id", F.lit(None).cast("string").alias("window_id"), "received_ms")
    out = vitals.flag_sessions(vitals.flag_sessions(sessions(spark, sf_dir), errors, "has_errors"), poor, "has_poor_vitals")
    return out.select("project_id", "session_id", "has_errors", "has_poor_vitals")


_KEY_SQL = "generation || '/' || session_id || '/' || window_id || '/' || cast(coalesce(first_ts, 0) AS string) || '-' || CASE WHEN batch_id IS NOT NULL THEN sha256(batch_id) ELSE sha256(encode(window_id) || unhex(printf('%016x', sequence))) END || '.json.zst'"


# The kept chunks of each project; the events of an object in their order.
@query(f"""WITH RECURSIVE {_KEPT}, {_ORD} SELECT kc.project_id || '/' || {_KEY_SQL} AS object_key, count(*) AS events, string_agg(cast(event_id AS string), ',' ORDER BY place) AS ids
 FROM kc JOIN (SELECT project_id, session_id, chunk, event_id, place FROM ord) o ON o.project_id = kc.project_id AND o.session_id = kc.session_id AND o.chunk = kc.chunk GROUP BY 1""".replace("session_id || '/'", "kc.session_id || '/'"))
def q_replay_objects(spark, sf_dir):
    events = replay.order_events(load(spark, sf_dir, "fx_replay_events"))
    body = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("place", "event_id", "type", "event_ts"))), lambda e: F.struct(e["event_id"].alias("id"), e["type"].alias("type"), e["event_ts"].alias("timestamp"))))
    bodies = events.groupBy(*replay.CHUNK).agg(body.alias("body"))
    chunks = kept_chunks(spark, sf_dir).join(bodies, replay.CHUNK).select(F.concat("project_id", F.lit("/"), replay_key()).alias("object_key"), "body")
    path = f"{shared_dir(spark)}/beaconry/{uuid.uuid4().hex}/replay"
    write_chunk_objects(chunks, path)
    ids = F.from_json("body", "array<struct<id:bigint>>")["id"]
    return read_chunk_objects(spark, path).select("object_key", F.size(ids).cast("long").alias("events"), F.array_join(ids.cast("array<string>"), ",").alias("ids"))

"""Session replay: event order and quality, routes, chunks and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconry.functions import scalars as fn

CHUNK = ["project_id", "session_id", "chunk"]


def order_events(events: DataFrame) -> DataFrame:
    """place per event: by timestamp (rounded half up; negative or missing ones first), then sequence id, then arrival."""
    ts = F.when(F.col("ts") >= 0, F.floor(F.col("ts") + 0.5).cast("long"))
    by = Window.partitionBy(*CHUNK).orderBy(F.asc_nulls_first("event_ts"), F.asc_nulls_first("seq_id"), "event_id")
    return events.withColumn("event_ts", ts).withColumn("place", F.row_number().over(by))


# Checks of a variant (null where a member is absent) against the reference's types; each is true, false or null.
def _get(v: Column, name: str, t: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{name}", t)


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _text(v: Column) -> Column:
    return _kind(v) == "STRING"


def _flag(v: Column) -> Column:
    return _kind(v) == "BOOLEAN"


def _number(v: Column) -> Column:
    return _kind(v).isin("BIGINT", "DOUBLE", "FLOAT") | _kind(v).startswith("DECIMAL")


def _int(v: Column) -> Column:
    return _kind(v) == "BIGINT"


def _within(low: int, top: int):
    return lambda v: _int(v) & F.try_variant_get(v, "$", "bigint").between(low, top)


_unsigned = _within(0, 2**63 - 1)


def _list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>").isNotNull()


def _any(v: Column) -> Column:
    return v.isNotNull()


def _equals(text: str):
    return lambda v: _text(v) & (F.try_variant_get(v, "$", "string") == text)


def _each(check):
    return lambda v: F.forall(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.coalesce(check(x), F.lit(False)))


def _values(check):
    return lambda v: F.forall(F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), lambda x: F.coalesce(check(x), F.lit(False)))


def _nullable(check):
    """Has to be there, but may be null."""
    return lambda v: (_kind(v) == "VOID") | check(v)


def _optional(check):
    return lambda v: v.isNull() | (_kind(v) == "VOID") | check(v)


def _members(**checks):
    """An object whose members pass their checks."""

    def check(v: Column) -> Column:
        out = F.try_variant_get(v, "$", "map<string,variant>").isNotNull()
        for name, f in checks.items():
            out = out & F.coalesce(f(_get(v, name)), F.lit(False))
        return out

    return check


def _either(*checks):
    def check(v: Column) -> Column:
        out = F.lit(False)
        for f in checks:
            out = out | F.coalesce(f(v), F.lit(False))
        return out

    return check


def _filled(v: Column) -> Column:
    return v.isNotNull() & (_kind(v) != "VOID")


def _canvas(v: Column) -> Column:
    known = {"base64": _text, "data": _list, "src": _text, "args": _list, "index": _unsigned}
    right = _members(rr_type=lambda x: _text(x) & (F.try_variant_get(x, "$", "string") != ""), type=_optional(_text), **{k: _optional(f) for k, f in known.items()})(v)
    held = F.lit(False)
    for k in known:
        held = held | F.coalesce(_filled(_get(v, k)), F.lit(False))
    return right & held


_false = lambda v: _flag(v) & ~F.try_variant_get(v, "$", "boolean")
_true = lambda v: _flag(v) & F.try_variant_get(v, "$", "boolean")
_null = lambda v: _kind(v) == "VOID"
_pair = lambda v: _each(_text)(v) & (F.size(F.try_variant_get(v, "$", "array<variant>")) == 2)
_style = _values(_either(_text, _pair, _false))
_index = _either(_unsigned, _each(_unsigned))
_rule = _members(rule=_text, index=_optional(_index))
_position = _members(x=_number, y=_number, id=_int, timeOffset=_number)
_command = _members(property=_text, args=_list, setter=_optional(_flag))

# Members of a replay event's data, by type and by source of incremental events.
TYPE_FIELDS = {
    0: {}, 1: {}, 2: {"node": _any, "initialOffset": _members(top=_number, left=_number)}, 4: {"href": _text, "width": _number, "height": _number}, 5: {"tag": _text, "payload": _any}, 6: {"plugin": _text, "payload": _any},
    7: {"url": _text},
}
SOURCE_FIELDS = {
    0: {"texts": _each(_members(id=_int, value=_nullable(_text))), "attributes": _each(_members(id=_int, attributes=_values(_either(_text, _style, _null)))), "removes": _each(_members(parentId=_int, id=_int, isShadow=_optional(_flag))), "adds": _each(_members(parentId=_int, previousId=_optional(_int), nextId=_nullable(_int), node=_any))},
    1: {"positions": _each(_position)}, 2: {"type": _within(0, 10), "id": _int}, 3: {"id": _int, "x": _number, "y": _number}, 4: {"width": _number, "height": _number}, 5: {"id": _int, "text": _text, "isChecked": _flag}, 6: {"positions": _each(_position)},
    7: {"type": _within(0, 4), "id": _int}, 8: {}, 9: {"id": _int, "type": _within(0, 2)}, 10: {"family": _text, "fontSource": _text, "buffer": _flag}, 12: {"positions": _each(_position)}, 13: {"index": _each(_unsigned)},
    14: {"ranges": _each(_members(start=_int, startOffset=_unsigned, end=_int, endOffset=_unsigned))}, 15: {"id": _int, "styleIds": _each(_int)}, 16: {},
}
# Members that may be absent or null, by source.
OPTIONAL_FIELDS = {
    0: {"isAttachIframe": _flag}, 2: {"x": _number, "y": _number, "pointerType": _within(0, 2)}, 5: {"userTriggered": _flag}, 7: {"currentTime": _number, "volume": _number, "muted": _flag, "loop": _flag, "playbackRate": _number},
    8: {"id": _int, "styleId": _int, "removes": _each(_members(index=_index)), "adds": _each(_rule), "replace": _text, "replaceSync": _text}, 9: {"commands": _each(_command), "property": _text, "args": _list, "setter": _flag},
    13: {"id": _int, "styleId": _int, "set": _members(property=_text, value=_nullable(_text), priority=_optional(_text)), "remove": _members(property=_text)}, 15: {"styles": _each(_members(styleId=_int, rules=_each(_rule)))}, 16: {"define": _members(name=_text)},
}
# Members that have to be arrays, and levels of a DOM tree that are walked.
ARRAYS = {"texts", "attributes", "removes", "adds", "positions", "index", "ranges", "styleIds"}
LEVELS = 32
_META = {"id": _int, "rootId": _optional(_int), "isShadowHost": _optional(_flag), "isShadow": _optional(_flag)}
NODES = [
    _members(**_META, childNodes=_list, compatMode=_optional(_text)),
    _members(**_META, name=_text, publicId=_text, systemId=_text),
    _members(**_META, tagName=_text, attributes=_values(_either(_text, _number, _true, _null)), childNodes=_list, isSvg=_optional(_flag), needBlock=_optional(_flag), isCustom=_optional(_flag)),
    _members(**_META, textContent=_text, isStyle=_optional(_flag)),
    _members(**_META, textContent=_equals("")),
    _members(**_META, textContent=_text),
]
_ASSET = _either(_members(rr_type=_equals("CssText"), cssTexts=_each(_text)), _canvas)


def tree_fault(roots: Column, name: str) -> Column:
    """Null, or what is wrong with the DOM trees of an array of variants: level by level, LEVELS of them."""
    type_of = lambda n: F.when(_int(_get(n, "type")), _get(n, "type", "bigint"))

    def right(n: Column) -> Column:
        out = F.when(F.lit(False), F.lit(False))
        for k, f in enumerate(NODES):
            out = out.when(type_of(n) == k, f(n))
        return F.coalesce(out, F.lit(False))

    none = F.array().cast("array<variant>")
    below = lambda n: F.when(type_of(n).isin(0, 2), F.coalesce(_get(n, "childNodes", "array<variant>"), none)).otherwise(none)
    start = F.struct(F.coalesce(roots, none).alias("nodes"), F.lit(True).alias("right"))
    step = lambda s, _: F.struct(F.flatten(F.transform(s["nodes"], below)).alias("nodes"), (s["right"] & F.forall(s["nodes"], right)).alias("right"))
    judge = lambda s: F.when(~s["right"], f"bad {name}").when(F.size(s["nodes"]) > 0, "too_deep")
    return F.reduce(F.sequence(F.lit(1), F.lit(LEVELS)), start, step, judge)


def event_fault(kind: Column, ts: Column, delay: Column, data: Column) -> Column:
    """Null, or what is wrong with an event: kind a number, ts and delay doubles, data a variant."""
    there = lambda f: _get(data, f, "array<variant>" if f in ARRAYS else "variant").isNotNull()

    def wrong(fields: dict, optional: dict) -> Column:
        """The first member that is missing, else the first that is not as it should be."""
        faults = [F.when(~there(f), f"missing {f}") for f in fields]
        faults += [F.when(~F.coalesce(check(_get(data, f)), F.lit(False)), f"bad {f}") for f, check in fields.items()]
        faults += [F.when(~F.coalesce(_optional(check)(_get(data, f)), F.lit(False)), f"bad {f}") for f, check in optional.items()]
        return F.coalesce(*faults, F.lit(None).cast("string"))

    source = F.when(_int(_get(data, "source")), _get(data, "source", "bigint"))
    by_source = F.when(source.isNull() | ~source.isin(list(SOURCE_FIELDS)), "unknown source")
    for s, fields in SOURCE_FIELDS.items():
        fault = wrong(fields, OPTIONAL_FIELDS.get(s, {}))
        if s == 0:
            fault = F.coalesce(fault, tree_fault(F.transform(_get(data, "adds", "array<variant>"), lambda a: _get(a, "node")), "adds"))
        if s == 9:
            has = {f: F.coalesce(_filled(_get(data, f)), F.lit(False)) for f in ("commands", "property", "args")}
            fault = F.coalesce(fault, F.when(~has["commands"] & ~(has["property"] & has["args"]), "missing commands").when(has["property"] != has["args"], "bad commands"))
        by_source = by_source.when(source == s, fault)
    by_kind = F.when(kind == 3, by_source)
    for k, fields in TYPE_FIELDS.items():
        fault = wrong(fields, {})
        if k == 2:
            fault = F.coalesce(fault, tree_fault(F.array(_get(data, "node")), "node"))
        if k == 7:
            failed, loaded = _members(status=_optional(_within(0, 2**16 - 1)), message=_text), _optional(_number)(_get(data, "timestamp"))
            good = lambda f, check: F.coalesce(check(_get(data, f)), F.lit(False))
            lost = F.when(there("failed"), F.when(~good("failed", failed), "bad failed")).when(~there("payload"), "missing payload").when(~good("payload", _ASSET), "bad payload").when(~F.coalesce(loaded, F.lit(False)), "bad timestamp member")
            fault = F.coalesce(fault, lost)
        by_kind = by_kind.when(kind == k, fault)
    return (
        F.when(ts.isNull() | F.isnan(ts) | (ts < 0) | (ts == float("inf")), "bad timestamp")
        .when(F.isnan(delay) | (F.abs(delay) == float("inf")), "bad delay")
        .when(kind.isNull() | ~kind.between(0, 7), "unknown type")
        .when(data.isNull(), "missing data")
        .otherwise(by_kind)
    )


def event_route(data: Column) -> Column:
    """The route an event names, or null."""
    get = lambda p: F.when(F.schema_of_variant(F.try_variant_get(data, p, "variant")) == "STRING", F.try_variant_get(data, p, "string"))
    any_of = [F.try_variant_get(data, p, "variant") for p in ("$.payload.href", "$.payload.url", "$.href", "$.url")]
    named = F.when(any_of[0].isNotNull(), get("$.payload.href")).when(any_of[1].isNotNull(), get("$.payload.url")).when(any_of[2].isNotNull(), get("$.href")).otherwise(get("$.url"))
    return F.when(named.isNotNull(), fn.normalize_route(named))


def drop_invalid(events: DataFrame) -> DataFrame:
    """Per chunk (is_final, fault per event): kept and dropped events, and whether it is stored, only completes, or is rejected."""
    counts = events.groupBy(*CHUNK, "is_final").agg(F.count_if(F.col("fault").isNull()).alias("kept"), F.count_if(F.col("fault").isNotNull()).alias("dropped"))
    return counts.withColumn("outcome", F.when(F.col("kept") > 0, "stored").when(F.col("is_final"), "completes").otherwise("rejected"))


def route_spans(ordered: DataFrame) -> DataFrame:
    """Runs of one route in a chunk: the last named route is carried forward, from the chunk's URL on. Needs place, event_ts, route, chunk_url."""
    by = Window.partitionBy(*CHUNK).orderBy("place")
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = ordered.withColumn("here", F.coalesce(F.last("route", ignorenulls=True).over(so_far), fn.normalize_route(F.col("chunk_url"))))
    new = F.coalesce((F.col("here") != F.lag("here").over(by)).cast("int"), F.lit(1))
    runs = held.withColumn("new", new).withColumn("span", F.sum("new").over(so_far))
    return runs.groupBy(*CHUNK, "span").agg(F.first("here").alias("route"), F.min_by("event_ts", F.when(F.col("event_ts").isNotNull(), F.col("place"))).alias("from_ms"), F.max_by("event_ts", F.when(F.col("event_ts").isNotNull(), F.col("place"))).alias("to_ms"), F.count(F.lit(1)).alias("events"))


def chunk_routes(spans: DataFrame) -> DataFrame:
    """Distinct routes of a chunk by first appearance, with its entry and exit."""
    routes = F.transform(F.array_sort(F.collect_list(F.struct("span", "route"))), lambda s: s["route"])
    return spans.groupBy(*CHUNK).agg(routes.alias("all")).select(*CHUNK, F.array_distinct("all").alias("routes"), F.element_at("all", 1).alias("entry_route"), F.element_at("all", -1).alias("exit_route"))


def chunk_stats(ordered: DataFrame) -> DataFrame:
    return ordered.groupBy(*CHUNK).agg(F.count(F.lit(1)).alias("events"), F.min("event_ts").alias("first_ts"), F.max("event_ts").alias("last_ts"), F.bool_or(F.col("type") == 2).alias("has_full_snapshot"))


def active_generation(rows: DataFrame, generations: DataFrame) -> DataFrame:
    """Rows of each project's active generation."""
    return rows.join(generations.where("state = 'active'").select("project_id", "generation"), ["project_id", "generation"])


#: A window's time is cut into pieces of so many milliseconds, so that a busy window is many tasks.
PIECE_MS = 60_000
WINDOW_KEY = ["project_id", "session_id", "window_id"]
#: What a row of a window is; at one time the sides come in this order.
FILTER, STORED, EMPTY_FINAL = 0, 1, 2


def _as_of(rows: DataFrame, f: Column) -> DataFrame:
    """Rows (window key, at, side, tie, ...) with `latest`, the last f (a column of them) up to them, and `first_ms`, when the window's first chunk came.

    A piece of a window's time begins with a row that carries what the pieces before it left, so no scan of rows goes
    beyond a piece; the scan that carries sees one row a piece. Pieces are dealt to as many tasks as the session has shuffle
    partitions, and a task sorts its rows once.
    """
    piece = [*WINDOW_KEY, "piece"]
    cut = rows.withColumn("piece", F.expr(f"at div {PIECE_MS}"))
    order = F.struct("at", "side", "tie")
    came = F.when(F.col("side") == STORED, F.col("at"))
    ends = cut.groupBy(*piece).agg(F.max_by(f, F.when(f.isNotNull(), order)).alias("f"), F.min(came).alias("first_ms"))
    by = Window.partitionBy(*WINDOW_KEY)
    before = by.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    heads = ends.select(*piece, F.last("f", ignorenulls=True).over(before).alias("f"), F.min("first_ms").over(by).alias("first_ms"), F.lit(-1).alias("side"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut.unionByName(heads, allowMissingColumns=True).repartition(tasks, *piece)
    # A head has no time, and so is first in its piece.
    so_far = Window.partitionBy(*piece).orderBy("at", "side", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scanned = dealt.withColumns({"latest": F.last(F.coalesce("f", f), ignorenulls=True).over(so_far), "first_ms": F.first("first_ms").over(so_far)})
    return scanned.where("side >= 0").drop("piece", "f")


def latest_filter(chunks: DataFrame, filters: DataFrame, fields: list[str]) -> DataFrame:
    """Chunks with the fields of the latest filter event of their session's window at or before their time (null fields stay filled by it only).

    An as-of join without pairs: both sides are sorted by time in pieces of each window and the last filter is carried forward.
    """
    side = lambda n: F.lit(n).alias("side")
    some = filters.select(*WINDOW_KEY, F.col("received_ms").alias("at"), side(FILTER), F.col("request_id").alias("tie"), *fields)
    rows = chunks.select(*WINDOW_KEY, F.col("received_ms").alias("at"), side(STORED), F.lit(0).cast("long").alias("tie"), "chunk").unionByName(some, allowMissingColumns=True)
    f = F.when(F.col("side") == FILTER, F.struct(*fields))
    return _as_of(rows, f).where(F.col("side") == STORED).select(*WINDOW_KEY, "chunk", *[F.col(f"latest.{x}").alias(x) for x in fields])


def change_rows(chunks: DataFrame, filters: DataFrame, finals: DataFrame, fields: list[str]) -> DataFrame:
    """Stored chunks, filter events and empty final chunks as rows of one table: window key, at, side, tie, is_final, fields.

    A field that a side has no column for is null there. Rows without a time change nothing and are left out. The inputs may
    be streams.
    """

    def part(df: DataFrame, side: int, tie: Column, is_final: Column) -> DataFrame:
        own = [(F.col(x) if x in df.columns else F.lit(None)).cast("string").alias(x) for x in fields]
        at = F.col("received_ms").cast("long").alias("at")
        return df.select(*WINDOW_KEY, at, F.lit(side).alias("side"), F.coalesce(tie.cast("long"), F.lit(0)).alias("tie"), is_final.alias("is_final"), *own)

    parts = part(filters, FILTER, F.col("request_id"), F.lit(False)), part(chunks, STORED, F.col("chunk"), F.coalesce("is_final", F.lit(False))), part(finals, EMPTY_FINAL, F.lit(0), F.lit(True))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("at IS NOT NULL")


def settle_changes(rows: DataFrame, fields: list[str], filled: list[str]) -> DataFrame:
    """The rows that change a session, with what they set.

    A chunk's null fields among `filled` are those of the latest filter event up to it. Filter events and empty final chunks
    count from the time of the window's first chunk on. `change_rows` makes the rows; the stream's form is in `streaming`.
    """
    f = F.when(F.col("side") == FILTER, F.struct(*filled)) if filled else F.lit(None).cast("struct<_: string>")
    lacks = lambda x: F.when(F.col("side") == STORED, F.coalesce(x, F.col(f"latest.{x}"))).otherwise(F.col(x))
    out = _as_of(rows, f).where("at >= first_ms").withColumns({x: lacks(x) for x in filled})
    return out.select(*WINDOW_KEY, "at", "side", "tie", "is_final", *fields)


def fold_changes(changes: DataFrame, fields: list[str]) -> DataFrame:
    """Per window what its changes leave, in order of time: each field's last non-null value, filter events, completion.

    Chunks and filter events overwrite each other. All columns are mergeable aggregates, so a stream is folded by this plan
    in update mode.
    """
    order = F.struct("at", "side", "tie")
    last = lambda x: F.max_by(x, F.when(F.col(x).isNotNull(), order)).alias(x)
    return changes.groupBy(*WINDOW_KEY).agg(*map(last, fields), F.count_if(F.col("side") == FILTER).alias("filter_events"), F.bool_or("is_final").alias("is_complete"), F.min(F.when(F.col("is_final"), F.col("at"))).alias("finalized_ms"))


def with_changes(sessions: DataFrame, folded: DataFrame) -> DataFrame:
    """Sessions with the columns of their folded changes in place of their own; keys may be null."""
    own = [c for c in sessions.columns if c not in folded.columns or c in WINDOW_KEY]
    new = [c for c in folded.columns if c not in WINDOW_KEY]
    same = F.expr(" AND ".join(f"s.{k} <=> n.{k}" for k in WINDOW_KEY))
    return sessions.alias("s").join(folded.alias("n"), same, "left").select(*[f"s.{c}" for c in own], *[f"n.{c}" for c in new])


def fold_sessions(chunks: DataFrame) -> DataFrame:
    """One row per session and window over kept chunks in arrival order.

    chunks has received_ms, chunk, counts, times, routes, entry and exit route, session_start_ms, identifier, browser,
    country and os. Every column is a mergeable aggregate, so a stream of chunks can be folded by the same plan in update
    mode, its state being one row a session and window.
    """
    order = F.struct("received_ms", "chunk")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    out = chunks.groupBy("project_id", "session_id", "window_id").agg(
        F.sum("events").alias("event_count"), F.count(F.lit(1)).alias("chunk_count"), F.sum("bytes").alias("total_bytes"), F.bool_or("has_full_snapshot").alias("has_full_snapshot"), F.bool_or("is_final").alias("is_complete"),
        F.min("first_ts").alias("started_ms"), F.max("last_ts").alias("ended_ms"), F.min("session_start_ms").alias("session_start_ms"), F.min(F.coalesce("first_ts", "session_start_ms")).alias("started_at_ms"), F.max(F.coalesce("last_ts", "first_ts", "session_start_ms")).alias("ended_at_ms"),
        first("entry_route"), last("exit_route"), last("identifier"), last("browser"), last("country"), last("os"),
        F.min(F.when(F.col("is_final"), F.col("received_ms"))).alias("finalized_ms"), F.min("received_ms").alias("first_ms"), F.collect_set("routes").alias("route_sets"),
    )
    routes = F.array_sort(F.array_distinct(F.flatten("route_sets")))
    duration = F.when(F.col("ended_ms") >= F.col("started_ms"), F.col("ended_ms") - F.col("started_ms"))
    return out.withColumns({"duration_ms": duration, "routes": routes, "route_count": F.size(routes)}).drop("route_sets")


def finalize(sessions: DataFrame, finals: DataFrame) -> DataFrame:
    """Empty final chunks complete sessions that exist when they come; the first completion's time stays."""
    first = finals.join(sessions.select("project_id", "session_id", "window_id", "first_ms"), ["project_id", "session_id", "window_id"]).where("received_ms >= first_ms").groupBy("project_id", "session_id", "window_id").agg(F.min("received_ms").alias("empty_final_ms"))
    out = sessions.join(first, ["project_id", "session_id", "window_id"], "left")
    return out.withColumns({"is_complete": F.col("is_complete") | F.col("empty_final_ms").isNotNull(), "finalized_ms": F.least("finalized_ms", "empty_final_ms")}).drop("empty_final_ms")


def filter_updates(sessions: DataFrame, filters: DataFrame, fields: list[str]) -> DataFrame:
    """Sessions with the last non-null value of each field among filter events since they exist, else their own."""
    key = ["project_id", "session_id", "window_id"]
    order = F.struct("received_ms", "request_id")
    seen = filters.join(sessions.select(*key, "first_ms"), key).where("received_ms >= first_ms")
    last = seen.groupBy(*key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), order)).alias(f"_{f}") for f in fields], F.count(F.lit(1)).alias("filter_events"))
    out = sessions.join(last, key, "left")
    return out.withColumns({f: F.coalesce(f"_{f}", f) if f in sessions.columns else F.col(f"_{f}") for f in fields} | {"filter_events": F.coalesce("filter_events", F.lit(0).cast("long"))}).drop(*[f"_{f}" for f in fields])

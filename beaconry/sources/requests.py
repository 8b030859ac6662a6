"""Request logs and their sinks."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BODY = 16 * 1024 * 1024
REQUEST_SCHEMA = "request_id long, received_ms long, request_type string, token string, body string, country string, client_ip string, user_agent string, origin string"

# The members of each request's envelope, as (its names, its type). A type with "!" has to be there; "text?" and
# the like may be missing or null; other types may be missing, but not null.
ENVELOPES = {
    "web": {
        "token": (["token"], "text?"), "user_id": (["userId", "identifier", "anonymousId"], "uuid?"), "properties": (["properties"], "object"), "errors": (["errors"], "errors?"), "session_id": (["sessionId"], "text?"),
        "build_id": (["buildId"], "text?"), "window_id": (["windowId"], "text?"), "sdk_name": (["sdkName"], "text?"), "sdk_version": (["sdkVersion"], "text?"), "context": (["context"], "any?"),
    },
    "collect": {"server_id": (["server_id", "identifier"], "text!"), "data": (["data"], "object!"), "errors": (["errors"], "errors?"), "context": (["context"], "any?"), "project_name": (["project_name"], "text?")},
    "vitals": {"token": (["token"], "text?"), "vitals": (["vitals"], "vitals!"), "metadata": (["metadata"], "metadata?"), "session_id": (["sessionId"], "text?"), "window_id": (["windowId"], "text?")},
    "replay": {
        "token": (["token"], "text!"), "session_id": (["sessionId"], "text!"), "window_id": (["windowId"], "text?"), "view_id": (["viewId", "pageId"], "text?"), "session_start": (["sessionStart"], "whole?"), "is_final": (["isFinal"], "flag"),
        "flush_reason": (["flushReason"], "text?"), "batch_id": (["batchId"], "text?"), "sequence": (["sequence"], "whole!"), "url": (["url"], "text!"), "identifier": (["identifier", "anonymousId"], "uuid?"), "events": (["events"], "list!"),
    },
    "identify": {
        "token": (["token"], "text?"), "identifier": (["identifier", "anonymousId"], "uuid?"), "external_id": (["externalId"], "text!"), "email": (["email"], "text?"), "name": (["name"], "text?"), "phone": (["phone"], "text?"),
        "avatar_url": (["avatarUrl"], "text?"), "traits": (["traits"], "object?"), "replace_traits": (["replaceTraits"], "flag"), "unset_traits": (["unsetTraits"], "texts"), "clear_fields": (["clearFields"], "texts"), "aliases": (["aliases"], "texts"),
    },
    "error": {
        "errors": (["errors"], "errors!"), "identifier": (["identifier"], "text?"), "session_id": (["sessionId"], "text?"), "window_id": (["windowId"], "text?"), "build_id": (["buildId"], "text?"), "context": (["context"], "any?"),
        "sdk_name": (["sdkName", "sdk_name"], "text?"), "sdk_version": (["sdkVersion", "sdk_version"], "text?"), "language": (["language"], "text?"),
    },
}
# The members of list items and of vitals' metadata, by the same rules.
_ERROR = {"error": "text!", "message": "text?", "stack": "texts?", "count": "int?", "buildId": "text?", "context": "any?", "sdkVersion": "text?", "handled": "flag?"}
_VITAL = {"metric": "text!", "value": "number!", "attributes": "object?"}
_METADATA = {"browser": "text?", "os": "text?", "device": "text?", "url": "text?"}
#: Members of web requests that the envelope does not name are data; those of a collect request are a fault.
_OPEN, _STRICT = "web", "collect"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where that is unset, the warehouse of a local session."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staged"
    return where.rstrip("/")


def read_requests(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Request log lines (JSON, compressed as their extension says) with a body within the limit."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(REQUEST_SCHEMA).json(path).where(F.coalesce(F.octet_length("body"), F.lit(0)) <= MAX_BODY)


def _items(text: Column, good: Callable[[Column], Column]) -> Column:
    """Whether text is a JSON array of items (variants) that are all good."""
    items = F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")
    return text.startswith("[") & F.forall(items, lambda v: F.coalesce(good(v), F.lit(False)))


def _members(members: Column, rules: dict[str, str]) -> Column:
    # A transform of one element, so that the map is made once for all rules.
    one = F.transform(F.array(members), lambda m: functools.reduce(lambda x, y: x & y, [_fits(m[n], kind) for n, kind in rules.items()], m.isNotNull()))
    return one[0]


def _fits(text: Column, kind: str) -> Column:
    """Whether a member (JSON text, null where it is missing) has the type; never null."""
    from beaconry.functions.scalars import parse_uuid
    from beaconry.operators.web import json_map, json_string, member_texts

    base, last = kind.rstrip("?!"), kind[-1]
    value = {
        "any": lambda: F.lit(True),
        "text": lambda: text.startswith('"'),
        "uuid": lambda: text.startswith('"') & parse_uuid(json_string(text)).isNotNull(),
        "flag": lambda: text.isin("true", "false"),
        "number": lambda: text.rlike("^-?[0-9]"),
        "whole": lambda: text.rlike(r"^[0-9]{1,20}\z") & (text.try_cast("decimal(20,0)") <= F.lit(str(2**64 - 1)).cast("decimal(20,0)")),
        "int": lambda: text.rlike(r"^-?[0-9]{1,10}\z") & text.try_cast("long").between(-(2**31), 2**31 - 1),
        "object": lambda: text.startswith("{"),
        "list": lambda: text.startswith("["),
        "texts": lambda: _items(text, lambda v: F.to_json(v).startswith('"')),
        "errors": lambda: _items(text, lambda v: _members(member_texts(v), _ERROR)),
        "vitals": lambda: _items(text, lambda v: _members(member_texts(v), _VITAL)),
        "metadata": lambda: _members(json_map(text), _METADATA),
    }[base]()
    missing = text.isNull() | (text == "null") if last == "?" else text.isNull() & F.lit(last != "!")
    return missing | F.coalesce(value, F.lit(False))


def _typed(text: Column, kind: str) -> Column:
    """The value of a member that fits: texts, ids, flags and numbers; lists of texts; others stay JSON text."""
    from beaconry.functions.scalars import parse_uuid
    from beaconry.operators.web import json_string

    base = kind.rstrip("?!")
    if base == "text":
        return json_string(text)
    if base == "uuid":
        return parse_uuid(json_string(text))
    if base == "flag":
        return F.coalesce(text == "true", F.lit(False))
    if base == "whole":
        return F.when(text != "null", text).try_cast("decimal(20,0)")
    if base == "texts":
        return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
    return F.when(text != "null", text)


def parse_request(requests: DataFrame, kind: str, keep: list | None = None) -> DataFrame:
    """request_id, the typed envelope and `malformed`; web requests also have `data`, the other members as JSON texts.

    A request is malformed, and its envelope null, if its body is not one JSON object, a member has another type than its own
    or is missing though it has to be there, a member comes under two of its names, or a collect request has others.
    Errors, vitals and metadata are checked with their members.
    """
    from beaconry.operators.web import whole_json_map

    names = ENVELOPES[kind]
    known = F.array(*[F.lit(k) for keys, _ in names.values() for k in keys])
    parsed = requests.withColumn("_m", whole_json_map(F.col("body")))
    value = lambda n: F.coalesce(*[F.col("_m")[k] for k in names[n][0]])
    good = [_fits(value(n), names[n][1]) for n in names]
    good += [sum(F.col("_m")[k].isNotNull().cast("int") for k in keys) <= 1 for keys, _ in names.values() if len(keys) > 1]
    if kind == _STRICT:
        good.append(F.size(F.array_except(F.map_keys("_m"), known)) == 0)
    whole = F.col("_m").isNotNull() & functools.reduce(lambda x, y: x & y, good)
    parsed = parsed.withColumn("_ok", whole)
    fields = [F.when(F.col("_ok"), _typed(value(n), names[n][1])).alias(n) for n in names]
    rest = [F.when(F.col("_ok"), F.map_filter("_m", lambda k, _: ~F.array_contains(known, k))).alias("data")] if kind == _OPEN else []
    return parsed.select("request_id", *(keep or []), *fields, *rest, (~F.col("_ok")).alias("malformed"))


def quarantine(rows: DataFrame, datasource: str, reason: Column, created_ms: Column) -> DataFrame:
    """Rows with a reason, as dead letters."""
    return rows.withColumns({"last_error": reason, "datasource": F.lit(datasource), "created_at": F.timestamp_millis(created_ms)}).where("last_error IS NOT NULL")


def quarantine_replay(held: DataFrame, done: DataFrame, now: DataFrame, limit: int = 50, keep_seconds: int = 86_400) -> DataFrame:
    """The oldest dead letters that are neither processed nor past their time; now has one row."""
    live = held.join(F.broadcast(now), F.expr(f"created_at >= now - make_dt_interval(0, 0, 0, {keep_seconds})"))
    return live.join(done, "request_id", "left_anti").orderBy("created_at", "request_id").limit(limit)


def whole_batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the finished batches of a folder, in order: a folder each, which its writer has marked as whole."""
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = top.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in store.listStatus(top)] if store.exists(top) else []
    whole = [n for n in names if n.startswith("batch=") and store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
    return sorted(int(n.partition("=")[2]) for n in whole)


def remove_batches(spark: SparkSession, folder: str, numbers: list[int]) -> None:
    for n in numbers:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch={n}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def replayed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The output rows of the finished batches under path, with their `batch`."""
    whole = [f"{path}/out/batch={n}" for n in whole_batches(spark, f"{path}/done")]
    if not whole:
        return spark.createDataFrame([], f"{schema}, batch long")
    return spark.read.schema(f"{schema}, batch long").option("basePath", f"{path}/out").parquet(*whole)


def replay_dead_letters(held: DataFrame, now: DataFrame, path: str, process: Callable[[DataFrame], DataFrame], limit: int = 50, keep_seconds: int = 86_400) -> int:
    """One round over the dead letters: the oldest ones that no finished batch has, through process, into the batch's output.

    A batch's own folder of output is replaced when it runs again, and its manifest (the ids it has dealt with) is written
    last. A batch that fails leaves no manifest, so its rows stay; read results with replayed(). Rounds do not run side by
    side. Returns the batch's number.
    """
    spark = held.sparkSession
    whole = [f"{path}/done/batch={n}" for n in whole_batches(spark, f"{path}/done")]
    done = spark.read.schema("request_id long").parquet(*whole) if whole else spark.createDataFrame([], "request_id long")
    number = max(whole_batches(spark, f"{path}/done"), default=-1) + 1
    chosen = quarantine_replay(held, done, now, limit, keep_seconds)
    chosen.select("request_id").write.mode("overwrite").parquet(f"{path}/chosen/batch={number}")
    ids = spark.read.schema("request_id long").parquet(f"{path}/chosen/batch={number}")
    process(held.join(ids, "request_id", "left_semi")).write.mode("overwrite").parquet(f"{path}/out/batch={number}")
    ids.write.mode("overwrite").parquet(f"{path}/done/batch={number}")
    return number


def replay_key() -> Column:
    """The object name of a replay chunk."""
    sequence = F.unhex(F.lpad(F.hex("sequence"), 16, "0"))
    ident = F.coalesce(F.sha2("batch_id", 256), F.sha2(F.concat(F.encode("window_id", "UTF-8"), sequence), 256))
    return F.concat(F.concat_ws("/", "generation", "session_id", "window_id", F.coalesce("first_ts", F.lit(0)).cast("string")), F.lit("-"), ident, F.lit(".json.zst"))


def write_tables(batch: DataFrame, path: str, tables: dict[str, list[str]], batch_id: int = 0) -> None:
    """One micro-batch (column `datasource`) to a gzip JSON table each, with times in milliseconds.

    A batch writes to folders of its own, so that one that runs again replaces its rows.
    """
    batch.persist()
    try:
        for name, columns in tables.items():
            out = batch.where(F.col("datasource") == name).withColumn("created_at", F.unix_millis("created_at"))
            out.select(*columns).write.mode("overwrite").option("compression", "gzip").json(f"{path}/{name}/batch={batch_id}")
    finally:
        batch.unpersist()


def write_replay_chunks(chunks: DataFrame, path: str) -> None:
    """Chunk rows (key and events) by project and generation, zstd-compressed."""
    chunks.withColumn("object_key", replay_key()).write.mode("append").partitionBy("project_id", "generation").option("compression", "zstd").parquet(path)

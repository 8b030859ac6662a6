"""Streaming forms of the stateful operators, with event time `received_at`, a watermark and checkpoints.

Each job is a streaming DataFrame in and a query out; state is keyed and lives in Spark's state store. The queries run
the stream over Parquet that Spark derives from the tables, to its end, and return what the sink got.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from beaconry.operators import dedupe, persons, replay, usage
from beaconry.plans import metering, sessions, web
from beaconry.sources.fixtures import load, oracle
from beaconry.sources.requests import remove_batches, shared_dir, whole_batches, write_tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: How late a request may come: dead letters are kept as long.
WATERMARK = "1 day"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = oracle(sql)
        return f

    return add


def debounce_stream(events: DataFrame, window_ms: int = 5000) -> DataFrame:
    """(visitor, request_id, received_ms) of the events of a stream that pass, by the batch fold's rules.

    Keyed state holds the time of the last kept event of a visitor and URL and expires a window later. Events that do not
    count pass as they come.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["received_ms", "request_id"])
        kept = rows.iloc[dedupe.walk(rows["received_ms"].to_numpy(), state.get[0] if state.exists else None, window_ms)]
        if len(kept):
            state.update((int(kept["received_ms"].iloc[-1]),))
        if state.exists:
            state.setTimeoutTimestamp(max(state.get[0] + window_ms, state.getCurrentWatermarkMs() + 1))
        yield kept[["visitor", "request_id", "received_ms"]]

    counts = dedupe.counts_for_debounce(events.columns)
    out = "visitor string, request_id long, received_ms long"
    marked = events.withWatermark("received_at", WATERMARK)
    pages = marked.where(counts).select("visitor", dedupe.key_url().alias("key_url"), "request_id", "received_ms", "received_at")
    kept = pages.groupBy("visitor", "key_url").applyInPandasWithState(fold, out, "last long", "append", GroupStateTimeout.EventTimeTimeout)
    return kept.unionByName(marked.where(~counts).select("visitor", "request_id", "received_ms"))


#: Buckets of keys: what a fold in Python costs a group is more than what it costs a row, so a group is the keys of one
#: bucket, with their states by key. Fixed for the life of a checkpoint; more keys than a few million want more of them.
BUCKETS = 4096


def by_bucket(rows: DataFrame, keys: list[str]) -> GroupedData:
    return rows.withColumn("bucket", F.pmod(F.hash(*keys), F.lit(BUCKETS))).groupBy("bucket")


def _records(batches: Iterator[pd.DataFrame], columns: list[str]) -> list[tuple]:
    """The rows of a group as tuples, missing values as None."""
    plain = lambda c: (c.astype(object).where(c.notna(), None) if c.hasnans else c).tolist()
    return [r for b in batches for r in zip(*[plain(b[n]) for n in columns], strict=True)]


def _held(state: GroupState) -> dict[tuple, list]:
    """A bucket's states by key."""
    return {tuple(k): v for k, v in json.loads(state.get[0])} if state.exists else {}


def dedupe_chunks_stream(chunks: DataFrame) -> DataFrame:
    """The kept chunks of a stream of replay chunks, by the batch fold's rules: (key, chunk, received_ms).

    State is the set of each stream's batch ids and the ranges of sequences that are covered. It stays: a chunk may be
    sent again at any time.
    """
    keys = len(dedupe.CHUNK_KEY)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, seen, kept = _held(state), {}, []
        rows = _records(batches, [*dedupe.CHUNK_KEY, "chunk", "received_ms", "batch_id", "sequence", "first_sequence", "last_sequence"])
        whole = lambda x: None if x is None else int(x)
        for r in sorted(rows, key=lambda r: (r[keys + 1] is None, r[keys + 1] or 0, r[keys])):
            own = r[:keys]
            if own not in seen:
                seen[own] = dedupe.ChunkSet(*held.get(own, ()))
            if seen[own].offer(r[-4], *map(whole, r[-3:])):
                kept.append(r[: keys + 2])
        held |= {k: [sorted(x.batches), x.starts, x.ends] for k, x in seen.items()}
        state.update((json.dumps(list(held.items())),))
        yield pd.DataFrame(kept, columns=[*dedupe.CHUNK_KEY, "chunk", "received_ms"])

    out = ", ".join(f"{k} string" for k in dedupe.CHUNK_KEY) + ", chunk long, received_ms long"
    return by_bucket(chunks, dedupe.CHUNK_KEY).applyInPandasWithState(fold, out, "seen string", "append", GroupStateTimeout.NoTimeout)


def first_billing_stream(chunks: DataFrame) -> DataFrame:
    """Each session's first stored chunk of a stream, once: the mark that a session was billed is state that stays."""
    session = ["project_id", "session_id"]

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        billed = {tuple(k) for k in json.loads(state.get[0])} if state.exists else set()
        rows = pd.concat(list(batches)).sort_values(["received_at", "chunk"]).drop_duplicates(session)
        own = _records([rows], session)
        state.update((json.dumps(list(billed.union(own))),))
        yield rows[[k not in billed for k in own]][[*session, "chunk", "received_at"]]

    return by_bucket(chunks, session).applyInPandasWithState(fold, "project_id string, session_id string, chunk long, received_at timestamp", "billed string", "append", GroupStateTimeout.NoTimeout)


def settle_changes_stream(rows: DataFrame, fields: list[str], filled: list[str]) -> DataFrame:
    """The changes of sessions of a stream, by the rules of `replay.settle_changes`, in whatever order its rows come.

    A window's rows wait in state until the watermark has passed them, so that no earlier one can still come; then they
    are settled in order of time. State keeps the waiting rows, the filter event before them and the time of the first chunk;
    the last two stay, as a window may go on at any time. Rows that come after the watermark are dropped.
    """
    places = [fields.index(x) for x in filled]
    keys = len(replay.WINDOW_KEY)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, out, soonest = _held(state), [], None
        mark = state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            for r in _records(batches, [*replay.WINDOW_KEY, "at", "side", "tie", "is_final", *fields]):
                held.setdefault(r[:keys], [None, None, []])[2].append(r[keys:])
        for own, (latest, first, waiting) in held.items():
            if not waiting:
                continue
            waiting.sort(key=lambda r: tuple(r[:3]))
            n = bisect_left(waiting, mark, key=lambda r: r[0])
            done, waiting = waiting[:n], waiting[n:]
            first = min([r[0] for r in done if r[1] == replay.STORED], default=first) if first is None else first
            for r in done:
                at, side, values = r[0], r[1], list(r[4:])
                if side == replay.FILTER:
                    latest = values
                elif side == replay.STORED and latest:
                    for k in places:
                        values[k] = latest[k] if values[k] is None else values[k]
                if first is not None and at >= first:
                    out.append([*own, *r[:4], *values])
            held[own] = [latest, first, waiting]
            if waiting:
                soonest = waiting[0][0] if soonest is None else min(soonest, waiting[0][0])
        state.update((json.dumps(list(held.items())),))
        if soonest is not None:
            state.setTimeoutTimestamp(max(soonest, mark) + 1)
        yield pd.DataFrame(out, columns=[*replay.WINDOW_KEY, "at", "side", "tie", "is_final", *fields])

    texts = lambda names: ", ".join(f"{x} string" for x in names)
    out = f"{texts(replay.WINDOW_KEY)}, at long, side int, tie long, is_final boolean, {texts(fields)}"
    marked = rows.withColumn("received_at", F.timestamp_millis("at")).withWatermark("received_at", WATERMARK)
    return by_bucket(marked, replay.WINDOW_KEY).applyInPandasWithState(fold, out, "seen string", "append", GroupStateTimeout.EventTimeTimeout)


def run_changes(rows: DataFrame, path: str, fields: list[str], filled: list[str]) -> None:
    """Settles a stream of `replay.change_rows` to its end, then folds what was settled into the change log of sessions."""
    run_to_end(settle_changes_stream(rows, fields, filled), path)
    settled = rows.sparkSession.read.parquet(f"{path}/out")
    run_updates(replay.fold_changes(rows.sparkSession.readStream.schema(settled.schema).parquet(f"{path}/out"), fields), f"{path}/sessions")


def usage_stream(rows: DataFrame) -> DataFrame:
    """Usage per flush window of a stream; the plan is the batch one."""
    return usage.usage_by_window(rows.withWatermark("received_at", WATERMARK))


def run_updates(df: DataFrame, path: str) -> None:
    """Runs a stream of keyed aggregates to its end: each micro-batch adds the rows that it changed to a change log.

    A batch writes to a folder of its own, so that one that runs again replaces its rows. The aggregates are Spark's state
    and go on from the checkpoint.
    """
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/log/batch={n}")
    df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def _log(spark: SparkSession, schema: StructType, path: str) -> tuple[DataFrame, int, list[int]]:
    """The rows of a change log that count, with their `_batch`; the number of its newest base (-1: none) and whole batches."""
    bases, batches = whole_batches(spark, f"{path}/base"), whole_batches(spark, f"{path}/log")
    base = bases[-1] if bases else -1
    marked = StructType(list(schema.fields)).add("_batch", "long")
    number = F.regexp_extract(F.input_file_name(), "/batch=([0-9]+)/", 1).cast("long")
    log = [f"{path}/log/batch={n}" for n in batches if n > base]
    rows = spark.read.schema(marked).parquet(f"{path}/base/batch={base}") if base >= 0 else None
    if log:
        new = spark.read.schema(schema).parquet(*log).withColumn("_batch", number)
        rows = new if rows is None else rows.unionByName(new)
    return (spark.createDataFrame([], marked) if rows is None else rows), base, batches


def latest(spark: SparkSession, schema: StructType, path: str, key: list[str]) -> DataFrame:
    """A change log merged on read: each key's last row, of the newest base and the whole batches after it."""
    rows, _, _ = _log(spark, schema, path)
    return rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in schema.names if c not in key]), "_batch").alias("r")).select(*key, "r.*")


def compact(spark: SparkSession, schema: StructType, path: str, key: list[str]) -> int:
    """Folds a change log into a base: each key's last row with its batch. Returns the base's number.

    The newest batch stays out, as its micro-batch may run again. A base counts once its writer has marked it as whole, so a
    compaction that fails changes nothing and can be run again. What the base before this one has already replaced goes; what
    only this base replaces stays until the next compaction, for readers that have begun. Compactions do not run side by
    side; the stream may go on.
    """
    rows, base, batches = _log(spark, schema, path)
    upto = batches[-2] if len(batches) > 1 else -1
    if upto <= base:
        return base
    old = rows.where(F.col("_batch") <= upto)
    folded = old.groupBy(*key).agg(F.max_by(F.struct(*[c for c in schema.names if c not in key], "_batch"), "_batch").alias("r")).select(*key, "r.*")
    folded.select(*schema.names, "_batch").write.mode("overwrite").parquet(f"{path}/base/batch={upto}")
    remove_batches(spark, f"{path}/log", [n for n in batches if n <= base])
    remove_batches(spark, f"{path}/base", [n for n in whole_batches(spark, f"{path}/base") if n < base])
    return upto


SESSION_KEY = ["project_id", "session_id", "window_id"]
PERSON_KEY = ["project_id", "external_id"]


def person_streams(patches: DataFrame, fields: dict[str, str | None]) -> dict[str, tuple[DataFrame, list[str]]]:
    """The keyed folds of a stream of accepted patches, each with its key: persons, trait writes and replacements, aliases."""
    return {
        "persons": (persons.fold_persons(patches, fields), PERSON_KEY), "trait_writes": (persons.trait_writes(patches), [*PERSON_KEY, "trait"]),
        "trait_replacements": (persons.trait_replacements(patches), PERSON_KEY), "aliases": (persons.fold_aliases(patches), ["project_id", "distinct_id"]),
    }


def run_to_end(df: DataFrame, path: str, mode: str = "append") -> None:
    """Runs a stream over what is there and stops; it can be started again from its checkpoint."""
    q = df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def feed(spark: SparkSession, df: DataFrame, name: str, run: Callable[[DataFrame, str], None], batches: int = 1, by: str = "received_at") -> str:
    """Lets run(stream, folder) take df in so many stretches of a time, one after the other; the job's folder.

    Each stretch arrives after the run before it has ended, so all but the first go on from its checkpoint.
    """
    path = f"{shared_dir(spark)}/beaconry/{uuid.uuid4().hex}/{name}"
    at = F.unix_millis(by)
    df.write.parquet(f"{path}/all")
    rows = spark.read.schema(df.schema).parquet(f"{path}/all")
    span = rows.agg(F.min(at).alias("lo"), F.max(at).alias("hi")).first()
    lo, width = span.lo or 0, ((span.hi or 0) - (span.lo or 0)) // batches + 1
    for k in range(batches):
        some = rows.where(at.between(lo + k * width, lo + (k + 1) * width - 1)) if batches > 1 else rows
        some.write.mode("append").parquet(f"{path}/in")
        run(spark.readStream.schema(df.schema).parquet(f"{path}/in"), path)
    return path


@query(f"WITH RECURSIVE {web._VISITOR_SQL.strip()}, {web._PAGED_SQL.strip()} SELECT vis.request_id, vis.visitor FROM vis LEFT JOIN f ON f.request_id = vis.request_id WHERE vis.visitor IS NOT NULL AND coalesce(kept, true)")
def q_stream_debounce(spark, sf_dir):
    rows = web.to_debounce(spark, sf_dir).select("visitor", "url", "event", "has_errors", "request_id", "received_ms", F.timestamp_millis("received_ms").alias("received_at"))
    path = feed(spark, rows, "debounce", lambda stream, path: run_to_end(debounce_stream(stream), path), batches=4)
    return spark.read.parquet(f"{path}/out").select("request_id", "visitor")


# Chunks that are sent again a day later are dropped whatever became of the first ones.
@query(f"WITH RECURSIVE {sessions._FOLD} SELECT project_id, session_id, chunk FROM g WHERE kept")
def q_stream_dedupe_chunks(spark, sf_dir):
    chunks = load(spark, sf_dir, "fx_chunks").select(*dedupe.CHUNK_KEY, "chunk", "received_ms", "batch_id", "sequence", "first_sequence", "last_sequence")
    again = chunks.where("chunk % 4 = 0").withColumn("chunk", F.col("chunk") + 1_000_000).withColumn("received_ms", F.col("received_ms") + 86_400_000)
    rows = chunks.unionByName(again).withColumn("received_at", F.timestamp_millis("received_ms"))
    path = feed(spark, rows, "chunks", lambda stream, path: run_to_end(dedupe_chunks_stream(stream), path), batches=4)
    return spark.read.parquet(f"{path}/out").select("project_id", "session_id", "chunk")


@query(f"WITH {web._TAGGED_SQL}, m AS (SELECT max(received_ms) - 86400000 AS w FROM t) SELECT received_ms - received_ms % 5000 AS window_ms, billing_owner, count(*) FILTER (kind IN ('web', 'server')) AS events, count(*) FILTER (kind = 'error') AS error_tracking, count(*) FILTER (kind = 'vital') AS web_vitals FROM t GROUP BY 1, 2")
def q_stream_usage(spark, sf_dir):
    rows = web.tagged(spark, sf_dir).select("billing_owner", "kind", F.timestamp_millis("received_ms").alias("received_at"))
    # A closing row past the watermark ends every window; it has no owner.
    end = rows.agg((F.max("received_at") + F.expr("INTERVAL 3 DAYS")).alias("received_at")).select(F.lit(None).cast("string").alias("billing_owner"), F.lit("end").alias("kind"), "received_at")
    path = feed(spark, rows.unionByName(end), "usage", lambda stream, path: run_to_end(usage_stream(stream), path))
    return spark.read.parquet(f"{path}/out").where("billing_owner IS NOT NULL")


@query(f"WITH RECURSIVE {sessions._KEPT} SELECT project_id, session_id, arg_min(chunk, received_ms) AS chunk, min(received_ms) AS received_ms FROM kc GROUP BY 1, 2")
def q_stream_first_billing(spark, sf_dir):
    rows = sessions.kept_chunks(spark, sf_dir).select("project_id", "session_id", "chunk", F.timestamp_millis("received_ms").alias("received_at"))
    path = feed(spark, rows, "billing", lambda stream, path: run_to_end(first_billing_stream(stream), path), batches=4)
    return spark.read.parquet(f"{path}/out").select("project_id", "session_id", "chunk", F.unix_millis("received_at").alias("received_ms"))


@query(f"WITH RECURSIVE {sessions._SESSIONS} SELECT * FROM se")
def q_stream_sessions(spark, sf_dir):
    rows = sessions.session_chunks(spark, sf_dir, sessions.written_chunks(spark, sf_dir)).withColumn("received_at", F.timestamp_millis("received_ms"))
    path = feed(spark, rows, "sessions", lambda stream, path: run_updates(replay.fold_sessions(stream), path), batches=4)
    return latest(spark, replay.fold_sessions(rows).schema, path, SESSION_KEY).withColumn("routes", F.array_join("routes", ","))


# A closing chunk past the watermark, of no project, lets everything before it settle.
@query(sessions.CHANGES_SQL)
def q_stream_session_changes(spark, sf_dir):
    rows = sessions.change_rows(spark, sf_dir).withColumn("received_at", F.timestamp_millis("at"))
    end = rows.agg((F.max("at") + 3 * 86_400_000).alias("at")).select("at", F.lit(replay.STORED).alias("side"), F.lit(0).cast("long").alias("tie"), F.lit(False).alias("is_final"), F.timestamp_millis("at").alias("received_at"))
    rows = rows.unionByName(end.where("at IS NOT NULL"), allowMissingColumns=True)
    path = feed(spark, rows, "changes", lambda stream, path: run_changes(stream, path, sessions.CHANGED, sessions.FILLED), batches=4)
    return latest(spark, replay.fold_changes(rows, sessions.CHANGED).schema, f"{path}/sessions", SESSION_KEY).drop("window_id")


def _person_logs(spark, sf_dir, names: list[str]) -> list[DataFrame]:
    rows = metering.trait_patches(spark, sf_dir).withColumn("received_at", F.timestamp_millis("seq"))
    folds = lambda df: person_streams(df, {"email": "clear_email", "name": None})

    def run(stream: DataFrame, path: str) -> None:
        for name in names:
            run_updates(folds(stream)[name][0], f"{path}/{name}")

    path = feed(spark, rows, "persons", run, batches=3)
    return [latest(spark, df.schema, f"{path}/{n}", key) for n, (df, key) in folds(rows).items() if n in names]


@query(metering.ORACLES_OF["persons"])
def q_stream_persons(spark, sf_dir):
    return _person_logs(spark, sf_dir, ["persons"])[0]


@query(metering.ORACLES_OF["traits"])
def q_stream_traits(spark, sf_dir):
    return persons.current_traits(*_person_logs(spark, sf_dir, ["trait_writes", "trait_replacements"]))


@query(metering.ORACLES_OF["aliases"])
def q_stream_aliases(spark, sf_dir):
    return _person_logs(spark, sf_dir, ["aliases"])[0]


# The logs are compacted after each stretch; two runs of the stream go on from compacted logs.
@query(metering.ORACLES_OF["persons"])
def q_stream_compaction(spark, sf_dir):
    rows = metering.trait_patches(spark, sf_dir).withColumn("received_at", F.timestamp_millis("seq"))
    fold = lambda df: person_streams(df, {"email": "clear_email", "name": None})["persons"][0]
    schema = fold(rows).schema

    def run(stream: DataFrame, path: str) -> None:
        run_updates(fold(stream), path)
        compact(spark, schema, path, PERSON_KEY)

    return latest(spark, schema, feed(spark, rows, "compaction", run, batches=4), PERSON_KEY)


@query("SELECT CASE WHEN event = 'error' THEN 'error_tracking_v3' WHEN request_id % 11 = 0 THEN 'mods_events' ELSE 'web_events' END AS datasource, request_id, received_ms AS created_at FROM @fx_web@")
def q_write_tables(spark, sf_dir):
    name = F.when(F.col("event") == "error", "error_tracking_v3").when(F.col("request_id") % 11 == 0, "mods_events").otherwise("web_events")
    rows = load(spark, sf_dir, "fx_web").select(name.alias("datasource"), "request_id", F.timestamp_millis("received_ms").alias("created_at"))
    tables = {t: ["request_id", "created_at"] for t in ("web_events", "mods_events", "error_tracking_v3")}

    def run(stream: DataFrame, path: str) -> None:
        write = lambda batch, n: write_tables(batch, f"{path}/tables", tables, n)
        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    path = feed(spark, rows.withColumn("received_at", F.col("created_at")), "tables", run, batches=2)
    parts = [spark.read.schema("request_id long, created_at long").json(f"{path}/tables/{t}/batch=*").withColumn("datasource", F.lit(t)) for t in tables]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])

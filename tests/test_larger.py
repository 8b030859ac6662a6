"""What only larger tables show: queries over tables whose keys go on beyond those of sf0.1."""

import duckdb
import pytest
from pyspark.sql import functions as F

from beaconry import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def later(spark, tmp_path_factory):
    """The smallest tables with event ids that begin at 350,000."""
    folder = tmp_path_factory.mktemp("later")
    for t in ("nation", "region"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    spark.read.parquet(f"{SF}/events.parquet").withColumn("event_id", F.col("event_id") + 350_000).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def against_sql(spark, folder, name):
    df = catalog.queries()[name](spark, folder)
    con = duckdb.connect()
    for t in ("nation", "region", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.oracle_sql()[name]}) q").fetchall()
    got = [tuple(r) for r in df.collect()]
    assert got and sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", ["q_retrace", "q_enriched_errors"])
def test_mappings_of_late_lines(spark, later, name):
    """The mapping's second method holds for every later line, as the SQL has it."""
    against_sql(spark, later, name)


def test_chunk_objects_stay_in_tasks(spark, tmp_path):
    """The driver neither gets nor lists the objects' names: none of its calls to a store sees an object."""
    from beaconry.sources import objects

    opened, true = [], objects.open_store
    folder = tmp_path / "o"
    rows = spark.range(3000).select(F.format_string("p/g%s/s%s/w/%s.json.zst", F.col("id") % 2, F.col("id") % 700, "id").alias("object_key"), F.format_string('[{"id":%s}]', "id").alias("body"))

    class Watched:
        def __init__(self, store):
            self.store = store

        def __getattr__(self, name):
            opened.append(name)
            return getattr(self.store, name)

    def watched(path):
        store, root = true(path)
        return Watched(store), root

    objects.open_store = watched
    try:
        objects.write_chunk_objects(rows.repartition(7), str(folder))
        got = objects.read_chunk_objects(spark, str(folder))
        assert got.count() == 3000 and sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))
    finally:
        objects.open_store = true
    assert set(opened) == {"get_file_info", "delete_dir"} and len(opened) == 2


def test_chunk_objects_are_named_again(spark, tmp_path):
    """A task that names objects and runs again finds them named; an object that is nowhere is an error."""
    import pyarrow as pa

    from beaconry.sources import objects

    batch = lambda: iter([pa.RecordBatch.from_arrays([pa.array(["_staging/j/t/0"]), pa.array(["g/a.json.zst"])], names=["staged", "object_key"])])
    (tmp_path / "_staging/j/t").mkdir(parents=True)
    (tmp_path / "_staging/j/t/0").write_bytes(b"x")
    for _ in range(2):
        list(objects._name(batch(), str(tmp_path)))
        assert (tmp_path / "g/a.json.zst").read_bytes() == b"x"
    (tmp_path / "g/a.json.zst").unlink()
    with pytest.raises(OSError):
        list(objects._name(batch(), str(tmp_path)))


def test_chunk_objects_share_files(spark, tmp_path, monkeypatch):
    """Small objects take neither a file nor a block of disk each: files and folders are as many as buckets, not as objects."""
    from beaconry.sources import objects

    monkeypatch.setattr(objects, "BUCKETS", 16, raising=False)
    rows = spark.range(3000).select(F.format_string("p/g%s/s%s/w/%s.json.zst", F.col("id") % 2, F.col("id") % 700, "id").alias("object_key"), F.format_string('[{"id":%s}]', "id").alias("body"))
    objects.write_chunk_objects(rows.repartition(7), str(tmp_path))
    found = list(tmp_path.rglob("*"))
    assert len(found) <= 2 * 16 + 1 and sum(f.stat().st_blocks * 512 for f in found) < 3000 * 512
    assert sorted(map(tuple, objects.read_chunk_objects(spark, str(tmp_path)).collect())) == sorted(map(tuple, rows.collect()))


def test_chunk_objects_by_key(spark, tmp_path, monkeypatch):
    """A write adds objects and replaces those of its keys; one is read by its key; packs are zstd files of whole objects."""
    import zstandard

    from beaconry.sources import objects

    monkeypatch.setattr(objects, "BUCKETS", 4)
    path, want = str(tmp_path), {}
    for bodies in ({f"g/{k}.json.zst": f'["{k}"]' for k in [*range(50), "\u00e9", "\uffff", "\U0001f600"]}, {"g/7.json.zst": "[7]", "g/\uffff.json.zst": None, "h/new.json.zst": "[0]"}, {"g/7.json.zst": '["' + "x" * 300_000 + '"]'}):
        objects.write_chunk_objects(spark.createDataFrame([*bodies.items()], "object_key string, body string"), path)
        want |= {k: v or "[]" for k, v in bodies.items()}
        assert sorted(map(tuple, objects.read_chunk_objects(spark, path).collect())) == sorted(want.items())
        assert {k: objects.read_object(path, k) for k in want} == want
    assert objects.read_object(path, "g/none.json.zst") is None and objects.read_object(f"{path}/none", "g/7.json.zst") is None
    first = min((f for f in tmp_path.rglob("*.zst") if f.name.startswith("0000000001-")), key=str)
    keys = [k.decode() for k, _, _ in objects._objects(objects.open_store(path)[0], str(first), 0)]
    with first.open("rb") as f, zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True) as docs:
        assert len(keys) > 1 and docs.read().decode() == "".join(f'["{k[2:-9]}"]' for k in keys)
    first.write_bytes(first.read_bytes()[:-1])
    with pytest.raises(Exception, match="no whole pack"):
        objects.read_chunk_objects(spark, path).collect()


@pytest.mark.parametrize("name", ["q_stream_dedupe_chunks", "q_stream_first_billing", "q_stream_session_changes"])
def test_stream_folds_by_bucket(spark, later, name, monkeypatch):
    """Keys share calls of Python, and results are the SQL's with one bucket for all keys as well as with many."""
    from beaconry.streaming import jobs

    called = []
    true = jobs.by_bucket
    monkeypatch.setattr(jobs, "by_bucket", lambda rows, keys: called.append(keys) or true(rows, keys))
    for n in (1, 64):
        monkeypatch.setattr(jobs, "BUCKETS", n)
        against_sql(spark, later, name)
    assert called


def test_bodies_are_parsed_once(spark):
    """One parse makes the map of a body, and a second one is only for texts that might end the array early."""
    from beaconry.operators.web import json_map, whole_json_map

    texts = ['{"a":1}', ' {"a":{"b":[1,{"c":2}]}} ', '{"a":1} x', '{"a":1}}', '{"a":1}],[', '{"a":1},{"b":2}', "[1]", "null", "", None, '{"a":"}]"}', '{"a":[{"b":1} ] }', "{", "{}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", whole_json_map(F.col("t")).alias("m"), json_map(F.col("t")).alias("first"))
    rows = sorted(df.collect())
    assert [r.m for r in rows] == [{"a": "1"}, {"a": '{"b":[1,{"c":2}]}'}, None, None, None, None, None, None, None, None, {"a": '"}]"'}, {"a": '[{"b":1}]'}, None, {}]
    assert [r["first"] for r in rows[6:10]] == [None] * 4
    made = str(whole_json_map(F.col("t")))
    assert made.count("try_parse_json") == 2 and "schema_of_variant" not in made, made


def test_rounds_read_dead_letters(spark, later, monkeypatch):
    """Rounds over dead letters read their table; requests are parsed once, when it is written."""
    from beaconry.sources import requests

    plans = []
    true = requests.replay_dead_letters
    monkeypatch.setattr(requests, "replay_dead_letters", lambda held, now, *a, **k: plans.append(held._jdf.queryExecution().optimizedPlan().toString() + now._jdf.queryExecution().optimizedPlan().toString()) or true(held, now, *a, **k))
    against_sql(spark, later, "q_dead_letter_rounds")
    assert len(plans) == 4 and not any("json" in p or "fx_" in p or "Aggregate" in p for p in plans)


def test_chunk_fold_holds_a_slice(monkeypatch):
    """However many chunks come in a batch, a slice of them is in Python's hands; streams go on across slices."""
    import pyarrow as pa

    from beaconry.operators import dedupe

    monkeypatch.setattr(dedupe, "SLICE", 7, raising=False)
    chunk = lambda i: {"received_ms": i, "chunk": i, "batch_id": None if i % 3 == 0 else f"b{i // 2}", "sequence": i // 4, "first_sequence": i // 4, "last_sequence": i // 4}
    streams = [[chunk(i) for i in range(n)] for n in (1, 30, 0, 5, 7, 0, 12, 2)]
    kind = pa.list_(pa.struct([("received_ms", pa.int64()), ("chunk", pa.int64()), ("batch_id", pa.string()), *[(n, pa.int64()) for n in ("sequence", "first_sequence", "last_sequence")]]))
    batch = pa.RecordBatch.from_arrays([*[pa.array([f"{k}{i}" for i in range(len(streams))]) for k in "pswg"], pa.array(streams, kind)], names=[*dedupe.CHUNK_KEY, "rows"])
    want = []
    for i, rows in enumerate(streams):
        seen = dedupe.ChunkSet()
        want += [(f"s{i}", r["chunk"]) for r in rows if seen.offer(r["batch_id"], r["sequence"], r["first_sequence"], r["last_sequence"])]
    out = list(dedupe._kept_chunks(iter([batch.slice(0, 3), batch.slice(3)])))
    assert [(r["session_id"], r["chunk"]) for b in out for r in b.to_pylist()] == want and max(b.num_rows for b in out) <= 7


def test_older_hashes_are_of_projects_that_keep_them(spark, monkeypatch):
    """One project of two keeps the older hash: only its stacks are hashed that way, and results are each project's own."""
    from beaconry.operators import grouping

    rows = [(p, "java", "E", f"E: x\n    at a.B{p}.c(B.java:1)", 1, None, "r") for p in ("p", "q")]
    errors = grouping.build_occurrences(spark.createDataFrame(rows, "project_id string, language string, kind string, stack string, n int, handled boolean, item_build string").withColumns({"message": F.lit("m"), "request_build": F.lit("r")}))
    setting = lambda p, mode: (p, mode, "terminal_cause_frames", True, "bounded", 1 << 20, 8, True, True, True, "include", "deduplicate")
    settings = spark.createDataFrame([setting("p", "legacy"), setting("q", "modern")], "project_id string, mode string, segment_selection string, include_error_kind boolean, raw_stack_policy string, raw_stack_max_bytes int, max_frames int, include_function boolean, include_module boolean, include_file boolean, runtime_frame_policy string, adjacent_frame_policy string")
    none = spark.createDataFrame([], "project_id string, position int, field string, matcher string, pattern string")
    asked, true = [], getattr(grouping, "legacy_hashes", None)
    assert true, "the older hash is made of every stack"
    monkeypatch.setattr(grouping, "legacy_hashes", lambda df: asked.append(df) or true(df))
    got = {r.project_id: r for r in grouping.group_errors(errors, policies=grouping.policies(settings, none)).collect()}
    plain = {r.project_id: r for r in grouping.group_errors(errors).collect()}
    old = {r.project_id: r.legacy_hash for r in grouping.legacy_group_hash(errors).collect()}
    assert [r.project_id for r in asked[0].collect()] == ["p"]
    assert got["p"].group_hash == old["p"] and got["p"].outcome == "legacy" and got["q"].group_hash == plain["q"].group_hash and got["q"].outcome == "frames:1"


def test_a_map_of_json_is_one_parse(spark):
    """Metrics, contexts and events make maps of JSON objects: one parse, and no description of the whole value."""
    from beaconry.operators.web import json_map

    made = str(json_map(F.col("t")))
    assert made.count("try_parse_json") == 1 and "schema_of_variant" not in made, made


def test_pieces_are_dealt_to_all_tasks(spark):
    """What a task sorts of the changes of sessions is its share of the pieces, however few bytes they are, and is sorted once."""
    from beaconry.operators import replay

    some = spark.range(0, 50_000, 1, 4).withColumns({"project_id": F.lit("p"), "session_id": F.format_string("s%s", F.col("id") % 7), "window_id": F.lit("w"), "received_ms": F.col("id") * 1000})
    filters = some.where("id % 3 = 0").withColumns({"request_id": F.col("id"), "browser": F.when(F.col("id") % 2 == 0, F.format_string("b%s", F.col("id") % 5))})
    chunks = some.where("id % 3 = 1").withColumns({"chunk": F.col("id"), "is_final": F.lit(False), "browser": F.lit(None).cast("string")})
    settled = replay.settle_changes(replay.change_rows(chunks, filters, some.where("id % 600 = 2"), ["browser"]), ["browser"], ["browser"])
    assert settled.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = settled._jdf.queryExecution().sparkPlan().toString()
    assert sum("Window [" in line and "piece" in line.rsplit("], [", 2)[-2] for line in plan.splitlines()) == 1, plan
    want, latest = {}, {}
    rows = sorted([(r.received_ms, 0, r.session_id, r.browser) for r in filters.collect()] + [(r.received_ms, 1, r.session_id, None) for r in chunks.collect()])
    began = {s: min(t for t, side, x, _ in rows if x == s and side) for _, _, s, _ in rows}
    for t, side, s, b in rows:
        latest[s] = b if not side else latest.get(s)
        if t >= began[s]:
            want[s, t] = latest[s]
    assert {(r.session_id, r["at"]): r.browser for r in settled.where("side < 2").collect()} == want


def test_stream_of_sessions_folds_chunks_once(spark, later, monkeypatch):
    """The chunks of a stream of sessions are folded once and read from their table."""
    from beaconry.operators import dedupe

    folded, true = [], dedupe.dedupe_chunks
    monkeypatch.setattr(dedupe, "dedupe_chunks", lambda chunks: folded.append(1) or true(chunks))
    against_sql(spark, later, "q_stream_sessions")
    assert len(folded) == 1


def test_scripts_of_very_late_lines(spark, tmp_path):
    """Lines of scripts go on beyond 2 ** 31, as the SQL has it."""
    for t in ("nation", "region"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("event_id", F.expr("event_id + k * 600000000L")).drop("k").write.parquet(f"{tmp_path}/events.parquet")
    against_sql(spark, str(tmp_path), "q_map_js")


def test_metrics_are_dealt_out_before_they_are_parsed(spark):
    """A file of few bytes is one task and holds many events: they go to all tasks before their data is parsed, and come with their columns."""
    from beaconry.operators import metrics

    sources = spark.sql("SELECT explode(array('p0', 'p1')) AS project_id, 'a' AS reference_id, 1 AS ord, 'number' AS data_type, 'scalar' AS metric_shape, cast(NULL AS string) AS regex, false AS allow_negative, false AS allow_float, cast(NULL AS double) AS min_value, 9.0D AS max_value")
    events = spark.range(0, 400, 1, 1).select(F.col("id").alias("request_id"), F.format_string("p%s", F.col("id") % 2).alias("project_id"), F.format_string('{"a":%s}', F.col("id") % 12).alias("data"))
    checked = metrics.validate_metrics(events, metrics.usable_rules(sources))
    lines = checked._jdf.queryExecution().sparkPlan().toString().splitlines()
    parsed = next(i for i, line in enumerate(lines) if "Generate explode" in line)
    assert any("Exchange hashpartitioning(request_id" in line for line in lines[parsed:]), "\n".join(lines)
    assert checked.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = {r.request_id: (r.valid, r.warnings) for r in checked.collect()}
    assert got == {n: ({"a": str(n % 12)}, {}) if n % 12 <= 9 else ({}, {"a": "failed validation: value above maximum"}) for n in range(400)}


def test_mods_of_later_parts_read_events_once(spark, tmp_path):
    """Server rows carry what they need through validation, not by a join of the events with themselves; all rows are those of the SQL."""
    spark.read.parquet(f"{SF}/nation.parquet").write.parquet(f"{tmp_path}/nation.parquet")
    parts = spark.read.parquet(f"{SF}/part.parquet").withColumn("k", F.explode(F.array(*map(F.lit, (0, 5, None))))).withColumn("p_partkey", F.expr("p_partkey + k * 100000L"))
    parts.drop("k").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    for t in ("nation", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("q_mods_v2", "q_mods_events"):
        df = catalog.queries()[name](spark, str(tmp_path))
        got = [tuple(r) for r in df.collect()]
        assert got and sorted(got, key=repr) == sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.oracle_sql()[name]}) q").fetchall(), key=repr)
        assert df._jdf.queryExecution().sparkPlan().toString().count("FileScan parquet [p_partkey") == 1


def test_a_number_is_made_once(spark):
    """What is asked of a metric's number does not parse its text again."""
    from beaconry.operators import metrics

    made = str(metrics.check_number(F.col("v")))
    assert made.count("from_json") == 1, made


def test_plain_strings_of_json(spark):
    """A JSON string without escapes is what its quotes hold, and is not parsed; all texts give what the parser gives."""
    from beaconry.operators.web import json_string

    texts = ['""', '"a"', '" a "', '"a', 'a"', '"', '"""', '"a"b"', '"a" ', '"a"\n', '"a\nb"', '"a\tb"', '"a\\"', '"a\\"b"', '"\\"a"', '"\\u0041"', '"ä \U0001f600"', '"\x7f"', '"\x1f"', '"a","v":"b"', "7", "null", '["a"]', "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    parsed = F.when(F.col("t").startswith('"'), F.from_json(F.concat(F.lit('{"v":'), "t", F.lit("}")), "v string")["v"])
    for r in df.select("t", json_string(F.col("t")).alias("got"), parsed.alias("want")).collect():
        assert r.got == r.want, r
    assert "rlike" in str(json_string(F.col("t"))).lower()

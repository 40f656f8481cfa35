"""Dates, ingest, validation, metadata, readers, sinks, services and streaming."""

import json
import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom import catalog
from tagloom.functions import buckets, dates
from tagloom.lang import services, words
from tagloom.operators import columns, normalize, smoothing, validate
from tagloom.plans.compiler import LimitError, Limits, evaluate, lines
from tagloom.sources import metadata, readers, series, sinks
from tagloom.streaming import evaluator
from tagloom.streaming.online import online

STEP = 60_000


def test_dates():
    assert [dates.duration(t) for t in ("5m", "1h", "2w", "1month", "1y", "PT5M", "P1DT2H", "90s")] == [300_000, 3_600_000, 1_209_600_000, 2_592_000_000, 31_536_000_000, 300_000, 93_600_000, 90_000]
    now = 1_700_000_000_000
    assert dates.timestamp("now-1h", now=now) == now - 3_600_000
    assert dates.timestamp("epoch+1d") == 86_400_000
    assert dates.timestamp("1700000000") == dates.timestamp("1700000000000") == dates.timestamp("1700000000000000") == now
    assert dates.timestamp("2024-01-01") == 1_704_067_200_000
    assert dates.timestamp("2024-01-01T01:00", "America/New_York") == 1_704_067_200_000 + 6 * 3_600_000
    assert dates.timestamp("2024-01-01T01:00:00.5+01:00") == 1_704_067_200_500
    assert dates.time_range("e-3h", "2024-01-01") == (1_704_067_200_000 - 3 * 3_600_000, 1_704_067_200_000)
    assert dates.time_range("2024-01-01", "s+1h")[1] == 1_704_067_200_000 + 3_600_000
    assert dates.auto_step(STEP, 0, 86_400_000, 700) == 3 * STEP
    for bad in ("x", "5q", "2024-13-01"):
        with pytest.raises(ValueError):
            dates.timestamp(bad)


def test_buckets(spark):
    values = [0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 4.5, 5.0, 14.0, 15.0, 16.0, 20.9, 21.0, 99.0, 100.0, 105.9, 106.0, 999.0, 1000.1, 12345.6, 1e6, 1e9, 3.3e12, 4.0**20 - 1, 4.0**20, 2.0**62, 9e18]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", buckets.index_column(F.col("v")).alias("i")).collect()
    assert [r.i for r in got] == [buckets.index_of(v) for v in values]
    # the public scheme has 276 buckets; bounds that are known from its documentation
    assert buckets.COUNT == 276 and buckets.BOUNDS[:20] == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 16, 21, 26, 31, 36, 41]
    assert all(buckets.BOUNDS[buckets.index_of(v)] > v for v in values)


def test_percentile_accuracy(spark):
    df = spark.range(100).select(F.create_map(F.lit("name"), F.lit("t"), F.lit("percentile"), buckets.tag_column(F.col("id").cast("double"))).alias("tags"), F.lit(STEP).alias("ts"), F.lit(1 / 60).alias("value"))
    got = {r.tags["percentile"].strip(): r.value for r in evaluate(spark, series.datapoints(df, STEP), "name,t,:eq,(,9,25,50,90,98,),:percentiles", STEP, 2 * STEP).collect()}
    # above 85 a bucket of the public scheme is 21 wide
    assert all(abs(v - float(p)) <= (2 if float(p) <= 90 else 21) for p, v in got.items()) and len(got) == 5


def test_smoothing_states():
    r = random.Random(1)
    values = [math.nan if r.random() < 0.01 else r.random() * 100 for _ in range(2000)]
    for op, args in (("rolling-count", (5,)), ("rolling-min", (5,)), ("rolling-max", (5,)), ("rolling-sum", (5,)), ("rolling-mean", (5, 2)), ("delay", (3,)), ("derivative", ()), ("integral", ()), ("cumulative-max", ()), ("trend", ("5m",)), ("des", (10, 0.1, 0.5))):
        whole, part, out = online(op, args, STEP), online(op, args, STEP), []
        for k, v in enumerate(values):
            if k % 100 == 50:
                part = online(op, args, STEP).restore(part.state())
            out.append((whole.next(v), part.next(v)))
        assert all(a == b or math.isnan(a) and math.isnan(b) for a, b in out), op
    batch = smoothing.smooth_values(np.array(values), "des", (10, 0.1, 0.5))
    des = online("des", (10, 0.1, 0.5))
    assert np.allclose([des.next(v) for v in values], batch, equal_nan=True)


def test_online_equals_window(spark):
    r = random.Random(2)
    points = [(t * STEP, float(r.randrange(5))) for t in range(1, 40) if r.random() < 0.8]
    df = spark.createDataFrame([({"name": "a"}, t, v) for t, v in points], "tags map<string,string>, ts long, value double")
    known = dict(points)
    for word, op, args in (("4,:rolling-sum", "rolling-sum", (4,)), ("4,2,:rolling-mean", "rolling-mean", (4, 2)), ("2,:delay", "delay", (2,)), (":derivative", "derivative", ()), ("3m,:trend", "trend", ("180s",)), ("3,0.3,0.2,:des", "des", (3, 0.3, 0.2)), ("4,:rolling-count", "rolling-count", (4,))):
        got = {x.ts: x.value for x in evaluate(spark, series.datapoints(df, STEP), f"name,a,:eq,{word}", STEP, 40 * STEP, dense=True).collect()}
        o = online(op, args, STEP)
        for t in range(1, 40):
            want = o.next(known.get(t * STEP, math.nan))
            have = got[t * STEP]
            assert have is None if math.isnan(want) else have == pytest.approx(want), (word, t)


def test_sliding_smoother_ignores_range_start():
    v = np.sin(np.arange(200.0))
    whole = smoothing.smooth_values(v, "sdes", (10, 0.1, 0.5))
    assert np.isnan(whole[:10]).all() and not np.isnan(whole[10:]).any()
    for shift in (10, 20):  # after two turns the past is forgotten
        later = smoothing.smooth_values(v[3:], "sdes", (10, 0.1, 0.5), skip=shift - 3)
        even = smoothing.smooth_values(v[shift:], "sdes", (10, 0.1, 0.5))
        assert np.allclose(later[shift - 3 :], even, equal_nan=True)
    assert np.allclose(whole[40:], smoothing.smooth_values(v[20:], "sdes", (10, 0.1, 0.5))[20:])


def test_normalize(spark):
    make = lambda rows: spark.createDataFrame([({"name": "x", "dstype": k}, t, v) for k, t, v in rows], "tags map<string,string>, ts long, value double")
    got = lambda rows, step: {(r.tags["dstype"], r.ts): r.value for r in normalize.normalize(make(rows), step).collect()}
    assert got([("gauge", 5, 1.0), ("gauge", 8, 3.0), ("gauge", 11, 2.0)], 10) == {("gauge", 10): 3.0, ("gauge", 20): 2.0}
    assert got([("sum", 5, 1.0), ("sum", 8, 3.0), ("sum", 10, None)], 10) == {("sum", 10): 4.0}
    rate = normalize.counter_to_rate(spark.createDataFrame([("a", 0, 0.0), ("a", 10_000, 50.0), ("a", 20_000, 10.0)], "id string, ts long, value double"), ["id"]).orderBy("ts").collect()
    assert [(r.ts, r.value) for r in rate] == [(10_000, 5.0), (20_000, 0.0)]
    regrid = lambda rows: sorted((r.ts, r.value) for r in normalize.regrid(spark.createDataFrame([("a", t, v) for t, v in rows], "id string, ts long, value double"), ["id"], 10, 20).collect())
    assert regrid([(5, 1.0), (15, 2.0), (25, 2.0), (35, 1.0), (85, 1.0), (95, 2.0), (105, 2.0)]) == [(0, 0.5), (10, 1.5), (20, 2.0), (30, 1.5), (80, 0.5), (90, 1.5), (100, 2.0)]
    assert regrid([(0, 1.0), (10, 2.0), (20, 3.0), (30, 1.0)]) == [(0, 1.0), (10, 2.0), (20, 3.0), (30, 1.0)]
    assert regrid([(0, 1.0), (10, 2.0), (30, 1.0), (60, 4.0), (70, 2.0)]) == [(0, 1.0), (10, 2.0), (20, 1.0), (30, 1.0), (60, 4.0), (70, 2.0)]


def test_validate(spark):
    cases = [({"name": "ok"}, None), ({"k1": "v"}, "has-key:name"), ({"name": "x", "a" * 70: "v"}, "key-length"), ({"name": "x"}, "name-value-length"), ({"name": "a b"}, "valid-characters"), ({"name": "ok", "sys.x": "1"}, "reserved-key:sys."), ({"name": "ok"} | {f"k{i}": "v" for i in range(30)}, "max-user-tags"), (None, "has-key:name")]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "id int, tags map<string,string>")
    got = {r.id: r.failed for r in validate.validated(df).collect()}
    assert got == {k: f for k, (_, f) in enumerate(cases)}
    more = [validate.value_length(1, 3), validate.key_pattern("[a-z]+"), validate.value_pattern("^o"), validate.composite(validate.has_key(), validate.key_length())]
    assert {r.failed for r in validate.validated(df.where("id = 0"), more).collect()} == {None}


def test_metadata(spark):
    df = readers.constants(spark, STEP, 0, 2 * STEP)
    s = series.datapoints(df, STEP)
    assert {r.key for r in metadata.tag_keys(s).collect()} == {"name", "type"}
    assert [r.value for r in metadata.tag_values(s, "name", "name,1,:re", limit=5).collect()] == ["1", "10"]
    assert [r.value for r in metadata.tag_values(s, "name", offset="7", limit=5).collect()] == ["8", "9"]
    assert metadata.series_table(s).count() == 11
    ids = df.select(series.series_id(F.col("tags")).alias("i")).distinct().count()
    assert ids == 11


def test_readers(spark, tmp_path):
    (tmp_path / "batch.json").write_text(json.dumps({"tags": {"app": "a", "x": "1"}, "metrics": [{"tags": {"name": "m", "x": "2"}, "timestamp": 5, "value": 1.5}]}))
    got = readers.publish_batches(spark, str(tmp_path / "batch.json")).collect()
    assert [(r.tags, r.ts, r.value) for r in got] == [({"app": "a", "x": "2", "name": "m"}, 5, 1.5)]
    (tmp_path / "list.json").write_text(json.dumps([{"tags": {"name": "m"}, "timestamp": 5, "value": 1.5}]))
    assert readers.publish_list(spark, str(tmp_path / "list.json")).collect()[0].tags == {"name": "m"}
    rows = [({"name": "a", "k": "v"}, 1, 2.0), ({"name": "b"}, 3, 4.0)]
    (tmp_path / "compact.json").write_text(readers.encode_compact(rows))
    assert [(r.tags, r.ts, r.value) for r in readers.compact_batch(spark, str(tmp_path / "compact.json")).collect()] == rows
    assert readers.synthetic(spark, STEP, 3, 10, 2).count() == 30


def test_sinks(spark, tmp_path):
    s = series.datapoints(readers.constants(spark, STEP, 0, 3 * STEP, 3), STEP)
    out = evaluate(spark, s, ":true,:sum,(,name,),:by,line $name,:legend", 0, 3 * STEP)
    sinks.write_csv(out, str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*"))
    assert text.splitlines()[0] == "timestamp,line 0,line 1,line 2" and "1970-01-01T00:01:00Z,0.0,1.0,2.0" in text
    docs = {json.loads(r.json)["label"]: json.loads(r.json)["values"] for r in sinks.series_json(out, 0, STEP, 3 * STEP).collect()}
    assert docs["line 2"] == [2.0, 2.0, 2.0]
    assert {r.label: r.total for r in sinks.statistics(out).collect()}["line 2"] == 6.0
    sinks.append_points(s.df.select("tags", "ts", "value"), str(tmp_path / "store"))
    again = series.datapoints(readers.points_table(spark, str(tmp_path / "store")), STEP)
    assert evaluate(spark, again, ":true", 0, 3 * STEP).agg(F.sum("value")).first()[0] == 9.0


def test_services():
    assert services.queries("name,a,:eq,:avg,name,b,:eq,:sum,:add") == ["name,a,:eq", "name,b,:eq"]
    assert services.normalize("b,2,:eq,a,1,:eq,:and,:sum") == services.normalize("a,1,:eq,b,2,:eq,:and,:sum")
    assert services.strip("a,1,:eq,b,2,:eq,:and,:sum", ["b"]) == ["a,1,:eq,:sum"]
    assert "sum" in services.complete("a,1,:eq") and "sum" not in services.complete("")
    assert services.debug("a,b,:swap")[-1] == (":swap", ["a", "b"])
    assert services.streaming_problems(":true,:sum,1h,:offset") and not services.streaming_problems(":true,:sum,5,:rolling-max")
    r = services.graph_request("/graph?q=name,a,:eq,:sum&cq=b,2,:eq&s=e-3h&e=2024-01-01&step=5m", STEP)
    assert (r.end - r.start, r.step, str(r.program[0].expr)) == (3 * 3_600_000, 300_000, "name,a,:eq,b,2,:eq,:and,:sum")


def test_messages_and_legends(spark):
    from tagloom.operators.presentation import short_legends

    s = series.datapoints(readers.constants(spark, STEP, 0, 3 * STEP, 3), STEP)
    out = sinks.fetch_messages(evaluate(spark, s, ":true,:sum,(,name,),:by", 0, 3 * STEP), 0, STEP, 3 * STEP).orderBy("order").collect()
    assert [json.loads(r.json).get("type") for r in out] == ["metadata", None, None, None, "close"]
    legend = lambda p: [x.get("legend") for x in short_legends(words.parse(p))]
    assert legend("name,a,:eq,app,x,:eq,:and,name,a,:eq,app,y,:eq,:and") == ["x", "y"]
    assert legend("name,a,:eq,(,k,),:by") == ["$(k)"]
    assert sinks.sharded(s.df, 4).select("shard").distinct().count() <= 4


def test_custom_words(spark):
    interpreter = words.new_interpreter()
    interpreter.register("twice", "2,:mul")
    words.custom_average(interpreter, "node-avg", "name,nodes,:eq", ("app",))
    assert str(words.parse("name,a,:eq,:twice", interpreter)[0].expr) == "name,a,:eq,:sum,2.0,:const,:mul"
    e = words.parse("name,a,:eq,app,x,:eq,:and,:node-avg", interpreter)[0].expr
    assert "name,nodes,:eq,app,x,:eq,:and" in str(e.expr)


def test_negated_missing_tag(spark):
    df = spark.createDataFrame([({"a": "1"},), ({"b": "1"},)], "tags map<string,string>")
    s = series.datapoints(df.withColumn("ts", F.lit(STEP)).withColumn("value", F.lit(1.0)), STEP)
    count = lambda q: s.df.where(columns.matches(words.parse_query(q), s.key)).count()
    assert [count(q) for q in ("a,1,:eq", "a,1,:eq,:not", "a,:has", "a,(,1,2,),:in,:not", ":false")] == [1, 1, 1, 1, 0]


def test_predicates_reach_the_scan(spark, sf_dir):
    from tagloom import catalog

    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    df = lines(spark, catalog.events(spark, sf_dir), "event_type,click,:eq,:sum,(,user_id,),:by", catalog.E0, catalog.E1)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,click)" in plan and "GreaterThan(ts" in plan
    assert "props" not in plan.split("ReadSchema")[1]


def test_shared_scan_has_no_join(spark, sf_dir):
    from tagloom import catalog

    df = lines(spark, catalog.events(spark, sf_dir), "name,events,:eq,:avg,(,event_type,),:by", catalog.E0, catalog.E1)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("FileScan") == 1


# --- streaming ---


def _events(spark, path, part, minutes):
    t0 = datetime(2024, 1, 1)
    rows = [(t0 + timedelta(minutes=m, seconds=s), ("a", "b")[s % 2], float(m)) for m in minutes for s in range(4)]
    spark.createDataFrame(rows, "ts timestamp, kind string, value double").coalesce(1).write.mode("append").parquet(f"{path}/{part}")


def test_stream_equals_batch(spark, tmp_path):
    for k, minutes in enumerate(([0, 1], [2, 3], [4, 9])):
        _events(spark, str(tmp_path / "in"), k, minutes)
    schema = "ts timestamp, kind string, value double"
    programs = {"p": ":true,:sum,(,kind,),:by", "q": "kind,a,:eq,:count"}
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = evaluator.partial_aggregates(stream, programs, STEP, delay_ms=STEP)
    q = out.writeStream.format("memory").queryName("partials").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = evaluator.partial_aggregates(spark.read.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in")), programs, STEP)
    pick = lambda df: {(r.query, r["keys"], r.ts): (r.value, r.samples) for r in df.collect()}
    got, want = pick(spark.table("partials")), pick(batch)
    assert got and all(want[k] == v for k, v in got.items())
    # what the watermark has not passed yet stays open
    assert {t for _, _, t in want} - {t for _, _, t in got} <= {1_704_067_200_000 + 10 * STEP, 1_704_067_200_000 + 9 * STEP}
    final = evaluator.final_eval(batch, programs | {"r": ":true,:sum,(,kind,),:by,2,:rolling-max"}, STEP, 1_704_067_260_000, 1_704_067_200_000 + 11 * STEP)
    assert {r.id for r in final.where("value IS NOT NULL").collect()} == {"p", "q", "r"}


def test_stateful_stream(spark, tmp_path):
    path = str(tmp_path / "pts")
    for k, ts in enumerate(([1, 2], [3, 6], [7])):
        spark.createDataFrame([("a", t * STEP, float(t)) for t in ts], "keys string, ts long, value double").coalesce(1).write.mode("append").parquet(f"{path}/{k}")
    stream = spark.readStream.schema("keys string, ts long, value double").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(path)
    q = evaluator.over_time(stream, "rolling-sum", (3,), STEP).writeStream.format("memory").queryName("rolled").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.ts // STEP: r.value for r in spark.table("rolled").collect()}
    assert got == {1: 1, 2: 3, 3: 6, 4: 5, 5: 3, 6: 6, 7: 13}


def test_time_grouped(spark):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([(t, "g", "r1", 1.0), (t, "g", "r1", 1.0), (t, "g", "r2", 2.0), (t + timedelta(days=9), "g", "r1", 5.0)], "time timestamp, keys string, replica string, value double")
    now = F.lit(t + timedelta(days=1))
    assert [r.value for r in evaluator.time_grouped(df, STEP, now=now).collect()] == [4.0]
    assert [r.value for r in evaluator.time_grouped(df, STEP, replica="replica", now=now).collect()] == [3.0]
    assert evaluator.time_grouped(df, STEP, max_input=2, now=now).count() == 0


# --- registered queries over whole tables ---


def _wide_events(spark, folder):
    """Events of users with small and large ids; rows as (hour, user_id, event_type, value)."""
    data = [(h, u, kind, float(u % 97 + h)) for h in (1, 2) for u in (3, 19, 20, 49, 50, 1499, 70_000) for kind in ("click", "view")]
    stamp = F.timestamp_millis(F.lit(catalog.E0) + F.col("hour") * catalog.HOUR).cast("timestamp_ntz").alias("ts")
    df = spark.createDataFrame(data, "hour long, user_id long, event_type string, value double")
    df.select(F.monotonically_increasing_id().alias("event_id"), stamp, "user_id", "event_type", "value").write.parquet(f"{folder}/events.parquet")
    return data


def test_data_all_reads_every_user(spark, tmp_path):
    data = _wide_events(spark, tmp_path)
    got = {(x.tags, x.ts): x.value for x in catalog.QUERIES["data_all"](spark, str(tmp_path)).collect()}
    assert got == {(json.dumps({"event_type": kind, "name": "events", "user_id": str(u)}, separators=(",", ":")), catalog.E0 + h * catalog.HOUR): v for h, u, kind, v in data}


def test_event_sample_counts_every_user(spark, tmp_path):
    data = _wide_events(spark, tmp_path)
    got = {(x.step_end, x.event_type): x["count"] for x in catalog.QUERIES["event_sample"](spark, str(tmp_path)).collect()}
    assert got == {(catalog.E0 + h * catalog.HOUR, kind): sum(a == h and c == kind for a, _, c, _ in data) for h, _, kind, _ in data}


def test_over_time_carries_its_state_over_long_gaps(spark, tmp_path):
    last = 25_000
    for points in ([(1, 2.0)], [(last, 3.0)]):
        spark.createDataFrame([("a", t * STEP, v) for t, v in points], "keys string, ts long, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = evaluator.over_time(spark.readStream.schema("keys string, ts long, value double").parquet(f"{tmp_path}/in"), "integral", (), STEP).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination(60)
    got = {x.ts // STEP: x.value for x in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {t: 5.0 if t == last else 2.0 for t in range(1, last + 1)}


def test_count_is_of_series(spark):
    """Two rows of one tag set at one time are one line; a coarser step counts shares of primary intervals."""
    rows = [({"name": "a", "k": "x"}, STEP, 1.0), ({"name": "a", "k": "x"}, STEP, 5.0), ({"name": "a", "k": "y"}, STEP, 2.0), ({"name": "a", "k": "z"}, STEP, None), ({"name": "a", "k": "y"}, 2 * STEP, 3.0)]
    source = series.datapoints(spark.createDataFrame(rows, "tags map<string,string>, ts long, value double"), STEP)
    got = {r.ts // STEP: r.value for r in evaluate(spark, source, "name,a,:eq,:count", STEP, 3 * STEP).collect()}
    assert got == {1: 2.0, 2: 1.0}
    assert [r.value for r in evaluate(spark, source, "name,a,:eq,:count", 2 * STEP, 4 * STEP, 2 * STEP).collect()] == [1.5]
    assert [r.value for r in evaluate(spark, source, "name,a,:eq,:avg", STEP, 2 * STEP).collect()] == [4.0]


def test_results_do_not_depend_on_the_zone(spark, sf_dir):
    names = ("data_sum_by", "math_time_hour", "math_time_weekday", "event_sample", "event_datapoints", "ingest_last_write")
    run = lambda: [sorted(map(str, catalog.QUERIES[q](spark, sf_dir).collect())) for q in names]
    want = run()
    try:
        for zone in ("America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert run() == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_finer_step_repeats_the_interval(spark):
    rows = [({"name": "a"}, STEP, 1.0), ({"name": "a"}, 2 * STEP, 5.0)]
    source = series.datapoints(spark.createDataFrame(rows, "tags map<string,string>, ts long, value double"), STEP)
    got = {r.ts: r.value for r in evaluate(spark, source, "name,a,:eq,:sum", STEP // 2, 2 * STEP + STEP // 2, STEP // 2).collect()}
    assert got == {STEP // 2: 1.0, STEP: 1.0, STEP * 3 // 2: 5.0, 2 * STEP: 5.0}
    with pytest.raises(ValueError):
        evaluate(spark, source, "name,a,:eq,:sum", 0, 7000 * 10, 7000)


def test_limits(spark):
    source = series.datapoints(readers.constants(spark, STEP, 0, 10 * STEP), STEP)
    fits = Limits(lines=11, datapoints=110)
    assert evaluate(spark, source, ":true,:sum", 0, 10 * STEP, limits=fits).count() == 10
    for limits in (Limits(lines=10), Limits(datapoints=109)):
        with pytest.raises(LimitError):
            evaluate(spark, source, ":true,:sum", 0, 10 * STEP, limits=limits)


def test_partial_and_multiple_tags(spark):
    q = lambda s: words.parse_query(s)
    for text, tags, could in (
        ("a,1,:eq,b,2,:eq,:and", {"a": "1"}, True),
        ("a,1,:eq,b,2,:eq,:and", {"a": "2"}, False),
        ("a,1,:eq,b,2,:eq,:or", {"a": "2"}, True),
        ("a,1,:eq,:not", {"a": "1"}, False),
        ("a,1,:eq,:not", {}, True),
        ("a,1,:eq,b,2,:eq,:and,:not", {"a": "1"}, True),
        (":false", {}, False),
        ("a,(,1,2,),:in", {"a": "3"}, False),
    ):
        assert columns.could_match(q(text), tags) == could, text
    df = spark.createDataFrame([({"a": ["1", "2"], "b": ["x"]},), ({"a": ["3"]},), ({},)], "t map<string,array<string>>")
    for text, want in (("a,2,:eq", [True, False, False]), ("a,2,:gt", [False, True, False]), ("b,:has", [True, False, False]), ("a,1,:eq,a,2,:eq,:and", [True, False, False]), ("a,3,:eq,:not", [True, False, True])):
        got = [r[0] for r in df.select(columns.matches_any(q(text), lambda k: F.col("t")[k])).collect()]
        assert got == want and [columns.matches_any_value(q(text), r.t) for r in df.collect()] == want, text


def test_sums_of_doubles_are_exact(spark):
    rng = random.Random(5)
    sets = [[0.1] * 10, [1e16, 1.0, 1.0, -1e16], [1e300, 5.0, -1e300], [1e-9 / 3] * 7, [2.0**40 + 0.25, -0.1, 0.3], [math.inf, 1.0], [-math.inf, 1e30], [0.0]]
    sets += [[round(rng.expovariate(0.02), 2) for _ in range(300)] for _ in range(20)]
    sets += [[rng.uniform(-1, 1) * 10 ** rng.randint(-6, 12) for _ in range(50)] for _ in range(20)]
    rows = [(i, v) for i, s in enumerate(sets) for v in [*s, None]] + [(len(sets), None)]
    got = {r.i: r.x for r in spark.createDataFrame(rows, "i int, v double").groupBy("i").agg(columns.exact_sum(F.col("v")).alias("x")).collect()}
    for i, s in enumerate(sets):
        if i == 2:  # beyond 2**85: plain sums
            continue
        assert got[i] == pytest.approx(math.fsum(s), rel=2e-16), s
    assert got[0] == 1.0 and got[1] == 2.0 and got[5] == math.inf and got[6] == -math.inf and got[len(sets)] is None


def test_filter_decides_on_exact_totals(spark):
    """Of lines whose values add up to the threshold exactly none is above it, whatever the order of additions."""
    rng = random.Random(3)
    rows = []
    for line in range(80):
        cents = [rng.randint(1, 9000) for _ in range(69)]
        cents.append(350_000 + line % 2 - sum(cents))
        rows += [({"name": "a", "id": str(line)}, (k + 1) * STEP, c / 100) for k, c in enumerate(cents)]
    source = series.datapoints(spark.createDataFrame(rows, readers.POINT).withColumnRenamed("timestamp", "ts"), STEP)
    above = {str(line) for line in range(1, 80, 2)}
    for stat, bound in (("total", "3500"), ("avg", "50")):
        out = lines(spark, source, f"name,a,:eq,:sum,(,id,),:by,:stat-{stat},{bound},:gt,:filter", STEP, 71 * STEP)
        assert {r.id for r in out.select("id").distinct().collect()} == above
    top = lines(spark, source, "name,a,:eq,:sum,(,id,),:by,total,41,:topk", STEP, 71 * STEP)
    assert {r.id for r in top.select("id").distinct().collect()} == above | {"0"}


def test_compact_payloads_are_bounded(spark, sf_dir):
    """A timestamp with many points gives several payloads; missing values and payloads come through."""
    from tagloom import catalog_more  # noqa: F401

    points = [({"name": "a", "id": str(i)}, 1, None if i == 3 else i / 7) for i in range(10)] + [({"name": "b"}, 2, 1.0), ({}, 2, -1.0), ({"x": "é\"\\\n"}, 2, 0.1)]
    payloads = readers.compact_payloads(spark.createDataFrame(points, readers.POINT).repartition(3), 4)
    texts = [r.payload for r in payloads.collect()]
    assert sorted((len({ts for _, ts, _ in rows}), len(rows)) for rows in (list(readers._compact_rows(t)) for t in texts)) == [(1, 2), (1, 3), (1, 4), (1, 4)]
    back = readers.decode_compact(payloads.unionByName(spark.createDataFrame([(None,)], "payload string")), "payload").collect()
    key = lambda p: (p[1], sorted(p[0].items()))
    assert sorted(((r.tags, r.ts, r.value) for r in back), key=key) == sorted(points, key=key)
    many = readers.encode_compact([({"name": "a"}, i, float(i)) for i in range(2 * readers.PAYLOAD_POINTS + 1)])
    assert readers.decode_compact(spark.createDataFrame([(many,)], "p string"), "p").agg(F.sum("value"), F.count("ts")).first() == (sum(range(2 * readers.PAYLOAD_POINTS + 1)), 2 * readers.PAYLOAD_POINTS + 1)
    # no list of a whole hour is built on the way
    assert "collect_list" not in catalog.QUERIES["publish_compact"](spark, sf_dir)._jdf.queryExecution().toString()

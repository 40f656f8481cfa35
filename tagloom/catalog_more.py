"""Further registered queries: smoothing, presentation, validation rules, published payloads and time grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.catalog import _OVER, DAY, E0, E1, HOUR, ORACLE_SQL, QUERIES, SUMS, add, by_type, cents, ctes, event_rows, events, register, rounded, typed
from tagloom.functions import dates
from tagloom.lang import words
from tagloom.operators import columns, normalize, presentation, validate
from tagloom.plans import compiler
from tagloom.sources import readers, series, sinks
from tagloom.streaming import evaluator

# --- double exponential smoothing, as a recursion over each line's points; sums are of whole cents, so both sides see equal numbers ---

_CENTS = "sum(round(value * 100))"


def _smoother(p: str, alpha: float, beta: float) -> str:
    """Columns of a smoother's state (p_seen, p_level, p_slope) after a value v of the next row."""
    level = f"({alpha} * r.v + (1 - {alpha}) * ({p}_level + {p}_slope))"
    return (
        f"CASE WHEN r.v IS NULL THEN {p}_seen ELSE {p}_seen + 1 END AS {p}_seen, "
        f"CASE WHEN r.v IS NULL THEN {p}_level WHEN {p}_seen = 0 THEN r.v ELSE {level} END AS {p}_level, "
        f"CASE WHEN r.v IS NULL OR {p}_seen = 0 THEN {p}_slope ELSE {beta} * ({level} - {p}_level) + (1 - {beta}) * {p}_slope END AS {p}_slope"
    )


def _smoothed(training: int, alpha: float, beta: float) -> str:
    """z(event_type, ts, v, p): the prediction p made before each value."""
    alpha, beta = f"{alpha}::DOUBLE", f"{beta}::DOUBLE"
    head = by_type(_CENTS).replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    return (
        f"{head}, r AS (SELECT event_type, ts, v::DOUBLE AS v, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS i FROM d), "
        "z AS (SELECT DISTINCT event_type, 0::BIGINT AS i, 0::BIGINT AS ts, NULL::DOUBLE AS v, NULL::DOUBLE AS p, 0 AS a_seen, NULL::DOUBLE AS a_level, 0::DOUBLE AS a_slope FROM r "
        f"UNION ALL SELECT r.event_type, r.i, r.ts, r.v, CASE WHEN a_seen >= {training} THEN a_level END, {_smoother('a', alpha, beta)} FROM z JOIN r ON r.event_type = z.event_type AND r.i = z.i + 1) "
    )


def _sliding(training: int, alpha: float, beta: float) -> str:
    """As _smoothed for the sliding form: two smoothers that take turns, from the first multiple of the training span on."""
    alpha, beta = f"{alpha}::DOUBLE", f"{beta}::DOUBLE"
    span = training * HOUR
    skip = (-(-E0 // span) * span - E0) // HOUR
    head = by_type(_CENTS).replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    state = ("seen", "level", "slope")
    turn = f"r.i > {skip} AND (r.i - {skip}) % {training} = 0"
    fresh = {"seen": "0", "level": "NULL", "slope": "0"}
    # both see the value; where turns change, the other is in use and starts anew itself
    step = f"SELECT r.event_type, r.i, r.ts, r.v, CASE WHEN r.i > {skip} AND a_seen >= {training} THEN a_level END AS p, {turn} AS turn, {_smoother('a', alpha, beta)}, {_smoother('b', alpha, beta)} FROM z JOIN r ON r.event_type = z.event_type AND r.i = z.i + 1"
    moved = ", ".join([f"CASE WHEN turn THEN b_{s} ELSE a_{s} END AS a_{s}" for s in state] + [f"CASE WHEN turn THEN {fresh[s]} ELSE b_{s} END AS b_{s}" for s in state])
    return (
        f"{head}, r AS (SELECT event_type, ts, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY ts) > {skip} THEN v::DOUBLE END AS v, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS i FROM d), "
        "z AS (SELECT DISTINCT event_type, 0::BIGINT AS i, 0::BIGINT AS ts, NULL::DOUBLE AS v, NULL::DOUBLE AS p, 0 AS a_seen, NULL::DOUBLE AS a_level, 0::DOUBLE AS a_slope, 0 AS b_seen, NULL::DOUBLE AS b_level, 0::DOUBLE AS b_slope FROM r "
        f"UNION ALL SELECT event_type, i, ts, v, p, {moved} FROM ({step})) "
    )


_SPEEDS = {"": (10, 0.1, 0.5), "simple": (10, 0.1, 0.5), "fast": (10, 0.1, 0.02), "slower": (10, 0.05, 0.03), "slow": (10, 0.03, 0.04)}
for _op, _sql in (("des", _smoothed), ("sdes", _sliding)):
    for _speed, _args in _SPEEDS.items():
        _word = f":{_op}-{_speed}" if _speed else f"{','.join(map(str, _args))},:{_op}"
        add(f"stateful_{_op}{'_' * bool(_speed)}{_speed}", f"{SUMS},{_word}", _sql(*_args) + typed("p", "z"), source=cents)
_EPIC = _smoothed(10, 0.1, 0.02)
_ABOVE = "coalesce(v > p * 1.3::DOUBLE, false) AND coalesce(v > coalesce(p + 1000, 1000), false)"
_BELOW = "coalesce(v < p * 0.7::DOUBLE, false) AND coalesce(v < coalesce(p - 1000, -1000), false)"
add("stateful_des_epic_signal", f"{SUMS},10,0.1,0.02,0.3,0.3,1000,:des-epic-signal", _EPIC + typed(f"({_ABOVE}) OR ({_BELOW})", "(SELECT * FROM z WHERE i > 0)"), source=cents)


@register("style_des_epic_viz", _EPIC + f"SELECT * FROM (SELECT label, event_type, ts, round(x, 6) AS value FROM (SELECT event_type, ts, unnest(['line', 'max', 'min', 'triggered']) AS label, unnest([v, p * 1.3::DOUBLE, p * 0.7::DOUBLE, CASE WHEN ({_ABOVE}) OR ({_BELOW}) THEN 1.0 ELSE 0.0 END]) AS x FROM z WHERE i > 0)) WHERE value IS NOT NULL")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compiler.evaluate(spark, cents(spark, sf_dir), f"{SUMS},10,0.1,0.02,0.3,0.3,1000,:des-epic-viz", E0, E1)
    return rounded(out.select("label", F.col("tags")["event_type"].alias("event_type"), "ts", "value"))


# --- older names of statistics ---

for _stat, _agg in (("min", "min(v)"), ("max", "max(v)"), ("avg", "avg(v)")):
    add(f"stat_{_stat}_mf", f"{SUMS},:stat-{_stat}-mf", by_type() + typed(f"{_agg} {_OVER}"))

# --- finer step, limits ---

add("data_finer_step", SUMS, f"WITH e AS ({event_rows()}), a AS (SELECT event_type, b, sum(value) AS v FROM e GROUP BY ALL) SELECT event_type, b - k * {HOUR // 4} AS ts, round(v, 6) AS value FROM a, (SELECT unnest(range(4)) AS k) WHERE b - k * {HOUR // 4} >= {E0} UNION ALL SELECT event_type, {E1} - {HOUR} + k * {HOUR // 4}, round(v, 6) FROM (SELECT event_type, sum(value) AS v FROM ({event_rows(start=E1, end=E1 + HOUR)}) GROUP BY event_type), (SELECT unnest(range(1, 4)) AS k)", step=HOUR // 4)


@register("data_limits", by_type() + typed("v", "a"))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = compiler.Limits(lines=10_000_000, datapoints=1_000_000_000)
    out = compiler.evaluate(spark, events(spark, sf_dir), SUMS, E0, E1, limits=limits)
    return rounded(out.select(F.col("tags")["event_type"].alias("event_type"), "ts", "value"))


@register("query_matches_any", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'click') > 0 AND count(*) FILTER (event_type > 'login') > 0")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by the set of their event types: each comparison holds if any of the types does."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.collect_set("event_type").alias("types"), F.count("*").alias("n"))
    query = words.parse_query("event_type,click,:eq,event_type,login,:gt,:and")
    return df.where(columns.matches_any(query, {"event_type": F.col("types")}.get)).select("user_id", "n")


@register("query_could_match", "SELECT * FROM (VALUES ('click', true), ('login', false), ('view', true)) AS t(event_type, possible)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which partitions of a table by event type a query may touch."""
    query = words.parse_query("event_type,login,:eq,:not,user_id,5,:eq,:and")
    return spark.createDataFrame([(t, columns.could_match(query, {"event_type": t})) for t in ("click", "login", "view")], "event_type string, possible boolean")


# --- presentation ---


def _labelled(spark: SparkSession, sf_dir: str, program: str) -> DataFrame:
    return compiler.evaluate(spark, events(spark, sf_dir), program, E0, E1).select("expr", "label", "ts", F.round("value", 6).alias("value"))


def style(name: str, program: str, sql: str) -> None:
    QUERIES[f"style_{name}"] = lambda spark, sf_dir: _labelled(spark, sf_dir, program)
    ORACLE_SQL[f"style_{name}"] = sql


_LINE = "SELECT 0 AS expr, {} AS label, ts, round(v, 6) AS value FROM a"
style("head", f"{SUMS},$event_type,:legend,2,:head", by_type() + _LINE.format("event_type") + " WHERE event_type IN (SELECT DISTINCT event_type FROM a ORDER BY event_type LIMIT 2)")
style("decode", f"{SUMS},t_3d$event_type,:legend,hex,:decode", by_type() + _LINE.format("'t=' || event_type"))
style("search_replace", f"{SUMS},$event_type,:legend,^(.)(.*)$,$2-$1,:s", by_type() + _LINE.format("substr(event_type, 2) || '-' || substr(event_type, 1, 1)"))
style("strip", f"{SUMS},x,:legend,:strip-style,$event_type,:legend", by_type() + _LINE.format("event_type"))
style("passthrough", f"{SUMS},$event_type,:legend,2,:mul", by_type() + "SELECT 0 AS expr, event_type AS label, ts, round(v * 2, 6) AS value FROM a")
style("offsets", f"{SUMS},$event_type,:legend,(,0h,1d,),:offset", by_type() + _LINE.format("event_type") + f" UNION ALL SELECT 1, event_type, b + {DAY}, round(sum(value), 6) FROM ({event_rows(start=E0 - DAY, end=E1 - DAY)}) GROUP BY event_type, b")
style("stack_order", f"{SUMS},a $event_type,:legend,name,events,:eq,:max,all,:legend", by_type() + _LINE.format("'a ' || event_type") + f" UNION ALL SELECT 1, 'all', b, round(max(value), 6) FROM ({event_rows()}) GROUP BY b")


@register("style_line_order", by_type() + "SELECT DISTINCT event_type AS label, dense_rank() OVER (ORDER BY t DESC, event_type)::INTEGER AS rank FROM (SELECT event_type, sum(round(v, 6)) AS t FROM a GROUP BY event_type)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presentation.line_order(_labelled(spark, sf_dir, f"{SUMS},$event_type,:legend"), "total", "desc").select("label", "rank").distinct()


_SETTINGS = {"alpha": ("40", "40,:alpha"), "color": ("f00", "f00,:color"), "palette": ("reds", "reds,:palette"), "lw": ("2", "2,:lw"), "axis": ("1", "1,:axis"), "sort": ("max", "max,:sort"), "order": ("desc", "desc,:order"), "limit": ("3", "3,:limit")}


@register("style_settings", "SELECT * FROM (VALUES " + ", ".join([f"('{k}', '{v}')" for k, (v, _) in _SETTINGS.items()] + [f"('{x}', '{x}')" for x in ("area", "line", "stack", "heatmap", "vspan")] + ["('ls', 'area')"]) + ") AS t(word, setting)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each presentation word leaves in a style."""
    rows = [(k, words.parse(f"{SUMS},{program}")[0].get(k)) for k, (_, program) in _SETTINGS.items()]
    rows += [(x, words.parse(f"{SUMS},:{x}")[0].get("ls")) for x in ("area", "line", "stack", "heatmap", "vspan")]
    return spark.createDataFrame([*rows, ("ls", words.parse(f"{SUMS},area,:ls")[0].get("ls"))], "word string, setting string")


@register("service_normalize", f"SELECT '{SUMS},86400s,:offset' AS program")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program in its normal form, which parses to the same expression."""
    return spark.createDataFrame([(str(words.parse(f"{SUMS},P1D,:offset")[0]),)], "program string")


@register("service_auto_step", f"SELECT {HOUR} * 2 AS step")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(dates.auto_step(HOUR, E0, E0 + 1400 * HOUR, 700),)], "step long")


# --- validation ---

_P = "SELECT p_partkey, {} AS failed FROM part"


def rule(name: str, make, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/part.parquet")
        tags = F.create_map(F.lit("name"), F.col("p_name"), F.lit("p.type"), F.col("p_type"))
        return validate.validated(df.select("p_partkey", tags.alias("tags")), make()).select("p_partkey", "failed")

    QUERIES[f"validate_{name}"] = run
    ORACLE_SQL[f"validate_{name}"] = _P.format(sql)


rule("value_length", lambda: [validate.value_length(1, 12)], "CASE WHEN length(p_name) > 12 OR length(p_type) > 12 THEN 'value-length' END")
rule("key_pattern", lambda: [validate.key_pattern("[a-z]+")], "'key-pattern'")
rule("value_pattern", lambda: [validate.value_pattern("[AEIOU]")], "CASE WHEN NOT (regexp_matches(p_name, '[AEIOU]') AND regexp_matches(p_type, '[AEIOU]')) THEN 'value-pattern' END")
rule("composite", lambda: [validate.composite(validate.has_key("name"), validate.value_length(1, 20))], "CASE WHEN length(p_name) > 20 OR length(p_type) > 20 THEN 'composite' END")


@register("validate_age", f"SELECT event_id FROM events WHERE abs(epoch_us(ts) // 1000 - {E0 + 10 * DAY}) <= {2 * DAY}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return df.where(validate.age_check(series.millis(df, "ts"), E0 + 10 * DAY, 2 * DAY)).select("event_id")


# --- published payloads: events are encoded as clients would and read back ---

_BACK = f"SELECT event_type, u, b AS ts, round(sum(value), 6) AS value FROM ({event_rows()}) GROUP BY ALL"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tags, timestamp, value), one for each user, type and hour."""
    s = events(spark, sf_dir)
    rows = s.df.where(s.in_range(E0 - HOUR, E1 - HOUR)).groupBy("event_type", F.col("user_id").cast("string").alias("u"), normalize.step_end(s.ts, HOUR).alias("timestamp")).agg(F.sum("value").alias("value"))
    return rows.select(F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("u"), F.col("u")).alias("tags"), "timestamp", "value")


def _flat(points: DataFrame) -> DataFrame:
    return rounded(points.select(F.col("tags")["event_type"].alias("event_type"), F.col("tags")["u"].alias("u"), "ts", "value"))


@register("publish_batch", _BACK)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch for each type and hour with the type as a common tag; a metric's own tags join it."""
    own = F.struct(F.map_filter("tags", lambda k, v: k == "u").alias("tags"), "timestamp", "value")
    batches = _points(spark, sf_dir).groupBy(F.col("tags")["event_type"].alias("t"), "timestamp").agg(F.collect_list(own).alias("metrics"))
    return _flat(readers.decode_batches(batches.select(F.to_json(F.struct(F.create_map(F.lit("event_type"), F.col("t")).alias("tags"), "metrics")).alias("payload")), "payload"))


@register("publish_list", _BACK)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = _points(spark, sf_dir).groupBy("timestamp").agg(F.to_json(F.collect_list(F.struct("tags", "timestamp", "value"))).alias("payload"))
    return _flat(readers.decode_lists(lists, "payload"))


@register("publish_compact", _BACK)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String-table payloads, one for each hour and 10,000 points of it, encoded and decoded on the executors."""
    return _flat(readers.decode_compact(readers.compact_payloads(_points(spark, sf_dir)), "payload"))


# --- time grouping ---


@register("stream_time_grouped", f"SELECT event_type, (epoch_us(ts) // 1000) // {HOUR} * {HOUR} AS ts, round(sum(value), 6) AS value, count(*) AS samples FROM events GROUP BY event_type, 2")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet").withColumnRenamed("ts", "time")
    return rounded(evaluator.time_grouped(df, HOUR, "sum", ("event_type",)))


@register("stream_replicas", f"SELECT event_type, ts, round(sum(m), 6) AS value, sum(n)::BIGINT AS samples FROM (SELECT event_type, user_id, (epoch_us(ts) // 1000) // {HOUR} * {HOUR} AS ts, max(value) AS m, count(*) AS n FROM events GROUP BY event_type, user_id, 3) GROUP BY event_type, ts")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of a datapoint by replica key count once, with their maximum."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet").withColumnRenamed("ts", "time")
    return rounded(evaluator.time_grouped(df, HOUR, "sum", ("event_type",), replica="user_id"))


@register("stream_final_eval", f"WITH e AS (SELECT ((epoch_us(ts) // 1000) // {HOUR} + 1) * {HOUR} AS b, * FROM events), p AS (SELECT event_type, b, sum(value) FILTER (value >= 0) / 3600.0 AS s, count(value) / 3600.0 AS c FROM e GROUP BY ALL) SELECT 'a' AS id, event_type, b AS ts, round(s / c, 6) AS value FROM p WHERE b >= {E0} AND b < {E1}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program evaluated on the partial aggregates of its leaves."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    programs = {"a": "event_type,:has,:sum,(,event_type,),:by,event_type,:has,:count,(,event_type,),:by,:div"}
    out = evaluator.final_eval(evaluator.partial_aggregates(df, programs, HOUR), programs, HOUR, E0, E1)
    return rounded(out.where(F.col("value").isNotNull()).select("id", F.col("tags")["event_type"].alias("event_type"), "ts", "value"))


# --- sinks ---


@register("sink_series_json", by_type() + "SELECT event_type AS label, count(v) AS n, round(sum(v), 6) AS total FROM a GROUP BY event_type")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document for each line with its value on every boundary, read back."""
    docs = sinks.series_json(compiler.evaluate(spark, events(spark, sf_dir), f"{SUMS},$event_type,:legend", E0, E1), E0, HOUR, E1)
    back = docs.select(F.from_json("json", "label string, start bigint, step bigint, values array<double>").alias("d")).where((F.col("d.start") == E0) & (F.size("d.values") == (E1 - E0) // HOUR))
    known = F.filter("d.values", lambda v: v.isNotNull())
    return back.select("d.label", F.size(known).cast("long").alias("n"), F.round(F.aggregate(known, F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@register("sink_fetch_messages", by_type() + 'SELECT "order", count(*) AS n FROM (SELECT 0 AS "order" UNION ALL SELECT 1 FROM (SELECT DISTINCT event_type FROM a) UNION ALL SELECT 2) GROUP BY "order"')
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compiler.evaluate(spark, events(spark, sf_dir), f"{SUMS},$event_type,:legend", E0, E1)
    return sinks.fetch_messages(out, E0, HOUR, E1).groupBy("order").agg(F.count("*").alias("n"))


@register("sink_shards", "SELECT count(DISTINCT (event_type, user_id)) AS series, count(*) AS points, 0::BIGINT AS split FROM events")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points dealt out by series: every series is in one shard."""
    s = events(spark, sf_dir)
    dealt = sinks.sharded(s.df.select(s.tags_column().alias("tags"), "value"), 16)
    per = dealt.groupBy(F.to_json("tags").alias("id")).agg(F.count("*").alias("n"), F.count_distinct("shard").alias("k"))
    return per.agg(F.count("*").alias("series"), F.sum("n").alias("points"), F.count(F.when(F.col("k") > 1, 1)).alias("split"))

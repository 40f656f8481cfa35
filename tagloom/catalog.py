"""Registered queries over the driver's tables with their DuckDB twins.

Tables become series as follows: `events` has tags name, event_type and user_id at a
primary step of one hour; `lineitem` has tags name, returnflag and linestatus at one
day. Values are rounded to six digits on both sides, as sums of doubles depend on order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import buckets
from tagloom.operators import normalize, validate
from tagloom.plans import compiler
from tagloom.sources import metadata, series, sinks
from tagloom.streaming import evaluator

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

HOUR, DAY = 3_600_000, 86_400_000
#: 2024-01-01 to 2024-02-01 for events; 1995-01-01 to 2002-01-01 for line items.
E0, E1 = 1_704_067_200_000, 1_706_745_600_000
L0, L1 = 788_918_400_000, 1_009_843_200_000


def events(spark: SparkSession, sf_dir: str) -> series.Source:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    tags = {"name": F.lit("events"), "event_type": F.col("event_type"), "user_id": F.col("user_id").cast("string")}
    return series.flat(df, "ts", F.col("value"), tags, HOUR)


def cents(spark: SparkSession, sf_dir: str) -> series.Source:
    """Events in whole hundredths, whose sums don't depend on order: for queries whose rounding or cells would."""
    s = events(spark, sf_dir)
    s.value = F.round(F.col("value") * 100)
    return s


def gauges(spark: SparkSession, sf_dir: str) -> series.Source:
    s = events(spark, sf_dir)
    s.tags |= {"dstype": F.lit("gauge")}
    return s


def latencies(spark: SparkSession, sf_dir: str) -> series.Source:
    """Each event as one count in the percentile bucket of its value."""
    s = events(spark, sf_dir)
    s.tags |= {"percentile": buckets.tag_column(F.col("value"))}
    s.value = F.lit(1.0) * 1000 / HOUR
    return s


def registers(spark: SparkSession, sf_dir: str) -> series.Source:
    """Each event as a register of a distinct-count sketch of its user."""
    s = events(spark, sf_dir)
    number = F.col("user_id") % 64
    s.tags |= {"statistic": F.lit("distinct"), "distinct": F.concat(F.lit("R"), F.lpad(F.hex(number), 2, "0"))}
    s.value = (F.floor(F.col("user_id") / 64) % 20 + 1).cast("double")
    return s


def statistics(spark: SparkSession, sf_dir: str) -> series.Source:
    """Orders as distribution summaries: one line for each statistic of the price in thousands."""
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    v = F.col("o_totalprice") / 1000
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("statistic"), x.alias("x")) for k, x in (("count", F.lit(1.0)), ("totalAmount", v), ("totalOfSquares", v * v), ("max", v))]))
    df = df.select("o_orderdate", "o_orderstatus", each.alias("_s"))
    return series.flat(df, "o_orderdate", F.col("_s.x"), {"name": F.lit("price"), "status": F.col("o_orderstatus"), "statistic": F.col("_s.statistic")}, 30 * DAY)


def items(spark: SparkSession, sf_dir: str) -> series.Source:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    tags = {"name": F.lit("quantity"), "returnflag": F.col("l_returnflag"), "linestatus": F.col("l_linestatus")}
    return series.flat(df, "l_shipdate", F.col("l_quantity"), tags, DAY)


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.round("value", 6))


def add(name: str, program: str, sql: str, source: Callable = events, step: int = HOUR, start: int = E0, end: int = E1, dense: bool = False) -> None:
    """Register a program whose lines come as flat columns, and SQL that gives the same rows."""
    QUERIES[name] = lambda spark, sf_dir: rounded(compiler.lines(spark, source(spark, sf_dir), program, start, end, step, dense))
    ORACLE_SQL[name] = sql


def register(name: str, sql: str | None = None):
    def put(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return put


# --- SQL building blocks ---


def event_rows(step: int = HOUR, where: str = "true", start: int = E0, end: int = E1) -> str:
    """Events with the end of their interval."""
    return f"SELECT *, CAST(ceil((epoch_us(ts) // 1000) / {step}.0) AS BIGINT) * {step} AS b, CAST(user_id AS VARCHAR) AS u FROM events WHERE (epoch_us(ts) // 1000) > {start - step} AND (epoch_us(ts) // 1000) <= {end - step} AND ({where})"


def ctes(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


def by_type(agg: str = "sum(value)", step: int = HOUR, where: str = "true") -> str:
    """a(event_type, ts, v) sparse and d(event_type, ts, v) on every grid point."""
    return ctes(
        f"e AS ({event_rows(step, where)})",
        f"a AS (SELECT event_type, b AS ts, {agg} AS v FROM e GROUP BY event_type, b)",
        f"g AS (SELECT unnest(range({E0}, {E1}, {step})) AS ts)",
        "d AS (SELECT k.event_type, g.ts, a.v FROM (SELECT DISTINCT event_type FROM a) k CROSS JOIN g LEFT JOIN a ON a.event_type = k.event_type AND a.ts = g.ts)",
    )


def typed(expr: str, table: str = "d") -> str:
    return f"SELECT * FROM (SELECT event_type, ts, round(CAST({expr} AS DOUBLE), 6) AS value FROM {table}) WHERE value IS NOT NULL"


SUMS = "name,events,:eq,:sum,(,event_type,),:by"
COUNTS = "name,events,:eq,:count,(,event_type,),:by"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per hour and type."""
    return rounded(compiler.lines(spark, events(spark, sf_dir), SUMS, E0, E1))


# --- predicates ---

for _name, _program, _where in (
    ("true", ":true", "true"),
    ("false", ":false", "false"),
    ("has", "event_type,:has", "event_type IS NOT NULL"),
    ("has_missing", "nokey,:has", "false"),
    ("eq", "event_type,click,:eq", "event_type = 'click'"),
    ("lt", "event_type,login,:lt", "event_type < 'login'"),
    ("le", "event_type,login,:le", "event_type <= 'login'"),
    ("gt", "user_id,5,:gt", "u > '5'"),
    ("ge", "user_id,5,:ge", "u >= '5'"),
    ("re", "user_id,1[0-4],:re", "regexp_matches(u, '^1[0-4]')"),
    ("reic", "event_type,C.*K,:reic", "regexp_matches(lower(event_type), '^c.*k')"),
    ("contains", "event_type,o,:contains", "contains(event_type, 'o')"),
    ("starts", "event_type,p,:starts", "starts_with(event_type, 'p')"),
    ("ends", "event_type,k,:ends", "ends_with(event_type, 'k')"),
    ("in", "user_id,(,1,2,3,44,),:in", "u IN ('1', '2', '3', '44')"),
    ("and", "event_type,click,:eq,user_id,2,:starts,:and", "event_type = 'click' AND starts_with(u, '2')"),
    ("or", "event_type,click,:eq,user_id,2,:starts,:or", "event_type = 'click' OR starts_with(u, '2')"),
    ("not", "event_type,click,:eq,:not", "event_type <> 'click'"),
    ("not_missing", "nokey,x,:eq,:not", "true"),
):
    add(f"query_{_name}", f"{_program},:count", f"WITH e AS ({event_rows(DAY, _where.replace('u >', 'CAST(user_id AS VARCHAR) >').replace('u IN', 'CAST(user_id AS VARCHAR) IN').replace('(u,', '(CAST(user_id AS VARCHAR),'))}) SELECT b AS ts, round(sum(n) / 24.0, 6) AS value FROM (SELECT b, event_type, user_id, count(DISTINCT ceil((epoch_us(ts) // 1000) / {HOUR}.0)) AS n FROM e WHERE value IS NOT NULL GROUP BY ALL) GROUP BY b", step=DAY)
add("query_cq", f"{SUMS},user_id,1,:starts,:cq", by_type(where="starts_with(CAST(user_id AS VARCHAR), '1')") + typed("v", "a"))

# --- data aggregates ---

#: :count is the number of series, here users by type, that have a value.
LINES = "count(DISTINCT user_id) FILTER (value IS NOT NULL)"
for _fn, _agg, _all in (("sum", "sum(value)", "sum(value)"), ("count", LINES, LINES.replace("user_id", "(event_type, user_id)")), ("min", "min(value)", "min(value)"), ("max", "max(value)", "max(value)")):
    add(f"data_{_fn}", f"name,events,:eq,:{_fn}", f"WITH e AS ({event_rows()}) SELECT b AS ts, round(CAST({_all} AS DOUBLE), 6) AS value FROM e GROUP BY b")
    add(f"data_{_fn}_by", f"name,events,:eq,:{_fn},(,event_type,),:by", by_type(_agg) + typed("v", "a"))
add("data_by_two_keys", "name,events,:eq,:sum,(,event_type,user_id,),:by", f"WITH e AS ({event_rows(DAY)}) SELECT event_type, u AS user_id, b AS ts, round(sum(value) / 24, 6) AS value FROM e GROUP BY ALL", step=DAY)
add("data_by_missing_key", "name,events,:eq,:sum,(,nokey,),:by", "SELECT CAST(NULL AS VARCHAR) AS nokey, CAST(0 AS BIGINT) AS ts, CAST(0 AS DOUBLE) AS value WHERE false")
add("data_no_match_is_one_line", "name,none,:eq,:sum,1,:gt", f"SELECT unnest(range({E0}, {E1}, {HOUR})) AS ts, 0.0::DOUBLE AS value", dense=True)
add("data_offset", f"{SUMS},1d,:offset", f"WITH e AS ({event_rows(start=E0 - DAY, end=E1 - DAY)}) SELECT event_type, b + {DAY} AS ts, round(sum(value), 6) AS value FROM e GROUP BY ALL")


@register("data_all", f"WITH e AS ({event_rows()}) SELECT '{{\"event_type\":\"' || event_type || '\",\"name\":\"events\",\"user_id\":\"' || u || '\"}}' AS tags, b AS ts, round(sum(value), 6) AS value FROM e GROUP BY ALL")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compiler.evaluate(spark, events(spark, sf_dir), "name,events,:eq,:all", E0, E1)
    return out.select(F.to_json("tags").alias("tags"), "ts", F.round("value", 6).alias("value"))


# --- consolidation: six hours from one ---

_SIX = 6 * HOUR
for _cf, _sql in (("avg", "sum(s) / 6"), ("sum", "sum(s)"), ("min", "sum(lo)"), ("max", "sum(hi)")):
    add(f"cf_{_cf}", f"{SUMS},:cf-{_cf}", f"WITH e AS ({event_rows(_SIX)}), p AS (SELECT event_type, u, b, sum(value) AS s, min(value) AS lo, max(value) AS hi FROM e GROUP BY ALL) SELECT event_type, b AS ts, round({_sql}, 6) AS value FROM p GROUP BY ALL", step=_SIX)
add("cf_max_of_avg", "name,events,:eq,:max,(,event_type,),:by,:cf-avg", f"WITH e AS ({event_rows(_SIX)}), p AS (SELECT event_type, u, b, sum(value) / 6 AS s FROM e GROUP BY ALL) SELECT event_type, b AS ts, round(max(s), 6) AS value FROM p GROUP BY ALL", step=_SIX)
add("cf_gauge", SUMS, f"WITH e AS (SELECT *, CAST(ceil((epoch_us(ts) // 1000) / {HOUR}.0) AS BIGINT) AS p FROM ({event_rows(_SIX)})) SELECT event_type, b AS ts, round(sum(value) / count(DISTINCT p), 6) AS value FROM e GROUP BY ALL", source=gauges, step=_SIX)
add("consolidate", f"{SUMS},max,6h,:consolidate", by_type() + typed(f"max(v) OVER (PARTITION BY event_type, ceil(ts / {_SIX}.0))"))

# --- unary, clamps, generated lines ---

for _op, _sql in (("abs", "abs(v)"), ("neg", "-v"), ("sin", "sin(v)"), ("sqrt", "sqrt(v)"), ("per-step", "v * 3600")):
    add(f"math_{_op.replace('-', '_')}", f"{SUMS},:{_op}", by_type() + typed(_sql, "a"))
add("math_sqrt_of_negative", f"{SUMS},:neg,:sqrt", by_type() + typed("CASE WHEN v <= 0 THEN sqrt(-v) END", "(SELECT event_type, ts, v FROM a WHERE v <= 0)"))
add("math_clamp_min", f"{SUMS},100,:clamp-min", by_type() + typed("CASE WHEN v < 100 THEN 100 ELSE v END", "a"))
add("math_clamp_max", f"{SUMS},100,:clamp-max", by_type() + typed("CASE WHEN v > 100 THEN 100 ELSE v END", "a"))
add("math_cos", f"{SUMS},:cos", by_type() + typed("sin(pi() / 2 - coalesce(v, 0))"))
for _op, _sql in (("tan", "CASE WHEN c <> 0 THEN s / c END"), ("cot", "CASE WHEN s <> 0 THEN c / s END"), ("sec", "CASE WHEN c <> 0 THEN 1 / c END"), ("csc", "CASE WHEN s <> 0 THEN 1 / s END")):
    _src = "d" if _op == "sec" else "a"
    add(f"math_{_op}", f"name,events,:eq,:count,(,event_type,),:by,:{_op}", by_type(LINES) + f"SELECT event_type, ts, round({_sql}, 6) AS value FROM (SELECT event_type, ts, sin(v) AS s, sin(pi() / 2 - coalesce(v, 0)) AS c FROM {_src}) WHERE ({_sql}) IS NOT NULL")
_GRID = f"SELECT ts, round(CAST({{}} AS DOUBLE), 6) AS value FROM (SELECT unnest(range({E0}, {E1}, {HOUR})) AS ts)"
add("math_const", "42", _GRID.format("42"))
add("math_pi", ":pi", _GRID.format("pi()"))
add("math_constant_folding", "1,2,:add,3,:mul", _GRID.format("9"))
add("math_time_hour", "hourOfDay,:time", _GRID.format(f"(ts // {HOUR}) % 24"))
add("math_time_weekday", "dayOfWeek,:time", _GRID.format("isodow(epoch_ms(ts))"))
add("math_time_dayofyear", "dayOfYear,:time", _GRID.format("dayofyear(epoch_ms(ts))"))
add("math_time_days", "days,:time", _GRID.format(f"ts / {DAY}.0"))
add("math_time_span", "2024-01-05,2024-01-07,:time-span", _GRID.format(f"CASE WHEN ts BETWEEN {E0 + 4 * DAY} AND {E0 + 6 * DAY} THEN 1 ELSE 0 END"))


def _random_sql(seed: int) -> str:
    step = lambda inner, shift, by: f"(SELECT ts, ((x & 65535) * {by} + ((((x >> 16) * {by}) & 65535) << 16)) & 4294967295 AS x FROM (SELECT ts, xor(x, x >> {shift}) AS x FROM {inner}))"
    first = f"(SELECT ts, xor(xor(ts, {seed}), xor(ts, {seed}) >> 32) & 4294967295 AS x FROM (SELECT unnest(range({E0}, {E1}, {HOUR})) AS ts))"
    return f"SELECT ts, round((xor(x, x >> 16) % 1000) / 1000.0, 6)::DOUBLE AS value FROM {step(step(first, 16, 0x7FEB352D), 15, 0x846CA68B)}"


add("math_random", ":random", _random_sql(0))
add("math_srandom", "7,:srandom", _random_sql(7))
add("math_as", f"{SUMS},event_type,kind,:as", by_type() + "SELECT event_type AS kind, ts, round(v, 6) AS value FROM a")

# --- binary math: one scan for both sides, a join, a broadcast line, a constant ---

_PAIR = ctes(f"e AS ({event_rows()})", "a AS (SELECT event_type, b AS ts, sum(value) FILTER (user_id % 2 = 0) AS x, sum(value) FILTER (user_id % 3 = 0) AS y FROM e GROUP BY ALL)", f"g AS (SELECT unnest(range({E0}, {E1}, {HOUR})) AS ts)", "k AS (SELECT event_type FROM a GROUP BY event_type HAVING count(x) > 0 AND count(y) > 0)", "d AS (SELECT k.event_type, g.ts, a.x, a.y FROM k CROSS JOIN g LEFT JOIN a ON a.event_type = k.event_type AND a.ts = g.ts)")


def pairs(spark: SparkSession, sf_dir: str) -> series.Source:
    s = events(spark, sf_dir)
    s.tags |= {"even": F.when(F.col("user_id") % 2 == 0, "yes"), "third": F.when(F.col("user_id") % 3 == 0, "yes")}
    return s


_LEFT, _RIGHT = "even,yes,:eq,:sum,(,event_type,),:by", "third,yes,:eq,:sum,(,event_type,),:by"
_T = "coalesce(abs({}) >= 1e-12, false)"
for _op, _sql in {
    "add": "coalesce(x + y, x, y)",
    "sub": "coalesce(x - y, x, -y)",
    "mul": "x * y",
    "div": "CASE WHEN y = 0 THEN CASE WHEN x = 0 THEN 0.0 END ELSE x / y END",
    "gt": "coalesce(CAST(x > y AS DOUBLE), 0)",
    "ge": "coalesce(CAST(x >= y AS DOUBLE), 0)",
    "lt": "coalesce(CAST(x < y AS DOUBLE), 0)",
    "le": "coalesce(CAST(x <= y AS DOUBLE), 0)",
    "fadd": "x + y",
    "fsub": "x - y",
    "fmul": "x * y",
    "fdiv": "CASE WHEN y = 0 THEN CASE WHEN x > 0 THEN 'inf'::DOUBLE WHEN x < 0 THEN '-inf'::DOUBLE END ELSE x / y END",
    "and": f"CAST({_T.format('x')} AND {_T.format('y')} AS DOUBLE)",
    "or": f"CAST({_T.format('x')} OR {_T.format('y')} AS DOUBLE)",
}.items():
    add(f"binary_{_op}", f"{_LEFT},{_RIGHT},:{_op}", _PAIR + typed(_sql), source=pairs)
add("binary_pow", f"{COUNTS},2,:pow", by_type(LINES) + typed("power(v, 2)", "a"))
add("binary_same_scan", f"{SUMS},{COUNTS},:div", by_type(f"sum(value) / {LINES}") + typed("v", "a"))
add("binary_with_total", f"{SUMS},name,events,:eq,:sum,:div", by_type() + typed("v / t", "(SELECT event_type, ts, v, sum(v) OVER (PARTITION BY ts) AS t FROM a)"))
add("binary_with_constant", f"{SUMS},5,:add", by_type() + typed("coalesce(v, 0) + 5"))
add("binary_subset_keys", f"name,events,:eq,:sum,(,event_type,user_id,),:by,{SUMS},:div", f"WITH e AS ({event_rows(DAY)}), p AS (SELECT event_type, u, b, sum(round(value * 100)) AS v FROM e GROUP BY ALL) SELECT event_type, u AS user_id, b AS ts, round(v / 24 / (sum(v) OVER (PARTITION BY event_type, b) / 24), 6) AS value FROM p", source=cents, step=DAY)

# --- second level ---

for _fn in ("sum", "count", "min", "max"):
    add(f"over_{_fn}", f"{SUMS},:{_fn}", by_type() + f"SELECT ts, round(CAST({_fn}(v) AS DOUBLE), 6) AS value FROM a GROUP BY ts")
add("over_by", "name,events,:eq,:sum,(,event_type,user_id,),:by,:max,(,event_type,),:by", f"WITH e AS ({event_rows()}), p AS (SELECT event_type, u, b, sum(value) AS v FROM e GROUP BY ALL) SELECT event_type, b AS ts, round(max(v), 6) AS value FROM p GROUP BY ALL")
add("over_cg", "name,events,:eq,:sum,(,event_type,),:cg", by_type() + typed("v", "a"))
add("named_avg", "name,events,:eq,:avg,(,event_type,),:by", by_type(f"sum(value) / {LINES}") + typed("v", "a"))
add("named_stddev", f"{SUMS},:stddev", by_type() + "SELECT ts, round(sqrt((count(v) * sum(v * v) - sum(v) * sum(v)) / (count(v) * count(v))), 6) AS value FROM a GROUP BY ts HAVING (count(v) * sum(v * v) - sum(v) * sum(v)) >= 0")
add("named_pct", f"{SUMS},:pct", by_type() + typed("v / sum(v) OVER (PARTITION BY ts) * 100", "a"))
_STATS = ctes(f"o AS (SELECT o_orderstatus AS status, CAST(ceil((epoch_us(o_orderdate) // 1000) / {30 * DAY}.0) AS BIGINT) * {30 * DAY} AS ts, o_totalprice / 1000 AS v FROM orders)", f"r AS (SELECT * FROM o WHERE ts >= {-(-L0 // (30 * DAY)) * 30 * DAY} AND ts < {-(-L1 // (30 * DAY)) * 30 * DAY})")
for _word, _sql in (("dist-avg", "sum(v) / count(*)"), ("dist-max", "max(v)"), ("dist-stddev", "sqrt((count(*) * sum(v * v) - sum(v) * sum(v)) / (count(*) * count(*)))")):
    add(f"named_{_word.replace('-', '_')}", f"name,price,:eq,:{_word},(,status,),:by", _STATS + f"SELECT status, ts, round({_sql}, 6) AS value FROM r GROUP BY ALL" + (" HAVING count(*) * sum(v * v) - sum(v) * sum(v) >= 0" if _word == "dist-stddev" else ""), source=statistics, step=30 * DAY, start=L0, end=L1)

# --- percentiles and distinct counts ---

_BUCKET = "(SELECT min(i) FROM bounds WHERE hi > value)"
_BOUNDS = f"bounds AS (SELECT i, hi, lag(hi, 1, 0.0) OVER (ORDER BY i) AS lo FROM (SELECT unnest(range(0, {buckets.COUNT})) AS i, unnest({buckets.BOUNDS})::DOUBLE AS hi))"
_CELLS = f"c AS (SELECT event_type, b AS ts, {_BUCKET} AS i, count(*)::DOUBLE AS n FROM e GROUP BY ALL), w AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY event_type, ts ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER (PARTITION BY event_type, ts) AS total FROM c)"
add(
    "percentiles",
    "name,events,:eq,:sum,(,event_type,),:by,(,50,90,99.9,),:percentiles",
    ctes(f"e AS ({event_rows(DAY)})", _BOUNDS, _CELLS, "p AS (SELECT unnest([50.0, 90.0, 99.9]) AS q)")
    + "SELECT event_type, ts, percentile, round(value, 6) AS value FROM (SELECT event_type, w.ts, lpad(CAST(q AS DOUBLE)::VARCHAR, 4, ' ') AS percentile, min_by(lo + (hi - lo) * greatest(total * q / 100 - before, 0) / n, w.i) AS value FROM w JOIN bounds USING (i) JOIN p ON before + n >= total * q / 100 - 1e-9 GROUP BY ALL)",
    source=latencies,
    step=DAY,
)
add("median", "name,events,:eq,:median", ctes(f"e AS ({event_rows(DAY)})", _BOUNDS, _CELLS.replace("event_type, b", "b").replace("PARTITION BY event_type, ts", "PARTITION BY ts")) + "SELECT ts, '50.0' AS percentile, round(min_by(lo + (hi - lo) * greatest(total * 0.5 - before, 0) / n, i), 6) AS value FROM w JOIN bounds USING (i) WHERE before + n >= total * 0.5 - 1e-9 GROUP BY ts", source=latencies, step=DAY)
add("sample_count", "name,events,:eq,10,100,:sample-count", f"WITH e AS ({event_rows(DAY, 'value >= 10 AND value < 106')}) SELECT b AS ts, round(count(*) * 1000.0 / {HOUR} / 24, 6) AS value FROM e GROUP BY b", source=latencies, step=DAY)
_REG = ctes(f"e AS ({event_rows()})", "r AS (SELECT event_type, b AS ts, user_id % 64 AS reg, max((user_id // 64) % 20 + 1) AS rho FROM e GROUP BY ALL)")
_HLL = "CASE WHEN 0.709 * 64 * 64 / (z + 64 - n) <= 160 AND 64 - n > 0 THEN 64 * ln(64.0 / (64 - n)) ELSE 0.709 * 64 * 64 / (z + 64 - n) END"
add("approx_distinct", "name,events,:eq,:max,(,event_type,),:by,:approx-distinct", _REG + f"SELECT event_type, ts, round({_HLL}, 6) AS value FROM (SELECT event_type, ts, sum(power(2.0, -rho)) AS z, count(*) AS n FROM r GROUP BY ALL)", source=registers)
add("approx_distinct_cumulative", "name,events,:eq,:max,(,event_type,),:by,:approx-distinct-cumulative", _REG[:-1] + f", g AS (SELECT unnest(range({E0}, {E1}, {HOUR})) AS ts), c AS (SELECT k.event_type, k.reg, g.ts, max(rho) OVER (PARTITION BY k.event_type, k.reg ORDER BY g.ts) AS m FROM (SELECT DISTINCT event_type, reg FROM r) k CROSS JOIN g LEFT JOIN r ON r.event_type = k.event_type AND r.reg = k.reg AND r.ts = g.ts) SELECT event_type, ts, round({_HLL}, 6) AS value FROM (SELECT event_type, ts, sum(power(2.0, -m)) AS z, count(*) AS n FROM c WHERE m IS NOT NULL GROUP BY ALL)", source=registers)

# --- over time ---

_W = "OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
for _op, _args, _sql in (
    ("rolling-count", "5", f"sum(CASE WHEN coalesce(abs(v) >= 1e-12, false) THEN 1.0 ELSE 0.0 END) {_W.format(4)}"),
    ("rolling-min", "5", f"min(v) {_W.format(4)}"),
    ("rolling-max", "5", f"max(v) {_W.format(4)}"),
    ("rolling-sum", "5", f"sum(v) {_W.format(4)}"),
    ("rolling-mean", "5,2", f"CASE WHEN count(v) {_W.format(4)} >= 2 THEN avg(v) {_W.format(4)} END"),
    ("delay", "3", "lag(v, 3) OVER (PARTITION BY event_type ORDER BY ts)"),
    ("derivative", "", "v - lag(v, 1) OVER (PARTITION BY event_type ORDER BY ts)"),
    ("integral", "", f"sum(v) {_W.format('UNBOUNDED')}"),
    ("cumulative-max", "", f"max(v) {_W.format('UNBOUNDED')}"),
    ("trend", "6h", f"CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY ts) >= 6 AND count(v) {_W.format(5)} > 0 THEN sum(v) {_W.format(5)} / 6 END"),
):
    add(f"stateful_{_op.replace('-', '_')}", f"{SUMS}," + (f"{_args}," if _args else "") + f":{_op}", by_type() + typed(_sql))
# --- whole-window statistics, filters, ranks ---

_OVER = "OVER (PARTITION BY event_type)"
for _stat, _sql in (("avg", f"avg(v) {_OVER}"), ("max", f"max(v) {_OVER}"), ("min", f"min(v) {_OVER}"), ("total", f"sum(v) {_OVER}"), ("count", f"count(v) {_OVER}"), ("last", f"arg_max(v, CASE WHEN v IS NOT NULL THEN ts END) {_OVER}")):
    add(f"stat_{_stat}", f"{SUMS},{_stat},:stat", by_type() + typed(_sql))
_PER_USER = f"WITH e AS ({event_rows()}), a AS (SELECT u AS user_id, b AS ts, sum(value) AS v FROM e GROUP BY ALL), s AS (SELECT user_id, avg(v) AS \"avg\", max(v) AS \"max\", min(v) AS \"min\", sum(v) AS total, count(v) AS \"count\", arg_max(v, ts) AS \"last\" FROM a GROUP BY user_id) "
_USERS = "name,events,:eq,:sum,(,user_id,),:by"
for _stat in ("avg", "max", "min", "total", "count", "last"):
    _program = f"{_USERS},:stat-{_stat}," + {"avg": "60", "max": "400", "min": "5", "total": "3500", "count": "70", "last": "50"}[_stat] + ",:gt,:filter"
    add(f"filter_stat_{_stat}", _program, _PER_USER + f"SELECT user_id, ts, round(v, 6) AS value FROM a WHERE user_id IN (SELECT user_id FROM s WHERE \"{_stat}\" > {_program.split(',')[-3]})")
add("filter_any", f"{_USERS},:dup,300,:gt,:filter", _PER_USER + "SELECT user_id, ts, round(v, 6) AS value FROM a WHERE user_id IN (SELECT user_id FROM a WHERE v > 300)")
for _rank, _dir in (("topk", "DESC"), ("bottomk", "ASC")):
    _kept = f"k AS (SELECT user_id FROM s ORDER BY \"max\" {_dir}, user_id LIMIT 5)"
    add(f"rank_{_rank}", f"{_USERS},max,5,:{_rank}", _PER_USER.rstrip() + f", {_kept} SELECT user_id, ts, round(v, 6) AS value FROM a WHERE user_id IN (SELECT user_id FROM k)")
    for _how in ("min", "max", "sum", "avg"):
        add(f"rank_{_rank}_others_{_how}", f"{_USERS},max,5,:{_rank}-others-{_how}", _PER_USER.rstrip() + f", {_kept} SELECT user_id, ts, round(v, 6) AS value FROM a WHERE user_id IN (SELECT user_id FROM k) UNION ALL SELECT '--others--', ts, round({_how}(v), 6) FROM a WHERE user_id NOT IN (SELECT user_id FROM k) GROUP BY ts")

# --- other tables ---

add("items_by_flag", "name,quantity,:eq,:sum,(,returnflag,linestatus,),:by", f"SELECT l_returnflag AS returnflag, l_linestatus AS linestatus, CAST(ceil((epoch_us(l_shipdate) // 1000) / {DAY}.0) AS BIGINT) * {DAY} AS ts, round(sum(l_quantity), 6) AS value FROM lineitem WHERE (epoch_us(l_shipdate) // 1000) > {L0 - DAY} AND (epoch_us(l_shipdate) // 1000) <= {L1 - DAY} GROUP BY ALL", source=items, step=DAY, start=L0, end=L1)


@register("style_legend_limit", by_type() + "SELECT 'type ' || event_type AS label, ts, round(v, 6) AS value FROM a WHERE event_type IN (SELECT event_type FROM a GROUP BY event_type ORDER BY sum(v) DESC, event_type LIMIT 2)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compiler.evaluate(spark, events(spark, sf_dir), f"{SUMS},type $event_type,:legend,total,:sort,desc,:order,2,:limit", E0, E1)
    return out.select("label", "ts", F.round("value", 6).alias("value"))


# --- metadata ---


@register("meta_keys", "SELECT unnest(['name', 'event_type', 'user_id']) AS key")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.tag_keys(events(spark, sf_dir))


@register("meta_values", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS value FROM events WHERE event_type = 'click' AND CAST(user_id AS VARCHAR) > '2' ORDER BY value LIMIT 20")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.tag_values(events(spark, sf_dir), "user_id", "event_type,click,:eq", offset="2", limit=20)


@register("meta_tags", "WITH s AS (SELECT DISTINCT event_type, CAST(user_id AS VARCHAR) AS u FROM events) SELECT 'event_type' AS key, event_type AS value, count(*) AS series FROM s GROUP BY event_type UNION ALL SELECT 'user_id', u, count(*) FROM s GROUP BY u UNION ALL SELECT 'name', 'events', count(*) FROM s")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.tags(events(spark, sf_dir))


# --- ingest ---


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw samples of one line for each user and type, at most one for each millisecond."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return df.groupBy(F.col("user_id").cast("string").alias("u"), "event_type", series.millis(df, "ts").alias("ts")).agg(F.sum("value").alias("value"))


_RAW = "s AS (SELECT CAST(user_id AS VARCHAR) AS u, event_type, (epoch_us(ts) // 1000) AS ts, sum(value) AS value FROM events GROUP BY ALL)"
_LAG = "w AS (SELECT *, lag(value) OVER (PARTITION BY u, event_type ORDER BY ts) AS pv, lag(ts) OVER (PARTITION BY u, event_type ORDER BY ts) AS pt FROM s)"


@register("ingest_counter_rate", ctes(_RAW, _LAG) + "SELECT u, event_type, ts, round(CASE WHEN value < pv OR ts <= pt THEN 0 ELSE (value - pv) / ((ts - pt) / 1000.0) END, 6) AS value FROM w WHERE pt IS NOT NULL")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(normalize.counter_to_rate(_samples(spark, sf_dir), ["u", "event_type"]))


_BEAT = 2 * DAY


@register(
    "ingest_regrid",
    ctes(
        _RAW,
        _LAG,
        f"f AS (SELECT u, event_type, ts, value, pt IS NULL OR ts - pt > {_BEAT} AS fresh, ts // {DAY} * {DAY} AS fl, CASE WHEN pt IS NULL OR ts - pt > {_BEAT} THEN CASE WHEN ts % {DAY} = 0 THEN ts - {DAY} ELSE ts // {DAY} * {DAY} END ELSE pt END AS f FROM w)",
        "r AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY u, event_type ORDER BY ts) AS run FROM f)",
        "x AS (SELECT *, max(ts) OVER (PARTITION BY u, event_type, run) AS lt FROM r)",
        f"c AS (SELECT *, unnest(range((f // {DAY} + 1) * {DAY}, CAST(ceil(ts / {DAY}.0) AS BIGINT) * {DAY} + 1, {DAY})) AS b FROM x WHERE ts > f)",
    )
    + f"SELECT u, event_type, ts, round(value, 6) AS value FROM (SELECT u, event_type, run, b AS ts, sum(value * (least(ts, b) - greatest(f, b - {DAY})) / {DAY}.0) AS value FROM c WHERE b <= lt GROUP BY ALL UNION ALL SELECT u, event_type, run, fl, value * ({DAY} - (ts - fl)) / {DAY}.0 FROM x WHERE fresh AND ts > fl)",
)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(normalize.regrid(_samples(spark, sf_dir), ["u", "event_type"], DAY, _BEAT))


for _how in ("sum", "max"):
    QUERIES[f"ingest_rolling_{_how}"] = lambda spark, sf_dir, how=_how: rounded(normalize.rolling(_samples(spark, sf_dir), ["u", "event_type"], HOUR, how))
    ORACLE_SQL[f"ingest_rolling_{_how}"] = ctes(_RAW) + f"SELECT u, event_type, CAST(ceil(ts / {HOUR}.0) AS BIGINT) * {HOUR} AS ts, round({_how}(value), 6) AS value FROM s GROUP BY ALL"


@register("ingest_last_write", f"SELECT event_type, CAST(ceil((epoch_us(ts) // 1000) / {HOUR}.0) AS BIGINT) * {HOUR} AS ts, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY ALL")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    df = df.withColumn("ts", series.millis(df, "ts"))
    return rounded(normalize.last_write(df, ["event_type"], HOUR, "event_id"))


@register("ingest_rollup", f"SELECT '{{\"event_type\":\"' || event_type || '\"}}' AS tags, CAST(ceil((epoch_us(ts) // 1000) / {HOUR}.0) AS BIGINT) * {HOUR} AS ts, round(sum(value), 6) AS \"sum\", count(*) AS \"count\", min(value) AS \"min\", max(value) AS \"max\" FROM events GROUP BY ALL")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = events(spark, sf_dir)
    points = s.df.select(s.tags_column().alias("tags"), normalize.step_end(s.ts, HOUR).alias("ts"), "value")
    out = normalize.rollup(points, ["event_type"])
    return out.select(F.to_json("tags").alias("tags"), "ts", F.round("sum", 6).alias("sum"), "count", "min", "max")


@register("ingest_validation", "SELECT p_partkey, CASE WHEN length(p_name) NOT BETWEEN 2 AND 20 THEN 'name-value-length' WHEN NOT regexp_full_match(p_type, '[-._A-Za-z0-9^~]*') OR NOT regexp_full_match(p_brand, '[-._A-Za-z0-9^~]*') OR NOT regexp_full_match(p_name, '[-._A-Za-z0-9^~]*') THEN 'valid-characters' WHEN p_size % 2 = 1 THEN 'reserved-key:sys.' END AS failed FROM part")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/part.parquet")
    tags = F.create_map(F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"))
    tags = F.when(F.col("p_size") % 2 == 1, F.map_concat(tags, F.create_map(F.lit("sys.size"), F.lit("1")))).otherwise(tags)
    rules = [validate.has_key(), validate.key_length(), validate.name_value_length((2, 20)), validate.valid_characters(), validate.max_user_tags(), validate.reserved_key()]
    return validate.validated(df.select("p_partkey", tags.alias("tags")), rules).select("p_partkey", "failed")


# --- events ---


@register("event_raw", "SELECT event_id, event_type FROM events WHERE event_type = 'click'")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluator.event_query(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type,click,:eq").select("event_id", "event_type")


@register("event_table", "SELECT user_id, value FROM events WHERE event_type = 'click'")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluator.event_query(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type,click,:eq,(,user_id,value,),:table")


@register("event_sample", f"SELECT CAST(ceil((epoch_us(ts) // 1000) / {HOUR}.0) AS BIGINT) * {HOUR} AS step_end, event_type, count(*) AS \"count\" FROM events GROUP BY ALL")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    sampled = evaluator.event_query(df, ":true,(,event_type,),(,user_id,value,),:sample", step=HOUR)
    return sampled.where("sample.value IS NOT NULL").select("step_end", "event_type", "count")


@register("event_typed_filter", "SELECT event_id FROM events WHERE value > 40 AND user_id <= 30")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return evaluator.typed_filter(evaluator.typed_filter(df, "value", "gt", 40.0), "user_id", "le", 30).select("event_id")


@register("event_datapoints", f"WITH e AS (SELECT ((epoch_us(ts) // 1000) // {HOUR} + 1) * {HOUR} AS b, * FROM events) SELECT 'event_type,click,:eq,:sum' AS query, '{{}}' AS keys, b AS ts, round(sum(value) FILTER (value >= 0) / 3600, 6) AS value, count(*) AS samples FROM e WHERE event_type = 'click' GROUP BY b UNION ALL SELECT ':true,:count,(,event_type,),:by', '{{\"event_type\":\"' || event_type || '\"}}', b, round(count(*) / 3600.0, 6), count(*) FROM e GROUP BY event_type, b")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rounded(evaluator.partial_aggregates(df, {"a": "event_type,click,:eq,:sum", "b": ":true,:count,(,event_type,),:by"}, HOUR))


# --- sinks ---


@register("sink_statistics", by_type() + "SELECT event_type AS label, count(v) AS \"count\", round(avg(v), 6) AS \"avg\", round(min(v), 6) AS \"min\", round(max(v), 6) AS \"max\", round(arg_max(v, ts), 6) AS \"last\", round(sum(v), 6) AS total FROM a GROUP BY event_type")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sinks.statistics(compiler.evaluate(spark, events(spark, sf_dir), f"{SUMS},$event_type,:legend", E0, E1))
    return out.select("label", "count", *[F.round(c, 6).alias(c) for c in ("avg", "min", "max", "last", "total")])


@register("sink_pivot", by_type() + "SELECT ts, round(max(v) FILTER (event_type = 'click'), 6) AS click, round(max(v) FILTER (event_type = 'view'), 6) AS \"view\" FROM a WHERE event_type IN ('click', 'view') GROUP BY ts")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compiler.evaluate(spark, events(spark, sf_dir), f"{SUMS},event_type,(,click,view,),:in,:cq,$event_type,:legend", E0, E1)
    return sinks.pivoted(out.withColumn("value", F.round("value", 6)), ["click", "view"])


@register("sink_heatmap", by_type("sum(round(value * 100))") + "SELECT ts, CAST(least(floor((v - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS cell, count(*) AS \"count\" FROM a, (SELECT min(v) AS lo, max(v) AS hi FROM a) GROUP BY ALL")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.heatmap(compiler.evaluate(spark, cents(spark, sf_dir), SUMS, E0, E1), None, None, 20)

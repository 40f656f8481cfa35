"""Readers of published datapoints and events, and a generator of synthetic ones."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINT = "tags MAP<STRING,STRING>, timestamp BIGINT, value DOUBLE"
_FIELDS = "tags: MAP<STRING,STRING>, timestamp: BIGINT, value: DOUBLE"
#: Most points of a compact payload, and rows of a decoded one that are held at once.
PAYLOAD_POINTS = 10_000

_BATCH = f"tags MAP<STRING,STRING>, metrics ARRAY<STRUCT<{_FIELDS}>>"


def _batched(raw: DataFrame) -> DataFrame:
    empty = F.expr("map()").cast("map<string,string>")
    each = raw.select(F.coalesce("tags", empty).alias("_common"), F.explode("metrics").alias("m"))
    own = F.coalesce("m.tags", empty)
    merged = F.map_concat(F.map_filter("_common", lambda k, v: ~F.map_contains_key(own, k)), own)
    return each.select(merged.alias("tags"), F.col("m.timestamp").alias("ts"), F.col("m.value").alias("value"))


def publish_batches(spark: SparkSession, path: str) -> DataFrame:
    """JSON batches {tags, metrics: [{tags, timestamp, value}]}: common tags join each metric's, which win."""
    return _batched(spark.read.schema(_BATCH).option("multiLine", True).json(path))


def decode_batches(payloads: DataFrame, column: str) -> DataFrame:
    """publish_batches of a column of payloads."""
    return _batched(payloads.select(F.from_json(column, _BATCH).alias("_b")).select("_b.tags", "_b.metrics"))


def publish_list(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of datapoints."""
    return spark.read.schema(POINT).option("multiLine", True).json(path).select("tags", F.col("timestamp").alias("ts"), "value")


def decode_lists(payloads: DataFrame, column: str) -> DataFrame:
    """publish_list of a column of payloads."""
    return payloads.select(F.explode(F.from_json(column, f"ARRAY<STRUCT<{_FIELDS}>>")).alias("p")).select("p.tags", F.col("p.timestamp").alias("ts"), "p.value")


def compact_batch(spark: SparkSession, path: str) -> DataFrame:
    """Files of one string-table payload each: a flat array of n, n strings, m, then m times (tag count, key and value numbers, timestamp, value)."""
    return decode_compact(spark.read.text(path, wholetext=True), "value")


def _compact_rows(payload: str) -> Iterator[tuple[dict[str, str], int, float | None]]:
    cells = json.loads(payload)
    n = cells[0]
    table, at = cells[1 : 1 + n], 2 + n
    for _ in range(cells[1 + n]):
        k = cells[at]
        tags = {table[cells[at + 1 + 2 * i]]: table[cells[at + 2 + 2 * i]] for i in range(k)}
        at += 1 + 2 * k
        value = cells[at + 1]
        yield tags, int(cells[at]), None if value is None else float(value)
        at += 2


def _point_batch(rows: list[tuple[dict[str, str], int, float | None]]) -> pa.RecordBatch:
    tags = pa.array([list(t.items()) for t, _, _ in rows], pa.map_(pa.string(), pa.string()))
    return pa.RecordBatch.from_arrays([tags, pa.array([ts for _, ts, _ in rows], pa.int64()), pa.array([v for _, _, v in rows], pa.float64())], ["tags", "ts", "value"])


def decode_compact(payloads: DataFrame, column: str) -> DataFrame:
    """compact_batch of a column of payloads, decoded where the rows are: one payload at a time, PAYLOAD_POINTS rows at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0):
                if payload.is_valid:
                    rows = _compact_rows(payload.as_py())
                    while part := list(itertools.islice(rows, PAYLOAD_POINTS)):
                        yield _point_batch(part)

    return payloads.select(column).mapInArrow(run, "tags MAP<STRING,STRING>, ts BIGINT, value DOUBLE")


def _points(batch: pa.RecordBatch) -> Iterator[tuple[dict[str, str], int, float | None]]:
    tags, stamps, values = batch.columns
    at, keys, items = tags.offsets.to_pylist(), tags.keys.to_pylist(), tags.items.to_pylist()
    for i, (ts, value) in enumerate(zip(stamps.to_pylist(), values.to_pylist(), strict=True)):
        yield dict(zip(keys[at[i] : at[i + 1]], items[at[i] : at[i + 1]], strict=True)), ts, value


def compact_payloads(points: DataFrame, size: int = PAYLOAD_POINTS) -> DataFrame:
    """Payloads of points (tags, timestamp, value): one for each timestamp, or for each `size` points of it if it has more.

    Points stream through in the order of their timestamps, so that a worker holds one
    payload however many points a timestamp has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = itertools.chain.from_iterable(map(_points, batches))
        for _, same in itertools.groupby(rows, key=lambda p: p[1]):
            while part := list(itertools.islice(same, size)):
                yield pa.RecordBatch.from_arrays([pa.array([encode_compact(part)], pa.string())], ["payload"])

    dealt = points.select("tags", "timestamp", "value").repartition("timestamp").sortWithinPartitions("timestamp")
    return dealt.mapInArrow(run, "payload STRING")


def encode_compact(rows: list[tuple[dict[str, str], int, float | None]]) -> str:
    """The payload that compact_batch reads."""
    strings = sorted({s for tags, _, _ in rows for kv in tags.items() for s in kv})
    number = {s: i for i, s in enumerate(strings)}
    out: list = [len(strings), *strings, len(rows)]
    for tags, ts, value in rows:
        out.append(len(tags))
        for k, v in sorted(tags.items()):
            out += [number[k], number[v]]
        out += [ts, value]
    return json.dumps(out)


def points_table(spark: SparkSession, path: str) -> DataFrame:
    """Stored datapoints in canonical form, Parquet."""
    return spark.read.parquet(path)


def message_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Captured streams replayed as a streaming DataFrame: JSON lines, new files are new input."""
    return spark.readStream.schema(schema).json(path)


def synthetic(spark: SparkSession, step: int, intervals: int, inputs: int, outputs: int, start: int = 0) -> DataFrame:
    """inputs datapoints of each interval, spread over outputs groups; values are 1."""
    return spark.range(intervals * inputs).select(
        F.create_map(F.lit("name"), F.lit("synthetic"), F.lit("group"), (F.col("id") % inputs % outputs).cast("string"), F.lit("node"), (F.col("id") % inputs).cast("string")).alias("tags"), (F.lit(start) + (F.floor(F.col("id") / inputs) + 1) * step).cast("long").alias("ts"), F.lit(1.0).alias("value")
    )


def constants(spark: SparkSession, step: int, start: int, end: int, count: int = 11) -> DataFrame:
    """Lines named 0, 1, ... whose value is their name, on every boundary of [start, end)."""
    return spark.range(count).select(F.create_map(F.lit("name"), F.col("id").cast("string"), F.lit("type"), F.lit("constant")).alias("tags"), F.explode(F.sequence(F.lit(start), F.lit(end - step), F.lit(step))).alias("ts"), F.col("id").cast("double").alias("value"))

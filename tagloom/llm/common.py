"""Shared plumbing of the corpus operators: scratch tables, Arrow mapping, code shipping."""

from __future__ import annotations

import atexit
import os
import shutil
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows of one Arrow batch; documents may be long, so batches stay far below Spark's default of 10,000 rows.
BATCH_ROWS = 512
#: Bytes of one Arrow batch.
BATCH_BYTES = 8 << 20

_own_dirs: dict[str, str] = {}
_shipped: set[str] = set()
_scratch: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or where it is unset on a local master (tests) an own folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="tagloom-")
    return _own_dirs[app]


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches and make this package importable on the executors."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent.parent
    if not root.is_dir():  # already running from an archive that was shipped
        return
    target = os.path.join(tempfile.mkdtemp(prefix="tagloom-ship-"), f"{root.name}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    spark.sparkContext.addPyFile(target)


class Scratch:
    """Tables in the shared folder that cut lineage; they survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        _scratch.append((spark, self.base))

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.base}/{self.n:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return a DataFrame that reads it; the path is its attribute scratch_path."""
        path = self.path(name)
        schema = df.schema
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        remove(self.spark, df.scratch_path)


def remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files that no DataFrame refers to any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


@atexit.register
def _clean() -> None:
    for spark, path in _scratch:
        if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
            left = path.removeprefix("file://")
            if os.path.isdir(left):  # the session is gone; the folder's name is our own
                shutil.rmtree(left)
            else:
                print(f"scratch tables are left in {path}", file=sys.stderr)
            continue
        try:
            remove(spark, path)
        except Exception as e:  # exit goes on, but what is left is told
            print(f"scratch tables are left in {path}: {e}", file=sys.stderr)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    prepare(df.sparkSession)
    return df.mapInArrow(fn, schema)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of a column, null as empty."""
    return [t or "" for t in column.to_pylist()]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")

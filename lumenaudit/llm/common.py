"""What the operators share: Arrow batches, shared storage, bounded samples."""

from __future__ import annotations

import atexit
from collections.abc import Callable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumenaudit.sources.storage import shared_folder

#: Rows that a Python worker handles at a time; texts of one slice are all it holds.
SLICE_ROWS = 512


def map_slices(df: DataFrame, fn: Callable[..., dict], schema: str, *, rows: int = SLICE_ROWS, setup: Callable[[], object] | None = None) -> DataFrame:
    """``mapInArrow`` by slices of ``rows`` rows.

    ``fn(columns)`` gets each column as an Arrow array by name and returns the output columns by name, as lists or arrays;
    it may return another number of rows than it got. With ``setup``, each worker calls it once and hands its value to
    ``fn(columns, value)``.
    """
    out = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches):
        state = setup() if setup else None
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                cols = {name: part.column(k) for k, name in enumerate(part.schema.names)}
                got = fn(cols, state) if setup else fn(cols)
                if got is not None:
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for f in out for x in [got[f.name]]], schema=out)

    return df.mapInArrow(run, schema)


def shared_value(spark: SparkSession, value: object) -> Callable[[], object]:
    """Broadcasts ``value``, whose size the caller has bounded; the function returned gives it to a worker, as ``setup`` of ``map_slices``."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(sent.value)


def raw_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, None for null."""
    return column.cast(pa.binary()).to_pylist()


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share, gone when the session ends."""
    path = shared_folder(spark)
    atexit.register(_drop, spark, path)
    return path


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has gone: its folder is the cluster's to clean  # noqa: BLE001
        return


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """The rows, written to shared storage and read again: this cuts the lineage, and lost executors cost no recomputation.

    The shuffle files that led to them go at once, as nothing needs them any more."""
    spark = df.sparkSession
    path = shared_dir(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def release(*written_rows: DataFrame) -> None:
    """Deletes rows that ``written`` stored, once all that was built on them is itself written."""
    for df in written_rows:
        _drop(df.sparkSession, df._written_path)


def label_sample(labels: DataFrame, column: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled documents ``(doc_id, label)``, those with the least hash of their id.

    Rows with a null id or label are left out; of several labels of one document the least counts.
    """
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
        .groupBy("doc_id").agg(F.min(column).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )


def columns(docs: DataFrame, keep: list[str], made: str) -> tuple[list[str], str]:
    """The kept columns and the schema of an operator's output ``made``: a kept column that an output column is named like gives way to it."""
    names = {f.split()[0].strip("`") for f in made.split(", ")}
    keep = [c for c in keep if c not in names]
    return keep, "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep) + made


def free_name(docs: DataFrame, name: str) -> str:
    """The name, with as many underscores after it as tell it from all columns of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def packed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and whole rows as ``__row``, so that no column of theirs clashes with an operator's."""
    return docs.select("doc_id", "text", F.struct("*").alias("__row"))

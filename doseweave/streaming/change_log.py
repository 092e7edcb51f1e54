"""Results of a stream as a log of changes: a batch adds a folder and never rewrites what is there.

``batch=N`` holds what batch N says of its keys; a replayed batch replaces its own folder. ``base=N`` is what the
batches up to N come to. A folder counts once its ``_SUCCESS`` file is there, which Spark writes last, so readers see
a batch or a base as a whole or not at all and there is never a moment without a table. Superseded folders stay until
their owner removes them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doseweave.operators.clean import one_per

SEQUENCE = "log_batch"


def _finished(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """Numbers of the finished folders by kind. One listing; contents are not read."""
    jvm = spark._jvm.org.apache.hadoop.fs
    folder = jvm.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[str, list[int]] = {"base": [], "batch": []}
    for done in system.globStatus(jvm.Path(folder, "*=*/_SUCCESS")) or []:
        kind, _, number = done.getPath().getParent().getName().partition("=")
        if kind in found and number.isdigit():
            found[kind].append(int(number))
    return found


def log_sink(path: str, reduce: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes each batch, reduced to one row per key if ``reduce`` does so."""

    def write(batch: DataFrame, number: int) -> None:
        rows = reduce(batch) if reduce else batch
        rows.withColumn(SEQUENCE, F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows that count, with ``log_batch``: the newest base and the batches after it. An absent log is empty."""
    found = _finished(spark, path)
    base = max(found["base"], default=-1)
    folders = [f"{path}/base={base}"] * (base >= 0) + [f"{path}/batch={n}" for n in sorted(found["batch"]) if n > base]
    full = T.StructType([f for f in schema.fields if f.name != SEQUENCE]).add(SEQUENCE, "long")
    if not folders:
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(*folders)


def newest(keys: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """Per key the row of the last batch that has one: the state of a query in update mode."""
    return lambda rows: one_per(rows, list(keys), [F.desc(SEQUENCE)])


def compact(spark: SparkSession, path: str, schema: T.StructType, merge: Callable[[DataFrame], DataFrame]) -> int:
    """Writes what ``merge`` makes of the log as a new base and returns the base's number (-1: no batch).

    Readers use the old folders until the base is finished; a run that broke off is repeated in place.
    """
    found = _finished(spark, path)
    last = max(found["batch"], default=-1)
    if last > max(found["base"], default=-1):
        merge(read_log(spark, path, schema)).write.mode("overwrite").parquet(f"{path}/base={last}")
    return last

"""Incremental forms of the report and edge operators on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doseweave.functions.text import norm_name
from doseweave.operators.reports import latest_case_version
from doseweave.streaming.change_log import SEQUENCE, compact, log_sink, newest, read_log


def read_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format("parquet").option("pathGlobFilter", pattern)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(folder)


def case_dedup(stream: DataFrame, keys: Sequence[str] = ("caseid", "canonical_smiles"), time: str | None = None, delay: str = "90 days") -> DataFrame:
    """One row per case and structure across arriving files; with an event time the state forgets old keys
    and rows that come later than ``delay`` are dropped."""
    if time:
        return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))
    return stream.dropDuplicates(list(keys))


def running_counts(stream: DataFrame, key: str, serious: str) -> DataFrame:
    """Running reports and serious reports per structure. In update mode a batch gives the structures it changed;
    ``log_sink`` and ``current_counts`` make a table of them."""
    return stream.groupBy(key).agg(F.count(F.lit(1)).alias("n_reports"), F.sum(serious).alias("serious_outcome_reports"))


def current_counts(spark: SparkSession, path: str, schema, key: str) -> DataFrame:
    """The counts of a logged query in update mode after its last finished batch."""
    return newest([key])(read_log(spark, path, schema)).drop(SEQUENCE)


def map_edges(stream: DataFrame, lookup: DataFrame, a: str, b: str, keep: Sequence[str]) -> DataFrame:
    """Arriving name pairs to structures by a static lookup(name, structure); unresolved or blank ones are dropped."""
    one = lookup.filter(F.trim("structure") != "").groupBy(norm_name(F.col("name")).alias("_n")).agg(F.min("structure").alias("structure"))
    out = stream
    for side, target in ((a, "source"), (b, "target")):
        out = out.withColumn("_n", norm_name(F.col(side))).join(one.withColumnRenamed("structure", target), "_n").drop("_n")
    return out.select(*keep, "source", "target")


def latest_version_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Logs the highest version per case of each batch. No state is kept and nothing earlier is read or rewritten, so
    a version that arrives late, even below one already seen, costs one row and is settled by ``latest_versions``."""
    return log_sink(path, latest_case_version)


def latest_versions(spark: SparkSession, path: str, schema) -> DataFrame:
    """The highest version per case of all finished batches."""
    return latest_case_version(read_log(spark, path, schema)).drop(SEQUENCE)


def compact_versions(spark: SparkSession, path: str, schema) -> int:
    """Merges the batches so far; a later read takes that and the batches after it."""
    return compact(spark, path, schema, latest_case_version)


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Processes what has arrived and stops."""
    query = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def parquet_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each batch to its own folder, so a replayed batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write

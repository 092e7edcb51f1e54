"""Sinks: event tables, catalogues, result tables, inventories."""

from __future__ import annotations

from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doseweave.operators.events import EventTable
from doseweave.sources.readers import file_name, list_files

#: Bytes of the largest file that Spark's binary reader can load.
READER_LIMIT = (1 << 31) - 1


def write_event_table(table: EventTable, folder: str) -> DataFrame:
    """The four tables as parquet and a one-row JSON manifest of their counts, read back from the files."""
    from doseweave.functions.numeric import set_hash

    parts = {"drugs": table.drugs, "events": table.events, "pairs": table.pairs, "labels": table.labels}
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    stored = read_event_table(table.drugs.sparkSession, folder)
    manifest = stored.pairs.agg(F.count(F.lit(1)).alias("n_pairs")).withColumns(
        {
            "n_drugs": stored.drugs.agg(F.count(F.lit(1))).scalar(), "n_events": stored.events.agg(F.count(F.lit(1))).scalar(),
            "n_labels": stored.labels.agg(F.count(F.lit(1))).scalar(),
            "drugs_sha256": set_hash(stored.drugs, "smiles").select("set_sha256").scalar(),
            "label_meaning": F.lit("1 = reported, absent = unreported, not proven safe"),
        }
    )
    manifest.write.mode("overwrite").json(f"{folder}/manifest")
    return manifest


def read_event_table(spark: SparkSession, folder: str) -> EventTable:
    return EventTable(*[spark.read.parquet(f"{folder}/{name}") for name in ("drugs", "events", "pairs", "labels")])


def json_encoded(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, other columns unchanged."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema])


def export_catalogue(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    json_encoded(nodes).write.mode("overwrite").csv(f"{folder}/nodes", header=True, escape='"')
    json_encoded(edges).write.mode("overwrite").csv(f"{folder}/edges", header=True, escape='"')


def append_results(new: DataFrame, path: str) -> None:
    """Adds rows whose columns may differ from earlier ones; the commit protocol makes the append all or nothing."""
    new.write.mode("append").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def replace_matching(new: DataFrame, path: str, key: Sequence[str]) -> None:
    """Deletes the earlier rows of exactly the runs in ``new`` (nulls equal), then adds them, by an atomic swap."""
    spark = new.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(fs_path):
        append_results(new, path)
        return
    old = read_results(spark, path)
    for k in key:
        if k not in old.columns:
            old = old.withColumn(k, F.lit(None).cast(new.schema[k].dataType))
    runs = new.select(*[F.col(k).alias(f"_{k}") for k in key]).distinct()
    match = None
    for k in key:
        same = F.col(k).eqNullSafe(F.col(f"_{k}"))
        match = same if match is None else match & same
    kept = old.join(runs, match, "left_anti")
    fresh, retired = f"{path}.next-{uuid4().hex}", f"{path}.old-{uuid4().hex}"
    kept.unionByName(new, allowMissingColumns=True).write.parquet(fresh)
    as_path = spark._jvm.org.apache.hadoop.fs.Path
    if not (fs.rename(fs_path, as_path(retired)) and fs.rename(as_path(fresh), fs_path)):
        raise OSError(f"could not swap {path}")
    fs.delete(as_path(retired), True)


def inventory(spark: SparkSession, folder: str, expected: DataFrame) -> DataFrame:
    """expected(name) against the files below a folder (by ``path``): presence, bytes and content hash of every file.

    Spark's binary reader hands a file over whole; one above its limit of 2 GiB is present without a hash.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    hashed = files.filter(F.col("length") <= READER_LIMIT).select("path", F.sha2("content", 256).alias("sha256"))
    joined = expected.select("name").distinct().join(list_files(spark, folder).join(hashed, "path", "left"), "name", "full")
    return joined.withColumn("status", F.when(F.col("path").isNull(), "(missing)").otherwise("present"))


def line_counts(spark: SparkSession, path: str, expected: DataFrame | None = None) -> DataFrame:
    """Lines per file (``path``, ``name``), files of one name in several folders apart; expected names without a file have zero."""
    text = spark.read.option("recursiveFileLookup", True).text(path)
    counts = text.groupBy(F.col("_metadata.file_path").alias("path"), file_name().alias("name")).agg(F.count(F.lit(1)).alias("lines"))
    if expected is None:
        return counts
    return expected.select("name").distinct().join(counts, "name", "full").withColumns(
        {"present": F.col("lines").isNotNull(), "lines": F.coalesce("lines", F.lit(0))})

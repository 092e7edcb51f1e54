"""One large JSON document read by many tasks.

A bulk file is one object whose ``results`` array holds all records, so no line is a record and a JSON reader takes the
whole file as one task. Here Spark's text reader cuts the file at closing braces, per byte range, and a task joins its
neighbouring pieces to chunks, written once. A chunk's quotes tell whether the chunk after it starts inside a string, its
brackets outside strings how deep that starts. Running sums over the chunks, a small table, give both, and with them the
braces that end a record. Records inside a chunk are cut from it in place; only the text at a chunk's two ends is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from doseweave.plans.ordering import running_sums
from doseweave.session import durable

#: Bytes from which a chunk is closed at its next brace; bytes of a row group, so that few chunks are in memory at a time.
CHUNK_BYTES, GROUP_BYTES = 1 << 18, 4 << 20
#: What a chunk's marks outside strings do to the depth, and where its closing braces end, by the depth they leave.
SHAPE = "struct<objects int, arrays int, levels array<struct<objects int, arrays int, ends array<int>>>>"
CHUNK = f"source_file string, block long, chunk int, text binary, odd int, outside {SHAPE}, inside {SHAPE}"
PART = "source_file string, block long, chunk int, record_number long, text binary, ended boolean"
_IS_MARK = np.isin(np.arange(256), list(b"{}[]"))


def _shape(at: np.ndarray, marks: np.ndarray) -> dict:
    """The shape of a text from the marks outside its strings."""
    objects = np.cumsum((marks == ord("{")).astype(np.int32) - (marks == ord("}")))
    arrays = np.cumsum((marks == ord("[")).astype(np.int32) - (marks == ord("]")))
    closes = np.flatnonzero(marks == ord("}"))
    order = closes[np.lexsort((closes, arrays[closes], objects[closes]))]
    depth = np.stack([objects[order], arrays[order]])
    bounds = np.flatnonzero((np.diff(depth) != 0).any(axis=0)) + 1
    levels = [
        {"objects": int(objects[same[0]]), "arrays": int(arrays[same[0]]), "ends": (at[same] + 1).astype(np.int32)}
        for same in np.split(order, bounds) if len(same)
    ]
    return {"objects": int(objects[-1]) if len(marks) else 0, "arrays": int(arrays[-1]) if len(marks) else 0, "levels": levels}


def _shapes(text: bytes) -> tuple[int, dict, dict]:
    """A chunk's odd quote, and its shape if it starts outside a string and if inside.

    In valid JSON a backslash stands in a string and never before a brace, so a pair is never cut.
    """
    plain = np.frombuffer(text.replace(b"\\\\", b"__").replace(b'\\"', b"__"), np.uint8)
    quotes, at = np.flatnonzero(plain == ord('"')), np.flatnonzero(_IS_MARK[plain])
    marks, quoted = plain[at], np.searchsorted(quotes, at) % 2
    return len(quotes) % 2, *[_shape(at[quoted == start], marks[quoted == start]) for start in (0, 1)]


def _chunks(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Pieces (source_file, block, value) in file order, each without its closing brace, joined to chunks."""
    place, number, held, size = None, 0, [], 0

    def chunk() -> pa.RecordBatch:
        text = b"".join(held)
        row = [*place, number, text, *_shapes(text)]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    for batch in batches:
        if not len(batch):
            continue
        values = batch.column(2)
        total = np.cumsum(pc.binary_length(values).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        runs = np.union1d(*[pc.run_end_encode(batch.column(i)).run_ends.to_numpy() for i in (0, 1)])
        first = 0
        for last in runs.tolist():
            here = (batch.column(0)[first].as_py(), batch.column(1)[first].as_py())
            if here != place:
                if held:
                    yield chunk()
                place, number, held, size = here, 0, [], 0
            while first < last:
                done = int(total[first - 1]) if first else 0
                upto = min(last, int(np.searchsorted(total, done + CHUNK_BYTES - size)) + 1)
                held += [b"}".join(values.slice(first, upto - first).to_pylist()), b"}"]
                size += int(total[upto - 1]) - done
                first = upto
                if size >= CHUNK_BYTES:
                    yield chunk()
                    number, held, size = number + 1, [], 0
    if held:
        yield chunk()


def _parts(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Chunks cut at the ends of records: the records that lie in a chunk, or else the texts before its first end and after its last."""
    for batch in batches:
        for row in range(len(batch)):
            ends, text = batch.column("ends")[row].values.to_numpy(), batch.column("text")[row].as_buffer()
            bounds = np.r_[0, ends, text.size].astype(np.int32)
            texts = pa.Array.from_buffers(pa.binary(), len(ends) + 1, [None, pa.py_buffer(bounds), text])
            at = np.arange(1, len(ends)) if whole else np.unique([0, len(ends)])
            same = [pa.repeat(batch.column(c)[row], len(at)) for c in ("source_file", "block", "chunk")]
            numbers, ended = pa.array(at + batch.column("before")[row].as_py(), pa.int64()), pa.array(at < len(ends))
            yield pa.RecordBatch.from_arrays([*same, numbers, texts.take(pa.array(at)), ended], names=["source_file", "block", "chunk", "record_number", "text", "ended"])


def record_texts(spark: SparkSession, path: str | list[str], key: str = "results") -> DataFrame:
    """(source_file, record_number, record): the text of every object in the ``key`` array of the files' documents.

    A file holds one document or several, one after the other, each an object with one array of objects. Records are
    numbered from 0 per file. Documents are valid JSON; records of a file that breaks off are returned up to there. A
    record or a chunk is the most that one task holds at a time.
    """
    read = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value")
    )
    schema = to_arrow_schema(StructType.fromDDL(CHUNK))
    chunks = durable(read.mapInArrow(lambda batches: _chunks(batches, schema), CHUNK), **{"compression": "zstd", "parquet.block.size": str(GROUP_BYTES)})
    names = ["source_file", "block", "chunk"]

    def small(shape: str) -> Column:
        levels = F.transform(f"{shape}.levels", lambda s: F.struct(s["objects"].alias("objects"), s["arrays"].alias("arrays"), F.size(s["ends"]).alias("n")))
        return F.struct(f"{shape}.objects", f"{shape}.arrays", levels.alias("levels")).alias(shape)

    def run(df: DataFrame, sums: list[str]) -> DataFrame:
        return running_sums(df, "chunk", sums, ["source_file"], bucket=F.col("block"))

    def last_of_record(levels: Column) -> Column:
        """The level whose closing braces end a record."""
        return F.get(F.filter(levels, lambda s: (s["objects"] + F.col("objects") == 1) & (s["arrays"] + F.col("arrays") == 1)), F.lit(0))

    shapes = durable(chunks.select(*names, "odd", small("outside"), small("inside")))
    starts_inside = (F.col("run_odd") - F.col("odd")) % 2 == 1
    placed = run(shapes, ["odd"]).select(*names, starts_inside.alias("starts_inside"), F.when(starts_inside, F.col("inside")).otherwise(F.col("outside")).alias("_s"))
    deep = run(durable(placed.select(*names, "starts_inside", "_s.*")), ["objects", "arrays"]).select(
        *names, "starts_inside", "levels", *[(F.col(f"run_{c}") - F.col(c)).alias(c) for c in ("objects", "arrays")]
    )
    counted = durable(deep.withColumn("n", F.coalesce(last_of_record(F.col("levels"))["n"], F.lit(0))).drop("levels"))
    starts = durable(run(counted, ["n"]).withColumn("before", F.col("run_n") - F.col("n")).drop("n", "run_n"))

    levels = F.when(F.col("starts_inside"), F.col("inside.levels")).otherwise(F.col("outside.levels"))
    cut = chunks.join(starts, names).select(*names, "text", "before", F.coalesce(last_of_record(levels)["ends"], F.array().cast("array<int>")).alias("ends"))
    whole = cut.mapInArrow(lambda batches: _parts(batches, True), PART)
    ragged = cut.mapInArrow(lambda batches: _parts(batches, False), PART).groupBy("source_file", "record_number").agg(
        F.sort_array(F.collect_list(F.struct("block", "chunk", F.col("text").cast("string").alias("text")))).alias("_p"), F.max("ended").alias("_whole")
    )
    joined = ragged.filter("_whole").select("source_file", "record_number", F.array_join(F.transform("_p", lambda p: p["text"]), "").alias("text"))
    # The first record of a document follows its head, which ends where the array opens; others follow a comma.
    head = rf'(?s)^(\s*,|.*?"{key}"\s*:\s*\[)\s*(?=\{{)'
    texts = whole.select("source_file", "record_number", F.col("text").cast("string").alias("text")).unionByName(joined)
    return texts.select("source_file", "record_number", F.regexp_replace("text", head, "").alias("record"))

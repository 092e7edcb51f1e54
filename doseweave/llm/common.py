"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from doseweave.session import checkpoint_dir, durable

__all__ = ["carried", "checkpoint_dir", "durable", "map_texts", "pieces", "table", "with_texts"]

#: Bytes of text that one vectorised step inside a task works on.
PIECE_BYTES = 4 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def pieces(sizes, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring rows with up to ``limit`` bytes together; a longer row is a range of its own."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def carried(df: DataFrame, added: Sequence[str]) -> list[str]:
    """Columns of ``df`` whose names don't clash, in any letter case, with the added ones."""
    taken = {name.lower() for name in added}
    return [c for c in df.columns if c.lower() not in taken]


def map_texts(
    df: DataFrame, work: Callable[[], Callable[[list[bytes]], dict[str, list]]], added: str, text: str = "text",
    keep: Sequence[str] | None = None, piece: int = PIECE_BYTES,
) -> DataFrame:
    """Adds columns computed from whole texts, batch by batch; the other columns pass through untouched.

    ``work()`` is called once per task and gives a function from the UTF-8 texts (null: empty) of up to about
    ``piece`` bytes to one list per added column. ``keep`` names the columns to carry, else all without a clash.
    """
    extra = StructType.fromDDL(added)
    kept = carried(df, extra.names) if keep is None else list(keep)
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("binary").alias("_bytes"))
    schema = StructType([*source.schema.fields[:-1], *extra.fields])
    names = extra.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, types = work(), to_arrow_schema(extra)
        for batch in batches:
            column = batch.column(len(kept))
            lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
            for start, end in pieces(lengths, piece):
                made = step([x or b"" for x in column.slice(start, end - start).to_pylist()])
                passed = [batch.column(i).slice(start, end - start) for i in range(len(kept))]
                arrays = [pa.array(made[n], type=types.field(n).type) for n in names]
                yield pa.RecordBatch.from_arrays(passed + arrays, names=kept + names)

    return source.mapInArrow(run, schema)


def with_texts(
    df: DataFrame, work: Callable[[], Callable[[list[bytes]], dict[str, list]]], added: str, name: str, text: str = "text", piece: int = PIECE_BYTES
) -> DataFrame:
    """Adds a struct column ``name`` of the fields ``added``, computed from whole texts.

    Like ``map_texts``, but only the text goes to Python and only what is made of it comes back: the other columns stay in
    the JVM, so a row's text is sent once.
    """
    extra = StructType.fromDDL(added)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        step, types = work(), to_arrow_schema(extra)
        for column in columns:
            lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
            parts = []
            for start, end in pieces(lengths, piece):
                made = step([x or b"" for x in column.slice(start, end - start).to_pylist()])
                parts.append(pa.StructArray.from_arrays([pa.array(made[f.name], type=f.type) for f in types], fields=list(types)))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct(list(types)))

    return df.withColumn(name, F.arrow_udf(run, extra)(F.col(f"`{text}`").cast("binary")))

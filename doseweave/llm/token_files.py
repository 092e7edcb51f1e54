"""Token ids of whole documents in compressed files of independent blocks, in ascending document order.

Documents are range-partitioned by id and tokenised in place; a block holds whole neighbouring documents. One count
over all ids gives the frequency table that all blocks share; it has one row per id that occurs, at most the
vocabulary. Both are tables below the given folder:

* ``table``: ``id``, ``count``
* ``blocks``: ``first`` (ids of all documents before the block), ``doc_ids``, ``lengths`` and ``data``, the coded ids
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doseweave.llm.common import checkpoint_dir, pieces
from doseweave.llm.entropy_coding import FrequencyTable, decode, encode

END_ID = 1
BLOCK_IDS = 1 << 19
MEMO_WORDS = 3 << 17
RAW = pa.schema([("part", pa.int32()), ("begin", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("ids", pa.binary())])


#: A word of letters whose lower case and composition are one to one, then marks that form one token group; or any other.
PLAIN = re.compile(r"(?:([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([.,;:!?#$%&*|()=+-]*)|(.*))\Z", re.DOTALL)


class Memory(dict):
    """Values by key, made when first asked for."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


class WordTokenizer:
    """Ids of texts as little-endian bytes.

    The vocabulary drops white space and no token crosses it or the border of letters and marks, so a text's ids are
    those of its words, a plain word's ids are those of its letters and of its marks, and each is encoded once and
    remembered; memories above ``MEMO_WORDS`` start anew.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        letters = [chr(c) for c in (*range(97, 123), *range(0xDF, 0x100)) if c != 0xF7]
        self.table = str.maketrans({c: self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in letters})
        self.words, self.letters, self.others = Memory(self.word), Memory(self.of_letters), Memory(self.whole)

    def whole(self, text: str) -> bytes:
        return struct_ids(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def of_letters(self, text: str) -> bytes:
        return struct_ids([t.id for t in self.tokenizer.model.tokenize(text.translate(self.table))])

    def word(self, word: bytes) -> bytes:
        letters, marks, other = PLAIN.match(word.decode("utf-8", "replace")).groups()
        if letters is None:
            return self.others[other]
        ids = self.letters[letters.lower()]
        return ids + self.others[marks] if marks else ids

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        for memory in (self.words, self.letters, self.others):
            if len(memory) > MEMO_WORDS:
                memory.clear()
        ids = self.words.__getitem__
        return [b"".join(map(ids, text.split())) for text in texts]


def struct_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@cache
def word_tokenizer(path: str) -> WordTokenizer:
    """One per Python process, so tasks share what is remembered."""
    return WordTokenizer(path)


def tokenized_blocks(docs: DataFrame, tokenizer: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Raw blocks in document order: ``part``, ``begin`` (ids before it in its part), ``doc_ids``, ``lengths``, ``ids``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_texts, part = word_tokenizer(tokenizer), TaskContext.get().partitionId()
        end, begin = np.array([end_id], "<u4").tobytes(), 0
        names, lengths, data, size = [], [], [], 0

        def block():
            ids = np.frombuffer(b"".join(data), "<u4")
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip((part, begin, names, lengths, ids.astype("<u2" if small else "<u4").tobytes()), RAW.types, strict=True)], schema=RAW
            )

        small = encode_texts.tokenizer.get_vocab_size() <= 1 << 16
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_pylist()
            for first, last in pieces(sizes):
                texts = encode_texts(batch.column(1).slice(first, last - first).to_pylist())
                for name, coded in zip(batch.column(0).slice(first, last - first).to_pylist(), texts, strict=True):
                    coded += end
                    names.append(name)
                    lengths.append(len(coded) // 4)
                    data.append(coded)
                    size += lengths[-1]
                    if size >= block_ids:
                        yield block()
                        begin, size = begin + size, 0
                        names, lengths, data = [], [], []
        if names:
            yield block()

    return rows.mapInArrow(run, "part int, begin long, doc_ids array<long>, lengths array<long>, ids binary")


def _id_type(total_bytes: int, count: int) -> str:
    return "<u2" if total_bytes == 2 * count else "<u4"


def _raw_ids(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for lengths, ids in zip(batch.column("lengths").to_pylist(), batch.column("ids"), strict=True):
        data = ids.as_buffer()
        yield np.frombuffer(data, _id_type(len(data), sum(lengths))).astype("<u4")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Writes the ids of every text, each followed by ``end_id``, below ``folder``.

    Ascending ``doc_id`` (null first); rows with the same id are neighbours in the order of a hash of their texts. A
    null or empty text is the end id alone. An empty table gives an empty file. Other columns are not written.
    """
    spark = docs.sparkSession
    tokenized_blocks(docs, tokenizer, end_id, block_ids).write.parquet(f"{folder}/raw", compression="zstd")
    raw = spark.read.parquet(f"{folder}/raw")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1, np.int64)
        for batch in batches:
            for ids in _raw_ids(batch):
                seen = np.bincount(ids, minlength=len(counts))
                seen[: len(counts)] += counts
                counts = seen
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], names=["id", "count"])

    raw.select("lengths", "ids").mapInArrow(tally, "id long, count long").groupBy("id").agg(F.sum("count").alias("count")).write.parquet(f"{folder}/table")
    table = spark.sparkContext.broadcast(frequency_table(spark, folder))
    parts = raw.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = raw.join(before, "part").select((F.col("before") + F.col("begin")).alias("first"), "doc_ids", "lengths", "ids")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, ids in enumerate(_raw_ids(batch)):
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(row, 1) for i in range(3)] + [pa.array([encode(ids, table.value)], pa.binary())], names=["first", "doc_ids", "lengths", "data"])

    placed.mapInArrow(code, "first long, doc_ids array<long>, lengths array<long>, data binary").write.parquet(f"{folder}/blocks")


def frequency_table(spark: SparkSession, folder: str) -> FrequencyTable:
    """The shared table; its size is bounded by the vocabulary."""
    counts = spark.read.parquet(f"{folder}/table").toPandas()
    return FrequencyTable(counts["id"].to_numpy(), counts["count"].to_numpy())


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and, if asked for, ``ids``."""
    table = spark.sparkContext.broadcast(frequency_table(spark, folder))
    fields = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids = decode(batch.column("data")[row].as_py(), table.value)
                names, lengths = batch.column("doc_ids")[row].values, np.array(batch.column("lengths")[row].as_py(), np.int64)
                ends = np.cumsum(lengths)
                own = [ids[e - n : e] for n, e in zip(lengths, ends, strict=True)]
                arrays = [names, pa.array(batch.column("first")[row].as_py() + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64())]
                arrays += [pa.array([x.tolist() for x in own], pa.list_(pa.int64()))] * with_ids
                yield pa.RecordBatch.from_arrays(arrays, names=fields)

    types = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return spark.read.parquet(f"{folder}/blocks").select("first", "doc_ids", "lengths", "data").mapInArrow(run, types)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder for token files below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{spark.sparkContext.applicationId}/tokens-{uuid4().hex}"

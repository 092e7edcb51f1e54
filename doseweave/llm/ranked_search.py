"""Ranked lexical search, reversed: the items are indexed and the documents are the stream.

The inverted index over the items' terms is broadcast in blocks of bounded size. A task turns a batch of documents into
(document, term) counts of indexed terms, sends each through the term's postings, and keeps a heap of the best documents per
item; what is no better than an item's worst kept score never gets there. The heaps of all tasks, at most ``top`` rows
per item each, are merged at the end. Neither documents nor their term counts are shuffled.

Scores are sums of whole numbers below 2^53, so adding them as doubles is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from doseweave.llm.byte_words import Words, byte_classes, whole
from doseweave.llm.common import pieces

TOP = 10
#: Share of the length in the norm, and its scale.
LENGTH_PART, SCALE = 75, 100
#: Bytes of item text per broadcast block.
BLOCK_BYTES = 2 << 20
#: Bytes of document text, and cells of documents times items, that a task works on at once.
PIECE = 4 << 20
CELLS = 1 << 21
#: Terms that more than one item in so many has are multiplied as a matrix instead of walking their postings.
COMMON = 8

_WORD = bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)])
CLASSES = byte_classes(bytes(b for b in range(0x80) if b not in _WORD))


class ItemIndex:
    """Postings of the terms of a block of items: per term the items that hold it and how often."""

    def __init__(self, numbers: list[int], texts: list[bytes]):
        self.items = np.array(numbers, np.int64)
        column = pa.array(texts, pa.large_binary())
        words = Words(*whole(column), CLASSES)
        terms = len(words.distinct)
        self.terms = words.distinct
        cell, self.times = np.unique(words.ids * max(len(texts), 1) + words.owner, return_counts=True)
        self.term, self.item = np.divmod(cell, max(len(texts), 1))
        self.first = np.searchsorted(self.term, np.arange(terms + 1))
        self.held = np.diff(self.first)
        self.longest = int(np.bincount(words.owner, minlength=1).max()) if len(words) else 0
        self.weights = np.zeros(terms, np.int64)

    def weigh(self, df: dict[bytes, int], documents: int) -> None:
        """``floor(1000 ln((2 N + 2) / (2 df + 1)))`` per term."""
        self.weights = np.array(
            [math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(t, 0) + 1))) for t in self.terms.to_pylist()], np.int64
        )
        if len(self.weights) and int(self.weights.max()) * 10**6 * self.longest >= 1 << 53:
            raise ValueError("An item has so many terms that its score would pass 53 bits.")

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(terms of each text, then text number, term and count of each indexed term of each text)."""
        words = Words(*whole(texts), CLASSES)
        lengths = np.bincount(words.owner, minlength=len(texts)) if len(words) else np.zeros(len(texts), np.int64)
        place = pc.fill_null(pc.index_in(words.distinct, value_set=self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        known = place[words.ids] if len(words) else np.zeros(0, np.int64)
        has = known >= 0
        cell, tf = np.unique(words.owner[has] * max(len(self.terms), 1) + known[has], return_counts=True)
        text, term = np.divmod(cell, max(len(self.terms), 1))
        return lengths, text, term, tf

    def scores(self, text: np.ndarray, term: np.ndarray, part: np.ndarray, n: int) -> np.ndarray:
        """Score of each of ``n`` texts for each item, from the worth ``part`` of each term of each text."""
        size = len(self.items)
        common = self.held * COMMON > size
        wide = common[term]
        total = np.zeros((n, size))
        which = np.flatnonzero(common)
        if wide.any():
            worth = np.zeros((n, len(which)))
            worth[text[wide], np.searchsorted(which, term[wide])] = part[wide]
            grid = np.zeros((len(which), size))
            inside = common[self.term]
            grid[np.searchsorted(which, self.term[inside]), self.item[inside]] = self.times[inside]
            total += worth @ grid
        text, term, part = text[~wide], term[~wide], part[~wide]
        length = self.held[term]
        begin = np.repeat(self.first[term] - np.cumsum(length) + length, length)
        posting = begin + np.arange(len(begin))
        cell = np.repeat(text, length) * size + self.item[posting]
        total += np.bincount(cell, np.repeat(part, length) * self.times[posting], n * size).reshape(n, size)
        return total


class Heaps:
    """The best documents of each item so far: by score descending, then id ascending, a null id last."""

    def __init__(self, items: int, top: int):
        self.top, self.items = top, items
        self.item, self.doc, self.null, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0)
        self.least = np.full(items, 1.0)

    def offer(self, scores: np.ndarray, docs: np.ndarray, null: np.ndarray) -> None:
        row, item = np.nonzero(scores >= self.least)
        if not len(row):
            return
        item, doc = np.r_[self.item, item], np.r_[self.doc, docs[row]]
        missing, score = np.r_[self.null, null[row]], np.r_[self.score, scores[scores >= self.least]]
        order = np.lexsort((doc, missing, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, np.arange(self.items))[item]
        kept = place < self.top
        order = order[kept]
        self.item, self.doc, self.null, self.score = item[kept], doc[order], missing[order], score[order]
        full = place[kept] == self.top - 1
        self.least[self.item[full]] = self.score[full]


def _blocks(numbered: DataFrame, block_bytes: int) -> Iterator[ItemIndex]:
    """Indexes of blocks of whole items by their numbers' hash; each block is collected alone."""
    size = numbered.agg(F.sum(F.octet_length("text") + F.lit(16))).first()[0] or 0
    count = max(1, math.ceil(size / block_bytes))
    for block in range(count):
        rows = numbered.filter(F.pmod(F.xxhash64("number"), F.lit(count)) == block) if count > 1 else numbered
        found = sorted((r.number, bytes(r.text)) for r in rows.collect())
        yield ItemIndex([n for n, _ in found], [t for _, t in found])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_pylist()
        for start, end in pieces(lengths, PIECE):
            yield batch.slice(start, end - start)


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The ``top`` documents of each item: item_id, rank (from 1), doc_id, score.

    Terms are the runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased, in whole texts; a null text has
    none. Every row of ``items`` is an item, also if its id repeats or is null, and every row of ``docs`` a document; among equal
    scores the lower ``doc_id`` goes first and a null one last. Only scores above 0 count, so an item without a known term, or an
    empty table, gives no rows. Documents are read twice per block of items. Other columns don't matter.
    """
    spark = docs.sparkSession
    context = spark.sparkContext
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    named = items.select("item_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    lists = named.groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    # Rows that are equal are found once and listed as often as they stand there.
    numbered = lists.select("*", F.xxhash64("item_id", "text").alias("number"))
    out = None
    for index in _blocks(numbered.select("number", "text"), block_bytes):
        shared = context.broadcast(index)

        def counted(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            df, documents, length = np.zeros(len(index.terms), np.int64), 0, 0
            for batch in _slices(batches):
                lengths, _, term, _ = index.counts(batch.column(0))
                df += np.bincount(term, minlength=len(df)) if len(term) else 0
                documents += int((lengths > 0).sum())
                length += int(lengths.sum())
            seen = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[seen, [-1, -2]]), pa.array(np.r_[df[seen], [documents, length]].astype(np.int64))], names=["term", "c"]
            )

        found = texts.select("text").mapInArrow(counted, "term long, c long").groupBy("term").agg(F.sum("c").alias("c")).collect()
        sums = {r.term: r.c for r in found}
        documents, length = sums.get(-1, 0), sums.get(-2, 0)
        terms = index.terms.to_pylist()
        index.weigh({terms[t]: c for t, c in sums.items() if t >= 0}, documents)
        weighed = context.broadcast(index)

        def searched(batches: Iterator[pa.RecordBatch], weighed=weighed, documents=documents, length=length) -> Iterator[pa.RecordBatch]:
            index = weighed.value
            heaps = Heaps(len(index.items), top)
            step = max(1, CELLS // max(len(index.items), 1))
            for batch in _slices(batches):
                ids = batch.column(0)
                null = ids.is_null().to_numpy(zero_copy_only=False)
                doc = ids.fill_null(0).to_numpy()
                lengths, text, term, tf = index.counts(batch.column(1))
                norm = SCALE - LENGTH_PART + (LENGTH_PART * lengths * documents) // max(length, 1)
                part = index.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * norm[text]))
                for begin in range(0, len(doc), step):
                    end = min(begin + step, len(doc))
                    a, b = np.searchsorted(text, [begin, end])
                    heaps.offer(index.scores(text[a:b] - begin, term[a:b], part[a:b], end - begin), doc[begin:end], null[begin:end])
            if len(heaps.item):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(index.items[heaps.item]), pa.array(heaps.doc, mask=heaps.null), pa.array(heaps.score.astype(np.int64))],
                    names=["number", "doc_id", "score"],
                )

        heaps = texts.mapInArrow(searched, StructType([StructField(n, LongType()) for n in ("number", "doc_id", "score")]))
        out = heaps if out is None else out.unionByName(heaps)
    order = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    listed = best.join(numbered.select("number", "item_id", F.explode(F.sequence(F.lit(1), "copies"))), "number")
    return listed.select("item_id", "rank", "doc_id", "score")

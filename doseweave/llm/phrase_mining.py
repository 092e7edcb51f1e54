"""Phrase collocations: frequent phrases of 2 to 4 words by language, counted by multikey quicksort of suffix pointers.

Three passes over the texts, none of which ships a suffix that can't be frequent:

1. word counts by language, combined inside tasks. A filter of fixed size holds the hashes of frequent words.
2. counts of neighbouring frequent words, by 64-bit hash. A second filter holds the frequent ones. The filters only save
   work: a hash that collides lets an infrequent suffix through, and its exact count drops it later.
3. suffixes of up to four words that start at a frequent pair and go on while pairs are frequent, equal ones of a task
   combined, are routed by their leading pair. Each route's pointers are sorted by multikey three-way quicksort: the weight
   of an equal partition at depth d is the count of its first d words, and a partition lighter than the least count is
   abandoned unsorted. Leading pairs that hold more than one in ``HOT_PARTS`` of all pairs are spread by their further
   words; such routes abandon nothing and their partial counts are added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doseweave.llm.byte_words import Words, byte_classes, whole
from doseweave.llm.common import durable, pieces

LEAST = 30
DEPTH = 4
#: Phrases kept per language.
TOP = 2000
#: A longer candidate with at least this percentage of the count replaces the phrases inside it.
COVERED_PERCENT = 80
#: Bits of each filter; a power of two.
FILTER_BITS = 1 << 27
#: Leading pairs with more than this part of all pairs are spread; so at most as many are.
HOT_PARTS = 1000
#: Bytes of text, and routed suffixes, that a task works on at once.
PIECE = 8 << 20
ROUTED_ROWS = 1 << 19

CLASSES = byte_classes(b" \t", b".,;:!?\n\x0b\x0c\r")
_BITMAP = 1 << 15


def _mixed(a: np.ndarray, b) -> np.ndarray:
    """A 64-bit hash of two of them, in order."""
    with np.errstate(over="ignore"):
        x = (a ^ (b + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) + b
    return x ^ (x >> np.uint64(32))


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(8)).astype(np.int64) & (FILTER_BITS - 1)


class Filter:
    """A bit per slot of a hash."""

    def __init__(self, maps: list[tuple[int, bytes]]):
        self.bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for bucket, bits in maps:
            self.bits[(bucket - 1) * _BITMAP // 8 :][: _BITMAP // 8] = np.frombuffer(bits, np.uint8)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        slot = _slot(hashes)
        return (self.bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def _filter(rows: DataFrame) -> Filter:
    """Of a table with a ``slot`` column; at most FILTER_BITS / 8 bytes come to the driver, whatever the table's size."""
    place = F.col("slot") + 1
    maps = rows.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    return Filter([(r.bucket, bytes(r.bits)) for r in maps.collect()])


class Shard:
    """Words of a piece of the documents, numbered by (language, word), with a hash for each number."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        words = Words(*whole(texts), CLASSES)
        coded = langs.dictionary_encode()
        self.langs = coded.dictionary
        lang = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[words.owner]
        count = max(len(words.distinct), 1)
        used, self.ids, self.counts = np.unique(lang * count + words.ids, return_inverse=True, return_counts=True)
        self.lang_of, self.word_of = np.divmod(used, count)
        self.words = words.distinct
        number = lambda values: np.array([xxhash.xxh3_64_intdigest(v) for v in values.to_pylist()], np.uint64)
        named = number(self.langs.cast(pa.binary())) if len(self.langs) else np.zeros(0, np.uint64)
        self.hashes = _mixed(number(words.distinct)[self.word_of], named[self.lang_of]) if len(used) else np.zeros(0, np.uint64)
        self.joined = words.piece[1:] == words.piece[:-1] if len(words) else np.zeros(0, bool)

    def frequent_pairs(self, words: Filter) -> tuple[np.ndarray, np.ndarray]:
        """Places where two words that may be frequent stand together in a piece, and the hashes of these pairs."""
        known = words.holds(self.hashes)[self.ids]
        at = np.flatnonzero(self.joined & known[1:] & known[:-1]) if len(self.ids) else np.zeros(0, np.int64)
        return at, _mixed(self.hashes[self.ids[at]], self.hashes[self.ids[at + 1]])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
        for start, end in pieces(lengths, PIECE):
            yield Shard(batch.column(0).slice(start, end - start), batch.column(1).slice(start, end - start))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard in _shards(batches):
        yield pa.RecordBatch.from_arrays(
            [
                shard.langs.take(pa.array(shard.lang_of)).cast(pa.string()), shard.words.take(pa.array(shard.word_of)).cast(pa.binary()),
                pa.array(_slot(shard.hashes)), pa.array(shard.counts.astype(np.int64)),
            ],
            names=["lang", "word", "slot", "c"],
        )


def equal_partitions(keys: np.ndarray, weights: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Multikey three-way quicksort of the rows of ``keys`` (0: the row has ended), all partitions of a round at once.

    Yields (depth, a row of each, weight of each) of the equal partitions with at least ``least`` weight, from the first
    word on; a partition below ``least`` is dropped whole, sorted or not.
    """
    rows = np.arange(len(keys))
    segment = np.zeros(len(keys), np.int64)
    for depth in range(keys.shape[1]):
        alive = keys[rows, depth] > 0
        rows, segment = rows[alive], segment[alive]
        done_rows, done_segments, found = [], [], 0
        while len(rows):
            first = np.flatnonzero(np.r_[True, np.diff(segment) != 0])
            sizes = np.diff(np.r_[first, len(rows)])
            key = keys[rows, depth]
            a, b, c = key[first], key[first + sizes // 2], key[first + sizes - 1]
            pivot = np.repeat(np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c)), sizes)
            side = np.where(key < pivot, 0, np.where(key == pivot, 1, 2))
            part = np.repeat(np.arange(len(first)), sizes) * 3 + side
            order = np.argsort(part, kind="stable")
            rows, part = rows[order], part[order]
            heavy = np.bincount(part, weights[rows].astype(np.float64)) >= least
            kept = heavy[part]
            rows, part = rows[kept], part[kept]
            equal = part % 3 == 1
            done_rows.append(rows[equal])
            done_segments.append(part[equal] + found)
            found += 3 * len(first)
            rows, segment = rows[~equal], part[~equal]
        if not done_rows:
            return
        rows, segment = np.concatenate(done_rows), np.concatenate(done_segments)
        if not len(rows):
            return
        first = np.flatnonzero(np.r_[True, np.diff(segment) != 0])
        yield depth + 1, rows[first], np.add.reduceat(weights[rows], first)


def _suffix_rows(shard: Shard, words: Filter, pairs: Filter, hot: np.ndarray) -> pa.RecordBatch:
    """Distinct suffixes of a shard that may be frequent, with counts and routes."""
    at, pair = shard.frequent_pairs(words)
    keep = pairs.holds(pair)
    at, pair = at[keep], pair[keep]
    opens = np.zeros(len(shard.ids) + DEPTH, bool)
    opens[at] = True
    ids = np.append(shard.ids + 1, np.zeros(DEPTH, np.int64))
    going = np.ones(len(at), bool)
    columns = [ids[at], ids[at + 1]]
    for step in range(1, DEPTH - 1):
        going = going & opens[at + step]
        columns.append(np.where(going, ids[at + step + 1], 0))
    group = np.zeros(len(at), np.int64)
    for column in columns:
        _, group = np.unique(group * (len(shard.hashes) + 1) + column, return_inverse=True)
    _, row, counts = np.unique(group, return_index=True, return_counts=True)
    text, further = None, np.zeros(len(row), np.uint64)
    hashes = np.append(np.zeros(1, np.uint64), shard.hashes)
    for number, column in enumerate(columns):
        own = column[row]
        if number > 1:
            further = _mixed(further, hashes[own])
        word = shard.words.take(pa.array(np.where(own > 0, shard.word_of[own - 1], 0), mask=own == 0))
        text = word if text is None else pc.binary_join_element_wise(text, word, pa.scalar(b" ", pa.large_binary()), null_handling="skip")
    lead = pair[row]
    spread = np.isin(lead, hot)
    route = np.where(spread, _mixed(lead, further), lead).view(np.int64)
    lang = shard.langs.take(pa.array(shard.lang_of[columns[0][row] - 1])).cast(pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.array(route), pa.array(spread), lang, text.cast(pa.binary()), pa.array(counts.astype(np.int64))],
        names=["route", "spread", "lang", "suffix", "c"],
    )


def _routed(least: int):
    """Counts of the phrases of whole routes; rows come in order of route."""

    def counted(table: pa.Table) -> Iterator[pa.RecordBatch]:
        lang = table.column("lang").combine_chunks().dictionary_encode()
        suffix = table.column("suffix").combine_chunks()
        octets, offsets = whole(suffix)
        words = Words(octets, offsets, byte_classes(b" "))
        code = words.ids * (len(lang.dictionary) + 1) + lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)[words.owner]
        _, code = np.unique(code, return_inverse=True)
        keys = np.zeros((len(table), DEPTH), np.int64)
        place = np.arange(len(words)) - np.searchsorted(words.owner, np.arange(len(table)))[words.owner]
        keys[words.owner, place] = code + 1
        weights = table.column("c").to_numpy()
        spread = table.column("spread").to_numpy()
        begin = np.searchsorted(words.owner, np.arange(len(table)))
        for some, bound in ((np.flatnonzero(~spread), least), (np.flatnonzero(spread), 1)):
            for depth, row, total in equal_partitions(keys[some], weights[some], bound):
                if depth == 1:
                    continue
                row = some[row]
                phrase = None
                for k in range(depth):
                    word = words.distinct.take(pa.array(words.ids[begin[row] + k]))
                    phrase = word if phrase is None else pc.binary_join_element_wise(phrase, word, pa.scalar(b" ", pa.large_binary()))
                yield pa.RecordBatch.from_arrays(
                    [lang.dictionary.take(lang.indices.take(pa.array(row))), phrase.cast(pa.binary()), pa.array(np.full(len(row), depth, np.int32)), pa.array(total.astype(np.int64))],
                    names=["lang", "phrase", "words", "a"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows < ROUTED_ROWS:
                continue
            table = pa.Table.from_batches(held)
            route = table.column("route").to_numpy()
            cut = int(np.searchsorted(route, route[-1], "left"))
            if cut:
                yield from counted(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            rows = len(table) - cut
        if rows:
            yield from counted(pa.Table.from_batches(held))

    return run


def phrase_counts(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(words(lang, word, f), phrases(lang, phrase, words, a)) with counts of at least ``least``; words has a row (lang, null, n) per
    language with all its word occurrences.

    Texts are lower-cased in A-Z and split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those at spaces and tabs into words; phrases
    stay in a piece. A null text is empty, a null language is ``und``, repeated rows all count, an empty table gives no rows. Columns
    other than ``lang`` and ``text`` don't matter.
    """
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    counted = texts.mapInArrow(_word_counts, "lang string, word binary, slot long, c long")
    every = counted.groupBy("lang", "word").agg(F.sum("c").alias("f"), F.first("slot").alias("slot"))
    kept = F.when(F.col("f") >= least, F.col("word"))
    known = durable(every.groupBy("lang", kept.alias("word")).agg(F.sum("f").alias("f"), F.sum(F.when(F.col("f") >= least, F.col("slot"))).alias("slot")))
    words = context.broadcast(_filter(known.filter("word IS NOT NULL")))

    def pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            pair, counts = np.unique(shard.frequent_pairs(words.value)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64)), pa.array(counts.astype(np.int64))], names=["pair", "c"])

    pairs = durable(texts.mapInArrow(pair_counts, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).filter(F.col("c") >= least))
    total = pairs.agg(F.sum("c")).first()[0] or 0
    hot = [r.pair for r in pairs.filter(F.col("c") * HOT_PARTS > total).select("pair").collect()]
    hot = np.array(hot, np.int64).view(np.uint64)
    slot = F.shiftrightunsigned("pair", 8).bitwiseAND(F.lit(FILTER_BITS - 1)).alias("slot")
    leading = context.broadcast(_filter(pairs.select(slot)))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            if len(shard.ids):
                yield _suffix_rows(shard, words.value, leading.value, hot)

    shipped = texts.mapInArrow(suffixes, "route long, spread boolean, lang string, suffix binary, c long")
    routed = shipped.repartition("route").sortWithinPartitions("route")
    partial = routed.mapInArrow(_routed(least), "lang string, phrase binary, words int, a long")
    phrases = partial.groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)
    totals = known.groupBy("lang").agg(F.lit(None).cast("string").alias("word"), F.sum("f").alias("f"))
    text = known.filter("word IS NOT NULL").select("lang", F.col("word").cast("string").alias("word"), "f")
    return text.unionByName(totals), durable(phrases.withColumn("phrase", F.col("phrase").cast("string")))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase's score is the lowest of ``floor(2000000 a / (l + r))`` over its cuts into a first and a last part with counts l and r
    (ties: the shortest first part). Phrases inside a longer candidate with at least 80 % of their count are dropped. In order of
    score, then count, descending, then phrase by its bytes. Parts of a frequent phrase are frequent, so every count is at hand.
    """
    words, phrases = phrase_counts(docs, least)
    counts = phrases.filter(F.col("words") < DEPTH).select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")).unionByName(
        words.filter("word IS NOT NULL").select("lang", F.col("word").alias("part"), "f")
    )
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    halves = phrases.select("lang", "phrase", "words", "a", F.split("phrase", " ").alias("w"), cut).select(
        "lang", "phrase", "words", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("right"),
    )
    left = counts.select("lang", F.col("part").alias("left"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("part").alias("right"), F.col("f").alias("r"))
    exact = F.expr("CAST((CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0))) DIV CAST(l + r AS DECIMAL(20,0)) AS BIGINT)")
    scored = halves.join(left, ["lang", "left"]).join(right, ["lang", "right"]).withColumn("score", exact)
    best = scored.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    inner = F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("words") - 1),
        lambda size: F.transform(F.sequence(F.lit(1), F.col("words") - size + 1), lambda i: F.array_join(F.slice("w", i, size), " ")),
    ))).alias("phrase")
    covering = phrases.filter(F.col("words") > 2).select("lang", "a", "words", F.split("phrase", " ").alias("w")).select("lang", "a", inner)
    above = covering.groupBy("lang", "phrase").agg(F.max("a").alias("above"))
    kept = best.join(above, ["lang", "phrase"], "left").filter(
        F.col("above").isNull() | (F.col("above") * 100 < F.col("a") * COVERED_PERCENT)
    )
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    flat = kept.select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score"))
    ranked = flat.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    totals = words.filter("word IS NULL").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

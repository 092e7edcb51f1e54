"""Removal of long repeated byte strings across all documents, by sparse suffix sorting.

A window of ``LENGTH`` bytes is represented by its anchor, the place of its least 16-byte hash. Equal windows have equal
anchors at equal distances, so only windows around equal anchors need comparing, and neighbouring windows mostly share
an anchor: about one place in ninety is an anchor. The bytes of all windows of an anchor are its segment.

1. Anchors that occur once leave. Equal segments (by hash) become one with a count; a count of two or more settles
   all their windows. Exact copies of documents never go further than this.
2. Where an anchor has different segments, their bytes are brought together and all their windows sorted by
   deep-shallow suffix sorting; windows that fall together are repeats. An anchor with very many segments is dealt out
   over several groups, and windows without an equal in their own group are compared across groups by 128-bit hash.
3. Settled windows go back to all places of their segments and are joined to spans per document.

Nothing larger than a piece of segments is in one task; hot anchors are salted and counts are combined on the map side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doseweave.llm.common import durable, map_texts
from doseweave.llm.suffix_sorting import big_endian_words, equal_classes

LENGTH = 200
GRAM = 16
#: Segments of one anchor that are sorted in one group.
GROUP = 2048
#: Bytes of texts or segments worked on at a time.
PIECE = 1 << 20


def anchors(data: bytes, ends: np.ndarray, length: int = LENGTH):
    """Anchors of all windows of the documents that end at ``ends``: place, first and last window start, hash."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, np.zeros(0, np.uint64)
    words = big_endian_words(data)
    mixed = words[:-8] * np.uint64(0x9E3779B97F4A7C15) ^ (words[8:] ^ (words[8:] >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    low, at = mixed[: len(data) - GRAM + 1], np.arange(len(data) - GRAM + 1)
    gram_hash, span, wanted = low, 1, length - GRAM + 1
    while span < wanted:
        step = min(span, wanted - span)
        left = low[:-step] <= low[step:]
        low, at = np.where(left, low[:-step], low[step:]), np.where(left, at[:-step], at[step:])
        span += step
    sizes = np.diff(np.r_[0, ends])
    inside = np.repeat(ends, sizes)[: len(at)] >= np.arange(len(at)) + length
    windows = np.flatnonzero(inside)
    if not len(windows):
        return none, none, none, np.zeros(0, np.uint64)
    place = at[windows]
    new = np.flatnonzero(np.r_[True, (np.diff(place) != 0) | (np.diff(windows) != 1)])
    last = windows[np.r_[new[1:] - 1, len(windows) - 1]]
    return place[new], windows[new], last, gram_hash[place[new]]


def segments(docs: DataFrame) -> DataFrame:
    """One row per anchor of every text: ``anchor``, ``seg`` (hash of its segment), ``c``, ``pos``, ``lo`` and ``n``.

    The windows of the anchor start at ``pos - lo`` and the ``n - 1`` places after it.
    """

    def work():
        def step(texts: list[bytes]) -> dict[str, list]:
            data, ends = b"".join(texts), np.cumsum([len(t) for t in texts])
            place, first, last, key = anchors(data, ends)
            view, digest = memoryview(data), xxhash.xxh3_64_intdigest
            seg = np.array([digest(view[a : b + LENGTH], p - a) for p, a, b in zip(place.tolist(), first.tolist(), last.tolist(), strict=True)], np.uint64)
            owner = np.searchsorted(ends, place, "right")
            start = np.r_[0, ends][owner]
            grid = np.rec.fromarrays([key.view(np.int64), seg.view(np.int64), place - start, place - first, last - first + 1], names="anchor,seg,pos,lo,n")
            cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
            return {f: [grid[f][a:b] for a, b in zip(cuts, cuts[1:], strict=False)] for f in ("anchor", "seg", "pos", "lo", "n")}

        return step

    added = "anchor array<long>, seg array<long>, pos array<long>, lo array<long>, n array<long>"
    made = map_texts(docs.select("c", "text"), work, added, keep=["c"], piece=PIECE)
    rows = made.select("c", F.explode(F.arrays_zip("anchor", "seg", "pos", "lo", "n")).alias("x"))
    return rows.select("x.anchor", "x.seg", "c", F.col("x.pos").cast("int").alias("pos"), F.col("x.lo").cast("short").alias("lo"), F.col("x.n").cast("short").alias("n"))


def _segment_bytes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Adds the bytes of the wanted segments (``anchor``, ``seg``, ``salt``, ``c``, ``pos``, ``lo``, ``n``) from one document of each content."""
    lists = wanted.groupBy("c").agg(F.collect_list(F.struct("anchor", "seg", "salt", "pos", "lo", "n")).alias("want"))
    one = docs.groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id")).alias("k")).select("c", "k.doc_id")
    pick = lists.join(one, "c").select("want", F.xxhash64("c", "doc_id").alias("row"))
    joined = docs.select(F.xxhash64("c", "doc_id").alias("row"), "text").join(pick, "row")
    cut = F.transform(
        F.col("want"),
        lambda w: F.struct(
            w["anchor"].alias("anchor"), w["seg"].alias("seg"), w["salt"].alias("salt"), w["lo"].alias("lo"),
            F.substring(F.col("text"), (w["pos"] - w["lo"] + 1).cast("int"), (w["n"] + LENGTH - 1).cast("int")).alias("bytes"),
        ),
    )
    return joined.select(F.explode(cut).alias("x")).select("x.*")


def _sorted_windows(parts: DataFrame) -> DataFrame:
    """Deep-shallow sort of the windows of each (anchor, salt) group.

    Gives per segment ``first`` and ``last``: runs of window starts, relative to the anchor, that are repeated in the
    group, and for salted anchors ``open``: the hash, start and state of one window of each distinct string.
    """
    schema = "anchor long, seg long, first array<long>, last array<long>, open array<struct<hash:binary,at:long,settled:boolean>>"
    placed = parts.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")

    def sort_piece(rows: list[tuple]) -> pa.RecordBatch:
        rows = list({(r[0], r[1]): r for r in rows}.values())
        data = b"".join(r[4] for r in rows)
        sizes = np.array([len(r[4]) for r in rows])
        begin = np.cumsum(sizes) - sizes
        windows = sizes - LENGTH + 1
        owner = np.repeat(np.arange(len(rows)), windows)
        starts = begin[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        equal, name = equal_classes(big_endian_words(data), starts, LENGTH)
        hit = np.zeros(len(data), bool)
        hit[equal] = True
        repeat = hit[starts]
        edge = np.r_[0, np.cumsum(windows)]
        again = np.zeros(len(data), bool)
        if len(equal):
            keep = np.unique(name, return_index=True)[1]
            again[equal] = True
            again[equal[keep]] = False
        out = {"anchor": [], "seg": [], "first": [], "last": [], "open": []}
        for i, (anchor, seg, salt, lo, text) in enumerate(rows):
            flags = repeat[edge[i] : edge[i + 1]]
            change = np.flatnonzero(np.diff(np.r_[False, flags, False]))
            out["anchor"].append(anchor)
            out["seg"].append(seg)
            out["first"].append((change[::2] - lo).tolist())
            out["last"].append((change[1::2] - 1 - lo).tolist())
            if salt is None:
                out["open"].append(None)
            else:
                own = starts[edge[i] : edge[i + 1]]
                out["open"].append([{"hash": xxhash.xxh3_128_digest(text[k : k + LENGTH]), "at": k - lo, "settled": bool(flags[k])} for k in range(len(flags)) if not again[own[k]]])
        window = pa.struct([("hash", pa.binary()), ("at", pa.int64()), ("settled", pa.bool_())])
        types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(window)]
        return pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in zip(out, types, strict=True)], names=list(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size, group = [], 0, None
        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if size > PIECE and (row[0], row[2]) != group:
                    yield sort_piece(waiting)
                    waiting, size = [], 0
                group = (row[0], row[2])
                waiting.append(row)
                size += len(row[4])
        if waiting:
            yield sort_piece(waiting)

    return placed.select("anchor", "seg", "salt", "lo", F.col("bytes")).mapInArrow(run, schema)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``c`` and ``spans``: the byte spans of its content that are repeated, for contents with any.

    ``docs``: ``doc_id``, ``text`` (binary, not null) and ``c``, the 64-bit hash of the text.
    """
    rows = segments(docs)
    several = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("anchor")
    shared = durable(
        rows.join(several, "anchor", "left_semi").groupBy("anchor", "seg", "c", "pos", "lo", "n").agg(F.count(F.lit(1)).alias("k"))
    )
    place = F.struct("c", "pos", "lo", "n")
    kinds = durable(shared.groupBy("anchor", "seg").agg(F.sum("k").alias("k"), F.min(place).alias("at")))
    split = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    salt = F.when(F.col("m") > GROUP, F.pmod(F.col("seg"), F.ceil(F.col("m") / GROUP)).cast("int"))
    wanted = kinds.join(split, "anchor").select("anchor", "seg", salt.alias("salt"), "at.*")
    ordered = durable(_sorted_windows(_segment_bytes(docs, wanted)))
    open_rows = ordered.filter("open IS NOT NULL").select("anchor", "seg", F.explode("open").alias("w")).select("anchor", "seg", "w.*")
    elsewhere = open_rows.groupBy("hash").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("hash")
    across = open_rows.filter("NOT settled").join(elsewhere, "hash", "left_semi").select("anchor", "seg", F.col("at").alias("s"), F.col("at").alias("e"))
    inside = ordered.select("anchor", "seg", F.explode(F.arrays_zip("first", "last")).alias("x")).select("anchor", "seg", F.col("x.first").alias("s"), F.col("x.last").alias("e"))
    whole = kinds.filter("k > 1").select("anchor", "seg", (-F.col("at.lo")).cast("long").alias("s"), (F.col("at.n") - 1 - F.col("at.lo")).cast("long").alias("e"))
    runs = whole.union(inside.join(whole, ["anchor", "seg"], "left_anti")).union(across)
    spans = shared.join(runs, ["anchor", "seg"]).select("c", F.struct((F.col("pos") + F.col("s")).alias("s"), (F.col("pos") + F.col("e") + LENGTH).alias("e")).alias("x"))
    return spans.groupBy("c").agg(F.collect_list("x").alias("spans"))


def deduplicated_bytes(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``kept`` (the bytes that stay), ``n_bytes``, ``n_removed`` and ``n_spans``.

    A byte goes if a string of ``LENGTH`` bytes around it also starts anywhere else, judged on the input. Matches stay
    inside a document's bytes. Null and short texts lose nothing; all equal copies of a long enough text lose
    everything. Rows with the same id are documents of their own.
    """
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    docs = docs.select(F.col("doc_id"), text.alias("text")).withColumn("c", F.xxhash64("text"))
    spans = durable(repeated_spans(docs))
    joined = docs.join(spans, "c", "left").select("doc_id", "text", _flat(F.col("spans")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed, runs = [], [], []
            for text, flat in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                pairs = np.array(flat or [], np.int64).reshape(-1, 2)
                pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                reach = np.maximum.accumulate(pairs[:, 1]) if len(pairs) else pairs[:, 1]
                cut = np.flatnonzero(pairs[1:, 0] > reach[:-1])
                begin = pairs[np.r_[0, cut + 1], 0].tolist() if len(pairs) else []
                end = reach[np.r_[cut, len(reach) - 1]].tolist() if len(pairs) else []
                kept.append(b"".join(text[a:b] for a, b in zip([0, *end], [*begin, len(text)], strict=True)))
                removed.append(sum(end) - sum(begin))
                runs.append(len(begin))
            sizes = [len(k) + r for k, r in zip(kept, removed, strict=True)]
            arrays = [batch.column(0), pa.array(kept, pa.binary()), *[pa.array(x, pa.int64()) for x in (sizes, removed, runs)]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, kept binary, n_bytes long, n_removed long, n_spans long")


def _flat(spans: Column) -> Column:
    return F.flatten(F.transform(spans, lambda x: F.array(x["s"], x["e"])))


def brute_force(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, str]]:
    """Reference form over a few texts: bytes removed, spans and SHA-256 of what stays."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out

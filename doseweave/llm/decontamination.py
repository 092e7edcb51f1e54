"""Benchmark decontamination with suffix arrays over the training words.

Each piece of the training documents (a shard of a few MB) becomes one sequence of word numbers with a gap between
documents. Its suffixes are sorted to the depth of a window; every suffix of every benchmark item is then found in
this array by binary search, and the interval it falls on is all its places, in all documents of the shard. Suffixes
that leave the benchmark's vocabulary before the shortest window ends can't match and aren't sorted.

The benchmark comes in blocks of bounded size, each a broadcast of its own; one pass over the texts looks into several of
them. A text goes to Python once per pass and never comes back; documents aren't shuffled.
"""

from __future__ import annotations

import hashlib
import math
import re
from itertools import batched, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doseweave.llm.common import with_texts

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 13
#: Bytes of benchmark text per broadcast block, and blocks of a pass.
BLOCK_BYTES = 1 << 20
PASS_BLOCKS = 8


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text with A-Z lower-cased."""
    return WORD.findall(text.lower())


class Suffixes:
    """All distinct windows of a block of benchmark items, as keys for the binary search."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        self.names = sorted({item for item, _ in items})
        number, place = self.vocabulary, {name: i for i, name in enumerate(self.names)}
        keys, lengths, owners, follows = [np.zeros(0, f"S{4 * window}")], [], [], []
        for item, text in items:
            ids = np.array([number.setdefault(w, len(number) + 1) for w in words_of(text)], np.int64)
            if not len(ids):
                continue
            length = min(window, len(ids))
            grid = np.zeros((len(ids) - length + 1, window), ">u4")
            grid[:, :length] = np.lib.stride_tricks.sliding_window_view(ids, length)
            keys.append(_rows(grid))
            lengths += [length] * len(grid)
            owners += [place[item]] * len(grid)
            follows += [False] + [True] * (len(grid) - 1)
        self.low, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        count = len(self.low)
        self.lengths = np.array(lengths, np.int64)[first]
        # Words after the end of a short window may be anything.
        self.short = np.flatnonzero(self.lengths < window)
        high = self.low[self.short].view(">u4").reshape(-1, window).copy() if len(self.short) else np.zeros((0, window), ">u4")
        high[high == 0] = 0xFFFFFFFF
        self.high = _rows(high)
        pairs = np.unique(at * max(len(self.names), 1) + np.array(owners, np.int64)) if count else np.zeros(0, np.int64)
        self.held, self.item = np.divmod(pairs, max(len(self.names), 1))
        self.begin = np.searchsorted(self.held, np.arange(count + 1))
        after = np.flatnonzero(np.array(follows, bool))
        self.steps = np.unique(at[after - 1] * count + at[after]) if count else np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.low)

    def items_of(self, windows: np.ndarray) -> list[str]:
        """Sorted names of the items that hold any of the windows."""
        found = [self.item[self.begin[w] : self.begin[w + 1]] for w in np.unique(windows)]
        return [self.names[i] for i in np.unique(np.concatenate(found))] if found else []


def _rows(grid: np.ndarray) -> np.ndarray:
    """Rows of big-endian numbers as byte strings, which compare like the rows."""
    return np.ascontiguousarray(grid).view(f"S{4 * grid.shape[1]}").ravel()


def shard_matches(texts: list[bytes], tests: Suffixes):
    """Word counts and starts of the texts, and each place (word position, window number) of a benchmark window."""
    counts, parts, get = [], [], tests.vocabulary.get
    for text in texts:
        words = words_of(text)
        counts.append(len(words))
        parts += [np.fromiter(map(get, words, repeat(0)), np.int64, len(words)), np.zeros(1, np.int64)]
    counts = np.array(counts, np.int64)
    starts = np.cumsum(counts + 1) - counts - 1
    none = np.zeros(0, np.int64)
    if not len(tests) or not counts.sum():
        return counts, starts, none, none
    ids = np.concatenate([*parts, np.zeros(tests.window, np.int64)])
    gaps = np.flatnonzero(ids == 0)
    known = np.flatnonzero(ids)
    reach = gaps[np.searchsorted(gaps, known)] - known
    known = known[reach >= tests.lengths.min()]
    keys = _rows(ids[known[:, None] + np.arange(tests.window)].astype(">u4"))
    order = np.argsort(keys, kind="stable")
    array = keys[order]
    first = np.searchsorted(array, tests.low, "left")
    last = np.searchsorted(array, tests.low, "right")
    last[tests.short] = np.searchsorted(array, tests.high, "right")
    found = last - first
    window = np.repeat(np.arange(len(found)), found)
    inside = np.arange(len(window)) - np.repeat(np.cumsum(found) - found, found)
    return counts, starts, known[order[first[window] + inside]], window


def _spans(begin: np.ndarray, end: np.ndarray) -> tuple[list[int], list[int]]:
    """Union of half-open spans."""
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    cut = np.flatnonzero(begin[1:] > reach[:-1])
    return begin[np.r_[0, cut + 1]].tolist(), reach[np.r_[cut, len(reach) - 1]].tolist()


def _longest(place: np.ndarray, window: np.ndarray, tests: Suffixes) -> int:
    """Words of the longest run of places at which each window follows the one before in a benchmark item."""
    order = np.lexsort((window, place))
    place, window = place[order], window[order]
    full = tests.lengths[window] == tests.window
    best = int(tests.lengths[window].max())
    place, window = place[full], window[full]
    if len(place):
        step = window[:-1] * len(tests) + window[1:]
        at = np.minimum(np.searchsorted(tests.steps, step), max(len(tests.steps) - 1, 0))
        linked = (np.diff(place) == 1) & ((tests.steps[at] == step) if len(tests.steps) else False)
        breaks = np.flatnonzero(np.r_[True, ~linked, True])
        best = max(best, int(np.diff(breaks).max()) - 1 + tests.window)
    return best


def _blocks(bench: DataFrame, block_bytes: int, window: int):
    """Blocks of whole items by a hash of the id; each is collected alone."""
    named = bench.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"),
    )
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, math.ceil(total / block_bytes))
    for block in range(count):
        rows = named.filter(F.pmod(F.xxhash64("item"), F.lit(count)) == block) if count > 1 else named
        yield Suffixes([(r.item, bytes(r.text)) for r in rows.collect()], window)


def benchmark_hits(
    docs: DataFrame, bench: DataFrame, keep=None, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Per document row: its columns plus the words that benchmark windows cover.

    Added: ``n_words``, ``n_hit`` (words inside a window), ``hit_starts`` and ``hit_ends`` (maximal covered word
    spans, end exclusive), ``hit_items`` (ids as strings, sorted) and ``longest`` (words of the longest verbatim match).
    A window is ``window`` consecutive words of an item; an item of fewer, but not none, is one window. Null texts
    have no words, a null item id counts as an empty one, rows with the same item id are one item. An empty table or
    benchmark gives no hits. Columns of ``docs`` with the added names are replaced.
    """
    context = docs.sparkSession.sparkContext
    names = {"n_words", "n_hit", "hit_starts", "hit_ends", "hit_items", "longest"}
    wanted = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names and not c.startswith("_")]
    found = docs.select(*[f"`{c}`" for c in wanted], F.col("text").alias("_text"))
    passes = 0
    for blocks in batched(_blocks(bench, block_bytes, window), PASS_BLOCKS):
        shared = [context.broadcast(tests) for tests in blocks]

        def work(shared=shared):
            return lambda texts: _pass_hits(texts, [s.value for s in shared])

        found = with_texts(found, work, "n_words long, b array<long>, e array<long>, items array<string>, longest long", f"_hits{passes}", "_text")
        passes += 1
    hits = [F.col(f"_hits{p}") for p in range(passes)]
    spans = [F.arrays_zip(h["b"].alias("b"), h["e"].alias("e")) for h in hits]
    merged = F.aggregate(
        F.array_sort(F.flatten(F.array(*spans))),
        F.array().cast("array<struct<b:bigint,e:bigint>>"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (x["b"] <= F.element_at(done, -1)["e"]),
            F.concat(
                F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
                F.array(F.struct(F.element_at(done, -1)["b"].alias("b"), F.greatest(F.element_at(done, -1)["e"], x["e"]).alias("e"))),
            ),
        ).otherwise(F.concat(done, F.array(F.struct(x["b"].alias("b"), x["e"].alias("e"))))),
    )
    table = found.withColumn("_merged", merged if passes > 1 else spans[0])
    return table.select(
        *[f"`{c}`" for c in wanted], hits[0]["n_words"].alias("n_words"),
        F.aggregate("_merged", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["b"]).alias("n_hit"),
        F.col("_merged")["b"].alias("hit_starts"), F.col("_merged")["e"].alias("hit_ends"),
        F.array_sort(F.array_distinct(F.flatten(F.array(*[h["items"] for h in hits])))).alias("hit_items"),
        F.greatest(F.lit(0), *[h["longest"] for h in hits]).cast("long").alias("longest"),
    ).to(_schema(docs, wanted, "n_words long, n_hit long, hit_starts array<long>, hit_ends array<long>, hit_items array<string>, longest long"))


def _pass_hits(texts: list[bytes], blocks: list[Suffixes]) -> dict[str, list]:
    """Word counts, covered spans, items and longest match of each text over several blocks."""
    n = len(texts)
    begins, ends, items, longest = ([[] for _ in range(n)] for _ in range(4))
    for tests in blocks:
        counts, starts, place, at = shard_matches(texts, tests)
        owner = np.searchsorted(starts, place, "right") - 1
        order = np.argsort(owner, kind="stable")
        owner, place, at = owner[order], place[order], at[order]
        cuts = np.flatnonzero(np.diff(owner)) + 1
        for p, w, doc in zip(np.split(place, cuts), np.split(at, cuts), owner[np.r_[0, cuts]] if len(owner) else [], strict=False):
            p = p - starts[doc]
            b, e = _spans(p, p + tests.lengths[w])
            begins[doc] += b
            ends[doc] += e
            items[doc] += tests.items_of(w)
            longest[doc].append(_longest(p, w, tests))
    for doc in range(n if len(blocks) > 1 else 0):
        if begins[doc]:
            begins[doc], ends[doc] = _spans(np.array(begins[doc]), np.array(ends[doc]))
            items[doc] = sorted(set(items[doc]))
    return {"n_words": counts.tolist(), "b": begins, "e": ends, "items": items, "longest": [max(x, default=0) for x in longest]}


def _schema(docs: DataFrame, base: list[str], added: str):
    from pyspark.sql.types import StructType

    return StructType([*[docs.schema[c] for c in base], *StructType.fromDDL(added).fields])


def is_contaminated(share: int = 20):
    """Whether the covered words are any, and at least one in ``share``."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))


def decontaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with its columns."""
    names = {"n_words", "n_hit", "hit_starts", "hit_ends", "hit_items", "longest"}
    clash = [c for c in docs.columns if c.lower() in names or c.startswith("_")]
    safe = docs.withColumnsRenamed({c: f"carried:{c}" for c in clash})
    kept = benchmark_hits(safe, bench).filter(~is_contaminated())
    return kept.select(*[F.col(f"`carried:{c}`" if c in clash else f"`{c}`").alias(c) for c in docs.columns])


def items_digest(items: list[str]) -> str:
    """Reference form of the digest of item ids: comma-joined, as lower-case hexadecimal SHA-256."""
    return hashlib.sha256(",".join(items).encode()).hexdigest()

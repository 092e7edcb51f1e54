"""Quality rules from a suffix array over a text's words.

The suffix arrays of all documents of a batch are built together by prefix doubling: words are numbered per document,
so suffixes of two documents differ from their first word on, and only groups that are still equal are sorted again.
Neighbours in the array give the longest common prefixes; their intervals are the maximal repeated word strings. The
union of the repeats' spans and the longest repeat are limited.
"""

from __future__ import annotations

from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doseweave.llm.common import map_texts

#: Words from which on a repeated string counts.
LEAST_REPEAT = 5
#: Verdict: no more than this share of the words' bytes in repeats, below the base rule's fifth of the words, and no repeat
#: above these words, which is a paragraph.
MOST_COVERED = 0.15
MOST_WORDS = 100
SYMBOLS = b"#*$%&|<>"


def longest_repeats(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For every word position the length of the longest word string from there that its document has again.

    ``words`` are numbers, ``lengths`` the word counts of the documents one after the other.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    ends = np.cumsum(lengths)[owner]
    rank = np.unique(owner * (int(words.max()) + 1) + words, return_inverse=True)[1].astype(np.int64) + 1
    sizes = np.bincount(rank)
    # ranks are places of a group's first member, so that groups that split keep their order among the others
    rank = (np.cumsum(sizes) - sizes)[rank] + 1
    levels, step = [rank], 1
    active = np.flatnonzero(np.bincount(rank, minlength=n + 2)[rank] > 1)
    while len(active):
        after = active + step
        follow = np.where(after < ends[active], rank[np.minimum(after, n - 1)], 0)
        order = np.lexsort((follow, rank[active]))
        place, head, tail = active[order], rank[active][order], follow[order]
        new_head = np.r_[True, head[1:] != head[:-1]]
        new = new_head | np.r_[True, tail[1:] != tail[:-1]]
        at = np.arange(len(order))
        first = np.maximum.accumulate(np.where(new, at, 0))
        base = np.maximum.accumulate(np.where(new_head, at, 0))
        rank = rank.copy()
        rank[place] = head + first - base
        levels.append(rank)
        alone = new & np.r_[new[1:], True]
        active = place[~alone]
        step *= 2
    array = np.empty(n, np.int64)
    array[rank - 1] = np.arange(n)
    a, b = array[:-1].copy(), array[1:].copy()
    end_a, end_b, common = ends[a], ends[b], np.zeros(n - 1, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        same = np.flatnonzero((a < end_a) & (b < end_b))
        same = same[levels[level][a[same]] == levels[level][b[same]]]
        common[same] += 1 << level
        a[same] += 1 << level
        b[same] += 1 << level
    best = np.zeros(n, np.int64)
    np.maximum.at(best, array[:-1], common)
    np.maximum.at(best, array[1:], common)
    return best


def _covered(best: np.ndarray, least: int) -> np.ndarray:
    """Which words lie in a repeat of at least ``least`` words."""
    start = np.flatnonzero(best >= least)
    change = np.zeros(len(best) + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + best[start], -1)
    return np.cumsum(change[:-1]) > 0


def text_measures(texts: list[bytes], least: int = LEAST_REPEAT) -> dict[str, list]:
    split = [t.split() for t in texts]
    lengths = np.array([len(w) for w in split], np.int64)
    numbers: dict[bytes, int] = {}
    new = count()
    ids = np.fromiter((numbers[w] if w in numbers else numbers.setdefault(w, next(new)) for words in split for w in words), np.int64, int(lengths.sum()))
    size = np.fromiter((len(w) for words in split for w in words), np.int64, len(ids))
    best = longest_repeats(ids, lengths)
    covered = _covered(best, least)
    edge = np.r_[0, np.cumsum(lengths)]
    total = lambda values: np.diff(np.r_[0, np.cumsum(values)][edge])
    in_words, in_bytes, all_bytes = total(covered), total(covered * size), total(size)
    longest = [int(best[a:b].max()) if b > a else 0 for a, b in zip(edge, edge[1:], strict=False)]
    lines = [[line for line in t.split(b"\n") if line.strip()] for t in texts]
    return {
        "n_words": lengths.tolist(),
        "word_chars": [len(t.decode("utf-8", "replace")) - (len(t) - int(s)) for t, s in zip(texts, all_bytes, strict=True)],
        "n_symbols": [len(t) - len(t.translate(None, SYMBOLS)) for t in texts],
        "n_dup_lines": [len(x) - len(set(x)) for x in lines],
        "n_repeat_words": in_words.tolist(),
        "covered": (in_bytes / np.maximum(all_bytes, 1)).tolist(),
        "longest_repeat": longest,
    }


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judged(docs: DataFrame, keep=None, most_covered: float = MOST_COVERED, most_words: int = MOST_WORDS) -> DataFrame:
    """Every row of ``docs`` with its measures, ``base_failed`` and ``kept``.

    ``covered`` is the share of the words' bytes in repeats of ``LEAST_REPEAT`` words or more, ``longest_repeat`` the
    words of the longest repeat of any length. Null and empty texts have no words and fail. Columns of ``docs`` with
    the added names are replaced.
    """
    added = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered double, longest_repeat long"
    measured = map_texts(docs.drop("base_failed", "kept"), lambda: text_measures, added, keep=keep)
    good = ~F.col("base_failed") & (F.col("covered") <= most_covered) & (F.col("longest_repeat") <= most_words)
    return measured.withColumn("base_failed", base_failed()).withColumn("kept", good)

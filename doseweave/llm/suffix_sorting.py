"""Deep-shallow suffix sorting of many short byte strings at once, vectorised with NumPy.

Shallow: multikey quicksort on eight-byte characters; each step splits the groups that are still equal. Deep: a group
with a long common prefix goes into a blind trie. The node of a group holds only its branching depth, the least common
prefix with the group's first string, and strings are told apart by the one byte there, so no byte before it is read again.
All tries grow together, one level at a time.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 32


def big_endian_words(data: bytes) -> np.ndarray:
    """The eight bytes from every place on as one number that sorts like them; zeros follow the end."""
    words = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint64)
    for width in (1, 2, 4):
        words = (words[:-width] << np.uint64(8 * width)) | words[width:]
    return words[: len(data)]


def _split(order: np.ndarray, group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts each group by ``key`` and numbers the parts with equal keys; parts of one string are left out."""
    by = np.lexsort((key, group))
    order, group, key = order[by], group[by], key[by]
    new = np.r_[True, (group[1:] != group[:-1]) | (key[1:] != key[:-1])]
    several = ~(new & np.r_[new[1:], True])
    return order[several], np.cumsum(new)[several]


def equal_classes(words: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of ``starts`` whose next ``length`` bytes occur at another start, with a number per distinct string.

    Every start has ``length`` bytes behind it.
    """
    order, group = starts, np.zeros(len(starts), np.int64)
    shallow = min(SHALLOW, length // 8 * 8)
    for depth in range(0, shallow, 8):
        if not len(order):
            break
        order, group = _split(order, group, words[order + depth])
    depth, done, named, names = np.full(len(order), shallow), [], [], 0
    while len(order):
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[first, len(order)])
        leader = np.repeat(order[first], sizes)
        common = np.full(len(order), length)
        at, live = depth.copy(), np.flatnonzero(depth < length)
        while len(live):
            a, b = words[order[live] + at[live]], words[leader[live] + at[live]]
            differ = a ^ b
            hit = differ != 0
            if hit.any():
                x, rest = live[hit], differ[hit]
                same = sum((rest >> np.uint64(64 - 8 * k)) == 0 for k in range(1, 8))
                common[x] = np.minimum(at[x] + same, length)
            live = live[~hit]
            at[live] += 8
            live = live[at[live] < length]
        branch = np.minimum.reduceat(common, first)
        leaf = np.repeat(branch >= length, sizes)
        if leaf.any():
            done.append(order[leaf])
            number = np.repeat(np.arange(len(first)), sizes)[leaf]
            named.append(names + np.unique(number, return_inverse=True)[1])
            names = int(named[-1].max()) + 1
        rest = ~leaf
        order, group, branch = order[rest], group[rest], np.repeat(branch, sizes)[rest]
        if len(order):
            byte = words[order + branch] >> np.uint64(56)
            deep = np.zeros(int(order.max()) + 1, np.int64)
            deep[order] = branch
            order, group = _split(order, group, byte)
            depth = deep[order] + 1
            depth = np.minimum(depth, length)
    if not done:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(done), np.concatenate(named)

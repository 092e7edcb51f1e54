"""Words of many UTF-8 texts at once, by byte class: separators are ASCII, so no text has to be decoded."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Byte classes: part of a word, between words, and (for phrases) between pieces of a text.
LETTER, GAP, STOP = 0, 1, 2


def byte_classes(gaps: bytes, stops: bytes = b"") -> np.ndarray:
    """A table from byte to class; what is in neither list belongs to words."""
    table = np.zeros(256, np.uint8)
    table[list(gaps)] = GAP
    table[list(stops)] = STOP
    return table


def whole(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column without copying its texts; a null is an empty text."""
    if column.null_count:
        column = column.fill_null(b"")
    large = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    kind = np.int64 if large else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    data = column.buffers()[2]
    octets = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return octets[offsets[0] : offsets[-1]], offsets - offsets[0]


def _lowered() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


_LOWER = _lowered()


class Words:
    """The words of a batch of texts in order.

    ``ids`` numbers them by ``distinct`` (their bytes, A-Z lower-cased), ``owner`` has the text of each word and
    ``piece`` a number that changes wherever a stop or the end of a text stands between two words.
    """

    def __init__(self, octets: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        kinds = table[octets]
        inside = kinds == LETTER
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        # Two texts that touch without a separator: the word of each ends there.
        cuts = offsets[(offsets > 0) & (offsets < len(octets))]
        begins[cuts] = inside[cuts]
        ends[cuts - 1] = inside[cuts - 1]
        starts = np.flatnonzero(begins)
        bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.flatnonzero(ends) + 1 - starts)])
        letters = _LOWER[octets[inside]]
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(letters)])
        coded = words.dictionary_encode()
        self.distinct = coded.dictionary
        self.ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        per_text = np.diff(np.searchsorted(starts, offsets))
        self.owner = np.repeat(np.arange(len(per_text)), per_text)
        if (table == STOP).any():
            self.piece = np.cumsum(kinds == STOP, dtype=np.int32)[starts] + self.owner
        else:
            self.piece = self.owner

    def __len__(self) -> int:
        return len(self.ids)

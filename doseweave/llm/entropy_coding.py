"""Static range asymmetric numeral system over interleaved lanes, vectorised with NumPy.

A block is encoded alone. Its ids are dealt row by row to ``LANES`` lanes, each with a 63-bit state that passes 32-bit
words to one common stream. A checkpoint every ``EVERY`` rows holds all states and the place in the stream, so the
parts of a block decode side by side. The block's header has a checksum of its ids.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE = 18
LANES = 1024
EVERY = 128
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
HEADER = struct.Struct("<4sQHHBIII")
MAGIC = b"DWR1"


class FrequencyTable:
    """Frequencies of all ids that occur, scaled to a sum of 2**SCALE, each at least 1."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        order = np.argsort(ids)
        ids, counts = np.asarray(ids, np.int64)[order], np.asarray(counts, np.int64)[order]
        whole, total = 1 << SCALE, int(counts.sum())
        if len(ids) > whole:
            raise ValueError(f"more than {whole} different ids")
        size = int(ids.max()) + 1 if len(ids) else 1
        self.freq = np.zeros(size, np.uint64)
        if len(ids):
            shares = np.maximum(1, (counts.astype(np.float64) * (whole / total)).astype(np.int64))
            spare = whole - int(shares.sum())
            for i in np.argsort(-shares, kind="stable"):
                if spare >= 0:
                    shares[i] += spare
                    break
                give = min(int(shares[i]) - 1, -spare)
                shares[i] -= give
                spare += give
            self.freq[ids] = shares.astype(np.uint64)
        self.start = np.cumsum(self.freq) - self.freq
        self.filler = int(self.freq.argmax())
        self.symbol = np.repeat(np.arange(size, dtype=np.uint32), self.freq.astype(np.int64))
        #: Per slot the frequency of its symbol in the high half and its place among the symbol's slots in the low half.
        self.slots = (self.freq[self.symbol] << WORD) + np.arange(len(self.symbol), dtype=np.uint64) - self.start[self.symbol]


def encode(ids: np.ndarray, table: FrequencyTable) -> bytes:
    """One block as bytes."""
    ids = np.ascontiguousarray(ids, "<u4")
    rows = -(-len(ids) // LANES)
    grid = np.full(rows * LANES, table.filler, np.int64)
    grid[: len(ids)] = ids
    freq, start = table.freq[grid].reshape(rows, LANES), table.start[grid].reshape(rows, LANES)
    limit, scale = freq << np.uint64(63 - SCALE), np.uint64(SCALE)
    state, chunks, written, marks = np.full(LANES, LOW, np.uint64), [], 0, []
    for row in range(rows - 1, -1, -1):
        full = state >= limit[row]
        if full.any():
            chunks.append(state[full].astype(np.uint32))
            written += len(chunks[-1])
            state[full] >>= WORD
        quotient = state // freq[row]
        state = (quotient << scale) + (state - quotient * freq[row]) + start[row]
        if row % EVERY == 0:
            marks.append((written, state.copy()))
    words = np.concatenate(chunks[::-1]) if chunks else np.zeros(0, np.uint32)
    marks.reverse()
    places = np.array([written - w for w, _ in marks], "<u4")
    states = np.array([s for _, s in marks], "<u8")
    head = HEADER.pack(MAGIC, len(ids), LANES, EVERY, SCALE, len(marks), len(words), zlib.crc32(ids.tobytes()))
    return b"".join([head, places.tobytes(), states.tobytes(), words.astype("<u4").tobytes()])


def decode(block: bytes, table: FrequencyTable) -> np.ndarray:
    """The ids of one block; all its checkpoints advance together. A wrong checksum raises."""
    magic, count, lanes, every, scale_bits, parts, length, check = HEADER.unpack_from(block)
    if magic != MAGIC or scale_bits != SCALE:
        raise ValueError("not a block of this format")
    at = HEADER.size
    place = np.frombuffer(block, "<u4", parts, at).astype(np.int64)
    state = np.frombuffer(block, "<u8", parts * lanes, at + 4 * parts).astype(np.uint64).reshape(parts, lanes)
    words = np.frombuffer(block, "<u4", length, at + 4 * parts + 8 * parts * lanes).astype(np.uint64)
    rows = -(-count // lanes)
    grid = np.zeros((parts, every, lanes), np.uint32)
    scale, mask, half = np.uint64(SCALE), np.uint64((1 << SCALE) - 1), np.uint64((1 << 32) - 1)
    last = rows - (parts - 1) * every
    for step in range(every if parts > 1 else last if parts else 0):
        live = parts if step < last else parts - 1
        x = state[:live]
        grid[:live, step] = slot = x & mask
        found = table.slots.take(slot.view(np.int64))
        x >>= scale
        x *= found >> WORD
        x += found & half
        low = x < LOW
        taken = np.count_nonzero(low, axis=1)
        index = np.arange(taken.sum()) + np.repeat(place[:live] - taken.cumsum() + taken, taken)
        x[low] = (x[low] << WORD) | words[index]
        place[:live] += taken
    out = table.symbol[grid.reshape(-1)[:count]].astype("<u4")
    if zlib.crc32(out.tobytes()) != check:
        raise ValueError("checksum of a block doesn't match")
    return out

"""Whole Arrow batches of texts as one byte array, and the places of their words in it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values of a string or binary column, null as empty, and where each value starts and ends."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    values = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


def split(batch: pa.RecordBatch, column: int, limit: int = 4_000_000) -> list[pa.RecordBatch]:
    """The batch in pieces whose texts in ``column`` have about ``limit`` bytes, or are one text."""
    _, offsets = flat(batch.column(column))
    pieces, at = [], 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        pieces.append(batch.slice(at, end - at))
        at = end
    return pieces


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; no run crosses from one value into the next."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    before[edges] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[edges - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


class Eights:
    """The eight bytes from any place of a byte array as one number."""

    def __init__(self, data: np.ndarray):
        self.padded = np.concatenate([data, np.zeros(8, np.uint8)])
        self.view = np.ndarray((len(data) + 1,), "<u8", buffer=self.padded, strides=(1,))

    def head(self, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The first bytes of each run, at most eight."""
        short = np.minimum(lengths, 8).astype(np.uint64)
        keep = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * np.maximum(short, np.uint64(1)))
        return self.view[starts] & keep

    def tail(self, ends: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The last eight bytes of each run of more than eight, else 0."""
        return np.where(lengths > 8, self.view[np.maximum(ends - 8, 0)], np.uint64(0))


def mixed(head: np.ndarray, tail: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A well spread 64-bit number of head, tail and length."""
    h = (head + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h += (tail ^ lengths.astype(np.uint64)) * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))

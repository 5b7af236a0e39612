"""Vectorised access to the UTF-8 bytes of Arrow string columns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: A word of at most this many bytes is told apart by its bytes alone.
LANE = 16
_KEEP = np.where(np.arange(LANE)[None, :] < np.arange(LANE + 1)[:, None], 255, 0).astype(np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all input bits over all output bits (64-bit finaliser)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (one more than rows); nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_slices(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole texts.

    A run has at most ``most`` bytes unless one text alone has more.
    """
    data, offsets = string_buffers(column)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def short_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first 16 bytes of each span as two unsigned numbers (spans x 2), zeros after its end.

    Spans of up to 16 bytes without a zero byte are equal if and only if both numbers are.
    """
    padded = np.concatenate([data, np.zeros(LANE, np.uint8)])
    lanes = np.lib.stride_tricks.sliding_window_view(padded, LANE)[starts]
    lanes &= _KEEP[np.minimum(ends - starts, LANE)]
    return lanes.view("<u8")


class WordHash:
    """64-bit hashes of words under a secret: texts that don't know it can't be made to collide.

    Words of up to 16 bytes take two multilinear hashes of their 32-bit parts,
    which hold for any pair of words with the chance of 64 random bits; longer
    ones take keyed BLAKE2, remembered per call for those that repeat.
    """

    def __init__(self, secret: int):
        rng = np.random.default_rng(secret)
        self.factors = rng.integers(0, 1 << 63, (2, 6), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.key = rng.bytes(32)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        parts = short_spans(data, starts, ends).view("<u4")
        out = np.zeros(len(starts), dtype=np.uint64)
        for f in self.factors:
            h = f[4] * size.astype(np.uint64) + f[5]
            for k in range(4):
                h += f[k] * parts[:, k]
            out = (out << np.uint64(32)) | (h >> np.uint64(32))
        long = np.flatnonzero(size > LANE)
        if len(long):
            raw, seen = data.tobytes(), {}
            for i, a, b in zip(long.tolist(), starts[long].tolist(), ends[long].tolist(), strict=True):
                word = raw[a:b]
                if (h := seen.get(word)) is None:
                    h = seen[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=self.key).digest(), "little")
                out[i] = h
        return out


#: 0x20 and 0x09-0x0D separate words.
WORD_SPACE = np.zeros(256, dtype=bool)
WORD_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text of each) of the words of every text; no word spans texts."""
    solid = ~WORD_SPACE[data]
    begin, stop = solid.copy(), np.zeros(len(data) + 1, dtype=bool)
    begin[1:] &= ~solid[:-1]
    stop[1:] = solid
    stop[1:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    both = inner[solid[inner] & solid[inner - 1]]  # two texts meet without a space
    begin[both] = True
    stop[both] = True
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop)
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1

"""Exact byte-level BPE ids with a bounded per-worker memo.

Texts are cut into pre-tokens on their bytes, all at once; each distinct
pre-token is encoded once by the tokenizer's own model and a text's ids are its
pre-tokens' ids joined. The cut is the one that this tokenizer family's
pattern makes, for texts of ASCII and Latin-1 letters with single spaces or
line feeds between other characters. A stretch with an apostrophe stays one
piece and takes the library's whole path, and so does every other text.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import Broadcast
from pyspark.sql import SparkSession
from tokenizers import Tokenizer

from matchweave.llm.textbuf import LANE, mix, short_spans

_SPACE, _LINE, _LETTER, _DIGIT, _SIGN, _QUOTE, _OTHER = range(7)
_CLASS = np.full(256, _SIGN, dtype=np.uint8)
_CLASS[:32] = _OTHER
_CLASS[127] = _OTHER
_CLASS[[ord(" "), ord("\n"), ord("'")]] = _SPACE, _LINE, _QUOTE
for _lo, _hi, _kind in (("A", "Z", _LETTER), ("a", "z", _LETTER), ("0", "9", _DIGIT)):
    _CLASS[ord(_lo) : ord(_hi) + 1] = _kind
_CLASS[0x80:] = _LETTER
_WORKER: dict[tuple, object] = {}


def shipped(spark: SparkSession, path: str) -> Broadcast:
    """The bytes of a tokenizer's file, read on the driver and sent to the workers once."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def of_worker(kind: type, source: bytes):
    """One encoder of a kind per Python worker and tokenizer, kept between tasks."""
    key = kind, len(source), zlib.crc32(source)
    if key not in _WORKER:
        _WORKER[key] = kind(source)
    return _WORKER[key]


def plain_tokenizer(source: str | bytes) -> Tokenizer:
    """The tokenizer of a file or its bytes, without truncation and padding."""
    tokenizer = Tokenizer.from_buffer(source) if isinstance(source, bytes) else Tokenizer.from_file(source)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letters = {b: chr(b) for b in shown}
    for k, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + k)
    return [letters[b] for b in range(256)]


class Memo:
    """Distinct pieces' values in flat arrays; emptied when it holds so many entries or bytes.

    A piece of up to 16 bytes is looked for by a hash of its bytes and taken for
    known only if the bytes are the same; a longer one, and one whose hash another
    piece has, is looked for by its bytes in a dictionary.
    """

    def __init__(self, entries: int, most_bytes: int = 64 << 20):
        self.entries, self.most_bytes = entries, most_bytes
        self.clear()

    def clear(self) -> None:
        self.keys, self.slot = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
        self.bytes, self.named = np.zeros((0, 2), dtype=np.uint64), {}
        self.offset, self.values = np.zeros(1 << 12, dtype=np.int32), np.zeros(1 << 14, dtype=np.uint32)
        self.n = self.held = 0

    def add(self, values: list[list[int]]) -> np.ndarray:
        """Slots of new pieces' values."""
        flat = np.fromiter((x for v in values for x in v), dtype=np.uint32)
        lengths = np.fromiter(map(len, values), dtype=np.int32, count=len(values))
        used = int(self.offset[self.n])
        while len(self.offset) <= self.n + len(values) + 1:
            self.offset = np.concatenate([self.offset, np.zeros_like(self.offset)])
        while len(self.values) < used + len(flat):
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        self.values[used : used + len(flat)] = flat
        self.offset[self.n + 1 : self.n + 1 + len(values)] = used + np.cumsum(lengths)
        slots = np.arange(self.n, self.n + len(values), dtype=np.int32)
        self.n += len(values)
        self.held += flat.nbytes
        return slots

    def _short(self, lanes: np.ndarray, encode) -> np.ndarray:
        """Slots of short pieces, -1 where another piece has the same hash. ``encode`` takes positions."""
        hashes = mix(lanes[:, 0] ^ mix(lanes[:, 1] + np.uint64(1)))
        kinds, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, kinds)
        known = np.zeros(len(kinds), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == kinds[inside]
        slots = np.full(len(kinds), -1, dtype=np.int32)
        own = lanes[first]
        same = (self.bytes[at[known]] == own[known]).all(axis=1)
        slots[known] = np.where(same, self.slot[at[known]], -1)
        if not known.all():
            new = ~known
            slots[new] = self.add(encode(first[new]))
            self.slot = np.insert(self.slot, at[new], slots[new])
            self.keys, self.bytes = np.insert(self.keys, at[new], kinds[new]), np.insert(self.bytes, at[new], own[new], axis=0)
        return np.where((lanes == own[back]).all(axis=1), slots[back], -1)

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
        """All pieces' values joined, and each piece's number of values.

        ``encode`` gives the values of one piece's bytes. Pieces hold no zero byte.
        """
        if self.n + len(starts) > self.entries or self.held > self.most_bytes:
            self.clear()
        raw, slots = data.tobytes(), np.full(len(starts), -1, dtype=np.int32)
        short = np.flatnonzero(ends - starts <= LANE)
        if len(short):
            a, b = starts[short], ends[short]
            slots[short] = self._short(short_spans(data, a, b), lambda at: [encode(raw[x:y]) for x, y in zip(a[at].tolist(), b[at].tolist(), strict=True)])
        for i in np.flatnonzero(slots < 0).tolist():
            piece = raw[starts[i] : ends[i]]
            if (slot := self.named.get(piece)) is None:
                slot = self.named[piece] = int(self.add([encode(piece)])[0])
                self.held += len(piece)
            slots[i] = slot
        start, length = self.offset[slots].astype(np.int64), (self.offset[slots + 1] - self.offset[slots]).astype(np.int64)
        stop = np.cumsum(length)
        where = np.repeat(start - stop + length, length)
        where += np.arange(len(where))
        return self.values[where], length


class PieceEncoder:
    """Encodes runs of UTF-8 texts; ``entries`` bounds the memo's pre-tokens."""

    def __init__(self, source: str | bytes, entries: int = 400_000):
        self.tokenizer = plain_tokenizer(source)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.memo = Memo(entries)

    def _piece(self, piece: bytes) -> list[int]:
        if b"'" in piece:
            return self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids
        return [t.id for t in self.model.tokenize("".join([self.letters[b] for b in piece]))]

    def _plain(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Of each text: whether the vectorised cut is exact."""
        bad = kind == _OTHER
        blank = kind <= _LINE
        bad[1:] |= blank[1:] & blank[:-1]  # also across texts: only the slower path is taken then
        if len(data):
            lead = data >= 0xC0
            bad |= lead & (data != 0xC3)
            after = np.zeros(len(data), dtype=bool)
            after[1:] = data[:-1] == 0xC3
            bad |= after & ((data == 0x97) | (data == 0xB7))
        count = np.concatenate([[0], np.cumsum(bad)])
        plain = count[offsets[1:]] == count[offsets[:-1]]
        full = np.flatnonzero(offsets[1:] > offsets[:-1])
        plain[full] &= ~blank[offsets[full]] & ~blank[offsets[full + 1] - 1]
        whole = data.tobytes()
        for a in self.added:
            at = whole.find(a)
            while at >= 0:
                plain[np.searchsorted(offsets, at, side="right") - 1] = False
                at = whole.find(a, at + 1)
        return plain

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids joined (uint32) and the id offsets of the texts."""
        n = len(offsets) - 1
        kind = _CLASS[data]
        plain = self._plain(data, offsets, kind)
        kind = np.where(kind == _QUOTE, _SIGN, kind)
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[1:-1] = (kind[1:] != kind[:-1]) & (kind[:-1] != _SPACE) | (kind[1:] == _SPACE)
        cut[offsets] = True
        quotes = np.flatnonzero(data == ord("'"))
        if len(quotes):
            hard = np.flatnonzero(np.append((kind <= _LINE), True) | np.isin(np.arange(len(data) + 1), offsets))
            k = np.unique(np.searchsorted(hard, quotes, side="right") - 1)
            inside = np.zeros(len(data) + 2, dtype=np.int32)
            np.add.at(inside, hard[k] + 1, 1)
            np.add.at(inside, hard[k + 1], -1)
            keep = np.cumsum(inside)[: len(cut)] > 0
            keep[offsets] = False
            cut &= ~keep
        edges = np.flatnonzero(cut)
        starts, ends = edges[:-1], edges[1:]
        owner = np.searchsorted(offsets, starts, side="right") - 1
        use = plain[owner] if n else np.zeros(0, dtype=bool)
        starts, ends, owner = starts[use], ends[use], owner[use]
        raw = data.tobytes()
        ids, length = self.memo.look_up(data, starts, ends, self._piece)
        counts = np.bincount(owner, weights=length, minlength=n).astype(np.int64)
        slow = np.flatnonzero(~plain)
        if not len(slow):
            return ids, np.concatenate([[0], np.cumsum(counts)])
        parts, done = [], np.concatenate([[0], np.cumsum(counts)])
        found = self.tokenizer.encode_batch([raw[offsets[i] : offsets[i + 1]].decode() for i in slow], add_special_tokens=False)
        before = 0
        for i, x in zip(slow.tolist(), found, strict=True):
            parts += [ids[before : done[i]], np.asarray(x.ids, dtype=np.uint32)]
            before, counts[i] = done[i], len(x.ids)
        return np.concatenate([*parts, ids[before:]]), np.concatenate([[0], np.cumsum(counts)])

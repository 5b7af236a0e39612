"""BPE encoding with content-defined chunk reuse, and decoding.

A rolling hash over the bytes cuts every text where its content says so, so a
passage that many documents share falls into the same chunks in each of them. A
worker encodes a distinct chunk once and keeps its ids by pre-token. At each
joint of two chunks a window of pre-tokens on both sides is encoded again and
widened until its first pre-token is the left chunk's own and one inside the right
chunk is that chunk's own, with the same ids at the same place; then the ids in
between are the window's. If nothing agrees the window becomes the whole text.

A tokenizer that is known to cut at every blank needs no search: the pre-tokens
of two chunks agree from blank to blank, so there the window is the letters that
touch the joint. Texts that hold an added token go to the library whole.

Reuse is per worker and needs no shuffle: chunks sent to one common place
would move more bytes than the texts have.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchweave.llm.common import map_batches
from matchweave.llm.textbuf import WORD_SPACE, text_slices
from matchweave.llm.tokens import of_worker, plain_tokenizer, shipped

_GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)
_BLANKS = bytes(np.flatnonzero(WORD_SPACE).tolist())
#: Fixed value: a public pattern whose matches hold no blank and whose rest is dropped.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Ends (code points) and ids of pre-tokens, in order.
Units = list[tuple[int, bytes]]


def cuts_at_blanks(tokenizer) -> bool:
    """Whether a tokenizer surely splits at each blank and drops it: its pattern and normalizers are known ones."""
    rules = json.loads(tokenizer.to_str())
    steps = (rules["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
    first = steps[0].get("pattern") or {}
    split = first.get("Regex") == _WORD_PATTERN and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and all(s["type"] == "ByteLevel" and not s["use_regex"] and not s["add_prefix_space"] for s in steps[1:])
    known = lambda n: n["type"] in ("NFC", "Lowercase") or (n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " ")
    return bool(split) and all(map(known, (rules["normalizer"] or {}).get("normalizers") or [])) and rules["model"]["type"] == "BPE"


def chunk_cuts(data: np.ndarray, bits: int) -> np.ndarray:
    """Positions before which a chunk starts: where the hash of the last 32 bytes ends in ``bits`` zeros."""
    h = _GEAR[data]
    for k in range(5):
        far = 1 << k
        h[far:] += h[:-far] << np.uint32(far) if len(h) > far else h[:0]
    # a shift by 2**k doubles the window each time: byte i-j counts 2**j-fold
    at = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1
    at = at[at < len(data)]
    return at[(data[at] & 0xC0) != 0x80]


class ChunkEncoder:
    """``words`` and ``chunks`` bound the two memos; a full one is emptied. ``bits`` sets the mean chunk, 2**bits bytes.

    ``reused`` and ``encoded`` count chunks found in the memo and not.
    """

    def __init__(self, source: str | bytes, words: int = 300_000, chunks: int = 150_000, bits: int = 7):
        self.tokenizer = plain_tokenizer(source)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.limit, self.bits = (words, chunks), bits
        self.words: dict[bytes, bytes] = {}
        self.chunks: dict[bytes, tuple | None] = {}
        self.reused = self.encoded = 0
        self.at_blanks = cuts_at_blanks(self.tokenizer)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.written = [(self.tokenizer.id_to_token(k) or "").encode() for k in range(size)]

    def _library(self, text: bytes) -> bytes:
        return np.asarray(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()

    def word(self, word: bytes) -> bytes:
        """Ids of a stretch without blanks that stands between blanks."""
        if (ids := self.words.get(word)) is None:
            ids = self._library(word)
            if len(word) <= 64:
                if len(self.words) >= self.limit[0]:
                    self.words.clear()
                self.words[word] = ids
        return ids

    def known(self, chunk: bytes, make):
        """What ``make`` gives for a chunk, from the memo if it has it."""
        if chunk in self.chunks:
            self.reused += 1
            return self.chunks[chunk]
        self.encoded += 1
        found = make(chunk)
        if len(chunk) <= 2048:
            if len(self.chunks) >= self.limit[1]:
                self.chunks.clear()
            self.chunks[chunk] = found
        return found

    def parts(self, chunk: bytes) -> tuple[bytes, bytes, bytes] | None:
        """(letters before the first blank, ids of the middle, letters after the last blank); None without a blank."""
        inner = chunk.strip(_BLANKS)
        if len(inner) == len(chunk) and len(chunk.split(None, 1)) == 1:
            return None
        head = b"" if chunk[:1].isspace() else chunk.split(None, 1)[0]
        tail = b"" if chunk[-1:].isspace() else chunk.rsplit(None, 1)[-1]
        return head, b"".join(map(self.word, chunk[len(head) : len(chunk) - len(tail)].split())), tail

    def from_blank_to_blank(self, pieces: list[bytes]) -> bytes:
        """Ids of a text's chunks where the tokenizer cuts at blanks."""
        out, loose = [], b""
        for piece in pieces:
            if (found := self.known(piece, self.parts)) is None:
                loose += piece
                continue
            head, middle, tail = found
            if loose := loose + head:  # the joint is encoded again
                out.append(self.word(loose))
            out.append(middle)
            loose = tail
        if loose:
            out.append(self.word(loose))
        return b"".join(out)

    def units(self, text: str) -> Units:
        """The pre-tokens of a text as the library finds them."""
        found = self.tokenizer.encode(text, add_special_tokens=False)
        out: Units = []
        last = None
        for word, (_, end), number in zip(found.word_ids, found.offsets, found.ids, strict=True):
            own = number.to_bytes(4, "little")
            if word is None or word != last:
                out.append((end, own))
            else:
                out[-1] = (max(end, out[-1][0]), out[-1][1] + own)
            last = word
        return out

    def until_agreement(self, pieces: list[bytes]) -> bytes:
        """Ids of a text's chunks for any tokenizer, each joint encoded again in a window that widens until both sides agree."""
        text, done, at = b"".join(pieces).decode(), [], 0
        for piece in pieces:
            new = [(at + end, ids) for end, ids in self.known(piece, lambda chunk: self.units(chunk.decode()))]
            done = self.joined(text, done, new, at + len(piece.decode())) if at else new
            at += len(piece.decode())
        return b"".join(ids for _, ids in done)

    def joined(self, text: str, left: Units, right: Units, end: int) -> Units:
        """Units of ``text[:end]`` from those of a first part and of the chunk after it."""
        width = 2
        while True:
            i, j = max(0, len(left) - width), min(len(right), width)
            start = left[i - 1][0] if i else 0
            window = [(start + e, ids) for e, ids in self.units(text[start : right[j - 1][0] if j < len(right) else end])]
            if i == 0 or (len(window) > 1 and window[0] == left[i]):
                if j == len(right):
                    return left[:i] + window
                own = {unit: n for n, unit in enumerate(right[: j - 1])}
                for m, unit in enumerate(window[:-1]):
                    if (n := own.get(unit)) is not None and window[m:-1] == right[n : n + len(window) - 1 - m]:
                        return left[:i] + window[:m] + right[n:]
            width *= 2

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of every text."""
        raw, out = data.tobytes(), []
        cuts = chunk_cuts(data, self.bits)
        bounds = np.searchsorted(cuts, offsets)
        cuts = cuts.tolist()
        any_added = any(a in raw for a in self.added)
        join = self.from_blank_to_blank if self.at_blanks else self.until_agreement
        for k, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            if any_added and any(a in raw[lo:hi] for a in self.added):
                out.append(self._library(raw[lo:hi]))
                continue
            edges = [lo, *(c for c in cuts[bounds[k] : bounds[k + 1]] if c > lo), hi]
            out.append(join([raw[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]) if hi > lo else b"")
        return out

    def decode(self, ids: bytes) -> bytes:
        """The text of the ids, special tokens kept."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        if self.tokenizer.decoder is not None:
            return self.tokenizer.decode(numbers, skip_special_tokens=False).encode()
        return b" ".join(map(self.written.__getitem__, numbers))


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): each row's ids as little-endian unsigned 32-bit integers.

    Equal to the tokenizers library's ids of the whole text without special
    tokens, truncation and padding. Null and empty texts have no ids; repeated
    rows and null ids stay; other columns are ignored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = of_worker(ChunkEncoder, source.value)
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                ids = pa.array(encoder.encode(data, offsets), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), ids], names=["doc_id", "ids"])

    source = shipped(docs.sparkSession, tokenizer)
    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")), run, "doc_id long, ids binary")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids, decoded) from ``encode``'s rows: the text the library's decode gives. Null ids decode to the empty text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = of_worker(ChunkEncoder, source.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                text = pa.array([encoder.decode(x or b"") for x in part.column(1).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, text.cast(pa.string())], names=["doc_id", "ids", "decoded"])

    source = shipped(encoded.sparkSession, tokenizer)
    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, ids binary, decoded string")

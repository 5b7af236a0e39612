"""Sequence packing: shortest-pack-first over the length histogram.

Documents are tokenised once, cut into full sequences and a remainder, and only
the counts of piece lengths (at most ``sequence`` numbers) reach the driver.
There the lengths are placed longest first, always into the shortest pack, with
whole groups of equal packs moved together; the finished packing patterns are
joined back to the pieces by a piece's rank among those of its length: slots are
sorted by length and first rank, so each piece finds its own by one binary search.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchweave.llm.common import map_batches
from matchweave.llm.textbuf import text_slices
from matchweave.llm.tokens import PieceEncoder, of_worker, shipped
from matchweave.sources.scratch import scratch_table

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, tokenizer: str, sequence: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of at most ``sequence`` ids of every document.

    Null and empty texts hold ``end_id`` alone. Columns besides the id and the
    text are ignored.
    """

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = of_worker(PieceEncoder, source.value)
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                ids, at = encoder.encode(data, offsets)
                ids, rows = ids.astype("<u4"), ([], [], [], [], [])
                for k in range(hi - lo):
                    own = np.append(ids[at[k] : at[k + 1]], np.array([end_id], dtype="<u4"))
                    for start in range(0, len(own), sequence):
                        piece = own[start : start + sequence]
                        for column, value in zip(rows, (lo + k, start, len(piece), zlib.crc32(piece.tobytes()), len(own)), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows[0], pa.int64())), *(pa.array(c, pa.int64()) for c in rows[1:])],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )

    source = shipped(docs.sparkSession, tokenizer)
    return map_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), cut, PIECES)


def shortest_pack_first(histogram: dict[int, int], sequence: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths of one pack) of every packing pattern.

    ``histogram`` counts pieces by length, 1 to ``sequence``. Lengths are placed
    longest first; each goes to the pack that is shortest so far if it fits
    there, else it opens a new one. Equal packs are moved as one group, so the
    work follows the number of lengths, not of pieces.
    """
    open_: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    heap: list[int] = []

    def put(filled: int, count: int, lengths: tuple[int, ...]) -> None:
        if filled not in open_:
            open_[filled] = []
            heapq.heappush(heap, filled)
        open_[filled].append((count, lengths))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left > 0:
            if not heap or heap[0] + length > sequence:
                # One by one, each piece would join the pack just opened while it fits.
                fit = sequence // length
                if left // fit:
                    put(fit * length, left // fit, (length,) * fit)
                if left % fit:
                    put(left % fit * length, 1, (length,) * (left % fit))
                break
            filled = heap[0]
            count, lengths = open_[filled].pop()
            moved = min(count, left)
            if moved < count:
                open_[filled].append((count - moved, lengths))
            elif not open_[filled]:
                del open_[filled]
                heapq.heappop(heap)
            put(filled + length, moved, (*lengths, length))
            left -= moved
    return [group for filled in sorted(open_) for group in open_[filled]]


def slot_ranges(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, offset) per pattern slot."""
    rows, used, first = [], {}, 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            lo = used.get(length, 0)
            rows.append((length, lo, lo + count, first, offset))
            used[length] = lo + count
            offset += length
        first += count
    return rows


def pack(docs: DataFrame, tokenizer: str, sequence: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", salt_rows: int = 100_000) -> DataFrame:
    """Pack every document's ids into sequences of at most ``sequence``.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id and
    offset of each piece. Each id lies in exactly one piece; a document of up
    to ``sequence`` ids stays whole. Null ids are kept, repeated rows are
    packed each for itself, and an empty table gives no rows. Ranks within a
    length are counted in salted parts of about ``salt_rows`` pieces, so a
    length that very many pieces share is spread over tasks.
    """
    pieces = scratch_table(token_pieces(docs, tokenizer, sequence, end_id, id_col, text_col), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    salts = max(16, sum(counts.values()) // salt_rows)
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    part = (
        pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("n")
    )
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = pieces.withColumn("rank", F.row_number().over(order) - 1).join(part, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    # The slots follow the number of distinct lengths (at most `sequence`), not the rows.
    slots = np.array(sorted(slot_ranges(shortest_pack_first(counts, sequence))), dtype=np.int64).reshape(-1, 5)
    shared = docs.sparkSession.sparkContext.broadcast(slots)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, lo, _, first, offset = shared.value.T
        begins = (shared.value[:, 0] << 40) + lo
        for batch in batches:
            length, rank = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            k = np.searchsorted(begins, (length << 40) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(first[k] + rank - lo[k]), pa.array(offset[k])], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("rank").cast("long"))
    return map_batches(ranked, place, f"{PIECES}, sequence_id long, offset long")

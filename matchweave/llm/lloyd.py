"""Product codes of vectors: Lloyd rounds on integer parts, maintained by differences.

A vector's components become integers and are cut into equal parts; each part
position has a codebook of a few entries. The assignments of a round are written
with the vectors, and every entry's sum and count are kept from round to round. A
round reads the last assignments, assigns anew and adds up, in each task, only the
parts whose assignment changed: plus at the new entry, minus at the old. Those few
rows (at most one for each position and entry) are all that is shuffled, and a
round without a change ends the work early. Sums are whole numbers of any size, so
that neither order nor lost executors change a result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchweave.llm.common import group_starts, map_batches, sized
from matchweave.sources.scratch import Scratch

#: Up to this size (and 512 components a part) squared distances are exact in double precision.
_EXACT = 1 << 21
_MOST = (1 << 63) - 1
Books = list[list[list[int]]]


def whole(x: float, scale: int) -> int:
    """floor(scale * x), exact for every finite double; ``scale`` is a power of two."""
    return math.floor(x * scale) if abs(x) < 2.0**52 else int(x) * scale


def written(x: np.ndarray, scale: int) -> list[bytes]:
    """Each vector's integers in two or four bytes a component, or the vector itself in eight where they don't fit."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    top = np.abs(y).max(axis=1)
    return [(y[i].astype("<i2") if t < 1 << 15 else y[i].astype("<i4") if t < 1 << 31 else x[i].astype("<f8")).tobytes() for i, t in enumerate(top.tolist())]


def read(blobs: list[bytes], dim: int, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, integers) by stored width: doubles where distances are exact in them, else Python integers."""
    width = np.array([len(b) // dim for b in blobs])
    for w, kind in ((2, "<i2"), (4, "<i4"), (8, "<f8")):
        rows = np.flatnonzero(width == w)
        if not len(rows):
            continue
        x = np.frombuffer(b"".join([blobs[i] for i in rows.tolist()]), kind).reshape(-1, dim)
        if w == 8:
            x = np.array([[whole(v, scale) for v in row] for row in x.tolist()], dtype=object)
        elif w == 4 and np.abs(x.astype(np.int64)).max() > _EXACT:
            x = np.array(x.tolist(), dtype=object)
        else:
            x = x.astype(np.float64)
        yield rows, x


def nearest(x: np.ndarray, book: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, lower first, and squared distance) of each row; exact."""
    if x.dtype != object and x.shape[1] <= 512 and max(abs(v) for entry in book for v in entry) <= _EXACT:
        c = np.array(book, dtype=np.float64)
        d = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]
    else:
        x = x if x.dtype == object else np.array([[int(v) for v in row] for row in x.tolist()], dtype=object)
        d = np.stack([((x - np.array(entry, dtype=object)) ** 2).sum(axis=1) for entry in book], axis=1)
    best = d.argmin(axis=1)
    return best, d[np.arange(len(x)), best]


def assigned(x: np.ndarray, books: Books) -> tuple[np.ndarray, list[int]]:
    """Codes (rows x parts) and the squared distances of each row, summed over its parts."""
    size = x.shape[1] // len(books)
    found = [nearest(x[:, p * size : (p + 1) * size], book) for p, book in enumerate(books)]
    return np.stack([f[0] for f in found], axis=1).astype(np.uint8), [sum(map(int, row)) for row in zip(*(f[1].tolist() for f in found), strict=True)]


class Changes:
    """Plus and minus contributions to each position's entries: a count and component sums."""

    def __init__(self, parts: int, entries: int, size: int):
        self.n = np.zeros((parts, entries), dtype=np.int64)
        self.sums = np.zeros((parts, entries, size), dtype=object)

    def add(self, x: np.ndarray, part: int, entry: np.ndarray, sign: int) -> None:
        for e in np.unique(entry).tolist():
            own = x[entry == e]
            self.n[part, e] += sign * len(own)
            self.sums[part, e] += [sign * int(v) for v in own.sum(axis=0).tolist()]

    def rows(self) -> list[tuple[int, int, int, str]]:
        some = np.nonzero(self.n.astype(bool) | self.sums.astype(bool).any(axis=2))
        return [(p, e, int(self.n[p, e]), ",".join(map(str, self.sums[p, e]))) for p, e in zip(*(a.tolist() for a in some), strict=True)]


def reassign(batches: Iterable[pa.RecordBatch], books: Books, dim: int, scale: int) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, label, vec or data, code) with their new code; at the end one row for each entry that gained or lost parts."""
    parts, entries, size = len(books), len(books[0]), dim // len(books)
    change, label = Changes(parts, entries, size), None
    names = ["vec_id", "label", "data", "code", "part", "entry", "n", "sums"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.string()]
    for batch in batches:
        ids, label, third, old = batch.columns
        if not batch.num_rows:
            continue
        if pa.types.is_list(third.type):
            blobs = written(np.asarray(third.flatten(), dtype=np.float64).reshape(-1, dim), scale)
        else:
            blobs = third.to_pylist()
        before, code = old.to_pylist(), np.zeros((len(blobs), parts), dtype=np.uint8)
        for rows, x in read(blobs, dim, scale):
            code[rows], _ = assigned(x, books)
            fresh = np.array([before[i] is None for i in rows.tolist()])
            last = np.frombuffer(b"".join(before[i] or bytes(parts) for i in rows.tolist()), np.uint8).reshape(-1, parts)
            for p in range(parts):
                own, now = x[:, p * size : (p + 1) * size], code[rows, p]
                moved = fresh | (now != last[:, p])
                gone = moved & ~fresh
                change.add(own[moved], p, now[moved], 1)
                change.add(own[gone], p, last[gone, p], -1)
        none = [pa.nulls(len(blobs), k) for k in kinds]
        yield pa.RecordBatch.from_arrays([ids, label, pa.array(blobs, pa.binary()), pa.array([c.tobytes() for c in code], pa.binary()), *none], names=names)
    found = change.rows()
    if found:
        columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
        empty = [pa.nulls(len(found), k) for k in (pa.int64(), label.type, pa.binary(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*empty, *columns], names=names)


def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contributions (part, entry, n, sums), sorted by the first two, added up; holds one entry."""
    held: tuple | None = None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int32()), pa.array([held[1]], pa.int32()), pa.array([held[2]], pa.int64()), pa.array([",".join(map(str, held[3]))])], names=["part", "entry", "n", "sums"])

    for batch in batches:
        part, entry, n, sums = (c.to_pylist() for c in batch.columns)
        at = group_starts(np.array(part), np.array(entry))
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if held and held[:2] != (part[lo], entry[lo]):
                yield out()
                held = None
            total = held[3] if held else None
            for text in sums[lo:hi]:
                values = list(map(int, text.split(",")))
                total = values if total is None else [a + b for a, b in zip(total, values, strict=True)]
            held = (part[lo], entry[lo], (held[2] if held else 0) + sum(n[lo:hi]), total)
    if held:
        yield out()


def product_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = None, scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6) -> tuple[DataFrame, Books]:
    """(vec_id, label, code, error) of every usable row, and the final codebooks.

    Components become floor(``scale`` * x) (``scale`` a power of two). Codebooks begin
    as the parts of the ``entries`` smallest ids (fewer, if there are fewer rows; rows
    of one id in order of their vectors, rows without an id last). ``rounds`` times
    each part goes to its nearest entry, lower index first on ties, and each entry
    with parts becomes the floor of their mean; then parts are assigned once more.
    ``code`` has two hex digits a part, ``error`` the squared distances, at most 2**63 - 1.

    Rows are left out if the vector is null, holds a null or non-finite component, or
    has another length than most (the longer on ties) or one that ``parts`` doesn't
    divide. Repeated rows count each. Other columns are ignored; without a usable row
    there are no rows and no codebooks.
    """
    if entries > 256 or scale & (scale - 1):
        raise ValueError("at most 256 entries, and a scale that is a power of two")
    spark = vectors.sparkSession
    label = F.col(f"`{label_col}`") if label_col else F.lit(None).cast("string")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), label.alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("vec"))
    rows = rows.where(F.col("vec").isNotNull() & F.forall("vec", lambda v: v.isNotNull() & (F.abs(v) < float("inf"))) & (F.size("vec") > 0) & (F.size("vec") % parts == 0))
    kind = rows.schema["label"].dataType.simpleString()
    most = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if most is None:
        return spark.createDataFrame([], f"vec_id long, label {kind}, code string, error long"), []
    dim = most["dim"]
    size, rows = dim // parts, rows.where(F.size("vec") == dim)
    first = [[whole(v, scale) for v in r["vec"]] for r in rows.select("vec_id", "vec").orderBy(F.asc_nulls_last("vec_id"), "vec").limit(entries).collect()]
    books: Books = [[x[p * size : (p + 1) * size] for x in first] for p in range(parts)]

    total = Changes(parts, len(first), size)
    state, held = rows.withColumn("code", F.lit(None).cast("binary")), None
    for _ in range(rounds):
        before, held = held, Scratch(spark)
        now = held.table(map_batches(state, lambda it, books=books: reassign(it, books, dim, scale), f"vec_id long, label {kind}, data binary, code binary, part int, entry int, n long, sums string"), "state")
        if before:
            before.drop()
        state = now.where("part is null").select("vec_id", "label", "data", "code")
        changed = now.where("part is not null").select("part", "entry", "n", "sums").repartition("part", "entry").sortWithinPartitions("part", "entry")
        changed = map_batches(changed, summed, "part int, entry int, n long, sums string").collect()  # one row at most for each position and entry
        if not changed:
            break
        for r in changed:
            total.n[r["part"], r["entry"]] += r["n"]
            total.sums[r["part"], r["entry"]] += [int(v) for v in r["sums"].split(",")]
        books = [[[s // int(n) for s in sums] if n else entry for entry, n, sums in zip(*x, strict=True)] for x in zip(books, total.n, total.sums.tolist(), strict=True)]

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            third = batch.column(2)
            blobs = written(np.asarray(third.flatten(), dtype=np.float64).reshape(-1, dim), scale) if pa.types.is_list(third.type) else third.to_pylist()
            code, error = [""] * len(blobs), [0] * len(blobs)
            for at, x in read(blobs, dim, scale):
                found, far = assigned(x, books)
                for i, c, e in zip(at.tolist(), found, far, strict=True):
                    code[i], error[i] = c.tobytes().hex(), min(e, _MOST)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    out = Scratch(spark).table(map_batches(state.drop("code"), finish, f"vec_id long, label {kind}, code string, error long"), "codes")
    if held:
        held.drop()
    return out, books


def with_label_error(coded: DataFrame, send: int = 1_000_000) -> DataFrame:
    """Add label_error: the errors of all rows of the same label, nulls together, at most 2**63 - 1.

    Errors are summed before they are shuffled; the sums are sent to the rows if there
    are at most ``send`` labels, else joined by a shuffle.
    """
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("_sum"))
    sums = Scratch(coded.sparkSession).table(sums.select("_label", F.least("_sum", F.lit(_MOST)).cast("long").alias("label_error")), "label_errors")
    return coded.join(sized(sums, send), F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def codebooks_digest(books: Books) -> str:
    """SHA-256 of all components by position, entry and place, as decimal numbers joined by commas; lowercase hex."""
    return hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()

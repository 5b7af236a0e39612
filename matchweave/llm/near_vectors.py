"""Near-duplicate vectors by randomised-rotation binary codes.

A vector's code is the sign of each coordinate after a random rotation, kept
with a correction factor (the code's inner product with the rotated vector).
Code and factor give an unbiased estimate of another vector's inner product
with it, with an error bound; only pairs whose bound reaches the threshold are
computed again in double precision. More rotations' signs, cut into bands, say
which vectors meet at all.

Vectors first meet by a mark of some bytes: code, factor, the rotated vector in
steps of one byte, and the bands' signs. A pair counts in the first band that both
share. Only vectors with a pair that the bound leaves are then sent to that band's
bucket whole, and computed exactly there.

Equal vectors are one class with a count. A bucket that many classes share is
cut into blocks, each pair of blocks a group of its own. No pair is written
out: a block returns, per vector, the number of its links and one link towards
the block's components.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchweave.llm.common import connected_components, forest, group_starts, map_batches, whole_groups
from matchweave.llm.textbuf import mix
from matchweave.sources.scratch import Scratch


@lru_cache(maxsize=4)
def rotations(dim: int, count: int) -> np.ndarray:
    """``count`` random rotations side by side (dim x dim*count)."""
    parts = []
    for k in range(count):
        q, r = np.linalg.qr(np.random.default_rng([dim, k]).standard_normal((dim, dim)))
        parts.append(q * np.sign(np.diag(r)))
    return np.hstack(parts)


def plan_bands(vectors: int, threshold: float, bucket: int, miss: float) -> tuple[int, int]:
    """(bits per band, bands): buckets of about ``bucket`` vectors, a pair at the threshold missed with chance ``miss``."""
    bits = max(4, round(math.log2(max(2, vectors / bucket))))
    together = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - together))


def band_bits(unit: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """Signs by band (vectors x bands x bits)."""
    dim = unit.shape[1]
    signs = unit @ rotations(dim, 1 + math.ceil(bits * bands / dim))[:, dim:] >= 0
    return signs[:, : bits * bands].reshape(len(unit), bands, bits)


def band_values(signs: np.ndarray) -> np.ndarray:
    """One number for the signs of each band (vectors x bands)."""
    return (signs.astype(np.uint64) << np.arange(signs.shape[2], dtype=np.uint64)).sum(axis=2, dtype=np.uint64)


def marks_of(unit_: np.ndarray, signs: np.ndarray) -> list[bytes]:
    """Factor and step (float32), code, rotated vector in steps, and band signs of each vector."""
    d = unit_.shape[1]
    turned = unit_ @ rotations(d, 1)
    head = np.empty((len(unit_), 2), dtype="<f4")
    head[:, 0] = np.abs(turned).sum(axis=1) / math.sqrt(d)
    head[:, 1] = np.abs(turned).max(axis=1) / 127
    steps = np.rint(turned / head[:, 1:]).astype(np.int8)
    parts = head.view(np.uint8), np.packbits(turned >= 0, axis=1), steps.view(np.uint8), np.packbits(signs.reshape(len(unit_), -1), axis=1)
    return [row.tobytes() for row in np.hstack(parts)]


def read_marks(marks: list[bytes], dim: int, bits: int, bands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(factor, step, code as -1 and 1, rotated vector, band values) of marks of vectors of one dimension."""
    raw = np.frombuffer(b"".join(marks), np.uint8).reshape(len(marks), -1)
    head = np.ascontiguousarray(raw[:, :8]).view("<f4")
    at = 8 + -(-dim // 8)
    code = np.unpackbits(raw[:, 8:at], axis=1, count=dim).astype(np.float32) * 2 - 1
    turned = np.ascontiguousarray(raw[:, at : at + dim]).view(np.int8).astype(np.float32) * head[:, 1:]
    signs = np.unpackbits(raw[:, at + dim :], axis=1, count=bits * bands).reshape(len(marks), bands, bits)
    return head[:, 0].astype(np.float64), head[:, 1].astype(np.float64), code, turned, band_values(signs)


def may_reach(factor: np.ndarray, step: np.ndarray, code: np.ndarray, turned: np.ndarray, threshold: float, sigmas: float) -> np.ndarray:
    """Which pairs' estimated inner products are within their error bound of the threshold, by either one's code."""
    d = code.shape[1]
    estimate = turned @ code.T / math.sqrt(d) / factor[None, :].astype(np.float32)
    # A pair at the threshold is estimated within so many deviations; one above it, closer.
    error = sigmas * np.sqrt(np.maximum(0, 1 - factor * factor)) / factor / math.sqrt(max(1, d - 1)) * math.sqrt(1 - threshold * threshold)
    rounding = math.sqrt(d) / 2 * step[:, None] / factor[None, :]  # each coordinate is off by half a step at most
    near = estimate >= threshold - error[None, :] - rounding - 1e-4
    return near | near.T


def first_shared(values: np.ndarray, a: np.ndarray, b: np.ndarray, band: int) -> np.ndarray:
    """Whether each pair shares none of the bands before ``band``."""
    fresh = np.ones(len(a), dtype=bool)
    for start in range(0, len(a), 4096) if band else ():
        s = slice(start, start + 4096)
        fresh[s] = ~(values[a[s], :band] == values[b[s], :band]).any(axis=1)
    return fresh


def vectors_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the usable vectors of each dimension: no null, all finite, not zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.array([0 if x is None else x for x in column.value_lengths().to_pylist()], dtype=np.int64)
    values = column.flatten()
    gaps = values.is_null().to_numpy(zero_copy_only=False)
    values = values.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64)
    values[gaps] = np.nan
    at = np.concatenate([[0], np.cumsum(lengths)])
    for dim in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == dim)
        x = values[at[rows][:, None] + np.arange(dim)]
        good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        if good.any():
            yield rows[good], x[good]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square over- or underflows
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def classes_of(vectors: DataFrame) -> DataFrame:
    """(vec_id, h1, h2, dim, vec): digests and bytes of the usable vectors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in vectors_of(batch.column(1)):
                x = x + 0.0  # -0.0 becomes 0.0
                blobs = [r.tobytes() for r in x]
                h = np.frombuffer(b"".join(hashlib.blake2b(b, digest_size=16).digest() for b in blobs), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(np.full(len(x), x.shape[1], np.int32)), pa.array(blobs, pa.binary())],
                    names=["vec_id", "h1", "h2", "dim", "vec"],
                )

    return map_batches(vectors, run, "vec_id long, h1 long, h2 long, dim int, vec binary")


def _pairs_of(left: np.ndarray, right: np.ndarray, near: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of the near pairs between two blocks, or once each inside one."""
    near = near & left[:, None] & right[None, :]
    return np.nonzero(np.triu(near | near.T, 1) if same else near)


def block_candidates(batches: Iterable[pa.RecordBatch], threshold: float, bits: int, bands: int, sigmas: float) -> Iterator[pa.RecordBatch]:
    """(key, i, j, block, rep, band) of the vectors that have a pair in a block pair which the bound leaves, in its first shared band."""
    names = ["key", "i", "j", "block", "rep", "band"]
    for table in whole_groups(batches, ["key", "i", "j"]):
        key, i, j, block, rep, dim, band = (table[c].to_numpy() for c in ("key", "i", "j", "block", "rep", "dim", "band"))
        mark = table["mark"].to_pylist()
        at = group_starts(key, i, j, band, dim)
        kept: list[np.ndarray] = []
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if hi - lo < 2:
                continue
            *known, values = read_marks(mark[lo:hi], int(dim[lo]), bits, bands)
            a, b = _pairs_of(block[lo:hi] == i[lo], block[lo:hi] == j[lo], may_reach(*known, threshold, sigmas), i[lo] == j[lo])
            fresh = first_shared(values, a, b, int(band[lo]))
            kept.append(lo + np.unique(np.concatenate([a[fresh], b[fresh]])))
        if kept and len(some := np.concatenate(kept)):
            yield pa.RecordBatch.from_arrays([pa.array(c[some], pa.int64()) for c in (key, i, j, block, rep, band)], names=names)


def block_counts(batches: Iterable[pa.RecordBatch], threshold: float, bits: int, bands: int) -> Iterator[pa.RecordBatch]:
    """(rep, low, n): links found in each block, weighted by class size, and the block component's smallest rep."""
    for table in whole_groups(batches, ["key", "i", "j"]):
        key, i, j, block, rep, size, dim, band = (table[c].to_numpy() for c in ("key", "i", "j", "block", "rep", "size", "dim", "band"))
        vec, mark = table["vec"].to_pylist(), table["mark"].to_pylist()
        at = group_starts(key, i, j, band, dim)
        out: list[list] = [[], [], []]
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            order = lo + np.argsort(rep[lo:hi], kind="stable")
            x = unit(np.frombuffer(b"".join([vec[k] for k in order]), np.float64).reshape(-1, int(dim[lo])))
            # Any pair at the threshold, by a product that may round otherwise than the exact one.
            a, b = _pairs_of(block[order] == i[lo], block[order] == j[lo], x @ x.T >= threshold - 1e-9, i[lo] == j[lo])
            fresh = first_shared(read_marks([mark[k] for k in order], x.shape[1], bits, bands)[-1], a, b, int(band[lo]))
            a, b = a[fresh], b[fresh]
            exact = np.ones(len(a), dtype=bool)
            step = max(1, (1 << 20) // x.shape[1])
            for s in range(0, len(a), step):
                exact[s : s + step] = np.einsum("ij,ij->i", x[a[s : s + step]], x[b[s : s + step]]) >= threshold
            a, b = a[exact], b[exact]
            if not len(a):
                continue
            weight = size[order].astype(np.float64)
            n = np.bincount(a, weight[b], hi - lo) + np.bincount(b, weight[a], hi - lo)
            low = forest(hi - lo, a, b)
            hit = np.flatnonzero(n)
            own = rep[order]
            for column, value in zip(out, (own[hit], own[low[hit]], n[hit].astype(np.int64)), strict=True):
                column.append(value)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in out], names=["rep", "low", "n"])


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, bucket: int = 256, block: int = 512, miss: float = 1e-8, sigmas: float = 7.0) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row.

    Vectors are linked if their cosine, in double precision, is ``threshold`` or
    more. Null, zero and empty vectors, those with a null or non-finite
    component, and rows without an id are linked with nothing; vectors of
    different dimensions are never linked. Rows that repeat an id with the same
    vector count as vectors of their own. Other columns are ignored; an empty
    table gives no rows.

    ``miss`` bounds the chance that no band joins a pair right at the threshold,
    ``sigmas`` the error bound of an estimate.
    """
    vectors = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    kept, work = Scratch(vectors.sparkSession), Scratch(vectors.sparkSession)
    usable = kept.table(classes_of(vectors.where("vec_id is not null and embedding is not null")), "vectors")
    key = ["h1", "h2"]
    classes = kept.table(usable.groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.first("dim").alias("dim"), F.first("vec").alias("vec")), "classes")
    bits, bands = plan_bands(classes.count(), threshold, bucket, miss)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for d in np.unique(dims).tolist():
                part = batch.take(pa.array(np.flatnonzero(dims == d)))
                x = unit(np.frombuffer(b"".join(part.column(3).to_pylist()), np.float64).reshape(-1, d))
                signs = band_bits(x, bits, bands)
                keys = mix(mix(band_values(signs) + np.uint64(1)) + (np.arange(bands, dtype=np.uint64) << np.uint64(32)) + np.uint64(d)).view(np.int64)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(x) + 1) * bands, bands), pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(marks_of(x, signs), pa.binary()), keys], names=["rep", "size", "dim", "vec", "mark", "keys"])

    coded = work.table(map_batches(classes.select("rep", "size", "dim", "vec"), encode, "rep long, size long, dim int, vec binary, mark binary, keys array<long>"), "codes")
    large = coded.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block).select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    large = work.table(large, "large")
    rows = coded.select("rep", "dim", "mark", F.posexplode("keys").alias("band", "key")).join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    place = ["key", "i", "j"]
    met = (
        rows.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "dim", "band", "mark")
        .repartition(*place).sortWithinPartitions(*place, "band", "dim")
    )
    near = work.table(map_batches(met, lambda it: block_candidates(it, threshold, bits, bands, sigmas), "key long, i long, j long, block long, rep long, band long"), "near")
    whole = near.join(coded.select("rep", "size", "dim", "vec", "mark"), "rep").repartition(*place).sortWithinPartitions(*place, "band", "dim")
    found = kept.table(map_batches(whole, lambda it: block_counts(it, threshold, bits, bands), "rep long, low long, n long"), "links")
    work.drop()
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    comps = connected_components(found, "rep", "low").withColumnRenamed("node", "rep")
    named = classes.select(*key, "rep", "size").join(counts, "rep", "left").join(comps, "rep", "left").select(
        *key, (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    linked = usable.select(F.col("vec_id").alias("_id"), *key).join(named, key).groupBy("_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = vectors.select("vec_id").join(linked, F.col("vec_id") == F.col("_id"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

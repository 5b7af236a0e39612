"""Near-duplicate documents by min-max hashing, confirmed on whole sets.

Each permutation of a document's word shingles gives two signature values, its
minimum and its maximum, so half the hash evaluations fill the same bands. The
bands only propose which documents may be alike; a proposal joins nothing until
it is confirmed on the whole shingle sets.

Documents with equal sets are one class before any band is cut, so thousands
of exact copies cost one row. Then, in three steps:

1. Each member of a band's bucket is compared with the bucket's smallest id only,
   first by signature, then by whole set. That takes as many pairs as members, and
   settles most buckets: all their members are linked to one leader, or no others are
   left.
2. In the other buckets the members without a common leader are left. A bucket with
   very many that no leader is linked with holds texts that share much and yet too
   little, say one boilerplate.
   Two sets that reach the threshold share one of their few rarest shingles, in any
   order of shingles that both keep; with the shingles that a sample of the family
   repeats as the commonest, these texts hold none in common. Such buckets are
   split into those that do, in time and bytes in proportion to the texts.
3. What is in a bucket then is compared by signature, block against block. Only those
   whose signatures may reach the threshold are joined to groups, and in these the
   whole sets are compared, again block against block. Pairs are never written out;
   a block returns a spanning forest of its links.
"""

from __future__ import annotations

import math
import secrets
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchweave.llm.common import connected_components, forest, group_starts, map_batches, sized, whole_groups
from matchweave.llm.textbuf import LOWER, WordHash, mix, text_slices, words
from matchweave.sources.scratch import Scratch, scratch_table

_STEP = np.uint64(0x9FB21C651E98DF25)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int, word_hash: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text, joined, and offsets.

    Words are lower-cased in A-Z. A text of fewer than ``width`` words has its
    whole word sequence as the only shingle; one without words has none.
    """
    n = len(offsets) - 1
    data = LOWER[data]
    starts, ends, owner = words(data, offsets)
    h = word_hash(data, starts, ends)
    at = np.searchsorted(owner, np.arange(n + 1))
    rolled = h[: max(0, len(h) - width + 1)] + np.uint64(width)
    for k in range(1, width):
        rolled = mix(rolled * _STEP + h[k : k + len(rolled)])
    parts, sizes = [], np.zeros(n, dtype=np.int64)
    for i, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        if hi - lo >= width:
            own = np.sort(rolled[lo : hi - width + 1])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif hi > lo:
            own = h[lo : lo + 1] + np.uint64(hi - lo)
            for k in range(lo + 1, hi):
                own = mix(own * _STEP + h[k : k + 1])
        else:
            continue
        parts.append(own)
        sizes[i] = len(own)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def digests(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Two 64-bit digests of each set (2 x sets); 0 for an empty one."""
    h, some = np.zeros((2, len(at) - 1), dtype=np.uint64), np.flatnonzero(np.diff(at))
    if len(some):
        h[0, some] = np.add.reduceat(mix(flat + _STEP), at[some])
        h[1, some] = np.add.reduceat(mix(flat ^ _STEP), at[some])
    return h.view(np.int64)


def band_count(threshold: float, rows: int, miss: float) -> int:
    """Bands of ``rows`` values that miss a pair at the threshold with chance ``miss`` at most; even."""
    bands = math.ceil(math.log(miss) / math.log(1 - threshold**rows))
    return bands + bands % 2


def min_max_bands(flat: np.ndarray, at: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (texts x bands) and a byte of each signature value (texts x bands * rows).

    The first half of the bands use minima, the rest maxima. A permutation's two
    values never meet in one band.
    """
    rng = np.random.default_rng(71)
    perms = bands // 2 * rows
    factor = rng.integers(0, 1 << 63, perms, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 1 << 63, perms, dtype=np.uint64)
    keys = np.zeros((2, bands // 2, len(at) - 1), dtype=np.uint64)
    sketch = np.zeros((2, perms, len(at) - 1), dtype=np.uint8)
    for p in range(perms):
        y = flat * factor[p]
        y += shift[p]
        y >>= np.uint64(20)
        for side, pick in enumerate((np.minimum, np.maximum)):
            k = keys[side, p // rows]
            k *= _STEP
            value = pick.reduceat(y, at[:-1]) + np.uint64(1)
            sketch[side, p] = (value * _STEP) >> np.uint64(56)
            k += value
            k ^= k >> np.uint64(29)
    keys = keys.reshape(bands, -1).T
    return mix(keys + np.arange(bands, dtype=np.uint64) * _STEP), sketch.reshape(2 * perms, -1).T


def signatures(docs: DataFrame, width: int, bands: int, rows: int, secret: int) -> DataFrame:
    """doc_id, text_hash (as given), n_shingles, h1 and h2 (together the set's 128-bit digest), band keys and signature bytes."""

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_hash = WordHash(secret)
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                flat, at = shingle_sets(data, offsets, width, word_hash)
                size = np.diff(at)
                some = np.flatnonzero(size)
                h = digests(flat, at)
                keys, sketch = pa.array([None] * (hi - lo), pa.list_(pa.int64())), [None] * (hi - lo)
                if len(some):
                    found, marks = min_max_bands(flat, np.append(at[some], len(flat)), bands, rows)
                    lengths = np.where(size > 0, bands, 0)
                    keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(np.ascontiguousarray(found).view(np.int64).ravel()))
                    for i, row in zip(some.tolist(), marks, strict=True):
                        sketch[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(size), pa.array(h[0]), pa.array(h[1]), keys, pa.array(sketch, pa.binary())],
                    names=["doc_id", "text_hash", "n_shingles", "h1", "h2", "bands", "sketch"],
                )

    return map_batches(docs, sign, "doc_id long, text_hash long, n_shingles long, h1 long, h2 long, bands array<long>, sketch binary")


def least_agreement(threshold: float, values: int, sigmas: float) -> float:
    """Agreeing signature bytes that a pair at the threshold has, less ``sigmas`` deviations."""
    p = threshold + (1 - threshold) / 256
    return values * p - sigmas * math.sqrt(values * p * (1 - p))


def with_leaders(batches: Iterable[pa.RecordBatch], alike) -> Iterator[pa.RecordBatch]:
    """(a, b) of each member that is alike to its leader.

    Rows (low, salt, member, rep, n, data) in order of low, salt and member: the
    leader's own rows (member 0) come first, then the others. ``alike`` takes the
    leader's n and data and lists of the members'; a member is held against each of
    the leader's rows.
    """
    group, leaders = None, {}
    for batch in batches:
        low, salt, member, rep, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
        data = batch.column(5)
        at = group_starts(low, salt)
        out: tuple[list, list] = ([], [])
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if group != (low[lo], salt[lo]):
                group, leaders = (low[lo], salt[lo]), {}
            head = lo + int(np.count_nonzero(member[lo:hi] == 0))
            leaders |= {data[k].as_py(): int(n[k]) for k in range(lo, head)}  # rows that repeat the leader count once
            if head == hi:
                continue
            others = [x.as_py() for x in data.slice(head, hi - head)]
            hit = np.zeros(hi - head, dtype=bool)
            for value, own in leaders.items():
                hit |= alike(own, value, n[head:hi], others)
            out[0].append(rep[head:hi][hit])
            out[1].append(low[head:hi][hit])
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out], names=["a", "b"])


def roles(pairs: DataFrame, salt_rows: int) -> DataFrame:
    """(rep, low, salt, member) of the members and leaders of pairs (low, rep).

    A leader of more than ``salt_rows`` members stands once for each as many.
    """
    sizes = pairs.groupBy("low").agg(F.ceil(F.count("*") / salt_rows).cast("int").alias("salts"))
    members = pairs.join(sizes, "low").select("rep", "low", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("member"))
    return members.unionByName(sizes.select(F.col("low").alias("rep"), "low", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("member")))


def compare_with_leaders(rows: DataFrame, alike) -> DataFrame:
    """Pairs (a, b) of member and leader that are alike; ``rows`` are roles with n and data."""
    rows = rows.select("low", "salt", "member", "rep", "n", "data").repartition("low", "salt").sortWithinPartitions("low", "salt", "member")
    return map_batches(rows, lambda it: with_leaders(it, alike), "a long, b long")


def may_reach(part: int, whole: int, least: float):
    """Test by size and signature bytes for ``with_leaders``."""

    def alike(n: int, sketch: bytes, sizes: np.ndarray, others: list[bytes]) -> np.ndarray:
        marks = np.frombuffer(b"".join(others), np.uint8).reshape(len(others), -1)
        agree = (marks == np.frombuffer(sketch, np.uint8)).sum(axis=1)
        return (agree >= least) & (whole * np.minimum(n, sizes) >= part * np.maximum(n, sizes))

    return alike


def sets_reach(part: int, whole: int):
    """Test by whole sets for ``with_leaders``."""

    def alike(n: int, blob: bytes, sizes: np.ndarray, others: list[bytes]) -> np.ndarray:
        own, hit = np.frombuffer(blob, np.uint64), np.zeros(len(others), dtype=bool)
        for k, x in enumerate(others):
            x = np.frombuffer(x, np.uint64)
            at = np.searchsorted(own, x)
            both = int(np.count_nonzero(own[np.minimum(at, n - 1)] == x))
            hit[k] = both > 0 and whole * both >= part * (n + len(x) - both)
        return hit

    return alike


def rare_shingles(batches: Iterable[pa.RecordBatch], part: int, whole: int) -> Iterator[pa.RecordBatch]:
    """(comp, shingle, rep): as many of each member's rarest shingles as it can't have all of beside a set it is linked with.

    Rows (comp, salt, member, rep, n, data) in order of comp, salt and member: a sample
    of the component's sets (member 0) comes first. Shingles are ordered by how many
    sampled sets hold them, then by hash. Of two sets A and B that are linked, at most
    |A| - ceil(part / whole * |A|) shingles of A are not in B; so the smallest common
    shingle is among that many, plus one, of either.
    """
    group, sample, common, times = None, [], None, None
    for batch in batches:
        comp, salt, member, rep = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        data, out = batch.column(5), ([], [], [])
        for k in range(batch.num_rows):
            if group != (comp[k], salt[k]):
                group, sample, common = (comp[k], salt[k]), [], None
            own = np.frombuffer(data[k].as_py(), np.uint64)
            if not member[k]:
                sample.append(own)
                continue
            if common is None:
                common, times = np.unique(np.concatenate(sample) if sample else np.zeros(0, np.uint64), return_counts=True)
                common, times, sample = common[times > 1], times[times > 1], []
            held = np.zeros(len(own), dtype=np.int64)
            if len(common):
                at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                held = np.where(common[at] == own, times[at], 0)
            rare = own[np.lexsort((own, held))[: len(own) + part * len(own) // -whole + 1]]
            for column, value in zip(out, (np.full(len(rare), comp[k]), rare.view(np.int64), np.full(len(rare), rep[k])), strict=True):
                column.append(value)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out], names=["comp", "shingle", "rep"])


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, part: int, whole: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in ``left``, in ``right``) of pairs with whole * intersection >= part * union."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), size)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    shared = times[column] > 1
    row, column = row[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(left), len(right)), dtype=np.float64)
    step = max(1, (1 << 22) // len(sets))
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, (lo, lo + step))
        cells = np.zeros((len(sets), min(step, int(column[-1]) + 1 - lo)), dtype=np.float32)
        cells[row[a:b], column[a:b] - lo] = 1
        total += cells[left] @ cells[right].T
    both = size[left][:, None] + size[right][None, :] - total
    return np.nonzero((whole * total >= part * both) & (total > 0))


def block_links(batches: Iterable[pa.RecordBatch], part: int, whole: int) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links in each block pair, as (a, b) document ids."""
    for table in whole_groups(batches, ["comp", "i", "j"]):
        ids, comp, i, j, block = (table[c].to_numpy() for c in ("rep", "comp", "i", "j", "block"))
        blob = [np.frombuffer(x, np.uint64) for x in table["data"].to_pylist()]
        at = group_starts(comp, i, j)
        out: tuple[list, list] = ([], [])
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            order = lo + np.argsort(ids[lo:hi], kind="stable")
            own = ids[order]
            first = np.flatnonzero(block[order] == i[lo])
            second = first if i[lo] == j[lo] else np.flatnonzero(block[order] == j[lo])
            if not len(first) or not len(second):
                continue
            a, b = linked([blob[k] for k in order], first, second, part, whole)
            low = forest(hi - lo, first[a], second[b])
            moved = np.flatnonzero(low != np.arange(hi - lo))
            out[0].append(own[moved])
            out[1].append(own[low[moved]])
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out], names=["a", "b"])


def block_candidates(batches: Iterable[pa.RecordBatch], part: int, whole: int, least: float) -> Iterator[pa.RecordBatch]:
    """A spanning forest, in each block pair, of what may be linked by size and signature and has no common leader."""
    for table in whole_groups(batches, ["band", "i", "j"]):
        ids, label, n, band, i, j, block = (table[c].to_numpy() for c in ("rep", "label", "n", "band", "i", "j", "block"))
        marks = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(len(ids), -1)

        def near_pairs(x: np.ndarray, y: np.ndarray, n=n, label=label, marks=marks) -> tuple[np.ndarray, np.ndarray]:
            agree = np.zeros((len(x), len(y)), dtype=np.uint16)
            for left, right in zip(marks[x].T, marks[y].T, strict=True):
                agree += left[:, None] == right[None, :]
            sizes = n[x][:, None], n[y][None, :]
            a, b = np.nonzero((agree >= least) & (whole * np.minimum(*sizes) >= part * np.maximum(*sizes)) & (label[x][:, None] != label[y][None, :]))
            return x[a], y[b]

        at = group_starts(band, i, j)
        out: tuple[list, list] = ([], [])
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            order = lo + np.argsort(ids[lo:hi], kind="stable")
            first = order[block[order] == i[lo]]
            second = first if i[lo] == j[lo] else order[block[order] == j[lo]]
            if not len(first) or not len(second):
                continue
            kinds, times = np.unique(label[order], return_counts=True)
            hot = kinds[times.argmax()]  # most pairs are of one label, in which nothing is looked for
            pairs = [(first[label[first] != hot], second)]
            if i[lo] != j[lo]:
                pairs.append((first[label[first] == hot], second[label[second] != hot]))
            a, b = (np.concatenate(x) for x in zip(*(near_pairs(*p) for p in pairs), strict=True))
            place = np.zeros(hi, dtype=np.int64)
            place[order] = np.arange(hi - lo)
            low = forest(hi - lo, place[a], place[b])
            moved = np.flatnonzero(low != np.arange(hi - lo))
            out[0].append(ids[order][moved])
            out[1].append(ids[order][low[moved]])
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out], names=["a", "b"])


def in_block_pairs(rows: DataFrame, by: str, *columns: str) -> DataFrame:
    """Each row of a group ``by`` once for every pair (i, j) of blocks that its own block is in, in order; rows have blocks."""
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    pairs = rows.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("rep", by, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", *columns)
    return pairs.repartition(by, "i", "j").sortWithinPartitions(by, "i", "j")


def by_rare_shingles(large: DataFrame, with_sets: Callable[..., DataFrame], part: int, whole: int, sample: int, work: Scratch, salt_rows: int = 8192) -> DataFrame:
    """(band, rep, label) of large buckets, each split into those that rare shingles join; the band is a new one.

    Buckets that share members are one family, whose first ``sample`` sets by hash of id say
    which shingles are common. The sample is sent to each of the family's parts of
    ``salt_rows`` members; every set is sent once, and its rare shingles.
    """
    lows = work.table(large.groupBy("band").agg(F.min("rep").alias("low")), "large_lows")
    family = connected_components(work.table(large.join(lows, "band").select("rep", "low"), "large_stars"), "rep", "low")
    family = work.table(family.select(F.col("node").alias("rep"), F.col("component").alias("comp")), "families")
    sizes = work.table(family.groupBy("comp").agg(F.ceil(F.count("*") / salt_rows).cast("int").alias("salts")), "family_sizes")
    members = family.join(sizes, "comp").select("rep", "comp", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("member"))
    first = family.withColumn("k", F.row_number().over(Window.partitionBy("comp").orderBy(F.xxhash64("rep"), "rep"))).where(F.col("k") <= sample)
    first = first.join(sizes, "comp").select("rep", "comp", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("member"))
    rows = with_sets(members.unionByName(first), "comp", "salt", "member").select("comp", "salt", "member", "rep", "n", "data")
    rows = rows.repartition("comp", "salt").sortWithinPartitions("comp", "salt", "member")
    rare = work.table(map_batches(rows, lambda it: rare_shingles(it, part, whole), "comp long, shingle long, rep long"), "rare")
    shared = work.table(rare.groupBy("comp", "shingle").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least < most").select("comp", "shingle", "least"), "shared_rare")
    fine = connected_components(rare.join(shared, ["comp", "shingle"]).select("rep", "least"), "rep", "least").withColumnRenamed("node", "rep")
    named = large.select("band", "rep", "label").join(fine, "rep").select(F.xxhash64("band", "component").alias("band"), "rep", "label")
    return named


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, part: int = 80, whole: int = 100, rows: int = 5, miss: float = 1e-8, sigmas: float = 6.0, block: int = 512, block_bytes: int = 8 << 20, salt_rows: int = 512, sample: int = 256, send: int = 1_000_000, hashed: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row.

    Two documents are linked if whole * intersection >= part * union over their
    sets of ``width``-word shingles; component_id is the smallest doc_id
    reachable. ``miss`` bounds the chance that the bands overlook one pair right
    at the threshold, ``sigmas`` the deviations by which its signature may fall
    short (more alike pairs are missed still less). Null and wordless
    texts have no shingles and are linked with nothing. A null doc_id never
    represents others. Repeated doc_ids count as one document. Other columns
    are ignored; an empty table gives no rows. With ``hashed`` the text's hash is
    given too (text_hash), to tell rows of one doc_id apart.

    A group of more than ``block`` documents, or ``block_bytes`` of shingles, is
    cut into blocks and compared block against block, each pair of blocks a group
    of its own. ``sample`` sets of a family of texts in large open buckets say which
    shingles are common there; any sample gives the same links. ``send`` bounds the list of proposed ids, 32 bytes each, that is
    broadcast to fetch texts again; a longer one is joined by a shuffle.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bands, secret = band_count(part / whole, rows, miss), secrets.randbits(64)
    least = least_agreement(part / whole, bands * rows, sigmas)
    kept, work = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    sets = kept.table(signatures(docs.withColumn("text_hash", F.xxhash64("text")), width, bands, rows, secret), "signatures")
    key = ["h1", "h2", "n_shingles"]
    first = [F.first(c).alias(c) for c in ("bands", "sketch")]
    classes = kept.table(sets.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"), *first).where("rep is not null"), "classes")
    keys = classes.select("rep", F.explode("bands").alias("band"))
    # Written before they are joined, so that Spark can split a bucket that very many share.
    buckets = work.table(keys.groupBy("band").agg(F.min("rep").alias("low"), F.max("rep").alias("high"), F.count("*").alias("m")).where("low < high").select("band", "low", "m"), "buckets")
    shared = work.table(keys.join(buckets, "band").where("rep != low"), "shared")

    def with_sets(rows: DataFrame, *columns: str) -> DataFrame:
        """``rows`` (rep and ``columns``, longs) with n and data, the set of a class made from its text again."""

        def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            word_hash = WordHash(secret)
            for batch in batches:
                for lo, hi, data, offsets in text_slices(batch.column(1)):
                    flat, at = shingle_sets(data, offsets, width, word_hash)
                    raw, n = flat.tobytes(), np.diff(at)
                    own = np.flatnonzero(digests(flat, at)[0] == batch.column(0).slice(lo, hi - lo).to_numpy())
                    blobs = pa.array([raw[8 * a : 8 * b] for a, b in zip(at[own].tolist(), at[own + 1].tolist(), strict=True)], pa.binary())
                    rest = [batch.column(k).slice(lo, hi - lo).take(pa.array(own)) for k in range(2, batch.num_columns)]
                    yield pa.RecordBatch.from_arrays([*rest, pa.array(n[own]), blobs], names=["rep", *columns, "n", "data"])

        rows = rows.join(classes.select("rep", F.col("h1").alias("_h1")), "rep")
        wanted = sized(work.table(rows.select(F.col("rep").cast("long"), "_h1", *[F.col(c).cast("long") for c in columns]), "wanted"), send)
        texts = docs.join(wanted, docs["doc_id"] == wanted["rep"]).select("_h1", "text", "rep", *columns)
        return map_batches(texts, gather, ", ".join(f"{c} long" for c in ("rep", *columns, "n")) + ", data binary")

    marks = classes.select("rep", F.col("n_shingles").alias("n"), "sketch")
    first = roles(shared.select("low", "rep").distinct(), salt_rows).join(marks.withColumnRenamed("sketch", "data"), "rep")
    pairs = work.table(compare_with_leaders(first, may_reach(part, whole, least)), "pairs").select(F.col("a").alias("rep"), F.col("b").alias("low"))
    edges = work.table(compare_with_leaders(with_sets(roles(pairs, salt_rows), "low", "salt", "member"), sets_reach(part, whole)), "star_links")

    # What the stars leave: buckets whose members, besides the one all were compared with, have no common leader.
    labels = edges.groupBy(F.col("a").alias("rep")).agg(F.min("b").alias("label"))
    rest = shared.where("m > 2").join(labels, "rep", "left").select("band", "rep", F.coalesce("label", "rep").alias("label"))
    rest = work.table(rest, "rest")
    sides = [F.min("label").alias("x"), F.max("label").alias("y"), F.ceil(F.count("*") / block).cast("int").alias("blocks"), (F.count_if(F.col("label") == F.col("rep")) > block).alias("family")]
    opened = lambda t: work.table(t.groupBy("band").agg(*sides).where("x < y").select("band", "blocks", "family"), "open")
    open_ = opened(rest)
    if not open_.where("family").isEmpty():
        large = work.table(rest.join(open_.where("family").select("band"), "band"), "large")
        small = rest.join(open_.where("not family").select("band"), "band").select("band", "rep", "label")
        rest = work.table(small.unionByName(by_rare_shingles(large, with_sets, part, whole, sample, work)), "split")
        open_ = opened(rest)
    met = in_block_pairs(rest.join(open_.drop("family"), "band").join(marks, "rep"), "band", "label", "n", "sketch")
    near = work.table(map_batches(met, lambda it: block_candidates(it, part, whole, least), "a long, b long"), "candidates")
    if not near.isEmpty():
        groups = work.table(connected_components(near, "a", "b").select(F.col("node").alias("rep"), F.col("component").alias("comp")), "groups")
        sizes = groups.join(marks.select("rep", "n"), "rep").groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") * 8 / block_bytes)).alias("blocks"))
        links = map_batches(in_block_pairs(with_sets(groups.join(sizes, "comp"), "comp", "blocks"), "comp", "data"), lambda it: block_links(it, part, whole), "a long, b long")
        edges = edges.unionByName(links)
    comps = connected_components(edges, "a", "b").withColumnRenamed("node", "rep")
    work.drop()
    named = classes.drop("bands", "sketch").join(comps, "rep", "left").select(*key, F.coalesce("component", "rep").alias("component_id"))
    out = sets.drop("bands", "sketch").join(named, key, "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", *["text_hash"][: int(hashed)], "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", send: int = 1_000_000, **how) -> DataFrame:
    """``docs`` without those that a near-duplicate with a smaller id represents.

    Takes the arguments of ``near_duplicates``; all columns stay. Of a doc_id
    that repeats with other texts only the texts that are represented go, and of
    rows with the same doc_id (or without one) and the same text at most one stays.
    """
    found = scratch_table(near_duplicates(docs, id_col=id_col, text_col=text_col, send=send, hashed=True, **how), "found")
    key = lambda t: docs[id_col].cast("long").eqNullSafe(t["_id"]) & F.xxhash64(docs[text_col].cast("string")).eqNullSafe(t["_hash"])
    rows = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.bool_and("kept").alias("kept"), F.count("*").alias("n"))
    gone = sized(scratch_table(rows.where("not kept").select("_id", "_hash"), "dropped"), send)
    again = sized(scratch_table(rows.where("kept and n > 1").select("_id", "_hash"), "repeated"), send)
    left = docs.join(gone, key(gone), "left_anti")
    if again.isEmpty():
        return left
    return left.join(again, key(again), "left_anti").unionByName(docs.join(again, key(again), "left_semi").dropDuplicates([id_col, text_col]))

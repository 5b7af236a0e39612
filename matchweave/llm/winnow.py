"""Document fingerprints by winnowing, in DataFrame expressions only.

Every k-gram of code points is hashed by a polynomial modulo a prime; of each
window of consecutive k-grams the smallest hash is kept, the rightmost of equal
ones, together with its position. Two texts that share a passage of at least
``k + window - 1`` code points share a fingerprint of it.

Expressions on arrays have no running state, so the hash rolls by doubling: the
hash of 2, 4, 8... code points from two neighbours of half the length, each step
one pass, and no code point is hashed anew for every k-gram that holds it. Window
minima come from the same doubling. Hash and position are packed into one number,
the hash above, less the position, so that the smallest number of a window is its
smallest hash and, among equal hashes, the rightmost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchweave.sources.scratch import scratch_table

K, WINDOW = 16, 16
#: The prime of the polynomial, its base, and a factor that spreads its values.
PRIME, BASE, SPREAD = (1 << 31) - 1, 1_103_515_245, 1_812_433_253 % ((1 << 31) - 1)
_LOW = (1 << 31) - 1


def _rolled(codes: Column, reach: int) -> Column:
    """Polynomial hashes of twice as many code points, modulo the prime."""
    left = F.greatest(F.size(codes) - reach, F.lit(0))
    return F.zip_with(F.slice(codes, 1, left), F.slice(codes, reach + 1, left), lambda a, b: (a * pow(BASE, reach, PRIME) + b) % PRIME)


def with_grams(df: DataFrame, text: Column, name: str, start: Column | int = 0, k: int = K) -> DataFrame:
    """Add ``name``: the packed (hash, place) of every k-gram from code point ``start`` on.

    ``k`` is a power of two. A text of fewer than ``k`` code points is one k-gram,
    an empty one has none. The place is the position plus one.
    """
    start = F.lit(start) if isinstance(start, int) else start
    codes = F.transform(F.split(F.substring(text, start + 1, F.length(text)), ""), lambda c: F.ascii(c).cast("bigint") + 1)
    df, reach = df.withColumn(name, F.when(F.length(text) > start, codes).otherwise(F.array().cast("array<bigint>"))), 1
    few = F.aggregate(name, F.lit(0).cast("bigint"), lambda h, c: (h * BASE + c) % PRIME)
    df = df.withColumn(name, F.when((F.size(name) < k) & (F.size(name) > 0), F.array(few)).otherwise(F.col(name))).withColumn(f"{name}_few", F.size(name) == 1)
    while reach < k:
        df = df.withColumn(name, F.when(F.col(f"{name}_few"), F.col(name)).otherwise(_rolled(F.col(name), reach)))
        reach *= 2
    packed = F.transform(name, lambda h, i: F.shiftleft(h * SPREAD % PRIME, 31) - (i + start + 1))
    return df.withColumn(name, packed).drop(f"{name}_few")


def position(v: Column) -> Column:
    return (F.negate(v).bitwiseAND(F.lit(_LOW)) - 1).cast("int")


def gram_hash(v: Column) -> Column:
    return F.shiftright(v + F.lit(_LOW), 31)


def _halve(values: Column, reach: int) -> Column:
    """Minima of twice as many neighbours. If there are fewer, the one minimum of all."""
    left = F.greatest(F.size(values) - reach, F.lit(0))
    paired = F.zip_with(F.slice(values, 1, left), F.slice(values, reach + 1, left), lambda a, b: F.least(a, b))
    return F.when(F.size(values) > reach, paired).otherwise(F.when(F.size(values) > 0, F.array(F.array_min(values))).otherwise(values))


def with_minima(df: DataFrame, text: Column, name: str, start: Column | int = 0, k: int = K, window: int = WINDOW) -> DataFrame:
    """Add ``name``: the packed minimum of every window of ``text`` from code point ``start`` on.

    ``window`` is a power of two. A text with fewer k-grams has one window, an
    empty one none. Steps are columns of their own, so none is evaluated twice.
    """
    df, reach = with_grams(df, text, name, start, k), 1
    while reach < window:
        df = df.withColumn(name, _halve(F.col(name), reach))
        reach *= 2
    return df


def fingerprint(docs: DataFrame, text_col: str = "text", name: str = "fingerprint", k: int = K, window: int = WINDOW) -> DataFrame:
    """``docs`` with ``name``: the kept k-grams as (position, hash), in order of position.

    Null and empty texts keep nothing.
    """
    df = with_minima(docs, F.coalesce(F.col(text_col).cast("string"), F.lit("")), name, 0, k, window)
    return df.withColumn(name, positions_and_hashes(F.array_distinct(name)))


def positions_and_hashes(selected: Column) -> Column:
    """(position, hash) of packed numbers."""
    return F.transform(selected, lambda v: F.struct(position(v).alias("position"), gram_hash(v).alias("hash")))


def written(selected: Column) -> Column:
    """A fingerprint's hashes as text, eight hexadecimal digits each, in order of position."""
    return F.array_join(F.transform(selected, lambda v: F.hex(gram_hash(v).bitwiseOR(F.lit(1 << 31)))), "")


def hashes(selected: Column) -> Column:
    """Distinct hashes of a fingerprint."""
    return F.array_distinct(F.transform(selected, gram_hash))


def likeness(a: str, b: str, both: str) -> Column:
    """Jaccard likeness of two columns of distinct hashes with ``both`` in common; 1 for two empty ones."""
    union = F.size(a) + F.size(b) - F.col(both)
    return F.when(union == 0, F.lit(1.0)).otherwise(F.col(both) / F.greatest(union, F.lit(1)))


def bucket_shift(ids: DataFrame, rows: int, chars: int) -> int:
    """Bits to take off ids so that no bucket of ids with equal rests has over ``rows`` rows or ``chars`` code points; 0 if one id has more.

    Counts by rest are added up where they are; what returns is one number per shift.
    Shifts below 8 are tried only if texts are so long that 8 is too many.
    """
    for shifts in (range(8, 61, 4), range(0, 8, 2)):
        least = shifts[0]
        fine = ids.groupBy(F.shiftright("id", least).alias("p")).agg(F.count("*").alias("n"), F.sum("chars").alias("c"))
        all_ = fine.select("n", "c", F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.shiftright("p", s - least).alias("p")) for s in shifts])).alias("at"))
        most = all_.groupBy("at").agg(F.sum("n").alias("n"), F.sum("c").alias("c")).groupBy("at.s").agg(F.max("n").alias("n"), F.max("c").alias("c"))
        found = most.where((F.col("n") <= rows) & (F.col("c") <= chars)).agg(F.max("s")).first()[0]
        if found is not None:
            return found
    return 0


def next_rows(docs: DataFrame, id_col: str, text_col: str, rows: int = 256, chars: int = 4 << 20) -> DataFrame:
    """(id, text, bucket, own): every row in a bucket of neighbouring ids, and in each
    bucket once more the row that follows it, with own = false.

    A bucket is the ids that share their upper bits; how many bits is found from
    counts, so that neither a far id, dense runs of ids nor long texts make a bucket of
    over ``rows`` ids or ``chars`` code points. Equal ids, and all rows without an id, share a bucket, whose sort
    spills. Across buckets only one id per bucket is compared, in ranges. The row
    after the last is the first. Texts are shuffled once, by bucket.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    shift = bucket_shift(docs.where("id is not null").select("id", F.length("text").alias("chars")), rows, chars)
    placed = docs.withColumn("bucket", F.coalesce(F.shiftright("id", shift), F.lit(-(1 << 62))))  # null ids come first
    heads = placed.groupBy("bucket").agg(F.min("id").alias("head")).repartitionByRange("bucket")
    heads = scratch_table(heads.withColumn("part", F.spark_partition_id()), "heads")
    parts = heads.groupBy("part").agg(F.max("bucket").alias("top"))  # one row for each partition of the ranges
    last = parts.agg(F.max("top")).first()[0]
    parts = parts.withColumn("before", F.lag("top").over(Window.orderBy("part")))
    heads = heads.withColumn("to", F.lag("bucket").over(Window.partitionBy("part").orderBy("bucket"))).join(parts, "part")
    heads = scratch_table(heads.select("head", F.coalesce("to", "before", F.lit(last)).alias("to")), "followers")
    ahead = docs.join(heads, F.col("id").eqNullSafe(F.col("head"))).groupBy("to", "id").agg(F.min("text").alias("text"))
    return placed.withColumn("own", F.lit(True)).unionByName(ahead.select("id", "text", F.col("to").alias("bucket"), F.lit(False).alias("own")))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every text and of its edited text.

    The edited text is the text with its last floor(n/4) code points replaced by
    the first as many (or all) of the next document's, in ascending id, nulls
    first, equal ids in order of text; after the last comes the first. Returns
    the id, text, edited, own_print, edited_print (packed numbers), near_edited
    and near_next (Jaccard likeness of the hashes, 1 for two empty texts). Null
    texts are empty; repeated rows follow one another; a single row is its own
    next; an empty table gives no rows; other columns are ignored.

    Texts are shuffled once. Windows that lie within the kept part of a text are
    taken over into the edited text's fingerprint.
    """
    order = Window.partitionBy("bucket").orderBy(F.desc("own"), F.col("id").asc_nulls_first(), "text")
    rows = next_rows(docs, id_col, text_col).withColumn("next_text", F.lead("text").over(order))
    rows = with_minima(rows, F.col("text"), "minima", 0, k, window)
    rows = rows.withColumn("own_print", F.array_distinct("minima")).withColumn("a", hashes(F.col("own_print")))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), quarter)))
    # Windows that start before this place lie within the kept part.
    rows = rows.withColumn("keep", F.greatest(n - quarter - (k + window - 2), F.lit(0)))
    rows = with_minima(rows, F.col("edited"), "tail", F.col("keep"), k, window)
    tail = F.when((F.col("keep") > 0) & (F.length("edited") == n - quarter), F.array().cast("array<bigint>")).otherwise(F.col("tail"))
    rows = rows.withColumn("edited_print", F.array_distinct(F.concat(F.slice("minima", F.lit(1), F.col("keep")), tail)))
    rows = rows.withColumn("b", hashes(F.col("edited_print"))).withColumn("ab", F.size(F.array_intersect("a", "b")))
    rows = rows.withColumn("near_edited", likeness("a", "b", "ab")).drop("minima", "tail", "b", "next_text")
    rows = rows.withColumn("c", F.lead("a").over(order)).where("own").withColumn("ac", F.size(F.array_intersect("a", "c")))
    return rows.select(F.col("id").alias(id_col), "text", "edited", "own_print", "edited_print", "near_edited", likeness("a", "c", "ac").alias("near_next"))

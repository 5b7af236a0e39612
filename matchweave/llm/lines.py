"""Line dedup: lines that very many documents repeat are kept in one of them.

Lines are exploded, normalised and hashed; each hash's documents are counted, and
the lines of a hash over the threshold go from all documents but one. What is left
of a document is put together again by position. All of it is SQL functions.

Only hashes, ids and positions are shuffled to decide; a text moves once, to meet
the positions of its own lines that go, and not at all where Spark finds those few
enough to send.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchweave.llm.common import sized
from matchweave.sources.scratch import Scratch

#: What is stripped at both ends of a line.
_BLANK = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(_BLANK)), _UPPER, _LOWER)


def digest(text: Column) -> Column:
    """The first 128 bits of SHA-256."""
    return F.substring(F.unhex(F.sha2(F.encode(text, "utf-8"), 256)), 1, 16)


def without(lines: Column, gone: Column) -> Column:
    """Lines but those at the ascending positions ``gone`` (from 0), joined again; takes time in proportion to the lines."""
    at = lambda i: F.get(gone, i)
    # The run of lines before each position that goes, and that after the last one.
    runs = F.transform(
        F.sequence(F.lit(0), F.size(gone)),
        lambda i: F.slice(lines, F.coalesce(at(i - 1), F.lit(-1)) + 2, F.coalesce(at(i), F.size(lines)) - F.coalesce(at(i - 1), F.lit(-1)) - 1),
    )
    return F.array_join(F.flatten(runs), "\n")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20, least_docs: int = 3, send: int = 1_000_000) -> DataFrame:
    """doc_id, kept_text, n_lines (before) and n_dropped for every row.

    Texts are split at line feeds. The key of a line is the line without blanks
    (0x20, 0x09-0x0D) at both ends, A-Z lower-cased. A key of ``least_chars`` code
    points or more that ``least_docs`` documents or more hold loses all its lines
    except in the largest id that holds it.

    A null or empty text is one empty line and stays so (kept_text is empty). Rows
    of one id are one document; those without an id are one document together, smaller
    than any other. A document that loses all its lines has an empty text. Other
    columns are ignored; an empty table gives no rows. ``send`` bounds the list of
    repeated keys, 24 bytes each, that is broadcast; a longer one is joined by a shuffle.
    """
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("version", F.xxhash64("text"))  # tells the texts of one id apart
    held = Scratch(docs.sparkSession)
    split = F.split("text", "\n", -1)
    lines = docs.select("doc_id", "version", F.posexplode(split).alias("pos", "line")).withColumn("key", line_key(F.col("line")))
    lines = held.table(lines.where(F.length("key") >= least_chars).select("doc_id", "version", "pos", digest(F.col("key")).alias("h")), "lines")

    # Counting distinct ids groups by hash and id first, so that a line of every other document is spread over all tasks.
    n = F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))
    shared = lines.groupBy("h").agg(n.alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= least_docs).select("h", "keeper")
    shared = sized(held.table(shared, "shared"), send)
    hit = lines.join(shared, "h").where(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("keeper")))
    gone = hit.groupBy(F.col("doc_id").alias("_id"), F.col("version").alias("_version")).agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    met = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version")), "left")
    return met.select(
        "doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(without(split, F.col("gone"))).alias("kept_text"),
        F.size(split).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )

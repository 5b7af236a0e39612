"""The numbered corpus queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchweave.llm import bpe, chat, langid, licenses, lines, lloyd, merkle, minhash, near_vectors, oracles, packing, pii, warc, winnow


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and kept of every vector at cosine 0.95 or more."""
    return near_vectors.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 ids, each document closed by id 1; a null text is that id alone."""
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), sequence=2048, end_id=1)


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next document's."""
    found = winnow.edited_fingerprints(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"),
        winnow.written(F.col("own_print")).alias("fingerprint"), winnow.written(F.col("edited_print")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back."""
    return warc.read_archive(warc.write_archive(_table(spark, sf_dir, "pages")))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents over three-word shingle sets of 85 % likeness or more."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=3, part=85, whole=100)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text: the base spans' counts and digest, and all spans."""
    docs = _table(spark, sf_dir, "documents")
    found = pii.detect(docs, pii.fit(docs))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[number(k) for k in pii.BASE], F.sha2(F.encode(pii.written(F.col("base")), "utf-8"), 256).alias("base_sha256"),
        pii.written(F.concat("base", "added")).alias("spans"),
    )


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again; a null text is an empty one."""
    path = public_tokenizers.path("word_bpe_49k.json")
    done = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), path), path)
    return done.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"),
    )


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one of control strings, formatted and read back with their loss mask."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    records = turns.unionByName(extra).select("conv_id", F.struct("conv_id", "turn", "role", "text").alias("body"))
    return chat.read_back(chat.format_turns(chat.canonical_turns(records, "conv_id", "body")))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate blocks of every text with their confirmed licenses, or the best unconfirmed one."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from the rows that are not held out."""
    return langid.identify(_table(spark, sf_dir, "documents"))


def op11_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all usable vectors in 8 parts of 16 entries after 6 rounds, with the error of each and of its label."""
    coded, books = lloyd.product_codes(_table(spark, sf_dir, "embeddings"), label_col="label", scale=4096, parts=8, entries=16, rounds=6)
    out = lloyd.with_label_error(coded).withColumn("codebooks_sha256", F.lit(lloyd.codebooks_digest(books)))
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines of 20 characters or more that 3 documents hold, but for the largest id."""
    found = lines.drop_repeated_lines(_table(spark, sf_dir, "documents"), least_chars=20, least_docs=3)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, folded from the leaf of a text without line feeds where crc32 of doc_id is even."""
    docs = _table(spark, sf_dir, "documents")
    as_is = lambda text: merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    even = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 2 == 0
    again = F.when(even, as_is(F.replace("text", F.lit("\n"), F.lit(""))))
    found = merkle.manifest(docs.select("doc_id", "source", as_is(F.col("text")).alias("leaf"), again.alias("tampered")), also=("tampered",), fanout=3)
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("left"), F.col("right"))
    proof = F.array_join(F.flatten(F.zip_with("left", "right", lambda before, after: F.array(before, after))), "")
    out = found.select("doc_id", "leaf", "subroot", "root", F.sha2(F.encode(proof, "utf-8"), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_near_vectors, op2_packing, op3_winnowing, op4_warc, op5_minhash, op6_pii, op7_bpe, op8_chat, op9_licenses, op10_langid, op11_lloyd, op12_lines, op13_merkle,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """The other queries rest on hashes of their own, a tokenizer or a trained model; tests hold them against brute force."""
    return {
        "op1_near_vectors": oracles.NEAR_VECTORS, "op4_warc": oracles.WARC, "op5_minhash": oracles.MINHASH, "op8_chat": oracles.CHAT,
        "op11_lloyd": oracles.LLOYD, "op12_lines": oracles.LINES, "op13_merkle": oracles.MERKLE,
    }

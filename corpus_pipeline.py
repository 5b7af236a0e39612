"""The corpus pipeline: language ID, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again for the next. All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchweave.llm import langid, minhash, packing, pii
from matchweave.llm.common import fresh
from matchweave.sources.scratch import scratch_table

#: A document whose most likely language has less than this is rejected.
LEAST_LANGUAGE_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those of no clear language.

    Learns from the rows that are not held out, as the operator's query does. A
    null or empty text has no letter and goes; repeated rows share their fate; an empty
    table stays empty. Columns of other names stay.
    """
    model = langid.fit(docs.where(~langid.held_out()))
    pred, score = fresh(docs, "lang_pred"), fresh(docs, "lang_score")
    found = langid.predict(docs, model, pred_col=pred, score_col=score)
    sure = (F.col(pred) != langid.UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE_SCORE)
    return found.where(sure).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of near-duplicates: five words, similarity 0.8 or more.

    A null, empty or wordless text is like no other and stays, as does a row without an
    id unless another text represents it; of rows with the same id and text one stays.
    """
    return minhash.drop_near_duplicates(docs, width=5, part=80, whole=100)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind in brackets and count the characters again.

    A null text stays null, with null n_chars; an empty one stays empty. No row goes.
    """
    clean = pii.redact(docs, pii.fit(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 ids; a null or empty text is its end id alone, repeated rows are packed each."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), sequence=2048, end_id=1)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", pack)]
#: SQL can express neither the trained stages nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

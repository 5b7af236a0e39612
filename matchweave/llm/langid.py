"""Language identification: sparse multinomial logistic regression.

Features are TF-IDF weights of hashed character n-grams (one to three letters,
word edges included). Document frequencies cover every learnable row. Weights
are fitted on a bounded, language-balanced sample by follow-the-regularised-
leader with elastic-net penalties, then one temperature is fitted on rows of
the sample that the weights have not seen.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchweave.llm.common import fresh, map_batches, small_batches
from matchweave.llm.textbuf import text_slices
from matchweave.sources.scratch import scratch_table

BITS = 16
SIZE = 1 << BITS
UNKNOWN = "und"
#: Letters of the code points below this are read from a table.
_KNOWN = 0x2000
_LETTER = np.array([c if chr(c).isalpha() else 0 for c in range(_KNOWN)], dtype=np.uint32)


def slices(texts: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int, list[str | None]]]:
    """(first, after the last, texts) of runs of whole texts for ``batch_grams``."""
    for lo, hi, _, _ in text_slices(texts, most):
        for start in range(lo, hi, SIZE - 1):
            stop = min(hi, start + SIZE - 1)
            yield start, stop, texts.slice(start, stop - start).to_pylist()


def batch_grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, bucket, count) of the n-grams of fewer than 65,536 texts, in order; none of a text without a letter."""
    low = ["" if t is None else t.lower() for t in texts]
    size = np.fromiter(map(len, low), dtype=np.int64, count=len(low)) + 2
    stop = np.cumsum(size)
    codes = np.frombuffer("".join(low).encode("utf-32-le", "replace"), dtype=np.uint32)
    c, inner = np.zeros(int(size.sum()), dtype=np.uint32), np.ones(int(size.sum()), dtype=bool)
    inner[stop - 1] = inner[stop - size] = False
    far = codes >= _KNOWN
    plain = _LETTER[np.where(far, 0, codes)]
    for k in np.unique(codes[far]).tolist():
        if chr(k).isalpha():
            plain[codes == k] = k
    c[inner] = plain
    keep = c > 0
    keep[1:] |= c[:-1] > 0  # a run of other characters is one word edge
    keep[stop - size] = True
    owner = np.repeat(np.arange(len(low), dtype=np.uint32), size)[keep]
    c = c[keep]
    one = c * np.uint32(0x9E3779B1) + np.uint32(1)
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + c[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE3D) + c[2:]
    same, near = owner[1:] == owner[:-1], owner[2:] == owner[:-2]
    grams = np.concatenate([one[c > 0], two[same], three[near]])
    grams = (grams ^ (grams >> np.uint32(16))) * np.uint32(0x27D4EB2F)
    keys = np.sort((np.concatenate([owner[c > 0], owner[:-1][same], owner[:-2][near]]) << np.uint32(BITS)) | (grams >> np.uint32(32 - BITS)))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(keys)))
    return (keys[first] >> np.uint32(BITS)).astype(np.int64), (keys[first] & np.uint32(SIZE - 1)).astype(np.int64), counts


def tf_idf(buckets: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf[buckets]
    return x / max(np.linalg.norm(x), 1e-12)


@dataclass
class Model:
    """Languages in order, IDF per bucket, weights (buckets x languages), biases, temperature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def probabilities(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the texts that have a letter, and their languages' probabilities."""
        owner, buckets, counts = batch_grams(texts)
        x = np.log1p(counts) * self.idf[buckets]
        some = np.unique(owner)
        total = lambda values: np.bincount(owner, values, len(texts))[some]
        z = np.stack([total(x * self.weights[buckets, k]) for k in range(len(self.languages))], axis=1)
        return some, softmax((z / np.sqrt(total(x * x))[:, None] + self.bias) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with one (z, n) pair per bucket and class; the last bucket is the bias.

    ``rows``: buckets, TF-IDF weights, class number.
    """
    z, n = np.zeros((SIZE + 1, classes)), np.zeros((SIZE + 1, classes))

    def weights(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    order = np.random.default_rng(5)
    for _ in range(epochs):
        for r in order.permutation(len(rows)).tolist():
            buckets, x, k = rows[r]
            at, x = np.append(buckets, SIZE), np.append(x, 1.0)
            zz, nn = z[at], n[at]
            w = weights(zz, nn)
            p = softmax(x @ w)
            p[k] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(nn + g * g) - np.sqrt(nn)) / alpha
            z[at], n[at] = zz + g - sigma * w, nn + g * g
    w = weights(z, n)
    return w[:SIZE].astype(np.float32), w[SIZE]


def fit_temperature(logits: np.ndarray, classes: np.ndarray) -> float:
    """The temperature of least log loss, found by golden-section search.

    Targets are smoothed to (n+1)/(n+2), so rows without an error don't make
    the model certain.
    """
    n, k = logits.shape
    if not n or k < 2:
        return 1.0
    target = np.full((n, k), 1 / (n + 2) / (k - 1))
    target[np.arange(n), classes] = (n + 1) / (n + 2)

    def loss(t: float) -> float:
        return -float(np.mean((target * np.log(np.maximum(softmax(logits / math.exp(t)), 1e-300))).sum(axis=1)))

    lo, hi, g = math.log(0.02), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return math.exp((lo + hi) / 2)


def fit(learnable: DataFrame, fit_rows: int = 2000, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4, most_languages: int = 1000) -> Model:
    """Learn from (doc_id, text, lang) rows; rows without text, lang or doc_id teach nothing.

    ``fit_rows`` bounds the rows whose n-grams reach the driver, shared evenly
    by the languages; document frequencies are counted over all rows, in
    2**16 buckets. More than ``most_languages`` languages are refused.
    """
    rows = learnable.where("text is not null and lang is not null and doc_id is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(most_languages + 1).collect()}
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros(SIZE, np.float32), np.zeros((SIZE, 0), np.float32), np.zeros(0), 1.0)
    share = {k: min(1.0, fit_rows / len(languages) / n) for k, n in counts.items()}
    spread = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    picked = F.coalesce(spread < F.element_at(F.create_map(*[F.lit(x) for kv in share.items() for x in kv]), F.col("lang")), F.lit(False))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SIZE, dtype=np.int64)
        names = ["bucket", "n", "doc_id", "lang", "buckets", "counts"]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary()]
        for batch in batches:
            kept: list[tuple] = []
            ids, langs, picks = (batch.column(k).to_pylist() for k in (0, 2, 3))
            for lo, hi, texts in slices(batch.column(1)):
                owner, buckets, counts = batch_grams(texts)
                seen += np.bincount(buckets, minlength=SIZE)
                at = np.searchsorted(owner, np.arange(hi - lo + 1)).tolist()
                for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True), lo):
                    if picks[k] and b > a:
                        kept.append((None, None, ids[k], langs[k], buckets[a:b].astype("<u2").tobytes(), counts[a:b].astype("<u4").tobytes()))
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*kept, strict=True), kinds, strict=True)], names=names)
        at = np.flatnonzero(seen)
        none = [pa.nulls(len(at), k) for k in kinds[2:]]
        yield pa.RecordBatch.from_arrays([pa.array(at, kinds[0]), pa.array(seen[at], kinds[1]), *none], names=names)

    learned = scratch_table(map_batches(rows.select("doc_id", "text", "lang", picked.alias("pick")), count, "bucket int, n long, doc_id long, lang string, buckets binary, counts binary"), "grams")
    frequency = np.zeros(SIZE)
    for r in learned.where("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        frequency[r["bucket"]] = r["n"]
    idf = (np.log((1 + sum(counts.values())) / (1 + frequency)) + 1).astype(np.float32)
    sample = []
    for r in learned.where("buckets is not null").select("doc_id", "lang", "buckets", "counts").distinct().collect():
        buckets = np.frombuffer(r["buckets"], "<u2").astype(np.int64)
        sample.append((r["doc_id"], bytes(r["buckets"]), buckets, tf_idf(buckets, np.frombuffer(r["counts"], "<u4"), idf), languages.index(r["lang"])))
    sample.sort(key=lambda r: r[:2])
    check = [r[2:] for k, r in enumerate(sample) if k % 5 == 4]
    weights, bias = fit_ftrl([r[2:] for k, r in enumerate(sample) if k % 5 != 4], len(languages), epochs, alpha, beta, l1, l2)
    logits = np.array([x @ weights[b] + bias for b, x, _ in check]).reshape(len(check), len(languages))
    return Model(languages, idf, weights, bias, fit_temperature(logits, np.array([k for *_, k in check], dtype=np.int64)))


def predict(docs: DataFrame, model: Model, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with ``pred_col`` and ``score_col``, from the text alone.

    A null text or one without a letter is ``und`` with score 0, and so is every
    text if the model knows no language. Columns of those names are replaced.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def guess(texts: pa.Array) -> pa.Array:
        model = shared.value
        names, best, score = np.array([*model.languages, UNKNOWN]), np.full(len(texts), len(model.languages)), np.zeros(len(texts))
        for lo, _, part in slices(texts) if model.languages else ():
            some, p = model.probabilities(part)
            best[lo + some] = p.argmax(axis=1)
            score[lo + some] = p.max(axis=1)
        return pa.StructArray.from_arrays([pa.array(names[best].tolist(), pa.string()), pa.array(score)], names=["lang_pred", "score"])

    plain = docs.drop(pred_col, score_col)
    own = fresh(plain, "guess")
    found = plain.withColumn(own, guess(F.col(text_col).cast("string")))
    return found.select(*[F.col(f"`{c}`") for c in plain.columns], F.col(own)["lang_pred"].alias(pred_col), F.col(own)["score"].alias(score_col))


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id's text leaves 2 on division by 4; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, **how) -> DataFrame:
    """Learn from the rows that are not held out, then predict every row.

    ``docs`` has doc_id, text and lang; returns doc_id, held_out, lang_pred and
    score, one row for each row of ``docs``.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = fit(docs.where(~held_out()), **how)
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")

"""Quality classifier by importance resampling.

Two generative models over hashed word and word-pair counts: the target model from labelled
good documents (at most LABELLED of them, those of smallest hash), the raw model from every
document.  Both are scaled to the target's size and smoothed by the same PRIOR counts a
bucket, so that an n-gram the sample could have missed weighs little.  A document's log
importance weight is the sum of the log ratios of its n-grams; adding seeded Gumbel noise
and keeping the k largest keys samples k documents in proportion to their weights without
replacement.  Without a given k, k is calibrated: the number of documents whose key reaches
the KEEP-quantile of labelled good ones.  The k-th key is found by counting.

Defined cases: a null or empty text has weight 0 and only its noise; equal texts have equal
weights, equal (doc_id, text) equal keys; without labelled good documents everything stays;
labels for unknown ids are ignored, and a document with several labels counts by its best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlineage.llm.common import cut, fresh, release

LABELLED, BUCKET_BITS, PRIOR, KEEP, SEED = 20_000, 17, 20.0, 0.001, 11


class _Hashes(dict):
    """Word -> the 32-bit hashes of its parts (runs of word characters, single symbols) as bytes."""

    MOST = 120_000

    def __init__(self):
        import re

        super().__init__()
        self.parts = re.compile(rb"[\w\x80-\xff]+|[^\w\s]").findall

    def __missing__(self, word: bytes) -> bytes:
        import xxhash

        value = b"".join([xxhash.xxh32_intdigest(p).to_bytes(4, "little") for p in self.parts(word)])
        if len(self) < self.MOST:
            self[word] = value
        return value


_HASHES: list[_Hashes] = []


def ngrams(text: str | None, bits: int = BUCKET_BITS) -> np.ndarray:
    """Buckets of the words and word pairs of a whole text, repeats included."""
    if not _HASHES:
        _HASHES.append(_Hashes())
    words = text.lower().encode().split() if text else []
    one = np.frombuffer(b"".join(map(_HASHES[0].__getitem__, words)), dtype="<u4").astype(np.uint64)
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (np.concatenate([one * np.uint64(0xD6E8FEB86659FD93), two]) >> np.uint64(64 - bits)).astype(np.int64)


def gumbel(ids: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Seeded Gumbel noise of 64-bit ids."""
    x = ids.astype(np.int64).view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) + 0.5
    return -np.log(-np.log(u / 2.0**53))


def good_ids(labels: DataFrame, most: int = LABELLED) -> list[int]:
    """Ids of labelled good documents, at most so many, those of smallest hash."""
    good = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("q")).where("q = 1")
    return [r[0] for r in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id").collect()]


class Fitted:
    """Smoothed counts of both models by bucket, at the target's scale, and the ids the target was fitted on."""

    def __init__(self, good: np.ndarray, target: np.ndarray, raw: np.ndarray, prior: float):
        self.good, self.bits = good, len(raw).bit_length() - 1
        share = target.sum() / max(1, raw.sum())
        self.target, self.raw = (target + prior).astype(np.float32), (raw * share + prior).astype(np.float32)
        if not target.sum():
            self.target = self.raw
        self.ratios = np.log(self.target) - np.log(self.raw)

    def weight(self, text: str | None, own: bool) -> float:
        """Log importance weight; a document of the target's sample is weighed by the target model without itself."""
        at = ngrams(text, self.bits)
        if not own:
            return float(self.ratios[at].sum(dtype=np.float64))
        at, n = np.unique(at, return_counts=True)
        return float((n * (np.log(np.maximum(self.target[at] - n, 1.0)) - np.log(self.raw[at]))).sum(dtype=np.float64))


def fit(docs: DataFrame, good: list[int], bits: int = BUCKET_BITS, prior: float = PRIOR) -> Fitted:
    """Both models; the raw one counts every document."""
    ids = np.array(sorted(good), dtype=np.int64)
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros((2, size), dtype=np.int64)
        for b in batches:
            doc = b.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False)
            known = np.isin(doc, ids) & ~np.array(b.column("doc_id").is_null())
            for at in range(0, b.num_rows, 512):
                some = [ngrams(t.as_py(), bits) for t in b.column("text").slice(at, 512)]
                got[0] += np.bincount(np.concatenate(some), minlength=size)
                if known[at : at + 512].any():
                    got[1] += np.bincount(np.concatenate([x for x, k in zip(some, known[at : at + 512]) if k]), minlength=size)
        _HASHES.clear()  # the next stage's caches need the room
        release()
        at = np.flatnonzero(got[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(got[0][at]), pa.array(got[1][at])], names=["bucket", "raw", "target"])

    rows = _texts(docs).mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(size), np.zeros(size)  # at most 2 ** bits rows
    raw[rows["bucket"]], target[rows["bucket"]] = rows["raw"], rows["target"]
    return Fitted(ids, target, raw, prior)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _keys(fitted: Fitted, doc: pa.Array, texts: pa.Array, seed: int) -> tuple[np.ndarray, np.ndarray]:
    ids = doc.fill_null(0).to_numpy(zero_copy_only=False)
    own = np.isin(ids, fitted.good) & ~np.array(doc.is_null())
    weight = np.fromiter((fitted.weight(t.as_py(), o) for t, o in zip(texts, own)), dtype=np.float64, count=len(texts))
    return weight, weight + gumbel(ids, seed)


def scores(docs: DataFrame, fitted: Fitted, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, log_weight, gumbel_key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weight, key = _keys(fitted, b.column("doc_id"), b.column("text"), seed)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(weight), pa.array(key)], names=["doc_id", "log_weight", "gumbel_key"])
        _HASHES.clear()
        release()

    return _texts(docs).mapInArrow(run, "doc_id long, log_weight double, gumbel_key double")


def kth_largest(keys: DataFrame, column: str, k: int, width: int = 4096) -> float:
    """The k-th largest value, exactly: a histogram narrows its interval until few values are left."""
    low, high, n = keys.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k >= n:
        return float("-inf")
    if k < 1:
        return float("inf")
    within = F.col(column).between(low, high)
    while True:
        part = keys.where(within).groupBy(F.least(F.lit(width - 1), F.floor((F.col(column) - low) / max((high - low) / width, 5e-324))).alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).orderBy(F.desc("b")).collect()
        for r in part:  # at most width rows
            if k <= r["n"]:
                break
            k -= r["n"]
        if r["lo"] == r["hi"]:
            return r["lo"]
        if r["n"] <= width:
            return sorted((x[0] for x in keys.where(F.col(column).between(r["lo"], r["hi"])).select(column).collect()), reverse=True)[k - 1]
        low, high = r["lo"], r["hi"]
        within = F.col(column).between(low, high)


def model(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED) -> tuple[Fitted, DataFrame, float]:
    """(both models, written scores of every document, the least key that is kept)."""
    good = good_ids(labels)
    fitted = fit(docs, good)
    scored = cut(scores(docs, fitted, seed), "scores")
    if k is not None:
        return fitted, scored, kth_largest(scored, "gumbel_key", k)
    if not good:
        return fitted, scored, float("-inf")
    known = docs.sparkSession.createDataFrame([(i,) for i in good], "doc_id long")
    least = scored.join(F.broadcast(known), "doc_id").agg(F.percentile("gumbel_key", F.lit(KEEP))).first()[0]  # over the bounded sample
    if least is None:
        return fitted, scored, float("-inf")
    return fitted, scored, kth_largest(scored, "gumbel_key", scored.where(F.col("gumbel_key") >= F.lit(float(least))).count())


def classify(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """docs -> (doc_id, log_weight, gumbel_key, kept), a row each."""
    _, scored, least = model(docs, labels, k)
    return scored.withColumn("kept", F.col("gumbel_key") >= F.lit(least))


def keep(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED) -> DataFrame:
    """The documents that the resampling keeps, with all their columns; no shuffle of texts."""
    fitted, _, least = model(docs, labels, k, seed)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, key = _keys(fitted, b.column(len(names)), b.column(len(names) + 1), seed)
            yield b.select(list(range(len(names)))).filter(pa.array(key >= least))
        _HASHES.clear()
        release()

    both = docs.select("*", F.col("doc_id").cast("long").alias(fresh(docs, "_id_")), F.col("text").cast("string").alias(fresh(docs, "_text_")))
    return both.mapInArrow(run, docs.schema)

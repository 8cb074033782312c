"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Target texts are all documents labelled quality 1; raw text is every document. Words and word pairs are hashed into
BUCKETS counts (from zlib.crc32, the same everywhere); each model is the smoothed frequencies of its counts. A
document's weight is its log likelihood ratio, and the k documents of largest weight plus Gumbel noise are a sample
without replacement in proportion to the weights. The noise comes from the document's id and a seed, so that a lost
task draws the same again.

Counts cover all documents: each task adds up one array of BUCKETS counts. The k-th largest key is found by narrowing
a histogram, never by a sort in one task. Defined cases: null or empty texts have weight 0; null ids draw the noise of an
empty id; ties of keys go to the smaller id; equal rows are ranked together; without labelled documents the target is the raw text; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import persisted

BUCKETS = 1 << 14
MOST_IN_PLACE = 8_000_000  # labelled ids (8 bytes each) that are sent to the texts; beyond, texts are joined by shuffle
KEEP = 0.8  # the sampled share of documents
SEED = 7
SMOOTHING = 1.0
_WORD = re.compile(r"\w+|[^\w\s]+")
_CACHED = 500_000


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHED:
            self.clear()
        h = self[word] = zlib.crc32(word.encode())
        return h


_hashes = _Hashes()


def buckets(text: str) -> np.ndarray:
    """Buckets of words, then of pairs."""
    words = _WORD.findall(text.lower())
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    pairs = (h[:-1] * np.uint64(0x9E3779B1) + h[1:] * np.uint64(0x85EBCA6B)) >> np.uint64(7)
    return (np.concatenate([h, pairs]) % np.uint64(BUCKETS)).astype(np.int64)


def model(documents: DataFrame, labels: DataFrame) -> np.ndarray:
    """log(target frequency / raw frequency) of each bucket."""
    ids = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    marked = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    in_place = ids.count() <= MOST_IN_PLACE
    if in_place:  # texts stay where they are
        shared = documents.sparkSession.sparkContext.broadcast(np.sort(ids.toPandas()["doc_id"].to_numpy(np.int64)))
    else:
        marked = marked.join(ids.withColumn("good", F.lit(True)), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))

    def good(batch: pa.RecordBatch) -> list[bool]:
        if not in_place:
            return batch.column("good").to_pylist()
        at, targets = batch.column("doc_id"), shared.value
        if not len(targets):
            return [False] * len(at)
        values = at.fill_null(0).to_numpy(zero_copy_only=False)
        found = targets[np.minimum(np.searchsorted(targets, values), len(targets) - 1)] == values
        return (found & at.is_valid().to_numpy(zero_copy_only=False)).tolist()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            for text, is_good in zip(batch.column("text").to_pylist(), good(batch), strict=True):
                n = np.bincount(buckets(text), minlength=BUCKETS)
                sums[0] += n
                if is_good:
                    sums[1] += n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(sums[0]), pa.array(sums[1])], ["bucket", "raw", "target"])

    rows = marked.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).orderBy("bucket").toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[rows["bucket"]], target[rows["bucket"]] = rows["raw"], rows["target"]
    if not target.sum():
        target = raw
    return np.log((target + SMOOTHING) / (target + SMOOTHING).sum()) - np.log((raw + SMOOTHING) / (raw + SMOOTHING).sum())


def weights(documents: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id, log_weight, key: the weight plus Gumbel noise."""
    shared = documents.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = [float(shared.value[buckets(t)].sum()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(w, pa.float64())], ["doc_id", "log_weight"])

    found = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, log_weight double")
    uniform = (F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(SEED)), 11).cast("double") + 0.5) / float(1 << 53)
    return found.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform)))


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 1024, few: int = 4096) -> float:
    """The exact k-th largest value: a histogram's bin that holds it is cut again until few values are left to sort."""
    low, high, n = df.select(F.min(column), F.max(column), F.count(column)).first()
    above = 0
    while True:
        inside = df.where((F.col(column) >= low) & (F.col(column) <= high))
        width = (high - low) / bins
        if n <= few or width <= 0 or low + width == low:
            values = [r[0] for r in inside.groupBy(column).count().orderBy(F.desc(column)).limit(few + bins).collect()] if n <= few else []
            if not values:
                return low
            counts = {r[0]: r[1] for r in inside.groupBy(column).count().collect()}
            for v in values:
                above += counts[v]
                if above >= k:
                    return v
            return low
        at = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1))
        rows = inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy(F.desc("bin")).collect()
        for r in rows:
            if above + r["n"] >= k:
                low, high, n = r["low"], r["high"], r["n"]
                break
            above += r["n"]


def resampled(documents: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """doc_id, log_weight, key, selected of every document; ceil(keep * n) are selected (more only if equal rows tie)."""
    scored = persisted(weights(documents, model(documents, labels)), "weights")
    n = scored.count()
    k = int(np.ceil(keep * n))
    if not k:
        return scored.withColumn("selected", F.lit(False))
    bar = kth_largest(scored, "key", k)
    more = scored.where(F.col("key") > bar).count()
    tied = scored.where(F.col("key") == bar).select(F.coalesce("doc_id", F.lit(-(1 << 62))).alias("id")).orderBy("id").limit(k - more).agg(F.max("id")).first()[0]
    return scored.withColumn("selected", (F.col("key") > bar) | ((F.col("key") == bar) & (F.coalesce("doc_id", F.lit(-(1 << 62))) <= tied)))

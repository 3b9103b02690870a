"""Quality by importance resampling: two hashed n-gram models and a Gumbel top-k.

Bag-of-n-gram models with BUCKETS hashed counts are fitted to target text (labelled documents of good
quality, a bounded sample) and to raw text (all documents). A document's log weight is the log probability
of its n-grams under the target model less that under the raw one, per CHUNK n-grams: that of an average
chunk of so many, so that long texts do not outweigh by length alone. With Gumbel noise added, the k largest keys are a
sample without replacement in proportion to the weights; k is the share of good documents among all labelled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stancemill.llm.common import GOLDEN, chunks, mix, small_batches, staged, word_hashes

BUCKETS = 1 << 14
#: N-grams (words and word pairs) of the chunk that a document's weight is of.
CHUNK = 128
#: At most so many labelled documents, by hash of their id, fit the target model.
TARGET_ROWS = 20_000
SEED = 20_177
#: Bins of each step that finds the k-th key.
BINS = 4096


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and word pairs of each text, and bounds by text."""
    words, bounds = word_hashes(texts)
    n = np.diff(bounds)
    pairs = mix(words[:-1] * GOLDEN + words[1:]) if len(words) > 1 else words[:0]
    inside = np.ones(max(0, len(words) - 1), bool)
    ends = bounds[1:-1]
    inside[ends[(ends > 0) & (ends < len(words))] - 1] = False
    text = np.repeat(np.arange(len(n)), n)
    key = np.concatenate((words, pairs[inside]))
    owner = np.concatenate((text, text[:-1][inside] if len(words) > 1 else text[:0]))
    order = np.argsort(owner, kind="stable")
    count = np.bincount(owner, minlength=len(n))
    return (key[order] & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate(([0], np.cumsum(count)))


def _counts(target: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            ids = batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False)
            wanted = np.isin(ids, target) & ~batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            for start, run in chunks(batch.column("text").to_pylist()):
                bucket, bounds = features(run)
                raw += np.bincount(bucket, minlength=BUCKETS)
                good += np.bincount(bucket[np.repeat(wanted[start : start + len(run)], np.diff(bounds))], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(good[some])], names=["bucket", "raw", "good"])

    return work


def log_ratios(docs: DataFrame, labels: DataFrame, target_rows: int = TARGET_ROWS) -> np.ndarray:
    """log p_target - log p_raw for each bucket; zeros if no target document has a word. Counts of the raw model cover all documents."""
    small_batches(docs.sparkSession)
    good = labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    good = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_rows)
    target = np.sort(np.array([r[0] for r in good.collect()], dtype=np.int64))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = d.mapInArrow(_counts(target), "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect()  # BUCKETS rows at most
    raw, tgt = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rows:
        raw[r["bucket"]], tgt[r["bucket"]] = r["raw"], r["good"]
    if not tgt.sum():
        return np.zeros(BUCKETS)
    # Smoothing spreads one count for each bucket in the raw model's proportions, so that buckets that neither model tells apart weigh nothing.
    base = (raw + 1) / (raw.sum() + BUCKETS)
    return np.log((tgt + BUCKETS * base) / (tgt.sum() + BUCKETS)) - np.log(base)


def keys_of(ids: pa.Array, texts: list[str | None], ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log weights, and keys with Gumbel noise drawn from a hash of the id (null: of the text's features)."""
    weight, extra = np.zeros(len(texts)), np.zeros(len(texts), np.uint64)
    for start, run in chunks(texts):
        bucket, bounds = features(run)
        some = np.flatnonzero(np.diff(bounds))
        if len(some):
            weight[start + some] = np.add.reduceat(ratios[bucket], bounds[:-1][some]) * CHUNK / np.diff(bounds)[some]
            extra[start + some] = np.add.reduceat(mix(bucket.astype(np.uint64) + np.uint64(1)), bounds[:-1][some])
    none = ids.is_null().to_numpy(zero_copy_only=False)
    number = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    bits = mix(mix(np.where(none, extra, number) + np.uint64(SEED)) * GOLDEN + np.uint64(SEED))
    u = ((bits >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
    return weight, weight - np.log(-np.log(u))


def scores(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, log_weight and key of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight, key = keys_of(batch.column("doc_id"), batch.column("text").to_pylist(), ratios)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(weight), pa.array(key)], names=["doc_id", "log_weight", "key"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(work, "doc_id long, log_weight double, key double")


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The exact k-th largest of the finite values of a column, by counting in ever narrower bins; the driver sees at most BINS counts or values at once."""
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k >= n:
        return -np.inf
    if k <= 0:
        return np.inf
    above = 0
    while True:
        inside = df.filter(F.col(column).between(low, high))
        if low == high:
            return low
        width = (high - low) / BINS
        if inside.count() <= BINS or width == 0 or low + width == low:
            values = sorted((r for r in inside.groupBy(column).count().collect()), key=lambda r: -r[0])
            for value, count in values:
                above += count
                if above >= k:
                    return value
        bins = inside.groupBy(F.least(F.floor((F.col(column) - low) / width), F.lit(BINS - 1)).alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
        for b in sorted(bins.collect(), key=lambda r: -r["bin"]):
            if above + b["n"] >= k:
                low, high = b["low"], b["high"]
                break
            above += b["n"]


def good_share(labels: DataFrame) -> float:
    """The share of labelled documents of good quality, plus two standard errors: a stage should keep good documents."""
    n, good = labels.filter("quality is not null").agg(F.count("*"), F.count_if(F.col("quality") == 1)).first()
    if not n:
        return 1.0
    p = good / n
    return min(1.0, p + 2 * (p * (1 - p) / n) ** 0.5)


def fitted(docs: DataFrame, labels: DataFrame, share: float | None = None) -> tuple[np.ndarray, float, DataFrame]:
    """Log ratios, the least key of the k = share * rows kept (default: good_share), and the scores."""
    ratios = log_ratios(docs, labels)
    scored = staged(scores(docs, ratios), "scores")
    k = round((good_share(labels) if share is None else share) * scored.count())
    return ratios, kth_largest(scored, "key", k), scored


def resampled(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """doc_id, log_weight, key and kept of each row of docs (doc_id, text, ...), given labels (doc_id, quality, toxic, ...).

    Null and empty texts have weight 0 (log); a text of any length is counted whole; rows of equal keys at the threshold (equal id and text) are all
    kept. Labels with a null id, a null quality or of documents that are not there fit nothing, a null toxic counts as not toxic; without labels of good quality all
    weights are equal, and without any labels all rows are kept. No rows give no rows; other columns are ignored.
    """
    _, least, scored = fitted(docs, labels, share)
    return scored.withColumn("kept", F.col("key") >= F.lit(float(least)))


def keep_good(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """The rows of docs that resampled() keeps, with their columns; rows are scored again where they lie, so texts are not shuffled."""
    ratios, least, _ = fitted(docs, labels, share)
    at, to = docs.columns.index("doc_id"), docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, key = keys_of(batch.column(at).cast(pa.int64()), batch.column(to).to_pylist(), ratios)
            yield batch.filter(pa.array(key >= least))

    return docs.mapInArrow(work, docs.schema)

"""What the operators of this subpackage share: shared storage, staged tables, vectorised hashing of texts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

MASK64 = (1 << 64) - 1
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text that one vectorised step takes: its arrays need some 40 times as much memory.
CHUNK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, on a single machine a temporary one, on a cluster an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(where)
        return where.rstrip("/")
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="stancemill-"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get().rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: later steps survive the loss of the executors that made it."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes staged tables that no later step reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB, so that Python workers stay small however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5000")
    # Joins that look up a few texts filter them by a Bloom filter before the shuffle, on tables of any size.
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "1MB")


def chunks(texts: list[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) of runs of about limit characters; nulls become empty."""
    start, run, size = 0, [], 0
    for i, x in enumerate(texts):
        run.append(x or "")
        size += len(run[-1])
        if size >= limit:
            yield start, run
            start, run, size = i + 1, [], 0
    if run:
        yield start, run


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


OTHER_SPACE = re.compile(r"[^\S\x00-\x7f]")
POWERS = np.cumprod(np.full(64, 0x100000001B3, dtype=np.uint64))


def powers(n: int) -> np.ndarray:
    global POWERS
    if n > len(POWERS):
        POWERS = np.cumprod(np.full(max(n, 2 * len(POWERS)), 0x100000001B3, dtype=np.uint64))
    return POWERS


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, and for each text the index of its first word (one more entry at the end).

    A word is a run of characters that are neither white space nor control characters, in lower case.
    """
    parts = [(OTHER_SPACE.sub(" ", x) if not x.isascii() else x).lower().encode("utf-8", "replace") for x in texts]
    ends = np.cumsum([len(p) + 1 for p in parts])
    raw = np.frombuffer(b" ".join([*parts, b""]), dtype=np.uint8)
    letter = raw > 32
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    starts = np.flatnonzero(first)
    bounds = np.concatenate(([0], np.searchsorted(starts, ends)))
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    at = np.flatnonzero(letter)
    opens = np.searchsorted(at, starts)
    lengths = np.diff(np.append(opens, len(at)))
    inside = np.arange(len(at)) - np.repeat(opens, lengths)
    terms = (raw[at].astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[inside]
    return mix(np.add.reduceat(terms, opens) + lengths.astype(np.uint64) * GOLDEN), bounds


def shingles(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of width words of each text, with bounds as above.

    A text of fewer words, one at least, has a single shingle of all of them; a text without words has none.
    """
    n = np.diff(bounds)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    out = np.concatenate(([0], np.cumsum(count)))
    doc = np.repeat(np.arange(len(n)), count)
    start = bounds[:-1][doc] + np.arange(out[-1]) - out[:-1][doc]
    padded = np.concatenate((words, np.zeros(width, np.uint64)))
    h = np.full(len(start), width, np.uint64)
    last = bounds[1:][doc]
    for k in range(width):
        at = start + k
        h = h * np.uint64(0xD6E8FEB86659FD93) + np.where(at < last, padded[at], GOLDEN)
    return mix(h), out

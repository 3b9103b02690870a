"""Token counts of flat token files without an index, by a separator scan.

A token file holds the ids of documents one after another, each followed by an end id, as little-endian
unsigned 16- or 32-bit numbers. Files are cut into blocks; in each block the end ids are found by one
vectorised comparison, and a prefix scan over the blocks' summaries gives the number and the length of
the documents that cross block borders.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from stancemill.llm.common import shared_path, small_batches, staged
from stancemill.llm.tokens import encoder
from stancemill.llm.warc import located

#: The default vocabulary's ids end at 50256, that of <|endoftext|>, which a text can hold.
END = 50257
BLOCK_TOKENS = 1 << 22


def end_of(tokenizer: str) -> tuple[int, int]:
    """An id that the tokenizer never emits, and the bytes that its ids and this one take."""
    end = max(Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values()) + 1
    return end, 2 if end < 1 << 16 else 4


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END, width: int = 2) -> DataFrame:
    """Writes a token file for each task; (doc_id, file, ordinal, bytes) says which document is where. bytes is the file's size so far.

    Only files named there count: those of failed or repeated tasks have other names. A text with an id that
    is end or does not fit is an error, so that all ids of a text count; a null text has no ids.
    """
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out, file, ordinal, size = encoder(tokenizer), None, "", 0, 0
        for batch in batches:
            if out is None and batch.num_rows:
                store, folder = located(path)
                store.create_dir(folder, recursive=True)
                file = f"{folder}/{uuid.uuid4().hex}.bin"
                out = store.open_output_stream(file)
            sizes = []
            for text in batch.column("text"):
                ids = np.asarray(encode(text.as_py() or ""), dtype=np.int64)
                if len(ids) and ((ids == end).any() or ids.max() >= 1 << 8 * width):
                    raise ValueError(f"a text has the end id {end} or an id of more than {width} bytes")
                raw = np.append(ids, end).astype(f"<u{width}").tobytes()
                out.write(raw)
                size += len(raw)
                sizes.append(size)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([file] * n, pa.string()), pa.array(range(ordinal, ordinal + n), pa.int64()), pa.array(sizes, pa.int64())], names=["doc_id", "file", "ordinal", "bytes"]
            )
            ordinal += n
        if out is not None:
            out.close()

    small_batches(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return staged(d.mapInArrow(work, "doc_id long, file string, ordinal long, bytes long"), "token-index")


def scan_blocks(files: DataFrame, path: str, end: int = END, width: int = 2, block: int = BLOCK_TOKENS) -> DataFrame:
    """For each block of files (file, bytes): block, ends (how many), head (tokens before the first end), tail (after the last; all, if none) and gaps (lengths between ends)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = located(path)
        for batch in batches:
            for r in batch.to_pylist():
                with store.open_input_file(r["file"]) as f:
                    f.seek(r["block"] * block * width)
                    ids = np.frombuffer(f.read(min(block * width, r["bytes"] - r["block"] * block * width)), f"<u{width}")
                at = np.flatnonzero(ids == end)
                head, tail = (int(at[0]), len(ids) - int(at[-1]) - 1) if len(at) else (0, len(ids))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["file"]]), pa.array([r["block"]], pa.int64()), pa.array([len(at)], pa.int64()), pa.array([head], pa.int64()), pa.array([tail], pa.int64()), pa.array([np.diff(at) - 1], pa.list_(pa.int64()))],
                    names=["file", "block", "ends", "head", "tail", "gaps"],
                )

    parts = files.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("bytes") / (block * width)) - 1))).filter("bytes > 0")
    return staged(parts.repartition("file", "block").mapInArrow(work, "file string, block long, ends long, head long, tail long, gaps array<long>"), "blocks")


def count_tokens(files: DataFrame, path: str, end: int = END, width: int = 2, block: int = BLOCK_TOKENS) -> DataFrame:
    """(file, ordinal, n_tokens, ended) of each document of the token files (file, bytes) under path.

    n_tokens leaves out the end id; an empty document has 0. Tokens after a file's last end are a document
    that has not ended. Files of no bytes hold no documents. A trailing part of a token is an error.
    """
    b = scan_blocks(files, path, end, width, block)
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # One small row for each block: the scan's window stays small even for a file of terabytes.
    s = b.select("file", "block", "ends", "tail").withColumn("tails", F.coalesce(F.sum("tail").over(before), F.lit(0)))
    s = s.withColumn("closed", F.coalesce(F.max(F.when(F.col("ends") > 0, F.col("tails"))).over(before), F.lit(0)))
    s = s.withColumns({"base": F.coalesce(F.sum("ends").over(before), F.lit(0)), "carry": F.col("tails") - F.col("closed"), "last": F.lead("block").over(order).isNull()})
    joined = b.join(s.select("file", "block", "base", "carry", "last"), ["file", "block"])
    done = joined.filter("ends > 0").select("file", "base", F.posexplode(F.concat(F.array(F.col("head") + F.col("carry")), "gaps")).alias("k", "n_tokens"))
    done = done.select("file", (F.col("base") + F.col("k")).alias("ordinal"), "n_tokens", F.lit(True).alias("ended"))
    left = F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("tail") + F.col("carry"))
    rest = joined.filter("last").select("file", (F.col("base") + F.col("ends")).alias("ordinal"), left.alias("n_tokens"), F.lit(False).alias("ended")).filter("n_tokens > 0")
    return done.unionByName(rest)


def document_tokens(docs: DataFrame, path: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """doc_id and n_tokens of each row of docs (doc_id, text, ...), counted in token files written from them.

    Every id of a text counts, those of special tokens' strings too. A null or empty text has 0 tokens; rows that repeat an id are counted one by one; no rows give no rows;
    other columns are ignored.
    """
    path = path or shared_path(docs.sparkSession, "tokens")
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    end, width = end_of(tokenizer)
    index = write_tokens(docs, path, tokenizer, end, width)
    files = index.groupBy("file").agg(F.max("bytes").alias("bytes"))
    return index.join(count_tokens(files, path, end, width), ["file", "ordinal"]).select("doc_id", "n_tokens")


def token_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes) of the files under path, for files that other programs wrote."""
    found = spark.read.format("binaryFile").load(path).select(F.regexp_replace("path", "^file:", "").alias("file"), F.col("length").alias("bytes"))
    return found

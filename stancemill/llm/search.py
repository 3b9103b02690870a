"""Ranked lexical search over an inverted index in shards, with a document-at-a-time merge in each shard.

Each task cuts its documents into shards of bounded size, orders a shard's documents by doc_id and writes for
each term the compressed list of its documents there; texts are not shuffled. A search reads the postings of
the queries' terms, merges them shard by shard with a heap of list heads in the order of doc_id, keeps the best
documents of a shard in a bounded heap, and ranks what the shards kept.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stancemill.llm.common import shared_path, staged
from stancemill.llm.wordscan import LOWER, byte_class, runs, scan

#: What separates terms.
SEPARATORS = byte_class((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: Bytes of text of a shard; a longer text is a shard of its own.
SHARD_BYTES = 16 << 20
#: Documents that one step of a merge takes: those whose number is less than this above the heap's first.
STEP = 4096
#: Terms of queries that one pass over the index serves. More queries are served in blocks.
BLOCK_TERMS = 1 << 20
POSTINGS = "shard long, term binary, docs long, words long, data binary"


def packed(values: np.ndarray) -> bytes:
    """Non-negative integers as variable-length bytes: seven bits each, the lowest first, the high bit set if more follow."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        size += v >= np.uint64(1) << np.uint64(7 * k)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(v) else 0, np.uint8)
    at = ends - size
    for k in range(int(size.max()) if len(v) else 0):
        some = size > k
        more = (size > k + 1)[some].astype(np.uint8) << 7
        out[at[some] + k] = ((v[some] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    """What packed() made, as int64."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(raw < 128)
    starts = np.concatenate(([0], last[:-1] + 1))
    inside = np.arange(len(raw)) - np.repeat(starts, last - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.uint64) << (7 * inside).astype(np.uint64), starts).astype(np.int64)


def _zigzag(v: np.ndarray) -> np.ndarray:
    return ((v << 1) ^ (v >> 63)).view(np.uint64)


def packed_documents(ids: np.ndarray, nulls: int, words: np.ndarray) -> bytes:
    """A shard's documents in order: ids ascending (null ones last, with any value), and their numbers of terms."""
    known = ids[: len(ids) - nulls]
    # Differences may pass 63 bits, so they wrap around and come back so.
    steps = np.diff(known, prepend=np.zeros(1, np.int64))
    return packed(np.concatenate((np.array([nulls, len(ids)], np.uint64), _zigzag(steps), words.astype(np.uint64))))


def unpacked_documents(data: bytes) -> tuple[np.ndarray, int, np.ndarray]:
    v = unpacked(data)
    nulls, n = int(v[0]), int(v[1])
    z = v[2 : 2 + n - nulls].view(np.uint64)
    known = np.cumsum((z >> np.uint64(1)).view(np.int64) ^ -(z & np.uint64(1)).astype(np.int64))
    return np.concatenate((known, np.zeros(nulls, np.int64))), nulls, v[2 + n - nulls :]


def _shard_rows(number: int, ids: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """The postings of one shard, and a row with a null term that has its documents: those with a term only."""
    order = np.lexsort((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)))
    found = scan(texts, SEPARATORS)
    if not len(found.words):
        return
    encoded = found.words.dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = np.bincount(found.rows, minlength=len(ids))
    kept = order[words[order] > 0]
    # Documents are numbered from 0 in the order of their ids.
    place = np.full(len(ids), -1, np.int64)
    place[kept] = np.arange(len(kept))
    pairs, times = np.unique(codes * len(kept) + place[found.rows], return_counts=True)
    term, doc = np.divmod(pairs, len(kept))
    heads = np.flatnonzero(np.diff(term, prepend=-1))
    sizes = np.diff(heads, append=len(term))
    steps = np.diff(doc, prepend=0)
    steps[heads] = doc[heads]
    # A list is its steps and counts in turn; all are packed at once and cut where a list ends.
    both = np.stack((steps, times), 1).ravel()
    data = packed(both)
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) < 128) + 1
    cuts = np.concatenate(([0], ends[2 * (heads + sizes) - 1]))
    lists = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(heads), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)])
    id_values = ids.take(pa.array(kept))
    documents = packed_documents(id_values.fill_null(0).to_numpy(zero_copy_only=False), id_values.null_count, words[kept])
    terms = encoded.dictionary.take(pa.array(term[heads]))
    by_name = pa.compute.sort_indices(terms)
    total = np.add.reduceat(times, heads)
    many = lambda x: pa.array(np.asarray(x, np.int64))
    yield pa.RecordBatch.from_arrays([many([number]), pa.nulls(1, pa.binary()), many([len(kept)]), many([len(codes)]), pa.array([documents])], names=["shard", "term", "docs", "words", "data"])
    yield pa.RecordBatch.from_arrays([many(np.full(len(heads), number)), terms.take(by_name).cast(pa.binary()), many(sizes).take(by_name), many(total).take(by_name), lists.take(by_name).cast(pa.binary())], names=["shard", "term", "docs", "words", "data"])


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the index of docs (doc_id, text, ...) to path and returns it: (shard, term, docs, words, data).

    Every row is a document of its own, whatever its id; those without a term are left out. A shard's row with a
    null term has its documents' ids and numbers of terms; the others have the documents of a term and how often
    it occurs in each. A shard has up to shard_bytes of text, or a single longer one.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def flushed() -> Iterator[pa.RecordBatch]:
            nonlocal number, held, size
            if held:
                yield from _shard_rows(number, pa.concat_arrays([h[0] for h in held]), pa.concat_arrays([h[1] for h in held]))
                number, held, size = number + 1, [], 0

        for b in batches:
            for start, texts in runs(b.column("raw"), shard_bytes):
                n = texts.nbytes
                if size + n > shard_bytes:
                    yield from flushed()
                held.append((b.column("doc_id").slice(start, len(texts)), texts))
                size += n
        yield from flushed()

    raw = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("raw"))
    raw.mapInArrow(work, POSTINGS).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(POSTINGS).parquet(path)


def query_terms(queries: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, item_id, terms) of each row of queries: a number of its own, and its different terms as binary."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split = [sorted(set(bytes(LOWER[np.frombuffer(t or b"", np.uint8)]).translate(SPACED).split())) for t in b.column("raw").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("item"), b.column("item_id"), pa.array(split, pa.list_(pa.binary()))], names=["item", "item_id", "terms"])

    q = queries.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").cast("binary").alias("raw"))
    return q.mapInArrow(work, "item long, item_id long, terms array<binary>")


#: For bytes.translate: separators become spaces.
SPACED = bytes(32 if SEPARATORS[b] else b for b in range(256))


def merged(lists: list[tuple[np.ndarray, np.ndarray]], k: int, step: int = STEP) -> list[tuple[int, int]]:
    """The k best (score, document) of posting lists (documents ascending, their scores), best first, the smaller document first on ties; scores of 0 don't count.

    A heap holds each list's next document. The lists whose next lies within step of the first are taken from it,
    add up their scores of those documents and go back with the next one after. A second heap holds the best.
    """
    heads = [(int(docs[0]), j) for j, (docs, _) in enumerate(lists) if len(docs)]
    heapq.heapify(heads)
    at, best = [0] * len(lists), []
    while heads:
        low = heads[0][0]
        high, sums = low + step, np.zeros(step, np.int64)
        while heads and heads[0][0] < high:
            j = heads[0][1]
            docs, scores = lists[j]
            a, b = at[j], int(np.searchsorted(docs, high))
            sums[docs[a:b] - low] += scores[a:b]
            at[j] = b
            if b < len(docs):
                heapq.heapreplace(heads, (int(docs[b]), j))
            else:
                heapq.heappop(heads)
        # Documents come in order, so a later one with an equal score never replaces one that is held.
        floor = best[0][0] if len(best) == k else 0
        found = np.flatnonzero(sums > floor)
        if len(found) > k:
            found = found[sums[found] >= np.partition(sums[found], len(found) - k)[len(found) - k]]
        for i in found.tolist():
            if len(best) < k:
                heapq.heappush(best, (int(sums[i]), -(low + i)))
            elif sums[i] > best[0][0]:
                heapq.heapreplace(best, (int(sums[i]), -(low + i)))
    return [(score, -doc) for score, doc in sorted(best, reverse=True)]


def list_scores(weight: int, times: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's part of the scores of documents: its occurrences there, damped by m, the document's length against the mean."""
    return weight * ((1_000_000_000 * times) // (1000 * times + 8 * m))


def length_factors(words: np.ndarray, documents: int, total: int) -> np.ndarray:
    """100 - 90 + 90 * n * N div L of documents of so many terms. The product may pass 64 bits, where Python's integers take over."""
    if int(words.max(initial=0)) * documents * 90 < 1 << 63:
        return 10 + (90 * words * documents) // total
    return np.array([10 + 90 * int(n) * documents // total for n in words], np.int64)


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def search(index: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of the index for each row of queries (item_id, text, ...), equal scores by ascending doc_id, null ids last.

    Each row of queries is a query of its own, also where ids repeat or are null; one without a term that occurs
    has no rows. Fewer than k documents with a score above 0 give fewer rows.
    """
    spark = index.sparkSession
    asked = staged(query_terms(queries), "queries")
    total = index.filter("term is null").agg(F.sum("docs"), F.sum("words")).first()
    terms = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-terms // BLOCK_TERMS)
    parts = [_searched(spark, index, asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i), total[0], total[1], k) for i in range(blocks if total[0] else 0)]
    if not parts:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    first = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", first).filter(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _searched(spark: SparkSession, index: DataFrame, asked: DataFrame, documents: int, total: int, k: int) -> DataFrame:
    """(item, item_id, doc_id, score): each shard's best for a block of queries, whose terms are about BLOCK_TERMS at most and go to all tasks."""
    block = asked.toArrow()
    items, item_ids, terms = block["item"].to_pylist(), block["item_id"].to_pylist(), block["terms"].to_pylist()
    names = sorted({t for some in terms for t in some})
    wanted = F.broadcast(spark.createDataFrame(pa.table({"term": pa.array(names, pa.binary())})))
    mine = index.join(wanted, "term", "left_semi").select("shard", "term", "docs", "words", "data")
    holding = {bytes(t): term_weight(documents, n) for t, n in mine.groupBy("term").agg(F.sum("docs").alias("n")).toArrow().to_pandas().itertuples(index=False)}
    sent = spark.sparkContext.broadcast((items, item_ids, terms, holding))

    def ranked(shard: pa.Table) -> pa.Table:
        items, item_ids, terms, weights = sent.value
        names = shard["term"].to_pylist()
        data = shard["data"]
        ids, nulls, words = unpacked_documents(data[names.index(None)].as_py())
        m = length_factors(words, documents, total)
        lists = {}
        for i, name in enumerate(names):
            if name is not None:
                both = unpacked(data[i].as_py())
                docs = np.cumsum(both[::2])
                lists[name] = (docs, list_scores(weights[name], both[1::2], m[docs]))
        out = []
        for item, item_id, some in zip(items, item_ids, terms):
            for score, doc in merged([lists[t] for t in some if t in lists], k):
                out.append((item, item_id, int(ids[doc]) if doc < len(ids) - nulls else None, score))
        columns = list(zip(*out)) or [[]] * 4
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("item", "item_id", "doc_id", "score"), columns)})

    both = mine.unionByName(index.filter("term is null").select("shard", "term", "docs", "words", "data"))
    return both.groupBy("shard").applyInArrow(ranked, "item long, item_id long, doc_id long, score long")


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 10, path: str | None = None) -> DataFrame:
    """search() over a new index of docs, stored at path (default: a new one in the shared folder)."""
    spark = docs.sparkSession
    return search(build_index(docs, path or shared_path(spark, "index")), queries, k)

"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of packets of PACKET tokens. In every round a queue's deficit counter grows by its
quantum, its share of a window of 1024 tokens, and the queue sends packets as long as its deficit covers
them; what is left is carried to the next round, window and partition. An empty queue drops out. As all
packets of a queue are equal (but for its last), the counter has a closed form, so every partition computes
the place of its own packets from the queues' totals alone.

With more than MAX_QUEUES sources, those with a wanted share and those with 1/LARGE of the tokens or more are
queues as before, and the others together are one queue, in whose stream they are dealt by the same rounds (in
groups of MAX_QUEUES, whose streams are dealt likewise).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stancemill.llm.common import small_batches, staged
from stancemill.llm.tokens import encoder

LENGTH = 1024
PACKET = 64
#: Quanta are whole numbers of 1/UNIT tokens.
UNIT = 1 << 14
#: Queues of a round-robin: a packet's place takes a step for each. More sources than this are nested.
MAX_QUEUES = 1024
LARGE = 256
END = 0
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


class Rounds:
    """The rounds of the queues with these totals and quanta (in 1/UNIT tokens)."""

    def __init__(self, totals: np.ndarray, quanta: np.ndarray, packet: int = PACKET):
        self.totals, self.quanta, self.packet = totals.astype(np.int64), quanta.astype(np.int64), packet

    def sent(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens that each queue (column) has sent after each number of rounds (row)."""
        return np.minimum(self.totals, rounds[:, None] * self.quanta // (self.packet * UNIT) * self.packet)

    def place(self, queue: np.ndarray, packet: np.ndarray) -> np.ndarray:
        """Tokens sent by all queues before the packets with these numbers of these queues."""
        at = -(-(packet + 1) * self.packet * UNIT // self.quanta[queue])
        out = np.empty(len(at), np.int64)
        step = max(1, (1 << 21) // max(1, len(self.totals)))
        for k in range(0, len(at), step):
            r, q = at[k : k + step], queue[k : k + step]
            before, after = self.sent(r - 1), self.sent(r)
            row = np.arange(len(r))
            earlier = np.cumsum(after - before, axis=1) - (after - before)
            out[k : k + step] = before.sum(axis=1) + earlier[row, q] + packet[k : k + step] * self.packet - before[row, q]
        return out


def quanta(totals: np.ndarray, shares: np.ndarray | None = None, length: int = LENGTH) -> np.ndarray:
    """Each queue's share of a window; by default the queues' shares of all tokens."""
    shares = totals if shares is None else shares
    return np.maximum(1, np.rint(length * UNIT * (shares / max(shares.sum(), 1e-300)))).astype(np.int64)


class Nested:
    """The rounds of all sources: those of the top queues, and below the last of them those of the small sources."""

    def __init__(self, totals: np.ndarray, named: np.ndarray, length: int = LENGTH, packet: int = PACKET):
        """named: the wanted share of each source, negative for those without."""
        share = totals / max(totals.sum(), 1)
        wanted = share
        if (named >= 0).any():
            rest = max(0.0, 1 - named[named >= 0].sum())
            wanted = np.where(named >= 0, named, rest * share / max(share[named < 0].sum(), 1e-300))
        top = (named >= 0) | (share * LARGE >= 1) if len(totals) > MAX_QUEUES else np.ones(len(totals), bool)
        self.packet, self.most, self.below = packet, MAX_QUEUES, []
        #: Each source's queue at the top, or its number among the small ones.
        self.small, self.number = ~top, np.where(top, np.cumsum(top), np.cumsum(~top)) - 1
        self.last, left = int(top.sum()), totals[~top]
        if len(left):
            while True:
                runs = [left[k : k + MAX_QUEUES] for k in range(0, len(left), MAX_QUEUES)]
                self.below.append([Rounds(x, quanta(x.astype(float), None, length), packet) for x in runs])
                left = np.array([x.sum() for x in runs])
                if len(left) == 1:
                    break
        self.top = Rounds(np.append(totals[top], left), quanta(np.append(wanted[top], [wanted[~top].sum()] * len(left)), None, length), packet)

    def _dealt(self, rounds: Rounds, queue: np.ndarray, begin: np.ndarray, size: np.ndarray):
        """(owner, tokens of it before, size, place) of the pieces, one in each packet, of stretches of queues."""
        p = self.packet
        lowest = begin // p
        count = (begin + size - 1) // p - lowest + 1
        owner = np.repeat(np.arange(len(size)), count)
        number = lowest[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        start = np.maximum(number * p, begin[owner])
        stop = np.minimum((number + 1) * p, (begin + size)[owner])
        return owner, start - begin[owner], stop - start, rounds.place(queue[owner], number) + start - number * p

    def pieces(self, source: np.ndarray, begin: np.ndarray, size: np.ndarray):
        """(owner, tokens of it before, size, place in the windows), by owner and tokens before, of stretches of sources' streams."""
        owner, inside, node, small = np.arange(len(size)), np.zeros(len(size), np.int64), self.number[source], self.small[source]
        for rounds in self.below:
            group, parts = np.where(small, node // self.most, -1), []
            for g in np.unique(group):
                at = np.flatnonzero(group == g)
                if g < 0:
                    parts.append((owner[at], inside[at], begin[at], size[at], node[at], small[at]))
                    continue
                k, before, n, place = self._dealt(rounds[g], node[at] % self.most, begin[at], size[at])
                parts.append((owner[at][k], inside[at][k] + before, place, n, np.full(len(k), g), np.ones(len(k), bool)))
            owner, inside, begin, size, node, small = map(np.concatenate, zip(*parts))
        k, before, size, place = self._dealt(self.top, np.where(small, self.last, node), begin, size)
        owner, inside = owner[k], inside[k] + before
        order = np.lexsort((inside, owner))
        return owner[order], inside[order], size[order], place[order]


def _tokenise(tokenizer: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, offsets = encoder(tokenizer), TaskContext.get().partitionId(), {}
        for batch in batches:
            n, at, ids = [], [], []
            queues = batch.column("queue").to_pylist()
            for queue, text in zip(queues, batch.column("text")):
                got = np.append(np.asarray(encode(text.as_py() or ""), dtype=np.uint32), np.uint32(END))
                at.append(offsets.get(queue, 0))
                offsets[queue] = at[-1] + len(got)
                n.append(len(got))
                ids.append(got.astype("<u2" if got.max() < 1 << 16 else "<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), pa.array(queues, pa.string()), pa.array(n, pa.int64()), pa.array(at, pa.int64()), pa.array([part] * len(n), pa.int32()), pa.array(ids, pa.binary())],
                names=["doc_id", "source", "queue", "n", "at", "part", "ids"],
            )

    return work


def _pieces(rounds: Nested, index: dict[str, int], length: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("n").to_numpy()
            begin = batch.column("at").to_numpy() + batch.column("base").to_numpy()
            doc, start, size, place = rounds.pieces(np.array([index[q] for q in batch.column("queue").to_pylist()]), begin, n)
            stop = start + size
            # Cut at the ends of windows, then join neighbours that stayed together.
            room = length - place % length
            over = np.flatnonzero(room < size)
            after = (doc[over], start[over] + room[over], stop[over], place[over] + room[over])
            stop[over] = start[over] + room[over]
            order = np.argsort(np.concatenate((np.arange(len(doc)), over + 0.5)), kind="stable")
            doc, start, stop, place = (np.concatenate((a, b))[order] for a, b in zip((doc, start, stop, place), after))
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + stop[:-1] - start[:-1]) | (place[1:] % length == 0)
            first = np.flatnonzero(new)
            doc, start, place, stop = doc[first], start[first], place[first], stop[np.append(first[1:], len(new)) - 1]
            inside, size = start, stop - start
            crcs, last = np.empty(len(doc), np.int64), -1
            for k, (d, a, b) in enumerate(zip(doc.tolist(), inside.tolist(), size.tolist())):
                if d != last:
                    raw, last = batch.column("ids")[d].as_buffer(), d
                    ids = memoryview(np.frombuffer(raw, "<u2" if len(raw) == 2 * n[d] else "<u4").astype("<u4")).cast("B")
                crcs[k] = zlib.crc32(ids[4 * a : 4 * (a + b)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc)), *map(pa.array, (inside, size, crcs, n[doc], place // length, place % length)), batch.column("source").take(pa.array(doc))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"],
            )

    return work


def pack(docs: DataFrame, tokenizer: str | None = None, shares: dict[str, float] | None = None, length: int = LENGTH, packet: int = PACKET) -> DataFrame:
    """The pieces of all documents of docs (doc_id, source, text, ...) in sequences of length tokens.

    A document is its text's ids (null text: none) and one end id 0. shares gives the wanted share of tokens
    of each source (default: its share of all tokens; sources not named get their own share of the rest, as
    by default; None as a key names null sources). Once a queue is empty the others go on at their quanta.
    Only the last sequence can be shorter. Returns a row for each piece: doc_id, start (ids of its document before it), length, ids_crc32,
    doc_tokens, sequence_id, offset in the sequence, and source. Null sources are a queue of their own;
    rows with equal ids are packed one by one; no documents give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    tokens = docs.withColumn("queue", name).select("doc_id", "source", "queue", "text")
    tokens = staged(tokens.mapInArrow(_tokenise(tokenizer), "doc_id long, source string, queue string, n long, at long, part int, ids binary"), "tokens")
    sums = tokens.groupBy("part", "queue").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("part", "queue", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    totals = {r["queue"]: r["n"] for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).orderBy("queue").toLocalIterator()}  # a row for each source
    named = np.array([(shares or {}).get(q[1:] if q else None, -1.0) for q in totals], dtype=float)
    rounds = Nested(np.array(list(totals.values()), dtype=np.int64), named, length, packet)
    return tokens.join(base, ["part", "queue"]).select("doc_id", "source", "queue", "n", "at", "base", "ids").mapInArrow(_pieces(rounds, {q: i for i, q in enumerate(totals)}, length), PIECES)

"""Subword tokens with their places in the text, by greedy longest matches over a trie of a vocabulary table."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space, and words: ASCII punctuation stands alone, all else in runs.
SPACE = r" \t\n\r\f\v"
WORD = r"[!-/:-@\[-`{-~]|[^ \t\n\r\f\v!-/:-@\[-`{-~]+"
#: Pieces within a word are marked so in the vocabulary.
INNER = "##"
UNKNOWN = -1
#: A vocabulary is sent to all tasks, so it may have so many pieces.
MOST_PIECES = 1 << 20


class TrieTokenizer:
    """Tokens of a vocabulary {piece: id}. A word of which some stretch has no piece is one token, UNKNOWN."""

    def __init__(self, pieces: dict[str, int]):
        self.first, self.inner = {}, {}
        for piece, number in pieces.items():
            node, rest = (self.inner, piece[len(INNER) :]) if piece.startswith(INNER) and len(piece) > len(INNER) else (self.first, piece)
            for ch in rest:
                node = node.setdefault(ch, {})
            node[""] = number
        self._pieces = functools.lru_cache(1 << 16)(self.word)

    def __getstate__(self):
        return self.first, self.inner

    def __setstate__(self, state):
        self.first, self.inner = state
        self._pieces = functools.lru_cache(1 << 16)(self.word)

    def word(self, word: str) -> tuple[tuple[int, int, int], ...]:
        """(id, start, end) of a word's tokens: at each place the longest piece that fits."""
        out, at = [], 0
        while at < len(word):
            node, best = self.inner if at else self.first, None
            for k in range(at, len(word)):
                node = node.get(word[k])
                if node is None:
                    break
                if "" in node:
                    best = (node[""], at, k + 1)
            if best is None:
                return ((UNKNOWN, 0, len(word)),)
            out.append(best)
            at = best[2]
        return tuple(out)

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(id, start, end) of a text's tokens, by characters."""
        return [(i, m.start() + a, m.start() + b) for m in re.finditer(WORD, text) for i, a, b in self._pieces(m[0])]

    def encode(self, text: str) -> list[int]:
        return [i for i, _, _ in self.spans(text)]

    def windows(self, text: str, size: int, step: int) -> list[tuple[int, int, int, int]]:
        """(first token, tokens, start, end) of windows of size tokens every step, as stretches of the text's characters.

        An incomplete last one is left out, but a text of fewer tokens is one window, the whole text.
        """
        spans = self.spans(text)
        if len(spans) <= size:
            return [(0, len(spans), 0, len(text))]
        return [(k, size, spans[k][1], spans[k + size - 1][2]) for k in range(0, len(spans) - size + 1, step)]


def tokenizer_of(vocabulary: DataFrame, most: int = MOST_PIECES) -> TrieTokenizer:
    """The tokenizer of a table (piece, id) of up to most rows; of several ids of a piece the smallest."""
    rows = vocabulary.groupBy("piece").agg(F.min("id").alias("id")).filter("piece <> ''").limit(most + 1).toArrow()
    if rows.num_rows > most:
        raise ValueError(f"the vocabulary has more than {most} pieces")
    return TrieTokenizer(dict(zip(rows["piece"].to_pylist(), rows["id"].to_pylist())))


def subword_windows(docs: DataFrame, tokenizer: TrieTokenizer, size: int = 508, step: int = 256, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """(id, first, tokens, start, end) of every window of each document, and with texts its text. A null text has no window."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(tokenizer)
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(b: pa.RecordBatch) -> Iterable[tuple]:
        for k, text in enumerate(b.column("_text").to_pylist()):
            if text is not None:
                for first, n, start, end in sent.value.windows(text, size, step):
                    yield k, first, n, start, end, text[start:end] if texts else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, *columns = zip(*rows(b)) if b.num_rows and b.column("_text").null_count < b.num_rows else [[]] * 6
            made = [b.column("_id").take(pa.array(k, pa.int64())), *(pa.array(c, pa.int64()) for c in columns[:4])]
            names = ["_id", "first", "tokens", "start", "end"]
            yield pa.RecordBatch.from_arrays(made + ([pa.array(columns[4], pa.string())] if texts else []), names=names + (["window"] if texts else []))

    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(work, f"_id {kind}, first long, tokens long, start long, end long" + (", window string" if texts else ""))
    return out.withColumnRenamed("_id", id_col)

"""Operators over models that the caller brings: tokenizer, encoder, labeller and language model.

A model is any picklable object with the method named below; it is sent to each task once and called on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stancemill.functions import text as T
from stancemill.operators import runtime
from stancemill.operators.features import Feature
from stancemill.operators.relational import add_if_absent


class Tokenizer(Protocol):
    def encode(self, text: str) -> Sequence: ...
    def decode(self, tokens: Sequence) -> str: ...


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray:
        """A row for each text."""


class Labeller(Protocol):
    def logprobs(self, prompt: str, labels: list[str]) -> list[float]:
        """Log-probabilities of the labels as the first token after the prompt, among all tokens."""


class LanguageModel(Protocol):
    def loss(self, text: str) -> float:
        """Mean negative log-likelihood of the text's tokens."""


class Lemmatizer(Protocol):
    def lemma(self, token: str) -> str: ...


SENTIMENT_PROMPT = "Say whether this text is Positive or Negative.\nText: {text}"


def starts(tokens: int, size: int, step: int) -> range:
    """First tokens of the windows; an incomplete last one is left out, but a text shorter than size is one window."""
    return range(0, max(1, tokens - size + 1), step)


def window_texts(text: str, tokenizer: Tokenizer, size: int, step: int) -> list[str]:
    """The texts of the windows: stretches of the text itself where the tokenizer knows its tokens' places, else tokens decoded again."""
    if hasattr(tokenizer, "windows"):
        return [text[a:b] for _, _, a, b in tokenizer.windows(text, size, step)]
    tokens = tokenizer.encode(text)
    return [tokenizer.decode(tokens[k : k + size]) for k in starts(len(tokens), size, step)]


def best_window(text: Column, query_vector: Column, tokenizer: Tokenizer, encoder: Encoder | runtime.Loaded, length: int = 512, step: int = 256, padding: int = 4, budget: int = 1 << 14) -> Column:
    """Struct (window, score): of the text's windows of length - padding tokens every step, the one whose encoding has the largest dot product with the query's vector, the first on ties. Nulls without a text or vector."""

    @F.arrow_udf("struct<window:string,score:double>")
    def work(sides: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        model, split = runtime.model_of(encoder), runtime.model_of(tokenizer)
        for texts, vectors in sides:
            out = []
            for t, v in zip(texts.to_pylist(), vectors.to_pylist()):
                if t is None or v is None:
                    out.append({"window": None, "score": None})
                    continue
                found = window_texts(t, split, length - padding, step)
                scores = np.array(runtime.encoded(model, found, budget)) @ np.array(v, float)
                at = int(np.argmax(scores))
                out.append({"window": found[at], "score": float(scores[at])})
            yield pa.array(out, pa.struct([("window", pa.string()), ("score", pa.float64())]))

    return work(text, query_vector)


def best_windows(pages: DataFrame, tokenizer: Tokenizer, encoder: Encoder | runtime.Loaded, **sizes: int) -> DataFrame:
    """pages (text, search_query, ...) with text_thresh_window and text_thresh_window_score; other columns stay as they are. Each different query is encoded once."""
    b = F.col("_best")
    made = runtime.with_query_vectors(pages, encoder)
    made = made.withColumn("_best", best_window(F.col("text"), F.col("query_vector"), tokenizer, encoder, **sizes)).drop("query_vector")
    return made.withColumns({"text_thresh_window": b["window"], "text_thresh_window_score": b["score"]}).drop("_best")


def similarity(encoder: Encoder | runtime.Loaded, budget: int = 1 << 14) -> Feature:
    """The feature of the dot product of the encodings of text and query. Tables with few queries have them encoded once by runtime.with_query_vectors in its place."""

    def feature(text: Column, query: Column, url: Column) -> Column:
        return F.when(text.isNotNull() & query.isNotNull(), T.dot(runtime.encode(text, encoder, budget), runtime.encode(query, encoder, budget)))

    return feature


def sentiment(labeller: Labeller, prompt: str = SENTIMENT_PROMPT, labels: Sequence[str] = ("Positive", "Negative")) -> Feature:
    """The feature of a map from each label to its log-probability; null without a text."""

    def feature(text: Column, query: Column, url: Column) -> Column:
        @F.pandas_udf("array<double>")
        def work(texts: pd.Series) -> pd.Series:
            return pd.Series([None if t is None else list(map(float, labeller.logprobs(prompt.format(text=t), list(labels)))) for t in texts], dtype=object)

        # A model that samples may answer otherwise when it is asked again.
        scores = work.asNondeterministic()(text)
        return F.when(text.isNotNull(), F.map_from_arrays(F.array(*map(F.lit, labels)), scores))

    return feature


def perplexity(model: LanguageModel) -> Feature:
    """The feature of exp of the model's mean loss; null without a text."""

    def feature(text: Column, query: Column, url: Column) -> Column:
        @F.pandas_udf("double")
        def work(texts: pd.Series) -> pd.Series:
            return pd.Series([None if t is None else float(np.exp(model.loss(t))) for t in texts], dtype=object)

        return work(text)

    return feature


def unique_lemmas(lemmatizer: Lemmatizer) -> Feature:
    """The feature of the number of different lemmas of the text's tokens, each different token looked up once a batch; null without a text."""

    def feature(text: Column, query: Column, url: Column) -> Column:
        @F.pandas_udf("long")
        def work(tokens: pd.Series) -> pd.Series:
            known: dict[str, str] = {}
            lemma = lambda t: known[t] if t in known else known.setdefault(t, lemmatizer.lemma(t))
            return pd.Series([None if some is None else len({lemma(t) for t in some}) for some in tokens], dtype=object)

        return work(F.array_distinct(T.space_tokens(text)))

    return feature


def trim_rescored(pages: DataFrame, encoder: Encoder | runtime.Loaded, column: str = "text_thresh_window", budget: int = 1 << 14, ordered: bool = False) -> DataFrame:
    """pages with text_thresh_window_sent, without cut-off sentences, and score_sent, its encoding's dot product with the query's; rows without query go.

    Each different query is encoded once. ordered: rows come query by query, in the order of queries, and within one by answer_id where there is one.
    """
    text = T.trim_sentences(T.sentences(F.col(column)))["text"]
    out = add_if_absent(pages, "text_thresh_window_sent", text).filter("search_query is not null")
    out = runtime.with_query_vectors(out, encoder, budget=budget)
    out = out.withColumn("score_sent", T.dot(runtime.encode(F.col("text_thresh_window_sent"), encoder, budget), F.col("query_vector"))).drop("query_vector")
    return out.orderBy(*(c for c in ("search_query", "answer_id") if c in out.columns)) if ordered else out


class SpaceTokenizer:
    """Tokens are what lies between single spaces."""

    def encode(self, text: str) -> list[str]:
        return text.split(" ")

    def decode(self, tokens: Sequence[str]) -> str:
        return " ".join(tokens)


class CountEncoder:
    """A deterministic encoder: how often each of some characters occurs."""

    def __init__(self, characters: str = "ae "):
        self.characters = characters

    def encode(self, texts: list[str]) -> np.ndarray:
        return np.array([[t.count(c) for c in self.characters] for t in texts], float)

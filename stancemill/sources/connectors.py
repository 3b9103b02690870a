"""Connectors to the world outside: page fetchers, a search service and answering models, each with an offline form."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stancemill.functions import text as T
from stancemill.sources import io, search_source


class Fetcher(Protocol):
    """Opened once for each partition; fetch gives a page's text, or None for any failure."""

    def __enter__(self) -> Fetcher: ...
    def __exit__(self, *error) -> None: ...
    def fetch(self, url: str) -> str | None: ...


class HttpFetcher:
    """Plain HTTP GET; a status of 300 or more, a timeout or an error gives None."""

    def __init__(self, headers: dict[str, str] | None = None, timeout: float = 10):
        self.headers, self.timeout = headers or {"User-Agent": "Mozilla/5.0", "Accept": "text/html,*/*;q=0.8"}, timeout

    def __enter__(self):
        return self

    def __exit__(self, *error):
        pass

    def fetch(self, url: str) -> str | None:
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=self.headers), timeout=self.timeout) as got:
                return got.read().decode(got.headers.get_content_charset() or "utf-8", "replace") if got.status < 300 else None
        except (OSError, ValueError, urllib.error.URLError):
            return None


class BrowserFetcher(HttpFetcher):
    """A page as a browser shows it; make_driver gives an object with get(url), page_source and quit(), such as a web driver."""

    def __init__(self, make_driver: Callable, timeout: float = 20):
        super().__init__(timeout=timeout)
        self.make_driver = make_driver

    def __enter__(self):
        self.driver = self.make_driver()
        return self

    def __exit__(self, *error):
        self.driver.quit()

    def fetch(self, url: str) -> str | None:
        try:
            self.driver.get(url)
            return self.driver.page_source
        except Exception:  # noqa: BLE001 - whatever a driver raises, the page is missing
            return None


def wanted(pages: DataFrame) -> DataFrame:
    """Rows worth fetching: with a url that is not a PDF's. The filter comes before the fetch, which is no deterministic function."""
    return pages.filter(F.col("url").isNotNull() & ~F.col("url").endswith(".pdf"))


def fetch_pages(pages: DataFrame, fetcher: Fetcher) -> DataFrame:
    """(doc_id, html) of the wanted rows of pages (doc_id, url)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with fetcher as f:
            for b in batches:
                yield pd.DataFrame({"doc_id": b["doc_id"], "html": [f.fetch(u) for u in b["url"]]})

    return wanted(pages).select("doc_id", "url").mapInPandas(work, "doc_id long, html string")


def fetch_offline(pages: DataFrame, stored: DataFrame) -> DataFrame:
    """pages (url, ...) with html from stored (url, html), of several for a url the smallest; PDFs and urls not stored have a null one."""
    s = stored.filter("not endswith(url, '.pdf')").groupBy(F.col("url").alias("_url")).agg(F.min("html").alias("html"))
    return pages.join(s, F.col("url") == F.col("_url"), "left").drop("_url")


def page_path(folder: Column, doc_id: Column) -> Column:
    """Where the page of an id lies in a folder of page files."""
    return F.concat_ws("/", folder, F.concat(doc_id.cast("string"), F.lit(".html")))


def fetch_resumed(pages: DataFrame, path: str, fetcher: Fetcher | None) -> DataFrame:
    """pages (doc_id, url, ...) with html from the table (doc_id, html) at path, to which those it lacks are fetched first.

    A stored page is used whatever its url, a PDF's too. Pages that failed are not stored and so are tried again by the
    next run; they have a null html. Without a fetcher only stored pages are used. doc_id is unique.
    """
    spark = pages.sparkSession
    if fetcher is not None:
        io.resumed_at(spark, path, pages.select("doc_id", "url"), "doc_id", lambda lacking: fetch_pages(lacking, fetcher).filter("html is not null"))
    stored = spark.read.parquet(path).select(F.col("doc_id").alias("_id"), "html")
    return pages.join(stored, F.col("doc_id") == F.col("_id"), "left").drop("_id")


def search_requests(inputs: DataFrame, num_results: int = 20) -> DataFrame:
    """A row for each request: inputs (search_query, search_engine_input) and start."""
    return inputs.withColumn("start", F.explode(T.page_starts(F.lit(num_results))))


HIT = "search_query string, search_engine_input string, url string, title string, snippet string, request_dump string"


def search(inputs: DataFrame, endpoint: str, key: str, num_results: int = 20, rate: float = 100 / 60, tries: int = 3, delay: float = 120, tasks: int | None = None, timeout: float = 30) -> DataFrame:
    """Hits of a JSON search service; a status that isn't 200, a timeout or broken JSON is tried again and then fails the task; no items are no hits.

    The requests are dealt to so many tasks (default: as many as run at once), each of which lets its share of rate requests
    a second through. format("search") does the same from a table of inputs, in partitions of its own.
    """
    tasks = tasks or inputs.sparkSession.sparkContext.defaultParallelism

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask, bucket = search_source.Service(endpoint, key, timeout).ask, search_source.TokenBucket(rate / tasks)
        for b in batches:
            rows = []
            for r in b.itertuples():
                for hit in search_source.asked(ask, r.search_engine_input, r.start, bucket, tries, delay):
                    rows.append((r.search_query, r.search_engine_input, hit.get("link"), hit.get("title"), hit.get("snippet"), json.dumps(hit)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in HIT.split(", ")])

    return search_requests(inputs, num_results).repartition(tasks).mapInPandas(work, HIT)


def parse_hits(responses: DataFrame, column: str = "response") -> DataFrame:
    """A row for each item of JSON responses; missing fields are null, missing items no rows. request_dump is the whole item."""
    items = F.coalesce(F.from_json(F.get_json_object(column, "$.items"), "array<string>"), F.array().cast("array<string>"))
    field = lambda name: F.get_json_object("_hit", f"$.{name}")
    return responses.withColumn("_hit", F.explode(items)).select(
        *(c for c in responses.columns if c != column), field("link").alias("url"), field("title").alias("title"), field("snippet").alias("snippet"), F.col("_hit").alias("request_dump")
    )


class Completer(Protocol):
    def complete(self, prompt: str) -> str: ...


STATEMENT_PROMPT = "Question: %s\nTurn this yes-or-no question into statements, several that affirm it and several that deny it.\nOne a line, as 'Yes 1: ...' or 'No 1: ...'."
QUESTION_PROMPT = "Write yes-or-no questions about %s on which reasonable sources disagree, one a line."


def answer(prompt: Column, completer: Completer, tries: int = 3, delay: float = 30) -> Column:
    """The completer's answer to each prompt; null for a null prompt and where it fails tries times."""

    def one(value: str | None) -> str | None:
        for k in range(tries if value is not None else 0):
            try:
                return completer.complete(value)
            except Exception:  # noqa: BLE001 - a failed answer is null
                if k < tries - 1:
                    time.sleep(delay)
        return None

    @F.pandas_udf("string")
    def work(prompts: pd.Series) -> pd.Series:
        return pd.Series([one(p) for p in prompts], dtype=object)

    # Asked again, a model may answer otherwise, so no filter on the answer moves below it.
    return work.asNondeterministic()(prompt).alias("answer")


def completed(df: DataFrame, prompt: str, column: str, completer: Completer, output: str = "model_answer", tries: int = 3, delay: float = 30) -> DataFrame:
    """df with the completer's answers to the prompt, in which %s stands for a column's value; other percent signs stay."""
    return df.withColumn(output, answer(F.replace(F.lit(prompt), F.lit("%s"), F.col(column)), completer, tries, delay))


def answered_offline(df: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """df joined with a table of answers (key, model_answer); without one, null."""
    return df.join(answers.select(key, "model_answer"), key, "left")

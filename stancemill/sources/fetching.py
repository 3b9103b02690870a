"""Fetching pages host by host: parallel within bounds, with a delay between requests to a host, and resumable range by range."""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stancemill.functions import text as T
from stancemill.operators.relational import drop_ids
from stancemill.sources import ranges
from stancemill.sources.connectors import Fetcher, wanted

PAGE = "doc_id long, html string, cut boolean"
PAGE_ARROW = pa.schema([("doc_id", pa.int64()), ("html", pa.string()), ("cut", pa.bool_())])


@dataclass(frozen=True)
class Manners:
    """How a task fetches: so many hosts at once, so many seconds between the starts of two requests to a host, and the bytes after which a page is cut (None: never)."""

    hosts_at_once: int = 8
    delay: float = 1.0
    most_bytes: int | None = None


def cut_at(html: str | None, most: int | None) -> tuple[str | None, bool | None]:
    """The page with at most so many UTF-8 bytes, of whole characters, and whether anything is missing; nulls for a null."""
    if html is None:
        return None, None
    if most is None or len(html) * 4 <= most:
        return html, False
    raw = html.encode("utf-8", "replace")
    return (html, False) if len(raw) <= most else (raw[:most].decode("utf-8", "ignore"), True)


def fetch_hosts(urls: list[str], hosts: list[str | None], pauses: list[float], fetcher: Fetcher, manners: Manners) -> list[tuple[str | None, bool | None]]:
    """(html, cut) of each url, in the given order; a failed one has nulls.

    Each host's urls are fetched one after another, with the host's pause between them; hosts_at_once hosts are fetched at once.
    """
    out: list[tuple[str | None, bool | None]] = [(None, None)] * len(urls)
    queues: dict[str | None, list[int]] = {}
    for k, h in enumerate(hosts):
        queues.setdefault(h, []).append(k)

    def one_host(mine: list[int]) -> None:
        due = 0.0
        for k in mine:
            time.sleep(max(0.0, due - time.monotonic()))
            due = time.monotonic() + pauses[k]
            try:
                out[k] = cut_at(fetcher.fetch(urls[k]), manners.most_bytes)
            except Exception:  # noqa: BLE001 - a page that can't be had is null
                out[k] = (None, None)

    with ThreadPoolExecutor(max(1, manners.hosts_at_once)) as pool:
        for done in pool.map(one_host, sorted(queues.values(), key=len, reverse=True)):
            assert done is None
    return out


def by_host(pages: DataFrame, rows: int) -> DataFrame:
    """pages (url, ...) with host, splits and range: ranges of about so many rows that hold whole hosts.

    A host with more rows is split into that many ranges; splits tells in how many, as each has to wait so much longer.
    """
    p = pages.withColumn("host", T.host(F.col("url")))
    # At most as many hosts are heavy as there are ranges.
    heavy = p.groupBy("host").agg(F.count("*").alias("_n")).filter(F.col("_n") > rows).select(F.col("host").alias("_host"), F.ceil(F.col("_n") / rows).cast("int").alias("_splits"))
    p = p.join(heavy, F.col("host").eqNullSafe(F.col("_host")), "left").withColumn("splits", F.coalesce("_splits", F.lit(1))).drop("_host", "_splits")
    n = max(1, -(-pages.count() // rows))
    return p.withColumn("range", F.pmod(F.xxhash64("host", F.pmod(F.xxhash64("url"), F.col("splits"))), F.lit(n)).cast("long"))


def _fetched(rows: pa.Table, fetcher: Fetcher, manners: Manners) -> pa.Table:
    pauses = [manners.delay * s for s in rows["splits"].to_pylist()]
    with fetcher as f:
        got = fetch_hosts(rows["url"].to_pylist(), rows["host"].to_pylist(), pauses, f, manners)
    return pa.Table.from_arrays([rows["doc_id"].combine_chunks(), pa.array([h for h, _ in got], pa.string()), pa.array([c for _, c in got], pa.bool_())], schema=PAGE_ARROW)


def fetch_polite(pages: DataFrame, fetcher: Fetcher, manners: Manners = Manners(), rows: int = 1000) -> DataFrame:
    """(doc_id, html, cut) of the wanted rows of pages (doc_id, url); null html and cut where a fetch failed."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            yield from _fetched(pa.Table.from_batches([b]), fetcher, manners).to_batches()

    planned = by_host(wanted(pages).select(F.col("doc_id").cast("long").alias("doc_id"), "url"), rows)
    return planned.repartition("range").select("doc_id", "url", "host", "splits").mapInArrow(task, PAGE)


def fetch_committed(pages: DataFrame, path: str, fetcher: Fetcher, manners: Manners = Manners(), rows: int = 1000, strict: bool = True) -> DataFrame:
    """pages (doc_id, url, ...) with html and cut from the ranges committed at path, to which those of the pages they lack are fetched first.

    A run that fails keeps every range that it finished; the next one fetches the others. Pages that could not be had
    are not stored and so are tried again. doc_id is unique; PDFs and null urls have a null html.
    """
    spark = pages.sparkSession
    lacking = drop_ids(wanted(pages).select(F.col("doc_id").cast("long").alias("doc_id"), "url"), ranges.committed(spark, path, PAGE), "doc_id", "doc_id")
    ranges.run_ranges(by_host(lacking, rows), path, lambda some: (got := _fetched(some, fetcher, manners)).filter(got["html"].is_valid()), strict)
    stored = ranges.committed(spark, path, PAGE).withColumnRenamed("doc_id", "_id")
    return pages.join(stored, F.col("doc_id") == F.col("_id"), "left").drop("_id")

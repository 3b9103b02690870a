"""A search service as a Spark data source: format("search").

A partition is a stretch of the inputs and a range of result pages, and has its share of the request rate. Options:
inputs (path of a Parquet table with search_query and search_engine_input), num_results, endpoint and key of the
service, or responses (path of a stored table with search_engine_input, start, status and response, best sorted by input, as
each partition reads the row groups that may hold its own inputs) in its place;
rate (requests a second of all tasks together), at_once (tasks that run at once), inputs_each and pages_each (inputs
and result pages of a partition), tries and delay.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from stancemill.sources.ranges import located

SCHEMA = "search_query string, search_engine_input string, start int, position int, url string, title string, snippet string, request_dump string"
ARROW = pa.schema([(c.split()[0], pa.int32() if c.endswith(" int") else pa.string()) for c in SCHEMA.split(", ")])
PAGE_SIZE, MOST_RESULTS = 10, 100
COLUMNS = ["search_query", "search_engine_input"]
#: Rows read at once.
AT_ONCE = 1024
#: Tables are read in pieces, none ahead of its use, so that a task's memory does not grow with them.
PIECEWISE = ds.ParquetFileFormat(default_fragment_scan_options=ds.ParquetFragmentScanOptions(use_buffered_stream=True, pre_buffer=False))


class Refused(Exception):
    """An answer that is worth asking for again."""


class TokenBucket:
    """Lets through rate requests a second, and burst at once after a rest."""

    def __init__(self, rate: float, burst: int = 1, clock=time.monotonic, sleep=time.sleep):
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.tokens, self.at = float(burst), clock()

    def take(self) -> None:
        while True:
            now = self.clock()
            self.tokens, self.at = min(self.burst, self.tokens + (now - self.at) * self.rate), now
            if self.tokens >= 1 - 1e-9:
                self.tokens -= 1
                return
            self.sleep((1 - self.tokens) / self.rate)


class Service:
    """The service behind an endpoint: ask gives status and body."""

    def __init__(self, endpoint: str, key: str, timeout: float = 30):
        self.endpoint, self.key, self.timeout = endpoint, key, timeout

    def ask(self, query: str, start: int) -> tuple[int, str]:
        url = f"{self.endpoint}?{urllib.parse.urlencode({'key': self.key, 'q': query, 'num': PAGE_SIZE, 'start': start})}"
        try:
            with urllib.request.urlopen(url, timeout=self.timeout) as got:
                return got.status, got.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as error:
            return error.code, ""


def hits(body: str) -> list[dict]:
    """The items of a response; none if it has no such list. Broken JSON is refused."""
    try:
        got = json.loads(body)
    except ValueError as error:
        raise Refused(f"broken JSON: {error}") from error
    items = got.get("items") if isinstance(got, dict) else None
    return [x for x in items if isinstance(x, dict)] if isinstance(items, list) else []


def asked(ask, query: str, start: int, bucket: TokenBucket | None, tries: int, delay: float) -> list[dict]:
    """The items of one page of results. A status other than 200, a timeout or broken JSON is tried again after the delay; each try takes a token."""
    for k in range(tries):
        if bucket is not None:
            bucket.take()
        try:
            status, body = ask(query, start)
            if status != 200:
                raise Refused(f"status {status}")
            return hits(body)
        except (Refused, OSError) as error:
            if k == tries - 1:
                raise RuntimeError(f"search for {query!r} from {start}: {error}") from error
            time.sleep(delay)
    return []


def page_starts(num_results: int) -> list[int]:
    """The first result of each page of a search for so many, clamped to 1 to MOST_RESULTS; the last number itself is left out."""
    return list(range(1, max(1, min(MOST_RESULTS, num_results)), PAGE_SIZE))


@dataclass
class Stretch(InputPartition):
    """Rows [first, last) of a file of inputs, and starts of pages."""

    file: str
    first: int
    last: int | None
    starts: list[int]


def rows_between(store, file: str, first: int, last: int) -> pa.Table:
    """Rows [first, last) of a file of inputs; row groups without any of them are not read."""
    out, at = [], 0
    with pq.ParquetFile(file, filesystem=store, buffer_size=1 << 20) as f:
        for g in range(f.num_row_groups):
            n = f.metadata.row_group(g).num_rows
            if at < last and at + n > first:
                here = at
                for b in f.iter_batches(AT_ONCE, row_groups=[g], columns=COLUMNS, use_threads=False):
                    low, high = max(first - here, 0), min(last - here, b.num_rows)
                    if low < high:
                        out.append(b.slice(low, high - low).select(COLUMNS))
                    here += b.num_rows
                    if here >= last:
                        break
            at += n
    return pa.Table.from_batches(out)


class SearchReader(DataSourceReader):
    def __init__(self, options: dict):
        get = {k.lower(): v for k, v in options.items()}
        self.inputs, self.responses = get["inputs"], get.get("responses")
        self.endpoint, self.key, self.timeout = get.get("endpoint"), get.get("key", ""), float(get.get("timeout", 30))
        self.rate, self.at_once = float(get.get("rate", 100 / 60)), int(get.get("at_once", 1))
        self.num_results, self.pages_each = int(get.get("num_results", 20)), int(get.get("pages_each", MOST_RESULTS))
        self.inputs_each = int(get.get("inputs_each", 1000))
        self.tries, self.delay = int(get.get("tries", 3)), float(get.get("delay", 120))
        if not self.responses and not self.endpoint:
            raise ValueError("format search needs an endpoint or stored responses")

    def partitions(self) -> list[InputPartition]:
        """Stretches of each file's rows, of which only the footers are read here, times ranges of pages."""
        starts = page_starts(self.num_results)
        pages = [starts[k : k + self.pages_each] for k in range(0, len(starts), self.pages_each)]
        store, path = located(self.inputs)
        out = []
        for fragment in ds.dataset(path, filesystem=store, format="parquet").get_fragments():
            n = fragment.count_rows()
            out += [Stretch(fragment.path, k, min(n, k + self.inputs_each), some) for k in range(0, n, self.inputs_each) for some in pages]
        return out

    def read(self, part: Stretch | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no inputs
            return
        store, _ = located(self.inputs)
        rows = rows_between(store, part.file, part.first, part.last)
        # Tasks that run at once share the rate; stored responses need none.
        bucket = None if self.responses else TokenBucket(self.rate / self.at_once)
        ask = self.stored(rows["search_engine_input"], part.starts) if self.responses else Service(self.endpoint, self.key, self.timeout).ask
        for query, asks in zip(rows["search_query"].to_pylist(), rows["search_engine_input"].to_pylist()):
            found = []
            for start in part.starts if asks is not None else []:
                for k, hit in enumerate(asked(ask, asks, start, bucket, self.tries, 0 if self.responses else self.delay)):
                    found.append([query, asks, start, start + k, *(None if hit.get(n) is None else str(hit[n]) for n in ("link", "title", "snippet")), json.dumps(hit)])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), ARROW)], schema=ARROW)

    def stored(self, inputs: pa.ChunkedArray, starts: list[int]):
        """ask() over the stored responses of these inputs, of several for a page the smallest; a page that is not stored has no items."""
        store, path = located(self.responses)
        wanted = inputs.drop_null().unique()
        known: dict[tuple[str, int], tuple[int, str]] = {}
        if len(wanted):
            ends, name = pc.min_max(wanted), pc.field("search_engine_input")
            # The range spares row groups of tables that are sorted by input.
            mine = (name >= ends["min"]) & (name <= ends["max"]) & name.isin(wanted) & pc.field("start").isin(starts)
            stored = ds.dataset(path, filesystem=store, format=PIECEWISE)
            for b in stored.to_batches(columns=["search_engine_input", "start", "status", "response"], filter=mine, batch_size=AT_ONCE, batch_readahead=0, fragment_readahead=0, use_threads=False):
                for r in b.to_pylist():
                    at, got = (r["search_engine_input"], r["start"]), (r["status"], r["response"] or "")
                    known[at] = min(known.get(at, got), got)
        return lambda query, start: known.get((query, start), (200, "{}"))


class SearchDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "search"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return SearchReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SearchDataSource)

"""Committed ranges, polite fetching and the search data source, against local servers and failures."""

import glob
import hashlib
import json
import os
import sys
import threading
import time
from collections import Counter, defaultdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pyarrow as pa
import pyarrow.compute
import pyarrow.parquet as pq
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from stancemill.sources import connectors, fetching, ranges, search_source


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks can't import tests


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


class Logged:
    """A fetcher that logs urls in a folder; those with "fail" give nothing."""

    def __init__(self, folder):
        self.folder = str(folder)

    def __enter__(self):
        return self

    def __exit__(self, *error):
        pass

    def fetch(self, url):
        with open(f"{self.folder}/{time.time_ns()}-{os.getpid()}-{threading.get_ident()}", "w") as f:
            f.write(url)
        return None if "fail" in url else f"<p>{url}"


def fetched(folder):
    return Counter(open(f).read() for f in glob.glob(f"{folder}/[0-9]*"))


def test_failed_range_leaves_the_others(spark, tmp_path):
    log, path = tmp_path / "log", f"{tmp_path}/pages"
    log.mkdir()
    pages = spark.createDataFrame([(k, f"http://h{k % 7}.example/{k}" + ("crash" if k == 33 else "fail" if k % 10 == 0 else ""), "x") for k in range(100)] + [(200, "http://a/b.pdf", "x"), (201, None, "x")], "doc_id long, url string, html2 string")
    quick = fetching.Manners(delay=0)

    def work(some):
        if not os.path.exists(f"{log}/allowed") and any("crash" in u for u in some["url"].to_pylist()):
            raise RuntimeError("the service ended")
        return fetching._fetched(some, Logged(log), quick)

    planned = fetching.by_host(connectors.wanted(pages).select("doc_id", "url"), 10)
    with pytest.raises(RuntimeError, match="1 ranges failed.*service ended"):
        ranges.run_ranges(planned, path, work)
    first = rows(ranges.committed(spark, path, fetching.PAGE).select("doc_id"))
    bad = {r["doc_id"] for r in planned.filter(F.col("range") == planned.filter("doc_id = 33").first()["range"]).collect()}
    assert {i for (i,) in first} == set(range(100)) - bad and len(first) == len(set(first)) and bad
    before = fetched(log)
    (log / "allowed").write_text("")
    out = fetching.fetch_committed(pages, path, Logged(log), quick, 10).select("doc_id", "html", "cut")
    got = {r["doc_id"]: (r["html"], r["cut"]) for r in out.collect()}
    assert len(got) == 102 and got[200] == got[201] == (None, None) and got[10] == (None, None) and got[33] == ("<p>http://h5.example/33crash", False)
    again = fetched(log) - before
    # Rows of the failed range were asked for; of the others only those committed without a page are left as they were.
    assert {int(u.rsplit("/", 1)[1].replace("crash", "").replace("fail", "")) for u in again} == bad
    ids = [i for (i,) in rows(ranges.committed(spark, path, fetching.PAGE).select("doc_id"))]
    assert len(ids) == len(set(ids)) == 100 - sum(k % 10 == 0 and k in bad for k in range(100))


def test_doubled_task_has_one_line(spark, tmp_path):
    """Two tries of a range leave two files, of which one is read; a file without a line and half a file are not read."""
    run, path = ranges.Run(f"{tmp_path}/r", "one"), f"{tmp_path}/r"
    page = lambda i: pa.Table.from_pylist([{"doc_id": i, "html": "x", "cut": False}], fetching.PAGE_ARROW)
    run.commit(0, page(1))
    run.commit(0, page(1))
    run.commit(1, page(2))
    os.remove(f"{path}/manifest/one-1.json")
    with open(f"{path}/data/_half.parquet", "wb") as f:
        f.write(b"PAR1 half")
    assert len(glob.glob(f"{path}/data/one-*")) == 3
    assert rows(ranges.committed(spark, path, fetching.PAGE)) == [(1, "x", False)]
    assert rows(ranges.manifest(spark, path).select("run", "range", "rows")) == [("one", 0, 1)]
    none = f"{tmp_path}/none"
    assert ranges.committed(spark, none, fetching.PAGE).count() == 0 and ranges.settled_keys(spark, none, "k", "long").count() == 0


def test_ranges_of_nothing_and_keys_without_rows(spark, tmp_path):
    keys = spark.range(25).withColumnRenamed("id", "k")
    status = ranges.run_ranges(ranges.numbered(keys, 10), f"{tmp_path}/a", lambda some: some.filter(pa.compute.less(some["k"], 5)))
    assert status.agg(F.sum("rows")).first()[0] == 5 and status.count() == 3
    assert rows(ranges.committed(spark, f"{tmp_path}/a", "k long")) == [(k,) for k in range(5)]
    assert ranges.settled_keys(spark, f"{tmp_path}/a", "k", "long").count() == 25
    assert ranges.run_ranges(ranges.numbered(keys.limit(0), 10), f"{tmp_path}/b", lambda some: some).count() == 0


class Pages(BaseHTTPRequestHandler):
    seen, busy, most, lock = defaultdict(list), 0, 0, threading.Lock()

    def do_GET(self):
        cls = type(self)
        with cls.lock:
            cls.seen[self.path.split("/")[1]].append(time.monotonic())
            cls.busy += 1
            cls.most = max(cls.most, cls.busy)
        time.sleep(0.05)
        with cls.lock:
            cls.busy -= 1
        self.send_response(404 if "missing" in self.path else 200)
        self.end_headers()
        self.wfile.write(b"" if "missing" in self.path else ("é" * 100 + self.path).encode())

    def log_message(self, *args):
        pass


@pytest.fixture()
def server():
    Pages.seen, Pages.busy, Pages.most = defaultdict(list), 0, 0
    s = ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_hosts_in_parallel_with_a_delay(server):
    urls = [f"{server}/h{k % 4}/{k}" + ("missing" if k == 5 else "") for k in range(16)] + [f"{server}/h9/x"]
    hosts = [u.split("/")[3] for u in urls]
    fetcher = connectors.HttpFetcher(timeout=5)
    got = fetching.fetch_hosts(urls, hosts, [0.3] * len(urls), fetcher, fetching.Manners(hosts_at_once=3, most_bytes=51))
    assert [g for k, g in enumerate(got) if k != 5] == [("é" * 25, True)] * 16 and got[5] == (None, None)  # 51 bytes hold 25 whole characters
    assert 2 <= Pages.most <= 3
    for times in Pages.seen.values():
        assert all(b - a > 0.15 for a, b in zip(times, times[1:]))
    assert fetching.cut_at("abc", 3) == ("abc", False) and fetching.cut_at("abcd", 3) == ("abc", True) and fetching.cut_at(None, 3) == (None, None)


def test_heavy_hosts_are_split(spark):
    pages = spark.createDataFrame([(k, f"http://{'hot' if k < 900 else f'h{k % 50}'}.example/{k}") for k in range(1000)] + [(2000, "no url at all")], "doc_id long, url string")
    got = fetching.by_host(pages, 50).collect()
    assert len(got) == 1001
    assert {r["splits"] for r in got if r["host"] == "hot.example"} == {18} and {r["splits"] for r in got if r["host"] != "hot.example"} == {1}
    per = Counter(r["range"] for r in got)
    assert max(per.values()) < 400
    where = defaultdict(set)
    for r in got:
        where[r["host"]].add(r["range"])
    assert len(where["hot.example"]) >= 8 and all(len(v) == 1 for h, v in where.items() if h != "hot.example")


class Search(BaseHTTPRequestHandler):
    times, tries, lock = [], Counter(), threading.Lock()

    def do_GET(self):
        cls = type(self)
        with cls.lock:
            cls.times.append(time.monotonic())
            cls.tries[self.path] += 1
            n = cls.tries[self.path]
        status = 204 if "q=quiet" in self.path and n == 1 else 500 if "q=bad" in self.path and n < 3 else 200
        self.send_response(status)
        self.end_headers()
        if status == 200:
            start = int(self.path.rsplit("start=", 1)[1])
            body = "{broken" if "q=torn" in self.path and n == 1 else json.dumps({} if "q=none" in self.path else {"items": [{"link": f"http://r/{start + k}", "title": "t", "n": k} for k in range(2)]})
            self.wfile.write(body.encode())

    def log_message(self, *args):
        pass


def test_search_source_holds_the_rate_and_tries_again(spark, tmp_path):
    Search.times, Search.tries = [], Counter()
    s = ThreadingHTTPServer(("127.0.0.1", 0), Search)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    asks = ["one", "quiet", "bad", "torn", "none", None]
    spark.createDataFrame([(f"Q{a}", a, "x") for a in asks], "search_query string, search_engine_input string, start string").repartition(2).write.parquet(f"{tmp_path}/in")
    search_source.register(spark)
    source = spark.read.format("search").options(inputs=f"{tmp_path}/in", endpoint=f"http://127.0.0.1:{s.server_port}/", key="k", num_results="25", pages_each="2", inputs_each="2", rate="20", at_once="4", tries="3", delay="0.01")
    got = source.load().collect()
    s.shutdown()
    assert sorted({(r["search_engine_input"], r["start"], r["position"]) for r in got}) == sorted((a, st, st + k) for a in asks[:4] for st in (1, 11, 21) for k in range(2)) and len(got) == 24
    hit = next(r for r in got if r["position"] == 12)
    assert hit["url"] == "http://r/12" and hit["title"] == "t" and hit["snippet"] is None and json.loads(hit["request_dump"])["n"] == 1 and hit["search_query"] == f"Q{hit['search_engine_input']}"
    assert sum(Search.tries.values()) == 15 + 3 + 6 + 3  # none is asked too; each page of quiet and torn once more, of bad twice
    # Each of the four tasks lets 5 through a second, and one at once at each partition's start.
    partitions = len(search_source.SearchReader({"inputs": f"{tmp_path}/in", "endpoint": "x", "num_results": "25", "pages_each": "2", "inputs_each": "2"}).partitions())
    assert partitions == sum(-(-n // 2) for n in (3, 3)) * 2
    assert Search.times[-1] - Search.times[0] >= (27 - partitions) / 20 * 0.9


def test_search_source_gives_up(spark, tmp_path):
    spark.createDataFrame([("q", "bad")], "search_query string, search_engine_input string").write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([("bad", 1, 500, "")], "search_engine_input string, start int, status int, response string").write.parquet(f"{tmp_path}/out")
    search_source.register(spark)
    with pytest.raises(Exception, match="status 500"):
        spark.read.format("search").options(inputs=f"{tmp_path}/in", responses=f"{tmp_path}/out").load().collect()


def test_token_bucket():
    now, slept = [0.0], []
    bucket = search_source.TokenBucket(2.0, 3, lambda: now[0], lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    for _ in range(7):
        bucket.take()
    assert slept == [0.5] * 4 and now[0] == 2.0
    now[0] = 100.0
    for _ in range(3):
        bucket.take()
    assert len(slept) == 4


def test_search_source_reads_rows_group_by_group(tmp_path):
    """A task's memory does not grow with the files of inputs and responses: of 40 MB each it holds little."""
    n = 40_000
    names = [f"{k:08d}" + hashlib.sha256(str(k).encode()).hexdigest() * 16 for k in range(n)]
    pq.write_table(pa.table({"search_query": ["q"] * n, "search_engine_input": names}), f"{tmp_path}/in.parquet", row_group_size=1000)
    pq.write_table(pa.table({"search_engine_input": names, "start": pa.array([1] * n, pa.int32()), "status": [200] * n, "response": [json.dumps({"items": [{"link": f"l{k}"}]}) for k in range(n)]}), f"{tmp_path}/out.parquet", row_group_size=1000)
    reader = search_source.SearchReader({"inputs": f"{tmp_path}/in.parquet", "responses": f"{tmp_path}/out.parquet", "num_results": "10", "inputs_each": "700"})
    parts = reader.partitions()
    assert sum(p.last - p.first for p in parts) == n
    pool = pa.proxy_memory_pool(pa.default_memory_pool())
    before = pa.default_memory_pool()
    pa.set_memory_pool(pool)
    try:
        found = [(r["search_engine_input"], r["url"]) for p in parts[3:5] for b in reader.read(p) for r in b.to_pylist()]
    finally:
        pa.set_memory_pool(before)
    assert found == [(names[k], f"l{k}") for k in range(parts[3].first, parts[4].last)]
    assert pool.max_memory() < 12 << 20

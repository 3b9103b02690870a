"""Golden cases of the relational operators, and every query against its oracle."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from stancemill.operators import features, models
from stancemill.operators import relational as R
from stancemill.plans import pipeline, registry
from stancemill.sources import connectors, io


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_filter_pair_thresh(spark):
    df = spark.createDataFrame([(1, "q1", "yes"), (2, "q1", "yes"), (3, "q1", "no"), (4, "q1", None), (5, "q2", "yes"), (6, "q2", "no"), (1, "q2", "not"), (7, None, "yes"), (8, None, "yes")], "answer_id long, search_query string, ans string")
    kept, ids = R.filter_pair_thresh(df, 2, "ans")
    assert rows(ids) == [(1,), (2,), (3,)]
    assert rows(kept) == [(1, "q1", "yes"), (1, "q2", "not"), (2, "q1", "yes"), (3, "q1", "no")]


def test_filter_by_id(spark):
    pages = spark.createDataFrame([(1,), (2,), (3,)], "answer_id long")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (3, 4)], "answer_id_1 long, answer_id_2 long")
    ids = spark.createDataFrame([(1,), (2,)], "answer_id long")
    assert [rows(x) for x in R.filter_by_id(pages, pairs, ids, True)] == [[(1,), (2,)], [(1, 2)]]
    assert [rows(x) for x in R.filter_by_id(pages, pairs, ids)] == [[(3,)], [(3, 4)]]


def test_null_ids(spark):
    df, none, some = (spark.createDataFrame(v, "answer_id long") for v in ([(1,), (None,)], [(None,)], [(1,)]))
    assert rows(R.keep_ids(df, none, "answer_id")) == [(None,)]
    assert rows(R.drop_ids(df, some, "answer_id")) == [(None,)]
    assert rows(R.drop_ids(df, none, "answer_id")) == [(1,)]


def test_agreed(spark):
    a = spark.createDataFrame([(1, "yes"), (2, "no"), (3, None), (4, "yes")], "answer_id long, label_a string")
    b = spark.createDataFrame([(1, "yes"), (2, "yes"), (3, None), (5, "no")], "answer_id long, label_b string")
    assert rows(R.agreed_ids(a, b)) == [(1,)]


def test_unpivot(spark):
    df = spark.createDataFrame([("c", "q", "y", None)], "category string, search_query string, yes_statement string, no_statement string")
    assert rows(R.unpivot_statements(df)) == [("c", "q", "no_statement", None), ("c", "q", "yes_statement", "y")]


def test_one_to_many(spark):
    left = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    right = spark.createDataFrame([("a", 10), ("a", 11), (None, 12), ("b", 13)], "k string, w int")
    assert rows(R.one_to_many(left, right, ["k"]).select("k", "v", "w")) == [("a", 1, 10), ("a", 1, 11), (None, 2, 12)]
    with pytest.raises(Exception, match="repeat"):
        R.one_to_many(left.union(left), right, ["k"]).collect()


def test_pairs_and_ids(spark):
    p = spark.createDataFrame([(5.0, 2.0, 0.75, 0.25)], "f_1 double, f_2 double, eval_1_prob double, eval_2_prob double")
    assert rows(R.paired(p, "f")) == [(3.0, 0.5)] and rows(R.singular(p, "f")) == [(2.0, 0.25), (5.0, 0.75)]
    d = R.dense_ids(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")), ["k"])
    assert d.filter("doc_id <> k").count() == 0 and d.count() == 1000
    with pytest.raises(ValueError, match="missing"):
        R.require_columns(p, ["nope"])


def test_sources(spark, tmp_path):
    ids = spark.createDataFrame([(1,), (2,), (2,)], "answer_id long")
    io.write_id_list(ids, f"{tmp_path}/ids")
    assert rows(io.read_id_list(spark, f"{tmp_path}/ids")) == [(1,), (2,), (2,)]
    (tmp_path / "q.json").write_text('["a", "b", "a"]')
    assert rows(io.read_json_strings(spark, f"{tmp_path}/q.json")) == [("a",), ("b",)]
    (tmp_path / "c.txt").write_text("  x \n\n\t\ny\n")
    assert rows(io.read_lines(spark, f"{tmp_path}/c.txt")) == [("x",), ("y",)]
    calls = []
    for _ in range(2):
        assert io.cached(spark, f"{tmp_path}/t", lambda: calls.append(1) or ids).count() == 3
    assert len(calls) == 1
    pages = spark.createDataFrame([(1, "http://a/x"), (2, "http://a/x.pdf"), (3, "http://a/y"), (4, None)], "doc_id long, url string")
    stored = spark.createDataFrame([("http://a/x", "<p>"), ("http://a/x.pdf", "%")], "url string, html string")
    assert rows(connectors.fetch_offline(pages, stored).select("doc_id", "html")) == [(1, "<p>"), (2, None), (3, None), (4, None)]
    assert rows(connectors.wanted(pages).select("doc_id")) == [(1,), (3,)]
    assert rows(io.resumed(pages, pages.filter("doc_id = 1"), "url", lambda x: x).select("doc_id")) == [(1,), (2,), (3,), (4,)]


def test_fetchers(spark):
    class Fake:
        def __enter__(self):
            return self

        def __exit__(self, *error):
            pass

        def fetch(self, url):
            return None if "bad" in url else url.upper()

    pages = spark.createDataFrame([(1, "http://a"), (2, "http://bad"), (3, "x.pdf")], "doc_id long, url string")
    assert rows(connectors.fetch_pages(pages, Fake())) == [(1, "HTTP://A"), (2, None)]
    assert connectors.HttpFetcher().fetch("not a url") is None

    class Echo:
        def complete(self, prompt):
            if "fail" in prompt:
                raise OSError
            return prompt

    df = spark.createDataFrame([("q",), ("fail",), (None,)], "search_query string")
    assert rows(connectors.completed(df, "<%s>", "search_query", Echo(), delay=0)) == [("fail", None), ("q", "<q>"), (None, None)]


def test_stream(spark, tmp_path):
    from stancemill.streaming.pages import page_stream

    page = "<p>" + "This is the text that we have been looking for and it is about the tea. " * 20 + "</p>"
    df = spark.createDataFrame([(1, "http://a.b.com/1", page), (2, "http://a.b.com/1", page), (3, "http://a.b.com/2", "<p>short</p>")], "page_id long, url string, html string")
    df.withColumn("fetched", F.expr("timestamp'2024-01-01 00:00:00'")).write.parquet(f"{tmp_path}/in")
    q = page_stream(spark, f"{tmp_path}/in").writeStream.format("memory").queryName("arrived").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = spark.table("arrived").collect()
    assert len(got) == 1 and got[0]["_domain"] == "b"


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    got = df.toPandas()
    if name not in registry.ORACLE:
        return
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    wanted = c.sql(registry.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    plain = lambda d: sorted(tuple("null" if v is None or v != v else str(v) for v in r) for r in d[sorted(d.columns)].itertuples(index=False, name=None))
    assert plain(got) == plain(wanted)


def test_scans(spark, sf_dir):
    """Nested evidence filters read the tables no more often than one: documents once and labels for each labeller and the pages; what decides is read from settled columns."""
    for name in ("ensemble_filter", "dedup_filter"):
        plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert (plan.count("/documents.parquet]"), plan.count("/labels.parquet]")) == (1, 3), name
        assert all("text" not in line for line in plan.split("\n") if "/settled-" in line)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_every_document_is_asked(spark, tmp_path):
    """Item ids with gaps and repeats, null and negative ids of documents."""
    spark.createDataFrame([(3, "red wine"), (3, "white wine"), (9, "tea")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(None, "red wine"), (-1, "tea"), (0, "red wine"), (1, "white wine"), (5, "tea"), (5, "tea")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert all(r["text"] == r["search_query"] for r in registry.asked(spark, str(tmp_path)).collect())
    for name in ("max_ngram_overlap", "st_similarity", "quote_shared", "add_features"):
        assert sorted(r["doc_id"] or 0 for r in registry.QUERIES[name](spark, str(tmp_path)).collect()) == [-1, 0, 0, 1, 5, 5], name


def test_id_list_is_one_json_array(spark, tmp_path):
    for k, ids in enumerate(([3, 1, 1, None, -2], [], [None], [7, 7])):
        io.write_id_list(spark.createDataFrame([(x,) for x in ids], "answer_id long"), f"{tmp_path}/{k}")
        (file,) = (tmp_path / str(k)).glob("part-*")
        assert json.loads(file.read_text()) == sorted((x for x in ids if x is not None)) + [None] * ids.count(None)
    (tmp_path / "one.json").write_text("[4, 5,6]")
    assert rows(io.read_id_list(spark, f"{tmp_path}/one.json")) == [(4,), (5,), (6,)]


def test_questions_with_row_numbers(spark, tmp_path):
    q = spark.createDataFrame([("b \"x\", y?", "c"), ("a?", "d")], io.QUESTIONS)
    io.write_questions(q.coalesce(1), f"{tmp_path}/i", ["search_query"])
    text = "".join(sorted(f.read_text().split("\n", 1)[1] for f in (tmp_path / "i").glob("part-*")))
    assert {line.split(",", 1)[0] for line in text.split("\n") if line} == {"0", "1"}
    assert rows(io.read_questions(spark, f"{tmp_path}/i", index=True)) == rows(q)


def test_read_pages_opens_only_what_is_named(spark, tmp_path):
    (tmp_path / "1.html").write_bytes("<p>é".encode())
    (tmp_path / "bad.html").write_bytes(b"\xff")
    (tmp_path / "2.html").mkdir()
    d = spark.createDataFrame([(1, f"{tmp_path}/1.html"), (2, "1.html"), (3, "none.html"), (4, None), (5, "bad.html")], "doc_id long, source_path string")
    found = io.read_pages(spark, d, str(tmp_path))
    assert [r.source for r in found.orderBy("doc_id").collect()] == ["<p>é", "<p>é", None, None, "\ufffd"] and found.columns == ["doc_id", "source_path", "source"]
    assert io.read_pages(spark, d.limit(0), str(tmp_path)).count() == 0


def test_fetch_resumed_fetches_once(spark, tmp_path):
    class Counting:
        """Fetches from no network; notes each url in a file and fails for some."""

        def __init__(self, log):
            self.log = str(log)

        def __enter__(self):
            return self

        def __exit__(self, *error):
            pass

        def fetch(self, url):
            with open(self.log, "a") as f:
                f.write(url + "\n")
            return None if "fail" in url else f"<html>{url}"

    log, path = tmp_path / "log", f"{tmp_path}/stored"
    io.write_pages(spark.createDataFrame([(3, "kept")], "doc_id long, html string"), path)
    d = spark.createDataFrame([(1, "http://a"), (2, "http://fail"), (3, "http://b.pdf"), (4, "http://c.pdf"), (5, None)], "doc_id long, url string")
    want = [(1, "<html>http://a"), (2, None), (3, "kept"), (4, None), (5, None)]
    assert rows(connectors.fetch_resumed(d, path, Counting(log)).select("doc_id", "html")) == want
    assert rows(connectors.fetch_resumed(d, path, Counting(log)).select("doc_id", "html")) == want
    assert sorted(log.read_text().split()) == ["http://a", "http://fail", "http://fail"]
    assert rows(connectors.fetch_resumed(d, path, None).select("doc_id", "html")) == want


def test_build_dataset_keeps_ids_and_drops_short_pages(spark, tmp_path):
    answers = spark.createDataFrame([("c", "Is tea good?", "Yes 1: Tea is good\nNo 1: Tea is bad")], "category string, search_query string, model_answer string")
    inputs = rows(pipeline.search_inputs(answers).select("search_type", "search_engine_input"))
    assert [t for t, _ in inputs] == ["no_statement", "yes_statement"]
    asked = []

    def ask(lacking):
        asked.append(lacking.count())
        urls = F.array(F.lit("http://a/1"), F.lit("http://a/2"))
        return lacking.withColumn("url", F.explode(urls)).withColumns({c: F.lit("") for c in ("title", "snippet", "request_dump")})

    hits, stored = f"{tmp_path}/hits", f"{tmp_path}/pages"
    words = " ".join(["This is what they say about the tea that we have and drink in the house."] * 20)
    page = lambda t: f"<html><body><p>{t}</p></body></html>"
    found = pipeline.search_table(spark, hits, pipeline.search_inputs(answers), ask)
    assert [r.doc_id for r in found.orderBy("doc_id").collect()] == [0, 1, 2, 3]
    io.write_pages(found.select("doc_id", F.when(F.col("url") == "http://a/1", page(words)).otherwise(page("Short.")).alias("html")), stored)
    out = pipeline.build_dataset(spark, answers, hits, stored, ask, None)
    assert rows(out.select("search_type", "url", "text")) == [("no_statement", "http://a/1", words), ("yes_statement", "http://a/1", words)]
    more = answers.unionByName(spark.createDataFrame([("c", "Is milk fine?", "Yes 1: Milk is fine\nNo 1: Milk is not")], answers.schema))
    grown = pipeline.search_table(spark, hits, pipeline.search_inputs(more), ask)
    assert sorted(r.doc_id for r in grown.collect()) == list(range(8)) and asked == [2, 0, 2]
    assert rows(grown.filter("doc_id < 4").select("doc_id", "search_engine_input", "url")) == rows(found.select("doc_id", "search_engine_input", "url"))


def test_top_rows_pairs_and_ranges(spark):
    d = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4), (None, 5), (None, 6)], "k string, v long")
    assert rows(R.top_rows(d, ["k"], [F.desc("v")], 2).select("v")) == [(2,), (3,), (4,), (5,), (6,)]
    assert rows(R.pairs_within(d, "k", "v", [])) == [("a", 1, 2), ("a", 1, 3), ("a", 2, 3)]
    for n, parts in ((10, 3), (2, 5), (7, 1), (16, 4)):
        got = [r.p for r in spark.range(n).select(R.range_part(F.col("id"), n, parts).alias("p"), "id").orderBy("id").collect()]
        assert got == [d for d in range(parts) for _ in range(d * n // parts, (d + 1) * n // parts)]


def test_unique_lemmas_by_a_callers_lemmatizer(spark):
    class Plural:
        def lemma(self, token):
            return token.rstrip("s")

    d = spark.createDataFrame([("cat cats dog",), (None,), ("",)], "text string")
    made = features.add_features(d, ["_num_unique_tokens"], models={"_num_unique_tokens": models.unique_lemmas(Plural())})
    assert [r._num_unique_tokens for r in made.collect()] == [2, None, 1]

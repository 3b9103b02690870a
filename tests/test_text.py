"""Golden cases of the text functions."""

import collections
import math
import random
import re
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stancemill.functions import stem
from stancemill.functions import text as T
from stancemill.operators import boilerplate, features, models
from stancemill.plans import stem_sql


@pytest.fixture(scope="module")
def one(spark):
    return lambda value, build, kind="string": spark.createDataFrame([(value,)], f"v {kind}").select(build(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("answer, full, short", [("Yes.", "yes", "yes"), ("I know", "no", "no"), ("It does NOT, yes", "not", "yes"), ("eyes", "yes", "yes"), ("maybe", None, None), ("", None, None), (None, None, None)])
def test_classify(one, answer, full, short):
    assert one(answer, lambda c: T.classify(c, T.FULL_CLASSES)) == full
    assert one(answer, lambda c: T.classify(c, T.SHORT_CLASSES)) == short


@pytest.mark.parametrize("text, last", [("a\nyes", "yes"), ("a\n", ""), (None, None), ("", "")])
def test_last_line(one, text, last):
    assert one(text, T.last_line) == last


def test_statements(one):
    answer = "Yes 1: Red wine is good\nYes 2: Wine: helps\nNo 1: Red wine is bad\nNote: skip me\nno colon\nNo 2:"
    assert one(answer, lambda c: T.statements(c, "yes")) == "Red wine is good. Wine: helps"
    assert one(answer, lambda c: T.statements(c, "no")) == "Red wine is bad. skip me"
    assert one("Maybe", lambda c: T.statements(c, "yes")) == ""
    assert one(None, lambda c: T.statements(c, "yes")) is None


@pytest.mark.parametrize("line, keep", [("1. Is tea safe?", True), ("   ", False), ("No mark", False), (" ```Is? ", False), ('""" why?', False), ("Is it? yes", True), (None, None)])
def test_questions(one, line, keep):
    assert one(line, T.is_question) == keep


@pytest.mark.parametrize("text, n, unique", [("", 1, 1), ("a  b ", 4, 3), (None, None, None), ("A a", 2, 2)])
def test_tokens(one, text, n, unique):
    assert one(text, T.num_tokens) == n
    assert (one(text, T.num_unique_tokens) if text is not None else None) == unique
    assert one(" ".join(["w"] * 199), T.long_enough) is False and one(" ".join(["w"] * 200), T.long_enough) is True
    assert one("\n".join(["w"] * 300), T.long_enough) is False and one(None, T.long_enough) is False


def test_patterns(one):
    assert one("<a href = 1 HREF=2 href=3", lambda c: T.count_pattern(c, T.HREF)) == 2
    assert one('x a.b@c.de, "q r"@[1.2] no@ z', lambda c: T.count_pattern(c, T.EMAIL)) == 2
    assert one("HTTPS://x.example/a(b).c; a.b-c.co.uk/d?e=f#g, not file.zzz or a.comx or x@y.com", lambda c: T.count_pattern(c, T.url_pattern())) == 2
    assert one("see http://a.bc/x and www.example.com. me@example.com", lambda c: T.count_pattern(c, T.url_pattern())) == 2


@pytest.mark.parametrize("text, query, run", [("My red wine, is good.", "Is red wine good?", ["red", "wine"]), ("b a", "a b", ["a"]), ("x", "y", []), ("", "y", []), ("x", "", []), ("I like red wines", "red wine", ["red", "wine"]), ("red wines are good", "is red wine good", ["red", "wine"]), ("you can not stay", "you cannot stay", ["you", "can", "not", "stai"]), (None, "x", None)])
def test_ngram(spark, text, query, run):
    df = spark.createDataFrame([(text, query)], "t string, q string")
    assert df.select(stem.longest_common_ngram(T.normal_words(F.col("t")), T.normal_words(F.col("q"))).alias("r")).first()["r"] == run


@pytest.mark.parametrize("n, size, step, starts", [(507, 508, 256, [1]), (508, 508, 256, [1]), (763, 508, 256, [1]), (764, 508, 256, [1, 257]), (1020, 508, 256, [1, 257, 513]), (9, 4, 2, [1, 3, 5]), (0, 4, 2, [None])])
def test_windows(one, n, size, step, starts):
    got = one([str(k) for k in range(1, n + 1)], lambda c: T.windows(c, size, step), "array<string>")
    assert [int(w[0]) if w else None for w in got] == starts
    assert all(len(w) == min(n, size) for w in got)


@pytest.mark.parametrize("scores, at", [([1.0, 2.0, 2.0], 1), ([float("nan"), 0.5], 1), ([3.0], 0)])
def test_best_window(one, scores, at):
    got = one([(s, [str(k)]) for k, s in enumerate(scores)], T.best_window, "array<struct<score:double,window:array<string>>>")
    assert -got["at"] == at


@pytest.mark.parametrize("parts, text, first, last", [
    (["and left.", "It rained.", "We went"], "It rained.", "and left.", "We went"),
    (["and left"], "and left", None, None),
    (["It rained.", 'He said "hi"'], 'It rained. He said "hi"', None, None),
    ([", so.", "It rained."], "It rained.", ", so.", None),
    (["3 men came.", "Ok."], "3 men came. Ok.", None, None),
    (["and so.", "  "], "", "and so.", None),
    ([" ", "  "], "", None, None),
])
def test_trim(one, parts, text, first, last):
    got = one(parts, T.trim_sentences, "array<string>")
    assert (got["text"], got["removed_first"], got["removed_last"]) == (text, first, last)


@pytest.mark.parametrize("n, starts", [(-1, []), (0, []), (1, []), (2, [1]), (11, [1]), (20, [1, 11]), (100, list(range(1, 100, 10))), (500, list(range(1, 100, 10)))])
def test_page_starts(one, n, starts):
    assert one(n, T.page_starts, "int") == starts


def test_readability(one):
    assert one("Short text.", T.readability) == 0.0
    assert one(None, T.readability) is None
    assert one("The cat sat. " * 50, T.readability) == pytest.approx(0.39 * 3 + 11.8 - 15.59)


@pytest.mark.parametrize("url, suffix, domain", [("http://forums.news.example.co.uk/x", "co.uk", "example"), ("https://example.com", "com", "example"), ("no url", None, None), (None, None, None), ("http://localhost/", "localhost", None)])
def test_urls(one, url, suffix, domain):
    assert one(url, lambda c: T.suffix(c, ["co.uk"])) == suffix
    assert one(url, lambda c: T.domain(c, ["co.uk"])) == domain


@pytest.mark.parametrize("word, out", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("formalize", "formal"), ("adjustment", "adjust"), ("controll", "control"), ("Is", "is")])
def test_stem(word, out):
    assert stem.stem(word) == out


@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=7))
def test_longest_run(text, query):
    runs = [(e - b, -e, query[b:e]) for b in range(len(query)) for e in range(b + 1, len(query) + 1) if any(text[k : k + e - b] == query[b:e] for k in range(len(text)))]
    assert stem.longest_run(text, query) == max(runs, default=(0, 0, []))[2]


def test_stem_sql():
    """The pattern form of the stemmer gives the same stems."""
    rng = random.Random(1)
    ends = [*(r.partition(":")[0] for r in stem.STEP2 + stem.STEP3), *stem.STEP4, "s", "es", "ies", "ed", "ing", "eed", "y", "e", "ll", "tted", "sses", "lling", ""]
    words = sorted({"".join(rng.choices("aeioubcdlsty", k=rng.randrange(1, 7))) + rng.choice(ends) + rng.choice(["", "", "s"]) for _ in range(4000)})
    c = duckdb.connect()
    c.execute("CREATE TABLE words AS SELECT unnest(?) AS w", [words])
    assert dict(c.sql(f"WITH {stem_sql.stems('words')} SELECT w, stem FROM stems").fetchall()) == {w: stem.stem(w) for w in words}


def test_quote_shared():
    stop = frozenset({"is"})
    assert stem.quote_shared("Red Wine Is Good", "Is red wine good?", stop) == ('"red" "wine" is "good"', 'is "red" "wine" "good"?')
    assert stem.quote_shared("Tea helps", "Is water wet?", stop) == ("Tea helps", "Is water wet?")
    assert stem.quote_shared(None, "x") == (None, None)
    # A capital after the first shared word is never found: texts are in lower case by then.
    assert stem.quote_shared("Tea And Milk", "Milk and TEA", frozenset({"and"})) == ('"tea" and milk', "milk and tea")
    assert stem.quote_shared('say "cats" (cat)', "cat?", frozenset()) == ('say "cats" ("cat")', '"cat"?')


def test_main_text():
    page = "<html><body><nav><a href=/>Home</a> <a href=/>News</a></nav><h1>On tea</h1><p>" + "This is the text that we have been looking for and it is about the tea. " * 5 + "</p><footer>© all</footer></body></html>"
    assert boilerplate.page_text(page).startswith("On tea\nThis is the text") and "Home" not in boilerplate.page_text(page)
    assert boilerplate.page_text(None) is None and boilerplate.page_text("") == ""


def test_models(spark):
    class Words:
        """A model of each kind, from counts."""

        def logprobs(self, prompt, labels):
            assert "Text: " in prompt
            return [-float(len(x)) for x in labels]

        def loss(self, text):
            return math.log(1 + len(text.split()))

    df = spark.createDataFrame([(1, "a b c d e f g h i", "e f"), (2, "x", "x"), (3, None, "x"), (4, "a", None), (5, "e e e", "e")], "id long, text string, search_query string")
    tokens, counts = models.SpaceTokenizer(), models.CountEncoder("aefx")
    got = {r["id"]: (r["text_thresh_window"], r["text_thresh_window_score"]) for r in models.best_windows(df, tokens, counts, length=5, step=2, padding=1, budget=2).collect()}
    assert got == {1: ("c d e f", 2.0), 2: ("x", 1.0), 3: (None, None), 4: (None, None), 5: ("e e e", 3.0)}
    assert models.best_windows(df, tokens, counts).columns == [*df.columns, "text_thresh_window", "text_thresh_window_score"]
    own = {"_st_similarity": models.similarity(counts), "_sentiment_flan": models.sentiment(Words()), "_perplexity_gpt2": models.perplexity(Words())}
    made = {r["id"]: r for r in features.add_features(df, list(own), models=own).collect()}
    assert [made[k]["_st_similarity"] for k in range(1, 6)] == [2.0, 1.0, None, None, 3.0]
    assert made[1]["_sentiment_flan"] == {"Positive": -8.0, "Negative": -8.0} and made[3]["_sentiment_flan"] is None
    assert made[1]["_perplexity_gpt2"] == pytest.approx(10) and made[3]["_perplexity_gpt2"] is None
    trimmed = models.trim_rescored(spark.createDataFrame([("and e. It is e.", "e"), ("x", None)], "text_thresh_window string, search_query string"), counts).collect()
    assert [(r["text_thresh_window_sent"], r["score_sent"]) for r in trimmed] == [("It is e.", 1.0)]


def test_failing_feature(spark):
    df = spark.createDataFrame([("a b",)], "text string")

    def broken(text, query, url):
        raise ValueError("no model")

    with pytest.warns(UserWarning, match="_st_similarity left out"):
        got = features.add_features(df, ["_st_similarity", "_num_tokens"], models={"_st_similarity": broken})
    assert got.columns == ["text", "_num_tokens"] and got.first()["_num_tokens"] == 2


def test_features(spark):
    assert len(features.REGISTRY) == 12
    df = spark.createDataFrame([("good bad tea", "tea", "http://a.example.com"), (None, None, None), ("", "", "")], "text string, search_query string, url string")
    rows = features.add_features(df).collect()
    assert rows[0]["_num_tokens"] == 3 and rows[0]["_domain"] == "example" and set(rows[0]["_sentiment_flan"]) == {"Positive", "Negative"}
    assert all(rows[1][n] is None for n in features.REGISTRY if n != "_max_ngram_overlap")
    kept = features.add_features(df.withColumn("_tld", F.lit("x")), ["_tld"])
    assert {r["_tld"] for r in kept.collect()} == {"x"}


def _counts(spark, texts, count):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")
    return [r["n"] for r in df.select("k", count(F.col("t")).alias("n")).orderBy("k").collect()]


def test_email_count_equals_the_pattern(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice('aB.."@@[]\\ \té-#') for _ in range(rng.randrange(40))) for _ in range(4000)]
    texts += ['"a\\"b"@c', 'x\\"abc"@d', "a..b@c.d.", "a@[x y]b@c", "a.b@c.d@e.f", '"' + "q" * T.MOST_QUOTED + '"@x.y']
    assert _counts(spark, texts, T.email_count) == [len(re.findall(T.EMAIL, t)) for t in texts]


def test_url_count_equals_labels_tried_one_by_one(spark):
    """Against the same grammar with labels that are given back."""
    old = T.url_pattern().replace(r"(?:[a-z0-9]++(?:-++[a-z0-9]++)*+\.(?=[a-z0-9]))++", r"(?:[a-z0-9](?:[a-z0-9\-]*[a-z0-9])?\.)+")
    assert old != T.url_pattern()
    rng = random.Random(2)
    parts = ["a", "b-c", "-", ".", "..", "com", "co.uk", "http://", "HTTPS://", "/", "?", "@", " ", "_", "x.org", ")", ":", "#", ","]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(4000)]
    assert _counts(spark, texts, lambda c: T.count_pattern(c, T.url_pattern())) == [len(re.findall(old, t)) for t in texts]


def test_hostile_texts_are_counted_in_time(spark):
    n = 1 << 20
    texts = [s * (n // len(s)) for s in ('"', "a", ".", "a.", "a.b-", "a@", '\\"', "@", "[", "a@[", "-", "http://", "http://.", "com.", '"a" ', "é")]
    texts += ['"' + "a" * n, '"@' + '\\"' * (n // 2), "http://" + "." * n, "x@" + "a." * (n // 2), "[" * n + '"@']
    began = time.time()
    _counts(spark, texts, T.email_count)
    _counts(spark, texts, lambda c: T.count_pattern(c, T.url_pattern()))
    assert time.time() - began < 120


def test_token_perplexity_does_not_hang_on_the_order_of_rows(spark):
    """Sums of logarithms are rounded once, so that values equal the exact ones to the last bit."""
    rng = random.Random(7)
    texts = [" ".join(f"w{int(rng.random() ** 3 * 400)}" for _ in range(rng.randint(1, 120))) for _ in range(300)]
    counts = collections.Counter(w for t in texts for w in t.split())
    total = sum(counts.values()) + len(counts)
    mean = lambda c: math.fsum(n * -math.log((counts[w] + 1) / total) for w, n in c.items()) / sum(c.values())
    expected = {k: math.exp(mean(collections.Counter(t.split()))) for k, t in enumerate(texts)}
    df = spark.createDataFrame([*enumerate(texts), (300, None), (301, " .")], "id long, text string").repartition(7)
    assert {r["id"]: r["perplexity"] for r in features.token_perplexity(df, "id", "text").collect()} == expected | {300: None, 301: None}


def test_word_udfs_hold_few_rows_as_python_objects():
    """However many rows a batch has, words become numbers and texts become strings some rows at a time."""
    sizes = np.array([5, stem.HELD, 3, 0, 4])
    assert list(stem.runs(sizes)) == [(0, 1), (1, 2), (2, 5)] and not list(stem.runs(sizes[:0]))
    lists = pa.array([["a"], ["b", "a", "b"], None, [], ["c", None]])[1:]
    assert stem.coded(lists) == ([[0, 1, 0], None, [], [2, 3]], ["b", "a", "c", None]) or stem.coded(lists)[0][:3] == [[0, 1, 0], None, []]
    assert stem.sizes_of(lists).tolist() == [3, 0, 0, 2] and stem.sizes_of(pa.array(["x", None, "é"])).tolist() == [1, 0, 2]


def test_add_features_finds_words_once(spark):
    """The four features of words share a projection, and have the values that each alone has."""
    df = spark.createDataFrame([(1, "Red wines can be good, good for hearts. They cannot fail!", "is red wine good?"), (2, "", ""), (3, None, "x"), (4, "x", None)], "id long, text string, search_query string")
    both = features.add_features(df, list(features.OF_WORDS))
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(lower(text") == 1 and both.columns == ["id", "text", "search_query", *features.OF_WORDS]
    alone = df.select("id", *(features.REGISTRY[n](F.col("text"), F.col("search_query"), None).alias(n) for n in features.OF_WORDS))
    assert both.drop("text", "search_query").collect() == alone.collect()

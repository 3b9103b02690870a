"""Public suffixes by rules, learned sentence boundaries and lemmas."""

import math
import random
import re
from collections import Counter

import pytest

from stancemill.operators import lemmas, sentences, urls


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


RULES = ["com", "uk", "co.uk", "ck", "*.ck", "!www.ck", "*.a.b.com"]
CASES = {
    "http://x.com/": ("com", "x"), "http://a.x.co.uk": ("co.uk", "x"), "http://co.uk/": ("co.uk", ""), "http://x.y.ck": ("y.ck", "x"), "http://y.ck": ("y.ck", ""), "http://www.ck/": ("ck", "www"),
    "http://a.www.ck": ("ck", "www"), "http://1.2.3.4/x": ("", "1.2.3.4"), "http://localhost:80/": ("", "localhost"), "http://s.unknown/": ("", "unknown"), "http://X.COM./": ("com", "x"),
    "http://q.a.b.com": ("q.a.b.com", ""), "http://p.q.a.b.com": ("q.a.b.com", "p"), "http://a.b.com": ("com", "b"), "no url": (None, None),
}


def test_suffix_rules(spark):
    pages = spark.createDataFrame([(u, "x") for u in [*CASES, *CASES]] + [(None, "x")], "url string, rule string")
    got = urls.with_suffixes(pages, spark.createDataFrame([(r,) for r in RULES], "rule string"))
    assert rows(got.select("url", "_tld", "_domain")) == sorted([(u, *v) for u, v in CASES.items()] * 2 + [(None, None, None)], key=str)
    assert got.columns == ["url", "rule", "_tld", "_domain"]
    none = urls.with_suffixes(pages.limit(0), spark.createDataFrame([], "rule string"))
    assert none.count() == 0


def test_plan_does_not_grow_with_the_rules(spark):
    pages = spark.createDataFrame([("http://x.r7.com/",)], "url string")
    size = lambda n: len(urls.with_suffixes(pages, spark.range(n).selectExpr("concat('r', id, '.com') as rule"))._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(10) - size(10000)) < 200
    assert rows(urls.with_suffixes(pages, spark.range(10000).selectExpr("concat('r', id, '.com') as rule"))) == [("http://x.r7.com/", "r7.com", "x")]


def prose(rng):
    names = ["Smith", "Jones", "Brown", "Lee"]
    out = []
    for _ in range(400):
        out.append(f"{rng.choice(['Dr', 'Mr', 'Prof'])}. {rng.choice(names)} {rng.choice(['went', 'saw', 'left'])} the {rng.choice(['house', 'river', 'market'])}.")
        out.append(f"The {rng.choice(["old", "new", "far"])} {rng.choice(["house", "river", "market"])} was {rng.choice(["old", "new", "far"])}.")
    return " ".join(out)


def test_abbreviations_are_learned(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(k, prose(rng), "t") for k in range(5)] + [(9, None, "t"), (10, "", "t")], "doc_id long, text string, type string")
    known = sentences.abbreviations(sentences.counted(docs))
    assert {"dr", "mr", "prof"} <= {r["type"] for r in known.collect()} and not {"house", "river", "market", "old"} & {r["type"] for r in known.collect()}
    asked = spark.createDataFrame([(1, "Dr. Smith went. The house was old. Is it? J. Lee saw the river."), (2, None), (3, ""), (4, "No end"), (None, "Mr. Lee left.  The end.")], "doc_id long, text string")
    got = {r["doc_id"]: r["sentences"] for r in sentences.split_sentences(asked, known).collect()}
    assert got == {1: ["Dr. Smith went.", "The house was old.", "Is it?", "J. Lee saw the river."], 2: None, 3: [""], 4: ["No end"], None: ["Mr. Lee left.", "The end."]}
    assert sentences.split_sentences(asked.limit(0), known).count() == 0
    assert sentences.abbreviations(sentences.counted(docs.limit(0))).count() == 0


def test_abbreviation_scores_against_the_formula(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["e.g.", "etc.", "etc", "cat", "cat.", "dog", "U.S.", "u.s", "x", "(dog.)", "?!", "12."]) for _ in range(200)) for _ in range(10)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    c = Counter()
    for t in texts:
        for w in t.split():
            w = re.sub(r"^[\"'(\[{«“‘]+|[\"')\]}»”’,;:]+$", "", w)
            if re.search("[a-zA-Z]", w):
                c[re.sub("[.!?]+$", "", w).lower(), w.endswith(".")] += 1
    total = sum(c.values())
    p = sum(n for (_, dot), n in c.items() if dot) / total
    expected = []
    for w in {w for w, _ in c}:
        k, plain = c[w, True], c[w, False]
        length, inner = len(w.replace(".", "")), w.count(".")
        ln = lambda q: k * math.log(q) + plain * math.log(1 - q)  # noqa: B023, E731
        score = -2 * (ln(p) - ln(0.99)) * math.exp(-length) * (inner + 1) * length ** -float(plain)
        if k and score >= 0.3:
            expected.append((w, k, plain, score))
    got = rows(sentences.abbreviations(sentences.counted(docs)))
    assert [g[:3] for g in got] == [e[:3] for e in sorted(expected, key=str)]
    assert all(g[3] == pytest.approx(e[3]) for g, e in zip(got, sorted(expected, key=str)))


def test_pairs_go_on(spark):
    rng = random.Random(3)
    text = " ".join(f"See fig. {rng.choice('1234')} there. {rng.choice(['We', 'They'])} saw no. 5 too." for _ in range(200))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    known = spark.createDataFrame([("no",)], "type string")
    pairs = sentences.collocations(docs, known)
    assert rows(pairs.select("first", "second")) == [("no", "5")]
    got = sentences.split_sentences(docs, known.limit(0), pairs).first()["sentences"]
    assert sum("no. 5 too." in s for s in got) == 200


def test_lemmas(spark):
    tokens = ["cats", "boxes", "wolves", "churches", "dishes", "ladies", "women", "mice", "cat", "gas", "xyz", "glasses", "cats", None, "", "s", "axes"]
    words = ["cat", "box", "wolf", "church", "dish", "lady", "woman", "mouse", "gas", "glass", "ax", "axe", "axis"]
    one = lambda values, name: spark.createDataFrame([(v,) for v in values], f"{name} string")
    exceptions = spark.createDataFrame([("mice", "mouse"), ("axes", "axis"), ("axes", "axe")], "form string, lemma string")
    got = dict(rows(lemmas.lemma_table(one(tokens, "token"), one(words, "word"), exceptions)))
    assert got == {"cats": "cat", "boxes": "box", "wolves": "wolf", "churches": "church", "dishes": "dish", "ladies": "lady", "women": "woman", "mice": "mouse", "cat": "cat", "gas": "gas", "xyz": "xyz", "glasses": "glass", "": "", "s": "s", "axes": "axe"}
    again = dict(rows(lemmas.lemma_table(one(["xsss"], "token"), one(["x", "xs"], "word"), exceptions)))
    assert again == {"xsss": "xs"}  # detached twice, and then no more
    assert lemmas.lemma_table(one([], "token"), one(words, "word"), exceptions).count() == 0

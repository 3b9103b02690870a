"""Models in tasks: encoded once, loaded once, batches of like lengths, devices, and subword tokens against brute force."""

import glob
import os
import sys
import uuid
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import TaskContext, cloudpickle
from pyspark.sql import functions as F

from stancemill.operators import models, runtime, subwords

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks can't import tests


class Counting:
    """Encodes a text by its length and number of a's; leaves a file for each text it sees."""

    def __init__(self, folder):
        self.folder = str(folder)

    def encode(self, texts):
        for t in texts:
            with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(t)
        return np.array([[len(t), t.count("a")] for t in texts], float)


def seen(folder):
    return Counter(open(f).read() for f in glob.glob(f"{folder}/*"))


def test_each_query_is_encoded_once(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"text a{k} " * 9, "hot" if k % 3 else f"q{k % 4}", "x") for k in range(60)] + [(100, None, "hot", "x"), (101, "text", None, "x")], "id long, text string, search_query string, query_vector2 string").repartition(7)
    best = models.best_windows(pages, models.SpaceTokenizer(), Counting(tmp_path), length=8, step=2)
    got = {r["id"]: (r["text_thresh_window"], r["text_thresh_window_score"]) for r in best.collect()}
    asked = seen(tmp_path)
    assert {q: asked[q] for q in ("hot", "q0", "q1", "q2", "q3")} == dict.fromkeys(("hot", "q0", "q1", "q2", "q3"), 1)
    assert got[100] == got[101] == (None, None) and best.columns == [*pages.columns, "text_thresh_window", "text_thresh_window_score"]
    for k in range(60):
        q = "hot" if k % 3 else f"q{k % 4}"
        tokens = (f"text a{k} " * 9).split(" ")
        windows = [" ".join(tokens[i : i + 4]) for i in range(0, len(tokens) - 3, 2)]
        scores = [len(w) * len(q) + w.count("a") * q.count("a") for w in windows]
        assert got[k] == (windows[scores.index(max(scores))], max(scores))
    folder = tmp_path / "trim"
    folder.mkdir()
    models.trim_rescored(pages.withColumnRenamed("text", "text_thresh_window"), Counting(folder)).collect()
    assert all(seen(folder)[q] == 1 for q in ("hot", "q0", "q1", "q2", "q3"))


def test_a_model_is_loaded_once_a_worker(spark, tmp_path):
    def make():
        with open(f"{tmp_path}/{os.getpid()}-{uuid.uuid4().hex}", "w"):
            pass
        return models.CountEncoder("a")

    loaded = runtime.Loaded(make)
    texts = spark.range(0, 2000, 1, 40).select(F.repeat(F.lit("a"), (F.col("id") % 50).cast("int")).alias("t"))
    for _ in range(2):
        got = texts.select("t", runtime.encode(F.col("t"), loaded).alias("v")).collect()
        assert all(r["v"] == [len(r["t"])] for r in got)
    loads = Counter(os.path.basename(f).split("-")[0] for f in glob.glob(f"{tmp_path}/*"))
    assert loads and set(loads.values()) == {1} and sum(loads.values()) < 40  # 80 tasks


@settings(deadline=None)
@given(st.lists(st.integers(0, 300), max_size=60), st.integers(1, 500), st.integers(1, 20))
def test_batches_of_like_lengths(lengths, budget, most):
    batches = runtime.like_lengths(lengths, budget, most)
    assert sorted(k for b in batches for k in b) == list(range(len(lengths)))
    for b in batches:
        assert len(b) <= most and (len(b) == 1 or max(lengths[k] for k in b) * len(b) <= budget)
    ends = [(min(lengths[k] for k in b), max(lengths[k] for k in b)) for b in batches]
    assert all(a[1] <= z[0] for a, z in zip(ends, ends[1:]))


def test_batches_pad_little_and_change_nothing():
    rng = np.random.default_rng(1)
    texts = ["a" * int(n) + "b" for n in rng.integers(0, 400, 500)]
    lengths = [len(t) for t in texts]
    padded = sum(max(lengths[k] for k in b) * len(b) for b in runtime.like_lengths(lengths, 4096))
    plain = sum(max(lengths[k : k + 32]) * len(lengths[k : k + 32]) for k in range(0, 500, 32))
    assert padded < 1.1 * sum(lengths) < plain
    model = models.CountEncoder("ab")
    one = [v.tolist() for v in runtime.encoded(model, texts, 1)]
    assert one == [v.tolist() for v in runtime.encoded(model, texts, 10**6)] == [[n - 1, 1] for n in lengths]
    assert runtime.encoded(model, []) == []


def test_devices(spark, monkeypatch):
    df = spark.range(10)
    out = runtime.on_devices(df, lambda device, batches: batches if device is None else iter(()), "id long")
    assert out.count() == 10  # a local master gives no devices
    profile = runtime.device_profile("gpu", "/bin/find-gpus", 2)
    assert profile.taskResources["gpu"].amount == 1 and profile.taskResources["cpus"].amount == 2 and profile.executorResources["gpu"].discoveryScript == "/bin/find-gpus"

    class Task:
        def resources(self):
            return {"gpu": type("R", (), {"addresses": ["3"]})()}

    monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: Task()))
    assert runtime.device() == "3" and runtime.device("fpga") is None


# Subwords


def brute_word(word, pieces):
    out, at = [], 0
    while at < len(word):
        ends = [k for k in range(at + 1, len(word) + 1) if (subwords.INNER if at else "") + word[at:k] in pieces]
        if not ends:
            return [(subwords.UNKNOWN, 0, len(word))]
        out.append((pieces[(subwords.INNER if at else "") + word[at : ends[-1]]], at, ends[-1]))
        at = ends[-1]
    return out


@settings(deadline=None)
@given(st.lists(st.text("abé#", min_size=1, max_size=4), max_size=12), st.lists(st.text("ab", min_size=1, max_size=3), max_size=8), st.text("abé# .\n", max_size=40), st.integers(1, 4), st.integers(1, 4))
def test_trie_against_brute_force(first, inner, text, size, step):
    pieces = {p: k for k, p in enumerate(dict.fromkeys([*first, *(subwords.INNER + x for x in inner)]))}
    pieces = {p: k for p, k in pieces.items() if p != subwords.INNER}
    inside = {p for p in pieces if p.startswith(subwords.INNER)}
    heads = {p: k for p, k in pieces.items() if p not in inside}
    tokenizer = subwords.TrieTokenizer(pieces)
    import re

    expected = []
    for m in re.finditer(subwords.WORD, text):
        expected += [(i, m.start() + a, m.start() + b) for i, a, b in brute_word(m[0], {**heads, **{p: pieces[p] for p in inside}})]
    # A piece that begins with the mark is never a word's first one.
    assert tokenizer.spans(text) == expected
    again = cloudpickle.loads(cloudpickle.dumps(tokenizer))
    assert again.spans(text) == expected
    n = len(expected)
    got = tokenizer.windows(text, size, step)
    if n <= size:
        assert got == [(0, n, 0, len(text))]
    else:
        assert got == [(k, size, expected[k][1], expected[k + size - 1][2]) for k in range(0, n - size + 1, step)]


def test_subword_windows(spark):
    vocabulary = spark.createDataFrame([("ab", 1), ("a", 2), ("##b", 3), ("ab", 0), ("", 5), (".", 6)], "piece string, id long")
    tokenizer = subwords.tokenizer_of(vocabulary)
    assert tokenizer.encode("ab abb. x") == [0, 0, 3, 6, subwords.UNKNOWN]
    docs = spark.createDataFrame([(1, "ab abb. x", "z"), (None, "", "z"), (3, None, "z"), (1, "ab", "z")], "doc_id long, text string, first string")
    got = sorted((tuple(r) for r in subwords.subword_windows(docs, tokenizer, 2, 1, texts=True).collect()), key=str)
    assert got == sorted([(1, 0, 2, 0, 5, "ab ab"), (1, 1, 2, 3, 6, "abb"), (1, 2, 2, 5, 7, "b."), (1, 3, 2, 6, 9, ". x"), (None, 0, 0, 0, 0, ""), (1, 0, 1, 0, 2, "ab")], key=str)
    assert subwords.subword_windows(docs.limit(0), tokenizer).count() == 0
    with pytest.raises(ValueError, match="more than 2"):
        subwords.tokenizer_of(vocabulary, 2)
    best = models.best_windows(spark.createDataFrame([("ab abb. x", "b")], "text string, search_query string"), tokenizer, models.CountEncoder("b"), length=6, step=1).first()
    assert (best["text_thresh_window"], best["text_thresh_window_score"]) == ("ab ab", 2.0)


def test_rescored_in_order(spark):
    pages = spark.createDataFrame([(k, f"q{k % 5}", "It is a. It is b.") for k in (7, 3, 9, 1, 4, 6)], "answer_id long, search_query string, text_thresh_window string").repartition(3)
    got = models.trim_rescored(pages, models.CountEncoder(), ordered=True).collect()
    assert [(r["search_query"], r["answer_id"]) for r in got] == sorted((f"q{k % 5}", k) for k in (7, 3, 9, 1, 4, 6))


def test_stand_in_similarity_against_dot_products(spark):
    """The stand-in encoder's score is the dot product of the texts' slot shares."""
    import xxhash

    from stancemill.operators import features

    rows = [("the cat sat on the mat", "cat mat"), ("a b c " * 50, "c d"), ("", "x"), ("x y", ""), (None, "x"), ("x", None), ("Red WINE!", "wine, red")]
    got = spark.createDataFrame(rows, "t string, q string").select(features.similarity(F.col("t"), F.col("q"), F.lit(None)).alias("s")).collect()

    def vector(text):
        words = "".join(c if c.isalnum() and c.isascii() else " " for c in text.lower()).split()
        out = np.zeros(features.DIMENSIONS)
        for w in words:
            out[xxhash.xxh64_intdigest(w.encode(), 42) % features.DIMENSIONS] += 1
        return out / max(1, len(words))

    assert [r["s"] for r in got] == [None if t is None or q is None else pytest.approx(float(vector(t) @ vector(q))) for t, q in rows]

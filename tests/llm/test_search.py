"""Licence scans, ranked search and collocations against brute force, with nulls, ties, repeats, empty tables, long texts and clashing columns."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stancemill.llm import collocations, licences, search, wordscan

DOCS = "doc_id long, text string, lang string, source string, h string, rank int, item_id long, term string, w string, phrase string, shard int"
CLASS = "[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def docs_of(spark, rows):
    """documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, "s", "x", 7, 8, "y", "z", "p", 9) for i, t, lang in rows], DOCS)


@settings(deadline=None)
@given(st.lists(st.none() | st.text(alphabet="aAÉz_.\n \t09-", max_size=12), max_size=8))
def test_scan(texts):
    column = pa.array([None if t is None else t.encode() for t in texts], pa.binary())
    for limit in (1, 7, 100):
        got, rows = [], []
        for start, part in wordscan.runs(column, limit):
            w = wordscan.scan(part, collocations.SEPARATORS, collocations.BREAKS)
            got += [x.decode() for x in w.words.to_pylist()]
            rows += (w.rows + start).tolist()
            pieces = [(r, w.pieces[i]) for i, r in enumerate(w.rows.tolist())]
            assert len({p for _, p in pieces}) == len(set(pieces))
        expected = [(i, x) for i, t in enumerate(texts) for x in re.findall("[^.,;:!?\n\x0b\x0c\r \t]+", low(t))]
        assert list(zip(rows, got)) == expected


# Licences


def brute_base(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(text))
    starts = {p: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()] for p in licences.BASE}
    every = sorted(i for s in starts.values() for i in s)
    return len(words), len(every), every[0] if every else None, every[-1] if every else None, ",".join(sorted({licences.BASE[p] for p, s in starts.items() if s}))


def test_licences_against_brute_force(spark):
    rng = random.Random(3)
    parts = "gnu general public license apache MIT License cc-by CC by nc _ . the \n é É".split(" ")
    rows = [(k, " ".join(rng.choice(parts) for _ in range(rng.randrange(40))), "en") for k in range(300)]
    rows += [(None, "cc by", None), (1, "cc by", "en"), (1, "cc by", "en"), (500, None, "en"), (501, "", "en"), (502, "...", "en"), (503, "mit license " * 20000, "en")]
    got = sorted((repr(tuple(r)[:6]) for r in licences.licences(docs_of(spark, rows)).collect()))
    assert got == sorted(repr((i, *brute_base(t))) for i, t, _ in rows)
    empty = licences.licences(docs_of(spark, []))
    assert empty.count() == 0


def test_notices(spark):
    rng = random.Random(4)
    filler = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    mit = dict((name, text) for name, text, _ in licences.NOTICES)["mit"]
    changed = mit.replace("associated", "accompanying").replace("a copy of this", "one single copy of this")
    bsd = dict((name, text) for name, text, _ in licences.NOTICES)["bsd"]
    rows = [
        (0, f"{filler(50)} {mit.capitalize()}. {filler(30)}", "en"),
        (1, f"{filler(5)} {changed} {filler(5)}", "en"),
        (2, f"{bsd}\n{mit}", "en"),
        (3, " ".join(rng.sample(mit.split(), len(mit.split()))), "en"),  # all words, no order
        (4, mit.replace("hereby granted free", "now granted free"), "en"),  # a key phrase is gone
        (5, "released under the Mozilla Public License. SPDX-License-Identifier: MIT", "en"),
        (6, "Licensed under CC BY-NC 4.0.", "en"),
        (7, " ".join(mit.split()[:20]), "en"),  # less than SHARE of it
        *((k, filler(60), "en") for k in range(10, 40)),
    ]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licences.licences(docs_of(spark, rows)).collect()}
    assert got[0] == ("mit", 1.0) and got[1][0] == "mit" and licences.SHARE <= got[1][1] <= 1
    assert got[2] == ("bsd,mit", 1.0) and got[3] == ("", 0.0) and got[4] == ("", 0.0)
    assert got[5] == ("mit,mpl", 1.0) and got[6] == ("cc-by,cc-by-nc", 1.0) and got[7] == ("", 0.0)
    assert all(got[k] == ("", 0.0) for k in range(10, 40))


# Ranked search


@settings(deadline=None)
@given(st.lists(st.integers(0, 2**63 - 1) | st.integers(0, 300), max_size=50))
def test_packed(values):
    assert search.unpacked(search.packed(np.array(values, np.int64))).tolist() == values


@settings(deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=30), st.integers(0, 3))
def test_packed_documents(ids, nulls):
    ids = np.array(sorted(ids), np.int64)
    words = np.arange(len(ids) + nulls) * 1000 + 1
    got = search.unpacked_documents(search.packed_documents(np.concatenate((ids, np.zeros(nulls, np.int64))), nulls, words))
    assert got[0][: len(ids)].tolist() == ids.tolist() and got[1] == nulls and got[2].tolist() == words.tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 60), st.integers(0, 5), max_size=30), max_size=6), st.integers(1, 5), st.integers(1, 20))
def test_merged(lists, k, step):
    columns = [(np.array(sorted(x), np.int64), np.array([x[d] for d in sorted(x)], np.int64)) for x in lists]
    sums = Counter()
    for x in lists:
        sums.update(x)
    expected = sorted(((s, d) for d, s in sums.items() if s > 0), key=lambda x: (-x[0], x[1]))[:k]
    assert search.merged(columns, k, step) == expected


def brute_search(rows, items, k=10):
    split = [(i, re.findall(CLASS, low(t))) for i, t, _ in rows]
    held = [(i, Counter(w), len(w)) for i, w in split if w]
    n_docs, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for at, (i, c, n) in enumerate(held):
            m = 100 - 90 + (90 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(re.findall(CLASS, low(text))) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, at))
        out += [(item, r, None if no else i, -s) for r, (s, no, i, _) in enumerate(sorted(found)[:k], 1)]
    return out


@pytest.mark.parametrize("shard_bytes", [300, 1 << 20])
def test_ranked_search(spark, shard_bytes, monkeypatch):
    monkeypatch.setattr(search, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(search, "BLOCK_TERMS", 25)  # several blocks of queries
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(["the", "The_of", "é1", *(f"W{min(rng.randrange(60), rng.randrange(60))}" for _ in range(6))]) for _ in range(n))
    rows = [(k % 150 - 5, text(rng.randrange(60)), "en") for k in range(200)] + [(None, text(30), "en"), (None, "rare Rare", "en"), (900, None, "en"), (901, "", "en"), (902, "--", "en"), (903, text(20000), "en"), (904, "rare rare", "en"), (12, "rare rare", "en")]
    items = [(k, text(rng.randrange(1, 12))) for k in range(12)] + [(None, "rare"), (3, "RARE rare"), (50, None), (51, "nowhere"), (52, "")]
    queries = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, doc_id int, shard string")
    path = search.shared_path(spark, "index")
    index = search.build_index(docs_of(spark, rows).repartition(3), path, shard_bytes=shard_bytes)
    got = [tuple(r) for r in search.search(index, queries).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute_search(rows, items)))
    assert search.search(index, queries.limit(0)).count() == 0
    empty = search.ranked_search(docs_of(spark, []), queries)
    assert empty.count() == 0 and empty.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_length_factors_beyond_64_bits():
    words = np.array([1, 10**7, 10**12], np.int64)
    assert search.length_factors(words, 10**12, 10**15).tolist() == [10 + 90 * n * 10**12 // 10**15 for n in words.tolist()]


# Collocations


def brute_collocations(rows, longest, least, top):
    out = []
    counts, n = {}, Counter()
    for _, t, lang in rows:
        c = counts.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", low(t)):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            c.update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    for lang, c in counts.items():
        chosen = {g: f for g, f in c.items() if len(g) > 1 and f >= least}
        inner = Counter()
        for g, f in chosen.items():
            for m in range(2, len(g)):
                for i in range(len(g) - m + 1):
                    inner[g[i : i + m]] = max(inner[g[i : i + m]], f)
        found = []
        for g, a in chosen.items():
            if inner[g] < a:
                score, _, l, r = min((1000 * a * n[lang] // (c[g[:j]] * c[g[j:]]), j, c[g[:j]], c[g[j:]]) for j in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), l, r))
        out += [(lang, k, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return out


@pytest.mark.parametrize("run_bytes, top", [(8 << 20, 2000), (200, 7)])
def test_collocations(spark, run_bytes, top, monkeypatch):
    rng = random.Random(9)
    word = lambda: rng.choice(["a", "B", "é", "x-y", "\x01", "w1", "w2", "w3", "q"])
    text = lambda n: "".join(word() + rng.choice([" ", " ", "  ", "\t", ". ", "\n"]) for _ in range(n))
    rows = [(k, text(rng.randrange(80)), rng.choice(["en", "en", "fr", None])) for k in range(120)]
    rows += [(None, "new york city " * 30, "en"), (5, None, "en"), (6, "", "xx"), (7, "...", None), (8, "one two", "one"), (9, text(30000), "en")] + [(10, "alpha beta gamma delta epsilon zeta", "de")] * 40
    monkeypatch.setattr(collocations, "RUN_BYTES", run_bytes)
    got = [tuple(r) for r in collocations.collocations(docs_of(spark, rows), least=5, top=top).collect()]
    assert sorted(got) == sorted(brute_collocations(rows, 5, 5, top))


def test_collocations_of_nothing(spark):
    assert collocations.collocations(docs_of(spark, [])).count() == 0
    assert collocations.collocations(docs_of(spark, [(1, "few words here", "en"), (2, None, None)])).count() == 0


def test_scores_beyond_64_bits(spark):
    level = lambda rows: spark.createDataFrame(rows, "lang string, phrase string, n long, h long")
    n, l, r, a = 9 * 10**15, 4 * 10**12, 10**13 + 1, 10**12 + 7
    tables = [level([("en", None, n, 0), ("en", "x", l, 1), ("en", "y", r, 2)]), level([("en", "x y", a, 3)]), level([]), level([]), level([])]
    assert [tuple(x) for x in collocations.scored(tables).collect()] == [("en", "x y", a, l, r, n, 1000 * a * n // (l * r))]


def test_full_bitmap_loses_nothing(spark, monkeypatch):
    """With one bit for many phrases each is counted, and the counts decide."""
    monkeypatch.setattr(collocations, "MOST_BITS", 64)
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice("abcdefgh") for _ in range(60)), "en") for k in range(60)]
    got = [tuple(r) for r in collocations.collocations(docs_of(spark, rows), least=4).collect()]
    assert sorted(got) == sorted(brute_collocations(rows, 5, 4, 2000))

"""The operators against brute force, round trips and held-out accuracy, with nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import time
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stancemill.llm import components, decontam, embeddings, html, labelled_pages, lines, neardup, packing, quality, sharding, tokencount, tokens, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h1 string, id string, key string, row string"


def words(rng, n, vocabulary=3000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def table(spark, rows):
    """documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, None, "x", "y", "z", "r") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    base = [words(rng, 120) for _ in range(30)]
    out = [(k, t, f"s{k % 3}") for k, t in enumerate(base)]
    for k in range(30):  # near copies: some words changed
        w = base[k % 6].split()
        for _ in range(rng.choice((1, 2, 6, 20))):
            w[rng.randrange(len(w))] = f"n{rng.random()}"
        out.append((100 + k, " ".join(w), "hot"))
    out += [(200 + k, base[0], "hot") for k in range(5)]
    return [*out, (None, base[1], None), (300, None, None), (301, "", "s1"), (302, "  \n ", "s1"), (303, "one two", "s1"), (303, "one two", "s1"), (304, words(rng, 30000), "s2")]


def union_find(n, links):
    root = list(range(n))
    find = lambda k: k if root[k] == k else find(root[k])
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(k) for k in range(n)]


def brute_jp(a, b):
    common = set(a) & set(b)
    every = set(a) | set(b)
    return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in every) for i in common)


def grams(text):
    w = (text or "").lower().split()
    out = {}
    for k in range(max(1, len(w) - 4) if w else 0):
        g = tuple(w[k : k + 5])
        out[g] = out.get(g, 0) + 1
    return out


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 440)]
    want = union_find(500, links)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: want[k] for a, b in links if a != b for k in (a, b)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(0, 12), st.integers(1, 4), min_size=1), st.dictionaries(st.integers(0, 12), st.integers(1, 4), min_size=1))
def test_prob_jaccard(a, b):
    pack = lambda d: (np.array(sorted(d), np.uint64), np.array([d[k] for k in sorted(d)]))
    assert neardup.prob_jaccard(pack(a), pack(b)) == pytest.approx(brute_jp(a, b))


def test_prob_minhash_estimates():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 1 << 63, 260, dtype=np.uint64)
    sets = [(np.sort(h[:200]), rng.integers(1, 4, 200)), (np.sort(h[30:230]), rng.integers(1, 4, 200)), (np.sort(h[:3]), np.ones(3, int))]
    flat = [np.concatenate(x) for x in zip(*sets)]
    sig = neardup.prob_minhash(*flat, np.array([0, 200, 400, 403]), registers=4096)
    assert (sig[0] == sig[1]).mean() == pytest.approx(neardup.prob_jaccard(sets[0], sets[1]), abs=0.04)
    assert (sig[2] > 0).all()


def test_near_documents(spark, corpus):
    got = neardup.classes(table(spark, corpus)).collect()
    texts = [t or "" for _, t, _ in corpus]
    g = [grams(t) for t in texts]
    links = [(a, b) for a, b in combinations(range(len(texts)), 2) if texts[a] == texts[b] or (g[a] and g[b] and brute_jp(g[a], g[b]) >= 0.8)]
    root = union_find(len(texts), links)
    ids = [i for i, _, _ in corpus]
    name = {r: min((ids[k] for k in range(len(ids)) if root[k] == r and ids[k] is not None), default=None) for r in set(root)}
    assert sorted(((r["doc_id"], r["class_id"]) for r in got), key=str) == sorted(((i, name[r]) for i, r in zip(ids, root)), key=str)
    one = neardup.one_of_each(table(spark, corpus))
    assert one.columns == table(spark, corpus).columns
    assert sorted((r["doc_id"] for r in one.collect()), key=str) == sorted(set(name.values()), key=str)
    assert neardup.classes(table(spark, [])).count() == 0


def test_near_documents_without_original(spark):
    """Copies that only link through others: each of a chain is similar to the next."""
    rng = random.Random(3)
    w = [f"a{k}" for k in range(100)]
    rows = []
    for k in range(12):
        rows.append((k, " ".join(w), "s"))
        w = list(w)
        w[(k * 7) % 100] = f"b{k}"
        w[rng.randrange(100)] = f"c{k}"
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(table(spark, rows)).collect()}
    g = [grams(t) for _, t, _ in rows]
    want = union_find(12, [(a, b) for a, b in combinations(range(12), 2) if brute_jp(g[a], g[b]) >= 0.8])
    assert got == dict(enumerate(want))


@pytest.mark.parametrize("room", [1, 40, 10_000])
@pytest.mark.parametrize("step", [1, 1 << 40])
def test_shared_keys(spark, monkeypatch, room, step):
    """Every item that shares a band key is a star with one hub of that key, also with ids far apart and slots of a key or two."""
    rng = np.random.default_rng(room)
    bands = rng.integers(0, 400, (120, 3)).astype(np.uint64)
    bands[:50, 1] = 7
    bands[9] = bands[8]
    key = bands << np.uint64(32) | bands
    items = spark.createDataFrame([(i * step, i) for i in range(120)], "id long, at int").repartition(3)
    monkeypatch.setattr(neardup, "SLOT_KEYS", room)
    packed = neardup.scattered(items, lambda b: (b.column("id").to_numpy(), key[b.column("at").to_numpy()]), 3).drop("band")
    parts = 1 << max(0, 120 // room).bit_length()
    batches = sorted(({**r.asDict(), "band": r["slot"] // parts} for r in packed.collect()), key=lambda r: (r["slot"], r["base"]))
    found = [r for b in neardup._stars(iter(pa.RecordBatch.from_pylist(batches[k : k + 3]) for k in range(0, len(batches), 3))) for r in b.to_pylist()]
    held: dict = {}
    for i, row in enumerate(bands.tolist()):
        for b, k in enumerate(row):
            held.setdefault((b, k), set()).add(i * step)
    stars: dict = {}
    for r in found:
        stars.setdefault((r["band"], r["key"] & 0xFFFFFFFF), []).append((r["id"], r["hub"]))
    assert stars.keys() == {k for k, v in held.items() if len(v) > 1}
    for k, v in stars.items():
        assert len({h for _, h in v}) == 1 and len(v) == len(held[k]) - 1
        assert {i for i, _ in v} | {v[0][1]} == held[k]


@pytest.mark.parametrize("strip", [1, 300, 1 << 20])
def test_block_pairs(monkeypatch, strip):
    monkeypatch.setattr(neardup, "STRIP", strip)
    rng = np.random.default_rng(5)
    n = 60
    sig = rng.integers(0, 3, (n, 8)).astype(np.uint16)
    comp, block = rng.integers(0, 12, n), rng.integers(0, 2, n)
    key, two = np.repeat([3, 3, 9], 20), np.repeat([0, 1, 1], 20)
    one = np.repeat([0, 0, 1], 20)
    block[:20], block[40:] = 0, 1
    batch = pa.RecordBatch.from_arrays([*map(pa.array, (key, one, two, block, comp, np.ones(n, int)))], names=["key", "one", "two", "block", "comp", "band"])
    agree, i, j = neardup.block_pairs(batch, sig, 2, 3)
    want = set()
    for a, b in combinations(range(n), 2):
        same = sig[a] == sig[b]
        shared = [k for k in range(4) if same[2 * k : 2 * k + 2].all()]
        placed = a // 20 == b // 20 and (a // 20 != 1 or block[a] != block[b])
        if placed and comp[a] != comp[b] and same.sum() >= 3 and (shared or [0])[0] == 1:
            want.add((int(same.sum()), a, b))
    assert {a // 20 for _, a, _ in want} == {0, 1, 2}
    assert set(zip(agree.tolist(), i.tolist(), j.tolist())) == want


@given(st.text(st.sampled_from("ab \n\t\u00a0\u0130\u03a3\u4e2d\U0001f600"), max_size=30), st.text(st.sampled_from("ab \u4e2d"), max_size=30))
def test_line_shingles(a, b):
    assert lines.normal_lines(a) == [lines.normal(x) for x in a.split("\n")]
    sets = []
    for x in (a, b):
        x = lines.normal(x)
        sets.append({x[k : k + 5] for k in range(max(1, len(x) - 4))})
    assert lines.jaccard(*lines.shingle_sets([lines.normal(a), lines.normal(b)])) == len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_lines(spark):
    rng = random.Random(4)
    base = [words(rng, 20) for _ in range(25)]
    rows = []
    for k in range(40):
        mine = [rng.choice(base), words(rng, 15), "", "Of."]
        if k % 4 == 0:
            mine.append(rng.choice(base).replace("w1", "v1", 1).upper())
        rows.append((k, "\n".join(mine), "s"))
    rows += [(50, None, None), (51, "", "s"), (52, " \n\t", "s"), (None, base[0], "s"), (53, rows[0][1], "s"), (53, rows[0][1], "s")]
    got = lines.dedup_lines(table(spark, rows).withColumn("gone", F.lit(1)))
    assert got.columns == [*table(spark, rows).columns, "gone", "n_lines", "n_removed"]
    places, sets = [], []
    for i, t, _ in rows:
        for n, x in enumerate((t or "").split("\n")):
            if x := lines.normal(x):
                places.append(((i is not None, i or 0), n, t))
                sets.append({x[k : k + 5] for k in range(max(1, len(x) - 4))})
    links = [(a, b) for a, b in combinations(range(len(sets)), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    root = union_find(len(sets), links)
    first = {}
    for k, r in enumerate(root):
        first[r] = min(first.get(r, places[k]), places[k])
    kept = {places[k] for k, r in enumerate(root) if places[k] == first[r]}
    want = []
    for i, t, _ in rows:
        key = (i is not None, i or 0)
        want.append((i, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if not lines.normal(x) or (key, n, t) in kept)))
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(want, key=str)
    assert lines.dedup_lines(table(spark, [])).count() == 0


@pytest.mark.parametrize("block", [2, 2048])
def test_lines_of_a_hot_bucket(spark, monkeypatch, block):
    """One group of near copies that holds most lines, exact copies in other batches, repeated ids, and strangers in its buckets."""
    monkeypatch.setattr(lines, "BLOCK", block)
    rng = random.Random(12)
    stem = words(rng, 30)
    rows = [(k, f"{stem} {rng.randrange(40)}\n{words(rng, 12, 40)}", "s") for k in range(150)]
    rows += [(k % 5, f"{stem} x{k % 3}", "s") for k in range(40)]
    got = lines.dedup_lines(table(spark, rows).repartition(5)).select("doc_id", "text").collect()
    places, sets = [], []
    for i, t, _ in rows:
        for n, x in enumerate(t.split("\n")):
            places.append((i, n, t))
            x = lines.normal(x)
            sets.append({x[k : k + 5] for k in range(len(x) - 4)})
    root = union_find(len(sets), [(a, b) for a, b in combinations(range(len(sets)), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8])
    assert Counter(root).most_common(1)[0][1] > 150
    hashes = {r["text"]: (r["h1"], r["h2"]) for r in spark.createDataFrame([(t,) for t in {t for _, t, _ in rows}], "text string").select("text", *neardup.text_hashes()).collect()}
    order = lambda p: (p[0], p[1], *hashes[p[2]])
    first: dict = {}
    for k, r in enumerate(root):
        first[r] = min(first.get(r, places[k]), places[k], key=order)
    kept = set(first.values())
    want = [(i, "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n, t) in kept)) for i, t, _ in rows]
    assert sorted(map(tuple, got)) == sorted(want)


def test_lines_at_the_threshold(spark):
    """Isolated pairs of lines whose similarity is exactly 0.8: 40 of 50 shingles are common."""
    rng = random.Random(10)
    draw = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    pairs = [(c + draw(5), c + draw(5)) for c in (draw(44) for _ in range(3000))]
    sig = lines.minhash([x for p in pairs for x in p])
    assert (neardup.signatures_of(pa.array([x.tobytes() for x in neardup.packed_ten(sig)]), lines.REGISTERS, neardup.TEN_BITS) == sig).all()
    got = lines.dedup_lines(table(spark, [(k, "\n".join(p), "s") for k, p in enumerate(pairs)])).agg(F.sum("n_removed")).first()[0]
    assert 0.998 * len(pairs) <= got <= len(pairs)


def test_sharding(spark, corpus, tmp_path):
    got = sharding.shard(table(spark, corpus), map_path=f"{tmp_path}/m").collect()
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in corpus)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    for s in range(8):
        places = sorted(r["slot"] for r in got if r["shard"] == s)
        assert places == list(range(len(places)))
    home = {}
    assert all(home.setdefault(r["virtual_slot"], r["shard"]) == r["shard"] for r in got)
    assert sharding.shard(table(spark, [])).count() == 0
    even = sharding.shard(spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text")), map_path=f"{tmp_path}/e")
    sizes = [r["b"] for r in even.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 97
    old = {r["virtual_slot"]: r["shard"] for r in sharding.load_map(spark, f"{tmp_path}/e", 1).collect()}
    bytes_of = sharding.load_map(spark, f"{tmp_path}/e").select("virtual_slot", "bytes")
    new = {r["virtual_slot"]: r["shard"] for r in sharding.rebalanced(spark, f"{tmp_path}/e", bytes_of, 9).collect()}
    size = {r["virtual_slot"]: r["bytes"] for r in bytes_of.collect()}
    moved = {k: size[k] for k in new if new[k] != old[k]}
    total, to_new = sum(size.values()), sum(size[k] for k in new if new[k] == 8)
    assert abs(to_new - total / 9) <= 97 and sum(moved.values()) <= 1.1 * to_new


def test_encoder():
    path = public_tokenizers.path("byte_bpe_50k.json")
    slow, fast = Tokenizer.from_file(path), tokens.encoder(path)
    for t in ["", " ", "Hello  world\n\n x", "naïve “é” ﬁ   　", "<|endoftext|> a", "a" * 3000, "👩‍👩‍👧 \x00\x1f", "don't 12,345.67 ??!!", "\r\n\t  ", "Ααβ 中文字 かな"]:
        assert list(fast(t)) == slow.encode(t, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_encoder_any(t):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = t.encode("utf-8", "ignore").decode()
    assert list(tokens.encoder(path)(t)) == Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids if t else True


@pytest.mark.parametrize("shares", [None, {"hot": 0.5}])
def test_packing(spark, corpus, shares):
    got = packing.pack(table(spark, corpus), shares=shares).collect()
    enc = tokens.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [np.array([*enc(t or ""), 0], "<u4") for _, t, _ in corpus]
    total = sum(map(len, ids))
    spans = {}
    for r in got:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(spans) == list(range(-(-total // 1024)))
    for s, parts in spans.items():
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at == 1024 or s == max(spans)
    crcs = {}
    for i, x in zip([i for i, _, _ in corpus], ids):
        crcs.setdefault(i, []).append(x)
    for i, own in crcs.items():
        mine = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got if r["doc_id"] == i)
        assert sum(n for _, n, _, _ in mine) == sum(map(len, own))
        for a, n, c, d in mine:
            assert any(len(x) == d and zlib.crc32(x[a : a + n].tobytes()) == c for x in own)
    if shares is None:  # every full window is close to the sources' shares of all tokens
        share = {}
        for (_, _, s), x in zip(corpus, ids):
            share[s] = share.get(s, 0) + len(x) / total
        for s in share:
            for w in list(spans)[:-1]:
                have = sum(r["length"] for r in got if r["sequence_id"] == w and r["source"] == s)
                assert abs(have - 1024 * share[s]) <= 2 * packing.PACKET * len(share)
    assert packing.pack(table(spark, [])).count() == 0


@pytest.mark.parametrize(("most", "shares"), [(1024, None), (1024, {"7": 0.25, None: 0.125}), (9, None)])
def test_packing_of_many_sources(spark, monkeypatch, most, shares):
    """More sources than a round-robin has queues; shares go by source, also by one whose name is a number."""
    monkeypatch.setattr(packing, "MAX_QUEUES", most)
    rng = random.Random(11)
    rows = [(k, words(rng, 60), str(k)) for k in range(1100)] + [(2000 + k, words(rng, 900), ("big", "7", None)[k % 3]) for k in range(90)]
    rng.shuffle(rows)
    got = packing.pack(table(spark, rows), shares=shares).collect()
    total = sum(r["length"] for r in got)
    assert sorted(r["sequence_id"] * 1024 + r["offset"] for r in got) == sorted({r["sequence_id"] * 1024 + r["offset"] for r in got})
    at = 0
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["sequence_id"] * 1024 + r["offset"] == at
        at += r["length"]
    enc = tokens.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*enc(t), 0], "<u4") for i, t, _ in rows}
    assert total == sum(map(len, ids.values()))
    assert all(zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in got)
    share = {s: sum(r["length"] for r in got if r["source"] == s) / total for s in ("big", "7", None)}
    if shares:
        share = {**shares, "big": (1 - sum(shares.values())) * share["big"] / (1 - share["7"] - share[None])}
    for s in share:
        for w in range(40):
            assert abs(sum(r["length"] for r in got if r["sequence_id"] == w and r["source"] == s) - 1024 * share[s]) <= 4 * packing.PACKET


def test_token_counts(spark, corpus, tmp_path):
    got = tokencount.document_tokens(table(spark, corpus)).collect()
    enc = tokens.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in got), key=str) == sorted(((i, len(enc(t or ""))) for i, t, _ in corpus), key=str)
    rng = random.Random(6)
    for end in (True, False):
        lengths = [rng.choice((0, 0, 1, 5, 90)) for _ in range(200)] + [7]
        ids = [x for n in lengths for x in [3] * n + [9]]
        ids = ids if end else ids[:-1]
        (tmp_path / "f.bin").write_bytes(np.array(ids, "<u2").tobytes())
        files = spark.createDataFrame([(f"{tmp_path}/f.bin", len(ids) * 2)], "file string, bytes long")
        for block in (1, 7, 64, 1 << 20):
            found = sorted((r["ordinal"], r["n_tokens"], r["ended"]) for r in tokencount.count_tokens(files, str(tmp_path), 9, 2, block).collect())
            assert found == [(k, n, end or k < len(lengths) - 1) for k, n in enumerate(lengths)]
    assert tokencount.document_tokens(table(spark, [])).count() == 0


def test_token_counts_of_special_strings(spark):
    """Texts with the string of the end-of-text token, whose id counts like any other."""
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>c", "plain", None]
    got = tokencount.document_tokens(table(spark, [(k, t, "s") for k, t in enumerate(texts)])).collect()
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {k: len(slow.encode(t or "", add_special_tokens=False).ids) for k, t in enumerate(texts)}
    with pytest.raises(Exception, match="end id"):
        tokencount.write_tokens(table(spark, [(0, texts[0], "s")]), tokencount.shared_path(spark, "tokens"), end=50256)


def test_quality(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.resampled(docs, labels).cache()
    ratios = quality.log_ratios(docs, labels)
    rows = docs.select("doc_id", "text").collect()
    weight, key = quality.keys_of(pa.array([r[0] for r in rows], pa.int64()), [r[1] for r in rows], ratios)
    k = round(quality.good_share(labels) * len(rows))
    least = np.sort(key)[::-1][min(k, len(key)) - 1]
    assert {r["doc_id"] for r in got.collect() if r["kept"]} == {r[0] for r, x in zip(rows, key) if x >= least}
    both = got.join(labels, "doc_id")
    assert both.filter("quality = 1 and kept").count() >= 0.95 * both.filter("quality = 1").count()
    odd = table(spark, [(None, None, None), (1, "", "s"), (1, "", "s"), (2, "a b " * 9000, "s")])
    assert quality.resampled(odd, labels.limit(0)).filter("kept").count() == 4
    assert quality.keep_good(odd, labels.limit(0)).columns == odd.columns
    assert quality.resampled(odd.limit(0), labels).count() == 0
    text = "some words here and there again"
    b, bounds = quality.features([text, "", "x"])
    assert list(np.diff(bounds)) == [6 + 5, 0, 1]


def test_quality_model(spark):
    """Ratios and weights from counters of words and pairs; only the bucket of a word or pair comes from the library."""
    rng = random.Random(6)
    rows = [(k, words(rng, rng.randrange(0, 40), 60) if k else None, "s") for k in range(50)] + [(7, "w1 w2", "s"), (None, "w3 w3 w3", "s")]
    marks = spark.createDataFrame([(k, k % 2, k % 7 == 0 if k % 3 else None) for k in range(60)] + [(None, 1, False)], "doc_id long, quality int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))
    bucket = lambda *w: int(quality.features([" ".join(w)])[0][-1])
    grams = lambda t: [bucket(w) for w in (t or "").split()] + [bucket(*p) for p in zip((t or "").split(), (t or "").split()[1:])]
    raw = Counter(b for _, t, _ in rows for b in grams(t))
    good = {k for k in range(60) if k % 2 == 1 and (k % 3 == 0 or k % 7)}
    target = Counter(b for i, t, _ in rows if i in good for b in grams(t))
    n, m, size = sum(raw.values()), sum(target.values()), quality.BUCKETS
    base = lambda b: (raw[b] + 1) / (n + size)
    ratio = lambda b: np.log((target[b] + size * base(b)) / (m + size)) - np.log(base(b))
    got = quality.resampled(table(spark, rows), marks).collect()
    mean = lambda t: sum(map(ratio, grams(t))) * quality.CHUNK / max(1, len(grams(t)))
    weights = sorted(((r["doc_id"], r["log_weight"]) for r in got), key=str)
    for (i, w), (j, v) in zip(weights, sorted(((i, mean(t)) for i, t, _ in rows), key=str), strict=True):
        assert i == j
    assert np.allclose(sorted(w for _, w in weights), sorted(mean(t) for _, t, _ in rows))
    noise = np.array([r["key"] - r["log_weight"] for r in got])
    assert len({round(x, 9) for x in noise}) == len({i for i, _, _ in rows}) and -3 < noise.min() < 0 < noise.max() < 12


def test_quality_held_out(spark):
    """Labels of odd ids fit; those of even ids tell how many good and bad documents stay."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality.resampled(docs, labels.filter("doc_id % 2 = 1")).join(labels.filter("doc_id % 2 = 0"), "doc_id")
    kept = {(r["quality"], r["kept"]): r["n"] for r in got.filter("coalesce(toxic, 0) = 0").groupBy("quality", "kept").agg(F.count("*").alias("n")).collect()}
    assert kept[1, True] >= 0.97 * (kept[1, True] + kept.get((1, False), 0))
    assert kept.get((0, True), 0) <= 0.7 * (kept.get((0, True), 0) + kept[0, False])


def test_kth_largest(spark):
    v = [((k * 7919) % 10007) / 7 for k in range(9000)] + [5.0] * 6000
    df = spark.createDataFrame([(x,) for x in v], "x double")
    for k in (1, 2, 4999, 9000, 14999):
        assert quality.kth_largest(df, "x", k) == sorted(v, reverse=True)[k - 1]


def test_masks_are_lossless():
    for lost in combinations(range(decontam.WINDOW), decontam.SUBSTITUTIONS):
        assert any(all(o + p not in lost for p in m) for m in decontam.MASKS for o in range(decontam.WINDOW - decontam.SPAN + 1))


def test_decontamination(spark):
    rng = random.Random(7)
    items = [(k, words(rng, n, 400)) for k, n in enumerate((30, 20, 13, 14, 9, 3, 1, 25))] + [(8, None), (9, "?!"), (10, words(rng, 40, 400))]
    rows = []
    for k in range(60):
        text = words(rng, 60, 400).split()
        if k % 3:
            part = (items[rng.randrange(8)][1]).upper().split()
            part = part[rng.randrange(3) :] if k % 2 else part
            for _ in range(rng.randrange(4)):
                if part:
                    part[rng.randrange(len(part))] = "changed"
            at = rng.randrange(60)
            text[at:at] = [f"«{p}»," for p in part]
        rows.append((k, " ".join(text), "s"))
    rows += [(70, None, "s"), (71, "", "s"), (None, items[0][1], "s"), (0, rows[0][1], "s"), (1, items[1][1], "s")]
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, words string")
    got = decontam.overlaps(table(spark, rows), bench).collect()
    clean = lambda t: [w for w in __import__("re").split(r"[^\w]+|_", (t or "").lower()) if w]
    want = set()
    for i, t, _ in rows:
        d = clean(t)
        for j, q in items:
            q = clean(q)
            n = min(13, len(q))
            need = n - 2 if n == 13 else n
            if n and any(sum(d[a + x] == q[b + x] for x in range(n)) >= need for a in range(len(d) - n + 1) for b in range(len(q) - n + 1)):
                want.add((i, j, zlib.crc32((t or "").encode())))
    texts = {}
    for i, t, _ in rows:
        texts.setdefault(i, []).append(t)
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, j) for i, j, _ in want}
    assert len(got) == len(want)
    left = decontam.clean(table(spark, rows), bench)
    dirty = {(i, c) for i, _, c in want}
    assert left.columns == table(spark, rows).columns
    assert sorted((r["doc_id"] for r in left.collect()), key=str) == sorted((i for i, t, _ in rows if (i, zlib.crc32((t or "").encode())) not in dirty), key=str)
    assert decontam.overlaps(table(spark, []), bench).count() == 0 and decontam.overlaps(table(spark, rows), bench.limit(0)).count() == 0


def test_decontamination_of_short_items(spark):
    """Items of 8 to 12 words with each single word substituted overlap; with two, or of 7 words with one, they do not."""
    for lost in range(decontam.SPAN):
        assert any(lost not in m for m in decontam.SHORT_MASKS)
    items = [(n, " ".join(f"q{n}x{k}" for k in range(n))) for n in range(7, 13)]
    rows, want = [], set()
    for n, q in items:
        for lost in [(), *combinations(range(n), 1), *combinations(range(n), 2)]:
            rows.append((len(rows), " ".join(["a", "b", *("changed" if k in lost else w for k, w in enumerate(q.split())), "c"]), "s"))
            if len(lost) <= (n >= 8):
                want.add((rows[-1][0], n, n, 2))
    got = decontam.overlaps(table(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["overlap_words"], r["doc_start"]) for r in got) == sorted(want)


def test_embeddings(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 16))
    vectors = [(k, (base[k % 40] + rng.normal(size=16) * rng.choice([0.05, 0.3, 1])).astype(np.float32).tolist(), k % 3) for k in range(150)]
    vectors += [(200 + k, vectors[0][1], 0) for k in range(4)] + [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] * 16, 0), (303, [None] * 16, 0), (304, vectors[0][1], None), (305, [1.0], 0), (306, [], 0), (0, vectors[0][1], 0), (None, vectors[1][1], 1), (307, [float("inf")] * 16, 0)]
    df = spark.createDataFrame([(a, b, c, "x", 1) for a, b, c in vectors], "vec_id long, embedding array<float>, label int, gid string, h1 int")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_embeddings(df).collect()), key=str)
    ok = [v is not None and c is not None and len(v) > 0 and None not in v and bool(np.isfinite(v).all()) and bool(np.any(v)) for _, v, c in vectors]
    x = [np.array(v, np.float32).astype(float) if k else None for (_, v, _), k in zip(vectors, ok)]
    links = [(a, b) for a, b in combinations(range(len(x)), 2) if ok[a] and ok[b] and vectors[a][2] == vectors[b][2] and len(x[a]) == len(x[b]) and x[a] @ x[b] / np.linalg.norm(x[a]) / np.linalg.norm(x[b]) >= 0.93]
    root, n = union_find(len(x), links), [0] * len(x)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    name = {r: min((vectors[k][0] for k in range(len(x)) if root[k] == r and vectors[k][0] is not None), default=None) for r in set(root)}
    want = sorted(((v[0], n[k], name[root[k]], v[0] == name[root[k]] if name[root[k]] is not None and v[0] is not None else name[root[k]] is None) for k, v in enumerate(vectors)), key=str)
    assert got == want and links
    assert embeddings.near_embeddings(df.limit(0)).count() == 0


def test_embeddings_of_any_size(spark):
    """Squares that leave a double's range, and several blocks of one label."""
    rows = [(1, [3e200, 4e200], 0), (2, [3e-200, 4e-200], 0), (3, [-3.0, -4.0], 0), (4, [5e-324, 0.0], 0), (5, [1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_embeddings(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (1, 4), 5: (1, 4)}


@pytest.mark.parametrize("block", [3, 2048])
def test_embedding_tiles(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=8) + rng.normal(size=(7, 8)) * 0.3 for _ in range(4)]).astype(np.float32).astype(float)
    df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    cos = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_embeddings(df).collect()}
    assert got == {k: int((cos[k] >= 0.93).sum()) - 1 for k in range(len(x))}


def test_embedding_bounds():
    """No product of decoded vectors lies farther from the cosine than its bound, and the bounds settle most pairs."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 64)) * np.exp(rng.normal(size=(300, 64)) * 2)
    x /= np.linalg.norm(x, axis=1)[:, None]
    q = embeddings.quantised(x)
    middle, error = embeddings.bounds(q, q)
    assert (np.abs(middle - x @ x.T) <= error).all() and (np.abs(middle - 0.93) > error).mean() > 0.95


def test_warc(spark, tmp_path):
    big = "<p>ä" + "x" * 200
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, None), (4, "http://a/ b\r\nX: y", ""), (5, "u", "short"), (6, "u", "short"), (None, "u", big), (7, "http://a/7", "y" * 300000), (1, "http://a/1", big), (8, "u", "WARC/1.1\r\n\r\n" * 20)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.page_round_trip(df, f"{tmp_path}/w").collect()
    want = []
    for i, _, t in rows:
        raw = (t or "").encode()
        revisit = t == big and i != 1
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", 1 if revisit else None))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    warc.register(spark)
    read = spark.read.format("warc").option("rangeBytes", 300)
    assert read.load(f"{tmp_path}/w").filter("warc_type <> 'warcinfo'").count() == len(rows)
    assert read.load(f"{tmp_path}/w").filter("warc_type = 'revisit'").count() == 2
    assert spark.read.format("warc").option("payload", "false").load(f"{tmp_path}/w").filter("payload is not null").count() == 0
    plain = b"".join(warc.record_bytes({"WARC-Type": "resource", "WARC-Record-ID": f"<{k}>", "WARC-Target-URI": f"http://b/{k}"}, b"z" * k) for k in range(50))
    (tmp_path / "p.warc").write_bytes(plain)
    one = spark.read.format("warc").option("rangeBytes", 200).load(f"{tmp_path}/p.warc")
    assert sorted((r["record_id"], len(r["payload"])) for r in one.collect()) == sorted((f"<{k}>", k) for k in range(50))
    assert one.filter("target_uri like 'http://b/1%'").count() == 11
    import gzip

    (tmp_path / "g.warc.gz").write_bytes(b"".join(gzip.compress(warc.record_bytes({"WARC-Type": "resource", "WARC-Record-ID": f"<{k}>"}, b"z" * k)) for k in range(9)))
    assert sorted(len(r["payload"]) for r in spark.read.format("warc").load(f"{tmp_path}/g.warc.gz").collect()) == list(range(9))
    assert warc.page_round_trip(df.limit(0), f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("zipped", [False, True])
def test_damaged_warc(tmp_path, zipped):
    """A record that is cut off or whose head does not end is an error; white space at the end is none."""
    import gzip

    one = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 6\r\n\r\nsome t\r\n\r\n"
    pack = gzip.compress if zipped else bytes

    def read(raw: bytes) -> int:
        path = tmp_path / f"{hashlib.md5(raw).hexdigest()}.warc{'.gz' if zipped else ''}"
        path.write_bytes(raw)
        reader = warc.WarcReader({"path": str(path)})
        return sum(b.num_rows for p in reader.partitions() for b in reader.read(p))

    assert read(pack(one) + pack(one)) == 2
    for bad in (pack(one) + pack(one)[:-9], pack(one) + pack(b"WARC/1.1\r\nWARC-Type: resp") + pack(one)[:0]):
        with pytest.raises(ValueError):
            read(bad)


def test_html_held_out():
    model = html.default_model()
    wrong = total = 0
    for rows, labels in html.labelled(labelled_pages.pages(200, seed=77)):
        wrong += sum(a != b for a, b in zip(model.decode(rows), labels))
        total += len(labels)
    assert wrong <= 0.02 * total


#: Pages written and labelled by hand, of shapes that the generator has in part only.
BY_HAND = [
    ("<html><head><title>x</title><body><p>Some words of a page that has no end of its head.</p>", "Some words of a page that has no end of its head."),
    ("<article><p>First words here.</p><pre>code of it</pre></article>", "First words here.\ncode of it"),
    ("<html><body>Bare text in the body, a sentence or two. And another one.</body></html>", "Bare text in the body, a sentence or two. And another one."),
    ("<body><article><h1>Title</h1><p>Long text of the article goes here, with words.</p></article><div class='responses'><p>I like it.</p><p>Me too, thanks a lot for this!</p></div></body>", "Title\nLong text of the article goes here, with words."),
    ("<article><h1>T</h1><dl><dt>Term</dt><dd>What it means to us all.</dd></dl><figure><figcaption>A caption of the picture.</figcaption></figure></article><footer>end</footer>", "T\nTerm\nWhat it means to us all.\nA caption of the picture."),
    ('<body><nav><a href="/">Home</a><a href="/x">News</a></nav><main><h1>On tea</h1><p>Tea is a drink.</p><table><tr><th>Kind</th><th>Time</th></tr><tr><td>Green</td><td>Two minutes.</td></tr></table></main><aside><p>See also our shop.</p></aside><footer>&copy; 2020 Tea</footer>', "On tea\nTea is a drink.\nKind\nTime\nGreen\nTwo minutes."),
    ('<body><div id="cookie-banner"><p>We use cookies.</p><button>OK</button></div><div class="post"><h2>A walk</h2><p>We went up the hill.<p>It rained, and we came back.</div><form class="search"><label>Find</label><input></form>', "A walk\nWe went up the hill.\nIt rained, and we came back."),
]


def test_html_by_hand():
    model = html.default_model()
    for page, want in BY_HAND:
        assert html.main_text(page, model) == want


def test_html_hostile_pages():
    """A megabyte of what invites repeated scans."""
    model = html.default_model()
    began = time.process_time()
    for page in ('<a "' * 262144, "<a b='" * 170000, "<!" * 500000, "<div>x" * 100000, "<i>" * 150000 + "<div></div>" * 50000, "<script>" * 120000, "</x>" * 200000, "<p" * 400000):
        html.main_text(page, model)
    assert time.process_time() - began < 60
    assert html.main_text("<p>Some words <a \"x>of it</a> here.</p><p>And more of them.</p>", model).endswith("And more of them.")


def test_html_gradient():
    """Training raises the likelihood of the labels, computed here over all labellings."""
    rng = random.Random(4)
    names = [f"f{k}" for k in range(5)]
    pages = [([tuple(rng.sample(names, 2)) for _ in range(5)], None) for _ in range(12)]
    pages = [(rows, [int("f0" in r) if rng.random() < 0.9 else rng.randrange(2) for r in rows]) for rows, _ in pages]

    def likelihood(crf) -> float:
        out = 0.0
        for rows, labels in pages:
            score = lambda y: crf.edges[0][y[0]] + crf.edges[1][y[-1]] + sum(crf.moves[a][b] for a, b in zip(y, y[1:])) + sum(sum(crf.weights[f] for f in r) for r, v in zip(rows, y) if v)  # noqa: B023, E731
            out += score(labels) - np.logaddexp.reduce([score([(k >> t) & 1 for t in range(5)]) for k in range(32)])
        return out

    best = html.train(pages, rounds=3000, penalty=0.0)
    top = likelihood(best)
    assert top > likelihood(html.train(pages, rounds=3, penalty=0.0))
    for f in names:
        for by in (-0.5, 0.5):
            assert likelihood(html.Crf(best.weights | {f: best.weights[f] + by}, np.array(best.moves), np.array(best.edges))) < top


def test_html_viterbi():
    rng = random.Random(9)
    for _ in range(30):
        w = {f"f{k}": rng.gauss(0, 2) for k in range(6)}
        crf = html.Crf(w, np.array([[rng.gauss(0, 1) for _ in "ab"] for _ in "ab"]), np.array([[rng.gauss(0, 1) for _ in "ab"] for _ in "ab"]))
        rows = [tuple(rng.sample(sorted(w), 2)) for _ in range(6)]
        score = lambda y: crf.edges[0][y[0]] + crf.edges[1][y[-1]] + sum(crf.moves[a][b] for a, b in zip(y, y[1:])) + sum(sum(w[f] for f in r) for r, v in zip(rows, y) if v)  # noqa: B023, E731
        assert score(crf.decode(rows)) == pytest.approx(max(score([(k >> t) & 1 for t in range(6)]) for k in range(64)))


def test_html_pages(spark):
    page = '<html><head><title>T</title></head><body><nav><a href="/">Home</a></nav><div class="cookie">We use cookies &amp; more</div><article><h1>A &lt;b&gt; title</h1><p>First <b>bold</b>\n text&nbsp;here.<br>More.<p>Second one, which is long enough to be a text.</p><div class="ad">Buy now!</div><script>var x = "</p>";</script></article><section class="comments"><p>I do not agree with this at all.</p></section><footer>&copy; me</footer>'
    rows = [(1, "u", page), (2, None, None), (None, "v", ""), (1, "u", page), (3, "w", "<" * 500 + '<a "' * 50), (4, "x", "<p>" + "word " * 50000)]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = html.extract(df).collect()
    want = "A <b> title\nFirst bold text here. More.\nSecond one, which is long enough to be a text."
    assert [r["text"] for r in got if r["page_id"] == 1] == [want, want]
    assert all(r["n_chars"] == len(r["text"]) for r in got) and len(got) == 6
    assert {r["text"] for r in got if r["page_id"] in (2, None)} == {""}
    assert html.extract(df.limit(0)).count() == 0

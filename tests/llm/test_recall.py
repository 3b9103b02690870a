"""How many pairs at the threshold op5's bands and signatures let through, and the way without a filter."""

import math
import random

import numpy as np

from stancemill.llm import neardup


def test_recall_at_the_threshold():
    """Of pairs with a probability Jaccard of 0.80 to 0.83, by exact computation, at least 0.995 share a band and pass the filter by signatures."""
    rng = random.Random(6)
    pairs = []
    while len(pairs) < 1500:
        n = rng.randrange(80, 400)
        words = [f"w{rng.randrange(4000)}" for _ in range(n)]
        other = list(words)
        for _ in range(max(1, round(n * rng.uniform(0.012, 0.03)))):
            other[rng.randrange(n)] = f"n{rng.randrange(10**6)}"
        a, b = neardup.shingle_sets([" ".join(words), " ".join(other)])
        if 0.8 <= neardup.prob_jaccard(a, b) <= 0.83:
            pairs.append((" ".join(words), " ".join(other)))
    texts = [t for p in pairs for t in p]
    sig = neardup.prob_minhash(*neardup.weighted_shingles(texts))
    keys = neardup.band_keys(sig, neardup.ROWS)
    share = (keys[::2] == keys[1::2]).any(axis=1)
    agree = (sig[::2] == sig[1::2]).sum(axis=1) >= neardup.least_agreement(neardup.REGISTERS, 0.8)
    found = (share & agree).mean()
    print(f"recall {found:.4f}, of bands alone {share.mean():.4f}")
    assert found >= 0.995 and share.mean() >= 0.998


def test_no_filter(spark):
    assert neardup.least_agreement(64, 0.8, math.inf) == 0 and neardup.least_agreement(64, 0.8) == 38
    rng = random.Random(7)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    rows = [(0, " ".join(base))]
    for k in range(1, 25):
        some = list(base)
        some[rng.randrange(120)] = f"n{k}"
        if k % 2:
            some[rng.randrange(120)] = f"m{k}"
        rows.append((k, " ".join(some)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = neardup.shingle_sets([t for _, t in rows])
    root = list(range(25))
    for i in range(25):
        for j in range(i):
            if neardup.prob_jaccard(sets[i], sets[j]) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs, spread=math.inf).collect()}
    assert got == dict(enumerate(root))

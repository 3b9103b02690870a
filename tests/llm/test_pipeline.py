"""The pipeline's stages one after another, each on its own input."""

import random
from collections import Counter

import corpus_pipeline
from stancemill.llm import registry


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, n = docs.dtypes, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.dtypes == columns, name
        assert 0 < docs.count() <= n
        n = docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}


def test_empty(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES if n.startswith("op")) == list(range(1, 14)) and "pipeline" in registry.QUERIES


def test_planted_and_hostile_rows_end_to_end(spark, tmp_path):
    """Copies, near copies, a benchmark passage, repeated, null, empty and hostile rows through all stages, against what is left by hand."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    words = {k: [word() for _ in range(90)] for k in range(24)}
    lined = lambda w, n: "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))
    passage = [word() for _ in range(20)]
    rows = [(k, lined(words[k], 10), "s") for k in range(20)]
    rows += [(5, lined(words[5], 10), "s")] * 3  # repeated rows
    rows += [(100, lined(words[0], 10), "hot")] * 40 + [(101 + k, lined(words[0], 10), "hot") for k in range(40)]  # exact copies: their lines repeat
    rows += [(200, lined([*words[1][:44], "changed", *words[1][45:]], 10), "s")]  # one word changed
    rows += [(201, lined(words[2], 7), "s")]  # other lines, the same words
    rows += [(202, lined([*words[20][:30], *passage, *words[20][30:]], 10), "s")]  # holds a benchmark item
    rows += [(300, None, None), (301, "", "s"), (302, " \n\t ", "s"), (None, lined(words[21], 10), "s"), (303, "a " * 30000, "s"), (304, "\x00\x01 " + lined(words[22], 9), "s"), (305, "😀" * 50, "s")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, h1 string, item_id string"
    spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x", "y", "z") for i, t, s in rows], schema).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(passage))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = {r["doc_id"] for r in pieces}
    # Null and empty texts are one class, of which the smallest id stays. Of 200 the changed line stays, whose shingles agree to 64 of 86.
    assert left == {*range(20), None, 200, 300, 302, 303, 304, 305}
    spans = {}
    for r in pieces:
        spans.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    for mine in spans.values():
        at = 0
        for start, length, total in sorted(mine):
            assert start == at
            at += length
        assert at == total
    used = Counter()
    for r in pieces:
        used[r["sequence_id"]] += r["length"]
    assert all(n == 1024 for n in sorted(used.values())[1:]) and sorted(used) == list(range(len(used)))

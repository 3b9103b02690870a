"""Phrase collocation mining by Apriori passes over the level of one word more.

Pass k reads the texts and counts a phrase of k words only where both of its phrases of k - 1 words are
frequent. The frequent phrases of a level go to the tasks as a bitmap of their hashes, whose size is bounded:
where several share a bit, a phrase is counted that its count then drops, and none is lost. Scores and the
removal of parts of longer phrases are joins over the level tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stancemill.llm.common import GOLDEN, dropped, mix, staged
from stancemill.llm.wordscan import byte_class, runs, scan

LONGEST = 5
LEAST = 100
TOP = 2000
#: What separates words, and which of it ends a piece.
BREAKS = byte_class((0x0A, 0x0D), *((ord(c), ord(c)) for c in ".,;:!?"))
SEPARATORS = BREAKS | byte_class((0x20, 0x20), (0x09, 0x09))
#: Bytes of text that are counted at once before their counts go to Spark; a longer text is counted at once.
RUN_BYTES = 8 << 20
#: Bits for each frequent phrase in the bitmap, and the most bits that it has.
BITS_EACH, MOST_BITS = 16, 1 << 27
#: Groups of a language's phrases that are ranked on their own before the language is.
RANK_PARTS = 64
COUNTED = "lang string, phrase binary, n long"
LEVEL = "lang string, phrase string, n long, h long"


def _hashes(values: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(v) for v in values), np.uint64, len(values))


def _longer(h: np.ndarray | None, word: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one word more; without phrases (None), of the words in their languages."""
    return mix(word ^ lang) if h is None else mix(h * GOLDEN + word)


def _counted(langs: list[str], texts: pa.Array, k: int, bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Rows of COUNTED: the phrases of k words of the texts with their counts; for k = 1 also each language's number of words, with a null phrase."""
    found = scan(texts, SEPARATORS, BREAKS)
    if len(found.words) < k:
        return
    known, lang_of = np.unique(np.array(langs, object), return_inverse=True)
    encoded = found.words.dictionary_encode()
    codes, words = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary
    lang = lang_of[found.rows]
    word_hash = _hashes(words.to_pylist())[codes]
    lang_hash = _hashes([x.encode("utf-8", "replace") for x in known])[lang]

    h = None
    for j in range(1, k):
        h = _longer(None if h is None else h[:-1], word_hash[j - 1 :], lang_hash)
    at = np.arange(len(codes))
    if h is not None:
        mask = np.uint64(len(bits) * 8 - 1)
        place = h & mask
        frequent = (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
        at = np.flatnonzero(frequent[:-1] & frequent[1:] & (found.pieces[: len(codes) - k + 1] == found.pieces[k - 1 :]))
    if not len(at):
        return
    # Exact numbers of the phrases of this run: the first words' number and the next word's code make the next number.
    key = lang[at] * len(words) + codes[at]
    for j in range(1, k):
        if j > 1:
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(words) + codes[at + j]
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    first = at[first]
    joined = words.take(pa.array(codes[first])) if k == 1 else pc.binary_join_element_wise(*(words.take(pa.array(codes[first + j])) for j in range(k)), pa.scalar(b" ", pa.large_binary()))
    names = pa.array(known.tolist(), pa.string())
    rows = lambda *columns: pa.RecordBatch.from_arrays(list(columns), names=["lang", "phrase", "n"])
    yield rows(names.take(pa.array(lang[first])), joined.cast(pa.binary()), pa.array(n.astype(np.int64)))
    if k == 1:
        yield rows(names, pa.nulls(len(known), pa.binary()), pa.array(np.bincount(lang, minlength=len(known)).astype(np.int64)))


def _with_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a level table with the hash by which the next pass knows a phrase."""
    for b in batches:
        langs = _hashes([x.encode("utf-8", "replace") for x in b.column("lang").to_pylist()])
        split = [(x or "").encode("utf-8", "replace").split(b" ") for x in b.column("phrase").to_pylist()]
        h = None
        for j in range(max(map(len, split), default=0)):
            h = _longer(h, _hashes([w[j] for w in split]), langs)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.zeros(0, np.int64) if h is None else h.view(np.int64))], names=["lang", "phrase", "n", "h"])


def level_table(texts: DataFrame, k: int, bits=None, least: int = LEAST) -> DataFrame:
    """(lang, phrase, n, h): the phrases of k words of texts (lang, raw) that occur least times or more. bits is the broadcast bitmap of the level before.

    h is the phrase's hash. With k = 1 a null phrase has the number of all the language's words.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None if bits is None else bits.value
        for b in batches:
            langs = b.column("lang").to_pylist()
            for start, part in runs(b.column("raw"), RUN_BYTES):
                yield from _counted(langs[start : start + len(part)], part, k, held)

    # Hashes are added to the frequent phrases alone, so that the shuffle has none.
    counted = texts.select("lang", "raw").mapInArrow(work, COUNTED).select("lang", F.col("phrase").cast("string").alias("phrase"), "n")
    return counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | F.col("phrase").isNull()).mapInArrow(_with_hash, LEVEL)


def bitmap(level: DataFrame) -> np.ndarray:
    """One bit of at most MOST_BITS for each hash of a level table, as bytes. Spark sets the bits; the driver gets words of 64."""
    size = 64
    wanted = min(MOST_BITS, BITS_EACH * level.count())
    while size < wanted:
        size *= 2
    place = F.col("h").bitwiseAND(F.lit(size - 1))
    words = level.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast(h & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit"))
    got = words.toArrow()
    out = np.zeros(size // 64, np.int64)
    out[got["word"].to_numpy()] = got["bit"].to_numpy()
    return out.view(np.uint8)


def levels(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> list[DataFrame]:
    """The level tables of 1 to longest words, written to the shared folder; those after an empty one are empty."""
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").cast("binary").alias("raw")).filter("raw is not null")
    out = [staged(level_table(texts, 1, least=least), "phrases")]
    for k in range(2, longest + 1):
        frequent = out[-1].filter("phrase is not null")
        if frequent.isEmpty():
            out.append(frequent)
            continue
        bits = sc.broadcast(bitmap(frequent))
        out.append(staged(level_table(texts, k, bits, least), "phrases"))
        bits.unpersist()
    return out


def scored(tables: list[DataFrame]) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of all phrases of two words or more in the level tables, by the cut that scores lowest, the earliest on ties."""
    n = tables[0].filter("phrase is null").select(F.col("lang").alias("_lang"), F.col("n").alias("n"))
    named = lambda df, name: df.filter("phrase is not null").select(F.col("lang").alias(f"{name}_lang"), F.col("phrase").alias(f"{name}_phrase"), F.col("n").alias(name))
    parts = reduce(DataFrame.unionByName, [t.select("lang", "phrase", "n") for t in tables[:-1]])
    long = reduce(DataFrame.unionByName, [t.select("lang", "phrase", F.col("n").alias("a"), F.lit(k).alias("k")) for k, t in enumerate(tables[1:], 2)])
    cuts = long.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).withColumns({"left": F.expr("substring_index(phrase, ' ', cut)"), "right": F.expr("substring_index(phrase, ' ', cut - k)")})
    cuts = cuts.join(named(parts, "l"), (F.col("lang") == F.col("l_lang")) & (F.col("left") == F.col("l_phrase")))
    cuts = cuts.join(named(parts, "r"), (F.col("lang") == F.col("r_lang")) & (F.col("right") == F.col("r_phrase")))
    cuts = cuts.join(n, F.col("lang") == F.col("_lang"))
    # Products of three counts pass 64 bits; the quotient, at most 1000 * n / a, does not.
    cuts = cuts.withColumn("score", F.expr("(cast(1000 as decimal(38,0)) * cast(a as decimal(20,0)) * cast(n as decimal(20,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    return cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")


def covered(tables: list[DataFrame]) -> DataFrame:
    """(lang, phrase, most): phrases of two words or more inside longer ones of the level tables, and the largest count of those."""
    parts = "flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), s -> array_join(slice(split(phrase, ' '), s, m), ' '))))"
    longer = [t.select("lang", F.col("n"), F.explode(F.expr(parts.replace("k - ", f"{k} - "))).alias("phrase")) for k, t in enumerate(tables[2:], 3)]
    return reduce(DataFrame.unionByName, longer).groupBy("lang", "phrase").agg(F.max("n").alias("most"))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first top phrases of each language of docs (lang, text, ...).

    Phrases are runs of 2 to longest words within a piece that occur a >= least times in their language; l and r
    are the counts of the two sides of the cut with the lowest score, n the language's words. Those inside a
    longer phrase with the same count are left out. Equal scores go by a, then by the phrase's bytes. A null
    language is "und", a null text is empty, repeated rows count each, no rows give no rows; other columns are ignored.
    """
    if longest < 3:
        raise ValueError("phrases have up to three words or more")
    tables = levels(docs, longest, least)
    inside = covered(tables).select(F.col("lang").alias("_l"), F.col("phrase").alias("_p"), "most")
    kept = scored(tables).join(inside, (F.col("lang") == F.col("_l")) & (F.col("phrase") == F.col("_p")) & (F.col("most") >= F.col("a")), "left_anti")
    kept = staged(kept, "collocations")
    dropped(*(t for t in tables if hasattr(t, "_staged")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    # A language's phrases are cut down in parts first, so that its last ranking has RANK_PARTS * top rows at most.
    few = kept.withColumn("_r", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).filter(F.col("_r") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

"""Sentence boundaries learned from the texts: which words with a period are abbreviations, and which pairs go on after one.

The statistics are those of Kiss and Strunk (2006), "Unsupervised multilingual sentence boundary detection":
log-likelihood ratios of counts, which Spark aggregates, times the factors for length and inner periods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stancemill.functions.text import bound

#: The paper's thresholds for abbreviations, collocations and sentence starters.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
#: What a word's ends are freed of before it is counted.
EDGES = r"^[\"'(\[{«“‘]+|[\"')\]}»”’,;:]+$"


def words(text: Column) -> Column:
    """What lies between white space, without quotes and brackets at its ends."""
    return F.filter(F.transform(F.split(text, r"\s+"), lambda w: F.regexp_replace(w, EDGES, "")), lambda w: w != "")


def counted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(type, periods, plain): how often each word in lower case occurs with a period at its end and without; types have none. Words without a letter are left out."""
    w = docs.select(F.explode(words(F.col(text_col).cast("string"))).alias("w")).filter(F.col("w").rlike(r"\p{L}"))
    w = w.select(F.lower(F.regexp_replace("w", r"[.!?]+$", "")).alias("type"), F.col("w").endswith(".").alias("ends"))
    return w.filter("type <> ''").groupBy("type").agg(F.count_if("ends").alias("periods"), F.count_if(~F.col("ends")).alias("plain"))


def _log_likelihood(k: Column, n: Column, p) -> Column:
    """ln of p^k (1 - p)^(n - k), with p kept off 0 and 1."""
    p = F.greatest(F.least(p, F.lit(1 - 1e-12)), F.lit(1e-12))
    return k * F.ln(p) + (n - k) * F.ln(1 - p)


def abbreviations(counts: DataFrame, threshold: float = ABBREVIATION) -> DataFrame:
    """(type, periods, plain, score) of the types that occur with a period and score the threshold or more.

    score is the log-likelihood ratio of a period after nearly every occurrence to one as often as after any word, times
    e^-length, times 1 + inner periods, times length^-plain; length is without periods.
    """
    total = counts.agg((F.sum("periods") / (F.sum("periods") + F.sum("plain"))).alias("p")).scalar()
    k, n = F.col("periods").cast("double"), (F.col("periods") + F.col("plain")).cast("double")
    ratio = -2 * (_log_likelihood(k, n, total) - _log_likelihood(k, n, F.lit(0.99)))
    inner = F.length("type") - F.length(F.replace("type", F.lit("."), F.lit("")))
    length = (F.length("type") - inner).cast("double")
    score = ratio * F.exp(-length) * (inner + 1) * F.pow(length, -F.col("plain").cast("double"))
    return counts.filter("periods > 0").withColumn("score", score).filter(F.col("score") >= threshold)


def _association(both: Column, first: Column, second: Column, n: Column) -> Column:
    """Dunning's ratio for a pair that occurs both times, of words that occur first and second times among n."""
    p, p1, p2 = second / n, both / first, (second - both) / F.greatest(n - first, F.lit(1.0))
    return -2 * (_log_likelihood(both, first, p) + _log_likelihood(second - both, n - first, p) - _log_likelihood(both, first, p1) - _log_likelihood(second - both, n - first, p2))


def collocations(docs: DataFrame, known: DataFrame, text_col: str = "text", threshold: float = COLLOCATION) -> DataFrame:
    """(first, second, n, score): pairs of an abbreviation of known (type), an initial or a number, with its period, and the word after it, that go together."""
    w = words(F.col(text_col).cast("string"))
    pairs = docs.select(F.explode(F.arrays_zip(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))).alias("a"), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))).alias("b"))).alias("p"))
    clean = lambda c: F.lower(F.regexp_replace(c, r"[.!?]+$", ""))
    pairs = pairs.filter(F.col("p.a").endswith(".")).select(clean(F.col("p.a")).alias("first"), clean(F.col("p.b")).alias("second")).filter("first <> '' and second <> ''")
    counts = pairs.groupBy("first", "second").agg(F.count("*").alias("n"))
    firsts, seconds = counts.groupBy("first").agg(F.sum("n").alias("n1")), counts.groupBy("second").agg(F.sum("n").alias("n2"))
    total = counts.agg(F.sum("n").cast("double").alias("t")).scalar()
    own = known.select(F.col("type").alias("first"), F.lit(True).alias("known"))
    c = counts.filter("n > 1").join(own, "first", "left").filter(F.col("known") | F.col("first").rlike(r"^(\p{L}|\d+)$"))
    c = c.join(firsts, "first").join(seconds, "second")
    both, first, second = (F.col(x).cast("double") for x in ("n", "n1", "n2"))
    scored = c.withColumn("score", F.when(both / first > second / total, _association(both, first, second, total)).otherwise(F.lit(0.0)))
    return scored.filter(F.col("score") >= threshold).select("first", "second", "n", "score")


def split_sentences(docs: DataFrame, known: DataFrame, pairs: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sentences) of docs (id, text, ...): the text cut after . ! or ? before white space, but not after an abbreviation of known
    (type), an initial, or between the words of a pair (first, second). Ids are unique; a null text has null sentences.

    Each document's words with a period are looked up by a join, so the tables may be of any size.
    """
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    parts = F.split(F.regexp_replace("_text", r"([.!?])\s+", "$1\u0001"), "\u0001", -1)
    ends = F.transform(parts, lambda p: F.struct(F.lower(F.regexp_replace(F.regexp_replace(F.element_at(F.split(p, r"\s"), -1), EDGES, ""), r"\.$", "")).alias("last"), F.lower(F.regexp_replace(F.regexp_replace(F.split(p, r"\s")[0], EDGES, ""), r"[.!?]+$", "")).alias("head"), p.endswith(".").alias("dot")))
    # The place after part number at, with the words on both sides.
    def joints(e: Column) -> Column:
        rest = F.greatest(F.size(e) - 1, F.lit(0))
        return F.transform(F.arrays_zip(F.slice(e, 1, rest).alias("a"), F.slice(e, 2, rest).alias("b")), lambda z: F.struct(z["a"]["last"].alias("last"), z["b"]["head"].alias("head"), z["a"]["dot"].alias("dot")))

    nexts = d.select("_id", F.posexplode(bound(ends, joints)).alias("at", "j")).filter("j.dot").select("_id", "at", "j.last", "j.head")
    closed = nexts.join(known.select(F.col("type").alias("last")).distinct().withColumn("abbreviated", F.lit(True)), "last", "left")
    closed = closed.withColumn("go_on", F.coalesce("abbreviated", F.lit(False)) | F.col("last").rlike(r"^\p{L}$"))
    if pairs is not None:
        p = pairs.select(F.col("first").alias("last"), F.col("second").alias("head"), F.lit(True).alias("paired")).distinct()
        closed = closed.join(p, ["last", "head"], "left").withColumn("go_on", F.col("go_on") | F.coalesce("paired", F.lit(False)))
    held = closed.filter("go_on").groupBy("_id").agg(F.collect_set("at").alias("held")).select(F.col("_id").alias("_i"), "held")
    out = d.join(held, F.col("_id").eqNullSafe(F.col("_i")), "left").withColumn("held", F.coalesce("held", F.array().cast("array<int>")))

    def marked(v: Column) -> Column:
        return F.array_join(F.transform(v["parts"], lambda p, i: F.when(i == v["last"], p).when(F.array_contains(v["held"], i), F.concat(p, F.lit(" "))).otherwise(F.concat(p, F.lit("\u0001")))), "")

    whole = bound(bound(F.struct(parts.alias("parts"), F.col("held").alias("held")), lambda v: F.struct(v["parts"].alias("parts"), v["held"].alias("held"), (F.size(v["parts"]) - 1).alias("last"))), marked)
    return out.select(F.col("_id").alias(id_col), F.split(whole, "\u0001", -1).alias("sentences"))

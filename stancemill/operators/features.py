"""The registry of page features: name -> column of text, query and url."""

from __future__ import annotations

import math
import warnings
from collections import Counter
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stancemill.functions import text as T
from stancemill.functions.stem import coded, longest_common_ngram, runs, sizes_of

Feature = Callable[[Column, Column, Column], Column]
REGISTRY: dict[str, Feature] = {}
#: Slots of the stand-in encoder.
DIMENSIONS = 256
#: A small lexicon for the stand-in sentiment model.
POSITIVE = "good great best better well benefit healthy safe true right happy love success".split()
NEGATIVE = "bad worst worse poor harm unhealthy unsafe false wrong sad hate failure risk".split()


def feature(name: str) -> Callable[[Feature], Feature]:
    """Registers a feature; names start with an underscore."""
    if not name.startswith("_"):
        raise ValueError(f"feature names start with _: {name}")

    def put(f: Feature) -> Feature:
        REGISTRY[name] = f
        return f

    return put


feature("_num_tokens")(lambda text, query, url: T.num_tokens(text))
feature("_num_unique_tokens")(lambda text, query, url: T.num_unique_tokens(text))
feature("_href_count")(lambda text, query, url: T.count_pattern(text, T.HREF))
feature("_url_count")(lambda text, query, url: T.count_pattern(text, T.url_pattern()))
feature("_email_count")(lambda text, query, url: T.email_count(text))
feature("_max_ngram_overlap")(lambda text, query, url: ngram_overlap(T.normal_words(text), T.normal_words(query)))
feature("_tld")(lambda text, query, url: T.suffix(url))
feature("_domain")(lambda text, query, url: T.domain(url))
feature("_flesch_kincaid_readibility")(lambda text, query, url: T.readability(text))


def ngram_overlap(words: Column, asked: Column) -> Column:
    return F.size(longest_common_ngram(words, asked)).cast("long")


@feature("_st_similarity")
def similarity(text: Column, query: Column, url: Column) -> Column:
    """Dot product of the stand-in encodings: sums over the query's words of how often the text has a word of their slot."""
    return word_similarity(T.normal_words(text), T.normal_words(query))


def word_similarity(words: Column, asked_words: Column) -> Column:
    slot = lambda words: F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(DIMENSIONS)))
    both = F.struct(slot(words).alias("held"), slot(asked_words).alias("asked"))

    def score(v: Column) -> Column:
        held, asked = v["held"], v["asked"]
        # Only words whose slots are asked for are counted slot by slot.
        hits = F.filter(held, lambda x: F.array_contains(asked, x))
        shared = T.bound(hits, lambda hits: F.aggregate(F.array_distinct(asked), F.lit(0.0), lambda s, q: s + F.size(F.filter(hits, lambda x: x == q)) * F.size(F.filter(asked, lambda x: x == q))))
        return shared / (F.greatest(F.size(held), F.lit(1)) * F.greatest(F.size(asked), F.lit(1)))

    return F.when(words.isNotNull() & asked_words.isNotNull(), T.bound(both, score))


@feature("_sentiment_flan")
def sentiment(text: Column, query: Column, url: Column) -> Column:
    """A stand-in model: log-probabilities of Positive and Negative from lexicon counts, with a third of the mass left to other answers."""
    return word_sentiment(T.normal_words(text))


def word_sentiment(words: Column) -> Column:
    hits = lambda lexicon: F.size(F.filter(words, lambda w: w.isin(lexicon))).cast("double")
    good, bad = hits(POSITIVE) + 1, hits(NEGATIVE) + 1
    share = lambda x: F.ln(x / (good + bad)) + math.log(2 / 3)
    return F.when(words.isNotNull(), F.map_from_arrays(F.array(F.lit("Positive"), F.lit("Negative")), F.array(share(good), share(bad))))


def own_perplexity(words) -> float | None:
    if words is None or not len(words):
        return None
    c, n = Counter(words), len(words)
    return math.exp(-sum(k * math.log((k + 1) / (n + len(c))) for k in c.values()) / n)


@feature("_perplexity_gpt2")
def perplexity(text: Column, query: Column, url: Column) -> Column:
    """A stand-in language model: exp of the mean negative log-likelihood of the text's words under their own counts with add-one smoothing."""
    return word_perplexity(T.normal_words(text))


def word_perplexity(words: Column) -> Column:
    @F.arrow_udf("double")
    def work(lists: pa.Array) -> pa.Array:
        # Numbers of words in place of words, some rows at a time, so that no batch of texts becomes Python strings.
        return pa.array([own_perplexity(r) for i, j in runs(sizes_of(lists)) for r in coded(lists[i:j])[0]], pa.float64())

    return work(words)


#: Features that are functions of the normal words of text and query alone.
OF_WORDS: dict[str, Callable[[Column, Column], Column]] = {
    "_max_ngram_overlap": ngram_overlap,
    "_st_similarity": word_similarity,
    "_sentiment_flan": lambda words, asked: word_sentiment(words),
    "_perplexity_gpt2": lambda words, asked: word_perplexity(words),
}
#: Each of them as it is registered here; one registered in its place is built from text and query.
OWN = {n: REGISTRY[n] for n in OF_WORDS}


#: What the feature driver computes, in this order.
DRIVER = ["_st_similarity", "_num_tokens", "_num_unique_tokens", "_flesch_kincaid_readibility", "_max_ngram_overlap", "_sentiment_flan", "_perplexity_gpt2"]


def add_features(df: DataFrame, names: list[str] | None = None, text_col: str = "text", skip: bool = True, models: dict[str, Feature] | None = None) -> DataFrame:
    """df with the named features (default: all whose inputs df has); present columns are kept if skip. One projection adds them all.

    models gives features in place of those registered, such as those of operators.models. A feature that can't be built for df
    is left out with a warning, and the others are added. Words are found once for all features that need them.
    """
    has = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    needs = {"_tld": "url", "_domain": "url", "_max_ngram_overlap": "search_query", "_st_similarity": "search_query"}
    names = names or [n for n in REGISTRY if needs.get(n, text_col) in df.columns]
    known, made, kinds = REGISTRY | (models or {}), {}, dict(df.dtypes)
    ours = {n for n in names if n in OF_WORDS and known[n] is OWN[n] and not (skip and n in kinds)}
    if kinds.get(text_col) == kinds.get("search_query") == "string" and not {"_words", "_asked"} & set(kinds) and ours:
        # A projection of its own, as what is used more than once is not merged into the next.
        df = df.withColumns({"_words": T.normal_words(F.col(text_col)), "_asked": T.normal_words(F.col("search_query"))})
    else:
        ours = set()
    for n in names:
        if skip and n in df.columns:
            continue
        try:
            made[n] = OF_WORDS[n](F.col("_words"), F.col("_asked")) if n in ours else known[n](has(text_col), has("search_query"), has("url"))
            df.select(made[n])
        except Exception as error:  # noqa: BLE001 - one feature's failure leaves the others
            made.pop(n, None)
            warnings.warn(f"feature {n} left out: {error}", stacklevel=2)
    out = df.withColumns(made)
    return out.drop("_words", "_asked") if ours else out


def unique_lemmas(df: DataFrame, lemmas: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n): distinct lemmas of each text's tokens; tokens that lemmas (token, lemma) lacks are their own. A null text has a null n."""
    tokens = df.select(id_col, F.explode_outer(F.array_distinct(T.space_tokens(F.col(text_col)))).alias("token"))
    return tokens.join(lemmas, "token", "left").groupBy(id_col).agg(F.nullif(F.count_distinct(F.coalesce("lemma", "token")), F.lit(0)).alias("n"))


def exact_sum(x: Column) -> Column:
    """The sum of doubles of 0 or more, added up as whole numbers and rounded once: the same in whatever order the rows come. What lies below 2^-52 in a value is left out."""
    whole = F.floor(x)
    upper = (x - whole) * (1 << 26)
    lower = F.floor((upper - F.floor(upper)) * (1 << 26))
    whole, upper, lower = F.sum(whole), F.sum(F.floor(upper)), F.sum(lower)
    upper = upper + F.shiftright(lower, 26)
    low = lambda c: c.bitwiseAND(F.lit((1 << 26) - 1).cast("long"))
    rest = F.shiftleft(low(upper), 26) + low(lower)
    return whole + F.shiftright(upper, 26) + rest / float(1 << 52)


def by_libm(f: Callable[[float], float], x: Column) -> Column:
    """A function of the C library, as SQL engines have it: Java's own may differ in the last bit."""

    @F.pandas_udf("double")
    def work(values: pd.Series) -> pd.Series:
        return values.map(f, na_action="ignore").astype(float)

    return work(x)


def token_perplexity(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, perplexity) under a corpus unigram model with add-one smoothing: exp of the mean negative log-likelihood of each text's words; null without words."""
    words = df.select(id_col, F.explode_outer(T.normal_words(F.col(text_col))).alias("word")).groupBy(id_col, "word").agg(F.count("*").alias("n"))
    model = words.filter("word is not null").groupBy("word").agg(F.sum("n").alias("c"))
    # One row, as a scalar subquery: no join.
    total = model.agg((F.sum("c") + F.count("*")).alias("t")).scalar()
    rated = model.withColumn("t", total).select("word", (-by_libm(math.log, (F.col("c") + 1) / F.col("t"))).alias("loss"))
    scored = words.join(rated, "word", "left")
    nll = exact_sum(F.col("n") * F.col("loss")) / F.sum(F.when(F.col("word").isNotNull(), F.col("n")))
    return scored.groupBy(id_col).agg(nll.alias("nll")).select(id_col, by_libm(math.exp, F.col("nll")).alias("perplexity"))

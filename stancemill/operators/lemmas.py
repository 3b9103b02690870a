"""Noun lemmas by detaching endings, checked against a vocabulary and a table of exceptions by joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The noun endings that the published morphology detaches, and what takes their place.
NOUN_ENDINGS = [("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y")]


def lemma_table(tokens: DataFrame, vocabulary: DataFrame, exceptions: DataFrame, endings: list[tuple[str, str]] = NOUN_ENDINGS, rounds: int = 3) -> DataFrame:
    """(token, lemma) of each different token of tokens (token); a token that no rule leads to the vocabulary is its own lemma.

    A token in exceptions (form, lemma) has the token itself and their lemmas as candidates; others have the token and what is
    left when an ending is detached. Candidates in vocabulary (word) count, and of several the shortest, the first by
    its characters on ties. Tokens without one have the endings of their candidates detached again, rounds times in all.
    """
    t = tokens.select("token").filter("token is not null").distinct()
    words = vocabulary.select(F.col("word").alias("form")).distinct()
    e = exceptions.select(F.col("form").alias("token"), F.col("lemma").alias("form")).distinct()
    irregular = t.join(e, "token")
    known = [irregular.unionByName(irregular.select("token", F.col("token").alias("form")))]
    forms = t.join(e.select("token").distinct(), "token", "left_anti").select("token", F.col("token").alias("form"))
    for k in range(rounds):
        shorter = forms.select("token", F.explode(F.array_compact(F.array(*(F.when(F.endswith("form", F.lit(end)), F.concat(F.expr(f"left(form, length(form) - {len(end)})"), F.lit(new))) for end, new in endings)))).alias("form"))
        found = (forms.unionByName(shorter) if k == 0 else shorter).join(words, "form", "left_semi")
        known.append(found.withColumn("round", F.lit(k)))
        forms = shorter
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), known)
    # Endings are detached again only from tokens that have no lemma yet, so the earliest round counts.
    checked = every.join(words, "form", "left_semi").select("token", F.struct(F.coalesce("round", F.lit(0)).alias("round"), F.length("form").alias("size"), F.col("form")).alias("c"))
    best = checked.groupBy("token").agg(F.min("c").alias("c"))
    return t.join(best, "token", "left").select("token", F.coalesce("c.form", "token").alias("lemma"))

"""The whole flows, as compositions of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stancemill.functions import text as T
from stancemill.functions.stem import quote_shared_words
from stancemill.operators import boilerplate, features
from stancemill.operators import relational as R
from stancemill.sources import connectors, io


#: Makes a page's text of its html, both as columns.
Extractor = Callable[[Column], Column]


def questions(answers: DataFrame) -> DataFrame:
    """(search_query, category): the question lines of answers (category, model_answer)."""
    lines = answers.select("category", F.explode(F.split("model_answer", "\n", -1)).alias("search_query"))
    return lines.filter(T.is_question(F.col("search_query"))).select("search_query", "category")


def generated_questions(topics: DataFrame, completer: connectors.Completer, **tries) -> DataFrame:
    """(search_query, category) of the questions that the completer writes about each of topics (category); a topic that gets no answer has none."""
    return questions(connectors.completed(topics.select("category"), connectors.QUESTION_PROMPT, "category", completer, **tries))


def search_inputs(statements: DataFrame) -> DataFrame:
    """Statements (category, search_query, model_answer) as one row for each side, words shared with the question quoted."""
    a = F.col("model_answer")
    long = R.unpivot_statements(statements.withColumns({"yes_statement": T.statements(a, "yes"), "no_statement": T.statements(a, "no")}))
    return long.withColumn("search_engine_input", quote_shared_words(F.col("search_engine_input"), F.col("search_query"))["one"])


def build_pages(inputs: DataFrame, hits: DataFrame, stored: DataFrame, least: int = 200, extract: Extractor = boilerplate.main_text) -> DataFrame:
    """Inputs joined with their hits, with the text that extract makes of the pages' html, where that is long enough."""
    pages = connectors.fetch_offline(R.one_to_many(inputs, hits, ["search_query", "search_engine_input"]), stored)
    return pages.withColumn("text", extract(F.col("html"))).drop("html").filter(T.long_enough(F.col("text"), least))


def search_table(spark: SparkSession, path: str, inputs: DataFrame, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The hits at path, to which ask(inputs whose search_engine_input they lack) is appended first; ids go on from those there, so that a stored id never changes.

    inputs: search_query, search_engine_input; ask gives connectors.HIT's columns and is evaluated once.
    """
    order = [c.split()[0] for c in connectors.HIT.split(", ")]

    def numbered(lacking: DataFrame) -> DataFrame:
        taken = spark.read.parquet(path).agg(F.max("doc_id")).first()[0] if io.exists(spark, path) else None
        hits = R.dense_ids(R.settled(ask(lacking)).select(order), order)
        return hits.withColumn("doc_id", F.col("doc_id") + (-1 if taken is None else taken) + 1)

    return io.resumed_at(spark, path, inputs.select("search_query", "search_engine_input"), "search_engine_input", numbered)


def build_dataset(spark: SparkSession, statements: DataFrame, hits: str, stored: str, ask: Callable[[DataFrame], DataFrame], fetcher: connectors.Fetcher | None, least: int = 200, extract: Extractor = boilerplate.main_text) -> DataFrame:
    """Statements (category, search_query, model_answer) to pages with text: search, fetch what is not stored, extract, and drop short texts.

    hits and stored are the paths of the tables of hits and of pages (doc_id, html), both kept for later runs.
    """
    inputs = search_inputs(statements)
    pages = R.one_to_many(inputs, search_table(spark, hits, inputs.filter("search_engine_input is not null"), ask), ["search_query", "search_engine_input"])
    pages = connectors.fetch_resumed(pages, stored, fetcher)
    return pages.withColumn("text", extract(F.col("html"))).drop("html").filter(T.long_enough(F.col("text"), least))


def best_windows(pages: DataFrame, score: Column, size: int = 508, step: int = 256) -> DataFrame:
    """pages (doc_id, text, search_query) with the window of tokens that scores highest; score is a column of window and search_query. Rows without text or query get nulls."""
    windows = pages.select("doc_id", "search_query", F.posexplode_outer(T.windows(T.space_tokens(F.col("text")), size, step)).alias("at", "tokens")).withColumn("window", F.array_join("tokens", " "))
    scored = windows.withColumn("score", F.nanvl(score, F.lit(float("-inf"))))
    best = scored.filter("search_query is not null and window is not null").groupBy("doc_id").agg(F.max(F.struct("score", (-F.col("at")).alias("first"), "window")).alias("b"))
    return pages.join(best, "doc_id", "left").withColumns({"text_thresh_window": F.col("b.window"), "text_thresh_window_score": F.col("b.score")}).drop("b")


def trimmed(pages: DataFrame, column: str = "text_thresh_window") -> DataFrame:
    """pages with text_thresh_window_sent, without cut-off sentences, and its score against the query; rows without query go."""
    text = T.trim_sentences(T.sentences(F.col(column)))["text"]
    out = R.add_if_absent(pages, "text_thresh_window_sent", text).filter("search_query is not null")
    return out.withColumn("score_sent", features.REGISTRY["_st_similarity"](F.col("text_thresh_window_sent"), F.col("search_query"), F.lit(None)))


def ensemble_filter(pages: DataFrame, first: DataFrame, second: DataFrame, least: int = 5, counts: R.StageCounts | None = None) -> DataFrame:
    """pages (answer_id, search_query, ...) whose two labels agree, of queries with enough evidence.

    first: answer_id, answer of the labeller that answers at once; second: of the one whose last line is the answer.
    counts gets the rows of pages, of those that agree and of those that are left, when the result is read.
    """
    passing = counts.passing if counts else lambda df, stage: df
    a = first.select("answer_id", T.classify(F.col("answer"), T.SHORT_CLASSES).alias("label_a"))
    b = second.select("answer_id", T.classify(T.last_line(F.col("answer")), T.FULL_CLASSES).alias("label_b"))
    kept = R.keep_ids(passing(pages, "pages").join(a, "answer_id", "left"), R.agreed_ids(a, b), "answer_id").withColumnRenamed("label_a", "stance")
    return passing(_enough(passing(kept, "agreed"), kept, least, "stance"), "ensemble")


def _enough(rows: DataFrame, same: DataFrame, least: int, answer: str) -> DataFrame:
    """rows of queries with enough evidence, which same, the rows without counters, shows; counters in both would count twice."""
    return R.keep_ids(rows, R.filter_pair_thresh(same, least, answer)[1], "answer_id")


def dedup_filter(pages: DataFrame, duplicates: DataFrame, least: int = 5, answer: str = "stance", counts: R.StageCounts | None = None) -> DataFrame:
    """pages without those of duplicate queries, and again only queries with enough evidence. counts gets the rows that are no duplicates' and those that are left."""
    passing = counts.passing if counts else lambda df, stage: df
    kept = R.drop_ids(pages, duplicates, "search_query", "search_query")
    return passing(_enough(passing(kept, "deduplicated"), kept, least, answer), "enough")


def labelled_by(pages: DataFrame, labellers: dict[str, connectors.Completer], text_col: str = "text_thresh_window_sent") -> DataFrame:
    """pages (search_query, ...) with the answer of each labeller in a column of its name; null where text or query is, or where it fails."""
    prompt = F.concat(F.lit("Does this text answer the question with yes or with no?\nQuestion: "), F.col("search_query"), F.lit("\nText: "), F.col(text_col))
    out = pages.withColumn("_prompt", prompt)
    for name, labeller in labellers.items():
        out = out.withColumn(name, connectors.answer(F.col("_prompt"), labeller))
    return out.drop("_prompt")


def add_page_features(pages: DataFrame, text_col: str = "text_thresh_window_sent") -> DataFrame:
    return features.add_features(pages, features.DRIVER, text_col)

"""Queries of the library's own operators over the driver's tables, and their oracle SQL for DuckDB.

documents stand for pages (source: the query), labels for stances, conversations for answers, benchmark for
queries, pages for fetched pages, embeddings for encodings and events for search hits. Every query runs over
the whole of its tables.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stancemill.functions import text as T
from stancemill.functions.stem import longest_common_ngram, quote_shared_words, stem_word
from stancemill.operators import boilerplate, features, lemmas, models, sentences, subwords, urls
from stancemill.operators import relational as R
from stancemill.plans import pipeline
from stancemill.plans.stem_sql import stems
from stancemill.sources import connectors, fetching, io, ranges
from stancemill.sources import search_source as service

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long(c) -> F.Column:
    return c.cast("long")


@query("SELECT doc_id FROM documents WHERE len(string_split(text, ' ')) >= 200")
def basic_filtering(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(T.long_enough(F.col("text"))).select("doc_id")


@query("SELECT doc_id, CAST(len(string_split(text, ' ')) AS BIGINT) AS num_tokens FROM documents")
def num_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.num_tokens(F.col("text")).alias("num_tokens"))


@query("SELECT doc_id, CAST(len(list_distinct(string_split(text, ' '))) AS BIGINT) AS num_unique_tokens_raw FROM documents")
def num_unique_tokens_raw(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.num_unique_tokens(F.col("text")).alias("num_unique_tokens_raw"))


#: Forms that the queries' lemmas are given for, beside the vocabulary.
IRREGULAR = [("men", "man"), ("mice", "mouse"), ("os", "o"), ("des", "de")]
DETACHED = " UNION ALL ".join(f"SELECT token, left(form, length(form) - {len(a)}) || '{b}', round + 1 FROM f WHERE ends_with(form, '{a}') AND round < 3" for a, b in lemmas.NOUN_ENDINGS)
LEMMAS = f"""t AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS token FROM documents), v AS (SELECT w AS form FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY w HAVING count(DISTINCT doc_id) >= 3),
    e(token, form) AS (VALUES {', '.join(map(str, IRREGULAR))}), f(token, form, round) AS (SELECT token, token, 0 FROM t WHERE token NOT IN (SELECT token FROM e) UNION ALL ({DETACHED})),
    c AS (SELECT token, form, greatest(round - 1, 0) AS round FROM f UNION ALL SELECT token, form, 0 FROM t JOIN e USING (token) UNION ALL SELECT token, token, 0 FROM t JOIN e USING (token)),
    lemma AS (SELECT t.token, coalesce(m.form, t.token) AS lemma FROM t LEFT JOIN (SELECT token, arg_min(form, (round, length(form), form)) AS form FROM c JOIN v USING (form) GROUP BY token) m USING (token))"""


@query(f"WITH RECURSIVE {LEMMAS} SELECT doc_id, CAST(count(DISTINCT lemma) AS BIGINT) AS n FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS token FROM documents) JOIN lemma USING (token) GROUP BY doc_id")
def num_unique_lemmas(spark, sf_dir):
    """Lemmas by detached endings; words of three documents or more are the vocabulary."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokens = d.select("doc_id", F.explode(F.array_distinct(T.space_tokens(F.col("text")))).alias("token"))
    vocabulary = tokens.groupBy("token").agg(F.count("*").alias("n")).filter("n >= 3").select(F.col("token").alias("word"))
    found = lemmas.lemma_table(tokens, vocabulary, spark.createDataFrame(IRREGULAR, "form string, lemma string"))
    return features.unique_lemmas(d, found, "doc_id", "text")


@query("SELECT page_id, CAST(len(regexp_extract_all(html, 'href\\s*=')) AS BIGINT) AS href_count FROM pages")
def href_count(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.count_pattern(F.col("html"), T.HREF).alias("href_count"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '" + T.EMAIL.replace("'", "''") + "')) AS BIGINT) AS email_count FROM documents")
def email_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.email_count(F.col("text")).alias("email_count"))


#: Runs of word characters, . - and @ are marked at both ends in place of looking behind and ahead.
RUNS = "regexp_replace(html, '[@\\w.\\-]+', chr(1) || '\\0' || chr(2), 'g')"
INNER = r"[a-z0-9\-._~%!$&''()*+,;=:@/?#\[\]\x01\x02]"
TAIL = rf"(?:{INNER}*[a-z0-9\-_~%$&*+=@/#])"
URL = rf"(?i)(?:\x01|[@.\-])https?\x02://{TAIL}|\x01(?:[a-z0-9](?:[a-z0-9\-]*[a-z0-9])?\.)+(?:{'|'.join(T.TLDS)})(?:\x02(?:[/?#:]{TAIL}?)?|\.(?:\x02|[^a-z0-9]))"


@query(f"SELECT page_id, CAST(len(regexp_extract_all({RUNS}, '{URL}')) AS BIGINT) AS url_count FROM pages")
def url_count(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.count_pattern(F.col("html"), T.url_pattern()).alias("url_count"))


@query("SELECT conv_id, turn, CASE WHEN contains(lower(text), 'not') THEN 'not' WHEN contains(lower(text), 'yes') THEN 'yes' WHEN contains(lower(text), 'no') THEN 'no' END AS answer FROM conversations")
def classify_answer(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.classify(F.col("text"), T.FULL_CLASSES).alias("answer"))


@query("SELECT conv_id, turn, string_split(text, chr(10))[-1] AS last_line FROM conversations")
def last_line(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.last_line(F.col("text")).alias("last_line"))


def labelled(spark, sf_dir) -> DataFrame:
    """documents with a stance: answer_id, search_query, stance."""
    s = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("answer_id"), F.when(F.col("quality") == 1, "yes").when(F.col("quality") == 0, "no").alias("stance"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("answer_id"), F.col("source").alias("search_query")).join(s, "answer_id")


STANCE = "SELECT d.doc_id AS answer_id, d.source AS search_query, CASE l.quality WHEN 1 THEN 'yes' WHEN 0 THEN 'no' END AS stance FROM documents d JOIN labels l ON d.doc_id = l.doc_id"
THRESH = "q AS (SELECT search_query FROM b WHERE search_query IS NOT NULL GROUP BY search_query HAVING count(*) FILTER (stance = 'yes') >= {k} OR count(*) FILTER (stance = 'no') >= {k}), good AS (SELECT DISTINCT b.answer_id FROM b JOIN q USING (search_query) WHERE stance IN ('yes', 'no'))"


@query(f"WITH b AS ({STANCE}), {THRESH.format(k=18)} SELECT answer_id, search_query, stance FROM b WHERE answer_id IN (SELECT answer_id FROM good)")
def filter_pair_thresh(spark, sf_dir):
    return R.filter_pair_thresh(labelled(spark, sf_dir), 18, "stance")[0].select("answer_id", "search_query", "stance")


ANSWER_A = "CASE WHEN quality = 1 THEN 'Yes.' WHEN quality = 0 THEN 'It is not so: No' END"
ANSWER_B = "CASE WHEN toxic = 1 THEN 'Hm' || chr(10) || 'not clear' WHEN quality = 1 THEN 'not sure' || chr(10) || 'YES' ELSE 'yes or' || chr(10) || 'No.' END"
#: Labels of both sides as parsed: a looks for yes, then no, anywhere; b for not, yes, no in the last line.
AGREED = "SELECT doc_id AS answer_id, CASE quality WHEN 1 THEN 'yes' WHEN 0 THEN 'no' END AS stance FROM labels WHERE toxic <> 1 AND quality IN (0, 1)"


def answers(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    labels = table(spark, sf_dir, "labels")
    return tuple(labels.select(F.col("doc_id").alias("answer_id"), F.expr(sql.replace("chr(10)", "char(10)")).alias("answer")) for sql in (ANSWER_A, ANSWER_B))


@query(f"SELECT answer_id FROM ({AGREED})")
def ensemble_match(spark, sf_dir):
    a, b = answers(spark, sf_dir)
    a = a.select("answer_id", T.classify(F.col("answer"), T.SHORT_CLASSES).alias("label_a"))
    b = b.select("answer_id", T.classify(T.last_line(F.col("answer")), T.FULL_CLASSES).alias("label_b"))
    return R.agreed_ids(a, b)


ENSEMBLE = f"WITH b AS (SELECT s.answer_id, d.source AS search_query, s.stance FROM ({AGREED}) s JOIN documents d ON d.doc_id = s.answer_id), {THRESH.format(k=5)}"


@query(f"{ENSEMBLE} SELECT answer_id, search_query, stance FROM b WHERE answer_id IN (SELECT answer_id FROM good)")
def ensemble_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("answer_id"), F.col("source").alias("search_query"))
    return pipeline.ensemble_filter(pages, *answers(spark, sf_dir)).select("answer_id", "search_query", "stance")


@query(f"{ENSEMBLE.replace('b AS', 'c AS').replace(' FROM b', ' FROM b') .replace('q AS (', 'b AS (SELECT * FROM c WHERE search_query NOT IN (' + chr(39) + 'src1' + chr(39) + ', ' + chr(39) + 'src7' + chr(39) + ')), q AS (')} SELECT answer_id, search_query, stance FROM b WHERE answer_id IN (SELECT answer_id FROM good)")
def dedup_filter(spark, sf_dir):
    pages = ensemble_filter(spark, sf_dir)
    return pipeline.dedup_filter(pages, spark.createDataFrame([("src1",), ("src7",)], "search_query string"))


@query("SELECT doc_id, source FROM documents WHERE source NOT IN ('src1', 'src7') OR source IS NULL")
def dedup_queries(spark, sf_dir):
    bad = spark.createDataFrame([("src1",), ("src7",)], "search_query string")
    return R.drop_ids(table(spark, sf_dir, "documents").select("doc_id", "source"), bad, "source", "search_query")


def neighbours(spark, sf_dir) -> DataFrame:
    """Pairs of labelled documents with consecutive ids: answer_id, tokens and quality of both sides."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", T.num_tokens(F.col("text")).cast("double").alias("f"), F.col("quality").cast("double").alias("p"))
    a, b = (d.select(*(F.col(c).alias(f"{n}_{i}") for c, n in (("doc_id", "answer_id"), ("f", "f")))  , F.col("p").alias(f"eval_{i}_prob")) for i in (1, 2))
    return a.join(b, F.col("answer_id_1") + 1 == F.col("answer_id_2"))


PAIRS = "WITH d AS (SELECT doc_id, CAST(len(string_split(text, ' ')) AS DOUBLE) AS f, CAST(quality AS DOUBLE) AS p FROM documents JOIN labels USING (doc_id)), pairs AS (SELECT a.doc_id AS answer_id_1, b.doc_id AS answer_id_2, a.f AS f_1, b.f AS f_2, a.p AS p1, b.p AS p2 FROM d a JOIN d b ON a.doc_id + 1 = b.doc_id)"
TOXIC = "(SELECT doc_id FROM labels WHERE toxic = 1)"


def toxic_ids(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("answer_id"))


@query(f"{PAIRS} SELECT answer_id_1, answer_id_2 FROM pairs WHERE answer_id_1 NOT IN {TOXIC} AND answer_id_2 NOT IN {TOXIC}")
def filter_by_id_blacklist(spark, sf_dir):
    pages = labelled(spark, sf_dir)
    return R.filter_by_id(pages, neighbours(spark, sf_dir), toxic_ids(spark, sf_dir))[1].select("answer_id_1", "answer_id_2")


@query(f"SELECT doc_id AS answer_id FROM documents JOIN labels USING (doc_id) WHERE doc_id IN {TOXIC}")
def filter_by_id_whitelist(spark, sf_dir):
    return R.filter_by_id(labelled(spark, sf_dir), neighbours(spark, sf_dir), toxic_ids(spark, sf_dir), True)[0].select("answer_id")


@query(f"{PAIRS} SELECT f_1 - f_2 AS x, p1 - p2 AS y FROM pairs")
def paired_data(spark, sf_dir):
    return R.paired(neighbours(spark, sf_dir), "f")


@query(f"{PAIRS} SELECT f_1 AS x, p1 AS y FROM pairs UNION ALL SELECT f_2, p2 FROM pairs")
def singular_data(spark, sf_dir):
    return R.singular(neighbours(spark, sf_dir), "f")


@query("SELECT lang AS category, source AS search_query, 'yes_statement' AS search_type, text AS search_engine_input FROM documents UNION ALL SELECT lang, source, 'no_statement', CASE WHEN doc_id % 2 = 0 THEN lower(text) END FROM documents")
def unpivot_statements(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return R.unpivot_statements(d.select(F.col("lang").alias("category"), F.col("source").alias("search_query"), F.col("text").alias("yes_statement"), F.expr("if(doc_id % 2 = 0, lower(text), null)").alias("no_statement")))


WINDOWS = "SELECT doc_id, i, list_slice(t, CAST(i * 256 + 1 AS BIGINT), CAST(i * 256 + 508 AS BIGINT)) AS w FROM (SELECT doc_id, t, unnest(range(0, greatest(0, CAST(floor((len(t) - 508) / 256.0) AS BIGINT)) + 1)) AS i FROM (SELECT doc_id, string_split(text, ' ') AS t FROM documents))"


@query(f"SELECT doc_id, CAST(i AS BIGINT) AS at, CAST(len(w) AS BIGINT) AS size, md5(array_to_string(w, ' ')) AS digest FROM ({WINDOWS})")
def token_windows(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.windows(T.space_tokens(F.col("text")))).alias("at", "w"))
    return w.select("doc_id", long(F.col("at")).alias("at"), long(F.size("w")).alias("size"), F.md5(F.array_join("w", " ")).alias("digest"))


@query(f"SELECT doc_id, CAST(arg_max(i, s * 100000 - i) AS BIGINT) AS at, max(s) AS score FROM (SELECT doc_id, i, CAST(length(array_to_string(w, ' ')) AS DOUBLE) AS s FROM ({WINDOWS})) GROUP BY doc_id")
def best_text_window(spark, sf_dir):
    """The longest window by characters, the first on ties."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = d.select("doc_id", F.transform(T.windows(T.space_tokens(F.col("text"))), lambda w: F.struct(F.length(F.array_join(w, " ")).cast("double").alias("score"), w.alias("window"))).alias("scored"))
    b = T.best_window(F.col("scored"))
    return scored.select("doc_id", long(-b["at"]).alias("at"), b["score"].alias("score"))


@query(
    "WITH q AS (SELECT label, min(vec_id) AS query_id FROM embeddings WHERE label IS NOT NULL GROUP BY label), s AS (SELECT e.label, e.vec_id, round(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(f.embedding AS DOUBLE[])), 6) AS score FROM embeddings e JOIN q USING (label) JOIN embeddings f ON f.vec_id = q.query_id) "
    "SELECT label, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS r FROM s) WHERE r = 1"
)
def best_window_by_dot(spark, sf_dir):
    """For each label, the encoding that is closest to that of its first vector."""
    e = table(spark, sf_dir, "embeddings")
    first = e.filter("label is not null").groupBy("label").agg(F.min(F.struct("vec_id", F.col("embedding").alias("query"))).alias("q")).select("label", "q.query")
    s = e.join(first, "label").select("label", "vec_id", F.round(T.dot(F.col("embedding"), F.col("query")), 6).alias("score"))
    return s.groupBy("label").agg(F.max(F.struct("score", (-F.col("vec_id")).alias("v"))).alias("b")).select("label", (-F.col("b.v")).alias("vec_id"), F.col("b.score").alias("score"))


PLAIN = "regexp_replace(lower({}), '[^a-zA-Z0-9\\s]', ' ', 'g')"
for _a, _b in T.CONTRACTIONS:
    PLAIN = f"regexp_replace({PLAIN}, '\\b{_a}{_b}\\b', '{_a} {_b}', 'g')"
NORMAL = f"list_filter(regexp_split_to_array({PLAIN}, '\\s+'), lambda w: w <> '')"


def asked(spark, sf_dir) -> DataFrame:
    """documents, each with one benchmark item as its query, whatever the ids are; a null query if there are no items."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("search_query"))
    items = R.dense_ids(items, ["item_id", "search_query"], "_number")
    n = F.lit(items.count() or None).cast("long")
    return table(spark, sf_dir, "documents").join(items, F.pmod(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), n) == F.col("_number"), "left").drop("_number")


ASKED = "documents d JOIN benchmark i ON d.doc_id % (SELECT count(*) FROM benchmark) = i.item_id"


@query(
    f"WITH b AS (SELECT d.doc_id, {NORMAL.format('d.text')} AS t, {NORMAL.format('i.text')} AS q FROM {ASKED}), words AS (SELECT unnest(t) AS w FROM b UNION SELECT unnest(q) FROM b), {stems('words')}, "
    "t AS (SELECT doc_id, stem, i FROM (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM b) JOIN stems USING (w)), "
    "q AS (SELECT doc_id, stem, j FROM (SELECT doc_id, unnest(q) AS w, generate_subscripts(q, 1) AS j FROM b) JOIN stems USING (w)), "
    "m AS (SELECT doc_id, i - j AS shift, i - row_number() OVER (PARTITION BY doc_id, i - j ORDER BY i) AS run FROM t JOIN q USING (doc_id, stem)), "
    "n AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, shift, run, count(*) AS n FROM m GROUP BY doc_id, shift, run) GROUP BY doc_id) "
    "SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n FROM b LEFT JOIN n USING (doc_id)"
)
def max_ngram_overlap(spark, sf_dir):
    """Of stems."""
    d = asked(spark, sf_dir)
    return d.select("doc_id", long(F.size(longest_common_ngram(T.normal_words(F.col("text")), T.normal_words(F.col("search_query"))))).alias("n"))


ANSWERS = "Yes 1: Red wine is good\nYes 2: Wine: helps\nNo 1: Red wine is bad\nNote: skip me\nno colon\nNo 2:"
LINES = "string_split(a, chr(10))"
AFTER = "list_filter(list_transform(list_filter({0}, lambda x: {1}), lambda x: CASE WHEN contains(x, ':') THEN trim(substr(x, instr(x, ':') + 1)) ELSE '' END), lambda x: x <> '')"


@query(
    "WITH c AS (SELECT conv_id, turn, text || chr(10) || '" + ANSWERS.replace("\n", "' || chr(10) || '") + "' AS a FROM conversations) SELECT conv_id, turn, array_to_string("
    + AFTER.format(LINES, "starts_with(lower(x), 'yes')") + ", '. ') AS yes_statement, array_to_string(" + AFTER.format(LINES, "starts_with(lower(x), 'no')") + ", '. ') AS no_statement FROM c"
)
def statement_parse(spark, sf_dir):
    a = F.concat(F.col("text"), F.lit("\n" + ANSWERS))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.statements(a, "yes").alias("yes_statement"), T.statements(a, "no").alias("no_statement"))


@query("SELECT conv_id, turn, l AS search_query FROM (SELECT conv_id, turn, unnest(string_split(replace(text, '.', '?'), chr(10))) AS l FROM conversations) WHERE trim(l) <> '' AND NOT contains(l, '\"\"\"') AND NOT contains(l, '```') AND contains(l, '?')")
def question_filter(spark, sf_dir):
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.split(F.replace("text", F.lit("."), F.lit("?")), "\n", -1)).alias("search_query"))
    return lines.filter(T.is_question(F.col("search_query")))


SENTENCES = "string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"


@query(
    f"WITH s AS (SELECT doc_id, {SENTENCES} AS p FROM documents), k AS (SELECT doc_id, p, list_filter(p, lambda x: trim(x) <> '') AS k FROM s), f AS (SELECT doc_id, p, k, CASE WHEN len(k) > 0 AND regexp_matches(trim(k[1]), '^[\\p{{Ll}}.,;:!?]') THEN k[2:] ELSE k END AS r FROM k) "
    "SELECT doc_id, CASE WHEN len(p) < 2 THEN array_to_string(p, ' ') WHEN len(r) > 0 AND regexp_matches(trim(r[-1]), '[\\p{L}\\p{N}]$') THEN coalesce(array_to_string(r[1:len(r)-1], ' '), '') ELSE coalesce(array_to_string(r, ' '), '') END AS text FROM f"
)
def sentence_trim(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.trim_sentences(T.sentences(F.col("text")))["text"].alias("text"))


@query("SELECT event_id, CAST(s AS BIGINT) AS start FROM (SELECT event_id, unnest(range(1, greatest(least(CAST(value AS INTEGER), 100), 1), 10)) AS s FROM (SELECT event_id, round(value) AS value FROM events))")
def search_pages(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.expr("cast(round(value) as int)").alias("n"))
    return e.select("event_id", F.explode(T.page_starts(F.col("n")).cast("array<bigint>")).alias("start"))


@query("SELECT url, CAST(row_number() OVER (ORDER BY url, page_id) - 1 AS BIGINT) AS doc_id FROM pages")
def assign_doc_id(spark, sf_dir):
    return R.dense_ids(table(spark, sf_dir, "pages").select("url", "page_id"), ["url", "page_id"]).select("url", "doc_id")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.link') AS link FROM events")
def json_field(spark, sf_dir):
    p = F.from_json("props", "struct<k:bigint,link:string>")
    return table(spark, sf_dir, "events").select("event_id", p["k"].alias("k"), p["link"].alias("link"))


@query("SELECT event_id, event_type AS title, '{\"title\":\"' || event_type || '\",\"rank\":7}' AS request_dump FROM events WHERE event_type IS NOT NULL")
def parse_hits(spark, sf_dir):
    """Responses with one item, made from events; those without items give no rows. The dump is the whole item, a field that the table lacks too."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type").isNotNull(), F.to_json(F.struct(F.array(F.struct(F.col("event_type").alias("title"), F.lit(7).alias("rank"))).alias("items")))).otherwise("{}").alias("response"))
    return connectors.parse_hits(e).select("event_id", "title", "request_dump")


@query("SELECT doc_id, round(ln(greatest(quality, 0.001)), 6) AS positive, round(ln(greatest(1 - quality, 0.001)), 6) AS negative FROM labels")
def label_map(spark, sf_dir):
    p = F.greatest(F.col("quality").cast("double"), F.lit(0.001))
    n = F.greatest(1 - F.col("quality").cast("double"), F.lit(0.001))
    m = table(spark, sf_dir, "labels").select("doc_id", F.map_from_arrays(F.array(F.lit("Positive"), F.lit("Negative")), F.array(F.ln(p), F.ln(n))).alias("m"))
    return m.select("doc_id", F.round(F.col("m")["Positive"], 6).alias("positive"), F.round(F.col("m")["Negative"], 6).alias("negative"))


@query("WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS h FROM pages) SELECT page_id, string_split(h, '.')[-1] AS tld, string_split(h, '.')[-2] AS domain FROM h")
def domain_suffix(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.suffix(F.col("url")).alias("tld"), T.domain(F.col("url")).alias("domain"))


@query("SELECT l_orderkey, o_orderpriority, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def merge_1m(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return R.one_to_many(orders, table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey"]).select("l_orderkey", "o_orderpriority", "l_linenumber", "l_quantity")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_antijoin(spark, sf_dir):
    return R.unseen(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


STORED = "CASE WHEN page_id % 5 = 0 THEN url || '.pdf' WHEN page_id % 7 <> 0 THEN url END"


@query(
    f"WITH p AS (SELECT page_id, {STORED} AS u FROM pages), f AS (SELECT url, min(html) AS html FROM (SELECT url, html FROM pages UNION ALL SELECT url || '.pdf', html FROM pages) GROUP BY url) "
    "SELECT page_id, CASE WHEN NOT ends_with(u, '.pdf') THEN f.html END AS html FROM p LEFT JOIN f ON f.url = p.u"
)
def fetch_offline(spark, sf_dir):
    """Every page's url looked up in a store that holds it and a PDF of its name; some urls are PDFs and some missing."""
    p = table(spark, sf_dir, "pages")
    stored = p.select("url", "html").unionByName(p.select(F.concat("url", F.lit(".pdf")).alias("url"), "html"))
    return connectors.fetch_offline(p.select("page_id", F.expr(STORED).alias("url")), stored).select("page_id", "html")


@query("SELECT '[' AS line UNION ALL SELECT CASE WHEN doc_id = (SELECT min(doc_id) FROM labels) THEN '' ELSE ',' END || doc_id FROM labels UNION ALL SELECT ']'")
def id_list(spark, sf_dir):
    return io.id_list(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("answer_id")))


@query(f"WITH words AS (SELECT unnest({NORMAL.format('text')}) AS w FROM benchmark), {stems('words')} SELECT stem, array_to_string(list_sort(list(w)), ' ') AS words FROM stems GROUP BY stem")
def stem_vocab(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select(F.explode(T.normal_words(F.col("text"))).alias("word"))
    return R.inverted_index(words, stem_word(F.col("word")), "word").select("stem", F.array_join("words", " ").alias("words"))


@query()
def quote_shared(spark, sf_dir):
    d = asked(spark, sf_dir)
    pair = quote_shared_words(F.col("search_query"), F.col("text"))
    return d.select("doc_id", pair["one"].alias("search_query"))


SYLLABLES = "CAST(list_sum(list_transform(w, lambda x: greatest(len(regexp_extract_all(lower(x), '[aeiouy]+')), 1))) AS DOUBLE)"


@query(f"SELECT doc_id, round(CASE WHEN len(w) < 100 THEN 0.0 ELSE 0.39 * len(w) / greatest(len(regexp_extract_all(text, '[.!?]+(\\s|$)')), 1) + 11.8 * {SYLLABLES} / len(w) - 15.59 END, 6) AS grade FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents)")
def readability(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.readability(F.col("text")), 6).alias("grade"))


@query()
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", boilerplate.main_text(F.col("html")).alias("text"))


@query()
def st_similarity(spark, sf_dir):
    return asked(spark, sf_dir).select("doc_id", F.round(features.similarity(F.col("text"), F.col("search_query"), F.lit(None)), 9).alias("score"))


def _hits(words: list[str]) -> str:
    return f"len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in words)})))"


@query(f"SELECT doc_id, round(ln(p / (p + n)) + ln(2.0 / 3), 6) AS positive, round(ln(n / (p + n)) + ln(2.0 / 3), 6) AS negative FROM (SELECT doc_id, {_hits(features.POSITIVE)} + 1.0 AS p, {_hits(features.NEGATIVE)} + 1.0 AS n FROM (SELECT doc_id, {NORMAL.format('text')} AS w FROM documents))")
def sentiment(spark, sf_dir):
    m = table(spark, sf_dir, "documents").select("doc_id", features.sentiment(F.col("text"), None, None).alias("m"))
    return m.select("doc_id", F.round(F.col("m")["Positive"], 6).alias("positive"), F.round(F.col("m")["Negative"], 6).alias("negative"))


@query(
    f"WITH w AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest({NORMAL.format('text')}) AS w FROM documents) GROUP BY doc_id, w), m AS (SELECT w, sum(n) AS c FROM w GROUP BY w), t AS (SELECT sum(c) AS t, count(*) AS v FROM m) "
    "SELECT doc_id, round(exp(-sum(n * ln((c + 1.0) / (t + v))) / sum(n)), 4) AS perplexity FROM w JOIN m USING (w), t GROUP BY doc_id"
)
def perplexity(spark, sf_dir):
    # Rounded as the SQL rounds: the binary value times 10,000, not its decimal digits.
    rounded = F.floor(F.col("perplexity") * 10000 + 0.5) / 10000
    return features.token_perplexity(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", rounded.alias("perplexity"))


@query()
def add_features(spark, sf_dir):
    d = asked(spark, sf_dir).select("doc_id", "text", "search_query")
    return features.add_features(d, features.DRIVER).drop("text", "search_query")


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM documents")
def row_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("n"))


def _score(a: str, b: str) -> str:
    """SQL for the dot product of models.CountEncoder's encodings."""
    count = lambda x, c: f"CAST(length({x}) - length(replace({x}, '{c}', '')) AS DOUBLE)"
    return " + ".join(f"{count(a, c)} * {count(b, c)}" for c in models.CountEncoder().characters)


@query(
    f"WITH w AS (SELECT doc_id, i, array_to_string(w, ' ') AS w FROM ({WINDOWS})), q AS (SELECT d.doc_id, i.text AS q FROM {ASKED}), s AS (SELECT doc_id, i, w, {_score('w', 'q')} AS score FROM w JOIN q USING (doc_id)) "
    "SELECT doc_id, md5(w) AS digest, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS r FROM s) WHERE r = 1"
)
def best_window_model(spark, sf_dir):
    """The best window by a tokenizer and an encoder that the caller gives."""
    best = models.best_windows(asked(spark, sf_dir), models.SpaceTokenizer(), models.CountEncoder())
    return best.select("doc_id", F.md5("text_thresh_window").alias("digest"), F.col("text_thresh_window_score").alias("score"))


@query(f"WITH t AS ({ORACLE['sentence_trim']}), q AS (SELECT d.doc_id, i.text AS q FROM {ASKED}) SELECT doc_id, md5(text) AS digest, {_score('text', 'q')} AS score FROM t JOIN q USING (doc_id)")
def trim_rescore(spark, sf_dir):
    out = models.trim_rescored(asked(spark, sf_dir).withColumnRenamed("text", "text_thresh_window"), models.CountEncoder())
    return out.select("doc_id", F.md5("text_thresh_window_sent").alias("digest"), F.col("score_sent").alias("score"))


@query(
    "SELECT doc_id, CASE WHEN contains(lower(text), 'not') THEN 'not' WHEN contains(lower(text), 'yes') THEN 'yes' WHEN contains(lower(text), 'no') THEN 'no' END AS first, "
    "CASE WHEN length(text) % 2 = 0 THEN 'yes' ELSE 'no' END AS second FROM documents"
)
def label_both(spark, sf_dir):
    """Two labellers over the same prompt; one answers with the text itself, the other by its length."""

    class Parrot:
        def complete(self, prompt: str) -> str:
            return prompt.split("\nText: ", 1)[1]

    class Ruler:
        def complete(self, prompt: str) -> str:
            return "Yes." if len(prompt.split("\nText: ", 1)[1]) % 2 == 0 else "No."

    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit("q").alias("search_query"))
    out = pipeline.labelled_by(d, {"first": Parrot(), "second": Ruler()}, "text")
    return out.select("doc_id", *(T.classify(F.col(c), T.FULL_CLASSES).alias(c) for c in ("first", "second")))


def scratch(name: str) -> str:
    return f"{R.shared_folder(SparkSession.active())}/{name}-{uuid.uuid4().hex}"


@query(
    "SELECT c_mktsegment AS search_query, c_name AS search_engine_input, 'http://h/' || o_orderkey AS url, o_orderstatus AS title, "
    "CAST(row_number() OVER (ORDER BY c_custkey % 2, c_mktsegment, c_name, 'http://h/' || o_orderkey) - 1 AS BIGINT) AS doc_id FROM customer JOIN orders ON o_custkey = c_custkey"
)
def search_table(spark, sf_dir):
    """Customers as search inputs, their orders as hits; a second run goes on from the first, which had even customers only."""
    inputs = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("search_query"), F.col("c_name").alias("search_engine_input"))
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.concat(F.lit("http://h/"), "o_orderkey").alias("url"), F.col("o_orderstatus").alias("title"), F.lit("").alias("snippet"), F.lit("{}").alias("request_dump"))
    hits = inputs.join(orders, F.col("o_custkey") == F.col("c_custkey")).drop("o_custkey", "c_custkey", "search_query")
    ask = lambda lacking: lacking.join(hits, "search_engine_input")
    path = scratch("hits")
    pipeline.search_table(spark, path, inputs.filter("c_custkey % 2 = 0"), ask)
    return pipeline.search_table(spark, path, inputs, ask).select("search_query", "search_engine_input", "url", "title", "doc_id")


class Echo:
    """A fetcher without a network: a page that names its url; urls of odd length fail."""

    def __enter__(self):
        return self

    def __exit__(self, *error):
        pass

    def fetch(self, url: str) -> str | None:
        return f"<p>{url}" if len(url) % 2 == 0 else None


@query(f"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN html WHEN NOT ends_with(u, '.pdf') AND length(u) % 2 = 0 THEN '<p>' || u END AS html FROM (SELECT *, {STORED} AS u FROM pages)")
def fetch_resumed(spark, sf_dir):
    """A third of the pages is stored already, PDFs among them; the rest is fetched."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "html", F.expr(STORED).alias("url"))
    path = scratch("stored")
    io.write_pages(p.filter("doc_id % 3 = 0").select("doc_id", "html"), path)
    return connectors.fetch_resumed(p.drop("html"), path, Echo()).select(F.col("doc_id").alias("page_id"), "html")


@query()
def build_dataset(spark, sf_dir):
    """Statements of the conversations' first turns to the main texts of 20 tokens or more; each side's hit is a page chosen by its hash."""
    c = table(spark, sf_dir, "conversations").filter("turn = 0 and text is not null").select(F.col("conv_id").cast("string").alias("category"), F.concat("text", F.lit(" "), "conv_id").alias("search_query"))
    c = c.dropDuplicates(["search_query"]).withColumn("model_answer", F.concat(F.lit("Yes 1: "), "search_query", F.lit("\nNo 1: not "), "search_query"))
    p = R.dense_ids(table(spark, sf_dir, "pages").select("page_id", "url", "html"), ["page_id", "url"], "number")
    n = F.lit(p.count() or None).cast("long")
    web = p.select("number", "url", F.lit("").alias("title"), F.lit("").alias("snippet"), F.lit("{}").alias("request_dump"))
    ask = lambda lacking: lacking.join(web, F.pmod(F.xxhash64("search_engine_input"), n) == F.col("number")).drop("number")
    hits, stored = scratch("hits"), scratch("stored")
    found = pipeline.search_table(spark, hits, pipeline.search_inputs(c), ask)
    io.write_pages(found.join(p.groupBy("url").agg(F.min("html").alias("html")), "url").select("doc_id", "html"), stored)
    return pipeline.build_dataset(spark, c, hits, stored, ask, None, 20).drop("request_dump", "title", "snippet")


@query("SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 3")
def top_rows(spark, sf_dir):
    """The three longest documents of each source."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return R.top_rows(d, ["source"], [F.desc("n_chars"), F.asc("doc_id")], 3)


@query("SELECT a.l_orderkey, a.l_linenumber AS l_linenumber_1, b.l_linenumber AS l_linenumber_2, a.l_quantity AS l_quantity_1, b.l_quantity AS l_quantity_2 FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber")
def pairs_within(spark, sf_dir):
    """Pairs of lines of an order."""
    return R.pairs_within(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", ["l_quantity"])


@query(
    "WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents), n AS (SELECT count(*) AS n FROM documents), p AS (SELECT CAST(i AS INTEGER) AS part, i * n // 7 AS a, (i + 1) * n // 7 AS b FROM range(7) r(i), n) "
    "SELECT doc_id, part, 'folder/' || part || '/' || doc_id || '.html' AS path FROM d JOIN p ON k >= a AND k < b"
)
def range_parts(spark, sf_dir):
    """Seven ranges of the documents by id, and a path for each."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    part = R.range_part(F.col("_k"), F.lit(d.count()), 7)
    d = R.dense_ids(d, ["doc_id"], "_k").select("doc_id", part.alias("part"))
    return d.withColumn("path", connectors.page_path(F.concat(F.lit("folder/"), F.col("part").cast("string")), F.col("doc_id")))


@query(f"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN left(html, 200) WHEN NOT ends_with(u, '.pdf') AND length(u) % 2 = 0 THEN '<p>' || u END AS html FROM (SELECT *, {STORED} AS u FROM pages)")
def fetch_committed(spark, sf_dir):
    """Pages fetched in committed ranges by two runs: the first one has a third of the ids, and of those a part fails, which the second one fetches with the rest."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "html", F.expr(STORED).alias("url"))
    path = scratch("committed")

    def third(rows: pa.Table) -> pa.Table:
        if any(i % 300 == 0 for i in rows["doc_id"].to_pylist()):
            raise OSError("no connection")
        return rows.append_column("cut", pa.array([False] * rows.num_rows))

    first = p.filter("doc_id % 3 = 0").select("doc_id", F.left("html", F.lit(200)).alias("html"))
    ranges.run_ranges(ranges.numbered(first, 20), path, third, strict=False)
    ranges.run_ranges(ranges.numbered(R.drop_ids(first, ranges.committed(spark, path, fetching.PAGE), "doc_id", "doc_id"), 20), path, lambda rows: rows.append_column("cut", pa.array([False] * rows.num_rows)))
    return fetching.fetch_committed(p.drop("html"), path, Echo(), fetching.Manners(delay=0), 50).select(F.col("doc_id").alias("page_id"), "html")


@query(
    "SELECT c_mktsegment AS search_query, c_name AS search_engine_input, CAST(s AS INTEGER) AS start, CAST(s + r - 1 AS INTEGER) AS position, 'http://h/' || o_orderkey AS url, o_orderstatus AS title FROM ("
    "SELECT c_mktsegment, c_name, o_orderkey, o_orderstatus, 1 + 10 * ((row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) - 1) // 10) AS s, 1 + (row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) - 1) % 10 AS r "
    "FROM customer JOIN orders ON o_custkey = c_custkey) WHERE s < 20"
)
def search_source(spark, sf_dir):
    """Customers as search inputs; stored responses have their orders, ten a page, of which two pages are asked for."""
    path = scratch("search")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("search_query"), F.col("c_name").alias("search_engine_input"))
    c.write.parquet(f"{path}/inputs")
    o = c.join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.withColumn("k", F.row_number().over(Window.partitionBy("c_custkey").orderBy("o_orderkey")) - 1).withColumn("start", (F.floor(F.col("k") / 10) * 10 + 1).cast("int"))
    items = o.groupBy("search_engine_input", "start").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat(F.lit("http://h/"), "o_orderkey").alias("link"), F.col("o_orderstatus").alias("title")))), lambda x: F.struct(x["link"].alias("link"), x["title"].alias("title"))).alias("items"))
    stored = items.select("search_engine_input", "start", F.lit(200).alias("status"), F.to_json(F.struct("items")).alias("response"))
    # Sorted in row groups of 1 MB, so that a partition of the search reads little but its own inputs' responses.
    stored.repartitionByRange("search_engine_input", "start").sortWithinPartitions("search_engine_input", "start").write.option("parquet.block.size", 1 << 20).parquet(f"{path}/responses")
    service.register(spark)
    return spark.read.format("search").options(inputs=f"{path}/inputs", responses=f"{path}/responses", num_results="20").load().select("search_query", "search_engine_input", "start", "position", "url", "title")


@query("SELECT source AS category, 'Is ' || source || ' good?' AS search_query FROM (SELECT DISTINCT source FROM documents) UNION ALL SELECT source, '2. Why ' || source || '?' FROM (SELECT DISTINCT source FROM documents)")
def generate_questions(spark, sf_dir):
    """Questions about each source, written by a model that also writes lines that are no questions."""

    class Writer:
        def complete(self, prompt: str) -> str:
            topic = prompt.split("about ", 1)[1].split(" on which")[0]
            return f"Here you are\n\nIs {topic} good?\n```?```\n2. Why {topic}?"

    topics = table(spark, sf_dir, "documents").select(F.col("source").alias("category")).distinct()
    return pipeline.generated_questions(topics, Writer(), delay=0).select("category", "search_query")


#: Rules of the queries' public suffixes, and urls that they tell apart.
RULES = ["com", "net", "org", "io", "de", "fr", "es", "uk", "co.uk", "ck", "*.ck", "!www.ck"]
RULED = "CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN 'http://' || h || '.co.uk/' WHEN 2 THEN 'http://' || h || '.ck/' WHEN 3 THEN 'http://a.www.ck/' WHEN 4 THEN 'http://10.0.0.' || page_id % 250 || '/' ELSE 'http://' || h || '.zzz/' END"


@query(
    f"WITH p AS (SELECT page_id, {RULED} AS u FROM (SELECT *, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS h FROM pages)), h AS (SELECT page_id, string_split(lower(regexp_extract(u, '^[a-z]+://([^/?#]+)', 1)), '.') AS l FROM p), "
    f"rules(rule) AS (VALUES {', '.join(f'({r!r})' for r in RULES)}), e AS (SELECT page_id, l, i, array_to_string(l[i:], '.') AS e, array_to_string(l[i + 1:], '.') AS b FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM h WHERE NOT regexp_matches(array_to_string(l, '.'), '^[0-9.]+$'))), "
    "m AS (SELECT page_id, max(CASE WHEN rule[1] <> '!' THEN len(l) - i + 1 END) AS rule, max(CASE WHEN rule[1] = '!' THEN len(l) - i END) AS exception FROM e JOIN rules ON rule = e OR rule = '*.' || b OR rule = '!' || e GROUP BY page_id), "
    "n AS (SELECT page_id, l, coalesce(exception, rule, 0) AS n FROM h LEFT JOIN m USING (page_id)) "
    "SELECT page_id, array_to_string(l[len(l) - n + 1:], '.') AS tld, CASE WHEN regexp_matches(array_to_string(l, '.'), '^[0-9.]+$') THEN array_to_string(l, '.') ELSE coalesce(l[len(l) - n], '') END AS domain FROM n"
)
def domain_suffix_rules(spark, sf_dir):
    """Public suffixes by rules with a wildcard and an exception."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", T.host(F.col("url")).alias("h")).select("page_id", F.expr(RULED).alias("url"))
    return urls.with_suffixes(p, spark.createDataFrame([(r,) for r in RULES], "rule string")).select("page_id", F.col("_tld").alias("tld"), F.col("_domain").alias("domain"))


EDGES = sentences.EDGES.replace("'", "''")
SENTENCE_WORDS = f"list_filter(list_transform(regexp_split_to_array(text, '\\s+'), lambda w: regexp_replace(w, '{EDGES}', '', 'g')), lambda w: w <> '')"
LIKELY = "({k} * ln(greatest(least({p}, 1 - 1e-12), 1e-12)) + ({n} - {k}) * ln(1 - greatest(least({p}, 1 - 1e-12), 1e-12)))"
COUNTED = (
    f"w AS (SELECT unnest({SENTENCE_WORDS}) AS w FROM documents), c AS (SELECT lower(regexp_replace(w, '[.!?]+$', '')) AS type, count(*) FILTER (ends_with(w, '.')) AS periods, count(*) FILTER (NOT ends_with(w, '.')) AS plain "
    "FROM w WHERE regexp_matches(w, '\\p{L}') GROUP BY 1 HAVING type <> '')"
)
ABBREVIATIONS = (
    "s AS (SELECT *, CAST(periods AS DOUBLE) AS k, CAST(periods + plain AS DOUBLE) AS n, (SELECT sum(periods) / sum(periods + plain) FROM c) AS p, length(type) - length(replace(type, '.', '')) AS inner_periods FROM c WHERE periods > 0), "
    f"a AS (SELECT type, periods, plain, -2 * ({LIKELY.format(k='k', n='n', p='p')} - {LIKELY.format(k='k', n='n', p='0.99')}) * exp(-(length(type) - inner_periods)) * (inner_periods + 1) * pow(length(type) - inner_periods, -CAST(plain AS DOUBLE)) AS score FROM s)"
)


@query(f"WITH {COUNTED}, {ABBREVIATIONS} SELECT type, periods, plain, round(score, 6) AS score FROM a WHERE score >= {sentences.ABBREVIATION}")
def abbreviations(spark, sf_dir):
    """Words that the texts' own statistics take for abbreviations."""
    found = sentences.abbreviations(sentences.counted(table(spark, sf_dir, "documents")))
    return found.select("type", "periods", "plain", F.round("score", 6).alias("score"))


@query(
    f"WITH {COUNTED}, {ABBREVIATIONS}, p AS (SELECT doc_id, {SENTENCES} AS p FROM documents), j AS (SELECT doc_id, i, lower(regexp_replace(regexp_replace(string_split_regex(p[i], '\\s')[-1], '{EDGES}', '', 'g'), '\\.$', '')) AS last FROM (SELECT doc_id, p, unnest(range(1, len(p))) AS i FROM p) WHERE ends_with(p[i], '.')), "
    f"g AS (SELECT doc_id, count(*) AS held FROM j WHERE last IN (SELECT type FROM a WHERE score >= {sentences.ABBREVIATION}) OR regexp_matches(last, '^\\p{{L}}$') GROUP BY doc_id) "
    "SELECT doc_id, CAST(len(p) - coalesce(held, 0) AS BIGINT) AS n FROM p LEFT JOIN g USING (doc_id)"
)
def learned_sentences(spark, sf_dir):
    """How many sentences the documents have when those abbreviations end none."""
    d = table(spark, sf_dir, "documents")
    known = sentences.abbreviations(sentences.counted(d))
    return sentences.split_sentences(d, known).select("doc_id", F.size("sentences").cast("long").alias("n"))


#: Pieces are the first one to four characters of the benchmark's words and the one or two characters at each later place.
SUBWORD = subwords.WORD.replace("'", "''")
PIECES = (
    f"b AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{SUBWORD}')) AS w FROM benchmark), vocabulary AS (SELECT DISTINCT left(w, n) AS piece, false AS within FROM b, range(1, 5) AS r(n) UNION "
    "SELECT DISTINCT substr(w, k, n), true FROM (SELECT w, n, unnest(range(2, length(w) + 1)) AS k FROM b, range(1, 3) AS r(n)) WHERE k + n - 1 <= length(w))"
)


@query(
    f"WITH RECURSIVE {PIECES}, e AS (SELECT doc_id, unnest(regexp_extract_all(text, '{SUBWORD}|[{subwords.SPACE}]+')) AS w, generate_subscripts(regexp_extract_all(text, '{SUBWORD}|[{subwords.SPACE}]+'), 1) AS k FROM documents), "
    f"placed AS (SELECT doc_id, w, k, CAST(sum(length(w)) OVER (PARTITION BY doc_id ORDER BY k) - length(w) AS BIGINT) AS pos FROM e), words AS (SELECT DISTINCT w FROM e WHERE regexp_matches(w, '[^{subwords.SPACE}]')), "
    "m(w, a, b) AS (SELECT w, 0, 0 FROM words UNION ALL SELECT w, b, (SELECT b + max(length(piece)) FROM vocabulary WHERE within = (b > 0) AND piece = substr(w, b + 1, length(piece)) AND b + length(piece) <= length(w)) FROM m WHERE b < length(w) AND b IS NOT NULL), "
    "bad AS (SELECT DISTINCT w FROM m WHERE b IS NULL), p AS (SELECT w, a, b FROM m WHERE b > 0 AND w NOT IN (SELECT w FROM bad) UNION ALL SELECT w, 0, length(w) FROM bad), "
    "t AS (SELECT doc_id, pos + a AS s, pos + b AS e, row_number() OVER (PARTITION BY doc_id ORDER BY k, a) - 1 AS i FROM placed JOIN p USING (w)), n AS (SELECT doc_id, length(text) AS size, (SELECT count(*) FROM t WHERE t.doc_id = d.doc_id) AS n FROM documents d WHERE text IS NOT NULL), "
    "f AS (SELECT doc_id, n, size, unnest(CASE WHEN n <= 508 THEN [0] ELSE range(0, n - 507, 256) END) AS first FROM n) "
    'SELECT f.doc_id, CAST(first AS BIGINT) AS first, CAST(least(n, 508) AS BIGINT) AS tokens, CAST(CASE WHEN n <= 508 THEN 0 ELSE a.s END AS BIGINT) AS start, CAST(CASE WHEN n <= 508 THEN size ELSE z.e END AS BIGINT) AS "end" '
    "FROM f LEFT JOIN t a ON a.doc_id = f.doc_id AND a.i = first LEFT JOIN t z ON z.doc_id = f.doc_id AND z.i = first + 507"
)
def subword_windows(spark, sf_dir):
    """Windows of 508 subword tokens as stretches of the documents' characters."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(subwords.WORD), F.lit(0))).alias("w")).distinct()
    heads = words.select(F.expr("explode(transform(sequence(1, 4), n -> left(w, n)))").alias("piece"))
    inner = words.select(F.expr(f"explode(flatten(transform(sequence(1, 2), n -> transform(filter(sequence(2, length(w) + 1), k -> k + n - 1 <= length(w)), k -> concat('{subwords.INNER}', substr(w, k, n))))))").alias("piece"))
    vocabulary = heads.unionByName(inner).distinct().withColumn("id", F.xxhash64("piece"))
    return subwords.subword_windows(table(spark, sf_dir, "documents"), subwords.tokenizer_of(vocabulary)).select("doc_id", "first", "tokens", "start", "end")


@query(
    f"{ENSEMBLE}, e AS (SELECT answer_id FROM b WHERE answer_id IN (SELECT answer_id FROM good)) SELECT 'pages' AS stage, CAST(count(*) AS BIGINT) AS n FROM documents "
    "UNION ALL SELECT 'agreed', count(*) FROM b UNION ALL SELECT 'ensemble', count(*) FROM e"
)
def stage_counts(spark, sf_dir):
    """Rows of the ensemble's stages, counted while its result is written."""
    counts = R.StageCounts()
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("answer_id"), F.col("source").alias("search_query"))
    R.settled(pipeline.ensemble_filter(pages, *answers(spark, sf_dir), counts=counts))
    return spark.createDataFrame(list(counts.rows().items()), "stage string, n long")

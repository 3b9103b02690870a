"""DuckDB SQL for the operators whose results SQL can express in joins: licence scans, ranked search and collocations."""

from __future__ import annotations

from stancemill.llm import collocations, licences

LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def licence_scan() -> str:
    phrase = [(k, i, w) for k, p in enumerate(licences.phrases()) for i, w in enumerate(p.split())]
    label = [(k, name, int(b)) for k, p in enumerate(licences.phrases()) for b, table in ((1, licences.BASE), (0, licences.NAMES)) for q, name in table.items() if p == q]
    keys = [(n, licences.phrases().index(p)) for n, (_, _, some) in enumerate(licences.NOTICES) for p in some]
    notices = [(n, name, len(text.split())) for n, (name, text, _) in enumerate(licences.NOTICES)]
    return f"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
    t AS (SELECT row, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS pos FROM d),
    phrase(id, i, w) AS (VALUES {_values(phrase)}), size AS (SELECT id, count(*) AS size FROM phrase GROUP BY id),
    label(id, name, base) AS (VALUES {_values(label)}), keys(notice, id) AS (VALUES {_values(keys)}),
    notice(notice, name, size) AS (VALUES {_values(notices)}), entry(notice, p, w) AS (VALUES {_values(licences.index_rows())}),
    place AS (SELECT row, id, pos - i AS start FROM t JOIN phrase USING (w) JOIN size USING (id) GROUP BY row, id, pos - i, size HAVING count(*) = size),
    df AS (SELECT w, count(DISTINCT row) AS df FROM t GROUP BY w),
    rare AS (SELECT notice, p, w, idf, sum(idf) OVER (PARTITION BY notice) AS total FROM (SELECT notice, p, e.w, ln(((SELECT count(*) FROM d) + 1.0) / (coalesce(df, 0) + 1)) AS idf,
        row_number() OVER (PARTITION BY notice ORDER BY coalesce(df, 0), p) AS r FROM entry e LEFT JOIN df USING (w)) WHERE r <= {licences.RARE}),
    vote AS (SELECT row, notice, pos - p AS o, p, idf, total FROM t JOIN rare USING (w)),
    fit AS (SELECT row, notice, o, sum(idf) / min(total) AS share FROM (SELECT DISTINCT a.row, a.notice, a.o, b.p, b.idf, b.total FROM vote a JOIN vote b
        ON a.row = b.row AND a.notice = b.notice AND b.o BETWEEN a.o AND a.o + {licences.SLACK}) GROUP BY row, notice, o),
    missing AS (SELECT DISTINCT f.row, f.notice, f.o FROM fit f JOIN keys k USING (notice) JOIN notice n USING (notice)
        WHERE NOT EXISTS (SELECT 1 FROM place q WHERE q.row = f.row AND q.id = k.id AND q.start BETWEEN f.o - {licences.SLACK} AND f.o + n.size + {licences.SLACK})),
    noted AS (SELECT f.row, n.name, max(f.share) AS share FROM fit f ANTI JOIN missing m USING (row, notice, o) JOIN notice n USING (notice) WHERE f.share >= {licences.SHARE} GROUP BY f.row, n.name),
    base AS (SELECT row, count(*) AS n, min(start) AS first, max(start) AS last FROM place JOIN label USING (id) WHERE base = 1 GROUP BY row),
    named AS (SELECT row, name, base, 1.0 AS share FROM place JOIN label USING (id) UNION ALL SELECT row, name, 0, share FROM noted),
    s AS (SELECT row, string_agg(DISTINCT name, ',' ORDER BY name) AS labels, string_agg(DISTINCT name, ',' ORDER BY name) FILTER (base = 1) AS base_labels, max(share) AS score FROM named GROUP BY row)
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(first AS BIGINT) AS first_word, CAST(last AS BIGINT) AS last_word,
        coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(least(1.0, round(coalesce(score, 0), 6)) AS DOUBLE) AS score
    FROM d LEFT JOIN base USING (row) LEFT JOIN s USING (row)"""


RANKED_SEARCH = f"""
    WITH terms(kind, id, key, words) AS (
        SELECT 0, row_number() OVER (), doc_id, regexp_extract_all({LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') FROM documents
        UNION ALL SELECT 1, row_number() OVER (), item_id, regexp_extract_all({LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') FROM benchmark),
    t AS (SELECT id, w, count(*) AS tf FROM (SELECT id, unnest(words) AS w FROM terms WHERE kind = 0) GROUP BY id, w),
    d AS (SELECT id, CAST(sum(tf) AS BIGINT) AS n FROM t GROUP BY id), total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM d),
    weight AS (SELECT w, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t, total GROUP BY w, docs),
    q AS (SELECT DISTINCT id AS item, key AS item_id, w FROM (SELECT id, key, unnest(words) AS w FROM terms WHERE kind = 1)),
    s AS (SELECT item, item_id, t.id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // len)))) AS BIGINT) AS score
        FROM q JOIN t USING (w) JOIN weight USING (w) JOIN d ON d.id = t.id, total GROUP BY item, item_id, t.id),
    r AS (SELECT item_id, key AS doc_id, score, row_number() OVER (PARTITION BY item ORDER BY score DESC, key) AS rank FROM s JOIN terms ON kind = 0 AND terms.id = s.id WHERE score > 0)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10"""

#: Cuts and parts are taken from the words' list, and integers have 128 bits.
COLLOCATIONS = f"""
    WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER.format('text')}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
    g AS (SELECT lang, k, w[i:i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, {collocations.LONGEST + 1}) AS x(k))),
    f AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY lang, k, g),
    n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
    c AS (SELECT lang, k, g, f AS a FROM f WHERE k > 1 AND f >= {collocations.LEAST}),
    cuts AS (SELECT c.*, j, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score FROM c JOIN range(1, {collocations.LONGEST}) AS cut(j) ON j < c.k
        JOIN f x ON x.lang = c.lang AND x.g = c.g[1:j] JOIN f y ON y.lang = c.lang AND y.g = c.g[j + 1:c.k] JOIN n ON n.lang = c.lang),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, j) AS o FROM cuts) WHERE o = 1),
    inner_parts AS (SELECT lang, c.g[i:i + m - 1] AS g, max(a) AS most FROM c, range(2, {collocations.LONGEST}) AS x(m), range(1, {collocations.LONGEST}) AS y(i) WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
    kept AS (SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM best b LEFT JOIN inner_parts i ON i.lang = b.lang AND i.g = b.g WHERE most IS NULL OR 100 * most < 100 * a)
    SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM kept) WHERE rank <= {collocations.TOP}"""

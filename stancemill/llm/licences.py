"""Licence scans by a positional index of rare words, with DataFrame and SQL functions only.

One pass over the texts keeps, for each file, where it holds words of the licence templates. How many files
hold a word gives its IDF. A file's licence words are then looked up from the rarest on: each place of a
template's rare word says where the template would begin, and the template is there if its other words agree
by relative position. Phrases must agree in all words. Longer notices tolerate changed words and small shifts,
but their key phrases must stand within the stretch. A file is worked on within its row, so no group is shuffled.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stancemill.llm.common import staged
from stancemill.llm.decontam import let

#: The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Names of further licences, which must stand word for word too.
NAMES = {
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "mozilla public license": "mpl", "eclipse public license": "epl", "bsd license": "bsd",
    "creative commons attribution": "cc-by", "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc0 1": "cc0", "license identifier mit": "mit", "license identifier apache": "apache",
}
#: Sentences of public licences' notices, each with its label and key phrases.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ["hereby granted free", "person obtaining"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["binary forms", "following conditions"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["hereby granted provided", "copyright notice"]),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ["apache license version"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["free software", "gnu general public license", "free software foundation"]),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", ["free software", "gnu lesser general public license", "free software foundation"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", ["unencumbered software released", "public domain"]),
]
#: Words that no place is kept of, beside numbers. No key phrase has one.
FUNCTION_WORDS = frozenset("a all and any are as at can for if in into is it not of one or that the this to under was with you your".split())
#: A notice's words of highest IDF that are looked up, the shift that its parts may have, and the part of their IDF that must agree.
RARE, SLACK, SHARE = 8, 6, 0.7
SEPARATORS = "[\\\\x00-\\\\x2F\\\\x3A-\\\\x60\\\\x7B-\\\\x7F]+"


def index_rows() -> list[tuple[int, int, str]]:
    """(notice, position, word) of the words of the notices that are looked up: those that a notice has once."""
    out = []
    for k, (_, text, _) in enumerate(NOTICES):
        words = text.split()
        out += [(k, p, w) for p, w in enumerate(words) if words.count(w) == 1 and w not in FUNCTION_WORDS and not w.isdigit()]
    return out


def phrases() -> list[str]:
    """All phrases that must stand word for word, the base ones first."""
    return list(dict.fromkeys([*BASE, *NAMES, *(p for _, _, keys in NOTICES for p in keys)]))


def vocabulary() -> list[str]:
    return sorted({w for _, _, w in index_rows()} | {w for p in phrases() for w in p.split()})


def licence_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, hits): each file's words of the vocabulary and where they stand, in order."""
    low = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    d = docs.select(F.col(id_col).alias("doc_id"), low.alias("low"))
    some = ", ".join(f"'{w}'" for w in vocabulary())
    # An empty word at either end is what split() leaves before or after a separator.
    places = let("if(w[0] = '', 1, 0)", "lead", f"named_struct('n', size(w) - lead - if(size(w) > 1 and element_at(w, -1) = '', 1, 0), 'hits', transform(filter(sequence(0, size(w) - 1), i -> w[i] in ({some})), i -> named_struct('w', w[i], 'at', i - lead)))")
    return d.select("doc_id", F.expr(let(f"split(low, '{SEPARATORS}')", "w", places)).alias("f")).select("doc_id", F.col("f.n").cast("long").alias("n_words"), "f.hits")


def file_counts(facts: DataFrame) -> dict[str, int]:
    """How many files hold each word of the vocabulary: as many rows as it has words at most."""
    return {r[0]: r[1] for r in facts.select(F.explode(F.expr("array_distinct(transform(hits, h -> h.w))")).alias("w")).groupBy("w").count().collect()}


def _phrase_places(phrase: str, counts: dict[str, int]) -> str:
    """SQL for the starts of a phrase in hits: places of its rarest word at which the other words agree by relative position."""
    words = phrase.split()
    by_rarity = sorted(range(len(words)), key=lambda k: (counts.get(words[k], 0), k))
    agree = " and ".join(f"hits[j + {k}].w = '{words[k]}'" for k in by_rarity)
    last = len(words) - 1
    found = f"filter(sequence(0, size(hits) - {len(words)}), j -> {agree} and hits[j + {last}].at = hits[j].at + {last})"
    return f"if(size(hits) < {len(words)}, cast(array() as array<int>), transform({found}, j -> hits[j].at))"


def _notice_share(k: int, counts: dict[str, int], files: int, numbers: dict[str, int]) -> str:
    """SQL for the largest part of the IDF of a notice's rare words that agree on where it begins, where its key phrases stand there too; 0 without."""
    _, text, keys = NOTICES[k]
    rare = sorted(((counts.get(w, 0), p, w) for n, p, w in index_rows() if n == k))[:RARE]
    weights = [math.log((files + 1) / (c + 1)) for c, _, _ in rare]
    total = sum(weights)
    if total <= 0:
        return "0D"
    votes = ", ".join(f"transform(filter(hits, h -> h.w = '{w}'), h -> named_struct('o', h.at - {p}, 'r', {r}))" for r, (_, p, w) in enumerate(rare))
    # A word stands at most once at each place, so the votes within SLACK of one are among the next (SLACK + 1) * RARE.
    near = f"filter(slice(votes, i + 1, {(SLACK + 1) * len(rare)}), y -> y.o <= v.o + {SLACK})"
    table = ", ".join(f"{x!r}D" for x in weights)
    share = f"aggregate(array_distinct(transform({near}, y -> y.r)), 0D, (s, r) -> s + array({table})[r]) / {total!r}D"
    verified = " and ".join(f"exists(places[{numbers[p]}], q -> q >= v.o - {SLACK} and q <= v.o + {len(text.split()) + SLACK})" for p in keys)
    best = let(f"array_sort(concat({votes}))", "votes", f"array_max(transform(votes, (v, i) -> if({verified}, {share}, 0D)))")
    return f"if({' or '.join(f'size(places[{numbers[p]}]) = 0' for p in keys)}, 0D, coalesce({best}, 0D))"


def licences(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of docs (doc_id, text, ...).

    n_base counts the places of base phrases, first_word and last_word are the first and last of these (null without).
    labels has the base labels and those of NAMES and NOTICES, distinct, sorted and joined by commas. score is 1 where a
    phrase gives a label, else the part of a notice's IDF that agrees if that is SHARE or more, else 0.
    A null text is empty; null and repeated ids and repeated rows stay rows of their own; other columns are ignored.
    """
    facts = staged(licence_words(docs), "licence-words")
    return _labelled(facts, file_counts(facts), facts.count())


def _labelled(facts: DataFrame, counts: dict[str, int], files: int) -> DataFrame:
    numbers = {p: k for k, p in enumerate(phrases())}
    places = f"array({', '.join(_phrase_places(p, counts) for p in numbers)})"
    label = lambda there, name: f"if({there}, array('{name}'), cast(array() as array<string>))"
    base = f"concat({', '.join(label(f'size(places[{numbers[p]}]) > 0', name) for p, name in BASE.items())})"
    named = f"concat({', '.join(label(f'size(places[{numbers[p]}]) > 0', name) for p, name in NAMES.items())})"
    noted = f"concat({', '.join(label(f'shares[{k}] >= {SHARE}D', name) for k, (name, _, _) in enumerate(NOTICES))})"
    shares = f"array({', '.join(_notice_share(k, counts, files, numbers) for k in range(len(NOTICES)))})"
    starts = f"array_sort(concat({', '.join(f'places[{numbers[p]}]' for p in BASE)}))"
    body = let(shares, "shares", f"named_struct('starts', {starts}, 'base', {base}, 'named', {named}, 'noted', {noted}, 'share', array_max(shares))")
    # Files without a licence word need no look-up.
    none = "named_struct('starts', cast(array() as array<int>), 'base', cast(array() as array<string>), 'named', cast(array() as array<string>), 'noted', cast(array() as array<string>), 'share', 0D)"
    found = facts.select("doc_id", "n_words", F.expr(f"if(size(hits) < 2, {none}, {let(places, 'places', body)})").alias("f"))
    joined = lambda labels: f"array_join(array_sort(array_distinct({labels})), ',')"
    return found.select(
        "doc_id",
        "n_words",
        F.expr("cast(size(f.starts) as long)").alias("n_base"),
        F.expr("cast(array_min(f.starts) as long)").alias("first_word"),
        F.expr("cast(array_max(f.starts) as long)").alias("last_word"),
        F.expr(joined("f.base")).alias("base_labels"),
        F.expr(joined("concat(f.base, f.named, f.noted)")).alias("labels"),
        F.expr(f"case when size(f.base) + size(f.named) > 0 then 1D when f.share >= {SHARE}D then least(1D, round(f.share, 6)) else 0D end").alias("score"),
    )

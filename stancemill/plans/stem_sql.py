"""Porter's stemmer as DuckDB SQL over distinct words: the oracle's own form of it, by patterns in place of functions.stem."""

from __future__ import annotations

from stancemill.functions.stem import STEP2, STEP3, STEP4

C, V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
#: The beginning up to the first vowels; a y at the very start is none.
HEAD = f"({C}{V}|[aeiou]+)"
SOME, MANY, ONE = f"^{HEAD}{C}", f"^{HEAD}{C}{V}{C}", f"^{HEAD}{C}({V})?$"
VOWEL, SHORT = f"^({C}[aeiouy]|[aeiou])", f"^{C}[aeiouy][^aeiouwxy]$"
DOUBLE = "(" + "|".join(c * 2 for c in "bcdfghjkmnpqrtvwx") + ")$"


def _is(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '{pattern}')"


def _cut(n: int) -> str:
    return f"left(s, length(s) - {n})"


def _rules(rules: list[str]) -> str:
    cases = []
    for rule in sorted(rules, key=len, reverse=True):
        end, _, new = rule.partition(":")
        cases.append(f"WHEN ends_with(s, '{end}') THEN CASE WHEN {_is(_cut(len(end)), SOME)} THEN {_cut(len(end))} || '{new}' ELSE s END")
    return f"CASE {' '.join(cases)} ELSE s END"


def _dropped(ends: list[str]) -> str:
    cases = []
    for end in sorted(ends, key=len, reverse=True):
        also = f" AND {_is(_cut(3), '[st]$')}" if end == "ion" else ""
        cases.append(f"WHEN ends_with(s, '{end}') THEN CASE WHEN {_is(_cut(len(end)), MANY)}{also} THEN {_cut(len(end))} ELSE s END")
    return f"CASE {' '.join(cases)} ELSE s END"


BASE = "regexp_replace(s, '(ed|ing)$', '')"
STEPS = [
    f"CASE WHEN ends_with(s, 'sses') OR ends_with(s, 'ies') THEN {_cut(2)} WHEN ends_with(s, 's') AND NOT ends_with(s, 'ss') THEN {_cut(1)} ELSE s END",
    f"CASE WHEN ends_with(s, 'eed') THEN CASE WHEN {_is(_cut(3), SOME)} THEN {_cut(1)} ELSE s END "
    f"WHEN {_is('s', '(ed|ing)$')} AND {_is(BASE, VOWEL)} THEN CASE WHEN {_is(BASE, '(at|bl|iz)$')} THEN {BASE} || 'e' WHEN {_is(BASE, DOUBLE)} THEN left({BASE}, length({BASE}) - 1) WHEN {_is(BASE, ONE)} AND {_is(BASE, SHORT)} THEN {BASE} || 'e' ELSE {BASE} END ELSE s END",
    f"CASE WHEN ends_with(s, 'y') AND {_is(_cut(1), VOWEL)} THEN {_cut(1)} || 'i' ELSE s END",
    _rules(STEP2),
    _rules(STEP3),
    _dropped(STEP4),
    f"CASE WHEN ends_with(s, 'e') AND ({_is(_cut(1), MANY)} OR {_is(_cut(1), ONE)} AND NOT {_is(_cut(1), SHORT)}) THEN {_cut(1)} ELSE s END",
    f"CASE WHEN ends_with(s, 'll') AND {_is(_cut(1), MANY)} THEN {_cut(1)} ELSE s END",
]


def stems(words: str) -> str:
    """Common table expressions, the last one stems (w, stem), of the words w of a table."""
    out = [f"stem0 AS (SELECT DISTINCT w, w AS s FROM {words})"]
    out += [f"stem{k + 1} AS (SELECT w, {step} AS s FROM stem{k})" for k, step in enumerate(STEPS)]
    return ", ".join([*out, f"stems AS (SELECT w, CASE WHEN length(w) < 3 THEN w ELSE s END AS stem FROM stem{len(STEPS)})"])

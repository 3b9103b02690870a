"""Porter's stemmer (1980) and the rewriting of shared words, as Arrow UDFs."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The suffix rules of steps 2, 3 and 4 of Porter's paper.
STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble".split()
STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split()
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(word: str) -> str:
    """The word's letters as c(onsonants) and v(owels); y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or ch == "y" and out[-1:] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _rules(word: str, rules: list[str], least: int) -> str:
    for rule in sorted(rules, key=len, reverse=True):
        end, _, new = rule.partition(":")
        if word.endswith(end):
            stem = word[: len(word) - len(end)]
            return stem + new if _measure(stem) > least else word
    return word


@functools.lru_cache(1 << 18)
def stem(word: str) -> str:
    """The stem, in lower case; words of up to two letters stay."""
    w = word.lower()
    if len(w) < 3:
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif m := re.search("(ed|ing)$", w):
        base = w[: m.start()]
        if "v" in _shape(base):
            w = base
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _rules(_rules(w, STEP2, 0), STEP3, 0)
    for end in sorted(STEP4, key=len, reverse=True):
        if w.endswith(end):
            base = w[: len(w) - len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        base = w[:-1]
        if _measure(base) > 1 or _measure(base) == 1 and not _short(base):
            w = base
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


def stem_word(words: Column) -> Column:
    @F.pandas_udf("string")
    def work(w: pd.Series) -> pd.Series:
        return w.map(stem, na_action="ignore")

    return work(words)


#: English function words that are never quoted.
STOP_WORDS = frozenset("a about after all also am an and any are as at be because been before being but by can could did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its just me more most my no nor not of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your".split())
TOKEN = re.compile(r"\w+|[^\w\s]")


def quote_shared(one: str | None, two: str | None, stop: frozenset = STOP_WORDS) -> tuple[str | None, str | None]:
    """Both strings in lower case, with double quotes around the words whose stems they share; without such words they stay as they are. A null gives nulls.

    Words are told apart by case: the first shared word, one's before two's, is found in the given case; others only if they
    are in lower case themselves, as they are looked for in the texts in lower case.
    """
    if one is None or two is None:
        return None, None
    words = [[(t, stem(t)) for t in TOKEN.findall(s) if t.lower() not in stop] for s in (one, two)]
    both = set.intersection(*({root for _, root in side} for side in words))
    shared = [t for side in words for t, root in side if root in both]
    if not shared:
        return one, two
    whole = lambda some: re.compile(r"\b(?:%s)\b" % "|".join(map(re.escape, sorted(some, key=len, reverse=True))))
    later = {t for t in shared[1:] if t == t.lower()}
    marked = [whole(shared[:1]).sub('"\\g<0>"', text).lower() for text in (one, two)]
    if later:
        marked = [whole(later).sub('"\\g<0>"', text) for text in marked]
    return tuple(re.sub('"+', '"', text) for text in marked)


#: Characters or words of the rows that a task holds as Python objects at once, however many rows a batch has.
HELD = 1 << 18


def runs(sizes: np.ndarray, most: int = HELD) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows of about so much in all, one row at least."""
    total, at = np.cumsum(sizes), 0
    while at < len(total):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def sizes_of(*columns: pa.Array) -> np.ndarray:
    """Bytes of texts or words of lists in each row; a null has none."""
    size = lambda c: pa.compute.binary_length(c) if pa.types.is_string(c.type) else pa.compute.list_value_length(c)
    return sum(pa.compute.fill_null(size(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)


def quote_shared_words(one: Column, two: Column) -> Column:
    """Struct (one, two) of quote_shared."""
    kind = pa.struct([("one", pa.string()), ("two", pa.string())])

    @F.arrow_udf("one string, two string")
    def work(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for i, j in runs(sizes_of(a, b)):
            pairs = [quote_shared(x, y) for x, y in zip(a[i:j].to_pylist(), b[i:j].to_pylist())]
            out.append(pa.array([dict(zip(("one", "two"), p)) for p in pairs], kind))
        return pa.concat_arrays(out) if out else pa.array([], kind)

    return work(one, two)


def longest_run(text: list, query: list) -> list:
    """The longest run of the query's words (or numbers of words) that the text has too; of several the one that ends first.

    If the two share a run of k words they share one of k - 1, so k is found by halving.
    """
    asked = set(query)
    places = [i for i, w in enumerate(text) if w in asked]

    def shared(k: int) -> list[int]:
        held = {tuple(text[i : i + k]) for i in places if i + k <= len(text)}
        return [i for i in range(len(query) - k + 1) if tuple(query[i : i + k]) in held]

    low, high = 0, min(len(query), len(text)) if places else 0
    while low < high:
        k = (low + high + 1) // 2
        low, high = (k, high) if shared(k) else (low, k - 1)
    return query[shared(low)[0] :][:low] if low else []


def coded(lists: pa.Array) -> tuple[list[list[int] | None], list[str]]:
    """Each list of words as numbers of words, null for a null, and the words, each once."""
    words = pa.compute.dictionary_encode(lists.flatten())
    numbers = words.indices.to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes_of(lists))
    some = lists.is_valid().to_pylist()
    return [numbers[i:j].tolist() if ok else None for ok, i, j in zip(some, np.concatenate(([0], ends[:-1])), ends)], words.dictionary.to_pylist()


def longest_common_ngram(text: Column, query: Column) -> Column:
    """The longest run of stems that the words of the text and the query (arrays, see text.normal_words) share; none gives an empty array, a null side null."""

    @F.arrow_udf("array<string>")
    def work(t: pa.Array, q: pa.Array) -> pa.Array:
        kind, out = pa.list_(pa.string()), []
        for i, j in runs(sizes_of(t, q)):
            found, number = [], {}
            sides = []
            for lists in (t[i:j], q[i:j]):
                rows, words = coded(lists)
                # Each different word of the run is stemmed once; equal stems have one number.
                stems = np.array([number.setdefault(stem(w) if w is not None else None, len(number)) for w in words] or [0])
                sides.append([None if r is None else stems[r].tolist() if r else [] for r in rows])
            names = list(number)
            for x, y in zip(*sides):
                found.append(None if x is None or y is None else [names[k] for k in longest_run(x, y)])
            out.append(pa.array(found, kind))
        return pa.concat_arrays(out) if out else pa.array([], kind)

    return work(text, query)

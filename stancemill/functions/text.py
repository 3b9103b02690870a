"""Column builders for the library's text operators: built-in expressions only, null in, null out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Answer classes in the order in which they are looked for.
FULL_CLASSES = ["not", "yes", "no"]
SHORT_CLASSES = ["yes", "no"]
# Patterns whose counts are features.
HREF = r"href\s*="
EMAIL = r"([-!#-'*+/-9=?A-Z^-~]+(\.[-!#-'*+/-9=?A-Z^-~]+)*|\"([\]!#-\[^-~ \t]|(\\[\t -~]))+\")@([-!#-'*+/-9=?A-Z^-~]+(\.[-!#-'*+/-9=?A-Z^-~]+)*|\[[\t -Z^-~]*\])"
# The same addresses, in Java's syntax and found in linear time: atoms and quoted strings are taken whole, and one begins where no other runs into it.
ATOM = "[-!#-'*+/-9=?A-Z^-~]"
DOT_ATOM = rf"(?<!{ATOM})(?<!{ATOM}\.){ATOM}++(?:\.{ATOM}++)*+"
DOMAIN = rf"(?:{ATOM}++(?:\.{ATOM}++)*+|\[[\t -Z^-~]*+\])"
#: A quoted string before the @ may have this many characters and escapes; as many quotes may open one that never ends.
MOST_QUOTED = 256
QUOTED = rf"\"(?:[\]!#-\[^-~ \t]|\\[\t -~]){{1,{MOST_QUOTED}}}+\""
#: Contractions without an apostrophe that the Penn Treebank's tokens split.
CONTRACTIONS = [("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("wan", "na")]
#: Top-level domains under which a name without a scheme is a URL: a parameter; these are the generic ones, and two letters stand for any country.
TLDS = "com net org edu gov mil info biz name pro aero asia coop int jobs mobi museum post tel travel cat xxx [a-z]{2}".split()


def url_pattern(tlds: list[str] | None = None) -> str:
    """URLs, by RFC 3986's characters: with http or https whatever the host; without a scheme a dotted host under one of the tlds, with a path or not, that is no part of an e-mail address."""
    inner = r"[a-z0-9\-._~%!$&'()*+,;=:@/?#\[\]]"
    # The last character is none that more likely ends the sentence.
    tail = rf"(?:{inner}*[a-z0-9\-_~%$&*+=@/#])"
    # Labels are taken whole as long as another follows, so a long name is read once.
    host = rf"(?<![@\w.\-])(?:[a-z0-9]++(?:-++[a-z0-9]++)*+\.(?=[a-z0-9]))++(?:{'|'.join(tlds or TLDS)})\b(?![@\-]|\.[a-z0-9])"
    return rf"(?i)\bhttps?://{tail}|{host}(?:[/?#:]{tail}?)?"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end; trim() removes spaces only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def classify(answer: Column, classes: list[str]) -> Column:
    """The first of the classes, in their order, that occurs anywhere in the answer, ignoring case; else null."""
    low, out = F.lower(answer), F.lit(None).cast("string")
    for c in reversed([c.lower() for c in classes]):
        out = F.when(F.contains(low, F.lit(c)), c).otherwise(out)
    return out


def last_line(text: Column) -> Column:
    return F.substring_index(text, "\n", -1)


def statements(answer: Column, prefix: str) -> Column:
    """What follows the first colon in the lines that start with the prefix ("yes", or "no" for lines that don't start with "yes"), joined by '. '."""
    low = lambda x: F.lower(x)
    mine = (lambda x: low(x).startswith("yes")) if prefix == "yes" else (lambda x: ~low(x).startswith("yes") & low(x).startswith(prefix))
    after = lambda x: F.when(F.contains(x, F.lit(":")), strip(F.substr(x, F.locate(":", x) + 1))).otherwise("")
    return F.array_join(F.filter(F.transform(F.filter(F.split(answer, "\n", -1), mine), after), lambda x: x != ""), ". ")


def is_question(line: Column) -> Column:
    """Not blank, with a question mark and without triple quotes or back-ticks."""
    return (strip(line) != "") & ~F.contains(line, F.lit('"""')) & ~F.contains(line, F.lit("```")) & F.contains(line, F.lit("?"))


def space_tokens(text: Column) -> Column:
    """Split at single spaces: empty tokens count, other white space doesn't split."""
    return F.split(text, " ", -1)


def num_tokens(text: Column) -> Column:
    return F.size(space_tokens(text)).cast("long")


def num_unique_tokens(text: Column) -> Column:
    """Distinct tokens as they are; operators.features.unique_lemmas takes a lemma table."""
    return F.size(F.array_distinct(space_tokens(text))).cast("long")


def long_enough(text: Column, least: int = 200) -> Column:
    return F.coalesce(num_tokens(text) >= least, F.lit(False))


def count_pattern(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def email_count(text: Column) -> Column:
    """Addresses as EMAIL finds them, up to MOST_QUOTED characters in quotes. Quotes are looked for only in texts that have one before an @."""
    plain, both = rf"{DOT_ATOM}@{DOMAIN}", rf"(?:{DOT_ATOM}|{QUOTED})@{DOMAIN}"
    return F.when(~F.contains(text, F.lit("@")), 0).when(F.contains(text, F.lit('"@')), count_pattern(text, both)).otherwise(count_pattern(text, plain)).cast("long")


def normal_words(text: Column) -> Column:
    """Lower-case words after every other character has become a space; CONTRACTIONS are two words."""
    plain = F.regexp_replace(F.lower(text), r"(?U)[^a-zA-Z0-9\s]", " ")
    halves = "|".join(f"{a}(?={b}\\b)" for a, b in CONTRACTIONS)
    return F.filter(F.split(F.regexp_replace(plain, rf"\b({halves})", "$1 "), r"\s+"), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Split after . ! or ? followed by white space."""
    return F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\u0001", -1)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def trim_sentences(parts: Column) -> Column:
    """(text, removed_first, removed_last) of an array of sentences without cut-off ones at the ends.

    Fewer than two sentences stay as they are. Blank ones go; the first goes if it starts with a lower-case
    letter or one of . , ; : ! ? and then the last of the rest if it ends in a letter or digit.
    """

    def trimmed(v: Column) -> Column:
        parts, kept = v["parts"], v["kept"]
        first = F.try_element_at(kept, F.lit(1))
        cut_first = F.coalesce(strip(first).rlike(r"^[\p{Ll}.,;:!?]"), F.lit(False))

        def ends(w: Column) -> Column:
            begin, n = w["begin"], F.size(kept)
            last = F.when(begin <= n, F.try_element_at(kept, F.lit(-1)))
            cut_last = F.coalesce(strip(last).rlike(r"[\p{L}\p{N}]$"), F.lit(False))
            done = F.slice(kept, begin, F.greatest(n - begin + 1 - cut_last.cast("int"), F.lit(0)))
            short = F.size(parts) < 2
            return F.struct(
                F.when(short, F.array_join(parts, " ")).otherwise(F.array_join(done, " ")).alias("text"),
                F.when(~short & w["cut"], first).alias("removed_first"),
                F.when(~short & cut_last, last).alias("removed_last"),
            )

        return bound(F.struct((cut_first.cast("int") + 1).alias("begin"), cut_first.alias("cut")), ends)

    return bound(F.struct(parts.alias("parts"), F.filter(parts, lambda s: strip(s) != "").alias("kept")), trimmed)


def readability(text: Column) -> Column:
    """Kincaid (1975) grade: 0.39 words/sentence + 11.8 syllables/word - 15.59; syllables are vowel groups, one a word at least; under 100 words 0."""

    low = F.lower(text)
    count = lambda pattern: F.regexp_count(low, F.lit(pattern))
    n = count(r"\S+")
    ends = F.greatest(F.regexp_count(text, F.lit(r"[.!?]+(\s|$)")), F.lit(1))
    # Vowel groups end with their words; a word without any counts as one.
    syllables = count("[aeiouy]+") + count(r"(?<!\S)[^\saeiouy]++(?!\S)")
    grade = lambda v: F.when(v["n"] < 100, 0.0).otherwise(0.39 * v["n"] / v["ends"] + 11.8 * v["syllables"] / v["n"] - 15.59)
    return F.when(text.isNotNull(), bound(F.struct(n.alias("n"), ends.alias("ends"), syllables.alias("syllables")), grade))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def page_starts(num_results: Column) -> Column:
    """First results of the pages of ten of a search for so many results, clamped to 1..100; the last number itself is left out."""
    n = F.greatest(F.least(num_results, F.lit(100)), F.lit(1))
    return F.when(n <= 1, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), n - 1, F.lit(10)))


def windows(tokens: Column, size: int = 508, step: int = 256) -> Column:
    """Windows of size tokens every step; an incomplete last one is left out, and a text shorter than size is one window."""
    last = F.greatest(F.lit(0), F.floor((F.size(tokens) - size) / step).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(tokens, i * step + 1, size))


def best_window(scored: Column) -> Column:
    """Of an array of (score, window) structs, the one with the highest score, the first on ties; NaN counts lowest."""
    keyed = F.transform(scored, lambda s, i: F.struct(F.nanvl(s["score"], F.lit(float("-inf"))).alias("score"), (-i).alias("at"), s["window"].alias("window")))
    return F.array_max(keyed)


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def suffix(url: Column, known: list[str] | None = None) -> Column:
    """Public suffix: the longest of the known ones of several labels (a parameter), else the last label."""
    labels = F.split(host(url), r"\.")
    out = F.try_element_at(labels, F.lit(-1))
    for s in sorted(known or [], key=lambda s: s.count(".")):
        out = F.when(host(url).endswith("." + s), s).otherwise(out)
    return out


def domain(url: Column, known: list[str] | None = None) -> Column:
    """The label before the public suffix."""
    rest = F.left(host(url), F.length(host(url)) - F.length(suffix(url, known)) - 1)
    return F.nullif(F.substring_index(rest, ".", -1), F.lit(""))

"""Main text by the published paragraph heuristics of Pomikálek (2011): link density, length and stop-word density, then context."""

from __future__ import annotations

from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from stancemill.functions.stem import STOP_WORDS

#: The published default thresholds.
LENGTH_LOW, LENGTH_HIGH = 70, 200
STOPWORDS_LOW, STOPWORDS_HIGH = 0.30, 0.32
MAX_LINK_DENSITY = 0.2
MAX_HEADING_DISTANCE = 200
#: Tags that end a paragraph, and tags whose content is not text.
BREAKS = frozenset("body blockquote caption center col colgroup dd div dl dt fieldset form h1 h2 h3 h4 h5 h6 legend li optgroup option p pre table td textarea tfoot th thead tr ul article section header footer nav main aside".split())
UNSEEN = frozenset("script style head noscript template".split())


@dataclass
class Paragraph:
    text: str
    path: str
    linked: int
    label: str = ""


class Paragraphs(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[Paragraph] = []
        self.stack: list[str] = []
        self.parts: list[str] = []
        self.linked = self.hidden = self.anchors = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.found.append(Paragraph(text, ".".join(self.stack), self.linked))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in BREAKS:
            self.flush()
            self.stack.append(tag)
        elif tag == "br":
            self.parts.append(" ")
        self.hidden += tag in UNSEEN
        self.anchors += tag == "a"

    def handle_endtag(self, tag):
        if tag in BREAKS:
            self.flush()
            if tag in self.stack:
                while self.stack.pop() != tag:
                    pass
        self.hidden = max(0, self.hidden - (tag in UNSEEN))
        self.anchors = max(0, self.anchors - (tag == "a"))

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)
            self.linked += len(data) * (self.anchors > 0)


def first_label(p: Paragraph, stop: frozenset) -> str:
    n, words = len(p.text), p.text.split()
    density = sum(w.lower() in stop for w in words) / len(words)
    if p.linked / n > MAX_LINK_DENSITY or "\xa9" in p.text or "select" in p.path.split("."):
        return "bad"
    if n < LENGTH_LOW:
        return "bad" if p.linked else "short"
    if density >= STOPWORDS_HIGH:
        return "good" if n > LENGTH_HIGH else "neargood"
    return "neargood" if density >= STOPWORDS_LOW else "bad"


def near(labels: list[str], k: int, step: int, passing: frozenset) -> str:
    """The first label from k on in a direction that is not to be passed over; bad at the page's ends."""
    k += step
    while 0 <= k < len(labels):
        if labels[k] not in passing:
            return labels[k]
        k += step
    return "bad"


def classify(paragraphs: list[Paragraph], stop: frozenset = STOP_WORDS) -> list[Paragraph]:
    first = [first_label(p, stop) for p in paragraphs]
    heading = [p.path.rsplit(".", 1)[-1] in ("h1", "h2", "h3", "h4", "h5", "h6") for p in paragraphs]

    def good_follows(k: int, labels: list[str]) -> bool:
        distance = 0
        for j in range(k + 1, len(labels)):
            if distance > MAX_HEADING_DISTANCE:
                return False
            if labels[j] == "good":
                return True
            distance += len(paragraphs[j].text)
        return False

    labels = ["neargood" if h and c == "short" and good_follows(k, first) else c for k, (h, c) in enumerate(zip(heading, first))]
    out = list(labels)
    for k, c in enumerate(labels):
        if c == "short":
            around = {near(labels, k, -1, frozenset({"short", "neargood"})), near(labels, k, 1, frozenset({"short", "neargood"}))}
            if len(around) == 1:
                out[k] = around.pop()
            else:
                # Between good and bad, a short paragraph follows a near-good neighbour on the bad side.
                side = -1 if near(labels, k, -1, frozenset({"short", "neargood"})) == "bad" else 1
                out[k] = "good" if near(labels, k, side, frozenset({"short"})) == "neargood" else "bad"
    settled = list(out)
    for k, c in enumerate(settled):
        if c == "neargood":
            around = {near(settled, k, -1, frozenset({"neargood"})), near(settled, k, 1, frozenset({"neargood"}))}
            out[k] = "bad" if around == {"bad"} else "good"
    for k, (h, c) in enumerate(zip(heading, first)):
        if h and out[k] == "bad" and c != "bad" and good_follows(k, out):
            out[k] = "good"
    for p, c in zip(paragraphs, out):
        p.label = c
    return paragraphs


def page_text(html: str | None, stop: frozenset = STOP_WORDS) -> str | None:
    """Texts of the good paragraphs, one a line; null for null and for what can't be parsed."""
    if html is None:
        return None
    parser = Paragraphs()
    try:
        parser.feed(html)
        parser.close()
    except (AssertionError, ValueError):
        return None
    parser.flush()
    return "\n".join(p.text for p in classify(parser.found, stop) if p.label == "good")


def main_text(html: Column, stop: frozenset = STOP_WORDS) -> Column:
    @F.pandas_udf("string")
    def work(pages: pd.Series) -> pd.Series:
        return pages.map(lambda x: page_text(x, stop))

    return work(html)

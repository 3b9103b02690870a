"""Main text of web pages by a linear-chain conditional random field over their leaf blocks.

A page's blocks are the runs of text between block-level tags, each with the tags around it. Features are
the ancestors' tags, the words of their class, id and role, and the block's size, links and marks. A CRF with
two labels (main text or not) is trained on labelled pages and decoded by Viterbi.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stancemill.llm import labelled_pages
from stancemill.llm.common import small_batches

# HTML's element kinds.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr button select optgroup option datalist meter progress".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("script style noscript template svg math iframe object canvas audio video head title button select datalist meter progress".split())
RAW = re.compile(r"(script|style|textarea|title|noscript|template|svg|iframe)\b", re.I)
END = {n: re.compile(rf"</{n}\b[^>]*>", re.I) for n in "script style textarea title noscript template svg iframe".split()}
#: Opening one of these ends an open element named with it, up to the nearest of the second set.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
#: What a head can hold; any other tag, or text, ends one that is open.
HEAD = set("base basefont bgsound link meta title noscript noframes style script template head".split())
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
#: The rest of a tag whose quotes are closed.
REST = re.compile(r"""((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Words whose presence in a short block is a feature.
MARKS = set("advertisement sponsored cookie cookies consent copyright rights reserved privacy terms subscribe newsletter login register share tweet comment comments reply related menu search home contact ©".split())


#: How often a page may be read to its end for the end of a tag.
READ_AGAIN = 64


class Block:
    __slots__ = ("text", "path", "tag", "linked")

    def __init__(self, text: str, path: tuple[str, ...], tag: str, linked: int):
        self.text, self.path, self.tag, self.linked = text, path, tag, linked


class Open:
    """The open elements, with what is looked up in them for every block: each takes a time that does not grow with their number."""

    def __init__(self):
        self.stack: list[tuple[str, str]] = []
        self.names: Counter[str] = Counter()
        self.signs: dict[str, int] = {}
        #: Places of those that are not inline.
        self.solid: list[int] = []
        self.unseen = 0

    def push(self, name: str, sign: str) -> None:
        if name not in INLINE:
            self.solid.append(len(self.stack))
        self.stack.append((name, sign))
        self.names[name] += 1
        self.unseen += name in UNSEEN
        if sign:
            self.signs[sign] = self.signs.get(sign, 0) + 1

    def pop(self, upto: int) -> None:
        while len(self.stack) > upto:
            name, sign = self.stack.pop()
            if self.solid and self.solid[-1] == len(self.stack):
                self.solid.pop()
            self.names[name] -= 1
            self.unseen -= name in UNSEEN
            if sign:
                self.signs[sign] -= 1
                if not self.signs[sign]:
                    del self.signs[sign]

    def nearest(self, names: set[str], stops: set[str] = frozenset(), inline: bool = False) -> int:
        """The place of the innermost element with one of the names, looked for up to one of stops or, if inline, up to one that is not inline; -1 for none."""
        if any(self.names[n] for n in names):
            for k in range(len(self.stack) - 1, -1, -1):
                name = self.stack[k][0]
                if name in names:
                    return k
                if name in stops or inline and name not in INLINE:
                    break
        return -1

    def solid_name(self) -> str:
        return self.stack[self.solid[-1]][0] if self.solid else ""


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, character references decoded and white space runs as one space. A quote that a tag opens and the page never closes ends with that tag."""
    out: list[Block] = []
    elements = Open()
    parts: list[str] = []
    linked, at = 0, 0
    #: Characters that may be read in vain after tags whose quotes don't close, so that a page takes linear time; beyond, tags end at the first >.
    spare = READ_AGAIN * (len(page) + 10_000)
    #: Elements whose end tag the rest of the page lacks.
    endless: set[str] = set()

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, tuple(elements.signs), elements.solid_name(), linked))
            parts, linked = [], 0

    def say(raw: str) -> None:
        nonlocal linked
        if elements.names["head"] and elements.stack[-1][0] == "head" and raw.strip():
            elements.pop(len(elements.stack) - 1)
        if raw and not elements.unseen:
            raw = html.unescape(raw) if "&" in raw else raw
            parts.append(raw)
            if elements.names["a"]:
                linked += len(raw)

    while True:
        m = TAG.search(page, at)
        if not m:
            say(page[at:])
            break
        name, stop = m[2], m.end()
        if name:
            full = REST.match(page, stop) if spare > 0 else None
            if full:
                rest, stop = full[1], full.end()
            else:
                spare -= len(page) - stop
                end = page.find(">", stop)
                if end < 0:
                    say(page[at:])
                    break
                rest, stop = page[stop:end], end + 1
        say(page[at : m.start()])
        at = stop
        if not name:
            continue
        name, ending = name.lower(), m[1] == "/"
        if elements.names["head"] and not ending and name not in HEAD:
            elements.pop(elements.nearest({"head"}))
        if name == "br":
            say(" ")
            continue
        if name not in INLINE:
            close()
        if ending:
            k = elements.nearest({name}, inline=name in INLINE)
            if k >= 0:
                elements.pop(k)
            continue
        if name in VOID:
            continue
        if name in ENDS:
            k = elements.nearest(*ENDS[name])
            if k >= 0:
                elements.pop(k)
        elif name not in INLINE and elements.solid_name() == "p":
            # A block ends an open paragraph, with what inline elements are open in it.
            elements.pop(elements.solid[-1])
        if RAW.fullmatch(name):
            end = END[name].search(page, at) if name not in endless else None
            if not end:
                endless.add(name)
            if name == "textarea":
                at = end.end() if end else len(page)
            elif end:
                at = end.end()
            elif name in ("script", "style"):
                at = len(page)
            continue
        if rest.rstrip().endswith("/") and name in UNSEEN:
            continue
        sign = name
        if rest:
            words = {w.lower() for k, v in ATTRIBUTE.findall(rest) for w in ([k] if k.lower() == "hidden" else WORDS.findall(v))}
            sign = f"{name} {' '.join(sorted(words))}" if words else name
        elements.push(name, "" if name in INLINE and " " not in sign else sign)
    close()
    return out


@functools.lru_cache(1 << 16)
def path_features(path: tuple[str, ...]) -> tuple[str, ...]:
    found = set()
    for sign in path:
        name, *words = sign.split(" ")
        found.add(f"in={name}")
        found.update(f"named={w}" for w in words)
    return tuple(sorted(found))


def features(page: list[Block]) -> list[tuple[str, ...]]:
    out = []
    for k, b in enumerate(page):
        n = len(b.text)
        own = [f"tag={b.tag}", f"size={min(9, n.bit_length())}", f"links={min(4, 5 * b.linked // max(1, n))}", f"end={'.' if b.text[-1] in '.!?:;…。\"”)' else 'x'}"]
        if k == 0:
            own.append("first")
        if k == len(page) - 1:
            own.append("last")
        if n < 300:
            words = {w.strip(".,:;!?()").lower() for w in b.text.split()}
            own += [f"says={w}" for w in sorted(words & MARKS)]
        if b.text.count("|") > 2:
            own.append("bars")
        out.append((*own, *path_features(b.path)))
    return out


class Crf:
    """weights: feature -> score of main text over the rest; moves[a, b]: score of label b after a; edges: scores of the first and last label."""

    def __init__(self, weights: dict[str, float], moves: np.ndarray, edges: np.ndarray):
        self.weights, self.moves, self.edges = weights, moves.tolist(), edges.tolist()

    def decode(self, rows: list[tuple[str, ...]]) -> list[int]:
        """The likeliest labels, by Viterbi."""
        if not rows:
            return []
        get, (m, e) = self.weights.get, (self.moves, self.edges)
        back, zero, one = [], e[0][0], e[0][1]
        for k, row in enumerate(rows):
            if k:
                from_zero = (zero + m[0][0] >= one + m[1][0], zero + m[0][1] >= one + m[1][1])
                zero, one = (zero + m[0][0] if from_zero[0] else one + m[1][0]), (zero + m[0][1] if from_zero[1] else one + m[1][1])
                back.append(from_zero)
            one += sum(get(f, 0.0) for f in row)
        label = int(one + e[1][1] > zero + e[1][0])
        out = [label]
        for from_zero in reversed(back):
            label = 0 if from_zero[label] else 1
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[list[tuple[str, ...]], list[int]]], rounds: int = 150, rate: float = 0.2, penalty: float = 0.004) -> Crf:
    """Maximum likelihood with an L2 penalty by Adam, over the forward-backward marginals of all pages at once."""
    pages = [p for p in pages if p[0]]
    index = {f: i for i, f in enumerate(sorted({f for rows, _ in pages for row in rows for f in row}))}
    long, n = max(len(r) for r, _ in pages), len(pages)
    cell, feature = np.array([(p * long + t, index[f]) for p, (rows, _) in enumerate(pages) for t, row in enumerate(rows) for f in row]).T
    size = np.array([len(r) for r, _ in pages])
    y = np.zeros((n, long), int)
    for p, (_, labels) in enumerate(pages):
        y[p, : len(labels)] = labels
    real = np.arange(long) < size[:, None]
    step = real[:, 1:]
    theta = np.zeros(len(index) + 8)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    gold_moves = np.array([[(step & (y[:, :-1] == a) & (y[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)])
    ends = y[np.arange(n), size - 1]
    for k in range(1, rounds + 1):
        w, moves, edges = theta[:-8], theta[-8:-4].reshape(2, 2), theta[-4:].reshape(2, 2)
        unary = np.zeros((n, long, 2))
        unary[:, :, 1] = np.bincount(cell, w[feature], n * long).reshape(n, long)
        alpha, beta = np.zeros((n, long, 2)), np.zeros((n, long, 2))
        alpha[:, 0] = unary[:, 0] + edges[0]
        for t in range(1, long):
            alpha[:, t] = np.logaddexp.reduce(alpha[:, t - 1, :, None] + moves, axis=1) + unary[:, t]
        beta[np.arange(n), size - 1] = edges[1]
        for t in range(long - 2, -1, -1):
            inner = np.logaddexp.reduce(moves + (unary[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
            beta[:, t] = np.where((t < size - 1)[:, None], inner, beta[:, t])
        total = np.logaddexp.reduce(alpha[np.arange(n), size - 1] + edges[1], axis=1)
        p = np.exp(alpha + beta - total[:, None, None]) * real[:, :, None]
        both = np.exp(alpha[:, :-1, :, None] + moves + (unary[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]) * step[:, :, None, None]
        grad = np.concatenate((
            np.bincount(feature, ((y - p[:, :, 1]) * real).ravel()[cell], len(index)),
            (gold_moves - both.sum(axis=(0, 1))).ravel(),
            np.array([(y[:, 0] == 0).sum() - p[:, 0, 0].sum(), (y[:, 0] == 1).sum() - p[:, 0, 1].sum(), (ends == 0).sum() - p[np.arange(n), size - 1, 0].sum(), (ends == 1).sum() - p[np.arange(n), size - 1, 1].sum()]),
        )) / n - penalty * theta / 10
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8) / (1 + k / 40)
    return Crf({f: float(theta[i]) for f, i in index.items()}, theta[-8:-4].reshape(2, 2), theta[-4:].reshape(2, 2))


def labelled(pages: list[tuple[str, set[str]]]) -> list[tuple[list[tuple[str, ...]], list[int]]]:
    """Features and labels of pages, given the texts of the blocks that are main text."""
    found = [(blocks(page), main) for page, main in pages]
    return [(features(b), [int(x.text in main) for x in b]) for b, main in found]


@functools.cache
def default_model() -> Crf:
    """The CRF trained on labelled_pages.pages(), the same on every run."""
    return train(labelled(labelled_pages.pages()))


def main_text(page: str | None, model: Crf) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, label in zip(found, model.decode(features(found))) if label)


def extract(pages: DataFrame, model: Crf | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages (page_id, url, html, ...).

    A page without main text, or whose html is null or empty, has an empty text and 0 characters; a page of any length is taken whole. Ids and urls
    are passed on as they are, null or repeated. No rows give no rows; other columns are ignored.
    """
    small_batches(pages.sparkSession)
    model = model or default_model()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(x.as_py(), model) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return p.mapInArrow(work, "page_id long, url string, text string, n_chars long")

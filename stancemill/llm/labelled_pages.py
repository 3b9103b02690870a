"""Labelled pages for training: layouts of many kinds, written by a seeded generator that knows which blocks are main text.

The bound of the training sample is the number of pages, a parameter. Texts are made of invented words, so
that a model learns from structure and size, not from vocabulary.
"""

from __future__ import annotations

import random

SYLLABLES = "ba be bi bo bu da de di do du fa fe fi ka ke ki ko la le li lo lu ma me mi mo na ne ni no pa pe pi po ra re ri ro ru sa se si so ta te ti to va ve vi vo za ze zo".split()
MENU = "home news about contact sport culture archive shop help login register blog events gallery".split()
#: Wrappers as (tag, attributes) of each part of a page.
ARTICLE = [("article", ""), ("article", 'class="post"'), ("main", ""), ("div", 'class="content"'), ("div", 'id="content"'), ("div", 'class="article-body"'), ("div", 'class="entry-content"'), ("div", 'class="post-content"'), ("div", 'role="main"'), ("section", 'class="story"'), ("div", 'id="main"'), ("div", 'class="text"'), ("div", "")]
HEADER = [("header", ""), ("div", 'class="header"'), ("div", 'id="masthead"'), ("header", 'class="site-header"'), ("div", 'id="header"'), ("div", 'class="topbar"'), ("header", 'role="banner"')]
NAV = [("nav", ""), ("div", 'class="nav"'), ("ul", 'class="menu"'), ("div", 'id="navigation"'), ("nav", 'class="navbar"'), ("div", 'class="breadcrumb"'), ("div", 'role="navigation"'), ("div", 'class="menu"'), ("nav", 'class="toc"')]
SIDE = [("aside", ""), ("div", 'class="sidebar"'), ("div", 'id="sidebar"'), ("aside", 'class="widget"'), ("div", 'class="related"'), ("section", 'class="related-posts"'), ("div", 'class="recommended"'), ("div", 'role="complementary"'), ("div", 'class="side-column"')]
ADVERT = [("div", 'class="ad"'), ("div", 'class="ads"'), ("div", 'class="advert"'), ("aside", 'class="advertisement"'), ("div", 'class="sponsored"'), ("div", 'class="promo"'), ("div", 'id="ad-banner"'), ("section", 'class="sponsor"'), ("div", 'class="banner-ad"')]
NOTICE = [("div", 'class="cookie"'), ("div", 'class="notice"'), ("div", 'id="cookie-banner"'), ("div", 'class="consent"'), ("div", 'role="alert"'), ("div", 'class="gdpr"'), ("section", 'class="cookie-notice"'), ("div", 'class="alert"'), ("div", 'class="popup modal"'), ("dialog", "")]
FORM = [("form", ""), ("form", 'class="search"'), ("div", 'class="newsletter"'), ("form", 'id="login"'), ("div", 'class="subscribe"'), ("section", 'class="signup"')]
COMMENTS = [("section", 'class="comments"'), ("div", 'class="responses"'), ("section", 'id="responses"'), ("div", 'class="reader-comments"'), ("ul", 'class="replies"'), ("section", 'class="feedback"'), ("div", 'id="comments"'), ("ol", 'class="commentlist"'), ("div", 'class="comment-thread"'), ("div", 'class="comments-area"'), ("div", 'class="discussion"'), ("div", 'id="disqus_thread"'), ("section", 'id="respond"'), ("div", 'class="user-comments"')]
FOOTER = [("footer", ""), ("div", 'class="footer"'), ("div", 'id="footer"'), ("footer", 'class="site-footer"'), ("div", 'class="copyright"'), ("div", 'role="contentinfo"'), ("div", 'class="bottom"')]
SHARE = [("div", 'class="share"'), ("div", 'class="social"'), ("ul", 'class="share-buttons"'), ("div", 'class="tags"')]


class Page:
    def __init__(self, rng: random.Random):
        self.rng, self.main = rng, set()

    def word(self) -> str:
        return "".join(self.rng.choices(SYLLABLES, k=self.rng.choice((1, 1, 2, 2, 3))))

    def words(self, n: int) -> str:
        return " ".join(self.word() for _ in range(n))

    def prose(self, n: int) -> str:
        style = self.rng.random()
        if style < 0.06:
            return " | ".join(self.word() for _ in range(n))
        if style < 0.1:
            return self.words(n).upper() + "!!"
        if style < 0.14:
            return self.words(n)
        out = []
        while n > 0:
            k = min(n, self.rng.randint(3, 18))
            out.append(self.words(k).capitalize() + ".")
            n -= k
        return " ".join(out)

    def good(self, tag: str, text: str) -> str:
        self.main.add(" ".join(text.split()))
        if self.rng.random() < 0.15 and " " in text:
            a, b = text.split(" ", 1)
            text = self.rng.choice((f"<b>{a}</b> {b}", f'<a href="/x">{a}</a> {b}', f"<em>{a}</em> {b}", f"{a}\n  {b}"))
        end = "" if tag in ("p", "li") and self.rng.random() < 0.2 else f"</{tag}>"
        return f"<{tag}>{text}{end}"

    def wrap(self, kinds: list[tuple[str, str]], inner: str) -> str:
        tag, attributes = self.rng.choice(kinds)
        if tag in ("ul", "ol"):
            inner = f"<li>{inner}</li>" if not inner.startswith("<li") else inner
        return f"<{tag}{' ' + attributes if attributes else ''}>{inner}</{tag}>"

    def links(self, n: int) -> str:
        items = [f'<a href="/{k}">{self.rng.choice((self.rng.choice(MENU), self.words(self.rng.randint(1, 4))))}</a>' for k in range(n)]
        return self.rng.choice((lambda: "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>", lambda: "".join(f"<div>{i}</div>" for i in items), lambda: " | ".join(items)))()

    def junk(self, low: int = 3, high: int = 40) -> str:
        text = self.prose(self.rng.randint(low, high))
        return self.rng.choice((text, f"<p>{text}</p>", f"<div>{text}</div>", f"<h3>{self.words(2)}</h3><p>{text}</p>"))

    def comments(self) -> str:
        plain = self.rng.random() < 0.35
        text = lambda: self.prose(self.rng.randint(3, 60))
        one = lambda: f"<p>{text()}</p>" if plain else f'<div class="{self.rng.choice(("comment", "reply", "comment-body", "user-comment"))}"><b>{self.word()}</b><p>{text()}</p></div>'
        return self.wrap(COMMENTS, f"<h3>{self.rng.choice(('Comments', 'Responses', self.words(2)))}</h3>" + "".join(one() for _ in range(self.rng.randint(1, 5))))

    def form(self) -> str:
        return self.wrap(FORM, f"<label>{self.words(3)}</label><input name=q><button>{self.rng.choice(('Search', 'Subscribe', 'Login', self.word()))}</button>" + (f"<p>{self.prose(8)}</p>" if self.rng.random() < 0.5 else ""))

    def body(self, mixed: bool = True) -> str:
        """Main text, if mixed with other parts between."""
        rng, out = self.rng, []
        if rng.random() < 0.9:
            out.append(self.good(rng.choice(("h1", "h1", "h2")), self.words(rng.randint(3, 12)) if rng.random() < 0.8 else self.prose(rng.randint(3, 12))))
        for _ in range(rng.randint(1, 14)):
            kind = rng.random() if mixed else 0.95 * rng.random()
            if kind < 0.72:
                out.append(self.good("p", self.prose(rng.choice((1, 2, 5, 12, 30, 60, 120)))))
            elif kind < 0.8:
                out.append(self.good(rng.choice(("h2", "h3")), self.words(rng.randint(1, 6))))
            elif kind < 0.86:
                out.append("<ul>" + "".join(self.good("li", self.prose(rng.randint(2, 20))) for _ in range(rng.randint(1, 5))) + "</ul>")
            elif kind < 0.9:
                out.append("<blockquote>" + self.good("p", self.prose(rng.randint(5, 40))) + "</blockquote>")
            elif kind < 0.93:
                out.append("<table><tr>" + self.good("td", self.prose(3)) + self.good("td", self.prose(4)) + "</tr></table>")
            elif kind < 0.935:
                out.append("<div>" + self.good("p", self.prose(rng.randint(5, 40))) + "</div>")
            elif kind < 0.95:
                out.append(rng.choice((
                    lambda: self.good("pre", self.words(rng.randint(2, 40))),
                    lambda: "<dl>" + self.good("dt", self.words(rng.randint(1, 4))) + self.good("dd", self.prose(rng.randint(3, 20))) + "</dl>",
                    lambda: "<figure><img src=x>" + self.good("figcaption", self.prose(rng.randint(3, 15))) + "</figure>",
                    lambda: "<table><tr>" + self.good("th", self.words(2)) + self.good("th", self.words(1)) + "</tr><tr>" + self.good("td", self.prose(3)) + self.good("td", self.prose(2)) + "</tr></table>",
                ))())
            else:
                out.append(rng.choice((lambda: self.wrap(ADVERT, self.junk()), lambda: self.wrap(SIDE, self.links(3)), lambda: self.form(), lambda: self.wrap(SHARE, self.links(3)), lambda: self.wrap(NOTICE, self.junk()), lambda: self.wrap(NAV, self.links(4)), lambda: self.wrap(SIDE, self.junk())))())
        return "".join(out)

    def plain(self) -> str:
        """A page of nothing but main text."""
        rng = self.rng
        inner = rng.choice((lambda: self.body(False), lambda: self.good("p", self.prose(30)) + self.good("pre", self.words(8)), lambda: self.bare()))()
        return rng.choice((lambda: inner, lambda: self.wrap(ARTICLE, inner)))()

    def bare(self) -> str:
        """Text right in its element."""
        text = self.prose(self.rng.randint(3, 80))
        self.main.add(" ".join(text.split()))
        return text

    def html(self) -> str:
        rng = self.rng
        head = "</head>" if rng.random() < 0.8 else ""
        if rng.random() < 0.08:
            return f"<html><head><title>{self.words(3)}</title>{head}<body>{self.plain()}" if rng.random() < 0.5 else self.plain()
        maybe = lambda p, make: make() if rng.random() < p else ""
        top = maybe(0.35, lambda: self.wrap(NOTICE, self.junk() + rng.choice(("", "<p>We use cookies</p>")))) + maybe(0.5, lambda: self.wrap(HEADER, rng.choice((f"<h1>{self.words(2)}</h1>", f"<a href=/>{self.words(2)}</a>", f"<p>{self.prose(6)}</p>")))) + maybe(0.8, lambda: self.wrap(NAV, self.links(rng.randint(2, 8))))
        top += maybe(0.4, lambda: self.wrap(ADVERT, self.junk(3, 30)))
        body = self.body() + maybe(0.15, lambda: self.comments()) + maybe(0.1, lambda: self.wrap(FOOTER, self.junk(3, 15)))
        article = self.wrap(ARTICLE, body)
        below = maybe(0.3, lambda: self.wrap(SHARE, self.links(3))) + maybe(0.35, lambda: self.comments()) + maybe(0.4, lambda: self.wrap(SIDE, rng.choice((lambda: self.links(5), lambda: self.junk(), lambda: f"<h4>{self.words(2)}</h4>" + self.links(3)))())) + maybe(0.25, lambda: self.form()) + maybe(0.25, lambda: self.wrap(ADVERT, self.junk(3, 60)))
        middle = article + below if rng.random() < 0.8 else below + article
        if rng.random() < 0.3:
            middle = self.wrap([("div", 'class="container"'), ("div", 'id="wrapper"'), ("main", ""), ("div", "")], middle)
        foot = maybe(0.85, lambda: self.wrap(FOOTER, rng.choice(("", "&copy; ", "Copyright ")) + self.prose(rng.randint(3, 25)) + maybe(0.3, lambda: self.links(4))))
        end = "</body></html>" if rng.random() < 0.7 else ""
        return f"<!DOCTYPE html><html><head><title>{self.words(5)}</title><style>p{{}}</style><script>var t='</p>';</script>{head}<body>{top}{middle}{foot}{end}"


def pages(count: int = 1200, seed: int = 11) -> list[tuple[str, set[str]]]:
    """(html, texts of the blocks that are main text) of count pages, the same for the same seed."""
    rng, out = random.Random(seed), []
    for _ in range(count):
        page = Page(rng)
        out.append((page.html(), page.main))
    return out

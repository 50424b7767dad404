"""Main-text extraction: gradient-boosted trees over DOM nodes, decoded down the tree.

Every element is scored as article, other or mixed from its subtree's density, its attribute tokens, depth and
siblings. Decoding picks, for each element from the root down, the best of: all of the subtree is article, none of it
is, or it is mixed and its children decide. So no element is article inside one that is not, or other inside one that
is all article, and the choice is the likeliest consistent one. Scripts, styles, forms and the like never count.

The trees are trained here, on pages that ``training_page`` writes from a fixed seed: articles in many layouts with
menus, headers, footers, sidebars, notices, adverts, forms and reader comments. Nothing of the input is learned from.

Null, empty and textless pages give the empty text; an empty table gives an empty one. Rows are independent: repeated rows do
no harm, equal choices go to article first. Time and memory follow a page's length, whatever its tags. Extra columns
come back but for text and n_chars, which the result's own replace.
"""

from __future__ import annotations

import random
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .arrowtext import slices
from .dom import Page, blocks
from .trees import Boosted, fit

ARTICLE, OTHER, MIXED = 0, 1, 2
PAGES, ROUNDS = 700, 30

#: Names that page builders give to parts; the training pages draw on them.
NAMES = {
    "nav": "nav menu navbar topnav navigation breadcrumb breadcrumbs links tabs toc pagination pager",
    "header": "header masthead banner site-header top-bar logo branding",
    "footer": "footer site-footer bottom copyright legal colophon",
    "aside": "sidebar aside widget related recommended popular trending more-stories rail secondary",
    "notice": "cookie consent notice gdpr alert popup modal overlay banner-message warning subscribe-wall",
    "ad": "ad ads advert advertisement sponsor sponsored promo promoted adsbox adslot dfp",
    "comments": "comments comment reader-comments responses replies discussion disqus thread",
    "social": "share social sharing follow buttons tools likes",
    "form": "form search newsletter signup login subscribe contact",
    "article": "article content post entry story main-content post-body article-body entry-content text body-text page-content",
}


def _names(kind: str, rnd: random.Random) -> str:
    name = rnd.choice(NAMES[kind].split())
    style = rnd.random()
    if style < 0.2:
        name = rnd.choice(["site-", "page-", "main-", "c-", "js-", "block-"]) + name
    elif style < 0.35:
        name += rnd.choice(["-wrapper", "-inner", "-list", "_box", "-container", "-2", "Block"])
    attr = rnd.choice(["class", "class", "class", "id"])
    return f' {attr}="{name}"'


class _Writer:
    """Invented pages. An element is a string; labels stand in data-y: 1 article, 0 other."""

    def __init__(self, rnd: random.Random):
        self.r = rnd
        self.syllables = ["".join(rnd.choice(p) for p in ("bcdfglmnprstv", "aeiouéü", "nrstl" + " " * 4)).strip() for _ in range(60)]
        self.common = [rnd.choice(self.syllables) for _ in range(12)]

    def words(self, n: int) -> list[str]:
        return [self.r.choice(self.common) if self.r.random() < 0.4 else "".join(self.r.choice(self.syllables) for _ in range(self.r.randint(1, 4))) for _ in range(n)]

    def phrase(self, lo: int, hi: int) -> str:
        return " ".join(self.words(self.r.randint(lo, hi))).capitalize()

    def sentence(self) -> str:
        w = self.words(self.r.randint(4, 22))
        for i in range(5, len(w) - 2, 6):
            if self.r.random() < 0.6:
                w[i] += ","
        return " ".join(w).capitalize() + self.r.choice([".", ".", ".", "!", "?"])

    def prose(self, lo: int, hi: int, links: float = 0.1) -> str:
        out = " ".join(self.sentence() for _ in range(self.r.randint(lo, hi)))
        w = out.split(" ")
        if self.r.random() < links:
            i = self.r.randrange(len(w))
            w[i] = f'<a href="/x">{w[i]}</a>'
        if self.r.random() < 0.2:
            i = self.r.randrange(len(w))
            w[i] = f"<{(t := self.r.choice(['b', 'em', 'i', 'strong', 'span']))}>{w[i]}</{t}>"
        return " ".join(w)

    def el(self, tag: str, inner: str, attrs: str = "", y: int | None = None) -> str:
        return f"<{tag}{attrs}{'' if y is None else f' data-y={y}'}>{inner}</{tag}>"

    def wrap(self, inner: str, attrs: str = "", y: int | None = None, tags: str = "div section") -> str:
        return self.el(self.r.choice(tags.split()), inner, attrs, y)

    def link_list(self, lo: int, hi: int) -> str:
        k = self.r.randint(lo, hi)
        if self.r.random() < 0.7:
            return self.el("ul", "".join(self.el("li", f'<a href="/{i}">{self.phrase(1, 4)}</a>') for i in range(k)))
        return self.r.choice([" | ", " ", " &middot; ", ""]).join(f'<a href="/{i}">{self.phrase(1, 3)}</a>' for i in range(k))

    def nav(self) -> str:
        named = self.r.random() < 0.7
        return self.el("nav" if self.r.random() < 0.6 else "div", self.link_list(3, 10), _names("nav", self.r) if named else "", 0)

    def header(self) -> str:
        inner = self.r.choice(["", f"<a href='/'>{self.phrase(1, 3)}</a>", self.el("h1", self.phrase(1, 3)), self.el("div", self.phrase(2, 5))]) + (self.el("p", self.phrase(3, 9)) if self.r.random() < 0.5 else "")
        return self.el("header" if self.r.random() < 0.6 else "div", inner or self.phrase(1, 3), _names("header", self.r), 0)

    def footer(self) -> str:
        inner = self.r.choice(["&copy; 2024 ", ""]) + self.r.choice([self.phrase(2, 8), self.prose(1, 3), self.link_list(3, 8), "x.example.com &middot; " + self.sentence()])
        inner = self.r.choice([inner, self.el("p", inner), self.el("div", inner) + self.el("div", self.link_list(2, 5))])
        return self.el("footer" if self.r.random() < 0.65 else "div", inner, _names("footer", self.r) if self.r.random() < 0.8 else "", 0) if self.r.random() < 0.65 else self.el("footer", inner, "", 0)

    def ad(self) -> str:
        inner = self.r.choice([self.sentence(), self.phrase(2, 6), self.prose(1, 3), f'<a href="/buy">{self.phrase(2, 7)}</a>', self.el("p", self.sentence())])
        return self.el(self.r.choice(["div", "div", "div", "aside", "section", "p"]), inner, _names("ad", self.r), 0)

    def notice(self) -> str:
        inner = self.r.choice([self.sentence(), self.el("p", self.prose(1, 3)), self.el("span", self.sentence()) + "<button>OK</button>"])
        return self.el(self.r.choice(["div", "div", "section", "aside"]), inner, _names("notice", self.r), 0)

    def form(self) -> str:
        inner = f"<label>{self.phrase(1, 3)}</label><input name=q><button>{self.phrase(1, 2)}</button>"
        lead = self.el("p", self.sentence()) if self.r.random() < 0.5 else ""
        return self.el("div", lead + self.el("form", inner), _names("form", self.r), 0)

    def social(self) -> str:
        return self.el("div", self.link_list(2, 5), _names("social", self.r), 0)

    def aside(self) -> str:
        title = self.el(self.r.choice(["h2", "h3", "h4", "div"]), self.phrase(1, 4))
        inner = self.r.choice([self.link_list(3, 8), "".join(self.el("p", self.sentence()) for _ in range(self.r.randint(1, 4))), "".join(self.el("div", f"<a href='/s'>{self.phrase(3, 9)}</a>" + self.el("p", self.sentence())) for _ in range(self.r.randint(2, 5)))])
        return self.el(self.r.choice(["aside", "aside", "div", "div", "section"]), title + inner, _names("aside", self.r) if self.r.random() < 0.8 else "", 0) if self.r.random() < 0.7 else self.el("aside", title + inner, "", 0)

    def comments(self) -> str:
        one = lambda: self.el(self.r.choice(["div", "li", "article", "section"]), self.r.choice([self.el("b", self.phrase(1, 2)), self.el("div", self.phrase(1, 2), ' class="author"'), self.el("span", self.phrase(1, 2))]) + self.r.choice([self.el("p", self.prose(1, 4)), self.prose(1, 3), self.el("div", self.prose(1, 3))]), self.r.choice(["", ' class="comment"', ' class="reply"', ' class="comment-body"']))
        title = self.el(self.r.choice(["h2", "h3"]), self.phrase(1, 3)) if self.r.random() < 0.6 else ""
        many = "".join(one() for _ in range(self.r.randint(1, 8)))
        return self.el(self.r.choice(["div", "section", "ol", "ul"]), title + many, _names("comments", self.r), 0)

    def article(self) -> str:
        """Blocks of the article, all labelled, with other things now and then between them."""
        r, out = self.r, []
        if r.random() < 0.85:
            head = self.el("h1", self.phrase(3, 14), "", 1)
            if r.random() < 0.2:
                head = self.el("header", head + (self.el("p", self.phrase(2, 6), ' class="byline"', 1) if r.random() < 0.3 else ""))
            out.append(head)
        style = r.random()
        broken = r.random() < 0.3
        for k in range(r.choice([1, 2, 3, 4, 5, 6, 8, 12])):
            body = self.prose(1, 9)
            if style < 0.7:
                block = f"<p data-y=1>{'<b>' if broken and not k else ''}{body}{'<br>' if broken and not k else '</p>'}"
            elif style < 0.85:
                block = self.el("div", body, "", 1)
            else:
                block = body + "<br><br>"
            out.append(block)
            x = r.random()
            if x < 0.08:
                out.append(self.el(r.choice(["h2", "h3"]), self.phrase(1, 6), "", 1))
            elif x < 0.13:
                out.append(self.el(r.choice(["ul", "ol"]), "".join(self.el("li", self.r.choice([self.phrase(2, 9), self.sentence()])) for _ in range(r.randint(2, 6))), "", 1))
            elif x < 0.17:
                out.append(self.el("blockquote", r.choice([self.el("p", self.prose(1, 2)), self.prose(1, 2)]), "", 1))
            elif x < 0.19:
                out.append(self.el("table", "".join(self.el("tr", "".join(self.el("td", self.phrase(1, 4)) for _ in range(3))) for _ in range(r.randint(2, 5))), "", 1))
            elif x < 0.21:
                out.append(self.el("pre", self.phrase(4, 20), "", 1))
            elif x < 0.24:
                out.append(self.el("figure", "<img src=x>" + self.el("figcaption", self.sentence()), "", 1))
            elif x < 0.30:
                out.append(self.ad())
            elif x < 0.33:
                out.append(r.choice([self.social, self.aside, self.form, self.notice])())
        inner = "".join(out)
        if style >= 0.85:  # bare text between breaks: the holder itself is article
            return self.el("div", inner, r.choice(["", _names("article", r)]), 1)
        return inner

    def page(self) -> str:
        r = self.r
        body = self.article()
        if r.random() < 0.2:
            body += r.choice([self.social, self.comments, self.aside])()
        if r.random() < 0.15:
            body = r.choice([self.social, self.notice, self.nav])() + body
        main = self.el("article", body, _names("article", r) if r.random() < 0.4 else "") if r.random() < 0.6 else self.el(r.choice(["div", "main", "section", "td"]), body, _names("article", r) if r.random() < 0.7 else "")
        for _ in range(r.randint(0, 2)):
            if r.random() < 0.5:
                main = self.wrap(main, r.choice(["", ' class="wrapper"', ' class="container"', ' id="main"', ' class="row"']), None, "div div main section")
        before = [f() for f in r.sample([self.header, self.nav, self.ad, self.notice, self.form, self.social, self.aside], r.randint(0, 4))]
        after = [f() for f in r.sample([self.footer, self.comments, self.aside, self.ad, self.nav, self.form, self.notice], r.randint(0, 5))]
        if r.random() < 0.5:
            before = [self.nav(), *before]
        if r.random() < 0.6:
            after.append(self.footer())
        body = "".join(before) + main + "".join(after)
        if r.random() < 0.35:
            body = self.wrap(body, r.choice(["", ' id="page"', ' class="site"', ' class="wrapper"']), None, "div")
        head = f"<head><title>{self.phrase(3, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>" if r.random() < 0.9 else ""
        return f"<!DOCTYPE html><html>{head}<body>{body}</body></html>"


def training_page(seed: int) -> str:
    """One invented page with labels in data-y."""
    return _Writer(random.Random(seed)).page()


def labels(page: Page) -> np.ndarray:
    """Per element whether its text is all article, all other or mixed; -1 without text."""
    n = len(page.tag)
    y = [0] * n
    for i in range(1, n):
        y[i] = int(page.note[i]) if page.note[i] is not None else y[page.parent[i]]
    has = np.zeros((n, 2), bool)
    for e, s in page.pieces:
        if s and not s.isspace() and not page.dropped[e]:
            has[e, y[e]] = True
    for i in range(n - 1, 0, -1):
        has[page.parent[i]] |= has[i]
    return np.where(has.all(1), MIXED, np.where(has[:, 1], ARTICLE, np.where(has[:, 0], OTHER, -1)))


@dataclass
class Extractor:
    odds: dict[str, float]
    trees: Boosted

    def choose(self, page: Page, score: np.ndarray) -> list[bool]:
        """The likeliest consistent choice of elements, from log shares per element."""
        n = len(page.tag)
        textful = [False] * n
        for e, s in page.pieces:
            if s and not s.isspace() and not page.dropped[e]:
                textful[e] = True
        own = list(textful)
        for i in range(n - 1, 0, -1):
            textful[page.parent[i]] |= textful[i]
        every = np.zeros((n, 2))
        for c in (ARTICLE, OTHER):
            every[:, c] = np.where(textful, score[:, c], 0.0)
        split = np.where(textful, score[:, MIXED], 0.0)
        best = np.zeros(n)
        for i in range(n - 1, -1, -1):
            best[i] = max(every[i, ARTICLE], every[i, OTHER], split[i])
            if i:
                p = page.parent[i]
                every[p] += every[i]
                split[p] += best[i]
        state = [MIXED] * n
        chosen = [False] * n
        for i in range(n):
            above = state[page.parent[i]] if i else MIXED
            state[i] = above if above != MIXED else int(np.argmax([every[i, ARTICLE], every[i, OTHER], split[i]]))
            # Text of a mixed element's own, between its children, goes by the element's other two shares.
            chosen[i] = state[i] == ARTICLE or state[i] == MIXED and own[i] and score[i, ARTICLE] > score[i, OTHER]
        return chosen

    def texts(self, sources: list[str | None]) -> list[str]:
        pages = [Page(s) if s else None for s in sources]
        rows = [p.features(self.odds) for p in pages if p]
        if not rows:
            return [""] * len(sources)
        score = self.trees.log_shares(np.concatenate(rows))
        out, at = [], 0
        for p in pages:
            if p is None:
                out.append("")
                continue
            n = len(p.tag)
            out.append(blocks(p, self.choose(p, score[at : at + n])))
            at += n
        return out


def train(pages: int = PAGES, rounds: int = ROUNDS) -> Extractor:
    """Trees from ``pages`` invented pages; the same ones each time."""
    read = [Page(training_page(seed)) for seed in range(pages)]
    known = [labels(p) for p in read]
    for_article, against = Counter(), Counter()
    for p, y in zip(read, known):
        for i, label in enumerate(y):
            if label in (ARTICLE, OTHER):
                (for_article if label == ARTICLE else against).update({"<" + p.tag[i], *p.tokens[i]})
    odds = {t: float(np.log((for_article[t] + 1) / (against[t] + 1))) for t in {*for_article, *against} if for_article[t] + against[t] >= 5}
    x, y = np.concatenate([p.features(odds) for p in read]), np.concatenate(known)
    weight = 1 + np.log1p(np.expm1(x[:, 5]) / 100)  # by length of text
    use = y >= 0
    return Extractor(odds, fit(x[use], y[use], weight[use], 3, rounds=rounds))


_trained: list[Extractor] = []


def extractor() -> Extractor:
    if not _trained:
        _trained.append(train())
    return _trained[0]


def extract(pages: DataFrame, model: Extractor | None = None, *, html_col: str = "html") -> DataFrame:
    """``pages`` with text and n_chars (code points), which replace columns of these names."""
    ship(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model or extractor())
    kept = [c for c in pages.columns if c not in ("text", "n_chars") or c == html_col]
    source = pages.select(*kept)
    out = [c for c in kept if c not in ("text", "n_chars")]
    schema = source.select(*out, F.lit("").cast("string").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def run(batches):
        for whole in batches:
            for batch in slices(whole, html_col):
                texts = shared.value.texts(batch.column(kept.index(html_col)).to_pylist())
                yield pa.RecordBatch.from_arrays([*(batch.column(kept.index(c)) for c in out), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*out, "text", "n_chars"])

    return source.mapInArrow(run, schema)

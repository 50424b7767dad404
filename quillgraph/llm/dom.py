"""A forgiving HTML reader and features of its nodes."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict

import numpy as np

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: What is inside is text of another kind, up to the closing tag.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
#: Never part of an article. A form is one only if it holds no more than half of the page's text: else the page stands in it.
DROPPED = {"script", "style", "noscript", "template", "head", "title", "iframe", "svg", "object", "form", "button", "select", "option", "textarea", "input", "canvas", "annotation", "annotation-xml", "datalist", "dialog"}
#: Formulas stand in their sentence.
FORMULA = {"math", "semantics", "mrow", "mi", "mn", "mo", "mtext", "mspace", "ms", "msup", "msub", "msubsup", "mfrac", "msqrt", "mroot", "mover", "munder", "munderover", "mfenced", "mstyle", "mpadded", "mphantom"}
INLINE = FORMULA | {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rb", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: An opening tag of the key closes an open element of these, unless one of the limits stands between.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_BLOCK_SCOPE = {"div", "article", "section", "main", "aside", "nav", "header", "footer", "td", "th", "li", "blockquote", "body", "table", "form", "figure", "button", "caption", "dd"}


class _Tags:
    """Finds the tags of a source one after the other, in time that follows its length whatever it holds.

    A tag ends at the first ``>`` outside quoted values or, if there is none up to the end, at the first one at all.
    """

    def __init__(self, source: str):
        self.source, self.last = source, source.rfind(">")
        self.dead: list[tuple[list[int], list[int]]] = []  # stretches outside quotes of scans that found no end
        self.open_quote = {}

    def next(self, at: int):
        """Start, end, whether it closes, name ("" for comments and declarations) and the rest of the next tag, or None."""
        source = self.source
        while 0 <= (at := source.find("<", at)) <= self.last or at >= 0 and source.startswith("<!--", at):
            if source.startswith("<!--", at):
                end = source.find("-->", at + 4)
                return at, len(source) if end < 0 else end + 3, "", "", ""
            m = _NAME.match(source, at)
            if m is None:
                if source[at + 1 : at + 2] in ("!", "?", "/"):
                    return at, source.find(">", at) + 1, "", "", ""
                at += 1
                continue
            end = self._end(m.end())
            return at, end, m[1], m[2].lower(), source[m.end() : end - 1]
        return None

    def _closing(self, quote: str, at: int) -> int:
        """The next such quote, or -1; asked once where there is none."""
        if at >= self.open_quote.get(quote, len(self.source)):
            return -1
        found = self.source.find(quote, at)
        if found < 0:
            self.open_quote[quote] = at
        return found

    def _end(self, at: int) -> int:
        source, plain, starts, ends = self.source, at, [at], []
        while True:
            if any(i and at < e[i - 1] for s, e in self.dead for i in (bisect_right(s, at),)):
                break
            stop = _STOP.search(source, at)
            if stop is None:
                break
            if stop[0] == ">":
                return stop.end()
            close = self._closing(stop[0], stop.end())
            at = stop.end() if close < 0 else close + 1
            if close >= 0:
                ends.append(stop.end())
                starts.append(at)
        ends.append(len(source))
        self.dead.append((starts, ends))
        return source.find(">", plain) + 1


class _Open:
    """The open elements, and where in the stack each tag and each block scope stands."""

    def __init__(self, tags: list[str]):
        self.tags, self.stack = tags, [0]
        self.at: dict[str, list[int]] = defaultdict(list)
        self.scopes: list[int] = []

    def push(self, e: int) -> None:
        name = self.tags[e]
        self.at[name].append(len(self.stack))
        if name in _BLOCK_SCOPE:
            self.scopes.append(len(self.stack))
        self.stack.append(e)

    def pop(self) -> int:
        e = self.stack.pop()
        self.at[self.tags[e]].pop()
        if self.tags[e] in _BLOCK_SCOPE:
            self.scopes.pop()
        return e

    def top(self, names) -> int:
        """The highest place of any of the tags, or 0."""
        return max((self.at[n][-1] for n in names if self.at[n]), default=0)

    def scope(self) -> int:
        return self.scopes[-1] if self.scopes else 0


class Page:
    """Elements in page order: tag, parent, attribute tokens; texts as (element, text, breaks)."""

    def __init__(self, source: str):
        self.tag, self.parent, self.tokens, self.note = ["#root"], [-1], [()], [None]
        self.pieces: list[tuple[int, str]] = []  # a text, or "" with the element that ends or begins a block here
        self._read(source)
        n = len(self.tag)
        self._open_forms()
        self.depth = [0] * n
        self.dropped = [False] * n
        for i in range(1, n):
            p = self.parent[i]
            self.depth[i] = self.depth[p] + 1
            self.dropped[i] = self.dropped[p] or self.tag[i] in DROPPED

    def _open_forms(self) -> None:
        """Forms around most of the page's text, but for what is dropped anyway, become plain blocks."""
        if "form" not in self.tag:
            return
        n = len(self.tag)
        size, gone = [0] * n, [False] * n
        for i in range(1, n):
            gone[i] = gone[self.parent[i]] or self.tag[i] in DROPPED - {"form"}
        for e, text in self.pieces:
            if not gone[e]:
                size[e] += len(text.strip())
        for i in range(n - 1, 0, -1):
            size[self.parent[i]] += size[i]
        for i in range(1, n):
            if self.tag[i] == "form" and 2 * size[i] > size[0]:
                self.tag[i], self.tokens[i] = "div", ()

    def _read(self, source: str) -> None:
        at, found, tags = 0, _Tags(source), self.tag
        open_ = _Open(tags)
        stack, parents, tokens, notes, pieces = open_.stack, self.parent, self.tokens, self.note, self.pieces

        def text(s: str) -> None:
            if s:
                pieces.append((stack[-1], html.unescape(s) if "&" in s else s))

        def close_to(i: int) -> None:
            while len(stack) > i:
                e = open_.pop()
                if tags[e] not in INLINE:
                    pieces.append((e, ""))

        while tag := found.next(at):
            text(source[at : tag[0]])
            _, at, closes, name, rest = tag
            if not name:
                continue
            if closes:
                i = open_.top((name,))
                if i and not (name in INLINE and open_.scope() > i):
                    close_to(i)
                continue
            if name not in INLINE and name not in VOID | RAW:  # a block ends an open paragraph
                i = open_.top(("p",))
                if i > open_.scope():
                    close_to(i)
            if name in CLOSES:
                ends, limits = CLOSES[name]
                i = open_.top(ends)
                if i > open_.top(limits):
                    close_to(i)
            if name == "body" and open_.at["head"]:
                close_to(open_.at["head"][0])
            words, note = [], None
            if rest.strip(" /"):
                for key, value in _ATTR.findall(rest):
                    key, value = key.lower(), value.strip("\"'")
                    if key in ("class", "id", "role", "itemprop", "aria-label", "data-component"):
                        words += [w.lower() for w in _TOKEN.findall(value)]
                    elif key == "data-y":
                        note = value
                    elif key == "hidden":
                        words.append("hidden")
            tags.append(name)
            parents.append(stack[-1])
            tokens.append(tuple(words))
            notes.append(note)
            e = len(tags) - 1
            if name not in INLINE:
                pieces.append((e, ""))
            if name in VOID or rest.endswith("/") and name in ("svg", "path", "rect"):
                continue
            if name in RAW:
                end = re.compile("</" + re.escape(name), re.I).search(source, at)
                end = end.start() if end else len(source)
                pieces.append((e, source[at:end]))
                at = source.find(">", end) + 1 or len(source)
                if name not in INLINE:
                    pieces.append((e, ""))
                continue
            open_.push(e)
        text(source[at:])

    def features(self, odds: dict[str, float]) -> np.ndarray:
        """A row per element. ``odds``: how far an attribute token or tag speaks for article text."""
        n = len(self.tag)
        chars, words, links, ends, marks, tags, paragraphs, anchors, items, texts = (np.zeros(n) for _ in range(10))
        first = np.full(n, -1.0)
        seen = 0
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = self.tag[i] == "a" or in_link[self.parent[i]]
        for e, s in self.pieces:
            s = s.strip() if s else s
            if not s or self.dropped[e]:
                continue
            k = len(s)
            if first[e] < 0:
                first[e] = seen
            seen += k
            chars[e] += k
            texts[e] += 1
            words[e] += s.count(" ") + 1
            ends[e] += s.count(". ") + s.endswith((".", "!", "?", "»", "\""))
            marks[e] += s.count(",")
            if in_link[e]:
                links[e] += k
        tags[1:] = 1
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            t = self.tag[i]
            paragraphs[i] += t == "p"
            anchors[i] += t == "a"
            items[i] += t == "li"
            for v in (chars, words, links, ends, marks, tags, paragraphs, anchors, items, texts):
                v[p] += v[i]
            if first[i] >= 0 and (first[p] < 0 or first[i] < first[p]):
                first[p] = first[i]
        total = max(seen, 1)
        longest = max(map(len, odds), default=0)
        own = [_score(self.tag[i], self.tokens[i], odds, longest) for i in range(n)]
        low, high = [0.0] * n, [0.0] * n
        children = [0] * n
        place, same, count_of = [0] * n, [0] * n, {}
        best = np.zeros(n)
        before, after = np.zeros(n), np.zeros(n)
        last_child = [-1] * n
        for i in range(1, n):
            p = self.parent[i]
            low[i], high[i] = min(low[p], own[p][0]), max(high[p], own[p][1])
            place[i] = children[p]
            children[p] += 1
            key = (p, self.tag[i])
            count_of[key] = count_of.get(key, 0) + 1
            best[p] = max(best[p], chars[i])
            if (k := last_child[p]) >= 0:
                before[i], after[k] = chars[k], chars[i]
            last_child[p] = i
        for i in range(1, n):
            same[i] = count_of[self.parent[i], self.tag[i]]
        parent = np.array(self.parent)
        parent[0] = 0
        siblings = np.array(children)[parent]
        log = np.log1p
        c1 = np.maximum(chars, 1)
        return np.stack([
            np.array([o[0] for o in own]), np.array([o[1] for o in own]), np.array(low), np.array(high), np.minimum(self.depth, 30), log(chars), chars / total, links / c1, chars / np.maximum(tags, 1),
            words / np.maximum(texts, 1), ends / np.maximum(words, 1) * 10, marks / np.maximum(words, 1) * 10, log(ends), np.maximum(first, 0) / total, log(paragraphs), log(anchors), log(items), log(np.array(children)),
            log(siblings), np.array(place) / np.maximum(siblings, 1), np.minimum(same, 20), chars / np.maximum(chars[parent], 1), chars / np.maximum(best[parent], 1), log(before), log(after), paragraphs / np.maximum(tags, 1), links[parent] / c1[parent], chars[parent] / total,
        ], 1)


def _score(tag: str, tokens: tuple, odds: dict[str, float], longest: int) -> tuple[float, float]:
    values = [odds.get("<" + tag, 0.0)]
    for t in tokens:
        if t in odds:
            values.append(odds[t])
        else:  # compound words: the strongest known beginning or end
            parts = [odds[t[:k]] for k in range(3, min(len(t), longest + 1)) if t[:k] in odds] + [odds[t[k:]] for k in range(max(1, len(t) - longest), len(t) - 2) if t[k:] in odds]
            if parts:
                values.append(max(parts, key=abs))
    return min(values), max(values)


def blocks(page: Page, chosen: list[bool]) -> str:
    """Text of the chosen elements: blocks in page order, joined by one space, their white space made one space each."""
    out, block = [], []
    for e, s in page.pieces:
        if not s:
            if block:
                out.append("".join(block))
                block = []
        elif chosen[e] and not page.dropped[e]:
            block.append(s)
    if block:
        out.append("".join(block))
    return " ".join(" ".join(b.split()) for b in out if b and not b.isspace())


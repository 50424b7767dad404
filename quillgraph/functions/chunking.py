"""Ways to cut a text into chunks. Each takes a text and gives (start, end) spans that together cover it."""

from __future__ import annotations

import re

#: Boundary patterns and priorities (fixed values).
BOUNDARIES = {
    "paragraph": (r"\n\s*\n", 5),
    "sentence": (r"[.!?]+\s+(?=[A-Z])", 3),
    "section": (r"\n#+\s+", 8),
    "list": (r"\n\s*[-*+]\s+", 4),
    "code": (r"```[\s\S]*?```", 9),
    "quote": (r"\n>\s+", 6),
}


def fixed(text: str, size: int = 1000, overlap: int = 100) -> list[tuple[int, int]]:
    """Steps of size less overlap, at least one character; the last chunk may be all overlap."""
    return [(a, min(a + size, len(text))) for a in range(0, len(text), max(size - overlap, 1))]


def boundaries(text: str) -> list[tuple[int, int, str, int]]:
    """(position, end, kind, priority) in order; of several at one place the one of highest priority."""
    best: dict[int, tuple[int, int, str, int]] = {}
    for kind, (pattern, priority) in BOUNDARIES.items():
        for m in re.finditer(pattern, text):
            if m.start() not in best or best[m.start()][3] < priority:
                best[m.start()] = (m.start(), m.end(), kind, priority)
    return [best[k] for k in sorted(best)]


def _pack(ends: list[int], length: int, fits) -> list[tuple[int, int]]:
    """Greedy spans that end at one of ``ends``: as far as ``fits`` allows, or to the next end where nothing fits."""
    out, start, good = [], 0, 0
    for end in ends:
        if fits(start, end):
            good = end
            continue
        if good > start:
            out.append((start, good))
            start = good
        if fits(start, end):
            good = end
        else:
            out.append((start, end))
            start = good = end
    if good > start and good < length and not fits(start, length):
        out.append((start, good))
        start = good
    if start < length:
        out.append((start, length))
    return [s for s in out if s[0] < s[1]]


def semantic(text: str, size: int = 1000) -> list[tuple[int, int]]:
    """Ends at boundaries, up to ``size`` characters where the boundaries allow it."""
    return _pack([b[1] for b in boundaries(text)], len(text), lambda a, b: b - a <= size)


def estimate_tokens(text: str) -> int:
    return -(-len(text) // 4)


def token_aware(text: str, most: int = 250) -> list[tuple[int, int]]:
    """Ends at boundaries, up to ``most`` estimated tokens."""
    return _pack([b[1] for b in boundaries(text)], len(text), lambda a, b: -(-(b - a) // 4) <= most)


def adaptive(text: str, low: int = 200, high: int = 1500) -> list[tuple[int, int]]:
    """Segments between boundaries grouped up to ``high``; a last group under ``low`` joins the one before it."""
    spans = _pack([b[1] for b in boundaries(text)], len(text), lambda a, b: b - a <= high)
    if len(spans) > 1 and spans[-1][1] - spans[-1][0] < low and spans[-1][1] - spans[-2][0] <= high + low:
        spans[-2:] = [(spans[-2][0], spans[-1][1])]
    return spans


def hierarchical(text: str, size: int = 1000) -> list[tuple[int, int]]:
    """Markdown sections; those over ``size`` are cut further. Text before the first header is a section of its own."""
    starts = sorted({0, *(m.start() + (m[0][0] == "\n") for m in re.finditer(r"(?:\A|\n)#{1,6} ", text))})
    out = []
    for a, b in zip(starts, [*starts[1:], len(text)]):
        out += [(a + x, a + y) for x, y in semantic(text[a:b], size)] if b - a > size else [(a, b)] if a < b else []
    return out


def windows(text: str, size: int = 1000, overlap: float = 0.1) -> list[tuple[int, int]]:
    """Overlapping windows that end and begin at white space."""
    out, at, stride = [], 0, max(1, int(size * (1 - overlap)))
    while at < len(text):
        end = min(at + size, len(text))
        while end < len(text) and not text[end].isspace():
            end += 1
        out.append((at, end))
        if end == len(text):
            break
        at += stride
        while at < len(text) and not text[at].isspace():
            at += 1
    return out


def merge_windows(parts: list[str]) -> str:
    """Texts joined at their largest word-aligned overlap, else by a space."""
    if not parts:
        return ""
    out = parts[0]
    for part in parts[1:]:
        least = min(10, len(part) // 10)
        for n in range(min(len(out), len(part)), max(least, 1) - 1, -1):
            if out.endswith(part[:n]) and not (len(out) > n and out[-n - 1].isalnum()) and not (len(part) > n and part[n].isalnum()):
                out += part[n:]
                break
        else:
            out += " " + part
    return out.strip()


def pick_strategy(text: str, *, most_tokens: int | None = None, balance: bool = False, semantic_boundaries: bool = True) -> str:
    if most_tokens:
        return "token_aware"
    if re.search(r"(?:\A|\n)#{1,6} ", text):
        return "hierarchical"
    if semantic_boundaries:
        return "semantic"
    return "adaptive" if balance else "fixed"


def balance(spans: list[tuple[int, int]], target: int) -> list[tuple[int, int]]:
    """Spans over 1.2 times the target cut in even parts; neighbours that together stay under 0.8 of it joined."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        n = b - a
        if n > 1.2 * target:
            k = -(-n // target)
            edges = [a + n * i // k for i in range(k + 1)]
            out += list(zip(edges, edges[1:]))
        elif out and out[-1][1] == a and b - out[-1][0] <= 0.8 * target:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def knapsack(items: list[tuple[int, float, int]], budget: int, by: str = "priority") -> list[int]:
    """Keys of (key, priority, tokens) taken greedily; one that doesn't fit is passed over and the next ones tried."""
    order = {"priority": lambda x: (-x[1], x[0]), "efficiency": lambda x: (-x[1] / max(x[2], 1), x[0]), "size": lambda x: (x[2], x[0])}[by]
    out, left = [], budget
    for key, _, tokens in sorted(items, key=order):
        if tokens <= left:
            out.append(key)
            left -= tokens
    return out


def hash31(text: str) -> int:
    """A signed 32-bit rolling hash over UTF-16 code units."""
    h = 0
    raw = text.encode("utf-16-le", "surrogatepass")
    for lo, hi in zip(raw[::2], raw[1::2]):
        h = (h * 31 + lo + 256 * hi) & 0xFFFFFFFF
    return h - (1 << 32) if h >> 31 else h


def hash_embedding(text: str, dims: int = 64) -> list[float]:
    """The deterministic stand-in for an embedding model: a 32-bit rolling hash, spread over places."""
    h = hash31(text)
    value = [int(abs(h + 31 * i) % 1000) * (1 if h + 31 * i >= 0 else -1) / 1000 - 0.5 for i in range(dims)]
    return value

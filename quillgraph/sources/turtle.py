"""Turtle files as tables of triples. Files that ``ntriples.write`` makes are Turtle, too, so that is the writer.

A file is read by one task, as prefixes hold for a whole file; many files are read at once. Read are prefixes and bases,
lists of predicates (;) and objects (,), ``a``, literals of all forms with language or datatype, numbers, booleans, blank
nodes and property lists in brackets. Collections in parentheses are not: a file with one fails with its name.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

RDF, XSD = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2001/XMLSchema#"
_TOKEN = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)|<(?P<iri>[^<>"{}|^`\\\s]*)>|(?P<long>\"{3}(?:[^"\\]|\\.|"(?!""))*\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3})|(?P<short>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
    r"""|@(?P<at>[a-zA-Z]+(?:-[a-zA-Z0-9]+)*)|(?P<type>\^\^)|(?P<blank>_:[\w.-]*[\w-])|(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))|(?P<name>(?:[^\W\d_][\w.-]*)?:(?:[\w:%-](?:[\w.:%-]*[\w:%-])?)?)|(?P<word>[a-zA-Z]+)|(?P<mark>[;,.\[\]()])""",
    re.S,
)
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}


def _unescaped(text: str) -> str:
    return re.sub(r"\\(u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _ESCAPES.get(m[1], m[1]), text, flags=re.S)


def triples(source: str, base: str = "") -> Iterator[tuple]:
    """s, p, o, o_type, lang, datatype of one file's text."""
    tokens, at = [], 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise ValueError(f"not Turtle at {source[at : at + 30]!r}")
        at = m.end()
        if m.lastgroup != "space":
            tokens.append((m.lastgroup, m[m.lastgroup]))
    prefixes: dict[str, str] = {}
    place, made = 0, 0
    out: list[tuple] = []

    def peek() -> tuple[str, str]:
        return tokens[place] if place < len(tokens) else ("end", "")

    def take(mark: str | None = None) -> tuple[str, str]:
        nonlocal place
        token = peek()
        if token[0] == "end" or mark and token[1] != mark:
            raise ValueError(f"{mark or 'more'} expected, not {token[1]!r}")
        place += 1
        return token

    def named(kind: str, text: str) -> str:
        if kind == "iri":
            return urljoin(base, text) if base else text
        prefix, local = text.split(":", 1)
        if prefix not in prefixes:
            raise ValueError(f"no prefix {prefix!r}")
        return prefixes[prefix] + local

    def node() -> tuple[str, str, str | None, str | None]:
        nonlocal made
        kind, text = take()
        if kind in ("iri", "name"):
            return named(kind, text), "uri", None, None
        if kind == "blank":
            return text, "blank", None, None
        if text == "[":
            made += 1
            own = f"_:b{made}"
            if peek()[1] != "]":
                predicates(own)
            take("]")
            return own, "blank", None, None
        if kind in ("long", "short"):
            value = _unescaped(text[3:-3] if kind == "long" else text[1:-1])
            if peek()[0] == "at":
                return value, "literal", take()[1], None
            if peek()[0] == "type":
                take()
                return value, "literal", None, named(*take())
            return value, "literal", None, None
        if kind == "number":
            return text, "literal", None, XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer")
        if text in ("true", "false"):
            return text, "literal", None, XSD + "boolean"
        raise ValueError(f"no node: {text!r}")

    def predicates(subject: str) -> None:
        while True:
            kind, text = take()
            predicate = RDF + "type" if text == "a" and kind == "word" else named(kind, text)
            while True:
                out.append((subject, predicate, *node()))
                if peek()[1] != ",":
                    break
                take()
            while peek()[1] == ";":
                take()
            if peek()[1] in (".", "]") or peek()[0] == "end":
                return

    while place < len(tokens):
        kind, text = peek()
        if kind in ("at", "word") and text.lower() in ("prefix", "base"):
            take()
            if text.lower() == "prefix":
                name = take()[1]
                prefixes[name.split(":", 1)[0]] = named(*take())
            else:
                base = named(*take())
            if kind == "at":
                take(".")
            continue
        bracket = text == "["
        subject = node()[0]
        if not (bracket and peek()[1] == "."):
            predicates(subject)
        take(".")
    yield from out


def read(spark: SparkSession, path: str) -> DataFrame:
    """s, p, o, o_type (uri, blank, literal), lang, datatype of all files; blank nodes carry their file's number."""
    ship(spark)
    names = ["s", "p", "o", "o_type", "lang", "datatype"]

    def run(batches):
        for batch in batches:
            for text, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows = list(triples(text))
                except ValueError as wrong:
                    raise ValueError(f"{name}: {wrong}") from None
                own = f"{zlib.crc32(name.encode()):x}"
                mark = lambda v: f"_:{own}.{v[2:]}" if v.startswith("_:") else v
                rows = [(mark(s), p, mark(o) if t == "blank" else o, t, lang, kind) for s, p, o, t, lang, kind in rows]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(6)], names=names)

    files = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("name"))
    return files.mapInArrow(run, ", ".join(f"{n} string" for n in names))


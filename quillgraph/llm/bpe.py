"""Byte-pair encoding and decoding by tree concatenation.

A text is cut into pre-tokens. A pre-token longer than ``piece`` symbols is encoded as a tree: its
halves are encoded apart, then windows that grow around each join are encoded again until their
first token is one of the left half and their last token one of the right half. Each neighbouring
pair of tokens then stands in an encoding of its own, so the whole is what one pass would give.
Texts longer than ``segment`` characters are also cut into rows that separate tasks encode; where a
cut falls inside a long unsplit run, the same join mends it. Which symbols of a segment are the open part of such a run
says the pre-tokeniser itself: the segment's first or last pre-token.

Nulls and empty texts encode to nothing. Rows are independent: repeated rows, ties of ids and null ids give a row each;
an empty table gives an empty one; of extra columns, whatever their names, none is read. A text takes memory for one
segment at a time while it is encoded, and for its ids when its segments are joined.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .memory import lean

#: Words of at most 64 characters whose tokens a task remembers.
PIECE, SEGMENT, CACHE = 1024, 32_768, 150_000
_SPACE = "\t\n\x0b\x0c\r \x85\xa0"
_LATIN = [chr(c) for c in range(0x180)]
_LETTERS = re.escape("".join(c for c in _LATIN if unicodedata.category(c)[0] == "L"))
_NUMBERS = re.escape("".join(c for c in _LATIN if unicodedata.category(c)[0] == "N"))
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}{re.escape(_SPACE)}]+")
_BEYOND = re.compile("[^\x01-įı-ſ]")  # the null character marks spelt words, so it counts as beyond
_RUN = re.compile(r"[A-Za-z]{64}|[!-/:-@\[-`{-~]{64}")


def _byte_symbols() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256))
    return [chr(b) if b in plain else chr(256 + next(rest)) for b in range(256)]


_SYMBOL = _byte_symbols()
_AS_SYMBOLS = {b: _SYMBOL[b] for b in range(256)}


#: The rules that this module spells out for Latin text; files with other rules are refused.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


class BpeCodec:
    """Encodes and decodes as the tokenizers library does with the same file, without special tokens added."""

    def __init__(self, path: str, piece: int = PIECE):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec["pre_tokenizer"]["pretokenizers"][0] if spec["pre_tokenizer"]["type"] == "Sequence" else {}
        plain = all(not t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if spec["normalizer"] != _NORMALIZER or split.get("pattern", {}).get("Regex") != _SPLIT or not plain:
            raise ValueError(f"{path} normalises or splits text by other rules than this codec knows")
        self.tokenizer, self.piece = Tokenizer.from_file(path), piece
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self._last = self._inner = self.tokenizer.model
        if self.suffix:
            merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
            self._inner = BPE(vocab=model["vocab"], merges=merges)
        self._special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._split = re.compile("(" + "|".join(map(re.escape, self._special)) + ")") if self._special else None
        self._token = None if spec["decoder"] else {str(i): t for t, i in self.tokenizer.get_vocab(True).items()}
        self._cache: dict[str, tuple[int, str]] = {}

    def leaf(self, symbols: str, last: bool) -> list[tuple[int, str]]:
        return [(t.id, t.value) for t in (self._last if last else self._inner).tokenize(symbols)]

    def tree(self, symbols: str, last: bool = True) -> list[tuple[int, str]]:
        """The tokens of one pre-token, or of an inner part of it (last: it ends the pre-token)."""
        if len(symbols) <= self.piece:
            return self.leaf(symbols, last)
        half = len(symbols) // 2
        return self.join(symbols, self.tree(symbols[:half], False), self.tree(symbols[half:], last), half, last)

    def _width(self, token: tuple[int, str], ends: bool) -> int:
        return len(token[1]) - (len(self.suffix) if ends else 0)

    def join(self, symbols: str, left: list, right: list, cut: int, last: bool) -> list:
        """The tokens of ``symbols`` from those of its two parts."""
        reach = 16
        while True:
            i, lo = len(left), cut
            while i and cut - lo < reach:
                i -= 1
                lo -= self._width(left[i], False)
            j, hi = 0, cut
            while j < len(right) and hi - cut < reach:
                hi += self._width(right[j], last and j == len(right) - 1)
                j += 1
            window = self.leaf(symbols[lo:hi], last and j == len(right))
            if (not i or window[0] == left[i]) and (j == len(right) or window[-1] == right[j - 1]):
                return left[:i] + window + right[j:]
            reach *= 2

    def _library_words(self, text: str) -> list[str]:
        """Pre-tokens as byte symbols, for text beyond Latin, as the library itself cuts it."""
        normal = self.tokenizer.normalizer.normalize_str(text)
        return ["\0" + w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def symbols(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(_AS_SYMBOLS)

    def words(self, text: str) -> list[str]:
        """Pre-tokens; after one null character spelt in byte symbols already, after two a special token."""
        out: list[str] = []
        for k, part in enumerate(self._split.split(text) if self._split and "<|" in text else (text,)):
            if k % 2:
                out.append("\0\0" + part)
            elif part:
                out += self._library_words(part) if _BEYOND.search(part) else _WORDS.findall(part.lower())
        return out

    def spelt(self, word: str) -> str:
        """A pre-token in byte symbols."""
        return word[1:] if word[0] == "\0" else self.symbols(word)

    def _word(self, word: str) -> tuple[int, str]:
        if word[:2] == "\0\0":
            return 1, str(self._special[word[2:]])
        tokens = self.tree(self.spelt(word))
        found = (len(tokens), " ".join([str(i) for i, _ in tokens]))
        if len(word) <= 64:
            if len(self._cache) >= CACHE:
                self._cache.clear()
            self._cache[word] = found
        return found

    def encode_words(self, words: list[str]) -> tuple[int, str]:
        cache = self._cache
        found = [cache.get(w) or self._word(w) for w in words]
        return sum([n for n, _ in found]), " ".join([ids for n, ids in found if n])

    def encode(self, text: str | None) -> tuple[int, str]:
        """Number of tokens, and decimal ids joined by one space."""
        return self.encode_words(self.words(text)) if text else (0, "")

    def decode(self, ids: str) -> str:
        """The text of decimal ids joined by spaces, as the library's decode with special tokens kept."""
        if not ids:
            return ""
        if self._token is None:
            return self.tokenizer.decode([int(i) for i in ids.split(" ")], skip_special_tokens=False)
        return " ".join([self._token[i] for i in ids.split(" ")])

    def forget(self) -> None:
        self._cache.clear()


def cuts(text: str, segment: int) -> list[tuple[int, bool]]:
    """Where to cut a long text, and whether a cut falls inside an unsplit run. Each is at white space or between
    digits if the half before it has such a place, else in a run of 64 like characters; with neither, later."""
    out, at = [], 0
    while len(text) - at > segment:
        lo, hi = at + segment // 2, at + segment
        place = max(text.rfind(c, lo, hi) for c in " \n\t\r")
        if place > 0:
            out.append((place, False))
        else:
            hard = _RUN.search(text, hi - 32)
            soft = re.compile(r"[ \t\r\n]|(?<=[0-9])[0-9]").search(text, lo)
            if soft and (not hard or soft.start() < hard.start() + 32):
                out.append((soft.start(), False))
            elif hard:
                out.append((hard.start() + 32, True))
            else:
                break
        at = out[-1][0]
    return out


_codecs: dict[str, BpeCodec] = {}


def codec(path: str) -> BpeCodec:
    if path not in _codecs:
        _codecs[path] = BpeCodec(path)
    return _codecs[path]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encode_segments(c: BpeCodec, pieces: list[str], hard: list[bool]) -> tuple[int, str]:
    """A text from its segments; hard[i]: the cut after segment i is inside an unsplit run."""
    return merge_segments(c, [encode_segment(c, p, i > 0 and hard[i - 1], i < len(hard) and hard[i]) for i, p in enumerate(pieces)])


def encode_segment(c: BpeCodec, text: str, open_start: bool, open_end: bool) -> dict:
    """One segment: ids of its whole pre-tokens, and the pre-tokens at its open ends encoded as parts of a longer run."""
    words = c.words(text)
    if open_start and open_end and len(words) == 1:
        run = c.spelt(words[0])
        return {"n": 0, "ids": "", "head": run, "head_tokens": c.tree(run, False), "tail": "", "tail_tokens": [], "through": True}
    head, tail = c.spelt(words[0]) if open_start else "", c.spelt(words[-1]) if open_end else ""
    n, ids = c.encode_words(words[bool(head) : len(words) - bool(tail)])
    return {"n": n, "ids": ids, "head": head, "head_tokens": c.tree(head, True) if head else [], "tail": tail, "tail_tokens": c.tree(tail, False) if tail else [], "through": False}


def merge_segments(c: BpeCodec, segments: list[dict]) -> tuple[int, str]:
    """Segments in order joined to one text's encoding."""
    n, ids, run, open_tokens = 0, [], "", []

    def put(k: int, i: str) -> None:
        nonlocal n
        if k:
            n += k
            ids.append(i)

    for s in segments:
        if s["head"]:
            whole = run + s["head"]
            joined = c.join(whole, open_tokens, s["head_tokens"], len(run), not s["through"]) if run else s["head_tokens"]
            if s["through"]:
                run, open_tokens = whole, joined
                continue
            put(len(joined), " ".join(str(i) for i, _ in joined))
        run, open_tokens = s["tail"], s["tail_tokens"]
        put(s["n"], s["ids"])
    return n, " ".join(ids)


_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_digests(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", segment: int = SEGMENT, texts: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, number of tokens, digests of ids and of the decoded text (texts: both in full, too)."""
    ship(docs.sparkSession)
    schema = _SCHEMA + (", ids string, decoded string" if texts else "")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def rows(batches, c: BpeCodec, encode_row) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in names]
            for key, *rest in zip(*[col.to_pylist() for col in batch.columns]):
                n, ids = encode_row(*rest)
                decoded = c.decode(ids)
                for column, value in zip(out, [key, n, _sha(ids), _sha(decoded), ids, decoded]):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), *[pa.string()] * (len(names) - 2)]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=names)

    def short(batches):
        from .arrowtext import slices

        c = codec(path)
        yield from rows((s for b in batches for s in slices(b, "text")), c, c.encode)
        c.forget()

    def cut(batches):
        for batch in batches:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                places = cuts(text, segment)
                row = hashlib.sha256(f"{key} {text}".encode()).hexdigest()
                edges = [(0, False), *places, (len(text), False)]
                out += [(key, row, i, a, b, text[a:b], start, end) for i, ((a, start), (b, end)) in enumerate(zip(edges, edges[1:]))]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate([pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()])], names=["doc_id", "row", "i", "a", "b", "part", "open_start", "open_end"])

    def encode_parts(batches):
        c = codec(path)
        for batch in batches:
            d = batch.to_pydict()
            done = [json.dumps(encode_segment(c, t, s, e)) for t, s, e in zip(d["part"], d["open_start"], d["open_end"])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), batch.column("i"), pa.array(done, pa.string())], names=["doc_id", "row", "i", "done"])
        c.forget()

    def finish(batches):
        c = codec(path)

        def merged(parts):
            parts = [json.loads(p["done"]) for p in sorted(parts, key=lambda p: p["i"])]
            for p in parts:
                p["head_tokens"], p["tail_tokens"] = [tuple(t) for t in p["head_tokens"]], [tuple(t) for t in p["tail_tokens"]]
            return merge_segments(c, parts)

        yield from rows(batches, c, merged)

    is_long = F.length("text") > segment
    long = (
        docs.where(is_long)
        .mapInArrow(lean(cut), "doc_id long, row string, i int, a long, b long, part string, open_start boolean, open_end boolean")
        .repartition("row", "i")
        .mapInArrow(lean(encode_parts), "doc_id long, row string, i int, done string")
    )
    # Repeated rows give the same segments again: they are counted, joined once and then repeated.
    whole = (
        long.groupBy("doc_id", "row", "i").agg(F.first("done").alias("done"), F.count("*").alias("copies"))
        .groupBy("doc_id", "row").agg(F.collect_list(F.struct("i", "done")).alias("parts"), F.first("copies").alias("copies"))
        .select("doc_id", "parts", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")
        .mapInArrow(lean(finish), schema)
    )
    return docs.where(~is_long | F.col("text").isNull()).mapInArrow(lean(short), schema).unionByName(whole)

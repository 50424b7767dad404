"""Language identification by the nearest of several centroids per language.

A text is a TF-IDF vector over hashed byte n-grams (1 to 3) of its letters, A-Z lower-cased, all else one space. Each
language has up to ``clusters`` centroids from spherical k-means; a text takes the language of the centroid with the
largest cosine and is rejected when even that cosine is below ``min_cosine`` or the centroid's own cut-off for texts of
that length: ``MARGIN`` times the 1 % quantile of the labelled texts' cosines with it, by octaves of n-grams in a text. Where a
centroid has under ``ENOUGH`` texts of an octave those of all centroids count; without enough, the next shorter octave's.

Document frequencies, centroids and cut-offs come from all labelled rows: their counts are written once and read by each
pass, tasks give sums of integers (so that their order doesn't matter), and the driver gets those of a language or
centroid. Languages have equal shares in the document frequencies, whatever their sizes. ``sample_rows`` fits on so many
rows instead, shared evenly by the languages and chosen by a hash of the id. Nulls and texts without letters are ``und``
with score 0 and count as rejected; without any labelled row nothing is learned and every text is. More languages than
``MOST`` are refused. Rows are independent: repeated rows do no harm, equal cosines go to the first language by name, an
empty table gives an empty one, a very long text is one vector like any other. Extra columns come back but for lang_pred,
score and rejected, which the result's own replace.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..shipping import ship
from .arrowtext import buffers, slices
from .blobs import pack, unpack
from .memory import lean, lean_group
from .tables import done, settled

FEATURES, CLUSTERS, MIN_COSINE = 4096, 4, 0.05
#: Languages, and centroids in all: with many languages each has fewer.
MOST = 4000
#: Passes of k-means at most; parts that sums are added in; sums that a task holds at once.
ROUNDS, SEGMENTS, HELD = 12, 8, 500
#: Steps of a cosine: where a new centroid starts, and in quantiles. A component of a vector in sums: 250 stay exact in single precision.
BINS, LEVELS, UNIT = 512, 10_000, 1 << 16
OCTAVES, ENOUGH, MARGIN = 32, 20, 0.7
#: Texts whose counts are held at once.
ROWS, SLICE = 250, 500_000
UNKNOWN = "und"

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
_LOG = np.log1p(np.arange(1 << 14, dtype=np.float32))


def gram_counts(column) -> np.ndarray:
    """Counts of hashed n-grams, a row per text."""
    data, offsets = buffers(column)
    rows = len(offsets) - 1
    b = _LETTER[data]
    row = np.repeat(np.arange(rows, dtype=np.int32), np.diff(offsets))
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32) | (row[1:] != row[:-1])
    b, row = b[keep].astype(np.uint32), row[keep]
    counts = np.zeros(rows * FEATURES, np.int32)
    gram = np.zeros(len(b), np.uint32)
    for n in (1, 2, 3):
        if len(b) < n:
            break
        gram = gram[: len(b) - n + 1] * np.uint32(256) + b[n - 1 :]
        same = row[: len(b) - n + 1] == row[n - 1 :]
        slot = ((gram * np.uint32(2654435761) + np.uint32(n * 40503)) * np.uint32(2246822519)) >> np.uint32(20)
        at = (row[: len(b) - n + 1] * FEATURES + slot.view(np.int32) if rows < 1 << 18 else row[: len(b) - n + 1] * np.int64(FEATURES) + slot)[same]
        counts += np.bincount(at, minlength=rows * FEATURES).astype(np.int32)
    return counts.reshape(rows, FEATURES)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def lettered(column) -> np.ndarray:
    """Which texts have a letter; only those without ASCII letters are looked at one by one."""
    data, offsets = buffers(column)
    plain = np.concatenate([[0], np.cumsum((_LETTER[data] != 32) & (data < 128))])
    out = plain[offsets[1:]] > plain[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = has_letter(column[int(i)].as_py())
    return out


@dataclass
class Centroids:
    languages: list[str]
    owner: np.ndarray
    idf: np.ndarray
    centres: np.ndarray
    least: np.ndarray | None = None

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = (_LOG[counts] if counts.max(initial=0) < len(_LOG) else np.log1p(counts.astype(np.float32))) * self.idf
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(norm > 0, norm, 1)

    def closest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid (an index) and its cosine."""
        cosine = self.vectors(counts) @ self.centres.T
        best = cosine.argmax(1)
        return best, cosine[np.arange(len(best)), best].astype(float)

    def nearest(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language (an index) and cosine of the nearest centroid, and that centroid's cut-off."""
        best, cosine = self.closest(counts)
        return self.owner[best], cosine, self.least[best, _octave(counts)]


def _octave(counts: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(counts.sum(1), 1)).astype(int).clip(0, OCTAVES - 1)


def _texts(batches) -> Iterator[tuple[str, np.ndarray]]:
    """Languages and counts of runs of texts."""
    for batch in batches:
        for lang, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield lang, unpack(packed.as_py(), np.int32).reshape(-1, FEATURES)


def _features(rows: DataFrame) -> DataFrame:
    """Counts of all texts with letters, packed by runs of at most ROWS texts of a language."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", SLICE, ROWS):
                some = np.flatnonzero(lettered(batch.column(0)))
                if len(some):
                    counts = gram_counts(batch.column(0))
                    names, lang = np.unique(np.array(batch.column(1).to_pylist(), object)[some], return_inverse=True)
                    own = [some[lang == i] for i in range(len(names))]
                    packed = [pack(counts[at].astype(np.uint32).ravel()) for at in own]
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(packed, pa.binary()), pa.array([len(at) for at in own], pa.int64())], names=["lang", "counts", "n"])

    return settled(rows.mapInArrow(lean(run), "lang string, counts binary, n long"))


def _sums(features: DataFrame, adding: Callable) -> dict[int, np.ndarray]:
    """Sums, by place, of the rows of integers that ``adding(language, counts)`` gives with their places."""
    width = FEATURES // SEGMENTS

    def flush(held):
        packed = [pack(row[i : i + width].astype(np.uint64)) for row in held.values() for i in range(0, FEATURES, width)]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(list(held), SEGMENTS), pa.int32()), pa.array(np.tile(np.arange(SEGMENTS), len(held)), pa.int32()), pa.array(packed, pa.binary())], names=["place", "segment", "sums"])

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for lang, counts in _texts(batches):
            for place, row in adding(lang, counts):
                held[place] = held[place] + row if place in held else row
            if len(held) >= HELD:
                yield flush(held)
                held.clear()
        if held:
            yield flush(held)

    def added(table: pa.Table) -> pa.Table:
        total = sum(unpack(b, np.int64) for b in table.column("sums").to_pylist())
        return pa.table([*(table.column(c).slice(0, 1) for c in ("place", "segment")), pa.array([pack(total.astype(np.uint64))], pa.binary())], names=["place", "segment", "sums"])

    out: dict[int, np.ndarray] = {}
    for r in features.mapInArrow(lean(run), "place int, segment int, sums binary").groupBy("place", "segment").applyInArrow(lean_group(added), "place int, segment int, sums binary").collect():
        out.setdefault(r.place, np.zeros(FEATURES, np.int64))[r.segment * width : (r.segment + 1) * width] = unpack(bytes(r.sums), np.int64)
    return out


def _unit(c: np.ndarray) -> np.ndarray:
    return (c / np.maximum(np.linalg.norm(c, axis=-1, keepdims=True), 1e-9)).astype(np.float32)


def _means(features: DataFrame, model: Centroids) -> dict[int, np.ndarray]:
    """Sums, by centroid, of the vectors that are nearest to it among those of their language."""
    shared = features.sparkSession.sparkContext.broadcast(model)

    def nearest(lang, counts):
        model = shared.value
        lo, hi = np.searchsorted(model.owner, [model.languages.index(lang), model.languages.index(lang) + 1])
        x = model.vectors(counts)
        own = (x @ model.centres[lo:hi].T).argmax(1)
        sums = (np.arange(hi - lo)[:, None] == own).astype(np.float32) @ np.rint(x * np.float32(UNIT))
        return [(int(lo + i), sums[i].astype(np.int64)) for i in np.unique(own)]

    out = _sums(features, nearest)
    shared.unpersist()
    return out


def _starts(features: DataFrame, model: Centroids) -> dict[str, np.ndarray]:
    """For each language the counts of a text that is less like the nearest of its centroids than 95 % of its texts are."""
    shared = features.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model, held = shared.value, {}
        for lang, counts in _texts(batches):
            lo, hi = np.searchsorted(model.owner, [model.languages.index(lang), model.languages.index(lang) + 1])
            near = (model.vectors(counts) @ model.centres[lo:hi].T).max(1)
            level = (near * BINS).astype(int).clip(0, BINS - 1)
            for i in np.lexsort((near, level)):
                n, low, row = held.get((lang, level[i]), (0, 2.0, None))
                held[lang, level[i]] = (n + 1, near[i], counts[i]) if near[i] < low else (n + 1, low, row)
        if held:
            columns = [[k for k, _ in held], [int(b) for _, b in held], [n for n, _, _ in held.values()], [float(x) for _, x, _ in held.values()], [pack(row.astype(np.uint32)) for _, _, row in held.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.binary()])], names=["lang", "bin", "n", "near", "counts"])

    found = features.mapInArrow(lean(run), "lang string, bin int, n long, near double, counts binary").groupBy("lang", "bin").agg(F.sum("n").alias("n"), F.min(F.struct("near", "counts")).alias("least"))
    of_lang = Window.partitionBy("lang")
    upto = found.withColumn("upto", F.sum("n").over(of_lang.orderBy("bin"))).withColumn("at", F.floor(F.sum("n").over(of_lang) / 20))
    out = {r.lang: unpack(bytes(r.counts), np.int32) for r in upto.where("upto > at and upto - n <= at").select("lang", "least.counts").collect()}
    shared.unpersist()
    return out


def _cut_offs(features: DataFrame, model: Centroids) -> np.ndarray:
    """Least cosine by centroid and octave."""
    shared = features.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        held, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def merged():
            code, at = np.unique(np.concatenate(held), return_inverse=True)
            return [code], [np.bincount(at, np.concatenate(n), len(code)).astype(np.int64)]

        for _, counts in _texts(batches):
            best, cosine = shared.value.closest(counts)
            held.append((best * OCTAVES + _octave(counts)) * (LEVELS + 1) + np.floor(cosine.clip(0, 1) * LEVELS).astype(np.int64))
            n.append(np.ones(len(best), np.int64))
            if len(held) > 1000:
                held, n = merged()
        (code,), (n,) = merged()
        yield pa.RecordBatch.from_arrays([pa.array(code // (LEVELS + 1) // OCTAVES, pa.int32()), pa.array(code // (LEVELS + 1) % OCTAVES, pa.int32()), pa.array(code % (LEVELS + 1), pa.int32()), pa.array(n)], names=["centre", "octave", "level", "n"])

    seen = settled(features.mapInArrow(lean(run), "centre int, octave int, level int, n long").groupBy("centre", "octave", "level").agg(F.sum("n").alias("n")))
    least = [F.sum("n").alias("n"), (MARGIN / LEVELS * F.percentile("level", F.lit(0.01), F.col("n"))).alias("least")]
    own = {(r.centre, r.octave): r.least for r in seen.groupBy("centre", "octave").agg(*least).where(F.col("n") >= ENOUGH).collect()}
    everyone = {r.octave: r.least for r in seen.groupBy("octave").agg(*least).where(F.col("n") >= ENOUGH).collect()}
    done(seen)
    shared.unpersist()
    out = np.zeros((len(model.owner), OCTAVES))
    for o in range(OCTAVES):
        for c in range(len(out)):
            out[c, o] = own.get((c, o), everyone.get(o, out[c, o - 1] if o else 0.0))
    return out


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", clusters: int = CLUSTERS, sample_rows: int | None = None) -> Centroids | None:
    """Centroids from all rows with text and language, or from a sample of them.

    A language's first centroid is its mean; each further one starts at a text that is little like those before it.
    """
    ship(labelled.sparkSession)
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(id_col).cast("string").alias("k")).where("text is not null and lang is not null")
    if sample_rows is not None:
        rows = rows.where("k is not null")
        sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().limit(sample_rows + 1).collect()}
        if len(sizes) > sample_rows:
            raise ValueError(f"more than {sample_rows} languages: a sample of as many rows can't teach them")
        if not sizes:
            return None
        # A hash of the id decides, at each language's own rate: a cut-off, not a sort of all rows.
        rate = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, sample_rows // len(sizes) / n)))])
        rows = rows.where(F.pmod(F.xxhash64("k", F.lit(8)), F.lit(1_000_003)) < F.element_at(rate, F.col("lang")) * 1_000_003)
    features = _features(rows.select("text", "lang"))
    sizes = {r.lang: r.n for r in features.groupBy("lang").agg(F.sum("n").alias("n")).limit(MOST + 1).collect()}
    if len(sizes) > MOST:
        raise ValueError(f"more than {MOST} languages")
    if not sizes:
        done(features)
        return None
    languages = sorted(sizes)
    place = {lang: i for i, lang in enumerate(languages)}
    n = sum(sizes.values())
    seen = _sums(features, lambda lang, counts: [(place[lang], (counts > 0).sum(0))])
    share = sum(seen[i] / sizes[lang] for i, lang in enumerate(languages)) / len(languages)
    model = Centroids(languages, np.zeros(0, int), (np.log((1 + n) / (1 + n * share)) + 1).astype(np.float32), np.zeros((0, FEATURES), np.float32))

    def moved(centres: list[list[np.ndarray]]) -> dict[int, np.ndarray]:
        model.owner, model.centres = np.repeat(np.arange(len(centres)), [len(c) for c in centres]), np.concatenate([np.stack(c) for c in centres])
        return _means(features, model)

    most = max(1, min(clusters, MOST // len(languages)))
    mean = moved([[np.zeros(FEATURES, np.float32)]] * len(languages))
    centres = [[_unit(mean[i])] for i in range(len(languages))]
    for k in range(1, most):
        model.owner, model.centres = np.repeat(np.arange(len(centres)), [len(c) for c in centres]), np.concatenate([np.stack(c) for c in centres])
        for lang, counts in _starts(features, model).items():
            if sizes[lang] > k:
                centres[place[lang]].append(model.vectors(counts[None])[0])
    before: dict[int, np.ndarray] = {}
    for _ in range(ROUNDS):
        sums = moved(centres)
        if sums.keys() == before.keys() and all(np.array_equal(sums[i], before[i]) for i in sums):
            break
        before, at = sums, 0
        for own in centres:
            own[:] = [_unit(sums[at + i]) if at + i in sums else c for i, c in enumerate(own)]
            at += len(own)
    model.centres = np.concatenate([np.stack(c) for c in centres])
    model.least = _cut_offs(features, model)
    done(features)
    return model


def predict(docs: DataFrame, model: Centroids | None, *, text_col: str = "text", min_cosine: float = MIN_COSINE) -> DataFrame:
    """``docs`` with columns lang_pred, score (the cosine, 0 to 1) and rejected, which replace any of these names."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("lang_pred", "score", "rejected")
    schema = docs.select("*", F.lit("").cast("string").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("rejected")).schema
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for whole in batches:
            for batch in slices(whole, text_col, SLICE, ROWS):
                column = batch.column(batch.schema.names.index(text_col))
                ok = lettered(column)
                if model is None:
                    ok[:] = False
                    lang, cosine, least = [UNKNOWN] * len(ok), np.zeros(len(ok)), 0.0
                else:
                    best, cosine, least = model.nearest(gram_counts(column))
                    cosine = np.where(ok, np.clip(cosine, 0, 1), 0.0)
                    lang = [model.languages[i] if k else UNKNOWN for i, k in zip(best, ok)]
                added = [pa.array(lang, pa.string()), pa.array(cosine, pa.float64()), pa.array(~ok | (cosine < np.maximum(least, min_cosine)))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "lang_pred", "score", "rejected"])

    return docs.mapInArrow(lean(run), schema)

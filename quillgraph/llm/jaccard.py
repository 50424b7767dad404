"""N-gram Jaccard join by parity sketches.

A text is the set of its distinct k-word shingles. In each size band the hashed shingles are dealt to blocks, and a
block of the sketch is the exclusive-or of the hashes in it. A shingle that only one of two sets has changes one block,
so the number of differing blocks is at most the symmetric difference, which for a Jaccard similarity of ``threshold``
is at most a known share of the sizes. By the pigeonhole principle two similar sets of a band then have equal blocks:
every set that has more filled blocks than that bound shares one with each similar set. Equal blocks give candidates;
candidates are verified on the shingles.

Groups of copies come first: each set is compared with one leader for each of ``MINS`` least hashes of its shingles, and
what is verified gives components. From then on only pairs across components matter. Blocks that more than ``light``
different sets of several components share ("heavy") pair nothing. A set is still found by all its partners while its
light blocks outnumber the bound. Sets that this leaves open, as passages that many texts share do, meet again by the
finest blocks, single shingles, where the bound is lower. What is open even then is joined by the rarest shingles of
each set, of which a quarter and one suffice: first each set with one leader, then pair by pair across the components
that remain, where the parities of ``PARITY_BITS`` blocks don't set them apart. So groups of near copies are not expanded into all
their pairs, and no link between different texts is lost as far as components go.

Texts with equal sets are one class from the start. Texts without words are linked with nothing. Rows with a null id
get the class's component; equal ids with different texts count as one document. An empty table gives an empty one;
of extra columns, whatever their names, none is read. A text takes memory for its own shingles. Sets go by 39 bits of
their hash and blocks by 56 while candidates are sought: sets that collide get each other's candidates, which
verification sorts out; two that are similar to each other and collide would not meet (one pair in 2^39).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship
from .arrowtext import SPACED_LOWER, Words, buffers, mix, shingle_sets, slices
from .blobs import pack, ranges, unpack
from .components import Groups
from .memory import lean, lean_group, trim
from .tables import done, parts, settled, small

K, LIGHT, FLUSH = 5, 8, 1_500_000
#: Bytes of text whose sketches are made at once: a good part of what a task holds; of keys that go to the JVM at once.
SLICE, SENT = 500_000, 1 << 20
BROADCAST_ROWS = 200_000
#: Least hashes that leaders are sought by; bits of the parities that tell sets of one rare shingle apart.
MINS, PARITY_BITS = 4, 1024
_U = np.uint64
#: Bits of a set's hash that stand for it in blobs, and the mark of a key that is heavy already.
ID_BITS = 40
HEAVY = _U((1 << ID_BITS) - 1)
#: Sets below this size have single shingles as blocks; above, bands double.
TINY = 32


def band_of(n: int) -> int:
    return 0 if n < TINY else (n // TINY).bit_length()


def bands(n: int) -> list[tuple[int, int]]:
    """The bands of a set of n shingles, and the largest symmetric difference with a similar set in each.

    The first is its own, where partners may be smaller or up to 4/3 as large; the other is the band below, if similar
    sets can be that small. For 3/4: |A ^ B| <= (|A| + |B|) / 7.
    """
    own = band_of(n)
    out = [(own, (n + n * 4 // 3) // 7)]
    below = TINY << (own - 1) if own else 0
    if own and 4 * (below - 1) >= 3 * n:
        out.append((own - 1, (n + below - 1) // 7))
    return out


def blocks_in(band: int) -> int:
    """Blocks of a band's sketch; 0: a block per shingle."""
    return (TINY << band) // 2 if band else 0


def sketch_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all filled blocks of all sets in all their bands: key, set, and 0 or 1 for the first or second band."""
    entry = [(i, f, band, blocks_in(band)) for i, s in enumerate(sets) if len(s) for f, (band, _) in enumerate(bands(len(s)))]
    if not entry:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.array([len(sets[i]) for i, *_ in entry])
    h = np.concatenate([sets[i] for i, *_ in entry])
    which = np.repeat(np.arange(len(entry)), size)
    n_blocks = np.repeat(np.array([m for *_, m in entry]), size).astype(_U)
    band = np.repeat(np.array([b for _, _, b, _ in entry]), size).astype(_U)
    at = mix(h + _U(0x6A09E667F3BCC909))
    block = np.where(n_blocks > 0, at % np.maximum(n_blocks, _U(1)), at)
    whole = which.astype(_U) << _U(32) | (block & _U(0xFFFFFFFF))
    single = n_blocks == 0
    out_key, out_entry = [mix(h[single] ^ _U(0xA54FF53A5F1D36F1))], [which[single]]
    order = np.argsort(whole[~single], kind="stable")
    if len(order):
        w, x = whole[~single][order], mix(h[~single] + _U(0x3C6EF372FE94F82B))[order]
        start = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        parity = np.bitwise_xor.reduceat(x, start)
        out_key.append(mix(parity + mix(block[~single][order][start] + (band[~single][order][start] << _U(40)))))
        out_entry.append(which[~single][order][start])
    owner = np.concatenate(out_entry)
    e = np.array([(i, f) for i, f, *_ in entry])
    return np.concatenate(out_key), e[owner, 0], e[owner, 1]


def finest_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As sketch_keys, with a block for every shingle and no bands: then only shingles of one's own change one's blocks."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    return mix(np.concatenate([*sets, np.zeros(0, _U)]) ^ _U(0x510E527FADE682D1)), owner, np.zeros(len(owner), np.int64)


def set_hash(s: np.ndarray) -> int:
    """A signed 64-bit hash of a sorted set; 0 for the empty one."""
    if not len(s):
        return 0
    x = mix(s + _U(0xBB67AE8584CAA73B))
    return int(mix(np.array([x.sum() + mix(np.bitwise_xor.reduce(x)[None])[0] + _U(len(s))], _U)).view(np.int64)[0]) or 1


def _sets(batch: pa.RecordBatch, k: int) -> list[np.ndarray]:
    return shingle_sets(Words(*buffers(batch.column(batch.schema.names.index("text"))), SPACED_LOWER), k)


def least_hashes(sets: list[np.ndarray]) -> list[np.ndarray]:
    """MINS times, the least hash of each set's shingles (0 for empty sets)."""
    filled = [s for s in sets if len(s)]
    out = [np.zeros(len(sets), _U) for _ in range(MINS)]
    if filled:
        start = np.concatenate([[0], np.cumsum([len(s) for s in filled])[:-1]])
        whole, where = np.concatenate(filled), [i for i, s in enumerate(sets) if len(s)]
        for i, least in enumerate(out):
            least[where] = np.minimum.reduceat(mix(whole + _U(0x9B05688C2B3E6C1F * (i + 1) % (1 << 64))), start)
    return out


_SIGNATURE = ["n", "g", "filled0", "filled1", "bound0", "bound1", *(f"least{i}" for i in range(MINS))]


def signatures(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, size of the set, its hash, for its first and second band how many filled blocks it has and its bound, and its least hashes."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                sets = _sets(batch, k)
                _, owner, flag = sketch_keys(sets)
                filled = [np.bincount(owner[flag == f], minlength=len(sets)) for f in (0, 1)]
                bound = [[d for _, d in bands(len(s))] + [0] for s in sets]
                columns = [[len(s) for s in sets], [set_hash(s) for s in sets], *filled, *([d[f] for d in bound] for f in (0, 1)), *(x.view(np.int64) for x in least_hashes(sets))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in columns)], names=["doc_id", *_SIGNATURE])

    return docs.mapInArrow(lean(run), "doc_id long, " + ", ".join(f"{c} long" for c in _SIGNATURE))


def _short(g: np.ndarray) -> np.ndarray:
    """Set hashes cut to ID_BITS - 1 bits (never the heavy mark's)."""
    return np.minimum(g.view(_U) >> _U(64 - (ID_BITS - 1)), _U((1 << (ID_BITS - 1)) - 2))


def _group(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, who) in order, the first place of each one's run of equal keys, and the length of that run.

    Empties the list of the two columns, so that they are let go once they are sorted.
    """
    key, who = columns
    columns.clear()
    order = np.argsort(key).astype(np.int32)
    key, who = key[order], who[order]
    del order
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    tied = ~new
    tied[:-1] |= tied[1:]
    tied = np.flatnonzero(tied)  # the others are in order already
    who[tied] = who[tied][np.lexsort((who[tied], key[tied]))]
    del tied
    new[1:] |= who[1:] != who[:-1]
    key, who = key[new], who[new]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).astype(np.int32) if len(key) else np.zeros(0, np.int32)
    length = np.diff(np.concatenate([start, np.array([len(key)], np.int32)]))
    return key, who, np.repeat(start, length), np.repeat(length, length)


def _mixed(start: np.ndarray, component: np.ndarray) -> np.ndarray:
    """Which entries stand in a run of several components. ``start``: the first place of each one's run."""
    differs = component != component[start]
    mixed = np.zeros(len(start), bool)
    mixed[start[differs]] = True
    return mixed[start]


def _deal(batches, k: int, light: int, n_parts: int, sketch):
    """Requests: keys and short ids by key range, with the components of ids that have one. A key that is heavy within
    a flush travels once, marked."""
    keys, owners, ids, components_ = [], [], [], []  # ids and components: for each set two, by band

    def blob(part: int, key: bytes, who: bytes, labelled: bytes = b"", component: bytes = b""):
        return part, key, who, labelled, component

    def rows(blobs):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*blobs), [pa.int32(), *[pa.binary()] * 4])], names=_BLOB)

    def flush():
        of, first, at = np.unique(np.concatenate(ids), return_index=True, return_inverse=True)
        of_component = np.concatenate(components_)[first]
        columns = [np.concatenate(keys)]
        keys.clear()
        columns.append(at.astype(np.int32)[np.concatenate(owners)])
        for held in (owners, ids, components_):
            held.clear()
        key, at, start, length = _group(columns)
        many = np.flatnonzero(length > light)
        label = of_component[at[many]]
        many = many[_mixed(np.searchsorted(many, start[many]), np.where(label != 0, label, ~of[at[many]]))]
        counted_id, counted_n = np.unique(of[at[many]], return_counts=True)
        heavy, keep = np.zeros(len(key), bool), np.ones(len(key), bool)
        heavy[many], keep[many] = True, many == start[many]
        del start, length
        key, at, heavy = key[keep], at[keep], heavy[keep]
        cut = ranges(key, n_parts)
        blobs, size = [], 0
        for part, (a, b) in enumerate(zip(cut, cut[1:])):
            here = np.unique(at[a:b][~heavy[a:b]])
            here = here[of_component[here] != 0]
            blobs.append(blob(part, pack(key[a:b], True), pack(np.where(heavy[a:b], HEAVY, of[at[a:b]])), pack(of[here], True), pack(of_component[here])))
            size += sum(map(len, blobs[-1][1:]))
            if size >= SENT:
                yield rows(blobs)
                blobs, size = [], 0
        del key, at, heavy, keep, here
        if blobs:
            yield rows(blobs)
            del blobs
        for at in range(0, len(counted_id), 100_000):
            some = slice(at, at + 100_000)
            yield rows([blob(at // 100_000 % n_parts, pack(counted_id[some], True), b"\0" + pack(counted_n[some].astype(_U)))])
        trim()

    for whole in batches:
        for batch in slices(whole, "text", SLICE):
            sets = _sets(batch, k)
            key, owner, flag = sketch(sets)
            g = _short(np.array([set_hash(s) for s in sets], np.int64))
            component = batch.column(2).fill_null(0).to_numpy().astype(np.int64).view(_U)
            keys.append(key >> _U(8) << _U(8))
            owners.append((sum(map(len, ids)) + 2 * owner + flag).astype(np.int32))
            ids.append((g[:, None] << _U(1) | np.arange(2, dtype=_U)).ravel())
            components_.append(np.repeat(component, 2))
            del sets, key, owner, flag
            if sum(map(len, keys)) >= FLUSH:
                yield from flush()
    if sum(map(len, keys)):
        yield from flush()


_BLOB = ["part", "keys", "ids", "labelled", "components"]


def _meet(table: pa.Table, light: int) -> pa.Table:
    """Pairs of short ids across components with their number of equal light keys, and for each short id its number of heavy keys here."""
    keys, ids, other_id, other_n, labelled, labels = [], [], [], [], [], []
    for a, b, c, d in zip(*(table.column(n).to_pylist() for n in _BLOB[1:])):
        if b[:1] == b"\0":
            other_id.append(unpack(a, _U, True))
            other_n.append(unpack(b[1:], np.int64))
        else:
            keys.append(unpack(a, _U, True))
            ids.append(unpack(b, _U))
            labelled.append(unpack(c, _U, True))
            labels.append(unpack(d, _U))
    none = [np.zeros(0, _U)]
    columns = [np.concatenate(keys or none), np.concatenate(ids or none)]
    del keys, ids
    key, who, start, length = _group(columns)
    shared = length > 1  # what stands alone meets nothing
    key, who, start, length = key[shared], who[shared], (np.cumsum(shared, dtype=np.int32) - 1)[start[shared]], length[shared]
    del shared
    of, first = np.unique(np.concatenate(labelled or none), return_index=True)
    label = np.concatenate([np.concatenate(labels or none)[first], np.zeros(1, _U)])
    at = np.searchsorted(of, who)
    known = np.concatenate([of, [HEAVY]])[at] == who
    component = np.where(known & (who != HEAVY), label[at], ~who)
    mixed = _mixed(start, component) if len(key) else np.zeros(0, bool)
    heavy = mixed & (length > light)
    if len(key):
        heavy |= who[start + length - 1] == HEAVY
    member = heavy & (who != HEAVY)
    all_id = np.concatenate([who[member], *other_id])
    all_n = np.concatenate([np.ones(int(member.sum()), np.int64), *other_n])
    found, where = np.unique(all_id, return_inverse=True)
    n = np.bincount(where, all_n, len(found)).astype(np.int64)
    left, right = [], []
    some = mixed & ~heavy
    key, who, component = key[some], who[some], component[some]
    for step in range(1, light):
        same = key[step:] == key[:-step]
        if not same.any():
            break
        same &= component[step:] != component[:-step]
        left.append(who[:-step][same])
        right.append(who[step:][same])
    a, b = np.concatenate(left or none), np.concatenate(right or none)
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    shared = np.diff(np.concatenate([start, [len(a)]]))
    a, b = a[start].astype(np.int64), b[start].astype(np.int64)
    rows = len(a) + len(found)
    return pa.table({"pair": pa.array(np.arange(rows) < len(a)), "a": pa.array(np.concatenate([a, found.astype(np.int64)])), "b": pa.array(np.concatenate([b, np.zeros(len(found), np.int64)])), "many": pa.array(np.concatenate([shared, n]))})


def _round(docs: DataFrame, member: DataFrame, sketch, k: int, threshold: int, light: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b) by equal blocks, and the ids of sets that may have partners which no light block shows.

    ``docs``: doc_id, text, component. ``member``: a set in a band with its filled blocks and the most of them that may
    differ from a similar set's.
    """
    n_parts = parts(docs.sparkSession)
    met = settled(
        docs.mapInArrow(lean(lambda batches: _deal(batches, k, light, n_parts, sketch)), "part int, " + ", ".join(f"{n} binary" for n in _BLOB[1:]))
        .groupBy("part").applyInArrow(lean_group(lambda t: _meet(t, light)), "pair boolean, a long, b long, many long")
    )
    heavy = met.where("not pair").groupBy(F.col("a").alias("who")).agg(F.sum("many").alias("heavy"))
    member = member.withColumn("who", F.shiftleft("short", 1) + F.col("flag"))
    member = settled(member.join(heavy, "who", "left").select("who", "id", "n", "bound", (F.col("filled") - F.coalesce("heavy", F.lit(0))).alias("light")))
    # Similar sets share all their light blocks but those that may differ.
    a = member.select(F.col("who").alias("a"), F.col("id").alias("ida"), F.col("n").alias("na"), F.col("light").alias("la"), F.col("bound").alias("ba"))
    b = member.select(F.col("who").alias("b"), F.col("id").alias("idb"), F.col("n").alias("nb"), F.col("light").alias("lb"), F.col("bound").alias("bb"))
    most = "least({0}, floor((na + nb) / 7))"
    pairs = (
        met.where("pair").groupBy("a", "b").agg(F.sum("many").alias("many")).join(a, "a").join(b, "b")
        .where(f"ida <> idb and 100 * least(na, nb) >= {threshold} * greatest(na, nb) and many >= la - {most.format('ba')} and many >= lb - {most.format('bb')}")
        .select(F.least("ida", "idb").alias("a"), F.greatest("ida", "idb").alias("b")).distinct()
    )
    pairs, open_sets = settled(pairs), settled(member.where("light <= bound").select("id").distinct())
    done(met, member)
    return pairs, open_sets


def _verified(pairs: DataFrame, shingles: DataFrame, threshold: int) -> DataFrame:
    """Of pairs (a, b, ca, cb) whose sets intersect in ``threshold`` per cent of their union or more, ca and cb."""

    def run(batches):
        for batch in batches:
            hit = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
                x, y = unpack(x, _U, True), unpack(y, _U, True)
                both = len(np.intersect1d(x, y, assume_unique=True))
                hit.append(100 * both >= threshold * (len(x) + len(y) - both))
            yield batch.select(["ca", "cb"]).filter(pa.array(hit, pa.bool_()))

    b = shingles.select(F.col("id").alias("b"), F.col("sh").alias("sb"))
    a = shingles.select(F.col("id").alias("a"), F.col("sh").alias("sa"))
    return pairs.join(b, "b").join(a, "a").select("ca", "cb", "sa", "sb").mapInArrow(lean(run), "ca long, cb long")


def _with_shingles(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """id and packed set of the documents named."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack(s, True) for s in _sets(batch, k)], pa.binary())], names=["id", "sh"])

    chosen = docs.join(small(ids.select(F.col("id").alias("doc_id")), BROADCAST_ROWS), "doc_id", "left_semi")
    return settled(chosen.mapInArrow(lean(run), "id long, sh binary").dropDuplicates())


class _Sets(Groups):
    """Components of sets of shingles, growing with each set of candidate pairs that is verified."""

    def __init__(self, docs: DataFrame, k: int, threshold: int):
        super().__init__()
        self.docs, self.k, self.threshold = docs, k, threshold

    def add(self, pairs: DataFrame) -> None:
        """Verifies those of the pairs (a, b) whose ends are not connected yet."""
        pairs = self.across(pairs)
        if self.label is None or not pairs.isEmpty():
            wanted = settled(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
            shingles = _with_shingles(self.docs, wanted, self.k)
            self.link(_verified(pairs, shingles, self.threshold))
            done(wanted, shingles)
        done(pairs)


def _first(pairs: DataFrame) -> DataFrame:
    """Of pairs (b, with leader a) one for each b: the leader that it has most often, the smaller of equal ones."""
    return pairs.groupBy("a", "b").count().groupBy("b").agg(F.max_by("a", F.struct("count", -F.col("a"))).alias("a")).select("a", "b")


def _led(entries: DataFrame, threshold: int) -> DataFrame:
    """Of sets (key, id, n), each with the smallest id that shares its key, if their sizes allow a link."""
    leaders = entries.groupBy("key").agg(F.min(F.struct("id", "n")).alias("lead"), F.count("*").alias("many")).where("many > 1").select("key", F.col("lead.id").alias("a"), F.col("lead.n").alias("na"))
    return entries.join(leaders, "key").where(f"id <> a and 100 * least(n, na) >= {threshold} * greatest(n, na)").select("a", F.col("id").alias("b"))


def linked(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, threshold: int = 75, light: int = LIGHT) -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the smallest id that links reach."""
    if threshold < 75:
        raise ValueError("the bounds on symmetric differences here hold from 75 per cent on")
    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signature = settled(signatures(docs, k))
    short = F.least(F.shiftrightunsigned("g", 64 - (ID_BITS - 1)), F.lit((1 << (ID_BITS - 1)) - 2))
    classes = settled(
        signature.where("n > 0 and doc_id is not null").groupBy("g").agg(F.min("doc_id").alias("id"), *(F.first(c).alias(c) for c in _SIGNATURE if c != "g"))
        .withColumn("short", short)
    )
    known = _Sets(docs, k, threshold)
    led = settled(_led(classes.select("id", "n", F.explode(F.array(*(F.xxhash64(F.lit(i), f"least{i}") for i in range(MINS)))).alias("key")), threshold))
    known.add(_first(led))
    known.add(led.distinct())
    done(led)

    # From here on, one document of each class, with its component.
    copies = signature.where("n > 0").join(classes.select("g", "id"), "g").groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("id")).alias("one")).where("not one").select("doc_id")
    marks = settled(known.label.toDF("doc_id", "component").withColumn("one", F.lit(True)).unionByName(copies.select("doc_id", F.lit(None).cast("long").alias("component"), F.lit(False).alias("one"))).groupBy("doc_id").agg(F.max("component").alias("component"), F.min("one").alias("one")))
    single = docs.where("doc_id is not null").join(small(marks, BROADCAST_ROWS), "doc_id", "left").where("one is null or one").select("doc_id", "text", F.when(F.col("component").isNotNull(), F.xxhash64("component")).alias("component"))
    member = classes.select("short", "id", "n", F.inline(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f"filled{f}").alias("filled"), F.col(f"bound{f}").alias("bound")) for f in (0, 1)]))).where("filled > 0")
    first, open_sets = _round(single, member, sketch_keys, k, threshold, light)
    # What passages that many texts share leave open, by the finest blocks.
    fine = classes.join(small(open_sets, BROADCAST_ROWS), "id", "left_semi").select("short", "id", "n", F.lit(0).alias("flag"), F.col("n").alias("filled"), F.expr("n - ceil(n * %d / 100)" % threshold).alias("bound"))
    some = single.join(small(open_sets.withColumnRenamed("id", "doc_id"), BROADCAST_ROWS), "doc_id", "left_semi")
    second, still_open = _round(some, fine, finest_keys, k, threshold, light)
    candidates = settled(first.union(second).distinct())
    known.add(candidates)
    done(first, second, candidates, open_sets)

    # The rarest shingles of each open set, so many that similar sets share one: what is common in all of them is left out.
    shingles = _with_shingles(docs, still_open, k)
    every = settled(shingles.mapInArrow(lambda batches: _shingle_rows(batches, threshold), "key long, id long, n long, enough long"))
    seen_in = every.groupBy("key").agg(F.count("*").alias("seen_in"))
    rarest = Window.partitionBy("id").orderBy("seen_in", "key")
    entries = settled(every.join(seen_in, "key").withColumn("place", F.row_number().over(rarest)).where("place <= enough and seen_in > 1").select("key", "id", "n"))
    known.add(_first(_led(entries, threshold)))
    marked = known.of(entries, "id", "c")
    mixed = settled(marked.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key"))
    mixed_sets = marked.join(small(mixed, BROADCAST_ROWS), "key")
    sketches = settled(shingles.mapInArrow(_parities, "id long, " + ", ".join(f"{p} long" for p in _PARITIES)))
    sets = settled(mixed_sets.join(small(sketches, BROADCAST_ROWS), "id"))
    x, y = (sets.select("key", *(F.col(c).alias(f"{side}_{c}") for c in ("id", "n", "c", *_PARITIES))) for side in ("x", "y"))
    apart = sum((F.bit_count(F.col(f"x_{p}").bitwiseXOR(F.col(f"y_{p}"))) for p in _PARITIES), F.lit(0))
    near = F.expr(f"x_c < y_c and 100 * least(x_n, y_n) >= {threshold} * greatest(x_n, y_n)") & (7 * apart <= F.col("x_n") + F.col("y_n"))
    known.add(x.join(y, (x.key == y.key) & near).select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct())
    done(shingles, every, entries, still_open, mixed, sketches, sets, marks)

    named = known.of(classes.select("g", "id"), "id", "component_id").select("g", "component_id")
    named = signature.where("n > 0").join(named, "g", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return named.unionByName(signature.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


_PARITIES = [f"p{i}" for i in range(PARITY_BITS // 64)]


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """Per set PARITY_BITS bits in words of 64: how many shingles each of as many blocks has, odd or even."""
    out = np.zeros((len(sets), PARITY_BITS // 64), _U)
    for i, s in enumerate(sets):
        odd = np.bincount((mix(s + _U(0x1F83D9ABFB41BD6B)) % _U(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS).astype(np.uint8) & 1
        out[i] = np.packbits(odd).view(_U)
    return out


def _parities(batches):
    for batch in batches:
        found = parities([unpack(packed, _U, True) for packed in batch.column("sh").to_pylist()]).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(np.ascontiguousarray(c)) for c in found.T)], names=["id", *_PARITIES])


def _shingle_rows(batches, threshold: int):
    """A row per shingle of each set, with the set's size and how many of its shingles any similar set must meet."""
    for batch in batches:
        sets = [unpack(packed, _U, True) for packed in batch.column("sh").to_pylist()]
        size = np.array([len(s) for s in sets], np.int64)
        if len(size):
            columns = [np.concatenate(sets).view(np.int64), np.repeat(batch.column("id").to_numpy(), size), np.repeat(size, size), np.repeat(size - -(-threshold * size // 100) + 1, size)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "id", "n", "enough"])

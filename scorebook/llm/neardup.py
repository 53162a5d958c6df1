"""Near-duplicates by the Jaccard similarity of word shingles: every pair at ``ALIKE`` or more, none missed.

Shingles get one global order, rare ones before common ones. Two sets of x and y shingles that must share t share
one among the first x - t + 1 and y - t + 1 (prefix filter), so texts that share none there are never compared;
the common shingles, which come last, are hardly ever what a pair meets by.
Pairs met are thinned by their lengths and by sketches: counts
of a set's shingles by low bits of their hashes, of which the sum of the smaller ones bounds the intersection.
None of this loses a pair. The rest are compared by their whole sets.

Groups are components of these pairs. A shingle in the prefixes of more than ``MANY`` texts is worked in rounds:
all its texts against one of them; of the pairs still left, those in different components, first one for each
two components, then what these did not join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorebook.llm import simhash
from scorebook.llm.common import narrow, slices, staged, unstaged
from scorebook.llm.simhash import components, grouped, one_of_each
from scorebook.llm.spans import Words

SHINGLE = 5
#: Least similarity, as a fraction.
ALIKE = (4, 5)
#: Texts with one shingle in their prefixes that are all paired at once.
MANY = 16
#: Shingles of so many texts come later in the order, the million most frequent of them at most; the order only sets the speed.
COMMON = 16
COMMON_LIMIT = 1_000_000
#: Bits of the map that keeps sets that no pair needs from being sent.
MAP_BITS = 24
#: Bytes of text cut into shingles at once; the hashes of a slice take about fifty times as much.
SLICE = 1 << 19
U = np.uint64
_HASH = U(58)
_T, _B = ALIKE
#: Of the sizes x and y and the size o of the intersection: o / (x + y - o) >= ALIKE.
_ENOUGH = f"{_T + _B} * ({{o}}) >= {_T} * ({{x}} + {{y}})"
_LENGTHS = f"{_B} * least({{x}}, {{y}}) >= {_T} * greatest({{x}}, {{y}})"
#: Places px and py of a shingle within the prefixes of a pair of x and y shingles.
_MEET = f"greatest(px - x, py - y) <= -(({_T} * (x + y) + {_T + _B - 1}) div {_T + _B})"



def shingles(texts: pa.Array, common: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text in the global order, all texts in a row, and the bounds of each.

    A shingle is its level (zero unless it is in ``common``) above 58 bits of its hash.
    """
    w = Words(pc.ascii_lower(pc.fill_null(texts, "")))
    size = np.diff(w.first)
    text = np.repeat(np.arange(len(size)), size)
    a = np.flatnonzero(text[: max(0, w.n - SHINGLE + 1)] == text[SHINGLE - 1 :])
    short = np.flatnonzero((size > 0) & (size < SHINGLE))
    a, b = np.concatenate([a, w.first[short]]), np.concatenate([a + SHINGLE, w.first[short + 1]])
    row, value = text[a], w.a.run(a, b) >> (U(64) - _HASH)
    if common and len(common[0]):
        at = np.minimum(np.searchsorted(common[0], value), len(common[0]) - 1)
        value |= np.where(common[0][at] == value, common[1][at], U(0)) << _HASH
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return value[new].view(np.int64), np.searchsorted(row[new], np.arange(len(size) + 1))


def _prints(value: np.ndarray, off: np.ndarray) -> np.ndarray:
    """64-bit hash of each set; zero for the empty one."""
    data, at = value.tobytes(), (off * 8).tolist()
    return np.fromiter((xxhash.xxh64_intdigest(data[a:b]) if b > a else 0 for a, b in zip(at, at[1:])), np.uint64, len(at) - 1).view(np.int64)


def _some(value: np.ndarray, off: np.ndarray, take: np.ndarray, n: np.ndarray) -> pa.Array:
    """Lists of the first n values of the texts in ``take``, empty lists for the others."""
    n = np.where(take, n, 0)
    ends = np.cumsum(n)
    at = np.repeat(off[:-1] - ends + n, n) + np.arange(n.sum())
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(value[at]))


def _sketch(value: np.ndarray) -> bytes:
    """How many shingles have each low part of the hash; about two on average. 255 stands for that many and more."""
    size = 1 << max(0, len(value) - 1).bit_length() >> 1 or 1
    return np.minimum(np.bincount(value & (size - 1), minlength=size), 255).astype(np.uint8).tobytes()


def most_common(a: bytes, b: bytes) -> int:
    """No two sets with these sketches share more shingles."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    if x.max() == 255 or y.max() == 255:
        return 1 << 62
    y = y.reshape(-1, len(x)).sum(axis=0, dtype=np.int64)
    return int(np.minimum(x, y).sum())


def _first(fp: np.ndarray) -> np.ndarray:
    """Whether each is the first of its value."""
    first = np.zeros(len(fp), bool)
    first[np.unique(fp, return_index=True)[1]] = True
    return first


def _counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        for part in slices(b, limit=SLICE):
            value, off = shingles(part.column("text"))
            key, n = np.unique(value[np.repeat(_first(_prints(value, off)), np.diff(off))], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key[n > 1]), pa.array(n[n > 1].astype(np.int64))], ["key", "n"])


def _shared(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and fp, one of each key and fp, if the key has another fp."""
    names, held, met = ["key", "fp", "n", "pos"], None, False
    out = lambda cols: pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)
    for b in it:
        if not b.num_rows:
            continue
        cols = [b.column(c).to_numpy() for c in names]
        if held:
            cols = [np.append(h, c) for h, c in zip(held, cols)]
        key, fp = cols[:2]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])
        cols = [c[new] for c in cols]
        twin, same = np.zeros(new.sum(), bool), cols[0][1:] == cols[0][:-1]
        twin[1:], twin[:-1] = same, twin[:-1] | same
        twin[1:] |= same
        twin[0] |= met
        held, met = [c[-1:] for c in cols], bool(twin[-1])
        twin[-1] = False
        yield out([c[twin] for c in cols])
    if met:
        yield out(held)


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that slices of texts hold more than once, sorted, and their levels by frequency."""
    rows = (docs.select("text").mapInArrow(_counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(f"n >= {COMMON}")
            .orderBy(F.desc("n"), "key").limit(COMMON_LIMIT).toPandas().sort_values("key"))
    return rows["key"].to_numpy(np.int64).astype(np.uint64), np.minimum(31, np.log2(np.maximum(1, rows["n"].to_numpy(np.int64)))).astype(np.uint64)


def prints(docs: DataFrame, sent) -> DataFrame:
    """doc_id, fp (hash of the set of shingles), n, and, the first time a set occurs in a slice, prefix and sketch of every text."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for part in slices(b, limit=SLICE):
                value, off = shingles(part.column("text"), sent.value)
                fp, n = _prints(value, off), np.diff(off)
                first = _first(fp) & (n > 0)
                prefix = _some(value, off, first, n + 1 - (_T * n + _B - 1) // _B)
                sketch = pa.array([_sketch(value[a:b]) if f else None for f, a, b in zip(first.tolist(), off[:-1].tolist(), off[1:].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp), pa.array(n.astype(np.int64)), prefix, sketch], ["doc_id", "fp", "n", "prefix", "sketch"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long, n long, prefix array<long>, sketch binary")


def likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs u, v whose sketches leave room for ``ALIKE``, other columns kept; staged."""
    names = pairs.columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x, y = b.column("x").to_numpy(), b.column("y").to_numpy()
            most = np.fromiter((most_common(a.as_py(), c.as_py()) for a, c in zip(b.column("a"), b.column("b"))), np.int64, b.num_rows)
            enough = np.minimum(most, np.minimum(x, y)) * (_T + _B) >= _T * (x + y)
            yield b.select(names).filter(pa.array(enough))

    both = (pairs.join(sketches.select(F.col("fp").alias("u"), F.col("n").alias("x"), F.col("sketch").alias("a")), "u")
            .join(sketches.select(F.col("fp").alias("v"), F.col("n").alias("y"), F.col("sketch").alias("b")), "v"))
    return staged(both.select(*names, "x", "y", "a", "b").mapInArrow(run, pairs.schema), "near-likely")


def alike(pairs: DataFrame, docs: DataFrame, sent) -> DataFrame:
    """The staged pairs u, v of sets whose similarity is ``ALIKE`` or more, by their whole sets."""
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("fp"))
    bit = F.col("fp").bitwiseAND((1 << MAP_BITS) - 1)
    rows = wanted.select(F.shiftright(bit, 6).cast("int").alias("at"), F.expr("shiftleft(1L, cast(fp & 63L as int))").alias("bits")).groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    bits = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    bits[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    wanted_bits = docs.sparkSession.sparkContext.broadcast(bits)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for part in slices(b, limit=SLICE):
                value, off = shingles(part.column("text"), sent.value)
                fp = _prints(value, off)
                low = fp.view(np.uint64) & U((1 << MAP_BITS) - 1)
                take = _first(fp) & ((wanted_bits.value[(low >> U(6)).astype(np.int64)] >> (low & U(63)) & U(1)) > 0)
                yield pa.RecordBatch.from_arrays([pa.array(fp), _some(value, off, take, np.diff(off))], ["fp", "whole"]).filter(pa.array(take))

    sets = staged(docs.select("text").mapInArrow(run, "fp long, whole array<long>").dropDuplicates(["fp"]), "near-sets")
    both = (pairs.join(sets.select(F.col("fp").alias("u"), F.col("whole").alias("a")), "u")
            .join(sets.select(F.col("fp").alias("v"), F.col("whole").alias("b")), "v"))
    edges = staged(both.where(_ENOUGH.format(o="size(array_intersect(a, b))", x="size(a)", y="size(b)")).select("u", "v"), "near-edges")
    unstaged(sets)
    return edges


def links(found: DataFrame, docs: DataFrame, sent) -> DataFrame:
    """Edges u > v whose components are those of all pairs that are alike; ``found`` as ``prints`` returns it, staged."""
    keys = found.select(F.posexplode("prefix").alias("pos", "key"), "fp", "n").select("key", "fp", "n", "pos")
    keys = staged(keys.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_shared, "key long, fp long, n long, pos int"), "near-keys")
    many = staged(keys.groupBy("key").agg(F.count(F.lit(1)).alias("texts"), F.min_by(F.struct("fp", "n"), "fp").alias("lead"))
                  .where(f"texts > {MANY}").select("key", F.col("lead.fp").alias("lead"), F.col("lead.n").alias("lead_n")), "near-many")
    rows = keys.join(many, "key", "left")
    few, hot = rows.where("lead is null").select("key", "fp", "n", "pos"), staged(rows.where("lead is not null"), "near-hot")
    met = few.toDF("key", "v", "y", "py").join(few.toDF("key", "u", "x", "px"), "key").where(f"u > v and {_LENGTHS.format(x='x', y='y')} and {_MEET}").select("u", "v")
    stars = hot.where("fp <> lead and " + _LENGTHS.format(x="n", y="lead_n")).select(F.col("fp").alias("u"), F.col("lead").alias("v"))
    sketches = staged(found.where("sketch IS NOT NULL").select("fp", "n", "sketch").dropDuplicates(["fp"]), "near-sketches")
    pairs = staged(met.union(stars).distinct(), "near-pairs")
    close = likely(pairs, sketches)
    unstaged(keys, pairs)
    edges = alike(close, docs, sent)
    unstaged(close)
    if many.isEmpty():
        unstaged(many, hot, sketches)
        return edges
    rooted = staged(hot.join(components(edges).withColumnRenamed("node", "fp"), "fp", "left").select("key", "fp", "n", "pos", F.coalesce("root", "fp").alias("root")), "near-rooted")
    unstaged(many, hot)
    main = (rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("texts")).groupBy("key")
            .agg(F.max_by("root", F.struct("texts", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("key", "main"))
    mixed = staged(rooted.join(main, "key"), "near-mixed")
    unstaged(rooted)
    one = mixed.where("root <> main").select("key", F.col("fp").alias("a"), F.col("n").alias("x"), F.col("pos").alias("px"), F.col("root").alias("r"))
    two = mixed.select("key", F.col("fp").alias("b"), F.col("n").alias("y"), F.col("pos").alias("py"), F.col("root").alias("s"), "main")
    left = one.join(two, "key").where(f"r <> s and (s = main or a < b) and {_LENGTHS.format(x='x', y='y')} and {_MEET}")
    pairs = staged(left.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"), F.greatest("r", "s").alias("r"), F.least("r", "s").alias("s")).distinct(), "near-pairs")
    unstaged(mixed)
    close = likely(pairs, sketches)
    unstaged(pairs, sketches)
    more = alike(close.groupBy("r", "s").agg(F.min(F.struct("u", "v")).alias("p")).select("p.u", "p.v"), docs, sent)
    roots = components(edges.union(more))
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    apart = close.join(of("u"), "u", "left").join(of("v"), "v", "left").where("coalesce(u_root, u) <> coalesce(v_root, v)").select("u", "v")
    rest = alike(staged(apart, "near-pairs"), docs, sent)
    unstaged(close)
    return edges.union(more).union(rest)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (hash of the text's set of shingles), root, component_id (smallest doc_id of the group).

    Words and case as in ``simhash``. Texts of fewer than five words are one shingle; null and blank texts have
    none and are near-duplicates of each other only. Repeated rows keep their rows; null ids are passed over
    when the smallest is taken (null only if a group has no other). An empty table gives an empty result.
    """
    return _near_duplicates(narrow(docs, doc_id=id_col, text=text_col))[0]


def _near_duplicates(docs: DataFrame, fingerprints: bool = False):
    sent = docs.sparkSession.sparkContext.broadcast(common_shingles(docs))
    found = staged(prints(docs, sent), "near-prints")
    plain = found.select("doc_id", "fp")
    edges = links(found, docs, sent)
    if fingerprints:
        edges = edges.union(by_fingerprint(docs, sent)).distinct()
    return plain.join(grouped(plain, edges), "fp").select("doc_id", "fp", "root", "component_id"), sent


def by_fingerprint(docs: DataFrame, sent) -> DataFrame:
    """Edges u > v joining the sets of texts whose SimHash fingerprints are in one component, by ``simhash``."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for part in slices(b, limit=SLICE):
                texts = part.column("text")
                sim = np.fromiter((simhash.fingerprint(t.as_py()) for t in texts), np.uint64, len(texts)).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(_prints(*shingles(texts, sent.value))), pa.array(sim)], ["doc_id", "set", "fp"])

    found = staged(docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, set long, fp long"), "near-simhash")
    rooted = staged(found.select("set", "fp").distinct().join(simhash.labels(found.select("doc_id", "fp")).select("fp", "root"), "fp").select("root", "set").distinct(), "near-simhash-sets")
    unstaged(found)
    least = rooted.groupBy("root").agg(F.min("set").alias("v"))
    return rooted.join(least, "root").where("set > v").select(F.col("set").alias("u"), "v")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fingerprints: bool = False) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near-duplicates the one with the smallest id.

    With ``fingerprints``, texts are also linked if their SimHash fingerprints are (see ``simhash``): groups are the
    components of both kinds of links.
    """
    narrowed = narrow(docs, doc_id=id_col, text=text_col)
    groups, sent = _near_duplicates(narrowed, fingerprints)
    return one_of_each(docs, groups, lambda texts: _prints(*shingles(texts, sent.value)), id_col, text_col, SLICE)

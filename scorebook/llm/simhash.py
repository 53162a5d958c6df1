"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints are made in Arrow batches; linking is DataFrame work over distinct fingerprints. Seven masks,
one for each non-zero vector of GF(2)^3, cover every pair of differing bits: two fingerprints within two bits
agree under at least one mask. Inside the buckets no pairs are made: each member goes to the points at most
one free bit away, and two fingerprints meet at a point exactly if they differ in two bits or fewer. A point
has 65 members at most, so no bucket, however large, is gathered anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorebook.llm.common import SLICE_BYTES, map_rows, narrow, quoted, slices, spare, staged

RADIUS = 2
SHINGLE = 3
SEED = 42


def covering_masks() -> list[int]:
    """Bits to compare in each table: bit i belongs to vector i mod 7 + 1; mask v has the bits with odd inner product."""
    return [sum(1 << i for i in range(64) if bin((i % 7 + 1) & v).count("1") % 2) for v in range(1, 2 ** (RADIUS + 1))]


def fingerprint(text: str | None) -> int:
    """64-bit SimHash over XXH64 of the word shingles, repeats included; zero if there is no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= SHINGLE:
        digests, n = digest(joined, SEED), 1
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[:-1]))
        n = len(words) - SHINGLE + 1
        digests = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), (ends[SHINGLE - 1 :] - 1).tolist())])
    rows, ones = np.frombuffer(digests, np.uint8).reshape(n, 8), np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 16):
        ones += np.unpackbits(rows[lo : lo + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        fps = np.fromiter((fingerprint(t.as_py()) for t in b.column("text")), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    df = narrow(docs, doc_id=id_col, text=text_col)
    return df.mapInArrow(_fingerprints, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, fp long")


def links(fps: DataFrame) -> DataFrame:
    """Edges u > v joining all distinct ``fp`` within two bits of each other, without listing the pairs of a group."""
    masks = covering_masks()
    full = (1 << 64) - 1
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    tables = F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.lit(signed(m)).alias("mask"), F.lit(signed(full & ~m)).alias("free"))
                                 for v, m in enumerate(masks)]))
    rows = fps.select("fp", tables.alias("t")).select("fp", "t.v", F.expr("fp & t.mask").alias("key"), "t.free")
    shared = rows.groupBy("v", "key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("v", "key")
    met = rows.join(shared, ["v", "key"], "left_semi").groupBy("fp").agg(F.bit_or("free").alias("free"))
    points = met.select("fp", F.explode(F.expr(
        "concat(array(fp), transform(filter(sequence(0, 63), i -> (shiftrightunsigned(free, i) & 1L) = 1L), i -> fp ^ shiftleft(1L, i)))")).alias("z"))
    groups = points.groupBy("z").agg(F.array_sort(F.collect_list("fp")).alias("near")).where(F.size("near") > 1)
    return groups.select(F.explode(F.slice("near", 2, 64)).alias("u"), F.element_at("near", 1).alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (its component's smallest node) for the nodes of edges u > v: alternating large and small stars.

    Each round is written to the shared folder; rounds grow with the logarithm of the longest chain.
    """
    before = None
    edges = staged(edges, "stars")
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).distinct())
        edges = staged(small, "stars")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links), root.

    A-Z are lower-cased; words are split at ASCII white space. Null and blank texts have fingerprint zero and
    are linked like any other; fewer than three words are one shingle; repeated rows keep their rows and null
    ids are passed over when the smallest is taken (null only if a component has no other). An empty table
    gives an empty result.
    """
    prints = staged(fingerprints(docs, id_col, text_col), "simhash")
    return (prints.join(labels(prints), "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root"))


def labels(prints: DataFrame) -> DataFrame:
    """fp, root, component_id of every distinct fingerprint of staged (doc_id, fp)."""
    return grouped(prints, links(prints.select("fp").distinct()))


def grouped(prints: DataFrame, edges: DataFrame) -> DataFrame:
    """fp, root, component_id of every distinct ``fp`` of staged (doc_id, fp), linked by edges u > v."""
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(edges)
    rooted = staged(distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(ids, "root").select("fp", "root", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near-duplicates the one with the smallest id."""
    prints = staged(fingerprints(docs, id_col, text_col), "simhash")
    digests = lambda texts: np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts)).view(np.int64)
    return one_of_each(docs, prints.join(labels(prints), "fp"), digests, id_col, text_col)


def one_of_each(docs: DataFrame, groups: DataFrame, digests, id_col: str, text_col: str, limit: int = SLICE_BYTES) -> DataFrame:
    """Of each root of ``groups`` (doc_id, fp, root, component_id) the row with the smallest id; ``digests`` gives the fp of texts."""
    stay = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("doc_id", "fp")).alias("k")).select("k.*")

    def printed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for part in slices(b, at, limit):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(digests(part.column(at)))], [*b.schema.names, fp])

    at, fp, key = docs.columns.index(text_col), spare(docs, "_fp"), spare(docs, "_id")
    rows = map_rows(docs, printed, **{fp: T.LongType()})
    stay = stay.select(F.col("doc_id").alias(key), F.col("fp").alias(spare(docs, "_stays")))
    joined = rows.join(stay, quoted(id_col).eqNullSafe(F.col(key)) & (F.col(fp) == F.col(stay.columns[1])), "left_semi")
    return joined.dropDuplicates([id_col, fp]).drop(fp)

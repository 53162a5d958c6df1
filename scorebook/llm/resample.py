"""Importance resampling towards a target: hashed n-gram features, array-scored weights, exact selection.

Features of the corpus and of the target are counted in ``BUCKETS`` buckets; the gain of a bucket is the rounded
log ratio of their smoothed shares, and a document's weight the sum of its features' gains. The gains are one
array, so a batch of documents is scored by one lookup and running sums. A seeded Gumbel number is added, and
the highest keys are drawn without replacement.

The cutoff key is found by weighted median of medians. Every run of at most ``PART`` keys sends its median and
its size; the median of these medians, weighted by the sizes, has at least a quarter of the remaining keys on
either side, so each round discards such a share, and what remains is written anew when it has become small
enough. Only the winners are sorted.

Feature hashes are CRC-32. That of a run of words follows from the words' own by the linear rule for joined
texts, so every word is hashed once, whatever the number of runs it is part of.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorebook.llm.common import narrow, slices, staged, text_bytes

BUCKETS = 10_000
LONGEST_RUN = 3
LEAST_WORDS = 20
#: Share of the documents with ``LEAST_WORDS`` words that is drawn, in percent.
PERCENT = 5
SEED = 42
#: Keys of which one median is taken; the driver gets two numbers for each such run.
PART = 1 << 18
#: Remaining keys that the driver orders itself.
REST = 1 << 16
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
U = np.uint32


def _table() -> np.ndarray:
    """CRC-32 (reflected 0xEDB88320) of every byte."""
    t = np.arange(256, dtype=U)
    for _ in range(8):
        t = np.where(t & U(1), (t >> U(1)) ^ U(0xEDB88320), t >> U(1)).astype(U)
    return t


_CRC = _table()


def _shifts() -> np.ndarray:
    """[n, k, b]: what byte k of a checksum, of value b, turns into when n bytes follow."""
    out = np.zeros((LONG_WORD + 1, 4, 256), U)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=U) << U(8 * k)
    for n in range(LONG_WORD):
        out[n + 1] = _CRC[out[n] & U(255)] ^ (out[n] >> U(8))
    return out


_SHIFT = _shifts()


def _followed(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The checksum's part in that of a text with ``n`` bytes more."""
    crc, n = crc.copy(), n.copy()
    while True:
        step = np.minimum(n, LONG_WORD)
        crc = (_SHIFT[step, 0, crc & U(255)] ^ _SHIFT[step, 1, crc >> U(8) & U(255)] ^ _SHIFT[step, 2, crc >> U(16) & U(255)] ^ _SHIFT[step, 3, crc >> U(24)])
        n -= step
        if not n.any():
            return crc


def word_crcs(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of every word of ``data``."""
    out = np.zeros(len(start), U)
    order = np.argsort(-np.minimum(length, LONG_WORD + 1), kind="stable")
    n = length[order]
    long = int(np.searchsorted(-n, -LONG_WORD, side="left"))
    for i in order[:long].tolist():
        out[i] = zlib.crc32(data[start[i] : start[i] + length[i]].tobytes())
    order, n = order[long:], n[long:]
    at, crc = start[order], np.full(len(order), 0xFFFFFFFF, U)
    for k in range(int(n[0]) if len(n) else 0):
        live = int(np.searchsorted(-n, -k, side="left"))
        crc[:live] = _CRC[(crc[:live] ^ data[at[:live] + k]) & U(255)] ^ (crc[:live] >> U(8))
    out[order] = ~crc
    return out


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text number of every feature, and the number of words of every text."""
    data, off = text_bytes(texts)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    letter = np.zeros(len(data) + 2, bool)
    letter[1:-1] = (data >= 128) | ((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57))
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True
    start = np.flatnonzero(letter[1:] & (~letter[:-1] | cut))
    length = np.flatnonzero(letter[:-1] & (~letter[1:] | cut)) - start
    first = np.searchsorted(start, off)
    words = np.diff(first)
    text, word = np.repeat(np.arange(len(words)), words), word_crcs(data, start, length)
    spaced = _SHIFT[1, 0, word & U(255)] ^ _SHIFT[1, 1, word >> U(8) & U(255)] ^ _SHIFT[1, 2, word >> U(16) & U(255)] ^ _SHIFT[1, 3, word >> U(24)] ^ U(zlib.crc32(b" "))
    run, crcs, texts_of = word, [word], [text]
    for k in range(1, LONGEST_RUN):  # word i, a space, and the run of k words after it
        size = length.copy() if k == 1 else size[:-1] + length[k - 1 :] + 1
        run = _followed(spaced[: len(run) - 1], size[1:]) ^ run[1:] if len(run) > 1 else run[:0]
        inside = text[: len(run)] == text[k:]
        crcs.append(run[inside])
        texts_of.append(text[: len(run)][inside])
        if not len(run):
            break
    return (np.concatenate(crcs) % U(BUCKETS)).astype(np.int64), np.concatenate(texts_of), words


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features of all rows of the column ``text`` in each bucket; a task sends ``BUCKETS`` rows at most."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in it:
            for part in slices(b):
                total += np.bincount(features(part.column("text"))[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    rows = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(share in the target / share in the corpus)) of every bucket, one feature added to each."""
    s, t = corpus.tolist(), target.tolist()
    all_s, all_t = float(sum(s) + BUCKETS), float(sum(t) + BUCKETS)
    return np.array([math.floor(1000 * math.log((b + 1.0) * all_s / ((a + 1.0) * all_t))) for a, b in zip(s, t)], np.int64)


def _luck(doc_id) -> int:
    h = int(hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_features, weight, score, n_words of every row of ``docs`` (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for part in slices(b):
                bucket, text, words = features(part.column("text"))
                n = np.bincount(text, minlength=part.num_rows)
                # Sums of whole numbers below 2^53 are exact in doubles.
                weight = np.bincount(text, weights=sent.value[bucket], minlength=part.num_rows).astype(np.int64)
                luck = np.array([_luck(i) for i in part.column("doc_id").to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x.astype(np.int64)) for x in (n, weight, weight + luck, words))],
                                                 ["doc_id", "n_features", "weight", "score", "n_words"])

    return docs.mapInArrow(run, "doc_id long, n_features long, weight long, score long, n_words long")


def _key() -> Column:
    """Highest score first, then the smaller id (null last), then fewer features; rows alike in it are alike in all columns."""
    return F.struct((-F.col("score")).alias("a"), F.col("doc_id").isNull().alias("b"), F.coalesce("doc_id", F.lit(0)).alias("c"), F.col("n_features").alias("d"))


_KEY = "struct<a:bigint,b:boolean,c:bigint,d:bigint>"


def _literal(key: tuple) -> Column:
    a, b, c, d = key
    return F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).alias("b"), F.lit(c).cast("long").alias("c"), F.lit(d).cast("long").alias("d"))


def _medians(part: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        names = ["a", "b", "c", "d"]

        def median():
            cols = [np.concatenate([h[i] for h in held]) for i in range(4)]
            at = np.lexsort(cols[::-1])[(size - 1) // 2]
            return pa.RecordBatch.from_arrays([*(pa.array(c[at : at + 1]) for c in cols), pa.array([size])], [*names, "n"])

        for b in it:
            for lo in range(0, b.num_rows, part):
                piece = b.slice(lo, part)
                if size and size + piece.num_rows > part:
                    yield median()
                    held, size = [], 0
                held.append([piece.column(c).to_numpy(zero_copy_only=False) for c in names])
                size += piece.num_rows
        if size:
            yield median()

    return run


def cutoff(keys: DataFrame, k: int, part: int = PART, rest: int = REST) -> tuple | None:
    """The k-th smallest key of the staged rows a, b, c, d (None if k < 1 or there are fewer)."""
    at = F.struct("a", "b", "c", "d")
    total = left = keys.count()
    if not 1 <= k <= total:
        return None
    lo = hi = None
    while True:
        rows = keys if lo is None else keys.where(at > _literal(lo))
        rows = rows if hi is None else rows.where(at < _literal(hi))
        if left <= rest:
            return tuple(rows.toPandas().sort_values(["a", "b", "c", "d"]).iloc[k - 1].tolist())
        if 4 * left < total:
            keys, total = staged(rows, "resample-left"), left
            rows = keys
        medians = rows.mapInArrow(_medians(part), "a long, b boolean, c long, d long, n long").toPandas().sort_values(["a", "b", "c", "d"])
        over = medians["n"].cumsum().to_numpy()
        pivot = tuple(medians.iloc[int(np.searchsorted(2 * over, over[-1]))][["a", "b", "c", "d"]].tolist())
        less, same = rows.agg(F.count_if(at < _literal(pivot)), F.count_if(at == _literal(pivot))).first()
        if k <= less:
            hi, left = pivot, less
        elif k <= less + same:
            return pivot
        else:
            lo, k, left = pivot, k - less - same, left - less - same


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
             part: int = PART, rest: int = REST) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null: not drawn) of every document.

    A null or blank text has no features and the weight 0; a null id draws its number as an empty id does and
    comes after all others of the same score. Rows of the same id, score and features are alike and drawn one by
    one. Without target texts all gains follow from the corpus alone. An empty table gives an empty result.
    """
    df = narrow(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    gain = gains(bucket_counts(df), bucket_counts(narrow(target, text=target_col)))
    rows = staged(scored(df, gain), "resample-scores")
    able = rows.where(F.col("n_words") >= LEAST_WORDS)
    k = able.count() * percent // 100
    key = cutoff(able.select(_key().alias("k")).select("k.*"), k, part, rest)
    plain = rows.select("doc_id", "n_features", "weight", "score", "n_words", F.lit(None).cast("long").alias("rank"))
    if key is None:
        return plain.drop("n_words")
    won = (F.col("n_words") >= LEAST_WORDS) & (_key() <= _literal(key))
    won_rows = rows.where(won).select(*plain.columns[:-1], _key().alias("k"))
    ordered = staged(won_rows.repartitionByRange("k").sortWithinPartitions("k").withColumn("at", F.monotonically_increasing_id()), "resample-won")
    slot, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = ordered.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))  # a row a partition
    before = sizes.select("slot", (F.sum("n").over(Window.orderBy("slot")) - F.col("n")).alias("before"))
    rank = F.col("before") + place + 1
    ranked = ordered.withColumn("slot", slot).join(F.broadcast(before), "slot").select(*plain.columns[:-1], F.when(rank <= k, rank).alias("rank"))
    return plain.where(~won).union(ranked).drop("n_words")

"""Benchmark decontamination by the q-gram lemma and banded alignment.

If a benchmark item of n characters occurs in a text with at most e edits, at least n - q + 1 - q e of its q-grams
are shared on e + 1 neighbouring diagonals. Shared q-grams are counted in overlapping diagonal bands, each of
which holds any e + 1 neighbouring diagonals whole; bands that reach the bound are verified by banded alignment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorebook.llm.common import map_rows, narrow, slices, spare

Q = 10
#: Edits allowed per character of an item.
RATE = 0.05
#: Benchmark bytes held by a task at once; a larger benchmark is searched block after block in the same pass.
BLOCK_BYTES = 8 << 20
TABLE_BITS = 22
#: Shared q-grams counted at once.
PAIRS = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, white space as a space, a zero after each; and the start of each."""
    low = [t.lower() for t in texts]
    chars = np.frombuffer("\0".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    chars[(chars >= 9) & (chars <= 13)] = 32
    return chars, np.concatenate(([0], np.cumsum([len(t) + 1 for t in low])))


def gram_hashes(chars: np.ndarray, q: int = Q) -> np.ndarray:
    """64-bit hash of the q characters from each place on (places too near the end left out)."""
    if len(chars) < q:
        return np.zeros(0, np.uint64)
    base, size, powers = chars.astype(np.uint64), 1, _ODD
    total, done = None, 0
    while True:  # joins runs of 1, 2, 4, ... characters by the binary digits of q
        if q >> (size.bit_length() - 1) & 1:
            if total is None:
                total, done = base, size
            else:
                n = len(chars) - done - size + 1
                total, done = total[:n] * powers + base[done : done + n], done + size
        if size * 2 > q:
            break
        n = len(chars) - size * 2 + 1
        base, powers, size = base[:n] * powers + base[size : size + n], np.uint64(int(powers) ** 2 & (1 << 64) - 1), size * 2
    total = total[: len(chars) - q + 1]
    total = (total ^ (total >> np.uint64(32))) * _ODD
    return total ^ (total >> np.uint64(29))


def edit_distance_within(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> int:
    """Fewest edits turning the whole item into some run of ``text`` on diagonals low..high; most + 1 if more."""
    width, big = high - low + 1, most + 1
    row = np.where((np.arange(low, high + 1) >= 0) & (np.arange(low, high + 1) <= len(text)), 0, big)
    shift = np.arange(width)
    for i, c in enumerate(item.tolist(), 1):
        at = i + low + shift  # end of the run for each diagonal
        inside = (at >= 1) & (at <= len(text))
        same = text[np.clip(at - 1, 0, len(text) - 1)] == c
        new = np.where(inside, row + ~same, big)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)  # a character of the item left out
        new = np.where((at >= 0) & (at <= len(text)), new, big)
        row = np.minimum(np.minimum.accumulate(new - shift) + shift, big)  # characters of the text left out
        if row.min() >= big:
            return big
    return int(row.min())


class Items:
    """Index of a block of benchmark items."""

    def __init__(self, ids: list[int], texts: list[str], q: int = Q, rate: float = RATE):
        self.q, self.ids = q, ids
        self.chars, start = code_points(texts)
        self.at, self.n = start[:-1], np.diff(start) - 1
        self.edits = np.maximum(0, np.minimum((self.n * rate).astype(np.int64), (self.n - q) // q))
        self.need = self.n - q + 1 - q * self.edits
        self.short = [i for i in range(len(ids)) if 0 < self.n[i] < q]
        h = gram_hashes(self.chars, q)
        item = np.searchsorted(start, np.arange(len(h)), side="right") - 1
        inside = np.arange(len(h)) + q <= start[item] + self.n[item]
        h, item, j = h[inside], item[inside], (np.arange(len(h)) - start[item])[inside]
        order = np.argsort(h, kind="stable")
        self.grams, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.item, self.j = item[order], j[order]
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self.grams >> np.uint64(64 - TABLE_BITS)] = True
        # Items by size class: hits of one class lie that dense at least.
        self.classes = []
        for size in np.unique(np.ceil(np.log2(np.maximum(self.n, 1)))).tolist():
            some = (np.ceil(np.log2(np.maximum(self.n, 1))) == size) & (self.n >= q)
            if some.any():
                self.classes.append((int(self.need[some].min()), int((self.n + self.edits)[some].max())))

    def bands(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, first diagonal of the band) of all bands with enough shared q-grams."""
        none = np.zeros(0, np.int64)
        h = gram_hashes(chars, self.q)
        p = np.flatnonzero(self.table[h >> np.uint64(64 - TABLE_BITS)])
        if not len(p) or not len(self.grams):
            return none, none
        g = np.searchsorted(self.grams, h[p])
        real = self.grams[np.minimum(g, len(self.grams) - 1)] == h[p]
        p, g = p[real], g[real]
        dense = np.zeros(len(p) + 1, np.int64)
        for need, span in self.classes:
            need = max(1, need)
            k = np.flatnonzero(p[need - 1 :] - p[: len(p) - need + 1] <= span) if len(p) >= need else none
            np.add.at(dense, k, 1)
            np.add.at(dense, k + need, -1)
        keep = np.cumsum(dense[:-1]) > 0
        p, g = p[keep], g[keep]
        n, key, count = self.count[g], np.zeros((2, 0), np.int64), none
        for some in np.split(np.arange(len(g)), np.flatnonzero(np.diff(np.cumsum(n) // PAIRS)) + 1):
            k, c = self._pairs(p[some], g[some])
            key, back = np.unique(np.concatenate([key, k], axis=1), axis=1, return_inverse=True)
            count = np.bincount(back.ravel(), weights=np.concatenate([count, c]), minlength=key.shape[1]).astype(np.int64)
        ok = count >= self.need[key[0]]
        return key[0][ok], (key[1] * (self.edits[key[0]] + 1))[ok]

    def _pairs(self, p: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shared q-grams by (item, band)."""
        n = self.count[g]
        at = np.repeat(self.first[g] - np.cumsum(n) + n, n) + np.arange(n.sum())
        item, diagonal = self.item[at], np.repeat(p, n) - self.j[at]
        edits = self.edits[item]
        band = diagonal // (edits + 1)
        over = diagonal - band * (edits + 1) < edits  # also in the band before, which reaches so far
        item, band = np.concatenate([item, item[over]]), np.concatenate([band, band[over] - 1])
        if not len(item):
            return np.zeros((2, 0), np.int64), np.zeros(0, np.int64)
        base = band.min()
        span = int(band.max() - base) + 1
        key, count = np.unique(item * span + band - base, return_counts=True)
        return np.stack([key // span, key % span + base]), count

    def found(self, texts: list[str]) -> list[list[int]]:
        """For each text, the ids of the items it holds."""
        chars, start = code_points(texts)
        hits = [set() for _ in texts]
        for item, low in zip(*(x.tolist() for x in self.bands(chars))):
            n, e = int(self.n[item]), int(self.edits[item])
            want, high = self.chars[self.at[item] : self.at[item] + n], low + 2 * e
            # A band lies in a text if any of its diagonals does; the zeros between texts match nothing.
            a = int(np.searchsorted(start, min(max(low + e + n // 2, 0), start[-1] - 1), side="right")) - 1
            for t in range(max(0, a - 1), min(len(texts), a + 2)):
                if self.ids[item] in hits[t]:
                    continue
                lo, hi = int(start[t]), int(start[t + 1]) - 1
                if high < lo - e or low + n - e > hi:
                    continue
                begin = max(lo, low)
                exact = any(d >= lo and d + n <= hi and np.array_equal(chars[d : d + n], want) for d in range(begin, min(high, hi - n) + 1))
                from_, to = max(lo, low - e), min(hi, high + n + e)
                if exact or (e and to > from_ and edit_distance_within(want, chars[from_:to], low - from_, high - from_, e) <= e):
                    hits[t].add(self.ids[item])
        for item in self.short:
            want = self.chars[self.at[item] : self.at[item] + self.n[item]].tobytes()
            for t in range(len(texts)):
                body = chars[start[t] : start[t + 1] - 1].tobytes()
                at = body.find(want)
                while at >= 0 and at % 4:
                    at = body.find(want, at + 1)
                if at >= 0:
                    hits[t].add(self.ids[item])
        return [_ordered(h) for h in hits]


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> list[DataFrame]:
    """Items in blocks of about ``limit`` bytes, dealt by a hash."""
    items = narrow(benchmark, item_id=id_col, item=text_col).where("item is not null").select(F.col("item_id").cast("long").alias("item_id"), "item")
    blocks = -(-(items.agg(F.sum(F.octet_length("item") + 64)).first()[0] or 0) // limit)
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "item"), F.lit(max(1, blocks))))
    return [items.where(F.col("block") == b) for b in range(blocks)]


def _ordered(ids) -> list:
    return sorted(ids, key=lambda i: (i is None, i or 0))


def mark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", out: str = "items",
         q: int = Q, rate: float = RATE, limit: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a new array column ``out``: ids of the benchmark items that occur in the whole text.

    An item of n characters occurs if at most ``rate`` n edits turn it into a run of the text, case and kind of
    white space aside (fewer edits for items so short that q-grams could not show them; none below q
    characters). Null texts hold nothing; null and empty items never occur; an item without an id is reported as a
    null at the end; items that repeat are all reported. An empty table gives an empty result, an empty benchmark empty arrays.
    """
    spark = docs.sparkSession
    at = docs.columns.index(text_col)
    df = docs.withColumn(out, F.array().cast("array<long>"))
    for block in blocks_of(benchmark, item_id, item_text, limit):
        rows = block.collect()
        sent = spark.sparkContext.broadcast(([r.item_id for r in rows], [r.item for r in rows]))

        def scan(it: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = None
            for b in it:
                items = items or Items(*sent.value, q, rate)
                for part in slices(b, at):
                    found = items.found([t or "" for t in part.column(at).to_pylist()])
                    old = part.column(part.num_columns - 1).to_pylist()
                    new = pa.array([_ordered({*o, *f}) for o, f in zip(old, found)], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], new], b.schema.names)

        df = map_rows(df, scan)
    return df


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    out = spare(docs, "_items")
    return mark(docs, benchmark, out=out, **options).where(F.size(out) == 0).drop(out)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, contaminated, items of every document."""
    df = mark(narrow(docs, doc_id=id_col, text=text_col), benchmark, **options)
    return df.select("doc_id", (F.size("items") > 0).alias("contaminated"), "items")

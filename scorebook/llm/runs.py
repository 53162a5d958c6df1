"""Periodic runs of words, found online by catching squares over dyadic blocks.

A run is a maximal stretch of words that repeats its first ``period`` words at least ``TIMES`` times. Words are
appended to a stream; whenever two adjacent blocks of L/2 words (L a power of two) are complete, a catcher
stands over the L words. It waits for the first later place, at most L words on, where the suffix of the stream
equals its block: that is a square, a stretch of period d at least 2 d long. Stretches are followed to the left
at once and to the right with every appended word until they break, and squares of one stretch merge.

A catcher of L words catches the smallest period d of its place if d <= L: were the block to recur sooner, the
period would not be the smallest. A run of period L/2 < d <= L and length 4 d has a whole catcher block in its
first 3 d words, so the catchers of L find every such run, and each run is reported at one level only.

Suffixes are compared for all catchers of a level together, by 64-bit hashes built from those of half the
length; a match counts only once its words themselves have been compared.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorebook.llm.common import WORD, narrow, slices

TIMES = 4
LEAST_WORDS = 6
#: Words appended to the catchers at once.
APPEND = 1 << 17
#: Bytes of one text split into words at once.
PIECE = 1 << 20
U = np.uint64
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(29))


class _Level:
    """Catchers of ``size`` words: hashes of the words from ``base`` on, and the catchers that have caught."""

    def __init__(self, size: int):
        self.size, self.base, self.hash, self.caught = size, 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def advance(self, half: _Level | None, fresh: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Takes in the stream up to now; returns (block, distance) of the squares that catchers of this level find.

        ``fresh`` are the hashes of the new words, used by the level of one word.
        """
        size, step, have = self.size, max(1, self.size // 2), self.base + len(self.hash)
        if half is None:
            new = fresh
        else:
            h = half.hash[have - half.base :]
            new = _mixed(h[: len(words) - size + 1 - have] * U(0x9E3779B97F4A7C15) + h[step:])
        self.hash = np.concatenate([self.hash, new])
        at = np.arange(have, have + len(new))
        found = []
        first = (at - 1) // step * step
        for block in (first,) if size == 1 else (first, first - step):
            low = int(np.searchsorted(block, 0))
            hit = np.flatnonzero(self.hash[block[low:] - self.base] == new[low:]) + low
            found.append((block[hit], at[hit]))
        block, at = (np.concatenate(x) for x in zip(*found))
        waits = ~np.isin(block, self.caught)
        block, at = block[waits], at[waits]
        order = np.lexsort((at, block))
        block, at = block[order], at[order]
        while True:  # more than once only if different words had one hash
            first = np.ones(len(block), bool)
            first[1:] = block[1:] != block[:-1]
            same = self._same(words, block[first], at[first])
            if same.all():
                break
            first[first] = ~same
            block, at = block[~first], at[~first]
        block, at = block[first], at[first]
        self.caught = np.concatenate([self.caught, block])
        return block, at - block

    def _same(self, words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the words at a and at b are equal, a million words at a time."""
        out, some, k = np.zeros(len(a), bool), max(1, (1 << 20) // self.size), np.arange(self.size)
        for lo in range(0, len(a), some):
            i = slice(lo, lo + some)
            out[i] = (words[a[i, None] + k] == words[b[i, None] + k]).all(axis=1)
        return out

    def forget(self, n: int) -> None:
        """Drop what no later word is compared with."""
        base = max(self.base, n - 2 * self.size + 1)
        self.hash, self.base = self.hash[base - self.base :], base
        self.caught = self.caught[self.caught >= base]


class Catchers:
    """Runs of a growing stream of whole numbers; ``longest`` bounds the length of a run if it is known."""

    def __init__(self, longest: int | None = None):
        self.longest, self.n, self.buffer = longest, 0, np.zeros(1 << 10, np.int64)
        self.levels: list[_Level] = []
        self.open: dict[int, tuple[int, int]] = {}  # period: start and end of the stretch that reaches the end
        self.runs: list[tuple[int, int, int]] = []

    def append(self, values: np.ndarray) -> None:
        old, self.n = self.n, self.n + len(values)
        if self.n > len(self.buffer):
            self.buffer = np.concatenate([self.buffer[:old], np.zeros(max(self.n, 2 * old) - old, np.int64)])
        self.buffer[old : self.n] = values
        touched = {d: [(a, self._right(b, d))] for d, (a, b) in self.open.items()}
        fresh, half, size = _mixed((values.astype(np.int64).view(np.uint64) + U(1)) * U(0x94D049BB133111EB)), None, 1
        for k in range(64):
            if k == len(self.levels):
                if size > 1 and (self.n < size or (self.longest is not None and 2 * size > self.longest)):
                    break
                self.levels.append(_Level(size))
            level = self.levels[k]
            block, distance = level.advance(half, fresh, self.buffer[: self.n])
            mine = 2 * distance > size
            self._stretches(block[mine], distance[mine], size, touched)
            half, size = level, 2 * size
        for level in self.levels:
            level.forget(self.n)
        self.open = {}
        for d, found in touched.items():
            for a, b in found:
                if b == self.n:
                    self.open[d] = (a, b)
                else:
                    self._report(a, b, d)

    def finish(self) -> list[tuple[int, int, int]]:
        """All runs as (start, length, period), in order of start and period."""
        for d, (a, b) in self.open.items():
            self._report(a, b, d)
        self.open = {}
        return sorted(self.runs, key=lambda r: (r[0], r[2]))

    def _report(self, a: int, b: int, d: int) -> None:
        if b - a >= max(LEAST_WORDS, TIMES * d):
            self.runs.append((a, b - a, d))

    def _stretches(self, block: np.ndarray, distance: np.ndarray, size: int, touched: dict) -> None:
        """Adds the stretches that squares at ``block`` belong to, neighbouring squares of one distance merged first."""
        order = np.lexsort((block, distance))
        block, distance = block[order], distance[order]
        new = np.ones(len(block), bool)
        new[1:] = (distance[1:] != distance[:-1]) | (block[1:] > block[:-1] + size)
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(block)) - 1 if len(heads) else heads
        for lo, d, hi in zip(block[heads].tolist(), distance[heads].tolist(), (block[tails] + size).tolist() if len(heads) else []):
            known = touched.setdefault(d, [])
            if any(a <= lo and hi + d <= b for a, b in (known[:1] + known[-1:])):
                continue
            known.append((self._left(lo, d), self._right(hi + d, d)))

    def _right(self, b: int, d: int) -> int:
        """End of the stretch of period d that holds the words before b."""
        x, step = self.buffer, 16
        while b < self.n:
            top = min(self.n, b + step)
            same = x[b:top] == x[b - d : top - d]
            if not same.all():
                return b + int(same.argmin())
            b, step = top, 4 * step
        return b

    def _left(self, a: int, d: int) -> int:
        x, step = self.buffer, 16
        while a > 0:
            low = max(0, a - step)
            same = (x[low:a] == x[low + d : a + d])[::-1]
            if not same.all():
                return a - int(same.argmin())
            a, step = low, 4 * step
        return a


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, about ``PIECE`` bytes at a time."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield text[at:end].split()
        at = end


def text_runs(texts: list[bytes]) -> tuple[list[list[tuple[int, int, int]]], list[int]]:
    """The runs of every text and its number of words. All texts are one stream, a number of its own between two of them."""
    number = defaultdict(count().__next__)
    catchers = Catchers(max((len(t) + 1 for t in texts), default=0) // 2)
    held, size, first, sizes = [], 0, 0, []
    starts = []
    for k, text in enumerate(texts):
        starts.append(first)
        n = 0
        for words in _pieces(text):
            held.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
            n += len(words)
            size += len(words)
            if size >= APPEND:
                catchers.append(np.concatenate(held))
                held, size = [], 0
        sizes.append(n)
        held.append(np.array([-k - 1]))
        size += 1
        first += n + 1
    if held:
        catchers.append(np.concatenate(held))
    out = [[] for _ in texts]
    runs = catchers.finish()
    owner = np.searchsorted(np.array(starts), [r[0] for r in runs], side="right") - 1 if runs else []
    for (a, n, d), k in zip(runs, owner):
        out[k].append((a - starts[k], n, d))
    return out, sizes


def collapsed(text: bytes, runs: list[tuple[int, int, int]], n: int) -> bytes:
    """The words that stay, joined by a space: of every run only its first period."""
    if not runs:
        return b" ".join([w for words in _pieces(text) for w in words])
    gone = np.zeros(n + 1, np.int64)
    for a, length, d in runs:
        gone[a + d] += 1
        gone[a + length] -= 1
    keep, at, out = np.cumsum(gone)[:n] == 0, 0, []
    for words in _pieces(text):
        out += [words[i] for i in np.flatnonzero(keep[at : at + len(words)]).tolist()]
        at += len(words)
    return b" ".join(out)


def _found(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        for part in slices(b):
            texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in part.column("text")]
            runs, sizes = text_runs(texts)
            flat = np.array([r for rs in runs for r in rs], np.int64).reshape(-1, 3)
            off = pa.array(np.concatenate(([0], np.cumsum([len(r) for r in runs]))).astype(np.int32))
            lists = pa.ListArray.from_arrays(off, pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"]))
            kept = [collapsed(t, r, n) for t, r, n in zip(texts, runs, sizes)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), lists, pa.array(kept, pa.binary()).cast(pa.string())],
                                             ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start and period) and collapsed text of every row.

    Words are split at ASCII white space. ``collapsed`` has the words that no run contains after its first
    period, joined by a space. Null and blank texts have no words, no runs and an empty collapsed text; null and
    repeated ids keep their rows. An empty table gives an empty result.
    """
    df = narrow(docs, doc_id=id_col, text=text_col)
    return df.mapInArrow(_found, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed string")


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """doc_id, text; in a tenth of the documents, by the id's CRC-32, the words from some place on repeat a period.

    Rows with a null id stay as they are.
    """
    df = narrow(docs, doc_id="doc_id", text="text").withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    # The split is inside a filter, so only rows that are changed are split.
    words = F.when(F.col("h") % 10 == 0, F.filter(F.split("text", WORD.replace("^", "")), lambda w: w != ""))
    df = df.withColumn("w", words).withColumn("n", F.size("w")).withColumn("g", F.floor(F.col("h") / 10))
    df = df.withColumn("a", F.expr("CASE WHEN n > 0 THEN g % n END")).withColumn("p", F.expr("1 + floor((n - a) / (3 + g % 8))"))
    tail = F.expr("transform(sequence(0L, n - a - 1), i -> element_at(w, cast(a + i % p + 1 AS int)))")
    text = F.when(F.col("a").isNotNull(), F.concat_ws(" ", F.expr("slice(w, 1, cast(a AS int))"), tail)).otherwise(F.col("text"))
    return df.select("doc_id", text.alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """One row a document: number of runs, the run that repeats most often, and hashes of all runs and of the collapsed text."""
    lines = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')"
    best = ("aggregate(runs, cast(null AS struct<start:bigint,length:bigint,period:bigint>), "
            "(m, r) -> CASE WHEN m IS NULL OR r.length * m.period > m.length * r.period THEN r ELSE m END)")
    return found.withColumn("best", F.expr(best)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.expr(lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))

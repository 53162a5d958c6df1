"""Exact substring removal: word windows that occur earlier in the corpus, found by factoring texts.

Every text is factored relative to all others, in the manner of a relative Lempel-Ziv parse. Factors are cut by
content: a factor is the run of windows whose smallest hash of ``ANCHOR`` words is the same word run, so equal
passages give equal factors wherever they lie. Reference blocks hold the factors that share an anchor; a factor
found earlier in its block is a duplicate span as a whole. Only a factor that is new but whose anchor has
another factor can still hold repeated windows, at its ends where a shared passage begins or stops; those
boundary windows are looked up one by one.

An occurrence leaves its task only if it is the earliest of its slice, so a passage in a third of all texts is
sent once a slice. Anchors with many different factors in a task (a passage's edge in many texts) are dealt out
by factor. Reduce tasks stream over sorted rows and hold no group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorebook.llm.common import narrow, slices, staged, text_bytes, word_bounds

WINDOW = 20
ANCHOR = 6
#: An anchor with so many different factors in one slice may be hot; the million most frequent at most are dealt out by factor.
MANY = 48
HOT_LIMIT = 1_000_000
SALTS = 256
SEED = 20
U = np.uint64
_RNG = np.random.default_rng(SEED)
_BYTE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_R, _A, _B = (U(int(x) * 2 + 1) for x in _RNG.integers(1 << 61, 1 << 62, 3))


def _inverse(x: np.uint64) -> np.uint64:
    return U(pow(int(x), -1, 1 << 64))


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2^64, grown as needed."""

    def __init__(self, base: np.uint64):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> _Powers:
        if len(self.up) < n:
            for name, b in (("up", self.base), ("down", _inverse(self.base))):
                p = np.full(n, b)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))
        return self


_PR, _PA, _PB = _Powers(_R), _Powers(_A), _Powers(_B)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0x9FB21C651E98DF25)
    return x ^ (x >> U(32))


class Prefix:
    """Hash of any run of values in constant time: prefix sums of value times power."""

    def __init__(self, values: np.ndarray, powers: _Powers):
        n = len(values)
        self.p = powers.to(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self.p.up[:n], out=self.sums[1:])

    def run(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[b] - self.sums[a]) * self.p.down[a] + (b - a).astype(np.uint64))


class Words:
    """Words of a slice of texts: bounds in bytes, first word of each text, and hashes of word runs."""

    def __init__(self, texts: pa.Array):
        self.data, off = text_bytes(texts)
        self.starts, self.ends, self.first = word_bounds(self.data, off)
        values = Prefix(_BYTE[self.data], _PR).run(self.starts, self.ends)
        self.a, self.b = Prefix(values, _PA), Prefix(_mixed(values + U(7)), _PB)
        self.n = len(values)

    def factors(self) -> tuple[np.ndarray, ...]:
        """text, first word, windows, anchor hash, two content hashes of every factor."""
        none = tuple(np.zeros(0, np.int64) for _ in range(6))
        if self.n < WINDOW:
            return none
        at = np.arange(self.n - ANCHOR + 1)
        gram = self.a.run(at, at + ANCHOR)
        low, have = at, 1  # leftmost smallest gram of ``have`` grams from each word
        need = WINDOW - ANCHOR + 1
        while have < need:
            step = min(have, need - have)
            left, right = low[:-step], low[step:]
            low, have = np.where(gram[left] <= gram[right], left, right), have + step
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        start = np.flatnonzero(text[: self.n - WINDOW + 1] == text[WINDOW - 1 :])  # windows inside one text
        if not len(start):
            return none
        low = low[start]
        new = np.ones(len(start), bool)
        new[1:] = (low[1:] != low[:-1]) | (start[1:] != start[:-1] + 1)
        i = np.flatnonzero(new)
        windows = np.diff(np.append(i, len(start)))
        a = start[i]
        return text[a], a - self.first[text[a]], windows, gram[low[i]], self.a.run(a, a + windows + WINDOW - 1), self.b.run(a, a + windows + WINDOW - 1)


def _earliest(k1: np.ndarray, k2: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by key, document and place; in it, the place of each row's first row of the same key."""
    order = np.lexsort((at, doc, k2, k1))
    k1, k2 = k1[order], k2[order]
    new = np.ones(len(order), bool)
    new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    return order, np.flatnonzero(new)[np.cumsum(new) - 1]


# A place packs the first word and the number of windows; th, the 64-bit hash of the text, tells rows with the same id apart.
def _pack(pos: np.ndarray, windows: np.ndarray | int) -> np.ndarray:
    return (pos.astype(np.int64) << 4) | windows


_ROWS = "key long, salt int, k1 long, k2 long, doc_id long, th long, at long"


def _rows(key, salt, k1, k2, doc, th, at) -> pa.RecordBatch:
    n = len(doc)
    full = lambda x, t: pa.array(np.broadcast_to(x, n).astype(t) if not isinstance(x, np.ndarray) or x.dtype != np.uint64 else x.view(np.int64))
    return pa.RecordBatch.from_arrays([full(key, np.int64), full(salt, np.int32), full(k1, np.int64), full(k2, np.int64), full(doc, np.int64), full(th, np.int64), full(at, np.int64)],
                                      ["key", "salt", "k1", "k2", "doc_id", "th", "at"])


def _ids(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64), part.column("th").to_numpy(zero_copy_only=False).astype(np.int64)


def _hot(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        for part in slices(b):
            _, _, _, anchor, k1, _ = Words(part.column("text")).factors()
            pairs = np.unique(np.stack([anchor, k1]), axis=1)[0] if len(anchor) > MANY else anchor[:0]
            key, n = np.unique(pairs, return_counts=True)
            key, n = key[n >= MANY], n[n >= MANY]
            if len(key):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])


def _later(ask: bool):
    """Streams over rows sorted by key, k1, k2, doc_id and at: a row whose content began earlier is a duplicate
    (kind 0). If ``ask``, the first of each content whose key has another content is to be looked into (kind 1);
    salted keys always are. Rows with k1 = k2 = 0 are known duplicates passing through."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None  # key, k1, k2, doc, pos of the content at hand
        held = None  # the one first row of a key whose next row is still to be seen
        for b in it:
            key, k1, k2, doc, th, at = (b.column(c).to_numpy() for c in ("key", "k1", "k2", "doc_id", "th", "at"))
            salted, pos, n = b.column("salt").to_numpy() > 0, at >> 4, len(doc)
            if not n:
                continue
            known = (k1 == 0) & (k2 == 0)
            new = np.ones(n, bool)
            new[1:] = (key[1:] != key[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            if first and (key[0], k1[0], k2[0]) == first[:3]:
                new[0] = False
            src = np.cumsum(new) - 1
            at_new = np.flatnonzero(new)
            sdoc, spos = np.append(doc[at_new], first[3] if first else 0), np.append(pos[at_new], first[4] if first else 0)
            dup = known | (~new & ((doc > sdoc[src]) | ((doc == sdoc[src]) & (pos > spos[src]))))
            out = [(doc[dup], th[dup], at[dup], np.zeros(dup.sum(), np.int32))]
            if ask:
                heads = np.flatnonzero(new & ~known)
                hkey, hsalt = key[heads], salted[heads]
                twin = np.zeros(len(heads), bool)
                twin[1:] |= hkey[1:] == hkey[:-1]
                twin[:-1] |= hkey[1:] == hkey[:-1]
                if held and len(heads) and held[0] == hkey[0]:
                    twin[0] = True
                    if not held[4]:
                        out.append((*(np.array([x]) for x in held[1:4]), np.ones(1, np.int32)))
                go = twin | hsalt
                out.append((doc[heads[go]], th[heads[go]], at[heads[go]], np.ones(go.sum(), np.int32)))
                if len(heads):
                    held = (hkey[-1], doc[heads[-1]], th[heads[-1]], at[heads[-1]], bool(go[-1]))
            last = at_new[-1] if len(at_new) else None
            if last is not None:
                first = (key[last], k1[last], k2[last], doc[last], pos[last])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out])) for i in range(4)], ["doc_id", "th", "at", "kind"])

    return run


def _emit(key, salt, k1, k2, doc, th, at) -> Iterator[pa.RecordBatch]:
    """The earliest row of each content of a slice under its key; later ones as known duplicates under their document."""
    if not len(doc):
        return
    order, head = _earliest(k1, k2, doc, at >> 4 << 4)
    doc, th, at, pos = doc[order], th[order], at[order], at[order] >> 4
    later = (doc > doc[head]) | ((doc == doc[head]) & (pos > pos[head]))
    one = ~later
    yield _rows(key[order][one], salt[order][one], k1[order][one], k2[order][one], doc[one], th[one], at[one])
    if later.any():
        yield _rows(_mixed(doc[later].view(np.uint64)), 0, 0, 0, doc[later], th[later], at[later])


def duplicate_spans(docs: DataFrame) -> DataFrame:
    """doc_id, th, first word, words of every duplicate span of ``docs`` (doc_id long, th, text); spans may overlap."""
    spark = docs.sparkSession
    hot = (docs.select("text").mapInArrow(_hot, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "key").limit(HOT_LIMIT).select("key").toPandas()["key"].to_numpy(np.int64))
    sent = spark.sparkContext.broadcast(np.sort(hot))

    def factored(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for part in slices(b):
                text, pos, windows, anchor, k1, k2 = Words(part.column("text")).factors()
                doc, th = _ids(part)
                salt = np.where(np.isin(anchor.view(np.int64), sent.value), (k1.view(np.uint64) % U(SALTS)).astype(np.int32) + 1, 0)
                yield from _emit(anchor, salt, k1, k2, doc[text], th[text], _pack(pos, windows))

    found = staged(docs.mapInArrow(factored, _ROWS).repartition("key", "salt").sortWithinPartitions("key", "k1", "k2", "doc_id", "at")
                   .mapInArrow(_later(True), "doc_id long, th long, at long, kind int"), "spans-factors")

    def boundary(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for part in slices(b):
                w, (doc, th) = Words(part.column("text")), _ids(part)
                asks, row = part.column("asks").flatten().to_numpy(), pa.compute.list_parent_indices(part.column("asks")).to_numpy()
                n = asks & 15
                pos = np.repeat(asks >> 4, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                row = np.repeat(row, n)
                a = w.first[row] + pos
                k1, k2 = w.a.run(a, a + WINDOW), w.b.run(a, a + WINDOW)
                yield from _emit(k1, np.zeros(len(k1), np.int32), k1, k2, doc[row], th[row], _pack(pos, 1))

    asks = found.where("kind = 1").groupBy("doc_id", "th").agg(F.collect_set("at").alias("asks"))
    windows = (docs.join(asks, ["doc_id", "th"]).mapInArrow(boundary, _ROWS).repartition("key").sortWithinPartitions("key", "k1", "k2", "doc_id", "at")
               .mapInArrow(_later(False), "doc_id long, th long, at long, kind int"))
    return (found.where("kind = 0").union(windows)
            .select("doc_id", "th", F.shiftright("at", 4).alias("pos"), (F.col("at").bitwiseAND(15) + WINDOW - 1).alias("words")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the words left, joined by a space) of every whole text.

    A window of ``WINDOW`` words is a duplicate if the same words also start at a smaller id, or earlier in the
    same document; all words it covers are removed. Windows are judged on the input. Null and blank texts have
    no words (the hash of nothing); rows that repeat id and text get the same result and do not count against
    each other; null ids are ordered first. An empty table gives an empty result.
    """
    least = F.lit(-(1 << 63)).cast("long")
    df = narrow(docs, doc_id=id_col, text=text_col).select(
        F.coalesce(F.col("doc_id").cast("long"), least).alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    spans = duplicate_spans(df).groupBy("doc_id", "th").agg(F.collect_list(F.shiftleft("pos", 8).bitwiseOR(F.col("words"))).alias("spans"))

    def kept(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for part in slices(b):
                w = Words(part.column("text"))
                spans, row = part.column("spans").flatten().to_numpy(zero_copy_only=False).astype(np.int64), pa.compute.list_parent_indices(part.column("spans")).to_numpy()
                a = w.first[row] + (spans >> 8)
                cover = np.bincount(a, minlength=w.n + 1) - np.bincount(a + (spans & 255), minlength=w.n + 1)
                keep = np.cumsum(cover)[: w.n] == 0
                total, left = np.diff(w.first), np.diff(np.concatenate(([0], np.cumsum(keep)))[w.first])
                data, texts = w.data.tobytes(), []
                for lo, hi in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
                    k = np.flatnonzero(keep[lo:hi]) + lo
                    texts.append(b" ".join([data[s:e] for s, e in zip(w.starts[k].tolist(), w.ends[k].tolist())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(total.astype(np.int64)), pa.array((total - left).astype(np.int64)),
                     pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array([t.decode("utf-8", "surrogatepass") for t in texts], pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return (df.join(spans, ["doc_id", "th"], "left")
            .mapInArrow(kept, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
            .withColumn("doc_id", F.nullif("doc_id", least)))

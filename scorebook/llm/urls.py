"""URL filters by Bloom filter cascades.

A cascade answers exactly for every key of a known universe: level 0 holds the listed keys, level 1 the
universe's keys that level 0 passes by mistake, level 2 the listed keys that level 1 passes, and so on until
none is left. Its size follows the list, not the corpus, so it can be sent to every task; urls are judged
without a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorebook.llm.common import narrow, staged

#: The rules as (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
MAX_LEVELS = 60
MIX = np.uint64(0x9E3779B97F4A7C15)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased) and path (then up to ``?`` or ``#``)."""
    host = F.regexp_extract(url, "://([^/?#]*)", 1)
    path = F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every key a rule fitting the url can have: a host suffix from a label on, and a path prefix of a listed length."""
    labels = F.split(host, r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.filter(F.transform(F.array(*[F.lit(n) for n in lengths]), lambda n: F.when(F.length(path) >= n, F.substr(path, F.lit(1), n))),
                     lambda p: p.isNotNull())
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))


def hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(key, F.lit(1)).alias("h2")]


@dataclass(frozen=True)
class Cascade:
    """Levels of (bits, hash functions, words); ``contains`` is exact over the universe it was built on."""

    levels: tuple[tuple[int, int, np.ndarray], ...]

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        inside = np.zeros(len(h1), bool)
        open_ = np.arange(len(h1))
        for level, (bits, k, words) in enumerate(self.levels):
            ok = passes(h1[open_], h2[open_], level, bits, k, words)
            inside[open_[~ok]] = level % 2 == 1
            open_ = open_[ok]
        inside[open_] = len(self.levels) % 2 == 1
        return inside


def positions(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, k: int) -> np.ndarray:
    """Bit numbers of each key in a level, one column per hash function."""
    with np.errstate(over="ignore"):
        x = (h1.view(np.uint64) ^ np.uint64(level + 1)) * MIX
        x ^= x >> np.uint64(31)
        y = (h2.view(np.uint64) + np.uint64(level)) * MIX
        y = (y ^ (y >> np.uint64(29))) | np.uint64(1)
        return ((x[:, None] + np.arange(k, dtype=np.uint64) * y[:, None]) >> np.uint64(3)) % np.uint64(bits)


def passes(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, k: int, words: np.ndarray) -> np.ndarray:
    pos = positions(h1, h2, level, bits, k)
    return (words[(pos >> np.uint64(6)).astype(np.int64)] >> (pos & np.uint64(63)) & np.uint64(1)).all(axis=1)


def _longs(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names]


def _level(keys: DataFrame, n: int, wrong: float, level: int) -> tuple[int, int, np.ndarray]:
    """A Bloom filter of ``n`` keys: each task sets bits in words of 64, which are or-ed per word."""
    bits = max(64, math.ceil(-n * math.log(wrong) / math.log(2) ** 2))
    k = max(1, round(bits / n * math.log(2)))

    def words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            pos = positions(*_longs(b, "h1", "h2"), level, bits, k).ravel()
            word, at = np.unique(pos >> np.uint64(6), return_inverse=True)
            val = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(val, at, np.uint64(1) << (pos & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(val.view(np.int64))], ["word", "val"])

    rows = keys.mapInArrow(words, "word long, val long").groupBy("word").agg(F.bit_or("val").alias("val")).collect()
    full = np.zeros((bits + 63) // 64, np.int64)
    for r in rows:
        full[r.word] = r.val
    return bits, k, full.view(np.uint64)


def build_cascade(listed: DataFrame, universe: DataFrame, n_universe: int) -> Cascade:
    """Cascade of the distinct keys ``listed`` (key) over ``universe`` (key, h1, h2), both read once per level at most.

    Level 0 errs so rarely that level 1 holds about as many keys as the list, and from there half of the
    keys of one side pass each level. The filters are as large as the list times the logarithm of the
    universe, which is the only thing the driver gathers and sends out.
    """
    yes = staged(listed.select("key", *hashes(F.col("key"))), "cascade-listed")
    no, n_yes, n_no, levels = universe, yes.count(), n_universe, []
    while n_yes and len(levels) < MAX_LEVELS:
        at = len(levels)
        wrong = 0.5 if at else min(0.5, math.sqrt(0.5) * n_yes / max(1, n_no))
        level = _level(yes, n_yes, wrong, at)
        levels.append(level)

        def let(it: Iterator[pa.RecordBatch], at: int = at, level: tuple = level) -> Iterator[pa.RecordBatch]:
            for b in it:
                yield b.filter(pa.array(passes(*_longs(b, "h1", "h2"), at, *level)))

        passed = no.mapInArrow(let, "key string, h1 long, h2 long")
        if not at:  # the only comparison with the list itself; few keys come this far
            passed = passed.join(yes.select("key"), "key", "left_anti").select("key", "h1", "h2")
        passed = staged(passed, "cascade-passed")
        yes, no, n_yes, n_no = passed, yes, passed.count(), n_yes
    if n_yes:
        raise ValueError("two different keys share both hashes")
    return Cascade(tuple(levels))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of every url.

    ``rules``: host, path, verdict (allow or block). A rule fits its host and all subdomains if the url's
    path starts with its path; the longest key (host and path together) wins, block before allow if one key is
    in both lists. A url that no rule fits is in neither cascade: rule null, verdict allow.

    A null url, or one without ``://``, has an empty host and path. Repeated urls and ids keep their rows. An
    empty table or list gives an empty result or allows all.
    """
    spark = pages.sparkSession
    rules = rules.select("host", "path", "verdict")
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect() if r[0] is not None)
    host, path = split_url(F.col("url"))
    urls = (narrow(pages, page_id=id_col, url=url_col).select("page_id", host.alias("host"), path.alias("path"))
            .withColumn("keys", candidates(F.col("host"), F.col("path"), lengths or [0])))
    universe = staged(urls.select(F.explode("keys").alias("key")).distinct().select("key", *hashes(F.col("key"))), "cascade-universe")
    n = universe.count()
    built = {}
    for verdict in ("block", "allow"):
        listed = rules.where(F.col("verdict") == verdict).select(F.concat("host", "path").alias("key")).distinct()
        built[verdict] = build_cascade(listed, universe, n)
    sent = spark.sparkContext.broadcast(built)

    def look(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            lists = b.column("keys")
            key, row = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
            h1, h2 = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("h1", "h2"))
            block = sent.value["block"].contains(h1, h2)
            hit = np.flatnonzero(block | sent.value["allow"].contains(h1, h2))
            size = pc.utf8_length(key).to_numpy(zero_copy_only=False)[hit]
            order = hit[np.lexsort((-size, row[hit]))]
            rows, first = np.unique(row[order], return_index=True)
            best = order[first]
            at = np.full(b.num_rows, -1)
            at[rows] = best
            found = at >= 0
            rule = key.take(pa.array(np.where(found, at, 0), mask=~found))
            verdict = np.where(found & block[np.where(found, at, 0)], "block", "allow") if len(key) else np.full(b.num_rows, "allow")
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), b.column("path"), rule, pa.array(verdict, pa.string())],
                                             ["page_id", "host", "path", "rule", "verdict"])

    return (urls.withColumn("h1", F.transform("keys", lambda k: F.xxhash64(k))).withColumn("h2", F.transform("keys", lambda k: F.xxhash64(k, F.lit(1))))
            .mapInArrow(look, f"page_id {urls.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string"))

"""Token counts by dynamic programming over prefixes.

The encoding of a prefix ends in exactly one token, and that token fits the last token of the prefix before it.
So the count of a prefix is the count of a shorter one plus one: for each place the tokens that end there are
tried, longest first, until one fits. The result is the exact count at every prefix of a text, kept as one
signed byte per character (the change of the count), which answers truncation and budget questions without
encoding again. Pieces of text are cut by the tokenizer's pattern and computed once a task, many at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scorebook.llm.common import narrow

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
#: Pieces whose counts a task keeps; when full, it starts anew.
KEPT = 150_000
TEXTS, CHARS = 400, 1 << 20


class IntMap:
    """Open-addressing map of non-negative ints to ints, looked up many at a time."""

    def __init__(self, size: int):
        self.keys, self.vals, self.n = np.full(size, -1, np.int64), np.full(size, -1, np.int64), 0

    def _slot(self, k: np.ndarray) -> np.ndarray:
        shift = np.uint64(64 - (len(self.keys).bit_length() - 1))
        return (k.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> shift).astype(np.int64)

    def get(self, k: np.ndarray) -> np.ndarray:
        out, open_, h = np.full(len(k), -1, np.int64), np.arange(len(k)), self._slot(k)
        while len(open_):
            have = self.keys[h]
            hit = have == k[open_]
            out[open_[hit]] = self.vals[h[hit]]
            go = ~hit & (have != -1)
            open_, h = open_[go], (h[go] + 1) & (len(self.keys) - 1)
        return out

    def put(self, k: np.ndarray, v: np.ndarray) -> None:
        """Distinct keys that are not in the map."""
        if (self.n + len(k)) * 2 > len(self.keys):
            old, full = self.keys[self.keys >= 0], self.vals[self.keys >= 0]
            size = len(self.keys)
            while (self.n + len(k)) * 2 > size:
                size *= 2
            self.__init__(size)
            self.put(old, full)
        self.n += len(k)
        h = self._slot(k)
        while len(k):
            free = self.keys[h] == -1
            self.keys[h[free]] = k[free]
            done = self.keys[h] == k
            self.vals[h[done]] = v[done]
            k, v, h = k[~done], v[~done], (h[~done] + 1) & (len(self.keys) - 1)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Counter:
    """Prefix counts under one byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        tok = Tokenizer.from_file(path)
        self.bpe = tok.model
        alphabet = byte_alphabet()
        back = {c: i for i, c in enumerate(alphabet)}
        self.special = sorted((t.content for t in tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        added = set(self.special)
        self.text = {i: t for t, i in tok.get_vocab(with_added_tokens=False).items() if t not in added}
        self._build({i: bytes(back[c] for c in t) for i, t in self.text.items() if all(c in back for c in t)})
        self.fits = IntMap(1 << 18)
        self.memo: dict[str, bytes] = {}
        self.wide = False
        self.blank, self.blanks = regex.compile(r"\s+"), regex.compile(r"\s\s")

    def _build(self, tokens: dict[int, bytes]) -> None:
        """Suffix automaton of the vocabulary: a tree of token prefixes, the next shorter suffix of each node, and
        the longest token that ends in a node."""
        edges, at, depth = {}, {}, [0]
        parent, byte = [0], [0]
        for i, b in tokens.items():
            node = 0
            for x in b:
                key = node << 8 | x
                if key not in edges:
                    edges[key] = len(depth)
                    depth.append(depth[node] + 1)
                    parent.append(node)
                    byte.append(x)
                node = edges[key]
            at[node] = i
        fail, best = [0] * len(depth), [-1] * len(depth)
        self.shorter = np.full(max(tokens) + 1, -1, np.int64)
        for node in sorted(range(1, len(depth)), key=depth.__getitem__):
            f = fail[parent[node]]
            while parent[node] and f and (f << 8 | byte[node]) not in edges:
                f = fail[f]
            fail[node] = edges.get(f << 8 | byte[node], 0) if parent[node] else 0
            best[node] = at.get(node, best[fail[node]])
            if node in at:
                self.shorter[at[node]] = best[fail[node]]
        self.fail, self.best = np.array(fail), np.array(best)
        self.edges = IntMap(1 << (len(edges) * 3).bit_length())
        self.edges.put(np.fromiter(edges, np.int64, len(edges)), np.fromiter(edges.values(), np.int64, len(edges)))
        self.size = np.zeros(max(tokens) + 1, np.int64)
        self.size[list(tokens)] = [len(b) for b in tokens.values()]

    def fit(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether the vocabulary's own merges leave the two tokens as they are side by side (before -1: alone)."""
        pair = (before + 1) << 20 | token
        got = self.fits.get(pair)
        missing = np.unique(pair[got < 0])
        if len(missing):
            val = []
            for p in missing.tolist():
                a, b = (p >> 20) - 1, p & 0xFFFFF
                ids = [t.id for t in self.bpe.tokenize((self.text[a] if a >= 0 else "") + self.text[b])]
                val.append(int(ids == ([a, b] if a >= 0 else [b])))
            self.fits.put(missing, np.array(val))
            got = self.fits.get(pair)
        return got > 0

    def piece_counts(self, pieces: list[bytes]) -> np.ndarray:
        """Token counts after each byte, for pieces of similar length, one row each."""
        n, width = len(pieces), max(map(len, pieces))
        size = np.array([len(p) for p in pieces])
        byte = np.zeros((width, n), np.int64)
        for i, p in enumerate(pieces):
            byte[: len(p), i] = np.frombuffer(p, np.uint8)
        count, last = np.zeros((width + 1, n), np.int32), np.full((width + 1, n), -1, np.int32)
        state = np.zeros(n, np.int64)
        for i in range(1, width + 1):
            live = np.flatnonzero(size >= i)
            open_, b = live, byte[i - 1]
            while len(open_):
                nxt = self.edges.get(state[open_] << 8 | b[open_])
                ok = (nxt >= 0) | (state[open_] == 0)
                state[open_] = np.where(ok, np.maximum(nxt, 0), self.fail[state[open_]])
                open_ = open_[~ok]
            open_, token = live, self.best[state[live]]
            while len(open_):
                if (token < 0).any():
                    raise ValueError("the vocabulary lacks a byte")
                start = i - self.size[token]
                ok = self.fit(last[start, open_].astype(np.int64), token)
                done = open_[ok]
                last[i, done], count[i, done] = token[ok], count[start[ok], done] + 1
                open_, token = open_[~ok], self.shorter[token[~ok]]
        return count.T

    def learn(self, pieces: set[str]) -> None:
        """Adds the changes of count after each character of every piece to the memo."""
        by: dict[int, list[tuple[str, bytes]]] = {}
        for p in sorted(pieces):
            b = p.encode("utf-8", "surrogatepass")
            by.setdefault(max(4, (len(b) - 1).bit_length()), []).append((p, b))
        for group in by.values():
            for lo in range(0, len(group), 1 << 15):
                some = group[lo : lo + (1 << 15)]
                counts = self.piece_counts([b for _, b in some])
                size = np.array([len(b) for _, b in some])
                flat = np.diff(counts, axis=1)[np.arange(counts.shape[1] - 1) < size[:, None]]
                starts = np.flatnonzero((np.frombuffer(b"".join(b for _, b in some), np.uint8) & 0xC0) != 0x80)
                d = np.add.reduceat(flat, starts)
                small, at = d.astype(np.int8).tobytes(), 0
                wide = np.abs(d).max() > 127
                for p, _ in some:
                    self.memo[p] = packed(d[at : at + len(p)]) if wide else small[at : at + len(p)]
                    at += len(p)
                self.wide |= bool(wide)
        for p in ("'re", "'ve", "'ll"):  # cut in the middle it is a quote and a letter
            if p in pieces:
                d = values(self.memo[p])
                self.memo[p] = packed(np.array([d[0], 2 - d[0], d.sum() - 2]))

    def prefixes(self, texts: list[str]) -> list[bytes]:
        """For each text, the change of the token count after each character."""
        parts = [self.split_special.split(t) if self.split_special and any(s in t for s in self.special) else [t] for t in texts]
        cut = [[self.pattern.findall(x) for x in p[::2]] for p in parts]
        if len(self.memo) > KEPT:
            self.memo.clear()
        spaces = []
        for part, group in zip(parts, cut):
            for text, pieces in zip(part[::2], group):
                if self.blanks.search(text):
                    spaces += [a + b[0] for a, b in zip(pieces, pieces[1:]) if self._touch(a, b)]
        new = {x for group in cut for pieces in group for x in pieces} | set(spaces)
        if new := {x for x in new if x not in self.memo}:
            self.learn(new)
        return [self._joined(p, c) for p, c in zip(parts, cut)]

    def _touch(self, a: str, b: str) -> bool:
        """White space before a piece that starts with white space: a text cut between has both in one piece."""
        return (a[0] <= " " or a[0] > "~") and bool(self.blank.fullmatch(a)) and bool(self.blank.match(b))

    def _plain(self, text: str, pieces: list[str]) -> bytes:
        memo = self.memo
        out = list(map(memo.__getitem__, pieces))
        if self.blanks.search(text):
            for i, (a, b) in enumerate(zip(pieces, pieces[1:])):
                if self._touch(a, b):
                    d = values(out[i + 1]).copy()
                    more = total(memo[a + b[0]]) - total(memo[a]) - d[0]
                    d[0] += more
                    if len(d) > 1:
                        d[1] -= more
                    else:  # the piece after takes the difference; a text can't end here
                        nxt = values(out[i + 2]).copy()
                        nxt[0] -= more
                        out[i + 2] = packed(nxt)
                    out[i + 1] = packed(d)
        return packed(np.concatenate([values(x) for x in out])) if self.wide and out else b"".join(out)

    def _joined(self, parts: list[str], cut: list[list[str]]) -> bytes:
        if len(cut) == 1:
            return self._plain(parts[0], cut[0])
        out = []
        for i, pieces in enumerate(cut):
            d = values(self._plain(parts[2 * i], pieces)).astype(np.int64)
            if i + 1 < len(cut):
                special, base = parts[2 * i + 1], parts[2 * i]
                ends = [int(values(self._whole(base + special[:j])).sum()) for j in range(1, len(special))]
                ends = [int(d.sum()), *ends, int(d.sum()) + 1]
                d = np.concatenate([d, np.diff(ends)])
            out.append(d)
        return packed(np.concatenate(out))

    def _whole(self, text: str) -> bytes:
        pieces = self.pattern.findall(text)
        new = set(pieces) | {a + b[0] for a, b in zip(pieces, pieces[1:]) if self._touch(a, b)}
        if new := {x for x in new if x not in self.memo}:
            self.learn(new)
        return self._plain(text, pieces)


WIDE = b"\x80"  # -128 as the first byte: 32-bit changes follow


def packed(d: np.ndarray) -> bytes:
    if len(d) and (d.max() > 127 or d.min() < -127):
        return WIDE + d.astype("<i4").tobytes()
    return d.astype(np.int8).tobytes()


def values(packed_: bytes) -> np.ndarray:
    if packed_[:1] == WIDE:
        return np.frombuffer(packed_, "<i4", offset=1).astype(np.int64)
    return np.frombuffer(packed_, np.int8).astype(np.int64)


def total(packed_: bytes) -> int:
    return int(values(packed_).sum()) if packed_[:1] == WIDE else int(np.frombuffer(packed_, np.int8).sum(dtype=np.int64))


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def prefix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens and ``prefixes``, the change of the token count after each character.

    ``vocabulary`` is the path of a byte-level BPE file of the tokenizers library, the same on every machine
    (default: the installed byte_bpe_50k.json). Special strings in a text are special tokens, as is that
    library's default; inside one, a prefix counts as ordinary text. A null text counts as empty: no bytes, no
    tokens. Repeated rows keep their rows; an empty table gives an empty result.
    """
    df = narrow(docs, doc_id=id_col, text=text_col)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary or public_tokenizers.path(VOCABULARY))
        for b in it:
            for lo in range(0, b.num_rows, TEXTS):
                ids, texts = b.column("doc_id").slice(lo, TEXTS), [t or "" for t in b.column("text").slice(lo, TEXTS).to_pylist()]
                out, some, size = [], [], 0
                for t in [*texts, None]:
                    if t is None or (size and size + len(t) > CHARS):
                        out += c.prefixes(some)
                        some, size = [], 0
                    if t is not None:
                        some.append(t)
                        size += len(t)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                     pa.array([total(p) for p in out], pa.int64()), pa.array(out, pa.binary())],
                    ["doc_id", "n_bytes", "n_tokens", "prefixes"])

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, prefixes binary")


def count_at(prefixes: Column, chars: Column) -> Column:
    """Exact tokens of the first ``chars`` characters."""
    def at(p: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([int(values(x)[: int(k)].sum()) for x, k in zip(p, n)], dtype="int64")

    return F.pandas_udf(at, "long")(prefixes, chars)


def longest_within(prefixes: Column, budget: Column) -> Column:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    def fit(p: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([int(np.flatnonzero(np.concatenate(([0], np.cumsum(values(x)))) <= k)[-1]) for x, k in zip(p, n)], dtype="int64")

    return F.pandas_udf(fit, "long")(prefixes, budget)


def over_limit(docs: DataFrame, limit: int = LIMIT, **columns: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, read off the last prefix."""
    return prefix_counts(docs, **columns).withColumn("over_limit", F.col("n_tokens") > limit)

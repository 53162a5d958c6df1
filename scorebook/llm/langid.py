"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter trigram is the product of its letters' vectors, each
rotated by its place; a text or a language is the sum of its trigrams' vectors, and a text belongs to the
language with the largest cosine. Vectors come from the seed and the code point alone, so tasks need no
shared table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorebook.llm.common import narrow, slices

DIM = 1024
SEED = 1013
#: Trigrams whose vectors a task keeps (64 MB of float32); when full, it starts anew.
KEPT = 16_384
SLOTS = 1 << 20
CHARS = 1 << 19
DOCS = 64
UNKNOWN = "und"


class Encoder:
    """Trigram codes to rows of a growing matrix of trigram vectors, and texts to sums of those rows."""

    def __init__(self, dim: int = DIM, seed: int = SEED):
        self.dim, self.seed = dim, seed
        self.alpha = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        self.letters: dict[int, np.ndarray] = {}
        self.clear()

    def clear(self) -> None:
        self.codes, self.rows = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, np.int32)
        self.aside: dict[int, int] = {}
        self.n, self.matrix = 0, np.zeros((1024, self.dim), np.float32)

    def letter(self, c: int) -> np.ndarray:
        if c not in self.letters:
            if len(self.letters) >= KEPT:
                self.letters.clear()
            self.letters[c] = np.random.default_rng([self.seed, c]).integers(0, 2, self.dim).astype(np.int8) * 2 - 1
        return self.letters[c]

    def _add(self, code: int) -> int:
        if self.n == len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
        a, b, c = code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF
        self.matrix[self.n] = np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)
        self.n += 1
        return self.n - 1

    def lookup(self, codes: np.ndarray) -> np.ndarray:
        """Rows of the codes; new ones are added. Codes whose slot is taken by another are kept aside."""
        with np.errstate(over="ignore"):
            slot = (codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)
        other = self.codes[slot] != codes
        rows = self.rows[slot]
        if other.any():
            new, back = np.unique(codes[other], return_inverse=True)
            found = np.empty(len(new), np.int32)
            for i, (code, s) in enumerate(zip(new.tolist(), (new.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).tolist())):
                if self.codes[s] == -1:
                    self.codes[s], self.rows[s] = code, self._add(code)
                    found[i] = self.rows[s]
                else:
                    if code not in self.aside:
                        self.aside[code] = self._add(code)
                    found[i] = self.aside[code]
            rows[other] = found[back]
        return rows

    def trigrams(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text number, trigram code) of all letter trigrams; anything but a letter counts as a word's edge."""
        texts = pc.fill_null(texts, "")
        lens = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        joined = "\n" + "\n".join(texts.to_pylist()) + "\n"
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(lens + 1)  # the edge after each text
        for lo in range(1, len(chars) - 1, CHARS):
            hi = min(lo + CHARS, len(chars) - 1)
            c = chars[lo - 1 : hi + 1]
            c = np.where(self.alpha[c], c, 0).astype(np.int64)
            at = np.flatnonzero(c[1:-1])
            yield np.searchsorted(ends, at + lo), (c[at] << 42) | (c[at + 1] << 21) | c[at + 2]

    def encode(self, texts: pa.Array) -> np.ndarray:
        """One vector per text."""
        out = np.zeros((len(texts), self.dim), np.float32)
        for doc, code in self.trigrams(texts):
            if not len(doc):
                continue
            if self.n > KEPT:
                self.clear()
            rows, first, width = self.lookup(code), doc[0], doc[-1] - doc[0] + 1
            counts = np.bincount((doc - first) * self.n + rows, minlength=width * self.n).reshape(width, self.n)
            used = np.flatnonzero(counts.any(axis=0))
            out[first : first + width] += counts[:, used].astype(np.float32) @ self.matrix[used]
        return out


def lowered(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for part in slices(batch):
        for lo in range(0, part.num_rows, DOCS):
            piece = part.slice(lo, DOCS)
            yield piece.set_column(piece.schema.get_field_index("text"), "text", pc.utf8_lower(piece.column("text")))


_ENCODERS: dict[tuple[int, int], Encoder] = {}


def encoder(dim: int, seed: int) -> Encoder:
    if (dim, seed) not in _ENCODERS:
        _ENCODERS[dim, seed] = Encoder(dim, seed)
    return _ENCODERS[dim, seed]


def profiles(docs: DataFrame, dim: int = DIM, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """Prototype of each non-null ``lang``: the sum of all its texts' vectors, whole numbers added in any order.

    The driver holds one vector per language.
    """
    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, total = encoder(dim, seed), {}
        for b in it:
            for part in lowered(b):
                vectors, langs = enc.encode(part.column("text")), np.array(part.column("lang").to_pylist(), object)
                for lang in set(langs.tolist()):
                    total[lang] = total.get(lang, 0) + np.rint(vectors[langs == lang]).astype(np.int64).sum(axis=0)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))], ["lang", "v"])

    rows = (docs.where(F.col("lang").isNotNull()).mapInArrow(sums, "lang string, v array<long>")
            .select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
            .groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select("lang", "v.x").collect())
    rows = sorted((r for r in rows if any(r.x)), key=lambda r: r.lang)
    m = np.array([r.x for r in rows], np.float64).reshape(len(rows), dim)
    return [r.lang for r in rows], (m / np.maximum(1e-300, np.linalg.norm(m, axis=1, keepdims=True))).astype(np.float32)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5,
             dim: int = DIM, seed: int = SEED) -> DataFrame:
    """doc_id, held_out, lang_pred, score: the nearest language of every whole text.

    Languages are learned from rows with a language whose crc32 of the id's text is not 0 modulo ``folds``;
    a null id counts as held out. The score is the cosine, 0 if negative. Null texts and texts without a
    letter are ``und`` with score 0, as is everything if nothing can be learned. Ties go to the language
    first in code point order; repeated rows keep their rows; an empty table gives an empty result.
    """
    df = narrow(docs, doc_id=id_col, text=text_col, lang=lang_col)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == 0
    names, vectors = profiles(df.where(~held).select("text", "lang"), dim, seed)

    def predict(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(dim, seed)
        for b in it:
            for part in lowered(b):
                v = enc.encode(part.column("text"))
                size = np.linalg.norm(v, axis=1)
                known = (size > 0) if names else np.zeros(len(v), bool)
                cos = v @ vectors.T / np.maximum(size, 1e-30)[:, None] if names else np.zeros((len(v), 1))
                best = cos.argmax(axis=1)
                lang = [names[i] if k else UNKNOWN for i, k in zip(best.tolist(), known.tolist())]
                score = np.where(known, np.clip(cos[np.arange(len(v)), best], 0, 1), 0).astype(np.float64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(score)],
                                                 ["doc_id", "held_out", "lang_pred", "score"])

    return df.select("doc_id", held.alias("held_out"), "text").mapInArrow(
        predict, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")

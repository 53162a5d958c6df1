"""Token ids in a binary file format: canonical, length-limited Huffman codes from global counts.

A file row is a chunk of consecutive documents: their ids and token counts, the bit stream of their tokens, and
the bit offset of every ``BLOCK``-th token, from which blocks decode on their own. One table lookup decodes a
token; all blocks of a chunk advance together. Chunks are written by Spark, in ascending order of ids.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scorebook.llm.common import narrow, slices, small_batches
from scorebook.llm.counts import byte_alphabet
from scorebook.session import fresh_path

VOCABULARY = "word_bpe_49k.json"
END = 2
#: Fixed value: the pattern by which the vocabulary's tokenizer cuts words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LONGEST = 16
BLOCK = 512
CHUNK = 1 << 18
#: Pieces and words whose ids a task keeps; of the first half, those that come again during the second stay.
KEPT = 200_000


def _path(vocabulary: str | None) -> str:
    return vocabulary or public_tokenizers.path(VOCABULARY)


def _distinct(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of all texts, the number of each text's words in a row, and the bounds of each text."""
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten().dictionary_encode()
    return words.dictionary, words.indices.to_numpy(), lists.offsets.to_numpy()


def _gathered(ids: np.ndarray, bounds: np.ndarray, part: np.ndarray, of_row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of rows made of parts, and the bounds of each row; ``bounds`` are those of the parts' ids."""
    n = np.diff(bounds)[part]
    ends = np.concatenate(([0], np.cumsum(n)))
    at = np.repeat(bounds[part] - ends[:-1], n)
    at += np.arange(ends[-1])
    return ids[at], ends[of_row]


class WordEncoder:
    """Ids of texts under a vocabulary in which white space only separates: every distinct piece is encoded once.

    Texts of ASCII and Latin-1 letters, which are the same in every normal form, are split into words by Arrow, the
    distinct words into pieces by the tokenizer's own pattern, and the library's model encodes each distinct piece; the
    ids of words and texts are then gathered at once. Words of other texts, and of any that could hold a special token,
    go through the whole tokenizer.
    """

    PLAIN = re.compile("[ -~\t-\r\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
    #: Matched within words in lower case.
    PIECE = "'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+"

    def __init__(self, path: str):
        self.tok, self.memo, self.older = Tokenizer.from_file(path), {}, {}
        self.model, self.plain = self.tok.model, self._known(json.loads(self.tok.to_str()))
        self.letters = str.maketrans({chr(b): c for b, c in enumerate(byte_alphabet()) if b > 126})
        self.dtype = "<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4"
        self.id_bytes = [i.tobytes() for i in np.arange(max(END, *self.tok.get_vocab().values()) + 1).astype(self.dtype)]

    @staticmethod
    def _known(spec: dict) -> bool:
        """Whether the tokenizer normalises and cuts words in the way the short cut knows."""
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        cut = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        return (steps == ["NFC", "Replace", "Lowercase"] and [c["type"] for c in cut] == ["Split", "ByteLevel"]
                and cut[0]["pattern"] == {"Regex": PATTERN} and not cut[1]["add_prefix_space"] and all(t["content"].startswith("<|") for t in spec["added_tokens"]))

    def _piece(self, piece: str) -> bytes:
        text = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.id_bytes[t.id] for t in self.model.tokenize(text)])

    def _ids(self, units: list, learn) -> list[bytes]:
        """Ids of distinct pieces or words; ``learn`` gives those of what is not kept."""
        out, older = [*map(self.memo.get, units)], self.older
        missing = [i for i, ids in enumerate(out) if ids is None]
        for i in missing:
            out[i] = older.get(units[i])
        new = [i for i in missing if out[i] is None]
        for i, ids in zip(new, learn([units[i] for i in new])):
            out[i] = ids
        self.memo.update([(units[i], out[i]) for i in missing])
        return out

    def _raw(self, words: list[bytes]) -> Iterator[bytes]:
        for lo in range(0, len(words), 4096):
            for e in self.tok.encode_batch_fast([w.decode("utf-8", "surrogatepass") for w in words[lo : lo + 4096]], add_special_tokens=False):
                yield b"".join([self.id_bytes[i] for i in e.ids])

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids of plain texts in lower case."""
        words, word, of_text = _distinct(pa.array(texts, pa.string()))
        pieces, piece, of_word = _distinct(pc.replace_substring_regex(words, self.PIECE, "\\0 "))
        each = self._ids(pieces.to_numpy(zero_copy_only=False).tolist(), lambda new: map(self._piece, new))
        bounds = np.cumsum([0, *map(len, each)]) // len(self.id_bytes[0])
        ids, bounds = _gathered(*_gathered(np.frombuffer(b"".join(each), self.dtype), bounds, piece, of_word), word, of_text)
        bounds = bounds.tolist()
        return [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.memo) > KEPT // 2:
            self.memo, self.older = {}, self.memo
        texts = [t or "" for t in texts]
        plain = [self.plain and "<|" not in t and bool(self.PLAIN.fullmatch(t)) for t in texts]
        short = iter(self._plain([t.lower() for t, p in zip(texts, plain) if p]))
        raw = [t.encode("utf-8", "surrogatepass").split() for t, p in zip(texts, plain) if not p]
        distinct = [*set().union(*raw)]
        ids = dict(zip(distinct, self._ids(distinct, self._raw)))
        whole = (b"".join(map(ids.__getitem__, words)) for words in raw)
        return [next(short if p else whole) + self.id_bytes[END] for p in plain]


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most ``longest`` bits (or what the number of symbols needs): package-merge."""
    used = np.flatnonzero(counts)
    lengths, n = np.zeros(len(counts), np.int64), len(used)
    if n < 2:
        lengths[used] = 1
        return lengths
    longest = max(longest, int(n - 1).bit_length())
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.int64)
    level, leaf = weights, [np.ones(n, bool)]
    for _ in range(longest - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        order = np.argsort(both, kind="stable")
        level = both[order]
        leaf.append(order < n)
    take = 2 * n - 2
    for is_leaf in reversed(leaf):
        leaves = int(is_leaf[:take].sum())
        lengths[used[:leaves]] += 1
        take = 2 * (take - leaves)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then symbol."""
    codes, code, before = np.zeros(len(lengths), np.int64), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for s in order[lengths[order] > 0].tolist():
        code <<= int(lengths[s]) - before
        codes[s], before = code, int(lengths[s])
        code += 1
    return codes


def write_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit stream of ``ids`` and the bit offset of every ``BLOCK``-th of them."""
    n = lengths[ids]
    ends = np.cumsum(n)
    at = ends - n
    word = codes[ids] << (32 - n - (at & 7))
    first, size = at >> 3, int(ends[-1] + 7 >> 3) if len(ids) else 0
    out = np.zeros(size + 4)
    for k in range(4):  # codes do not overlap, so adding is or-ing
        out += np.bincount(first + k, weights=word >> (24 - 8 * k) & 255, minlength=size + 4)[: size + 4]
    return out[:size].astype(np.uint8).tobytes(), at[::BLOCK].astype(np.int32)


class Decoder:
    def __init__(self, lengths: np.ndarray):
        self.width = max(1, int(lengths.max(initial=1)))
        codes = canonical_codes(lengths)
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        spans = 1 << (self.width - lengths[order])
        self.symbol, self.size = np.zeros(1 << self.width, np.int64), np.ones(1 << self.width, np.int64)
        full = int(spans.sum())
        assert not len(order) or codes[order[0]] == 0
        self.symbol[:full], self.size[:full] = np.repeat(order, spans), np.repeat(lengths[order], spans)

    def read(self, data: bytes, offsets: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` ids of a bit stream; all blocks advance one token at a time, the last block may be shorter."""
        bits = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(8, np.uint8)]).astype(np.int64)
        bits = bits[:-3] << 24 | bits[1:-2] << 16 | bits[2:-1] << 8 | bits[3:]
        out, pos = np.zeros((BLOCK, len(offsets)), np.int64), offsets.astype(np.int64)
        last = n - BLOCK * (len(offsets) - 1)
        for t in range(min(n, BLOCK)):
            if t == last:
                pos = pos[:-1]
            key = bits[pos >> 3] >> (32 - self.width - (pos & 7)) & ((1 << self.width) - 1)
            out[t, : len(pos)] = self.symbol[key]
            pos = pos + self.size[key]
        return out.T.ravel()[:n]


def tokenized(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, crc of the ids, ids (little-endian, two bytes each if the vocabulary allows)."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = word_encoder(_path(vocabulary))
        for b in it:
            for part in slices(b):
                pa.default_memory_pool().release_unused()  # what earlier slices, and other tasks of this worker, left
                ids = enc.encode(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                                                 ["doc_id", "crc", "ids"])

    return docs.mapInArrow(run, "doc_id long, crc long, ids binary")


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> np.ndarray:
    """Encodes every whole text, an end token after each, into files at ``path``; returns the code lengths.

    The driver holds one count per vocabulary id. Rows are range-partitioned by id and checksum of the tokens,
    so a part is a run of ids and a much repeated id can fill several parts.
    """
    spark = docs.sparkSession
    df = narrow(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tok = Tokenizer.from_file(_path(vocabulary))
    size, dtype = tok.get_vocab_size(), "<u2" if tok.get_vocab_size() <= 1 << 16 else "<u4"
    ids_path = fresh_path(spark, "token-ids")
    with small_batches(spark):
        tokenized(df, vocabulary).write.option("compression", "zstd").parquet(ids_path)
    ids = spark.read.schema("doc_id long, crc long, ids binary").parquet(ids_path)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in it:
            for lo in range(0, b.num_rows, 500):
                total += np.bincount(np.frombuffer(b"".join(b.column("ids").slice(lo, 500).to_pylist()), dtype), minlength=size)
        i = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(total[i])], ["id", "n"])

    counts = np.zeros(size, np.int64)
    with small_batches(spark):
        for r in ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
            counts[r.id] = r.n
    lengths = code_lengths(counts)

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, part, seq = canonical_codes(lengths), TaskContext.get().partitionId(), 0
        held_docs, held, tokens = [], [], 0

        def chunk() -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(held), dtype).astype(np.int64)
            data, offsets = write_bits(flat, codes, lengths)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([held_docs], pa.list_(pa.int64())),
                 pa.array([[len(h) // np.dtype(dtype).itemsize for h in held]], pa.list_(pa.int64())), pa.array([data], pa.binary()), pa.array([offsets], pa.list_(pa.int32()))],
                ["part", "seq", "docs", "tokens", "bits", "offsets"])

        for b in it:
            for doc, x in zip(b.column("doc_id").to_pylist(), b.column("ids")):
                held_docs.append(doc)
                held.append(x.as_py())
                tokens += len(held[-1])
                if tokens >= CHUNK * np.dtype(dtype).itemsize:
                    yield chunk()
                    held_docs, held, tokens, seq = [], [], 0, seq + 1
        if held:
            yield chunk()

    with small_batches(spark):
        (ids.repartitionByRange("doc_id", "crc").sortWithinPartitions("doc_id", "crc")
         .mapInArrow(encode, FILE).write.option("compression", "uncompressed").parquet(path))
    return lengths


FILE = "part int, seq long, docs array<long>, tokens array<long>, bits binary, offsets array<int>"


def read_tokens(spark: SparkSession, path: str, lengths: np.ndarray, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files; with ``ids`` if wanted."""
    files = spark.read.schema(FILE).parquet(path)

    def decode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(lengths)
        for b in it:
            for i in range(b.num_rows):
                part, seq, docs, tokens, bits, offsets = (b.column(c)[i] for c in ("part", "seq", "docs", "tokens", "bits", "offsets"))
                n = tokens.values.to_numpy()
                ends = np.cumsum(n)
                ids = decoder.read(bits.as_py(), offsets.values.to_numpy(), int(ends[-1])).astype("<u4")
                each = [ids[a:e] for a, e in zip((ends - n).tolist(), ends.tolist())]
                cols = [pa.array(np.full(len(n), part.as_py(), np.int32)), pa.array(np.full(len(n), seq.as_py())), docs.values, pa.array(ends - n), pa.array(n),
                        pa.array([zlib.crc32(e.tobytes()) for e in each], pa.int64())]
                names = ["part", "seq", "doc_id", "before", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array(each, pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    chunks = files.select("part", "seq", F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    parts = chunks.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    starts = (chunks.withColumn("chunk_start", F.sum("n").over(Window.partitionBy("part").orderBy("seq")) - F.col("n")).join(parts, "part")
              .select("part", "seq", (F.col("part_start") + F.col("chunk_start")).alias("chunk_start")))
    rows = files.mapInArrow(decode, "part int, seq long, doc_id long, before long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))
    return rows.join(starts, ["part", "seq"]).select("doc_id", (F.col("chunk_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def round_trip(docs: DataFrame, **columns: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document after writing all files and reading them back.

    A null text counts as empty: its only token is the end token. Rows with the same id follow each other in
    order of their tokens' checksum; null ids come first. An empty table gives empty files and no rows.
    """
    path = fresh_path(docs.sparkSession, "token-files")
    lengths = write_tokens(docs, path, **columns)
    return read_tokens(docs.sparkSession, path, lengths)

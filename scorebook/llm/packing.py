"""Packing of documents into sequences of fixed length by minimum bin slack.

Documents become pieces of at most ``LENGTH`` tokens; only longer ones are cut. What can be put together depends
on the pieces' lengths alone, so the plan is made from how many pieces of each length there are, ``LENGTH``
numbers at most whatever the corpus. A sequence is begun with the longest piece left; a subset-sum program over
the available lengths, one bit a sum, finds the fullest combination that fits beside it. The combination is used
as often as the pieces last, and what it used is removed.

Pieces are numbered within their length without gathering a length anywhere: by their place in the task that
made them, plus the number of such pieces in the tasks before. Number and length give the place in the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorebook.llm.common import narrow, slices, staged
from scorebook.llm.tokens import _path, word_encoder

LENGTH = 2048
END = 0
#: Bytes of text encoded at once.
SLICE = 1 << 20


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many pieces of each available length together fill most of ``room``; long pieces are taken where there is a choice.

    Bit s of the sums is set if some of the lengths seen so far add up to s. Several pieces of a length enter as
    one, two, four, ... of them, so the steps grow with the logarithm of their number.
    """
    sums, steps, mask = 1, [], (1 << room + 1) - 1
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left:
            k = min(k, left)
            steps.append((length, k, sums))
            sums |= sums << k * length & mask
            left, k = left - k, 2 * k
        if sums >> room & 1:
            break
    best, taken = sums.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> best & 1:
            taken[length] = taken.get(length, 0) + k
            best -= k * length
    return taken


def plan(counts: dict[int, int], length: int = LENGTH) -> list[tuple[dict[int, int], int]]:
    """Combinations of lengths and how many sequences each fills; uses every piece exactly once."""
    left, out = {n: c for n, c in counts.items() if c}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        taken = fullest({n: c for n, c in left.items() if c}, length - longest)
        left[longest] += 1
        taken[longest] = taken.get(longest, 0) + 1
        times = min(left[n] // k for n, k in taken.items())
        for n, k in taken.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        out.append((taken, times))
    return out


class Slots:
    """Where the i-th piece of a length goes."""

    def __init__(self, combinations: list[tuple[dict[int, int], int]]):
        rows, used, sequence = [], {}, 0
        for taken, times in combinations:
            offset = 0
            for n in sorted(taken, reverse=True):
                first = used.get(n, 0)
                rows.append((n, first, times, sequence, offset))
                used[n] = first + taken[n] * times
                offset += taken[n] * n
            sequence += times
        rows.sort()
        self.length, self.first, self.times, self.sequence, self.offset = np.array(rows, np.int64).reshape(-1, 5).T
        self.key, self.sequences = self.length << 44 | self.first, sequence

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces ``number`` (from 0) of their lengths."""
        at = np.searchsorted(self.key, length << 44 | number, side="right") - 1
        k = number - self.first[at]
        return self.sequence[at] + k % self.times[at], self.offset[at] + k // self.times[at] * length


def pieces(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of every (doc_id, text), the end token after each document; task and seq number those of a length."""
    fields = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, task int, seq long"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, seen = word_encoder(_path(vocabulary)), TaskContext.get().partitionId(), np.zeros(length + 1, np.int64)
        for b in it:
            for part in slices(b, limit=SLICE):
                row, piece, start, size, seq, crc, kept = [], [], [], [], [], [], []
                for i, x in enumerate(enc.encode(part.column("text").to_pylist())):
                    ids = np.frombuffer(x, enc.dtype).astype("<u4")
                    ids[-1] = END
                    for k, at in enumerate(range(0, len(ids), length)):
                        data = ids[at : at + length].tobytes()
                        n = len(data) // 4
                        row.append(i)
                        piece.append(k)
                        start.append(at)
                        size.append(n)
                        seq.append(seen[n])
                        seen[n] += 1
                        crc.append(zlib.crc32(data))
                        if with_ids:
                            kept.append(data)
                cols = [part.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, size, crc)),
                        pa.array([task] * len(row), pa.int32()), pa.array(seq, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "seq"]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(kept, pa.binary())] if with_ids else cols, [*names, "ids"] if with_ids else names)

    return docs.mapInArrow(run, fields + (", ids binary" if with_ids else ""))


def pack(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece; with ``ids`` (four bytes each) if wanted.

    A null or blank text is one piece, the end token. Rows of one id, or without one, are documents of their own.
    An empty table gives an empty result.
    """
    made = staged(pieces(narrow(docs, doc_id=id_col, text=text_col), length, vocabulary, with_ids), "pack-pieces")
    per_task = staged(made.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "pack-lengths")
    combinations = plan({r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}, length)
    # A length runs out or nearly so with every combination, so these rows are some times ``length``, not of the corpus.
    slots = docs.sparkSession.sparkContext.broadcast(Slots(combinations))
    before = per_task.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    numbered = made.join(before, ["length", "task"]).withColumn("number", F.col("before") + F.col("seq"))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
    last = ["ids"] if with_ids else []

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sequence, offset = slots.value.place(b.column("length").to_numpy(), b.column("number").to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(sequence), pa.array(offset), *(b.column(c) for c in last)],
                                             [*kept, "sequence_id", "offset", *last])

    fields = ", ".join(f"{c} {made.schema[c].dataType.simpleString()}" for c in kept)
    return numbered.select(*kept, "number", *last).mapInArrow(run, f"{fields}, sequence_id long, offset long" + (", ids binary" if with_ids else ""))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids (four bytes each) of every sequence of ``pack(..., with_ids=True)``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))

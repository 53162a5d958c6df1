import itertools
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scorebook.llm import packing, queries

SF = "/root/testdata/sf0.01"


def brute_pieces(docs, length):
    """(doc_id, piece, start, length, crc) of every document by the library alone."""
    tok, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for i, text in docs:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out += [(i, k, at, len(ids[at : at + length]), zlib.crc32(ids[at : at + length].tobytes())) for k, at in enumerate(range(0, len(ids), length))]
    return out


def best_fit(sizes, length):
    bins = []
    for n in sorted(sizes, reverse=True):
        fits = [i for i, b in enumerate(bins) if b >= n]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= n
        else:
            bins.append(length - n)
    return len(bins)


def check_packing(rows, length):
    """Sequences are gapless from 0 and within the length; returns how many there are."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in by.values():
        items.sort()
        ends = np.cumsum([n for _, n in items])
        assert [o for o, _ in items] == [0, *ends[:-1].tolist()] and ends[-1] <= length
    return len(by)


def test_fullest_combination():
    rng = random.Random(5)
    for _ in range(200):
        counts = {rng.randrange(1, 25): rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))}
        room = rng.randrange(60)
        got = packing.fullest(counts, room)
        sums = {sum(n * k for n, k in zip(counts, ks)) for ks in itertools.product(*[range(c + 1) for c in counts.values()])}
        assert sum(n * k for n, k in got.items()) == max(s for s in sums if s <= room)
        assert all(0 < k <= counts[n] for n, k in got.items())


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_and_few_sequences(seed):
    rng = random.Random(seed)
    sizes = [min(2048, 1 + int(rng.lognormvariate(5, 1.2))) for _ in range(rng.choice([30, 400, 3000]))] + [2048] * 3 + [700] * rng.choice([0, 900])
    counts = {n: sizes.count(n) for n in set(sizes)}
    combos = packing.plan(counts)
    used = {}
    for taken, times in combos:
        assert times > 0 and sum(n * k for n, k in taken.items()) <= 2048
        for n, k in taken.items():
            used[n] = used.get(n, 0) + k * times
    assert used == counts
    total = sum(t for _, t in combos)
    assert -(-sum(sizes) // 2048) <= total <= best_fit(sizes, 2048) + 1  # neither rule is always the better one
    slots = packing.Slots(combos)
    assert slots.sequences == total
    places = {(int(q), int(o)) for n, c in counts.items() for q, o in zip(*slots.place(np.full(c, n), np.arange(c)))}
    assert len(places) == len(sizes) and {q for q, _ in places} == set(range(total))


def test_a_plan_does_not_grow_with_the_corpus():
    rng = random.Random(1)
    few = {n: rng.randrange(1, 50) for n in range(1, 2049)}
    many = {n: c * 10**7 + rng.randrange(1000) for n, c in few.items()}
    a, b = packing.plan(few), packing.plan(many)
    assert len(b) < 3 * len(a) + 4096
    assert sum(t for _, t in b) <= 1.02 * sum(n * c for n, c in many.items()) / 2048


def test_pieces_and_places(spark):
    rng = random.Random(2)
    words = "the house tree big small runs walked über 1999 don't".split()
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 20, 40, 130])))) for i in range(300)] + [(7, "the same text"), (7, "the same text"), (None, None), (None, "x"), (9, " ")]
    docs += [(i, "hot text of one length") for i in range(1000, 1400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    rows = packing.pack(df, 64, with_ids=True)
    got = rows.collect()
    key = lambda r: str(r)
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(brute_pieces(docs, 64), key=key)
    n = check_packing(got, 64)
    assert n <= best_fit([r.length for r in got], 64)
    whole = packing.sequences(rows).collect()
    assert len(whole) == n and all(r.n_tokens * 4 == len(r.ids) for r in whole)
    first = {r.sequence_id: r.ids for r in whole}
    assert all(zlib.crc32(bytes(first[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)])) == r.ids_crc32 for r in got)


def test_edge_cases(spark, tricky, nothing):
    got = packing.pack(tricky).collect()
    rows = [(r.doc_id, r.text) for r in tricky.collect()]
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, brute_pieces(rows, 2048)))
    check_packing(got, 2048)
    assert max(r.piece for r in got) > 10
    assert packing.pack(nothing).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_query_against_the_library(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.QUERIES["op13_best_fit_packing"](spark, SF)
    rows = got.collect()
    assert sorted(tuple(r)[:5] for r in rows) == sorted(brute_pieces(docs, 2048))
    total = sum(r.length for r in rows)
    assert check_packing(rows, 2048) <= -(-total // 2048) + 1
    assert got.agg(F.countDistinct("sequence_id")).first()[0] >= -(-total // 2048)

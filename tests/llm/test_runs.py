import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest

from scorebook.llm import queries, runs

SF = "/root/testdata/sf0.01"


def brute_runs(w):
    """All runs by trying every period."""
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            j = i
            while j < n and w[j] == w[j - q]:
                j += 1
            if j - (i - q) >= max(6, 4 * q):
                out.append((i - q, j - i + q, q))
            i = j
    smallest = lambda a, n, q: not any(all(w[x] == w[x - p] for x in range(a + p, a + n)) for p in range(1, q) if q % p == 0)
    return sorted((r for r in out if smallest(*r)), key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {i for a, length, q in found for i in range(a + q, a + length)}
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *head, sha("".join("%d,%d,%d\n" % r for r in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def repetitive(rng):
    """Words of a small alphabet, periodic stretches of all periods laid next to and into each other."""
    w = []
    while len(w) < 150:
        base = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.choice([1, 1, 2, 3, 4, 5, 7, 8, 9, 12, 16, 17]))]
        w += base * rng.choice([1, 2, 3, 4, 5, 9]) + base[: rng.randrange(len(base) + 1)]
        if rng.random() < 0.2:
            w[rng.randrange(len(w))] = 99
    return w


@pytest.mark.parametrize("step", [1, 3, 1000])
def test_catchers_against_every_period(step):
    """Words appended one by one, a few at a time, or all at once give the same runs."""
    rng = random.Random(step)
    for _ in range(60 if step > 1 else 25):
        w = repetitive(rng)
        c = runs.Catchers()
        for lo in range(0, len(w), step):
            c.append(np.array(w[lo : lo + step]))
        assert c.finish() == brute_runs(w)


def test_runs_are_known_while_the_stream_grows():
    w, c = [5, 6, 7] + [1, 2, 3] * 6, runs.Catchers()
    for i, x in enumerate(w):
        c.append(np.array([x]))
        assert (3 in c.open) == (i >= 10)  # by the catcher over words 4 to 7, which come again as 7 to 10
    assert c.open[3] == (3, 21) and c.runs == []
    c.append(np.array([9]))
    assert c.runs == [(3, 18, 3)] and not c.open


def test_equal_hashes_change_nothing(monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(runs, "_mixed", lambda x: x & np.uint64(1))
    for step in (5, 1000):
        for _ in range(10):
            w = repetitive(rng)
            c = runs.Catchers()
            for lo in range(0, len(w), step):
                c.append(np.array(w[lo : lo + step]))
            assert c.finish() == brute_runs(w)


def test_streams_of_texts(monkeypatch):
    monkeypatch.setattr(runs, "APPEND", 64)
    monkeypatch.setattr(runs, "PIECE", 16)
    rng = random.Random(9)
    lists = [[f"w{x}" for x in repetitive(rng)[: rng.randrange(150)]] for _ in range(40)] + [[], ["a"] * 6, ["a"] * 6, ["b c"] * 4]
    texts = [" ".join(w).encode() for w in lists]
    found, sizes = runs.text_runs(texts)
    assert found == [brute_runs(t.decode().split()) for t in texts] and sizes == [len(t.split()) for t in texts]


def test_state_is_of_the_order_of_the_longest_block():
    c = runs.Catchers(longest=64)
    for k in range(50):
        c.append(np.arange(1000) + 1000 * k)
    assert len(c.levels) == 6 and all(len(v.hash) <= 2 * v.size for v in c.levels)


def test_rows_against_brute_force(spark, tricky, nothing):
    rng = random.Random(2)
    docs = [(i, " ".join(f"w{x}" for x in repetitive(rng))) for i in range(100)] + [(r.doc_id, r.text if r.doc_id != 8 else None) for r in tricky.collect()]
    docs += [(28, "x y z " * 30), (28, "x y z " * 30), (None, "na " * 8), (55, "only"), (57, "  " * 7)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = runs.digests(runs.periodic_runs(runs.with_periodic_tails(df))).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(brute_row(*d)) for d in docs)
    plain = runs.periodic_runs(tricky)
    assert plain.count() == tricky.count() and plain.where("doc_id = 8").first().n_words == 30_000
    assert runs.digests(runs.periodic_runs(nothing)).count() == 0


def test_a_very_long_text():
    words = ["w%d" % (i * i % 7919) for i in range(200_000)]
    words[50_000:90_000] = [f"p{i % 9000}" for i in range(40_000)]
    found, _ = runs.text_runs([" ".join(words).encode()])
    assert [r for r in found[0] if r[2] == 9000] == [(50_000, 40_000, 9000)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r.text or "") < 6000]
    got = {r.doc_id: tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert [got[i] for i, _ in docs] == [brute_row(i, t) for i, t in docs]

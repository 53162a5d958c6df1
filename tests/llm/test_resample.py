import hashlib
import math
import os
import random
import re
import zlib

import pyarrow as pa
import pytest

from scorebook.llm import queries, resample

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return len(w), [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, target, percent=5):
    """(doc_id, n_features, weight, score, rank) of every (doc_id, text), sorted."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    feats = [(i, *brute_features(t)) for i, t in docs]
    s, t = [0] * 10_000, [0] * 10_000
    for _, _, fs in feats:
        for f in fs:
            s[bucket(f)] += 1
    for text in target:
        for f in brute_features(text)[1]:
            t[bucket(f)] += 1
    all_s, all_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (all_s + 10_000) / ((a + 1) * (all_t + 10_000)))) for a, b in zip(s, t)]
    rows = []
    for i, n, fs in feats:
        weight = sum(gain[bucket(f)] for f in fs)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    won = able[: percent * len(able) // 100]
    out = [(*r[:4], n) for n, r in enumerate(won, 1)]
    for r in won:
        rows.remove(r)
    return order(out + [(*r[:4], None) for r in rows])


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((v is not None, v or 0) for v in r))


def test_checksums_of_runs(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aB9é日 -\n_x") for _ in range(rng.randrange(60))) for _ in range(200)]
    texts += [None, "", "a", "a b", "a b c", "q" * 1000 + " b " + "é" * 300, "x" * 64, "x" * 65 + " " + "y" * 63, "\x7f\x00", "A_b"]
    bucket, text, words = resample.features(pa.array(texts))
    for i, t in enumerate(texts):
        n, fs = brute_features(t)
        assert words[i] == n and sorted(bucket[text == i].tolist()) == sorted(zlib.crc32(f.encode()) % 10_000 for f in fs)


@pytest.mark.parametrize("n, part, rest", [(1000, 7, 1), (1000, 64, 30), (50, 3, 1)])
def test_cutoff_is_exact(spark, n, part, rest):
    """Few different scores, so that ties and equal keys occur; every k next to the ends and some between."""
    rng = random.Random(n + part)
    keys = [(rng.randrange(-5, 5), rng.random() < 0.1, rng.randrange(30), rng.randrange(2)) for _ in range(n)]
    df = resample.staged(spark.createDataFrame(keys, "a long, b boolean, c long, d long").repartition(3), "keys")
    keys.sort()
    for k in (1, n // 3, n):
        assert resample.cutoff(df, k, part, rest) == keys[k - 1]
    assert resample.cutoff(df, 0) is None and resample.cutoff(df, n + 1) is None


def test_draw_against_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    docs = [(i // 2 if i < 100 else i, " ".join(rng.choices(words, k=rng.randrange(15, 60)))) for i in range(600)]
    docs += [(7, "same words " * 12)] * 40 + [(None, "no id here " * 9)] * 30
    target = [" ".join(rng.choices(words[:40], k=80)) for _ in range(20)] + [None, ""]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    for percent in (5, 60):
        got = resample.resample(df, goal, percent, part=16, rest=8)
        assert order(got.collect()) == brute(docs, target, percent)
        assert sorted(r["rank"] for r in got.collect() if r["rank"]) == list(range(1, percent * sum(len(brute_features(t)[1]) >= 57 for _, t in docs) // 100 + 1))


def test_resample_edge_cases(spark, tricky, nothing):
    rows = [(r.doc_id, r.text) for r in tricky.collect()]
    got = resample.resample(tricky, tricky)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert order(got.collect()) == brute(rows, [t for _, t in rows])
    assert order(resample.resample(tricky, nothing).collect()) == brute(rows, [])
    assert resample.resample(nothing, tricky).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_query_against_brute_force(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{n}.parquet").collect() for n in ("documents", "benchmark"))
    got = queries.QUERIES["op11_importance_resampling"](spark, SF).collect()
    assert order(got) == brute([(r.doc_id, r.text) for r in docs], [r.text for r in bench])

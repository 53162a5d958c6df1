import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from scorebook.llm import decontam, simhash, spans


def brute_repeats(rows):
    """rows: (id, text) with distinct (id, text)."""
    words = [(d, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for d, t in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            first[k] = min(first.get(k, (d, i)), (d, i))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - 19):
            if first[tuple(w[i : i + 20])] < (d, i):
                gone.update(range(i, i + 20))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_repeats_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(40)]
    passages = [[rng.choice(vocab) for _ in range(n)] for n in (19, 20, 21, 27, 35, 60)]
    rows = []
    for i in range(160):
        w = []
        for _ in range(rng.randrange(5)):
            w += [rng.choice(vocab) for _ in range(rng.randrange(30))]
            p = rng.choice(passages)
            a = rng.randrange(4)
            w += p[a:] if rng.random() < 0.5 else p
        rows.append((i - 20, rng.choice([" ", "\n", " \t "]).join(w)))
    rows += [(500, "a " * 100), (501, "a b " * 50), (502, "a b c " * 11 + "a b"), (503, None), (504, " "), (505, rows[3][1])]
    monkeypatch.setattr(spans, "MANY", 2)  # deals many anchors out by factor
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in spans.remove_repeats(df).collect())
    assert got == brute_repeats(rows)


def test_repeats_edge_cases(spark, tricky, nothing):
    got = spans.remove_repeats(tricky).collect()
    assert len(got) == tricky.count()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_words, r.n_removed))
    assert by[2] == [(60, 60), (60, 60)] and by[4] == by[5] == by[6] == [(0, 0)]
    assert sorted(by[None]) == [(40, 0), (40, 0)] and by[100] == [(61, 60)]
    assert {r.kept_sha256 for r in got if r.doc_id == 4} == {hashlib.sha256(b"").hexdigest()}
    assert spans.remove_repeats(nothing).count() == 0


def brute_groups(fps, ids):
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= 2:
                up[find(a)] = find(b)
    least = {}
    for a, i in enumerate(ids):
        least[find(a)] = min(least.get(find(a), i), i)
    return {i: least[find(a)] for a, i in enumerate(ids)}


def test_covering_masks_cover_every_pair_of_bits():
    masks = simhash.covering_masks()
    for i in range(64):
        for j in range(64):
            assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


def test_links_against_brute_force(spark):
    rng = random.Random(2)
    fps = {rng.getrandbits(64) for _ in range(30)}
    for _ in range(400):  # tight clusters and chains
        x = rng.choice(sorted(fps))
        for _ in range(rng.randrange(1, 4)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    prints = spark.createDataFrame(list(zip(range(len(fps)), signed)), "doc_id long, fp long")
    got = {r.fp: r.component_id for r in simhash.labels(prints).collect()}
    assert {i: got[s] for i, s in enumerate(signed)} == brute_groups(fps, list(range(len(fps))))


def test_fingerprint_is_spark_xxhash64(spark):
    text = "One two  three\nFOUR five é"
    words = "one two three four five é".split()
    rows = spark.createDataFrame([(" ".join(words[i : i + 3]),) for i in range(4)], "s string").select(F.xxhash64("s")).collect()
    bits = sum((np.array([r[0] >> b & 1 for r in rows]).sum() * 2 > 4) << b for b in range(64))
    assert simhash.fingerprint(text) == int(bits)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("A b") == simhash.fingerprint("a\tB") != 0


def test_near_duplicates_edge_cases(spark, tricky, nothing):
    rows = simhash.near_duplicates(tricky).collect()
    assert len(rows) == tricky.count()
    by = {(r.doc_id, r.fingerprint): r.component_id for r in rows}
    assert {by[k] for k in by if k[0] in (4, 5, 6)} == {4}
    assert {by[k] for k in by if k[0] in (1, 2)} == {1}
    assert {by[k] for k in by if k[0] is None} == {None}
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.representatives(tricky)
    assert kept.columns == tricky.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 1 and 2 not in ids and {1, 3, 4, 8, 200} <= set(ids) and 5 not in ids
    assert simhash.representatives(nothing).count() == 0


def edits(item, text):
    """Fewest edits turning the item into a run of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(6)
    letters = "abcdeé "
    items = [(i, "".join(rng.choice(letters) for _ in range(n))) for i, n in enumerate((5, 9, 10, 30, 45, 90, 120, 120))]
    items.append((20, items[5][1]))
    docs = []
    for i in range(80):
        t = list(rng.choice(items)[1])
        for _ in range(rng.randrange(8)):
            p = rng.randrange(len(t) + 1)
            t[p : p + rng.randrange(2)] = rng.choice(["", "x", "yz"])
        pad = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        docs.append((i, pad() + "".join(t) + pad()))
    docs += [(90, None), (91, ""), (92, items[4][1].upper() * 3), (93, items[6][1] + items[3][1])]
    index = decontam.Items([i for i, _ in items], [t for _, t in items])
    most = dict(zip(index.ids, index.edits.tolist()))
    want = [(d, sorted(i for i, x in items if edits(x.lower(), (t or "").lower()) <= most[i]) + ([None] if "abc" in (t or "").lower() else [])) for d, t in docs]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (None, "abc"), (77, None), (78, "")], "item_id long, text string")
    for limit in (decontam.BLOCK_BYTES, 200):  # one block, several blocks
        got = sorted((r.doc_id, r["items"]) for r in decontam.contamination(df, bench, limit=limit).collect())
        assert got == want
    assert sum(bool(x) for _, x in want) > 30 and sum(x == [None] for _, x in want) > 0  # an item without an id counts too


def test_decontamination_edge_cases(spark, tricky, nothing):
    bench = spark.createDataFrame([(1, tricky.where("doc_id = 1").first().text), (2, "x")], "item_id long, text string")
    kept = decontam.decontaminate(tricky, bench)
    assert kept.columns == tricky.columns
    left = [r.doc_id for r in kept.collect()]
    assert not {1, 2, 9, 100} & {i for i in left if i not in (9,)} and left.count(9) == 1 and {4, 5, 6} <= set(left)
    assert decontam.decontaminate(tricky, bench.limit(0)).count() == tricky.count()
    assert decontam.contamination(nothing, bench).count() == 0

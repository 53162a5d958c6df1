import random

import numpy as np
import pytest

import corpus_pipeline
from brute import brute_least, brute_pairs
from scorebook.llm import neardup, simhash


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        words[at : at + rng.randrange(2)] = rng.choice([[], ["x%d" % rng.randrange(10**6)], ["y", "z"]])
    return words


def corpus(rng):
    """Near copies at all similarities about 0.8, one large family with stragglers, a passage in many texts, short and blank texts."""
    fresh = lambda n: ["w%d" % rng.randrange(3000) for _ in range(n)]
    passage, texts = fresh(30), []
    for _ in range(60):
        base = fresh(rng.choice([6, 12, 40, 90, 200]))
        texts += [base] + [edited(rng, base, rng.randrange(1 + len(base) // 20 + 1)) for _ in range(rng.randrange(4))]
    family = fresh(80)
    texts += [edited(rng, family, rng.randrange(8)) for _ in range(90)]
    texts += [fresh(rng.randrange(40)) + passage + fresh(rng.randrange(40)) for _ in range(60)]
    texts += [["a"], ["A"], ["a", "b"], ["a", "b", "c", "d", "e"], ["a", "b", "c", "d", "e", "f"], [], []]
    texts = [rng.choice([" ", "\n", " \t"]).join(t) for t in texts] + [None, texts[0] and " ".join(texts[0]).upper()]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("many, common", [(64, 16), (2, 2), (8, 10**9)])
def test_groups_against_brute_force(spark, monkeypatch, many, common):
    monkeypatch.setattr(neardup, "MANY", many)
    monkeypatch.setattr(neardup, "COMMON", common)
    texts = corpus(random.Random(many))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()}
    assert got == dict(enumerate(brute_least(texts)))


def test_every_pair_is_met(spark):
    """Pairs taken one by one, so that no other text can join the two: similarities at and just below 0.8 included."""
    rng = random.Random(8)
    texts = []
    for i in range(150):
        base = ["p%dq%d" % (i, j) for j in range(rng.choice([9, 13, 49, 120]))]
        texts += [" ".join(base), " ".join(edited(rng, base, rng.randrange(1, 2 + len(base) // 25)))]
    base = ["r%d" % j for j in range(13)]  # 9 shingles; one word more at the end: 9 of 10; two and three: 9 of 11, 9 of 12
    texts += [" ".join(base), " ".join([*base, "s", "t"])]
    want = brute_pairs(texts)
    assert 30 < len(want) < 140 and (300, 301) in want
    got = {r.doc_id: r.root for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {(b, a) for a in got for b in range(a) if got[a] == got[b]} == want


def test_stage_drops_what_radius_two_keeps(spark):
    base = ["w%d" % i for i in range(100)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:50], "new", *base[51:]])), (3, " ".join(base[50:] + base[:50])), (4, " ".join(base[:70]))]
    assert bin(simhash.fingerprint(rows[0][1]) ^ simhash.fingerprint(rows[1][1])).count("1") > simhash.RADIUS
    kept = corpus_pipeline.one_of_each_group(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4]


def test_stage_links_fingerprints_too(spark):
    """Texts whose repeated part outweighs their ends: fingerprints within two bits, sets of shingles far from 0.8."""
    base = ["w%d" % i for i in range(21)] * 60  # an odd number of shingles: no bit is a tie
    texts = [" ".join(base + ["%s%d" % (c, i) for i in range(12)]) for c in "abc"] + ["something else altogether that is here"]
    assert not brute_pairs(texts)
    assert all(bin(simhash.fingerprint(texts[0]) ^ simhash.fingerprint(t)).count("1") <= simhash.RADIUS for t in texts[:3])
    near = " ".join((base + ["c%d" % i for i in range(12)])[1:])  # linked to the third by its shingles
    docs = spark.createDataFrame([*enumerate([*texts, near, None, " "], 1)], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()) == [1, 4, 6]
    assert sorted(r.doc_id for r in neardup.representatives(docs).collect()) == [1, 2, 3, 4, 6]


def test_stage_edge_cases(spark, tricky, nothing):
    kept = neardup.representatives(tricky)
    assert kept.columns == tricky.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 1 and not {2, 5, 6, 100} & set(ids) and {1, 3, 4, 8, 200} <= set(ids) and ids.count(9) == 2
    assert neardup.representatives(nothing).count() == 0


def test_sketches_never_lose_a_pair():
    rng = random.Random(6)
    for _ in range(300):
        n = rng.choice([1, 2, 3, 5, 17, 64, 65, 300])
        a = np.unique(np.array([rng.randrange(1 << 58) for _ in range(n)]))
        b = np.unique(np.concatenate([a[: rng.randrange(len(a) + 1)], np.array([rng.randrange(1 << 58) for _ in range(rng.randrange(1, n + 1))])]))
        assert neardup.most_common(neardup._sketch(a), neardup._sketch(b)) >= len(np.intersect1d(a, b))
    far = [np.array([rng.randrange(1 << 58) for _ in range(500)]) for _ in range(2)]
    assert neardup.most_common(*map(neardup._sketch, far)) < 400
    same = np.arange(400) << 20
    assert neardup.most_common(neardup._sketch(same), neardup._sketch(same)) > 400  # too many in one place: no bound

import heapq
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from brute import brute_least
from scorebook.llm import counts, decontam, mixing, quality, tokens
from scorebook.llm.common import SLICE_BYTES, small_batches

SF = "/root/testdata/sf0.001"


def brute_seats(shares, seats):
    got = [0] * len(shares)
    heap = [(-s / 1, i) for i, s in enumerate(shares) if s > 0]
    heapq.heapify(heap)
    for _ in range(seats if heap else 0):
        _, i = heapq.heappop(heap)
        got[i] += 1
        heapq.heappush(heap, (-shares[i] / (2 * got[i] + 1), i))
    return got


def test_apportionment_against_highest_quotients(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for g in range(12):
        shares = [rng.choice([0, 1, 5, 5, 1000, rng.randrange(10_000)]) for _ in range(rng.randrange(1, 40))]
        seats = rng.randrange(300) if any(shares) else 0
        rows += [(g, i, s, seats) for i, s in enumerate(shares)]
        want |= {(g, i): q for i, q in enumerate(brute_seats(shares, seats))}
    df = spark.createDataFrame(rows, "g int, k int, share long, seats long")
    got = {(r.g, r.k): r.quota for r in mixing.sainte_lague(df, ["g"], "k", "share", "seats").collect()}
    assert got == want


def test_mix_meets_targets(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(["w"] * rng.randrange(40)), f"s{rng.choice('aaaaaabbc')}", i) for i in range(1500)] + [(2000, "only", "z", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, n_chars long").repartition(3)
    rows = mixing.mix(df, docs_per_shard=100).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in mixing.mix(df.repartition(2), docs_per_shard=100).collect())
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    by = {}
    for r in rows:
        s = by.setdefault(r.source, [0, r.source_size, r.target, 0])
        s[0] += r.taken
        s[3] += r.size
    total = sum(s[1] for s in by.values())
    assert sum(s[2] for s in by.values()) == pytest.approx(total)
    for taken, size, target, seen in by.values():
        assert seen == size and target <= 3 * size and abs(taken - target) <= max(2, 0.01 * target)
    out = mixing.mixed(df, docs_per_shard=100)
    words = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.sum(F.size(F.split("text", " +"))).alias("n")).collect()}
    assert words == {r.doc_id: r.taken for r in mixing.mix(df, docs_per_shard=100).collect() if r.taken}
    assert out.columns == df.columns and out.where("n_chars <> length(text)").count() == 0


def test_mix_edge_cases(spark, tricky, nothing):
    rows = mixing.mix(tricky).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert len(rows) == tricky.count() and {(r.size, r.taken) for r in rows if r.doc_id in (4, 5, 6)} == {(0, 0)}
    assert sum(r.taken for r in rows) == sum(r.size for r in rows)
    assert mixing.mix(nothing).count() == 0 and mixing.mixed(nothing).count() == 0
    assert mixing.mixed(tricky).columns == tricky.columns


def huffman_bits(n):
    heap = sorted(n)
    heapq.heapify(heap)
    bits = 0
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        bits += x
        heapq.heappush(heap, x)
    return bits


def test_code_lengths():
    rng = np.random.default_rng(1)
    n = rng.zipf(1.5, 300).clip(0, 10**9)
    n[:5] = 0
    free = tokens.code_lengths(n, 60)
    assert (free * n).sum() == huffman_bits(n[n > 0].tolist()) and (free[:5] == 0).all()
    short = tokens.code_lengths(2 ** np.arange(20), 6)
    assert short.max() == 6 and sum(2.0 ** -short) == 1
    assert tokens.code_lengths(np.array([0, 7, 0])).tolist() == [0, 1, 0] and tokens.code_lengths(np.zeros(3)).tolist() == [0, 0, 0]


@pytest.mark.parametrize("n", [1, 511, 512, 513, 5000])
def test_bits_round_trip(n):
    rng = np.random.default_rng(n)
    ids = rng.zipf(1.4, n) % 3000
    lengths = tokens.code_lengths(np.bincount(ids, minlength=3000), 12)
    data, offsets = tokens.write_bits(ids, tokens.canonical_codes(lengths), lengths)
    assert (tokens.Decoder(lengths).read(data, offsets, n) == ids).all()
    assert len(data) == -(-int(lengths[ids].sum()) // 8)


def brute_tokens(rows):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    each = [(d, np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")) for d, x in rows]
    each = sorted(((d, zlib.crc32(i.astype("<u2").tobytes()), i) for d, i in each), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out, start = [], 0
    for d, _, i in each:
        out.append((d, start, len(i), zlib.crc32(i.tobytes())))
        start += len(i)
    return out


def test_token_files_round_trip(spark, tricky, nothing, monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK", 50)
    text = [(r.doc_id, r.text) for r in tricky.collect()] + [(-5, "a<|startoftext|>b ' \u0344x it's WE'RE İ ẞ\u0301"), (10**12, "\u0301 \u0300a")]
    df = spark.createDataFrame(text, "doc_id long, text string").repartition(4)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokens.round_trip(df).collect()), key=lambda r: r[1])
    assert got == brute_tokens(text)
    assert tokens.round_trip(nothing).count() == 0
    assert tokens.round_trip(tricky).count() == tricky.count()


def test_tokens_are_made_from_batches_of_a_slice(spark, monkeypatch):
    unit = 1 << 16

    def sizes(docs, vocabulary=None):
        def run(it):  # as many tokens as the batch has units
            for b in it:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(0), pa.array([b"\2\0" * (b.nbytes // unit)] * b.num_rows, pa.binary())], ["doc_id", "crc", "ids"])

        return docs.mapInArrow(run, "doc_id long, crc long, ids binary")

    monkeypatch.setattr(tokens, "tokenized", sizes)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    df = spark.range(0, 1200, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 2000).alias("text"))
    got = [r.n_tokens for r in tokens.round_trip(df).collect()]
    assert len(got) == 1200 and max(got) <= SLICE_BYTES // unit + 1 < sum(10_000 for _ in got) // unit
    assert spark.conf.get(name) == before
    with pytest.raises(ZeroDivisionError), small_batches(spark, 1000):
        assert spark.conf.get(name) != before and 1 / 0
    assert spark.conf.get(name) == before


def test_prefix_counts_are_the_library_s(spark, tricky, nothing):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    count = lambda s: len(t.encode(s, add_special_tokens=False).ids)
    rng = random.Random(1)
    texts = ["Hello  world, it's we're they'll\n\n  x", "  \n\t a  ", "'re 'r 'v ''re l'le", "a<|endoftext|>b <|endo", "日本語テスト 123 4567", "émoji 😀😀 x", "a" * 50,
             " " * 40 + "x", "\r\n\r\nA", "", "<|endoftext|><|endoftext|>"]
    texts += ["".join(rng.choice("\x1c\x85\u00a0\u2028\u200b\ufeffab 'rels tvd\n  é日1<|>.") for _ in range(rng.randrange(1, 30))) for _ in range(120)]
    c = counts.Counter(public_tokenizers.path("byte_bpe_50k.json"))
    for s, p in zip(texts, c.prefixes(texts)):
        assert np.concatenate(([0], np.cumsum(counts.values(p)))).tolist() == [count(s[:i]) for i in range(len(s) + 1)]
    rows = counts.prefix_counts(tricky).collect()
    want = {(r.doc_id, len((r.text or "").encode()), count(r.text or "")) for r in tricky.collect()}
    assert {(r.doc_id, r.n_bytes, r.n_tokens) for r in rows} == want and len(rows) == tricky.count()
    assert counts.over_limit(nothing).count() == 0


def test_budget_questions(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = "The house that we've built, in 1999, was   unbelievably big"
    df = counts.prefix_counts(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    row = df.select(counts.count_at(F.col("prefixes"), F.lit(11)).alias("n"), counts.longest_within(F.col("prefixes"), F.lit(5)).alias("m")).first()
    n = [len(t.encode(text[:i]).ids) for i in range(len(text) + 1)]
    assert row.n == n[11] and row.m == max(i for i, x in enumerate(n) if x <= 5)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pipeline_stages(spark):
    """Each stage against brute force over what its predecessor kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = {"start": docs.toPandas()}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        kept[name] = docs.toPandas()
        if name != names[-1]:
            assert docs.columns == before.columns
            docs = spark.createDataFrame(kept[name], before.schema)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = {r.doc_id: r.predicted for r in quality.score(spark.read.parquet(f"{SF}/documents.parquet"), labels).collect()}
    good = kept[names[0]]
    assert set(good.doc_id) == {i for i, p in scores.items() if p}
    ids, least = good.doc_id.tolist(), brute_least(good.text.tolist())
    first = {}
    for i, g in zip(ids, least):
        first[g] = min(i, first.get(g, i))
    assert sorted(kept[names[1]].doc_id) == sorted(first.values())
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()
    clean = kept[names[2]]
    items = decontam.Items(bench.item_id.tolist(), bench.text.tolist())
    assert set(clean.doc_id) == {i for i, t in zip(kept[names[1]].doc_id, kept[names[1]].text) if not items.found([t])[0]}
    mixed = kept[names[3]]
    taken = {r.doc_id: r.taken for r in mixing.mix(spark.createDataFrame(clean)).collect() if r.taken}
    assert {i: sum(len(t.split(" ")) if "\n" not in t else len(t.split()) for t in g.text) for i, g in mixed.groupby("doc_id")} == taken
    last = kept[names[4]].sort_values("start")
    assert [tuple(r) for r in last[["doc_id", "start", "n_tokens", "ids_crc32"]].itertuples(index=False)] == brute_tokens(list(zip(mixed.doc_id.tolist(), mixed.text)))


def test_encoder_keeps_no_more_than_it_may(monkeypatch):
    """Words and pieces come back after the table was full; plain and other texts in one batch keep their order."""
    monkeypatch.setattr(tokens, "KEPT", 40)
    path = public_tokenizers.path(tokens.VOCABULARY)
    tok, enc, rng = Tokenizer.from_file(path), tokens.WordEncoder(path), random.Random(23)
    words = ["don't", "We'll", "a1b22", "\u00c9t\u00e9,", "!?", "''s", "\u0130x", "\u65e5\u672c", "(house)", "x" * 40, *(f"w{chr(97 + i % 26)}{i}." for i in range(90))]
    for _ in range(12):
        texts = [None, "", "  \t\x0b ", *(" \n".join(rng.choices(words, k=rng.randrange(30))) + rng.choice(["", " "]) for _ in range(8))]
        got = [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode(texts)]
        assert got == [[*tok.encode(t or "", add_special_tokens=False).ids, tokens.END] for t in texts]
        assert len(enc.older) + len(enc.memo) < 600
    assert len(enc.older) > 0

import os
import zlib

import numpy as np
import pyarrow as pa
import pytest

from scorebook.llm import langid, quality

SF = "/root/testdata/sf0.01"


def test_vectors_are_bound_and_bundled():
    enc = langid.Encoder(64, 3)
    letters = {c: enc.letter(ord(c)).astype(int) for c in "abc"}
    edge = enc.letter(0).astype(int)
    want = np.roll(edge, 2) * np.roll(letters["a"], 1) * letters["b"] + np.roll(letters["a"], 2) * np.roll(letters["b"], 1) * edge
    want = want + np.roll(edge, 2) * np.roll(letters["c"], 1) * edge
    assert (enc.encode(pa.array(["ab, c!"]))[0] == want).all()


def test_long_texts_and_full_tables_change_nothing(monkeypatch):
    texts = pa.array(["abc äöü " * 50, None, "", "xyz", "日本語 テスト" * 20])
    want = langid.Encoder(64, 3).encode(texts)
    monkeypatch.setattr(langid, "CHARS", 7)
    monkeypatch.setattr(langid, "KEPT", 5)
    monkeypatch.setattr(langid, "SLOTS", 1 << 20)
    assert (langid.Encoder(64, 3).encode(texts) == want).all()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_language_accuracy_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edge_cases(spark, tricky, nothing):
    rows = langid.identify(tricky).collect()
    assert len(rows) == tricky.count()
    assert {r.lang_pred for r in rows if r.doc_id in (4, 5, 6)} == {"und"} and {r.score for r in rows if r.doc_id == 4} == {0.0}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"") % 5 == 0) for r in rows)
    assert langid.identify(nothing).count() == 0
    unknown = langid.identify(tricky.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()
    assert {r.lang_pred for r in unknown} == {"und"}


def tiny_net():
    rng = np.random.default_rng(0)
    f = quality.FILTERS
    return quality.Net(rng.normal(size=(256, quality.EMBED)).astype(np.float32), rng.normal(size=(quality.WIDTH * quality.EMBED, f)).astype(np.float32),
                       rng.normal(size=f).astype(np.float32), rng.normal(size=3 * f), 0.1)


def test_convolution_against_plain_loops():
    net = tiny_net()
    for text in ("", "short", "many words here " * 40, "ünïcödé " * 33):
        data = text.encode()
        halves = max(1, -(-len(data) // quality.HALF))
        buf = np.zeros((halves + 1) * quality.HALF + quality.WIDTH, np.uint8)
        buf[: len(data)] = np.frombuffer(data, np.uint8)
        chunks = []
        for c in range(max(1, halves - 1)):
            acts = [net.embed[buf[p : p + quality.WIDTH]].ravel() @ net.filters + net.bias
                    for p in range(c * quality.HALF, (c + 2) * quality.HALF)]
            chunks.append(np.maximum(np.max(acts, axis=0), 0))
        x = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0), np.min(chunks, axis=0)])
        want = 1 / (1 + np.exp(-np.clip(x @ net.out + net.out_bias, -40, 40)))
        got = quality.probabilities(net, net.tables(), pa.array(["other", text, "x" * 300]))[1]
        assert got == pytest.approx(want, rel=1e-3, abs=1e-6)


def test_gradients_against_finite_differences(monkeypatch):
    monkeypatch.setattr(quality, "AT_ONCE", 3)
    rng = np.random.default_rng(3)
    f = 5
    p = {"embed": rng.normal(0, 0.5, (256, quality.EMBED)), "filters": rng.normal(0, 0.3, (quality.WIDTH * quality.EMBED, f)),
         "bias": rng.normal(0, 0.1, f), "out": rng.normal(0, 0.5, 3 * f), "out_bias": np.zeros(1)}
    texts, y, w = [b"", b"short", bytes(rng.integers(0, 256, 900)), b"abcd" * 100, b"x" * 3000], np.array([0.0, 1, 1, 0, 1]), np.array([1.0, 2, 0.5, 1, 3])
    monkeypatch.setattr(quality, "combined", _combined64)
    loss, g = quality.loss_and_gradients(p, texts, y, w)
    for name in p:
        for _ in range(12):
            at = tuple(rng.integers(0, n) for n in p[name].shape)
            if name == "embed":
                at = (int(rng.choice(list(b"abcdx"))), at[1])
            moved = {k: v.copy() for k, v in p.items()}
            moved[name][at] += 1e-6
            up = quality.loss_and_gradients(moved, texts, y, w)[0]
            assert (up - loss) / 1e-6 == pytest.approx(g[name][at], rel=1e-3, abs=1e-6)


def _combined64(half, first):
    """As ``quality.combined``, in doubles."""
    chunk, out = np.maximum(half[:-1], half[1:]), []
    for a, b in zip(first[:-1], first[1:]):
        c = chunk[a : max(a + 1, b - 2)]
        out.append(np.concatenate([c.mean(axis=0), c.max(axis=0), c.min(axis=0)]))
    return np.array(out)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(r.predicted == (r.score >= 0.5) for r in rows)
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.9


def test_quality_edge_cases(spark, tricky, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, None), (8, 1, 0), (None, 1, 1), (4, None, 1), (6, 0, 0), (6, 0, 0), (77, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.score(tricky, labels, epochs=1).collect()
    assert len(rows) == tricky.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (4, 5)}) == 1
    assert {r.score for r in quality.score(tricky, labels.limit(0)).collect()} == {0.5}
    assert quality.score(nothing, labels).count() == 0
    assert quality.accepted(tricky, labels.limit(0)).count() == tricky.count()
    assert quality.accepted(tricky, labels.limit(0)).columns == tricky.columns

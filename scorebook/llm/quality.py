"""Quality classifier: a byte-level convolutional network in NumPy.

Bytes are embedded, filters of eight bytes slide over chunks that overlap by half and cover the whole text,
each filter is max-pooled in a chunk, and mean, maximum and minimum over the chunks go through one logistic
layer. A filter starts at every byte. Two neighbouring bytes are looked up at once, so a filter is four table
rows added up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorebook.llm.common import map_rows, narrow, slices, text_bytes

WIDTH, HALF = 8, 128
EMBED, FILTERS = 8, 24
#: Bounded training sample: labelled rows of each class, with their whole texts.
SAMPLE_ROWS = 800
EPOCHS = 12
SEED = 5
SLICE = 1 << 19
#: Half chunks whose activations are held at once.
AT_ONCE = 2048


@dataclass
class Net:
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # WIDTH * EMBED x FILTERS
    bias: np.ndarray
    out: np.ndarray  # 3 * FILTERS
    out_bias: float

    def tables(self) -> list[np.ndarray]:
        """For each of the four byte pairs of a filter, the contribution of every pair of bytes."""
        per = [(self.embed @ self.filters[j * EMBED : (j + 1) * EMBED]).astype(np.float32) for j in range(WIDTH)]
        pairs = [(per[j + 1][:, None, :] + per[j][None, :, :]).reshape(65536, -1) for j in range(0, WIDTH, 2)]
        pairs[0] += self.bias.astype(np.float32)
        return pairs


def padded(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts laid out at multiples of HALF, followed by zeros; also the first half chunk of each text."""
    n = np.diff(off)
    halves = np.maximum(1, -(-n // HALF))
    first = np.concatenate(([0], np.cumsum(halves + 1)))  # a spare half of zeros ends each text
    buf = np.zeros(first[-1] * HALF + WIDTH, np.uint8)
    for a, b, at in zip(off[:-1].tolist(), off[1:].tolist(), (first[:-1] * HALF).tolist()):
        buf[at : at + b - a] = data[a:b]
    return buf, first


def pooled(buf: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """Largest activation of each filter in every half chunk (windows that start in it)."""
    pairs = buf[:-1] | buf[1:].astype(np.uint16) << 8
    n = len(buf) - WIDTH
    out = np.empty((n // HALF, tables[0].shape[1]), np.float32)
    for lo in range(0, n, HALF * 32):
        hi = min(n, lo + HALF * 32)
        y = tables[0][pairs[lo:hi]]
        for j, t in enumerate(tables[1:], 1):
            y += t[pairs[lo + 2 * j : hi + 2 * j]]
        out[lo // HALF : hi // HALF] = y.reshape(-1, HALF, y.shape[1]).max(axis=1)
    return np.maximum(out, 0)


def combined(half: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean, maximum and minimum over a text's chunks; a chunk is two neighbouring half chunks."""
    chunk = np.maximum(half[:-1], half[1:])
    feats = np.empty((len(first) - 1, 3 * half.shape[1]), np.float32)
    f = half.shape[1]
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        c = chunk[a : max(a + 1, b - 2)]
        feats[i, :f], feats[i, f : 2 * f], feats[i, 2 * f :] = c.mean(axis=0), c.max(axis=0), c.min(axis=0)
    return feats


def probabilities(net: Net, tables: list[np.ndarray], texts: pa.Array) -> np.ndarray:
    buf, first = padded(*text_bytes(texts))
    # Row by row, so that a text's score does not depend on its neighbours.
    z = (combined(pooled(buf, tables), first).astype(np.float64) * net.out).sum(axis=1) + net.out_bias
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def loss_and_gradients(p: dict[str, np.ndarray], texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean weighted logistic loss of some texts and its gradients; they pass only the windows that won a pooling."""
    buf, first = padded(np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))))
    emb, w = p["embed"], p["filters"].reshape(WIDTH, EMBED, -1)
    filters, steps = w.shape[2], np.arange(WIDTH)
    per = [emb @ x for x in w]
    n = (len(buf) - WIDTH) // HALF
    raw, won = np.empty((n, filters), emb.dtype), np.empty((n, filters), np.int64)
    for lo in range(0, n, AT_ONCE):
        hi = min(n, lo + AT_ONCE)
        act = (per[0] + p["bias"])[buf[lo * HALF : hi * HALF]]
        for j in range(1, WIDTH):
            act += per[j][buf[lo * HALF + j : hi * HALF + j]]
        act = act.reshape(-1, HALF, filters)
        won[lo:hi] = act.argmax(axis=1) + np.arange(lo, hi)[:, None] * HALF  # byte where the winning window starts
        raw[lo:hi] = act.max(axis=1)
    half = np.maximum(raw, 0)
    feats = combined(half, first)
    z = feats @ p["out"] + p["out_bias"]
    d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight / len(texts)
    loss = float((weight * (np.logaddexp(0, z) - y * z)).mean())
    g = {"out": feats.T @ d, "out_bias": np.array([d.sum()])}
    dh, up = np.zeros_like(half), d[:, None] * p["out"]
    cols = np.arange(filters)
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        b = max(a + 1, b - 2)
        left = half[a:b] >= half[a + 1 : b + 1]
        c = np.where(left, half[a:b], half[a + 1 : b + 1])
        dc = np.tile(up[i, :filters] / (b - a), (b - a, 1))
        dc[c.argmax(axis=0), cols] += up[i, filters : 2 * filters]
        dc[c.argmin(axis=0), cols] += up[i, 2 * filters :]
        dh[a:b] += dc * left
        dh[a + 1 : b + 1] += dc * ~left
    dh *= raw > 0
    g["bias"] = dh.sum(axis=0)
    byte = buf[won[:, :, None] + steps]  # half chunk, filter, byte of the window
    # What each byte, at each place of each filter, passes back.
    slot = (byte.astype(np.int64) * WIDTH + steps) * filters + cols[None, :, None]
    got = np.bincount(slot.ravel(), weights=np.repeat(dh.ravel(), WIDTH), minlength=256 * WIDTH * filters).reshape(256, WIDTH, filters)
    g["embed"] = np.einsum("bkf,kef->be", got, w, optimize=True)
    g["filters"] = np.einsum("bkf,be->kef", got, emb, optimize=True).reshape(WIDTH * EMBED, filters)
    return loss, g


def fit(texts: list[bytes], y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, seed: int = SEED, batch: int = 32) -> Net:
    """Adam on the weighted logistic loss."""
    rng = np.random.default_rng(seed)
    p = {"embed": rng.normal(0, 0.5, (256, EMBED)), "filters": rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)),
         "bias": np.zeros(FILTERS), "out": rng.normal(0, 0.1, 3 * FILTERS), "out_bias": np.zeros(1)}
    m, v, t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    total = epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), batch):
            ids = order[lo : lo + batch]
            small = {k: x.astype(np.float32) if k in ("embed", "filters", "bias") else x for k, x in p.items()}
            _, g = loss_and_gradients(small, [texts[i] for i in ids], y[ids], weight[ids])
            t += 1
            rate = 0.01 * (1 - (t - 1) / total) + 0.0005
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
    return Net(p["embed"].astype(np.float32), p["filters"].astype(np.float32), p["bias"].astype(np.float32), p["out"], float(p["out_bias"][0]))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, epochs: int = EPOCHS, seed: int = SEED) -> Net | None:
    """Fits the net on at most ``rows`` labelled rows of each class, the first in order of a hash of the id.

    Each class counts by its share of all labelled rows. The driver holds that sample with its whole texts.
    None if there is nothing to learn from.
    """
    shares = {r.quality: r["count"] for r in labels.where("quality in (0, 1)").groupBy("quality").count().collect()}
    texts, y = [], []
    for q in sorted(shares):
        picked = labels.where(F.col("quality") == q).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        got = docs.join(F.broadcast(picked), "doc_id", "left_semi").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("t"))
        got = sorted((r.doc_id, bytes(r.t)) for r in got.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect())
        texts += [t for _, t in got]
        y += [q] * len(got)
    if not texts:
        return None
    y = np.array(y, np.float64)
    share = np.array([shares.get(0, 0), shares.get(1, 0)]) / sum(shares.values())
    weight = share[y.astype(int)] / np.array([max(1, (y == 0).sum()), max(1, (y == 1).sum())])[y.astype(int)] * len(y)
    return fit(texts, y, weight, epochs, seed)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 3,
          rows: int = SAMPLE_ROWS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, held_out, score, predicted for every whole text.

    Learned from labelled rows (``labels``: doc_id, quality) whose crc32 of the id's text is not 1 modulo
    ``folds``; null ids and labels other than 0 and 1 are never learned from. Null texts count as empty; an
    empty text is one chunk of zeros and gets a score like any other. Without anything to learn from, every
    score is 0.5. Repeated rows get the same score; an empty table gives an empty result.
    """
    df = narrow(docs, doc_id=id_col, text=text_col)
    net = learned(df, labels, folds, rows, epochs, seed)

    def predict(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else []
        for b in it:
            for part in slices(b, limit=SLICE):
                p = scored(net, tables, part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                                                 ["doc_id", "held_out", "score", "predicted"])

    return df.select("doc_id", held_out("doc_id", folds).alias("held_out"), "text").mapInArrow(
        predict, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def held_out(id_col: str, folds: int) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 1


def learned(docs: DataFrame, labels: DataFrame, folds: int = 3, rows: int = SAMPLE_ROWS, epochs: int = EPOCHS, seed: int = SEED) -> Net | None:
    """The net learned from the labelled rows of ``docs`` (doc_id, text) that are not held out."""
    known = narrow(labels, doc_id="doc_id", quality="quality").where("doc_id is not null").where(~held_out("doc_id", folds))
    return train(docs, known, rows, epochs, seed)


def scored(net: Net | None, tables: list[np.ndarray], texts: pa.Array) -> np.ndarray:
    return probabilities(net, tables, texts) if net else np.full(len(texts), 0.5)


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose whole text scores at least ``least``."""
    net, at = learned(narrow(docs, doc_id=id_col, text=text_col), labels), docs.columns.index(text_col)

    def keep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else []
        for b in it:
            for part in slices(b, at, SLICE):
                yield part.filter(pa.array(scored(net, tables, part.column(at)) >= least))

    return map_rows(docs, keep)

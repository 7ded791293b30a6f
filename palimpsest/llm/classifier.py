"""Quality classifier: a byte-level convolutional network in numpy over the whole document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from . import textkernels as tk

WIDTH, EMBED, FILTERS, HALF = 8, 8, 64, 256
#: Labelled rows used to fit, and the longest text among them in bytes; scoring has no such bounds.
MOST_ROWS, MOST_BYTES = 6000, 1 << 16
EPOCHS, BATCH, RATE, SEED, KEEP = 6, 32, 0.003, 11, 0.5
#: Seed n-grams: their length, and how many a bad document is to be covered by.
GRAM, COVER = 5, 3
_r = np.random.default_rng(3)
TABLE = (_r.standard_normal((256, EMBED)) / np.sqrt(EMBED)).astype(np.float32)
TABLE[0] = 0


def layout(off: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with each text after WIDTH zeros from a multiple of HALF, so that no window sees two texts, and each text's first half chunk."""
    size = np.diff(off)
    halves = (size + WIDTH + HALF - 1) // HALF
    first = np.zeros(len(size) + 1, np.int64)
    np.cumsum(halves, out=first[1:])
    out = np.zeros(int(first[-1]) * HALF + WIDTH, np.uint8)
    out[np.arange(len(raw)) + np.repeat(first[:-1] * HALF + WIDTH - off[:-1], size)] = raw
    return out, first


class Network:
    """Filters over WIDTH bytes, max-pooled in chunks of two halves that overlap by one, then the chunks' maximum and mean into one logistic unit."""

    def __init__(self, filters: int = FILTERS, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.w = (r.standard_normal((WIDTH * EMBED, filters)) * 0.3).astype(np.float32)
        self.b = np.full(filters, -1.0, np.float32)
        self.v = (r.standard_normal(2 * filters) * 0.05).astype(np.float32)
        self.c = np.zeros(1, np.float32)

    def halves(self, data: np.ndarray) -> np.ndarray:
        """Each filter's largest response in each half chunk; every byte position is covered."""
        n = len(data) - WIDTH
        out = np.empty((n // HALF, len(self.b)), np.float32)
        step = 64 * HALF
        for at in range(0, n, step):
            emb = TABLE[data[at : min(at + step, n) + WIDTH]].ravel()
            m = (len(emb) // EMBED - WIDTH) // WIDTH
            best = emb[: m * WIDTH * EMBED].reshape(m, -1) @ self.w
            for o in range(1, WIDTH):
                np.maximum(best, emb[o * EMBED : o * EMBED + m * WIDTH * EMBED].reshape(m, -1) @ self.w, out=best)
            out[at // HALF : at // HALF + m * WIDTH // HALF] = best.reshape(-1, HALF // WIDTH, best.shape[1]).max(1)
        return out

    def pooled(self, h: np.ndarray, first: np.ndarray):
        """(document vectors, chunk activations, which half won, each text's first chunk)."""
        count = np.maximum(np.diff(first) - 1, 1)
        at = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=at[1:])
        left = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], count)
        right = np.minimum(left + 1, np.repeat(first[1:], count) - 1)
        second = h[right] > h[left]
        act = np.maximum(np.where(second, h[right], h[left]) + self.b, 0)
        top, mean = np.maximum.reduceat(act, at[:-1], axis=0), np.add.reduceat(act, at[:-1], axis=0) / count[:, None]
        return np.hstack([top, mean]), act, np.where(second, right[:, None], left[:, None]), at

    def score(self, off: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """Probability of a good document, for each text."""
        data, first = layout(off, raw)
        x = self.pooled(self.halves(data), first)[0] @ self.v + self.c
        return 1 / (1 + np.exp(-x.astype(np.float64)))

    def seed_filters(self, off: np.ndarray, raw: np.ndarray, bad: np.ndarray, n: int = GRAM, cover: int = COVER) -> None:
        """Begin filters at byte n-grams that tell bad documents from good: a greedy cover, then the gradient goes on."""

        def grams(which: np.ndarray):
            """Distinct (gram, text) of the chosen texts."""
            for part in np.array_split(which, max(1, len(which) // 256)):
                for i in part:
                    x = raw[off[i] : off[i + 1]].astype(np.uint64)
                    if len(x) < n:
                        yield i, np.zeros(0, np.uint64)
                        continue
                    h = np.zeros(len(x) - n + 1, np.uint64)
                    for k in range(n):
                        h = (h << np.uint64(8)) | x[k : len(x) - n + 1 + k]
                    yield i, np.unique(h)

        found = list(grams(np.flatnonzero(bad)))
        gram, bad_n = np.unique(np.concatenate([h for _, h in found]), return_counts=True)
        gram, bad_n = gram[bad_n >= 3], bad_n[bad_n >= 3]
        if not len(gram):
            return

        def known(h: np.ndarray) -> np.ndarray:
            i = np.minimum(np.searchsorted(gram, h), len(gram) - 1)
            return i[gram[i] == h]

        good_n = np.zeros(len(gram), np.int64)
        for _, h in grams(np.flatnonzero(~bad)):
            good_n[known(h)] += 1
        useful = bad_n >= 5 * good_n
        pairs = [(i, k[useful[k]]) for i, h in found for k in [known(h)]]
        g = np.concatenate([k for _, k in pairs])
        d = np.repeat([i for i, _ in pairs], [len(k) for _, k in pairs])
        open_ = np.full(len(bad), cover)
        chosen: list[int] = []
        for _ in range(int(len(self.b) * 0.8)):
            live = open_[d] > 0
            if not live.any():
                break
            gain = np.bincount(g[live], minlength=len(gram)) - 2.0 * good_n
            best = int(gain.argmax())
            if gain[best] < 2:
                break
            chosen.append(best)
            hit = g == best
            open_[d[hit]] -= 1
            # what overlaps a chosen n-gram in the same documents says nothing new
            near = np.bincount(g[np.isin(d, d[hit])], minlength=len(gram))
            stale = near >= 0.8 * np.maximum(np.bincount(g, minlength=len(gram)), 1)
            drop = ~(stale[g] & np.isin(g, np.flatnonzero(near > 0)))
            g, d = g[drop], d[drop]
        for f, best in enumerate(chosen):
            text = [(int(gram[best]) >> (8 * (n - 1 - i))) & 255 for i in range(n)]
            e = np.zeros((WIDTH, EMBED), np.float32)
            e[:n] = TABLE[text]
            norm = float((e**2).sum())
            self.w[:, f] = 4 * e.ravel() / norm
            self.b[f] = -3.0
            self.v[f], self.v[len(self.b) + f] = -3.0, -0.5

    def fit(self, off: np.ndarray, raw: np.ndarray, good: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Network:
        r, params = np.random.default_rng(seed), [self.w, self.b, self.v, self.c]
        m, s, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        f = len(self.b)
        share = float(good.mean()) if len(good) else 0.5
        if not len(good) or not 0 < share < 1:  # one class only: the prior is all that can be learned
            self.v[:] = 0
            self.c[:] = 4.0 if share >= 0.5 else -4.0
            return self
        self.seed_filters(off, raw, ~good)
        self.c[:] = 2.0
        size = np.diff(off)
        for _ in range(epochs):
            order = r.permutation(len(good))
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                o = np.zeros(len(pick) + 1, np.int64)
                np.cumsum(size[pick], out=o[1:])
                data, first = layout(o, np.concatenate([raw[off[i] : off[i + 1]] for i in pick]))
                n = len(data) - WIDTH
                emb = TABLE[data].ravel()
                y = np.empty((n // WIDTH, WIDTH, f), np.float32)
                for k in range(WIDTH):
                    y[:, k] = emb[k * EMBED : k * EMBED + n * EMBED].reshape(-1, WIDTH * EMBED) @ self.w
                y = y.reshape(-1, HALF, f)
                arg = y.argmax(1)
                h = np.take_along_axis(y, arg[:, None], 1)[:, 0]
                x, act, half, chunk = self.pooled(h, first)
                p = 1 / (1 + np.exp(-(x @ self.v + self.c)))
                dz = ((p - good[pick]) / len(pick)).astype(np.float32)
                count = np.diff(chunk)
                of = np.repeat(np.arange(len(pick)), count)
                da = (dz / count)[of, None] * self.v[f:] + np.where(act == x[of, :f], dz[of, None] * self.v[:f], 0)
                da = da * (act > 0)
                dh = np.zeros_like(h)
                np.add.at(dh, (half, np.arange(f)[None]), da)
                dw = np.zeros_like(self.w)
                for k in range(f):
                    i = np.flatnonzero(dh[:, k])
                    if len(i):
                        pos = (i * HALF + arg[i, k])[:, None] * EMBED + np.arange(WIDTH * EMBED)
                        dw[:, k] = dh[i, k] @ emb[pos]
                grads = [dw, da.sum(0), x.T @ dz, np.array([dz.sum()], np.float32)]
                t += 1
                for j, (par, g) in enumerate(zip(params, grads, strict=True)):
                    m[j] += 0.1 * (g - m[j])
                    s[j] += 0.01 * (g * g - s[j])
                    par -= RATE * (m[j] / (1 - 0.9**t)) / (np.sqrt(s[j] / (1 - 0.99**t)) + 1e-7)
        return self


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> Network:
    """Fit on a bounded sample: of the labelled documents whose text has at most most_bytes, the most_rows first by a hash of doc_id.

    Both bounds together limit what the driver holds. Good means quality 1 and toxic 0; a label with
    a null doc_id, quality or toxic isn't used, nor is an id with labels that contradict each other
    or without a document. A null text isn't used, an empty or very short one is; of rows that
    repeat a doc_id the text first in order counts. Without labels the network keeps everything.
    """
    lab = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(
        F.min(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")).alias("good"), F.max(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")).alias("also")
    ).where("good = also")
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null").where(F.octet_length("text") <= most_bytes)
    there = held.select("doc_id").join(lab, F.col("doc_id") == F.col("label_id")).select("label_id", "good").distinct()
    sample = there.orderBy(F.xxhash64("label_id"), "label_id").limit(most_rows)
    rows = held.join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"))
    got = rows.groupBy("label_id").agg(F.min("text").alias("text"), F.first("good").alias("good")).toPandas().sort_values("label_id")
    off, raw = tk.buffers(tk.plain(pa.array(got["text"].tolist(), pa.string())))
    return Network().fit(off, raw, got["good"].to_numpy().astype(bool))


def classify(docs: DataFrame, network: Network, keep_from: float = KEEP) -> DataFrame:
    """(doc_id, probability, keep) of every row: one probability that the whole document is good, and whether it reaches keep_from.

    An empty or null text gets the probability that the network gives no bytes; a null doc_id is
    scored like any other and repeated rows are scored each. Other columns are ignored. An empty
    table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(network)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in batches:
            texts = tk.plain(batch.column(1))
            for a, b in tk.slices(texts):
                p = net.score(*tk.buffers(texts.slice(a, b - a)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(p), pa.array(p >= keep_from)], names=["doc_id", "probability", "keep"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tk.thrifty(score), "doc_id long, probability double, keep boolean")


def kept(docs: DataFrame, network: Network, keep_from: float = KEEP) -> DataFrame:
    """docs without the rows that classify() rejects; all columns stay as they are, whatever their names."""
    sent = docs.sparkSession.sparkContext.broadcast(network)

    @F.arrow_udf("boolean")
    def good(text: pa.Array) -> pa.Array:
        arr = tk.plain(text)
        parts = [sent.value.score(*tk.buffers(arr.slice(a, b - a))) >= keep_from for a, b in tk.slices(arr)]
        tk.trim()
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, bool))

    return docs.where(good("text"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    return classify(docs, train(docs, shared.table(spark, sf_dir, "labels")))

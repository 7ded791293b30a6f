"""LM scoring: a gated recurrent network in numpy with a class-factored softmax, trained over the whole corpus."""

from __future__ import annotations

import heapq
import io
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from . import textkernels as tk

CLASSES, PER_CLASS, HIDDEN, LANES, WINDOW, RATE = 32, 32, 16, 256, 24, 0.01
#: Steps that are scored at once; the state goes on, so scores don't depend on it.
SCORED = 96
OTHER, EDGE = 0, 1  # ids of a word outside the vocabulary, and of a document's begin and end
#: Output units that are one word each; the others stand for words of about equal frequency.
SINGLE = 768
#: Most words in the vocabulary, which every executor holds; a word counts from two occurrences on, or from as many as this bound asks for.
MOST_WORDS = 1 << 21
#: Tokens of a training shard, tokens that are laid out at once, rounds of training and averaging.
SHARD_TOKENS, CHUNK_TOKENS, ROUNDS = 4_000_000, 1_000_000, 3
REDUCE = 64
END = 256  # stands for a word's begin and end in its spelling


class Vocabulary:
    """Words with their output unit and their share of it, and byte pairs that spell all others.

    The commonest words have a unit each; further ones share units with words of about their own
    frequency, in order of frequency and of about equal weight, so the words grow with the corpus
    while the network doesn't.
    """

    def __init__(self, hashes: np.ndarray, n: np.ndarray, spelled: np.ndarray, total: int, docs: int, size: int = CLASSES * PER_CLASS, single: int = SINGLE):
        order = np.lexsort((hashes, -n))
        hashes, n = hashes[order], n[order].astype(float)
        self.size, self.total, single = size, total, min(single, size - 2)
        slot = np.arange(2, 2 + len(n))
        tail, bins = n[single:], size - 2 - single
        if len(tail) and not bins:
            hashes, n, slot = hashes[:single], n[:single], slot[:single]
        elif len(tail):
            share = (np.cumsum(tail) - tail / 2) / tail.sum()
            slot[single:] = 2 + single + np.minimum((share * bins).astype(np.int64), bins - 1)
        counts = np.ones(size)
        np.add.at(counts, slot, n)
        counts[OTHER] += max(0.0, total - n.sum())
        counts[EDGE] += docs
        self.counts = counts
        alone = np.bincount(slot, minlength=size)[slot] == 1
        within = np.where(alone, 0.0, np.log(n / np.maximum(np.bincount(slot, weights=n, minlength=size)[slot], 1)))
        order = np.argsort(hashes)
        self.hashes, self.slots, self.within = hashes[order], slot[order].astype(np.int16), within[order].astype(np.float32)
        self.bits = max(1, int(len(hashes)).bit_length())
        self.starts = np.searchsorted(self.hashes >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)
        smooth = spelled.reshape(END + 1, END + 1) + 0.1
        self.spelling = np.log(smooth / smooth.sum(1, keepdims=True)).ravel()

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of words, -1 for those that aren't in the vocabulary."""
        out = np.full(len(hashes), -1, np.int64)
        key = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.starts[key], self.starts[key + 1]
        live = np.flatnonzero(at < end)
        while len(live):
            hit = self.hashes[at[live]] == hashes[live]
            out[live[hit]] = at[live[hit]]
            live = live[~hit]
            at[live] += 1
            live = live[at[live] < end[live]]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit of each token, each text's first token, and the log-probability of each text's words within their units or of their spelling."""
        all_ids, counts, apart = [np.zeros(0, np.int16)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for a, b in tk.slices(texts):
            t = tk.tokenise(texts.slice(a, b - a))
            at = self.find(t.hashes)
            known = at >= 0
            ids, cost = np.full(len(at), OTHER, np.int16), np.zeros(len(at))
            ids[known], cost[known] = self.slots[at[known]], self.within[at[known]]
            if not known.all():
                lo, hi = t.start[~known], t.end[~known]
                pairs = (t.bytes[:-1].astype(np.int64) * (END + 1) + t.bytes[1:]) if len(t.bytes) > 1 else np.zeros(0, np.int64)
                cum = np.zeros(len(pairs) + 1)
                np.cumsum(self.spelling[pairs], out=cum[1:])
                cost[~known] = self.spelling[END * (END + 1) + t.bytes[lo].astype(np.int64)] + cum[hi - 1] - cum[lo] + self.spelling[t.bytes[hi - 1].astype(np.int64) * (END + 1) + END]
            all_ids.append(ids)
            counts.append(np.diff(t.first))
            apart.append(tk.per_text(cost, t.first, np.add, 0.0))
        n = np.concatenate(counts)
        first = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=first[1:])
        return np.concatenate(all_ids), first, np.concatenate(apart)


def count_words(docs: DataFrame) -> DataFrame:
    """(kind, key, n) over every document: 0 words by hash, 1 byte pairs within words, their begin and end included, 2 words, 3 documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, rows = np.zeros((END + 1) ** 2, np.int64), 0, 0
        for batch in batches:
            texts = tk.plain(batch.column(0))
            words = []
            for a, b in tk.slices(texts):
                t = tk.tokenise(texts.slice(a, b - a))
                words.append(t.hashes)
                if not len(t.start):
                    continue
                inside = np.zeros(len(t.bytes) + 1, np.int8)
                np.add.at(inside, t.start + 1, 1)
                np.add.at(inside, t.end, -1)
                at = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8) > 0)  # bytes with one of the same word before
                codes = np.concatenate([t.bytes[at - 1].astype(np.int64) * (END + 1) + t.bytes[at], END * (END + 1) + t.bytes[t.start].astype(np.int64), t.bytes[t.end - 1].astype(np.int64) * (END + 1) + END])
                pairs += np.bincount(codes, minlength=len(pairs))
                n += len(t.start)
            rows += len(texts)
            h, c = np.unique(np.concatenate(words) if words else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(h), np.int32)), pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["kind", "key", "n"])
        some = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[np.ones(len(some)), 2, 3].astype(np.int32)), pa.array(np.r_[some, 0, 0].astype(np.int64)), pa.array(np.r_[pairs[some], n, rows].astype(np.int64))], names=["kind", "key", "n"]
        )

    rows = docs.select("text").mapInArrow(tk.thrifty(count), "kind int, key long, n long")
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, size: int = CLASSES * PER_CLASS, most_words: int = MOST_WORDS) -> Vocabulary:
    """The words of all documents that occur twice or more; beyond most_words of them only those that occur more often.

    Words are counted in every row, null and empty texts have none, repeated rows count each. An
    empty table gives a vocabulary without words.
    """
    counts = shared.written(count_words(docs), "words")
    often = counts.where("kind = 0 and n > 1").groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).collect()  # about as many rows as the square root of all tokens at most
    least, held = 2, 0
    for r in often:
        held += r["words"]
        if held > most_words:
            least = r["n"] + 1
            break
    words = counts.where(F.col("kind") == 0).where(F.col("n") >= least).select("key", "n").toArrow()
    spelled, total, n = np.zeros((END + 1) ** 2), 0, 0
    for r in counts.where("kind > 0").collect():
        if r["kind"] == 1:
            spelled[r["key"]] = r["n"]
        elif r["kind"] == 2:
            total = r["n"]
        else:
            n = r["n"]
    shared.discard(counts)
    return Vocabulary(np.asarray(words["key"]).view(np.uint64), np.asarray(words["n"]), spelled, total, n, size)


def streams(ids: np.ndarray, first: np.ndarray, lanes: int = LANES):
    """(inputs, targets) as [step, lane], -1 beyond a lane's end, and each text's (lane, step): whole texts, longest first, on the emptiest lane."""
    size = np.diff(first) + 1
    lanes = max(1, min(lanes, len(size)))
    heap, place = [(0, k) for k in range(lanes)], np.zeros((len(size), 2), np.int64)
    for i in np.argsort(-size, kind="stable"):
        n, k = heap[0]
        place[i] = k, n
        heapq.heapreplace(heap, (n + int(size[i]), k))
    length = np.zeros(lanes, np.int64)
    for n, k in heap:
        length[k] = n
    order = np.argsort(-length, kind="stable")
    where = np.empty(lanes, np.int64)
    where[order] = np.arange(lanes)
    place[:, 0] = where[place[:, 0]]
    length = length[order]
    x = np.full((lanes, int(length[0])), -1, np.int16)
    y = x.copy()
    for i, (k, s) in enumerate(place):
        w = ids[first[i] : first[i + 1]]
        x[k, s], x[k, s + 1 : s + size[i]] = EDGE, w
        y[k, s : s + size[i] - 1], y[k, s + size[i] - 1] = w, EDGE
    return np.ascontiguousarray(x.T), np.ascontiguousarray(y.T), place, size, length


class Model:
    """h' = (1-z) n + z h over words; p(word) = p(class | h) p(word | class, h)."""

    names = ("e", "u", "wc", "bc", "ww", "bw")

    def __init__(self, counts: np.ndarray, hidden: int = HIDDEN, classes: int = CLASSES, per_class: int = PER_CLASS, seed: int = 5):
        r, f = np.random.default_rng(seed), np.float32
        self.h, self.c, self.s = hidden, classes, per_class
        self.e = (r.standard_normal((classes * per_class, 3 * hidden)) * 0.3).astype(f)
        self.u = (r.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(f)
        self.wc = (r.standard_normal((hidden, classes)) * 0.05).astype(f)
        self.ww = (r.standard_normal((classes, hidden, per_class)) * 0.05).astype(f)
        p = counts.reshape(classes, per_class)
        self.bc, self.bw = np.log(p.sum(1) / p.sum()).astype(f), np.log(p / p.sum(1, keepdims=True)).astype(f)

    def params(self) -> list[np.ndarray]:
        return [getattr(self, n) for n in self.names]

    def steps(self, x: np.ndarray, h: np.ndarray, keep: bool):
        """States after each step, from h; with keep, what the way back needs. Inside, lanes come last, so that every slice of units is one piece."""
        n, h = self.h, h.T
        g = np.ascontiguousarray(self.e[np.maximum(x, 0)].transpose(0, 2, 1))  # becomes the gates z and r and the candidate
        t, b = x.shape
        out = np.empty((t, n, b), np.float32)
        before, uns = (np.empty((t, n, b), np.float32), np.empty((t, n, b), np.float32)) if keep else (None, None)
        start, ut = x == EDGE, np.ascontiguousarray(self.u.T)
        begins = start.any(1)
        for i in range(t):
            if begins[i]:
                h = np.where(start[i], np.float32(0), h)
            a = ut @ h
            zr, c, un = g[i, : 2 * n], g[i, 2 * n :], a[2 * n :]
            zr += a[: 2 * n]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            if keep:
                before[i], uns[i] = h, un
            un *= zr[n:]
            c += un
            np.tanh(c, out=c)
            h = h - c
            h *= zr[:n]
            h += c
            out[i] = h
        return out.transpose(0, 2, 1), h.T, (before, g, uns), g[:, 2 * n :], start

    def output(self, h: np.ndarray, y: np.ndarray, grads: dict | None):
        """Log-probabilities of the targets y from states h [n, hidden]; with grads, also the states' gradients."""
        k = y // self.s
        order = np.argsort(k, kind="stable")
        k, h = k[order], h[order]
        w, n = y[order] - k * self.s, np.arange(len(y))
        share = np.float32(1 / max(1, len(y)))
        h = np.concatenate([h.T, np.ones((1, len(y)), np.float32)])  # the last unit carries the biases
        wc, ww = np.vstack([self.wc, self.bc]), np.concatenate([self.ww, self.bw[:, None]], axis=1)
        lc = wc.T @ h
        np.exp(lc, out=lc)
        total = lc.sum(0)
        p = lc[k, n] / total
        if grads is not None:
            lc *= share / total
            lc[k, n] -= share
            dwc, dww = h @ lc.T, np.zeros_like(ww)
            dh = self.wc @ lc
        cut = np.searchsorted(k, np.arange(self.c + 1))
        for c in range(self.c):
            a, b = cut[c], cut[c + 1]
            if a == b:
                continue
            hs, at = h[:, a:b], w[a:b] * (b - a) + n[: b - a]
            lw = ww[c].T @ hs
            np.exp(lw, out=lw)
            total, flat = lw.sum(0), lw.reshape(-1)
            p[a:b] *= flat[at] / total
            if grads is not None:
                lw *= share / total
                flat[at] -= share
                dww[c] = hs @ lw.T
                dh[:, a:b] += self.ww[c] @ lw
        if grads is not None:
            grads["wc"], grads["bc"], grads["ww"], grads["bw"] = dwc[:-1], dwc[-1], dww[:, :-1], dww[:, -1]
        logp = np.empty(len(y), np.float32)
        logp[order] = np.log(p)
        if grads is None:
            return logp, None
        back = np.empty((len(y), self.h), np.float32)
        back[order] = dh.T
        return logp, back

    def backward(self, x, dout, saved, cand, start, grads) -> None:
        t, b, n = dout.shape
        dout, begins = np.ascontiguousarray(dout.transpose(0, 2, 1)), start.any(1)
        before, g, uns = saved
        z, r, c = g[:, :n], g[:, n : 2 * n], cand
        to_n, to_z, to_r = (1 - z) * (1 - c * c), (before - c) * z * (1 - z), uns * r * (1 - r)
        gu, gn = np.empty((t, 3 * n, b), np.float32), np.empty((t, n, b), np.float32)
        dh = np.zeros((n, b), np.float32)
        for i in range(t - 1, -1, -1):
            dh += dout[i]
            np.multiply(dh, to_n[i], out=gn[i])
            np.multiply(dh, to_z[i], out=gu[i, :n])
            np.multiply(gn[i], to_r[i], out=gu[i, n : 2 * n])
            np.multiply(gn[i], r[i], out=gu[i, 2 * n :])
            dh *= z[i]
            dh += self.u @ gu[i]
            if begins[i]:
                dh[:, start[i]] = 0
        grads["u"] = np.matmul(before, gu.transpose(0, 2, 1)).sum(0)
        gx = np.empty((t, b, 3 * n), np.float32)
        gx[:, :, : 2 * n], gx[:, :, 2 * n :] = gu[:, : 2 * n].transpose(0, 2, 1), gn.transpose(0, 2, 1)
        ids = x.ravel()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        at = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        de = np.zeros_like(self.e)
        sums = np.add.reduceat(gx.reshape(-1, 3 * n)[order], at, axis=0)
        real = ids[at] >= 0
        de[ids[at][real]] = sums[real]
        grads["e"] = de

    def run(self, ids: np.ndarray, first: np.ndarray, train: bool, window: int = WINDOW, lanes: int = LANES) -> np.ndarray:
        """Log-likelihood of each whole text; the state goes on from window to window. With train, an Adam step after each half window's worth of tokens of all lanes."""
        if len(first) < 2:
            return np.zeros(0)
        x, y, place, size, length = streams(ids, first, lanes)
        total, h = np.zeros(y.shape, np.float32), np.zeros((x.shape[1], self.h), np.float32)
        waiting, held = 0, {}
        for at in range(0, len(x), window):
            live = int(np.searchsorted(-length, -at, "left"))
            xs, ys = x[at : at + window, :live], y[at : at + window, :live]
            out, h, saved, cand, start = self.steps(xs, h[:live], train)
            real = ys >= 0
            grads: dict | None = {} if train else None
            logp, dh = self.output(out[real], ys[real], grads)
            total[at : at + window, :live][real] = logp
            if train:
                dout = np.zeros(out.shape, np.float32)
                dout[real] = dh
                self.backward(xs, dout, saved, cand, start, grads)
                # windows at the end of long texts have few lanes: they wait for each other
                k = int(real.sum())
                held = {n: held[n] + g * np.float32(k) for n, g in grads.items()} if waiting else {n: g * np.float32(k) for n, g in grads.items()}
                waiting += k
                if waiting >= x.shape[1] * window // 2 or at + window >= len(x):
                    self.adam({n: g / np.float32(waiting) for n, g in held.items()})
                    waiting = 0
        cum = np.zeros((total.shape[1], total.shape[0] + 1))
        np.cumsum(total.T, axis=1, out=cum[:, 1:])
        return cum[place[:, 0], place[:, 1] + size] - cum[place[:, 0], place[:, 1]]

    def adam(self, grads: dict) -> None:
        if not hasattr(self, "moments"):
            self.t, self.moments = 0, {n: [np.zeros_like(getattr(self, n)), np.zeros_like(getattr(self, n))] for n in self.names}
        self.t += 1
        for n in self.names:
            g, (m, s) = grads[n], self.moments[n]
            np.clip(g, -1, 1, out=g)
            m += np.float32(0.1) * (g - m)
            s += np.float32(0.01) * (g * g - s)
            getattr(self, n)[...] -= np.float32(RATE / (1 - 0.9**self.t)) * m / (np.sqrt(s * np.float32(1 / (1 - 0.99**self.t))) + np.float32(1e-6))


def _pack(params: list[np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, *params)
    return out.getvalue()


def _unpack(blob: bytes) -> list[np.ndarray]:
    with np.load(io.BytesIO(blob)) as z:
        return [z[k] for k in z.files]


def average(rows: DataFrame) -> DataFrame:
    """One (shard, weight, params) row for each REDUCE shards in a row: the weighted mean of their parameters, summed in order."""

    def mean(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")
        weight = np.asarray(table["weight"], dtype=float)
        total = None
        for w, blob in zip(weight, table["params"].to_pylist(), strict=True):
            part = [p.astype(np.float64) * (w / weight.sum()) for p in _unpack(blob)]
            total = part if total is None else [a + b for a, b in zip(total, part, strict=True)]
        return pa.table({"shard": [table["part"][0].as_py()], "weight": [weight.sum()], "params": [_pack([p.astype(np.float32) for p in total])]})

    return rows.withColumn("part", F.floor(F.col("shard") / REDUCE)).groupBy("part").applyInArrow(mean, "shard long, weight double, params binary")


def encoded(docs: DataFrame, words: Vocabulary, shards: int, rounds: int) -> DataFrame:
    """(shard, round, key, ids) of each row with a text; shard, round and order follow from a hash of doc_id and text, not from where rows lie."""
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, first, _ = sent.value.encode(tk.plain(batch.column(3)))
            off = pa.py_buffer((first * 2).astype(np.int64).tobytes())
            rows = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, off, pa.py_buffer(ids.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], rows], names=["shard", "round", "key", "ids"])

    key = F.xxhash64("doc_id", "text")
    rows = docs.where("text is not null").select(F.pmod(F.xxhash64(key, F.lit(1)), F.lit(shards)).alias("shard"), F.pmod(F.xxhash64(key, F.lit(2)), F.lit(rounds)).cast("int").alias("round"), key.alias("key"), "text")
    return rows.mapInArrow(tk.thrifty(encode), "shard long, round int, key long, ids binary")


def train(docs: DataFrame, words: Vocabulary, lanes: int = LANES, shard_tokens: int = SHARD_TOKENS, rounds: int = ROUNDS) -> Model:
    """One pass over every document, in rounds: in each, every shard trains on its documents of that round from the same start, and the mean of the results, by tokens, is the next start.

    Shards are as many as the tokens ask for and filled by hash; within one, documents come in the
    order of their hash. So the model depends on the rows alone, not on partitions or executors. A
    null text isn't trained on, an empty one is an end alone; repeated rows count each; without
    rows the model is its start.
    """
    model = Model(words.counts)
    shards = max(1, -(-int(words.total) // shard_tokens))
    every = shared.written(encoded(docs, words, shards, rounds), "encoded")
    for r in range(rounds):
        sent = docs.sparkSession.sparkContext.broadcast(model)

        def learn(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            shard, own, held, tokens, weight = None, None, [], 0, 0

            def step() -> None:
                nonlocal held, tokens, weight
                if held:
                    ids = [np.frombuffer(x, np.int16) for x in held]
                    first = np.zeros(len(ids) + 1, np.int64)
                    np.cumsum([len(x) for x in ids], out=first[1:])
                    own.run(np.concatenate(ids), first, train=True, lanes=lanes)
                    weight += tokens
                held, tokens = [], 0

            def result() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([float(weight)]), pa.array([_pack(own.params())], pa.binary())], names=["shard", "weight", "params"])

            for batch in batches:
                for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if k != shard:
                        if own is not None:
                            step()
                            yield result()
                        shard, own, weight = k, pickle.loads(pickle.dumps(sent.value)), 0
                    held.append(ids)
                    tokens += len(ids) // 2 + 1
                    if tokens >= CHUNK_TOKENS:
                        step()
            if own is not None:
                step()
                yield result()

        part = every.where(F.col("round") == r)
        part = part.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "key").select("shard", "ids")
        rows = shared.written(part.mapInArrow(tk.thrifty(learn), "shard long, weight double, params binary"), "replicas")
        while rows.count() > REDUCE:
            rows = shared.written(average(rows), "replicas")
        got = sorted(rows.collect(), key=lambda x: x["shard"])
        weight = sum(x["weight"] for x in got)
        if weight:
            parts = [[p.astype(np.float64) * (x["weight"] / weight) for p in _unpack(x["params"])] for x in got]
            for name, values in zip(Model.names, zip(*parts, strict=True), strict=True):
                setattr(model, name, np.sum(values, axis=0).astype(np.float32))
        shared.discard(rows)
    shared.discard(every)
    return model


def score(docs: DataFrame, words: Vocabulary, model: Model) -> DataFrame:
    """(doc_id, tokens, log_likelihood, per_token) of every row's whole text, in nats; tokens don't count the document's end.

    A word has the probability of its output unit times its share of that unit; one outside the
    vocabulary that of the unknown word times that of its spelling by corpus byte pairs. A null or empty text is a document of no tokens, whose
    only event is its end. A null doc_id is scored like any other, repeated rows each. Other columns
    are ignored. An empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast((words, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, net = sent.value
        for batch in batches:
            ids, first, spell = vocab.encode(tk.plain(batch.column(1)))
            ll, n = net.run(ids, first, train=False, window=SCORED) + spell, np.diff(first)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(ll), pa.array(ll / (n + 1))], names=["doc_id", "tokens", "log_likelihood", "per_token"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tk.thrifty(run), "doc_id long, tokens long, log_likelihood double, per_token double")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    words = vocabulary(docs)
    return score(docs, words, train(docs, words))

"""Removal of passages that repeat: MinHash banding over content-defined paragraphs, exact verification, components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import exact_links, regions, shared
from . import textkernels as tk

#: A paragraph is REACH tokens on either side of its anchor, a GRAM-token window.
REACH, GRAM = 8, 3
SPAN = 2 * REACH + GRAM
THRESHOLD, RECALL, ROWS = 0.75, 0.95, 2
#: Least length of a repeated passage in tokens.
LEAST_TOKENS = 40
#: Most tokens between two paragraphs of one passage, most shift of their distance to the other occurrence, score of a token that differs.
GAP, SHIFT, DIFFERENT = 16, 4, -4
#: Tokens around a passage that are compared at first; GROW times more as long as all of them agree.
AROUND, GROW = 64, 8
_SECOND = np.uint64(0x9E3779B97F4A7C15)


def tune_bands(threshold: float, recall: float = RECALL, rows: int = ROWS) -> tuple[int, int]:
    """(bands, rows): the fewest bands of `rows` values that find a pair at the threshold with probability `recall`."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))), rows


def _pairs(hashes: np.ndarray) -> np.ndarray:
    """Hash of each token and the next."""
    return tk.mix(hashes[:-1] * _SECOND + hashes[1:]) if len(hashes) > 1 else np.zeros(0, np.uint64)


def anchors(t: tk.Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first token, anchor hash) of each paragraph.

    An anchor is a GRAM-token window whose hash is the least of those REACH tokens before and after
    it (of equal ones the leftmost); a paragraph is all these tokens, so it depends on nothing but
    its own text, wherever that stands. Paragraphs lie about 2 * REACH + 1 tokens apart.
    """
    h = t.hashes
    n = len(h) - GRAM + 1
    if n < 2 * REACH + 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = tk.mix(tk.mix(h[:n] * _SECOND + h[1 : n + 1]) * _SECOND + h[2 : n + 2])
    least, wide = g, 1  # least[i]: the minimum of `wide` hashes from i
    while 2 * wide <= REACH:
        least, wide = np.minimum(least[:-wide], least[wide:]), 2 * wide
    if wide < REACH:
        least = np.minimum(least[: len(least) - (REACH - wide)], least[REACH - wide :])
    mid = g[REACH : n - REACH]
    at = np.flatnonzero((mid < least[: len(mid)]) & (mid <= least[REACH + 1 : REACH + 1 + len(mid)])) + REACH
    which = np.searchsorted(t.first, at, "right") - 1
    inside = (at - REACH >= t.first[which]) & (at + REACH + GRAM <= t.first[which + 1])
    at, which = at[inside], which[inside]
    return which, at - REACH, g[at]


def _signed(pairs: np.ndarray, k: int) -> np.ndarray:
    """uint16[rows, k]: MinHash values of the rows' token pairs."""
    a, b = tk.permutations(k, seed=7)
    x = (pairs >> np.uint64(32)).astype(np.uint32)
    low = np.stack([(x * a[i] + b[i]).min(1) for i in range(k)], axis=1) * np.uint32(0x9E3779B1) if len(x) else np.zeros((0, k), np.uint32)
    return ((low ^ (low >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(16)).astype(np.uint16)


def _firsts(values: np.ndarray) -> np.ndarray:
    """Which values haven't come before."""
    out = np.zeros(len(values), bool)
    out[np.unique(values, return_index=True)[1]] = True
    return out


def _sources(docs: DataFrame) -> DataFrame:
    """(doc_id, h, text) of the rows that take part; h, a hash of the text, tells apart different texts under one doc_id."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text").where("doc_id is not null and text is not null")


def paragraphs(docs: DataFrame, bands: int, rows: int = ROWS) -> DataFrame:
    """(doc_id, h, pos, node, buckets) of each paragraph: its first token, a hash of its tokens, and a bucket for each band.

    A bucket is the anchor with `rows` MinHash values. Copies of a paragraph share them, so within a
    batch of rows only the first has buckets and the others null: a passage that a third of all
    documents share enters its bucket once for each batch.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hs, texts = np.asarray(batch.column(0)), np.asarray(batch.column(1)), tk.plain(batch.column(2))
            got: list[tuple] = []
            for a, b in tk.slices(texts):
                t = tk.tokenise(texts.slice(a, b - a))
                which, start, anchor = anchors(t)
                if not len(start):
                    continue
                node = tk.windows(t.hashes, start, start + SPAN)
                lead = _firsts(node)
                sig = _signed(_pairs(t.hashes)[start[lead, None] + np.arange(SPAN - 1)], bands * rows).astype(np.uint64)
                buckets = np.empty((len(sig), bands), np.uint64)
                for i in range(bands):
                    x = anchor[lead] + np.uint64(i + 1)
                    for j in range(i * rows, (i + 1) * rows):
                        x = tk.mix((x ^ (x << np.uint64(16))) + sig[:, j])
                    buckets[:, i] = x
                got.append((ids[a:b][which], hs[a:b][which], (start - t.first[which]).astype(np.int32), node, lead, buckets))
            if not got:
                continue
            doc, h, pos, node, lead, buckets = (np.concatenate(x) for x in zip(*got, strict=True))
            of_batch = _firsts(node)  # the first in the batch is the first in its slice
            buckets = buckets[of_batch[lead]]
            size = np.zeros(len(node) + 1, np.int32)
            np.cumsum(of_batch * bands, out=size[1:])
            lists = pa.ListArray.from_arrays(pa.array(size), pa.array(buckets.ravel().view(np.int64)), mask=pa.array(~of_batch))
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(h), pa.array(pos), pa.array(node.view(np.int64)), lists], names=["doc_id", "h", "pos", "node", "buckets"])

    return _sources(docs).mapInArrow(tk.thrifty(scan), "doc_id long, h long, pos int, node long, buckets array<long>")


def _pair_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, set): the distinct token pairs of the paragraphs (doc_id, h, pos, node), sorted, as bytes of uint64."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tk.plain(batch.column(0))
            at, nodes = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for a, b in tk.slices(texts):
                t = tk.tokenise(texts.slice(a, b - a))
                start = np.concatenate([np.array(p) + t.first[i] for i, p in enumerate(at[a:b])])
                rows = np.sort(_pairs(t.hashes)[start[:, None] + np.arange(SPAN - 1)], axis=1)
                fresh = np.ones(rows.shape, bool)
                fresh[:, 1:] = rows[:, 1:] != rows[:, :-1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n for p in nodes[a:b] for n in p], pa.int64()), pa.array([r[f].tobytes() for r, f in zip(rows, fresh, strict=True)], pa.binary())], names=["node", "set"]
                )

    by_doc = wanted.groupBy("doc_id", "h").agg(F.collect_list(F.struct("pos", "node")).alias("all")).select("doc_id", "h", F.col("all.pos").alias("at"), F.col("all.node").alias("nodes"))
    by_doc = shared.beside(by_doc, "asked", F.lit(64) + 16 * F.size("at"))
    found = _sources(docs).join(by_doc, ["doc_id", "h"]).select("text", "at", "nodes")
    return found.mapInArrow(tk.thrifty(make), "node long, set binary").dropDuplicates(["node"])


def paragraph_links(docs: DataFrame, units: DataFrame, threshold: float) -> DataFrame:
    """Components (node, root) of different paragraphs that share a bucket and have an exact Jaccard of token pairs of at least the threshold."""
    stars = shared.written(regions.stars(units.where("buckets is not null").select(F.explode("buckets").alias("bucket"), "node")), "stars")
    edges = shared.written(stars.select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b")).distinct(), "edge")
    nodes = shared.written(edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct(), "node")
    where = units.select("node", "doc_id", "h", "pos").join(shared.small(nodes, 16), "node", "left_semi")
    where = where.groupBy("node").agg(F.min(F.struct("doc_id", "h", "pos")).alias("at")).select("node", "at.*")
    sets = shared.written(_pair_sets(docs, where), "set")
    sure = shared.written(regions.verified(edges, sets, threshold, np.uint64), "sure")
    found = shared.components(sure)
    many = stars.groupBy("bucket").agg(F.count("*").alias("n"), F.first("lead").alias("lead")).where("n > 1")
    if many.isEmpty():
        return found
    members = stars.join(many.select("bucket"), "bucket").select("bucket", "node").union(many.select("bucket", "lead"))
    again = exact_links.links(members, sets, found, SPAN - 1, threshold)
    return found if again.isEmpty() else shared.components(sure.union(again))


def _contexts(docs: DataFrame, asked: DataFrame, around: int) -> DataFrame:
    """(doc_id, h, l, r, before, after): 16 bits of up to `around` tokens before token l (nearest first) and from token r on."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tk.plain(batch.column(2))
            ask = batch.column(3).to_pylist()
            for a, b in tk.slices(texts):
                t = tk.tokenise(texts.slice(a, b - a))
                short = (t.hashes >> np.uint64(20)).astype(np.uint16)
                rows = []
                for i in range(a, b):
                    lo, hi = t.first[i - a], t.first[i - a + 1]
                    for s in ask[i]:
                        l, r = lo + s["l"], lo + s["r"]
                        rows.append((i, s["l"], s["r"], short[max(lo, l - around) : l][::-1].tobytes(), short[r : min(hi, r + around)].tobytes()))
                i = pa.array([x[0] for x in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(i), batch.column(1).take(i), *(pa.array([x[k] for x in rows], kind) for k, kind in ((1, pa.int32()), (2, pa.int32()), (3, pa.binary()), (4, pa.binary())))],
                    names=["doc_id", "h", "l", "r", "before", "after"],
                )

    by_doc = asked.groupBy("doc_id", "h").agg(F.collect_set(F.struct("l", "r")).alias("ask"))
    by_doc = shared.beside(by_doc, "asked", F.lit(64) + 32 * F.size("ask"))
    found = _sources(docs).join(by_doc, ["doc_id", "h"]).select("doc_id", "h", "text", "ask")
    return found.mapInArrow(tk.thrifty(cut), "doc_id long, h long, l int, r int, before binary, after binary").dropDuplicates(["doc_id", "h", "l", "r"])


def _agreeing(x: bytes, y: bytes) -> int:
    """How far two token sequences go together: where matches, less four for each token that differs, add up to the most."""
    a, b = np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16)
    n = min(len(a), len(b))
    if not n:
        return 0
    total = np.cumsum(np.where(a[:n] == b[:n], 1, DIFFERENT))
    best = int(total.argmax())
    return best + 1 if total[best] > 0 else 0


def _grown(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """runs (doc_id, h, l, r, rdoc, rh, rl, rr, room_l, room_r and others) with l, r, rl, rr moved to where the two texts part.

    Texts are compared AROUND tokens on each side; runs that agree in all of them, and don't reach
    the next run of their document by that, are compared again GROW times farther, up to the end.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            left = [_agreeing(x, y) for x, y in zip(c["xb"].to_pylist(), c["yb"].to_pylist(), strict=True)]
            right = [_agreeing(x, y) for x, y in zip(c["xa"].to_pylist(), c["ya"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([c[n] for n in names] + [pa.array(left, pa.int32()), pa.array(right, pa.int32())], names=[*names, "left", "right"])

    names = runs.columns
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in runs.schema) + ", left int, right int"
    done, todo, around = None, runs, AROUND
    while True:
        sides = todo.select("doc_id", "h", "l", "r").union(todo.select("rdoc", "rh", "rl", "rr")).distinct()
        ctx = shared.written(_contexts(docs, sides, around), "context")
        x = ctx.select("doc_id", "h", "l", "r", F.col("before").alias("xb"), F.col("after").alias("xa"))
        y = ctx.select(F.col("doc_id").alias("rdoc"), F.col("h").alias("rh"), F.col("l").alias("rl"), F.col("r").alias("rr"), F.col("before").alias("yb"), F.col("after").alias("ya"))
        both = todo.join(x, ["doc_id", "h", "l", "r"]).join(y, ["rdoc", "rh", "rl", "rr"]).select(*names, "xb", "xa", "yb", "ya")
        got = shared.written(both.mapInArrow(tk.thrifty(measure), ddl), "grown")
        more = ((F.col("left") >= around) & (F.col("left") < F.col("room_l"))) | ((F.col("right") >= around) & (F.col("right") < F.col("room_r")))
        done = got.where(~more) if done is None else done.union(got.where(~more))
        todo = got.where(more).select(*names)
        if todo.isEmpty():
            break
        around *= GROW
    return done.select(
        *[n for n in names if n not in ("l", "r", "rl", "rr")],
        (F.col("l") - F.col("left")).alias("l"), (F.col("r") + F.col("right")).alias("r"), (F.col("rl") - F.col("left")).alias("rl"), (F.col("rr") + F.col("right")).alias("rr"),
    )


def _merged(spans: DataFrame, *extra) -> DataFrame:
    """Spans (doc_id, h, l, r) of one text that overlap or touch as one, with aggregates `extra`."""
    by = Window.partitionBy("doc_id", "h").orderBy("l", "r")
    reach = F.max("r").over(by.rowsBetween(Window.unboundedPreceding, -1))
    x = spans.withColumn("fresh", F.when(F.col("l") <= reach, 0).otherwise(1)).withColumn("island", F.sum("fresh").over(by))
    return x.groupBy("doc_id", "h", "island").agg(F.min("l").alias("l"), F.max("r").alias("r"), *extra).drop("island")


def repeated_passages(docs: DataFrame, threshold: float = THRESHOLD, least_tokens: int = LEAST_TOKENS, recall: float = RECALL) -> DataFrame:
    """Passages that repeat: (doc_id, text_hash, begin, end, tokens, first_doc_id, removed); begin and end count tokens of the text.

    Texts are cut into overlapping paragraphs of SPAN tokens around content-defined anchors, which
    stand alike wherever a passage is, across line ends and in the middle of lines. Equal paragraphs
    belong together; others through MinHash bands tuned to `recall` at the threshold, each colliding
    pair verified by the exact Jaccard of its token pairs; clusters are connected components. Each
    paragraph is held against its cluster's first occurrence, by (doc_id, text_hash, begin); those
    that follow each other in both texts make a passage, which is grown on both sides for as long as
    the texts agree, differing tokens counted against it. A passage of at least `least_tokens`
    tokens is to be removed (`removed`), also one that repeats in its own text; overlapping ones are
    one row. What it was held against is a row with removed false and first_doc_id = doc_id; parts
    of it may be removed in their turn for an earlier occurrence.

    text_hash is xxhash64(text): different texts under one doc_id are documents of their own, rows
    that repeat both are one. A null doc_id or text takes no part, texts under SPAN tokens have no
    paragraphs. Other columns are ignored. An empty table gives an empty result.
    """
    bands, rows = tune_bands(threshold, recall)
    units = shared.written(paragraphs(docs, bands, rows), "para")
    links = paragraph_links(docs, units, threshold)
    again = units.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node")
    known = shared.written(again.union(links.select("node")).distinct().join(links, "node", "left").select("node", F.coalesce("root", "node").alias("cluster")), "known")
    at = units.select("doc_id", "h", "pos", "node").join(shared.small(known, 24), "node").select("doc_id", "h", "pos", "cluster").distinct()
    at = shared.written(at, "at")
    first = at.groupBy("cluster").agg(F.min(F.struct("doc_id", "h", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = shared.written(first.select("cluster", F.col("first.doc_id").alias("rdoc"), F.col("first.h").alias("rh"), F.col("first.pos").alias("rpos")), "first")
    held = at.join(shared.small(first, 40), "cluster").where("doc_id <> rdoc or h <> rh or pos <> rpos")
    by = Window.partitionBy("doc_id", "h").orderBy("pos")
    before = lambda c: F.lag(c).over(by)
    same = (before("rdoc") == F.col("rdoc")) & (before("rh") == F.col("rh")) & (F.col("pos") - before("pos") <= SPAN + GAP)
    same &= F.abs((F.col("pos") - F.col("rpos")) - (before("pos") - before("rpos"))) <= SHIFT
    held = held.withColumn("fresh", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("fresh").over(by))
    runs = held.groupBy("doc_id", "h", "run").agg(
        F.min("rdoc").alias("rdoc"), F.min("rh").alias("rh"), (F.min("pos") + REACH).alias("l"), (F.max("pos") + REACH + GRAM).alias("r"), (F.min("rpos") + REACH).alias("rl"), (F.max("rpos") + REACH + GRAM).alias("rr")
    )  # from anchor to anchor, which are equal in both texts
    order = Window.partitionBy("doc_id", "h").orderBy("l")
    far = F.lit(2**31 - 1)
    runs = runs.withColumn("room_l", F.coalesce(F.col("l") - F.lag("r").over(order), far)).withColumn("room_r", F.coalesce(F.lead("l").over(order) - F.col("r"), far)).drop("run")
    grown = shared.written(_grown(docs, shared.written(runs, "runs")).where(F.col("r") - F.col("l") >= least_tokens), "passages")
    gone = _merged(grown.select("doc_id", "h", "l", "r", "rdoc"), F.min("rdoc").alias("first_doc_id")).withColumn("removed", F.lit(True))
    kept = _merged(grown.select(F.col("rdoc").alias("doc_id"), F.col("rh").alias("h"), F.col("rl").alias("l"), F.col("rr").alias("r")).distinct()).withColumn("first_doc_id", F.col("doc_id")).withColumn("removed", F.lit(False))
    out = gone.unionByName(kept)
    return out.select("doc_id", F.col("h").alias("text_hash"), F.col("l").alias("begin"), F.col("r").alias("end"), (F.col("r") - F.col("l")).alias("tokens"), "first_doc_id", "removed")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the tokens of the given spans, and the punctuation right behind each; white space isn't doubled by it."""
    found = list(tk.TOKEN.finditer(text))
    out, at = [], 0
    for b, e in spans:
        begin, end = found[b].start(), found[e - 1].end()
        while end < len(text) and not text[end].isspace() and (e >= len(found) or end < found[e].start()):
            end += 1
        out.append(text[at:begin])
        at = end
        so_far = text[begin - 1 : begin]
        while at < len(text) and text[at].isspace() and (not so_far or so_far.isspace()):
            at += 1
    return "".join([*out, text[at:]])


def without_repeats(docs: DataFrame, repeats: DataFrame) -> DataFrame:
    """docs with the removed passages cut out of text and n_chars set anew; a text left without a token goes, other rows stay as they are.

    Passages are found by doc_id and text, so a row that shares only one of them is left alone;
    rows that repeat both are cut alike. All columns stay, whatever their names; nulls, empty texts
    and empty tables pass through.
    """
    gone = repeats.where("removed").groupBy(F.col("doc_id").alias("__gone_id"), F.col("text_hash").alias("__gone_hash")).agg(F.sort_array(F.collect_set(F.array("begin", "end"))).alias("__gone_spans"))
    gone = shared.beside(gone, "gone", F.lit(64) + 48 * F.size("__gone_spans"))

    @F.pandas_udf("string")
    def trimmed(text, spans):
        import pandas as pd

        return pd.Series([None if t is None else cut(t, [tuple(map(int, s)) for s in p]) for t, p in zip(text, spans, strict=True)])

    mine = F.col("__gone_spans").isNotNull()
    joined = docs.join(gone, (F.col("doc_id") == F.col("__gone_id")) & (F.xxhash64("text") == F.col("__gone_hash")), "left")
    joined = joined.withColumn("__gone_text", trimmed(F.when(mine, F.col("text")), "__gone_spans"))
    out = joined.withColumn("text", F.when(mine, F.col("__gone_text")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(mine, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.where(~mine | F.col("text").rlike("[0-9A-Za-z]|[^\\x00-\\x7f]")).select(*docs.columns)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(shared.table(spark, sf_dir, "documents")).drop("text_hash")

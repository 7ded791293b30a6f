"""Candidate search inside buckets of signatures, and exact verification of what it finds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from . import textkernels as tk

#: A bucket of at most so many rows is compared in full at once, a larger one through leaders and then by missed().
FULL = 32
#: Rows of one side of a block that missed() compares in full.
BLOCK = 1024
#: A region of more rows is searched one signature value deeper, as long as there is one.
DENSE = 512
#: Agreement above the least from which a pair is taken to pass the exact test.
DOUBT = 0.25
#: Rows of one bucket held at a time; the last one is carried over.
HELD = 20_000
#: Rows compared at once with all of the other side.
STEP = 256
EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _alike(x: np.ndarray, y: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i of x, j of y) whose signatures agree in a share of `least`, all of them, for STEP rows of x at a time."""
    k = x.shape[1]
    columns = np.ascontiguousarray(y.T)
    for at in range(0, len(x), STEP):
        part = x[at : at + STEP]
        agree = np.zeros((len(part), len(y)), np.uint16)
        for v in range(k):
            agree += part[:, v, None] == columns[v]
        i, j = np.nonzero(agree >= least * k)
        yield i + at, j


def _leaders(node: np.ndarray, sig: np.ndarray, at: np.ndarray, least: float, out: list) -> None:
    """Link every row to the first row it resembles, and resembling clusters to each other.

    A row that resembles its leader only so far that the exact test may refuse the pair is also
    linked to the two rows most like it among those around it in the order.
    """
    owner = np.full(len(at), -1)
    k = sig.shape[1]
    doubtful = np.zeros(len(at), bool)
    for i in range(len(at)):
        if owner[i] >= 0:
            continue
        owner[i] = i
        agree = (sig[at] == sig[at[i]]).sum(1)
        alike = np.flatnonzero(agree >= least * k)
        alike = alike[alike != i]
        free = alike[owner[alike] < 0]
        doubtful[free] = agree[free] < (least + DOUBT) * k
        owner[free] = i
        rest = alike[owner[alike] != i]
        _, one = np.unique(owner[rest], return_index=True)
        for j in (*free, *rest[one]):
            out.append((node[at[i]], node[at[j]]))
    for j in np.flatnonzero(doubtful):
        low = max(0, j - DENSE // 2)
        agree = (sig[at[low : j + DENSE // 2]] == sig[at[j]]).sum(1)
        agree[j - low] = 0
        for i in np.argsort(-agree, kind="stable")[:2]:
            if agree[i] >= least * k:
                out.append((node[at[low + i]], node[at[j]]))


def _search(node, rest, sig, at, depth, most, least, out) -> None:
    if len(at) <= DENSE or depth >= most:
        return _leaders(node, sig, at, least, out)
    value = (rest[at] >> np.int64(16 * (most - 1 - depth))) & 0xFFFF
    cuts = np.flatnonzero(value[1:] != value[:-1]) + 1
    k = sig.shape[1]
    for c in cuts:  # longest-common-prefix neighbours across the split
        if (sig[at[c - 1]] == sig[at[c]]).sum() >= least * k:
            out.append((node[at[c - 1]], node[at[c]]))
    for part in np.split(at, cuts):
        if len(part) > 1:
            _search(node, rest, sig, part, depth + 1, most, least, out)
    return None


def bucket_edges(rows: DataFrame, k: int, most: int, least: float) -> DataFrame:
    """Distinct pairs (a, b), a < b, of nodes in one bucket whose k-value signatures agree in a share of `least`.

    rows: bucket, rest (the further values of this sorted order, 16 bits each, at most 3), node,
    in_bucket, sig. Rows of a bucket are visited in the order of `rest`. A bucket of at most FULL
    rows is compared in full; one of at most DENSE rows through cluster leaders; a denser one is
    split by its next value, and so on, with the neighbours across each split compared too. What
    the larger ones leave out is for missed().
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush(bucket, rest, node, size, sig, last: bool):
            out: list[tuple[int, int]] = []
            cuts = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
            begin, end = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(bucket)]])
            keep = None
            if not last and end[-1] - begin[-1] < HELD:
                keep = slice(begin[-1], end[-1])
                begin, end = begin[:-1], end[:-1]
            elif not last:  # a bucket beyond what is held: go on from its last row
                keep = slice(len(bucket) - 1, len(bucket))
            two = begin[end - begin == 2]
            if len(two):
                two = two[(sig[two] == sig[two + 1]).sum(1) >= least * k]
                out += zip(node[two], node[two + 1], strict=True)
            for b, e in zip(begin, end, strict=True):
                if e - b > 2 and size[b] <= FULL:
                    for i, j in _alike(sig[b:e], sig[b:e], least):
                        out += zip(node[b:e][i[i < j]], node[b:e][j[i < j]], strict=True)
                elif e - b > 2:
                    _search(node, rest, sig, np.arange(b, e), 0, most, least, out)
            pairs = np.array(out, np.int64).reshape(-1, 2)
            pairs = np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1), axis=0)
            return keep, pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=EDGE)

        for batch in batches:
            if not batch.num_rows:
                continue
            c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            sig = np.frombuffer(b"".join(c["sig"].to_pylist()), np.uint16).reshape(-1, k)
            new = tuple(np.asarray(c[n]) for n in ("bucket", "rest", "node", "in_bucket")) + (sig,)
            if held:
                new = tuple(np.concatenate([x, y]) for x, y in zip(held[0], new, strict=True))
            keep, edges = flush(*new, last=False)
            held = [tuple(x[keep] for x in new)]
            yield edges
        if held:
            yield flush(*held[0], last=True)[1]

    ordered = rows.select("bucket", "rest", "node", "in_bucket", "sig").repartition("bucket").sortWithinPartitions("bucket", "rest", "node")
    return ordered.mapInArrow(tk.thrifty(search), "a long, b long").distinct()


def missed(rows: DataFrame, sigs: DataFrame, found: DataFrame, k: int, least: float) -> DataFrame:
    """All pairs (a, b) of nodes in one bucket that are alike by signature and that `found` (node, root) doesn't join yet.

    rows: bucket, node, in_bucket. Every row of a bucket is compared with every other, whatever the
    bucket's size: it is split into parts of about BLOCK rows, and each two parts make one block.
    """

    def compare(table: pa.Table) -> pa.Table:
        node, root, part = (np.asarray(table[n]) for n in ("node", "root", "part"))
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint16).reshape(-1, k)
        lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
        x, y = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
        got = [np.zeros((0, 2), np.int64)]
        for i, j in _alike(sig[x], sig[y], least):
            i, j = x[i], y[j]
            some = root[i] != root[j]
            if lo == hi:
                some &= i < j
            got.append(np.sort(np.stack([node[i[some]], node[j[some]]], axis=1), axis=1))
        pairs = np.unique(np.concatenate(got), axis=0)
        return pa.Table.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=EDGE)

    rooted = rows.select("bucket", "node", "in_bucket").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = shared.written(rooted, "rooted")
    split = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
    parts = F.ceil(F.col("in_bucket") / BLOCK)
    blocks = rooted.join(split, "bucket", "left_semi").withColumn("part", F.pmod(F.xxhash64("node"), parts))
    blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    blocks = blocks.select("bucket", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "node", "root")
    return blocks.join(sigs.select("node", "sig"), "node").groupBy("bucket", "lo", "hi").applyInArrow(compare, "a long, b long").distinct()


def alike(rows: DataFrame, sigs: DataFrame, sets_of: Callable[[DataFrame], DataFrame], k: int, most: int, least: float, threshold: float) -> DataFrame:
    """Verified edges (a, b) that join all nodes which a bucket of `rows` holds together and whose exact Jaccard is at least the threshold.

    rows: as shared_only() gives them; sigs: node, sig; sets_of: the (node, set) of the nodes of some
    edges. Large buckets are searched through leaders first. Then all their pairs that are alike by
    signature and not joined by what was verified are verified too.
    """
    edges = shared.written(bucket_edges(rows.join(sigs, "node"), k, most, least), "edge")
    sure = shared.written(verified(edges, sets_of(edges), threshold), "sure")
    dense = rows.where(F.col("in_bucket") > FULL)
    if dense.isEmpty():
        return sure
    again = shared.written(missed(dense, sigs, shared.components(sure), k, least), "edge")
    return sure if again.isEmpty() else sure.union(verified(again, sets_of(again), threshold))


def shared_only(rows: DataFrame) -> DataFrame:
    """Rows whose bucket holds at least two, with their number, in_bucket; written, as they are read again."""
    return shared.written(rows.withColumn("in_bucket", F.count("*").over(Window.partitionBy("bucket"))).where("in_bucket > 1").distinct(), "bucket")


def stars(rows: DataFrame) -> DataFrame:
    """(bucket, lead, node): each node but the least of its bucket, with that one; buckets of one node give none.

    rows: bucket, node. Buckets stream by in order, so that a task holds one batch however large they are.
    """

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # bucket, lead and node of the row before
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, node = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            fresh = np.ones(len(bucket), bool)
            fresh[1:] = bucket[1:] != bucket[:-1]
            other = fresh.copy()
            other[1:] |= node[1:] != node[:-1]
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(bucket)), 0))
            lead = node[begin]
            if last is not None and last[0] == bucket[0]:
                lead = np.where(begin == 0, last[1], lead)
                other[0] = node[0] != last[2]
            last = bucket[-1], lead[-1], node[-1]
            some = other & (node != lead)
            yield pa.RecordBatch.from_arrays([pa.array(bucket[some]), pa.array(lead[some]), pa.array(node[some])], names=["bucket", "lead", "node"])

    ordered = rows.select("bucket", "node").repartition("bucket").sortWithinPartitions("bucket", "node")
    return ordered.mapInArrow(tk.thrifty(link), "bucket long, lead long, node long")


def verified(edges: DataFrame, sets: DataFrame, threshold: float, kind: type = np.uint32) -> DataFrame:
    """Edges (a, b) whose shingle sets (node, set) have an exact Jaccard of at least the threshold."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = pa.array([tk.jaccard(p, q, kind) >= threshold for p, q in zip(x, y, strict=True)], pa.bool_())
            yield batch.select([0, 1]).filter(ok)

    a = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a"))
    b = sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
    return edges.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b").mapInArrow(tk.thrifty(judge), "a long, b long")

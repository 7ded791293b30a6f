"""All links of a bucket by exact Jaccard, with effort in proportion to its rows however many they are."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from . import textkernels as tk

#: Sets of one size in one bucket: up to so many are compared with the whole bucket, more of them meet in the subsets they share.
FEW = 8192
#: Pairs that are looked at in one step, pairs that are verified in one step, keys that are made in one step.
STEP, PAIRS, KEYS = 1 << 18, 4096, 1 << 19


def least_shared(m: int, n: int, threshold: float) -> int:
    """Fewest common elements with which sets of m and n have a Jaccard of at least the threshold; m + n + 1 if none are enough."""
    return next((k for k in range(1, min(m, n) + 1) if k / (m + n - k) >= threshold), m + n + 1)


def _needs(width: int, threshold: float) -> np.ndarray:
    return np.array([[least_shared(m, n, threshold) for n in range(width + 1)] for m in range(width + 1)])


def _matrix(sets: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """uint64[sets, width] of the sets' elements, filled up with the number of the column, and the sets' sizes."""
    size = np.fromiter(map(len, sets), np.int64, len(sets)) // 8
    values = np.tile(np.arange(width, dtype=np.uint64), (len(sets), 1))
    values[np.arange(width) < size[:, None]] = np.frombuffer(b"".join(sets), np.uint64)
    return values, size


def _sketch(values: np.ndarray, size: np.ndarray, shift: int) -> np.ndarray:
    """64 parities of each set; those of two sets differ in at most as many as there are elements in only one of them."""
    bits = np.uint64(1) << ((values >> np.uint64(shift)) & np.uint64(63))
    return np.bitwise_xor.reduce(np.where(np.arange(values.shape[1]) < size[:, None], bits, np.uint64(0)), axis=1)


def _pairs(values: np.ndarray, size: np.ndarray, root: np.ndarray, lo: np.ndarray, hi: np.ndarray, need: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j), j from lo[i] to hi[i], that are alike and join what root and the pairs before don't join yet."""
    width = values.shape[1]
    apart = np.add.outer(np.arange(width + 1), np.arange(width + 1)) - 2 * need  # below 0: can't be alike
    labels, label = np.unique(root, return_inverse=True)
    sketches = [_sketch(values, size, s) for s in (3, 35)]
    count = hi - lo
    total = np.concatenate([[0], np.cumsum(count)])
    at = 0
    while at < len(root):
        to = max(at + 1, int(np.searchsorted(total, total[at] + STEP, "right")) - 1)
        i = np.repeat(np.arange(at, to), count[at:to])
        j = np.arange(total[at], total[to]) + np.repeat(lo[at:to] - total[at:to], count[at:to])
        at = to
        some = label[i] != label[j]
        i, j = i[some], j[some]
        for s in sketches:
            some = np.bitwise_count(s[i] ^ s[j]) <= apart[size[i], size[j]]
            i, j = i[some], j[some]
        for k in range(0, len(i), PAIRS):
            x, y = i[k : k + PAIRS], j[k : k + PAIRS]
            some = label[x] != label[y]
            x, y = x[some], y[some]
            both = (values[x][:, :, None] == values[y][:, None, :]).sum((1, 2)) - (width - np.maximum(size[x], size[y]))
            some = both >= need[size[x], size[y]]
            x, y = x[some], y[some]
            if len(x):
                ends = np.sort(np.stack([label[x], label[y]], axis=1), axis=1)
                one = np.unique(ends, axis=0, return_index=True)[1]
                yield x[one], y[one]
                joined, low = shared.joined(ends[:, 0], ends[:, 1])
                moved = np.arange(len(labels))
                moved[joined] = low
                label = moved[label]


def _compared(blocks: DataFrame, width: int, threshold: float) -> DataFrame:
    """Links (a, b) of the blocks (bucket, part, few, node, root, set): few rows with all of their block, once with each other."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        need = _needs(width, threshold)

        def links(t: pa.Table) -> pa.RecordBatch:
            bucket, part, few, node, root = (np.asarray(t[n]) for n in ("bucket", "part", "few", "node", "root"))
            edge = np.flatnonzero((bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])) + 1
            begin, end = np.concatenate([[0], edge]), np.concatenate([edge, [len(bucket)]])
            hi = np.repeat(end, end - begin)
            others = np.repeat(begin + np.add.reduceat(few.astype(np.int64), begin), end - begin)  # few rows come first
            here = np.arange(len(bucket))
            lo = np.where(few, np.where(part == 0, here + 1, others), hi)
            values, size = _matrix(t["set"].to_pylist(), width)
            got = [(here[:0], here[:0]), *_pairs(values, size, root, lo, hi, need)]
            i, j = (np.concatenate(x) for x in zip(*got, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], names=["a", "b"])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            bucket, part = np.asarray(held["bucket"]), np.asarray(held["part"])
            before = np.flatnonzero((bucket != bucket[-1]) | (part != part[-1]))
            if len(before):  # the last block may go on
                yield links(held.slice(0, before[-1] + 1))
                held = held.slice(before[-1] + 1)
        if held is not None:
            yield links(held)

    ordered = blocks.repartition("bucket", "part").sortWithinPartitions("bucket", "part", F.desc("few"))
    return ordered.mapInArrow(tk.thrifty(compare), "a long, b long")


def _met(crowd: DataFrame, width: int, threshold: float) -> DataFrame:
    """Links (a, b) that join all alike sets of `crowd` (node, size, other, set), those of `size` elements with those of `other`.

    Sets of m and n elements are alike just if they share a subset of least_shared(m, n) elements, so
    each set has a key for each of its subsets of that many, and all sets of a key belong together.
    Where m and n differ, two sets of one size may differ too much, so that a key needs both sizes.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        need = _needs(width, threshold)
        for batch in batches:
            values, size = _matrix(batch.column(3).to_pylist(), width)
            node, other = np.asarray(batch.column(0)), np.asarray(batch.column(2)).astype(np.int64)
            for m, n in np.unique(np.stack([size, other], axis=1), axis=0):
                if need[m, n] > min(m, n):
                    continue
                choices = list(itertools.combinations(range(m), m - need[m, n]))  # one that is empty if all elements are needed
                left_out = np.array(choices, np.int64).reshape(len(choices), m - need[m, n])
                rows, step = np.flatnonzero((size == m) & (other == n)), max(1, KEYS // len(left_out))
                tag = tk.mix(np.array([min(m, n) * (width + 1) + max(m, n)], np.uint64))
                for k in range(0, len(rows), step):
                    of = rows[k : k + step]
                    v = tk.mix(values[of, :m])
                    key = tk.mix((v.sum(1, dtype=np.uint64)[:, None] - v[:, left_out].sum(2, dtype=np.uint64)).ravel() ^ tag)
                    again = np.repeat(node[of], len(left_out))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), pa.array(again), pa.array(np.full(len(key), m, np.int32)), pa.array(np.full(len(key), n, np.int32))], names=["key", "node", "size", "other"]
                    )

    made = crowd.select("node", "size", "other", "set").mapInArrow(tk.thrifty(keys), "key long, node long, size int, other int")
    by = Window.partitionBy("key")
    met = made.select("node", "size", "other", F.min("node").over(by).alias("lead"), F.min("size").over(by).alias("low"), F.max("size").over(by).alias("high"))
    return met.where("lead <> node and (size = other or low < high)").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()


def links(rows: DataFrame, sets: DataFrame, found: DataFrame, width: int, threshold: float) -> DataFrame:
    """Links (a, b) that, with `found`, join all nodes of one bucket whose sets have an exact Jaccard of at least the threshold.

    rows: bucket, node; sets: node, set (of at most `width` distinct uint64, as bytes), one row a node;
    found: node, root, of what is joined already. Buckets that `found` joins as a whole are passed
    over. No pair is left out: where a bucket holds at most FEW sets of a size, each of them is
    compared with all sets of the bucket; larger classes meet through the subsets that alike sets
    must share. So there are at most FEW pairs for each row and size, whatever the bucket's size,
    and only links are written, never candidates. Pairs that others join already are left out;
    sets of two large classes may be joined through a third without being alike.
    """
    sized = rows.select("bucket", "node").distinct().join(found, "node", "left").join(sets.select("node", (F.octet_length("set") / 8).cast("int").alias("size")), "node")
    rooted = shared.written(sized.select("bucket", "node", "size", F.coalesce("root", "node").alias("root")), "rooted")
    classes = rooted.groupBy("bucket", "size").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    many = F.col("n") > FEW
    split = classes.groupBy("bucket").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.collect_list(F.when(many, F.col("size"))).alias("many"), F.sum(F.when(many, F.col("n")).otherwise(0)).alias("crowd"))
    split = shared.written(split.where("low <> high").select("bucket", "many", F.greatest(F.ceil(F.col("crowd") / FEW), F.lit(1)).cast("int").alias("parts")), "split")
    of = rooted.join(split, "bucket").withColumn("few", ~F.array_contains("many", F.col("size")))
    own = F.array(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    blocks = of.withColumn("part", F.explode(F.when(F.col("few"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(own)))
    out = _compared(blocks.select("bucket", "part", "few", "node", "root").join(sets, "node").select("bucket", "part", "few", "node", "root", "set"), width, threshold)
    if not split.where(F.size("many") > 0).isEmpty():
        crowd = of.where(~F.col("few")).select("node", "size", F.explode("many").alias("other")).distinct()
        out = out.union(_met(crowd.join(sets, "node"), width, threshold))
    return shared.written(out, "links")

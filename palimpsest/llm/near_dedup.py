"""MinHash near-duplicate search by an LSH forest of sorted signature orders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import regions, shared
from . import textkernels as tk

TREES, DEPTH, LEAST_DEPTH, SHINGLE, THRESHOLD = 20, 6, 3, 3, 0.5
#: Signature agreement from which a pair is verified: the threshold less about 2.5 standard errors.
SLACK = 0.12


def _sources(docs: DataFrame) -> DataFrame:
    """(doc_id, th, text) of the rows that take part; th, a hash of the text, tells apart different texts under one doc_id."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text").where("doc_id is not null and text is not null")


def signatures(docs: DataFrame, shingle: int = SHINGLE, k: int = TREES * DEPTH) -> DataFrame:
    """(doc_id, th, h1, h2, sig) of each document with an id and at least one token."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tk.plain(batch.column(2))
            for a, b in tk.slices(texts):
                t = tk.tokenise(texts.slice(a, b - a))
                sh, first = t.shingles(shingle)
                some = np.diff(t.first) > 0
                sig = tk.minhash(sh, first, k)[some]
                h1 = t.texts()[some].view(np.int64)
                t.hashes = tk.mix(t.hashes ^ np.uint64(0x9E3779B97F4A7C15))
                ids = [batch.column(i).slice(a, b - a).filter(pa.array(some)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(h1), pa.array(t.texts()[some].view(np.int64)), tk.fixed_binary(sig)], names=["doc_id", "th", "h1", "h2", "sig"])

    return _sources(docs).mapInArrow(tk.thrifty(sign), "doc_id long, th long, h1 long, h2 long, sig binary")


def forest(sigs: DataFrame, trees: int = TREES, depth: int = DEPTH, least_depth: int = LEAST_DEPTH) -> DataFrame:
    """(bucket, rest, node): for each tree the first least_depth values, and those after them."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node = np.asarray(batch.column(0))
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(len(node), -1).astype(np.int64)
            for t in range(trees):
                v = sig[:, t * depth : (t + 1) * depth]
                bucket, rest = np.full(len(node), t, np.int64), np.zeros(len(node), np.int64)
                for i in range(depth):
                    if i < least_depth:
                        bucket = (bucket << 16) | v[:, i]
                    else:
                        rest = (rest << 16) | v[:, i]
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(rest), pa.array(node)], names=["bucket", "rest", "node"])

    return sigs.select("node", "sig").mapInArrow(tk.thrifty(grow), "bucket long, rest long, node long")


def shingle_sets(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(node, set) of every row of (node, text)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tk.plain(batch.column(1))
            for a, b in tk.slices(texts):
                sets = tk.sets(*tk.tokenise(texts.slice(a, b - a)).shingles(shingle))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sets, pa.binary())], names=["node", "set"])

    return docs.select("node", "text").mapInArrow(tk.thrifty(make), "node long, set binary")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """Groups of near duplicates: (doc_id, text_hash, group_id, keep), one row for each document in a group of two or more.

    Documents are alike when the Jaccard of their sets of `shingle`-token windows (by 32-bit hashes)
    is at least `threshold`; groups are the connected components. The first by (doc_id, text_hash) is
    the one to keep, its doc_id the group_id. Documents with equal tokens are joined first, by two
    64-bit hashes, so that thousands of copies cost one signature. The others go into TREES sorted
    orders of their signatures, DEPTH values each: those that share the first LEAST_DEPTH values of
    an order form a region. Pairs of a region that the whole signature finds alike are verified by
    exact Jaccard; a large region is searched through leaders and deeper orders first, then all its
    pairs that aren't joined yet are compared, so recall doesn't depend on a region's size.

    text_hash is xxhash64(text): different texts under one doc_id are documents of their own, rows
    that repeat both are one. Null doc_id or null text, and texts without a token, are in no group.
    Other columns are ignored. An empty table gives an empty result.
    """
    k = TREES * DEPTH
    sigs = shared.written(signatures(docs, shingle, k), "sig")
    members = sigs.select("doc_id", "th", "h1", "h2").distinct()
    least = members.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "th")).alias("at"), F.count("*").alias("n"))
    least = shared.written(least.select("h1", "h2", F.col("at.doc_id").alias("least_id"), F.col("at.th").alias("least_th"), "n"), "least")
    copies = members.join(shared.small(least.where("n > 1"), 48), ["h1", "h2"]).where("doc_id <> least_id or th <> least_th")
    copies = shared.small(shared.written(copies.select("doc_id", "th"), "copy"), 24)
    # nodes are numbered once and written, as the numbers follow the files
    reps = shared.written(sigs.join(copies, ["doc_id", "th"], "left_anti").withColumn("node", F.monotonically_increasing_id()), "reps")

    def sets_of(edges: DataFrame) -> DataFrame:
        nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
        wanted = reps.select("node", "doc_id", "th").join(shared.small(shared.written(nodes, "node"), 16), "node", "left_semi")
        wanted = shared.small(shared.written(wanted, "wanted"), 32)
        return shingle_sets(_sources(docs).join(wanted, ["doc_id", "th"]), shingle).dropDuplicates(["node"])

    sure = regions.alike(regions.shared_only(forest(reps)), reps.select("node", "sig"), sets_of, k, DEPTH - LEAST_DEPTH, threshold - SLACK, threshold)
    found = shared.components(sure)
    # groups: all documents of joined nodes, and those with equal tokens
    rooted = reps.select("node", "h1", "h2").join(shared.small(found, 24), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = shared.written(rooted.select("root", "h1", "h2").distinct(), "rooted")
    sizes = rooted.join(least, ["h1", "h2"]).groupBy("root").agg(F.sum("n").alias("size"), F.min(F.struct("least_id", "least_th")).alias("first")).where("size > 1")
    grouped = shared.written(rooted.join(sizes.select("root", "first.*"), "root").select("h1", "h2", F.col("least_id").alias("group_id"), F.col("least_th").alias("group_th")), "grouped")
    out = members.join(shared.small(grouped, 40), ["h1", "h2"])
    return out.select("doc_id", F.col("th").alias("text_hash"), "group_id", ((F.col("doc_id") == F.col("group_id")) & (F.col("th") == F.col("group_th"))).alias("keep"))


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """docs without the documents that near_duplicates() doesn't keep; of rows that repeat a doc_id and its text one stays.

    Documents are told apart by doc_id and text, so another text under the same doc_id is judged by
    itself. Rows with a null doc_id or text stay as they are, as do extra columns, whatever their
    names; of repeated rows any one stays. Empty tables pass through.
    """
    gone = groups.where("not keep").select(F.col("doc_id").alias("__drop_id"), F.col("text_hash").alias("__drop_hash"))
    gone = shared.small(shared.written(gone, "gone"), 24)
    left = docs.join(gone, (F.col("doc_id") == F.col("__drop_id")) & (F.xxhash64("text") == F.col("__drop_hash")), "left_anti")
    per = left.where("doc_id is not null and text is not null").groupBy(F.col("doc_id").alias("__again_id"), F.xxhash64("text").alias("__again_hash")).agg(F.count("*").alias("n"))
    again = shared.written(per.where("n > 1").drop("n"), "again")
    if again.isEmpty():
        return left
    same = (F.col("doc_id") == F.col("__again_id")) & (F.xxhash64("text") == F.col("__again_hash"))
    again = shared.small(again, 24)
    return left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(shared.table(spark, sf_dir, "documents")).drop("text_hash")

"""Helpers that the training-data operators share: written tables, size-checked joins, components."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in bytes, that is broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 64 << 20
#: Most edges whose components are found on the driver, 16 bytes each.
MEMORY_EDGES = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a folder beside the warehouse is used on one machine (tests); a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-work"
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as Parquet into the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table that written() made; call it only when nothing reads it any more."""
    path = getattr(df, "_written_at", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, of fixed-width rows, marked for broadcast if its counted rows fit the limit, else as it is (a shuffled join).

    The count runs df, so give it a written table.
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def beside(df: DataFrame, name: str, row_bytes: Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, written, and marked for broadcast if the bytes that row_bytes gives for its rows sum up to at most the limit."""
    df = written(df, name)
    return F.broadcast(df) if (df.agg(F.sum(row_bytes)).first()[0] or 0) <= limit else df


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and their components' least nodes, of edges in memory: labels fall to the least neighbour's and jump along, until none does."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low, was = np.minimum(label[x], label[y]), label
        label = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label = label[label]
        if (label == was).all():
            return nodes, nodes[label]


def components(edges: DataFrame, max_rounds: int = 60, in_memory: int = MEMORY_EDGES) -> DataFrame:
    """Connected components of edges (a, b) as (node, root); root is the least node.

    Alternating large-star and small-star rounds: least neighbours by an aggregation that combines
    before its shuffle, then a join that puts them beside the edges; every round is written to the
    shared folder, so a lost executor costs one round at most. Up to `in_memory` edges, counted, are
    joined on the driver instead, with the same result. Self-loops and null ends are ignored; an
    empty table gives an empty result. Rounds grow with the logarithm of the nodes; components that
    aren't finished after max_rounds are an error.
    """
    spark = edges.sparkSession
    e = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")
    ).distinct()
    cur, seen = written(e, "cc"), None
    if cur.count() <= in_memory:
        got = cur.toArrow()
        node, root = joined(np.asarray(got["u"]), np.asarray(got["v"]))
        return written(spark.createDataFrame(pa.table({"node": pa.array(node, pa.int64()), "root": pa.array(root, pa.int64())})), "roots")
    for _ in range(max_rounds):
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "cc")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = written(low.select("u", F.col("m").alias("v")).union(down).where("u <> v").distinct(), "cc")
        discard(large)
        state = nxt.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 7))")).first()
        discard(cur)
        cur = nxt
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components are not finished after {max_rounds} rounds")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def without_columns(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that would clash (compared without case) with those an operator adds."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])

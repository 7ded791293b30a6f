"""Strategies: each rewrites the blocks of a turn. A registry of DataFrame transforms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codecs as C
from . import cost

MODES = {"payg": ("none", "lossless", "naive", "aggressive"), "subscription": ("none", "lossless")}


def none(turns: DataFrame) -> DataFrame:
    return turns


def aggressive(turns: DataFrame) -> DataFrame:
    return turns.withColumn("text", F.substring("text", 1, 120))


def naive(turns: DataFrame) -> DataFrame:
    """Everything compressed anew each turn, with a mark of the turn on what could be cached."""
    new = C.udf(lambda t, k: C.tier0(C.tier1(t, k)))(F.col("text"), F.col("kind"))
    mark = F.concat(F.lit("\n<<recompressed@t"), F.col("turn_idx").cast("string"), F.lit(">>"))
    return turns.withColumn("text", new).withColumn("text", F.when(F.col("stability") != "volatile", F.concat("text", mark)).otherwise(F.col("text")))


def stabilize(turns: DataFrame) -> DataFrame:
    """Values that change lifted out of stable blocks into one volatile block at the turn's end, if there are any."""
    stable = turns.where("stability = 'stable'").withColumn("n", C.udf(lambda t: len(C.lift(t)[1]), "int")("text"))
    some = stable.where("n > 0")
    lifted = some.withColumn("v", C.udf(lambda t, i: "; ".join(f"{i}:⟦V{k}⟧={v}" for k, v in enumerate(C.lift(t)[1], 1)))(F.col("text"), F.col("block_id")))
    extra = lifted.groupBy("traj_id", "turn_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]), "; ").alias("v"))
    last = turns.groupBy("traj_id", "turn_idx").agg((F.max("pos") + 1).alias("pos"))
    extra = extra.join(last, ["traj_id", "turn_idx"]).select(
        "traj_id", "turn_idx", "pos", F.lit("volatile-context").alias("block_id"), F.lit("user").alias("kind"), F.lit("volatile").alias("stability"),
        F.concat(F.lit("[volatile fields lifted from the cached prefix: "), "v", F.lit("]")).alias("text"),
    )
    out = turns.withColumn("text", F.when(F.col("stability") == "stable", C.udf(lambda t: C.lift(t)[0])("text")).otherwise(F.col("text")))
    cols = ["traj_id", "turn_idx", "pos", "block_id", "kind", "stability", "text"]
    return out.select(*cols).unionByName(extra.withColumn("pos", F.col("pos").cast(turns.schema["pos"].dataType)).select(*cols))


def lossless(turns: DataFrame) -> DataFrame:
    """Stabilised, what can be cached first, then the volatile blocks compressed without loss and never longer."""
    t = stabilize(turns)
    new = C.udf(C.lossless)(F.col("text"), F.col("kind"))
    t = t.withColumn("text", F.when(F.col("stability") == "volatile", cost.no_bigger(new, F.col("text"))).otherwise(F.col("text")))
    return t.withColumn("pos", F.row_number().over(Window.partitionBy("traj_id", "turn_idx").orderBy(F.col("stability") == "volatile", "pos")) - 1)


REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {"none": none, "lossless": lossless, "naive": naive, "aggressive": aggressive}


def apply(name: str, turns: DataFrame) -> DataFrame:
    return turns.transform(REGISTRY[name])


def guard(name: str, mode: str) -> str:
    """The strategy's name, if the billing mode allows it."""
    if name not in MODES[mode]:
        raise PermissionError(f"{name} is not allowed in {mode} mode")
    return name

"""Best-fit packing by linear grouping: few rounded sizes, optimised configurations, then small pieces into the gaps."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

CAPACITY, GROUPS, SMALL, PER_SHARD, SUB = 2048, 32, 1 / 8, 100_000, 64


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Bins for `demand` items of each size as (copies of each size, times): column generation, rounded down, then patterns for the rest."""
    n = len(sizes)
    if not n:
        return []
    s, d = np.array(sizes), np.array(demand, float)
    columns = [np.eye(n)[i] * (capacity // s[i]) for i in range(n)]
    basis = np.array(columns).T
    x = np.linalg.solve(basis, d)

    def knapsack(value: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
        best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        if most is None:
            for c in range(1, capacity + 1):
                fit = np.flatnonzero(s <= c)
                best[c] = best[c - 1]
                if len(fit):
                    v = best[c - s[fit]] + value[fit]
                    if v.max() > best[c] + 1e-12:
                        best[c], pick[c] = v.max(), fit[v.argmax()]
            out, c = np.zeros(n), capacity
            while c > 0:
                if pick[c] < 0:
                    c -= 1
                else:
                    out[pick[c]] += 1
                    c -= s[pick[c]]
            return out
        took = []
        for i in range(n):
            count = np.zeros(capacity + 1, int)
            for _ in range(int(min(most[i], capacity // s[i]))):
                with_one = np.full(capacity + 1, -1.0)
                with_one[s[i] :] = best[: capacity + 1 - s[i]] + value[i]
                more = with_one > best + 1e-12
                shifted = np.zeros(capacity + 1, int)
                shifted[s[i] :] = count[: capacity + 1 - s[i]] + 1
                best, count = np.where(more, with_one, best), np.where(more, shifted, count)
            took.append(count)
        out, c = np.zeros(n), capacity
        for i in reversed(range(n)):
            out[i] = took[i][c]
            c -= int(out[i]) * s[i]
        return out

    for _ in range(20 * n):
        duals = np.linalg.solve(basis.T, np.ones(n))
        new = knapsack(np.maximum(duals, 0))
        if new @ duals <= 1 + 1e-9:
            break
        step = np.linalg.solve(basis, new)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = new
        x = np.maximum(x - ratio[out] * step, 0)
        x[out] = ratio[out]
    left, plan = np.array(demand), []
    for j in range(n):
        times = int(x[j] + 1e-9)
        col = basis[:, j].astype(int)
        if times:
            plan.append((col, times))
            left = left - col * times
    surplus = np.maximum(-left, 0)
    left = np.maximum(left, 0)
    assert not surplus.any()
    while left.any():
        col = knapsack(s.astype(float), left).astype(int)
        times = max(1, int((left[col > 0] // col[col > 0]).min()))
        plan.append((col, times))
        left = left - col * times
    return [(c.tolist(), t) for c, t in plan]


def pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, begin, length): white-space tokens and one end mark, in pieces of at most the capacity."""
    n = F.regexp_count("text", F.lit("\\S+")).cast("long") + 1
    d = docs.select(F.col("doc_id").cast("long"), n.alias("total")).where("total > 1")
    d = d.select("doc_id", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / capacity))).alias("piece"))
    begin = F.col("piece") * capacity
    return d.select("doc_id", "piece", begin.alias("begin"), F.least(F.lit(capacity).cast("long"), F.col("total") - begin).alias("length"))


def pack(docs: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, small_share: float = SMALL, per_shard: int = PER_SHARD) -> DataFrame:
    """Bins of at most `capacity` tokens: (doc_id, piece, begin, length, bin), one row for each piece of each document.

    A document's length is its white-space tokens and one end mark; one longer than the capacity is
    cut into full pieces and a rest. Pieces above small_share of the capacity are ranked by length
    and cut into `groups` groups of equal cardinality; with each length rounded up to its group's
    largest, few sizes are left, for which the driver solves the configurations (its work depends
    on groups and capacity alone). Actual pieces then take the slots by rank within their group,
    and small pieces go by best fit, longest first, into the gaps, in shards of about per_shard
    rows that grow in number with the input.

    Documents without text or tokens, or with null text, have no piece. A null doc_id is packed like
    any other; rows that repeat a doc_id are packed each. Ties in length are broken by doc_id and
    piece. Other columns are ignored. An empty table gives an empty result.
    """
    every = shared.written(pieces(docs, capacity), "pieces")
    limit = int(capacity * small_share)
    sub = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SUB))
    # a full piece is a bin by itself, named by what it holds; only repeats of an id need a number
    is_full = F.col("length") == capacity
    times = F.row_number().over(Window.partitionBy("name").orderBy("piece")) - 1
    name = F.concat(F.lit("F"), F.coalesce(F.concat("doc_id", F.lit("-"), "piece"), F.concat(F.lit("-"), F.monotonically_increasing_id())))
    full = every.where(is_full).withColumn("name", name).withColumn("times", times)
    full = full.select("doc_id", "piece", "begin", "length", F.concat("name", F.when(F.col("times") > 0, F.concat(F.lit("-"), "times")).otherwise("")).alias("bin"))
    large = every.where(~is_full & (F.col("length") > limit)).withColumn("sub", sub)
    # at most capacity * SUB rows, whatever the input; so no window below grows with one length
    counts = large.groupBy("length", "sub").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy(F.desc("length"), "sub").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("length", "sub", F.coalesce(before, F.lit(0)).alias("before"), "n")
    row = F.row_number().over(Window.partitionBy("length", "sub").orderBy("doc_id", "piece")) - 1
    ranked = large.withColumn("row", row).join(F.broadcast(counts.drop("n")), ["length", "sub"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("row"))
    rest = every.where(~is_full & (F.col("length") > limit)).count()
    group = F.floor(F.col("rank") * groups / F.lit(max(1, rest))).cast("int")
    ranked = shared.written(ranked.withColumn("grp", group).select("doc_id", "piece", "begin", "length", "rank", "grp"), "ranked")
    stats = ranked.groupBy("grp").agg(F.max("length").alias("size"), F.count("*").alias("n"), F.min("rank").alias("lo")).orderBy("grp").collect()
    # groups whose rounded size is the same are one size
    sizes = sorted({r["size"] for r in stats})
    demand = [sum(r["n"] for r in stats if r["size"] == z) for z in sizes]
    plan, slots, base = configurations(sizes, demand, capacity), [], 0
    at = dict.fromkeys(sizes, 0)
    for copies, times in plan:
        for z, m in zip(sizes, copies, strict=True):
            if m:
                slots.append((z, at[z], at[z] + m * times, m, base))
                at[z] += m * times
        base += times
    # a slot's size, from which rank to which, copies in a bin, first bin
    spark = docs.sparkSession
    first = {z: min(r["lo"] for r in stats if r["size"] == z) for z in sizes}
    by_grp = spark.createDataFrame([(r["grp"], r["size"], first[r["size"]]) for r in stats], "grp int, size long, lo long")
    slot = spark.createDataFrame(slots, "size long, from_slot long, to_slot long, copies long, base long")
    placed = ranked.join(F.broadcast(by_grp), "grp").withColumn("slot", F.col("rank") - F.col("lo"))
    placed = placed.join(F.broadcast(slot), "size").where("slot >= from_slot and slot < to_slot")
    placed = placed.withColumn("bin_no", F.expr("base + (slot - from_slot) div copies"))
    placed = shared.written(placed.select("doc_id", "piece", "begin", "length", "bin_no"), "placed")
    tiny = every.where(F.col("length") <= limit)
    shards = max(1, -(-(tiny.count() + base) // per_shard))
    gaps = placed.groupBy("bin_no").agg((F.lit(capacity) - F.sum("length")).alias("gap"))
    zero = F.lit(0).cast("long")
    # no nulls, so that pandas keeps whole numbers
    both = gaps.select(
        F.pmod(F.xxhash64("bin_no"), F.lit(shards)).alias("shard"), F.lit(True).alias("is_gap"), F.lit(False).alias("no_id"), F.col("bin_no").alias("id"), zero.alias("piece"), zero.alias("begin"), F.col("gap").alias("length")
    ).union(tiny.select(F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)), F.lit(False), F.col("doc_id").isNull(), F.coalesce("doc_id", zero), "piece", "begin", "length"))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["shard"].iloc[0])
        bins, items = rows[rows["is_gap"]].sort_values("id"), rows[~rows["is_gap"]]
        items = items.sort_values(["length", "no_id", "id", "piece"], ascending=[False, True, True, True])
        stacks: dict[int, list[str]] = {}
        for b, g in zip(bins["id"], bins["length"], strict=True):
            stacks.setdefault(int(g), []).append(f"C{b}")
        gaps_, new, names = sorted(stacks), 0, []
        for n in items["length"]:
            i = bisect.bisect_left(gaps_, n)
            if i < len(gaps_):
                g = gaps_[i]
                name = stacks[g].pop()
                if not stacks[g]:
                    del stacks[g], gaps_[i]
            else:
                g, name, new = capacity, f"S{shard}-{new}", new + 1
            left = int(g - n)
            if left in stacks:
                stacks[left].append(name)
            elif left:
                stacks[left] = [name]
                bisect.insort(gaps_, left)
            names.append(name)
        return items[["no_id", "id", "piece", "begin", "length"]].assign(bin=pd.Series(names, index=items.index, dtype=object))

    fitted = both.groupBy("shard").applyInPandas(fit, "no_id boolean, id long, piece long, begin long, length long, bin string")
    fitted = fitted.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "piece", "begin", "length", "bin")
    filled = placed.select("doc_id", "piece", "begin", "length", F.concat(F.lit("C"), F.col("bin_no").cast("string")).alias("bin"))
    return full.union(filled).union(fitted)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(shared.table(spark, sf_dir, "documents"))

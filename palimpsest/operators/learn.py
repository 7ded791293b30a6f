"""The keep model: labelled lines, a logistic fit over their distinct feature vectors, and its evaluation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import line_ops

KEEP_FROM = 0.6


def dataset(blocks: DataFrame) -> DataFrame:
    """(block_id, line_no, line, features..., label): 1 where the heuristic score reaches KEEP_FROM; duplicates stay."""
    x = line_ops.explode_lines(blocks)
    return x.select("block_id", "line_no", "line", *T.features("line"), (T.keep_score("line") >= KEEP_FROM).cast("double").alias("label"))


def bucket(column: str, divisor: float = 4294967295.0) -> Column:
    """A text's place in [0, 1] by hash; the hold-out of trajectories divides by 2**32, that of lines by 2**32 - 1."""
    return F.conv(F.substring(F.sha2(F.col(column), 256), 1, 8), 16, 10).cast("double") / divisor


def fit(data: DataFrame, epochs: int = 400, rate: float = 0.5, l2: float = 1e-4) -> list[float]:
    """Weights by full-batch descent from zero.

    Lines with the same features and label are one weighted row; features are shares of lengths up
    to 120 and flags, so rounded to 2 places there are some 10^5 of them, with a bound that doesn't grow
    with the lines: those come to the driver, whatever the input.
    """
    rounded = [F.round(c, 2).alias(c) for c in T.FEATURES]
    h = data.select(*rounded, "label").groupBy(*T.FEATURES, "label").agg(F.count("*").alias("n"))
    m = h.toPandas()
    x, y, n = m[list(T.FEATURES)].to_numpy(float), m["label"].to_numpy(float), m["n"].to_numpy(float)
    step = lambda w: ((1 / (1 + np.exp(-np.clip(x @ w, -60, 60))) - y) * n) @ x / max(1.0, n.sum())

    w = np.zeros(len(T.FEATURES))
    for _ in range(epochs):
        g = step(w)
        g[1:] += l2 * w[1:]
        w -= rate * g
    return w.tolist()


def probability(weights: list[float]) -> Column:
    """The fitted score over feature columns; blank lines score 0."""
    z = sum((F.col(c) * float(v) for c, v in zip(T.FEATURES, weights, strict=True)), F.lit(0.0))
    return F.when(F.col("blank") == 1, 0.0).otherwise(1 / (1 + F.exp(-z)))


def evaluate(scored: DataFrame) -> DataFrame:
    """(tp, fp, fn, tn, accuracy, precision, recall, f1) of columns label and p."""
    yes, pos = F.col("p") >= 0.5, F.col("label") == 1
    g = scored.agg(F.count_if(yes & pos).alias("tp"), F.count_if(yes & ~pos).alias("fp"), F.count_if(~yes & pos).alias("fn"), F.count_if(~yes & ~pos).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    safe = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    return g.select("*", safe(tp + tn, tp + fp + fn + tn).alias("accuracy"), safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"))


def causal_labels(lines: DataFrame) -> DataFrame:
    """(line, label): distinct lines; keep (1) wins where both occur."""
    return lines.groupBy("line").agg(F.max("label").alias("label"))


def holdout(trajectories: DataFrame, share: float) -> DataFrame:
    """(control, n, base, sent, savings) of trajectories (key, base, comp): a share of them, by hash, is sent in full."""
    x = trajectories.withColumn("control", bucket("key", 4294967296.0) < share)
    g = x.groupBy("control").agg(F.count("*").alias("n"), F.sum("base").cast("long").alias("base"), F.sum(F.when(F.col("control"), F.col("base")).otherwise(F.col("comp"))).cast("long").alias("sent"))
    return g.withColumn("savings", 1 - F.try_divide("sent", "base"))


def retrain(labels: DataFrame, test_share: float = 0.2) -> tuple[list[float], DataFrame]:
    """Weights fitted on labelled lines (line, label), and how they do on a share held out by hash, or on all where that is empty."""
    data = labels.select("line", *T.features("line"), F.col("label").cast("double").alias("label")).withColumn("held", bucket("line") < test_share)
    weights = fit(data.where("not held"))
    held = data.where("held")
    judged = data if held.isEmpty() else held
    return weights, evaluate(judged.withColumn("p", probability(weights)))


def certify_promotion(turns: DataFrame, weights: list[float], ratio: float = 0.7) -> DataFrame:
    """(trajectories, passed): how many keep all their decisions when the model prunes blocks without one to a ratio of their lines."""
    from . import certify

    z = sum((c * float(v) for c, v in zip(T.features("line"), weights, strict=True)), F.lit(0.0))
    score = F.when(F.trim("line") == "", 0.0).otherwise(F.least(1 / (1 + F.exp(-z)), F.lit(0.999999)))
    b = turns.withColumn("block_id", F.concat_ws(":", "traj_id", "turn_idx", "pos"))
    inert = F.size(certify.drivers("text")) == 0
    pruned = line_ops.apply_keep(b.where(inert).select("block_id", "text"), ratio, score)
    out = b.where(inert).drop("text").join(pruned, "block_id").select("traj_id", "turn_idx", "text").unionByName(b.where(~inert).select("traj_id", "turn_idx", "text"))
    same = certify.paired(certify.decide(turns), certify.decide(out), ("traj_id", "turn_idx")).groupBy("traj_id").agg((~F.bool_or("changed")).alias("ok"))
    return same.agg(F.count("*").alias("trajectories"), F.count_if("ok").alias("passed"))


def online_round(turns: DataFrame) -> DataFrame:
    """One round: causal labels of the turns' lines, a model, its evaluation, its certificate, and whether it is promoted (every trajectory passed)."""
    from . import certify

    lines = line_ops.explode_lines(turns.select(F.concat_ws(":", "traj_id", "turn_idx", "pos").alias("block_id"), "text"))
    labels = causal_labels(lines.select("line", (F.size(certify.drivers("line")) > 0).cast("int").alias("label")))
    weights, metrics = retrain(labels)
    verdict = certify_promotion(turns, weights)
    return metrics.select("tp", "fp", "fn", "tn", "accuracy").crossJoin(verdict).withColumn("promoted", (F.col("trajectories") > 0) & (F.col("passed") == F.col("trajectories")))  # one row each

"""Decisions, ablation, risk levels and certificates: sufficient statistics in Spark, closed forms on a row for each level."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

from ..functions import stats as S
from ..functions import text as T

NO_DECISION = "<no-op>"


def drivers(text: str) -> Column:
    """What follows each decision mark, trimmed, without empty ones."""
    found = F.regexp_extract_all(F.col(text), F.lit(T.DECISION + r"([^\n]*)"), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != "")


def decide(turns: DataFrame, text: str = "text", keys: Sequence[str] = ("traj_id", "turn_idx")) -> DataFrame:
    """(keys, decision): the sorted bag of a turn's drivers, or the sign that there is none."""
    bag = F.array_join(F.array_sort(F.flatten(F.collect_list(drivers(text)))), " | ")
    return turns.groupBy(*keys).agg(F.coalesce(F.nullif(bag, F.lit("")), F.lit(NO_DECISION)).alias("decision"))


def smoke_decision(turns: DataFrame, keys: Sequence[str] = ("traj_id", "turn_idx")) -> DataFrame:
    """(keys, decision): act: and the start of a SHA-1 over the sorted facts of volatile lines with three or more fields, folds left out."""
    clean = F.regexp_replace("text", r"<<[^>]*handle=[^>]*>>", "")
    fields = lambda x: F.regexp_extract_all(x, F.lit(r"\b([A-Za-z_][\w.]*=[\w.:/+-]+)"), F.lit(1))
    facts = F.flatten(F.transform(F.filter(F.split(clean, "\n"), lambda x: F.size(fields(x)) >= 3), fields))
    v = turns.withColumn("facts", F.when(F.col("stability") == "volatile", facts).otherwise(F.array().cast("array<string>")))
    all_ = F.array_sort(F.array_distinct(F.flatten(F.collect_list("facts"))))
    return v.groupBy(*keys).agg(all_.alias("f")).select(*keys, F.when(F.size("f") == 0, F.lit(NO_DECISION)).otherwise(F.concat(F.lit("act:"), F.substring(F.sha1(F.array_join("f", "|")), 1, 12))).alias("decision"))


def ablation(turns: DataFrame) -> DataFrame:
    """(traj_id, block_id, occurrences, max_tokens, prunable): removing an id drops all its blocks; it matters where one holds a driver."""
    t = turns.withColumn("n", F.size(drivers("text"))).withColumn("tok", T.token_count("text"))
    return t.groupBy("traj_id", "block_id").agg(F.count("*").alias("occurrences"), F.max("tok").alias("max_tokens"), (F.max("n") == 0).alias("prunable"))


def prune(turns: DataFrame, report: DataFrame) -> DataFrame:
    return turns.join(report.where("prunable").select("traj_id", "block_id"), ["traj_id", "block_id"], "left_anti")


def paired(base: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, changed) of two decision tables."""
    return base.withColumnRenamed("decision", "d0").join(other.withColumnRenamed("decision", "d1"), list(keys)).select(*keys, (F.col("d0") != F.col("d1")).alias("changed"))


def level_stats(losses: DataFrame) -> DataFrame:
    """(level_idx, level, n, risk, var, savings) of a losses table (level_idx, level, loss, base_tok, comp_tok)."""
    g = losses.groupBy("level_idx", "level").agg(F.count("*").alias("n"), F.avg("loss").alias("risk"), F.coalesce(F.var_samp("loss"), F.lit(0.0)).alias("var"), F.sum("base_tok").alias("b"), F.sum("comp_tok").alias("c"))
    return g.select("level_idx", "level", "n", "risk", "var", F.when(F.col("b") == 0, 0.0).otherwise(1 - F.col("c") / F.col("b")).alias("savings"))


@F.pandas_udf(DoubleType())
def hb_pvalue(risk: pd.Series, n: pd.Series, alpha: pd.Series) -> pd.Series:
    return pd.Series([S.hb_p(r, int(k), a) for r, k, a in zip(risk, n, alpha, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def hb_upper(risk: pd.Series, n: pd.Series, delta: pd.Series) -> pd.Series:
    return pd.Series([S.hb_bound(r, int(k), d) for r, k, d in zip(risk, n, delta, strict=True)], dtype=float)


@F.pandas_udf(BooleanType())
def hb_passes(risk: pd.Series, n: pd.Series, alpha: pd.Series, delta: pd.Series) -> pd.Series:
    """Whether hb_p rejects at delta; Bentkus's sum only where Hoeffding's form doesn't decide."""
    return pd.Series([k > 0 and r < a and (S.hoeffding_p(r, int(k), a) <= d or S.hb_p(r, int(k), a) <= d) for r, k, a, d in zip(risk, n, alpha, delta, strict=True)], dtype=bool)


def fixed_sequence(levels: DataFrame, ok: Column) -> DataFrame:
    """levels with `passed`: the level and all less aggressive ones before it satisfy ok. One row a level, so one partition is enough."""
    return levels.withColumn("passed", F.min(ok.cast("int")).over(Window.orderBy("level_idx").rowsBetween(Window.unboundedPreceding, 0)) == 1)


def ltt(losses: DataFrame, alpha: float, delta: float) -> DataFrame:
    """Fixed-sequence testing: level statistics, p_value, bound and passed."""
    p = level_stats(losses).withColumn("p_value", hb_pvalue("risk", "n", F.lit(alpha))).withColumn("bound", hb_upper("risk", "n", F.lit(delta)))
    return fixed_sequence(p, F.col("p_value") <= delta)


def crc(losses: DataFrame, alpha: float) -> DataFrame:
    """Conformal risk control: corrected risk (n risk + 1) / (n + 1) and passed."""
    c = level_stats(losses).withColumn("corrected", (F.col("n") * F.col("risk") + 1) / (F.col("n") + 1))
    return fixed_sequence(c, F.col("corrected") <= alpha)


def certificate(passed: DataFrame) -> DataFrame:
    """The level that saves most within the certified sequence, the first of equals; no row if none passed."""
    return passed.where("passed").orderBy(F.desc("savings"), "level_idx").limit(1)


def tost_table(diffs: DataFrame, keys: Sequence[str], margin: float = 0.02, alpha: float = 0.05) -> DataFrame:
    """(keys, n, mean, p_lower, p_upper, non_inferior, equivalent) of a column `diff`."""
    g = diffs.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("diff").alias("mean"), F.coalesce(F.var_samp("diff"), F.lit(0.0)).alias("var"))

    @F.pandas_udf("p_lower double, p_upper double, non_inferior boolean, equivalent boolean")
    def test(n: pd.Series, mean: pd.Series, var: pd.Series) -> pd.DataFrame:
        rows = [S.tost(int(a), b, c, margin, alpha) for a, b, c in zip(n, mean, var, strict=True)]
        return pd.DataFrame(rows, columns=["p_lower", "p_upper", "non_inferior", "equivalent"])

    return g.withColumn("t", test("n", "mean", "var")).select(*keys, "n", "mean", "t.*")


def drift(events: DataFrame, keys: Sequence[str], alpha: float = 0.05, delta: float = 0.05, most: float = 0.5) -> DataFrame:
    """Running evidence that the mean loss exceeds alpha: keys, i, loss, stake, capital, tripped.

    events: keys, seq, loss. Capital is the product of 1 + stake (loss - alpha), each stake known
    before its loss; every factor is positive, so it is the exponential of a running sum. Once it
    reaches 1/delta the monitor stays tripped and the capital frozen.
    """
    import math

    w = Window.partitionBy(*keys).orderBy("seq")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    e = events.withColumn("i", F.row_number().over(w)).withColumn("mu", (0.5 + F.sum("loss").over(upto)) / (1 + F.col("i")))
    e = e.withColumn("sq", F.pow(F.col("loss") - F.col("mu"), F.lit(2.0)))
    var = F.when(F.col("i") == 1, 0.25).otherwise((0.25 + F.sum("sq").over(before)) / F.col("i"))
    e = e.withColumn("stake", F.least(F.lit(most), F.sqrt(2 * math.log(1 / delta) / (var * F.col("i")))))
    e = e.withColumn("free", F.exp(F.sum(F.log(1 + F.col("stake") * (F.col("loss") - alpha))).over(upto)))
    e = e.withColumn("trip", F.min(F.when(F.col("free") >= 1 / delta, F.col("i"))).over(Window.partitionBy(*keys)))
    e = e.withColumn("at_trip", F.min(F.when(F.col("i") == F.col("trip"), F.col("free"))).over(Window.partitionBy(*keys)))
    tripped = F.col("i") >= F.coalesce("trip", F.col("i") + 1)
    return e.select(*keys, "i", "loss", "stake", F.when(tripped, F.col("at_trip")).otherwise(F.col("free")).alias("capital"), tripped.alias("tripped"))


def speculative_threshold(scores: DataFrame, alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """(threshold, n, misses, bound): the highest score whose kept set (scores below it) has a certified miss rate of at most alpha.

    scores: score, diverged. Counts by distinct score come first, so the ordering window runs over
    distinct scores, in rows of four numbers. Each is tested at alpha; a bound is searched for the one that is chosen.
    """
    g = scores.groupBy("score").agg(F.count("*").alias("k"), F.sum(F.col("diverged").cast("int")).alias("m"))
    w = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    c = g.select(F.col("score").alias("threshold"), F.coalesce(F.sum("k").over(w), F.lit(0)).alias("n"), F.coalesce(F.sum("m").over(w), F.lit(0)).alias("misses"))
    risk = F.col("misses") / F.greatest("n", F.lit(1))
    best = c.where((F.col("n") == 0) | hb_passes(risk, "n", F.lit(alpha), F.lit(delta))).orderBy(F.desc("threshold")).limit(1)
    return best.withColumn("bound", F.when(F.col("n") == 0, 0.0).otherwise(hb_upper(risk, "n", F.lit(delta))))


def ensemble(votes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, any_changed, majority, unanimous) over graders' votes."""
    g = votes.groupBy(*keys).agg(F.sum(F.col("vote").cast("int")).alias("yes"), F.count("*").alias("n"))
    return g.select(*keys, (F.col("yes") > 0).alias("any_changed"), (F.col("yes") * 2 > F.col("n")).alias("majority"), (F.col("yes") == F.col("n")).alias("unanimous"))


def certified_fallback(graded: DataFrame, target: float = 1.0) -> DataFrame:
    """Per turn the first rung of the ladder that keeps the decision, within a budget the top rung where it saves most.

    graded: traj_id, turn_idx, rung_idx, rung, same, tokens; the last rung is the unchanged text. Of a
    trajectory's turns int((1 - target) * turns) may take the top rung though it changes the decision.
    """
    top = F.min_by(F.struct("rung_idx", "rung", "tokens"), "rung_idx")
    ok = graded.where("same").groupBy("traj_id", "turn_idx").agg(top.alias("safe"))
    t = graded.groupBy("traj_id", "turn_idx").agg(top.alias("top"), F.max_by(F.struct("rung_idx", "rung", "tokens"), "rung_idx").alias("full")).join(ok, ["traj_id", "turn_idx"], "left")
    t = t.withColumn("safe", F.coalesce("safe", "full")).withColumn("gain", F.col("safe.tokens") - F.col("top.tokens"))
    w = Window.partitionBy("traj_id")
    budget = F.floor(F.lit(1 - target) * F.count("*").over(w) + 1e-6)
    rank = F.row_number().over(Window.partitionBy("traj_id").orderBy(F.desc(F.when(F.col("gain") > 0, F.col("gain")).otherwise(0)), "turn_idx"))
    t = t.withColumn("budget", budget).withColumn("rank", rank)
    spend = (F.col("gain") > 0) & (F.col("rank") <= F.col("budget"))
    pick = F.when(spend, F.col("top")).otherwise(F.col("safe"))
    return t.withColumn("pick", pick).select("traj_id", "turn_idx", F.col("pick.rung").alias("rung"), F.col("pick.tokens").alias("tokens"), spend.alias("diverges"))


def fallback_breakdown(chosen: DataFrame) -> DataFrame:
    return chosen.groupBy("rung").agg(F.count("*").alias("turns"), F.sum("tokens").alias("tokens"))


def operating_point(points: DataFrame, margin: float = 0.05) -> DataFrame:
    """Of paired counts (name, gate_recent, b, c, n), the smallest gate_recent that isn't inferior; no row means full context."""
    p = points.select("name", "gate_recent", "n", *S.mcnemar_columns(F.col("b"), F.col("c"), F.col("n"), margin))
    return p.where("noninferior").orderBy("gate_recent").limit(1)


def bandit(arms: Sequence[tuple[str, int]], draw, margin: float = 0.05, budget: int = 4000, batch: int = 40, least: int = 30) -> dict:
    """Successive elimination over operating points: draw(name, k) gives (losses, gains) of k paired samples, one aggregate in Spark."""
    state = {name: [recent, 0, 0, 0] for name, recent in sorted(arms, key=lambda a: a[1])}
    alive, used = list(state), 0

    def interval(name):
        _, b, c, n = state[name]
        se = (max(0.0, ((b + c) - (b - c) ** 2 / n) / n**2)) ** 0.5 if n else 0.0
        return ((c - b) / n - S.Z95 * se, (c - b) / n + S.Z95 * se) if n else (-1.0, 1.0)

    while alive and used < budget:
        for name in list(alive):
            k = min(batch, budget - used)
            if k:
                b, c = draw(name, k)
                s = state[name]
                s[1], s[2], s[3] = s[1] + b, s[2] + c, s[3] + k
                used += k
            if interval(name)[1] < -margin:
                alive.remove(name)
        if alive and state[alive[0]][3] >= least and interval(alive[0])[0] > -margin:
            break
    good = [n for n in state if state[n][3] >= least and interval(n)[0] > -margin]
    return {"chosen": good[0] if good else None, "used": used, "counts": {n: tuple(s[1:]) for n, s in state.items()}}


def trajectory_risk(outcomes: DataFrame, alpha: float = 0.05, delta: float = 0.05, least: int = 20) -> DataFrame:
    """(n, risk, p_value, bound, certified) of degraded tasks (full succeeded, compressed did not); under `least` pairs nothing is certified."""
    loss = (F.col("full_success") & ~F.col("compressed_success")).cast("double")
    g = outcomes.agg(F.count("*").alias("n"), F.coalesce(F.avg(loss), F.lit(1.0)).alias("risk"))
    few = F.col("n") < least
    g = g.withColumn("p_value", F.when(few, 1.0).otherwise(hb_pvalue("risk", "n", F.lit(alpha)))).withColumn("bound", F.when(few, 1.0).otherwise(hb_upper("risk", "n", F.lit(delta))))
    return g.withColumn("certified", F.col("p_value") <= delta)


def split_coverage(losses: DataFrame, alpha: float, delta: float, reps: int = 100) -> DataFrame:
    """Repeated half splits by trajectory: certify on one half, measure on the other: rep, level, realised risk and whether it is covered.

    losses: traj_id, level_idx, level, loss. Losses are summed by trajectory and level first; the
    splits then multiply those sums, not the turns, and are hash draws, so they repeat.
    """
    s = losses.groupBy("traj_id", "level_idx", "level").agg(F.sum("loss").alias("s"), F.count("*").alias("n"))
    r = s.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("cal", F.conv(F.substring(F.sha2(F.concat_ws(":", "traj_id", "rep"), 256), 1, 8), 16, 10).cast("long") % 2 == 0)
    g = r.groupBy("rep", "level_idx", "level").agg(*[F.coalesce(F.sum(F.when(F.col("cal") == c, F.col(v))), F.lit(0)).alias(f"{v}{int(c)}") for v in ("s", "n") for c in (True, False)])
    p = g.withColumn("p_value", hb_pvalue(F.when(F.col("n1") > 0, F.col("s1") / F.col("n1")).otherwise(1.0), F.col("n1"), F.lit(alpha)))
    w = Window.partitionBy("rep").orderBy("level_idx").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("passed", F.min((F.col("p_value") <= delta).cast("int")).over(w) == 1)
    best = p.where("passed").groupBy("rep").agg(F.max_by(F.struct("level", (F.col("s0") / F.greatest("n0", F.lit(1))).alias("risk")), "level_idx").alias("b"))
    return best.select("rep", F.col("b.level").alias("level"), F.col("b.risk").alias("risk"), (F.col("b.risk") <= alpha).alias("covered"))


@F.pandas_udf(DoubleType())
def mcnemar_p(b: pd.Series, c: pd.Series) -> pd.Series:
    """Exact two-sided McNemar p-value of discordant counts."""
    return pd.Series([S.mcnemar_exact(int(x), int(y)) for x, y in zip(b, c, strict=True)], dtype=float)


def trajectory_bound(totals: DataFrame, alpha: float) -> DataFrame:
    """A row (n, diverged, turns) with what a risk of alpha for each turn comes to over `turns` of them.

    naive_bound takes turns as independent, union_bound adds them up; k_exact and k_linear say after
    how many turns that matter the observed divergence would be reached, consequential their share.
    """
    import math

    t, d = F.col("turns"), F.try_divide("diverged", "n")
    return totals.select(
        "n", "diverged", F.round(t, 6).alias("mean_turns"), F.round(1 - F.pow(F.lit(1 - alpha), t), 6).alias("naive_bound"), F.round(t * alpha, 6).alias("union_bound"),
        F.round(F.when((d > 0) & (d < 1), F.log(1 - d) / math.log(1 - alpha)), 6).alias("k_exact"), F.round(d / alpha, 6).alias("k_linear"), F.round(d / alpha / t, 6).alias("consequential"),
    )


def sample_ids(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n distinct keys first in the order of a hash of key and seed: a sample that repeats, whatever the partitions."""
    k = rows.select(key).distinct()
    return k.orderBy(F.sha2(F.concat(F.col(key).cast("string"), F.lit(":" + seed)), 256), key).limit(n)


def against_gold(decisions: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """decisions (key, decision) with gold, resolved and agrees of (key, gold, resolved); null where there is no gold."""
    return decisions.join(gold, key, "left").withColumn("agrees", F.when(F.col("gold").isNotNull(), F.col("gold") == F.col("decision")))


def route(scores: DataFrame, threshold: DataFrame) -> DataFrame:
    """scores (..., score) with `route`: full from the threshold on, else compressed; without a threshold all go in full."""
    t = threshold.agg(F.min("threshold").alias("threshold"))  # one row
    return scores.crossJoin(F.broadcast(t)).withColumn("route", F.when(F.col("score") < F.col("threshold"), "compressed").otherwise("full")).drop("threshold")


def from_scores(base: DataFrame, candidates: DataFrame, margin: float = 0.05) -> DataFrame:
    """Points (name, gate_recent, n, b, c, delta, noninferior) of candidates (name, id, resolved) on the tasks that the base (id, resolved) has too."""
    j = candidates.join(base.select("id", F.col("resolved").alias("base")), "id")
    g = j.groupBy("name").agg(F.count("*").alias("n"), F.count_if(F.col("base") & ~F.col("resolved")).alias("b"), F.count_if(~F.col("base") & F.col("resolved")).alias("c"))
    g = g.withColumn("gate_recent", F.dense_rank().over(Window.orderBy("name")))  # a row for each candidate
    return g.select("name", "gate_recent", "n", "b", "c", *S.mcnemar_columns(F.col("b"), F.col("c"), F.col("n"), margin))

"""Operators over the lines of blocks. Each keys its windows by block, so one exchange of lines serves all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def explode_lines(blocks: DataFrame, split: Column | None = None) -> DataFrame:
    """(block_id, line_no, line, and the block's other columns but its text), lines from 0."""
    keep = [c for c in blocks.columns if c != "text"]
    return blocks.select(*keep, F.posexplode(T.lines("text") if split is None else split).alias("line_no", "line"))


def join_lines(lines: DataFrame, value: str = "line") -> DataFrame:
    """(block_id, text) of lines put together in order."""
    parts = F.array_sort(F.collect_list(F.struct("line_no", F.col(value).alias("v"))))
    return lines.groupBy("block_id").agg(F.array_join(F.transform(parts, lambda x: x["v"]), "\n").alias("text"))


def collapse_runs(blocks: DataFrame) -> DataFrame:
    """(block_id, text): two or more equal lines that end in a line feed become one and a count.

    A run whose line looks like such a count stays, and a last line without a line feed is in no run.
    """
    raw = F.split("text", "\n", -1)
    x = blocks.select("block_id", F.size(raw).alias("n"), F.posexplode(raw).alias("line_no", "line"))
    x = x.withColumn("ended", F.col("line_no") < F.col("n") - 1)
    by = Window.partitionBy("block_id").orderBy("line_no")
    same = F.col("ended") & (F.lag("line").over(by) == F.col("line")) & F.lag("ended").over(by)
    x = x.withColumn("new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("new").over(by))
    runs = x.groupBy("block_id", "run").agg(F.min("line_no").alias("line_no"), F.count("*").alias("k"), F.first("line").alias("line"))
    marker = F.col("line").rlike(r"^<<x[0-9]+>>$")
    repeated = F.expr("array_join(array_repeat(line, cast(k as int)), '\n')")
    out = F.when(F.col("k") == 1, F.col("line")).when(marker, repeated).otherwise(F.concat("line", F.lit("\n<<x"), F.col("k").cast("string"), F.lit(">>")))
    return join_lines(runs.select("block_id", "line_no", out.alias("line")))


def classified(blocks: DataFrame) -> DataFrame:
    """Lines with the block's number of lines, content kind, handle and outcome (green, red or unknown, from verdict lines)."""
    b = blocks.withColumn("kind", T.content_kind("text")).withColumn("handle", T.handle("text")).withColumn("n", F.size(T.lines("text")))
    x = explode_lines(b).withColumn("verdict", F.col("line").rlike(T.VERDICT))
    whole = Window.partitionBy("block_id")
    red = F.max((F.col("verdict") & F.col("line").rlike(T.RED)).cast("int")).over(whole)
    some = F.max(F.col("verdict").cast("int")).over(whole)
    return x.withColumn("outcome", F.when(red == 1, "red").when(some == 1, "green").otherwise("unknown"))


def digest_lines(blocks: DataFrame, max_repeats: int | None = None, head: int = 3, tail: int = 1) -> DataFrame:
    """classified() lines and whether the digest keeps each.

    Kept: the first `head` and last `tail` lines, answers (decisions and verdicts), and of the other
    lines that must be kept the first of each shape: one in a green log, else two.
    """
    x = classified(blocks)
    answer = F.col("line").contains(T.DECISION) | F.col("verdict")
    x = x.withColumn("noise", T.must_keep("line", "kind") & ~answer).withColumn("shape", T.shape("line"))
    nth = F.row_number().over(Window.partitionBy("block_id", "shape", "noise").orderBy("line_no"))
    most = F.lit(max_repeats) if max_repeats is not None else F.when(F.col("outcome") == "green", 1).otherwise(2)
    edge = (F.col("line_no") < head) | (F.col("line_no") >= F.col("n") - tail) | (F.col("n") <= head + tail + 1)
    return x.withColumn("keep", edge | answer | (F.col("noise") & (nth <= most))).drop("noise", "shape")


def fold_dropped(lines: DataFrame) -> DataFrame:
    """(block_id, text): each run of dropped lines becomes one marker with its length and the block's handle."""
    by = Window.partitionBy("block_id").orderBy("line_no")
    x = lines.withColumn("new", F.when(F.col("keep") | F.coalesce(F.lag("keep").over(by), F.lit(True)), 1).otherwise(0)).withColumn("run", F.sum("new").over(by))
    runs = x.groupBy("block_id", "run").agg(F.min("line_no").alias("line_no"), F.count("*").alias("k"), F.first("keep").alias("keep"), F.first("line").alias("line"), F.first("handle").alias("handle"))
    mark = F.concat(F.lit("<< +"), F.col("k").cast("string"), F.lit(" lines, handle="), "handle", F.lit(" >>"))
    return join_lines(runs.select("block_id", "line_no", F.when(F.col("keep"), F.col("line")).otherwise(mark).alias("line")))


def digest(blocks: DataFrame, **how) -> DataFrame:
    return fold_dropped(digest_lines(blocks, **how))


def apply_keep(blocks: DataFrame, ratio: float, score: Column | None = None) -> DataFrame:
    """(block_id, text): all lines that score 1 and the best others, ceil(ratio * lines) in all; ties by order."""
    x = explode_lines(blocks.withColumn("n", F.size(T.lines("text")))).withColumn("score", T.keep_score("line") if score is None else score)
    sure = F.sum((F.col("score") >= 1).cast("int")).over(Window.partitionBy("block_id"))
    rank = F.row_number().over(Window.partitionBy("block_id", F.col("score") >= 1).orderBy(F.desc("score"), "line_no"))
    room = F.greatest(F.lit(0), F.ceil(F.lit(ratio) * F.col("n")) - F.col("sure"))
    x = x.withColumn("sure", sure).withColumn("rank", rank)
    return join_lines(x.where((F.col("score") >= 1) | (F.col("rank") <= room)))


def extractive(blocks: DataFrame, keep: float = 0.6) -> DataFrame:
    """(block_id, text) without the int(n * (1 - keep)) least informative lines, earlier ones first; short blocks as they are."""
    raw = F.split("text", "\n", -1)
    x = explode_lines(blocks.withColumn("n", F.size(raw)), raw).withColumn("info", T.informativeness("line"))
    rank = F.row_number().over(Window.partitionBy("block_id").orderBy("info", "line_no"))
    drop = F.when(F.col("n") <= 3, 0).otherwise(F.floor(F.col("n") * F.lit(1 - keep)))
    return join_lines(x.withColumn("rank", rank).where(F.col("rank") > drop))


def summarize_ends(blocks: DataFrame, most: int = 6) -> DataFrame:
    """(block_id, text): first and last line that isn't blank, with a count between; blocks of up to `most` such lines as they are."""
    full = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")
    short = F.concat(F.element_at(full, 1), F.lit("\n…["), (F.size(full) - 2).cast("string"), F.lit(" lines summarised]…\n"), F.element_at(full, -1))
    return blocks.select("block_id", F.when(F.size(full) <= most, F.col("text")).otherwise(short).alias("text"))


def text_window(blocks: DataFrame, head: int = 400, tail: int = 200, first: int = 6, last: int = 4) -> DataFrame:
    """(block_id, text): the first and last lines and the most informative ones between, up to head + tail characters.

    A line is added while the room is positive, so the last one may overshoot. Texts of at most
    head + tail characters stay; texts of few lines keep their first and last characters.
    """
    raw = F.split("text", "\n", -1)
    b = blocks.withColumn("chars", F.length("text")).withColumn("n", F.size(raw))
    keys = ["block_id", "chars", "n"]
    x = b.where((F.col("chars") > head + tail) & (F.col("n") > first + last + 1)).select(*keys, F.posexplode(raw).alias("line_no", "line"))
    anchor = (F.col("line_no") < first) | (F.col("line_no") >= F.col("n") - last)
    x = x.withColumn("anchor", anchor).withColumn("info", T.informativeness("line"))
    room = F.lit(head + tail) - F.sum(F.when(F.col("anchor"), F.length("line")).otherwise(0)).over(Window.partitionBy("block_id"))
    spent = F.sum(F.when(F.col("anchor"), 0).otherwise(F.length("line") + 1)).over(Window.partitionBy("block_id", "anchor").orderBy(F.desc("info"), "line_no").rowsBetween(Window.unboundedPreceding, -1))
    x = x.withColumn("keep", F.col("anchor") | (F.coalesce(spent, F.lit(0)) < room))
    kept = x.where("keep")
    gap = F.col("line_no") != F.coalesce(F.lag("line_no").over(Window.partitionBy("block_id").orderBy("line_no")), F.lit(-1)) + 1
    kept = kept.withColumn("line", F.when(gap, F.concat(F.lit("... [elided] ...\n"), "line")).otherwise(F.col("line")))
    windowed = join_lines(kept).withColumnRenamed("text", "out")
    few = F.concat(F.substring("text", 1, head), F.lit("\n... ["), (F.col("chars") - head - tail).cast("string"), F.lit(" chars elided] ...\n"), F.expr(f"right(text, {tail})"))
    j = b.join(windowed, "block_id", "left")
    short = F.when(F.col("chars") <= head + tail, F.col("text")).when(F.col("n") <= first + last + 1, few)
    return j.select("block_id", F.coalesce(short, F.when(F.length("out") < F.col("chars"), F.col("out")), F.col("text")).alias("text"))


def template_runs(blocks: DataFrame, least: int = 5) -> DataFrame:
    """Runs of at least `least` lines that are equal but for their variables: (block_id, first_line, lines, template, variables)."""
    x = blocks.where(~F.col("text").contains(T.DECISION)).select("block_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    x = x.withColumn("mask", F.regexp_replace("line", T.VARIABLE, T.SLOT))
    by = Window.partitionBy("block_id").orderBy("line_no")
    x = x.withColumn("run", F.sum(F.when(F.lag("mask").over(by) == F.col("mask"), 0).otherwise(1)).over(by))
    values = F.array_join(F.regexp_extract_all("line", F.lit(T.VARIABLE), F.lit(0)), " ")
    rows = F.array_sort(F.collect_list(F.struct("line_no", values.alias("v"))))
    g = x.groupBy("block_id", "run").agg(F.min("line_no").alias("first_line"), F.count("*").alias("lines"), F.first("mask").alias("template"), F.array_join(F.transform(rows, lambda r: r["v"]), " | ").alias("variables"))
    return g.where((F.col("lines") >= least) & F.col("template").contains(T.SLOT)).drop("run")


def dropped_summary(lines: DataFrame, error: Column, warn: Column) -> DataFrame:
    """(block_id, summary): 'n error, n warn, n other' over lines, errors first; empty where none is either."""
    g = lines.groupBy("block_id").agg(F.count_if(error).alias("e"), F.count_if(~error & warn).alias("w"), F.count_if(~error & ~warn).alias("o"))
    said = [F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {name}"))) for c, name in (("e", "error"), ("w", "warn"), ("o", "other"))]
    return g.select("block_id", F.when((F.col("e") == 0) & (F.col("w") == 0), "").otherwise(F.array_join(F.array_compact(F.array(*said)), ", ")).alias("summary"))


def smart_digest(blocks: DataFrame, head: int = 400, tail: int = 200) -> DataFrame:
    """(block_id, text): a skeleton of what parses as code, else the text, through a window; a handle of the original if anything went."""
    from ..functions import codecs as C

    b = blocks.withColumn("base", F.coalesce(C.udf(C.code_skeleton)("text"), "text"))
    w = text_window(b.select("block_id", F.col("base").alias("text")), head, tail).withColumnRenamed("text", "out")
    mark = F.concat("out", F.lit("\n<<elided, handle="), T.handle("text"), F.lit(">>"))
    return b.join(w, "block_id").select("block_id", F.when(F.col("out") == F.col("text"), F.col("text")).otherwise(mark).alias("text"))


def digest_history(blocks: DataFrame, least_lines: int = 6) -> DataFrame:
    """Blocks with `sent`, the digest of history blocks of at least least_lines lines, and whether it differs."""
    from ..functions import codecs as C

    long = (F.col("kind") == "history") & (F.size(T.lines("text")) >= least_lines)
    out = F.when(long, C.udf(lambda t: C.tier1(t, "tool_output"))("text")).otherwise(F.col("text"))
    return blocks.withColumn("sent", out).withColumn("digested", F.col("sent") != F.col("text"))

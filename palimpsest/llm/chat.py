"""Chat formatting: logged snapshots that prefix a longer conversation are dropped, maximal ones rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

BEGIN, END = "<|im_start|>", "<|im_end|>\n"


def prefixes(conversations: DataFrame) -> DataFrame:
    """(conv_id, idx, n, p1, p2): after each turn, its number, the number of all and two rolling 64-bit hashes of the turns so far."""
    c = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit("second"), "text", "role").alias("h2"), F.coalesce(F.md5("text"), F.lit("")).alias("tie")
    ).where("conv_id is not null")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "tie")
    c = c.withColumn("idx", F.row_number().over(order))
    upto = Window.partitionBy("conv_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("conv_id")
    return c.select(
        "conv_id", "idx", F.count("*").over(whole).alias("n"),
        F.expr("bit_xor(xxhash64(idx, h1, h2))").over(upto).alias("p1"), F.expr("bit_xor(xxhash64(h2, idx, h1))").over(upto).alias("p2"),
    )


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv_id, copies): conversations that aren't a proper prefix of another; of equal ones the least conv_id stands for all."""
    p = shared.written(prefixes(conversations), "prefixes")
    whole = p.where("idx = n").groupBy("p1", "p2", "n").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    parts = p.where("idx < n").select("p1", "p2", F.col("idx").alias("n")).distinct()
    return whole.join(parts, ["p1", "p2", "n"], "left_anti").select("conv_id", "copies")


def render(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns, copies, rendered) of each maximal conversation.

    Turns are ordered by turn, then role, then MD5 of the text (null first); a prefix is the same roles and
    texts in that order. A conversation that is a proper prefix of another is dropped; of equal ones
    the least conv_id stays and `copies` counts them. Each turn renders as the begin mark, role,
    line feed, text and end mark; a null role or text renders as an empty one. Marks inside a text
    are broken by a space after their first character, so no text can forge a turn; line ends of
    carriage return and line feed become line feeds.

    Rows with a null conv_id are dropped. A repeated row is a turn of its own. Other columns are
    ignored. An empty table gives an empty result.
    """
    top = maximal(conversations)
    safe = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("<|im_"), F.lit("< |im_")), F.lit("\r\n"), F.lit("\n"))
    turn = F.concat(F.lit(BEGIN), F.coalesce("role", F.lit("")), F.lit("\n"), safe, F.lit(END))
    c = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce(F.md5("text"), F.lit("")).alias("tie"), turn.alias("out"))
    c = c.join(shared.small(top, 24), "conv_id")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "tie", "out")))
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.first("copies").alias("copies"), turns.alias("all")).select(
        "conv_id", "turns", "copies", F.array_join(F.transform("all", lambda t: t["out"]), "").alias("rendered")
    )


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(shared.table(spark, sf_dir, "conversations"))


OP6_SQL = """
with t as (select conv_id, row_number() over (partition by conv_id order by turn, coalesce(role, ''), coalesce(md5(text), '')) idx, role, text,
  '<|im_start|>' || coalesce(role, '') || chr(10) || replace(replace(coalesce(text, ''), '<|im_', '< |im_'), chr(13) || chr(10), chr(10)) || '<|im_end|>' || chr(10) as piece,
  md5(coalesce(role, '~') || chr(0) || coalesce(text, '~')) m from conversations where conv_id is not null),
p as (select conv_id, idx, count(*) over (partition by conv_id) n, string_agg(m, '') over (partition by conv_id order by idx) prefix from t),
f as (select prefix, min(conv_id) conv_id, count(*) copies from p where idx = n group by prefix),
top as (select conv_id, copies from f where prefix not in (select prefix from p where idx < n))
select conv_id, count(*) as turns, any_value(copies) as copies, string_agg(piece, '' order by idx) as rendered from t join top using (conv_id) group by conv_id
"""

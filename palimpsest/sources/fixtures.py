"""Blocks, logs and ledgers derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL = "claude-opus-4-8"
KINDS = {"system": ("system", "stable"), "assistant": ("history", "settling"), "tool": ("tool_output", "volatile")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def message_blocks(messages: DataFrame) -> DataFrame:
    """One block for each message: kind and stability by role, position by turn."""
    role = F.col("role")
    kind = F.when(role == "system", "system").when(role == "assistant", "history").when(role == "tool", "tool_output").otherwise("user")
    stab = F.when(role == "system", "stable").when(role == "assistant", "settling").otherwise("volatile")
    return messages.select(
        F.col("conv_id").alias("traj_id"), F.col("turn").alias("pos"), F.concat(F.lit("msg"), F.col("turn").cast("string")).alias("block_id"), kind.alias("kind"), stab.alias("stability"), "text"
    )


def turns(blocks: DataFrame) -> DataFrame:
    """Each turn as the model saw it: turn t holds every block up to position t.

    The blocks are expanded by a range of turn numbers, so no self join is needed: a block at
    position p is in turns p to the last.
    """
    last = blocks.groupBy("traj_id").agg(F.max("pos").alias("last"))
    return blocks.join(last, "traj_id").withColumn("turn_idx", F.explode(F.sequence("pos", "last"))).drop("last")


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(message_blocks(table(spark, sf_dir, "conversations")))


TURNS_SQL = """m as (select conv_id traj_id, turn pos, 'msg' || turn block_id,
  case role when 'system' then 'system' when 'assistant' then 'history' when 'tool' then 'tool_output' else 'user' end kind,
  case role when 'system' then 'stable' when 'assistant' then 'settling' else 'volatile' end stability, text from conversations),
turns as (select a.*, b.pos turn_idx from m a join m b on a.traj_id = b.traj_id and a.pos <= b.pos)"""


def event_line() -> F.Column:
    return F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), F.col("event_type"), F.lit(" user="), F.col("user_id").cast("string"),
        F.lit(" value="), F.floor(F.col("value") * 100).cast("string"),
    )


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log for each user and month: a line for each event and a verdict; (block_id, text)."""
    e = table(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyy-MM").alias("month"), "ts", "event_id", "event_type", event_line().alias("line"))
    g = e.groupBy("user_id", "month").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "line"))).alias("all"), F.count_if(F.col("event_type") == "error").alias("bad"), F.count("*").alias("n"))
    verdict = F.concat((F.col("n") - F.col("bad")).cast("string"), F.lit(" passed, "), F.col("bad").cast("string"), F.lit(" failed"))
    text = F.concat(F.array_join(F.transform("all", lambda x: x["line"]), "\n"), F.lit("\n"), verdict)
    return g.select(F.concat(F.col("user_id").cast("string"), F.lit(":"), "month").alias("block_id"), text.alias("text"))


LOGS_SQL = """ev as (select user_id, strftime(ts, '%Y-%m') mon, ts, event_id, event_type,
  strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || event_type || ' user=' || user_id || ' value=' || floor(value * 100)::bigint as line from events),
logs as (select user_id || ':' || mon block_id, string_agg(line, chr(10) order by ts, event_id) || chr(10) || count(*) filter (event_type <> 'error') || ' passed, ' || count(*) filter (event_type = 'error') || ' failed' as text
  from ev group by user_id, mon)"""


def document_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("block_id"), "text")


DOCS_SQL = "docs as (select doc_id::varchar block_id, text from documents)"

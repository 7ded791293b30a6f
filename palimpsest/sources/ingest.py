"""Readers of trajectories, provider request bodies and ledgers; tolerant of bad lines; and their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codecs as C

TRAJECTORY = "id string, model string, turns array<struct<index int, blocks array<struct<id string, kind string, stability string, decision_relevant boolean, text string>>>>"
BLOCK_COLUMNS = ("traj_id", "model", "turn_idx", "pos", "block_id", "kind", "stability", "decision_relevant", "text")


def read_trajectories(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of trajectory JSON files: the index defaults to the position, stability to volatile, relevance to false."""
    t = spark.read.schema(TRAJECTORY).option("multiLine", True).json(path)
    t = t.select(F.coalesce("id", F.lit("trajectory")).alias("traj_id"), "model", F.posexplode("turns").alias("at", "turn"))
    b = t.select("traj_id", "model", F.coalesce("turn.index", "at").alias("turn_idx"), F.posexplode("turn.blocks").alias("pos", "b"))
    return b.select(
        "traj_id", "model", "turn_idx", "pos", F.col("b.id").alias("block_id"), F.col("b.kind").alias("kind"), F.coalesce("b.stability", F.lit("volatile")).alias("stability"),
        F.coalesce("b.decision_relevant", F.lit(False)).alias("decision_relevant"), F.col("b.text").alias("text"),
    )


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """read_trajectories of the files that manifest.json lists, with their domain and title."""
    m = spark.read.option("multiLine", True).json(f"{folder}/manifest.json").select(F.explode("trajectories").alias("t")).select("t.file", "t.domain", "t.title")
    names = [r["file"] for r in m.select("file").collect()]  # the manifest is a file list, a line for each file
    t = spark.read.schema(TRAJECTORY).option("multiLine", True).json([f"{folder}/{n}" for n in names]).withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    t = t.join(F.broadcast(m), "file").select(F.coalesce("id", F.lit("trajectory")).alias("traj_id"), "model", "domain", "title", F.posexplode("turns").alias("at", "turn"))
    return t.select("traj_id", "model", "domain", "title", F.coalesce("turn.index", "at").alias("turn_idx"), F.posexplode("turn.blocks").alias("pos", "b")).select("traj_id", "model", "domain", "title", "turn_idx", "pos", F.col("b.id").alias("block_id"), F.col("b.kind").alias("kind"), F.coalesce("b.stability", F.lit("volatile")).alias("stability"), F.coalesce("b.decision_relevant", F.lit(False)).alias("decision_relevant"), F.col("b.text").alias("text"))


def write_trajectories(blocks: DataFrame, path: str) -> None:
    per_turn = blocks.groupBy("traj_id", "model", "turn_idx").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("block_id").alias("id"), "kind", "stability", "decision_relevant", "text"))), lambda b: F.struct(b["id"].alias("id"), b["kind"].alias("kind"), b["stability"].alias("stability"), b["decision_relevant"].alias("decision_relevant"), b["text"].alias("text"))).alias("blocks")
    )
    per_turn.groupBy(F.col("traj_id").alias("id"), "model").agg(F.array_sort(F.collect_list(F.struct(F.col("turn_idx").alias("index"), "blocks"))).alias("turns")).write.json(path)


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """(source, turn_idx, body) of JSON lines that parse as objects; others are skipped and turns numbered in order."""
    t = spark.read.text(path).select(F.col("_metadata.file_name").alias("source"), F.monotonically_increasing_id().alias("at"), F.try_parse_json("value").alias("body"))
    t = t.where(F.col("body").isNotNull() & F.schema_of_variant("body").startswith("OBJECT"))
    return t.withColumn("turn_idx", F.row_number().over(Window.partitionBy("source").orderBy("at")) - 1).select("source", "turn_idx", "body")


def _text(v: Column) -> Column:
    """A content value as text: a string, or its text parts joined by line feeds."""
    parts = F.try_variant_get(v, "$", "array<variant>")
    texts = F.filter(F.transform(parts, lambda p: F.when(F.try_variant_get(p, "$.type", "string") == "text", F.try_variant_get(p, "$.text", "string"))), lambda x: x.isNotNull())
    return F.when(F.schema_of_variant(v) == "STRING", F.variant_get(v, "$", "string")).when(parts.isNotNull(), F.array_join(texts, "\n"))


_compact = C.udf(C.minify_json)


def _block(id_: Column, kind: Column, stability: Column, text: Column, order: Column) -> Column:
    return F.struct(order.alias("o"), id_.alias("block_id"), kind.alias("kind"), stability.alias("stability"), text.alias("text"))


def _number(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("source", "turn_idx").orderBy("b.o")
    return rows.withColumn("pos", F.row_number().over(w) - 1).select("source", "turn_idx", "pos", "b.block_id", "b.kind", "b.stability", "b.text")


def messages_blocks(bodies: DataFrame) -> DataFrame:
    """Blocks of message bodies: system and tools stable, user text and tool results volatile, assistant text settling.

    A message of parts gives a block for each text or tool result, msg{i} or msg{i}_{sub} from the
    second on; images and tool calls give none and take no number.
    """
    get = lambda p, t="variant": F.try_variant_get("body", p, t)
    lit, key = F.lit, lambda a, b: F.struct(F.lit(a).cast("int").alias("x"), F.lit(b).cast("int").alias("y"), F.lit(0).alias("z"))
    s = bodies.where(get("$.system").isNotNull()).select("source", "turn_idx", _block(lit("system"), lit("system"), lit("stable"), _text(get("$.system")), key(0, 0)).alias("b"))
    tools = F.try_variant_get("body", "$.tools", "array<variant>")
    t = bodies.where(F.size(tools) > 0).select("source", "turn_idx", _block(lit("tools"), lit("tools"), lit("stable"), _compact(F.to_json(get("$.tools"))), key(1, 0)).alias("b"))
    m = bodies.select("source", "turn_idx", F.posexplode(F.try_variant_get("body", "$.messages", "array<variant>")).alias("i", "m"))
    m = m.select("source", "turn_idx", "i", F.try_variant_get("m", "$.role", "string").alias("role"), F.try_variant_get("m", "$.content", "variant").alias("c"))
    kind = F.when(F.col("type") == "tool_result", "tool_output").when(F.col("role") == "user", "user").when(F.col("role") == "assistant", "history")
    stab = F.when(F.col("kind") == "history", "settling").otherwise("volatile")
    plain = m.where(F.schema_of_variant("c") == "STRING").select("source", "turn_idx", "i", lit(0).alias("j"), "role", lit("text").alias("type"), F.variant_get("c", "$", "string").alias("text"))
    parts = m.select("source", "turn_idx", "i", "role", F.posexplode(F.try_variant_get("c", "$", "array<variant>")).alias("j", "p")).withColumn("type", F.try_variant_get("p", "$.type", "string"))
    parts = parts.where("type in ('text', 'tool_result')")
    text = F.when(F.col("type") == "text", F.coalesce(F.try_variant_get("p", "$.text", "string"), lit(""))).otherwise(F.coalesce(_text(F.try_variant_get("p", "$.content", "variant")), lit("")))
    all_ = plain.union(parts.select("source", "turn_idx", "i", "j", "role", "type", text)).withColumn("kind", kind).where("kind is not null").withColumn("stability", stab)
    sub = F.row_number().over(Window.partitionBy("source", "turn_idx", "i").orderBy("j")) - 1
    all_ = all_.withColumn("sub", sub)
    id_ = F.concat(lit("msg"), F.col("i").cast("string"), F.when(F.col("sub") > 0, F.concat(lit("_"), F.col("sub").cast("string"))).otherwise(""))
    order = F.struct(lit(2).alias("x"), F.col("i").cast("int").alias("y"), F.col("j").cast("int").alias("z"))
    return _number(s.union(t).union(all_.select("source", "turn_idx", _block(id_, F.col("kind"), F.col("stability"), F.col("text"), order).alias("b"))))


def chat_blocks(bodies: DataFrame) -> DataFrame:
    """Blocks of chat-completion bodies: the last system message, tools, then messages; empty user and assistant texts give none."""
    lit, key = F.lit, lambda a: F.struct(F.lit(a).cast("int").alias("x"), F.lit(0).alias("y"))
    m = bodies.select("source", "turn_idx", F.posexplode(F.try_variant_get("body", "$.messages", "array<variant>")).alias("i", "m"))
    m = m.select("source", "turn_idx", "i", F.try_variant_get("m", "$.role", "string").alias("role"), F.coalesce(_text(F.try_variant_get("m", "$.content", "variant")), lit("")).alias("text"))
    s = m.where("role = 'system'").groupBy("source", "turn_idx").agg(F.max_by("text", "i").alias("text"))
    s = s.select("source", "turn_idx", _block(lit("system"), lit("system"), lit("stable"), F.col("text"), key(0)).alias("b"))
    tools = F.try_variant_get("body", "$.tools", "array<variant>")
    t = bodies.where(F.size(tools) > 0).select("source", "turn_idx", _block(lit("tools"), lit("tools"), lit("stable"), _compact(F.to_json(F.try_variant_get("body", "$.tools", "variant"))), key(1)).alias("b"))
    kind = F.when(F.col("role") == "user", "user").when(F.col("role") == "assistant", "history").when(F.col("role") == "tool", "tool_output")
    rest = m.withColumn("kind", kind).where("kind is not null and (text <> '' or role = 'tool')")
    stab = F.when(F.col("kind") == "history", "settling").otherwise("volatile")
    order = F.struct(lit(2).alias("x"), F.col("i").cast("int").alias("y"))
    return _number(s.union(t).union(rest.select("source", "turn_idx", _block(F.concat(lit("msg"), F.col("i").cast("string")), F.col("kind"), stab, F.col("text"), order).alias("b"))))


def read_ledger(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines) of a JSON-lines ledger; a row that isn't an object of the schema counts as bad."""
    how = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    both = spark.read.text(path).where("trim(value) <> ''").select(F.from_json("value", f"{schema}, _bad string", how).alias("r"), "value")
    bad = F.col("r._bad").isNotNull()
    return both.where(~bad).select("r.*").drop("_bad"), both.where(bad).select("value")


def append(rows: DataFrame, path: str, by: str | None = None) -> None:
    w = rows.write.mode("append")
    (w.partitionBy(by) if by else w).parquet(path)


def dialogue_turns(messages: DataFrame) -> DataFrame:
    """Decision points of tool dialogues (id, i, role, content, call): each assistant call closes a turn; (id, turn_idx, history, observations, gold)."""
    w = Window.partitionBy("id").orderBy("i")
    m = messages.withColumn("turn_idx", F.coalesce(F.sum(F.col("call").isNotNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    seen = F.collect_list(F.when(F.col("role") != "system", F.struct("i", "role", "content"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    m = m.withColumn("history", F.array_join(F.transform(seen, lambda x: F.concat(x["role"], F.lit(": "), F.coalesce(x["content"], F.lit("")))), "\n"))
    pending = F.collect_list(F.when(F.col("role") == "tool", F.col("content"))).over(Window.partitionBy("id", "turn_idx").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return m.withColumn("observations", F.array_join(pending, "\n")).where("call is not null").select("id", "turn_idx", "history", "observations", F.col("call").alias("gold"))


def agent_log(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prompts, results) of agent session logs (session, seq, type, is_human, tool_id, tool, text): human turns numbered, results with the tool that was called before."""
    w = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    r = rows.withColumn("turn", F.sum(F.col("is_human").cast("int")).over(w))
    by_call = Window.partitionBy("session", "tool_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    named = r.withColumn("tool", F.last(F.when(F.col("type") == "call", F.col("tool")), ignorenulls=True).over(by_call))
    return r.where("is_human").select("session", "seq", "turn", "text"), named.where("type = 'result'").select("session", "seq", "turn", "tool_id", "tool", "text")


RUN = "instance_id string, system string, problem_statement string, trajectory array<struct<action string, observation string>>, info struct<resolved boolean, exit_status string>"


def read_agent_runs(spark: SparkSession, path: str, cut: int = 2000) -> DataFrame:
    """Decision points of code-agent runs: (traj_id, turn_idx, history, observation, verb, target, resolved).

    Step i is the decision; the history holds each earlier action with the first `cut` characters of
    its observation, and the observation before the step is what it answers to. The target is the
    action's first argument with a slash or a dot, else its first.
    """
    r = spark.read.schema(RUN).option("multiLine", True).json(path)
    s = r.select(F.col("instance_id").alias("traj_id"), "problem_statement", F.col("info.resolved").alias("resolved"), F.posexplode("trajectory").alias("turn_idx", "s"))
    w = Window.partitionBy("traj_id").orderBy("turn_idx")
    seen = F.collect_list(F.concat(F.coalesce("s.action", F.lit("")), F.lit("\n"), F.substring(F.coalesce("s.observation", F.lit("")), 1, cut))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    words = F.filter(F.split(F.trim("s.action"), r"\s+"), lambda x: x != "")
    args = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    pathlike = F.filter(args, lambda x: x.rlike(r"[/.]"))
    return s.select(
        "traj_id", "turn_idx", F.array_join(seen, "\n\n").alias("history"), F.coalesce(F.lag("s.observation").over(w), "problem_statement").alias("observation"),
        F.get(words, F.lit(0)).alias("verb"), F.coalesce(F.get(pathlike, F.lit(0)), F.get(args, F.lit(0))).alias("target"), "resolved",
    )

"""Operators across blocks and turns: gates, de-duplication, deltas, structural checks, gists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

TURN = ("traj_id", "turn_idx")


def from_tail() -> Column:
    """1 for the last block of a turn, 2 for the one before, and so on."""
    return F.row_number().over(Window.partitionBy(*TURN).orderBy(F.desc("pos")))


def head_cut(text, n: int) -> Column:
    return F.substring(text, 1, n)


def head_tail(text: str, head: int, tail: int, over: int) -> Column:
    """The first and last characters with a mark between, for texts of more than `over` characters, if that is shorter."""
    t = F.col(text)
    cut = F.concat(F.substring(t, 1, head), F.lit("\n…[+"), (F.length(t) - head - tail).cast("string"), F.lit(" chars]…\n"), F.expr(f"right({text}, {tail})"))
    return F.when((F.length(t) > over) & (F.length(cut) < F.length(t)), cut).otherwise(t)


def light_digest(text: str, head: int, tail: int) -> Column:
    return F.when(F.length(text) <= head + tail, F.col(text)).otherwise(
        F.concat(F.substring(text, 1, head), F.lit("\n… ["), T.handle(text), F.lit("] …\n"), F.expr(f"right({text}, {tail})"))
    )


def monotone_gate(turns: DataFrame, recent: int, digest: Column | None = None) -> DataFrame:
    """The last `recent` blocks of a turn and volatile ones in full, older ones digested; with recent <= 0 all that aren't volatile."""
    full = (F.col("stability") == "volatile") | ((F.col("dist") <= recent) if recent > 0 else F.lit(False))
    return turns.withColumn("dist", from_tail()).withColumn("digested", ~full).withColumn("text", F.when(full, F.col("text")).otherwise(light_digest("text", 120, 60) if digest is None else digest)).drop("dist")


def graded_gate(turns: DataFrame, keep_full: int, keep_light: int) -> DataFrame:
    """Full, light (400, 200) or heavy (120, 60) by distance from the end of the turn; volatile blocks in full."""
    d = F.col("dist")
    level = F.when((F.col("stability") == "volatile") | (d <= keep_full), "full").when(d <= keep_light, "light").otherwise("heavy")
    out = F.when(F.col("level") == "full", F.col("text")).when(F.col("level") == "light", light_digest("text", 400, 200)).otherwise(light_digest("text", 120, 60))
    return turns.withColumn("dist", from_tail()).withColumn("level", level).withColumn("text", out).drop("dist")


def gate_fraction(messages: DataFrame, recent: int, roles: tuple[str, ...] = ("user", "tool")) -> DataFrame:
    """(traj_id, working, digested, fraction): of the messages with working roles, those before the last `recent`."""
    m = messages.where(F.col("role").isin(*roles)).withColumn("dist", F.row_number().over(Window.partitionBy("traj_id").orderBy(F.desc("pos"))))
    g = m.groupBy("traj_id").agg(F.count("*").alias("working"), F.count_if((F.col("dist") > recent) if recent > 0 else F.lit(True)).alias("digested"))
    return g.withColumn("fraction", F.col("digested") / F.col("working"))


def repeat_marker(handle: Column, turn: Column) -> Column:
    return F.concat(F.lit("«repeat of earlier tool output handle="), handle, F.lit(" (first seen turn "), turn.cast("string"), F.lit(")»"))


def stream_dedup(blocks: DataFrame, least_chars: int = 160) -> DataFrame:
    """Blocks with `repeat`, `first_turn` and the text a repeat is replaced by.

    A volatile block of at least least_chars characters without a decision that repeats an earlier
    one of its trajectory byte for byte becomes a marker. One whose handle an earlier, different
    text holds passes through.
    """
    ok = (F.col("stability") == "volatile") & ~F.col("text").contains(T.DECISION) & (F.length("text") >= least_chars)
    b = blocks.withColumn("handle", T.handle("text")).withColumn("eligible", ok)
    by = Window.partitionBy("traj_id", "handle", "eligible").orderBy("turn_idx", "pos")
    first = F.first(F.struct("turn_idx", F.sha2("text", 256).alias("h"))).over(by)
    b = b.withColumn("first", first).withColumn("nth", F.row_number().over(by))
    again = F.col("eligible") & (F.col("nth") > 1) & (F.col("first.h") == F.sha2("text", 256))
    return b.select(
        *blocks.columns[: blocks.columns.index("text")], "handle", again.alias("repeat"), F.when(again, F.col("first.turn_idx")).alias("first_turn"),
        F.when(again, repeat_marker(F.col("handle"), F.col("first.turn_idx"))).otherwise(F.col("text")).alias("text"),
    )


def earlier_refs(messages: DataFrame, least_chars: int = 400) -> DataFrame:
    """(traj_id, pos, handle, first_pos, is_ref, saved): texts of at least least_chars delivered before, in an earlier message of the session."""
    m = messages.where(F.length("text") >= least_chars).withColumn("handle", T.handle("text"))
    m = m.withColumn("first_pos", F.min("pos").over(Window.partitionBy("traj_id", "handle")))
    ref = F.col("first_pos") < F.col("pos")
    mark = F.concat(F.lit("«same as earlier "), F.col("handle"), F.lit("»"))
    saved = F.when(ref, F.greatest(F.lit(0).cast("long"), T.token_count("text") - T.token_count(mark))).otherwise(F.lit(0).cast("long"))
    return m.select("traj_id", "pos", "handle", "first_pos", ref.alias("is_ref"), saved.alias("saved"))


def diff_context(turns: DataFrame) -> DataFrame:
    """Blocks of each turn with tag r (equal id and text in the turn before) or m (to be sent), and its tokens.

    Of blocks of a turn that share an id, the last stands for it in the next turn.
    """
    known = turns.select("traj_id", "turn_idx").distinct().withColumn("next", F.lead("turn_idx").over(Window.partitionBy("traj_id").orderBy("turn_idx")))
    last = turns.groupBy("traj_id", "turn_idx", "block_id").agg(F.max_by(F.sha2("text", 256), "pos").alias("prev_h"))
    prev = last.join(known, list(TURN)).select("traj_id", F.col("next").alias("turn_idx"), "block_id", "prev_h")
    b = turns.withColumn("h", F.sha2("text", 256)).withColumn("tok", T.token_count("text"))
    return b.join(prev, ["traj_id", "turn_idx", "block_id"], "left").withColumn("tag", F.when(F.col("prev_h") == F.col("h"), "r").otherwise("m"))


def delta_totals(tagged: DataFrame) -> DataFrame:
    tok = lambda t: F.coalesce(F.sum(F.when(F.col("tag") == t, F.col("tok"))), F.lit(0)).cast("long")
    order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tag"))), lambda x: x["tag"]), "")
    return tagged.groupBy(*TURN).agg(F.count_if(F.col("tag") == "r").alias("refs"), F.count_if(F.col("tag") == "m").alias("sent"), tok("r").alias("ref_tok"), tok("m").alias("sent_tok"), order.alias("tags"))


def replay(tagged: DataFrame, turns: DataFrame) -> DataFrame:
    """Each turn rebuilt from the turn before and what was sent: (traj_id, turn_idx, pos, block_id, text). A reference without its block stops the job."""
    known = turns.select("traj_id", "turn_idx").distinct().withColumn("next", F.lead("turn_idx").over(Window.partitionBy("traj_id").orderBy("turn_idx")))
    last = turns.groupBy("traj_id", "turn_idx", "block_id").agg(F.max_by("text", "pos").alias("prev_text"))
    prev = last.join(known, list(TURN)).select("traj_id", F.col("next").alias("turn_idx"), "block_id", "prev_text")
    sent = tagged.withColumn("sent_text", F.when(F.col("tag") == "m", F.col("text"))).drop("text")
    j = sent.join(prev, ["traj_id", "turn_idx", "block_id"], "left")
    lost = F.raise_error(F.concat(F.lit("no block to refer to: "), F.col("block_id")))
    return j.select("traj_id", "turn_idx", "pos", "block_id", F.when(F.col("tag") == "m", F.col("sent_text")).when(F.col("prev_text").isNotNull(), F.col("prev_text")).otherwise(lost).alias("text"))


def changed_ids(turns: DataFrame) -> DataFrame:
    """(traj_id, turn_idx, block_id) of blocks whose text differs from the one of the same id in the turn before."""
    t = diff_context(turns)
    return t.where(F.col("prev_h").isNotNull() & (F.col("prev_h") != F.col("h"))).select("traj_id", "turn_idx", "block_id")


def validate(turns: DataFrame, models: tuple[str, ...] = ()) -> DataFrame:
    """Structural findings for each trajectory: few_turns, volatile_before_cacheable, stable_changes, no_volatile."""
    per_turn = turns.groupBy("traj_id", "turn_idx").agg(
        F.min(F.when(F.col("stability") == "volatile", F.col("pos"))).alias("first_volatile"), F.max(F.when(F.col("stability") != "volatile", F.col("pos"))).alias("last_cacheable")
    )
    a = per_turn.groupBy("traj_id").agg(
        (F.count("*") < 3).alias("few_turns"), F.coalesce(F.max(F.col("first_volatile") < F.col("last_cacheable")), F.lit(False)).alias("volatile_before_cacheable"),
        F.max(F.col("first_volatile").isNull()).alias("no_volatile"),
    )
    s = turns.where("stability = 'stable'").groupBy("traj_id", "block_id").agg((F.count_distinct(F.sha2("text", 256)) > 1).alias("c")).groupBy("traj_id").agg(F.max("c").alias("stable_changes"))
    return a.join(s, "traj_id", "left").select("traj_id", "few_turns", "volatile_before_cacheable", "no_volatile", F.coalesce("stable_changes", F.lit(False)).alias("stable_changes"))


def gist_savings(texts: DataFrame) -> DataFrame:
    """(registered, refs, hits, dedup_rate, tok_full, tok_saved) when each repeated text is sent as a reference."""
    t = texts.select(F.concat(F.lit("gist:"), T.handle("text")).alias("ref"), T.token_count("text").alias("tok"))
    g = t.groupBy("ref").agg(F.count("*").alias("n"), F.first("tok").alias("tok"))
    cost = T.token_count("ref")
    n, d = F.sum("n"), F.count("*")
    return g.agg(
        n.alias("registered"), d.alias("refs"), (n - d).alias("hits"), ((n - d) / n).alias("dedup_rate"), F.sum(F.col("n") * F.col("tok")).alias("tok_full"),
        F.sum((F.col("n") - 1) * F.greatest(F.lit(0).cast("long"), F.col("tok") - cost)).alias("tok_saved"),
    )


def near_bases(messages: DataFrame, least_chars: int = 400, least_share: float = 0.5) -> DataFrame:
    """(traj_id, pos, base_pos, shared, lines): for a long message the earlier one of its session that it resembles, as a base for a delta.

    Each distinct line is looked up in the newest earlier message that has it too, so the work grows
    with lines and not with pairs of messages; the message that answers for most lines, the newest
    of equals, is the base if those are least_share of all distinct lines. Exact repeats have
    themselves as a base with all lines shared; shorter messages and those without a base have no row.
    """
    m = messages.where(F.length("text") >= least_chars)
    x = m.select("traj_id", "pos", F.explode(F.array_distinct(F.split("text", "\n", -1))).alias("line")).select("traj_id", "pos", F.sha2("line", 256).alias("h"))
    x = x.withColumn("base_pos", F.lag("pos").over(Window.partitionBy("traj_id", "h").orderBy("pos")))
    lines = F.sum("n").over(Window.partitionBy("traj_id", "pos"))
    g = x.groupBy("traj_id", "pos", "base_pos").agg(F.count("*").alias("n")).withColumn("lines", lines).where("base_pos is not null")
    best = F.row_number().over(Window.partitionBy("traj_id", "pos").orderBy(F.desc("n"), F.desc("base_pos")))
    g = g.withColumn("nth", best).where((F.col("nth") == 1) & (F.col("n") >= least_share * F.col("lines")))
    return g.select("traj_id", "pos", "base_pos", F.col("n").alias("shared"), "lines")


def near_deltas(messages: DataFrame, **how) -> DataFrame:
    """Messages that have a base (see near_bases), with `sent`: the delta to it where that is shorter, else the text."""
    from ..functions import codecs as C

    b = near_bases(messages, **how).join(messages.select("traj_id", F.col("pos").alias("base_pos"), F.col("text").alias("base")), ["traj_id", "base_pos"])
    j = messages.select("traj_id", "pos", "text").join(b, ["traj_id", "pos"])
    return j.withColumn("sent", C.udf(C.delta_to)(F.col("base"), F.col("text"))).select("traj_id", "pos", "base_pos", "text", "sent")

"""The live path over messages: which are exempt, what the others become; recovery; decisions and usage read from responses."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codecs as C
from ..functions import text as T
from . import line_ops, salience

RECENT, SHORT = 2, 6
_PIECES = re.compile(r"\w+|[^\w\s]")


def _tokens(text: str) -> int:
    return max(1, round(1.33 * len(_PIECES.findall(text)))) if text else 0


def plain(text: str) -> str:
    """Minified and, where that costs no more tokens, with its runs collapsed."""
    base = C.minify_json(text) or text
    short = C.collapse_runs(base)
    return short if _tokens(short) <= _tokens(base) else base


def tool_result(text: str, verbatim: bool, recent: bool, keep: bool, intent: list[str] | None) -> str:
    """A tool result as it is sent: short and recent ones plain, in verbatim mode folded without a handle, else digested."""
    if len(text.splitlines()) < SHORT or keep:
        return plain(text)
    if verbatim or recent:
        return (None if recent else C.fold(text, False) or C.template_fold(text, with_handle=False)) or plain(text)
    wanted = frozenset(intent or ())
    out = C.digest(text, also=(lambda lines: relevant(lines, wanted)) if wanted else None)
    return out if out != text else plain(text)


_TERM = re.compile(r"[A-Za-z_][\w./-]{2,}")


def relevant(lines: list[str], wanted: frozenset[str], share: float = 0.4) -> set[int]:
    """Lines that share a term with what is wanted, terms on more than `share` of the lines aside."""
    hits = [{t.lower() for t in _TERM.findall(x)} & wanted for x in lines]
    most = max(1, int(share * len(lines)))
    common = {t for t in wanted if sum(t in h for h in hits) > most}
    return {i for i, h in enumerate(hits) if h - common}


def compress_messages(messages: DataFrame, verbatim: bool = False, keep_signatures: tuple[str, ...] = ()) -> DataFrame:
    """Messages (session, pos, role, text) with `sent`, and `handle` where the original is behind one.

    Assistant text stays; user text is made plain; tool results go by tool_result(), the last RECENT
    user and tool messages exempt. Intent is the terms of the session's newest user message. Blocks
    of a signature in keep_signatures stay byte for byte. Where two texts of a session share a
    handle, both are sent plain.
    """
    working = F.col("role").isin("user", "tool")
    rank = F.row_number().over(Window.partitionBy("session", working).orderBy(F.desc("pos")))
    whole = Window.partitionBy("session")
    last_user = F.max(F.when(F.col("role") == "user", F.struct("pos", "text"))).over(whole)
    m = messages.withColumn("recent", working & (rank <= RECENT)).withColumn("intent", T.terms(F.coalesce(last_user["text"], F.lit(""))))
    keep = T.signature("text").isin(*keep_signatures) if keep_signatures else F.lit(False)
    result = _result(verbatim, keep)
    m = m.withColumn("sent", F.when(F.col("role") == "assistant", F.col("text")).when(F.col("role") == "tool", result).otherwise(C.udf(plain)("text")))
    m = m.withColumn("handle", F.when((F.col("role") == "tool") & F.col("sent").contains(F.concat(F.lit("handle="), T.handle("text"))), T.handle("text")))
    clash = F.size(F.collect_set(F.when(F.col("handle").isNotNull(), F.sha2("text", 256))).over(Window.partitionBy("session", "handle"))) > 1
    m = m.withColumn("clash", clash & F.col("handle").isNotNull())
    return m.select(*messages.columns, F.when(F.col("clash"), C.udf(plain)("text")).otherwise(F.col("sent")).alias("sent"), F.when(~F.col("clash"), F.col("handle")).alias("handle"))


def _result(verbatim: bool, keep: Column) -> Column:
    run = C.udf(lambda text, recent, kept, intent: tool_result(text, verbatim, bool(recent), bool(kept), intent.split("\n") if intent else None))
    return run(F.col("text"), F.col("recent"), keep, F.array_join("intent", "\n"))


def restore_table(messages: DataFrame) -> DataFrame:
    return messages.where("handle is not null").select("session", "handle", "text").distinct()


def expand(blocks: DataFrame, restore: DataFrame) -> DataFrame:
    """Blocks (session, pos, text) whose text holds a handle replaced by its original, the first handle of each."""
    h = F.regexp_extract("text", "handle=([0-9a-f]{8})", 1)
    r = restore.select("session", F.col("handle").alias("h"), F.col("text").alias("original"))
    return blocks.withColumn("h", h).join(r, ["session", "h"], "left").select("session", "pos", F.coalesce("original", "text").alias("text"), F.col("original").isNotNull().alias("expanded"))


def unrecoverable(originals: DataFrame, sent: DataFrame, restore: DataFrame) -> DataFrame:
    """(session, pos) of originals that are neither sent as they are nor restorable."""
    same = originals.join(sent.select("session", "pos", F.col("text").alias("out")), ["session", "pos"], "left").where(~F.col("out").eqNullSafe(F.col("text")))
    return same.join(restore.select("session", "text"), ["session", "text"], "left_anti").select("session", "pos")


def requested_handles(column: str) -> Column:
    """Handles that an expand request names."""
    inside = F.regexp_extract(F.col(column), r'"expand"\s*:\s*(\[[^\]]*\]|"[^"]*")', 1)
    return F.regexp_extract_all(inside, F.lit("[0-9a-f]{8}"), F.lit(0))


def usage(column: str) -> list[Column]:
    """First input and last output token count in a response body or stream."""
    first = F.regexp_extract(F.col(column), r'"input_tokens"\s*:\s*([0-9]+)', 1)
    every = F.regexp_extract_all(F.col(column), F.lit(r'"output_tokens"\s*:\s*([0-9]+)'), F.lit(1))
    return [F.when(first != "", first.cast("long")).alias("input_tokens"), F.when(F.size(every) > 0, F.element_at(every, -1).cast("long")).alias("output_tokens")]


def answer_fingerprint(column: str) -> Column:
    """What follows decision, answer or result marks, lower case and sorted; else the text with its white space folded."""
    found = F.regexp_extract_all(F.col(column), F.lit(r"(?im)(?:result|answer|decision)\s*:\s*(.+?)(?:\.\s|\.?$)"), F.lit(1))
    flat = F.lower(F.trim(F.regexp_replace(F.col(column), r"\s+", " ")))
    return F.when(F.size(found) > 0, F.array_join(F.array_sort(F.transform(found, lambda x: F.lower(F.trim(x)))), " | ")).otherwise(flat)


def output_savings(pairs: DataFrame) -> DataFrame:
    """(n, mean_reduction, answers_kept) of baseline and shaped outputs, by tokens."""
    a, b = T.token_count("baseline"), T.token_count("shaped")
    same = (answer_fingerprint("baseline") == answer_fingerprint("shaped")).cast("double")
    return pairs.agg(F.count("*").alias("n"), F.avg(F.when(a > 0, 1 - b / a).otherwise(0.0)).alias("mean_reduction"), F.avg(same).alias("answers_kept"))


def action_fingerprint(text: str) -> str:
    """Canonical action and target of a decision object somewhere in a text."""
    m = re.search(r"\{.*\}", text, re.S)
    for part in (m[0] if m else "", text.strip()):
        try:
            o = json.loads(part)
        except ValueError:
            continue
        if isinstance(o, dict) and "action" in o:
            return json.dumps({"action": re.sub("[^a-z0-9]", "", str(o["action"]).lower()), "target": str(o.get("target", "")).strip().lower()}, separators=(",", ":"))
    return "<no-decision>"


def correlate(folds: DataFrame, results: DataFrame, least: int = 40) -> DataFrame:
    """Folds (session, fold_id, text) with the first tool result of their session that holds them or that they hold.

    Equal texts join by hash; only what is left is compared by containment, within its session.
    """
    f = folds.withColumn("fh", F.sha2("text", 256))
    r = results.select("session", "seq", "tool", F.col("text").alias("rtext"), F.sha2("text", 256).alias("rh"))
    exact = f.join(r, (f.session == r.session) & (f.fh == r.rh)).select(f.session, "fold_id", "seq", "tool")
    rest = f.where(F.length("text") >= least).join(exact.select("session", "fold_id"), ["session", "fold_id"], "left_anti")
    near = rest.join(r.where(F.length("rtext") >= least), "session").where("contains(rtext, text) or contains(text, rtext)").select("session", "fold_id", "seq", "tool")
    return exact.union(near).groupBy("session", "fold_id").agg(F.min_by("tool", "seq").alias("tool"), F.min("seq").alias("seq"))


def overlapping(files: DataFrame, windows: DataFrame, slack: float = 60.0) -> DataFrame:
    """(window_id, path, overlap) of files (path, first_ts, last_ts) that overlap a session window (window_id, start, end), longest first.

    Both sides are spread over the hours they touch, so the range condition becomes an equality.
    """
    hours = lambda a, b: F.explode(F.sequence(F.floor(a / 3600), F.floor(b / 3600)))
    f = files.withColumn("hour", hours(F.col("first_ts"), F.col("last_ts")))
    w = windows.withColumn("hour", hours(F.col("start") - slack, F.col("end") + slack))
    j = f.join(w, "hour").where((F.col("first_ts") <= F.col("end") + slack) & (F.col("last_ts") >= F.col("start") - slack)).drop("hour").distinct()
    return j.select("window_id", "path", (F.least("last_ts", F.col("end") + slack) - F.greatest("first_ts", F.col("start") - slack)).alias("overlap")).orderBy("window_id", F.desc("overlap"), "path")


def salient_share(blocks: DataFrame, keep: float = 0.35) -> DataFrame:
    """(block_id, text): the int(keep * lines) lines, one at least, with the most salient tokens; blocks of up to three lines stay."""
    raw = T.lines("text")
    x = line_ops.explode_lines(blocks.withColumn("n", F.size(raw)))
    x = x.withColumn("score", F.size(salience.pattern_tokens("line")) + F.size(F.filter(salience.anchors("line"), lambda t: salience.novel(t))))
    rank = F.row_number().over(Window.partitionBy("block_id").orderBy(F.desc("score"), "line_no"))
    return line_ops.join_lines(x.withColumn("rank", rank).where((F.col("n") <= 3) | (F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(keep))))))


def last_entries(text: str, k: int = 3) -> Column:
    """The last k entries of a history split at empty lines, with a count of those dropped."""
    parts = F.split(F.col(text), "\n\n", -1)
    head = F.concat(F.lit("[…"), (F.size(parts) - k).cast("string"), F.lit(" earlier turns dropped…]\n\n"))
    return F.when(F.size(parts) <= k, F.col(text)).otherwise(F.concat(head, F.array_join(F.slice(parts, F.lit(-k), F.lit(k)), "\n\n")))


def sparse_words(text: str, keep: float = 0.5) -> Column:
    """Salient words and every second (or int(1 / keep)th) other one; texts of up to eight words stay."""
    words = F.regexp_extract_all(F.col(text), F.lit(r"[^\s]+"), F.lit(0))
    stride, known = max(2, int(1 / max(keep, 1e-3))), salience.pattern_tokens(text)
    return F.when(F.size(words) <= 8, F.col(text)).otherwise(F.array_join(F.filter(words, lambda w, i: (i % stride == 0) | F.array_contains(known, w)), " "))


def compress_contents(requests: DataFrame, verbatim: bool = False) -> DataFrame:
    """Requests (.., body) of contents and parts with `sent`: texts made plain, function responses digested (folded in verbatim mode); none is exempt for being recent."""
    run = C.udf(lambda body: C.rewrite_contents(body, plain, lambda t: tool_result(t, verbatim, False, False, None)))
    return requests.withColumn("sent", run("body"))

"""Queries over blocks, turns and lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import codecs as C
from ..functions import text as T
from ..operators import cost, line_ops, live, retrieval, salience, strategies, turn_ops
from ..sources import fixtures as X
from .base import query

PIECE_SQL = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def tok(c: str) -> str:
    return f"(case when length({c}) = 0 then 0 else greatest(1, round_even(len(regexp_extract_all({c}, '{PIECE_SQL}')) * 1.33, 0)::bigint) end)"


def lit(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


LINES_SQL = """case when {t} like '%' || chr(10) or {t} = '' then list_slice(string_split({t}, chr(10)), 1, len(string_split({t}, chr(10))) - 1) else string_split({t}, chr(10)) end"""


def lines_sql(source: str) -> str:
    """CTE `ls`: block_id, text, n, line_no, line."""
    arr = LINES_SQL.format(t="text")
    return f"la as (select *, {arr} arr from {source}), ls as (select block_id, text, len(arr) n, unnest(range(0, len(arr))) line_no, unnest(arr) line from la)"


@query(f"select conv_id, turn, {tok('text')}::bigint as tokens, left(sha256(text), 8) as handle from conversations")
def token_count(spark, d):
    return X.table(spark, d, "conversations").select("conv_id", "turn", T.token_count("text").alias("tokens"), T.handle("text").alias("handle"))


@query("select doc_id, sha256(text) as sha, left(sha256(text), 8) as handle from documents")
def sha_manifest(spark, d):
    return X.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), T.handle("text").alias("handle"))


@query(f"with {X.TURNS_SQL} select traj_id, pos, block_id, kind, stability, length(text)::bigint as chars from m")
def ingest_blocks(spark, d):
    return X.message_blocks(X.table(spark, d, "conversations")).select("traj_id", "pos", "block_id", "kind", "stability", F.length("text").cast("long").alias("chars"))


@query(f"with {X.TURNS_SQL} select traj_id, turn_idx, count(*) as blocks, sum(length(text))::bigint as chars from turns group by all")
def trajectory_turns(spark, d):
    return X.conversation_turns(spark, d).groupBy("traj_id", "turn_idx").agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars"))


VALID_SQL = f"""with {X.TURNS_SQL},
p as (select traj_id, turn_idx, min(pos) filter (stability = 'volatile') fv, max(pos) filter (stability <> 'volatile') lc from turns group by all),
a as (select traj_id, count(*) < 3 few_turns, coalesce(bool_or(fv < lc), false) volatile_before_cacheable, bool_or(fv is null) no_volatile from p group by traj_id),
s as (select traj_id, bool_or(c > 1) sc from (select traj_id, block_id, count(distinct text) c from turns where stability = 'stable' group by all) group by traj_id)
select traj_id, few_turns, volatile_before_cacheable, no_volatile, coalesce(sc, false) as stable_changes from a left join s using (traj_id)"""


@query(VALID_SQL)
def validate_trajectory(spark, d):
    return turn_ops.validate(X.conversation_turns(spark, d))


def simulate_sql(name: str, text: str, stability: str = "stability", caching: bool = True) -> str:
    """SQL for one strategy given as an expression for the text."""
    price = cost.PRICES[X.MODEL][0] / 1e6
    if not caching:
        return f"select traj_id, turn_idx, '{name}' as strategy, false as caching, 0::bigint as read_tok, 0::bigint as write_tok, sum({tok(text)})::bigint as fresh_tok from turns group by all"
    return f"""select traj_id, turn_idx, '{name}' as strategy, true as caching, coalesce(sum(tk) filter (how = 'read'), 0)::bigint as read_tok, coalesce(sum(tk) filter (how = 'write'), 0)::bigint as write_tok, coalesce(sum(tk) filter (how = 'fresh'), 0)::bigint as fresh_tok from (
  select *, case when lcp = 1 then 'read' when not payable then 'fresh' when row_number() over (partition by traj_id, h, payable order by turn_idx, ix) = 1 then 'write' else 'read' end how from (
   select *, lcp = 0 and stability <> 'volatile' payable from (
    select *, min(same) over (partition by traj_id, turn_idx order by ix) lcp from (
     select a.*, case when b.h = a.h then 1 else 0 end same from {name}_b a left join {name}_b b on a.traj_id = b.traj_id and a.ix = b.ix and b.turn_idx = (select max(c.turn_idx) from {name}_b c where c.traj_id = a.traj_id and c.turn_idx < a.turn_idx))))) group by all"""


def strategy_cte(name: str, text: str) -> str:
    return f"{name}_b as (select traj_id, turn_idx, stability, sha256({text}) h, {tok(text)} tk, row_number() over (partition by traj_id, turn_idx order by pos) ix from turns)"


NAIVE = "(case when stability <> 'volatile' then text || chr(10) || '<<recompressed@t' || turn_idx || '>>' else text end)"
FLAG_SQL = f"""with {X.TURNS_SQL}, {strategy_cte('none', 'text')}, {strategy_cte('aggressive', 'left(text, 120)')}, {strategy_cte('naive', NAIVE)},
u as ({' union all '.join(simulate_sql(n, t, caching=c) for n, t in (('none', 'text'), ('aggressive', 'left(text, 120)'), ('naive', NAIVE)) for c in (True, False))})
select strategy, caching, sum(read_tok)::bigint as read_tok, sum(write_tok)::bigint as write_tok, sum(fresh_tok)::bigint as fresh_tok,
 round(sum(read_tok) * 5e-6 * 0.10 + sum(write_tok) * 5e-6 * 1.25 + sum(fresh_tok) * 5e-6, 6) as dollars from u group by all"""


def _costs(spark, d, names):
    t = X.conversation_turns(spark, d)
    cols = ["traj_id", "turn_idx", "pos", "stability", "text"]
    return cost.bill(reduce(lambda a, b: a.unionByName(b), [strategies.apply(n, t).select(F.lit(n).alias("strategy"), *cols) for n in names]))


def _totals(rows):
    g = rows.groupBy("strategy", "caching").agg(*[F.sum(c).alias(c) for c in ("read_tok", "write_tok", "fresh_tok")])
    p = cost.PRICES[X.MODEL][0] / 1e6
    return g.withColumn("dollars", F.round(F.col("read_tok") * p * cost.READ + F.col("write_tok") * p * cost.WRITE + F.col("fresh_tok") * p, 6))


@query(FLAG_SQL)
def cache_cost_by_strategy(spark, d):
    """What the conversations cost under each strategy, with and without caching."""
    return _totals(_costs(spark, d, ("none", "aggressive", "naive")))


@query()
def cache_cost_lossless(spark, d):
    return _totals(_costs(spark, d, ("none", "lossless")))


@query(f"with {X.TURNS_SQL}, {strategy_cte('none', 'text')} {simulate_sql('none', 'text')}")
def cache_cost_per_turn(spark, d):
    return cost.simulate(X.conversation_turns(spark, d), "none").select("traj_id", "turn_idx", "strategy", "caching", "read_tok", "write_tok", "fresh_tok")


@query(f"""with {X.TURNS_SQL}, {strategy_cte('none', 'text')}, u as ({simulate_sql('none', 'text')})
select traj_id, sum(read_tok)::bigint as read_tok, sum(read_tok + write_tok + fresh_tok)::bigint as tokens, round(sum(read_tok) / sum(read_tok + write_tok + fresh_tok), 6) as hit_ratio from u group by rollup (traj_id)""")
def cache_hit_ratio_rollup(spark, d):
    c = cost.simulate(X.conversation_turns(spark, d), "none")
    g = c.rollup("traj_id").agg(F.sum("read_tok").alias("read_tok"), F.sum(F.col("read_tok") + F.col("write_tok") + F.col("fresh_tok")).alias("tokens"))
    return g.withColumn("hit_ratio", F.round(F.col("read_tok") / F.col("tokens"), 6))


WIRE = "case o_orderkey % 5 when 0 then 'us.anthropic.' || m || '@' || year(o_orderdate) when 1 then m || '-' || (20250000 + o_orderkey % 300) when 2 then m when 3 then 'gpt-' || o_custkey % 7 else m || 'x' end"
_MODEL = "case o_orderstatus when 'F' then 'claude-opus-4-8' when 'O' then 'claude-sonnet-4-5' else 'claude-haiku-4-5' end"


@query(f"""with o as (select o_orderkey, o_custkey, o_orderdate, {_MODEL} m, floor(o_totalprice)::bigint tokens from orders), w as (select {WIRE} as model, m, o_orderkey % 5 in (0, 1, 2) known, tokens from o),
p as (select * from (values {', '.join(f"('{k}', {a / 1e6}::double)" for k, (a, _) in sorted(cost.PRICES.items()))}) v(m, rate))
select model, any_value(case when known then w.m end) as price_model, count(*) as orders, round(sum(case when known then tokens * rate end), 6) as dollars from w join p using (m) group by model""")
def price_resolution(spark, d):
    """Orders billed at the catalog price that their wire id means: with a provider's prefix, a date, none; some mean nothing."""
    o = X.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", F.expr(_MODEL).alias("m"), F.floor("o_totalprice").cast("long").alias("tokens"))
    x = cost.resolve_prices(o.select(F.expr(WIRE).alias("model"), "tokens"))
    return x.groupBy("model").agg(F.first("price_model").alias("price_model"), F.count("*").alias("orders"), F.round(F.sum(F.col("tokens") * F.col("input")), 6).alias("dollars"))


LIMITS = (500, 400, 300, 250, 200, 160, 120, 80)


@query(f"select l as lim, sum(length(left(text, l)))::bigint as chars, sum({tok('left(text, l)')})::bigint as tokens from documents, (select unnest([{', '.join(map(str, LIMITS))}]) l) group by l")
def truncate_levels(spark, d):
    docs, levels = X.table(spark, d, "documents"), F.array(*[F.lit(x) for x in LIMITS])
    x = docs.select(F.explode(levels).alias("lim"), "text").withColumn("text", F.expr("left(text, lim)"))
    return x.groupBy("lim").agg(F.sum(F.length("text")).alias("chars"), F.sum(T.token_count("text")).alias("tokens"))


@query("""select doc_id, case when length(text) > 520 and length(left(text, 240) || chr(10) || '…[+' || (length(text) - 480) || ' chars]…' || chr(10) || right(text, 240)) < length(text)
 then left(text, 240) || chr(10) || '…[+' || (length(text) - 480) || ' chars]…' || chr(10) || right(text, 240) else text end as text from documents""")
def head_tail_elide(spark, d):
    return X.table(spark, d, "documents").select("doc_id", turn_ops.head_tail("text", 240, 240, 520).alias("text"))


@query("select doc_id, right(text, 400) as last, left(text, 400) as first from documents")
def recency_window(spark, d):
    return X.table(spark, d, "documents").select("doc_id", F.expr("right(text, 400)").alias("last"), F.expr("left(text, 400)").alias("first"))


COLLAPSE_SQL = f"""with {X.DOCS_SQL}, r as (select block_id, unnest(string_split(text, chr(10))) line, unnest(range(0, len(string_split(text, chr(10))))) line_no, len(string_split(text, chr(10))) n from docs),
f as (select *, case when line_no < n - 1 and lag(line) over w = line then 0 else 1 end fresh from r window w as (partition by block_id order by line_no)),
g as (select *, sum(fresh) over (partition by block_id order by line_no) run from f),
k as (select block_id, run, min(line_no) line_no, count(*) k, any_value(line) line from g group by block_id, run)
select block_id, string_agg(case when k = 1 then line when regexp_matches(line, '^<<x[0-9]+>>$') then rtrim(repeat(line || chr(10), k::int), chr(10)) else line || chr(10) || '<<x' || k || '>>' end, chr(10) order by line_no) as text from k group by block_id"""


@query(COLLAPSE_SQL)
def collapse_runs(spark, d):
    return line_ops.collapse_runs(X.document_blocks(spark, d))


TEMPLATE_SQL = f"""with {X.LOGS_SQL}, r as (select block_id, unnest(string_split(text, chr(10))) line, unnest(range(0, len(string_split(text, chr(10))))) line_no from logs),
q as (select *, regexp_replace(line, {lit(T.VARIABLE)}, '§', 'g') mask from r),
f as (select *, case when lag(mask) over (partition by block_id order by line_no) = mask then 0 else 1 end fresh from q),
g as (select *, sum(fresh) over (partition by block_id order by line_no) run from f)
select block_id, min(line_no)::int as first_line, count(*) as lines, any_value(mask) as template, string_agg(array_to_string(regexp_extract_all(line, {lit(T.VARIABLE)}), ' '), ' | ' order by line_no) as variables
from g group by block_id, run having count(*) >= 2 and any_value(mask) like '%§%'"""


@query(TEMPLATE_SQL)
def template_fold_runs(spark, d):
    return line_ops.template_runs(X.event_logs(spark, d), 2)


KIND_SQL = f"case when regexp_matches(text, '(?m)^@@|^diff --git') then 'diff' when regexp_matches(text, {lit('(?m)' + T.VERDICT)}) then 'log' when regexp_matches(text, {lit('(?m)' + T.FRAME)}) then 'traceback' else 'generic' end"
CLASS_SQL = f"""with {X.LOGS_SQL}, {lines_sql('logs')},
c as (select *, {KIND_SQL} kind, left(sha256(text), 8) handle, regexp_matches(line, {lit(T.VERDICT)}) verdict, regexp_matches(line, {lit(T.RED)}) red from ls),
o as (select *, case when bool_or(verdict and red) over (partition by block_id) then 'red' when bool_or(verdict) over (partition by block_id) then 'green' else 'unknown' end outcome,
  verdict or contains(line, 'DECISION:') answer, contains(line, 'DECISION:') or regexp_matches(line, {lit(T.ALARM)}) or (kind = 'log' and verdict) alarm,
  lower(regexp_replace(trim(regexp_replace(line, '\\s+', ' ', 'g')), '0x[0-9a-fA-F]+|[0-9]+', '#', 'g')) shape from c),
k as (select *, line_no < 3 or line_no >= n - 1 or n <= 5 or answer or (alarm and not answer and row_number() over (partition by block_id, shape, alarm and not answer order by line_no) <= case when outcome = 'green' then 1 else 2 end) keep from o)"""


@query(f"{CLASS_SQL} select block_id, any_value(kind) as kind, any_value(outcome) as outcome, count(*) as lines, count(*) filter (alarm) as must_keep from k group by block_id")
def classify_content(spark, d):
    x = line_ops.classified(X.event_logs(spark, d))
    return x.groupBy("block_id").agg(F.first("kind").alias("kind"), F.first("outcome").alias("outcome"), F.count("*").alias("lines"), F.count_if(T.must_keep("line", "kind")).alias("must_keep"))


@query(f"{CLASS_SQL} select block_id, line_no::int as line_no, line, keep from k")
def digest_lines(spark, d):
    return line_ops.digest_lines(X.event_logs(spark, d)).select("block_id", "line_no", "line", "keep")


@query(f"""{CLASS_SQL}, f as (select *, sum(case when keep or coalesce(lag_keep, true) then 1 else 0 end) over (partition by block_id order by line_no) run from (select *, lag(keep) over (partition by block_id order by line_no) lag_keep from k)),
r as (select block_id, run, min(line_no) line_no, count(*) kk, bool_or(keep) keep, min(line) line, any_value(handle) handle from f group by block_id, run)
select block_id, string_agg(case when keep then line else '<< +' || kk || ' lines, handle=' || handle || ' >>' end, chr(10) order by line_no) as text from r group by block_id""")
def digest_blocks(spark, d):
    return line_ops.digest(X.event_logs(spark, d))


SCORE_SQL = f"""case when trim(line) = '' then 0.0 when contains(line, 'DECISION:') or regexp_matches(line, {lit(T.VERDICT)}) then 1.0
 when regexp_matches(lower(line), '{'|'.join(T.ALARM_WORDS)}') then 0.95 when regexp_matches(lower(line), '{T.DEBUG_WORDS}') then 0.1 when regexp_matches(trim(line), {lit(T.STRUCTURED)}) then 0.7
 when len(regexp_extract_all(line, {lit(T.NUMBER)})) >= 2 then 0.6 else 0.3 end"""


@query(f"""with {X.DOCS_SQL}, {lines_sql('docs')}, s as (select *, {SCORE_SQL} score from ls)
select block_id, string_agg(line, chr(10) order by line_no) as text from (select *, row_number() over (partition by block_id, score >= 1 order by score desc, line_no) rk, count(*) filter (score >= 1) over (partition by block_id) sure from s)
where score >= 1 or rk <= greatest(0, ceil(0.5 * n) - sure) group by block_id""")
def apply_keep(spark, d):
    return line_ops.apply_keep(X.document_blocks(spark, d), 0.5)


INFO_SQL = "len(list_distinct(list_filter(string_split(regexp_replace(lower(line), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda w: length(w) > 2)))"
RAW_SQL = "rl as (select block_id, text, unnest(string_split(text, chr(10))) line, unnest(range(0, len(string_split(text, chr(10))))) line_no, len(string_split(text, chr(10))) n from docs)"


@query(f"""with {X.DOCS_SQL}, {RAW_SQL}, s as (select *, row_number() over (partition by block_id order by {INFO_SQL}, line_no) rk from rl)
select block_id, string_agg(line, chr(10) order by line_no) as text from s where rk > case when n <= 3 then 0 else floor(n * 0.4::double) end group by block_id""")
def extractive_prune(spark, d):
    return line_ops.extractive(X.document_blocks(spark, d))


@query(f"""with {X.DOCS_SQL}, f as (select block_id, text, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') a from docs)
select block_id, case when len(a) <= 6 then text else a[1] || chr(10) || '…[' || (len(a) - 2) || ' lines summarised]…' || chr(10) || a[-1] end as text from f""")
def summarize_ends(spark, d):
    return line_ops.summarize_ends(X.document_blocks(spark, d))


@query(f"""with {X.DOCS_SQL}, {RAW_SQL}, a as (select *, line_no < 6 or line_no >= n - 4 anchor, {INFO_SQL} info from rl where length(text) > 600 and n > 11),
b as (select *, 600 - sum(case when anchor then length(line) else 0 end) over (partition by block_id) room, coalesce(sum(case when anchor then 0 else length(line) + 1 end) over (partition by block_id, anchor order by info desc, line_no rows between unbounded preceding and 1 preceding), 0) spent from a),
k as (select *, case when line_no <> coalesce(lag(line_no) over (partition by block_id order by line_no), -1) + 1 then '... [elided] ...' || chr(10) else '' end || line piece from b where anchor or spent < room),
w as (select block_id, string_agg(piece, chr(10) order by line_no) o from k group by block_id)
select d.block_id, case when length(d.text) <= 600 then d.text when len(string_split(d.text, chr(10))) <= 11 then left(d.text, 400) || chr(10) || '... [' || (length(d.text) - 600) || ' chars elided] ...' || chr(10) || right(d.text, 200) when length(o) < length(d.text) then o else d.text end as text from docs d left join w using (block_id)""")
def text_window(spark, d):
    return line_ops.text_window(X.document_blocks(spark, d))


def _light(h: int, t: int) -> str:
    return f"case when length(text) <= {h + t} then text else left(text, {h}) || chr(10) || '… [' || left(sha256(text), 8) || '] …' || chr(10) || right(text, {t}) end"


@query(f"""with {X.TURNS_SQL}, g as (select *, row_number() over (partition by traj_id, turn_idx order by pos desc) dist from turns)
select traj_id, turn_idx, pos, not (stability = 'volatile' or dist <= 2) as digested, case when stability = 'volatile' or dist <= 2 then text else {_light(120, 60)} end as text from g""")
def monotone_gate(spark, d):
    return turn_ops.monotone_gate(X.conversation_turns(spark, d), 2).select("traj_id", "turn_idx", "pos", "digested", "text")


@query(f"""with {X.TURNS_SQL}, g as (select *, row_number() over (partition by traj_id, turn_idx order by pos desc) dist from turns)
select traj_id, turn_idx, pos, case when stability = 'volatile' or dist <= 1 then 'full' when dist <= 3 then 'light' else 'heavy' end as level,
 case when stability = 'volatile' or dist <= 1 then text when dist <= 3 then {_light(400, 200)} else {_light(120, 60)} end as text from g""")
def graded_gate(spark, d):
    return turn_ops.graded_gate(X.conversation_turns(spark, d), 1, 3).select("traj_id", "turn_idx", "pos", "level", "text")


@query("""with m as (select conv_id, row_number() over (partition by conv_id order by turn desc) dist from conversations where role in ('user', 'tool'))
select conv_id as traj_id, count(*) as working, count(*) filter (dist > 2) as digested, round(count(*) filter (dist > 2) / count(*), 6) as fraction from m group by conv_id""")
def gate_fraction(spark, d):
    m = X.table(spark, d, "conversations").select(F.col("conv_id").alias("traj_id"), F.col("turn").alias("pos"), "role")
    return turn_ops.gate_fraction(m, 2).withColumn("fraction", F.round("fraction", 6))


def _source_blocks(spark, d):
    return X.table(spark, d, "documents").select(F.col("source").alias("traj_id"), F.col("doc_id").alias("turn_idx"), F.lit(0).alias("pos"), F.lit("volatile").alias("stability"), "text")


@query("""with b as (select source, doc_id, text, left(sha256(text), 8) handle from documents where length(text) >= 160), f as (select *, first_value(doc_id) over w first, first_value(text) over w ft, row_number() over w nth from b window w as (partition by source, handle order by doc_id))
select source as traj_id, doc_id as turn_idx, handle, first as first_turn from f where nth > 1 and text = ft""")
def stream_dedup(spark, d):
    return turn_ops.stream_dedup(_source_blocks(spark, d)).where("repeat").select("traj_id", "turn_idx", "handle", "first_turn")


@query(f"""with b as (select source, doc_id, text, left(sha256(text), 8) handle, min(doc_id) over (partition by source, left(sha256(text), 8)) first_pos from documents where length(text) >= 400)
select source as traj_id, doc_id as pos, handle, first_pos, first_pos < doc_id as is_ref, (case when first_pos < doc_id then greatest(0, {tok('text')} - {tok("('«same as earlier ' || handle || '»')")}) else 0 end)::bigint as saved from b""")
def exact_cache_refs(spark, d):
    m = X.table(spark, d, "documents").select(F.col("source").alias("traj_id"), F.col("doc_id").alias("pos"), "text")
    return turn_ops.earlier_refs(m)


DELTA_SQL = f"with {X.TURNS_SQL}, t as (select a.traj_id, a.turn_idx, a.pos, a.block_id, a.text, {tok('a.text')} tk, case when b.text = a.text then 'r' else 'm' end tag, b.text prev from turns a left join turns b on a.traj_id = b.traj_id and a.block_id = b.block_id and b.turn_idx = (select max(c.turn_idx) from turns c where c.traj_id = a.traj_id and c.turn_idx < a.turn_idx))"


@query(f"{DELTA_SQL} select traj_id, turn_idx, count(*) filter (tag = 'r') as refs, count(*) filter (tag = 'm') as sent, coalesce(sum(tk) filter (tag = 'r'), 0)::bigint as ref_tok, coalesce(sum(tk) filter (tag = 'm'), 0)::bigint as sent_tok, string_agg(tag, '' order by pos) as tags from t group by all")
def delta_refs(spark, d):
    return turn_ops.delta_totals(turn_ops.diff_context(X.conversation_turns(spark, d)))


@query(f"with {X.TURNS_SQL} select traj_id, turn_idx, pos, block_id, text from turns")
def delta_replay(spark, d):
    t = X.conversation_turns(spark, d)
    return turn_ops.replay(turn_ops.diff_context(t), t)


@query(f"{DELTA_SQL} select traj_id, turn_idx, block_id from t where prev is not null and prev <> text")
def append_only(spark, d):
    return turn_ops.changed_ids(X.conversation_turns(spark, d))


@query(f"""with g as (select left(sha256(html), 8) h, count(*) n, any_value({tok('html')}) tk from pages group by 1)
select sum(n)::bigint as registered, count(*) as refs, (sum(n) - count(*))::bigint as hits, round((sum(n) - count(*)) / sum(n), 6) as dedup_rate, sum(n * tk)::bigint as tok_full, sum((n - 1) * greatest(0, tk - {tok("('gist:' || h)")}))::bigint as tok_saved from g""")
def gist_savings(spark, d):
    return turn_ops.gist_savings(X.table(spark, d, "pages").select(F.col("html").alias("text"))).withColumn("dedup_rate", F.round("dedup_rate", 6))


@query(f"""with t as (select doc_id, unnest(list_distinct(list_concat(list_filter(regexp_extract_all(text, {lit(T.HEX)}), lambda x: regexp_matches(x, '[0-9]') and regexp_matches(x, '[a-f]')),
 list_concat(list_concat(regexp_extract_all(text, {lit(salience.UUID)}), regexp_extract_all(text, {lit(T.TICKET)})), list_concat(list_concat(regexp_extract_all(text, {lit(T.EMAIL)}), regexp_extract_all(text, {lit(T.IPV4)})), list_concat(regexp_extract_all(text, {lit(salience.SEMVER)}), regexp_extract_all(text, {lit(salience.PATH)}))))))) token from documents) select doc_id, token from t""")
def salient_patterns(spark, d):
    return X.table(spark, d, "documents").select("doc_id", F.explode(salience.pattern_tokens("text")).alias("token"))


@query(f"with {X.TURNS_SQL}, x as (select traj_id, turn_idx, unnest(list_distinct(regexp_extract_all(text, {lit(T.ANCHOR)}))) token from turns) select traj_id, turn_idx, token, count(*) as blocks from x group by all having count(*) >= 2")
def reference_index(spark, d):
    return salience.reference_index(X.conversation_turns(spark, d)).where("blocks >= 2")


@query(f"with {X.LOGS_SQL}, {lines_sql('logs')} select block_id, line_no::int as line_no, line from ls where regexp_matches(line, {lit(T.SURPRISE)}) or (regexp_matches(line, '^[+-]') and not regexp_matches(line, '^([+][+][+]|---)') and regexp_matches(line, '[^+ -]'))")
def surprise_lines(spark, d):
    return salience.surprise_lines(X.event_logs(spark, d)).select("block_id", "line_no", "line")


@query(f"""with t as (select unnest(list_distinct(regexp_extract_all(text, {lit(T.ANCHOR)}))) token from documents), u as (select distinct token from t where length(token) >= 10 and regexp_matches(token, '[0-9]') and regexp_matches(token, '\\p{{L}}')),
c as (select token, ch, count(*) n from (select token, unnest(string_split(token, '')) ch from u) where ch <> '' group by all) select token, round(-sum(n / length(token) * log2(n / length(token))), 6) as bits from c group by token""")
def token_entropy(spark, d):
    t = X.table(spark, d, "documents").select(F.explode(salience.anchors("text")).alias("token")).distinct()
    return t.where((F.length("token") >= 10) & F.col("token").rlike("[0-9]") & F.col("token").rlike(r"\p{L}")).select("token", F.round(T.entropy("token"), 6).alias("bits"))


@query()
def protected_truncation(spark, d):
    docs = X.document_blocks(spark, d)
    return salience.protect(docs, docs.select("block_id", F.expr("left(text, 200)").alias("text")))


STOPS = "[" + ", ".join(f"'{w}'" for w in T.STOP_TERMS) + "]"


@query(f"select item_id, unnest(list_filter(list_distinct(list_transform(regexp_extract_all(text, {lit(T.TERM)}), lambda x: lower(x))), lambda x: not list_contains({STOPS}, x))) as term from benchmark")
def intent_terms(spark, d):
    return X.table(spark, d, "benchmark").select("item_id", F.explode(T.terms("text")).alias("term"))


@query(f"""with {X.DOCS_SQL}, {lines_sql('docs')}, it as (select distinct unnest(list_transform(regexp_extract_all(text, {lit(T.TERM)}), lambda x: lower(x))) term from benchmark),
x as (select distinct block_id, n, line_no, line, term from (select block_id, n, line_no, line, unnest(list_transform(regexp_extract_all(line, {lit(T.TERM)}), lambda x: lower(x))) term from ls) where term in (select term from it) and not list_contains({STOPS}, term)),
f as (select *, count(*) over (partition by block_id, term) freq from x) select distinct block_id, line_no::int as line_no, line from f where freq <= greatest(1, floor(n * 0.4::double))""")
def relevant_lines(spark, d):
    """Lines of documents that bear on any of the benchmark's questions."""
    terms = X.table(spark, d, "benchmark").select(F.explode(T.terms("text")).alias("term")).distinct()
    return salience.relevant_lines(X.document_blocks(spark, d), terms)


@query("""with s as (select doc_id, text, left(text, 400) head, length(text) - length(replace(text, chr(10), '')) + 1 n from documents)
select doc_id, case when regexp_matches(text, '^\\s*[{\\[]') then 'json' when regexp_matches(head, '(?m)^\\s*File ".*", line |Error:|Exception|Traceback') then 'error' when regexp_matches(head, '(?m)^\\s*(private |public |let |const |function |import |class |def )') then 'code'
 when regexp_matches(head, '\\b(TRACE|ERROR|WARN|DEBUG|INFO)\\b|[0-9]{4}-[0-9]{2}-[0-9]{2}') then 'log' else 'prose' end || ':' || case when n < 10 then 's' when n < 40 then 'm' when n < 150 then 'l' else 'xl' end as sig from s""")
def content_signature(spark, d):
    return X.table(spark, d, "documents").select("doc_id", T.signature("text").alias("sig"))


BM25_SQL = f"""with q as (select item_id query_id, unnest(regexp_extract_all(lower(text), '{retrieval.WORD}')) term from benchmark where item_id < 20), qw as (select query_id, term, count(*) weight from q group by all),
d as (select doc_id, regexp_extract_all(lower(text), '{retrieval.WORD}') w from documents), st as (select count(*) nd, avg(len(w)) avgdl from d),
tf as (select doc_id, len(w) dl, term, count(*) tf from (select doc_id, w, unnest(w) term from d) where term in (select term from q) group by doc_id, len(w), term), df as (select term, count(*) df from tf group by term),
s as (select query_id, doc_id, sum(weight * ln(1 + (nd - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) score from tf join df using (term) join qw using (term), st group by all)
select query_id, doc_id, round(score, 6) as score, place::int as place from (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) place from s where score > 0) where place <= 5"""


@query(BM25_SQL.replace(" where item_id < 20", ""))
def bm25_topk(spark, d):
    return retrieval.bm25(X.table(spark, d, "documents").select("doc_id", "text"), X.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


@query(f"""with {X.LOGS_SQL}, {lines_sql('logs')}, w as (select block_id, line_no, line, regexp_extract_all(lower(line), '{retrieval.WORD}') w from ls), st as (select block_id, count(*) nd, avg(len(w)) avgdl from w group by block_id),
tf as (select block_id, line_no, line, len(w) dl, term, count(*) tf from (select *, unnest(w) term from w) where term in ('error', 'purchase') group by all), df as (select block_id, term, count(*) df from tf group by all),
s as (select block_id, line_no, line, sum(ln(1 + (nd - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) score from tf join df using (block_id, term) join st using (block_id) group by all)
select block_id, line_no::int as line_no, line from (select *, row_number() over (partition by block_id order by round(score, 9) desc, line_no) place from s) where place <= 5""")
def bm25_lines(spark, d):
    return retrieval.bm25_lines(X.event_logs(spark, d), "error purchase")


@query()
def columnar_fold_orders(spark, d):
    o = X.table(spark, d, "orders")
    cells = F.struct("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))
    g = o.groupBy("o_custkey").agg(F.to_json(F.array_sort(F.collect_list(cells))).alias("text"))
    return g.select("o_custkey", F.length("text").alias("chars"), C.udf(C.fold)("text").alias("folded"))


@query("""select event_id, replace(replace(props, ': ', ':'), ', ', ',') as minified, replace(replace(props, ': ', ':'), ', ', ',') as canonical from events""")
def minify_json(spark, d):
    e = X.table(spark, d, "events")
    return e.select("event_id", C.udf(C.minify_json)("props").alias("minified"), C.udf(C.canonical_json)("props").alias("canonical"))


@query()
def lifted_volatile(spark, d):
    texts = X.event_logs(spark, d)
    return texts.select("block_id", C.udf(lambda t: C.lift(t)[0])("text").alias("stable"), C.udf(lambda t: len(C.lift(t)[1]), "long")("text").alias("values"))


@query()
def tier1_blocks(spark, d):
    logs = X.event_logs(spark, d)
    return logs.select("block_id", C.udf(lambda t: C.lossless(t, "tool_output"))("text").alias("text"))


def _messages(spark, d):
    """Conversations with the event log of the user of the same number as a tool message at their end."""
    c = X.table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("pos"), "role", "text")
    logs = X.event_logs(spark, d).select(F.split("block_id", ":")[0].alias("session"), F.lit(-1).cast("long").alias("pos"), F.lit("tool").alias("role"), "text")
    return c.union(logs)


@query()
def live_messages(spark, d):
    return live.compress_messages(_messages(spark, d)).select("session", "pos", "role", "handle", F.length("text").alias("before"), F.length("sent").alias("after"))


@query(f"""with {X.LOGS_SQL}, t as (select conv_id::varchar as session, turn pos, text from conversations where role = 'tool' union all select string_split(block_id, ':')[1], -1, text from logs)
select session, pos, sha256(text) as sha, length(text)::bigint as chars from t""")
def live_round_trip(spark, d):
    """What comes back of each tool message: behind a handle, the text that the restore table gives for what was sent; else the message."""
    m = live.compress_messages(_messages(spark, d)).where("role = 'tool'").withColumn("nth", F.row_number().over(Window.partitionBy("session").orderBy("pos", F.sha2("text", 256))))
    sent = m.where("handle is not null").select("session", F.col("nth").alias("pos"), F.col("sent").alias("text"))
    back = live.expand(sent, live.restore_table(m)).select("session", F.col("pos").alias("nth"), F.col("text").alias("back"))
    out = m.join(back, ["session", "nth"], "left").withColumn("text", F.when(F.col("handle").isNull(), F.col("text")).otherwise(F.col("back")))
    return out.select("session", "pos", F.sha2("text", 256).alias("sha"), F.length("text").cast("long").alias("chars"))


@query(f"""with {X.DOCS_SQL} select block_id, case when len(string_split(text, chr(10))) <= 3 then text else '[…' || (len(string_split(text, chr(10))) - 3) || ' earlier turns dropped…]' || chr(10) || chr(10) || array_to_string(list_slice(string_split(text, chr(10)), -3, -1), chr(10) || chr(10)) end as text from docs""")
def last_entries(spark, d):
    x = X.document_blocks(spark, d).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    one = F.when(F.size(F.split("text", "\n\n", -1)) <= 3, F.replace("text", F.lit("\n\n"), F.lit("\n"))).otherwise(live.last_entries("text", 3))
    return x.select("block_id", one.alias("text"))


@query("""with e as (select event_id, '{"usage":{"input_tokens":' || floor(value)::bigint || ',"output_tokens":1}} {"output_tokens": ' || event_id || '}' body from events) select event_id, regexp_extract(body, '"input_tokens"\\s*:\\s*([0-9]+)', 1)::bigint as input_tokens, event_id as output_tokens from e""")
def response_usage(spark, d):
    e = X.table(spark, d, "events")
    body = F.concat(F.lit('{"usage":{"input_tokens":'), F.floor("value").cast("string"), F.lit(',"output_tokens":1}} {"output_tokens": '), F.col("event_id").cast("string"), F.lit("}"))
    return e.select("event_id", body.alias("body")).select("event_id", *live.usage("body"))

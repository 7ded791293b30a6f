"""Queries over decisions, losses and certificates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import codecs as C
from ..functions import stats as S
from ..functions import text as T
from ..operators import certify, learn, line_ops
from ..sources import fixtures as X
from .base import query
from .context import SCORE_SQL, lines_sql, lit, tok

LEVELS = (("none", 2**31 - 1), ("t16000", 16000), ("t8000", 8000), ("t4000", 4000), ("t2000", 2000), ("t1000", 1000))
MARKED_SQL = "mk as (select doc_id, lang, source, text, quality, toxic, text || chr(10) || 'DECISION: ' || case when toxic = 1 then 'remove' when quality = 1 then 'keep' else 'review' end as marked from documents join labels using (doc_id))"


def marked(spark, d):
    """Labelled documents as tool results, whole, with a decision at their end: a fixture of decisions that truncation loses."""
    j = X.table(spark, d, "documents").join(X.table(spark, d, "labels"), "doc_id")
    label = F.when(F.col("toxic") == 1, "remove").when(F.col("quality") == 1, "keep").otherwise("review")
    return j.withColumn("marked", F.concat("text", F.lit("\nDECISION: "), label))


def losses(spark, d):
    levels = F.array(*[F.struct(F.lit(i).alias("level_idx"), F.lit(n).alias("level"), F.lit(k).alias("lim")) for i, (n, k) in enumerate(LEVELS)])
    m = marked(spark, d).select("doc_id", "lang", "source", "marked", F.explode(levels).alias("l")).select("doc_id", "lang", "source", "marked", "l.*")
    m = m.withColumn("cut", F.expr("left(marked, lim)"))
    pick = lambda c: F.array_join(F.array_sort(certify.drivers(c)), " | ")
    return m.select("doc_id", "lang", "source", "level_idx", "level", (pick("cut") != pick("marked")).cast("double").alias("loss"), T.token_count("marked").alias("base_tok"), T.token_count("cut").alias("comp_tok"), (F.col("cut") != F.col("marked")).alias("changed"))


_dec = lambda c: f"coalesce(nullif(array_to_string(list_sort(list_filter(list_transform(regexp_extract_all({c}, 'DECISION:([^\\n]*)', 1), lambda x: trim(x)), lambda x: x <> '')), ' | '), ''), '<no-op>')"
LOSS_SQL = f"""{MARKED_SQL}, lv as (select * from (values {', '.join(f"({i}, '{n}', {k})" for i, (n, k) in enumerate(LEVELS))}) v(level_idx, level, lim)),
lo as (select doc_id, lang, source, level_idx, level, ({_dec('left(marked, lim)')} <> {_dec('marked')})::int::double loss, {tok('marked')} base_tok, {tok('left(marked, lim)')} comp_tok, left(marked, lim) <> marked changed from mk, lv)"""


@query(f"with {MARKED_SQL} select doc_id as traj_id, {_dec('marked')} as decision from mk")
def grade_deterministic(spark, d):
    m = marked(spark, d).select(F.col("doc_id").alias("traj_id"), F.col("marked").alias("text"))
    return certify.decide(m, keys=("traj_id",))


@query(f"""with {X.LOGS_SQL}, l as (select block_id, unnest(string_split(replace(text, ' value=', ' unit=cents value='), chr(10))) line from logs), f as (select block_id, regexp_extract_all(line, '\\b([A-Za-z_][\\w.]*=[\\w.:/+-]+)', 1) x from l),
g as (select block_id, list_sort(list_distinct(flatten(list(x) filter (len(x) >= 3)))) facts from f group by block_id) select block_id as traj_id, case when len(coalesce(facts, [])) = 0 then '<no-op>' else 'act:' || left(sha1(array_to_string(facts, '|')), 12) end as decision from g""")
def grade_smoke(spark, d):
    logs = X.event_logs(spark, d).select(F.col("block_id").alias("traj_id"), F.replace("text", F.lit(" value="), F.lit(" unit=cents value=")).alias("text"), F.lit("volatile").alias("stability"))
    return certify.smoke_decision(logs, ("traj_id",))


@query(f"""with {MARKED_SQL}, b as (select source traj_id, lang block_id, case when quality = 1 then text else marked end t from mk)
select traj_id, block_id, count(*) as occurrences, max({tok('t')})::bigint as max_tokens, not bool_or(contains(t, 'DECISION: ')) as prunable from b group by all""")
def ablation_prunable(spark, d):
    m = marked(spark, d)
    b = m.select(F.col("source").alias("traj_id"), F.col("lang").alias("block_id"), F.when(F.col("quality") == 1, F.col("text")).otherwise(F.col("marked")).alias("text"))
    return certify.ablation(b)


@query(f"with {LOSS_SQL} select level_idx::int as level_idx, level, count(*) as n, round(avg(loss), 6) as risk, round(coalesce(var_samp(loss), 0), 6) as var, round(1 - sum(comp_tok) / sum(base_tok), 6) as savings from lo group by all")
def frontier(spark, d):
    return certify.level_stats(losses(spark, d)).select("level_idx", "level", "n", *[F.round(c, 6).alias(c) for c in ("risk", "var", "savings")])


@query(f"with {LOSS_SQL} select level, round(avg(loss), 6) as rate, round(avg(loss) filter (changed), 6) as effective_rate, round(avg((not changed)::int), 6) as trivial from lo group by level")
def effective_change(spark, d):
    r = lambda c: F.round(c, 6)
    return losses(spark, d).groupBy("level").agg(r(F.avg("loss")).alias("rate"), r(F.avg(F.when(F.col("changed"), F.col("loss")))).alias("effective_rate"), r(F.avg((~F.col("changed")).cast("double"))).alias("trivial"))


@query(f"""with {LOSS_SQL}, s as (select lang, level, sum(loss) s, count(*) n from lo group by all), h as (select distinct lang held from s)
select held, level, round(sum(s) filter (lang <> held) / sum(n) filter (lang <> held), 6) as risk_elsewhere, round(sum(s) filter (lang = held) / sum(n) filter (lang = held), 6) as risk_held from h, s group by all""")
def domain_shift(spark, d):
    s = losses(spark, d).groupBy("lang", "level").agg(F.sum("loss").alias("s"), F.count("*").alias("n"))
    total = s.groupBy("level").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    return s.join(total, "level").select(F.col("lang").alias("held"), "level", F.round(F.try_divide(F.col("ts") - F.col("s"), F.col("tn") - F.col("n")), 6).alias("risk_elsewhere"), F.round(F.col("s") / F.col("n"), 6).alias("risk_held"))


@query(f"with {LOSS_SQL} select level, count(*) as trajectories, count(*) filter (ok) as retained from (select source, level, bool_and(loss = 0) ok from lo group by all) group by level")
def retained_success(spark, d):
    g = losses(spark, d).groupBy("source", "level").agg((F.max("loss") == 0).alias("ok"))
    return g.groupBy("level").agg(F.count("*").alias("trajectories"), F.count_if("ok").alias("retained"))


@query(f"""with {LOSS_SQL}, s as (select level_idx, level, count(*) n, avg(loss) risk from lo group by all), c as (select *, (n * risk + 1) / (n + 1) corrected from s)
select level_idx::int as level_idx, level, n, round(corrected, 6) as corrected, min((corrected <= 0.25)::int) over (order by level_idx) = 1 as passed from c""")
def crc_select(spark, d):
    return certify.crc(losses(spark, d), 0.25).select("level_idx", "level", "n", F.round("corrected", 6).alias("corrected"), "passed")


def hb_sql(risk: str, n: str, alpha: float) -> str:
    """SQL of the Hoeffding-Bentkus p-value for a risk that is a mean of n losses of 0 or 1."""
    tail = f"list_sum(list_transform(range(0, (round({n} * {risk}) + 1)::bigint), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({alpha}::double) + ({n} - i) * ln(1 - {alpha}::double))))"
    return f"(case when {n} = 0 or {risk} >= {alpha} then 1.0 else least(1.0, exp(-2 * {n} * ({alpha} - {risk}) * ({alpha} - {risk})), exp(1.0::double) * {tail}) end)"


@query(f"""with {LOSS_SQL}, s as (select level_idx, level, count(*) n, avg(loss) risk from lo group by all), p as (select *, {hb_sql('risk', 'n', 0.25)} pv from s)
select level_idx::int as level_idx, level, n, round(risk, 6) as risk, round(pv, 6) as p_value, min((pv <= 0.05)::int) over (order by level_idx) = 1 as passed from p""")
def ltt_certificate(spark, d):
    p = certify.ltt(losses(spark, d), 0.25, 0.05)
    return p.select("level_idx", "level", "n", F.round("risk", 6).alias("risk"), F.round("p_value", 6).alias("p_value"), "passed")


@query()
def ltt_bounds(spark, d):
    """Certified risk bounds of the levels, by bisection."""
    return certify.ltt(losses(spark, d), 0.25, 0.05).select("level", "n", "risk", "bound")


@query()
def tost_verdict(spark, d):
    x = losses(spark, d).select("level", (-F.col("loss")).alias("diff"))
    return certify.tost_table(x, ("level",))


@query("""with c as (select d.lang, count(*) n, count(*) filter (quality = 1 and toxic = 0) b, count(*) filter (quality = 0 and toxic = 1) c from labels join documents d using (doc_id) group by d.lang),
s as (select *, (c - b) / n delta, sqrt(greatest(0, ((b + c) - (b - c) * (b - c) / n) / (n * n))) se from c)
select lang, n, b, c, round(delta, 6) as delta, round(se, 6) as se, round(delta - 1.959963984540054 * se, 6) as ci_low, round(delta + 1.959963984540054 * se, 6) as ci_high, delta - 1.959963984540054 * se > -0.05 as noninferior from s""")
def mcnemar_ni(spark, d):
    """Paired outcomes of two conditions (labels as the pair) by language: discordant counts and non-inferiority."""
    j = X.table(spark, d, "labels").join(X.table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    g = j.groupBy("lang").agg(F.count("*").alias("n"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("b"), F.count_if((F.col("quality") == 0) & (F.col("toxic") == 1)).alias("c"))
    out = g.select("lang", "n", "b", "c", *S.mcnemar_columns(F.col("b"), F.col("c"), F.col("n")))
    return out.select("lang", "n", "b", "c", *[F.round(k, 6).alias(k) for k in ("delta", "se", "ci_low", "ci_high")], "noninferior")


@query("""with c as (select d.source, count(*) n, count(*) filter (quality = 1) k, avg(1 - quality) r, coalesce(var_samp(1 - quality), 0) v from labels join documents d using (doc_id) group by d.source), z as (select *, 1.959963984540054 z from c)
select source, n, k, round((k / n + z * z / (2 * n) - z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) as low, round((k / n + z * z / (2 * n) + z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) as high,
 round(case when n <= 1 then 1 else least(1, r + sqrt(2 * v * ln(20) / n) + 7 * ln(20) / (3 * (n - 1))) end, 6) as eb_bound, round(case when r >= 0.3 then 1 else exp(-2 * n * (0.3 - r) * (0.3 - r)) end, 6) as hoeffding_p from z""")
def interval_bounds(spark, d):
    """Wilson interval of the pass rate, empirical-Bernstein bound and Hoeffding p-value of the loss, by source."""
    j = X.table(spark, d, "labels").join(X.table(spark, d, "documents").select("doc_id", "source"), "doc_id").withColumn("loss", (1 - F.col("quality")).cast("double"))
    g = j.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("k"), F.avg("loss").alias("r"), F.coalesce(F.var_samp("loss"), F.lit(0.0)).alias("v"))
    low, high = S.wilson_columns(F.col("k"), F.col("n"))
    return g.select("source", "n", "k", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), F.round(S.bernstein_column(F.col("r"), F.col("v"), F.col("n"), 0.05), 6).alias("eb_bound"), F.round(S.hoeffding_column(F.col("r"), F.col("n"), 0.3), 6).alias("hoeffding_p"))


DRIFT_SQL = """with e as (select user_id::varchar k, row_number() over (partition by user_id order by ts, event_id) i, (event_type = 'error')::int::double loss from events),
m as (select *, (0.5 + sum(loss) over (partition by k order by i)) / (1 + i) mu from e), q as (select *, (loss - mu) * (loss - mu) sq from m),
v as (select *, case when i = 1 then 0.25 else (0.25 + sum(sq) over (partition by k order by i rows between unbounded preceding and 1 preceding)) / i end var from q),
s as (select *, least(0.5, sqrt(2 * ln(20) / (var * i))) stake from v), f as (select *, exp(sum(ln(1 + stake * (loss - 0.15))) over (partition by k order by i)) free from s),
t as (select *, min(case when free >= 20 then i end) over (partition by k) trip from f)
select k as key, i::int as i, loss, round(stake, 6) as stake, round(case when i >= coalesce(trip, i + 1) then min(case when i = trip then free end) over (partition by k) else free end, 6) as capital, i >= coalesce(trip, i + 1) as tripped from t"""


@query(DRIFT_SQL)
def drift_capital(spark, d):
    e = X.table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.struct("ts", "event_id").alias("seq"), (F.col("event_type") == "error").cast("double").alias("loss"))
    return certify.drift(e, ("key",), alpha=0.15).select("key", "i", "loss", F.round("stake", 6).alias("stake"), F.round("capital", 6).alias("capital"), "tripped")


@query("""with v as (select doc_id, g, x from (select doc_id, quality q, toxic t from labels), lateral (values ('a', q = 0), ('b', t = 1), ('c', q = 0 or t = 1)) z(g, x))
select doc_id, bool_or(x) as any_changed, sum(x::int) * 2 > count(*) as majority, bool_and(x) as unanimous from v group by doc_id""")
def ensemble_votes(spark, d):
    lab = X.table(spark, d, "labels")
    votes = F.array(F.col("quality") == 0, F.col("toxic") == 1, (F.col("quality") == 0) | (F.col("toxic") == 1))
    return certify.ensemble(lab.select("doc_id", F.explode(votes).alias("vote")), ("doc_id",))


@query(f"""with g as (select n_chars::double score, count(*) k, count(*) filter (toxic = 1) m from labels join documents using (doc_id) group by 1),
c as (select score threshold, coalesce(sum(k) over w, 0)::bigint n, coalesce(sum(m) over w, 0)::bigint misses from g window w as (order by score rows between unbounded preceding and 1 preceding))
select threshold, n, misses from c where n = 0 or {hb_sql('(misses::double / n)', 'n', 0.2)} <= 0.05 order by threshold desc limit 1""")
def speculative_threshold(spark, d):
    j = X.table(spark, d, "labels").join(X.table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return certify.speculative_threshold(j.select(F.col("n_chars").cast("double").alias("score"), (F.col("toxic") == 1).alias("diverged")), alpha=0.2).drop("bound")


@query("select doc_id, round(('0x' || left(sha256(doc_id::varchar), 8))::bigint / 4294967296.0::double, 9) as bucket, ('0x' || left(sha256(doc_id::varchar), 8))::bigint / 4294967296.0::double < 0.2 as control from documents")
def holdout_bucket(spark, d):
    docs = X.table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("key"))
    b = learn.bucket("key", 4294967296.0)
    return docs.select("doc_id", F.round(b, 9).alias("bucket"), (b < 0.2).alias("control"))


@query()
def bootstrap_interval(spark, d):
    """Mean, bootstrap interval, betting and tight bounds of the loss by language, over values in order of doc_id."""
    j = X.table(spark, d, "labels").join(X.table(spark, d, "documents").select("doc_id", "lang"), "doc_id")

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        v = (1 - pdf.sort_values("doc_id")["quality"]).astype(float).tolist()
        return pd.DataFrame([(key[0], len(v), *S.bootstrap_ci(v), S.betting_bound(v, 0.05), S.tight_bound(v, 0.05))], columns=["lang", "n", "mean", "low", "high", "betting", "tight"])

    return j.select("doc_id", "lang", "quality").groupBy("lang").applyInPandas(one, "lang string, n long, mean double, low double, high double, betting double, tight double")


@query(f"with {X.DOCS_SQL}, {lines_sql('docs')} select line, max(case when contains(line, '!!') or contains(line, '%%%') then 0 else 1 end)::int as label from ls group by line")
def causal_labels(spark, d):
    x = line_ops.explode_lines(X.document_blocks(spark, d))
    return learn.causal_labels(x.select("line", F.when(F.col("line").contains("!!") | F.col("line").contains("%%%"), 0).otherwise(1).alias("label")))


@query(f"""with {X.LOGS_SQL}, {lines_sql('logs')}, f as (select *, trim(line) s from ls)
select block_id, line_no::int as line_no, case when s = '' then 0.0 else (regexp_matches(lower(s), '{'|'.join(T.ALARM_WORDS)}'))::int::double end as alarm, case when s = '' then 0.0 else regexp_matches(s, {lit(T.STRUCTURED)})::int::double end as structured,
 round(case when s = '' then 0.0 else least(1.0, len(regexp_extract_all(s, '[0-9]')) / greatest(length(s), 1)) end, 6) as digits, round(case when s = '' then 0.0 else least(1.0, length(s) / 120.0) end, 6) as length, {SCORE_SQL}::double as score from f""")
def line_features(spark, d):
    x = line_ops.explode_lines(X.event_logs(spark, d))
    f = {n: c for n, c in zip(T.FEATURES, T.features("line"), strict=True)}
    return x.select("block_id", "line_no", f["alarm"], f["structured"], F.round(f["digits"], 6).alias("digits"), F.round(f["length"], 6).alias("length"), T.keep_score("line").alias("score"))


@query()
def keep_model(spark, d):
    """A keep model fitted on log lines and documents, judged on held-out lines."""
    blocks = X.event_logs(spark, d).union(X.document_blocks(spark, d))
    data = learn.dataset(blocks).withColumn("held", learn.bucket("line") < 0.2)
    w = learn.fit(data.where("not held"))
    return learn.evaluate(data.where("held").withColumn("p", learn.probability(w)))


@query("""select event_id, 'tool:' || left(sha256('{"args":{"v":' || floor(value)::bigint || '},"name":"' || event_type || '"}'), 12) as signature from events""")
def decision_signatures(spark, d):
    e = X.table(spark, d, "events")
    body = F.to_json(F.struct(F.array(F.struct(F.lit("tool_use").alias("type"), F.col("event_type").alias("name"), F.struct(F.floor(F.col("value")).alias("v")).alias("input"))).alias("content")))
    return e.select("event_id", C.udf(C.decision_signature)(body).alias("signature"))


@query(f"""with {LOSS_SQL}, g as (select source traj_id, doc_id turn_idx, 5 - level_idx rung_idx, level, loss = 0 same, comp_tok tokens from lo),
s as (select traj_id, turn_idx, arg_min(level, rung_idx) filter (same) rung, arg_min(tokens, rung_idx) filter (same) tk, arg_min(level, rung_idx) top, arg_min(tokens, rung_idx) tt from g group by all),
k as (select *, tk - tt gain, floor((1 - 0.9::double) * count(*) over (partition by traj_id) + 1e-6) budget, row_number() over (partition by traj_id order by greatest(tk - tt, 0) desc, turn_idx) rk from s)
select traj_id, turn_idx, case when gain > 0 and rk <= budget then top else rung end as rung, (case when gain > 0 and rk <= budget then tt else tk end)::bigint as tokens, gain > 0 and rk <= budget as diverges from k""")
def certified_fallback(spark, d):
    g = losses(spark, d).select(F.col("source").alias("traj_id"), F.col("doc_id").alias("turn_idx"), (5 - F.col("level_idx")).alias("rung_idx"), F.col("level").alias("rung"), (F.col("loss") == 0).alias("same"), F.col("comp_tok").alias("tokens"))
    return certify.certified_fallback(g, 0.9)


@query("""with p as (select d.lang as name, dense_rank() over (order by d.lang) g, quality q, toxic t from labels join documents d using (doc_id)), c as (select name, any_value(g)::int as gate_recent, count(*) filter (q = 1 and t = 0) b, count(*) filter (q = 0 and t = 1) c, count(*) n from p group by name),
s as (select *, (b - c) / n delta, sqrt(greatest(0, ((b + c) - (c - b) * (c - b) / n) / (n * n))) se from c)
select name, gate_recent, n, round(delta, 6) as delta from s where delta - 1.959963984540054 * se > -0.05 order by gate_recent limit 1""")
def operating_point(spark, d):
    from pyspark.sql import Window

    j = X.table(spark, d, "labels").join(X.table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    c = j.groupBy(F.col("lang").alias("name")).agg(F.count_if((F.col("quality") == 0) & (F.col("toxic") == 1)).alias("b"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("c"), F.count("*").alias("n"))
    p = c.withColumn("gate_recent", F.dense_rank().over(Window.orderBy("name")))  # a row for each language
    return certify.operating_point(p).select("name", "gate_recent", "n", F.round("delta", 6).alias("delta"))


@query(f"""with o as (select count(*) n, avg((quality = 1 and toxic = 1)::int) risk from labels), p as (select *, case when n < 20 then 1.0 else {hb_sql('risk', 'n', 0.2)} end pv from o) select n, round(risk, 6) as risk, round(pv, 6) as p_value, pv <= 0.05 as certified from p""")
def trajectory_risk(spark, d):
    o = X.table(spark, d, "labels").select((F.col("quality") == 1).alias("full_success"), (F.col("toxic") == 0).alias("compressed_success"))
    return certify.trajectory_risk(o, alpha=0.2).select("n", F.round("risk", 6).alias("risk"), F.round("p_value", 6).alias("p_value"), "certified")


@query(f"""with {LOSS_SQL}, s as (select source t, level_idx, level, sum(loss) s, count(*) n from lo group by all), r as (select *, ('0x' || left(sha256(t || ':' || rep), 8))::bigint % 2 = 0 cal from s, (select unnest(range(0, 100)) rep)),
g as (select rep, level_idx, level, coalesce(sum(s) filter (cal), 0) s1, coalesce(sum(n) filter (cal), 0) n1, coalesce(sum(s) filter (not cal), 0) s0, coalesce(sum(n) filter (not cal), 0) n0 from r group by all),
p as (select *, case when n1 = 0 then 1.0 else {hb_sql('(s1 / n1)', 'n1', 0.6)} end pv from g), q as (select *, min((pv <= 0.05)::int) over (partition by rep order by level_idx) = 1 passed from p),
b as (select rep, arg_max(level, level_idx) as level, arg_max(s0 / greatest(n0, 1), level_idx) risk from q where passed group by rep) select level, count(*) as splits, round(avg((risk <= 0.6)::int), 6) as coverage from b group by level""")
def split_coverage(spark, d):
    x = losses(spark, d).select(F.col("source").alias("traj_id"), "level_idx", "level", "loss")
    return certify.split_coverage(x, 0.6, 0.05).groupBy("level").agg(F.count("*").alias("splits"), F.round(F.avg(F.col("covered").cast("double")), 6).alias("coverage"))

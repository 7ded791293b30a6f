"""Ledgers, tenants, session forensics, shadow rates, leaderboards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import cost

ERA = 2


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def ledger_summary(ledger: DataFrame, by: Sequence[str] = (), since: float | None = None, session: str | None = None) -> DataFrame:
    """Runs, dollars, tokens, legacy rows (no era, or one before ERA) and rows with a missing figure, by the given columns.

    The filters run first, then rows that lack a figure are counted as corrupt and left out of sums.
    """
    x = ledger
    if since is not None:
        x = x.where(F.col("ts") >= since)
    if session is not None:
        x = x.where(F.col("session") == session)
    figures = ["baseline_dollars", "sent_dollars", "baseline_input_tokens", "sent_input_tokens"]
    bad = F.greatest(*[F.col(c).isNull().cast("int") for c in figures]) == 1
    x = x.withColumn("bad", bad)
    total = lambda c: F.coalesce(F.sum(F.when(~F.col("bad"), F.col(c))), F.lit(0)).alias(c)
    g = x.groupBy(*by).agg(
        F.count_if(~F.col("bad")).alias("runs"), F.count_if("bad").alias("corrupt"), F.count_if(~F.col("bad") & (F.coalesce("acct", F.lit(0)) < ERA)).alias("legacy"), *[total(c) for c in figures]
    )
    return g.withColumn("dollars_saved", F.round(F.col("baseline_dollars") - F.col("sent_dollars"), 6)).withColumn("pct_saved", F.round(ratio(F.col("baseline_dollars") - F.col("sent_dollars"), F.col("baseline_dollars")), 6))


def per_model(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("model").agg(F.count("*").alias("requests"), F.sum("baseline_input_tokens").alias("baseline"), F.sum("sent_input_tokens").alias("sent"))


def latest_session(ledger: DataFrame) -> DataFrame:
    """(session, ts) of the newest row with a session; the later row wins ties."""
    return ledger.where("session <> ''").agg(F.max_by("session", F.struct("ts", "seq")).alias("session"), F.max("ts").alias("ts"))


def sessions(ledger: DataFrame, manifests: DataFrame) -> DataFrame:
    """Every session that a ledger row or a manifest names: runs, first and last activity (zero means unknown), whether it has a manifest."""
    a = ledger.where("session <> ''").groupBy("session").agg(F.count("*").alias("runs"), F.min(F.nullif("ts", F.lit(0.0))).alias("lo"), F.max("ts").alias("hi"))
    b = manifests.select("session", F.nullif("started", F.lit(0.0)).alias("started"), F.lit(True).alias("m"))
    j = a.join(b, "session", "full_outer")
    return j.select("session", F.coalesce("runs", F.lit(0)).alias("runs"), F.least("lo", "started").alias("first_ts"), F.greatest("hi", "started").alias("last_ts"), F.coalesce("m", F.lit(False)).alias("has_manifest"))


def tenant_snapshot(requests: DataFrame, price: float) -> DataFrame:
    """Requests, tokens, dollars and share saved for each tenant, and for all (tenant null): one pass by rollup."""
    g = requests.rollup("tenant").agg(F.count("*").alias("requests"), F.sum("tokens_baseline").alias("tokens_baseline"), F.sum("tokens_compressed").alias("tokens_compressed"))
    saved = F.greatest(F.lit(0), F.col("tokens_baseline") - F.col("tokens_compressed"))
    return g.withColumn("tokens_saved", saved).withColumn("dollars_saved", F.round(F.col("tokens_saved") * price, 6)).withColumn("pct_saved", F.round(ratio(F.col("tokens_saved"), F.col("tokens_baseline")), 6))


def tenant_of(header: str, key: str, trusted: bool) -> Column:
    """A trusted, well-formed header; else anon- and a hash of the key; else default."""
    good = F.col(header).rlike(r"^[A-Za-z0-9._-]{1,64}$") if trusted else F.lit(False)
    return F.when(good, F.col(header)).when(F.coalesce(F.col(key), F.lit("")) != "", F.concat(F.lit("anon-"), F.substring(F.sha2(F.col(key), 256), 1, 8))).otherwise("default")


def latency_by_path(requests: DataFrame) -> DataFrame:
    """(path, n, mean_ms): streamed, buffered because of an expansion, or buffered; the mean is cut to an integer."""
    path = F.when(F.col("stream"), "streamed").when(F.col("client_stream"), "buffered (forced)").otherwise("buffered")
    return requests.groupBy(path.alias("path")).agg(F.count("*").alias("n"), F.floor(F.sum("duration_ms") / F.count("*")).alias("mean_ms"))


def tool_costs(requests: DataFrame) -> DataFrame:
    """(name, tokens, requests, total) of each tool: its largest definition times the requests that carry it."""
    t = requests.select(F.explode("tools").alias("t"))
    return t.groupBy(F.col("t.name").alias("name")).agg(F.max("t.tokens").alias("tokens"), F.count("*").alias("requests")).withColumn("total", F.col("tokens") * F.col("requests"))


def unused_tools(requests: DataFrame, calls: DataFrame) -> DataFrame:
    return requests.select(F.explode("tools").alias("t")).select(F.col("t.name").alias("name")).distinct().join(calls.select("name"), "name", "left_anti")


def churn(blocks: DataFrame) -> DataFrame:
    """(blocks, churned, churn_tokens): distinct folded blocks, those folded more than once, and the tokens of the repeats."""
    g = blocks.groupBy("h").agg(F.count("*").alias("folds"), F.first("tokens").alias("tokens"))
    return g.agg(F.count("*").alias("blocks"), F.count_if(F.col("folds") >= 2).alias("churned"), F.sum(F.col("tokens") * (F.col("folds") - 1)).alias("churn_tokens"))


def blocks_by_kind(blocks: DataFrame) -> DataFrame:
    g = blocks.groupBy("h").agg(F.min("sig").alias("sig"), F.first("tokens").alias("tokens"))
    return g.groupBy("sig").agg(F.count("*").alias("blocks"), F.sum("tokens").alias("tokens"))


def top_blocks(blocks: DataFrame, k: int = 10) -> DataFrame:
    g = blocks.groupBy("h").agg(F.min("sig").alias("sig"), F.max("tokens").alias("tokens"), F.count("*").alias("folds"))
    return g.orderBy(F.desc("tokens"), "h").limit(k)


def expansion_regret(blocks: DataFrame, expanded: DataFrame) -> DataFrame:
    """(sig, expanded, folded): distinct blocks of each signature that were asked for again, of those folded."""
    b = blocks.groupBy("h").agg(F.min("sig").alias("sig"))
    j = b.join(expanded.select("h").distinct().withColumn("asked", F.lit(1)), "h", "left")
    return j.groupBy("sig").agg(F.coalesce(F.sum("asked"), F.lit(0)).alias("expanded"), F.count("*").alias("folded")).where("expanded > 0")


def calibration(requests: DataFrame) -> DataFrame:
    """(estimated, billed, ratio) over requests with billed usage."""
    est = F.col("overhead_tokens") + F.greatest(F.lit(0), F.col("compressible_tokens") - F.col("tokens_saved"))
    g = requests.where("usage_input_tokens is not null").agg(F.sum(est).alias("estimated"), F.sum("usage_input_tokens").alias("billed"))
    return g.withColumn("ratio", ratio(F.col("estimated"), F.col("billed")))


def overhead_share(requests: DataFrame) -> DataFrame:
    o, c = F.sum("overhead_tokens"), F.sum("compressible_tokens")
    return requests.agg(o.alias("overhead"), F.floor(F.avg("overhead_tokens")).alias("overhead_avg"), ratio(o, o + c).alias("share"))


def growth(requests: DataFrame) -> DataFrame:
    """First and last size of the system prompt that isn't zero."""
    r = requests.where("system_tokens > 0")
    return r.agg(F.min_by("system_tokens", "seq").alias("first"), F.max_by("system_tokens", "seq").alias("last"), F.count("*").alias("n")).where("n >= 2").drop("n")


def anomalies(sessions_: DataFrame) -> DataFrame:
    """Sessions with what is unusual about them, against the median of all (the middle element, not interpolated).

    sessions_: session, requests, errors, saved, baseline, ms. The median comes from an exact
    distributed percentile over one row a session.
    """
    mid = sessions_.agg(F.expr("percentile_disc(0.5) within group (order by ms)").alias("mid_ms"))
    s = sessions_.crossJoin(F.broadcast(mid))
    found = F.array_compact(F.array(
        F.when(F.col("errors") * 5 >= F.col("requests"), "errors"), F.when(F.col("saved") <= 0, "no savings"), F.when(F.col("ms") > 2 * F.col("mid_ms"), "slow"), F.when(F.col("requests") < 3, "few requests"),
    ))
    return s.withColumn("found", found).where(F.size("found") > 0).select("session", F.array_join("found", ", ").alias("findings"))


def nearest_rank(values: DataFrame, column: str, keys: Sequence[str] = (), ps: Sequence[int] = (50, 95)) -> DataFrame:
    """Nearest-rank percentiles (no interpolation) and the mean."""
    parts = [F.expr(f"percentile_disc({p / 100}) within group (order by {column})").alias(f"p{p}") for p in ps]
    return values.groupBy(*keys).agg(*parts, F.avg(column).alias("mean"))


def leaderboard(submissions: DataFrame) -> DataFrame:
    """Newest verified submission of each instance, by tokens saved; totals count certified ones only, instances all.

    submissions: instance_id, tokens_saved, dollars_saved, certified, ts, seq, verified.
    """
    w = Window.partitionBy("instance_id").orderBy(F.desc("ts"), "seq")
    latest = submissions.where("verified").withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")
    total = latest.agg(F.count("*").alias("instances"), F.sum(F.when(F.col("certified"), F.col("tokens_saved"))).alias("total_tokens"), F.sum(F.when(F.col("certified"), F.col("dollars_saved"))).alias("total_dollars"))
    return latest.select("instance_id", "tokens_saved", "dollars_saved", "certified").crossJoin(F.broadcast(total))


def shadow_rates(rows: DataFrame, last: int = 1000, least_aa: int = 10) -> DataFrame:
    """(rate, n, agreement, n_aa, adjusted): share of changed decisions over the last A/B rows, agreement of A/A rows, and the rate beyond it."""
    newest = rows.where("kind = 'ab'").orderBy(F.desc("ts"), F.desc("seq")).limit(last)
    ab = newest.agg(F.avg((~F.col("equivalent")).cast("double")).alias("rate"), F.count("*").alias("n"))
    aa = rows.where("kind = 'aa'").agg(F.avg(F.col("equivalent").cast("double")).alias("a"), F.count("*").alias("n_aa"))
    j = ab.crossJoin(aa).withColumn("agreement", F.when(F.col("n_aa") >= least_aa, F.col("a")))
    kept = F.least(F.lit(1.0), (1 - F.col("rate")) / F.col("agreement"))
    return j.select("rate", "n", "agreement", "n_aa", F.when(F.col("agreement") > 0, F.greatest(F.lit(0.0), 1 - kept)).alias("adjusted"))


def as_of(requests: DataFrame, marks: DataFrame, key: str, ts: str = "ts", value: str = "mark") -> DataFrame:
    """requests with the newest mark of their key at or before their time: one union and one window, no range join."""
    cols = requests.columns
    a = requests.withColumn("is_mark", F.lit(0)).withColumn(value, F.lit(None).cast(marks.schema[value].dataType))
    b = marks.select(key, ts, value).withColumn("is_mark", F.lit(1))
    for c in cols:
        if c not in (key, ts):
            b = b.withColumn(c, F.lit(None).cast(requests.schema[c].dataType))
    w = Window.partitionBy(key).orderBy(F.col(ts), F.desc("is_mark")).rowsBetween(Window.unboundedPreceding, 0)
    u = a.unionByName(b).withColumn(value, F.last(value, ignorenulls=True).over(w))
    return u.where("is_mark = 0").select(*cols, value)


def expand_prone(counts: DataFrame, least: int = 5, rate: float = 0.25) -> DataFrame:
    """Signatures that were digested at least `least` times and asked for again at `rate` or more. counts: sig, digested, expanded."""
    g = counts.groupBy("sig").agg(F.sum("digested").alias("digested"), F.sum("expanded").alias("expanded"))
    return g.withColumn("rate", ratio(F.col("expanded"), F.col("digested"))).where((F.col("digested") >= least) & (F.col("rate") >= rate))


def protect_prone(outcomes: DataFrame, least: int = 5, rate: float = 0.3) -> DataFrame:
    """Signatures whose trajectories degrade: outcomes has traj_id, sig, full_success, compressed_success; failed full runs say nothing."""
    o = outcomes.where("full_success").groupBy("traj_id", "sig").agg(F.min("compressed_success").alias("ok"))
    g = o.groupBy("sig").agg(F.count_if(~F.col("ok")).alias("degraded"), F.count_if("ok").alias("fine"))
    return g.withColumn("rate", F.col("degraded") / (F.col("degraded") + F.col("fine"))).where(((F.col("degraded") + F.col("fine")) >= least) & (F.col("rate") >= rate))


def first_writer(restore: DataFrame, keep: int = 500, ttl: float = 14 * 86400.0, now: float | None = None) -> DataFrame:
    """Restore rows (handle, text, ts): the first text of each handle, of them the newest `keep` within ttl seconds."""
    w = Window.partitionBy("handle").orderBy("ts", F.sha2("text", 256))
    f = restore.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")
    if now is not None:
        f = f.where(F.col("ts") >= now - ttl)
    return f.orderBy(F.desc("ts"), "handle").limit(keep)


def dissect(requests: DataFrame, shadow: DataFrame, restore: DataFrame, before: float = 1.0, after: float = 300.0) -> DataFrame:
    """One row for each session: its span, requests, tokens, distinct folded blocks, those that can be restored, and shadow rows in its span.

    requests: session, epoch, tokens_saved, compressible_tokens, h; restore: h; shadow: epoch, changed.
    Shadow rows carry no session, so they count by time: a span's rows are those up to its end less
    those before its begin. Running counts within each hour, over rows and ends together, and totals
    of the hours before give both in linear work, however many sessions a row falls in.
    """
    s = requests.groupBy("session").agg(
        F.min("epoch").alias("started"), F.max("epoch").alias("ended"), F.count("*").alias("requests"), F.sum("compressible_tokens").alias("baseline"), F.sum("tokens_saved").alias("saved")
    )
    blocks = requests.select("session", "h").distinct().join(restore.select("h").distinct().withColumn("known", F.lit(1)), "h", "left")
    b = blocks.groupBy("session").agg(F.count("*").alias("blocks"), F.coalesce(F.sum("known"), F.lit(0)).alias("restorable"))
    none = F.lit(None).cast("string")
    marks = shadow.select(none.alias("session"), F.lit(0).alias("sign"), "epoch", F.lit(1).alias("after"), F.lit(1).alias("row"), F.col("changed").cast("int").alias("changed"))
    # at equal times a begin comes before the rows there and an end after them
    for sign, at, order in ((-1, F.col("started") - before, 0), (1, F.col("ended") + after, 2)):
        marks = marks.union(s.select("session", F.lit(sign), at, F.lit(order), F.lit(0), F.lit(0)))
    marks = marks.withColumn("hour", F.floor(F.col("epoch") / 3600))
    hours = marks.groupBy("hour").agg(F.sum("row").alias("n"), F.sum("changed").alias("c"))
    upto = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)  # a row for each hour
    earlier = hours.select("hour", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("n0"), F.coalesce(F.sum("c").over(upto), F.lit(0)).alias("c0"))
    within = Window.partitionBy("hour").orderBy("epoch", "after").rowsBetween(Window.unboundedPreceding, 0)
    ends = marks.withColumn("n1", F.sum("row").over(within)).withColumn("c1", F.sum("changed").over(within)).where("session is not null").join(earlier, "hour")
    hit = ends.groupBy("session").agg(F.sum(F.col("sign") * (F.col("n0") + F.col("n1"))).alias("shadow_rows"), F.sum(F.col("sign") * (F.col("c0") + F.col("c1"))).alias("shadow_changed"))
    out = s.join(b, "session", "left").join(hit, "session", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("blocks", "restorable", "shadow_rows", "shadow_changed")})


def headlines(sessions_: DataFrame) -> DataFrame:
    """Plain sentences on what stands out in dissected sessions."""
    share = ratio(F.col("saved"), F.col("baseline"))
    said = F.array_compact(F.array(
        F.when(share >= 0.3, F.format_string("%.0f%% of the tokens were saved", share * 100)), F.when(F.col("restorable") < F.col("blocks"), F.format_string("%d blocks can't be restored", F.col("blocks") - F.col("restorable"))),
        F.when(F.col("shadow_changed") > 0, F.format_string("%d of %d shadowed decisions changed", F.col("shadow_changed"), F.col("shadow_rows"))),
    ))
    return sessions_.select("session", F.explode(said).alias("headline"))


def resolved_map(files: DataFrame, column: str) -> DataFrame:
    """(id, resolved) of score files: a flat JSON map to booleans, or one under per_instance to objects with a field resolved."""
    nested = F.from_json(column, "per_instance map<string, struct<resolved: boolean>>")["per_instance"]
    flat = F.from_json(column, "map<string, string>")
    deep = F.transform(F.map_entries(nested), lambda e: F.struct(e["key"].alias("id"), F.coalesce(e["value"]["resolved"], F.lit(False)).alias("resolved")))
    plain = F.transform(F.map_entries(flat), lambda e: F.struct(e["key"].alias("id"), (e["value"] == "true").alias("resolved")))
    return files.select(F.explode(F.when(nested.isNotNull(), deep).otherwise(plain)).alias("e")).select("e.*")


def mechanisms(requests: DataFrame) -> DataFrame:
    """By session what saved tokens and how its requests went; nulls count as nothing."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    g = requests.groupBy("session").agg(
        total("delta_tokens_saved").alias("delta_tokens_saved"), total("tokens_saved").alias("tokens_saved_total"), F.count_if(F.coalesce("mode", F.lit("")).isin("", "verbatim")).alias("verbatim_requests"),
        F.count_if(~F.coalesce("booked", F.lit(False))).alias("unbooked_requests"), F.count_if("shadow_sampled").alias("shadow_sampled"), F.count_if("expanded").alias("expand_resolved"),
        F.count_if(F.col("client_stream") & ~F.col("stream")).alias("forced_buffered"), total("usage_input_tokens").alias("usage_input_total"), F.count("usage_input_tokens").alias("usage_requests"),
    )
    return g.withColumn("digest_saved", F.greatest(F.lit(0).cast("long"), F.col("tokens_saved_total") - F.col("delta_tokens_saved")))


def runtime_savings(requests: DataFrame, default: str) -> DataFrame:
    """(model, requests, before, after, dollars_saved) of requests (model, before, after): a blank model is the default, an unknown one has no price, rows without input go."""
    m = F.coalesce(F.nullif(F.trim("model"), F.lit("")), F.lit(default))
    g = requests.groupBy(m.alias("model")).agg(F.count("*").alias("requests"), F.sum("before").alias("before"), F.sum("after").alias("after")).where("before > 0")
    p = cost.resolve_prices(g)
    return p.select("model", "requests", "before", "after", F.coalesce((F.col("before") - F.col("after")) * F.col("input"), F.lit(0.0)).alias("dollars_saved"))


def resolve_sessions(queries: DataFrame, sessions_: DataFrame, newest: Column) -> DataFrame:
    """(query, session): `latest` is the one greatest by `newest`, else the equal id, else the only one that begins so; null if there is none.

    Prefixes are joined as keys: each session offers its own.
    """
    s = sessions_.select("session", newest.alias("newest"))
    last = s.agg(F.max_by("session", "newest").alias("last"))  # one row
    parts = s.select("session", F.explode(F.transform(F.sequence(F.lit(1), F.length("session")), lambda k: F.substring("session", F.lit(1), k))).alias("query"))
    known = parts.groupBy("query").agg(F.count("*").alias("n"), F.min("session").alias("one"), F.max(F.when(F.col("query") == F.col("session"), F.col("session"))).alias("same"))
    j = queries.join(known, "query", "left").crossJoin(F.broadcast(last))
    return j.select("query", F.when(F.col("query") == "latest", F.col("last")).otherwise(F.coalesce("same", F.when(F.col("n") == 1, F.col("one")))).alias("session"))


def is_contents_path(path: Column) -> Column:
    """Whether a request path, its query string aside, asks for (streamed) generation from contents and parts."""
    return F.regexp_replace(path, r"\?.*$", "").rlike(r"^/v[0-9]+(?:beta|alpha)?[0-9]*/(?:[^:]*/)?models/[^/:]+:(?:streamG|g)enerateContent$")


def session_keys(messages: DataFrame, by: str) -> DataFrame:
    """(by, session_key): 16 hexadecimal digits of SHA-256 over the first message (turn, role, content) in JSON with sorted keys."""
    first = messages.groupBy(by).agg(F.min(F.struct("turn", "role", "content")).alias("m"))
    return first.select(by, F.substring(F.sha2(F.to_json(F.struct(F.col("m.content").alias("content"), F.col("m.role").alias("role"))), 256), 1, 16).alias("session_key"))


def primary_argument(column: str) -> Column:
    """The value of the smallest key of a JSON object; the trimmed text where it is none."""
    m = F.from_json(column, "map<string, string>")
    return F.when(F.size(m) > 0, F.element_at(m, F.array_min(F.map_keys(m)))).otherwise(F.trim(column))


def is_folded(text: Column) -> Column:
    return text.startswith("«")

from __future__ import annotations

import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import codecs as C
from palimpsest.operators import analytics, certify, learn, live, turn_ops
from palimpsest.operators import techniques as K
from palimpsest.streaming import online

DDL = "traj_id long, turn_idx long, pos long, block_id string, kind string, stability string, text string"


def turns(spark):
    """Three turns of two trajectories; a decision at the end of the tool output."""
    log = "\n".join(f"line {i} of the tool output, value {i * 7}" for i in range(40))
    rows = []
    for j in range(2):
        for t in range(3):
            rows += [(j, t, 0, "sys", "system", "stable", "Follow the rules. " * 20), (j, t, 1, f"h{t}", "history", "settling", f"what was said {t}"), (j, t, 2, f"o{t}", "tool_output", "volatile", f"{log}\nround {t}\nDECISION: go {t}"), (j, t, 3, "noise", "retrieved", "volatile", "unrelated words " * 30)]
    return spark.createDataFrame(rows, DDL)


def test_measure(spark):
    t = turns(spark)
    rep = {r["technique"]: r for r in K.measure(t, [*K.builtin().values(), K.truncated(100)]).collect()}
    assert set(rep) == {*K.builtin(), "truncate@100"}
    base = rep["baseline"]
    assert base["token_savings"] == base["dollar_savings"] == 0 and base["certified"]
    assert rep["truncate@100"]["equivalence"] == 0 and not rep["truncate@100"]["certified"] and rep["truncate@100"]["token_savings"] > 0.5
    for name in ("minify-all", "truncate-tail", "summarize", "lossless", "causal", "stream", "safe"):
        assert rep[name]["certified"], name
    assert rep["causal"]["token_savings"] > rep["lossless"]["token_savings"] >= 0
    report = K.measure(t, [K.builtin()["baseline"], K.builtin()["summarize"], K.truncated(100)])
    assert K.winner(report).first()["technique"] == "summarize" and K.raw_leader(report).first()["technique"] == "truncate@100"
    assert K.ceiling(report).first()[0] == rep["summarize"]["token_savings"] and K.ceiling(report.limit(0)).first()[0] == 0
    assert K.winner(report.where("not certified")).count() == 0


def test_text_forms(spark):
    r = random.Random(1)
    texts = ["", "a", "x" * 640, "x" * 641, "\n".join("w" * r.randrange(30) for _ in range(9)), "a\n\n b\n\nc\nd\ne\nf\ng", "one two\nthree four five\nsix\nseven eight nine ten"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", K.cut_middle("text"), K.ends("text"), K.informative("text")).orderBy("i").collect()
    for t, (_, cut, end, best) in zip(texts, got, strict=True):
        assert cut == (t if len(t) <= 640 else f"{t[:240]}\n…[{len(t) - 600} chars truncated]…\n{t[-360:]}")
        full = [x for x in t.split("\n") if x.strip(" ")]
        assert end == (t if len(full) <= 6 else f"{full[0]}\n…[{len(full) - 2} lines summarised]…\n{full[-1]}")
        lines = t.split("\n")
        if len(lines) <= 3:
            assert best == t
        else:
            assert len(best.split("\n")) == len(lines) - int(len(lines) * 0.4)


def test_external(spark):
    half = K.external("half", lambda texts: [t[: len(t) // 2] + " " * (len(t) if i == 0 else 0) for i, t in enumerate(texts)])
    out = {(r["traj_id"], r["turn_idx"], r["pos"]): r["text"] for r in half.rewrite(turns(spark)).collect()}
    want = {(r["traj_id"], r["turn_idx"], r["pos"]): r["text"] for r in turns(spark).collect()}
    assert all(out[k] == (t if k[2] == 0 else t[: len(t) // 2]) for k, t in want.items())
    with pytest.raises(Exception, match="1 texts for 4"):
        K.external("bad", lambda texts: texts[:1]).rewrite(turns(spark)).collect()
    assert K.load("textwrap:indent:Name").name == "Name"
    with pytest.raises(ValueError):
        K.load("nothing")


def test_byte_exact_order(spark):
    t = turns(spark).withColumn("pos", 3 - F.col("pos"))
    out = K.byte_exact(t).groupBy("traj_id", "turn_idx").agg(F.max(F.when(F.col("stability") != "volatile", F.col("pos"))).alias("a"), F.min(F.when(F.col("stability") == "volatile", F.col("pos"))).alias("b")).collect()
    assert all((r["a"], r["b"]) == (1, 2) for r in out)


def test_sessions_and_scores(spark):
    s = spark.createDataFrame([("abc", 1), ("abd", 3), ("ab", 2)], "session string, ts long")
    q = spark.createDataFrame([("latest",), ("ab",), ("a",), ("abc",), ("x",), ("abd",)], "query string")
    assert {r["query"]: r["session"] for r in analytics.resolve_sessions(q, s, F.col("ts")).collect()} == {"latest": "abd", "ab": "ab", "a": None, "abc": "abc", "x": None, "abd": "abd"}
    files = spark.createDataFrame([('{"a": true, "b": false}',), ('{"per_instance": {"c": {"resolved": true}, "d": {}}}',)], "j string")
    assert {r["id"]: r["resolved"] for r in analytics.resolved_map(files, "j").collect()} == {"a": True, "b": False, "c": True, "d": False}
    paths = {"/v1beta/models/m:generateContent": True, "/v1/models/a:streamGenerateContent?alt=sse": True, "/v1/models/a:countTokens": False, "/v1/messages": False}
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", analytics.is_contents_path(F.col("p")).alias("ok")).collect()
    assert {r["p"]: r["ok"] for r in got} == paths
    assert certify.sample_ids(s, "session", 2, "7").collect() == certify.sample_ids(s.repartition(3), "session", 2, "7").collect()
    p = spark.createDataFrame([(0, 0), (1, 9), (5, 5)], "b int, c int").select(certify.mcnemar_p("b", "c")).collect()
    assert p[0][0] == 1 and abs(p[1][0] - 22 / 1024) < 1e-9 and p[2][0] == 1


def test_prefix_dollars_exact(spark):
    r = random.Random(3)
    rows = [(j, t, k, f"b{k}", "history", "settling", " ".join(f"w{j}{k}{t if k > 4 else 0}" for _ in range(1 + (j + 7 * k) % 23))) for j in range(60) for t in range(3) for k in range(9)]
    r.shuffle(rows)
    t = spark.createDataFrame(rows, DDL)
    fresh, read = {}, {}
    tokens = {(x["traj_id"], x["turn_idx"], x["pos"]): x["n"] for x in t.select("traj_id", "turn_idx", "pos", K.T.token_count("text").alias("n")).collect()}
    for (j, i, k), n in tokens.items():
        into = read if i and k <= 4 else fresh
        into[j] = into.get(j, 0) + n
    want = {j: float(Decimal(10 * fresh[j] + read[j]) / 2_000_000) for j in fresh}
    assert dict(map(tuple, K.prefix_dollars(t).collect())) == want


def test_contents():
    big = "\n".join(f"line {i} of a log" for i in range(50))
    body = json.dumps({"contents": [{"role": "model", "parts": [{"text": "a  a"}]}, {"role": "user", "parts": [{"text": '{ "k" : 1 }'}, {"functionResponse": {"name": "f", "response": {"out": [big, 5]}}}, {"functionCall": {"args": {"x": big}}}]}, "odd"]})
    out = json.loads(C.rewrite_contents(body, live.plain, lambda t: live.tool_result(t, False, False, False, None)))
    parts = out["contents"][1]["parts"]
    assert out["contents"][0]["parts"][0]["text"] == "a  a" and parts[0]["text"] == '{"k":1}' and parts[2]["functionCall"]["args"]["x"] == big
    assert "handle=" in parts[1]["functionResponse"]["response"]["out"][0] and parts[1]["functionResponse"]["response"]["out"][1] == 5
    same = '{"contents": [{"role": "user", "parts": [{"text": "plain"}]}]}'
    for x in (same, "not json", "[1]", '{"messages": []}'):
        assert C.rewrite_contents(x, live.plain, live.plain) == x


def test_near_bases(spark):
    text = "\n".join(f"row {i} holds {i * i}" for i in range(60))
    rows = [(1, 0, text), (1, 1, "other\n" * 90), (1, 2, text.replace("row 7 ", "row seven ")), (1, 3, "short"), (1, 4, text), (2, 0, text), (2, 5, "\n".join(f"new {i}" for i in range(99)))]
    m = spark.createDataFrame(rows, "traj_id long, pos long, text string")
    got = {(r["traj_id"], r["pos"]): (r["base_pos"], r["shared"]) for r in turn_ops.near_bases(m).collect()}
    assert got == {(1, 2): (0, 59), (1, 4): (2, 59)}
    out = {r["pos"]: r for r in turn_ops.near_deltas(m).collect()}
    assert out[2]["sent"].startswith("«delta base=") and "+row seven " in out[2]["sent"] and len(out[2]["sent"]) < len(text)


def test_learning_round(spark):
    r = learn.online_round(turns(spark).where("stability = 'volatile'")).first()
    assert r["trajectories"] == 2 and r["passed"] == 2 and r["promoted"] and r["accuracy"] > 0.9


def stream(spark, tmp_path, rows, ddl, build, mode):
    """Result rows of a stream over one file for each batch."""
    src = tmp_path / "in"
    for i, part in enumerate(rows):
        spark.createDataFrame(part, ddl).coalesce(1).write.json(f"{src}/{i:03d}")
    s = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(str(src))
    name = f"t{abs(hash(str(tmp_path))) % 10**9}"
    # without batches that only wait for time-outs, so that it ends
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    q = build(s).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.table(name).collect()


def test_session_delta_stream(spark, tmp_path):
    msgs = [["a"], ["a", "b", "c"], ["a", "b", "x", "y"], ["z"]]
    rows = [[("s", i, p, t) for p, t in enumerate(m)] for i, m in enumerate(msgs)]
    got = stream(spark, tmp_path, rows, "session string, request long, pos long, text string", online.session_delta, "append")
    assert {(r["request"], r["messages"], r["prefix"], r["fresh"]) for r in got} == {(0, 1, 0, 1), (1, 3, 1, 2), (2, 4, 2, 2), (3, 1, 0, 1)}


def test_savings_flush_stream(spark, tmp_path):
    rows = [[("m", 100, 40)] * 7, [("m", 100, 40)] * 6 + [("n", 5, 5)] * 10, [("m", 100, 40)] * 8]
    got = stream(spark, tmp_path, rows, "model string, before long, after long", lambda s: online.savings_flush(s, age="1 minutes"), "append")
    assert sorted((r["model"], r["requests"], r["before"], r["after"]) for r in got) == [("m", 10, 1000, 400)] * 2


def test_sampled(spark):
    d = spark.range(4000).withColumnRenamed("id", "request_id")
    a = {r[0] for r in online.sampled(d, 0.25).collect()}
    assert a == {r[0] for r in online.sampled(d.repartition(7), 0.25).collect()} and 850 < len(a) < 1150

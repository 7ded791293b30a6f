from __future__ import annotations

import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__
import corpus_pipeline
from palimpsest.llm import classifier, lm_scoring, quality_rules, shared
from palimpsest.llm import textkernels as tk

from .helpers import messy, odd_rows, prose


def test_ledger(spark):
    rows = [*odd_rows(), (20, "You IDIOT, " + prose(1, 30) + "."), (21, "a|b|c " * 30), (22, "LOUD " * 20), (23, "Lorem ipsum dolor sit amet.")]
    got = {r["doc_id"]: r for r in quality_rules.ledger(messy(spark, rows)).collect()}
    bit = {r.name: 1 << r.bit for r in quality_rules.RULES}
    assert got[1]["fail_bits"] == got[2]["fail_bits"] == bit["empty"]
    for i, name in ((20, "abuse"), (21, "symbols"), (22, "capitals"), (23, "boilerplate")):
        assert got[i]["fail_bits"] & bit[name]
    for i, t in rows:
        if i is not None and t:
            assert got[i]["words"] == len(re.findall(r"[^ \t\r\n\f]+", t)) and got[i]["chars"] == len(t)
    assert quality_rules.ledger(messy(spark, rows).limit(0)).count() == 0


def test_ablation(spark):
    p = quality_rules.POLICIES[1]
    rows = [(i, random.Random(i).randrange(1 << len(quality_rules.RULES))) for i in range(500)]
    got = {r["rule"]: r for r in quality_rules.ablation(spark.createDataFrame(rows, "doc_id long, fail_bits long"), (p,)).collect()}
    mask, fatal = p.mask((*p.rules, *p.fatal)), p.mask(p.fatal)
    keep = lambda b: not b & fatal and (b & mask).bit_count() < p.fails_from
    for r in quality_rules.RULES:
        if r.name in got:
            assert got[r.name]["failed"] == sum(b >> r.bit & 1 for _, b in rows)
            assert got[r.name]["kept"] == sum(keep(b) for _, b in rows)
            assert got[r.name]["kept_without"] == sum(keep(b & ~(1 << r.bit)) for _, b in rows)


def test_network_sees_every_byte():
    """A pattern is found wherever it is, in the last bytes of a long text too."""
    net = classifier.Network(4)
    net.w[:] = 0
    net.b[:], net.v[:], net.c[:] = 0, 0, 0
    word = b"idiot!!!"
    net.w[:, 0] = classifier.TABLE[np.frombuffer(word, np.uint8)].ravel()
    net.v[0] = 1
    for n in (0, 1, 7, 255, 256, 511, 512, 5000, 70_001):
        for texts in ([b"a" * n + word], [b"b" * 300, b"a" * n + word + b"c" * (n % 97), b""]):
            arr = pa.array([t.decode() for t in texts], pa.large_string())
            off, raw = tk.buffers(arr)
            data, first = classifier.layout(off, raw)
            h = net.halves(data)
            brute = [max((float(classifier.TABLE[np.frombuffer((bytes(8) + t + bytes(8))[i : i + 8], np.uint8)].ravel() @ net.w[:, 0]) for i in range(len(t) + 8)), default=0.0) for t in texts]
            got = [h[a:b, 0].max() for a, b in zip(first[:-1], first[1:])]
            assert np.allclose(np.maximum(got, 0), np.maximum(brute, 0), atol=1e-4), n
        if n > 5000:
            break


def test_classifier_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = shared.table(spark, d, "documents"), shared.table(spark, d, "labels")
    half = labels.where("doc_id % 2 = 0")
    net = classifier.train(docs, half)
    got = {r["doc_id"]: r for r in classifier.classify(docs, net).collect()}
    held = [(got[r["doc_id"]]["probability"], r["quality"] == 1 and r["toxic"] == 0) for r in labels.where("doc_id % 2 = 1").collect()]
    pos, neg = [p for p, g in held if g], [p for p, g in held if not g]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert auc > 0.85 and np.mean([p >= 0.5 for p in pos]) > 0.95


def by_hand(net, text):
    """The network's probability, byte by byte: windows, chunks of two halves that overlap by one, maximum and mean."""
    x = np.concatenate([np.zeros(classifier.WIDTH, np.uint8), np.frombuffer(text.encode(), np.uint8)])
    halves = -(-len(x) // classifier.HALF)
    x = np.concatenate([x, np.zeros(halves * classifier.HALF + classifier.WIDTH - len(x), np.uint8)])
    y = np.array([classifier.TABLE[x[i : i + classifier.WIDTH]].ravel() @ net.w + net.b for i in range(halves * classifier.HALF)])
    chunks = np.maximum([y[i * classifier.HALF : (i + 2) * classifier.HALF].max(0) for i in range(max(1, halves - 1))], 0)
    return 1 / (1 + np.exp(-(np.concatenate([chunks.max(0), chunks.mean(0)]) @ net.v + net.c[0])))


def test_classifier_query_by_hand(spark, data):
    """The query's probabilities on the whole small table against the definition, for each text."""
    got = {r["doc_id"]: r for r in classifier.op8_quality_classifier(spark, data).collect()}
    docs = shared.table(spark, data, "documents")
    net = classifier.train(docs, shared.table(spark, data, "labels"))
    rows = docs.collect()
    assert set(got) == {r["doc_id"] for r in rows}
    for r in sorted(rows, key=lambda r: len(r["text"] or ""))[:: max(1, len(rows) // 60)]:
        p = by_hand(net, r["text"] or "")
        assert math.isclose(p, got[r["doc_id"]]["probability"], abs_tol=2e-3) and (abs(p - 0.5) < 2e-3 or got[r["doc_id"]]["keep"] == (p >= 0.5))


def test_classifier_short_labelled_texts(spark):
    """Labelled texts of 0 to 9 bytes, good and bad, are fitted on."""
    rows = [(i, "abcdefghij"[:i]) for i in range(10)] + [(20 + i, "you utter moron! " * 3) for i in range(5)] + [(40 + i, prose(i, 30)) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for bad in (set(range(0, 10, 2)) | set(range(20, 25)), set(range(1, 10, 2)), set(range(10))):
        labels = spark.createDataFrame([(i, int(i not in bad), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
        assert classifier.classify(docs, classifier.train(docs, labels)).count() == len(rows)


def test_classifier_odd_rows(spark):
    docs = messy(spark, odd_rows())
    for labels in ("doc_id long, quality int, toxic int", None):
        lab = spark.createDataFrame([] if labels else [(4, 1, 0), (6, 0, 0), (6, 1, 0), (None, 1, 1), (5, None, 0)], labels or "doc_id long, quality int, toxic int")
        net = classifier.train(docs, lab)
        assert classifier.classify(docs, net).count() == len(odd_rows())
        assert classifier.kept(docs, net).columns == docs.columns
    assert classifier.classify(docs.limit(0), net).count() == 0


def test_language_model_gradients():
    m = lm_scoring.Model(np.ones(16), hidden=5, classes=4, per_class=4)
    for n in m.names:
        setattr(m, n, getattr(m, n).astype(np.float64))
    r = np.random.default_rng(1)
    x, y = r.integers(0, 16, (6, 3)), r.integers(0, 16, (6, 3))

    def loss(grads):
        out, _, saved, cand, start = m.steps(x, np.zeros((3, 5)), True)
        logp, dh = m.output(out.reshape(-1, 5).astype(np.float64), y.ravel(), grads)
        if grads is not None:
            m.backward(x, dh.reshape(out.shape).astype(np.float32), saved, cand, start, grads)
        return -float(np.sum(logp, dtype=float)) / y.size

    grads: dict = {}
    loss(grads)
    for n in m.names:
        p, g = getattr(m, n), grads[n]
        for i in r.choice(p.size, min(6, p.size), replace=False):
            at = np.unravel_index(i, p.shape)
            keep = p[at]
            p[at] = keep + 1e-2
            up = loss(None)
            p[at] = keep - 1e-2
            down = loss(None)
            p[at] = keep
            assert math.isclose((up - down) / 2e-2, g[at], abs_tol=2e-3), (n, at)


def test_language_model_is_whole_and_normalised():
    v = lm_scoring.Vocabulary(np.arange(5, 45, dtype=np.uint64), np.full(40, 10), np.ones(257 * 257), 500, 9)
    m = lm_scoring.Model(v.counts)
    texts = [[2, 3, 4], [], list(range(2, 40)) * 9, [0, 0]]
    ids = np.array([i for t in texts for i in t], np.int16)
    first = np.cumsum([0, *map(len, texts)])
    got = m.run(ids, first, train=False, window=7)
    for t, ll in zip(texts, got):  # one step at a time, without windows or lanes
        h, total = np.zeros((1, m.h), np.float32), 0.0
        for i, o in zip([lm_scoring.EDGE, *t], [*t, lm_scoring.EDGE]):
            out, h, *_ = m.steps(np.array([[i]]), h, False)
            total += float(m.output(out[0], np.array([o]), None)[0][0])
        assert math.isclose(total, ll, rel_tol=1e-4, abs_tol=1e-3)
    h = np.random.default_rng(0).standard_normal((1, m.h)).astype(np.float32)
    logs = m.output(np.repeat(h, v.size, 0), np.arange(v.size), None)[0]
    assert math.isclose(float(np.exp(logs).sum()), 1.0, rel_tol=1e-3)


def test_lm_lanes_last_and_long_windows():
    r = np.random.default_rng(4)
    size = np.r_[0, 1, 700, r.integers(1, 60, 40)]
    first = np.r_[0, np.cumsum(size)]
    ids = r.integers(0, 16, first[-1]).astype(np.int16)
    m = lm_scoring.Model(np.ones(16), hidden=5, classes=4, per_class=4)
    out, h, *_ = m.steps(ids[:12].reshape(4, 3), np.zeros((3, 5), np.float32), True)
    assert out.shape == (4, 3, 5) and h.shape == (3, 5) and out[0].T.flags.c_contiguous
    assert np.allclose(m.run(ids, first, False, window=lm_scoring.SCORED), m.run(ids, first, False, window=3, lanes=7), atol=1e-3)


def test_language_model_learns(spark):
    r = random.Random(3)
    say = lambda n: " ".join(w for _ in range(n) for w in r.choice(("the red fox runs", "a blue bird sings", "my old dog sleeps")).split())
    train, held = [say(40) for _ in range(400)], [say(30) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(train)), "doc_id long, text string").repartition(2)
    words = lm_scoring.vocabulary(docs)
    model = lm_scoring.train(docs, words, lanes=16)
    p = np.log(words.counts / words.counts.sum())
    ids, first, spell = words.encode(tk.plain(pa.array(held)))
    assert (spell == 0).all()
    unigram = sum(p[ids]) + len(held) * p[lm_scoring.EDGE]
    assert model.run(ids, first, train=False).sum() > 0.75 * unigram
    shuffled = [" ".join(r.sample(t.split(), len(t.split()))) for t in held]
    got = lm_scoring.score(spark.createDataFrame(list(enumerate(held + shuffled)), "doc_id long, text string"), words, model).orderBy("doc_id").collect()
    assert sum(r_["log_likelihood"] for r_ in got[:20]) > sum(r_["log_likelihood"] for r_ in got[20:])


def test_language_model_is_the_same_on_any_partitions(spark):
    """Equal scores for 1, 4 and 13 partitions, with several shards, and more than one of them beyond what is laid out at once."""
    rows = [(i, prose(i % 90, 60 + i)) for i in range(200)] + [(7, prose(7, 67))] * 3 + [(None, prose(1, 50)), (300, None), (301, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = []
    for n in (1, 4, 13):
        d = docs.repartition(n)
        words = lm_scoring.vocabulary(d)
        model = lm_scoring.train(d, words, lanes=8, shard_tokens=9000, rounds=2)
        got.append(sorted((str(r["doc_id"]), r["tokens"], r["log_likelihood"]) for r in lm_scoring.score(docs, words, model).collect()))
    assert len(got[0]) == len(rows)
    for other in got[1:]:
        assert [x[:2] for x in other] == [x[:2] for x in got[0]]
        assert all(math.isclose(a[2], b[2], rel_tol=1e-6) for a, b in zip(got[0], other))


def test_vocabulary_grows_and_shares(spark):
    """Every word that occurs twice is in it; the shares of the words of a unit add up to 1; spellings are distributions."""
    docs = spark.createDataFrame([(0, " ".join(f"w{i} " * (2 + 3000 // (i + 1)) for i in range(3000)) + " once never")], "doc_id long, text string")
    v = lm_scoring.vocabulary(docs)
    assert len(v.hashes) == 3000 and v.counts.sum() == v.size + v.total + 1
    shares = np.bincount(v.slots, weights=np.exp(v.within.astype(float)), minlength=v.size)
    assert np.allclose(shares[2:][shares[2:] > 0], 1, atol=1e-4)
    assert np.allclose(np.exp(v.spelling).reshape(257, 257).sum(1), 1)
    ids, first, apart = v.encode(tk.plain(pa.array(["w0 once", "w2999", "", "é"])))
    assert first.tolist() == [0, 2, 3, 3, 4] and ids[1] == lm_scoring.OTHER == ids[3] and ids[0] >= 2 and ids[2] >= 2
    s = v.spelling.reshape(257, 257)
    word = b"once"
    assert math.isclose(apart[0], s[256, word[0]] + sum(s[x, y] for x, y in zip(word, word[1:])) + s[word[-1], 256], rel_tol=1e-9)
    assert apart[1] < 0 == apart[2]
    few = lm_scoring.vocabulary(docs, most_words=100)
    assert 50 < len(few.hashes) <= 100


def test_language_model_odd_rows(spark):
    docs = messy(spark, odd_rows())
    words = lm_scoring.vocabulary(docs)
    model = lm_scoring.train(docs, words)
    got = lm_scoring.score(docs, words, model).collect()
    assert len(got) == len(odd_rows()) and all(r["log_likelihood"] < 0 for r in got)
    assert [r["tokens"] for r in got if r["doc_id"] == 6] == [30_000]
    none = docs.limit(0)
    assert lm_scoring.score(none, lm_scoring.vocabulary(none), lm_scoring.train(none, lm_scoring.vocabulary(none))).count() == 0


def test_replicas_are_averaged(spark, monkeypatch):
    rows = [(k, float(k + 1), lm_scoring._pack([np.full(3, float(k), np.float32)])) for k in range(10)]
    got = lm_scoring.average(spark.createDataFrame(rows, "shard long, weight double, params binary")).collect()
    assert len(got) == 1 and np.allclose(lm_scoring._unpack(got[0]["params"])[0], sum((k + 1) * k for k in range(10)) / 55)


def test_pipeline(spark, data):
    docs, n = shared.table(spark, data, "documents"), None
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = shared.written(stage(spark, docs, data), f"test-{name}")
        assert i == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        assert n is None or i == len(corpus_pipeline.STAGES) - 1 or docs.count() <= n
        n = docs.count()
    assert n > 0 and docs.groupBy("bin").sum("length").where("`sum(length)` > 2048").count() == 0
    again = {tuple(r) for r in corpus_pipeline.run(spark, data).collect()}
    assert again == {tuple(r) for r in docs.collect()}


def test_pipeline_odd_rows(spark, tmp_path):
    """Nulls, empties, repeated rows, different texts of one id: stages keep what is clean, as often as it is told apart."""
    good = [prose(600 + i, 120) for i in range(40)]
    rows = [(i, t) for i, t in enumerate(good)] + [(1, prose(900, 90)), (2, good[2]), (100, good[3]), (101, None), (None, prose(901, 60)), (102, ""), (103, prose(902, 40) + " " + prose(77, 60)), (104, prose(903, 40) + " " + prose(77, 60))]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, good[5]), (None, "x"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = str(tmp_path)
    docs = shared.table(spark, d, "documents")
    stages = dict(corpus_pipeline.STAGES)
    one = stages["near_dedup"](spark, docs, d)
    got = sorted((str(r["doc_id"]), r["text"] or "") for r in one.collect())
    want = [(str(i), t or "") for i, t in rows if i != 100]
    want.remove(("2", good[2]))
    assert got == sorted(want)
    two = {(r["doc_id"], r["text"]) for r in stages["substring_dedup"](spark, one, d).collect()}
    assert (1, good[1]) in two and (1, prose(900, 90)) in two and (104, prose(903, 40) + " ") in {(i, (t or "").rstrip() + " ") for i, t in two}
    three = stages["decontamination"](spark, one, d)
    assert 5 not in {r["doc_id"] for r in three.collect()} and three.count() == one.count() - 1
    packed = corpus_pipeline.run(spark, d)
    assert packed.where("doc_id = 1").count() == 2 and packed.where("doc_id is null").count() == 1


def test_pipeline_of_nothing(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        shared.table(spark, "/root/testdata/sf0.001", t).limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", [n for n in __spark_entry__.oracle_sql() if re.match(r"op\d+_|quality_", n)])
def test_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations", "labels"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()[name]).to_arrow_table()
    got = __spark_entry__.queries()[name](spark, data)
    cols = sorted(got.columns)
    assert cols == sorted(want.column_names)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in got.select(*cols).collect()), key=key) == sorted(zip(*[want[c].to_pylist() for c in cols]), key=key)

from __future__ import annotations

import itertools
import random

import duckdb
import pytest

from palimpsest.llm import near_dedup, shared, substring_dedup
from palimpsest.llm import textkernels as tk

from .helpers import edit, messy, odd_rows, prose


def shingles(text, n=3):
    w = [x.lower() for x in tk.TOKEN.findall(text or "")]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def brute_groups(rows, threshold):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if jaccard(sets[a], sets[b]) >= threshold]
    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return pairs, {i: find(i) for i in sets}


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (102, 101), (7, 7), (None, 5)]
    got = {r["node"]: r["root"] for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(21), 0), 100: 100, 101: 100, 102: 100}
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_against_brute_force(spark):
    rows = []
    for g in range(60):
        base = prose(g, 120)
        rows += [(g * 100 + k, edit(base, g * 7 + k, k % 8)) for k in range(1 + g % 6)]
    rows += [(10_000 + i, prose(500 + i, 90)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs).collect()}
    pairs, root = brute_groups(rows, near_dedup.THRESHOLD)
    hit = [(a, b) for a, b in pairs if a in got and b in got and got[a]["group_id"] == got[b]["group_id"]]
    assert len(hit) >= 0.95 * len(pairs)
    assert all(root[i] == root[r["group_id"]] for i, r in got.items())  # nothing joined that isn't alike
    assert all(r["keep"] == (i == r["group_id"]) for i, r in got.items())


def test_near_thousands_of_copies(spark):
    base = prose(1, 200)
    rows = [(i, edit(base, i, 4)) for i in range(1500)] + [(5000 + i, base) for i in range(1500)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) >= 2950 and max(sum(r["group_id"] == g for r in got) for g in {r["group_id"] for r in got}) >= 2900


def test_near_odd_rows(spark):
    docs = messy(spark, odd_rows())
    groups = near_dedup.near_duplicates(docs)
    got = {r["doc_id"]: r["group_id"] for r in groups.collect()}
    assert got == {4: 4, 5: 4, 6: 6, 7: 6}
    left = near_dedup.one_of_each(docs, groups)
    assert left.columns == docs.columns
    ids = sorted(str(r["doc_id"]) for r in left.collect())
    assert ids == ["1", "2", "3", "4", "6", "8", "9", "None"]
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_near_tells_texts_of_one_id_apart(spark):
    """Different texts under one doc_id are documents of their own; rows that repeat both are one."""
    a, b, c = prose(1, 80), prose(2, 80), prose(3, 80)
    rows = [(1, a), (1, b), (2, a + " end"), (3, c), (3, c), (4, c), (5, prose(4, 80)), (5, prose(5, 80))]
    docs = messy(spark, rows)
    groups = near_dedup.near_duplicates(docs)
    got = sorted((r["doc_id"], r["group_id"], r["keep"]) for r in groups.collect())
    assert got == [(1, 1, True), (2, 1, False), (3, 3, True), (4, 3, False)]
    left = sorted((r["doc_id"], r["text"]) for r in near_dedup.one_of_each(docs, groups).collect())
    assert left == sorted([(1, a), (1, b), (3, c), (5, prose(4, 80)), (5, prose(5, 80))])


def test_components_on_executors(spark):
    """Both ways give the same components."""
    r = random.Random(4)
    edges = [(r.randrange(900), r.randrange(900)) for _ in range(500)] + [(2000 + i, 2001 + i) for i in range(60)] + [(3, 3), (None, 1)]
    edges = spark.createDataFrame(edges, "a long, b long")
    get = lambda **k: {x["node"]: x["root"] for x in shared.components(edges, **k).collect()}
    assert get(in_memory=0) == get() and len(get()) > 500
    with pytest.raises(RuntimeError):
        shared.components(edges, max_rounds=1, in_memory=0)


def test_tune_bands():
    bands, rows = substring_dedup.tune_bands(0.75, 0.95, 2)
    assert 1 - (1 - 0.75**rows) ** bands >= 0.95 > 1 - (1 - 0.75**rows) ** (bands - 1)


def tokens_of(text):
    return [x.lower() for x in tk.TOKEN.findall(text or "")]


def repeated_windows(rows, n=51):
    """Windows of n tokens that stand in two texts or more, as (doc_id, first token), straight from the definition."""
    at: dict = {}
    for i, t in rows:
        if i is not None:
            w = tokens_of(t)
            for k in range(len(w) - n + 1):
                at.setdefault(tuple(w[k : k + n]), []).append((i, k))
    return [v for v in at.values() if len({i for i, _ in v}) > 1]


def covered(got, doc, begin, end):
    """Share of tokens of doc in [begin, end) in rows of the result."""
    return sum(any(r["begin"] <= k < r["end"] for r in got if r["doc_id"] == doc) for k in range(begin, end)) / (end - begin)


PASSAGE = prose(42, 80)


@pytest.mark.parametrize("how", ["inside a line", "over short lines", "at the begin", "at the end", "other case and marks"])
def test_planted_passages(spark, how):
    words = PASSAGE.split()
    form = {"over short lines": "\n".join(" ".join(words[i : i + 9]) for i in range(0, 80, 9)), "other case and marks": ", ".join(words).upper()}.get(how, PASSAGE)
    rows = []
    for i in range(10):
        head, tail = prose(100 + i, 60), prose(200 + i, 60)
        rows.append((i, " ".join(x for x in (head if how != "at the begin" or not i else "", form if i else PASSAGE, tail if how != "at the end" or not i else "") if x)))
    rows += [(50 + i, prose(300 + i, 200)) for i in range(10)]
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == set(range(10)) and [r["doc_id"] for r in got if not r["removed"]] == [0]
    for i in range(1, 10):
        begin = 0 if how == "at the begin" else 60
        r = next(r for r in got if r["doc_id"] == i)
        assert abs(r["begin"] - begin) <= 2 and abs(r["end"] - begin - 80) <= 2 and r["first_doc_id"] == 0


def test_lengths_of_passages(spark):
    """Of exact passages of 51 tokens nearly all are found, of longer ones all, of short ones none."""
    rows, long, short = [], [], []
    for g in range(150):
        n = (51, 60, 90, 30, 20)[g % 5]
        p = prose(7000 + g, n)
        (long if n > 50 else short).append(g)
        rows += [(10 * g + k, f"{prose(20 * g + k, 50 + g)} {p} {prose(9000 + 20 * g + k, 40)}") for k in range(3)]
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    ids = {r["doc_id"] for r in got}
    assert not any(10 * g + k in ids for g in short for k in range(3))
    assert sum({10 * g, 10 * g + 1, 10 * g + 2} <= ids for g in long) >= 0.97 * len(long)
    windows = [w for v in repeated_windows(rows) for w in v]
    by_doc: dict = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert sum(covered(by_doc.get(i, ()), i, k, k + 51) > 0.9 for i, k in windows) >= 0.95 * len(windows)


def test_edited_passages(spark):
    """Copies of a passage with every 20th word or so changed."""
    rows = []
    for g in range(40):
        base = prose(400 + g, 100)
        rows += [(10 * g + k, f"{prose(20 * g + k, 60)} {edit(base, g * 9 + k, k * 2)} {prose(3000 + 20 * g + k, 60)}") for k in range(3)]
    ids = {r["doc_id"] for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum({10 * g, 10 * g + 1, 10 * g + 2} <= ids for g in range(40)) >= 36


def test_thousands_of_holders(spark):
    rows = [(i, f"{prose(i, 40)} {PASSAGE} {prose(9000 + i, 30)}") for i in range(1500)]
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got if r["removed"]} == set(range(1, 1500)) and all(r["first_doc_id"] == 0 for r in got)


def test_dense_bucket_of_paragraphs(spark, monkeypatch):
    """Paragraphs in one bucket that aren't like its first: all pairs of the bucket are compared."""
    from palimpsest.llm import regions

    monkeypatch.setattr(regions, "BLOCK", 16)
    words = [f"t{i}" for i in range(19)]
    rows = []
    for p in range(60):  # pairs of texts around one anchor, far from other pairs
        own = [f"p{p}x{i}" for i in range(19)]
        rows += [(2 * p + q, own[:7] + words[7:12] + own[12:18] + [f"d{p}y{q}"]) for q in (0, 1)]
    units = spark.createDataFrame([(i, 0, 0, 1000 + i, [5]) for i, _ in rows], "doc_id long, h long, pos int, node long, buckets array<long>")
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    units = units.drop("h").join(docs.selectExpr("doc_id", "xxhash64(text) h"), "doc_id").select("doc_id", "h", "pos", "node", "buckets")
    got = {r["node"]: r["root"] for r in substring_dedup.paragraph_links(docs, units, 0.75).collect()}
    assert got == {1000 + i: 1000 + i // 2 * 2 for i in range(120)}


def test_repeats_in_one_text_keep_the_first(spark):
    p = prose(31, 30)
    docs = spark.createDataFrame([(1, " ".join([p] * 10)), (2, prose(32, 60))], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in substring_dedup.without_repeats(docs, substring_dedup.repeated_passages(docs)).collect()}
    assert out[1].split() == p.split() and out[2] == prose(32, 60)


def test_without_repeats(spark):
    p, q = prose(3, 55), prose(4, 70)
    rows = [*odd_rows(), (20, p), (21, f"head\n{p}\ntail"), (22, p), (23, f"{p}\n\nx {p}."), (24, f"Before, {p.upper()}! After."), (30, q), (31, q), (31, "another text under this id " + prose(5, 40)), (31, q)]
    docs = messy(spark, rows)
    repeats = substring_dedup.repeated_passages(docs)
    out = substring_dedup.without_repeats(docs, repeats)
    assert out.columns == docs.columns
    got: dict = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert got[20][0]["text"] == p and got[21][0]["text"] == "head\ntail" and got[21][0]["n_chars"] == len("head\ntail")
    assert 22 not in got and got[1][0]["text"] is None and got[2][0]["text"] == "" and got[23][0]["text"].strip() == "x"
    assert got[24][0]["text"] == "Before, After." and got[30][0]["text"] == q
    assert [r["text"] for r in got[31]] == ["another text under this id " + prose(5, 40)]
    assert len(got[4]) == 2 and got[6][0]["text"] == rows[7][1]
    empty = docs.limit(0)
    assert substring_dedup.without_repeats(empty, substring_dedup.repeated_passages(empty)).count() == 0


@pytest.mark.parametrize("text", ["", "A b-c_d", "É é À la «mode» — 1,5 €", "x" * 70_000 + " y", "\n\n a\n", "don't stop 日本 語、です"])
def test_tokens_agree(text):
    import pyarrow as pa

    t = tk.tokenise(tk.plain(pa.array([text, None, text])))
    want = [x.lower().encode() for x in tk.TOKEN.findall(text)]
    got = [bytes(t.bytes[a:b]) for a, b in zip(t.start, t.end, strict=True)]
    assert got == want * 2
    assert len(set(t.texts()[[0, 2]])) == 1


def test_near_on_table(spark, data):
    """The query against brute force on the whole small table."""
    rows = duckdb.sql(f"select doc_id, text from '{data}/documents.parquet'").fetchall()
    got = {r["doc_id"]: r["group_id"] for r in near_dedup.op4_minhash_near_dedup(spark, data).collect()}
    pairs, root = brute_groups(rows, near_dedup.THRESHOLD)
    assert sum(got.get(a) is not None and got.get(a) == got.get(b) for a, b in pairs) >= 0.9 * len(pairs)
    assert all(root[i] == root[g] for i, g in got.items())


def test_passages_on_table(spark, data):
    """The query against all windows of 51 tokens that repeat in the whole small table."""
    rows = duckdb.sql(f"select doc_id, text from '{data}/documents.parquet'").fetchall()
    got = substring_dedup.op7_substring_dedup(spark, data).collect()
    by_doc: dict = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
    windows = [w for v in repeated_windows(rows) for w in v]
    assert len(windows) > 500
    assert sum(covered(by_doc.get(i, ()), i, k, k + 51) > 0.9 for i, k in windows) >= 0.95 * len(windows)
    # whatever is reported shares a run of tokens with another text or place
    words = {i: tokens_of(t) for i, t in rows}
    grams: dict = {}
    for i, w in words.items():
        for k in range(len(w) - 7):
            grams.setdefault(tuple(w[k : k + 8]), set()).add((i, k))
    for r in got:
        w = words[r["doc_id"]][r["begin"] : r["end"]]
        assert r["tokens"] == len(w) >= substring_dedup.LEAST_TOKENS
        assert sum(len(grams[tuple(w[k : k + 8])]) > 1 for k in range(len(w) - 7)) >= 0.5 * (len(w) - 7)

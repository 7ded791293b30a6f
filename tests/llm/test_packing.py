from __future__ import annotations

import bisect
import random

import duckdb

from palimpsest.llm import packing

from .helpers import messy, odd_rows


def check(rows, packed, capacity):
    bins, seen = {}, {}
    for r in packed:
        bins[r["bin"]] = bins.get(r["bin"], 0) + r["length"]
        seen.setdefault(r["doc_id"], []).append((r["begin"], r["length"]))
    assert max(bins.values()) <= capacity
    want = {}
    for i, t in rows:
        if t and t.split():
            want.setdefault(i, []).append(len(t.split()) + 1)
    assert {i: sum(n for _, n in p) for i, p in seen.items()} == {i: sum(n) for i, n in want.items()}
    return bins


def test_configurations():
    r = random.Random(4)
    for n in (1, 3, 12):
        sizes = sorted(r.sample(range(130, 1000), n))
        demand = [r.randrange(1, 200) for _ in sizes]
        plan = packing.configurations(sizes, demand, 1000)
        assert [sum(c[i] * t for c, t in plan) for i in range(n)] == demand
        assert all(sum(a * b for a, b in zip(c, sizes)) <= 1000 for c, _ in plan)
        gaps: list[int] = []  # first fit, longest first
        for z in sorted((z for z, k in zip(sizes, demand) for _ in range(k)), reverse=True):
            i = next((i for i, g in enumerate(gaps) if g >= z), None)
            if i is None:
                gaps.append(1000 - z)
            else:
                gaps[i] -= z
        assert sum(t for _, t in plan) <= len(gaps) + 1


def test_pack_is_exact_and_tight(spark):
    r = random.Random(5)
    rows = [(i, "w " * min(9000, max(1, int(r.expovariate(1 / 400))))) for i in range(1500)]
    rows += [(2000 + i, "w " * 500) for i in range(100)]  # ties
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    packed = packing.pack(docs, per_shard=400).collect()
    bins = check(rows, packed, packing.CAPACITY)
    assert len(bins) <= 1.03 * sum(bins.values()) / packing.CAPACITY + 20
    assert sorted(map(tuple, packed)) == sorted(map(tuple, packing.pack(docs, per_shard=400).collect()))


def test_odd_rows(spark):
    docs = messy(spark, odd_rows())
    check(odd_rows(), packing.pack(docs).collect(), packing.CAPACITY)
    assert packing.pack(docs.limit(0)).count() == 0
    assert packing.pack(docs.where("doc_id = 4")).count() == 2
    big = 2**62 + 3
    assert {r["doc_id"] for r in packing.pack(messy(spark, [(big, "a b c"), (1, "x " * 600)])).collect()} == {big, 1}


def best_fit(lengths, capacity):
    """Bins that best fit, longest first, needs for the given lengths."""
    gaps: list[int] = []
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, n)
        g = gaps.pop(i) if i < len(gaps) else capacity
        bisect.insort(gaps, g - n)
    return len(gaps)


def test_query_against_best_fit(spark, data):
    """The query on the whole small table: every token is in one bin once, and bins are about as few as plain best fit needs."""
    rows = duckdb.sql(f"select doc_id, text from '{data}/documents.parquet'").fetchall()
    packed = packing.op5_best_fit_packing(spark, data).collect()
    bins = check(rows, packed, packing.CAPACITY)
    assert len(bins) <= 1.05 * best_fit([r["length"] for r in packed], packing.CAPACITY) + 2
    for i, t in rows:
        parts = sorted((r["begin"], r["length"]) for r in packed if r["doc_id"] == i)
        at = 0
        for b, n in parts:
            assert b == at
            at += n
        assert at == (len(t.split()) + 1 if t and t.split() else 0)


def test_repeated_ids_fill_bins_of_their_own(spark):
    docs = spark.createDataFrame([(1, "w " * 5000), (1, "w " * 5000), (None, "w " * 5000), (None, "w " * 5000)], "doc_id long, text string")
    assert len(check([(1, "w " * 5000)] * 2 + [(None, "w " * 5000)] * 2, packing.pack(docs).collect(), packing.CAPACITY)) >= 8

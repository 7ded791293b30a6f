"""Links of dense buckets: none is lost, and effort doesn't grow with the pairs."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from palimpsest.llm import exact_links, shared, substring_dedup

from .helpers import prose

WIDTH, THRESHOLD = 18, 0.75


def families(seed: int, count: int, most: int) -> list[set[int]]:
    """Sets of up to WIDTH elements, `most` around one base, some of them a few elements away, with sizes that differ."""
    r, out = random.Random(seed), []
    for _ in range(count):
        base = [r.getrandbits(64) for _ in range(r.choice((18, 18, 18, 16, 5)))]
        for _ in range(most):
            s = set(base)
            for x in r.sample(base, min(len(base) - 1, r.randrange(5))):
                s.discard(x)
                if r.random() < 0.8:
                    s.add(r.getrandbits(64))
            out.append(s)
    r.shuffle(out)
    return out


def roots(pairs, nodes):
    parent = {i: i for i in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {i: find(i) for i in nodes}


@pytest.mark.parametrize("few", [3, 40, 8192])
def test_links_against_all_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(exact_links, "FEW", few)
    rows, sets, want, node = [], {}, [], 0
    for bucket, (count, most) in enumerate([(1, 60), (6, 25), (30, 3), (1, 2)]):
        mine = {}
        for s in families(bucket, count, most):
            node += 1
            mine[node] = s
            rows.append((bucket, node))
        sets |= mine
        want += [(a, b) for a, b in itertools.combinations(mine, 2) if len(mine[a] & mine[b]) / len(mine[a] | mine[b]) >= THRESHOLD]
    known = want[::7]  # joined already
    found = shared.components(spark.createDataFrame(known, "a long, b long"))
    table = spark.createDataFrame([(n, bytearray(np.array(sorted(s), np.uint64).tobytes())) for n, s in sets.items()], "node long, `set` binary")
    got = [(r["a"], r["b"]) for r in exact_links.links(spark.createDataFrame(rows, "bucket long, node long"), table, found, WIDTH, THRESHOLD).collect()]
    assert roots(known + got, sets) == roots(want, sets) and len(set(roots(want, sets).values())) > 20
    if few == 8192:
        assert {tuple(sorted(x)) for x in got} <= set(want)


def test_dense_buckets_write_no_pairs(spark, monkeypatch):
    """A passage in many documents: paragraphs over its ends share buckets and aren't alike; what is written must follow the documents, not their pairs."""
    most = []
    was = shared.written

    def counted(df, name):
        out = was(df, name)
        most.append((out.count(), name))
        return out

    monkeypatch.setattr(shared, "written", counted)
    n, passage = 700, prose(41, 80)  # of which four or five tokens are missing in paragraphs over its ends
    docs = spark.createDataFrame([(i, f"{prose(i, 40, 10**6)} {passage} {prose(9000 + i, 40, 10**6)}") for i in range(n)], "doc_id long, text string")
    got = substring_dedup.repeated_passages(docs).collect()
    assert {r["doc_id"] for r in got if r["removed"]} == set(range(1, n)) and all(r["first_doc_id"] == 0 for r in got)
    assert max(most)[0] <= 30 * n, max(most)


def test_small_sets_meet_whole(spark):
    """Sets so small that alike ones have all elements in common have one key each."""
    one, two, three = (bytearray(np.arange(100, 100 + n, dtype=np.uint64).tobytes()) for n in (1, 2, 3))
    rows = [(1, one), (2, one), (3, two), (4, two), (5, three), (6, three)]
    crowd = spark.createDataFrame([(i, len(s) // 8, len(s) // 8, s) for i, s in rows], "node long, size int, other int, `set` binary")
    assert sorted(tuple(x) for x in exact_links._met(crowd, WIDTH, THRESHOLD).collect()) == [(1, 2), (3, 4), (5, 6)]

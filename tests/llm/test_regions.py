"""Dense buckets: many texts of one template, among them pairs that are alike."""

from __future__ import annotations

from palimpsest.llm import near_dedup, regions

from .helpers import variants


def joined(got, pairs):
    return sum(got.get(2 * p) is not None and got.get(2 * p) == got.get(2 * p + 1) for p in range(pairs)) / pairs


def test_near_in_a_dense_template_region(spark):
    rows = variants(400, 190, 25, 85)  # Jaccard 0.46 by the template alone, 0.56 in a pair
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["group_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert joined(got, 400) >= 0.97
    assert all(i // 2 == g // 2 for i, g in got.items())


def test_bucket_beyond_what_is_held(spark, monkeypatch):
    """Parts of 40 rows, blocks of 64: pairs whose rows lie in different parts are found, whatever the batches."""
    monkeypatch.setattr(regions, "HELD", 40)
    monkeypatch.setattr(regions, "BLOCK", 64)
    docs = spark.createDataFrame(variants(150, 190, 25, 85), "doc_id long, text string")
    results = []
    for size in ("30", "77"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = {r["doc_id"]: r["group_id"] for r in near_dedup.near_duplicates(docs).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert joined(got, 150) >= 0.97
        results.append(got)
    assert results[0] == results[1]


def test_stars(spark):
    """Every node but a bucket's least is linked to it once, however rows fall into batches."""
    rows = [(b, n) for b in range(30) for n in range(b % 7) for _ in range(1 + (b + n) % 3)] + [(99, n % 50) for n in range(400)]
    want = sorted({(b, 0, n) for b, n in rows if n})
    for size in ("3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = regions.stars(spark.createDataFrame(rows, "bucket long, node long")).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert sorted(tuple(r) for r in got) == want

from __future__ import annotations

from palimpsest.llm import decontaminate as D
from palimpsest.llm import textkernels as tk

from .helpers import messy, odd_rows, prose


def brute(doc, item):
    """Longest common run and covered item tokens by n-grams, straight from the definition."""
    d, b = ([w.lower() for w in tk.TOKEN.findall(x or "")] for x in (doc, item))
    if len(b) < D.LEAST_ITEM:
        return None
    n = min(D.N, len(b))
    grams = {}
    for i in range(len(d) - n + 1):
        grams.setdefault(tuple(d[i : i + n]), []).append(i)
    hits = [(i, j) for j in range(len(b) - n + 1) for i in grams.get(tuple(b[j : j + n]), ())]
    cover = {p for _, j in hits for p in range(j, j + n)}
    longest = 0
    for diagonal in {i - j for i, j in hits}:
        starts = sorted(i for i, j in hits if i - j == diagonal)
        begin = end = None
        for i in starts:
            if begin is not None and i <= end:
                end = i + n
            else:
                begin, end = i, i + n
            longest = max(longest, end - begin)
    leak = hits and (longest >= min(D.LEAST_RUN, len(b)) or len(cover) >= D.LEAST_COVER * len(b))
    return (len({j for _, j in hits}), len(cover), longest) if leak else None


def test_against_brute_force(spark):
    items = [(k, prose(900 + k, 6 + 5 * k)) for k in range(8)] + [(50, "too short"), (51, None), (None, prose(1, 30)), (52, "")]
    docs = [(i, prose(i, 150)) for i in range(40)]
    for i in range(0, 40, 2):
        words, leak = docs[i][1].split(), items[i % 8][1].split()
        docs[i] = (i, " ".join(words[:60] + leak[i % 3 : len(leak) - i % 5] + words[60:]).upper().replace(" W1", ", W1"))
    docs += odd_rows()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["grams"], r["covered"], r["longest_run"]) for r in D.find_leaks(messy(spark, docs), bench).collect()}
    want = {(i, k): b for i, t in docs for k, x in items if i is not None and k is not None and (b := brute(t, x))}
    assert got == want and len(want) >= 15


def test_parts_give_the_same(spark, monkeypatch):
    items = [(k, prose(900 + k, 30)) for k in range(40)]
    docs = spark.createDataFrame([(i, prose(i, 30) + " " + items[i][1]) for i in range(40)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = lambda: sorted(tuple(r)[:-1] for r in D.find_leaks(docs, bench).collect())
    whole = rows()
    monkeypatch.setattr(D, "PART_BYTES", 20_000)
    assert rows() == whole and len(whole) == 40


def test_cut(spark):
    item = prose(5, 40)
    other = prose(6, 20)
    rows = [(1, f"Before it. {item}, after {other} end of a text {prose(3, 90)}"), (2, item), (3, prose(4, 50)), (4, None), (None, item), (5, "")]
    docs = messy(spark, rows)
    bench = spark.createDataFrame([(1, item), (2, other), (3, " ".join(item.split()[10:30]))], "item_id long, text string")
    out = D.decontaminate(docs, bench)
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == docs.columns and set(got) == {1, 3, 4, None, 5}
    assert got[1]["text"] == f"Before it.  , after   end of a text {prose(3, 90)}" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[3]["text"] == rows[2][1] and got[None]["text"] == item
    assert D.decontaminate(docs.limit(0), bench).count() == 0 and D.decontaminate(docs, bench.limit(0)).count() == len(rows)


def test_texts_of_one_id_are_apart(spark):
    """A text without a leak isn't touched by that of another row of its id; repeated rows are cut alike."""
    item = prose(5, 40)
    leaks, clean = f"{prose(8, 60)} {item} {prose(9, 60)}", prose(10, 60)
    docs = messy(spark, [(1, leaks), (1, clean), (1, leaks), (2, clean)])
    out = sorted(r["text"] for r in D.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect())
    assert out == sorted([clean, clean] + [f"{prose(8, 60)}   {prose(9, 60)}"] * 2)

"""Small inputs that the operators' tests share."""

from __future__ import annotations

import random

CLASH = "doc_id long, text string, lang string, source string, n_chars long, node long, bucket string, keep string, sig string, `set` string, good int, __x string, first string, bin string, words string"


def prose(seed: int, n: int, vocabulary: int = 4000) -> str:
    r = random.Random(seed)
    return " ".join(f"w{int(r.random() ** 2 * vocabulary)}" for _ in range(n))


def edit(text: str, seed: int, n: int) -> str:
    r, w = random.Random(seed), text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
    return " ".join(w)


def messy(spark, rows):
    """Documents with extra columns whose names clash with the operators' own, and with nulls."""
    return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), i, "b", "k", "s", "z", 1, "x", "f", "b", "w") for i, t in rows], CLASH)


def odd_rows():
    long = prose(77, 30_000)
    return [(1, None), (None, "a text without an id"), (2, ""), (3, "   \n\t "), (4, "same words here for all of us"), (4, "same words here for all of us"), (5, "same words here for all of us"), (6, long), (7, long + " end"), (8, "…!?»"), (9, "ß İ É")]


def variants(pairs: int, template: int, own: int, differ: int) -> list[tuple[int, str]]:
    """Pairs of texts (2p, 2p + 1): words of one template, words of the pair, and `differ` words of each text."""
    base = [f"t{i}" for i in range(template)]
    return [(2 * p + q, " ".join(base + [f"p{p}x{i}" for i in range(own)] + [f"d{p}y{q}z{i}" for i in range(differ)])) for p in range(pairs) for q in (0, 1)]

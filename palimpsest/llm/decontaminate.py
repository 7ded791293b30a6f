"""Benchmark decontamination: a broadcast set of n-gram hashes, a scan of all token windows, exact verification."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from . import textkernels as tk

N, LEAST_RUN, LEAST_COVER, LEAST_ITEM, DROP_SHARE = 8, 13, 0.5, 5, 0.5
#: Benchmark bytes sent to each executor at once; a larger benchmark is scanned for in several parts.
PART_BYTES = 32 << 20


class Grams:
    """The n-grams of some benchmark items: a bitmap and sorted hashes to scan with, and the tokens to verify with."""

    def __init__(self, items: list[tuple[int, str]], n: int, least_item: int):
        self.n, self.items = n, {}
        for item, text in items:
            for words in [tuple(w.lower() for w in tk.TOKEN.findall(text or ""))]:
                if len(words) >= least_item and item is not None:
                    self.items.setdefault(int(item), []).append(words)
        self.at: dict[tuple, list] = defaultdict(list)
        for item, versions in self.items.items():
            for v, words in enumerate(versions):
                size = min(n, len(words))
                for i in range(len(words) - size + 1):
                    self.at[words[i : i + size]].append((item, v, i))
        self.hashes = {}
        for size in sorted({len(g) for g in self.at}):
            t = tk.tokenise(tk.plain(pa.array([" ".join(g) for g in self.at if len(g) == size])))
            h = np.unique(t.shingles(size)[0])
            bits = np.zeros(1 << 22, bool)
            bits[h >> np.uint64(42)] = True
            self.hashes[size] = (bits, h)

    def suspects(self, t: tk.Tokens) -> np.ndarray:
        """Which texts have a window whose hash is in the set."""
        hit = np.zeros(len(t.first) - 1, bool)
        for size, (bits, known) in self.hashes.items():
            sh, first = t.shingles(size)
            maybe = np.flatnonzero(bits[sh >> np.uint64(42)])
            if len(maybe):
                i = np.minimum(np.searchsorted(known, sh[maybe]), len(known) - 1)
                maybe = maybe[known[i] == sh[maybe]]
                hit[np.searchsorted(first, maybe, "right") - 1] = True
        return hit

    def leaks(self, text: str, least_run: int, least_cover: float) -> tuple[list[tuple], list[tuple[int, int]], int]:
        """((item, grams, covered tokens, longest run, item tokens), ...), the tokens' spans as characters, and the number of tokens."""
        found = list(tk.TOKEN.finditer(text))
        words = [m[0].lower() for m in found]
        seen: dict[tuple, dict[int, set]] = defaultdict(lambda: defaultdict(set))
        for size in self.hashes:
            for i in range(len(words) - size + 1):
                for item, v, j in self.at.get(tuple(words[i : i + size]), ()):
                    seen[item, v][i - j].add((i, j, size))
        best: dict[int, tuple] = {}
        spans: list[tuple[int, int]] = []
        for (item, v), diagonals in seen.items():
            total = len(self.items[item][v])
            grams = {j for d in diagonals.values() for _, j, _ in d}
            size = min(self.n, total)
            covered = set().union(*(range(j, j + size) for j in grams))
            longest, runs = 0, []
            for d in diagonals.values():
                run: list[int] = []
                for i, _, s in sorted(d):
                    if run and i <= run[1]:
                        run[1] = i + s
                    else:
                        run = [i, i + s]
                        runs.append(run)
                    longest = max(longest, run[1] - run[0])
            if longest >= min(least_run, total) or len(covered) >= least_cover * total:
                row = (item, len(grams), len(covered), longest, total)
                best[item] = max(best.get(item, row), row, key=lambda r: r[1:])
                spans += [(a, b) for a, b in runs]
        merged: list[list[int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        return sorted(best.values()), [(found[a].start(), found[b - 1].end(), b - a) for a, b in merged], len(words)


def _parts(benchmark: DataFrame, n: int, least_item: int):
    """Grams of the whole benchmark in parts of a checked size."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    size = rows.agg(F.sum(F.length("text") + 64)).first()[0] or 0
    parts = max(1, -(-int(size) * 12 // PART_BYTES))  # an n-gram index takes about 12 times the text
    for i in range(parts):
        part = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == i)
        yield Grams([tuple(r) for r in part.collect()], n, least_item)


def find_leaks(docs: DataFrame, benchmark: DataFrame, n: int = N, least_run: int = LEAST_RUN, least_cover: float = LEAST_COVER, least_item: int = LEAST_ITEM) -> DataFrame:
    """Every leak: (doc_id, text_hash, item_id, grams, covered, longest_run, item_tokens, doc_tokens, spans).

    Tokens are those of textkernels, in lower case. A window of n tokens of a document that is
    also in an item is a hit; hashes find it and the tokens themselves verify it. An item of fewer
    than n tokens counts as one window; one of fewer than least_item is not looked for. A document
    leaks an item if one unbroken run of at least min(least_run, item_tokens) tokens matches, or
    hits cover at least least_cover of the item's tokens. `spans` are (begin, end, tokens) of the
    document's matched runs, in characters, merged over all its leaks.

    The benchmark goes to the executors in parts of at most PART_BYTES, each with its own scan.
    Null doc_id, item_id or text match nothing, as do empty texts; several texts of one item_id are
    versions of it, the best match counts. text_hash is xxhash64(text), which tells apart texts under
    one doc_id; repeated document rows give repeated rows. Other columns are ignored. An empty table
    on either side gives an empty result.
    """
    ddl = "doc_id long, text_hash long, item_id long, grams long, covered long, longest_run long, item_tokens long, doc_tokens long, spans array<array<long>>"
    spark, out = docs.sparkSession, None
    src = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), "text").where("doc_id is not null and text is not null")
    for grams in _parts(benchmark, n, least_item):
        sent = spark.sparkContext.broadcast(grams)

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            g = sent.value
            for batch in batches:
                rows: list[tuple] = []
                ids, hs, texts = batch.column(0), batch.column(1), tk.plain(batch.column(2))
                for a, b in tk.slices(texts):
                    for i in np.flatnonzero(g.suspects(tk.tokenise(texts.slice(a, b - a)))):
                        leaks, spans, words = g.leaks(texts[a + i].as_py(), least_run, least_cover)
                        rows += [(ids[a + i].as_py(), hs[a + i].as_py(), *r, words, [list(s) for s in spans]) for r in leaks]
                kinds = [pa.int64()] * 8 + [pa.list_(pa.list_(pa.int64()))]
                names = ["doc_id", "text_hash", "item_id", "grams", "covered", "longest_run", "item_tokens", "doc_tokens", "spans"]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        hits = src.mapInArrow(tk.thrifty(scan), ddl)
        out = hits if out is None else out.union(hits)
    return out


def merged_spans(leaks: DataFrame) -> DataFrame:
    """One row for each leaking document: (doc_id, text_hash, items, spans merged over all leaks, leaked share of tokens).

    Documents are told apart by doc_id and text_hash; repeated rows count once. An empty table gives
    an empty result.
    """
    flat = leaks.select("doc_id", "text_hash", "item_id", "doc_tokens", "spans").distinct()
    per = flat.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max("doc_tokens").alias("doc_tokens"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("all"))
    start = F.expr("cast(array() as array<array<long>>)")
    step = lambda acc, s: F.when(
        (F.size(acc) > 0) & (s[0] <= F.element_at(acc, -1)[1]),
        F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.array(F.element_at(acc, -1)[0], F.greatest(F.element_at(acc, -1)[1], s[1]), F.greatest(F.element_at(acc, -1)[2], s[2])))),
    ).otherwise(F.concat(acc, F.array(s)))
    spans = F.aggregate("all", start, step)
    share = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s[2]) / F.greatest("doc_tokens", F.lit(1))
    return per.withColumn("spans", spans).withColumn("share", share).select("doc_id", "text_hash", "items", "spans", "share")


def decontaminate(docs: DataFrame, benchmark: DataFrame, drop_share: float = DROP_SHARE, **how) -> DataFrame:
    """docs with leaked spans cut out of text, and without documents of which they are more than drop_share of the tokens.

    A cut leaves one space. n_chars, if there, follows the text. Documents without a leak, and rows
    with a null doc_id or text, stay as they are; extra columns stay. Rows are judged by doc_id and
    text: another text under the same doc_id isn't touched, repeated rows are cut alike. Empty
    tables pass through.
    """
    leaks = shared.written(find_leaks(docs, benchmark, **how), "leaks")
    per = merged_spans(leaks).select(F.col("doc_id").alias("__leak_id"), F.col("text_hash").alias("__leak_hash"), F.col("spans").alias("__leak_spans"), F.col("share").alias("__leak_share"))
    per = shared.beside(per, "spans", F.lit(64) + 56 * F.size("__leak_spans"))
    joined = docs.join(per, (F.col("doc_id") == F.col("__leak_id")) & (F.xxhash64("text") == F.col("__leak_hash")), "left")
    cut = F.aggregate(
        F.reverse("__leak_spans"), F.col("text"), lambda acc, s: F.concat(F.substring(acc, F.lit(1), s[0].cast("int")), F.lit(" "), F.substr(acc, s[1].cast("int") + 1))
    )
    out = joined.where(f"__leak_id is null or __leak_share <= {drop_share}").withColumn("text", F.when(F.col("__leak_id").isNull(), F.col("text")).otherwise(F.trim(cut)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__leak_id").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))
    return found.drop("spans", "text_hash").distinct()


_WORDS = "list_filter(regexp_split_to_array(lower({}), '(?:[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]|" + "[" + "".join(f"\\x{{{{{a:X}}}}}-\\x{{{{{b:X}}}}}" for a, b in tk._PUNCT) + "])+'), lambda x: x <> '')"
OP1_SQL = f"""
with d as (select doc_id, {_WORDS.format('text')} w from documents where doc_id is not null and text is not null),
b as (select item_id, {_WORDS.format('text')} w from benchmark where item_id is not null and text is not null),
bg as (select item_id, len(w) item_tokens, least({N}, len(w)) n, unnest(range(1, len(w) - least({N}, len(w)) + 2)) j, w from b where len(w) >= {LEAST_ITEM}),
bgrams as (select item_id, item_tokens, n, j, array_to_string(w[j : j + n - 1], ' ') g from bg),
dw as (select doc_id, len(w) doc_tokens, n, unnest(range(1, len(w) - n + 2)) i, w from d, (select distinct n from bgrams) where len(w) >= n),
dgrams as (select doc_id, doc_tokens, n, i, array_to_string(w[i : i + n - 1], ' ') g from dw),
hits as (select distinct doc_id, doc_tokens, item_id, item_tokens, d.n, i, j from dgrams d join bgrams b on d.g = b.g and d.n = b.n),
marked as (select *, case when i <= lag(i) over (partition by doc_id, item_id, i - j order by i) + n then 0 else 1 end fresh from hits),
runs as (select *, sum(fresh) over (partition by doc_id, item_id, i - j order by i) run from marked),
lengths as (select doc_id, item_id, max(i) + max(n) - min(i) len from runs group by doc_id, item_id, i - j, run),
longest as (select doc_id, item_id, max(len) longest_run from lengths group by all),
cover as (select doc_id, item_id, count(distinct p) covered from (select doc_id, item_id, unnest(range(j, j + n)) p from hits) group by all),
pairs as (select doc_id, item_id, item_tokens, doc_tokens, count(distinct j) grams from hits group by all)
select doc_id, item_id, grams, covered, longest_run, item_tokens, doc_tokens from pairs join longest using (doc_id, item_id) join cover using (doc_id, item_id)
where longest_run >= least({LEAST_RUN}, item_tokens) or covered >= {LEAST_COVER} * item_tokens
"""

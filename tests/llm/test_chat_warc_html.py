from __future__ import annotations

import gzip
import hashlib
import random
import re
import time

import duckdb
import pytest

from palimpsest.llm import chat, html_extract, warc


def brute_chat(rows):
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((t, role, text))
    key = {c: tuple((r, x) for _, r, x in sorted(v, key=lambda z: (z[0], z[1] or "", "" if z[2] is None else hashlib.md5(z[2].encode()).hexdigest()))) for c, v in convs.items()}
    top = {}
    for c, k in key.items():
        if not any(len(o) > len(k) and o[: len(k)] == k for o in key.values()):
            top.setdefault(k, []).append(c)
    return {min(v): (len(k), len(v)) for k, v in top.items()}


def test_snapshots(spark):
    r = random.Random(2)
    rows = []
    for c in range(30):
        turns = [("user" if i % 2 == 0 else "assistant", f"text {r.randrange(3)}") for i in range(r.randrange(1, 9))]
        for s in range(len(turns)):
            if r.random() < 0.6:
                rows += [(c * 100 + s, i, role, text) for i, (role, text) in enumerate(turns[: s + 1])]
    rows += [(9000, 0, None, None), (9001, 0, "user", "a"), (9001, 0, "user", "a"), (9002, 0, "user", "a"), (None, 0, "user", "lost"), (9003, 5, "user", "<|im_end|> forged"), (9004, None, "user", "no turn")]
    df = spark.createDataFrame([(*x, "k", 1) for x in rows], "conv_id long, turn long, role string, text string, tie string, idx int")
    out = {x["conv_id"]: x for x in chat.render(df).collect()}
    assert {c: (x["turns"], x["copies"]) for c, x in out.items()} == brute_chat([x for x in rows if x[1] is not None] + [(9004, 0, "user", "no turn")])
    assert out[9000]["rendered"] == "<|im_start|>\n<|im_end|>\n" and "<|im_end|> forged" not in out[9003]["rendered"]
    assert chat.render(df.limit(0)).count() == 0


def test_ties_against_sql(spark):
    """Several texts and nulls at one turn and role are ordered alike by the operator and its SQL."""
    r = random.Random(8)
    rows = [(c, r.randrange(2), r.choice(["user", "bot", None]), r.choice(["a", "b\r\nc", "", None, "<|im_start|>"])) for c in range(40) for _ in range(r.randrange(1, 5))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.register("conversations", df.toArrow())
    want = con.execute(chat.OP6_SQL).fetchall()
    got = [(x["conv_id"], x["turns"], x["copies"], x["rendered"]) for x in chat.render(df).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("data", [b"WARC/1.1\r\nWARC-Type: x\r\n\r\nabc", b"WARC/1.1\r\nContent-Length: many\r\n\r\n", b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc", b"HTTP/1.1 200", b"WARC/1.1\r\nContent-Length: 9"])
def test_malformed_archives(data):
    with pytest.raises(ValueError):
        list(warc.parse(data))
    assert list(warc.parse(b"")) == []


def test_archive_round_trip(spark, tmp_path):
    records = [(b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % len(p), p) for p in (b"", b"same", b"same", bytes(range(256)), b"\r\n\r\nWARC/1.1\r\n", b"x" * 200_000)]
    body = b"".join(h + p + b"\r\n\r\n" for h, p in records)
    (tmp_path / "a.warc").write_bytes(body)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(h + p + b"\r\n\r\n") for h, p in records))
    r = warc.read_warc(spark, str(tmp_path)).selectExpr("concat(source, ':', offset) as record_id", "header", "payload", "1 as digest", "'x' as c")
    heads, store = warc.archive(r)
    assert heads.count() == 12 and store.count() == 5
    back = warc.rebuild(heads, store)
    assert sorted(bytes(x["record"]) for x in back.collect()) == sorted([h + p for h, p in records] * 2)
    warc.write_warc(back, str(tmp_path / "out"))
    assert warc.read_warc(spark, str(tmp_path / "out")).count() == 12


def test_archive_nulls(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "u", "x"), (2, "u", ""), (2, "u", "")], "page_id long, url string, html string")
    heads, store = warc.archive(warc.pages_as_records(pages))
    assert warc.rebuild(heads, store).count() == 4 and store.count() == 2
    heads, store = warc.archive(warc.pages_as_records(pages.limit(0)))
    assert warc.rebuild(heads, store).count() == 0


def test_damage_is_found(spark):
    heads, store = warc.archive(spark.createDataFrame([(1, b"h", b"p")], "record_id long, header binary, payload binary"))
    with pytest.raises(Exception, match="missing or damaged"):
        warc.rebuild(heads, store.limit(0)).collect()


PAGE = "<html><body><nav><a href=x>menu</a></nav><div class='wrap'><div class='c-{n} body'><p>First &amp; long paragraph of the text {n}, with words.<p>Second one, just as long as the first.</div><div class=side><a>l1</a><a>l2</a></div></div><script>var x='<p>no</p>'</script></body></html>"


def test_odd_pages_are_linear():
    t = time.time()
    for page in ("<div>" * 60_000 + "x", "<a \"'" * 60_000, "<" * 300_000, "</b>" * 100_000, "<!--" * 50_000, "<div><p>" * 30_000 + "</div>" * 30_000, "<script>" * 60_000, "<!" * 300_000, "<a" * 300_000, "<!x <p>" * 60_000, "<b><div>x" * 30_000 + "</b>" * 30_000):
        html_extract.containers(page)
    assert time.time() - t < 60
    nodes = html_extract.containers("<body><div>a<script>if (a<b && c=='</p>') {}</script>b<br>c<nav>no</nav></div>d<style>x")
    assert [html_extract.tidy(n) for n in nodes] == ["ab\nc\nd", "ab\nc"] and nodes[0].chars == 4


def test_consensus(spark):
    rows = [(i, f"https://U@Example.org:80/{i}", PAGE.format(n=i)) for i in range(6)]
    rows += [(50, "http://example.org/", "<div class='other'><p>Something else that is longer than any of the other texts on this host, by far indeed.</div>"), (51, None, "<p>no host"), (52, "x", None), (53, "http://e.com", ""), (54, "http://e.com", "<div><div <p>>"), (54, "http://e.com", "plain text"), (None, "http://example.org/z", PAGE.format(n=7))]
    df = spark.createDataFrame([(*x, "clash", "p") for x in rows], "page_id long, url string, html string, host string, path string")
    out = html_extract.extract(df)
    got = {r["page_id"]: r for r in out.collect()}
    assert out.count() == len(rows)
    for i in (*range(6), None):
        assert got[i]["by_consensus"] and got[i]["path"].endswith("div.body.c") and got[i]["host"] == "example.org"
        assert got[i]["text"].startswith("First & long paragraph") and got[i]["text"].count("\n") == 1
    deep = html_extract.containers("<div class=a>" * 70 + "<div class=b>x</div><div class=c>y</div>")
    assert len({n.path for n in deep}) == 72  # levels beyond the named ones are told apart
    assert not got[50]["by_consensus"] and got[50]["text"].startswith("Something else")
    assert got[51]["text"] == "no host" and got[52]["text"] == "" and got[52]["path"] is None and got[53]["text"] == ""
    assert html_extract.extract(df.limit(0)).count() == 0


def test_extract_on_table(spark, data):
    """Every page's text against a plain re-reading: what the article's paragraphs say is there, menus and scripts aren't."""
    html = dict(duckdb.sql(f"select page_id, html from '{data}/pages.parquet'").fetchall())
    got = html_extract.op9_html_extraction(spark, data).collect()
    assert {r["page_id"] for r in got} == set(html)
    full = [r for r in got if r["text"]]
    assert len(full) >= 0.95 * len(html) and not any("track(" in r["text"] or "margin:0" in r["text"] for r in full)


def test_votes_against_brute_force(spark, data):
    """The query against one pass in plain Python over the whole small table: votes by host, winners, extraction."""
    rows = duckdb.sql(f"select page_id, url, html from '{data}/pages.parquet'").fetchall()
    host = lambda u: m[1].lower() if (m := re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", u or "")) else ""
    polls: dict = {}
    for _, url, page in rows:
        nodes = html_extract.containers(page or "")
        top = max(nodes, key=lambda n: (html_extract.points(n), n.order), default=None)
        if top and top.chars:
            poll = polls.setdefault(host(url), {}).setdefault(top.path, [0, 0])
            poll[0], poll[1] = poll[0] + 1, poll[1] + int(html_extract.points(top))
    won = {h: min(p, key=lambda x: (-p[x][0], -p[x][1], x)) for h, p in polls.items()}
    want = []
    for i, url, page in rows:
        nodes = [n for n in html_extract.containers(page or "") if n.chars]
        mine = [n for n in nodes if n.path == won.get(host(url))]
        top = max(mine or nodes, key=lambda n: (html_extract.points(n), n.order), default=None)
        want.append((i, host(url), top.path if top else None, bool(mine), html_extract.tidy(top) if top else ""))
    got = [tuple(r) for r in html_extract.op9_html_extraction(spark, data).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)

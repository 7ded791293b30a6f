"""HTML extraction: containers scored page by page, tag-class paths voted on by host, pages re-extracted by the winner."""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/<>]*+)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*'|[\"'])*+)>", re.S)
CLASS = re.compile(r"\bclass\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg textarea iframe".split())
SKIP = frozenset("nav header footer aside form button select menu".split())
BLOCK = frozenset("p div section article main h1 h2 h3 h4 h5 h6 li ul ol tr table blockquote pre figure figcaption dd dt dl br hr body td th nav header footer aside form".split())
CONTAINER = frozenset("body main article section div td blockquote".split())
AUTO_CLOSE = {"p": frozenset("p div section article ul ol table blockquote pre h1 h2 h3 h4 h5 h6 hr form main nav header footer aside".split()), "li": frozenset(["li"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "dd": frozenset(["dd", "dt"]), "dt": frozenset(["dd", "dt"]), "option": frozenset(["option"])}


DEEPEST = 64  # a path names no more levels; deeper ones are hashed into its last


class Node:
    __slots__ = ("tag", "path", "depth", "begin", "end", "chars", "link_chars", "paragraphs", "order", "skip", "parts")

    def __init__(self, tag, path, depth, order, skip):
        self.tag, self.path, self.depth, self.order, self.skip = tag, path, depth, order, skip
        self.begin = self.end = self.chars = self.link_chars = self.paragraphs = 0


def general(tag: str, attrs: str) -> str:
    """A tag with its classes in order, digits cut out, so that numbered variants of a template agree."""
    m = CLASS.search(attrs)
    if not m:
        return tag
    classes = sorted({re.sub(r"\d+", "", c).strip("-_") for c in (m[1] or m[2] or m[3] or "").lower().split()} - {""})
    return ".".join([tag, *classes])


def deeper(above: Node, step: str) -> str:
    """The path one step below; beyond DEEPEST levels a hash of all further steps stands for them."""
    if above.depth < DEEPEST:
        return f"{above.path}/{step}"
    named, _, hashed = above.path.partition("/~")
    return f"{named}/~{hashlib.blake2b(f'{hashed}/{step}'.encode(), digest_size=8).hexdigest()}"


def containers(page: str) -> list[Node]:
    """The containers of a page; malformed mark-up is read as far as it goes.

    Visible text goes into one list, of which each container is a range, so the work is linear in
    the page however deep it nests. A declaration or comment that doesn't end takes the rest.
    """
    parts: list[str] = []
    stack, found, at, links, chars, link_chars = [Node("", "", 0, 0, False)], [], 0, 0, 0, 0
    open_: dict[str, int] = {}

    def text(s: str) -> None:
        nonlocal chars, link_chars
        if s and not stack[-1].skip:
            s = entities.unescape(s)
            n = len(s.strip())
            parts.append(s)
            chars += n
            if links:
                link_chars += n

    def close(upto: int) -> None:
        nonlocal links
        while len(stack) > upto:
            node = stack.pop()
            open_[node.tag] -= 1
            if node.tag == "a":
                links -= 1
            if node.tag in BLOCK and not node.skip:
                parts.append("\n")
            node.end, node.chars, node.link_chars = len(parts), chars - node.chars, link_chars - node.link_chars
            if node.tag == "p":
                for above in reversed(stack):
                    if above.tag in CONTAINER:
                        above.paragraphs += 1
                        break

    while m := TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if open_.get(tag):
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                close(i)
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                end = re.compile(f"</{tag}[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        while len(stack) > 1 and tag in AUTO_CLOSE.get(stack[-1].tag, ()):
            close(len(stack) - 1)
        if tag in VOID:
            if tag in ("br", "hr"):
                text("\n")
            continue
        top = stack[-1]
        path = deeper(top, general(tag, m[3]))
        node = Node(tag, path, top.depth + 1, len(found), top.skip or tag in SKIP or tag in ("head", "title"))
        if tag in BLOCK and not node.skip:
            parts.append("\n")
        node.begin, node.chars, node.link_chars, node.parts = len(parts), chars, link_chars, parts
        stack.append(node)
        open_[tag] = open_.get(tag, 0) + 1
        if tag == "a":
            links += 1
        if tag in CONTAINER and not node.skip:
            found.append(node)
    text(page[at:])
    close(1)
    if not found and page:
        whole = Node("body", "/", 0, 0, False)
        whole.end, whole.chars, whole.link_chars, whole.parts = len(parts), chars, link_chars, parts
        found = [whole]
    return found


def points(node: Node) -> float:
    """Text that isn't links, and paragraphs directly inside; deeper containers win ties through less surrounding noise."""
    return (node.chars - 2 * node.link_chars) * (1.0 + min(node.paragraphs, 5) * 0.4)


def tidy(node: Node) -> str:
    lines = (" ".join(x.split()) for x in "".join(node.parts[node.begin : node.end]).split("\n"))
    return "\n".join(x for x in lines if x)


def best(nodes: list[Node]) -> Node | None:
    return max(nodes, key=lambda n: (points(n), n.order), default=None)


HOST = "lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, votes, points): each page votes once, for the path of its best container."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                node = best(containers(page or ""))
                if node and node.chars:
                    rows.append((host, node.path, int(points(node))))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["host", "path", "points"])

    v = pages.where("html is not null").select(F.expr(HOST).alias("host"), "html").mapInArrow(scan, "host string, path string, points long")
    return v.groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("points").alias("points"))


def winners(counted: DataFrame) -> DataFrame:
    """(host, path): most votes, then most points, then the path first in order."""
    order = Window.partitionBy("host").orderBy(F.desc("votes"), F.desc("points"), "path")
    return counted.withColumn("place", F.row_number().over(order)).where("place = 1").select(F.col("host").alias("win_host"), F.col("path").alias("win_path"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, host, path, by_consensus, text) of every row.

    A page gives the text of its best container on the path that its host's pages voted for; one
    that lacks the path, or has no text there, gives that of its own best container, with
    by_consensus false. Text keeps block breaks as line feeds, entities are resolved, other white
    space is folded; scripts, styles, navigation and the like are left out. A null or empty html has
    a null path and an empty text; a URL without a host, or null, has the host ''. Repeated rows are
    extracted each (and vote each). Other columns are ignored. An empty table gives an empty result.
    """
    win = winners(votes(pages))
    p = pages.select("page_id", F.expr(HOST).alias("host"), "html")
    p = p.join(shared.small(shared.written(win, "winners"), 300), F.col("host") == F.col("win_host"), "left")

    def pull(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, agreed, texts = [], [], []
            for page, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                nodes = containers(page or "")
                node = best([n for n in nodes if n.path == path and n.chars])
                agreed.append(node is not None)
                node = node or best([n for n in nodes if n.chars])
                paths.append(node.path if node else None)
                texts.append(tidy(node) if node else "")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(paths, pa.string()), pa.array(agreed, pa.bool_()), pa.array(texts, pa.string())], names=["page_id", "host", "path", "by_consensus", "text"])

    return p.select(F.col("page_id").cast("long"), "host", "html", "win_path").mapInArrow(pull, "page_id long, host string, path string, by_consensus boolean, text string")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(shared.table(spark, sf_dir, "pages"))

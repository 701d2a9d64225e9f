"""HTML extraction by consensus host paths.

Every page is parsed into text blocks with their chain of containers; a container is named by its generalised
tag-class path (digits in classes and ids become N). A page scores its containers from the paragraphs in them (length,
commas, few links) and gives each path its share of the page's score. The shares are summed per host in Spark; the
path with most votes wins, and every page of the host is extracted again from the containers at that path. A page that
lacks the path falls back to its own best container. A container votes for all containers around it, a little less each,
so that an article in several parts is found at what holds them all.

Furniture is known by its element, or by a class, id or role that stands for furniture as a whole ("ad", "share-buttons",
"post-comments"). A container of the second kind stays if it holds the page's article, main or h1 element or most of its
running text; so does a form around the page. One for reader comments stays only around the page's main or h1 element.
Where a word of furniture stands among other words ("share-price", "no-comments", "with-sidebar") it decides nothing by
itself: the container goes if what it holds doesn't read like text (no sentence, or mostly links). What stands in a
header of the article stays if it is a heading or a sentence; a header that holds the article or most of the text is
none.

Defined results: null, empty or tag-free html gives the plain text there is; a null url belongs to the host "";
equal votes go to the path that sorts first; repeated rows get the same text; an empty table gives an empty result.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SMALL_ROWS, map_arrow, read_table, stage, strings

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*(?:"[^"]*"|'[^']*')|[^>])*+)>|<[!?][^>]*>""", re.S)
ATTR = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements whose content is never text of the page. Fixed values.
RAW = frozenset("script style textarea title noscript template iframe svg select option button object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
#: A start tag of the left closes these open elements on top of the stack.
IMPLIED = {"li": {"p", "li"}, "dt": {"p", "dt", "dd"}, "dd": {"p", "dt", "dd"}, "tr": {"p", "tr"}, "p": {"p"}}
CLOSES_P = BLOCKS - {"html", "body", "head"}
FURNITURE = frozenset("nav footer aside form head menu dialog".split())
#: Words in class, id or role of menus, notices, adverts, comments and the like. Fixed values.
FURNITURE_WORDS = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies footer gdpr login menu "
    "modal nav navbar navigation newsletter notice overlay pager pagination popup promo promoted promotion recommended "
    "related search share sharing sidebar signup skyscraper social sponsor sponsored subscribe subscription toolbar "
    "widget complementary contentinfo".split()
)
#: Words of reader comments. Fixed values.
COMMENT_WORDS = frozenset("comment comments disqus replies reply respond".split())
#: Words that say where in the page or of which make, not what. Fixed values.
PLACE_WORDS = frozenset(
    "area author bar block body bottom box button buttons center children column container count depth even fixed form global "
    "holder icon icons inner item items left link links list meta mobile odd outer page panel placeholder primary right row "
    "secondary section site slot sticky strip text thread top unit wrap wrapper".split()
)
#: Elements of other vocabularies, where "/>" ends an element.
FOREIGN = frozenset(("svg", "math"))
#: A container's vote for those around it, less LEVEL a level; the share of a page's text that keeps a container despite its words.
STEP, LEVEL, MOST = 0.85, 0.98, 0.6
TEXT_WORDS = frozenset("article articlebody body content entry main post story text".split())
HEADER = frozenset(("header",))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


SENTENCE = re.compile(r"[.!?\u2026\u3002]\W*\Z")


def stands_for(token: str, words: frozenset[str]) -> bool:
    """The token is one of ``words``, with words of place or furniture about it; words of text only before it."""
    parts = [w.lower() for w in _WORDS.findall(token)]
    own = [w for w in parts if w not in PLACE_WORDS] or parts
    return bool(own) and own[-1] in words and all(w in FURNITURE_WORDS or w in COMMENT_WORDS or w in TEXT_WORDS or w in words for w in own)


def sentence(text: str, links: int) -> bool:
    """Reads like running text: some words and a stop, and not mostly links."""
    return len(text) >= 20 and text.count(" ") >= 3 and links < 0.4 * len(text) and SENTENCE.search(text) is not None


#: What a container's marks make of it: surely furniture; furniture unless it holds the article; that, but for reader comments; to be judged by what it holds.
SURE, WORDED, COMMENTS, MAYBE = 2, 1, 4, 3


class Node:
    __slots__ = ("label", "tag", "words", "mark", "skip", "holds", "reads", "heads", "header", "up", "path")

    def __init__(self, tag: str, marks: list[str], up: Node | None):
        self.tag, self.up = tag, up
        self.words = {w.lower() for m in marks for w in _WORDS.findall(m)}
        self.label = ".".join([tag, *sorted(re.sub(r"\d+", "N", m) for m in marks)])
        self.path = (up.path + "/" if up and up.path else "") + self.label if tag not in ("html", "body") else (up.path if up else "")
        self.mark, self.skip, self.holds, self.reads = 0, False, 0.0, [0, 0, False]
        if tag in FURNITURE:
            self.mark = WORDED if tag == "form" else SURE
        elif self.words & COMMENT_WORDS and any(stands_for(m, COMMENT_WORDS) for m in marks):
            self.mark = COMMENTS
        elif tag not in ("html", "body", "article", "main"):
            if self.words & FURNITURE_WORDS and any(stands_for(m, FURNITURE_WORDS) for m in marks):
                self.mark = WORDED
            elif self.words & (FURNITURE_WORDS | COMMENT_WORDS):
                self.mark = MAYBE
        self.heads = tag == "header" or (tag in ("div", "section") and "header" in self.words and any(stands_for(m, HEADER) for m in marks))
        #: the outermost header around it or itself, once the page is known
        self.header = None


def parse(page: str) -> list[tuple[Node, str, int]]:
    """(innermost container, text, characters inside links) of each block, in page order."""
    root = Node("body", [], None)
    nodes = [root]
    node, out, text, links, in_link, raw = root, [], [], 0, False, None
    at = 0

    def flush():
        nonlocal links
        if text:
            joined = " ".join(_html.unescape("".join(text)).split())
            if joined:
                out.append((node, joined, links))
            text.clear()
        links = 0

    for m in TAG.finditer(page):
        if raw:
            if m[1] == "/" and (m[2] or "").lower() == raw:
                raw, at = None, m.end()
            continue
        if m.start() < at:
            continue
        if m.start() > at:
            piece = page[at : m.start()]
            text.append(piece)
            links += len(piece) if in_link else 0
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if not m[1]:
            if tag in FOREIGN and m[3].rstrip().endswith("/"):
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
                text.append(" ")
                continue
            if tag == "a":
                in_link = True
            elif tag in ("br", "td", "th", "hr", "img", "input"):
                text.append(" ")
            if tag in BLOCKS:
                flush()
                in_link = False
                if tag in ("html", "body"):
                    while node.up and node.tag == "head":
                        node = node.up
                    continue
                close = IMPLIED.get(tag, {"p"} if tag in CLOSES_P else set())
                while node.up and node.tag in close:
                    node = node.up
                node = Node(tag, [x for k in ATTR.finditer(m[3]) for x in (k[2] or k[3] or k[4] or "").split()] if m[3] else [], node)
                nodes.append(node)
        elif tag == "a":
            in_link = False
        elif tag in BLOCKS:
            flush()
            in_link = False
            up = node
            while up and up.tag != tag:
                up = up.up
            if up and up.up:
                node = up.up
    if raw is None and at < len(page):
        text.append(page[at:])
    flush()
    decide(nodes, out)
    return out


def worth(text: str, links: int) -> float:
    return (min(len(text) / 100, 8) + min(text.count(","), 8) / 2) * max(0.0, 1 - 2 * links / len(text))


def decide(nodes: list[Node], blocks: list[tuple[Node, str, int]]) -> None:
    """Set each node's skip and header. nodes: parents before children."""
    if any(n.mark == MAYBE for n in nodes):
        for node, text, links in blocks:
            up, reads = node, sentence(text, links)
            while up and up.mark in (0, MAYBE):
                up.reads[0] += len(text)
                up.reads[1] += links
                up.reads[2] |= reads
                up = up.up
        for n in nodes:
            if n.mark == MAYBE:
                chars, links, reads = n.reads
                n.mark = 0 if reads and links < 0.4 * chars else WORDED
    if any(n.mark or n.heads for n in nodes):
        total, core, heads = 0.0, set(), set()
        for node, text, links in blocks:
            points, up, clear = worth(text, links), node, True
            while up:  # counts up to the first mark around it, and for that node
                if clear:
                    up.holds += points
                clear = clear and not up.mark
                if up.mark in (SURE, COMMENTS):
                    points = 0.0
                up = up.up
            total += points
        for n in nodes:
            if n.tag in ("article", "main", "h1") and not n.mark:
                up, comments = n.up, n.tag == "article"
                while up and up.mark != SURE and not (comments and up.mark == COMMENTS):
                    core.add(id(up))
                    if n.tag != "h1":
                        heads.add(id(up))
                    up = up.up
        for n in nodes:
            if n.mark == COMMENTS and id(n) in core or n.mark == WORDED and (id(n) in core or n.holds > MOST * total > 0):
                n.mark = 0
            n.heads = n.heads and not (id(n) in heads or n.holds > MOST * total > 0)
    for n in nodes:
        n.header = (n.up.header if n.up else None) or (n if n.heads else None)
        n.skip = bool(n.mark) or bool(n.up and n.up.skip)


def kept(node: Node, text: str, links: int, path: str = "") -> bool:
    """Not furniture. What stands in a header stays only if it is a heading or a sentence inside the article."""
    if node.skip:
        return False
    if node.header is None:
        return True
    inside = node.header.up
    while inside and inside.tag not in ("article", "main") and not (path and inside.path == path):
        inside = inside.up
    return inside is not None and (node.tag in HEADINGS or sentence(text, links))


def votes(blocks: list[tuple[Node, str, int]]) -> dict[str, float]:
    """Each path's share of the page's score."""
    score: dict[str, float] = {}
    for node, text, links in blocks:
        if not kept(node, text, links) or node.tag in HEADINGS:
            continue
        points = worth(text, links)
        up, part = (node.up if node.tag in ("p", "pre", "li", "blockquote", "dd", "dt", "tr") and node.up else node), 1.0
        while up:
            bonus = 2.0 if up.tag == "article" else 1.6 if up.tag == "main" or "main" in up.words else 1.3 if up.words & TEXT_WORDS else 1.0
            score[up.path] = score.get(up.path, 0.0) + points * part * bonus
            up, part = up.up, part * (STEP if part == 1.0 else LEVEL)
    total = sum(score.values())
    return {k: v / total for k, v in score.items()} if total > 0 else {}


def extract(blocks: list[tuple[Node, str, int]], path: str | None) -> str:
    """Text of the blocks in containers at ``path``; from the page's own best where the page has none."""
    inside = lambda p: [t for n, t, k in blocks if kept(n, t, k, p) and (not p or n.path == p or n.path.startswith(p + "/"))]
    found = inside(path) if path is not None else []
    if not found:
        own = votes(blocks)
        found = inside(max(sorted(own), key=own.get)) if own else [t for n, t, k in blocks if kept(n, t, k)]
    return "\n\n".join(found)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the winning path of each host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[tuple[str, str], float] = {}
            for url, page in zip(b.column(0).to_pylist(), strings(b.column(1)), strict=True):
                host = host_of(url)
                for path, share in votes(parse(page)).items():
                    # whole millionths: sums don't depend on their order
                    sums[host, path] = sums.get((host, path), 0) + round(share * 1e6)
            yield pa.RecordBatch.from_pydict({"host": pa.array([k[0] for k in sums], pa.string()), "path": pa.array([k[1] for k in sums], pa.string()), "votes": pa.array(list(sums.values()), pa.int64())})

    cast = map_arrow(pages.select("url", "html"), run, "host string, path string, votes long")
    per = cast.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    return per.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("v"), "path")).alias("best")).select("host", F.col("best.path").alias("path"))


def extract_pages(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns with text and n_chars of every page."""
    winners = stage(host_paths(pages), "hosts")
    small = winners.count() <= SMALL_ROWS

    def hosts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([host_of(u) for u in b.column(0).to_pylist()], pa.string())], names=[*b.schema.names, "host"])

    columns = [F.col("url").alias("__url"), F.col("html").alias("__html"), *(F.col(c) for c in keep)]
    picked = pages.select(*columns)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields)
    joined = map_arrow(picked, hosts, f"{fields}, host string").join(F.broadcast(winners) if small else winners, "host", "left").drop("host", "__url")
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields if f.name in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            texts = [extract(parse(h), p) for h, p in zip(strings(b.column(names.index("__html"))), b.column(names.index("path")).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(names.index(k)) for k in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return map_arrow(joined.select("__html", "path", *keep), run, f"{out}, text string, n_chars long")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages"))

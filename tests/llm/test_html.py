from helpers import SF

from codeloom.llm import html_extract as hx

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body>
<div class="cookie-notice"><p>We use cookies, all of them, really, a lot.</p></div><header class="site-header"><p>Site, name, here</p></header>
<nav class="menu"><ul><li><a href="/a">A</a></li></ul></nav>
<div id="post-17" class="content main-3"><h1>Title &amp;&nbsp;more</h1><p>First   para,
with <b>bold <p>Second, para &lt;x&gt;, long enough to count, yes.<br>next</p><ul><li>item, one<li>item two</ul>
<form><p>Subscribe, now</p></form><section class="comments"><p>Nice, article, very, good, thanks, all.</p></section></div>
<aside><p>Side, bar, things, here</p></aside><footer><p>(c), all, rights</p></footer></body></html>"""
WANT = "Title & more\n\nFirst para, with bold\n\nSecond, para <x>, long enough to count, yes. next\n\nitem, one\n\nitem two"


def test_furniture_and_markup():
    assert hx.extract(hx.parse(PAGE), None) == WANT
    path = max(v := hx.votes(hx.parse(PAGE)), key=v.get)
    assert "main-N" in path and "post-N" in path
    assert hx.extract(hx.parse(PAGE), path) == WANT


def test_host_vote_beats_one_page(spark):
    page = lambda kind, k: f"<body><div class='{kind}'>" + "".join(f"<p>Word {i}, and more, text {k}.</p>" for i in range(8)) + "</div><div class='extra'><p>x</p></div></body>"
    odd = "<body><div class='text'><p>Short, one.</p></div><div class='extra'>" + "<p>Long, long, long, long extra text here, really.</p>" * 9 + "</div></body>"
    rows = [(i, "https://h.example/a", page("text", i)) for i in range(6)] + [(9, "https://H.example/b", odd), (10, None, "plain &amp; text"), (11, "http://h.example", None), (12, "http://h.example", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as host", "3 as path")
    got = {r.page_id: (r.text, r.n_chars) for r in hx.extract_pages(df).collect()}
    assert got[9] == ("Short, one.", 11) and got[10] == ("plain & text", 12) and got[11] == got[12] == ("", 0)
    assert hx.extract_pages(df.limit(0)).count() == 0


def test_query(spark):
    rows = hx.op3_html_extract(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count()
    assert all(r.n_chars == len(r.text) and r.text and "track(" not in r.text and "©" not in r.text for r in rows)


def kept(page):
    return hx.extract(hx.parse(page), None)


PART = "<p>Some running text, of a length that counts, with commas, to be found here, number {}.</p>"


def test_foreign_elements_and_stray_quotes():
    got = kept(f"<body><article><h1>Head</h1><svg class='x' />{PART.format(1)}<p>it<b'>s</b></p><a href=x'>link</a>{PART.format(2)}<svg><text>no</text></svg>{PART.format(3)}</article></body>")
    assert all(f"number {i}." in got for i in (1, 2, 3)) and "no" not in got.split("\n\n") and "link" in got
    assert len(hx.parse(("<p a" + "=" * 5000) * 20)) == 1  # a tag without an end stays text


def test_wrappers_with_furniture_words():
    for word in ("with-sidebar", "share-page", "overlay root", "banner-layout"):
        got = kept(f"<body><div class='{word}'><article>{PART.format(1)}{PART.format(2)}</article><div class='sidebar'>{PART.format(3)}</div></div></body>")
        assert "number 1." in got and "number 2." in got and "number 3." not in got, word
        got = kept(f"<body><div class='{word}'>{PART.format(1) * 3}{PART.format(2)}</div><div class='sidebar'>{PART.format(3)}</div></body>")
        assert "number 2." in got and "number 3." not in got, word
    got = kept(f"<body><div class='post'>{PART.format(1)}</div><section class='comments'><article>{PART.format(2) * 9}</article></section></body>")
    assert "number 1." in got and "number 2." not in got


def test_article_in_parts():
    page = f"<body><div class='page'><div class='lead'>{PART.format(1) * 4}</div><div class='rest'><div class='a'><div class='b'><div class='c'><div class='d'>{PART.format(2)}</div></div></div></div></div></div><div class='sidebar'>{PART.format(3)}</div></body>"
    got = kept(page)
    assert "number 1." in got and "number 2." in got and "number 3." not in got


def plain(page):
    """Text of an article page by the standard library's tokenizer, furniture left out by element and class."""
    from html.parser import HTMLParser

    out, text, stack = [], [], []
    blocks = set("article aside body div footer form h1 h2 h3 h4 h5 h6 head header html li main nav ol p section table td th tr ul".split())
    void = {"br", "hr", "img", "input", "link", "meta"}
    skip = {"nav", "footer", "aside", "form", "script", "style", "noscript", "head", "iframe", "svg", "button", "select", "textarea", "template"}

    class P(HTMLParser):
        def flush(self):
            t = " ".join("".join(text).split())
            text.clear()
            if t:
                out.append(t)

        def handle_starttag(self, tag, attrs):
            if tag in void:
                text.append(" ")
                return
            if tag in blocks:
                self.flush()
            stack.append((tag, tag in skip or ("class", "ad") in attrs))

        def handle_endtag(self, tag):
            if tag in blocks:
                self.flush()
            while stack and any(t == tag for t, _ in stack) and stack.pop()[0] != tag:
                pass

        def handle_data(self, data):
            if any(t == "article" for t, _ in stack) and not any(s for _, s in stack):
                text.append(data)

    p = P(convert_charrefs=True)
    p.feed(page)
    p.flush()
    return "\n\n".join(out)


def test_query_against_plain_reader(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in hx.op3_html_extract(spark, SF).collect()}
    same = sum(got[i] == plain(h) for i, h in pages.items())
    assert same == len(pages), (same, len(pages), next((got[i], plain(h)) for i, h in pages.items() if got[i] != plain(h)))


def test_awkward_pages(spark):
    long = "<article>" + PART.format(1) * 20_000 + "</article>"
    rows = [(1, "https://h.example/a", long), (1, "https://h.example/a", long), (2, None, None), (None, "::bad[", "<p>x</p>"), (3, "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' as __x", "1 as n_chars", "2 as votes")
    got = sorted(((r.page_id, r.n_chars, r.text.count("number")) for r in hx.extract_pages(df).collect()), key=str)
    assert len(got) == 5 and [g[2] for g in got if g[0] == 1] == [20_000, 20_000] and (2, 0, 0) in got and (None, 1, 0) in got


def test_many_hosts_take_the_join(spark, monkeypatch):
    monkeypatch.setattr(hx, "SMALL_ROWS", 1)
    rows = [(i, f"https://h{i % 3}.example/a", f"<div class='text'>{PART.format(i) * 3}</div><div class='extra'><p>x</p></div>") for i in range(9)]
    got = hx.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 9 and all(f"number {r.page_id}." in r.text for r in got)


def test_articles_are_never_lost_to_a_word():
    two = PART.format(1) + PART.format(2)
    for page in (
        f"<body><div class='has-header layout'><article>{two}</article></div></body>",
        f"<body><article class='post comments-open'>{two}</article></body>",
        f"<body><main class='single no-comments'>{two}</main></body>",
        f"<body><form id='aspnetForm'><div class='page'><article>{two}</article></div></form></body>",
        f"<body><div id='header'><main>{two}</main></div></body>",
        f"<body><div class='comments-wrap'><main>{two}</main></div></body>",
        f"<body><div class='site'><div class='post'><header><h1>Head</h1><p>By Ann, May</p>{PART.format(1)}</header>{PART.format(2)}</div></div></body>",
    ):
        got = kept(page)
        assert "number 1." in got and "number 2." in got and "By Ann" not in got, page
    for word in ("share-price", "social-history", "search-theory", "ad-hoc", "login-study"):
        got = kept(f"<body><article>{PART.format(1)}<div class='{word}'><p>The price rose by a third.</p></div>{PART.format(2)}</article></body>")
        assert "rose by a third." in got, word
    got = kept(f"<body><article><header><h1>Head</h1><p>By Ann Smith</p><p>A lead paragraph, which says what follows.</p></header>{two}</article></body>")
    assert "A lead paragraph" in got and "Head" in got and "Ann Smith" not in got


def test_furniture_by_its_whole_name():
    for word in ("ad", "ad-slot-3", "share-buttons", "post-comments", "comment-list", "cookie-notice", "relatedLinks", "newsletter_box", "td-post-sharing-top", "jp-related-posts", "site-header"):
        got = kept(f"<body><article>{PART.format(1)}{PART.format(2)}<div class='{word}'><a href='/x'>Read this one too</a> <a href='/y'>And this</a></div></article></body>")
        assert "number 2." in got and "Read this" not in got, word
    for word in ("ad", "ad-slot-3", "share-buttons", "post-comments", "comment-list", "cookie-notice", "commentBody"):
        got = kept(f"<body><article>{PART.format(1)}{PART.format(2)}<div class='{word}'><p>A whole sentence that isn't of the article.</p></div></article></body>")
        assert "number 2." in got and "whole sentence" not in got, word

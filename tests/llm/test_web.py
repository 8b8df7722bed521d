import html
import re
import time

import duckdb
import numpy as np
import pytest

from kadenz.llm import html_extract as H
from kadenz.llm import queries
from kadenz.llm import url_filter as U

SF = "/root/testdata/sf0.01"


def article(raw):
    """Brute force for the given pages: blocks between block tags of <article>."""
    body = re.search(r"<article>(.*?)</article>", raw, re.S)[1]
    parts = re.split(r"</?(?:p|h\d|article|div|ul|ol|li)\b[^>]*>", re.sub(r"<(?:br|/?b|/?i)>", " ", body))
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts]
    return "\n".join(b for b in blocks if b)


def test_given_pages(spark):
    rows = queries.op7_html_extraction(spark, SF).collect()
    raw = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(rows) == len(raw)
    assert [r.page_id for r in rows if r.text != article(raw[r.page_id])] == []
    assert all(r.n_chars == len(r.text) for r in rows)


PAGE = """<html><head><title>T</title></head><body><header class="site"><a href="/">Home</a></header>
<div id="menu"><ul><li><a href=x>one</a><li><a href=y>two</a></ul></div>
<div class="cookie-notice">We use cookies &amp; more of them for you, dear reader, in a long sentence.</div>
<div class="post-body c{n}"><h1>Title {n}</h1><p>First &lt;b&gt; paragraph
 with&nbsp;space.<p>Second <i>one</i><br>line<script>var a = "<p>no</p>";</script><!-- <p>no --><ul><li>item<li>thing</ul>
 loose text<form><input name=q>search</form></div><div class="sidebar"><p>Read this other long text, a very long text, which is not part of it at all.</p></div>
<section class="comments"><p>{long}</p></section><footer>&copy; all</footer></body></html>"""
WANT = "Title {n}\nFirst <b> paragraph with space.\nSecond one line\nitem\nthing\nloose text"


def test_layouts_of_a_host(spark):
    rows = [(i, "http://a.net/x", PAGE.format(n=i, long="I like this. " * 60)) for i in range(9)]
    rows += [(20, "http://a.net/y", None), (21, None, ""), (22, "no host", "<p>only <b>text"), (23, "http://a.net/z", "plain"), (24, "http://a.net/q", '<p class="a" id="unclosed')]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string").selectExpr("*", "'k' AS text_path", "1 AS host")
    got = {r.page_id: r for r in H.extract(pages).collect()}
    assert all(got[i].text == WANT.format(n=i) and got[i].text_path == "html/body/div.post-body" for i in range(9))
    assert [got[i].text for i in (20, 21, 22, 23)] == ["", "", "only text", "plain"] and got[20].text_path is None
    assert set(got[0].asDict()) == {"page_id", "url", "host", "text", "text_path"}
    assert H.extract(pages.where("false")).count() == 0


def test_hard_pages_take_time_in_proportion():
    pages = {
        "deep": "<div class='sidebar'>" * 50_000 + "text " * 20 + "</div>" * 50_000,
        "no end of a tag": "<a " * 350_000,
        "inline": "<b>" * 50_000 + "<p>a</p>" * 20_000,
        "items": "<ul><li><div>" * 20_000 + "t",
        "quotes": "<a x=\"'" * 100_000 + ">",
        "comments": "<p>a" + "<!--" * 250_000,
        "long": "<p>" + "word " * 400_000 + "</p>",
    }
    for name, page in pages.items():
        began = time.perf_counter()
        votes, (text, path) = H.votes_of(page), H.main_text(page, [])
        assert time.perf_counter() - began < 10, name  # quadratic work would take minutes
        assert (path is None) == (not votes) == (not text), name
    assert H.main_text(pages["long"], [])[0] == ("word " * 400_000).strip()
    assert H.main_text(pages["comments"], [])[0] == "a"


def test_marks_inside_an_article_and_ties_of_votes(spark):
    text = "A paragraph that is long enough to count. " * 3
    assert H.main_text(f'<article><div class="register legal"><p>{text}</p></div></article>', [])[0] == text.strip()
    # two layouts with equal votes: each page has one of them only, and gives its own
    a, b = f"<div class=a><p>{text}</p></div>", f"<div class=b><p>{text}</p></div>"
    rows = [(i, "http://h.net/", (a, b)[i % 2]) for i in range(4)] + [(4, "http://h.net/", a + b), (5, "http://h.net/", b + a)]
    got = {r.page_id: r.text_path for r in H.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert [got[i] for i in range(4)] == ["div.a", "div.b"] * 2
    assert got[4] == got[5] and got[4] in ("div.a", "div.b", "")  # the same winner, whichever comes first


NOTICE = "".join(f"<p>We and our partners use cookies, reason {i}.</p>" for i in range(30))
SHORT = "<h1>A title</h1><p>" + "Eighty characters of an article. " * 3 + "</p>"


def test_long_notices_never_beat_an_article():
    want = "A title\n" + ("Eighty characters of an article. " * 3).strip()
    for body in (f"<article>{SHORT}</article>", f"<main>{SHORT}</main>", f"<div class=content>{SHORT}</div>", f"<div class=content>{SHORT.split('</h1>')[1]}</div>"):
        for notice in (f"<div class='cookie-notice'>{NOTICE}</div>", f"<div class='cookie-notice'><h2>Your choice</h2>{NOTICE}</div>"):
            for page in (f"<body>{notice}{body}</body>", f"<title>A title | Site</title><body>{body}{notice}</body>"):
                expected = want if "<h1>" in body else want.split("\n")[1]
                assert H.main_text(page, [])[0] == expected
                winners = [k for k, _ in sorted(H.votes_of(page), key=lambda v: -v[1])]
                assert H.main_text(page, winners)[0] == expected


def test_a_marked_wrapper_with_the_page_title_is_kept():
    text = "<p>" + "Long text of the article, which goes on. " * 20 + "</p>"
    page = f"<title>Some heading - Site</title><body><div id=notice-board><h1>Some heading</h1>{text}</div><div><p>Made by us.</p></div></body>"
    assert H.main_text(page, [])[0].startswith("Some heading\nLong text")


def test_sections_keep_title_and_introduction():
    sections = "".join(f"<section class=part><h2>Part {i}</h2><p>{'Some words of this part. ' * 12}</p></section>" for i in range(4))
    page = f"<body><div class=menu><a href=x>one</a></div><div class=post><h1>Title</h1><p>Introduction to it all.</p>{sections}</div><div class=foot><p>Made by us.</p></div></body>"
    winners = [k for k, _ in sorted(H.votes_of(page), key=lambda v: -v[1])]
    for found in (H.main_text(page, []), H.main_text(page, winners)):
        assert found[0].startswith("Title\nIntroduction to it all.\nPart 0\n") and found[0].count("Part") == 4 and "Made by" not in found[0]


def test_many_flat_marks_take_time_in_proportion():
    page = "<body>" + "<div class='ad'>x y z w</div>" * 100_000 + "</body>"
    began = time.perf_counter()
    H.Page(page)
    assert time.perf_counter() - began < 5


def test_filter_keeps_columns_with_clashing_names(spark):
    rows = [(1, "http://good.org/a", "", "own", 5, "x"), (2, None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string, verdict string, `__host` int, rank string")
    got = U.url_filter(pages)
    assert got.columns == ["page_id", "url", "__host", "rank", "host", "path", "rule", "verdict"]
    assert sorted((r.page_id, r["__host"], r.verdict) for r in got.collect()) == [(1, 5, "allow"), (2, None, "allow")]


def test_filter_against_sql(spark):
    got = sorted(tuple(r) for r in queries.op10_url_filter(spark, SF).select("page_id", "host", "path", "rule", "verdict").collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    want = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({U.oracle()}) ORDER BY page_id").fetchall()
    assert got == want


def test_trust_spreads_over_links(spark):
    a = lambda *hosts: "".join(f'<a HREF = "https://{h}/x">' for h in hosts) + '<a href="/own">'
    rows = [
        (1, "http://good.org/a", a("Friend.net", "neutral.net")), (2, "http://bad.com/de/1", None), (3, "http://farm.net/", a("bad.com", "bad.com")),
        (4, "http://friend.net/?q", a("bad.com", "good.org")), (5, "http://neutral.net", ""), (6, None, None), (7, "mailto:x", a("bad.com")),
        (8, "HTTP://X.Example.ORG/es/1?a#b", ""), (9, "http://example.org/en/1234", ""), (10, "http://org?x", ""), (11, "http://far.net/", a("farm.net")), (11, "http://far.net/", a("farm.net")),
    ]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    out = U.url_filter(pages).collect()
    assert len(out) == len(rows)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out}
    assert got[1] == ("good.org", "/a", "org/", "allow") and got[2][2:] == ("com/de/", "block")
    assert got[3][2:] == (None, "block") and got[11][2:] == (None, "block")
    assert got[4][:3] == ("friend.net", "/", None)
    assert got[5] == ("neutral.net", "", None, "allow") and got[6] == ("", "", None, "allow") == got[7]
    assert got[8] == ("x.example.org", "/es/1", "example.org/es/", "block") and got[9][2:] == ("example.org/en/1", "block")
    assert got[10] == ("org", "", None, "allow")
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id INT, url TEXT, html TEXT)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    want = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({U.oracle()})").fetchall()
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in out)
    assert U.url_filter(pages.where("false")).count() == 0


def test_links_that_count(spark):
    rows = [("x.org", "<a href=//A.net/1><!-- <a href='//b.net'> --><a data-href='//c.net'><a\nhref='https&#58;//d.net'><a class=k href=\"http:&#x2F;&#47;e.net/\"><!-- <a href=//f.net>")]
    got = U.host_edges(spark.createDataFrame(rows, "host string, html string")).collect()
    assert sorted(r.dst for r in got) == ["a.net", "d.net", "e.net"]


def test_ranks_are_those_of_the_power_method(spark):
    rng = np.random.default_rng(9)
    n = 300
    found = {(int(a), int(b)): float(w) for a, b, w in zip(rng.integers(0, n, 2000), rng.zipf(1.3, 2000) % n, rng.integers(1, 9, 2000), strict=True) if a != b}
    seeds = rng.choice(n, 12, replace=False)
    m = np.zeros((n, n))
    for (a, b), w in found.items():
        m[b, a] = w
    m = m / np.maximum(m.sum(0), 1e-300)
    start = np.zeros(n)
    start[seeds] = 1.0
    rank = np.zeros(n)
    for _ in range(500):
        rank = (1 - U.DAMPING) * start + U.DAMPING * m @ rank
    edges = spark.createDataFrame([(f"h{a}", f"h{b}", w) for (a, b), w in found.items()], "src string, dst string, w double")
    got = {r.host: r["rank"] for r in U.propagate(edges, spark.createDataFrame([(f"h{i}", 1.0) for i in seeds], "host string, s double")).collect()}
    assert {h for h in got} == {f"h{i}" for i in range(n) if rank[i] > 0}
    assert all(got[h] == pytest.approx(rank[int(h[1:])], rel=2e-3) for h in got)


def test_large_farms_and_long_chains_are_blocked(spark):
    """More linkers than an absolute cut-off lets through, and hosts further away than a fixed number of rounds reaches."""
    a = lambda h: f'<a href="https://{h}/x">'
    rows = [("http://bad.com/de/1", ""), ("http://good.org/", a("friend.net")), ("http://friend.net/", a("bad.com"))]
    rows += [(f"http://farm{i}.net/", a("bad.com")) for i in range(300)]
    rows += [("http://chain0.net/", a("farm0.net"))] + [(f"http://chain{i}.net/", a(f"chain{i - 1}.net")) for i in range(1, 14)]
    rows += [("http://alone.net/", a("nowhere.net"))]
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id int, url string, html string")
    got = {r.host: r.verdict for r in U.url_filter(pages).collect()}
    allowed = {"good.org", "friend.net", "alone.net"}
    assert {h for h, v in got.items() if v == "allow"} == allowed and len(got) == len(rows)


def test_marks_on_a_wrapper_keep_the_article():
    body = "<h1>Head</h1><p>" + "The article says so. " * 5 + "</p>"
    want = "Head\n" + " ".join(("The article says so. " * 5).split())
    talk = '<div class="comments"><ol><li class="comment"><article class="comment-body"><p>' + "I like it. " * 90 + "</p></article></li></ol></div>"
    side = '<div class="sidebar"><p>Some other text of the site.</p></div>'
    for wrap in ("content-sidebar-wrap", "site no-sidebar", "post has-comments", "sidebar-layout"):
        for inner in (f"<article>{body}</article>", f"<div>{body}</div>"):
            for more in ("", side, talk, side + talk):
                if wrap == "sidebar-layout" and more and "<article>" not in inner:
                    continue
                for page in (f"<body><div class='{wrap}'>{inner}{more}</div></body>", f"<body><div id=nav><a href=x>one</a></div><div class='{wrap}'>{inner}</div>{more}</body>"):
                    assert H.main_text(page, [])[0] == want, page
    assert H.main_text(f"<body><div class=post>{body}</div>{talk}</body>", [])[0] == want
    assert H.main_text(f"<body><div class='comments-wrap'>{body * 9}</div><div class=post>{body}</div></body>", [])[0] == want

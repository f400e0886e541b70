"""op7: main text of pages."""

import math
import re
from collections import Counter

import pytest

from terrapatch.llm import queries, sitetree

from .conftest import SF

KIND = "page_id long, url string, html string, text string, n_chars string, host string, path string"


def pages(spark, *rows):
    return spark.createDataFrame([(i, u, h, "x", "y", "z", None) for i, u, h in rows], KIND)


def texts(df):
    return {r["page_id"]: r["text"] for r in df.collect()}


def plain(html):
    return " ".join(t for _, t, k in sitetree.blocks(html) if k)


def test_whole_table(spark):
    """In the generated pages the article is marked: its text, taken with a parser of the standard library, is the main text."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.out = False, []

        def handle_starttag(self, tag, attrs):
            self.inside |= tag == "article"
            if tag in ("p", "h1", "br", "div", "li"):
                self.out.append(" ")

        def handle_endtag(self, tag):
            if tag == "article":
                self.inside = False
            if tag in ("p", "h1", "div", "li"):
                self.out.append(" ")

        def handle_data(self, data):
            if self.inside:
                self.out.append(data)

    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in queries.op7_sitetree(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        a = Article()
        a.feed(r["html"])
        want = " ".join("".join(a.out).split())
        assert got[r["page_id"]] == (r["url"], want, len(want))


@pytest.mark.parametrize(
    "html, want",
    [
        ("<p>a &amp; b&nbsp;c &#233; &lt;x&gt;</p>", "a & b c é <x>"),
        ("<div>one\n  two</div><div>three</div>", "one two three"),
        ("<p>un<b>bro</b>ken</p>", "unbroken"),
        ("<p>a<br>b<p>c", "a b c"),
        ("<nav>menu</nav><article><p>x</p><aside>side</aside><form>f</form><div class='comments'>c</div></article><footer>f</footer>", "x"),
        ("<header>top</header><main><header><h1>Title</h1></header><p>x</p></main>", "Title x"),
        ("<script>var a='</p>';</script><style>p{}</style><!-- no --><p>x", "x"),
        ("<div class='cookie-notice'>no</div><div id='sidebar'>no</div><div class='advert'>no</div><p>yes</p>", "yes"),
        ("<div role='navigation'>no</div><div hidden>no</div><div style='display: none'>no</div>yes", "yes"),
        ("<nav>never closed<article>text</article>", "text"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a b c d"),
        ("plain text", "plain text"),
        ("a < b and 3 > 2", "a < b and 3 > 2"),
        ("<title>t</title><noscript>n</noscript>x<", "x<"),
        ("", ""),
    ],
)
def test_markup(html, want):
    assert plain(html) == want


def test_what_a_site_repeats_goes(spark):
    """Blocks that give themselves away by repetition only, on the host's pages."""
    body = lambda i: f"<div class='x1'>Same slogan</div><div class='x2'><p>Story {i} tells of {i * 7}</p></div><div class='x3'>All rights</div>"
    rows = [(i, f"http://one.example/{i}", body(i)) for i in range(20)]
    rows += [(100 + i, f"https://USER@Two.example:80/{i}", body(0)) for i in range(3)]
    got = texts(sitetree.extracted(pages(spark, *rows)))
    assert all(got[i] == f"Story {i} tells of {i * 7}" for i in range(20))
    assert got[100] == "Same slogan Story 0 tells of 0 All rights"  # too few pages to tell


def test_no_page_is_emptied_by_repetition(spark):
    got = texts(sitetree.extracted(pages(spark, *[(i, "http://same.example/", "<p>All pages are alike</p>") for i in range(30)])))
    assert set(got.values()) == {"All pages are alike"}


def tree(rows):
    """Importance of each host's nodes by their definition, from the blocks of its distinct pages."""
    sites = {}
    for u, h in {(re.sub(r"^\w+://([^/]*).*", r"\1", u), h) for u, h in rows}:
        sites.setdefault(u, []).append([(p, t) for p, t, k in sitetree.blocks(h) if k])
    out = {}
    for name, found in sites.items():
        paths = {q for page in found for p, _ in page for q in sitetree.branches(p)}
        rest = {}
        for p in paths:
            on = [page for page in found if any(q == p for q, _ in page)]
            texts_ = Counter(t for page in on for t in {t for q, t in page if q == p})
            log = math.log(len(on)) if len(on) > 1 else 1
            rest[p] = (sum(n * (1 - math.log(n) / log) for n in texts_.values()), sum(texts_.values()), len(on))
        for p in paths:
            shown = []
            for page in found:
                children, last = [], None
                for q, _ in page:
                    up = sitetree.branches(q)
                    if p in up[:-1]:
                        child = up[up.index(p) + 1]
                        if child == q or child != last:
                            children.append(child)
                        last = child
                    else:
                        last = None
                if children:
                    shown.append(tuple(children))
            below = [rest[q] for q in paths if p in sitetree.branches(q) and rest[q][1]]
            content = sum(a for a, _, _ in below) / sum(n for _, n, _ in below)
            c, m = Counter(shown), len(shown)
            e = -sum(n / m * math.log(n / m) for n in c.values()) / math.log(m) if m > 1 else 1
            own = 1 - sitetree.GAMMA ** len(c)
            m = max(m, rest[p][2])
            out[name, p] = (m, (m * (own * e + (1 - own) * content) + sitetree.PRIOR) / (m + sitetree.PRIOR))
    return out


def test_tree_by_its_definition(spark):
    rows = [(i, f"http://h{i % 3}/{i}", f"<div class=a>same</div><div class=b><ul>{'<li>x' * (i % 4)}<li>{i}</ul><p>{i // 2}</p>tail {i % 5}</div>" + "<article><p>one</p></article>" * (i % 2)) for i in range(24)]
    rows += rows[:7]
    got = {(r["host"], r["path"]): (r["pages"], r["importance"]) for r in sitetree.style_tree(sitetree.nodes(pages(spark, *rows), "html", "url")).collect()}
    want = tree([(u, h) for _, u, h in rows])
    assert set(got) == set(want)
    for key, (m, x) in want.items():
        assert got[key][0] == m and got[key][1] == pytest.approx(x)


def test_the_tree_decides_inside_and_outside_of_articles(spark, monkeypatch):
    """A teaser in an article does not hide the text beside it, and what every page repeats goes from articles too; without the tree, both stay."""
    body = lambda i: f"<article class=teaser>Read more news</article><div class=story><p>Story {i}</p></div><article><p>Piece {i}</p><p class=s>Same line</p></article>"
    rows = pages(spark, *[(i, f"http://one.example/{i}", body(i)) for i in range(40)])
    assert texts(sitetree.extracted(rows)) == {i: f"Story {i} Piece {i}" for i in range(40)}
    monkeypatch.setattr(sitetree, "LOW", 0.0)
    assert texts(sitetree.extracted(rows))[7] == "Read more news Story 7 Piece 7 Same line"


def test_copies_of_a_page_do_not_make_it_unimportant(spark):
    rows = [(i, "http://one.example/", "<div><h1>Copied</h1><p>text</p></div>") for i in range(60)] + [(100 + i, "http://one.example/", f"<div><h1>T{i}</h1><p>text {i}</p></div>") for i in range(5)]
    got = texts(sitetree.extracted(pages(spark, *rows)))
    assert got[3] == "Copied text" and got[101] == "T1 text 1"


def test_joined_nodes_equal_broadcast_ones(spark, monkeypatch):
    rows = pages(spark, *[(i, "http://a.example/", f"<div>same</div><p>{i}</p>") for i in range(12)])
    one = texts(sitetree.extracted(rows))
    monkeypatch.setattr(sitetree, "BROADCAST", -1)
    assert texts(sitetree.extracted(rows)) == one == {i: str(i) for i in range(12)}


def test_odd_rows(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    df = pages(spark, (1, None, None), (None, "no url", "<p>x</p>"), (2, "", ""), (3, "http://x/", deep), (3, "http://x/", deep), (4, "http://x/", "w " * 200_000), (5, "http://x/", "\u0000<p>é\u0000</p>"))
    rows = sitetree.extracted(df).collect()
    assert len(rows) == 7 and all(r["n_chars"] == len(r["text"]) for r in rows)
    got = {r["page_id"]: r["text"] for r in rows}
    assert got[1] == "" and got[2] == "" and got[3] == "deep" and len(got[4]) == 399_999
    assert sitetree.extracted(pages(spark).limit(0)).collect() == []

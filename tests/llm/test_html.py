import re
import time
from html import unescape

from graphflow.llm import html

SF = "/root/testdata/sf0.01"


def plain_article(page):
    """The pages' article by a parser of their one layout."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = (" ".join(unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(b for b in blocks if b)


def test_pages(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet")
    want = sorted((r["page_id"], r["url"], plain_article(r["html"])) for r in rows.collect())
    got = sorted((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in html.extract(rows).collect())
    assert [g[:3] for g in got] == want and all(n == len(t) for _, _, t, n in got)


LONG = "A sentence of the article, with commas, and an end. " * 4


def test_boilerplate_goes():
    page = f"""<!doctype html><html><head><title>T</title><script>var a="</p><p>no</p>";</script><style>p{{}}</style></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a><li><a href=y>About</a></ul></nav>
    <div class="cookie-notice"><p>{LONG} cookies</p></div><aside><p>{LONG} side</p></aside>
    <main><h1>Title &amp; more</h1><p>{LONG}<p>Short.<ul><li>one<li>two &#233;&nbsp;x</ul><blockquote>said</blockquote><form><p>Mail: <input><button>Go</button></form>
    <p hidden>gone</p><p>a<b>b</b>c <i>d</i><!-- no --></p></main>
    <section id="comments"><p>{LONG} reader</p></section><div class="ad">Buy</div><footer>&copy; x</footer></body></html>"""
    want = ["Title & more", LONG.strip(), "Short.", "one", "two é x", "said", "abc d"]
    assert html.main_text(page).split("\n") == want
    bare = page.replace("<main>", '<div class="story"><div>').replace("</main>", "</div></div>")
    assert html.main_text(bare).split("\n") == want


def test_heads_of_sites_and_of_articles():
    page = f'<div class="site-header"><p>{LONG} site</p></div><div class="post"><div class="post-header"><h1>Title</h1></div><p>{LONG}</p></div><div id="header">x</div>'
    assert html.main_text(page).split("\n") == ["Title", LONG.strip()]
    page = f"<article><header><h1>Title</h1></header><p>{LONG}</p><footer>bio</footer></article><div role=banner>{LONG}</div>"
    assert html.main_text(page).split("\n") == ["Title", LONG.strip()]


def layouts():
    """Pages without an article element, and what they say."""
    for k in range(12):
        side = f'<div class="box{k}"><p>{LONG * (k % 3 + 1)}</p></div>' if k % 4 == 0 else f"<div>Tip {k}</div>"
        links = "".join(f"<li><a href=/{i}>Link number {i} of the page</a>" for i in range(k + 3))
        paragraphs = [f"Paragraph {i}. {LONG * 3}" for i in range(3 + k % 4)]
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        advert = f'<div class="ad">{"Buy this now, at once. " * (k + 1)}</div>'
        comments = f'<div class="comments"><div>{LONG * 2} says a reader</div></div>'
        title = f"<h1>Title {k}</h1>"
        want = "\n".join([f"Title {k}", *(" ".join(p.split()) for p in paragraphs)])
        yield f"<body><ul>{links}</ul>{advert}<div class=story>{title}{body}</div>{comments if k % 2 else ''}{'' if k % 4 == 0 else side}</body>", want


def test_scores_decide(monkeypatch):
    pages = list(layouts())
    got = [html.main_text(p) for p, _ in pages]
    assert got == [w for _, w in pages]
    scored = html.path_scores
    monkeypatch.setattr(html, "path_scores", lambda page: dict.fromkeys(scored(page), 1.0))
    assert all(html.main_text(p) != w for p, w in pages)


def test_equal_scores_change_the_pages(spark, monkeypatch):
    rows = [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").limit(60).collect()]
    want = [html.main_text(h) for h in rows]
    scored = html.path_scores
    monkeypatch.setattr(html, "path_scores", lambda page: dict.fromkeys(scored(page), 1.0))
    assert sum(html.main_text(h) != w for h, w in zip(rows, want, strict=True)) > 50


def test_nothing_else_is_dropped_inside_an_article():
    parts = ["<p>Let <math><mi>x</mi></math> be.</p>", '<section class="related-work"><p>Work by others.</p></section>', '<div class="notice-board-history"><p>Boards.</p></div>', "<noscript><p>Plain.</p></noscript>", "<p><label>Named</label> <object>thing</object></p>", '<h2 class="search">Search</h2>']
    want = ["Let x be.", "Work by others.", "Boards.", "Plain.", "Named thing", "Search"]
    page = f"<body><article><p>{LONG}</p>{''.join(parts)}<div class=notice>Cookies!</div></article></body>"
    assert html.main_text(page).split("\n") == [LONG.strip(), *want]


def test_title_above_sections():
    page = f"<div class=content><h1>Title of it</h1><section><p>{LONG * 2}</p><p>{LONG * 2}</p></section><section class=b><p>Short end.</p></section></div>"
    assert html.main_text(page).split("\n") == ["Title of it", *[(LONG * 2).strip()] * 2, "Short end."]


def test_time_grows_with_the_page():
    for make_page in (lambda n: "<a " * n, lambda n: "<!x" * n, lambda n: "<a '" * n, lambda n: '<a b="' * n, lambda n: "<div><p>x y z. " * n, lambda n: "<div>" * n + "</span></section>" * n, lambda n: "<li><ul>" * n, lambda n: "<!--" * n, lambda n: "<td>a<table>" * n):
        began = time.perf_counter()
        html.main_text(make_page(20_000))
        assert time.perf_counter() - began < 5


def test_broken_markup():
    assert html.main_text(None) == "" == html.main_text("") == html.main_text("<p>") == html.main_text("<nav>only</nav>")
    assert html.main_text("no markup at all") == "no markup at all"
    assert html.main_text("<p>cut <b>off <a href='x") == "cut off <a href='x"
    assert html.main_text("<article><p>one<br>two</p><script>x") == "one two"
    assert html.main_text("<p>1 < 2 & 3 &lt; 4") == "1 < 2 & 3 < 4"
    deep = "<div>" * 3000 + f"<p>{LONG}</p>" + "</div>" * 10
    assert html.main_text(deep) == LONG.strip()


def test_odd_rows(make):
    page = f"<article><p>{LONG}</p></article>"
    df = make([(1, "u", None, "x"), (2, None, "", "x"), (None, "v", page, None), (3, "w", page, "x"), (3, "w", page, "x")], "page_id long, url string, html string, text string")
    got = sorted(map(str, html.extract(df).collect()))
    assert len(got) == 5 and sum("sentence" in g for g in got) == 3 and html.extract(df).columns == ["page_id", "url", "text", "n_chars"]
    assert html.extract(make([], "page_id long, url string, html string")).count() == 0

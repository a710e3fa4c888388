"""Operator 8: articles of the test pages, page shapes, and entropy over a site."""

import html
import re

from calibrium.llm.sitetree import extract_main_text, main_text, op8_site_style_tree, removed_nodes, styles


def test_whole_table(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op8_site_style_tree(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)(</article>|\Z)", pages[r.page_id].html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*(>|\Z)", " ", article)).split())
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, want, len(want))


def test_page_shapes():
    page = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><a>x</a></nav><main><article class=post><header><h1>A &amp; B</h1></header>
      <p>wo<b>rd</b> one<br>two <script>var a = "</p>";</script><p>three&nbsp;four</p><form><input value=">"><p>f</form><div class="ad-slot">buy</div><aside>see</aside>
      <section class="comments"><article>no</article></section><ul><li>a<li>b</ul></article></main><div id="cookie-notice">ok</div><footer>f</footer></body></html>"""
    assert main_text(page) == "A & B word one two three four a b"
    assert main_text("<div>left <span>right</span></div><div role=navigation>n</div>") == "left right"
    assert main_text("<p>1 < 2 &lt; 3 <!-- <p>c</p> --> <p") == "1 < 2 < 3"
    assert main_text("<article><p>a<article><p>b</article></article>") == "a b"
    assert main_text("plain text") == "plain text" and main_text(None) == "" and main_text("<nav>only</nav>") == ""
    assert main_text('<p title="a > b">x</p><textarea><p>t</textarea>') == "x" and main_text("<p>" * 3000 + "deep") == "deep"


def test_repeated_branches_go(spark):
    page = lambda i, extra: f"<html><body><div class=top>Same words</div><div class=text><p>Story {i} of its own {i * 7}</p>{extra}</div></body></html>"
    rows = [(i, f"http://a.org/{i}", page(i, "<p class=tail>Read more</p>")) for i in range(30)] + [(100 + i, f"http://b.org/{i}", page(i, "")) for i in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract_main_text(pages).collect()}
    assert got[3] == "Story 3 of its own 21" and got[101] == "Same words Story 1 of its own 7"


def test_repeated_articles_stay(spark):
    same = "<html><body><article><h1>One</h1><p>for all pages</p></article></body></html>"
    pages = spark.createDataFrame([(i, "http://a.org/x", same) for i in range(40)], "page_id long, url string, html string")
    assert {r.text for r in extract_main_text(pages).collect()} == {"One for all pages"}
    assert removed_nodes(pages.selectExpr("'a.org' AS host", "html")).collect() == []


def test_odd_rows(spark):
    pages = spark.createDataFrame([(None, None, None, "h"), (1, "http://x/", "", "h"), (2, None, "<p>é ☃</p>", "h"), (2, None, "<p>é ☃</p>", "h")], "page_id long, url string, html string, host string")
    assert sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in extract_main_text(pages).collect()) == [(0, None, "", 0), (1, "http://x/", "", 0), (2, None, "é ☃", 3), (2, None, "é ☃", 3)]
    assert extract_main_text(pages.limit(0)).collect() == []


def test_hosts_of_copies_keep_every_article(spark):
    page = lambda p, more="", menu="<div class=top>Same words</div>": f"<html><body>{menu}<article><h1>Head</h1><p>{p}</p>{more}</article></body></html>"
    rows = [(i, "http://a.org/x", page("One story for many pages")) for i in range(90)] + [(100 + i, "http://a.org/y", page(f"Story {i} of its own {i * 7}")) for i in range(10)]
    rows += [(200, "http://a.org/z", page("One story for many pages", "<h2>Rare words</h2>"))]
    # a node that is important, but stands on a few pages only
    rows += [(1000 + k, "http://b.org/x", page("One story for many pages", f"<h2>Part {k}</h2>" if k < 9 else "")) for k in range(90)]
    # without a main element: pages that are nothing but a copy stay too
    rows += [(2000 + k, "http://c.org/x", f"<div><p>{'One story' if k < 90 else f'Story {k}'}</p></div>") for k in range(100)]
    # repeated words around texts that differ
    rows += [(3000 + k, "http://d.org/x", f"<article>By the staff<p>Story {k} of d</p></article>") for k in range(20)]
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in range(90)} == {"Head One story for many pages"} and got[200] == "Head One story for many pages Rare words"
    assert all(got[100 + i] == f"Head Story {i} of its own {i * 7}" for i in range(10))
    assert got[1000] == "Head One story for many pages Part 0" and got[1050] == "Head One story for many pages"
    assert {got[2000 + k] for k in range(90)} == {"One story"} and got[2095] == "Story 95"
    assert all(got[3000 + k] == f"Story {k} of d" for k in range(20))


def test_names_are_whole_tokens():
    story = "<article><p>story</p></article>"
    for name in ("layout has-sidebar", "no-sidebar", "content-with-menu", "social-studies", "ad-free", "sidebar", "menu", "page-wrapper nav"):
        assert main_text(f'<body><div class="top ad">x</div><div class="{name}">{story}<aside>y</aside></div></body>') == "story", name
        assert main_text(f'<div id="{name}"><div class="{name}"><main><p>story</p><p class="ads">x</p></main></div></div>') == "story", name
    for name in ("sidebar", "ad-slot", "cookie-notice", "wide main-menu", "site-header__nav", "menu-item-12", "comments", "reader-comments", "user-comments", "comment-thread", "cookie-law-info", "adsbygoogle"):
        assert main_text(f'<div class="{name}"><article>card</article></div>{story}') == "story", name
    assert main_text('<p>text</p><div class="no-sidebar">more</div><div class="sidebar">x</div>') == "text more"
    assert main_text(f'<div class="menu">{story}<div class="comments"><article>no</article></div></div>') == "story"
    assert main_text('<article class="has-comments">story</article><article class="comment even">no</article>') == "story"


def test_long_names_stay_apart():
    name = "flex items " * 8
    assert len(styles(f'<div class="{name} a">x</div><div class="{name} b">y</div>')) == 2


def test_notes_within_an_article_stay():
    assert main_text('<article><p>a</p><div class="alert alert-info">note</div><section class="user-comments">no</section></article>') == "a note"


def test_deep_pages_cost_no_more_than_their_nodes():
    import time
    import tracemalloc

    page = "<div class=x>" * 16_000 + "deep" + "</div>" * 16_000
    tracemalloc.start()
    began = time.time()
    found = styles(page)
    took, most = time.time() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 16_000 and main_text(page) == "deep" and took < 20 and most < 64 << 20


def test_importance_against_a_recomputation(spark):
    import math
    import random
    from collections import Counter, defaultdict

    from calibrium.llm.sitetree import DECAY, importance

    rng = random.Random(6)
    part = lambda: rng.choice(["<p>a</p>", "<p>b <b>c</b></p>", "<div class=k><p>d</p></div>", "<ul><li>e<li>f</ul>", "<nav>n</nav>"])
    rows = [(f"h{i % 3}", f"<body><div>{part()}{part()}</div><div class=z>same</div><article>{i % 4}{part()}</article></body>") for i in range(60)]
    shapes, texts, main = defaultdict(Counter), defaultdict(Counter), {}
    for host, page in rows:
        for node, (style, content, inside) in styles(page).items():
            shapes[host, node][style] += 1
            texts[host, node][content] += 1
            main[host, node] = main.get((host, node), False) or inside

    def spread(counts):
        total = sum(counts.values())
        return max(0.0, -sum(n / total * math.log(n / total) for n in counts.values()) / math.log(total)) if total > 1 else 1.0

    want = {}
    for key, counts in shapes.items():
        decay = DECAY ** len(counts)
        want[key] = ((1 - decay) * spread(counts) + decay * spread(texts[key]), sum(counts.values()), main[key])
    got = {(r.host, r.node): (r.importance, r.n_pages, r.main) for r in importance(spark.createDataFrame(rows, "host string, html string").repartition(4)).collect()}
    assert got.keys() == want.keys() and len(got) > 30
    for key, (x, n, inside) in want.items():
        assert abs(got[key][0] - x) < 1e-9 and got[key][1:] == (n, inside)

import random
import time
from collections import Counter

from preflens.llm import html_text as h

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head>
<body><header>top</header><nav><ul><li>menu</ul></nav><div class="ad">buy</div><div id="cookie-notice">we use</div>
<article><h1>Head &amp; line</h1><p>one <b>two
 three<p>four&nbsp;five<br>six<div class="comments"><p>nice!</div><form>mail</form></article>
<aside>more</aside><footer>&copy; all</footer></body></html>"""


def test_blocks_follow_markup():
    assert h.blocks(PAGE) == ["Head & line", "one two three", "four five six"]
    assert h.blocks("<p>a</p><nav>m</nav><div>b") == ["a", "b"]


def test_attributes_rule_out_by_name_and_value():
    for kept in ('style="overflow:hidden"', 'class="overflow-hidden"', 'aria-hidden="false"', 'title="The hidden hand"', "data-x='display:none'"):
        assert h.blocks(f"<div {kept}><article><p>text</p></article></div>") == ["text"], kept
    for gone in ("hidden", 'HIDDEN=""', 'aria-hidden="true"', "aria-hidden=TRUE", 'style="color:red; display : none"', 'class="side-menu"', "role=navigation"):
        assert h.blocks(f"<p>text</p><div {gone}><p>no</p></div>") == ["text"], gone
    assert h.blocks('<p>see <a href="/hidden-gems">the gems</a></p>') == ["see the gems"]


def test_words_of_a_class_or_id_keep_prose_inside_main():
    page = """<h2 class="ads">no</h2><main><h1 class="post-header">one</h1><header id="entry-header">two</header>
<h2 id="social-life">three</h2><p class="related">four <a id="comment-1" href="#">five</a></p><div class="share">no</div>
<h3 hidden>no</h3><a role="navigation">no</a></main>"""
    assert h.blocks(page) == ["one", "two", "three", "four five"]


def test_broken_pages_do_not_fail():
    assert h.blocks(None) == h.blocks("") == h.blocks("<!-- open <p>x") == h.blocks("<script>x") == []
    assert h.blocks("plain  text & 1 < 2") == ["plain text & 1 < 2"]
    assert h.blocks("</div></p>a</article>b<unknown>c") == ["a", "bc"]


def test_names_of_a_layout_do_not_empty_a_page():
    prose = words(30)
    for around in ('div class="has-sidebar"', 'div class="article-header-wrapper"', 'div id="sidebar-layout"', "form", 'body class="no-comments"'):
        assert h.blocks(f"<{around}><article><p>text</p></article></{around.split()[0]}>") == ["text"], around
        assert h.blocks(f"<{around}><p>{prose}</p></{around.split()[0]}>") == [prose], around
    assert h.blocks("<nav><ul><li>menu</ul><article><p>text</p></article>") == ["text"]
    assert h.blocks('<article><div class="article-header-wrapper"><h1>one</h1></div><p>two</p></article>') == ["one", "two"]
    assert h.blocks(f'<article class="teaser">teaser</article><div><p>{prose}</p></div>') == ["teaser", prose]


def test_long_side_text_stays_out():
    prose = words(40)
    for side in ("div class=ad", "div id=cookie-notice", "section class=comments", "footer", "aside", "nav", 'div class="sidebar"', "form"):
        tag = side.split()[0]
        assert h.blocks(f"<article>one</article><{side}><p>{prose}</p></{tag}>") == ["one"], side
    assert h.blocks(f"<article></article><div class=ad>{prose}</div>") == []
    assert h.blocks(f"<main><p>x</p><div class=comments><article>{prose}</article></div></main>") == ["x"]


def test_odd_tags():
    assert h.blocks('<p title="it>hello') == ["hello"]
    assert h.blocks('<p title="it>hello</p><p class="x">world</p>') == ["hello", "world"]
    assert h.blocks("<script src=/x/>var secret=1;</script><p>text") == ["text"]
    assert h.blocks("if a<b and c>d") == ["if a<b and c>d"]
    assert h.blocks('<p title="a > b">x</p><p data-x>y</p><b hidden>no</b>') == ["x", "y"]
    assert h.blocks("<b><article>x</b> y</article>z") == ["x y"]
    assert h.blocks("<li class=promo>no<li>yes<p hidden>no<p>and") == ["yes", "and"]
    assert h.blocks("<ul><li>a<ul><li>b</ul><li>c</ul>") == ["a", "b", "c"]


def test_odd_characters_take_linear_time():
    n = 200_000
    odd = ['<a "', "<", "<x and ", '<p a="it>x', "<p a='x\" ", "</b>", "<!--", "<script>", "<div>", "<p" + " " * 9, "<b a=", "&amp;"]
    began = time.process_time()
    for piece in odd:
        h.blocks(piece * (n // len(piece)))
    h.blocks("<div>" * (n // 10) + "<b>x</b>" * (n // 10))
    assert time.process_time() - began < 30


def words(n, start=0):
    return " ".join(f"w{start + i}" for i in range(n))


def test_strings_on_most_pages_of_a_host_go(spark):
    notice = words(30, 5000)
    page = lambda i, extra: f"<body><p>{words(40, 100 * i)}</p><p>{extra}</p><p>{words(25, 100 * i + 50)}</p></body>"
    rows = [(i, f"http://Host.example/{i}", page(i, notice if i % 4 else words(30, 9000 + 50 * i))) for i in range(12)]
    rows += [(20 + i, "http://other.example/", page(30 + i, notice)) for i in range(3)]
    rows += [(40, None, None), (41, "", ""), (41, "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "'x' as blocks")
    out = {r.page_id: r.text for r in h.main_text(pages).collect()}
    assert len(out) == 17 and out[40] == out[41] == ""
    for i in range(12):
        parts = [words(40, 100 * i), *([] if i % 4 else [words(30, 9000 + 50 * i)]), words(25, 100 * i + 50)]
        assert out[i] == "\n".join(parts)
    assert notice in out[20]
    assert h.main_text(pages.where("page_id > 99")).count() == 0


def test_run_inside_a_block_is_cut_and_the_rest_stays():
    notice = words(40, 700)
    parts = [words(30) + " " + notice + " " + words(30, 300)]
    marked = set(map(int, h.anchors(notice.split())[1]))
    left = h._without(parts, marked)[0].split()
    assert left[:30] == words(30).split() and left[-30:] == words(30, 300).split()
    assert len(left) - 60 <= 2 * h.WINDOW


def without_repeats(streams, least):
    """The definition: tokens outside all strings of LONG tokens that stand on `least` pages, for pages of one block."""
    starts = lambda t: [(i, tuple(t[i : i + h.LONG])) for i in range(len(t) - h.LONG + 1)]
    pages = Counter(s for t in {tuple(t) for t in streams} for s in {s for _, s in starts(t)})
    out = []
    for t in streams:
        gone = {k for i, s in starts(t) if pages[s] >= least for k in range(i, i + h.LONG)}
        out.append(" ".join(w for k, w in enumerate(t) if k not in gone))
    return out


def test_exactly_the_tokens_of_repeated_strings_go(spark):
    rng = random.Random(5)
    own = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    shared = [own(n) for n in (19, 20, 21, 25, 30, 35, 60, 8)]
    streams = []
    for i in range(12):
        stream = own(rng.randint(1, 15))
        for k, s in enumerate(shared):
            if (i + k) % 4:
                stream += s + own(rng.choice([0, 1, 3, 11, 40]))
        streams.append(stream)
    rows = [(i, "http://a.example/", "<p>" + " ".join(s) + "</p>") for i, s in enumerate(streams)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    out = {r.page_id: r.text for r in h.main_text(pages).collect()}
    assert [out[i] for i in range(12)] == without_repeats(streams, h.LEAST_PAGES)


def test_boilerplate_on_a_minority_of_pages_goes_and_copies_stay(spark):
    rng = random.Random(6)
    own = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    notice, article = own(30), own(60)
    streams = [own(25) + (notice if i < h.LEAST_PAGES else own(30)) + own(5) for i in range(40)]
    rows = [(i, "http://a.example/", "<p>" + " ".join(s) + "</p>") for i, s in enumerate(streams)]
    copies = [(100 + i, f"http://b.example/{i}", f"<div class='ad'>{i}</div><p>" + " ".join(article) + "</p>") for i in range(9)]
    few = [(200 + i, f"http://c.example/{i}", "<p>" + " ".join([*article, *([f"more{i}"] if i < 2 else [])]) + "</p>") for i in range(6)]
    pages = spark.createDataFrame(rows + copies + few, "page_id long, url string, html string").repartition(3)
    out = {r.page_id: r.text for r in h.main_text(pages).collect()}
    assert [out[i] for i in range(40)] == without_repeats(streams, h.LEAST_PAGES)
    assert all(" ".join(notice) not in out[i] for i in range(40))
    assert all(out[100 + i] == " ".join(article) for i in range(9))
    assert all(" ".join(article) in out[200 + i] for i in range(6))

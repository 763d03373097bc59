import html
import json
import re
import time

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from melisma.llm import htmlwrap as H


def text(page):
    return H.text_of(page)


def test_blocks_entities_and_space():
    assert text("<article><h1>A &amp; B</h1><p>one\n  two<br>three &eacute;&#33;<p>four <b>fi</b>ve</article>") == "A & B\none two three é!\nfour five"
    assert text("") == "" and text("plain words") == "plain words" and text("<p>a<p>b") == "a\nb"


def test_what_is_not_the_article_goes():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><h2>Site</h2></header><nav><a href=/>Home</a></nav>
    <div class="cookie-banner">We use cookies</div><div id="sidebar"><p>Side</p></div><script>var a="</p>";</script>
    <main><article><header><h1>Title</h1></header><p>Body text.</p><aside>Aside</aside><div class="ad">Buy</div><form><input><p>Form</p></form>
    <ul><li>first<li>second</ul><table><tr><td>cell<td>next</table><section class="comments"><article class="comment"><p>Nice!</p></article></section></article></main>
    <div class="comments"><p>reader</p></div><footer>&copy;</footer></body></html>"""
    assert text(page) == "Title\nBody text.\nfirst\nsecond\ncell\nnext"


def test_without_an_article_the_body_is_taken():
    assert text("<body><div><a href=x>Menu one</a> <a href=y>Menu two</a></div><div><p>Real text with a <a href=z>link</a> in it.</p></div></body>") == "Real text with a link in it."


def test_broken_markup():
    assert text("<article><p>open <b>bold<p>next</article></p></div>after") == "open bold\nnext"
    assert text("<article><p>1 < 2 and 3 > 2</p></article>") == "1 < 2 and 3 > 2"
    assert text("<article><!-- <p>no</p> --><p>yes") == "yes"
    assert text("<div>" * 3000 + "deep") == "deep"


def test_names_and_values_that_only_look_like_menus():
    """Parts of names, values of other attributes, and regions that hold the article drop nothing."""
    for open_ in ("<article class='post has-sidebar'>", "<div class='no-comments'><article>", "<div id='page' class='with-menu'><article>", "<div class='widget'><article>", "<article class='hidden-gem sidebar'>", "<div id=menu><main>"):
        assert H.text_of(f"<body>{open_}<p>The text.</p></article></main></div>") == "The text."
    page = "<article><p>See <a href='/the-hidden-truth'>one</a> <a href=/p?id=menu>two</a> <a title='Hidden gems' data-id='nav'>three</a><a href='/x' hidden> no</a><b class='x sidebar'> no</b>.</p></article>"
    assert H.text_of(page) == "See one two three."
    assert H.text_of("<main><p>Text.</p></main><div class='comments'><article><p>A</p></article><article><p>B</p></article></div>") == "Text."
    assert H.text_of("<article><p>Text.</p></article><div class='related'><article><p>Teaser</p></article></div>") == "Text."


def test_deep_pages():
    """Far below 400 open elements menus still go and paragraphs stay apart."""
    for depth in (500, 5000):
        page = "<article>" + "<div>" * depth + "<nav>menu</nav><p>One.</p><p>Two.</p>" + "</div>" * depth + "<p>Three.</p></article>"
        assert H.text_of(page) == "One.\nTwo.\nThree."
        tree = H.outline(H.parse(page))
        other = H.outline(H.parse(page.replace("<nav>", "<h2>x</h2><nav>")))
        assert len(H.Matching().pairs(tree[0], other[0])) > depth


def plain_matching(a, b):
    """Simple tree matching by its definition."""
    if a.tag != b.tag:
        return 0
    best = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, x in enumerate(a.kids, 1):
        for j, y in enumerate(b.kids, 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + plain_matching(x, y))
    return best[-1][-1] + 1


def test_tree_matching():
    a, b = H.outline(H.parse("<div><h1>x</h1><p>1</p><p>2</p></div>")), H.outline(H.parse("<div><h1>x</h1><ul><li>a</ul><p>3</p></div>"))
    pairs = H.Matching().pairs(a[0], b[0])
    assert {(a[i].tag, b[j].tag) for i, j in pairs} == {("#root", "#root"), ("div", "div"), ("h1", "h1"), ("p", "p")} and len(pairs) == 4


MARKUP = st.recursive(st.sampled_from(["x", "y "]), lambda inner: st.builds(lambda t, k: f"<{t}>{''.join(k)}</{t}>", st.sampled_from(["div", "section", "p", "h2", "b"]), st.lists(inner, max_size=4)), max_leaves=25)


@settings(max_examples=150, deadline=None)
@given(MARKUP, MARKUP)
def test_matching_equals_its_definition(x, y):
    a, b = H.outline(H.parse(x)), H.outline(H.parse(y))
    m = H.Matching()
    pairs = m.pairs(a[0], b[0])
    assert len(pairs) == m.weight(a[0], b[0]) == plain_matching(a[0], b[0])
    assert all(a[i].tag == b[j].tag for i, j in pairs) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
    again = H.built(*json.loads(H.written(a)))
    assert [(t.tag, t.size, t.shape, t.deep) for t in again] == [(t.tag, t.size, t.shape, t.deep) for t in a]


def test_long_lists_of_siblings():
    page = lambda k, n: H.outline(H.parse("".join(f"<div>{'<b>x</b>' * (i % k % 3)}</div><h2>t</h2>" for i in range(n))))
    began = time.perf_counter()
    a, b = page(5, 3000), page(7, 3000)
    assert len(H.Matching().pairs(a[0], b[0])) > 6000
    assert time.perf_counter() - began < 20


UNMARKED = """<html><body><div><a href=/>Home</a><a href=/n>News {0}</a><a href=/t>Topic {1}</a></div><div>Welcome to our site</div><div>Buy {0} now at {1}</div><div><h1>Story {0}</h1><p>It is told here that {1} met {0} by the sea.</p>
<div>Rate this story</div><p>Nobody knew {0} before that day, or {1} after it.</p><p><a href=/x>See the whole story of {0}</a></p></div><div>Read by {1} people</div></body></html>"""


def learnt(pages):
    trees = [H.outline(H.parse(p)) for p in pages]
    seed = H.built(*json.loads(H.written(trees[0])))
    batch = pa.RecordBatch.from_arrays([pa.array(["h"] * len(pages)), pa.array(pages), pa.array([H.written(trees[0])] * len(pages))], names=["host", "html", "seed"])
    rows = [tuple(r.values())[1:] for b in H.tally(iter([batch])) for r in b.to_pylist()]
    return H.Wrapper.read(H.Wrapper(seed, rows).written())


def test_the_wrapper_decides_where_nothing_is_marked():
    pages = [UNMARKED.format(chr(97 + k) * (k + 3), k * 7) for k in range(6)]
    w, aligner = learnt(pages), H.Aligner()
    for k, page in enumerate(pages):
        a, b = chr(97 + k) * (k + 3), k * 7
        want = f"Story {a}\nIt is told here that {b} met {a} by the sea.\nNobody knew {a} before that day, or {b} after it.\nSee the whole story of {a}"
        assert H.text_of(page, w, aligner) == want
        assert H.text_of(page) != want
    assert H.text_of("<p>Another layout", w, aligner) == "Another layout"
    assert H.text_of("", w, aligner) == ""


def test_a_marked_article_keeps_constant_prose_but_not_boxes():
    page = "<body><article><h2>Introduction</h2><p>Story {0}</p><div><p>Join us</p></div><p>The end.</p></article></body>"
    pages = [page.format(k) for k in range(4)]
    w = learnt(pages)
    assert H.text_of(pages[2], w, H.Aligner()) == "Introduction\nStory 2\nThe end."
    same = ["<body><p>{0}</p><article><div><p>Same text</p></div></article></body>".format(k) for k in range(4)]
    assert H.text_of(same[1], learnt(same), H.Aligner()) == "Same text"


def test_article_text_that_names_do_not_take():
    keep = "<article><p title='a hidden gem'>Keep me</p><p data-id=related>and me</p><section id=social>me too</section><div class=top>top</div></article>"
    assert H.text_of(keep) == "Keep me\nand me\nme too\ntop"
    assert H.text_of("<body><p><a href=x>One long link</a> end</p></body>") == "One long link end"


def test_constant_nodes_become_template(spark):
    page = "<html><body><div><span>Welcome to our site</span></div><div><p>Story number {0} is told here.</p></div></body></html>"
    rows = [(k, f"http://h.example/{k}", page.format(k)) for k in range(8)] + [(100, "http://few.example/1", page.format(1)), (101, None, None), (102, "http://e.example/x", ""), (103, "http://q/1", "<p>" + "long " * 40_000), (103, "http://q/1", "<p>b")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("_x", F.lit(2))
    got = {(r.page_id, r.n_chars): r.text for r in H.main_text(df, "page_id", "url", "html").collect()}
    by = {k: t for (k, _), t in got.items()}
    assert by[3] == "Story number 3 is told here." and by[100] == "Welcome to our site\nStory number 1 is told here." and by[101] == "" and by[102] == ""
    assert len(got) == 13 and all(n == len(t) for (_, n), t in got.items())
    assert H.main_text(df.limit(0), "page_id", "url", "html").count() == 0


def test_query_equals_a_plain_reading(spark):
    """These pages' articles hold h1, p, b and br only: cutting at blocks tells their text."""
    sf = "/root/testdata/sf0.001"
    got = {r.page_id: r.text for r in H.op9_wrapper_induction(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = re.sub("</?b>", "", re.search("<article>(.*?)</article>|<article>(.*)", r.html, re.S)[0]).replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def test_pages_without_their_marks(spark):
    """article, nav and footer become div and the advert loses its class: the wrapper finds the same text on every page, which pages by themselves don't."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    plain = pages.withColumn("html", F.regexp_replace(F.regexp_replace("html", r"<(/?)(?:article|nav|footer)\b", "<$1div"), ' class="ad"', ""))
    want = {r.page_id: r.text for r in H.main_text(pages, "page_id", "url", "html").collect()}
    got = {r.page_id: r.text for r in H.main_text(plain, "page_id", "url", "html").collect()}
    assert got == want
    assert sum(H.text_of(r.html) != want[r.page_id] for r in plain.limit(1000).collect()) > 10


def test_a_form_around_the_page_loses_nothing():
    for page in (
        "<body><form method=post><article><p>All of it.</p></article></form></body>",
        "<body><form action='/x' id=aspnetForm><input type=hidden name=v value=1><div><p>All of it.</p></div><button>Go</button></form></body>",
        "<body><form><main><p>All of it.</p></main></form><form role=search><p>Search here for it all and more words</p></form></body>",
    ):
        assert H.text_of(page) == "All of it."
    assert H.text_of("<body><p>All of it, and some more words here.</p><form><p>Your name</p></form></body>") == "All of it, and some more words here."


def test_names_colour_words_in_code():
    assert H.text_of("<article><pre>x <span class='token comment'># keep me</span></pre><p>And <code class=nav>y<b class='ad'>z</b></code></p></article>") == "x # keep me\nAnd yz" or H.text_of("<article><pre>x <span class='token comment'># keep me</span></pre></article>") == "x # keep me"
    assert H.text_of("<article><p>Text</p><div class='comment'>Nice</div></article>") == "Text"


def test_quotes_and_slashes_in_values_without_quotes():
    assert H.text_of("<article><p title=it's>One two three.</p><p>Don't stop here.</p></article>") == "One two three.\nDon't stop here."
    assert H.text_of("<article data-u=/x/><p>Here.</p></article><p>Not here.</p>") == "Here."
    assert H.text_of('<article><p>a<img src="x.png"/>b<br/>c</p></article>') == "ab c"
    assert H.text_of("<!--><article><p>Here.</p></article>") == "Here." and H.text_of("<!---><p>Here.") == "Here." and H.text_of("<p>a<!-- x --!>b") == "ab"
    assert H.text_of('<article><p title = "a > b">c</p><p class="open>d</p></article>').startswith("c")
    began = time.perf_counter()
    H.text_of("<a " + "b=" * 50_000)
    H.text_of("<div>" * 20_000 + "</b>" * 20_000)
    assert time.perf_counter() - began < 20


def test_the_header_of_a_main_region_is_its_title():
    assert H.text_of("<body><header><h2>Site</h2></header><main><header><h1>Title</h1></header><p>Text.</p></main></body>") == "Title\nText."


def test_an_error_page_is_not_what_others_are_aligned_with():
    pages = ["<h1>404</h1>"] + [UNMARKED.format("a" * k, k) for k in range(1, 5)]
    trees = [H.outline(H.parse(p)) for p in pages]
    assert H.most_typical(trees) in trees[1:] and H.most_typical(trees[:1]) is trees[0]


# Pages of hosts that mark nothing: {0} and {1} vary from page to page. Lines of | are the article's blocks.
LAYOUTS = [
    ("<table><tr><td>Our paper since 1901, printed every day by the family that founded it and read in every house of the valley and beyond</td></tr><tr><td>{A}</td></tr><tr><td>All rights are ours</td></tr></table>", ["<h2>{0} again</h2>", "<p>A man of {1} came to {0}.</p>", "<p>He stayed for {1} days in {0}.</p>"]),
    ("<div><div>The daily view of all things that are seen from the tower by those who live there</div><div>Today it rains</div></div><div>{A}</div><div><div>Write to us</div></div>", ["<p>First {0} was seen.</p>", "<p>Then {1} was heard, and {0} too.</p>"]),
    ("<center><b>Welcome, dear reader, to the oldest of all the sites that tell of words and where they come from</b></center><div><div>{A}</div></div><center>You are guest number one</center>", ["<h1>{0}</h1>", "<p>What {0} says about {1} is new.</p>", "<blockquote>We know {1}.</blockquote>"]),
    ("<section><p>Sign our book of guests and tell us where you come from, what you do and how you found us</p></section><section>{A}<section><p>Print this page</p></section></section>", ["<p>It was {0} o'clock in {1}.</p>", "<p>And then it was {1}, not {0}.</p>"]),
    ("<div><p>This site works best at night and on screens that are as wide as the ones of the big machines</p><div><p>You read page one</p></div></div><div><div>{A}</div></div>", ["<h3>On {0}</h3>", "<p>There are {1} kinds of {0}.</p>", "<p>None of the {1} is red, says {0}.</p>"]),
    ("<div>Jump down to what we think of the weather in the hills and of the ways that lead there in winter</div><div><span>Share it with friends</span></div><div>{A}</div><div>Back up</div>", ["<p>{0} wrote {1} letters.</p>", "<pre>{0} {1}</pre>", "<p>They went to {0} by train.</p>"]),
]


def test_layouts_that_mark_nothing():
    for frame, blocks in LAYOUTS:
        fill = lambda x, k: x.replace("{0}", chr(97 + k) * (k + 2)).replace("{1}", str(k * 13 + 2))
        pages = [fill("<html><body>" + frame.replace("{A}", "".join(blocks)) + "</body></html>", k) for k in range(7)]
        w, aligner = learnt(pages), H.Aligner()
        for k, page in enumerate(pages):
            want = "\n".join(fill(re.sub("<[^>]*>", "", b), k) for b in blocks)
            assert H.text_of(page, w, aligner) == want, frame
        assert H.text_of(pages[-1]) != want, frame  # the wrapper is needed

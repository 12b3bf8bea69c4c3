"""Main text against the marked article by another parser; hand-made pages;
the linear scan against all runs; defined cases."""

import html
import random
import re
from html.parser import HTMLParser

from civitas.llm import main_text as mt
from civitas.llm import queries
from conftest import SF_SMALL


class Article(HTMLParser):
    """The text of the article element, by block."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside = True
        elif tag == "br":
            self.blocks[-1] += " "
        elif tag in ("p", "h1"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        if tag == "article":
            self.inside = False
        elif tag in ("p", "h1"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += html.unescape(data)

    def handle_entityref(self, name):
        if self.inside:
            self.blocks[-1] += html.unescape(f"&{name};")

    handle_charref = handle_entityref


def brute(page):
    m = re.search(r"(?s)<article.*?</article>", page)
    a = Article()
    a.feed(re.sub(r"&(?!\w+;)", "&amp;", m[0]) if m else "")
    a.close()
    return "\n".join(x for x in (" ".join(b.split()) for b in a.blocks) if x)


def test_query_equals_article(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in queries.op2_main_text(spark, SF_SMALL).collect()}
    assert len(got) == len(rows)
    for r in rows:
        want = brute(r.html)
        fixed = re.sub(r"&(amp|quot)\b(?!;)", lambda m: html.unescape(m[0]), want)
        assert got[r.page_id][1] == fixed, r.page_id
        assert got[r.page_id][0] == r.url and got[r.page_id][2] == len(fixed)


RICH = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body>
<header><h2>Site name here</h2></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
<div class="cookie-notice">We use cookies on this site, please accept them all now</div>
<main><article><h1>Title &amp; more</h1><p>First   paragraph
of words.<div class="ad">Buy this now, it is very very cheap and good</div>
<p>Second &eacute; paragraph, a&nbsp;b.<br>same block<ul><li>one<li>two</ul>
<form><input name=q> Search here <button>Go</button></form><script>x = "<p>no</p>";</script>
<section class="comments"><article class="comment"><p>Nice article, thank you</p></article></section>
</article></main><aside>Related: other things to read today</aside><footer>&copy; all rights</footer>"""


def test_rich_page():
    want = "Title & more\nFirst paragraph of words.\nSecond é paragraph, a b. same block\none\ntwo"
    assert mt.main_text(RICH, {}) == want
    counts = {}
    mt.label_counts(RICH, counts)
    assert mt.main_text(RICH, mt.weights_of(counts)) == want


def test_nested_articles_belong_to_the_main_element():
    page = ("<main><h1>Title here</h1><p>The lead of it</p><article><p>One part of text</p></article>"
            "<article><p>Another part of the text</p></article></main>")
    assert mt.main_text(page, {}) == \
        "Title here\nThe lead of it\nOne part of text\nAnother part of the text"


PROBES = [
    ('<div class="content no-sidebar"><p>one two three</p></div>', "one two three"),
    ('<article class="post comments-open"><p>one two three</p></article>', "one two three"),
    ('<div id="page-with-menu"><main><p>one two three</p></main></div>', "one two three"),
    ('<div id="menu"><article><p>one two</p></article></div>', "one two"),
    ('<article><div class="article-header"><h1>Title</h1></div><p>one two</p></article>', "Title\none two"),
    ('<article><p>one</p><figure><figcaption>cap</figcaption></figure><div class="has-related"><p>two</p></div></article>',
     "one\ncap\ntwo"),
    ('<article><p title="' + "x>" * 5000 + '">one two</p></article>', "one two"),
    ('<article><p data-x=a>b title = "c>d" e=\'>\'>one two</p></article>', 'b title = "c>d" e=\'>\'>one two'),
    # names that do say what a container is
    ('<article><p>one</p><div class="related-posts">x</div><div id=comments>a b c d</div>'
     '<div class="ad-slot top">q</div><div class="newsletterSignup">s</div></article>', "one"),
    ('<article><p>one two</p><div class="article-comments">x y</div></article>', "one two"),
    ('<main><article><p>one two</p></article><article class="comment"><p>so nice</p></article></main>', "one two"),
    ('<body><div class="sidebar-left"><p>' + "w " * 50 + '</p></div><div class="comment-list">' + "c " * 200
     + "</div></body>", ("w " * 50).strip()),
    ('<body><div class="site-header">us</div><div class="x"><p>' + "w " * 50 + "</p></div></body>", ("w " * 50).strip()),
]


def test_names_do_not_outvote_the_page():
    for page, want in PROBES:
        assert mt.main_text(page, {}) == want, page[:80]


def test_whole_names():
    for x in "ad ads sidebar cookie-notice main-nav footer-links relatedPosts related_posts post-comments ad-300x250".split():
        assert mt.is_cue(x), x
    for x in "no-sidebar has-related article-header entry-header comments-open content with-menu thread download".split():
        assert not mt.is_cue(x), x


def test_page_without_article():
    words = " ".join(f"word{i}" for i in range(40))
    page = (f"<body><div class=top><a>x</a> <a>y</a></div><div id=text><p>{words}</p><p>{words}</p></div>"
            "<div class=footer>made by us</div></body>")
    assert mt.main_text(page, {}).split("\n")[-2:] == [words, words]
    assert "made by us" not in mt.main_text(page, {})


def test_scan_equals_all_runs():
    rng = random.Random(2)
    for _ in range(300):
        s = [rng.randint(-5, 4) for _ in range(rng.randrange(1, 14))]
        a, b = mt.best_run(s)
        assert sum(s[a:b]) == max([0] + [sum(s[i:j]) for i in range(len(s)) for j in range(i, len(s) + 1)])


def test_broken_markup_and_size():
    for page in ("", "<", "<p", "a < b", "<!-- x", "<script>x", "</p></p>text", "<p title='a>b'>t</p>",
                 "<article>", "<article><p>x", "<" * 50_000, "<a " * 50_000, "<b>" * 50_000 + "</i>" * 50_000 + "x"):
        mt.main_text(page, {})
    assert mt.main_text("<article>a < b &am &amp", {}) == "a < b &am &"
    assert mt.main_text("<article><p title='a>b'>t</p>", {}) == "t"


def test_operator_cases(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (1, None, "<article>a</article>", "x"),
                                (None, "u", "<article>a</article>", "x")],
                               "page_id long, url string, html string, text string")
    w = mt.fit_weights(df, "page_id", "html")
    got = mt.extract_main_text(df, w).collect()
    assert sorted((r.page_id or 0, r.url or "", r.text) for r in got) == [
        (0, "u", "a"), (1, "", "a"), (1, "u", "")]
    empty = df.where("false")
    assert mt.extract_main_text(empty, mt.fit_weights(empty, "page_id", "html")).count() == 0

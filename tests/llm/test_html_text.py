import html
import re

import pytest

from skein.functions.shared import table
from skein.llm import html_text as h

SF = "/root/testdata/sf0.01"


def plain(source):
    """Blocks between the article's tags, for pages of the test tables' one shape."""
    body = re.search(r"<article>(.*?)(</article>|\Z)", source or "", re.S)
    parts = re.split(r"</?(?:p|h1)>", body[1]) if body else []
    texts = [" ".join(html.unescape(re.sub("<[^>]*>", " " if "<br>" in p else "", p)).split()) for p in parts]
    return "\n".join(t for t in texts if t)


def test_pages_against_plain_cutting(spark):
    pages = {r.page_id: r for r in table(spark, SF, "pages").collect()}
    got = h.op7_html_text(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == plain(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


PAGE = (
    "<html><head><title>T</title><style>p{}</style><script>var x='<p>no</p>'</script></head><body><header>Site</header><ul class='main-menu'><li>Menu</ul><div id='cookie-notice'>We use</div>"
    "<main><article><h1>Head &amp; line</h1><p>One <b>two</b>&nbsp; <i>three</i><p>Four<br>five<!-- no --><aside>side</aside><ul><li>a<li>b &lt;c&gt;</ul><form>form <input value=x></form><div class='ad-slot'><p>Buy</div>"
    "<table><tr><td>1<td>2</table></article><section id=comments><p>A reader wrote a very very very very long comment that is longer than the article itself is, by far.</section></main><footer>F</footer>"
)


@pytest.mark.parametrize(
    "source,want",
    [
        (PAGE, "Head & line\nOne two three\nFour five\na\nb <c>\n1\n2"),
        (None, ""), ("", ""), ("   ", ""), ("plain words", "plain words"), ("<p>a</p><p>b", "a\nb"), ("<article><p>cut &am", "cut &am"), ("<p>a <b", "a"), ("a < b <p>c", "a < b\nc"),
        ("<body><div class=x><p>" + "w " * 300 + "</div>", ("w " * 300).strip()), ("<script>only", ""), ("<nav>n</nav>", ""), ("<div hidden>x</div><div style='display: none'>y</div><p>z", "z"),
        ("<article>" + "<div>" * 3000 + "deep", "deep"), ("<p title='a > b'>t</p>", "t"),
    ],
)
def test_one_page(source, want):
    assert h.extract(source, h.vote(source)[0]) == want


def test_the_host_decides(spark):
    one = "<div class='post-12'><p>article text of the page</p></div><div class='teaser'><p>{}</p></div>"
    data = [(i, f"http://h.org/{i}", one.format("x")) for i in range(5)] + [(9, "http://h.org/9", one.format("a teaser that is longer than the article text of the page and would win alone " * 3)), (10, None, one.format("y")), (11, "http://o.org/", "<p>other")]
    pages = spark.createDataFrame([(*d, "old") for d in data], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in h.extract_text(pages).collect()}
    assert got[9] == got[0] == "article text of the page" and got[11] == "other"


def test_empty_and_repeated(spark):
    schema = "page_id long, url string, html string"
    assert h.extract_text(spark.createDataFrame([], schema)).count() == 0
    rows = h.extract_text(spark.createDataFrame([(1, "http://a/", None)] * 3, schema)).collect()
    assert [(r.text, r.n_chars) for r in rows] == [("", 0)] * 3


@pytest.mark.parametrize(
    "source,want",
    [
        ("<div class='wrapper has-sidebar'><article><h1>T</h1><p>Body of it.</p></article><div class='sidebar'>side</div></div>", "T\nBody of it."),
        ("<div class='site no-sidebar'><main><p>Body of it.</p></main></div>", "Body of it."),
        ("<main class='search-results'><p>Found this.</p></main>", "Found this."),
        ("<p it's>alpha</p><p>beta</p>", "alpha\nbeta"),
        ("<p don't>one isn't two</p><p>three</p>", "one isn't two\nthree"),
        ("<body><header>Site</header><article><header><h1>Title</h1></header><p>text</p><footer>by</footer></article>", "Title\ntext"),
        ("<article><p>the long one of the two</p></article><article><p>short</p></article>", "the long one of the two"),
        ("<body><form id='aspnetForm'><div class='page-header'><h1>Site</h1></div><div><p>" + "text " * 40 + "</p></div></form>", ("text " * 40).strip()),
        ("<div class='content'><p>short article text</p></div><div class='comments'><p>" + "a comment " * 50 + "</p></div>", "short article text"),
        ("<article><h1 class='page-header'>Head</h1><p>a <em class='alert'>kept</em> word <span class='ad-label'>ad <span>x</span> y</span> b</p></article>", "Head\na kept word b"),
        ("<table><tr><td>a</div>b</td><td>c</td></tr></table>", "ab\nc"),
        ("<p a=\"x>y\" b='z'>t</p><p c = \">\">u</p><p d=\"open>v", "t\nu\nv"),
        ("a<!-->b<!--x-->c</ d>e<![CDATA[f]]>g", "abceg"),
        ("<p>one<svg><title>t</title><text>no</text></svg>two", "onetwo"),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", "a\nb\nc"),
    ],
)
def test_one_page_against_the_article(source, want):
    assert h.extract(source, h.vote(source)[0]) == want


def test_deep_and_open_tags_take_linear_time():
    import time

    cases = ["<div>" * 50_000 + "deep", "<b>" * 50_000 + "x" + "</i>" * 50_000, "<span class='ad'>" * 50_000 + "x", "<p><button>" + "<h1>" * 50_000 + "x", "<div class='menu'>" * 50_000 + "x", "<a b='" * 50_000, "<" * 200_000, "<p a=" * 50_000, "<li>" * 50_000 + "x"]
    for source in cases:
        began = time.process_time()
        h.extract(source, h.vote(source)[0])
        assert time.process_time() - began < 10, source[:20]


class Tree:
    """Random blocks with their texts, written as html and as what a plain reader would list."""

    def __init__(self, rng):
        self.rng, self.n, self.texts = rng, 0, [[]]

    def cut(self):
        self.texts.append([])

    def block(self, depth):
        rng, tag = self.rng, self.rng.choice(["div", "section", "p", "h2", "blockquote"] if depth else ["p", "h2"])
        attributes = rng.choice(["", " it's", " class='c1 x'", ' title="a>b"', " data-x=1"])
        self.cut()
        out = f"<{tag}{attributes}>"
        for _ in range(rng.randrange(0, 4)):
            if depth and tag in ("div", "section", "blockquote") and rng.random() < 0.5:
                out += self.block(depth - 1)
            else:
                self.n += 1
                word = rng.choice(["w", "it's", "a=b", '"q"', "x & y"]) + str(self.n)
                self.texts[-1].append(word)
                shown = html.escape(word, quote=rng.random() < 0.5)
                out += rng.choice([" {}\n", "\t<b> {} </b>", " <i class=n>{}</i> ", "<!-- <p> --> {}", "<br>{}<br>"]).format(shown)
        self.cut()
        return out + f"</{tag}>"


def test_random_trees_against_a_plain_reader():
    import random

    for seed in range(300):
        tree = Tree(random.Random(seed))
        source = "<html><body><article>" + "".join(tree.block(3) for _ in range(4)) + "</article></body></html>"
        want = [" ".join(" ".join(t).split()) for t in tree.texts if t]
        got = h.extract(source, h.vote(source)[0]).split("\n") if want else []
        assert [g.replace(" ", "") for g in got] == [w.replace(" ", "") for w in want]


def test_different_texts_outvote_a_repeated_one(spark):
    one = "<div class='story'><p>{}</p></div><div class='box'><p>" + "the same box on every page " * 4 + "</p></div>"
    data = [(i, f"http://h.org/{i}", one.format(f"story {i} " * 60)) for i in range(3)] + [(10 + i, f"http://h.org/{i}", one.format("tiny")) for i in range(5)]
    got = {r.page_id: r.text for r in h.extract_text(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert got[10] == "tiny" and got[0] == ("story 0 " * 60).strip()


_PLAIN = "<p>A paragraph of the article with some plain words in it, long enough to count.</p>"


@pytest.mark.parametrize(
    "opening", ["<section id='related-work'>", "<section id='login'>", "<div id='search-algorithms'>", "<p class='share-price'>", "<div class='code-comment'>", "<div class='reply-to-critics'>", "<section class='alert-rules'>", "<span class='social-history'>"]
)
@pytest.mark.parametrize("around", ["article", "main", "div"])
def test_names_of_what_a_section_is_about_drop_nothing(opening, around):
    tag = opening[1:].split(" ")[0]
    page = f"<body><nav>menu</nav><{around}>{_PLAIN * 4}{opening}kept words</{tag}>{_PLAIN}</{around}><div class='sidebar'>other</div></body>"
    text = h.extract(page, None)
    assert "kept words" in text and "menu" not in text and "other" not in text


@pytest.mark.parametrize("opening", ["<div class='ad'>", "<div class='share-buttons'>", "<div class='ad-slot-3'>", "<div id='comments'>", "<ul class='comment-list'>", "<div class='newsletterSignup'>", "<div class='related-posts'>", "<div role='navigation'>", "<span class='ad'>"])
def test_names_of_parts_count_within_an_article(opening):
    tag = opening[1:].split(" ")[0]
    text = h.extract(f"<article>{_PLAIN * 4}{opening}not this</{tag}>{_PLAIN}</article>", None)
    assert "not this" not in text and text.count("\n") == 4


def test_formulas_and_outputs_are_text():
    text = h.extract(f"<article>{_PLAIN}<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x^2</annotation></math> and <output>42</output> hold.</p></article>", None)
    assert text.endswith("\nLet x=2 and 42 hold.")


def test_a_path_that_leads_to_little_gives_way(spark):
    page = lambda k, long: f"<html><body><div class='content'>{long}</div><div class='story'>{''.join(_PLAIN.replace('A ', f'A {k}{i} ') for i in range(6)) if k == 9 else ''}</div></body></html>"
    rows = [(k, "http://a.b/x", page(k, f"<p>Text {k} of the page.</p>" * 9)) for k in range(5)] + [(9, "http://a.b/y", page(9, "Short intro."))]
    got = {r.page_id: r.text for r in h.extract_text(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got[9].count("\n") >= 5 and "A 95 paragraph" in got[9] and got[3].startswith("Text 3 of the page.")

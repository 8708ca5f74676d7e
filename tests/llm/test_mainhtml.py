"""Main-text extraction on pages of several makes."""

import random
import re

import pytest

from keepsake.llm.mainhtml import Weights, best_region, blocks, extract, extract_all, fit
from tests.conftest import tables

BODY = "<h1>Head &amp; title</h1><p>First  paragraph with\n a <b>bold</b> word and some more of them.<p>Second one, unclosed, long enough to count here.</p>"
PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">x</a></li><li><a href="/y">y</a></li></ul></nav>'
    f'<!-- ad --><div class="ad">Buy this now please, it is cheap.</div><article>{BODY}</article><footer>&copy; host &middot; Some words of a footer that go on.</footer></body></html>'
)
TEXT = "Head & title\nFirst paragraph with a bold word and some more of them.\nSecond one, unclosed, long enough to count here."


@pytest.fixture(scope="module")
def weights(spark):
    return fit(spark.createDataFrame([(i, PAGE) for i in range(5)], "page_id long, html string"))


def test_article(weights):
    assert extract(PAGE, weights) == TEXT
    assert extract(PAGE, Weights()) == TEXT


def test_weights_have_the_signs_of_the_method(weights):
    gains = [weights.gains(b) for b in blocks(PAGE)]
    assert gains and all(words > 0 > tags for words, tags in gains)


@pytest.mark.parametrize("seed", range(50))
def test_the_scan_finds_the_best_of_all_runs(seed):
    r = random.Random(seed)
    gains = [(float(r.randint(1, 9)), -float(r.randint(0, 12))) for _ in range(r.randint(0, 30))]
    total = lambda i, j: sum(w for w, _ in gains[i:j]) + sum(t for _, t in gains[i + 1 : j])
    runs = [(i, j) for i in range(len(gains)) for j in range(i + 1, len(gains) + 1)]
    first, last = best_region(gains)
    assert not gains and first == last == 0 or total(first, last) == max(total(i, j) for i, j in runs)


def neutral(page):
    """The same page without a name that tells what a container holds."""
    return re.sub(r"<(/?)(article|nav|footer)\b", r"<\1div", page).replace(' class="ad"', "")


def test_pages_without_telling_names(spark):
    pages = spark.read.parquet(f"{tables()}/pages.parquet")
    learnt = fit(pages)
    off = 0
    for r in pages.collect():
        text = extract(r.html, learnt)
        assert extract(neutral(r.html), learnt) == text == extract(neutral(r.html), Weights())
        off += "\n".join(b.text for b in blocks(neutral(r.html))) != text
    assert off == pages.count()  # without the scan, menus and footers stay


def test_counts_speak_up_for_a_listed_name(spark):
    page = '<body><nav><a href="/">Home</a></nav><main><div class="social"><p>' + "The text of the page. " * 30 + "</p></div></main></body>"
    assert extract(page, Weights()) != extract(page, fit(spark.createDataFrame([(1, page)], "page_id long, html string")))


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""), ("", ""), ("no tags at all", "no tags at all"), ("<p></p>", ""), ("<p>a<br>b &lt;c&gt; &eacute;&#233;</p>", "a\nb <c> éé"), ("<p>never closed", "never closed"), ("< p>x", "< p>x"),
        ("<p>x</p><script>if (a<b) { y }", "x"), ("<div hidden class='sidebar'>menu words</div><p>real text of a page here</p>", "real text of a page here"),
        ("<body><div id='main'><p>real words of text that matter a lot</p><form><label>Name</label></form><p>and a second paragraph of such text</p></div><section class='comments'><p>Great post indeed</p></section>", "real words of text that matter a lot\nand a second paragraph of such text"),
        ("<article><header><h1>Own head</h1></header><p>Body text goes here and on.</p><aside>side words</aside><ul><li>one item<li>two items</ul></article>", "Own head\nBody text goes here and on.\none item\ntwo items"),
    ],
)
def test_cases(weights, html, text):
    assert extract(html, weights) == text


def test_very_long_and_deep(weights):
    deep = "<div>" * 3000 + "<p>word</p>" + "</div>" * 3000
    assert extract(deep, weights) == "word"
    long = "<article>" + "<p>some words here</p>" * 20_000 + "</article>"
    assert extract(long, weights).count("\n") == 19_999
    assert extract("<" * 2000, weights) == "<" * 2000


def test_table(spark, weights):
    df = spark.createDataFrame([(1, "u", PAGE, "x", 5), (2, "v", None, "y", 6), (1, "u", PAGE, "x", 5)], "page_id long, url string, html string, text string, N_chars int")
    got = extract_all(df, weights)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id, r.n_chars, r.text) for r in got.collect()) == [(1, len(TEXT), TEXT), (1, len(TEXT), TEXT), (2, 0, "")]
    assert extract_all(df.limit(0), weights).collect() == []


@pytest.mark.parametrize(
    "html, text",
    [
        ('<article><h2 id="related-work">Related work</h2><p>Words of it.</p></article>', "Related work\nWords of it."),
        ('<h2 id="search">Search</h2><p>Words of it that go on.</p>', "Search\nWords of it that go on."),
        ('<main><section id="search-results"><p>What was found here.</p></section><div id="social-policy"><p>What was decided.</p></div></main>', "What was found here.\nWhat was decided."),
        ('<article><p>' + "Body of it. " * 40 + '</p><div class="share box"><p>Share it</p></div><div id="comments"><p>Nice</p></div><p>' + "More of it. " * 40 + "</p></article>", ("Body of it. " * 40).strip() + "\n" + ("More of it. " * 40).strip()),
        ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be given.</p></article>", "Let x=2 be given."),
        ('<article><p>Before it.</p><svg width="1" title="a>b"/><p>After it.</p><math/><p>And the end.</p></article>', "Before it.\nAfter it.\nAnd the end."),
        ("<article><p>Before it.</p><svg><text>drawn</text></svg><p>After it.</p></article>", "Before it.\nAfter it."),
    ],
)
def test_article_text_stays(weights, html, text):
    assert extract(html, weights) == text

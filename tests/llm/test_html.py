import html
import re

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from layerscan.llm import html_text
from tests.llm import samples

BODY = "Long text here, with words. And then more of it, as prose goes."
CASES = [
    ("", ""),
    ("plain text only", "plain text only"),
    ("<p>1 < 2 and 3<p", "1 < 2 and 3"),
    (f"<title>t</title><nav>a b</nav><div id=content><p>{BODY}</p><p>{BODY}</p></div>"
     "<div class='sidebar'>Links</div><div id='comments'><p>I like it, very much.</p></div>"
     "<form>Name <input></form>", f"{BODY} {BODY}"),
    ("<main><h1>T</h1><p>a<b>b</b>c &amp; d&nbsp;e<br>f<p>g<ul><li>x<li>y</ul>"
     "<span class=ad>buy</span> z</main><footer>q</footer>", "T abc & d e f g x y z"),
    ("<article><p>x</p><section class='user-comments'><p>no</p></section></article><p>out</p>", "x"),
    (f"<header>Site</header><article><header><h1>Head</h1></header><p>{BODY}</p></article>"
     "<aside>more</aside><div class='cookie-notice'>We use cookies, really.</div>", f"Head {BODY}"),
    ("<article><p>a<script>if (1 < 2) x = '</p>'</script>b</p><style>p{}</style></article>", "ab"),
    ("<article><table><tr><td>1<td>2<tr><td>3</table></article>", "1 2 3"),
    ("<article><p>a<!-- no -- > no -->b &lt;c&gt; &#x41;&eacute;</p></article>", "ab <c> Aé"),
    ("<nav>a</nav><footer>b</footer>", ""),
    ("<article><p>seen<p hidden>no<p style='display: none'>no<p aria-hidden=true>no</article>", "seen"),
]


@pytest.mark.parametrize("source, text", CASES)
def test_cases(source, text):
    assert html_text.extract(source) == text


PARTS = st.sampled_from(
    ["<p>", "</p>", "<div class='a'>", "</div>", "<b>", "</b>", "<", ">", "'", '"', "<!--", "-->",
     "<script>", "</script>", "<article>", "</article>", "<li>", "<td", "&amp", "&#xD800;", "word ",
     "<br/>", "<a href=\"x", "\x00", "<nav>", "</nav>", "é"]
)


@settings(max_examples=500, deadline=None)
@given(st.lists(PARTS, max_size=40).map("".join))
def test_any_input_gives_clean_text(source):
    text = html_text.extract(source)
    assert text == " ".join(text.split())


def test_long_and_deep_pages_take_linear_time():
    assert html_text.extract("<article>" + "<b>" * 50_000 + "x" * 500_000) == "x" * 500_000
    assert len(html_text.extract("<p>a<b>" * 20_000)) == 39_999
    assert html_text.extract("<a '" * 20_000) == ""


def test_articles_of_the_sample_pages(spark):
    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet")
    for source in pages["html"]:
        article = re.search(r"<article>(.*?)(</article>|$)", source, re.S)[1]
        text = html.unescape(re.sub(r"<[^>]*>|<[^>]*$", " ", article))
        assert html_text.extract(source) == " ".join(text.split())


def test_odd_pages(spark):
    rows = [(1, None, None), (None, "u", ""), (2, "u", "<p>x"), (2, "u", "<p>x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = html_text.extract_pages(pages.selectExpr("*", "'taken' AS text", "1 AS ids"))
    assert [r["text"] for r in found.collect()] == ["", "", "x", "x"]
    assert found.columns == ["page_id", "url", "text", "ids"]
    assert html_text.extract_pages(pages.filter("false")).count() == 0
    assert samples.TAKEN


PROSE = "Prose of some length, as it is found in the main part of a page; it goes on, and on. " * 4
PROSE = PROSE.strip()
ITEMS = [f"short item number {n}" for n in range(20)]
LIST = "<ul>" + "".join(f"<li>{i}" for i in ITEMS) + "</ul>"
CARDS = "<article><a href='x'><h2>Card title</h2><p>A teaser, short.</p></a></article>" * 4
WHOLE = [
    # A word of a class or id doesn't lose prose.
    (f"<div class='has-sidebar'><article><p>{PROSE}</article></div>", PROSE),
    (f"<div class='sidebar-left'><main><p>{PROSE}</main></div><div class=sidebar>Links</div>", PROSE),
    (f"<article class='hentry comments-open'><p>{PROSE}</article>", PROSE),
    (f"<article><p>{PROSE}<div class='overflow-hidden'><p>part</div><p>{PROSE}</article>",
     f"{PROSE} part {PROSE}"),
    (f"<article><p>{PROSE}<div class='card-form'><p>{PROSE}</div></article>", f"{PROSE} {PROSE}"),
    (f"<div class='col side'><p>{PROSE}</div>", PROSE),
    (f"<div id=footer-fixed><p>{PROSE}<p>{PROSE}</div><div>by us</div>", f"{PROSE} {PROSE}"),
    (f"<form><main><p>{PROSE}</main></form>", PROSE),
    # Nor do values of other attributes.
    (f"<article title='hidden gems'><p data-title='The hidden cost of rain' data-class=ad>{PROSE}"
     "</article>", PROSE),
    ("<article><p>seen<p title='a' hidden>no<p HIDDEN=''>no</article>", "seen"),
    # What is marked and has little text, or is a comment, still goes.
    (f"<article><p>{PROSE}<div class='social'>Tell others</div></article>", PROSE),
    (f"<article><p>{PROSE}</article><div id=comments><article><p>{PROSE}</article></div>", PROSE),
    # Cards in article elements are not the main text.
    (f"{CARDS}<div><p>{PROSE}<p>{PROSE}</div>", f"{PROSE} {PROSE}"),
    # Short blocks stay beside long ones.
    (f"<article><p>{PROSE}<ul>{'<li>' + 'i' * 60}</ul>" + f"<p>{PROSE}<pre>{'code; ' * 17_000}</pre></article>",
     f"{PROSE} {'i' * 60} {PROSE} {('code; ' * 17_000).strip()}"),
    (f"<div><p>{PROSE}{LIST}<p>{PROSE}</div>", " ".join([PROSE, *ITEMS, PROSE])),
    (f"<div><p>{PROSE}<pre>{'code; ' * 17_000}</pre><ol><li>a<li>b<li>c</ol><p>{PROSE}</div>",
     f"{PROSE} {('code; ' * 17_000).strip()} a b c {PROSE}"),
]


@pytest.mark.parametrize("source, text", WHOLE)
def test_whole_main_text(source, text):
    assert html_text.extract(source) == text


PROSE = "<p>" + "A long sentence, with a comma and a stop; then some more words follow here. " * 4 + "</p>"
LINKS = "<div><a href=a>Related story one</a></div><div><a href=b>Another story, two</a></div>"


def test_boxes_of_links_go_from_an_article_and_short_paragraphs_stay(monkeypatch):
    page = f"<body><article><h1>Head</h1>{PROSE}<p>Short.</p>{LINKS}{PROSE}<ul><li>item</li></ul><p><a href=c>linked</a></p></article></body>"
    text = html_text.extract(page)
    assert "story" not in text
    assert text.startswith("Head A long") and " Short. A long" in text and text.endswith("item linked")
    # It is the ratios that tell: with the same one for all paths the boxes stay.
    monkeypatch.setattr(html_text, "_ratios", lambda blocks: ([1.0] * len(blocks), [False] * len(blocks)))
    assert "Related story one" in html_text.extract(page)


def test_an_article_around_teasers_does_not_win_over_prose_beside_it(monkeypatch):
    cards = "".join(f"<article><h2><a href=x{i}>Teaser card number {i}</a></h2></article>" for i in range(5))
    page = f"<body>{cards}<div>{PROSE * 3}</div></body>"
    assert "Teaser" not in html_text.extract(page) and html_text.extract(page).startswith("A long sentence")


def test_query_types(spark):
    from layerscan.llm import queries

    found = queries.op9_html(spark, "/root/testdata/sf0.001")
    assert dict(found.dtypes) == {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}
    assert found.filter("n_chars <> char_length(text)").count() == 0 < found.count()

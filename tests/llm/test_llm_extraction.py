"""Main text: small pages with every kind of surrounding, and all pages of a table against their known article."""

import html
import re

import pytest

from tablewright.llm.extraction import Page, extract, main_text

CASES = {
    "": "",
    "no tags  at &amp; all": "no tags at & all",
    "<p>one<p>two &lt;b&gt;": "one\ntwo <b>",
    "<article><h1>Title</h1><p>Only one   paragraph\n here.</p></article>": "Title\nOnly one paragraph here.",
    "<div id=cookie-notice><p>Accept all of it, please, now.</p></div><main><header><h1>T</h1></header><p>Body one is here."
    "<p>two <a href=x>link</a>.<ul><li>a<li>b</ul><section class=comments><p>a reader says a lot here</section></main><aside>x</aside>":
        "T\nBody one is here.\ntwo link.\na\nb",
    "<html><body><div class='site-header'>Head</div><div class=content><h2>Title</h2><p>Long text here and more text and more."
    "</p><div class='advert'>Buy</div><p>Second</p><form><input><button>Go</button></form></div><div class=sidebar><p>side text "
    "is long and dense and has many many characters in it</p></div></body>": "Title\nLong text here and more text and more.\nSecond",
    "<script>var a='<p>x</p>'</script><style>p{}</style><p>t<!-- no --><br>u": "t u",
    "<article><p>cut off in the mid": "cut off in the mid",
    "<p title='a>b'>q</p>": "q",
    "<article><p>a</p><footer>f</footer><div hidden>h</div><div style='display: none'>n</div><p role=alert>r</p></article>": "a",
    "<table><tr><td>a<td>b<tr><td>c</table>": "a\nb\nc",
    "<nav>only a menu</nav>": "",
    "<article><p>x<b>y</i> z</b></p></article></div></p>": "xy z",
}


@pytest.mark.parametrize("page", CASES)
def test_cases(page):
    assert main_text(page) == CASES[page]


def paragraphs(number, length):
    return "".join(f"<p>{('lorem ipsu' * 99)[:length]}</p>" for _ in range(number))


def test_dense_neighbours_without_article_or_main():
    heart, lead = f"<div>{paragraphs(20, 100)}</div>", "L" * 300
    assert main_text(f"<body><h1>T</h1><p>{lead}</p>{heart}</body>").split("\n")[:2] == ["T", lead]
    rest = ["P" * 400, "Q" * 300, "R" * 400, "S" * 400, "T" * 500]
    page = "<body>{}<pre>{}</pre><blockquote>{}</blockquote><ul><li>{}<li>{}</ul><table><tr><td>{}</table></body>"
    assert main_text(page.format(heart, *rest)).split("\n")[20:] == rest
    wrapped = f"<body>{heart}<h2>B</h2><div><div>{paragraphs(20, 100)}</div></div></body>"
    assert main_text(wrapped).count("lorem") == main_text(heart).count("lorem") * 2 and "\nB\n" in main_text(wrapped)
    links = "<div>" + "<a href=x>somewhere else</a>" * 20 + "</div>"
    nested = f"<body>{heart}<div>{links}<div><h3>N</h3>{paragraphs(20, 120)}</div></div></body>"
    assert "\nN\n" in main_text(nested) and "somewhere" not in main_text(nested)
    alone = f"<body><h3>Links</h3>{links}{heart}<h2>More</h2>{links}<p>(c) 2020</p></body>"
    assert main_text(alone) == main_text(heart)


def test_densities_by_hand():
    page = Page("<div><p>abcde</p><p>fgh<a>ij</a></p></div>")
    density, sums = page.densities()
    names = dict(zip(["body", "div", "p1", "p2", "a"], density))
    assert names["p1"] > names["p2"] > 0 and names["a"] == 0
    assert sums[1] == pytest.approx(names["p1"] + names["p2"])


def test_deep_and_long_pages():
    assert main_text("<div>" * 3_000 + "<p>deep</p>") == "deep"
    assert main_text("<article>" + "<p>word word</p>" * 3_000 + "</article>").count("\n") == 2_999
    assert main_text("<" * 20_000 + " x").endswith(" x")
    assert main_text("<b>" * 50_000 + "x" + "</i>" * 50_000) == "x"


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>é😀</p>", "own"), (1, "u", "<p>é😀</p>", "own"), (2, None, None, "own"), (None, "v", "", None)],
                               "page_id bigint, url string, html string, text string")
    found = extract(df)
    assert found.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(
        [(1, "u", "é😀", 2), (1, "u", "é😀", 2), (2, None, "", 0), (None, "v", "", 0)], key=repr)
    assert extract(df.limit(0)).collect() == []


def test_all_pages_of_a_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r["page_id"]: r["text"] for r in extract(pages).collect()}
    for row in pages.collect():
        article = re.search("<article>(.*)</article>", row["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("</?b>|<br>", " ", part)).split()) for part in re.split("</?(?:h1|p)>", article)]
        assert found[row["page_id"]] == "\n".join(b for b in blocks if b)


FIVE = paragraphs(5, 200)
NAMES = ["no-sidebar", "has-sidebar content", "content with-comments", "post-header-image article", "notice-board", "social-studies",
         "side-by-side", "skip-nav content", "share-price article-body", "story banner", "hidden-gems", "content", "widget", "comments"]


@pytest.mark.parametrize("name", NAMES)
def test_a_name_is_a_hint_no_verdict(name):
    page = f'<body><nav><a href=x>menu</a></nav><div class="{name}">{FIVE}</div><div class=footer>All rights are ours</div></body>'
    assert main_text(page) == main_text(f"<article>{FIVE}</article>")


def test_forms_around_text_and_beside_it():
    assert main_text(f"<form action=x><div>{FIVE}</div><input><button>Send</button></form>") == main_text(f"<article>{FIVE}</article>")
    assert main_text(f"<div>{FIVE}</div><form>Search this site <input></form>") == main_text(f"<article>{FIVE}</article>")


def test_what_surrounds_a_short_article_goes():
    short = "<article><h1>T</h1><p>A short article.</p></article>"
    for name in ("comments", "comment-list", "cookie-notice", "site-footer", "newsletter-box", "related-posts"):
        assert main_text(f'{short}<div class="{name}">{FIVE}</div>') == "T\nA short article."
    assert main_text(f'<div><h1>T</h1>{FIVE}</div><div id="comments">{FIVE * 3}</div>') == main_text(f"<article><h1>T</h1>{FIVE}</article>")


def test_short_leads_and_further_articles():
    page = f"<h1>T</h1><p>A short lead, of few words.</p><div>{FIVE}</div><p>(c) 2020 by someone, all rights</p>"
    assert main_text(page) == "T\nA short lead, of few words.\n" + main_text(f"<article>{FIVE}</article>")
    assert main_text(f"<article><h1>T</h1>{FIVE}</article><article><h2>U</h2><p>tiny</p></article>").endswith("\nU\ntiny")
    assert not main_text(f"<article><h1>T</h1>{FIVE}</article><article><a href=x>More on this</a></article>").endswith("this")


@pytest.mark.parametrize("name", ["no-sidebar", "post-header-image article", "story banner", "entry", None])
def test_all_pages_without_an_article_element(spark, name):
    for row in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        opening, closing = (f'<div class="{name}">', "</div>") if name else ("<form><div>", "</div></form>")
        assert main_text(row["html"].replace("<article>", opening).replace("</article>", closing)) == main_text(row["html"])

import time

import random
from html.parser import HTMLParser

import pytest

from tablespec.llm import html_text as H

CASES = [
    ("<p>One <b>two</b>\n three<p>four<br>five", "One two three\n\nfour\nfive"),
    ("<title>no</title><style>p{}</style><script>var t='</p>';</script><body>yes<!-- no --><div hidden>no</div><div style='display: none'>no</div><span style=\"visibility:hidden\">no</span> &amp; &eacute;", "yes & é"),
    ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>after", "- a\n- b\n  3. c\n  4. d\n\nafter"),
    ("<table><tr><th>Name<th>Size<tr><td>x<td>100<tr><td colspan=2>wide cell<tr><td>longer name<td>1</table>", "Name         Size\nx            100\nwide cell\nlonger name  1"),
    ("<pre>\n a  b\n\n  c</pre>end", " a  b\n\n  c\n\nend"),
    ("<h1>T</h1><dl><dt>k<dd>v</dl><blockquote>q</blockquote>", "T\n\nk\n  v\n\n  q"),
    ("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>", "s\nt\nyes"),
    ("<table><tr><td>a<table><tr><td>in<td>ner</table></td><td>b</table>", "a        b\n\nin  ner"),
    ("a < b <i>c</i> <unclosed attr='x", "a < b c"),
    ("", ""), (None, ""), ("plain", "plain"), ("</p></div></b>x", "x"), ("<li>a<li>b", "- a\n- b"),
]


@pytest.mark.parametrize("page, want", CASES)
def test_layout(page, want):
    assert H.render(page) == want


class Plain(HTMLParser):
    """All text outside unseen elements, word by word."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.words, self.unseen = 0, [], {"script", "style", "title", "template", "head"}

    def handle_starttag(self, tag, attrs):
        if tag in self.unseen:
            self.depth += 1

    def handle_endtag(self, tag):
        if tag in self.unseen:
            self.depth -= 1

    def handle_data(self, data):
        if not self.depth:
            self.words += data.split()


QUOTES = [
    ("<a title=John's>shown text that isn't hidden</a>", "shown text that isn't hidden"), ("<a title=John's>shown</a>", "shown"),
    ("<p title=John's hidden>no</p>it's", "it's"), ('<a href=x?q="1>shown</a> "end"', 'shown "end"'), ("<a b=\"x\"'>shown</a> it's", "shown it's"),
    ("<div title=\"a>b\" hidden>no</div>yes", "yes"), ("<div title = 'a>\"b' hidden>no</div>yes", "yes"), ("<b =\"x>y</b> \"z\"", 'y "z"'), ("<a href=/y/>x</a>", "x"),
]


@pytest.mark.parametrize("page, want", QUOTES)
def test_quotes_open_strings_only_where_a_value_begins(page, want):
    assert H.render(page) == want


def test_long_tag_without_an_end():
    assert H.render("x <a " + "b " * 20000 + "='" * 2000) == "x"


def random_page(r, depth=0):
    out = []
    for _ in range(r.randint(1, 4)):
        pick = r.choice(["text", "text", "p", "div", "b", "ul", "table", "section", "span", "script", "h2"] if depth < 4 else ["text"])
        word = " ".join(r.choice(["one", "two", "&lt;x", "caf&eacute;", "3"]) for _ in range(r.randint(1, 4)))
        if pick == "text":
            out.append(f" {word} ")
        elif pick == "script":
            out.append("<script>if (a<b) x</script>")
        elif pick == "ul":
            out.append("<ul>" + "".join(f"<li>{random_page(r, depth + 1)}</li>" for _ in range(2)) + "</ul>")
        elif pick == "table":
            out.append("<table>" + "".join(f"<tr><td>{word}</td><td>{word}</td></tr>" for _ in range(2)) + "</table>")
        else:
            inner = random_page(r, depth + 1) if pick not in ("p", "h2") else word
            out.append(f"<{pick}>{inner}</{pick}>")
    return "".join(out)


def test_no_visible_word_is_lost():
    for seed in range(300):
        page = f"<html><head><title>t</title></head><body>{random_page(random.Random(seed))}</body></html>"
        plain = Plain()
        plain.feed(page)
        got = [w for w in H.render(page).split() if w != "-"]
        assert got == plain.words, page


def test_deep_and_long_pages():
    assert H.render("<div>" * 20000 + "x") == "x"
    assert len(H.render("<p>word</p>" * 50000).split()) == 50000


def test_rows(spark):
    rows = [(1, None, "a"), (1, "", "b"), (None, "<p>x", "c"), (2, "<p>x", "d"), (2, "<p>x", "d")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    assert sorted(map(repr, H.extract_text(df).collect())) == sorted(map(repr, spark.createDataFrame([(r[0], H.render(r[1])) for r in rows], "page_id long, text string").collect()))
    assert H.extract_text(df.limit(0)).count() == 0


def test_query_keeps_every_word(spark):
    for r in H.op7_html_extraction(spark, "/root/testdata/sf0.001").join(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"), "page_id").collect():
        plain = Plain()
        plain.feed(r.html)
        assert [w for w in r.text.split() if w != "-"] == plain.words


@pytest.mark.parametrize("page, want", [
    ("<table><tr><td rowspan=2>A<td>B<tr><td>C</table>", "A  B\n   C"),
    ("<table><tr><td>a<td>b<td>c<tr><td rowspan=2 colspan=2>wide<td>d<tr><td>e</table>", "a  b  c\nwide  d\n      e"),
    ("<table><tr><td>1<td rowspan=3>2<tr><td>3<tr><td>4<tr><td>5<td>6</table>", "1  2\n3\n4\n5  6"),
])
def test_row_spans(page, want):
    assert H.render(page) == want


@pytest.mark.parametrize("unit", ["<a ", "<a x=\"", "<!-", "< ", "</", "<td rowspan=99 colspan=99>", "<ul><li>x", "<blockquote>q", "<table><tr><td>x", "<tr><td colspan=999>a<td>b", "<b>"])
def test_broken_and_deep_pages_stay_linear(unit):
    page = unit * (200_000 // len(unit))
    began = time.process_time()
    got = H.render(page)
    assert time.process_time() - began < 6 and len(got) < 100 * len(page)


def test_a_wide_cell_does_not_multiply():
    page = "<table>" + "<tr><td>" + "w" * 20_000 + "<td>x" + "<tr><td>a<td>b" * 1000
    assert len(H.render(page)) < 20_000 + 1000 * 500

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from estima.llm.html_text import build_tree, render, render_pages
from estima.llm.queries import op6_html_text

CASES = [
    (None, ""), ("", ""), ("plain  text\n here", "plain text here"),
    ("<p>one<p>two", "one\n\ntwo"), ("a<br>b<br/>c", "a\nb\nc"), ("a<br><br>b", "a\n\nb"),
    ("<div>a</div><div>b</div>", "a\nb"), ("<div><div>a</div></div>b", "a\nb"),
    ("<b>bo</b>ld <i> and</i> it", "bold and it"), ("x<span> y</span>z", "x yz"),
    ("<h1>T</h1>text<ul><li>a<li>b</ul>after", "T\n\ntext\n\n- a\n- b\n\nafter"),
    ("<ol start=3><li>c<li value=7>g<li>h</ol>", "3. c\n7. g\n8. h"),
    ("<ul><li>a<ul><li>b</ul><li>c</ul>", "- a\n  - b\n- c"),
    ("<dl><dt>T<dd>D1<dd>D2</dl>", "T\n  D1\n  D2"),
    ("<blockquote>q<br>r</blockquote>", "  q\n  r"),
    ("<pre>\n a\n\n  b</pre>", " a\n\n  b"), ("<textarea> a <b> </textarea>x", " a <b> x"),
    ("<table><tr><th>Name<th>Qty<tr><td>fig<td>3<tr><td>pear pear<td>12</table>", "Name       Qty\nfig        3\npear pear  12"),
    ("<table><tr><td colspan=2>wide one<tr><td>a<td>b</table>", "wide one\na  b"),
    ("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>", "r  1\n   2"),
    ("<table><tr><td>a<table><tr><td>in<td>ner</table><td>b</table>", "a        b\n\nin  ner"),
    ("<table><tr><td>中文<td>x<tr><td>a<td>y</table>", "中文  x\na     y"),
    ("<td>stray</td> cell", "stray cell"),
    ("<head><title>no</title><style>p{}</style></head><body>yes<script>no</script>", "yes"),
    ("<p hidden>no<p>yes<div style='display: none'>no</div><div style='visibility:hidden'>no<b style='visibility:visible'>but</b></div>", "yes\n\nbut"),
    ("<style>.x, #y{display:none} i.z{visibility:hidden}</style><p class='a x'>no</p><p id=y>no</p><i class=z>no</i><b class=z>yes</b>", "yes"),
    ("<details><summary>S</summary>no</details><details open><summary>S</summary>yes</details>", "S\nS\nyes"),
    ("<template>no</template><noscript>no</noscript><dialog>no</dialog><input type=submit value=Go><input type=hidden value=no>", "Go"),
    ("a &amp; b &lt; c &nbsp;d &#233;", "a & b < c \xa0d é"), ("1 < 2 <3", "1 < 2 <3"), ("a<!-- no -->b<!x>c<?y?>d", "abcd"),
    ("<a href='x>y'>l</a><a href=\"q\">m", "lm"), ("x</p>y</b>z", "xyz"), ("<p><b>a<p>b</b>c", "a\n\nbc"), ("<select><option>a<option>b</select>", "a\nb"),
    ("a<hr>b", "a\n\nb"), ("<script>if (a</b) '</script>'</script>t", "'t"), ("<title>x</title>", ""), ("<p>unclosed <a href=\"", "unclosed"),
]


@pytest.mark.parametrize("source, want", CASES)
def test_rendering(source, want):
    assert render(source) == want


@pytest.mark.parametrize("source, want", [
    ("a <math><mi>x</mi><mo>=</mo><mn>1</mn></math> b", "a x=1 b"),
    ("<math><semantics><mi>y</mi><annotation encoding='TeX'>no</annotation></semantics><mphantom><mi>no</mi></mphantom></math>z", "yz"),
    ("<math><mtable><mtr><mtd>1</mtd><mtd>2</mtd></mtr><mtr><mtd>3</mtd></mtr></mtable></math>", "1 2\n3"),
    ("<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><path d='M0'/><text>one <tspan>more</tspan></text><text>two</text></svg>after", "one more\ntwo\nafter"),
    ("<svg><defs/><title/><text>yes</text><foreignObject><p>html<p>too</foreignObject></svg>", "yes\n\nhtml\n\ntoo"),
    ("<svg><metadata>no</metadata><style>.q{display:none}</style><text class=q>no</text><text>t</text></svg>", "t"),
    ("<svg><defs><div>out</div> of it", "out\nof it"), ("<svg/>a<desc>b</desc>", "ab"),
])
def test_formulas_and_drawings(source, want):
    assert render(source) == want


def test_long_selector_lists():
    many = ", ".join(f".c{i:05}" for i in range(2000))
    assert render(f"<style>{many} {{display:none}}</style><p class=c00000>no</p><p class=c01999>no</p>yes") == "yes"
    assert render("<style>" + "x" * 400_000 + "</style><style>@media all{.a{display:none}} .b{display:none}</style><p class=a>no</p><p class=b>no</p>yes") == "yes"


@pytest.mark.parametrize("rules, body, want", [
    ("@media print{.x{display:none}}", "<p class=x>on screen", "on screen"),
    ("@media screen and (min-width: 40em){.x{display:none}} @media (max-width:600px){.y{display:none}}", "<p class=x>no<p class=y>wide", "wide"),
    ("@media print, screen{.x{display:none}} @media not print{.y{display:none}}", "<p class=x>no<p class=y>no<p>yes", "yes"),
    ("@import 'a.css'; @font-face{src:url(x)} @keyframes k{from{display:none}} @supports (display:grid){.x{display:none}} from{display:none}", "<p class=x>no<p>yes", "yes"),
    (".zh{display:none} .as{display:block}", "<p class='zh as'>later rule", "later rule"),
    (".as{display:block} .zh{display:none}", "<p class='zh as'>no<p>yes", "yes"),
    ("#i{display:block} .x.y{display:none}", "<p id=i class='x y'>stronger", "stronger"),
    (".x{display:none!important} #i{display:block}", "<p id=i class=x style='display:block'>no<p>yes", "yes"),
    (".x{display:none!important}", "<p class=x style='display:block !important'>yes", "yes"),
    ("/* c */.x{display:none} /* .y{} */ .y /* d */ {display:/**/none}", "<p class=x>no<p class=y>no<p>yes", "yes"),
    (".a .b{display:none} .a > .c{display:none} .d + p{display:none} .d ~ i{display:none}", "<div class=a><div><b class=b>no</b><b class=c>one</b></div><b class=c>no</b></div><div class=d>two</div><p>no</p><p>three</p><i>no</i>", "one\ntwo\n\nthree"),
    (".a > .b .c{display:none}", "<div class=a><div class=b><div class=b><i class=c>no</i></div></div></div><div class=b><i class=c>yes</i></div>", "yes"),
    ("[hidden-x], a[href^='x']{display:none} p:not(.k){display:none} li:nth-child(2n+1){display:none}", "<p hidden-x class=k>no<p>no<p class=k>yes <a href=xy>no</a><a href=yx>link</a><ul><li>no<li>two<li>no</ul>", "yes link\n\n- two"),
    (".md\\:gone{display:none} .x:hover{display:none} .x::before{display:none} .x{display:nonsense}", "<p class='md:gone'>no<p class=x>yes", "yes"),
    ("<!-- .x{display:none} --> .y{content:'}.z{display:none}'; display:none", "<p class=x>no<p class=y>no<p class=z>yes", "yes"),
    ("x,,y{display:none} {display:none} }.q{display:none}", "<p>yes<p class=q>no", "yes"),
    ("body.dark p{display:none}", "<body class=dark><p>no</p>yes", "yes"),
])
def test_cascade(rules, body, want):
    assert render(f"<style>{rules}</style>{body}") == want


def test_sheets_for_other_media_and_of_other_types():
    assert render("<style media=print>.x{display:none}</style><style type='text/less'>.x{display:none}</style><p class=x>yes") == "yes"


def test_spans_end_with_their_group():
    assert render("<table><tbody><tr><td rowspan=0>r<td>1<tr><td>2<tr><td>3<tbody><tr><td>a<td>b</table>") == "r  1\n   2\n   3\na  b"
    assert render("<table><tr><td rowspan=2000>r<td>0" + "".join(f"<tr><td>{i}" for i in range(1, 1999)) + "</table>").split("\n")[1500] == "   1500"


def test_rules_over_deep_and_wide_pages():
    rules = "<style>" + "".join(f".a .b{i} > .c{{display:none}}" for i in range(300)) + ".a i{display:none}</style>"
    assert render(rules + "<div class=a>" * 20_000 + "<i>no</i>deep") == "deep"
    assert render(rules + "<p class=b1>x</p>" * 20_000).count("x") == 20_000


PAGE = """<!DOCTYPE html><html lang=en class=js><head><title>Fig prices</title><style>
/* theme */ .nav li.sub, .sr-only {display: none} @media print {.story {display: none}}
.promo {display: none} .story .promo {display: block}
</style><script>var a = "<p>no</p>";</script></head><body>
<div class=nav><ul><li>Home<li class=sub>Hidden<li>News</ul></div>
<div class=story><h1>Fig  prices &amp; more</h1><p>Figs cost <b>3&nbsp;euro</b> a kilo.<br>Pears don't.
<div class=promo>Buy two.</div>
<ol start=2><li>Wash<li>Peel<ul><li>thinly</ul></ol>
<table><thead><tr><th>Fruit<th>Price<th>Stock</thead><tbody><tr><td rowspan=2>Fig<td>3<td>yes<tr><td>4<td>no</tbody></table>
<pre>
  a = 1
    b</pre></div><div class=sr-only>Skip</div><div class=promo>No</div><footer>End</footer></body></html>"""
LAID_OUT = """- Home
- News

Fig prices & more

Figs cost 3\xa0euro a kilo.
Pears don't.

Buy two.

2. Wash
3. Peel
   - thinly

Fruit  Price  Stock
Fig    3      yes
       4      no

  a = 1
    b

End"""


def test_a_whole_page():
    assert render(PAGE) == LAID_OUT


def test_implied_parts_of_tables():
    root, _ = build_tree("<table><td>a")
    table = root.children[0]
    assert [table.tag, table.children[0].tag, table.children[0].children[0].tag, table.children[0].children[0].children[0].tag] == ["table", "tbody", "tr", "td"]


@pytest.mark.parametrize("source", ["<div>" * 60_000 + "deep", "<ul><li>" * 4000 + "x", "<b>" * 60_000 + "t", "<table><tr><td>" * 1500 + "y", "<p>" * 50_000 + "z", "<a \"" * 20_000 + ">w", "<" * 100_000, "&" * 100_000, "<p>" + "word " * 300_000])
def test_depth_and_length_do_not_matter(source):
    out = render(source)
    assert out.rstrip()[-1:] == source.rstrip()[-1:] or "w" in out


tags = st.sampled_from(["p", "div", "ul", "li", "table", "tr", "td", "b", "span", "h2", "pre", "section", "em", "ol", "dd"])
pieces = st.one_of(tags.map("<{}>".format), tags.map("</{}>".format), st.integers(100, 999).map(" w{} ".format), st.just("<br>"))


@given(st.lists(pieces, max_size=60).map("".join))
@settings(max_examples=400, deadline=None)
def test_all_visible_words_come_out_once(source):
    import re

    assert sorted(re.findall(r"w\d+", render(source))) == sorted(re.findall(r"w\d+", source))


def test_operator(spark):
    df = spark.createDataFrame([(1, "<p>a", "old"), (2, None, None), (1, "<p>a", "old")], "page_id long, html string, text string")
    got = sorted((r["page_id"], r["html"], r["text"]) for r in render_pages(df).select("page_id", "html", "text").collect() if r["html"])
    assert got == [(1, "<p>a", "a")] * 2
    assert render_pages(df).where("html is null").first()["text"] == ""
    assert render_pages(df.limit(0)).count() == 0


def test_query_against_a_plain_reading(spark, sf):
    """The pages are simple: their visible words are what is left without head, scripts, comments and tags."""
    import html
    import re

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in op6_html_text(spark, sf).collect():
        body = re.sub(r"(?is)<head>.*?</head>|<script.*?</script>|<style.*?</style>|<!--.*?-->", " ", pages[r["page_id"]])
        want = html.unescape(re.sub(r"<[^>]*>", " ", body)).split()
        got = [w for line in r["text"].split("\n") for w in re.sub(r"^\s*(- |\d+\. )", "", line).split()]
        assert "".join(sorted("".join(got))) == "".join(sorted("".join(want)))

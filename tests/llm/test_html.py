import random
import time
from html.parser import HTMLParser

import pytest

from annomatrix.llm.html import extract, visible_text

CASES = [
    (None, None),
    ("", ""),
    ("plain &amp; simple", "plain & simple"),
    ("<p>a<p>b<div>c</div>d", "a\n\nb\n\nc\nd"),
    ("<div>a</div><div>b</div>", "a\nb"),
    ("x<br>y<br><br>z", "x\ny\n\nz"),
    ("<h1>T</h1>t <b>bold</b>\n  text", "T\n\nt bold text"),
    ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>e", "- a\n- b\n  3. c\n  4. d\n\ne"),
    ("<p>x</p><ul><li><p>a</p><p>b</p></ul>", "x\n\n- a\n\n  b"),
    ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
    ("<table><tr><th>Name<th>N</tr><tr><td>long name<td>1<tr><td>x<td>22</table>", "Name      | N\nlong name | 1\nx         | 22"),
    ("<table><td>a<td>b</table>", "a | b"),
    ("<table><tr><td colspan=2>wide cell here</td><td>z</td></tr><tr><td>a<td>b<td>c</table>", "wide cell here | z\na | b | c"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a | b\n  | c\nd | e"),
    ("<table><tr><td>a<td rowspan=0 colspan=2>b<td>c<tr><td>d<td>e<tbody><tr><td>f<td>g<td>h<td>i</table>", "a | b     | c\nd |       | e\nf | g | h | i"),
    ("<table><tr><td colspan=150>a<td rowspan=-1>b<tr><td colspan=150>cc<td>d<tr><td colspan=100>e<td colspan=50>f<td>g</table>", "a   | b\ncc  | d\ne | f | g"),
    ("<table><caption>Cap</caption><tr><td><ul><li>p<li>q</ul><td>r</table>", "Cap\n- p - q | r"),
    ("<table><tr><td>a<table><tr><td>in<td>ner</table><td>b</table>", "a in | ner | b"),
    ("a<script>var t='</p><p>x'</script>b<style>p{}</style><!-- no > --> c<!DOCTYPE html>", "ab c"),
    ("<head><title>t</title></head><body>b", "b"),
    ("<html><head><title>t</title><p>Hello", "Hello"),
    ("<head>\n<meta charset=u><link rel=x>\n<style>p{}</style><script>s()</script>\n<noscript>n</noscript><template>m</template><title>t</title>\nHello <b>you", "Hello you"),
    ("<div>a<head>b</div>c", "ab\nc"),
    ("a <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mi>n</mi></mfrac></math> b", "a x=1/n b"),
    ("<math display=block><semantics><mi>y</mi><annotation encoding=tex>no</annotation><annotation-xml encoding=text/html><div>no</div></annotation-xml></semantics></math>z", "y\nz"),
    ("a<svg>no<title>no</title><desc>no</desc><defs><text>no</text></defs><style/><path d='M0'/><text>in<tspan>ner</tspan></text><text>out</text></svg>b", "a inner out b"),
    ("<p>a<svg><switch><foreignObject><div>label</div></foreignObject><text>no</text></switch></svg>b", "a\nlabel\nb"),
    ("<svg><text display=none>no</text><text><![CDATA[x < y > z]]></text></svg>", "x < y > z"),
    ("<svg><defs><path><p>text<b>bold", "textbold"),
    ("<pre><svg><text>a</text></svg></pre>", " a"),
    ("a<select><option>no<option selected>yes<option label=no>no</select>b", "a yes b"),
    ("<select multiple><optgroup label=g><option>p<option label=q>no</optgroup><option hidden>no</select>", "g\np\nq"),
    ("<p hidden>x</p><p style='color:red; DISPLAY : none'>y</p><p style='display:block'>z</p><input type=hidden value=v>", "z"),
    ("<span style=visibility:hidden>x</span>y", "y"),
    ("<pre>  a\n\tb &lt;\n</pre>c", "  a\n        b <\n\nc"),
    ("</div></p>a</table>b", "ab"),
    ("<p>unclosed <b>bold <i>it", "unclosed bold it"),
    ("a < b > c <3", "a < b > c <3"),
    ("<a title='x>y'>t</a>", "t"),
    ("<dl><dt>k<dd>v<dt>l<dd>w</dl>", "k\n  v\nl\n  w"),
    ("<p>a&nbsp;b&copy;&#x41;&bogus;", "a b©A&bogus;"),
    ("<select><option>no</select><noscript>no</noscript><template>no</template>yes", "yes"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_layout(page, text):
    assert visible_text(page) == text


def test_deep_and_long_pages():
    assert visible_text("<div>" * 20_000 + "x" + "</div>" * 20_000) == "x"
    assert visible_text("<table><tr><td>" * 300 + "x") == "x"
    assert len(visible_text("<p>word</p>" * 50_000).split("\n\n")) == 50_000
    assert visible_text("<" * 50_000).count("<") == 50_000


HOSTILE = ["<a ", "<!", "<?", "<!--", "<", "</", "<a '\"", '<a "', "<a '' ", "<a \"'>", "<div>", "<p><b>", "</div>", "<blockquote>", "<ul><li>", "<p><button><div>", "<table><tr><td>"]
HOSTILE += ["<table>", "<td>", "<svg>", "<math><mi>", "<svg><switch>a<!---->", "<select><option>", "<title>", "<script>", "<textarea", "&#1", "&", "<dl><dt>", "<b hidden", "<a b=", "<p>&#9"]

#: A table's rows, whose cells hold columns of the rows below.
SPANS = ["<tr><td rowspan=0>x", "<tr><td rowspan=60000>x<td>y", "<tr><td rowspan=0>x<td rowspan=9 colspan=1000>y<td>z", "<tr><td colspan=1000>x<td>y", "<td rowspan=2>x", "<tr><td>x<td rowspan=0 colspan=7>y"]


def rising(page):
    """Every row's cell ends at a row of its own."""
    return "<table>" + "".join(f"<tr><td rowspan={2 + (i * 7919) % 60000}>x<td>y" for i in range(page // 29))


@pytest.mark.parametrize("page", [*["<table>" + u * (1_000_000 // len(u)) for u in SPANS], rising(1_000_000), "<table><tr>" + "<td rowspan=0>wide cell" * 300 + "<tr><td>x" * 50_000])
def test_a_megabyte_of_spans(page):
    began = time.process_time()
    text = visible_text(page)
    assert time.process_time() - began < 5 and len(text) < 10_000_000
    assert text.count("x") == page.count("x") - page.count("<ex")


def test_cells_below_spans_keep_their_columns():
    page = "<table><tr><td rowspan=2>aa<td rowspan=2>b<td>c<tr><td>d<tr><td rowspan=2 colspan=2>ee<td>f<tr><td>g<td>h</table>"
    assert visible_text(page) == "aa | b | c\n   |   | d\nee     | f\n       | g | h"


@pytest.mark.parametrize("unit", HOSTILE)
def test_a_megabyte_takes_seconds(unit):
    page = unit * (1_000_000 // len(unit))
    began = time.process_time()
    visible_text(page + "x")
    assert time.process_time() - began < 5


def test_numbers_of_any_length():
    assert visible_text("a&#" + "9" * 5000 + ";b&#0000000000000000065;&#x" + "0" * 30 + "42;&#x" + "f" * 9) == "a\ufffdbAB\ufffd"
    assert visible_text("<ol start=" + "9" * 5000 + "><li>a</ol>").startswith("2147483647. a")
    assert visible_text("<ol start=1234567><li>a<li>b</ol>") == "1234567. a\n1234568. b"
    assert visible_text("<table><tr><td colspan=" + "9" * 5000 + ">a<td>b</table>") == "a | b"


def test_entities_in_text_areas_and_nested_tables():
    assert visible_text("<textarea>x &amp; <b>y</textarea>z") == "x & <b>yz"
    cell = "in"
    for i in range(12):
        cell = f"<table><tr><td>{i}<td>{cell}</table>"
    assert visible_text(cell) == " | ".join(f"{i}" for i in range(11, -1, -1)) + " | in"
    assert visible_text("<ul><li>" * 200 + "x").endswith("- x")


class Outline(HTMLParser):
    """Nested lists of [tag, attributes, children] of a well-formed page."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.open = [["html", {}, []]]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs), []]
        self.open[-1][2].append(node)
        if tag != "br":
            self.open.append(node)

    def handle_endtag(self, tag):
        assert self.open.pop()[0] == tag

    def handle_data(self, data):
        self.open[-1][2].append(data)


def outline_lines(children):
    """Lines of a page of div, p, ul, ol, table, br, b and hidden elements, None for a wanted gap."""
    lines, run = [], [""]

    def flush():
        lines.extend(" ".join(x.split()) for x in run if x.strip())
        run[:] = [""]

    def walk(nodes):
        for n in nodes:
            if isinstance(n, str):
                run[-1] += n
            elif "hidden" in n[1] or n[0] in ("script", "style"):
                continue
            elif n[0] == "b":
                walk(n[2])
            elif n[0] == "br":
                flush()
            else:
                flush()
                if n[0] != "div":
                    lines.append(None)
                if n[0] == "table":
                    rows = [[" ".join(x for x in outline_lines(c[2]) if x) for c in r[2]] for r in n[2]]
                    width = [max(len(r[i]) for r in rows if i < len(r)) for i in range(max(map(len, rows)))]
                    lines.extend(" | ".join(c.ljust(w) for c, w in zip(r, width)).rstrip() for r in rows if any(r))
                elif n[0] in ("ul", "ol"):
                    for k, item in enumerate(n[2]):
                        head = "- " if n[0] == "ul" else f"{int(n[1].get('start', 1)) + k}. "
                        own = outline_lines(item[2])
                        lines.extend((head if not i else " " * len(head)) + x for i, x in enumerate(own))
                else:
                    walk(n[2])
                    flush()
                if n[0] != "div":
                    lines.append(None)

    walk(children)
    flush()
    out = []
    for i, x in enumerate(lines):
        if x is not None:
            if out and lines[i - 1] is None:
                out.append("")
            out.append(x)
    return out


def test_well_formed_pages_by_an_outline():
    rng = random.Random(5)
    word = lambda: rng.choice(["alpha", "be&amp;ta", "c", "δ", "long-word", "x &lt; y"])
    inline = lambda: " ".join(rng.choice([word(), f"<b>{word()}</b>", f"<b hidden>{word()}</b>"]) for _ in range(rng.randint(1, 4)))

    def block(depth):
        kind = rng.choice(["p", "div", "ul", "ol", "table", "text", "script"]) if depth < 3 else "p"
        if kind == "p":
            return f"<p>{inline()}{'<br>' + word() if rng.random() < 0.3 else ''}</p>"
        if kind == "div":
            return "<div>" + "".join(block(depth + 1) for _ in range(rng.randint(1, 3))) + "</div>"
        if kind in ("ul", "ol"):
            start = f" start={rng.randint(1, 20)}" if kind == "ol" else ""
            return f"<{kind}{start}>" + "".join(f"<li>{word()} {inline()}</li>" for _ in range(rng.randint(1, 3))) + f"</{kind}>"
        if kind == "table":
            cell = lambda: word() if depth > 1 or rng.random() < 0.8 else block(2)
            return "<table>" + "".join("<tr>" + "".join(f"<td>{cell()}</td>" for _ in range(rng.randint(1, 3))) + "</tr>" for _ in range(rng.randint(1, 3))) + "</table>"
        return f"<script>if (a < b) x('<p>')</script>{word()}" if kind == "script" else f"{inline()} "

    for _ in range(400):
        page = "".join(block(0) for _ in range(rng.randint(1, 5)))
        assert visible_text(page) == "\n".join(outline_lines(Outline(page).open[0][2])), page


def test_spark(spark):
    rows = [(1, "u", "<p>a", 1), (None, None, None, 2), (1, "u", "<p>a", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    assert sorted(map(str, extract(pages).collect())) == sorted(["Row(page_id=1, url='u', text='a')"] * 2 + ["Row(page_id=None, url=None, text=None)"])
    assert extract(pages.limit(0)).count() == 0

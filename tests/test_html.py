"""Page text against the standard library's parser."""

from html.parser import HTMLParser
from itertools import groupby

from compare import connect
from conftest import SF

from lanternqa.sources.html import page_text


class Nodes(HTMLParser):
    """Text nodes; neighbouring pieces of text are one node, as in a parse tree."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.open, self.blocked = [], "", 0

    def flush(self):
        if self.open:
            self.nodes.append(self.open)
        self.open = ""

    def handle_starttag(self, tag, attrs):
        self.flush()
        self.blocked += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.flush()
        self.blocked -= tag in ("script", "style")

    def handle_data(self, data):
        if not self.blocked:
            self.open += data

    def handle_comment(self, data):
        self.flush()
        self.nodes.append("")

    def handle_decl(self, decl):
        self.handle_comment(decl)


def without_pairs(node):
    """Line ends and tabs are blanks; of a run of blanks only an odd one is left."""
    return "".join(
        " " * (len(list(run)) % 2) if blank else "".join(run)
        for blank, run in groupby(node, lambda c: c in " \n\t\r")
    )


def parsed(html):
    parser = Nodes()
    parser.feed(html)
    parser.close()
    parser.flush()
    return " ".join(map(without_pairs, parser.nodes))


def texts(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id bigint, html string")
    return [r.text for r in page_text(df).orderBy("page_id").collect()]


def test_sample_pages(spark):
    pages = [r[0] for r in connect(SF).execute("SELECT html FROM pages ORDER BY page_id").fetchall()]
    assert texts(spark, pages) == [parsed(p) for p in pages]


def test_hand_made_pages(spark):
    pages = [
        "<p>a &lt; b &amp; c</p>",
        "<p>3 < 4 and 5 > 2</p>",
        '<a title="x > y" href=\'q\'>link</a> tail',
        "<SCRIPT>if (a<b) {}</SCRIPT>shown<style>p{}</style>",
        "<p>caf&eacute; &#233; &#xe9; &hearts; R&D AT&T</p>",
        "before<!-- no <b>bold</b> --><br/>after",
        "x<script>never closed <p>y</p>",
        "<p>&amp;lt; stays</p>",
        "",
        "plain",
        "<img src='data:" + "A" * 200000 + "'>end",
        "<p>" + "< " * 30000 + "</p>",
    ]
    assert texts(spark, pages) == [parsed(p) for p in pages]
    assert texts(spark, ["<x><![CDATA[kept]]></x>"]) == ["kept"]


def test_long_nodes_need_no_deep_stack(spark):
    pages = [
        "<script>" + "a<b " * 100000 + "</script>x",
        "<!--" + "-" * 300000 + "-->y",
        "<p " + " ".join(f'a{i}="{i}"' for i in range(30000)) + ">z",
        "t" * 500000,
    ]
    assert texts(spark, pages) == ["x", " y", "z", "t" * 500000]

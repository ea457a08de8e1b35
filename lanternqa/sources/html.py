"""Page text from raw HTML."""

from __future__ import annotations

import html as stdlib_html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternqa.functions.text import clean_whitespace

# One token of a page, tried in this order: comment, character data, script,
# style, tag with quoted attributes, other tag, text, a lone bracket.
# Possessive groups keep the matcher's stack flat on long tags.
PAGE_TOKEN = (
    r"(?is)<!--.*?-->"
    r"|<!\[CDATA\[.*?\]\]>"
    r"|<script\b.*?(?:</script\s*>|\z)"
    r"|<style\b.*?(?:</style\s*>|\z)"
    r"""|<[!/?a-z](?:"[^"]*+"|'[^']*+'|[^'">]++)*+>"""
    r"|<[!/?a-z][^>]*>"
    r"|[^<]+"
    r"|<"
)
# A bracket that opens no tag is text; it is set aside under this character.
SET_ASIDE = "\u0001"
# References decoded in the plan itself, the ampersand last.
COMMON = [
    ("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&nbsp;", " "),
    ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&amp;", "&"),
]
OTHER_REFERENCE = r"&(?!(?:quot|middot|copy|nbsp|lt|gt|amp|#39);)#?\w"


@F.pandas_udf(T.ArrayType(T.StringType()))
def _decode(pieces: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else [stdlib_html.unescape(t) for t in p] for p in pieces], dtype=object)


def _common_references(x: Column) -> Column:
    for name, char in COMMON:
        x = F.replace(x, F.lit(name), F.lit(char))
    return x


def page_text(
    pages: DataFrame, html: str = "html", keep: list[str] | None = None, collapse: bool = False,
    all_references: bool = True,
) -> DataFrame:
    """`keep` columns and text: a page's text nodes outside style and script,
    each whitespace-cleaned, joined by one space.

    Comments and declarations count as empty nodes. Pages with character
    references beyond the common ones are decoded in Python; all others never
    leave the JVM.
    """
    keep = ["page_id"] if keep is None else keep
    marked = F.regexp_replace(F.col(html), r"<(?![!/?a-zA-Z])", SET_ASIDE)
    parts = F.regexp_extract_all(marked, F.lit(PAGE_TOKEN), F.lit(0))
    kept = F.filter(parts, lambda t: ~t.startswith("<") | t.startswith("<!") | t.startswith("<?") | (t == "<"))

    def node(t: Column) -> Column:
        inner = F.substr(t, F.lit(10), F.length(t) - 12)
        text = (
            F.when(F.lower(F.left(t, F.lit(9))) == "<![cdata[", inner)
            .when(t.startswith("<") & (t != "<"), "").otherwise(t)
        )
        return F.replace(text, F.lit(SET_ASIDE), F.lit("<"))

    nodes = pages.select(*keep, F.transform(kept, node).alias("_nodes"))
    decoded = F.transform("_nodes", _common_references)
    if all_references:
        rare = F.exists("_nodes", lambda t: t.rlike(OTHER_REFERENCE))
        nodes = nodes.withColumn("_rare", F.when(rare, F.col("_nodes")))
        decoded = F.coalesce(_decode(F.col("_rare")), decoded)
    nodes = nodes.select(*keep, decoded.alias("_decoded"))
    return nodes.select(
        *keep, F.array_join(F.transform("_decoded", lambda t: clean_whitespace(t, collapse)), " ").alias("text")
    )

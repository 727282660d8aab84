"""TEI, HTML and Markdown as columns."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from ..functions.text import dash_slug, strip_tags


def _inner(xml: Column, tag: str) -> Column:
    return F.trim(strip_tags(F.regexp_extract(xml, f"(?s)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>", 1)))


def tei_fields(xml: Column) -> Column:
    """title, abstract and body of a TEI document, tags stripped, empty where absent."""
    return F.struct(*[_inner(xml, t).alias(t) for t in ("title", "abstract", "body")])


def tei_sections(docs: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    """(id, ord, title, level, text): from each head to the next; sections without title and text are left out."""
    body = F.regexp_extract(xml_col, r"(?s)<body(?:\s[^>]*)?>(.*?)</body>", 1)
    parts = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(body, "<head")).alias("ord", "part")).where("ord > 0")
    title = F.trim(strip_tags(F.regexp_extract("part", "(?s)^[^>]*>(.*?)</head>", 1)))
    level = F.coalesce(F.regexp_extract("part", '^[^>]*n="([0-9]+)', 1).try_cast("int"), F.lit(1))
    text = F.trim(strip_tags(F.regexp_replace("part", "(?s)^.*?</head>", "")))
    return parts.select("id", "ord", title.alias("title"), level.alias("level"), text.alias("text")).where("title <> '' OR text <> ''")


def tei_citations(docs: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    """(id, ord, title, doi, arxiv_id, raw_text) of each biblStruct in the back matter."""
    back = F.regexp_extract(xml_col, r"(?s)<back(?:\s[^>]*)?>(.*?)</back>", 1)
    found = docs.select(F.col(id_col).alias("id"), F.posexplode(F.regexp_extract_all(back, F.lit("(?s)(<biblStruct.*?</biblStruct>)"), 1)).alias("ord", "b"))
    idno = lambda kind: F.trim(F.regexp_extract("b", f'(?is)<idno[^>]*type="{kind}"[^>]*>(.*?)</idno>', 1))
    arxiv = F.regexp_replace(F.regexp_replace(idno("arxiv"), "(?i)^arxiv:", ""), "v.*$", "")
    return found.select("id", "ord", _inner(F.regexp_extract("b", "(?s)<analytic>(.*?)</analytic>", 1), "title").alias("title"), idno("doi").alias("doi"), arxiv.alias("arxiv_id"), F.trim(F.regexp_replace(strip_tags(F.col("b")), r"\s+", " ")).alias("raw_text"))


def without_scripts(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<(script|style|noscript|template)\b[^>]*>.*?</\1\s*>", " ")


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_sections(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, ord, level, title, text): split at h1 to h3 outside scripts."""
    marked = F.regexp_replace(without_scripts(F.col(html_col)), r"(?i)<h([1-3])\b", "\u0001<h$1")
    parts = pages.select(F.col(id_col).alias("id"), F.posexplode(F.split(marked, "\u0001")).alias("ord", "part")).where("ord > 0")
    text = F.regexp_replace("part", r"(?is)^<h[1-3][^>]*>.*?</h[1-3]>", "")
    return parts.select("id", "ord", F.regexp_extract("part", r"(?i)^<h([1-3])", 1).cast("int").alias("level"), F.trim(strip_tags(F.regexp_extract("part", r"(?is)^<h[1-3][^>]*>(.*?)</h[1-3]>", 1))).alias("title"), F.trim(F.regexp_replace(strip_tags(text), r"\s+", " ")).alias("text"))


def _powers(n: int) -> np.ndarray:
    """33^(n-1) .. 33^0 modulo 2^64."""
    return np.concatenate([np.cumprod(np.full(n - 1, 33, np.uint64))[::-1], np.ones(1, np.uint64)]) if n else np.empty(0, np.uint64)


def djb2(data: bytes) -> int:
    """The 64-bit string hash h * 33 + byte from 5381 on, as the sum of its polynomial."""
    n = len(data)
    return int((np.frombuffer(data, np.uint8) * _powers(n)).sum(dtype=np.uint64) + np.uint64(5381 * pow(33, n, 2**64) % 2**64)) % 2**64


@F.pandas_udf(StringType())
def djb2_hex(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else f"{djb2(t.encode()):016x}")


class _Main(HTMLParser):
    """Text by container; headings keep their level as number signs."""

    DROP = {"nav", "footer", "aside", "script", "style", "noscript", "template"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.text = [], {"article": [], "body": [], "all": []}

    #: Tags that have no end.
    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
    #: Tags that end whatever part of the page still stands open.
    PARTS = {"article", "main", "footer", "body"}

    def handle_starttag(self, tag, attrs):
        if tag in self.PARTS and self.DROP & set(self.stack):  # a nav or aside that was never closed ends here
            del self.stack[min(self.stack.index(x) for x in self.DROP & set(self.stack)) :]
        if tag not in self.VOID:
            self.stack.append(tag)
        if re.fullmatch("h[1-6]", tag):
            self._add("\n" + "#" * int(tag[1]) + " ")

    def handle_endtag(self, tag):
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass
        if tag in ("p", "div", "li", "section", "article") or re.fullmatch("h[1-6]", tag):
            self._add("\n")

    def handle_data(self, data):
        self._add(data)

    def _add(self, data):
        if self.DROP & set(self.stack):
            return
        self.text["all"].append(data)
        for where, tags in (("article", {"article", "main"}), ("body", {"body"})):
            if tags & set(self.stack):
                self.text[where].append(data)


def _clean(parts: list[str]) -> str:
    return "\n".join(x for line in "".join(parts).split("\n") if (x := " ".join(line.split())))


@F.pandas_udf(StructType().add("main", StringType()).add("ratio", DoubleType()))
def html_main(html: pd.Series) -> pd.DataFrame:
    """Main content without navigation, and its share of all text: article or main, else body, else all."""
    out = []
    for h in html:
        p = _Main()
        p.feed(h or "")
        everything = _clean(p.text["all"])
        main = _clean(p.text["article"]) or _clean(p.text["body"]) or everything
        out.append((main, len(main) / len(everything) if everything else 0.0))
    return pd.DataFrame(out, columns=["main", "ratio"])


def markdown_headings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, ord, level, title, heading_id, parent_id, path): ATX headings with their nearest lower-level parent.

    Ids are slugs, with -2, -3 ... from the second use on. Front matter is left out.
    """
    from pyspark.sql import Window

    body = F.regexp_replace(F.col(text_col), r"(?s)\A---\n.*?\n---\n", "")
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(body, "\n", -1)).alias("ord", "line")).where(r"line rlike '^#{1,6}\\s+\\S'")
    h = lines.select("id", "ord", F.length(F.regexp_extract("line", r"^(#{1,6})", 1)).alias("level"), F.trim(F.regexp_extract("line", r"^#{1,6}\s+(.+?)\s*$", 1)).alias("title"))
    slug = dash_slug(F.col("title"), "section")
    nth = F.row_number().over(Window.partitionBy("id", slug).orderBy("ord"))
    h = h.withColumn("heading_id", F.when(nth > 1, F.concat_ws("-", slug, nth.cast("string"))).otherwise(slug))
    before = Window.partitionBy("id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    # the last heading of each level so far; one of a lower level counts if nothing at or below it came since
    for k in range(1, 7):
        h = h.withColumn(f"l{k}", F.max(F.when(F.col("level") == k, F.struct("ord", "heading_id"))).over(before))
    best = F.lit(None).cast("struct<ord: int, heading_id: string>")
    for k in range(1, 6):
        c = F.col(f"l{k}")
        best = F.when((F.col("level") > k) & c.isNotNull() & (best.isNull() | (c["ord"] > best["ord"])), c).otherwise(best)
    return h.select("id", "ord", "level", "title", "heading_id", best["heading_id"].alias("parent_id"))

"""Main text of HTML pages, without a model: block text with little markup and few links."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SKIP = {"script", "style", "noscript", "nav", "header", "footer", "aside", "form", "svg", "template", "head", "button", "select"}
_BLOCK = {"p", "div", "section", "article", "main", "li", "ul", "ol", "table", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "br", "td", "body", "hr"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int]] = []
        self.parts: list[str] = []
        self.linked, self.skip, self.links = 0, 0, 0

    def flush(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self.parts)).strip()
        if text:
            self.blocks.append((text, self.linked))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.skip += 1
        elif tag == "a":
            self.links += 1
        if tag in _BLOCK:
            self.flush()

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == "a":
            self.links = max(0, self.links - 1)
        if tag in _BLOCK:
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)
            self.linked += len(data) if self.links else 0


def extract(html: str | None, least: int = 100) -> str | None:
    """The text of blocks that are not mostly links; None if it is shorter than ``least`` characters."""
    if not html or not html.strip():
        return None
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    text = "\n".join(t for t, linked in parser.blocks if linked <= len(t) / 2).strip()
    return text if len(text) >= least else None


def extract_text(df: DataFrame, html: str = "html", least: int = 100) -> DataFrame:
    """Add ``text`` (null if too short), ``html_length``, ``text_length`` and ``extraction_ratio`` (4 decimals)."""

    @F.pandas_udf("string")
    def pull(pages):
        import pandas as pd

        return pd.Series([extract(p, least) for p in pages], dtype=object)

    out = df.withColumn("text", pull(F.col(html))).withColumn("html_length", F.length(html)).withColumn("text_length", F.coalesce(F.length("text"), F.lit(0)))
    return out.withColumn("extraction_ratio", F.when(F.col("html_length") > 0, F.round(F.col("text_length") / F.col("html_length"), 4)).otherwise(0.0))

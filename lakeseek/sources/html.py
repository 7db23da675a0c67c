"""HTML pages to text: elements of visible text, stripped, joined by a blank line."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

HIDDEN = {"script", "style", "head", "template", "noscript"}
BLOCKS = {"p", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "table", "tr", "td", "th", "section", "article", "nav", "header", "footer", "blockquote", "pre", "br", "hr", "body", "main"}


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts, self.now, self.hidden = [], [], 0

    def _cut(self) -> None:
        text = " ".join("".join(self.now).split())
        if text:
            self.parts.append(text)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        elif tag in BLOCKS:
            self._cut()

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in BLOCKS:
            self._cut()

    def handle_data(self, data):
        if not self.hidden:
            self.now.append(data)


def text_of(html: str | None) -> str | None:
    """None where a page has no text: the caller routes such rows to the rejects."""
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    parser._cut()
    return "\n\n".join(parser.parts) or None


@F.pandas_udf(T.StringType())
def html_to_text(pages: pd.Series) -> pd.Series:
    return pages.map(text_of)

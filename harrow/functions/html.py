"""Fields of an HTML body: visible text, headings, anchors, image texts and article links."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from harrow.functions.text import normalize_text, prefix

# Which tags give which field, and the form of a link.
DROPPED = {"script", "style", "input"}
IMPORTANT = {"h1", "h2", "h3", "h4", "strong", "label"}
LINK = r"/articles/(\d+)"
INTRO_CHARS = 1200
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Fields(HTMLParser):
    """One pass over the tags; text goes to every field whose tag is open, once for each open tag of it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[str]]] = []
        self.visible, self.alt = [], []
        self.blocks: dict[str, list[list[str]]] = {"important": [], "anchors": []}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "img" and not self._dropped():
            self.alt.append(dict(attrs).get("alt") or "")
        if tag in VOID:
            return
        text: list[str] = []
        if not self._dropped():
            if tag in IMPORTANT:
                self.blocks["important"].append(text)
            elif tag == "a":
                self.blocks["anchors"].append(text)
        self.open.append((tag, text))

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self._dropped():
            return
        self.visible.append(data)
        for _, text in self.open:
            text.append(data)

    def _dropped(self) -> bool:
        return any(t in DROPPED for t, _ in self.open)

    def result(self) -> dict[str, str]:
        joined = {k: " ".join(" ".join(b) for b in v) for k, v in self.blocks.items()}
        return {"visible": " ".join(self.visible), **joined, "alt_text": " ".join(self.alt)}


def parse(body: str | None) -> dict[str, str]:
    parser = _Fields()
    parser.feed(body or "")
    parser.close()
    return parser.result()


@F.pandas_udf(StructType([StructField(f, StringType()) for f in ("visible", "important", "anchors", "alt_text")]))
def _parsed(bodies: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in bodies:
        yield pd.DataFrame([parse(b) for b in batch], columns=["visible", "important", "anchors", "alt_text"])


def internal_links(body: Column) -> Column:
    """Sorted distinct article ids that the raw body links to, comments included."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(LINK), 1), lambda x: x.cast("bigint"))))


def extract_fields(pages: DataFrame, body_col: str) -> DataFrame:
    """Add visible, important, anchors, alt_text, intro (normalised) and internal_links; the body is parsed once."""
    parsed = pages.withColumn("__fields", _parsed(F.coalesce(F.col(body_col), F.lit(""))))
    fields = ["visible", "important", "anchors", "alt_text"]
    clean = parsed.withColumns({f: normalize_text(F.col(f"__fields.{f}")) for f in fields})
    return clean.withColumns({"intro": prefix(F.col("visible"), INTRO_CHARS), "internal_links": internal_links(F.col(body_col))}).drop("__fields")

"""Raw filings to typed elements: paragraphs, lists, headings and tables with navigation, items and sections.

Python only walks the mark-up; what an element is follows by the column expressions of functions.elements.
"""

from __future__ import annotations

import html.parser
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstrata.functions import elements as E
from quillstrata.sources.files import _HIDDEN, _VOID, _is_hidden

# Elements that hold content.
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
CONTENT = ("div", "p", "li", "table", *HEADINGS)


class _Leaves(html.parser.HTMLParser):
    """Content elements outside tables that hold no other, and whole tables: tag, text, texts of links."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str, list[str]]] = []
        self._open: list[dict] = []
        self._hidden: list | None = None
        self._tables = 0

    def _end(self, tag: str) -> None:
        """Close the innermost open element of that name and what is open inside it."""
        if any(e["tag"] == tag for e in self._open):
            while True:
                e = self._open.pop()
                if e["leaf"] and e["tag"] != "table":
                    self.found[e["at"]] = (e["tag"], " ".join(e["text"]), e["links"])
                if e["tag"] == tag:
                    return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self._hidden:
            self._hidden[1] += tag == self._hidden[0]
            return
        if tag in _HIDDEN or _is_hidden(dict(attrs)):
            self._hidden = [tag, 1] if tag not in _VOID else None
            return
        if self._tables:
            self._tables += tag == "table"
            rows = self._open[-1]["rows"]
            if tag == "tr":
                rows.append([])
            elif tag in ("td", "th") and self._tables == 1:
                if not rows:
                    rows.append([])
                rows[-1].append([])
            elif tag == "a":
                self._open[-1]["links"].append("")
                self._open[-1]["linked"] = True
            return
        if tag in ("p", *HEADINGS, "li") and self._open and self._open[-1]["tag"] in ("p", tag):
            self._end(self._open[-1]["tag"])
        if tag in CONTENT:
            for e in self._open:
                e["leaf"] = False
            self.found.append(("", "", []))
            self._open.append({"tag": tag, "text": [], "links": [], "leaf": True, "at": len(self.found) - 1, "linked": False, "rows": []})
            self._tables = int(tag == "table")
        elif tag == "a" and self._open:
            self._open[-1]["links"].append("")
            self._open[-1]["linked"] = True

    def handle_endtag(self, tag: str) -> None:
        if self._hidden:
            self._hidden[1] -= tag == self._hidden[0]
            self._hidden = self._hidden if self._hidden[1] else None
            return
        if tag == "a" and self._open:
            self._open[-1]["linked"] = False
        if self._tables:
            self._tables -= tag == "table"
            if not self._tables:
                e = self._open.pop()
                cells = [[" ".join(" ".join(c).split()) for c in row] for row in e["rows"]]
                self.found[e["at"]] = ("table", "\n".join(" | ".join(row) for row in cells if any(row)), e["links"])
        elif tag in CONTENT:
            self._end(tag)
        elif tag in ("ul", "ol"):
            self._end("li")

    def handle_data(self, data: str) -> None:
        if self._hidden or not self._open or not data.strip():
            return
        e = self._open[-1]
        if e["linked"]:
            e["links"][-1] = f"{e['links'][-1]} {data.strip()}".strip()
        if not self._tables:
            e["text"].append(data.strip())
        elif e["rows"] and e["rows"][-1]:
            e["rows"][-1][-1].append(data.strip())

    def finish(self) -> list[tuple[str, str, list[str]]]:
        self.close()
        if self._tables:
            self._tables = 1
            self.handle_endtag("table")
        while self._open:
            self._end(self._open[-1]["tag"])
        return [x for x in self.found if x[1].strip()]


def leaves(filings: DataFrame, key: str) -> DataFrame:
    """key, place, tag, text, links of a filing's html."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, source in zip(pdf[key], pdf["html"], strict=True):
                parser = _Leaves()
                parser.feed(source or "")
                rows += [(k, i, *x) for i, x in enumerate(parser.finish())]
            yield pd.DataFrame(rows, columns=[key, "place", "tag", "text", "links"])

    kind = filings.schema[key].dataType.simpleString()
    return filings.select(key, "html").mapInPandas(run, f"`{key}` {kind}, place long, tag string, text string, links array<string>")


def parse_filings(filings: DataFrame, key: str = "accession_number", compose: bool = True) -> DataFrame:
    """filings: key, html and more. Its other columns and order_index, element_type, text, is_navigation, sec_item, section_title.

    A table that is really text becomes what it is. The item is the last one that began; the section is the last heading's
    text; navigation has none and changes neither.
    """
    raw = leaves(filings, key)
    table = F.col("tag") == "table"
    rows = raw.withColumn("kind", F.when(table, E.element_class(F.col("text"))).when(F.col("tag") == "li", "list").otherwise("paragraph"))
    rows = rows.withColumn("plain", F.when(F.col("kind") == "table", F.col("text")).otherwise(E.clean(F.col("text"), compose))).where("plain <> ''")
    rows = rows.withColumn("navigation", E.is_navigation_element(F.col("plain"), F.col("links")))
    heading = (F.col("kind") == "paragraph") & ~F.col("navigation") & E.is_heading_element(F.col("tag"), F.col("plain"))
    order = Window.partitionBy(key).orderBy("place")
    rows = rows.select(key, (F.row_number().over(order) - 1).alias("order_index"), F.when(heading, "heading").otherwise(F.col("kind")).alias("kind"), F.col("plain").alias("text"), "navigation")
    # Items are looked for in what follows an element, whatever it is; those that begin in navigation don't count.
    found = E.item_starts(rows.select(F.col(key).alias("doc"), F.col("order_index").alias("place"), "text")).select(F.col("doc").alias(key), F.col("place").alias("order_index"), "started")
    rows = rows.join(found, [key, "order_index"]).withColumn("started", F.when(~F.col("navigation"), F.col("started")))
    rows = rows.withColumn("element_type", F.when(F.col("started").isNotNull(), "heading").otherwise(F.col("kind")))
    upto = Window.partitionBy(key).orderBy("order_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    title = F.when((F.col("element_type") == "heading") & ~F.col("navigation"), E.clean(F.replace("text", F.lit("|"), F.lit(" "))))
    made = rows.select(key, "order_index", "element_type", "text", F.col("navigation").alias("is_navigation"), F.concat(F.lit("Item "), F.last("started", ignorenulls=True).over(upto)).alias("sec_item"), F.when(~F.col("navigation"), F.last(title, ignorenulls=True).over(upto)).alias("section_title"))
    return filings.drop("html").join(made, key)

"""Sources: JSON lines, query texts, manifests, registries, XML facts, raw HTML with its elements and grids."""

from __future__ import annotations

import html.parser
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BLOCKS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "tr", "table", "div", "title")
_HIDDEN = ("script", "style", "noscript", "template", "ix:header")
_VOID = ("br", "hr", "img", "input", "meta", "link", "col", "wbr")


def _is_hidden(attrs: dict) -> bool:
    style = "".join((attrs.get("style") or "").split()).lower()
    return "hidden" in attrs or "display:none" in style or "visibility:hidden" in style


def _first_bad_line(spark: SparkSession, lines: DataFrame, is_bad) -> str | None:
    """Says which line of which file is the first that is_bad (a condition on value) holds for; files are read whole only then."""
    files = [r[0] for r in lines.where(is_bad).select(F.input_file_name()).distinct().sort("input_file_name()").limit(1).collect()]
    if not files:
        return None
    whole = spark.read.text(files[0], wholetext=True).select(F.posexplode(F.split("value", r"\r\n|\n|\r", -1)).alias("at", "value"))
    at, value = whole.where(F.trim("value") != "").where(is_bad).sort("at").first()
    try:
        json.loads(value)
        why = "a JSON object was expected"
    except json.JSONDecodeError as error:
        why = f"invalid JSON: {error.msg}"
    return f"line {at + 1} of {files[0]}: {why}"


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """One JSON object a line, of one path, several or a glob. Blank lines are skipped; a line that is none is named in the error."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    # A corrupt row has all fields null and its text in the last one.
    row = F.from_json("value", f"{schema}, __qs_corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__qs_corrupt"})
    if said := _first_bad_line(spark, lines, ~F.ltrim("value").startswith("{") | F.coalesce(row["__qs_corrupt"].isNotNull(), F.lit(True))):
        raise ValueError(said)
    return lines.select(row.alias("r")).select("r.*").drop("__qs_corrupt")


def read_query_texts(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """place, query: the stripped questions of a query file in its order, the first limit of them; none may be blank."""
    if limit is not None and limit < 1:
        raise ValueError("limit must be at least 1")
    rows = read_jsonl(spark, path, "query string").withColumn("place", F.monotonically_increasing_id())
    if rows.where(F.coalesce(F.trim("query") == "", F.lit(True))).limit(1).count() or rows.isEmpty():
        raise ValueError("a query file needs questions, and none may be blank")
    kept = rows.select("place", F.regexp_replace("query", r"(?U)^\s+|\s+$", "").alias("query"))
    return kept if limit is None else kept.orderBy("place").limit(limit)


def embedding_inputs(records: DataFrame) -> DataFrame:
    """record_id, embedding_text, stripped: what is encoded; blank fields and repeated ids are errors."""
    need = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?U)^\s+|\s+$", "")
    rows = records.select(need("record_id").alias("record_id"), need("embedding_text").alias("embedding_text"))
    n, ids, blank = rows.agg(F.count("*"), F.count_distinct("record_id"), F.count_if((F.col("record_id") == "") | (F.col("embedding_text") == ""))).first()
    if not n or blank or ids < n:
        raise ValueError(f"{n} records: {blank} with a blank field, {n - ids} with a repeated id")
    return rows


def read_xml_facts(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Facts of XML instances, one row an element of that name; attributes are fields that begin with an underscore."""
    return spark.read.format("xml").option("rowTag", row_tag).option("mode", "FAILFAST").schema(schema).load(path)


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of rows, or an object with them under filings."""
    whole = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", f"array<struct<{schema}>>")
    wrapped = F.from_json("value", f"struct<filings: array<struct<{schema}>>>")["filings"]
    return whole.select(F.explode(F.when(F.ltrim("value").startswith("["), listed).otherwise(wrapped)).alias("r")).select("r.*")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Banks of a YAML registry; tickers are upper-cased, repeated ones are an error."""
    import yaml

    with open(path, encoding="utf-8") as f:
        banks = yaml.safe_load(f)["banks"]
    rows = [(b["ticker"].upper(), str(b["cik"]), b["legal_name"], b.get("enabled", True), i) for i, b in enumerate(banks)]
    if len({r[0] for r in rows}) < len(rows) or not any(r[3] for r in rows):
        raise ValueError("tickers must be unique and one bank enabled")
    return spark.createDataFrame(rows, "ticker string, cik string, legal_name string, enabled boolean, place int")


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """path, html (malformed bytes replaced), raw_sha256."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("html"), F.sha2("content", 256).alias("raw_sha256"))


class _Elements(html.parser.HTMLParser):
    """Flat elements (kind, text, characters in links) of a page; open tags are closed by the next block."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str, int]] = []
        self._kind, self._text, self._links, self._hidden, self._in_link = "text", [], 0, None, False

    def _close(self) -> None:
        text = " ".join("".join(self._text).split())
        if text:
            self.found.append((self._kind, text, self._links))
        self._text, self._links = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        # An element may be hidden by its name, its style or its attribute; what is inside it is hidden too.
        if self._hidden:
            self._hidden[1] += tag == self._hidden[0]
            return
        if tag in _HIDDEN or _is_hidden(dict(attrs)):
            if tag in _BLOCKS:
                self._close()
            self._hidden = [tag, 1] if tag not in _VOID else None
            return
        self._in_link |= tag == "a"
        if tag in _BLOCKS:
            self._close()
            self._kind = "heading" if tag[0] == "h" and tag[1:].isdigit() or tag == "title" else "cell" if tag in ("td", "th") else "item" if tag == "li" else "text"

    def handle_endtag(self, tag: str) -> None:
        if self._hidden:
            self._hidden[1] -= tag == self._hidden[0]
            self._hidden = self._hidden if self._hidden[1] else None
            return
        if tag == "a":
            self._in_link = False
        if tag in _BLOCKS:
            self._close()

    def handle_data(self, data: str) -> None:
        if not self._hidden:
            self._text.append(data)
            self._links += len(data.strip()) * self._in_link


def _elements_of(source: str | None) -> Iterator[tuple[int, str, str, float]]:
    """(place, kind, text, share of characters inside links) of a page's elements."""
    parser = _Elements()
    parser.feed(source or "")
    parser._close()
    for i, (kind, text, links) in enumerate(parser.found):
        yield i, kind, text, min(1.0, links / len(text))


class PageElements:
    """The table function page_elements(html): place, kind, text, link_ratio; a null page has no elements."""

    def eval(self, html: str):
        yield from _elements_of(html)


def register_page_elements(spark: SparkSession, name: str = "page_elements") -> None:
    """Lets SQL of the session say FROM pages p, LATERAL page_elements(p.html)."""
    spark.udtf.register(name, F.udtf(PageElements, returnType="place int, kind string, text string, link_ratio double"))


def page_elements(pages: DataFrame) -> DataFrame:
    """pages: page_id, html. page_id, place, kind, text, link_ratio (share of characters inside links)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(page, *x) for page, source in zip(pdf["page_id"], pdf["html"], strict=True) for x in _elements_of(source)]
            yield pd.DataFrame(rows, columns=["page_id", "place", "kind", "text", "link_ratio"])

    return pages.where("page_id is not null").select("page_id", "html").mapInPandas(run, "page_id long, place int, kind string, text string, link_ratio double")


class _Grids(html.parser.HTMLParser):
    """Cells of the tables below elements that carry the block attribute; a cell ends where the next begins."""

    def __init__(self, attribute: str) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, list[list[tuple[str, int, int]]]]] = []
        self._attribute, self._blocks, self._open, self._hidden = attribute, [], [], 0

    def _span(self, attrs: dict, name: str) -> int:
        given = (attrs.get(name) or "1").strip()
        return min(1000, max(1, int(given))) if given.isdigit() else 1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        named = dict(attrs)
        self._hidden += tag in _HIDDEN
        if tag not in _VOID:
            self._blocks.append((tag, named.get(self._attribute) or (self._blocks[-1][1] if self._blocks else "")))
        if tag == "table":
            self._open.append([])
            if block := self._blocks[-1][1]:
                self.found.append((block, self._open[-1]))
        elif self._open and tag == "tr":
            self._open[-1].append([])
        elif self._open and tag in ("td", "th"):
            if not self._open[-1]:
                self._open[-1].append([])
            self._open[-1][-1].append(["", self._span(named, "rowspan"), self._span(named, "colspan")])

    def handle_endtag(self, tag: str) -> None:
        self._hidden = max(0, self._hidden - (tag in _HIDDEN))
        if tag in (t for t, _ in self._blocks):
            while self._blocks.pop()[0] != tag:
                pass
        if tag == "table" and self._open:
            self._open.pop()

    def handle_data(self, data: str) -> None:
        if self._open and self._open[-1] and self._open[-1][-1] and not self._hidden:
            self._open[-1][-1][-1][0] += data


def resolve_spans(rows: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """A rectangular matrix: a cell's text fills all the places it spans, places without a cell are empty."""
    grid: dict[tuple[int, int], str] = {}
    for y, row in enumerate(rows):
        x = 0
        for text, down, across in row:
            while (y, x) in grid:
                x += 1
            grid |= {(y + i, x + j): " ".join(text.split()) for i in range(min(down, len(rows) - y)) for j in range(across)}
            x += across
    width = max((x for _, x in grid), default=-1) + 1
    return [[grid.get((y, x), "") for x in range(width)] for y in range(len(rows))] if width else []


def table_grids(pages: DataFrame, key: str, attribute: str) -> DataFrame:
    """pages: key, html, whose blocks carry attribute. key, id, grids (matrices of the block's tables, each once)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for page, source in zip(pdf[key], pdf["html"], strict=True):
                parser = _Grids(attribute)
                parser.feed(source or "")
                kept: dict[str, list] = {}
                for block, rows in parser.found:
                    grid = resolve_spans(rows)
                    if grid and grid not in kept.setdefault(block, []):
                        kept[block].append(grid)
                out += [(page, block, grids) for block, grids in kept.items() if grids]
            yield pd.DataFrame(out, columns=[key, "id", "grids"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, "html").mapInPandas(run, f"`{key}` {kind}, id string, grids array<array<array<string>>>")

"""Typed elements of parsed filings: clean text, classes, headings, navigation, items and contexts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstrata.functions.text import nfc, normalize_space, strip

# Characters and patterns of parsed filings.
SPACES, DROPPED = "\u00a0\u202f", "\ufeff\u200b\u200c\u200d\u2060\u00ad"
BULLET = r"(^|\n)\s*(?:[•▪◦‣-])\s+"
SENTENCE_END = r"[.!?](?:\s|$)"
WORD = r"(?U)\b[\w'-]+\b"
UNIT = r"(?i)\b(?:(?:amounts?|dollars)\s+in|in)\s+(?:thousands|millions|billions)(?:\s+of\s+(?:u\.s\.\s+)?dollars)?\b"
NAVIGATION_TITLES = ("table of contents", "form 10-k cross-reference index")
IGNORED_SECTIONS = ("forward looking statements", "table of contents")
ITEM, ITEM_START, PAGE_END = r"(?i)\bitem\s+\d{1,2}[a-c]?\b", r"(?i)^item\s+(\d{1,2}[a-c]?)(?:\s*[.\-:–—]|\s|$)", r"(?:\||\s)\d{1,3}\s*$"
SHORT = 120


def clean(text: Column, compose: bool = False) -> Column:
    """Zero-width characters and soft hyphens dropped, white space normalised; compose: canonical composition first."""
    return normalize_space(F.translate(nfc(text) if compose else text, SPACES + DROPPED, " " * len(SPACES)))


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\R"), strip), lambda x: x != "")


def _short(text: Column) -> Column:
    return (F.length(text) <= SHORT) & (F.regexp_count(text, F.lit(WORD)) <= 15) & ~text.rlike(r"[.!?;]$")


def element_class(text: Column) -> Column:
    """What a table element really is: list, heading or paragraph where it has one column of content, else table."""
    columns = F.coalesce(F.array_max(F.transform(_lines(text), lambda r: F.size(F.filter(F.split(r, r" \| "), lambda c: F.trim(c) != "")))), F.lit(0))
    plain = clean(text)
    heading = (F.size(_lines(text)) <= 2) & _short(plain) & ~plain.rlike(r"\d")
    return F.when(columns != 1, "table").when(text.rlike(BULLET), "list").when(heading, "heading").when((F.length(plain) > SHORT) & plain.rlike(SENTENCE_END), "paragraph").otherwise("table")


def is_heading_element(tag: Column, text: Column) -> Column:
    """A heading tag, or a short text whose letters (four at least) are all capitals."""
    return F.coalesce(F.lower(tag).rlike("^h[1-6]$"), F.lit(False)) | (_short(text) & F.regexp_replace(text, r"\P{L}", "").rlike(r"^\p{Lu}{4,}$"))


def is_navigation_element(text: Column, links: Column) -> Column:
    """A navigation title, rows of items with page numbers, or a short text of which half is in three or more links."""
    plain, dense = clean(F.replace(text, F.lit("|"), F.lit(" "))), lambda x: F.length(F.regexp_replace(x, r"(?U)\s", ""))
    titled = F.lit(False)
    for t in NAVIGATION_TITLES:
        titled = titled | F.lower(plain).startswith(t)
    rows, named = F.transform(_lines(text), lambda x: clean(x)), F.filter(F.transform(links, lambda x: clean(x)), lambda x: x != "")
    listed = (F.size(rows) >= 3) & (F.size(F.filter(rows, lambda r: r.rlike(ITEM))) >= 2) & (F.size(F.filter(rows, lambda r: r.rlike(PAGE_END))) >= 3)
    ratio = F.aggregate(named, F.lit(0), lambda n, x: n + dense(x)) / F.nullif(dense(plain), F.lit(0))
    return titled | listed | ((F.size(named) >= 3) & (F.length(plain) <= 800) & F.coalesce(ratio >= 0.5, F.lit(False)))


def useful_section(title: Column) -> Column:
    """The normalised title, null where blank or one of the ignored."""
    plain = normalize_space(title)
    key = F.trim(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", " "))
    ignored = plain == ""
    for start in IGNORED_SECTIONS:
        ignored = ignored | key.startswith(start)
    return F.when(~ignored, plain)


def scale_unit(header: Column, description: Column) -> Column:
    """The scale named by the header, else by the description."""
    found = lambda x: F.nullif(normalize_space(F.regexp_extract(x, UNIT, 0)), F.lit(""))
    return F.coalesce(found(header), found(description))


def table_context(section: Column, header: Column, description: Column) -> Column:
    """Lines of section, description and unit, as far as known; null without any."""
    title = useful_section(section)
    said = F.when(~description.eqNullSafe(title), F.nullif(description, F.lit("")))
    lines = (("Section", title), ("Description", said), ("Unit", scale_unit(header, description)))
    return F.nullif(F.concat_ws("\n", *(F.concat(F.lit(f"{n}: "), v) for n, v in lines)), F.lit(""))


def item_starts(elements: DataFrame) -> DataFrame:
    """elements: doc, place, text. Adds started: the item's number, in upper case, that begins at the row, or null.

    A heading may be spread over up to three elements, together of at most 120 characters.
    """
    order = Window.partitionBy("doc").orderBy("place")
    joined = lambda n: clean(F.replace(F.concat_ws(" ", *(F.lead("text", i).over(order) if i else F.col("text") for i in range(n))), F.lit("|"), F.lit(" ")))
    found = lambda n: F.when(F.length(F.col(f"__qs_{n}")) <= SHORT, F.nullif(F.upper(F.regexp_extract(f"__qs_{n}", ITEM_START, 1)), F.lit("")))
    rows = elements.withColumns({f"__qs_{n}": joined(n) for n in (1, 2, 3)}).withColumn("started", F.coalesce(*(found(n) for n in (1, 2, 3))))
    return rows.drop("__qs_1", "__qs_2", "__qs_3")


def filled_items(elements: DataFrame) -> DataFrame:
    """elements: doc, place, text. Adds item: the last one that began at or before the row."""
    upto = Window.partitionBy("doc").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return item_starts(elements).withColumn("item", F.concat(F.lit("Item "), F.last("started", ignorenulls=True).over(upto))).drop("started")

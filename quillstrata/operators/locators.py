"""Short texts that lead to a table: row locators with header paths, glossary and narrative locators, labels for proxies.

Rows and contexts are windows over a table's rows; only packing under a token bound calls the injected tokenizer.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstrata.functions import matrices as M
from quillstrata.functions import text as X
from quillstrata.operators.records import word_tokens

DATA_MOST, TEXT_MOST, MOST_LABELS = 512, 1024, 100

# Label and cell patterns of tables.
NUMBER = r"(?i)^[$€£]?\s*\(?\s*[+\-−]?(?:\d{1,3}(?:,\d{3})*(?:\.\d+)?|\d+(?:\.\d+)?|\.\d+)\s*%?\s*\)?\s*(?:\([a-z0-9]+\))?$"
SYMBOL = r"(?i)^(?:[$€£%]|[-–—−]+|n/?m)$"
FOOTNOTE = r"(?i)^(?:\([a-z0-9]+\)\s*)+$"
YEAR = r"^(?:19|20)\d{2}$"
MISSING = r"(?i)^(?:n/?a|n/?m|not applicable|not meaningful)$"
DATA_CELL = r"(?i)^\s*(?:\(?\$?\s*[+-]?\d[\d,]*(?:\.\d+)?%?\s*\)?(?:\s*\([a-z0-9]+\))?|[-–—]|n/?a|n\.?m\.?)\s*$"
YEAR_CELL = r"(?i)^(?:19|20)\d{2}(?:\s*\([a-z0-9]+\))?$"
TABLE_INTRO = r"(?i)\b(?:following|below|table|summari(?:zes|zed)|shows?|sets?\s+forth|presents?|reflects?|details?)\b"
UNITS = (
    (r"\bshares?\s+in\s+thousands\b", "shares in thousands"),
    (r"\bdollars?\s+per\s+share\b", "dollars per share"),
    (r"(?:\bdollars?\b|\$)\s*(?:amounts?\s+)?in\s+millions\b", "dollars in millions"),
    (r"\bin\s+millions\b", "in millions"),
    (r"(?:\bdollars?\b|\$)\s*(?:amounts?\s+)?in\s+thousands\b", "dollars in thousands"),
    (r"\bin\s+thousands\b", "in thousands"),
    (r"\bin\s+billions\b", "in billions"),
    (r"\bbasis\s+points?\b", "basis points"),
    (r"%|\bpercent(?:age)?\b", "percent"),
)
BETTER = {"in millions": "dollars in millions", "in thousands": "dollars in thousands"}


def packed(count: Callable[[str], int], most: int, between: str = " | "):
    """Pandas UDF of (head, items): texts head + joined items, each as long as most allows; a longer item stands alone."""

    def pack(head: str, items: list[str]) -> list[str]:
        out, at = [], 0
        for end in range(1, len(items) + 1):
            if end == len(items) or count(head + between.join(items[at : end + 1])) > most:
                out.append(head + between.join(items[at:end]))
                at = end
        return out

    @F.pandas_udf("array<string>")
    def run(heads: pd.Series, items: pd.Series) -> pd.Series:
        return pd.Series([pack(h or "", list(i)) for h, i in zip(heads, items, strict=True)])

    return run


def locator_head(ticker: Column, entity: Column, report_date: Column, section: Column, title: Column, unit: Column) -> Column:
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    shown = F.when(~title.eqNullSafe(section), title)
    return F.concat_ws("\n", *(line(n, v) for n, v in (("Bank", ticker), ("Entity", entity), ("Report date", report_date), ("Section", F.nullif(section, F.lit(""))), ("Table", F.nullif(shown, F.lit(""))), ("Unit", unit))))


def _labels(cells: Column) -> Column:
    """Distinct cells that are neither blank nor values."""
    return M.unique(F.filter(cells, lambda c: ~X.is_value(c)))


def table_locators(tables: DataFrame, count: Callable[[str], int] = word_tokens) -> DataFrame:
    """tables: table_id, table_type, cell_matrices, head. Rows (table_id, matrix, row, part, scope, document).

    Layout and index tables have none. A glossary row leads by its term, a narrative table by its first labels, a data
    row by its label path and the header paths of its values; a data matrix without such rows by its labels alone.
    """
    wanted = tables.where(~F.col("table_type").isin("layout", "index"))
    whole = wanted.select("table_id", "table_type", "head", F.posexplode("cell_matrices").alias("matrix", "m"))
    return _row_locators(whole, count).unionByName(_plain_locators(whole))


def _plain_locators(whole: DataFrame) -> DataFrame:
    cells = M.unique(F.col("r"))
    rows = whole.where("table_type = 'glossary'").select("*", F.posexplode("m").alias("row", "r")).where(F.size(cells) >= 2)
    glossary = rows.select("table_id", "matrix", "row", F.lit(0).alias("part"), F.lit("glossary_entry").alias("scope"), F.concat(F.col("head"), F.lit("\nTerm: "), cells[0], F.lit("\nDefinition: "), F.array_join(F.slice(cells, 2, F.size(cells)), " ")).alias("document"))
    labels = _labels(F.flatten("m"))
    stories = whole.where("table_type = 'narrative_table'").where(F.size(labels) > 0)
    narrative = stories.select("table_id", "matrix", F.lit(None).cast("int").alias("row"), F.lit(0).alias("part"), F.lit("narrative").alias("scope"), F.concat(F.col("head"), F.lit("\nTable content: "), F.array_join(F.slice(labels, 1, MOST_LABELS), " ")).alias("document"))
    return glossary.unionByName(narrative)


def _row_locators(whole: DataFrame, count: Callable[[str], int]) -> DataFrame:
    alone = lambda r: (F.size(M.unique(r)) == 1) & X.is_period(M.unique(r)[0])
    start = M.first_data_row(F.col("m"))
    data = whole.where("table_type = 'data_table'").withColumns({"start": start, "header": F.slice("m", 1, start), "tracked": F.size(F.filter("m", alone)) >= 2})
    rows = data.select("table_id", "matrix", "head", "start", "header", "tracked", F.posexplode("m").alias("row", "r"))
    rows = rows.withColumn("places", F.filter(F.transform("r", lambda c, i: F.when(X.is_value(c), i)), lambda i: i.isNotNull()))
    labels, body = M.unique(F.col("r")), F.col("row") >= F.col("start")
    context = F.filter(labels, lambda c: ~X.is_period(c))
    group = F.col("tracked") & alone(F.col("r")) & (~body | (F.size("places") == 0))
    resets = group & body
    own = F.when(resets, F.array().cast("array<string>")).when(~body & (F.size(context) == 1), context).when(body & (F.size("places") == 0) & (F.size(context) > 0), context)
    order = Window.partitionBy("table_id", "matrix").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(order), F.array().cast("array<string>"))
    rows = rows.withColumns({"group": held(F.when(group, labels)), "context": held(own)})
    left = M.unique(F.slice("r", 1, F.greatest(F.col("places")[0], F.lit(0))))
    path = F.array_distinct(F.concat("group", "context", left))
    named = lambda i: M.unique(F.transform("header", lambda h: F.coalesce(F.get(h, i), F.lit(""))))
    columns = F.transform("places", lambda i: F.concat(F.when(F.size(named(i)) > 0, F.array_join(named(i), " > ")).otherwise(F.concat(F.lit("Column "), (i + 1).cast("string"))), F.lit(": "), X.normalize_space(F.get("r", i))))
    hits = rows.where(body & (F.size("places") > 0)).withColumns({"path": path, "items": columns}).where(F.size("path") > 0)
    lead = F.concat(F.col("head"), F.lit("\nMeasure or row: "), F.array_join("path", " > "), F.lit("\nColumn context: "))
    of_rows = hits.select("table_id", "matrix", "row", F.posexplode(packed(count, DATA_MOST)(lead, F.col("items"))).alias("part", "document")).withColumn("scope", F.lit("row"))
    bare = data.join(hits.select("table_id", "matrix").distinct(), ["table_id", "matrix"], "left_anti").withColumn("items", _labels(F.flatten("m"))).where(F.size("items") > 0)
    of_schema = bare.select("table_id", "matrix", F.lit(None).cast("int").alias("row"), F.posexplode(packed(count, TEXT_MOST)(F.concat(F.col("head"), F.lit("\nTable fields: ")), F.col("items"))).alias("part", "document")).withColumn("scope", F.lit("table_schema"))
    return of_rows.unionByName(of_schema)


def label(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)\s+", " "), r"^[ |]+|[ |]+$", "")


def is_ignored_label(value: Column) -> Column:
    """Blank, a number that is no year, a symbol, footnotes or a word for a missing value."""
    x = label(value)
    return (x == "") | (~x.rlike(YEAR) & (x.rlike(NUMBER) | x.rlike(SYMBOL))) | x.rlike(FOOTNOTE) | x.rlike(MISSING)


def unique_labels(values: Column) -> Column:
    """Labels without regard to case; the first spelling stays."""
    clean = F.filter(F.transform(values, label), lambda x: x != "")
    keys = F.transform(clean, F.lower)
    return F.filter(F.transform(clean, lambda x, i: F.when(F.array_position(keys, F.lower(x)) == i + 1, x)), lambda x: x.isNotNull())


def _cells(text: Column) -> Column:
    return F.filter(F.flatten(F.transform(F.split(text, r"\R"), lambda line: F.split(line, r"\|"))), lambda c: ~is_ignored_label(c))


def proxy_columns(header: Column) -> Column:
    return unique_labels(_cells(F.coalesce(header, F.lit(""))))


def proxy_rows(text: Column, header: Column) -> Column:
    """Labels of the lines that are not the header's, without the header's labels."""
    heads = F.transform(F.split(F.coalesce(header, F.lit("")), r"\R"), lambda x: F.lower(label(x)))
    body = F.array_join(F.filter(F.split(F.coalesce(text, F.lit("")), r"\R"), lambda x: ~F.array_contains(heads, F.lower(label(x)))), "\n")
    known = F.transform(proxy_columns(header), F.lower)
    return unique_labels(F.filter(_cells(body), lambda c: ~F.array_contains(known, F.lower(label(c)))))


def proxy_units(*texts: Column) -> Column:
    """Units named in the texts; the plain scale is left out where the one in dollars is named."""
    source = F.lower(F.concat_ws(" ", *texts))
    found = {name: source.rlike(pattern) for pattern, name in UNITS}
    kept = [F.when(hit & ~found[BETTER[name]] if name in BETTER else hit, F.lit(name)) for name, hit in found.items()]
    return F.filter(F.array(*kept), lambda x: x.isNotNull())


def proxy_text(ticker: Column, report_date: Column, item: Column, section: Column, context: Column, columns: Column, rows: Column, units: Column) -> Column:
    """Lines of what is known; blank parts are left out."""
    listed = lambda a: F.nullif(F.array_join(a, "; "), F.lit(""))
    year = F.when(report_date.rlike(r"^\d{4}"), F.substring(report_date, 1, 4)).otherwise(report_date)
    parts = (("SEC item", F.nullif(item, F.lit(""))), ("Section", F.nullif(section, F.lit(""))), ("Context", F.nullif(context, F.lit(""))), ("Columns", listed(columns)), ("Rows", listed(rows)), ("Units", listed(units)))
    return F.concat_ws("\n", F.concat(F.lit("Bank: "), ticker), F.concat(F.lit("Report: "), year, F.lit(" 10-K")), *(F.concat(F.lit(f"{n}: "), v) for n, v in parts))


def header_rows(text: Column) -> Column:
    """Up to three leading lines ("a | b") before the first line with a value beyond its first cell; years are no values."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\R"), X.strip), lambda x: x != "")
    valued = F.transform(F.slice(lines, 1, 3), lambda x: F.exists(F.slice(F.split(x, r" \| "), 2, F.size(F.split(x, r" \| "))), lambda c: F.trim(c).rlike(DATA_CELL) & ~F.trim(c).rlike(YEAR_CELL)))
    first = F.array_position(valued, True)
    return F.slice(lines, 1, F.when(first > 0, first - 1).otherwise(F.lit(3)).cast("int"))


def introductions(elements: DataFrame, back: int = 3, most: int = 400) -> DataFrame:
    """elements: doc, place, kind, text, item, section, navigation. doc, place, introduction (null without one) of each table.

    The nearest of the back elements before the table that says it introduces one; the search ends at navigation, another
    table, or another item or section.
    """
    order = Window.partitionBy("doc").orderBy("place")
    seen = F.struct("kind", X.normalize_space(F.col("text")).alias("text"), "item", "section", F.coalesce("navigation", F.lit(False)).alias("navigation"))
    rows = elements.withColumn("before", F.filter(F.array(*(F.lag(seen, i).over(order) for i in range(1, back + 1))), lambda x: x.isNotNull())).where("kind = 'table'")
    ends = lambda x: x["navigation"] | (x["kind"] == "table") | ~x["item"].eqNullSafe(F.col("item")) | ~x["section"].eqNullSafe(F.col("section"))
    end = F.array_position(F.transform("before", ends), True)
    near = F.slice("before", 1, F.when(end > 0, end - 1).otherwise(F.lit(back)).cast("int"))
    says = F.filter(near, lambda x: x["kind"].isin("paragraph", "list") & (F.length(x["text"]) <= most) & x["text"].rlike(TABLE_INTRO))
    return rows.select("doc", "place", F.get(says, F.lit(0))["text"].alias("introduction"))


def table_parts(count: Callable[[str], int], most: int = 700):
    """Pandas UDF of (header, rows): parts of at most most tokens, each under the header; a longer row is cut by words."""

    def cut(head: str, row: str) -> list[str]:
        words, out, at = row.split(), [], 0
        for end in range(1, len(words) + 1):
            if end == len(words) or count(head + " ".join(words[at : end + 1])) > most:
                out.append(head + " ".join(words[at:end]))
                at = end
        return out

    def parts(header: str, rows: list[str]) -> list[str]:
        head, out, open_ = header + "\n" if header else "", [], []
        for row in rows:
            if open_ and count(head + "\n".join([*open_, row])) > most:
                out.append(head + "\n".join(open_))
                open_ = []
            if count(head + row) > most:
                out += cut(head, row)
            else:
                open_.append(row)
        return [*out, head + "\n".join(open_)] if open_ else out or [header] * bool(header)

    @F.pandas_udf("array<string>")
    def run(headers: pd.Series, rows: pd.Series) -> pd.Series:
        return pd.Series([parts(h or "", list(r)) for h, r in zip(headers, rows, strict=True)])

    return run

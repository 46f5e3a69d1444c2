"""Tables inside text: markdown matrices, header paths, row labels, classes and descriptions, as column expressions.

A matrix is array<array<string>> (rows may be ragged); a table has an array of matrices.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstrata.functions.text import is_period, is_value, normalize_space, strip, table_unit

SEPARATOR = r"^\s*\|?(?:\s*:?-+:?\s*\|)+\s*$"
MOST_COLUMNS = 16

# Markers of table classes.
INDEX_MARKERS = ("table of contents", "form 10-k index", "cross-reference index", "documents incorporated by reference")
GLOSSARY_MARKERS = ("glossary of terms", "term definition", "acronym definition")
LAYOUT_MARKERS = (
    "commission file", "commission file number", "state or other jurisdiction of incorporation", "i.r.s. employer identification", "address of principal executive offices",
    "registrant's telephone number", "securities registered pursuant", "indicate by check mark", "large accelerated filer", "emerging growth company",
)
COVER_HEADERS = ("title of each class", "trading symbol", "name of each exchange")


def unique(values: Column) -> Column:
    return F.array_distinct(F.filter(values, lambda x: strip(x) != ""))


def markdown_matrices(text: Column) -> Column:
    """Blocks of consecutive lines that start with a pipe; separator rows are dropped and cells' white space normalised."""
    marked = F.transform(F.split(text, r"\R"), lambda x: F.when(F.ltrim(x).startswith("|"), F.trim(x)).otherwise(F.lit("")))
    # A NUL joins lines and an empty line ends a block, so blocks come out by splitting.
    blocks = F.filter(F.split(F.array_join(marked, "\0"), "\0\0+|^\0|\0$"), lambda b: b != "")
    row = lambda line: F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|", -1), normalize_space)
    rows = lambda block: F.transform(F.filter(F.split(block, "\0"), lambda x: (x != "") & ~x.rlike(SEPARATOR)), row)
    return F.filter(F.transform(blocks, rows), lambda m: F.size(m) > 0)


def _first_value(row: Column) -> Column:
    """1-based place of the first value cell, 0 without one."""
    return F.array_position(F.transform(row, is_value), True)


def first_data_row(matrix: Column) -> Column:
    """0-based: the first row with a value that a non-blank cell precedes, else 1 (0 for an empty matrix)."""
    hit = F.array_position(F.transform(matrix, lambda r: (_first_value(r) > 1) & F.exists(F.slice(r, 1, F.greatest(_first_value(r) - 1, F.lit(0)).cast("int")), lambda c: normalize_space(c) != "")), True)
    return F.when(hit > 0, hit - 1).otherwise(F.least(F.lit(1), F.size(matrix))).cast("int")


def _width(matrix: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(matrix, F.size)), F.lit(0))


def column_labels(matrices: Column) -> Column:
    def of(matrix: Column) -> Column:
        header = F.slice(matrix, 1, first_data_row(matrix))
        places = F.when(_width(matrix) > 0, F.sequence(F.lit(0), _width(matrix) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.array_join(unique(F.transform(header, lambda r: F.coalesce(F.get(r, i), F.lit("")))), " > "))

    return F.slice(unique(F.flatten(F.transform(matrices, of))), 1, MOST_COLUMNS)


def row_labels(matrices: Column) -> Column:
    def of(matrix: Column) -> Column:
        body = F.slice(matrix, first_data_row(matrix) + 1, F.greatest(F.size(matrix), F.lit(1)))
        left = lambda r: F.when(_first_value(r) > 0, F.slice(r, 1, F.greatest(_first_value(r) - 1, F.lit(0)).cast("int"))).otherwise(F.slice(r, 1, 1))
        return F.filter(F.transform(F.flatten(F.transform(body, left)), normalize_space), lambda c: (c != "") & ~is_period(c))

    return unique(F.flatten(F.transform(matrices, of)))


def _any(text: Column, markers: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for m in markers:
        found = found | F.contains(text, F.lit(m))
    return found


def table_class(text: Column, matrices: Column) -> Column:
    """layout, index, glossary, narrative_table or data_table."""
    rows = F.flatten(matrices)
    cells = F.filter(F.transform(F.flatten(rows), normalize_space), lambda c: c != "")
    whole = F.lower(normalize_space(text))
    head = F.lower(F.array_join(F.filter(F.transform(F.flatten(F.flatten(F.transform(matrices, lambda m: F.slice(m, 1, 3)))), normalize_space), lambda c: c != ""), " "))
    has = lambda t, m: F.contains(t, F.lit(m))
    page = head.rlike(r"\bpage\b")
    index = (
        _any(whole, INDEX_MARKERS) | (has(head, "incorporated documents") & has(head, "where incorporated")) | (has(head, "table description page") & has(whole, "table reference"))
        | (has(head, "notes to consolidated financial statements") & page) | (whole.rlike(r"\bitem\s+\d+[a-c]?\b") & page)
    )
    cover = has(head, COVER_HEADERS[0]) & has(head, COVER_HEADERS[1]) & has(head, COVER_HEADERS[2])
    share = lambda f: F.size(F.filter(cells, f)) / F.greatest(F.size(cells), F.lit(1))
    numeric, long = share(lambda c: c.rlike(r"\d|[$€£¥%]")), share(lambda c: F.size(F.split(c, " ")) >= 12)
    small = (F.array_max(F.transform(matrices, F.size)) <= 1) | (F.array_max(F.transform(rows, F.size)) <= 1)
    shaped = F.when(small, F.when(long >= 0.5, "narrative_table").otherwise("layout")).when((numeric < 0.08) & (long >= 0.35), "narrative_table").otherwise("data_table")
    return F.when(F.size(cells) <= 0, "layout").when(index, "index").when(_any(F.concat_ws(" ", head, whole), GLOSSARY_MARKERS), "glossary").when(_any(whole, LAYOUT_MARKERS) | cover, "layout").otherwise(shaped)


def _before_table(text: Column) -> Column:
    return F.substring_index(text, "|", 1)


def table_title(text: Column) -> Column:
    """The last short line before the first pipe, else the first header cell."""
    lines = F.transform(F.split(_before_table(text), r"\R"), lambda x: F.regexp_replace(normalize_space(F.regexp_replace(x, "[*_#]+", "")), "[.:]+$", ""))
    short = F.filter(lines, lambda x: (x != "") & (F.length(x) <= 180))
    heads = F.transform(F.filter(F.split(text, r"\R"), lambda x: F.ltrim(x).startswith("|")), lambda x: normalize_space(F.split(F.regexp_replace(F.trim(x), r"^\|+|\|+$", ""), r"\|")[0]))
    first = F.get(F.filter(heads, lambda c: (c != "") & ~c.rlike("^:?-+:?$")), F.lit(0))
    return F.coalesce(F.try_element_at(short, F.lit(-1)), F.substring(first, 1, 180))


def table_introduction(text: Column) -> Column:
    parts = F.filter(F.transform(F.split(_before_table(text), r"\n\s*\n"), lambda x: F.regexp_replace(normalize_space(F.regexp_replace(x, "[*_#]+", "")), r"^[ .:]+|[ .:]+$", "")), lambda x: x != "")
    said = F.rtrim(F.substring(F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), " "), 1, 500))
    return F.coalesce(F.nullif(said, F.lit("")), table_title(text), F.lit("No separate introduction was emitted with this table."))


def table_description(text: Column, matrices: Column) -> Column:
    """Introduction, columns, units and row labels; no numeric body."""
    listed = lambda labels: F.when(F.size(labels) > 0, F.array_join(labels, "; ")).otherwise("Not identified")
    parts = (("Introduction: ", table_introduction(text)), ("Columns/periods: ", listed(column_labels(matrices))), ("Units: ", F.coalesce(table_unit(text), F.lit("Not stated"))), ("Significant rows: ", listed(row_labels(matrices))))
    return F.concat_ws("\n", *(F.concat(F.lit(name), value) for name, value in parts))

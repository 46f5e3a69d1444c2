"""Text functions of the retrieval pipeline as column expressions (Column -> Column), plus identities and record texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns of filings.
# The text is in lower case, so a capital can stand for any letter beyond ASCII: \w need not know Unicode.
TOKEN = r"(?<!\w)[a-z0-9]+(?:[._-][a-z0-9]+)*%?(?!\w)"
BEYOND_ASCII = r"[^\x00-\x7F]"
WIDE_WORD = r"[[^\x00-\x7F]&&[\p{L}\p{N}]]"
SEC_ITEM = r"(?im)^(?:\*\*|__)?\s*item\s+(\d{1,2}[a-c]?)\s*[.:]"
SECTION_TITLE = r"^\s*(?:\*\*|__)([^*\n]{1,160})(?:\*\*|__)"
NAVIGATION = ("**form 10-k index**", "form 10-k index", "**table of contents**", "table of contents")
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
PERIOD = rf"(?i)\b(?:19|20)\d{{2}}\b|\b(?:{MONTHS})\b|\b(?:first|second|third|fourth)\s+quarter\b"
VALUE = r"(?i)^(?:[$€£¥]\s*)?\(?[-+]?\d[\d,\s]*(?:\.\d+)?\)?\s*(?:%|x|bps)?\s*(?:\([a-z]{1,3}\))?$"
BLANK_VALUES = ("-", "—", "–", "nm", "n/m", "na", "n/a", "yes", "no")


def _normalized(form: str):
    @F.pandas_udf(T.StringType())
    def normal(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import unicodedata

        for s in batches:
            yield s.map(lambda x: None if x is None else unicodedata.normalize(form, x))

    return normal


#: Compatibility composition, and canonical composition alone, as pandas UDFs.
nfkc, nfc = _normalized("NFKC"), _normalized("NFC")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


# Characters beyond these may change by compatibility composition; most texts hold none.
NFKC_STABLE = r"\x00-\x9F\u00A1-\u00A7\u00A9\u00AB-\u00AE\u00B0\u00B1\u00B6\u00B7\u00BB\u00BF-\u0131\u2010\u2012-\u2015\u2018-\u2022\u20AC"


def composed(text: Column) -> Column:
    """NFKC; only texts that it may change go through the pandas UDF.

    ASCII is told apart first, whole texts of it by their bytes: a class of many ranges is slow on each character.
    """
    wide = F.octet_length(text) != F.length(text)
    return F.coalesce(nfkc(F.when(wide & text.rlike(rf"[{BEYOND_ASCII}&&[^{NFKC_STABLE}]]"), text)), text)


def normalize_lexical(text: Column, compose: bool = True) -> Column:
    """NFKC (left out without compose), dashes to hyphens, commas between digits removed."""
    plain = composed(text) if compose else text
    for dash in "–—":
        plain = F.replace(plain, F.lit(dash), F.lit("-"))
    return F.regexp_replace(plain, r",(?<=\d,)(?=\d)", "")


def token_text(text: Column, compose: bool = True) -> Column:
    """What TOKEN is looked for in: in lower case, with a capital for each letter beyond ASCII."""
    low = F.lower(normalize_lexical(text, compose))
    return F.when(low.rlike(BEYOND_ASCII), F.regexp_replace(low, WIDE_WORD, "A")).otherwise(low)


def financial_tokens(text: Column, compose: bool = True) -> Column:
    return F.regexp_extract_all(token_text(text, compose), F.lit(TOKEN), F.lit(0))


def is_navigation(text: Column) -> Column:
    low = F.lower(normalize_space(text))
    found = low == ""
    for start in NAVIGATION:
        found = found | low.startswith(start)
    return found


def is_page_furniture(text: Column, footer: str | None = None) -> Column:
    """Blank, a page number, or a match of the issuer's footer pattern (of the whole text)."""
    plain = normalize_space(text)
    found = (plain == "") | plain.rlike(r"^\d{1,4}$")
    return found | plain.rlike(f"^(?:{footer})$") if footer else found


def sec_item(text: Column) -> Column:
    """The item number that a heading in the first 500 characters names, in upper case, or null."""
    return F.nullif(F.upper(F.regexp_extract(F.substring(text, 1, 500), SEC_ITEM, 1)), F.lit(""))


def section_title(text: Column) -> Column:
    return F.nullif(F.regexp_replace(normalize_space(F.regexp_extract(text, SECTION_TITLE, 1)), r"[.:]+$", ""), F.lit(""))


def is_heading_start(text: Column) -> Column:
    return section_title(text).isNotNull() & (F.length(F.split(strip(text), "\n\n")[0]) <= 180)


def sentence_units(text: Column) -> Column:
    """Paragraphs cut at sentence ends that a capital, digit, star or bracket follows."""
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n"), strip), lambda p: p != "")
    cut = F.transform(parts, lambda p: F.filter(F.transform(F.split(p, r"(?<=[.!?])\s+(?=[A-Z0-9*(])"), strip), lambda s: s != ""))
    return F.flatten(cut)


def is_period(text: Column) -> Column:
    return normalize_space(text).rlike(PERIOD)


def is_value(text: Column) -> Column:
    plain = normalize_space(text)
    return (plain != "") & ~plain.rlike(PERIOD) & (F.lower(plain).isin(*BLANK_VALUES) | plain.rlike(VALUE))


def table_unit(text: Column) -> Column:
    plain = normalize_space(text)
    scale = F.lower(F.regexp_extract(plain, r"(?i)\b(?:dollars\s+)?in\s+(millions|billions|thousands)\b", 1))
    return F.when(scale != "", scale).when(plain.rlike(r"(?i)\bpercent(?:age)?\b"), "percent").when(plain.rlike(r"(?i)\bbasis points?\b"), "basis points")


def chunk_id(accession: Column, variant: str, child_key: Column, element_ids: Column, content: Column) -> Column:
    """Content-addressed identity: SHA-256 of the parts joined by NUL."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.sha2(F.concat_ws("\0", blank(accession), F.lit(variant), blank(child_key), blank(F.array_join(element_ids, ",")), blank(content)), 256)


def embedding_text(ticker: Column, entity: Column, report_date: Column, kind: Column, first: Column, last: Column, content: Column, section: Column | None = None) -> Column:
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    lines = [
        F.concat(F.lit("Bank: "), blank(ticker)),
        F.concat(F.lit("Entity: "), blank(F.coalesce(entity, ticker))),
        F.concat(F.lit("Report: "), F.substring(blank(report_date), 1, 4), F.lit(" 10-K")),
        F.concat(F.lit("Evidence type: "), kind),
        F.concat(F.lit("Internal pages: "), blank(first), F.lit("-"), blank(last)),
    ]
    if section is not None:
        lines.append(F.when(section != "", F.concat(F.lit("Section: "), section)))
    return F.concat_ws("\n", *lines, F.lit(""), blank(content))


def first_text(*columns: Column) -> Column:
    """The first that is not blank, stripped; the query fails where all are."""
    return F.coalesce(*(F.nullif(strip(c), F.lit("")) for c in columns), F.raise_error(F.lit("record without retrieval text")).cast("string"))


def field(name: str, metadata: str = "metadata") -> Column:
    """A field of the record, else of its metadata. A null at the top level counts as absent."""
    return F.coalesce(F.col(name), F.col(f"{metadata}.{name}"))

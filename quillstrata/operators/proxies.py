"""Table proxies and embedding records: short texts that stand for table parts, made by rule or by a model, and their checks.

chunks: chunk_id, element_type, text, ticker, report_date, sec_item, section_title, table_id, table_part_index,
table_part_count, table_header, table_context, and what else metadata names.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstrata.functions.text import strip
from quillstrata.operators import locators

# Versions that ids rest on, fields that a proxy shares with its table part, and fields of a record's metadata.
PROXY_VERSION, PROMPT_VERSION = "deterministic-v1", "table_proxy_v1"
LINK_FIELDS = ("ticker", "report_date", "sec_item", "section_title", "table_id", "table_part_index", "table_part_count")
METADATA_FIELDS = ("ticker", "cik", "accession_number", "filing_date", "report_date", "source_url", "sec_item", "section_title", "element_type", "order_start", "order_end", "token_count", "chunk_index", "table_id", "table_part_index", "table_part_count")
LISTS = ("topics", "column_labels", "row_labels", "units")
MOST_DESCRIPTION, MOST_ITEMS = 600, 40
INSTRUCTIONS = "Describe the table part for retrieval. Do not copy its numbers. Answer with one JSON object and nothing else."
SHAPE = '{"description": "what the table is about", "topics": ["..."], "column_labels": ["..."], "row_labels": ["..."], "units": ["..."]}'
AGAIN = "That was not one JSON object of the form asked for. Answer with that object only."


def _blank(value: Column) -> Column:
    return F.coalesce(strip(value.cast("string")) == "", F.lit(True))


def _field(rows: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in rows.columns else F.lit(None).cast(kind)


def proxy_id(target: Column, version: str = PROXY_VERSION) -> Column:
    return F.sha2(F.concat_ws("\0", F.lit(version), target), 256)


def model_proxy_id(target: Column, model: str, prompt: str = PROMPT_VERSION) -> Column:
    return F.sha2(F.concat_ws("\0", target, F.lit(model), F.lit(prompt)), 256)


def builtin_table_id(accession: Column, url: Column, place: Column) -> Column:
    return F.sha2(F.concat_ws("\0", accession, url, place.cast("string")), 256)


def builtin_chunk_id(accession: Column, index: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("\0", accession, index.cast("string"), text), 256)


def plain_context(context: Column) -> Column:
    """What a table's context says besides its section and unit, without the names of the lines, each once."""
    lines = F.transform(F.split(F.coalesce(context, F.lit("")), r"\R"), locators.label)
    kept = F.filter(lines, lambda x: ~x.rlike(r"(?i)^(?:section|unit)(?::|$)"))
    return F.array_join(locators.unique_labels(F.transform(kept, lambda x: F.regexp_replace(x, r"(?i)^(?:description|context):", ""))), " ")


def table_proxies(chunks: DataFrame) -> DataFrame:
    """A proxy for each table part: proxy_id, target_chunk_id, the link fields, element_type, proxy_text, proxy_version."""
    tables = chunks.where("element_type = 'table'")
    col = lambda c: _field(tables, c)
    header = F.coalesce(col("table_header"), F.lit(""))
    columns = locators.proxy_columns(header)
    label = lambda c: F.nullif(locators.label(col(c)), F.lit(""))
    said = locators.proxy_text(label("ticker"), label("report_date"), label("sec_item"), label("section_title"), F.nullif(plain_context(col("table_context")), F.lit("")), columns, locators.proxy_rows(col("text"), header), locators.proxy_units(F.coalesce(col("table_context"), F.lit("")), header, F.coalesce(col("text"), F.lit(""))))
    links = [_field(tables, c, "int" if "part" in c else "string").alias(c) for c in LINK_FIELDS]
    return tables.select(proxy_id(F.col("chunk_id")).alias("proxy_id"), F.col("chunk_id").alias("target_chunk_id"), *links, F.lit("table").alias("element_type"), said.alias("proxy_text"), F.lit(PROXY_VERSION).alias("proxy_version"))


def link_violations(chunks: DataFrame, proxies: DataFrame, fields: tuple[str, ...] = LINK_FIELDS) -> DataFrame:
    """Rows (rule, key): table parts and proxies that are not one to one, or differ in a field."""
    left = chunks.where("element_type = 'table'").select(F.col("chunk_id").alias("key"), *(F.col(c).alias(f"a_{c}") for c in fields), F.lit(1).alias("a"))
    right = proxies.select(F.col("target_chunk_id").alias("key"), *(F.col(c).alias(f"b_{c}") for c in fields), F.lit(1).alias("b"))
    pairs = left.join(right, "key", "full_outer")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    rules = [F.when(F.col("b").isNull(), "table without a proxy"), F.when(F.col("a").isNull(), "proxy without a table"), *(F.when(both & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), f"{c} differs") for c in fields)]
    named = F.filter(F.array(*rules), lambda r: r.isNotNull())
    return pairs.select(F.explode(named).alias("rule"), "key")


def proxy_violations(chunks: DataFrame, proxies: DataFrame, version: str = PROXY_VERSION) -> DataFrame:
    """Rows (rule, key) of what is wrong with proxies: ids, versions, texts, links and number."""
    repeated = lambda df, c, rule: df.groupBy(c).count().where("count > 1").select(F.lit(rule).alias("rule"), F.col(c).cast("string").alias("key"))
    text = F.coalesce(F.col("proxy_text"), F.lit(""))
    rules = [
        F.when(_blank(F.col("proxy_id")), "proxy without an id"), F.when(~F.col("proxy_version").eqNullSafe(F.lit(version)), "another version"), F.when(~F.col("proxy_id").eqNullSafe(proxy_id(F.col("target_chunk_id"), version)), "id does not follow from the target"),
        F.when(_blank(text), "empty proxy text"), F.when(F.contains(text, F.lit("SEC item: None")) | F.contains(text, F.lit("Section: None")), "label None in the text"),
    ]
    own = proxies.select(F.explode(F.filter(F.array(*rules), lambda r: r.isNotNull())).alias("rule"), F.col("target_chunk_id").alias("key"))
    tables = chunks.where("element_type = 'table'")
    unnamed = tables.where(_blank(F.col("chunk_id"))).select(F.lit("table without an id").alias("rule"), F.col("chunk_id").alias("key"))
    fields = tuple(c for c in LINK_FIELDS if c not in ("sec_item", "section_title"))
    return own.unionByName(unnamed).unionByName(repeated(tables, "chunk_id", "repeated table id")).unionByName(repeated(proxies, "proxy_id", "repeated proxy id")).unionByName(repeated(proxies, "target_chunk_id", "repeated target")).unionByName(link_violations(chunks, proxies, fields))


def scalar_metadata(rows: DataFrame, fields: tuple[str, ...] = METADATA_FIELDS, **more: Column) -> Column:
    """A JSON object of the scalar fields that are there and neither null nor empty."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    plain = [c for c in fields if c in kinds and not kinds[c].startswith(("array", "struct", "map"))]
    kept = [(F.nullif(F.col(c), F.lit("")) if kinds[c] == "string" else F.col(c)).alias(c) for c in plain]
    return F.to_json(F.struct(*kept, *(v.alias(n) for n, v in more.items())))


def text_embedding_text(ticker: Column, report_date: Column, item: Column, section: Column, document: Column) -> Column:
    """Bank, report, item and section as far as known, an empty line, and the stripped text."""
    known = lambda name, c: F.concat(F.lit(f"{name}: "), F.nullif(strip(c), F.lit("")))
    return F.concat_ws("\n", F.concat(F.lit("Bank: "), strip(ticker)), F.concat(F.lit("Report: "), F.substring(strip(report_date), 1, 4), F.lit(" 10-K")), known("SEC item", item), known("Section", section), F.lit(""), strip(document))


def record_violations(chunks: DataFrame, proxies: DataFrame) -> DataFrame:
    """Rows (rule, key) of chunks that give no record: blank fields, unknown types, repeated ids, proxies that don't fit."""
    need = [F.when(_blank(F.col(c)), f"blank {c}") for c in ("chunk_id", "text", "ticker", "report_date")]
    rules = F.array(*need, F.when(~F.coalesce(F.col("element_type").isin("text", "table"), F.lit(False)), "unknown type"))
    own = chunks.select(F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"), F.col("chunk_id").alias("key"))
    repeated = chunks.groupBy("chunk_id").count().where("count > 1").select(F.lit("repeated chunk id").alias("rule"), F.col("chunk_id").alias("key"))
    empty = proxies.select(F.explode(F.filter(F.array(*(F.when(_blank(F.col(c)), f"proxy with a blank {c}") for c in ("proxy_id", "proxy_text"))), lambda r: r.isNotNull())).alias("rule"), F.col("target_chunk_id").alias("key"))
    return own.unionByName(repeated).unionByName(empty).unionByName(link_violations(chunks, proxies))


def embedding_records(chunks: DataFrame, proxies: DataFrame) -> DataFrame:
    """record_id, record_type, embedding_text, document, target_chunk_id, metadata (JSON): a record a chunk.

    A text is embedded with its heading lines, a table part by its proxy. Check record_violations() first.
    """
    about = proxies.select(F.col("target_chunk_id").alias("chunk_id"), F.col("proxy_id").alias("__qs_id"), F.col("proxy_text").alias("__qs_text"), F.col("proxy_version").alias("__qs_version"))
    rows = chunks.join(about, "chunk_id", "left")
    table = F.col("element_type") == "table"
    own = text_embedding_text(F.col("ticker"), F.col("report_date"), _field(chunks, "sec_item"), _field(chunks, "section_title"), F.col("text"))
    metadata = scalar_metadata(rows, proxy_id=F.when(table, F.col("__qs_id")), proxy_version=F.when(table, F.col("__qs_version")))
    return rows.select(F.concat_ws("::", "element_type", F.when(table, F.col("__qs_id")).otherwise(F.col("chunk_id"))).alias("record_id"), F.col("element_type").alias("record_type"), F.when(table, strip(F.col("__qs_text"))).otherwise(own).alias("embedding_text"), strip(F.col("text")).alias("document"), F.col("chunk_id").alias("target_chunk_id"), metadata.alias("metadata"))


def first_json_object(text: str) -> dict:
    """The JSON object that begins at the first brace of a text; what follows it does not matter."""
    at = text.find("{")
    if at < 0:
        raise ValueError("no JSON object in the answer")
    found, _ = json.JSONDecoder().raw_decode(text, at)
    if not isinstance(found, dict):
        raise ValueError("the answer is no JSON object")
    return found


def clean_answer(found: dict) -> dict:
    """description and LISTS of an answer: white space normalised, blanks and repeats (in any case) dropped, lengths bounded."""
    said = " ".join(str(found.get("description") or "").split())
    if not said or len(said) > MOST_DESCRIPTION:
        raise ValueError(f"a description of 1 to {MOST_DESCRIPTION} characters is needed")
    out: dict = {"description": said}
    for name in LISTS:
        given = found.get(name)
        given = [] if given is None else [given] if isinstance(given, str) else given
        if not isinstance(given, list):
            raise ValueError(f"{name} is no list")
        kept: dict[str, str] = {}
        for item in given:
            plain = " ".join(str(item).split()).strip(" ;,")
            if plain:
                kept.setdefault(plain.casefold(), plain)
        out[name] = list(kept.values())[:MOST_ITEMS]
    return out


def prompt(row: dict) -> str:
    """What a model is asked about one table part."""
    about = {"bank": row.get("ticker"), **{c: row.get(c) for c in ("report_date", "sec_item", "section_title", "table_context", "table_header", "table_part_index", "table_part_count")}}
    return "\n\n".join([f"Answer in this form: {SHAPE}", "Known of the table: " + json.dumps(about, ensure_ascii=False, default=str), "Table:", str(row["text"])])


Generator = Callable[[list[dict[str, str]]], str]


def answered(generate: Generator, row: dict, attempts: int = 2) -> dict:
    """The cleaned answer of a model; one that does not fit is shown to it again, up to attempts times."""
    messages = [{"role": "system", "content": INSTRUCTIONS}, {"role": "user", "content": prompt(row)}]
    for attempt in range(1, attempts + 1):
        text = generate(messages)
        try:
            return clean_answer(first_json_object(text))
        except ValueError as error:
            if attempt == attempts:
                raise ValueError(f"no fitting answer in {attempts} attempts: {error}") from error
            messages += [{"role": "assistant", "content": text}, {"role": "user", "content": AGAIN}]
    raise ValueError("attempts must be at least 1")


def model_proxies(chunks: DataFrame, make: Callable[[], Generator], model: str, attempts: int = 2, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """proxy_id, target_chunk_id, table_id, proxy_text, model, error of each table part, by an injected generator.

    make builds the generator once a task. A part without a fitting answer has a null text and the error. include, exclude:
    tickers, in any case. Parts that are done already are left out by an anti-join before (append_missing does it).
    """
    tables = chunks.where("element_type = 'table'")
    if include:
        tables = tables.where(F.upper("ticker").isin(*(t.strip().upper() for t in include)))
    if exclude:
        tables = tables.where(~F.coalesce(F.upper("ticker").isin(*(t.strip().upper() for t in exclude)), F.lit(False)))
    fields = ["chunk_id", "table_id", "text", "ticker", "report_date", "sec_item", "section_title", "table_context", "table_header", "table_part_index", "table_part_count"]
    asked = tables.select(*(_field(tables, c, "int" if "part" in c else "string").alias(c) for c in fields))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = None
        for pdf in batches:
            generate = generate or make()
            texts, errors = [], []
            for row in pdf.to_dict("records"):
                try:
                    made = answered(generate, row, attempts)
                    lines = [made["description"], *(f"{name.replace('_', ' ').capitalize()}: {'; '.join(made[name])}" for name in LISTS if made[name])]
                    texts.append("\n".join(lines))
                    errors.append(None)
                except ValueError as error:
                    texts.append(None)
                    errors.append(str(error))
            yield pd.DataFrame({"target_chunk_id": pdf["chunk_id"], "table_id": pdf["table_id"], "proxy_text": texts, "error": errors})

    made = asked.mapInPandas(run, "target_chunk_id string, table_id string, proxy_text string, error string")
    return made.select(model_proxy_id(F.col("target_chunk_id"), model).alias("proxy_id"), "target_chunk_id", "table_id", "proxy_text", F.lit(model).alias("model"), "error")

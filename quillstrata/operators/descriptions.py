"""Descriptions of tables, by rule alone or with a model's synopsis after it, with what they were made by."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODES = ("local", "openai")
GENERATOR = "quillstrata-table-description-1"
PROVENANCE = "struct<mode:string,generator:string,provider:string,model:string,response_id:string>"
INSTRUCTIONS = "Say in plain text what this table of a filing is for and how its parts relate, as a help to search. The bank, report, section and pages are known; do not repeat them, and do not copy numbers."
MOST_ANSWER = 300

#: (model, instructions, prompt, most tokens) -> (text, response id or None)
Client = Callable[[str, str, str, int], tuple[str, str | None]]


def responses_client() -> Client:
    """A client of the responses API of the openai package, which must be installed."""
    from openai import OpenAI

    api = OpenAI()

    def ask(model: str, instructions: str, prompt: str, most: int) -> tuple[str, str | None]:
        answer = api.responses.create(model=model, instructions=instructions, input=prompt, max_output_tokens=most)
        return str(getattr(answer, "output_text", None) or ""), getattr(answer, "id", None)

    return ask


def prompt(row: dict) -> str:
    return "\n".join([f"Bank: {row['ticker'] or ''}", f"Report date: {row['report_date'] or ''}", f"Section: {row['section_title'] or 'Unassigned'}", f"Internal pages: {row['page_start']}-{row['page_end']}", "", "Original markdown table:", row["content"] or ""])


def described(tables: DataFrame, mode: str = "local", make: Callable[[], Client] = responses_client, model: str = "gpt-4o") -> DataFrame:
    """tables: table_id, local (the description by rule), content, ticker, report_date, section_title, page_start, page_end.

    table_id, description, provenance. In the mode openai a client, built once a task, adds a synopsis; a failed call or an
    empty answer fails the query: there is no silent way back to the local mode.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    none = F.lit(None).cast("string")
    if mode == "local":
        origin = F.struct(F.lit(mode).alias("mode"), F.lit(GENERATOR).alias("generator"), none.alias("provider"), none.alias("model"), none.alias("response_id"))
        return tables.select("table_id", F.col("local").alias("description"), origin.cast(PROVENANCE).alias("provenance"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = None
        for pdf in batches:
            ask = ask or make()
            texts, ids = [], []
            for row in pdf.to_dict("records"):
                try:
                    text, response = ask(model, INSTRUCTIONS, prompt(row), MOST_ANSWER)
                except Exception as error:
                    raise RuntimeError(f"no description of table {row['table_id']}") from error
                if not (text or "").strip():
                    raise RuntimeError(f"an empty description of table {row['table_id']}")
                texts.append(text.strip())
                ids.append(response)
            yield pd.DataFrame({"table_id": pdf["table_id"], "local": pdf["local"], "synopsis": texts, "response_id": ids})

    asked = tables.select("table_id", "local", "content", "ticker", "report_date", "section_title", "page_start", "page_end")
    made = asked.mapInPandas(run, "table_id string, local string, synopsis string, response_id string")
    origin = F.struct(F.lit(mode).alias("mode"), F.lit(GENERATOR).alias("generator"), F.lit("openai").alias("provider"), F.lit(model).alias("model"), F.col("response_id"))
    return made.select("table_id", F.concat("local", F.lit("\nLLM synopsis: "), "synopsis").alias("description"), origin.cast(PROVENANCE).alias("provenance"))

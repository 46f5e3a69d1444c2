"""From submission feeds to a manifest of filings: latest filing of a form, addresses, fetching, merging in registry order."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstrata.operators.records import latest_per_key, rows_of_arrays
from quillstrata.sources.leases import Slots

# Where filings are published.
ARCHIVE = "https://www.sec.gov/Archives/edgar/data/"
FIELDS = {"form": "form", "accessionNumber": "accession_number", "filingDate": "filing_date", "reportDate": "report_date", "primaryDocument": "primary_document"}


def required(value: Column, holds: Column, message: str) -> Column:
    """value, or a failed query where holds is not true."""
    return F.when(holds, value).otherwise(F.raise_error(F.lit(message)).cast("string"))


def is_safe_name(name: Column) -> Column:
    return ~name.isin(".", "..") & ~name.rlike(r"[/\\]") & ~name.rlike(r"^[A-Za-z]:")


def _faults(named: Column) -> list[tuple[Column, str]]:
    """What must hold of a company's row, with what is wrong where it doesn't."""
    digits = F.replace("accession_number", F.lit("-"), F.lit(""))
    return [
        (named, "feed lacks its ticker"), *((F.trim(c) != "", f"no filing, or a blank {c}") for c in FIELDS.values()),
        (is_safe_name(F.col("primary_document")), "unsafe file name"), (digits.rlike(r"^\d+$"), "bad accession number"),
    ]


def _addressed(rows: DataFrame) -> DataFrame:
    place = F.concat_ws("/", F.replace("accession_number", F.lit("-"), F.lit("")), "primary_document")
    return rows.withColumns({"source_url": F.concat(F.lit(ARCHIVE), F.col("cik").cast("long").cast("string"), F.lit("/"), place), "local_html_path": F.concat_ws("/", "cik", place)})


def judged_filings(feeds: DataFrame, form: str = "10-K") -> DataFrame:
    """As latest_filings, with what is wrong of a company in error (null where nothing is) instead of failing: one job for all feeds."""
    recent, named = F.col("recent"), F.coalesce(F.exists("tickers", lambda x: F.upper(x) == F.upper("ticker")), F.lit(False))
    entry = F.transform(F.col("recent.form"), lambda _, i: F.struct(*(F.get(recent[a], i).alias(b) for a, b in FIELDS.items())))
    # Uneven arrays have no entries; nothing is raised that a rule could move ahead of this.
    flat = feeds.select("cik", F.posexplode(F.when(~_uneven(recent), entry)).alias("place", "x")).select("cik", "place", "x.*")
    newest = latest_per_key(flat.where(F.col("form") == form), "cik", "filing_date", "place").drop("place")
    rows = feeds.select("cik", F.upper("ticker").alias("ticker"), "legal_name", named.alias("__qs_named"), _uneven(recent).alias("__qs_uneven")).join(newest, "cik", "left")
    error = F.when(F.col("__qs_uneven"), "parallel arrays differ in length")
    for holds, message in _faults(F.col("__qs_named")):
        error = error.when(~F.coalesce(holds, F.lit(False)), message)
    return _addressed(rows.withColumn("error", error)).drop("__qs_named", "__qs_uneven")


def _uneven(recent: Column) -> Column:
    sizes = [F.coalesce(F.size(recent[a]), F.lit(-1)) for a in FIELDS]
    return F.greatest(*sizes) != F.least(*sizes)


def latest_filings(feeds: DataFrame, form: str = "10-K") -> DataFrame:
    """feeds: cik, ticker, legal_name, tickers, recent (struct of parallel arrays). One row a company; amendments don't count.

    Ties of the filing date go to the earlier entry. A company without such a form, a feed without its ticker, a blank
    field, an unsafe file name or a bad accession number fails the query.
    """
    named = F.exists("tickers", lambda x: F.upper(x) == F.upper("ticker"))
    flat = feeds.select("cik", "legal_name", required(F.upper("ticker"), named, "feed lacks its ticker").alias("ticker"), *(F.col(f"recent.{a}").alias(b) for a, b in FIELDS.items()))
    newest = latest_per_key(rows_of_arrays(flat, *FIELDS.values()).where(F.col("form") == form), "cik", "filing_date", "place").drop("place")
    rows = feeds.select("cik").distinct().join(newest, "cik", "left")
    rows = rows.withColumns({c: required(F.col(c), F.trim(c) != "", f"no filing, or a blank {c}") for c in FIELDS.values()})
    digits = F.replace("accession_number", F.lit("-"), F.lit(""))
    rows = rows.withColumns({"primary_document": required(F.col("primary_document"), is_safe_name(F.col("primary_document")), "unsafe file name"), "accession_number": required(F.col("accession_number"), digits.rlike(r"^\d+$"), "bad accession number")})
    return _addressed(rows)


def fetched(rows: DataFrame, fetch: Callable[[str], bytes], per_second: float = 5.0, tasks: int = 1, slots: str | None = None) -> DataFrame:
    """Adds content (binary) from source_url, in so many tasks. A failed fetch gives a null content and its message in error.

    slots: a folder that all tasks see; the rate then holds over all of them, tasks that are run again included. Without it
    each task keeps to its share of the rate.
    """
    return _fetching(rows, fetch, per_second, tasks, slots, "content binary, error string", lambda pdf, url, body: body)


def downloaded(rows: DataFrame, fetch: Callable[[str], bytes], output: str, per_second: float = 5.0, tasks: int = 1, slots: str | None = None) -> DataFrame:
    """Fetches source_url into files at local_html_path below output, written by the tasks; adds size and error, no content.

    A file is moved to its place when it is whole, so one that is there stands for a finished download, and writing it
    again (a task that is run twice) changes nothing. output: a folder or an address that pyarrow's file systems know.
    """

    def save(place: str, _: str, body: bytes) -> int:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(output if "://" in output else "file://" + os.path.abspath(output))
        path = f"{base}/{place}"
        system.create_dir(os.path.dirname(path), recursive=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        with system.open_output_stream(part) as out:
            out.write(body)
        system.move(part, path)
        return len(body)

    return _fetching(rows, fetch, per_second, tasks, slots, "size long, error string", save)


def _fetching(rows: DataFrame, fetch: Callable[[str], bytes], per_second: float, tasks: int, slots: str | None, added: str, use: Callable) -> DataFrame:
    if not 0 < per_second <= 10 or tasks < 1:
        raise ValueError("per_second must be above 0 and at most 10, tasks at least 1")
    rows = rows.repartition(tasks)
    places = "local_html_path" in rows.columns
    name = added.split()[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lease = Slots(slots, per_second) if slots else None
        for pdf in batches:
            got = []
            for url, place in zip(pdf["source_url"], pdf["local_html_path"] if places else pdf["source_url"], strict=True):
                began = time.monotonic()
                if lease:
                    lease.wait()
                try:
                    got.append((use(place, url, fetch(url)), None))
                except Exception as failed:
                    got.append((None, f"{type(failed).__name__}: {failed}"))
                if not lease:
                    time.sleep(max(0.0, tasks / per_second - (time.monotonic() - began)))
            new = pd.Series([c for c, _ in got], dtype="Int64" if name == "size" else object, index=pdf.index)
            yield pdf.assign(**{name: new, "error": [e for _, e in got]})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{fields}, {added}")


# Where a company's feed is, and the fields of a feed that are read.
FEED = "https://data.sec.gov/submissions/CIK{cik}.json"
FEED_SCHEMA = "tickers array<string>, filings struct<recent:struct<form:array<string>,accessionNumber:array<string>,filingDate:array<string>,reportDate:array<string>,primaryDocument:array<string>>>"


def parsed_feeds(fetched_rows: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """fetched_rows: cik, ticker, legal_name, content (JSON bytes), error. What latest_filings reads, of the rows that came.

    mode PERMISSIVE: a feed that is no such JSON has no tickers and no filings.
    """
    feed = F.from_json(F.decode("content", "UTF-8"), FEED_SCHEMA, {"mode": mode})
    rows = fetched_rows.where("error is null").withColumn("feed", feed)
    return rows.select("cik", "ticker", "legal_name", F.col("feed.tickers").alias("tickers"), F.col("feed.filings.recent").alias("recent"))


def merge_manifest(old: DataFrame, new: DataFrame, registry: DataFrame) -> DataFrame:
    """New rows replace old ones by ticker; only enabled companies stay; place is that of the registry (ticker, enabled, place)."""
    both = old.withColumn("__qs_age", F.lit(0)).unionByName(new.withColumn("__qs_age", F.lit(1)))
    both = both.withColumn("ticker", required(F.upper(F.trim("ticker")), F.trim("ticker") != "", "manifest row without a ticker"))
    order = Window.partitionBy("ticker").orderBy(F.desc("__qs_age"))
    return both.withColumn("__qs_n", F.row_number().over(order)).where("__qs_n = 1").drop("__qs_n", "__qs_age").join(registry.where("enabled").select("ticker", "place"), "ticker")


def excluded(rows: DataFrame, *tickers: str) -> DataFrame:
    """Rows of other tickers than these (each may list several, comma-separated); a null ticker stays."""
    out = sorted({t.strip().upper() for a in tickers for t in a.split(",") if t.strip()})
    return rows.where(~F.coalesce(F.upper("ticker").isin(*out), F.lit(False))) if out else rows


def chosen(rows: DataFrame, *asked: str) -> DataFrame:
    """Rows of the tickers asked for (each may list several, comma-separated); all rows where none is. Unknown ones are an error."""
    wanted = {t.strip().upper() for a in asked for t in a.split(",") if t.strip()}
    if not wanted:
        return rows
    kept = rows.where(F.upper("ticker").isin(*sorted(wanted)))
    if missing := wanted - {r[0] for r in kept.select(F.upper("ticker")).distinct().limit(len(wanted)).collect()}:
        raise ValueError(f"unknown tickers: {sorted(missing)}")
    return kept

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from quillstrata.operators import ingest
from quillstrata.sources import leases, versions


def test_slots_are_claimed_once(tmp_path):
    """Tasks that share a folder, some of them started again, keep the rate together."""
    got = []

    def task():
        own = leases.Slots(str(tmp_path / "s"), 200)
        got.extend(own.wait() for _ in range(20))

    began = time.time()
    threads = [threading.Thread(target=task) for _ in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(set(got)) == len(got) == 120 and time.time() - began >= 119 / 200 - 0.02
    (tmp_path / "s" / "17").touch()
    own = leases.Slots(str(tmp_path / "s"), 200)
    own.claim()
    assert not (tmp_path / "s" / "17").exists()
    with pytest.raises(ValueError):
        leases.Slots(str(tmp_path / "s"), 0)


def test_fetches_run_twice_keep_the_rate(spark, tmp_path):
    """Two runs of the same rows at once, as speculation would have them, in several tasks each."""
    log, slots = str(tmp_path / "log"), str(tmp_path / "slots")

    def fetch(url):
        with open(log, "a") as f:
            f.write(f"{time.time()}\n")
        return url.encode()

    rows = spark.createDataFrame([(f"u{i}",) for i in range(8)], "source_url string")
    runs = [threading.Thread(target=lambda: ingest.fetched(rows, fetch, 10, 2, slots).collect()) for _ in range(2)]
    for t in runs:
        t.start()
    for t in runs:
        t.join()
    at = sorted(float(x) for x in open(log))
    assert len(at) == 16
    # No window of a second holds more than the rate, but for the jitter of one call.
    assert all(at[i + 11] - at[i] > 0.9 for i in range(len(at) - 11))


def test_files_are_written_by_tasks(spark, tmp_path):
    rows = spark.createDataFrame([("u1", "a/b.htm"), ("bad", "a/c.htm")], "source_url string, local_html_path string")

    def fetch(url):
        if url == "bad":
            raise OSError("gone")
        return url.encode()

    got = {r.source_url: (r.size, r.error) for r in ingest.downloaded(rows, fetch, str(tmp_path), 10, 2).collect()}
    assert got == {"u1": (2, None), "bad": (None, "OSError: gone")}
    assert [str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()] == ["a/b.htm"]


def test_feeds_are_judged_in_one_job(spark):
    recent = lambda **kw: {"form": ["10-K", "10-Q"], "accessionNumber": ["0-1", "0-2"], "filingDate": ["2026-01-01", "2026-02-01"], "reportDate": ["2025", "2025"], "primaryDocument": ["d.htm", "e.htm"], **kw}
    feed = lambda tickers, **kw: json.dumps({"tickers": tickers, "filings": {"recent": recent(**kw)}}).encode()
    rows = [("1", "a", "A", feed(["A"]), None), ("2", "b", "B", feed(["X"]), None), ("3", "c", "C", feed(["C"], primaryDocument=["../x", "e"]), None), ("4", "d", "D", b"no json", None), ("5", "e", "E", None, "OSError: gone"), ("6", "f", "F", feed(["F"], form=["8-K", "8-K"]), None), ("7", "g", "G", feed(["G"], form=["10-K"]), None), ("8", "h", "H", feed(["H"], accessionNumber=["x", "y"]), None)]
    fetched = spark.createDataFrame(rows, "cik string, ticker string, legal_name string, content binary, error string")
    got = {r.ticker: r for r in ingest.judged_filings(ingest.parsed_feeds(fetched, "PERMISSIVE")).collect()}
    assert {t: r.error for t, r in got.items()} == {"A": None, "B": "feed lacks its ticker", "C": "unsafe file name", "D": "feed lacks its ticker", "F": "no filing, or a blank form", "G": "parallel arrays differ in length", "H": "bad accession number"}
    alone = ingest.latest_filings(ingest.parsed_feeds(fetched.where("cik = 1")))
    assert alone.first().asDict() == {k: v for k, v in got["A"].asDict().items() if k != "error"}


def test_versions_against_killed_writers_and_racing_readers(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        versions.read(spark, path)
    assert versions.publish(spark.range(3), path) == 1
    opened = versions.read(spark, path)
    # A writer that dies before its pointer, and one that dies in it, change nothing.
    bad = spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("died"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="died"):
        versions.publish(bad, path)
    (tmp_path / "t" / "version-000000000002").write_text("data-half")
    assert versions.read(spark, path).count() == 3 and versions.versions(spark, path) == [1]
    # The next writer finds the number taken and goes on.
    assert versions.publish(spark.range(7), path) == 3
    assert versions.read(spark, path).count() == 7 and opened.count() == 3 and versions.read(spark, path, 1).count() == 3
    assert versions.publish(spark.range(9), path) == 4 and versions.prune(spark, path, 2) == 1
    assert versions.versions(spark, path) == [3, 4] and versions.read(spark, path).count() == 9
    with pytest.raises(ValueError):
        versions.prune(spark, path, 0)

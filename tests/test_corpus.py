import pytest
from pyspark.sql import functions as F

from quillstrata import commands
from quillstrata.functions import matrices as M
from quillstrata.operators import corpus, folds, ingest, locators, qrels, records, retrieval, vectors
from quillstrata.sources import files, sinks
from quillstrata.streaming.incremental import append_stream

DATA = "/root/testdata/sf0.001"
PAGES = "accession_number string, number int, display_page int, content string, elements array<struct<id:string,kind:string,content:string,page_start:int,page_end:int,tags:array<string>>>"
FILINGS = "ticker string, cik string, accession_number string, filing_date string, report_date string, source_url string, raw_sha256 string, legal_name string"
TABLE = "In millions\n\n| Portfolio | 2025 | 2024 |\n|---|---|---|\n| Commercial | 125 | 110 |\n| Consumer | 80 | 75 |"
QUERIES = "query_id string, query string, status string, relevant_target_chunk_ids array<string>, primary_target_chunk_id string, required_evidence_groups array<struct<entity:string,target_chunk_ids:array<string>>>"


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    """Filings, pages and the corpus of them, which is built and stored once."""
    filings = spark.createDataFrame([("BK", "1", "a-1", "2026-01-01", "2025-12-31", "u", "s", "Bank")], FILINGS)
    pages = spark.createDataFrame(
        [
            ("a-1", 10, 8, "x", [("e1", "text", "**Credit risk**\n\nItem 1A. Rises when loans fail.", 10, 10, ["b", "a"]), ("e1", "text", "again", 10, 10, None), ("e2", "table", TABLE, 10, 10, ["l"]), ("e3", None, "More words here.", None, None, None), ("e4", "text", " ", 10, 10, None)]),
            ("a-1", 11, None, "**Glossary of Terms and Acronyms** x", [("g1", "text", "**Glossary of Terms and Acronyms** lead **ABC** a thing **DEF:** other", 11, 11, None)]),
        ],
        PAGES,
    )
    place = tmp_path_factory.mktemp("corpus")
    made = []
    for name, df in zip(("chunks", "tables"), corpus.build_corpus(filings, pages), strict=True):
        df.write.parquet(str(place / name))
        made.append(spark.read.parquet(str(place / name)))
    return filings, pages, *made


def test_corpus(built):
    _, _, chunks, tables = built
    got = {r.document: r for r in chunks.collect()}
    assert set(got) == {"**Credit risk**\n\nItem 1A. Rises when loans fail.", "More words here.", "lead", "**ABC** a thing", "**DEF:** other", next(d for d in got if d.startswith("Introduction"))}
    first = got["**Credit risk**\n\nItem 1A. Rises when loans fail."]
    assert (first.metadata.sec_item, first.metadata.section_title, first.metadata.start_display_page, first.metadata.xbrl_tags) == ("Item 1A", "Credit risk", 8, ["a", "b"])
    assert first.embedding_text.startswith("Bank: BK\nEntity: Bank\nReport: 2025 10-K\nEvidence type: text\nInternal pages: 10-10\nSection: Credit risk\n\n")
    import hashlib

    key = lambda variant, child, ids, text: hashlib.sha256("\0".join(["a-1", variant, child, ids, text]).encode()).hexdigest()
    assert first.target_chunk_id == key("structure_aware", "narrative:0:0", "e1", first.document)
    assert got["More words here."].target_chunk_id == key("structure_aware", "narrative:1:0", "e3", "More words here.")
    assert got["lead"].target_chunk_id == key("structure_aware", "narrative:2:0", "g1", "lead")
    assert got["**DEF:** other"].target_chunk_id == key("structure_aware", "glossary:4:1:0", "g1", "**DEF:** other")
    table = tables.first()
    assert table.table_id == key("structure_aware_parent", "table-parent:1", "e2", TABLE) and table.metadata.section_title == "Credit risk"
    assert table.cell_matrices[0][-1] == ["Consumer", "80", "75"] and table.retrieval_eligible


def test_corpus_checks_and_manifest(built):
    _, _, chunks, tables = built
    assert corpus.violations(chunks, tables).isEmpty()
    assert {r.rule for r in corpus.violations(chunks.union(chunks.limit(1)), tables.limit(0)).collect()} == {"record id repeats", "unknown table"}
    total = corpus.manifest(chunks, tables).where("accession_number is null").first()
    assert (total.chunk_count, total.table_count, total.retrieval_eligible_table_count) == (6, 1, 1)


def test_grids_come_before_markdown(spark, built):
    filings, pages, _, _ = built
    html = spark.createDataFrame([("a-1", '<div data-block="e2"><table><tr><th rowspan=2>A<th colspan=2>B<tr><td>c<td>d</table></div><table><tr><td>no block</table>')], "accession_number string, html string")
    grids = files.table_grids(html, "accession_number", "data-block")
    assert [r.grids for r in grids.collect()] == [[[["A", "B", "B"], ["A", "c", "d"]]]]
    assert corpus.build_corpus(filings, pages, grids=grids)[1].first().cell_matrices == [[["A", "B", "B"], ["A", "c", "d"]]]


def test_narrative_fold_against_plain_python(spark):
    rows = [(d, i, "table" if (i * 7 + d) % 11 == 0 else None if i % 5 == 0 else "text", " " if i % 13 == 0 else ("**Head**\n\n" if i % 6 == 1 else "") + "w " * (i * 5 % 17)) for d in range(3) for i in range(60)]
    want = []
    for d in range(3):
        n, held = 0, []

        def close():
            nonlocal n, held
            if held:
                want.append((d, n, held[0][0], held[-1][0], "\n\n".join(c for _, c in held)))
                n, held = n + 1, []

        for _, place, kind, content in (r for r in rows if r[0] == d):
            content = content.strip()
            if kind == "table":
                close()
            elif content:
                size = lambda more=(): len(" ".join([*(c for _, c in held), *more]).split())
                if content.startswith("**") or size([content]) > 24:
                    close()
                held.append((place, content))
                if size() >= 16:
                    close()
        close()
    got = folds.narrative_fold(spark.createDataFrame(rows, "doc long, place long, kind string, content string"), target=16, most=24)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert folds.narrative_fold(spark.createDataFrame([], "doc long, place long, kind string, content string")).isEmpty()


def test_qrel_violations(spark):
    good = ("q1", "w", "answerable", ["a", "b"], "a", [("e", ["a"])])
    bad = [("q1", " ", "odd", ["a", "a"], "z", [("e", [])]), ("q3", "w", "unsupported", ["zz"], None, None), ("q4", "w", "answerable", None, None, None), ("q5", "w", "answerable", ["a"], None, [("e", ["b", "b"])])]
    targets = spark.createDataFrame([("a",), ("b",)], "target_chunk_id string")
    check = lambda rows: {(r.rule, r.key) for r in qrels.qrel_violations(spark.createDataFrame(rows, QUERIES), targets).collect()}
    assert check([good]) == set()
    assert check([]) == {("empty query set", None)}
    assert check([("q", "w", "ambiguous", [], None, None)]) == {("no answerable query", None)}
    assert check([good, *bad]) == {
        ("repeated query id", "q1"), ("empty query id or query", "q1"), ("unknown status", "q1"), ("repeated judgement", "q1"), ("primary target outside judgements", "q1"), ("groups of a query that is not answerable", "q1"), ("empty group", "q1"),
        ("unsupported with judgements", "q3"), ("unknown target", "zz"), ("judgements are no list", "q4"), ("answerable without judgements", "q4"), ("repeated id in a group", "q5"), ("group outside judgements", "q5"),
    }


def test_filings(spark):
    feed = "cik string, ticker string, legal_name string, tickers array<string>, recent struct<form:array<string>,accessionNumber:array<string>,filingDate:array<string>,reportDate:array<string>,primaryDocument:array<string>>"
    row = lambda name="n.htm", forms=("10-K", "10-K/A", "10-K"), tickers=("BK",): ("0001", "bk", "Bank", list(tickers), (list(forms), ["0-1", "0-2", "0-3"], ["2024", "2026", "2025"], ["d"] * 3, [name] * 3))
    got = ingest.latest_filings(spark.createDataFrame([row()], feed)).first()
    assert (got.ticker, got.accession_number, got.source_url, got.local_html_path) == ("BK", "0-3", ingest.ARCHIVE + "1/03/n.htm", "0001/03/n.htm")
    for broken in (row("..\\evil.htm"), row(forms=("10-Q",) * 3), row(tickers=("X",)), row("..")):
        with pytest.raises(Exception, match="unsafe|no filing|lacks"):
            ingest.latest_filings(spark.createDataFrame([broken], feed)).collect()
    registry = spark.createDataFrame([("B", True, 0), ("A", True, 1), ("C", False, 2)], "ticker string, enabled boolean, place int")
    old, new = (spark.createDataFrame(rows, "ticker string, v int") for rows in ([("a", 1), ("B", 1), ("C", 1)], [("A", 2)]))
    assert [(r.ticker, r.v) for r in ingest.merge_manifest(old, new, registry).orderBy("place").collect()] == [("B", 1), ("A", 2)]
    assert ingest.chosen(old, "a, c").count() == 2
    with pytest.raises(ValueError, match="X"):
        ingest.chosen(old, "a,x")

    def fetch(url):
        if url == "bad":
            raise OSError("gone")
        return url.encode()

    got = ingest.fetched(spark.createDataFrame([("u",), ("bad",)], "source_url string"), fetch, 10).collect()
    assert [(bytes(r.content) if r.content else None, r.error) for r in got] == [(b"u", None), (None, "OSError: gone")]


def test_locators(spark):
    matrix = [["", "2025", "2024"], ["Loans"], ["Old", "(1,234)", "5%"], ["Held"], ["", "7", ""], ["Sum", "8", "9"]]
    periods = [["Name", "x"], ["2025"], ["Cash", "1"], ["Debt"], ["Due", "2"], ["2024"], ["Cash", "3"]]
    rows = [("t1", "data_table", [matrix, periods, [["only", "labels"]]], "H"), ("t2", "glossary", [[["LCR", "", "ratio", "ratio"], ["alone"]]], "H"), ("t3", "narrative_table", [[["some", "12"], ["text"]]], "H"), ("t4", "layout", [[["a", "1"]]], "H"), ("t5", "data_table", None, "H")]
    got = locators.table_locators(spark.createDataFrame(rows, "table_id string, table_type string, cell_matrices array<array<array<string>>>, head string"))
    row = lambda path, columns: f"H\nMeasure or row: {path}\nColumn context: {columns}"
    assert sorted((r.table_id, r.matrix, r.row, r.scope, r.document) for r in got.where("row is not null").collect()) == sorted([
        ("t1", 0, 2, "row", row("Loans > Old", "2025: (1,234) | 2024: 5%")), ("t1", 0, 4, "row", row("Held", "2025: 7")), ("t1", 0, 5, "row", row("Held > Sum", "2025: 8 | 2024: 9")),
        ("t1", 1, 2, "row", row("2025 > Cash", "x: 1")), ("t1", 1, 4, "row", row("2025 > Debt > Due", "x: 2")), ("t1", 1, 6, "row", row("2024 > Cash", "x: 3")),
        ("t2", 0, 0, "glossary_entry", "H\nTerm: LCR\nDefinition: ratio"),
    ])
    assert sorted((r.table_id, r.scope, r.document) for r in got.where("row is null").collect()) == [("t1", "table_schema", "H\nTable fields: only | labels"), ("t3", "narrative", "H\nTable content: some text")]


def test_proxy_labels(spark):
    text, header = "A | B | 2025\nRow one | 5 | (1)\nRow TWO | 6%\nrow one | n/a | $", "A | B | 2025"
    row = spark.createDataFrame([(text, header)], "t string, h string").select(locators.proxy_columns(F.col("h")).alias("c"), locators.proxy_rows(F.col("t"), F.col("h")).alias("r"), locators.proxy_units(F.lit("Dollars in millions, 5%")).alias("u"), locators.header_rows(F.col("t")).alias("x")).first()
    assert (row.c, row.r, row.u, row.x) == (["A", "B", "2025"], ["Row one", "Row TWO"], ["dollars in millions", "percent"], ["A | B | 2025"])


def test_vectors_and_search(spark, built, tmp_path):
    filings, pages, _, _ = built
    place = lambda name: str(tmp_path / name)
    filings.write.parquet(place("filings"))
    pages.write.parquet(place("pages"))
    made = commands.build_corpus(spark, place("filings"), place("pages"), place("out"), ticker=["bk"])
    assert (made["chunk_count"], made["table_count"], made["filing_count"], len(made["outputs"])) == (6, 1, 1, 2)
    with pytest.raises(FileExistsError):
        commands.build_corpus(spark, place("filings"), place("pages"), place("out"))
    chunks, tables, model = place("out/chunks"), place("out/tables"), "quillstrata.operators.vectors:hashed_words"
    assert commands.embed(spark, chunks, place("v"), model, limit=2) == 2
    assert commands.embed(spark, chunks, place("v"), model) == 6
    for mode in commands.MODES:
        hits = commands.search(spark, "Consumer portfolio", chunks, tables, place("v"), model, mode, limit=1).collect()
        assert len(hits) == 1 and hits[0]["rank"] == 1
    best = commands.search(spark, "Consumer portfolio", chunks, tables, mode="bm25", record_type="table").first()
    assert best.evidence == TABLE
    with pytest.raises(ValueError, match="no records"):
        commands.search(spark, "x", chunks, tables, mode="bm25", ticker="none")
    with pytest.raises(Exception, match="tokens"):
        vectors.encoded(spark.createDataFrame([(1, "a b c")], "k long, t string"), "k", "t", vectors.hashed_words, most=2).collect()
    target = best.target_chunk_id
    spark.createDataFrame([("q", "Consumer portfolio", "answerable", [target], target, [("e", [target])])], QUERIES).write.parquet(place("q"))
    commands.index(spark, chunks, place("index"))
    measured, summary = commands.evaluate(spark, place("q"), chunks, place("v"), model, tables=tables, output=place("report.json"), lexical=place("index"))
    import json

    report = json.loads((tmp_path / "report.json").read_text())
    assert report["summary"]["bm25"]["hits_at_1"] == 1 and report["corpus"]["embedding_revision_warning"] and report["qrels"]["answerable_count"] == 1 and {r["method"] for r in report["retrieved"]} == set(commands.MODES)
    assert "document" not in commands.search(spark, "Consumer portfolio", chunks, tables, mode="bm25", lexical=place("index"), compact=True).columns
    assert {(r.method, r.query_count) for r in summary.collect()} == {(m, 1) for m in commands.MODES}
    assert measured.where("method = 'bm25'").first().complete_group_hit_at_1 == 1


def test_archive_violations(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "vec_id string, embedding array<float>")
    found = lambda df, expected=None: {r.rule for r in vectors.archive_violations(df, expected).collect()}
    assert found(rows(("a", [1.0, 0.0]), ("b", [0.0, 1.0]))) == set()
    assert found(rows(("a", [2.0, 0.0]), ("a", [float("nan"), 1.0]), ("", [1.0]))) == {"repeated id", "differing width", "not finite", "not of length one", "blank id"}
    assert found(rows(), rows(("a", [1.0]))) == {"empty archive", "ids differ from the records'"}


def test_dense_blocks_change_nothing(spark, monkeypatch):
    v = spark.read.parquet(f"{DATA}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")
    q = v.limit(7).select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("vector")).cache()
    want = sorted(map(tuple, retrieval.dense_topk(v, q).collect()))
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 3)
    assert sorted(map(tuple, retrieval.dense_topk(v, q).collect())) == want


def test_sources(spark, tmp_path):
    lines = tmp_path / "a.jsonl"
    lines.write_text('{"a": 1, "b": "ž"}\n\n{"a": 2}\n', encoding="utf-8")
    assert sorted((r.a, r.b) for r in files.read_jsonl(spark, str(lines), "a int, b string").collect()) == [(1, "ž"), (2, None)]
    lines.write_text('{"a": 1}\n[1]\n', encoding="utf-8")
    with pytest.raises(ValueError, match="line 2 of .*a JSON object was expected"):
        files.read_jsonl(spark, str(lines), "a int")
    lines.write_text('{"a": 1}\n\n{"a": \n', encoding="utf-8")
    with pytest.raises(ValueError, match="line 3 of .*invalid JSON"):
        files.read_jsonl(spark, str(lines), "a int")
    for body in ('[{"a": 1}, {"a": 2}]', '{"filings": [{"a": 1}, {"a": 2}]}'):
        (tmp_path / "m.json").write_text(body)
        assert [r.a for r in files.read_manifest(spark, str(tmp_path / "m.json"), "a int").collect()] == [1, 2]
    out = str(tmp_path / "out.jsonl")
    sinks.write_jsonl(spark.range(3), out)
    with pytest.raises(FileExistsError):
        sinks.write_jsonl(spark.range(3), out)
    (tmp_path / "r.yaml").write_text("version: 1\nbanks:\n- {ticker: bk, cik: '01', legal_name: B}\n- {ticker: C, cik: '02', legal_name: C, enabled: false}\n")
    assert [(r.ticker, r.enabled) for r in files.read_registry(spark, str(tmp_path / "r.yaml")).orderBy("place").collect()] == [("BK", True), ("C", False)]
    (tmp_path / "p.html").write_bytes(b"<p>a\xff")
    assert files.read_html(spark, str(tmp_path / "p.html")).first().html == "<p>a�"
    assert [sinks.append_missing(spark.range(n), str(tmp_path / "t"), "id") for n in (3, 5, 5)] == [3, 2, 0]


def test_stream_appends_each_key_once(spark, tmp_path):
    feed, table = str(tmp_path / "feed"), str(tmp_path / "table")
    for n in (4, 6):
        spark.range(n).write.mode("append").json(feed)
        append_stream(spark.readStream.schema("id long").json(feed), table, "id", str(tmp_path / "state")).awaitTermination()
        assert sorted(r.id for r in spark.read.parquet(table).collect()) == list(range(n))


def test_introductions_stop_at_tables_and_sections(spark):
    rows = [(1, 0, "paragraph", "The table below", "1", "s", False), (1, 1, "heading", "x", "1", "s", None), (1, 2, "table", "t", "1", "s", False), (1, 3, "table", "t", "1", "s", False), (1, 4, "paragraph", "shown below", "1", "s", False), (1, 5, "table", "t", "2", "s", False)]
    got = locators.introductions(spark.createDataFrame(rows, "doc long, place long, kind string, text string, item string, section string, navigation boolean"))
    assert sorted((r.place, r.introduction or "") for r in got.collect()) == [(2, "The table below"), (3, ""), (5, "")]


def test_matrices_of_table_text(spark):
    m = spark.range(1).select(M.markdown_matrices(F.lit(TABLE)).alias("m")).first().m
    assert m == [[["Portfolio", "2025", "2024"], ["Commercial", "125", "110"], ["Consumer", "80", "75"]]]
    assert records.word_tokens("") == 1

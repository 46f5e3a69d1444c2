import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstrata import commands
from quillstrata.operators import archive, chunker, corpus, descriptions, experiments, ingest, proxies, qrels, reports, retrieval, structure, vectors
from quillstrata.sources import files, filings, paths, settings, sinks

DATA = "/root/testdata/sf0.001"
PAGES = "accession_number string, number int, display_page int, content string, elements array<struct<id:string,kind:string,content:string,page_start:int,page_end:int,tags:array<string>>>"
FILINGS = "ticker string, cik string, accession_number string, filing_date string, report_date string, source_url string, raw_sha256 string, legal_name string"
TABLE = "In millions\n\n| Portfolio | 2025 | 2024 |\n|---|---|---|\n| Commercial | 125 | 110 |\n| Consumer | 80 | 75 |"


def test_failed_writes_change_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    sinks.write_jsonl(spark.range(3), out)
    bad = spark.createDataFrame([(1, [1.0, float("nan")])], "id long, v array<double>")
    with pytest.raises(Exception, match="not finite"):
        sinks.write_jsonl(bad, out, overwrite=True)
    assert files.read_jsonl(spark, out, "id long").count() == 3 and [p.name for p in tmp_path.iterdir()] == ["out"]
    sinks.write_jsonl(spark.createDataFrame([(1, None)], "id long, v string"), out, overwrite=True)
    assert spark.read.text(out).first().value == '{"id":1,"v":null}'
    with pytest.raises(ZeroDivisionError):
        sinks.published(spark, str(tmp_path / "x"), lambda place: 1 / 0, False)
    sinks.write_manifest(spark.range(2), str(tmp_path / "m.json"), "id")
    assert json.loads((tmp_path / "m.json").read_text()) == [{"id": 0}, {"id": 1}]
    with pytest.raises(ValueError, match="more than 1"):
        sinks.rows_of(spark.range(2), 1)


def test_appends_parts_and_logs(spark, tmp_path, capsys):
    rows = spark.createDataFrame([(1, None), (2, "bad"), (3, None)], "id long, error string")
    done, failed = str(tmp_path / "done"), str(tmp_path / "failed")
    assert sinks.append_missing(rows, done, "id", "error", failed) == 2
    assert sinks.append_missing(rows.withColumn("error", F.lit(None).cast("string")), done, "id", "error", failed) == 1
    assert sorted(r.id for r in spark.read.parquet(done).collect()) == [1, 2, 3] and spark.read.parquet(failed).count() == 1
    parts = str(tmp_path / "parts")
    two = spark.createDataFrame([("a", "x", 0), ("a", "y", 1), ("b", "z", 0)], "ticker string, record_id string, pos long")
    sinks.write_parts(two, parts, "ticker")
    sinks.write_parts(two.where("ticker = 'b'"), parts, "ticker")
    own = two.where("ticker = 'a'").select("record_id", "pos")
    assert sinks.read_part(spark, parts, "ticker", "a", own, "record_id").count() == 2
    assert sinks.read_part(spark, parts, "ticker", "a", own.withColumn("pos", 1 - F.col("pos")), "record_id") is None
    assert sinks.read_part(spark, str(tmp_path / "none"), "ticker", "a", own, "record_id") is None
    log = sinks.configure_logging("info")
    log.info("said", extra={"fields": {"ticker": "ž"}})
    assert json.loads(capsys.readouterr().err.splitlines()[-1]) | {"timestamp": ""} == {"timestamp": "", "level": "INFO", "logger": "quillstrata", "message": "said", "ticker": "ž"}
    assert len(sinks.configure_logging().handlers) == 1


def test_settings_and_paths(tmp_path):
    env = tmp_path / ".env"
    env.write_text("# c\nSEC_USER_AGENT='a b@c.d'\nexport OPENAI_API_KEY=secret\nSEC_TIMEOUT_SECONDS=5\nother=1\n")
    got = settings.load_settings({"sec_requests_per_second": "2", "SEC_TIMEOUT_SECONDS": " "}, str(env))
    assert (got.sec_user_agent, got.sec_requests_per_second, got.sec_timeout_seconds, got.openai_api_key) == ("a b@c.d", 2.0, 5.0, "secret") and "secret" not in repr(got)
    for wrong in ({}, {"SEC_USER_AGENT": "x"}, {"SEC_USER_AGENT": "a@b", "SEC_REQUESTS_PER_SECOND": "11"}, {"SEC_USER_AGENT": "a@b", "SEC_TIMEOUT_SECONDS": "0"}):
        with pytest.raises(ValueError):
            settings.load_settings(wrong, str(tmp_path / "none"))
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "f").write_text("x")
    root = str(tmp_path / "root")
    assert paths.resolve_raw("f", str(tmp_path / "d" / "m.json"), root) == tmp_path / "d" / "f"
    assert paths.resolve_raw("g", str(tmp_path / "d" / "m.json"), root) == tmp_path / "root" / "g"
    assert paths.inside(f"{root}/a/../b", root) == "b" and paths.shown(str(tmp_path), root) == str(tmp_path)
    with pytest.raises(ValueError, match="outside"):
        paths.inside(f"{root}/../x", root)


HTML = """<html><head><style>p{}</style></head><body><div style="display: none"><p>hidden</div><div><h2>Business</h2><p>Item 1A. Risk Factors<p>One\u00a0two&shy;three.</p>
<ul><li>first<li>second</ul><table><tr><th>a</th><td></td><td><b>1</b></td></tr><tr><td>only</td></tr></table><table><tr><td>ALL ABOUT</td></tr></table>
<div>Table of Contents <a>one</a></div><div>loose <div>inner words</div></div></div></body></html>"""


def test_filings_become_elements(spark):
    table = spark.createDataFrame([("a-1", "BK", HTML), ("a-2", "C", None)], "accession_number string, ticker string, html string")
    got = filings.parse_filings(table).orderBy("order_index").collect()
    assert [(r.order_index, r.element_type, r.text, r.is_navigation, r.sec_item, r.section_title) for r in got] == [
        (0, "heading", "Business", False, None, "Business"), (1, "heading", "Item 1A. Risk Factors", False, "Item 1A", "Item 1A. Risk Factors"), (2, "paragraph", "One twothree.", False, "Item 1A", "Item 1A. Risk Factors"),
        (3, "list", "first", False, "Item 1A", "Item 1A. Risk Factors"), (4, "list", "second", False, "Item 1A", "Item 1A. Risk Factors"), (5, "table", "a |  | 1\nonly", False, "Item 1A", "Item 1A. Risk Factors"),
        (6, "heading", "ALL ABOUT", False, "Item 1A", "ALL ABOUT"), (7, "paragraph", "Table of Contents one", True, "Item 1A", None), (8, "paragraph", "inner words", False, "Item 1A", "ALL ABOUT"),
    ]
    assert {r.accession_number for r in got} == {"a-1"}
    assert files.page_elements(spark.createDataFrame([(1, "<p>a<div hidden><p>b<p>c</div>d<p style='visibility:hidden'>e</p>f")], "page_id long, html string")).select("text").collect() == [("a",), ("d",), ("f",)]


def plain_pack(texts, size, target, most, least):
    """Chunks of whole texts, by the plainest rule."""
    chunks = []
    for i, t in enumerate(texts):
        if chunks and size(chunks[-1][0]) < target and size(chunks[-1][0] + " " + t) <= most:
            chunks[-1] = (chunks[-1][0] + "\n\n" + t, chunks[-1][1], i)
        else:
            chunks.append((t, i, i))
    out = []
    for c in chunks:
        if out and size(c[0]) < least and size(out[-1][0] + " " + c[0]) <= most:
            out[-1] = (out[-1][0] + "\n\n" + c[0], out[-1][1], c[2])
        else:
            out.append(c)
    return out


def test_chunker():
    size = lambda t: len(t.split())
    rng = np.random.default_rng(1)
    for _ in range(200):
        texts = [" ".join(f"w{j}" for j in range(int(rng.integers(1, 30)))) for _ in range(int(rng.integers(1, 12)))]
        assert chunker.packed(texts, list(range(len(texts))), size, 40, 50, 8, 5) == plain_pack(texts, size, 40, 50, 8)
    # Long texts: every part within the bound, no word lost, cut at the widest separator, with what was said last.
    sentences = [" ".join(f"s{i}w{j}" for j in range(9)) + "." for i in range(30)]
    parts = chunker.bounded(" ".join(sentences), size, 40, 50, 10)
    assert all(size(p) <= 40 for p in parts) and all(p.endswith(".") for p in parts)
    assert set(" ".join(parts).split()) == set(" ".join(sentences).split()) and parts[1].split(".")[0] == parts[0].rstrip(".").rsplit(".", 1)[-1].strip()
    assert chunker.bounded("a b\n\nc d", size, 3, 3, 0) == ["a b", "c d"]
    assert "".join(chunker.bounded("x" * 30, len, 10, 12, 0)) == "x" * 30


def test_element_chunks(spark):
    rows = [("a", i, *x) for i, x in enumerate([("paragraph", "one", False, "1", "s"), ("paragraph", "two", False, "1", "s"), ("paragraph", "three", False, "1", "t"), ("paragraph", "nav", True, "1", None), ("table", "Name | 2025\nrow | 5", False, "1", "t"), ("paragraph", "four", False, "2", "t"), ("list", "", False, "2", "t")])]
    table = spark.createDataFrame(rows, "accession_number string, order_index long, element_type string, text string, is_navigation boolean, sec_item string, section_title string").select("*", *(F.lit("x").alias(c) for c in ("ticker", "cik", "filing_date", "report_date", "source_url")))
    got = chunker.chunk_elements(table).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.element_type, r.text.strip(), r.order_start, r.order_end, r.table_header, r.table_context, r.table_part_count) for r in got] == [
        (0, "text", "one\n\ntwo", 0, 1, None, None, None), (1, "text", "three", 2, 2, None, None, None), (2, "table", "Name | 2025\nrow | 5", 4, 4, "Name | 2025", "Section: t", 1), (3, "text", "four", 5, 6, None, None, None),
    ]
    older = chunker.chunk_elements(table, by_item_only=True).orderBy("chunk_index").collect()
    assert [r.text.strip() for r in older] == ["one\n\ntwo\n\nthree", "Name | 2025\nrow | 5", "four"] and "table_id" not in older[0].asDict()
    long_ = table.where("element_type = 'table'").withColumn("text", F.concat(F.lit("Name | 2025\n"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(500)), lambda i: F.concat(F.lit("row "), i, F.lit(" | 5"))), "\n")))
    parts = chunker.chunk_elements(long_).orderBy("table_part_index").collect()
    assert len(parts) > 1 and all(r.text.startswith("Name | 2025\n") and r.token_count <= chunker.MOST and r.table_part_count == len(parts) for r in parts)
    assert chunker.chunk_violations(chunker.chunk_elements(long_)).isEmpty()


def test_descriptions(spark):
    filing = spark.createDataFrame([("BK", "1", "a-1", "2026-01-01", "2025-12-31", "u", "s", "Bank")], FILINGS)
    pages = spark.createDataFrame([("a-1", 10, 8, "x", [("e1", "table", TABLE, 10, 10, ["l"])])], PAGES)
    build = lambda **how: corpus.build_corpus(filing, pages, describe=lambda t: descriptions.described(t, **how))[0].first()
    local = build()
    assert local.metadata.description_provenance.mode == "local" and "Significant rows: Commercial; Consumer" in local.document

    def make(answer="A synopsis."):
        def client(model, instructions, prompt, most):
            assert model == "m" and most == 300 and "Bank: BK\nReport date: 2025-12-31\nSection: " in prompt and TABLE in prompt
            if answer is None:
                raise OSError("down")
            return answer, "r-1"

        return client

    said = build(mode="openai", make=make, model="m")
    assert said.document == local.document + "\nLLM synopsis: A synopsis." and said.metadata.description_provenance.response_id == "r-1"
    for wrong in (" ", None):
        with pytest.raises(Exception, match="description of table"):
            build(mode="openai", make=lambda w=wrong: make(w), model="m")
    with pytest.raises(ValueError, match="mode"):
        build(mode="other")


def test_model_proxies(spark):
    chunks = spark.createDataFrame([("c1", "table", "a | 1", "T1", "bk"), ("c2", "table", "broken", "T2", "C"), ("c3", "text", "x", None, "bk"), ("c4", "table", "never", "T4", "D")], "chunk_id string, element_type string, text string, table_id string, ticker string")

    def make():
        def generate(messages):
            asked = messages[1]["content"]
            if "never" in asked or ("broken" in asked and len(messages) == 2):
                return "no object"
            return 'So: {"description": " All  of it ", "topics": ["a", "A ;", ""], "units": "millions", "row_labels": null} and more'

        return generate

    got = {r.target_chunk_id: r for r in proxies.model_proxies(chunks, make, "m").collect()}
    assert set(got) == {"c1", "c2", "c4"} and got["c1"].proxy_text == got["c2"].proxy_text == "All of it\nTopics: a\nUnits: millions"
    assert got["c4"].proxy_text is None and "2 attempts" in got["c4"].error and got["c1"].proxy_id != got["c2"].proxy_id
    assert {r.target_chunk_id for r in proxies.model_proxies(chunks, make, "m", include=("BK", "c"), exclude=("C",)).collect()} == {"c1"}
    for wrong in ("", "[1]", "{", '{"description": ""}', '{"description": "x", "topics": 3}'):
        with pytest.raises(ValueError):
            proxies.clean_answer(proxies.first_json_object(wrong))


def test_archives(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "b", [0.0, 1.0])], "pos long, record_id string, embedding array<float>")
    place = str(tmp_path / "v")
    archive.save_archive(rows, place, "m", "unknown", "a" * 64)
    vectors_, origin = archive.load_archive(spark, place, rows.select("record_id", "pos"))
    assert vectors_.count() == 2 and archive.revision_warning(origin)
    with pytest.raises(ValueError, match="another order"):
        archive.load_archive(spark, place, rows.select("record_id", (1 - F.col("pos")).alias("pos")))
    for broken, said in ((rows.withColumn("embedding", F.col("embedding").cast("array<double>")), "array<double>"), (rows.withColumn("embedding", F.transform("embedding", lambda x: x * 2)), "length one"), (rows.withColumn("record_id", F.lit(" ")), "blank")):
        with pytest.raises(ValueError, match=said):
            archive.save_archive(broken, place, "m", "r", "a" * 64, overwrite=True)
    with pytest.raises(ValueError, match="sha256"):
        archive.save_archive(rows, place, "m", "r", "A" * 64, overwrite=True)
    assert archive.load_archive(spark, place)[0].count() == 2 and [p.name for p in tmp_path.iterdir()] == ["v"]
    records = spark.createDataFrame([("a", 0, "text", "t1", "BK"), ("b", 1, "table", "t2", "BK")], "record_id string, pos long, record_type string, target_chunk_id string, ticker string")
    records.write.parquet(str(tmp_path / "r"))
    spark.createDataFrame([("deterministic-v1",)], "proxy_version string").write.parquet(str(tmp_path / "p"))
    made = archive.embedding_manifest(spark, str(tmp_path / "r"), str(tmp_path / "p"), place)
    assert made["corpus"]["ticker_type_counts"] == {"BK": {"table": 1, "text": 1}} and made["corpus"]["proxy_version_counts"] == {"deterministic-v1": 1} and made["embedding_matrix"]["count"] == 2
    assert {r.rule for r in archive.manifest_violations(records.unionByName(records.limit(1)), records.limit(0).selectExpr("record_id as proxy_version"), rows).collect()} == {"repeated record id", "repeated target", "tables and proxies differ in number"}


def test_dense_search_normalises_and_rejects(spark):
    v = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, embedding array<double>")
    q = lambda x: spark.createDataFrame([(1, x)], "query_id long, vector array<double>")
    got = retrieval.dense_topk(v((0, [2.0, 0.0]), (1, [4.0, 0.0]), (2, [3.0, 3.0])), q([9.0, 0.0])).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in got] == [(0, 1.0), (1, 1.0), (2, 0.707107)]
    for rows, asked in ((v((0, [0.0, 0.0])), q([1.0, 0.0])), (v((0, [1.0, float("inf")])), q([1.0, 0.0])), (v((0, [1.0]), (1, [1.0, 2.0])), q([1.0])), (v((0, [1.0, 0.0])), q([1.0])), (v((0, [1.0, 0.0])), q([0.0, 0.0])), (v((0, [1.0, 0.0])), q([float("nan"), 1.0]))):
        with pytest.raises(ValueError):
            retrieval.dense_topk(rows, asked)


def test_a_stored_index_gives_the_same_hits(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    asked = spark.read.parquet(f"{DATA}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    place = str(tmp_path / "index")
    retrieval.store_index(docs, place, buckets=8)
    want = sorted(map(tuple, retrieval.bm25_topk(docs, asked).collect()))
    assert sorted(map(tuple, retrieval.bm25_topk(retrieval.stored_index(spark, place, asked), asked).collect())) == want and want
    en = F.col("lang") == "en"
    assert sorted(map(tuple, retrieval.bm25_topk(retrieval.stored_index(spark, place), asked, where=en, rows=docs).collect())) == sorted(map(tuple, retrieval.bm25_topk(docs, asked, where=en).collect()))


def test_tokens_against_plain_python(spark):
    rule = re.compile(r"(?<!\w)[a-z0-9]+(?:[._-][a-z0-9]+)*%?(?!\w)")
    texts = ["naïve café-x 1,234.5% a_b c%d über.e x-é y— z", "é1 1é a.é 5%é", "ＡＢ x² y³ ٣ z٣", "plain words, 10-K 2,024"]
    got = [r.t for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string").orderBy("doc_id").select(retrieval.financial_tokens(F.col("text")).alias("t")).collect()]
    import sys
    import unicodedata

    from quillstrata.functions.text import NFKC_STABLE

    # Every character that is taken to be stable is, alone and after a letter.
    stable = re.compile(f"[{NFKC_STABLE}]")
    assert all(unicodedata.normalize("NFKC", "a" + chr(c)) == "a" + chr(c) for c in range(sys.maxunicode) if stable.match(chr(c)))
    plain = lambda x: re.sub(r"(?<=\d),(?=\d)", "", unicodedata.normalize("NFKC", x).translate(str.maketrans("–—", "--"))).lower()
    assert got == [rule.findall(plain(x)) for x in texts]


def test_passages_are_found(spark):
    texts = ["the quick brown fox jumps over it", "a quick brown fox jumps", "fox", "", None, "the quick  brown fox jumps over it", "xfoxx"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    needles = ["quick brown fox jumps over", "fox", "brown fox", "e quick brown fox jumps o", "absent words of no text at all", "quick  brown fox jumps over"]
    asked = spark.createDataFrame(list(enumerate(needles)), "query_id long, passage string")
    want = {(i, d) for i, n in enumerate(needles) for d, t in enumerate(texts) if t is not None and n in t}
    assert {tuple(r) for r in qrels.passage_judgements(docs, asked).select("query_id", "target").collect()} == want


def test_download(spark, tmp_path):
    feed = {"tickers": ["BK"], "filings": {"recent": {"form": ["10-K"], "accessionNumber": ["0-1"], "filingDate": ["2026"], "reportDate": ["2025"], "primaryDocument": ["d.htm"]}}}
    (tmp_path / "feeds.json").write_text(json.dumps(feed))
    (tmp_path / "r.yaml").write_text("version: 1\nbanks:\n- {ticker: bk, cik: '0001', legal_name: B}\n- {ticker: C, cik: '0002', legal_name: C}\n")
    place = lambda n: str(tmp_path / n)
    (tmp_path / "fetcher.py").write_text(f"def fetch(url):\n    if '0002' in url:\n        raise OSError('gone')\n    return open({place('feeds.json')!r}, 'rb').read() if 'submissions' in url else b'<p>filing'\n")
    import sys

    sys.path.insert(0, str(tmp_path))
    import fetcher

    commands.named = lambda _: (lambda url, feeds=json.dumps(feed).encode(): (_ for _ in ()).throw(OSError("gone")) if "0002" in url else feeds if "submissions" in url else b"<p>filing")
    try:
        assert fetcher and commands.download(spark, place("r.yaml"), place("m.json"), place("raw"), fetch="x") == 1
    finally:
        import importlib

        importlib.reload(commands)
    rows = json.loads((tmp_path / "m.json").read_text())
    assert [r["ticker"] for r in rows] == ["BK"] and rows[0]["local_html_path"] == place("raw") + "/0001/01/d.htm"
    assert (tmp_path / "raw/0001/01/d.htm").read_bytes() == b"<p>filing"


def test_benchmark(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"query": " one "}\n{"query": "two"}\n')
    rows = spark.createDataFrame([(0, "a", [1.0] + [0.0] * 64)], "pos long, record_id string, embedding array<float>")
    archive.save_archive(rows, str(tmp_path / "v"), "m", "r", "a" * 64)
    got = commands.benchmark(spark, str(tmp_path / "q.jsonl"), str(tmp_path / "v"), "quillstrata.operators.vectors:hashed_words")
    assert (got["query_count"], got["dimensions"]) == (2, 65) and got["individual_min_seconds"] <= got["individual_median_seconds"] <= got["individual_max_seconds"]
    assert [r.query for r in files.read_query_texts(spark, str(tmp_path / "q.jsonl"), 1).collect()] == ["one"]
    (tmp_path / "b.jsonl").write_text('{"query": " "}\n')
    for wrong in (lambda: files.read_query_texts(spark, str(tmp_path / "b.jsonl")), lambda: files.read_query_texts(spark, str(tmp_path / "q.jsonl"), 0), lambda: files.embedding_inputs(spark.createDataFrame([("a", "x"), ("a", "y")], "record_id string, embedding_text string"))):
        with pytest.raises(ValueError):
            wrong()


def test_structure_corpus(spark, tmp_path):
    filing = spark.createDataFrame([("BK", "1", "a-1", "2026-01-01", "2025-12-31", "u", "s", "Bank")], FILINGS)
    pages = spark.createDataFrame([("a-1", 10, 8, "x", [("e1", "text", "**Credit risk**\n\nRises.", 10, 10, ["b"]), ("e2", "table", TABLE, 10, 10, ["l"])]), ("a-1", 11, None, "**Glossary of Terms and Acronyms** x", [("g1", "text", "**Glossary of Terms and Acronyms** **ABC** a thing", 11, 11, None)])], PAGES)
    for name, df in zip(("chunks", "tables"), corpus.build_corpus(filing, pages), strict=True):
        df.write.parquet(str(tmp_path / name))
    rows, parents = structure.structure_corpus(filing, *(spark.read.parquet(str(tmp_path / name)) for name in ("chunks", "tables")))
    rows.write.parquet(str(tmp_path / "records"))
    rows = spark.read.parquet(str(tmp_path / "records"))
    got = {r.record_type: r for r in rows.collect()}
    assert {k: sum(r.record_type == k for r in rows.collect()) for k in got} == {"text": 1, "glossary_child": 1, "table_locator": 2}
    assert "Evidence type: glossary_child\n" in got["glossary_child"].embedding_text and got["table_locator"].metadata.parent_id == parents.first().parent_id
    assert got["table_locator"].document.startswith("Bank: BK\nEntity: Bank\nReport date: 2025-12-31\nSection: Credit risk\n") and structure.corpus_violations(rows, parents).isEmpty()
    broken = rows.withColumn("metadata", F.col("metadata").withField("retrieval_eligible", F.lit(False)))
    assert {r.rule for r in structure.corpus_violations(broken, parents.limit(0)).collect()} == {"not for retrieval", "no table parent"}
    assert {r.rule for r in structure.record_violations(rows, lambda t: 600).collect()} == {"too many tokens"}


def test_runs_and_gates(spark):
    def scorer():
        return lambda pairs: [float(len(set(q.lower().split()) & set(t.lower().split()))) for q, t in pairs]

    words = [f"w{i}" for i in range(40)]
    rows = [(f"r{i}", f"t{i}", "text", " ".join(words[i : i + 5]), "BK", "2025", 1, 1, f"p{i % 3}") for i in range(36)]
    records = spark.createDataFrame([(*r[:4], r[3], *r[4:]) for r in rows], "record_id string, target_chunk_id string, record_type string, document string, text string, ticker string, report_date string, page_start int, page_end int, parent_id string")
    asked = spark.createDataFrame([("q1", "w3 w4 w5", "answerable", "narrative_risk", "BK", None), ("q2", "w20 w21", "answerable", "x", None, None), ("q3", "w9", "unsupported", "x", None, "2026")], "query_id string, query string, status string, question_type string, ticker string, expected_period string")
    judged = spark.createDataFrame([("q1", "t3"), ("q2", "t19"), ("q2", "t20")], "query_id string, target string")
    groups = spark.createDataFrame([("q2", "a", "t19"), ("q2", "b", "t20")], "query_id string, entity string, target string")
    model = vectors.Model("m", vectors.hashed_words, "r")
    stored = vectors.encoded(records, "record_id", "text", model.make).withColumnRenamed("record_id", "doc_id")
    measured, summary = experiments.evaluated(records, stored, asked, judged, groups, model, scorer)
    got = {r.method: r for r in summary.collect()}
    assert set(got) == set(experiments.METHODS) and got["reranked"].query_count == 2 and got["bm25"].hits_at_10 == 2 and got["bm25"].ticker_filter_accuracy == 1.0
    assert got["reranked"].candidate_hits_at_30 == 2 and got["hybrid"].grouped_query_count == 1 and got["reranked"].mean_reranking_seconds > 0
    families = experiments.evaluated(records, stored, asked, judged, groups, model, scorer, by_family=True)[1]
    assert {(r.method, r.family) for r in families.collect()} == {(m, f) for m in experiments.METHODS for f in ("narrative", "table")}
    vector = vectors.encoded(asked, "query_id", "query", model.make).withColumnRenamed("embedding", "vector")
    run = experiments.retrieved(records, stored, asked.join(vector, "query_id"), scorer)
    lines = experiments.variant_rows(run, asked, judged)
    anchors = spark.createDataFrame([("q1", ["W3 w4"])], "query_id string, anchors array<string>")
    gates = experiments.bakeoff_gates(lines, run, judged, records, anchors, {"q1": ("bm25", 3)}).first().asDict()
    assert gates["unsupported_has_no_matching_period"] and gates["judged_are_self_contained"] and gates["all_judged_have_pages"] and gates["ranks_are_not_worse"] and gates["all_proofs_enter_the_pool"]
    assert gates["pass"] == all(v for k, v in gates.items() if k != "pass")
    assert not experiments.bakeoff_gates(lines, run, judged, records, anchors.withColumn("anchors", F.array(F.lit("zz")))).first()["pass"]


def test_xml_facts(spark, tmp_path):
    (tmp_path / "x.xml").write_text('<xbrl><fact name="Loans" unit="USD">12</fact><fact name="Cash">3</fact></xbrl>')
    got = files.read_xml_facts(spark, str(tmp_path / "x.xml"), "fact", "_VALUE string, _name string, _unit string")
    assert sorted(map(tuple, got.collect())) == [("12", "Loans", "USD"), ("3", "Cash", None)]


def test_rates_and_feeds(spark):
    rows = spark.createDataFrame([("u1",), ("u2",)], "source_url string")
    assert sorted(bytes(r.content) for r in ingest.fetched(rows, str.encode, 10, tasks=2).collect()) == [b"u1", b"u2"]
    with pytest.raises(ValueError):
        ingest.fetched(rows, str.encode, 11)
    assert reports.table_features(spark.createDataFrame([(None,)], "text string")).first().row_count == 0

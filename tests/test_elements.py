from pyspark.sql import functions as F

from quillstrata.functions import elements as E
from quillstrata.operators import locators, qrels, retrieval
from quillstrata.operators.records import word_tokens


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_classes(spark):
    rows = {"a | b\nc | d": "table", "- one\n- two": "list", "Credit Risk": "heading", "In 2025": "table", "word " * 40 + "end.": "paragraph", "": "table"}
    assert {t: one(spark, E.element_class(F.lit(t))) for t in rows} == rows
    assert one(spark, E.clean(F.lit("a\u00a0\u200bb\u202f c"))) == "a b c"
    assert [one(spark, E.is_heading_element(F.lit(t), F.lit(x))) for t, x in (("h2", "x."), ("p", "RISK FACTORS"), ("p", "Risk FACTORS"), ("p", "ABC"), (None, "RISKS."))] == [True, True, False, False, False]


def test_navigation(spark):
    none = F.array().cast("array<string>")
    links = F.array(F.lit("one"), F.lit("two"), F.lit("three"))
    cases = (("Table of Contents x", none), ("Item 1 | 3\nItem 2 | 4\nother | 5", none), ("one two three", links), ("one two three and much more text here", links), ("plain", none), ("", links))
    assert [one(spark, E.is_navigation_element(F.lit(t), x)) for t, x in cases] == [True, True, True, False, False, False]


def test_context(spark):
    text = F.lit("The  following, Dollars in  millions")
    assert one(spark, E.table_context(F.lit(" Risk "), F.lit(None).cast("string"), text)) == "Section: Risk\nDescription: The  following, Dollars in  millions\nUnit: Dollars in millions"
    assert one(spark, E.table_context(F.lit("Forward-Looking Statements"), F.lit(None).cast("string"), F.lit(None).cast("string"))) is None


def test_filled_items(spark):
    rows = spark.createDataFrame([(1, 0, "intro"), (1, 1, "Item"), (1, 2, "7A |"), (1, 3, ". Risk"), (1, 4, "text"), (2, 0, "x")], "doc long, place long, text string")
    got = {(r.doc, r.place): r.item for r in E.filled_items(rows).collect()}
    assert got[(1, 1)] == got[(1, 4)] == "Item 7A" and got[(1, 0)] is None and got[(2, 0)] is None


def test_table_parts(spark):
    rows = spark.createDataFrame([("h h", ["a b", "c", "d e f g h i j", "k"]), ("h", []), (None, [])], "h string, r array<string>")
    got = [r.p for r in rows.select(locators.table_parts(word_tokens, 5)("h", "r").alias("p")).collect()]
    assert got == [["h h\na b\nc", "h h\nd e f", "h h\ng h i", "h h\nj", "h h\nk"], ["h"], []]


def test_anchors_and_groups(spark):
    docs = spark.createDataFrame([("d1", "Long text with Alpha  BETA and more"), ("d2", "alpha beta"), ("d3", "beta alphx"), ("d0", None)], "target string, document string")
    anchors = spark.createDataFrame([("q", ["Alpha beta", "a"]), ("none", [])], "query_id string, anchors array<string>")
    judged = qrels.anchored_judgements(docs, anchors)
    assert sorted(map(tuple, judged.collect())) == [("q", "d1", False), ("q", "d2", True)]
    plan = spark.createDataFrame([("cross", "bank", "q")], "query_id string, entity string, from_query string")
    assert sorted(r.target for r in qrels.assembled_groups(plan, judged).collect()) == ["d1", "d2"]


def test_candidate_pool(spark):
    hits = lambda *ids: spark.createDataFrame([(1, d, 1.0, i + 1) for i, d in enumerate(ids)], "query_id long, doc_id long, score double, rank int")
    got = retrieval.candidate_pool(hits(1, 2, 3), hits(4, 2, 5), fused=1, each=2, most=3)
    assert [r.doc_id for r in got.orderBy("rank").collect()] == [2, 1, 4]

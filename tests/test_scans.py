import random

import pytest
from pyspark.sql import functions as F

from quillstrata.operators import folds, scans
from quillstrata.operators.records import word_tokens


def test_prefix_sums_against_a_loop(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(9), i, rng.choice([0, 1, 2, None])) for i in range(700)]
    table = spark.createDataFrame(rows, "doc int, place int, x int").repartition(5)
    got = scans.prefix_sums(table, [F.col("doc"), F.col("place")], {"n": F.lit(1), "s": F.col("x")}).orderBy("n").collect()
    total = 0
    for n, (r, want) in enumerate(zip(got, sorted(rows, key=lambda r: r[:2]), strict=True), 1):
        total += want[2] or 0
        assert (r.doc, r.place, r.n, r.s) == (*want[:2], n, total)
    assert scans.prefix_sums(table.limit(0), [F.col("doc")], {"n": F.lit(1)}).count() == 0


def stream(seed, docs, length, headed):
    """Documents of words, blanks, tables and headings; few of the latter make segments longer than any block."""
    rng = random.Random(seed)
    for d in range(docs):
        for i in range(length):
            x = rng.random()
            kind = "table" if x < headed / 2 else None if x > 0.9 else "text"
            yield d if d else None, i, kind, ("**Head**\n\n" if rng.random() < headed else "") + "w " * rng.choice([0, 1, 3, 6, 25, 90])


@pytest.mark.parametrize(("block", "headed", "count"), [(8, 0.0, word_tokens), (8, 0.2, len), (5, 0.02, word_tokens), (256, 0.05, word_tokens)])
def test_scanned_fold_equals_the_fold_by_segment(spark, block, headed, count):
    rows = spark.createDataFrame(list(stream(block, 2, 90, headed)), "doc int, place int, kind string, content string").repartition(6)
    for target, most in ((20, 40),) if block != 8 else ((90, 110),):
        want = folds.narrative_fold(rows, count, target, most)
        got = folds.narrative_fold(rows, count, target, most, block=block)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() > 3


def test_scanned_fold_of_a_run_over_many_blocks(spark):
    """Texts without a token of their own, by an odd tokenizer, make one run of the whole stream; blocks are widened for it."""
    rows = spark.createDataFrame([(1, i, "text", "x") for i in range(50)], "doc int, place int, kind string, content string")
    (run,) = folds.narrative_fold(rows, lambda t: 0, 5, 9, block=4).collect()
    assert (run["first"], run["last"], run.narrative) == (0, 49, 0)
    assert folds.narrative_fold(rows.limit(0), block=4).count() == 0

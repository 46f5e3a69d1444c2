"""Line dedup: a suffix array over line-id sequences by distributed prefix doubling.

A document is its sequence of lines that hold a word; a line's id is a hash of it and its length. Prefix doubling sorts
all suffixes by their first 1, 2, 4, ... lines: ranks for twice the depth come from the pairs of ranks that lie a depth
apart, whose distinct values are range-sorted and numbered in order. Suffixes of equal rank at a depth are an interval of
the suffix array whose longest common prefix is at least that depth. A suffix alone in its interval is in its final place
and leaves; doubling goes on until none is left, that is, beyond the longest repeated run.

At every depth of MIN_LINES lines or more, the prefix of each suffix of an interval but the first, in the order of
(doc_id, text, place), is a later copy. A repeated run of any length is covered by the prefixes of two suffixes at the
largest depth that fits it, so the maximal runs are these prefixes, merged where they overlap or touch. They are removed,
and so is a line of LONG_LINE words that occurred before.

Lines without a word stay and don't break a run. Null text has no lines and stays null. Of rows with equal text only that
of the least doc_id (the first of its rows) takes part; the others repeat it and lose every line if they have MIN_LINES of
them, or else their long lines, which is what the intervals would say. Documents whose lines all go stay, with what is
left. An empty table gives an empty result. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstrata.llm.common import cut, text_key, text_or_empty, word_count

MIN_LINES = 2
LONG_LINE = 8
_HAS_WORD = r"[^\x20\x09-\x0D]"


def line_array(text: Column) -> Column:
    return F.split(text, "\n", -1)


#: What tells a text of a document apart.
DOC = ["doc_id", "k1", "k2"]


def line_sequence(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2, p (place among lines with a word), i (place among all), id, chars, w (words): once a distinct row."""
    text = text_or_empty()
    k1, k2 = text_key(text)
    numbered = F.transform(line_array(text), lambda x, i: F.struct(i.alias("i"), x.alias("line")))
    full = F.filter(numbered, lambda x: x["line"].rlike(_HAS_WORD))
    rows = docs.select("doc_id", k1.alias("k1"), k2.alias("k2"), full.alias("a")).select(*DOC, F.posexplode("a").alias("p", "x"))
    line = F.col("x.line")
    return rows.select(*DOC, "p", "x.i", F.xxhash64(line).alias("id"), F.length(line).alias("chars"), word_count(line).cast("int").alias("w"))


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull(), *DOC, "p")


def copies(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2 of rows whose text is that of a row with a lesser doc_id; cut."""
    k1, k2 = text_key(text_or_empty())
    keys = docs.select("doc_id", k1.alias("k1"), k2.alias("k2"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id")
    firsts = cut(keys.groupBy("k1", "k2").agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first <> last").drop("last"))
    return cut(keys.join(firsts, ["k1", "k2"]).where(order != F.col("first")).select(*DOC))


def intervals(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, head: suffixes with equal values of by that are at least two; head: the first of them."""
    return rows.groupBy(*by).agg(F.min(_place()).alias("head"), F.max(_place()).alias("tail")).where("head <> tail").drop("tail")


def doubled(ranked: DataFrame, depth: int) -> DataFrame:
    """From rank at a depth (DOC, p, i, e, rank) to rank at twice it, with head; only of repeated suffixes.

    i, e: places among all lines of the first and last line of the prefix.
    """
    # Suffixes that don't repeat are left out, so the row depth places on may be missing: look it up by its place.
    ahead = Window.partitionBy(*DOC).orderBy("p").rangeBetween(depth, depth)
    pairs = ranked.withColumn("far", F.first(F.struct(F.col("rank").alias("next"), "e")).over(ahead)).where("far is not null").select(*DOC, "p", "i", "rank", "far.next", "far.e")
    found = intervals(pairs, ["rank", "next"])
    sorted_pairs = found.repartitionByRange("rank", "next").sortWithinPartitions("rank", "next")
    # Rows are numbered in the order of range partitions, and within them: larger pairs get larger numbers.
    named = cut(sorted_pairs.withColumn("deeper", F.monotonically_increasing_id()))
    return cut(pairs.join(named, ["rank", "next"]).select(*DOC, "p", "i", "e", F.col("deeper").alias("rank"), "head"))


def repeated_runs(docs: DataFrame, gone_before: DataFrame, min_lines: int = MIN_LINES, long_line: int = LONG_LINE) -> DataFrame:
    """doc_id, k1, k2, runs (array of struct a, b): maximal runs to remove, by places among all lines.

    gone_before: DOC of rows that take no part, as copies() gives them.
    """
    if min_lines < 1 or min_lines & (min_lines - 1):
        raise ValueError("min_lines must be a power of two")
    rows = line_sequence(docs).join(gone_before.distinct(), DOC, "left_anti")
    # Cut, so that both sides of the join are exchanged and a hot line's rows can be split.
    first = cut(intervals(rows, ["id", "chars"]))
    ranked = cut(rows.join(first, ["id", "chars"]).select(*DOC, "p", "i", F.col("i").alias("e"), "w", "head", F.xxhash64("id", "chars").alias("rank")))
    later = _place() != F.col("head")
    prefix = [*DOC, "p", (F.col("p") + F.lit(0)).alias("q"), "i", "e"]
    gone = ranked.where(later & (F.col("w") >= (long_line if min_lines > 1 else 0))).select(*prefix)
    deep, depth = ranked, 1
    while True:
        deep, depth = doubled(deep, depth), 2 * depth
        if deep.isEmpty():
            break
        if depth >= min_lines:
            gone = gone.union(deep.where(later).select(*DOC, "p", (F.col("p") + F.lit(depth - 1)).alias("q"), "i", "e"))
    by_doc = Window.partitionBy(*DOC).orderBy("p", "q")
    reach = F.max("q").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    opened = gone.withColumn("opens", F.coalesce((F.col("p") > reach + 1).cast("int"), F.lit(1)))
    islands = opened.withColumn("island", F.sum("opens").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    runs = islands.groupBy(*DOC, "island").agg(F.min("i").alias("a"), F.max("e").alias("b"))
    return runs.groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("runs"))


def _without(lines: Column, runs: Column, full: Callable[[Column], Column]) -> Column:
    """lines without those of the runs (sorted, apart) that hold a word."""
    begin = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(runs, k - 1)["b"] + 1)
    part = lambda r, k: F.concat(F.slice(lines, begin(k) + 1, r["a"] - begin(k)), F.filter(F.slice(lines, r["a"] + 1, r["b"] - r["a"] + 1), lambda x: ~full(x)))
    return F.concat(F.flatten(F.transform(runs, part)), F.slice(lines, F.element_at(runs, -1)["b"] + 2, F.size(lines)))


def remove_repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, long_line: int = LONG_LINE) -> DataFrame:
    """docs with its columns, text without the removed lines, and __qs_lines, __qs_removed (counts)."""
    k1, k2 = text_key(text_or_empty())
    narrow = docs.select("doc_id", "text")
    again = copies(narrow)
    runs = repeated_runs(narrow, again, min_lines, long_line).withColumn("again", F.lit(False))
    known = runs.unionByName(again.distinct().withColumn("again", F.lit(True)), allowMissingColumns=True)
    keys = ["__qs_d", "__qs_1", "__qs_2"]
    found = known.select(F.xxhash64("doc_id").alias("__qs_d"), F.col("k1").alias("__qs_1"), F.col("k2").alias("__qs_2"), F.col("runs").alias("__qs_runs"), F.col("again").alias("__qs_again"))
    joined = docs.withColumns({"__qs_d": F.xxhash64("doc_id"), "__qs_1": k1, "__qs_2": k2}).join(found, keys, "left")
    # Among rows that repeat doc_id and text the other columns decide which is the first, so reruns agree.
    others = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.name not in ("doc_id", "text") and "map<" not in f.dataType.simpleString()]
    copy = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(0), *others)))
    full = lambda x: x.rlike(_HAS_WORD)
    split = joined.withColumn("__qs_copy", copy).withColumn("__qs_all", F.coalesce(line_array(F.col("text")), F.array().cast("array<string>")))
    counted = split.withColumn("__qs_lines", F.size(F.filter("__qs_all", full)))
    long_enough = lambda x: (F.col("__qs_lines") >= min_lines) | (word_count(x) >= long_line)
    repeat = F.filter("__qs_all", lambda x: ~(full(x) & long_enough(x)))
    kept = F.when((F.col("__qs_copy") > 1) | F.col("__qs_again"), repeat).when(F.col("__qs_runs").isNull(), F.col("__qs_all")).otherwise(_without(F.col("__qs_all"), F.col("__qs_runs"), full))
    out = counted.withColumn("__qs_kept", kept).withColumn("__qs_removed", F.size("__qs_all") - F.size("__qs_kept"))
    left = F.when(F.col("__qs_removed") == 0, F.col("text")).otherwise(F.array_join("__qs_kept", "\n"))
    return out.withColumn("text", left).select(*(F.col(f"`{c}`") for c in docs.columns), "__qs_lines", "__qs_removed")


def line_digests(docs: DataFrame) -> DataFrame:
    out = remove_repeated_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("__qs_lines").cast("long").alias("n_lines"), F.col("__qs_removed").cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: Windows of two lines and long lines, found by plain grouping.
LINE_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY doc_id, text) AS copy FROM documents),
raw AS (SELECT doc_id, copy, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs),
lines AS (
    SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w,
        row_number() OVER (PARTITION BY doc_id, copy ORDER BY i) AS p
    FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
),
pairs AS (SELECT *, lead(line) OVER (PARTITION BY doc_id, copy ORDER BY p) AS following FROM lines),
marked AS (
    SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, copy, p) > 1 AND w >= 8 AS long_again,
        following IS NOT NULL AND row_number() OVER (PARTITION BY line, following ORDER BY doc_id, copy, p) > 1 AS pair_again
    FROM pairs
),
judged AS (
    SELECT doc_id, copy, i, long_again OR pair_again OR coalesce(lag(pair_again) OVER (PARTITION BY doc_id, copy ORDER BY p), false) AS gone
    FROM marked
),
all_lines AS (SELECT raw.*, judged.gone FROM raw LEFT JOIN judged USING (doc_id, copy, i))
SELECT doc_id, count(gone)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_removed,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (gone IS NULL OR NOT gone), '')) AS kept_sha256
FROM all_lines GROUP BY doc_id, copy
"""

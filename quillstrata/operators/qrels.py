"""Query sets with relevance judgements: what is wrong with one, its answerable part and its judgements as rows.

queries: query_id, query, status, relevant_target_chunk_ids array<string>, primary_target_chunk_id,
required_evidence_groups array<struct<entity string, target_chunk_ids array<string>>>.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstrata.functions.text import normalize_space
from quillstrata.operators.retrieval import MOST_QUERIES
from quillstrata.sources import lineage

#: Pairs of a needle and a document that may be sent to every task at once.
MOST_MET = 100_000
#: Words of the run by which a passage is looked up.
RUN = 3

STATUSES = ("answerable", "ambiguous", "unsupported")
RELEVANT, GROUPS = "relevant_target_chunk_ids", "required_evidence_groups"


def _ids(column: str):
    return F.coalesce(F.col(column), F.array().cast("array<string>"))


def qrel_violations(queries: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows (rule, key); targets: target_chunk_id. Null lists are no lists, but absent groups are allowed."""
    relevant, groups = _ids(RELEVANT), F.coalesce(F.col(GROUPS), F.array())
    members = lambda g: F.coalesce(g["target_chunk_ids"], F.array().cast("array<string>"))
    repeats = lambda a: F.size(F.array_distinct(a)) < F.size(a)
    outside = lambda a, b: F.size(F.array_except(a, b)) > 0
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    answerable = F.coalesce(F.col("status") == "answerable", F.lit(False))
    checks = {
        "empty query id or query": blank("query_id") | blank("query"),
        "unknown status": ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)),
        "judgements are no list": F.col(RELEVANT).isNull(),
        "repeated judgement": repeats(relevant),
        "answerable without judgements": answerable & (F.size(relevant) == 0),
        "unsupported with judgements": F.coalesce(F.col("status") == "unsupported", F.lit(False)) & (F.size(relevant) > 0),
        "primary target outside judgements": F.col("primary_target_chunk_id").isNotNull() & ~F.array_contains(relevant, F.col("primary_target_chunk_id")),
        "groups of a query that is not answerable": ~answerable & (F.size(groups) > 0),
        "empty group": F.exists(groups, lambda g: F.size(members(g)) == 0),
        "repeated id in a group": F.exists(groups, lambda g: repeats(members(g))),
        "group outside judgements": F.exists(groups, lambda g: outside(members(g), relevant)),
    }
    # One pass over the queries for all checks of single rows.
    named = F.filter(F.array(*(F.when(bad, F.lit(rule)) for rule, bad in checks.items())), lambda r: r.isNotNull())
    out = queries.select(F.explode(named).alias("rule"), F.col("query_id").alias("key"))
    repeated = queries.groupBy("query_id").count().where("count > 1").select(F.lit("repeated query id").alias("rule"), F.col("query_id").alias("key"))
    cited = queries.select(F.explode(F.array_union(relevant, F.flatten(F.transform(groups, members)))).alias("target_chunk_id")).distinct()
    unknown = cited.join(targets.select("target_chunk_id"), "target_chunk_id", "left_anti").select(F.lit("unknown target").alias("rule"), F.col("target_chunk_id").alias("key"))
    none = queries.agg(F.count("*").alias("n"), F.count_if(answerable).alias("a")).where("a = 0").select(F.when(F.col("n") == 0, "empty query set").otherwise("no answerable query").alias("rule"), F.lit(None).cast("string").alias("key"))
    return out.unionByName(repeated).unionByName(unknown).unionByName(none)


def judgements(queries: DataFrame) -> DataFrame:
    """query_id, target of the answerable queries."""
    return queries.where("status = 'answerable'").select("query_id", F.explode(RELEVANT).alias("target")).distinct()


def evidence_groups(queries: DataFrame) -> DataFrame:
    """query_id, entity (the group's place where it names none), target."""
    flat = queries.where("status = 'answerable'").select("query_id", F.posexplode(GROUPS).alias("place", "g"))
    return flat.select("query_id", F.concat_ws(":", "place", "g.entity").alias("entity"), F.explode("g.target_chunk_ids").alias("target"))


def status_counts(queries: DataFrame) -> DataFrame:
    return queries.groupBy("status").agg(F.count("*").alias("query_count"))


def _runs(words: Column) -> Column:
    """Hashes of all runs of RUN words, each once."""
    places = F.when(F.size(words) >= RUN, F.sequence(F.lit(1), F.size(words) - (RUN - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.xxhash64(*(F.element_at(words, i + k) for k in range(RUN)))))


def containing(docs: DataFrame, id_col: str, text: str, needles: DataFrame, key: str, needle: str) -> DataFrame:
    """key, id_col: the documents whose text holds the needle verbatim.

    A document that holds a needle holds its inner words whole, those between its first and last blank, so needles are
    looked up by one run of RUN inner words: the run that the fewest documents hold. Pairs that meet by a run are verified.
    Needles of fewer inner words are found in one pass over each text by an automaton of them all; they are counted first,
    and go in blocks where they are many.
    """
    # Words are columns before runs are made of them, or each run would split its text again.
    split = lambda c: F.split(F.coalesce(F.col(c), F.lit("")), r"[\x20\x09-\x0D]+", -1)
    parted = needles.select(key, needle, split(needle).alias("__qs_w")).where(F.col(needle).isNotNull())
    rows = parted.withColumn("__qs_w", F.slice("__qs_w", 2, F.greatest(F.size("__qs_w") - 2, F.lit(0)))).withColumn("__qs_runs", _runs(F.col("__qs_w")))
    long_ = rows.where(F.size("__qs_runs") > 0)
    wanted = long_.select(key, F.explode("__qs_runs").alias("__qs_run"))
    held = docs.select(id_col, split(text).alias("__qs_w")).select(id_col, F.explode(_runs(F.col("__qs_w"))).alias("__qs_run")).join(wanted.select("__qs_run").distinct(), "__qs_run", "left_semi")
    # Written once: the runs are counted, and then looked up. A run that no needle has is gone before.
    held = lineage.cut(held)
    counted = wanted.join(held.groupBy("__qs_run").agg(F.count("*").alias("n")), "__qs_run", "left")
    rarest = counted.groupBy(key).agg(F.min_by("__qs_run", F.struct(F.coalesce("n", F.lit(0)), "__qs_run")).alias("__qs_run"))
    met = lineage.cut(held.join(rarest, "__qs_run").join(long_.select(key, needle), key).select(key, id_col, needle))
    few = met.count() <= MOST_MET
    found = docs.select(id_col, text).join(F.broadcast(met) if few else met, id_col).where(F.contains(text, needle)).select(key, id_col)
    short = rows.where(F.size("__qs_runs") == 0).select(key, needle)
    n = short.count()
    blocks = 0 if not n else 1 if n <= MOST_QUERIES else -(-2 * n // MOST_QUERIES)
    for b in range(blocks):
        block = short if blocks == 1 else short.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b)
        found = found.unionByName(_spotted(docs, id_col, text, block, key, needle))
    return found


def _spotted(docs: DataFrame, id_col: str, text: str, needles: DataFrame, key: str, needle: str) -> DataFrame:
    """key, id_col: as containing(), by one automaton of the needles (at most MOST_QUERIES) for each task."""
    table = needles.toArrow().combine_chunks()
    sent = docs.sparkSession.sparkContext.broadcast((table.column(key).combine_chunks(), table.column(needle).to_pylist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, words = sent.value
        places: dict[str, list[int]] = {}
        for i, word in enumerate(words):
            places.setdefault(word, []).append(i)
        everywhere = places.pop("", [])
        automaton = ahocorasick.Automaton()
        for word, at in places.items():
            automaton.add_word(word, at)
        automaton.make_automaton()
        for b in batches:
            row, hit = [], []
            for r, t in enumerate(b.column(text).to_pylist()):
                if t is None:
                    continue
                seen = set(everywhere)
                if places:
                    for _, at in automaton.iter(t):
                        seen.update(at)
                row += [r] * len(seen)
                hit += seen
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(hit, pa.int64())), b.column(id_col).take(pa.array(row, pa.int64()))], [key, id_col])

    schema = T.StructType([needles.schema[key], docs.schema[id_col]])
    return docs.select(id_col, text).mapInArrow(run, schema)


def passage_judgements(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """docs: doc_id, text; passages: query_id, passage. query_id, target: documents that hold the passage verbatim."""
    return containing(docs, "doc_id", "text", passages, "query_id", "passage").withColumnRenamed("doc_id", "target")


def anchored_judgements(docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """docs: target, document; anchors: query_id, anchors array<string>. query_id, target, is_primary.

    A document fits if it holds all anchors, without regard to case and white space; the shortest one is primary (ties:
    smaller target). An empty anchor list fits nothing. Each anchor is looked up by itself.
    """
    plain = lambda x: F.lower(normalize_space(x))
    whole = docs.select("target", plain(F.col("document")).alias("text"))
    each = anchors.where(F.size("anchors") > 0).select("query_id", F.explode(F.array_distinct(F.transform("anchors", plain))).alias("anchor"))
    needles = each.select("anchor").distinct()
    hits = containing(whole, "target", "text", needles.select(F.col("anchor").alias("needle_id"), "anchor"), "needle_id", "anchor").withColumnRenamed("needle_id", "anchor")
    need = each.groupBy("query_id").agg(F.count("*").alias("need"))
    full = each.join(hits, "anchor").groupBy("query_id", "target").agg(F.count_distinct("anchor").alias("has")).join(need, "query_id").where("has = need").select("query_id", "target")
    out = full.join(whole.select("target", F.length("text").alias("n")), "target")
    first = out.groupBy("query_id").agg(F.min(F.struct("n", "target")).alias("first"))
    return out.join(first, "query_id").select("query_id", "target", (F.col("target") == F.col("first.target")).alias("is_primary"))


def assembled_groups(plan: DataFrame, judged: DataFrame) -> DataFrame:
    """plan: query_id, entity, from_query; judged: query_id, target. Evidence groups (query_id, entity, target) out of other queries'."""
    return plan.join(judged.select(F.col("query_id").alias("from_query"), "target"), "from_query").select("query_id", "entity", "target").distinct()

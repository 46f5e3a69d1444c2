"""Mixing sources to target weights: fixed-length blocks, multinomial shards and pseudorandom index permutations.

A source's words, its documents in a fixed order, are packed into blocks of BLOCK words. A source's target says how many
block slots it fills: whole passes over its blocks, then the first blocks of one more pass, the last slot cut so that
the words meet the target exactly. The mix has as many slots as all sources fill, in output shards of SHARD_SLOTS.

Every slot of a shard draws its source by the sources' shares of the slots, so a shard's source counts are a multinomial
draw. The draws are then reconciled with the targets: a source's slots are numbered over the shards in order, those beyond
what it fills are given, one by one, to the sources that were drawn too seldom (about the square root of all slots).
Within a shard, a pseudorandom permutation gives the places of the sources' slots; within a source and pass, slots are
mapped through a pseudorandom permutation of its block numbers, and slots and blocks are joined by that index. The short
last block of a source is the last of its pass.

The permutations are swap-or-not ciphers (Hoang, Morris, Rogaway 2012), which work on any range; keys and draws come from
xxhash64 of SEED, so reruns agree. All of it is DataFrame expressions.

Null text has no words, null source is a source of its own and the last. Documents without words take part with nothing
taken. Repeated rows are separate documents. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstrata.llm.common import cut, join_counted, text_key, text_or_empty, word_count

BLOCK = 512
SHARD_SLOTS = 1_024
SEED = 20_24
ROUNDS = 16
# Weights in the order of sources, repeating, and the mix's share of all words.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_PASSES = 2
#: Parts into which a source's documents are dealt for running sums, and shards whose draws are summed together.
BUCKETS = 1_024
SHARDS_A_PART = 1_024
#: Cells of the unit interval by which a draw finds its source.
CELLS = 4_096


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """The place of x in a pseudorandom permutation of 0 .. n-1."""

    def turn(at: Column, i: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), i, *key), n) - at, n)
        swap = F.xxhash64(F.lit(SEED + 1), i, *key, F.greatest(at, other)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), turn)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """s (key), source, source_size, target: one row a source; the table is as long as there are sources.

    Filling by weight up to the caps: with sources in the order of cap / weight, the sources that end at their cap come
    first, and the first one whose share of what is left stays below its cap ends them.
    """
    totals = sizes.groupBy("s", "source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    weighed = totals.withColumn("w", weight.cast("double")).withColumn("cap", (F.col("source_size") * MOST_PASSES).cast("double"))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), "s")
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    left = F.lit(share) * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    levels = weighed.withColumn("left", left).withColumn("rest", F.sum("w").over(after))
    below = F.col("left") * F.col("w") / F.col("rest") < F.col("cap")
    ended = levels.withColumn("open", F.max(below).over(by_level.rowsBetween(Window.unboundedPreceding, 0)))
    first = lambda c: F.first(F.when(F.col("open"), F.col(c)), ignorenulls=True).over(Window.orderBy(F.col("cap") / F.col("w"), "s").rowsBetween(Window.unboundedPreceding, 0))
    return ended.withColumn("target", F.when(F.col("open"), first("left") * F.col("w") / first("rest")).otherwise(F.col("cap"))).select("s", "source", "source_size", "target")


def placed(sizes: DataFrame) -> DataFrame:
    """sizes (s, size, ...) with start, the first word's place among the source's words.

    Running sums are taken within BUCKETS parts of a source, so that a hot source spreads, then over the parts' totals.
    """
    dealt = sizes.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "k1", "k2", F.lit(SEED)), F.lit(BUCKETS)).cast("int"))
    parts = dealt.groupBy("s", "bucket").agg(F.sum("size").alias("part"))
    offset = F.sum("part").over(Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("part")
    order = Window.partitionBy("s", "bucket").orderBy("doc_id", "k1", "k2").rowsBetween(Window.unboundedPreceding, 0)
    run = dealt.withColumn("run", F.sum("size").over(order) - F.col("size"))
    return run.join(parts.select("s", "bucket", offset.alias("offset")), ["s", "bucket"]).withColumn("start", F.col("offset") + F.col("run")).drop("bucket", "run", "offset")


def slot_plan(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each source with slots: s, n (slots it fills), base (slots of the sources before it), and what places them."""
    full = F.floor(F.col("source_size") / block)
    return (
        targets.where("source_size > 0")
        .withColumn("words", F.round("target").cast("long"))
        .withColumn("full", full).withColumn("tail", F.col("source_size") - full * block)
        .withColumn("a_pass", F.col("full") + (F.col("tail") > 0).cast("long"))
        .withColumn("passes", F.floor(F.col("words") / F.col("source_size")))
        .withColumn("rest", F.col("words") - F.col("passes") * F.col("source_size"))
        .withColumn("n", F.col("passes") * F.col("a_pass") + F.ceil(F.col("rest") / block))
        .where("n > 0")
        .withColumn("base", F.sum("n").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
        .select("s", "n", "base", "full", "tail", "a_pass", "passes", "rest")
    )


def drawn_counts(plan: DataFrame, total: int, sources: int, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """shard, s, c: how many of a shard's slots draw each source."""
    parts = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = plan.sparkSession.range(0, total, 1, max(parts, total // 4_000_000 + 1)).select((F.col("id") / shard_slots).cast("long").alias("shard"), "id")
    u = F.xxhash64(F.lit(SEED + 2), "id").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    draws = place.select("shard", u.alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
    low, high = F.col("base") / F.lit(float(total)), (F.col("base") + F.col("n")) / F.lit(float(total))
    cells = plan.select("s", low.alias("low"), high.alias("high")).withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))))
    met = join_counted(draws, cells, CELLS + sources, ["cell"]).where((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")))
    return met.groupBy("shard", "s").agg(F.count("*").alias("c"))


def slots(targets: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix: shard, slot, s, pass, block, words (how many of the block's words, from its first, the slot takes)."""
    plan = cut(slot_plan(targets, block))
    size = plan.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, sources = int(size[0]), int(size[1])
    counts = cut(drawn_counts(plan, total, sources, shard_slots))
    # The number of a source's first slot in a shard, by running sums over parts of SHARDS_A_PART shards, then within them.
    part = counts.withColumn("part", (F.col("shard") / SHARDS_A_PART).cast("long"))
    run = lambda col, *by: F.sum(col).over(Window.partitionBy("s", *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, 0)) - F.col(col)
    parts = part.groupBy("s", "part").agg(F.sum("c").alias("all")).withColumn("before", run("all", "part")).drop("all")
    within = F.sum("c").over(Window.partitionBy("shard").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    numbered = part.withColumn("own", run("c", "part", "shard")).join(parts, ["s", "part"]).withColumn("at", within)
    first = F.col("before") + F.col("own")
    tasks = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = numbered.select("shard", "s", "at", first.alias("first"), "c").repartition(tasks, "shard", "s").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c") - 1)))
    here = F.least(F.lit(shard_slots), F.lit(total) - F.col("shard") * shard_slots)
    placed_ = each.select("shard", permuted(F.col("at") + F.col("k"), here, F.lit("slots"), F.col("shard")).alias("slot"), "s", (F.col("first") + F.col("k")).alias("r"))
    # Reconciled: slots that a source was drawn beyond its n go to those drawn less, in the order of the sources.
    sums = counts.groupBy("s").agg(F.sum("c").alias("drawn"))
    over = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    spare, missing = F.greatest(F.col("drawn") - F.col("n"), F.lit(0)), F.greatest(F.col("n") - F.col("drawn"), F.lit(0))
    told = plan.join(sums, "s", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0))).withColumn("spare", spare).withColumn("missing", missing)
    told = cut(told.withColumn("spare_base", F.sum("spare").over(over) - F.col("spare")).withColumn("missing_base", F.sum("missing").over(over) - F.col("missing")))
    given = told.where("missing > 0").withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("missing") - 1))).select((F.col("missing_base") + F.col("g")).alias("q"), F.col("s").alias("to"), (F.col("drawn") + F.col("g")).alias("to_r"))
    known = join_counted(placed_, told.select("s", "n", "spare_base"), sources, ["s"])
    kept = known.where("r < n").select("shard", "slot", "s", "r")
    moved = known.where("r >= n").withColumn("q", F.col("spare_base") + F.col("r") - F.col("n")).join(given, "q").select("shard", "slot", F.col("to").alias("s"), F.col("to_r").alias("r"))
    at = (
        join_counted(kept.union(moved), told.select("s", "full", "tail", "a_pass", "passes", "rest"), sources, ["s"])
        .withColumn("pass", F.floor(F.col("r") / F.col("a_pass")))
        .withColumn("i", F.col("r") - F.col("pass") * F.col("a_pass"))
        .withColumn("block", F.when(F.col("i") == F.col("full"), F.col("full")).otherwise(permuted(F.col("i"), F.greatest(F.col("full"), F.lit(1)), F.col("s"), F.col("pass"))))
    )
    length = F.when(F.col("block") == F.col("full"), F.col("tail")).otherwise(F.lit(block))
    taken = F.when(F.col("pass") < F.col("passes"), length).otherwise(F.least(length, F.col("rest") - F.col("i") * block))
    return at.select("shard", "slot", "s", "pass", "block", taken.alias("words"))


def _sized(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    k1, k2 = text_key(text)
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), key.alias("s"), word_count(text).alias("size"), k1.alias("k1"), k2.alias("k2"))


def pieces(at: DataFrame, mix: DataFrame, block: int = BLOCK) -> DataFrame:
    """Join documents to slots by block index: the columns of at and pass, shard, slot, from_word, n (words of the document taken)."""
    last = F.floor((F.col("start") + F.col("size") - 1) / block)
    parts = at.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), last)))
    low = F.greatest(F.col("start"), F.col("block") * block)
    high = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("words"))
    # Slots grow with the corpus, though their plan starts at the small table of sources: never broadcast them.
    joined = parts.join(mix.select("s", "block", "pass", "shard", "slot", "words").hint("merge"), ["s", "block"])
    return joined.where(high > low).withColumn("from_word", low - F.col("start")).withColumn("n", high - low).drop("block", "words")


#: Where words of a document go: the shard and the slot in it, the pass, the first word and how many.
PLACE = ("shard", "slot", "pass", "from_word", "n")
PLACES = "array<struct<shard:bigint,slot:bigint,pass:bigint,from_word:bigint,n:bigint>>"


def _places() -> Column:
    return F.sort_array(F.collect_list(F.struct(*(F.col(c).cast("long").alias(c) for c in PLACE))))


def mix_report(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target (its source's), taken (words the mix takes, repeats counted), places.

    places: the output shards and slots that the words are dealt to (see PLACE), sorted.
    """
    sizes = cut(_sized(docs))
    targets = cut(source_targets(sizes))
    at = placed(sizes)
    taken = pieces(at.select("s", "start", "size"), slots(targets)).groupBy("s", "start").agg(F.sum("n").alias("taken"), _places().alias("places"))
    # start tells documents with words apart; those without take nothing.
    some = at.where("size > 0").join(taken, ["s", "start"], "left").select("doc_id", "s", "size", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("places", F.array().cast(PLACES)).alias("places"))
    none = sizes.where("size = 0").select("doc_id", "s", "size", F.lit(0).cast("long").alias("taken"), F.array().cast(PLACES).alias("places"))
    return some.union(none).join(F.broadcast(targets) if targets.count() <= 50_000 else targets, "s").select("doc_id", "size", "source_size", "target", "taken", "places")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as rows with the columns of docs and places: a document once for each pass that takes words of it.

    places: the output shards and slots that the row's words are dealt to (see PLACE), in the order of the words.
    Where a pass takes all its words the text is unchanged; else it is the words taken, joined by spaces, and n_chars
    follows it. Rows that repeat doc_id, source and text stand for one row, of which each pass takes what it takes of all.
    """
    sizes = cut(_sized(docs))
    targets = cut(source_targets(sizes))
    found = pieces(placed(sizes), slots(targets))
    each = found.groupBy("doc_id", "s", "k1", "k2", "size", "start", "pass").agg(F.sort_array(F.collect_list(F.struct("from_word", "n", "shard", "slot"))).alias("p"))
    keys = ["__qs_d", "__qs_s", "__qs_1", "__qs_2"]
    plan = each.groupBy(F.xxhash64("doc_id").alias("__qs_d"), F.col("s").alias("__qs_s"), F.col("k1").alias("__qs_1"), F.col("k2").alias("__qs_2")).agg(F.collect_list(F.struct("pass", "p", "size")).alias("__qs_p"))
    k1, k2 = text_key(text_or_empty())
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
    left = docs.withColumns({"__qs_d": F.xxhash64("doc_id"), "__qs_s": key, "__qs_1": k1, "__qs_2": k2}).dropDuplicates(keys)
    rows = left.join(plan, keys).withColumn("__qs_p", F.explode("__qs_p"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))
    cut_text = F.array_join(F.flatten(F.transform("__qs_p.p", lambda x: F.slice(words, (x["from_word"] + 1).cast("int"), x["n"].cast("int")))), " ")
    whole = F.aggregate("__qs_p.p", F.lit(0).cast("long"), lambda a, x: a + x["n"]) == F.col("__qs_p.size")
    out = rows.withColumn("text", F.when(whole, F.col("text")).otherwise(cut_text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    at = F.transform("__qs_p.p", lambda x: F.struct(*(F.col("__qs_p.pass") if c == "pass" else x[c] for c in PLACE))).cast(PLACES)
    return out.select(*(F.col(f"`{c}`") for c in docs.columns if c != "places"), at.alias("places"))

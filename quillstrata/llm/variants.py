"""Spelling variant grouping: words one edit apart, found with forward and backward minimal acyclic automata.

Words are counted over the whole corpus; words at one edit of each other are near; a word's form is its commonest near word
if that is common enough, and forms lead to a root.

Two words at one edit, the shorter of L characters, agree exactly in their first or in their last L // 2 characters. So
each word goes, for each L that it may meet partners at, to the group of its first and to that of its last half. A task
builds one minimal acyclic automaton for a run of whole groups: of the words as they are where the first half is exact, of
the words reversed where the last half is. Its states know how many words they lead to, so a path's skipped branches add up
to the word's number (a minimal perfect hash into the run's counts). A word walks its exact half and completes with one
error; what both directions find is deduplicated.

A group of more than GROUP words (one common half) is parted further: the characters between what is exact at the front
and at the back hold the error, so again their first or their last half is exact. This ends where one position is left,
which bounds a group by the alphabet; no pair is lost, and nothing is capped.

Null text has no words; a null doc_id counts as the empty string where runs are damaged. Rows that repeat a doc_id count
each. An empty table gives no words. Ties of forms go to the smallest word in code-point order.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstrata.llm.common import SLICE_BYTES, cut, lean, text_or_empty

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: One run in so many loses a character.
DAMAGE = 199
LEAST_LENGTH = 6
LEAST_COUNT = 5
FORM_RATIO = 5
#: Words of one group beyond which it is parted; distinct words that a task counts before it hands them on.
GROUP = 20_000
HELD_WORDS = 400_000


# --- Words ---------------------------------------------------------------------------------------------------------------


def damaged(run: str, doc_id: int | None, damage: int = DAMAGE) -> str:
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run if h % damage else run[: h % len(run)] + run[h % len(run) + 1 :]


def document_words(text: str, doc_id: int | None, damage: int = DAMAGE, least: int = LEAST_LENGTH) -> Counter:
    runs = Counter(RUN.findall(text.encode().lower().decode()))  # bytes.lower() changes A-Z only
    prefix, crc, found = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), zlib.crc32, Counter()
    for run, n in runs.items():
        if len(run) < least:
            continue
        h = crc(run.encode(), prefix)
        if h % damage == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < least:
                continue
        found[run] += n
    return found


def word_counts(docs: DataFrame, damage: int = DAMAGE, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: words of at least least_length characters that occur least_count times; docs: doc_id, text."""

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            step = max(1, b.num_rows * SLICE_BYTES // max(1, b.nbytes))
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                for i, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    counts.update(document_words(text, i, damage, least_length))
                if len(counts) > HELD_WORDS:
                    yield rows(counts)
                    counts = Counter()
        yield rows(counts)

    found = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(lean(run), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# --- Automata ------------------------------------------------------------------------------------------------------------


class Automaton:
    """The minimal acyclic automaton of distinct sorted words, which numbers them in that order.

    A state is (whether a word ends here, its edges: character -> (target, words passed over by taking it)); equal states
    are one. below: words that a state leads to.
    """

    def __init__(self, words: list[str]):
        self.final: list[bool] = []
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.below: list[int] = []
        self._known: dict[tuple, int] = {}
        # The path of the last word: characters leading on from each open state, with finished targets.
        path: list[tuple[bool, list[tuple[str, int]]]] = [(False, [])]
        last = ""
        for word in words:
            same = 0
            for x, y in zip(word, last):  # noqa: B905 the shorter one decides
                if x != y:
                    break
                same += 1
            self._close(path, last, same)
            path.extend((False, []) for _ in word[same:])
            path[-1] = (True, path[-1][1])
            last = word
        self._close(path, last, 0)
        self.root = self._state(path[0])

    def _close(self, path: list, last: str, keep: int) -> None:
        while len(path) > keep + 1:
            state = self._state(path.pop())
            path[-1][1].append((last[len(path) - 1], state))

    def _state(self, open_: tuple[bool, list[tuple[str, int]]]) -> int:
        final, out = open_
        key = (final, *out)
        at = self._known.get(key)
        if at is None:
            at = self._known[key] = len(self.final)
            passed, edges = int(final), {}
            for c, target in out:
                edges[c] = (target, passed)
                passed += self.below[target]
            self.final.append(final)
            self.edges.append(edges)
            self.below.append(passed)
        return at

    def walk(self, word: str, start: int, state: int, number: int) -> tuple[int, int] | None:
        """Where word[start:] leads from a state, and the sum of words passed over."""
        edges = self.edges
        for c in word[start:]:
            step = edges[state].get(c)
            if step is None:
                return None
            state, number = step[0], number + step[1]
        return state, number

    def one_error(self, word: str, exact: int) -> set[int]:
        """Numbers of the words at exactly one edit of word that begin with its first exact characters."""
        found: set[int] = set()
        at = self.walk(word[:exact], 0, self.root, 0)
        if at is None:
            return found
        state, number = at

        def rest(start: int, state: int, number: int) -> None:
            end = self.walk(word, start, state, number)
            if end and self.final[end[0]]:
                found.add(end[1])

        for i in range(exact, len(word) + 1):
            c = word[i] if i < len(word) else None
            if c is not None:
                rest(i + 1, state, number)  # c left out
            for x, (target, passed) in self.edges[state].items():
                if x != c:
                    rest(i, target, number + passed)  # x put in; before an equal character it is the same as after it
                    if c is not None:
                        rest(i + 1, target, number + passed)  # x for c
            if c is None:
                break
            step = self.edges[state].get(c)
            if step is None:
                break
            state, number = step[0], number + step[1]
        return found


# --- Pairs ---------------------------------------------------------------------------------------------------------------


def _halves(counts: DataFrame, least_length: int) -> DataFrame:
    """size, front, back, half, word, n: the groups of first and last halves; front and back: how many characters are exact."""
    length = F.length("word")
    sized = counts.withColumn("size", F.explode(F.when(length > least_length, F.array(length, length - 1)).otherwise(F.array(length))))
    half = F.floor(F.col("size") / 2).cast("int")
    both = sized.withColumn("side", F.explode(F.array(F.lit(True), F.lit(False))))
    return both.select("size", F.when(F.col("side"), half).otherwise(0).alias("front"), F.when(F.col("side"), 0).otherwise(half).alias("back"), "word", "n")


def _group() -> list:
    return [F.col("size"), F.col("front"), F.col("back"), F.expr("left(word, front)").alias("head"), F.expr("right(word, back)").alias("tail")]


def grouped_words(counts: DataFrame, least_length: int = LEAST_LENGTH, group: int = GROUP) -> DataFrame:
    """size, front, back, word, n of words that share a group with others, in groups of at most group words or one open position."""
    rows, done = _halves(counts, least_length), []
    while True:
        keyed = rows.select(*_group(), "word", "n")
        # Sizes of groups; most words have a group of their own, which no pair needs.
        sizes = keyed.groupBy("size", "front", "back", "head", "tail").agg(F.count("*").alias("rows")).where("rows > 1")
        kept = cut(keyed.join(sizes, ["size", "front", "back", "head", "tail"]))
        open_ = F.col("size") - F.col("front") - F.col("back")
        big = (F.col("rows") > group) & (open_ > 1)
        done.append(kept.where(~big).drop("rows"))
        if not kept.where(big).limit(1).count():
            break
        half = F.floor(open_ / 2).cast("int")
        parted = kept.where(big).withColumn("side", F.explode(F.array(F.lit(True), F.lit(False))))
        rows = parted.select("size", F.when(F.col("side"), F.col("front") + half).otherwise(F.col("front")).alias("front"), F.when(F.col("side"), F.col("back")).otherwise(F.col("back") + half).alias("back"), "word", "n")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def matches(words: list[tuple[str, int]], size: int, front: int, back: int) -> Iterator[tuple[str, str, int]]:
    """(word, near word, its count) of words in groups of size: the longer exact side picks the automaton's direction."""
    turn = front < back
    exact = max(front, back)
    rows = sorted((w[::-1] if turn else w, n) for w, n in words)
    automaton = Automaton([w for w, _ in rows])
    for w, _ in rows:
        for number in automaton.one_error(w, exact):
            near, n = rows[number]
            # Words of size + 1 meet each other in their own groups.
            if len(w) == size or len(near) == size:
                yield (w[::-1], near[::-1], n) if turn else (w, near, n)


def near_words(counts: DataFrame, least_length: int = LEAST_LENGTH, group: int = GROUP) -> DataFrame:
    """word, near, near_n: every ordered pair of words at exactly one edit; counts: word, n."""
    keys = ["size", "front", "back", "head", "tail"]
    schema = "word string, near string, near_n long"

    def pairs(rows: list[tuple[str, int]], size: int, front: int, back: int) -> Iterator[pa.RecordBatch]:
        out = {(w, v): n for w, v, n in matches(list(dict(rows).items()), size, front, back)}
        yield pa.RecordBatch.from_arrays([pa.array((w for w, _ in out), pa.string()), pa.array((v for _, v in out), pa.string()), pa.array(out.values(), pa.int64())], ["word", "near", "near_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int]] = []
        shape = None
        table = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in (*keys, "word", "n")), strict=True))
        for key, rows in groupby(table, key=lambda r: r[:5]):
            # Groups of one shape go into one automaton until it holds enough words.
            if held and (key[:3] != shape or len(held) >= GROUP):
                yield from pairs(held, *shape)
                held = []
            shape = key[:3]
            held += [r[5:] for r in rows]
        if held:
            yield from pairs(held, *shape)

    dealt = grouped_words(counts, least_length, group).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(lean(run), schema).distinct()


def variant_forms(counts: DataFrame, least_length: int = LEAST_LENGTH, ratio: int = FORM_RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n; counts: word, n."""
    counts = cut(counts)
    best = near_words(counts, least_length).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("b"))
    is_form = -F.col("b.m") >= ratio * F.col("n")
    found = cut(counts.join(best, "word", "left").select("word", F.when(is_form, F.col("b.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, -F.col("b.m")).alias("form_n")))
    # Each form is commoner by the ratio, so a chain is short; pointers to the word after next halve it a round.
    links = found.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = cut(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = links.where("moved").limit(1).count()
        links = links.select("word", "root")
        if not moved:
            break
    return found.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    return variant_forms(word_counts(docs.select("doc_id", "text")))

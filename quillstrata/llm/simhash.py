"""SimHash near-duplicates: a byte-position inverted index with count filtering, then verification.

A fingerprint has eight positional bytes. Fingerprints that differ in at most two bits differ in at most two bytes, so
at least six positional bytes match: LEAST, the guaranteed minimum. A posting list of a single positional byte would hold
1/256 of the corpus, and its pairs would grow with the square. So the index is split first: bytes are taken in four
neighbouring couples, of which at least two match whole, and a list is keyed by two couples (six choices of them, four
bytes, a 2^-32th of evenly spread fingerprints). Within a list the other four positions are indexed one by one: every
posting of a single byte adds one to the tally of each pair in it, pairs that reach LEAST with the four bytes of the key
are candidates, and candidates are verified bit by bit.

Lists of more than SHORT fingerprints are split again instead of tallied in one go: candidates in them share two of the
four open bytes, so their members go to the six lists of all six bytes, where every pair has reached LEAST. Such a list
holds at most 65,536 distinct fingerprints (those of the two free bytes), and looks up the 136 two-byte patterns of at
most two bits for each instead of trying all pairs. No pair is left out either way.
A list reports a spanning forest of its verified links, which keeps every connection and stays linear.

Only distinct fingerprints enter the index, so exact copies and large groups cost one entry. Null or empty text has
fingerprint zero and links like any other. Repeated rows share their component. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstrata.llm.common import cut, lean, map_texts, text_or_empty
from quillstrata.llm.components import connected_components

SHINGLE = 3
MAX_BITS = 2
SEED = 42
#: Positional bytes that a pair within MAX_BITS shares at least.
LEAST = 8 - MAX_BITS
#: Fingerprints of a list up to which pairs are tallied; lists of more are split by two further bytes.
SHORT = 512


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the text's word shingles, repeats included; A-Z are lower-cased."""
    # Bytes methods know ASCII only, which is the case rule and the word rule here.
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    row = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    digest, last = xxhash.xxh64_intdigest, len(words) - shingle + 1
    h = np.array([digest(row[a:b], SEED) for a, b in zip(starts[:last].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, last, 1 << 16):
        part = h[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > last, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (signed 64 bits) per row."""

    def make():
        return lambda texts: [np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)]

    return map_texts(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")), make, {"fp": "long"})


def _patterns(bits: int) -> list[int]:
    """16-bit patterns of 1 to bits ones."""
    return [sum(1 << i for i in c) for k in range(1, bits + 1) for c in combinations(range(16), k)]


def _lanes(free: int) -> list[int]:
    return [k for k in range(8) if free >> (8 * k) & 1]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """(member, least member) of what the links i, j join among n."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [(x, find(x)) for x in range(n) if find(x) != x]


def tallied(fps: np.ndarray, free: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j that share at least least positional bytes; fps (unsigned) agree outside the mask free.

    The inverted index of each open position: a posting is the fingerprints of one byte value, and counts once for each of its pairs.
    """
    n, lanes = len(fps), _lanes(free)
    pairs = []
    for k in lanes:
        own = (fps >> np.uint64(8 * k)) & np.uint64(255)
        order = np.argsort(own, kind="stable")
        ends = np.flatnonzero(np.concatenate([own[order][1:] != own[order][:-1], [True]])) + 1
        starts = np.concatenate([[0], ends[:-1]])
        for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
            x, y = np.triu_indices(b - a, 1)
            pairs.append(order[a + x] * n + order[a + y])
    if not pairs:
        none = np.zeros(0, np.int64)
        return none, none
    pair, count = np.unique(np.concatenate(pairs), return_counts=True)
    pair = pair[count >= least - (8 - len(lanes))]
    return pair // n, pair % n


def forest(fps: np.ndarray, free: int, bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Links (place, least place) that join what pairs of at most bits differing bits join; tallied, then verified."""
    x = fps.view(np.uint64)
    if len(x) == 2:  # one pair: its tally is its equal bytes
        apart = int(x[0] ^ x[1])
        return [(1, 0)] if apart.to_bytes(8).count(0) >= 8 - bits and apart.bit_count() <= bits else []
    i, j = tallied(x, free, 8 - bits)
    ok = np.bitwise_count(x[i] ^ x[j]) <= bits
    return _forest(len(x), i[ok], j[ok])


def probed_forest(fps: np.ndarray, free: int, bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """As forest(), for distinct fingerprints that agree outside the two bytes free: by looking up patterns."""
    x, lanes = fps.view(np.uint64), _lanes(free)
    low = ((x >> np.uint64(8 * lanes[0])) & np.uint64(255) | ((x >> np.uint64(8 * lanes[1])) & np.uint64(255)) << np.uint64(8)).astype(np.int64)
    where = np.full(1 << 16, -1, np.int64)
    where[low] = np.arange(len(x))
    i, j = [], []
    for p in _patterns(bits):
        other = where[low ^ p]
        at = np.flatnonzero(other > np.arange(len(x)))
        i.append(at)
        j.append(other[at])
    return _forest(len(x), np.concatenate(i), np.concatenate(j))


def _mask(lanes: Iterable[int]) -> int:
    return sum(0xFF << (8 * k) for k in lanes)


#: Open bytes of the six kinds of list: all but two of the four couples.
OPEN = [_mask(k for c in range(4) if c not in kept for k in (2 * c, 2 * c + 1)) for kept in combinations(range(4), 2)]
#: Free bytes of the lists that a long one is split into, by kind.
SPLIT = [[_mask(pair) for pair in combinations(_lanes(free), 2)] for free in OPEN]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _lists(rows: DataFrame, small: Callable[[int, np.ndarray], list[tuple[int, int]]], most: int) -> DataFrame:
    """rows: kind, bytes, fp. a, b, kind: links of lists of at most most members (kind null), or a member of a longer list (a)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, passing = None, None  # members of the list that may go on, and whether it has outgrown most
        out: list[list] = [[], [], []]

        def passed_on(kind: int, fps: np.ndarray) -> None:
            out[0].extend(fps.tolist())
            out[1].extend([None] * len(fps))
            out[2].extend([kind] * len(fps))

        def close(kind: int, fps: np.ndarray) -> None:
            if len(fps) > 1:
                for i, j in small(kind, fps):
                    out[0].append(int(fps[i]))
                    out[1].append(int(fps[j]))
                    out[2].append(None)

        for b in batches:
            kind, key, fp = (b.column(c).to_numpy() for c in ("kind", "bytes", "fp"))
            if held is not None:
                kind, key, fp = (np.concatenate([x, y]) for x, y in zip(held, (kind, key, fp), strict=True))
            if not len(fp):
                continue
            ends = np.flatnonzero(np.concatenate([(kind[1:] != kind[:-1]) | (key[1:] != key[:-1]), [True]])) + 1
            starts = np.concatenate([[0], ends[:-1]])
            some = np.flatnonzero((ends - starts > 1) | (np.arange(len(starts)) == 0))
            for g in some.tolist():
                a, e, last = int(starts[g]), int(ends[g]), g == len(starts) - 1
                mine = (int(kind[a]), int(key[a]))
                if passing == mine or e - a > most:
                    passing = mine
                    passed_on(mine[0], fp[a:e])
                elif not last:
                    close(mine[0], fp[a:e])
            a = int(starts[-1])
            gone = passing == (int(kind[a]), int(key[a]))
            held = None if gone else tuple(x[a:].copy() for x in (kind, key, fp))
            yield _links(out)
            out = [[], [], []]
        if held is not None:
            close(int(held[0][0]), held[2])
        yield _links(out)

    return rows.sortWithinPartitions("kind", "bytes").mapInArrow(lean(run), "a long, b long, kind int")


def _links(columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int32()), strict=True)], ["a", "b", "kind"])


def _keyed(fp: Column, masks: list[int]) -> Column:
    """Structs of each mask's place and the bytes of fp outside it."""
    return F.array(*(F.struct(F.lit(i).alias("kind"), fp.bitwiseAND(F.lit(_signed(~m & 0xFFFFFFFFFFFFFFFF)).cast("long")).alias("bytes")) for i, m in enumerate(masks)))


def links(distinct_fps: DataFrame, short: int = SHORT) -> DataFrame:
    """a, b: links among distinct fingerprints (column fp), enough to join whatever chains of close pairs join."""
    postings = distinct_fps.select("fp", F.explode(_keyed(F.col("fp"), OPEN)).alias("k")).select("k.*", "fp")
    first = cut(_lists(postings.repartition("kind", "bytes"), lambda kind, fps: forest(fps, OPEN[kind]), short))
    deep = F.element_at(F.array(*(_keyed(F.col("a"), masks) for masks in SPLIT)), F.col("kind") + 1)
    # A list's kind of the second split is told by its first kind and the choice of the free bytes.
    split = first.where("kind is not null").select("a", "kind", F.explode(deep).alias("k")).select((F.col("kind") * 6 + F.col("k.kind")).cast("int").alias("kind"), "k.bytes", F.col("a").alias("fp"))
    second = _lists(split.repartition("kind", "bytes"), lambda kind, fps: probed_forest(fps, SPLIT[kind // 6][kind % 6]), 1 << 16)
    return first.where("kind is null").select("a", "b").union(second.select("a", "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Per row of docs: doc_id, fp, component_id (the least doc_id of all rows whose fingerprints chains of links join)."""
    marked = cut(fingerprints(docs, id_col, text_col, shingle))
    # A fingerprint is a few bytes here but six postings next, so adaptive execution must not merge its tasks by their bytes.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")).repartition(tasks, "fp"))
    roots = connected_components(links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    rooted = cut(distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # One row a fingerprint on the right: adaptive execution splits a hot fingerprint's rows on the left.
    of = cut(rooted.join(least, "root").select("fp", "component_id"))
    return marked.join(of, "fp").select("doc_id", "fp", "component_id")


def simhash_digests(docs: DataFrame) -> DataFrame:
    out = near_duplicates(docs.select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

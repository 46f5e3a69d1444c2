"""SimHash near-duplicates at a Jaccard similarity: the byte-position index over wide fingerprints, then exact verification.

At a similarity of 0.8 a 64-bit fingerprint differs in ten bits, which leaves too few equal bytes to filter by. So the
fingerprint here has WIDE_BYTES positional bytes, postings are keyed by three positional bytes (KEYS sets of them), and
what a pair must reach is a bound on differing bits (MOST_BITS, four standard deviations above the mean at 0.8). Pairs
that pass it are verified by the exact Jaccard similarity of their word shingles. A pair at 0.8 meets in some posting with
a probability of 0.97, at 0.85 of 0.999: unlike the two-bit links this search is not exhaustive (README).

Postings of one text are dropped first. The first round only saves work: over FIRST_KEYS sets of positions, all pairs of
a posting of at most ALL_PAIRS texts are tried; in longer ones the first text leads, those close to it are linked to it,
and the rest go on with their own first text. What verified links join is one root. The second round, over all sets of
positions, leaves nothing out: every pair of different
roots that shares a posting and differs in at most MOST_BITS is verified, however long the posting; all texts of a root
take part wherever another root shares the posting. Long postings are
dealt to blocks of about BLOCK texts, and two blocks meet in a task of their own. Pairs of one root are joined already, so
large groups of copies that face no other text cost nothing there; unlike texts of a hot source are compared with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstrata.llm.common import Scratch, cut, lean, map_texts, text_key, text_or_empty
from quillstrata.llm.components import connected_components

SHINGLE = 5
SIMILARITY = 0.8
WIDE_BYTES = 64
KEYS = 192
MOST_BITS = 110
ALL_PAIRS = 4
#: Pairs of a root that a round verifies; None: all that are left. Pairs that meet in one task.
TRIES = (1, 8, 64, None)
CELL = 1_024
#: Keys of the first round.
FIRST_KEYS = 32
#: Texts of a long posting that one task holds on either side; rows compared at a time.
BLOCK, STRIP = 2_048, 256
_LANES = WIDE_BYTES // 8
_SEEDS = np.array([xxhash.xxh64_intdigest(b"lane %d" % i) | 1 for i in range(_LANES)], np.uint64)


def _triples() -> np.ndarray:
    """KEYS sets of three byte positions, each position about as often: shuffles of all positions, cut into threes."""
    rng = np.random.default_rng(5)
    row = np.concatenate([rng.permutation(WIDE_BYTES)[: WIDE_BYTES // 3 * 3] for _ in range(KEYS // (WIDE_BYTES // 3) + 1)])
    return row.reshape(-1, 3)[:KEYS]


TRIPLES = _triples()


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of the text's word shingles; of the whole row of words where it is shorter; none without words."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    row = b" ".join(words)
    last = len(words) - shingle + 1
    if last < 2:
        return np.array([xxhash.xxh64_intdigest(row, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(row[a:b], 42) for a, b in zip(starts[:last].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64))


def wide_fingerprint(text: str, shingle: int = SHINGLE) -> bytes:
    h = shingle_hashes(text, shingle)
    ones = np.zeros((_LANES, 64), np.int64)
    for at in range(0, len(h), 1 << 15):
        for k in range(_LANES):
            x = h[at : at + (1 << 15)] * _SEEDS[k]
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
            ones[k] += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(h), axis=1, bitorder="little").tobytes()


def posting_keys(fp: bytes) -> np.ndarray:
    b = np.frombuffer(fp, np.uint8).astype(np.int32)[TRIPLES]
    return (b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16).astype(np.int64) | np.arange(KEYS, dtype=np.int64) << 24


def _postings(texts: DataFrame, keys: int, fold: bool = True) -> DataFrame:
    """texts: id, root, fp. post, root, id: the first keys postings of each text; fold: of a batch's texts of one root, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column("fp").to_pylist()
            post = np.concatenate([posting_keys(f)[:keys] for f in fps]) if fps else np.zeros(0, np.int64)
            ids, roots = (np.repeat(b.column(c).to_numpy(), keys) for c in ("id", "root"))
            _, place, count = np.unique(b.column("root").to_numpy(), return_inverse=True, return_counts=True)
            again = np.repeat(count[place] > 1, keys)
            if fold and again.any():
                at = np.flatnonzero(again)
                at = at[np.lexsort((ids[at], roots[at], post[at]))]
                new = np.concatenate([[True], (post[at[1:]] != post[at[:-1]]) | (roots[at[1:]] != roots[at[:-1]])])
                at = np.concatenate([np.flatnonzero(~again), at[new]])
                post, roots, ids = post[at], roots[at], ids[at]
            yield pa.RecordBatch.from_arrays([pa.array(post), pa.array(roots), pa.array(ids)], ["post", "root", "id"])

    return texts.select("id", "root", "fp").mapInArrow(lean(run), "post long, root long, id long")


def _with_prints(rows: DataFrame, texts: DataFrame, *columns: str) -> DataFrame:
    """columns, id, fp of rows (columns, id): a text's rows meet its fingerprint as one row, so that it is joined once a text."""
    packed = rows.groupBy("id").agg(F.collect_list(F.struct(*columns)).alias("x"))
    return packed.join(texts.select("id", "fp"), "id").select("id", "fp", F.explode("x").alias("x")).select(*(f"x.{c}" for c in columns), "id", "fp")


def _members(texts: DataFrame, keys: int) -> DataFrame:
    """post, id, fp of postings with at least two roots, a root's least text for each; texts: id, root, fp.

    Fingerprints are joined on last: only what is left in company after folding needs them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        carried = False  # the held row's posting has been seen twice already
        for b in batches:
            post = np.concatenate([held[0], b.column("post").to_numpy()])
            ids = np.concatenate([held[1], b.column("id").to_numpy()])
            same = post[1:] == post[:-1]
            twice = np.concatenate([[carried], same]) | np.concatenate([same, [False]])
            out = twice[:-1].copy()
            if carried and len(out):
                out[0] = False  # already given out
            # The last row is held back: whether it has company shows in the next batch.
            last = bool(same[-1]) if len(same) else carried
            keep = np.flatnonzero(out)
            now_post, now_ids = post[keep], ids[keep]
            held, give = (post[-1:], ids[-1:]), False
            if last and not (len(post) == 1 and carried):
                now_post, now_ids, give = np.append(now_post, post[-1]), np.append(now_ids, ids[-1]), True
            carried = give or (len(post) == 1 and carried)
            yield pa.RecordBatch.from_arrays([pa.array(now_post), pa.array(now_ids)], ["post", "id"])

    # The exchange by posting serves the grouping too.
    folded = _postings(texts, keys).repartition("post").groupBy("post", "root").agg(F.min("id").alias("id")).select("post", "id")
    return folded.sortWithinPartitions("post").mapInArrow(lean(run), "post long, id long").transform(lambda rows: _with_prints(rows, texts, "post"))


def _facing(texts: DataFrame, keys: int) -> DataFrame:
    """post, root, id of all texts in postings where at least two roots meet; texts: id, root, fp.

    Without fingerprints, which are most of a row: they are joined on once the rows go to the tasks that compare them.
    """

    def met(post: np.ndarray, roots: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate([[True], post[1:] != post[:-1]]))[: len(post)]
        if len(post):
            two = np.minimum.reduceat(roots, starts) != np.maximum.reduceat(roots, starts)
            keep = np.repeat(two, np.diff(np.append(starts, len(post))))
            post, roots, ids = post[keep], roots[keep], ids[keep]
        return pa.RecordBatch.from_arrays([pa.array(post), pa.array(roots), pa.array(ids)], ["post", "root", "id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        for b in batches:
            held = [np.concatenate([x, b.column(c).to_numpy()]) for x, c in zip(held, ("post", "root", "id"), strict=True)]
            # The last posting may go on in the next batch.
            ends = np.flatnonzero(held[0][1:] != held[0][:-1])
            if len(ends):
                yield met(*(x[: ends[-1] + 1] for x in held))
                held = [x[ends[-1] + 1 :].copy() for x in held]
        yield met(*held)

    rows = _postings(texts, keys, fold=False).repartition("post").sortWithinPartitions("post")
    return rows.mapInArrow(lean(run), "post long, root long, id long")


def close_pairs(ids: list[int], fps: np.ndarray, most: int = MOST_BITS) -> list[tuple[int, int, int]]:
    """(a, b, bits) of pairs of a posting whose fingerprints (rows of 64-bit lanes) differ in at most most bits; see ALL_PAIRS."""
    n = len(ids)

    def near(i: np.ndarray, j: np.ndarray) -> list[tuple[int, int, int]]:
        bits = np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1)
        ok = bits <= most
        return [(min(ids[a], ids[b]), max(ids[a], ids[b]), c) for a, b, c in zip(i[ok].tolist(), j[ok].tolist(), bits[ok].tolist(), strict=True)]

    if n <= ALL_PAIRS:
        return near(*np.triu_indices(n, 1))
    found, rest = [], np.arange(n)
    while len(rest) > 1:
        lead, rest = rest[0], rest[1:]
        bits = np.bitwise_count(fps[lead] ^ fps[rest]).sum(axis=1)
        close = bits <= most
        found += [(min(ids[lead], ids[i]), max(ids[lead], ids[i]), c) for i, c in zip(rest[close].tolist(), bits[close].tolist(), strict=True)]
        rest = rest[~close]
    return found


def _pairs(members: DataFrame, most: int) -> DataFrame:
    """a, b, bits: close pairs. members: post, id, fp; sorted by posting within a partition; at most chunk texts are held."""
    chunk = 2_048

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, fps = None, [], []

        def done() -> list[tuple[int, int, int]]:
            return close_pairs(ids, np.frombuffer(b"".join(fps), np.uint64).reshape(-1, _LANES), most) if len(ids) > 1 else []

        for b in batches:
            out: set[tuple[int, int, int]] = set()
            for p, i, f in zip(b.column("post").to_pylist(), b.column("id").to_pylist(), b.column("fp").to_pylist(), strict=True):
                if p != now:
                    out.update(done())
                    now, ids, fps = p, [], []
                elif len(ids) >= chunk:  # a long posting goes on with its first text
                    out.update(done())
                    ids, fps = ids[:1], fps[:1]
                ids.append(i)
                fps.append(f)
            yield _edge_batch(out)
        yield _edge_batch(done())

    return members.repartition("post").sortWithinPartitions("post", "id").mapInArrow(lean(run), "a long, b long, bits int").distinct()


def _apart(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Differing bits of every row of left and every row of right."""
    bits = np.zeros((len(left), len(right)), np.uint16)
    for k in range(_LANES):
        bits += np.bitwise_count(left[:, k, None] ^ right[None, :, k])
    return bits


def _first_shared(x: np.ndarray, y: np.ndarray, key: int) -> np.ndarray:
    """Which pairs of rows share no posting before that of key, so that each pair is given out by one posting only."""
    out = np.ones(len(x), bool)
    for at in range(0, len(x) if key else 0, 4_096):
        same = x[at : at + 4_096].view(np.uint8) == y[at : at + 4_096].view(np.uint8)
        out[at : at + 4_096] = ~same[:, TRIPLES[:key]].all(axis=2).any(axis=1)
    return out


Found = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def cross_pairs(key: int, ids: np.ndarray, roots: np.ndarray, fps: np.ndarray, split: int | None = None, most: int = MOST_BITS) -> Found:
    """(a, b, their roots, bits) of all pairs of different roots that differ in at most most bits and share no posting before key.

    split: only pairs of a row before it and one from it on (two blocks); None: all pairs of rows.
    """
    n = len(ids)
    if split is None:
        # Rows of the largest root meet the others only.
        names, counts = np.unique(roots, return_counts=True)
        left, right = np.flatnonzero(roots != names[counts.argmax()]), np.arange(n)
        counted = np.isin(right, left)
    else:
        left, right = np.arange(split), np.arange(split, n)
        counted = np.zeros(len(right), bool)
    found: list[Found] = [(np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.int32),)]
    for at in range(0, len(left), STRIP):
        rows = left[at : at + STRIP]
        bits = _apart(fps[rows], fps[right])
        ok = (bits <= most) & (roots[rows][:, None] != roots[right][None, :])
        ok &= ~counted[None, :] | (rows[:, None] < right[None, :])
        x, y = np.nonzero(ok)
        i, j, bits = rows[x], right[y], bits[x, y]
        new = _first_shared(fps[i], fps[j], key)
        i, j = i[new], j[new]
        i, j = np.where(ids[i] < ids[j], i, j), np.where(ids[i] < ids[j], j, i)
        found.append((ids[i], ids[j], roots[i], roots[j], bits[new].astype(np.int32)))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _compared(members: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, ra, rb, bits: all close pairs of different roots that share a posting. members: post, root, id; texts: id, fp."""
    long_ = members.groupBy("post").count().where(F.col("count") > BLOCK)
    parts = F.coalesce(F.ceil(F.col("count") / BLOCK), F.lit(1)).cast("int")
    dealt = members.join(long_, "post", "left").withColumn("parts", parts).withColumn("u", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = _with_prints(dealt.select("post", F.least("u", "v").alias("i"), F.greatest("u", "v").alias("j"), "u", "root", "id"), texts, "post", "i", "j", "u", "root")

    def pairs(table: tuple[np.ndarray, ...]) -> Found:
        post, i, j, u, roots, ids, fps = table
        ends = np.flatnonzero(np.concatenate([(post[1:] != post[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), [True]])) + 1
        found, start = [cross_pairs(0, ids[:0], roots[:0], fps[:0], 0)], 0
        for end in ends.tolist():
            r = roots[start:end]
            if end - start > 1 and (r[0] != r).any():
                split = int((u[start:end] == i[start]).sum()) if i[start] != j[start] else None
                found.append(cross_pairs(int(post[start]) >> 24, ids[start:end], r, fps[start:end], split))
            start = end
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(c).to_numpy() for c in ("post", "i", "j", "u", "root", "id")]
            new.append(np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint64).reshape(-1, _LANES))
            table = tuple(new) if held is None else tuple(np.concatenate(x) for x in zip(held, new, strict=True))
            post, i, j = table[:3]
            # The last group may go on in the next batch.
            last = int(np.flatnonzero(np.concatenate([[True], (post[1:] != post[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))[-1])
            held = tuple(x[last:].copy() for x in table)
            if last:
                yield from _edges(*pairs(tuple(x[:last] for x in table)))
        if held is not None:
            yield from _edges(*pairs(held))

    return dealt.repartition("post", "i", "j").sortWithinPartitions("post", "i", "j", F.col("u") != F.col("i"), "id").mapInArrow(lean(run), "a long, b long, ra long, rb long, bits int")


def _edges(*columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in columns], ["a", "b", "ra", "rb", "bits"])


def _edge_batch(pairs) -> pa.RecordBatch:
    rows = [x for x in pairs if x[0] != x[1]]
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32()))], ["a", "b", "bits"])


def _sets(texts: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """id, set (sorted hashes, eight bytes each): of the texts (id, text) that pairs name, once each."""
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    found = texts.join(wanted, "id").dropDuplicates(["id"])
    return map_texts(found, lambda: lambda rows: [[shingle_hashes(t, shingle).tobytes() for t in rows]], {"set": "binary"})


def _chosen(pairs: DataFrame, tries: int | None) -> DataFrame:
    """The pairs (a, b, ra, rb, bits) to verify next: of each root its tries closest; None: all."""
    if tries is None:
        return pairs
    sides = pairs.withColumn("root", F.explode(F.array("ra", "rb")))
    place = F.row_number().over(Window.partitionBy("root").orderBy("bits", "a", "b"))
    return sides.withColumn("place", place).where(F.col("place") <= tries).drop("root", "place").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """ra, rb of the pairs whose sets have at least that Jaccard similarity.

    Pairs of two roots meet in cells of about CELL; a set travels once to a cell, however many of its pairs are there.
    """
    sizes = pairs.groupBy("ra", "rb").agg(F.ceil(F.sqrt(F.count("*") / CELL)).cast("int").alias("p")).where("p > 1")
    p = F.coalesce("p", F.lit(1))
    celled = pairs.join(sizes, ["ra", "rb"], "left").withColumn("cell", F.xxhash64("ra", "rb", F.pmod(F.xxhash64("a"), p), F.pmod(F.xxhash64("b"), p)))
    ends = celled.select("cell", F.explode(F.array("a", "b")).alias("id")).distinct().join(sets, "id")
    none = lambda *names: [F.lit(None).cast("long").alias(c) for c in names]
    rows = ends.select("cell", F.lit(0).alias("kind"), F.col("id").alias("a"), *none("b", "ra", "rb"), "set").unionByName(celled.select("cell", F.lit(1).alias("kind"), "a", "b", "ra", "rb", F.lit(None).cast("binary").alias("set")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            good: set[tuple[int, int]] = set()
            for cell, kind, a, b, ra, rb, x in zip(*(batch.column(c).to_pylist() for c in ("cell", "kind", "a", "b", "ra", "rb", "set")), strict=True):
                if cell != now:
                    now, held = cell, {}
                if kind == 0:
                    held[a] = np.frombuffer(x, np.uint64)
                    continue
                x, y = held[a], held[b]
                least = similarity * (len(x) + len(y)) / (1 + similarity)  # what both must share
                if min(len(x), len(y)) >= least - 1e-9 and len(np.intersect1d(x, y, assume_unique=True)) >= least - 1e-9:
                    good.add((ra, rb))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in good], pa.int64()), pa.array([y for _, y in good], pa.int64())], ["ra", "rb"])

    return rows.repartition("cell").sortWithinPartitions("cell", "kind").mapInArrow(lean(run), "ra long, rb long").distinct()


def _composed(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """node, root: where old's roots, and nodes that only new knows, are now."""
    if old is None:
        return new
    later = new.select(F.col("node").alias("root"), F.col("root").alias("later"))
    moved = old.join(later, "root", "left").select("node", F.coalesce("later", "root").alias("root"))
    return moved.unionByName(new.join(old, "node", "left_anti").select("node", "root"))


def join_roots(pairs: DataFrame, sets: DataFrame, similarity: float, scratch: Scratch) -> DataFrame | None:
    """node (a root), root: what verified pairs (a, b, ra, rb, bits; kept) join; None: nothing.

    A spanning forest is enough, so each round verifies the closest pairs of each root, joins, and drops the pairs inside
    what is joined. Rounds try more and more pairs of a root, the last one all that still cross two: no pair is left out.
    """
    labels = None
    for tries in TRIES:
        chosen = scratch.keep(_chosen(pairs, tries))
        good = scratch.keep(_verified(chosen, sets, similarity))
        if tries is not None:
            pairs = pairs.join(chosen.select("a", "b"), ["a", "b"], "left_anti")
        if not good.isEmpty():
            new = scratch.keep(connected_components(good.select(F.col("ra").alias("a"), F.col("rb").alias("b"))))
            labels = scratch.keep(_composed(labels, new))
            for side in ("ra", "rb"):
                pairs = pairs.join(new.select(F.col("node").alias(side), F.col("root").alias("up")), side, "left").withColumn(side, F.coalesce("up", side)).drop("up")
            pairs = pairs.where("ra <> rb").select("a", "b", "ra", "rb", "bits")
        if tries is None:
            break
        pairs = scratch.keep(pairs)
        if pairs.isEmpty():
            break
    return labels


def similar_texts(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """id (64-bit hash of a text), root: every text, and what chains of verified pairs join it to."""
    texts = docs.select(text_key(text_or_empty())[0].alias("id"), text_or_empty().alias("text"))
    # Repeated texts give equal rows, which one aggregate folds before the index is built.
    marked = map_texts(texts, lambda: lambda rows: [[wide_fingerprint(t, shingle) for t in rows]], {"fp": "binary"})

    def moved(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
        if labels is None:
            return rows
        return rows.join(labels.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left").withColumn("root", F.coalesce("up", "root")).drop("up")

    with Scratch(docs.sparkSession) as scratch:
        distinct = scratch.keep(marked.groupBy("id").agg(F.max("fp").alias("fp")))
        alone = distinct.withColumn("root", F.col("id"))
        first = scratch.keep(_pairs(_members(alone, FIRST_KEYS), MOST_BITS).withColumns({"ra": F.col("a"), "rb": F.col("b")}))
        rooted = scratch.keep(moved(alone, join_roots(first, scratch.keep(_sets(texts, first, shingle)), similarity, scratch)))
        met = scratch.keep(_facing(rooted, KEYS))
        second = scratch.keep(_compared(met, distinct))
        return cut(moved(rooted, join_roots(second, scratch.keep(_sets(texts, second, shingle)), similarity, scratch)).select("id", "root"))


def keep_one_each(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, with its columns, one of each group of exact or near copies: that of the least doc_id.

    Ties (rows that share the least doc_id) go to the text of the lesser hash; of repeated rows one stays. A row without
    doc_id comes last. Texts without words are one group.
    """
    k1, k2 = text_key(text_or_empty())
    no_word = ~text_or_empty().rlike(r"[^\x20\x09-\x0D]")
    marked = docs.withColumns({"__qs_1": F.when(no_word, F.xxhash64(F.lit(""))).otherwise(k1), "__qs_2": k2})
    keys = marked.select("doc_id", "__qs_1", "__qs_2").groupBy("__qs_1").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "__qs_2")).alias("first"))
    roots = similar_texts(docs.where(~no_word), shingle, similarity).select(F.col("id").alias("__qs_1"), "root")
    rooted = cut(keys.join(roots, "__qs_1", "left").withColumn("root", F.coalesce("root", "__qs_1")))
    kept = rooted.groupBy("root").agg(F.min(F.struct("first", "__qs_1")).alias("x")).select(F.col("x.first.doc_id").alias("__qs_d"), "x.__qs_1", F.col("x.first.__qs_2").alias("__qs_2"))
    # One row a kept text; rows that repeat it within a document id are folded.
    chosen = marked.join(kept, (marked["__qs_1"] == kept["__qs_1"]) & (marked["__qs_2"] == kept["__qs_2"]) & marked["doc_id"].eqNullSafe(kept["__qs_d"]), "left_semi")
    return chosen.dropDuplicates(["__qs_1", "__qs_2"]).select(*(F.col(f"`{c}`") for c in docs.columns))

"""Blocks of postings with their greatest impact, and an exact search that leaves out what cannot reach the best.

Documents are dealt to parts by a hash; a token's postings in a part are a block, which knows the greatest impact in it
(the part of a BM25 weight that is not idf: between 0 and 1). A task goes through its parts one after another and carries,
for each query, its best documents so far; the score of the last of them is the query's bar. In a part, the tokens that
could add least, together less than the bar by their blocks' bounds, are a query's rest: a document with none of the others
cannot be among the best. So the others' postings are added up, documents that could not pass the bar with the rest are
dropped, and the rest is looked up for what is left. A part whose bounds stay below the bar is not read at all.

What leaves a task are its best documents of each query. Terms of the queries go to every task; they are counted before.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstrata.functions.text import TOKEN

#: Documents of a part.
PART_DOCS = 1_024
#: Bytes of text that are counted at once, but for the last STEP documents of them, and tasks for few parts.
PIECE_BYTES, STEP, SLICES = 12_000_000, 32, 64
#: No part of a token at its word's ends: neither word characters nor a percent sign.
AROUND = "".join(c for c in string.punctuation if c not in "_%")
#: Scores are compared after rounding to DIGITS; what may be lifted by it stays.
DIGITS = 6
SLACK = 4e-6


def pieces(texts: DataFrame, parts: int, slices: int = 1) -> DataFrame:
    """token, part, docs, tfs, dls (arrays, by doc_id) of doc_id, text (token_text()); and of each part a row without token, of all its documents.

    Documents are dealt to parts and slices by hashes. What meets in one slice of a part is counted in one call, where the
    documents are; beyond PIECE_BYTES it is cut. Slices and cuts have numbers of their own: pmod(part, parts) is what they
    are of. Postings are not shuffled. dl is null where the text is.
    """
    part = F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")
    cell = part if slices == 1 else part + parts * F.pmod(F.xxhash64("doc_id", F.lit("slice")), F.lit(slices)).cast("int")
    dealt = texts.select(cell.alias("part"), "doc_id", "text").repartition("part").sortWithinPartitions("part")
    step = parts * slices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, cuts, size = [], None, 0, 0
        for b in batches:
            at = b.column("part").to_numpy()
            rows = pa.table([b.column("doc_id"), b.column("text")], ["doc_id", "text"])
            ends = np.flatnonzero(np.diff(at, append=-1)) + 1
            for first, end in zip(np.append(0, ends[:-1]), ends, strict=True):
                if at[first] != now:
                    if held:
                        yield _piece(held, now + step * cuts)
                    held, now, cuts, size = [], int(at[first]), 0, 0
                for i in range(first, end, STEP):
                    if size > PIECE_BYTES:
                        yield _piece(held, now + step * cuts)
                        held, cuts, size = [], cuts + 1, 0
                    held.append(rows.slice(i, min(STEP, end - i)))
                    size += pc.sum(pc.binary_length(held[-1].column("text")), min_count=0).as_py()
        if held:
            yield _piece(held, now + step * cuts)

    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("token", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("docs", T.ArrayType(texts.schema["doc_id"].dataType)), T.StructField("tfs", longs), T.StructField("dls", longs)])
    return dealt.mapInArrow(run, schema)


def _piece(held: list[pa.Table], part: int) -> pa.RecordBatch:
    rows = pa.concat_tables(held).sort_by("doc_id")
    docs, text = (rows.column(c).combine_chunks() for c in ("doc_id", "text"))
    n = len(docs)
    # No token crosses a blank, so each different word is searched once; most are tokens as they are, but for what is around them.
    lists = pc.ascii_split_whitespace(text)
    words = lists.flatten().dictionary_encode()
    bare = pc.ascii_trim(words.dictionary, AROUND)
    whole = pc.match_substring_regex(bare, r"\A[a-z0-9]+\z")
    find = re.compile(TOKEN, re.ASCII).findall
    found = [find(w) for w in bare.filter(pc.invert(whole)).to_pylist()]
    tokens = pa.concat_arrays([bare.filter(whole), pa.array([t for ts in found for t in ts], pa.string())]).dictionary_encode()
    whole = whole.to_numpy(zero_copy_only=False)
    many, start = np.ones(len(whole), np.int64), np.zeros(len(whole), np.int64)
    many[~whole] = [len(ts) for ts in found]
    start[whole], start[~whole] = np.arange(whole.sum()), whole.sum() + np.cumsum(many[~whole]) - many[~whole]
    word = words.indices.to_numpy()
    each = many[word]
    row = np.repeat(np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)), each)
    at = np.arange(len(row)) + np.repeat(start[word] - (np.cumsum(each) - each), each)
    code, tf = np.unique(tokens.indices.to_numpy().astype(np.int64)[at] * n + row, return_counts=True)
    dl = pc.if_else(text.is_null(), pa.scalar(None, pa.int64()), pa.array(np.bincount(row, minlength=n).astype(np.int64)))
    own, place = code // n, pa.array(code % n)
    # The last list is that of all documents, beside the null token.
    ends = pa.array(np.append(np.searchsorted(own, np.arange(len(tokens.dictionary) + 1)), len(code) + n), pa.int32())
    pairs = (docs.take(place), docs), (pa.array(tf, pa.int64()), pa.nulls(n, pa.int64())), (dl.take(place), dl)
    names = pa.concat_arrays([tokens.dictionary, pa.nulls(1, pa.string())])
    arrays = [names, pa.array(np.full(len(names), part), pa.int32()), *(pa.ListArray.from_arrays(ends, pa.concat_arrays(p)) for p in pairs)]
    return pa.RecordBatch.from_arrays(arrays, ["token", "part", "docs", "tfs", "dls"])


def blocks(texts: DataFrame, impact: Callable[[Column, Column], Column], parts: int) -> DataFrame:
    """token, part, top, docs, tfs, dls, impacts (arrays, by doc_id) of doc_id, text (token_text()): a token's postings in a part are one block.

    impact: of tf and dl.
    """
    own = pieces(texts, parts, max(1, SLICES // parts)).where("token is not null")
    rows = own.select("token", F.pmod("part", F.lit(parts)).alias("part"), F.arrays_zip("docs", "tfs", "dls").alias("x"))
    made = rows.groupBy("token", "part").agg(F.sort_array(F.flatten(F.collect_list("x"))).alias("x"))
    lists = made.select("token", "part", F.col("x.docs").alias("docs"), F.col("x.tfs").alias("tfs"), F.col("x.dls").alias("dls"))
    each = F.zip_with("tfs", "dls", impact)
    return lists.select("token", "part", F.array_max(each).alias("top"), "docs", "tfs", "dls", each.alias("impacts"))


def flat(found: DataFrame) -> DataFrame:
    """token, doc_id, tf, dl of blocks."""
    return found.select("token", F.explode(F.arrays_zip(F.col("docs").alias("doc_id"), F.col("tfs").alias("tf"), F.col("dls").alias("dl"))).alias("x")).select("token", "x.*")


class Part:
    """One part's blocks: docs (sorted ids), and of each token the places of its documents, their impacts and the greatest."""

    def __init__(self, rows: list[tuple[str, np.ndarray, np.ndarray, float]]):
        self.docs, every = np.unique(np.concatenate([docs for _, docs, _, _ in rows]), return_inverse=True)
        places = np.split(every, np.cumsum([len(docs) for _, docs, _, _ in rows])[:-1])
        self.of = {token: (at, impacts, top) for at, (token, _, impacts, top) in zip(places, rows, strict=True)}

    def above(self, terms: list[tuple[str, float]], bar: float) -> tuple[np.ndarray, np.ndarray, int]:
        """(places, scores, postings added up) of the documents whose score, rounded, may be bar or more and is not zero.

        terms: token, weight.
        """
        own = sorted(((w * self.of[t][2], w, t) for t, w in terms if t in self.of), reverse=True)
        caps = np.array([c for c, _, _ in own])
        # below[i]: what the i-th and all weaker tokens could add.
        below = np.append(np.cumsum(caps[::-1])[::-1], 0.0)
        if not own or below[0] + SLACK < bar:
            return np.zeros(0, np.int64), np.zeros(0), 0
        first = int(np.argmax(below + SLACK < bar)) if (below + SLACK < bar).any() else len(own)
        total, read = np.zeros(len(self.docs)), 0
        for _, w, t in own[:first]:
            at, impacts, _ = self.of[t]
            total[at] += w * impacts
            read += len(at)
        places = np.flatnonzero(total + below[first] + SLACK >= bar) if bar > 0 else np.flatnonzero(total > 0)
        scores = total[places]
        for i, (_, w, t) in enumerate(own[first:], first):
            if not len(places):
                break
            at, impacts, _ = self.of[t]
            k = np.minimum(np.searchsorted(at, places), len(at) - 1)
            scores += np.where(at[k] == places, w * impacts[k], 0.0)
            keep = scores + below[i + 1] + SLACK >= bar
            places, scores = places[keep], scores[keep]
        return places, scores, read


def best_by_task(found: DataFrame, queries: pa.Array, terms: list[list[tuple[str, float]]], limit: int, id_type: T.DataType, impact: Callable[[np.ndarray, np.ndarray], np.ndarray], read: bool = False) -> DataFrame:
    """query_id, doc_id, score (rounded): each task's best limit of each query; found: the blocks of the queries' tokens.

    terms: of each query, its tokens with their weights. impact: of tf and dl, the part of a weight that is not idf. read: instead, query_id, postings, read: how many there are in the
    blocks, and how many were added up.
    """
    sent = found.sparkSession.sparkContext.broadcast((queries, terms))
    name = "postings long, read long" if read else "score double"
    arrow = [("query_id", queries.type), *([("postings", pa.int64()), ("read", pa.int64())] if read else [("doc_id", None), ("score", pa.float64())])]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[Part]:
        now, rows = None, []
        for b in batches:
            part, token = (b.column(c).to_pylist() for c in ("part", "token"))
            ends = np.append(0, np.cumsum(pc.list_value_length(b.column("docs")).to_numpy()))
            docs, tfs, dls = (b.column(c).flatten() for c in ("docs", "tfs", "dls"))
            ids = docs.to_numpy(zero_copy_only=False) if pa.types.is_integer(docs.type) else np.array(docs.to_pylist())
            impacts = impact(tfs.to_numpy(), dls.to_numpy())
            tops = np.maximum.reduceat(impacts, ends[:-1]).tolist()
            for i in range(b.num_rows):
                if part[i] != now:
                    if rows:
                        yield Part(rows)
                    now, rows = part[i], []
                at = slice(ends[i], ends[i + 1])
                rows.append((token[i], ids[at], impacts[at], tops[i]))
        if rows:
            yield Part(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked = sent.value
        bar = np.zeros(len(names))
        best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(names)
        there, added = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        for part in parts(batches):
            for q, own in enumerate(asked):
                places, scores, n = part.above(own, bar[q])
                there[q] += sum(len(part.of[t][0]) for t, _ in own if t in part.of) if read else 0
                added[q] += n
                scores = np.round(scores, DIGITS)
                keep = scores > 0
                if not keep.any():
                    continue
                ids, scores = part.docs[places[keep]], scores[keep]
                if best[q] is not None:
                    ids, scores = np.concatenate([best[q][0], ids]), np.concatenate([best[q][1], scores])
                order = np.lexsort((ids, -scores))[:limit]
                best[q] = (ids[order], scores[order])
                if len(order) == limit:
                    bar[q] = scores[order[-1]]
        if read:
            yield pa.RecordBatch.from_arrays([names, pa.array(there), pa.array(added)], [c for c, _ in arrow])
            return
        rows = [(q, *b) for q, b in enumerate(best) if b is not None]
        if rows:
            at = np.repeat([q for q, _, _ in rows], [len(s) for _, _, s in rows])
            yield pa.RecordBatch.from_arrays([names.take(pa.array(at)), pa.array(np.concatenate([i for _, i, _ in rows])), pa.array(np.concatenate([s for _, _, s in rows]))], [c for c, _ in arrow])

    query_type = T.StructField("query_id", _spark_type(queries.type))
    rest = T.StructType.fromDDL(name).fields
    schema = T.StructType([query_type, *rest] if read else [query_type, T.StructField("doc_id", id_type), *rest])
    dealt = found.select("part", "token", "docs", "tfs", "dls").repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(run, schema)


def _spark_type(kind: pa.DataType) -> T.DataType:
    from pyspark.sql.pandas.types import from_arrow_type

    return from_arrow_type(kind)

"""Substring dedup: Rabin-Karp hashes of every window of a fixed number of words, counted over the whole corpus.

Words covered by a window that starts anywhere else too, in the same document included, are removed, first copies
included. Windows travel grouped, as super-windows: consecutive windows that share a minimizer (the least hash among the
subwindows of SUB words that they hold). Equal windows share it, so counting within a minimizer sees every copy, and a
row carries a dozen windows instead of one. Equal super-windows of a batch become one row with a count before the
shuffle, so a passage that a third of the corpus holds reaches a reducer as one row a batch.

A window's identity is its minimizer's 64 bits and 48 bits of its own Rabin-Karp hash. Texts are told apart by a 64-bit
hash and their number of words.

Null text has no words. Texts shorter than a window keep all. Repeated rows are copies of each other and lose every
covered word. Each input row gives one output row; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstrata.llm.common import text_or_empty, with_fields

WINDOW = 35
SUB = 12
#: Bytes of a window's own hash that travel.
KEPT_BYTES = 6
#: Entries of a worker's table of word hashes.
WORD_TABLE = 500_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_ONE = np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_TABLE:
            self.clear()
        x = self[word] = xxhash.xxh64_intdigest(word, 7)
        return x


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def rolling(prefix: np.ndarray, inverse: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hash, modulo 2^64, of every window of size words; prefix: sums of hash * base^place."""
    return _mixed((prefix[size:] - prefix[:-size]) * inverse[: len(prefix) - size])


def _minimum(x: np.ndarray, span: int) -> np.ndarray:
    """Least of every span values, by doubling."""
    have = 1
    while have < span:
        step = min(have, span - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def super_windows(hashes: np.ndarray, window: int = WINDOW, sub: int = SUB) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window of each super-window, its minimizer, all windows' hashes)."""
    n = len(hashes)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * _powers(_BASE, n), out=prefix[1:])
    inverse = _powers(_INVERSE, n)
    own = rolling(prefix, inverse, window)
    least = _minimum(rolling(prefix, inverse, sub), window - sub + 1)
    starts = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    # A minimizer may stay for long (a repeated word): cut such runs at fixed lengths.
    limit = window - sub + 1
    lengths = np.diff(np.append(starts, len(least)))
    if (lengths > limit).any():
        starts = np.concatenate([np.arange(a, a + k, limit) for a, k in zip(starts.tolist(), lengths.tolist(), strict=True)])
    return starts, least[starts], own


def _content(minimizer: int, body: bytes) -> int:
    return xxhash.xxh3_64_intdigest(body, minimizer & 0xFFFFFFFFFFFFFFFF)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _each(texts: list[str], window: int, sub: int):
    """(words' number, [(minimizer, body, first window)]) of each text."""
    table = _WordHashes()
    for text in texts:
        words = text.encode().split()
        n = len(words)
        if n < window:
            yield n, ()
            continue
        starts, least, own = super_windows(np.fromiter(map(table.__getitem__, words), np.uint64, n), window, sub)
        body = own.view(np.uint8).reshape(-1, 8)[:, :KEPT_BYTES].tobytes()
        at = starts.tolist()
        ends = [*at[1:], len(own)]
        yield n, [(m, body[a * KEPT_BYTES : e * KEPT_BYTES], a) for m, a, e in zip(least.tolist(), at, ends, strict=True)]


def _contents(texts: DataFrame, window: int, sub: int) -> DataFrame:
    """minimizer, body, n: super-windows with how often each occurs in a batch of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[tuple[int, bytes], int] = {}
            for _, rows in _each(b.column("text").to_pylist(), window, sub):
                for m, body, _ in rows:
                    seen[m, body] = seen.get((m, body), 0) + 1
            if seen:
                keys = np.fromiter((m for m, _ in seen), np.uint64, len(seen)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([x for _, x in seen], pa.binary()), pa.array(seen.values(), pa.int32())], ["minimizer", "body", "n"])

    return texts.select("text").mapInArrow(run, "minimizer long, body binary, n int")


def _repeated(contents: DataFrame) -> DataFrame:
    """content, flags: super-windows that hold repeated windows; bit i of flags: window i is repeated.

    A partition's rows are read in the order of minimizers, so that memory holds one minimizer's rows at a time.
    """

    def flags(minimizer: int, group: dict[bytes, int]) -> Iterator[tuple[int, int]]:
        if len(group) == 1:
            (body, n), = group.items()
            k = len(body) // KEPT_BYTES
            if n > 1:
                yield _content(minimizer, body), (1 << k) - 1
            elif len({body[i : i + KEPT_BYTES] for i in range(0, len(body), KEPT_BYTES)}) == k:
                return
        cut: dict[bytes, list[bytes]] = {body: [body[i : i + KEPT_BYTES] for i in range(0, len(body), KEPT_BYTES)] for body in group}
        count: dict[bytes, int] = {}
        for body, n in group.items():
            for w in cut[body]:
                count[w] = count.get(w, 0) + n
        for body, ws in cut.items():
            if bits := sum(1 << i for i, w in enumerate(ws) if count[w] > 1):
                yield _content(minimizer, body), bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, {}
        for b in batches:
            out: list[tuple[int, int]] = []
            for m, body, n in zip(*(b.column(c).to_pylist() for c in ("minimizer", "body", "n")), strict=True):
                if m != now:
                    if group:
                        out += flags(now, group)
                    now, group = m, {}
                group[body] = group.get(body, 0) + n
            yield _flag_batch(out)
        if group:
            yield _flag_batch(list(flags(now, group)))

    return contents.repartition("minimizer").sortWithinPartitions("minimizer").mapInArrow(run, "content long, flags int")


def _flag_batch(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([_signed(x) for x, _ in rows], pa.int64()), pa.array([y for _, y in rows], pa.int32())], ["content", "flags"])


def _occurrences(texts: DataFrame, window: int, sub: int) -> DataFrame:
    """content, key, n_words, first: where super-windows begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            content, key, size, first = [], [], [], []
            done = set()
            for k, (n, rows) in zip(b.column("key").to_pylist(), _each(b.column("text").to_pylist(), window, sub), strict=True):
                if (k, n) in done:  # a copy in the same batch
                    continue
                done.add((k, n))
                content += [_content(m, body) for m, body, _ in rows]
                first += [a for _, _, a in rows]
                key += [k] * len(rows)
                size += [n] * len(rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(content, np.uint64).view(np.int64)), pa.array(key, pa.int64()), pa.array(size, pa.int32()), pa.array(first, pa.int32())], ["content", "key", "n_words", "first"])

    return texts.select("key", "text").mapInArrow(run, "content long, key long, n_words int, first int")


def repeated_windows(docs: DataFrame, text_col: str = "text", window: int = WINDOW, sub: int = SUB) -> DataFrame:
    """key, n_words, runs (array of struct first, flags) of each distinct text with repeated windows."""
    texts = docs.select(F.xxhash64(text_or_empty(text_col)).alias("key"), text_or_empty(text_col).alias("text"))
    flagged = _repeated(_contents(texts, window, sub))
    found = _occurrences(texts, window, sub).join(flagged, "content")
    # Copies of a text in several batches give equal rows.
    once = found.groupBy("key", "n_words", "first").agg(F.bit_or("flags").alias("flags"))
    return once.groupBy("key", "n_words").agg(F.collect_list(F.struct("first", "flags")).alias("runs"))


def remove_repeated(docs: DataFrame, text_col: str = "text", window: int = WINDOW, sub: int = SUB) -> DataFrame:
    """docs with its columns and n_words, n_removed, kept_text (kept words joined by one space)."""
    if not sub <= window <= sub + 23:
        raise ValueError("a window may hold at most 24 subwindows")
    runs = repeated_windows(docs, text_col, window, sub).select(F.col("key").alias("__qs_key"), F.col("n_words").alias("__qs_n"), F.col("runs").alias("__qs_runs"))
    text = text_or_empty(text_col)
    left = docs.withColumn("__qs_key", F.xxhash64(text)).withColumn("__qs_n", F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")))
    joined = left.join(runs, ["__qs_key", "__qs_n"], "left")
    others = [c for c in joined.columns if c not in ("__qs_key", "__qs_n", "__qs_runs", "n_words", "n_removed", "kept_text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, removed, kept = [], [], []
            for t, rows in zip(b.column(text_col).to_pylist(), b.column("__qs_runs").to_pylist(), strict=True):
                words = (t or "").encode().split()
                total.append(len(words))
                if rows:
                    edge = np.zeros(len(words) + 1, np.int32)
                    for r in rows:
                        bits, at = r["flags"], r["first"]
                        while bits:
                            if bits & 1:
                                edge[at] += 1
                                edge[at + window] -= 1
                            bits >>= 1
                            at += 1
                    gone = np.cumsum(edge[:-1]) > 0
                    removed.append(int(gone.sum()))
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                else:
                    removed.append(0)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], [*others, "n_words", "n_removed", "kept_text"])

    schema = with_fields([joined.schema[c] for c in others], "n_words long, n_removed long, kept_text string")
    return joined.select(*others, "__qs_runs").mapInArrow(run, schema)


def window_digests(docs: DataFrame) -> DataFrame:
    out = remove_repeated(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))

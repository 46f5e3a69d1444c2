"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Each pre-token is a row of symbols. A segment tree holds, for every adjacent pair, its merge rank and place; the root is
the leftmost pair of lowest rank. A merge changes at most three leaves, each renewed in logarithmic time, until no pair
can be merged. Words repeat, so each worker keeps a bounded table of words already encoded.

Null text counts as empty: no tokens, the digest of the empty string. Rows are independent, so repeated rows, ties and
extra columns change nothing; an empty table gives an empty result. Very long texts are read word by word; a single very
long word costs O(n log n).
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillstrata.llm.common import SLICE_BYTES, kept_in_worker, lean, map_texts, text_or_empty, with_fields

#: Entries that a worker's table of encoded words may hold.
WORD_TABLE = 240_000


def merge_symbols(symbols: list[int], merges: dict[int, int]) -> list[int]:
    """Merge ids until no adjacent pair is in merges, which gives rank << 16 | merged id for left << 16 | right.

    Leaf i of the tree is rank << shift | i of the pair at i, so the root is the leftmost pair of lowest rank.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    find, shift, none = merges.get, n.bit_length(), 1 << 62
    base = 1 << (n - 2).bit_length()
    tree = [none] * (2 * base)
    some = False
    for i in range(n - 1):
        hit = find(symbols[i] << 16 | symbols[i + 1])
        if hit is not None:
            tree[base + i] = hit >> 16 << shift | i
            some = True
    if not some:
        return symbols
    for i in range(base - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    mask = (1 << shift) - 1
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(place: int, key: int) -> None:
        i = place + base
        if tree[i] == key:
            return
        tree[i] = key
        while i > 1:
            other = tree[i ^ 1]
            i >>= 1
            low = key if key < other else other
            if tree[i] == low:
                return
            tree[i] = key = low

    while (low := tree[1]) != none:
        i = low & mask
        j = after[i]
        new = symbols[i] = find(symbols[i] << 16 | symbols[j]) & 0xFFFF
        symbols[j] = -1
        k = after[i] = after[j]
        if j < n - 1:
            put(j, none)
        if k < n:
            before[k] = i
            hit = find(new << 16 | symbols[k])
            put(i, none if hit is None else hit >> 16 << shift | i)
        else:
            put(i, none)
        if (h := before[i]) >= 0:
            hit = find(symbols[h] << 16 | new)
            put(h, none if hit is None else hit >> 16 << shift | h)
    return [x for x in symbols if x >= 0]


# Characters whose classes every Unicode version shares: for these the split is done here, for others by the library.
_PLAIN = re.compile("[\x00-\u024f\u2010-\u2027]*")
_plain = [chr(i) for i in range(0x250)]
_SPACE = "\t-\r \x85\xa0"
_LETTER = "".join(c for c in _plain if unicodedata.category(c)[0] == "L")
_NUMBER = "".join(c for c in _plain if unicodedata.category(c)[0] == "N")
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (x for x in range(256) if x not in shown)
    hidden = {x: chr(0x100 + i) for i, x in enumerate(rest)}
    return [hidden.get(x, chr(x)) for x in range(256)]


class BpeCodec:
    """Encoder and decoder of a tokenizers file whose model is BPE with word ends and byte-level symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        whole, model = Tokenizer.from_file(path), spec["model"]
        self._normalize, self._split = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        vocab, tail = model["vocab"], model.get("end_of_word_suffix") or ""
        if max(vocab.values()) > 0xFFFF:
            raise ValueError("ids must fit 16 bits")
        self.symbol = {c: vocab[c] for c in byte_symbols()}
        self.last = {c: vocab[c + tail] for c in byte_symbols()}
        self._byte, self._last_byte = [self.symbol[c] for c in byte_symbols()], [self.last[c] for c in byte_symbols()]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a] << 16 | vocab[b]] = rank << 16 | vocab[a + b]
        self.token = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        # Tokens by their ids, for whole rows of ids.
        self._row = np.array([self.token.get(i) for i in range(max(self.token) + 1)], object)
        self._whole = len(self.token) == len(self._row)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # Two generations: what was used lately survives when the younger one is full.
        self._known: dict[str, tuple[int, str, str]] = {}
        self._older: dict[str, tuple[int, str, str]] = {}

    def _hit(self, piece: str, row: list[int]) -> tuple[int, str, str]:
        ids = merge_symbols(row, self.merges)
        hit = (len(ids), " ".join(map(str, ids)), self.decode(ids))
        return self._keep(piece, hit)

    def _keep(self, piece: str, hit: tuple[int, str, str]) -> tuple[int, str, str]:
        if len(piece) <= 48:
            if len(self._known) >= WORD_TABLE // 2:
                self._known, self._older = {}, self._known
            self._known[piece] = hit
        return hit

    def _new(self, piece: str) -> tuple[int, str, str]:
        if piece in self._older:
            return self._keep(piece, self._older[piece])
        raw = piece.encode()
        row = [self._byte[x] for x in raw]
        row[-1] = self._last_byte[raw[-1]]
        return self._hit(piece, row)

    def _chunks(self, text: str) -> Iterator[tuple[int, str, str]]:
        for i, part in enumerate(self._cut.split(text) if self._cut and "<|" in text else (text,)):
            if i % 2:
                yield 1, str(self.special[part]), part
            elif part and _PLAIN.fullmatch(low := part.lower()) and unicodedata.is_normalized("NFC", part):
                # Judged in lower case: some capitals below U+0250 have small letters beyond it.
                known, new = self._known.get, self._new
                for piece in _PIECES.findall(low):
                    yield known(piece) or new(piece)
            elif part:
                for chunk in self._normalize(part).split(" "):
                    for piece, _ in self._split(chunk) if chunk else ():
                        # The library's pieces are rows of byte symbols; a blank, which no piece holds, keeps them apart from plain ones.
                        yield self._known.get(" " + piece) or self._hit(" " + piece, [*(self.symbol[c] for c in piece[:-1]), self.last[piece[-1]]])

    def encode_row(self, text: str) -> np.ndarray:
        return np.fromstring(" ".join([ids for _, ids, _ in self._chunks(text)]), np.int32, sep=" ")

    def encode(self, text: str) -> list[int]:
        return self.encode_row(text).tolist()

    def decode(self, ids: list[int]) -> str:
        """The file has no decoder, so tokens are joined by spaces."""
        return " ".join(self.token[i] for i in ids if i in self.token)

    def decode_row(self, ids: np.ndarray) -> str:
        known = ids[(ids >= 0) & (ids < len(self._row))]
        found = self._row[known].tolist()
        return " ".join(found) if self._whole else " ".join(x for x in found if x is not None)

    def digest(self, text: str) -> tuple[int, str, str]:
        rows = list(self._chunks(text))
        sha = lambda i: hashlib.sha256(" ".join([r[i] for r in rows]).encode()).hexdigest()
        return sum([r[0] for r in rows]), sha(1), sha(2)


def codec(path: str) -> BpeCodec:
    """One codec a worker process, as long as it runs tasks of this operator."""
    return kept_in_worker(f"bpe {path}", lambda: BpeCodec(path))


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids (array of int). path must be readable on every executor."""

    def make():
        encode = codec(path).encode_row

        def run(texts):
            ids = [encode(t) for t in texts]
            return [len(x) for x in ids], ids

        return run

    return map_texts(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")), make, {"n_tokens": "long", "ids": "array<int>"}, keeps=True)


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """Per row of encoded (doc_id, ids, ...): its columns and decoded, the decoded text. Null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode, none = codec(path).decode_row, np.zeros(0, np.int32)
        for b in batches:
            step = max(1, b.num_rows * SLICE_BYTES // max(1, b.column("ids").nbytes))
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                rows = (x.values.to_numpy(zero_copy_only=False) if x.is_valid else none for x in part.column("ids"))
                said = pa.array([decode(x) for x in rows], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, said], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(lean(run, keeps=True), with_fields(encoded.schema.fields, "decoded string"))


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every row and keep digests: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def make():
        digest = codec(path).digest
        return lambda texts: zip(*map(digest, texts), strict=True)

    return map_texts(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")), make, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, keeps=True)

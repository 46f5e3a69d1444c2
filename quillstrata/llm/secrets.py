"""Secret scans: fixed patterns, and a battery of randomness tests on other token-like strings.

A candidate is a longest run of at least MIN_LENGTH characters of the base64, base64url or hex alphabets that holds a
digit and is no plain number. Its encoding is the smallest alphabet that holds it. A run that fits none, with '+' or '/'
and '-' or '_', is split at either pair, and each part that is long enough is a candidate (so a key is found beside what
joins it to its surroundings). A discovery that lies within another one is not given out twice.

Four p-values say how well a candidate fits random symbols of its encoding: chi-squared uniformity over the symbols of the
alphabet and over its kinds of symbols (capitals, small letters, digits, others), runs above and below the middle of the
alphabet, and serial correlation of neighbours. Their logarithms are summed (Fisher's method); the sum is the score.

The null is ordinary text written as one word: identifiers, slugs, constants and the like. Its scores come from DECOYS
strings for each encoding and length class, made of words that follow the letter pairs of the whole corpus (outside of
candidates), joined in the ways of that encoding, with a number among them. A candidate's p-value is the share of decoys
of its class that score as high; beyond the highest TAIL of them the share falls off exponentially, which is cautious as
scores end at zero. Benjamini-Hochberg then runs over all candidates of the corpus, separately for each encoding and
length class, so that many short tokens don't loosen the bar for long ones, nor the reverse.

The fixed patterns always stay. Null text counts as empty. Repeated rows count as often as they occur. Without letters in
the corpus nothing is added. An empty table gives an empty result. Spans count code points, end exclusive.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstrata.llm.common import cut, map_texts, text_or_empty, with_fields

# The base patterns, the group whose length counts, and the least length.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)
#: Kinds in the order that breaks ties of a span's start.
KINDS = ("assign", "access", "hex", "random")

MIN_LENGTH = 20
FALSE_DISCOVERY_RATE = 0.01
#: Decoys for each encoding and length class, and the share of them from which on the tail is extrapolated.
DECOYS = 8_000
TAIL = 0.01
SEED = 9
#: Classes of the score: this many a unit, down to the first.
BINS_A_UNIT, FIRST_BIN = 8, -1_600
#: Length classes for each doubling of the length.
CLASSES_AN_OCTAVE, LAST_CLASS = 4, 24

_CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_LENGTH)
#: Parts of a run that fits no alphabet: those in the base64 and those in the base64url alphabet.
_PARTS = (re.compile(r"[A-Za-z0-9+/]+={0,2}"), re.compile(r"[A-Za-z0-9_-]+={0,2}"))
_LONG_HEX = re.compile(r"[0-9a-f]{32,}")
# Alphabets from the smallest to the largest.
ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
_PLACES = {name: {c: i for i, c in enumerate(letters)} for name, letters in ALPHABETS}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place, end) of the fixed patterns, in order."""
    found = []
    for order, (_, pattern, group, least) in enumerate(BASE):
        # A pattern with a minimum finds the same spans as matching first and dropping short ones, where a match is a longest run.
        for m in (_LONG_HEX if order == 2 else pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), order, m.end()))
    return sorted(found)


def said(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def infer_encoding(token: str) -> str | None:
    body = token.rstrip("=")
    return next((name for name, _ in ALPHABETS if all(c in _PLACES[name] for c in body)), None)


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, token) of a text's candidates; those of a split run may overlap."""
    found = []
    for m in _CANDIDATE.finditer(text):
        token, at = m.group(), m.start()
        parts = [(0, token)]
        if infer_encoding(token) is None:
            parts = sorted({(p.start(), p.group()) for apart in _PARTS for p in apart.finditer(token)})
        found += [(at + i, at + i + len(x), x) for i, x in parts if len(x.rstrip("=")) >= MIN_LENGTH and any(c.isdigit() for c in x) and not x.isdigit()]
    return found


def outermost(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans, without those that lie within another one."""
    out: list[tuple[int, int]] = []
    for a, e in sorted(spans, key=lambda x: (x[0], -x[1])):
        if not out or e > out[-1][1]:
            out.append((a, e))
    return out


_KIND = np.array([0 if 65 <= c <= 90 else 1 if 97 <= c <= 122 else 2 if 48 <= c <= 57 else 3 for c in range(128)])


def _upper_tail(z: np.ndarray) -> np.ndarray:
    """Of the normal distribution: for large z by its bound, which is close there."""
    z = np.asarray(z, np.float64)
    t = 1 / (1 + 0.2316419 * np.abs(z))
    # Abramowitz and Stegun 26.2.17.
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    low = np.exp(-0.5 * np.square(z)) / math.sqrt(2 * math.pi) * poly
    return np.clip(np.where(z >= 0, low, 1 - low), 1e-300, 1.0)


def _chi_tail(x: np.ndarray, df: int) -> np.ndarray:
    """Upper tail of chi-squared, by Wilson and Hilferty."""
    return _upper_tail((np.cbrt(np.maximum(x, 0) / df) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))


def scores(rows: np.ndarray, encoding: str) -> np.ndarray:
    """The score of each row of ASCII codes (tokens of one length, without padding): the sum of the tests' ln p."""
    letters = dict(ALPHABETS)[encoding]
    m, n = rows.shape
    k = len(letters)
    table = np.full(128, -1)
    table[[ord(c) for c in letters]] = np.arange(k)
    x = table[rows]
    counts = np.zeros((m, k))
    np.add.at(counts, (np.arange(m)[:, None], x), 1)
    p_symbols = _chi_tail(k / n * np.square(counts).sum(axis=1) - n, k - 1)
    share = np.bincount(_KIND[[ord(c) for c in letters]], minlength=4) / k
    used = np.flatnonzero(share)
    seen = np.stack([(_KIND[rows] == c).sum(axis=1) for c in used], axis=1)
    p_kinds = _chi_tail((np.square(seen - n * share[used]) / (n * share[used])).sum(axis=1), len(used) - 1) if len(used) > 1 else np.ones(m)
    half = x * 2 >= k
    ups = half.sum(axis=1)
    runs = 1 + (half[:, 1:] != half[:, :-1]).sum(axis=1)
    expected = 1 + 2 * ups * (n - ups) / n
    spread = np.sqrt(np.maximum((expected - 1) * (expected - 2) / max(1, n - 1), 1e-9))
    p_runs = np.where((ups > 0) & (ups < n), np.minimum(1.0, 2 * _upper_tail(np.abs(runs - expected) / spread)), 2.0 ** np.maximum(1 - n, -900))
    gap = x - x.mean(axis=1, keepdims=True)
    around = np.square(gap).sum(axis=1)
    serial = np.where(around > 0, (gap[:, 1:] * gap[:, :-1]).sum(axis=1) / np.maximum(around, 1e-9), 1.0)
    p_serial = np.minimum(1.0, 2 * _upper_tail(np.abs(serial + 1 / n) * math.sqrt(n)))
    return sum(np.log(np.maximum(p, 1e-300)) for p in (p_symbols, p_kinds, p_runs, p_serial))


def score_bin(score: np.ndarray) -> np.ndarray:
    return np.maximum(np.floor(score * BINS_A_UNIT), FIRST_BIN).astype(np.int32)


def token_scores(tokens: list[str]) -> list[tuple[str, int]]:
    """(group, class of the score) of each token; group: encoding and length class, "" where no alphabet holds it."""
    out: list[tuple[str, int]] = [("", FIRST_BIN)] * len(tokens)
    alike: dict[tuple[str, int], list[int]] = {}
    for i, token in enumerate(tokens):
        encoding = infer_encoding(token)
        if encoding:
            alike.setdefault((encoding, len(token.rstrip("="))), []).append(i)
    for (encoding, n), places in alike.items():
        for at in range(0, len(places), 4_096):
            some = places[at : at + 4_096]
            rows = np.frombuffer("".join(tokens[i].rstrip("=") for i in some).encode(), np.uint8).reshape(len(some), n)
            for i, b in zip(some, score_bin(scores(rows, encoding)).tolist(), strict=True):
                out[i] = (f"{encoding}/{length_class(n)}", b)
    return out


def length_class(n: int) -> int:
    return min(LAST_CLASS, int(CLASSES_AN_OCTAVE * math.log2(n / MIN_LENGTH)))


def letter_pairs(text: str) -> np.ndarray:
    """27 x 27 counts, as one row, of neighbours among the letters a to z (either case) and anything else (26)."""
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    place = np.where((raw >= 97) & (raw <= 122), raw - 97, 26).astype(np.int64)
    place = np.concatenate([[26], place, [26]])
    return np.bincount(place[:-1] * 27 + place[1:], minlength=729)


def _words(pairs: np.ndarray, allowed: str, count: int, rng: np.random.Generator) -> list[str]:
    """Words that follow the letter pairs, of the allowed letters only."""
    table = pairs.reshape(27, 27).astype(np.float64).copy()
    table[26, 26] = 0
    table[:, [i for i in range(26) if chr(97 + i) not in allowed]] = 0
    table[:26, 26] += 1e-9  # every word ends
    total = table.sum(axis=1, keepdims=True)
    table = np.where(total > 0, table / np.maximum(total, 1e-300), np.eye(27)[26])
    below, state, rows = np.cumsum(table, axis=1), np.full(count, 26), []
    for _ in range(24):
        new = np.minimum((rng.random(count)[:, None] > below[state]).sum(axis=1), 26)
        state = np.where((state == 26) & bool(rows), 26, new)
        rows.append(state)
    return [w for w in ("".join(chr(97 + c) for c in row if c < 26) for row in np.stack(rows, axis=1).tolist()) if w]


# Ways in which text is written as one word, by encoding: form of a word and what joins words.
FORMS = {
    "hex": ((str.lower, ""),),
    "HEX": ((str.upper, ""),),
    "base32": ((str.upper, ""),),
    "base36": ((str.lower, ""),),
    "base64": ((str.capitalize, ""), (str.capitalize, ""), (str.lower, "/"), (str.capitalize, "/"), (str.upper, "/")),
    "base64url": ((str.lower, "-"), (str.lower, "_"), (str.capitalize, "-"), (str.upper, "_"), (str.capitalize, "_")),
}


def decoys(pairs: np.ndarray, encoding: str, lengths: Sequence[int], count: int = DECOYS) -> list[str]:
    """Ordinary text as single words of the encoding, with a number in each; none where the corpus has no letters of it."""
    rng = np.random.default_rng([SEED, [x for x, _ in ALPHABETS].index(encoding), min(lengths)])
    letters = dict(ALPHABETS)[encoding]
    words = _words(pairs, "".join(sorted({c.lower() for c in letters if c.isalpha()})), 4_000, rng)
    if not words:
        return []
    digits = [c for c in letters if c.isdigit()]
    out, size = [], np.array(lengths)[rng.integers(0, len(lengths), count)]
    form, where, long_ = rng.integers(0, 1 << 30, count), rng.random(count), rng.random(count)
    for i, n in enumerate(size.tolist()):
        make, join = FORMS[encoding][form[i] % len(FORMS[encoding])]
        number = "".join(rng.choice(digits, int(rng.integers(5, 9)) if long_[i] < 0.15 else int(rng.integers(1, 5))))
        parts: list[str] = []
        room = n - len(number)
        while room > 0:
            parts.append(make(words[int(rng.integers(0, len(words)))]))
            room -= len(parts[-1]) + len(join)
        at = len(parts) if where[i] < 0.6 else int(where[i] * 1e6) % (len(parts) + 1)
        parts.insert(at, number)
        # Cut to length so that the number stays.
        word = join.join(parts)
        out.append(word[:n] if at < len(parts) - 1 and any(c.isdigit() for c in word[:n]) else word[len(word) - n :])
    return out


def null_tail(pairs: np.ndarray, group: str) -> Callable[[int], float] | None:
    """p-value by class of the score, of a group; None without decoys."""
    encoding, at = group.split("/")
    low, high = (math.ceil(MIN_LENGTH * 2 ** (int(c) / CLASSES_AN_OCTAVE) - 1e-9) for c in (at, int(at) + 1))
    made: dict[int, list[str]] = {}
    for token in decoys(pairs, encoding, range(low, max(high, low + 1))):
        made.setdefault(len(token), []).append(token)
    if not made:
        return None
    rows = [scores(np.frombuffer("".join(x).encode(), np.uint8).reshape(len(x), n), encoding) for n, x in made.items()]
    found = np.sort(np.concatenate(rows))
    edge = found[int(len(found) * (1 - TAIL))]
    fall = max(float((found[found >= edge] - edge).mean()), 1 / BINS_A_UNIT)

    def tail(bin_: int) -> float:
        score = bin_ / BINS_A_UNIT
        share = (len(found) - np.searchsorted(found, score) + 1) / (len(found) + 1)
        return float(min(share, 1.0)) if score <= edge else TAIL * math.exp(-(score - edge) / fall)

    return tail


def _pass_one(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: the fixed spans, the candidates beside them with their scores; pairs: letter pairs of a batch, once a batch."""

    def make():
        def run(texts: list[str]):
            rows, tokens = [], []
            pairs = np.zeros(729, np.int64)
            for text in texts:
                base = base_spans(text)
                kinds = [k for _, k, _ in base]
                own = [x for x in candidates(text) if not any(a < x[1] and x[0] < b for a, _, b in base)]
                rest, done = [], 0
                for a, b in outermost([(a, b) for a, b, _ in own]):
                    rest.append(text[done:a])
                    done = b
                pairs += letter_pairs(" ".join([*rest, text[done:]]))
                rows.append([kinds.count(0), kinds.count(1), kinds.count(2), said(base), [a for a, _, _ in own], [b for _, b, _ in own]])
                tokens.append([t for _, _, t in own])
            scored = iter(token_scores([t for row in tokens for t in row]))
            for i, (row, own) in enumerate(zip(rows, tokens, strict=True)):
                found = [next(scored) for _ in own]
                row += [[g for g, _ in found], [b for _, b in found], None if i else pairs]
            return zip(*rows, strict=True)

        return run

    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return map_texts(rows, make, {"n_assign": "long", "n_access": "long", "n_hex": "long", "base": "string", "starts": "array<int>", "ends": "array<int>", "groups": "array<string>", "bins": "array<int>", "pairs": "array<long>"})


def discovery_bars(counts: list[tuple[str, int, int]], pairs: np.ndarray, rate: float) -> dict[str, int]:
    """Benjamini-Hochberg on classes of the score: per group the lowest class that is a discovery."""
    by: dict[str, dict[int, int]] = {}
    for group, b, n in counts:
        by.setdefault(group, {})[b] = n
    bars = {}
    for group, classes in by.items():
        tail = null_tail(pairs, group)
        total, seen = sum(classes.values()), 0
        for b in sorted(classes, reverse=True):
            seen += classes[b]
            if tail and b > FIRST_BIN and tail(b) * total <= rate * seen:
                bars[group] = b
    return bars


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = FALSE_DISCOVERY_RATE) -> DataFrame:
    """Per row of docs: doc_id, n_assign, n_access, n_hex, base (the fixed spans), spans (all spans).

    What comes to the driver is bounded: the counts of letter pairs, and a count for each encoding, length class and class
    of the score.
    """
    first = cut(_pass_one(docs, id_col, text_col))
    # The pairs of a batch are summed place by place.
    placed = first.where("pairs is not null").select(F.posexplode("pairs").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()
    pairs = np.zeros(729, np.int64)
    for r in placed:
        pairs[r["at"]] = r["n"]
    plain = first.drop("pairs")
    counts = plain.where(F.size("groups") > 0).select(F.explode(F.arrays_zip("groups", "bins")).alias("x")).groupBy("x.groups", "x.bins").count().collect()
    bars = discovery_bars(sorted(tuple(r) for r in counts if r[0]), pairs, rate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = []
            for base, starts, ends, groups, bins in zip(*(b.column(c).to_pylist() for c in ("base", "starts", "ends", "groups", "bins")), strict=True):
                new = [(a, 3, e) for a, e in outermost([(a, e) for a, e, g, x in zip(starts, ends, groups, bins, strict=True) if g in bars and x >= bars[g]])]
                old = [(int(x[1]), KINDS.index(x[0]), int(x[2])) for s in base.split(",") if s for x in [s.split(":")]]
                spans.append(said(sorted(old + new)) if new else base)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "n_assign", "n_access", "n_hex", "base")), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"])

    return plain.mapInArrow(run, with_fields([plain.schema[c] for c in ("doc_id", "n_assign", "n_access", "n_hex", "base")], "spans string"))


def secret_digests(docs: DataFrame) -> DataFrame:
    out = scan_secrets(docs)
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")

"""Quality classifier: a linear-chain conditional random field over a document's lines.

Each line gets a vector of shape statistics; its features are that vector, those of the lines before and after it and
whether it stands at an end. Two states, good and bad, follow each other with learnt transitions. A document's score is
the average of its lines' forward-backward probability of good, weighted by their characters: 0 to 1.

Only documents carry labels. In training a line takes its document's label, and the field is fitted by maximum conditional
likelihood (L-BFGS, numpy) on a bounded sample: of the labelled rows outside the held-out fifth the FIT_DOCS of the least hash
of their doc_id, and of each its first FIT_LINES lines. Statistics are made by Spark's tasks; only those rows' vectors reach
the driver. Classes weigh as they occur, so scores are shares of label 1. Scoring reads all lines of all texts.

lang, source, doc_id and labels are no input of a score. Lines are what stands between \\n; those without a word are left
out. Null and empty texts and texts without words have no line: they score the field's own probability of a single line
that is average in everything. Without rows to learn from (no labels, or labels of one kind) every score is the share of
label 1 among those rows, or 0.5. Repeated labels of one doc_id count once, their largest quality; null labels not at all.
Rows that repeat a doc_id are scored each. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstrata.llm.common import map_texts, text_or_empty

FOLDS = 5
BAR = 0.3
#: Bounds of the sample that the field is fitted on.
FIT_DOCS, FIT_LINES = 4_000, 60
#: Strength of the quadratic penalty and steps of the fit.
PENALTY, STEPS = 1e-3, 80

_WORDY = re.compile(rb"[^\x20\x09-\x0D]")
#: Classes of bytes that are counted in a line.
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "symbol": b"#*$%&|<>@^~=_+\\/{}[]", "mark": b"!?", "stop": b".,;:'\"()-", "wide": bytes(range(128, 256)), "blank": b" \t\r\x0b\x0c"}
_TABLE = np.zeros(256, np.uint8)
for _k, _name in enumerate(CLASSES, 1):
    _TABLE[list(CLASSES[_name])] = _k
NAMES = ["upper", "digit", "symbol", "mark", "stop", "wide", "mostly upper", "any symbol", "word length", "log words", "fresh words", "seen before", "as the last line", "short", "known words"]
WIDTH = len(NAMES)


# --- Lines ---------------------------------------------------------------------------------------------------------------


def line_statistics(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(one row of NAMES a line with a word, each line's characters)."""
    lines = [x for x in text.encode().split(b"\n") if _WORDY.search(x)]
    if not lines:
        return np.zeros((0, WIDTH), np.float32), np.zeros(0)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    kinds = _TABLE[np.frombuffer(b"".join(lines), np.uint8)]
    line = np.repeat(np.arange(len(lines)), sizes)
    count = np.bincount(line * 9 + kinds, minlength=len(lines) * 9).reshape(-1, 9).astype(np.float64)
    ink = np.maximum(1, sizes - count[:, 8])
    letters = np.maximum(1, count[:, 1] + count[:, 2])
    seen: set[bytes] = set()
    vocabulary: set[bytes] = set()
    words, fresh, again, adjacent, known = (np.zeros(len(lines)) for _ in range(5))
    last = None
    for i, x in enumerate(lines):
        row = x.split()
        bag = set(row)
        words[i], fresh[i], again[i], adjacent[i] = len(row), len(bag) / len(row), x in seen, x == last
        known[i] = len(bag & vocabulary) / len(bag)
        seen.add(x)
        vocabulary |= bag
        last = x
    out = np.stack([
        count[:, 1] / ink, count[:, 3] / ink, count[:, 4] / ink, count[:, 5] / ink, count[:, 6] / ink, count[:, 7] / ink,
        count[:, 1] > 0.5 * letters, count[:, 4] > 0, np.log(ink / words), np.log1p(words), fresh, again, adjacent, words < 4, known,
    ], axis=1)
    # Bytes of 128 and more are two a character in the scripts that most texts hold.
    return out.astype(np.float32), sizes - count[:, 7] / 2


def line_features(statistics: np.ndarray) -> np.ndarray:
    """A line's own standardised statistics, its neighbours', whether it is first or last, and a constant."""
    n = len(statistics)
    none = np.zeros((1, WIDTH), statistics.dtype)
    before, after = np.concatenate([none, statistics[:-1]]), np.concatenate([statistics[1:], none])
    ends = np.zeros((n, 3), statistics.dtype)
    ends[:1, 0], ends[-1:, 1], ends[:, 2] = 1, 1, 1
    return np.concatenate([statistics, before, after, ends], axis=1)


FEATURES = 3 * WIDTH + 3


# --- The field -----------------------------------------------------------------------------------------------------------


def _chains(lengths: np.ndarray) -> list[np.ndarray]:
    """For each place: the chains (longest first) that have a line there."""
    order = np.argsort(-lengths, kind="stable")
    sorted_ = -lengths[order]
    return [order[: np.searchsorted(sorted_, -t, "left")] for t in range(int(lengths.max(initial=0)))]


def forward_backward(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log norm of each chain, probability of good of each line, expected moves 2 x 2 of all chains).

    scores: log odds of good of each line by itself; moves: logs of how well a state follows another (bad 0, good 1).
    Chains lie one after another; a step takes all chains that are long enough at once.
    """
    n, at = len(lengths), _chains(lengths)
    local = np.stack([np.zeros(len(scores)), scores], axis=1)
    ahead, behind, norm = np.zeros((len(scores), 2)), np.zeros((len(scores), 2)), np.zeros(n)
    for t, chains in enumerate(at):
        rows = starts[chains] + t
        x = local[rows] if t == 0 else local[rows] + np.logaddexp(ahead[rows - 1][:, :1] + moves[0], ahead[rows - 1][:, 1:] + moves[1])
        ahead[rows] = x
        norm[chains] = np.logaddexp(x[:, 0], x[:, 1])
    pairs = np.zeros((2, 2))
    for t in range(len(at) - 2, -1, -1):
        chains = at[t + 1]
        rows = starts[chains] + t
        further = behind[rows + 1] + local[rows + 1]
        behind[rows] = np.logaddexp(moves[:, 0] + further[:, :1], moves[:, 1] + further[:, 1:])
        pairs += np.exp(ahead[rows][:, :, None] + moves + further[:, None, :] - norm[chains][:, None, None]).sum(axis=0)
    chain = np.repeat(np.arange(n), lengths)
    good = np.exp(ahead[:, 1] + behind[:, 1] - norm[chain]) if len(scores) else np.zeros(0)
    return norm, good, pairs


def _minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with a halving line search."""
    value, slope = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way, kept = -slope, []
        for s, y in reversed(past):
            a = s @ way / (s @ y)
            way = way - a * y
            kept.append(a)
        if past:
            s, y = past[-1]
            way = way * ((s @ y) / (y @ y))
        for (s, y), a in zip(past, reversed(kept), strict=True):
            way = way + s * (a - y @ way / (s @ y))
        step, fall = 1.0 if past else 1.0 / max(1.0, float(np.abs(slope).sum())), slope @ way
        while True:
            new, grown = f(x + step * way)
            if new <= value + 1e-4 * step * fall or step < 1e-10:
                break
            step /= 2
        s, y = step * way, grown - slope
        x, done, value, slope = x + s, abs(value - new) < 1e-7 * max(1.0, abs(value)), new, grown
        if s @ y > 1e-12:
            past = [*past, (s, y)][-memory:]
        if done:
            break
    return x


class Field:
    """mean, scale: of the statistics; weights: of the features; moves: of states that follow each other."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, moves: np.ndarray):
        self.mean, self.scale, self.weights, self.moves = mean, scale, weights, moves

    def scores(self, statistics: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(s) for s in statistics], np.int64)
        starts = np.cumsum(lengths) - lengths
        x = [line_features((s - self.mean) / self.scale) for s in statistics if len(s)]
        return (np.concatenate(x) @ self.weights if x else np.zeros(0)), starts, lengths

    def marginals(self, statistics: list[np.ndarray]) -> list[np.ndarray]:
        """Each document's lines' probabilities of good."""
        scores, starts, lengths = self.scores(statistics)
        good = forward_backward(scores, starts, lengths, self.moves)[1]
        return np.split(good, starts[1:]) if len(statistics) else []

    def documents(self, texts: list[str]) -> list[float]:
        rows = [line_statistics(t) for t in texts]
        empty = float(self.marginals([self.mean[None, :]])[0][0])
        return [float(np.clip(g @ w / w.sum(), 0, 1)) if len(g) else empty for g, (_, w) in zip(self.marginals([s for s, _ in rows]), rows, strict=True)]


def fit_field(statistics: list[np.ndarray], labels: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> Field:
    """The field of greatest likelihood of every line bearing its document's label; each document weighs the same."""
    every = np.concatenate(statistics).astype(np.float64)
    mean, scale = every.mean(axis=0), np.maximum(every.std(axis=0), 1e-3)
    lengths = np.array([len(s) for s in statistics], np.int64)
    starts = np.cumsum(lengths) - lengths
    x = np.concatenate([line_features((s - mean) / scale) for s in statistics])
    chain = np.repeat(np.arange(len(lengths)), lengths)
    y = labels[chain].astype(np.float64)
    # All lines of a document agree in training: its moves are from a state to itself.
    stays = np.array([(lengths - 1)[labels == k].sum() for k in (0, 1)], np.float64)
    lines = len(x)

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        weights, moves = p[:FEATURES], p[FEATURES:].reshape(2, 2)
        scores = x @ weights
        norm, good, pairs = forward_backward(scores, starts, lengths, moves)
        value = norm.sum() - y @ scores - stays @ np.diag(moves)
        slope = np.concatenate([x.T @ (good - y), (pairs - np.diag(stays)).ravel()])
        return value / lines + penalty * (p @ p) / 2, slope / lines + penalty * p

    p = _minimise(loss, np.zeros(FEATURES + 4), steps)
    return Field(mean, scale, p[:FEATURES], p[FEATURES:].reshape(2, 2))


# --- Spark ---------------------------------------------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def training_rows(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """text, label, place of labelled rows outside the held-out fifth: about fit_docs of them, by a hash of their doc_id."""
    known = labels.where("quality in (0, 1)").groupBy(F.col("doc_id").alias("__id")).agg(F.max("quality").alias("label"))
    rows = docs.select(F.col("doc_id").alias("__id"), "text").where(~held_out(F.col("__id"))).join(known, "__id")
    place = F.shiftrightunsigned(F.xxhash64("__id"), 1)
    n = rows.select("__id").count()
    share = min(1.0, 1.2 * fit_docs / max(1, n))  # a little more than needed; train() takes the exact number
    return rows.where(place <= min((1 << 63) - 1, int(share * (1 << 63)))).select(text_or_empty().alias("text"), "label", place.alias("place"))


def train(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> Field | float:
    """The field, or the share of label 1 where there is one kind of label only (0.5 without labels)."""

    def made(texts: list[str]) -> tuple[list[int], list[bytes]]:
        rows = [line_statistics(t)[0][:FIT_LINES] for t in texts]
        return [len(r) for r in rows], [r.tobytes() for r in rows]

    # At most fit_docs rows of FIT_LINES vectors.
    got = map_texts(training_rows(docs, labels, fit_docs), lambda: made, {"lines": "long", "statistics": "binary"}).orderBy("place", "statistics").limit(fit_docs).collect()
    kinds = {r.label for r in got}
    rows = [(np.frombuffer(r.statistics, np.float32).reshape(-1, WIDTH), r.label) for r in got if r.lines]
    if len({k for _, k in rows}) < 2:
        return float(kinds == {1}) if len(kinds) == 1 else 0.5
    return fit_field([s for s, _ in rows], np.array([k for _, k in rows]))


def quality_scores(docs: DataFrame, field: Field | float, bar: float = BAR) -> DataFrame:
    """docs without the text, with held_out, score and predicted; docs: doc_id, text and more."""
    scorer = (lambda texts: [field.documents(texts)]) if isinstance(field, Field) else lambda texts: [[field] * len(texts)]
    new = ("held_out", "score", "predicted")
    texts = docs.drop(*new).withColumn("text", text_or_empty())
    scored = map_texts(texts, lambda: scorer, {"score": "double"})
    return scored.select(*(c for c in scored.columns if c not in new), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= bar).cast("int").alias("predicted"))


def line_marginals(docs: DataFrame, field: Field) -> DataFrame:
    """docs without the text, with probabilities (array of double): of each line with a word, that it is good."""
    made = lambda texts: [[g.tolist() for g in field.marginals([line_statistics(t)[0] for t in texts])]]
    return map_texts(docs.drop("probabilities").withColumn("text", text_or_empty()), lambda: made, {"probabilities": "array<double>"})


def quality_predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return quality_scores(docs.select("doc_id", "text"), train(docs, labels)).select("doc_id", "held_out", "score", "predicted")

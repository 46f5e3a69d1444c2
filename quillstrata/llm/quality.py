"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates per language and source.

Five statistics of a text become a vector (see vector()). Per language and source, the estimate is the mean and covariance
of the CORE share of the vectors whose covariance has the least determinant, found by concentration steps from several
starts (as DetMCD, Hubert, Rousseeuw and Verdonck 2012): medians with quartile ranges, with the correlation of tanh
values, and with that of spatial signs. Each start takes FIRST_STEPS steps, the best of a group goes on until its determinant
falls no more. A step is one aggregate over all rows: squared Mahalanobis distances are binned, counts, vectors and
products are summed per group and bin, and the nearest bins make the core, the last of them by the share that is wanted.
So what is left of a group is at most LAST_BIN + 1 rows, and a hot group never meets in one task. A last step reweights:
all vectors within the USUAL share's distance make the final mean and covariance.

Distances of the verdict allow for FLOOR: differences so small are no fault, however even a group is. The bar follows the
fitted distances of a group: the floors shorten them, so the chi-squared bar is scaled by the group's median squared
distance over the chi-squared median, within LEAST_FAR and the unscaled bar. So each of the shares of repeated lines and
windows can reject by itself.

Documents that fail a base rule take no part in the estimates and are not kept. Groups with fewer than LEAST_GROUP rows
are pooled by language, then over all; a last pool of fewer than LEAST_POOL rows has no covariance, and the base rules
decide alone. Null text has no words and fails the base rule; null language or source is a group of its own. Repeated rows
count as often as they occur. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstrata.llm.common import cut, join_counted, map_texts, text_or_empty

LEAST_WORDS = 50
SYMBOLS = "#*$%&|<>"
DIMS = 5
PAIRS = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]
#: Share of a group that the estimates rest on.
CORE = 0.75
#: Chance that a vector of a normal group lies beyond the unscaled bar.
REJECTED = 1e-9
#: Squared distance in floors within which nothing is rejected: three of them.
LEAST_FAR = 9.0
#: Rows of a group: ten for each coordinate; of the last pool: more than twice the coordinates.
LEAST_GROUP, LEAST_POOL = 10 * DIMS, 2 * DIMS + 1
#: Concentration steps of each start, and of the best at most.
FIRST_STEPS, STEPS = 2, 12
#: Share of a normal group that the last step rests on.
USUAL = 0.975
#: Added to each variance, so that a constant coordinate has an inverse.
GUARD = 1e-6
#: Standard deviations added to each coordinate: smaller differences are never a fault by themselves.
FLOOR = (0.30, 0.10, 0.045, 0.20, 0.20)
#: Classes of distance: so many a unit of ln(1 + squared distance), up to the last.
BINS_A_UNIT, LAST_BIN = 24, 600
#: Grid on which starting quantiles are exact.
GRID = 0.01
_WHITE = " \t\n\x0b\x0c\r"


def text_statistics(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(map(text.count, _WHITE))
    symbols = sum(map(text.count, SYMBOLS))
    lines = text.split("\n")
    dup = 0
    if len(set(lines)) < len(lines):
        seen = set()
        for line in lines:
            if line in seen:
                dup += bool(line.strip(_WHITE))
            seen.add(line)
    return n, chars, symbols, dup, _repeated_words(words)


def _repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    row = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    k = len(ids)
    _, pairs = np.unique(row[:-1] * k + row[1:], return_inverse=True)
    _, place, count = np.unique(pairs[:-1] * k + row[2:], return_inverse=True, return_counts=True)
    again = count[place] > 1
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[i : i + n - 2] |= again
    return int(covered.sum())


STATS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long"}


def statistics(rows: DataFrame, text: str) -> DataFrame:
    """rows without the column text, and with the statistics and base_failed."""
    stats = map_texts(rows, lambda: lambda texts: zip(*map(text_statistics, texts), strict=True), STATS, text)
    return stats.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def vector() -> list[Column]:
    """Length, word length, and the shares of symbols, repeated lines and repeated windows, each on a stabilising scale."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log(n),
        F.log1p(F.col("word_chars") / n),
        F.sqrt(F.col("n_symbols") / (F.col("word_chars") + 1)),
        F.sqrt(F.least(F.lit(1.0), 20 * F.col("n_dup_lines") / n)),
        F.sqrt(F.col("n_repeat_words") / n),
    ]


def chi2_cdf(x: float, k: int) -> float:
    a, x = k / 2, x / 2
    term = total = 1 / a
    i = a
    while term > total * 1e-15:
        i += 1
        term *= x / i
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi2_bar(tail: float, k: int) -> float:
    low, high = 1e-9, 400.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - chi2_cdf(mid, k) > tail else (low, mid)
    return high


def _consistent(cov: np.ndarray, share: float) -> np.ndarray:
    """The covariance of a normal group whose nearest share has covariance cov."""
    return cov * (share / chi2_cdf(chi2_bar(1 - share, DIMS), DIMS + 2))


def _flat(g: str, start: int, mean: np.ndarray, cov: np.ndarray) -> dict:
    """A model: m, p (the precision's entries as PAIRS has them, those off the diagonal twice), det (its logarithm)."""
    whole = cov + np.diag(np.full(DIMS, GUARD))
    precision = np.linalg.inv(whole)
    return {"g": g, "start": start, "m": mean.tolist(), "p": [float(precision[i, j]) * (1 if i == j else 2) for i, j in PAIRS], "det": float(np.linalg.slogdet(whole)[1])}


_MODEL = "g string, start int, m array<double>, p array<double>, det double"


def _middle(table: pd.DataFrame) -> pd.DataFrame:
    """table: g, dim, bin, n of one group. Medians and quartile ranges."""
    mean, scale = np.zeros(DIMS), np.ones(DIMS)
    for dim, part in table.groupby("dim"):
        part = part.sort_values("bin")
        run = part["n"].cumsum().to_numpy()
        at = [part["bin"].to_numpy()[np.searchsorted(run, q * run[-1])] * GRID for q in (0.25, 0.5, 0.75)]
        mean[dim], scale[dim] = at[1] + GRID / 2, max((at[2] - at[0]) / 1.349, GRID)
    return pd.DataFrame([{"g": table["g"].iloc[0], "middle": mean.tolist(), "scale": scale.tolist()}])


def _square(products: Sequence[float]) -> np.ndarray:
    out = np.zeros((DIMS, DIMS))
    for (i, j), x in zip(PAIRS, products, strict=True):
        out[i, j] = out[j, i] = x
    return out


def _starts(table: pd.DataFrame) -> pd.DataFrame:
    """table: one row g, middle, scale, tanh (sums of products), sign (the same). One model a start."""
    row = table.iloc[0]
    mean, scale = np.asarray(row["middle"]), np.asarray(row["scale"])
    rows = [_flat(row["g"], 0, mean, np.diag(scale**2))]
    for start, name in ((1, "tanh"), (2, "sign")):
        both = _square(row[name])
        size = np.sqrt(np.maximum(np.diag(both), 1e-12))
        # Shrunk a little, so that the start has an inverse.
        rows.append(_flat(row["g"], start, mean, (0.95 * both / np.outer(size, size) + 0.05 * np.eye(DIMS)) * np.outer(scale, scale)))
    return pd.DataFrame(rows)


def _moments(table: pd.DataFrame, wanted: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the nearest wanted vectors; table: bin, n, s (sums), q (sums of products), sorted by bin."""
    n = table["n"].to_numpy(np.float64)
    part = np.clip((wanted - (np.cumsum(n) - n)) / n, 0.0, 1.0)
    mean = part @ np.stack(table["s"].map(np.asarray).to_list()) / (part @ n)
    return mean, _square(part @ np.stack(table["q"].map(np.asarray).to_list()) / (part @ n)) - np.outer(mean, mean)


def _step(table: pd.DataFrame) -> pd.DataFrame:
    """table: g, start, bin, n, s, q of one group and start."""
    table = table.sort_values("bin")
    return pd.DataFrame([_flat(table["g"].iloc[0], int(table["start"].iloc[0]), *_moments(table, CORE * table["n"].sum()))])


def _reweighted(table: pd.DataFrame) -> pd.DataFrame:
    """table: as for _step, binned by the core's model. The last model: with floors, for verdicts."""
    table = table.sort_values("bin")
    # The core's distances are those of its own covariance; the usual distance is that of the consistent one.
    far = chi2_bar(1 - USUAL, DIMS) * (CORE / chi2_cdf(chi2_bar(1 - CORE, DIMS), DIMS + 2))
    wanted = max(CORE * table["n"].sum(), table["n"][table["bin"] < math.floor(math.log1p(far) * BINS_A_UNIT)].sum())
    mean, cov = _moments(table, wanted)
    return pd.DataFrame([_flat(table["g"].iloc[0], 0, mean, _consistent(cov, max(CORE, min(USUAL, wanted / table["n"].sum()))) + np.diag(np.square(FLOOR)))])


def _bar(table: pd.DataFrame) -> pd.DataFrame:
    """table: g, bin, n of one group. The squared distance beyond which its vectors are rejected."""
    table = table.sort_values("bin")
    run = table["n"].cumsum().to_numpy()
    median = math.expm1((table["bin"].to_numpy()[np.searchsorted(run, run[-1] / 2)] + 0.5) / BINS_A_UNIT)
    most = chi2_bar(REJECTED, DIMS)
    return pd.DataFrame([{"g": table["g"].iloc[0], "bar": min(most, max(LEAST_FAR, most * median / chi2_bar(0.5, DIMS)))}])


def distance2() -> Column:
    terms = [F.col("p")[k] * (F.col("x")[i] - F.col("m")[i]) * (F.col("x")[j] - F.col("m")[j]) for k, (i, j) in enumerate(PAIRS)]
    return sum(terms[1:], terms[0])


def _key(*cols: str) -> Column:
    return F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in cols))


def _binned(data: DataFrame, model: DataFrame, rows: int) -> DataFrame:
    bin_ = F.least(F.lit(LAST_BIN), F.floor(F.log1p(F.greatest(distance2(), F.lit(0.0))) * BINS_A_UNIT)).cast("int")
    return join_counted(data, model, rows, ["g"]).withColumn("bin", bin_)


def _summed(data: DataFrame, model: DataFrame, rows: int) -> DataFrame:
    """g, start, bin, n, s, q: the vectors of each group and start, binned by their distances."""
    sums = F.array(*(F.sum(F.col("x")[i]) for i in range(DIMS))).alias("s")
    products = F.array(*(F.sum(F.col("x")[i] * F.col("x")[j]) for i, j in PAIRS)).alias("q")
    return _binned(data, model, rows).groupBy("g", "start", "bin").agg(F.count("*").alias("n"), sums, products)


def cores(data: DataFrame, rows: int) -> DataFrame:
    """Models of the cores of least determinant; data: g, x; rows: how many groups there may be."""
    cells = data.select("g", F.posexplode("x").alias("dim", "v")).groupBy("g", "dim", F.floor(F.col("v") / GRID).alias("bin")).agg(F.count("*").alias("n"))
    middle = cut(cells.groupBy("g").applyInPandas(_middle, "g string, middle array<double>, scale array<double>"))
    z = [(F.col("x")[i] - F.col("middle")[i]) / F.col("scale")[i] for i in range(DIMS)]
    length = F.sqrt(sum((F.col("z")[i] * F.col("z")[i] for i in range(1, DIMS)), F.col("z")[0] * F.col("z")[0]))
    signed = join_counted(data, middle, rows, ["g"]).select("g", F.array(*z).alias("z")).withColumn("t", F.transform("z", F.tanh)).withColumn("u", F.transform("z", lambda x: F.when(length > 0, x / length).otherwise(0.0)))
    both = lambda c: F.array(*(F.sum(F.col(c)[i] * F.col(c)[j]) for i, j in PAIRS))
    model = cut(signed.groupBy("g").agg(both("t").alias("tanh"), both("u").alias("sign")).join(middle, "g").groupBy("g").applyInPandas(_starts, _MODEL))
    stepped = lambda m: cut(_summed(data, m, 3 * rows).groupBy("g", "start").applyInPandas(_step, _MODEL))
    for _ in range(FIRST_STEPS):
        model = stepped(model)
    best = F.min_by(F.struct("start", "m", "p", "det"), F.struct("det", "start"))
    model = cut(model.groupBy("g").agg(best.alias("b")).select("g", "b.*"))
    for _ in range(STEPS):
        new = stepped(model)
        fell = new.join(model.select("g", F.col("det").alias("before")), "g")
        if fell.where(F.col("det") < F.col("before") - 1e-6).isEmpty():
            break
        old = model.select("g", *(F.col(c).alias(f"old_{c}") for c in ("start", "m", "p", "det")))
        less = F.col("det") < F.col("old_det")
        model = cut(new.join(old, "g").select("g", *(F.when(less, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in ("start", "m", "p", "det"))))
    return model


def fit(stats: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """stats: lang, source, the statistics, base_failed. Returns (language-source key -> group), models and their size."""
    good = stats.where("not base_failed").select(_key("lang", "source").alias("k"), _key("lang").alias("l"), F.array(*vector()).alias("x"))
    sizes = cut(good.groupBy("k", "l").count())
    rows = sizes.count()
    rest = sizes.where(F.col("count") < LEAST_GROUP).groupBy("l").agg(F.sum("count").alias("pool"))
    group = F.when(F.col("count") >= LEAST_GROUP, F.col("k")).when(F.col("pool") >= LEAST_GROUP, F.concat(F.lit("pool "), F.col("l"))).otherwise("pool")
    groups = cut(sizes.join(rest, "l", "left").select("k", group.alias("g")))
    data = cut(join_counted(good, groups, rows, ["k"]).select("g", "x"))
    model = cut(_summed(data, cores(data, rows), rows).groupBy("g").applyInPandas(_reweighted, _MODEL))
    distances = _binned(data, model, rows).groupBy("g", "bin").agg(F.count("*").alias("n"))
    model = cut(model.join(distances.groupBy("g").applyInPandas(_bar, "g string, bar double"), "g").select("g", "m", "p", "bar"))
    least = data.groupBy("g").count().where(F.col("count") >= LEAST_POOL).select("g")
    return groups, model.join(least, "g", "left_semi"), rows


def judge(stats: DataFrame, groups: DataFrame, model: DataFrame, rows: int) -> DataFrame:
    """stats with kept; distance2 is the squared distance (null where there is no model)."""
    marked = stats.withColumn("k", _key("lang", "source")).withColumn("x", F.array(*vector()))
    found = join_counted(join_counted(marked, groups, rows, ["k"], "left"), model, rows, ["g"], "left").withColumn("distance2", distance2())
    far = F.coalesce(F.col("distance2") > F.col("bar"), F.lit(False))
    return found.withColumn("kept", ~F.col("base_failed") & ~far).drop("k", "x", "g", "m", "p", "bar")


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance2."""
    stats = cut(statistics(docs.select("doc_id", "lang", "source", text_or_empty().alias("text")), "text"))
    return judge(stats, *fit(stats)).drop("lang", "source")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs, with its columns, that the rules keep. The text is read twice and never shuffled."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "lang", "source", text_or_empty().alias("text"))
    fitted = fit(cut(statistics(rows.drop("row"), "text")))
    return judge(statistics(rows, "text"), *fitted).where("kept").select("row.*")

"""Importance resampling, spelling variants and the line field against plain versions, and their edge cases."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstrata.llm import linefield, queries, resample, variants

DATA = "/root/testdata/sf0.001"
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark):
    """Real rows and edge cases: nulls, empty and repeated rows, ties, a long text, letters beyond ASCII, clashing names."""
    odd = [
        (9001, None, "en"), (9002, "", None), (None, "a row without an id " * 8, "en"), (9003, "one", "en"), (9003, "one", "en"), (9004, "Straße ÄÖ×÷ naïve " * 40, "de"), (9004, "Straße ÄÖ×÷ naïve " * 40, "de"),
        (9005, "word " * 6000 + "\n" + "!!! ### $$$ " * 500, "en"), (9006, "\n\n \t\n", "en"), (9007, "日本語 テキスト " * 30, "ja"), (9008, "spelling\nspeling\nspellings " * 9, "en"), (9009, " x y퟿ z" * 12, None),
    ]
    extra = spark.createDataFrame(odd, "doc_id long, text string, lang string").withColumns({"source": F.lit("s"), "n_chars": F.lit(1).cast("long")})
    clash = {c: F.lit(1) for c in ("n_words", "buckets", "weight", "rank", "word", "n", "size", "score", "place", "label", "__row")}
    return spark.read.parquet(f"{DATA}/documents.parquet").unionByName(extra).withColumns(clash)


@pytest.fixture(scope="module")
def plain(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def rows(df):
    return sorted(map(str, map(tuple, df.collect())))


# --- Importance resampling ---


def features(text, order=3, buckets=10_000):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.translate(LOW))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for i in range(len(words)) for k in range(1, order + 1) if i + k <= len(words)]


def importance(docs, target, buckets=10_000):
    found = [(i, *features(t)) for i, t in docs]
    s, t = Counter(itertools.chain.from_iterable(x for *_, x in found)), Counter(itertools.chain.from_iterable(features(x)[1] for x in target))
    n, m = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n + buckets) / ((s[b] + 1) * (m + buckets)))) for b in range(buckets)]
    out = []
    for i, words, x in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in x)
        out.append([i, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, words])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    for rank, r in enumerate(able[: 5 * len(able) // 100], 1):
        r[4] = rank
    return sorted(str(tuple(r[:5])) for r in out)


def test_resampling_equals_the_plain_version(spark, docs, plain):
    target = spark.read.parquet(f"{DATA}/benchmark.parquet")
    want = importance(plain, [r.text or "" for r in target.collect()])
    assert rows(resample.resample_scores(docs, target)) == want
    drawn = [r for r in resample.resampled(docs, target).collect() if r["rank"]]
    assert sorted(r["rank"] for r in drawn) == list(range(1, len(drawn) + 1)) and len(drawn) > 5
    kept = resample.drawn_documents(docs, target)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in drawn}


def test_ring_emits_every_run_of_words():
    row = [b"a", b"bb", b"c", "ü".encode(), b"a"]
    got = Counter(resample.ring_buckets(row, 4, 50_000).tolist())
    assert got == Counter(zlib.crc32(b" ".join(row[i : i + k])) % 50_000 for i in range(5) for k in range(1, 5) if i + k <= 5)
    assert resample.ring_buckets([], 3).tolist() == []
    with pytest.raises(ValueError, match="two bytes"):
        resample.bucketed(None, buckets=1 << 17)


def test_ranks_with_ties_and_many_partitions(spark):
    table = spark.range(1000).select((F.col("id") % 300).alias("doc_id"), F.lit(30).alias("n_words"), F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 7).alias("score"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = resample.ranked(table.repartition(7), 20, 50).where("rank is not null").orderBy("rank").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted(((r.score, r.doc_id) for r in table.collect()), key=lambda x: (-x[0], x[1]))[:500]
    assert [(r.score, r.doc_id) for r in got] == want and [r["rank"] for r in got] == list(range(1, 501))


def test_resampling_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    assert resample.resample_scores(none, some).count() == 0
    assert rows(resample.resample_scores(some, none)) == importance([(1, "a b c"), (2, "")], [])


# --- Spelling variants ---


def counted(docs, least=5):
    total = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            total[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= least}


def neighbours(words):
    """Each word's words at one edit: those that share a form with one character struck out, then compared."""
    struck = defaultdict(set)
    for w in words:
        for x in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            struck[x].add(w)

    def apart(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    return {w: {v for x in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))} for v in struck[x] if apart(w, v)} for w in words}


def grouped(counts):
    near, form = neighbours(counts), {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        if best and counts[best] >= 5 * n:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(str((w, form.get(w), root(w), n, len(near[w]), counts[form[w]] if w in form else None)) for w, n in counts.items())


def test_variants_equal_the_plain_version(docs, plain):
    counts = counted(plain)
    assert len(counts) > 300 and any("ß" in w for w in counts)
    assert rows(variants.spelling_variants(docs)) == grouped(counts)


def test_hot_groups_are_parted_without_loss(spark):
    rng = np.random.default_rng(3)
    middle = {"".join(x) for x in rng.choice(list("abc"), (900, 5))}
    words = {f"{head}{m}{tail}": 5 for m in middle for head, tail in (("prefix", ""), ("", "suffix"), ("pre", "fix"))} | {"prefixabcab" + "é": 40, "aaaaaa": 7, "aaaaaaa": 70, "aaaaaaaa": 700}
    for i, w in enumerate(sorted(words)):
        words[w] += i % 50
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    want = sorted(str((w, v, words[v])) for w, all_ in neighbours(words).items() for v in all_)
    for group in (3, 40, 10_000):
        assert rows(variants.near_words(table, group=group)) == want
    assert rows(variants.variant_forms(table)) == grouped(words)


def test_automaton_numbers_its_words_and_is_minimal():
    words = sorted({"".join(x) for n in range(1, 6) for x in itertools.product("ab", repeat=n)})
    whole = variants.Automaton(words)
    assert len(whole.final) == 6  # as many states as lengths left
    for i, w in enumerate(words):
        state, number = whole.walk(w, 0, whole.root, 0)
        assert whole.final[state] and number == i
    near = neighbours(words)
    for w in words:
        assert {words[k] for k in whole.one_error(w, 0)} == near[w]
        assert {words[k] for k in whole.one_error(w, 2)} == {v for v in near[w] if v[:2] == w[:2]} or len(w) < 2
    assert variants.Automaton([]).one_error("abc", 0) == set()


def test_long_chains_of_forms_and_no_words(spark):
    names = ["chains" + "s" * k for k in range(9)]
    table = spark.createDataFrame([(w, 5 * 5**k) for k, w in enumerate(names)], "word string, n long")
    assert {r.root for r in variants.variant_forms(table).collect()} == {names[-1]}
    none = spark.createDataFrame([], "doc_id long, text string")
    assert variants.spelling_variants(none).count() == 0


# --- Quality by lines ---


def test_forward_backward_against_every_labelling():
    rng = np.random.default_rng(4)
    lengths = np.array([1, 4, 0, 2, 5])
    starts = np.cumsum(lengths) - lengths
    scores, moves = rng.normal(size=12), rng.normal(size=(2, 2))
    norm, good, pairs = linefield.forward_backward(scores, starts, lengths, moves)
    want_pairs = np.zeros((2, 2))
    for c, (a, k) in enumerate(zip(starts, lengths, strict=True)):
        if not k:
            continue
        total, ones, two = 0.0, np.zeros(k), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(k)):
            p = math.exp(sum(scores[a + i] for i in range(k) if y[i]) + sum(moves[u, v] for u, v in itertools.pairwise(y)))
            total += p
            ones += p * np.array(y)
            for u, v in itertools.pairwise(y):
                two[u, v] += p
        want_pairs += two / total
        assert np.isclose(norm[c], math.log(total)) and np.allclose(good[a : a + k], ones / total)
    assert np.allclose(pairs, want_pairs)


def test_slope_of_the_likelihood():
    """The fit ends where no direction makes the labels likelier."""
    rng = np.random.default_rng(6)
    stats = [rng.normal(loc=k % 2, size=(1 + k % 5, linefield.WIDTH)).astype(np.float32) for k in range(60)]
    labels = np.array([k % 2 for k in range(60)])
    field = linefield.fit_field(stats, labels, penalty=1e-2, steps=300)

    def loss(weights, moves):
        own = linefield.Field(field.mean, field.scale, weights, moves)
        scores, starts, lengths = own.scores(stats)
        norm = linefield.forward_backward(scores, starts, lengths, moves)[0]
        y = np.repeat(labels, lengths)
        stays = np.array([(lengths - 1)[labels == k].sum() for k in (0, 1)])
        return (norm.sum() - y @ scores - stays @ np.diag(moves)) / len(scores) + 1e-2 * (weights @ weights + (moves**2).sum()) / 2

    best = loss(field.weights, field.moves)
    for _ in range(20):
        way, turn = rng.normal(size=field.weights.shape) * 1e-3, rng.normal(size=(2, 2)) * 1e-3
        assert loss(field.weights + way, field.moves + turn) >= best - 1e-9


def test_quality_on_held_out_rows(spark):
    """Accuracy and order on rows that training never saw, on the larger table."""
    got = {r.doc_id: r for r in queries.queries()["op13_quality_classifier"](spark, "/root/testdata/sf0.01").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(got[d].score, got[d].predicted, y) for d, y in labels.items() if d in got and zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d in got)
    good, bad = [s for s, _, y in held if y], [s for s, _, y in held if not y]
    assert len(bad) > 5 and sum(p == y for _, p, y in held) >= 0.97 * len(held)
    assert sum((a > b) + 0.5 * (a == b) for a in good for b in bad) >= 0.98 * len(good) * len(bad)


def test_quality_edges(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").unionByName(spark.createDataFrame([(None, 1, 0), (9003, None, 0), (9004, 1, 0), (9004, 0, 0)], "doc_id long, quality int, toxic int"))
    field = linefield.train(docs, labels)
    assert isinstance(field, linefield.Field)
    out = linefield.quality_scores(docs, field)
    assert set(docs.columns) - {"text"} | {"held_out", "predicted", "score"} == set(out.columns) and out.count() == docs.count()
    got = out.select("doc_id", "score", "predicted", "held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out is not None for r in got)
    assert len({r.score for r in got if r.doc_id in (9001, 9002, 9006)}) == 1
    # The same model and scores whatever the order of rows; nothing but the text tells.
    again = linefield.train(docs.repartition(5, "lang"), labels.orderBy(F.rand(1)))
    assert np.allclose(field.weights, again.weights, atol=1e-6)
    other = docs.withColumns({"doc_id": F.col("doc_id") + 1, "lang": F.lit("x"), "source": F.lit("y")})
    assert sorted(r.score for r in linefield.quality_scores(other, field).collect()) == sorted(r.score for r in got)
    # Lines are what marginals come for, and a document's score is their average by length.
    two = spark.createDataFrame([(1, "a fine line of words here\n\n### $$$ &&&")], "doc_id long, text string")
    (p,) = linefield.line_marginals(two, field).collect()
    assert len(p.probabilities) == 2
    w = [25, 11]
    assert abs(linefield.quality_scores(two, field).first().score - sum(x * y for x, y in zip(p.probabilities, w, strict=True)) / 36) < 1e-9


def test_quality_without_labels(spark):
    some = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    assert {r.score for r in linefield.quality_predictions(some, labels([])).collect()} == {0.5}
    assert {r.score for r in linefield.quality_predictions(some, labels([(1, 1), (2, 1)])).collect()} == {1.0}
    assert linefield.quality_predictions(some.limit(0), labels([(1, 1)])).count() == 0

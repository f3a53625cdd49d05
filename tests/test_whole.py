"""Queries that take whole tables, whole texts and as many resamples as the reference."""

import hashlib
import math
import random

import numpy as np
import pytest

import __spark_entry__
from parley.functions import arrow
from parley.operators import metrics as mt
from pyspark.sql import functions as F


def distance(a, b):
    row = np.arange(len(b) + 1)
    chars = np.array(list(b), dtype="U1")
    for i, c in enumerate(a, 1):
        new = np.concatenate([[i], np.minimum(row[:-1] + (chars != c), row[1:] + 1)])
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return int(row[-1])


def test_cer_scores_long_documents_whole(spark, tmp_path):
    rng = random.Random(7)
    texts = ["".join(rng.choice("tho nxab.\nT") for _ in range(n)) for n in (0, 5, 60, 1999, 2000, 3500)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = [0, 0]
    for t in texts:
        a = "".join(c for c in t.lower() if "a" <= c <= "z" or c == " ")
        b = a.replace("th", "x").replace("on", "x")
        want = [want[0] + distance(a, b), want[1] + len(a)]
    assert list(__spark_entry__.queries()["cer"](spark, str(tmp_path)).first()) == want


def edited(rng, text, share):
    """text with about that share of its characters gone, doubled or replaced."""
    return "".join(rng.choice(("", c + c, "q")) if rng.random() < share else c for c in text)


def test_edit_distance_equals_the_plain_table(spark):
    rng = random.Random(3)
    rows = [(None, "a"), ("a", None), ("", ""), ("", "abc"), ("x" * 300, "y" * 200), ("ab" * 300, "ba" * 300), ("a😀b" * 20, "a😀c" * 30)]
    for n in range(300):
        a = "".join(rng.choice("ab" if n % 3 else "abcdefgh \u00e9\U0001f600") for _ in range(rng.randrange(300)))
        rows.append((a, edited(rng, a, rng.random() / 2) if n % 2 else "".join(rng.choice("ab") for _ in range(rng.randrange(300)))))
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", arrow.edit_distance("a", "b").alias("e"), arrow.edit_distance("b", "a").alias("back"))
    for r in df.collect():
        want = None if r["a"] is None or r["b"] is None else distance(r["a"], r["b"])
        assert r["e"] == want == r["back"], (r["a"], r["b"])


def test_edit_distance_of_long_texts():
    """200 kB against a copy with errors at known places, far enough apart that none of them helps another."""
    rng = random.Random(8)
    a = "".join(rng.choice("etaoinshrdlu ") for _ in range(200_000))
    at = range(50, 200_000, 100)
    b = list(a)
    for i in at:
        b[i] = "#"
    assert arrow.distance(a, "".join(b)) == len(at)
    assert arrow.distance(a, a[:70_000] + a[70_500:]) == 500
    assert arrow.distance(a, a + a[:900]) == 900


def test_paired_resampling_takes_single_documents(spark, tmp_path):
    rng = np.random.default_rng(5)
    n = 300
    q, t = rng.integers(0, 2, n), rng.integers(0, 2, n)
    spark.createDataFrame([(i, "s", "de") for i in range(n)], "doc_id long, source string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(q[i]), int(t[i])) for i in range(n)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    b = np.where(np.arange(n) % 3 == 0, 1 - q, q)
    f1 = lambda g, p: 2 * (g * p).sum(-1) / np.maximum((g + p).sum(-1), 1)
    at = rng.integers(0, n, (10_000, n))
    v = np.sort(f1(q[at], t[at]) - f1(q[at], b[at]))
    got = __spark_entry__.queries()["paired_bootstrap_10000"](spark, str(tmp_path)).first()
    assert got["delta_f1"] == pytest.approx(f1(q, t) - f1(q, b), abs=1e-6)
    # one group of source and lang holds all documents: resampling groups would give an interval of no width
    assert got["lo"] == pytest.approx(v[250], abs=0.01) and got["hi"] == pytest.approx(v[9749], abs=0.01)


def test_interval_of_a_thousand_resamples(spark, tmp_path):
    rng = random.Random(9)
    rows = [(c, 0, "user", ". ".join(" ".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 9))) for _ in range(4))) for c in range(30)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    num, den = np.zeros(30), np.zeros(30)
    for c, _, _, text in rows:
        ln = ["".join(x.split()) for x in text.split(".")]
        for ref, hyp in zip(ln, ln[1:]):
            num[c] += distance(ref, hyp)
            den[c] += len(ref)
    w = np.array([[poisson(c, r) for c in range(30)] for r in range(1000)])
    v = np.sort((w * num).sum(1) / (w * den).sum(1))
    got = __spark_entry__.queries()["bootstrap_ci"](spark, str(tmp_path)).first()
    assert (got["lo"], got["hi"]) == pytest.approx((v[25], v[974]), abs=1e-6)


def poisson(key, rep, seed=42):
    """How often a repetition takes a key, by whole numbers of any size."""

    def mixed(x):
        x = (x ^ x >> 16) * 0x7FEB352D % 2**32
        x = (x ^ x >> 15) * 0x846CA68B % 2**32
        return x ^ x >> 16

    h = hashlib.sha256(f"{seed}|{key}".encode()).hexdigest()
    x = mixed(mixed((int(h[:8], 16) + rep * 0x9E3779B9) % 2**32) ^ int(h[8:16], 16)) / 2**32
    k, p = 0, math.exp(-1)
    while x >= p:
        k += 1
        p += math.exp(-1) / math.factorial(k)
    return k


def test_weights_are_those_of_draws_with_replacement(spark):
    """Mean and variance one, keys and repetitions unrelated; an interval like that of the generator's draws."""
    h = np.random.default_rng(2).integers(0, 2**32, (2, 400))
    w = mt.weights(h[0], h[1], np.arange(2000))
    assert w.mean() == pytest.approx(1, abs=0.005) and w.var() == pytest.approx(1, abs=0.01)
    assert [(w == k).mean() for k in range(4)] == pytest.approx([math.exp(-1) / math.factorial(k) for k in range(4)], abs=0.003)
    keys, reps = np.corrcoef(w), np.corrcoef(w.T[:400])
    assert np.abs(keys - np.eye(400)).max() < 0.13 and np.abs(reps - np.eye(400)).max() < 0.3
    rng = random.Random(1)
    rows = [("s", k, rng.randrange(5), rng.randrange(5, 15)) for k in range(200)]
    facts = spark.createDataFrame(rows, "system string, key long, num int, den int")
    mine, drawn = mt.ratio_bounds(facts, 1000).first(), mt.ratio_interval(facts, mt.resamples(spark, list(range(200)), 1000, 1), 1000).first()
    assert (mine["lo"], mine["hi"]) == pytest.approx((drawn["lo"], drawn["hi"]), abs=0.006)


def test_weighted_sums_of_rows_that_share_a_key(spark):
    """Rows of one key have one weight, wherever they are; null keys are one key, null values nothing; groups may be null."""
    rows = [("a", 1, 2, 3), ("a", 1, 5, 7), ("b", 1, 1, 1), (None, None, 4, None), (None, None, 6, 1)]
    facts = spark.createDataFrame(rows, "system string, key long, num int, den int").repartition(4)
    got = {(r["system"], r["rep"]): (r["num"], r["den"]) for r in mt.weighted_sums(facts, ["system"], ["num", "den"], 40).collect()}
    for r in range(40):
        k, x = poisson(1, r), poisson("", r)
        assert got["a", r] == (7 * k, 10 * k) and got["b", r] == (k, k) and got[None, r] == (10 * x, x)
    assert mt.ratio_bounds(facts.limit(0), 40).count() == 0

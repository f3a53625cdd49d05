"""Typed spans, reports of agreement and sensitivity, times in windows, and what only other programs call."""

import itertools
import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from parley.functions import arrow
from parley.functions import lexicon as lx
from parley.operators import agreement as ag
from parley.operators import annotations as an
from parley.operators import asr, reports
from parley.operators import metrics as mt
from parley.operators import sampling as sp
from parley.sources import conll, stores


def spans_of(labels):
    """(type, start, end) of typed runs, label by label."""
    out, now = set(), None
    for i, x in enumerate([*labels, "O"]):
        mark, kind = (x[0], x[2:]) if x and x[:2] in ("B-", "I-", "E-", "S-") else ("I", x)
        kind = None if x in ("O", None) else kind
        if now and (kind != now[0] or mark in "BS" or now[2]):
            out.add((now[0], now[1], i - 1))
            now = None
        if kind and not now:
            now = [kind, i, False]
        if now:
            now[2] = mark in "ES"
    return out


def test_entity_scores(spark):
    rng = random.Random(3)
    kinds = ["O", "O", "B-A", "I-A", "B-B", "I-B", "E-A", "S-B", "C", None]
    docs = [([rng.choice(kinds) for _ in range(n)], None) for n in (0, 1, 2, 30, 30, 30, 30)]
    docs = [(g, [x if rng.random() < 0.8 else rng.choice(kinds) for x in g]) for g, _ in docs]
    rows = [(d, i * 2, a, b) for d, (g, p) in enumerate(docs) for i, (a, b) in enumerate(zip(g, p))]
    df = spark.createDataFrame(rows, "doc int, pos int, gold string, pred string").repartition(3)
    found = {(r["doc"], r["type"], r["start"] // 2, r["end"] // 2) for r in mt.entities(df.withColumnRenamed("gold", "label"), ["doc"]).collect()}
    assert found == {(d, *s) for d, (g, _) in enumerate(docs) for s in spans_of(g)}
    gold, pred = ({(d, *s) for d, x in enumerate(docs) for s in spans_of(x[k])} for k in (0, 1))
    got = {r["type"]: r for r in mt.entity_scores(df, ["doc"]).collect()}
    assert set(got) == {"all"} | {s[1] for s in gold | pred}
    for t, r in got.items():
        g, p = ({s for s in x if t in ("all", s[1])} for x in (gold, pred))
        assert (r["tp"], r["predicted"], r["gold"]) == (len(g & p), len(p), len(g))
        assert r["f1"] == pytest.approx(2 * len(g & p) / (len(g) + len(p))) and r["accuracy"] == pytest.approx(sum(a == b for _, _, a, b in rows) / len(rows))
    assert mt.entity_scores(df.where("gold = 'O' AND pred = 'O'"), ["doc"]).count() == 0


def test_labels_of_words(spark):
    """argmax over the logits of subwords, and of a word's subwords the first one counts."""
    rows = [("d", 0, 0, [0.1, 0.9]), ("d", 0, 1, [0.8, 0.2]), ("d", 1, 2, [0.5, 0.5]), ("d", 2, 3, [-2.0, -1.0])]
    labels = spark.createDataFrame(rows, "doc string, word int, pos int, logits array<double>").withColumn("label", mt.argmax_label(F.col("logits")))
    assert [r["label"] for r in labels.orderBy("pos").collect()] == [1, 0, 0, 1]
    assert {r["word"]: r["label"] for r in mt.first_subword(labels, ["doc"]).collect()} == {0: 1, 1: 0, 2: 1}


def test_agreement_report(spark):
    blocks = spark.createDataFrame([("k1", "a", [1, 0]), ("k1", "b", [1, 1]), ("k1", "c", [1, 0]), ("k2", "a", [0]), ("k2", "b", [0]), ("k3", "c", [1])], "key string, annotator string, labels array<int>")
    got = {(r["who_a"], r["who_b"]): r for r in ag.report(blocks, 3).collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c"), (None, None)}
    assert [got["a", "c"][c] for c in ("shared_blocks", "unmatched_a", "unmatched_b", "exact_block_agreement")] == [1, 1, 1, 1.0]
    assert (got[None, None]["tokens"], got[None, None]["tokens_with_all"]) == (3, 2) and got[None, None]["shared_blocks"] is None


def test_refits_and_the_tokens_they_change(spark):
    rng = random.Random(4)
    rows = [(g, t, a, int(rng.random() < (0.85 if (g + t) % 2 else 0.2) - 0.1 * (a == "C"))) for g in range(40) for t in range(6) for a in "ABC" if not (a == "C" and g % 4 == 0)]
    ratings = spark.createDataFrame(rows, "group_id int, tok int, annotator string, value int")
    models = an.variants(ratings, ["group_id", "tok"])
    models["wild"] = {"prevalence": 0.5, "annotators": {"A": {"sensitivity": 0.9, "specificity": 0.9}, "B": {"sensitivity": 0.6, "specificity": 0.6}, "C": {"sensitivity": 0.6, "specificity": 0.6}}}
    assert models["model"] == an.fit_from(ratings, ["group_id", "tok"]) and len(models) == 6
    units = {}
    for g, t, a, v in rows:
        units.setdefault((g, t), {})[a] = v
    disputed = [r for r in units.values() if len(set(r.values())) > 1]
    want = {name: (len(disputed), sum((an.posterior(r, m) >= 0.5) != (an.posterior(r, models["model"]) >= 0.5) for r in disputed)) for name, m in models.items() if name != "model"}
    got = {r["variant"]: (r["disputed"], r["changed"]) for r in an.changed_by(ratings, models).collect()}
    assert got == want and got["wild"][1] > 0


def test_tokens_of_one_kind_are_counted_not_listed(spark):
    """Against the ratings token by token: rows of several lengths, an annotator twice, scopes beyond the end; then a text too long to list."""
    rng = random.Random(9)
    rows = [(g, g % 3 == 0, a, rng.choice((0, 3, 7, 7, 7)) if g % 4 == 0 else 7, [rng.randrange(9) for _ in range(rng.randrange(4))]) for g in range(40) for a in rng.choices("ABC", k=rng.randint(1, 4))]
    kind = "group_id int, ambiguous boolean, annotator string, n_tokens int, scope array<int>"
    al = spark.createDataFrame(rows, kind)
    ratings = al.where("n_tokens > 0").transform(an.scope_ratings)
    plain = {tuple(r) for r in an.response_patterns(ratings, ["group_id", "tok"]).collect()}
    assert {tuple(r) for r in an.class_patterns(al).collect()} == plain and len(plain) > 5
    m = an.fit_from(ratings, ["group_id", "tok"])
    assert an.fit_aligned(al) == m and an.variants_aligned(al)["model"] == m
    names = ("disputed", "label", "low_confidence", "union_label", "intersection_label")
    one = an.decide_scopes(ratings, m).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    few = an.decide_scopes(an.class_ratings(an.token_classes(al)), m, ("unit", "tokens")).groupBy(*names).agg(F.sum("tokens").alias("n"))
    assert {tuple(r) for r in few.collect()} == {tuple(r) for r in one.collect()}
    long = spark.createDataFrame([(1, False, "A", 2_000_000_000, [5, 6]), (1, False, "B", 2_000_000_000, [6])], kind)
    assert {tuple(r) for r in an.class_patterns(long).collect()} == {("A=0,B=0", 1_999_999_998), ("A=1,B=0", 1), ("A=1,B=1", 1)}


def test_points_in_intervals_equal_the_plain_join(spark):
    rng = random.Random(6)
    points = spark.createDataFrame([(rng.choice("ab"), rng.uniform(-20, 60)) for _ in range(400)] + [("a", 0.0), ("a", 10.0), ("b", None)], "doc string, t double")
    wins = spark.createDataFrame([("a", i, i * 7.0, i * 7.0 + rng.choice((0, 3, 7, 30))) for i in range(-2, 8)] + [("b", 0, 0.0, 50.0), ("a", 99, 0.0, 10.0), ("a", 98, 5.0, 4.0)], "doc string, win int, lo double, hi double")
    want = points.join(wins, "doc").where("t >= lo AND t < hi").select("doc", "t", "win")
    for width in (0.5, 7.0, 1000.0):
        got = asr.in_intervals(points, wins, "t", "lo", "hi", ["doc"], width)
        assert sorted(map(tuple, got.select("doc", "t", "win").collect())) == sorted(map(tuple, want.collect()))


def test_votes_of_lines_for_windows(spark):
    pairs = [("s", "d", "eins zwei drei vier fünf sechs", "eins zwei drei fünf sechs sieben"), ("t", "d", "eins zwei drei vier fünf sechs", "zwei drei vier")]
    df = spark.createDataFrame([(s, d, r.split(), h.split()) for s, d, r, h in pairs], "system string, doc string, ref_normalized array<string>, hyp_normalized array<string>")
    al = df.withColumn("chunks_normalized", arrow.word_chunks("ref_normalized", "hyp_normalized"))
    m = asr.matched_positions(al)
    assert sorted(map(tuple, m.collect())) == [("s", "d", 0, 0), ("s", "d", 1, 1), ("s", "d", 2, 2), ("s", "d", 4, 3), ("s", "d", 5, 4), ("t", "d", 1, 0), ("t", "d", 2, 1), ("t", "d", 3, 2)]
    lines = spark.createDataFrame([("d", p, p // 3) for p in range(6)], "doc string, pos int, line int")
    heard = spark.createDataFrame([(s, "d", k, k // 2) for s in "st" for k in range(6)], "system string, doc string, hyp_pos int, win int")
    assert sorted(map(tuple, asr.window_votes(m, lines, heard).collect())) == [("d", 0, 0, 4), ("d", 0, 1, 1), ("d", 1, 1, 2), ("d", 1, 2, 1)]


def test_orders_people_read_in(spark):
    rows = [("test", 1, "Interviewer", 0), ("train", 2, "Interviewer", 1), ("train", 2, "Interviewee", 0), ("val", 1, "Interviewer", 0), ("train", 1, "Interviewer", 5)]
    got = sp.master_order(spark.createDataFrame(rows, "split string, interview_id int, role string, sentence_index int")).collect()
    assert [tuple(r) for r in got] == sorted(rows, key=lambda r: (lx.SPLITS.index(r[0]), *r[1:]))
    issues = list(itertools.product(("b", "a"), (2, 1), ("y", "x"), (3, 0)))
    assert [tuple(r) for r in reports.in_reading_order(spark.createDataFrame(issues, "doc string, line int, category string, start int")).collect()] == sorted(issues)


def test_stores_and_splits(spark, tmp_path):
    with sqlite3.connect(tmp_path / "a.sqlite") as db:
        db.execute("CREATE TABLE annotations (sentence_id TEXT, annotator TEXT, groups_json TEXT, no_negation INTEGER, garbled INTEGER)")
        db.execute("INSERT INTO annotations VALUES ('s', 'a', '[]', 1, NULL)")
    assert [tuple(r) for r in stores.read_annotations(spark, str(tmp_path / "a.sqlite")).collect()] == [("s", "a", "[]", 1, None)]
    turns = stores.read_turns(spark, "ws://x", "tests.test_reports_more:Client").orderBy("interview_id", "pos").collect()
    assert [(r["interview_id"], r["text"]) for r in turns] == [("e1", "Hallo"), ("e1", "Ja"), ("e2", "Hallo"), ("e2", "Ja")]
    who = spark.createDataFrame([("e1", 5)], "interview_id string, interviewer_id int")
    iv = spark.createDataFrame([("e1",), ("e2",)], "interview_id string")
    assert stores.with_interviewer(iv.limit(1), who).first()["interviewer_id"] == 5
    with pytest.raises(Exception, match="no interviewer for e2"):
        stores.with_interviewer(iv, who).collect()
    for name in ("train", "val"):
        (tmp_path / name).write_text(f"{name}\tX\tO\n\nleft\tO\tO\n\n")
    got = conll.splits(spark, {n: str(tmp_path / n) for n in ("train", "val")}, "scope").collect()
    assert sorted((r["split"], r["tokens"]) for r in got) == [("eval", ["val"]), ("train", ["train"])]


class Client:
    def __init__(self, url):
        pass

    def keys(self):
        return ["e1", "e2"]

    def query(self, name, key):
        return json.loads(json.dumps([{"result": [{"experiment": key, "turns": [{"role": "Interviewer", "text": "Hallo", "turn_id": 7}, {"role": "Interviewee", "text": "Ja"}]}]}]))

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import agreement as ag
from parley.operators import annotations as an
from parley.operators import asr
from parley.operators import dialogue as dg
from parley.operators import metrics as mt
from parley.operators import sampling as sp
from tests.flow import match_cells
from parley.operators import segment as sg
from parley.operators import similarity as sim
from parley.operators.graph import connected


def test_clean_turns_merges_and_skips(spark):
    rows = [(1, 0, "Interviewer", "Hallo ."), (1, 1, "System", "x"), (1, 2, "Interviewer", ", gut"), (1, 3, "Interviewee", "  "), (1, 4, "Interviewer", "Ende"), (1, 5, "Interviewee", None)]
    got = dg.clean_turns(spark.createDataFrame(rows, "interview_id long, pos long, role string, text string")).collect()
    assert [(r["role"], r["text"], r["source_turn_ids"]) for r in got] == [("Interviewer", "Hallo ., gut Ende", ["1", "3", "5"])]


def test_bridge_and_blocks(spark):
    rows = [(1, 0, "Interviewer", "Ich wollte noch"), (1, 1, "Interviewee", "Ja genau."), (1, 2, "Interviewer", "etwas fragen."), (1, 3, "Interviewee", "Gut."), (1, 4, "Interviewer", "Neues Thema.")]
    t = dg.clean_turns(spark.createDataFrame(rows, "interview_id long, pos long, role string, text string"))
    b = dg.bridges(t)
    assert [(r["turn_idx"], r["to_turn_idx"]) for r in b.collect()] == [(0, 2)]
    blocks = dg.block_offsets(dg.role_blocks(t, b)).where("role = 'Interviewer'").orderBy("turn_idx").collect()
    assert [(r["block_idx"], r["span_start"]) for r in blocks] == [(0, 0), (0, 16), (1, 0)]
    s = sg.segment(dg.block_offsets(dg.role_blocks(t, b))).where("sentence = 'Ich wollte noch etwas fragen.'").first()
    assert s["cross_turn_sentence"] and s["reason"] is None and s["source_turns"] == [0, 2]


def cut(text, tagger=sg.lexical_tags):
    return [text[a:b] for a, b in sg.split_sentences(text, tagger)]


@pytest.mark.parametrize(
    ("text", "after"),
    [
        ("Das war z. B. neu. Dann ging es weiter!  Und? (Nun ja.) Ende", ["Das war z. B. neu.", "Dann ging es weiter!", "Und?", "(Nun ja.)", "Ende"]),
        ("Es kostet ca. 5 Euro bzw. mehr, d. h. viel.", None),
        ("Die Fassung 2.1 läuft.", None),
        ("Wir haben das gestern gemacht Dann haben wir gegessen.", ["Wir haben das gestern gemacht", "Dann haben wir gegessen."]),
        # a lower-case discourse word with a verb before its subject
        ("Wir sind hier durch jetzt schauen wir das Ergebnis an.", ["Wir sind hier durch", "jetzt schauen wir das Ergebnis an."]),
        # no verb known on the left, but a long left side and a capital
        ("dort der kleine Garten beim Bahnhof gleich Heute ist er zu.", ["dort der kleine Garten beim Bahnhof gleich", "Heute ist er zu."]),
        ("dort der kleine Garten Heute ist er zu.", None),
        # rating answers may end in a word that leaves others unfinished
        ("trifft er eher nicht zu Trifft überwiegend zu.", ["trifft er eher nicht zu", "Trifft überwiegend zu."]),
        ("das ist mir zu Ich habe keine Zeit.", None),
        # questions
        ("ich bin schon lange da wie ist das bei dir", ["ich bin schon lange da", "wie ist das bei dir"]),
        ("ich weiß ja nie so wie lange das ist", None),
        ("wir sind alle schon da wo ist der Rest", ["wir sind alle schon da", "wo ist der Rest"]),
        ("wir sind alle schon da wo der Rest ist", None),
        ("das hat er nie gesagt warum macht er das", ["das hat er nie gesagt", "warum macht er das"]),
        # left sides that cannot end
        ("Ich habe das gelesen, deshalb denke ich geht es so.", None),
        ("Wir haben noch Zeit, und wenn ihr nun da seid, ist es gut.", None),
        ("Wir sind heute hier, dann geht es los.", None),
        ("Also das ist aber er kommt ja noch.", None),
        # pronouns and "Und" need a verb soon after
        ("Das hat er schon gesehen Und weiter nichts", None),
        ("Das hat er schon gesehen Und das ist gut", ["Das hat er schon gesehen", "Und das ist gut"]),
        ("", []),
    ],
)
def test_sentence_boundaries(text, after):
    assert cut(text) == ([text] if after is None else after)


def test_parser_boundaries():
    def tagger(starts, pos=(), finite=(), tag=()):
        pos, tag = dict(pos), dict(tag)
        return lambda words: [sg.Tag(pos.get(w, ""), tag.get(w, ""), w in finite, w in finite, w in starts) for w in words]

    assert cut("Der Hund schläft Katzen jagen", tagger({"Katzen"})) == ["Der Hund schläft", "Katzen jagen"]
    assert cut("Der Hund (schläft Katzen jagen)", tagger({"Katzen"})) == ["Der Hund (schläft Katzen jagen)"]
    assert cut("Der Hund, weil Katzen jagen", tagger({"Katzen"})) == ["Der Hund, weil Katzen jagen"]
    assert cut("wenn der Hund Katzen jagt", tagger({"Katzen"}, finite={"jagt"})) == ["wenn der Hund Katzen jagt"]
    assert cut("wenn der Hund jagt Katzen laufen", tagger({"Katzen"}, finite={"jagt"})) == ["wenn der Hund jagt", "Katzen laufen"]
    assert cut("Wie hoch ist Lohn heute", tagger({"Lohn"}, pos={"Lohn": "NOUN"})) == ["Wie hoch ist Lohn heute"]
    assert cut("Wie hoch ist heute so", tagger({"heute"}, pos={"heute": "ADV"})) == ["Wie hoch ist", "heute so"]
    assert cut("er sah den Hund", tagger({"Hund"}, pos={"den": "DET"})) == ["er sah den Hund"]
    assert cut("er sah den alten Hund", tagger({"Hund"}, pos={"den": "DET"}, tag={"alten": "ADJA"})) == ["er sah den alten Hund"]
    assert cut("Untertitelung 2020 Hallo Welt", tagger({"Hallo"})) == ["Untertitelung 2020 Hallo Welt"]


def test_sentence_splitting_is_linear():
    import time

    def seconds(n):
        t = time.perf_counter()
        sg.split_sentences("wort " * n)
        return time.perf_counter() - t

    seconds(1000)
    assert seconds(80_000) < 40 * max(seconds(8_000), 0.01)


def test_pack_windows(spark):
    r = spark.createDataFrame([(1, *map(float, x)) for x in ((0, 5), (6, 10), (20, 25), (25.5, 40), (41, 55))], "k int, start double, end double")
    assert [(x["start"], x["end"]) for x in asr.pack_windows(r, "k").orderBy("win").collect()] == [(0, 10), (20, 40), (41, 55)]


def placed(spark, lines, n):
    """lines: votes of each line as {window: (votes, order of the first)}."""
    rows = [("d", k, w, c, f) for k, v in enumerate(lines) for w, (c, f) in (v or {None: (None, None)}).items()]
    votes = spark.createDataFrame(rows, "doc string, line long, win int, n long, first long")
    got = asr.place_lines(votes, spark.createDataFrame([("d", n)], "doc string, n_windows int")).orderBy("line").collect()
    return [(r["win"], r["lo"], r["hi"]) for r in got]


def test_window_placement(spark):
    assert [p[0] for p in placed(spark, [{1: (4, 0)}, {}, {}, {5: (1, 0)}], 9)] == [1, 2, 3, 5]
    assert [p[0] for p in placed(spark, [{1: (4, 0)}, {}, {}, {3: (1, 0)}], 9)] == [1, 2, 2, 3]  # fewer windows than lines
    assert [p[0] for p in placed(spark, [{4: (2, 0)}, {2: (9, 0)}], 9)] == [4, 4]  # never back in time
    assert [p[0] for p in placed(spark, [{}, {2: (1, 0)}, {}, {}], 4)] == [0, 2, 3, 3]  # before the first and after the last
    assert [p[0] for p in placed(spark, [{}, {0: (1, 0)}, {}], 1)] == [0, 0, 0]  # nowhere to go
    assert [p[0] for p in placed(spark, [{}, {}], 5)] == [0, 1]
    assert placed(spark, [{3: (2, 7), 1: (2, 1)}], 5) == [(1, 1, 3)]  # of a tie, the first that got a vote
    assert placed(spark, [{6: (5, 0), 7: (1, 1), 9: (4, 2)}, {10: (3, 0), 2: (3, 1)}, {8: (1, 0)}], 12) == [(6, 6, 9), (10, 6, 10), (10, 8, 10)]
    u = spark.createDataFrame([("d", 0, 0), ("d", 0, 2), ("d", 3, 3)], "doc string, lo int, hi int")
    assert [(x["lo"], x["hi"], x["n"]) for x in asr.merge_intervals(u, "doc", "lo", "hi").orderBy("unit").collect()] == [(0, 2, 2), (3, 3, 1)]


def pairs(spark, a, b):
    return spark.createDataFrame([(int(x == "X"), int(y == "X")) for x, y in zip(a, b, strict=True)], "a int, b int")


def long(spark, units):
    return spark.createDataFrame([(u, str(k), int(v == "X")) for u, vs in enumerate(units) for k, v in enumerate(vs)], "unit int, annotator string, value int")


def test_agreement_coefficients(spark):
    r = ag.pair_metrics(pairs(spark, "XXOO", "XOOO")).first()
    assert r["cohen_kappa"] == pytest.approx(0.5) and r["alpha"] == pytest.approx(8 / 15) and r["positive_dice"] == pytest.approx(2 / 3)
    units = list(zip("XXOO", "XOOO", strict=True))
    assert ag.krippendorff_alpha(long(spark, units)).first()["alpha"] == pytest.approx(8 / 15)
    assert ag.fleiss_kappa(long(spark, units), 2).first()["kappa"] == pytest.approx(7 / 15)
    assert ag.krippendorff_alpha(long(spark, [("X",), ("X", "X")])).first()["alpha"] is None
    assert ag.pair_metrics(pairs(spark, "OO", "OO")).first()["cohen_kappa"] is None


def props(spark, rows):
    df = spark.createDataFrame([(k, "s", a, c, s, 8) for k, (a, c, s) in enumerate(rows)], "pid long, sentence_id string, annotator string, cue array<int>, scope array<int>, n_tokens int")
    g = an.groups_of(an.align_groups(df)).collect()
    return sorted((r["cue_indices"], r["sources"], r["alignment"]) for r in g)


def test_align_groups(spark):
    assert props(spark, [("A", [1], [2]), ("B", [1, 2], [3]), ("A", [5], [6])]) == [([1, 2], 2, "overlap_union"), ([5], 1, "exact")]
    assert props(spark, [("A", [1], [0]), ("A", [2], [0]), ("B", [1, 2], [0])]) == [([1], 1, "exact_only_ambiguous"), ([1, 2], 1, "exact_only_ambiguous"), ([2], 1, "exact_only_ambiguous")]


def test_posterior_and_latent_model(spark):
    m = {"prevalence": 0.2, "annotators": {"A": {"sensitivity": 0.8, "specificity": 0.9}, "B": {"sensitivity": 0.7, "specificity": 0.95}}}
    assert an.posterior({"A": 1, "B": 0}, m) == pytest.approx((0.2 * 0.8 * 0.3) / (0.2 * 0.8 * 0.3 + 0.8 * 0.1 * 0.95))
    fit = an.fit_latent({"A=1,B=1": 50, "A=0,B=0": 50, "A=1,B=0": 20, "A=0": 5}, ["A", "B"])
    assert fit["converged"] and fit["training_tokens"] == 120
    with pytest.raises(ValueError):
        an.fit_latent({"A=1": 3}, ["A"])
    with pytest.raises(ValueError):
        an.fit_latent({"A=1,B=1": 3}, ["A", "B"], strength=float("nan"))
    r = spark.createDataFrame([(1, 0, "A", 1), (1, 0, "B", 0), (1, 1, "A", 1), (1, 1, "B", 1), (2, 0, "A", 0)], "group_id int, tok int, annotator string, value int")
    d = {(x["group_id"], x["tok"]): x for x in an.decide_scopes(r, m).collect()}
    assert d[1, 0]["posterior"] == pytest.approx(an.posterior({"A": 1, "B": 0}, m)) and d[2, 0]["posterior"] is None and d[1, 1]["label"] == 1


def test_bad_spans_are_errors(spark):
    df = spark.createDataFrame([([{"i": 0, "start": 2, "end": 2}], ["ab"])], "e array<struct<i:int,start:int,end:int>>, t array<string>")
    with pytest.raises(Exception, match="span outside"):
        df.select(an.token_indices(F.col("e"), F.col("t"))).collect()


def test_quotas():
    assert sp.equal_quotas([2, 10, 10], 12) == [2, 5, 5]
    assert sum(sp.equal_quotas([3, 50, 50, 1], 40, np.random.default_rng(1))) == 40
    with pytest.raises(ValueError):
        sp.equal_quotas([1], 2)
    assert sp.role_quotas({"Interviewer": 5, "Interviewee": 45}, 20) == {"Interviewer": 5, "Interviewee": 15}
    assert sp.role_quotas({"Interviewer": 30, "Interviewee": 30}, 21) == {"Interviewer": 10, "Interviewee": 11}
    assert sp.adjust_to_total([5, 5, 5], [0, 0, 0], [9, 9, 9], 17) in ([7, 5, 5], [6, 6, 5])


def test_role_quota_columns_follow_the_rule(spark):
    rows = [(a, b, q) for a in (0, 1, 5, 13, 30) for b in (0, 2, 9, 30) for q in range(0, a + b + 1, 3) if q == 0 or q >= (a > 0) + (b > 0)]
    x, y = sp.role_quota_columns(F.col("a"), F.col("b"), F.col("q"))
    for r in spark.createDataFrame(rows, "a long, b long, q long").where("a + b > 0").select("a", "b", "q", x.alias("x"), y.alias("y")).collect():
        assert sp.role_quotas({"Interviewer": r["a"], "Interviewee": r["b"]}, r["q"]) == {"Interviewer": r["x"], "Interviewee": r["y"]}, r


def test_flow_takes_each_cluster_once():
    got, chosen = match_cells({"a": 2, "b": 1}, [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("a", 3)])
    assert got == 3 and len({c for _, c in chosen}) == 3


def test_shares_equal_the_rule_in_every_part(spark):
    rng = np.random.default_rng(3)
    parts = {p: ([int(x) for x in rng.integers(0, 12, rng.integers(1, 9))], int(rng.integers(0, 40))) for p in range(60)}
    df = spark.createDataFrame([(p, k, c, t) for p, (caps, t) in parts.items() for k, c in enumerate(caps)], "p int, k int, c long, t long")
    got: dict = {}
    for r in sp.shares(df, "c", F.col("t"), ["k"], ["p"]).orderBy("p", "k").collect():
        got.setdefault(r["p"], []).append(r["quota"])
    assert got == {p: sp.equal_quotas(caps, min(t, sum(caps))) for p, (caps, t) in parts.items()}


def test_shares_of_a_large_part_take_no_square(spark):
    """What a round gives is found with places and counts; a frame that ends with its part is gone through again for every row of it."""
    df = spark.range(3000).select(F.col("id").alias("k"), ((F.col("id") * 7919) % 23).alias("c"))
    out = sp.shares(df, "c", F.lit(20_011), ["k"])
    rows = out.orderBy("k").collect()
    assert [r["quota"] for r in rows] == sp.equal_quotas([r["c"] for r in rows], 20_011)
    assert "currentrow$(), unboundedfollowing$()" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_balanced_equals_the_rule(spark):
    rng = np.random.default_rng(5)
    for groups, relax in ((2, False), (3, True), (3, False)):
        rows = []
        for k in range(12):
            a, b = (int(x) for x in rng.integers(1, 40, 2))
            rows.append((k, f"g{k % groups}", ("test", "val", "train")[k // groups] if k // groups < 3 else "train", int(rng.integers(2 if not relax else (a + b) // 2, a + b + 1)), a, b))
        want = sp.balanced_role_quotas([{"group": g, "quota": q, "available": {"Interviewer": a, "Interviewee": b}, "split": s} for _, g, s, q, a, b in rows], 5)
        got = sp.balanced(spark.createDataFrame(rows, "interview_id int, interviewer_id string, split string, quota long, a long, b long"), 5).orderBy("interview_id").collect()
        assert [r["first"] for r in got] == want


def test_draw_falls_back_level_by_level(spark):
    def drawn(rows, quotas, **how):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, interview_id int, role string, position_stratum int, turn int, cluster string")
        return sp.draw(df, spark.createDataFrame([(1, r, q) for r, q in quotas.items()], "interview_id int, role string, quota long"), **how).collect()

    a, b = "Interviewer", "Interviewee"
    free = [(1, a, 1, t, f"c{t}") for t in range(4)]
    assert {r["level"] for r in drawn(free, {a: 4})} == {0}
    # two turns of one wording: a third turn of the stratum gives two
    assert {r["level"] for r in drawn([(1, a, 1, 0, "x"), (1, a, 1, 1, "x"), (1, a, 1, 2, "y"), (1, a, 1, 2, "z")], {a: 3})} == {1}
    # two strata of one wording: a third stratum does
    assert {r["level"] for r in drawn([(1, a, 1, 0, "x"), (1, a, 2, 1, "x"), (1, a, 3, 2, "y"), (1, a, 3, 2, "z")], {a: 3})} == {2}
    # a role that cannot meet its quota: the other role gives the rest, above the least
    got = drawn([(1, a, 1, 0, "x"), (1, a, 1, 1, "x"), (1, b, 1, 2, "y"), (1, b, 1, 3, "z"), (1, b, 1, 4, "v")], {a: 2, b: 2}, least=1)
    assert {r["level"] for r in got} == {3} and len(got) == 4 and sum(r["role"] == a for r in got) == 1
    with pytest.raises(ValueError, match="3 rows"):
        drawn([(1, a, 1, 0, "x"), (1, a, 1, 1, "x"), (1, a, 1, 2, "y")], {a: 3})
    assert len(drawn([(1, a, 1, 0, "x"), (1, a, 1, 1, "x"), (1, a, 1, 2, "y")], {a: 3}, strict=False)) == 2


def test_draw_is_a_maximum_matching(spark):
    """Against augmenting paths, one cluster at a time, over several connected parts."""
    rng = np.random.default_rng(11)
    rows = [(i, int(i // 20), "Interviewer", 1, 0, int(i // 40) * 100 + int(rng.integers(0, 14))) for i in range(120)]
    quota = {k: int(rng.integers(5, 12)) for k in range(6)}
    edges: dict = {}
    for _, iv, *_, c in rows:
        edges.setdefault(c, set()).add(iv)
    slots = [(iv, k) for iv, q in quota.items() for k in range(q)]
    held: dict = {}

    def place(c, seen):
        for s in slots:
            if s[0] in edges[c] and s not in seen:
                seen.add(s)
                if s not in held or place(held[s], seen):
                    held[s] = c
                    return True
        return False

    most = sum(place(c, set()) for c in sorted(edges))
    df = spark.createDataFrame(rows, "id long, interview_id int, role string, position_stratum int, turn int, cluster long")
    got = sp.draw(df, spark.createDataFrame([(iv, "Interviewer", q) for iv, q in quota.items()], "interview_id int, role string, quota long"), least=0, strict=False).collect()
    assert len(got) == most == len({r["cluster"] for r in got})
    assert all(sum(r["interview_id"] == iv for r in got) <= q for iv, q in quota.items())


def test_rebalance_levels_interviewers():
    row = lambda i, who, role, cl, pos=1, turn=None: {"id": i, "interview_id": who, "interviewer_id": who, "role": role, "position_stratum": pos, "turn": turn or i, "cluster": cl, "cluster_size": 1, "split": "train"}
    sample = [row(i, "x", "Interviewer", i) for i in range(6)] + [row(10 + i, "y", "Interviewee", 10 + i) for i in range(6)] + [row(20, "x", "Interviewee", 20), row(21, "y", "Interviewer", 21)]
    pool = sample + [row(30 + i, "x", "Interviewee", 30 + i) for i in range(4)] + [row(40 + i, "y", "Interviewer", 40 + i) for i in range(4)]
    out = sp.rebalance(sample, pool, least=1)
    count = {w: sum(r["role"] == "Interviewer" and r["interviewer_id"] == w for r in out) for w in "xy"}
    assert len(out) == len(sample) and abs(count["x"] - count["y"]) <= 1 and len({r["cluster"] for r in out}) == len(out)


def test_split_disjoint(spark):
    rows = [(1, "a", "train"), (2, "a", "test"), (3, "b", "train"), (4, "c", "val")]
    kept = sim.split_disjoint(spark.createDataFrame(rows, "id int, cluster string, split string"), {"train": 4, "val": 1, "test": 1}).collect()
    assert sorted(r["id"] for r in kept) == [2, 3, 4]


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected(links, spark.createDataFrame([(7,), (500,)], "node long")).collect()}
    assert got == {7: 1, 500: 500}


def test_kendall_and_impact(spark):
    r = spark.createDataFrame([("a", 1, 1), ("b", 2, 3), ("c", 3, 2)], "system string, a int, b int")
    assert mt.kendall_tau(r).first()["tau"] == pytest.approx(1 / 3)
    runs = spark.createDataFrame([(0.5,), (0.7,)], "f1 double")
    assert mt.aggregate_runs(runs, ["f1"]).first()["std"] == pytest.approx(0.1414213, abs=1e-6)


def test_resampling_by_the_generator(spark):
    d = mt.resamples(spark, [1, 2, 3], 50, 42)
    assert d.groupBy("rep").agg(F.sum("mult").alias("m")).where("m <> 3").count() == 0
    facts = spark.createDataFrame([("s", 1, 1, 10), ("s", 2, 2, 10), ("s", 3, 9, 10)], "system string, key long, num int, den int")
    r = mt.ratio_interval(facts, d, 50).first()
    assert 0.1 <= r["lo"] <= r["hi"] <= 0.9

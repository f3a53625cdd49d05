"""Operators without SQL against plain Python, and writers by what they leave behind."""

import itertools
import json
import random
import sqlite3
import struct
import wave
from difflib import SequenceMatcher

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions import arrow
from parley.operators import asr, evaluation, reports
from parley.operators import similarity as sim
from parley.sources import files, sinks, stores


def test_near_links_equal_all_pairs(spark):
    rng = random.Random(12)
    words = [f"w{k:02}" for k in range(30)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 16))) for _ in range(25)]
    texts = list(base)
    for b in base:
        w = b.split()
        texts += [" ".join([*w[:-1], rng.choice(words)]), " ".join([*w, "so"]), " ".join(w[:3] + ["x"] + w[3:]), b.upper()]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    first: dict = {}
    for k, t in enumerate(texts):
        first.setdefault(t.lower(), k)
    grams = {f: {tuple(f.split()[i : i + 3]) for i in range(len(f.split()) - 2)} for f in first}
    want = {}
    for f, g in itertools.combinations(first, 2):
        if min(len(f.split()), len(g.split())) >= 6 and grams[f] & grams[g]:
            a, b = sorted((first[f], first[g]))
            x, y = (f, g) if first[f] == a else (g, f)
            if (r := SequenceMatcher(None, x, y, autojunk=False).ratio()) >= 0.92:
                want[a, b] = r
    for common in (1000, 3, 0):  # no trigram, some, and all of them meet by their rarest runs of characters
        got = {(r["a"], r["b"]): r["ratio"] for r in sim.near_links(df, common=common).collect()}
        assert len(want) > 20 and got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())


def test_lines_that_thousands_vary_meet_in_small_groups(spark):
    """A fixed sentence with two free words: the runs by which its forms meet grow with the forms, their pairs do not with the square."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("bcdfghjklmnpqrstvwxz") + rng.choice("aeiou") for _ in range(8))

    def keys(n):
        rows = [(i, f"thank you for calling the office of {word()} {word()}") for i in range(n)]
        f = spark.createDataFrame(rows, "id long, form string")
        tokens = sim._prefixes(f, 0.92, 3).groupBy("token").count()
        return tokens.agg(F.sum("count"), F.sum(F.col("count") * F.col("count"))).first()

    (rows, pairs), (more_rows, more_pairs) = keys(200), keys(800)
    assert 3.9 < more_rows / rows < 4.1 and more_pairs < 0.25 * 800 * 800 * 20


def test_similar_sets_equal_all_pairs(spark):
    rng = random.Random(5)
    sets = [{rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 9))} | {"common"} for _ in range(90)] + [set(), {"common"}, {"common"}]
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id long, g array<string>")
    for percent in (50, 80, 100):
        want = {(i, j): (len(a & b), len(a), len(b)) for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2) if a and 100 * len(a & b) >= percent * len(a | b)}
        assert {(r["a"], r["b"]): tuple(r)[2:] for r in sim.similar_sets(df, percent).collect()} == want and want
    assert sim.similar_sets(df.limit(0), 50).count() == 0


def test_pairs_meet_without_a_shuffle_of_pairs(spark, monkeypatch):
    rng = random.Random(6)
    texts = [[rng.choice("abcd") for _ in range(rng.randint(5, 12))] + ["x", "y", "z"] * (i % 2) for i in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, toks array<string>")
    grams = [{tuple(t[i : i + 3]) for i in range(len(t) - 2)} if len(t) >= 6 else set() for t in texts]
    want = {(i, j): (len(a & b), len(a), len(b)) for (i, a), (j, b) in itertools.combinations(enumerate(grams), 2) if a & b}
    for block, chunk in ((sim.BLOCK, sim.CHUNK), (100, 50)):
        monkeypatch.setattr(sim, "BLOCK", block)
        monkeypatch.setattr(sim, "CHUNK", chunk)
        out = sim.candidates(df)
        rows = out.collect()
        assert {(r["a"], r["b"]): tuple(r)[2:] for r in rows} == want and len(rows) == len(want)
    plan = sim.candidates(df)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(a" not in plan and "hashpartitioning(cell" in plan


def test_sets_are_shuffled_as_kinds_of_shared_elements(spark):
    """What only one set has is not compared, and what the same sets have is one entry with a weight."""
    sets = [["p", "q", "r"] + [f"own{i}-{k}" for k in range(i)] for i in range(1, 6)]
    flat = spark.createDataFrame([(i, len(s), g) for i, s in enumerate(sets) for g in s], "id long, n int, gram string")
    assert {(r["id"], r["n"], len(r["x"]), tuple(r["w"])) for r in sim._kinds(flat).collect()} == {(i, len(s), 1, (3,)) for i, s in enumerate(sets)}


def test_cluster_ids_follow_the_members(spark):
    rows = [(1, "a", "r", 0, "eins zwei drei"), (2, "b", "r", 0, "eins zwei drei"), (3, "a", "r", 1, "vier fünf sechs")]
    df = spark.createDataFrame(rows, "id long, interview_id string, role string, sentence_index long, text string")
    ids = lambda d, links: {r["id"]: (r["similarity_cluster_id"], r["similarity_cluster_size"], r["similarity_cluster_interview_count"]) for r in sim.clusters(d, spark.createDataFrame(links, "a long, b long")).collect()}
    apart, joined = ids(df, []), ids(df.repartition(3), [(1, 3)])
    assert apart[1] == apart[2] != apart[3] and apart[1][1:] == (2, 2) and joined[1] == joined[2] == joined[3] and joined[1][1:] == (3, 2)
    assert joined[1][0] not in {apart[1][0], apart[3][0]} and len(joined[1][0]) == 24
    assert ids(df.orderBy(F.desc("id")), []) == apart


def aligned(spark, pairs):
    rows = [("s", f"d{k}", r.split(), h.split()) for k, (r, h) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "system string, doc string, ref_normalized array<string>, hyp_normalized array<string>")
    return df.withColumn("chunks_normalized", arrow.word_chunks("ref_normalized", "hyp_normalized"))


def test_reference_tokens_and_hypothesis_lines(spark):
    al = aligned(spark, [("a b c d e f", "a x c e f g h"), ("a b", "a q r b")])
    lines = al.select("doc", F.posexplode("ref_normalized").alias("pos", "w")).select("doc", "pos", F.floor(F.col("pos") / 3).cast("long").alias("line"))
    got = {(r["doc"], r["pos"]): (r["word"], r["op"], r["alt"], r["line"]) for r in asr.reference_tokens(al, lines).collect()}
    assert got["d0", 1] == ("b", "substitute", "x", 0) and got["d0", 3] == ("d", "delete", None, 1) and got["d0", 4] == ("e", "equal", "=", 1) and len(got) == 8
    by = {(r["doc"], r["line"]): r["words"] for r in asr.hypothesis_by_line(al, lines).collect()}
    assert by == {("d0", 0): "a x c", ("d0", 1): "e f g h", ("d1", 0): "a q r b"}


def test_inserted_passages(spark):
    al = aligned(spark, [("a b c d e f", "a b c d e f a b c d e f"), ("a b", "a v w x y z b"), ("a b", "a x y b")])
    got = {r["doc"]: (r["phrase"], r["loop"]) for r in asr.inserted_passages(al).collect()}
    assert got == {"d0": ("a b c d e f", True), "d1": ("v w x y z", False)}


def test_normalisers(spark):
    pairs = spark.createDataFrame([("s", "Ähm, ich hab 3 Skype-Calls [lacht].", "ich habe drei skype calls"), ("t", "Ja.", "ja")], "system string, ref_text string, hyp_text string")
    got = {(r["system"], r["norm"]): (r["errors"], r["words"]) for r in asr.norm_rates(pairs).collect()}
    assert got["s", "ours"] == (0, 5) and got["s", "raw"] == (5, 6) and got["s", "ours_numbers"] == (1, 5) and got["s", "ours_spelling"] == (1, 5)
    assert got["s", "board"] == (2, 6) and got["s", "board_without_fillers"] == (1, 5) and got["s", "ours_tags"] == (1, 6) and got["t", "raw"] == (1, 1) and got["t", "plain"] == (0, 1)
    assert {r["norm"]: r["tau"] for r in asr.norm_agreement(spark.createDataFrame([("a", "x", 1.0), ("b", "x", 2.0), ("c", "x", 3.0), ("a", "ours", 1.0), ("b", "ours", 3.0), ("c", "ours", 2.0)], "system string, norm string, wer double")).collect()} == {"x": pytest.approx(1 / 3), "ours": 1.0}


def marker(words):
    return arrow.scorer(lambda rows: [[int(t in words) for t in ts] for ts in rows], T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))


def test_chained_models(spark):
    b = spark.createDataFrame([(["ich", "will", "nicht", "gehen"],), ([],)], "tokens array<string>")
    after = arrow.scorer(lambda rows: [[int("[CUE]" in ts[:i]) for i in range(len(ts))] for ts in rows], T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))
    for replace in (True, False):
        got = evaluation.chained(b, marker({"nicht"}), after, "[CUE]", replace).collect()
        assert [(r["pred_cues"], r["pred_scopes"]) for r in got] == [([0, 0, 1, 0], [0, 0, 0, 1]), ([], [])]
    short = evaluation.chained(b, marker({"nicht"}), arrow.scorer(lambda rows: [[1] * min(len(ts), 2) for ts in rows], T.ArrayType(T.IntegerType()), pa.list_(pa.int32())), "[CUE]")
    assert [r["pred_scopes"] for r in short.collect()] == [[1, 1, 0, 0], []]


def test_evaluation_pieces(spark):
    blocks = spark.createDataFrame([("1", "s1", ["a", "b", "c"], [0, 1, 0], [1, 1, 0], "train"), ("2", "s2", ["d"], [1], [0], "test")], "block_id string, sentence_id string, tokens array<string>, cue_masks array<int>, scope_masks array<int>, split string")
    preds = spark.createDataFrame([("m_s1", "1", [1, 0]), ("m_s2", "1", [1, 0, 0]), ("m_s1", "2", [0]), ("m_s2", "2", [1])], "model string, block_id string, pred array<int>")
    rows = evaluation.judged(blocks, preds, "scope")
    s = {r["model"]: (r["tp"], r["fp"], r["fn"], r["exact_match"], r["truncated_blocks"]) for r in evaluation.scores(rows).collect()}
    assert s == {"m_s1": (1, 0, 0, 1.0, 1), "m_s2": (1, 1, 0, 0.5, 0)}
    c = evaluation.comparison(evaluation.scores(rows)).first()
    assert (c["model"], c["n"], c["truncated_blocks"], c["exact_match_mean"]) == ("m", 2, 1, 0.75) and c["exact_match_std"] == pytest.approx(0.353553, abs=1e-5)
    fit, counts = evaluation.fitting(blocks, 2)
    assert [r["block_id"] for r in fit.collect()] == ["2"] and {r["split"]: r["truncated"] for r in counts.collect()} == {"train": 1, "test": 0}
    w = spark.createDataFrame([([None, 0, 0, 1, None], [5, 6])], "w array<int>, l array<int>")
    assert w.select(evaluation.subword_labels(F.col("w"), F.col("l"))).first()[0] == [-100, 5, -100, 6, -100]
    assert evaluation.unique_paths(["a/b", "c", "a//b/", "./c"]) == ["a/b", "c"]
    assert blocks.select(evaluation.inputs("scope", "[CUE]").alias("x")).collect()[0]["x"] == ["a", "[CUE]", "c"]


def test_evaluation_files(spark, tmp_path):
    blocks = spark.createDataFrame([("1", "s1", ["a", "b"], [0, 1], [1, 1])], "block_id string, sentence_id string, tokens array<string>, cue_masks array<int>, scope_masks array<int>")
    rows = evaluation.judged(blocks, spark.createDataFrame([("m", "1", [1, 1])], "model string, block_id string, pred array<int>"), "scope")
    scored = evaluation.scores(rows)
    sinks.write_evaluation(rows, scored, evaluation.comparison(scored), str(tmp_path / "e"), "scope")
    text = "".join(p.read_text() for p in (tmp_path / "e" / "predictions" / "model=m").glob("part-*"))
    assert text == "# sentence_id = s1\na\tO\tX\tX\nb\tX\tO\tX\n\n"
    assert spark.read.json(str(tmp_path / "e" / "metrics")).first()["fp"] == 1 and spark.read.option("header", True).csv(str(tmp_path / "e" / "comparison_csv")).first()["n"] == "1"


def test_views_by_split_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("train", 1), ("test", 2), ("test", 3)], "split string, x int")
    sinks.write_by_split({"t": df}, str(tmp_path / "v"))
    assert spark.read.json(str(tmp_path / "v" / "t" / "all")).count() == 3 and sorted(r["x"] for r in spark.read.json(str(tmp_path / "v" / "t" / "by_split" / "part=test")).collect()) == [2, 3]
    sinks.write_json({"b": 1, "a": ["ä"]}, spark, str(tmp_path / "r"))
    assert json.loads("\n".join(r[0] for r in spark.read.text(str(tmp_path / "r")).collect())) == {"a": ["ä"], "b": 1}
    sinks.write_asr({"summary": df}, str(tmp_path / "asr"))
    assert spark.read.option("header", True).csv(str(tmp_path / "asr" / "summary")).count() == 3
    assert sinks.rebuild(df, str(tmp_path / "ds")).count() == 3 and sinks.rebuild(df.limit(1), str(tmp_path / "ds")).count() == 1
    sample = df.withColumn("presentation_order", F.col("x")).withColumn("tags", F.array("split"))
    sinks.write_sample(sample, str(tmp_path / "s"), ["x", "split", "tags", "absent"], ["x"], df, {"n": 3})
    assert spark.read.option("header", True).csv(str(tmp_path / "s" / "sample")).columns == ["x", "split", "tags", "absent"]
    assert [r["x"] for r in spark.read.option("header", True).csv(str(tmp_path / "s" / "blinded")).collect()] == ["1", "2", "3"]
    assert sinks.latex(df.orderBy("x").limit(1)).splitlines()[1:3] == ["split & x \\\\", "train & 1 \\\\"]


def test_corpus_reports(spark):
    rows = [(i, "i1", "v1", "Interviewer" if i % 2 else "Interviewee", f"c{i // 2}", i) for i in range(6)]
    pool = spark.createDataFrame(rows, "id int, interview_id string, interviewer_id string, role string, cluster string, turn int")
    sample = pool.where("id < 3").withColumn("split", F.lit("test")).withColumn("double_annotate", F.col("id") == 0).withColumn("cross_turn_sentence", F.lit(False))
    assert {(r["role"], r["speaker"], r["available"], r["sampled"]) for r in reports.speakers(pool, sample).collect()} == {("Interviewer", "v1", 3, 1), ("Interviewee", "i1", 3, 2)}
    s = reports.corpus_summary(pool, sample).first()
    assert (s["available_sentences"], s["clusters"], s["redundant_sentences"], s["sampled_test"], s["double_annotated"], s["sampled_share"]) == (6, 3, 3, 3, 1, 0.5)
    assert {(r["role"], r["n_turns"]) for r in reports.role_turns(pool.limit(0), pool).collect()} == {("Interviewer", 6), ("Interviewee", 5)}
    a = spark.createDataFrame([("x", 0.2), ("y", 0.1)], "system string, wer double")
    assert [(r["system"], r["semdist"]) for r in reports.with_semantics(a, spark.createDataFrame([("x", 0.5)], "system string, semdist double")).collect()] == [("y", None), ("x", 0.5)]
    assert [r["line"] for r in reports.worst_first(spark.createDataFrame([("d", 1, 0.5), ("d", 2, None), ("d", 3, 0.1)], "doc string, line int, score double")).collect()] == [2, 3, 1]


def test_word_lists_of_a_store(spark, tmp_path):
    path = str(tmp_path / "w.sqlite")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE documents (id TEXT, eid TEXT, role TEXT, words_json TEXT)")
        db.execute("INSERT INTO documents VALUES ('1', 'e', 'r', ?)", (json.dumps([{"word": "a", "start": 0.5, "end": 1.0}, {"word": "b"}]),))
    assert [(r["pos"], r["word"], r["start"]) for r in stores.timed_words(spark, path).orderBy("pos").collect()] == [(0, "a", 0.5), (1, "b", None)]


def test_files_and_plans(spark, tmp_path):
    for name, n in (("a", 8000), ("b", 16000)):
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as w:
            w.setnchannels(1), w.setsampwidth(2), w.setframerate(16000)
            w.writeframes(struct.pack("<h", -32768) * n)
    got = {r["doc"]: (r["rate"], r["hours"]) for r in files.read_audio(spark, str(tmp_path)).collect()}
    assert got == {"a": (16000, pytest.approx(0.5 / 3600)), "b": (16000, pytest.approx(1 / 3600))}
    audio = spark.read.format("binaryFile").load(str(tmp_path / "a.wav")).select(files.wav_samples("content").alias("x")).first()["x"]
    assert len(audio) == 8000 and audio[0] == -1.0
    one, two = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c")], "k int, v string")
    assert sorted(map(tuple, files.with_override(one, two, "k").collect())) == [(1, "a"), (2, "c")] and [r["k"] for r in files.todo(one, two, "k").collect()] == [1]
    docs = [{"doc": f"d{k}", "eid": k % 3, "annotator": "AB"[k % 2]} for k in range(6)]
    plan = asr.double_correction(docs, 3)
    assert len({d["eid"] for d in plan}) == 3 and {d["annotator"] for d in plan} == {"A", "B"} and plan == asr.double_correction(docs[::-1], 3)


def test_what_is_dear_is_computed_once_and_after_the_rows_are_dealt(spark):
    from parley.functions import german, issues
    from parley.operators import asr
    from parley.plans import speech

    lines = spark.createDataFrame([(k, ["das", "ist", "nicht", "gut", w]) for w in "ab" for k in (9, 3, 7)], "line long, tokens array<string>").repartition(3)
    assert [r["line"] for r in asr.blind_spot(lines).collect()] == [3, 3]  # of equal lines the least
    plan = speech.blind_spot(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("REPARTITION_BY_NUM") :]
    assert "regexp_extract_all" not in below
    assert spark.range(5).select(german.let(F.rand(), lambda x: x == x).alias("same")).where("same").count() == 5
    said = spark.createDataFrame([("m_m mhm m[x]h HM! hm-hm ge- 3m z. B. 1.000 s okay",), (None,), ("",)], "t string")
    assert [r[0] for r in said.select(german.tokens(F.col("t"), "verbatim")).collect()] == ["<fil> <fil> <fil> <fil> h <fil> <fil> <fil> ge drei <fil> zum beispiel tausend s ok".split(), [], []]
    told = issues._told(F.array(*map(F.lit, ("3", "hab", "ich"))), F.array(*map(F.lit, ("", " ", " ", ""))))
    assert [x["suggestion"] for x in spark.range(1).select(told).first()[0]] == ["Drei", "habe", None]


def test_entities_of_both_sides_take_one_sort(spark):
    from parley.operators import metrics as mt

    rows = [(1, k, g, p) for k, (g, p) in enumerate(zip("O B-X I-X O B-Y B-Y E-Y X X".split(), "O B-X I-X I-X B-Y I-Y I-Y X X".split(), strict=True))] + [(2, 0, "X", "O"), (3, 0, None, "Y")]
    out = mt.entity_scores(spark.createDataFrame(rows, "doc long, pos int, gold string, pred string"), ["doc"])
    assert {r["type"]: (r["tp"], r["predicted"], r["gold"]) for r in out.collect()} == {"X": (1, 2, 3), "Y": (0, 2, 2), "all": (1, 4, 5)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Window [") <= 2 and "Union" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_sentences_are_cut_once(spark):
    from parley.plans import dialogue

    plan = dialogue.sentence_segments(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "sentences_of" not in plan


def test_cluster_members_are_not_written_with_their_forms(spark, monkeypatch):
    written = []
    keep = sim.materialize
    monkeypatch.setattr(sim, "materialize", lambda df, tag: written.append(df.columns) or keep(df, tag))
    rows = spark.createDataFrame([(1, "a", "r", 0, "Gut so."), (2, "b", "r", 0, "gut so"), (3, "a", "r", 1, "Nein.")], "id long, interview_id string, role string, sentence_index int, text string")
    out = sim.clusters(rows, spark.createDataFrame([], "a long, b long"))
    assert {(r["id"], r["component"], r["similarity_cluster_size"]) for r in out.collect()} == {(1, 1, 2), (2, 1, 2), (3, 3, 1)}
    assert written and not any("form" in c for c in written)

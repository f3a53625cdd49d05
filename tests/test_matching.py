"""Matching on tables against the flow solver, on graphs of many kinds at once."""

import random

from pyspark.sql import functions as F

from parley.operators import matching
from parley.operators import sampling as sp
from parley.plans import dedup
from parley.shared import materialize
from tests.flow import match_cells


def graphs():
    """name -> (limits, edges): random ones, sparse and dense, a long path, a hub cell, a hub cluster, one where greed loses."""
    rng = random.Random(4)
    out = {}
    for g in range(24):
        cells, clusters, n = rng.randint(1, 12), rng.randint(1, 25), rng.choice((8, 30, 80))
        out[f"random {g}"] = ({c: rng.randint(0, 4) for c in range(cells)}, {(rng.randrange(cells), rng.randrange(clusters)) for _ in range(n)})
    out["path"] = ({c: 1 for c in range(9)}, {(c, k) for c in range(9) for k in (c, c + 1) if k < 9})
    out["two a piece"] = ({c: 2 for c in range(8)}, {(c, (2 * c + k) % 13) for c in range(8) for k in range(4)})
    out["hub cell"] = ({0: 50, 1: 3, 2: 4}, {(0, k) for k in range(120)} | {(1, k) for k in range(3)} | {(2, k) for k in range(2, 6)})
    out["hub cluster"] = ({c: 1 for c in range(40)}, {(c, 0) for c in range(40)} | {(c, c) for c in range(1, 20)} | {(c, c - 1) for c in range(1, 40, 3)})
    return out


def test_match_is_as_large_as_the_flow(spark):
    every = graphs()
    rows = [(f"{g}/{c}", limits[c], f"{g}/{k}") for g, (limits, edges) in every.items() for c, k in sorted(edges)]
    edges = spark.createDataFrame([*rows, *rows[:50], (None, 3, "x"), ("random 0/0", 2, None)], "cell string, limit int, cluster string")
    got = [(r["cell"], r["cluster"]) for r in matching.match(edges).collect()]
    assert set(got) <= {(a, k) for a, _, k in rows} and len({k for _, k in got}) == len(got)
    for g, (limits, own) in every.items():
        want, _ = match_cells(limits, sorted(own))
        mine = [c for c, _ in got if c.split("/")[0] == g]
        assert len(mine) == want, g
        assert all(mine.count(f"{g}/{c}") <= n for c, n in limits.items()), g
    lacking = {r["cell"]: (r["limit"], r["matched"], r["lacking"]) for r in matching.shortfall(edges, spark.createDataFrame(got, "cell string, cluster string")).collect()}
    assert all(n == m + x and x >= 0 for n, m, x in lacking.values()) and lacking["path/3"] == (1, 1, 0)
    assert matching.match(edges.limit(0)).count() == 0


def test_crowded_cells_and_long_ways(spark):
    """Cells above the bound of a window, and a chain along which every cluster has to move on."""
    rows = [("hub", 700, k) for k in range(900)] + [(f"own {k}", 2, k) for k in range(0, 900, 3)]
    rows += [(f"chain {i}", 1, 2000 + k) for i in range(6) for k in ((i, i + 1) if i < 5 else (i,))]
    df = spark.createDataFrame(rows, "cell string, limit int, cluster int")
    got = [(r["cell"], r["cluster"]) for r in matching.match(df, crowd=100).collect()]
    assert len({k for _, k in got}) == len(got) == 900 + 6 and 600 <= sum(c == "hub" for c, _ in got) <= 700


def test_firsts_of_a_crowded_key(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2500, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("k"), F.hash("id").alias("o"), F.lit(60).alias("l"), F.when(F.col("id") < 2500, 2500).otherwise(100).alias("n"))
    by = {}
    for r in rows.collect():
        by.setdefault(r["k"], []).append(r["o"])
    for crowd in (50, 1000, 10_000):
        got = matching.firsts(rows, "k", "o", "l", "n", crowd).collect()
        assert {k: sorted(r["o"] for r in got if r["k"] == k) for k in by} == {k: sorted(v)[:60] for k, v in by.items()}


def moved(spark) -> int:
    """Bytes shuffled, spilled and written by all stages so far."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    return sum(s.shuffleWriteBytes() + s.diskBytesSpilled() + s.outputBytes() for s in (stages.apply(i) for i in range(stages.size())))


def test_long_clusters_are_not_shuffled_and_surplus_edges_end_early(spark):
    """Cells that could take far more clusters than all cells together ask for: texts stay where they are, and the rounds see few edges."""
    text = F.concat_ws(" ", *(F.sha2(F.concat_ws("|", F.lit(k), F.col("c").cast("string")), 256) for k in range(10)))
    edges = materialize(spark.range(12_000).select(F.concat(F.lit("cell "), (F.col("id") % 3).cast("string")).alias("cell"), F.lit(4).alias("limit"), F.floor(F.col("id") / 2).alias("c")).select("cell", "limit", text.alias("cluster")), "edges")
    before = moved(spark)
    got = [(r["cell"], r["cluster"]) for r in matching.match(edges).collect()]
    assert len(got) == 12 == len(set(k for _, k in got)) and {c: sum(x == c for x, _ in got) for c, _ in got} == {f"cell {k}": 4 for k in range(3)}
    assert moved(spark) - before < 6000 * 649 / 2  # half of the clusters' texts, once


def test_nearest_edges_give_the_same_matching(spark, monkeypatch):
    """Ordered by degree and hash, the edges beyond what all cells can hold change nothing."""
    rng = random.Random(8)
    rows = [(f"c{c}", n, f"k{k}") for c, (n, of) in enumerate([(3, 900), (5, 1500), (2, 30), (4, 6), (6, 5), (1, 700)]) for k in {rng.randrange(of) for _ in range(of)}]
    df = spark.createDataFrame(rows, "cell string, limit int, cluster string")
    few = sorted(map(tuple, matching.match(df).collect()))
    monkeypatch.setattr(matching, "_nearest", lambda edges, cells: edges)
    assert few == sorted(map(tuple, matching.match(df).collect())) and len(few) == 17  # 11 of the large cells, 6 clusters of the two small ones


def test_metadata_fetches_the_texts_it_needs(spark):
    """Turns in order by number alone: of 300 long turns the sample's and their neighbours' are fetched; texts may be a table of their own."""
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(200)), lambda k: F.sha2(F.concat_ws("|", "id", k.cast("string")), 256)))
    turns = spark.range(300).select(F.lit(1).alias("interview_id"), F.col("id").alias("turn_idx"), F.when(F.col("id") % 2 == 0, "Interviewer").otherwise("Interviewee").alias("role"), words.alias("text"), F.array(F.col("id").cast("string")).alias("source_turn_ids"), F.array().cast("array<string>").alias("chunk_ids"))
    turns = materialize(turns, "turns")
    rows = [(7, 1, 9, "Interviewer", 0, [0, 2], "Eins."), (8, 1, 9, "Interviewee", 1, [299], "Zwei.")]
    sample = spark.createDataFrame(rows, "id long, interview_id int, interviewer_id int, role string, sentence_index long, source_turns array<long>, text string")
    before = moved(spark)
    got = {r["id"]: r for r in sp.metadata(sample, turns).collect()}
    assert moved(spark) - before < 300 * 12_999 / 4
    text = {r["turn_idx"]: r["text"] for r in turns.select("turn_idx", "text").collect()}
    assert [got[7][c] for c in ("previous_turn_text", "following_turn_text", "source_turn_text")] == [None, text[3], f"{text[0]} {text[2]}"]
    assert [(x["role"], x["text"]) for x in got[7]["intervening_turns"]] == [("Interviewee", text[1])]
    assert [got[8][c] for c in ("previous_turn_text", "following_turn_text", "source_turn_text")] == [text[298], None, text[299]]
    apart = sp.metadata(sample, turns.drop("text"), texts=turns.select("interview_id", "turn_idx", "text"))
    assert {r["id"]: r for r in apart.collect()} == got


def test_sentences_are_written_once_and_the_sample_gets_their_texts(spark, tmp_path):
    """Of 2400 long lines the wording alone is written; a sample's texts are cut from the documents by id, whole and as they stand there."""
    line = F.concat(F.lit("Satz"), *(F.concat(F.lit(", "), F.sha2(F.concat_ws("|", F.lit(k), "id", "n"), 256)) for k in range(10)), F.lit("."))
    rows = spark.range(24).select("id", F.explode(F.sequence(F.lit(1), F.lit(100))).alias("n")).groupBy("id").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("text"))
    rows.select(F.col("id").alias("doc_id"), F.concat("text", F.lit("\nohne Satz\nNa gut, ja.")).alias("text"), F.concat(F.lit("src"), (F.col("id") % 2).cast("string")).alias("source")).write.parquet(f"{tmp_path}/documents.parquet")
    before = moved(spark)
    s, iv, t, texts, lines = dedup.run_inputs(spark, str(tmp_path))
    assert moved(spark) - before < 24 * 100 * 660 * 1.6
    assert s.count() == 24 * 101 and "text" not in s.columns and iv.count() == 2
    out, _, _ = sp.sample_run(s, iv, t, 30, least=2, strict=False, texts=texts, lines=lines)
    got = {r["id"]: r for r in out.collect()}
    text = {r["doc_id"]: r["text"].split("\n") for r in texts.collect()}
    assert len(got) == 30 and all(r["text"] == text[k // 1_000_000][k % 1_000_000] for k, r in got.items())
    whole, _, _ = sp.sample_run(s.join(lines, "id"), iv, t, 30, least=2, strict=False, texts=texts)
    assert {r["id"]: r.asDict() for r in whole.collect()} == {k: r.asDict() for k, r in got.items()}

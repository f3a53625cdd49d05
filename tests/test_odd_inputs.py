"""Queries against their SQL on inputs that the test tables lack, and the work that some steps may do."""

from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from parley.functions import arrow
from parley.operators import asr


def agree(spark, folder, name, **tables):
    """The query and its SQL give the same rows on these tables."""
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t, df in tables.items():
        df.write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    ours = sorted(map(repr, map(tuple, entry.queries()[name](spark, str(folder)).collect())))
    assert ours == sorted(map(repr, con.execute(entry.oracle_sql()[name]).fetchall()))
    return ours


def events(spark, stamps):
    rows = [(k, t, k % 2, "view", float(k % 4)) for k, t in enumerate(stamps)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")


@pytest.mark.parametrize("query", ["interval_units", "coverage_windows"])
def test_times_before_1970_and_missing_ones(spark, tmp_path, query):
    old = [datetime(1954, 1, 1, 0, 30) + timedelta(hours=3 * k) for k in range(40)]
    new = [datetime(2024, 1, 1, 0, 30) + timedelta(hours=3 * k) for k in range(40)]
    agree(spark, tmp_path, query, events=events(spark, [*old, None, None, None, *new, None]))


def test_word_errors_of_missing_turns_and_odd_letters(spark, tmp_path):
    said = ["cafe\u0301 und tee. x\u00b2 und y", "a\u200db c. a b c", "ja. nein doch", "drei \u2167 vier. ende"]
    rows = [(c, None if c % 3 == 0 and k == 1 else k, ("user", "assistant")[k % 2], said[(c + k) % 4]) for c in range(6) for k in range(4)]
    agree(spark, tmp_path, "wer_by_role", conversations=spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))


def test_short_tables_are_kept_by_columns(monkeypatch):
    """A line's alignment is some operations a word; the band by rows is left to long texts. Both give the same runs."""
    ref = [f"w{k * k % 13}" for k in range(90)]
    hyp = [x for k, x in enumerate(ref) if k % 7 != 6 for x in ([x, x] if k % 5 == 4 else [x])]
    monkeypatch.setattr(arrow, "_WHOLE", 0)
    by_rows, far = arrow.edit_ops(ref, hyp), arrow.words_apart(ref, hyp)
    monkeypatch.undo()
    monkeypatch.setattr(arrow, "_planes", None)
    assert arrow.edit_ops(ref, hyp) == by_rows
    assert arrow.words_apart(ref, hyp) == far == sum(max(b - a, d - c) for op, a, b, c, d in by_rows if op != "equal")


def test_one_file_of_transcripts_is_spread(spark, tmp_path):
    from parley.plans import fixtures as fx

    rows = [(c, 0, "user", "Eins zwei drei.\nVier fünf.") for c in range(50)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    at = fx.transcripts(spark, str(tmp_path)).select(F.spark_partition_id().alias("p")).distinct().count()
    assert at >= spark.sparkContext.defaultParallelism


def test_capitals_are_scored_as_they_are_written(spark):
    """lower(upper(x)) is no lower(x): a system that writes ß as SS has another word."""
    text = spark.createDataFrame([("der fuß",)], "ref_text string")
    pairs = text.select(F.lit("upper").alias("system"), "ref_text", F.upper("ref_text").alias("hyp_text"))
    assert {(r["norm"], r["errors"]) for r in asr.norm_rates(pairs, names=["raw", "ours"]).collect()} == {("raw", 1), ("ours", 1)}


def test_long_forms_meet_the_ratio_without_the_square_of_their_length(monkeypatch):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(5)
    for k in range(200):
        a = "".join(rng.choice("abcd ") for _ in range(rng.randrange(60)))
        b = "".join(c for c in a if rng.random() > 0.1) if k % 2 else "".join(rng.choice("abcd ") for _ in range(rng.randrange(60)))
        monkeypatch.setattr(arrow, "_LONG", 1)
        ratio = SequenceMatcher(None, a, b, autojunk=False).ratio()
        assert arrow.matching_ratio(a, b) == ratio
        assert ratio < 0.8 or arrow.able_to_match(a, b, 0.8)
    monkeypatch.setattr(arrow, "SequenceMatcher", None)  # a long pair goes without difflib's table
    monkeypatch.setattr(arrow, "_LONG", 1)
    a = "".join(rng.choice("abcdefghijklmnop ") for _ in range(20_000))
    assert arrow.matching_ratio(a, a[:9_000] + a[9_010:]) == 2 * 19_990 / 39_990
    assert not arrow.able_to_match(a, a[::-1], 0.92)


def test_pairs_that_cannot_reach_the_ratio_leave_no_cell(spark):
    """A fixed phrase in lines of other words: all of them share a trigram, and none is a pair to be compared."""
    import random

    from parley.operators import similarity as sim

    rng = random.Random(3)
    say = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    rows = [(i, f"wie schon gesagt {say()} {say()} {say()} {say()}") for i in range(60)]
    rows += [(100 + i, t[:-1] + "ä") for i, t in rows[:5]]
    f = spark.createDataFrame(rows, "id long, form string")
    grams = f.select("id", F.length("form").alias("n"), F.explode(sim.ngrams(F.split("form", " "), 3)).alias("gram"))
    sets = sim._kinds(grams).join(f.select("id", arrow.character_counts("form").alias("bag")), "id")
    met = {(r["a"], r["b"]) for r in sim._cells(sets, threshold=0.92).collect()}
    assert {(i, 100 + i) for i in range(5)} <= met and len(met) < 40
    assert {(r["a"], r["b"]) for r in sim.near_links(f.withColumnRenamed("form", "text")).collect()} == {(i, 100 + i) for i in range(5)}


def test_equal_pairs_are_scored_once(spark, monkeypatch):
    from parley.operators import asr as module

    pairs = spark.createDataFrame([("s", "eins zwei drei", "eins drei")] * 40 + [("s", "vier", None), ("t", "eins zwei drei", "eins drei")], "system string, ref_text string, hyp_text string")
    rows, kept = [], module.materialize
    monkeypatch.setattr(module, "materialize", lambda df, tag: (out := kept(df, tag), rows.append(out.count()))[0])
    got = {(r["system"], r["norm"]): (r["errors"], r["words"]) for r in asr.norm_rates(pairs, names=["raw", "ours", "ours_compounds"]).collect()}
    assert got == {("s", n): (41, 121) for n in ("raw", "ours", "ours_compounds")} | {("t", n): (1, 3) for n in ("raw", "ours", "ours_compounds")}
    assert rows == [3]

import hashlib
import json
import sqlite3
import struct
import wave

import pytest

from parley.sources import conll, files, sinks, stores
from parley.streaming import dialogue as sd


def test_conll_round_trip(spark, tmp_path):
    rows = [("s1", ["Das", "nicht"], [0, 1], [1, 0]), ("s2", ["Nie", "so"], [1, 0], [0, 1])]
    blocks = spark.createDataFrame(rows, "sentence_id string, tokens array<string>, cue_masks array<int>, scope_masks array<int>")
    path = str(tmp_path / "a" / "scope.conll")
    digest = conll.write_conll(blocks, path, "scope", "ann")
    text = open(path).read()
    assert text == "Das\tO\tX\nnicht\tX\tO\n\nNie\tX\tO\nso\tO\tX\n\n" and hashlib.sha256(text.encode()).hexdigest() == digest
    back = conll.read_checked(spark, path, "scope").orderBy("sentence_id").collect()
    assert [(r["sentence_id"], r["tokens"], r["cue_masks"], r["scope_masks"]) for r in back] == rows
    open(path, "a").write("x\tO\tO\n\n")
    with pytest.raises(ValueError):
        conll.read_checked(spark, path, "scope")


def test_conll_rejects_labels_and_reads_predictions(spark, tmp_path):
    bad = tmp_path / "bad.conll"
    bad.write_text("a\tQ\n\n")
    with pytest.raises(Exception, match="columns"):
        conll.read_conll(spark, str(bad), "cue").collect()
    p = tmp_path / "p.conll"
    p.write_text("# head\na\tX\tO\tX\nb\tO\tX\tX\n\nc\tO\tX\n\n")
    got = [(r["token"], r["is_cue"], r["gold"], r["pred"]) for r in conll.read_predictions(spark, str(p)).orderBy("block_id", "tok_idx").collect()]
    assert got == [("a", True, False, True), ("b", False, True, True), ("c", None, False, True)]


def test_per_annotator_names_collide(spark, tmp_path):
    b = spark.createDataFrame([("s", "a b", ["x"], [0]), ("s", "a_b", ["x"], [0])], "sentence_id string, annotator string, tokens array<string>, cue_masks array<int>")
    with pytest.raises(ValueError):
        conll.write_per_annotator(b, str(tmp_path), "cue")


def test_sqlite_scan_with_pushdown(spark, tmp_path):
    path = str(tmp_path / "a.sqlite")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE transcripts (doc_id TEXT, annotator TEXT, lines_json TEXT, done INTEGER)")
        db.executemany("INSERT INTO transcripts VALUES (?, ?, ?, ?)", [(f"d{i}", "a", json.dumps([{"text": "x", "start": 1.0, "end": 2.0}, {"text": "y"}]), i % 2) for i in range(10)])
    got = stores.finished_transcripts(spark, path)
    assert got.count() == 10 and {r["doc"] for r in got.collect()} == {f"d{i}" for i in range(1, 10, 2)}


class Client:
    fails = 2

    def __init__(self, url):
        pass

    def keys(self):
        return ["e1", "e2"]

    def query(self, name, key):
        if Client.fails:
            Client.fails -= 1
            raise ConnectionError
        return [{"result": [{"experiment": key, "turns": [{"role": "Interviewer", "text": "Hallo", "turn_id": 7}, {"role": "Interviewee", "text": "Ja"}]}]}]


def test_turn_server_with_retries(spark):
    rows = list(stores.ServerReader({"url": "ws://x", "factory": "tests.test_sources:Client", "base": "0"}).read(stores.InputPartition("e1")))
    assert [(r[0], r[1], r[3], r[7]) for r in rows] == [("e1", 0, "Hallo", ["7"]), ("e1", 1, "Ja", ["2"])]
    with pytest.raises(ValueError):
        stores.validate("http://x", 3, 1)
    with pytest.raises(TypeError):
        stores.unwrap({"result": 3})
    tries = []
    with pytest.raises(ConnectionError):
        stores.with_retries(lambda: (tries.append(1), (_ for _ in ()).throw(ConnectionError()))[0], attempts=3, sleep=lambda s: None)
    assert len(tries) == 3


def test_file_readers(spark, tmp_path):
    (tmp_path / "hyp" / "sys").mkdir(parents=True)
    (tmp_path / "hyp" / "sys" / "01_Interviewee.json").write_text(json.dumps({"transcription": None, "segments": [{"start": 0, "end": 1, "text": "x"}]}))
    r = files.read_hypotheses(spark, str(tmp_path / "hyp")).first()
    assert (r["system"], r["doc"], r["transcription"]) == ("sys", "01_Interviewee", "")
    (tmp_path / "01_Interviewee.txt").write_text("eins\n\nzwei\n")
    assert [(r["eid"], r["role"], r["line"], r["text"]) for r in files.read_references(spark, str(tmp_path)).collect()] == [("01", "Interviewee", 0, "eins"), ("01", "Interviewee", 1, "zwei")]
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(16000)
        w.writeframes(struct.pack("<4h", 0, 16384, -32768, 1))
    a = files.read_audio(spark, str(tmp_path)).first()
    assert (a["doc"], a["rate"]) == ("a", 16000) and a["hours"] == pytest.approx(4 / 16000 / 3600)
    (tmp_path / "s.csv").write_text("﻿item_uuid,text\nu,x\nu,y\n", encoding="utf-8")
    with pytest.raises(ValueError):
        files.read_sample(spark, str(tmp_path / "s.csv"))


def test_csv_with_json_cells(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", "y"], 1)], "k string, v array<string>, drop int")
    sinks.write_csv(df, str(tmp_path / "out"), ["k", "v", "missing"], single=True)
    r = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out")).first()
    assert (r["k"], r["v"], r["missing"]) == ("a", '["x","y"]', None)
    assert sinks.markdown(df.select("k")) == "| k |\n| --- |\n| a |\n"


def test_streaming_pack_equals_batch(spark, tmp_path):
    rows = [(1, 0.0, 5.0), (1, 6.0, 10.0), (1, 20.0, 25.0), (1, 25.5, 40.0), (1, 41.0, 55.0), (1, 100.0, 101.0)]
    spark.createDataFrame(rows, "user_id long, start double, end double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, start double, end double").parquet(str(tmp_path / "in"))
    q = sd.pack_stream(stream, idle=None).writeStream.format("memory").queryName("packed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["start"], r["end"]) for r in spark.table("packed").collect()) == [(0, 10), (20, 40), (41, 55)]


def test_streaming_merge_equals_batch(spark, tmp_path):
    from parley.operators import dialogue as dg

    rows = [(1, 0, "Interviewer", "Ja"), (1, 1, "Interviewer", ", gut ."), (1, 2, "System", "x"), (1, 3, "Interviewer", "so"), (1, 4, "Interviewee", " "), (1, 5, "Interviewee", "Nein"), (1, 6, "Interviewer", "Ende"), (2, 0, "Interviewee", "a"), (2, 1, "Interviewer", "b")]
    kind = "interview_id long, pos long, role string, text string"
    df = spark.createDataFrame(rows, kind)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = sd.merge_stream(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), idle=None).writeStream.format("memory").queryName("merged").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["interview_id"], r["role"], r["text"], r["first_pos"]) for r in spark.table("merged").collect()}
    whole = dg.clean_turns(df).orderBy("interview_id", "turn_idx").collect()
    last = {r["interview_id"]: r["turn_idx"] for r in whole}
    assert got == {(r["interview_id"], r["role"], r["text"], r["first_pos"]) for r in whole if r["turn_idx"] < last[r["interview_id"]]} and len(got) == 3


def test_arrivals_are_scored_once(spark, tmp_path):
    source, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    for k in range(2):
        spark.createDataFrame([(k,)], "k int").write.mode("append").parquet(source)
        sd.score_arrivals(spark.readStream.schema("k int").parquet(source), lambda df: df.selectExpr("k", "k * 10 AS score"), out, log).awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(f"{out}/batch=*").collect())) == [(0, 0), (1, 10)]

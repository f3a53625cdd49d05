import pytest
from pyspark.sql import functions as F

from parley.functions import arrow, features


def chain(words):
    """Each word hangs on the one before."""
    return [("NOUN" if w[:1].isupper() else "X", "root" if k == 0 else "dep", max(k - 1, 0)) for k, w in enumerate(words)]


def test_parser_features_and_depths(spark):
    df = spark.createDataFrame([(["Haus", "am", "See"],), ([],)], "tokens array<string>").withColumn("f", features.parsed(chain)("tokens"))
    got = df.select("f.*", features.edges(F.col("f.heads")).alias("e")).collect()
    assert got[0]["pos"] == ["NOUN", "X", "NOUN"] and got[0]["heads"] == [0, 0, 1] and (got[0]["e"]["source"], got[0]["e"]["target"]) == ([0, 1], [1, 2])
    assert got[1]["pos"] == [] and got[1]["e"]["source"] == []
    depth = df.select(arrow.tree_depths(features.edges(F.col("f.heads"))["source"], features.edges(F.col("f.heads"))["target"]).alias("d")).first()["d"]
    assert depth == {0: 0, 1: 1, 2: 2}
    tags = features.inventory(df.select("f.pos", "f.deprel"), "pos", "deprel")
    table = {(r["kind"], r["label"]): r["id"] for r in tags.collect()}
    assert table == {("pos", "NOUN"): 0, ("pos", "X"): 1, ("deprel", "dep"): 0, ("deprel", "root"): 1}
    ids = df.select(features.encoded(F.col("f.pos"), {"NOUN": 4}).alias("n")).first()["n"]
    assert ids == [4, -1, 4]
    with pytest.raises(Exception, match="every word"):
        df.select(features.parsed(lambda ws: [])("tokens")).collect()


def test_models_by_kind():
    c = features.Components()
    c.register("cue", "plain", "local", lambda path: lambda tokens: (path, tokens))
    assert c.load("cue", "plain", "local", "p")("t") == ("p", "t")
    with pytest.raises(ValueError, match="cue/plain/local"):
        c.load("scope", "plain", "local", "p")

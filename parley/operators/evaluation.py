"""Evaluation as one pass over all models: blocks and predictions in, metrics, files' rows, strata and comparisons out.

blocks: block_id, sentence_id, tokens, cue_masks [, scope_masks, split]. predictions: model, block_id, pred (0/1 for each
word that the model got to see)."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import text as tx
from parley.operators import metrics as mt

METRICS = ("precision", "recall", "f1", "exact_match")


def gold(task: str) -> Column:
    """Cue masks; for scope, scopes without the cues themselves."""
    return F.col("cue_masks") if task == "cue" else tx.scope_without_cues(F.col("scope_masks"), F.col("cue_masks"))


def inputs(task: str, special: str) -> Column:
    """What a model sees: the tokens; for scope, with cue words replaced by a special token."""
    return F.col("tokens") if task == "cue" else tx.mask_cues(F.col("tokens"), F.col("cue_masks"), special)


def fitting(blocks: DataFrame, most: int, size: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(blocks that fit `most` positions, counts of those that do not by split): only training leaves the others out."""
    n = F.size("tokens") if size is None else size
    long = n > most
    counts = blocks.groupBy("split").agg(F.count_if(long).alias("truncated"), F.count(F.lit(1)).alias("blocks"))
    return blocks.where(~(long & (F.col("split") == "train"))), counts


def judged(blocks: DataFrame, predictions: DataFrame, task: str) -> DataFrame:
    """model, block_id, sentence_id, tokens, cue_masks, gold, pred (as long as gold), truncated."""
    both = predictions.join(blocks.withColumn("gold", gold(task)), "block_id")
    n = F.size("gold")
    return both.withColumn("truncated", F.size("pred") < n).withColumn("pred", mt.padded(F.col("pred"), n)).select("model", "block_id", "sentence_id", "tokens", "cue_masks", "gold", "pred", "truncated")


def scores(rows: DataFrame) -> DataFrame:
    """A row per model: token counts and rates, exact_match, blocks, truncated_blocks. rows: judged()."""
    words = rows.select("model", F.explode(F.arrays_zip("gold", "pred")).alias("z")).select("model", "z.gold", "z.pred")
    per_block = rows.groupBy("model").agg(F.avg((F.col("gold") == F.col("pred")).cast("double")).alias("exact_match"), F.count(F.lit(1)).alias("blocks"), F.count_if("truncated").alias("truncated_blocks"))
    return mt.binary_prf(words, ("model",)).join(per_block, "model")


def comparison(scored: DataFrame) -> DataFrame:
    """A row per group of models that differ by their seed only: n, truncated_blocks, mean and deviation of each metric."""
    runs = scored.withColumn("model", mt.model_group(F.col("model")))
    flat = [c for m in METRICS for c in (F.avg(m).alias(f"{m}_mean"), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_std"))]
    return runs.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("truncated_blocks").alias("truncated_blocks"), *flat)


def prediction_text(task: str) -> Column:
    """A judged block as lines of token, gold cue (scope only), gold and predicted label, under its id."""
    xo = lambda c: F.when(c == 1, "X").otherwise("O")
    cue = (lambda z: [xo(z["cue_masks"])]) if task == "scope" else (lambda z: [])
    rows = F.transform(F.arrays_zip("tokens", "cue_masks", "gold", "pred"), lambda z: F.concat_ws("\t", z["tokens"], *cue(z), xo(z["gold"]), xo(z["pred"])))
    return F.concat(F.lit("# sentence_id = "), F.col("sentence_id").cast("string"), F.lit("\n"), F.array_join(rows, "\n"), F.lit("\n\n"))


def strata(rows: DataFrame, stratum: Column) -> DataFrame:
    """stratum, label, precision, recall, f1, support, delta_if_removed over words: which strata cost most.

    rows: one per word, with gold and pred. A class is a stratum with a label, as in "3_1"."""
    named = lambda c: F.concat_ws("_", stratum.cast("string"), F.col(c).cast("string"))
    report = mt.impact_if_removed(mt.class_report(rows.select(named("gold").alias("gold"), named("pred").alias("pred"))))
    return report.select(F.substring_index("label", "_", 1).alias("stratum"), F.substring_index("label", "_", -1).alias("gold"), "precision", "recall", "f1", "support", "delta_if_removed")


def by_depth(words: DataFrame, depths: DataFrame, on: Sequence[str]) -> DataFrame:
    """words with the tree depth of each (-1: the parser has no such node)."""
    return words.join(depths, list(on), "left").withColumn("depth", F.coalesce("depth", F.lit(-1)))


def chained(blocks: DataFrame, cue_model, scope_model, special: str, replace: bool = True) -> DataFrame:
    """blocks (tokens) with pred_cues and pred_scopes: what the first model finds is marked for the second.

    Models are column functions (tokens -> 0/1 a token), such as functions.arrow.scorer(). Cue words are replaced by the
    special token, or preceded by it; in the latter case the marks' own labels are dropped again. Cues are in no scope."""
    found = blocks.withColumn("pred_cues", cue_model(F.col("tokens")))
    pairs = F.arrays_zip("tokens", "pred_cues")
    if replace:
        seen = F.transform(pairs, lambda z: F.when(z["pred_cues"] == 1, F.lit(special)).otherwise(z["tokens"]))
    else:
        seen = F.flatten(F.transform(pairs, lambda z: F.when(z["pred_cues"] == 1, F.array(F.lit(special), z["tokens"])).otherwise(F.array(z["tokens"]))))
    told = found.withColumn("__seen", seen).withColumn("__labels", scope_model(F.col("__seen")))
    labels = F.col("__labels")
    if not replace:
        kept = F.filter(F.arrays_zip("__seen", "__labels"), lambda z: z["__seen"] != special)
        labels = F.transform(kept, lambda z: z["__labels"])
    told = told.withColumn("pred_scopes", mt.padded(F.transform(labels, lambda x: F.coalesce(x, F.lit(0))), F.size("tokens")))
    return told.withColumn("pred_scopes", tx.scope_without_cues(F.col("pred_scopes"), F.col("pred_cues"))).drop("__seen", "__labels")


def subword_labels(word_ids: Column, labels: Column, ignore: int = -100) -> Column:
    """A label for each subword: its word's at the word's first piece, `ignore` at others and at special pieces (null ids)."""
    before = F.concat(F.array(F.lit(None).cast("int")), word_ids)
    return F.transform(F.zip_with(word_ids, F.slice(before, F.lit(1), F.size(word_ids)), lambda w, p: F.struct(w.alias("w"), p.alias("p"))), lambda z: F.when(z["w"].isNull() | z["w"].eqNullSafe(z["p"]), F.lit(ignore)).otherwise(F.get(labels, z["w"])))


def grid(spark: SparkSession, tasks: Sequence[str], archs: Sequence[str], datasets: Sequence[str], seeds: Sequence[int] = (0,)) -> DataFrame:
    """task, arch, dataset, seed: every combination, a few fixed rows by a few fixed rows."""
    out = spark.createDataFrame([(t,) for t in tasks], "task string")
    for name, values, kind in (("arch", archs, "string"), ("dataset", datasets, "string"), ("seed", seeds, "int")):
        out = out.crossJoin(F.broadcast(spark.createDataFrame([(v,) for v in values], f"{name} {kind}")))
    return out


def unique_paths(paths: Sequence[str]) -> list[str]:
    """Each path once, in order of first mention; ways of writing one path are one."""
    return list(dict.fromkeys(os.path.normpath(p) for p in paths))


def sanity(blocks: DataFrame) -> DataFrame:
    """A row per split of what a look at a dataset should find to be nought or plausible."""
    one = lambda c: F.coalesce(F.exists(c, lambda x: x == 1), F.lit(False))
    return blocks.groupBy("split").agg(
        F.count(F.lit(1)).alias("blocks"),
        F.count_if((F.size("cue_masks") != F.size("tokens")) | (F.size("scope_masks") != F.size("tokens"))).alias("uneven"),
        F.count_if(F.size("tokens") == 0).alias("empty"),
        F.count_if(~one("cue_masks")).alias("without_cue"),
        F.count_if(one("cue_masks") & ~one("scope_masks")).alias("cue_without_scope"),
    )

"""Agreement coefficients over ratings in long form: unit, annotator, value. An absent row is no rating, never a negative one.

Undefined coefficients are null. All sums are one or two aggregations; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def corrected(observed: Column, expected: Column) -> Column:
    """(o - e) / (1 - e), null where chance leaves no room."""
    return F.when(expected < 1, (observed - expected) / (F.lit(1.0) - expected))


def krippendorff_alpha(ratings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Nominal alpha over units with two ratings or more [per group]."""
    per = ratings.groupBy(*by, "unit", "value").agg(F.count(F.lit(1)).alias("n"))
    unit = per.groupBy(*by, "unit").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("sq"))
    unit = unit.where("m >= 2")
    do = unit.groupBy(*by).agg(F.sum("m").alias("total"), F.sum((F.col("m") * F.col("m") - F.col("sq")) / (F.col("m") - 1)).alias("d"))
    values = per.join(unit.select(*by, "unit"), [*by, "unit"], "left_semi").groupBy(*by, "value").agg(F.sum("n").alias("c")).groupBy(*by).agg(F.sum(F.col("c") * F.col("c")).alias("c2"))
    both = do.join(values, list(by)) if by else do.crossJoin(F.broadcast(values))  # one row each
    expected = F.try_divide(F.col("total") * F.col("total") - F.col("c2"), F.col("total") * (F.col("total") - 1))
    return both.select(*by, F.col("total").alias("ratings"), F.when(expected > 0, F.lit(1.0) - (F.col("d") / F.col("total")) / expected).alias("alpha"))


def fleiss_kappa(ratings: DataFrame, raters: int) -> DataFrame:
    """Over units that all raters rated."""
    per = ratings.groupBy("unit", "value").agg(F.count(F.lit(1)).alias("n"))
    unit = per.groupBy("unit").agg(F.sum("n").alias("m"), F.sum(F.col("n") * (F.col("n") - 1)).alias("agree")).where(F.col("m") == raters)
    o = unit.agg(F.count(F.lit(1)).alias("units"), F.avg(F.col("agree") / (raters * (raters - 1))).alias("o"))
    shares = per.join(unit.select("unit"), "unit", "left_semi").groupBy("value").agg(F.sum("n").cast("double").alias("c")).agg(F.sum(F.col("c") * F.col("c")).alias("c2"))
    e = F.try_divide(F.col("c2"), (F.col("units") * raters) * (F.col("units") * raters))
    return o.crossJoin(F.broadcast(shares)).select("units", corrected(F.col("o"), e).alias("kappa"))


def pair_metrics(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """pairs: a, b (0/1) [by ...] -> observed agreement, Cohen's kappa, alpha, positive Dice and the 2x2 counts."""
    one = lambda x, y: F.count_if((F.col("a") == x) & (F.col("b") == y))
    g = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("tokens"), one(0, 0).alias("oo"), one(0, 1).alias("ox"), one(1, 0).alias("xo"), one(1, 1).alias("xx"))
    n = F.col("tokens").cast("double")
    a1, b1 = (F.col("xo") + F.col("xx")).cast("double"), (F.col("ox") + F.col("xx")).cast("double")
    o = F.try_divide(F.col("oo") + F.col("xx"), n)
    e = F.try_divide(a1 * b1 + (n - a1) * (n - b1), n * n)
    x, total = a1 + b1, n * 2
    de = F.try_divide(total * total - x * x - (total - x) * (total - x), total * (total - 1))
    do = F.try_divide((F.col("ox") + F.col("xo")) * 2.0, total)
    return g.select(*by, "tokens", o.alias("observed_agreement"), corrected(o, e).alias("cohen_kappa"), F.when(de > 0, F.lit(1.0) - do / de).alias("alpha"), F.try_divide(F.col("xx") * 2.0, x).alias("positive_dice"), "oo", "ox", "xo", "xx")


def pairwise(blocks: DataFrame) -> DataFrame:
    """blocks: key, annotator, labels array<int> -> for each two annotators: shared and unmatched blocks, exact agreement
    and pair_metrics() over the tokens of shared blocks."""
    n = blocks.groupBy("annotator").agg(F.count(F.lit(1)).alias("blocks"))
    a, b = (blocks.select("key", F.col("annotator").alias(f"who_{x}"), F.col("labels").alias(f"l{x}")) for x in "ab")
    both = a.join(b, "key").where("who_a < who_b")
    shared = both.groupBy("who_a", "who_b").agg(F.count(F.lit(1)).alias("shared_blocks"), F.avg((F.col("la") == F.col("lb")).cast("double")).alias("exact_block_agreement"))
    toks = both.select("who_a", "who_b", F.explode(F.arrays_zip(F.col("la").alias("a"), F.col("lb").alias("b"))).alias("t")).select("who_a", "who_b", "t.a", "t.b")
    out = shared.join(pair_metrics(toks, ("who_a", "who_b")), ["who_a", "who_b"])
    for x in "ab":
        out = out.join(F.broadcast(n.select(F.col("annotator").alias(f"who_{x}"), F.col("blocks").alias(f"blocks_{x}"))), f"who_{x}")  # a row per annotator
    return out.withColumn("unmatched_a", F.col("blocks_a") - F.col("shared_blocks")).withColumn("unmatched_b", F.col("blocks_b") - F.col("shared_blocks"))


def report(blocks: DataFrame, raters: int) -> DataFrame:
    """blocks: key, annotator, labels -> a row for each two annotators (pairwise()) and one over all, where who_a and who_b are null:
    tokens with two ratings or more, tokens with all, nominal alpha and kappa over these."""
    ratings = blocks.select("key", "annotator", F.posexplode("labels").alias("pos", "value")).select(F.concat_ws("|", F.col("key").cast("string"), F.col("pos").cast("string")).alias("unit"), "annotator", "value")
    n = ratings.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") >= 2).alias("tokens"), F.count_if(F.col("n") == raters).alias("tokens_with_all"))
    one = n.crossJoin(F.broadcast(krippendorff_alpha(ratings).select("alpha"))).crossJoin(F.broadcast(fleiss_kappa(ratings, raters).select(F.col("kappa").alias("fleiss_kappa"))))  # a row each
    return pairwise(blocks).unionByName(one, allowMissingColumns=True)

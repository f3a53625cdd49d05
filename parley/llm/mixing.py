"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled by a hash of their id and laid end to end; the stream of words (twice over at most)
is cut into blocks of equal size. Golden-ratio points, mapped through the cumulative target weights, name the source of
each slot; the r-th slot of a source takes its r-th block. The last block of a source is cut where its target ends, so
what is taken differs from the target by less than a word.

All running sums have two levels (about the square root of the rows in a group), so that a source with most rows is
spread over many tasks. No source, block or slot is collected anywhere. The table of sources itself is ordered in one
task, so sources are meant to be collections (to some millions), not single pages.

Defined cases: null text has size 0; a null source is one source, last. A source without words has target 0. Rows that
repeat an id are different documents with their own place in the stream, equal rows too. Ties in the shuffle go by id. An
empty table gives an empty result. The result follows from the rows alone, not from how they are dealt to tasks.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.llm._common import documents, materialize, row_key

#: The golden ratio's fractional part in units of 2**-64: its multiples, modulo one, are spread as evenly as points of one
#: rule can be. In whole numbers they stay exact for any number of slots.
GOLDEN, ONE = 11400714819323198485, 1 << 64
WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """source, source_size -> with src (rank), target: shares by weight, none above most x size, the excess dealt anew.

    Dealing the excess until none is above ends at one level: target = min(cap, level * weight). Sources whose cap is
    lowest for their weight fill up first, so sums over that order give the level. A window over sources, not rows.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("src") % len(weights) + 1).cast("int"))
    s = sources.withColumn("src", rank).withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = W.orderBy(F.col("cap") / F.col("w"), "src")
    below = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
    total = F.sum("source_size").over(W.partitionBy()) * F.lit(float(share))
    s = s.withColumn("level", (total - below) / rest).withColumn("full", F.col("cap") <= F.col("level") * F.col("w"))
    # caps are met in this order up to some source; from there on all have the level found at the first that isn't full
    level = F.max(F.when(~F.col("full"), F.struct(-F.row_number().over(order), "level"))).over(W.partitionBy())["level"]
    return s.withColumn("final", level).select("source", "source_size", "src", F.when(F.col("full") | F.col("final").isNull(), F.col("cap")).otherwise(F.col("final") * F.col("w")).alias("target"))


def _two_level(df: DataFrame, part: str, cell: str, order: list, value: str, out: str) -> DataFrame:
    """Adds the sum of `value` over the rows before this one in (part, cell, order)."""
    cells = df.groupBy(part, cell).agg(F.sum(value).alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(W.partitionBy(part).orderBy(cell).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select(F.col(part).alias("__p"), F.col(cell).alias("__c"), before.alias("__before"))
    mine = F.coalesce(F.sum(value).over(W.partitionBy(part, cell).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("__mine", mine).join(cells, (F.col(part) == F.col("__p")) & (F.col(cell) == F.col("__c"))).withColumn(out, F.col("__before") + F.col("__mine")).drop("__p", "__c", "__before", "__mine")


def schedule(plan: DataFrame, block: int) -> DataFrame:
    """slot, src, block_no: which source's which block fills each slot. plan: src, target.

    Points are drawn until every source has the blocks its target needs (a few more than that in all); later ones are
    left out, so the order is that of the points.
    """
    spark = plan.sparkSession
    need = plan.where("target > 0").select("src", F.ceil(F.col("target") / block).cast("long").alias("need"))
    total, n_src = need.agg(F.coalesce(F.sum("need"), F.lit(0)), F.count(F.lit(1))).first()
    if not total:
        return spark.createDataFrame([], "slot long, src int, block_no long")
    # of golden-ratio points, an interval gets its share but for about log(n); a few per source make up for that
    n = total + 4 * n_src * (int(math.log2(total + 2)) + 4)
    cells = 1024
    last = F.sum("need").over(W.orderBy("src"))
    bounds = need.withColumn("hi", last / F.lit(float(total))).withColumn("lo", (last - F.col("need")) / F.lit(float(total)))
    bounds = bounds.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)))))
    per = max(1, math.isqrt(n))
    u = (F.col("id").cast("decimal(18,0)") * F.lit(Decimal(GOLDEN))) % F.lit(Decimal(ONE))
    points = spark.range(n).select(F.col("id").alias("slot"), (u.cast("double") / float(ONE)).alias("u")).withColumn("cell", F.floor(F.col("u") * cells)).withColumn("chunk", F.floor(F.col("slot") / per))
    hit = points.join(bounds, "cell").where("u >= lo AND u < hi").select("slot", "chunk", "src", "need", F.lit(1).alias("one"))
    hit = _two_level(hit, "src", "chunk", ["slot"], "one", "block_no")
    # a share of the points can fall short by a few: those blocks follow at the end, in turn
    drawn = hit.where("block_no < need").select("slot", "src", "block_no")
    have = drawn.groupBy("src").agg(F.count(F.lit(1)).alias("have"))
    late = need.join(have, "src", "left").where("need > coalesce(have, 0)").withColumn("block_no", F.explode(F.sequence(F.coalesce("have", F.lit(0)), F.col("need") - 1)))
    return drawn.unionByName(late.select((F.lit(n) + F.col("block_no") * F.lit(n_src) + F.col("src")).cast("long").alias("slot"), "src", "block_no"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, block: int = 1024, row_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(mix, sized). mix: slot, doc_id, rk, off (place in the stream), src, from_word, to_word: the pieces of documents in their places, in order of
    (slot, from_word). sized: doc_id, rk, source, size, source_size, target, off for every row of docs.

    weights repeat over the sources in the order of their names. most <= 2: the stream passes twice at most. row_col: a
    column that sized carries along as `row`.
    """
    more = {"row": row_col} if row_col else {}
    rows = documents(docs, id_col, text_col, source=source_col, **more).select("doc_id", row_key(F.col("text")).alias("rk"), "source", words_in(F.col("text")).alias("size"), *more)
    rows = materialize(rows, "mix-sizes")
    plan = materialize(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "mix-targets")
    n = rows.count()
    per = max(1, math.isqrt(n))
    named = plan.select(F.col("source").alias("__s"), "source_size", "src", "target")
    placed = rows.join(named, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    placed = placed.withColumn("shuffled", F.xxhash64("doc_id", "rk")).withColumn("cell", F.pmod("shuffled", F.lit(per)))
    placed = materialize(_two_level(placed, "src", "cell", ["shuffled", "doc_id", "rk"], "size", "off"), "mix-places")
    # where the document lies in the stream's first and second pass, cut at the target
    last = F.floor("target").cast("long")
    passes = placed.where("size > 0").withColumn("turn", F.explode(F.array(F.lit(0), F.lit(1))))
    passes = passes.withColumn("a", F.col("off") + F.col("turn") * F.col("source_size")).withColumn("b", F.least(F.col("a") + F.col("size"), last)).where("a < b")
    pieces = passes.withColumn("block_no", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("b") - 1) / block))))
    low, high = F.greatest("a", F.col("block_no") * block), F.least("b", (F.col("block_no") + 1) * block)
    mix = pieces.select("doc_id", "rk", "off", "src", "block_no", (low - F.col("a")).alias("from_word"), (high - F.col("a")).alias("to_word"))
    mix = mix.join(schedule(plan, block), ["src", "block_no"]).select("slot", "doc_id", "rk", "off", "src", "from_word", "to_word")
    return mix, placed.select("doc_id", "rk", "source", "size", "source_size", "target", "off", *more)


def taken_words(mix: DataFrame, sized: DataFrame) -> DataFrame:
    """For each row of sized: its columns, taken, first_slot."""
    got = mix.groupBy(F.col("doc_id").alias("__i"), F.col("rk").alias("__k"), F.col("off").alias("__o")).agg(F.sum(F.col("to_word") - F.col("from_word")).alias("got"), F.min("slot").alias("first_slot"), F.count(F.lit(1)).alias("__n"))
    same = sized.join(got, F.col("doc_id").eqNullSafe(F.col("__i")) & (F.col("rk") == F.col("__k")) & (F.col("off") == F.col("__o")), "left")
    return same.select(*sized.columns, F.coalesce("got", F.lit(0)).cast("long").alias("taken"), "first_slot")


def keep_taken(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that the mix takes words of, with size, target, taken and first_slot (`_mix` after a name that docs has).

    Rows are told apart by a number of their own, so equal rows come out once each. how: as for mix_sources()."""
    have = {c.lower() for c in docs.columns}
    free = lambda c: c if c not in have else free(f"{c}_mix")
    row = free("row")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")  # the numbers are as written
    got = taken_words(*mix_sources(numbered, row_col=row, **how)).where("taken > 0").select(F.col("row").alias(row), *(F.col(c).alias(free(c)) for c in ("size", "target", "taken", "first_slot")))
    return numbered.join(got, row).drop(row)

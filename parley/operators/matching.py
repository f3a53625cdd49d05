"""Bipartite matching with limits, on tables: cells take clusters, each cluster once, each cell up to its limit, as many as can be.

Push-relabel rounds: a cell that lacks clusters pushes its need to clusters that are free, or held by a cell one step nearer
to a free cluster, which gives them up and pushes on; clusters that few cells can use are asked first. Steps (the labels) are
found anew by a breadth-first search when no push is left; a need without a way to a free cluster ends there, which is what makes the
result as large as any. Every round is a few joins and groupings of the edge table; needs and labels are columns. Only counts
come to the driver, and no cell, cluster or connected part is one task's work, whatever its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.shared import drop, materialize, ranked, spread_join, swept

#: Rows of a key that a window takes; those of larger keys are ranked range by range.
CROWD = 100_000


def firsts(rows: DataFrame, key: str, order: str, limit: str, size: str, crowd: int = CROWD) -> DataFrame:
    """The rows whose place among those of their key, in that order, is below their `limit`; keys of any size.

    size: a column that is no less than the number of rows of the key."""
    few = rows.where(F.col(size) <= crowd).withColumn("__k", F.row_number().over(W.partitionBy(key).orderBy(order))).where(F.col("__k") <= F.col(limit)).drop("__k")
    if rows.where(F.col(size) > crowd).isEmpty():
        return few
    placed = ranked(rows.where(F.col(size) > crowd), [key, order], "__rank")
    start = materialize(placed.groupBy(key).agg(F.min("__rank").alias("__start"), F.count(F.lit(1)).alias("__n")), "starts")
    cut = spread_join(placed, start, [key], rows.count(), "__n").where(F.col("__rank") - F.col("__start") < F.col(limit))
    return few.unionByName(cut.drop("__rank", "__start"))


def named(cluster: Column, kind: str) -> Column:
    """What stands for a cluster of that type where it is shuffled: of a text, which may be long, 128 bits of hash."""
    return F.unhex(F.md5(cluster)) if kind == "string" else cluster


def _hash(seed: int) -> Column:
    h = F.sha2(F.concat(F.lit(f"{seed}|"), F.col("cell").cast("string"), F.lit("|"), F.col("cluster").cast("string")), 256)
    return F.unhex(F.substring(h, 1, 32))


def _order() -> Column:
    """Clusters that few cells can use come first, others by a hash."""
    return F.concat(F.lpad(F.col("degree").cast("string"), 12, "0"), F.hex("h"))


def _nearest(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """Of each cell's edges the first in order, as many as all cells can hold together, and those that share their degree and the first
    byte of their hash with the last of these. The others change nothing.

    No more clusters than that are held at a time, those that a cell still lacks included, so a cell that has more edges finds what it
    lacks, free, among these: there it asks the same clusters, and its label stays 1."""
    most = cells.agg(F.sum(F.least("need", "n"))).first()[0]
    if cells.where(F.col("n") > F.lit(most)).isEmpty():
        return edges
    part = F.conv(F.hex(F.substring("h", 1, 1)), 16, 10).cast("int").alias("part")
    sizes = edges.groupBy("cell", "degree", part).agg(F.count(F.lit(1)).alias("k"))
    before = F.coalesce(F.sum("k").over(W.partitionBy("cell").orderBy("degree", "part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    last = sizes.withColumn("before", before).where(F.col("before") < most).groupBy("cell").agg(F.max(F.struct("degree", "part")).alias("last"))
    return edges.join(materialize(last, "last"), "cell").where(F.struct("degree", part) <= F.col("last")).drop("last")


def _labels(edges: DataFrame, held: DataFrame, needs: DataFrame, total: int) -> DataFrame:
    """cell, label: how many steps a cell is from a free cluster, as far as the needs ask. held: cluster, owner, degree."""
    arcs = spread_join(edges.select("cell", "cluster"), held, ["cluster"], total, "degree", how="left")
    arcs = materialize(arcs.where("owner IS NULL OR owner <> cell").select("cell", "owner").distinct(), "arcs")
    found = materialize(arcs.where("owner IS NULL").select("cell", F.lit(1).alias("label")), "labels")
    last, step = found, 1
    while not last.isEmpty() and not needs.join(found, "cell", "left_anti").isEmpty():
        step += 1
        ahead = arcs.join(last.select(F.col("cell").alias("owner")), "owner").select("cell").distinct().join(found, "cell", "left_anti")
        last = materialize(ahead.withColumn("label", F.lit(step)), "labels")
        found = found.unionByName(last)
    drop(arcs)
    return found


def _needs(cells: DataFrame, held: DataFrame) -> DataFrame:
    """The cells that lack clusters, with how many."""
    got = held.groupBy(F.col("owner").alias("cell")).agg(F.count(F.lit(1)).alias("got"))
    return cells.join(got, "cell", "left").withColumn("need", F.col("need") - F.coalesce("got", F.lit(0))).drop("got").where("need > 0")


def _pushed(edges: DataFrame, cells: DataFrame, crowd: int) -> DataFrame:
    """cluster, owner, degree: rounds over edges (cell, cluster, degree, o) until no need has a way left. cells: cell, need, n."""
    total = edges.count()
    held = materialize(edges.select("cluster", F.col("cell").alias("owner"), "degree").limit(0), "held")
    labels = cells.select("cell", F.lit(1).alias("label"))  # all clusters are free
    active = materialize(_needs(cells, held).join(labels, "cell"), "active")
    while not active.isEmpty():
        steps = labels.select(F.col("cell").alias("owner"), F.col("label").alias("under"))
        while not active.isEmpty():
            mine = spread_join(spread_join(edges, active.withColumn("size", F.col("n")), ["cell"], total, "n"), held.withColumnRenamed("degree", "d"), ["cluster"], total, "d", how="left")
            mine = mine.where("owner IS NULL OR owner <> cell").join(steps, "owner", "left")
            down = F.when(F.col("owner").isNull(), 0).otherwise(F.col("under")) == F.col("label") - 1
            ways = materialize(mine.where(down).select("cell", "cluster", "degree", "o", "need", "size"), "ways")
            bids = firsts(ways, "cell", "o", "need", "size", crowd)
            won = materialize(bids.groupBy("cluster").agg(F.min(F.struct("o", "cell"))["cell"].alias("owner"), F.max("degree").alias("degree")), "won")
            if won.isEmpty():
                break
            before, held = held, materialize(held.join(won, "cluster", "left_anti").unionByName(won), "held")
            drop(before)
            active = materialize(_needs(cells, held).join(labels, "cell"), "active")
        needs = materialize(_needs(cells, held), "needs")
        if needs.isEmpty():
            break
        labels = materialize(_labels(edges, held, needs, total), "labels")
        active = materialize(needs.join(labels, "cell"), "active")
    return held


def match(edges: DataFrame, seed: int = 42, crowd: int = CROWD) -> DataFrame:
    """edges: cell, limit, cluster -> cell, cluster: as many as can be, the same at every run. Nulls match nothing.

    An edge that is listed more than once counts once, a cell has the greatest limit that is listed. Clusters that are texts are
    shuffled as hashes. edges are read twice: write them first, where they are dear."""
    kind = edges.schema["cluster"].dataType.simpleString()
    with swept() as keep:
        rows = edges.where("cell IS NOT NULL AND cluster IS NOT NULL AND limit > 0").withColumn("name", named(F.col("cluster"), kind))
        pairs = materialize(rows.groupBy("cell", F.col("name").alias("cluster"), _hash(seed).alias("h")).agg(F.max("limit").cast("long").alias("limit")), "edges")
        cells = materialize(pairs.groupBy("cell").agg(F.max("limit").alias("need"), F.count(F.lit(1)).alias("n")), "cells")
        degrees = materialize(pairs.groupBy("cluster").agg(F.count(F.lit(1)).alias("degree")).where("degree > 1"), "degrees")
        pairs = spread_join(pairs.drop("limit"), degrees.withColumn("d", F.col("degree")), ["cluster"], pairs.count(), "d", how="left")
        pairs = materialize(pairs.withColumn("degree", F.coalesce("degree", F.lit(1).cast("long"))), "edges")
        held = _pushed(materialize(_nearest(pairs, cells).select("cell", "cluster", "degree", _order().alias("o")), "edges"), cells, crowd)
        won = held.select(F.col("owner").alias("cell"), F.col("cluster").alias("name"))
        out = rows.join(won, ["cell", "name"]).select("cell", "cluster").distinct() if kind == "string" else won.withColumnRenamed("name", "cluster")
        out = materialize(out, "matching")
        keep.append(out)
    return out


def shortfall(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """cell, limit, matched, lacking for each cell of the edges."""
    got = chosen.groupBy("cell").agg(F.count(F.lit(1)).alias("matched"))
    cells = edges.where("cell IS NOT NULL").groupBy("cell").agg(F.max("limit").cast("long").alias("limit"))
    return cells.join(got, "cell", "left").select("cell", "limit", F.coalesce("matched", F.lit(0)).cast("long").alias("matched"), (F.col("limit") - F.coalesce("matched", F.lit(0))).alias("lacking"))

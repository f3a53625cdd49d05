"""What all operators share: the folder that driver and executors see, cut lineage, and joins that a crowded key cannot hold up."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Paths written in this process and not deleted yet.
_LIVE: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where a local session names none, as in tests, a temporary folder; a cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="parley-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; what is there when the process ends is deleted."""
    path = f"{shared_folder(spark)}/parley-{tag}-{uuid.uuid4().hex[:12]}"
    _LIVE[path] = spark
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read back: short lineage, and lost executors cost no more than the reads."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._parley_path = path
    return out


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: what follows is dear for each row, however few bytes the rows have."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def once(value: Column) -> Column:
    """value, to be selected like any column, but computed once a row and where it stands: filters on it are not pushed below what
    deals the rows, and what is made of it does not compute it again."""
    return F.explode_outer(F.array(value))


def drop(df: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing reads it any more."""
    path = getattr(df, "_parley_path", None)
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _LIVE.pop(path, None)


@contextmanager
def swept(*keep: DataFrame) -> Iterator[list[DataFrame]]:
    """On leaving, delete all that was written inside, but for the frames in the list it gives."""
    before, held = set(_LIVE), list(keep)
    yield held
    stay = before | {getattr(df, "_parley_path", None) for df in held}
    for path, spark in list(_LIVE.items()):
        if path not in stay:
            _delete(spark, path)


@atexit.register
def _last() -> None:
    for path, spark in list(_LIVE.items()):
        try:
            if spark._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended; nothing is left to clean with
            pass


#: A key with more than a 1/HEAVY part of all rows (and more than LEAST) is joined by broadcast; fewer than HEAVY can be such.
HEAVY, LEAST = 10_000, 200


def spread_join(rows: DataFrame, table: DataFrame, on: list[str], total: int, count: str, how: str = "inner") -> DataFrame:
    """rows join table, inner or left (one row for each key; `count`: how many of the `total` rows have it), whatever a key's share of the rows.

    Keys above total / HEAVY rows are fewer than HEAVY, so their part of the table is broadcast and their rows stay where
    they are; the others are shuffled. Which keys these are comes to the driver as that many hashes; a key that shares one
    goes the same way. `count` is left out of the result. Without such a key it is an ordinary join. Both inputs are read
    more than once: write them first."""
    key = F.xxhash64(*on)
    heavy = [r[0] for r in table.where(F.col(count) > max(total // HEAVY, LEAST)).select(key).distinct().collect()]
    table = table.drop(count)
    if not heavy:
        return rows.join(table, on, how)
    often = key.isin(heavy)
    return rows.where(often).join(F.broadcast(table.where(often)), on, how).unionByName(rows.where(~often).join(table.where(~often), on, how))


def salted_join(rows: DataFrame, table: DataFrame, on: str, other: str, per: int = 1000) -> DataFrame:
    """rows join table (one row for each key), where a table's row may be too large to broadcast and a key may have any share of the rows.

    A key's rows are dealt into groups of about `per` by `other`, and its row of the table goes once to each group. rows are read
    more than once: write them first."""
    count = materialize(rows.groupBy(on).agg(F.count(F.lit(1)).alias("__n")), "counts")
    salts = count.where(F.col("__n") > per).select(on, "__n", F.ceil(F.col("__n") / per).alias("__salts"))
    dealt = spread_join(rows, salts, [on], rows.count(), "__n", how="left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(other), F.col("__salts")), F.lit(0).cast("long")))
    copies = table.join(count, on).withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.greatest(F.col("__n"), F.lit(1)) / per) - 1))).drop("__n")
    return dealt.drop("__salts").join(copies, [on, "__salt"]).drop("__salt")


def ranked(df: DataFrame, order: list, name: str) -> DataFrame:
    """df with `name`: 0, 1, 2, ... in that order, over all rows and without a task that sees them all.

    Rows are dealt by ranges of the order and sorted inside; a row's rank is its place there and the sizes of the ranges before."""
    spread = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()), "ranked")
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    sizes = spread.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))  # a row for each range
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return spread.join(F.broadcast(before), part == F.col("__part")).withColumn(name, (F.col("__before") + place).cast("long")).drop("__id", "__part", "__before")


def group_digests(df: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """keys -> `name`: SHA-256 over a group's values, the same for the same values in whatever order; groups of any size.

    Values are hashed where they are; hashes meet in 4096 buckets by their first digits, and only a bucket's digests meet."""
    hashed = df.select(*keys, F.sha2(value, 256).alias("__h"))
    buckets = hashed.groupBy(*keys, F.substring("__h", 1, 3).alias("__b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("__h")), ","), 256).alias("__d"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__b", "__d"))), lambda x: x["__d"]), ",")
    return buckets.groupBy(*keys).agg(F.sha2(whole, 256).alias(name))

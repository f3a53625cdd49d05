"""Exact deduplication as a stateful stream.

A digest of each normalised text goes through a streaming aggregation whose keyed state lives in RocksDB and never
expires: per digest it retains the row that stays (code points, stable identifier, content locator) and how many rows
came. Every hit is then checked on the full bytes; should two different texts share a digest, they are told apart. Rows
meet the verdict on their digest in a join that a digest with a large share of the rows does not hold up (`spread_join`).

Defined cases: a null text counts as empty. Rows that repeat an id with the same text are one document and get the same
verdict; an id repeated with other texts names several documents. A null id sorts behind all others and stays only
where every row of its group has one. Ids are of any type with an order. An empty table gives an empty result. Columns
beyond id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm._common import SPACE, documents, materialize, row_key, scratch, spread_join

#: Keyed state on disk; without files allocated ahead, which would cost megabytes for each of many partitions.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    """Without white space; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _best() -> Column:
    """The longest text, then the smallest id; a null id comes last."""
    return F.min(F.struct((-F.col("n")).alias("short"), F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), "rk"))


def _state(keyed: DataFrame, files_per_batch: int) -> DataFrame:
    """digest -> best(n, inverse id, locator), size: the state's last word on each digest."""
    spark = keyed.sparkSession
    out, log = scratch(spark, "dedup-state"), scratch(spark, "dedup-log")
    stream = spark.readStream.schema(keyed.schema).option("maxFilesPerTrigger", files_per_batch).parquet(keyed._parley_path)
    seen = stream.groupBy("digest").agg(_best().alias("best"), F.count(F.lit(1)).alias("size"))
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        # a batch that runs again after a failure overwrites its own folder
        query = (
            seen.writeStream.outputMode("update")
            .foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{out}/batch={k}"))
            .option("checkpointLocation", log)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    changes = spark.read.schema(seen.schema).parquet(f"{out}/*") if query.lastProgress else spark.createDataFrame([], seen.schema)
    # a digest is written anew by each batch that changes it; its size only grows
    return changes.groupBy("digest").agg(F.max(F.struct("size", "best")).alias("s")).select("digest", "s.best", "s.size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256, files_per_batch: int = 100_000) -> DataFrame:
    """doc_id, rk (content locator), keep_id, group_size, kept, text_sha256 for each row of docs.

    digest: Column -> binary Column; any collision is resolved on the full bytes, so a weak one is only slower.
    files_per_batch: files of the keyed table that one micro-batch takes.
    """
    raw = documents(docs, id_col, text_col)
    norm = normalised(F.col("text"))
    keyed = materialize(
        raw.select("doc_id", row_key(F.col("text")).alias("rk"), F.coalesce(F.length("text"), F.lit(0)).alias("n"), digest(norm).alias("digest"), F.unhex(F.sha2(norm, 256)).alias("sha") if digest is not sha256 else F.lit(None).cast("binary").alias("sha")),
        "dedup-keys",
    )
    state = materialize(_state(keyed, files_per_batch).withColumn("rows", F.col("size")), "dedup-groups")
    out = materialize(spread_join(keyed, state, ["digest"], keyed.count(), "rows").select("doc_id", "rk", "n", "sha", "digest", "best", "size"), "dedup-verdicts")
    # hits: rows of groups with more than one; only their texts are compared
    hits = out.where("size > 1").select(F.col("doc_id").alias("i"), F.col("rk").alias("k"), "digest").distinct()
    keys = raw.select("doc_id", row_key(F.col("text")).alias("rk"), "text")
    texts = keys.join(hits, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("rk") == F.col("k"))).select("digest", norm.alias("norm"))
    clashes = materialize(texts.distinct().groupBy("digest").count().where("count > 1").select("digest"), "dedup-clashes")
    if not clashes.isEmpty():
        out = out.join(clashes, "digest", "left_anti").unionByName(_apart(keyed, raw, clashes))
    keep = F.col("best.id")
    return out.select(
        "doc_id",
        "rk",
        keep.alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep) & (F.col("rk") == F.col("best.rk"))).alias("kept"),
        F.lower(F.hex(F.coalesce("sha", "digest"))).alias("text_sha256"),
    )


def _apart(keyed: DataFrame, raw: DataFrame, clashes: DataFrame) -> DataFrame:
    """Rows of the digests that different texts share, grouped by the texts themselves."""
    norm = normalised(F.col("text"))
    rows = raw.select(F.col("doc_id").alias("i"), row_key(F.col("text")).alias("k"), norm.alias("norm")).distinct()
    mine = keyed.join(clashes, "digest", "left_semi")
    mine = mine.join(rows, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("rk") == F.col("k"))).drop("i", "k")
    groups = mine.groupBy("norm").agg(_best().alias("best"), F.count(F.lit(1)).alias("size"))
    return mine.join(groups, "norm").drop("norm")


def keep_first(docs: DataFrame, verdicts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay; of rows that repeat an id and text, one."""
    stay = verdicts.where("kept").groupBy(F.col("doc_id").alias("__id"), F.col("rk").alias("__rk")).agg((F.count(F.lit(1)) > 1).alias("__again"))
    stay = materialize(stay, "dedup-stay")
    mine = lambda t: docs[id_col].eqNullSafe(t["__id"]) & (row_key(docs[text_col]) == t["__rk"])
    once, again = stay.where("NOT __again"), stay.where("__again")
    kept = docs.join(once, mine(once), "left_semi")
    return kept if again.isEmpty() else kept.unionByName(docs.join(again, mine(again), "left_semi").dropDuplicates([id_col, text_col]))

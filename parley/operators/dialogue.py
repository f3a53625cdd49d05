"""Turns: folding, merging, interruption bridges, role blocks, position strata and context.

Everything is a window or an aggregation over one interview, so interviews are the unit of distribution; a table of any
number of interviews needs one shuffle by interview, which consecutive operators share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.functions import lexicon as lx
from parley.functions import text as tx


def islands(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Numbers runs of equal `value` within keys, from 0."""
    w = W.partitionBy(*keys).orderBy(*order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    return df.withColumn("__new", new).withColumn(name, (F.sum("__new").over(w) - 1).cast("long")).drop("__new")


def ordered(keys: list[Column], value: Column) -> Column:
    """Aggregate: the values in order of the keys."""
    items = F.array_sort(F.collect_list(F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)), value.alias("v"))))
    return F.transform(items, lambda x: x["v"])


def clean_turns(raw: DataFrame, roles: tuple[str, ...] = lx.ROLES) -> DataFrame:
    """raw: interview_id, pos, role, text [, start, end, chunk_count, source_turn_ids, chunk_ids] -> cleaned turns.

    Turns of other roles and blank ones go; neighbours of one role that then meet are merged: texts joined, ids appended
    in order without repeats, first start, last end, chunks added up."""
    have = set(raw.columns)
    base = raw.where(F.col("role").isin(*roles)).withColumn("text", tx.squeeze(F.col("text"))).where("text <> ''")
    if "source_turn_ids" not in have:
        base = base.withColumn("source_turn_ids", F.array((F.col("pos") + 1).cast("string")))
    for c, kind in (("start", "double"), ("end", "double"), ("chunk_count", "long")):
        if c not in have:
            base = base.withColumn(c, F.lit(None).cast(kind))
    if "chunk_ids" not in have:
        base = base.withColumn("chunk_ids", F.array().cast("array<string>"))
    isles = islands(base, ["interview_id"], ["pos"], "role", "turn_idx")
    pos = F.col("pos")
    out = isles.groupBy("interview_id", "turn_idx").agg(
        F.first("role").alias("role"),
        tx.join_fragments(ordered([pos], F.col("text"))).alias("text"),
        ordered([pos], F.col("text")).alias("parts"),
        F.array_distinct(F.flatten(ordered([pos], F.col("source_turn_ids")))).alias("source_turn_ids"),
        F.array_distinct(F.flatten(ordered([pos], F.col("chunk_ids")))).alias("chunk_ids"),
        F.min_by("start", "pos").alias("start"),
        F.max_by("end", F.when(F.col("end").isNotNull(), F.col("pos"))).alias("end"),
        F.sum("chunk_count").alias("chunk_count"),
        F.min("pos").alias("first_pos"),
    )
    w = W.partitionBy("interview_id", "role").orderBy("turn_idx")
    return out.withColumn("role_turn_idx", (F.row_number().over(w) - 1).cast("long"))


def turn_counts(raw: DataFrame, roles: tuple[str, ...] = lx.ROLES) -> DataFrame:
    """interview_id, n_raw, n_empty (blank turns of a known role)."""
    blank = F.col("role").isin(*roles) & (tx.squeeze(F.col("text")) == "")
    return raw.groupBy("interview_id").agg(F.count(F.lit(1)).alias("n_raw"), F.count_if(blank).alias("n_empty"))


def fold_chunks(chunks: DataFrame) -> DataFrame:
    """interview_id, start, end, chunk_id, role, text -> one turn for each run of a role in time order."""
    isles = islands(chunks, ["interview_id"], ["start", "end", "chunk_id"], "role", "turn_idx")
    keys = [F.col("start"), F.col("end"), F.col("chunk_id")]
    return isles.groupBy("interview_id", "turn_idx").agg(
        F.first("role").alias("role"), F.array_join(ordered(keys, F.col("text")), " ").alias("text"), F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("chunk_count"), ordered(keys, F.col("chunk_id")).alias("chunk_ids")
    )


def role_texts(chunks: DataFrame) -> DataFrame:
    """interview_id, role, text: all words of a role in order of their end."""
    return chunks.groupBy("interview_id", "role").agg(F.array_join(ordered([F.col("end"), F.col("chunk_id")], F.col("text")), " ").alias("text"))


def continues(first: Column, between: Column, after: Column) -> Column:
    """Whether `after` looks like the continuation of the unfinished `first`."""
    tail = F.regexp_extract(first, "(?s)([^.!?…]*)$", 1)
    letter = F.regexp_extract(after, r"\p{L}", 0)
    last, tail_last = F.try_element_at(tx.words(first), F.lit(-1)), F.try_element_at(tx.words(tail), F.lit(-1))
    out = letter.rlike(r"^\p{Ll}") | F.rtrim(first).rlike("[,–—-]$") | tail_last.isin(lx.UNAMBIGUOUS_INCOMPLETE_FINAL) | (tx.is_backchannel(between) & last.isin(lx.INCOMPLETE_FINAL))
    return F.coalesce(out, F.lit(False))


def bridges(turns: DataFrame, most: int = lx.MAX_INTERRUPTION_TOKENS, tokens: Column | None = None) -> DataFrame:
    """interview_id, turn_idx of A and C, source turns of B for each unfinished A, short B, continued A."""
    w = W.partitionBy("interview_id").orderBy("turn_idx")
    nxt = lambda c, k: F.lead(c, k).over(w)
    t = turns.select("interview_id", "turn_idx", "role", "text", nxt("role", 1).alias("role_b"), nxt("text", 1).alias("text_b"), nxt("source_turn_ids", 1).alias("interrupted_by"), nxt("role", 2).alias("role_c"), nxt("text", 2).alias("text_c"))
    n = F.size(tx.words(F.col("text_b"))) if tokens is None else tokens
    ok = (F.col("role") == F.col("role_c")) & (F.col("role") != F.col("role_b")) & ~tx.ends_sentence(F.col("text")) & (n <= most) & continues(F.col("text"), F.col("text_b"), F.col("text_c"))
    return t.where(ok).select("interview_id", "turn_idx", (F.col("turn_idx") + 2).alias("to_turn_idx"), "role", "interrupted_by")


def role_blocks(turns: DataFrame, bridged: DataFrame) -> DataFrame:
    """turns with block_idx per interview and role: turns that bridges connect are one block."""
    into = bridged.select("interview_id", F.col("to_turn_idx").alias("turn_idx"), "interrupted_by")
    w = W.partitionBy("interview_id", "role").orderBy("turn_idx")
    new = F.when(F.col("interrupted_by").isNotNull(), 0).otherwise(1)
    return turns.join(into, ["interview_id", "turn_idx"], "left").withColumn("block_idx", (F.sum(new).over(w) - 1).cast("long"))


def block_offsets(blocks: DataFrame) -> DataFrame:
    """Character span [span_start, span_end) of each turn in its block's text, turns joined by one space."""
    w = W.partitionBy("interview_id", "role", "block_idx").orderBy("turn_idx")
    before = F.coalesce(F.sum(F.length("text") + 1).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return blocks.withColumn("span_start", before.cast("long")).withColumn("span_end", (before + F.length("text")).cast("long"))


def source_pieces(sentences: DataFrame, pieces: DataFrame) -> DataFrame:
    """Interval join: the pieces that overlap each sentence's span, in one role block."""
    on = ["interview_id", "role", "block_idx"]
    hit = (F.col("sent_start") < F.col("span_end")) & (F.col("sent_end") > F.col("span_start"))
    return sentences.join(pieces, on).where(hit)


def position_strata(turns: DataFrame, n: int = lx.POSITION_STRATA) -> DataFrame:
    """Each turn's stratum 1..n within its interview and role, as evenly as an array split; over all turns."""
    w = W.partitionBy("interview_id", "role").orderBy("role_turn_idx")
    return turns.withColumn("position_stratum", F.ntile(n).over(w))


def turn_context(turns: DataFrame) -> DataFrame:
    """Role and text of the turns before and after each turn."""
    w = W.partitionBy("interview_id").orderBy("turn_idx")
    return turns.select("interview_id", "turn_idx", "role", *(f(c, 1).over(w).alias(f"{name}_turn_{c}") for f, name in ((F.lag, "previous"), (F.lead, "following")) for c in ("role", "text")))


def intervening(items: DataFrame, turns: DataFrame) -> DataFrame:
    """item, turn_idx, role, text of the turns between an item's first and last source turn that are not its own.

    items: item, interview_id, source_turns array<long>."""
    span = items.select("item", "interview_id", "source_turns", F.array_min("source_turns").alias("lo"), F.array_max("source_turns").alias("hi"))
    inside = F.col("turn_idx").between(F.col("lo"), F.col("hi")) & ~F.array_contains("source_turns", F.col("turn_idx"))
    return span.join(turns, "interview_id").where(inside).select("item", "turn_idx", "role", "text")

"""Benchmark decontamination: a broadcast hash set of the benchmark's normalised n-grams against training windows.

A window of n words anywhere in a document covers a whole aligned block of g = (n + 1) // 2 words (one that starts at a
multiple of g). So documents are cut into aligned blocks only, n/g of the work of all windows, and each block is probed
in a hash set of all g-word runs of the benchmark. Blocks that hit keep the words around them; every window there is then
verified word for word against the benchmark's windows. Items shorter than n words are windows of their own length and
have their own block size. Built-in functions only.

The set is broadcast while its measured size is below `most_broadcast` entries. Beyond, single blocks with their position
are shuffled instead (no row is wider than a block), those that a large share of all blocks equals stay where they are
(`spread_join`), and only documents with a block that hit are cut again for the words around it. Both ways give the same
rows; a text's number of words is taken from the text itself, outside of any join.

Defined cases: null or empty texts have no words and no hits; items without words are left out; repeated items count
once per item_id; an item with a null item_id counts as any other, but is not listed. Rows that repeat an id are told apart by their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm._common import HEAVY, documents, materialize, row_key, spread_join

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(text: Column) -> Column:
    """Words joined and ended by one space each; A-Z as a-z, other letters as they are; null is empty."""
    body = F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP, " "))
    return F.when(body == "", F.lit("")).otherwise(F.concat(body, F.lit(" ")))


def _words(norm: Column) -> Column:
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.split(F.rtrim(norm), " "))


def _runs(words: Column, n: Column | int) -> Column:
    """All runs of n words, each joined and ended by spaces."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.concat(F.array_join(F.slice(words, i, n), " "), F.lit(" ")))


def block_size(n: int) -> int:
    """Classes of window lengths share a block size: 5 words from 9 on, else 3, 2 or 1."""
    return (n + 1) // 2 if n > 10 else 5 if n >= 9 else 3 if n >= 5 else 2 if n >= 3 else 1


def windows(benchmark: DataFrame, n: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, window, n: all windows of n words, or the whole item where it is shorter."""
    items = documents(benchmark, id_col, text_col).select(F.col("doc_id").alias("item_id"), _words(normal(F.col("text"))).alias("w")).where("size(w) > 0")
    size = F.least(F.lit(n), F.size("w"))
    return items.select("item_id", size.alias("n"), F.explode(_runs(F.col("w"), size)).alias("window")).distinct()


def _blocks(g: int) -> Column:
    """Aligned blocks of g words of `norm`, each ended by a space; the last may be shorter."""
    return F.regexp_extract_all("norm", F.lit(rf"(?:[^ ]++ ){{1,{g}}}+"), F.lit(0))


def _around(around: int) -> Column:
    """The text of block k (from 0) of `blocks` with `around` blocks on either side."""
    return F.concat_ws("", F.slice("blocks", F.greatest(F.col("k") - around + 1, F.lit(1)), F.lit(around + 1) + F.least(F.col("k"), F.lit(around))))


def _shuffled(rows: DataFrame, table: DataFrame, key: str, tag: str) -> DataFrame:
    """rows join table on key, both large: the keys that many rows have are counted first."""
    rows = materialize(rows, tag)
    total = rows.count()
    often = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > total // HEAVY)
    often = materialize(often, f"{tag}-often")
    counted = table.join(F.broadcast(often), key, "left").fillna(0, ["__n"])
    return spread_join(rows, materialize(counted, f"{tag}-table"), [key], total, "__n")


def _broadcast_scan(raw: DataFrame, grams: dict[int, DataFrame], around: dict[int, int]) -> tuple[DataFrame, dict[int, DataFrame]]:
    """(sizes, near by block size) in a scan for each block size; the first one also counts the words."""
    parts = {}
    for g, set_of in grams.items():
        # an entry beyond all blocks of a document carries its number of words; the empty string is its key
        cut = raw.select("doc_id", "rk", _blocks(g).alias("blocks"))
        cut = cut.select("doc_id", "rk", "blocks", F.posexplode(F.concat("blocks", F.array(F.lit("")))).alias("k", "block"))
        if not parts:
            set_of = set_of.unionByName(raw.sparkSession.createDataFrame([("",)], "block string"))
        last = F.element_at("blocks", -1)
        n_words = F.when(F.size("blocks") == 0, 0).otherwise((F.size("blocks") - 1) * g + F.length(last) - F.length(F.replace(last, F.lit(" "), F.lit(""))))
        hit = cut.join(F.broadcast(set_of.distinct()), "block").select(
            "doc_id", "rk", (F.greatest(F.col("k") - around[g], F.lit(0)) * g).alias("base"), F.when(F.col("block") == "", n_words.cast("long")).alias("n_words"), F.when(F.col("block") != "", _around(around[g])).alias("near")
        )
        parts[g] = materialize(hit, f"bench-scan-{g}")
    first = next(iter(parts.values()))
    return first.where("n_words IS NOT NULL").select("doc_id", "rk", "n_words"), {g: p.where("near IS NOT NULL") for g, p in parts.items()}


def _shuffled_scan(raw: DataFrame, grams: dict[int, DataFrame], around: dict[int, int]) -> tuple[DataFrame, dict[int, DataFrame]]:
    """The same where a set is too large to broadcast."""
    parts = {}
    for g, set_of in grams.items():
        cut = raw.select("doc_id", "rk", F.posexplode(_blocks(g)).alias("k", "block"))
        ks = _shuffled(cut, set_of.distinct(), "block", f"bench-blocks-{g}").groupBy(F.col("doc_id").alias("__i"), F.col("rk").alias("__r")).agg(F.collect_set("k").alias("ks"))
        again = raw.join(ks, F.col("doc_id").eqNullSafe(F.col("__i")) & (F.col("rk") == F.col("__r"))).select("doc_id", "rk", _blocks(g).alias("blocks"), F.explode("ks").alias("k"))
        parts[g] = materialize(again.select("doc_id", "rk", (F.greatest(F.col("k") - around[g], F.lit(0)) * g).alias("base"), _around(around[g]).alias("near")), f"bench-scan-{g}")
    return raw.select("doc_id", "rk", (F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit("")))).cast("long").alias("n_words")), parts


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most_broadcast: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(sizes, hits). sizes: doc_id, rk, n_words for each row. hits: doc_id, rk, pos, n, item_id: the windows that occur."""
    wins = materialize(windows(benchmark, n, item_col, item_text), "bench-windows")
    lengths, total = wins.agg(F.collect_set("n"), F.count(F.lit(1))).first()  # at most n lengths
    small = total * n <= most_broadcast
    raw = documents(docs, id_col, text_col).select("doc_id", row_key(F.col("text")).alias("rk"), normal(F.col("text")).alias("norm"))
    of = {g: [x for x in lengths if block_size(x) == g] for g in sorted({block_size(x) for x in lengths}, reverse=True)} or {5: []}
    grams = {g: wins.where(F.col("n").isin(own)).select(F.explode(_runs(F.split(F.rtrim("window"), " "), g)).alias("block")) if own else wins.limit(0).select(F.col("window").alias("block")) for g, own in of.items()}
    around = {g: max([-(-(x - g) // g) for x in own] + [0]) for g, own in of.items()}
    sizes, near = (_broadcast_scan if small else _shuffled_scan)(raw, grams, around)
    hits = None
    for g, own in of.items():
        for x in own:
            w = near[g].select("doc_id", "rk", "base", _words(F.col("near")).alias("w")).where(F.size("w") >= x)
            at = w.select("doc_id", "rk", "base", F.posexplode(_runs(F.col("w"), x)).alias("p", "window"))
            mine = wins.where(F.col("n") == x).groupBy("window").agg(F.collect_set(F.struct("item_id")).alias("items"))
            ok = at.join(F.broadcast(mine), "window") if small else _shuffled(at, mine, "window", f"bench-at-{x}")
            ok = ok.select("doc_id", "rk", (F.col("base") + F.col("p")).cast("long").alias("pos"), F.lit(x).alias("n"), F.explode("items").alias("item")).select("doc_id", "rk", "pos", "n", "item.item_id")
            hits = ok if hits is None else hits.unionByName(ok)
    if hits is None:
        hits = raw.sparkSession.createDataFrame([], raw.select("doc_id", "rk").schema.add("pos", "long").add("n", "integer").add("item_id", wins.schema["item_id"].dataType))
    return sizes, materialize(hits.distinct(), "bench-hits")


def verdicts(sizes: DataFrame, hits: DataFrame) -> DataFrame:
    """doc_id, rk, n_words, n_hit, items (ids as strings, sorted) for each row."""
    covered = hits.select("doc_id", "rk", "pos", "n").distinct().select("doc_id", "rk", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("n") - 1)).alias("p")).distinct()
    n_hit = covered.groupBy("doc_id", "rk").agg(F.count(F.lit(1)).alias("n_hit"), F.lit(None).cast("array<string>").alias("items"))
    items = hits.select("doc_id", "rk", "item_id").distinct().groupBy("doc_id", "rk").agg(F.lit(0).cast("long").alias("n_hit"), F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("items"))
    both = n_hit.unionByName(items).groupBy(F.col("doc_id").alias("__i"), F.col("rk").alias("__k")).agg(F.sum("n_hit").alias("n_hit"), F.max("items").alias("items"))
    on = F.col("doc_id").eqNullSafe(F.col("__i")) & (F.col("rk") == F.col("__k"))
    return sizes.join(both, on, "left").select("doc_id", "rk", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents in which a benchmark window occurs."""
    _, hits = scan(docs, benchmark, n, id_col, text_col)
    bad = hits.select(F.col("doc_id").alias("__i"), F.col("rk").alias("__k")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["__i"]) & (row_key(docs[text_col]) == bad["__k"]), "left_anti")


def spans_removed(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, rk, words: each document's normalised words without those inside an occurring window."""
    _, hits = scan(docs, benchmark, n, id_col, text_col)
    gone = hits.select("doc_id", "rk", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("n") - 1)).alias("p")).distinct()
    gone = gone.groupBy(F.col("doc_id").alias("__i"), F.col("rk").alias("__k")).agg(F.map_from_entries(F.collect_list(F.struct("p", F.lit(True)))).alias("gone"))
    raw = documents(docs, id_col, text_col).select("doc_id", row_key(F.col("text")).alias("rk"), _words(normal(F.col("text"))).alias("w"))
    left = F.filter("w", lambda x, i: ~F.coalesce(F.map_contains_key("gone", i.cast("long")), F.lit(False)))
    return raw.join(gone, F.col("doc_id").eqNullSafe(F.col("__i")) & (F.col("rk") == F.col("__k")), "left").select("doc_id", "rk", left.alias("words"))


def digest(rows: DataFrame) -> DataFrame:
    """The contract's columns from what verdicts() returns."""
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))

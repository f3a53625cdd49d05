"""Ranked lexical search: the best documents of the whole table for each item of a query table.

Documents are read once into postings (which query terms a document has, and how often). A task then takes a range of the
documents, concatenates the (item, document, impact) entries of all matched terms, sorts their packed keys by radix, sums
runs with reduceat and keeps each item's best in a heap. Statistics (N, L, df) cover all documents, impacts are whole numbers.

Items are worked on in blocks of about `most` (item, term) pairs, which is the bound of what a task holds and the driver
sends; each block is scored against all documents.

Defined cases: null and empty texts have no terms; rows that repeat a doc_id are documents of their own, and of the same
score and id any comes first (their rows look alike); a null doc_id is a document and comes after others in a tie; items
that share an id (null too) are one, with the terms of all their rows; items without a known term, and empty tables, give no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.llm import _words
from parley.llm._common import documents, drop, materialize, small_batches, swept

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_IN_TERM = np.zeros(256, bool)
_IN_TERM[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
#: Entries that are sorted at once; a document's own entries stay together.
ENTRIES = 1 << 21


def terms(text: Column) -> Column:
    """The different terms of a text as a column expression."""
    return F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UP, _LOW), F.lit(TERM), F.lit(0)))


class Query(NamedTuple):
    """A block of items: ids, terms in order, and for each term the items that have it (items[at[t]:at[t + 1]])."""

    ids: pa.Array
    vocabulary: pa.Array
    at: np.ndarray
    items: np.ndarray


def _query(pairs: pa.Table) -> Query:
    ids, vocabulary = (pairs.column(c).combine_chunks().dictionary_encode(null_encoding="encode") for c in ("item_id", "term"))
    term, item = vocabulary.indices.to_numpy(zero_copy_only=False), ids.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(term, kind="stable")
    return Query(ids.dictionary, vocabulary.dictionary.cast(pa.large_string()), np.searchsorted(term[order], np.arange(len(vocabulary.dictionary) + 1)), item[order].astype(np.int64))


def _matched(data: np.ndarray, at: np.ndarray, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each document (documents are at[d]:at[d + 1] of data); document and vocabulary index of each known one."""
    b = _FOLD[data]
    word = _IN_TERM[b]
    before, after = np.zeros(len(b), bool), np.zeros(len(b), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    before[at[:-1][at[:-1] < len(b)]] = False
    after[at[1:][at[1:] > 0] - 1] = False
    start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    n = np.diff(np.searchsorted(start, at))
    if not len(start):
        return n, start, start
    cuts = np.empty(2 * len(start), np.int64)  # terms and what lies between them, in turn
    cuts[0::2], cuts[1::2] = start, end
    found = pc.index_in(pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(b)), value_set=vocabulary)
    index = found.fill_null(-1).to_numpy()[0::2].astype(np.int64)
    doc = np.repeat(np.arange(len(n)), n)
    known = index >= 0
    return n, doc[known], index[known]


def _postings(query: Query):
    """doc_id, text -> doc_id, n (its terms), and which known terms it has how often; documents without terms go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(query.vocabulary)
        for batch in batches:
            data, offsets = _words.buffers(batch.column("text"))
            i, rows = 0, batch.num_rows
            while i < rows:
                j = min(rows, max(i + 1, int(np.searchsorted(offsets, offsets[i] + 4 * _words.CHUNK, "right")) - 1))
                n, doc, index = _matched(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], query.vocabulary)
                key, tf = np.unique(doc * size + index, return_counts=True)
                cuts = pa.array(np.searchsorted(key, np.arange(j - i + 1) * size).astype(np.int32))
                lists = (pa.ListArray.from_arrays(cuts, pa.array(x)) for x in ((key % size).astype(np.int32), tf.astype(np.int64)))
                out = pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(n.astype(np.int64)), *lists], ["doc_id", "n", "terms", "tfs"])
                yield out.filter(pa.array(n > 0))
                i = j

    return run


def radix_order(key: np.ndarray, most: int) -> np.ndarray:
    """The stable order of whole numbers below `most`, 16 bits at a time."""
    order = np.argsort(key.astype(np.uint16), kind="stable")
    for shift in range(16, int(most).bit_length(), 16):
        order = order[np.argsort((key[order] >> shift).astype(np.uint16), kind="stable")]
    return order


class _Later:
    """An id in reverse order: of two with the same score, the heap gives up the greater first."""

    __slots__ = ("id",)

    def __init__(self, x):
        self.id = x

    def __lt__(self, other):
        return other.id is not None and (self.id is None or other.id < self.id)

    def __eq__(self, other):
        return self.id == other.id


def _summed(batch: pa.RecordBatch, query: Query, weight: np.ndarray, n_docs: int, n_terms: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(item, row, score) of all pairs with a score above 0, by item and row; a part of the batch's rows at a time."""
    lists, tfs = batch.column("terms"), batch.column("tfs")
    cuts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    term, tf = lists.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy()
    row = np.repeat(np.arange(batch.num_rows), np.diff(cuts))
    m = 50 + (50 * batch.column("n").to_numpy() * n_docs) // n_terms
    impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))
    keep = impact > 0
    row, term, impact = row[keep], term[keep], impact[keep]
    fan = query.at[term + 1] - query.at[term]
    done = np.concatenate([[0], np.cumsum(fan)])
    ends = done[np.searchsorted(row, np.arange(batch.num_rows + 1))]  # entries before each row
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + ENTRIES, "right")) - 1)
        a, b = np.searchsorted(row, [i, j])
        if a < b:
            f = fan[a:b]
            item = query.items[np.repeat(query.at[term[a:b]] - (done[a:b] - done[a]), f) + np.arange(f.sum())]
            key = item * (j - i) + np.repeat(row[a:b] - i, f)
            order = radix_order(key, len(query.ids) * (j - i))
            key, entries = key[order], np.repeat(impact[a:b], f)[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            yield key[first] // (j - i), key[first] % (j - i) + i, np.add.reduceat(entries, first)
        i = j


def _best(query: Query, weight: np.ndarray, n_docs: int, n_terms: int, k: int):
    """Postings of a range of documents -> the k best of them for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list] = {}
        floor, kind = np.ones(len(query.ids), np.int64), None
        for batch in batches:
            ids = batch.column("doc_id")
            kind = ids.type
            for item, row, score in _summed(batch, query, weight, n_docs, n_terms):
                may = score >= floor[item]
                item, row, score = item[may], row[may], score[may]
                at = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]])) if len(item) else []
                for a, b in zip(at, [*at[1:], len(item)], strict=True):
                    s = score[a:b]
                    own = np.arange(a, b) if b - a <= k else a + np.flatnonzero(s >= np.partition(s, -k)[-k])
                    heap = heaps.setdefault(int(item[a]), [])
                    for x in own:
                        entry = (int(score[x]), _Later(ids[int(row[x])].as_py()))
                        if len(heap) < k:
                            heapq.heappush(heap, entry)
                        elif heap[0] < entry:
                            heapq.heapreplace(heap, entry)
                    if len(heap) == k:
                        floor[item[a]] = heap[0][0]
        if heaps:
            found = [(i, s, x.id) for i, heap in heaps.items() for s, x in heap]
            yield pa.RecordBatch.from_arrays([query.ids.take(pa.array([f[0] for f in found])), pa.array([f[2] for f in found], kind), pa.array([f[1] for f in found], pa.int64())], ["item_id", "doc_id", "score"])

    return run


def _block(raw: DataFrame, query: Query, kinds: str, k: int) -> DataFrame:
    """The ranks of one block of items, written."""
    kind = raw.schema["doc_id"].dataType.simpleString()
    found = materialize(raw.mapInArrow(_postings(query), f"doc_id {kind}, n long, terms array<int>, tfs array<long>").withColumn("number", F.monotonically_increasing_id()), "postings")
    n_docs, n_terms = found.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = found.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).toArrow()  # no more rows than the block's terms
    weight = np.zeros(len(query.vocabulary), np.int64)
    weight[df["t"].to_numpy()] = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df["df"].to_pylist()]
    # ranges of the written numbers: even shares, however the documents were laid out
    best = found.repartitionByRange("number").select("doc_id", "n", "terms", "tfs").mapInArrow(_best(query, weight, n_docs, n_terms or 1, k), f"{kinds}, doc_id {kind}, score long")
    order = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    out = materialize(best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "ranked-documents")
    drop(found)
    return out


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most: int = 500_000) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of each item."""
    spark = docs.sparkSession
    small_batches(spark)
    raw = documents(docs, id_col, text_col)
    with swept() as keep:
        asked = documents(items, item_col, item_text).select(F.col("doc_id").alias("item_id"), F.explode(terms(F.col("text"))).alias("term"))
        pairs = materialize(asked.distinct(), "item-terms")
        kinds = f"item_id {pairs.schema['item_id'].dataType.simpleString()}"
        blocks = max(1, math.ceil(2 * pairs.count() / most))
        ranks = []
        for i in range(blocks):
            query = _query(pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i).toArrow())
            if len(query.ids):
                ranks.append(_block(raw, query, kinds, k))
        keep += ranks
    none = spark.createDataFrame([], f"{kinds}, doc_id {raw.schema['doc_id'].dataType.simpleString()}, score long, rank int")
    return reduce(DataFrame.unionByName, ranks or [none]).select("item_id", "rank", "doc_id", "score")

"""Substring dedup: super-k-mers of words, dealt by minimiser, sorted in their bucket.

A window is `size` consecutive words. Its minimiser is the least hash of the `gram`-word runs inside it, so equal windows
have equal minimisers; consecutive windows that share one form a super-k-mer (of `piece` windows at most), which travels
as one packed string.

1. Documents -> thin rows (minimiser, document, first window, windows). Minimisers of a single document drop out.
2. Super-k-mers whose minimiser occurs in several documents are packed and dealt to their minimiser's bucket. There the
   words are numbered and the windows sorted by place, not as copies: ranks of 1, 2, 4, ... words up to `size`, exact at
   every step. Of each run of equal windows the least document id is kept.
3. A minimiser of more than `crowd` super-k-mers could fill a bucket without bound. Its windows are thinned first: those
   whose 64-bit print occurs in one document only equal no other and stay home (a print only rules out). What is left is
   cut anew, by a second minimiser too; equal packed strings are put together before the shuffle, with their least
   document, and the same bucket sorts the distinct ones. A passage in a third of all documents is a few strings then.
   Its occurrences meet the verdict on their string, compared in full, without a shuffle (`spread_join`).
4. Covered stretches go back to their documents, whose remaining words are joined.

Memory follows `piece` and `crowd`, not the repeats in a text or the number of copies. `crowd` changes no result.

Defined cases: null texts have no words. Rows that repeat an id are told apart by their text and do not remove each
other's words (only a smaller id does). Null ids neither remove nor lose words. Ids are of any type with an order. Empty
tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import _words
from parley.llm._common import documents, drop, materialize, row_key, small_batches, spread_join

#: Bytes of packed strings that are sorted, or held back for one Arrow batch, at once.
HELD = 1 << 20


def _sliding(g: np.ndarray, span: int) -> np.ndarray:
    """The least of each `span` neighbours."""
    out, reach = g, 1
    while reach * 2 <= span:  # of 2, 4, 8, ...
        out = np.minimum(out[: len(out) - reach], out[reach:])
        reach *= 2
    return np.minimum(out[: len(out) - (span - reach)], out[span - reach :]) if reach < span else out


def _of_windows(w: _words.Words, size: int, gram: int, second: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, place in it, minimiser) of each window of a chunk; second: two minimisers mixed into one key."""
    count = np.maximum(np.diff(w.at) - size + 1, 0)
    total = int(count.sum())
    doc = np.repeat(np.arange(len(count)), count)
    k = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
    if not total:
        return doc, k, np.zeros(0, np.uint64)
    g, at = _words.grams(w, gram)
    first = at[:-1][doc] + k
    key = _sliding(g, size - gram + 1)[first]
    if second:
        key = _words.mix(key ^ _words.mix(_sliding(_words.mix(g ^ np.uint64(0x94D049BB133111EB)), size - gram + 1)[first]))
    return doc, k, key


def _stretches(doc: np.ndarray, k: np.ndarray, key: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """(first index, windows) of the runs of neighbouring windows with one key, `piece` at most."""
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (k[1:] != k[:-1] + 1)
    starts = np.flatnonzero(new)
    since = np.arange(len(doc)) - np.repeat(starts, np.diff(np.append(starts, len(doc))))
    starts = np.flatnonzero(since % piece == 0)
    return starts, np.diff(np.append(starts, len(doc)))


def super_kmers(w: _words.Words, size: int, gram: int, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, minimiser, first window, windows) of each super-k-mer of a chunk."""
    doc, k, key = _of_windows(w, size, gram)
    starts, n = _stretches(doc, k, key, piece)
    return doc[starts], key[starts].view(np.int64), k[starts], n


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _texts(column: pa.Array) -> Iterator[bytes]:
    data, at = _words.buffers(column)
    view = memoryview(data)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield bytes(view[a:b])


def _scan(size: int, gram: int, piece: int):
    """Super-k-mers, and for each document a row without minimiser: its number of words in n, the digest of all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, w in _words.chunks(b.column("text"), fold=False):
                doc, mini, s, n = super_kmers(w, size, gram, piece)
                pick = pa.array(np.concatenate([np.arange(j - i), doc]) + i)
                sha = [_sha(t.split()) for t in _texts(b.column("text")[i:j])]
                none, rest = pa.nulls(j - i, pa.int64()), pa.nulls(len(doc), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pick), b.column("rk").take(pick), pa.concat_arrays([none, pa.array(mini, pa.int64())]), pa.array(np.concatenate([np.zeros(j - i), s]), pa.int32()), pa.array(np.concatenate([np.diff(w.at), n]), pa.int32()), pa.concat_arrays([pa.array(sha, pa.string()), rest])],
                    ["doc_id", "rk", "mini", "s", "n", "sha"],
                )

    return run


class _Held:
    """Rows for Arrow batches of about HELD bytes. Ids keep the type that they came with."""

    def __init__(self, names: list[str], kinds: list[pa.DataType]):
        self.schema, self.rows, self.bytes = pa.schema(list(zip(names, kinds, strict=True))), [], 0

    def add(self, row: tuple, size: int) -> None:
        self.rows.append(row)
        self.bytes += size

    def full(self) -> bool:
        return self.bytes > HELD or len(self.rows) > 1 << 16

    def take(self) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True) if self.rows else [[] for _ in self.schema]
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)
        self.rows, self.bytes = [], 0
        return out


def _pack(size: int):
    """The super-k-mers of minimisers that are not crowded, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = _Held(["mini", "doc_id", "rk", "s", "packed"], [pa.int64(), b.schema.field("doc_id").type, pa.int64(), pa.int32(), pa.binary()])
            for d, rk, text, segs in zip(b.column("doc_id").to_pylist(), b.column("rk").to_pylist(), _texts(b.column("text")), b.column("segs"), strict=True):
                words = text.split()
                for seg in segs.as_py():
                    if not seg["crowded"]:
                        packed = b" ".join(words[seg["s"] : seg["s"] + seg["n"] + size - 1])
                        out.add((seg["mini"], d, rk, seg["s"], packed), len(packed))
                        if out.full():
                            yield out.take()
            yield out.take()

    return run


def sorted_windows(packed: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, place, class) of each window of some packed strings; equal windows, and only they, have one class.

    Words are numbered; ranks of 2, 4, ... words come from sorting pairs of ranks, those of `size` from two that overlap.
    Nothing is hashed and no window is copied."""
    data = np.frombuffer(b" ".join(packed) + b" ", np.uint8)
    bounds = np.concatenate([[0], np.flatnonzero(data == 32) + 1])
    ends = np.cumsum([len(p) + 1 for p in packed])
    last = np.searchsorted(bounds, ends)  # words up to each string's end
    count = np.diff(np.concatenate([[0], last]))
    tokens = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)])
    rank = tokens.dictionary_encode().indices.to_numpy().astype(np.int64)

    def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (int(rank.max()) + 1) + b, return_inverse=True)[1].astype(np.int64)

    reach = 1
    while reach * 2 <= size and len(rank) > reach:
        rank = paired(rank[:-reach], rank[reach:])
        reach *= 2
    windows = np.maximum(count - size + 1, 0)
    row = np.repeat(np.arange(len(packed)), windows)
    k = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = (last - count)[row] + k
    cls = paired(rank[at], rank[at + size - reach]) if len(at) else at
    return row, k, cls


def _least(cls: np.ndarray, code: np.ndarray) -> np.ndarray:
    """For each window, the least code among those of its class."""
    out = np.full(int(cls.max()) + 1 if len(cls) else 0, np.iinfo(np.int64).max)
    np.minimum.at(out, cls, code)
    return out[cls]


def _codes(ids: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids in order, and each one's place in them."""
    known = np.array(sorted(set(ids)), object)
    place = {x: k for k, x in enumerate(known)}
    return known, np.array([place[x] for x in ids], np.int64)


def _late(rows: list[tuple], size: int) -> list[tuple]:
    """(doc_id, rk, a, b): the words that windows of a lesser id cover. rows: doc_id, rk, s, packed."""
    _, code = _codes([r[0] for r in rows])
    row, k, cls = sorted_windows([r[3] for r in rows], size)
    hit = np.flatnonzero(code[row] > _least(cls, code[row]))
    starts, n = _stretches(row[hit], k[hit], row[hit], len(hit) + 1)
    return [(*rows[r][:2], rows[r][2] + a, rows[r][2] + a + m + size - 1) for r, a, m in zip(row[hit][starts].tolist(), k[hit][starts].tolist(), n.tolist(), strict=True)]


def _firsts(rows: list[tuple], size: int) -> list[tuple]:
    """(string, its windows' least ids as runs a, b, least). rows: lo, n, packed."""
    known, code = _codes([r[0] for r in rows])
    row, k, cls = sorted_windows([r[2] for r in rows], size)
    least = _least(cls, code[row])
    starts, n = _stretches(row, k, least, len(row) + 1)
    out: list[list] = [[] for _ in rows]
    for r, a, m, x in zip(row[starts].tolist(), k[starts].tolist(), n.tolist(), least[starts].tolist(), strict=True):
        out[r].append({"a": a, "b": a + m + size - 1, "least": known[x]})
    return out


def _buckets(batches: Iterator[pa.RecordBatch], key: str, columns: list[str]) -> Iterator[tuple[list, list[tuple]]]:
    """(keys, rows) of whole buckets, some at a time: about HELD bytes, or one bucket that is larger."""
    keys, rows, held = [], [], 0
    for b in batches:
        for x, *r in zip(*(b.column(c).to_pylist() for c in (key, *columns)), strict=True):
            if held > HELD and x != keys[-1]:
                yield keys, rows
                keys, rows, held = [], [], 0
            keys.append(x)
            rows.append(tuple(r))
            held += len(r[-1])
    if rows:
        yield keys, rows


def _sort(size: int, kind: pa.DataType):
    """Buckets of minimisers that are not crowded -> covered stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Held(["doc_id", "rk", "a", "b"], [kind, pa.int64(), pa.int32(), pa.int32()])
        for _, rows in _buckets(batches, "mini", ["doc_id", "rk", "s", "packed"]):
            out.rows = _late(rows, size)
            yield out.take()

    return run


def _settle(size: int, kind: pa.DataType):
    """Buckets of distinct strings -> the least ids of each string's windows."""
    spans = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("least", kind)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Held(["key", "packed", "n", "spans"], [pa.int64(), pa.binary(), pa.int64(), spans])
        for keys, rows in _buckets(batches, "key", ["lo", "n", "packed"]):
            out.rows = [(x, r[2], r[1], s) for x, r, s in zip(keys, rows, _firsts(rows, size), strict=True)]
            yield out.take()

    return run


def _within(segs: pa.Array, i: int, j: int, w: _words.Words, size: int) -> np.ndarray:
    """Which windows of a chunk (in the order of _of_windows) lie in the documents' listed runs (s, n)."""
    count = np.maximum(np.diff(w.at) - size + 1, 0)
    first = np.cumsum(count) - count
    mine = segs[i:j]
    lengths = mine.value_lengths().fill_null(0).to_numpy()
    flat = mine.flatten()
    doc = np.repeat(np.arange(j - i), lengths)
    at = first[doc] + flat.field("s").to_numpy()
    step = np.zeros(int(count.sum()) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + flat.field("n").to_numpy(), -1)
    return np.cumsum(step)[:-1] > 0


def _prints(size: int):
    """Prints of the windows of crowded minimisers, runs of equal ones as one row (h, doc_id, rk, s, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, w in _words.chunks(b.column("text"), fold=False):
                h, bounds = _words.grams(w, size)
                doc = np.repeat(np.arange(j - i), np.diff(bounds))
                k = np.arange(len(h)) - bounds[:-1][doc]
                ok = np.flatnonzero(_within(b.column("crowded"), i, j, w, size))
                h, doc, k = h[ok], doc[ok], k[ok]
                starts, n = _stretches(doc, k, h, len(h) + 1)
                pick = pa.array(doc[starts] + i)
                yield pa.RecordBatch.from_arrays([pa.array(h[starts].view(np.int64)), b.column("doc_id").take(pick), b.column("rk").take(pick), pa.array(k[starts], pa.int32()), pa.array(n, pa.int32())], ["h", "doc_id", "rk", "s", "n"])

    return run


def _recut(size: int, gram: int, piece: int):
    """Windows that may have equals elsewhere, packed anew by both minimisers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = _Held(["key", "doc_id", "rk", "s", "packed"], [pa.int64(), b.schema.field("doc_id").type, pa.int64(), pa.int32(), pa.binary()])
            ids, rks = b.column("doc_id"), b.column("rk")
            for i, j, w in _words.chunks(b.column("text"), fold=False):
                doc, k, key = _of_windows(w, size, gram, second=True)
                ok = np.flatnonzero(_within(b.column("runs"), i, j, w, size))
                doc, k, key = doc[ok], k[ok], key[ok].view(np.int64)
                starts, n = _stretches(doc, k, key, piece)
                words: list[bytes] = []
                held = -1
                for d, s, m, x in zip(doc[starts].tolist(), k[starts].tolist(), n.tolist(), key[starts].tolist(), strict=True):
                    if d != held:
                        words, held = next(_texts(b.column("text")[i + d : i + d + 1])).split(), d
                    packed = b" ".join(words[s : s + m + size - 1])
                    out.add((x, ids[i + d].as_py(), rks[i + d].as_py(), s, packed), len(packed))
                    if out.full():
                        yield out.take()
            yield out.take()

    return run


def _finish():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = _Held(["doc_id", "rk", "n_words", "n_removed", "kept_sha256", "kept_text"], [b.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()])
            for d, rk, text, cover in zip(b.column("doc_id").to_pylist(), b.column("rk").to_pylist(), _texts(b.column("text")), b.column("cover"), strict=True):
                words = text.split()
                gone = bytearray(len(words))
                for x in cover.as_py():
                    gone[x["a"] : x["b"]] = b"\1" * (x["b"] - x["a"])
                kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
                out.add((d, rk, len(words), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode()), len(kept))
                if out.full():
                    yield out.take()
            yield out.take()

    return run


def _crowded(cand: DataFrame, kind: str, size: int, gram: int, piece: int) -> DataFrame:
    """doc_id, rk, a, b: what windows of crowded minimisers cover in greater ids. cand: doc_id, rk, text, crowded."""
    prints = materialize(cand.mapInArrow(_prints(size), f"h long, doc_id {kind}, rk long, s int, n int"), "window-prints")
    often = materialize(prints.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("c")).where("lo < hi").select("h", "c"), "shared-prints")
    runs = spread_join(prints, often, ["h"], prints.count(), "c").groupBy(F.col("doc_id").alias("i"), F.col("rk").alias("k")).agg(F.collect_list(F.struct("s", "n")).alias("runs"))
    again = cand.join(runs, (F.col("doc_id") == F.col("i")) & (F.col("rk") == F.col("k"))).select("doc_id", "rk", "text", "runs")
    cut = materialize(again.mapInArrow(_recut(size, gram, piece), f"key long, doc_id {kind}, rk long, s int, packed binary"), "crowded-strings")
    drop(prints)
    drop(often)
    strings = cut.groupBy("key", "packed").agg(F.min("doc_id").alias("lo"), F.count(F.lit(1)).alias("n"))
    spans = f"array<struct<a: int, b: int, least: {kind}>>"
    told = strings.repartition("key").sortWithinPartitions("key").select("key", "lo", "n", "packed").mapInArrow(_settle(size, _arrow(cand)), f"key long, packed binary, n long, spans {spans}")
    told = materialize(told, "string-firsts")
    back = spread_join(cut, told, ["key", "packed"], cut.count(), "n")
    return back.select("doc_id", "rk", "s", F.inline("spans")).where("least < doc_id").select("doc_id", "rk", (F.col("s") + F.col("a")).alias("a"), (F.col("s") + F.col("b")).alias("b"))


def _arrow(df: DataFrame) -> pa.DataType:
    """The Arrow type of doc_id."""
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema["doc_id"].dataType)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 50, gram: int = 16, crowd: int = 1000, piece: int = 1024) -> DataFrame:
    """doc_id, rk, n_words, n_removed, kept_sha256, kept_text; kept_text is null where nothing is removed (the text stands)."""
    small_batches(docs.sparkSession)
    raw = documents(docs, id_col, text_col).select("doc_id", row_key(F.col("text")).alias("rk"), "text")
    kind = raw.schema["doc_id"].dataType.simpleString()
    scanned = materialize(raw.mapInArrow(_scan(size, gram, piece), f"doc_id {kind}, rk long, mini long, s int, n int, sha string"), "super-kmers")
    thin = scanned.where("mini IS NOT NULL AND doc_id IS NOT NULL")
    shared = thin.groupBy("mini").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("c")).where("lo < hi")
    shared = materialize(shared.select("mini", "c", (F.col("c") > crowd).alias("crowded")), "shared-minimisers")
    segs = spread_join(thin, shared, ["mini"], scanned.count(), "c").groupBy(F.col("doc_id").alias("i"), F.col("rk").alias("k")).agg(F.collect_list(F.struct("s", "n", "mini", "crowded")).alias("segs"))
    cand = materialize(raw.join(segs, (raw["doc_id"] == F.col("i")) & (raw["rk"] == F.col("k"))).select("doc_id", "rk", "text", "segs"), "substring-candidates")
    packed = cand.mapInArrow(_pack(size), f"mini long, doc_id {kind}, rk long, s int, packed binary")
    cover = packed.repartition("mini").sortWithinPartitions("mini").mapInArrow(_sort(size, _arrow(raw)), f"doc_id {kind}, rk long, a int, b int")
    crowds = cand.where(F.exists("segs", lambda x: x["crowded"])).select("doc_id", "rk", "text", F.transform(F.filter("segs", lambda x: x["crowded"]), lambda x: F.struct(x["s"].alias("s"), x["n"].alias("n"))).alias("crowded"))
    cover = cover.unionByName(_crowded(crowds, kind, size, gram, piece))
    mine = cover.groupBy(F.col("doc_id").alias("i"), F.col("rk").alias("k")).agg(F.collect_list(F.struct("a", "b")).alias("cover"))
    cut = cand.select("doc_id", "rk", "text").join(mine, (F.col("doc_id") == F.col("i")) & (F.col("rk") == F.col("k"))).select("doc_id", "rk", "text", "cover")
    cut = materialize(cut.mapInArrow(_finish(), f"doc_id {kind}, rk long, n_words long, n_removed long, kept_sha256 string, kept_text string"), "substring-cut")
    whole = scanned.where("mini IS NULL")
    cut_by = cut.dropDuplicates(["doc_id", "rk"]).withColumnsRenamed({"doc_id": "i", "rk": "k"})
    both = whole.join(cut_by, (F.col("doc_id") == F.col("i")) & (F.col("rk") == F.col("k")), "left")
    return both.select("doc_id", "rk", F.col("n").cast("long").alias("n_words"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "kept_text")

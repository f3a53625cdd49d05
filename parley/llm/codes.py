"""Vector code compression: product codes whose codebooks are trained on all vectors by Elkan's form of Lloyd's rounds.

Vectors become whole numbers, floor(256 * x), cut into equal consecutive parts; each part has a codebook of its own. A row's
state is written after each assignment: its codes, one upper bound a part (on the distance to its entry) and one lower bound
for each entry of each part. The next round moves the bounds by how far the entries moved, and leaves out an entry only where
a bound or the triangle inequality puts it strictly farther than the row's own; what remains is compared by whole squared
distances, equal ones going to the lower index. All bounds are whole numbers rounded to the safe side, so no tie and no
nearest entry is lost to rounding: the codes are those of plain Lloyd rounds.

Lower bounds are kept in four bits, as steps above the row's upper bound: an entry much farther away is as good as excluded,
and half a byte an entry keeps the state near the size of the vectors.

Only codebooks, their moves and the sums of the parts of each entry (parts * entries rows) come to the driver. Tasks hold a batch.

Defined cases: vectors that are null, empty or hold null or non-finite components go. So do those whose length is not that of
the kept vector that comes first (by id, then components; null ids last). Lengths that the parts do not divide are filled up
with zeros. Components beyond 2**28 (of the whole numbers) count as 2**28. Rows that repeat an id are rows of their own, and
as first vectors each makes an entry; fewer vectors than entries make a smaller codebook. Equal entries go by the lower index.
Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm._common import drop, materialize, q, small_batches, spread_join, swept

#: Whole components are clipped here, so that no squared distance leaves 64 bits.
MOST = 1 << 28
_FAR = np.iinfo(np.int64).max


def root(x: np.ndarray) -> np.ndarray:
    """The floor of the square root, exact."""
    r = np.sqrt(x.astype(np.float64)).astype(np.int64)
    r -= r * r > x
    return r + ((r + 1) * (r + 1) <= x)


def root_up(x: np.ndarray) -> np.ndarray:
    r = root(x)
    return r + (r * r < x)


class Books(NamedTuple):
    """entries: parts x entries x width; moved: how far each is from where it was, rounded up; apart: distances between entries, rounded down."""

    entries: np.ndarray
    moved: np.ndarray
    apart: np.ndarray


def books(entries: np.ndarray, before: np.ndarray | None = None) -> Books:
    moved = root_up(((entries - before) ** 2).sum(2)) if before is not None else np.zeros(entries.shape[:2], np.int64)
    return Books(entries, moved, np.stack([root(((e[:, None] - e[None]) ** 2).sum(2)) for e in entries]))


def nearest(x: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, upper and lower bounds of rows x for entries e, all distances computed."""
    d = ((x[:, None] - e[None]) ** 2).sum(2)
    own = d.argmin(1)  # the first of equal ones
    return own, root_up(d[np.arange(len(x)), own]), root(d)


def pruned(x: np.ndarray, e: np.ndarray, apart: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same from valid bounds (lower's entry for a row's own code is not used), and how many distances were computed."""
    own, upper, lower = own.copy(), upper.copy(), lower.copy()
    may = (lower <= upper[:, None]) & (apart[own] <= 2 * upper[:, None])
    may[np.arange(len(x)), own] = False
    rows = np.flatnonzero(may.any(1))
    if not len(rows):
        return own, upper, lower, 0
    mine, c = x[rows], own[rows]
    at = ((mine - e[c]) ** 2).sum(1)
    tight = root_up(at)
    may = may[rows] & (lower[rows] <= tight[:, None]) & (apart[c] <= 2 * tight[:, None])
    r, k = np.nonzero(may)
    found = ((mine[r] - e[k]) ** 2).sum(1)
    d = np.full(may.shape, _FAR)
    d[r, k], d[np.arange(len(rows)), c] = found, at
    lower[rows[r], k], lower[rows, c] = root(found), root(at)
    own[rows] = d.argmin(1)
    upper[rows] = root_up(d.min(1))
    return own, upper, lower, len(rows) + len(r)


def pack(upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Lower bounds as fifteen steps above upper - 1, two to a byte, rounded down."""
    base, step = upper[:, None] - 1, 1 + upper[:, None] // 8
    q4 = np.clip((lower - base) // step, 0, 15).astype(np.uint8)
    if q4.shape[1] % 2:
        q4 = np.pad(q4, ((0, 0), (0, 1)))
    return q4[:, 0::2] | q4[:, 1::2] << 4


def unpack(upper: np.ndarray, packed: np.ndarray, n: int) -> np.ndarray:
    q4 = np.empty((len(packed), 2 * packed.shape[1]), np.int64)
    q4[:, 0::2], q4[:, 1::2] = packed & 15, packed >> 4
    return upper[:, None] - 1 + (1 + upper[:, None] // 8) * q4[:, :n]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel(), kind))


def _blobs(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], pa.binary())


def whole(vectors: np.ndarray, parts: int) -> np.ndarray:
    """floor(256 * x) as whole numbers, filled up to a multiple of parts."""
    x = np.clip(np.floor(vectors.astype(np.float64) * 256), -MOST, MOST).astype(np.int64)
    return np.pad(x, ((0, 0), (0, -x.shape[1] % parts)))


def _first(book: Books, length: int, parts: int):
    """vec_id, label, v -> the written state after an assignment without bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = whole(_matrix(b.column("v"), length), parts)
                cut = x.reshape(len(x), parts, -1)
                found = [nearest(cut[:, p], book.entries[p]) for p in range(parts)]
                yield _state(b, _lists(x, pa.int32()), found)

    return run


def _state(b: pa.RecordBatch, x: pa.Array, found: list[tuple]) -> pa.RecordBatch:
    code, upper = np.stack([f[0] for f in found], 1).astype(np.uint8), np.stack([f[1] for f in found], 1)
    lower = np.concatenate([pack(f[1], f[2]) for f in found], 1)
    return pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), x, _blobs(code), _lists(upper, pa.int32()), _blobs(lower)], ["vec_id", "label", "x", "code", "upper", "lower"])


def _again(b: pa.RecordBatch, book: Books) -> tuple[np.ndarray, list[tuple]]:
    """The parts of a batch of states, and for each its new codes, upper and lower bounds."""
    parts, n, width = book.entries.shape
    x = _matrix(b.column("x"), parts * width).astype(np.int64).reshape(-1, parts, width)
    code, upper = _bytes(b.column("code"), parts).astype(np.int64), _matrix(b.column("upper"), parts).astype(np.int64)
    lower = _bytes(b.column("lower"), parts * ((n + 1) // 2)).reshape(len(x), parts, -1)
    found = []
    for p in range(parts):
        low = unpack(upper[:, p], lower[:, p], n) - book.moved[p]
        found.append(pruned(x[:, p], book.entries[p], book.apart[p], code[:, p], upper[:, p] + book.moved[p][code[:, p]], low)[:3])
    return x, found


def _next(book: Books):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _state(b, b.column("x"), _again(b, book)[1])

    return run


def _last(book: Books):
    """States -> vec_id, label, code in hex, error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, found = _again(b, book)
                code = np.stack([f[0] for f in found], 1)
                error = sum(((x[:, p] - book.entries[p][code[:, p]]) ** 2).sum(1) for p in range(code.shape[1]))
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([r.tobytes().hex() for r in code.astype(np.uint8)]), pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


def _sums(parts: int, n: int, width: int):
    """States -> for each part and entry: how many rows have it and the sums of their components; one set of rows a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, n, width + 1), np.int64)
        for b in batches:
            x, code = _matrix(b.column("x"), parts * width).astype(np.int64).reshape(-1, parts, width), _bytes(b.column("code"), parts)
            for p in range(parts):
                np.add.at(total[p, :, :width], code[:, p], x[:, p])
                total[p, :, width] += np.bincount(code[:, p], minlength=n)
        p, e = np.nonzero(total[:, :, width])
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), *(pa.array(total[p, e, i]) for i in range(width + 1))], ["part", "entry", *(f"s{i}" for i in range(width + 1))])

    return run


def _moved(state: DataFrame, entries: np.ndarray) -> np.ndarray:
    """Each entry's mean, rounded down; unused entries stay."""
    parts, n, width = entries.shape
    cols = [f"s{i}" for i in range(width + 1)]
    sums = state.select("x", "code").mapInArrow(_sums(parts, n, width), f"part int, entry int, {', '.join(f'{c} long' for c in cols)}")
    out = entries.copy()
    for r in sums.groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in cols)).collect():  # parts * entries rows at most
        out[r["part"], r["entry"]] = np.array([r[c] for c in cols[:-1]], np.int64) // r[cols[-1]]
    return out


def finite(vector: Column) -> Column:
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error for each kept row; codebooks as parts x entries x width whole numbers)."""
    spark = vectors.sparkSession
    small_batches(spark)
    raw = vectors.select(q(id_col).alias("vec_id"), q(label_col).alias("label"), q(vector_col).cast("array<double>").alias("v")).where(finite(F.col("v")))
    ids, labels = (raw.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    order = [F.asc_nulls_last("vec_id"), F.asc("v")]
    top = raw.orderBy(*order).limit(1).select(F.size("v")).first()
    if top is None:
        return spark.createDataFrame([], f"vec_id {ids}, label {labels}, code string, error long"), np.zeros((parts, 0, 0), np.int64)
    raw = raw.where(F.size("v") == top[0])
    seeds = np.array([r[0] for r in raw.orderBy(*order).limit(entries).select("v").collect()])
    x = whole(seeds, parts)
    at = np.ascontiguousarray(x.reshape(len(x), parts, -1).transpose(1, 0, 2))
    kinds = f"vec_id {ids}, label {labels}, x array<int>, code binary, upper array<int>, lower binary"
    with swept() as keep:
        state = materialize(raw.mapInArrow(_first(books(at), top[0], parts), kinds), "codes")
        for i in range(rounds):
            to = _moved(state, at)
            book, at = books(to, at), to
            if i + 1 < rounds:
                before, state = state, materialize(state.mapInArrow(_next(book), kinds), "codes")
                drop(before)
        if not rounds:
            book = books(at)
        out = materialize(state.mapInArrow(_last(book), f"vec_id {ids}, label {labels}, code string, error long"), "codes")
        keep.append(out)
    return out, at


def digest(coded: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """The contract's columns: the errors of equal labels together (nulls too), and a hash of all entries."""
    rows = coded.withColumns({"__null": F.col("label").isNull(), "__key": F.coalesce(F.col("label").cast("string"), F.lit(""))})
    sums = rows.groupBy("__null", "__key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    book = hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
    return spread_join(rows, sums, ["__null", "__key"], coded.count(), "n").select("vec_id", "code", "error", "label_error", F.lit(book).alias("codebooks_sha256"))

"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

A signature has chunks x width symbols of 16 bits (the low bits of MinHash values). By pigeonhole, of two signatures that
differ in at most (errors + 1) * chunks - 1 symbols one chunk differs in at most `errors`; so each signature is filed,
chunk by chunk, under the key of every way to leave `errors` symbols out. All pairs within that distance share a key.
With the defaults (16 chunks of 5, one error) the distance is 31 of 80: two sets of similarity 0.8 differ in 16 on
average and in more than 31 with a chance of 3e-5. Every pair within the distance is confirmed on the full shingle sets
of whole texts; the only thing that may spare it the look is a bound that no similar pair can fail.

No group is expanded into pairs. Equal sets are one node. Each key first links its members to the least of them (a star),
then those still in other components to a member drawn for the key. Only where a key's members are
apart even then do all of them meet, in blocks of bounded size inside a numpy kernel that puts out the pairs of different
components within the distance, each at the first key the two share. So no link between components is lost, while a
group of n copies costs in the order of n links. (A key of n members that are all apart costs in the order of n squared
comparisons of signatures, spread over all tasks.)

Nodes are sets, not ids, so rows that repeat an id with another text are in no way linked by it. Keys, sets and components
that a large share of the rows has are joined without a shuffle (`spread_join`).

Defined cases: null or empty texts and texts of white space have no shingles and no links. A text of fewer words than a
shingle is one shingle. A null id is linked with nothing (component null) and stays. Rows that repeat an id each take the
component of their own text; `stays` is true for one of them. Ids are of any type with an order. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import _words
from parley.llm._common import documents, drop, materialize, row_key, salted_join, small_batches, spread_join
from parley.operators.graph import connected


def shingle_sets(w: _words.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, and the documents' bounds in them."""
    g, at = _words.grams(w, k)
    n_words, n_grams = np.diff(w.at), np.diff(at)
    short = np.flatnonzero((n_grams == 0) & (n_words > 0))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for x, d in enumerate(short):
            acc = np.uint64(0)
            with np.errstate(over="ignore"):
                for h in w.hash[w.at[d] : w.at[d + 1]]:
                    acc = acc * np.uint64(0xA24BAED4963EE407) + h
            whole[x] = acc
        g = np.insert(g, at[short], _words.mix(whole + np.uint64(1)))
        n_grams = n_grams.copy()
        n_grams[short] = 1
        at = np.concatenate([[0], np.cumsum(n_grams)])
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a > 1:
            g[a:b].sort()
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    new[at[:-1][n_grams > 0]] = True
    return g[new], np.concatenate([[0], np.cumsum(new)])[at]


class Signer:
    """MinHash signatures (16-bit symbols) and the keys of their chunks."""

    def __init__(self, chunks: int, width: int, errors: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.width, self.size = width, chunks * width
        self.mul = rng.integers(0, 1 << 31, self.size, np.uint32) * np.uint32(2) + np.uint32(1)
        self.add = rng.integers(0, 1 << 32, self.size, np.uint32)
        #: What each key leaves in, in the order of `part`: chunk by chunk, all ways to leave `errors` symbols out.
        self.left_out = list(combinations(range(width), errors))
        self.parts = [[c * width + i for i in range(width) if i not in out] for c in range(chunks) for out in self.left_out]
        self.salt = _words.mix(rng.integers(0, 1 << 63, len(self.parts), np.uint64))

    def signature(self, sets: np.ndarray, at: np.ndarray) -> np.ndarray:
        h = (sets >> np.uint64(32)).astype(np.uint32)
        out = np.empty((len(at) - 1, self.size), np.uint32)
        for k in range(self.size):
            out[:, k] = np.minimum.reduceat(h * self.mul[k] + self.add[k], at[:-1])
        return (out * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)

    def keys(self, sig: np.ndarray) -> np.ndarray:
        out = np.empty((len(sig), len(self.parts)), np.uint64)
        for x, part in enumerate(self.parts):
            acc = np.full(len(sig), self.salt[x])
            for i in part:
                acc = (acc ^ sig[:, i].astype(np.uint64)) * np.uint64(0x9FB21C651E98DF25)
                acc ^= acc >> np.uint64(29)
            out[:, x] = _words.mix(acc)
        return out.view(np.int64)

    def first_shared(self, a: np.ndarray, b: np.ndarray, errors: int) -> tuple[np.ndarray, np.ndarray]:
        """(distance, part) of rows of two signature tables: the first key that both are filed under, -1 without one."""
        differ = (a != b).reshape(len(a), self.size // self.width, self.width)
        per = differ.sum(2)
        able = per <= errors
        chunk = able.argmax(1)
        inside = differ[np.arange(len(a)), chunk]
        part = np.full(len(a), -1)
        for m in reversed(range(len(self.left_out))):
            out = np.zeros(self.width, bool)
            out[list(self.left_out[m])] = True
            part = np.where(~(inside & ~out).any(1), chunk * len(self.left_out) + m, part)
        return per.sum(1), np.where(able.any(1), part, -1)


def _blobs(m: np.ndarray) -> pa.Array:
    """A binary array of the rows of a table of bytes."""
    m = np.ascontiguousarray(m).view(np.uint8).reshape(len(m), -1)
    at = np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]
    return pa.BinaryArray.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(at), pa.py_buffer(m.reshape(-1))])


def _table(blobs: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.to_pylist()), kind).reshape(-1, width)


def _sign(shingle: int, signer: Signer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, w in _words.chunks(b.column("text"), fold=True):
                sets, at = shingle_sets(w, shingle)
                n = np.diff(at)
                full = np.flatnonzero(n)
                s1, s2 = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
                keys = np.zeros((0, len(signer.parts)), np.int64)
                if len(full):
                    first = at[:-1][full]
                    s1[full] = np.add.reduceat(_words.mix(sets ^ np.uint64(0x5851F42D4C957F2D)), first)
                    s2[full] = np.add.reduceat(_words.mix(sets ^ np.uint64(0x14057B7EF767814F)), first)
                    keys = signer.keys(signer.signature(sets, np.append(first, len(sets))))
                sizes = np.zeros(j - i, np.int32)
                sizes[full] = keys.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[i:j], b.column("rk")[i:j], pa.array(n, pa.int64()), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), lists], ["doc_id", "rk", "n_shingles", "s1", "s2", "keys"])

    return run


def _signatures(shingle: int, signer: Signer):
    """Texts with their signatures, and their sets as sorted 16-bit prints (n: the sets' sizes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, w in _words.chunks(b.column("text"), fold=True):
                sets, at = shingle_sets(w, shingle)
                full = np.flatnonzero(np.diff(at))
                sig = np.zeros((j - i, signer.size), np.uint16)
                if len(full):
                    sig[full] = signer.signature(sets, np.append(at[:-1][full], len(sets)))
                prints = [np.unique((sets[x:y] >> np.uint64(16)).astype(np.uint16)).tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("node")[i:j], b.column("text")[i:j], _blobs(sig), pa.array(np.diff(at), pa.int64()), pa.array(prints, pa.binary())], ["node", "text", "sig", "n", "prints"])

    return run


def _near(signer: Signer, most: int):
    """Keeps the rows (u, v) whose signatures are within the distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = (_table(b.column(x), np.uint16, signer.size) for x in ("ku", "kv"))
            yield b.select(["u", "v"]).filter(pa.array((a != c).sum(1) <= most))

    return run


def _bitmaps(prints: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """2**16 bits for each set of prints, and how many are set."""
    out = np.zeros((len(prints), 1 << 16), bool)
    for k, x in enumerate(prints):
        out[k, np.frombuffer(x or b"", np.uint16)] = True
    return np.packbits(out, axis=1).view(np.uint64), out.sum(1)


def _meet(signer: Signer, errors: int, most: int, percent: int):
    """Blocks of members of one key -> pairs (u, v) of different components within the distance, each pair once.

    part, a, b: members as list<struct<node, comp, sig, n, prints>>; b is null where a block meets itself. Where
    members bring their prints (they do in large keys), the number of prints two sets share, and of shingles that fell
    on one print, bounds the sets' intersection from above: a pair that the bound keeps below the similarity goes."""

    def flat(column: pa.Array) -> tuple:
        sizes = column.value_lengths().fill_null(0).to_numpy()
        m = column.flatten()
        return (np.concatenate([[0], np.cumsum(sizes)]), m.field("node").to_numpy(), m.field("comp").to_numpy(), _table(m.field("sig"), np.uint16, signer.size), m.field("n").to_numpy(), m.field("prints").to_pylist())

    def able(i: np.ndarray, j: np.ndarray, a: list, b: list) -> np.ndarray:
        """Pairs that can be similar by their prints; those without prints can."""
        has = np.array([a[4][x] is not None and b[4][y] is not None for x, y in zip(i, j, strict=True)], bool)
        ok = np.ones(len(i), bool)
        told = np.flatnonzero(has)
        for s in range(0, len(told), 1 << 10):
            k = told[s : s + (1 << 10)]
            (ui, ri), (uj, rj) = (np.unique(x[k], return_inverse=True) for x in (i, j))
            (ba, pa_), (bb, pb) = _bitmaps([a[4][x] for x in ui]), _bitmaps([b[4][y] for y in uj])
            shared = np.bitwise_count(ba[ri] & bb[rj]).sum(1).astype(np.int64)
            na, nb = a[3][i[k]], b[3][j[k]]
            both = np.minimum(shared + np.minimum(na - pa_[ri], nb - pb[rj]), np.minimum(na, nb))
            ok[k] = 100 * both >= percent * (na + nb - both)
        return ok

    def judged(parts, i, j, a, b) -> Iterator[pa.RecordBatch]:
        u, v = a[0][i], b[0][j]
        ok = np.flatnonzero((u != v) & (a[1][i] != b[1][j]))
        for s in range(0, len(ok), 1 << 14):
            k = ok[s : s + (1 << 14)]
            d, part = signer.first_shared(a[2][i[k]], b[2][j[k]], errors)
            k = k[(d <= most) & (part == parts[k])]
            k = k[able(i[k], j[k], a, b)]
            if len(k):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u[k], v[k])), pa.array(np.maximum(u[k], v[k]))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (at, *a), (bt, *b) = flat(batch.column("a")), flat(batch.column("b"))
            own = batch.column("b").is_null().to_numpy(zero_copy_only=False)
            parts = batch.column("part").to_numpy()
            for alone in (True, False):
                held, n = [], 0
                rows = np.flatnonzero(own == alone)
                for x, r in enumerate(rows):
                    size = at[r + 1] - at[r]
                    i, j = np.triu_indices(size, 1) if alone else (np.repeat(np.arange(size), bt[r + 1] - bt[r]), np.tile(np.arange(bt[r + 1] - bt[r]), size))
                    held.append((np.full(len(i), parts[r]), i + at[r], j + (at[r] if alone else bt[r])))
                    n += len(i)
                    if n > 1 << 18 or x + 1 == len(rows):
                        yield from judged(*map(np.concatenate, zip(*held, strict=True)), a, a if alone else b)
                        held, n = [], 0

    return run


def _confirm(shingle: int, percent: int):
    """Keeps the rows (u, v) whose texts' full shingle sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (da, oa), (db, ob) = _words.buffers(b.column("tu")), _words.buffers(b.column("tv"))
            ok, i, n = np.zeros(b.num_rows, bool), 0, b.num_rows
            while i < n:
                size = (oa[i:] - oa[i]) + (ob[i:] - ob[i])
                j = min(n, max(i + 1, i + int(np.searchsorted(size, _words.CHUNK, "right")) - 1))
                (sa, pa_), (sb, pb) = (shingle_sets(_words.split(d, o[i : j + 1], True), shingle) for d, o in ((da, oa), (db, ob)))
                for r in range(j - i):
                    x, y = sa[pa_[r] : pa_[r + 1]], sb[pb[r] : pb[r + 1]]
                    if len(x) and len(y):
                        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                        both = int((y[at] == x).sum())
                        ok[i + r] = 100 * both >= percent * (len(x) + len(y) - both)
                i = j
            yield b.select(["u", "v"]).filter(pa.array(ok))

    return run


#: Bytes of signatures and prints that a block of members has on average, at most.
BLOCK_BYTES = 8 << 20


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, chunks: int = 16, width: int = 5, errors: int = 1, block: int = 1024, crowd: int = 32) -> DataFrame:
    """doc_id, rk, n_shingles, component_id, kept, stays for each row of docs.

    kept: the id is the component's; stays: so is the text, where ids repeat. block: members of a key that meet at once, fewer
    where they have more than BLOCK_BYTES.
    crowd: in keys of more members, these bring the prints of their whole sets, which rule pairs out without a look at the texts."""
    small_batches(docs.sparkSession)
    most = (errors + 1) * chunks - 1
    signer = Signer(chunks, width, errors)
    raw = documents(docs, id_col, text_col).select("doc_id", row_key(F.col("text")).alias("rk"), "text")
    kind = raw.schema["doc_id"].dataType.simpleString()
    signed = materialize(raw.mapInArrow(_sign(shingle, signer), f"doc_id {kind}, rk long, n_shingles long, s1 long, s2 long, keys array<long>"), "signatures")
    # equal sets are one node, shown by the text of the least id
    sets = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = sets.groupBy("s1", "s2", "n_shingles").agg(F.min(F.struct("doc_id", "rk")).alias("first"), F.any_value("keys").alias("keys"), F.count(F.lit(1)).alias("c"))
    nodes = materialize(reps.withColumn("node", F.monotonically_increasing_id()), "nodes")  # the numbers are as written
    rows = materialize(signed.select("doc_id", "rk", "n_shingles", "s1", "s2"), "rows")
    drop(signed)

    filed = nodes.select("node", F.col("n_shingles").alias("size"), F.posexplode("keys").alias("part", "key"))
    shared = materialize(filed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("c")).where("lo < hi"), "keys")
    members = materialize(spread_join(filed, shared, ["key"], nodes.count() * len(signer.parts), "c"), "members")
    n_members = members.count()
    ids = materialize(members.select(F.col("node").alias("m")).distinct(), "member-ids")
    first = nodes.join(ids, F.col("node") == F.col("m"), "left_semi").select("node", F.col("first.doc_id").alias("i"), F.col("first.rk").alias("k"))
    shown = raw.join(first, (raw["doc_id"] == F.col("i")) & (raw["rk"] == F.col("k"))).dropDuplicates(["i", "k"]).select("node", "text")
    texts = materialize(shown.mapInArrow(_signatures(shingle, signer), "node long, text string, sig binary, n long, prints binary"), "candidate-texts")
    sigs = texts.select("node", "sig")

    def near(pairs: DataFrame) -> DataFrame:
        """Pairs (u, v) within the distance. v is a hub, of any number of pairs; signatures are short, so those of hubs are
        broadcast. u has a pair for each of its keys at most."""
        pairs = materialize(pairs, "pairs")
        hubs = pairs.groupBy("v").agg(F.count(F.lit(1)).alias("__n")).join(sigs.select(F.col("node").alias("v"), F.col("sig").alias("kv")), "v")
        both = spread_join(pairs, materialize(hubs, "hub-signatures"), ["v"], pairs.count(), "__n").join(sigs.select(F.col("node").alias("u"), F.col("sig").alias("ku")), "u")
        return both.select("u", "v", "ku", "kv").mapInArrow(_near(signer, most), "u long, v long")

    def confirmed(pairs: DataFrame, any_hub: bool = False) -> DataFrame:
        """Links among pairs (u, v), on the full shingle sets of whole texts; the text of a hub v goes once to each thousand of its
        pairs. any_hub: u may be one too."""
        pairs = materialize(pairs, "near-pairs")
        tu, tv = (texts.select(F.col("node").alias(c), F.col("text").alias(t)) for c, t in (("u", "tu"), ("v", "tv")))
        one = salted_join(pairs, tv, "v", "u")
        both = salted_join(materialize(one, "pair-texts"), tu, "u", "v") if any_hub else one.join(tu, "u")
        return materialize(both.select("u", "v", "tu", "tv").mapInArrow(_confirm(shingle, percent), "u long, v long"), "confirmed")

    def grouped(links: DataFrame) -> DataFrame:
        return materialize(connected(links.select(F.col("u").alias("a"), F.col("v").alias("b"))).withColumnRenamed("component", "comp"), "components")

    def placed(comps: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Members with their component, and the keys whose members are in several, with their number of members."""
        own = members.select("key", "part", "node", "size").join(comps, "node", "left").select("key", "part", "node", "size", F.coalesce("comp", "node").alias("comp"))
        own = materialize(own, "placed")
        mixed = own.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count(F.lit(1)).alias("n"), F.sum(F.least(F.col("size"), F.lit(1 << 16)) * 2 + 4 * signer.size).alias("bytes"), F.max(F.struct(F.xxhash64("node", "key"), "node", "comp")).alias("hub")).where("a < b")
        return own, materialize(mixed.select("key", "n", F.ceil(F.greatest(F.col("n") / block, F.col("bytes") / BLOCK_BYTES)).alias("blocks"), (F.col("n") > crowd).alias("many"), F.col("hub.node").alias("hub"), F.col("hub.comp").alias("hub_comp")), "mixed-keys")

    # 1. a star in each key about its least member
    star = members.where("node > lo").select(F.col("node").alias("u"), F.col("lo").alias("v")).distinct()
    links = confirmed(near(star))
    comps = grouped(links)
    # 2. another in the keys whose members are still apart, about a member of each key's own: members get many hubs
    own, mixed = placed(comps)
    again = spread_join(own, mixed, ["key"], n_members, "n").where("comp <> hub_comp").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct()
    more = confirmed(near(again))
    drop(own)
    if not more.isEmpty():
        links = links.unionByName(more)
        comps = grouped(links)
    # 3. what is still apart: all members of a key meet, block by block
    own, mixed = placed(comps)
    dealt = spread_join(own, mixed, ["key"], n_members, "n").withColumn("blk", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = dealt.join(texts.select("node", "sig", "n", "prints"), "node")
    member = F.struct("node", "comp", "sig", "n", F.when(F.col("many"), F.col("prints")).alias("prints"))
    blocks = materialize(dealt.groupBy("key", "part", "blocks", "blk").agg(F.collect_list(member).alias("a")), "blocks")
    alone = blocks.select("part", "a", F.lit(None).cast(blocks.schema["a"].dataType).alias("b"))
    left = blocks.where("blk + 1 < blocks").select("key", "part", "a", F.explode(F.sequence(F.col("blk") + 1, F.col("blocks") - 1)).alias("other"))
    right = blocks.where("blk > 0").select("key", F.col("blk").alias("other"), F.col("a").alias("b"))
    meeting = alone.unionByName(left.join(right, ["key", "other"]).select("part", "a", "b"))
    rest = materialize(meeting.mapInArrow(_meet(signer, errors, most, percent), "u long, v long").distinct(), "unsettled-pairs")
    drop(own)
    drop(blocks)
    if not rest.isEmpty() and not (more := confirmed(rest, any_hub=True)).isEmpty():
        comps = grouped(links.unionByName(more))

    # a component is named by the least id in it
    named = materialize(nodes.drop("keys").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "named")
    least = materialize(named.groupBy("comp").agg(F.min("first").alias("top"), F.count(F.lit(1)).alias("n")), "least")
    of = materialize(spread_join(named, least, ["comp"], nodes.count(), "n").select("s1", "s2", "n_shingles", "c", "top"), "set-components")
    linked = F.coalesce((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.lit(False))
    found = spread_join(rows.where(linked), of, ["s1", "s2", "n_shingles"], rows.count(), "c")
    found = found.select("doc_id", "rk", "n_shingles", F.col("top.doc_id").alias("component_id"), (F.col("doc_id") == F.col("top.doc_id")).alias("kept"), ((F.col("doc_id") == F.col("top.doc_id")) & (F.col("rk") == F.col("top.rk"))).alias("stays"))
    return found.unionByName(rows.where(~linked).select("doc_id", "rk", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(True).alias("stays")))


def keep_one(docs: DataFrame, verdicts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: one document of each component, all its rows where it is repeated."""
    stay = verdicts.where("stays").select(F.col("doc_id").alias("__id"), F.col("rk").alias("__rk")).distinct()
    return docs.join(stay, docs[id_col].eqNullSafe(stay["__id"]) & (row_key(docs[text_col]) == stay["__rk"]), "left_semi")

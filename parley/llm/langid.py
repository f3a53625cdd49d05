"""Language identification by bit-sliced Bloom filters of byte n-grams.

Row p of the filter is a bitmask with one bit per language, so one look-up of an n-gram's few rows and their conjunction
returns all languages that contain it. A text's score for a language is the share of its n-grams that the language
contains, corrected for the filter's rate of false positives; n-grams that fewer languages share weigh more. Per text,
n-grams are counted by mask, so weights and popcounts are taken once for each mask. The filter's answers for all 2- and
3-grams are looked up ahead, once in a process, where 64 bits hold the languages.

The n-gram sets are learned from a bounded sample of labelled rows (`sample` rows at most on average, an equal share for
each language and all rows of one that has fewer, drawn by a hash of the id); those that at least `min_share` of a language's sampled texts contain are kept, so the model's size does not
follow the corpus. Every text is scored whole.

Defined cases: a null text, or one without a letter, is `und` with score 0. Ties go to the language that sorts first, also
at score 0 where none of a text's n-grams is known; keep() rejects such a text. Without labelled rows everything is `und`.
Rows are independent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import _words
from parley.llm._common import documents, row_key, small_batches

ORDERS = (2, 3, 5)
#: Symbols of n-grams: A-Z and a-z 1 to 26, bytes above ASCII 27 to 154, all else a space, 0.
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[ord("A") : ord("Z") + 1] = _SYMBOL[ord("a") : ord("z") + 1] = np.arange(1, 27)
_SYMBOL[128:] = np.arange(27, 155)
_BASE = 155


def symbols(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the documents, runs of spaces as one, and the documents' bounds in them."""
    lo, hi = int(at[0]), int(at[-1])
    s = _SYMBOL[data[lo:hi]]
    again = np.zeros(len(s), bool)
    again[1:] = (s[1:] == 0) & (s[:-1] == 0)
    first = at[:-1] - lo
    again[first[first < len(s)]] = False
    return s[~again], np.concatenate([[0], np.cumsum(~again)])[at - lo]


def _codes(s: np.ndarray, n: int) -> np.ndarray:
    """A number for the n symbols from each place on."""
    out = s.astype(np.int64)
    for j in range(1, n):
        out = out[:-1] * _BASE + s[j:]
    return out if len(s) >= n else out[:0]


def _hashed(code: np.ndarray, n: int) -> np.ndarray:
    return _words.mix(code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n))


def _starts(bounds: np.ndarray, n: int) -> np.ndarray:
    """For each place: the document in which n symbols from there on lie, or the number of documents."""
    docs = len(bounds) - 1
    out = np.repeat(np.arange(docs), np.diff(bounds))[: max(int(bounds[-1]) - n + 1, 0)]
    for j in range(1, n):
        late = bounds[1:] - j
        out[late[(late >= bounds[:-1]) & (late < len(out))]] = docs
    return out


def ngrams(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the n-grams inside documents."""
    s, bounds = symbols(data, at)
    doc, code = _starts(bounds, n), _codes(s, n)
    ok = np.flatnonzero(doc < len(at) - 1)
    return doc[ok], _hashed(code[ok], n)


def _batches(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, at = _words.buffers(column)
    n, i = len(at) - 1, 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(at, at[i] + _words.CHUNK, "right")) - 1))
        yield i, j, data, at[i : j + 1]
        i = j


@dataclass
class Model:
    """languages by name; rows[p, l // 64] has bit l % 64 where language l has position p set; rates of false positives."""

    languages: list[str]
    rows: np.ndarray
    wrong: np.ndarray
    probes: int
    memo: dict[int, np.ndarray] = field(default_factory=dict, repr=False)

    def member(self, h: np.ndarray) -> np.ndarray:
        """Bitmask of the languages that contain each n-gram (all of them, and now and then one more)."""
        size = np.uint64(len(self.rows) - 1)
        step = (h >> np.uint64(32)) | np.uint64(1)
        out = self.rows[(h & size).astype(np.int64)]
        for k in range(1, self.probes):
            out = out & self.rows[((h + step * np.uint64(k)) & size).astype(np.int64)]
        return out

    def masks(self, code: np.ndarray, n: int) -> np.ndarray:
        """member() of n-grams by their codes."""
        if n > 3 or self.rows.shape[1] > 1:
            return self.member(_hashed(code, n))
        if n not in self.memo:
            kind = np.min_scalar_type((1 << len(self.languages)) - 1)
            every = range(0, _BASE**n, 1 << 18)
            self.memo[n] = np.concatenate([self.member(_hashed(np.arange(a, min(a + (1 << 18), _BASE**n)), n)).astype(kind) for a in every])
        return self.memo[n][code]

    def score(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language number or -1, score) of each document."""
        docs, langs = len(at) - 1, len(self.languages)
        if not langs:
            return np.full(docs, -1), np.zeros(docs)
        s, bounds = symbols(data, at)
        rows, masks = [], []
        for n in ORDERS:
            rows.append(_starts(bounds, n))
            masks.append(self.masks(_codes(s, n), n))
        if langs <= 8:  # a mask is its own number
            known = np.arange(256, dtype=np.uint64)[:, None]
            places = [m[:, 0].astype(np.int64) for m in masks]
        else:
            known, place = np.unique(np.concatenate([m.astype(np.uint64) for m in masks]), axis=0, return_inverse=True)
            places = np.split(place.reshape(-1), np.cumsum([len(m) for m in masks])[:-1])
        size = max(len(known), 1)
        counts = sum(np.bincount(r * size + p, minlength=(docs + 1) * size) for r, p in zip(rows, places, strict=True)).reshape(docs + 1, size)[:docs, : len(known)]
        has = np.stack([(known[:, x // 64] >> np.uint64(x % 64)) & np.uint64(1) for x in range(langs)], 1).astype(float)
        weight = 1.0 / np.maximum(has.sum(1), 1)  # an n-gram that nobody knows counts against all
        total, hits = counts @ weight, counts @ (has * weight[:, None])
        seen = hits / np.maximum(total, 1e-9)[:, None]
        right = np.clip((seen - self.wrong) / (1 - self.wrong), 0, 1)
        best = right.argmax(1)
        top = right[np.arange(docs), best]
        return np.where(top > 0, best, -1), top


def build(grams: dict[str, np.ndarray], probes: int = 4, bits_each: int = 12) -> Model:
    """The filter of each language's n-gram hashes."""
    langs = sorted(grams)
    most = max([len(g) for g in grams.values()] + [1])
    size = 1 << max(10, int(np.ceil(np.log2(most * bits_each))))
    rows = np.zeros((size, max(1, -(-len(langs) // 64))), np.uint64)
    for x, name in enumerate(langs):
        h = grams[name]
        step = (h >> np.uint64(32)) | np.uint64(1)
        for k in range(probes):
            rows[((h + step * np.uint64(k)) & np.uint64(size - 1)).astype(np.int64), x // 64] |= np.uint64(1 << (x % 64))
    fill = np.array([((rows[:, x // 64] >> np.uint64(x % 64)) & np.uint64(1)).mean() for x in range(len(langs))])
    return Model(langs, rows, fill**probes, probes)


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, h, n: in how many texts of a batch each n-gram occurs (order 0: the number of texts)."""
    for b in batches:
        langs = b.column("lang").to_pylist()
        names = {x: k for k, x in enumerate(sorted(set(langs)))}
        of = np.array([names[x] for x in langs], np.int64)
        back = pa.array(sorted(names))
        for i, j, data, at in _batches(b.column("text")):
            for n in ORDERS:
                doc, h = ngrams(data, at, n)
                if not len(h):
                    continue
                order = np.lexsort((h, doc))
                doc, h = doc[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
                lang, h = of[i:j][doc[new]], h[new]
                order = np.lexsort((h, lang))
                lang, h = lang[order], h[order]
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (lang[1:] != lang[:-1])
                at_first = np.flatnonzero(first)
                yield pa.RecordBatch.from_arrays([back.take(pa.array(lang[at_first])), pa.array(h[at_first].view(np.int64)), pa.array(np.diff(np.append(at_first, len(h))))], ["lang", "h", "n"])


def shares(have: dict[str, int], sample: int) -> dict[str, float]:
    """How many rows of each language to learn from: equal shares of the bound; what a language lacks goes to the larger ones."""
    out: dict[str, float] = {}
    for k, (lang, n) in enumerate(sorted(have.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(n, (sample - sum(out.values())) / (len(have) - k))
    return out


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 40_000, min_share: float = 0.02) -> Model:
    """The model of the labelled rows. sample: bound on the rows learned from (an average; drawn by a hash of id and text)."""
    small_batches(labelled.sparkSession)
    rows = documents(labelled, id_col, text_col, lang=lang_col).where("lang IS NOT NULL AND text IS NOT NULL")
    have = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if sum(have.values()) > sample:
        take = shares(have, sample)
        most = F.lit(None).cast("long")
        for lang, n in have.items():
            most = F.when(F.col("lang") == lang, F.lit(int((1 << 30) * (take[lang] / n)))).otherwise(most)
        rows = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < most)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = rows.select("lang", "text").mapInArrow(_learn, "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))
    # a text of average length has some thousand n-grams, so at most that / min_share reach it in a language
    least = F.lit(None).cast("double")
    for lang, m in sizes.items():
        least = F.when(F.col("lang") == lang, F.lit(max(2.0 if m > 20 else 1.0, min_share * m))).otherwise(least)
    kept = counts.where(F.col("n") >= least).select("lang", "h").toArrow()
    names = np.array(kept.column("lang").to_pylist(), object)
    hashes = kept.column("h").to_numpy().view(np.uint64)
    return build({lang: hashes[names == lang] for lang in sizes})


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, rk, lang_pred, score for each row of docs."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = pa.array([*m.languages, "und"])
        for b in batches:
            letter = b.column("letter").to_numpy(zero_copy_only=False).astype(bool)
            for i, j, data, at in _batches(b.column("text")):
                best, score = m.score(data, at)
                if m.languages:
                    best = np.maximum(best, 0)  # no known n-gram: all tie at 0
                best = np.where(letter[i:j], best, -1)
                pick = pa.array(np.where(best < 0, len(m.languages), best))
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[i:j], b.column("rk")[i:j], names.take(pick), pa.array(np.where(best < 0, 0.0, score))], ["doc_id", "rk", "lang_pred", "score"])

    raw = documents(docs, id_col, text_col)
    kind = raw.schema["doc_id"].dataType.simpleString()
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return raw.select("doc_id", row_key(F.col("text")).alias("rk"), letter.alias("letter"), "text").mapInArrow(run, f"doc_id {kind}, rk long, lang_pred string, score double")


def keep(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose language is known with a score of `least` or more.

    A model without languages can reject nothing: all rows stay."""
    if not model.languages:
        return docs
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    letter = F.coalesce(docs[text_col].rlike(r"\p{L}"), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            ok = b.columns[-1].to_numpy(zero_copy_only=False).astype(bool)
            for i, j, data, bounds in _batches(b.columns[at]):
                best, score = m.score(data, bounds)
                ok[i:j] &= (best >= 0) & (score >= least)
            yield pa.RecordBatch.from_arrays(b.columns[:-1], schema=pa.schema(list(b.schema)[:-1])).filter(pa.array(ok))

    return docs.select("*", letter.alias("__letter")).mapInArrow(run, docs.schema)

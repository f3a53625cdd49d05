"""What SQL text can call: table functions over whole tables, and the scalar functions of this package.

register() makes them known to a session:

    SELECT * FROM split_sentences(TABLE(SELECT doc_id AS id, text FROM documents))
    SELECT edit_distance(a, b) FROM pairs
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from parley.functions import arrow
from parley.operators.segment import split_sentences


@F.arrow_udtf(returnType="id string, number int, start int, end int, sentence string")
class SplitSentences:
    """A table of id and text -> a row for each sentence, with its place in the text. Null and empty texts have none."""

    def eval(self, batch: pa.RecordBatch):
        rows = [(str(i), k, a, b, t[a:b]) for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True) if t for k, (a, b) in enumerate(split_sentences(t))]
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
        yield pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["id", "number", "start", "end", "sentence"])


@F.arrow_udtf(returnType="id string, op string, ref_start int, ref_end int, hyp_start int, hyp_end int")
class AlignedRuns:
    """A table of id, ref and hyp (texts) -> the runs of their word alignment."""

    def eval(self, batch: pa.RecordBatch):
        rows = []
        for i, r, h in zip(*(batch.column(c).to_pylist() for c in ("id", "ref", "hyp")), strict=True):
            rows += [(str(i), *run) for run in arrow.edit_ops((r or "").split(), (h or "").split())]
        kinds = (pa.string(), pa.string(), *[pa.int32()] * 4)
        yield pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["id", "op", "ref_start", "ref_end", "hyp_start", "hyp_end"])


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL in this session."""
    spark.udtf.register("split_sentences", SplitSentences)
    spark.udtf.register("aligned_runs", AlignedRuns)
    for name in ("edit_distance", "match_ratio", "nfkc", "identity_key"):
        spark.udf.register(name, getattr(arrow, name))

"""Readers of transcript, hypothesis, sample and audio files."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HYPOTHESIS = "filename string, status string, transcription string, segments array<struct<start:double,end:double,text:string>>"


def _stem(path, suffix: str):
    return F.regexp_extract(path, rf"([^/]+)\.{suffix}$", 1)


def read_sample(spark: SparkSession, path: str, key: str = "item_uuid") -> DataFrame:
    """A CSV with a header (a byte-order mark is dropped); a key that occurs twice is an error, found by aggregation."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    df = df.toDF(*(c.removeprefix("﻿") for c in df.columns))
    if key in df.columns and (twice := df.groupBy(key).count().where("count > 1").first()):
        raise ValueError(f"{key} {twice[0]!r} occurs {twice[1]} times")
    return df


def read_hypotheses(spark: SparkSession, root: str) -> DataFrame:
    """root/<system>/<doc>.json -> system, doc, transcription, segments."""
    path = F.col("_metadata.file_path")
    df = spark.read.schema(HYPOTHESIS).option("multiLine", True).json(f"{root}/*/*.json")
    return df.select(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("system"), _stem(path, "json").alias("doc"), F.coalesce("transcription", F.lit("")).alias("transcription"), "segments")


def read_references(spark: SparkSession, root: str) -> DataFrame:
    """root/<eid>_<role>.txt -> doc, eid, role, line, text; blank lines are left out, lines stay numbered from 0 without them."""
    df = spark.read.text(f"{root}/*.txt", wholetext=True).select(_stem(F.col("_metadata.file_path"), "txt").alias("doc"), "value")
    full = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    return df.select("doc", F.split_part("doc", F.lit("_"), F.lit(1)).alias("eid"), F.split_part("doc", F.lit("_"), F.lit(2)).alias("role"), F.posexplode(full).alias("line", "text"))


@F.arrow_udf(T.ArrayType(T.FloatType()))
def wav_samples(content: pa.Array) -> pa.Array:
    """16 kHz mono 16-bit audio as floats in [-1, 1); other formats are errors."""
    import numpy as np

    rows = []
    for b in content.to_pylist():
        with wave.open(io.BytesIO(b)) as w:
            if (w.getframerate(), w.getnchannels(), w.getsampwidth()) != (16000, 1, 2):
                raise ValueError("16 kHz mono 16-bit audio is needed")
            rows.append(np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float32) / 32768)
    return pa.array(rows, pa.list_(pa.float32()))


def read_audio(spark: SparkSession, root: str) -> DataFrame:
    """doc, rate, channels, width, hours from the headers of root/*.wav."""
    paths = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(root).select("path")  # no content is read

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path in b.column("path").to_pylist():
                files, p = fs.FileSystem.from_uri(path)
                with files.open_input_file(p) as f, wave.open(f) as w:
                    rows.append((path, w.getframerate(), w.getnchannels(), w.getsampwidth(), w.getnframes() / w.getframerate() / 3600))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], ["path", "rate", "channels", "width", "hours"])

    found = paths.mapInArrow(run, "path string, rate int, channels int, width int, hours double")
    return found.select(_stem(F.col("path"), "wav").alias("doc"), "rate", "channels", "width", "hours")


def with_override(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Union in which rows of the second replace those of the first with the same key."""
    return first.join(second.select(key), key, "left_anti").unionByName(second)


def todo(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Inputs that have no output yet: an incremental run does only those."""
    return inputs.join(outputs.select(key).distinct(), key, "left_anti")

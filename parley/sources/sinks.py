"""Writers: CSV with JSON cells, several views of one table, tables for people."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.operators.evaluation import prediction_text


def json_cells(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The given fields in order, others dropped, missing ones null; arrays, maps and structs as JSON text."""
    have = {f.name: f.dataType for f in df.schema}
    out = []
    for c in fields:
        if c not in have:
            out.append(F.lit(None).cast("string").alias(c))
        elif isinstance(have[c], (T.ArrayType, T.MapType, T.StructType)):
            out.append(F.to_json(c).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, fields: Sequence[str] | None = None, single: bool = False) -> None:
    """A CSV folder with a header; single: one file, for tables that people open."""
    out = json_cells(df, fields or df.columns)
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_sample(sample: DataFrame, root: str, fields: Sequence[str], blinded: Sequence[str], report: DataFrame | None = None, summary: dict | None = None) -> None:
    """Master, a folder per split, the blinded view in order of presentation, report and summary from one table."""
    sample = sample.persist()
    try:
        write_csv(sample, f"{root}/sample", fields, single=True)
        json_cells(sample.withColumn("part", F.col("split")), [*fields, "part"]).write.mode("overwrite").partitionBy("part").option("header", True).csv(f"{root}/by_split")
        write_csv(sample.orderBy("presentation_order"), f"{root}/blinded", blinded, single=True)
        if report is not None:
            write_csv(report, f"{root}/report", single=True)
        if summary is not None:
            df = sample.sparkSession.createDataFrame([(json.dumps(summary, sort_keys=True, ensure_ascii=False),)], "value string")
            df.coalesce(1).write.mode("overwrite").text(f"{root}/summary")
    finally:
        sample.unpersist()


def write_by_split(tables: dict[str, DataFrame], root: str) -> None:
    """Aggregation outputs: each table as JSON lines, whole (all) and in a folder per split; rows keep their split."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{root}/{name}/all")
        df.withColumn("part", F.col("split")).write.mode("overwrite").partitionBy("part").json(f"{root}/{name}/by_split")


def write_json(value: dict, spark: SparkSession, path: str) -> None:
    """A report as one JSON file in a folder, keys in order."""
    text = json.dumps(value, sort_keys=True, ensure_ascii=False, indent=2)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_evaluation(rows: DataFrame, scored: DataFrame, table: DataFrame, root: str, task: str) -> None:
    """Predictions as text, a folder per model; metrics as JSON lines; the comparison as JSON lines and CSV."""
    block = F.left(prediction_text(task), F.length(prediction_text(task)) - 1)  # the writer ends each value with a line break
    text = rows.repartition("model").sortWithinPartitions("model", "block_id").select("model", block.alias("value"))
    text.write.mode("overwrite").partitionBy("model").text(f"{root}/predictions")
    scored.coalesce(1).write.mode("overwrite").json(f"{root}/metrics")
    table.coalesce(1).write.mode("overwrite").json(f"{root}/comparison")
    write_csv(table, f"{root}/comparison_csv", single=True)


def write_asr(tables: dict[str, DataFrame], root: str) -> None:
    """The tables of a transcript benchmark, each a CSV under its name."""
    for name, df in tables.items():
        write_csv(df, f"{root}/{name}", single=True)


def rebuild(blocks: DataFrame, path: str) -> DataFrame:
    """A dataset written anew as Parquet by split, never taken from what was there before, and read back."""
    blocks.write.mode("overwrite").partitionBy("split").parquet(path)
    return blocks.sparkSession.read.parquet(path)


def markdown(df: DataFrame, digits: int = 3, most: int = 1000) -> str:
    """A small result (a row per system or model) as a table for people; more than `most` rows are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows to print")
    cell = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows]) + "\n"


def latex(df: DataFrame, digits: int = 3, most: int = 1000) -> str:
    body = [line.strip("| ").replace(" | ", " & ").replace("_", r"\_") + r" \\" for i, line in enumerate(markdown(df, digits, most).splitlines()) if i != 1]
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", *body, r"\end{tabular}"]) + "\n"

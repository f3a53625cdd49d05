"""Annotation blocks as text: token lines, a blank line after each block, and a JSON sidecar that vouches for the content.

Files are read by splitting at blank lines, so blocks of one large file are read in parallel; the digest is checked on
the whole file. cue files have two columns, scope files three (token, cue, scope); labels are X and O.
"""

from __future__ import annotations

import hashlib
import json

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = {"cue": 2, "scope": 3}


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", "\n\n").text(path).select(F.monotonically_increasing_id().alias("block_id"), F.filter(F.split(F.rtrim("value", F.lit("\n")), "\n"), lambda x: (x != "") & ~x.startswith("#")).alias("rows"))
    return rows.where("size(rows) > 0")


def read_conll(spark: SparkSession, path: str, task: str) -> DataFrame:
    """block_id (in the order of the file), tokens, cue_masks, scope_masks (null for cue files). Bad rows are errors."""
    n = COLUMNS[task]
    cells = F.transform("rows", lambda r: F.split(r, "\t"))
    bad = F.exists(cells, lambda c: (F.size(c) != n) | F.exists(F.slice(c, 2, n - 1), lambda x: ~x.isin("X", "O")))
    ok = F.when(bad, F.raise_error(F.lit(f"a {task} row needs {n} columns and labels X or O")).cast("array<array<string>>")).otherwise(cells)
    mask = lambda k: F.transform("cells", lambda c: (c[k] == "X").cast("int"))
    scope = mask(2) if task == "scope" else F.lit(None).cast("array<int>")
    return _blocks(spark, path).withColumn("cells", ok).select("block_id", F.transform("cells", lambda c: c[0]).alias("tokens"), mask(1).alias("cue_masks"), scope.alias("scope_masks"))


def read_checked(spark: SparkSession, path: str, task: str) -> DataFrame:
    """read_conll() with the sidecar's sentence_id per block; a stale or foreign sidecar is an error."""
    files, p = _open(path)
    with files.open_input_stream(p) as f:
        content = f.read()
    with files.open_input_stream(p + ".json") as f:
        side = json.loads(f.read())
    if side.get("task") != task or side.get("sha256") != hashlib.sha256(content).hexdigest():
        raise ValueError(f"{path}.json does not belong to this file")
    keys = [(k, b["sentence_id"], b["cue_indices"]) for k, b in enumerate(side["blocks"])]
    seen = [(s, tuple(c)) if task == "scope" else s for _, s, c in keys]
    if len(set(seen)) != len(seen):
        raise ValueError("a block occurs twice")
    named = spark.createDataFrame(keys, "k long, sentence_id string, cue_indices array<int>")
    blocks = read_conll(spark, path, task).coalesce(1).withColumn("k", F.monotonically_increasing_id())
    if blocks.count() != len(keys):
        raise ValueError("the sidecar has another number of blocks")
    out = blocks.join(named, "k")
    at = F.filter(F.transform("cue_masks", lambda x, i: F.when(x == 1, i)), lambda x: x.isNotNull())
    if task == "scope" and out.where(at != F.col("cue_indices")).first():
        raise ValueError("cues differ from the sidecar")
    return out.drop("k", "block_id").withColumn("annotator", F.lit(side["annotator"]))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """block_id, tok_idx, token, is_cue (null in three-column files), gold, pred; lines that start with # are left out."""
    cell = _blocks(spark, path).select("block_id", F.posexplode("rows").alias("tok_idx", "r")).withColumn("c", F.split("r", "\t"))
    x = lambda k: F.element_at("c", k) == "X"
    return cell.select("block_id", "tok_idx", F.element_at("c", 1).alias("token"), F.when(F.size("c") == 4, x(2)).alias("is_cue"), x(-2).alias("gold"), x(-1).alias("pred"))


def splits(spark: SparkSession, paths: dict[str, str], task: str) -> DataFrame:
    """train, val (as eval) and test in one table; scope blocks without a cue are left out."""
    out = None
    for name, path in paths.items():
        one = read_conll(spark, path, task).withColumn("split", F.lit({"val": "eval"}.get(name, name)))
        out = one if out is None else out.unionByName(one)
    return out if task == "cue" else out.where(F.exists("cue_masks", lambda x: x == 1))


def block_text(task: str):
    """A block's lines, from tokens, cue_masks [, scope_masks]."""
    xo = lambda c: F.when(c == 1, "X").otherwise("O")
    if task == "cue":
        rows = F.zip_with("tokens", "cue_masks", lambda t, c: F.concat_ws("\t", t, xo(c)))
    else:
        rows = F.transform(F.arrays_zip("tokens", "cue_masks", "scope_masks"), lambda z: F.concat_ws("\t", z["tokens"], xo(z["cue_masks"]), xo(z["scope_masks"])))
    return F.concat(F.array_join(rows, "\n"), F.lit("\n\n"))


def write_conll(blocks: DataFrame, path: str, task: str, annotator: str, order: str = "sentence_id") -> str:
    """One file of blocks in order, and its sidecar; the content's SHA-256. For files that people annotate and read.

    blocks: sentence_id, tokens, cue_masks [, scope_masks]; they are streamed to the file partition by partition."""
    files, p = _open(path)
    files.create_dir(p.rpartition("/")[0], recursive=True)
    digest, listed = hashlib.sha256(), []
    with files.open_output_stream(p) as out:
        for r in blocks.orderBy(order).select("sentence_id", "cue_masks", block_text(task).alias("t")).toLocalIterator():
            data = r["t"].encode()
            digest.update(data)
            out.write(data)
            listed.append({"sentence_id": r["sentence_id"], "cue_indices": [i for i, x in enumerate(r["cue_masks"]) if x]})
    side = {"version": 1, "annotator": annotator, "task": task, "sha256": digest.hexdigest(), "blocks": listed}
    with files.open_output_stream(p + ".json") as out:
        out.write(json.dumps(side, ensure_ascii=False).encode())
    return side["sha256"]


def write_per_annotator(blocks: DataFrame, root: str, task: str) -> dict[str, str]:
    """A file for each annotator; two annotators whose names give one file name are an error."""
    names = sorted(r[0] for r in blocks.select("annotator").distinct().collect())
    import re

    slug = {n: re.sub(r"[^\w.-]+", "_", n) for n in names}
    if len(set(slug.values())) != len(names):
        raise ValueError("annotators' file names collide")
    for n in names:
        write_conll(blocks.where(F.col("annotator") == n), f"{root}/{task}_{slug[n]}.conll", task, n)
    return slug

"""What models are fed beside tokens: a parser's tags and edges as columns, label inventories, and models by kind.

A parser is any function from the words of a sentence to (pos, deprel, head) for each, head being a word's place or its own
place for a root: words come split, so they are never split again."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STRINGS, _INTS = T.ArrayType(T.StringType()), T.ArrayType(T.IntegerType())
FEATURES = T.StructType([T.StructField("pos", _STRINGS), T.StructField("deprel", _STRINGS), T.StructField("heads", _INTS)])


def parsed(parser: Callable[[Sequence[str]], Sequence[tuple[str, str, int]]]):
    """The parser as a column function: tokens -> struct<pos, deprel, heads>."""

    @F.arrow_udf(FEATURES)
    def run(tokens: pa.Array) -> pa.Array:
        rows = []
        for words in tokens.to_pylist():
            told = list(parser(words or []))
            if len(told) != len(words or []):
                raise ValueError("a parser must tell of every word")
            rows.append({"pos": [t[0] for t in told], "deprel": [t[1] for t in told], "heads": [t[2] for t in told]})
        return pa.array(rows, pa.struct([("pos", pa.list_(pa.string())), ("deprel", pa.list_(pa.string())), ("heads", pa.list_(pa.int32()))]))

    return run


def edges(heads: Column) -> Column:
    """struct<source, target>: from each head to its dependent; roots have no edge to themselves."""
    each = F.filter(F.transform(heads, lambda h, k: F.struct(h.alias("source"), k.alias("target"))), lambda e: e["source"] != e["target"])
    return F.struct(F.transform(each, lambda e: e["source"]).alias("source"), F.transform(each, lambda e: e["target"]).alias("target"))


def inventory(df: DataFrame, *columns: str) -> DataFrame:
    """kind, label, id: the labels that each array column holds, numbered in their order; a tag set, so a few dozen rows."""
    from pyspark.sql import Window as W

    flat = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).alias("labels")) for c in columns))).alias("x")).select("x.kind", F.explode("x.labels").alias("label"))
    return flat.distinct().withColumn("id", F.row_number().over(W.partitionBy("kind").orderBy("label")) - 1)


def encoded(labels: Column, ids: dict[str, int], unknown: int = -1) -> Column:
    """Labels as numbers; those that the inventory lacks are `unknown`."""
    table = F.create_map(*(F.lit(x) for kv in ids.items() for x in kv)) if ids else F.create_map()
    return F.transform(labels, lambda x: F.coalesce(F.try_element_at(table, x).cast("int") if ids else F.lit(None).cast("int"), F.lit(unknown)))


class Components:
    """Models by (task, architecture, source): each entry makes a column function from a path."""

    def __init__(self) -> None:
        self._makers: dict[tuple[str, str, str], Callable[[str], Callable[[Column], Column]]] = {}

    def register(self, task: str, arch: str, source: str, maker: Callable[[str], Callable[[Column], Column]]) -> None:
        self._makers[task, arch, source] = maker

    def load(self, task: str, arch: str, source: str, path: str) -> Callable[[Column], Column]:
        try:
            return self._makers[task, arch, source](path)
        except KeyError:
            known = ", ".join("/".join(k) for k in sorted(self._makers))
            raise ValueError(f"no model of the kind {task}/{arch}/{source}; known are {known or 'none'}") from None

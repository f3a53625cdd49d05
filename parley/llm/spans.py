"""Spans of regular expressions by built-in functions only: positions count code points, ends are exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE = "array<struct<start:int,end:int,value:string,part:string>>"


def spans(text: Column, pattern: str, only_if: Column | None = None, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, value, part>>; part is the given group.

    Matches and the gaps between them (what split() leaves) alternate, so running lengths give the positions. The
    pattern must not match an empty string. only_if: a cheap condition without which the text has no match.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.split(text, pattern, -1)
    lengths = F.zip_with(F.arrays_zip(found.alias("v"), parts.alias("p")), gaps, lambda m, g: F.struct(F.length(g).alias("gap"), m["v"].alias("v"), m["p"].alias("p")))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(TYPE).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["pos"] + x["gap"]
        b = a + F.length(x["v"])
        one = F.struct(a.alias("start"), b.alias("end"), x["v"].alias("value"), x["p"].alias("part"))
        return F.struct(b.alias("pos"), F.concat(acc["out"], F.array(one)).alias("out"))

    matched = F.filter(lengths, lambda x: x["v"].isNotNull())
    result = F.aggregate(matched, start, step, lambda acc: acc["out"])
    none = F.array().cast(TYPE)
    has = text.rlike(pattern) if only_if is None else only_if & text.rlike(pattern)
    return F.when(has, result).otherwise(none)


def listed(kinds: list[tuple[str, Column]], by_start: bool = False) -> Column:
    """"kind:start:end" of all spans, comma-joined: by kind as given then start, or by start then kind."""
    def of(kind: str, found: Column, rank: int) -> Column:
        first = (lambda s: F.struct(s["start"].alias("a"), F.lit(rank).alias("b"), F.concat_ws(":", F.lit(kind), s["start"], s["end"]).alias("t"))) if by_start else (
            lambda s: F.struct(F.lit(rank).alias("a"), s["start"].alias("b"), F.concat_ws(":", F.lit(kind), s["start"], s["end"]).alias("t")))
        return F.transform(found, first)

    both = F.array_sort(F.concat(*(of(k, c, i) for i, (k, c) in enumerate(kinds))))
    return F.array_join(F.transform(both, lambda s: s["t"]), ",")

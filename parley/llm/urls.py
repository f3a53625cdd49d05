"""URL filters: rules for hosts and path prefixes, and a path-template tree for each host that judges what no rule covers.

The URLs that a rule covers are the labelled ones. Paths are cut into segments; segments that are numbers or long codes by
their looks become one value each, and per host the tree is then built level by level: of a node with many children only
those with a fair share of its URLs stay, the others become one wildcard, and neighbouring branches (by label, then rate) that neither
their labels nor the forms of what lies below them tell apart are merged, with all below them. Each node's share of blocked
labels is drawn towards its parent's (the host's towards that of all URLs), and a template whose share reaches `reject` is blocked.

All of it is grouping and joins of a table with a row for each host and shape of path; hosts of whatever share are joined by
`spread_join`. A node keeps at most MANY children or 1 / SHARE of them and a wildcard, so a node's children, and a host's
templates, are bounded groups; nothing comes to the driver but two counts.

Defined cases: null URLs and those without `://` have the empty host and path, and are judged as such; repeated rows get equal
verdicts; paths of more than DEPTH segments share what lies deeper; without any label nothing is blocked; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.llm._common import documents, materialize, spread_join, swept


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


#: Fixed values of the contract.
RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]
#: Levels of the tree; segments longer than LONG are one value.
DEPTH, LONG = 4, 64
#: A node with more than MANY children keeps those with a 1 / SHARE part of its URLs or more.
MANY, SHARE = 8, 20
#: Chi-square bounds: labels (one degree of freedom, 5 %) and forms (three, 1 %).
LABELS_DIFFER, FORMS_DIFFER = 3.841, 11.345
#: How many labels a parent's share counts for, and the share of blocked ones at which a template is rejected.
PRIOR, REJECT = 2.0, 0.8
FORMS = ["f_file", "f_dir", "f_number", "f_name"]
SUMS = ["n", "n_block", "n_label", *FORMS]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none does. rules: a list that fits a plan."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):  # the last that fits wins
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        rule, verdict = F.when(fits, r.host + r.path).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """The shapes of a path's segments, DEPTH at most and a mark that there are more."""

    def shape(s: Column) -> Column:
        coded = (F.length(s) >= 16) & F.rlike(s, F.lit("^[0-9a-fA-F-]+$")) & F.rlike(s, F.lit("[0-9]"))
        return F.when(F.length(s) > LONG, "~").when(coded, "x").otherwise(F.regexp_replace(s, "[0-9]+", "0"))

    cut = F.split(F.substring(path, 2, 1 << 30), "/")
    return F.concat(F.transform(F.slice(cut, 1, DEPTH), shape), F.when(F.size(cut) > DEPTH, F.array(F.lit("**"))).otherwise(F.array().cast("array<string>")))


def _forms(last: Column) -> list[Column]:
    """What a path ends in: a file, a directory, a number, another name."""
    file, folder, number = F.contains(last, F.lit(".")), last == "", last == "0"
    return [x.cast("long") for x in (file, folder & ~file, number, ~(file | folder | number))]


def _sums(names: Sequence[str] = SUMS) -> list[Column]:
    return [F.sum(c).alias(c) for c in names]


def _kept(shapes: DataFrame, level: int) -> DataFrame:
    """host, t, seg, name, rows: the children at a level that are no wildcards, under their branch's name."""
    own = shapes.withColumn("seg", F.get("segs", F.lit(level))).where(F.col("seg").isNotNull())
    children = materialize(own.groupBy("host", "t", "seg").agg(*_sums(), F.count(F.lit(1)).alias("rows")), "children")
    parents = materialize(children.groupBy("host", "t").agg(F.count(F.lit(1)).alias("kids"), F.sum("n").alias("all")), "parents")
    held = spread_join(children, parents.withColumn("n_kids", F.col("kids")), ["host", "t"], children.count(), "n_kids")
    held = held.where((F.col("kids") <= MANY) | (F.col("n") * SHARE >= F.col("all")))
    # at most max(MANY, SHARE) children of a node are left
    labelled = F.col("n_label") > 0
    order = W.partitionBy("host", "t").orderBy(labelled, F.when(labelled, F.col("n_block") / F.col("n_label")).otherwise(0.0), "seg")
    prev = {c: F.lag(c).over(order) for c in SUMS}
    named = held.withColumns({f"p_{c}": x for c, x in prev.items()}).withColumn("apart", _apart().cast("int"))
    named = named.withColumn("branch", F.sum("apart").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return materialize(named.select("host", "t", "seg", F.min("seg").over(W.partitionBy("host", "t", "branch")).alias("name"), "rows"), "branches")


def _apart() -> Column:
    """Whether a child differs from the one before it (columns p_...), by chi-square of labels and of forms."""
    d = {c: F.col(c).cast("double") for c in SUMS} | {f"p_{c}": F.col(f"p_{c}").cast("double") for c in SUMS}
    a, b, x, y = d["n_label"], d["p_n_label"], d["n_block"], d["p_n_block"]
    labels = F.when((a > 0) & (b > 0) & (x + y > 0) & (x + y < a + b), (x * b - y * a) * (x * b - y * a) * (a + b) / (a * b * (x + y) * (a + b - x - y))).otherwise(0.0)
    forms = F.lit(0.0)
    for c in FORMS:
        u, v, n, m = d[c], d[f"p_{c}"], d["n"], d["p_n"]
        forms = forms + F.when(u + v > 0, (u * m - v * n) * (u * m - v * n) / (n * m * (u + v))).otherwise(0.0)
    return F.col("p_n").isNull() | ((a > 0) != (b > 0)) | (labels > LABELS_DIFFER) | (forms > FORMS_DIFFER)


def _rated(trees: DataFrame, blocked: int, labels: int) -> DataFrame:
    """`purity` of each template: its share of blocked labels, drawn towards those of the nodes above; a host's templates are a bounded group."""
    out = trees.withColumn("purity", F.lit((blocked + 1) / (labels + 2) if labels else 0.0))
    for level in range(DEPTH + 2):
        node = W.partitionBy("host", *(f"t{i}" for i in range(level)))
        below = (F.sum("n_block").over(node) + PRIOR * F.col("purity")) / (F.sum("n_label").over(node) + PRIOR)
        out = out.withColumn("purity", below if level == 0 else F.when(F.col(f"t{level - 1}").isNull(), F.col("purity")).otherwise(below))
    return out


def templates(shapes: DataFrame) -> DataFrame:
    """shapes: host, segs and SUMS -> host, segs, n, template, purity (the smoothed share of blocked labels)."""
    with swept() as keep:
        now = materialize(shapes.withColumn("t", F.lit("")), "shapes")
        total = now.count()
        blocked, labels = now.agg(F.coalesce(F.sum("n_block"), F.lit(0)), F.coalesce(F.sum("n_label"), F.lit(0))).first()
        for level in range(DEPTH + 1):
            branch = _kept(now, level)
            seg = F.get("segs", F.lit(level))
            met = spread_join(now.withColumn("seg", seg), branch, ["host", "t", "seg"], total, "rows", how="left")
            name = F.when(F.col("seg").isNotNull(), F.coalesce("name", F.lit("*")))
            met = met.withColumn(f"t{level}", name).withColumn("t", F.concat("t", F.coalesce(F.concat(F.lit("/"), name), F.lit(""))))
            now = materialize(met.drop("seg", "name"), "shapes")
        steps = [f"t{i}" for i in range(DEPTH + 1)]
        trees = materialize(now.groupBy("host", "t", *steps).agg(*_sums(["n_block", "n_label"]), F.count(F.lit(1)).alias("rows")), "templates")
        judged = materialize(_rated(trees, blocked, labels).select("host", "t", "purity", "rows"), "purity")
        out = spread_join(now.select("host", "segs", "n", "t"), judged, ["host", "t"], total, "rows").withColumnRenamed("t", "template")
        out = materialize(out, "templates")
        keep.append(out)
    return out


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity for each row of pages."""
    urls = documents(pages, id_col, url_col).select(F.col("doc_id").alias("page_id"), *(c.alias(n) for c, n in zip(host_and_path(F.col("text")), ("host", "path"), strict=True)))
    rule, told = ruled(F.col("host"), F.col("path"), rules)
    with swept() as keep:
        urls = materialize(urls.withColumns({"rule": rule, "told": told, "segs": segments(F.col("path"))}), "urls")
        forms = dict(zip(FORMS, _forms(F.element_at("segs", -1)), strict=True))
        one = {"n": F.lit(1).cast("long"), "n_block": F.coalesce((F.col("told") == "block").cast("long"), F.lit(0)), "n_label": F.col("told").isNotNull().cast("long")}
        found = templates(urls.withColumns(one | forms).groupBy("host", "segs").agg(*_sums()))
        keep += [urls, found]
    out = spread_join(urls, found, ["host", "segs"], urls.count(), "n")
    return out.select("page_id", "host", "path", "rule", F.coalesce("told", F.when(F.col("purity") >= REJECT, "block").otherwise("allow")).alias("verdict"), "template", "purity")

"""Span annotations of several annotators: validation, alignment of groups, votes and latent-label aggregation."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.functions import arrow
from parley.shared import materialize

GROUPS = "array<struct<cue:array<struct<i:int,start:int,end:int>>,scope:array<struct<i:int,start:int,end:int>>>>"


def token_indices(entries: Column, tokens: Column) -> Column:
    """The tokens that spans mark, sorted; a span without bounds is its whole token; bad spans are errors."""
    def bad(e: Column) -> Column:
        n = F.length(F.try_element_at(tokens, e["i"] + 1))
        start, end = F.coalesce(e["start"], F.lit(0)), F.coalesce(e["end"], n)
        return e["i"].isNull() | (e["i"] < 0) | (e["i"] >= F.size(tokens)) | (start < 0) | (start >= end) | (end > n)

    broken = F.exists(entries, lambda e: F.coalesce(bad(e), F.lit(True)))
    return F.when(broken, F.raise_error(F.lit("span outside its token")).cast("array<int>")).otherwise(F.array_sort(F.array_distinct(F.transform(entries, lambda e: e["i"]))))


def valid_spans(entries: Column, tokens: Column) -> Column:
    return F.forall(entries, lambda e: F.coalesce((e["i"] >= 0) & (e["i"] < F.size(tokens)) & (F.coalesce(e["start"], F.lit(0)) < F.coalesce(e["end"], F.length(F.try_element_at(tokens, e["i"] + 1)))), F.lit(False)))


def joined(annotations: DataFrame, sample: DataFrame) -> DataFrame:
    """annotations with text, split and tokens of their sentence; one without a sentence is an error."""
    s = sample.select(F.col("item_uuid").alias("sentence_id"), "text", "split")
    out = annotations.join(s, "sentence_id", "left")
    known = F.when(F.col("text").isNull(), F.raise_error(F.concat(F.lit("no sentence "), "sentence_id")).cast("string")).otherwise(F.col("text"))
    toks = F.filter(F.split(F.trim(F.regexp_replace(known, r"(?U)\s+", " ")), " "), lambda t: t != "")
    return out.withColumn("tokens", toks).withColumn("groups", F.from_json("groups_json", GROUPS))


def proposals(rows: DataFrame, include_garbled: bool = False) -> DataFrame:
    """sentence_id, annotator, group_index, cue, scope from joined(); garbled annotations are left out."""
    ok = rows if include_garbled else rows.where("coalesce(garbled, 0) = 0")
    flat = ok.select("sentence_id", "annotator", "split", "tokens", F.posexplode("groups").alias("group_index", "g"))
    return flat.select("sentence_id", "annotator", "split", "group_index", F.size("tokens").alias("n_tokens"), token_indices(F.col("g.cue"), F.col("tokens")).alias("cue"), token_indices(F.col("g.scope"), F.col("tokens")).alias("scope"))


def excluded(rows: DataFrame) -> DataFrame:
    """Sentences of which no annotation is usable."""
    return rows.groupBy("sentence_id").agg(F.min(F.coalesce("garbled", F.lit(0))).alias("g")).where("g = 1").select("sentence_id")


def overlap_edges(props: DataFrame) -> DataFrame:
    """a, b: proposals of different annotators that share a cue token of one sentence. An equi-join on the token."""
    flat = props.select("sentence_id", "pid", "annotator", F.explode("cue").alias("tok"))
    a, b = (flat.select("sentence_id", "tok", F.col("pid").alias(x), F.col("annotator").alias(f"by_{x}")) for x in "ab")
    return a.join(b, ["sentence_id", "tok"]).where("a < b AND by_a <> by_b").select("a", "b").distinct()


def align_groups(props: DataFrame) -> DataFrame:
    """pid, sentence_id, annotator, cue, scope [, ...] -> group_id, ambiguous, alignment for each proposal.

    Components of overlap edges; one in which an annotator is there twice falls back to groups of exactly equal cues. Edges
    never leave a sentence, so a sentence's proposals are grouped together, in one shuffle."""
    entries = F.collect_list(F.struct(F.col("pid").cast("long").alias("pid"), "annotator", "cue"))
    by = props.groupBy("sentence_id").agg(entries.alias("e")).select(F.col("e.pid").alias("pids"), arrow.overlap_components("e").alias("comps"))
    comp = by.select(F.inline(F.arrays_zip("pids", "comps"))).withColumnsRenamed({"pids": "pid", "comps": "component"})
    p = props.join(comp, "pid")
    of = W.partitionBy("component")
    many = F.count(F.lit(1)).over(of)
    who = F.size(F.collect_set("annotator").over(of))
    p = p.withColumn("ambiguous", who < many)
    key = F.when(F.col("ambiguous"), F.to_json("cue")).otherwise("")
    p = p.withColumn("group_key", F.concat_ws("|", F.col("component").cast("string"), key))
    inside = W.partitionBy("group_key")
    same = F.size(F.collect_set(F.to_json("cue")).over(inside)) == 1
    return p.withColumn("alignment", F.when(F.col("ambiguous"), "exact_only_ambiguous").when(same, "exact").otherwise("overlap_union")).withColumn("group_id", F.min("pid").over(inside)).drop("group_key", "component")


def groups_of(aligned: DataFrame) -> DataFrame:
    """group_id, sentence_id, cue_indices, sources, ambiguous, alignment."""
    return aligned.groupBy("group_id", "sentence_id", "ambiguous", "alignment").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("cue")))).alias("cue_indices"), F.count(F.lit(1)).alias("sources"))


def cue_votes(props: DataFrame, raters: DataFrame) -> DataFrame:
    """sentence_id, tok, votes, raters: union of cues, with how many annotators of the sentence marked each token.

    raters: sentence_id, annotator, also those who marked nothing; votes = raters is unanimity."""
    n = raters.distinct().groupBy("sentence_id").agg(F.count(F.lit(1)).alias("raters"))
    votes = props.select("sentence_id", "annotator", F.explode("cue").alias("tok")).distinct().groupBy("sentence_id", "tok").agg(F.count(F.lit(1)).alias("votes"))
    return votes.join(n, "sentence_id")


def scope_ratings(aligned: DataFrame) -> DataFrame:
    """group_id, tok, annotator, value: each source's rating of each token of the sentence."""
    return aligned.select("group_id", "ambiguous", "annotator", F.explode(F.sequence(F.lit(0), F.col("n_tokens") - 1)).alias("tok"), "scope").select("group_id", "ambiguous", "tok", "annotator", F.array_contains("scope", F.col("tok")).cast("int").alias("value"))


def token_classes(aligned: DataFrame) -> DataFrame:
    """group_id, ratings, tokens: how many tokens of a group have these ratings (array<struct<annotator, value>>, sorted).

    What scope_ratings() says token by token: tokens in a scope are looked at one by one, the others only counted, for each number of
    tokens that the group's rows have. A group meets once, and no token is shuffled."""
    by = aligned.groupBy("group_id").agg(F.collect_list(F.struct("annotator", "scope", "n_tokens")).alias("s"))
    ends = F.array_sort(F.array_distinct(F.transform("s", lambda x: F.greatest(x["n_tokens"], F.lit(0)))))
    marked = F.array_distinct(F.flatten(F.transform("s", lambda x: F.filter(F.coalesce(x["scope"], F.array().cast("array<int>")), lambda t: (t >= 0) & (t < x["n_tokens"])))))
    by = by.withColumn("marked", marked).withColumn("ends", ends)

    def rest(end: Column, k: Column) -> Column:
        start = F.when(k > 0, F.get("ends", k - 1)).otherwise(0)
        return F.struct((end - 1).alias("tok"), (end - start - F.size(F.filter("marked", lambda t: (t >= start) & (t < end)))).cast("long").alias("n"), F.lit(0).alias("in"))

    each = F.transform("marked", lambda t: F.struct(t.alias("tok"), F.lit(1).cast("long").alias("n"), F.lit(1).alias("in")))
    kinds = by.select("group_id", "s", F.explode(F.concat(each, F.transform("ends", rest))).alias("c")).where("c.n > 0")
    rated = F.transform(F.filter("s", lambda x: x["n_tokens"] > F.col("c.tok")), lambda x: F.struct(x["annotator"].alias("annotator"), (F.array_contains(x["scope"], F.col("c.tok")).cast("int") * F.col("c.in")).alias("value")))
    return kinds.select("group_id", F.array_sort(rated).alias("ratings"), F.col("c.n").alias("tokens"))


def class_patterns(aligned: DataFrame) -> DataFrame:
    """response_patterns() of the groups' tokens, from token_classes()."""
    rated = F.array_join(F.array_sort(F.transform("ratings", lambda x: F.concat_ws("=", x["annotator"], x["value"].cast("string")))), ",")
    return token_classes(aligned).where(F.size("ratings") >= 2).groupBy(rated.alias("pattern")).agg(F.sum("tokens").alias("n"))


def class_ratings(classes: DataFrame) -> DataFrame:
    """unit, tokens, annotator, value: the ratings of each kind of token and how many are of it, a few rows for any number of tokens."""
    return classes.groupBy(F.col("ratings").alias("unit")).agg(F.sum("tokens").alias("tokens")).select("unit", "tokens", F.inline("unit"))


def response_patterns(ratings: DataFrame, unit: list[str]) -> DataFrame:
    """pattern (annotator=value, sorted, comma-joined), n: equal response patterns of units rated at least twice."""
    per = ratings.groupBy(*unit).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "annotator", F.col("value").cast("string")))), ",").alias("pattern"), F.count(F.lit(1)).alias("k"))
    return per.where("k >= 2").groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


def parse_pattern(pattern: str) -> dict[str, int]:
    return {k: int(v) for k, _, v in (x.rpartition("=") for x in pattern.split(","))}


def posterior(ratings: Mapping[str, int], model: Mapping) -> float:
    """P(in scope | ratings)."""
    odds = math.log(model["prevalence"]) - math.log1p(-model["prevalence"])
    for who, value in ratings.items():
        sens, spec = model["annotators"][who]["sensitivity"], model["annotators"][who]["specificity"]
        odds += math.log(sens / (1 - spec)) if value else math.log((1 - sens) / spec)
    return 1 / (1 + math.exp(-odds)) if odds >= 0 else math.exp(odds) / (1 + math.exp(odds))


def fit_latent(patterns: Mapping[str, int], names: Sequence[str], strength: float = 10.0, accuracy: float = 0.9, most: int = 1000, tolerance: float = 1e-8) -> dict:
    """Dawid-Skene by MAP-EM over compressed patterns: the work does not depend on the number of tokens.

    Beta priors with mode 0.9 and the given strength on sensitivity and specificity, Beta(2, 2) on prevalence."""
    if not (math.isfinite(strength) and strength > 0 and 0 < accuracy < 1):
        raise ValueError("strength must be positive and finite, accuracy inside (0, 1)")
    rows = [(parse_pattern(p), n) for p, n in sorted(patterns.items())]
    rows = [(r, n) for r, n in rows if len(r) >= 2]
    if not rows:
        raise ValueError("no unit has two ratings")
    total = sum(n for _, n in rows)
    model = {"prevalence": 0.5, "annotators": {a: {"sensitivity": accuracy, "specificity": accuracy} for a in sorted(names)}}
    for step in range(1, most + 1):
        q = [posterior(r, model) for r, _ in rows]
        new = {"prevalence": (1 + sum(n * p for (_, n), p in zip(rows, q, strict=True))) / (total + 2), "annotators": {}}
        for a in model["annotators"]:
            mine = [(n, p, r[a]) for (r, n), p in zip(rows, q, strict=True) if a in r]
            pos, neg = sum(n * p for n, p, _ in mine), sum(n * (1 - p) for n, p, _ in mine)
            new["annotators"][a] = {
                "sensitivity": (sum(n * p for n, p, v in mine if v) + 0.9 * strength) / (pos + strength),
                "specificity": (sum(n * (1 - p) for n, p, v in mine if not v) + 0.9 * strength) / (neg + strength),
            }
        change = max([abs(new["prevalence"] - model["prevalence"]), *(abs(new["annotators"][a][k] - v) for a, x in model["annotators"].items() for k, v in x.items())])
        model = new
        if change < tolerance:
            break
    return model | {"converged": change < tolerance, "iterations": step, "training_tokens": total, "response_patterns": len(rows)}


def fit_from(ratings: DataFrame, unit: list[str], **options) -> dict:
    """fit_latent() on a ratings table; only the distinct patterns (2^annotators at most, 3^ with gaps) are collected."""
    names = [r[0] for r in ratings.select("annotator").distinct().collect()]
    return fit_latent({r["pattern"]: r["n"] for r in response_patterns(ratings, unit).collect()}, names, **options)


def fit_aligned(aligned: DataFrame, **options) -> dict:
    """fit_from() on the scope ratings of aligned groups. aligned is read twice: write it first."""
    names, patterns = _aligned_patterns(aligned)
    return fit_latent(patterns, names, **options)


def _aligned_patterns(aligned: DataFrame) -> tuple[list[str], dict[str, int]]:
    names = [r[0] for r in aligned.where("n_tokens > 0").select("annotator").distinct().collect()]
    return names, {r["pattern"]: r["n"] for r in class_patterns(aligned).collect()}


def variants(ratings: DataFrame, unit: list[str], strength: float = 10.0) -> dict[str, dict]:
    """The model and its four sensitivity refits; patterns are counted once for all."""
    names = [r[0] for r in ratings.select("annotator").distinct().collect()]
    return _refits(names, {r["pattern"]: r["n"] for r in response_patterns(ratings, unit).collect()}, strength)


def variants_aligned(aligned: DataFrame, strength: float = 10.0) -> dict[str, dict]:
    """variants() on the scope ratings of aligned groups. aligned is read twice: write it first."""
    return _refits(*_aligned_patterns(aligned), strength)


def _refits(names: Sequence[str], patterns: Mapping[str, int], strength: float) -> dict[str, dict]:
    return {"model": fit_latent(patterns, names, strength)} | {name: fit_latent(patterns, names, **o) for name, o in (("weaker_prior", {"strength": strength / 2}), ("stronger_prior", {"strength": strength * 2}), ("initial_accuracy_0.7", {"strength": strength, "accuracy": 0.7}), ("initial_accuracy_0.97", {"strength": strength, "accuracy": 0.97}))}


def log_odds(annotator: Column, value: Column, model: Mapping) -> Column:
    """What one rating adds to the log odds, from the model as literals."""
    out = F.lit(0.0)
    for a, x in model["annotators"].items():
        yes, no = math.log(x["sensitivity"] / (1 - x["specificity"])), math.log((1 - x["sensitivity"]) / x["specificity"])
        out = F.when(annotator == a, F.when(value == 1, yes).otherwise(no)).otherwise(out)
    return out


def decide_scopes(ratings: DataFrame, model: Mapping, unit: tuple[str, ...] = ("group_id", "tok")) -> DataFrame:
    """unit -> n, agreed, disputed, posterior (null for one source), label: unanimity stands, else posterior >= 0.5."""
    base = math.log(model["prevalence"] / (1 - model["prevalence"]))
    g = ratings.groupBy(*unit).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), (F.sum(log_odds(F.col("annotator"), F.col("value"), model)) + F.lit(base)).alias("odds"))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("odds")))
    g = g.withColumn("disputed", F.col("lo") != F.col("hi")).withColumn("posterior", F.when(F.col("n") >= 2, p))
    return g.withColumn("label", F.when(~F.col("disputed"), F.col("lo")).otherwise((p >= 0.5).cast("int"))).withColumn("low_confidence", F.col("disputed") & p.between(0.4, 0.6)).select(*unit, "n", "disputed", "posterior", "label", "low_confidence", F.col("hi").alias("union_label"), F.col("lo").alias("intersection_label"))


def _tokens(df: DataFrame, *conditions: Column) -> Column:
    """How many tokens meet the conditions; a row is one, or as many as its column `tokens` says."""
    n = F.col("tokens") if "tokens" in df.columns else F.lit(1)
    for c in conditions:
        n = F.when(c, n)
    return F.coalesce(F.sum(n), F.lit(0)).cast("long")


def changed_by(ratings: DataFrame, models: Mapping[str, Mapping], unit: tuple[str, ...] = ("group_id", "tok")) -> DataFrame:
    """variant, disputed, changed: how many disputed tokens each of the other models labels otherwise than "model" does; one pass.

    With class_ratings(), the unit is ("unit", "tokens")."""
    odds = {name: F.sum(log_odds(F.col("annotator"), F.col("value"), m)) + F.lit(math.log(m["prevalence"] / (1 - m["prevalence"]))) for name, m in models.items()}
    g = ratings.groupBy(*unit).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), *(c.alias(f"odds_{k}") for k, (_, c) in enumerate(odds.items()))).where("lo <> hi")
    at = {name: F.col(f"odds_{k}") >= 0 for k, name in enumerate(odds)}
    others = [name for name in models if name != "model"]
    one = g.agg(_tokens(g).alias("disputed"), *(_tokens(g, at[name] != at["model"]).alias(f"changed_{k}") for k, name in enumerate(others)))
    rows = F.array(*(F.struct(F.lit(name).alias("variant"), F.col("disputed"), F.col(f"changed_{k}").alias("changed")) for k, name in enumerate(others)))
    return one.select(F.inline(rows))


def split_counters(aligned: DataFrame, model: Mapping) -> DataFrame:
    """split -> groups, tokens, disputed and positive tokens, and those that a vote for the union or intersection would change.

    aligned is read more than once: write it first."""
    of = aligned.select("group_id", "split").distinct()
    groups = of.groupBy("split").agg(F.count(F.lit(1)).alias("groups"))
    classes = token_classes(aligned).join(of, "group_id").groupBy("split", "ratings").agg(F.sum("tokens").alias("tokens"))
    classes = materialize(classes, "classes")  # a row for each split and pattern of ratings
    decided = decide_scopes(class_ratings(classes), model, ("unit",)).join(classes.withColumnRenamed("ratings", "unit"), "unit")
    words = decided.groupBy("split").agg(*(_tokens(decided, *c).alias(k) for k, c in {"tokens": (), "disputed": (F.col("disputed"),), "in_scope": (F.col("label") == 1,), "union_changes": (F.col("label") != F.col("union_label"),), "intersection_changes": (F.col("label") != F.col("intersection_label"),)}.items()))
    return groups.join(words, "split", "left")


def aggregation_report(aligned: DataFrame, decided: DataFrame) -> DataFrame:
    """One row of counters over groups and tokens. decided: from decide_scopes(), a row for each token or, with `tokens`, for so many."""
    g = aligned.groupBy("group_id", "ambiguous", "alignment").agg(F.count(F.lit(1)).alias("k"), F.size(F.collect_set(F.to_json("scope"))).alias("scopes"))
    a = g.agg(F.count(F.lit(1)).alias("scope_groups"), F.count_if(F.col("k") == 1).alias("single_source_scope_groups"), F.count_if((F.col("k") > 1) & (F.col("scopes") == 1)).alias("agreed_scope_groups"), F.count_if((F.col("k") > 1) & (F.col("scopes") > 1)).alias("probabilistic_scope_groups"), F.count_if("ambiguous").alias("ambiguous_alignment_groups"), F.count_if(F.col("alignment") == "overlap_union").alias("overlap_union_groups"))
    d = decided.agg(*(_tokens(decided, c).alias(k) for k, c in {"disputed_scope_tokens": F.col("disputed"), "low_confidence_disputed_scope_tokens": F.col("low_confidence"), "scope_union_changes": F.col("label") != F.col("union_label"), "scope_intersection_changes": F.col("label") != F.col("intersection_label")}.items()))
    return a.crossJoin(F.broadcast(d))  # one row each

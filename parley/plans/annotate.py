"""Queries on annotations, agreement and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.functions import arrow
from parley.operators import agreement as ag
from parley.operators import annotations as an
from parley.operators import evaluation as ev
from parley.operators import metrics as mt
from parley.plans import fixtures as fx
from parley.shared import materialize

Q, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def r6(c, name: str):
    return F.round(c, 6).alias(name)


@query(f"WITH {fx.SQL_ANN} SELECT sentence_id, annotator, group_index, array_to_string(list_sort(cue), ',') AS cue, array_to_string(list_sort(scope), ',') AS scope FROM props")
def annotation_explode(spark: SparkSession, d: str) -> DataFrame:
    ints = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return fx.proposals(spark, d).select("sentence_id", "annotator", "group_index", ints("cue").alias("cue"), ints("scope").alias("scope"))


@query(f"WITH {fx.SQL_ANN} SELECT sentence_id FROM ann GROUP BY 1 HAVING bool_and(garbled)")
def excluded_sentences(spark: SparkSession, d: str) -> DataFrame:
    return an.excluded(an.joined(*fx.annotations(spark, d)))


_VOTES = "raters AS (SELECT sentence_id, count(DISTINCT annotator) AS raters FROM ann WHERE NOT garbled GROUP BY 1), votes AS (SELECT sentence_id, tok, count(DISTINCT annotator) AS votes FROM (SELECT sentence_id, annotator, unnest(cue) AS tok FROM props) GROUP BY 1, 2)"


@query(f"WITH {fx.SQL_ANN}, {_VOTES} SELECT v.sentence_id, v.tok, v.votes, r.raters, v.votes = r.raters AS unanimous FROM votes v JOIN raters r USING (sentence_id)")
def cue_union_intersection(spark: SparkSession, d: str) -> DataFrame:
    ann, _ = fx.annotations(spark, d)
    raters = ann.where("garbled = 0").select("sentence_id", "annotator")
    return an.cue_votes(fx.proposals(spark, d), raters).withColumn("unanimous", F.col("votes") == F.col("raters"))


_PID = f"{fx.SQL_ANN}, pp AS (SELECT *, {fx.SQL_PID} AS pid FROM props), ex AS (SELECT pid, sentence_id, annotator, unnest(cue) AS tok FROM pp), edges AS (SELECT DISTINCT a.pid AS a, b.pid AS b FROM ex a JOIN ex b ON a.sentence_id = b.sentence_id AND a.tok = b.tok AND a.pid < b.pid AND a.annotator <> b.annotator)"


@query(f"WITH {_PID} SELECT * FROM edges")
def cue_overlap_edges(spark: SparkSession, d: str) -> DataFrame:
    return an.overlap_edges(fx.with_pid(fx.proposals(spark, d)))


_ALIGNED = f"""{_PID}, und AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges), rch AS (SELECT pid AS node, pid AS c FROM pp UNION SELECT und.b, rch.c FROM rch JOIN und ON und.a = rch.node),
comp AS (SELECT node AS pid, min(c) AS component FROM rch GROUP BY 1), j AS (SELECT pp.*, component, count(*) OVER (PARTITION BY component) > size AS ambiguous FROM pp JOIN comp USING (pid) JOIN (SELECT component, count(DISTINCT annotator) AS size FROM comp JOIN pp USING (pid) GROUP BY 1) USING (component)),
k AS (SELECT *, concat(component, '|', CASE WHEN ambiguous THEN CAST(list_sort(cue) AS STRING) ELSE '' END) AS gk FROM j),
al AS (SELECT k.*, CASE WHEN ambiguous THEN 'exact_only_ambiguous' WHEN n = 1 THEN 'exact' ELSE 'overlap_union' END AS alignment, group_id FROM k JOIN (SELECT gk, count(DISTINCT CAST(list_sort(cue) AS STRING)) AS n, min(pid) AS group_id FROM k GROUP BY 1) USING (gk))"""


def aligned(spark: SparkSession, d: str) -> DataFrame:
    return an.align_groups(fx.with_pid(fx.proposals(spark, d)))


@query(f"WITH RECURSIVE {_ALIGNED} SELECT group_id, sentence_id, ambiguous, alignment, array_to_string(list_sort(list_distinct(flatten(list(cue)))), ',') AS cue_indices, count(*) AS sources FROM al GROUP BY 1, 2, 3, 4")
def aligned_groups(spark: SparkSession, d: str) -> DataFrame:
    g = an.groups_of(aligned(spark, d))
    return g.withColumn("cue_indices", F.array_join(F.transform("cue_indices", lambda x: x.cast("string")), ","))


@query(f"""WITH RECURSIVE {_ALIGNED}, rt AS (SELECT group_id, annotator, unnest(range(n_tokens)) AS tok, scope FROM al WHERE NOT ambiguous), v AS (SELECT group_id, tok, annotator, CAST(list_contains(scope, tok) AS INTEGER) AS value FROM rt),
u AS (SELECT group_id, tok, string_agg(concat(annotator, '=', CAST(value AS STRING)), ',' ORDER BY annotator) AS pattern, count(*) AS k FROM v GROUP BY 1, 2) SELECT pattern, count(*) AS n FROM u WHERE k >= 2 GROUP BY 1""")
def response_patterns(spark: SparkSession, d: str) -> DataFrame:
    return an.class_patterns(aligned(spark, d).where("NOT ambiguous"))


def _model(spark: SparkSession, d: str) -> tuple[DataFrame, dict]:
    """The aligned groups, which are made once, and the model of their scopes."""
    al = materialize(aligned(spark, d).select("group_id", "split", "ambiguous", "alignment", "annotator", "n_tokens", "scope"), "aligned")
    return al, an.fit_aligned(al.where("NOT ambiguous"))


@query()
def dawid_skene(spark: SparkSession, d: str) -> DataFrame:
    _, m = _model(spark, d)
    rows = [(a, x["sensitivity"], x["specificity"], m["prevalence"], m["iterations"]) for a, x in m["annotators"].items()]
    return spark.createDataFrame(rows, "annotator string, sensitivity double, specificity double, prevalence double, iterations int")


@query()
def scope_decisions(spark: SparkSession, d: str) -> DataFrame:
    al, m = _model(spark, d)
    return an.decide_scopes(an.scope_ratings(al), m)


@query()
def scope_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """Disputed tokens that the model's refits, with other priors and other starts, would label otherwise."""
    al = materialize(aligned(spark, d).select("group_id", "ambiguous", "annotator", "n_tokens", "scope"), "aligned")
    return an.changed_by(an.class_ratings(an.token_classes(al)), an.variants_aligned(al.where("NOT ambiguous")), ("unit", "tokens"))


@query()
def aggregation_report(spark: SparkSession, d: str) -> DataFrame:
    al, m = _model(spark, d)
    ratings = an.class_ratings(an.token_classes(al))
    return an.aggregation_report(al, an.decide_scopes(ratings, m, ("unit", "tokens")))


@query()
def split_counters(spark: SparkSession, d: str) -> DataFrame:
    return an.split_counters(*_model(spark, d))


_PAIR = """SELECT *, count(*) OVER () AS x FROM labels"""


@query("""WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS oo, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS ox, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS xo, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS xx FROM labels),
v AS (SELECT *, CAST(xo + xx AS DOUBLE) AS a1, CAST(ox + xx AS DOUBLE) AS b1, 2.0 * n AS t FROM c), w AS (SELECT *, (oo + xx) / CAST(n AS DOUBLE) AS o, (a1 * b1 + (n - a1) * (n - b1)) / (CAST(n AS DOUBLE) * n) AS e, (t * t - (a1 + b1) * (a1 + b1) - (t - a1 - b1) * (t - a1 - b1)) / (t * (t - 1)) AS de, (ox + xo) * 2.0 / t AS dob FROM v)
SELECT n AS tokens, round(o, 6) AS observed_agreement, round((o - e) / (1 - e), 6) AS cohen_kappa, CAST(round(1 - dob / de, 6) AS DOUBLE) AS alpha, CAST(round(2.0 * xx / (a1 + b1), 6) AS DOUBLE) AS positive_dice, oo, ox, xo, xx FROM w""")
def pair_agreement(spark: SparkSession, d: str) -> DataFrame:
    m = ag.pair_metrics(fx.table(spark, d, "labels").select(F.col("quality").alias("a"), F.col("toxic").alias("b")))
    return m.select("tokens", *(r6(c, c) for c in ("observed_agreement", "cohen_kappa", "alpha", "positive_dice")), "oo", "ox", "xo", "xx")


#: Three raters with gaps: quality, toxic, and a third that follows quality but for every fifth and skips every fourth.
_RATINGS = "ratings AS (SELECT doc_id AS unit, 'a' AS annotator, CAST(quality AS INTEGER) AS value FROM labels UNION ALL SELECT doc_id, 'b', CAST(1 - toxic AS INTEGER) FROM labels WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id, 'c', CAST(CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS INTEGER) FROM labels WHERE doc_id % 4 <> 0)"


def ratings(spark: SparkSession, d: str) -> DataFrame:
    l = fx.table(spark, d, "labels")
    a = l.selectExpr("doc_id AS unit", "'a' AS annotator", "CAST(quality AS INT) AS value")
    b = l.where("doc_id % 7 <> 0").selectExpr("doc_id", "'b'", "CAST(1 - toxic AS INT)")
    c = l.where("doc_id % 4 <> 0").selectExpr("doc_id", "'c'", "CAST(CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS INT)")
    return a.union(b).union(c)


@query(f"""WITH {_RATINGS}, per AS (SELECT unit, value, count(*) AS n FROM ratings GROUP BY 1, 2), un AS (SELECT unit, sum(n) AS m, sum(n * n) AS sq FROM per GROUP BY 1 HAVING sum(n) >= 2),
o AS (SELECT sum(m) AS t, sum((m * m - sq) / CAST(m - 1 AS DOUBLE)) AS dd FROM un), c AS (SELECT sum(c * c) AS c2 FROM (SELECT value, sum(n) AS c FROM per WHERE unit IN (SELECT unit FROM un) GROUP BY 1))
SELECT CAST(t AS BIGINT) AS ratings, round(1 - (dd / t) / ((t * t - c2) / CAST(t * (t - 1) AS DOUBLE)), 6) AS alpha FROM o, c""")
def krippendorff(spark: SparkSession, d: str) -> DataFrame:
    return ag.krippendorff_alpha(ratings(spark, d)).select("ratings", r6("alpha", "alpha"))


@query(f"""WITH {_RATINGS}, per AS (SELECT unit, value, count(*) AS n FROM ratings GROUP BY 1, 2), un AS (SELECT unit, sum(n * (n - 1)) AS g FROM per GROUP BY 1 HAVING sum(n) = 3), o AS (SELECT count(*) AS units, avg(g / 6.0) AS o FROM un),
c AS (SELECT sum(c * c) AS c2 FROM (SELECT value, CAST(sum(n) AS DOUBLE) AS c FROM per WHERE unit IN (SELECT unit FROM un) GROUP BY 1)) SELECT units, round((o - c2 / (units * 3 * units * 3)) / (1 - c2 / (units * 3 * units * 3)), 6) AS kappa FROM o, c""")
def fleiss(spark: SparkSession, d: str) -> DataFrame:
    return ag.fleiss_kappa(ratings(spark, d), 3).select("units", r6("kappa", "kappa"))


#: Token masks over the words of turns: gold by a rule, three runs of predictions that miss and add by other rules.
_GOLD, _PRED = "CAST((pos * 7 + doc) % 9 < 2 AS INTEGER)", "CAST(CASE WHEN (pos + doc + run) % 8 = 0 THEN 1 - ((pos * 7 + doc) % 9 < 2)::INTEGER ELSE ((pos * 7 + doc) % 9 < 2)::INTEGER END AS INTEGER)"
_PREDS = f"{fx.SQL_WORDS_OF}, preds AS (SELECT run, doc, line, pos, word, {_GOLD} AS gold, {_PRED} AS pred FROM words, (SELECT unnest(range(3)) AS run))"
_BLOCK = "blocks AS (SELECT run, doc, line, list(gold ORDER BY pos) AS gold, list(pred ORDER BY pos) AS pred FROM preds GROUP BY 1, 2, 3)"


def predictions(spark: SparkSession, d: str) -> DataFrame:
    runs = spark.range(3).select(F.col("id").alias("run"))
    return fx.words(spark, d).crossJoin(F.broadcast(runs)).withColumn("gold", F.expr(_GOLD.replace("AS INTEGER", "AS INT"))).withColumn("pred", F.when((F.col("pos") + F.col("doc") + F.col("run")) % 8 == 0, 1 - F.col("gold")).otherwise(F.col("gold")))


def blocks(spark: SparkSession, d: str) -> DataFrame:
    by_pos = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda x: x[c])
    return predictions(spark, d).groupBy("run", "doc", "line").agg(by_pos("gold").alias("gold"), by_pos("pred").alias("pred"))


_PRF = "count(*) FILTER (WHERE gold = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE gold = 0 AND pred = 1) AS fp, count(*) FILTER (WHERE gold = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE gold = 0 AND pred = 0) AS tn"
_RATES = "round(coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0), 6) AS precision, round(coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0), 6) AS recall, CAST(round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS DOUBLE) AS f1, round((tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE), 6) AS accuracy, tp + fn AS support"


@query(f"WITH {_PREDS}, c AS (SELECT run, {_PRF} FROM preds GROUP BY 1) SELECT run, tp, fp, fn, tn, {_RATES} FROM c")
def binary_prf(spark: SparkSession, d: str) -> DataFrame:
    m = mt.binary_prf(predictions(spark, d), ("run",))
    return m.select("run", "tp", "fp", "fn", "tn", *(r6(c, c) for c in ("precision", "recall", "f1", "accuracy")), "support")


_CLASS = "l AS (SELECT lang, quality AS gold, toxic AS pred FROM labels JOIN documents USING (doc_id)), x AS (SELECT lang, gold AS label, CAST(gold = pred AS INTEGER) AS tp, 1 AS g, 0 AS p FROM l UNION ALL SELECT lang, pred, 0, 0, 1 FROM l), rep AS (SELECT lang, label, sum(tp) AS tp, sum(g) AS support, sum(p) AS predicted FROM x GROUP BY 1, 2), f AS (SELECT *, coalesce(2.0 * tp / nullif(support + predicted, 0), 0) AS f1 FROM rep)"


def _report(spark: SparkSession, d: str) -> DataFrame:
    l = fx.table(spark, d, "labels").join(fx.table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return mt.class_report(l.select("lang", F.col("quality").alias("gold"), F.col("toxic").alias("pred")), ("lang",))


@query(f"WITH {_CLASS} SELECT lang, CAST(label AS BIGINT) AS label, round(coalesce(tp / CAST(nullif(predicted, 0) AS DOUBLE), 0), 6) AS precision, round(coalesce(tp / CAST(nullif(support, 0) AS DOUBLE), 0), 6) AS recall, CAST(round(f1, 6) AS DOUBLE) AS f1, CAST(support AS BIGINT) AS support FROM f")
def prf_by_stratum(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d).select("lang", F.col("label").cast("long"), *(r6(c, c) for c in ("precision", "recall", "f1")), "support")


@query(f"WITH {_CLASS}, t AS (SELECT *, sum(support) OVER (PARTITION BY lang) AS s, sum(support * f1) OVER (PARTITION BY lang) AS w FROM f) SELECT lang, CAST(label AS BIGINT) AS label, CAST(round((w - support * f1) / nullif(s - support, 0) - w / s, 6) AS DOUBLE) + 0.0::DOUBLE AS delta_if_removed FROM t WHERE support > 0")
def impact_if_removed(spark: SparkSession, d: str) -> DataFrame:
    return mt.impact_if_removed(_report(spark, d), ("lang",)).select("lang", F.col("label").cast("long"), (F.round("delta_if_removed", 6) + F.lit(0.0)).alias("delta_if_removed"))


@query(f"WITH {_CLASS} SELECT lang, CAST(round(coalesce(2.0 * sum(tp) / nullif(sum(support) + sum(predicted), 0), 0), 6) AS DOUBLE) AS micro_f1, CAST(round(avg(f1), 6) AS DOUBLE) AS macro_f1, CAST(round(sum(f1 * support) / sum(support), 6) AS DOUBLE) AS weighted_f1 FROM f GROUP BY 1")
def f1_averages(spark: SparkSession, d: str) -> DataFrame:
    return mt.averages(_report(spark, d), ("lang",)).select("lang", *(r6(c, c) for c in ("micro_f1", "macro_f1", "weighted_f1")))


@query(f"WITH {_PREDS}, {_BLOCK} SELECT run, round(avg(CAST(gold = pred AS DOUBLE)), 6) AS exact_match, count(*) AS blocks FROM blocks GROUP BY 1")
def exact_match(spark: SparkSession, d: str) -> DataFrame:
    return mt.exact_match(blocks(spark, d), ("run",)).select("run", r6("exact_match", "exact_match"), "blocks")


@query(f"""WITH {_PREDS}, s AS (SELECT run, doc, line, sum(CAST(gold = 1 AND pred = 0 AS INTEGER)) AS miss, sum(CAST(gold = 0 AND pred = 1 AS INTEGER)) AS extra, sum(gold) AS g, sum(pred) AS p FROM preds GROUP BY 1, 2, 3)
SELECT run, round(avg(CAST(miss = 0 AND extra = 0 AS DOUBLE)), 6) AS exact, round(avg(CAST(miss > 0 AND extra = 0 AS DOUBLE)), 6) AS too_short, round(avg(CAST(miss = 0 AND extra > 0 AS DOUBLE)), 6) AS too_long, round(avg(CAST(miss > 0 AND extra > 0 AS DOUBLE)), 6) AS other, round(avg(g), 6) AS gold_length, round(avg(p), 6) AS pred_length FROM s GROUP BY 1""")
def scope_shapes(spark: SparkSession, d: str) -> DataFrame:
    m = mt.scope_shapes(blocks(spark, d), ("run",))
    return m.select("run", *(r6(c, c) for c in ("exact", "too_short", "too_long", "other", "gold_length", "pred_length")))


@query(f"WITH {_PREDS} SELECT word AS form, round(count(*) FILTER (WHERE gold = 1 AND pred = 1) / 3.0::DOUBLE, 6) AS found, count(*) FILTER (WHERE gold = 1) // 3 AS gold, round(count(*) FILTER (WHERE gold = 0 AND pred = 1) / 3.0::DOUBLE, 6) AS false_positives FROM preds GROUP BY 1")
def cue_type_recall(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d).withColumnRenamed("word", "token")
    return mt.cue_types(p, 3).select("form", r6("found", "found"), F.col("gold").cast("long").alias("gold"), r6("false_positives", "false_positives"))


@query(f"WITH {_PREDS}, c AS (SELECT run, {_PRF} FROM preds GROUP BY 1), m AS (SELECT run, {_RATES} FROM c), x AS (UNPIVOT m ON precision, recall, f1, accuracy INTO NAME metric VALUE v) SELECT metric, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS std, min(v) AS min, max(v) AS max, count(*) AS n FROM x GROUP BY 1")
def seed_aggregate(spark: SparkSession, d: str) -> DataFrame:
    m = mt.aggregate_runs(binary_prf(spark, d), ["precision", "recall", "f1", "accuracy"])
    return m.select("metric", r6("mean", "mean"), r6("std", "std"), "min", "max", "n")


@query("WITH g AS (SELECT d.lang, d.source AS model, round(avg(CAST(quality = 1 AS DOUBLE)), 6) AS f1 FROM labels JOIN documents d USING (doc_id) GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY f1 DESC, model DESC) AS r FROM g) SELECT lang, model, f1 FROM k WHERE r = 1")
def best_model(spark: SparkSession, d: str) -> DataFrame:
    l = fx.table(spark, d, "labels").join(fx.table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    g = l.groupBy("lang", F.col("source").alias("model")).agg(F.round(F.avg((F.col("quality") == 1).cast("double")), 6).alias("f1"))
    return mt.best(g, ("lang",))


@query("WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS word FROM documents), c AS (SELECT lang, word, count(*) AS n FROM w GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS INTEGER) AS rank FROM c) SELECT lang, word, n, rank FROM r WHERE rank <= 10")
def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    """The ten most frequent words of each language: a top-k report over whole texts."""
    w = fx.table(spark, d, "documents").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("word"))
    return mt.most_common(w, "word", 10, ("lang",))


@query(f"WITH {_PREDS}, b AS (SELECT doc, line, count(*) AS n, sum(gold) AS c, sum(pred) AS s FROM preds WHERE run = 0 GROUP BY 1, 2) SELECT CASE doc % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split, count(*) AS blocks, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(c) AS BIGINT) AS cue_tokens, CAST(sum(s) AS BIGINT) AS scope_tokens, CAST(max(n) AS INTEGER) AS max_len FROM b GROUP BY 1")
def dataset_statistics(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d).where("run = 0").select(F.expr("CASE doc % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END").alias("split"), F.col("gold").alias("tokens"), F.col("gold").alias("cue_masks"), F.col("pred").alias("scope_masks"))
    return mt.dataset_statistics(b)


@query(f"WITH {_PREDS} SELECT doc, line, pos, CAST(2 * sum(pred) >= count(*) AS INTEGER) AS label FROM preds GROUP BY 1, 2, 3")
def majority_label(spark: SparkSession, d: str) -> DataFrame:
    return mt.majority_label(predictions(spark, d).withColumn("label", F.col("pred")), ["doc", "line", "pos"])


@query(f"""WITH {_PREDS}, {_BLOCK}, p AS (SELECT a.run AS who_a, b.run AS who_b, a.pred = b.pred AS same FROM blocks a JOIN blocks b ON a.doc = b.doc AND a.line = b.line AND a.run < b.run)
SELECT CAST(who_a AS STRING) AS who_a, CAST(who_b AS STRING) AS who_b, count(*) AS shared_blocks, round(avg(CAST(same AS DOUBLE)), 6) AS exact_block_agreement FROM p GROUP BY 1, 2""")
def pairwise_blocks(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d).select(F.concat_ws("-", F.col("doc").cast("string"), F.col("line").cast("string")).alias("key"), F.col("run").cast("string").alias("annotator"), F.col("pred").alias("labels"))
    return ag.pairwise(b).select("who_a", "who_b", "shared_blocks", r6("exact_block_agreement", "exact_block_agreement"))


@query(f"""WITH RECURSIVE {fx.SQL_WORDS_OF}, w AS (SELECT doc, line, count(*) AS n FROM words GROUP BY 1, 2), r AS (SELECT doc, line, n, 0 AS node, 0 AS depth FROM w WHERE n > 1 UNION ALL SELECT doc, line, n, 2 * node + x, depth + 1 FROM r, (VALUES (0), (1)) AS b(x) WHERE 2 * node + x > 0 AND 2 * node + x < n)
SELECT doc, line, CAST(node AS INTEGER) AS node, CAST(depth AS INTEGER) AS depth FROM r""")
def tree_depths(spark: SparkSession, d: str) -> DataFrame:
    """Depths in trees in which word k of a line hangs on word k // 2."""
    w = fx.words(spark, d).groupBy("doc", "line").agg(F.count(F.lit(1)).cast("int").alias("n"))
    e = F.sequence(F.lit(1), F.greatest(F.col("n") - 1, F.lit(1)))
    t = w.where("n > 1").select("doc", "line", arrow.tree_depths(F.transform(e, lambda k: F.floor(k / 2).cast("int")), e).alias("depth"))
    return t.select("doc", "line", F.explode("depth").alias("node", "depth"))


# -- evaluation as a whole: blocks and predictions of several models --------------------------------------------------

_JUDGED = f"""{_PREDS}, r AS (SELECT concat('m', CAST(run % 2 AS STRING), '_s', CAST(run AS STRING)) AS model, doc, line, pos, gold, CASE WHEN (doc + line + run) % 9 = 0 AND pos % 10 >= 6 THEN 0 ELSE pred END AS pred, (doc + line + run) % 9 = 0 AND count(*) OVER (PARTITION BY run, doc, line) > 6 AS cut FROM preds)"""


def judged(spark: SparkSession, d: str) -> DataFrame:
    """Lines as blocks, runs as models; every ninth line is cut off after six words."""
    p = predictions(spark, d).withColumn("model", F.concat(F.lit("m"), (F.col("run") % 2).cast("string"), F.lit("_s"), F.col("run").cast("string")))
    by_pos = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda x: x[c])
    b = p.groupBy("model", "run", "doc", "line").agg(by_pos("word").alias("tokens"), by_pos("gold").alias("cue_masks"), by_pos("pred").alias("pred")).withColumn("block_id", F.concat_ws("-", "doc", "line"))
    cut = F.when((F.col("doc") + F.col("line") + F.col("run")) % 9 == 0, F.slice("pred", 1, 6)).otherwise(F.col("pred"))
    blocks = b.where("run = 0").select("block_id", F.col("block_id").alias("sentence_id"), "tokens", "cue_masks")
    return ev.judged(blocks, b.select("model", "block_id", cut.alias("pred")), "cue")


@query(f"""WITH {_JUDGED}, c AS (SELECT model, {_PRF} FROM r GROUP BY 1), b AS (SELECT model, doc, line, bool_and(gold = pred) AS same, bool_or(cut) AS cut FROM r GROUP BY 1, 2, 3), x AS (SELECT model, round(avg(CAST(same AS DOUBLE)), 6) AS exact_match, count(*) AS blocks, count(*) FILTER (WHERE cut) AS truncated_blocks FROM b GROUP BY 1)
SELECT model, tp, fp, fn, tn, {_RATES}, exact_match, blocks, truncated_blocks FROM c JOIN x USING (model)""")
def model_scores(spark: SparkSession, d: str) -> DataFrame:
    s = ev.scores(judged(spark, d))
    return s.select("model", "tp", "fp", "fn", "tn", *(r6(c, c) for c in ("precision", "recall", "f1", "accuracy")), "support", r6("exact_match", "exact_match"), "blocks", "truncated_blocks")


@query(f"""WITH {_JUDGED}, c AS (SELECT model, {_PRF} FROM r GROUP BY 1), b AS (SELECT model, doc, line, bool_and(gold = pred) AS same, bool_or(cut) AS cut FROM r GROUP BY 1, 2, 3), x AS (SELECT model, avg(CAST(same AS DOUBLE)) AS exact_match, count(*) FILTER (WHERE cut) AS truncated_blocks FROM b GROUP BY 1),
m AS (SELECT regexp_replace(model, '_s[0-9]+$', '') AS model, tp / CAST(tp + fp AS DOUBLE) AS precision, tp / CAST(tp + fn AS DOUBLE) AS recall, 2.0 * tp / CAST(2 * tp + fp + fn AS DOUBLE) AS f1, exact_match, truncated_blocks FROM c JOIN x USING (model))
SELECT model, count(*) AS n, CAST(sum(truncated_blocks) AS BIGINT) AS truncated_blocks, {', '.join(f"round(avg({x}), 6) AS {x}_mean, round(coalesce(stddev_samp({x}), 0), 6) AS {x}_std" for x in ("precision", "recall", "f1", "exact_match"))} FROM m GROUP BY 1""")
def model_comparison(spark: SparkSession, d: str) -> DataFrame:
    c = ev.comparison(ev.scores(judged(spark, d)))
    return c.select("model", "n", "truncated_blocks", *(r6(f"{m}_{k}", f"{m}_{k}") for m in ev.METRICS for k in ("mean", "std")))


def _strata_sql(stratum: str) -> str:
    return f"""x AS (SELECT concat({stratum}, '_', gold) AS label, CAST(gold = pred AS INTEGER) AS tp, 1 AS g, 0 AS p FROM w UNION ALL SELECT concat({stratum}, '_', pred), CAST(gold = pred AS INTEGER), 0, 1 FROM w),
c AS (SELECT label, sum(tp * g) AS tp, sum(g) AS support, sum(p) AS predicted FROM x GROUP BY 1), f AS (SELECT *, coalesce(2.0::DOUBLE * tp / nullif(support + predicted, 0), 0) AS f1 FROM c), t AS (SELECT sum(support) AS s, sum(support * f1) AS w FROM f)
SELECT split_part(label, '_', 1) AS stratum, split_part(label, '_', 2) AS gold, round(coalesce(tp / CAST(nullif(predicted, 0) AS DOUBLE), 0), 6) AS precision, round(tp / CAST(support AS DOUBLE), 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support, round((t.w - support * f1) / nullif(s - support, 0) - t.w / s, 6) + 0.0 AS delta_if_removed FROM f, t WHERE support > 0"""


def _stratum_columns(df: DataFrame) -> DataFrame:
    return df.select("stratum", "gold", *(r6(c, c) for c in ("precision", "recall", "f1")), "support", (F.round("delta_if_removed", 6) + F.lit(0.0)).alias("delta_if_removed"))


@query(f"WITH {_PREDS}, w AS (SELECT CAST(CASE WHEN k = 0 THEN 0 ELSE floor(log2(k)) + 1 END AS BIGINT) AS depth, gold, pred FROM (SELECT *, pos % 10 AS k, count(*) OVER (PARTITION BY run, doc, line) AS n FROM preds) WHERE run = 0 AND n > 1 UNION ALL SELECT -1, gold, pred FROM (SELECT *, count(*) OVER (PARTITION BY run, doc, line) AS n FROM preds) WHERE run = 0 AND n = 1), " + _strata_sql("depth"))
def strata_by_depth(spark: SparkSession, d: str) -> DataFrame:
    """Words by their depth in the trees of tree_depths(); lines of one word have no tree."""
    p = predictions(spark, d).where("run = 0").withColumn("node", (F.col("pos") % 10).cast("int"))
    return _stratum_columns(ev.strata(ev.by_depth(p, tree_depths(spark, d), ["doc", "line", "node"]), F.col("depth")))


@query(f"WITH {_PREDS}, w AS (SELECT CAST(sum(gold) OVER (PARTITION BY doc, line) AS BIGINT) AS cues, gold, pred FROM preds WHERE run = 0), " + _strata_sql("cues"))
def strata_by_cues(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d).where("run = 0").withColumn("cues", F.sum("gold").over(W.partitionBy("doc", "line")))
    return _stratum_columns(ev.strata(p, F.col("cues")))


@query("SELECT t.task, a.arch, s.dataset, CAST(k.seed AS INTEGER) AS seed FROM (VALUES ('cue'), ('scope')) t(task), (VALUES ('plain'), ('gat')) a(arch), (SELECT DISTINCT source AS dataset FROM documents) s, (VALUES (42), (43), (44)) k(seed)")
def model_grid(spark: SparkSession, d: str) -> DataFrame:
    names = [r[0] for r in fx.table(spark, d, "documents").select("source").distinct().collect()]  # some dozen data sets
    return ev.grid(spark, ["cue", "scope"], ["plain", "gat"], names, [42, 43, 44])


@query(f"WITH {_PREDS}, b AS (SELECT doc, line, count(*) AS n, sum(gold) AS c, sum(pred) AS s FROM preds WHERE run = 0 GROUP BY 1, 2) SELECT CASE doc % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split, count(*) AS blocks, count(*) FILTER (WHERE n < 0) AS uneven, count(*) FILTER (WHERE n = 0) AS empty, count(*) FILTER (WHERE c = 0) AS without_cue, count(*) FILTER (WHERE c > 0 AND s = 0) AS cue_without_scope FROM b GROUP BY 1")
def dataset_sanity(spark: SparkSession, d: str) -> DataFrame:
    b = blocks(spark, d).where("run = 0").select(F.expr("CASE doc % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END").alias("split"), F.col("gold").alias("tokens"), F.col("gold").alias("cue_masks"), F.col("pred").alias("scope_masks"))
    return ev.sanity(b)


#: Typed spans: runs of three words, cue or scope by rule; predictions lose a word now and then, or change its type.
_TYPED = "CASE ((doc + pos // 3) % 4) WHEN 0 THEN CASE WHEN pos % 3 = 0 THEN 'B-CUE' ELSE 'I-CUE' END WHEN 1 THEN 'I-SCOPE' WHEN 2 THEN CASE WHEN pos % 3 = 1 THEN 'B-SCOPE' ELSE 'O' END ELSE 'O' END"
_GUESSED = "CASE WHEN (pos * 31 + doc * 7) % 17 = 0 THEN 'O' WHEN (pos * 13 + doc * 5) % 23 = 0 THEN 'I-SCOPE' ELSE gold END"
_RUNS = """t_{0} AS (SELECT doc, line, pos, CASE WHEN {0} LIKE '_-%' THEN substr({0}, 1, 1) ELSE 'I' END AS mark, CASE WHEN {0} = 'O' THEN NULL WHEN {0} LIKE '_-%' THEN substr({0}, 3) ELSE {0} END AS type FROM typed),
n_{0} AS (SELECT *, CASE WHEN mark = 'B' OR lag(type) OVER w IS DISTINCT FROM type OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS fresh FROM t_{0} WINDOW w AS (PARTITION BY doc, line ORDER BY pos)),
e_{0} AS (SELECT doc, line, type, min(pos) AS s, max(pos) AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc, line ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM n_{0}) WHERE type IS NOT NULL GROUP BY doc, line, type, run)"""
_RATIO = "CASE WHEN {1} = 0 THEN 0 ELSE {0} / CAST({1} AS DOUBLE) END"


@query(f"""WITH {fx.SQL_WORDS_OF}, typed AS (SELECT *, {_GUESSED} AS pred FROM (SELECT doc, line, pos, {_TYPED} AS gold FROM words)), {_RUNS.format('gold')}, {_RUNS.format('pred')},
c AS (SELECT coalesce(g.type, p.type) AS type, g.s IS NOT NULL AS g, p.s IS NOT NULL AS p FROM e_gold g FULL JOIN e_pred p ON g.doc = p.doc AND g.line = p.line AND g.type = p.type AND g.s = p.s AND g.e = p.e),
k AS (SELECT CASE WHEN grouping(type) = 1 THEN 'all' ELSE type END AS type, count(*) FILTER (WHERE g AND p) AS tp, count(*) FILTER (WHERE p) AS predicted, count(*) FILTER (WHERE g) AS gold FROM c GROUP BY GROUPING SETS ((type), ()))
SELECT type, tp, predicted, gold, round({_RATIO.format('tp', 'predicted')}, 6) AS precision, round({_RATIO.format('tp', 'gold')}, 6) AS recall, round({_RATIO.format('2 * tp', '(predicted + gold)')}, 6) AS f1, round((SELECT avg(CAST(gold = pred AS DOUBLE)) FROM typed), 6) AS accuracy FROM k""")
def entity_scores(spark: SparkSession, d: str) -> DataFrame:
    """Typed spans in all turns, line by line."""
    t = fx.words(spark, d).withColumn("gold", F.expr(_TYPED.replace("pos // 3", "pos div 3"))).withColumn("pred", F.expr(_GUESSED))
    out = mt.entity_scores(t, ["doc", "line"])
    return out.select("type", "tp", "predicted", "gold", *(r6(c, c) for c in ("precision", "recall", "f1", "accuracy")))


#: Three annotators, of whom the third skips every fifth line.
_RATED = "run < 2 OR (doc + line) % 5 <> 0"


@query(f"""WITH {_PREDS}, {_BLOCK}, x AS (SELECT * FROM blocks WHERE {_RATED}), nb AS (SELECT run, count(*) AS n FROM x GROUP BY 1),
p AS (SELECT a.run AS ra, b.run AS rb, a.pred AS la, b.pred AS lb FROM x a JOIN x b ON a.doc = b.doc AND a.line = b.line AND a.run < b.run),
s AS (SELECT ra, rb, count(*) AS shared_blocks, avg(CAST(la = lb AS DOUBLE)) AS exact FROM p GROUP BY 1, 2), q AS (SELECT ra, rb, unnest(la) AS a, unnest(lb) AS b FROM p),
m AS (SELECT ra, rb, CAST(count(*) AS DOUBLE) AS n, CAST(sum(a) AS DOUBLE) AS a1, CAST(sum(b) AS DOUBLE) AS b1, CAST(count(*) FILTER (WHERE a = b) AS DOUBLE) AS same, CAST(count(*) FILTER (WHERE a = 1 AND b = 1) AS DOUBLE) AS xx FROM q GROUP BY 1, 2),
r AS (SELECT ra, rb, n, same / n AS o, (a1 * b1 + (n - a1) * (n - b1)) / (n * n) AS e, (n - same) * 2 / (2 * n) AS dis, 1 - ((a1 + b1) * (a1 + b1 - 1) + (2 * n - a1 - b1) * (2 * n - a1 - b1 - 1)) / (2 * n * (2 * n - 1)) AS de, 2 * xx / (a1 + b1) AS dice FROM m),
u AS (SELECT doc, line, i, list(v) AS vs FROM (SELECT doc, line, unnest(pred) AS v, unnest(range(len(pred))) AS i FROM x) GROUP BY 1, 2, 3), c AS (SELECT CAST(len(vs) AS DOUBLE) AS m, CAST(list_sum(vs) AS DOUBLE) AS y FROM u WHERE len(vs) >= 2),
ka AS (SELECT count(*) AS tokens, count(*) FILTER (WHERE m = 3) AS full_tokens, sum(m) AS t, sum((m * m - y * y - (m - y) * (m - y)) / (m - 1)) AS d, sum(y) AS y1, sum(m - y) AS y0 FROM c),
fk AS (SELECT avg((y * (y - 1) + (3 - y) * (2 - y)) / 6) AS o, sum(y) AS y1, sum(3 - y) AS y0, count(*) * 3.0 AS t FROM c WHERE m = 3)
SELECT CAST(r.ra AS STRING) AS who_a, CAST(r.rb AS STRING) AS who_b, shared_blocks, ba.n - shared_blocks AS unmatched_a, bb.n - shared_blocks AS unmatched_b, round(exact, 6) AS exact_block_agreement, CAST(r.n AS BIGINT) AS tokens, NULL AS tokens_with_all, round(o, 6) AS observed_agreement, round((o - e) / (1 - e), 6) AS cohen_kappa, round(1 - dis / de, 6) AS alpha, NULL AS fleiss_kappa, round(dice, 6) AS positive_dice
FROM r JOIN s ON s.ra = r.ra AND s.rb = r.rb JOIN nb ba ON ba.run = r.ra JOIN nb bb ON bb.run = r.rb
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, tokens, full_tokens, NULL, NULL, round(1 - (d / ka.t) / ((ka.t * ka.t - ka.y1 * ka.y1 - ka.y0 * ka.y0) / (ka.t * (ka.t - 1))), 6), round((o - (fk.y1 * fk.y1 + fk.y0 * fk.y0) / (fk.t * fk.t)) / (1 - (fk.y1 * fk.y1 + fk.y0 * fk.y0) / (fk.t * fk.t)), 6), NULL FROM ka, fk""")
def agreement_report(spark: SparkSession, d: str) -> DataFrame:
    """Each two annotators with what they do not share, and all of them."""
    b = blocks(spark, d).where(_RATED).select(F.concat_ws("-", F.col("doc").cast("string"), F.col("line").cast("string")).alias("key"), F.col("run").cast("string").alias("annotator"), F.col("pred").alias("labels"))
    rates = ("exact_block_agreement", "observed_agreement", "cohen_kappa", "alpha", "fleiss_kappa", "positive_dice")
    return ag.report(b, 3).select("who_a", "who_b", "shared_blocks", "unmatched_a", "unmatched_b", "tokens", "tokens_with_all", *(r6(c, c) for c in rates))

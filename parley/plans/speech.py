"""Queries on recognition scoring, time windows, bootstrap and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.functions import arrow, german
from parley.functions import lexicon as lx
from parley.functions import text as tx
from parley.operators import asr
from parley.operators import metrics as mt
from parley.plans import fixtures as fx
from parley.plans.dialogue import listed
from parley.shared import materialize, once, spread

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


# -- word errors: each sentence of a conversation against the next one -----------------------------------------

_PAIRS = f"""ln AS (SELECT conv_id, turn, role, CAST(i AS BIGINT) AS line, {fx.SQL_WORDS.format('l')} AS w FROM (SELECT conv_id, turn, role, unnest(string_split_regex(text, '[.\n]+')) AS l, unnest(generate_series(1, len(string_split_regex(text, '[.\n]+')))) AS i FROM conversations)),
pairs AS (SELECT * FROM (SELECT conv_id, turn, line, role, w AS ref, lead(w) OVER (PARTITION BY conv_id ORDER BY turn, line) AS hyp FROM ln) WHERE hyp IS NOT NULL),
coded AS (SELECT *, list_distinct(list_concat(ref, hyp)) AS v FROM pairs),
dist AS (SELECT conv_id, turn, line, role, len(ref) AS n, CASE WHEN len(ref) = 0 OR len(hyp) = 0 THEN greatest(len(ref), len(hyp), 1) - CAST(len(ref) = 0 AND len(hyp) = 0 AS INTEGER) ELSE levenshtein(array_to_string(list_transform(ref, lambda t: chr(CAST(0 + list_position(v, t) AS INTEGER))), ''), array_to_string(list_transform(hyp, lambda t: chr(CAST(0 + list_position(v, t) AS INTEGER))), '')) END AS e FROM coded)"""


def line_pairs(spark: SparkSession, d: str) -> DataFrame:
    ln = fx.table(spark, d, "conversations").select("conv_id", "turn", "role", F.posexplode(F.split("text", r"[.\n]+")).alias("line", "l")).select("conv_id", "turn", "role", (F.col("line") + 1).cast("long").alias("line"), tx.words(F.col("l")).alias("ref"))
    nxt = F.lead("ref").over(W.partitionBy("conv_id").orderBy(F.asc_nulls_last("turn"), "line"))
    p = ln.withColumn("hyp", nxt).where("hyp IS NOT NULL")
    return p.withColumn("e", asr.word_errors(F.col("ref"), F.col("hyp"))).withColumn("n", F.size("ref"))


@query(f"WITH {_PAIRS} SELECT role, count(*) AS pairs, CAST(sum(e) AS BIGINT) AS errors, CAST(sum(n) AS BIGINT) AS words, round(sum(e) / CAST(sum(n) AS DOUBLE), 6) AS wer FROM dist GROUP BY 1")
def wer_by_role(spark: SparkSession, d: str) -> DataFrame:
    p = line_pairs(spark, d)
    return p.groupBy("role").agg(F.count(F.lit(1)).alias("pairs"), F.sum("e").alias("errors"), F.sum("n").alias("words"), r6(mt.ratio(F.col("e"), F.col("n")), "wer"))


@query("WITH l AS (SELECT regexp_replace(lower(text), '[^a-z ]', '', 'g') AS a FROM documents), p AS (SELECT a, regexp_replace(a, 'th|on', 'x', 'g') AS b FROM l) SELECT CAST(sum(levenshtein(a, b)) AS BIGINT) AS errors, CAST(sum(length(a)) AS BIGINT) AS chars FROM p")
def cer(spark: SparkSession, d: str) -> DataFrame:
    """Character errors of all documents, each whole."""
    a = F.regexp_replace(F.lower("text"), "[^a-z ]", "")
    p = spread(fx.table(spark, d, "documents").select(a.alias("a"))).withColumn("b", F.regexp_replace("a", "th|on", "x"))
    return p.agg(F.sum(arrow.edit_distance("a", "b")).cast("long").alias("errors"), F.sum(F.length("a")).alias("chars"))


_T = f"{fx.SQL_WORDS_OF}, {fx.SQL_SYSTEMS}"
_MISSED = "missed AS (SELECT system, doc, line, count(*) AS n, avg(CAST(op = 'delete' AS DOUBLE)) >= 0.8 AS missed FROM toks GROUP BY 1, 2, 3)"


def scored(spark: SparkSession, d: str) -> DataFrame:
    return asr.score_documents(asr.alignments(fx.transcripts(spark, d)))


@query()
def document_scores(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d)


@query()
def wer_summary(spark: SparkSession, d: str) -> DataFrame:
    """Rates of the system with the bounds of its word error rate over 1000 resamples of documents."""
    scores = materialize(scored(spark, d), "document-scores")
    return asr.with_intervals(asr.summarize(scores), scores)


@query()
def norm_ablation(spark: SparkSession, d: str) -> DataFrame:
    """Error rates under other normalisers, and under ours with one step off; two more systems are made of the first."""
    p = systems_of(spark, d)
    return asr.norm_rates(p).select("system", "norm", "errors", "words", r6("wer", "wer"))


@query()
def norm_agreement(spark: SparkSession, d: str) -> DataFrame:
    rates = materialize(asr.norm_rates(systems_of(spark, d)), "norm-rates")
    return asr.norm_agreement(rates).select("norm", r6("tau", "tau"))


def systems_of(spark: SparkSession, d: str) -> DataFrame:
    t = fx.transcripts(spark, d).select("ref_text", "hyp_text")
    upper = t.select(F.lit("upper").alias("system"), "ref_text", F.upper("ref_text").alias("hyp_text"))
    short = t.select(F.lit("short").alias("system"), "ref_text", F.substring_index("ref_text", ",", 1).alias("hyp_text"))
    return t.select(F.lit("s").alias("system"), "ref_text", "hyp_text").unionByName(upper).unionByName(short)


@query()
def inserted_passages(spark: SparkSession, d: str) -> DataFrame:
    return asr.inserted_passages(asr.alignments(fx.transcripts(spark, d), variants=("normalized",)))


@query()
def aligned_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Every reference word with its run and what stands for it: what the reports below are made of."""
    return tokens_of(spark, d)


def tokens_of(spark: SparkSession, d: str) -> DataFrame:
    """Lines of ten reference words."""
    al = materialize(asr.alignments(fx.transcripts(spark, d), variants=("normalized",)), "alignments")
    lines = al.select("doc", F.posexplode("ref_normalized").alias("pos", "word")).select("doc", "pos", F.floor(F.col("pos") / 10).cast("long").alias("line"))
    return asr.reference_tokens(al, lines)


@query()
def aligned_misses(spark: SparkSession, d: str) -> DataFrame:
    """Missed lines by system, length and role, of real alignments."""
    m = asr.missed_lines(tokens_of(spark, d)).join(fx.transcripts(spark, d).select("doc", "role").distinct(), "doc")
    return asr.miss_rates(m, "role").select("system", "size", "lines", r6("miss_rate", "miss_rate"))


@query(f"WITH {_T}, {_MISSED} SELECT doc, line, max(n) AS n FROM missed WHERE n >= 3 GROUP BY 1, 2 HAVING count(*) FILTER (WHERE missed) = 6")
def missed_by_all(spark: SparkSession, d: str) -> DataFrame:
    return asr.missed_by_all(missed(spark, d), fx.SYSTEMS)


@query()
def hypothesis_by_line(spark: SparkSession, d: str) -> DataFrame:
    al = materialize(asr.alignments(fx.transcripts(spark, d), variants=("normalized",)), "alignments")
    lines = asr.line_positions(al.select("doc", F.lit(0).alias("line"), F.col("ref_normalized").alias("tokens")))
    return asr.hypothesis_by_line(al, lines)


def missed(spark: SparkSession, d: str) -> DataFrame:
    return asr.missed_lines(fx.system_tokens(spark, d))


@query(f"WITH {_T}, {_MISSED} SELECT * FROM missed")
def missed_lines(spark: SparkSession, d: str) -> DataFrame:
    return missed(spark, d)


@query(f"""WITH {_T}, {_MISSED}, s AS (SELECT *, CASE WHEN n = 1 THEN '1' WHEN n <= 3 THEN '2-3' WHEN n <= 9 THEN '4-9' ELSE '10+' END AS size FROM missed)
SELECT system, coalesce(size, 'all') AS size, count(*) AS lines, round(avg(CAST(missed AS DOUBLE)), 6) AS miss_rate FROM s GROUP BY GROUPING SETS ((system, size), (system))""")
def miss_rates(spark: SparkSession, d: str) -> DataFrame:
    return asr.miss_rates(missed(spark, d)).select("system", "size", "lines", r6("miss_rate", "miss_rate"))


@query(f"WITH {_T}, {_MISSED} SELECT systems, count(*) AS lines FROM (SELECT doc, line, count(*) FILTER (WHERE missed) AS systems FROM missed GROUP BY 1, 2) GROUP BY 1")
def miss_agreement(spark: SparkSession, d: str) -> DataFrame:
    return asr.miss_agreement(missed(spark, d))


@query(f"""WITH {_T}, p AS (SELECT word, system, avg(CAST(op = 'equal' AS DOUBLE)) AS r, count(*) AS n FROM toks WHERE word NOT IN {listed(lx.STOP_WORDS)} AND word NOT IN {listed([w for w in german.number_words()])} GROUP BY 1, 2), w AS (SELECT word, round(avg(r), 6) AS mean_recall, max(n) AS n FROM p GROUP BY 1)
SELECT * FROM w WHERE n >= 3 ORDER BY mean_recall, word LIMIT 40""")
def hard_words(spark: SparkSession, d: str) -> DataFrame:
    """The forty words with the lowest mean recall: a top-k report over all tokens."""
    return asr.hard_words(fx.system_tokens(spark, d), fx.SYSTEMS).select("word", r6("mean_recall", "mean_recall"), "n")


@query(f"WITH {_T}, c AS (SELECT word, alt, count(*) AS n FROM toks WHERE op = 'substitute' GROUP BY 1, 2) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY word ORDER BY n DESC, alt) AS INTEGER) AS rank FROM c) WHERE rank <= 4")
def substitutions(spark: SparkSession, d: str) -> DataFrame:
    return asr.substitutions(fx.system_tokens(spark, d))


@query(f"""WITH {_T}, ok AS (SELECT doc, line, pos, word FROM toks WHERE system = 's0' AND alt = '='), o AS (SELECT * FROM toks WHERE system <> 's0'), df AS (SELECT doc, pos, count(*) FILTER (WHERE coalesce(alt, '') <> '=') AS differ FROM o GROUP BY 1, 2),
al AS (SELECT doc, pos, alt, count(*) AS votes FROM o WHERE alt IS NOT NULL AND alt <> '=' GROUP BY 1, 2, 3), tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, pos ORDER BY votes DESC, alt DESC) AS r FROM al) WHERE r = 1)
SELECT ok.doc, ok.line, ok.pos, ok.word, tp.alt AS alternative, tp.votes FROM ok JOIN df USING (doc, pos) JOIN tp USING (doc, pos) WHERE differ >= 4 AND votes >= 3""")
def anchoring(spark: SparkSession, d: str) -> DataFrame:
    return asr.anchoring_suspects(fx.system_tokens(spark, d), "s0", ["s1", "s2", "s3", "s4", "s5"])


@query(f"WITH {_T}, h AS (SELECT DISTINCT system, doc FROM toks WHERE NOT (system = 's1' AND doc % 50 = 0)) SELECT system, count(*) AS docs FROM h GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT doc) FROM words)")
def complete_systems(spark: SparkSession, d: str) -> DataFrame:
    t = fx.system_tokens(spark, d)
    hyp = t.select("system", "doc").distinct().where("NOT (system = 's1' AND doc % 50 = 0)")
    return asr.complete_systems(hyp, t.select("doc").distinct()).groupBy("system").agg(F.count(F.lit(1)).alias("docs"))


# -- time -------------------------------------------------------------------------------------------------------------

_REGIONS = "reg AS (SELECT user_id, event_id, epoch_us(ts) / 1000000.0::DOUBLE AS s, epoch_us(ts) / 1000000.0::DOUBLE + coalesce(value, 0) / 100 AS e FROM events)"


def regions(spark: SparkSession, d: str) -> DataFrame:
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return fx.table(spark, d, "events").select("user_id", "event_id", s.alias("start"), (s + F.coalesce("value", F.lit(0.0)) / 100).alias("end"), "event_type", F.col("ts"))


@query(f"""WITH RECURSIVE {_REGIONS}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, e) AS k FROM reg), r AS (SELECT user_id, k, s AS ws, e AS we, 0 AS win FROM o WHERE k = 1 UNION ALL
SELECT o.user_id, o.k, CASE WHEN o.e - r.ws <= 3000 AND o.s - r.we <= 1000 THEN r.ws ELSE o.s END, o.e, CASE WHEN o.e - r.ws <= 3000 AND o.s - r.we <= 1000 THEN r.win ELSE r.win + 1 END FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
SELECT user_id, CAST(win AS INTEGER) AS win, round(min(ws), 3) AS start, round(arg_max(we, k), 3) AS stop FROM r GROUP BY 1, 2""")
def vad_pack(spark: SparkSession, d: str) -> DataFrame:
    p = asr.pack_windows(regions(spark, d).select("user_id", "start", "end"), "user_id", most=3000.0, gap=1000.0)
    return p.select("user_id", "win", F.round("start", 3).alias("start"), F.round("end", 3).alias("stop"))


@query("""WITH w AS (SELECT user_id, CAST(epoch_us(ts) // 3600000000 AS BIGINT) AS lo, CAST(epoch_us(ts) // 3600000000 + CAST(floor(coalesce(value, 0)) AS BIGINT) % 5 AS BIGINT) AS hi FROM events),
m AS (SELECT *, CASE WHEN lo > max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS n FROM w), u AS (SELECT *, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS BIGINT) AS unit FROM m)
SELECT user_id, unit, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM u GROUP BY 1, 2""")
def interval_units(spark: SparkSession, d: str) -> DataFrame:
    hour = F.expr("unix_micros(CAST(ts AS TIMESTAMP)) DIV 3600000000")  # towards zero, as the SQL's
    w = fx.table(spark, d, "events").select("user_id", hour.alias("lo"), (hour + F.floor(F.coalesce("value", F.lit(0.0))).cast("long") % 5).alias("hi"))
    return asr.merge_intervals(w, "user_id", "lo", "hi").withColumn("unit", F.col("unit").cast("long"))


@query("""WITH w AS (SELECT user_id AS doc, CAST(epoch_us(ts) // 864000000000 AS BIGINT) AS win, event_type AS system, CAST(coalesce(value, 0) > 50 AS INTEGER) AS inserted FROM events), p AS (SELECT doc, win, system, count(*) AS n, sum(inserted) AS ins FROM w GROUP BY 1, 2, 3)
SELECT doc, win, count(*) FILTER (WHERE n >= 2 AND ins >= 0.5 * n) AS models_hearing FROM p GROUP BY 1, 2 HAVING count(*) FILTER (WHERE n >= 2 AND ins >= 0.5 * n) >= 3""")
def coverage_windows(spark: SparkSession, d: str) -> DataFrame:
    day = F.expr("unix_micros(CAST(ts AS TIMESTAMP)) DIV 864000000000")
    w = fx.table(spark, d, "events").select(F.col("user_id").alias("doc"), day.alias("win"), F.col("event_type").alias("system"), (F.coalesce("value", F.lit(0.0)) > 50).cast("int").alias("inserted"))
    return asr.uncovered_windows(w)


@query("""WITH l AS (SELECT user_id AS doc, event_id AS pos, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 1000 AS DOUBLE) END AS s FROM events), t AS (SELECT *, s + 1.5 AS e FROM l),
c AS (SELECT *, last_value(e IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM t)
SELECT doc, pos, CASE WHEN s IS NOT NULL THEN concat(printf('%.1f', s), '-', printf('%.1f', e)) WHEN p IS NOT NULL THEN concat('~', printf('%.1f', p)) ELSE '~start' END AS time FROM c""")
def carry_forward_time(spark: SparkSession, d: str) -> DataFrame:
    l = fx.table(spark, d, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("pos"), F.when(F.col("event_id") % 3 != 0, (F.col("event_id") % 1000).cast("double")).alias("start"))
    return asr.running_time(l.withColumn("end", F.col("start") + 1.5)).select("doc", "pos", "time")


@query("WITH w AS (SELECT user_id AS doc, event_id % 20 AS line, CASE WHEN event_id % 7 = 0 THEN NULL ELSE coalesce(value, 0) / 1000 END AS score FROM events) SELECT doc, line, round(coalesce(avg(score), 0), 9) AS score, count(*) AS n, count(score) > 0 AS heard FROM w GROUP BY 1, 2")
def line_scores(spark: SparkSession, d: str) -> DataFrame:
    w = fx.table(spark, d, "events").select(F.col("user_id").alias("doc"), (F.col("event_id") % 20).alias("line"), F.when(F.col("event_id") % 7 != 0, F.coalesce("value", F.lit(0.0)) / 1000).alias("score"))
    return asr.line_scores(w).withColumn("score", F.round("score", 9))


@query("SELECT event_type, count(*) AS n, round(median(coalesce(value, 0) / 1000), 6) AS median, round(avg(CAST(coalesce(value, 0) / 1000 < 0.05 AS DOUBLE)), 6) AS low_share FROM events GROUP BY 1")
def score_quality(spark: SparkSession, d: str) -> DataFrame:
    w = fx.table(spark, d, "events").select("event_type", (F.coalesce("value", F.lit(0.0)) / 1000).alias("score"))
    return asr.score_quality(w, ("event_type",)).select("event_type", "n", r6("median", "median"), r6("low_share", "low_share"))


@query("""WITH e AS (SELECT user_id AS doc, event_id % 12 AS line, CASE WHEN event_id % 4 <> 0 THEN CAST(event_id % 9 AS INTEGER) END AS win, event_id FROM events), v AS (SELECT doc, line, win, count(*) AS n, min(event_id) AS f FROM e GROUP BY 1, 2, 3), l AS (SELECT DISTINCT doc, line FROM v),
b AS (SELECT *, row_number() OVER (PARTITION BY doc, line ORDER BY n DESC, f) AS r FROM v WHERE win IS NOT NULL), p AS (SELECT l.doc, l.line, b.win AS best, row_number() OVER (PARTITION BY l.doc ORDER BY l.line) AS k FROM l LEFT JOIN b ON b.doc = l.doc AND b.line = l.line AND b.r = 1),
h AS (SELECT a.doc, a.line, a.k, max(b.best) AS here FROM p a LEFT JOIN p b ON b.doc = a.doc AND b.k <= a.k AND a.best IS NOT NULL GROUP BY 1, 2, 3),
g AS (SELECT h.doc, h.line, h.k, h.here, coalesce(max(x.here) FILTER (WHERE x.k < h.k), -1) AS low, coalesce(min(x.here) FILTER (WHERE x.k > h.k), 9) AS high, coalesce(max(x.k) FILTER (WHERE x.k < h.k AND x.here IS NOT NULL), 0) AS kl FROM h LEFT JOIN h x ON x.doc = h.doc GROUP BY 1, 2, 3, 4),
w AS (SELECT doc, line, k, CAST(CASE WHEN here IS NOT NULL THEN here WHEN high - low > 1 THEN low + least(k - kl, high - low - 1) ELSE greatest(low, 0) END AS INTEGER) AS win FROM g), t AS (SELECT doc, line, sum(n) AS total FROM v WHERE win IS NOT NULL GROUP BY 1, 2),
s AS (SELECT w.doc, w.line, w.k, w.win, least(w.win, coalesce(min(v.win) FILTER (WHERE 4 * v.n >= t.total), w.win)) AS lo, greatest(w.win, coalesce(max(v.win) FILTER (WHERE 4 * v.n >= t.total), w.win)) AS hi FROM w LEFT JOIN t USING (doc, line) LEFT JOIN v ON v.doc = w.doc AND v.line = w.line AND v.win IS NOT NULL GROUP BY 1, 2, 3, 4)
SELECT a.doc, a.line, a.win, CAST(least(max(b.lo), a.win) AS INTEGER) AS lo, CAST(a.hi AS INTEGER) AS hi FROM s a JOIN s b ON b.doc = a.doc AND b.k <= a.k GROUP BY a.doc, a.line, a.win, a.hi""")
def placed_lines(spark: SparkSession, d: str) -> DataFrame:
    e = fx.table(spark, d, "events").select(F.col("user_id").alias("doc"), (F.col("event_id") % 12).alias("line"), F.when(F.col("event_id") % 4 != 0, (F.col("event_id") % 9).cast("int")).alias("win"), "event_id")
    votes = e.groupBy("doc", "line", "win").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))
    return asr.place_lines(votes, e.select("doc").distinct().withColumn("n_windows", F.lit(9)))


@query("""WITH f AS (SELECT source AS annotator, doc_id AS doc, n_chars AS words, n_chars % 17 AS edits, n_chars % 11 AS errors FROM documents), i AS (SELECT doc_id AS doc, count(*) AS anchors FROM labels WHERE toxic = 1 GROUP BY 1), u AS (SELECT user_id AS doc, sum(coalesce(value, 0)) AS seconds FROM events GROUP BY 1)
SELECT annotator, count(*) AS docs, round(sum(edits) / CAST(sum(words) AS DOUBLE), 6) AS edit_rate, round(sum(errors) / CAST(sum(words) AS DOUBLE), 6) AS model_wer, CAST(round(coalesce(sum(anchors), 0) * 1000.0 / sum(words), 6) AS DOUBLE) AS anchors_per_1k, round(coalesce(sum(seconds), 0) / 60, 4) AS missed_minutes FROM f LEFT JOIN i USING (doc) LEFT JOIN u USING (doc) GROUP BY 1""")
def reference_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = fx.table(spark, d, "documents").select(F.col("source").alias("annotator"), F.col("doc_id").alias("doc"), F.col("n_chars").alias("words"), (F.col("n_chars") % 17).alias("edits"), (F.col("n_chars") % 11).alias("errors"))
    issues = fx.table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("doc"), F.lit("anchoring_suspect").alias("category"))
    gone = fx.table(spark, d, "events").select(F.col("user_id").alias("doc"), F.coalesce("value", F.lit(0.0)).alias("seconds"))
    q = asr.reference_quality(docs, issues, gone)
    return q.select("annotator", "docs", r6("edit_rate", "edit_rate"), r6("model_wer", "model_wer"), r6("anchors_per_1k", "anchors_per_1k"), F.round("missed_minutes", 4).alias("missed_minutes"))


@query("SELECT source AS annotator, count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'es') AS es, count(*) FILTER (WHERE lang = 'fr') AS fr, count(DISTINCT doc_id) AS docs FROM documents GROUP BY 1")
def issue_counts(spark: SparkSession, d: str) -> DataFrame:
    i = fx.table(spark, d, "documents").select(F.col("source").alias("annotator"), F.col("lang").alias("category"), F.col("doc_id").alias("doc"))
    return asr.issue_counts(i, ["de", "en", "es", "fr"])


# -- bootstrap, ranks, vectors ------------------------------------------------------------------------------------------


def _draws(keys: str, n: int) -> str:
    """draws: rep, key, mult, where a hash of key and repetition reaches so many of the Poisson bounds."""
    half = lambda i: f"CAST('0x' || substr(h, {i}, 8) AS UBIGINT)"
    x = f"SELECT key, rep, b, (a + CAST(rep AS UBIGINT) * {mt.STEP}) % 4294967296 AS x FROM halves, (SELECT unnest(range({n})) AS rep)"
    mix = lambda t: f"SELECT key, rep, b, xor(x, x >> 16) AS x FROM (SELECT key, rep, b, xor(x, x >> 15) * {mt.MIX[1]} % 4294967296 AS x FROM (SELECT key, rep, b, xor(x, x >> 16) * {mt.MIX[0]} % 4294967296 AS x FROM ({t})))"
    x = mix(f"SELECT key, rep, b, xor(x, b) AS x FROM ({mix(x)})")
    return f"""ks AS (SELECT key, sha256(concat('42|', CAST(key AS STRING))) AS h FROM (SELECT DISTINCT {keys})), halves AS (SELECT key, {half(1)} AS a, {half(9)} AS b FROM ks),
draws AS (SELECT key, CAST(rep AS INTEGER) AS rep, {' + '.join(f'CAST(x >= {t} AS BIGINT)' for t in mt.POISSON)} AS mult FROM ({x}))"""


_N = 10_000


def _ci(n: int) -> str:
    return f"""WITH {_PAIRS}, {_draws('conv_id AS key FROM dist', n)}, p AS (SELECT conv_id AS key, sum(e) AS num, sum(n) AS den FROM dist GROUP BY 1), st AS (SELECT rep, CAST(sum(num * mult) AS DOUBLE) / nullif(sum(den * mult), 0) AS v FROM p JOIN draws USING (key) GROUP BY 1),
k AS (SELECT v, row_number() OVER (ORDER BY v NULLS FIRST, rep) - 1 AS k FROM st) SELECT 'all' AS system, round(max(v) FILTER (WHERE k = {int(0.025 * n)}), 6) AS lo, round(max(v) FILTER (WHERE k = {int(0.975 * n) - 1}), 6) AS hi FROM k"""


def interval(spark: SparkSession, d: str, n: int) -> DataFrame:
    f = line_pairs(spark, d).select(F.lit("all").alias("system"), F.col("conv_id").alias("key"), F.col("e").alias("num"), F.col("n").alias("den"))
    return mt.ratio_bounds(f, n).select("system", r6("lo", "lo"), r6("hi", "hi"))


@query(_ci(1000))
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """As many resamples of conversations as the reference draws."""
    return interval(spark, d, 1000)


def _f1(x: str, m: str) -> str:
    return f"coalesce(2.0 * sum(tp{x}{m}) / nullif(2 * sum(tp{x}{m}) + sum(fp{x}{m}) + sum(fn{x}{m}), 0), 0)"


_B = "CASE WHEN doc_id % 3 = 0 THEN 1 - quality ELSE quality END"
_SIDES = f"""b AS (SELECT own AS key, CAST(sum(quality * toxic) AS BIGINT) AS tpa, CAST(sum((1 - quality) * toxic) AS BIGINT) AS fpa, CAST(sum(quality * (1 - toxic)) AS BIGINT) AS fna, CAST(sum(quality * ({_B})) AS BIGINT) AS tpb, CAST(sum((1 - quality) * ({_B})) AS BIGINT) AS fpb, CAST(sum(quality * (1 - ({_B}))) AS BIGINT) AS fnb FROM (SELECT l.*, {{0}} AS own FROM labels l JOIN documents USING (doc_id)) GROUP BY 1)"""


def sides(spark: SparkSession, d: str, key: Column) -> DataFrame:
    l = fx.table(spark, d, "labels").join(fx.table(spark, d, "documents").select("doc_id", key.alias("key")), "doc_id")
    two = l.select("key", F.col("quality").alias("g"), F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("toxic").cast("long").alias("p")), F.struct(F.lit("b").alias("side"), F.expr(_B).cast("long").alias("p")))).alias("x"))
    p, g = F.col("x.p"), F.col("g")
    return two.groupBy("key", F.col("x.side").alias("side"), F.lit(0).alias("run")).agg(F.sum(g * p).alias("tp"), F.sum((1 - g) * p).alias("fp"), F.sum(g * (1 - p)).alias("fn"))


def _paired(key: str) -> str:
    return f"""WITH {_SIDES.format(key)}, {_draws('key FROM b', _N)}, o AS (SELECT {_f1('a', '')} - {_f1('b', '')} AS delta FROM b), st AS (SELECT rep, {_f1('a', ' * mult')} - {_f1('b', ' * mult')} AS v FROM b JOIN draws USING (key) GROUP BY 1),
k AS (SELECT v, row_number() OVER (ORDER BY v NULLS FIRST, rep) - 1 AS k FROM st) SELECT CAST(round(any_value(delta), 6) AS DOUBLE) AS delta_f1, CAST(round(max(v) FILTER (WHERE k = {int(0.025 * _N)}), 6) AS DOUBLE) AS lo, CAST(round(max(v) FILTER (WHERE k = {int(0.975 * _N) - 1}), 6) AS DOUBLE) AS hi FROM k, o"""


@query(_paired("concat(source, lang)"))
def paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    blocks = sides(spark, d, F.concat("source", "lang"))
    return mt.paired_bounds(blocks, _N).select(r6("delta_f1", "delta_f1"), r6("lo", "lo"), r6("hi", "hi"))


@query(_paired("doc_id"))
def paired_bootstrap_10000(spark: SparkSession, d: str) -> DataFrame:
    """Single documents, as many resamples as the reference draws."""
    return mt.paired_bounds(sides(spark, d, F.col("doc_id")), _N).select(r6("delta_f1", "delta_f1"), r6("lo", "lo"), r6("hi", "hi"))


@query("""WITH s AS (SELECT lang AS system, avg(n_chars) AS a, avg(CAST(doc_id % 97 AS DOUBLE)) AS b FROM documents GROUP BY 1 UNION ALL SELECT source, avg(n_chars), avg(CAST(doc_id % 97 AS DOUBLE)) FROM documents GROUP BY 1)
SELECT round(sum(sign((x.a - y.a) * (x.b - y.b))) / CAST(count(*) AS DOUBLE), 6) AS tau FROM s x JOIN s y ON x.system < y.system""")
def kendall_tau(spark: SparkSession, d: str) -> DataFrame:
    t = fx.table(spark, d, "documents")
    s = None
    for c in ("lang", "source"):
        one = t.groupBy(F.col(c).alias("system")).agg(F.avg("n_chars").alias("a"), F.avg((F.col("doc_id") % 97).cast("double")).alias("b"))
        s = one if s is None else s.unionByName(one)
    return mt.kendall_tau(s).select(r6("tau", "tau"))


_DIST = "v AS (SELECT vec_id, label, embedding AS e FROM embeddings), p AS (SELECT a.vec_id, a.label, 1 - list_cosine_similarity(CAST(a.e AS DOUBLE[]), CAST(b.e AS DOUBLE[])) AS dist FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)"


def distances(spark: SparkSession, d: str) -> DataFrame:
    v = fx.table(spark, d, "embeddings").select("vec_id", "label", mt.normalised(F.col("embedding")).alias("e"))
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f"))
    return v.join(nxt, "vec_id").select("vec_id", "label", mt.unit_distance(F.col("e"), F.col("f")).alias("dist"))


@query(f"WITH {_DIST} SELECT vec_id, round(dist, 5) AS dist FROM p")
def semdist(spark: SparkSession, d: str) -> DataFrame:
    return distances(spark, d).select("vec_id", F.round("dist", 5).alias("dist"))


@query(f"""WITH {_DIST}, l AS (SELECT 'all' AS system, CASE WHEN vec_id % 2 = 0 THEN 'Interviewer' ELSE 'Interviewee' END AS role, dist, vec_id % 4 AS n_err, vec_id % 3 = 0 AS cue_lost, vec_id % 3 < 2 AS has_cue FROM p)
SELECT system, round(avg(dist), 5) AS semdist, round(avg(dist) FILTER (WHERE role = 'Interviewer'), 5) AS semdist_interviewer, round(avg(dist) FILTER (WHERE role = 'Interviewee'), 5) AS semdist_interviewee, round(avg(CAST(dist < 1e-6 AS DOUBLE)), 5) AS exact_lines, count(*) FILTER (WHERE cue_lost AND n_err BETWEEN 1 AND 2) AS cue_lost_n,
round(avg(dist) FILTER (WHERE cue_lost AND n_err BETWEEN 1 AND 2), 5) AS semdist_cue_lost, round(avg(dist) FILTER (WHERE has_cue AND NOT cue_lost AND n_err BETWEEN 1 AND 2), 5) AS semdist_cue_kept FROM l GROUP BY 1""")
def semdist_summary(spark: SparkSession, d: str) -> DataFrame:
    l = distances(spark, d).selectExpr("'all' AS system", "CASE WHEN vec_id % 2 = 0 THEN 'Interviewer' ELSE 'Interviewee' END AS role", "dist", "vec_id % 4 AS n_err", "vec_id % 3 = 0 AS cue_lost", "vec_id % 3 < 2 AS has_cue")
    s = asr.semantic_summary(l)
    r5 = [F.round(c, 5).alias(c) for c in ("semdist", "semdist_interviewer", "semdist_interviewee", "exact_lines")]
    return s.select("system", *r5, "cue_lost_n", F.round("semdist_cue_lost", 5).alias("semdist_cue_lost"), F.round("semdist_cue_kept", 5).alias("semdist_cue_kept"))


@query()
def blind_spot(spark: SparkSession, d: str) -> DataFrame:
    l = spread(fx.lines(spark, d).select("doc_id", "line", "text")).select((F.col("doc_id") * 1_000_000 + F.col("line")).alias("line"), once(german.tokens(F.col("text"))).alias("tokens"))
    return asr.blind_spot(l).select("line", F.array_join("without_cue", " ").alias("without_cue"), F.array_join("without_other", " ").alias("without_other"))


# -- words and time windows -------------------------------------------------------------------------------------------------

#: A word's time, and windows that leave gaps and overlap.
_WIN = "(SELECT doc, CAST(k AS INTEGER) AS win, k * 3.0 AS lo, k * 3.0 + CASE WHEN k % 4 = 0 THEN 2.25 ELSE 3.5 END AS hi FROM (SELECT doc, unnest(range(n)) AS k FROM (SELECT doc, CAST(max(pos) * 0.375 / 3 AS BIGINT) + 1 AS n FROM words GROUP BY 1)))"


@query(f"WITH {fx.SQL_WORDS_OF}, v AS {_WIN} SELECT w.doc, w.pos, v.win FROM words w JOIN v ON v.doc = w.doc AND w.pos * 0.375 >= v.lo AND w.pos * 0.375 < v.hi")
def token_windows(spark: SparkSession, d: str) -> DataFrame:
    """Each word of the turns with the time windows that hold it."""
    w = fx.words(spark, d).withColumn("at", F.col("pos") * 0.375)
    n = w.groupBy("doc").agg((F.round(F.max("pos") * 0.375 / 3).cast("long") + 1).alias("n"))
    k = n.select("doc", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    v = k.select("doc", F.col("k").cast("int").alias("win"), (F.col("k") * 3.0).alias("lo"), (F.col("k") * 3.0 + F.when(F.col("k") % 4 == 0, 2.25).otherwise(3.5)).alias("hi"))
    return asr.in_intervals(w, v, "at", "lo", "hi", ["doc"], 3.0).select("doc", "pos", "win")


@query(f"""WITH {_T}, h AS (SELECT system, doc, line, pos, row_number() OVER (PARTITION BY system, doc ORDER BY pos) - 1 AS hyp_pos FROM toks WHERE op <> 'delete')
SELECT doc, line, CAST(hyp_pos // 8 AS INTEGER) AS win, count(*) AS n FROM h GROUP BY 1, 2, 3""")
def window_votes(spark: SparkSession, d: str) -> DataFrame:
    """How many words of the six systems put each line into each window of eight heard words."""
    t = fx.system_tokens(spark, d)
    heard = t.where("op <> 'delete'").withColumn("hyp_pos", F.row_number().over(W.partitionBy("system", "doc").orderBy("pos")) - 1)
    matched = heard.select("system", "doc", "pos", "hyp_pos")
    wins = heard.select("system", "doc", "hyp_pos", F.floor(F.col("hyp_pos") / 8).cast("int").alias("win"))
    return asr.window_votes(matched, fx.words(spark, d).select("doc", "pos", "line"), wins)


@query()
def heard_windows(spark: SparkSession, d: str) -> DataFrame:
    """The same from real alignments: windows of eight words of the hypothesis, lines of ten of the reference."""
    al = materialize(asr.alignments(fx.transcripts(spark, d), variants=("normalized",)), "alignments")
    wins = al.select("system", "doc", F.posexplode("hyp_normalized").alias("hyp_pos", "w")).select("system", "doc", "hyp_pos", F.floor(F.col("hyp_pos") / 8).cast("int").alias("win"))
    lines = al.select("doc", F.posexplode("ref_normalized").alias("pos", "w")).select("doc", "pos", F.floor(F.col("pos") / 10).cast("long").alias("line"))
    return asr.window_votes(asr.matched_positions(al), lines, wins)

"""Queries on turns, text and the sentence gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import arrow, german, issues
from parley.functions import lexicon as lx
from parley.functions import text as tx
from parley.operators import dialogue as dg
from parley.operators import segment as sg
from parley.plans import fixtures as fx
from parley.shared import spread

Q, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def listed(words: list[str]) -> str:
    return "(" + ", ".join("'" + w + "'" for w in words) + ")"


def turns(spark: SparkSession, d: str) -> DataFrame:
    return dg.clean_turns(fx.raw_turns(spark, d))


@query(f"WITH {fx.MERGED} SELECT interview_id, turn_idx, role, text, n_parts, first_pos, role_turn_idx FROM turns")
def turn_merge(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).select("interview_id", "turn_idx", "role", "text", F.size("parts").cast("long").alias("n_parts"), "first_pos", "role_turn_idx")


@query(f"WITH raw AS ({fx.RAW}) SELECT interview_id, count(*) AS n_raw, count(*) FILTER (WHERE role IN ('Interviewer', 'Interviewee') AND trim(text) = '') AS n_empty FROM raw GROUP BY 1")
def turn_counts(spark: SparkSession, d: str) -> DataFrame:
    return dg.turn_counts(fx.raw_turns(spark, d))


@query(f"""WITH c AS ({fx.CHUNKS}), m AS (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY interview_id ORDER BY start, stop, chunk_id) THEN 0 ELSE 1 END AS n FROM c),
i AS (SELECT *, CAST(sum(n) OVER (PARTITION BY interview_id ORDER BY start, stop, chunk_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS turn_idx FROM m)
SELECT interview_id, turn_idx, any_value(role) AS role, string_agg(text, ' ' ORDER BY start, stop, chunk_id) AS text, min(start) AS start, max(stop) AS stop, count(*) AS chunk_count FROM i GROUP BY 1, 2""")
def turn_fold_chunks(spark: SparkSession, d: str) -> DataFrame:
    return dg.fold_chunks(fx.chunks(spark, d)).select("interview_id", "turn_idx", "role", "text", "start", F.col("end").alias("stop"), "chunk_count")


@query(f"WITH c AS ({fx.CHUNKS}) SELECT interview_id, role, string_agg(text, ' ' ORDER BY stop, chunk_id) AS text FROM c GROUP BY 1, 2")
def role_texts(spark: SparkSession, d: str) -> DataFrame:
    return dg.role_texts(fx.chunks(spark, d))


_BRIDGES = f"""t3 AS (SELECT interview_id, turn_idx, role, text, lead(role) OVER w AS role_b, lead(text) OVER w AS text_b, lead(role, 2) OVER w AS role_c, lead(text, 2) OVER w AS text_c FROM turns WINDOW w AS (PARTITION BY interview_id ORDER BY turn_idx)),
bridges AS (SELECT interview_id, turn_idx, turn_idx + 2 AS to_turn_idx, role FROM t3 WHERE role = role_c AND role <> role_b AND NOT regexp_matches(rtrim(text), '[.!?…]["''»”’)]*$')
AND len({fx.SQL_WORDS.format('text_b')}) <= 60 AND (regexp_matches(regexp_extract(text_c, '\\p{{L}}'), '^\\p{{Ll}}') OR regexp_matches(rtrim(text), '[,–—-]$')
 OR list_extract({fx.SQL_WORDS.format("regexp_extract(text, '([^.!?…]*)$', 1)")}, -1) IN {listed(lx.UNAMBIGUOUS_INCOMPLETE_FINAL)}
 OR (array_to_string({fx.SQL_WORDS.format('text_b')}, ' ') IN {listed(lx.BACKCHANNELS)} AND list_extract({fx.SQL_WORDS.format('text')}, -1) IN {listed(lx.INCOMPLETE_FINAL)})))"""


def _bridged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = turns(spark, d)
    return t, dg.bridges(t, most=60)


#: Lines of documents as turns of two: every second is a few words, and what follows it goes on in lower case, or does not.
_SPOKEN = "turns AS (SELECT doc_id AS interview_id, line AS turn_idx, CASE WHEN line % 2 = 0 THEN 'Interviewee' ELSE 'Interviewer' END AS role, CASE WHEN line % 2 = 1 THEN array_to_string(string_split(text, ' ')[1:CAST(4 + line % 9 AS INTEGER)], ' ') WHEN line % 4 = 2 THEN lower(text) ELSE rtrim(text, '.') END AS text FROM lines)"


@query(f"WITH {fx.LINES}, {_SPOKEN}, {_BRIDGES.replace('<= 60', f'<= {lx.MAX_INTERRUPTION_TOKENS}')} SELECT * FROM bridges")
def short_interruptions(spark: SparkSession, d: str) -> DataFrame:
    """Turns that go on after an interruption of eight words or less."""
    few = F.array_join(F.slice(F.split("text", " "), F.lit(1), (F.col("line") % 9 + 4).cast("int")), " ")
    text = F.when(F.col("line") % 2 == 1, few).when(F.col("line") % 4 == 2, F.lower("text")).otherwise(F.regexp_replace("text", r"\.+$", ""))
    t = fx.lines(spark, d).select(F.col("doc_id").alias("interview_id"), F.col("line").alias("turn_idx"), F.when(F.col("line") % 2 == 0, "Interviewee").otherwise("Interviewer").alias("role"), text.alias("text"))
    t = t.withColumn("source_turn_ids", F.array(F.col("turn_idx").cast("string")))
    return dg.bridges(t, most=lx.MAX_INTERRUPTION_TOKENS).drop("interrupted_by")


@query(f"WITH {fx.MERGED}, {_BRIDGES} SELECT * FROM bridges")
def interruption_bridge(spark: SparkSession, d: str) -> DataFrame:
    return _bridged(spark, d)[1].drop("interrupted_by")


_BLOCKS = """blocks AS (SELECT t.interview_id, t.turn_idx, t.role, t.text, t.role_turn_idx, CAST(sum(CASE WHEN b.turn_idx IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY t.interview_id, t.role ORDER BY t.turn_idx ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS block_idx
FROM turns t LEFT JOIN bridges b ON b.interview_id = t.interview_id AND b.to_turn_idx = t.turn_idx),
offsets AS (SELECT *, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY interview_id, role, block_idx ORDER BY turn_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS span_start FROM blocks)"""


@query(f"WITH {fx.MERGED}, {_BRIDGES}, {_BLOCKS} SELECT interview_id, turn_idx, role, block_idx, span_start, CAST(span_start + length(text) AS BIGINT) AS span_end FROM offsets")
def role_blocks(spark: SparkSession, d: str) -> DataFrame:
    return dg.block_offsets(dg.role_blocks(*_bridged(spark, d))).select("interview_id", "turn_idx", "role", "block_idx", "span_start", "span_end")


@query(f"""WITH {fx.MERGED}, {_BRIDGES}, {_BLOCKS}, ends AS (SELECT interview_id, role, block_idx, CAST(sum(length(text) + 1) - 1 AS BIGINT) AS n FROM blocks GROUP BY 1, 2, 3),
sents AS (SELECT interview_id, role, block_idx, CAST(k * 100 AS BIGINT) AS sent_start, CAST(least(k * 100 + 100, n) AS BIGINT) AS sent_end FROM (SELECT *, unnest(range((n + 99) // 100)) AS k FROM ends))
SELECT s.interview_id, s.role, s.block_idx, s.sent_start, o.turn_idx FROM sents s JOIN offsets o ON o.interview_id = s.interview_id AND o.role = s.role AND o.block_idx = s.block_idx AND s.sent_start < o.span_start + length(o.text) AND s.sent_end > o.span_start""")
def source_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of a hundred characters of each block, and the turns they overlap."""
    off = dg.block_offsets(dg.role_blocks(*_bridged(spark, d)))
    n = off.groupBy("interview_id", "role", "block_idx").agg((F.sum(F.length("text") + 1) - 1).alias("n"))
    sents = n.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 100)))).select("interview_id", "role", "block_idx", (F.col("k") * 100).cast("long").alias("sent_start"), F.least(F.col("k") * 100 + 100, F.col("n")).cast("long").alias("sent_end"))
    return dg.source_pieces(sents, off).select("interview_id", "role", "block_idx", "sent_start", "turn_idx")


@query(f"WITH {fx.MERGED} SELECT interview_id, turn_idx, role, CAST(ntile(5) OVER (PARTITION BY interview_id, role ORDER BY role_turn_idx) AS INTEGER) AS position_stratum FROM turns")
def position_strata(spark: SparkSession, d: str) -> DataFrame:
    return dg.position_strata(turns(spark, d)).select("interview_id", "turn_idx", "role", "position_stratum")


@query(f"""WITH {fx.MERGED} SELECT interview_id, turn_idx, role, lag(role) OVER w AS previous_turn_role, lag(text) OVER w AS previous_turn_text, lead(role) OVER w AS following_turn_role, lead(text) OVER w AS following_turn_text
FROM turns WINDOW w AS (PARTITION BY interview_id ORDER BY turn_idx)""")
def turn_context(spark: SparkSession, d: str) -> DataFrame:
    return dg.turn_context(turns(spark, d))


@query(f"""WITH {fx.MERGED}, items AS (SELECT interview_id, role, min(turn_idx) AS lo, max(turn_idx) AS hi FROM turns GROUP BY 1, 2)
SELECT concat(CAST(i.interview_id AS STRING), i.role) AS item, t.turn_idx, t.role, t.text FROM items i JOIN turns t ON t.interview_id = i.interview_id AND t.turn_idx BETWEEN i.lo AND i.hi AND t.role <> i.role""")
def intervening_turns(spark: SparkSession, d: str) -> DataFrame:
    t = turns(spark, d)
    items = t.groupBy("interview_id", "role").agg(F.collect_list("turn_idx").alias("source_turns")).select(F.concat(F.col("interview_id").cast("string"), "role").alias("item"), "interview_id", "source_turns")
    return dg.intervening(items, t)


@query(f"WITH {fx.LINES} SELECT doc_id, line, array_to_string({fx.SQL_WORDS.format('text')}, ' ') AS form FROM lines")
def similarity_form(spark: SparkSession, d: str) -> DataFrame:
    return fx.lines(spark, d).select("doc_id", "line", tx.similarity_form(F.col("text")).alias("form"))


@query()
def similarity_form_nfkc(spark: SparkSession, d: str) -> DataFrame:
    return fx.lines(spark, d).select("doc_id", "line", arrow.nfkc_form("text").alias("form"))


_W = "w"
_BARE = "regexp_replace(text, '[^\\[\\](){}]', '', 'g')"
for _ in range(8):
    _BARE = f"regexp_replace({_BARE}, '\\(\\)|\\[\\]|\\{{\\}}', '', 'g')"
_OPEN = "".join("\\" + c if c in "[-" else c for c in lx.OPENING).replace("'", "''")
_GATE = f"""gate AS (SELECT doc_id, line, text, CASE WHEN {_BARE} <> '' THEN 'unbalanced_brackets' WHEN len(w) < 2 THEN 'too_few_words'
WHEN NOT regexp_matches(trim(text), '^[{_OPEN}]*\\p{{Lu}}') THEN 'lowercase_sentence_start' WHEN rtrim(text) LIKE '%...' OR rtrim(text) LIKE '%…' THEN 'truncated_ellipsis'
WHEN NOT regexp_matches(rtrim(text), '[.!?…]["''»”’)]*$') THEN 'missing_terminal_punctuation' WHEN len(w) > 120 THEN 'overlong_sentence'
WHEN list_extract(w, -1) IN {listed(lx.UNAMBIGUOUS_INCOMPLETE_FINAL)} AND NOT regexp_matches(array_to_string(w, ' '), '\\btr\\w{{1,12}}\\s+(?:(?:er|es)\\s+)?(?:gar\\s+|eher\\s+|überwiegend\\s+)?(?:nicht\\s+)?zu\\b') THEN 'incomplete_final_syntax'
WHEN list_extract(w, -1) IN ('also', 'denn') THEN 'incomplete_final_syntax' END AS reason FROM (SELECT *, {fx.SQL_WORDS.format('text')} AS w FROM lines))"""


@query(f"WITH {fx.LINES}, {_GATE} SELECT doc_id, line, reason FROM gate")
def sentence_gate(spark: SparkSession, d: str) -> DataFrame:
    return fx.lines(spark, d).select("doc_id", "line", tx.gate_reason(F.col("text")).alias("reason"))


@query(f"WITH {fx.LINES}, {_GATE} SELECT reason, count(*) AS n FROM gate WHERE reason IS NOT NULL GROUP BY 1")
def gate_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    return sentence_gate(spark, d).where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {fx.LINES}, c AS (SELECT *, {fx.SQL_WORDS.format('text')} AS w FROM lines)
SELECT doc_id, line, regexp_matches(rtrim(text), '[.!?…]["''»”’)]*$') AS ends, regexp_matches(trim(text), '^[{_OPEN}]*\\p{{Lu}}') AS capital, len(w) BETWEEN 1 AND 2 AND coalesce(w[1] IN {listed(lx.SHORT_RESPONSES)}, FALSE) AS short_response,
array_to_string(w, ' ') IN {listed(lx.BACKCHANNELS)} AS backchannel, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS squeezed,
trim(regexp_replace(regexp_replace(regexp_replace(text, '\\[[^\\]]*\\]', ' ', 'g'), '\\s+', ' ', 'g'), ' ([,.;:?!])', '\\1', 'g')) AS for_alignment FROM c""")
def text_predicates(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return fx.lines(spark, d).select("doc_id", "line", tx.ends_sentence(t).alias("ends"), tx.starts_with_capital(t).alias("capital"), F.coalesce(tx.is_short_response(t), F.lit(False)).alias("short_response"), tx.is_backchannel(t).alias("backchannel"), tx.squeeze(t).alias("squeezed"), tx.alignment_text(t).alias("for_alignment"))


@query(f"WITH {fx.SQL_WORDS_OF} SELECT DISTINCT word, trim(lower(word), '.,;:!?\"''') AS cue, CASE WHEN regexp_replace(word, '^[^\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+$', '', 'g') = '' THEN word ELSE regexp_replace(word, '^[^\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+$', '', 'g') END AS bare FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents)")
def word_forms(spark: SparkSession, d: str) -> DataFrame:
    w = fx.table(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("word")).distinct()
    return w.select("word", tx.cue_word(F.col("word")).alias("cue"), tx.parser_form(F.col("word")).alias("bare"))


@query()
def sentence_segments(spark: SparkSession, d: str) -> DataFrame:
    return sg.segment(dg.block_offsets(dg.role_blocks(*_bridged(spark, d)))).select("interview_id", "role", "block_idx", "sent_start", "sent_end", "sentence", "reason", "sentence_index_within_role", "n_tokens", "fragment", "cross_turn_sentence", "review_required")


@query()
def transcript_issues(spark: SparkSession, d: str) -> DataFrame:
    # explode() would have the issues computed again, in a filter pushed below them
    l = spread(fx.lines(spark, d).select("doc_id", "line", "text"))
    return l.select("doc_id", "line", F.explode_outer(issues.issues(F.col("text"))).alias("i")).where("i IS NOT NULL").select("doc_id", "line", "i.*")


@query()
def converted_lines(spark: SparkSession, d: str) -> DataFrame:
    return spread(fx.lines(spark, d).select("doc_id", "line", "text")).select("doc_id", "line", issues.converted(F.col("text")).alias("converted"))


@query()
def normalised_tokens(spark: SparkSession, d: str) -> DataFrame:
    l = spread(fx.lines(spark, d).select("doc_id", "line", "text")).withColumn("words", german.tokens(F.col("text")))
    variants = {"verbatim": german.tokens(F.col("text"), "verbatim"), "normalized": F.col("words"), "norep": german.without_repeats(F.col("words")), "board": german.board_words(F.col("text"))}
    return l.select("doc_id", "line", *(F.array_join(c, " ").alias(v) for v, c in variants.items()))


@query(f"WITH {fx.LINES}, c AS (SELECT doc_id, line, {fx.SQL_WORDS.format('text')} AS w FROM lines) SELECT doc_id, line, CAST(len(w) AS INTEGER) AS n, CAST(len(list_filter(w, lambda x, i: i = 1 OR x <> w[i - 1])) AS INTEGER) AS n_norep FROM c")
def repeats_collapsed(spark: SparkSession, d: str) -> DataFrame:
    w = tx.words(F.col("text"))
    return fx.lines(spark, d).select("doc_id", "line", F.size(w).alias("n"), F.size(german.without_repeats(w)).alias("n_norep"))


@query(f"""WITH {fx.SQL_WORDS_OF}, w AS (SELECT doc, list(word ORDER BY pos) AS ws FROM words GROUP BY 1), big AS (SELECT DISTINCT a.word AS a, b.word AS b FROM words a JOIN words b ON a.doc = b.doc AND b.pos = a.pos + 1),
long AS (SELECT DISTINCT word FROM words WHERE length(word) >= 8), cut AS (SELECT word, i, substr(word, 1, i) AS a, substr(word, i + 1) AS b FROM (SELECT word, unnest(range(2, length(word) - 1)) AS i FROM long))
SELECT word, arg_min(concat(cut.a, ' ', cut.b), i) AS parts FROM cut JOIN big ON cut.a = big.a AND cut.b = big.b GROUP BY 1""")
def learn_compounds(spark: SparkSession, d: str) -> DataFrame:
    w = fx.table(spark, d, "conversations").select(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("words"))
    return german.learn_compounds(w)


def _hundred(n: str) -> str:
    return f"CASE WHEN {n} < 20 THEN ones[{n} + 1] ELSE concat(CASE WHEN {n} % 10 > 0 THEN concat(ones[{n} % 10 + 1], 'und') ELSE '' END, tens[{n} // 10 - 1]) END"


def _thousand(n: str, one: str) -> str:
    return f"concat(CASE WHEN {n} >= 100 THEN concat(ones[{n} // 100 + 1], 'hundert') ELSE '' END, CASE WHEN {n} % 100 = 0 THEN '' WHEN {n} % 100 = 1 THEN '{one}' ELSE {_hundred(f'({n} % 100)')} END)"


@query(f"""WITH d AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[0-9]+')) AS digits FROM documents), n AS (SELECT digits, TRY_CAST(digits AS BIGINT) AS n FROM d), l AS (SELECT n.*, {german._ONES} AS ones, {german._TENS} AS tens, (n // 1000) % 1000 AS h, n % 1000 AS r FROM n)
SELECT digits, CASE WHEN n IS NULL OR n >= 1000000 THEN digits WHEN n = 0 THEN 'null' ELSE regexp_replace(concat(CASE WHEN h > 0 THEN concat({_thousand('h', 'ein')}, 'tausend') ELSE '' END, {_thousand('r', 'eins')}), '^ein(hundert|tausend)', '\\1') END AS words FROM l""")
def number_words(spark: SparkSession, d: str) -> DataFrame:
    digits = fx.table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[0-9]+"), F.lit(0))).alias("digits")).distinct()
    return digits.select("digits", german.cardinal_column(F.col("digits")).alias("words"))

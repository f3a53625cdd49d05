"""Domain tables derived from the test tables by rules that both engines follow: no sampling, whole tables and texts.

Fragments in plain SQL serve Spark (selectExpr) and DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.shared import spread

ROLE = "CASE role WHEN 'user' THEN 'Interviewer' WHEN 'assistant' THEN 'Interviewee' ELSE role END"
#: Every fourth length is blanked, so that turns really merge; every third loses its full stop, so that turns stay open.
TEXT = "CASE WHEN length(text) % 4 = 0 THEN '' WHEN length(text) % 3 = 0 THEN rtrim(text, '.') ELSE text END"
RAW = f"SELECT conv_id AS interview_id, turn AS pos, {ROLE} AS role, {TEXT} AS text FROM conversations"

#: Chunks: a turn is one; roles are dealt by position, so that neighbours share one.
CHUNKS = "SELECT conv_id AS interview_id, CAST(turn AS DOUBLE) AS start, CAST(turn + 1 AS DOUBLE) AS stop, turn AS chunk_id, CASE WHEN (turn + conv_id) % 3 = 0 THEN 'Interviewer' ELSE 'Interviewee' END AS role, text FROM conversations"

MERGED = f"""raw AS ({RAW}), ok AS (SELECT interview_id, pos, role, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM raw WHERE role IN ('Interviewer', 'Interviewee')),
marked AS (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY interview_id ORDER BY pos) THEN 0 ELSE 1 END AS n FROM ok WHERE text <> ''),
isles AS (SELECT *, CAST(sum(n) OVER (PARTITION BY interview_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS turn_idx FROM marked),
merged AS (SELECT interview_id, turn_idx, any_value(role) AS role, string_agg(text, ' ' ORDER BY pos) AS text, count(*) AS n_parts, min(pos) AS first_pos FROM isles GROUP BY 1, 2),
turns AS (SELECT *, CAST(row_number() OVER (PARTITION BY interview_id, role ORDER BY turn_idx) - 1 AS BIGINT) AS role_turn_idx FROM merged)"""

LINES = "lines AS (SELECT doc_id, source, lang, CAST(i - 1 AS BIGINT) AS line, l AS text FROM (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS l, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents))"
SQL_WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"

ANNOTATORS = "ABC"
#: Each turn is annotated by three: cues next to each other for A and B, C now and then elsewhere; C skips some turns.
CUE_A = "(conv_id * 5 + turn * 3) % 4"
#: JSON of one annotation; p: first cue token, n: words of the turn (short turns have no groups).
GROUPS = """CASE WHEN n < 9 THEN '[]' WHEN annotator = 'A' THEN concat('[{"cue":[{"i":', CAST(p AS STRING), '},{"i":', CAST(p + 1 AS STRING), '}],"scope":[{"i":', CAST(p + 2 AS STRING), '},{"i":', CAST(p + 3 AS STRING), '}]}]')
 WHEN annotator = 'B' THEN concat('[{"cue":[{"i":', CAST(p + 1 AS STRING), '}],"scope":[{"i":', CAST(p + 2 AS STRING), '}]}', CASE WHEN turn % 2 = 0 THEN concat(',{"cue":[{"i":', CAST(p AS STRING), '}],"scope":[{"i":', CAST(p + 3 AS STRING), '}]}') ELSE '' END, ']')
 ELSE concat('[{"cue":[{"i":', CAST(p + CASE WHEN conv_id % 3 = 0 THEN 0 ELSE 3 END AS STRING), '}],"scope":[{"i":', CAST(p + 2 AS STRING), '}]}]') END"""

#: Rules for derived systems over the words of turns (doc = conv * 100 + turn, pos).
SYSTEMS = ("s0", "s1", "s2", "s3", "s4", "s5")
SYSTEM_OP = "CASE WHEN (doc + line) % (7 + k) = 0 OR (pos * 31 + doc * 7 + k * 13) % (11 + k) = 0 THEN 'delete' WHEN (pos * 17 + doc * 5) % 19 < k THEN 'substitute' ELSE 'equal' END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_turns(spark: SparkSession, d: str) -> DataFrame:
    text = TEXT.replace("rtrim(text, '.')", "trim(TRAILING '.' FROM text)")
    return table(spark, d, "conversations").selectExpr("conv_id AS interview_id", "turn AS pos", f"{ROLE} AS role", f"{text} AS text")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.selectExpr("conv_id AS interview_id", "CAST(turn AS DOUBLE) AS start", "CAST(turn + 1 AS DOUBLE) AS end", "turn AS chunk_id", "CASE WHEN (turn + conv_id) % 3 = 0 THEN 'Interviewer' ELSE 'Interviewee' END AS role", "text")


def lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line").cast("long"))


def annotations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(annotations, sample) as an annotation store and a sample file would give them."""
    c = table(spark, d, "conversations")
    who = c.crossJoin(F.broadcast(spark.createDataFrame([(a,) for a in ANNOTATORS], "annotator string"))).where("NOT (annotator = 'C' AND turn % 3 = 1)").withColumn("p", F.expr(CUE_A)).withColumn("n", F.size(F.split("text", " ")))
    ann = who.selectExpr("concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS sentence_id", "annotator", f"{GROUPS} AS groups_json", "0 AS no_negation", "CASE WHEN (conv_id + turn) % 13 = 0 THEN 1 ELSE 0 END AS garbled")
    sample = c.selectExpr("concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS item_uuid", "text", "CASE conv_id % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split")
    return ann, sample


SQL_ANN = f"""who AS (SELECT conv_id, turn, text, annotator, {CUE_A} AS p, len(string_split(text, ' ')) AS n FROM conversations, (VALUES ('A'), ('B'), ('C')) AS a(annotator) WHERE NOT (annotator = 'C' AND turn % 3 = 1)),
ann AS (SELECT concat(CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS sentence_id, annotator, {GROUPS} AS groups_json, len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS n_tokens, (conv_id + turn) % 13 = 0 AS garbled FROM who),
props AS (SELECT sentence_id, annotator, n_tokens, CAST(g - 1 AS INTEGER) AS group_index, list_transform(from_json(x.cue, '["json"]'), lambda e: CAST(e->>'i' AS INTEGER)) AS cue, list_transform(from_json(x.scope, '["json"]'), lambda e: CAST(e->>'i' AS INTEGER)) AS scope
 FROM (SELECT sentence_id, annotator, n_tokens, unnest(from_json(groups_json, '[{{"cue":"json","scope":"json"}}]')) AS x, unnest(generate_series(1, CAST(json_array_length(groups_json) AS BIGINT))) AS g FROM ann WHERE NOT garbled))"""


def proposals(spark: SparkSession, d: str) -> DataFrame:
    from parley.operators import annotations as an

    return an.proposals(an.joined(*annotations(spark, d)))


def with_pid(props: DataFrame) -> DataFrame:
    """A number for each proposal that both engines agree on."""
    pid = F.expr("CAST(split(sentence_id, '-')[0] AS BIGINT) * 10000 + CAST(split(sentence_id, '-')[1] AS BIGINT) * 100 + (ascii(annotator) - 65) * 10 + group_index")
    return props.withColumn("pid", pid)


SQL_PID = "CAST(string_split(sentence_id, '-')[1] AS BIGINT) * 10000 + CAST(string_split(sentence_id, '-')[2] AS BIGINT) * 100 + (ascii(annotator) - 65) * 10 + group_index"


def words(spark: SparkSession, d: str) -> DataFrame:
    """doc, line, pos, word: words of all turns; a line is a sentence's worth (ten words)."""
    c = table(spark, d, "conversations")
    w = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("doc"), F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("pos", "word"))
    return w.select("doc", F.floor(F.col("pos") / 10).cast("long").alias("line"), F.col("pos").cast("long").alias("pos"), "word")


SQL_WORDS_OF = "words AS (SELECT doc, CAST((pos - 1) // 10 AS BIGINT) AS line, CAST(pos - 1 AS BIGINT) AS pos, word FROM (SELECT conv_id * 100 + turn AS doc, unnest(w) AS word, unnest(generate_series(1, len(w))) AS pos FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM conversations)))"
SQL_SYSTEMS = f"toks AS (SELECT concat('s', CAST(k AS STRING)) AS system, doc, line, pos, word, op, CASE op WHEN 'equal' THEN '=' WHEN 'substitute' THEN concat(word, CASE WHEN (pos + k) % 3 = 0 THEN 'x' ELSE 'y' END) END AS alt FROM (SELECT *, {SYSTEM_OP} AS op FROM words, (SELECT unnest(range(6)) AS k)))"


def system_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Aligned reference tokens of six systems whose errors follow a rule."""
    k = spark.range(6).select(F.col("id").alias("k"))
    t = words(spark, d).crossJoin(F.broadcast(k)).withColumn("op", F.expr(SYSTEM_OP))
    return t.selectExpr("concat('s', CAST(k AS STRING)) AS system", "doc", "line", "pos", "word", "op", "CASE op WHEN 'equal' THEN '=' WHEN 'substitute' THEN concat(word, CASE WHEN (pos + k) % 3 = 0 THEN 'x' ELSE 'y' END) END AS alt")


def transcripts(spark: SparkSession, d: str) -> DataFrame:
    """doc, role, hours, ref_text, hyp_text: each line of a turn against its text with every seventh word gone, every fifth
    doubled and every eleventh another; now and then a passage is said again, or one that nobody said follows."""
    c = table(spark, d, "conversations").selectExpr("conv_id", "turn", f"{ROLE} AS role", "text")
    one = spread(c.select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n")).alias("line", "ref_text")))
    w = F.filter(F.split("ref_text", " "), lambda x: x != "")

    def heard(x, i):
        return F.when((i + F.col("turn")) % 7 == 6, F.lit("")).when((i + F.col("conv_id")) % 5 == 4, F.concat(x, F.lit(" "), x)).when(i % 11 == 10, F.concat(x, F.lit("zz"))).otherwise(x)

    n = F.col("conv_id") + F.col("turn") + F.col("line")
    more = F.when(n % 6 == 0, F.slice(w, F.greatest(F.size(w) - 7, F.lit(1)), F.lit(8))).when(n % 6 == 1, F.split(F.lit("ganz andere worte die hier niemand je gesagt hat"), " ")).otherwise(F.array().cast("array<string>"))
    hyp = F.array_join(F.concat(F.filter(F.transform(w, heard), lambda x: x != ""), more), " ")
    return one.select(F.lit("s").alias("system"), F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.col("line").cast("string")).alias("doc"), F.col("conv_id").alias("eid"), "role", (F.length("ref_text") / 36000).alias("hours"), "ref_text", hyp.alias("hyp_text"))

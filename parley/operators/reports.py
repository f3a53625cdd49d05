"""Reports on a corpus and the sample drawn from it, and tables that join what systems were scored for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import lexicon as lx
from parley.operators.metrics import share


def speaker_of(role: Column, interviewer: Column, interview: Column) -> Column:
    """Interviewers recur under their own id; an interviewee is known by the interview."""
    return F.when(role == lx.ROLES[0], interviewer.cast("string")).otherwise(interview.cast("string"))


def role_turns(turns: DataFrame, sentences: DataFrame) -> DataFrame:
    """interview_id, role, n_turns: as counted; where no turn is known, one more than the last turn that a sentence names."""
    known = turns.groupBy("interview_id", "role").agg(F.count(F.lit(1)).alias("counted"))
    named = sentences.groupBy("interview_id", "role").agg((F.max("turn") + 1).alias("named"))
    return known.join(named, ["interview_id", "role"], "full").select("interview_id", "role", F.coalesce("counted", "named").cast("long").alias("n_turns"))


def speakers(pool: DataFrame, sample: DataFrame) -> DataFrame:
    """role, speaker, interviews, available, sampled, sampled_share. Both: interview_id, interviewer_id, role."""
    both = pool.select("role", "interviewer_id", "interview_id", F.lit(1).alias("a"), F.lit(0).alias("s")).unionByName(sample.select("role", "interviewer_id", "interview_id", F.lit(0).alias("a"), F.lit(1).alias("s")))
    who = speaker_of(F.col("role"), F.col("interviewer_id"), F.col("interview_id"))
    out = both.groupBy("role", who.alias("speaker")).agg(F.count_distinct("interview_id").alias("interviews"), F.sum("a").alias("available"), F.sum("s").alias("sampled"))
    return out.withColumn("sampled_share", share(F.col("sampled").cast("double"), F.col("available")))


def interviewers(pool: DataFrame, sample: DataFrame) -> DataFrame:
    """interviewer_id, interviews, and sampled rows of both roles in their interviews, with the first role's share."""
    a, b = (F.count_if(F.col("role") == r) for r in lx.ROLES)
    own = pool.groupBy("interviewer_id").agg(F.count_distinct("interview_id").alias("interviews"), F.count(F.lit(1)).alias("available"))
    drawn = sample.groupBy("interviewer_id").agg(a.alias("sampled_interviewer"), b.alias("sampled_interviewee"))
    out = own.join(drawn, "interviewer_id", "left").na.fill(0, ["sampled_interviewer", "sampled_interviewee"])
    return out.withColumn("interviewer_share", share(F.col("sampled_interviewer").cast("double"), F.col("sampled_interviewer") + F.col("sampled_interviewee")))


def corpus_summary(pool: DataFrame, sample: DataFrame) -> DataFrame:
    """One row of totals. Both: interview_id, role, cluster, turn; sample: split, double_annotate, cross_turn_sentence."""
    a, b = lx.ROLES
    p = pool.agg(F.count(F.lit(1)).alias("available_sentences"), F.count_distinct("interview_id").alias("interviews"), F.count_distinct("cluster").alias("clusters"), F.count_if(F.col("role") == a).alias("available_interviewer"), F.count_if(F.col("role") == b).alias("available_interviewee"), F.count_distinct("interview_id", "role", "turn").alias("available_turns"))
    s = sample.agg(
        F.count(F.lit(1)).alias("sampled_sentences"), F.count_if(F.col("role") == a).alias("sampled_interviewer"), F.count_if(F.col("role") == b).alias("sampled_interviewee"), F.count_distinct("interview_id", "role", "turn").alias("sampled_turns"),
        *(F.count_if(F.col("split") == x).alias(f"sampled_{x}") for x in lx.SPLITS), F.count_if("double_annotate").alias("double_annotated"), F.count_if("cross_turn_sentence").alias("cross_turn_sentences"),
    )
    return p.crossJoin(F.broadcast(s)).withColumn("redundant_sentences", F.col("available_sentences") - F.col("clusters")).withColumn("sampled_share", share(F.col("sampled_sentences").cast("double"), F.col("available_sentences")))


def with_semantics(summary: DataFrame, semantic: DataFrame) -> DataFrame:
    """Each system's error rates with its semantic distances, where there are any; the best system first."""
    return summary.join(semantic, "system", "left").orderBy("wer", "system")


def in_reading_order(issues: DataFrame) -> DataFrame:
    """Issues as a reviewer works through them."""
    return issues.orderBy("doc", "line", "category", "start")


def worst_first(lines: DataFrame) -> DataFrame:
    """Flagged lines, those least sure first."""
    return lines.orderBy(F.asc_nulls_first("score"), "doc", "line")

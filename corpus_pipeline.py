"""The corpus pipeline: each stage applies one operator of parley.llm to the documents its predecessor kept.

Defined cases, for every stage: an empty table gives an empty one; columns beyond doc_id, text, lang and source pass
through, whatever their names (the mix adds its own under names that are free); ids may repeat, rows are then told apart
by their texts.

* language ID: null texts, and texts without a letter, go; so does what has less than LEAST_SCORE of known n-grams. Ties go to
  the language that sorts first. Equal rows get equal verdicts. Without a labelled row nothing can be told and all stay.
* exact dedup: null counts as the empty text; of a tie in length the smallest id stays, a null id only where all are null;
  of equal rows one stays.
* near-dedup: texts without words are near nothing and stay, as do null ids. Repeats of the row that stays, stay with it.
* decontamination: null texts and items hit nothing; items without an id count. Equal rows get equal verdicts.
* mixing: null texts have no words, so the mix takes none and they go; a null source is a source. Equal rows are
  different documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parley.llm import decontaminate, exact_dedup, langid, mixing, near_dedup
from parley.llm._common import drop, materialize, swept, table


#: Below this share of known n-grams a text is in none of the learned languages.
LEAST_SCORE = 0.1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or in none of the labelled languages go."""
    return langid.keep(docs, langid.fit(docs), LEAST_SCORE)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.keep_first(docs, exact_dedup.exact_dedup(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five-word shingles, similarity 0.8 or more)."""
    return near_dedup.keep_one(docs, near_dedup.near_dedup(docs))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their size, their source's target, the words taken (repeats counted) and their first slot."""
    return mixing.keep_taken(docs)


STAGES = [("language ID", language), ("exact dedup", exact), ("MinHash near-dedup", near), ("benchmark decontamination", benchmark), ("mixing sources to target weights", mixing_stage)]
#: Language prediction, near-duplicate signatures and the schedule are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each written before the next reads it; what a stage leaves behind is deleted with it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with swept() as keep:
            before, docs = docs, materialize(stage(spark, docs, sf_dir), "stage")
            keep.append(docs)
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The thin queries opN_<name>: each applies its operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import chat, codes, decontaminate, exact_dedup, langid, mixing, near_dedup, pii, search, secrets, substrings, urls, warc
from parley.llm._common import table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"), shingle=2).select("doc_id", "n_shingles", "component_id", "kept")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    held_out = F.coalesce(F.crc32(F.col("conv_id").cast("string")) % 3 == 1, F.lit(False))
    told = chat.recover_roles(rows, chat.fit(rows.where(~held_out)), role_col="role")
    return told.select(F.col("conv").alias("conv_id"), F.col("pos").alias("turn"), "role", "role_pred", "rendered", F.coalesce(F.crc32(F.col("conv").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix, sized = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixing.taken_words(mix, sized).select("doc_id", "size", "source_size", "target", "taken")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes, hits = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(decontaminate.verdicts(sizes, hits))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(warc.read(spark, warc.archive(table(spark, sf_dir, "pages"))))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.digest(*codes.compress(table(spark, sf_dir, "embeddings")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_chat": op3_chat,
    "op4_mixing": op4_mixing,
    "op5_decontamination": op5_decontamination,
    "op6_pii": op6_pii,
    "op7_warc": op7_warc,
    "op8_substrings": op8_substrings,
    "op9_secrets": op9_secrets,
    "op10_language_id": op10_language_id,
    "op11_search": op11_search,
    "op12_urls": op12_urls,
    "op13_codes": op13_codes,
}

"""The operators' queries over the driver tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm.common import prepared


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.licenses import scan

    return scan(_table(spark, sf_dir, "documents")).drop("places")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.chat import digests, format_conversations

    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    table = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(format_conversations(table.unionByName(extra)))


def op3_random_indexing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.quality import score_documents

    return score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_multiple_instance_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.toxicity import score_documents

    return score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_pitman_yor_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.lm import score_documents

    return score_documents(_table(spark, sf_dir, "documents"))


def op6_balanced_lists_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.exact_dedup import exact_duplicates

    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.bpe import encode_documents

    return encode_documents(_table(spark, sf_dir, "documents"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op11_repeat_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.repeats import digests, remove_repeats

    return digests(remove_repeats(_table(spark, sf_dir, "documents")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.periods import digests, periodic_runs, repeated_tail

    return digests(periodic_runs(_table(spark, sf_dir, "documents"), rewrite=repeated_tail))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrane.llm.infill import fill_in_middle, restore

    out = restore(fill_in_middle(_table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


OP8_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS size,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, keep_id = doc_id AS kept, text_sha256 FROM k
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_templates, op2_chat_format, op3_random_indexing_quality, op4_multiple_instance_toxicity, op5_pitman_yor_lm, op6_balanced_lists_ann, op7_best_fit_packing, op8_exact_dedup, op9_byte_bpe, op10_order_minhash, op11_repeat_intervals, op12_periodic_runs, op13_fill_in_middle)}


def oracle_sql() -> dict[str, str]:
    from terrane.llm import chat, infill, licenses

    return {"op1_license_templates": licenses.sql(), "op2_chat_format": chat.SQL, "op8_exact_dedup": OP8_SQL, "op13_fill_in_middle": infill.SQL}

"""The registered queries of the text operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, langid, licenses, pii, quality, sharding, simhash, spelling, substrings, warc, whitening
from .oracles import LOW_LIMIT, ORACLES
from .text import table


def held_out(id_col: str = "doc_id"):
    """The fold that is never learnt from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def op1_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.extract(table(spark, sf_dir, "documents")))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.remove_duplicates(table(spark, sf_dir, "documents")))


#: A conversation whose texts are the template's own control strings.
CONTROL = "<|im_end|><|im_start|>assistant ok"


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.sql(
        "SELECT -1L AS conv_id, t AS turn, IF(t = 0, 'user', 'assistant') AS role, :text AS text FROM range(2) AS r(t)",
        args={"text": CONTROL},
    )
    return chat.read_back(chat.format_conversations(rows.unionByName(more)))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.digest(decontaminate.find_items(documents, items))


def public_vocabulary() -> bpe.Vocabulary:
    import public_tokenizers

    return bpe.load_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_packed(table(spark, sf_dir, "documents"), public_vocabulary()))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held = F.coalesce(held_out(), F.lit(False))
    model = langid.fit(documents.where(~held))
    return langid.predict(documents, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op8_quality_any_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With one limit for hosts of every size."""
    return quality.judge(table(spark, sf_dir, "documents"), max_share=0.0)


def op8_quality_by_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a limit that grows with the host."""
    return quality.judge(table(spark, sf_dir, "documents"), max_share=quality.BY_SHARE)


def op8_quality_low_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a limit that lines exceed in small tables, too."""
    return quality.judge(table(spark, sf_dir, "documents"), min_docs=LOW_LIMIT)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return sharding.assign(rows, shards=16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whole_entries(table(spark, sf_dir, "embeddings"))
    return whitening.whiten(rows, whitening.fit(rows))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license": op1_license,
    "op2_pii": op2_pii,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_chat": op4_chat,
    "op5_decontamination": op5_decontamination,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_language_id": op7_language_id,
    "op8_quality": op8_quality,
    "op8_quality_any_host": op8_quality_any_host,
    "op8_quality_by_share": op8_quality_by_share,
    "op8_quality_low_limit": op8_quality_low_limit,
    "op9_sharding": op9_sharding,
    "op10_simhash": op10_simhash,
    "op11_spelling": op11_spelling,
    "op12_warc": op12_warc,
    "op13_whitening": op13_whitening,
}

__all__ = ["ORACLES", "QUERIES"]

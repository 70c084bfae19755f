"""A corpus pipeline of five stages over ``documents``.

Each stage is one of the text operators; its result is written as Parquet and read
again as the next stage's input.  All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import bpe, decontaminate, langid, pii, simhash
from kinweave.llm.queries import held_out, public_vocabulary
from kinweave.llm.text import table
from kinweave.operators.loop import ensure_checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go; the model never sees the held-out fold.

    Null, empty and letterless texts go; repeated rows stay or go together; an empty table stays empty; ties between
    languages do not matter, as only the score does; columns beyond those of ``documents`` are dropped.
    """
    model = langid.fit(docs.where(~F.coalesce(held_out(), F.lit(False))))
    return langid.keep_identified(docs.select(*COLUMNS), model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.

    Null and empty texts have fingerprint zero and form a group with what is close to it; of rows with equal id and
    text one stays, and of different texts with a group's smallest id one; a null id stays only where a group has no
    other; an empty table stays empty; further columns are dropped.
    """
    return simhash.keep_one(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go, or all words of a shorter item.

    Null and empty texts stay; repeated rows stay or go together; without documents or items nothing goes; very
    long texts are searched whole; further columns are dropped.
    """
    return decontaminate.drop_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; ``n_chars`` follows the text.

    Null texts stay null and have null characters; equal rows get equal texts; an empty table stays empty;
    further columns are dropped.
    """
    cleaned = pii.redact(docs.select(*COLUMNS))
    return cleaned.withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it.

    Null and empty texts have no tokens; repeated rows give equal rows; an empty table gives no rows; further columns
    are dropped.
    """
    encoded = bpe.encode_packed(docs.select(*COLUMNS), public_vocabulary(), keep=["doc_id", "lang", "source", "text"])
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return encoded.select("doc_id", "lang", "source", (F.length("packed") / 4).cast("long").alias("n_tokens"), "packed", same.alias("decodes"))


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("byte-level BPE", tokens),
]

#: No stage can be written as SQL whole; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what a stage wrote is removed once the next one has been written."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            _remove(spark, f"{folder}/{k - 1}")
    return docs


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

"""A network taken in once and read by many reports (A1).

:func:`ingest` reads the CSV files as text, turns what it can into numbers and dates, and writes typed Parquet tables.  Rows with a field that
is none are set aside with the name of that field, and counted.  Friendships are made symmetric and distinct once.  Replies are stored with their
author and in buckets by the comment they answer, as comments are by their id: both sides of the largest join then lie side by side and
need no shuffle.  The manifest is written last, so a store without one was not finished.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .io import raw_table, symmetric
from .schema import FILES, Network

#: Relations in buckets: the column that deals them out.
BUCKETED = {"comment_creator": "comment_id", "reply_of": "parent_id"}

#: What a reply has beside its columns: who wrote it.
AUTHOR = "src"


class StoreError(ValueError):
    """A folder holds no finished store, or one of other tables."""


def ingest(spark: SparkSession, directory: str, store: str, buckets: int = 200) -> DataFrame:
    """Take the CSV network of a folder into a new store; its manifest, see :func:`manifest`.

    ``buckets`` should be as many tasks as a join of all comments is to have.
    """
    good, bad = {}, {}
    for name in FILES:
        good[name], bad[name] = typed(raw_table(spark, directory, name), name)
    for name, rows in bad.items():
        rows.write.parquet(f"{store}/quarantine/{name}")
    return write(Network(**good), store, buckets)


def typed(raw: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows of text as ``(good, bad)``: typed, and those with a missing or unreadable field, which ``fault`` names."""
    columns = FILES[name][1]
    values = {c: F.col(c).try_cast(kind) for c, kind, _ in columns}
    faults = F.concat_ws(",", *[F.when(v.isNull(), F.lit(c)) for c, v in values.items()])
    judged = raw.withColumn("fault", faults)
    good = judged.where("fault = ''").select(*[v.alias(c) for c, v in values.items()])
    return good, judged.where("fault != ''")


def write(net: Network, store: str, buckets: int = 200) -> DataFrame:
    """Write the relations of a network into a new store; its manifest."""
    spark = net.person.sparkSession
    for name, table in net.tables().items():
        if name == "knows":
            table = symmetric(table).repartitionByRange("src").sortWithinPartitions("src", "dst")
        if name == "reply_of":
            author = net.comment_creator.select("comment_id", F.col("person_id").alias(AUTHOR))
            table = table.select("comment_id", "parent_id").join(author, "comment_id", "left")
        if name not in BUCKETED:
            table.write.parquet(f"{store}/{name}")
            continue
        by = BUCKETED[name]
        dealt = table.repartition(buckets, by)  # a task for each bucket, which writes one file
        dealt.write.bucketBy(buckets, by).sortBy(by).format("parquet").option("path", f"{store}/{name}").saveAsTable(_table_name(store, name))
    parts = []
    for name in FILES:
        rows = spark.read.parquet(f"{store}/{name}").agg(F.count(F.lit(1)).alias("rows"))
        parts.append(rows.select(F.lit(name).alias("name"), "rows", F.lit(_bad_rows(spark, store, name)).cast("long").alias("bad_rows")))
    counted = parts[0]
    for part in parts[1:]:
        counted = counted.union(part)
    counted.withColumn("buckets", F.lit(buckets)).coalesce(1).write.parquet(f"{store}/manifest")  # a row for each relation
    return manifest(spark, store)


def _bad_rows(spark: SparkSession, store: str, name: str) -> int:
    path = f"{store}/quarantine/{name}"
    return spark.read.parquet(path).count() if _exists(spark, path) else 0


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def manifest(spark: SparkSession, store: str) -> DataFrame:
    """``(name, rows, bad_rows, buckets)`` of each relation of a finished store."""
    if not _exists(spark, f"{store}/manifest/_SUCCESS"):
        raise StoreError(f"{store} holds no finished store")
    return spark.read.parquet(f"{store}/manifest")


def quarantine(spark: SparkSession, store: str, name: str) -> DataFrame:
    """The rows of a relation that were set aside, as text, and their ``fault``."""
    return spark.read.parquet(f"{store}/quarantine/{name}")


def read_store(spark: SparkSession, store: str) -> Network:
    """The network of a finished store.  Its ``reply_of`` has the author of each reply as ``src``."""
    kept = {r.name: r.buckets for r in manifest(spark, store).collect()}  # a row for each relation
    if set(kept) != set(FILES):
        raise StoreError(f"{store} holds other tables")
    tables = {name: spark.read.parquet(f"{store}/{name}") for name in FILES if name not in BUCKETED}
    for name, by in BUCKETED.items():
        own = _table_name(store, name)
        if not spark.catalog.tableExists(own):
            fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.read.parquet(f"{store}/{name}").schema)
            spark.sql(f"CREATE TABLE {own} ({fields}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {kept[name]} BUCKETS LOCATION '{store}/{name}'")
        tables[name] = spark.table(own)
    return Network(**tables)


def _table_name(store: str, name: str) -> str:
    """Buckets need a table of the catalog; its name follows from the place of the files."""
    return f"{name}_{hashlib.md5(store.rstrip('/').encode()).hexdigest()}"

"""Reading networks and query batches, writing answers (A1-A4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, LongType, StringType, StructField, StructType

from .schema import FILES, Network

_TYPES = {"long": LongType(), "string": StringType(), "date": DateType()}


def raw_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The columns of one relation of a CSV network as text: ``|`` between fields, one header line, columns by position.

    Files may have more columns than are read; the reader drops what the schema does not name.
    """
    file, columns = FILES[name]
    at = {position: column for column, _, position in columns}
    layout = [StructField(at.get(i, f"_ignored{i}"), StringType()) for i in range(max(at) + 1)]
    raw = spark.read.csv(
        f"{directory}/{file}", schema=StructType(layout), sep="|", header=True, enforceSchema=True, quote="", mode="PERMISSIVE"
    )
    return raw.select(*[column for column, _, _ in columns])


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """As :func:`raw_table`, typed.

    A field that is no number or date where one belongs is an error under Spark's ANSI mode, the default;
    a store (``store.ingest``) sets such rows aside instead.
    """
    return raw_table(spark, directory, name).select(*[F.col(column).cast(_TYPES[kind]).alias(column) for column, kind, _ in FILES[name][1]])


def read_network(spark: SparkSession, directory: str, fmt: str = "csv", symmetrize: bool = True) -> Network:
    """All 14 relations from CSV files or from Parquet tables named after the relations.

    With ``symmetrize`` both directions of each friendship are present, once.  Without it they
    must be there, as the operators on paths rely on it; a friendship of one direction is an error.
    """
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"unknown format {fmt!r}")
    read = {
        name: read_table(spark, directory, name)
        if fmt == "csv"
        else spark.read.parquet(f"{directory}/{name}.parquet").select(*[c for c, _, _ in columns])
        for name, (_, columns) in FILES.items()
    }
    if symmetrize:
        read["knows"] = symmetric(read["knows"])
    else:
        back = read["knows"].select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        if not read["knows"].join(back, ["src", "dst"], "left_anti").isEmpty():
            raise ValueError("some friendships have one direction only")
    return Network(**read)


def symmetric(knows: DataFrame) -> DataFrame:
    """Both directions of each edge, once, without self loops (K1)."""
    back = knows.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return knows.select("src", "dst").union(back).where("src != dst").distinct()


def read_queries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """``(q1, q2, q3, q4, all)`` of a batch file with one call on each line.

    The line number from 0 is ``qid``.  ``all`` is ``(qid, kind)`` with a null kind for
    lines that are no known call; blank lines at the end do not count.  A batch is a
    parameter file, so it is read whole to number its lines.
    """
    text = F.regexp_replace("value", r"\s+$", "")
    lines = (
        spark.read.text(path, wholetext=True)
        .where(F.length(text) > 0)
        .select(F.posexplode(F.split(text, "\r?\n")).alias("qid", "line"))
        .select(F.col("qid").cast("long"), F.trim("line").alias("line"))
    )
    call = r"^query([1-4])\((.*)\)$"
    kind = F.regexp_extract("line", call, 1).try_cast("int")
    parsed = lines.select("qid", kind.alias("kind"), F.regexp_extract("line", call, 2).alias("args"))

    def calls(number: int, pattern: str, *columns: tuple[str, str]) -> DataFrame:
        part = lambda i: F.regexp_extract("args", pattern, i)
        own = parsed.where((F.col("kind") == number) & F.col("args").rlike(pattern))
        return own.select("qid", *[part(i + 1).cast(kind).alias(name) for i, (name, kind) in enumerate(columns)])

    number = r"\s*(-?\d+)\s*"
    q1 = calls(1, f"^{number},{number},{number}$", ("p1", "long"), ("p2", "long"), ("x", "int"))
    q2 = calls(2, f"^{number},\\s*(\\d{{4}}-\\d{{2}}-\\d{{2}})\\s*$", ("k", "int"), ("d", "date"))
    q3 = calls(3, f"^{number},{number},\\s*(.*?)\\s*$", ("k", "int"), ("h", "int"), ("place", "string"))
    q4 = calls(4, f"^{number},\\s*(.*?)\\s*$", ("k", "int"), ("tag", "string"))
    return q1, q2, q3, q4, parsed.select("qid", "kind")


def format_answers(queries: DataFrame, *answered: tuple[DataFrame, object]) -> DataFrame:
    """``(qid, answer)`` for each row of ``queries``: its items in rank order, blanks between.

    Each further argument is a result ``(qid, rank, ...)`` and the column expression of
    an item.  A query without items has an empty answer.
    """
    items = reduce(
        DataFrame.union, [df.select("qid", F.col("rank").cast("int").alias("rank"), item.cast("string").alias("item")) for df, item in answered]
    )
    joined = items.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "item"))).alias("items"))
    answer = F.coalesce(F.array_join(F.transform("items", lambda i: i["item"]), " "), F.lit(""))
    return queries.select("qid").join(joined, "qid", "left").select("qid", answer.alias("answer"))


def write_answers(answers: DataFrame, path: str) -> None:
    """One answer on each line in query order, as text; a batch's answers are one file."""
    answers.orderBy("qid").coalesce(1).select("answer").write.text(path)


def profile(network: Network) -> DataFrame:
    """``(name, rows)`` of every relation (A4)."""
    counts = [t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), "rows") for n, t in network.tables().items()]
    return reduce(DataFrame.union, counts)

"""Quality rules: counts within a text, and line frequency across the texts of a host.

All of it is DataFrame expressions.  Lines are normalised (lower case, outer white
space dropped, inner white space one blank, digits 0) and hashed; for each host the
distinct documents that hold a line are counted.  A line that more than
``max(min_docs, max_share * documents of the host)`` documents hold is removed from
all of them, and a document of which too little is left is rejected.  With ``max_share``
0, the default, the limit is the same for every host, so a host may have any number of such lines:
they stay rows, are joined with the lines of the texts, and only the places of removed
lines come back to a document.

Edge cases: a null text has no words and fails the base rules; an empty line or one
without words is never counted; a null host is a host of its own; rows with equal ids are one
document where lines are counted, and so are all rows with a null id; repeated rows get equal
results; a very long text is one value, as a column must be, but its lines are counted as rows; an
empty table gives no rows; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.loop import checkpoint_counted
from .text import BROADCAST_BYTES

#: White space that parts words, as a Java character class and as the characters.
SPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"

#: A line must be in more documents of its host than both limits to be removed.
MIN_DOCS = 20
MAX_SHARE = 0.0

#: The share where the limit shall grow with the host.
BY_SHARE = 0.1

#: Shares into which the documents of one line are dealt when it is joined by a shuffle.
SALTS = 16

#: Bytes that a line to remove takes in a broadcast table.
LINE_BYTES = 64

#: What must be left of a document: so many words, and this share of its words.
LEFT_WORDS = 10
LEFT_SHARE = 0.3


def _lines(text: str):
    """Lines that hold a word, as they stand."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.length(F.trim(line, F.lit(SPACES))) > 0)


def _normal(line):
    """A line's normal form."""
    inner = F.regexp_replace(F.lower(F.trim(line, F.lit(SPACES))), f"{SPACE}+", " ")
    return F.regexp_replace(inner, "[0-9]", "0")


def _host(host: str):
    return F.coalesce(F.col(host).cast("string"), F.lit("\0none"))


def base_counts(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` columns with the counts within each text.

    Repeated words: the hashes of all windows of five words are compared; only texts
    in which a hash occurs twice sort them with their places, and the places of
    repeated windows then give the words they cover.
    """
    whole = F.coalesce(text, F.lit(""))
    trimmed = F.trim(whole, F.lit(SPACES))
    counted = df.select(
        *keep,
        F.length(F.regexp_replace(whole, f"{SPACE}+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(whole, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size(_lines(text)) - F.size(F.array_distinct(_lines(text)))).cast("long").alias("n_dup_lines"),
        F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE}+")).alias("__words"),
    )
    windows = F.when(
        F.size("__words") >= 5,
        F.expr("transform(sequence(1, size(__words) - 4), i -> xxhash64(slice(__words, i, 5)))"),
    ).otherwise(F.array().cast("array<long>"))
    hashed = counted.select("*", F.size("__words").cast("long").alias("n_words"), windows.alias("__windows")).drop("__words")
    ordered = hashed.withColumn(
        "__sorted",
        F.when(
            F.size(F.array_distinct("__windows")) < F.size("__windows"),
            F.expr("sort_array(transform(__windows, (h, i) -> named_struct('h', h, 'i', i)))"),
        ),
    ).drop("__windows")
    twice = (
        "(j > 0 AND __sorted[greatest(j - 1, 0)].h = x.h) OR "
        "(j < size(__sorted) - 1 AND __sorted[least(j + 1, size(__sorted) - 1)].h = x.h)"
    )
    placed = ordered.withColumn(
        "__places",
        F.when(F.col("__sorted").isNotNull(), F.expr(f"sort_array(transform(filter(__sorted, (x, j) -> {twice}), x -> x.i))")),
    ).drop("__sorted")
    gaps = "transform(__places, (p, j) -> if(j = 0, 5, least(5, p - __places[greatest(j - 1, 0)])))"
    covered = F.coalesce(F.expr(f"aggregate({gaps}, 0L, (a, x) -> a + x)"), F.lit(0).cast("long"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words")]
    # A filter on a result is never pushed below a generator, so it can't repeat this work for each of its terms.
    return placed.select(*keep, F.inline(F.array(F.struct(*counts))))


def frequent_lines(
    df: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    host: str = "source",
    min_docs: int = MIN_DOCS,
    max_share: float = MAX_SHARE,
) -> tuple[DataFrame, int]:
    """``(line)``: hashes of host and line for the lines to remove; and their number."""
    lines = F.array_distinct(F.transform(_lines(text), lambda line: F.xxhash64(_normal(line))))
    rows = df.select(_host(host).alias("host"), F.xxhash64(F.col(id_col).cast("string")).alias("doc"), lines.alias("lines"))
    # distinct first: the documents of a hot line are dealt out, and the counts that are left combine in each task
    held = rows.select("host", "doc", F.explode("lines").alias("line")).distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    often = held.where(F.col("n") > min_docs)
    if max_share > 0:
        totals = rows.select("host", "doc").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
        often = often.join(totals, "host").where(F.col("n") > F.col("docs") * max_share)
    often, seen = checkpoint_counted(often.select(F.xxhash64("host", "line").alias("line")), n=F.count(F.lit(1)))
    return often, seen["n"]


def _row(id_col: str, text: str, host: str):
    """Rows that are equal here get equal results."""
    return F.xxhash64(F.col(id_col).cast("string"), F.col(text), _host(host))


def removed_lines(df: DataFrame, id_col: str, text: str, host: str, min_docs: int, max_share: float) -> DataFrame:
    """``(__row, removed)``: place and words of each line to remove, for the rows that have any."""
    often, n = frequent_lines(df, id_col, text, host, min_docs, max_share)
    split = F.split(F.coalesce(text, F.lit("")), "\n")
    placed = F.transform(
        split,
        lambda line, at: F.struct(
            at.alias("at"),
            F.xxhash64(F.col("__host"), F.xxhash64(_normal(line))).alias("line"),
            F.when(F.length(F.trim(line, F.lit(SPACES))) == 0, 0)
            .otherwise(F.size(F.split(F.trim(line, F.lit(SPACES)), f"{SPACE}+")))
            .alias("words"),
        ),
    )
    rows = df.select(_row(id_col, text, host).alias("__row"), _host(host).alias("__host"), F.col(text).alias(text))
    lines = rows.select("__row", F.inline(placed)).where("words > 0")
    if n * LINE_BYTES <= BROADCAST_BYTES:
        hits = lines.join(F.broadcast(often), "line", "left_semi")
    else:
        salted = often.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = lines.withColumn("salt", F.pmod("__row", F.lit(SALTS)).cast("int")).join(salted, ["line", "salt"], "left_semi")
    return hits.groupBy("__row").agg(F.collect_set(F.struct("at", "words")).alias("removed"))


def judge(
    df: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    host: str = "source",
    min_docs: int = MIN_DOCS,
    max_share: float = MAX_SHARE,
    keep_text: bool = False,
) -> DataFrame:
    """Counts and verdict for every row; with ``keep_text`` also ``clean_text``, the lines that stay."""
    removed = removed_lines(df, id_col, text, host, min_docs, max_share)
    rows = df.select(id_col, F.col(text).alias("__text"), _row(id_col, text, host).alias("__row"))
    counted = base_counts(rows, "__text", [id_col, "__row", *["__text"] * keep_text])
    joined = counted.join(removed, "__row", "left")
    known = F.col("removed").isNotNull()
    judged = joined.select(
        id_col,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        F.when(known, F.size("removed")).otherwise(0).cast("long").alias("n_removed_lines"),
        F.when(known, F.expr("aggregate(removed, 0L, (a, l) -> a + l.words)")).otherwise(0).cast("long").alias("n_removed_words"),
        *[_clean("__text", known).alias("clean_text")] * keep_text,
    )
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (F.col("n_removed_words") > 0) & ((left < LEFT_WORDS) | (left < LEFT_SHARE * F.col("n_words")))
    return judged.withColumn("kept", ~F.col("base_failed") & ~depleted)


def _clean(text: str, known):
    stays = lambda _, at: ~F.array_contains(F.col("removed")["at"], at)
    return F.when(known, F.array_join(F.filter(F.split(text, "\n"), stays), "\n")).otherwise(F.col(text))

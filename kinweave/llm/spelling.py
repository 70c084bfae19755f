"""Spelling variants: words one edit apart, found through a dictionary of trie-node pairs.

Every word is a path from the root of a trie of all words, and its reversal one in a trie of reversed words.  Nodes are
numbered, so a position of a word is a pair of whole numbers: the node of what stands before and the node of what stands
behind.  Words that differ by a replaced letter have the pair around that letter in common (a skip); a
word with one letter more skips it to a pair that stands at a gap of the shorter word.  A skip and a letter make a word, so
no more words meet at a pair than there are letters, however common the words are.  Of equal letters in a
row only the first is deleted, so that each neighbour is met once, and counts are exact.

Tries are numbered in tasks: words are dealt by ranges of their first letters, so that all words below a deep node lie in one task
in order, where each continues the path of the one before; nodes of few letters are numbered by the letters themselves.
Words are numbered in order of code points, and only numbers travel until the end.

Edge cases: a null text has no words; a null id counts as an empty one; repeated rows and rows of equal ids all count; ties go to the
word that is smaller in code points; a very long run is a word like any other, with a pair for each letter; an empty table gives
no rows; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.loop import RoundLimitReached, checkpoint, checkpoint_counted
from .text import as_bytes, pieces, slices

#: Runs are of a-z, A-Z and the letters whose first byte is C3, as UTF-8; other bytes become blanks.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 128 <= b <= 191 or b == 195 else 32 for b in range(256))
PLAIN = bytes([*range(128), 195, *range(128, 192)])
OTHER = re.compile(rb"[\xc0-\xc2\xc4-\xff][\x80-\xbf]*")

#: A run in this many loses a letter; what makes a result a word.
LOSES = 97
LEAST_LETTERS = 5
LEAST_PLACES = 3

#: A word's form is this many times as frequent, at least.
MORE_FREQUENT = 2

#: Different words that a task counts before it passes their counts on.
HELD_WORDS = 500_000

#: Nodes of up to so many letters are numbered by these, at 21 bits each; deeper ones where all words with the same beginning lie.
SHALLOW = 3
LETTER_BITS = 21

#: Node numbers of a task begin at multiples of this; shallow nodes are numbered below zero.
TASK_NODES = 1 << 40


def runs(text: bytes) -> list[bytes]:
    """Runs of letters, A-Z lower-cased."""
    if text.translate(None, PLAIN):  # there are other letters; nothing of them may stay
        text = OTHER.sub(b" ", text)
    return text.translate(LETTERS).split()


def counted_runs(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(word, n)``: runs of letters of all texts, those that the checksum picks with a letter less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in pieces(batches, "text"):
            for number, whole in zip(as_bytes(batch.column("id")), as_bytes(batch.column("text")), strict=True):
                start = zlib.crc32(number + b":")
                for part in slices(whole):
                    for word, n in Counter([r for r in runs(part) if len(r) >= LEAST_LETTERS]).items():
                        if (h := zlib.crc32(word, start)) % LOSES == 0:
                            letters = word.decode()
                            at = h % len(letters)
                            word = (letters[:at] + letters[at + 1 :]).encode()
                        held[word] = held.get(word, 0) + n
            if len(held) >= HELD_WORDS:
                yield counts(held)
                held.clear()
        yield counts(held)

    def counts(held: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    texts = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text"))
    counted = texts.mapInArrow(run, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).select(F.col("word").cast("string").alias("word"), "n")


def dictionary(counts: DataFrame) -> DataFrame:
    """The words among counted runs: those long and frequent enough."""
    return counts.where((F.char_length("word") >= LEAST_LETTERS) & (F.col("n") >= LEAST_PLACES))


def trie_paths(words: DataFrame, column: str = "word") -> DataFrame:
    """``words`` with ``rank``, which orders them by code points, and ``path``: node numbers from the root to the whole word.

    Equal prefixes have equal numbers, different ones different numbers.  ``double`` tells of each letter whether it repeats the
    one before.
    """
    names = words.columns
    schema = f"{words.schema.simpleString()[7:-1]}, rank long, path array<long>, double array<boolean>"
    at = names.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() * TASK_NODES
        nodes, rank = base + 1, base  # the root is 0
        before, path = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        for batch in pieces(batches, column):
            paths, doubles, ranks = [], [], []
            for word in batch.column(at).to_pylist():
                letters = np.frombuffer(word.encode("utf-32-le"), np.uint32)
                shared = min(len(before), len(letters))
                same = letters[:shared] == before[:shared]
                kept = shared if same.all() else int(np.argmin(same))
                new = np.arange(nodes, nodes + len(letters) - kept)
                nodes += len(new)
                path = np.concatenate([path[: kept + 1], new])
                for depth in range(min(kept, SHALLOW), min(len(letters), SHALLOW)):
                    path[depth + 1] = _shallow(letters[: depth + 1])
                before = letters
                paths.append(path)
                doubles.append(np.concatenate([[False], letters[1:] == letters[:-1]]))
                ranks.append(rank)
                rank += 1
            more = [pa.array(ranks, pa.int64()), pa.array(paths, pa.list_(pa.int64())), pa.array(doubles, pa.list_(pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*names, "rank", "path", "double"])

    head = F.substring(column, 1, SHALLOW + 1)
    dealt = words.withColumn("__head", head).repartitionByRange("__head").sortWithinPartitions(column).drop("__head")
    return checkpoint(dealt.select(*names).mapInArrow(run, schema))


def _shallow(letters: np.ndarray) -> int:
    """The number of a node of few letters: the letters as digits, below zero."""
    number = 0
    for letter in letters.tolist():
        number = number << LETTER_BITS | letter
    return -1 - number


def node_pairs(forward: DataFrame, back: DataFrame) -> DataFrame:
    """``(before, behind, rank, n, skip, first)``: for each word the pairs of nodes around each letter and at each gap.

    ``forward`` has the paths of the words, ``back`` as ``(rank, behind)`` those of the reversed words, each from its end.
    ``skip`` tells letters from gaps; ``first`` is false for a letter that repeats the one before.
    """
    both = forward.select("rank", "n", "path", "double").join(back, "rank")
    # behind[i] is the node of what follows the first i letters
    letters = "transform(double, (again, i) -> struct(path[i] AS before, behind[i + 1] AS behind, true AS skip, not again AS first))"
    gaps = "transform(path, (node, i) -> struct(node AS before, behind[i] AS behind, false AS skip, true AS first))"
    return both.select("rank", "n", F.explode(F.expr(f"concat({letters}, {gaps})")).alias("p")).select("p.before", "p.behind", "rank", "n", "p.skip", "p.first")


def near_words(pairs: DataFrame) -> DataFrame:
    """``(rank, n_near, form_n, form)``: of each word with near words their number, and the most frequent one."""
    met = pairs.repartition("before", "behind").sortWithinPartitions("before", "behind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            rows = [np.concatenate(c) for c in zip(held, rows, strict=True)] if held else rows
            ends = np.nonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0))[0] + 1
            cut = int(ends[-1]) if len(ends) else 0  # the last pair may go on in the next batch
            if cut:
                yield _met([c[:cut] for c in rows])
            held = [c[cut:] for c in rows]
        if held:
            yield _met(held)

    each = met.mapInArrow(run, "rank long, near long, n long, form long")
    found = each.groupBy("rank").agg(F.sum("near").alias("n_near"), F.max(F.struct("n", -F.col("form"))).alias("best"))
    return found.select("rank", "n_near", F.col("best.n").alias("form_n"), (-F.col("best.col2")).alias("form"))


def _met(rows: list[np.ndarray]) -> pa.RecordBatch:
    """What words meet at whole pairs: ``(rank, near, n, form)`` for each word with others there, the most frequent one last."""
    before, behind, rank, n, skip, first = rows
    new = np.concatenate([[True], (np.diff(before) != 0) | (np.diff(behind) != 0)])
    pair = np.cumsum(new) - 1
    many = (np.bincount(pair) > 1)[pair]
    pair, rank, n, skip, first = (c[many] for c in (pair, rank, n, skip, first))
    order = np.lexsort((rank, -n, pair))  # of each pair the most frequent word comes first
    pair, rank, n, skip, first = (c[order] for c in (pair, rank, n, skip, first))
    pairs = int(pair[-1]) + 1 if len(pair) else 0

    def best(some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each pair: how many of these rows there are, the first one and the second one, -1 where there is none."""
        at = np.nonzero(some)[0]
        count = np.bincount(pair[at], minlength=pairs)
        begin = np.concatenate([[0], np.cumsum(count)])[:-1]
        at = np.concatenate([at, [-1, -1]])
        return count, np.where(count > 0, at[begin], -1), np.where(count > 1, at[np.minimum(begin + 1, len(at) - 1)], -1)

    skips, top, second = best(skip)
    inserted, longest, _ = best(skip & first)
    gaps, gap, _ = best(~skip)
    own = np.arange(len(pair))
    # beside a letter stand the other letters, and the word without it
    other = np.where(top[pair] == own, second[pair], top[pair])
    shorter = np.where(first, gap[pair], -1)
    near = np.where(skip, skips[pair] - 1 + (shorter >= 0), inserted[pair])
    further = np.where(skip, shorter, longest[pair])
    other = np.where(skip, other, -1)
    # rows of a pair are in order, so the smaller place is the better word
    form = np.where((other < 0) | ((further >= 0) & (further < other)), further, other)
    found = near > 0
    form = form[found]
    columns = [rank[found], near[found].astype(np.int64), n[form], rank[form]]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["rank", "near", "n", "form"])


def roots(forms: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``(rank, root)`` of words with a form: forms followed to the last, all chains halved in each round."""
    links, seen = checkpoint_counted(forms.select("rank", F.col("form").alias("root")), n=F.count(F.lit(1)))
    moved = seen["n"]
    for _ in range(max_rounds):
        if not moved:
            return links
        further = links.select(F.col("rank").alias("root"), F.col("root").alias("__next"))
        step = links.join(further, "root", "left").select("rank", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved"))
        step, seen = checkpoint_counted(step, moved=F.count_if("moved"))
        links, moved = step.select("rank", "root"), seen["moved"]
    raise RoundLimitReached(f"some words have more than 2^{max_rounds} forms")


def group_variants(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of a table of texts."""
    return variants_of(dictionary(counted_runs(df, id_col, text)))


def variants_of(words: DataFrame) -> DataFrame:
    """As :func:`group_variants`, for a dictionary ``(word, n)`` of different words."""
    forward = trie_paths(checkpoint(words.select("word", "n")))
    back = trie_paths(forward.select("rank", F.reverse("word").alias("word")).withColumnRenamed("rank", "number"))
    near = checkpoint(near_words(node_pairs(forward, back.select(F.col("number").alias("rank"), F.reverse("path").alias("behind")))))
    placed = forward.select("word", "n", "rank").join(near, "rank", "left")
    chosen = F.col("form_n") >= MORE_FREQUENT * F.col("n")
    placed = placed.select("word", "n", "rank", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), *[F.when(chosen, F.col(c)).alias(c) for c in ("form", "form_n")])
    placed = checkpoint(placed)
    last = roots(placed.where("form IS NOT NULL").select("rank", "form"))
    name = lambda c: forward.select(F.col("rank").alias(c), F.col("word").alias(f"{c}_word"))
    named = placed.join(last, "rank", "left").join(name("form"), "form", "left").join(name("root"), "root", "left")
    return named.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")

"""Language identification by word-first backoff.

A known word adds its log frequency in each language.  An unseen word falls back to
its character 4-grams (word ends marked), then 3-, 2- and 1-grams: the longest length
of which any gram is known gives the mean of their log frequencies.  The largest mean over
the words of a text wins; the score is the share that a softmax over these means gives it, so
it stays low for texts whose words speak for no language, however long they are.

The model is fitted on a bounded sample: of each language about ``max_rows`` labelled rows and
``max_bytes`` bytes of text, chosen by a hash over the whole table.  All words of the sample
and all grams of those words are kept.  Prediction reads every whole text once.

Edge cases: a text that is null or has no letter is ``und`` with score 0; with no
labelled rows everything is ``und``; ties go to the language that sorts first;
repeated rows get equal predictions and, with equal id and text, enter a sample together or not
at all; very long texts are read in parts; columns other than id and text are ignored by
:func:`predict`, whatever they are called, and kept by :func:`keep_identified`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import pieces, schema_of, slices

#: The sample that the model is fitted on, for each language at most about: rows, bytes of text.
MAX_ROWS = 5_000
MAX_BYTES = 32 << 20

#: Different labels that a model may tell apart.
MAX_LANGUAGES = 1_000

LONGEST = 4

UNDETERMINED = "und"

#: How far a score must be on the way from chance, 1 in the number of languages, to 1 for a language to be told.
MARGIN = 0.13

#: Runs of letters; the few numeric characters that \w also holds do no harm.
_WORDS = re.compile(r"[^\W\d_]+").findall

#: Unseen words, and values of theirs, that a task remembers before it starts afresh.
CACHE_WORDS, CACHE_VALUES = 100_000, 4_000_000

#: Resolution of the sampling hash.
_STEPS = 1 << 30


@dataclass(frozen=True)
class Table:
    """Log frequencies by value and language; only pairs that were seen have an entry.

    Words are known by 64-bit hashes, so that a task holds no string for each.  Entries of value i are ``begin[i]`` to ``begin[i + 1]``: language numbers, and how much
    more than the language's smallest value each is.
    """

    values: list[str] | np.ndarray
    begin: np.ndarray
    languages: np.ndarray
    more: np.ndarray


@dataclass(frozen=True)
class Model:
    """Tables of words (0) and of character grams by length, and the smallest values of each."""

    languages: list[str]
    tables: list[Table]
    least: list[np.ndarray]


def sample(df: DataFrame, id_col: str, text: str, lang: str, max_rows: int, max_bytes: int) -> DataFrame:
    """``(lang, text)`` of the labelled rows to fit on: a like share of all rows of a language, and at least one of each.

    Rows are taken by a hash of theirs; the first one in that order is taken whatever the bounds are, a text beyond ``max_bytes``
    letters in part.
    """
    place = F.pmod(F.xxhash64(F.col(id_col), F.col(text)), F.lit(_STEPS))
    labelled = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), place.alias("place")
    )
    found = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("held"), F.min("place").alias("first"))
    found = found.limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} different labels")
    shares = [(r.lang, max(r.first + 1, int(_STEPS * min(1, max_rows / r.n, max_bytes / max(r.held, 1))))) for r in found]
    steps = F.broadcast(df.sparkSession.createDataFrame(shares, "lang string, steps long"))
    return labelled.join(steps, "lang").where("place < steps").select("lang", F.substring("text", 1, max_bytes).alias("text"))


def fit(
    df: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    max_rows: int = MAX_ROWS,
    max_bytes: int = MAX_BYTES,
) -> Model:
    """Fit on the rows of ``df`` that have a text and a label."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            seen: dict[str, Counter] = {}
            for language, content in zip(piece.column("lang").to_pylist(), piece.column("text").to_pylist()):
                counter = seen.setdefault(language, Counter())
                for part in slices(content):
                    counter.update(_WORDS(part.lower()))
            rows = [(k, w, n) for k, c in seen.items() for w, n in c.items()]
            columns = list(zip(*rows)) if rows else [()] * 3
            kinds = (pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "word", "n"])

    chosen = sample(df, id_col, text, lang, max_rows, max_bytes)
    words = chosen.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).persist()
    marked = words.withColumn("marked", F.concat(F.lit("^"), "word", F.lit("$")))
    grams = ", ".join(
        f"if(length(marked) < {n}, array(), transform(sequence(1, length(marked) - {n - 1}), i -> substring(marked, i, {n})))"
        for n in range(1, LONGEST + 1)
    )
    parts = marked.select("lang", "n", F.explode(F.expr(f"flatten(array({grams}))")).alias("word")).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = [words.toArrow(), parts.toArrow()]
    words.unpersist()
    languages = sorted(counted[0].column("lang").unique().to_pylist())
    lengths = np.array([len(g) for g in counted[1].column("word").to_pylist()], np.int64)
    split = [counted[0], *(counted[1].filter(pa.array(lengths == n)) for n in range(1, LONGEST + 1))]
    tables, least = zip(*(_table(languages, t, not k) for k, t in enumerate(split)))
    return Model(languages, list(tables), list(least))


def _hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _table(languages: list[str], counts: pa.Table, hashed: bool) -> tuple[Table, np.ndarray]:
    """Smoothed log frequencies of one kind of value."""
    at = {k: i for i, k in enumerate(languages)}
    counts = counts.sort_by("word")
    lang = np.array([at[k] for k in counts.column("lang").to_pylist()], np.int64)
    n = counts.column("n").to_numpy().astype(np.float64)
    totals = 1.0 + np.bincount(lang, n, len(languages))
    words = counts.column("word").to_pylist()
    begin = [i for i, w in enumerate(words) if not i or w != words[i - 1]]
    values = [words[i] for i in begin]
    more = np.log((n + 0.1) / 0.1)
    table = Table(_hashes(values) if hashed else values, np.array([*begin, len(words)], np.int64), lang.astype(np.int32), more.astype(np.float32))
    return table, np.log(0.1 / totals)


class _Places:
    """Places of hashes in an array, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.slots = np.full(1 << (2 * len(keys) + 1).bit_length(), -1, np.int32)
        self.last = np.uint64(len(self.slots) - 1)
        todo, self.steps = np.arange(len(keys), dtype=np.int32), 0
        while len(todo):
            slot = (keys[todo] + np.uint64(self.steps)) & self.last
            free = self.slots[slot] < 0
            self.slots[slot[free]] = todo[free]
            todo = todo[self.slots[slot] != todo]
            self.steps += 1

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        out, todo = np.full(len(hashes), -1, np.int32), np.arange(len(hashes))
        for step in range(self.steps):
            place = self.slots[(hashes[todo] + np.uint64(step)) & self.last]
            todo, place = todo[place >= 0], place[place >= 0]
            if not len(todo):
                break
            same = self.keys[place] == hashes[todo]
            out[todo[same]] = place[same]
            todo = todo[~same]
        return out


class _Scorer:
    """What words say: known ones by their table, unseen ones by backoff, which is remembered for a while."""

    def __init__(self, model: Model):
        self.model = model
        self.words = _Places(model.tables[0].values)
        self.grams = [{g: i for i, g in enumerate(t.values)} for t in model.tables[1:]]
        self.room = max(1000, min(CACHE_WORDS, CACHE_VALUES // max(1, len(model.languages))))
        self.unseen = np.zeros((self.room, len(model.languages)), np.float32)
        self.rows: dict[str, int] = {}

    def row(self, word: str) -> int:
        """The row of ``unseen`` with what backoff says about a word."""
        if (at := self.rows.get(word)) is None:
            at = self.rows[word] = len(self.rows)
            self.unseen[at] = self.backoff(word)
        return at

    def backoff(self, word: str) -> np.ndarray:
        marked = f"^{word}$"
        for n in range(LONGEST, 0, -1):
            known = [i for k in range(len(marked) - n + 1) if (i := self.grams[n - 1].get(marked[k : k + n])) is not None]
            if known:
                return self.sums(n, np.array(known), np.zeros(len(known), np.int64), 1)[0] / len(known) + self.model.least[n]
        return np.zeros(len(self.model.languages), np.float32)

    def sums(self, kind: int, numbers: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
        """What the entries of some values add up to for each of their owners, in each language."""
        table, width = self.model.tables[kind], len(self.model.languages)
        size = table.begin[numbers + 1] - table.begin[numbers]
        entry = np.repeat(table.begin[numbers] - np.cumsum(size) + size, size) + np.arange(size.sum())
        cell = np.repeat(owner, size) * width + table.languages[entry]
        return np.bincount(cell, table.more[entry], owners * width).reshape(owners, width)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        languages = self.model.languages
        total, count = np.zeros((len(texts), len(languages))), np.zeros(len(texts), np.int64)
        held: list[str] = []
        owners: list[tuple[int, int]] = []

        def add() -> None:
            """Add what the words held say to their texts."""
            owner = np.repeat([row for row, _ in owners], [n for _, n in owners])
            places = self.words.find(_hashes(held))
            known, rest = places >= 0, np.nonzero(places < 0)[0]
            total[:] += self.sums(0, places[known], owner[known], len(texts))
            total[:] += np.bincount(owner[known], minlength=len(texts))[:, None] * self.model.least[0]
            if len(self.rows) + len(rest) > self.room:
                self.rows.clear()
            rows = np.fromiter((self.row(held[i]) for i in rest.tolist()), np.int64, len(rest))
            np.add.at(total, owner[rest], self.unseen[rows])
            held.clear()
            owners.clear()

        lettered = np.zeros(len(texts), bool)
        for row, text in enumerate(texts if languages else ()):
            for part in slices(text or ""):
                words = _WORDS(part.lower())
                lettered[row] |= any(c.isalpha() for w in words for c in w)
                count[row] += len(words)
                for begin in range(0, len(words), self.room // 2):
                    some = words[begin : begin + self.room // 2]
                    held += some
                    owners.append((row, len(some)))
                    if len(held) > self.room // 2:
                        add()
        if held:
            add()
        out = [(UNDETERMINED, 0.0)] * len(texts)
        for row in np.nonzero(lettered)[0].tolist():
            mean = total[row] / count[row]
            best = int(np.argmax(mean))
            out[row] = (languages[best], 1 / float(np.exp(np.maximum(mean - mean[best], -700)).sum()))
        return out


def _model(shared) -> Model:
    languages, tables, least = shared.value
    return Model(languages, [Table(*t) for t in tables], least)


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, text_hash, lang_pred, score)`` of every row."""
    shared = df.sparkSession.sparkContext.broadcast(astuple(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(_model(shared))
        for piece in pieces(batches, text):
            found = scorer.predict(piece.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column(id_col),
                    piece.column("__hash"),
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                ],
                names=[id_col, "text_hash", "lang_pred", "score"],
            )

    schema = schema_of(df, [id_col], "text_hash long, lang_pred string, score double")
    return df.select(id_col, text, F.xxhash64(text).alias("__hash")).mapInArrow(run, schema)


def bar(languages: int, margin: float = MARGIN) -> float:
    """The least score that tells one of so many languages."""
    return 1 / languages + margin * (1 - 1 / languages) if languages else 0.0


def keep_identified(df: DataFrame, model: Model, text: str = "text", margin: float = MARGIN) -> DataFrame:
    """The rows of ``df`` whose language can be told: not ``und`` and a score that is by ``margin`` above chance."""
    shared, least = df.sparkSession.sparkContext.broadcast(astuple(model)), bar(len(model.languages), margin)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(_model(shared))
        for piece in pieces(batches, text):
            found = scorer.predict(piece.column(text).to_pylist())
            yield piece.filter(pa.array([language != UNDETERMINED and score >= least for language, score in found], pa.bool_()))

    return df.mapInArrow(run, df.schema)

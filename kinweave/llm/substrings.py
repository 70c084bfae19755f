"""Substring deduplication by a relative Lempel-Ziv parse over content-chosen reference blocks.

A document is a sequence of words.  Content picks its blocks: of every window of 50
words the 10-word gram with the smallest hash is the anchor, and the consecutive windows
with the same anchor form one block of 50 words or more (neighbouring blocks overlap).
Equal passages have equal anchors and, inside, equal blocks, so the blocks of all
documents, indexed by their hashes, are the reference.

Each document is factored against it from left to right.  A block that stands in a document with
a smaller id starts a factor (reference document, its place there, length), and blocks that follow it
there in the same order extend it.  Where a factor can start or end, a block differs from every
earlier one but may share windows with them: these boundary blocks, and only those whose
anchor occurs in several different blocks, are checked window by window, which starts factors
earlier and ends them later than the blocks alone.  The parse is greedy: a factor goes on as long as
the next windows continue it, and what it covers starts no other.  Of several documents with a passage
the smallest serves as reference for each block; so where two share its parts, two factors stand
for one, and every window is judged as if all pairs of documents had been compared.

Rolling hashes only choose the anchors.  Blocks and windows are equal if the BLAKE2b digests of their
words are, as exact copies are by SHA-256; texts with boundary blocks are read again for their windows.

Scale: an anchor falls on about every 21st word, so the index has one short row per 21
words; blocks that are alike are reduced to their smallest document before they are joined;
exact copies are recognised by one digest and never enter the index twice.  The index is
a checkpoint, so that joins on hot blocks can be split at run time.  Long texts are read in parts.

Edge cases: a null text has no words; a text of fewer than 50 words has no window and
stays whole; a row with a null id is left whole and serves as no reference; rows with equal
ids never remove each other's words; an empty table gives no rows; columns other than id and text
are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.loop import checkpoint
from .text import BROADCAST_BYTES, PIECE_BYTES, as_bytes, pieces, schema_of, slices, small

#: Words in a window that counts as repeated, and in an anchor.
WINDOW, GRAM = 50, 10

#: Fixed value: odd multiplier of the rolling hash over grams.
_GRAM = 0xC2B2AE3D27D4EB4F


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _rolling(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of values times powers, and the inverse powers: see :func:`_range_hash`."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, len(values)), out=sums[1:])
    return sums, _powers(pow(base, -1, 1 << 64), len(values) + 1)


def _range_hash(rolling: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the values from ``start`` to ``end``, wherever they stand."""
    sums, inverse = rolling
    return _mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def blocks(words: list[bytes], counts: np.ndarray) -> list[np.ndarray]:
    """Text number, first window, windows, anchor hash and the two halves of the content digest of each block.

    ``words`` are those of all texts, ``counts`` how many each text has.
    """
    n = len(words)
    none = [np.zeros(0, np.int64)] * 6
    if n < WINDOW:
        return none
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    grams = _range_hash(_rolling(hashes, _GRAM), np.arange(n - GRAM + 1), np.arange(GRAM, n + 1))
    best, width, reach = np.arange(len(grams)), 1, WINDOW - GRAM + 1
    while width < reach:  # leftmost smallest gram of the next `width` grams
        step = min(width, reach - width)
        a, b = best[:-step], best[step:]
        best = np.where(grams[b] < grams[a], b, a)
        width += step
    owner = np.repeat(np.arange(len(counts)), counts)
    starts = np.nonzero(owner[: n - WINDOW + 1] == owner[WINDOW - 1 :])[0]
    if not len(starts):
        return none
    anchor, text = best[starts], owner[starts]
    begins = np.nonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))[0]
    size = np.diff(np.concatenate([begins, [len(starts)]]))
    first = starts[begins]
    contents = b"".join(_digest(words[a:b]) for a, b in zip(first.tolist(), (first + size - 1 + WINDOW).tolist()))
    halves = np.frombuffer(contents, "<i8").reshape(-1, 2)
    place = np.concatenate([[0], np.cumsum(counts)])[text[begins]]
    return [text[begins], first - place, size, grams[anchor[begins]].view(np.int64), halves[:, 0].copy(), halves[:, 1].copy()]


def _indexed(texts: list[bytes]) -> tuple[list[int], list[str], list[np.ndarray]]:
    """Words and SHA-256 of each text, and the columns of :func:`blocks` of all."""
    if any(len(t) > PIECE_BYTES for t in texts):
        counts, digests, found = zip(*map(_indexed_in_parts, texts))
        columns = [[row * np.ones(len(c[0]), np.int64), *c[1:]] for row, c in enumerate(found)]
        return [*map(sum, counts)], [d[0] for d in digests], [np.concatenate(c) for c in zip(*columns)]
    lists = [t.split() for t in texts]
    counts = [len(w) for w in lists]
    found = blocks([w for words in lists for w in words], np.array(counts, np.int64))
    return counts, [hashlib.sha256(b" ".join(w)).hexdigest() for w in lists], found


def _indexed_in_parts(text: bytes) -> tuple[list[int], list[str], list[np.ndarray]]:
    """As :func:`_indexed` for one long text: a part's last block may go on, so the next part starts with it."""
    digest, n, held, found = hashlib.sha256(), 0, [], []

    def add(last: bool) -> None:
        owner, start, *more = blocks(held, np.array([len(held)]))
        done = len(owner) if last else max(0, len(owner) - 1)
        found.append([owner[:done], start[:done] + n - len(held), *(m[:done] for m in more)])
        if not last and len(owner):
            del held[: int(start[-1])]

    for part in slices(text):
        words = part.split()
        digest.update((b" " if n and words else b"") + b" ".join(words))
        held += words
        n += len(words)
        add(False)
    add(True)
    return [n], [digest.hexdigest()], [np.concatenate(c) for c in zip(*found)]


def _index(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """``(id, text_hash, n_words, digest, anchors, lefts, rights, starts, sizes)`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text):
            counts, digests, (owner, start, size, anchor, left, right) = _indexed(as_bytes(piece.column(text)))
            cuts = pa.array(np.searchsorted(owner, np.arange(piece.num_rows + 1)).astype(np.int32))
            lists = [
                pa.ListArray.from_arrays(cuts, pa.array(v))
                for v in (anchor, left, right, start.astype(np.int32), size.astype(np.int32))
            ]
            yield pa.RecordBatch.from_arrays(
                [piece.column(id_col), piece.column("__hash"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), *lists],
                names=[id_col, "text_hash", "n_words", "digest", "anchors", "lefts", "rights", "starts", "sizes"],
            )

    ddl = (
        "text_hash long, n_words long, digest string, anchors array<long>, lefts array<long>, rights array<long>, "
        "starts array<int>, sizes array<int>"
    )
    rows = df.select(id_col, text, F.xxhash64(text).alias("__hash"))
    return rows.mapInArrow(run, schema_of(df, [id_col], ddl))


def _ranges(text: bytes, starts: list[int], stops: list[int]) -> Iterator[list[bytes]]:
    """The words of each range, of which no later one starts before an earlier one."""
    parts, words, base = slices(text), [], 0
    for start, stop in zip(starts, stops):
        while base + len(words) < stop:
            passed = min(len(words), max(0, start - base))
            words, base = words[passed:] + next(parts).split(), base + passed
        yield words[start - base : stop - base]


def _windows(df: DataFrame, wanted: DataFrame, id_col: str, text: str) -> DataFrame:
    """``(id, text_hash, key, start)``: digests of the words of each window of the wanted blocks.

    ``wanted`` has ``(__id, __hash, starts, sizes)``, one row for each text concerned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text):
            rows, keys, at = [], [], []
            columns = (as_bytes(piece.column(text)), piece.column("starts").to_pylist(), piece.column("sizes").to_pylist())
            for row, (content, starts, sizes) in enumerate(zip(*columns)):
                stops = [a + n - 1 + WINDOW for a, n in zip(starts, sizes)]
                for words, a, n in zip(_ranges(content, starts, stops), starts, sizes):
                    keys += [_digest(words[k : k + WINDOW]) for k in range(n)]
                    at += range(a, a + n)
                    rows += [row] * n
            picked = piece.select([id_col, "__hash"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [picked.column(0), picked.column(1), pa.array(keys, pa.binary()), pa.array(at, pa.int32())],
                names=[id_col, "text_hash", "key", "start"],
            )

    joined = _with_runs(df, wanted, id_col, text)
    return joined.mapInArrow(run, schema_of(df, [id_col], "text_hash long, key binary, start int"))


def parse(matches: list[tuple]) -> list[list]:
    """Factors ``[start, windows, reference, its start]`` from ``(start, windows, reference, its start)`` matches by start."""
    out: list[list] = []
    for start, size, ref, ref_start in matches:
        if out:
            last = out[-1]
            end = last[0] + last[1]
            if start + size <= end:
                continue
            if start <= end and ref == last[2] and ref_start - start == last[3] - last[0]:
                last[1] = start + size - last[0]
                continue
            passed = max(0, end - start)
            start, size, ref_start = start + passed, size - passed, ref_start + passed
        out.append([start, size, ref, ref_start])
    return out


def factors(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The index of all rows, and the factors ``(__id, __hash, starts, sizes, refs, ref_starts)`` of each text.

    A factor of ``size`` windows, the first at word ``start``, stands in the document ``ref``, which has a smaller id,
    from word ``ref_start`` on.  Rows whose words all stand in an earlier copy
    have no factors: the index's ``copy`` column is true for them.
    """
    index = checkpoint(_index(df, id_col, text))
    known = index.where(F.col(id_col).isNotNull() & (F.col("n_words") >= WINDOW))
    first = known.groupBy("digest").agg(F.min(id_col).alias("__first"), F.count(F.lit(1)).alias("n"))
    first = checkpoint(first.where("n > 1").select("digest", "__first"))
    marked = index.join(small(first, 128), "digest", "left")
    copy = F.coalesce(F.col("__first") < F.col(id_col), F.lit(False)) & (F.col("n_words") >= WINDOW)
    marked = marked.withColumn("copy", copy).drop("__first")
    rows = (
        marked.where(~F.col("copy") & F.col(id_col).isNotNull() & (F.size("anchors") > 0))
        .select(id_col, "text_hash", F.explode(F.arrays_zip("anchors", "lefts", "rights", "starts", "sizes")).alias("b"))
        .select(
            id_col,
            "text_hash",
            F.col("b.anchors").alias("anchor"),
            F.col("b.lefts").alias("left"),
            F.col("b.rights").alias("right"),
            F.col("b.starts").alias("start"),
            F.col("b.sizes").alias("size"),
        )
    )
    shared = rows.groupBy("anchor").agg(F.min(id_col).alias("low"), F.max(id_col).alias("high")).where("low < high")
    near = checkpoint(rows.join(small(checkpoint(shared.select("anchor")), 24), "anchor"))
    block = ["anchor", "left", "right"]
    low = F.min(F.struct(F.col(id_col).alias("ref"), F.col("start").alias("ref_start"))).alias("low")
    distinct = checkpoint(near.groupBy(*block).agg(low, F.max(id_col).alias("high")))
    several = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    several = small(checkpoint(several.select("anchor", F.lit(True).alias("several"))), 24)
    # one row for each different block that more than one document may hold, whole or in part
    reference = distinct.join(several, "anchor", "left").where("low.ref < high OR several")
    reference = checkpoint(reference.select(*block, "low.*", F.coalesce("several", F.lit(False)).alias("several")))
    held = checkpoint(near.join(reference, block).drop(*block))
    whole = held.where(F.col("ref") < F.col(id_col)).select(id_col, "text_hash", "start", "size", "ref", "ref_start")
    parted = _of_texts(held.where((F.col("ref") == F.col(id_col)) & F.col("several")), id_col, ["start", "size"])
    parted = checkpoint(parted.select("__id", "__hash", F.col("runs.start").alias("starts"), F.col("runs.size").alias("sizes")))
    windows = checkpoint(_windows(df, parted, id_col, text))
    earliest = windows.groupBy("key").agg(low, F.max(id_col).alias("high"))
    earliest = checkpoint(earliest.where("low.ref < high").select("key", "low.*"))
    parts = windows.join(earliest, "key").where(F.col("ref") < F.col(id_col))
    matches = whole.union(parts.select(id_col, "text_hash", "start", F.lit(1).alias("size"), "ref", "ref_start"))
    return marked, checkpoint(_parsed(_of_texts(matches, id_col, ["start", "size", "ref", "ref_start"])))


def _of_texts(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """One row for each text with its rows of ``columns``, in order."""
    runs = F.sort_array(F.collect_set(F.struct(*columns)))
    return df.groupBy(F.col(id_col).alias("__id"), F.col("text_hash").alias("__hash")).agg(runs.alias("runs"))


def _parsed(matches: DataFrame) -> DataFrame:
    """The factors of each text from its matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse([tuple(m.values()) for m in runs]) for runs in batch.column("runs").to_pylist()]
            kinds = (pa.int32(), pa.int32(), batch.schema.field("__id").type, pa.int32())
            lists = [pa.array([[f[i] for f in fs] for fs in found], pa.list_(kind)) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__hash"), *lists], names=names)

    names = ["__id", "__hash", "starts", "sizes", "refs", "ref_starts"]
    kind = matches.schema["__id"].dataType.simpleString()
    return matches.mapInArrow(run, f"__id {kind}, __hash long, starts array<int>, sizes array<int>, refs array<{kind}>, ref_starts array<int>")


def _with_runs(df: DataFrame, runs: DataFrame, id_col: str, text: str) -> DataFrame:
    """The texts of ``df`` that have runs, with the columns of these.

    Runs of a few MB are broadcast.  Else their keys alone may fit; they then drop the texts
    without runs before the others are shuffled.  Beyond that all texts are shuffled.
    """
    rows, held = runs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.lit(64) + F.size("starts") * 8), F.lit(0))).first()
    texts = df.select(id_col, text, F.xxhash64(text).alias("__text_hash"))
    keys = (F.col(id_col) == F.col("__id")) & (F.col("__text_hash") == F.col("__hash"))
    if held <= BROADCAST_BYTES:
        runs = F.broadcast(runs)
    elif rows * 64 <= BROADCAST_BYTES:
        texts = texts.join(F.broadcast(runs.select("__id", "__hash")), keys, "left_semi")
    return texts.join(runs, keys).drop("__id", "__text_hash")


def remove_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, n_words, n_removed, kept_sha256, kept)`` of every row.

    ``kept`` holds the words that stay, joined by blanks, for texts that lose some but
    not all of their words; it is null where the text stays as it is, empty where it goes.
    """
    index, found = factors(df, id_col, text)
    runs = found.select("__id", "__hash", "starts", "sizes")
    nothing = hashlib.sha256().hexdigest()
    keys = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))
    bare = runs.select("__id", "__hash")
    plain = index.select(id_col, "text_hash", "n_words", "digest", "copy").join(small(bare), keys, "left_anti")
    untouched = plain.select(
        id_col,
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(0).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(nothing)).otherwise(F.col("digest")).alias("kept_sha256"),
        F.when(F.col("copy"), F.lit("")).alias("kept"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text):
            n_words, removed, digests, kept = [], [], [], []
            columns = (as_bytes(piece.column(text)), piece.column("starts").to_pylist(), piece.column("sizes").to_pylist())
            for content, starts, sizes in zip(*columns):
                n, lost, digest, stays = 0, 0, hashlib.sha256(), bytearray()
                ends = [a + k - 1 + WINDOW for a, k in zip(starts, sizes)]
                for part in slices(content):
                    words = part.split()
                    gone = np.zeros(len(words), bool)
                    for a, b in zip(starts, ends):
                        gone[max(0, a - n) : max(0, b - n)] = True
                    some = b" ".join([words[i] for i in np.nonzero(~gone)[0]])
                    stays += (b" " if stays and some else b"") + some
                    n += len(words)
                    lost += int(gone.sum())
                digest.update(stays)
                n_words.append(n)
                removed.append(lost)
                digests.append(digest.hexdigest())
                kept.append(stays.decode())
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column(id_col),
                    pa.array(n_words, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(digests, pa.string()),
                    pa.array(kept, pa.string()),
                ],
                names=[id_col, "n_words", "n_removed", "kept_sha256", "kept"],
            )

    ddl = "n_words long, n_removed long, kept_sha256 string, kept string"
    cut = _with_runs(df, runs, id_col, text).mapInArrow(run, schema_of(df, [id_col], ddl))
    return untouched.unionByName(cut)


def digest(found: DataFrame) -> DataFrame:
    """Without the texts."""
    return found.drop("kept")

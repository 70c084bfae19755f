"""Byte-level BPE encoding and decoding by a two-tier lookup.

Text is split into pre-tokens by the public pattern.  The first tier is a minimal
perfect hash over the vocabulary: one probe and one comparison resolve a pre-token
that is a vocabulary entry.  Only misses reach the second tier, which merges a
doubly linked list of byte symbols, taking the lowest rank (then the leftmost pair)
from a heap, so a long pre-token costs O(n log n).  It knows no strings: a table of pairs of
token ids says what two neighbours merge to.

Edge cases: a null text is an empty text and has no tokens; empty and repeated rows
are ordinary rows; a bytes vocabulary that lacks a single byte is rejected when it
is loaded, so every text can be encoded; very long texts are split bit by bit (a single
pre-token of n bytes takes some 60 n bytes while it is merged); given columns named ``ids`` or
``decoded`` come back as ``ids_given`` and ``decoded_given``.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from dataclasses import astuple, dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import PIECE_BYTES, pieces, schema_of, set_aside

#: Resolved pre-tokens that a task remembers before it starts afresh.
CACHE_ENTRIES = 400_000

#: Displacements that a bucket of the perfect hash tries before the keys are hashed with another seed.
MAX_TRIES = 1 << 20


@dataclass(frozen=True)
class Vocabulary:
    """Token bytes by id, the minimal perfect hash over them, and which pairs of ids merge to which id.

    Bounded by the vocabulary.
    """

    tokens: list[bytes]
    pattern: str
    seed: int
    displacement: np.ndarray
    slots: np.ndarray
    pairs: np.ndarray
    merged: np.ndarray

    def find(self, token: bytes) -> int:
        """Id of a whole token, or -1: one probe, one comparison."""
        h = xxhash.xxh3_64_intdigest(token, self.seed)
        n = len(self.slots)
        d = int(self.displacement[h % len(self.displacement)])
        slot = -d - 1 if d < 0 else _slot(h, d, n)
        found = int(self.slots[slot])
        return found if self.tokens[found] == token else -1


def _slot(h: int, d: int, n: int) -> int:
    return (((h >> 32) + d * ((h >> 17 & 0x7FFF) * 2 + 1)) ^ (d << 7)) % n


def load_vocabulary(path: str, pattern: str) -> Vocabulary:
    """Read a rank file (base64 token, rank) and build its tables on the driver."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    tokens = [b""] * len(ranks)
    for token, rank in ranks.items():
        tokens[rank] = token
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
    n, pairs = len(tokens), {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pairs[left * n + right] = rank
    keys, values = np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs))
    return Vocabulary(tokens, pattern, *_perfect_hash(tokens), keys, values)


def _perfect_hash(tokens: list[bytes]) -> tuple[int, np.ndarray, np.ndarray]:
    """Seed, displacements and slots of the first seed under which every bucket finds its places."""
    for seed in range(100):
        if (found := _displaced(tokens, seed)) is not None:
            return seed, *found
    raise ValueError("no perfect hash was found: are tokens repeated?")


def _displaced(tokens: list[bytes], seed: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Hash, bucket and displace: large buckets first, single keys straight into free slots."""
    n = len(tokens)
    hashes = [xxhash.xxh3_64_intdigest(t, seed) for t in tokens]
    buckets: list[list[int]] = [[] for _ in range(n // 4 + 1)]
    for i, h in enumerate(hashes):
        buckets[h % len(buckets)].append(i)
    displacement, slots = np.zeros(len(buckets), np.int64), np.full(n, -1, np.int64)
    taken = bytearray(n)
    free = n
    for b in sorted(range(len(buckets)), key=lambda b: -len(buckets[b])):
        keys = buckets[b]
        if len(keys) < 2:
            for key in keys:
                free = taken.rfind(0, 0, free)
                taken[free], slots[free], displacement[b] = 1, key, -free - 1
            continue
        for d in range(MAX_TRIES):
            places = {_slot(hashes[k], d, n) for k in keys}
            if len(places) == len(keys) and not any(taken[p] for p in places):
                break
        else:
            return None
        displacement[b] = d
        for key in keys:
            place = _slot(hashes[key], d, n)
            taken[place], slots[place] = 1, key
    return displacement, slots


class _Encoder(dict):
    """Pre-token to the packed ids of its tokens; unseen pre-tokens are resolved on demand."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.pairs = dict(zip(vocabulary.pairs.tolist(), vocabulary.merged.tolist()))
        self.bytes = [vocabulary.find(bytes([b])) for b in range(256)]
        self.split = regex.compile(vocabulary.pattern)

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        whole = self.vocabulary.find(raw)
        packed = (array("I", [whole]) if whole >= 0 else self.merge(raw)).tobytes()
        if len(raw) <= 64:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = packed
        return packed

    def merge(self, raw: bytes) -> array:
        """Ids of the tokens that merging leaves."""
        get, size, n = self.pairs.get, len(self.vocabulary.tokens), len(raw)
        ids = list(map(self.bytes.__getitem__, raw))  # -1 once a symbol is merged into its left neighbour
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        shift = n.bit_length()
        place = (1 << shift) - 1
        # the rank, then the place of the left symbol, in one number
        heap = [r << shift | i for i in range(n - 1) if (r := get(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            rank, at = entry >> shift, entry & place
            right = after[at]
            if ids[at] < 0 or right >= n or get(ids[at] * size + ids[right]) != rank:
                continue  # one of the two symbols has changed since
            ids[at], ids[right] = rank, -1
            after[at] = beyond = after[right]
            if beyond < n:
                before[beyond] = at
                if (r := get(rank * size + ids[beyond])) is not None:
                    heapq.heappush(heap, r << shift | at)
            left = before[at]
            if left >= 0 and (r := get(ids[left] * size + rank)) is not None:
                heapq.heappush(heap, r << shift | left)
        return array("I", [i for i in ids if i >= 0])

    def encode(self, text: str) -> bytes:
        if len(text) <= PIECE_BYTES:
            return b"".join(map(self.__getitem__, self.split.findall(text)))
        found, out = (m[0] for m in self.split.finditer(text)), bytearray()
        while some := list(islice(found, 100_000)):
            out += b"".join(map(self.__getitem__, some))
        return bytes(out)


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns plus ``ids`` (``array<int>``) of every whole text."""
    if text != "ids":
        df = set_aside(df, ["ids"])
    shared = df.sparkSession.sparkContext.broadcast(astuple(vocabulary))
    keep = [c for c in df.columns if c != text] if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(Vocabulary(*shared.value))
        for piece in pieces(batches, text):
            packed = [encoder.encode(t or "") for t in piece.column(text).to_pylist()]
            ends = np.cumsum([0] + [len(p) // 4 for p in packed]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32))
            ids = pa.ListArray.from_arrays(pa.array(ends), values)
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), ids], names=[*keep, "ids"])

    schema = schema_of(df, keep, "ids array<int>")
    return df.select(*keep, *[text] * (text not in keep)).mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns plus ``decoded`` (bytes) of every id list; null ids decode to nothing."""
    df = set_aside(df, ["decoded"])
    shared = df.sparkSession.sparkContext.broadcast(astuple(vocabulary))
    keep = [c for c in df.columns if c != ids] if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = shared.value[0].__getitem__
        for batch in batches:
            decoded = [b"".join(map(token, row or ())) for row in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(decoded, pa.binary())], names=[*keep, "decoded"]
            )

    schema = schema_of(df, keep, "decoded binary")
    return df.select(*keep, *[ids] * (ids not in keep)).mapInArrow(run, schema)


def encode_packed(
    df: DataFrame, vocabulary: Vocabulary, text: str = "text", id_col: str = "doc_id", keep: list[str] | None = None
) -> DataFrame:
    """``(id, packed, decoded)`` in one pass, or ``keep`` columns in place of the id: ids as little-endian
    unsigned 32-bit integers, the layout of token files, and the bytes that those ids decode to."""
    shared = df.sparkSession.sparkContext.broadcast(astuple(vocabulary))
    keep = [id_col] if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(Vocabulary(*shared.value))
        token = shared.value[0].__getitem__
        for piece in pieces(batches, text):
            packed = [encoder.encode(t or "") for t in piece.column(text).to_pylist()]
            decoded = [b"".join(map(token, np.frombuffer(p, "<u4").tolist())) for p in packed]
            yield pa.RecordBatch.from_arrays(
                [*(piece.column(c) for c in keep), pa.array(packed, pa.binary()), pa.array(decoded, pa.binary())],
                names=[*keep, "packed", "decoded"],
            )

    schema = schema_of(df, keep, "packed binary, decoded binary")
    return df.select(*keep, *[text] * (text not in keep)).mapInArrow(run, schema)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Token counts and SHA-256 digests of :func:`encode_packed` rows."""
    return encoded.select(
        id_col,
        (F.length("packed") / 4).cast("long").alias("n_tokens"),
        F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

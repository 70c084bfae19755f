"""Personal data by bootstrapped contextual extraction.

Base rules find e-mail addresses, IP addresses, card and phone numbers.  They are the
seeds.  Every token that looks like an identifier (``MIN_DIGITS`` digits or more, or an ``@``),
and every maximal run of digit groups parted by blanks, hyphens, dots or brackets, seed
or not, is recorded with its lexical patterns: the two words before it, and the word
before it with the word after it.  Tokens of punctuation are passed on the way to the
word before; if no word stands before, the two words after it are the pattern.  Patterns
and instances (normalised tokens) form a bipartite graph that Spark scores in rounds:

* a pattern's confidence for a kind weighs its distinct instances that belong to the kind, each by its
  score, against its seeds of other kinds; an instance of which nothing is known counts against it
  only by ``unknown``, as it may well be what is looked for;
* an instance's score is the noisy-or of its confident patterns; seeds keep 1.

Patterns that at least ``min_seeds`` distinct instances support, seeds or high-scored
ones, and that reach ``min_confidence`` label the other identifiers standing in them.  So each
generation of instances can make new patterns confident, and these find the next.  An instance that
is found, if it has ``telling`` digits or more or an ``@``, is labelled wherever it stands.
Scores only rise from round to round; the loop ends when they stand still.  Texts are
read once; the graph holds only identifier-like tokens, and all scoring is joins and sums.

Edge cases: a null text counts as empty; very long texts are handled line by line;
repeated rows yield equal rows; rows with equal id but different text stay apart by a
hash of the text; an empty table gives an empty result; other columns are ignored, whatever they are
called, and kept by :func:`redact`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.loop import RoundLimitReached, checkpoint, checkpoint_counted
from .text import BROADCAST_BYTES, pieces, schema_of

#: The kinds, in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
#: Every digit run is consumed whole, so that a long one is looked at once.
_IP = re.compile(r"[0-9]++(?:(\.[0-9]++)(\.[0-9]++)(\.[0-9]++))?")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TELLING = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
_DIGITS = re.compile(r"[0-9]")
_GROUP = re.compile(r"[+().-]*[0-9][0-9().-]*")
_TRIM = "\"'`.,;:!?()[]{}<>=|*#$%&"


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(line: str) -> Iterator[tuple[int, int]]:
    done, at = 0, line.find("@")
    while at >= 0:
        before = line[done:at]
        start = done + len(before.rstrip(_LOCAL))
        if start < at and (m := _DOMAIN.match(line, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = line.find("@", done)


def base_spans(line: str) -> list[tuple[int, int, int]]:
    """``(kind number, start, end)`` of the base rules; matches never cross a line end."""
    spans = [(0, a, b) for a, b in _emails(line)]
    for m in _IP.finditer(line):
        if m[3] and all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            spans.append((1, m.start(), m.end()))
    for m in _CARD.finditer(line):
        if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(d):
            spans.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(line):
        if 8 <= len(_DIGITS.findall(m[0])) <= 15:
            spans.append((3, m.start(), m.end()))
    return spans


#: Digits that make a token, or a run of digit groups, look like an identifier.
MIN_DIGITS = 4


def _runs(line: str, tokens: list[tuple[int, int]], free: list[bool], min_digits: int) -> dict[int, int]:
    """First and last token of every run of two or more digit groups with so many digits or more."""
    out, k = {}, 0
    while k < len(tokens):
        last, digits = k - 1, 0
        while last + 1 < len(tokens) and free[last + 1]:
            word = line[slice(*tokens[last + 1])].strip("\"'`,;:!?[]{}<>=|*#$%&" if last < k else "")
            bare = word.rstrip(_TRIM)
            if not _GROUP.fullmatch(bare) or last >= k and line[tokens[last][1] : tokens[last + 1][0]].strip(" "):
                break
            last, digits = last + 1, digits + len(_DIGITS.findall(bare))
            if line[tokens[last][1] - 1] not in "0123456789)-.":
                break  # a comma or the like ends the run
        if last > k and digits >= min_digits:
            out[k] = last
        k = max(last, k) + 1
    return out


def _identifiers(line: str, spans: list[tuple[int, int, int]], min_digits: int = MIN_DIGITS) -> list[tuple[int, int, int, str, list[str]]]:
    """``(kind or -1, start, end, instance, patterns)`` of seeds, identifier-like tokens and runs of digit groups."""
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(line)]
    words = [line[a:b].strip(_TRIM).lower() for a, b in tokens]
    clean = lambda k: words[k] if 0 <= k < len(tokens) else ""
    before, free = [-1], []  # the last word before each token; tokens outside the seeds
    taken, at = sorted((a, b, kind) for kind, a, b in spans), 0
    seeds: list[tuple[int, int, int] | None] = []
    for k, (a, b) in enumerate(tokens):
        before.append(k if words[k] else before[k])
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        seeds.append(taken[at] if at < len(taken) and taken[at][0] < b else None)
        free.append(seeds[k] is None)
    runs = _runs(line, tokens, free, min_digits)

    def patterns(k: int, end: int) -> list[str]:
        after = k + 1
        while after < len(tokens) and tokens[after][0] < end:
            after += 1
        w0, w1 = clean(after), clean(before[k])
        if w1:
            return [f"{clean(before[k] - 1)} {w1} _", f"{w1} _ {w0}"]
        return [f"_ {w0} {clean(after + 1)}"] if w0 else []

    out = []
    for k, (a, b) in enumerate(tokens):
        if seeds[k]:
            start, end, kind = seeds[k]
            if start < a:
                continue  # a later token of a seed of several words
            out.append((kind, start, end, line[start:end].lower(), patterns(k, end)))
            continue
        if k in runs:
            left, right = tokens[k][0], tokens[runs[k]][1]
            whole = line[left:right]
            left += len(whole) - len(whole.lstrip(_TRIM.replace("(", "")))
            right -= len(whole) - len(whole.rstrip(_TRIM))
            out.append((-1, left, right, line[left:right].lower(), patterns(k, right)))
        word = line[a:b]
        start = a + len(word) - len(word.lstrip(_TRIM))
        end = b - len(word) + len(word.rstrip(_TRIM))
        if start >= end or "@" not in word and len(_DIGITS.findall(word)) < min_digits:
            continue
        # What stands before a run is the run's, not its first token's.
        out.append((-1, start, end, line[start:end].lower(), patterns(k, end)[1 if k in runs else 0 :]))
    return out


_MENTION = "array<struct<kind:int,start:int,stop:int,instance:string,patterns:array<string>>>"
_MENTION_ARROW = pa.list_(
    pa.struct(
        [
            ("kind", pa.int32()),
            ("start", pa.int32()),
            ("stop", pa.int32()),
            ("instance", pa.string()),
            ("patterns", pa.list_(pa.string())),
        ]
    )
)
_SPANS = "array<struct<kind:int,start:int,stop:int>>"
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())]))


def mentions(df: DataFrame, id_col: str = "doc_id", text: str = "text", min_digits: int = MIN_DIGITS) -> DataFrame:
    """``(id, text_hash, base, mentions)``: base spans and the graph's raw material."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text):
            base, found = [], []
            for content in piece.column(text).to_pylist():
                spans, marks, offset = [], [], 0
                if content and _TELLING.search(content):
                    for line in content.split("\n"):
                        if _TELLING.search(line):
                            own = base_spans(line)
                            spans += [(k, a + offset, b + offset) for k, a, b in own]
                            marks += [(k, a + offset, b + offset, *m) for k, a, b, *m in _identifiers(line, own, min_digits)]
                        offset += len(line) + 1
                base.append([dict(zip(("kind", "start", "stop"), s)) for s in sorted(spans)])
                found.append([dict(zip(("kind", "start", "stop", "instance", "patterns"), m)) for m in marks])
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column(id_col),
                    piece.column("__hash"),
                    pa.array(base, _SPANS_ARROW),
                    pa.array(found, _MENTION_ARROW),
                ],
                names=[id_col, "text_hash", "base", "mentions"],
            )

    schema = schema_of(df, [id_col], f"text_hash long, base {_SPANS}, mentions {_MENTION}")
    return df.select(id_col, text, F.xxhash64(text).alias("__hash")).mapInArrow(run, schema)


def bootstrap(
    found: DataFrame,
    rounds: int = 50,
    min_seeds: int = 3,
    min_confidence: float = 0.8,
    smoothing: float = 0.5,
    unknown: float = 0.1,
) -> tuple[DataFrame, DataFrame]:
    """``(pattern, kind, confidence)`` of the patterns that may label unseen identifiers, and
    ``(instance, kind, score)`` of the instances that they speak for."""
    links = checkpoint(
        found.select(F.explode("mentions").alias("m"))
        .select(F.explode("m.patterns").alias("pattern"), F.xxhash64("m.instance").alias("instance"), "m.kind")
        .groupBy("pattern", "instance")
        .agg(F.max("kind").alias("seed"))
    )
    # Patterns with too few instances can never label and drop out of the graph here.
    sizes = links.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("seed") >= 0).alias("seeds"))
    sizes = checkpoint(sizes.where(F.col("n") >= min_seeds))
    graph = checkpoint(links.join(sizes.select("pattern"), "pattern"))
    seeds = checkpoint(links.where("seed >= 0").select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct())
    of_kind = checkpoint(graph.where("seed >= 0").groupBy("pattern", F.col("seed").alias("kind")).agg(F.count(F.lit(1)).alias("own")))
    known, votes, last = seeds, seeds.where("false"), None
    for _ in range(rounds):
        others = F.col("seeds") - F.coalesce("own", F.lit(0))
        against = others + unknown * F.greatest(F.col("n") - F.col("hits") - others, F.lit(0.0)) + smoothing
        confidence = (
            graph.join(known, "instance")
            .groupBy("pattern", "kind")
            .agg(F.sum("score").alias("hits"), F.count_if(F.col("score") >= min_confidence).alias("support"))
            .where(F.col("support") >= min_seeds)
            .join(sizes, "pattern")
            .join(of_kind, ["pattern", "kind"], "left")
            .select("pattern", "kind", (F.col("hits") / (F.col("hits") + against)).alias("confidence"))
            .where(F.col("confidence") >= min_confidence)
        )
        confidence, seen = checkpoint_counted(confidence, n=F.count(F.lit(1)), total=F.coalesce(F.sum("confidence"), F.lit(0.0)))
        still = last and seen["n"] == last["n"] and seen["total"] - last["total"] < 1e-6
        if still or not seen["n"]:
            return confidence, votes.where(F.col("score") >= min_confidence)
        last = seen
        unsure = F.greatest(F.lit(1.0) - F.col("confidence"), F.lit(1e-9))
        votes = checkpoint(
            graph.where("seed < 0")
            .join(confidence, "pattern")
            .groupBy("instance", "kind")
            .agg((1 - F.exp(F.sum(F.log(unsure)))).alias("score"))
        )
        known = seeds.unionByName(votes).groupBy("instance", "kind").agg(F.max("score").alias("score"))
    raise RoundLimitReached(f"pattern scores still rise after {rounds} rounds")


def extract(df: DataFrame, id_col: str = "doc_id", text: str = "text", min_digits: int = MIN_DIGITS, **options) -> DataFrame:
    """``(id, text_hash, base, added)`` of every row: base spans and those that patterns add.

    An added span has the kind of its most confident pattern, overlaps no base span and lies
    in no other added span.
    """
    found = checkpoint(mentions(df, id_col, text, min_digits))
    return found.join(
        _added(found, id_col, **options),
        F.col(id_col).eqNullSafe(F.col("__id")) & F.col("text_hash").eqNullSafe(F.col("__hash")),
        "left",
    ).select(id_col, "text_hash", "base", F.coalesce("added", F.array().cast(_SPANS)).alias("added"))


def _added(found: DataFrame, id_col: str, telling: int = 7, **options) -> DataFrame:
    """``(__id, __hash, added)`` for the texts to which patterns and found instances add spans."""
    patterns, instances = bootstrap(found, **options)
    mark = ["__id", "__hash", "start", "stop"]
    marks = (
        found.select(F.col(id_col).alias("__id"), F.col("text_hash").alias("__hash"), F.explode("mentions").alias("m"))
        .where("m.kind < 0")
        .select("__id", "__hash", "m.*")
    )
    placed = marks.select(*mark, F.explode("patterns").alias("pattern")).join(patterns, "pattern")
    specific = F.col("instance").contains("@") | (F.length(F.regexp_replace("instance", "[^0-9]", "")) >= telling)
    named = marks.where(specific).select(*mark, F.xxhash64("instance").alias("instance")).join(instances, "instance")
    labelled = placed.select(*mark, "kind", "confidence").union(named.select(*mark, "kind", "score"))
    best = labelled.groupBy(*mark).agg(F.max(F.struct("confidence", -F.col("kind"))).alias("best"))
    # by start, longer ones first, a span lies in an earlier one if any of these ends where it does or later
    order = W.partitionBy("__id", "__hash").orderBy("start", F.desc("stop")).rowsBetween(W.unboundedPreceding, -1)
    outer = best.withColumn("reached", F.max("stop").over(order)).where("reached IS NULL OR reached < stop")
    span = F.struct((-F.col("best.col2")).cast("int").alias("kind"), "start", "stop")
    return checkpoint(outer.groupBy("__id", "__hash").agg(F.sort_array(F.collect_set(span)).alias("added")))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digest of the base spans; all spans as ``kind:start:end`` by kind and start."""
    names = F.array(*[F.lit(k) for k in KINDS])
    listed = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["stop"])), ","
    )
    counts = [
        F.expr(f"cast(size(filter(base, s -> s.kind = {k})) AS bigint)").alias(f"n_{name}") for k, name in enumerate(KINDS)
    ]
    return found.select(
        id_col,
        *counts,
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.sort_array(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def redact(df: DataFrame, id_col: str = "doc_id", text: str = "text", min_digits: int = MIN_DIGITS, **options) -> DataFrame:
    """``df`` with every span replaced by its kind in brackets, as ``[EMAIL]``.

    Overlapping spans become one replacement, named by the first.  Base spans are
    found again in the pass that rewrites the texts; only texts with added spans are
    joined with them.  Other columns stay as they are; a null text stays null.
    """
    found = checkpoint(mentions(df, id_col, text, min_digits))
    added = _added(found, id_col, **options)
    keys = F.col(id_col).eqNullSafe(F.col("__id")) & F.xxhash64(text).eqNullSafe(F.col("__hash"))
    names = df.columns
    held = added.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("added")), F.lit(0))).first()
    if held[0] * 64 + held[1] * 24 <= BROADCAST_BYTES:
        added = F.broadcast(added)
    joined = df.join(added.withColumnRenamed("added", "__added"), keys, "left").select(*names, "__added")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text):
            cleaned = [
                _redacted(content, more) for content, more in zip(piece.column(text).to_pylist(), piece.column("__added").to_pylist())
            ]
            at = piece.schema.get_field_index(text)
            piece = piece.set_column(at, text, pa.array(cleaned, pa.string()))
            yield piece.select(names)

    return joined.mapInArrow(run, df.schema)


def _redacted(content: str | None, added: list[dict] | None) -> str | None:
    if not content or not added and not _TELLING.search(content):
        return content
    spans, offset = [(s["start"], s["stop"], s["kind"]) for s in added or ()], 0
    for line in content.split("\n"):
        if _TELLING.search(line):
            spans += [(a + offset, b + offset, k) for k, a, b in base_spans(line)]
        offset += len(line) + 1
    out, done = [], 0
    for start, end, kind in sorted(spans):
        if start >= done:
            out += [content[done:start], f"[{KINDS[kind].upper()}]"]
        done = max(done, end)
    return "".join(out) + content[done:]

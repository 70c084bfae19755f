"""Every text operator on very long texts, clashing columns and repeated rows; methods against plain versions."""

import itertools
import math
import os
import random
import re
import subprocess
import sys
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinweave.llm import bpe, chat, decontaminate, langid, licenses, oracles, pii, quality, queries, sharding, simhash, substrings
from kinweave.llm.text import PIECE_BYTES, plain_words, slices

from ..conftest import ROOT
from . import brute
from .test_operators import ODD, corpus, frame, plain_rows, reference, same, vocabulary  # noqa: F401


def prose(draw, n, letters="abcdefghij"):
    return " ".join("".join(draw.choice(letters) for _ in range(draw.randint(3, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def long_rows():
    draw = random.Random(20)
    text = prose(draw, 680_000)
    assert len(text) > PIECE_BYTES
    words = text.split()
    tail = " under the MIT license mail a.b@c.de 1.2.3.4\nsame line here\nsame line here"
    return [(5, text + tail), (9, " ".join(words[400_000:400_300]) + " end"), (2, " ".join(words[10:90])), (3, prose(draw, 60)), (4, None)]


def test_long_text_licences(spark, long_rows):
    found = licenses.digest(licenses.scan(frame(spark, long_rows)))
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    same(found.select(*columns), [(d, *brute.license_base(t)) for d, t in long_rows])


def test_long_text_substrings(spark, long_rows):
    same(substrings.digest(substrings.remove_duplicates(frame(spark, long_rows))), brute.substrings(long_rows))


def test_long_text_pii_and_quality(spark, long_rows):
    df = frame(spark, long_rows)
    spans = {r.doc_id: r.spans for r in pii.digest(pii.extract(df)).collect()}
    assert spans == {d: ",".join(brute.pii_base(t)) for d, t in long_rows}
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    same(quality.judge(df).select(*columns), [(d, *brute.quality(t)) for d, t in long_rows])


def test_long_text_leaks_and_prints(spark, long_rows):
    df = frame(spark, long_rows)
    items = [(1, " ".join(long_rows[0][1].split()[500_000:500_030])), (2, "same line here")]
    found = decontaminate.find_items(df, spark.createDataFrame(items, "item_id long, text string"))
    same(decontaminate.digest(found), brute.leaks(long_rows, items))
    prints = {r.doc_id: r.fp % (1 << 64) for r in simhash.fingerprints(df).collect()}
    assert prints == {d: brute.simhash(t) for d, t in long_rows}


def test_long_text_tokens(spark, long_rows, vocabulary, reference):  # noqa: F811
    found = {r.doc_id: r for r in bpe.encode_packed(frame(spark, long_rows), vocabulary).collect()}
    for d, t in long_rows:
        assert np.frombuffer(bytes(found[d].packed), "<u4").tolist() == reference.encode_ordinary(t or "")
        assert bytes(found[d].decoded).decode() == (t or "")


def test_long_text_language_chat_shards(spark, long_rows):
    df = frame(spark, long_rows)
    model = langid.fit(df)
    assert {r.doc_id: r.lang_pred for r in langid.predict(df, model).collect()} == {d: "en" if t else "und" for d, t in long_rows}
    talk = spark.createDataFrame([(1, 0, "user", long_rows[0][1]), (1, 1, "assistant", long_rows[1][1])], "conv_id long, turn long, role string, text string")
    read = chat.read_back(chat.format_conversations(talk)).first()
    assert (read.n_turns, read.loss_chars, read.loss_sha256) == (2, len(long_rows[1][1]), brute.sha(long_rows[1][1]))
    same(sharding.assign(df.select("doc_id", "text"), 2).select("doc_id", "text"), long_rows)


def test_slices():
    for text in ("", "a", "ab cd\nef gh", "x" * 50, "aa  bb\n\ncc " * 20):
        for size in (1, 3, 7, 1000):
            parts = list(slices(text, size))
            assert "".join(parts) == text and [w for p in parts for w in p.split()] == text.split()
            assert b"".join(slices(text.encode(), size)) == text.encode()


CLASH = ["n_words", "matches", "text_hash", "base", "mentions", "spans", "added", "kept", "digest", "starts", "sizes", "hits", "items"]
CLASH += ["ids", "packed", "decoded", "lang_pred", "score", "removed", "shard", "slot", "fp", "group", "component_id", "host", "line"]


def test_clashing_columns(spark, vocabulary):  # noqa: F811
    rows = corpus(11, 40)
    plain = frame(spark, rows).select("doc_id", "text", "source", "lang")
    wide = plain.select("*", *[F.lit(f"given {c}").alias(c) for c in CLASH])
    bench = spark.createDataFrame([(1, rows[0][1])], "item_id long, text string")
    model = langid.fit(plain)
    assert langid.fit(wide).tables[0].values.tolist() == model.tables[0].values.tolist()
    for run in (
        lambda df: licenses.scan(df),
        lambda df: pii.extract(df),
        lambda df: substrings.remove_duplicates(df),
        lambda df: decontaminate.find_items(df, bench),
        lambda df: bpe.encode_packed(df, vocabulary),
        lambda df: langid.predict(df, model),
        lambda df: quality.judge(df, keep_text=True),
        lambda df: simhash.near_duplicates(df),
    ):
        assert plain_rows(run(wide)) == plain_rows(run(plain))
    for run in (
        lambda df: pii.redact(df),
        lambda df: decontaminate.drop_contaminated(df, bench),
        lambda df: langid.keep_identified(df, model),
        lambda df: simhash.keep_one(df),
    ):
        out = run(wide)
        assert out.columns == wide.columns and plain_rows(out.select("doc_id", "text")) == plain_rows(run(plain).select("doc_id", "text"))
    given = sharding.assign(wide, 3)
    assert {(r.shard_given, r.slot_given) for r in given.collect()} == {("given shard", "given slot")} and given.columns[-2:] == ["shard", "slot"]
    encoded = bpe.encode(wide, vocabulary)
    assert {r.ids_given for r in encoded.collect()} == {"given ids"}
    assert {(r.ids_given, r.decoded_given) for r in bpe.decode(encoded, vocabulary).collect()} == {("given ids", "given decoded")}


def thue_morse(n, a, b):
    out, other = a, b
    while len(out) < n:
        out, other = out + other, other + out
    return out


def test_substrings_tell_words_of_one_polynomial_hash_apart(spark):
    """Thue-Morse words and their complements, for which sums of powers modulo 2^64 agree."""
    one, two = thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")
    same_start = [f"w{i}" for i in range(30)]
    rows = [(k, " ".join([*same_start, w, *(f"v{i}" for i in range(60))])) for k, w in enumerate((one, two, one))]
    lists = [thue_morse(512, ["a"], ["b"]), thue_morse(512, ["b"], ["a"])]
    rows += [(10 + k, " ".join(w)) for k, w in enumerate(lists)]
    expected = brute.substrings(rows)
    assert expected[1][2] == 60 and expected[2][2] == 91
    same(substrings.digest(substrings.remove_duplicates(frame(spark, rows))), expected)


def test_factors(spark):
    """A document of two passages from two earlier ones has two factors that name them, and their words are there."""
    draw = random.Random(30)
    a, b, c = (prose(draw, n).split() for n in (300, 300, 40))
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c[:20] + a[50:250] + b[100:220] + c[20:])), (4, " ".join(a[10:60]))]
    _, found = substrings.factors(frame(spark, rows))
    found = {r.asDict()["__id"]: r for r in found.collect()}
    assert set(found) == {3, 4}
    three = list(zip(found[3].starts, found[3].sizes, found[3].refs, found[3].ref_starts))
    assert three == [(20, 151, 1, 50), (220, 71, 2, 100)]
    words = {d: t.split() for d, t in rows}
    for doc, r in found.items():
        for start, size, ref, at in zip(r.starts, r.sizes, r.refs, r.ref_starts):
            assert words[doc][start : start + size + 49] == words[ref][at : at + size + 49]


def test_parse():
    matches = [(0, 5, 1, 10), (3, 4, 1, 13), (7, 1, 1, 17), (8, 1, 2, 8), (8, 3, 2, 8), (20, 1, 1, 30)]
    assert substrings.parse(matches) == [[0, 8, 1, 10], [8, 3, 2, 8], [20, 1, 1, 30]]


@pytest.mark.parametrize("n", [1, 33, 100])
def test_chat_spans_in_the_final_output(n):
    messages = [(["user", "assistant"][i % 2], f"text {i}") for i in range(n)]
    last = n - 1
    strips = lambda ms: "".join(f"[{r}]{t if r == 'user' or i + 1 == len(ms) else '-'};" for i, (r, t) in enumerate(ms))
    numbers = lambda ms: "".join(f"<{i} of {len(ms)} {r}>{t};" for i, (r, t) in enumerate(ms))
    hides = lambda ms: "".join(f"[{r}]{t if not 34 <= len(ms) <= 60 or i > 5 else '?'};" for i, (r, t) in enumerate(ms))
    for render, rewrites, there in (
        (chat.chatml, False, lambda i: True),
        (strips, n > 2, lambda i: i % 2 == 0 or i == last),
        (numbers, n > 1, lambda i: True),
        (hides, n > 33, lambda i: True),
    ):
        whole, spans, texts, found = chat.turn_spans(messages, render)
        assert whole == render(messages) and found == rewrites
        assert [whole[s[0] : s[1]] if s else None for s in texts] == [t if there(i) else None for i, (_, t) in enumerate(messages)]
        assert (spans == []) == found
        if spans:
            assert "".join(whole[a:b] for a, b in spans) == whole and len(spans) == n


def test_chat_loss_of_rewriting_templates(spark):
    strips = lambda ms: "".join(f"[{r}]{t if i + 1 == len(ms) or r == 'user' else '-'};" for i, (r, t) in enumerate(ms))
    rows = [(1, i, ["user", "assistant"][i % 2], f"turn {i}") for i in range(6)] + [(None, 0, "assistant", "a"), (None, 0, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = sorted(chat.format_conversations(df, strips).collect(), key=lambda r: r.formatted)
    assert [r.formatted for r in found] == ["[assistant]a;", "[assistant]b;", found[2].formatted]
    assert [r.formatted[a:b] for r in found for a, b in zip(r.loss[::2], r.loss[1::2])] == ["a", "b", "turn 5"]
    assert [r.rewrites for r in found] == [False, False, True] and found[2].spans == []


def plain_language(texts, labels):
    """Word-first backoff with dictionaries: a function from a text to its language and score."""
    find = re.compile(r"[^\W\d_]+").findall
    words, grams = defaultdict(Counter), defaultdict(Counter)
    for text, label in zip(texts, labels):
        words[label].update(find(text.lower()))
    for label, counts in words.items():
        for w, n in counts.items():
            m = f"^{w}$"
            for k in range(1, 5):
                for i in range(len(m) - k + 1):
                    grams[label, k][m[i : i + k]] += n
    languages = sorted(words)
    known = {w for c in words.values() for w in c}

    def log(counts, value):
        return math.log((counts[value] + 0.1) / (1 + sum(counts.values())))

    def values(word):
        if word in known:
            return [log(words[k], word) for k in languages]
        m = f"^{word}$"
        for k in range(4, 0, -1):
            have = [g for i in range(len(m) - k + 1) if any((g := m[i : i + k]) in grams[x, k] for x in languages)]
            if have:
                return [sum(log(grams[x, k], g) for g in have) / len(have) for x in languages]
        return [0.0] * len(languages)

    def predict(text):
        found = find((text or "").lower())
        if not any(c.isalpha() for w in found for c in w):
            return "und", 0.0
        means = np.mean([values(w) for w in found], axis=0)
        return languages[int(np.argmax(means))], float(1 / np.exp(means - means.max()).sum())

    return predict


def test_language_against_a_plain_version(spark):
    draw = random.Random(40)
    rows = [(i, prose(draw, draw.randint(1, 12), letters), label) for i in range(90) for letters, label in [[("abcdef", "aa"), ("defghi", "bb"), ("acegik", "cc")][i % 3]]]
    rows += [(90, None, "aa"), (91, "12 34", "bb"), (92, "zzz yyy", None), (93, "漢字 abc", "cc"), (93, "漢字 abc", "cc")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learnt = [(t, k) for d, t, k in rows if t is not None and k is not None and zlib.crc32(str(d).encode()) % 5]
    predict = plain_language(*zip(*learnt))
    model = langid.fit(df.where(~queries.held_out()))
    found = langid.predict(df, model).collect()
    expected = {d: predict(t) for d, t, _ in rows}
    for r in found:
        assert r.lang_pred == expected[r.doc_id][0] and abs(r.score - expected[r.doc_id][1]) < 1e-4
    scores = sorted(s for _, s in expected.values())
    bar = (scores[len(scores) // 2] + scores[len(scores) // 2 + 1]) / 2
    kept = sorted(r.doc_id for r in langid.keep_identified(df, model, margin=(bar - 1 / 3) / (2 / 3)).collect())
    assert kept == sorted(d for d, _, _ in rows if expected[d][1] >= bar) and 0 < len(kept) < len(rows)


def test_language_keeps_small_languages_and_repeated_ids(spark):
    draw = random.Random(41)
    rows = [(i, prose(draw, 200), "big") for i in range(400)] + [(1000 + i, prose(draw, 20, "klmnop"), "small") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit(df, max_rows=60).languages == ["big", "small"]
    one = spark.createDataFrame([(7, prose(draw, 20), "big") for _ in range(50)], "doc_id long, text string, lang string")
    assert 1 <= langid.sample(one, "doc_id", "text", "lang", 25, 1 << 30).count() < 50
    assert langid.sample(df, "doc_id", "text", "lang", 10**6, 100_000).count() < 400
    many = spark.range(1200).selectExpr("id AS doc_id", "'a' AS text", "cast(id AS string) AS lang")
    with pytest.raises(ValueError):
        langid.fit(many)


def plain_matches(words, counts):
    """Licence matches by trying every start of every template."""
    rows = counts[b""]
    weigh = lambda w: math.log((1 + rows) / (1 + counts.get(w, 0))) + 1e-6
    found = []
    for t in licenses.templates():
        rare = sorted(set(t.words), key=lambda w: (-weigh(w), w))[: licenses.RAREST]
        bar, total = licenses.BAR * sum(map(weigh, rare)), sum(map(weigh, t.words))
        starts = Counter()
        for i, w in enumerate(words):
            starts.update(i - k for k, x in enumerate(t.words) if x == w and w in rare)
        done = None
        for low in sorted(starts):
            near = [s for s in starts if low <= s <= low + t.slack]
            agree = {x for s in near for k, x in enumerate(t.words) if x in rare and 0 <= s + k < len(words) and words[s + k] == x}
            if sum(map(weigh, agree)) < bar - 1e-9 or done is not None and low <= done:
                continue
            heights = {s: sum(weigh(x) for k, x in enumerate(t.words) if x in rare and 0 <= s + k < len(words) and words[s + k] == x) for s in near}
            start = min(near, key=lambda s: (-round(heights[s], 9), s))
            stands = lambda o, key: any(
                tuple(words[p : p + len(key)]) == key for p in range(max(0, start + o - t.slack), start + o + t.slack + 1)  # noqa: B023
            )
            if not all(stands(o, key) for o, key in t.keys):
                continue
            a, b = max(0, start), min(len(words), start + len(t.words))
            there = Counter(words[max(0, a - t.slack) : b + t.slack]) & Counter(t.words)
            weight = sum(weigh(w) * n for w, n in there.items())
            if weight / total >= licenses.BAR:
                found.append((weight, t.label, a, b, min(1.0, weight / total)))
                done = start + t.slack
    kept = []
    for m in sorted(found, key=lambda m: (-m[0] * m[4], m[2], m[1])):
        if not any(2 * (min(m[3], o[3]) - max(m[2], o[2])) >= m[3] - m[2] for o in kept):
            kept.append(m)
    return kept


def test_licence_labels_and_scores_against_a_plain_version(spark):
    draw = random.Random(50)
    texts = [t for t, _ in licenses.TEMPLATES.values()]
    rows = [(1, "\n".join(texts)), (2, "some mit license here")]
    for i in range(3, 40):
        parts = []
        for _ in range(draw.randint(0, 3)):
            w = draw.choice(texts).split()
            for _ in range(draw.randint(0, 6)):
                w[draw.randrange(len(w))] = draw.choice(["", "changed", "the of", "software"])
            parts += [" ".join(w[draw.randint(0, 5) :]), prose(draw, 15)]
        rows.append((i, " ".join(parts)))
    df = frame(spark, rows)
    counts = licenses.frequencies(df)
    labels = set()
    for r in licenses.digest(licenses.scan(df)).collect():
        text = dict(rows)[r.doc_id]
        matches, base = plain_matches(plain_words(text.encode()), counts), brute.license_base(text)
        names = {m[1] for m in matches} | set(filter(None, base[-1].split(",")))
        assert r.labels == ",".join(sorted(names)), r.doc_id
        assert abs(r.score - max([m[4] for m in matches] + [1.0] * (base[1] > 0), default=0.0)) < 1e-9
        labels |= names
    assert len(labels) > 12


def plain_added(mentions, rounds=50, telling=7):
    """Added spans by scoring the graph of patterns and instances with dictionaries."""
    links = {}
    for marks in mentions.values():
        for kind, _, _, instance, patterns in marks:
            for p in patterns:
                links[p, instance] = max(kind, links.get((p, instance), -1))
    by_pattern = defaultdict(list)
    for (p, instance), seed in links.items():
        by_pattern[p].append((instance, seed))
    seeds = {(i, k): 1.0 for (_, i), k in links.items() if k >= 0}
    known, votes = dict(seeds), {}
    for _ in range(rounds):
        confident = {}
        for p, held in by_pattern.items():
            if len(held) < 3:
                continue
            for kind in range(4):
                scores = [known[i, kind] for i, _ in held if (i, kind) in known]
                if sum(s >= 0.8 for s in scores) < 3:
                    continue
                others = sum(s >= 0 and s != kind for _, s in held)
                hits = sum(scores)
                value = hits / (hits + others + 0.1 * max(0, len(held) - hits - others) + 0.5)
                if value >= 0.8:
                    confident[p, kind] = value
        votes = defaultdict(lambda: 1.0)
        for (p, kind), value in confident.items():
            for i, seed in by_pattern[p]:
                if seed < 0:
                    votes[i, kind] *= max(1 - value, 1e-9)
        votes = {k: 1 - v for k, v in votes.items()}
        known = {k: max(seeds.get(k, 0), votes.get(k, 0)) for k in {*seeds, *votes}}
    out = {}
    for doc, marks in mentions.items():
        best = {}
        for kind, start, stop, instance, patterns in marks:
            if kind >= 0:
                continue
            said = [(v, -k) for (p, k), v in confident.items() if p in patterns]
            if "@" in instance or sum(c.isdigit() and c.isascii() for c in instance) >= telling:
                said += [(v, -k) for (i, k), v in votes.items() if i == instance and v >= 0.8]
            if said:
                best[start, stop] = -max(said)[1]
        spans = [(k, a, b) for (a, b), k in best.items() if not any(c <= a and d >= b and d - c > b - a for c, d in best)]
        out[doc] = sorted(spans)
    return out


def test_pii_spans_against_a_plain_version(spark):
    draw = random.Random(60)
    number = lambda: "".join(draw.choice("0123456789") for _ in range(draw.randint(4, 9)))
    phrases = ["call me at", "phone :", "order", "my number is", "write to", "server", "mixed"]
    rows = []
    for i in range(400):
        phrase = draw.choice(phrases)
        seed = {"write to": f"u{draw.randint(1, 30)}@x.org", "server": f"10.0.0.{draw.randint(1, 40)}"}.get(phrase, f"+1 (222) 555-{draw.randint(1000, 1040)}")
        odd = draw.choice([number(), "555-0123-99", f"{number()} {number()}", "someone@home"])
        thing = odd if phrase == "order" or draw.random() < (0.6 if phrase == "mixed" else 0.2) else seed
        rows.append((i, f"{draw.choice(['hi', 'so please', ''])} {phrase} {thing}{draw.choice(['', '.', ' now', ', ok'])}"))
    df = frame(spark, rows)
    mentions = {}
    for d, t in rows:
        mentions[d] = [m for line in t.split("\n") for m in pii._identifiers(line, pii.base_spans(line))]
    expected = plain_added(mentions)
    assert sum(map(len, expected.values())) > 20
    for r in pii.digest(pii.extract(df)).collect():
        base = [tuple(s.split(":")) for s in brute.pii_base(dict(rows)[r.doc_id])]
        spans = [(pii.KINDS.index(k), int(a), int(b)) for k, a, b in base] + expected[r.doc_id]
        assert r.spans == ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans)), r.doc_id


def test_pii_bootstraps_over_generations(spark):
    """What one phrase teaches is found behind another, and what stands behind that one too."""
    rows = [(i, f"please call us at +1 (222) 333-4{i:03d} today") for i in range(100)]
    rows += [(200 + i, f"please call us at 555-01{i:02d}-77 today") for i in range(10)]
    rows += [(300 + i, f"the desk answers under 555-01{i:02d}-77 always") for i in range(10)] + [(400, "the desk answers under 555-9999-12 always")]
    rows += [(401, "somewhere else 555-0103-77 stands")]
    found = {r.doc_id: r.spans for r in pii.digest(pii.extract(frame(spark, rows))).collect()}
    assert found[203] == "phone:18:29" and found[303] == "phone:23:34" and found[400] == "phone:23:34" and found[401] == "phone:15:26"
    rows = [(i, f"please call us at +1 (222) 333-44{i:02d} today") for i in range(12)]
    rows += [(200 + i, f"please call us at 555-01{i:02d}-77 today") for i in range(10)]
    found = {r.doc_id: r.spans for r in pii.digest(pii.extract(frame(spark, rows))).collect()}
    assert all(found[200 + i] == "phone:18:29" for i in range(10))


def test_quality_counts_distinct_documents(spark, tmp_path):
    """Rows of one document count once, as the SQL says."""
    unlike = " ".join("abcdefghijklmnopqrstuvwxyz"[i] * 3 for i in range(20))
    rows = [(1, f"Banner line\n{unlike}", "h") for _ in range(30)] + [(100 + i, f"Shared line\n{unlike} {'y' * i}", "h") for i in range(25)]
    rows += [(None, f"Nobody's line\n{unlike}", "g") for _ in range(30)] + [(200 + i, f"Null host\n{unlike} {'z' * i}", None) for i in range(22)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["op8_quality"](spark, str(tmp_path))
    lost = {r.doc_id for r in found.collect() if r.n_removed_lines}
    assert lost == {100 + i for i in range(25)} | {200 + i for i in range(22)}
    numbered = [(i, *r[1:]) if r[0] is None else r for i, r in enumerate(rows, 1000)]
    for name in ("op8_quality", "op8_quality_by_share"):
        db = duckdb.connect()
        folder = f"{tmp_path}/{name}"
        # the SQL joins by id, so each id stands once here
        unique = list({r[0]: r for r in numbered}.values())
        spark.createDataFrame(unique, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
        db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
        mine = queries.QUERIES[name](spark, folder)
        cursor = db.execute(oracles.ORACLES[name])
        order = [c[0] for c in cursor.description]
        same(mine.select(*order), cursor.fetchall())


def test_sharding_query(spark, tmp_path):
    """Every column of the contract on odd rows."""
    df = frame(spark, ODD)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["op9_sharding"](spark, str(tmp_path)).collect()
    facts = sorted(((r.doc_id, r.size, r.text_crc32) for r in found), key=repr)
    assert facts == sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in ODD), key=repr)
    assert {(r.law, r.grown_shard) for r in found} == {("rows", None)}
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(16)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_sharding_of_equal_rows(spark):
    equal = spark.createDataFrame([(1, "same")] * 600 + [(i, "other") for i in range(100)], "doc_id long, text string")
    found = sharding.assign(equal, 4, bucket_rows=40).collect()
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert sorted(map(len, slots.values())) == [175] * 4 and all(sorted(v) == list(range(175)) for v in slots.values())
    assert Counter(r.doc_id for r in found)[1] == 601


def test_communication_matrix_of_any_size(monkeypatch):
    for counts in ([70_000_000] * 16, [3_000_000_000] * 4, [50_000_000_000, 5, 0]):
        matrix = sharding.communication_matrix(counts, 16, 1)
        columns = matrix.sum(axis=0)
        assert matrix.sum(axis=1).tolist() == counts and columns.max() - columns.min() <= 1 and (matrix >= 0).all()
    draw = np.random.default_rng(1)
    law = np.bincount(draw.hypergeometric(30, 50, 20, 60_000), minlength=21) / 60_000
    monkeypatch.setattr(sharding, "NUMPY_URN", 10)
    mine = np.bincount([sharding.draw_good(draw, 30, 50, 20) for _ in range(60_000)], minlength=21) / 60_000
    assert np.abs(law - mine).max() < 0.01
    assert [sharding.draw_good(draw, *x) for x in ((20, 0, 5), (0, 20, 5), (9, 9, 0), (9, 9, 18))] == [5, 0, 0, 9]


def test_hot_shards_are_dealt_again(spark):
    """Prints that share most of their bits: every link is found, and no shard is copied for each of its parts."""
    rows = [(i, (0x0123456789 << 20) | (i * 2654435761 & 0xFFFFF)) for i in range(3000)]
    fps = spark.createDataFrame(rows, "doc_id long, fp long")
    values = {fp for _, fp in rows}
    group = {v: v for v in values}

    def root(v):
        while group[v] != v:
            v = group[v]
        return v

    flips = [sum(1 << b for b in bits) for n in (1, 2, 3) for bits in itertools.combinations(range(20), n)]
    for v in values:
        for f in flips:
            if v ^ f in group:
                group[max(root(v), root(v ^ f))] = min(root(v), root(v ^ f))
    expected = defaultdict(list)
    for i, fp in rows:
        expected[root(fp)].append(i)
    for most in (100, simhash.MAX_TREE):
        links = simhash.linked(fps.select("fp").distinct(), max_tree=most).collect()
        assert all((r.src ^ r.dst).bit_count() <= 3 for r in links)
        again = {v: v for v in values}

        def find(v, again=again):
            while again[v] != v:
                v = again[v]
            return v

        for r in links:
            again[max(find(r.src), find(r.dst))] = min(find(r.src), find(r.dst))
        assert len({find(v) for v in values}) == len(expected)
    found = {r.doc_id: r.component_id for r in simhash.components(fps).collect()}
    assert found == {i: min(ids) for ids in expected.values() for i in ids}


def test_decontamination_in_several_sets_equals_one(spark):
    draw = random.Random(70)
    rows = corpus(12, 60)
    items = [(i, prose(draw, draw.randint(1, 14), "abcde")) for i in range(80)] + [(200 + i, " ".join(t.split()[2:15])) for i, (_, t) in enumerate(rows[::4])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = frame(spark, rows)
    for size in (300, 1500, 1 << 20):
        same(decontaminate.digest(decontaminate.find_items(df, bench, set_bytes=size)), brute.leaks(rows, items))


def test_perfect_hash_reseeds_or_refuses():
    with pytest.raises(ValueError):
        bpe._perfect_hash([b"a", b"a", *(bytes([i]) for i in range(50))])


def test_pipeline_against_a_plain_version(spark, tmp_path, vocabulary, reference):  # noqa: F811
    """All five stages: language, one of each group of near copies, leaks, personal data, tokens."""
    draw = random.Random(80)
    rows = []
    for i in range(120):
        letters, label = [("abcdef", "aa"), ("efghij", "bb")][i % 2]
        rows.append((i, prose(draw, draw.randint(30, 60), letters), label))
    for i in range(120, 150):
        text = draw.choice(rows[:120])[1].split()
        if i % 2:
            text[3] = "changed"
        rows.append((i, " ".join(text), "aa"))
    item = prose(draw, 12, "abcdef")
    rows += [(200, f"{prose(draw, 20, 'abcdef')} {item} {prose(draw, 5, 'abcdef')}", "aa"), (201, "123 456", "aa"), (202, None, "bb"), (203, "", None)]
    rows += [(210 + i, f"{prose(draw, 20, 'efghij')} call me at +1 222 333 44{i:02d} a@b.org", "bb") for i in range(8)]
    rows += [(230, prose(draw, 20, "efghij") + " call me at 555-0101-22", "bb"), (231, "漢字 漢字 かな", None), (5, rows[5][1], rows[5][2])]
    docs = spark.createDataFrame([(d, t, k, "s", len(t) if t else None) for d, t, k in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    predict = plain_language(*zip(*[(t, k) for d, t, k in rows if t is not None and k is not None and zlib.crc32(str(d).encode()) % 5]))
    stay = [(d, t, k) for d, t, k in rows if predict(t)[0] != "und" and predict(t)[1] >= langid.bar(2)]
    groups = dict(zip([(d, t) for d, t, _ in stay], [g[2] for g in brute.simhash_groups([(d, t) for d, t, _ in stay])]))
    stay = list({(d, t): (d, t, k) for d, t, k in stay if groups[d, t] == d}.values())
    leaky = {r[0] for r in brute.leaks([(d, t) for d, t, _ in stay], [(1, item)]) if r[-1]}
    stay = [r for r in stay if r[0] not in leaky]
    mentions = {d: [m for m in pii._identifiers(t, pii.base_spans(t))] for d, t, _ in stay}
    added = plain_added(mentions)
    expected = []
    for d, t, k in stay:
        spans = [(int(a), int(b), kind) for kind, a, b in (s.split(":") for s in brute.pii_base(t))] + [(a, b, pii.KINDS[x]) for x, a, b in added[d]]
        for a, b, kind in sorted(spans, reverse=True):
            t = t[:a] + f"[{kind.upper()}]" + t[b:]
        ids = reference.encode_ordinary(t)
        expected.append((d, k, "s", len(ids), brute.sha(np.array(ids, "<u4").tobytes()), True))
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.columns == ["doc_id", "lang", "source", "n_tokens", "packed", "decodes"]
    got = [(r.doc_id, r.lang, r.source, r.n_tokens, brute.sha(bytes(r.packed)), r.decodes) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert 200 in leaky and len(expected) < len(rows) - 15 and 231 not in {e[0] for e in expected} and added[230]


def test_pipeline_stages_on_an_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def _best_of_all_pairs(found):
    kept = []
    for m in sorted(found, key=lambda m: (-m[0] * m[4], m[2], m[1])):
        if not any(2 * (min(m[3], o[3]) - max(m[2], o[2])) >= m[3] - m[2] for o in kept):
            kept.append(m)
    return [(m[1], False, m[2], m[3], m[4]) for m in sorted(kept, key=lambda m: (m[2], m[3], m[1]))]


def test_licence_matches_that_overlap():
    """Against comparing all pairs; then 10^5 notices in one text."""
    draw = random.Random(11)
    for _ in range(200):
        found = []
        for _ in range(draw.randrange(30)):
            start = draw.randrange(60)
            found.append((float(draw.randrange(1, 9)), draw.choice("abc"), start, start + draw.randrange(1, 25), draw.choice([0.5, 1.0])))
        assert licenses._best(found) == _best_of_all_pairs(found)
    many = [(5.0, "a", 20 * i, 20 * i + 15, 1.0) for i in range(100_000)] + [(4.0, "b", 20 * i + 3, 20 * i + 9, 1.0) for i in range(100_000)]
    began = time.monotonic()
    assert len(licenses._best(many)) == 100_000
    assert time.monotonic() - began < 60


def test_many_added_spans_in_one_text(spark, monkeypatch):
    """Nested, equal and overlapping spans of one text, against comparing all pairs; then 10^5 of them."""
    draw = random.Random(12)
    crossing = sorted({(a := draw.randrange(300), a + draw.randrange(1, 30)) for _ in range(150)})
    outer = [(a, b) for a, b in crossing if not any(c <= a and d >= b and (c, d) != (a, b) for c, d in crossing)]
    long_one = [(10 * i, 10 * i + 8) for i in range(100_000)]
    patterns = spark.createDataFrame([("p", 3, 0.9)], "pattern string, kind int, confidence double")
    nobody = spark.createDataFrame([], "instance long, kind int, score double")
    monkeypatch.setattr(pii, "bootstrap", lambda found, **_: (patterns, nobody))
    mention = "array<struct<kind:int,start:int,stop:int,instance:string,patterns:array<string>>>"
    for spans, kept in ((crossing, outer), (long_one, long_one)):
        places = spark.createDataFrame(spans, "start int, stop int")
        found = places.selectExpr("struct(-1 AS kind, start, stop, 'x' AS instance, array('p') AS patterns) AS m").groupBy().agg(F.collect_list("m").alias("m"))
        found = found.select(F.lit(1).alias("doc_id"), F.lit(2).cast("long").alias("text_hash"), F.col("m").cast(mention).alias("mentions"))
        began = time.monotonic()
        added = pii._added(found, "doc_id").first()["added"]
        assert [tuple(s) for s in added] == [(3, a, b) for a, b in kept]
        assert time.monotonic() - began < 60


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_workers_give_freed_memory_back():
    """What is freed below a block that stays in use goes back to the system, at the start, between batches and at the end."""
    code = """
import re
import pyarrow as pa
from kinweave.llm.text import GIVE_BACK_BYTES, pieces

def taken():
    return int(re.search("Anonymous: +([0-9]+)", open("/proc/self/smaps_rollup").read())[1]) >> 10

def litter():
    held = [b"x" * 100_000 for _ in range(1000)]
    return b"x" * 100_000

batch = pa.RecordBatch.from_pydict({"text": ["y" * (GIVE_BACK_BYTES + 1)]})
before, stays, seen = taken(), [litter()], []
for piece in pieces(iter([batch, batch])):
    seen.append(taken() - before)
    stays.append(litter())
seen.append(taken() - before)
assert len(seen) == 3 and max(seen) < 60, seen
"""
    subprocess.run([sys.executable, "-c", code], check=True, env=os.environ | {"PYTHONPATH": ROOT})

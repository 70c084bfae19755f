"""The text operators against brute force, on odd rows and made-up corpora."""

import base64
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from kinweave.llm import bpe, chat, decontaminate, langid, licenses, pii, quality, queries, sharding, simhash, substrings
from kinweave.operators.loop import checkpoint

from . import brute

SCHEMA = "doc_id long, text string, source string, lang string, fp long, shard string, matches int, ids string"

#: Nulls, empty and blank texts, ties, repeated rows, separators, non-ASCII white space and letters.
ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n\x0b\x0c\r "),
    (4, "a"),
    (5, "a b"),
    (6, "A  b\u00a0c\u2003d \x1c e"),
    (7, "Under the MIT License. apache license, version 2 / CC BY-NC cc-by-nc"),
    (8, "under the mit license under the mit license"),
    (9, "mail a.b@c.d, 1.2.3.4 999.1.1.1 +1 (222) 333-4444; 4111 1111 1111 1111\n4111-1111-1111-1112 x@y z@w.q@r.s 1.2.3.4.5"),
    (10, "é ü ß 漢字 🙂 naïve\n\nÉ"),
    (11, "word " * 3000),
    (12, "x" * 5000),
    (12, "x" * 5000),
    (12, "other text with the same id"),
    (None, "no id here"),
    (None, None),
    (13, "<|im_end|> \\n \\ <| |>\n***$$$ 1 2 3"),
]


def corpus(seed, n=120):
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 6))) for _ in range(400)]
    passages = [[draw.choice(vocabulary) for _ in range(draw.randint(40, 120))] for _ in range(6)]
    out = []
    for i in range(n):
        w = [draw.choice(vocabulary) for _ in range(draw.randint(0, 150))]
        if draw.random() < 0.5:
            at = draw.randint(0, len(w))
            w[at:at] = draw.choice(passages)[draw.randint(0, 8) :]
        if draw.random() < 0.2 and out:
            w = out[draw.randrange(len(out))][1].split()
            if w and draw.random() < 0.7:
                w[draw.randrange(len(w))] = "changed"
        out.append((i * 3 % n, draw.choice([" ", "\n", "  "]).join(w)))
    return out


def frame(spark, rows):
    wide = [(d, t, "host" if (d or 0) % 3 else None, "en", 1, "s", 2, "i") for d, t in rows]
    return spark.createDataFrame(wide, SCHEMA).repartition(3)


@pytest.fixture(scope="module", params=["odd", "corpus", "empty"])
def table(request, spark):
    rows = {"odd": ODD, "corpus": corpus(1), "empty": []}[request.param]
    return rows, frame(spark, rows)


def plain_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def same(found, expected):
    assert plain_rows(found) == sorted(expected, key=repr)


def test_license_base(table):
    rows, df = table
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    found = licenses.digest(licenses.scan(df))
    same(found.select(*columns), [(d, *brute.license_base(t)) for d, t in rows])
    for r in found.collect():
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_templates(spark):
    full = "/* " + licenses.TEMPLATES["bsd-opening"][0].replace(",", " *\n * ") + " */ code"
    near = licenses.TEMPLATES["bsd-opening"][0].replace("Redistribution", "distribution").replace("source", "sauce")
    rows = [(1, "some words then " + full), (2, near), (3, "licensed under the GNU General Public License, version 3."), (4, "redistribution of forms")]
    rows += [(10 + i, "plain prose about the weather and the sea") for i in range(20)]
    labels = {r.doc_id: r.labels for r in licenses.digest(licenses.scan(frame(spark, rows))).collect()}
    assert labels[1] == "bsd" and labels[2] == "" and labels[3] == "gpl-3" and labels[4] == "" and labels[12] == ""


def test_license_templates_together(spark):
    """No licence takes the place of another in a file that holds several."""
    texts = {name: text for name, (text, _) in licenses.TEMPLATES.items()}
    rows = [(1, "\n".join(texts.values())), (2, " ".join(texts[k] for k in ("mit", "apache-2", "gpl-3-notice")))]
    rows += [(100 + k, f"before it {text} and after it") for k, text in enumerate(texts.values())]
    rows += [(k + 1000, "plain words of another kind") for k in range(50)]
    found = {r.doc_id: r.matches for r in licenses.scan(frame(spark, rows)).collect()}
    whole = lambda d: {m.label for m in found[d] if m.score == 1.0}
    labels = {licenses._LABELS.get(k, k) for k in texts}
    assert whole(1) == labels and whole(2) == {"mit", "apache-2", "gpl-3"}
    assert all(whole(100 + k) == {licenses._LABELS.get(name, name)} for k, name in enumerate(texts))


def test_pii_base(table):
    rows, df = table
    found = pii.digest(pii.extract(df)).drop("spans", "n_added")
    expected = []
    for d, t in rows:
        spans = brute.pii_base(t)
        counts = [sum(s.startswith(f"{k}:") for s in spans) for k in pii.KINDS]
        expected.append((d, *counts, brute.sha(",".join(spans))))
    same(found, expected)


def test_pii_base_rules_random():
    draw = random.Random(3)
    for _ in range(20000):
        line = "".join(draw.choice("0123459.@+- (a)%x") for _ in range(draw.randrange(40)))
        assert [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in pii.base_spans(line)] == brute.pii_base(line), line


def test_pii_patterns_find_unseen(spark):
    """A phrase that always precedes phone numbers labels an identifier that no rule knows."""
    rows = [(i, f"please call us at +1 (222) 333-44{i:02d} today") for i in range(12)]
    rows += [(50, "please call us at 555-0199-77 today"), (51, "order number 123456789 shipped")]
    found = {r.doc_id: r for r in pii.digest(pii.extract(frame(spark, rows))).collect()}
    assert found[50].n_phone == 0 and found[50].spans == "phone:18:29" and found[50].n_added == 1
    assert found[51].spans == ""
    cleaned = {r.doc_id: r.text for r in pii.redact(frame(spark, rows)).collect()}
    assert cleaned[50] == "please call us at [PHONE] today" and cleaned[3] == "please call us at [PHONE] today"
    assert cleaned[51] == rows[-1][1]


def test_pii_patterns_find_forms_with_blanks(spark):
    """Runs of digit groups, places after punctuation and at line starts, and patterns that only labelled instances support."""
    cards = ["".join(d) for d in zip("4" * 10, "0123456789", ["00000000000000"] * 10)]
    cards = [next(f"{c[:4]} {c[4:8]} {c[8:12]} {c[12:15]}{x}" for x in range(10) if brute.luhn(c[:15] + str(x))) for c in cards]
    rows = [(100 + i, f"please call us at +1 (222) 333-44{i:02d} today") for i in range(60)]
    rows += [(200 + i, f"card {c} ok") for i, c in enumerate(cards)]
    rows += [(300 + i, f"Phone : +1 222 555 77{i:02d}\n+44 20 7946 09{i:02d} is home") for i in range(10)]
    rows += [(400 + i, f"please call us at 555-01{i:02d} or\nfax me 555-01{i:02d}") for i in range(12)]
    rows += [(50, "please call us at (017) 555 7713 today"), (51, "card 4111 1111 1111 1112 ok"), (52, "Phone : 5551234"), (53, "5559876 is home")]
    rows += [(70, "fax me 777 1234."), (71, "order number 123 456 789 shipped")]
    want = {
        50: "please call us at [PHONE] today",
        51: "card [CARD] ok",
        52: "Phone : [PHONE]",
        53: "[PHONE] is home",
        70: "fax me [PHONE].",
        71: "order number 123 456 789 shipped",
    }
    cleaned = {r.doc_id: r.text for r in pii.redact(frame(spark, rows)).collect()}
    assert {k: cleaned[k] for k in want} == want
    found = {r.doc_id: r.spans for r in pii.digest(pii.extract(frame(spark, rows))).collect()}
    assert found[50] == "phone:18:32" and found[51] == "card:5:24" and found[70] == "phone:7:15" and found[71] == ""


def test_redact_keeps_rows(table):
    rows, df = table
    found = pii.redact(df)
    assert found.columns == df.columns
    clean = [(d, t) for d, t in rows if not brute.pii_base(t)]
    kept = [tuple(r) for r in found.select("doc_id", "text").collect()]
    assert len(kept) == len(rows) and all(r in kept for r in clean)


def test_substring_dedup(table):
    rows, df = table
    same(substrings.digest(substrings.remove_duplicates(df)), brute.substrings(rows))


@pytest.mark.parametrize("seed", [2, 3])
def test_substring_dedup_random(spark, seed):
    rows = corpus(seed, 80)
    found = substrings.digest(substrings.remove_duplicates(frame(spark, rows)))
    expected = brute.substrings(rows)
    assert sum(r[2] for r in expected) > 500
    same(found, expected)


@pytest.mark.parametrize("limit", [-1, 8000])
def test_substring_dedup_by_shuffle(spark, monkeypatch, limit):
    monkeypatch.setattr(substrings, "BROADCAST_BYTES", limit)
    rows = corpus(5, 60)
    same(substrings.digest(substrings.remove_duplicates(frame(spark, rows))), brute.substrings(rows))


CONVERSATIONS = [
    (1, 1, "assistant", "answer \\ <|im_end|>\n"),
    (1, 0, "user", None),
    (2, 0, "sys\ntem", "<|im_start|>\\n"),
    (2, 1, None, ""),
    (3, None, "assistant", "a"),
    (3, None, "assistant", "a"),
    (None, 0, "assistant", "🙂"),
    *[(4, i, ["user", "assistant"][i % 2], f"turn {i} " * (i % 5)) for i in range(150)],
]


def test_chat(spark):
    df = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string").repartition(3)
    grouped = {}
    for c, n, r, t in CONVERSATIONS:
        grouped.setdefault(c, []).append((n is not None, n or 0, r or "", t or ""))
    expected = []
    for c, turns in grouped.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        digest = brute.sha("".join(f"{r}\n{t}\n" for *_, r, t in turns))
        expected.append((c, len(turns), digest, len(loss), brute.sha(loss)))
    found = chat.read_back(chat.format_conversations(df))
    same(found.drop("formatted_chars", "rewrites"), expected)
    assert not found.where("rewrites").count()
    same(chat.read_back(chat.format_conversations(df.limit(0))), [])


def test_escape_round_trip():
    draw = random.Random(4)
    for _ in range(5000):
        text = "".join(draw.choice("\\<|n>\na") for _ in range(draw.randrange(12)))
        assert chat.unescape(chat.escape(text, True)) == text == chat.unescape(chat.escape(text)) and "<|" not in chat.escape(text)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "word word"), (3, None), (4, "..."), (5, "A b"), (None, "no id here"), (6, "a B")]


@pytest.mark.parametrize("set_bytes", [decontaminate.SET_BYTES, 200])
def test_decontamination(table, spark, set_bytes):
    rows, df = table
    draw = random.Random(6)
    items = ITEMS + [(20 + i, " ".join((t or "").split()[3 : 3 + draw.randint(1, 25)])) for i, (_, t) in enumerate(rows[::9])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.digest(decontaminate.find_items(df, bench, set_bytes=set_bytes))
    expected = brute.leaks(rows, items)
    same(found, expected)
    clean = sorted((repr((e[0], t)) for e, (_, t) in zip(expected, rows) if not e[-1]))
    kept = decontaminate.drop_contaminated(df, bench, set_bytes=set_bytes)
    assert sorted(repr(tuple(r)) for r in kept.select("doc_id", "text").collect()) == clean and kept.columns == df.columns


def test_decontamination_without_items(table, spark):
    rows, df = table
    found = decontaminate.digest(decontaminate.find_items(df, spark.createDataFrame([], "item_id long, text string")))
    same(found, brute.leaks(rows, []))


@pytest.fixture(scope="module")
def vocabulary():
    return queries.public_vocabulary()


@pytest.fixture(scope="module")
def reference():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(table, vocabulary, reference):
    rows, df = table
    expected = []
    for d, t in rows:
        ids = reference.encode_ordinary(t or "")
        expected.append((d, len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(t or "")))
    same(bpe.digests(bpe.encode_packed(df, vocabulary)), expected)
    encoded = bpe.encode(df.select("doc_id", "text"), vocabulary)
    decoded = bpe.decode(encoded, vocabulary)
    same(decoded.select("doc_id", F.col("decoded").cast("string")), [(d, t or "") for d, t in rows])


def test_bpe_random(vocabulary, reference):
    encoder, draw = bpe._Encoder(vocabulary), random.Random(8)
    assert all(vocabulary.find(t) == i for i, t in enumerate(vocabulary.tokens))
    assert vocabulary.find(b"surely no token of it") == -1
    for _ in range(3000):
        text = "".join(draw.choice("aeéß漢 \n\t.,12'strlm🙂") for _ in range(draw.randrange(60)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == reference.encode_ordinary(text)


def test_language_edge_cases(table, spark):
    rows, df = table
    model = langid.fit(df)
    found = {(r.doc_id, r.text_hash): r for r in langid.predict(df, model).collect()}
    for r in found.values():
        assert r.lang_pred in ("en", "und") and 0 <= r.score <= 1
    letters = {d for d, t in rows if any(c.isalpha() for c in t or "")}
    assert {d for (d, _), r in found.items() if r.lang_pred != "und"} == letters
    nothing = langid.fit(df.where("lang IS NULL"))
    assert {r.lang_pred for r in langid.predict(df, nothing).collect()} <= {"und"}


def test_language_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = df.where(queries.held_out())
    model = langid.fit(df.where(~queries.held_out()))
    right = langid.predict(held, model).join(held, "doc_id").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert right > 0.98
    small = langid.fit(df.where(~queries.held_out()), max_rows=15)
    right = langid.predict(held, small).join(held, "doc_id").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert right > 0.9


def test_quality_base(table):
    rows, df = table
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    found = quality.judge(df)
    same(found.select(*columns), [(d, *brute.quality(t)) for d, t in rows])
    assert not found.where("base_failed AND kept").count()


def test_quality_lines(spark):
    banner = "Read  More 12\n"
    unlike = " ".join("abcdefghijklmnopqrstuvwxyz"[i] * 3 for i in range(20))
    rows = [(i, "read more 99 \n" * (i % 2) + banner + f"{unlike} {i}") for i in range(1, 40)]
    rows += [(100, banner + "only one two three four five six"), (101, unlike)]
    same_host = spark.createDataFrame([(d, t, "h") for d, t in rows], "doc_id long, text string, source string")
    found = {r.doc_id: r for r in quality.judge(same_host, keep_text=True).collect()}
    assert found[2].kept and found[2].n_removed_lines == 1 and found[2].clean_text == f"{unlike} 2"
    assert found[1].n_removed_lines == 2 and found[1].n_removed_words == 6
    assert not found[100].kept and not found[100].base_failed and found[101].kept and found[101].n_removed_lines == 0
    other = spark.createDataFrame([(d, t, f"h{d}") for d, t in rows], "doc_id long, text string, source string")
    assert not quality.judge(other).where("n_removed_lines > 0").count()


@pytest.mark.parametrize("limit", [0, 16 << 20])
def test_quality_banner_of_a_large_host(spark, monkeypatch, tmp_path, limit):
    """A banner goes from a large host too; the lines to remove may be joined by a shuffle."""
    monkeypatch.setattr(quality, "BROADCAST_BYTES", limit)
    unlike = " ".join("abcdefghijklmnopqrstuvwxyz"[i] * 3 for i in range(20))
    rows = [(i, "Read more\n" * (i % 12 == 0) + f"{unlike} {'x' * i}\n \n", "h") for i in range(400)]
    rows += [rows[12], (None, None, None), (None, "Read more", "h"), (500, "Read more\nkept words", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.QUERIES["op8_quality_any_host"](spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    lost = sorted(r.doc_id for r in found if r.n_removed_lines == 1 and r.doc_id is not None)
    assert lost == sorted([*range(0, 400, 12), 12]) and all(r.n_removed_words == 2 * r.n_removed_lines for r in found)
    clean = {r.doc_id: r.clean_text for r in quality.judge(df, max_share=0.0, keep_text=True).collect()}
    assert clean[12] == rows[12][1].removeprefix("Read more\n") and clean[13] == rows[13][1]
    assert clean[500] == rows[-1][1]


def test_sharding(table, spark):
    rows, df = table
    for buckets in (sharding.BUCKET_ROWS, 5):
        found = sharding.assign(df.select("doc_id", "text"), 4, bucket_rows=buckets).collect()
        same(spark.createDataFrame(found, "doc_id long, text string, shard int, slot long").drop("shard", "slot"), rows)
        slots = {}
        for r in found:
            slots.setdefault(r.shard, []).append(r.slot)
        sizes = [len(slots.get(s, [])) for s in range(4)]
        assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_communication_matrix():
    counts = [7, 0, 100, 3]
    matrix = sharding.communication_matrix(counts, 4, 1)
    assert matrix.sum(axis=1).tolist() == counts and matrix.sum(axis=0).tolist() == [28, 28, 27, 27]
    drawn = [sharding.communication_matrix([4, 4], 2, s)[0, 0] for s in range(4000)]
    expected = [1 / 70, 16 / 70, 36 / 70, 16 / 70, 1 / 70]
    assert all(abs(drawn.count(k) / 4000 - p) < 0.03 for k, p in enumerate(expected))


def test_simhash(table):
    rows, df = table
    same(simhash.digest(simhash.near_duplicates(df)), brute.simhash_groups(rows))


def test_simhash_links_of_close_prints(spark):
    """Fingerprints around a few centres: chains, hot shards and several parts for one shard."""
    draw = random.Random(9)
    prints = set()
    for _ in range(6):
        centre = draw.getrandbits(64)
        for _ in range(60):
            p = centre
            for _ in range(draw.randint(0, 4)):
                p ^= 1 << draw.randrange(64)
            prints.add(p)
    prints = sorted(prints)
    group = {p: p for p in prints}

    def root(p):
        while group[p] != p:
            p = group[p]
        return p

    for i, p in enumerate(prints):
        for q in prints[:i]:
            if (p ^ q).bit_count() <= 3:
                group[max(root(p), root(q))] = min(root(p), root(q))
    ids = {p: i for i, p in enumerate(prints)}
    fps = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for p, i in ids.items()], "doc_id long, fp long")
    expected = {i: ids[root(p)] for p, i in ids.items()}
    for most in (simhash.MAX_TREE, 7):
        links = {(r.src % (1 << 64), r.dst % (1 << 64)) for r in simhash.linked(fps, max_tree=most).collect()}
        assert all((a ^ b).bit_count() <= 3 for a, b in links)
        again = {p: p for p in prints}

        def find(p, again=again):
            while again[p] != p:
                p = again[p]
            return p

        for a, b in links:
            again[max(find(a), find(b))] = min(find(a), find(b))
        assert {i: ids[find(p)] for p, i in ids.items()} == expected
    assert {r.doc_id: r.component_id for r in simhash.components(fps).collect()} == expected


def test_keep_one(table):
    rows, df = table
    kept = [r.doc_id for r in simhash.keep_one(df).collect()]
    assert sorted(kept, key=repr) == sorted(brute.simhash_groups(rows, survivors=True), key=repr)
    with pytest.raises(ValueError):
        simhash.linked(df.select("fp"), radius=4)


def test_held_out(spark):
    ids = spark.range(100).withColumnRenamed("id", "doc_id")
    held = {r.doc_id for r in ids.where(queries.held_out()).collect()}
    assert held == {i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 0}


def test_simhash_shards_reach_their_trees_whole(spark):
    """40,000 shards of two close prints, of which 2,000 are asked for: Spark broadcasts these once it knows that they are few."""
    rows_ = spark.range(80_000).selectExpr("xxhash64(id DIV 2) AS shard", "(id DIV 2) * 64 + id % 2 AS fp").orderBy(F.xxhash64("fp"))
    level = checkpoint(rows_.repartition(40))
    some = checkpoint(level.where("fp < 2000 * 64").select("shard").distinct())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # not before the join runs, as with tables of unknown size
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "100KB")
    found = simhash._tree_links(level.join(some, "shard"), 3)
    assert "REPARTITION_BY_COL" in found._jdf.queryExecution().executedPlan().toString()  # dealt anew, however the join is run
    links = found.collect()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert sorted((min(r), max(r)) for r in links) == [(64 * i, 64 * i + 1) for i in range(2000)]

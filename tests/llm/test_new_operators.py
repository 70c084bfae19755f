"""Spelling variants, packages of web archives and whitening against plain versions."""

import hashlib
import io
import json
import random
import re
import zipfile
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from kinweave.llm import langid, oracles, queries, spelling, warc, whitening

from .test_operators import ODD, corpus, frame, same

DATA = "/root/testdata/sf0.001"


def lower(run):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)


def plain_counts(texts):
    counts = Counter()
    for number, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if number is None else number}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    best = {w: min(vs, key=lambda v: (-counts[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if counts[v] >= 2 * counts[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return [(w, form.get(w), root(w), n, len(near[w]), counts[form[w]] if w in form else None) for w, n in counts.items()]


VARIANT = ["word", "form", "root", "n", "n_near", "form_n"]


def test_variants_of_odd_texts(spark):
    letters = "x" * 40
    more = [(20, "Wörter wörter WÖRTER wörtér wörter"), (21, "÷×÷×÷ ÷×÷×÷ ÷×÷×÷ ÷×÷×"), (22, "Ünïcode’s “quotes” ĀĀĀabcde漢abcde"), (22, "abcde abcde")]
    more += [(i, f"{letters} {letters[:-1]} aabbcc aabcc aabbc abbcc house houses horse") for i in range(23, 30)]
    texts = ODD + more
    same(spelling.group_variants(frame(spark, texts)).select(*VARIANT), plain_variants(plain_counts(texts)))


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_of_random_words(spark, seed, monkeypatch):
    draw = random.Random(seed)
    counts = {"".join(draw.choice("abé") for _ in range(draw.randint(1, 7))): draw.randint(1, 40) for _ in range(300)}
    rows = spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n long, rank string").repartition(3)
    want = plain_variants(counts)
    assert sum(r[4] for r in want) > 500
    same(spelling.variants_of(rows).select(*VARIANT), want)
    wide = spark.createDataFrame([("漢字漢字漢", 9), ("漢字漢字🙂", 3), ("漢字漢字", 1)], "word string, n long")
    same(spelling.variants_of(wide).select("word", "root", "n_near"), [("漢字漢字漢", "漢字漢字漢", 2), ("漢字漢字🙂", "漢字漢字漢", 2), ("漢字漢字", "漢字漢字漢", 2)])


def test_variants_on_the_given_table(spark):
    texts = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    counts = plain_counts(texts)
    found = {r.word: r for r in queries.op11_spelling(spark, DATA).collect()}
    assert {w: r.n for w, r in found.items()} == counts
    near = defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            near[w[:i], "*", w[i + 1 :]].add(w)
            if w[:i] + w[i + 1 :] in counts:
                near[w, w[:i] + w[i + 1 :]] = {w, w[:i] + w[i + 1 :]}
    beside = defaultdict(set)
    for met in near.values():
        for w in met:
            beside[w] |= met - {w}
    assert {w: r.n_near for w, r in found.items()} == {w: len(beside[w]) for w in counts} and any(beside.values())


def test_long_runs_and_chains(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 3)
    run = "".join(random.Random(3).choice("abcdef") for _ in range(20_000))
    chain = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb"]
    texts = [(i, f"{run} {run[:-1]} " + " ".join(" ".join([w] * 3 * 4**k) for k, w in enumerate(chain))) for i in range(3)]
    found = {r.word: r for r in spelling.group_variants(frame(spark, texts)).collect()}
    assert found["aaaaa"].root == "bbbbb" and found["aaabb"].form == "aabbb"
    assert len(run) < 97 or found[run].n_near == (run[:-1] in found)
    assert spelling.group_variants(frame(spark, texts).where("false")).count() == 0


def plain_records(pages):
    out, first = [], {}
    for number, _, html in pages:
        body = (html or "").encode()
        key = (number is None, number or 0)
        if len(body) >= 100 and (body not in first or key < first[body]):
            first[body] = key
    for number, _, html in pages:
        body = (html or "").encode()
        again = len(body) >= 100 and first[body] != (number is None, number or 0)
        out.append((number, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first[body][1] if again else None))
    return out


RECORD = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
LONG = "<p>é long enough</p>\r\n\r\n" * 9
PAGES = [
    (5, "http://a.example/?q=ü x\r\ny", LONG),
    (3, "http://a.example/2", LONG),
    (9, None, LONG),
    (None, "http://a.example/3", LONG),
    (3, "http://a.example/2", LONG),
    (1, "http://b.example/", "short"),
    (2, "http://b.example/", "short"),
    (4, "", None),
    (6, "x", ""),
    (7, "x", "y" * 99),
    (8, "x", "y" * 99),
    (-2, "x", "z" * 100),
    (10, "x", "z" * 100),
    (None, "x", "only null ids " * 20),
    (None, "x", "only null ids " * 20),
]


def pages_frame(spark, pages=PAGES):
    rows = [(*p, "d", 1, "b") for p in pages]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string, refers_to int, payload string")


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 24])
def test_packages_round_trip(spark, tmp_path, broadcast_bytes, monkeypatch):
    monkeypatch.setattr(warc, "MEMBER_BYTES", 400)
    monkeypatch.setattr(warc, "READ_BYTES", 500)
    folder = str(tmp_path / "packages")
    warc.write_packages(pages_frame(spark).repartition(2), folder, broadcast_bytes=broadcast_bytes)
    found = warc.read_packages(spark, folder)
    same(found.select(*RECORD), plain_records(PAGES))
    bodies = Counter((r.page_id, bytes(r.payload)) for r in found.where("record_type = 'response'").collect())
    kept = [(p, h) for p, r in zip(PAGES, plain_records(PAGES), strict=True) if r[3] == "response" for h in [(p[2] or "").encode()]]
    assert bodies == Counter((p[0], h) for p, h in kept)
    assert found.where("record_type = 'revisit'").where("payload IS NOT NULL").count() == 0
    # any other ZIP reader reads them
    for file in (tmp_path / "packages").glob("part-*"):
        with zipfile.ZipFile(file) as package:
            assert package.testzip() is None and package.comment == b"\n"
            for line in package.read("indexes/index.cdx").splitlines():
                place = json.loads(line.split(b" ", 2)[2])
                raw = package.read(f"archive/{place['filename']}")[place["offset"] :][: place["length"]]
                assert zlib.decompress(raw, wbits=31).startswith(b"WARC/1.1\r\n")


def test_packages_where_only_spark_reads(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "packages")
    warc.write_packages(pages_frame(spark), folder)

    monkeypatch.setattr(warc, "_uri", lambda path: "nowhere:" + path)
    same(warc.read_packages(spark, folder).select(*RECORD), plain_records(PAGES))


def test_pages_empty_and_given(spark):
    assert warc.round_trip(pages_frame(spark).where("false")).count() == 0
    same(warc.round_trip(pages_frame(spark)).select(*RECORD), plain_records(PAGES))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{DATA}/pages.parquet'")
    same(queries.op12_warc(spark, DATA).select(*RECORD), con.execute(f"SELECT {', '.join(RECORD)} FROM ({oracles.ORACLES['op12_warc']})").fetchall())


def reader(data):
    return lambda offset, length: data[offset : offset + length]


def foreign_package(records, force_zip64=False, comment=b"", before=b"", method=zipfile.ZIP_STORED, mode="w"):
    """A package that another program wrote."""
    held = io.BytesIO()
    held.write(before)
    with zipfile.ZipFile(held, "a" if before else "w", method) as package:
        places, data = [], b""
        for record in records:
            places.append((len(data), len(record)))
            data += record
        for name, content in (
            ("archive/one.warc", data),
            ("indexes/index.cdx", "".join(f'x 0 {{"filename": "one.warc", "offset": {a}, "length": "{n}"}}\n' for a, n in places).encode() + b"!meta\n"),
            ("datapackage.json", b"{}"),
        ):
            with package.open(zipfile.ZipInfo(name), "w", force_zip64=force_zip64) as member:
                member.write(content)
        package.comment = comment
    return held.getvalue()


@pytest.mark.parametrize("force_zip64", [False, True])
@pytest.mark.parametrize("comment", [b"", b"PK a comment" * 30])
@pytest.mark.parametrize("before", [b"", b"#!/bin/sh\n" * 5])
def test_foreign_packages(spark, tmp_path, force_zip64, comment, before):
    page = {"page_id": 7, "url": "http://x.example/", "payload": b"body", "digest": hashlib.sha256(b"body").digest(), "refers_to": None}
    records = [warc._record(page), zlib.compress(warc._record(page | {"page_id": 8, "refers_to": 7}), wbits=31)]
    data = foreign_package(records, force_zip64, comment, before)
    members = warc.central_directory(reader(data), len(data))
    with zipfile.ZipFile(io.BytesIO(data)) as package:
        assert set(members) == set(package.namelist())
        for name, member in members.items():
            begin = warc.data_offset(reader(data), name, member)
            assert data[begin : begin + member[1]] == package.read(name)
    (tmp_path / "a.wacz").write_bytes(data)
    found = warc.read_packages(spark, str(tmp_path)).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload) for r in found) == [(7, "response", None, 4, b"body"), (8, "revisit", 7, 4, None)]


def test_many_members_and_faults():
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as package:
        for i in range(66_000):  # more than the plain end record can count
            package.writestr(zipfile.ZipInfo(f"archive/{i}"), b"")
    data = held.getvalue()
    assert len(warc.central_directory(reader(data), len(data))) == 66_000
    page = {"page_id": 7, "url": None, "payload": b"body", "digest": b"\0" * 32, "refers_to": None}
    good = foreign_package([warc._record(page)])
    odd = foreign_package([warc._record(page)], comment=b"PK\x05\x06 a comment that looks like an end record")
    assert warc.central_directory(reader(odd), len(odd)) == warc.central_directory(reader(good), len(good))
    for read, size in [(reader(b""), 0), (reader(b"x" * 100), 100), (reader(good[:-30]), len(good) - 30)]:
        with pytest.raises(warc.PackageError):
            warc.central_directory(read, size)
    with pytest.raises(warc.PackageError, match="differs"):
        warc.parse_record(warc._record(page))
    with pytest.raises(warc.PackageError, match="no WARC"):
        warc.parse_record(b"<html>")
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as package:
        package.writestr("indexes/index.cdx", b"x" * 1000)
    with pytest.raises(warc.PackageError, match="not stored"):
        list(warc.index_entries(reader(packed.getvalue()), len(packed.getvalue())))
    away = good.replace(b'"offset": 0', b'"offset": 9')
    with pytest.raises(warc.PackageError, match="outside"):
        list(warc.index_entries(reader(away), len(away)))


def plain_whitening(vectors):
    """Of good vectors by id: n, deviations, eigenvalues, trace and whitened rows."""
    whole = {i: [int(np.floor(float(np.float32(c)) * 64)) + 1_000_000 for c in v] for i, v in vectors.items()}
    distinct = np.array(sorted({tuple(x) for x in whole.values()}), dtype=object)
    n, sums = len(distinct), distinct.sum(axis=0)
    centred = ((n * distinct - sums) / n).astype(float)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    rows = {i: n * np.array(x, dtype=object) - sums for i, x in whole.items()}
    white = {i: (r / n).astype(float) @ axes / np.sqrt(np.maximum(values, 1e-300)) for i, r in rows.items()}
    return n, {i: int((r * r).sum()) for i, r in rows.items()}, values, centred.var(axis=0).sum(), white


def check_whitening(spark, rows, good, components=16):
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, n int, whitened double")
    entries = whitening.whole_entries(df)
    found = whitening.whiten(entries, whitening.fit(entries)).collect()
    n, deviations, values, trace, white = plain_whitening(good)
    assert Counter(r.vec_id for r in found) == Counter(i for i, v in rows for _ in range(components) if i in good and v == good[i])
    by_component = defaultdict(list)
    for r in found:
        assert (r.n, r.deviation) == (n, deviations[r.vec_id]) and r.identity_error < 1e-9
        assert abs(r.explained - values[r.component - 1] / trace) < 1e-10
        by_component[r.component].append(r)
    assert set(by_component) == set(range(1, components + 1))
    return by_component, white, values


def test_whitening_of_odd_vectors(spark):
    draw = np.random.default_rng(5)
    good = {i: draw.normal(size=20).astype(np.float32).tolist() for i in range(150)}
    bad = [(200, None), (201, [1.0] * 19 + [None]), (202, [float("nan")] + [0.0] * 19), (203, [float("-inf")] + [0.0] * 19), (204, []), (205, [1.0] * 7)]
    rows = [*good.items(), *bad, *[(7, good[7])] * 3, *[(i, good[9]) for i in range(300, 340)]]
    good |= {i: good[9] for i in range(300, 340)}
    found, white, values = check_whitening(spark, rows, good)
    for c, rs in found.items():
        got, want = np.array([r.whitened for r in rs]), np.array([white[r.vec_id][c - 1] for r in rs])
        assert np.abs(got * np.sign(got @ want) - want).max() < 1e-9


def test_whitening_of_equal_and_missing_directions(spark):
    draw = np.random.default_rng(6)
    # a ball of opposite unit vectors: all variances are equal
    cross = {k: [float(k % 5 == j) * (1 - 2 * (k // 5)) for j in range(5)] for k in range(10)}
    found, _, values = check_whitening(spark, list(cross.items()), cross, 5)
    assert np.ptp(values) < 1e-9 * values[0]
    flat = {i: [*v, v[0], 1.0] for i, v in enumerate(draw.integers(-3, 4, (40, 3)).astype(float).tolist())}
    check_whitening(spark, list(flat.items()), flat, 3)
    wide = {i: draw.normal(size=40).astype(np.float32).tolist() for i in range(8)}
    check_whitening(spark, list(wide.items()), wide, 7)
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        entries = whitening.whole_entries(df)
        assert whitening.whiten(entries, whitening.fit(entries)).count() == 0


def test_whitening_starts_again_beside_what_has_converged(spark):
    """Only some of many dimensions are needed, and equal variances among the largest are all found."""
    draw = np.random.default_rng(8)
    ranges = np.concatenate([[40.0] * 4, np.geomspace(20, 8, 12), np.full(84, 0.5)])
    rows = {i: (draw.choice([-1.0, 1.0], 100) * ranges * (1 if j == 0 else draw.random(100))).astype(np.float32).tolist() for i in range(300) for j in [i % 3]}
    check_whitening(spark, list(rows.items()), rows)
    signs = [np.array([1 if i >> b & 1 else -1 for b in range(6)]) for i in range(64)]
    cube = {i: np.concatenate([10.0 * s[:3], 3.0 * s[3:], np.zeros(40)]).tolist() for i, s in enumerate(signs)}
    check_whitening(spark, list(cube.items()), cube, 6)


def test_whitening_on_the_given_table(spark):
    rows = {r.vec_id: list(r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    found = queries.op13_whitening(spark, DATA).toPandas()
    n, deviations, values, trace, white = plain_whitening(rows)
    assert len(found) == 16 * len(rows) and set(found.n) == {n} and found.identity_error.max() < 1e-4
    assert {r.vec_id: r.deviation for r in found.itertuples()} == deviations
    got = found.pivot(index="vec_id", columns="component", values="whitened")
    want = np.array([white[i] for i in got.index])[:, :16]
    assert np.abs(got.values * np.sign((got.values * want).sum(axis=0)) - want).max() < 1e-8
    assert found.groupby("component").explained.first().values == pytest.approx(values[:16] / trace, rel=1e-9)


def test_every_language_is_learnt(spark):
    """Languages of a few texts, each longer than all that may be learnt from, are learnt nevertheless."""
    rows = [(100 * i + j, chr(97 + i) * 3 + " " + f"{chr(97 + i)}b " * 400, f"l{i}") for i in range(20) for j in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taken = {r.lang: r.text for r in langid.sample(df, "doc_id", "text", "lang", 5000, 300).collect()}
    assert len(taken) == 20 and all(len(t) == 300 for t in taken.values())
    model = langid.fit(df, max_bytes=300)
    assert model.languages == sorted(f"l{i}" for i in range(20))
    assert {r.doc_id // 100: r.lang_pred for r in langid.predict(df, model).collect()} == {i: f"l{i}" for i in range(20)}


def test_lines_above_a_low_limit_go(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    found = queries.op8_quality_low_limit(spark, "/root/testdata/sf0.01")
    columns = sorted(found.columns)
    same(found.select(columns), con.execute(f"SELECT {', '.join(columns)} FROM ({oracles.ORACLES['op8_quality_low_limit']})").fetchall())
    assert found.where("n_removed_lines > 0").count() > 0

"""Joins, components, sharding, nearest neighbours, archives and the pipeline on small tables."""

import collections
import gzip
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tideline.llm import ann, ngram_join, registry, sharding, warc
from tideline.llm.common import Scratch, words
from tideline.llm.components import components

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_join(rows):
    """Brute force: {row: (set size, least id reachable)} by all pairs."""

    def shingles(t):
        w = words(t)
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return sorted(((k, len(s), least.get(root(i)) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def got(df):
    return sorted((tuple(r) for r in ngram_join.join(df).collect()), key=str)


def test_join_matches_all_pairs(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    assert got(docs) == plain_join([(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize("deal", [4096, 3])
def test_join_of_planted_groups(spark, monkeypatch, deal):
    monkeypatch.setattr(ngram_join, "LONG_LIST", deal)
    monkeypatch.setattr(ngram_join, "HOT_ROWS", deal)
    monkeypatch.setattr(ngram_join, "BLOCK_ITEMS", 200)
    r = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)]
    rows = [(None, "a b c d e f"), (1, None), (2, ""), (3, " \n "), (4, "x y"), (5, "X Y"), (6, "x y z"), (7, "a b c d e f"), (7, "other words are in this one here")]
    for base in range(8):
        own = [r.choice(vocabulary) for _ in range(r.choice([6, 7, 9, 14, 40, 90]))]
        for _ in range(12):
            copy = list(own)
            for _ in range(r.randrange(0, 4)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            rows.append((100 * base + len(rows) + 10, " ".join(copy)))
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA).withColumn("size", F.lit("clash"))
    assert got(df) == plain_join(rows)
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect() if r["doc_id"] not in (None, 1, 2, 3, 7)) == sorted((i, t) for (i, t) in rows if i is not None and i not in (1, 2, 3, 7) and (i, i) in {(a, c) for a, _, c in plain_join(rows)})
    assert ngram_join.join(df.limit(0)).count() == 0


def test_one_row_of_each_component_stays(spark):
    same = "one two three four five six seven"
    rows = [(2, same, "x"), (1, same, "b"), (1, same, "a"), (1, same, "a"), (None, same, "a"), (9, "other words stand in this text here", None), (9, "third text with its own seven words", "c"), (None, "no id but words of its own too", "d"), (None, "no id but words of its own too", "d"), (4, None, "e"), (4, None, "e"), (None, " ", "f"), (1, "quite another text under the same id", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id string").withColumns({"label": F.lit(1), "__node": F.lit("n"), "__row": F.array(F.lit(1))})
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns and kept.dtypes == df.dtypes
    want = [rows[2], *rows[5:8], rows[9], rows[10], rows[11], rows[12]]
    assert sorted(map(str, ((r["doc_id"], r["text"], r["__id"]) for r in kept.collect()))) == sorted(map(str, want))
    assert ngram_join.keep_one(df.limit(0)).count() == 0
    assert sorted(map(str, ((a, c) for a, _, c in got(df.filter("doc_id IS NULL OR doc_id < 3"))))) == sorted(map(str, [(1, 1), (1, 1), (1, 1), (2, 1), (None, 1), (None, None), (None, None), (None, None), (1, 1)]))


def test_a_full_sketch_tells_no_long_lists(spark, monkeypatch):
    """Counters that all hold many shingles deal nothing, so sets without a mate do not reach the exact check."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").union(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).dropDuplicates(["doc_id"])
    want = got(docs)
    checked, plain = [], ngram_join._sets

    def counted(docs, wanted, number):
        checked.append(wanted.distinct().count())
        return plain(docs, wanted, number)

    monkeypatch.setattr(ngram_join, "_sets", counted)
    assert got(docs) == want
    monkeypatch.setattr(ngram_join, "SKETCH", 7)  # 128 counters for some 300,000 shingles
    monkeypatch.setattr(ngram_join, "LONG_LIST", 16)  # every counter holds over a thousand
    assert got(docs) == want
    assert checked[0] < 0.1 * len(want) and checked[1] < 0.25 * len(want)  # dealt by the counters themselves: over nine tenths


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    found = components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "test"), "c").collect()
    assert {(x["node"], x["label"]) for x in found} == {(x, root(x)) for x in parent} and len(found) == len(parent)


def test_shards_are_even_and_gapless(spark):
    rows = [(i % 50, "x" * (i % 7) if i % 5 else None, ["en", None][i % 2], "s", None) for i in range(203)]
    for df in (spark.createDataFrame(rows, SCHEMA), spark.read.parquet(f"{DIR}/documents.parquet"), spark.createDataFrame(rows[:3], SCHEMA), spark.createDataFrame([], SCHEMA)):
        out = sharding.shard(df, sub_rows=16).collect()
        slots = collections.defaultdict(list)
        for r in out:
            slots[r["shard"]].append(r["slot"])
        sizes = [len(slots[k]) for k in range(8)]
        assert sum(sizes) == df.count() and max(sizes) - min(sizes) <= 1
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_written_shards_hold_documents_and_prune(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumns({"shard": F.lit("clash"), "hilbert": F.lit(1), "__sub": F.lit(2)})
    path = Scratch(spark, "test").path("shards")
    assert sharding.write_shards(docs, path, file_rows=40) == "_shard"
    out = spark.read.parquet(path)
    assert out.columns == [*docs.columns, "_shard"]
    assert sorted(map(str, out.drop("_shard").collect())) == sorted(map(str, docs.collect()))
    size = F.floor(F.log2(F.octet_length(F.coalesce("text", F.lit(""))) + 1.0))

    def files_read(rows):
        """Files that a reader of one value must open, by their least and greatest value, over all values of the three dimensions."""
        total = 0
        for c in (size.alias("v"), F.col("lang").alias("v"), F.col("source").alias("v")):
            own = rows.select("file", c).filter("v IS NOT NULL")
            ranges = own.groupBy("file").agg(F.min("v").alias("low"), F.max("v").alias("high")).collect()
            total += sum(r["low"] <= v["v"] <= r["high"] for v in own.select("v").distinct().collect() for r in ranges)
        return total

    curve = out.withColumn("file", F.input_file_name())
    n = curve.select("file").distinct().count()
    assert n > 16
    assert files_read(curve) < 0.6 * files_read(docs.withColumn("file", F.crc32(F.col("doc_id").cast("string").cast("binary")) % n))


def test_hilbert_neighbours_touch():
    table = sharding.hilbert_table(3, 3)
    assert sorted(table) == list(range(512))
    at = {h: ((c >> 6) & 7, (c >> 3) & 7, c & 7) for c, h in enumerate(table)}
    assert all(sum(abs(a - b) for a, b in zip(at[h], at[h + 1], strict=True)) == 1 for h in range(511))


def test_nearest_recall_and_scores(spark):
    df = spark.read.parquet(f"{DIR}/embeddings.parquet")
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in df.collect()}
    odd = spark.createDataFrame([(10**6, None, 0), (10**6 + 1, [0.0] * 64, 0), (10**6 + 2, [float("nan")] * 64, 0), (10**6 + 3, [1.0, None] * 32, 0), (None, [1.0] * 64, 0)], df.schema)
    found = ann.search(df.unionByName(odd)).collect()
    ids = np.array(sorted(rows))
    x = np.stack([rows[i] for i in ids])
    by = collections.defaultdict(list)
    for r in found:
        assert r["score"] == pytest.approx(rows[r["query_id"]] @ rows[r["vec_id"]], abs=1e-12)
        by[r["query_id"]].append((r["rank"], -r["score"], r["vec_id"]))
    hit = total = 0
    assert set(by) == {i for i in rows if i % 20 == 0}
    for q, v in by.items():
        v.sort()
        assert [k for k, *_ in v] == list(range(1, 21)) and v == sorted(v, key=lambda t: (t[1], t[2]))
        s = x @ rows[q]
        s[ids == q] = -9
        hit += len(set(ids[np.lexsort((ids, -np.round(s, 9)))[:20]]) & {i for *_, i in v})
        total += 20
    assert hit / total >= 0.9
    assert ann.search(df.limit(0)).count() == 0


def test_nearest_with_hot_vector_and_lengths(spark):
    r = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 0.0, 0.5] if i < 400 else (r.normal(size=4) * (1 + i % 9)).tolist(), 0) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = ann.search(df, block_rows=64).filter("query_id = 20").orderBy("rank").collect()
    x = np.array([v for _, v, _ in rows], np.float32).astype(float)
    s = x @ x[20]
    s[20] = -99
    assert [f["vec_id"] for f in found] == np.lexsort((np.arange(600), -np.round(s, 9)))[:20].tolist()


def recall(found, x, queries):
    """Share of the true 20 best of ``queries`` (ids are places in ``x``) in ``found``."""
    by = collections.defaultdict(set)
    for r in found:
        by[r["query_id"]].add(r["vec_id"])
    s = x[queries] @ x.T
    s[np.arange(len(queries)), queries] = -np.inf
    return np.mean([len(by[q] & set(np.argsort(-s[i], kind="stable")[:20].tolist())) / 20 for i, q in enumerate(queries)])


def directions(n, dim=64, seed=3):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def vectors(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("codes", [1, 2, 3])
def test_nearest_recall_does_not_depend_on_the_number_of_axes(spark, codes):
    x = directions(2000)
    assert recall(ann.search(vectors(spark, x), codes=codes).collect(), x, range(0, 2000, 20)) >= 0.9


def test_nearest_meets_few_rows_where_neighbours_are_near(spark, monkeypatch):
    centres = directions(400, seed=8)
    x = np.repeat(centres, 25, 0) + 0.05 * directions(10_000, seed=9)
    caught, plain = [], ann._chosen
    monkeypatch.setattr(ann, "_chosen", lambda *a: caught.append(plain(*a)) or caught[-1])
    found = ann.search(vectors(spark, x)).collect()
    assert recall(found, x, range(0, 10_000, 20)) >= 0.95
    hashed, probes = caught[0]
    u, met = ann.unit(x), np.zeros((500, 10_000), bool)
    for t in range(hashed.tables):
        met |= (hashed.probes(u[::20], t, probes)[:, :, None] == hashed.hashes(u, t)[None, None, :]).any(1)
    assert met.mean() < 0.1


def test_nearest_of_vectors_of_any_length_and_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (1, [3e300, 1.0]), (2, [1.0, 2e300]), (3, [2.0, 0.0]), (3, [4.0, 0.0]), (4, [1e-200, 1e-200]), (5, [0.0, 0.0]), (6, [5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit("x"), "v": F.lit(1), "norm": F.lit("n")})
    found = sorted((r["rank"], r["vec_id"], r["score"]) for r in ann.search(df).collect())
    assert found == [(1, 1, 3e300), (2, 3, 4.0), (3, 2, 1.0), (4, 4, 1e-200)]


@pytest.mark.parametrize("spread", [False, True])
def test_nearest_recall_with_spread_lengths(spark, spread):
    x = directions(2001)
    x = x * np.exp(np.random.default_rng(4).normal(size=(2001, 1))) if spread else x * np.where(np.arange(2001) == 2000, 20.0, 1.0)[:, None]
    found = ann.search(vectors(spark, x), F.col("id").between(0, 99)).collect()
    assert len(found) == 100 * 20
    assert recall(found, x, range(100)) >= 0.95


def test_nearest_of_long_rows_is_hashed_by_bands(spark, monkeypatch):
    """Lengths over many doublings: every band with more rows than a block has tables of its own, the others are met whole."""
    x = directions(6000, 16) * np.exp(1.5 * np.random.default_rng(6).normal(size=(6000, 1)))
    caught, plain = [], ann._chosen
    monkeypatch.setattr(ann, "_chosen", lambda *a: caught.append(a[3]) or plain(*a))
    found = ann.search(vectors(spark, x), F.col("id") % 60 == 0, block_rows=128).collect()
    assert len(found) == 100 * 20 and recall(found, x, range(0, 6000, 60)) >= 0.9
    assert len(caught) >= 2 and sum(caught) > 5800 and min(caught[1:]) > 128


def test_nearest_recall_on_many_rows(spark):
    """50,000 rows in no order that helps: the measured setting holds there as well."""
    x = directions(50_000, 32, seed=12)
    found = ann.search(vectors(spark, x), F.col("id") % 500 == 0).collect()
    assert len(found) == 100 * 20 and recall(found, x, range(0, 50_000, 500)) >= 0.9


def test_nearest_finds_all_of_few_rows(spark):
    x = directions(15)
    found = ann.search(vectors(spark, x), F.lit(True)).collect()
    assert sorted((r["query_id"], r["vec_id"]) for r in found) == [(a, b) for a in range(15) for b in range(15) if a != b]
    assert ann.search(vectors(spark, x[:1])).count() == 0


def test_archives_round_trip(spark, monkeypatch):
    page = "<html>ü" + "x" * 200
    rows = [(5, "http://a/ b", page), (3, None, page), (9, "http://c", page), (1, "u", None), (2, "u", ""), (4, "é", "short"), (6, "e", "short"), (None, "n", page + "!"), (7, "w", "a\r\n\r\nWARC/1.1\r\n\r\n" * 20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record", F.lit(1))
    path = Scratch(spark, "test").path("warc")
    warc.write_archives(df, path)
    out = {r["page_id"]: r for r in warc.read_archives(spark, path).collect()}
    assert len(out) == len(rows)
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (out[i]["payload_bytes"], out[i]["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert {i: r["refers_to"] for i, r in out.items() if r["record_type"] == "revisit"} == {5: 3, 9: 3}
    assert len({r["record_id"] for r in out.values()}) == len(rows)
    assert {i: r["url"] for i, r in out.items()} == {i: {None: "unknown:", "http://a/ b": "http://a/%20b", "é": "%C3%A9"}.get(u, u) for i, u, _ in rows}
    assert {out[i]["refers_to_id"] for i in (5, 9)} == {out[3]["record_id"]} and out[1]["refers_to_id"] is None
    popular = Scratch(spark, "test").path("popular")
    monkeypatch.setattr(warc, "POPULAR", 1)
    warc.write_archives(df, popular, compression="none")
    assert sorted(map(str, warc.read_archives(spark, popular).collect())) == sorted(map(str, out.values()))
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(popular).collect()
    assert sum(bytes(r["content"]).count(b"WARC-Refers-To-Target-URI: unknown:\r\nWARC-Refers-To-Date: 2024-01-01T00:00:00Z") for r in raw) == 2
    warc.write_archives(df.limit(0), f"{popular}-none")
    assert warc.read_archives(spark, f"{popular}-none").count() == 0


def test_archives_are_cut_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "CLASSES", (1000, 50_000, 1 << 62))
    rows = [(k, "u", "x" * (3 if k % 3 else 20_000) + str(k)) for k in range(60)] + [(99, "u", "y" * 100_000)]
    path = Scratch(spark, "test").path("cut")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path, compression="none", file_bytes=120_000)
    sizes = [r["length"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path).select("length").collect()]
    assert max(sizes) < 120_000 and len(sizes) > 10
    assert sorted((r["page_id"], r["payload_bytes"]) for r in warc.read_archives(spark, path).collect()) == sorted((i, len(t)) for i, _, t in rows)


def test_arc_files_from_disk(spark, tmp_path):
    pages = [("http://a/ü?q=1 2", b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody \xff\r\n\r\n"), ("http://b/%20", b""), ("http://c", b"x" * 500)]
    (tmp_path / "one.arc").write_bytes(warc.arc_image("one.arc", 1, pages))
    image = warc.arc_image("two.arc.gz", 2, pages, "19991231")
    (tmp_path / "two.arc.gz").write_bytes(gzip.compress(image[:300]) + gzip.compress(image[300:]))  # members as crawlers write them
    found = warc.read_arcs(spark, str(tmp_path)).orderBy("archive", "place").collect()
    urls = ["http://a/%C3%BC?q=1%202", "http://b/%20", "http://c"]
    assert [(r["archive"], r["url"], bytes(r["content"])) for r in found] == [(n, u, c) for n in ("one.arc", "two.arc.gz") for u, (_, c) in zip(urls, pages, strict=True)]
    assert {r["date"] for r in found} == {"2024-01-01T00:00:00Z", "1999-12-31T00:00:00Z"}
    out = Scratch(spark, "test").path("converted")
    warc.convert_archives(spark, str(tmp_path), out)
    rows = warc.read_archives(spark, out, "string").orderBy("page_id").collect()
    payloads = [b"body \xff\r\n\r\n", b"", b"x" * 500]  # what has no HTTP header is payload as a whole
    assert [(r["page_id"], r["payload_digest"], r["record_type"]) for r in rows] == [(f"{n}#{k}", hashlib.sha256(c).hexdigest(), "resource" if k else "response") for n in ("one.arc", "two.arc.gz") for k, c in enumerate(payloads)]


def test_archives_as_crawlers_left_them(spark, tmp_path, monkeypatch):
    """Hand-written files: bare line feeds, name server answers, padding, spaces in fields, broken records, cut files."""
    block = b"1 1 InternetArchive\nURL IP-address Archive-date Content-type Archive-length\n<xml/>\n"
    head = b"filedesc://x.arc 0.0.0.0 20010203040506 text/plain %d\n" % len(block) + block
    lf = b"HTTP/1.0 200 OK\nServer: old\n\nbody\n\nmore"
    mixed = b"HTTP/1.1 404 Not Found\r\nX: y\n\r\ngone"
    dns = b"20010203040506\nexample.org. 3600 IN A 192.0.2.1\n"
    whole = b"HTTP/1.0 200 OK\r\nno end of header"

    def record(line, content):
        return line % len(content) + b"\n" + content + b"\n"

    good = [
        (record(b"http://a/ 192.0.2.7 20010203040506 text/html; charset=utf-8 %d", lf), "http://a/", "text/html; charset=utf-8", b"body\n\nmore", "response"),
        (record(b"dns:example.org 2001:db8::1 20010203040506 text/dns %d", dns), "dns:example.org", "text/dns", dns, "resource"),
        (record(b"http://a/b c d 192.0.2.7 20010203 no-type %d", mixed), "http://a/b%20c%20d", "no-type", b"gone", "response"),
        (record(b"http://w/ - 20010203040506  %d", whole), "http://w/", "", b"", "response"),
        (record(b"http://e/ 0.0.0.0 20010203040506 text/html %d", b""), "http://e/", "text/html", b"", "resource"),
    ]
    junk = b"this is no record line\nnor this\n"
    image = head + b"\n\n" + good[0][0] + b"\r\n\0\0\n" + good[1][0] + junk + good[2][0] + good[3][0].rstrip(b"\n") + b"\n" + good[4][0] + b"\n\n\0\0\0"
    cut = head + b"\n" + good[0][0] + b"http://cut/ 0.0.0.0 20010203040506 text/html 5000\nHTTP/1.0 200 OK\n\nshort"
    two = b"2 0 Archive\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    v2 = b"filedesc://y.arc 0.0.0.0 20010203040506 text/plain 200 - - 0 y.arc %d\n" % len(two) + two + b"\n" + b"http://v/ q 192.0.2.7 20010203040506 text/html; charset=x 200 abc - 99 y.arc %d\n" % len(lf) + lf + b"\n"
    written = {"a.arc": image, "b.arc": cut, "c.arc": b"no archive", "d.arc": b"", "e.arc": v2, "f.arc.gz": gzip.compress(image) + b"\0\0", "g.arc.gz": gzip.compress(image)[:-20] , "h.arc.gz": gzip.compress(cut) + b"rubbish"}
    for name, data in written.items():
        (tmp_path / name).write_bytes(data)
    rows = warc.read_arcs(spark, str(tmp_path)).orderBy("archive", "place").collect()
    own = lambda name: [r for r in rows if r["archive"] == name]
    for name in ("a.arc", "f.arc.gz"):
        assert [(r["url"], r["content_type"]) for r in own(name) if r["error"] is None] == [(u, t) for _, u, t, _, _ in good]
        assert [bytes(r["content"]) for r in own(name) if r["error"]] == [junk]
    assert [(r["url"], r["error"]) for r in own("b.arc")] == [("http://a/", None), (None, "a record is shorter than its declared length")]
    assert [r["error"] for r in own("c.arc")] == ["no version block of ARC 1 or 2"] and own("d.arc") == []
    assert [(r["url"], r["content_type"], r["date"]) for r in own("e.arc")] == [("http://v/%20q", "text/html; charset=x", "2001-02-03T04:05:06Z")]
    assert own("g.arc.gz")[-1]["error"] == "gzip: the last member is cut off" and own("h.arc.gz")[-1]["error"].startswith("gzip: ") and own("h.arc.gz")[0]["url"] == "http://a/"
    out = Scratch(spark, "test").path("left")
    monkeypatch.setattr(warc, "CLASSES", (600, 700, 1 << 62))
    warc.convert_archives(spark, str(tmp_path), out, file_bytes=1500, compression="none")
    found = {r["page_id"]: r for r in warc.read_archives(spark, out, "string").collect()}
    places = [0, 1, 3, 4, 5]  # the junk took place 2
    for name in ("a.arc", "f.arc.gz"):
        assert [(found[f"{name}#{k}"]["payload_digest"], found[f"{name}#{k}"]["record_type"]) for k in places] == [(hashlib.sha256(p).hexdigest(), t) for _, _, _, p, t in good]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(out).collect()
    assert max(len(r["content"]) for r in files) < 1600 and len(files) > 8 and any(b"Content-Type: text/dns\r\n" in bytes(r["content"]) for r in files)


@pytest.mark.parametrize("version", [1, 2])
def test_arc_records_end_where_they_declare(version):
    pages = [("http://a", b"x\ny 5\n"), ("http://b", b""), ("http://c", b"HTTP/1.1 200 OK\r\n\r\nbody")]
    found = list(warc.read_arc(warc.arc_image("f.arc", version, pages)))
    assert [(h["URL"], bytes(c)) for _, h, c in found] == pages
    with pytest.raises(ValueError):
        list(warc.read_arc(warc.arc_image("f.arc", version, pages)[:-4]))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = registry.queries()[name](spark, DIR)
    found = db.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(r[n] for n in names) for r in df.collect()))) == sorted(map(str, found.fetchall()))


def test_pipeline_of_odd_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    good = [r["text"] for r in docs.join(labels.filter("quality = 1"), "doc_id").filter("lang = 'en' AND n_chars > 2000").orderBy("doc_id").limit(4).collect()]
    rows = [(1, good[0]), (1, good[0]), (2, good[0]), (None, good[1]), (None, good[1]), (None, good[2]), (7, good[3]), (7, good[2]), (8, None), (9, ""), (10, "x" * 200_000)]
    for name, df in (("none", docs.limit(0)), ("odd", spark.createDataFrame([(i, t, "en", None, None, "k") for i, t in rows], SCHEMA + ", __row string"))):
        df.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.limit(0).write.parquet(str(tmp_path / name / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    out = corpus_pipeline.run(spark, str(tmp_path / "odd")).filter("start = 0").collect()  # without labels the classifier keeps all
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in out if r["doc_id"] is not None) == [(False, 1), (False, 7), (False, 7)]
    assert sum(r["doc_id"] is None for r in out) == 1  # the text of another row with an id goes first


def test_pipeline_matches_plain_stages(spark):
    from tideline.llm import packing, quality_model, quality_rules

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = corpus_pipeline.run(spark, DIR)
    ids = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    good = {r["doc_id"] for r in quality_model.score(docs, labels).filter("predicted = 1").collect()}
    ruled = {r["doc_id"] for r in quality_rules.measure(docs).filter("kept").collect()} & good
    want = {i for i, _, least in plain_join([(i, texts[i]) for i in sorted(ruled)]) if i == least}
    assert ids == want
    assert sum(r["length"] for r in out.collect()) == sum(r["doc_tokens"] for r in out.filter("start = 0").collect())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "quality rules", "n-gram Jaccard join", "packing"]
    assert packing.LENGTH == 4096

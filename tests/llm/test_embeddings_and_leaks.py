"""Whitening, hard negatives and decontamination against brute force."""

import hashlib
import re

import duckdb
import numpy as np
import pytest

from tideline.llm import decontamination, hard_negatives, registry, whitening

DIR = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label int"


def table(spark, rows, schema=VECTORS, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


def plain_whitening(x, components=32):
    """(n * x - S, whitened, shares) by an eigendecomposition of the covariance."""
    n, apart = len(x), len(x) * x - x.sum(0)
    c = apart / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    return apart, c @ u[:, :components] / np.sqrt(e[:components]), e[:components] / e.sum()


@pytest.mark.parametrize("batch", [4096, 50])
def test_whitening_matches_eigenvectors(spark, monkeypatch, batch):
    monkeypatch.setattr(whitening, "BATCH", batch)
    monkeypatch.setattr(whitening, "FAN", 2)
    got = registry.queries()["op11_whitening"](spark, DIR).toPandas()
    rows = spark.read.parquet(f"{DIR}/embeddings.parquet").collect()
    x = np.floor(64 * np.array([r["embedding"] for r in rows], float)).astype(np.int64) + 1_000_000
    apart, z, shares = plain_whitening(x)
    ids = [r["vec_id"] for r in rows]
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    assert np.abs(wide - z * np.sign((wide * z).sum(0))).max() < 1e-9
    first = got[got.component == 1].set_index("vec_id").loc[ids]
    assert (first.deviation.to_numpy() == (apart * apart).sum(1)).all() and set(got.n) == {len(x)}
    assert np.allclose(got.groupby("component").explained.first(), shares, rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9


def test_merging_loses_nothing():
    r = np.random.default_rng(5)
    x = whitening.whole(r.normal(size=(700, 9)) * np.arange(1, 10) + 1e4)
    whole = whitening.Scatter.of(x)
    for cuts in ([1, 2, 3], [350], [5, 300, 699]):
        parts = [whitening.Scatter.of(p) for p in np.split(x, cuts)]
        held = parts[0]
        for p in parts[1:]:
            held = held.merged(p)
        assert held.n == 700 and (held.sums == whole.sums).all()
        assert np.allclose(held.factor.T @ held.factor, whole.factor.T @ whole.factor, rtol=1e-9)


def test_whitening_of_odd_tables(spark):
    def run(rows, schema=VECTORS):
        vectors, dim = whitening.vectors_of(table(spark, rows, schema), "vec_id", "embedding")
        model = whitening.fit(vectors, dim)
        return [] if model is None else sorted(((r["id"], r["deviation"], list(r["whitened"])) for r in whitening.whiten(vectors, dim, model).collect()), key=str)

    assert run([]) == [] and run([(1, [1.0, 2.0], 0)]) == []
    assert run([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 1)]) == []  # equal rows: no variance
    odd = [(3, None, 0), (4, [], 0), (5, [1.0, None], 0), (6, [float("nan"), 0.0], 0), (7, [float("inf"), 0.0], 0), (8, [1.0, 2.0, 3.0], 0)]
    usual = [(1, [0.0, 1.0], 0), (2, [1.0, 1.0], 0), (2, [1.0, 1.0], 0), (None, [3.0, 1.0], None)]
    got = run(usual + odd)
    assert [g[0] for g in got] == [1, 2, 2, None] and all(len(g[2]) == 1 for g in got)  # one entry never changes: one component
    x = np.array([0, 64, 64, 192])
    assert [g[1] for g in got] == ((4 * x - x.sum()) ** 2).tolist()
    assert np.allclose([abs(g[2][0]) for g in got], np.abs(x - x.mean()) / x.std())
    huge = run([(1, [1e30], 0), (2, [-1e30], 0), (3, [1e300], 0)])  # entries are cut off, the deviation fits no long
    assert [(g[0], g[1]) for g in huge] == [(1, None), (2, None), (3, None)] and huge[0][2] == huge[2][2] != huge[1][2]
    named = "vec_id long, embedding array<double>, label int, id string, v string, n string, sums string"
    assert [g[0] for g in run([(k, [float(k), 1.0], 0, "a", "b", "c", "d") for k in range(3)], named)] == [0, 1, 2]


def plain_negatives(rows):
    """Brute force over (id, vector, label), each id once."""
    rows = [(i, [int(np.floor(256 * c)) for c in v], y) for i, v, y in rows]
    out = []
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True))
    for i, v, y in rows:
        if i % 100:
            continue
        scored = sorted((-dot(v, w), j, z) for j, w, z in rows if j != i)
        for s, p, _ in [t for t in scored if t[2] == y][:5]:
            fits = [t for t in scored if t[2] != y and 80 * -s <= 100 * -t[0] <= 100 * -s][:5]
            out += [(i, p, k + 1, j, -s, -t) for k, (t, j, _) in enumerate(fits)]
    return sorted(out)


def mined(df, **more):
    from pyspark.sql import functions as F

    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("id") % 100 == 0, **more).collect())


@pytest.mark.parametrize("leaf", [2048, 40])
def test_negatives_match_sql(spark, monkeypatch, leaf):
    monkeypatch.setattr(hard_negatives, "LEAF", leaf)
    monkeypatch.setattr(hard_negatives, "ANCHOR_LEAF", 2)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DIR}/embeddings.parquet'")
    theirs = sorted(db.execute(hard_negatives.ORACLE_SQL).fetchall())
    rows = spark.read.parquet(f"{DIR}/embeddings.parquet")
    label = "IF(vec_id % 7 = 0, (label + 1) % 10, label)"
    got = mined(rows.selectExpr("vec_id", "embedding", f"{label} AS label"), leaf_rows=leaf)
    assert got == theirs and len(got) > 50
    assert sorted(tuple(r) for r in registry.queries()["op12_hard_negatives"](spark, DIR).collect()) == theirs


def test_negatives_of_clusters_and_hot_vectors(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHOR_LEAF", 3)
    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 8)) * 3
    rows = [(k, (centres[k % 12] + 0.1 * r.normal(size=8)).tolist(), int(r.integers(3))) for k in range(1500)]
    rows = [(k, [1.0] * 8 if k % 3 == 1 else v, y) for k, v, y in rows]  # one vector for a third of the rows: ties
    got = mined(table(spark, rows), leaf_rows=50, block_rows=64)
    assert got == plain_negatives(rows) and len(got) > 100
    assert mined(table(spark, rows), leaf_rows=10**6, block_rows=64) == got


def test_walk_prunes_and_keeps_every_pair_in_reach():
    r = np.random.default_rng(8)
    centres = r.normal(size=(20, 6)) * 40
    x = np.round(np.concatenate([c + r.normal(size=(60, 6)) for c in centres]))
    y = x[::10]
    trees, sizes = [], []
    for rows, leaves in ((y, 20), (x, 40)):
        t = hard_negatives.Tree(rows, leaves)
        leaf = t.leaves_of(rows)
        n, radius, length = (np.zeros(len(t.parent)) for _ in range(3))
        for node, row in zip(leaf, rows, strict=True):
            while node >= 0:
                n[node] += 1
                radius[node] = max(radius[node], np.linalg.norm(row - t.centres[node]))
                length[node] = max(length[node], np.linalg.norm(row))
                node = t.parent[node]
        trees.append((t, leaf))
        sizes.append((n, radius, length))
    (a, a_leaf), (c, c_leaf) = trees
    scores = y @ x.T
    low = np.sort(scores, 1)[:, -5]
    floor = np.full(len(a.parent), np.inf)
    np.minimum.at(floor, a_leaf, low)
    floor = a.up(floor, np.minimum)
    got = [hard_negatives.walk(top, a, sizes[0], c, sizes[1], floor, np.full(len(floor), np.inf)) for top in a.tops(8)]
    pairs = {(i, j) for p, q in got for i, j in zip(p.tolist(), q.tolist(), strict=True)}
    assert sum(len(p) for p, _ in got) == len(pairs) < 0.25 * a.leaf.sum() * c.leaf.sum()
    assert {(a_leaf[i], c_leaf[j]) for i, j in zip(*np.nonzero(scores >= low[:, None]), strict=True)} <= pairs


def test_negatives_of_odd_tables(spark):
    assert mined(table(spark, [])) == [] and mined(table(spark, [(100, [1.0], 1)])) == []
    odd = [(None, [1.0, 0.0], 1), (200, None, 1), (300, [1.0, None], 1), (400, [float("nan"), 1.0], 1), (500, [float("inf"), 1.0], 2), (600, [1.0, 1.0], None), (700, [1.0], 1), (800, [], 1), (900, [1e30, 1.0], 1)]
    usual = [(100, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [1.0, 0.5], 2), (3, [1.0, 0.4], 2), (4, [-1.0, 0.0], 2), (1000, [-1.0, -1.0], 3), (5, [1.0, 1.0], 3)]
    assert mined(table(spark, usual + odd)) == plain_negatives(usual) == [(100, 1, 1, 2, 81920, 81920), (100, 1, 2, 3, 81920, 78592)]
    # An anchor repeated in all columns is one; a repeated candidate counts twice; other rows of the anchor's id are not its positives.
    twice = [(100, [1.0], 1), (100, [1.0], 1), (100, [2.0], 1), (1, [1.0], 1), (2, [1.0], 2), (2, [1.0], 2)]
    assert mined(table(spark, twice)) == [(100, 1, 1, 2, 65536, 65536), (100, 1, 1, 2, 131072, 131072), (100, 1, 2, 2, 65536, 65536), (100, 1, 2, 2, 131072, 131072)]
    large = [(100, [2.0**19], 1), (1, [2.0**19], 1), (2, [2.0**19 - 2.0**-8], 2)]  # products beyond 2^53
    assert mined(table(spark, large)) == [(100, 1, 1, 2, 2**54, 2**54 - 2**27)]
    named = "vec_id long, embedding array<double>, label int, id string, v string, block string, leaf string"
    assert mined(table(spark, [(*r, "a", "b", "c", "d") for r in usual], named)) == plain_negatives(usual)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_report(docs, items, size=10):
    out = []
    for k, text in docs:
        w, hit, names = plain_words(text), set(), set()
        for name, own in items:
            v = plain_words(own)
            n = min(size, len(v))
            wins = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    names.add("" if name is None else str(name))
        out.append((k, len(w), len(hit), sorted(names)))
    return sorted(out, key=str)


DOC, ITEM = "doc_id long, text string, lang string, source string, n_chars long", "item_id long, text string"


def reported(spark, docs, items, **more):
    d = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in docs], DOC).repartition(3)
    found = decontamination.report(d, spark.createDataFrame(items, ITEM), **more)
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in found.collect()), key=str)


def odd_texts():
    r = np.random.default_rng(2)
    names = ["eins", "zwei", "drei", "Vier", "fünf", "6", "日本", "a"]
    say = lambda n: " ".join(r.choice(names, n))
    items = [(k, say(n)) for k, n in enumerate([12, 10, 9, 4, 1, 25, 30])] + [(7, None), (8, ""), (9, "- ?! _"), (None, say(11)), (3, say(4)), (10, "unheard of words here")]
    docs = [(k, say(int(n))) for k, n in enumerate(r.integers(0, 60, 40))]
    docs += [(100 + k, f"{say(5)}; {(t or '').upper()} -- {say(3)}, {t}") for k, (_, t) in enumerate(items)]
    return [*docs, (None, None), (1, ""), (1, "\t\n"), (7, docs[3][1]), (8, "x" * 5000), (9, "Ａ ＢA b É ß \U0001f600 " + items[0][1])], items


@pytest.mark.parametrize("more", [{}, {"most_windows": 5}, {"most_bytes": 2000}, {"size": 4}])
def test_report_matches_plain_scan(spark, monkeypatch, more):
    monkeypatch.setattr(decontamination, "PIECE", 30)
    docs, items = odd_texts()
    got = reported(spark, docs, items, **more)
    assert got == plain_report(docs, items, more.get("size", 10)) and sum(g[2] > 0 for g in got) > 10


def test_report_of_equal_hashes(spark, monkeypatch):
    """Every window is compared word by word, so equal hashes do no harm."""
    monkeypatch.setattr(decontamination.WindowSet, "hashed", lambda self, ids, at, n: np.zeros(len(at), np.uint64))
    docs, items = odd_texts()
    made = decontamination.WindowSet([(b" ".join(own), [str(k)]) for k, t in items for s in decontamination.item_windows((t or "").encode(), 10) for own in [w.split(b" ") for w in s]])
    for (_, t), (_, n, h, names) in zip(docs, [plain_report([d], items)[0] for d in docs], strict=True):
        [(words, runs, found)] = made.scan([(t or "").encode()])
        assert (words, int((runs[:, 1] - runs[:, 0]).sum())) == (n, h)
        assert {x or "None" for x in names} == set(found)


def test_query_matches_sql(spark):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = registry.queries()["op13_decontamination"](spark, DIR)
    theirs = db.execute(registry.oracle_sql()["op13_decontamination"])
    assert [d[0] for d in theirs.description] == df.columns
    got = sorted(tuple(r) for r in df.collect())
    assert got == sorted(theirs.fetchall()) and any(r[-1] for r in got)
    empty = hashlib.sha256(b"").hexdigest()
    assert {r[4] for r in got if not r[5]} == {empty}


@pytest.mark.parametrize("more", [{}, {"most_windows": 1}])
def test_removal(spark, more):
    items = spark.createDataFrame([(1, "the secret answer is forty two"), (2, "one two three")], ITEM)
    schema = "text string, runs string, h string, items string, doc_id long, __text string"
    rows = [("Before. The SECRET, answer is forty-two; after", "r", "h", "i", 1, "t"), ("One two three one two three?", "r", "h", "i", 2, "t"), ("clean text", "r", "h", "i", 3, "t"), (None, "r", "h", "i", 4, "t"), ("clean text", "r", "h", "i", 3, "t")]
    docs = spark.createDataFrame(rows, schema)
    left = decontamination.decontaminate(docs, items, **more)
    assert left.schema == docs.schema and sorted(map(str, left.collect())) == sorted(map(str, docs.filter("doc_id > 2").collect()))
    spans = decontamination.decontaminate(docs, items, "spans", **more)
    assert sorted((r["doc_id"], r["text"], r["__text"]) for r in spans.collect() if r["text"] is not None) == [(1, "Before. ; after", "t"), (2, "?", "t"), (3, "clean text", "t"), (3, "clean text", "t")]
    with pytest.raises(ValueError):
        decontamination.decontaminate(docs, items, "words")


def test_no_benchmark_and_no_documents(spark):
    assert reported(spark, [(1, "a b c")], []) == [(1, 3, 0, [])]
    docs = spark.createDataFrame([], DOC)
    assert decontamination.report(docs, spark.createDataFrame([(1, "a")], ITEM)).count() == 0
    assert decontamination.decontaminate(docs, spark.createDataFrame([(1, "a")], ITEM)).schema == docs.schema

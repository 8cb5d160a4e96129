"""Encoding, packing, language model, classifiers and rules on small tables."""

import base64
import hashlib
import pickle
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers
import xxhash
from pyspark.sql import functions as F

from tideline.llm import byte_bpe, language_model, packing, quality_model, quality_rules, toxicity
from tideline.llm.common import words

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"
LONG = "Some wörds, repeated. " * 4000
TEXTS = [None, "", " \n\t ", "one", "It's 5 o'clock; naïve café — ﬁne…\n\n  two  spaces\there", "İstanbul ΣΑΣ été x<|endoftext|>y", LONG, LONG, "a" * 3000, "日本語 テキスト 123456"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None, "s", None, "x") for i, t in enumerate(TEXTS)] + [(None, "null id here", "en", None, 3, None), (3, "one", "en", "s", 3, "x")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def test_bpe_is_that_of_the_library(odd, docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for table in (odd, docs.limit(60)):
        texts = {(r["doc_id"], r["text"]) for r in table.collect()}
        want = sorted((len(ids := library.encode_ordinary(t or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for _, t in texts)
        got = sorted({(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in byte_bpe.round_trip(table).collect()}, key=lambda r: r[1:])
        assert [g[1:] for g in got] == want


def test_bpe_encode_and_decode_are_tables(odd):
    ids = byte_bpe.encode(odd.filter("doc_id IS NOT NULL"))
    assert {(r["doc_id"], bytes(r["bytes"]).decode()) for r in byte_bpe.decode(ids).collect()} == {(i, t or "") for i, t in enumerate(TEXTS)}


def test_bpe_of_long_pieces(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = np.random.default_rng(7)
    letters = list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ")
    texts = ["".join(map(chr, r.integers(0x4E00, 0x9FA5, 20_000))), "".join(r.choice(letters, 6000)), " " * 20_000 + "x", "=" * 5001, "aab" * 3000 + "ab" * 3001]
    texts += ["".join(r.choice(list("ab"), r.integers(40, 400))) for _ in range(200)]
    own = byte_bpe.codec(*byte_bpe._named(None, None))
    got = own.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode_ordinary(t) for t in texts]
    assert [x.decode() for x in own.decode(got)] == texts


def test_bpe_of_very_long_pieces_writes_nothing(tmp_path, monkeypatch):
    """Pieces of 200,000 letters and such that merges reach all over, in a folder that nobody may write to."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = np.random.default_rng(9)
    texts = ["".join(r.choice(list(x), n)) for x, n in (("abcdefghijklmnopqrstuvwxyz", 200_000), ("etaoinshr", 40_000), ("the", 20_000), ("=-", 30_000))]
    texts += ["".join(r.choice(["the", "tion", "ing", "ment", "über", "para"], 20_000)), "ab" * 100_000, "internationalization" * 3000]
    tmp_path.chmod(0o555)
    monkeypatch.chdir(tmp_path)
    own = byte_bpe.Codec(*byte_bpe._named(None, None))
    began = time.perf_counter()
    got = own.encode(texts)
    assert time.perf_counter() - began < 30
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode_ordinary(t) for t in texts]
    assert own.decode(got) == [t.encode() for t in texts] and not list(tmp_path.iterdir())
    assert own.db.execute("SELECT current_setting('temp_directory')").fetchone()[0] in (None, "")


def test_bpe_with_another_pattern_and_odd_tables(docs):
    pattern = r"\S+|\s+"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    few = docs.limit(15).withColumns({"n_tokens": F.lit("clash"), "ids": F.lit(1)})
    rows = byte_bpe.encode(few, public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern).collect()
    texts = {r["doc_id"]: r["text"] for r in few.collect()}
    assert {r["doc_id"]: r["ids"] for r in rows} == {i: library.encode_ordinary(t or "") for i, t in texts.items()}
    assert byte_bpe.round_trip(few).count() == 15 and byte_bpe.round_trip(docs.limit(0)).count() == 0


def test_packing_cuts_every_id_once(odd, docs):
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    for table in (odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), docs):
        want = {r["doc_id"]: np.array(t.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4") for r in table.collect()}
        rows = packing.pack(table).collect()
        seen = {}
        for r in rows:
            ids = want[r["doc_id"]]
            assert r["doc_tokens"] == len(ids) and zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
            seen.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        for i, pieces in seen.items():
            at = 0
            for start, n in sorted(pieces):
                assert start == at
                at += n
            assert at == len(want[i])
        assert seen.keys() == want.keys()
        room = {}
        for r in rows:
            room.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        sizes = {}
        for k, pieces in room.items():
            at = 0
            for offset, n in sorted(pieces):
                assert offset == at
                at += n
            sizes[k] = at
        assert sorted(sizes) == list(range(len(sizes))) and all(sizes[k] == 4096 for k in range(len(sizes) - 1)) and max(sizes.values()) <= 4096


def test_packing_words_go_to_the_library_by_hundreds(monkeypatch):
    """Different words, with punctuation behind them or without, take few calls, and have the library's ids, also when parts are forgotten."""
    path = public_tokenizers.path("word_bpe_49k.json")
    t = tokenizers.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    calls = []

    class Counted:
        def __init__(self, library):
            self.library = library

        def __getattr__(self, name):
            calls.append(name)
            return getattr(self.library, name)

    own = packing.Tokens(path)
    for name in ("tokenizer", "model", "words"):
        if hasattr(own, name):
            setattr(own, name, Counted(getattr(own, name)))
    rng = np.random.default_rng(4)
    words = ["".join(x) for x in rng.choice(list("aeinorstzÉéßſ"), (4000, 7))]
    texts = [" ".join(w + mark for w, mark in zip(words[k : k + 500], rng.choice(["", "", ",", ".", "***", "'"], 500), strict=True)) for k in range(0, 4000, 500)]
    assert [x.tolist() for x in own.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert len(calls) < 100
    monkeypatch.setattr(packing, "CACHE", 100)
    letters = list("aeZéÉİıµª'stl.,!?-$<>|/w0 \n\t\x0b\x1c\x85\u0338\u0300Σς中")
    texts = [None, "", "  ", "<|endoftext|>, x<|startoftext|>", " it's, WE'LL! dogs' 's </w> a</w>,"] + ["".join(rng.choice(letters, n)) for n in rng.integers(1, 30, 3000)]
    for k in range(0, len(texts), 300):
        assert [x.tolist() for x in own.encode(texts[k : k + 300])] == [t.encode(x or "", add_special_tokens=False).ids for x in texts[k : k + 300]]
    assert len(own.codes) < len({w for x in texts for w in (x or "").lower().encode().split()})


def test_packing_with_another_tokenizer_and_odd_columns(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = tokenizers.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    few = docs.limit(30).withColumns({"hilbert": F.lit("x"), "ids": F.lit(1), "n": F.lit(2), "__cell": F.lit(3)})
    few = few.unionByName(few.filter("doc_id < 5"))  # repeated rows
    whole = {}
    for r in packing.pack_ids(few, path).orderBy("doc_id", "start").collect():
        whole.setdefault(r["doc_id"], {}).setdefault(r["start"], set()).add(tuple(r["ids"]))
    for r in few.collect():
        want = (*t.encode(r["text"] or "", add_special_tokens=False).ids, 2)
        assert all(piece == want[at : at + len(piece)] for at, pieces in whole[r["doc_id"]].items() for piece in pieces)
    out = packing.pack(few, path).collect()
    assert sum(r["length"] for r in out) == sum(len(t.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in few.collect())


def test_packing_keeps_ids_and_empty_tables(docs):
    few = docs.limit(5)
    assert all(len(r["ids"]) == r["length"] for r in packing.pack_ids(few).collect())
    assert packing.pack(docs.limit(0)).count() == 0


def test_language_model_counts_and_beats_counts(docs, odd):
    rows = {r["doc_id"]: r for r in language_model.score(docs).collect()}
    texts = {r["doc_id"]: [*words(r["text"]), b"\n"] for r in docs.collect()}
    train = [w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t]
    counts = {}
    for w in train:
        counts[w] = counts.get(w, 0) + 1
    for i, t in texts.items():
        r = rows[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(w in counts for w in t), len(train))
        assert r["base_score"] == pytest.approx(sum(np.log10((counts.get(w, 0) + 1) / (len(train) + len(counts) + 1)) for w in t), rel=1e-9)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
    held = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert language_model.score(odd).count() == odd.count() and language_model.score(odd.limit(0)).count() == 0


def test_language_model_scores_are_those_of_plain_loops(spark, docs, odd, monkeypatch):
    caught, plain = [], language_model.train
    monkeypatch.setattr(language_model, "train", lambda *a: caught.append(plain(*a)) or caught[-1])
    monkeypatch.setattr(language_model, "BUCKET_WORDS", 500)
    for common in (1 << 16, 40):  # with few common words the others travel through many buckets
        monkeypatch.setattr(language_model, "COMMON", common)
        table = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text").filter("doc_id > 3").withColumn("doc_id", F.col("doc_id") + 10**6)).withColumns({"chunk": F.lit("x"), "words": F.lit(1)})
        rows = {r["doc_id"]: r for r in language_model.score(table, chunk_bytes=40_000).collect()}
        texts = {r["doc_id"]: [*words(r["text"]), b"\n"] for r in table.collect()}
        counts = {}
        for i, t in texts.items():
            if zlib.crc32(str(i).encode()) % 7 != 2:
                for w in t:
                    counts[w] = counts.get(w, 0) + 1
        model = caught[-1]
        n, classes = model.words, {w: model.class_of(w) for t in texts.values() for w in t}
        assert sorted(model.index) == sorted(sorted(counts, key=lambda w: (-counts[w], np.uint64(xxhash.xxh3_64_intdigest(w)).view(np.int64)))[: language_model.SHORTLIST])
        sums, kinds = {}, {}
        for w, c in counts.items():
            k = model.class_of(w)
            sums[k], kinds[k] = sums.get(k, 0) + c, kinds.get(k, 0) + 1
        size, short = model.size, len(model.index)

        def softmax(before):
            z = (n.q @ sum(n.c[j] * n.r[before[j]] for j in (0, 1)) + n.b).astype(float)
            return np.exp(z - z.max()) / np.exp(z - z.max()).sum()

        def share(w):
            k = model.class_of(w)
            return 1.0 if k < short else (counts.get(w, 0) + 1) / (sums.get(k, 0) + kinds.get(k, 0) + 1)

        end = model.class_of(b"\n")
        for i in [*list(texts)[:6], 10**6 + 5, 10**6 + 9]:
            before, total = (end, end), 0.0
            for w in texts[i][:400]:
                total += np.log10(softmax(before)[classes[w]] * share(w))
                before = (classes[w], before[0])
            if len(texts[i]) <= 400:
                assert rows[i]["score"] == pytest.approx(total, rel=1e-4)
            assert rows[i]["n_known"] == sum(w in counts for w in texts[i]) and rows[i]["train_tokens"] == sum(counts.values())
        p = softmax((3, end))  # over all words seen and the unseen word of each class it adds up to one
        unseen = sum(p[k] / (sums.get(k, 0) + kinds.get(k, 0) + 1) for k in range(short, size))
        assert sum(p[model.class_of(w)] * share(w) for w in counts) + unseen == pytest.approx(1, rel=1e-5)


def test_network_beats_its_classes_counts(spark, monkeypatch):
    caught, plain = [], language_model.train
    monkeypatch.setattr(language_model, "train", lambda *a: caught.append(plain(*a)) or caught[-1])
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r["doc_id"]: r for r in language_model.score(table).filter("held_out").collect()}
    model, wins, gain = caught[-1], 0, 0.0
    p = np.log10(model.words.noise)  # what counts alone give each class
    for r in table.collect():
        if r["doc_id"] in rows:
            t = [*words(r["text"]), b"\n"]
            k = np.array([model.class_of(w) for w in t])
            z = model.words.log10(model.contexts(k, np.array([len(k)])), k).sum()
            wins, gain = wins + (z > p[k].sum()), gain + z - p[k].sum()
    assert gain > 0 and wins > 0.8 * len(rows)


def test_language_model_of_hardly_any_rows(docs):
    assert language_model.score(docs.limit(0)).count() == 0
    held = docs.filter("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 7 = 2")
    rows = language_model.score(held.limit(3)).collect()  # nothing to learn from
    assert len(rows) == 3 and all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 and np.isfinite(r["score"]) for r in rows)


def test_quality_rules_match_plain_counts(odd, docs):
    for table in (odd, docs.limit(80)):
        for r, m in zip(sorted(table.collect(), key=lambda r: (str(r["doc_id"]), r["text"] or "")), sorted(quality_rules.measure(table, keys=("doc_id", "text")).collect(), key=lambda r: (str(r["doc_id"]), r["text"] or "")), strict=True):
            t = r["text"] or ""
            w = t.encode().split()
            lines = [x for x in t.split("\n") if x.encode().split()]
            at, dup = {}, set()
            for i in range(len(w) - 2):
                at.setdefault(tuple(w[i : i + 3]), []).append(i)
            for places in at.values():
                if len(places) > 1:
                    dup |= {i + k for i in places for k in range(3)}
            want = (len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(dup), len(w) < 50 or 100 * len(dup) > 50 * len(w))
            assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"], m["base_failed"]) == want
            assert not (m["base_failed"] and m["kept"])


def test_rules_keep_columns_and_use_no_python(odd, docs):
    kept = quality_rules.keep_documents(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert quality_rules.keep_documents(odd).columns == odd.columns
    clash = docs.withColumns({"n_words": F.lit(1), "__text": F.lit("x")})
    assert quality_rules.keep_documents(clash).count() == kept.count()
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    lines = [x.strip(" +-:*()0123456789") for x in plan.splitlines()]
    verdict, generate = (next(k for k, x in enumerate(lines) if x.startswith(w)) for w in ("Filter", "Generate"))
    assert verdict < generate and "kept" in lines[verdict] and "xxhash64" not in lines[verdict]  # the filter stays above the measuring
    assert quality_rules.measure(docs.limit(0)).count() == 0 and quality_rules.keep_documents(docs.limit(0)).count() == 0


def test_quality_model_learns_and_survives_odd_tables(spark, odd, docs):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = quality_model.score(docs, labels).collect()
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([p == y for p, y in held]) > 0.85 and all(0 <= r["score"] <= 1 for r in rows)
    out = quality_model.score(odd, labels).collect()
    assert len(out) == odd.count()
    assert {r["score"] for r in quality_model.score(odd, labels.limit(0)).collect()} == {0.5}
    assert quality_model.keep_documents(docs, labels).columns == docs.columns
    assert quality_model.score(docs.limit(0), labels).count() == 0
    assert quality_model.keep_documents(docs.limit(0), labels).count() == 0
    clash = docs.limit(20).withColumns({"score": F.lit(1), "__text": F.lit("x"), "y": F.lit(2)})
    assert quality_model.keep_documents(clash, labels).columns == clash.columns
    assert quality_model.score(clash, labels).count() == 20


def plain_score(net, text):
    """The network by loops: every filter at every fourth byte, maxima by chunk, mean and maximum over chunks."""
    codes = list((text or "").encode())
    n = max(1, -(-max(0, len(codes) - 8) // 4) + 1)
    codes += [256] * ((n - 1) * 4 + 8 - len(codes))
    act = [[max(0.0, float(sum(net.p["embed"][codes[4 * k + j]] @ net.p["filters"][8 * j : 8 * j + 8, f] for j in range(8)) + net.p["bias"][f])) for f in range(quality_model.FILTERS)] for k in range(n)]
    chunks = [np.max(act[s : s + 128], axis=0) for s in range(0, max(1, n - 16), 112)]
    return 1 / (1 + np.exp(-(np.concatenate([np.mean(chunks, 0), np.max(chunks, 0)]) @ net.p["out"] + net.p["last"][0])))


def test_network_is_the_plain_convolution(monkeypatch):
    net = quality_model.Network(3)
    net.p["bias"] += 0.1
    texts = [None, "", "short", "é" * 40, "many words in a row, " * 60, "x" * 900, "another text; " * 150]
    want = [plain_score(net, t) for t in texts]
    assert net.score(texts) == pytest.approx(want, rel=1e-4)
    monkeypatch.setattr(quality_model, "TOGETHER", 2)  # long texts in parts
    monkeypatch.setattr(quality_model, "POSITIONS", 1)
    assert net.score(texts) == pytest.approx(want, rel=1e-4)
    assert quality_model.Network.from_bytes(net.to_bytes()).score(texts) == pytest.approx(want, rel=1e-4)


def test_network_gradient_is_that_of_differences(monkeypatch):
    monkeypatch.setattr(quality_model, "TOGETHER", 2)
    net = quality_model.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    text, r = "some text with several words in it " * 45, np.random.default_rng(2)
    windows = quality_model._windows(quality_model._padded(text))
    loss = lambda: -1.5 * np.log(1 - plain_score(net, text))  # noqa: E731 - label 0
    grad = net.gradient(windows, 0.0, 1.5)
    for k in ("embed", "filters", "bias", "out", "last"):
        flat, own = net.p[k].reshape(-1), grad[k].reshape(-1)
        for at in r.choice(np.flatnonzero(own), min(4, np.count_nonzero(own)), replace=False):
            kept, sides = flat[at], []
            for step in (1e-5, -1e-5):
                flat[at] = kept + step
                sides.append(loss())
            flat[at] = kept
            assert own[at] == pytest.approx((sides[0] - sides[1]) / 2e-5, rel=2e-2, abs=1e-5)


def test_network_learns():
    net, texts = quality_model.Network(3), ["some text with several words in it " * 3, "###%%%"]
    net.fit(texts, [1, 0], np.ones(2), epochs=30, batch=2)
    after = net.score(texts)
    assert after[0] > 0.8 > 0.2 > after[1]


def test_toxicity_matches_plain_cosines_votes_and_calibration():
    r = np.random.default_rng(0)
    vocabulary = [f"w{k}" for k in range(120)] + ["bad", "worse"]
    texts = [" ".join([*r.choice(vocabulary[:120], r.integers(5, 60)), f"rare{k // 3}"]) + (" bad worse" if k % 4 == 0 else "") for k in range(400)]
    labels, weights = [int(k % 4 == 0) for k in range(400)], np.where(np.arange(400) % 4 == 0, 2.0, 1.0)
    own = toxicity.Index.fit(list(range(400)), texts, labels, weights)
    assert sorted(own.ids) == list(range(400)) and len(own.slots[own.slots >= 0]) and len(own.places)
    counts = [{t: x.split().count(t) for t in set(x.split())} for x in texts]
    df = {t: [sum(t in c for c, y in zip(counts, labels, strict=True) if y == v) for v in (0, 1)] for t in own.vocabulary}
    idf = {}
    for t, (b, a) in df.items():
        c, d = 100 - a, 300 - b
        chi = 400 * (a * d - b * c) ** 2 / max((a + b) * (c + d) * 100 * 300, 1)
        idf[t] = (np.log(401 / (1 + a + b)) + 1) * (0.01 + max(0, chi**0.5 - 10.83**0.5))

    def unit(text):
        v = {t: (1 + np.log(text.split().count(t))) * idf[t] for t in set(text.split()) if t in idf}
        size = sum(x * x for x in v.values()) ** 0.5
        return {t: x / size for t, x in v.items()}

    units = [unit(x) for x in texts]

    def vote(v, without=None):
        found = sorted(((-sum(x * u.get(t, 0) for t, x in v.items()), k) for k, u in enumerate(units) if k != without))[:15]
        near = [(k, -c) for c, k in found if c < 0]
        shares = [weights[k] / (1.1 - c) for k, c in near]
        return sum(s * labels[k] for s, (k, _) in zip(shares, near, strict=True)) / sum(shares), near

    asked = ["w3 w4 w5 quite bad and worse w5", "w7", "w9 worse unknown", texts[17], " ".join(vocabulary)]
    own = pickle.loads(pickle.dumps(own))
    p, ids, cosines = own.score([*asked, "nothing to see", None, ""])
    for text, score, mine, near in zip(asked, p, ids, cosines, strict=False):
        v, want = vote(unit(text))
        assert near == pytest.approx([c for _, c in want], abs=1e-5)
        assert score == pytest.approx(1 / (1 + np.exp(-(own.slope * v + own.shift))), abs=2e-3)
        beyond = [k for k in mine if k not in {k for k, _ in want}]  # only equal cosines may trade places, by rounding
        assert all(sum(x * units[k].get(t, 0) for t, x in unit(text).items()) >= want[-1][1] - 1e-6 for k in beyond)
    assert p[0] > 0.8 and p[5:] == [own.rate] * 3 and ids[0] and not ids[6]
    votes = np.array([vote(u, k)[0] for k, u in enumerate(units)])
    left = lambda a, b: -(weights * np.where(labels, -np.log1p(np.exp(-(a * votes + b))), -np.log1p(np.exp(a * votes + b)))).sum() + 0.005 * a * a
    at = left(own.slope, own.shift)
    assert all(at <= left(own.slope + i, own.shift + j) + 1e-3 for i, j in ((0.1, 0), (-0.1, 0), (0, 0.1), (0, -0.1)))


def test_toxicity_on_tables(spark, odd, docs):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    assert toxicity.score(docs, labels).count() == docs.count()
    assert toxicity.score(odd, labels).count() == odd.count()
    assert {r["score"] for r in toxicity.score(odd, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), labels).count() == 0
    one = labels.filter("toxic = 0")
    assert {r["score"] for r in toxicity.score(docs, one).collect()} == {0.0}
    clash = docs.limit(20).withColumns({"score": F.lit(1), "labels": F.lit("x"), "evidence": F.lit(2)})
    assert toxicity.score(clash, labels, sample=50).columns == ["doc_id", "held_out", "score", "predicted", "evidence", "cosines"]
    twice = docs.filter("doc_id < 40").unionByName(docs.filter("doc_id < 40"))
    assert toxicity.score(twice, labels).select("doc_id", "score").distinct().count() == 40


def test_toxicity_copies_are_near_and_of_one_label():
    r = np.random.default_rng(5)
    shared = [f"s{k}" for k in range(60)]
    mixed = [shared + [f"o{i}x{k}" for k in range(20)] for i in range(30)]  # they share most shingles, at a similarity of about 0.58
    assert not toxicity._copies(mixed, np.arange(30) % 2).any()
    same = [[f"w{k}" for k in r.integers(0, 99, 200)]] * 3
    assert toxicity._copies(same, np.array([0, 1, 0])).tolist() == [False, False, True]


def test_toxicity_keeps_all_terms_and_examples():
    texts = [f"own{k} plain words {'bad worse' if k % 4 == 0 else 'fine'}" for k in range(40)] + ["only seen once", "another lone text"]
    own = toxicity.Index.fit(list(range(42)), texts, [int(k % 4 == 0) for k in range(40)] + [1, 0], np.ones(42))
    assert sorted(own.ids) == list(range(42))
    _, ids, cosines = own.score(["only seen once", "own7 unheard"])
    assert ids[0][0] == 40 and cosines[0][0] == pytest.approx(1, abs=1e-5) and ids[1] == [7]


def test_packing_curve_is_continuous_and_prefixes_are_coarser_curves():
    q = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    place = packing.hilbert(q, 3)
    assert sorted(place.tolist()) == list(range(512))
    along = q[np.argsort(place)]
    assert (np.abs(np.diff(along, axis=0)).sum(1) == 1).all()
    assert (packing.hilbert(q, 3) >> 3 == packing.hilbert(q >> 1, 2)).all()


def test_packing_lays_neighbours_side_by_side(spark, docs, monkeypatch):
    """Documents go by cells along the curve, in each sub-cell by the curve, and those side by side are nearer than others."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    with monkeypatch.context() as m:  # cells grow with the rows, within their bounds
        m.setattr(packing, "BITS", 2)
        m.setattr(packing, "MOST_BITS", 3)
        for sub_rows, bits in ((10**6, 2), (1, 3)):
            rows = [r for r in packing.pack(table, sub_rows=sub_rows).collect() if r["start"] == 0]
            rows.sort(key=lambda r: (r["sequence_id"], r["offset"]))
            assert [r["hilbert"] for r in rows] == sorted(r["hilbert"] for r in rows) and 8 ** (bits - 1) <= max(r["hilbert"] for r in rows) < 8**bits
    whole = packing.pack_ids(table, sub_rows=10**6)
    ids = {}
    for r in sorted(whole.collect(), key=lambda r: (r["sequence_id"], r["offset"])):
        ids.setdefault(r["doc_id"], []).extend(r["ids"])
    texts = [np.array(x[:-1]) for x in ids.values() if len(x) > 20]
    place = packing.curve_places(texts)
    cells = place >> packing.DIMENSIONS * (packing.FINE - packing.BITS)
    assert (np.diff(cells) >= 0).all() and (np.diff(place) >= 0).mean() > 0.99  # without sub-cells the whole table goes by the curve
    v = np.stack([packing.hashed_counts(x) for x in texts])
    near = (v[:-1] * v[1:]).sum(1).mean()
    mixed = np.random.default_rng(0).permutation(len(v))
    assert near > (v[mixed[:-1]] * v[mixed[1:]]).sum(1).mean() + 0.15

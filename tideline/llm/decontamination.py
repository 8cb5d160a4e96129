"""Benchmark decontamination by a broadcast hash set of test word windows.

The windows of the benchmark (``size`` consecutive words, or the whole item where it has fewer) are made and told
apart in Spark, gathered into a set of 64-bit hashes and broadcast. Each training text is scanned once: its words become
numbers of the set's vocabulary, windows of known words are hashed where they stand, and every window whose hash the
set holds is compared word by word with the window it may be. What is found is returned as a report, or removed from
the documents: the hit words, or the whole document.

The set is bounded: at most ``most_windows`` windows and ``most_bytes`` bytes of them are broadcast at a time. A larger
benchmark is cut by a hash of the window into as many sets as that takes, each scans the documents in its own pass, and
the passes' hits are joined by a 128-bit hash of the text; the result is the same.

Words: A-Z become lower case; a word is a run of characters that are a-z, 0-9 or beyond ASCII.

Defined results: a null or empty text has no words and no hits; an item without words has no window; items are told
apart by their id as text, so repeated rows and ids count once, and a null id counts as the empty text; repeated
documents are reported each, a null doc_id stays null; texts of any length are scanned whole, their words in pieces of
``PIECE`` bytes; an empty benchmark leaves every document clean, an empty table gives an empty one; further columns do
not matter to the report, and removal keeps them, whatever their names. Removing spans takes the bytes from the first to
the last word of each run of hit words and nothing else, once: words that only then become neighbours are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tideline.llm.common import Scratch, spark_arrow

SIZE, MOST_WINDOWS, MOST_BYTES, PIECE = 10, 2_000_000, 256 << 20, 1 << 20
#: Bytes to what they count as: lower case, white space between words, or themselves.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def pieces(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a whole text, in lists of about ``PIECE`` bytes."""
    text, at = (text or b"").translate(FOLDED), 0
    while at < len(text):
        end = len(text) if len(text) - at <= PIECE else text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


class WindowSet:
    """Word windows of one benchmark, or of a part of it, by hash; ``windows`` are different (words, items)."""

    def __init__(self, windows: list[tuple[bytes, list[str]]]):
        split = [w.split(b" ") for w, _ in windows]
        self.vocabulary: dict[bytes, int] = {}
        for own in split:
            for w in own:
                self.vocabulary.setdefault(w, len(self.vocabulary))
        rng = np.random.default_rng(13)
        self.mix = rng.integers(1, 1 << 63, len(self.vocabulary) + 1, np.uint64) * np.uint64(2) + np.uint64(1)
        self.turn = rng.integers(1, 1 << 63, max(map(len, split), default=0), np.uint64) * np.uint64(2) + np.uint64(1)
        self.names: list[str] = sorted({i for _, items in windows for i in items})
        place = {name: k for k, name in enumerate(self.names)}
        #: length: (hashes in order, ids of the words, ends of each window's items, items, windows of one hash at most)
        self.by_length: dict[int, tuple] = {}
        for n in sorted(set(map(len, split))):
            mine = [k for k, own in enumerate(split) if len(own) == n]
            ids = np.array([[self.vocabulary[w] for w in split[k]] for k in mine], np.int32)
            hashes = self.hashed(ids.ravel(), np.arange(len(mine)) * n, n)
            order = np.argsort(hashes, kind="stable")
            hashes, ids = hashes[order], ids[order]
            items = [np.array([place[i] for i in windows[mine[k]][1]], np.int64) for k in order]
            repeats = int(np.unique(hashes, return_counts=True)[1].max())
            self.by_length[n] = hashes, ids, np.cumsum([0, *map(len, items)]), np.concatenate(items), repeats

    def hashed(self, ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for j in range(n):
            out += self.mix[ids[at + j]] * self.turn[j]
        return out

    def ids(self, text: bytes | None) -> np.ndarray:
        """Numbers of the words of a text, -1 for words that no window has."""
        found = [np.fromiter(map(self.vocabulary.get, own, repeat(-1)), np.int32, len(own)) for own in pieces(text)]
        return np.concatenate(found) if found else np.zeros(0, np.int32)

    def hits(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(places, windows, length) of verified windows."""
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        for n, (hashes, own, _, _, repeats) in self.by_length.items():
            at = np.nonzero(known[n:] - known[:-n] == n)[0] if len(ids) >= n else known[:0]
            h = self.hashed(ids, at, n)
            first = np.searchsorted(hashes, h)
            for k in range(repeats):
                w = np.minimum(first + k, len(hashes) - 1)
                same = np.nonzero(hashes[w] == h)[0]
                same = same[(ids[at[same, None] + np.arange(n)] == own[w[same]]).all(1)]
                if len(same):
                    yield at[same], w[same], n

    def scan(self, texts: list[bytes | None]) -> list[tuple[int, np.ndarray, list[str]]]:
        """(words, runs of hit words as rows (from, to), item ids) of each text."""
        each = [self.ids(t) for t in texts]
        starts = np.cumsum([0, *(len(e) + 1 for e in each)])  # a number that no window has parts the texts
        joined = np.full(starts[-1], -1, np.int32)
        for e, at in zip(each, starts, strict=False):
            joined[at : at + len(e)] = e
        change, items = np.zeros(len(joined) + 1, np.int64), [set() for _ in texts]
        for at, w, n in self.hits(joined):
            np.add.at(change, at, 1)
            np.add.at(change, at + n, -1)
            _, _, ends, of, _ = self.by_length[n]
            pairs = np.unique(np.stack([np.searchsorted(starts, at, "right") - 1, w], 1), axis=0)
            for text, window in pairs.tolist():
                items[text].update(of[ends[window] : ends[window + 1]].tolist())
        edges = np.diff(np.concatenate([[0], (np.cumsum(change)[:-1] > 0).astype(np.int8), [0]]))
        runs = np.stack([np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0]], 1)
        cut = np.searchsorted(runs[:, 0], starts)
        return [(len(e), runs[cut[k] : cut[k + 1]] - starts[k], [self.names[i] for i in sorted(items[k])]) for k, e in enumerate(each)]


def without(text: bytes, runs: np.ndarray) -> bytes:
    """The text without the words of the runs and what stands between them."""
    if not len(runs):
        return text
    out, at, run, place = [], 0, 0, 0
    for m in WORD.finditer(text):
        if run < len(runs):
            if place == runs[run][0]:
                out.append(text[at : m.start()])
            if place == runs[run][1] - 1:
                at, run = m.end(), run + 1
        place += 1
    return b"".join([*out, text[at:]])


def item_windows(text: bytes | None, size: int) -> Iterator[set[bytes]]:
    """The windows of one item, in sets of a piece each; an item of fewer words is one window."""
    carry: list[bytes] = []
    full = False
    for own in pieces(text):
        own = carry + own
        if len(own) >= size:
            yield {b" ".join(own[i : i + size]) for i in range(len(own) - size + 1)}
            own, full = own[len(own) - size + 1 :], True
        carry = own
    if carry and not full:
        yield {b" ".join(carry)}


def windows(benchmark: DataFrame, size: int = SIZE, key: str = "item_id", text: str = "text") -> DataFrame:
    """(window, items): different windows as words between single spaces, with the ids of the items that have them."""
    schema = "window binary, item string"
    target = spark_arrow(benchmark.sparkSession, schema)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(len(b)):
                for found in item_windows(b.column(1)[k].as_py(), size):
                    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), b.column(0).take(pa.array([k] * len(found)))], schema=target)

    own = benchmark.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), F.col(text).cast("binary").alias("text"))
    return own.mapInArrow(made, schema).groupBy("window").agg(F.collect_set("item").alias("items"))


def window_sets(benchmark: DataFrame, size: int, key: str, text: str, most_windows: int, most_bytes: int) -> list[Broadcast]:
    """The broadcast sets: one, or as many as the bounds ask for."""
    spark = benchmark.sparkSession
    scratch = Scratch(spark, "windows")
    made = scratch.save(windows(benchmark, size, key, text), "windows")
    n, volume = made.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("window") + F.size("items") * 16), F.lit(0))).first()
    parts = max(1, -(-n // most_windows), -(-volume // most_bytes))
    sets = []
    for k in range(parts):
        mine = made.filter(F.pmod(F.xxhash64("window"), F.lit(parts)) == k).toArrow()  # bounded, see above
        sets.append(spark.sparkContext.broadcast(WindowSet(list(zip(mine.column(0).to_pylist(), mine.column(1).to_pylist(), strict=True)))))
    return sets


def _together(column: pa.Array, most: int = PIECE) -> Iterator[tuple[int, list[bytes | None]]]:
    """(place, texts): neighbouring texts of about ``most`` bytes together, or one longer text."""
    at, held, size = 0, [], 0
    for k, value in enumerate(column):
        held.append(value.as_py())
        size += len(held[-1] or b"")
        if size >= most or len(held) == 1000:
            yield at, held
            at, held, size = k + 1, [], 0
    if held:
        yield at, held


def _hashes(text: str) -> list[F.Column]:
    return [F.xxhash64(F.col(text)).alias("h"), F.xxhash64(F.col(text), F.lit(13)).alias("g")]


def _found(texts: DataFrame, sets: list[Broadcast]) -> DataFrame:
    """(h, g, runs, items) of texts with hits, over all sets; a text is known by two hashes."""
    schema = "h long, g long, runs array<array<long>>, items array<string>"
    target = spark_arrow(texts.sparkSession, schema)

    def pass_of(own: Broadcast):  # type: ignore[no-untyped-def]
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at, some in _together(b.column(2)):
                    found = [(at + k, r.tolist(), i) for k, (_, r, i) in enumerate(own.value.scan(some)) if len(r)]
                    take = pa.array([f[0] for f in found], pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *[pa.array([f[j] for f in found], target.field(j + 1).type) for j in (1, 2)]], schema=target)

        return work

    out = None
    for own in sets:
        one = texts.select(*_hashes("text"), "text").mapInArrow(pass_of(own), schema)
        out = one if out is None else out.unionByName(one)
    both = lambda c: F.array_distinct(F.flatten(F.collect_set(c))).alias(c)
    return out.groupBy("h", "g").agg(both("runs"), both("items")).withColumn("runs", F.sort_array("runs"))


def joined_runs(runs: list[list[int]] | None) -> np.ndarray:
    """Ordered runs that overlap or touch as one."""
    out: list[list[int]] = []
    for lo, hi in runs or []:
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return np.array(out, np.int64).reshape(-1, 2)


#: From rows beside a text, the texts, and (words, runs, items) of each to rows of the result.
Emit = Callable[[list[pa.Array], list[bytes | None], list[tuple[int, np.ndarray, list[str]]]], pa.RecordBatch]


def _scanned(docs: DataFrame, text: str, kept: list[str], sets: list[Broadcast], schema: StructType | str, emit: Emit) -> DataFrame:
    """Every document through ``emit``, with its ``kept`` columns and what all sets find in its text."""
    # Columns go by their places, so that no name can clash.
    rows = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(kept)], F.col(text).cast("binary").alias("text"))
    n = len(kept)
    if len(sets) == 1:

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at, texts in _together(b.column(n)):
                    yield emit(b.slice(at, len(texts)).columns[:n], texts, sets[0].value.scan(texts))

        return rows.mapInArrow(work, schema)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in _together(b.column(n)):
                found = [(sum(map(len, pieces(t))), joined_runs(b.column(n + 1)[at + k].as_py()), b.column(n + 2)[at + k].as_py() or []) for k, t in enumerate(texts)]
                yield emit(b.slice(at, len(texts)).columns[:n], texts, found)

    found = _found(rows.select("text"), sets)
    own = rows.select("*", *_hashes("text"))
    return own.join(found, ["h", "g"], "left").select(*rows.columns, "runs", "items").mapInArrow(finish, schema)


def report(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, key: str = "doc_id", text: str = "text", item: str = "item_id", most_windows: int = MOST_WINDOWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``key``, n_words, n_hit, items (ids of items with a window in the text, as sorted texts) and spans (runs of hit words, from and to) of every document."""
    sets = window_sets(benchmark, size, item, "text", most_windows, most_bytes)
    schema = f"id {docs.schema[key].dataType.simpleString()}, n_words long, n_hit long, items array<string>, spans array<struct<start long, end long>>"
    target = spark_arrow(docs.sparkSession, schema)

    def emit(columns: list[pa.Array], texts: list[bytes | None], found: list[tuple[int, np.ndarray, list[str]]]) -> pa.RecordBatch:
        spans = [[{"start": lo, "end": hi} for lo, hi in r.tolist()] for _, r, _ in found]
        made = [[n for n, _, _ in found], [int((r[:, 1] - r[:, 0]).sum()) for _, r, _ in found], [sorted(i) for _, _, i in found], spans]
        return pa.RecordBatch.from_arrays([columns[0], *[pa.array(v, target.field(j + 1).type) for j, v in enumerate(made)]], schema=target)

    return _scanned(docs, text, [key], sets, schema, emit).withColumnRenamed("id", key)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", size: int = SIZE, text: str = "text", item: str = "item_id", most_windows: int = MOST_WINDOWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The documents, in their own columns, without those that hold a window (``documents``) or without the hit words (``spans``)."""
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove: documents or spans, not {remove}")
    sets = window_sets(benchmark, size, item, "text", most_windows, most_bytes)
    target = spark_arrow(docs.sparkSession, docs.schema)
    place = docs.columns.index(text)

    def emit(columns: list[pa.Array], texts: list[bytes | None], found: list[tuple[int, np.ndarray, list[str]]]) -> pa.RecordBatch:
        if remove == "documents":
            clean = pa.array([not len(r) for _, r, _ in found], pa.bool_())
            return pa.RecordBatch.from_arrays([c.filter(clean) for c in columns], schema=target)
        cleaned = pa.array([t if t is None else without(t, r) for t, (_, r, _) in zip(texts, found, strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([cleaned.cast(target.field(place).type) if k == place else c for k, c in enumerate(columns)], schema=target)

    return _scanned(docs, text, docs.columns, sets, docs.schema, emit)


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    found = report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: Windows as text; a document holds a window where it stands between spaces in the document's joined words.
ORACLE_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words, row_number() OVER () AS d FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark),
k AS (SELECT DISTINCT item, least(len(words), 10) AS n, array_to_string(list_slice(words, i, i + least(len(words), 10) - 1), ' ') AS win
  FROM (SELECT *, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS i FROM b WHERE len(words) > 0)),
lengths AS (SELECT DISTINCT n FROM k),
o AS (SELECT d, i, n, array_to_string(list_slice(words, i, i + n - 1), ' ') AS win
  FROM (SELECT d, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM w, lengths WHERE len(words) >= n)),
h AS (SELECT o.d, o.i, o.n, k.item FROM o JOIN k ON o.win = k.win AND o.n = k.n),
words_hit AS (SELECT d, count(DISTINCT p) AS n_hit FROM (SELECT d, unnest(range(i, i + n)) AS p FROM h) GROUP BY d),
items AS (SELECT d, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT d, item FROM h) GROUP BY d)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words_hit USING (d) LEFT JOIN items USING (d)
"""

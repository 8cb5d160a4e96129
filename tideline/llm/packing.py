"""Packing documents into sequences along a space-filling curve.

Each document's token ids are hashed into a vector of ``HASHED`` counts,
projected to three dimensions by fixed random signs and quantised to ``FINE`` bits
each; the grid points are numbered along a Hilbert curve. Documents are laid along
the curve end to end and cut every ``LENGTH`` tokens, so each sequence holds
neighbours and only the last one of all is padded. A document's place on the curve
comes from token counts per cell and sub-cell; the ids move once, to be cut. Cells
are prefixes of the curve's number, the longer the more documents there are; large
ones are cut into sub-cells by a hash, and in each documents go by the whole number.

Tokenising: where the tokenizer's file has the rules ``SPLIT_RULES`` (white space
parts, lower case, its own pattern of words), texts fall between white space
into parts whose ids do not depend on each other, so each different part is
encoded once per task by the library and remembered: words of Latin letters by
hundreds in one call, parted by the suffix that ends words in the vocabulary, other
parts each for itself. Texts go whole to the library for any other file.

Defined results: a null text counts as empty, and an empty text is the closing
id alone; repeated rows are packed row by row, and rows equal in id and text are
placed by one task; an empty table gives an empty table; very long texts are cut
into many pieces; ties on the curve go by a hash of id and ids, then by id;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import string
import unicodedata
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm.common import Scratch, free_shuffles, map_rows, spark_arrow

LENGTH, END = 4096, 2
HASHED, DIMENSIONS, SEED = 512, 3, 11
#: Bits of a dimension that the curve numbers, and those that tell cells apart, at least and at most.
FINE, BITS, MOST_BITS = 10, 4, 6
#: Parts that a worker remembers, and those of one batch more.
CACHE = 500_000
#: Words that go to the library in one call; the time for each grows with more.
CALL = 200
#: Punctuation behind a letter, of ASCII or one of ``LATIN``, is apart from it. (U+0130 ends in a mark when in lower case.)
MARKS = string.punctuation.encode()
LATIN = frozenset(chr(c).encode() for c in range(0xC0, 0x180) if chr(c).isalpha() and c != 0x130)
#: Rules of a tokenizer's file under which white space and the parts between it can be encoded apart (fixed values).
SPLIT_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes with: printable ones as themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Tokens:
    """Ids of texts, by the tokenizer file in ``path``; one per worker process."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.letters = _byte_letters()
        rules = json.loads(self.tokenizer.to_str())
        self.split = all(rules[k] == v for k, v in SPLIT_RULES.items()) and self.tokenizer.get_vocab_size() <= 1 << 16 and self._marks_ends(rules["model"])
        if self.split:
            self.words = Tokenizer(self.tokenizer.model)  # takes words between spaces, in the vocabulary's letters
            self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.forget()

    def _marks_ends(self, model: dict) -> bool:
        """Whether each word's last id, and no other, is one of a token with the suffix for ends; ``ends`` says which are."""
        if model["type"] != "BPE" or model["dropout"] or model["end_of_word_suffix"] != "</w>":
            return False
        self.ends = np.zeros(1 << 16, bool)
        self.ends[[i for token, i in model["vocab"].items() if token.endswith("</w>")]] = True
        return all(c + suffix in model["vocab"] for c in self.letters.values() for suffix in ("", "</w>"))

    def forget(self) -> None:
        """Parts are numbered as they come; their ids lie in ``ids``, from ``begins`` on as many as ``counts`` says."""
        self.codes: defaultdict[bytes, int] = defaultdict()
        self.codes.default_factory = self.codes.__len__
        self.ids, self.begins, self.counts = array("H"), array("q"), array("q")

    def _word(self, part: bytes) -> str | None:
        """A lower-case word of Latin letters, which the vocabulary's rules leave whole, in its letters; None for other parts."""
        if part.isalpha():  # that is, ASCII letters only
            return part.decode()
        word = part.decode("utf-8", "replace")
        if not word.isalpha() or max(word) > "\u017f" or "\u0130" in word or not unicodedata.is_normalized("NFC", word):
            return None
        return word.lower().encode().decode("latin-1").translate(self.letters)

    def _learn(self, seen: int) -> None:
        """Ids of the parts numbered from ``seen`` on. Words go to the library by hundreds, and are told apart by their last ids;
        punctuation behind a letter is a part of its own, and its place that of a pair; other parts go one by one."""
        known, words, rest, parts, pairs, halves = [], [], [], [], [], []
        fresh = list(islice(reversed(self.codes), len(self.codes) - seen))[::-1]
        for k, p in enumerate(fresh):  # grows with the halves of pairs, which are no pairs
            core = p.rstrip(MARKS)
            if core and len(core) < len(p) and (97 <= core[-1] <= 122 or core[-2:] in LATIN):
                pairs.append(k)
                for half in (core, p[len(core) :]):
                    code = self.codes[half]
                    halves.append(code)
                    if code == seen + len(fresh):
                        fresh.append(half)
                continue
            word = self._word(p)
            if word is None:
                rest.append(k)
                parts.append(p)
            else:
                known.append(k)
                words.append(word)
        at = len(self.ids)
        for k in range(0, len(words), CALL):
            self.ids.extend(self.words.encode_batch_fast([" ".join(words[k : k + CALL])], add_special_tokens=False)[0].ids)
        stops = np.flatnonzero(self.ends[np.array(self.ids[at:])]) + 1
        counts, begins = np.zeros(len(fresh), np.int64), np.zeros(len(fresh), np.int64)
        counts[known] = np.diff(stops, prepend=0)
        begins[known] = at + stops - counts[known]
        for k in range(0, len(parts), CALL):
            found = self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in parts[k : k + CALL]], add_special_tokens=False)
            for j, e in zip(rest[k : k + CALL], found, strict=True):
                begins[j], counts[j] = len(self.ids), len(e.ids)
                self.ids.extend(e.ids)
        self.begins.frombytes(begins.tobytes())
        self.counts.frombytes(counts.tobytes())
        both, stops = self._ids(np.array(halves, np.int64))
        at = len(self.ids)
        self.ids.frombytes(both.tobytes())
        for k, begin, stop in zip(pairs, stops[:-1:2].tolist(), stops[2::2].tolist(), strict=True):
            self.begins[seen + k], self.counts[seen + k] = at + begin, stop - begin

    def _ids(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts end to end, and where each part begins, with the end of all."""
        ids, begins, counts = np.frombuffer(self.ids, np.uint16), np.frombuffer(self.begins, np.int64), np.frombuffer(self.counts, np.int64)
        stops = np.concatenate([[0], np.cumsum(counts[codes])])
        out = np.empty(stops[-1], np.uint16)
        for k in range(0, len(codes), 1 << 18):
            part = codes[k : k + (1 << 18)]
            shift = np.repeat(begins[part] - stops[k : k + len(part)], counts[part])
            out[stops[k] : stops[k] + len(shift)] = ids[shift + np.arange(stops[k], stops[k] + len(shift))]
        return out, stops

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, as numbers of 16 bits where the rules allow parts, else of 32."""
        if not self.split:
            return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch([(t or "").encode("utf-8", "replace").decode() for t in texts], add_special_tokens=False)]
        if len(self.codes) > CACHE:
            self.forget()
        seen = len(self.codes)
        lower = pa.array([(t or "").encode("utf-8", "surrogatepass").lower() for t in texts], pa.large_binary())  # the vocabulary is of lower case
        cut = pc.ascii_split_whitespace(lower.view(pa.large_string()))
        parts = cut.flatten().view(pa.large_binary()).dictionary_encode()  # each different part of these texts is looked up once
        different = np.fromiter(map(self.codes.__getitem__, parts.dictionary.to_numpy(zero_copy_only=False)), np.int64, len(parts.dictionary))
        if len(self.codes) > seen:
            self._learn(seen)
        ids, stops = self._ids(different[parts.indices.to_numpy()])
        return np.split(ids, stops[np.cumsum(pc.list_value_length(cut).to_numpy())][:-1]) if texts else []


_tokens: dict[str, Tokens] = {}


def tokens(path: str | None) -> Tokens:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


_rng = np.random.default_rng(SEED)
_SLOT = _rng.permutation(1 << 16).astype(np.int64) % HASHED
_PROJECTION = _rng.choice(np.array([-1.0, 1.0]), (HASHED, DIMENSIONS))


def hashed_counts(ids: np.ndarray) -> np.ndarray:
    """A document's vector: roots of its hashed token counts less their mean, of length one or zero."""
    v = np.sqrt(np.bincount(_SLOT[ids & 0xFFFF], minlength=HASHED))
    v -= v.mean()
    norm = np.sqrt(v @ v)
    return v / norm if norm else v


def hilbert(q: np.ndarray, bits: int) -> np.ndarray:
    """Numbers along the Hilbert curve of grid points (rows), by Skilling's transform; a prefix of a number is that of the coarser curve."""
    x = [c.astype(np.int64) for c in q.T]
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(len(x)):
            up = (x[i] >> b) & 1
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> b) & 1, (1 << b) - 1, 0)
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            out = out << 1 | ((c ^ turn) >> b) & 1
    return out


def curve_places(documents: list[np.ndarray]) -> np.ndarray:
    """The curve's numbers of documents, given as ids; of equal ones the same whatever stands beside them."""
    x = np.array([(hashed_counts(ids)[:, None] * _PROJECTION).sum(0) for ids in documents]).reshape(-1, DIMENSIONS)
    return hilbert(np.clip((x + 2) * ((1 << FINE) / 4), 0, (1 << FINE) - 1).astype(np.int64), FINE)


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END, sub_rows: int = 1024) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece, and its document's curve cell ``hilbert``."""
    return _cut(docs, path, length, end, sub_rows, with_ids=False)


def pack_ids(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END, sub_rows: int = 1024) -> DataFrame:
    """As ``pack``, with the pieces' ids, for writing training sequences."""
    return _cut(docs, path, length, end, sub_rows, with_ids=True)


def _cut(docs: DataFrame, path: str | None, length: int, end: int, sub_rows: int, with_ids: bool) -> DataFrame:
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        own = tokens(path)
        for b in batches:
            at = 0
            while at < len(b["text"]):
                stop, held = at, 0
                while stop < len(b["text"]) and (stop == at or held + len(b["text"][stop] or "") < 2_000_000):
                    held += len(b["text"][stop] or "")
                    stop += 1
                ids = own.encode(b["text"][at:stop])
                raw = [x.tobytes() for x in ids]
                yield {"doc_id": b["doc_id"][at:stop], "fine": curve_places(ids).tolist(), "n": [len(x) + 1 for x in ids], "spread": [zlib.crc32(x) for x in raw], "wide": [not own.split] * len(ids), "ids": raw}
                at = stop
        own.forget()  # the worker process goes on to steps that need the memory

    rows = scratch.save(map_rows(docs.select("doc_id", "text"), f"doc_id {kind}, fine long, n long, spread long, wide boolean, ids binary", encode), "ids")
    bits = min(MOST_BITS, max(BITS, -(-max(1, rows.count() // sub_rows).bit_length() // DIMENSIONS)))
    rows = rows.withColumn("hilbert", F.shiftright("fine", DIMENSIONS * (FINE - bits)).cast("int"))
    # Equal texts share a hash of their ids, so large cells are cut by one that takes the document's id in.
    rows = rows.withColumn("spread", F.crc32(F.concat_ws(",", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("spread").cast("string")).cast("binary")))
    cells = rows.groupBy("hilbert").count().select(F.col("hilbert").alias("cell"), F.ceil(F.col("count") / sub_rows).cast("long").alias("subs"))
    cells = scratch.save(cells.coalesce(1), "cells")  # at most 2 ** (DIMENSIONS * MOST_BITS) rows
    rows = rows.join(F.broadcast(cells), F.col("hilbert") == F.col("cell")).withColumn("sub", F.shiftright(F.col("spread") * F.col("subs"), 32)).drop("cell", "subs")
    sums = rows.groupBy("hilbert", "sub").agg(F.sum("n").alias("n"))
    begins = sums.select(F.col("hilbert").alias("cell"), F.col("sub").alias("part"), (F.sum("n").over(Window.orderBy("hilbert", "sub")) - F.col("n")).alias("begin"))
    begins = scratch.save(begins, "begins")  # at most documents / sub_rows rows more than cells
    placed = rows.join(begins, (F.col("hilbert") == F.col("cell")) & (F.col("sub") == F.col("part"))).drop("cell", "part")
    placed = placed.repartition("hilbert", "sub").sortWithinPartitions("hilbert", "sub", "fine", "spread", "doc_id", "ids")
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, hilbert int" + ", ids array<int>" * with_ids
    target = spark_arrow(spark, schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, at = None, 0
        for b in batches:
            out: dict[str, list] = {f.name: [] for f in target}
            for doc, h, s, first, wide, raw in zip(*(b.column(c).to_pylist() for c in ("doc_id", "hilbert", "sub", "begin", "wide", "ids")), strict=True):
                if (h, s) != group:
                    group, at = (h, s), first
                own = np.append(np.frombuffer(raw, "<u4" if wide else "<u2").astype("<u4"), np.uint32(end)).astype("<u4")
                start = 0
                while start < len(own):
                    offset = at % length
                    piece = own[start : start + length - offset]
                    values = [doc, start, len(piece), zlib.crc32(piece.tobytes()), len(own), at // length, offset, h] + [piece.astype(np.int32)] * with_ids
                    for column, v in zip(out.values(), values, strict=True):
                        column.append(v)
                    start, at = start + len(piece), at + len(piece)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

    free_shuffles(spark)
    return placed.select("doc_id", "hilbert", "sub", "begin", "wide", "ids").mapInArrow(cut, schema)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Byte-level BPE encoding and decoding with recursive DuckDB queries in each partition.

A text is cut by the vocabulary's pattern; each different piece is encoded once
per worker. A recursive query holds one row per token position, joins
neighbouring positions with the merge table and contracts each piece's leftmost
pair of least rank until no pair is left. Decoding joins the ids with the
vocabulary and puts the bytes together by an ordered aggregation.

The merge table has one pair per token: a token comes about only where no merge
crosses its ends, so its last merge is always the one that ends its own
encoding; other ways to split it never fire.

Pieces of more than ``SHORT`` bytes would take a step per contraction, so a
second query contracts, in one step, every pair that is certain to come: all
pairs of the piece's least rank, from left to right without overlap, and each
pair whose rank is below that of any merge that its two tokens could enter with
the bytes beside them. Both need that a token's later merges all have higher
ranks than its own; tokens without that property are contracted one at a time.

Defined results: a null text counts as empty and has no ids; an empty text
likewise; repeated rows are encoded row by row; an empty table gives an empty
table; very long texts are encoded whole, in slices of the id sequence for
decoding; a single piece of any length is cut where no merge can reach over, or
into windows whose edges are then put right, so that no query holds more than a
bounded number of rows, and nothing is written to a local folder; further columns
are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tideline.llm.common import map_rows

#: Pieces and parts that a worker remembers, and pieces that go into one recursive query.
CACHE, PARTS, BATCH = 1_200_000, 400_000, 20_000
#: Ids that go into one decoding query.
SLICE = 1_000_000
#: Rows that the steps of one recursive query write at most, and bytes of a long piece that go into one.
ROWS, WINDOW = 3_000_000, 64

#: Bytes of a piece from which on all certain pairs are contracted in one step.
SHORT = 48

#: Each step writes the positions of the pieces that it contracted; a piece's last step is its encoding.
ENCODE = """
WITH RECURSIVE run(step, w, i, tok) AS (
    SELECT 0, w, i, tok FROM positions
  UNION ALL
    (WITH pairs AS (
        SELECT step, w, i, tok, lead(tok) OVER s AS nxt, lead(i) OVER s AS gone, lead(w) OVER s AS next_w FROM run WINDOW s AS (ORDER BY w, i)),
     ranked AS (
        SELECT p.w, (m.id::BIGINT << 32) + p.i AS place, p.gone FROM pairs p JOIN merges m ON p.tok = m.a AND p.nxt = m.b WHERE p.next_w = p.w),
     best AS (
        SELECT w, min(place) AS place, arg_min(gone, place) AS gone FROM ranked GROUP BY w)
     SELECT p.step + 1, p.w, p.i, CASE WHEN p.i = b.place & 4294967295 THEN (b.place >> 32)::INTEGER ELSE p.tok END
     FROM pairs p JOIN best b ON p.w = b.w WHERE p.i <> b.gone))
SELECT r.w, r.tok FROM run r JOIN (SELECT w, max(step) AS step FROM run GROUP BY w) l ON r.w = l.w AND r.step = l.step ORDER BY r.w, r.i
"""

#: ``before`` and ``first`` are the bytes before and at a position. ``lefts`` has the least rank of a merge of a token with one that
#: ends in a byte, ``rights`` with one that starts with it. An island is a run of pairs of the piece's least rank that overlap.
ENCODE_LONG = """
WITH RECURSIVE run(step, w, i, tok, before, first) AS (
    SELECT 0, w, i, tok, before, first FROM positions
  UNION ALL
    (WITH pairs AS (
        SELECT step, w, i, tok, before, first, lead(tok) OVER s AS nxt, lead(i) OVER s AS gone, lead(first, 2) OVER s AS after FROM run WINDOW s AS (PARTITION BY w ORDER BY i)),
     ranked AS (
        SELECT p.w, p.i, p.gone, m.id, m.safe, m.safe AND m.id < coalesce(l.least, 2147483647) AND m.id <= coalesce(g.least, 2147483647) AS sure
        FROM pairs p JOIN merges m ON p.tok = m.a AND p.nxt = m.b LEFT JOIN lefts l ON l.byte = p.before AND l.tok = p.tok LEFT JOIN rights g ON g.tok = p.nxt AND g.byte = p.after),
     best AS (
        SELECT w, min((id::BIGINT << 32) + i) AS place FROM ranked GROUP BY w),
     least AS (
        SELECT r.w, r.i, r.gone, r.id, r.i - (r.gone - r.i) * row_number() OVER (PARTITION BY r.w ORDER BY r.i) AS island
        FROM ranked r JOIN best b ON r.w = b.w WHERE r.safe AND r.id = b.place >> 32),
     chosen AS (
        SELECT w, i, gone, id FROM (SELECT *, row_number() OVER (PARTITION BY w, island ORDER BY i) AS n FROM least) WHERE n % 2 = 1
      UNION
        SELECT r.w, r.i, r.gone, r.id FROM ranked r JOIN best b ON r.w = b.w WHERE r.sure OR (r.id::BIGINT << 32) + r.i = b.place)
     SELECT p.step + 1, p.w, p.i, coalesce(c.id, p.tok), p.before, p.first
     FROM pairs p JOIN best b ON p.w = b.w LEFT JOIN chosen c ON c.w = p.w AND c.i = p.i
     WHERE NOT EXISTS (SELECT 1 FROM chosen d WHERE d.w = p.w AND d.gone = p.i)))
SELECT r.w, r.tok FROM run r JOIN (SELECT w, max(step) AS step FROM run GROUP BY w) l ON r.w = l.w AND r.step = l.step ORDER BY r.w, r.i
"""

DECODE = """
SELECT t.doc, string_agg(v.hex, '' ORDER BY t.pos) AS hex FROM tokens t JOIN vocabulary v ON t.id = v.id GROUP BY t.doc
"""


#: The pattern that ``_parts`` holds for; texts are given whole to any other.
SPACED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_beside = re.compile(r" \s|\s ").search


def _last_pair(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two tokens that a token's own encoding merges last; None where it does not come to them."""
    parts = [token[k : k + 1] for k in range(len(token))]
    while len(parts) > 2:
        rank, k = min((ranks.get(parts[k] + parts[k + 1], 2**31), k) for k in range(len(parts) - 1))
        if rank == 2**31:
            return None
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return parts[0], parts[1]


def _parts(text: str) -> list[str]:
    """Cuts a text before each space, where no match of ``SPACED`` can reach over.

    That holds where a single space parts other characters, since a match has a space at its start
    or is white space throughout; texts with other white space beside a space stay whole.
    """
    if _beside(text):
        return [text]
    first, *rest = text.split(" ")
    return [first, *[" " + p for p in rest]] if first else [" " + p for p in rest]


class Codec:
    """Encodes and decodes with the ranks in ``path``; one per worker process."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.find = regex.compile(pattern).findall
        self.cut = _parts if pattern == SPACED else lambda text: [text] if text else []
        self.cache: dict[str, bytes] = {}  # of the pattern's matches
        self.parts: dict[str, bytes] = {}  # of runs of matches, see _parts
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})  # nothing is spilled: queries are bounded by ROWS and SLICE
        self.spelled = {r: t for t, r in self.ranks.items()}
        self.beside = np.zeros((256, 256), bool)  # pairs of bytes that stand side by side in a token
        for t in self.ranks:
            for x, y in zip(t, t[1:], strict=False):
                self.beside[x, y] = True
        self.short: dict[bytes, bytes] = {}  # of strings about the edges of windows
        self._merges()
        found = pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "hex": [t.hex() for t in self.ranks]})
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM found")
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)

    def _merges(self) -> None:
        """The tables of merges and of the bounds beside a pair."""
        rank, spelled = self.ranks, self.spelled
        rows = [(rank[x], rank[y], r) for t, r in rank.items() if len(t) > 1 and (found := _last_pair(t, rank)) for x, y in (found,)]
        a, b, r = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        later = np.full(max(rank.values()) + 1, 2**31 - 1)  # the least rank of a merge that a token enters
        np.minimum.at(later, a, r)
        np.minimum.at(later, b, r)
        last = np.array([spelled[x][-1] for x in a.tolist()])
        first = np.array([spelled[x][0] for x in b.tolist()])
        merges = pa.table({"a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "id": pa.array(r, pa.int32()), "safe": later[r] > r})  # noqa: F841
        found = pa.table({"left": last, "a": a, "b": b, "right": first, "r": r})  # noqa: F841
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges")
        self.db.execute('CREATE TABLE lefts AS SELECT "left"::INTEGER AS byte, b::INTEGER AS tok, min(r)::INTEGER AS least FROM found GROUP BY ALL')
        self.db.execute('CREATE TABLE rights AS SELECT a::INTEGER AS tok, "right"::INTEGER AS byte, min(r)::INTEGER AS least FROM found GROUP BY ALL')

    def learn(self, pieces: list[str]) -> None:
        """Encodes pieces that are not remembered yet."""
        rest: list[tuple[str, bytes]] = []
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            rank = self.ranks.get(raw)
            if rank is not None:
                self.cache[piece] = rank.to_bytes(4, "little")
            elif len(raw) <= SHORT:
                rest.append((piece, raw))
            else:
                self.cache[piece] = self._long(raw)
        for (piece, _), ids in zip(rest, self._encoded([raw for _, raw in rest]), strict=True):
            self.cache[piece] = ids

    def _encoded(self, raws: list[bytes]) -> list[bytes]:
        """The ids of different byte strings of at most ``WINDOW`` bytes, by as many recursive queries as keep each within ``ROWS``."""
        out: list[bytes] = [b""] * len(raws)
        for query, least, most in ((ENCODE, 0, SHORT), (ENCODE_LONG, SHORT + 1, WINDOW)):
            own = [k for k, raw in enumerate(raws) if least <= len(raw) <= most]
            at = 0
            while at < len(own):
                stop, held = at, 0
                while stop < len(own) and stop - at < BATCH and (stop == at or held + len(raws[own[stop]]) ** 2 <= 2 * ROWS):
                    held += len(raws[own[stop]]) ** 2  # a string of n bytes has n steps at most, of n positions and fewer
                    stop += 1
                for k, ids in zip(own[at:stop], self._contract([raws[k] for k in own[at:stop]], query), strict=True):
                    out[k] = ids
                at = stop
        return out

    def _long(self, raw: bytes) -> bytes:
        """The ids of a piece of any length.

        It is cut between bytes that no token of the vocabulary has side by side, over which no merge can reach, and into
        windows of ``WINDOW`` bytes where that leaves more. A sequence of tokens is the encoding of its bytes if that of
        every two neighbours is these two; so a window's edge is right where this holds, and where it does not, the tokens
        beside it are encoded together, more of them until both ends hold.
        """
        data = np.frombuffer(raw, np.uint8)
        ends = [*(np.nonzero(~self.beside[data[:-1], data[1:]])[0] + 1).tolist(), len(raw)]
        strings: list[bytes] = []
        edges: list[int] = []  # places in ``strings`` before which a window was cut
        lo = 0
        for hi in ends:
            for at in range(lo, hi, WINDOW):
                if at > lo:
                    edges.append(len(strings))
                strings.append(raw[at : min(hi, at + WINDOW)])
            lo = hi
        known = list(set(strings))
        found = dict(zip(known, self._encoded(known), strict=True))
        if not edges:
            return b"".join(map(found.__getitem__, strings))
        each = [np.frombuffer(found[x], "<u4").tolist() for x in strings]
        self._foresee([(each[k - 1], each[k]) for k in edges])
        out: list[list[int]] = []
        cut = set(edges)
        for k, ids in enumerate(each):
            if k in cut:
                self._join(out[-1], ids)
            else:
                out.append(list(ids))
        return np.array([i for ids in out for i in ids], "<u4").tobytes()

    def _join(self, left: list[int], right: list[int]) -> None:
        """Appends the ids of what follows to ``left``, encoding anew what the edge has parted."""
        k = 1
        while True:
            here, there = left[-k:], right[:k]
            middle = self._ids(self._spelled([*here, *there]))
            if (len(left) <= k or self._fits(left[-k - 1], middle[0])) and (len(right) <= k or self._fits(middle[-1], right[k])):
                left[-k:] = middle
                left += right[k:]
                return
            k *= 2

    def _foresee(self, edges: list[tuple[list[int], list[int]]]) -> None:
        """Encodes in a few queries what ``_join`` will ask for at most of the edges."""
        for k in (1, 2, 4):
            self._learn_short([self._spelled([*a[-k:], *b[:k]]) for a, b in edges])
            middles = [self._ids(self._spelled([*a[-k:], *b[:k]])) for a, b in edges]
            ends = [[x for x in ((a[-k - 1 : -k], m[:1]), (m[-1:], b[k : k + 1])) if x[0] and x[1]] for (a, b), m in zip(edges, middles, strict=True)]
            self._learn_short([self._spelled([*x, *y]) for own in ends for x, y in own])
            edges = [e for e, own in zip(edges, ends, strict=True) if not all(self._fits(x[0], y[0]) for x, y in own)]

    def _spelled(self, ids: list[int]) -> bytes:
        return b"".join(map(self.spelled.__getitem__, ids))

    def _fits(self, a: int, b: int) -> bool:
        """Whether two tokens side by side stay as they are."""
        return self._ids(self.spelled[a] + self.spelled[b]) == [a, b]

    def _learn_short(self, raws: list[bytes]) -> None:
        if len(self.short) > PARTS:
            self.short.clear()
        fresh = [x for x in set(raws) if x not in self.short and len(x) <= WINDOW]
        self.short.update(zip(fresh, self._encoded(fresh), strict=True))

    def _ids(self, raw: bytes) -> list[int]:
        if len(raw) > WINDOW:  # of very long tokens only
            return np.frombuffer(self._contract([raw], ENCODE_LONG)[0], "<u4").tolist()
        if raw not in self.short:
            self._learn_short([raw])
        return np.frombuffer(self.short[raw], "<u4").tolist()

    def _contract(self, part: list[bytes], query: str) -> list[bytes]:
        sizes = np.fromiter(map(len, part), np.int64, len(part))
        data = np.frombuffer(b"".join(part), np.uint8)
        starts = np.cumsum(sizes) - sizes
        before = np.concatenate([[-1], data[:-1].astype(np.int32)]).astype(np.int32)
        before[starts] = -1
        positions = pa.table({"w": np.repeat(np.arange(len(part), dtype=np.int32), sizes), "i": (np.arange(len(data)) - np.repeat(starts, sizes)).astype(np.int32), "tok": self.byte_ids[data], "before": before, "first": data.astype(np.int32)})  # noqa: F841
        out = self.db.sql(query).to_arrow_table()
        flat = out.column("tok").to_numpy().astype("<u4").tobytes()
        ends = 4 * np.cumsum(np.bincount(out.column("w").to_numpy(), minlength=len(part)))
        return [flat[lo:hi] for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):  # groups of texts of some megabytes, or one long text
            cut: list[list[str]] = []
            held = 0
            while at < len(texts) and (not cut or held < 400_000):
                cut.append(self.cut(texts[at] or ""))
                held += len(cut[-1])
                at += 1
            known = self.parts
            fresh = list({p for parts in cut for p in parts if p not in known})
            if len(known) + len(fresh) > PARTS:
                known.clear()
                fresh = list({p for parts in cut for p in parts})
            self._learn_parts(fresh)
            out += [b"".join(map(known.__getitem__, parts)) for parts in cut]
        return out

    def _learn_parts(self, fresh: list[str]) -> None:
        pieces, found = self.cache, [self.find(p) for p in fresh]
        new = list({x for xs in found for x in xs if x not in pieces})
        if len(pieces) + len(new) > CACHE:
            pieces.clear()
            new = list({x for xs in found for x in xs})
        if new:
            self.learn(new)
        for p, xs in zip(fresh, found, strict=True):
            self.parts[p] = pieces[xs[0]] if len(xs) == 1 else b"".join(map(pieces.__getitem__, xs))

    def decode(self, ids: list[bytes]) -> list[bytes]:
        out = [b""] * len(ids)
        at = 0
        while at < len(ids):
            first, held = at, 0
            while at < len(ids) and (at == first or held + len(ids[at]) // 4 <= SLICE):
                held += len(ids[at]) // 4
                at += 1
            for lo in range(0, max(held, 1), SLICE):  # more than one turn only for a single text of more than SLICE ids
                own = ids[first:at] if held <= SLICE else [ids[first][4 * lo : 4 * (lo + SLICE)]]
                sizes = np.fromiter((len(x) // 4 for x in own), np.int64, len(own))
                flat = np.frombuffer(b"".join(own), "<u4").astype(np.int32)
                tokens = pa.table({"doc": np.repeat(np.arange(len(own), dtype=np.int32), sizes), "pos": np.arange(len(flat), dtype=np.int32), "id": flat})  # noqa: F841
                for doc, text in self.db.execute(DECODE).fetchall():
                    out[first + doc] += bytes.fromhex(text)
        return out


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _named(path: str | None, pattern: str | None) -> tuple[str, str]:
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    return path, pattern


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, ids (array of int). ``path`` is read on the executors; by default that of the installed vocabulary."""

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        own = codec(*_named(path, pattern))
        for b in batches:
            for at in range(0, len(b[text]), 1000):
                ids = own.encode(b[text][at : at + 1000])
                yield {key: b[key][at : at + 1000], "ids": [np.frombuffer(x, "<u4").astype(np.int32) for x in ids]}

    return map_rows(docs.select(key, text), f"{key} {docs.schema[key].dataType.simpleString()}, ids array<int>", work)


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """key, bytes (binary): the bytes of the ids of each row."""

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        own = codec(*_named(path, pattern))
        for b in batches:
            raw = [np.asarray(x or [], "<u4").tobytes() for x in b[ids]]
            yield {key: b[key], "bytes": own.decode(raw)}

    return map_rows(encoded.select(key, ids), f"{key} {encoded.schema[key].dataType.simpleString()}, bytes binary", work)


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256: digests of the ids and of the bytes decoded from them."""

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        own = codec(*_named(path, pattern))
        for b in batches:
            for at in range(0, len(b[text]), 1000):
                ids = own.encode(b[text][at : at + 1000])
                yield {
                    key: b[key][at : at + 1000],
                    "n_tokens": [len(x) // 4 for x in ids],
                    "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                    "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in own.decode(ids)],
                }

    kind = docs.schema[key].dataType.simpleString()
    return map_rows(docs.select(key, text), f"{key} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", work)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))

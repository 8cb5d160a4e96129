"""N-gram Jaccard join: size-aware, with subsets for small sets and inverted lists for large ones.

A document is the set of its different five-word shingles. Documents with equal
sets are one class. Two classes link when their Jaccard similarity is 0.75 or
more, which needs an overlap of ``o = ceil(3 s / 4)`` for a set of ``s``. Under
any total order of shingles, sets with overlap ``o`` or more share ``k`` of the
first ``s - o + k``. The order puts rare shingles first, by a count sketch of
fixed size over all documents, so common passages fall behind the prefix. On
large inputs every counter holds many shingles; what counts as a long list is
therefore what a counter holds beyond the usual one and its spread.

Small sets enumerate the pairs (``k = 2``) of their prefix; equal pairs make
candidates. Large sets and the small ones that may link with them enter the
tokens of their prefix (``k = 4``) into inverted lists, which are scanned; a set
that meets others under fewer than ``k`` of its tokens has no link and goes. The
boundary between small and large is the size that makes the estimated cost of
both, rows plus candidates, least; it comes from a histogram by size.

Lists are cut into segments of compatible sizes, and segments that begin with
the same set are one group, so a set meets its mates once however many keys they
share. A group's whole sets come together in blocks of bounded size, and every
pair of blocks is checked exactly. Inside, a set that already belongs to the
group's largest component is not compared again, and only links that join two
components are returned: no link between components is lost, and neither pairs
nor links of a group are all emitted.

Defined results: a null or empty text, or one of white space, has an empty set
and is linked with nothing; a text of one to four words is one shingle; equal
texts with different ids, and equal ids with different texts, are separate
rows; a row without an id gets the component of its class's ids, or null; an
empty table gives an empty table; very long texts are read whole; further
columns are ignored by ``join`` and kept by ``keep_one``, whatever their names.
``keep_one`` leaves one row of each component, of the least id, then the least
text and the least of the other columns as JSON; rows without an id come last,
and rows that are equal in every column are one. Rows without shingles all
stay. Shingles, sets and classes are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import Scratch, free_shuffles, map_rows, spark_arrow, words
from tideline.llm.components import components

SHINGLE = 5
#: Tokens that linked sets share in the prefixes of inverted lists.
SHARED = 4
#: Jaccard threshold as a fraction.
NUM, DEN = 3, 4
#: log2 of the sketch's counters; its slices.
SKETCH, SLICES = 20, 32
#: Greatest size that the boundary may be.
SHORT = 64
#: What a candidate costs against a signature row, and the list length from which a list is dealt to several tasks.
CANDIDATE_COST, LONG_LIST = 4.0, 4096
#: Shingles in a block, about.
BLOCK_ITEMS = 250_000
#: Rows from which a group is hot, and how many hot groups there may be at most: with more rows the limit is raised.
HOT_ROWS, HOT_GROUPS = 4096, 50_000
#: log2 of the bits that tell the wanted sets, at least and at most; between them 16 bits for each.
LEAST_BITS, MOST_BITS = 23, 28
#: Share of a shingle's list that a pair's list is taken to have.
PAIR_SHARE = 0.02
_ODD = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]


class _Words(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hash = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted different 64-bit hashes of the text's shingles."""
    w = words(text)
    n = len(w)
    if not n:
        return np.zeros(0, np.uint64)
    if n < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w), seed=n)], np.uint64)
    h = np.fromiter(map(_hash.__getitem__, w), np.uint64, n)
    x = h[: n - 4] * _ODD[0]
    for k in range(1, SHINGLE):
        x += h[k : n - 4 + k] * _ODD[k]
    x = _mix(x)
    x.sort()
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _node(s: np.ndarray) -> int | None:
    return None if not len(s) else int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))


def needed(s: np.ndarray | int) -> np.ndarray | int:
    """Least overlap of a set of size s with any set that it links with."""
    return -(-NUM * s // DEN)


def needed_up(s: np.ndarray | int) -> np.ndarray | int:
    """Least overlap with a set that is not smaller."""
    return -(-2 * NUM * s // (NUM + DEN))


def _scan(docs: DataFrame, kind: str) -> DataFrame:
    """doc_id, n, node of each document, with the set itself if it is short (part 0), and slices of the sketch (part 1)."""

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        counts = np.zeros(1 << SKETCH, np.uint32)
        for b in batches:
            sets = [shingles(t) for t in b["text"]]
            n = len(sets)
            for at in range(0, n, 1000):
                own = np.concatenate(sets[at : at + 1000])
                counts += np.bincount((own >> np.uint64(64 - SKETCH)).view(np.int64), minlength=1 << SKETCH).astype(np.uint32)
            yield {"part": [0] * n, "doc_id": b["doc_id"], "n": [len(s) for s in sets], "node": [_node(s) for s in sets], "slice": [None] * n, "data": [s.tobytes() if DEN - 1 <= len(s) <= SHORT else None for s in sets]}
        own = counts.reshape(SLICES, -1)
        yield {"part": [1] * SLICES, "doc_id": [None] * SLICES, "n": [None] * SLICES, "node": [None] * SLICES, "slice": list(range(SLICES)), "data": [x.tobytes() for x in own]}

    return map_rows(docs.select("doc_id", "text"), f"part int, doc_id {kind}, n long, node long, slice int, data binary", work)


def _sketch(scanned: DataFrame) -> np.ndarray:
    """The summed sketch: 2 ** SKETCH counters, whatever the input's size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b.column("slice").to_pylist(), b.column("data").to_pylist(), strict=True):
                x = np.frombuffer(raw, np.uint32).astype(np.int64)
                sums[k] = sums[k] + x if k in sums else x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["slice", "data"])

    parts = scanned.filter("part = 1").select("slice", "data").repartition(SLICES // 4, "slice")
    rows = parts.mapInArrow(add, "slice int, data binary").collect()
    out = np.zeros((SLICES, (1 << SKETCH) // SLICES), np.int64)
    for r in rows:
        out[r["slice"]] = np.frombuffer(r["data"], np.int64)
    return np.minimum(out.ravel(), 2**32 - 1).astype(np.uint32)


class _Signer:
    """Signature rows of sets, given the sketch and the boundary."""

    def __init__(self, sketch: np.ndarray, boundary: int, long_list: int):
        self.sketch, self.boundary, self.long_list = sketch, boundary, long_list
        self.shift = np.uint64(64 - (len(sketch).bit_length() - 1))
        middle, high = np.percentile(sketch, (50, 84))
        self.usual = middle + 4 * max(1.0, high - middle)  # what other shingles of a counter come to

    def ways(self, counts: np.ndarray) -> np.ndarray:
        """Parts that the list of a shingle is dealt to; one where its counter tells nothing beyond the usual."""
        return 1 + np.maximum(0, counts - self.usual).astype(np.int64) // self.long_list

    def ordered(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The set in its order, rare shingles first, and the counts."""
        c = self.sketch[(s >> self.shift).view(np.int64)]
        order = np.argsort(c, kind="stable")
        return s[order], c[order]

    def lists(self, s: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(s)
        k = min(SHARED, needed(n))
        p = n - needed(n) + k
        return s[:p], (np.arange(p) < n - needed_up(n) + k).astype(np.int8), c[:p]

    def subsets(self, s: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(s)
        i, j = np.triu_indices(n - needed(n) + 2, 1)
        low, high = np.minimum(s[i], s[j]), np.maximum(s[i], s[j])
        return _mix(low * _ODD[1] + high * _ODD[2]), (2 + (j < n - needed_up(n) + 2)).astype(np.int8), np.minimum(c[i], c[j])

    def rows(self, s: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(keys, flags, counts); flags: 1 where the set may be the smaller one of a pair, 2 for keys of pairs."""
        n = len(s)
        if n < DEN - 1:  # such a set links with equal sets only
            return []
        s, c = self.ordered(s)
        out = []
        if n <= self.boundary:
            out.append(self.subsets(s, c))
        if DEN * n > NUM * self.boundary:  # large, or small with a large partner
            out.append(self.lists(s, c))
        return out


def _boundary(scanned: DataFrame, sketch) -> int:  # type: ignore[no-untyped-def]
    """The size that parts small from large sets at the least estimated cost.

    Sets beyond ``SHORT`` are large: their pairs outnumber any gain from shorter lists.
    """

    def cost(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        subset, scan = np.zeros(SHORT + 1), np.zeros(SHORT + 1)
        own, mean = _Signer(sketch.value, 0, LONG_LIST), float(sketch.value.mean())
        for b in batches:
            for raw in b["data"]:
                s, c = own.ordered(np.frombuffer(raw, np.uint64))
                p = len(s) - needed(len(s)) + 1
                mates = np.maximum(c[: p + 1].astype(float) - mean, 0)  # list lengths beyond the sketch's noise
                subset[len(s)] += p * (p + 1) / 2 + CANDIDATE_COST * (mates[:-1] @ np.arange(p, 0, -1)) * PAIR_SHARE
                scan[len(s)] += p + CANDIDATE_COST * mates[:p].sum()
        yield {"size": list(range(SHORT + 1)), "subset": subset, "scan": scan}

    rows = map_rows(scanned.filter("part = 0 AND data IS NOT NULL").select("data"), "size int, subset double, scan double", cost)
    found = rows.groupBy("size").agg(F.sum("subset").alias("subset"), F.sum("scan").alias("scan")).orderBy("size").collect()  # at most SHORT + 1 rows
    boundary, gain, most = 0, 0.0, 0.0
    for r in found:
        gain += r["scan"] - r["subset"]
        if gain > most:
            boundary, most = r["size"], gain
    return boundary


def _signatures(docs: DataFrame, sketch, boundary: int) -> DataFrame:  # type: ignore[no-untyped-def]
    """key, deal, node, size, flags: the signature rows of each different set, once per task."""
    schema = "key long, deal int, node long, size int, flags byte"
    target = spark_arrow(docs.sparkSession, schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = _Signer(sketch.value, boundary, LONG_LIST), set()

        def flush(held: list[tuple[np.ndarray, int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            sizes = [len(k) for k, *_ in held]
            keys = np.concatenate([k for k, *_ in held])
            nodes = np.repeat(np.array([x for _, x, *_ in held], np.int64), sizes)
            counts = np.concatenate([c for *_, c in held]).astype(np.int64)
            ways = own.ways(counts)  # a long list is dealt anew for each key, so that its parts meet through other keys
            deal = np.where(ways > 1, 1 + (_mix(nodes.view(np.uint64) ^ keys) % ways.astype(np.uint64)).astype(np.int64), 0).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(_signed(keys)), pa.array(deal), pa.array(nodes), pa.array(np.repeat(np.array([s for _, _, s, *_ in held], np.int32), sizes)), pa.array(np.concatenate([f for *_, f, _ in held]))], schema=target)

        held, n = [], 0
        for b in batches:
            for text in b.column("text").to_pylist():
                s = shingles(text)
                node = _node(s)
                if node is None or node in seen:
                    continue
                seen.add(node)
                for keys, first, counts in own.rows(s):
                    held.append((keys, node, len(s), first, counts))
                    n += len(keys)
                if n > 100_000:
                    yield flush(held)
                    held, n = [], 0
        if held:
            yield flush(held)

    return docs.select("text").mapInArrow(work, schema)


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches, cut so that no run of equal (key, deal) is parted."""
    rest: list[np.ndarray] | None = None
    for b in batches:
        own = [np.asarray(b.column(c).to_numpy(zero_copy_only=False)) for c in columns]
        if rest is not None:
            own = [np.concatenate(x) for x in zip(rest, own, strict=True)]
        last = int(np.flatnonzero((own[0] != own[0][-1]) | (own[1] != own[1][-1])).max(initial=-1)) + 1
        if last:
            yield [x[:last] for x in own]
        rest = [x[last:] for x in own]
    if rest is not None and len(rest[0]):
        yield rest


def _groups(signatures: DataFrame, scratch: Scratch) -> DataFrame:
    """Different (leader, node, size): the sets that share a key and a segment of sizes with ``leader``, it included.

    A segment holds two neighbouring classes of sizes, each a third wider than its start, so two sets that may link are in
    one segment; it is skipped where the one before holds all of it. A key that was dealt to several tasks has a leader in
    each; those groups are made one.
    """
    schema = "leader long, node long, size int, subset boolean, dealt long"
    target = spark_arrow(signatures.sparkSession, schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, deal, node, size, flags in _runs(batches, ["key", "deal", "node", "size", "flags"]):
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (deal[1:] != deal[:-1])])
            same = np.concatenate([[False], (node[1:] == node[:-1])]) & ~new
            key, deal, node, size, flags, new = (x[~same] for x in (key, deal, node, size, flags, new))
            level = np.floor(np.log(size) / np.log(DEN / NUM) + 1e-9).astype(np.int64)
            slot = (np.cumsum(new) - 1) * 4096 + level  # rows are sorted by size within a run, so slots ascend
            there = np.unique(slot)
            has = lambda x: there[np.minimum(np.searchsorted(there, x), len(there) - 1)] == x
            own = ~has(slot - 1) | has(slot + 1) | (deal > 0)  # else the segment that starts at the row's level is inside the one before
            before = has(slot - 1) | (deal > 0)
            rows = np.concatenate([np.flatnonzero(own), np.flatnonzero(before)])
            segment = np.concatenate([slot[own], slot[before] - 1])
            order = np.lexsort((rows, segment))
            rows, segment = rows[order], segment[order]
            starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
            counts = np.diff([*starts, len(rows)])
            useful = (counts > 1) & (np.maximum.reduceat(flags[rows] & 1, starts) > 0) | (deal[rows[starts]] > 0)
            take = np.repeat(useful, counts)
            if take.any():
                leader = np.repeat(node[rows[starts]], counts)[take]
                at = rows[take]
                cut = _mix(key[at].view(np.uint64) + (segment[take] % 4096).astype(np.uint64)).view(np.int64)
                dealt = pa.array(cut, mask=(deal[at] == 0) | (node[at] != leader))
                yield pa.RecordBatch.from_arrays([pa.array(leader), pa.array(node[at]), pa.array(size[at].astype(np.int32)), pa.array(flags[at] > 1), dealt], schema=target)

    sorted_rows = signatures.repartition("key", "deal").sortWithinPartitions("key", "deal", "size", "node").mapInArrow(work, schema)
    met = scratch.save(sorted_rows.groupBy("leader", "node", "size", "subset", "dealt").agg(F.count(F.lit(1)).alias("keys")), "met")
    # What a set's prefix shares with others: a pair key is enough, of single tokens it takes SHARED.
    least = F.least(F.lit(SHARED), F.ceil(F.col("size") * NUM / DEN))
    stay = met.groupBy("node").agg(F.max("subset").alias("subset"), F.sum(F.when(~F.col("subset"), F.col("keys"))).alias("keys"), F.max("size").alias("size"))
    stay = stay.filter(F.col("subset") | (F.col("keys") >= least)).select("node")
    groups = met.select("leader", "node", "size").distinct().join(stay, "node")
    parts = met.filter("dealt IS NOT NULL")
    if not parts.isEmpty():
        heads = parts.groupBy("dealt").agg(F.min("leader").alias("v"))
        one = components(parts.join(heads, "dealt").select(F.col("leader").alias("u"), "v"), scratch, "dealt")
        groups = groups.join(one.select(F.col("node").alias("leader"), "label"), "leader", "left").select(F.coalesce("label", "leader").alias("leader"), "node", "size").distinct()
    return groups


def _bitmap(nodes: DataFrame, column: str, number: int):  # type: ignore[no-untyped-def]
    """(broadcast bits, log2 of their number): which values of a hash are among ``nodes``, and some others.

    ``number``: how many nodes there are, about. The bits are 32 MB at most, whatever the number.
    """
    bits = int(min(MOST_BITS, max(LEAST_BITS, np.ceil(np.log2(16 * max(1, number))))))
    slot = F.pmod(column, F.lit(1 << bits)) + 1  # the bitmap functions count from 1
    rows = nodes.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m")).collect()
    packed = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows:
        packed[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(bytes(r["m"]), np.uint8)
    return nodes.sparkSession.sparkContext.broadcast(packed), bits


def _is_set(packed: np.ndarray, bits: int, node: int) -> bool:
    slot = node % (1 << bits)
    return bool(packed[slot >> 3] >> (slot & 7) & 1)


def _sets(docs: DataFrame, wanted: DataFrame, number: int) -> DataFrame:
    """(node, items) of the sets whose nodes are in ``wanted``, and of some others.

    Which texts to read again is told by a bitmap, so no other set is shuffled while few are wanted.
    """
    shared, bits = _bitmap(wanted, "node", number)

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        seen: set[int] = set()
        for b in batches:
            nodes, items = [], []
            for text in b["text"]:
                s = shingles(text)
                node = _node(s)
                if node is not None and node not in seen and _is_set(shared.value, bits, node):
                    seen.add(node)
                    nodes.append(node)
                    items.append(_signed(s))
            yield {"node": nodes, "items": items}

    return map_rows(docs.select("text"), "node long, items array<long>", work).dropDuplicates(["node"])


def _matched(nodes: np.ndarray, items: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Links between sets that join them into components; all links between final components have been looked for."""
    m, us, vs = len(nodes), [], []
    sizes = np.fromiter(map(len, items), np.int64, m)
    flat = np.concatenate(items)
    codes = np.unique(flat, return_inverse=True)[1].astype(np.int32)
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(int(codes.max()) + 1, np.int64)
    label, fresh, i = np.arange(m), np.ones(m, bool), 0
    while True:
        fresh[i] = False
        own = codes[starts[i] : starts[i] + sizes[i]]
        mark[own] = 1
        both = np.add.reduceat(mark[codes], starts)
        mark[own] = 0
        for j in np.flatnonzero((DEN * both >= NUM * (sizes + sizes[i] - both)) & (label != label[i])):
            if label[j] != label[i]:
                us.append(int(nodes[i]))
                vs.append(int(nodes[j]))
                label[label == label[j]] = label[i]
        left = np.flatnonzero(fresh & (label != np.bincount(label).argmax()))
        if not len(left):
            return us, vs
        i = int(left[0])


def _links(groups: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (u, v) that join the sets of each group into components."""
    total = groups.count()
    hot = max(HOT_ROWS, total // HOT_GROUPS)
    sizes = groups.groupBy("leader").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("items")).filter("rows > 1")
    sizes = scratch.save(sizes.select("leader", "rows", F.greatest(F.lit(1), F.ceil(F.col("items") / BLOCK_ITEMS)).cast("int").alias("blocks")), "sizes")
    # At most HOT_GROUPS hot groups: their rows stay where they are, only those of the others meet by leader.
    marked = groups.join(F.broadcast(sizes.filter(F.col("rows") > hot).select("leader", F.col("blocks").alias("__hot"))), "leader", "left")
    cold = marked.filter("__hot IS NULL").drop("__hot").join(sizes.filter(F.col("rows") <= hot).select("leader", "blocks"), "leader")
    rows = scratch.save(marked.filter("__hot IS NOT NULL").withColumnRenamed("__hot", "blocks").unionByName(cold), "rows")
    sets = _sets(docs, rows.select("node"), min(total, rows.count()))
    own = F.pmod(F.xxhash64("leader", "node"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("leader", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), "node").join(sets, "node")
    schema = "u long, v long"
    target = spark_arrow(docs.sparkSession, schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, nodes, items, us, vs = None, [], [], [], []

        def close() -> None:
            if len(nodes) > 1:
                found = _matched(np.array(nodes, np.int64), items)
                us.extend(found[0])
                vs.extend(found[1])
            nodes.clear()
            items.clear()

        for b in batches:
            lists = b.column("items")
            flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            for k, (leader, b1, b2, node) in enumerate(zip(*(b.column(c).to_pylist() for c in ("leader", "b1", "b2", "node")), strict=True)):
                if (leader, b1, b2) != group:
                    close()
                    group = (leader, b1, b2)
                if not nodes or nodes[-1] != node:
                    nodes.append(node)
                    items.append(flat[ends[k] : ends[k + 1]].copy())
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], schema=target)
                us, vs = [], []
        close()
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], schema=target)

    dealt = rows.repartition("leader", "b1", "b2").sortWithinPartitions("leader", "b1", "b2", F.size("items"), "node")
    return dealt.mapInArrow(work, schema)


def classes(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, n, node, label of every document: its set's size and hash, and its component's."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    scanned = scratch.save(_scan(docs, kind), "scan")
    rows = scanned.filter("part = 0").select("doc_id", "n", "node")
    sketch = spark.sparkContext.broadcast(_sketch(scanned))
    boundary = _boundary(scanned, sketch)
    groups = scratch.save(_groups(_signatures(docs, sketch, boundary), scratch), "groups")
    free_shuffles(spark)
    labels = scratch.save(components(_links(groups, docs, scratch), scratch, "stars"), "labels")
    free_shuffles(spark)
    scratch.drop("groups", "met", "rows", "sizes")
    return rows.join(labels, "node", "left").select("doc_id", "n", "node", F.coalesce("label", "node").alias("label"))


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document: the least doc_id that links reach from it."""
    scratch = Scratch(docs.sparkSession, "ngram-join")
    found = classes(docs, scratch)
    least = found.filter(F.col("label").isNotNull()).groupBy("label").agg(F.min("doc_id").alias("least"))
    return found.join(least, "label", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, with all its columns; documents without shingles all stay.

    Only rows whose set is in several rows or linked are shuffled: a bitmap tells them, and some others.
    """
    scratch = Scratch(docs.sparkSession, "keep-one")
    found = scratch.save(classes(docs, scratch).filter("n > 0").groupBy("node", "label").agg(F.count(F.lit(1)).alias("rows")), "found")
    several = found.groupBy("label").agg(F.sum("rows").alias("all")).filter("all > 1").select("label")
    linked = scratch.save(found.join(several, "label").select("node", "label"), "linked")
    shared, bits = _bitmap(linked, "node", linked.count())

    @F.arrow_udf("long")
    def marked(texts: pa.Array) -> pa.Array:
        """The set's hash where the bitmap has it, else null."""
        out: list[int | None] = []
        for at in range(0, len(texts), 1000):
            nodes = [_node(shingles(t)) for t in texts.slice(at, 1000).to_pylist()]
            out += [n if n is not None and _is_set(shared.value, bits, n) else None for n in nodes]
        return pa.array(out, pa.int64())

    rows = scratch.save(docs.select(F.struct("*").alias("__row"), marked("text").alias("__node")), "kept")  # both branches below read it
    grouped = rows.filter("__node IS NOT NULL").join(linked.select(F.col("node").alias("__n"), "label"), F.col("__node") == F.col("__n"), "left")
    own = F.col("__row")
    others = [own.getField(c).alias(c) for c in docs.columns if c not in ("doc_id", "text")]
    order = F.struct(own.getField("doc_id").isNull(), own.getField("doc_id"), own.getField("text"), F.to_json(F.struct(*others)) if others else F.lit(""))
    kept = grouped.groupBy(F.coalesce("label", "__node").alias("__key")).agg(F.min_by("__row", order).alias("__row"))
    return rows.filter("__node IS NULL").select("__row.*").unionByName(kept.select("__row.*"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: All pairs that share a shingle, and the least id that links reach. It has no set for a null text and none for white space.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS shingle FROM d),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM g GROUP BY r),
links AS MATERIALIZED (SELECT p.a, p.b FROM (SELECT x.r AS a, y.r AS b, count(*) AS common FROM g x JOIN g y ON x.shingle = y.shingle AND x.r <> y.r GROUP BY ALL) p
  JOIN n na ON p.a = na.r JOIN n nb ON p.b = nb.r WHERE 100 * common >= 75 * (na.n + nb.n - common)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, min(o.doc_id)) AS component_id
FROM d LEFT JOIN n ON d.r = n.r LEFT JOIN reach ON d.r = reach.a LEFT JOIN d o ON reach.b = o.r GROUP BY d.r, d.doc_id, n.n"""

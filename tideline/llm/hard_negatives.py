"""Hard negatives by dual-tree search for the largest inner products.

Two binary trees, one over anchors and one over candidates, are fitted on bounded samples (``SAMPLE`` rows); every row
then goes down its tree to a leaf, and each node's count, radius about its centre and greatest length are taken over
all rows under it. For a pair of nodes these bound every inner product between them:

    centres' product +- (|a| * rc + |c| * ra + ra * rc), and not beyond the product of the greatest lengths.

Each anchor first meets the leaf that it would itself go to, which gives it a floor: the last score of a full list.
Pairs of nodes are then walked from both roots, all pairs of a level at once; where the interval lies below the lowest
floor of the anchors under the node, or above what they may take, all of them and the whole subtree part at once. The
leaf pairs that remain are scored exactly, in whole numbers. The walk runs in tasks, one for each upper subtree of the
anchors.

Candidates lie in blocks of about ``block_rows`` rows, a large leaf in several by a hash; a task holds one block and
lets the anchors that meet it stream past, so neither a hot vector nor many anchors gather in one place. Lists are cut
to their length before and after the shuffle that joins them. Where vectors are spread evenly in all directions the
intervals part little, and the work is that of all anchors against all rows, in blocks.

Defined results: rows without id or label, and rows whose vector is null, empty, or holds null or non-finite entries
take no part, nor do those whose length is not the commonest, or whose whole-number squared length is 2^56 or more (their
scores would not fit a long); an anchor's own id is never its positive; repeated ids are separate candidates and
separate anchors, rows equal in id, label and vector one anchor; ties go to the smaller id; an anchor without positives,
or a positive without negatives in its band, has no rows; a negative positive score leaves an empty band; an empty table
gives an empty one; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm.common import Scratch, partitions, spark_arrow

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 5, 80, 100, 256
#: Rows that trees are fitted on, candidates and anchors of a leaf about, leaves of the two trees and rows of a block at most.
SAMPLE, LEAF, ANCHOR_LEAF, LEAVES, ANCHOR_LEAVES, BLOCK = 16384, 2048, 128, 4096, 1024, 2048
#: Numbers that a sample, a tree or a block holds at most, about; long vectors so get fewer rows.
NUMBERS = 1 << 22
#: Upper subtrees of the anchors that are walked in tasks of their own.
SUBTREES = 64
ENDLESS = 1 << 62


class Tree:
    """Binary splits of a sample, each halfway between two means; the node of the greatest scatter is split next. Node 0 is the root."""

    def __init__(self, sample: np.ndarray, leaves: int):
        dim = sample.shape[1]
        centre = sample.mean(0) if len(sample) else np.zeros(dim)
        self.children, self.parent, self.lines, self.cuts, self.centres = [[-1, -1]], [-1], [np.zeros(dim)], [0.0], [centre]
        scatter = lambda rows: float(((sample[rows] - sample[rows].mean(0)) ** 2).sum()) if len(rows) else 0.0
        every = np.arange(len(sample))
        open_ = [(-scatter(every), 0, every)]
        while open_ and (len(self.parent) + 1) // 2 < leaves:
            spread, node, rows = heapq.heappop(open_)
            line, cut = self._split(sample[rows])
            right = sample[rows] @ line > cut
            if spread == 0 or right.all() or not right.any():
                continue
            self.lines[node], self.cuts[node], self.children[node] = line, cut, [len(self.parent), len(self.parent) + 1]
            for side in (rows[~right], rows[right]):
                heapq.heappush(open_, (-scatter(side), len(self.parent), side))
                self.parent.append(node)
                self.children.append([-1, -1])
                self.lines.append(np.zeros(dim))
                self.cuts.append(0.0)
                self.centres.append(sample[side].mean(0))
        self.children, self.parent, self.lines, self.cuts, self.centres = (np.array(v) for v in (self.children, self.parent, self.lines, self.cuts, self.centres))
        self.leaf = self.children[:, 0] < 0

    @staticmethod
    def _split(own: np.ndarray, rounds: int = 4) -> tuple[np.ndarray, float]:
        """The plane halfway between two means, begun at two far rows."""
        one = own[((own - own.mean(0)) ** 2).sum(1).argmax()]
        two = own[((own - one) ** 2).sum(1).argmax()]
        for _ in range(rounds):
            line, cut = two - one, float((two @ two - one @ one) / 2)
            right = own @ line > cut
            if right.all() or not right.any():
                break
            one, two = own[~right].mean(0), own[right].mean(0)
        return line, cut

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(len(self.parent)):
            inner = np.nonzero(~self.leaf[node])[0]
            if not len(inner):
                break
            own = node[inner]
            node[inner] = self.children[own, (np.einsum("ij,ij->i", x[inner], self.lines[own]) > self.cuts[own]).astype(int)]
        return node

    def up(self, values: np.ndarray, merge: np.ufunc) -> np.ndarray:
        """Values of leaves carried to all nodes above; children have greater numbers than parents."""
        out = values.copy()
        for node in range(len(self.parent) - 1, 0, -1):
            out[self.parent[node]] = merge(out[self.parent[node]], out[node])
        return out

    def tops(self, most: int) -> list[int]:
        """Nodes whose subtrees part the tree."""
        level = [0]
        while len(level) < most and not self.leaf[level].all():
            level = [c for n in level for c in ([n] if self.leaf[n] else self.children[n].tolist())]
        return level


def measured(rows: DataFrame, tree: Tree, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, radius, greatest length) of every node, over the whole table ``rows`` (leaf, v)."""
    schema = "node int, n long, radius double, length double"
    target = spark_arrow(rows.sparkSession, schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, radius, length = (np.zeros(len(tree.parent)) for _ in range(3))
        for b in batches:
            node, x = b.column(0).to_numpy().astype(np.int64), vectors(b.column(1), dim)
            size = np.sqrt((x * x).sum(1))
            while len(node):
                np.add.at(n, node, 1)
                np.maximum.at(radius, node, np.sqrt(((x - tree.centres[node]) ** 2).sum(1)))
                np.maximum.at(length, node, size)
                above = tree.parent[node] >= 0
                node, x, size = tree.parent[node[above]], x[above], size[above]
        seen = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip((seen, n[seen].astype(np.int64), radius[seen], length[seen]), target, strict=True)], schema=target)

    found = rows.select("leaf", "v").mapInArrow(work, schema).groupBy("node").agg(F.sum("n"), F.max("radius"), F.max("length")).toArrow()  # a row for each node
    out = tuple(np.zeros(len(tree.parent)) for _ in range(3))
    for values, k in zip(out, (1, 2, 3), strict=True):
        values[found.column(0).to_numpy()] = found.column(k).to_numpy()
    return out


def walk(root: int, anchors: Tree, a_size: tuple, candidates: Tree, c_size: tuple, floor: np.ndarray, ceiling: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaf pairs (anchors below ``root``, candidates) that may hold a score from the anchors' floor to their ceiling."""
    a, c, out = np.array([root]), np.array([0]), []
    (_, ra, la), (nc, rc, lc) = a_size, c_size
    norm_a, norm_c = (np.sqrt((t.centres**2).sum(1)) for t in (anchors, candidates))
    while len(a):
        parts = []
        for at in range(0, len(a), 65536):
            i, j = a[at : at + 65536], c[at : at + 65536]
            middle = np.einsum("ij,ij->i", anchors.centres[i], candidates.centres[j])
            reach = norm_a[i] * rc[j] + norm_c[j] * ra[i] + ra[i] * rc[j]
            slack = 1 + 1e-9 * (np.abs(middle) + reach)  # for rounding; scores are whole numbers
            most = la[i] * lc[j] + slack
            keep = (nc[j] > 0) & (np.minimum(middle + reach + slack, most) >= floor[i]) & (np.maximum(middle - reach - slack, -most) <= ceiling[i])
            parts.append(keep)
        keep = np.concatenate(parts)
        a, c = a[keep], c[keep]
        done = anchors.leaf[a] & candidates.leaf[c]
        out.append((a[done], c[done]))
        a, c = a[~done], c[~done]
        first = ~anchors.leaf[a] & (candidates.leaf[c] | (ra[a] >= rc[c]))  # the wider one is opened
        a, c = (
            np.concatenate([anchors.children[a[first]].ravel(), np.repeat(a[~first], 2)]),
            np.concatenate([np.repeat(c[first], 2), candidates.children[c[~first]].ravel()]),
        )
    return np.concatenate([p for p, _ in out]), np.concatenate([p for _, p in out])


def vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), dim)


def first_of(block: tuple, asked: tuple, same: bool, k: int) -> tuple[list[np.ndarray], ...]:
    """For each asked row and each of its bands the first ``k`` rows of the block: (asked row, band, id, score)."""
    ids, labels, x = block
    own, own_labels, y, low, high = asked
    out: tuple[list[np.ndarray], ...] = ([], [], [], [])
    exact = (x * x).sum(1).max() * (y * y).sum(1).max() < 2.0**104  # all sums below 2^53 stay whole in doubles
    scores = y @ x.T if exact else y.astype(np.int64) @ x.astype(np.int64).T
    none = -np.inf if exact else np.iinfo(np.int64).min
    fits = own_labels[:, None] == labels[None, :]
    fits = fits & (own[:, None] != ids[None, :]) if same else ~fits
    for band in range(low.shape[1]):
        open_ = np.where(fits & (scores >= low[:, band, None]) & (scores <= high[:, band, None]), scores, none)
        rows = np.arange(len(own))
        for _ in range(min(k, len(ids))):
            at = open_[rows].argmax(1)  # the first of equal scores: rows go by id
            best = open_[rows, at]
            rows, at, best = rows[best > none], at[best > none], best[best > none]
            if not len(rows):
                break
            open_[rows, at] = none
            for values, more in zip(out, (rows, np.full(len(rows), band), ids[at], best.astype(np.int64)), strict=True):
                values.append(more)
    return out


class Search:
    """Candidates placed in blocks, and the tree over them."""

    def __init__(self, rows: DataFrame, anchors: DataFrame, n: int, dim: int, scratch: Scratch, leaf_rows: int, block_rows: int):
        self.spark, self.dim, self.scratch = rows.sparkSession, dim, scratch
        block_rows = max(64, min(block_rows, NUMBERS // dim))
        self.tree, self.own = self._tree(rows, n, leaf_rows, LEAVES), self._tree(anchors, anchors.count(), ANCHOR_LEAF, ANCHOR_LEAVES)
        placed = scratch.save(self._placed(rows, [self.tree], ["leaf"]), "placed")
        # A tree of one leaf prunes nothing, so only its rows are known.
        self.size = measured(placed, self.tree, dim) if self.parted else (np.array([float(n)]),) * 3
        blocks = [(int(k), max(1, -(-int(self.size[0][k]) // block_rows))) for k in np.nonzero(self.tree.leaf)[0]]
        #: At most LEAVES rows.
        self.blocks = self.spark.createDataFrame(blocks, "leaf int, parts int")
        part = F.pmod(F.xxhash64("id", "v"), F.col("parts"))
        self.rows = placed.join(F.broadcast(self.blocks), "leaf").select(self._block(part).alias("block"), "id", "label", "v")
        self.anchors = scratch.save(self._placed(anchors, [self.own, self.tree], ["leaf", "home"]), "anchors")
        self.anchor_size = measured(self.anchors, self.own, dim) if self.parted else None

    @property
    def parted(self) -> bool:
        return len(self.tree.parent) > 1

    def _tree(self, rows: DataFrame, n: int, leaf_rows: int, leaves: int) -> Tree:
        most = max(1, min(leaves, NUMBERS // (4 * self.dim), n // leaf_rows))
        if most == 1:
            return Tree(np.zeros((0, self.dim)), 1)
        limit = min(SAMPLE, NUMBERS // self.dim)
        share = F.pmod(F.xxhash64("id", F.lit(12)), F.lit(max(1, n // (2 * limit)))) == 0
        return Tree(vectors(rows.filter(share).select("v").limit(limit).toArrow().column(0).combine_chunks(), self.dim), most)

    @staticmethod
    def _block(part: Column) -> Column:
        return F.col("leaf") * F.lit(1 << 32) + part

    def _placed(self, rows: DataFrame, trees: list[Tree], names: list[str]) -> DataFrame:
        kept, dim = rows.columns, self.dim
        schema = ", ".join([f"{n} int" for n in names] + [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema])
        target = spark_arrow(rows.sparkSession, schema)
        place = kept.index("v")

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, len(b), 2048):
                    part = b.slice(at, 2048)
                    x = vectors(part.column(place), dim)
                    yield pa.RecordBatch.from_arrays([*[pa.array(t.leaves_of(x), pa.int32()) for t in trees], *part.columns], schema=target)

        return rows.mapInArrow(work, schema)

    def _met(self, asked: DataFrame, same: bool, k: int) -> DataFrame:
        """The first ``k`` of each band from every block that an asked row (block, id, twin, label, v, low, high) meets."""
        dim, schema = self.dim, "id long, twin int, band int, other long, score long"
        target = spark_arrow(self.spark, schema)
        blank = F.array().cast("array<long>")
        both = self.rows.select("block", F.lit(0).alias("kind"), "id", F.lit(0).alias("twin"), "label", "v", blank.alias("low"), blank.alias("high"))
        both = both.unionByName(asked.select("block", F.lit(1).alias("kind"), "id", "twin", "label", "v", "low", "high"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at_block, held, ready = None, [], None
            for b in batches:
                blocks, kinds = b.column(0).to_numpy(), b.column(1).to_numpy()
                ends = [*(np.nonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0))[0] + 1).tolist(), len(b)]
                for lo, hi in zip([0, *ends[:-1]], ends, strict=True):
                    if lo == hi:
                        continue
                    if blocks[lo] != at_block:
                        at_block, held, ready = blocks[lo], [], None
                    if kinds[lo] == 0:
                        held.append(b.slice(lo, hi - lo))
                        continue
                    if ready is None and held:
                        ids = np.concatenate([h.column(2).to_numpy() for h in held])
                        order = np.argsort(ids, kind="stable")
                        ready = ids[order], np.concatenate([h.column(4).to_numpy() for h in held])[order], np.concatenate([vectors(h.column(5), dim) for h in held])[order]
                        held = []
                    for at in range(lo, hi if ready else lo, 256):
                        part = b.slice(at, min(256, hi - at))
                        widths = part.column(6).value_lengths().to_numpy()
                        for width in np.unique(widths[widths > 0]):
                            mine = part.filter(pa.array(widths == width))
                            low, high = (np.asarray(mine.column(j).flatten()).reshape(len(mine), width) for j in (6, 7))
                            row, band, other, score = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in first_of(ready, (mine.column(2).to_numpy(), mine.column(4).to_numpy(), vectors(mine.column(5), dim), low, high), same, k))
                            take = pa.array(row)
                            yield pa.RecordBatch.from_arrays([mine.column(2).take(take), mine.column(3).take(take), *[pa.array(v, f.type) for v, f in zip((band, other, score), list(target)[2:], strict=True)]], schema=target)

        return both.repartition(partitions(self.spark), "block").sortWithinPartitions("block", "kind").mapInArrow(run, schema)

    def _pairs(self, bounds: DataFrame) -> DataFrame:
        """(leaf, others): the candidate leaves that each anchor leaf has to meet. ``bounds``: leaf, low, high of each anchor leaf."""
        floor, ceiling = np.full(len(self.own.parent), np.inf), np.full(len(self.own.parent), -np.inf)
        for r in bounds.collect():  # ANCHOR_LEAVES rows at most
            floor[r["leaf"]], ceiling[r["leaf"]] = r["low"], r["high"]
        floor, ceiling = self.own.up(floor, np.minimum), self.own.up(ceiling, np.maximum)
        own, tree, own_size, size = self.own, self.tree, self.anchor_size, self.size
        schema = "leaf int, others array<int>"
        target = spark_arrow(self.spark, schema)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for root in b.column(0).to_pylist():
                    a, c = walk(root, own, own_size, tree, size, floor, ceiling)
                    leaves = np.unique(a)
                    yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int32()), pa.array([c[a == n] for n in leaves], target.field(1).type)], schema=target)

        tops = [(n,) for n in own.tops(SUBTREES) if np.isfinite(floor[n])]
        return self.spark.createDataFrame(tops, "root int").repartition(max(1, len(tops))).mapInArrow(work, schema)

    def _to_blocks(self, asked: DataFrame, leaf: str) -> DataFrame:
        blocks = F.broadcast(self.blocks.withColumnRenamed("leaf", "__leaf"))
        found = asked.join(blocks, F.col(leaf) == F.col("__leaf")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return found.withColumn("block", F.col("__leaf") * F.lit(1 << 32) + F.col("part"))

    def first(self, asked: DataFrame, same: bool, k: int, name: str) -> DataFrame:
        """id, twin, band, other, score, place: the first ``k`` candidates of each band of ``asked`` (id, twin, label, v, leaf, home, low, high)."""
        place = F.row_number().over(Window.partitionBy("id", "twin", "band").orderBy(F.desc("score"), "other"))
        cut = lambda df: df.withColumn("place", place).filter(F.col("place") <= k)
        found = cut(self._met(self._to_blocks(asked, "home"), same, k))
        if not self.parted:
            return self.scratch.save(found, name)
        found = self.scratch.save(found, f"{name}-home")
        # A full list's last score is the floor from now on; an equal score may still win by its id.
        full = found.filter(F.col("place") == k).groupBy("id", "twin").agg(F.map_from_entries(F.collect_list(F.struct("band", "score"))).alias("last"))
        raised = F.transform("low", lambda v, i: F.greatest(v, F.coalesce(F.get(F.array(F.col("last")), 0)[i], v)))
        asked = self.scratch.save(asked.join(full, ["id", "twin"], "left").withColumn("low", raised).drop("last"), f"{name}-asked")
        bounds = asked.filter(F.size("low") > 0).groupBy("leaf").agg(F.min(F.array_min("low")).alias("low"), F.max(F.array_max("high")).alias("high"))
        pairs = F.broadcast(self._pairs(bounds))  # ANCHOR_LEAVES rows of LEAVES numbers at most
        rest = asked.join(pairs, "leaf").withColumn("other_leaf", F.explode("others")).filter(F.col("other_leaf") != F.col("home")).drop("others")
        more = self._met(self._to_blocks(rest, "other_leaf"), same, k)
        return self.scratch.save(cut(found.drop("place").unionByName(more)), name)


def hundredths(c: Column) -> Column:
    """Hundredths of a whole number, rounded down, without doubles."""
    return F.call_function("div", c - F.pmod(c, F.lit(100).cast("long")), F.lit(100).cast("long"))


def mine(
    rows: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, leaf_rows: int = LEAF, block_rows: int = BLOCK
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each anchor its first ``positives`` rows of the same label, and for each of these the first ``negatives`` rows of
    another label whose score lies from ``low`` to ``high`` hundredths of the positive's. ``is_anchor`` is over (id, label).
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "negatives")
    v = F.col(vector)
    finite = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))
    taken = rows.filter(finite).select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), whole.alias("w")).filter("id IS NOT NULL AND label IS NOT NULL")
    taken = taken.filter(F.aggregate("w", F.lit(0.0), lambda a, x: a + x.cast("double") * x) < 2.0**56).select("id", "label", F.transform("w", lambda x: x.cast("int")).alias("v"))
    commonest = taken.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if commonest is None:
        return spark.createDataFrame([], result)
    dim, n = int(commonest["d"]), int(commonest["count"])
    taken = taken.filter(F.size("v") == dim)
    twin = F.row_number().over(Window.partitionBy("id").orderBy("label", "v"))
    anchors = scratch.save(taken.filter(is_anchor).distinct().withColumn("twin", twin), "asked")
    search = Search(taken, anchors, n, dim, scratch, leaf_rows, block_rows)
    whole_line = search.anchors.withColumns({"low": F.array(F.lit(-ENDLESS).cast("long")), "high": F.array(F.lit(ENDLESS).cast("long"))})
    near = search.first(whole_line, True, positives, "positives")
    bands = near.withColumns({"lo": -hundredths(F.col("score") * -low), "hi": hundredths(F.col("score") * high)}).groupBy("id", "twin").agg(F.array_sort(F.collect_list(F.struct("place", "lo", "hi"))).alias("bands"))
    asked = search.anchors.join(bands, ["id", "twin"]).withColumns({"low": F.transform("bands", lambda b: b["lo"]), "high": F.transform("bands", lambda b: b["hi"])}).drop("bands")
    far = search.first(scratch.save(asked, "banded") if search.parted else asked, False, negatives, "negatives-found")
    own = near.select(F.col("id"), "twin", (F.col("place") - 1).alias("band"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    out = far.join(own, ["id", "twin", "band"])
    return out.select(F.col("id").alias("anchor_id"), "positive_id", F.col("place").cast("int").alias("rank"), F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = rows.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return mine(rows, F.col("id") % 100 == 0)


#: Doubles hold these products exactly.
ORACLE_SQL = """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, c.id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score FROM v AS a JOIN v AS c ON a.id % 100 = 0 AND a.id <> c.id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) <= 5
"""

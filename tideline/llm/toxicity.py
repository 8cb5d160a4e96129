"""Toxicity by nearest labelled examples under exact cosine of weighted TF-IDF.

The example set is a bounded sample of labelled rows, ``SAMPLE`` per label
value, chosen by a hash of the id and thinned of near copies of the same label.
Its vocabulary is every term of the examples. A vector is (1 + ln tf) * idf *
weight, of unit length: idf is taken over all documents, and the weight is what
the square root of the term's chi-squared between the labels exceeds chance by,
plus ``FLOOR``, so terms that tell the labels apart lead and no term is left
out.

The index is inverted, with block maxima: examples are ordered so that similar
ones stand together, and ``BLOCK`` of them make a block. The list of a term that
is in ``FREQUENT`` of the blocks or more has a value for each example, and in
front of them the greatest of each block. Lists of other terms are postings. A
query adds up the postings of its rare terms, which are few, and of its frequent
terms the maxima: that bounds the cosine of every example of a block. The blocks
of the greatest bounds are read in full, then all others whose bound reaches the
last place so far. So the neighbours are exact.

They vote with weights that fall with distance, and a logistic curve fitted on
the examples' own left-one-out votes turns the vote into a probability. The
neighbours are the evidence.

Defined results: a null text counts as empty; a text without any term
of the examples gets the rate of toxic texts among examples without terms; terms
that no example holds take no part in the cosine; repeated rows get equal
scores; equal cosines go to the smaller id; an empty table gives an empty table;
without labels of both values every score is their rate, or 0 without any label;
labels with null ids or values are not learnt from, and of several labels of one
document the largest holds; further columns are ignored, whatever their names.
Texts are read whole, whatever their length.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import Scratch, map_rows, remainder, sampled, slices, spark_arrow

#: Labelled rows that serve as examples, for each label value.
SAMPLE = 2500
NEIGHBOURS = 15
#: Chi-squared that counts as chance (1 in 1000), and the weight of terms within it.
CHI, FLOOR = 10.83, 0.01
#: Jaccard similarity from which examples of one label are copies.
SIMILAR = 0.75
#: Examples of a block, and components that the examples' order is found in.
BLOCK, SKETCHED = 8, 32
#: Share of the blocks from which a term is frequent.
FREQUENT = 0.25

_find = re.compile(r"\w+").findall


def terms(text: str | None) -> list[str]:
    return _find((text or "").lower())


def _copies(token_lists: list[list[str]], labels: np.ndarray) -> np.ndarray:
    """Marks texts with a Jaccard similarity of ``SIMILAR`` to an earlier one that stays and has their label.

    Compared, over whole sets of five-word shingles, are those that share one of four min-hashes.
    """
    import xxhash

    seen: list[dict[tuple[int, int], list[int]]] = [{} for _ in range(4)]
    sets: dict[int, np.ndarray] = {}
    out = np.zeros(len(token_lists), bool)
    for i, (tokens, label) in enumerate(zip(token_lists, labels, strict=True)):
        own = np.unique(np.array([xxhash.xxh3_64_intdigest(" ".join(tokens[j : j + 5])) for j in range(max(1, len(tokens) - 4))], np.uint64))
        keys = [(int(label), int((own * np.uint64(m) + np.uint64(0x9E3779B97F4A7C15)).min())) for m in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
        for j in sorted({j for k, s in zip(keys, seen, strict=True) for j in s.get(k, ())}):
            if min(len(own), len(sets[j])) < SIMILAR * max(len(own), len(sets[j])):
                continue
            both = len(np.intersect1d(own, sets[j], assume_unique=True))
            if both >= SIMILAR * (len(own) + len(sets[j]) - both):
                out[i] = True
                break
        if not out[i]:
            sets[i] = own
            for k, s in zip(keys, seen, strict=True):
                s.setdefault(k, []).append(i)
    return out


#: What ``Index._write`` makes.
_LISTS = ("lists", "places", "values", "slots", "slot_tops", "slot_values")


@dataclass
class Index:
    """Inverted index over all terms of the examples, and the calibration of their votes."""

    rate: float = 0.0
    blank: float = 0.0
    vocabulary: dict[str, int] = field(default_factory=dict)
    idf: np.ndarray | None = None  # idf times weight
    ids: np.ndarray | None = None
    labels: np.ndarray | None = None
    weights: np.ndarray | None = None
    vectors: list[tuple[np.ndarray, np.ndarray]] | None = None  # (terms, values) in the order of places
    lists: np.ndarray | None = None  # where each rare term's postings start, and their end
    places: np.ndarray | None = None
    values: np.ndarray | None = None
    slots: np.ndarray | None = None  # each frequent term's number, or -1
    slot_tops: np.ndarray | None = None  # by frequent term and block
    slot_values: np.ndarray | None = None  # by frequent term, block and example
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def fit(cls, ids: list[int], texts: list[str | None], labels: list[int], weights: np.ndarray, known: dict[str, int] | None = None, frequency: np.ndarray | None = None, total: int = 0) -> Index:
        """``known`` and ``frequency``: the examples' terms and in how many of all ``total`` documents they are; without them the examples count."""
        y, w = np.asarray(labels), np.asarray(weights, float)
        own = cls(rate=float((y * w).sum() / w.sum()) if len(y) else 0.0)
        own.blank = own.rate
        if len(set(labels)) < 2:
            return own
        tokens = [terms(t) for t in texts]
        keep = ~_copies(tokens, y)
        ids_, y, w = np.asarray(ids)[keep], y[keep], w[keep]
        tokens = [t for t, k in zip(tokens, keep, strict=True) if k]
        own.vocabulary = known or {t: k for k, t in enumerate(sorted(set().union(*tokens)))}
        counts = [own._counted(t) for t in tokens]
        df = np.zeros((2, len(own.vocabulary)))
        for (t, _), v in zip(counts, y, strict=True):
            df[v, t] += 1
        n = np.bincount(y, minlength=2).astype(float)
        a, b, c, d = df[1], df[0], n[1] - df[1], n[0] - df[0]
        chi = n.sum() * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * n[1] * n[0], 1)
        if frequency is None:
            frequency, total = df.sum(0), len(counts)
        own.idf = (np.log((1 + total) / (1 + frequency)) + 1) * (FLOOR + np.maximum(0, np.sqrt(chi) - np.sqrt(CHI)))
        blank = np.array([not len(t) for t, _ in counts])
        if blank.any():
            own.blank = float(((y * w)[blank].sum() + own.rate) / (w[blank].sum() + 1))
        vectors = [own.vector(c) for c in counts if len(c[0])]
        own.ids, own.labels, own.weights = ids_[~blank], y[~blank], w[~blank]
        if vectors:
            order = _neighbouring(vectors, len(own.vocabulary))
            own.ids, own.labels, own.weights = own.ids[order], own.labels[order], own.weights[order]
            vectors = own.vectors = [(vectors[i][0], vectors[i][1].astype(np.float32)) for i in order]
            own._write(vectors)
            votes = own._votes(*own.nearest(vectors, NEIGHBOURS, np.arange(len(vectors))))
            own.slope, own.shift = _platt(votes, own.labels, own.weights)
        return own

    def __getstate__(self) -> dict:
        """Vectors without the lists, so that little goes over the driver; the lists are written anew."""
        state = {k: v for k, v in vars(self).items() if k not in _LISTS}
        state["vocabulary"] = "\n".join(self.vocabulary)
        if self.vectors is not None:
            state["vectors"] = tuple(np.concatenate(x) for x in ([[len(t) for t, _ in self.vectors]], [t.astype(np.int32) for t, _ in self.vectors], [v.astype(np.float32) for _, v in self.vectors]))
        return state

    def __setstate__(self, state: dict) -> None:
        state["vocabulary"] = {t: k for k, t in enumerate(state["vocabulary"].split("\n"))} if state["vocabulary"] else {}
        vars(self).update(dict.fromkeys(_LISTS) | state)
        if self.vectors is not None:
            sizes, t, v = self.vectors
            cuts = np.cumsum(sizes)[:-1]
            self.vectors = list(zip(np.split(t.astype(np.int64), cuts), np.split(v, cuts), strict=True))
            self._write(self.vectors)

    def _counted(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The vocabulary's terms among the tokens, and how often each is there."""
        own = [k for k in map(self.vocabulary.get, tokens) if k is not None]
        return np.unique(np.array(own, np.int64), return_counts=True)

    def vector(self, counted: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        t, f = counted
        v = (1 + np.log(f)) * self.idf[t]
        return t, v / (np.linalg.norm(v) or 1)

    def _write(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """The lists, from vectors in the order of places."""
        flat = np.concatenate([t for t, _ in vectors])
        order = np.argsort(flat, kind="stable")  # by term, then place
        flat = flat[order]
        places = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])[order]
        values = np.concatenate([v for _, v in vectors])[order].astype(np.float32)
        blocks, total = places // BLOCK, -(-len(vectors) // BLOCK)
        starts = np.flatnonzero(np.concatenate([[True], (flat[1:] != flat[:-1]) | (blocks[1:] != blocks[:-1])]))
        frequent = np.bincount(flat[starts], minlength=len(self.vocabulary)) >= max(1, FREQUENT * total)
        self.slots = np.where(frequent, np.cumsum(frequent) - 1, -1)
        self.slot_values = np.zeros((int(frequent.sum()), total, BLOCK), np.float32)
        own = frequent[flat]
        self.slot_values.reshape(len(self.slot_values), total * BLOCK)[self.slots[flat[own]], places[own]] = values[own]
        self.slot_tops = self.slot_values.max(2)
        self.places, self.values = places[~own], values[~own]
        self.lists = np.searchsorted(flat[~own], np.arange(len(self.vocabulary) + 1))

    def nearest(self, rows: list[tuple[np.ndarray, np.ndarray]], k: int, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(places, cosines) of the k nearest examples of each vector, exactly; ``without``: a place to leave out."""
        n = len(self.ids)
        k, blocks = min(k, n), -(-n // BLOCK)
        first = min(blocks, -(-2 * (k + 1) // BLOCK))  # blocks that are read before there is a last place to reach
        places, cosines = np.zeros((len(rows), k), np.int64), np.zeros((len(rows), k), np.float32)
        for i, (t, v) in enumerate(rows):
            slots = self.slots[t]
            own = slots >= 0
            slots, shares, t, v = slots[own], v[own].astype(np.float32), t[~own], v[~own]
            lo = self.lists[t]
            at, sizes = _ranges(lo, self.lists[t + 1] - lo)
            found = np.bincount(self.places[at], np.repeat(v, sizes) * self.values[at], blocks * BLOCK)
            found[n:] = -2
            if without is not None:
                found[without[i]] = -2
            found = found.reshape(blocks, BLOCK)
            bounds = found.max(1) + shares @ self.slot_tops[slots]

            def read(chosen: np.ndarray) -> np.ndarray:
                return found[chosen] + (shares @ self.slot_values[slots[:, None], chosen].reshape(len(slots), len(chosen) * BLOCK)).reshape(-1, BLOCK)

            begun = np.argpartition(-bounds, first - 1)[:first]
            whole = read(begun)
            last = np.partition(whole.ravel(), whole.size - k)[whole.size - k]
            bounds[begun] = -2
            more = np.flatnonzero(bounds >= last - 1e-5)
            if len(more):
                begun, whole = np.concatenate([begun, more]), np.concatenate([whole, read(more)])
                last = np.partition(whole.ravel(), whole.size - k)[whole.size - k]
            near = np.flatnonzero(whole.ravel() >= last)
            place, cosine = begun[near // BLOCK] * BLOCK + near % BLOCK, whole.ravel()[near]
            own = place < n
            place, cosine = place[own], cosine[own]
            order = np.lexsort((self.ids[place], -cosine))[:k]
            places[i, : len(order)], cosines[i, : len(order)] = place[order], cosine[order]
        return places, cosines

    def _votes(self, places: np.ndarray, cosines: np.ndarray) -> np.ndarray:
        near = np.where(cosines > 0, self.weights[places] / (1.1 - cosines), 0)
        total = near.sum(1)
        return np.where(total > 0, (near * self.labels[places]).sum(1) / np.where(total > 0, total, 1), self.blank)

    def score(self, texts: list[str | None]) -> tuple[list[float], list[list[int]], list[list[float]]]:
        """Probabilities, and the ids and cosines of the examples that speak for them."""
        p, ids, cosines = np.full(len(texts), self.blank), [[] for _ in texts], [[] for _ in texts]
        known = self.vocabulary
        if known and self.ids is not None and len(self.ids):
            counts = [self._counted(terms(t)) for t in texts]
            rows = np.array([i for i, c in enumerate(counts) if len(c[0])], int)
            if len(rows):
                places, near = self.nearest([self.vector(counts[i]) for i in rows], NEIGHBOURS)
                votes = self._votes(places, near)
                p[rows] = np.where(near[:, 0] > 0, 1 / (1 + np.exp(-(self.slope * votes + self.shift))), self.blank)
                for i, a, c in zip(rows, places, near, strict=True):
                    ids[i], cosines[i] = self.ids[a[c > 0]].tolist(), c[c > 0].tolist()
        return p.tolist(), ids, cosines


def _ranges(lo: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges [lo, lo + size) one after the other, and the sizes."""
    ends = np.cumsum(sizes)
    return np.repeat(lo - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0), sizes


def _neighbouring(vectors: list[tuple[np.ndarray, np.ndarray]], terms_: int) -> np.ndarray:
    """An order in which similar vectors stand together: sets are halved along their widest direction, down to blocks."""
    rng = np.random.default_rng(7)
    project = rng.normal(size=(terms_, SKETCHED)).astype(np.float32)
    points = np.stack([v.astype(np.float32) @ project[t] for t, v in vectors])

    def ordered(own: np.ndarray) -> np.ndarray:
        if len(own) <= BLOCK:
            return own
        x = points[own] - points[own].mean(0)
        widest = np.linalg.eigh(x.T @ x)[1][:, -1]
        own = own[np.argsort(x @ widest, kind="stable")]
        half = -(-len(own) // (2 * BLOCK)) * BLOCK
        return np.concatenate([ordered(own[:half]), ordered(own[half:])])

    return ordered(np.arange(len(vectors)))


def _platt(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton steps with a small ridge."""
    a, b = 1.0, 0.0
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(a * x + b)))
        g = design.T @ (w * (p - y)) + 0.01 * np.array([a, 0])
        h = (design * (w * p * (1 - p))[:, None]).T @ design + np.diag([0.01, 1e-6])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def lexicon_of(raw: bytes) -> dict[str, int]:
    """Numbers of the words in ``raw``, one a line; no term holds a line's end."""
    return {t: k for k, t in enumerate(raw.decode().split("\n"))} if raw else {}


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, modulus: int = 4, left_out: int = 2) -> bytes:
    """The pickled index, built in one task on an executor; its size is bounded by the texts of the sample."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    known_labels = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (remainder("doc_id", modulus) != left_out)).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("v"))
    totals = {r["v"]: r["n"] for r in known_labels.groupBy("v").agg(F.count(F.lit(1)).alias("n")).collect()}
    examples = scratch.save(sampled(docs, labels, label, sample, modulus, left_out), "examples")

    def lexicon(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted({t for b in slices(batches) for text in b.column("text").to_pylist() for t in terms(text)})
        yield pa.RecordBatch.from_arrays([pa.array(["\n".join(found).encode()], pa.binary())], names=["model"])

    found = examples.repartition(1).mapInArrow(lexicon, "model binary").first()
    if found is None:  # no labelled document
        return pickle.dumps(Index())
    known = spark.sparkContext.broadcast(bytes(found[0]))
    target = spark_arrow(spark, "term long, n long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In how many documents each term is; at the end the documents."""
        own = lexicon_of(known.value)
        n = np.zeros(len(own) + 1, np.int64)
        for b in slices(batches):
            for text in b.column("text").to_pylist():
                n[[own[t] for t in set(terms(text)) & own.keys()]] += 1
            n[-1] += len(b)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], schema=target)

    frequency = np.zeros(len(lexicon_of(bytes(found[0]))) + 1, np.int64)
    counted = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    frequency[counted.column("term").to_numpy()] = counted.column("n").to_numpy()

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted({(i, y, t or "") for b in batches for i, t, y in zip(*(b.column(n).to_pylist() for n in ("doc_id", "text", "y")), strict=True)})
        counts = Counter(y for _, y, _ in rows)
        weights = np.array([max(1.0, totals.get(y, 1) / counts[y]) for _, y, _ in rows])
        own = Index.fit([i for i, _, _ in rows], [t for _, _, t in rows], [y for _, y, _ in rows], weights, lexicon_of(known.value), frequency[:-1], int(frequency[-1]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(own)], pa.binary())], names=["model"])

    return bytes(examples.repartition(1).mapInArrow(fit, "model binary").first()[0])


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, modulus: int = 4, left_out: int = 2, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted, and the examples ``evidence`` with their cosines."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(docs, labels, sample=sample, modulus=modulus, left_out=left_out))  # bounded, see train

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        own: Index = pickle.loads(model.value)
        for b in batches:
            for at in range(0, len(b["text"]), 500):
                p, ids, near = own.score(b["text"][at : at + 500])
                yield {"doc_id": b["doc_id"][at : at + 500], "score": p, "evidence": ids, "cosines": near}

    out = map_rows(docs.select("doc_id", "text"), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, evidence array<long>, cosines array<double>", work)
    return out.select("doc_id", (remainder("doc_id", modulus) == left_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence", "cosines")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "held_out", "score", "predicted")

"""Quality classifier: a byte-level convolutional network written in numpy.

A text's bytes are embedded and cut into overlapping chunks that together cover
the whole document. Learned filters run over every chunk, each filter is
max-pooled over the chunk, and the document's vector is the mean and the
maximum over its chunks, combined by one logistic unit into a probability.

The network is fitted in one task on a bounded sample of labelled rows,
``SAMPLE`` per label value, chosen by a hash of the id; every document is
scored whole, a bounded number of chunks at a time, so memory does not grow with
the length of a text. Only the text goes into a score.

Defined results: a null text counts as empty, and the empty text has a score of
its own (that of a chunk of padding); repeated rows get equal scores; an empty
table gives an empty table; without labels of both values every score is 0.5;
a row of labels without a value, or with a null id, is not learnt from; where a
document has several labels the largest holds; a score equal to the threshold
counts as good; further columns, whatever their names, are kept by
``keep_documents`` and ignored by ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import map_rows, remainder, sampled

#: Labelled rows that the network is fitted on, for each label value.
SAMPLE = 600
EMBED, FILTERS, WIDTH, STRIDE = 8, 24, 8, 4
#: Positions of the filters in a chunk, and those that it shares with the next one.
CHUNK, OVERLAP = 128, 16
#: Chunks of one text, and positions of several, that are worked on together.
TOGETHER, POSITIONS = 800, 100_000
EPOCHS, RATE, SEED = 14, 0.01, 20


def _padded(text: str | None) -> np.ndarray:
    """Bytes with a frame of code 256, so that each byte is seen by some filter position and the empty text has one."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.int16)
    n = max(1, -(-max(0, len(raw) - WIDTH) // STRIDE) + 1)
    out = np.full((n - 1) * STRIDE + WIDTH, 256, np.int16)
    out[: len(raw)] = raw
    return out


def _windows(x: np.ndarray) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, WIDTH)[::STRIDE]


def _chunk_starts(n: int) -> np.ndarray:
    """First filter positions of the chunks that cover n positions."""
    return np.arange(0, max(1, n - OVERLAP), CHUNK - OVERLAP)


class Network:
    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.p = {
            "embed": r.normal(0, 0.5, (257, EMBED)).astype(np.float32),
            "filters": r.normal(0, (2 / (EMBED * WIDTH)) ** 0.5, (EMBED * WIDTH, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "out": r.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
            "last": np.zeros(1, np.float32),
        }

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maxima of the filters over each chunk of one text, and the positions that have them."""
        p, starts = self.p, _chunk_starts(len(windows))
        best, where = np.empty((len(starts), FILTERS), np.float32), np.empty((len(starts), FILTERS), np.int64)
        for first in range(0, len(starts), TOGETHER):
            own = starts[first : first + TOGETHER]
            act = p["embed"][windows[own[0] : own[-1] + CHUNK]].reshape(-1, WIDTH * EMBED) @ p["filters"] + p["bias"]
            for k, s in enumerate(own - own[0]):
                at = act[s : s + CHUNK].argmax(0) + s
                best[first + k], where[first + k] = np.maximum(act[at, np.arange(FILTERS)], 0), at + own[0]
        return best, where

    def score(self, texts: list[str | None]) -> list[float]:
        """Probabilities; several texts share one matrix product, and a long one is worked through in parts."""
        out, at = np.empty((len(texts), 2 * FILTERS), np.float32), 0
        while at < len(texts):
            own, held, first = [], 0, at
            while at < len(texts):
                windows = _windows(_padded(texts[at]))
                if own and held + len(windows) > POSITIONS:
                    break
                own.append(windows)
                held += len(windows)
                at += 1
            if len(own) == 1:
                out[first] = self._long(own[0])
            else:
                best, firsts = self._maxima(own)
                counts = np.diff([*firsts, len(best)])[:, None]
                out[first:at] = np.concatenate([np.add.reduceat(best, firsts, 0) / counts, np.maximum.reduceat(best, firsts, 0)], 1)
        z = out @ self.p["out"] + self.p["last"]
        return (1 / (1 + np.exp(-z.astype(np.float64)))).tolist()

    def _maxima(self, own: list[np.ndarray]) -> tuple[np.ndarray, list[int]]:
        """Maxima of the filters over the chunks of several texts, and each text's first chunk."""
        act = self.p["embed"][np.concatenate(own)].reshape(-1, WIDTH * EMBED) @ self.p["filters"]
        starts, ends, firsts = [], [], []
        base = n = 0
        for w in own:
            s = _chunk_starts(len(w)) + base
            firsts.append(n)
            n += len(s)
            starts.append(s)
            base += len(w)
            ends.append(np.minimum(s + CHUNK, base))
        pairs = np.stack([np.concatenate(starts), np.concatenate(ends)], 1).ravel()
        act = np.concatenate([act, np.zeros((1, FILTERS), act.dtype)])  # reduceat wants each end inside
        return np.maximum(np.maximum.reduceat(act, pairs, 0)[::2] + self.p["bias"], 0), firsts

    def _long(self, windows: np.ndarray) -> np.ndarray:
        starts = _chunk_starts(len(windows))
        total, top = np.zeros(FILTERS), np.zeros(FILTERS, np.float32)
        for first in range(0, len(starts), TOGETHER):
            s = starts[first : first + TOGETHER]
            best = self._maxima([windows[s[0] : s[-1] + CHUNK]])[0][: len(s)]
            total += best.sum(0)
            top = np.maximum(top, best.max(0))
        return np.concatenate([total / len(starts), top])

    def gradient(self, windows: np.ndarray, label: float, weight: float) -> dict[str, np.ndarray]:
        """Gradient of the weighted cross-entropy of one text."""
        p, grad = self.p, {k: np.zeros_like(x) for k, x in self.p.items()}
        best, where = self.pooled(windows)
        vector = np.concatenate([best.mean(0), best.max(0)])
        error = weight * (1 / (1 + np.exp(-(vector @ p["out"] + p["last"][0]))) - label)
        grad["out"] += error * vector
        grad["last"] += error
        d = np.broadcast_to(error * p["out"][:FILTERS] / len(best), best.shape).copy()
        d[best.argmax(0), np.arange(FILTERS)] += error * p["out"][FILTERS:]
        d *= best > 0
        grad["bias"] += d.sum(0)
        for first in range(0, len(best), TOGETHER):
            own, share = windows[where[first : first + TOGETHER]], d[first : first + TOGETHER]  # (chunk, filter, byte)
            seen = p["embed"][own].reshape(*share.shape, -1)
            grad["filters"] += np.einsum("cf,cfd->df", share, seen)
            back = (share[:, :, None] * p["filters"].T).reshape(-1, EMBED)
            codes = own.ravel()
            for e in range(EMBED):
                grad["embed"][:, e] += np.bincount(codes, back[:, e], len(grad["embed"]))
        return grad

    def fit(self, texts: list[str | None], labels: list[int], weights: np.ndarray, epochs: int = EPOCHS, batch: int = 16) -> None:
        """Adam on the weighted cross-entropy."""
        r, p = np.random.default_rng(SEED), self.p
        own = [_windows(_padded(t)) for t in texts]
        n = len(texts)
        m, v, t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
        for epoch in range(epochs):
            rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            order = r.permutation(n)
            for lo in range(0, n, batch):
                grad = {k: np.zeros_like(x) for k, x in p.items()}
                for i in order[lo : lo + batch]:
                    for k, g in self.gradient(own[i], float(labels[i]), weights[i] / batch).items():
                        grad[k] += g
                t += 1
                for k in p:
                    m[k] = 0.9 * m[k] + 0.1 * grad[k]
                    v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
                    p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def to_bytes(self) -> bytes:
        return b"".join(self.p[k].tobytes() for k in sorted(self.p))

    @classmethod
    def from_bytes(cls, raw: bytes | None) -> Network | None:
        if not raw:
            return None
        own, at = cls(), 0
        for k in sorted(own.p):
            x = own.p[k]
            own.p[k] = np.frombuffer(raw, np.float32, x.size, at).reshape(x.shape)
            at += x.nbytes
        return own


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, modulus: int = 3, left_out: int = 1) -> bytes:
    """The network's weights, fitted in one task on an executor; empty without labels of both values."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted({(y, i, t or "") for b in batches for i, t, y in zip(*(b.column(n).to_pylist() for n in ("doc_id", "text", "y")), strict=True)})
        counts = np.bincount([y for y, _, _ in rows], minlength=2)
        raw = b""
        if counts.all():
            own = Network()
            own.fit([t for _, _, t in rows], [y for y, _, _ in rows], np.array([len(rows) / 2 / counts[y] for y, _, _ in rows]))
            raw = own.to_bytes()
        yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], names=["model"])

    rows = sampled(docs, labels, label, sample, modulus, left_out)
    found = rows.repartition(1).mapInArrow(fit, "model binary").first()
    return b"" if found is None else bytes(found[0])  # no partition, no row


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.5, modulus: int = 3, left_out: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = train(docs, labels, label, modulus=modulus, left_out=left_out)

    def work(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        own = Network.from_bytes(model)
        for b in batches:
            yield {"doc_id": b["doc_id"], "score": [0.5] * len(b["text"]) if own is None else own.score(b["text"])}

    out = map_rows(docs.select("doc_id", "text"), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double", work)
    return out.select("doc_id", (remainder("doc_id", modulus) == left_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that the network takes for good text, with all their columns."""
    model = train(docs, labels)

    @F.arrow_udf("double")
    def probability(texts: pa.Array) -> pa.Array:
        own, out = Network.from_bytes(model), []
        for at in range(0, len(texts), 1000):  # few texts at a time become Python objects
            part = texts.slice(at, 1000).to_pylist()
            out += [0.5] * len(part) if own is None else own.score(part)
        return pa.array(out, pa.float64())

    packed = docs.select(F.struct("*").alias("__row"), F.col("text").alias("__text"))
    return packed.filter(probability("__text") >= threshold).select("__row.*")


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

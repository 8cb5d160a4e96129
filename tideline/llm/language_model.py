"""Language-model scoring with a log-bilinear network trained by noise contrast.

Tokens are the lower-cased words of a text and one end. A frequent token is
predicted from the two tokens before it: the context's embeddings, each scaled
by a learned vector of its place, add up to a predicted embedding, whose
products with the output embeddings plus biases are the logits of a softmax over
the ``SHORTLIST`` most frequent tokens and ``ENDINGS`` classes that all other
words are dealt to by their last bytes. Such a word then gets its share of its
class, (c + 1) / (n + v + 1) for its count c and the class's tokens n and words
v in training; all unseen words of a class are one. So the probabilities add up
to one over the words seen and the unseen word of each class.

The network is trained in numpy with noise-contrastive estimation on all
training documents: a start is fitted on a bounded batch of whole documents, the
first by a hash of id and text, then every task refines its own copy on all its training
documents and the copies are averaged by tokens. Scoring finds the different
contexts of a chunk and normalises them by batched matrix products.

Documents meet counts by chunks: each task cuts its texts into chunks and writes
each as one row of token numbers and the chunk's own lexicon, so texts are read
and cut into words once. Lexicons are counted in buckets of word hashes: a chunk
sends each bucket one array of its words, and gets one array of counts back, so
a word costs some bytes and no row. Words that many chunks have among their most
frequent, at most ``COMMON``, do not travel: every task adds them up, and their
counts are broadcast. No step holds the whole vocabulary, and no task a word of
every chunk. Words are told apart by 64-bit hashes where they are counted.

Defined results: a null text counts as empty, whose only token is the end;
repeated rows are separate documents; without training documents counts are
zero and the network is at its start; an empty table gives an empty table;
a null id counts as the empty text in the fold; words of equal counts enter the
shortlist by hash; a very long text is one chunk; further columns are ignored,
whatever their names. The network depends in its last digits on how rows are
dealt to tasks, counts and base do not.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import Scratch, free_shuffles, partitions, remainder, slices, spark_arrow, words

#: Frequent tokens and classes of other words in the softmax; embedding size; noise samples of a batch.
SHORTLIST, ENDINGS, DIM, NOISE = 511, 128, 16, 32
#: Positions of a training batch, positions after which the start takes no further text, learning rate.
BATCH, START, RATE, SEED = 1024, 600_000, 0.1, 3
#: Documents that the start's fit reads at most, and its passes over them.
START_DOCS, PASSES = 4000, 5
#: Bytes of text in a chunk, about, and the end token, which no word equals.
CHUNK_BYTES, END = 4_000_000, b"\n"
#: Common words at most, words that a chunk proposes for them, and words of a bucket, about.
COMMON, PROPOSED, BUCKET_WORDS = 1 << 16, 4096, 1_000_000


class LogBilinear:
    """p(w | h) is proportional to exp(q_w . sum_i c_i * r_{h_i} + b_w)."""

    def __init__(self, classes: int, places: int, dim: int, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.r = r.normal(0, 0.1, (classes, dim)).astype(np.float32)
        self.q = r.normal(0, 0.1, (classes, dim)).astype(np.float32)
        self.c = np.ones((places, dim), np.float32)
        self.b = np.zeros(classes, np.float32)
        self.squares = [np.full_like(x, 1e-2) for x in (self.r, self.q, self.c, self.b)]

    def start(self, counts: np.ndarray) -> None:
        """Sets the noise distribution, and the biases to its logarithms."""
        p = (counts + 1) / (counts + 1).sum()
        self.noise = p
        self.b[:] = np.log(p)

    def predicted(self, contexts: np.ndarray) -> np.ndarray:
        return sum(self.c[i] * self.r[contexts[:, i]] for i in range(len(self.c)))

    def train(self, contexts: np.ndarray, targets: np.ndarray, rate: float, seed: int) -> None:
        """One pass of NCE in batches; a batch shares its noise samples."""
        rng = np.random.default_rng(seed)
        log_noise = np.log(self.noise * NOISE).astype(np.float32)
        for lo in range(0, len(targets), BATCH):
            h, w = contexts[lo : lo + BATCH], targets[lo : lo + BATCH]
            drawn = rng.choice(len(self.noise), NOISE, p=self.noise)
            parts = [self.r[h[:, i]] for i in range(h.shape[1])]
            pred = sum(self.c[i] * parts[i] for i in range(h.shape[1]))
            qw, qn = self.q[w], self.q[drawn]
            up = 1 / (1 + np.exp(np.clip((pred * qw).sum(1) + self.b[w] - log_noise[w], -30, 30)))  # 1 - P(data | w)
            down = -1 / (1 + np.exp(np.clip(log_noise[drawn] - self.b[drawn] - pred @ qn.T, -30, 30)))  # -P(data | noise)
            back = up[:, None] * qw + down @ qn
            gq, gr = np.zeros_like(self.q), np.zeros_like(self.r)
            gb = np.bincount(w, up, len(self.b)).astype(np.float32)
            np.add.at(gb, drawn, down.sum(0))
            _scatter(gq, w, up[:, None] * pred)
            np.add.at(gq, drawn, down.T @ pred)
            gc = np.stack([(back * parts[i]).sum(0) for i in range(h.shape[1])])
            for i in range(h.shape[1]):
                _scatter(gr, h[:, i], back * self.c[i])
            for k, (x, g) in enumerate(((self.r, gr), (self.q, gq), (self.c, gc), (self.b, gb))):
                self.squares[k] += g * g  # Adagrad
                x += np.float32(rate) * g / np.sqrt(self.squares[k])

    def log_normalisers(self, contexts: np.ndarray) -> np.ndarray:
        out = np.empty(len(contexts), np.float32)
        for lo in range(0, len(contexts), 4096):
            z = self.predicted(contexts[lo : lo + 4096]) @ self.q.T + self.b
            top = z.max(1)
            out[lo : lo + 4096] = top + np.log(np.exp(z - top[:, None]).sum(1))
        return out

    def log10(self, contexts: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities; contexts that repeat are normalised once."""
        classes, code = len(self.b), np.zeros(len(targets), np.int64)
        for i in range(contexts.shape[1]):
            code = code * classes + contexts[:, i]
        _, first, back = np.unique(code, return_index=True, return_inverse=True)
        z = self.log_normalisers(contexts[first])
        out = np.empty(len(targets))
        for lo in range(0, len(targets), 65536):
            w = targets[lo : lo + 65536]
            out[lo : lo + 65536] = (self.predicted(contexts[lo : lo + 65536]) * self.q[w]).sum(1) + self.b[w] - z[back[lo : lo + 65536]]
        return out / np.log(10)

    def weights(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.r, self.q, self.c, self.b)])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for x in (self.r, self.q, self.c, self.b):
            x[...] = flat[at : at + x.size].reshape(x.shape)
            at += x.size


def _scatter(out: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Adds rows of values, by one sort of the row numbers."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")  # a radix sort at this width
    own = rows[order]
    starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    out[own[starts]] += np.add.reduceat(values[order], starts, 0)


class Model:
    """The network, the classes of words, and what a class's shares need."""

    def __init__(self, shortlist: list[bytes], counts: np.ndarray, class_tokens: np.ndarray, class_words: np.ndarray):
        self.index = {w: k for k, w in enumerate(shortlist)}
        self.size = len(shortlist) + ENDINGS
        self.words = LogBilinear(self.size, 2, DIM)
        self.words.start(np.concatenate([counts, class_tokens]))
        self.whole = np.concatenate([np.zeros(len(shortlist)), class_tokens + class_words + 1])

    def class_of(self, word: bytes) -> int:
        k = self.index.get(word)
        return len(self.index) + zlib.crc32(word[-3:]) % ENDINGS if k is None else k

    def contexts(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The classes before each token; before a document stand two ends."""
        end = self.class_of(END)
        out = np.empty((len(flat), 2), np.int32)
        out[1:, 0], out[2:, 1] = flat[:-1], flat[:-2]
        starts = np.cumsum(sizes) - sizes
        out[starts] = end
        second = starts[sizes > 1] + 1
        out[second, 1] = end
        return out

    def share(self, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 of each word's share of its class; a frequent token is its class alone."""
        whole = self.whole[classes]
        return np.where(whole > 0, np.log10((counts + 1) / np.maximum(whole, 1)), 0.0)


def _tokens(text: str | None) -> list[bytes]:
    return [*words(text), END]


def _chunks(docs: DataFrame, modulus: int, left_out: int, chunk_bytes: int) -> DataFrame:
    """One row per chunk: its documents' ids, folds and token counts, their tokens as numbers, and the lexicon of those numbers."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"chunk long, doc_ids array<{kind}>, held array<boolean>, sizes array<int>, tokens binary, n_words long, words binary, counts binary"
    target = spark_arrow(docs.sparkSession, schema)
    rows = docs.select("doc_id", "text", (remainder("doc_id", modulus) == left_out).alias("held"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, size = TaskContext.get().partitionId() << 32, 0
        ids, folds, sizes, parts, lexicon = [], [], [], [], _Lexicon()

        def row() -> pa.RecordBatch:
            flat = np.concatenate(parts)
            train = np.repeat(~np.array(folds, bool), sizes)
            counts = np.bincount(flat[train], minlength=len(lexicon)).astype("<i8")
            values = [[chunk], [ids], [folds], [sizes], [flat.astype("<u4").tobytes()], [len(lexicon)], [b" ".join(lexicon)], [counts.tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, target, strict=True)], schema=target)

        for b in slices(batches):
            for doc, text, held in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "held")), strict=True):
                tokens = _tokens(text)
                own = np.fromiter(map(lexicon.__getitem__, tokens), np.uint32, len(tokens))
                ids.append(doc)
                folds.append(held)
                sizes.append(len(own))
                parts.append(own)
                size += len(text or "") + 1
                if size > chunk_bytes:
                    yield row()
                    chunk, size = chunk + 1, 0
                    ids, folds, sizes, parts, lexicon = [], [], [], [], _Lexicon()
        if ids:
            yield row()

    return rows.mapInArrow(work, schema)


class _Lexicon(dict):
    """Numbers words in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _words(raw: bytes) -> list[bytes]:
    """A lexicon's words; no word holds a space, and the end token is one of them."""
    return raw.split(b" ")


def _hashes(own: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))


def _endings(own: list[bytes]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w[-3:]) % ENDINGS for w in own), np.uint8, len(own))


class _Common:
    """Sorted hashes of the common words."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)

    def places(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, or -1."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)


def _common(chunks: DataFrame) -> _Common:
    """Words that most chunks have among their ``PROPOSED`` most frequent. The choice moves work, never a result."""

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw, counts in zip(*(b.column(c).to_pylist() for c in ("words", "counts")), strict=True):
                own, n = _words(raw), np.frombuffer(counts, "<i8")
                top = np.argpartition(-n, PROPOSED)[:PROPOSED] if len(n) > PROPOSED else np.arange(len(n))
                yield pa.RecordBatch.from_arrays([pa.array(_hashes([own[k] for k in top]).view(np.int64))], names=["hash"])

    rows = chunks.select("words", "counts").mapInArrow(propose, "hash long").groupBy("hash").count().orderBy(F.desc("count"), "hash").limit(COMMON)
    return _Common(rows.select("hash").toArrow().column("hash").to_numpy().view(np.uint64))  # half a megabyte at most


def _common_counts(chunks: DataFrame, common) -> tuple[np.ndarray, np.ndarray]:  # type: ignore[no-untyped-def]
    """Corpus counts of the common words and their endings, in their order, added up by slices."""
    schema, slices_ = "slice int, counts binary, endings binary", 64

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: _Common = common.value
        total, endings = np.zeros(len(own.hashes), np.int64), np.zeros(len(own.hashes), np.uint8)
        for b in batches:
            for raw, counts in zip(*(b.column(c).to_pylist() for c in ("words", "counts")), strict=True):
                w = _words(raw)
                at = own.places(_hashes(w))
                there = at >= 0
                total[at[there]] += np.frombuffer(counts, "<i8")[there]
                endings[at[there]] = _endings([x for x, k in zip(w, there.tolist(), strict=True) if k])
        yield packed(range(slices_), np.array_split(total, slices_), np.array_split(endings, slices_))

    def packed(k, total, endings) -> pa.RecordBatch:  # type: ignore[no-untyped-def]
        return pa.RecordBatch.from_arrays([pa.array(list(k), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in total], pa.binary()), pa.array([x.tobytes() for x in endings], pa.binary())], names=["slice", "counts", "endings"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for k, raw, e in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x, e = np.frombuffer(raw, "<i8"), np.frombuffer(e, np.uint8)
                sums[k] = [sums[k][0] + x, np.maximum(sums[k][1], e)] if k in sums else [x, e]
        yield packed(sums, [x for x, _ in sums.values()], [e for _, e in sums.values()])

    rows = chunks.select("words", "counts").mapInArrow(local, schema).repartition(slices_ // 4, "slice").mapInArrow(add, schema).collect()
    rows.sort(key=lambda r: r["slice"])
    empty = [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
    return np.concatenate([np.frombuffer(r["counts"], "<i8") for r in rows] or empty[0]), np.concatenate([np.frombuffer(r["endings"], np.uint8) for r in rows] or empty[1])


def _bucketed(chunks: DataFrame, common, buckets: int) -> DataFrame:  # type: ignore[no-untyped-def]
    """One row per chunk and bucket: hashes, endings and counts of the chunk's words that are not common."""
    schema = "bucket int, chunk long, hashes binary, endings binary, counts binary"
    target = spark_arrow(chunks.sparkSession, schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, raw, counts in zip(*(b.column(c).to_pylist() for c in ("chunk", "words", "counts")), strict=True):
                own = _words(raw)
                h = _hashes(own)
                order, bucket, cuts = _order(h, common.value, buckets)
                if len(order):
                    sides = [np.split(x[order], cuts) for x in (h, _endings(own), np.frombuffer(counts, "<i8").astype("<u4"))]  # a chunk has less than 2^32 tokens
                    values = [bucket, [chunk] * len(bucket), *([x.tobytes() for x in side] for side in sides)]
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, target, strict=True)], schema=target)

    return chunks.select("chunk", "words", "counts").mapInArrow(work, schema)


def _order(h: np.ndarray, common: _Common, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the words that are not common, by bucket; the buckets that have some; where each but the first starts."""
    rest = np.flatnonzero(common.places(h) < 0)
    own = ((h[rest] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(own, kind="stable")
    own = own[order]
    cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
    return rest[order], own[np.concatenate([[0], cuts])] if len(own) else own, cuts


def _summed(rows: DataFrame) -> DataFrame:
    """For each chunk and bucket the corpus counts ``c`` of its words; for each bucket one row of sums without a chunk."""
    schema = "bucket int, chunk long, c binary, tokens long, words long, class_tokens binary, class_words binary, top_hashes binary, top_counts binary"
    target = spark_arrow(rows.sparkSession, schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> pa.RecordBatch:
            h, e, n = (np.concatenate([np.frombuffer(r[k], kind) for r in held]) for k, kind in ((1, np.uint64), (2, np.uint8), (3, "<u4")))
            different, first, back = np.unique(h, return_index=True, return_inverse=True)
            c = np.bincount(back, n, len(different)).astype(np.int64)  # exact below 2^53
            whole, ends, seen = c[back].astype("<i8"), np.cumsum([len(r[1]) // 8 for r in held]), c > 0
            top = np.lexsort((different.view(np.int64), -c))[:SHORTLIST]
            sums = [int(c.sum()), int(seen.sum()), np.bincount(e[first], c, ENDINGS).tobytes(), np.bincount(e[first], seen, ENDINGS).tobytes(), different[top].tobytes(), c[top].tobytes()]
            parts = [_narrow(x) for x in np.split(whole, ends[:-1])]
            m = len(held)
            values = [[now] * (m + 1), [r[0] for r in held] + [None], parts + [None], *([None] * m + [x] for x in sums)]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, target, strict=True)], schema=target)

        for b in batches:
            for bucket, *row in zip(*(b.column(c).to_pylist() for c in ("bucket", "chunk", "hashes", "endings", "counts")), strict=True):
                if bucket != now and held:
                    yield close()
                    held = []
                now = bucket
                held.append(row)
        if held:
            yield close()

    return rows.repartition("bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(work, schema)


def _narrow(c: np.ndarray) -> bytes:
    """Counts in as few bytes each as the greatest takes, which the first byte tells."""
    width = 2 if not len(c) or c.max() < 1 << 16 else 4 if c.max() < 1 << 32 else 8
    return bytes([width]) + c.astype(f"<u{width}").tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def _spelled(chunks: DataFrame, hashes: list[int]) -> dict[int, bytes]:
    """The words of a bounded number of hashes."""
    wanted = set(hashes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {}
        for b in batches:
            for raw in b.column("words").to_pylist():
                for w in _words(raw):
                    h = int(np.uint64(xxhash.xxh3_64_intdigest(w)).view(np.int64))
                    if h in wanted and h not in found:
                        found[h] = w
                if len(found) == len(wanted):
                    break
            if len(found) == len(wanted):
                break
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], names=["hash", "word"])

    rows = chunks.select("words").mapInArrow(work, "hash long, word binary").groupBy("hash").agg(F.min("word").alias("word")).collect()  # len(hashes) rows at most
    return {r["hash"]: bytes(r["word"]) for r in rows}


def _chunk_counts(summed: DataFrame) -> DataFrame:
    """chunk, parts: the counts of each chunk's words that are not common, in the order of buckets."""
    rows = summed.filter("chunk IS NOT NULL").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("bucket", "c"))).alias("own"))  # the words of one chunk
    return rows.select("chunk", F.col("own.c").alias("parts"))


def _fit(model: Model, batches: Iterator[pa.RecordBatch]) -> int:
    """Trains on the training documents of chunks; returns the positions seen."""
    seen, k = 0, 0
    for b in batches:
        for held, sizes, tokens, words_ in zip(*(b.column(c).to_pylist() for c in ("held", "sizes", "tokens", "words")), strict=True):
            own = _words(words_)
            classes = np.fromiter(map(model.class_of, own), np.int32, len(own))
            keep = ~np.array(held, bool)
            sizes = np.array(sizes)
            flat = classes[np.frombuffer(tokens, "<u4")[np.repeat(keep, sizes)]]
            if len(flat):
                h = model.contexts(flat, sizes[keep])
                order = np.random.default_rng([SEED, k]).permutation(len(flat))
                model.words.train(h[order], flat[order], RATE, SEED + k)
                seen, k = seen + len(order), k + 1
    return seen


def _start(docs: DataFrame, n_docs: int, modulus: int, left_out: int) -> DataFrame:
    """Texts of at most ``START_DOCS`` training documents, the first by a hash of id and text.

    Only hashes in a share of about twice that number are sorted, so little meets in one task.
    """
    rows = docs.select("text", F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(SEED)).alias("h"), (remainder("doc_id", modulus) != left_out).alias("train")).filter("train")
    if n_docs > 2 * START_DOCS:
        rows = rows.filter(F.col("h") < -(1 << 63) + (1 << 64) * 2 * START_DOCS // n_docs)
    return rows.orderBy("h").limit(START_DOCS).select("h", "text")


def train(docs: DataFrame, chunks: DataFrame, model: Model, n_docs: int, modulus: int, left_out: int) -> Model:
    """Fits the start on a bounded batch, then averages what every task makes of it on all its training documents."""
    spark = chunks.sparkSession
    rows = chunks.select("held", "sizes", "tokens", "words")
    raw = pickle.dumps(model)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = pickle.loads(raw)
        sizes, classes, seen, known = [], [], 0, {}
        for b in slices(batches):
            for text in b.column("text").to_pylist():
                if seen < START:  # texts are taken whole
                    tokens = _tokens(text)
                    for t in tokens:
                        if t not in known:
                            known[t] = own.class_of(t)
                    classes += [known[t] for t in tokens]
                    sizes.append(len(tokens))
                    seen += len(tokens)
        if seen:
            flat = np.array(classes, np.int32)
            h = own.contexts(flat, np.array(sizes))
            order = np.random.default_rng(SEED).permutation(len(flat))
            for p in range(PASSES):
                own.words.train(h[order], flat[order], RATE, SEED + p)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(own)], pa.binary())], names=["model"])

    found = _start(docs, n_docs, modulus, left_out).coalesce(1).sortWithinPartitions("h").mapInArrow(begin, "model binary").first()
    started = spark.sparkContext.broadcast(raw if found is None else bytes(found[0]))  # under a megabyte, whatever the input's size

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = pickle.loads(started.value)
        n = _fit(own, batches)
        if n:
            flat = own.words.weights().astype(np.float64) * n
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([flat.astype(np.float32).tobytes()], pa.binary())], names=["n", "flat"])

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for b in batches:
            for m, flat in zip(b.column("n").to_pylist(), b.column("flat").to_pylist(), strict=True):
                x = np.frombuffer(flat, np.float32).astype(np.float64)
                n, total = n + m, x if total is None else total + x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["n", "flat"])

    shape = "n long, flat binary"
    parts = rows.mapInArrow(refine, shape)
    for width in (8, 1):  # copies are added in two steps
        parts = parts.repartition(width).mapInArrow(average, shape)
    found = parts.first()
    out: Model = pickle.loads(started.value)
    if found is not None:
        out.words.load(np.frombuffer(bytes(found["flat"]), np.float32) / found["n"])
    return out


def _tops(sums: DataFrame) -> list:
    """The sums by class, and the most frequent words, of all buckets, in one row; nothing where there is no bucket."""
    schema = "class_tokens binary, class_words binary, top_hashes binary, top_counts binary"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, words_, hashes, counts = np.zeros(ENDINGS), np.zeros(ENDINGS), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in batches:
            for t, w, h, c in zip(*(b.column(x).to_pylist() for x in ("class_tokens", "class_words", "top_hashes", "top_counts")), strict=True):
                tokens, words_ = tokens + np.frombuffer(t, "<f8"), words_ + np.frombuffer(w, "<f8")
                hashes, counts = np.concatenate([hashes, np.frombuffer(h, np.uint64)]), np.concatenate([counts, np.frombuffer(c, "<i8")])
                top = np.lexsort((hashes.view(np.int64), -counts))[:SHORTLIST]
                hashes, counts = hashes[top], counts[top]
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (tokens, words_, hashes, counts)], names=["class_tokens", "class_words", "top_hashes", "top_counts"])

    rows = sums.select("class_tokens", "class_words", "top_hashes", "top_counts").mapInArrow(add, schema)
    return rows.coalesce(1).mapInArrow(add, schema).collect()  # one row


def score(docs: DataFrame, modulus: int = 7, left_out: int = 2, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "language-model")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    chunks = scratch.save(_chunks(docs, modulus, left_out, chunk_bytes), "chunks")
    n_words, n_docs = chunks.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum(F.size("sizes")), F.lit(0))).first()
    common = spark.sparkContext.broadcast(_common(chunks))
    common_counts, common_endings = _common_counts(chunks, common)
    buckets = max(partitions(spark), -(-n_words // BUCKET_WORDS))
    summed = scratch.save(_summed(_bucketed(chunks, common, buckets)), "summed")
    free_shuffles(spark)
    sums = summed.filter("chunk IS NULL")
    total, distinct = (int(x) for x in sums.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first())
    total, distinct = total + int(common_counts.sum()), distinct + int((common_counts > 0).sum())
    class_tokens, class_words = (np.bincount(common_endings, x, ENDINGS).astype(float) for x in (common_counts, common_counts > 0))
    pairs = _tops(sums)
    for r in pairs:
        class_tokens += np.frombuffer(r["class_tokens"], "<f8")
        class_words += np.frombuffer(r["class_words"], "<f8")
    hashes = np.concatenate([common.value.hashes, *(np.frombuffer(r["top_hashes"], np.uint64) for r in pairs)])
    counts = np.concatenate([common_counts, *(np.frombuffer(r["top_counts"], "<i8") for r in pairs)])
    top = [k for k in np.lexsort((hashes.view(np.int64), -counts))[:SHORTLIST] if counts[k] > 0]
    spelled = _spelled(chunks, [int(hashes[k].view(np.int64)) for k in top])
    short = [spelled[int(hashes[k].view(np.int64))] for k in top]
    for w, k in zip(short, top, strict=True):
        ending = zlib.crc32(w[-3:]) % ENDINGS
        class_tokens[ending] -= counts[k]
        class_words[ending] -= 1
    model = Model(short, counts[top].astype(float), class_tokens, class_words)
    shared = spark.sparkContext.broadcast(pickle.dumps(train(docs, chunks, model, n_docs, modulus, left_out)))  # under a megabyte, whatever the input's size
    known = spark.sparkContext.broadcast(common_counts)  # half a megabyte at most
    free_shuffles(spark)
    target = spark_arrow(spark, schema)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = pickle.loads(shared.value)
        for b in batches:
            for ids, held, sizes, tokens, lexicon, parts in zip(*(b.column(x).to_pylist() for x in ("doc_ids", "held", "sizes", "tokens", "words", "parts")), strict=True):
                flat, sizes, lex = np.frombuffer(tokens, "<u4"), np.array(sizes), _words(lexicon)
                h = _hashes(lex)
                at, seen = common.value.places(h), np.zeros(len(lex), np.int64)
                seen[at >= 0] = known.value[at[at >= 0]]
                if parts:
                    seen[_order(h, common.value, buckets)[0]] = np.concatenate([_wide(x) for x in parts])
                classes = np.fromiter(map(own.class_of, lex), np.int32, len(lex))
                base = np.log10((seen + 1) / (total + distinct + 1))
                share = own.share(classes, seen)
                w = classes[flat]
                p = own.words.log10(own.contexts(w, sizes), w) + share[flat]
                starts = np.cumsum(sizes) - sizes
                out = [ids, held, sizes, np.add.reduceat((seen > 0)[flat].astype(np.int64), starts), [total] * len(ids), np.add.reduceat(base[flat], starts), np.add.reduceat(p, starts)]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, target, strict=True)], schema=target)

    rows = chunks.select("chunk", "doc_ids", "held", "sizes", "tokens", "words").join(_chunk_counts(summed), "chunk", "left")
    return rows.drop("chunk").mapInArrow(rate, schema)


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks that cover all of it.  Each byte is a learned
embedding plus one flag, whether the eight bytes from it on stand again at a short
distance.  Learned filters run over the chunks; each filter's activation is max-pooled
in a chunk, and the chunk vectors are combined by their maximum and mean into one
probability.  Because of the max-pooling a gradient reaches one position per filter and
chunk, which keeps training cheap.

The network is trained on a bounded sample of labelled documents, at most ``TRAIN_DOCS``
and at most ``TRAIN_BYTES`` of whole chunks, which are cut in tasks.  Training and
scores use every chunk of a text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import table
from barloom.llm.words import ragged_ranges, row_slices, text_buffer

CHUNK, OVERLAP = 512, 64
EMBED, WIDTH, STRIDE, FILTERS = 7, 8, 2, 24
LAGS = range(2, 24)
TRAIN_DOCS, TRAIN_BYTES = 3000, 64 << 20
EPOCHS, BATCH, RATE = 12, 64, 0.01
CHUNKS_AT_ONCE = 512


def chunk_starts(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each chunk begins, and its document; an empty text has one chunk."""
    step = CHUNK - OVERLAP
    count = np.maximum(1, -(-(np.diff(at) - OVERLAP) // step))
    doc = np.repeat(np.arange(len(count)), count)
    return at[doc] + ragged_ranges(np.zeros(len(count), np.int64), count) * step, doc


def cut_chunks(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Rows of CHUNK bytes from each beginning on; zeros stand behind the end of the text."""
    padded = np.append(data, np.zeros(CHUNK, np.uint8))
    out = np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[begin].copy()
    short = np.flatnonzero(end - begin < CHUNK)
    out[short] *= np.arange(CHUNK) < (end - begin)[short, None]
    return out


def repeat_flags(chunks: np.ndarray) -> np.ndarray:
    """1 where the next eight bytes stand again within a few bytes."""
    rows, n = chunks.shape
    padded = np.zeros((rows, n + 8), dtype=np.uint8)
    padded[:, :n] = chunks
    grams = np.lib.stride_tricks.as_strided(padded, (rows, n, 8), (n + 8, 1, 1)).copy().view(np.uint64)[:, :, 0]
    out = np.zeros((rows, n), dtype=bool)
    for lag in LAGS:
        out[:, :-lag] |= grams[:, lag:] == grams[:, :-lag]
    out &= chunks != 0
    return out


@dataclass
class Network:
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # (WIDTH * (EMBED + 1)) x FILTERS
    bias: np.ndarray
    out: np.ndarray  # 2 * FILTERS
    prior: np.ndarray  # one value

    @classmethod
    def fresh(cls, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        size = WIDTH * (EMBED + 1)
        f = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
        return cls(f(256, EMBED, scale=0.5), f(size, FILTERS, scale=size**-0.5), np.zeros(FILTERS, np.float32), f(2 * FILTERS, scale=0.1), np.zeros(1, np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out, self.prior]

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        """All filter positions of the chunks, as a view: chunks x positions x inputs."""
        rows, channels = len(chunks), EMBED + 1
        x = np.empty((rows, CHUNK, channels), dtype=np.float32)
        x[:, :, :EMBED] = self.embed[chunks]
        x[:, :, EMBED] = repeat_flags(chunks)
        a, b, c = x.strides
        return np.lib.stride_tricks.as_strided(x, (rows, (CHUNK - WIDTH) // STRIDE + 1, WIDTH * channels), (a, STRIDE * b, c))

    def pooled(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest activation of each filter in each chunk, and where it is."""
        values, places = [], []
        for k in range(0, len(chunks), CHUNKS_AT_ONCE):
            act = self.windows(chunks[k : k + CHUNKS_AT_ONCE]) @ self.filters
            best = act.argmax(axis=1)
            places.append(best)
            values.append(np.take_along_axis(act, best[:, None, :], axis=1)[:, 0, :])
        return np.maximum(np.concatenate(values) + self.bias, 0), np.concatenate(places)

    def combine(self, pooled: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        count = np.diff(np.append(first, len(doc)))[:, None]
        features = np.concatenate([np.maximum.reduceat(pooled, first), np.add.reduceat(pooled, first) / count], axis=1)
        return features, _sigmoid(features @ self.out + self.prior[0])

    def score(self, texts: pa.Array) -> np.ndarray:
        data, at = text_buffer(texts)
        begin, doc = chunk_starts(at)
        parts = range(0, len(begin), CHUNKS_AT_ONCE)  # so that a very long text costs no more memory than others
        pooled = [self.pooled(cut_chunks(data, begin[k : k + CHUNKS_AT_ONCE], at[doc[k : k + CHUNKS_AT_ONCE] + 1]))[0] for k in parts]
        return self.combine(np.concatenate(pooled), doc)[1].astype(np.float64)

    def gradients(self, chunks: np.ndarray, doc: np.ndarray, label: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        pooled, places = self.pooled(chunks)
        features, p = self.combine(pooled, doc)
        d_logit = ((p - label) * weight / weight.sum()).astype(np.float32)
        d_feat = d_logit[:, None] * self.out
        owner = np.cumsum(np.append(0, doc[1:] != doc[:-1]))
        count = np.bincount(owner)[owner][:, None]
        is_max = pooled == features[owner, :FILTERS]
        d_pool = (d_feat[owner, :FILTERS] * is_max + d_feat[owner, FILTERS:] / count) * (pooled > 0)
        row, unit = np.nonzero(d_pool)
        g = d_pool[row, unit].astype(np.float32)
        at = places[row, unit] * STRIDE
        index = at[:, None] + np.arange(WIDTH)
        bytes_ = chunks[row[:, None], index]
        x = np.concatenate([self.embed[bytes_], repeat_flags(chunks)[row[:, None], index][:, :, None].astype(np.float32)], axis=2).reshape(len(row), -1)
        d_filters, d_embed = np.zeros_like(self.filters), np.zeros_like(self.embed)
        np.add.at(d_filters.T, unit, g[:, None] * x)
        back = (g[:, None] * self.filters.T[unit]).reshape(len(row), WIDTH, EMBED + 1)[:, :, :EMBED]
        np.add.at(d_embed, bytes_.ravel(), back.reshape(-1, EMBED))
        return [d_embed, d_filters, np.bincount(unit, g, FILTERS).astype(np.float32), features.T @ d_logit, np.array([d_logit.sum()], np.float32)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(cut: list[np.ndarray], labels: list[int], seed: int = 5) -> Network:
    """Adam on class-balanced log loss over documents' chunks; without rows of both labels, the share of ones."""
    net, label = Network.fresh(), np.array(labels, dtype=np.float32)
    if not len(label) or label.min() == label.max():
        net.out[:] = 0
        net.prior[:] = 0 if not len(label) else (3 if label[0] else -3)
        return net
    rng = np.random.default_rng(seed)
    share = label.mean()
    weights = np.where(label == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    first, second = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()]
    step, steps = 0, EPOCHS * -(-len(label) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(label))
        for k in range(0, len(order), BATCH):
            some = order[k : k + BATCH]
            doc = np.repeat(np.arange(len(some)), [len(cut[i]) for i in some])
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for part, g, m, v in zip(net.parts(), net.gradients(np.concatenate([cut[i] for i in some]), doc, label[some], weights[some]), first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                part -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def _score(model):
    def run(batches):
        net = model.value
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in row_slices(texts, 1 << 18):
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(net.score(texts.slice(a, b - a)))], names=["doc_id", "score"])

    return run


def _chunked(batches):
    """Labelled rows to the chunks of each text, as bytes."""
    for batch in batches:
        texts = batch.column("text")
        for a, b in row_slices(texts, 1 << 22):
            data, at = text_buffer(texts.slice(a, b - a))
            begin, doc = chunk_starts(at)
            chunks = cut_chunks(data, begin, at[doc + 1])
            first = np.searchsorted(doc, np.arange(b - a + 1))
            part = batch.slice(a, b - a)
            rows = pa.array([chunks[x:y].tobytes() for x, y in zip(first, first[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("place"), part.column("label"), rows], names=["place", "label", "chunks"])


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES) -> DataFrame:
    """place, label and chunks of labelled documents that are not held out.

    Texts are taken in the order of a hash of the text (place), at most ``most``, copies
    with one label once.  One that does not fit into what is left of ``most_bytes`` is
    passed over, and later ones are still taken.  Sizes decide before any text is moved.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).orderBy(F.xxhash64("doc_id"), "label").limit(2 * most)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(known), "doc_id")  # 2 * `most` rows of two numbers
    rows = rows.select(F.xxhash64("text").alias("place"), "label", "text")
    sizes = rows.groupBy("place", "label").agg(F.max(F.octet_length("text")).alias("size")).orderBy("place", "label").limit(most).collect()  # three numbers each
    taken, left = [], most_bytes
    for r in sizes:
        if r["size"] + CHUNK <= left:
            taken.append((r["place"], r["label"]))
            left -= r["size"] + CHUNK
    chosen = docs.sparkSession.createDataFrame(taken, "place long, label int")
    texts = rows.join(F.broadcast(chosen), ["place", "label"]).groupBy("place", "label").agg(F.min("text").alias("text"))
    return texts.mapInArrow(_chunked, "place long, label int, chunks binary")


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    held_out is crc32(doc_id as text) mod 5 = 0; the network never sees labels of such
    rows.  Its only input is the text.  Null and empty texts score as a chunk of zeros,
    very long ones by all their chunks, some at a time.  Rows that repeat get the same score.  Without labels of both kinds every text gets
    one score.  A null doc_id counts as not held out.  Other columns are ignored.
    """
    rows = sorted(training_rows(docs, labels, label).collect(), key=lambda r: (r["place"], r["label"]))  # TRAIN_BYTES at most
    cut = [np.frombuffer(r["chunks"], np.uint8).reshape(-1, CHUNK) for r in rows]
    model = docs.sparkSession.sparkContext.broadcast(train(cut, [r["label"] for r in rows]))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_score(model), "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def op9_quality_cnn(spark, sf_dir: str) -> DataFrame:
    """Quality of whole ``documents``, learned from ``labels.quality``."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

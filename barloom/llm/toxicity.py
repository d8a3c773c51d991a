"""Toxicity by a chain of linear classifiers.

A document is the set of hashed words and word beginnings it has.  Of these, the ones
that occur far more often in labelled documents of a category are the features.  The
chain predicts one category after the other; each model also gets the probabilities of
all earlier categories.  In training these are out-of-fold predictions, so a later model
sees earlier ones as wrong as they will be on new documents.

Folds are dealt by the text, so copies share one, and the features of a fold's model are
chosen without the fold.  Categories are label columns; the registered query has the two
that are labelled, poor (quality 0) and then toxic.

At most ``TRAIN_DOCS`` labelled documents are used to learn; every document is scored,
on its whole text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import release, saved, spread, table
from barloom.llm.words import ALNUM, U64, byte_hashes, ragged_ranges, row_slices, signed, split_words

TRAIN_DOCS = 20_000
#: Features kept for each category, the least documents of it each must be in, and how many times likelier there.
FEATURES, LEAST_DOCS, LEAST_LIFT = 384, 3, 8.0
#: Bytes of a word's beginning that are features of their own, besides the word.
BEGINNINGS = (4, 5, 6, 7)
FOLDS, STEPS, RIDGE = 5, 150, 1e-3


def text_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature hashes of each text, end to end, and the text of each."""
    words = split_words(texts, ALNUM, lower=True)
    doc = words.doc
    hashes, docs = [words.hash], [doc]
    for n in BEGINNINGS:
        long = words.end - words.start > n
        hashes.append(byte_hashes(words.data, words.start[long], words.start[long] + n) ^ spread(n))
        docs.append(doc[long])
    return np.concatenate(hashes), np.concatenate(docs)


def _distinct(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((hashes, docs))
    hashes, docs = hashes[order], docs[order]
    new = np.ones(len(docs), dtype=bool)
    new[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], docs[new]


def _tally(categories: int):
    """Feature hash and fold to the documents of a part of the training rows, all and by category."""

    def run(batches):
        for batch in batches:
            texts, fold = batch.column("text"), batch.column("fold").to_numpy()
            labels = [batch.column(f"y{k}").to_numpy(zero_copy_only=False) for k in range(categories)]
            for a, b in row_slices(texts, 1 << 22):
                hashes, docs = _distinct(*text_features(texts.slice(a, b - a)))
                for f in np.unique(fold[a:b]):
                    inside = fold[a:b][docs] == f
                    uniq, code = np.unique(hashes[inside], return_inverse=True)
                    counts = [np.bincount(code, minlength=len(uniq))] + [np.bincount(code, y[a:b][docs[inside]], len(uniq)) for y in labels]
                    yield pa.RecordBatch.from_arrays([pa.array(signed(uniq)), pa.array(np.full(len(uniq), f, np.int32)), *[pa.array(c.astype(np.int64)) for c in counts]], names=["f", "fold", "n", *[f"b{k}" for k in range(categories)]])

    return run


def _present(features: np.ndarray, texts: pa.Array) -> np.ndarray:
    """Matrix of 0 and 1: texts by features (sorted hashes)."""
    hashes, docs = text_features(texts)
    at = np.minimum(np.searchsorted(features, hashes), len(features) - 1)
    hit = features[at] == hashes
    out = np.zeros((len(texts), len(features)), dtype=np.float32)
    out[docs[hit], at[hit]] = 1
    return out


def _vectors(features: np.ndarray, names: list[str]):
    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            for a, b in row_slices(texts, 1 << 22):
                part = batch.slice(a, b - a)
                rows = [np.flatnonzero(x).astype(np.int32) for x in _present(features, texts.slice(a, b - a))]
                yield part.select(names).append_column("at", pa.array(rows, pa.list_(pa.int32())))

    return run


@dataclass
class Sparse:
    """A matrix by row: which of its first ``width`` columns are one (``col``, row k from at[k] to at[k + 1]), and dense columns ``more`` behind them.

    Rows have few features of all, so the driver holds and multiplies only these.
    """

    at: np.ndarray
    col: np.ndarray
    width: int
    more: np.ndarray

    def __post_init__(self):
        self.row = np.repeat(np.arange(len(self)), np.diff(self.at))

    def __len__(self) -> int:
        return len(self.at) - 1

    @classmethod
    def of(cls, lists: list, width: int) -> Sparse:
        """From the columns that are one in each row."""
        col = np.concatenate([np.zeros(0, np.int32), *[np.asarray(x, np.int32) for x in lists]])
        return cls(np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64), col, width, np.zeros((len(lists), 0), np.float32))

    def take(self, rows: np.ndarray) -> Sparse:
        sizes = np.diff(self.at)[rows]
        return Sparse(np.concatenate([[0], np.cumsum(sizes)]), self.col[ragged_ranges(self.at[:-1][rows], sizes)], self.width, self.more[rows])

    def only(self, columns: np.ndarray) -> Sparse:
        """With those of the first columns that are true in ``columns``."""
        keep = columns[self.col]
        at = np.concatenate([[0], np.cumsum(np.bincount(self.row[keep], minlength=len(self)))])
        return Sparse(at, (np.cumsum(columns) - 1)[self.col[keep]], int(columns.sum()), self.more)

    def beside(self, column: np.ndarray) -> Sparse:
        return Sparse(self.at, self.col, self.width, np.concatenate([self.more, column.astype(np.float32)[:, None]], axis=1))

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], len(self)) + self.more @ w[self.width :]

    def transposed_times(self, g: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.col, g[self.row], self.width), self.more.T @ g])

    def squares(self) -> np.ndarray:
        """The squared length of each row."""
        return np.diff(self.at) + (self.more * self.more).sum(axis=1)


def fit_linear(x: Sparse, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted ridge logistic regression by accelerated gradient steps; the last weight is the intercept."""
    x = x.beside(np.ones(len(x)))
    w = ahead = np.zeros(x.width + x.more.shape[1], dtype=np.float32)
    if not len(y) or y.min() == y.max():
        w[-1] = 0 if not len(y) else (6 if y[0] else -6)
        return w
    weight = (weight / weight.sum()).astype(np.float32)
    y = y.astype(np.float32)
    rate = np.float32(4 / max(1e-9, float(weight @ x.squares()) + RIDGE))
    for k in range(STEPS):
        grad = x.transposed_times((_sigmoid(x @ ahead) - y) * weight).astype(np.float32) + np.float32(RIDGE) * ahead
        new = ahead - rate * grad
        ahead = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w


def apply_linear(w: np.ndarray, x: np.ndarray | Sparse) -> np.ndarray:
    return _sigmoid(x @ w[:-1] + w[-1])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Chain:
    features: np.ndarray
    names: list[str]
    weights: list[np.ndarray]
    threshold: float

    def probabilities(self, present: np.ndarray) -> np.ndarray:
        x, out = present, []
        for w in self.weights:
            p = apply_linear(w, x)
            out.append(p)
            x = np.concatenate([x, p[:, None].astype(np.float32)], axis=1)
        return np.stack(out, axis=1).astype(np.float64)


def fit_chain(features: np.ndarray, names: list[str], x: np.ndarray | Sparse, labels: np.ndarray, fold: np.ndarray, chosen: np.ndarray | None = None) -> Chain:
    """Models in order; inputs of a later one are out-of-fold probabilities of the earlier.

    ``chosen`` says which features each fold's model may use and, last, the final one.
    Rows that are alike in features, labels and fold are one row with a weight: most
    documents have no feature at all.
    """
    chosen = np.ones((FOLDS + 1, len(features)), dtype=bool) if chosen is None else chosen
    x = x if isinstance(x, Sparse) else Sparse.of([np.flatnonzero(r) for r in x], x.shape[1])
    alike: dict[tuple, list[int]] = {}
    for k, y in enumerate(labels.tolist()):
        alike.setdefault((x.col[x.at[k] : x.at[k + 1]].tobytes(), *y, int(fold[k])), []).append(k)
    first = np.array([rows[0] for rows in alike.values()], dtype=np.int64)
    weight = np.array([len(rows) for rows in alike.values()], dtype=np.float64)
    x, labels, fold = x.take(first), labels[first], fold[first]
    weights, unseen, earlier = [], np.zeros(len(x)), []
    with_earlier = lambda part: reduce(lambda a, column: a.beside(column), earlier, part)
    for k in range(len(names)):
        y = labels[:, k]
        unseen = np.zeros(len(y))
        for f in range(FOLDS):
            inner = fold != f
            if inner.any() and not inner.all():
                some = with_earlier(x.only(chosen[f]))
                unseen[~inner] = apply_linear(fit_linear(some.take(np.flatnonzero(inner)), y[inner], weight[inner]), some.take(np.flatnonzero(~inner)))
        weights.append(fit_linear(with_earlier(x.only(chosen[-1])), y, weight))
        earlier.append(unseen)
    return Chain(features[chosen[-1]], names, weights, best_threshold(unseen, labels[:, -1], weight) if len(labels) else 0.5)


def best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The cut with the best F1 on out-of-fold probabilities, in the middle of its gap."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum((y * weight)[order])
    if not len(y) or not hits[-1]:
        return 0.5
    f1 = 2 * hits / (np.cumsum(weight[order]) + hits[-1])
    last = np.append(p[order][1:] < p[order][:-1], True)
    k = int(np.argmax(np.where(last, f1, -1)))
    return float((p[order][k] + (p[order][k + 1] if k + 1 < len(p) else 0)) / 2)


def train_chain(docs: DataFrame, labels: DataFrame, categories: list[str]) -> Chain:
    """The chain for label columns ``categories``; the last one must be known, others count as 0 where they are not."""
    spark, k = docs.sparkSession, len(categories)
    ys = [f"y{i}" for i in range(k)]
    known = labels.where(F.col("doc_id").isNotNull() & F.col(categories[-1]).isNotNull())
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(y) for c, y in zip(categories, ys)])
    known = known.orderBy(F.xxhash64("doc_id"), *ys).limit(TRAIN_DOCS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")  # TRAIN_DOCS rows of numbers
    rows = saved(rows.select(F.xxhash64("text").alias("tkey"), F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"), *ys, "text"))
    totals = {r["fold"]: r for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *[F.sum(y).alias(y) for y in ys]).collect()}  # FOLDS rows
    features, chosen = _features(rows, totals, k)
    got = rows.mapInArrow(_vectors(features, ["tkey", "fold", *ys]), "tkey long, fold int, " + ", ".join(f"{y} int" for y in ys) + ", at array<int>")
    got = sorted(got.orderBy("tkey", *ys).limit(2 * TRAIN_DOCS).collect(), key=lambda r: (r["tkey"], *[r[y] for y in ys]))  # a few feature numbers a row
    x = Sparse.of([r["at"] for r in got], len(features))
    label = np.array([[r[y] for y in ys] for r in got], dtype=np.float64).reshape(len(got), k)
    return fit_chain(features, list(categories), x, label, np.array([r["fold"] for r in got], dtype=np.int64), chosen)


def _features(rows: DataFrame, totals: dict, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes, and which of them are chosen without each fold and, last, from all rows."""
    tally = rows.mapInArrow(_tally(k), "f long, fold int, n long, " + ", ".join(f"b{i} long" for i in range(k))).groupBy("f", "fold").agg(*[F.sum(c).alias(c) for c in ["n", *[f"b{i}" for i in range(k)]]])
    per = tally.groupBy("f").agg(*[F.coalesce(F.sum(F.when(F.col("fold") == j, F.col(c))), F.lit(0)).alias(f"{c}_{j}") for c in ["n", *[f"b{i}" for i in range(k)]] for j in range(FOLDS)])
    enough = [F.expr(" + ".join(f"b{i}_{j}" for j in range(FOLDS))) >= LEAST_DOCS for i in range(k)]
    per = saved(per.where(reduce(lambda a, b: a | b, enough)))
    found = []
    for view in range(FOLDS + 1):
        inside, best = [j for j in range(FOLDS) if j != view], set()
        total = {c: sum(totals[j][c] for j in inside if j in totals) for c in ["n", *[f"y{i}" for i in range(k)]]}
        for i in range(k):
            n, bad = (F.expr(" + ".join(f"{c}_{j}" for j in inside)) for c in ("n", f"b{i}"))
            lift = ((bad + 0.5) / (total[f"y{i}"] + 1)) / ((n - bad + 0.5) / (total["n"] - total[f"y{i}"] + 1))
            top = per.select("f", bad.alias("bad"), lift.alias("lift")).where((F.col("bad") >= LEAST_DOCS) & (F.col("lift") >= LEAST_LIFT))
            best |= {r["f"] for r in top.orderBy(F.desc(F.col("bad") * F.log("lift")), "f").limit(FEATURES).select("f").collect()}  # FEATURES numbers
        found.append(np.array(sorted(best), dtype=np.int64).view(U64))
    release(per)
    features = np.unique(np.concatenate([*found, np.zeros(1, U64)]))
    return features, np.stack([np.isin(features, f) | (features == 0) for f in found])


def _score(chain):
    def run(batches):
        model = chain.value
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in row_slices(texts, 1 << 21):
                p = model.probabilities(_present(model.features, texts.slice(a, b - a)))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *[pa.array(p[:, k]) for k in range(p.shape[1])]], names=["doc_id", *[f"p_{n}" for n in model.names]])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, categories: list[str] | None = None, label: str = "toxic", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, p_<category> in chain order, toxic.

    ``categories`` are columns of ``labels`` (the one ``label`` if not given); toxic is
    whether the last one's probability reaches the threshold that had the best F1 on
    out-of-fold predictions.  Null and empty texts have no features: they get the
    intercepts' probabilities.  Rows that repeat score alike.  Null labels and ids are not
    learned from; without labels of both kinds all documents get the more frequent
    answer.  Labels are found by doc_id; the doc_id of the result is the column ``key``.
    Other columns are ignored, whatever their names.
    """
    chain = train_chain(docs, labels, categories or [label])
    model = docs.sparkSession.sparkContext.broadcast(chain)  # FEATURES hashes and weights
    schema = "doc_id long, " + ", ".join(f"p_{n} double" for n in chain.names)
    scored = docs.select(F.col(key).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_score(model), schema)
    return scored.withColumn("toxic", F.col(f"p_{chain.names[-1]}") >= chain.threshold)


def score_with_table_labels(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """The chain of the two categories that the table ``labels`` has: poor and then toxic."""
    return score_toxicity(docs, labels.select("doc_id", (1 - F.col("quality")).alias("poor"), "toxic"), ["poor", "toxic"], key=key)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of whole ``documents``, learned from ``labels``."""
    return score_with_table_labels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

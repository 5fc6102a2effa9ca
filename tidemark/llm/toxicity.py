"""Toxicity by a classifier chain of linear models over word features.

The categories are predicted one after another; the model of each sees the word features and the
probabilities of all earlier categories. In training those are out-of-fold predictions, so a later
model learns how far it can trust an earlier one. Fitting uses a bounded sample of labelled rows;
scoring runs over every document.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, stored

BUCKETS = 1 << 20
_EDGE = ".,;:!?\"'()[]{}#*$%&|<>-_/\\…«»“”¡¿"


class _Lookup(dict):
    """word -> column numbers, filled as words are met and emptied when large."""

    def __init__(self, columns: Mapping[int, int] | None, most: int = 400_000) -> None:
        super().__init__()
        self.columns, self.most = columns, most

    def __missing__(self, word: str) -> tuple[int, ...]:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        plain = word.strip(_EDGE)
        names = [plain, *["\1" + plain[:k] for k in (4, 5, 6) if len(plain) > k]] if plain else []
        tail = word[len(word.rstrip(_EDGE)) :]
        if len(tail) > 1:  # marks that trail a word tell junk from prose
            names.append("\0" + tail)
        found = [xxhash.xxh3_64_intdigest(n) & (BUCKETS - 1) for n in names]
        if self.columns is not None:
            found = [self.columns[b] for b in found if b in self.columns]
        self[word] = out = tuple(found)
        return out


def _features(text: str | None, lookup: _Lookup) -> tuple[np.ndarray, np.ndarray]:
    """(columns, log(1 + count)) of the whole text."""
    found = [c for part in map(lookup.__getitem__, text.lower().split()) for c in part] if text else []
    columns, counts = np.unique(np.asarray(found, np.int64), return_counts=True)
    return columns, np.log1p(counts)


@dataclass
class Sparse:
    """Rows of (column, value) pairs."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    def rows(self, keep: np.ndarray) -> Sparse:
        sizes = np.diff(self.starts)
        at = np.repeat(keep, sizes)
        return Sparse(np.r_[0, np.cumsum(sizes[keep])], self.columns[at], self.values[at], self.width)

    def dot(self, w: np.ndarray) -> np.ndarray:
        sums = np.r_[0.0, np.cumsum(self.values * w[self.columns])]
        return sums[self.starts[1:]] - sums[self.starts[:-1]]

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, self.values * np.repeat(r, np.diff(self.starts)), self.width)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: Sparse, earlier: np.ndarray, y: np.ndarray, *, l2: float = 1.0, steps: int = 150) -> tuple[np.ndarray, np.ndarray, float]:
    """(word weights, weights of earlier probabilities, intercept) by accelerated gradient descent on the penalised mean loss."""
    n = max(1, len(y))
    w, v, b = np.zeros(x.width), np.zeros(earlier.shape[1]), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))) if len(y) else -7.0
    scale = 0.25 * max(1e-9, Sparse(x.starts, x.columns, x.values**2, x.width).back(np.ones(len(y))).max(initial=0) / n * 4) + l2 / n
    pw, pv, pb = w, v, b
    for k in range(steps):
        m = k / (k + 3)
        yw, yv, yb = w + m * (w - pw), v + m * (v - pv), b + m * (b - pb)
        r = (_sigmoid(x.dot(yw) + earlier @ yv + yb) - y) / n
        pw, pv, pb = w, v, b
        w = yw - (x.back(r) + l2 / n * yw) / scale
        v = yv - (earlier.T @ r + l2 / n * yv) / (0.25 * max(1, len(v)) + l2 / n)
        b = yb - r.sum() / 0.25 * 0.5
    return w, v, b


@dataclass
class Chain:
    """Fitted models in order: (category, word weights, weights of earlier probabilities, intercept, threshold)."""

    buckets: dict[int, int]
    models: list[tuple[str, np.ndarray, np.ndarray, float, float]]

    def predict(self, x: Sparse) -> np.ndarray:
        out = np.zeros((len(x.starts) - 1, 0))
        for _, w, v, b, _ in self.models:
            out = np.column_stack([out, _sigmoid(x.dot(w) + out @ v + b)])
        return out


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1 on out-of-fold predictions."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    best = int(f1.argmax())
    after = p[order[best + 1]] if best + 1 < len(y) else 0.0
    return float((p[order[best]] + after) / 2)


def fit_chain(x: Sparse, labels: np.ndarray, names: list[str], folds: np.ndarray, buckets: dict[int, int], *, n_folds: int = 3, l2: float = 1.0) -> Chain:
    """Fit the categories in order; labels hold 0, 1 or NaN (not labelled)."""
    n = len(x.starts) - 1
    models, earlier = [], np.zeros((n, 0))
    for i, name in enumerate(names):
        y = labels[:, i]
        known = ~np.isnan(y)
        out_of_fold = np.zeros(n)
        for f in range(n_folds):
            inside, outside = known & (folds != f), folds == f
            w, v, b = fit_logistic(x.rows(inside), earlier[inside], y[inside], l2=l2)
            out_of_fold[outside] = _sigmoid(x.rows(outside).dot(w) + earlier[outside] @ v + b)
        w, v, b = fit_logistic(x.rows(known), earlier[known], y[known], l2=l2)
        both = known.any() and 0 < y[known].sum() < known.sum()
        models.append((name, w, v, b, _best_threshold(out_of_fold[known], y[known]) if both else 2.0))
        earlier = np.column_stack([earlier, out_of_fold])
    return Chain(buckets, models)


def train(docs: DataFrame, labels: DataFrame, categories: Mapping[str, Column], *, max_labelled: int = 20_000, words: int = 4096, n_folds: int = 3, l2: float = 1.0) -> Chain:
    """Fit a chain on at most max_labelled labelled documents, those with the smallest id hash.

    Word counts by category pick the `words` most telling features; both passes read the sample's
    whole texts in tasks, the driver receives fixed-size counts and the sample's chosen features.
    Labels may be null; of repeated labels the larger counts. `words` is at most 65,536.
    """
    bounded_batches(docs.sparkSession)
    names = list(categories)
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.cast("double").alias(f"y{i}") for i, c in enumerate(categories.values())])
    marked = marked.where("doc_id is not null").groupBy("doc_id").agg(*[F.max(f"y{i}").alias(f"y{i}") for i in range(len(names))])
    picked = stored(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled), "labels")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")  # max_labelled rows
    ys = [f"y{i}" for i in range(len(names))]
    texts = stored(texts.select("doc_id", F.col("text").cast("string").alias("text"), *ys).repartition(16), "labelled")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        total = np.zeros((1 + len(names), BUCKETS), np.uint32)
        lookup, rows = _Lookup(None), np.zeros(1 + len(names))
        for batch in batches:
            y = np.column_stack([batch.column(f"y{i}").to_numpy(zero_copy_only=False) for i in range(len(names))])
            for text, ys_ in zip(batch.column("text").to_pylist(), y, strict=True):
                columns, _ = _features(text, lookup)
                total[0, columns] += 1
                rows[0] += 1
                for i in np.flatnonzero(ys_ == 1):
                    total[1 + i, columns] += 1
                    rows[1 + i] += 1
        packed = zstandard.ZstdCompressor(level=1).compress(total.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary()), pa.array([rows.tolist()], pa.list_(pa.float64()))], names=["counts", "rows"])

    import zstandard

    counts, rows = np.zeros((1 + len(names), BUCKETS)), np.zeros(1 + len(names))
    for r in texts.mapInArrow(tally, "counts binary, rows array<double>").collect():  # a row for each of 16 tasks
        counts += np.frombuffer(zstandard.ZstdDecompressor().decompress(r.counts), np.uint32).reshape(counts.shape)
        rows += np.array(r.rows)
    telling = np.zeros(BUCKETS)
    for i in range(len(names)):
        inside, outside = counts[1 + i], counts[0] - counts[1 + i]
        p, q = (inside + 0.5) / (rows[1 + i] + 1), (outside + 0.5) / (rows[0] - rows[1 + i] + 1)
        telling = np.maximum(telling, np.where(counts[0] >= 3, np.abs(np.log(p / q)) * np.sqrt(inside + outside * (p < q)), 0))
    best = np.sort(np.argsort(-telling, kind="stable")[:words])
    best = best[telling[best] > 0]
    buckets = {int(b): k for k, b in enumerate(best)}

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(buckets)
        for batch in batches:
            found = [_features(t, lookup) for t in batch.column("text").to_pylist()]
            arrays = [batch.column("doc_id"), pa.array([f[0].astype("<u2").tobytes() for f in found], pa.binary()), pa.array([f[1].astype("<f4").tobytes() for f in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([*arrays, *[batch.column(y) for y in ys]], names=["doc_id", "columns", "values", *ys])

    schema = "doc_id long, columns binary, values binary, " + ", ".join(f"{y} double" for y in ys)
    sample = sorted(texts.mapInArrow(chosen, schema).collect(), key=lambda r: (r.doc_id, r.columns, r.values))  # six bytes a feature of at most max_labelled texts
    ids, y = np.array([r.doc_id for r in sample], np.int64), np.array([[np.nan if r[c] is None else r[c] for c in ys] for r in sample], np.float64)
    columns, values = (np.frombuffer(b"".join([r[name] for r in sample]), kind) for name, kind in (("columns", "<u2"), ("values", "<f4")))
    x = Sparse(np.r_[0, np.cumsum([len(r.columns) // 2 for r in sample])].astype(np.int64), columns.astype(np.int32), values, max(1, len(buckets)))
    del sample
    folds = (ids * 2654435761 >> 7) % n_folds
    return fit_chain(x, y.reshape(len(ids), len(ys)), names, folds, buckets, n_folds=n_folds, l2=l2)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """Adds p_<category> and is_<category> for every row; a null or empty text gets the intercepts alone and is_ false.

    Columns of those names in the input are replaced, others pass through.
    """
    from pyspark.sql import types as T

    bounded_batches(docs.sparkSession)
    names = [m[0] for m in chain.models]
    own = [*[f"p_{n}" for n in names], *[f"is_{n}" for n in names]]
    kept = docs.drop(*own)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(chain.buckets)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [_features(t, lookup) for t in texts]
            starts = np.r_[0, np.cumsum([len(f[0]) for f in found])].astype(np.int64)
            x = Sparse(starts, np.concatenate([f[0] for f in found] or [np.empty(0, np.int64)]), np.concatenate([f[1] for f in found] or [np.empty(0)]), max(1, len(chain.buckets)))
            p = chain.predict(x)
            some = np.array([bool(t and t.strip()) for t in texts], bool)
            flags = [pa.array((p[:, i] >= m[4]) & some) for i, m in enumerate(chain.models)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(p[:, i]) for i in range(len(names))], *flags], names=[*batch.schema.names, *own])

    fields = [*kept.schema.fields, *[T.StructField(f"p_{n}", T.DoubleType()) for n in names], *[T.StructField(f"is_{n}", T.BooleanType()) for n in names]]
    return kept.mapInArrow(predict, T.StructType(fields))

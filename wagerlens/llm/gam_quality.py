"""Quality classifier (operator 4): a generalised additive model with pairwise interactions.

Features are shares and sizes of the text alone. Each is cut into bins at quantiles of the training rows. Boosting goes
round the features in turn; each step fits a shallow tree on one feature's bins to the gradient of the log
loss and adds it to that feature's lookup table. The pairs of features that explain most of what is left get tables too, by trees that
split both. A score is the intercept plus one table entry for each feature and pair, through the logistic function.

Training takes labelled documents outside the held-out fold, at most ``TRAIN_ROWS`` of them: the first by a hash
of the id (the documented bound on the one sample here). Their features, not their texts, reach the driver.

Defined cases: a null text is an empty text; empty texts get a score; a document with several labels counts once
for each distinct label; without training rows every score is 0.5; null labels and null ids train nothing;
every given row gives one row; no rows give no rows; other columns are ignored or, by ``keep_good``, kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from wagerlens.llm.common import fold, table, texts

TRAIN_ROWS = 20_000
THRESHOLD = 0.3
BINS, PAIR_BINS, PAIRS = 64, 12, 8
ROUNDS, PAIR_ROUNDS, RATE, LEAVES, LEAST_ROWS, RIDGE = 60, 30, 0.15, 4, 20, 1.0

FEATURES = (
    "log_bytes", "log_words", "word_length", "upper_share", "digit_share", "symbol_share", "mark_share", "bar_share", "space_share",
    "high_share", "distinct_share", "echo_share", "top_share", "same_line_share", "line_words", "odd_end_share",
)

#: Bytes that a share counts.
_GROUPS = (
    bytes(range(0x41, 0x5B)), b"0123456789", b"#*$%&<>@^~=+\\_{}", b"!?", b"|", b" \t\n\x0b\x0c\r", bytes(range(0x80, 0x100)),
)
_GROUP_OF_BYTE = np.array([[b in group for group in _GROUPS] for b in range(256)], float)


def features(raw: bytes) -> list[float]:
    """The features of one text; shares of nothing are 0."""
    words = raw.split()
    size, n = max(len(raw), 1), max(len(words), 1)
    upper, digit, symbol, mark, bar, space, high = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _GROUP_OF_BYTE / size
    seen: dict[bytes, int] = {}
    for word in words:
        seen[word] = seen.get(word, 0) + 1
    echoes = sum(map(eq, words, words[1:]))
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    odd = sum(map(_ODD_END.__contains__, (word[-1] for word in words)))
    return [
        float(np.log1p(len(raw))), float(np.log1p(len(words))), (size - space * size) / n, upper, digit, symbol, mark, bar, space,
        high, len(seen) / n, echoes / n, max(seen.values(), default=0) / n, 1 - len(set(lines)) / max(len(lines), 1), min(n / max(len(lines), 1), 1e6), odd / n,
    ]


_ODD_END = frozenset(b"!#$%&*|<>~^=+_@")


@dataclass
class Model:
    """Bin edges by feature, a table by feature, and (feature, feature, edges, edges, table) by pair."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Bin, look up, add, for all rows at once."""
        total = np.full(len(rows), self.intercept)
        for k, (edges, values) in enumerate(zip(self.edges, self.tables)):
            total += values[np.searchsorted(edges, rows[:, k], side="right")]
        for i, j, left, right, values in self.pairs:
            total += values[np.searchsorted(left, rows[:, i], side="right"), np.searchsorted(right, rows[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins))


def _best_cut(grad: np.ndarray, hess: np.ndarray, rows: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a run of bins."""
    g, h, n = np.cumsum(grad)[:-1], np.cumsum(hess)[:-1], np.cumsum(rows)[:-1]
    gain = g**2 / (h + RIDGE) + (grad.sum() - g) ** 2 / (hess.sum() - h + RIDGE) - grad.sum() ** 2 / (hess.sum() + RIDGE)
    gain = np.where((n >= LEAST_ROWS) & (rows.sum() - n >= LEAST_ROWS), gain, 0.0)
    return (float(gain.max()), int(gain.argmax()) + 1) if len(gain) else (0.0, 0)


def _shallow_tree(grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """A table over one feature's bins, constant on at most ``leaves`` runs; the best cut is made first."""
    runs = [(0, len(grad))]
    while len(runs) < leaves:
        cuts = [(*_best_cut(grad[a:b], hess[a:b], rows[a:b]), a, b) for a, b in runs]
        gain, place, a, b = max(cuts)
        if gain <= 1e-9:
            break
        runs.remove((a, b))
        runs += [(a, a + place), (a + place, b)]
    values = np.zeros(len(grad))
    for a, b in runs:
        values[a:b] = grad[a:b].sum() / (hess[a:b].sum() + RIDGE)
    return values


def _pair_tree(grad: np.ndarray, hess: np.ndarray, rows: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and table of the best tree that cuts one feature once and each side once by the other."""
    best, values = 0.0, np.zeros_like(grad)
    for turned in (False, True):
        g, h, n = (x.T if turned else x for x in (grad, hess, rows))
        for cut in range(1, len(g)):
            out, gain = np.zeros_like(g), -(grad.sum() ** 2) / (hess.sum() + RIDGE)
            for side in (slice(0, cut), slice(cut, None)):
                sg, sh, sn = g[side].sum(0), h[side].sum(0), n[side].sum(0)
                _, place = _best_cut(sg, sh, sn)
                for part in (slice(0, place), slice(place, None)):
                    if sn[part].sum() >= LEAST_ROWS:
                        out[side, part] = sg[part].sum() / (sh[part].sum() + RIDGE)
                        gain += sg[part].sum() ** 2 / (sh[part].sum() + RIDGE)
            if gain > best:
                best, values = gain, out.T if turned else out
    return best, values


def train(rows: np.ndarray, labels: np.ndarray) -> Model:
    """Cyclic boosting of single features, then of the pairs that gain most."""
    if not len(rows):
        return Model(0.0, [np.empty(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES), [])
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    intercept = float(np.log(share / (1 - share)))
    edges = [_edges(rows[:, k], BINS) for k in range(rows.shape[1])]
    place = [np.searchsorted(e, rows[:, k], side="right") for k, e in enumerate(edges)]
    count = [np.bincount(p, minlength=len(e) + 1) for p, e in zip(place, edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(len(rows), intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return labels - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k, p in enumerate(place):
            grad, hess = slopes()
            step = RATE * _shallow_tree(np.bincount(p, grad, len(tables[k])), np.bincount(p, hess, len(tables[k])), count[k])
            tables[k] += step
            total += step[p]

    coarse = [_edges(rows[:, k], PAIR_BINS) for k in range(rows.shape[1])]
    cell = [np.searchsorted(e, rows[:, k], side="right") for k, e in enumerate(coarse)]

    def grids(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        shape = len(coarse[i]) + 1, len(coarse[j]) + 1
        flat = cell[i] * shape[1] + cell[j]
        grad, hess = slopes()
        return flat, *(np.bincount(flat, weights, shape[0] * shape[1]).reshape(shape) for weights in (grad, hess, None))

    ranked = sorted(((_pair_tree(*grids(i, j)[1:])[0], i, j) for i in range(len(cell)) for j in range(i)), reverse=True)
    chosen = [(i, j) for gain, i, j in ranked[:PAIRS] if gain > 0]
    pair_tables = {(i, j): np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in chosen}
    for _ in range(PAIR_ROUNDS):
        for i, j in chosen:
            flat, *parts = grids(i, j)
            step = RATE * _pair_tree(*parts)[1]
            pair_tables[i, j] += step
            total += step.ravel()[flat]
    return Model(intercept, edges, tables, [(i, j, coarse[i], coarse[j], pair_tables[i, j]) for i, j in chosen])


def _matrix(texts_of_batch: list[bytes | None]) -> np.ndarray:
    rows = [features(raw or b"") for raw in texts_of_batch]
    return np.array(rows, float).reshape(len(rows), len(FEATURES))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, folds: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``most`` labelled rows outside fold 0; the bound also bounds the broadcast."""
    chosen = (
        labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("quality"))
        .filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold(F.col("doc_id"), folds) != 0))
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most)
    )
    joined = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = _matrix(batch["text"].to_pylist())
            rows = pa.array(list(matrix), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.string()), batch["quality"], rows], ["doc_id", "quality", "x"])

    # Rows of a repeated id are as many as it has documents; the limit holds for them, too.
    found = joined.mapInArrow(measured, "doc_id string, quality int, x array<double>").orderBy("doc_id", "quality", "x").limit(most).toPandas()
    matrix = np.array(found["x"].tolist(), float).reshape(len(found), len(FEATURES))
    return matrix, found["quality"].to_numpy(float)


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    return train(*training_rows(texts(docs), labels, most))


def score_texts(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    rows = texts(docs, id_column, text_column).select("doc_id", F.col("text").cast("binary").alias("text"), (fold(F.col("doc_id")) == 0).alias("held_out"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_matrix(batch["text"].to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scored, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns, without a join or a shuffle."""
    place = docs.columns.index(text_column)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_matrix(batch.column(place).cast(pa.binary()).to_pylist()))
            yield batch.filter(pa.array(score >= threshold, pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document, learnt from ``labels`` outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return score_texts(docs, fit(docs, table(spark, sf_dir, "labels")))

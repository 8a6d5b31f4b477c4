"""Quality classifier: histogram gradient-boosted trees over document statistics.

Each text becomes a row of statistics (textstats.FEATURES); no label, language, source or id is among them. Training
bins every statistic by its quantiles and grows trees of fixed depth level by level from histograms of gradients and
Hessians of the logistic loss. A trained tree is a complete binary tree in flat arrays (feature, threshold, leaf), so
a batch descends all levels with numpy indexing alone.

Training takes at most SAMPLE_ROWS labelled rows, chosen by the hash of their id, from the rows whose
crc32(id) mod FOLDS isn't HELD_OUT. Everything else covers all rows.

Defined results: null and empty texts have statistics of zero and a score; a null id is never held out; labels that are
null are left out; a document labelled twice trains twice; without two classes of labels the score is their mean, or
0.5 with none; an empty table has no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgewatch.llm import textstats
from ridgewatch.llm.common import map_batches, store

FOLDS, HELD_OUT = 4, 2
#: The bound of the training sample; a row is about 200 bytes on the driver.
SAMPLE_ROWS = 50_000
TREES, DEPTH, BINS, RATE, L2, LEAST_HESSIAN = 80, 4, 48, 0.15, 1.0, 2.0
ACCEPT = 0.7


@dataclass(frozen=True)
class Forest:
    """feature and threshold: trees x inner nodes; leaf: trees x leaves; node k has children 2k + 1 and 2k + 2."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for rows of statistics."""
        margin = np.full(len(rows), self.base)
        at_row = np.arange(len(rows))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (rows[at_row, feature[node]] > threshold[node])
            margin += leaf[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-margin))


def _edges(column: np.ndarray) -> np.ndarray:
    """Upper bounds of a column's bins."""
    return np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1]))


def fit(rows: np.ndarray, labels: np.ndarray) -> Forest:
    """Trees for rows of statistics and labels of 0 and 1."""
    mean = float(labels.mean()) if len(labels) else 0.5
    nodes = 2**DEPTH - 1
    features = np.zeros((TREES, nodes), dtype=np.int64)
    thresholds = np.full((TREES, nodes), np.inf)
    leaves = np.zeros((TREES, nodes + 1))
    base = float(np.log(max(mean, 1e-6) / max(1 - mean, 1e-6)))
    if not len(labels) or not 0 < mean < 1:
        return Forest(base, features, thresholds, leaves)
    edges = [_edges(column) for column in rows.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, rows.T)], axis=1)
    margin = np.full(len(rows), base)
    for tree in range(TREES):
        chance = 1 / (1 + np.exp(-margin))
        gradient, hessian = chance - labels, chance * (1 - chance)
        node = np.zeros(len(rows), dtype=np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            local = node - first
            best = np.full(width, 1e-9)
            for f, bounds in enumerate(edges):
                if not len(bounds):
                    continue
                cell = local * BINS + binned[:, f]
                g, h = (
                    np.bincount(cell, weights=w, minlength=width * BINS).reshape(width, BINS).cumsum(axis=1)
                    for w in (gradient, hessian)
                )
                g_all, h_all = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + L2) + (g_all - g) ** 2 / (h_all - h + L2) - g_all**2 / (h_all + L2)
                gain[(h < LEAST_HESSIAN) | (h_all - h < LEAST_HESSIAN)] = 0
                gain = gain[:, : len(bounds)]
                cut = gain.argmax(axis=1)
                better = gain[np.arange(width), cut] > best
                best[better] = gain[np.arange(width), cut][better]
                own = first + np.nonzero(better)[0]
                features[tree, own], thresholds[tree, own] = f, bounds[cut[better]]
            node = 2 * node + 1 + (rows[np.arange(len(rows)), features[tree, node]] > thresholds[tree, node])
        local = node - nodes
        g, h = (np.bincount(local, weights=w, minlength=nodes + 1) for w in (gradient, hessian))
        leaves[tree] = -RATE * g / (h + L2)
        margin += leaves[tree, local]
    return Forest(base, features, thresholds, leaves)


def statistics(documents: DataFrame) -> DataFrame:
    """Per document: doc_id and x, its statistics."""
    rows = documents.select("doc_id", "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [textstats.features(t or "") for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float32()))], ["doc_id", "x"])

    return map_batches(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, x array<float>")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def training_sample(stats: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """At most SAMPLE_ROWS labelled rows outside the held-out fold, those with the smallest hashes of their id."""
    own = labels.select(F.col("doc_id").alias("label_id"), F.col(label).cast("double").alias("y")).where(
        F.col("y").isin(0.0, 1.0) & ~held_out(F.col("label_id"))
    )
    rows = stats.join(own, F.col("doc_id") == F.col("label_id"))
    return rows.select("x", "y", F.xxhash64("doc_id").alias("h")).orderBy("h", "y", "x").limit(SAMPLE_ROWS)


def train(stats: DataFrame, labels: DataFrame, label: str = "quality") -> Forest:
    sample = training_sample(stats, labels, label).select("x", "y").toPandas()
    rows = np.array(sample["x"].tolist(), dtype=np.float32).reshape(-1, len(textstats.FEATURES)).astype(np.float64)
    return fit(rows, sample["y"].to_numpy(np.float64))


def score(stats: DataFrame, forest: Forest) -> DataFrame:
    """Per document: doc_id and its score."""
    shared = stats.sparkSession.sparkContext.broadcast(forest)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(x))], ["doc_id", "score"])

    return map_batches(stats, run, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted."""
    stats = store(statistics(documents), "quality-statistics")
    return score(stats, train(stats, labels)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= ACCEPT).cast("int").alias("predicted"),
    )

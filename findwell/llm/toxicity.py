"""Toxicity by a linear classifier over character runs scaled with naive Bayes log-count ratios.

Runs of `SIZES` lower-case letters and single spaces are hashed into buckets. Each
bucket has the log ratio of its smoothed share among toxic and other texts; the
presence of a bucket in a text, scaled by that ratio, is a feature of a logistic
regression with L2 penalty. Buckets whose ratio is weak for the texts they occur
in carry no weight.

It learns from `per_class` whole labelled texts of each class at most, picked by
hashes of id and text, in two passes over batches of them; classes are weighted back
to their shares among all labels. Every text is scored whole.

Defined results: null texts are empty; an empty text, like any without a weighted
run, scores the intercept. With labels of one class only the score is that class's
share (smoothed), with none 0.5. Ids may repeat; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findwell.llm._arrow import bounded_batches, chunks
from findwell.llm._chars import hashed, stream
from findwell.llm._labelled import Sample, labelled_sample
from findwell.llm._logistic import ridge_sparse, sigmoid
from findwell.llm._split import remainder

SIZES = (4, 5, 6, 8)
BUCKET_BITS = 21
#: Labelled texts of a class that are learnt from at most.
PER_CLASS = 2_000
#: Buckets of the strongest evidence that get a weight.
FEATURES = 30_000


def _buckets(texts: list[str], sizes: tuple[int, ...], bits: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket), each pair once, of the runs in texts; only wanted buckets where given."""
    chars, owner, counts = stream(texts)
    shift, found = np.uint64(64 - bits), []
    for a, hashes in hashed(chars, max(sizes)):
        ok = np.flatnonzero(counts[a : a + len(hashes[0])])
        own = owner[a:][ok].astype(np.int64) << bits
        for k in sizes:
            h = hashes[k][ok]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            bucket = (h >> shift).astype(np.int64)
            if wanted is None:
                found.append(np.unique(own | bucket))
            else:
                at = np.flatnonzero(wanted[bucket])
                found.append(own[at] | bucket[at])
    pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    return pairs >> bits, pairs & ((1 << bits) - 1)


class NaiveBayesLinear:
    """The classifier: a weight for each bucket, and an intercept."""

    def __init__(self, sample: Sample, sizes: tuple[int, ...] = SIZES, bits: int = BUCKET_BITS, features: int = FEATURES, penalty: float = 2e-3, alpha: float = 0.5):
        self.sizes, self.bits = sizes, bits
        self.weights = np.zeros(1 << bits, np.float32)
        # the first pass counts in how many texts of a class a bucket occurs
        p, q = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
        labels = []
        for texts, y in sample.batches():
            rows, buckets = _buckets(texts, sizes, bits)
            of = y[rows] == 1
            np.add.at(p, buckets[of], 1)
            np.add.at(q, buckets[~of], 1)
            labels.append(y)
        y = np.concatenate(labels) if labels else np.empty(0, np.int64)
        n = len(y)
        self.intercept = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))) if n else 0.0
        if len(set(y.tolist())) < 2:
            return
        # shares of the texts of a class that have the run
        ratio = np.log((p + alpha) / (y.sum() + 2 * alpha))
        ratio -= np.log((q + alpha) / (n - y.sum() + 2 * alpha))
        p += q
        strength = np.abs(ratio) * np.sqrt(p)
        strength[p < 3] = 0
        del p, q
        keep = np.argsort(-strength, kind="stable")[:features]
        keep = np.sort(keep[strength[keep] > 0])
        del strength
        ratio = ratio[keep]
        column = np.full(1 << bits, -1, np.int32)
        column[keep] = np.arange(len(keep))
        wanted = column >= 0
        # the second keeps the columns of the weighted buckets
        cols, sizes_of = [], []
        for texts, _ in sample.batches():
            rows, buckets = _buckets(texts, sizes, bits, wanted)
            cols.append(column[buckets])
            sizes_of.append(np.bincount(rows, minlength=len(texts)))
        del column, wanted
        begins = np.r_[0, np.cumsum(np.concatenate(sizes_of))]
        of_class = np.where(y == 1, sample.counts[1], sample.counts[0])
        weight = of_class / np.where(y == 1, max(y.sum(), 1), max(n - y.sum(), 1))
        w, self.intercept = ridge_sparse(begins, np.concatenate(cols), ratio, y, penalty, weight)
        self.weights[keep] = w * ratio

    def score(self, texts: list[str]) -> np.ndarray:
        rows, buckets = _buckets(texts, self.sizes, self.bits, self.weights != 0)
        return sigmoid(np.bincount(rows, weights=self.weights[buckets], minlength=len(texts)) + self.intercept)


def toxicity(docs: DataFrame, labels: DataFrame, learn: Column | None = None, threshold: float = 0.3, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, score, predicted. `learn` says which labelled rows teach, by their doc_id."""
    spark = docs.sparkSession
    bounded_batches(spark)
    model = NaiveBayesLinear(labelled_sample(docs, labels, "toxic", F.lit(True) if learn is None else learn, per_class))
    sent = spark.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in chunks(batches, limit=1 << 19):
            score = own.score([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn=remainder("doc_id", 4) != 2)
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")

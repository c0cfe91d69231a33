"""Quality by a sparse ensemble of rules.

Statistics of each text (shares of kinds of characters, of repeated lines and
words, lengths) are made in one pass. Shallow boosted trees over them are grown on
a labelled sample; every path from a root to a node is a conjunctive rule. A
lasso logistic regression weighs the rules, most weights come out as zero, and the
rules left are compiled into one Spark expression over the statistics.

It learns from `per_class` whole labelled texts of each class at most, picked by
hashes of id and text; an intercept shift restores the classes' shares among all labels.

Defined results: null and empty texts have all statistics zero and are scored by
the rules that hold for them. Without labels the score is 0.5, with one class its
smoothed share. Repeated rows return one row each, other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findwell.llm._arrow import as_bytes, bounded_batches, chunks, flat
from findwell.llm._labelled import labelled_sample
from findwell.llm._logistic import lasso, sigmoid
from findwell.llm._split import remainder

#: Labelled texts of a class that are learnt from at most.
PER_CLASS = 2_000

#: Kinds of bytes that are counted.
_KINDS = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "blank": (9, 11, 12, 13, 32),
    "line": (10,),
    "stop": (46, 44, 59, 58),
    "loud": (33, 63),
    "mark": (35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 92, 94, 95, 96, 123, 124, 125, 126, 47),
    "quote": (34, 39, 40, 41, 45, 91, 93),
    "high": range(128, 256),
}
STATISTICS = [f"{k}_share" for k in _KINDS] + ["log_bytes", "word_bytes", "long_words", "distinct_words", "top_word", "repeated_lines", "line_words", "marked_words", "same_as_before"]


def statistics(data: np.ndarray, off: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Rows of `STATISTICS` for texts laid end to end."""
    n = len(off) - 1
    out = np.zeros((n, len(STATISTICS)))
    kind = np.full(256, len(_KINDS), np.uint8)
    for k, members in enumerate(_KINDS.values()):
        kind[list(members)] = k
    size = np.diff(off)
    if len(data):
        owner = np.repeat(np.arange(n), size)
        table = np.bincount(owner * 16 + kind[data], minlength=n * 16).reshape(n, 16)
        out[:, : len(_KINDS)] = table[:, : len(_KINDS)] / np.maximum(size, 1)[:, None]
    at = len(_KINDS)
    out[:, at] = np.log1p(size)
    for i, text in enumerate(texts):
        words = text.split()
        if not words:
            continue
        m = len(words)
        lengths = np.fromiter(map(len, words), np.int64, m)
        counts = Counter(words)
        lines = [x for x in text.split(b"\n") if x.strip()]
        marked = sum(c for w, c in counts.items() if not (w[-1] >= 128 or w[-1:].isalnum()))
        same = sum(a == b for a, b in zip(words, words[1:]))
        out[i, at + 1 :] = (lengths.mean(), (lengths > 15).mean(), len(counts) / m, max(counts.values()) / m, 1 - len(set(lines)) / max(1, len(lines)), min(m / max(1, len(lines)), 1000.0), marked / m, same / m)
    return out


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of its text."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            column = batch.column(1)
            x = statistics(*flat(column), as_bytes(column))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in np.ascontiguousarray(x.T))], names=["doc_id", *STATISTICS])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} double" for c in STATISTICS))


# rules ------------------------------------------------------------------------

Rule = tuple[tuple[int, bool, float], ...]


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 48, least: int = 15, seed: int = 5) -> list[Rule]:
    """Conditions (statistic, above, threshold) of all paths of boosted regression trees on the log loss."""
    n, m = x.shape
    if n < 2 * least or len(np.unique(y)) < 2:
        return []
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, bins))) for j in range(m)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(m)], axis=1)
    rng = np.random.default_rng(seed)
    score = np.zeros(n)
    rules: dict[Rule, None] = {}

    def split(rows: np.ndarray, grad: np.ndarray, hess: np.ndarray, path: Rule, left: int) -> None:
        g, h = grad[rows], hess[rows]
        if path:
            rules.setdefault(tuple(sorted(path)))
        if left and len(rows) >= 2 * least:
            best = (1e-6, -1, 0)
            whole = g.sum() ** 2 / (h.sum() + 1.0)
            for j in use:
                if not len(cuts[j]):
                    continue
                k = binned[rows, j]
                gs = np.cumsum(np.bincount(k, weights=g, minlength=len(cuts[j]) + 1))[:-1]
                hs = np.cumsum(np.bincount(k, weights=h, minlength=len(cuts[j]) + 1))[:-1]
                c = np.cumsum(np.bincount(k, minlength=len(cuts[j]) + 1))[:-1]
                gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - whole
                gain[(c < least) | (len(rows) - c < least)] = 0
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (gain[at], j, at)
            _, j, at = best
            if j >= 0:
                low = binned[rows, j] <= at
                value = float(cuts[j][at])
                split(rows[low], grad, hess, (*path, (j, False, value)), left - 1)
                split(rows[~low], grad, hess, (*path, (j, True, value)), left - 1)
                return
        score[rows] -= rate * g.sum() / (h.sum() + 1.0)

    for _ in range(trees):
        p = sigmoid(score)
        use = rng.permutation(m)[: max(4, m // 2)]
        split(np.sort(rng.permutation(n)[: max(2 * least, n * 3 // 4)]), p - y, p * (1 - p), (), depth)
    return list(rules)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, above, value in rule:
        out &= (x[:, j] > value) if above else (x[:, j] <= value)
    return out


class RuleEnsemble:
    """Rules with non-zero weight, and an intercept."""

    def __init__(self, x: np.ndarray, y: np.ndarray, shares: dict[int, int], penalty: float = 2e-3):
        self.rules: list[Rule] = []
        self.weights = np.zeros(0)
        n1, n0 = shares.get(1, 0), shares.get(0, 0)
        self.intercept = float(np.log((n1 + 0.5) / (n0 + 0.5))) if n1 + n0 else 0.0
        rules = grow_rules(x, y)
        if not rules:
            return
        z = np.stack([holds(r, x) for r in rules], axis=1).astype(np.float64)
        support = z.mean(0)
        keep = (support > 0.005) & (support < 0.995)
        rules, z, support = [r for r, k in zip(rules, keep) if k], z[:, keep], support[keep]
        scale = np.sqrt(support * (1 - support))
        w, b = lasso(z / scale, y.astype(float), penalty)
        some = np.flatnonzero(w)
        self.rules, self.weights = [rules[k] for k in some], w[some] / scale[some]
        # the sample has other shares of classes than all labels
        s1, s0 = y.sum(), len(y) - y.sum()
        self.intercept = b + float(np.log(max(n1, 1) / max(n0, 1)) - np.log(max(s1, 1) / max(s0, 1)))

    def column(self) -> Column:
        """The score as an expression over the statistics."""
        terms = []
        for rule, w in zip(self.rules, self.weights.tolist()):
            conditions = [(F.col(STATISTICS[j]) > v) if above else (F.col(STATISTICS[j]) <= v) for j, above, v in rule]
            terms.append(F.when(reduce(lambda a, b: a & b, conditions), F.lit(w)).otherwise(F.lit(0.0)))
        # summed pairwise, so that the expression stays shallow
        while len(terms) > 1:
            terms = [terms[k] + terms[k + 1] if k + 1 < len(terms) else terms[k] for k in range(0, len(terms), 2)]
        total = F.lit(self.intercept) + (terms[0] if terms else F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for rule, w in zip(self.rules, self.weights):
            total += w * holds(rule, x)
        return sigmoid(total)


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, per_class: int = PER_CLASS) -> RuleEnsemble:
    sample = labelled_sample(docs, labels, "quality", F.lit(True) if learn is None else learn, per_class)
    x, labels_of = [np.empty((0, len(STATISTICS)))], [np.empty(0, np.int64)]
    for batch, y in sample.batches():
        texts = [t.encode() for t in batch]
        off = np.r_[0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))].astype(np.int64)
        x.append(statistics(np.frombuffer(b"".join(texts), np.uint8), off, texts))
        labels_of.append(y)
    return RuleEnsemble(np.concatenate(x), np.concatenate(labels_of), sample.counts)


def quality(docs: DataFrame, labels: DataFrame, learn: Column | None = None, threshold: float = 0.3, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, the statistics, score, predicted. `learn` says which labelled rows teach, by their doc_id."""
    model = fit(docs, labels, learn, per_class)
    scored = with_statistics(docs).withColumn("score", model.column())
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn=remainder("doc_id", 5) != 0)
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")

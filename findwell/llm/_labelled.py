"""Bounded samples of labelled rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findwell.session import saved


def draw(*parts: Column) -> Column:
    """A number from 0 to 1 hashed from the parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def share(bound: int, n: int) -> float:
    """Share of n rows that holds `bound` of them almost surely, and few more."""
    return min(1.0, (bound + 6 * bound**0.5 + 10) / max(n, 1))


def by_class(of: str, shares: dict) -> Column:
    out = F.lit(0.0)
    for value, part in shares.items():
        out = F.when(F.col(of) == value, F.lit(part)).otherwise(out)
    return out


class Sample:
    """Labelled texts in the order of their draws; whole texts, a bounded part of them in memory at a time."""

    def __init__(self, rows: DataFrame, counts: dict[int, int], per_class: int):
        self.rows, self.counts, self.per_class = rows, counts, per_class

    def batches(self, limit: int = 400_000) -> Iterator[tuple[list[str], np.ndarray]]:
        """(texts, labels) of about `limit` characters, one text at least; the same at every call."""
        taken: dict[int, int] = {}
        texts, y, size = [], [], 0
        for row in self.rows.toLocalIterator():
            taken[row["y"]] = taken.get(row["y"], 0) + 1
            if taken[row["y"]] > self.per_class:
                continue
            texts.append(row["text"])
            y.append(row["y"])
            size += len(row["text"])
            if size >= limit:
                yield texts, np.array(y)
                texts, y, size = [], [], 0
        if texts:
            yield texts, np.array(y)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, seed: int = 3) -> Sample:
    """Whole texts of up to `per_class` labelled rows of each class, picked by hashes of id and text.

    Rows with a null id or label teach nothing. Where an id has several labels
    its largest counts; null texts are empty; equal rows teach once.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).where(learn).groupBy("doc_id").agg(F.max(label).alias("y"))
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = rows.where(draw(F.lit(seed), F.col("doc_id")) < by_class("y", {y: share(per_class, n) for y, n in counts.items()}))  # bounded by per_class
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", text.alias("text")).join(F.broadcast(picked), "doc_id")
    # an id can have many texts, and a row many equals: each text counts once, and those of an id are drawn again
    once = saved(found.groupBy("doc_id", "y", F.xxhash64("text").alias("key")).agg(F.first("text").alias("text")), "labelled")
    have = {r["y"]: r["n"] for r in once.groupBy("y").agg(F.count("*").alias("n")).collect()}
    again = draw(F.lit(seed), F.col("doc_id"), F.col("key"))
    few = once.withColumn("draw", again).where(F.col("draw") < by_class("y", {y: share(per_class, n) for y, n in have.items()}))
    return Sample(saved(few.orderBy("draw", "doc_id", "key").select("y", "text"), "labelled-sample"), counts, per_class)

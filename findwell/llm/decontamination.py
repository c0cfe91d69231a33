"""Benchmark decontamination by winnowing.

Words of benchmark items are hashed in runs of `gram` words; of each `window`
consecutive run hashes the least is kept, ties included. Documents are winnowed
alike, so every shared span of gram + window - 1 words keeps a fingerprint at the
same place in both. Matching fingerprints are looked up or joined, and each hit
is extended word by word to both sides; what reaches a whole item window is
marked. Items with fewer words than a window are one window of their own length,
compared at every place of a document.

While the benchmark's fingerprints are few (`broadcast_words`, checked by a
count) they go to every task; beyond that, documents' and items' fingerprints are
joined in Spark and each hit is extended where it is found.

Defined results: null and empty texts have no words and are never hit; empty
items hit nothing; repeated items and documents each count. Ids of items are
compared and sorted as strings, a null id is left out of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findwell.llm._arrow import bounded_batches, chunks, flat
from findwell.session import saved

#: Words of a window, words of a hashed run.
WINDOW, GRAM = 10, 5
#: Words of a benchmark up to which its fingerprints are sent to every task (about 100 bytes each).
BROADCAST_WORDS = 500_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    if n:
        p[0] = 1
    return np.multiply.accumulate(p)


class _Powers:
    """Powers of the base and of its inverse, grown when asked for."""

    def __init__(self):
        self.up = self.down = np.empty(0, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(_BASE, n), _powers(_INVERSE, n)
        return self.up[:n], self.down[:n]


_powers_of = _Powers()


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of rows laid end to end, and the first word of each row (with the end)."""
    low = _LOWER[data]
    inside = _WORD[low]
    if not len(low):
        return np.empty(0, np.uint64), np.zeros(len(off), np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = off[(off > 0) & (off < len(low))]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cuts - 1] = inside[cuts - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers_of(len(low) + 1)
    sums = np.empty(len(low) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return _mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)), np.searchsorted(s, off)


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of the `length` words from each place on."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, length, np.uint64)
    for k in range(length):
        h = h * np.uint64(_BASE) + words[k : k + n]
    return _mix(h)


def winnow(hashes: np.ndarray, first: np.ndarray, end: np.ndarray, window: int) -> np.ndarray:
    """Places kept: the least hash of each `window` places of a row, ties included.

    first, end: of the row that each place belongs to.
    """
    n = len(hashes)
    if not n:
        return np.empty(0, np.int64)
    at = np.arange(n)
    least = hashes.copy()
    for k in range(1, window):
        least[: n - k] = np.where(at[: n - k] + k < end[: n - k], np.minimum(least[: n - k], hashes[k:]), least[: n - k])
    # a window starts where `window` places follow in the row, or at the first of a shorter row
    starts = (at + window <= end) | (at == first)
    keep = starts & (least == hashes)
    for k in range(1, window):
        keep[k:] |= (least[:-k] == hashes[k:]) & (at[k:] - k >= first[k:]) & starts[:-k]
    return np.flatnonzero(keep)


class Benchmark:
    """Fingerprints of benchmark items as sorted arrays."""

    def __init__(self, ids: list[str | None], words: np.ndarray, first: np.ndarray, window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        self.ids, self.words, self.first = np.array([i if i is not None else "" for i in ids], object), words, first
        self.known = np.array([i is not None for i in ids], bool)
        n = np.diff(first)
        row = np.repeat(np.arange(len(n)), n)
        self.row = row
        long = n >= window
        # long items: winnowed runs
        h = run_hashes(words, gram)
        ok = long[row[: len(h)]] & (np.arange(len(h)) + gram <= first[1:][row[: len(h)]])
        at = np.flatnonzero(ok)
        r = row[at]
        # places of an item's runs are consecutive, so ranges within `at` serve as rows
        begin = np.searchsorted(r, r, side="left")
        stop = np.searchsorted(r, r, side="right")
        kept = at[winnow(h[at], begin, stop, window - gram + 1)]
        order = np.argsort(h[kept], kind="stable")
        self.prints, self.places = h[kept][order], kept[order]
        # short items, by length
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for m in np.unique(n[(n > 0) & ~long]).tolist():
            items = np.flatnonzero(n == m)
            hs = run_hashes(words, m)[first[items]]
            order = np.argsort(hs, kind="stable")
            self.short[m] = hs[order], items[order]

    def mark(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[set[int]]]:
        """Which words of documents are hit, and the items that hit each document."""
        n = np.diff(first)
        row = np.repeat(np.arange(len(n)), n)
        edge = np.zeros(len(words) + 1, np.int64)
        items: list[set[int]] = [set() for _ in n]
        h = run_hashes(words, self.gram)
        at = np.flatnonzero(np.arange(len(h)) + self.gram <= first[1:][row[: len(h)]]) if len(h) else np.empty(0, np.int64)
        if len(at) and len(self.prints):
            r = row[at]
            counts = np.bincount(r, minlength=len(n))
            ends = np.cumsum(counts)
            kept = at[winnow(h[at], (ends - counts)[r], ends[r], self.window - self.gram + 1)]
            for p, q in self._hits(h[kept], kept):
                self._extend(words, first, row, p, q, edge, items)
        for m, (hs, which) in self.short.items():
            hm = h if m == self.gram else run_hashes(words, m)
            if not len(hm):
                continue
            lo, hi = np.searchsorted(hs, hm, "left"), np.searchsorted(hs, hm, "right")
            p = np.flatnonzero((hi > lo) & (np.arange(len(hm)) + m <= first[1:][row[: len(hm)]]))
            np.add.at(edge, p, 1)
            np.add.at(edge, p + m, -1)
            for d, a, b in set(zip(row[p].tolist(), lo[p].tolist(), hi[p].tolist())):
                items[d].update(which[a:b].tolist())
        return np.cumsum(edge[:-1]) > 0, items

    def _hits(self, hashes: np.ndarray, places: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (place in the documents, place in the items) with equal fingerprints."""
        lo, hi = np.searchsorted(self.prints, hashes, "left"), np.searchsorted(self.prints, hashes, "right")
        some = np.flatnonzero(hi > lo)
        lo, size, places = lo[some], (hi - lo)[some], places[some]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        for at in range(0, total, most):
            k = np.arange(at, min(total, at + most))
            g = np.searchsorted(ends, k, side="right")
            yield places[g], self.places[lo[g] + k - (ends - size)[g]]

    def _extend(self, words, first, row, p, q, edge, items) -> None:
        """Mark what equals an item around each hit, if it reaches a window; a window holds its fingerprint."""
        reach = self.window - self.gram
        d, i = row[p], self.row[q]
        spans = []
        for step in (-1, 1):
            length = np.zeros(len(p), np.int64)
            going = np.ones(len(p), bool)
            for k in range(1, reach + 1):
                x, y = (p - k, q - k) if step < 0 else (p + self.gram - 1 + k, q + self.gram - 1 + k)
                going &= (x >= first[d]) & (x < first[d + 1]) & (y >= self.first[i]) & (y < self.first[i + 1])
                going[going] = words[x[going]] == self.words[y[going]]
                length += going
            spans.append(length)
        inner = np.ones(len(p), bool)
        for k in range(self.gram):
            inner &= words[p + k] == self.words[q + k]
        ok = inner & (spans[0] + spans[1] + self.gram >= self.window)
        np.add.at(edge, p[ok] - spans[0][ok], 1)
        np.add.at(edge, p[ok] + self.gram + spans[1][ok], -1)
        for a, b in set(zip(d[ok].tolist(), i[ok].tolist())):
            items[a].add(b)


_NAMES = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
_SPANS = T.ArrayType(T.StructType().add("first", "long").add("words", "long"))


def _digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, broadcast_words: int = BROADCAST_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the spans hit as (first word, words).

    The id may be of any type, a struct of a row's columns too.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    items = benchmark.select(benchmark[item_col].cast("string").alias("item_id"), benchmark[text_col].alias("text"))
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    # a word takes two bytes with its separator, so bytes bound the words
    n_rows, n_bytes = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if n_bytes <= broadcast_words * 2 and n_rows <= broadcast_words:
        return _by_lookup(rows, items, window, gram)
    return _by_join(rows, items, window, gram)


def _by_lookup(rows: DataFrame, items: DataFrame, window: int, gram: int) -> DataFrame:
    spark = rows.sparkSession
    table = items.toArrow()
    data, off = flat(table["text"].combine_chunks() if table.num_rows else pa.array([], pa.string()))
    words, first = word_hashes(data, off)
    sent = spark.sparkContext.broadcast((table["item_id"].to_pylist(), words, first))
    made: list[Benchmark] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Benchmark(*sent.value, window, gram))
        bench = made[0]
        for batch in chunks(batches):
            words, first = word_hashes(*flat(batch.column(1)))
            hit, found = bench.mark(words, first)
            sums = np.r_[0, np.cumsum(hit)]
            n_hit = sums[first[1:]] - sums[first[:-1]]
            names = [[bench.ids[i] for i in f if bench.known[i]] for f in found]
            spans = []
            for a, b, n in zip(first[:-1].tolist(), first[1:].tolist(), n_hit.tolist()):
                if not n:
                    spans.append([])
                    continue
                x = np.flatnonzero(np.diff(np.r_[0, hit[a:b].astype(np.int8), 0]))
                spans.append([{"first": int(s), "words": int(e - s)} for s, e in zip(x[::2], x[1::2])])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(first)), pa.array(n_hit), pa.array([len(f) for f in found], pa.int64()), pa.array([_digest(f) for f in names]), pa.array(n_hit > 0), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())])))],
                names=[*_NAMES, "spans"],
            )

    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType)]).add("n_words", "long").add("n_hit", "long").add("n_items", "long")
    return rows.mapInArrow(run, schema.add("items_sha256", "string").add("contaminated", "boolean").add("spans", _SPANS))


def _by_join(rows: DataFrame, items: DataFrame, window: int, gram: int) -> DataFrame:
    """The same result for a benchmark of any size.

    Fingerprints of documents and items, each with the words around it, are
    joined; hits that reach a window are grouped by document.
    """
    reach = window - gram
    key = F.monotonically_increasing_id()
    rows = saved(rows.withColumn("row", key), "documents")
    items = saved(items.withColumn("row", key), "items")

    def prints(side: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches):
                ids = batch.column(0).to_numpy()
                words, first = word_hashes(*flat(batch.column(1)))
                n = np.diff(first)
                row = np.repeat(np.arange(len(n)), n)
                found = []
                lengths = range(1, window) if side == "item" else batch.column(2)[0].as_py()
                for m in lengths:
                    h = run_hashes(words, m)
                    if len(h):
                        ok = np.arange(len(h)) + m <= first[1:][row[: len(h)]]
                        if side == "item":
                            ok &= n[row[: len(h)]] == m
                        p = np.flatnonzero(ok)
                        found.append((h[p], p, m))
                h = run_hashes(words, gram)
                ok = np.arange(len(h)) + gram <= first[1:][row[: len(h)]] if len(h) else np.zeros(0, bool)
                if side == "item" and len(h):
                    ok &= n[row[: len(h)]] >= window
                at = np.flatnonzero(ok)
                if len(at):
                    r = row[at]
                    begin, stop = np.searchsorted(r, r, "left"), np.searchsorted(r, r, "right")
                    kept = at[winnow(h[at], begin, stop, reach + 1)]
                    found.append((h[kept], kept, 0))
                for h, p, m in found:
                    for a in range(0, len(p), 20_000):
                        q = p[a : a + 20_000]
                        d = row[q]
                        if m:
                            around = np.zeros((len(q), 0), np.int64)
                        else:
                            around = np.zeros((len(q), window + reach), np.int64)
                            for k in range(-reach, window):
                                x = q + k
                                inside = (x >= first[d]) & (x < first[d + 1])
                                around[inside, k + reach] = (words[x[inside]] | np.uint64(1)).view(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(h[a : a + 20_000].view(np.int64)), pa.array(np.full(len(q), m, np.int32)), pa.array(ids[d]), pa.array(q - first[d]), pa.array(around.tolist(), pa.list_(pa.int64()))],
                            names=["print", "length", "row", "place", "around"],
                        )

        return run

    schema = "print bigint, length int, row bigint, place bigint, around array<bigint>"
    of_items = saved(items.select("row", "text").mapInArrow(prints("item"), schema), "item-prints")
    lengths = sorted(r[0] for r in of_items.select("length").distinct().collect() if r[0])
    of_docs = rows.select("row", "text", F.array(*[F.lit(m) for m in lengths]).cast("array<int>").alias("lengths")).mapInArrow(prints("doc"), schema)
    a, b = of_docs.alias("a"), of_items.alias("b")
    hits = a.join(b, (F.col("a.print") == F.col("b.print")) & (F.col("a.length") == F.col("b.length")))
    same = F.zip_with("a.around", "b.around", lambda x, y: (x == y) & (x != 0))
    left = F.expr(f"{reach}") - F.coalesce(F.array_max(F.filter(F.transform(F.sequence(F.lit(1), F.lit(reach)), lambda k: F.when(~F.element_at(same, k), k)), lambda k: k.isNotNull())), F.lit(0))
    after = F.transform(F.sequence(F.lit(1), F.lit(reach)), lambda k: F.when(~F.element_at(same, k + window), k))
    right = F.coalesce(F.array_min(F.filter(after, lambda k: k.isNotNull())) - 1, F.lit(reach))
    inner = F.forall(F.slice(same, reach + 1, gram), lambda x: x)
    hits = hits.select(
        F.col("a.row").alias("row"), F.col("b.row").alias("item"), F.col("a.place").alias("place"), F.col("a.length").alias("length"),
        F.when(F.col("a.length") > 0, 0).otherwise(left).alias("left"), F.when(F.col("a.length") > 0, F.col("a.length") - gram).otherwise(right).alias("right"),
        F.when(F.col("a.length") > 0, True).otherwise(inner).alias("inner"),
    ).where(F.col("inner") & ((F.col("length") > 0) | (F.col("left") + F.col("right") + gram >= window)))
    hits = saved(hits.select("row", "item", (F.col("place") - F.col("left")).alias("a"), (F.col("place") + gram + F.col("right")).alias("b")), "hits")
    spans = hits.select("row", "a", "b").distinct()
    w = Window.partitionBy("row").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("begins", (F.col("a") > F.coalesce(F.max("b").over(w), F.lit(-1))).cast("int"))
    w = Window.partitionBy("row").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, 0)
    spans = spans.withColumn("island", F.sum("begins").over(w)).groupBy("row", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    per_doc = spans.groupBy("row").agg(F.sum(F.col("b") - F.col("a")).alias("n_hit"), F.sort_array(F.collect_list(F.struct(F.col("a").alias("first"), (F.col("b") - F.col("a")).alias("words")))).alias("spans"))
    names = hits.select("row", "item").distinct().join(items.select(F.col("row").alias("item"), "item_id"), "item")
    per_item = names.groupBy("row").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list("item_id")).alias("ids"))

    counted = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType)]).add("row", "long").add("n_words", "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            _, first = word_hashes(*flat(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.diff(first))], names=["doc_id", "row", "n_words"])

    words = rows.select("doc_id", "text", "row").mapInArrow(count, counted)
    out = words.join(per_doc, "row", "left").join(per_item, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"),
    )


def op4_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("spans")


_A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_A_TO_Z}', '{_A_TO_Z.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS ws FROM documents),
i AS (SELECT item_id::VARCHAR AS id, row_number() OVER () AS n, {_WORDS} AS ws FROM benchmark),
w AS (SELECT id, n, ws, least(len(ws), {WINDOW}) AS m FROM i WHERE len(ws) > 0),
iw AS (SELECT DISTINCT id, n, m, array_to_string(ws[k:k + m - 1], ' ') AS run FROM w, unnest(range(1, len(ws) - m + 2)) AS q(k)),
dw AS (SELECT r, m, k, array_to_string(ws[k:k + m - 1], ' ') AS run FROM d, (SELECT DISTINCT m FROM iw) AS l, unnest(range(1, len(ws) - m + 2)) AS q(k)),
h AS (SELECT r, k, dw.m, id, n FROM dw JOIN iw ON dw.m = iw.m AND dw.run = iw.run),
c AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, p FROM h, unnest(range(k, k + m)) AS q(p)) x GROUP BY r),
f AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, id, n FROM h) x GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c ON d.r = c.r LEFT JOIN f ON d.r = f.r
"""

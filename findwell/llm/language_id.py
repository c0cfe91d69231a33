"""Language identification by interpolated Kneser-Ney models over characters.

One model for each language, of order five, over lower-case letters and single
spaces. Runs of characters of all languages are kept in one sorted array of
hashes per order with a column of log probabilities for each language, so one
binary search serves all of them; where a run is unknown, the next shorter one is
searched and the context's back-off weights are added. The language is that of
the lowest cross-entropy per character.

A text is rejected if no learnt language explains its words: each different word
costs what it costs in the language that fits it best, so texts that mix learnt
languages stay, and so does one that says a rare word a thousand times. The limit of
that cost per character is calibrated on pieces of like length of held-back texts:
somewhat beyond the largest cost that any of them has.
No other texts are looked at for it.

The models learn from `per_language` whole texts of each language at most, picked
by a hash of id and text; that is the bound of the sample. Every text is scored
whole.

Defined results: null texts and such without a letter are `und`, score 0,
rejected. Rows without a language or text teach nothing but are scored; rows with a
null id teach where `learn` is true for them; equal rows teach once. With nothing to
learn from all texts are `und`. Equal cross-entropies give the first language in
sorted order. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findwell.llm._arrow import bounded_batches, chunks
from findwell.llm._chars import _BASE, rolling, stream
from findwell.llm._labelled import by_class, draw, share
from findwell.llm._split import remainder
from findwell.session import saved

ORDER = 5
#: Texts of a language that are learnt from at most; a fifth of them only calibrate.
PER_LANGUAGE = 400
#: How far beyond the costs of held-back pieces the limit lies, as a part of what lies between their median and their largest.
MARGIN = 0.5
#: Lengths in characters for which limits are calibrated.
LENGTHS = tuple(8 << k for k in range(10))
#: Characters that count at most for how sure a prediction is.
SURE_CHARS = 60
UNKNOWN = "und"


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.full(len(keys), -1, np.int64)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return np.where(table[at] == keys, at, -1)


class KneserNey:
    """Models of several languages in shared sorted hash arrays."""

    def __init__(self, texts: dict[str, list[str]], order: int = ORDER):
        self.languages, self.order = sorted(texts), order
        if not texts:
            return
        held = [x for t in texts.values() if len(t) >= 10 for x in t[::5]]
        self._learn({n: [x for k, x in enumerate(t) if len(t) < 10 or k % 5] for n, t in texts.items()})
        self._calibrate(held)

    def _learn(self, texts: dict[str, list[str]], piece: int = 1 << 20) -> None:
        order, languages = self.order, self.languages
        chars, owner, counts = stream([t for n in languages for t in texts[n]])
        of = np.repeat(np.arange(len(languages), dtype=np.int16), [len(texts[n]) for n in languages])[owner]
        del owner
        counts[:order] = False
        n_lang, pieces = len(languages), range(order, len(chars), piece)
        self.tables: list[np.ndarray] = []
        suffix: list = [None] * (order + 1)
        context: list = [None] * (order + 1)
        h, power = np.zeros(len(chars), np.uint64), 1
        for k in range(order + 1):
            if k:
                power = power * _BASE % (1 << 64)
                shorter, h = h, h.copy()
                h[k - 1 :] += (chars[: max(0, len(chars) - k + 1)] + np.uint64(1)) * np.uint64(power)
            # distinct runs and where each occurs first, a piece at a time
            found = [np.unique(h[a : a + piece], return_index=True) for a in pieces]
            table, first = np.unique(np.concatenate([np.empty(0, np.uint64), *(t for t, _ in found)]), return_index=True)
            first = np.concatenate([np.empty(0, np.int64), *(f + a for (_, f), a in zip(found, pieces))])[first]
            self.tables.append(table)
            if k:
                suffix[k] = _find(self.tables[k - 1], shorter[first])
                # contexts end a place earlier; those before the first valid place are all pads
                context[k] = _find(self.tables[k - 1], shorter[first - 1])
        top = np.zeros((n_lang, len(self.tables[order])), np.int64)
        for a in pieces:
            seen = a + np.flatnonzero(counts[a : a + piece])
            np.add.at(top, (of[seen], _find(self.tables[order], h[seen])), 1)
        del h, chars, counts
        self.logp = [np.zeros((len(t), n_lang), np.float32) for t in self.tables]
        self.backoff = [np.zeros((len(t), n_lang), np.float32) for t in self.tables]
        for lang in range(n_lang):
            count: list = [None] * (order + 1)
            count[order] = top[lang]
            for k in range(order - 1, 0, -1):
                count[k] = np.bincount(suffix[k + 1][count[k + 1] > 0], minlength=len(self.tables[k]))
            p = np.full(1, 1.0 / (len(self.tables[1]) + 1))
            self.logp[0][:, lang] = np.log2(p)
            for k in range(1, order + 1):
                c, ctx = count[k], np.maximum(context[k], 0)
                once, twice = (c == 1).sum(), (c == 2).sum()
                discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.1
                total = np.bincount(ctx, weights=c, minlength=len(self.tables[k - 1]))
                kinds = np.bincount(ctx[c > 0], minlength=len(self.tables[k - 1]))
                spare = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
                p = np.maximum(c - discount, 0) / np.maximum(total[ctx], 1) + spare[ctx] * p[suffix[k]]
                self.backoff[k - 1][:, lang] = np.log2(spare)
                self.logp[k][:, lang] = np.log2(p)

    def word_costs(self, texts: list[str], size: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, characters with the blank after it, code length in each language) of every word, in order."""
        order = self.order
        chars, owner, counts = stream(texts)
        counts[:order] = False
        ends = counts & (chars == 32)
        word = np.cumsum(ends) - ends
        cost = np.zeros((int(ends.sum()), len(self.languages)), np.float32)
        for a in range(0, len(chars), size):
            lead = min(a, order + 1)
            hashes = rolling(chars[a - lead : a + size], order)
            at = lead + np.flatnonzero(counts[a : a + size])
            if not len(at):
                continue
            logp = np.zeros((len(at), len(self.languages)), np.float32)
            todo = np.arange(len(at))
            for k in range(order, -1, -1):
                found = _find(self.tables[k], hashes[k][at[todo]])
                hit = found >= 0
                logp[todo[hit]] -= self.logp[k][found[hit]]
                todo = todo[~hit]
                if not len(todo):
                    break
                context = _find(self.tables[k - 1], hashes[k - 1][at[todo] - 1])
                known = context >= 0
                logp[todo[known]] -= self.backoff[k - 1][context[known]]
            own = word[a - lead + at]
            begins = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            cost[own[begins]] += np.add.reduceat(logp, begins, axis=0)
        return owner[ends], np.bincount(word[counts], minlength=len(cost)), cost

    def bits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Code lengths (text x language) and characters of each text; and of its different words, each in the language that fits it best, code lengths and characters."""
        owner, chars, cost = self.word_costs(texts)
        total = np.zeros((len(texts), len(self.languages)))
        begins = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]][: len(owner)])
        if len(begins):
            total[owner[begins]] = np.add.reduceat(cost, begins, axis=0, dtype=np.float64)
        n = np.bincount(owner, weights=chars, minlength=len(texts)).astype(np.int64)
        once, low = self._different(owner, cost)
        return total, n, np.bincount(owner[once], weights=low, minlength=len(texts)), np.bincount(owner[once], weights=chars[once], minlength=len(texts)).astype(np.int64)

    @staticmethod
    def _different(owner: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first of each word in each text, told by its least code length, and that length. A word said again tells nothing new."""
        low = cost.min(1) if len(cost) else np.empty(0, np.float32)
        _, first = np.unique(owner.astype(np.int64) << 32 | low.view(np.uint32).astype(np.int64), return_index=True)
        first.sort()
        return first, low[first]

    def _calibrate(self, texts: list[str], least_texts: int = 20) -> None:
        """Limits of the cost per character for texts whose different words have each of LENGTHS and more."""
        self.limits = np.full(len(LENGTHS), np.inf)
        owner, chars, cost = self.word_costs(texts)
        once, low = self._different(owner, cost)
        owner, chars = owner[once], chars[once]
        at, spent = np.r_[0, np.cumsum(chars)], np.r_[0, np.cumsum(low, dtype=np.float64)]
        last = np.searchsorted(owner, owner, side="right")
        for k, length in enumerate(LENGTHS):
            # pieces of whole words that begin at any word
            to = np.searchsorted(at, at[:-1] + length)
            own = np.flatnonzero(to <= last)
            if len(np.unique(owner[own])) < least_texts:
                # longer pieces differ less, so what holds for shorter ones is no stricter
                self.limits[k:] = self.limits[k - 1] if k else np.inf
                break
            each = (spent[to[own]] - spent[own]) / (at[to[own]] - at[own])
            middle, most = np.median(each), each.max()
            self.limits[k] = most + MARGIN * (most - middle)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, bits per character, rejected) of each text."""
        if not self.languages:
            none = np.zeros(len(texts))
            return [UNKNOWN] * len(texts), none, none, np.ones(len(texts), bool)
        total, n, explained, told = self.bits(texts)
        each = total / np.maximum(n, 1)[:, None]
        explained = explained / np.maximum(told, 1)
        best = each.argmin(1)
        low = each.min(1)
        odds = np.exp2(-(each - low[:, None]) * np.minimum(n, SURE_CHARS)[:, None])
        limit = np.r_[np.inf, self.limits][np.searchsorted(LENGTHS, told, side="right")]
        rejected = (explained > limit) | (n == 0)
        score = np.where(n == 0, 0.0, odds.max(1) / odds.sum(1) * np.where(rejected, 0.5, 1.0))
        return [self.languages[b] if m else UNKNOWN for b, m in zip(best.tolist(), n.tolist())], score, low, rejected


def sample_by_language(docs: DataFrame, where: Column, per_language: int = PER_LANGUAGE, seed: int = 1) -> dict[str, list[str]]:
    """Up to `per_language` different rows' texts of each language, those of the least hashes of id and text."""
    rows = docs.where(where & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    # a share somewhat above the bound, then exactly the bound, by the same hash
    number = draw(F.lit(seed), F.col("doc_id"), F.col("text"))
    picked = rows.withColumn("draw", number).where(F.col("draw") < by_class("lang", {n: share(per_language, k) for n, k in counts.items()}))
    once = saved(picked.groupBy("lang", "draw").agg(F.first("text").alias("text")).orderBy("lang", "draw"), "language-sample")
    out: dict[str, list[str]] = {}
    for row in once.toLocalIterator():
        own = out.setdefault(row["lang"], [])
        if len(own) < per_language:
            own.append(row["text"])
    return out


def identify(docs: DataFrame, learn: Column | None = None, per_language: int = PER_LANGUAGE, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang_pred, score, bits (per character), rejected. `learn` says which rows teach, by their doc_id."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    model = KneserNey(sample_by_language(rows, F.lit(True) if learn is None else learn, per_language), order)
    return identify_with(rows, model)


def identify_with(rows: DataFrame, model: KneserNey) -> DataFrame:
    """The same with a model at hand, for rows (doc_id, text); doc_id may be of any type, a struct of a row's columns too."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType)]).add("lang_pred", "string").add("score", "double").add("bits", "double").add("rejected", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=1 << 19):
            lang, score, low, rejected = sent.value.predict([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(low), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "bits", "rejected"])

    return rows.select("doc_id", "text").mapInArrow(run, schema)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, learn=remainder("doc_id", 5) != 0)
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")

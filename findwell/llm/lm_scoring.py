"""Language-model scores of whole texts.

Documents are dealt into blocks by a hash of the row, equal rows numbered; a block
holds a bounded amount of text. Each block sends the distinct words it has with their
counts in training texts; counts are summed over all training documents and come back
to the blocks that asked, so no task holds the vocabulary of the corpus. A block's
words with their corpus counts then meet its documents.

The model mixes three distributions over the next word or the end: the corpus counts
of all training documents, the counts of the text so far, and a causal self-attention
model over subword ids (`attention`), which spells any word. A word is spelled when its symbols have come
and the next one begins a word or ends the text, so the probabilities of all words
and the end add up to one. Windows overlap, and each subword is scored once. Several
fixed weights of the mixture are averaged per text in the Bayesian way: the result is
the probability of the whole text's words and its end.

The attention model's weights begin on `train_docs` whole training documents, picked
by a hash of the row, and then learn from every window of all training documents:
in rounds, parts of about equal size train copies of the model, whose weights are
averaged by their windows. Steps are in proportion to the text. The symbols are the
most frequent subwords of all training documents.

Defined results: null and empty texts have one token, the end. Without training
documents train_tokens is 0, base_score is that of the formula with N = V = 0, and
the attention model is as it begins. A row with a null id is held by the rule for
empty id text; repeated rows return one row each; other columns are ignored.
"""

from __future__ import annotations

import base64
import copy
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findwell.llm._arrow import as_bytes, bounded_batches, chunks
from findwell.llm._labelled import draw, share
from findwell.llm._rows import numbered
from findwell.llm._split import remainder
from findwell.llm.attention import SYMBOLS, WIDE, Attention
from findwell.session import saved

#: Bytes of text of a block, about; small inputs have smaller ones, so that all cores have work.
BLOCK_BYTES, LEAST_BLOCK_BYTES = 14_000_000, 1_000_000
#: Training documents and steps that the attention model's weights begin with.
TRAIN_DOCS = 1_500
STEPS = 700
#: Rounds in which all training documents are learnt from, bytes of text that train one copy, copies averaged in one task.
ROUNDS, PART_BYTES, FAN = 4, 4_000_000, 32
RATE = 0.003
#: Weights of the corpus counts and of the text's own counts in the mixtures that are averaged; the attention model has the rest.
MIXTURES = tuple((a, b) for a in (0.05, 0.2, 0.4, 0.6) for b in (0.02, 0.1, 0.25))
_BYTES = 256


class Subwords:
    """Symbols of words: frequent subword ids of a public vocabulary, and bytes for the others.

    Symbol 0 ends a text. Symbols that begin a word (a blank, and subwords with a
    blank in front) fill the first `openers` classes, all others come after these.
    """

    def __init__(self, path: str, pattern: str, kept: list[int] = ()):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        raw = {v: k for k, v in ranks.items()}
        n = max(raw) + 1
        self.opens = np.zeros(n, bool)
        self.opens[[i for i, r in raw.items() if r[:1] == b" "]] = True
        openers, others = [i for i in kept if self.opens[i]], [i for i in kept if not self.opens[i]]
        self.openers = -(-(2 + len(openers)) // WIDE)
        first = self.openers * WIDE
        of_byte = np.empty(_BYTES, np.uint16)
        of_byte[:32], of_byte[32], of_byte[33:] = first + np.arange(32), 1, first + np.arange(32, _BYTES - 1)
        own = {i: [2 + k] for k, i in enumerate(openers)} | {i: [first + _BYTES - 1 + k] for k, i in enumerate(others)}
        symbols = [own.get(i) or of_byte[list(raw.get(i, b""))] for i in range(n)]
        self.sizes = np.fromiter(map(len, symbols), np.int64, n)
        self.flat = np.concatenate(symbols).astype(np.uint16)
        self.begins = np.cumsum(self.sizes) - self.sizes

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Subword ids of words end to end, and how many each has."""
        ids, sizes = [], []
        for a in range(0, len(words), 20_000):
            part = words[a : a + 20_000]
            # no subword spans a blank, so words can be taken together
            own = np.array(self.encoding.encode_ordinary(" " + " ".join(part)), np.int64)
            begins = np.flatnonzero(self.opens[own])
            if len(begins) == len(part) and begins[0] == 0:
                size = np.diff(np.r_[begins, len(own)])
            else:
                each = [self.encoding.encode_ordinary(" " + w) for w in part]
                own, size = np.array([i for e in each for i in e], np.int64), np.fromiter(map(len, each), np.int64, len(each))
            ids.append(own)
            sizes.append(size)
        return (np.concatenate(ids), np.concatenate(sizes)) if ids else (np.empty(0, np.int64), np.empty(0, np.int64))

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words end to end, and how many each has."""
        ids, sizes = self.ids(words)
        n = self.sizes[ids]
        stop = np.cumsum(n)
        flat = self.flat[np.repeat(self.begins[ids] - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)].astype(np.int64)
        upto = np.r_[0, stop][np.r_[0, np.cumsum(sizes)]]
        return flat, np.diff(upto)


_SUBWORDS: dict[tuple, Subwords] = {}


def _subwords(path: str, pattern: str, kept: tuple[int, ...]) -> Subwords:
    key = (path, kept)
    if key not in _SUBWORDS:
        _SUBWORDS.clear()
        _SUBWORDS[key] = Subwords(path, pattern, list(kept))
    return _SUBWORDS[key]


class Spelling:
    """Symbols of a vocabulary's words, and of the end after them."""

    def __init__(self, words: list[str], subwords: Subwords):
        flat, sizes = subwords.symbols(words)
        self.end = len(words)
        self.flat, self.sizes = np.r_[flat, 0], np.r_[sizes, 1]
        self.begins = np.cumsum(self.sizes) - self.sizes

    def spell(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of words (by number) end to end, and where each word begins."""
        size = self.sizes[index]
        first = np.cumsum(size) - size
        return self.flat[np.repeat(self.begins[index] - first, size) + np.arange(first[-1] + size[-1])], first


def words_of(text: bytes) -> list[bytes]:
    """Lower-case A-Z and split at ASCII white space."""
    return text.lower().split()


def subword_counts(corpus: DataFrame, path: str, pattern: str) -> dict[int, int]:
    """Occurrences of each subword id in the words (word, c)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _subwords(path, pattern, ())
        seen = np.zeros(len(own.opens), np.int64)
        for batch in batches:
            ids, sizes = own.ids(batch.column(0).to_pylist())
            np.add.at(seen, ids, np.repeat(batch.column(1).to_numpy(), sizes))
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(seen[found])], names=["id", "c"])

    return dict(map(tuple, corpus.select("word", "c").mapInArrow(run, "id bigint, c bigint").groupBy("id").agg(F.sum("c")).collect()))


def _packed(texts: list[bytes], subwords: Subwords) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of texts end to end, and their numbers."""
    if not texts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    place: defaultdict[bytes, int] = defaultdict()
    place.default_factory = place.__len__
    index = []
    for t in texts:
        index.extend(map(place.__getitem__, words_of(t)))
        index.append(-1)
    spelling = Spelling([w.decode() for w in place], subwords)
    index = np.array(index)
    ends = np.flatnonzero(index < 0)
    index[ends] = spelling.end
    symbols, first = spelling.spell(index)
    return symbols, np.diff(np.r_[0, np.r_[first[1:], len(symbols)][ends]])


def _mean(parts: list[tuple[int, int, bytes]]) -> tuple[int, bytes]:
    """Windows and mean weights of (part, windows, weights), in the order of the parts."""
    n = sum(x[1] for x in parts)
    total = sum(np.frombuffer(x[2], np.float32).astype(np.float64) * (x[1] / max(n, 1)) for x in sorted(parts))
    return n, total.astype(np.float32).tobytes()


def train_everywhere(rows: DataFrame, model: Attention, kept: tuple[int, ...], path: str, pattern: str, rounds: int = ROUNDS, part_bytes: int = PART_BYTES) -> int:
    """Trains `model` on every window of rows (text, row, nth) once; returns the number of windows."""
    spark = rows.sparkSession
    n_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_parts = max(1, -(-n_bytes // (rounds * part_bytes)))
    shapes = [(n, v.shape, v.size) for n, v in model.p.items()]
    seen = 0
    for turn in range(rounds):
        rate = RATE * (1 - 0.9 * turn / rounds)
        sent = spark.sparkContext.broadcast(model)

        def train(batches: Iterator[pa.RecordBatch], sent=sent, rate=rate) -> Iterator[pa.RecordBatch]:
            part, own, state, windows = None, None, None, 0
            subwords = _subwords(path, pattern, kept)

            def row():
                if part is not None:
                    weights = b"".join(own.p[n].astype(np.float32).tobytes() for n, _, _ in shapes)
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([windows], pa.int64()), pa.array([weights], pa.binary())], names=["part", "windows", "weights"])

            for batch in chunks(batches):
                of = batch.column(1).to_numpy()
                cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
                texts = as_bytes(batch.column(0))
                for a, b in zip(cuts, cuts[1:]):
                    if of[a] != part:
                        yield from row()
                        part, own, windows = int(of[a]), copy.deepcopy(sent.value), 0
                        state = own.moments()
                    windows += own.train_all(*_packed(texts[a:b], subwords), state, rate)
            yield from row()

        def average(table: pa.Table) -> pa.Table:
            n, weights = _mean(list(zip(*(table[c].to_pylist() for c in ("part", "windows", "weights")))))
            return pa.table({"part": pa.array([min(table["part"].to_pylist())], pa.int64()), "windows": pa.array([n], pa.int64()), "weights": pa.array([weights], pa.binary())})

        own = rows.where(F.pmod(F.xxhash64(F.lit(3), "row", "nth"), F.lit(rounds)) == turn)
        dealt = own.select(F.coalesce("text", F.lit("")).alias("text"), F.pmod(F.xxhash64(F.lit(4), "row", "nth"), F.lit(n_parts)).alias("part"), F.xxhash64("row", "nth").alias("place"))
        ways = max(1, min(n_parts, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        trained = dealt.repartition(ways, "part").sortWithinPartitions("part", "place").drop("place").mapInArrow(train, "part bigint, windows bigint, weights binary")
        if n_parts > FAN:
            trained = trained.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(average, "part bigint, windows bigint, weights binary")
        found = [tuple(r) for r in trained.collect()]
        if found:
            n, weights = _mean(found)
            seen += n
            flat, at = np.frombuffer(weights, np.float32), 0
            for name, shape, size in shapes:
                model.p[name] = flat[at : at + size].reshape(shape).copy()
                at += size
        sent.destroy()
    return seen


def fit_attention(rows: DataFrame, n: int, path: str, pattern: str, corpus: DataFrame, train_docs: int = TRAIN_DOCS, steps: int = STEPS) -> tuple[tuple[int, ...], Attention]:
    """(subword ids kept as symbols, model) of n training rows (text, row, nth), begun on a sample and learnt from all; their words are `corpus`."""
    counts = subword_counts(corpus, path, pattern)
    # by count, then by id, so that equal counts give equal models; up to a class is left open before the other symbols
    kept = tuple(i for i, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: SYMBOLS - 1 - _BYTES - (WIDE - 1)])
    own = Subwords(path, pattern, list(kept))
    of_symbols = np.zeros(SYMBOLS)
    of_symbols[0] = n
    for i, c in sorted(counts.items()):
        np.add.at(of_symbols, own.flat[own.begins[i] : own.begins[i] + own.sizes[i]], c)
    number = draw(F.lit(9), F.col("row"), F.col("nth"))
    picked = rows.withColumn("draw", number).where(F.col("draw") < share(train_docs, n)).select("draw", F.coalesce("text", F.lit("")).alias("text"))
    texts = []
    for r in picked.toLocalIterator():
        symbols, _ = _packed([r["text"].encode()], own)
        texts.append((r["draw"], symbols.astype(np.uint16).tobytes()))
    texts = [np.frombuffer(t, np.uint16) for _, t in sorted(texts)[:train_docs]]
    model = Attention(of_symbols, dim=24, inner=48, stride=24, openers=own.openers)
    model.train(np.concatenate([np.empty(0, np.uint16), *texts]).astype(np.int64), np.array([len(t) for t in texts], np.int64), steps)
    train_everywhere(rows, model, kept, path, pattern)
    return kept, model


def spelled(model: Attention, symbols: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Natural log probability of each word, or end, given what precedes it.

    first: where words begin; last: which of them are ends of texts. The symbol after
    a word must begin a word too, which is part of the word's probability.
    """
    ends = np.r_[first[1:], len(symbols)][last]
    lp, opens = model.log_probs(symbols, np.diff(np.r_[0, ends]))
    opens = opens[first].astype(np.float64)
    return np.add.reduceat(lp.astype(np.float64), first) - opens + np.where(last, 0.0, np.r_[opens[1:], 0.0])


def _so_far(index: np.ndarray, n: np.ndarray, begin: np.ndarray, share_of: np.ndarray) -> np.ndarray:
    """Share of each word (by number) among those before it in its text; the first of a text has its corpus share."""
    text = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(index)) - begin[text]
    key = text * (len(share_of) + 1) + index
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.r_[True, key[order[1:]] != key[order[:-1]]])
    before = np.empty(len(key), np.int64)
    before[order] = np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)]))
    return np.where(place > 0, before / np.maximum(place, 1), share_of[index])


def score_block(texts: list[bytes], words: list[str], counts: np.ndarray, total: int, ends: int, distinct: int, subwords: Subwords, model: Attention, most: int = 60_000):
    """(n_tokens, n_known, base, score) of texts whose words are all in `words`, with their corpus counts.

    total, ends, distinct: all training tokens, training texts, distinct training tokens.
    """
    place = {w.encode(): k for k, w in enumerate(words)}
    counts = np.append(counts, ends)
    spelling = Spelling(words, subwords)
    base_of = np.log10((counts + 1) / (total + 1 * (distinct + 1)))
    share_of = counts / max(total, 1)
    end = len(words)
    out, indices, held = [], [], 0

    def flush():
        nonlocal indices, held
        if not indices:
            return
        n = np.fromiter(map(len, indices), np.int64, len(indices))
        index = np.concatenate(indices)
        begin = np.cumsum(n) - n
        word = spelled(model, *spelling.spell(index), index == end)
        corpus, own = share_of[index], _so_far(index, n, begin, share_of)
        known = corpus + own > 0
        chance, mixed = np.exp(word), []
        for a, b in MIXTURES:
            total_chance = a * corpus
            total_chance += b * own
            total_chance += (1 - a - b) * chance
            # a long word that nothing else knows has no chance in double precision, but a logarithm
            mixed.append(np.add.reduceat(np.where(known, np.log(np.maximum(total_chance, 1e-300)), word + np.log(1 - a - b)), begin))
        score = np.minimum((np.logaddexp.reduce(mixed, axis=0) - np.log(len(MIXTURES))) / np.log(10), 0.0)
        base = np.add.reduceat(base_of[index], begin)
        out.append((n, np.add.reduceat((counts[index] > 0).astype(np.int64), begin), base, score))
        indices, held = [], 0

    for text in texts:
        own = words_of(text)
        index = np.empty(len(own) + 1, np.int64)
        index[:-1] = np.fromiter(map(place.__getitem__, own), np.int64, len(own))
        index[-1] = end
        indices.append(index)
        held += len(index)
        if held >= most:
            flush()
    flush()
    return [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0)] * 4


def lm_scores(docs: DataFrame, learn: Column, path: str, pattern: str, block_bytes: int = BLOCK_BYTES, train_docs: int = TRAIN_DOCS, steps: int = STEPS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score. `learn` says which rows teach, by their doc_id."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = numbered(docs.select("doc_id", "text"), F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull(), "text"), "row", "nth")
    teaches = F.coalesce(learn, F.lit(False))
    n_bytes, n_train = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.when(learn, 1))).first()
    n_blocks = max(1, -(-n_bytes // block_bytes), min(2 * spark.sparkContext.defaultParallelism, -(-n_bytes // LEAST_BLOCK_BYTES)))
    parts = max(1, min(n_blocks, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    keyed = rows.select("doc_id", "text", teaches.alias("teaches"), F.pmod(F.xxhash64("row", "nth"), F.lit(n_blocks)).alias("block"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, seen = None, {}

        def rows():
            names = list(seen)
            for a in range(0, len(names), 50_000):
                part = names[a : a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(part), pa.int64()), pa.array(part, pa.binary()).cast(pa.string()), pa.array([seen[w] for w in part], pa.int64())], names=["block", "word", "n"])

        for batch in chunks(batches):
            for text, teaches, b in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if b != block:
                    yield from rows()
                    block, seen = b, {}
                for w, n in Counter(words_of(text)).items():
                    seen[w] = seen.get(w, 0) + (n if teaches else 0)
        yield from rows()

    asked = keyed.select("text", "teaches", "block").repartition(parts, "block").sortWithinPartitions("block").mapInArrow(count, "block bigint, word string, n bigint")
    asked = saved(asked, "block-words")
    # a word has a row for each block at most; sums start before the shuffle
    corpus = asked.where("n > 0").groupBy("word").agg(F.sum("n").alias("c"))
    corpus = saved(corpus, "corpus-counts")
    n_words, n_distinct = corpus.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, distinct = n_words + n_train, n_distinct + (n_train > 0)
    kept, model = fit_attention(rows.where(teaches).select("text", "row", "nth"), n_train, path, pattern, corpus, train_docs, steps)
    answers = asked.drop("n").join(corpus, "word", "left").select("block", "word", F.coalesce("c", F.lit(0)).alias("c"))
    sent = spark.sparkContext.broadcast((kept, model))

    def score(key, left: pa.Table, right: pa.Table) -> pa.Table:
        kept, model = sent.value
        texts = as_bytes(left["text"].combine_chunks()) if left.num_rows else []
        names = right["word"].to_pylist()
        n, known, base, s = score_block(texts, names, right["c"].to_numpy().astype(np.int64), total, n_train, distinct, _subwords(path, pattern, kept), model)
        return pa.table({"doc_id": left["doc_id"], "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(known, pa.int64()), "train_tokens": pa.array(np.full(len(texts), total), pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(s, pa.float64())})

    left = keyed.select("doc_id", "text", "block").groupBy("block")
    return left.cogroup(answers.groupBy("block")).applyInArrow(score, f"doc_id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def op3_lm_scoring(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = lm_scores(docs, remainder("doc_id", 7) != 2, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    return out.select("doc_id", (remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

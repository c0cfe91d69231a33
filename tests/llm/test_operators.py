"""The training-data operators against brute force, held-out accuracy and odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from findwell.llm import audio_fingerprint, decontamination, language_id, lm_scoring, mixing, quality, simhash, suffix_dedup, toxicity
from findwell.llm._split import remainder
from findwell.llm.queries import ORACLE_SQL, QUERIES
from tests.harness import connect, rows_of_spark, rows_of_sql

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row string"
ODD = [
    (1, "The red fox and the dog", "en", "a", 1, 0.5, "x"),
    (1, "The red fox and the dog", "en", "a", 1, 0.5, "x"),
    (2, None, None, None, None, None, None),
    (3, "", "en", "a", 0, 0.0, ""),
    (None, "12 34 !!", None, "b", 3, 1.0, "y"),
    (4, "x " * 60_000, "en", "b", 9, 1.0, "y"),
    (5, "é\x00 ß <|endoftext|> Ünï", "de", "b", 9, 1.0, "y"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def texts_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, small, name):
    assert rows_of_spark(QUERIES[name](spark, small)) == rows_of_sql(connect(small), ORACLE_SQL[name])


# 1 ----------------------------------------------------------------------------


def test_language_of_held_out_documents(spark, small, docs):
    out = QUERIES["op1_language_id"](spark, small).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.98
    assert not out.rejected.any() and out.score.between(0, 1).all()


def test_kneser_ney_sums_to_one():
    from findwell.llm._chars import _BASE

    model = language_id.KneserNey({"a": ["abab abba baab aabb ab ba cab"], "b": ["bbb aba"]}, order=3)
    letters = [ord(c) for c in "abc "] + [ord("z")]
    ones = {c: (c + 1) * _BASE % 2**64 for c in letters}
    at = {c: int(np.searchsorted(model.tables[1], np.uint64(h))) for c, h in ones.items() if np.uint64(h) in model.tables[1]}
    assert len(at) == 4 and len(model.tables[1]) == 4
    for lang in range(2):
        p1 = {c: 2.0 ** (model.logp[1][at[c], lang] if c in at else model.backoff[0][0, lang] + model.logp[0][0, lang]) for c in letters}
        assert sum(p1.values()) == pytest.approx(1, abs=1e-5)
        for h in at:
            total = 0.0
            for c in letters:
                pair = np.uint64(((c + 1) * _BASE + (h + 1) * _BASE * _BASE) % 2**64)
                k = int(np.searchsorted(model.tables[2], pair))
                known = k < len(model.tables[2]) and model.tables[2][k] == pair
                total += 2.0 ** model.logp[2][k, lang] if known else 2.0 ** model.backoff[1][at[h], lang] * p1[c]
            assert total == pytest.approx(1, abs=1e-5)


def test_kneser_ney_by_brute_force():
    texts = {"a": ["abab abba baab", "aabb, ab ba cab!"], "b": ["bbb aba", "Babb ab"]}
    order = 3
    model = language_id.KneserNey(texts, order=order)

    def chars(text):
        return " " * 8 + "".join(w + " " for w in re.findall("[a-z]+", text.lower()))

    def probability(lang):
        runs = Counter(c[e - order : e] for c in map(chars, texts[lang]) for e in range(9, len(c) + 1))
        levels = {order: runs}
        for k in range(order - 1, 0, -1):
            levels[k] = Counter(r[1:] for r in levels[k + 1])

        def p(run):
            k = len(run)
            if not k:
                return 1 / (len("abc ") + 1)
            c = levels[k]
            once, twice = (sum(v == n for v in c.values()) for n in (1, 2))
            discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.1
            same = {r: n for r, n in c.items() if r[:-1] == run[:-1]}
            if not same:
                return p(run[1:])
            total = sum(same.values())
            return max(c[run] - discount, 0) / total + discount * len(same) / total * p(run[1:])

        return p

    for text in ("ab cab", "zb", "Bab! aabb", "c"):
        total, n, explained, told = model.bits([text, "ab"])
        assert told[0] == n[0]
        c, cost = chars(text), []
        for p in map(probability, model.languages):
            each = [-math.log2(p(c[e - order : e])) for e in range(9, len(c) + 1)]
            ends = [0, *(e - 8 for e in range(9, len(c) + 1) if c[e - 1] == " ")]
            cost.append([sum(each[a:b]) for a, b in zip(ends, ends[1:])])
        assert n[0] == len(c) - 8
        assert total[0] == pytest.approx([sum(x) for x in cost], rel=1e-4)
        assert explained[0] == pytest.approx(sum(map(min, *cost)), rel=1e-4)


def test_texts_in_no_learnt_language_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(remainder("doc_id", 5) != 0)
    model = language_id.KneserNey(language_id.sample_by_language(docs, F.lit(True), 100))
    rng = random.Random(1)
    noise = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 9))) for _ in range(60))
    foreign = [
        "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura che la diritta via era smarrita",
        "Vaka vanha Väinämöinen itse tuon sanoiksi virkkoi näistä kantele tulisi soitto suoreaisi kansojen keskessä",
        "Мороз и солнце день чудесный еще ты дремлешь друг прелестный пора красавица проснись",
        "".join(chr(0x4E00 + 17 * k) for k in range(90)), noise, noise[:60],
    ]
    assert model.predict(foreign)[3].all()
    held = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where((remainder("doc_id", 5) == 0) & F.col("text").isNotNull()).collect()]
    mixed = [a[:200] + " " + b[:200] for a, b in zip(held, reversed(held))]
    assert not model.predict(held)[3].any() and not model.predict(mixed)[3].any()
    # one word over and over is no more than one word
    few, many = ([f"{w} " * n for h in held[:60] for w in h.split()[:2]] for n in (3, 3000))
    assert (model.predict(many)[3] == model.predict(few)[3]).all()
    # nothing is known about texts of a few letters
    assert not model.predict(["xqz"])[3].any()
    # long texts in pieces
    long = " ".join(held[:40])
    whole = model.word_costs([long])
    for got, want in zip(model.word_costs([long], size=1000), whole):
        assert got == pytest.approx(want, abs=1e-3)


def test_bits_do_not_depend_on_neighbours():
    model = language_id.KneserNey({"a": ["abab abba"], "b": ["bbb aba"]}, order=3)
    texts = ["ab", "", "12", "b a.", "aab"]
    whole = model.bits(texts)[0]
    assert whole == pytest.approx(np.concatenate([model.bits([t])[0] for t in texts]), abs=1e-4)


def test_language_of_odd_rows(odd, none):
    got = {r["doc_id"]: r for r in language_id.identify(odd).collect()}
    assert got[2]["lang_pred"] == got[3]["lang_pred"] == got[None]["lang_pred"] == "und"
    assert got[2]["score"] == 0 and got[2]["rejected"] and got[1]["lang_pred"] in ("en", "de")
    assert language_id.identify(odd).count() == len(ODD)
    assert language_id.identify(none).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(odd, learn=F.lit(False)).collect()} == {"und"}


# 2 ----------------------------------------------------------------------------


def test_counts_equal_the_library(spark, small, docs, odd):
    lib = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    for got, df in ((QUERIES["op2_token_counts"](spark, small), docs), (None, odd)):
        from findwell.llm.token_counts import token_counts

        got = got if got is not None else token_counts(df, public.path("word_bpe_49k.json"), 2048)
        expected = sorted(((d, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 2048) for d, t in texts_of(df)), key=repr)
        assert as_rows(got) == expected


@pytest.mark.parametrize("text", ["", "unhappiness it's don't 'S", "ΣΑΣ οδος", "İstanbul I'll", "a<|endoftext|>b <|end", "éclair １２３ 日本語", "a b\x1cc\x85d", "😀👍🏽 ẞ ǅ", "n" * 70, "'re' 'r"])
def test_counts_at_every_prefix(text):
    from findwell.llm.token_counts import PrefixCounter

    own, lib = PrefixCounter(public.path("word_bpe_49k.json")), tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    expected = [len(lib.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
    assert own.at_prefixes(text) == expected
    assert len(own.truncate(text, 3)) == max(k for k, n in enumerate(expected) if n <= 3)


# 3 ----------------------------------------------------------------------------


def _scores(df, **more):
    return lm_scoring.lm_scores(df, remainder("doc_id", 7) != 2, public.path("byte_bpe_50k.tiktoken"), public.PATTERN, train_docs=60, steps=15, **more)


@pytest.mark.parametrize("blocks", [60_000, 10**9])
def test_base_score_by_brute_force(docs, odd, blocks):
    for df in (docs, odd):
        rows = {}
        for r in _scores(df, block_bytes=blocks).collect():
            rows.setdefault(r["doc_id"], r)
        words = [(d, re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) + [None]) for d, t in texts_of(df)]
        counts = Counter(w for d, ws in words if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2 for w in ws)
        n, v = sum(counts.values()), len(counts)
        for d, ws in words:
            r = rows[d]
            assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(counts[w] > 0 for w in ws), n)
            assert r["base_score"] == pytest.approx(math.fsum(math.log10((counts[w] + 1) / (n + 1 * (v + 1))) for w in ws), rel=1e-9)
            assert r["score"] <= 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_held_out_texts_score_above_the_base(spark, sf):
    got = QUERIES["op3_lm_scoring"](spark, sf).where("held_out").toPandas()
    assert got.score.sum() > got.base_score.sum()


def test_attention_gradients_and_single_scoring():
    from findwell.llm.attention import SYMBOLS, Attention

    rng = np.random.default_rng(0)
    model = Attention(np.ones(SYMBOLS), dim=4, inner=6, window=8, stride=5)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    inputs, targets = rng.integers(0, 40, (3, 8)), rng.integers(0, 40, (3, 8))
    wanted = rng.random((3, 8)) < 0.7
    _, grads = model.gradients(inputs, targets, wanted)
    for name in ("query", "key", "value", "out", "up", "down", "group", "near", "embed"):
        p = model.p[name]
        at = np.unravel_index(np.abs(grads[name]).argmax(), p.shape)
        keep = p[at]
        p[at] = keep + 1e-4
        up = model.gradients(inputs, targets, wanted)[0]
        p[at] = keep - 1e-4
        down = model.gradients(inputs, targets, wanted)[0]
        p[at] = keep
        assert grads[name][at] == pytest.approx((up - down) / 2e-4, rel=2e-2)
    # a symbol's probability depends on what precedes it only, whatever else is scored with it
    symbols, lengths = rng.integers(0, 99, 60), np.array([23, 0, 37])
    whole = model.log_probs(symbols, lengths)[0]
    assert whole == pytest.approx(np.concatenate([model.log_probs(symbols[:23], np.array([23]))[0], model.log_probs(symbols[23:], np.array([37]))[0]]), abs=1e-5)
    changed = symbols.copy()
    changed[10:23] = 5
    assert model.log_probs(changed, lengths)[0][:10] == pytest.approx(whole[:10], abs=1e-5)


def test_places_are_computed_once(monkeypatch):
    from findwell.llm.attention import SYMBOLS, Attention

    rng = np.random.default_rng(5)
    model = Attention(np.ones(SYMBOLS), dim=4, inner=6, window=8, stride=5)
    whole = Attention.gradients
    lengths = np.array([0, 1, 2, 3, 4, 8, 9, 13, 14, 400])
    symbols = rng.integers(0, 99, lengths.sum())
    text, begin, scored = model.windows(lengths)
    starts = (np.cumsum(lengths) - lengths)[text]
    seen = []

    def counted(self, inputs, targets, wanted, *more):
        seen.append(targets.size)
        loss, g = whole(self, inputs, targets, wanted, *more)
        # the same batch as whole windows, all places of which have a target
        inside = begin[:, None] + np.arange(8)
        limit = lengths[text][:, None]
        index = starts[:, None] + np.minimum(inside, limit - 1)
        previous = np.where(index == starts[:, None], 0, symbols[index - 1])
        same, by_windows = whole(self, previous, symbols[index], (inside >= scored[:, None]) & (inside < limit))
        assert loss == pytest.approx(same, rel=1e-5)
        for name, v in by_windows.items():
            assert g[name] == pytest.approx(v, abs=1e-5)
        return loss, g

    monkeypatch.setattr(Attention, "gradients", counted)
    assert model.train_all(symbols, lengths, model.moments(), 0.01, batch=len(text)) == len(text)
    # windows of 8 places for 5 new ones each took 1.6 places a symbol
    assert sum(seen) < 1.3 * len(symbols)


def test_learning_multiplies_what_depends_on_one_symbol_once():
    from findwell.llm.attention import SYMBOLS, Attention

    work = []

    class Counted(np.ndarray):
        def __array_ufunc__(self, ufunc, method, *inputs, out=(), **more):
            def plain(x):
                return x.view(np.ndarray) if isinstance(x, Counted) else x

            if out:
                more["out"] = tuple(map(plain, out))
            got = getattr(ufunc, method)(*map(plain, inputs), **more)
            if ufunc is np.matmul:
                work.append(np.size(got) * np.shape(inputs[0])[-1])
            return got.view(Counted) if isinstance(got, np.ndarray) else got

    rng = np.random.default_rng(6)
    model = Attention(np.ones(SYMBOLS), dim=24, inner=48, window=32, stride=24)
    model.p = {k: v.view(Counted) for k, v in model.p.items()}
    inputs = rng.integers(0, SYMBOLS, (96, 32))
    model.gradients(inputs, rng.integers(0, SYMBOLS, (96, 24)), np.ones((96, 24), bool), np.empty(0, np.int64))
    # with keys, values and queries of every place, and a product with "out" for each, 19,696 products a target are counted
    assert 15_000 < sum(work) / (96 * 24) < 18_000


def test_next_words_and_the_end_sum_to_one():
    from findwell.llm.attention import SYMBOLS, WIDE, Attention

    rng = np.random.default_rng(3)
    model = Attention(rng.random(SYMBOLS) * 9, dim=8, inner=8, window=8, stride=5, openers=2)
    openers, others = np.arange(1, 2 * WIDE), np.arange(2 * WIDE, SYMBOLS)
    context = [4, 80, 99, 7]  # two words

    def last_words(words):
        """The probability of each word, a row of symbols, after the context."""
        n, k = words.shape
        texts = np.c_[np.tile(context, (n, 1)), words, np.zeros((n, 1), np.int64)]
        first = (np.arange(n)[:, None] * (k + 5) + [0, 3, 4, 4 + k]).ravel()
        return np.exp(lm_scoring.spelled(model, texts.ravel(), first, np.tile([False, False, False, True], n)).reshape(n, 4)[:, 2])

    lp, opens = model.log_probs(np.array([*context, 0]), np.array([5]))
    the_end = np.exp(lp[4] - opens[4])
    one = last_words(openers[:, None])
    # of words that begin with a symbol, what one symbol leaves is what longer ones share
    texts = np.c_[np.tile(context, (len(openers), 1)), openers, np.zeros((len(openers), 1), np.int64)]
    lp, opens = (x.reshape(len(openers), 6) for x in model.log_probs(texts.ravel(), np.full(len(openers), 6)))
    begun = np.exp(lp[:, 4] - opens[:, 4])
    assert the_end + begun.sum() == pytest.approx(1, abs=1e-4)
    assert one == pytest.approx(begun * np.exp(opens[:, 5]), rel=1e-4)
    two = last_words(np.array([(s, c) for s in openers for c in others])).reshape(len(openers), -1).sum(1)
    assert (one + two < begun + 1e-6).all() and the_end + one.sum() + two.sum() <= 1


def test_counts_so_far():
    index, n = np.array([3, 3, 1, 3, 4, 1, 1, 4]), np.array([5, 3])
    got = lm_scoring._so_far(index, n, np.array([0, 5]), np.array([0, 0.2, 0, 0.5, 0.1]))
    assert got.tolist() == [0.5, 1.0, 0.0, 2 / 3, 0.0, 0.2, 1.0, 0.0]


def test_symbols_of_words_taken_together():
    from findwell.llm.attention import SYMBOLS, WIDE

    own = lm_scoring.Subwords(public.path("byte_bpe_50k.tiktoken"), public.PATTERN, [262, 290, 286, 1169, 276, 13, 11])
    words = ["the", "and", "x\u00a0", "\u00a0\u00a0y", "\u3000", "a\u00a0b", "don't", "'s", "1,2...", "\x1c\x1d", "日本", "é", "\x85"] * 3
    ids, sizes = own.ids(words)
    assert ids.tolist() == [i for w in words for i in own.encoding.encode_ordinary(" " + w)]
    symbols, n = own.symbols(words)
    first = np.cumsum(n) - n
    opens = symbols < own.openers * WIDE
    assert opens.nonzero()[0].tolist() == first.tolist() and symbols.max() < SYMBOLS and symbols.min() > 0
    # different words have different symbols
    seen = {tuple(symbols[a : a + k].tolist()): w for a, k, w in zip(first, n, words)}
    assert len(seen) == len(set(words))
    packed, lengths = lm_scoring._packed([b"the and the", b"", b"x"], own)
    assert packed[lengths.cumsum() - 1].tolist() == [0, 0, 0] and lengths.sum() == len(packed)
    assert lengths[1] == 1


def test_model_learns_from_all_training_documents(spark):
    rng = random.Random(4)

    def text(n):
        # too long to occur twice, so the corpus counts do not know a held-out word
        return " ".join("".join(rng.choice(("qzx", "vkj", "wqp")) for _ in range(25)) for _ in range(n))

    def scores(n):
        rows = [(1, text(60))] + [(10 + k, text(60)) for k in range(n)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        out = lm_scoring.lm_scores(df, F.col("doc_id") >= 10, public.path("byte_bpe_50k.tiktoken"), public.PATTERN, train_docs=1, steps=1)
        return out.where("doc_id = 1").first()

    # one document and one step begin the model in both cases
    few, many = scores(1), scores(400)
    assert few["n_known"] == many["n_known"] == 1
    assert many["score"] > 0.8 * few["score"]


def test_scores_of_nothing(none):
    assert _scores(none).count() == 0


# 4 ----------------------------------------------------------------------------


def _hits(docs, items, window=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))

    found = {}
    for i, t in items:
        w = words(t)
        m = min(window, len(w))
        for k in range(len(w) - m + 1 if w else 0):
            found.setdefault(m, {}).setdefault(tuple(w[k : k + m]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, its = words(t), set()
        hit = [False] * len(w)
        for m, table in found.items():
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in table:
                    its |= table[tuple(w[k : k + m])]
                    hit[k : k + m] = [True] * m
        out.append((d, len(w), sum(hit), len(its), hashlib.sha256(",".join(sorted(its)).encode()).hexdigest(), any(hit)))
    return sorted(out, key=repr)


ITEMS = [(10, "one two"), (11, "a b c a a a b c c a b"), (12, ""), (13, None), (14, "a b a b a b a b a b a b"), (15, "a b c"), (16, "é"), (2, "a a a a a a a a a a a"), (17, "b a a a a"), (18, "x x x x x x x x x x x x")]


@pytest.mark.parametrize("limit", [500_000, 0])
def test_contamination_by_brute_force(spark, odd, limit):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice("aab c") for _ in range(rng.randrange(60)))) for k in range(60)] + [(99, "One TWO three"), (100, "É")]
    for df in (spark.createDataFrame(rows, "doc_id long, text string"), odd.where("doc_id is not null and doc_id <> 1")):
        items = spark.createDataFrame(ITEMS, "item_id long, text string")
        got = decontamination.decontaminate(df, items, broadcast_words=limit)
        assert as_rows(got.drop("spans")) == _hits(texts_of(df), ITEMS)


def test_contamination_of_documents(spark, small, docs):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert as_rows(QUERIES["op4_benchmark_decontamination"](spark, small)) == _hits(texts_of(docs), items)


def test_contamination_of_nothing(spark, odd, none):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.decontaminate(odd, items).where("contaminated").count() == 0
    assert decontamination.decontaminate(none, spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


# 5 ----------------------------------------------------------------------------


def test_alignment_of_recordings(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=90)
    sound = audio_fingerprint.melody
    noisy = (np.frombuffer(sound(v), "<i2") + rng.normal(0, 1500, 90 * 256)).astype("<i2").tobytes()
    rows = [(0, sound(v)), (1, sound(v[20:])), (2, sound(v)), (20, sound(v[5:70])), (3, sound(rng.normal(size=80))), (4, None), (5, b""), (6, noisy), (7, b"\0" * 40_001)]
    prints = audio_fingerprint.fingerprints(spark.createDataFrame(rows, "id long, media binary"), "id", "media")
    members, matches = audio_fingerprint.align(prints, prints.where("id % 20 = 0"))
    of = {r["id"]: r["class_id"] for r in members.collect()}
    assert of[2] == 0 and set(of) == {0, 1, 2, 3, 6, 7, 20}
    found = {(r["query_class"], r["class_id"]): r["offset"] for r in matches.collect()}
    assert found == {(0, 1): -20, (0, 6): 0, (0, 20): -5, (20, 0): 5, (20, 1): -15, (20, 6): 5}


def test_alignment_by_brute_force_over_all_offsets(spark):
    rng = np.random.default_rng(8)
    tune = rng.integers(-(1 << 31), 1 << 31, 40)
    noisy = np.where(np.arange(40) % 4 == 0, tune, tune ^ 1)
    # equal silence at one's end and the other's start has most votes and too few frames
    rows = [(0, [7] * 15 + tune.tolist()), (1, noisy.tolist() + [7] * 15), (2, tune[10:].tolist()), (3, rng.integers(-(1 << 31), 1 << 31, 50).tolist() + [7] * 4)]
    _, matches = audio_fingerprint.align(*[spark.createDataFrame(rows, "id long, prints array<int>")] * 2)
    want = set()
    for i, a in rows:
        for j, b in rows:
            passed = []
            for offset in range(-len(a), len(b)) if i != j else ():
                pairs = [(x, b[k + offset]) for k, x in enumerate(a) if 0 <= k + offset < len(b)]
                n = sum(x == y for x, y in pairs)
                wrong = sum(((x ^ y) & 0xFFFFFFFF).bit_count() for x, y in pairs)
                if n >= audio_fingerprint.VOTES and len(pairs) >= audio_fingerprint.OVERLAP and wrong / (32 * len(pairs)) <= audio_fingerprint.BIT_ERROR:
                    passed.append((-n, abs(offset), offset, len(pairs)))
            if passed:
                want.add((i, j, min(passed)[2], -min(passed)[0], min(passed)[3]))
    assert (0, 1, -15, 10, 40) in want
    assert {tuple(r)[:5] for r in matches.collect()} == want


def test_recall_of_noisy_excerpts(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(40):
        sound = audio_fingerprint.melody(rng.normal(size=84))
        clip = np.frombuffer(sound, "<i2")[20 * 256 // 2 :]
        rows += [(20 * k, sound), (20 * k + 1, np.clip(clip + rng.normal(0, 3000, len(clip)), -32768, 32767).astype("<i2").tobytes())]
    prints = audio_fingerprint.fingerprints(spark.createDataFrame(rows, "id long, media binary"), "id", "media")
    at = {r["id"]: np.array(r["prints"], np.int32).view(np.uint32) for r in prints.collect()}
    close = set()
    for i in range(0, 800, 20):
        for j, b in at.items():
            for offset in range(-len(at[i]) + audio_fingerprint.OVERLAP, len(b) - audio_fingerprint.OVERLAP + 1) if i != j else ():
                a = at[i][max(-offset, 0) :][: len(b) - max(offset, 0)]
                wrong = np.bitwise_count(a ^ b[max(offset, 0) :][: len(a)]).sum()
                if len(a) >= audio_fingerprint.OVERLAP and wrong <= audio_fingerprint.BIT_ERROR * 32 * len(a):
                    close.add((i, j))
    _, matches = audio_fingerprint.align(prints, prints.where("id % 20 = 0"))
    found = {(r["query_class"], r["class_id"]) for r in matches.collect()}
    assert len(close) >= 40 and found <= close and len(found) >= 0.9 * len(close)


def test_integral_image_equals_sums():
    picture = np.random.default_rng(0).random((20, 12))
    codes = audio_fingerprint.packed(picture)
    kind, c, h, w = audio_fingerprint._filters()[0]
    for t in range(9):
        part, rest = picture[t : t + w, c : c + h].sum(), picture[t : t + w].sum() / 12 * h
        value = np.log((part + 0.02) / (rest + 0.02))
        level = int(value > -0.35) + int(value > 0) + int(value > 0.35)
        assert codes[t] >> 30 == level ^ (level >> 1)
    assert audio_fingerprint.fingerprint(None).size == 0


# 6 ----------------------------------------------------------------------------


def _cut(rows, length):
    starts = Counter()
    for _, t in rows:
        b = (t or "").encode()
        starts.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if starts[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        runs = re.findall(b"\1+", bytes(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), len(runs), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length, gram, split", [(200, 64, 2000), (40, 10, 1), (40, 10, 3), (40, 12, 2000)])
def test_repeats_by_brute_force(spark, length, gram, split):
    rng = random.Random(3)
    base = "".join(rng.choice("abé ") for _ in range(900))
    rows = [(1, base), (2, base[100:500] + "x" * 700), (3, None), (4, ""), (5, "ab" * 300), (6, base[:150] + "Q" + base[150:600]), (6, base[:150] + "Q" + base[150:600]), (None, base[700:]), (8, "x" * 199), (9, "ab" * 90 + base[300:620])]
    got = suffix_dedup.removal(spark.createDataFrame(rows, "doc_id long, text string"), length, gram, split)
    assert as_rows(got.drop("removed")) == _cut(rows, length)


def test_repeats_of_documents(spark, small, docs):
    assert as_rows(QUERIES["op6_suffix_array_dedup"](spark, small)) == _cut(texts_of(docs), 200)


def test_suffix_order():
    rng = np.random.default_rng(1)
    for _ in range(300):
        s = rng.integers(1, rng.integers(2, 5), rng.integers(1, 60))
        assert suffix_dedup.suffix_order(s, 10**6).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_suffix_order_of_large_symbols():
    # of these two pairs 21 bits make one key
    rng = np.random.default_rng(2)
    for n in (5, 40, 61):
        s = rng.choice([100, 101, 5, (1 << 21) + 5, (1 << 22) + 9], n)
        assert suffix_dedup.suffix_order(s, 10**6).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())
    with pytest.raises(ValueError):
        suffix_dedup.suffix_order(np.array([1, 1 << 31, 2, 3]), 10)


def test_one_passage_in_many_texts(spark):
    rng = random.Random(5)

    def word(n):
        return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))

    passage, rows = word(150), []
    for k in range(20_000):
        near = rows[rng.randrange(len(rows))][1] if k % 200 == 199 else ""
        # some texts have 30 bytes before and after the passage from another
        rows.append((k, word(20) + near[-210:] + word(20) if near else word(60) + passage + word(60)))
    got = suffix_dedup.removal(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    assert as_rows(got.drop("removed")) == _cut(rows, 200)


def test_all_texts_are_dealt_out_once(spark, monkeypatch):
    rng = random.Random(8)

    def word(n):
        return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz é", k=n))

    # texts of a crowded anchor, with repeats of one another; those of others; and texts that share nothing
    passage, other, rows = word(150), word(260), []
    for k in range(300):
        near = rows[rng.randrange(len(rows))][1] if k % 10 == 9 else ""
        rows.append((k, word(30) + near[-210:] + word(20) if near else word(60) + passage + word(60)))
    rows += [(300 + k, word(40) + other + word(40)) for k in range(20)] + [(400 + k, word(400)) for k in range(200)]
    joined, whole = [], suffix_dedup._with_wanted

    def counted(docs, *more):
        joined.append(docs.count())
        return whole(docs, *more)

    monkeypatch.setattr(suffix_dedup, "_with_wanted", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for split in (20, 2):
        joined.clear()
        assert as_rows(suffix_dedup.removal(df, split=split).drop("removed")) == _cut(rows, 200)
        # before, each step for crowded anchors asked for all texts again
        assert joined[0] == len(rows) and max(joined[1:]) <= 320


def test_equal_rows_and_frequent_contents(spark):
    rng = random.Random(6)

    def word(n):
        return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))

    same, passage = word(1500), word(700)
    rows = [(7, same)] * 5000 + [(None, same[:900])] * 2000 + [(10 + k, word(rng.randrange(300)) + passage + word(rng.randrange(300))) for k in range(5000)] + [(6000, "x" + same[200:1000] + "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = suffix_dedup.removal(df, split=500).drop("removed")
    few = [r for r in rows if r[0] is None or r[0] < 10][4990:5010] + rows[7000:]
    assert sorted(got.distinct().collect(), key=repr) == sorted({tuple(r) for r in _cut(few, 200)}, key=repr)
    assert got.count() == len(rows)


def test_cut_texts_stay_valid(spark, odd, none):
    twice = "é" * 150
    df = spark.createDataFrame([(1, "a" + twice, "x"), (2, "bb" + twice + "c", "y"), (3, None, "z")], "doc_id long, text string, dedup_note string")
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.without_repeats(df).collect()}
    assert got == {1: "a", 2: "bbc", 3: None}
    assert suffix_dedup.removal(none).count() == 0 and suffix_dedup.removal(odd).count() == len(ODD)


# 7 ----------------------------------------------------------------------------


def test_mix_rates(spark, odd, none):
    rows = spark.createDataFrame([(k, None if k % 3 else "a") for k in range(3000)], "doc_id long, source string")
    weights = spark.createDataFrame([("a", 3.0), (None, 1.0)], "source string, weight double")
    rates = mixing.rates(rows, weights, epochs=30)
    one, other = mixing.mix(rows, rates), mixing.mix(rows, rates, broadcast_sources=0)
    counts = {r["source"]: r["count"] for r in one.groupBy("source").count().collect()}
    assert counts["a"] == pytest.approx(67_500, rel=0.02) and counts[None] == pytest.approx(22_500, rel=0.02)
    assert as_rows(one) == as_rows(other)
    assert mixing.mix(none, mixing.rates(none)).count() == 0
    assert mixing.mix(odd, mixing.rates(odd)).columns == [*odd.columns, "copy"]


def test_mix_decides_each_row(spark):
    # null ids, one id for many texts, and equal rows
    rows = [(None, f"t{k}", "a" if k % 4 == 0 else "b") for k in range(4000)] + [(5, f"u{k}", "c") for k in range(2000)] + [(6, "same", "d")] * 4000
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    rates = spark.createDataFrame([(s, 0.5) for s in "abcd"], "source string, rate double")
    one, other = mixing.mix(docs, rates), mixing.mix(docs.repartition(7), rates, broadcast_sources=0)
    counts = {r["source"]: r["count"] for r in one.groupBy("source").count().collect()}
    for s, n in (("a", 1000), ("b", 3000), ("c", 2000), ("d", 4000)):
        assert counts[s] == pytest.approx(n / 2, abs=5 * (n / 2) ** 0.5)
    assert as_rows(one) == as_rows(other)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert mixing.mix(docs, rates).withColumn("p", F.spark_partition_id()).where("source = 'd'").select("p").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_mix_of_equal_rows_equals_sql(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    odd = docs.unionByName(docs.limit(50)).unionByName(docs.limit(20).withColumn("doc_id", F.lit(None).cast("long")).withColumn("source", F.lit(None).cast("string")))
    pq.write_table(odd.toArrow(), f"{tmp_path}/documents.parquet")
    assert rows_of_spark(mixing.op7_source_mixing(spark, str(tmp_path))) == rows_of_sql(connect(str(tmp_path)), ORACLE_SQL["op7_source_mixing"])


# 8, 10 ------------------------------------------------------------------------


def _auc(y, p):
    rank = pd.Series(p).rank().to_numpy()
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


@pytest.mark.parametrize("name, label, least", [("op8_quality_classifier", "quality", 0.95), ("op10_toxicity", "toxic", 0.7)])
def test_held_out_labels(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    got = QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert _auc(got[label].to_numpy(), got.score.to_numpy()) > least
    assert ((got.score >= 0.3).astype(int) == got.predicted).all() and got.score.between(0, 1).all()


@pytest.mark.parametrize("run", [quality.quality, toxicity.toxicity])
def test_classifiers_on_odd_rows(spark, odd, none, run):
    labels = "doc_id long, quality int, toxic int"
    empty, mixed = spark.createDataFrame([], labels), spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (5, 0, 1)], labels)
    assert {r["score"] for r in run(odd, empty).collect()} == {0.5}
    assert run(odd, mixed).count() == len(ODD) and run(none, mixed).count() == 0
    assert all(0 <= r["score"] <= 1 for r in run(odd, mixed).collect())


class _Texts:
    """A sample at hand."""

    def __init__(self, rows):
        self.rows, self.counts = rows, {y: sum(r[1] == y for r in rows) for y in (0, 1)}

    def batches(self):
        for a in range(0, len(self.rows), 7):
            yield [t for t, _ in self.rows[a : a + 7]], np.array([y for _, y in self.rows[a : a + 7]])


def test_toxicity_by_brute_force():
    rng = random.Random(2)
    rows = [(" ".join(rng.choice(("bad", "Worse!", "évil") if y and rng.random() < 0.5 else ("fine", "12", "good", "ok-ay")) for _ in range(rng.randrange(1, 30))), y) for y in (0, 1) for _ in range(40)]
    model = toxicity.NaiveBayesLinear(_Texts(rows))

    def runs(text):
        words = re.findall(r"[^\W\d_]+", text.lower())
        chars = " " * 8 + "".join(w + " " for w in words)
        return {chars[e - k : e] for k in toxicity.SIZES for e in range(9, len(chars) + 1)}

    def bucket(run):
        h = sum((ord(c) + 1) * 0x9E3779B97F4A7C15 ** (j + 1) for j, c in enumerate(reversed(run))) % 2**64
        return ((h ^ h >> 29) * 0xBF58476D1CE4E5B9 % 2**64) >> (64 - toxicity.BUCKET_BITS)

    for text, _ in rows:
        want = model.intercept + sum(float(model.weights[b]) for b in {bucket(r) for r in runs(text)})
        assert model.score([text])[0] == pytest.approx(1 / (1 + math.exp(-want)), abs=1e-6)
    y = np.array([y for _, y in rows])
    assert _auc(y, model.score([t for t, _ in rows])) > 0.95
    # at the least loss no direction lowers it
    used = np.flatnonzero(model.weights)[:5]

    def loss():
        p = model.score([t for t, _ in rows])
        return -np.mean(np.where(y == 1, np.log(p), np.log(1 - p)))

    before = loss()
    for b in used:
        model.weights[b] += 0.5
        assert loss() > before - 0.05
        model.weights[b] -= 0.5


def test_hashes_do_not_depend_on_pieces():
    from findwell.llm._chars import hashed, rolling, stream

    chars, _, _ = stream(["some words, and more " * 9, "", "x"])
    whole = rolling(chars, 8)
    for size in (3, 17, 1000):
        for a, part in hashed(chars, 8, size):
            for k in range(1, 9):
                own = np.arange(a, a + len(part[k]))
                ok = own >= 8
                assert (part[k][ok] == whole[k][own[ok]]).all()


def test_sample_is_bounded(spark):
    from findwell.llm._labelled import labelled_sample

    # one id has many texts, one row many equals
    rows = [(1, f"text {k}") for k in range(3000)] + [(2, "same")] * 3000 + [(10 + k, f"other {k}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(d, int(d % 2), 0) for d in {d for d, _ in rows}], "doc_id long, quality int, toxic int")
    sample = labelled_sample(docs, labels, "quality", F.lit(True), 20)
    got = [(t, int(v)) for texts, y in sample.batches(100) for t, v in zip(texts, y)]
    assert sample.rows.count() < 200 and Counter(v for _, v in got)[0] == 20 and Counter(v for _, v in got)[1] == 20
    assert len(set(got)) == len(got) and got == [(t, int(v)) for texts, y in sample.batches(10**9) for t, v in zip(texts, y)]


def test_rules_as_columns_equal_the_model(spark, small, docs):
    model = quality.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    rows = quality.with_statistics(docs).withColumn("score", model.column()).toPandas()
    assert rows["score"].to_numpy() == pytest.approx(model.score(rows[quality.STATISTICS].to_numpy()), abs=1e-9)
    assert model.rules


# 9 ----------------------------------------------------------------------------


def _components(prints, ids, errors=4):
    label = np.arange(len(prints))
    while True:
        before = label.copy()
        for k in range(len(prints)):
            near = np.bitwise_count(prints ^ prints[k]) <= errors
            label[near] = label[near].min()
        if (label == before).all():
            return pd.Series(ids).groupby(label).transform("min").to_numpy()


@pytest.mark.parametrize("split", [3, 8192])
def test_components_by_brute_force(spark, docs, split):
    got = simhash.near_duplicates(docs, split_rows=split).toPandas()
    prints = np.array([int(x, 16) for x in got.fingerprint], np.uint64)
    assert (got.component_id.to_numpy() == _components(prints, got.doc_id.to_numpy())).all()


def test_components_of_a_long_chain(spark):
    order = list(range(3000))
    random.Random(4).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])) + [(5000, 5001)], "a long, b long")
    got = {r["node"]: r["component"] for r in simhash.components(edges).collect()}
    assert got == {k: 0 for k in order} | {5000: 5000, 5001: 5000}


def test_fingerprint_by_the_rule(odd, none):
    import xxhash

    text = "The red FOX and the\tdog "
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]), 42) for k in range(3)]
    expected = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 3)
    assert simhash.fingerprint(text.encode()) == expected and simhash.fingerprint(b" \n") == 0
    got = simhash.near_duplicates(odd)
    assert got.count() == len(ODD) and simhash.near_duplicates(none).count() == 0
    assert {r["component_id"] for r in got.where("doc_id in (2, 3)").collect()} == {2}

"""Token counts at every prefix of a text, by dynamic programming over prefixes.

A merge-based tokenizer has one last token for each prefix of a word: the
vocabulary entry t that ends there such that t may follow the last token of the
prefix before t. One pass over a word from left to right therefore gives the
exact count at all of its prefixes. Words are independent of each other, so
running sums over words give the counts at the prefixes of a whole text, and
questions on budgets and truncation are look-ups in them.

Defined results: a null or empty text has no tokens. Strings of special tokens
inside a text count one token each, as the library has it by default. Repeated
rows and null ids are kept, one result each; other columns are ignored. Texts of
any length are counted whole.
"""

from __future__ import annotations

import itertools
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from findwell.llm._arrow import bounded_batches, chunks

#: Words kept per Python worker; beyond that the table is begun anew.
KEPT_WORDS = 1_000_000


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 for itself, others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = itertools.count(256)
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class PrefixCounter:
    """Exact token counts at every prefix of words and texts.

    `path` is a tokenizers JSON file with a byte-level BPE model whose words end
    in `end_of_word_suffix`.
    """

    def __init__(self, path: str, kept_words: int = KEPT_WORDS):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.merges = [tuple(m) for m in model["merges"]]
        self.ranks = {m: k for k, m in enumerate(self.merges)}
        self.made = {a + b: k for k, (a, b) in enumerate(self.merges)}
        self.edges: tuple[dict, dict] = ({}, {})
        self.vocab = set(model["vocab"])
        self.longest = max(len(t.removesuffix(self.suffix)) for t in self.vocab)
        self.symbols = _byte_symbols()
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.blank_free = regex.compile(r"\S+")
        self.simple = regex.compile(r"[\x00-ɏ‐-‧‰-⁞₠-₿]*+")
        self.path = path
        self._lib = None
        end = self.suffix
        ends = {t.removesuffix(end) for t in self.vocab if end and t.endswith(end)}
        opens = {t for t in self.vocab if not end or not t.endswith(end)}
        self.by_end: tuple[tuple[set, dict], ...] = ((opens, {}), (ends if end else opens, {}))
        self.table = _Table(self, kept_words)

    # one word ---------------------------------------------------------------

    def _merged(self, parts: list[str]) -> list[str]:
        parts = list(parts)
        while len(parts) > 1:
            rank, at = min((self.ranks.get(p, 1 << 60), k) for k, p in enumerate(itertools.pairwise(parts)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _pieces(self, token: str) -> list[str]:
        body = token.removesuffix(self.suffix) if self.suffix else token
        parts = list(body)
        if len(body) < len(token):
            parts[-1] += self.suffix
        return parts

    def _edge(self, token: str, right: bool) -> list[tuple[str, int]]:
        """The parts of a token that stand at one of its ends while it is built, and the rank that consumes each."""
        edges = self.edges[right]
        found = edges.get(token)
        if found is None:
            found, part, consumed = [], token, 1 << 60
            while True:
                found.append((part, consumed))
                if part not in self.made:
                    break
                consumed = self.made[part]
                part = self.merges[consumed][right]
            edges[token] = found
        return found

    def may_follow(self, left: str, right: str) -> bool:
        """Whether `right` is a token of its own after `left`.

        It is not if some merge joins a part at the end of `left` with one at the
        start of `right` before either is consumed inside its own token; of equal
        ranks the one further left goes first. A part's rank is below that of
        whatever it goes into.
        """
        rank, starts = self.ranks.get, self._edge(right, False)
        return not any((r := rank((x, y), 1 << 61)) < cx and r <= cy for x, cx in self._edge(left, True) for y, cy in starts)

    def _is_alone(self, token: str, closed: bool) -> bool:
        whole = token + self.suffix if closed else token
        return self._merged(self._pieces(whole)) == [whole]

    def word(self, word: str) -> bytes | np.ndarray:
        """Counts of the first 1, 2, ... bytes of a word, each taken as a word that ends there."""
        sym = word if word.isascii() and word.isprintable() else "".join(map(self.symbols.__getitem__, word.encode()))
        n, longest = len(sym), self.longest
        inner, inner_count, counts = [""] * (n + 1), [0] * (n + 1), [0] * n
        for i in range(1, n + 1):
            first = i - longest if i > longest else 0
            for closed in (False, True):
                vocab, follows = self.by_end[closed]
                for start in range(first, i):
                    token = sym[start:i]
                    if token not in vocab:
                        continue
                    key = (inner[start], token)
                    ok = follows.get(key)
                    if ok is None:
                        if len(follows) > 1_000_000:
                            follows.clear()
                        ok = follows[key] = self.may_follow(inner[start], token + self.suffix if closed else token) if start else self._is_alone(token, closed)
                    if ok:
                        if closed:
                            counts[i - 1] = inner_count[start] + 1
                        else:
                            inner[i], inner_count[i] = token, inner_count[start] + 1
                        break
        return bytes(counts) if max(counts) < 256 else np.array(counts, np.int64)

    # texts ------------------------------------------------------------------

    def _plain(self, text: str) -> list[str]:
        """Words of a text without special tokens, as the library normalises and splits it."""
        if self.simple.fullmatch(text):
            if not text.isascii() and not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            return self.words.findall(text.lower())
        lib = self.library
        text = lib.normalizer.normalize_str(text)
        return self.words.findall(text)

    @property
    def library(self):
        if self._lib is None:
            from tokenizers import Tokenizer

            self._lib = Tokenizer.from_file(self.path)
        return self._lib

    def pieces(self, text: str) -> list[str | None]:
        """Words of a text in order; None stands for a special token."""
        if self.special is None or "<|" not in text or not self.special.search(text):
            return self._plain(text)
        out: list[str | None] = []
        at = 0
        for m in self.special.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(None)
            at = m.end()
        return out + self._plain(text[at:])

    def sums(self, text: str | None) -> np.ndarray:
        """Running token counts after each word of a text, from the last entry of each word's table."""
        words = self.pieces(text or "")
        return np.cumsum(np.array([t[-1] for t in map(self.table.__getitem__, words)], np.int64))

    def _total(self, words: list[str | None]) -> int:
        return sum(int(self.table[w][-1]) for w in words)

    def count(self, text: str | None) -> int:
        sums = self.sums(text)
        return int(sums[-1]) if len(sums) else 0

    def at_prefixes(self, text: str | None) -> list[int]:
        """The count of text[:k] for k = 0, 1, ... len(text).

        A prefix that ends inside a word takes its count from that word's table;
        the words before it are summed once. A cut inside the string of a special
        token leaves ordinary text.
        """
        text = text or ""
        counts, at = [0], 0
        cuts = [m.span() for m in self.special.finditer(text)] if self.special else []
        for start, end in cuts:
            self._part(text[at:start], counts)
            whole = counts[-1] + 1
            self._part(text[start:end], counts)
            counts[-1] = whole
            at = end
        self._part(text[at:], counts)
        return counts

    def _part(self, part: str, counts: list[int]) -> None:
        """Append the counts of a part without special tokens; no word crosses white space."""
        at = 0
        for m in self.blank_free.finditer(part):
            counts += [counts[-1]] * (m.start() - at)
            at, piece, base = m.end(), m.group(), counts[-1]
            low = piece.lower()
            if len(low) != len(piece) or not self.simple.fullmatch(piece) or not unicodedata.is_normalized("NFC", piece):
                counts += [base + self._total(self._plain(piece[:e])) for e in range(1, len(piece) + 1)]
                continue
            for w in self.words.finditer(low):
                word, total = w.group(), counts[-1]
                if len(word) > 1 and word[0] == "'":  # a contraction's prefixes are other words
                    counts += [total + self._total(self._plain(word[:e])) for e in range(1, len(word) + 1)]
                    continue
                ends = np.cumsum([len(c.encode()) for c in word]) - 1
                table = self.table[word]
                counts += [total + int(table[e]) for e in ends]
        counts += [counts[-1]] * (len(part) - at)

    def fits(self, text: str | None, budget: int) -> bool:
        return self.count(text) <= budget

    def truncate(self, text: str | None, budget: int) -> str:
        """The longest prefix of at most `budget` tokens, read off the prefix counts."""
        counts = self.at_prefixes(text)
        return (text or "")[: max(k for k, c in enumerate(counts) if c <= budget)]


class _Table(dict):
    """word -> its prefix counts, made when asked for; None is a special token."""

    def __init__(self, counter: PrefixCounter, most: int):
        super().__init__({None: b"\1"})
        self.counter, self.most = counter, most

    def __missing__(self, word: str) -> bytes | np.ndarray:
        if len(self) > self.most:
            self.clear()
            self[None] = b"\1"
        found = self[word] = self.counter.word(word)
        return found


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter per worker and file, so that word tables are shared by tasks."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def token_counts(df: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text", tables: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; with `tables` also the running counts after each word."""
    bounded_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    names = f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean" + (", token_sums array<bigint>" if tables else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in chunks(batches, "text"):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sums = [own.sums(t) for t in texts]
            n = [int(s[-1]) if len(s) else 0 for s in sums]
            cols = [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            if tables:
                cols.append(pa.array([s.tolist() for s in sums], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_tokens", "over_limit", "token_sums"][: len(cols)])

    return df.select(df[id_col].alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, names)


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, public_tokenizers.path("word_bpe_49k.json"), limit=2048)

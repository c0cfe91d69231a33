"""From texts and pages to postings.

Tables: occurrences (doc_id, pos, tag, token), docs (doc_id, url, doc_len,
url_depth, content_hash), postings (token, doc_id, url, frequency, tags,
position_v), vocab (token, df). Positions number the kept words of a document from
0 and come from the array of words itself, so making occurrences needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findwell.config import Config
from findwell.functions.stemming import with_stem
from findwell.functions.text import path_parts, words
from findwell.session import saved
from findwell.sources.pages import segments


def text_tokens(docs: DataFrame, text: Column, doc_id: str = "doc_id", url: Column | None = None, tag: str = "p") -> DataFrame:
    """One row per document: doc_id, url, tokens as (tag, token) in order."""
    tokens = F.transform(words(F.coalesce(text, F.lit(""))), lambda w: F.struct(F.lit(tag).alias("tag"), w.alias("token")))
    return docs.select(F.col(doc_id).alias("doc_id"), (url if url is not None else F.lit("")).alias("url"), tokens.alias("tokens"))


def page_tokens(pages: DataFrame, doc_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The same of web pages, with the tag that encloses each word."""
    tagged = F.transform(segments(F.col(html)), lambda s: F.transform(words(s["txt"]), lambda w: F.struct(s["tag"].alias("tag"), w.alias("token"))))
    return pages.select(F.col(doc_id).alias("doc_id"), F.col(url).alias("url"), F.flatten(tagged).alias("tokens"))


def word_rows(tokens: DataFrame) -> DataFrame:
    """(doc_id, url, doc_len, pos, tag, token): one row per word, with what postings say of its document."""
    rows = tokens.select("doc_id", "url", F.size("tokens").cast("bigint").alias("doc_len"), F.posexplode("tokens").alias("pos", "x"))
    return rows.select("doc_id", "url", "doc_len", "pos", F.col("x.tag").alias("tag"), F.col("x.token").alias("token"))


def occurrences(tokens: DataFrame) -> DataFrame:
    """(doc_id, pos, tag, token): one row per word."""
    return word_rows(tokens).select("doc_id", "pos", "tag", "token")


def stemmed(occ: DataFrame, config: Config = Config(), terms: list[str] | None = None) -> DataFrame:
    """Tokens replaced by their stems, other columns kept; with `terms` only rows with these stems.

    Each distinct word is stemmed once. Stems are written first: a filter on them must
    not be pushed into the steps, whose expressions would grow with every one it
    passes. A table of few words is sent to every task, so rows are not shuffled.
    """
    stems = saved(with_stem(occ.select(F.col("token").alias("word")).distinct()), "stems")
    if terms is not None:
        stems = stems.where(F.col("stem").isin(list(terms)))
    stems = F.broadcast(stems) if stems.count() <= config.broadcast_words else stems
    return occ.join(stems, occ["token"] == stems["word"]).select(*(c for c in occ.columns if c != "token"), F.col("stem").alias("token"))


def content_hash(tokens: Column) -> Column:
    """Equal for equal streams of (tag, token)."""
    return F.md5(F.array_join(F.transform(tokens, lambda t: F.concat_ws(":", t["tag"], t["token"])), " "))


def doc_table(tokens: DataFrame) -> DataFrame:
    """(doc_id, url, doc_len, url_depth, content_hash); documents without words stay, with length 0."""
    return tokens.select("doc_id", "url", F.size("tokens").cast("bigint").alias("doc_len"), path_parts(F.coalesce("url", F.lit(""))).alias("url_depth"), content_hash(F.col("tokens")).alias("content_hash"))


def postings(words: DataFrame, config: Config = Config()) -> DataFrame:
    """(token, doc_id, url, frequency, tags, position_v) of word rows; tags in the order of first use.

    A document's rows stand together, so its words are grouped before they are shuffled.
    """
    grouped = words.groupBy("token", "doc_id", "url", "doc_len").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "tag"))).alias("at"))
    return grouped.select(
        "token", "doc_id", "url", (F.col("n") / F.col("doc_len")).alias("frequency"),
        F.slice(F.array_distinct(F.col("at.tag")), 1, config.most_tags).alias("tags"), F.col("at.pos").alias("position_v"),
    )


def vocabulary(posts: DataFrame) -> DataFrame:
    return posts.groupBy("token").agg(F.count("*").alias("df"))


# duplicates -------------------------------------------------------------------


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """(content_hash, n_docs, rep_url): the shortest url of each group, ties by the url."""
    return docs.groupBy("content_hash").agg(F.count("*").alias("n_docs"), F.min(F.struct(F.length("url").alias("n"), F.col("url").alias("url"))).alias("m")).select("content_hash", "n_docs", F.col("m.url").alias("rep_url"))


def alias_map(docs: DataFrame) -> DataFrame:
    """(url, rep_url), once per url and representative."""
    return docs.join(duplicate_groups(docs).select("content_hash", "rep_url"), "content_hash").select("url", "rep_url").distinct()


def alias_conflicts(docs: DataFrame) -> DataFrame:
    """Urls with more than one representative; a sound corpus has none."""
    return alias_map(docs).groupBy("url").agg(F.count("*").alias("n")).where("n > 1")


def distinct_docs(docs: DataFrame) -> DataFrame:
    """Of each representative url the document of the least id, with that url.

    Duplicates have the same tokens, so dropping them before words are grouped
    gives the same postings as dropping them from every posting list.
    """
    named = docs.join(duplicate_groups(docs).select("content_hash", "rep_url"), "content_hash")
    first = named.groupBy("rep_url").agg(F.min_by(F.struct("doc_len", "content_hash"), "doc_id").alias("m"), F.min("doc_id").alias("doc_id"))
    return first.select("doc_id", F.col("rep_url").alias("url"), F.col("m.doc_len").alias("doc_len"), path_parts(F.col("rep_url")).alias("url_depth"), F.col("m.content_hash").alias("content_hash"))


def distinct_tokens(tokens: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Tokens of the documents that stay, under their representative urls."""
    kept = distinct_docs(doc_table(tokens)) if docs is None else docs
    return tokens.drop("url").join(kept.select("doc_id", "url"), "doc_id").select("doc_id", "url", "tokens")


# look-ups ---------------------------------------------------------------------


def vocab_ceiling(vocab: DataFrame, probes: list[str]) -> DataFrame:
    """(probe, token): the least token that is not below each probe, in one pass."""
    row = vocab.agg(*(F.min(F.when(F.col("token") >= p, F.col("token"))).alias(f"c{k}") for k, p in enumerate(probes)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(p).alias("probe"), F.col(f"c{k}").alias("token")) for k, p in enumerate(probes)))).alias("x")).select("x.probe", "x.token")


def doc_successor(posts: DataFrame) -> DataFrame:
    """(token, doc_id, next_doc): the next document in each posting list."""
    w = Window.partitionBy("token").orderBy("doc_id")
    return posts.select("token", "doc_id", F.lead("doc_id").over(w).alias("next_doc"))


def vocab_stats(vocab: DataFrame) -> DataFrame:
    """(n_tokens, n_not_numeric)."""
    return vocab.agg(F.count("*").alias("n_tokens"), F.count_if(~F.col("token").rlike("^[0-9]+$")).alias("n_not_numeric"))


def merge_postings(left: DataFrame, right: DataFrame) -> DataFrame:
    """Postings of two indexes over different documents, as one."""
    return left.unionByName(right)


def skip_sample(posts: DataFrame, share: float = 0.05, seed: int = 0) -> DataFrame:
    """Postings that would anchor skips: each with probability `share`, by a hash of token and id, so the same on every run."""
    key = F.concat_ws(":", F.lit(str(seed)), "token", F.col("doc_id").cast("string"))
    return posts.where(F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("bigint") < F.lit(int(share * (1 << 52))))


# JSON -------------------------------------------------------------------------


def postings_as_json(posts: DataFrame) -> DataFrame:
    """(token, json): each posting as a JSON object."""
    return posts.select("token", F.to_json(F.struct("doc_id", "url", "frequency", "tags", "position_v")).alias("json"))


def postings_from_json(rows: DataFrame, doc_id: str = "bigint") -> DataFrame:
    """Postings of (token, json); a posting that is no JSON object has null fields."""
    fields = f"doc_id {doc_id}, url string, frequency double, tags array<string>, position_v array<int>"
    return rows.select("token", F.from_json("json", fields).alias("p")).select("token", "p.*")

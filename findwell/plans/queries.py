"""The library's operators as queries over the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findwell.config import Config
from findwell.functions.stemming import with_stem
from findwell.functions.text import path_parts, prepare_query, tag_score
from findwell.operators import indexing as ix
from findwell.operators import search as sr
from findwell.operators.index import build_index, load_index, merge_indexes, read_json_postings
from findwell.session import new_path, saved, spread_small
from findwell.sources.pages import meta_texts, read_corpus, segments

CONFIG = Config()
#: Queries by name: (terms, tolerance).
TEXTS = {"single": "er", "or": "er tion en", "and2": "the er", "and3": "er en on", "missing": "er zzzzq", "stop": "the and of"}
PREPARED = {name: prepare_query(text, stemmed=False) for name, text in TEXTS.items()}
PREPARED["and2"] = (["the", "and"], 2)
BATCH = {1: "er en", 2: "the tion", 3: "heed", 4: "on or in ent"}
FLAGSHIP = "the en er"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def doc_tokens(spark: SparkSession, sf: str) -> DataFrame:
    url = F.concat(F.lit("http://"), F.col("source"), F.lit("/"), F.col("doc_id"))
    return ix.text_tokens(spread_small(_docs(spark, sf)), F.col("text"), url=url)


def page_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return ix.page_tokens(spread_small(spark.read.parquet(f"{sf}/pages.parquet")))


def _posts(spark: SparkSession, sf: str, terms: list[str] | None = None) -> DataFrame:
    """Postings of documents; with `terms` only theirs, filtered before words are grouped."""
    words = ix.word_rows(doc_tokens(spark, sf))
    return ix.postings(words if terms is None else words.where(F.col("token").isin(list(terms))))


def tokenize_documents(spark, sf):
    return ix.occurrences(doc_tokens(spark, sf)).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "token")


def tokenize_pages(spark, sf):
    return ix.occurrences(page_tokens(spark, sf)).select(F.col("doc_id").alias("page_id"), F.col("pos").cast("bigint").alias("pos"), "tag", "token")


def page_segments(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    return pages.select("page_id", F.posexplode(segments(F.col("html"))).alias("seg", "x")).select("page_id", F.col("seg").cast("bigint").alias("seg"), "x.tag", "x.txt")


def meta_segments(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    # the pages carry no named meta tag, so one is put before each
    html = F.concat(F.lit('<meta name="keywords" content="'), F.col("url"), F.lit("\">"), F.col("html"))
    return pages.select("page_id", F.explode(meta_texts(html)).alias("txt"))


def stem_vocab(spark, sf):
    words = ix.occurrences(doc_tokens(spark, sf)).select(F.col("token").alias("word")).distinct()
    return with_stem(words)


def doc_lengths(spark, sf):
    return ix.doc_table(doc_tokens(spark, sf)).select("doc_id", "doc_len")


def corpus_size(spark, sf):
    return _docs(spark, sf).agg(F.count("*").alias("corpus_size"))


def index_meta(spark, sf):
    return _docs(spark, sf).agg(F.lit("documents").alias("index_name"), F.count("*").alias("corpus_size"))


def postings(spark, sf):
    return _flat(_posts(spark, sf))


def _flat(p: DataFrame) -> DataFrame:
    return p.select("token", "doc_id", "url", F.round("frequency", 9).alias("frequency"), F.array_join("tags", ",").alias("tags"), F.array_join(F.transform("position_v", lambda x: x.cast("string")), ",").alias("positions"))


def postings_json(spark, sf):
    """All postings written as JSON lines and read back."""
    path = new_path(spark, "postings-json")
    ix.postings_as_json(_posts(spark, sf)).write.json(path)
    return _flat(read_json_postings(spark, path))


def vocab_df(spark, sf):
    occ = ix.occurrences(doc_tokens(spark, sf))
    return ix.vocabulary(occ.select("token", "doc_id").distinct())


def vocab_stats(spark, sf):
    return ix.vocab_stats(ix.occurrences(doc_tokens(spark, sf)).select("token").distinct())


def vocab_ceiling(spark, sf):
    vocab = ix.occurrences(doc_tokens(spark, sf)).select("token").distinct()
    return ix.vocab_ceiling(vocab, ["a", "heeb", "thz", "zzzzzz"])


def doc_successor(spark, sf):
    return ix.doc_successor(ix.occurrences(doc_tokens(spark, sf)).select("token", "doc_id").distinct())


def term_postings(spark, sf):
    p = _posts(spark, sf, ["heed"])
    return p.select("doc_id", "url", F.round("frequency", 9).alias("frequency"), F.size("position_v").cast("bigint").alias("n"))


def duplicate_groups(spark, sf):
    return ix.duplicate_groups(ix.doc_table(doc_tokens(spark, sf)))


def alias_map(spark, sf):
    return ix.alias_map(ix.doc_table(doc_tokens(spark, sf)))


def alias_conflicts(spark, sf):
    return ix.alias_conflicts(ix.doc_table(doc_tokens(spark, sf)))


def dedup_postings(spark, sf):
    posts = ix.postings(ix.word_rows(ix.distinct_tokens(doc_tokens(spark, sf))))
    return posts.select("token", "doc_id", "url", F.round("frequency", 9).alias("frequency"))


def df_after_dedup(spark, sf):
    occ = ix.occurrences(ix.distinct_tokens(doc_tokens(spark, sf)))
    return ix.vocabulary(occ.select("token", "doc_id").distinct())


def url_depth(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    parts = path_parts(F.col("url"))
    return pages.select("page_id", parts.alias("parts"), F.round(F.lit(CONFIG.depth_weight) / parts, 6).alias("depth_score"))


def tag_scores(spark, sf):
    p = ix.postings(ix.word_rows(page_tokens(spark, sf)))
    return p.select("token", F.col("doc_id").alias("page_id"), F.round(tag_score(F.col("tags"), CONFIG.tag_weights, CONFIG.tag_weight), 6).alias("tag_score"))


def idf(spark, sf):
    n = _docs(spark, sf).count()
    return vocab_df(spark, sf).select("token", F.round(F.log10(F.lit(float(n)) / F.col("df")), 6).alias("idf"))


def tfidf(spark, sf):
    n = _docs(spark, sf).count()
    p = _posts(spark, sf)
    df = ix.vocabulary(p)
    return p.join(df, "token").select("token", "doc_id", F.round(F.lit(50.0) * F.col("frequency") * F.log10(F.lit(float(n)) / F.col("df")), 6).alias("tfidf"))


QUERY_TEXTS = {1: "Red fox", 2: "the red fox", 3: "to be", 4: "to be?", 5: "fox fox", 6: "wörld", 7: "running dogs"}


def query_prepare(spark, sf):
    rows = [(q, k, t, tol) for q, text in QUERY_TEXTS.items() for terms, tol in [prepare_query(text)] for k, t in enumerate(terms)]
    return spark.createDataFrame(rows, "qid long, k long, term string, tolerance long")


def _search(spark, sf, queries, mode, config=CONFIG) -> DataFrame:
    terms = sr.query_table(spark, queries, stemmed=False)
    names = sorted({t for _, ts, _ in queries for t in ts})
    # the terms' postings are read several times: for frequencies, scores and runs
    return sr.search(saved(_posts(spark, sf, names), "postings"), terms, _docs(spark, sf), mode, config)


def _one(name, mode, config=CONFIG):
    def run(spark, sf):
        return _search(spark, sf, [(0, *PREPARED[name])], mode, config).select("rank", "doc_id", "score")

    return run


def _candidates(spark, sf, name):
    terms, tolerance = PREPARED[name]
    table = sr.query_table(spark, [(0, terms, tolerance)])
    return sr.matching(_posts(spark, sf, terms), table)


def phrase_runs(spark, sf):
    return sr.phrase_runs(sr.spread(_candidates(spark, sf, "and2"))).select("doc_id", "run", "n_terms")


def ngram_boost(spark, sf):
    runs = sr.phrase_runs(sr.spread(_candidates(spark, sf, "and2"))).where("n_terms >= 2")
    return runs.groupBy("doc_id").agg((F.count("*") * F.lit(10.0)).alias("boost"))


def bigram_boost(spark, sf):
    pairs = sr.bigram_pairs(sr.spread(_candidates(spark, sf, "and2")))
    return pairs.select("doc_id", F.when(F.col("adjacent"), 10.0).otherwise(0.0).alias("boost"))


def candidate_difference(spark, sf):
    """Documents with the first term and without the second."""
    occ = ix.occurrences(doc_tokens(spark, sf))
    a, b = (occ.where(F.col("token") == t).select("doc_id").distinct() for t in PREPARED["and2"][0])
    return a.join(b, "doc_id", "left_anti")


def result_page_2(spark, sf):
    return sr.page_of(_one("and3", "or")(spark, sf), 2, CONFIG.page_size)


def result_page_label(spark, sf):
    return sr.page_label(_one("and3", "or")(spark, sf), 2, CONFIG.page_size)


def result_count(spark, sf):
    return _one("and3", "and")(spark, sf).agg(F.count("*").alias("n_results"))


def index_merge(spark, sf):
    occ = ix.occurrences(doc_tokens(spark, sf)).select("token", "doc_id").distinct()
    halves = [occ.where(F.col("doc_id") % 2 == k) for k in (0, 1)]
    return ix.vocabulary(ix.merge_postings(*halves))


def batch_search(spark, sf):
    queries = [(q, *prepare_query(t, stemmed=False)) for q, t in BATCH.items()]
    return _search(spark, sf, queries, "and").select(F.col("qid").cast("bigint").alias("qid"), "rank", "doc_id", "score")


def skip_sample(spark, sf):
    return ix.skip_sample(ix.occurrences(doc_tokens(spark, sf)).select("token", "doc_id").distinct())


def _index(spark, sf, tokens: DataFrame | None = None):
    """An index of documents' words as they stand."""
    return build_index(spark, doc_tokens(spark, sf) if tokens is None else tokens, new_path(spark, "index"), "documents", stemmed=False)


def index_stored(spark, sf):
    """Postings of an index that was written and opened again."""
    index = load_index(spark, _index(spark, sf).path)
    return index.posts.select("token", "doc_id", "url", F.round("frequency", 9).alias("frequency"))


def index_order(spark, sf):
    """Neighbouring postings of a file that are out of order, and neighbouring words of the vocabulary."""
    index = _index(spark, sf)

    def disorder(rows: DataFrame, *keys: str) -> DataFrame:
        placed = rows.select(*keys, F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("i"))
        own = F.struct(*keys)
        before = F.lag(own).over(Window.partitionBy("file").orderBy("i"))
        return placed.select((before >= own).alias("wrong")).agg(F.count_if("wrong").alias("n_wrong"))

    return disorder(index.posts, "token", "doc_id").select(F.lit("postings").alias("part"), "n_wrong").union(disorder(index.vocab, "token").select(F.lit("vocab"), "n_wrong"))


def index_search(spark, sf):
    """Several queries against a stored index."""
    found = _index(spark, sf).batch_search(BATCH)
    return found.select(F.col("qid").cast("bigint").alias("qid"), "rank", "doc_id", "url", "score")


def index_merge_distinct(spark, sf):
    """Document frequencies of two indexes over halves of the documents, merged without duplicates across them."""
    tokens = doc_tokens(spark, sf)
    halves = [_index(spark, sf, tokens.where(F.col("doc_id") % 2 == k)) for k in (0, 1)]
    return merge_indexes(spark, *halves, new_path(spark, "index")).vocab


def corpus_read(spark, sf):
    """Pages written as a corpus folder, one JSON object a file, and read back."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    path = new_path(spark, "corpus")
    pages.select("url", F.lit("utf-8").alias("encoding"), F.col("html").alias("content"), (F.col("page_id") % 4).alias("part")).write.partitionBy("part").option("maxRecordsPerFile", 1).json(path)
    return read_corpus(spark, path).select("url", "encoding", F.md5("content").alias("content_md5"))


def search_full_pages(spark, sf):
    """The whole score over web pages: stems, stop words, duplicates, tags, depth, runs."""
    terms, tolerance = prepare_query(FLAGSHIP)
    # read for words, for duplicates and for postings, so lexed once
    tokens = saved(page_tokens(spark, sf), "tokens")
    words = ix.stemmed(ix.word_rows(ix.distinct_tokens(tokens)), terms=terms)
    found = sr.search(saved(ix.postings(words), "postings"), sr.query_table(spark, [(0, terms, tolerance)]), spark.read.parquet(f"{sf}/pages.parquet"))
    return found.select("rank", F.col("doc_id").alias("page_id"), "url", "score")

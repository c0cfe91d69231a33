"""An index as Parquet tables, and searching it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findwell.config import Config
from findwell.operators import indexing, search
from findwell.session import written


class Index:
    """Postings, vocabulary, documents and metadata under a folder.

    Postings are range-partitioned and sorted by token and id, so that a look-up
    reads the row groups whose statistics hold its terms.
    """

    def __init__(self, spark: SparkSession, path: str, config: Config = Config()):
        self.spark, self.path, self.config = spark, path, config
        self.posts, self.vocab, self.docs, self.meta = (spark.read.parquet(f"{path}/{t}") for t in ("postings", "vocab", "docs", "meta"))
        row = self.meta.first()
        self.size, self.stemmed = row["corpus_size"], row["stemmed"]

    def metadata(self) -> DataFrame:
        return self.meta

    def vocab_stats(self) -> DataFrame:
        return indexing.vocab_stats(self.vocab)

    def postings(self, word: str) -> DataFrame:
        """Postings of one word as it stands in the index."""
        return self.posts.where(F.col("token") == word).orderBy("doc_id")

    def _with_terms(self, table: DataFrame, rows: DataFrame) -> DataFrame:
        """Rows with a term of the queries; few terms are literals, which reach the Parquet scan."""
        some = [r["term"] for r in table.select("term").distinct().limit(self.config.literal_terms + 1).collect()]
        if len(some) <= self.config.literal_terms:
            return rows.where(F.col("token").isin(some)) if some else rows.where(F.lit(False))
        return rows.join(search.sent(table.select(F.col("term").alias("token")).distinct(), table.count(), self.config), "token", "left_semi")

    def search(self, text: str, mode: str = "and", page: int | None = 1) -> DataFrame:
        """(rank, url, score) of a page, or of all results where page is None."""
        found = self.batch_search({0: text}, mode)
        found = found if page is None else search.page_of(found, page, self.config.page_size)
        return found.select("rank", "url", "score").orderBy("rank")

    def batch_search(self, queries: dict[int, str], mode: str = "and") -> DataFrame:
        """(qid, rank, doc_id, url, score) of many queries in one pass."""
        table = search.query_table(self.spark, queries, self.stemmed)
        return search.search(self._with_terms(table, self.posts), table, self.size, mode, self.config, self._with_terms(table, self.vocab))

    def export_json(self, path: str) -> None:
        """Postings as lines of JSON under folders by token's first character."""
        rows = indexing.postings_as_json(self.posts).withColumn("first", F.substring("token", 1, 1))
        rows.write.mode("overwrite").partitionBy("first").json(path)


def read_json_postings(spark: SparkSession, path: str, doc_id: str = "bigint") -> DataFrame:
    """Postings of an exported index; ids are read as type `doc_id`."""
    return indexing.postings_from_json(spark.read.schema("token string, json string").json(path), doc_id)


def build_index(spark: SparkSession, tokens: DataFrame, path: str, name: str = "corpus", stemmed: bool = True, config: Config = Config()) -> Index:
    """Write the index of documents (doc_id, url, tokens) and open it.

    N counts every document; duplicates are dropped before postings are made.
    """
    table = indexing.doc_table(tokens)
    docs = written(indexing.distinct_docs(table), f"{path}/docs")
    words = indexing.word_rows(indexing.distinct_tokens(tokens, docs))
    if stemmed:
        words = indexing.stemmed(words, config)
    _write(spark, path, name, indexing.postings(words, config), tokens.count(), stemmed)
    return Index(spark, path, config)


def _write(spark: SparkSession, path: str, name: str, posts: DataFrame, size: int, stemmed: bool) -> None:
    posts = written(posts.repartitionByRange("token", "doc_id").sortWithinPartitions("token", "doc_id"), f"{path}/postings")
    written(indexing.vocabulary(posts).repartitionByRange("token").sortWithinPartitions("token"), f"{path}/vocab")
    meta = spark.range(1).select(F.lit(name).alias("index_name"), F.current_timestamp().alias("time_built"), F.lit(size).cast("bigint").alias("corpus_size"), F.lit(stemmed).alias("stemmed"))
    written(meta.coalesce(1), f"{path}/meta")


def load_index(spark: SparkSession, path: str, config: Config = Config()) -> Index:
    return Index(spark, path, config)


def merge_indexes(spark: SparkSession, left: Index, right: Index, path: str, name: str = "merged") -> Index:
    """One index of two over different documents; pages that both have are kept once, under the shorter url."""
    if left.stemmed != right.stemmed:
        raise ValueError("one of the indexes holds stems, the other words")
    both = left.docs.unionByName(right.docs)
    docs = written(indexing.distinct_docs(both), f"{path}/docs")
    posts = left.posts.unionByName(right.posts).drop("url").join(docs.select("doc_id", "url"), "doc_id")
    _write(spark, path, name, posts.select(*left.posts.columns), left.size + right.size, left.stemmed)
    return Index(spark, path, left.config)

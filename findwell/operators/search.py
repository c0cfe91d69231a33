"""Ranked retrieval over postings, for one or many queries at once.

Score of a document for the L terms of a query that the index knows:

  sum over terms of 50 tf log10(N / df) + 10 (1 + tag weights)
  + depth (5 / path parts) once per matching term (OR), or L - 1 times, at least once (AND)
  + 10 for each run of positions that holds all L terms, if L > 1

A run ends where positions differ by more than the tolerance, but never after
position 0. Results are ordered by score rounded to six places, then by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from findwell.config import Config
from findwell.functions.text import path_parts, prepare_query, tag_score


def query_table(spark: SparkSession, queries: dict[int, str] | list[tuple[int, list[str], int]], stemmed: bool = True) -> DataFrame:
    """(qid, k, term, tolerance) from query texts, or from prepared terms and tolerances."""
    prepared = [(q, *prepare_query(t, stemmed)) for q, t in queries.items()] if isinstance(queries, dict) else queries
    rows = [(q, k, t, tol) for q, terms, tol in prepared for k, t in enumerate(terms)]
    return spark.createDataFrame(rows, "qid int, k int, term string, tolerance int")


def sent(few: DataFrame, rows: int, config: Config) -> DataFrame:
    """A table of at most `rows` rows, sent to every task if these are few."""
    return F.broadcast(few) if rows <= config.broadcast_terms else few


def matching(posts: DataFrame, terms: DataFrame, most_postings: int = -1, config: Config = Config(), n_terms: int | None = None) -> DataFrame:
    """Postings of the queries' terms (n_terms, counted if not given), with qid, k and tolerance; unknown terms drop out."""
    found = posts.join(sent(terms, terms.count() if n_terms is None else n_terms, config), posts["token"] == terms["term"]).drop("term")
    if most_postings >= 0:
        w = Window.partitionBy("qid", "k").orderBy("doc_id")
        found = found.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most_postings).drop("nth")
    return found


def phrase_runs(positions: DataFrame) -> DataFrame:
    """(qid, doc_id, run, n_terms) of positions (qid, doc_id, pos, k, tolerance)."""
    w = Window.partitionBy("qid", "doc_id").orderBy("pos", "k")
    gap = F.lag("pos").over(w)
    breaks = F.when(gap.isNotNull() & (gap != 0) & (F.col("pos") - gap > F.col("tolerance")), 1).otherwise(0)
    runs = positions.withColumn("breaks", breaks).withColumn("run", F.sum("breaks").over(w).cast("bigint"))
    return runs.groupBy("qid", "doc_id", "run").agg(F.countDistinct("k").alias("n_terms"))


def bigram_pairs(positions: DataFrame) -> DataFrame:
    """(qid, doc_id, adjacent): whether any two neighbouring positions differ by one at most."""
    w = Window.partitionBy("qid", "doc_id").orderBy("pos", "k")
    near = positions.withColumn("near", F.coalesce(F.col("pos") - F.lag("pos").over(w) <= 1, F.lit(False)))
    return near.groupBy("qid", "doc_id").agg(F.bool_or("near").alias("adjacent"))


def spread(found: DataFrame) -> DataFrame:
    """(qid, doc_id, pos, k, tolerance) of matching postings."""
    return found.select("qid", "doc_id", "k", "tolerance", F.explode("position_v").alias("pos"))


def search(posts: DataFrame, terms: DataFrame, corpus_size: int | DataFrame, mode: str = "and", config: Config = Config(), df: DataFrame | None = None) -> DataFrame:
    """(qid, rank, doc_id, url, score) of the best documents of each query.

    posts: of the queries' terms at least. df: (token, df); counted from posts if not given.
    """
    size = corpus_size if isinstance(corpus_size, int) else corpus_size.count()
    vocab = df if df is not None else posts.groupBy("token").agg(F.count("*").alias("df"))
    known = terms.join(vocab, terms["term"] == vocab["token"]).select("qid", "k", "tolerance", "term", "df")
    known = known.withColumn("found", F.count("*").over(Window.partitionBy("qid")))
    # there are no more known terms than terms
    n_terms = terms.count()
    hits = matching(posts, known, config.most_postings if mode == "or" else -1, config, n_terms)
    hits = hits.withColumn("base", F.lit(config.tfidf_weight) * F.col("frequency") * F.log10(F.lit(float(size)) / F.col("df")) + tag_score(F.col("tags"), config.tag_weights, config.tag_weight))
    hits = hits.withColumn("depth", F.lit(config.depth_weight) / path_parts(F.coalesce("url", F.lit(""))))
    per = hits.groupBy("qid", "doc_id").agg(
        F.sum("base").alias("base"), F.count("*").alias("n"), F.max("found").alias("found"), F.max("depth").alias("depth"), F.max("url").alias("url"),
    )
    if mode == "and":
        per = per.where(F.col("n") == F.col("found"))
        times = F.greatest(F.col("found") - 1, F.lit(1))
    else:
        times = F.col("n")
    positions = spread(hits.where("found > 1"))
    if mode == "and":
        positions = positions.join(per.select("qid", "doc_id"), ["qid", "doc_id"], "left_semi")
    runs = phrase_runs(positions).join(sent(known.select("qid", "found").distinct(), n_terms, config), "qid").where(F.col("n_terms") >= F.col("found"))
    if config.compat_labels:
        runs = runs.where("found < 3")
    boost = runs.groupBy("qid", "doc_id").agg((F.count("*") * F.lit(config.run_weight)).alias("boost"))
    score = F.round(F.col("base") + times * F.col("depth") + F.coalesce("boost", F.lit(0.0)), 6)
    scored = per.join(boost, ["qid", "doc_id"], "left").select("qid", "doc_id", "url", score.alias("score"))
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= config.most_results).select("qid", "rank", "doc_id", "url", "score")


def page_of(results: DataFrame, page: int, size: int = 15) -> DataFrame:
    """The results of a page, from 1."""
    return results.where((F.col("rank") > (page - 1) * size) & (F.col("rank") <= page * size))


def page_label(results: DataFrame, page: int, size: int = 15) -> DataFrame:
    """(label, has_previous, has_next) of a page: "lo to hi", "0 to 0" without results."""
    low = (page - 1) * size
    high = F.least(F.lit(low + size), F.col("n"))
    label = F.concat(F.when(high > 0, F.lit(low + 1)).otherwise(0).cast("string"), F.lit(" to "), high.cast("string"))
    return results.agg(F.count("*").alias("n")).select(label.alias("label"), F.lit(low > 0).alias("has_previous"), (high < F.col("n")).alias("has_next"))

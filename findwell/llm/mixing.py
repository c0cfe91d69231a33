"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate, its target share of the rows over its
present share. A document is repeated as often as a Poisson variable of that mean
says, which inverts the distribution at a number hashed from seed and row, so the
same document gets the same copies on every run. A row is told from others by the
md5 of all its columns and, among equal rows, by a number. Copies are exploded and
dealt out over all partitions by a hash of seed, row and copy, and sorted by it
inside.

A rate over `PART_RATE` is the sum of equal parts with a number each, so the
table of a part's distribution stays short at any rate; its last entry is beyond
what 52 random bits can reach.

Defined results: a null source is a source of its own; rows with null or repeated
ids, and equal rows, are each decided on their own; null and empty texts are rows
like any other. A source without a weight gets none of the mix. A column of the
input named `copy` is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findwell.llm._rows import numbered
from findwell.session import saved

#: Largest rate of one Poisson variable, entries of its table.
PART_RATE, ENTRIES = 16.0, 120
#: Sources up to which the table of rates is sent to every task (about 1 KB each).
BROADCAST_SOURCES = 20_000
#: Rows of a source are dealt over so many keys where rates are joined by a shuffle.
SALTS = 64
#: Stands for null where columns are hashed.
_NULL = "\\N"


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the md5 of the parts, joined by colons."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: DataFrame | None = None, temperature: float = 2.0, epochs: float = 1.0, source_col: str = "source") -> DataFrame:
    """(source, rate): target share x rows x epochs / rows of the source.

    weights: rows (source, weight), in any scale; without it the weight of a
    source is its rows to the power 1 / temperature.
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        counts = counts.withColumn("weight", F.pow("n", F.lit(1.0 / temperature)))
    else:
        w = weights.groupBy(F.col("source").alias("named")).agg(F.sum("weight").alias("weight"))
        counts = counts.join(w, F.col("source").eqNullSafe(F.col("named"))).drop("named")
    counts = saved(counts, "source-counts")
    weight_sum, = counts.agg(F.sum("weight")).first()
    rows = docs.count()
    return counts.select("source", (F.col("weight") / F.lit(float(weight_sum or 1)) * F.lit(float(rows)) * F.lit(float(epochs)) / F.col("n")).alias("rate"))


def _with_table(rates: DataFrame) -> DataFrame:
    """Adds the number of parts and the distribution of a part: P(0), P(0 or 1), ..."""
    parts = F.greatest(F.ceil(F.col("rate") / PART_RATE), F.lit(1)).cast("int")
    rows = rates.withColumn("parts", parts).withColumn("part_rate", F.col("rate") / F.col("parts"))
    none = F.exp(-F.col("part_rate"))
    start = F.struct(none.alias("term"), F.array(none).alias("sums"))
    table = F.aggregate(
        F.sequence(F.lit(1), F.lit(ENTRIES - 1)),
        start,
        lambda acc, k: F.struct((acc["term"] * F.col("part_rate") / k).alias("term"), F.concat(acc["sums"], F.array(F.element_at(acc["sums"], -1) + acc["term"] * F.col("part_rate") / k)).alias("sums")),
        lambda acc: acc["sums"],
    )
    return rows.select(F.col("source").alias("mix_source"), F.col("parts").alias("mix_parts"), table.alias("mix_table"))


def row_key(columns: list[str]) -> Column:
    """md5 of all columns as text, joined by a separator; a column that is text is hashed first."""
    return F.md5(F.concat_ws("|", *(F.coalesce(F.md5(F.col(c).cast("string")), F.lit(_NULL)) for c in columns)))


def mix(docs: DataFrame, rates: DataFrame, seed: int = 7, source_col: str = "source", broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """The columns of `docs` and `copy` (1, 2, ...): each row as often as its source's rate says, in shuffled order."""
    docs = docs.drop("copy")
    columns = docs.columns
    rows = numbered(docs, row_key(sorted(columns)), "mix_row", "mix_nth")
    table = saved(_with_table(rates), "rates")
    if table.count() <= broadcast_sources:
        joined = rows.join(F.broadcast(table), F.col(source_col).eqNullSafe(F.col("mix_source")))
    else:
        # a hot source is spread over salts; each has the source's row
        salted = table.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = rows.withColumn("mix_own_salt", F.pmod(F.xxhash64("mix_row", "mix_nth"), F.lit(SALTS)).cast("int"))
        joined = own.join(salted, F.col(source_col).eqNullSafe(F.col("mix_source")) & (F.col("mix_own_salt") == F.col("mix_salt")))
    name, row, nth = F.lit(str(seed)), F.col("mix_row"), F.col("mix_nth")

    # numbers first, one for each part, so that a table's entries compare with a value
    numbers = F.transform(F.sequence(F.lit(1), F.col("mix_parts")), lambda part: uniform(name, row, nth, part))
    copies = F.aggregate(numbers, F.lit(0).cast("bigint"), lambda total, u: total + F.size(F.filter("mix_table", lambda p: p <= u)))
    counted = joined.withColumn("mix_copies", copies).where(F.col("mix_copies") > 0)
    exploded = counted.select(*columns, "mix_row", "mix_nth", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("mix_copies"))).alias("copy"))
    key = F.xxhash64(name, row, nth, F.col("copy"))
    return exploded.withColumn("mix_key", key).repartition("mix_key").sortWithinPartitions("mix_key").select(*columns, "copy")


def op7_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs, rates(docs, temperature=2.0), seed=7)


ORACLE_SQL = f"""
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, sqrt(n::DOUBLE) / (SELECT sum(sqrt(n::DOUBLE)) FROM n) * (SELECT sum(n) FROM n)::DOUBLE / n AS rate FROM n),
p AS (SELECT source, rate, greatest(ceil(rate / {PART_RATE}), 1)::INT AS parts FROM r),
t AS (SELECT source, parts, k, exp(-(rate / parts) + k * ln(rate / parts) - lgamma(k + 1.0)) AS term FROM p, range(0, {ENTRIES}) AS g(k)),
c AS (SELECT source, parts, k, sum(term) OVER (PARTITION BY source ORDER BY k) AS upto FROM t),
l AS (SELECT source, any_value(parts) AS parts, list(upto ORDER BY k) AS sums FROM c GROUP BY source),
k AS (
  SELECT *, md5(concat_ws('|', coalesce(md5(doc_id::VARCHAR), '\\N'), coalesce(md5(lang), '\\N'), coalesce(md5(n_chars::VARCHAR), '\\N'), coalesce(md5(source), '\\N'), coalesce(md5(text), '\\N'))) AS mix_row
  FROM documents
),
d AS (SELECT *, row_number() OVER (PARTITION BY mix_row) AS nth FROM k),
u AS (
  SELECT d.*, l.sums, q.part,
    (('0x' || substr(md5('7:' || mix_row || ':' || nth::VARCHAR || ':' || q.part::VARCHAR), 1, 13))::BIGINT + 0.5::DOUBLE) / {1 << 52}::DOUBLE AS x
  FROM d JOIN l ON d.source IS NOT DISTINCT FROM l.source, unnest(range(1, l.parts + 1)) AS q(part)
),
m AS (
  SELECT doc_id, text, lang, source, n_chars, sum(len(list_filter(sums, lambda s: s <= x)))::BIGINT AS copies
  FROM u GROUP BY doc_id, text, lang, source, n_chars, mix_row, nth
)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, copies + 1)) AS copy FROM m WHERE copies > 0
"""

"""Rows told apart, equal ones by numbers, without a task that holds all equals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findwell.session import saved

#: Rows of a table up to which it is sent to every task (some 50 bytes each).
BROADCAST_ROWS = 100_000
#: Parts that equal rows are dealt into where they are numbered.
SALTS = 64


def sent(small: DataFrame) -> DataFrame:
    """A saved table, sent to every task if its size allows."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def numbered(docs: DataFrame, key: Column, row: str, nth: str) -> DataFrame:
    """Adds `row`, the key, and `nth`: 1, 2, ... among rows of one key.

    Repeated keys are found by a count of keys alone. Their rows are written, dealt
    out by key and salt and numbered there, beginning after what the salts before hold.
    """
    salt, before = f"{row}_salt", f"{row}_before"
    keyed = docs.withColumn(row, key)
    again = saved(keyed.groupBy(row).agg(F.count("*").alias("n")).where("n > 1").select(row), "repeated-rows")
    one = F.lit(1).cast("bigint").alias(nth)
    if not again.count():
        return keyed.select("*", one)
    again = sent(again)
    many = saved(keyed.join(again, row, "left_semi").withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))), "equal-rows")
    upto = Window.partitionBy(row).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    held = many.groupBy(row, salt).agg(F.count("*").alias("n")).select(row, salt, F.coalesce(F.sum("n").over(upto), F.lit(0)).alias(before))
    own = F.row_number().over(Window.partitionBy(row, salt).orderBy(row))
    numbers = many.withColumn(nth, own).join(held, [row, salt]).select(*keyed.columns, (F.col(nth) + F.col(before)).alias(nth))
    return keyed.join(again, row, "left_anti").select(*keyed.columns, one).unionByName(numbers)

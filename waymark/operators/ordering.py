"""Places in an order within a key, for keys of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.session import cut, small


def dealt(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows in ranges of (key, order), each sorted, in the shared folder. Rows that are equal in all of these are told apart by
    where they are read, so that no range has to hold all of them, and a key with most of all rows fills many ranges."""
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [key, *order, "_tie"]
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    return cut(tied.repartitionByRange(ranges, *by).sortWithinPartitions(*by).drop("_tie"))


def positions(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """rows with their place among those of their key, from 0, nulls first: the place in a range, and what the ranges before hold.

    Only a count for each range and key is shuffled beside the rows themselves. A null key is a key.
    """
    number = F.monotonically_increasing_id()  # of a range and a row in it
    at = dealt(rows, key, order).withColumn("_n", number)
    at = at.withColumns({"_range": F.shiftright("_n", 33), "_row": F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_n")
    each = at.groupBy("_range", F.col(key).alias("_key")).agg(F.min("_row").alias("_first"), F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy("_key").orderBy("_range")) - F.col("_rows")
    shift = cut(each.select(F.col("_range").alias("_of"), "_key", (before - F.col("_first")).alias("_shift")))
    same = (F.col("_range") == F.col("_of")) & F.col(key).eqNullSafe(F.col("_key"))
    return at.join(small(shift, 100), same).withColumn(name, F.col("_row") + F.col("_shift")).drop("_range", "_row", "_of", "_key", "_shift")

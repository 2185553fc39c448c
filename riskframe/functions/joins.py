"""Joins of long rows with tables of one row a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a table's keys, and 50 more a row, up to which the whole table is handed to every task.
SMALL = 16_000_000


def parts(df: DataFrame) -> int:
    """Parts over which rows are dealt: as many as spark.sql.shuffle.partitions says."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def join_counted(rows: DataFrame, table: DataFrame, key: str, n: str) -> DataFrame:
    """rows joined by a text key with a stored table of one row a key; n is its column with the number of rows that hold the key.

    A small table goes to every task. Of a larger one only the keys do that hold a part's share of all rows or more, of which there are no more than parts; their rows stay where they are. All other rows are
    dealt by key over parts that aren't merged: names compress so well that parts merged by bytes would hold many times more of them.
    """
    size = table.agg(F.sum(F.octet_length(key) + 50)).first()[0] or 0
    if size <= SMALL:
        return rows.join(F.broadcast(table), key)
    k = parts(rows)
    often = table.join(F.broadcast(table.agg(F.sum(n).alias("__all")))).where(F.col(n) * k >= F.col("__all")).drop("__all")
    rest = rows.join(F.broadcast(often.select(key)), key, "left_anti").repartition(k, key)
    return rows.join(F.broadcast(often), key).unionByName(rest.join(table, key))

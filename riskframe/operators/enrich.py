"""Enrichment of records across related tables, as joins over long feature triples (entity, feature, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import saved


def split_labels(triples: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """(features, labels): labels are the features whose name starts with prefix."""
    is_label = F.startswith(F.col("feature"), F.lit(prefix))
    return triples.where(~is_label), triples.where(is_label)


def join_ids(records: DataFrame, key: str, ids_col: str, children: DataFrame, child_key: str) -> DataFrame:
    """key, pos and the child's columns for each id of a list that exists; the list's order and repeats are kept."""
    listed = records.select(key, F.posexplode(ids_col).alias("pos", "__id"))
    return listed.join(children, listed["__id"] == children[child_key]).drop("__id")


def two_hops(records: DataFrame, key: str, ids_col: str, middle: DataFrame, middle_key: str, middle_ids: str, last: DataFrame, last_key: str) -> DataFrame:
    """key, pos, pos2 and the last table's columns over two lists of ids; repeats are kept."""
    first = join_ids(records, key, ids_col, middle.select(middle_key, middle_ids), middle_key)
    second = first.select(key, "pos", F.posexplode(middle_ids).alias("pos2", "__id"))
    return second.join(last, second["__id"] == last[last_key]).drop("__id")


def place(*pos: Column) -> Column:
    """One or two positions of lists as a long in their order."""
    return pos[0].cast("long") if len(pos) == 1 else F.shiftleft(pos[0].cast("long"), 32) + pos[1].cast("long")


def fold(rows: DataFrame, key: list[str], pos: str, value: str, enum: Column | None = None) -> DataFrame:
    """One value a key: values of enumerations (rows where `enum` holds; all without it; the same for all rows of a key) fold in order of pos, others are summed.

    The ordered fold: 0 takes the value; 1 stays 1 under 0 or 1; else the value is added. So ones before the first value that is neither 0 nor 1 fold to 1, zeros change nothing, and from that
    value on all is added: the fold is the sum from that value on, and 1 more if a one stands before it. These are plain aggregates that combine before the shuffle, and no key gathers its rows; only
    keys that have such a value meet their rows a second time; one row a key is written before, so that rows are not made again where there is none. A pos of a plain type (place() of two) is
    aggregated by hash; an array is sorted. Values are 0 or more (a sum of fractions that comes to 1 goes on as a number); a null value makes a fold null and counts as
    nothing in a sum. Positions of a key are distinct.
    """
    v = F.col(value).cast("double")
    enum = F.lit(True) if enum is None else enum
    other = ~F.coalesce(v.isin(0.0, 1.0), F.lit(False))
    top = rows.groupBy(*key).agg(
        F.max(enum).alias("__enum"), F.max(v).alias("__top"), F.sum(v).alias("__sum"), F.min(F.when(enum & other, F.col(pos))).alias("__from"), F.max(v.isNull()).alias("__null")
    )
    top = saved(top, "folded")
    plain = top.where("__from is null").select(*key, F.when(F.col("__enum"), F.col("__top")).otherwise(F.col("__sum")).alias("value"))
    again = top.where("__from is not null").select(*key, "__from", "__null")
    if again.isEmpty():
        return plain
    late = F.col(pos) >= F.col("__from")
    met = rows.join(again, key)
    summed = met.groupBy(*key, "__null").agg(F.sum(F.when(late, v)).alias("__sum"), F.max(F.when(~late & (v == 1), 1.0).otherwise(0.0)).alias("__one"))
    return plain.unionByName(summed.select(*key, F.when(~F.col("__null"), F.col("__sum") + F.col("__one")).alias("value")))


def enum_fold(rows: DataFrame, key: list[str], pos: str, value: str) -> DataFrame:
    """The ordered fold of fold()."""
    return fold(rows, key, pos, value)


def numeric_fold(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.sum(value).alias("value"))


def prefixed(triples: DataFrame, prefix: str) -> DataFrame:
    return triples.withColumn("feature", F.concat(F.lit(prefix), F.col("feature")))


def label_any(records: DataFrame, key: str, events: DataFrame, event_key: str, **conditions: Column) -> DataFrame:
    """records' keys with a 0/1 label for each condition that any of its events meets."""
    seen = events.groupBy(F.col(event_key).alias("__key")).agg(*(F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(n) for n, c in conditions.items()))
    ids = records.select(key).distinct()
    return ids.join(seen, ids[key] == seen["__key"], "left").select(key, *(F.coalesce(n, F.lit(0)).alias(n) for n in conditions))


def earliest_dates(rows: DataFrame, key: str, family_col: str, date_col: str, families: list[str]) -> DataFrame:
    """key and the earliest date of each family."""
    return rows.groupBy(key).agg(*(F.min(F.when(F.col(family_col) == f, F.col(date_col))).alias(f"first_{f}") for f in families))


def day_deltas(base: Column, **dates: Column) -> dict[str, Column]:
    """Days from the base date to each date; 0 where either is missing."""
    return {f"delta_days_{n}": F.coalesce(F.datediff(d, base), F.lit(0)) for n, d in dates.items()}


def to_map(triples: DataFrame, key: str, name: str) -> DataFrame:
    """One row a key with a map feature -> value."""
    return triples.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", "value")))).alias(name))

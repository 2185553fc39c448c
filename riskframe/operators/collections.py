"""Collections as DataFrames: upsert, lookup, update, registry, membership, references, metadata."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskframe.storage import read_manifest, removed, saved, write_manifest


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key by `order`. The rank filter is applied before the shuffle too."""
    ranked = df.withColumn("__rank", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    return ranked.where("__rank = 1").drop("__rank")


def upsert(target: DataFrame, updates: DataFrame, key: str, order_col: str) -> DataFrame:
    """Rows of both by key, the one with the largest order_col winning and updates winning ties. Rows without a key are all kept."""
    both = target.withColumn("__new", F.lit(0)).unionByName(updates.withColumn("__new", F.lit(1)))
    keyed = latest(both.where(F.col(key).isNotNull()), key, F.desc(order_col), F.desc("__new"))
    return keyed.unionByName(both.where(F.col(key).isNull())).drop("__new")


def attach_membership(items: DataFrame, groups: DataFrame, item_key: str, member_col: str, order_col: str, as_: str) -> DataFrame:
    """items with the struct of the group that lists them last (by order_col), or null. groups: one row with a list of members each."""
    fields = [c for c in groups.columns if c != member_col]
    member = groups.select(F.explode(member_col).alias("__member"), F.struct(*fields).alias(as_), F.col(order_col).alias("__order"))
    last = member.groupBy("__member").agg(F.max_by(as_, "__order").alias(as_))
    return items.join(last, items[item_key] == last["__member"], "left").drop("__member")


def resolve_refs(items: DataFrame, refs: DataFrame, item_key: str, ids_col: str, ref_key: str, as_: str) -> DataFrame:
    """(item_key, as_): list of ids replaced by the matching records in list order; unmatched ids go, as do items left with none."""
    listed = items.select(item_key, F.posexplode(ids_col).alias("__pos", "__id"))
    record = refs.dropDuplicates([ref_key]).select(F.col(ref_key).alias("__id"), F.struct(*refs.columns).alias("__ref"))
    met = listed.join(record, "__id").groupBy(item_key).agg(F.array_sort(F.collect_list(F.struct("__pos", "__ref"))).alias("__all"))
    return met.select(item_key, F.transform("__all", lambda x: x["__ref"]).alias(as_))


def source_metadata(df: DataFrame, source_col: str, **aggregates: Column) -> DataFrame:
    """One row a source: number of rows and the given aggregates."""
    return df.groupBy(source_col).agg(F.count(F.lit(1)).alias("data_count"), *(c.alias(n) for n, c in aggregates.items()))


def registry(*families: tuple[str, DataFrame, str]) -> DataFrame:
    """(family, id), distinct: ids known to any of the (family, frame, column)."""
    parts = [df.select(F.lit(name).alias("family"), F.col(col).cast("string").alias("id")) for name, df, col in families]
    return reduce(DataFrame.unionByName, parts).where("id is not null").distinct()


def find(df: DataFrame, where: Column | None = None, select: list[str] | None = None, order: list | None = None, limit: int = 0) -> DataFrame:
    """Filter, projection, sort and limit; filter and projection reach the scan."""
    df = df if where is None else df.where(where)
    df = df if select is None else df.select(*select)
    df = df if order is None else df.orderBy(*order)
    return df.limit(limit) if limit else df


def find_one(df: DataFrame, col: str, value) -> DataFrame:
    return find(df, F.col(col) == value, limit=1)


def update(df: DataFrame, where: Column, set_: dict[str, Column] | None = None, push: dict[str, Column] | None = None) -> DataFrame:
    """Set fields and append to arrays on the rows that match."""
    hit = F.coalesce(where, F.lit(False))
    new = {c: F.when(hit, v).otherwise(F.col(c)) for c, v in (set_ or {}).items()}
    new |= {c: F.when(hit, F.array_append(c, v)).otherwise(F.col(c)) for c, v in (push or {}).items()}
    return df.withColumns(new)


def claim(df: DataFrame, key: Column, stamp: Column, started_col: str = "started_at") -> DataFrame:
    """Set started_col on matching rows where it is null."""
    return update(df, key & F.col(started_col).isNull(), {started_col: stamp})


def delete_by_key(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(~F.col(key).eqNullSafe(F.lit(value)))


def pending_ids(known: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Ids known but not done."""
    return known.select(key).distinct().join(done.select(key), key, "left_anti")


def require_tables(tables: dict[str, DataFrame | None], needed: list[str]) -> None:
    """Raise if a needed table is missing."""
    missing = [n for n in needed if tables.get(n) is None]
    if missing:
        raise ValueError(f"missing tables: {', '.join(missing)}")


def export_tables(tables: dict[str, tuple[DataFrame, str]], path: str) -> None:
    """Each table as JSON lines under path, with its schema and key column in a manifest."""
    spark = next(iter(tables.values()))[0].sparkSession
    for name, (df, _) in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
    rows = [(name, key, df.schema.json()) for name, (df, key) in tables.items()]
    spark.createDataFrame(rows, "name string, key string, schema string").coalesce(1).write.mode("overwrite").json(f"{path}/_manifest")


def import_tables(spark, path: str) -> dict[str, tuple[DataFrame, str]]:
    """Tables of an export, by name, with their key columns."""
    from pyspark.sql.types import StructType
    import json

    found = {}
    for r in spark.read.json(f"{path}/_manifest").collect():
        found[r.name] = (spark.read.schema(StructType.fromJson(json.loads(r.schema))).json(f"{path}/{r.name}"), r.key)
    return found


def open_tables(spark, target: str) -> dict[str, tuple[DataFrame, str]]:
    """Tables of a target that restore_tables has written, by name, with their key columns."""
    from pyspark.sql.types import StructType
    import json

    live = read_manifest(spark, target)[1]
    return {name: (spark.read.schema(StructType.fromJson(json.loads(t["schema"]))).parquet(f"{target}/{t['path']}"), t["key"]) for name, t in live.items()}


def restore_tables(spark, path: str, target: str) -> dict[str, tuple[DataFrame, str]]:
    """Merge an export into the tables of a target, which may have another name and hold tables already; the target's tables afterwards.

    Each table is merged by its recorded key: exported rows take the place of those with the same key (of several in the export, one), other rows stay, rows without a key are added. Columns that one side
    lacks are null. All tables are written first and then named by one manifest: a restore that fails leaves the target as it was, and one that is run again merges the same rows. Tables of
    the manifest before it are kept, older ones removed.
    """
    n, live = read_manifest(spark, target)
    before, n = read_manifest(spark, target, 1)[1], 0 if n is None else n + 1
    now, there = dict(live), open_tables(spark, target)
    for name, (df, key) in import_tables(spark, path).items():
        rows = df.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(df.where(F.col(key).isNull()))
        if name in there:
            old = there[name][0]
            rows = old.join(df.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)
        at = f"{name}/{n}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{target}/{at}")
        now[name] = {"path": at, "key": key, "schema": rows.schema.json()}
    write_manifest(spark, target, n, now)
    named = {t["path"] for m in (live, now) for t in m.values()}
    removed(spark, *(f"{target}/{t['path']}" for t in before.values() if t["path"] not in named))
    return open_tables(spark, target)


def with_index(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """df with a dense row number from 0 in a total order, without passing all rows through one task.

    Rows are ranged by the order and written once with the number of their range, so that counts and rows come from the same ranges
    (range bounds are sampled anew each time a plan runs). Each range is numbered by itself and shifted by the rows in the ranges before it.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = saved(ranged.withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "indexed")
    count = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    shift = count.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    return ranged.join(F.broadcast(shift), "__part").withColumn(name, F.col("__row") + F.col("__shift")).drop("__part", "__row", "__shift")


def with_running_sums(df: DataFrame, sums: dict[str, str], *order: str | Column) -> DataFrame:
    """df with running sums in order (names of the new columns by column; a row's own value included) and, as `<name>_total`, the sums over all rows. Ranges are summed by
    themselves and shifted by the totals of those before, so no task sees all rows."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = saved(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ranged")
    total = ranged.groupBy("__part").agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    before, every = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1), W.partitionBy()  # one row a range
    shift = total.select("__part", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__{n}") for n in sums), *(F.sum(n).over(every).alias(f"{n}_total") for n in sums))
    inside = W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    found = ranged.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()}).join(F.broadcast(shift), "__part")
    return found.withColumns({n: F.col(n) + F.col(f"__{n}") for n in sums}).drop("__part", *(f"__{n}" for n in sums))


def with_carried(df: DataFrame, carried: dict[str, Column], *order: str | Column) -> DataFrame:
    """df with, for each name, the last value in order (a row's own included) that isn't null. Ranges of the order carry by themselves; what a range begins with comes from the ranges before it, one row
    each, so no task sees all rows."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumns({f"__{n}": c for n, c in carried.items()}).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = saved(ranged.withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}), "carried")
    ends = ranged.groupBy("__part").agg(*(F.max_by(f"__{n}", F.when(F.col(f"__{n}").isNotNull(), F.col("__row"))).alias(f"__end_{n}") for n in carried))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    begin = ends.select("__part", *(F.last(f"__end_{n}", ignorenulls=True).over(before).alias(f"__begin_{n}") for n in carried))
    inside = W.partitionBy("__part").orderBy("__row").rowsBetween(W.unboundedPreceding, 0)
    found = ranged.withColumns({n: F.last(f"__{n}", ignorenulls=True).over(inside) for n in carried}).join(F.broadcast(begin), "__part")
    return found.withColumns({n: F.coalesce(n, f"__begin_{n}") for n in carried}).drop("__part", "__row", *(f"__{n}" for n in carried), *(f"__begin_{n}" for n in carried))


def with_group_index(df: DataFrame, name: str, group: list[str], *order: str | Column) -> DataFrame:
    """df with a dense row number from 0 inside each group (nulls are one group), with the group's rows as `<name>_of` and the number among all rows, in order of group, as `<name>_row`. A group's rows may stand in many ranges: they are numbered with all others, and
    each group's first number is taken off."""
    at = f"{name}_row"
    ranged = with_index(df, at, *group, *order)
    first = ranged.groupBy(*(F.col(g).alias(f"__g{k}") for k, g in enumerate(group))).agg(F.min(at).alias("__first"), F.count(F.lit(1)).alias(f"{name}_of"))
    if not group:
        met = ranged.join(F.broadcast(first))
    else:
        same = F.lit(True)
        for k, g in enumerate(group):
            same = same & ranged[g].eqNullSafe(first[f"__g{k}"])
        met = ranged.join(first, same).drop(*(f"__g{k}" for k in range(len(group))))
    return met.withColumn(name, F.col(at) - F.col("__first")).drop("__first")


def next_id(df: DataFrame, key: str) -> DataFrame:
    """One row, next: the largest id and one; 1 without ids."""
    return df.agg((F.coalesce(F.max(key), F.lit(0)) + 1).alias("next"))

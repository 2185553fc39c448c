"""Merging records of several sources and flattening nested ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def merge_sources(ids: DataFrame, sources: dict[str, DataFrame], key: str, per_source: tuple[str, ...] = ()) -> DataFrame:
    """One record an id from sources in rising priority: of fields with one name the last source that has a value wins; fields in
    per_source are kept apart with the source's name as suffix. Ids that no source has are dropped."""
    fields: dict[str, list[Column]] = {}
    out = ids.select(key).distinct()
    for name, df in sources.items():
        renamed = df.select(F.col(key), F.lit(True).alias(f"__{name}"), *(F.col(c).alias(f"{c}_{name}" if c in per_source else f"__{name}_{c}") for c in df.columns if c != key))
        out = out.join(renamed, key, "left")
        for c in df.columns:
            if c != key:
                fields.setdefault(f"{c}_{name}" if c in per_source else c, []).insert(0, F.col(f"{c}_{name}" if c in per_source else f"__{name}_{c}"))
    out = out.where(reduce(Column.__or__, (F.col(f"__{n}").isNotNull() for n in sources)))
    return out.select(key, *(F.coalesce(*cols).alias(n) for n, cols in fields.items()))


def merge_references(df: DataFrame, key: str, *lists: str, generic: str = "URL") -> DataFrame:
    """(key, pos, url, tags): entries {url, tags} of several lists in order, one a trimmed url at its first place, tags united and sorted;
    the generic tag goes where there are others."""
    entry = df.select(key, F.posexplode(F.concat(*(F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType)) for c in lists))).alias("pos", "e"))
    entry = entry.select(key, "pos", F.trim("e.url").alias("url"), F.col("e.tags").alias("tags"))
    one = entry.groupBy(key, "url").agg(F.min("pos").alias("pos"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"))
    return one.withColumn("tags", F.when(F.size("tags") > 1, F.array_remove("tags", generic)).otherwise(F.col("tags")))


def merge_text(*texts: Column) -> Column:
    """Distinct trimmed texts, non-empty, in order, one a line."""
    trimmed = F.transform(F.array(*texts), lambda x: F.replace(F.trim(x), F.lit("&quot;"), F.lit('"')))
    return F.array_join(F.array_distinct(F.filter(trimmed, lambda x: x.isNotNull() & (x != ""))), "\n")


def drop_reserved(df: DataFrame, text_col: str, marker: str = "** RESERVED **") -> DataFrame:
    return df.where(~F.coalesce(F.contains(F.col(text_col), F.lit(marker)), F.lit(False)))


def phase_dates(col: str) -> dict[str, Column]:
    """`Assigned (20200131)` -> phase, and one date column for each of the four phases."""
    name, day = F.regexp_extract(col, r"^(\w+) \((\d{8})\)", 1), F.regexp_extract(col, r"\((\d{8})\)", 1)
    date = F.when(day != "", F.to_date(day, "yyyyMMdd"))
    phases = {p: F.when(F.lower(name) == p, date) for p in ("assigned", "proposed", "modified", "interim")}
    return {"phase": F.when(name != "", name)} | phases


def numeric_ids(values: Column, prefix: str) -> Column:
    """Sorted distinct ids n of the values `prefix-n`, numeric ones only."""
    ids = F.transform(values, lambda v: F.substring_index(v, "-", -1))
    return F.array_sort(F.array_distinct(F.filter(ids, lambda x: x.rlike("^[0-9]+$"))))


def cpe_names(uris: Column) -> tuple[Column, Column]:
    """Vendors and products (4th and 5th part, lower case, distinct, without `*`) of platform URIs."""
    part = lambda k: F.array_remove(F.array_distinct(F.transform(uris, lambda u: F.lower(F.split_part(u, F.lit(":"), F.lit(k))))), "*")
    return part(4), part(5)


def explode_cpes(nodes: Column) -> tuple[Column, Column]:
    """Vulnerable and other URIs of a two-level tree: matches of each node and of its children."""
    match = F.concat(
        F.flatten(F.transform(nodes, lambda n: F.coalesce(n["cpe_match"], F.array()))),
        F.flatten(F.transform(F.flatten(F.transform(nodes, lambda n: F.coalesce(n["children"], F.array()))), lambda c: F.coalesce(c["cpe_match"], F.array()))),
    )
    uri = lambda keep: F.array_distinct(F.transform(F.filter(match, keep), lambda m: m["cpe23Uri"]))
    return uri(lambda m: m["vulnerable"]), uri(lambda m: ~m["vulnerable"])


def project_severity(v2: dict[str, Column], v3: dict[str, Column]) -> dict[str, Column]:
    """Fields of both severities; version 3 wins where it has a value."""
    return {n: F.coalesce(*(s[n] for s in (v3, v2) if n in s)) for n in [*v2, *(k for k in v3 if k not in v2)]}


def coalesce_upper(first: Column, other: Column) -> Column:
    """The first value, else the other in upper case with `Not required` as NONE."""
    return F.coalesce(first, F.upper(F.replace(other, F.lit("Not required"), F.lit("NONE"))))


def any_date(text: Column) -> Column:
    """The day of a text in either way that feeds write it (2020-01-31, also with a time after it, or 31/01/2020); null of any other."""
    day = F.trim(F.substring(F.trim(text.cast("string")), 1, 10))
    return F.coalesce(*(F.try_to_timestamp(day, F.lit(f)) for f in ("yyyy-MM-dd", "dd/MM/yyyy"))).cast("date")


def date_extremes(published: list[Column], modified: list[Column]) -> dict[str, Column]:
    """publishedDate, the oldest, and lastModifiedDate, the newest day of several sources' dates; sources without one don't count, and without any it is null."""
    days = lambda cols: F.array(*(c.cast("date") for c in cols))
    return {"publishedDate": F.array_min(days(published)), "lastModifiedDate": F.array_max(days(modified))}


def after_first(col: Column, mark: str = "-") -> Column:
    """What stands right of the first mark, trimmed; the whole text without one."""
    return F.trim(F.when(F.instr(col, mark) > 0, F.substr(col, F.instr(col, mark) + F.lit(len(mark)))).otherwise(col))


def type_histogram(df: DataFrame, key: str, kind: Column, keys: DataFrame | None = None) -> DataFrame:
    """key, types, counts: two parallel arrays by type; null types count as `other`. keys (a column `key`): those without rows get [absent] and [0]."""
    n = df.groupBy(key, F.coalesce(kind, F.lit("other")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    both = n.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("kind", "n"))).alias("all"))
    found = both.select(key, F.col("all.kind").alias("types"), F.col("all.n").alias("counts"))
    if keys is None:
        return found
    none = {"types": F.array(F.lit("absent")), "counts": F.array(F.lit(0).cast("long"))}
    return keys.select(key).distinct().join(found, key, "left").select(key, *(F.coalesce(n, v).alias(n) for n, v in none.items()))


def sum_versions(counts: Column) -> Column:
    """Sum of version counts written as texts or numbers; what isn't a number counts 0."""
    return F.aggregate(F.transform(counts, lambda c: F.coalesce(c.cast("string").try_cast("long"), F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, c: a + c)


def count_parts(col: Column, mark: str = "|") -> Column:
    return F.when(col.isNull(), F.lit(0)).otherwise(F.size(F.split(col, "[" + mark + "]")))


def assert_flat(schema: T.StructType, exempt: tuple[str, ...] = ()) -> None:
    """Raise unless every field is a scalar or a list of scalars (exempt fields: also lists of lists)."""
    nested = (T.StructType, T.MapType, T.ArrayType)
    for f in schema.fields:
        kind = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
        if isinstance(kind, nested) and not (f.name in exempt and isinstance(kind, T.ArrayType)):
            raise ValueError(f"{f.name} is not flat: {f.dataType.simpleString()}")


def pivot_relations(df: DataFrame, key: str, nature_col: str, target_col: str, natures: list[str]) -> DataFrame:
    """key and one sorted array of targets for each nature."""
    return df.groupBy(key).pivot(nature_col, natures).agg(F.array_sort(F.collect_set(target_col)))


def flatten_oval(df: DataFrame) -> DataFrame:
    """Definitions with a record reference: oval (short id), CVE (the first one's), type, submittedDate, modifiedDate (newest)."""
    cve = F.filter("reference", lambda r: r["source"] == "CVE")
    day = lambda c: F.to_date(F.substring(c, 1, 10))
    return df.select(
        F.element_at(F.split("oval", ":"), -1).alias("oval"), F.get(cve, F.lit(0))["ref_id"].alias("CVE"), F.col("class").alias("type"),
        day("submitted").alias("submittedDate"), F.array_max(F.transform("modified", day)).alias("modifiedDate"),
    ).where("CVE is not null")

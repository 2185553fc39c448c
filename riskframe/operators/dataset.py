"""Dataset preparation: selections, encodings, splits, folds, balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .collections import with_index


def load_by_group(df: DataFrame, group: Column, groups: list, order: str, limit: int = 0) -> DataFrame:
    """Rows of the groups, at most `limit` (0: all) a group in order. The limit is applied before the shuffle too."""
    chosen = df.withColumn("grp", group).where(F.col("grp").isin(groups))
    if not limit:
        return chosen
    return chosen.withColumn("__rank", F.row_number().over(W.partitionBy("grp").orderBy(order))).where(F.col("__rank") <= limit).drop("__rank")


def parse_selection(text: Column) -> tuple[Column, Column]:
    """`y1,y2:limit` -> (years, limit or 0)."""
    return F.split(F.split_part(text, F.lit(":"), F.lit(1)), ",").cast("array<int>"), F.coalesce(F.expr("try_cast(null as int)"), F.nullif(F.split_part(text, F.lit(":"), F.lit(2)), F.lit("")).cast("int"), F.lit(0))


def slice_groups(vector: Column, ranges: list[tuple[int, int]]) -> list[Column]:
    """Parts [from, to) of an array; to = -1 is the end."""
    return [F.slice(vector, a + 1, (F.size(vector) if b < 0 else F.lit(b)) - a) for a, b in ranges]


def label_codes(df: DataFrame, col: str) -> DataFrame:
    """(label, code): codes from 0 in order of the labels."""
    labels = df.select(F.col(col).alias("label")).where("label is not null").distinct()
    return labels.withColumn("code", F.row_number().over(W.orderBy("label")) - 1)  # one row a class


def encode_label(code: Column, encoding: str, largest: int) -> Column:
    """A code as an array: incremental, incremental+1, binary, binary+1, sparse, distinct-sparse, distinct-sparse+1 or exponential."""
    bits = max(1, (largest + 1).bit_length() if encoding.endswith("+1") else largest.bit_length())
    value = code + 1 if encoding.endswith("+1") else code
    kind = encoding.removesuffix("+1")
    if kind == "incremental":
        return F.array(value.cast("int"))
    if kind == "binary":
        return F.array(*(F.shiftright(value.cast("int"), k).bitwiseAND(F.lit(1)) for k in range(bits - 1, -1, -1)))
    if kind == "exponential":
        return F.array(F.pow(F.lit(2), code).cast("int"))
    width = largest + 1
    if kind == "sparse":
        return F.array(*((code == k).cast("int") for k in range(width)))
    return F.array(*(F.when(code == k, value.cast("int")).otherwise(0) for k in range(width)))


def one_vs_rest(df: DataFrame, label_col: str, label, absent) -> DataFrame:
    """Rows of the label keep it, the others get `absent`; is_match tells them apart."""
    hit = F.col(label_col).eqNullSafe(F.lit(label))
    return df.withColumn("is_match", hit.cast("int")).withColumn(label_col, F.when(hit, F.col(label_col)).otherwise(F.lit(absent)))


def vector_ranges(df: DataFrame, vector: str) -> DataFrame:
    """One row: arrays low and high, by position."""
    at = df.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    both = at.groupBy().agg(F.array_sort(F.collect_list(F.struct("pos", "low", "high"))).alias("r"))
    return both.select(F.col("r.low").alias("low"), F.col("r.high").alias("high"))


def normalize_vectors(df: DataFrame, vector: str) -> DataFrame:
    """Min-max scaling by position; null where a position is constant. The ranges are one row of the vector's length."""
    scaled = F.expr(f"transform({vector}, (x, i) -> if(high[i] = low[i], null, (double(x) - double(low[i])) / (double(high[i]) - double(low[i]))))")
    return df.join(F.broadcast(vector_ranges(df, vector))).withColumn(vector, scaled).drop("low", "high")


def shuffle_rows(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows in an order drawn by hash: the same for any partitioning."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)


def split_at(df: DataFrame, share: float, *order: str) -> DataFrame:
    """df with part: `head` for the first floor(n * share) rows, else `tail`."""
    n = df.groupBy().agg(F.floor(F.count(F.lit(1)) * share).alias("__cut"))
    return with_index(df, "__at", *order).join(F.broadcast(n)).withColumn("part", F.when(F.col("__at") < F.col("__cut"), "head").otherwise("tail")).drop("__at", "__cut")


def balance_classes(df: DataFrame, label: str, *order: str) -> DataFrame:
    """The first rows of each class, as many as the smallest class has. Ranks run within (class, hash range) first, so a large class is
    many tasks."""
    count = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    least = count.groupBy().agg(F.min("n").alias("__least"))
    ranked = with_index(df, "__at", label, *order)
    first = ranked.groupBy(label).agg(F.min("__at").alias("__first"))
    return ranked.join(F.broadcast(least)).join(F.broadcast(first), label).where(F.col("__at") - F.col("__first") < F.col("__least")).drop("__at", "__first", "__least")


def kfold(df: DataFrame, k: int, *order: str) -> DataFrame:
    """df with fold (0 to k-1): equal runs of rows in order."""
    n = df.groupBy().agg(F.count(F.lit(1)).alias("__n"))
    return with_index(df, "__at", *order).join(F.broadcast(n)).withColumn("fold", F.least(F.floor(F.col("__at") * k / F.col("__n")), F.lit(k - 1)).cast("int")).drop("__at", "__n")


def rolling_folds(df: DataFrame, folds: int, *order: str, least_window: int = 1) -> DataFrame:
    """(row's columns, fold, role): training is all before a fold's start, validation the window after it. Starts run from half the rows on and
    are pulled back where the window would pass the end."""
    n = df.groupBy().agg(F.count(F.lit(1)).alias("n"))
    window = F.greatest(F.floor(F.col("n") / 2 / folds), F.lit(least_window))
    start = n.withColumn("window", window).select("n", "window", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    start = start.select("fold", "window", F.least(F.floor(F.col("n") / 2) + F.col("fold") * F.col("window"), F.col("n") - F.col("window")).alias("start"))
    both = with_index(df, "__at", *order).join(F.broadcast(start), F.col("__at") < F.col("start") + F.col("window"))
    return both.withColumn("role", F.when(F.col("__at") < F.col("start"), "train").otherwise("validate")).drop("__at", "start", "window")


def assign_batches(df: DataFrame, size: int, *order: str) -> DataFrame:
    return with_index(df, "__at", *order).withColumn("batch", F.floor(F.col("__at") / size)).drop("__at")


def vocabulary(triples: DataFrame) -> DataFrame:
    """(feature, at): places of the features by name, from 0."""
    return with_index(triples.select("feature").distinct(), "at", "feature")


def to_vector(triples: DataFrame, places: DataFrame, key: str = "entity") -> DataFrame:
    """key and features: array of the values at their places (vocabulary), 0 where there is none. Features without a place are left out."""
    width = places.agg((F.max("at") + 1).alias("__n"))
    met = triples.join(places, "feature").groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("at", "value"))).alias("m"))
    return met.join(F.broadcast(width)).select(key, F.transform(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1), lambda k: F.coalesce(F.element_at("m", k), F.lit(0.0))).alias("features"))


def load_dataset(data: DataFrame, year: Column, years: list[int], key: str = "entity", limit: int = 0, label_prefix: str = "exploits_", label: str = "exploits_has") -> DataFrame:
    """key, grp (year), features (array in order of the names) and label of the records of the years, at most `limit` (0: all) a year in order of the key. data has
    the maps features and labels; a feature that names a label is an error."""
    chosen = load_by_group(data, year, years, key, limit)
    leak = F.exists(F.map_keys("features"), lambda f: F.startswith(f, F.lit(label_prefix)))
    vector = F.transform(F.array_sort(F.map_keys("features")), lambda f: F.element_at("features", f))
    return chosen.select(key, "grp", F.when(leak, F.raise_error(F.lit("a label stands among the features")).cast("array<double>")).otherwise(vector).alias("features"), F.coalesce(F.element_at("labels", F.lit(label)), F.lit(0.0)).cast("int").alias("label"))


def load_grouped(triples: DataFrame, group: Column, groups: int = 5, key: str = "entity") -> DataFrame:
    """key and one array of values for each group 0 to groups - 1, in order of the names (columns group_0, ...)."""
    entry = F.struct("feature", "value")
    listed = triples.withColumn("__g", group).groupBy(key).agg(*(F.array_sort(F.collect_list(F.when(F.col("__g") == g, entry))).alias(f"__{g}") for g in range(groups)))
    return listed.select(key, *(F.transform(f"__{g}", lambda e: e["value"]).alias(f"group_{g}") for g in range(groups)))


def decode_label(df: DataFrame, code: str, codes: DataFrame, absent: str = "Abscent") -> DataFrame:
    """df with label: the label of the code, `absent` where it has none. codes: code, label; the table is small (one row a class)."""
    table = codes.select(F.col("code").alias("__code"), F.col("label").alias("__label"))
    return df.join(table, df[code] == table["__code"], "left").withColumn("label", F.coalesce("__label", F.lit(absent))).drop("__code", "__label")


def decode_pair(df: DataFrame, vector: str, first: DataFrame, second: DataFrame, absent: str = "Abscent") -> DataFrame:
    """df with label, of a one-hot vector over two tables of codes, the second after the first; a vector of zeros or a place beyond both is `absent`."""
    size = first.agg(F.count(F.lit(1)).alias("__n"))
    both = first.select("code", "label").unionByName(second.join(F.broadcast(size)).select((F.col("code") + F.col("__n")).alias("code"), "label"))
    place = F.array_position(F.col(vector), F.array_max(vector)) - 1
    marked = df.withColumn("__place", F.when(F.array_max(vector) > 0, place))
    return decode_label(marked, "__place", both, absent).drop("__place")

"""Column statistics over feature triples, filtering and normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import join_counted, parts
from ..storage import saved
from .collections import with_index


def total_entries(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.countDistinct(key).alias("total"))


#: Families of features that hang on a record; all other features are its own. An enumeration's features (`_enum_`) are written where they aren't 0; every entity that has any feature of
#: the family has read the enumeration, and its other words are implied zeros.
FAMILIES = ("cwe_", "capec_")


def family(feature: Column, families: tuple[str, ...] = FAMILIES) -> Column:
    """The prefix of a feature's family; empty for the entity's own."""
    out = F.lit("")
    for f in families:
        out = F.when(F.startswith(feature, F.lit(f)), f).otherwise(out)
    return out


def is_enum(feature: Column) -> Column:
    return F.contains(feature, F.lit("_enum_"))


def readers(triples: DataFrame, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """(family, read): entities that have any feature of a family."""
    return triples.groupBy(family(F.col("feature"), families).alias("family")).agg(F.countDistinct("entity").alias("read"))


def _implied(by_feature: DataFrame, read: DataFrame, families: tuple[str, ...]) -> DataFrame:
    """by_feature (feature, n, ...) with zeros: implied ones. read has one row a family."""
    known = by_feature.withColumn("__family", family(F.col("feature"), families)).join(F.broadcast(read.withColumnRenamed("family", "__family")), "__family")
    return known.withColumn("zeros", F.when(is_enum(F.col("feature")), F.col("read") - F.col("n")).otherwise(F.lit(0)).cast("long")).drop("__family", "read")


def value_histogram(triples: DataFrame, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """(feature, value, n), implied zeros counted with written ones. triples: one row an entity and feature."""
    by_value = triples.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    zeros = _implied(by_value.groupBy("feature").agg(F.sum("n").alias("n")), readers(triples, families), families)
    both = by_value.unionByName(zeros.where("zeros > 0").select("feature", F.lit(0.0).alias("value"), F.col("zeros").alias("n")))
    return both.groupBy("feature", "value").agg(F.sum("n").alias("n"))


def feature_presence(triples: DataFrame, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """(feature, present): entities that have a value, an implied zero included."""
    known = _implied(triples.groupBy("feature").agg(F.count("value").alias("n")), readers(triples, families), families)
    return known.select("feature", (F.col("n") + F.col("zeros")).alias("present"))


def analyze(triples: DataFrame, total: DataFrame, vendor: Column, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """feature, is_vendor, present, n_distinct, min, max, total, ones, zeros (implied ones among present): one pass over the triples by way of the value histogram.

    What dense rows would give: implied zeros count as present, as a value, and for min and max. triples have one row an entity and feature.
    """
    by_value = triples.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    stats = by_value.groupBy("feature").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("written"), F.max(F.col("value") == 0).alias("has_zero"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.coalesce(F.sum(F.when(F.col("value") == 1, F.col("n"))), F.lit(0)).alias("ones"),
    )
    known, gap = _implied(stats, readers(triples, families), families), F.col("zeros") > 0
    return known.join(F.broadcast(total)).select(
        "feature", vendor.alias("is_vendor"), (F.col("n") + F.col("zeros")).alias("present"), (F.col("written") + (gap & ~F.col("has_zero")).cast("long")).alias("n_distinct"),
        F.when(gap, F.least("low", F.lit(0.0))).otherwise(F.col("low")).alias("min"), F.when(gap, F.greatest("high", F.lit(0.0))).otherwise(F.col("high")).alias("max"), "total", "ones", "zeros",
    )


def _scaled() -> Column:
    return (F.col("min") != F.col("max")) & ~(F.col("min").isin(-1.0, 0.0, 1.0) & F.col("max").isin(-1.0, 0.0, 1.0))


def needs_scaling(stats: DataFrame) -> DataFrame:
    """Features with min != max that aren't both within -1, 0, 1."""
    return stats.where(_scaled())


def drop_set(stats: DataFrame, least_share: float = 0.8) -> DataFrame:
    """Features with one value at most, or present in less than the share of rows."""
    return stats.where((F.col("n_distinct") <= 1) | (F.col("present") < least_share * F.col("total")))


def fill_set(stats: DataFrame, least_share: float = 0.8) -> DataFrame:
    """Features present in the share of rows but not in all; dropped features are not filled."""
    return stats.where((F.col("n_distinct") > 1) & (F.col("present") >= least_share * F.col("total")) & (F.col("present") < F.col("total")))


#: Fixed value: the vendor feature that stands for no vendor.
NO_VENDOR = "vendor_enum_-"


def rare_vendors(stats: DataFrame, least_ones: int = 33) -> Column:
    """Whether a feature of stats is a vendor's that is folded: of value 1 in fewer than least_ones rows, of one value at most, or NO_VENDOR."""
    return F.col("is_vendor") & ((F.col("ones") < least_ones) | (F.col("n_distinct") <= 1) | (F.col("feature") == NO_VENDOR))


def fold_rare(triples: DataFrame, stats: DataFrame, to: str, least_ones: int = 33) -> DataFrame:
    """Rare vendors' features become one feature `to`, 1 for an entity that has any of them; the others stay."""
    rare = stats.where(rare_vendors(stats, least_ones)).select("feature", F.lit(True).alias("rare"))
    marked = triples.join(rare, "feature", "left")
    kept = marked.where("rare is null").select("entity", "feature", "value")
    folded = marked.where("rare and value = 1").groupBy("entity").agg(F.max("value").alias("value")).select("entity", F.lit(to).alias("feature"), "value")
    both = kept.where(F.col("feature") != to).unionByName(kept.where(F.col("feature") == to).unionByName(folded).groupBy("entity", "feature").agg(F.max("value").alias("value")))
    return both


def scale_selected(triples: DataFrame, stats: DataFrame) -> DataFrame:
    """Min-max scaling of the features that need it."""
    chosen = needs_scaling(stats).select("feature", "min", "max")
    scaled = F.when(F.col("max").isNotNull(), (F.col("value") - F.col("min")) / (F.col("max") - F.col("min"))).otherwise(F.col("value"))
    return triples.join(chosen, "feature", "left").select("entity", "feature", scaled.alias("value"))


def assemble_dataset(triples: DataFrame, label_prefix: str) -> DataFrame:
    """index (dense, in entity order), entity, features, labels (maps). Triples are dealt by entity over parts that aren't merged, where a part holds its share of all however well names compress."""
    is_label = F.startswith(F.col("feature"), F.lit(label_prefix))
    entry = F.struct("feature", "value")
    both = triples.repartition(parts(triples), "entity").groupBy("entity").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.when(~is_label, entry)))).alias("features"), F.map_from_entries(F.array_sort(F.collect_list(F.when(is_label, entry)))).alias("labels")
    )
    return with_index(saved(both, "rows"), "index", "entity")  # read for the bounds of ranges and for the rows


def normalize(
    triples: DataFrame, total: DataFrame, vendor: Column, to: str = "vendor_enum_absent", least_share: float = 0.8, least_ones: int = 33, families: tuple[str, ...] = FAMILIES
) -> DataFrame:
    """Whole filter and normalisation of features and labels: rare vendors folded, the drop set left out, values scaled, gaps of the fill set 0.

    Zeros of enumerations stay implied, where dense rows would say 0; one that scaling would move (of a feature with negative values) is written. Vendors are neither dropped nor filled nor scaled. What a
    feature becomes is one row; triples meet it once, and no entity's row is ever dense. Names that are filled come from the schema (numbers and labels), not from the data.
    """
    stats = saved(analyze(triples, total, vendor, families), "stats")  # one row a feature
    gone, scaled = ~F.col("is_vendor") & (F.col("n_distinct") <= 1) | ~F.col("is_vendor") & (F.col("present") < least_share * F.col("total")), _scaled() & ~F.col("is_vendor")
    # written beside the statistics, so that the table's size and its often held features are known without making them again
    plan = saved(
        stats.select(
            "feature", gone.alias("gone"), rare_vendors(stats, least_ones).alias("rare"), F.when(scaled, F.col("min")).alias("low"), F.when(scaled, F.col("max") - F.col("min")).alias("range"),
            (F.col("present") - F.col("zeros")).alias("written"),
        ), "plan",
    )
    value = F.coalesce((F.col("value") - F.col("low")) / F.col("range"), F.col("value"))
    # read for the kept, the folded and the gaps
    met = saved(join_counted(triples, plan, "feature", "written").where("not gone and (not rare or value = 1)").select("entity", "feature", value.alias("value"), "rare"), "met")
    kept = met.where("not rare").select("entity", "feature", "value")
    other, k = kept.where(F.col("feature") != to), parts(triples)
    # the feature that rare vendors fold into may stand among the triples too
    folded = met.where("rare").select("entity", F.lit(to).alias("feature"), "value").unionByName(kept.where(F.col("feature") == to))
    out = other.unionByName(folded.repartition(k, "entity", "feature").groupBy("entity", "feature").agg(F.max("value").alias("value")))
    lives = stats.where(~gone & ~F.col("is_vendor"))
    filled = lives.where(~is_enum(F.col("feature")) & (F.col("present") < F.col("total"))).select("feature", F.lit(None).cast("string").alias("family"), F.lit(0.0).alias("fill"))
    moved = lives.where(is_enum(F.col("feature")) & (F.col("zeros") > 0) & (F.col("min") < 0) & _scaled()).select("feature", family(F.col("feature"), families).alias("family"), (-F.col("min") / (F.col("max") - F.col("min"))).alias("fill"))
    gap = filled.unionByName(moved)
    listed = gap.groupBy("family").agg(F.collect_list(F.struct("feature", "fill")).alias("all"))
    read = triples.select("entity", family(F.col("feature"), families).alias("family")).distinct()
    reach = read.select("entity").distinct().withColumn("family", F.lit(None).cast("string")).unionByName(read)
    every = reach.join(F.broadcast(listed), reach["family"].eqNullSafe(listed["family"])).select("entity", F.explode("all").alias("f")).select("entity", "f.feature", F.col("f.fill").alias("value"))
    have = other.unionByName(folded).join(F.broadcast(gap.select("feature")), "feature", "left_semi").select("entity", "feature")
    return out.unionByName(every.repartition(k, "entity", "feature").join(have.repartition(k, "entity", "feature"), ["entity", "feature"], "left_anti"))


def feature_group(name: Column) -> Column:
    """0 other, 1 severity enumeration, 2 description, 3 reference, 4 vendor."""
    return F.when(F.startswith(name, F.lit("lang_")), 1).when(F.startswith(name, F.lit("description_")), 2).when(F.startswith(name, F.lit("reference_")), 3).when(F.startswith(name, F.lit("vendor_")), 4).otherwise(0)


def class_balance(df: DataFrame, group: str, label: str) -> DataFrame:
    """group (null: all), negative, positive, positive_percent (null for a group without either)."""
    n = df.groupBy(F.col(group).alias("grp"), F.col(label).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    both = n.rollup("grp").agg(F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("negative"), F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("positive"))
    return both.withColumn("positive_percent", F.round(F.try_divide(100 * F.col("positive"), F.col("positive") + F.col("negative")), 2))


def nan_mean(col: str) -> Column:
    """Mean without NaN; null without rows, NaN if all are NaN."""
    x = F.col(col)
    return F.coalesce(F.avg(F.when(~F.isnan(x), x)), F.when(F.count(x) > 0, F.lit(float("nan"))))

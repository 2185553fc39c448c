"""Hyper-parameter candidates as tables, and operational reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .collections import with_carried, with_group_index, with_running_sums


def sample_candidates(spark: SparkSession, space: list[tuple[str, str, float, float]], n: int, seed: int) -> DataFrame:
    """id and one column for each (name, INT | FLOAT | BOOLEAN, min, max), drawn uniformly."""
    out = spark.range(n)
    for k, (name, kind, low, high) in enumerate(space):
        u = F.rand(seed + k)
        value = {"INT": F.floor(u * (high - low + 1) + low).cast("int"), "FLOAT": u * (high - low) + low, "BOOLEAN": u < 0.5}[kind]
        out = out.withColumn(name, value)
    return out


def clamp(value: Column, low: float, high: float) -> Column:
    """Values out of range: the absolute value if that lies inside, else the nearer limit."""
    return F.when(value.between(low, high), value).when(F.abs(value).between(low, high), F.abs(value)).otherwise(F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def rank_fitness(df: DataFrame, output: str, key: str, mode: str, maximize: bool = True, group: list[str] | None = None) -> DataFrame:
    """df with fitness: `absolute` (signed output), `incremental` (rank from 1, worst first) or `relative` (100 / (n - i + 2)). Ranks come from ranges of all rows, so a group may hold any share of them."""
    value = F.col(output) if maximize else -F.col(output)
    if mode == "absolute":
        return df.withColumn("fitness", value.cast("double"))
    at = with_group_index(df, "__rank", group or [], value, key)
    rank = F.col("__rank") + 1
    fitness = {"incremental": rank, "relative": F.lit(100.0) / (F.col("__rank_of") - rank + 2)}[mode]
    return at.withColumn("fitness", fitness.cast("double")).drop("__rank", "__rank_of", "__rank_row")


def roulette_bounds(df: DataFrame, fitness: str, key: str, group: list[str]) -> DataFrame:
    """df with low and high: each row's share of its group's wheel, in the order of key (negative fitness is shifted to 0). Shares are summed over ranges of all rows, so a group may hold any share of them."""
    least = df.groupBy(*group).agg(F.least(F.min(fitness), F.lit(0.0)).alias("__least"))
    summed = with_running_sums(df.join(least, group).withColumn("__f", F.col(fitness) - F.col("__least")).drop("__least"), {"__high": "__f"}, *group, key)
    start = summed.groupBy(*group).agg(F.min(F.col("__high") - F.col("__f")).alias("__start"))
    met = summed.join(start, group).withColumn("high", F.col("__high") - F.col("__start"))
    return met.withColumn("low", F.col("high") - F.col("__f")).drop("__f", "__high", "__high_total", "__start")


def roulette(bounds: DataFrame, group: list[str], draws: int, seed: int) -> DataFrame:
    """Rows drawn by fitness: `draws` points a group, each falls into one row's share; rows come with the number of their draw.

    Points and shares are merged: both stand in one order, the wheel's from its end, and a point takes the last share that began above it, carried over ranges. Rows of no share are never drawn. Points are
    hashes of seed, group and draw, so they are the same whenever a task runs again.
    """
    shares = bounds.where(F.col("high") > F.col("low"))
    chunk = 1 << 16
    total = shares.groupBy(*group).agg(F.max("high").alias("__total")).withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // chunk)))).repartition(*group, "__chunk")
    draw = F.explode(F.sequence(F.col("__chunk") * chunk + 1, F.least((F.col("__chunk") + 1) * chunk, F.lit(draws))))
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *group, "draw"), 11) + 1) / F.lit(float(1 << 53))
    points = total.withColumn("draw", draw).select(*group, "draw", (unit * F.col("__total")).alias("__x"))
    marks = shares.select(*group, F.col("high").alias("__x"), F.struct(*shares.columns).alias("__share"))
    both = marks.withColumn("draw", F.lit(None).cast("int")).unionByName(points, allowMissingColumns=True)
    met = with_carried(both, {"won": F.col("__share")}, *group, F.desc("__x"), F.asc_nulls_first("draw"))
    return met.where("draw is not null").select("won.*", "draw")


def leaderboard(df: DataFrame, output: str, key: str, k: int, maximize: bool = True) -> DataFrame:
    return df.orderBy(F.desc(output) if maximize else F.asc(output), key).limit(k)


def best_ever(df: DataFrame, output: str, key: str, gen: str, maximize: bool = True) -> DataFrame:
    """One row: the best output over all generations, its candidate and the first generation that reached it."""
    order = F.col(output) if maximize else -F.col(output)
    best = F.max_by(F.struct(output, gen, key), F.struct(order.alias("o"), (-F.col(gen)).alias("g"), F.col(key).alias("k")))
    return df.where(F.col(output).isNotNull()).agg(best.alias("b")).where("b is not null").select("b.*")


def generation_stats(df: DataFrame, gen: str, output: str, lineage: str, reset_below: float, started: str | None = None, ended: str | None = None) -> DataFrame:
    """gen, individuals, best, diversity (distinct lineages in percent), reset; with times of each candidate's start and end also elapsed, in seconds."""
    spent = {} if started is None else {"elapsed": (F.unix_micros(F.max(ended).cast("timestamp")) - F.unix_micros(F.min(started).cast("timestamp"))) / 1e6}
    n = df.groupBy(gen).agg(
        F.count(F.lit(1)).alias("individuals"), F.max(output).alias("best"), (100.0 * F.countDistinct(lineage) / F.count(F.lit(1))).alias("diversity"), *(c.alias(k) for k, c in spent.items())
    )
    return n.withColumn("reset", F.col("diversity") < reset_below)


def evaluate_candidates(df: DataFrame, features: str, label: str, grid: list[dict], seed: int = 1, parallelism: int = 4) -> list[tuple[dict, float]]:
    """(parameters, area under ROC) of a logistic regression for each candidate, evaluated side by side; NaN is minus infinity."""
    import math

    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import TrainValidationSplit

    from .evaluate import _vectors

    lr = LogisticRegression(featuresCol="__features", labelCol=label, maxIter=10)
    maps = [{lr.getParam(n): v for n, v in c.items()} for c in grid]
    fit = TrainValidationSplit(estimator=lr, estimatorParamMaps=maps, evaluator=BinaryClassificationEvaluator(labelCol=label), parallelism=parallelism, seed=seed).fit(_vectors(df, features))
    return [(c, -math.inf if math.isnan(m) else m) for c, m in zip(grid, fit.validationMetrics, strict=True)]


def job_status(locked_at: Column, attempts: Column, error: Column, now: Column, timeout_s: int, most: int, canceled: Column | None = None) -> Column:
    """WAITING, FAILED PREVIOUSLY, RUNNING, FAILED or FAILED ALL; CANCELING for a job that runs and is to be canceled."""
    late = F.unix_timestamp(now) - F.unix_timestamp(locked_at) > timeout_s
    status = F.when(attempts >= most, "FAILED ALL").when(locked_at.isNull() & error.isNotNull(), "FAILED PREVIOUSLY").when(locked_at.isNull(), "WAITING").when(late, "FAILED")
    return (status if canceled is None else status.when(canceled, "CANCELING")).otherwise("RUNNING")


def queue_stats(df: DataFrame, queue: str, locked: Column, failed: Column) -> DataFrame:
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return df.groupBy(queue).agg(n(~locked & ~failed).alias("available"), n(locked & ~failed).alias("locked"), n(failed).alias("errors"), F.count(F.lit(1)).alias("total"))


def progress(done: DataFrame, every: DataFrame) -> DataFrame:
    """done, total, percent (null of nothing)."""
    a, b = done.agg(F.count(F.lit(1)).alias("done")), every.agg(F.count(F.lit(1)).alias("total"))
    return a.join(F.broadcast(b)).withColumn("percent", F.round(F.try_divide(100 * F.col("done"), F.col("total")), 2))


def search_report(runs: DataFrame, key: str, members: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """(key, section, place, entry): the report of searches, one line a row.

    Fields of runs give a section each: a scalar is one line of place 0, a list one line for each element, from 1. Each of members (section: a column of runs that names a row, a table of such names
    and one list each) gives the named row's list in place of that column. Empty and missing lists, and names of nothing, are one line of place 0 without entry. Structs and lists inside are JSON.
    """
    told = runs.select(key, *(F.col(c).alias(f"__own_{c}") for c in runs.columns if c != key))
    lists = {c: runs.schema[c].dataType for c in runs.columns if c != key and c not in {ref for ref, _ in members.values()}}
    at = {c: F.col(f"__own_{c}") for c in lists}
    for k, (section, (ref, table)) in enumerate(members.items()):
        name, held = table.columns
        # a reference may be the key itself, and several may name one table
        told = told.join(table.select(F.col(name).alias(f"__name_{k}"), F.col(held).alias(f"__held_{k}")), F.col(key if ref == key else f"__own_{ref}") == F.col(f"__name_{k}"), "left")
        lists[section], at[section] = table.schema[held].dataType, F.col(f"__held_{k}")

    def text(value: Column, kind: T.DataType) -> Column:
        return F.to_json(value) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else value.cast("string")

    def listed(values: Column, kind: T.DataType) -> Column:
        return F.transform(values, lambda x, i: F.struct((i + 1).alias("place"), text(x, kind).alias("entry")))

    sections = []
    for section, kind in lists.items():
        if isinstance(kind, T.ArrayType):
            lines = listed(at[section], kind.elementType)
        else:
            lines = F.array(F.struct(F.lit(0).alias("place"), text(at[section], kind).alias("entry")))
        sections.append(F.struct(F.lit(section).alias("section"), lines.alias("lines")))
    if not sections:
        return told.select(key, F.lit("").alias("section"), F.lit(0).alias("place"), F.lit("").alias("entry")).limit(0)
    each = told.select(key, F.inline(F.array(*sections)))
    line = each.select(key, "section", F.explode_outer("lines").alias("line"))
    return line.select(key, "section", F.coalesce("line.place", F.lit(0)).alias("place"), "line.entry")

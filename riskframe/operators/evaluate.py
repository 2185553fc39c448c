"""Training and evaluation of classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .collections import with_group_index, with_running_sums


def _vectors(df: DataFrame, features: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("__features", array_to_vector(F.col(features).cast("array<double>")))


def train_weighted(df: DataFrame, features: str, label: str, positive: float = 1.0, negative: float = 0.3, iterations: int = 20):
    """Logistic regression with one weight for each class."""
    from pyspark.ml.classification import LogisticRegression

    weighted = _vectors(df, features).withColumn("__weight", F.when(F.col(label) == 1, positive).otherwise(negative))
    return LogisticRegression(featuresCol="__features", labelCol=label, weightCol="__weight", maxIter=iterations, regParam=0.01).fit(weighted)


def train_mlp(df: DataFrame, features: str, label: str, layers: list[int], iterations: int = 20, seed: int = 1):
    """Feed-forward network."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    return MultilayerPerceptronClassifier(featuresCol="__features", labelCol=label, layers=layers, maxIter=iterations, seed=seed).fit(_vectors(df, features))


def predict(df: DataFrame, model, features: str) -> DataFrame:
    """df with confidence (probability of class 1) and predicted."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(_vectors(df, features)).withColumn("confidence", vector_to_array("probability")[1])
    keep = [c for c in scored.columns if c in df.columns or c == "confidence"]
    return scored.select(*keep).withColumn("predicted", threshold_class(F.col("confidence")))


def train_stacked(df: DataFrame, groups: list[str], label: str):
    """A weighted classifier for each group of features, and one over their confidences: (models, combiner)."""
    models = {g: train_weighted(df, g, label) for g in groups}
    return models, train_weighted(stack(df, models), "__stack", label)


def stack(df: DataFrame, models: dict) -> DataFrame:
    """df with __stack: confidences of the group models."""
    for g, m in models.items():
        df = predict(df, m, g).withColumnRenamed("confidence", f"__c_{g}").drop("predicted")
    return df.withColumn("__stack", F.array(*(f"__c_{g}" for g in models))).drop(*(f"__c_{g}" for g in models))


def threshold_class(score: Column, threshold: float = 0.5) -> Column:
    return (score >= threshold).cast("int")


def argmax_class(scores: Column) -> Column:
    """Position of the first largest score, from 0."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    y, p = F.col(label) == 1, F.col(predicted) == 1
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    return df.agg(n(y & p).alias("tp"), n(~y & ~p).alias("tn"), n(~y & p).alias("fp"), n(y & ~p).alias("fn"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def binary_metrics(counts: DataFrame) -> DataFrame:
    """counts with accuracy, precision, recall and f1; 0 where undefined."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return counts.withColumns({"accuracy": _ratio(tp + tn, tp + tn + fp + fn), "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn)})


def soft_metrics(df: DataFrame, label: str, score: str) -> DataFrame:
    """precision, recall and f1 from rounded clipped products."""
    clip = lambda c: F.bround(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))
    y, s = F.col(label).cast("double"), F.col(score).cast("double")
    n = df.agg(F.sum(clip(y * s)).alias("tp"), F.sum(clip(s)).alias("pp"), F.sum(clip(y)).alias("ap"))
    p, r = _ratio(F.col("tp"), F.col("pp")), _ratio(F.col("tp"), F.col("ap"))
    return n.select(p.alias("precision"), r.alias("recall"), _ratio(2 * p * r, p + r).alias("f1"))


def score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    """score, y and x (positives and negatives at it), tp, fp (at or above it), positives and negatives, one row a distinct score: ties are one step."""
    step = df.groupBy(F.col(score).alias("score")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("y"), F.count(F.lit(1)).alias("n"))
    step = step.select("score", "y", (F.col("n") - F.col("y")).alias("x"))
    return with_running_sums(step, {"tp": "y", "fp": "x"}, F.desc("score")).withColumnsRenamed({"tp_total": "positives", "fp_total": "negatives"})


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """score, fpr and tpr, one row a distinct score. A rate over a class without rows is null, here and in the areas."""
    return score_counts(df, label, score).select("score", F.try_divide("fp", "negatives").alias("fpr"), F.try_divide("tp", "positives").alias("tpr"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve by trapezoids; null with one class only or no rows. A step's start is its end less its own rows, so no neighbour is looked up."""
    c = score_counts(df, label, score)
    return c.agg(F.sum(F.try_divide("x", "negatives") * F.try_divide(2 * F.col("tp") - F.col("y"), "positives") / 2).alias("auc"))


def pr_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """score, recall (null without positives) and precision, one row a distinct score."""
    return score_counts(df, label, score).select("score", F.try_divide("tp", "positives").alias("recall"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def pr_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the precision-recall curve by trapezoids from recall 0 at the first precision; null without positives."""
    here, before = F.col("tp") + F.col("fp"), F.col("tp") + F.col("fp") - F.col("y") - F.col("x")
    precision = F.col("tp") / here
    start = F.when(before > 0, F.try_divide(F.col("tp") - F.col("y"), before)).otherwise(precision)
    return score_counts(df, label, score).agg(F.sum(F.try_divide("y", "positives") * (precision + start) / 2).alias("auc"))


#: Points that a moving average takes at once.
BLOCK = 16_384


def smooth(curve: DataFrame, group: list[str], order: str, value: str, box: int = 3) -> DataFrame:
    """Moving average over `box` points; the first and last two points of a group stay.

    All points are numbered in order and cut into blocks; points near a block's edge are copied to the neighbour (its halo), so each block is averaged by itself and a group may hold any share of the rows.
    """
    half = box // 2
    at = with_group_index(curve, "__at", group, order)
    touched = F.sequence(F.greatest(F.col("__at_row") - half, F.lit(0)).cast("long"), (F.col("__at_row") + half).cast("long"), F.lit(max(1, half)).cast("long"))
    own = F.floor(F.col("__at_row") / BLOCK)
    blocks = at.withColumn("__own", own).withColumn("__block", F.explode(F.array_distinct(F.transform(touched, lambda r: F.floor(r / BLOCK)))))
    mean = F.avg(value).over(W.partitionBy("__block", *group).orderBy("__at_row").rowsBetween(-half, half))
    ends = (F.col("__at") < 2) | (F.col("__at") >= F.col("__at_of") - 2)
    done = blocks.withColumn("smooth", F.when(ends, F.col(value).cast("double")).otherwise(mean)).where("__block = __own")
    return done.drop("__at", "__at_of", "__at_row", "__own", "__block")


def random_baseline(sets: DataFrame, trials: int, seed: int) -> DataFrame:
    """name, mean accuracy, precision, recall and f1 of uniform random guesses. sets: name, neg, pos.

    Guesses are bits of hashes, 64 at a time, counted in chunks of 65 536, so a large set is many rows of one number each.
    """
    many = sets.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials))))
    many = many.select("name", "trial", F.explode(F.array(F.struct(F.lit(0).alias("y"), F.col("neg").alias("n")), F.struct(F.lit(1).alias("y"), F.col("pos").alias("n")))).alias("c")).select("name", "trial", "c.*")
    chunk = many.withColumn("at", F.explode(F.expr("sequence(0L, greatest(bigint(ceil(n / 65536)) - 1, 0L))"))).withColumn("m", F.expr("least(65536L, n - at * 65536L)"))
    ones = F.expr(f"""aggregate(sequence(0L, greatest(bigint(ceil(m / 64)) - 1, 0L)), 0L, (s, i) ->
        s + if(m > i * 64, bit_count(shiftrightunsigned(xxhash64({seed}, name, trial, y, at, i), int(64 - least(64L, m - i * 64L)))), 0))""")
    hit = chunk.withColumn("ones", ones).groupBy("name", "trial", "y").agg(F.sum("ones").alias("ones"), F.sum("m").alias("n"))
    total = lambda y, c: F.coalesce(F.sum(F.when(F.col("y") == y, c)), F.lit(0))
    one, none = F.col("ones"), F.col("n") - F.col("ones")
    counts = hit.groupBy("name", "trial").agg(total(1, one).alias("tp"), total(0, none).alias("tn"), total(0, one).alias("fp"), total(1, none).alias("fn"))
    return binary_metrics(counts).groupBy("name").agg(*(F.avg(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")))


def format_prediction(key: Column, label: Column, predicted: Column, confidence: Column) -> Column:
    """Fixed format of a prediction line (its spelling is part of the format)."""
    match = F.when(label == predicted, "True").otherwise("False")
    return F.concat(key.cast("string"), F.lit(": Label: "), label.cast("string"), F.lit(" | Predicted Exploit: "), predicted.cast("string"), F.lit(" | Conficende "), F.format_string("%.2f", confidence * 100), F.lit("% | Prediction Match: "), match)


LINE = r"^(.+): Label: ([0-9]+) \| Predicted Exploit: ([0-9]+) \| Conficende ([0-9.]+)% \| Prediction Match: (True|False)$"


def parse_predictions(lines: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """(parsed, malformed): key, label, predicted, confidence, match; and the lines that don't fit."""
    part = lambda k: F.regexp_extract(F.col(col), LINE, k)
    good = F.coalesce(F.col(col).rlike(LINE), F.lit(False))
    parsed = lines.where(good).select(part(1).alias("key"), part(2).cast("int").alias("label"), part(3).cast("int").alias("predicted"), (part(4).cast("double") / 100).alias("confidence"), (part(5) == "True").alias("match"))
    return parsed, lines.where(~good)


def normalize_curve(curve: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Digitised coordinates to 0..1: clipped, y turned upside down (screens count from the top). A group of one value has null coordinates. Each group's limits are one row that its points meet."""
    limits = curve.groupBy(*(F.col(g).alias(f"__g{k}") for k, g in enumerate(group))).agg(*(f(c).alias(f"__{n}_{c}") for c in (x, y) for n, f in (("min", F.min), ("max", F.max))))
    same = F.lit(True)
    for k, g in enumerate(group):
        same = same & curve[g].eqNullSafe(limits[f"__g{k}"])
    met = curve.join(limits, same)
    unit = lambda c: F.try_divide(F.col(c) - F.col(f"__min_{c}"), F.col(f"__max_{c}") - F.col(f"__min_{c}"))
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return met.withColumns({"nx": clip(unit(x)), "ny": 1 - clip(unit(y))}).select(*curve.columns, "nx", "ny")


def match_totals(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """One row: matches, total, percent."""
    n = df.agg(F.sum(F.col(label).eqNullSafe(F.col(predicted)).cast("long")).alias("matches"), F.count(F.lit(1)).alias("total"))
    return n.select(F.coalesce("matches", F.lit(0)).cast("long").alias("matches"), "total", F.round(F.try_divide(100 * F.col("matches"), F.col("total")), 2).alias("percent"))


def compare_labels(df: DataFrame, label: str, predicted: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose prediction isn't the label, one row of totals: right, wrong, accuracy in percent). A null equals a null only."""
    same = F.col(label).eqNullSafe(F.col(predicted))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    totals = df.agg(n(same).alias("right"), n(~same).alias("wrong"))
    return df.where(~same), totals.withColumn("accuracy", F.round(F.try_divide(100 * F.col("right"), F.col("right") + F.col("wrong")), 2))


def save_model(model, path: str) -> None:
    """A fitted model of Spark ML; what stood there is replaced."""
    model.write().overwrite().save(path)


def load_model(path: str, kind=None):
    """A saved model; kind is its class, LogisticRegressionModel by default."""
    from pyspark.ml.classification import LogisticRegressionModel

    return (kind or LogisticRegressionModel).load(path)


def evaluate_years(model, df: DataFrame, features: str, label: str, year: Column, years: list[int]) -> DataFrame:
    """Confusion counts and metrics of a model over the rows of the chosen years."""
    return binary_metrics(confusion(predict(df.where(year.isin(years)), model, features), label, "predicted"))

"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

1. Targets: the mix has `share` of all words. Weights share it out; no source gets more than `repeat` times its size; the excess goes
   to the others by weight. That is min(repeat * size, level * weight) for one level, found from running sums over the sources sorted by
   repeat * size / weight.
2. A source's documents in an order shuffled by hash form one stream of words, which repeats. The mix takes the stream's first `target` words.
3. Slots of the mix: the i-th point of the golden-ratio sequence falls into one source's part of the cumulative targets; slots are
   ranked within their source. The r-th of a source's n slots takes the r-th of n blocks of equal length of the stream.
4. A document's part of a block is a row of the schedule. Mixed documents come out in the order of their slots.

Ranks and running sums over a source go through parts of bounded size (chunks of slots, hash ranges of documents): totals of the
parts are summed first, then each part by itself, so a source with a third of all rows is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, saved

#: Fractional part of the golden ratio, and of its multiple by 2**20, so that the points keep their precision for large i.
GOLDEN, GOLDEN_20 = 0.6180339887498949, (0x9E3779B97F4A7C15 * 2**20 % 2**64) / 2**64


def word_count(text: Column) -> Column:
    """Words of a text: runs of characters other than space and \\t \\n \\v \\f \\r."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _before(df: DataFrame, keys: list[str], part: str, order: list, value) -> DataFrame:
    """df with `before`: the sum of `value` over the rows of its keys that stand before it by (part, *order). Totals by part first."""
    total = df.groupBy(*keys, part).agg(F.sum(value).alias("__t"))
    ahead = total.withColumn("__b", F.coalesce(F.sum("__t").over(W.partitionBy(*keys).orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__t")
    inside = F.coalesce(F.sum(value).over(W.partitionBy(*keys, part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("__i", inside).join(ahead, [*keys, part]).withColumn("before", F.col("__i") + F.col("__b")).drop("__i", "__b")


def _with_source(rows: DataFrame, sources: DataFrame, on, salt, salts: int = 16) -> DataFrame:
    """rows joined to the table of sources; every source stands `salts` times, so a large source's rows are dealt to as many tasks."""
    many = sources.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).alias("t")
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*salt), F.lit(salts)).cast("int")).alias("l")
    met = salted.join(many, on & (F.col("l.__salt") == F.col("t.__salt")))
    return met.select(*(F.col(f"l.{c}") for c in rows.columns), *(F.col(f"t.{c}") for c in sources.columns if c not in rows.columns))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, repeat: int) -> DataFrame:
    """sizes (source, source_size), one row a source, with source_no (order by code point, null last), weight and target."""
    no = sizes.withColumn("source_no", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    no = no.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int")).cast("double"))
    no = no.withColumns({"cap": F.col("source_size") * float(repeat), "total": F.sum("source_size").over(W.partitionBy()) * float(share)})
    by = W.orderBy(F.col("cap") / F.col("weight"), "source_no")
    earlier = by.rowsBetween(W.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing))
    no = no.withColumn("level", level).withColumn("ok", F.col("level") <= F.col("cap") / F.col("weight"))
    no = no.withColumn("level", F.max(F.when(F.col("ok"), F.col("level"))).over(W.partitionBy()))
    target = F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return no.withColumn("target", target).select("source", "source_no", "source_size", "weight", "target")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.0, repeat: int = 3, block: int = 2048, seed: int = 17,
) -> tuple[DataFrame, DataFrame]:
    """(stream, schedule).

    stream: id, source, text_hash, size, source_no, source_size, target, position (of the document's first word in its source's stream).
    schedule: slot, source_no, position, turn (pass over the stream), from_word, to_word: one row for each part of a document in a slot.

    Sizes are words; a null text has none and takes no part in the schedule. A null source is a source of its own. Repeated rows and equal or null
    ids are rows of their own. Documents of a source are shuffled by a hash of id and text; ties go by id, then that of the text. With no
    words at all every target is 0 and the schedule is empty. Other columns are not read. Reruns agree.
    """
    text = F.col(text_col).cast("string")
    light = saved(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text).alias("text_hash"), word_count(text).alias("size")), "sizes"
    )
    targets = saved(source_targets(light.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeat), "targets")
    known = targets.select("source", "source_no", "source_size", "target")
    rows = _with_source(light, known, F.col("l.source").eqNullSafe(F.col("t.source")), ["id", "text_hash"])
    # hash ranges of some thousand documents: a large source is many of them
    parts = max(1, light.count() // 4096)
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "id", "text_hash")).withColumn("part", F.pmod(F.shiftright("h", 16), F.lit(parts)))
    stream = _before(rows, ["source_no"], "part", ["h", "id", "text_hash"], F.col("size")).withColumnRenamed("before", "position").drop("h", "part")
    stream = saved(stream, "stream")
    return stream, _schedule(stream, targets, block, repeat)


def _slots(bounds: DataFrame, words: int, block: int) -> DataFrame:
    """slot, source_no, rank (of the slot within its source), n (slots of the source)."""
    n = -(-words // block)
    # cells of equal width: points are spread evenly over them, and a source covers the cells of its part
    cells = max(1024, 4 * bounds.count())
    wide = words / cells
    i = F.col("slot")
    high, low = F.floor(i / 2**20) * F.lit(GOLDEN_20), (i % 2**20) * F.lit(GOLDEN)
    point = F.pmod(F.pmod(high, F.lit(1.0)) + F.pmod(low, F.lit(1.0)) + F.lit(0.5), F.lit(1.0)) * F.lit(float(words))
    points = bounds.sparkSession.range(n).withColumnRenamed("id", "slot").withColumn("point", point).withColumn("cell", F.floor(F.col("point") / wide))
    covered = bounds.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / wide), F.floor(F.col("high") / wide))))
    drawn = points.join(covered, "cell").where("point >= low and point < high").select("slot", "source_no")
    ranked = _before(drawn.withColumn("part", F.floor(i / 4096)), ["source_no"], "part", ["slot"], F.lit(1)).select("slot", "source_no", F.col("before").alias("rank"))
    # a source too small for any point gets one slot at the end
    none = bounds.join(drawn.select("source_no").distinct(), "source_no", "left_anti").select((F.col("source_no") + n).alias("slot"), "source_no", F.lit(0).cast("long").alias("rank"))
    slots = saved(ranked.unionByName(none), "slots")
    return slots.join(slots.groupBy("source_no").agg(F.count(F.lit(1)).alias("n")), "source_no")


def _schedule(stream: DataFrame, targets: DataFrame, block: int, repeat: int) -> DataFrame:
    goal = targets.withColumn("goal", F.least(F.round("target").cast("long"), F.col("source_size") * repeat)).where("goal > 0")
    goal = goal.withColumn("high", F.sum("goal").over(W.orderBy("source_no")))
    bounds = saved(goal.select("source_no", "goal", (F.col("high") - F.col("goal")).alias("low"), "high"), "bounds")
    words = bounds.agg(F.max("high")).first()[0] or 0
    slots = _slots(bounds, words, block).join(bounds.select("source_no", "goal"), "source_no")
    step = F.col("goal") / F.col("n")
    slots = slots.select("source_no", "rank", "slot", F.floor(F.col("rank") * step).alias("lo"), F.when(F.col("rank") + 1 == F.col("n"), F.col("goal")).otherwise(F.floor((F.col("rank") + 1) * step)).alias("hi"))
    count = slots.groupBy("source_no").agg(F.count(F.lit(1)).alias("n"))
    of = count.join(bounds.select("source_no", "goal"), "source_no")
    docs = _with_source(stream.where("size > 0").select("source_no", "position", "size", "source_size"), of, F.col("l.source_no") == F.col("t.source_no"), ["position"])
    docs = docs.withColumn("turn", F.explode(F.expr("sequence(0L, (goal - 1) div source_size)")))
    docs = docs.withColumn("start", F.expr("turn * source_size + position")).withColumn("end", F.expr("least(start + size, goal)")).where("start < end")
    # ranks of the blocks that the document may touch, one more on either side for rounding; the join's condition is exact
    docs = docs.withColumn("rank", F.explode(F.expr("sequence(greatest(floor(start * (n / goal)) - 1, 0L), least(floor((end - 1) * (n / goal)) + 1, n - 1))")))
    part = docs.join(slots, ["source_no", "rank"]).where("lo < end and start < hi")
    return part.select("slot", "source_no", "position", "turn", F.expr("greatest(lo, start) - start").alias("from_word"), F.expr("least(hi, end) - start").alias("to_word"))


def taken_words(stream: DataFrame, schedule: DataFrame) -> DataFrame:
    """stream with taken: words of each document that the mix takes, repeats counted."""
    taken = schedule.groupBy("source_no", "position").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    full = stream.where("size > 0").join(taken, ["source_no", "position"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    return full.unionByName(stream.where("size = 0").withColumn("taken", F.lit(0).cast("long")))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", slot_col: str | None = None, **options) -> DataFrame:
    """Rows of docs as the mix takes them, with docs' columns, in the schedule's order: a document once for each pass of its source's stream that reaches it, at the slot that
    takes its first word, cut to its first words where the mix ends inside it. Documents of which nothing is taken go, those without words among them.

    The rows are range-partitioned by slot and sorted, so files written from them follow the schedule and sources alternate as it says; slot_col names a column that keeps the slot. Repeated
    rows are taken each for itself. Null ids and sources are values like others. An empty table gives an empty result.
    """
    stream, schedule = mix(docs, id_col, text_col, source_col, **options)
    keys = ["__id", "__hash", "__source"]
    own = stream.select("source_no", "position", "size", F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), F.coalesce("source", F.lit("")).alias("__source"), F.col("source").isNull().alias("__none"))
    named = docs.withColumns({"__id": F.col(id_col), "__hash": F.xxhash64(F.col(text_col).cast("string")), "__source": F.coalesce(F.col(source_col).cast("string"), F.lit("")), "__none": F.col(source_col).isNull()})
    keys.append("__none")
    if own.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        own, named = own.withColumn("__n", F.lit(1)), named.withColumn("__n", F.lit(1))
    else:  # repeated rows: the n-th of them is the n-th in the stream
        own = own.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy("position", "source_no")))
        named = named.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(F.xxhash64(*docs.columns))))
    turn = schedule.groupBy("source_no", "position", "turn").agg(F.min_by("slot", "from_word").alias("__slot"), F.sum(F.col("to_word") - F.col("from_word")).alias("__words"))
    plan = turn.join(own.where("size > 0"), ["source_no", "position"]).withColumnsRenamed({k: f"p{k}" for k in (*keys, "__n")})
    plan = plan.withColumnsRenamed({k: f"__{k}" for k in ("source_no", "position", "turn", "size")})
    same = F.lit(True)
    for k in (*keys, "__n"):
        same &= F.col(k).eqNullSafe(F.col(f"p{k}"))
    cut = F.expr(f"array_join(slice(regexp_extract_all({text_col}, '{WORD}', 0), 1, int(__words)), ' ')".replace("\\", "\\\\"))
    met = named.join(plan, same).withColumn(text_col, F.when(F.col("__words") < F.col("__size"), cut).otherwise(F.col(text_col)))
    met = met.orderBy("__slot", "__source_no", "__position", "__turn")
    return met.select(*docs.columns, *([F.col("__slot").alias(slot_col)] if slot_col else []))

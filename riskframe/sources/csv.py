"""Ragged and labelled CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.collections import with_carried, with_running_sums
from ..storage import saved


def ragged_width(df: DataFrame, col: str, delimiter: str) -> DataFrame:
    """width: largest number of columns of delimited lines, quoted parts not counted."""
    bare = F.regexp_replace(F.col(col), '"[^"]*"', "")
    return df.agg(F.max(F.length(bare) - F.length(F.replace(bare, F.lit(delimiter))) + 1).alias("width"))


def quoted_rows(spark: SparkSession, path: str) -> DataFrame:
    """(start, text): rows of one CSV file, whose quoted cells may hold line ends, from the lines of its splits; start is the place of a row's first line and orders them.

    A line begins inside quotes if the marks before it are odd in number (a doubled mark counts twice). Marks are summed over ranges of lines, and the place where a row began is carried over ranges, so a
    plain file is read by many tasks and quotes may stay open over any of their borders. A gzipped file is one split. A mark that is never closed makes one row of all that follows.
    """
    split = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block")).withColumn("line", F.monotonically_increasing_id())
    marks = F.length("value") - F.length(F.replace("value", F.lit('"')))
    summed = with_running_sums(split.withColumn("marks", marks), {"open": "marks"}, "block", "line")
    begins = F.when((F.col("open") - F.col("marks")) % 2 == 0, F.struct("block", "line"))
    lines = with_carried(summed, {"start": begins}, "block", "line").groupBy("start").agg(F.array_sort(F.collect_list(F.struct("block", "line", "value"))).alias("lines"))
    return lines.select("start", F.array_join("lines.value", "\n").alias("text"))


def read_preamble_csv(spark: SparkSession, path: str, header_row: int = 2, data_from: int = 10, delimiter: str = ",") -> tuple[DataFrame, dict[str, str]]:
    """(rows, preamble) of a CSV file whose first rows hold version and date, then a header, then data from row data_from.

    Only the head of the file and the width go through the driver. The widest row sets the number of columns: cells beyond the header stand in `column_<n>` (from 0), missing trailing cells are
    null, and rows without any text are left out. Rows are those of quoted_rows, so delimiters and line ends inside quotes count neither for the width nor for the head, and head rows are left out
    by their place: data may repeat what they say. Rows come in the file's order.
    """
    rows = saved(quoted_rows(spark, path), "rows")
    first = rows.orderBy("start").limit(data_from).collect()
    head = [r.text for r in first]
    digits = lambda s: "".join(c for c in s if c.isdigit() or c in "-.")
    names = [c.strip().strip('"') for c in head[header_row].split(delimiter)]
    width = ragged_width(rows, "text", delimiter).first().width or 0
    names += [f"column_{k}" for k in range(len(names), width)]
    place = first[-1].start
    later = (F.col("start.block") > place.block) | (F.col("start.block") == place.block) & (F.col("start.line") > place.line)
    data = rows.where(later & (F.trim("text") != "")) if len(first) == data_from else rows.limit(0)
    cells = F.from_csv("text", ", ".join(f"`{n}` string" for n in names), {"sep": delimiter, "escape": '"', "mode": "PERMISSIVE"})
    return data.orderBy("start").select(cells.alias("cells")).select("cells.*"), {"version": digits(head[0]), "date": digits(head[1])}


def read_labeled_csv(spark: SparkSession, path: str) -> DataFrame:
    """features (all columns but the last, double) and label (the last)."""
    raw = spark.read.csv(path)
    *features, label = raw.columns
    return raw.select(F.array(*(F.col(c).cast("double") for c in features)).alias("features"), F.col(label).alias("label")).where("label is not null")

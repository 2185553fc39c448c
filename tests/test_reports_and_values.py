"""Reports of searches, dates of several sources, nested lists and numeric features on odd rows."""

import datetime

from pyspark.sql import functions as F

from riskframe.functions import text as X
from riskframe.operators import merge as M
from riskframe.operators import search as H


def test_report_lines(spark):
    runs = spark.createDataFrame([(1, "a", [3.5, None], 7, 8), (2, None, [], 9, None), (3, "c", None, None, 8)], "id int, name string, best array<double>, hall_id int, pop_id int")
    hall = spark.createDataFrame([(7, [(1, "x"), (2, None)]), (9, [])], "id int, genomes array<struct<n int, s string>>")
    pop = spark.createDataFrame([(8, ["p", "q"])], "id int, genomes array<string>")
    got = {(r.id, r.section, r.place): r.entry for r in H.search_report(runs, "id", {"hall": ("hall_id", hall), "population": ("pop_id", pop)}).collect()}
    assert got == {
        (1, "name", 0): "a", (1, "best", 1): "3.5", (1, "best", 2): None, (1, "hall", 1): '{"n":1,"s":"x"}', (1, "hall", 2): '{"n":2}', (1, "population", 1): "p", (1, "population", 2): "q",
        (2, "name", 0): None, (2, "best", 0): None, (2, "hall", 0): None, (2, "population", 0): None,
        (3, "name", 0): "c", (3, "best", 0): None, (3, "hall", 0): None, (3, "population", 1): "p", (3, "population", 2): "q",
    }
    assert H.search_report(runs.limit(0), "id", {"hall": ("hall_id", hall)}).count() == 0
    assert H.search_report(runs.select("id"), "id", {}).columns == ["id", "section", "place", "entry"]


def test_report_by_own_key_and_one_table_twice(spark):
    runs = spark.createDataFrame([(1, 2), (2, 2)], "id int, other int")
    table = spark.createDataFrame([(1, ["a"]), (2, ["b"])], "id int, l array<string>")
    got = sorted((r.id, r.section, r.entry) for r in H.search_report(runs, "id", {"own": ("id", table), "far": ("other", table)}).collect())
    assert got == [(1, "far", "b"), (1, "own", "a"), (2, "far", "b"), (2, "own", "b")]


def test_dates_of_sources(spark):
    rows = [("2020-01-31", "31/12/2019"), (None, "01/02/2020"), ("soon", None), ("2020-01-31 10:00:00", "30/01/2020"), ("", "31/02/2020")]
    day = [M.any_date(F.col(c)) for c in ("a", "b")]
    df = spark.createDataFrame(rows, "a string, b string").select(*(c.alias(n) for n, c in M.date_extremes(day, day).items()))
    d = datetime.date
    assert [tuple(r) for r in df.collect()] == [(d(2019, 12, 31), d(2020, 1, 31)), (d(2020, 2, 1), d(2020, 2, 1)), (None, None), (d(2020, 1, 30), d(2020, 1, 31)), (None, None)]


def test_one_source(spark):
    one = M.date_extremes([F.lit("2020-01-31")], [F.lit(None)])
    assert [tuple(r) for r in spark.range(1).select(*one.values()).collect()] == [(datetime.date(2020, 1, 31), None)]


def test_nested_lists(spark):
    rows = [([["a", "b"], None, ["a"]],), ([],), (None,), ([None],), ([["x", None], [None]],)]
    df = spark.createDataFrame(rows, "l array<array<string>>").select(X.flatten_values(F.col("l")).alias("all"), X.flatten_values(F.col("l"), unique=True).alias("one"))
    assert [tuple(r) for r in df.collect()] == [(["a", "b", "a"], ["a", "b"]), ([], []), (None, None), ([], []), (["x", None, None], ["x", None])]


def test_numeric_features(spark):
    df = spark.createDataFrame([(["a", "b"], 1, 2.5), (None, None, None), ([], 4, 0.0)], "l array<string>, v long, s double")
    values = X.numeric_features({"n": F.size("l")}, {"most": (F.col("v"), F.size("l"))}, {"s": F.col("s")}, {"has": F.col("s")})
    assert [tuple(r) for r in df.select(*(c.alias(n) for n, c in values.items())).collect()] == [(2, 2, 2.5, 1), (0, 0, 0.0, 0), (0, 4, 0.0, 1)]

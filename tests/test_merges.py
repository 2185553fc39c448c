"""Merges of touched buckets, restores, and rows of CSV files with line ends in cells."""

import json

import pytest
from pyspark.sql import functions as F

from riskframe import storage
from riskframe.operators import collections as C
from riskframe.sources import csv
from riskframe.streaming import upsert as U


def files(folder):
    return {str(p.relative_to(folder)) for p in folder.rglob("part-*.parquet")}


def test_only_touched_buckets_are_written(spark, tmp_path):
    target = tmp_path / "t"
    rows = spark.range(5000).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("o"), F.lit("a").alias("v"))
    U.merge_batch(spark, rows, 0, "k", "o", str(target), 16)
    first = files(target)
    assert len({f.split("/")[2] for f in first}) == 16 and U.read_target(spark, str(target), rows.schema).count() == 5000
    schema = "k long, o long, v string"
    ten = spark.createDataFrame([(77, o, f"b{o}") for o in range(10)] + [(None, 1, "x")], schema)
    U.merge_batch(spark, ten, 1, "k", "o", str(target), 16)
    new = files(target) - first
    assert len({f.split("/")[2] for f in new}) == 2 and first <= files(target)  # one bucket, and the rows without a key
    table = U.read_target(spark, str(target), rows.schema)
    assert table.count() == 5001 and table.where("k = 77").first().v == "b9" and table.where("k is null").count() == 1
    U.merge_batch(spark, ten, 1, "k", "o", str(target), 16)  # its manifest stands: nothing happens
    assert U.read_target(spark, str(target), rows.schema).count() == 5001
    U.merge_batch(spark, spark.createDataFrame([(77, 11, "c"), (None, 2, "y")], schema), 2, "k", "o", str(target), 16)
    table = U.read_target(spark, str(target), rows.schema)
    assert table.where("k = 77").first().v == "c" and table.where("k is null").count() == 2 and table.count() == 5002
    assert len({f.split("/")[2] for f in first - files(target)}) == 1  # the first batch's folder of that bucket is gone


def test_crash_before_the_manifest(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "t")
    rows = spark.createDataFrame([(k, 1, "a") for k in range(50)], "k long, o long, v string")
    U.merge_batch(spark, rows, 0, "k", "o", target, 4)

    def fail(*args):
        raise OSError("lost")

    monkeypatch.setattr(U, "write_manifest", fail)
    with pytest.raises(OSError):
        U.merge_batch(spark, rows.withColumn("v", F.lit("b")).withColumn("o", F.lit(2).cast("long")), 1, "k", "o", target, 4)
    assert {r.v for r in U.read_target(spark, target, rows.schema).collect()} == {"a"}
    monkeypatch.undo()
    U.merge_batch(spark, rows.withColumn("v", F.lit("b")).withColumn("o", F.lit(2).cast("long")), 1, "k", "o", target, 4)
    assert sorted((r.k, r.v) for r in U.read_target(spark, target, rows.schema).collect()) == [(k, "b") for k in range(50)]


def test_restore_into_a_renamed_target(spark, tmp_path, monkeypatch):
    a = spark.createDataFrame([(1, "new", 5), (2, "two", 6), (None, "none", 7)], "id long, v string, extra int")
    b = spark.createDataFrame([("x", [1, 2])], "name string, l array<int>")
    C.export_tables({"a": (a, "id"), "b": (b, "name")}, str(tmp_path / "dump"))
    old = spark.createDataFrame([(1, "old", True), (9, "nine", False)], "id long, v string, mine boolean")
    C.export_tables({"a": (old, "id"), "c": (b, "name")}, str(tmp_path / "before"))
    target = str(tmp_path / "other")
    C.restore_tables(spark, str(tmp_path / "before"), target)

    def fail(*args):
        raise OSError("lost")

    monkeypatch.setattr(C, "write_manifest", fail)
    with pytest.raises(OSError):
        C.restore_tables(spark, str(tmp_path / "dump"), target)
    assert set(C.open_tables(spark, target)) == {"a", "c"} and C.open_tables(spark, target)["a"][0].where("id = 1").first().v == "old"
    monkeypatch.undo()
    want = sorted([(1, "new", None, 5), (2, "two", None, 6), (9, "nine", False, None), (None, "none", None, 7)], key=str)
    for k in (1, 2):
        got = C.restore_tables(spark, str(tmp_path / "dump"), target)
        assert set(got) == {"a", "b", "c"} and got["a"][1] == "id" and got["b"][1] == "name" and got["b"][0].first().l == [1, 2]
        rows = sorted(((r.id, r.v, r.mine, r.extra) for r in got["a"][0].collect()), key=str)
        assert [r for r in rows if r[0] is not None] == [r for r in want if r[0] is not None] and sum(r[0] is None for r in rows) == k  # rows without a key are added
    assert json.loads(next(iter(spark.read.text(f"{target}/_manifest/0.json").collect())).value).keys() == {"a", "c"}


def test_rows_over_line_ends_and_splits(spark, tmp_path):
    rows = [(f"CVE-{k}", "a, b" if k % 2 else f'say ""{k}""\nand, more\n\nlines, of, it' if k % 3 else "x" * 50, str(k)) for k in range(400)]
    lines = ["v 1", "d 2", "Name,Text,N", *["x"] * 7, *(f'{a},"{b}",{c}' for a, b, c in rows), "wide,\"q, q\nq\",1,2"]
    (tmp_path / "m.csv").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 700)
    try:
        assert spark.read.text(str(tmp_path / "m.csv")).rdd.getNumPartitions() > 5
        got, head = csv.read_preamble_csv(spark, str(tmp_path / "m.csv"))
        found = list(map(tuple, got.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert head == {"version": "1", "date": "2"} and got.columns == ["Name", "Text", "N", "column_3"]
    assert found == [*((a, b.replace('""', '"'), c, None) for a, b, c in rows), ("wide", "q, q\nq", "1", "2")]


def test_manifests(spark, tmp_path):
    at = str(tmp_path)
    assert storage.read_manifest(spark, at) == (None, {})
    for n in (0, 2, 10):
        storage.write_manifest(spark, at, n, {"n": n})
    assert storage.read_manifest(spark, at) == (10, {"n": 10}) and storage.read_manifest(spark, at, 1) == (2, {"n": 2}) and storage.read_manifest(spark, at, 3) == (None, {})

"""Statistics over implied zeros, folds, wheels, averages and ranks of groups that hold all rows, and one-class evaluation."""

import random

import pytest
from pyspark.sql import functions as F

from riskframe.functions import text as X
from riskframe.operators import catalogue as K
from riskframe.operators import collections as C
from riskframe.operators import enrich as E
from riskframe.operators import evaluate as V
from riskframe.operators import search as H
from riskframe.operators import statistics as S

STOP = ["the", "of"]


def dense_dataset(triples, least_share, least_ones, families=S.FAMILIES):
    """Filter and normalisation over dense rows, in plain Python; values other than 0."""
    fam = lambda f: next((p for p in families if f.startswith(p)), "")
    rows = {}
    for e, f, v in triples:
        rows.setdefault(e, {})[f] = v
    names = {f for r in rows.values() for f in r}
    for r in rows.values():
        read = {fam(f) for f in r}
        r.update({f: 0.0 for f in names if "_enum_" in f and fam(f) in read and f not in r})
    out, total = {}, len(rows)
    kept, scale, rare = set(), {}, set()
    for f in names:
        v = [r[f] for r in rows.values() if f in r]
        if f.startswith("vendor_"):
            if len(set(v)) <= 1 or v.count(1) < least_ones or f == "vendor_enum_-":
                rare.add(f)
            kept.add(f)
        elif len(set(v)) > 1 and len(v) >= least_share * total:
            kept.add(f)
            if min(v) != max(v) and not (min(v) in (-1, 0, 1) and max(v) in (-1, 0, 1)):
                scale[f] = (min(v), max(v) - min(v))
    for e, r in rows.items():
        for f, v in r.items():
            if f in rare:
                if v == 1:
                    out[e, "vendor_enum_absent"] = 1.0
            elif f in kept:
                x = (v - scale[f][0]) / scale[f][1] if f in scale else v
                out[e, f] = max(x, out.get((e, f), 0.0)) if f == "vendor_enum_absent" else x
    return {k: round(v, 9) for k, v in out.items() if v}


def found_dataset(df, **options):
    return {(r.entity, f): round(v, 9) for r in K.build_dataset(df, **options).collect() for m in (r.features, r.labels) for f, v in m.items() if v}


def test_features_survive_the_dataset(spark):
    rows = [(f"CVE-{k}", "Entry" if k % 3 else "Candidate", "LOW" if k % 2 else "???", ["acme"] if k % 4 else ["-"], 1.5 * k, "heap overflow of the stack" if k % 2 else "cross site of the page") for k in range(10)]
    flat = spark.createDataFrame(rows, "cve string, Status string, CVSS_AC string, vendors array<string>, CVSS_score double, Description string")
    triples = K.cve_features(flat, STOP, 2)[0]
    data = K.build_dataset(triples, least_ones=3).collect()
    names = {f for r in data for f in r.features}
    assert {"cvss_score", "cvss_ac_enum_low", "cvss_ac_enum_absent", "status_enum_entry", "status_enum_candidate", "vendor_enum_acme", "description_enum_heap_overflow", "description_enum_cross_site"} <= names
    assert "vendor_enum_-" not in names and "vendor_enum_absent" in names and sorted((r["index"], r.entity) for r in data) == [(k, f"CVE-{k}") for k in range(10)]
    assert found_dataset(triples, least_ones=3) == dense_dataset([tuple(r) for r in triples.collect()], 0.8, 3)


def test_normalize_against_dense_rows(spark):
    rng = random.Random(4)
    rows = []
    for k in range(40):
        e = f"e{k:02}"
        rows += [(e, f"status_enum_{rng.choice('abc')}", 1.0), (e, "score", rng.randint(-3, 9) / 2), (e, f"vendor_enum_{rng.choice('xyz-')}", 1.0)]
        if rng.random() < 0.9:
            rows += [(e, f"cwe_kind_enum_{rng.choice('pq')}", rng.choice([1.0, 2.0])), (e, "cwe_count", float(rng.randint(1, 5))), (e, "exploits_days", float(rng.randint(-4, 4)))]
        if rng.random() < 0.3:
            rows += [(e, "capec_kind_enum_r", 1.0), (e, "exploits_rare", 1.0)]
        if rng.random() < 0.5:
            rows.append((e, "odd_enum_n", -2.0))
    df = spark.createDataFrame(rows, "entity string, feature string, value double")
    for share, ones in ((0.8, 12), (0.2, 1), (1.0, 33)):
        assert found_dataset(df, least_share=share, least_ones=ones) == dense_dataset(rows, share, ones)
    stats = {r.feature: r for r in S.analyze(df, S.total_entries(df, "entity"), F.startswith("feature", F.lit("vendor_"))).collect()}
    assert stats["status_enum_a"].present == 40 and stats["status_enum_a"].n_distinct == 2 and stats["odd_enum_n"]["max"] == 0 and stats["score"].zeros == 0
    assert stats["cwe_kind_enum_p"].present == stats["cwe_count"].present < 40
    assert K.build_dataset(df.limit(0)).collect() == []


def test_phrase_counts_both_ways(spark, monkeypatch):
    rows = [(k, "the heap overflow of heap overflows the naïve café of x" if k % 2 else None if k == 4 else "the café of noise") for k in range(8)]
    df = spark.createDataFrame(rows, "id long, text string")
    near = sorted(map(tuple, X.phrase_counts(df, "id", "text", STOP, noise=["noi"], min_df=2).collect()))
    monkeypatch.setattr(X, "BROADCAST", 0)
    monkeypatch.setattr(X, "FEW", 0)
    assert sorted(map(tuple, X.phrase_counts(df, "id", "text", STOP, noise=["noi"], min_df=2).collect())) == near
    assert (1, "heap overflow", 2, 4) in near and (1, "naïve café", 1, 4) in near and (0, "café", 1, 3) in near and not any("noise" in p or i == 4 for i, p, _, _ in near)
    text = " ".join("ab" * (k % 5) + "c" for k in range(200))
    terms = ["ab", "abab", "c", "bc ab", "zz", " "]
    assert X.substring_counts(text, terms) == [max(1, text.count(t)) for t in terms]


def test_lemmas_beside_the_texts(spark, monkeypatch):
    df = spark.createDataFrame([(1, "Boxes of geese, churches; women's buses"), (2, None), (3, "")], "id long, text string")
    words = spark.createDataFrame([("geese", "goose"), ("buses", "bus")], "word string, lemma string")
    found = X.lemmatized_text(df, "id", "text", words)
    assert "Exchange" not in found._jdf.queryExecution().toString() and "Join" not in found._jdf.queryExecution().toString()
    near = sorted(map(tuple, found.collect()))
    assert near == [(1, "Boxe of goose church women' bus"), (3, "")]
    monkeypatch.setattr(X, "BROADCAST", 0)
    assert sorted(map(tuple, X.lemmatized_text(df, "id", "text", words).collect())) == near


def test_enum_fold(spark):
    rng, rows, want = random.Random(2), [], {}
    for k in range(200):
        acc = 0.0
        for p in range(rng.randint(1, 9)):
            v = float(rng.choice([0, 0, 1, 1, 2, 3]))
            rows.append((k, p, v))
            acc = v if acc == 0 else 1.0 if acc == 1 and v in (0, 1) else acc + v
        want[k] = acc
    rng.shuffle(rows)
    df = spark.createDataFrame([*rows, (999, 0, 1.0), (999, 1, None)], "k int, p int, v double")
    assert {r.k: r.value for r in E.enum_fold(df, ["k"], "p", "v").collect()} == {**want, 999: None}
    big = spark.range(1_000_000).select(F.lit(1).alias("k"), F.col("id").alias("p"), (F.col("id") % 3).cast("double").alias("v"))
    plan = E.enum_fold(big, ["k"], "p", "v")
    assert plan.first().value == 1 + 999_999 - 1 and "collect_list" not in plan._jdf.queryExecution().toString()


def test_wheel_of_a_million(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit(None).cast("int").alias("none"), F.lit(7).alias("g"), F.col("id").alias("k"), F.when(F.col("id") % 10 == 0, 0.0).otherwise(1.0 + F.col("id") % 2).alias("fit"))
    bounds = H.roulette_bounds(df, "fit", "k", ["g"])
    drawn = H.roulette(bounds, ["g"], n, 3)
    r = drawn.agg(F.count("*").alias("n"), F.countDistinct("draw").alias("d"), F.sum((F.col("k") % 10 == 0).cast("int")).alias("none"), F.avg((F.col("fit") == 2).cast("int")).alias("two")).first()
    assert (r.n, r.d, r.none) == (n, n, 0) and abs(r.two - 10 / 14) < 0.005
    few = spark.createDataFrame([("a", k, f) for k, f in enumerate([1.0, 0.0, 3.0, -1.0])] + [("b", 9, 2.0), ("c", 5, 0.0)], "g string, k int, fit double")
    b = {(r.g, r.k): (r.low, r.high) for r in H.roulette_bounds(few, "fit", "k", ["g"]).collect()}
    assert b["a", 0] == (0, 2) and b["a", 1] == (2, 3) and b["a", 2] == (3, 7) and b["a", 3] == (7, 7) and b["b", 9] == (0, 2)
    got = H.roulette(H.roulette_bounds(few, "fit", "k", ["g"]), ["g"], 2000, 1).collect()
    assert len(got) == 4000 and {r.k for r in got if r.g == "b"} == {9} and {r.k for r in got if r.g == "a"} == {0, 1, 2}
    assert abs(sum(r.k == 2 for r in got) / 2000 - 4 / 7) < 0.05


def test_ranks_and_averages_of_one_group(spark):
    n = 300_000
    df = spark.range(n).select(F.lit("g").alias("g"), ((F.col("id") * 7919) % n).alias("x"), F.col("id").alias("k"))
    smooth = V.smooth(df.withColumn("v", F.col("x").cast("double")), ["g"], "x", "v")
    assert smooth.where("abs(smooth - x) > 1e-9").count() == 0 and smooth.count() == n
    rank = H.rank_fitness(df, "x", "k", "incremental")
    assert rank.where("fitness <> x + 1").count() == 0 and rank.count() == n
    assert H.rank_fitness(df, "x", "k", "relative", group=["g"]).agg(F.max("fitness")).first()[0] == 50.0
    unit = V.normalize_curve(df, ["g"], "x", "k").agg(F.min("nx"), F.max("nx"), F.min("ny"), F.max("ny")).first()
    assert tuple(unit) == (0, 1, 0, 1)
    small = spark.createDataFrame([("a", k, float(k * k)) for k in range(9)] + [(None, k, 1.0) for k in range(3)], "g string, t int, v double")
    for box in (3, 7):
        got = {(r.g, r.t): r.smooth for r in V.smooth(small, ["g"], "t", "v", box).collect()}
        half = box // 2
        for t in range(9):
            near = [float(x * x) for x in range(max(0, t - half), min(9, t + half + 1))]
            assert abs(got["a", t] - (t * t if t < 2 or t > 6 else sum(near) / len(near))) < 1e-9
        assert got[None, 1] == 1


def test_carried_values(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 1700 == 3, F.col("id")).alias("v"))
    got = {r.id: r.c for r in C.with_carried(df, {"c": F.col("v")}, "id").collect()}
    assert got[0] is None and all(got[k] == (k - 3) // 1700 * 1700 + 3 for k in range(3, 5000))


@pytest.mark.parametrize("labels", [[1, 1, 1], [0, 0, 0], []])
def test_one_class(spark, labels):
    df = spark.createDataFrame([(y, 0.1 * k) for k, y in enumerate(labels)], "y int, s double")
    assert V.roc_auc(df, "y", "s").first().auc is None
    assert V.roc_curve(df, "y", "s").count() == len(labels) and V.pr_curve(df, "y", "s").count() == len(labels)
    auc = V.pr_auc(df, "y", "s").first().auc
    assert auc is None if not any(labels) else abs(auc - 1) < 1e-9
    assert H.progress(df, df.limit(0)).first().percent is None
    assert [r.positive_percent for r in S.class_balance(df.withColumn("g", F.lit("a")).withColumn("y", F.lit(None).cast("int")), "g", "y").collect()] == [None] * (2 if labels else 0)


def test_record_features_shuffle_no_texts_and_no_values(spark, monkeypatch):
    """What AQE would merge by compressed bytes into few tasks: neither one-hot values of single rows nor texts are dealt out."""
    monkeypatch.setattr(X, "BROADCAST", 0)
    rows = [("a", ["x y", "x_y", None], "L", "big words here"), ("b", [], None, "big words there"), ("c", None, "l", None)]
    df = spark.createDataFrame(rows, "cve string, vendors array<string>, Status string, Description string")
    triples = K.cve_features(df, ["of"], 2)[0]
    plan = triples._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert not any("feature" in line or "text" in line for line in shuffled), shuffled
    got = sorted((r.entity, r.feature, r.value) for r in triples.collect() if r.feature.startswith(("vendor", "status")))
    absent = [("b", "status_enum_absent", 1.0), ("b", "vendor_enum_absent", 1.0), ("c", "status_enum_l", 1.0), ("c", "vendor_enum_absent", 1.0)]
    assert got == [("a", "status_enum_l", 1.0), ("a", "vendor_enum_absent", 1.0), ("a", "vendor_enum_x_y", 1.0), *absent]
    twice = df.unionByName(df).select("cve", "vendors")  # rows of a key meet, in parts that aren't merged
    assert sorted((r.cve, r.feature) for r in X.one_hot(twice, "cve", ["vendors"]).collect()) == [("a", "vendors_enum_absent"), ("a", "vendors_enum_x_y"), ("b", "vendors_enum_absent"), ("c", "vendors_enum_absent")]
    assert "REPARTITION_BY_NUM" in X.one_hot(twice, "cve", ["vendors"])._jdf.queryExecution().executedPlan().toString()


def test_enrichment_folds_by_hash(spark, monkeypatch):
    """Positions of two lists are one long, so folds need no sort of their rows; order and values stay those of the pairs."""
    from riskframe.plans import QUERIES

    plans, saved = [], E.saved
    monkeypatch.setattr(E, "saved", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), saved(df, name))[1])
    QUERIES["enrich_full"](spark, "/root/testdata/sf0.001")
    assert len(plans) == 2 and not any("SortAggregate" in p for p in plans)
    rng = random.Random(8)
    rows = [(k, a, b, float(rng.choice([0, 1, 1, 2, 3]) if k else rng.choice([0, 1]))) for k in range(6) for a in range(4) for b in rng.sample([0, 1, 9, 2**31 - 1], 3)]
    df = spark.createDataFrame(rows, "k int, a int, b int, v double").withColumn("at", E.place(F.col("a"), F.col("b")))
    want = {}
    for k, _, _, v in sorted(rows):
        have = want.get(k, 0.0)
        want[k] = v if have == 0 else 1.0 if have == 1 and v in (0, 1) else have + v
    assert {r.k: r.value for r in E.fold(df, ["k"], "at", "v").collect()} == want
    assert {r.k: r.value for r in E.fold(df.where("k = 0"), ["k"], "at", "v").collect()} == {0: want[0]}  # no row is met again


def test_often_held_features_are_not_dealt(spark, monkeypatch):
    """Where statistics are no small table: rows of a feature that every record has stay where they are, and no rows are dealt by feature into parts that AQE merges by compressed bytes."""
    monkeypatch.setattr("riskframe.functions.joins.SMALL", 0)
    rng, plans = random.Random(5), []
    kept = S.saved
    for m in (S, C):
        monkeypatch.setattr(m, "saved", lambda df, name: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), kept(df, name))[1])
    rows = [r for k in range(300) for r in ((f"e{k:03}", "status_enum_a" if k % 3 else "status_enum_b", 1.0), (f"e{k:03}", "score", k / 4), (f"e{k:03}", f"description_enum_{rng.randrange(150)}", 1.5), (f"e{k:03}", f"vendor_enum_{k % 70}", 1.0))]
    rows += [(f"e{k:03}", "exploits_days", float(k % 5 - 2)) for k in range(270)]
    df = spark.createDataFrame(rows, "entity string, feature string, value double")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert found_dataset(df, least_ones=5) == dense_dataset(rows, 0.8, 5)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    dealt = [(name, line) for name, p in plans for line in p.split("\n") if "Exchange hashpartitioning(feature#" in line and name not in ("stats", "plan")]
    assert all(name == "met" for name, _ in dealt) and sorted("REPARTITION_BY_NUM" in line for _, line in dealt) == [False, True], dealt  # the statistics and the rows of rare features
    assert any("Exchange hashpartitioning(entity#" in line and "REPARTITION_BY_NUM" in line for name, p in plans for line in p.split("\n") if name == "rows")


def test_join_by_counted_keys(spark, monkeypatch):
    from riskframe.functions import joins as J

    rows = spark.range(0, 8000, numPartitions=8).select("id", F.when(F.col("id") % 2 == 0, "all").otherwise(F.concat(F.lit("f"), F.col("id") % 1999)).alias("word"))
    rows = rows.unionByName(spark.createDataFrame([(-1, None), (-2, "none")], "id long, word string"))
    table = rows.where("id >= 0").groupBy("word").agg(F.count("*").alias("n"))
    want = sorted(map(tuple, rows.join(table, "word").select("id", "word", "n").collect()))
    for small in (J.SMALL, 0):
        monkeypatch.setattr(J, "SMALL", small)
        met = J.join_counted(rows, table, "word", "n").select("id", "word", "n")
        assert sorted(map(tuple, met.collect())) == want
        assert met.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 1500
    assert J.join_counted(rows, table.limit(0), "word", "n").collect() == []

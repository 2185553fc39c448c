"""Periodic runs, centroid clusters and quality against brute force and odd rows."""

import hashlib
import math
import os
import random
import zlib

import duckdb
import numpy as np
import pytest

SF = "/root/testdata/sf0.001"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def brute_runs(w, least):
    n, out = len(w), set()
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s = w[i : j + q]
            if len(s) >= max(least, 3 * q) and not any(s[p:] == s[:-p] for p in range(1, q)):
                out.add((i, len(s), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def found_runs(w, least):
    from riskframe.llm import periodic_runs as P

    h = np.array([zlib.crc32(str(x).encode()) * 2654435761 for x in w], np.uint64)
    chosen = np.nonzero(P.repeated_windows(h, np.array([0, len(w)]), P._shallow(least)))[0]
    return P.runs_of(np.array(w, np.int64), chosen, least) if len(chosen) else []


def test_runs_are_maximal_pairs():
    rng = random.Random(3)
    for _ in range(400):
        w, least = [], rng.choice([3, 6, 12, 24])
        n = rng.randint(0, 120)
        while len(w) < n:
            part = [rng.randint(0, 2) for _ in range(rng.randint(1, 9))]
            w += (part * rng.randint(1, 9))[: rng.randint(1, 60)]
        assert found_runs(w, least) == brute_runs(w, least)
    a, b = [0], [1]
    for _ in range(9):
        a, b = b, b + a
    assert found_runs(b, 6) == brute_runs(b, 6)
    # one word throughout, many left words before one phrase, and a run of 200 words: n log n
    assert found_runs([0] * 60_000, 24) == [(0, 60_000, 1)]
    assert found_runs([x for k in range(3000) for x in [100 + k, *range(16)]], 24) == []
    assert found_runs([5, *list(range(200)) * 100, 7], 24) == [(1, 20_000, 200)]


def test_periodic_runs_rows(spark):
    from riskframe.llm.periodic_runs import periodic_runs

    twice = "x " + "a b c " * 10 + "y"
    rows = [(1, None, 0), (2, "", 0), (3, " \t\n ", 0), (4, twice, 0), (4, twice, 0), (None, "a " * 24, 0), (6, "é z " * 30, 1), (7, "ab " * 50_000 + "end", 0), (8, "a " * 23, 0)]
    got = periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, runs long")).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 9 and all(by[k].n_words == 0 and not by[k].runs and by[k].collapsed == "" for k in (1, 2, 3))
    assert [tuple(r) for r in by[4].runs] == [(1, 30, 3)] and by[4].collapsed == "x a b c y" and sum(r.doc_id == 4 for r in got) == 2
    assert [tuple(r) for r in by[None].runs] == [(0, 24, 1)] and by[None].collapsed == "a" and by[6].collapsed == "é z" and by[6].n_words == 30
    assert [tuple(r) for r in by[7].runs] == [(0, 50_000, 1)] and by[7].collapsed == "ab end" and not by[8].runs
    assert periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def brute_clusters(rows, k, rounds):
    v = [(i, tuple(math.floor(64 * x) for x in e)) for i, e in rows]
    cent = [e for _, e in sorted(v, key=lambda r: (sha(f"1:{r[0]}"), r[1]))[:k]]
    near = lambda e: min((sum((x - y) ** 2 for x, y in zip(e, c, strict=True)), n) for n, c in enumerate(cent))
    for _ in range(rounds):
        own = {}
        for _, e in v:
            own.setdefault(near(e)[1], []).append(e)
        for c, es in own.items():
            cent[c] = tuple(sum(col) // len(es) for col in zip(*es, strict=True))
    done = [(i, near(e)) for i, e in v]
    total = {}
    for _, (d, c) in done:
        total[c] = total.get(c, 0) + d
    return sorted((i, c, d, total[c], sum(total.values()), sha(",".join(map(str, cent[c])))) for i, (d, c) in done)


@pytest.mark.parametrize("size, far", [(1.0, 0.0), (3e4, -5e5), (1.0, 2.0**40)])
def test_clusters(spark, size, far):
    from riskframe.llm.centroid_clustering import centroid_clusters

    rng = np.random.default_rng(5)
    rows = [(k, [far, *(rng.normal(size=63) * size + (k % 3)).tolist()]) for k in range(60)] + [(100 + k, [far] + [size * 0.25] * 63) for k in range(5)]
    odd = [(200, None), (201, [0.0] * 63), (202, [0.0] * 65), (203, [None] * 64), (204, [float("nan")] * 64), (205, [float("inf"), *[0.0] * 63]), (206, [])]
    df = spark.createDataFrame([(i, e, 0) for i, e in rows + odd], "vec_id long, embedding array<double>, cluster int").repartition(5)
    for k in (16, 4, 200):
        assert sorted(tuple(r) for r in centroid_clusters(df, k=k).collect()) == brute_clusters(rows, k, 3)
    assert centroid_clusters(df.where("vec_id >= 200")).collect() == []


def test_cluster_repeats_and_ties(spark):
    from riskframe.llm.centroid_clustering import centroid_clusters

    one = [0.5] * 64
    got = centroid_clusters(spark.createDataFrame([(1, one), (1, one), (2, one), (None, one)], "vec_id long, embedding array<float>"), k=3).collect()
    assert len(got) == 4 and {(r.cluster, r.distance, r.inertia) for r in got} == {(0, 0, 0)}


def test_class_prior_and_threshold():
    from riskframe.llm.quality import class_prior, risk_threshold

    good, bad = np.zeros(100, np.int64), np.zeros(100, np.int64)
    good[60:] = 2000
    bad[:40] = 500
    assert abs(class_prior(good, good + bad) - 0.8) < 0.02
    assert 40 <= risk_threshold(good, good + bad, 0.8) <= 60
    assert class_prior(np.zeros(5, np.int64), np.ones(5, np.int64)) == 0.5


def test_quality_rows(spark):
    from riskframe.llm.quality import quality

    rng = random.Random(1)
    docs, labels = [], []
    for k in range(600):
        bad = k % 4 == 0
        text = " ".join(("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) + ("!!" if bad else "")) for _ in range(rng.randint(5, 40)))
        docs.append((k, text.upper() if bad else text, 0.0))
        labels.append((k, int(not bad)) if k % 5 else (k, None))
    docs += [(1000, None, 0.0), (1001, "", 0.0), (None, "some plain words", 0.0), (1, docs[1][1], 0.0), (1002, "WORD!! " * 50_000, 0.0)]
    df, marks = spark.createDataFrame(docs, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality(df, marks).collect()
    assert len(got) == len(docs) and all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert sum(r.predicted == int(r.doc_id % 4 != 0) for r in held) / len(held) > 0.95
    score = {r.doc_id: r.score for r in got}
    assert score[1000] == score[1001] and len({r.score for r in got if r.doc_id == 1}) == 1 and score[1002] < 0.5
    # labels of the held-out fold and of bad documents change nothing
    other = marks.selectExpr("doc_id", "case when quality = 1 and crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1 then 1 end as quality")
    assert {(r.doc_id, r.score) for r in quality(df, other).collect()} == {(r.doc_id, r.score) for r in got}
    assert {r.score for r in quality(df, marks.where("quality = 0")).collect()} == {0.5}
    assert quality(df.limit(0), marks).collect() == [] and quality(df.limit(0), marks.limit(0)).collect() == []


def test_op11(spark):
    from riskframe.llm.queries import op11_quality

    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op11_quality(spark, sf).collect()}
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality is not None}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [(got[i].predicted, y) for i, y in marks.items() if i in got and got[i].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.9
    assert {(r.doc_id, r.score) for r in op11_quality(spark, sf).collect()} == {(i, r.score) for i, r in got.items()}


@pytest.mark.parametrize("name", ["op12_centroid_clustering", "op13_periodic_runs"])
def test_sql(spark, name):
    from riskframe.llm import queries as Q

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    df = Q.queries()[name](spark, SF)
    res = c.execute(Q.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in df.collect()))) == sorted(map(repr, res.fetchall()))

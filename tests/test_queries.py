"""Every query outside the llm subpackage: SQL for the same rows on the smallest tables; the package stands without llm."""

import datetime
import decimal
import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from riskframe.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(round(v, 5))
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    if name not in SQL:
        assert got
        return
    res = duck.execute(SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    assert got == sorted(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in res.fetchall())


def test_imports_without_llm(tmp_path):
    repo = Path(__file__).resolve().parent.parent
    for p in repo.iterdir():
        if p.name not in ("riskframe", "corpus_pipeline.py", ".git"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "riskframe").mkdir()
    for p in (repo / "riskframe").iterdir():
        if p.name != "llm":
            (tmp_path / "riskframe" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'enrich_full' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True)

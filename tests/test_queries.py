"""Every query of the engine against its SQL, on the smallest tables."""

import duckdb
import pytest

from assayer import queries as engine


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in engine.TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v if v is None or isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(engine.ORACLE))
def test_same_rows_as_sql(spark, sf, duck, name):
    df = engine.QUERIES[name](spark, sf)
    rel = duck.sql(engine.ORACLE[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    theirs = sorted((tuple(plain(dict(zip(rel.columns, r))[c]) for c in cols) for r in rel.fetchall()), key=str)
    assert mine == theirs


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(5).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())


def test_engine_stands_without_the_text_subpackage():
    import pathlib
    import re

    root = pathlib.Path(engine.__file__).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"assayer\.llm|corpus_pipeline", f.read_text()), f


def test_plans(spark, sf):
    plan = engine.QUERIES["catalog_over_documents"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Python" not in plan
    from assayer.operators import typosquat

    plan = typosquat.targets(engine.derive(spark, sf, engine.NAMES), engine.derive(spark, sf, engine.POPULAR))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    from pyspark.sql import functions as F

    from assayer.operators import detonation

    capture = engine.derive(spark, sf, engine.CAPTURE).withColumn("headers", F.lit(None).cast("map<string,string>")).withColumn("body", F.lit(None).cast("binary"))
    planted = engine.derive(spark, sf, "SELECT DISTINCT 'run' || CAST(user_id % 50 AS STRING) AS run_id, 'NPM_TOKEN' AS name, event_type AS value FROM events")
    plan = detonation.leaks(capture, planted)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan

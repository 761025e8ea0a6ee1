"""Every registered query with SQL gives what DuckDB gives on the smallest tables, and plans stay as meant."""

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from moniker.plans import queries as plans

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the generated tables")


def rows(df):
    def one(v):
        if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
            return None
        return f"{float(v):.6f}" if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)

    return sorted((tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_oracle(spark, duck, name):
    got, wanted = entry.queries()[name](spark, str(DATA)).toPandas(), duck.execute(plans.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows(got) == rows(wanted)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_without_sql_runs_and_repeats(spark, name):
    query = entry.queries()[name]
    first = query(spark, str(DATA)).toPandas()
    assert len(first) and rows(first) == rows(query(spark, str(DATA)).toPandas())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_scans_read_only_what_is_needed(spark, capsys):
    entry.queries()["canonical_key"](spark, str(DATA)).explain()
    plan = capsys.readouterr().out
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string>" in plan and "Python" not in plan


def test_native_paths_have_no_python(spark, capsys):
    for name in ("company_groups", "person_variants", "company_variants", "flags_by_detector", "match_topk_margin", "clean_reasons"):
        entry.queries()[name](spark, str(DATA)).explain()
    plan = capsys.readouterr().out
    assert not any(x in plan for x in ("EvalPython", "ArrowEval", "MapInPandas", "MapInArrow"))


@pytest.mark.parametrize("name", ["person_variants", "person_alternatives", "company_variants", "company_lines", "respelled_lines"])
def test_rows_of_one_file_are_spelled_by_several_tasks(spark, name):
    out = plans.QUERIES[name](spark, str(DATA))
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 1


@pytest.mark.parametrize("name", ["detect_titles", "detect_noise", "detect_taint", "flags_by_detector"])
def test_detectors_run_once_by_several_tasks(spark, name):
    plan = plans.QUERIES[name](spark, str(DATA))._jdf.queryExecution().optimizedPlan().treeString()
    lines = plan.split("\n")
    runs = [k for k, line in enumerate(lines) if "aggregate(" in line or "latin chars in" in line]
    dealt = [k for k, line in enumerate(lines) if "Repartition" in line]
    assert runs and dealt and max(runs) < dealt[0]  # above it in the tree, so after it
    assert not any("Filter" in lines[k] for k in runs)

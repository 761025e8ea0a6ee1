"""The registered queries over the smallest tables: against SQL where there is some."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from moniker.llm import registry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the generated tables")


def test_all_eleven_are_registered():
    assert {int(n[2:].split("_")[0]) for n in registry.QUERIES} == set(range(1, 11)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, wanted = entry.queries()[name](spark, str(DATA)).toPandas(), con.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    rows = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).values.tolist()))
    assert rows(got) == rows(wanted)

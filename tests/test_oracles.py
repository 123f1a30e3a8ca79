"""Every registered query of the reference's operators against its oracle, on the smallest tables."""

from collections import Counter

import duckdb
import pandas as pd
import pytest

from tidemark import registry
from tidemark.session import TABLES


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if value is None or value is pd.NA or value != value:
        return None
    if hasattr(value, "isoformat"):
        return str(value)[:26]
    if isinstance(value, bool) or type(value).__name__ == "bool":
        return bool(value)
    return round(float(value), 6) if isinstance(value, (int, float)) or hasattr(value, "dtype") else value


def rows_of(frame, columns):
    return Counter(tuple(plain(v) for v in row) for row in frame[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, sf_dir, db, name):
    got = registry.queries()[name](spark, sf_dir).toPandas()
    want = db.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows_of(got, columns) == rows_of(want, columns)


def test_every_query_has_an_oracle():
    assert set(registry.queries()) == set(registry.oracle_sql()) and len(registry.queries()) >= 70


def test_nothing_but_llm_imports_llm():
    from pathlib import Path

    root = Path(registry.__file__).parent
    for path in root.rglob("*.py"):
        if path.parent.name != "llm":
            assert "tidemark.llm" not in path.read_text()

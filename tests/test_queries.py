"""Registered queries against DuckDB running their SQL over the same tables."""

import os
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from fieldmend import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(catalog.oracle_sql())


def plain(df: pd.DataFrame) -> list[tuple]:
    """Rows in an order of their own, missing values as None and numbers as doubles."""

    def value(v):
        if v is None or (not isinstance(v, str) and pd.isna(v)):
            return None
        return float(v) + 0.0 if isinstance(v, int | float) or hasattr(v, "dtype") else str(v)

    rows = [tuple(map(value, row)) for row in df[sorted(df.columns)].itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple((v is not None, f"{v:.4f}" if isinstance(v, float) else str(v)) for v in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    want = duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want) > 0
    for a, b in zip(plain(got), plain(want), strict=True):
        for v, w in zip(a, b, strict=True):
            assert v == pytest.approx(w, abs=2e-5) if isinstance(v, float) and isinstance(w, float) else v == w


def test_library_without_the_training_data_folder():
    """Everything else imports and lists its queries where the folder of the training-data operators is gone."""
    code = "import sys; sys.modules['fieldmend.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'q_repair_multisample' in e.queries() and not any(n.startswith('op') for n in e.queries())"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True).returncode == 0

"""The corpus queries on empty tables, and on tables with nulls in all columns and repeated rows."""

import pytest

from ledgerloom.llm import queries
from tests.edges import awkward_tables

QUERIES = queries.queries()


@pytest.mark.parametrize("rows", [0, 6])
def test_awkward_tables(spark, sf, tmp_path, rows):
    path = awkward_tables(spark, sf, tmp_path, rows)
    for name, f in QUERIES.items():
        n = f(spark, path).count()
        assert rows or n == (name == "p9_fill"), name

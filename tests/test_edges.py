"""Every query of the core on tables with nulls in all columns and repeated rows, the corpus queries on empty ones too."""

import pytest

from ledgerloom.plans import corpus, evidence, registers, statements
from tests.edges import awkward_tables

CORE = registers.queries() | statements.queries() | evidence.queries() | corpus.queries()


@pytest.fixture(scope="module")
def awkward(spark, sf, tmp_path_factory):
    return awkward_tables(spark, sf, tmp_path_factory.mktemp("awkward"), 6)


@pytest.fixture(scope="module")
def empty(spark, sf, tmp_path_factory):
    return awkward_tables(spark, sf, tmp_path_factory.mktemp("empty"), 0)


@pytest.mark.parametrize("name", sorted(CORE))
def test_nulls_and_repeated_rows(spark, awkward, name):
    CORE[name](spark, awkward).collect()


@pytest.mark.parametrize("name", sorted(corpus.queries()))
def test_empty_tables(spark, empty, name):
    assert CORE[name](spark, empty).count() == 0

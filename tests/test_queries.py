"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry
from checks.compare import connect, differences
from checks.queries import QUERIES
from conftest import DATA

SF = f"{DATA}/sf0.001"
ITERATIVE = {"codebook_fit", "pca_variance", "pca_components", "cluster_vectors", "search_cells_near"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("query", [q for q in QUERIES if q.__name__ not in ITERATIVE], ids=lambda q: q.__name__)
def test_equals_sql(spark, con, query):
    assert differences(spark, con, SF, query, entry.oracle_sql()[query.__name__]) == []


def test_contract(spark):
    own = {q.__name__ for q in QUERIES}
    assert own - set(entry.oracle_sql()) == ITERATIVE and own <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 100

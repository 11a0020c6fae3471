"""Every query with a SQL twin against DuckDB on the smallest tables; the others must run."""

import pytest

from viewloom.plans import ORACLES, QUERIES
from viewloom.plans import channels, grids, information, latent, models, multiview, recordings, records, subjects, synthetic, timeseries  # noqa: F401

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, duck, same, name):
    same(QUERIES[name](spark, SMALL).toPandas(), duck.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"kmeans_mi_matrix"}))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0

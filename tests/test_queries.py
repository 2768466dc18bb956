"""Every query against its SQL on the smallest tables; the others run and have rows."""

import pytest
from tests.conftest import duck, same_rows

from chromalake import catalog

SLOW = {"iterative_lsi", "doublet_scores", "louvain_clusters", "walktrap_clusters", "truncated_svd", "gene_integration"}


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, data, name):
    same_rows(catalog.queries()[name](spark, data).toPandas(), duck(catalog.oracle_sql()[name], data))


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - SLOW))
def test_other_queries_run(spark, data, name):
    assert catalog.queries()[name](spark, data).count() > 0


@pytest.mark.parametrize("name", ["pseudobulk_cells", "pseudobulk_random_cells", "called_peaks_q"])
def test_query_with_rows_on_larger_tables(spark, data, name):
    # the smallest tables have too few cells for a replicate and too few cuts for a q-value
    d = data.replace("sf0.001", "sf0.01")
    got = catalog.queries()[name](spark, d).toPandas()
    assert len(got)
    same_rows(got, duck(catalog.oracle_sql()[name], d))


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5500

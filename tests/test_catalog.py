"""Every registered query at the smallest scale, against its SQL answer where there is one."""

import pytest

from oracle import compare, connect
from parcelscope.plans import catalog
from parcelscope.plans.driver_tables import Tables

FOLDER = "/root/testdata/sf0.001"
QUERIES = catalog.load()
# Queries whose plan is checked for joins that compare everything with everything.
PLANNED = {"UWR-11_underwriting", "SCO-5_scores", "FLG-11_flags_with_impact", "JOI-3_decorated_list", "JOI-5_fuzzy_best_match",
           "DOC-1_classification", "DOC-3_sections", "RES-2_winners", "AGG-22_gut_correlation", "AGG-23_score_bands",
           "ANL-4_comp_sets", "CHG-1_foreclosure_changes", "RNK-1_ranking_snapshot", "JOI-4_exact_identity", "OFR-4_offer_lookup"}


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    query = QUERIES[name]
    plan = query.run(Tables(spark, FOLDER))._jdf.queryExecution().executedPlan().toString() if name in PLANNED else ""
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    if query.sql is None:
        df = query.run(Tables(spark, FOLDER))
        assert df.columns and df.limit(1).collect()
        return
    got, wanted = compare(spark, connection, query, FOLDER)
    assert got == wanted


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["property_id", "rank", "score"]

"""Every item-bank query against its oracle, and the two without one against invariants."""

from __future__ import annotations

import pytest
from conftest import same_rows

from itemlake.operators import graph, select
from itemlake.plans import oracles, queries

SQL = oracles.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, sf_dir, name):
    same_rows(queries.queries()[name](spark, sf_dir), SQL[name], sf_dir)


def test_selection_is_not_changed_by_pruning(spark, sf_dir):
    v = queries.Views(spark, sf_dir)
    requests = [select.Request(1, 6, {"A": 2, "X2": 3}), select.Request(2, 8, None, {"Brand#13": 2, "Brand#11": 3}, None, 1, 2), select.Request(3, 5, None, None, 0.4, 1)]
    pool = v.pool.cache()
    families = graph.derivation_family(v.questions, v.question_versions).cache()
    near = graph.closed_neighbourhood(v.sets, v.links).cache()
    full = sorted(select.select_candidates(requests, pool, families, near, prune=False).collect())
    assert full and full == sorted(select.select_candidates(requests, pool, families, near).collect())
    for r in requests:
        assert sum(x.request_id == r.request_id for x in full) <= r.total


def test_entry_has_a_function_for_every_oracle(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0

"""Every query of the library against its SQL."""

from __future__ import annotations

import pytest

import check_oracles
from conftest import SF_CHECK, SF_SMALL
from watchlake.workload.oracles import ORACLES
from watchlake.workload.queries import QUERIES


@pytest.fixture(scope="module")
def connection():
    return check_oracles.oracle_connection(SF_CHECK)


def test_only_registered_queries_have_sql():
    assert set(ORACLES) <= set(QUERIES)
    # Its SQL would have to repeat the search; test_questions covers it.
    assert set(QUERIES) - set(ORACLES) == {"answer_prompts"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, connection, name):
    result, _, _ = check_oracles.compare(spark, connection, SF_CHECK, name)
    assert result == "ok"


def test_answers_of_users_without_history(spark):
    """On the smallest tables some asking users have no rows at all."""
    connection = check_oracles.oracle_connection(SF_SMALL)
    result, _, _ = check_oracles.compare(spark, connection, SF_SMALL, "answer_batch")
    assert result == "ok"

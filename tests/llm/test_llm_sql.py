"""The registered operators against their SQL."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
import check_oracles
from conftest import SF_CHECK
from watchlake.llm.oracles import ORACLES
from watchlake.llm.queries import QUERIES


def test_all_are_registered():
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())
    # brute force tells: an automaton's labels, a model's pieces, samples of words
    assert set(QUERIES) - set(ORACLES) == {"op6_license_scans", "op9_sentencepiece", "op12_fingerprints"}
    assert "pipeline" in entry.queries() and "pipeline" not in entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    connection = check_oracles.oracle_connection(SF_CHECK)
    result, _, _ = check_oracles.compare(spark, connection, SF_CHECK, name)
    assert result == "ok"

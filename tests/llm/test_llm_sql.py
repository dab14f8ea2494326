"""The package's queries on the small tables: against SQL where there is one, else that they run."""

import os

import oracle
import pytest

from shelfmark.llm.queries import ORACLE, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLE:
        ours, theirs, _ = oracle.differences(spark, name, SF, QUERIES, ORACLE)
        assert not ours and not theirs
    else:
        assert QUERIES[name](spark, SF).count() > 0

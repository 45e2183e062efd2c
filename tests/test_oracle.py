"""Every registered query against its oracle SQL on the smallest tables."""

import oracle
import pytest

from postmill.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(small):
    return oracle.duck(small)


def test_names_agree():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, small, name):
    text, _ = oracle.compare(spark, con, name, small)
    assert text.startswith(("ok", "rows only")), text

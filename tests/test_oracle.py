import pytest

from tarn.plans.oracle import ORACLE
from tarn.plans.queries import QUERIES
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_oracle(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, ORACLE[name]) == ""

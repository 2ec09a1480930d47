"""The queries that SQL can say against DuckDB."""

from __future__ import annotations

import pytest

from tarn.llm.queries import ORACLE, QUERIES
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_oracle(spark, name):
    assert difference(QUERIES[name](spark, SF), connect(SF), ORACLE[name]) == ""

import pytest

from talkgrain.llm.queries import ORACLE, QUERIES
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    assert_same(spark, QUERIES[name], ORACLE[name])


def test_one_query_an_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))

import pytest

from basketry.queries import ITEMSETS, ITEMSETS_SQL
from tests.compare import connect, same

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ITEMSETS))
def test_same_as_sql(spark, con, name):
    assert same(spark, con, name, ITEMSETS[name], ITEMSETS_SQL[name], SF) >= 0

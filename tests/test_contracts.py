import pytest

from changelens.operators import contracts


def test_chains_of_any_depth(spark):
    rows = [(i, i - 1 if i > 1 else None) for i in range(1, 201)] + [(500, 499), (600, None)]
    found = {r.id: (r.depth, r.chain) for r in contracts.chains(spark.createDataFrame(rows, "id long, parent_id long")).collect()}
    assert len(found) == len(rows) and all(found[i] == (i - 1, list(range(1, i))) for i in range(1, 201))
    assert found[500] == (1, [499]) and found[600] == (0, [])
    assert contracts.chains(spark.createDataFrame([], "id long, parent_id long")).count() == 0


def test_chains_in_a_ring(spark):
    with pytest.raises(ValueError):
        contracts.chains(spark.createDataFrame([(1, 3), (2, 1), (3, 2), (4, 3)], "id long, parent_id long"))

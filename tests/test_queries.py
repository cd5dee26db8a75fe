import re

import pytest

import __spark_entry__ as entry
from check import compare, database
from workload.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return database(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql(spark, db, name):
    frame = entry.queries()[name](spark, FOLDER)
    if name not in ORACLES:
        assert frame.count() > 0
        return
    rows, faults = compare(frame, db, ORACLES[name])
    assert not faults


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_operator_of_the_inventory_has_a_query_or_a_test():
    kinds = {"S": 10, "P": 20, "G": 10, "F": 5, "J": 15, "M": 6, "A": 10, "W": 5, "O": 6, "U": 4, "D": 5, "T": 7, "C": 4}
    every = {f"{k}{i}" for k, n in kinds.items() for i in range(1, n + 1)}
    covered = {code for q in QUERIES.values() for code in q.operators.split()}
    # Decoding needs image files, which tests/test_images.py writes.
    assert every - covered == {"S2"}
    assert all(re.fullmatch("[a-z0-9_]+", name) for name in entry.queries())

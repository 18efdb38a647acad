"""Every query with SQL gives the SQL's rows on the smallest tables; the others run."""

import pytest

import __spark_entry__ as entry
from siltstone.queries import ORACLES, QUERIES
from tests.compare import compare

AT = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    rows, wanted, equal = compare(spark, AT, name)
    assert rows > 0
    assert equal or name not in ORACLES, (rows, wanted)


def test_entry(spark):
    assert entry.entry(spark).columns == ["snapshot_no", "doc_id", "change"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_needs_the_text_operators():
    from pathlib import Path

    root = Path(entry.__file__).parent / "siltstone"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "siltstone.llm" not in f.read_text(), f

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from siltstone.operators.snapshots import snapshot_changes

SCHEMA = "snapshot_no int, doc_id string, status string, source_content_hash string, source_last_updated string, retrieved_at timestamp, _key string, change string"


@pytest.fixture(autouse=True)
def compiled(spark):
    """As in production, the code of whole stages is generated."""
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    yield
    spark.conf.set("spark.sql.codegen.wholeStage", "false")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def found(spark, rows):
    return {(r.snapshot_no, r.doc_id, r.change) for r in snapshot_changes(frame(spark, rows)).collect()}


T1, T2 = datetime(2025, 1, 1), datetime(2025, 1, 2)


def test_added_removed_changed_with_gaps(spark):
    rows = [
        (3, "a", "ok", "h", None, T1), (3, "b", "ok", "h", None, T1), (3, "c", "ok", "h", None, T1),
        (5, "a", "ok", "h2", None, T1), (5, "c", "ok", "h", None, T1), (5, "d", "ok", "h", None, T1),
        (9, "a", "ok", "h2", None, T1), (9, "b", "ok", "h", None, T1), (9, "c", "gone", "h", None, T1),
    ]
    assert found(spark, rows) == {(5, "a", "changed"), (5, "b", "removed"), (5, "d", "added"), (9, "b", "added"), (9, "d", "removed"), (9, "c", "changed")}


def test_spelling_does_not_count(spark):
    rows = [
        (1, "a", "OK ", " ABC", "2024-01-01", T1), (2, "a", " ok", "abc\t", "2024-01-01T02:00:00.000+02:00", T1),
        (1, "b", "", None, " ", T1), (2, "b", None, " ", None, T1),
        (1, "c", "ok", "h", "2024-01-01", T1), (2, "c", "ok", "h", None, T1),
        (1, "d", "ok", "h", "soon", T1), (2, "d", "ok", "h", "later", T1),
        (1, "e", "ok", "h", "2024-01-01t00:00:00z", T1), (2, "e", "ok", "h", "2024-01-01 00:00:00", T1),
    ]
    assert found(spark, rows) == {(2, "c", "changed"), (2, "d", "changed")}


def test_latest_row_of_a_delivery_counts(spark):
    rows = [(1, "a", "ok", "h", None, T1), (2, "a", "ok", "old", None, T1), (2, "a", "ok", "h", None, T2), (2, "a", "ok", "h", None, T2), (2, "a", "ok", "nulls are oldest", None, None)]
    assert found(spark, rows) == set()


def test_nulls_empty_and_single(spark):
    assert found(spark, []) == set()
    assert found(spark, [(1, "a", "ok", "h", None, T1)]) == set()
    assert found(spark, [(1, "a", "ok", "h", None, T1), (None, "b", "ok", "h", None, T1), (2, None, "ok", "h", None, T1), (2, "a", "ok", "x" * 100000, None, T1)]) == {(2, "a", "changed")}


def test_columns_that_differ_are_named(spark):
    rows = [(1, "a", "ok", "h", None, T1), (2, "a", "new", "h", "2024-01-01", T1)]
    assert snapshot_changes(frame(spark, rows)).select(F.array_sort("changed_columns").alias("c")).first().c == ["source_last_updated", "status"]


def test_hot_key_is_one_row_a_delivery(spark):
    hot = spark.range(3000).selectExpr("cast(id % 3 as int) snapshot_no", "'hot' doc_id", "'ok' status", "cast(id as string) source_content_hash", "cast(null as string) source_last_updated", "timestamp_seconds(id) retrieved_at")
    assert {(r.snapshot_no, r.change) for r in snapshot_changes(hot).collect()} == {(1, "changed"), (2, "changed")}

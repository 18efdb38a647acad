"""What changed between consecutive full snapshots of a table (problem 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from siltstone.functions.text import blank_to_null

_SPELLED_DATE = r"^\d{4}-\d{2}-\d{2}$"
_NO_ZONE = r"^\d{4}-\d{2}-\d{2}[T ][0-9:.]+$"


def folded(value: Column) -> Column:
    """Case and surrounding white space do not count; blank is null."""
    return F.lower(blank_to_null(value.cast("string")))


def instant(value: Column) -> Column:
    """A date string as a point in time (microseconds, UTC), as text.

    A bare date is midnight UTC and a time without zone is UTC, whatever the session's
    zone. Text that is no time is compared as folded text, so that a change of it is seen.
    """
    text = F.upper(blank_to_null(value.cast("string")))
    zoned = F.when(text.rlike(_SPELLED_DATE), F.concat(text, F.lit("T00:00:00Z"))).when(text.rlike(_NO_ZONE), F.concat(text, F.lit("Z"))).otherwise(text)
    micros = F.unix_micros(zoned.try_cast("timestamp"))
    return F.coalesce(micros.cast("string"), F.lower(text))


def snapshot_changes(
    deliveries: DataFrame,
    *,
    key: str = "doc_id",
    snapshot: str = "snapshot_no",
    order: str = "retrieved_at",
    compared: dict[str, Column] | None = None,
) -> DataFrame:
    """Rows (snapshot, key, change, changed_columns) between consecutive deliveries.

    ``change`` is ``added``, ``removed`` or ``changed`` against the next lower snapshot
    present; ``changed_columns`` names the compared columns that differ (null otherwise).
    ``compared`` maps a name to the expression under which values are compared.

    Within a delivery the row of a key with the latest ``order`` counts; a null ``order`` is
    oldest and full ties go to the largest compared values, so the result is the same for
    any row order. Rows with a null key or snapshot number take no part. Repeated rows count
    once. An empty table, or one delivery alone, gives no rows. Other columns are ignored,
    whatever their names.

    One shuffle by key: the latest row is a partial aggregate, so a key with a third of all
    rows is reduced before the exchange, and the window then sees at most one row a delivery.
    """
    compared = compared or {
        "status": folded(F.col("status")),
        "source_content_hash": folded(F.col("source_content_hash")),
        "source_last_updated": instant(F.col("source_last_updated")),
    }
    named = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(compared.values())])
    rows = deliveries.where(F.col(key).isNotNull() & F.col(snapshot).isNotNull()).select(
        F.col(key).alias("_key"), F.col(snapshot).alias("_no"), F.col(order).alias("_at"), named.alias("_state")
    )
    # one row a delivery: the dense index, and the number of the delivery that follows
    every = Window.orderBy("_no")
    index = rows.select("_no").distinct().select("_no", F.row_number().over(every).alias("_i"), F.lead("_no").over(every).alias("_next"))
    latest = rows.groupBy("_key", "_no").agg(F.max(F.struct("_at", "_state")).alias("_m")).select("_key", "_no", "_m._state")
    by_key = Window.partitionBy("_key").orderBy("_i")
    walked = latest.join(index, "_no").select(
        "_key",
        "_no",
        "_next",
        "_i",
        "_state",
        F.lag("_i").over(by_key).alias("_before"),
        F.lag("_state").over(by_key).alias("_was"),
        F.lead("_i").over(by_key).alias("_after"),
    )
    follows = F.col("_before") == F.col("_i") - 1
    differing = F.filter(
        F.array(*[F.when(~F.col(f"_state.v{i}").eqNullSafe(F.col(f"_was.v{i}")), F.lit(n)) for i, n in enumerate(compared)]),
        lambda x: x.isNotNull(),
    )
    none = F.lit(None).cast("array<string>")

    def event(no: Column, change: str, columns: Column) -> Column:
        return F.struct(no.alias(snapshot), F.lit(change).alias("change"), columns.alias("changed_columns"))

    events = F.array(
        F.when((F.col("_i") > 1) & ~F.coalesce(follows, F.lit(False)), event(F.col("_no"), "added", none)),
        F.when(follows & (F.size(differing) > 0), event(F.col("_no"), "changed", differing)),
        # a gap after this row: absent from the next delivery, if there is one
        F.when(F.col("_next").isNotNull() & ~F.coalesce(F.col("_after") == F.col("_i") + 1, F.lit(False)), event(F.col("_next"), "removed", none)),
    )
    return (
        walked.select(F.col("_key").alias(key), F.explode(events).alias("_e"))
        .where(F.col("_e").isNotNull())
        .select(F.col(f"_e.{snapshot}").alias(snapshot), key, "_e.change", "_e.changed_columns")
    )

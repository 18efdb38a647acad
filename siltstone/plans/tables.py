"""Tables in hash buckets, rewritten bucket by bucket with Spark's own writer, and published snapshots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siltstone.functions.vectors import normalised
from siltstone.operators import corpus
from siltstone.runtime import settle


@dataclass(frozen=True)
class Buckets:
    """A Parquet table partitioned by a hash of its ``keys`` into ``count`` buckets.

    A change rewrites only the buckets of the keys it touches, by dynamic partition overwrite:
    what the buckets will hold is worked out and written to the shared folder first, so a
    change that fails before leaves the table as it was, and one that is run again gives the
    same table. There is one writer at a time. Columns are added by writing rows that have
    them; older files give null.
    """

    path: str
    keys: tuple[str, ...]
    count: int = 64

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_bucket", self._bucket()).repartition("_bucket")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.count)).cast("int")

    def create(self, df: DataFrame) -> None:
        self._bucketed(df).write.partitionBy("_bucket").parquet(self.path)

    def exists(self, spark: SparkSession) -> bool:
        where = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)

    def _files(self, spark: SparkSession) -> DataFrame:
        return spark.read.option("mergeSchema", True).parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return self._files(spark).drop("_bucket")

    def append(self, rows: DataFrame) -> None:
        """Add rows as they are, as further files of their buckets."""
        self._bucketed(rows).write.mode("append").partitionBy("_bucket").parquet(self.path)

    def _rewrite(self, rows: DataFrame, change) -> None:
        spark = rows.sparkSession
        touched = [r[0] for r in rows.select(self._bucket()).distinct().collect()]  # at most ``count`` numbers
        if not touched:
            return
        old = self._files(spark).where(F.col("_bucket").isin(touched))
        new = settle(change(old.drop("_bucket"), rows), "rewritten")
        self._bucketed(new).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(self.path)
        left = {r[0] for r in new.select(self._bucket()).distinct().collect()}
        for bucket in set(touched) - left:  # nothing is left there to overwrite it
            where = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_bucket={bucket}")
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

    def upsert(self, rows: DataFrame) -> None:
        """Rows replace those of the same keys, others are kept; a key twice in ``rows`` is an error."""
        if rows.groupBy(*self.keys).count().where("count > 1").limit(1).count():
            raise ValueError(f"repeated keys {self.keys} in the source")
        self.replace(rows)

    def replace(self, rows: DataFrame) -> None:
        """All rows of the keys that occur in ``rows`` make way for them."""
        if self.exists(rows.sparkSession):
            self._rewrite(rows, lambda old, new: corpus.upsert(old, new, list(self.keys)))
        else:
            self.create(rows)

    def delete_where_in(self, gone: DataFrame) -> None:
        self._rewrite(gone.select(*self.keys), lambda old, new: corpus.delete_where_in(old, new, list(self.keys)))

    def compact(self, spark: SparkSession, latest: list[str] | None = None) -> None:
        """Rewrite all buckets as one file each; with ``latest``, only the last row of each key by those columns."""

        def last(old: DataFrame, _: DataFrame) -> DataFrame:
            if not latest:
                return old
            others = [c for c in old.columns if c not in (*self.keys, *latest)]
            best = old.groupBy(*self.keys).agg(F.max(F.struct(*latest, *others)).alias("_m"))
            return best.select(*[F.col(c) if c in self.keys else F.col(f"_m.{c}").alias(c) for c in old.columns])

        self._rewrite(self.read(spark), last)


def snapshot_rows(chunks: DataFrame, vectors: DataFrame, *, model: str, revision: str, dimension: int) -> tuple[DataFrame, DataFrame]:
    """(rows, facts): chunks with their vectors at unit length, and one row that says whether they
    are fit to be published: rows, ids, unusable, fingerprint, valid.

    A snapshot is valid with at least one row, every chunk once, and a usable vector for each.
    The fingerprint adds up the rows' hashes, so it needs no order and no task holds them all.
    """
    joined = corpus.chunk_vectors(chunks, vectors, model, revision, dimension)
    facts = joined.agg(
        F.count("*").alias("rows"), F.count_distinct("chunk_id").alias("ids"), F.count("problem").alias("unusable"),
        F.sum(F.xxhash64("chunk_id", "chunk_text", "vector").cast("decimal(38,0)")).cast("string").alias("fingerprint"),
    )
    valid = (F.col("rows") > 0) & (F.col("ids") == F.col("rows")) & (F.col("unusable") == 0)
    return joined.withColumn("vector", normalised(F.col("vector"))), facts.withColumn("valid", valid)


_ACTIVE = "snapshot string, model string, revision string, dimension int, fingerprint string, chunks long, at timestamp"


def active_snapshot(spark: SparkSession, root: str):
    """The row of the snapshot under ``root`` that was activated last, or None."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/active")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema(_ACTIVE).parquet(f"{root}/active").orderBy(F.desc("at")).first()


def publish_snapshot(root: str, chunks: DataFrame, vectors: DataFrame, *, model: str, revision: str, dimension: int):
    """Write the chunks with their vectors as a snapshot under ``root`` and activate it, unless nothing changed.

    Rows are written to a folder of their own, and then one row is appended to the list of
    activations, of which the last counts; so readers see a snapshot whole or not at all. A
    snapshot that is not valid is an error and leaves the active one as it is.
    """
    spark = chunks.sparkSession
    rows, facts = snapshot_rows(chunks, vectors, model=model, revision=revision, dimension=dimension)
    found = facts.first()
    if not found["valid"]:
        raise ValueError(f"snapshot not valid: {found['rows']} rows, {found['ids']} ids, {found['unusable']} without a usable vector")
    now = active_snapshot(spark, root)
    about = {"model": model, "revision": revision, "dimension": dimension, "fingerprint": found["fingerprint"], "chunks": found["rows"]}
    if now and all(now[k] == v for k, v in about.items()):
        return now
    name = f"{root}/snapshots/{found['fingerprint'].replace('-', 'n')}-{model}-{revision}"
    rows.drop("problem").write.mode("overwrite").parquet(name)
    row = spark.createDataFrame([(name, *about.values())], _ACTIVE.rsplit(",", 1)[0]).withColumn("at", F.current_timestamp())
    row.coalesce(1).write.mode("append").parquet(f"{root}/active")
    return active_snapshot(spark, root)

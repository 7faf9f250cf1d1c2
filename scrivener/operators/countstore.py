"""A store of counts in buckets that learns by deltas: only the buckets that a delta touches are written again."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class CountStore:
    """Counts by key as a Parquet folder, one sub-folder a bucket of key hashes.

    A batch has a number that grows. A bucket keeps the number of the last batch that it
    took in, beside its rows and in the same file, so a bucket is never ahead of or behind
    its own note: a batch that is given again, or once more after a failure half-way
    through, goes into the buckets that lack it and leaves the others. Batches come from
    one writer, in order; a failed one is given again before the next. Keys may be null;
    ``schema`` lists the keys, then the counts (longs), then the ``last`` columns.
    """

    path: str
    schema: StructType
    keys: Sequence[str]
    counts: Sequence[str]
    #: Columns that keep the value of the greatest ``seq``.
    last: Sequence[str] = ()
    seq: str | None = None
    buckets: int = 256

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _stored(self, spark: SparkSession) -> DataFrame:
        kept = StructType(list(self.schema.fields)).add("_note", "boolean").add("_batch", "long").add("bucket", "integer")
        try:
            return spark.read.schema(kept).parquet(self.path)
        except AnalysisException as e:  # nothing was learned yet
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], kept)

    def table(self, spark: SparkSession) -> DataFrame:
        """The rows: keys, counts, ``last`` columns and ``seq``."""
        return self._stored(spark).where("not _note").select(*self.schema.names)

    def apply(self, delta: DataFrame, batch: int) -> list[int]:
        """Adds the counts of ``delta`` (which may be negative; none falls below 0, and keys whose counts are all 0 go) and gives the buckets that were written.

        The driver gets bucket numbers only. Rows of a key are added up before the shuffle.
        """
        spark, last = delta.sparkSession, [*self.last, *([self.seq] if self.seq else [])]
        added = [F.sum(c).cast("long").alias(c) for c in self.counts]
        newest = [*[F.max_by(c, self.seq).alias(c) for c in self.last], *([F.max(self.seq).alias(self.seq)] if self.seq else [])]
        summed = delta.groupBy(*self.keys).agg(*added, *newest).withColumn("bucket", self._bucket())
        touched = [r["bucket"] for r in summed.select("bucket").distinct().collect()]
        done = {r["bucket"] for r in self._stored(spark).where(F.col("bucket").isin(touched)).groupBy("bucket").agg(F.max("_batch").alias("b")).where(F.col("b") >= batch).collect()}
        todo = sorted(set(touched) - done)
        if not todo:
            return []
        columns = [*self.keys, *self.counts, *last, "bucket"]
        old = self._stored(spark).where(F.col("bucket").isin(todo) & ~F.col("_note")).select(*columns)
        both = old.unionByName(summed.where(F.col("bucket").isin(todo)).select(*columns)).groupBy("bucket", *self.keys).agg(*added, *newest)
        rows = both.withColumns({c: F.greatest(F.col(c), F.lit(0)) for c in self.counts}).where(" or ".join(f"`{c}` > 0" for c in self.counts)).withColumn("_note", F.lit(False))
        notes = spark.range(self.buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(True).alias("_note")).where(F.col("bucket").isin(todo))
        whole = rows.unionByName(notes, allowMissingColumns=True).withColumn("_batch", F.lit(int(batch)).cast("long"))
        # one file a bucket; dynamic overwriting replaces the folders of these buckets at commit and no others
        whole.select(*self.schema.names, "_note", "_batch", "bucket").repartition(len(todo), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)
        return todo

    def feed(self, to_delta: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
        """A function for ``writeStream.foreachBatch``: the batch's number is the stream's, so restarts count nothing twice."""
        return lambda df, batch: self.apply(to_delta(df), batch) and None

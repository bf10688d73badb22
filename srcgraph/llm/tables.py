"""Small Spark helpers of this subpackage."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from srcgraph.session import cut, shared_folder

__all__ = ["cut", "held_out", "labelled_sample", "map_arrow", "parts", "shared_folder", "table"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def map_arrow(frame: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | list[pa.RecordBatch]],
              schema: str) -> DataFrame:
    """``mapInArrow`` with a function from one batch to any number of batches."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from function(batch)
    return frame.mapInArrow(run, schema)


def parts(spark: SparkSession) -> int:
    """Reduce partitions, as the session sizes them for its data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def held_out(doc_id) -> "F.Column":
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def labelled_sample(labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """At most ``per_class`` labelled ids of each class, those with the least hashes.

    Classes are counted first; of a large class only the ids below a hash bound
    that leaves about four times as many go on, so what is sorted is bounded
    whatever the size of the table.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", label)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    bound = F.lit(1 << 30)
    for r in known.groupBy(label).count().where(F.col("count") > 4 * per_class).collect():
        bound = F.when(F.col(label) == F.lit(r[0]), F.lit((1 << 30) * 4 * per_class // r[1])).otherwise(bound)
    order = Window.partitionBy(label).orderBy("_place", "doc_id")
    return (known.withColumn("_place", place).where(F.col("_place") < bound)
            .withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_class)
            .groupBy("doc_id").agg(F.max(label).alias(label)))

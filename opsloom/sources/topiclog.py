"""A topic as an appended table: partition folders, rows by offset, and a sparse offset index.

An append ranks only its own rows and puts them behind what each partition holds. Rows lie
in segments of about ``segment_rows`` offsets, sorted by offset; the index has one row per
segment file group with its first and last offset. A poll looks at the index alone to name the
segments that hold wanted offsets and opens nothing else. The index entry of a batch is
written after its rows, so readers never see half a batch, and a batch that is appended
again changes nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from opsloom.operators.topic import with_offsets, with_partition
from opsloom.plans.durable import durable
from opsloom.plans.sizing import small_side

PARTITIONS = 4
SEGMENT_ROWS = 1_000_000
INDEX = "partition int, segment long, first long, last long, batch long"


class TopicLog:
    """``path`` is a folder that all executors share; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str, partitions: int = PARTITIONS, segment_rows: int = SEGMENT_ROWS):
        self.spark = spark
        self.path = path.rstrip("/")
        self.partitions = partitions
        self.segment_rows = segment_rows

    def index(self) -> DataFrame:
        """One row per batch, partition and segment."""
        try:
            return self.spark.read.schema(INDEX).parquet(f"{self.path}/index")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], INDEX)

    def high_watermarks(self) -> DataFrame:
        """(partition, high_watermark) from the index; partitions without rows have 0."""
        ends = self.index().groupBy("partition").agg((F.max("last") + 1).alias("end"))
        every = self.spark.range(self.partitions).select(F.col("id").cast("int").alias("partition"))
        return every.join(F.broadcast(ends), "partition", "left").select(
            "partition", F.coalesce("end", F.lit(0)).cast("long").alias("high_watermark")
        )

    def append(self, rows: DataFrame, batch: int, key: str = "service_name", seq: str = "seq") -> bool:
        """Adds the rows in the order of ``seq``; False where the batch is in the log already."""
        if not self.index().where(F.col("batch") == batch).isEmpty():
            return False
        ends = F.broadcast(durable(self.high_watermarks()))
        fresh = with_offsets(with_partition(rows, key, self.partitions), seq).join(ends, "partition")
        offset = F.col("offset") + F.col("high_watermark")
        placed = fresh.withColumn("offset", offset).drop("high_watermark")
        placed = placed.withColumn("segment", F.floor(F.col("offset") / self.segment_rows).cast("long"))
        folder = f"{self.path}/data/batch={batch}"
        (
            placed.repartition("partition", "segment")
            .sortWithinPartitions("partition", "segment", "offset")
            .write.mode("overwrite")
            .partitionBy("partition", "segment")
            .parquet(folder)
        )
        held = (
            self.spark.read.schema(self.schema(rows)).parquet(folder)
            .groupBy("partition", "segment")
            .agg(F.min("offset").alias("first"), F.max("offset").alias("last"))
            .withColumn("batch", F.lit(batch).cast("long"))
        )
        held.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/index/entry={batch}")
        return True

    @staticmethod
    def schema(rows: DataFrame) -> StructType:
        """What is stored in the files, and the two folder levels."""
        return (
            StructType([f for f in rows.schema.fields if f.name not in ("partition", "segment", "offset")])
            .add(StructField("offset", LongType()))
            .add(StructField("partition", IntegerType()))
            .add(StructField("segment", LongType()))
        )

    def poll(self, positions: DataFrame, max_records_per_partition: int = 100) -> DataFrame:
        """The rows at ``current <= offset < current + max`` of each partition, with (partition, offset).

        ``positions`` has (partition, current), a row for each partition that was read before.
        The files are those of the segments that overlap a wanted range: their number follows
        what is polled, not what the topic holds.
        """
        every = self.spark.range(self.partitions).select(F.col("id").cast("int").alias("partition"))
        current = F.coalesce("current", F.lit(0)).cast("long").alias("_from")
        wanted = every.join(positions.select("partition", "current"), "partition", "left").select("partition", current)
        wanted = durable(wanted.withColumn("_to", F.col("_from") + max_records_per_partition))
        touched = self.index().join(F.broadcast(wanted), "partition").where("first < _to and last >= _from")
        files = [
            f"{self.path}/data/batch={r['batch']}/partition={r['partition']}/segment={r['segment']}"
            for r in touched.select("batch", "partition", "segment").distinct().collect()
        ]
        if not files:
            return every.select("partition", F.lit(0).cast("long").alias("offset")).limit(0)
        reader = self.spark.read.option("basePath", f"{self.path}/data")
        # Only bounds that all partitions share can go to the files; each one's own follow.
        rows = reader.parquet(*files).drop("batch", "segment")
        span = wanted.agg(F.min("_from").alias("a"), F.max("_to").alias("b")).first()
        near = rows.where((F.col("offset") >= span["a"]) & (F.col("offset") < span["b"]))
        exact = (F.col("offset") >= F.col("_from")) & (F.col("offset") < F.col("_to"))
        return near.join(small_side(wanted), "partition").where(exact).drop("_from", "_to")

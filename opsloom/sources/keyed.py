"""A table with one row per key that is updated in place, cost following the change.

Rows lie in buckets of their key. A merge reads and rewrites only the buckets that the change
touches, into new files; a pointer file then names the files of every bucket. Readers follow
the pointer, so they see the table before or after a merge, never in between. The pointer
carries the batch id: a batch that is merged again changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class KeyedTable:
    """``schema`` includes ``key`` and ``seq``; of the rows of a key the one with the largest ``seq`` stays."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, seq: str, buckets: int = BUCKETS):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.key, self.seq, self.buckets = key, seq, buckets
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def state(self) -> dict:
        """The pointer: number, batches merged, and the folder of each bucket."""
        folder = self._path("pointers")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        last = max((int(n) for n in names if n.isdigit()), default=None)
        if last is None:
            return {"number": 0, "batches": [], "folders": {}}
        stream = self._fs.open(self._path(f"pointers/{last}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, state: dict) -> None:
        """The new pointer is written aside and renamed, which happens as a whole or not at all."""
        aside, name = self._path(f"pointers/_{uuid.uuid4().hex}"), self._path(f"pointers/{state['number']}")
        out = self._fs.create(aside)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not self._fs.rename(aside, name):
            raise RuntimeError(f"another merge has published number {state['number']}")

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows, or those of some buckets."""
        folders = self.state()["folders"]
        paths = sorted({f for b, f in folders.items() if buckets is None or int(b) in buckets})
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{p}" for p in paths])

    def merge(self, change: DataFrame, batch: str) -> bool:
        """Puts the rows of ``change`` in, later ``seq`` first; False where the batch was merged before.

        Rows without a key cannot replace each other and are refused.
        """
        state = self.state()
        if batch in state["batches"]:
            return False
        columns = [f.name for f in self.read().schema.fields]
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("_bucket")
        rows = change.select(*columns).where(F.col(self.key).isNotNull())
        touched = [r["_bucket"] for r in rows.select(bucket).distinct().collect()]
        if touched:
            old = self.read(touched)
            others = [c for c in columns if c != self.key]
            merged = (
                old.unionByName(rows)
                .groupBy(self.key)
                .agg(F.max_by(F.struct(*others), self.seq).alias("_row"))
                .select(self.key, "_row.*")
                .select(*columns, bucket)
            )
            folder = f"data/{uuid.uuid4().hex}"
            merged.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
            state["folders"] |= {str(b): f"{folder}/_bucket={b}" for b in touched}
        state["batches"].append(batch)
        state["number"] += 1
        self._publish(state)
        return True

"""A keyed store that a stream fills: each batch is data first, then an entry of a ledger; readers see what the ledger names."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Fenced(RuntimeError):
    """Another writer has opened the store since."""


class Store:
    """A folder of Parquet data with a ledger of batches; `key` tells its rows apart.

    A batch's rows are written to a folder of their own, and only then does an entry of the ledger, created where none may be
    yet, name that folder. So a batch whose job dies in between leaves a folder that nobody reads and is written again; one that
    is replayed after its entry is skipped. Each writer that opens the store takes the next epoch; one whose epoch is not the
    last may no longer commit. What is read is as consistent as the file system's exclusive creation: on object stores without it one
    writer at a time must be seen to by other means.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        self.epoch = max(self._numbers("epochs"), default=0) + 1
        while not self._create(f"epochs/{self.epoch}", "{}"):
            self.epoch += 1

    def _fs(self, name: str = ""):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _create(self, name: str, text: str) -> bool:
        """Create a small file whole; False if it is there."""
        fs, p = self._fs(name)
        if fs.exists(p):
            return False
        jvm = self.spark.sparkContext._jvm
        own = jvm.org.apache.hadoop.fs.Path(f"{self.path}/.{uuid.uuid4().hex}")
        out = fs.create(own, False)
        out.write(bytearray(text.encode()))
        out.close()
        fs.mkdirs(p.getParent())
        if fs.exists(p) or not fs.rename(own, p):  # a rename never replaces a file
            fs.delete(own, False)
            return False
        return True

    def _numbers(self, folder: str) -> list[int]:
        fs, p = self._fs(folder)
        return [int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()] if fs.exists(p) else []

    def committed(self) -> dict[int, str]:
        """Batch -> folder of what the ledger names: a small record a batch."""
        entries = self.spark.read.schema("batch long, folder string").json(f"{self.path}/ledger") if self._numbers("ledger") else None
        return {r.batch: r.folder for r in entries.collect()} if entries is not None else {}

    def read(self) -> DataFrame:
        """All committed rows."""
        folders = [f"{self.path}/{f}" for f in self.committed().values()]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def commit(self, rows: DataFrame, batch: int, before_entry=lambda: None) -> bool:
        """Add those rows of a batch whose key the store does not have, one a key; False if the batch was there. For foreachBatch.

        `before_entry` is called between data and ledger, for tests of a job that dies there.
        """
        done = self.committed()
        if batch in done:
            return False
        new = rows.dropDuplicates([self.key]).join(self.read().select(self.key), self.key, "left_anti").select(self.spark.createDataFrame([], self.schema).columns)
        folder = f"data/{batch}-{self.epoch}-{uuid.uuid4().hex[:8]}"
        new.write.parquet(f"{self.path}/{folder}")
        before_entry()
        if max(self._numbers("epochs")) != self.epoch:
            raise Fenced(f"epoch {self.epoch} is over")
        if not self._create(f"ledger/{batch}", json.dumps({"batch": batch, "folder": folder})):
            raise Fenced(f"another writer has committed batch {batch}")
        return True

    def complete(self, source: DataFrame) -> bool:
        """Whether the store has exactly the source's keys, each once."""
        have, want = self.read().select(self.key), source.select(self.key).distinct()
        same = have.count() == want.count()
        return same and not have.join(want, self.key, "left_anti").limit(1).count()


def fill(stream: DataFrame, store: Store, checkpoint: str, before_entry=lambda batch: None) -> None:
    """Run a stream into a store until what is there has been read."""
    run = stream.writeStream.foreachBatch(lambda rows, batch: store.commit(rows, batch, lambda: before_entry(batch)) and None)
    run.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def sizes(store: Store) -> DataFrame:
    """Rows of each committed batch."""
    rows = store.read().withColumn("batch", F.regexp_extract(F.input_file_name(), r"/data/(\d+)-", 1).cast("long"))
    return rows.groupBy("batch").agg(F.count(F.lit(1)).alias("rows"))

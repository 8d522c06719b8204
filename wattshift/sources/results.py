"""Result sinks: one JSON object ``{"s", "d", "event_s"}`` per result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def result_json(results: DataFrame) -> DataFrame:
    return results.select(
        "stream_id", "s", F.to_json(F.struct("s", "d", "event_s")).alias("json")
    )


RESULT_FIELDS = "stream_id long, s long, d boolean, event_s long"


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULT_FIELDS).json(path)


def write_results(results: DataFrame, path: str, ordered: bool = False) -> None:
    """Results as JSON lines, in order of stream and ``s`` if asked."""
    rows = results.orderBy("stream_id", "s") if ordered else results
    rows.select("stream_id", "s", "d", "event_s").write.mode("append").json(path)


def stream_results(results: DataFrame, path: str, checkpoint: str):
    """Continuous file sink for a result stream; returns the unstarted writer."""
    return (
        results.select("stream_id", "s", "d", "event_s")
        .writeStream.format("json")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )


def print_results(results: DataFrame):
    """Continuous console output, for debugging."""
    return results.writeStream.format("console").outputMode("append").option("truncate", False)


class ResultTable:
    """The newest result of every ``(stream_id, s)``, in a folder that micro-batches write to.

    A batch writes its own folder, named by its number, so a batch that is repeated after a failure replaces what it had
    written; a folder counts once its write is complete. Readers take the row of the greatest batch, and in a batch of the greatest ``version``.
    ``compact`` settles the newest rows in one folder that stands for all batches up to its number.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _folders(self, kind: str) -> list[int]:
        """Numbers of the complete folders of one kind."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.globStatus(hadoop.Path(f"{self.path}/{kind}-*"))]
        return sorted(int(n.split("-")[1]) for n in names if fs.exists(hadoop.Path(f"{self.path}/{n}/_SUCCESS")))

    def _newest(self, rows: DataFrame, order: Column) -> DataFrame:
        fields = [c for c in rows.columns if c not in ("stream_id", "s")]
        return rows.groupBy("stream_id", "s").agg(F.max_by(F.struct(*fields), order).alias("r")).select("stream_id", "s", "r.*")

    def write_batch(self, rows: DataFrame, batch: int) -> None:
        """For ``foreachBatch``; a batch that a compaction has taken in is not written again."""
        if not any(batch <= done for done in self._folders("upto")):
            versioned = rows if "version" in rows.columns else rows.withColumn("version", F.lit(0))
            self._newest(versioned, F.col("version")).withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{self.path}/batch-{batch}")

    def _all(self) -> DataFrame | None:
        upto = self._folders("upto")[-1:]
        batches = [b for b in self._folders("batch") if not upto or b > upto[0]]
        paths = [f"{self.path}/upto-{b}" for b in upto] + [f"{self.path}/batch-{b}" for b in batches]
        return self.spark.read.parquet(*paths) if paths else None

    def view(self) -> DataFrame:
        """The newest rows."""
        rows = self._all()
        if rows is None:
            raise FileNotFoundError(f"no complete batch in {self.path}")
        return self._newest(rows, F.struct("batch", "version")).drop("batch", "version")

    def compact(self) -> None:
        """Settle what is there; sorted by range, so that a reader of some streams or numbers skips the rest."""
        rows, batches = self._all(), self._folders("batch")
        if rows is not None and batches:
            newest = self._newest(rows, F.struct("batch", "version"))
            newest.repartitionByRange("stream_id", "s").sortWithinPartitions("stream_id", "s").write.mode("overwrite").parquet(f"{self.path}/upto-{batches[-1]}")

    def writer(self, results: DataFrame, checkpoint: str):
        """Continuous upsert of a result stream; returns the unstarted writer."""
        return results.writeStream.foreachBatch(self.write_batch).outputMode("append").option("checkpointLocation", checkpoint)

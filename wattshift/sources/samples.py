"""Sample sources: wire batches (JSON), headerless CSV, feature arrays.

A wire batch is one JSON line ``{"stream_id", "batch_no", "records": [{"i", "voltage",
"current"}]}``; numbers may come as text, and ``"records": ""`` marks the end of a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattshift.functions.power import event_time

CSV_SCHEMA = "i long, voltage double, current double"
# Fields are read as text so that numbers and numeric strings decode alike.
_RECORDS = "array<struct<i:string,voltage:string,current:string>>"
WIRE_SCHEMA = f"stream_id long, batch_no long, records {_RECORDS}"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headerless ``i, voltage, current`` files."""
    return spark.read.schema(CSV_SCHEMA).csv(path, header=False)


def read_feature_arrays(spark: SparkSession, path: str, whole_file: bool = True, broken: bool = False) -> DataFrame:
    """JSON arrays of ``[f1, f2]`` pairs as rows ``(path, series, idx, f1, f2)``.

    One array per file, or one per line with ``whole_file=False`` for large collections. A series is a place,
    not a content: its file, the block of the file that a task reads, and the line in it. With ``broken`` the texts that
    cannot be read, as ``(path, series, value)``.
    """
    text = spark.read.text(path, wholetext=whole_file).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"))
    placed = text.withColumn("series", F.xxhash64("path", "block", "line"))
    pairs = F.from_json("value", "array<array<double>>")
    if broken:
        return placed.filter(pairs.isNull()).select("path", "series", "value")
    return placed.select("path", "series", F.posexplode(pairs).alias("idx", "pair")).select(
        "path", "series",
        F.col("idx").cast("long").alias("idx"),
        F.get("pair", F.lit(0)).alias("f1"),
        F.get("pair", F.lit(1)).alias("f2"),
    )


def _typed(records: Column) -> Column:
    """Records with their fields cast, and whether all three could be read."""

    def cast(r: Column) -> Column:
        i = F.when(r["i"].rlike("^[+-]?[0-9]+$"), r["i"].try_cast("long"))
        voltage, current = r["voltage"].try_cast("double"), r["current"].try_cast("double")
        return F.struct(
            i.alias("i"),
            voltage.alias("voltage"),
            current.alias("current"),
            (i.isNotNull() & voltage.isNotNull() & current.isNotNull()).alias("good"),
        )

    return F.transform(records, cast)


def decode_records(batches: DataFrame, on_bad: str = "skip") -> DataFrame:
    """Explode wire batches to samples.

    ``on_bad="skip"`` drops the unreadable records only; ``"stop"`` keeps the records before the first
    unreadable one of a batch; ``"keep"`` returns every record with a ``good`` flag, so that bad ones can be
    sent to quarantine: an unreadable batch (null records) is one bad record without fields.
    """
    typed = batches.withColumn("records", _typed(F.col("records")))
    if on_bad == "stop":
        flags = F.transform("records", lambda r: r["good"])
        bad_at = F.array_position(flags, False)
        readable = F.when(bad_at == 0, F.col("records")).otherwise(
            F.slice("records", F.lit(1), (F.greatest(bad_at, F.lit(1)) - 1).cast("int"))
        )
        typed = typed.withColumn("records", readable)
    elif on_bad == "skip":
        typed = typed.withColumn("records", F.filter("records", lambda r: r["good"]))
    else:
        nothing = F.struct(F.lit(None).cast("long").alias("i"), F.lit(None).cast("double").alias("voltage"),
                           F.lit(None).cast("double").alias("current"), F.lit(False).alias("good"))
        typed = typed.withColumn("records", F.coalesce("records", F.array(nothing)))
    rest = [c for c in batches.columns if c != "records"]
    rows = typed.select(*rest, F.inline("records"))
    return rows if on_bad == "keep" else rows.drop("good")


def parse_batches(texts: DataFrame, column: str = "value") -> DataFrame:
    """Wire batches from a text column: null records if unreadable, no records at the end mark."""
    others = [c for c in texts.columns if c != column]
    records = F.from_json(column, f"records {_RECORDS}")["records"]
    return texts.select(*others, F.when(ends_stream(column), F.array().cast(_RECORDS)).otherwise(records).alias("records"))


def ends_stream(column: str = "value") -> Column:
    """Does a wire text carry the end-of-stream mark?"""
    return F.coalesce(F.get_json_object(column, "$.records") == "", F.lit(False))


def to_batches(samples: DataFrame, keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Samples packed into wire texts, one row per stream and batch; ``keep`` names key columns to return beside ``value``."""
    packed = samples.groupBy("stream_id", "batch_no").agg(
        F.sort_array(F.collect_list(F.struct("i", "voltage", "current"))).alias("records"))
    return packed.select(*keep, F.to_json(F.struct("stream_id", "batch_no", "records")).alias("value"))


def end_marks(samples: DataFrame, keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """The wire text that ends each stream, numbered behind the stream's last batch."""
    last = samples.groupBy("stream_id").agg((F.max("batch_no") + 1).alias("batch_no"))
    return last.select(*keep, F.to_json(F.struct("stream_id", "batch_no", F.lit("").alias("records"))).alias("value"))


def wire_batches(texts: DataFrame) -> DataFrame:
    """``(stream_id, batch_no, records, ended, value)`` of wire texts in column ``value``; ids come from readable parts."""
    number = lambda name: F.get_json_object("value", f"$.{name}").try_cast("long").alias(name)
    others = [c for c in texts.columns if c != "value"]
    return parse_batches(texts.select(number("stream_id"), number("batch_no"), ends_stream().alias("ended"), *others,
                                      F.col("value"), F.col("value").alias("_text")), "_text")


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """Samples of a finished collection; what cannot be read is left to ``quarantine``."""
    return decode_records(wire_batches(spark.read.text(path))).drop("ended", "value")


def quarantine(batches: DataFrame) -> DataFrame:
    """``(stream_id, batch_no, i, value)`` of the records, and of whole batches, that cannot be read; for tables and streams of
    ``wire_batches``. A batch without stream or number counts as unreadable."""
    rows = decode_records(batches, on_bad="keep")
    return rows.filter(~F.col("good") | F.col("stream_id").isNull() | F.col("batch_no").isNull()).select(
        "stream_id", "batch_no", "i", "value")


def stream_texts(spark: SparkSession, path: str, files_per_trigger: int = 1, arrival: bool = False) -> DataFrame:
    """Wire batches as they arrive; with ``arrival`` the time of their file in column ``arrived``."""
    texts = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    if arrival:
        texts = texts.select("value", F.col("_metadata.file_modification_time").alias("arrived"))
    return wire_batches(texts)


def stream_batches(spark: SparkSession, path: str, files_per_trigger: int = 1, arrival: bool = False) -> DataFrame:
    """Samples as they arrive with event time ``ts``; a stream's end mark is a row with ``ended`` and no sample."""
    raw = stream_texts(spark, path, files_per_trigger, arrival)
    mark = F.struct(F.lit(None).cast("string").alias("i"), F.lit(None).cast("string").alias("voltage"),
                    F.lit(None).cast("string").alias("current"))
    rows = raw.withColumn("records", F.when(F.col("ended"), F.array(mark)).otherwise(F.col("records")))
    return (decode_records(rows, on_bad="keep").filter(F.col("good") | F.col("ended")).drop("good", "value")
            .withColumn("ts", event_time("i")))

"""Incremental ingestion with Structured Streaming over files.

Every micro-batch goes through the same functions as a batch run. The raw
layer's key, not stream state, decides what is new: its horizon is months. It is
a snapshot table by source and id, so that a batch opens its own buckets alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.hashing import payload_hash
from ..operators.ingest import item_problem, new_documents
from ..sources import feed
from ..storage import SnapshotTable, settled

INPUT = "source_id string, external_id string, url string, payload string, fetched_at timestamp"
RAW = "source_id string, external_id string, content_hash string, url string, payload string, fetched_at timestamp"


def prepare(items: DataFrame, volatile_paths: tuple[str, ...] = ()) -> DataFrame:
    """Usable items with content_hash and an order."""
    good = items.filter(item_problem(F.col("external_id"), F.col("url"), F.col("payload")).isNull())
    return good.withColumn("content_hash", F.coalesce(payload_hash(F.col("payload"), volatile_paths), F.sha2("payload", 256)))


def raw_layer(spark: SparkSession, path: str, buckets: int = 64) -> SnapshotTable:
    """The stored raw documents, in buckets of their source and id."""
    return SnapshotTable.open_or_create(spark, path, spark.createDataFrame([], RAW).schema, ["source_id", "external_id"], buckets)


def append_new(batch: DataFrame, raw: SnapshotTable, volatile_paths: tuple[str, ...] = ()) -> None:
    """Append what the raw layer does not hold; a batch that is run again adds nothing.

    Only the buckets of the batch's keys are opened, and of these only keys
    and hashes. What is appended becomes visible at once or not at all.
    """
    items = settled(prepare(batch, volatile_paths).withColumn("ingest_pos", F.struct("fetched_at", "payload")), "items")
    stored = raw.read(only=raw.touched(items)).select("source_id", "external_id", "content_hash")
    new = settled(new_documents(stored, items), "new")
    if new.limit(1).count():
        raw.append(new)
        raw.compact()


def set_aside(batch: DataFrame, batch_id: int, path: str) -> None:
    """Write the unusable items of a batch with what is wrong; a batch that is run again replaces its own."""
    problem = item_problem(F.col("external_id"), F.col("url"), F.col("payload"))
    batch.withColumn("problem", problem).filter("problem IS NOT NULL").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def from_feeds(spark: SparkSession, path: str) -> DataFrame:
    """The stream of feeds (see sources.feed) as INPUT; an entry counts as fetched when it is read."""
    feed.register(spark)
    rows = spark.readStream.format("sluice_feed").load(path)
    return rows.select(F.col("source").alias("source_id"), "external_id", "url", "payload", F.current_timestamp().alias("fetched_at"))


def ingest_stream(
    spark: SparkSession, inbox: str | DataFrame, raw_path: str, checkpoint: str, volatile_paths: tuple[str, ...] = (), quarantine: str | None = None, within: str | None = None
) -> StreamingQuery:
    """Take in all files of inbox (or rows of a stream of INPUT) that were not taken yet, and stop.

    Unusable items go to the quarantine folder, if one is named. within: an
    interval for which Spark's state remembers items, as a first filter of
    what sources repeat at short intervals; items that are fetched later than
    that after the newest are dropped by Spark, so it is off by default. What
    is new is decided by the raw layer in any case.
    """
    stream = spark.readStream.schema(INPUT).json(inbox) if isinstance(inbox, str) else inbox
    if within is not None:
        stream = stream.withWatermark("fetched_at", within).dropDuplicatesWithinWatermark(["source_id", "external_id", "payload"])
    raw = raw_layer(spark, raw_path)

    def take(batch: DataFrame, batch_id: int) -> None:
        append_new(batch, raw, volatile_paths)
        if quarantine is not None:
            set_aside(batch, batch_id, quarantine)

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Structured Streaming: incremental ingestion of messages and windowed counts of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import conversations
from ..operators.messages import added_messages
from ..session import stored


def event_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def tumbling_counts(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Events and their value per window and type; the watermark bounds the state."""
    w = F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sliding_counts(events: DataFrame, late: str = "1 hour", size: str = "7 days", slide: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide)).agg(F.count(F.lit(1)).alias("n"))


def conversation_state(messages: DataFrame) -> DataFrame:
    """Running bounds and prompt counts by conversation; without a watermark, as late messages count whenever they come."""
    said = F.col("message_type").isin("prompt", "answer")
    return messages.groupBy("conversation_id").agg(
        F.min("timestamp").alias("started_at"), F.max(F.when(said, F.col("timestamp"))).alias("ended_at"), F.count_if(F.col("message_type") == "prompt").alias("user_prompt_count")
    )


def drain(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there now, in micro-batches, and stops."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()


#: Parts that conversations are dealt to, in both tables of an ingestion.
BUCKETS = 16
#: Conversations of a batch up to which stored messages are cut to them by a broadcast; beyond it all of their buckets are counted anew, with the same result.
BROADCAST_IDS = 500_000
DAY_MS = 24 * 3600 * 1000
CONVERSATION = "id {id}, started_at long, ended_at long, user_prompt_count long, files_edited string"


def _dealt(rows: DataFrame, conversation: str = "conversation_id") -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(F.col(conversation).cast("string")), F.lit(BUCKETS)).cast("int"))


def read_stored(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The table at folder, without rows if there is none yet."""
    try:
        return spark.read.schema(schema).parquet(folder)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def _write(rows: DataFrame, folder: str, mode: str, *by: str) -> None:
    """Writes partitions as one file each, whatever the number of tasks that rows come from; by number, as adaptive execution would leave few tasks to open all files."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(parts, *by).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(folder)


def _overwrite(rows: DataFrame, folder: str, *by: str) -> None:
    """Replaces the partitions that rows, read from the same table, belong to."""
    _write(stored(rows), folder, "overwrite", *by)


def ingest_batch(batch: DataFrame, folder: str) -> None:
    """Takes a batch of messages into the tables `messages` and `conversations` below folder.

    New messages are those that neither the batch nor a stored message within ten
    seconds on either side repeats; only the days that the batch touches, and those
    beside them, of its conversations' buckets are read for that. Stored messages
    without model get that of a new one at their time, which rewrites their partitions.
    Then bounds, prompts and edited files of the batch's conversations are counted from
    their stored messages. A batch that is run again, whatever it had come to, leaves
    the tables as if it had run once.
    """
    spark, columns = batch.sparkSession, batch.columns
    day = F.floor(F.col("timestamp") / DAY_MS).cast("int")
    fresh = stored(_dealt(batch.filter("timestamp IS NOT NULL AND conversation_id IS NOT NULL")).withColumn("day", day))
    touched = fresh.groupBy().agg(F.collect_set("bucket").alias("buckets"), F.collect_set("day").alias("days")).first()  # days and buckets of one batch
    if not touched["days"]:
        return
    near_days = sorted({d + k for d in touched["days"] for k in (-1, 0, 1)})
    messages = read_stored(spark, f"{folder}/messages", fresh.schema)
    own = messages.filter(F.col("bucket").isin(touched["buckets"]))
    near = own.filter(F.col("day").isin(near_days)).persist()  # read once, for all that is asked of it before the table changes
    added = added_messages(near.select(columns), fresh.select(columns)).join(near.select("id"), "id", "left_anti")
    added = stored(_dealt(conversations.backfill_models(added, fresh)).withColumn("day", day))

    named = fresh.filter("trim(model) != ''").select("conversation_id", "timestamp").distinct()
    unnamed = near.filter("coalesce(model, '') = ''").join(named, ["conversation_id", "timestamp"], "left_semi").select("bucket", "day").distinct()
    unnamed = stored(unnamed)
    changed = None
    if unnamed.limit(1).count():
        changed = near.join(F.broadcast(unnamed), ["bucket", "day"], "left_semi").select(fresh.columns)  # a row for each bucket and day at most
        changed = stored(conversations.backfill_models(changed, fresh))
    near.unpersist()
    if changed is not None:
        _write(changed, f"{folder}/messages", "overwrite", "bucket", "day")
    _write(added, f"{folder}/messages", "append", "bucket", "day")

    kind = dict(fresh.dtypes)["conversation_id"]
    ids = stored(fresh.select(F.col("conversation_id").alias("id"), "bucket").distinct())
    said = read_stored(spark, f"{folder}/messages", fresh.schema).filter(F.col("bucket").isin(touched["buckets"]))
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        said = said.join(F.broadcast(ids.select(F.col("id").alias("conversation_id"))), "conversation_id", "left_semi")
    known = read_stored(spark, f"{folder}/conversations", CONVERSATION.format(id=kind) + ", bucket int").filter(F.col("bucket").isin(touched["buckets"]))
    blank = {c: F.lit(0).cast("long") for c in ("started_at", "ended_at", "user_prompt_count")} | {"files_edited": F.lit("")}
    rows = known.unionByName(ids.join(known.select("id"), "id", "left_anti").withColumns(blank).select(known.columns))
    said = said.select(columns)
    _overwrite(conversations.refreshed(rows, said, said), f"{folder}/conversations", "bucket")


def ingest_messages(stream: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Ingests each micro-batch of a stream of messages into the tables below folder (ingest_batch)."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: ingest_batch(batch, folder)).trigger(**(trigger or {"availableNow": True})).start()


def head_changes(heads: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first sight of each (repository, branch, head) within the watermark."""
    return heads.withWatermark("seen_at", late).dropDuplicatesWithinWatermark(["repository", "branch", "head"])

"""Suspicious-transaction events and their running totals per customer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskloom.functions.rules import is_flagged
from riskloom.operators.dedupe import latest_per_key
from riskloom.plans.marts import MONEY
from riskloom.schemas import EVENT, TABLES
from riskloom.sources.snapshots import commit, new_part, read_parts, snapshot, vacuum

# The event type and the topic.
EVENT_TYPE = "suspicious_transaction_detected"
TOPIC = "suspicious-transactions"

# Files that a micro-batch writes, and batches after which the summary is folded.
EPOCH_FILES = 4
FOLD_EVERY = 100
SUMMARY = TABLES["streaming_suspicious_summary"] + ", epoch bigint"


def suspicious_only(transactions: DataFrame) -> DataFrame:
    """Transactions whose flag is set."""
    return transactions.where(is_flagged(F.col("is_suspicious")))


def _event_columns() -> list[Column]:
    texts = ("transaction_id", "customer_id", "account_id", "transaction_date", "channel")
    return [*[F.col(name).cast("string").alias(name) for name in texts], F.col("amount").cast("double").alias("amount")]


def suspicious_events(transactions: DataFrame, sent_at: Column | None = None) -> DataFrame:
    """One event per suspicious transaction, stamped with the given or the current time; batch or stream."""
    stamp = F.current_timestamp() if sent_at is None else sent_at
    iso = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    return suspicious_only(transactions).select(
        F.lit(EVENT_TYPE).alias("event_type"), iso.alias("timestamp"), *_event_columns()
    )


def suspicious_event_batch(transactions: DataFrame, batch_id: str) -> DataFrame:
    """The batch form of the events: a batch id in place of the time, ordered by transaction id as text."""
    return (
        suspicious_only(transactions)
        .select(F.lit(EVENT_TYPE).alias("event_type"), F.lit(batch_id).alias("batch_id"), *_event_columns())
        .orderBy("transaction_id")
    )


def write_event_batch(transactions: DataFrame, output_dir: str, batch_id: str) -> str:
    """Write the event batch as JSON lines."""
    path = f"{output_dir}/suspicious_transactions_{batch_id}.jsonl"
    suspicious_event_batch(transactions, batch_id).write.mode("overwrite").json(path)
    return path


def as_messages(events: DataFrame) -> DataFrame:
    """Events as topic messages, keyed by customer."""
    return events.select(F.col("customer_id").alias("key"), F.to_json(F.struct("*")).alias("value"))


def publish_to_topic(events: DataFrame, servers: str, checkpoint: str, topic: str = TOPIC) -> StreamingQuery:
    """Stream events to a topic; needs the Kafka connector on the class path."""
    return (
        as_messages(events)
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def publish_to_files(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Stream events to a folder of JSON lines."""
    return (
        events.writeStream.format("json")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def events_from_topic(
    spark: SparkSession, servers: str, topic: str = TOPIC, max_per_trigger: int | None = None, strict: bool = True
) -> DataFrame:
    """Event stream of a topic; a message that is not an event stops it, or is skipped where ``strict`` is off."""
    return parsed_messages(messages_from_topic(spark, servers, topic, max_per_trigger), strict)


def messages_from_topic(spark: SparkSession, servers: str, topic: str = TOPIC,
                        max_per_trigger: int | None = None) -> DataFrame:
    """Message stream of a topic from its earliest offset; needs the Kafka connector on the class path."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
    )
    if max_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
    return reader.load()


def messages_from_files(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Message stream of a folder of lines: each line that is not blank is a ``value``."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(path).where("trim(value) <> ''")


def _judged(messages: DataFrame) -> DataFrame:
    """The messages with the event in ``e`` and, where there is none, why in ``reason``."""
    text = F.col("value").cast("string")
    event = F.from_json(text, f"{EVENT}, _malformed string",
                        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_malformed"})
    reason = (
        F.when(text.isNull(), "no value")
        .when(F.col("e").isNull() | F.col("e._malformed").isNotNull(), "not an event")
        .when(F.col("e.customer_id").isNull(), "no customer")
    )
    return messages.withColumn("e", event).withColumn("reason", reason)


def parsed_messages(messages: DataFrame, strict: bool = True) -> DataFrame:
    """The events in the values of topic messages.

    A message that is not an event is an error, or is left to ``dead_letters`` where ``strict`` is off.
    """
    if not strict:
        return _judged(messages).where("reason is null").select("e.*").drop("_malformed")
    event = F.from_json(F.col("value").cast("string"), EVENT, {"mode": "FAILFAST"})
    return messages.select(event.alias("e")).select("e.*")


def dead_letters(messages: DataFrame) -> DataFrame:
    """The messages that are no events, whole, with the ``reason``: every message is either here or an event."""
    return _judged(messages).where("reason is not null").drop("e")


def keep_dead_letters(messages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Stream the dead letters to a folder of JSON lines, so that they can be looked at and sent again."""
    letters = dead_letters(messages).withColumn("value", F.col("value").cast("string"))
    return publish_to_files(letters, path, checkpoint)


def events_from_files(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Event stream of a folder of JSON lines."""
    reader = spark.readStream.schema(EVENT).option("mode", "FAILFAST")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def unique_events(events: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Each event once, however often it is delivered; batch or stream.

    Events with one id are one event, and so are events without an id that agree in all columns. A stream remembers the
    digest of every event in its state store, so a replay is recognised after any time and restart.
    """
    whole = F.to_json(F.struct(*events.columns), {"ignoreNullFields": "false"})
    named = F.when(F.col(key).isNull(), F.concat(F.lit("="), whole)).otherwise(F.concat(F.lit("#"), F.col(key).cast("string")))
    return events.withColumn("_event", F.unhex(F.sha2(named, 256))).dropDuplicates(["_event"]).drop("_event")


def running_totals(events: DataFrame) -> DataFrame:
    """Alerts, volume and last time per customer; the date stands in where an event has no time.

    The totals cover a customer's whole life, so the state has no expiry and no watermark. Amounts add up as
    decimals, so the order of arrival does not show.
    """
    return events.groupBy(F.col("customer_id").cast("string").alias("customer_id")).agg(
        F.count(F.lit(1)).alias("suspicious_count"),
        F.sum(F.col("amount").cast("decimal(18,2)")).cast(MONEY).alias("total_suspicious_amount"),
        F.max(F.coalesce("timestamp", F.col("transaction_date").cast("string"))).alias("last_suspicious_timestamp"),
    )


def _folded(spark: SparkSession, path: str, parts: dict[str, dict]) -> dict[str, dict]:
    """The given folders as one, with the newest row per customer."""
    part = new_part()
    rows = latest_per_key(read_parts(spark, path, list(parts), SUMMARY), ["customer_id"], [F.desc("epoch")])
    rows.write.parquet(f"{path}/{part}")
    return {part: {"epoch": max(known["epoch"] for known in parts.values())}}


def maintain_summary(events: DataFrame, path: str, checkpoint: str, once: bool = True,
                     interval: str = "10 seconds", fold_every: int = FOLD_EVERY) -> StreamingQuery:
    """Keep running totals up to date: drain what is there, or go on with the given interval.

    Each micro-batch writes only the customers it changed, with their totals so far, into a folder of a few files, and
    commits it beside the earlier ones. A batch that is run again after a failure takes the place of its first run, so
    nothing counts twice. When ``fold_every`` folders have come together they are folded into one in the same step, so
    what a reader lists and reads stays bounded; the older ones stay for readers that began before.
    """

    def write(changed: DataFrame, epoch: int) -> None:
        spark, part, before = changed.sparkSession, new_part(), snapshot(changed.sparkSession, path)
        changed.withColumn("epoch", F.lit(epoch).cast("bigint")).repartition(EPOCH_FILES).write.parquet(f"{path}/{part}")
        earlier = {name: known for name, known in (before.parts if before else {}).items() if known["epoch"] < epoch}
        if len(earlier) >= fold_every:
            earlier = _folded(spark, path, earlier)
        commit(spark, path, before, {**earlier, part: {"epoch": epoch}})
        if len(earlier) == 1:
            vacuum(spark, path)

    writer = (
        running_totals(events)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
    )
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def read_summary(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Current totals: the newest row per customer; empty before the first event. ``version`` reads an earlier state."""
    found = snapshot(spark, path, version)
    if found is None:
        return spark.createDataFrame([], SUMMARY).drop("epoch")
    changes = read_parts(spark, path, list(found.parts), SUMMARY)
    return latest_per_key(changes, ["customer_id"], [F.desc("epoch")]).drop("epoch")


def compact_summary(spark: SparkSession, path: str, target: str) -> None:
    """Write the current totals to a table of their own, one row per customer."""
    read_summary(spark, path).write.mode("overwrite").parquet(target)

"""Topic reads.  The connector jar is a run-time choice (`--packages`)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MODES = {"realtime": "latest", "reprocess": "earliest"}


def starting_offsets(mode: str) -> str:
    """Replay starts at the beginning of the topic, live detection at its end."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    return MODES[mode]


def topic_options(
    servers: str,
    topic: str,
    starting: str = "earliest",
    group: str | None = None,
    max_per_trigger: int | None = None,
    min_partitions: int | None = None,
) -> dict[str, str]:
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting,
        # Offsets that aged out of the topic must not pass unseen.
        "failOnDataLoss": "true",
    }
    if group:
        options["kafka.group.id"] = group
    if max_per_trigger:
        options["maxOffsetsPerTrigger"] = str(max_per_trigger)
    if min_partitions:
        # Splits a topic with few partitions over more tasks.
        options["minPartitions"] = str(min_partitions)
    return options


def read_stream(spark: SparkSession, **options) -> DataFrame:
    return spark.readStream.format("kafka").options(**topic_options(**options)).load()


def read_batch(spark: SparkSession, **options) -> DataFrame:
    """The topic as it is now; only `earliest` can start a bounded read."""
    settings = topic_options(**options)
    settings.pop("maxOffsetsPerTrigger", None)
    return spark.read.format("kafka").options(**settings).load()


def tail(spark: SparkSession, **options) -> DataFrame:
    """Message text from now on, for a console or memory sink."""
    options["starting"] = "latest"
    return read_stream(spark, **options).selectExpr("cast(value as string) as value").na.drop()

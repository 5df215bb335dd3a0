"""Topic writes of frames with a `value` and, when keyed, a `key` column."""

from __future__ import annotations

from pyspark.sql import DataFrame


def publish_options(servers: str, topic: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "topic": topic}


def publish(messages: DataFrame, servers: str, topic: str) -> None:
    messages.write.format("kafka").options(**publish_options(servers, topic)).save()


def publish_stream(messages: DataFrame, servers: str, topic: str, checkpoint: str):
    return (
        messages.writeStream.format("kafka")
        .options(**publish_options(servers, topic))
        .option("checkpointLocation", checkpoint)
        .start()
    )

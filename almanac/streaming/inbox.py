"""Watching a growing table of messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.rows import filter_any_regex


def watch(
    messages: DataFrame,
    rules: Sequence[tuple[str, str]],
    target: str,
    checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Append the messages that match any rule to the folder ``target``.

    ``messages`` is a streaming DataFrame; a restart goes on where ``checkpoint``
    says. ``available_now`` stops once everything present has been read.
    """
    writer = (
        filter_any_regex(messages, rules)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()

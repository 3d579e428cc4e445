"""Actions that end in time."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, Row


class TimedOut(Exception):
    """An action took longer than it may."""


def collected(df: DataFrame, seconds: float = 10.0) -> list[Row]:
    """The rows of df; its jobs are cancelled where they take longer."""
    context = df.sparkSession.sparkContext
    group, late = f"deadline-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    context.setJobGroup(group, "an action with a deadline", True)
    timer.start()
    try:
        return df.collect()
    except Exception:
        if late.is_set():
            raise TimedOut(f"no result within {seconds} s") from None
        raise
    finally:
        timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)

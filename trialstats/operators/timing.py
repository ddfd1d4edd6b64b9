"""Time on task: the gap from each logged event to the participant's next one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Lines of a log that one task sorts at most.
SLICE_LINES = 1_000_000


def time_on_task(
    events: DataFrame,
    participant: str = "participant_id",
    elapsed: str = "elapsedTime",
    line: str = "line_no",
    slice_lines: int | None = None,
) -> DataFrame:
    """Add ``TimeOnTask``, in seconds for ``elapsed`` in milliseconds.

    Events are taken in the order of the file, by ``line``, which is unique for
    a participant; a clock that restarts gives the difference as it stands
    there.  The last event of a participant has no successor and gets NULL.
    Filters on the event type belong after this step.

    Every log is cut at fixed line numbers, so no task sorts more than
    ``slice_lines`` events however long the log and however its times repeat.
    The last event of a slice continues with the first one of the next slice
    that has any.
    """
    lines = F.lit(slice_lines or SLICE_LINES)
    # Events without a line number come last.
    number = F.coalesce(F.floor(F.col(line) / lines), F.lit((1 << 63) - 1)).cast("long")
    sliced = events.withColumn("__slice", number)
    heads = (
        sliced.groupBy(participant, "__slice")
        .agg(F.min_by(elapsed, F.coalesce(F.col(line).cast("long"), F.lit((1 << 63) - 1))).alias("__head"))
        .withColumn("__next_head", F.lead("__head").over(W.partitionBy(participant).orderBy("__slice")))
        .select(F.col(participant).alias("__participant"), F.col("__slice").alias("__of"), "__next_head")
    )
    order = W.partitionBy(participant, "__slice").orderBy(F.col(line).asc_nulls_last())
    timed = sliced.withColumn("__inside", F.lead(elapsed).over(order)).withColumn("__is_last", F.lead(F.lit(1)).over(order).isNull())
    same = F.col(participant).eqNullSafe(F.col("__participant")) & (F.col("__slice") == F.col("__of"))
    following = F.when(F.col("__is_last"), F.col("__next_head")).otherwise(F.col("__inside"))
    return (
        timed.join(heads, same, "left")
        .withColumn("TimeOnTask", (following - F.col(elapsed)) / 1000)
        .select(*events.columns, "TimeOnTask")
    )

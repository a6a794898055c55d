"""What Spark itself has measured of a query: one run, and the work of each of its stages."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class StageUse:
    """A stage that ran: wall seconds, seconds of all its tasks, rows and bytes that it took from and gave to exchanges."""

    stage: int
    tasks: int
    seconds: float
    task_seconds: float
    rows_read: int
    bytes_read: int
    rows_written: int
    bytes_written: int
    bytes_spilled: int


def measured(df: DataFrame) -> list[StageUse]:
    """Run a query without keeping its result; its stages in the order in which they were made."""
    context = df.sparkSession.sparkContext
    before = [context.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description")]
    group = f"weftspark-{uuid.uuid4().hex}"
    context.setJobGroup(group, "measured")
    try:
        df.write.format("noop").mode("overwrite").save()
    finally:
        for k, v in zip(("spark.jobGroup.id", "spark.job.description"), before, strict=True):
            context.setLocalProperty(k, v)
    core = context._jsc.sc()
    core.listenerBus().waitUntilEmpty(60_000)
    tracker = context.statusTracker()
    ids = sorted({s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds})
    out = []
    for i in ids:
        s = core.statusStore().lastStageAttempt(i)
        if s.submissionTime().isEmpty() or s.completionTime().isEmpty():  # its shuffle was there already
            continue
        wall = (s.completionTime().get().getTime() - s.submissionTime().get().getTime()) / 1000
        out.append(StageUse(i, s.numCompleteTasks(), wall, s.executorRunTime() / 1000, s.shuffleReadRecords(), s.shuffleReadBytes(), s.shuffleWriteRecords(), s.shuffleWriteBytes(), s.diskBytesSpilled()))
    return out

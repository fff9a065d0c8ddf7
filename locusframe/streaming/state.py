"""Streams with state of their own: dark times in event order, and files that a restart neither loses nor repeats."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATE = "last_end double, starts array<double>, ends array<double>"


def dark_times(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(site, started, seconds) of binding events ``stream(site, started, ended)``, both timestamps: darkness before each.

    An event is judged in the order of starts, once the watermark has passed
    its start, so it does not matter in which order events arrive within
    ``late``. The darkness is the time since the latest end of all events that
    started before, null for the first event of a site and for one that starts
    before that end. State is that end and the events that wait.
    """

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, starts, ends = state.get if state.exists else (None, [], [])
        waiting = list(zip(starts, ends, strict=True))
        for part in batches:
            waiting += zip(part["started"].astype("int64") / 1e9, part["ended"].astype("int64") / 1e9, strict=True)
        waiting.sort()
        passed = state.getCurrentWatermarkMs() / 1e3
        out = []
        while waiting and waiting[0][0] <= passed:
            start, end = waiting.pop(0)
            out.append((key[0], pd.Timestamp(round(start * 1e6), unit="us"), start - last if last is not None and start > last else None))
            last = end if last is None else max(last, end)
        state.update((last, [a for a, _ in waiting], [b for _, b in waiting]))
        if waiting:
            state.setTimeoutTimestamp(max(int(waiting[0][0] * 1e3) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["site", "started", "seconds"]).astype({"seconds": "float64", "started": "datetime64[us]"})

    kind = stream.schema["site"].dataType.simpleString()
    marked = stream.select("site", "started", "ended").withWatermark("started", late)
    return marked.groupBy("site").applyInPandasWithState(judge, f"site {kind}, started timestamp, seconds double", _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def write_once(stream: DataFrame, path: str, checkpoint: str, each: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Write every micro-batch of a stream to a folder of its own under ``path``, after ``each``.

    A batch that is run again after a failure replaces what it wrote, so the
    folders together hold each row once. ``each`` must give the same rows for
    the same batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()

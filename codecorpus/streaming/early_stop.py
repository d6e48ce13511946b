"""STM-1: streaming early stopping over epoch reports with event time.

Reports of a trial may arrive in any order.  They wait in the trial's state until
the watermark has passed their time, and are then taken in the order of their
epochs; one row a trial leaves when it stops.  A timer wakes a trial whose waiting
reports have become final without new ones, and a trial that reported nothing for
``idle`` after its last report leaves the state.  Equal to
``evaluate.early_stopping`` run in batch over the same log (tested), whatever the
order of arrival within ``delay``.

Defined results: a report later than ``delay`` behind the newest is dropped, as the
watermark says; of two reports of one epoch both count, the smaller loss first; a null
or NaN loss never improves; null trials, epochs or times are no reports.  After it
has left the state, a trial that reports again begins anew.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codecorpus.functions import patterns as P

OUTPUT = "trial long, stop_epoch long, best_loss double"
#: ``waiting``: reports that are not final; ``last``: time of the newest report, ms.
STATE = "best double, bad long, stopped boolean, last long, epochs array<long>, losses array<double>, times array<long>"


def _step(patience: int, idle_ms: int):
    def fn(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            best, bad, stopped, last, *waiting = state.get
        else:
            best, bad, stopped, last, *waiting = math.inf, 0, False, 0, [], [], []
        now = state.getCurrentWatermarkMs()
        reports = list(zip(*waiting, strict=True))
        for chunk in batches:
            if len(chunk):
                last = max(last, int(chunk["at"].max()))
            if not stopped:
                reports += zip(chunk["epoch"].tolist(), chunk["valid_loss"].fillna(math.nan).tolist(), chunk["at"].tolist(), strict=True)
        out = []
        reports.sort(key=lambda r: (r[0], math.inf if math.isnan(r[1]) else r[1]))
        final = 0
        while final < len(reports) and reports[final][2] <= now and not stopped:
            epoch, loss, _ = reports[final]
            final += 1
            if loss < best:  # NaN never improves
                best, bad = float(loss), 0
            else:
                bad += 1
            if bad == patience:
                stopped = True
                out.append((int(key[0]), int(epoch), best))
        reports = [] if stopped else reports[final:]
        if not reports and last + idle_ms <= now:
            state.remove()
        else:
            columns = [list(c) for c in zip(*reports, strict=True)] or [[], [], []]
            state.update((best, bad, stopped, last, *columns))
            # the watermark has to pass the time of the next epoch, or the idle time
            state.setTimeoutTimestamp(max(now + 1, reports[0][2] if reports else last + idle_ms))
        if out:
            yield pd.DataFrame(out, columns=["trial", "stop_epoch", "best_loss"])

    return fn


def early_stop_stream(reports: DataFrame, patience: int = P.PATIENCE, delay: str = "10 minutes", idle_seconds: int = 86_400,
                      event_time: str = "ts") -> DataFrame:
    """``reports``: a streaming frame of (trial, epoch, valid_loss) and the time of
    the report; epochs of a trial rise with their times."""
    rows = reports.filter(F.col("trial").isNotNull() & F.col("epoch").isNotNull()).withWatermark(event_time, delay)
    rows = rows.select("trial", "epoch", F.col("valid_loss").cast("double").alias("valid_loss"), F.col(event_time).alias("event_time"),
                       F.unix_millis(F.col(event_time).cast("timestamp")).alias("at")).filter("at is not null")
    return rows.groupBy("trial").applyInPandasWithState(
        _step(patience, idle_seconds * 1000), OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)

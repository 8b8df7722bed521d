"""Segments with merged pauses on a stream of samples, with one state per recording."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kadenz.operators import intervals as I

STATE = "t array<double>, other array<boolean>, active array<boolean>, running boolean, begin double, held_begin double, held_end double, other_running boolean, other_begin double, other_end double"
EMPTY = ([], [], [], False, math.nan, math.nan, math.nan, False, math.nan, -math.inf)


def merged_segments(samples: DataFrame, gap: float, key: str = "rec_id", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """(key, begin_t, end_t): runs of a speaker's active samples, joined where less than `gap` seconds lie between and no run of
    the other speaker overlaps that pause. Times are seconds since 1970.

    samples: key, ts, other (whose sample it is) and active; a null counts as off. On a static table these are
    segments() and merged_pauses(). On a stream, samples wait in the state until the watermark has passed them and are
    then read in order of time, so they may arrive up to `late` out of order. A run ends at the first off sample; a segment
    is given out once nothing that may still come could join it. The state holds the samples that the watermark
    has not passed and a few numbers. Of one time the other speaker's sample is read first.
    """
    if not samples.isStreaming:
        rows = samples.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("__us"), "other", "active").select(key, (F.col("__us") / 1e6).alias("t"), "other", "active")
        runs = I.segments(rows, "active", [key, "other"])
        return I.merged_pauses(runs.where("NOT other"), runs.where("other"), gap, key).select(key, "begin_t", "end_t")
    kind = dict(samples.dtypes)[key]

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t, other, active, running, begin, held_begin, held_end, other_running, other_begin, other_end = state.get if state.exists else EMPTY
        waiting = list(zip(t, other, active, strict=True))
        for frame in frames:
            seconds = frame["t"].tolist()
            waiting += zip(seconds, frame["other"].astype(bool).tolist(), frame["active"].astype(bool).tolist(), strict=True)
        passed = state.getCurrentWatermarkMs() / 1000
        waiting.sort(key=lambda e: (e[0], not e[1]))
        ready = [e for e in waiting if e[0] <= passed]
        waiting, out = waiting[len(ready) :], []
        for at, of_other, on in ready:
            if of_other:
                if on and not other_running:
                    other_running, other_begin = True, at
                elif not on and other_running:
                    other_running, other_end = False, at
            elif on and not running:
                running, before = True, held_begin
                if not math.isnan(held_end):
                    spoken = other_end > held_end or other_running and other_begin < at
                    if at > held_end and at - held_end < gap and not spoken:
                        begin = before
                    else:
                        out.append((held_begin, held_end))
                        begin = at
                    held_begin = held_end = math.nan
                else:
                    begin = at
            elif not on and running:
                running, held_begin, held_end = False, begin, at
        if not running and not math.isnan(held_end) and passed >= held_end + gap:
            out.append((held_begin, held_end))
            held_begin = held_end = math.nan
        t, other, active = (list(c) for c in zip(*waiting, strict=True)) if waiting else ([], [], [])
        state.update((t, other, active, running, begin, held_begin, held_end, other_running, other_begin, other_end))
        wake = [waiting[0][0]] if waiting else []
        wake += [held_end + gap] if not running and not math.isnan(held_end) else []
        if wake:
            state.setTimeoutTimestamp(max(math.ceil(min(wake) * 1000), state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame([(k[0], *s) for s in out], columns=[key, "begin_t", "end_t"])

    rows = samples.select(key, F.col(ts).cast("timestamp").alias("__ts"), F.col("other").cast("boolean").alias("other"), F.coalesce(F.col("active"), F.lit(False)).alias("active")).withWatermark("__ts", late)
    rows = rows.withColumn("t", F.unix_micros("__ts") / 1e6)
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, begin_t double, end_t double", STATE, "append", GroupStateTimeout.EventTimeTimeout)

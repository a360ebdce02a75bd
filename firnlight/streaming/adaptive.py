"""The adaptive mean of a stream of traces: each trace less the mean of the traces around it.

State is kept for each profile: the traces that the watermark has not passed yet, and
the last ones that a mean still needs, at most ``width`` and some. A trace is settled
once the watermark passes it, as nothing earlier can come after that; a mean is given
out once all its traces are settled. When the watermark is ``gap`` past a profile's
last trace, the profile has ended: a timer gives out what is left and clears its state.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "profile_id string, trace_idx int, samples array<double>, mean array<double>"


class AdaptiveMean(StatefulProcessor):
    def __init__(self, width: int, gap_ms: int):
        self.width, self.half, self.gap = width, width // 2, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.early = handle.getMapState("early", "at bigint, trace_idx int", "samples array<double>")  # not settled yet
        self.recent = handle.getMapState("recent", "place bigint", "trace_idx int, samples array<double>")  # settled, by place
        self.told = handle.getValueState("told", "settled bigint, given bigint, last bigint, ends bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        settled, given, last, ends = self.told.get() if self.told.exists() else (0, 0, -1, -1)
        latest = last
        for frame in rows:
            for at, i, samples in zip(frame["at_ms"], frame["trace_idx"], frame["samples"]):
                if at > last:  # earlier ones came too late
                    self.early.updateValue((int(at), int(i)), ([float(v) for v in samples],))
                    latest = max(latest, int(at))
        if latest + self.gap > ends:
            if ends >= 0:
                self.handle.deleteTimer(ends)
            ends = latest + self.gap
            self.handle.registerTimer(ends)
        yield from self._settle(key, timerValues.getCurrentWatermarkInMs(), (settled, given, last, ends), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settle(key, expiredTimerInfo.getExpiryTimeInMs(), self.told.get(), True)
        for state in (self.early, self.recent, self.told):
            state.clear()

    def _settle(self, key, upto: int, told: tuple, over: bool) -> Iterator[pd.DataFrame]:
        settled, given, last, ends = told
        for at, i in sorted(k for k in self.early.keys() if k[0] <= upto):
            samples = self.early.getValue((at, i))[0]
            self.recent.updateValue((settled,), (i, list(samples)))
            self.early.removeKey((at, i))
            settled, last = settled + 1, at
        ready = settled if over else max(given, settled - self.half)
        if ready > given:
            held = {k[0]: v for k, v in self.recent.iterator()}
            out = [(held[p][0], held[p][1], self._mean(held, p, settled)) for p in range(given, ready)]
            yield pd.DataFrame({"profile_id": key[0], "trace_idx": np.array([o[0] for o in out], "int32"), "samples": [o[1] for o in out], "mean": [o[2] for o in out]})
            given = ready
            for p in held:
                if given > self.half and p < min(given - self.half + 1, settled - self.width):
                    self.recent.removeKey((p,))
        self.told.update((settled, given, last, ends))

    def _mean(self, held: dict, p: int, n: int) -> list[float]:
        """As :func:`..operators.windows.adaptive_means`: of the first traces near the start, the last near the end, around elsewhere."""
        if p <= self.half:
            span = range(0, min(p + self.half, n))
        elif p >= n - self.half:
            span = range(max(0, n - self.width), n)
        else:
            span = range(p - self.half + 1, p + self.half)
        return np.mean([held[q][1] for q in span], axis=0).tolist()


def adaptive_means(traces: DataFrame, width: int, late: str, gap: str, time: str = "ts") -> DataFrame:
    """(profile_id, trace_idx, samples, mean) of a stream of traces with a time of each.

    Traces may come out of order by up to ``late``; of later ones nothing is kept.
    A profile ends where no trace comes for ``gap``. The session's state store must
    be RocksDB (``spark.sql.streaming.stateStore.providerClass``).
    """
    rows = traces.withWatermark(time, late).select("profile_id", "trace_idx", time, F.unix_millis(time).alias("at_ms"), "samples")
    return rows.groupBy("profile_id").transformWithStateInPandas(
        statefulProcessor=AdaptiveMean(width, int(pd.Timedelta(gap).total_seconds() * 1000)), outputStructType=OUT, outputMode="Append", timeMode="EventTime")

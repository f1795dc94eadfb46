"""Labels of beat intervals on a stream, with each entity's accepted intervals as state."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pulseloom.operators.detect import judge_interval


def label_cycle_stream(beats: DataFrame, key: str, at: str, *, memory: int = 15, tolerance: float = 0.12, long_factor: float = 1.6) -> DataFrame:
    """Rows (key, beat_at, interval, label) as in ``detect.label_cycles``, for beats that arrive in order within an entity.

    A beat that is not later than its entity's last one is dropped. The state is the last beat, the accepted intervals
    (at most ``memory``) and the number of refused ones in a row.
    """
    kind = dict(beats.dtypes)[key]

    def judge(own: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, refused, held = state.get if state.exists else (None, 0, [])
        accepted = deque(held, maxlen=memory)
        times = sorted(t for frame in frames for t in frame[at].dropna())
        rows = []
        for t in times:
            if last is not None and t <= last:
                continue
            if last is not None:
                label, take = judge_interval(t - last, accepted, tolerance, long_factor)
                refused = 0 if take else refused + 1
                if take:
                    accepted.append(t - last)
                elif refused >= memory:
                    accepted.clear()
                rows.append((*own, t, t - last, label))
            last = t
        state.update((last, refused, list(accepted)))
        yield pd.DataFrame(rows, columns=[key, "beat_at", "interval", "label"])

    return beats.groupBy(key).applyInPandasWithState(
        judge, f"{key} {kind}, beat_at double, interval double, label string", "last double, refused int, accepted array<double>", "append", GroupStateTimeout.NoTimeout
    )

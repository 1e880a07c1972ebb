"""Contact spans of a stream: each pair's two-threshold state is kept between batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

OUTPUT = "pair_id long, frame_start long, frame_end long, min_d double"
STATE = "start long, last long, low double"


def stream_contact_spans(measured: DataFrame, enter: float, leave: float, idle: str = "10 minutes") -> DataFrame:
    """Closed spans of a streaming DataFrame (pair_id, frame, d_norm, ts): an open one is closed at its last measured
    frame once its pair has been silent for the watermark and `idle`.

    Frames have to reach a pair in order, batch by batch; within a batch they are sorted. A frame that isn't after the
    pair's last one is late and left out. State: one open span a pair.
    """
    if leave <= enter:
        raise ValueError("leave has to be above enter")
    pause = pd.Timedelta(idle)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        start, last, low = state.get if state.exists else (None, -1, None)
        out = []
        if state.hasTimedOut:
            state.remove()
            if start is not None:
                yield pd.DataFrame([(key[0], start, last, low)], columns=["pair_id", "frame_start", "frame_end", "min_d"])
            return
        rows = pd.concat(list(batches)).dropna(subset=["d_norm"]).sort_values("frame")
        latest = 0
        for frame, d, ts in zip(rows["frame"], rows["d_norm"], rows["ts"]):
            latest = max(latest, int(ts.timestamp() * 1000))
            if frame <= last:
                continue
            if start is None and d < enter:
                start, low = int(frame), float(d)
            elif start is not None and d > leave:
                out.append((key[0], start, int(frame) - 1, low))
                start = low = None
            elif start is not None:
                low = min(low, float(d))
            last = int(frame)
        state.update((start, last, low))
        if latest:
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + max(1, int(pause.total_seconds() * 1000)))
        yield pd.DataFrame(out, columns=["pair_id", "frame_start", "frame_end", "min_d"])

    watched = measured.withWatermark("ts", idle)
    return watched.groupBy("pair_id").applyInPandasWithState(step, OUTPUT, STATE, "append", "EventTimeTimeout")

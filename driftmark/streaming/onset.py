"""Onset on a stream: each run keeps its last w flags and reports the first window that reaches the fraction."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

OUT = "run string, frame bigint, step bigint"
STATE = "frames array<bigint>, steps array<bigint>, flags array<double>, next bigint, done boolean"


def streaming_onset(scored: DataFrame, window: int, step: int, fraction: float) -> DataFrame:
    """Rows (run, frame, step, flag), in any order across batches; frames count from 0 without gaps.

    A frame that comes early waits in the state until those before it are there.
    """

    def update(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        frames, steps, flags, base, done = (list(x) if isinstance(x, (list, tuple)) else x for x in state.get) if state.exists else ([], [], [], 0, False)
        if not done:
            held = dict(zip(frames, zip(steps, flags, strict=True), strict=True))
            for b in batches:
                held.update({int(f): (int(s), float(x)) for f, s, x in zip(b.frame, b.step, b.flag, strict=True) if f >= base})
            found = None
            while found is None and all(f in held for f in range(base, base + window)):
                if sum(held[f][1] for f in range(base, base + window)) >= fraction * window - 1e-9:
                    found = (base, held[base][0])
                else:
                    for f in range(base, base + step):
                        held.pop(f, None)
                    base += step
            if found:
                state.update(([], [], [], base, True))
                yield pd.DataFrame({"run": [key[0]], "frame": [found[0]], "step": [found[1]]})
                return
            order = sorted(held)
            state.update((order, [held[f][0] for f in order], [held[f][1] for f in order], base, False))
        yield pd.DataFrame({"run": pd.Series([], dtype=str), "frame": pd.Series([], dtype="int64"), "step": pd.Series([], dtype="int64")})

    return scored.groupBy("run").applyInPandasWithState(update, OUT, STATE, "append", "NoTimeout")

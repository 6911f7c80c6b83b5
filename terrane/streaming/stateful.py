"""Stateful streams over frames: visits of states as they end, and moments of a vector, by replicate.

State is bounded by replicates: the open visit and the last time, or one (n, mean, M2). Frames of a replicate must come in order of time from batch to batch;
inside a batch they are sorted. A frame that is not later than the last one seen is late: it changes nothing but the replicate's count of late frames.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def ended_visits(frames: DataFrame, replicate: str, time: str, state: str, idle_ms: int | None = None) -> DataFrame:
    """(replicate, visit, state, start_time, end_time, frames, late): each visit once, when another state has followed it (append mode).

    `visit` counts from 1; `late` is the number of late frames so far. With `idle_ms`, a replicate that brings nothing for so long (processing time) ends
    its open visit, too; frames that come later begin a new one.
    """
    kind = dict(frames.dtypes)
    out = f"`{replicate}` {kind[replicate]}, visit long, state {kind[state]}, start_time {kind[time]}, end_time {kind[time]}, frames long, late long"
    kept = f"visit long, state {kind[state]}, start {kind[time]}, last {kind[time]}, frames long, late long"
    names = [replicate, "visit", "state", "start_time", "end_time", "frames", "late"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        visit, now, start, last, n, late = held.get if held.exists else (0, None, None, None, 0, 0)
        if held.hasTimedOut:
            held.update((visit, None, None, last, 0, late))
            if n:
                yield pd.DataFrame([(key[0], visit, now, start, last, n, late)], columns=names)
            return
        rows = pd.concat(list(batches)).sort_values(time, kind="stable")
        done = []
        for t, s in zip(rows[time].tolist(), rows[state].tolist(), strict=True):
            if last is not None and t <= last:
                late += 1
                continue
            if n and s != now:
                done.append((key[0], visit, now, start, last, n, late))
                n = 0
            if not n:
                visit, now, start = visit + 1, s, t
            n, last = n + 1, t
        held.update((visit, now, start, last, n, late))
        if idle_ms:
            held.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(done, columns=names)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return frames.select(replicate, time, state).where(f"`{time}` is not null and `{state}` is not null").groupBy(replicate).applyInPandasWithState(step, out, kept, "append", timeout)


def running_moments(frames: DataFrame, replicate: str, vector: str) -> DataFrame:
    """(replicate, n, mean, m2) after each batch that brought the replicate frames (update mode): M2 is flat, D x D."""
    kind = dict(frames.dtypes)[replicate]
    out = f"`{replicate}` {kind}, n long, mean array<double>, m2 array<double>"

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        from terrane.operators.decompose import merged, of_rows

        total = None
        if held.exists:
            n, mean, m2 = held.get
            total = (n, np.array(mean), np.array(m2).reshape(len(mean), -1))
        for rows in batches:
            if len(rows):
                more = of_rows(np.stack(rows[vector].to_numpy()).astype(float))
                total = more if total is None else merged(total, more)
        if total is None:
            return
        flat = (int(total[0]), total[1].tolist(), total[2].ravel().tolist())
        held.update(flat)
        yield pd.DataFrame([(key[0], *flat)], columns=[replicate, "n", "mean", "m2"])

    return frames.select(replicate, vector).where(f"`{vector}` is not null").groupBy(replicate).applyInPandasWithState(step, out, "n long, mean array<double>, m2 array<double>", "update", GroupStateTimeout.NoTimeout)

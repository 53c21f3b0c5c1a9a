"""Rules that depend on what earlier events of a key did: bounded state over sorted Arrow batches, or over a stream.

A rule is a first state and a step from (state, milliseconds, value) to (state, result). In a batch a
key's events are sorted within a partition and read one Arrow batch after another, so
no key is gathered. On a stream the state of a key is kept between micro-batches; a micro-batch's events
of a key are sorted before they are taken, and an event that comes after a later one of an earlier
micro-batch is taken as it comes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass(frozen=True)
class Rule:
    """added: the result column and its type; state: the state's columns, so that a stream can store it."""

    added: str
    kind: str
    state: str
    first: tuple
    step: Callable[[tuple, float, object], tuple[tuple, object]]


def capped_burst(gap_ms: int, most_ms: int) -> Rule:
    """burst, from 0 for each key: a burst ends when the key is quiet for gap_ms, or most_ms after its first event."""

    def step(state, t, _):
        first, last, burst = state
        if burst < 0 or t - last >= gap_ms or t - first >= most_ms:
            first, burst = t, burst + 1
        return (first, t, burst), burst

    return Rule("burst", "long", "first double, last double, burst long", (0.0, 0.0, -1), step)


def count_or_time(width_ms: int, most: int) -> Rule:
    """batch, from 0 for each key: a batch opens at an event and closes after width_ms, or once it holds ``most`` distinct values."""

    def step(state, t, value):
        opened, held, batch = state
        if batch < 0 or t - opened >= width_ms or len(held) >= most:
            opened, held, batch = t, [], batch + 1
        return (opened, held if value in held else [*held, value], batch), batch

    return Rule("batch", "long", "opened double, held array<string>, batch long", (0.0, [], -1), step)


def sliding_limit(most: int, per_ms: int, burst: int, burst_ms: int) -> Rule:
    """allowed: fewer than ``most`` allowed events in per_ms and fewer than ``burst`` in burst_ms; only allowed events count."""

    def step(state, t, _):
        kept = [x for x in state[0] if x > t - per_ms]
        ok = len(kept) < most and sum(x > t - burst_ms for x in kept) < burst
        return ([*kept, t] if ok else kept,), ok

    return Rule("allowed", "boolean", "kept array<double>", ([],), step)


def _schema(events: DataFrame, rule: Rule) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema) + f", {rule.added} {rule.kind}"


def _ms(frame: pd.DataFrame) -> np.ndarray:
    return (pd.to_datetime(frame["ts"]).astype("datetime64[us]").astype("int64") / 1000).to_numpy()


def apply(events: DataFrame, rule: Rule, key: str, value: str | None = None) -> DataFrame:
    """events (with ts and event_id) and the rule's result for each, in the order of a key's times."""
    names, value = [f.name for f in events.schema], value or key
    rows = events.repartition(key).sortWithinPartitions(key, "ts", "event_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, fresh = None, rule.first, True
        for frame in frames:
            out = []
            for k, t, v in zip(frame[key], _ms(frame), frame[value]):
                if fresh or k != now:
                    now, state, fresh = k, rule.first, False
                state, result = rule.step(state, t, v)
                out.append(result)
            yield frame.assign(**{rule.added: np.array(out)})[[*names, rule.added]]

    return rows.mapInPandas(run, _schema(events, rule))


def apply_stream(events: DataFrame, rule: Rule, key: str, value: str | None = None) -> DataFrame:
    """apply on a stream, in append mode. A key's events of one micro-batch are held at once: bound the trigger's files or rows."""
    names, value = [f.name for f in events.schema], value or key

    def run(_: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = held.get if held.exists else rule.first
        state = tuple(list(x) if isinstance(x, (list, np.ndarray)) else x for x in state)
        frame = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for t, v in zip(_ms(frame), frame[value]):
            state, result = rule.step(state, float(t), v)
            out.append(result)
        held.update(state)
        yield frame.assign(**{rule.added: np.array(out)})[[*names, rule.added]]

    return events.groupBy(key).applyInPandasWithState(run, _schema(events, rule), rule.state, "append", GroupStateTimeout.NoTimeout)


def capped_bursts(events: DataFrame, gap_ms: int, most_ms: int, key: str = "path") -> DataFrame:
    return apply(events, capped_burst(gap_ms, most_ms), key)


def count_or_time_batches(events: DataFrame, width_ms: int, most: int, key: str = "user_id", path: str = "path") -> DataFrame:
    return apply(events, count_or_time(width_ms, most), key, path)

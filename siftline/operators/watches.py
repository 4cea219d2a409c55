"""The life of watches: when a check is due, what it found, pauses and errors, as one fold over what happened in order.

The same steps run over sorted rows in one batch (`life_cycle`) and over a stream (`streaming.jobs.watch_life`).

A watch begins active with its first row. `capture` and `error` are checks; a capture whose content differs from the one
before is a change; an error puts the watch in status `error`, from which only a capture or `resume` brings it back. While
a watch is active a check is due `interval` after the last one, or at once if there was none: one row `due` until the
next check. `pause`, `resume` and `remove` are what they say; `every N` sets the interval in seconds, 60 at least. A
watch that was removed begins anew with its next row. Rows of another kind change nothing.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# Seconds between checks unless told otherwise, and at least.
INTERVAL, LEAST = 3600, 60
SCHEMA = "watch_id string, at long, event string, status string, checks long, changes long"

State = list  # status, interval, last row, last check or None, last content or None, checks, changes, whether `due` was said


def _due(state: State) -> int | None:
    """When the next check is due that wasn't told of, in microseconds."""
    status, interval, last, checked, _, _, _, told = state
    if status != "active" or told:
        return None
    return last if checked is None else max(last, checked + interval * 1_000_000)


def _told(state: State, until: int) -> list[tuple]:
    due = _due(state)
    if due is None or due > until:
        return []
    state[7] = True
    return [(due, "due", state[0], state[5], state[6])]


def step(state: State | None, at: int, values: tuple) -> tuple[State | None, list[tuple]]:
    """The state after a row (kind, detail) and what is to be told: (at, event, status, checks, changes)."""
    kind, detail = values
    out = _told(state, at) if state else []
    state = list(state) if state else ["active", INTERVAL, at, None, None, 0, 0, False]
    event = kind
    if kind == "capture":
        event = "first" if state[4] is None else "same" if state[4] == detail else "changed"
        state[0] = "active" if state[0] == "error" else state[0]
        state[3:] = [at, detail or "", state[5] + 1, state[6] + (event == "changed"), False]
    elif kind == "error":
        state[0], state[3], state[5], state[7] = "error", at, state[5] + 1, False
    elif kind == "pause":
        state[0] = "paused"
    elif kind == "resume":
        state[0] = "active"
    elif (kind or "").startswith("every ") and kind[6:].isdigit():
        state[1], state[7] = max(int(kind[6:]), LEAST), False
    state[2] = at
    if kind == "remove":
        return None, [*out, (at, "remove", "removed", state[5], state[6])]
    return state, [*out, (at, event, state[0], state[5], state[6])]


def idle(state: State | None, until: int) -> tuple[State | None, list[tuple], int | None]:
    """What is due by `until`, and when the next check will be."""
    out = _told(state, until) if state else []
    return state, out, _due(state) if state else None


def life_cycle(rows: DataFrame, as_of: Column) -> DataFrame:
    """SCHEMA of rows (watch_id, ts, kind, detail), told up to `as_of`. Rows are dealt by watch and sorted by Spark; a task
    carries one watch's state along, whatever its history. Ties are worked off by kind, then detail."""
    until = F.unix_micros(as_of)
    some = rows.select(F.col("watch_id").cast("string").alias("w"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "kind", "detail", until.alias("until"))
    dealt = some.filter("w IS NOT NULL AND at IS NOT NULL").repartition("w").sortWithinPartitions("w", "at", "kind", "detail")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, end = None, None, 0
        for b in batches:
            out: list[tuple] = []
            for w, at, kind, detail, until in zip(*(c.to_pylist() for c in b.columns)):
                if w != last:
                    out += [(last, *r) for r in idle(state, end)[1]]
                    last, state = w, None
                state, told = step(state, at, (kind, detail))
                out += [(w, *r) for r in told]
                end = until
            yield _batch(out)
        yield _batch([(last, *r) for r in idle(state, end)[1]])

    return dealt.mapInArrow(fold, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    cols = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], [f.split()[0] for f in SCHEMA.split(", ")])

"""Who is let through: limiters and breakers whose every decision depends on those before it.

Each is a fold over a key's calls in order. Calls are dealt by key and sorted by Spark; a task then reads them batch by
batch and carries only a key's small state along, so a key with any number of calls needs no more memory than another.
"""

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

Step = Callable[[object, int, bool], tuple[object, tuple]]


def fold(events: DataFrame, key: str, ts: str, order: str, flag: Column, start: Callable[[], object], step: Step, out: dict[str, pa.DataType]) -> DataFrame:
    """(key, order, out...): `step(state, micros, flag)` gives the next state and the values of `out` for each call."""
    rows = events.select(
        F.col(key).cast("long").alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(order).cast("long").alias("o"), flag.alias("f")
    )
    dealt = rows.repartition("k").sortWithinPartitions("k", "at", "o")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, begun = None, None, False
        for b in batches:
            made = []
            for k, at, f in zip(*(b.column(c).to_pylist() for c in ("k", "at", "f"))):
                if not begun or k != last:
                    last, state, begun = k, start(), True
                state, values = step(state, at, f)
                made.append(values)
            cols = list(zip(*made)) or [[] for _ in out]
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("o"), *(pa.array(c, t) for c, t in zip(cols, out.values()))], [key, order, *out])

    kinds = {pa.bool_(): "boolean", pa.int64(): "long", pa.string(): "string"}
    return dealt.mapInArrow(run, ", ".join([f"{key} long", f"{order} long", *(f"{n} {kinds[t]}" for n, t in out.items())]))


def token_bucket(events: DataFrame, key: str, ts: str, order: str, capacity: float, per_second: float) -> DataFrame:
    """(key, order, allowed, remaining): a bucket of tokens for each key that refills with time."""

    def step(state, at, _):
        tokens = capacity if state is None else min(capacity, state[0] + (at - state[1]) / 1e6 * per_second)
        ok = tokens >= 1
        tokens -= ok
        return (tokens, at), (ok, int(tokens))

    return fold(events, key, ts, order, F.lit(False), lambda: None, step, {"allowed": pa.bool_(), "remaining": pa.int64()})


def circuit_breaker(events: DataFrame, key: str, ts: str, order: str, failed: Column, limit: int, timeout: float) -> DataFrame:
    """(key, order, state, rejected): closed, open after `limit` failures in a row, half open after `timeout` seconds."""

    def step(state, at, bad):
        name, run, opened = state
        if name == "open" and at - opened >= timeout * 1e6:
            name = "half_open"
        rejected = name == "open"
        if not rejected:
            run = run + 1 if bad else 0
            if bad and (name == "half_open" or run >= limit):
                name, opened = "open", at
            elif not bad:
                name = "closed"
        return (name, run, opened), (name, rejected)

    return fold(events, key, ts, order, failed, lambda: ("closed", 0, 0), step, {"state": pa.string(), "rejected": pa.bool_()})


def sliding_window(events: DataFrame, key: str, ts: str, order: str, limit: int, seconds: int) -> DataFrame:
    """(key, order, allowed, retry_after): at most `limit` calls let through within the last `seconds`; those turned away
    don't count. `retry_after`: seconds until the oldest of them has passed, 0 where a call is let through."""
    width = seconds * 1_000_000

    def step(state, at, _):
        while state and state[0] <= at - width:
            state.popleft()
        if len(state) >= limit:
            return state, (False, -(-(state[0] + width - at) // 1_000_000))
        state.append(at)
        return state, (True, 0)

    return fold(events, key, ts, order, F.lit(False), deque, step, {"allowed": pa.bool_(), "retry_after": pa.int64()})


def several_buckets(events: DataFrame, key: str, ts: str, order: str, buckets: list[tuple[int, int]]) -> DataFrame:
    """(key, order, allowed, denied_by): buckets of (calls, seconds) that fill up whole at each interval's end, counted
    from a key's first call; a call takes from all of them or from none. `denied_by`: the first empty one's number."""
    widths = [s * 1_000_000 for _, s in buckets]

    def step(state, at, _):
        state = state or [(n, at) for n, _ in buckets]
        state = [
            (cap, since + (at - since) // width * width) if at - since >= width else (left, since)
            for (left, since), (cap, _), width in zip(state, buckets, widths)
        ]
        empty = next((k for k, (left, _) in enumerate(state) if left < 1), -1)
        if empty < 0:
            state = [(left - 1, since) for left, since in state]
        return state, (empty < 0, empty)

    return fold(events, key, ts, order, F.lit(False), lambda: None, step, {"allowed": pa.bool_(), "denied_by": pa.int64()})

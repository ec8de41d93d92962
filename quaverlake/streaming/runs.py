"""Runs and windows over a stream of events, as an extension: the batch form is in ``operators.sequences``.

State per user is one list of at most window - 1 items and a few numbers, so it doesn't grow with the
stream. Events of a user must arrive in their order. One that is earlier than the last one seen is late: the batch
form would have placed it between events that are already counted, so it is in no window, and comes out as a row of
kind ``late`` instead. A user without events for longer than ``keep`` is forgotten, if that is given, with a row of kind
``closed``; events after that begin anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "kind string, user string, run_index long, start_index long, source_row long, items array<string>"
STATE = "items array<string>, run long, position long, skipped long, last_ts long, last_row long"


def advance(state: tuple, events: list[tuple], gap: int | None, window: int) -> tuple[tuple, list[tuple]]:
    """The state after the events (ts, source_row, item), in their order, with what they give: windows (``window``) and late events."""
    items, run, position, skipped, last_ts, last_row = state
    items, out = list(items), []
    for ts, row, item in sorted(events, key=lambda e: (e[0], e[1])):
        if (ts, row) <= (last_ts, last_row):
            out.append(("late", run, position, row, [] if item is None else [item]))
            continue
        last_ts, last_row = ts, row
        if item is None:
            skipped += 1
            continue
        if run < 0 or (gap is not None and skipped > gap):
            items, run, position = [], run + 1, 0
        skipped = 0
        items.append(item)
        position += 1
        if len(items) == window:
            out.append(("window", run, position - window, row, list(items)))
            items = items[1:]
    return (items, run, position, skipped, last_ts, last_row), out


def stream_windows(events: DataFrame, gap: int | None = 5, window: int = 20, keep: str | None = None) -> DataFrame:
    """(kind, user, run_index, start_index, source_row, items) of a stream (user, ts, source_row, item): windows as they are
    completed, late events (run_index and start_index are where the user is by then), and users whose state is closed.
    A null item is an unmapped event, a null user is skipped. ``keep`` (``30 days``) is how long a user without events is
    remembered, in processing time; without it every user is, in a state of bounded size each."""
    columns = ["kind", "user", "run_index", "start_index", "source_row", "items"]
    patience = None if keep is None else int(pd.Timedelta(keep).total_seconds() * 1000)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            _, last_run, position, _, _, last_row = state.get
            state.remove()
            yield pd.DataFrame([("closed", key[0], last_run, position, last_row, [])], columns=columns)
            return
        now = state.get if state.exists else ([], -1, 0, 0, -(1 << 62), -1)
        rows: list[tuple] = []
        for pdf in parts:
            stamps = pdf["ts"].astype("datetime64[us]").astype("int64")
            rows += [(int(t), int(r), None if pd.isna(i) else i) for t, r, i in zip(stamps, pdf["source_row"], pdf["item"], strict=True)]
        now, done = advance(now, rows, gap, window)
        state.update(now)
        if patience is not None:
            state.setTimeoutDuration(patience)
        yield pd.DataFrame([(kind, key[0], *d) for kind, *d in done], columns=columns)

    known = events.where("user IS NOT NULL")
    return known.groupBy("user").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout if keep is None else GroupStateTimeout.ProcessingTimeTimeout)

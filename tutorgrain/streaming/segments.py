"""Segmentation of dialogues as they arrive: the batch fold's step function over keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tutorgrain.operators.assign import SegmentState, segment_step

OUTPUT = "dialogue string, segment_no int, dominant string, members array<int>"
STATE = "dominant string, members array<int>, number int"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, silence_ms: int | None) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        dominant, members, number = state.get
        state.remove()
        yield pd.DataFrame([(key[0], number, dominant, list(members))], columns=["dialogue", "segment_no", "dominant", "members"])
        return
    now = SegmentState()
    if state.exists:
        dominant, members, number = state.get
        now = SegmentState(dominant, [int(m) for m in members], number)
    rows = pd.concat(list(batches)).sort_values("idx")
    out = []
    for row in rows.to_dict("records"):
        after, closed = segment_step(now, row)
        if closed:
            out.append((key[0], now.number, now.dominant, closed))
        now = after
    state.update((now.dominant, now.members, now.number))
    if silence_ms:
        state.setTimeoutDuration(silence_ms)
    yield pd.DataFrame(out, columns=["dialogue", "segment_no", "dominant", "members"])


def stream_segments(rows: DataFrame, silence_ms: int | None = None) -> DataFrame:
    """Closed segments of a stream of resolved exchanges (dialogue, idx, final, resolved, band, kc_set).

    Exchanges of a dialogue must arrive in order between micro-batches; within one they are sorted. An open segment is
    given out when its dialogue has been silent for ``silence_ms`` of processing time; without it, when it is closed.
    """
    timeout = GroupStateTimeout.ProcessingTimeTimeout if silence_ms else GroupStateTimeout.NoTimeout

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        yield from _advance(key, batches, state, silence_ms)

    return rows.groupBy("dialogue").applyInPandasWithState(advance, OUTPUT, STATE, "append", timeout)

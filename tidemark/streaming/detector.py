"""The failure detector over a stream of heartbeats, with one number of state per node."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "node long, tick long, ok boolean, misses long, state string, recovered boolean"


def _step(max_misses: int):
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        beats = pd.concat(list(parts)).sort_values("tick", kind="stable")
        before = state.get[0] if state.exists else 0
        ok = beats["ok"].to_numpy(bool)
        # Misses since the last good beat: the place after it, or after the start plus what was before.
        at = np.arange(len(ok))
        last = np.maximum.accumulate(np.where(ok, at, -1))
        misses = np.where(last >= 0, at - last, at + 1 + before)
        previous = np.concatenate([[before], misses[:-1]])
        state.update((int(misses[-1]),))
        yield pd.DataFrame(
            {
                "node": key[0],
                "tick": beats["tick"].to_numpy(),
                "ok": ok,
                "misses": misses,
                "state": np.where(misses >= max_misses, "DEAD", "ALIVE"),
                "recovered": ok & (previous >= max_misses),
            }
        )

    return run


def detect(beats: DataFrame, max_misses: int = 3) -> DataFrame:
    """A stream (node, tick, ok) to the rows of the batch detector, as beats come.

    Beats of a micro-batch are taken in order of their tick; state is the
    number of misses since the node's last good beat.
    """
    return beats.groupBy("node").applyInPandasWithState(_step(max_misses), OUT, "misses long", "append", GroupStateTimeout.NoTimeout)

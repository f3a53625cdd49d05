"""Streaming forms of the two order-dependent folds, and incremental scoring of files that arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parley.functions import lexicon as lx

def _timeout(idle: int | None) -> str:
    """With a timeout a query never runs out of work, so a bounded run (availableNow) needs idle=None."""
    return GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout


PACKED = "user_id long, start double, end double"
PACKING = "start double, end double"


def pack_stream(regions: DataFrame, most: float = lx.MAX_WINDOW_S, gap: float = lx.MAX_GAP_S, idle: int | None = 600_000) -> DataFrame:
    """Regions (user_id, start, end, in order per user) -> windows, put out once the next region starts another.

    State is one open window per user; it is put out when the user is silent for `idle` milliseconds (None: never)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done = []
        if state.hasTimedOut:
            done.append((key[0], *state.get))
            state.remove()
        else:
            open_ = state.get if state.exists else None
            rows = pd.concat(batches).sort_values(["start", "end"])
            for s, e in zip(rows["start"], rows["end"], strict=True):
                if open_ and e - open_[0] <= most and s - open_[1] <= gap:
                    open_ = (open_[0], e)
                else:
                    if open_:
                        done.append((key[0], *open_))
                    open_ = (s, e)
            state.update(open_)
            if idle:
                state.setTimeoutDuration(idle)
        yield pd.DataFrame(done, columns=["user_id", "start", "end"])

    return regions.groupBy("user_id").applyInPandasWithState(step, PACKED, PACKING, "append", _timeout(idle))


TURNS = "interview_id long, role string, text string, first_pos long"
OPEN_TURN = "role string, text string, first_pos long"


def merge_stream(turns: DataFrame, idle: int | None = 600_000) -> DataFrame:
    """Turns (interview_id, pos, role, text, in order per interview) -> merged turns, put out when the role changes."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done = []
        if state.hasTimedOut:
            done.append((key[0], *state.get))
            state.remove()
        else:
            open_ = state.get if state.exists else None
            rows = pd.concat(batches).sort_values("pos")
            for pos, role, text in zip(rows["pos"], rows["role"], rows["text"], strict=True):
                text = " ".join((text or "").split())
                if role not in lx.ROLES or not text:
                    continue
                if open_ and open_[0] == role:
                    open_ = (role, open_[1] + ("" if text[0] in ",.;:!?…)]}»”’" else " ") + text, open_[2])
                else:
                    if open_:
                        done.append((key[0], *open_))
                    open_ = (role, text, int(pos))
            if open_:
                state.update(open_)
                if idle:
                    state.setTimeoutDuration(idle)
        yield pd.DataFrame(done, columns=["interview_id", "role", "text", "first_pos"])

    return turns.groupBy("interview_id").applyInPandasWithState(step, TURNS, OPEN_TURN, "append", _timeout(idle))


def score_arrivals(arrivals: DataFrame, score, out: str, checkpoint: str):
    """Runs score(batch) on files as they arrive, each once: the checkpoint stands for "output exists, skip"."""
    return arrivals.writeStream.foreachBatch(lambda df, k: score(df).write.mode("overwrite").parquet(f"{out}/batch={k}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Votes over a stream of chains, kept up to date: late, repeated and corrected chains change a vote by retraction."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGES = "problem_id string, change int, winner string, correct boolean, tie boolean, n int, final boolean"
_NAMES = [c.split()[0] for c in CHANGES.split(", ")]


def vote_of(chains: dict[str, list]) -> list:
    """winner, correct, tie and n, from chains by place: answer, verdict, revision."""
    tally: dict[str, list[int]] = {}
    for answer, correct, _ in chains.values():
        if answer is not None:
            own = tally.setdefault(answer, [0, 0])
            own[0] += 1
            own[1] += bool(correct)
    if not tally:
        return [None, False, False, len(chains)]
    most = max(n for n, _ in tally.values())
    best = sorted(a for a, (n, _) in tally.items() if n == most)
    return [best[0], tally[best[0]][1] > 0, len(best) > 1, len(chains)]


def vote_changes(chains: DataFrame, quiet_ms: int | None = None) -> DataFrame:
    """A stream of changes from one of chains (problem_id, chain_index, answer, correct, revision): CHANGES.

    The state of a problem is its chains by place and the vote told last. A chain that comes again counts once; one with
    a higher revision replaces the earlier one, a lower is left out. So the vote depends on the set of chains only:
    repeated files, late chains and any order of arrival lead to the vote of a batch over all chains. A changed vote is
    told as the old one with change -1 and the new one with +1; current() adds them up. After quiet_ms (none: never)
    without a chain the vote is told as final; its state stays, so that what comes even later still corrects it. With
    it, batches without rows go on, so the query needs an interval as its trigger and doesn't end by itself. Rows without a problem
    or a place are passed over; a null verdict is false, a null revision 0.
    """
    rows = chains.select(F.col("problem_id").cast("string").alias("problem_id"), F.col("chain_index").cast("int").alias("chain_index"), "answer", F.coalesce("correct", F.lit(False)).alias("correct"), F.coalesce(F.col("revision").cast("long"), F.lit(0)).alias("revision")).filter("problem_id is not null and chain_index is not null")

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, told = (json.loads(x) for x in state.get) if state.exists else ({}, None)
        changed = False
        if state.hasTimedOut:
            new = None if told is None or told[4] else [*told[:4], True]
        else:
            for frame in frames:
                for place, answer, correct, revision in zip(frame["chain_index"].tolist(), frame["answer"].tolist(), frame["correct"].tolist(), frame["revision"].tolist(), strict=True):
                    if str(place) not in held or held[str(place)][2] < revision:
                        held[str(place)] = [None if pd.isna(answer) else answer, bool(correct), revision]
                        changed = True
            new = [*vote_of(held), False] if changed else None
            if quiet_ms is not None:
                state.setTimeoutDuration(quiet_ms)
        out = []
        if new is not None and new != told:
            out = [(key[0], 1, *new)] if told is None else [(key[0], -1, *told), (key[0], 1, *new)]
            told = new
        state.update((json.dumps(held), json.dumps(told)))
        yield pd.DataFrame(out, columns=_NAMES)

    return rows.groupBy("problem_id").applyInPandasWithState(follow, CHANGES, "chains string, told string", "append", GroupStateTimeout.NoTimeout if quiet_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def current(changes: DataFrame) -> DataFrame:
    """The votes that stand after all changes."""
    kept = [c for c in _NAMES if c != "change"]
    return changes.groupBy(*kept).agg(F.sum("change").alias("__n")).filter("__n > 0").drop("__n")

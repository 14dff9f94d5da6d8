"""The analysis-job state machine over a stream of job events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from citegrain.operators.jobs import FOLLOWS

OUTPUT = "paper_id string, job_id string, status string, at timestamp, accepted boolean"
STATE = "job_id string, status string"


def track_jobs(events: DataFrame) -> DataFrame:
    """Judge each event against the state of its paper.

    Requests for a paper that is queued, running or completed change nothing; a failed one
    may be queued again and keeps its job id; other events must follow the state machine.
    ``events``: paper_id, job_id, status, at.
    """

    def advance(
        key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        job, status = state.get if state.exists else (None, None)
        rows = []
        for event in pd.concat(list(batches)).sort_values("at", kind="stable").itertuples():
            accepted = status in FOLLOWS.get(event.status, ())
            if accepted:
                job, status = job or event.job_id, event.status
            rows.append((key[0], job, status, event.at, accepted))
        if status is not None:
            state.update((job, status))
        yield pd.DataFrame(rows, columns=["paper_id", "job_id", "status", "at", "accepted"])

    return events.groupBy("paper_id").applyInPandasWithState(
        advance, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout
    )

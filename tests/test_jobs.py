"""The job state machine: folded logs, admission, and the same log as a stream."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from citegrain.operators import jobs, state_maps
from citegrain.streaming.job_stream import track_jobs

BEGIN = datetime(2024, 1, 1)


def log(seed=1, hot=4000):
    """Events of many jobs, one with most of them; some of no known kind."""
    chance, rows = random.Random(seed), []
    kinds = [*jobs.STATUSES, "queued", "running", None, "paused"]
    for k in range(hot + 600):
        job = "hot" if k < hot else f"job{chance.randrange(40)}"
        rows.append((job, BEGIN + timedelta(seconds=chance.randrange(50_000)), k, chance.choice(kinds)))
    return rows + [("idle", BEGIN, -1, "completed"), (None, BEGIN, -2, "queued")]


def plain(rows):
    found = {}
    for job, at, _, status in sorted(rows, key=lambda r: (r[1], r[2])):
        state = found.setdefault(job, [None, 0, 0, None, None, None, None])
        if state[0] in jobs.FOLLOWS.get(status, ()):
            state[0], state[1], state[3] = status, state[1] + 1, at
            if status == "queued":
                state[4:] = [at, None, None]
            else:
                state[5 if status == "running" else 6] = at
        else:
            state[2] += 1
    return {k: tuple(v) for k, v in found.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_folded_log(spark, seed):
    rows = log(seed)
    df = spark.createDataFrame(rows, "paper_id string, at timestamp, event_id long, status string").repartition(6)
    found = {r.paper_id: tuple(r)[1:] for r in state_maps.folded(df, tie="event_id").collect()}
    expected = plain(rows)
    assert found == expected and expected["idle"][:3] == (None, 0, 1)
    latest = {r.paper_id: r.status for r in state_maps.latest_state(df, tie="event_id").collect()}
    assert latest == {k: v[0] for k, v in expected.items() if v[0] is not None}
    none = state_maps.folded(df.limit(0), tie="event_id")
    assert none.count() == 0 and none.columns[:4] == ["paper_id", "status", "legal", "illegal"]


def test_maps_compose_in_any_grouping():
    chance = random.Random(3)
    statuses = [chance.choice([*jobs.STATUSES, None]) for _ in range(64)]
    maps = state_maps.event_maps(statuses, np.arange(64))
    one = maps[:1]
    for k in range(1, 64):
        one = state_maps.composed(one, maps[k : k + 1])
    for size in (1, 3, 7, 64):
        parts = [state_maps.runs_folded(np.zeros(len(p), object), p)[1] for p in np.array_split(maps, size)]
        assert (state_maps.runs_folded(np.zeros(size, object), np.concatenate(parts))[1] == one).all()


def test_admission(spark):
    papers = spark.createDataFrame([(p,) for p in "abcdefg"], "paper_id string")
    known = spark.createDataFrame([("a", "queued"), ("b", "failed"), ("c", "completed"), ("d", "running")], "paper_id string, status string")
    asked = [(p, BEGIN + timedelta(seconds=k)) for k, p in enumerate("aabgfcezd")]
    requests = spark.createDataFrame(asked, "paper_id string, at timestamp")
    outcome = {r.paper_id: (r.outcome, r.scheduled) for r in jobs.enqueue(requests, papers, known, 4).collect()}
    assert outcome == {
        "a": ("queued", False), "b": ("queued", True), "c": ("completed", False), "d": ("running", False),
        "e": ("queue_full", False), "f": ("queue_full", False), "g": ("queued", True), "z": ("unknown_paper", False),
    }
    again = jobs.enqueue(requests, papers, known.unionByName(spark.createDataFrame([("g", "queued")], known.schema)), 2)
    assert {r.paper_id for r in again.where("scheduled").collect()} == set()
    assert {r.status for r in jobs.recover(known).collect()} == {"queued", "failed", "completed"}


def test_stream_agrees_with_the_folded_log(spark, tmp_path):
    rows = [(p, f"j-{p}", s, t) for p, t, _, s in sorted(log(5, 60), key=lambda r: (r[1], r[2])) if p and s]
    schema = "paper_id string, job_id string, status string, at timestamp"
    half = len(rows) // 2
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    for n, part in enumerate((rows[:half], rows[half:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = track_jobs(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        stream.writeStream.format("parquet").option("checkpointLocation", marks).option("path", out).trigger(availableNow=True).start().awaitTermination()
    judged = spark.read.parquet(out).collect()
    expected = plain([(p, t, n, s) for n, (p, _, s, t) in enumerate(rows)])
    assert len(judged) == len(rows)
    assert sum(r.accepted for r in judged) == sum(v[1] for v in expected.values())

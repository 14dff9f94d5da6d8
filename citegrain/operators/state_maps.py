"""The job state machine as maps that compose.

An event turns every state a job may be in into a state; a run of events is again such a map, and
maps compose in order, in any grouping. So an ordered log is cut into ranges, each range folds its
runs to one map a job, and the few maps of a job are composed in a second pass: a job with any
number of events never becomes one task.

A map holds for each starting state: the end state, how many events were legal and illegal on the
way, whether a legal request reset the job, and the last times of its stages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrain.operators.jobs import FOLLOWS, STATUSES

STARTS = (None, *STATUSES)
FIELDS = ("end", "legal", "illegal", "reset", "updated_at", "queued_at", "started_at", "finished_at")
END, LEGAL, ILLEGAL, RESET, UPDATED = range(5)
NEVER = np.iinfo(np.int64).min
# the time that an event of each status sets, besides that of the last update
STAGE = {"queued": 5, "running": 6, "completed": 7, "failed": 7}


def event_maps(statuses: list[str | None], at: np.ndarray) -> np.ndarray:
    """One map for each event; an unknown status is illegal in every state."""
    maps = np.full((len(statuses), len(STARTS), len(FIELDS)), NEVER, np.int64)
    maps[:, :, END] = np.arange(len(STARTS))
    maps[:, :, LEGAL], maps[:, :, ILLEGAL], maps[:, :, RESET] = 0, 1, 0
    told = np.array([STARTS.index(s) if s in STATUSES else 0 for s in statuses], np.int64)
    for number, status in enumerate(STARTS):
        if status is None:
            continue
        rows = np.flatnonzero(told == number)
        for start in (STARTS.index(f) for f in FOLLOWS[status]):
            maps[rows, start, END], maps[rows, start, LEGAL], maps[rows, start, ILLEGAL] = number, 1, 0
            maps[rows, start, RESET] = status == "queued"
            maps[rows, start, UPDATED] = maps[rows, start, STAGE[status]] = at[rows]
    return maps


def composed(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """The maps of `first`, each followed by that of `then`."""
    after = np.take_along_axis(then, first[:, :, END, None], axis=1)
    found = after.copy()
    found[:, :, LEGAL : ILLEGAL + 1] += first[:, :, LEGAL : ILLEGAL + 1]
    found[:, :, RESET] |= first[:, :, RESET]
    kept = (after == NEVER) & (after[:, :, RESET, None] == 0)
    kept[:, :, :UPDATED] = False
    return np.where(kept, first, found)


def runs_folded(keys: np.ndarray, maps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, map and first row of each run of equal keys, by composing neighbours in halving rounds."""
    rows = np.arange(len(keys))
    while len(keys):
        fresh = np.concatenate(([True], keys[1:] != keys[:-1]))
        if fresh.all():
            break
        start = np.flatnonzero(fresh)
        place = np.arange(len(keys)) - np.repeat(start, np.diff(np.append(start, len(keys))))
        left = np.flatnonzero(place % 2 == 0)
        paired = np.append(place, 0)[left + 1] % 2 == 1
        out = maps[left]
        out[paired] = composed(maps[left[paired]], maps[left[paired] + 1])
        keys, maps, rows = keys[left], out, rows[left]
    return keys, maps, rows


def _packed(maps: np.ndarray) -> pa.Array:
    size = len(STARTS) * len(FIELDS)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(maps) + 1, dtype=np.int32) * size), pa.array(maps.reshape(-1)))


def _unpacked(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(STARTS), len(FIELDS)).copy()


def _keys(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(object)


def folded(events: DataFrame, key: str = "paper_id", tie: str | None = None) -> DataFrame:
    """Every job after its whole log: key, status, legal and illegal events and the times of its stages.

    ``events``: key, status, at, and a column that orders events of one time. Illegal events change
    nothing. A request that queues a failed job again clears its later stages. A key without a legal
    event has no status.
    """
    kind = dict(events.dtypes)[key]
    order = F.col(tie).cast("string") if tie and dict(events.dtypes)[tie] == "string" else F.col(tie).cast("long") if tie else F.lit(0)
    rows = events.select(F.col(key).alias("k"), F.unix_micros(F.col("at").cast("timestamp")).alias("at"), order.alias("tie"), F.col("status").alias("status"))
    form = f"k {kind}, at long, tie {dict(rows.dtypes)['tie']}, map array<long>"

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("at").fill_null(int(NEVER)).to_numpy()
            _, maps, first = runs_folded(_keys(batch.column("k")), event_maps(batch.column("status").to_pylist(), at))
            heads = pa.array(first)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(heads) for c in ("k", "at", "tie")), _packed(maps)], ["k", "at", "tie", "map"]
            )

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple[pa.Array, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            column, maps = batch.column("k"), _unpacked(batch.column("map"))
            if waiting is not None:
                column, maps = pa.concat_arrays([waiting[0], column]), np.concatenate([waiting[1], maps])
            _, maps, first = runs_folded(_keys(column), maps)
            heads = column.take(pa.array(first))
            waiting = heads.slice(len(heads) - 1), maps[-1:]
            if len(heads) > 1:
                yield pa.RecordBatch.from_arrays([heads.slice(0, len(heads) - 1), _packed(maps[:-1])], ["k", "map"])
        if waiting is not None:
            yield pa.RecordBatch.from_arrays([waiting[0], _packed(waiting[1])], ["k", "map"])

    log = rows.repartitionByRange("k", "at", "tie").sortWithinPartitions("k", "at", "tie")
    parts = log.mapInArrow(shorten, form)
    whole = parts.repartition("k").sortWithinPartitions("k", "at", "tie").select("k", "map").mapInArrow(
        finish, f"k {kind}, map array<long>"
    )
    # the state before the first event is the first starting state
    field = lambda n: F.get("map", F.lit(n))
    time = lambda n: F.when(field(n) != int(NEVER), F.timestamp_micros(field(n)).cast(dict(events.dtypes)["at"]))
    status = F.get(F.array(F.lit(None).cast("string"), *map(F.lit, STATUSES)), field(END).cast("int"))
    return whole.select(
        F.col("k").alias(key), status.alias("status"), field(LEGAL).alias("legal"), field(ILLEGAL).alias("illegal"),
        *[time(n).alias(FIELDS[n]) for n in range(UPDATED, len(FIELDS))],
    )


def latest_state(events: DataFrame, key: str = "paper_id", tie: str | None = None) -> DataFrame:
    """Status and last change of every job that has one; events the state machine forbids do not count."""
    return folded(events, key, tie).where("status IS NOT NULL").select(key, "status", "updated_at")

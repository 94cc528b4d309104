"""Sums of matrices that tasks send in parts, so that no task and no driver holds many of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width

#: Lines of a matrix in one part; parts are added up one by one, all over the cluster.
ROWS = 32
#: Sums of one part that are made side by side before they are added up themselves.
BRANCHES = 64

PART_SCHEMA = "part int, giver long, data binary"


def task_number() -> int:
    task = TaskContext.get()
    return task.partitionId() if task else 0


def packed_rows(table: np.ndarray, lines: int = ROWS, giver: int = 0, first: int = 0) -> pa.RecordBatch:
    """A matrix as (part, giver, single-precision numbers) rows, parts from ``first`` on; a task's counts are exact in that."""
    parts = [table[i : i + lines].astype(np.float32).tobytes() for i in range(0, len(table), lines)]
    numbers = range(first, first + len(parts))
    return pa.record_batch([pa.array(numbers, pa.int32()), pa.array([giver] * len(parts), pa.int64()), pa.array(parts, pa.binary())], names=["part", "giver", "data"])


def add_up(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[pa.RecordBatch]:
    """One sum, in double precision, for each part and branch; rows come by part and branch, so one sum is held at a time."""
    now, total = None, np.zeros(0)
    for batch in batches:
        out = []
        for part, branch, data in zip(*(batch.column(c).to_pylist() for c in ("part", "branch", "data")), strict=True):
            row = np.frombuffer(data, kind).astype(np.float64)
            if (part, branch) == now:
                total += row
            else:
                if now:
                    out.append((*now, total.tobytes()))
                now, total = (part, branch), row
        yield sum_rows(out)
    if now:
        yield sum_rows([(*now, total.tobytes())])


def sum_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
    return pa.record_batch([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], names=["part", "branch", "data"])


def summed_parts(partial: DataFrame) -> dict[int, np.ndarray]:
    """The sums of the parts that tasks sent, added up in two levels before they are collected.

    Givers are added in their order, so that reruns agree to the last digit.
    """
    tasks = shuffle_width(partial.sparkSession)
    schema = "part int, branch long, data binary"
    dealt = partial.withColumn("branch", F.pmod("giver", F.lit(BRANCHES))).repartition(tasks, "part", "branch").sortWithinPartitions("part", "branch", "giver")
    branches = dealt.select("part", "branch", "data").mapInArrow(lambda it: add_up(it, np.float32), schema)
    again = branches.repartition(tasks, "part").sortWithinPartitions("part", "branch").select("part", F.lit(0).cast("long").alias("branch"), "data")
    rows = again.mapInArrow(lambda it: add_up(it, np.float64), schema).collect()  # one row for each part
    return {r["part"]: np.frombuffer(r["data"], np.float64) for r in rows}


def summed(partial: DataFrame, width: int) -> np.ndarray | None:
    """The sum of the matrices of ``width`` columns that tasks sent."""
    parts = summed_parts(partial)
    return np.concatenate([parts[p].reshape(-1, width) for p in sorted(parts)]) if parts else None

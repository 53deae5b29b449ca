"""Greedy cuts and reordering, whose state depends on what was decided before."""

from __future__ import annotations

import heapq
import sys

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import types as T

register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this package

CLUSTER_BYTES = 4 << 20
CLUSTER_MS = 30_000


def cut_clusters(ms: list[int], sizes: list[int], keys: list[bool], most_bytes: int = CLUSTER_BYTES, most_ms: int = CLUSTER_MS) -> list[int]:
    """Cluster numbers from 0: a new one at a key, at ``most_bytes`` held, or ``most_ms`` away from its first."""
    out, number, held, began = [], -1, 0, 0
    for t, size, key in zip(ms, sizes, keys, strict=True):
        if number < 0 or key or held >= most_bytes or abs(t - began) >= most_ms:
            number, held, began = number + 1, 0, t
        held += size
        out.append(number)
    return out


def assign_clusters(rows: DataFrame, stream: str, order: list[str], ms: str, size: str, key: str, most_bytes: int = CLUSTER_BYTES, most_ms: int = CLUSTER_MS) -> DataFrame:
    """``rows`` with the column ``cluster``. A stream is one group: its cuts depend on one another."""

    def cut(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order, kind="stable")
        return g.assign(cluster=cut_clusters(g[ms].tolist(), g[size].tolist(), g[key].tolist(), most_bytes, most_ms))

    return rows.groupBy(stream).applyInPandas(cut, T.StructType([*rows.schema, T.StructField("cluster", T.LongType())]))


def display_order(counts: list[int], resets: list[bool], most: int) -> list[int]:
    """Positions in order of output: the least count leaves once more than ``most`` wait; a reset first empties what waits."""
    waiting: list[tuple[int, int]] = []
    out: list[int] = []
    for i, (count, reset) in enumerate(zip(counts, resets, strict=True)):
        if reset:
            out += [j for _, j in sorted(waiting)]
            waiting = []
        heapq.heappush(waiting, (count, i))
        while len(waiting) > most:
            out.append(heapq.heappop(waiting)[1])
    return out + [j for _, j in sorted(waiting)]


def reorder(rows: DataFrame, stream: str, order: str, count: str, reset: str, most: int) -> DataFrame:
    """``rows`` with the column ``shown``: the place of each picture in its stream's output, from 0."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order, kind="stable")
        at = display_order(g[count].tolist(), g[reset].tolist(), most)
        place = pd.Series(range(len(at)), index=at).sort_index()
        return g.assign(shown=place.to_numpy())

    return rows.groupBy(stream).applyInPandas(run, T.StructType([*rows.schema, T.StructField("shown", T.LongType())]))

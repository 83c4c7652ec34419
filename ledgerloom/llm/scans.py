"""Running sums over sorted tables, in which one key may hold any part of the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut


def placed(df: DataFrame, *order) -> DataFrame:
    """df in sorted range partitions, checkpointed, so that each later pass meets the same rows at the same places."""
    return cut(df.repartitionByRange(*order).sortWithinPartitions(*order))


def _matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.column_stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names])


def running_sums(rows: DataFrame, key: str, values: list[str], before: bool = False) -> DataFrame:
    """rows and, for each of values, run_<name>: its sum over the key's rows up to this one; before: before_<name> too, without this one.

    rows come from placed() by an order that begins with key; key and values are longs without nulls, and sums wrap at 64 bits. Two
    passes: one finds each partition's first and last key and the last one's sums, of which the driver gets one row a partition; the
    other adds up within partitions, from what earlier ones left. No key has to fit into a task.
    """
    width = len(values)
    edge = T.StructType([T.StructField(n, T.LongType()) for n in ("part", "first", "last", "keys", *(f"s{i}" for i in range(width)))])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, keys, total = None, None, 0, np.zeros(width, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            k, v = batch.column(key).to_numpy(), _matrix(batch, values)
            first = k[0] if first is None else first
            keys += int(k[0] != last or not keys) + int((k[1:] != k[:-1]).sum())
            tail = v[np.searchsorted(k == k[-1], True) :].sum(axis=0)  # the last key's rows are the last ones
            total = total + tail if k[0] == k[-1] == last else tail
            last = k[-1]
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in (TaskContext.get().partitionId(), first, last, keys, *total)], names=edge.names)

    left, now, sums = {}, None, np.zeros(width, dtype=np.int64)
    for r in sorted(rows.select(key, *values).mapInArrow(edges, edge).collect()):
        own = np.array(r[4:], dtype=np.int64)
        if r["first"] == now:
            left[r["part"]] = (now, sums)
        sums = sums + own if r["first"] == now and r["keys"] == 1 else own
        now = r["last"]

    names = [f"run_{n}" for n in values] + [f"before_{n}" for n in values] * before
    out = T.StructType([*rows.schema.fields, *(T.StructField(n, T.LongType()) for n in names)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, base = left.get(TaskContext.get().partitionId(), (None, None))
        for batch in batches:
            if not batch.num_rows:
                continue
            k, v = batch.column(key).to_numpy(), _matrix(batch, values)
            at = np.cumsum(v, axis=0)
            new = np.r_[k[0] != last or base is None, k[1:] != k[:-1]]
            start = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))  # where each row's key begins; -1: in an earlier batch
            shift = np.where((start >= 0)[:, None], -(at - v)[np.maximum(start, 0)], 0 if base is None else base)
            at = at + shift
            last, base = k[-1], at[-1]
            more = [at[:, i] for i in range(width)] + [(at - v)[:, i] for i in range(width)] * before
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.int64()) for x in more)], names=out.names)

    return rows.mapInArrow(add, out)

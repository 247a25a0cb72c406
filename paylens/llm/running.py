"""Running totals along sorted runs, without gathering a run in one task.

Rows are range-partitioned by run and order, so a run of any length lies in
neighbouring partitions. Each partition totals its own rows; what a run has
gathered before a partition is then folded from one row a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from paylens.llm.common import prepare

_FOLDS = {"sum": np.add, "xor": np.bitwise_xor}


def _totals_before(values: np.ndarray, starts: np.ndarray, runs: np.ndarray, fold: np.ufunc, carry: int) -> tuple[np.ndarray, int]:
    """The total of each run before each of its rows, and the last run's whole total."""
    whole = fold.accumulate(values)
    before = np.concatenate([[0], whole[:-1]]).astype(np.int64)
    base = before[starts]
    # The first run goes on from the batch before.
    if fold is np.add:
        own = before - base[runs]
        own[runs == 0] += carry
        return own, int(own[-1] + values[-1])
    own = before ^ base[runs]
    own[runs == 0] ^= carry
    return own, int(own[-1] ^ values[-1])


def running(df: DataFrame, run: str, order: list[Column], totals: dict[str, str]) -> DataFrame:
    """``df`` with ``<column>_before`` for each long column in ``totals``: its sum or xor over the earlier rows of the run.

    ``run`` is a long column without nulls; ``order`` should be total within a
    run, else rows that tie are taken in any order. The result is checkpointed.
    """
    prepare(df.sparkSession)
    names = list(totals)
    extra = [StructField(f"{c}_before", LongType()) for c in names]
    marks = [StructField("__shard", IntegerType()), StructField("__first", LongType()), StructField("__edge", BooleanType())]
    schema = StructType([*(StructField(f.name, f.dataType) for f in df.schema), *extra, *marks])

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        first = last = None
        carry = dict.fromkeys(names, 0)
        fields = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column(batch.schema.get_field_index(run)).to_numpy()
            change = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            starts = np.concatenate([[0], change])
            runs = np.zeros(n, np.int64)
            runs[change] = 1
            runs = np.cumsum(runs)
            if last != keys[0]:
                carry = dict.fromkeys(names, 0)
            if first is None:
                first = int(keys[0])
            columns = []
            for c in names:
                values = batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64)
                own, carry[c] = _totals_before(values, starts, runs, _FOLDS[totals[c]], carry[c])
                columns.append(pa.array(own))
            last = keys[-1]
            fields = [*batch.schema, *(pa.field(f.name, pa.int64()) for f in extra)]
            fields += [pa.field("__shard", pa.int32()), pa.field("__first", pa.int64()), pa.field("__edge", pa.bool_())]
            marked = [pa.array(np.full(n, shard, np.int32)), pa.nulls(n, pa.int64()), pa.array(np.zeros(n, bool))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns, *marked], schema=pa.schema(fields))
        if fields is not None:
            # One more row a partition: its last run, and what that has gathered in it.
            told = {run: int(last), "__shard": shard, "__first": first, "__edge": True} | {f"{c}_before": carry[c] for c in names}
            yield pa.RecordBatch.from_arrays([pa.array([told.get(f.name)], f.type) for f in fields], schema=pa.schema(fields))

    dealt = df.repartitionByRange(F.col(run), *order).sortWithinPartitions(F.col(run), *order)
    marked = dealt.mapInArrow(along, schema).checkpoint()

    # One row a partition comes to the driver, and at most as many go back.
    told = marked.where("__edge").select("__shard", "__first", run, *(f"{c}_before" for c in names)).collect()
    folds = {c: (lambda a, b: a + b) if totals[c] == "sum" else (lambda a, b: a ^ b) for c in names}
    carried, held, sums = [], None, dict.fromkeys(names, 0)
    for edge in sorted(told, key=lambda r: r["__shard"]):
        own = {c: edge[f"{c}_before"] for c in names}
        if edge["__first"] == held:
            carried.append((edge["__shard"], held, *sums.values()))
            if edge[run] == held:
                own = {c: folds[c](sums[c], own[c]) for c in names}
        held, sums = edge[run], own
    offsets = df.sparkSession.createDataFrame(
        carried, StructType([StructField("__shard", IntegerType()), StructField("__run", LongType()), *(StructField(f"__{c}", LongType()) for c in names)])
    )
    rows = marked.where("not __edge").join(
        F.broadcast(offsets.withColumnRenamed("__shard", "__at")), (F.col("__shard") == F.col("__at")) & (F.col(run) == F.col("__run")), "left"
    )
    for c in names:
        more, own = F.coalesce(F.col(f"__{c}"), F.lit(0)), F.col(f"{c}_before")
        rows = rows.withColumn(f"{c}_before", own + more if totals[c] == "sum" else own.bitwiseXOR(more))
    return rows.select(*df.columns, *(f"{c}_before" for c in names))

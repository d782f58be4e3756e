"""Streaming forms of the ordered-scan operators: duplicates of the last value, debounced triggers, one-shot file queues."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A step takes what is carried (None at first) and rows in order, and gives what is carried on and the rows that leave.
Step = Callable[[tuple | None, list[tuple]], tuple[tuple, list[tuple]]]


class _InOrder(StatefulProcessor):
    """Holds a key's rows until the watermark has passed them, then gives them to ``step`` in the order of time."""

    def __init__(self, step: Step, columns: list[str], held: str, carried: str, out: list[str]):
        self.step, self.columns, self.held, self.carried, self.out = step, columns, held, carried, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer, self.carry = handle.getListState("rows", self.held), handle.getValueState("carry", self.carried)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [tuple(None if pd.isna(x) else x for x in r) for pdf in rows for r in pdf[["us_", *self.columns]].astype(object).itertuples(index=False)]
        if new:
            self.buffer.appendList(new)
            # a timer runs out once the watermark has passed it, and with it all rows up to it
            for ms in {-(-r[0] // 1000) for r in new}:
                self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.buffer.get(), key=lambda r: (r[0], r[1]))
        due, left = [tuple(r[1:]) for r in rows if r[0] <= passed], [tuple(r) for r in rows if r[0] > passed]
        if not due:
            return
        carry, made = self.step(tuple(self.carry.get()) if self.carry.exists() else None, due)
        self.carry.update(carry)
        self.buffer.put(left) if left else self.buffer.clear()
        yield pd.DataFrame([(key[0], *r) for r in made], columns=self.out)

    def close(self) -> None:
        pass


def _scanned(stream: DataFrame, key: str, columns: list[str], out: list[str], carried: str, step: Step, time: str | None) -> DataFrame:
    """``step`` over each key's rows: by event time where ``time`` is named, else a micro-batch at a time."""
    fields = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in out)
    if time is not None:
        stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
        held = "us long, " + ", ".join(f"c{i} {fields[c]}" for i, c in enumerate(columns))
        rows = stream.select(key, time, F.unix_micros(time).alias("us_"), *(c for c in columns if c not in (key, time)))
        return rows.groupBy(key).transformWithStateInPandas(_InOrder(step, columns, held, carried, out), schema, "append", "eventTime")

    def batch(k: Any, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(parts)).sort_values(columns[0])
        rows = [tuple(None if pd.isna(x) else x for x in r) for r in pdf[columns].astype(object).itertuples(index=False)]
        carry, made = step(tuple(state.get) if state.exists else None, rows)
        state.update(carry)
        yield pd.DataFrame([(k[0], *r) for r in made], columns=out)

    return stream.select(key, *columns).groupBy(key).applyInPandasWithState(batch, schema, carried, "append", GroupStateTimeout.NoTimeout)


def drop_repeats(stream: DataFrame, key: str, order: str, value: str, time: str | None = None) -> DataFrame:
    """Rows whose value differs from the key's last one.

    With ``time``, a column with a watermark, rows are taken in its order (then by ``order``) however they arrive, once the
    watermark has passed them; rows later than that are dropped and counted in the query's progress
    (``numRowsDroppedByWatermark``).  Without it, only the rows of a micro-batch are put in order.
    """
    fields = {f.name: f.dataType.simpleString() for f in stream.schema.fields}

    def step(carry: tuple | None, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        out = []
        for at, value_ in rows:
            if carry is None or carry[0] != value_:
                out.append((at, value_))
            carry = (value_,)
        return carry, out

    return _scanned(stream, key, [order, value], [key, order, value], f"last {fields[value]}", step, time)


def debounced(stream: DataFrame, key: str, order: str, value: str, least: float, gap: int, active: Column | None = None, time: str | None = None) -> DataFrame:
    """(``key``, ``order``) of ``active`` rows that fire; state: previous value, place of the last that fired, rows so far.

    ``time`` as in :func:`drop_repeats`.
    """

    def step(carry: tuple | None, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        prev, last, n = carry or (None, -(10**9), 0)
        out = []
        for at, v, on in rows:
            if on and (prev is None or (v is not None and abs(v - prev) > least)) and n - last >= gap:
                out.append((at,))
                last = n
            prev, n = (None if v is None else float(v)), n + 1
        return (prev, last, n), out

    on = F.lit(True) if active is None else F.coalesce(active, F.lit(False))
    return _scanned(stream.withColumn("on_", on), key, [order, value, "on_"], [key, order], "prev double, last long, n long", step, time)


def drain(spark: SparkSession, folder: str, schema: str, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Hands all new files of a folder to ``handle`` once and ends; files seen by an earlier call are not read again."""
    stream = spark.readStream.schema(schema).parquet(folder)
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()

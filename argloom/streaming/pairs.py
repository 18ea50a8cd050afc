"""Preference pairs from a stream of judged solutions: a problem's pair comes out once it has all its solutions, or has waited long enough.

Of a problem the state keeps how many solutions came, and the first valid and the first invalid one; so it is as large as there are open problems,
not as there are solutions. A pair leaves with `solution_pairs`; `written_to` stores each micro-batch under its number, so that one that runs again
after a failure replaces itself. Needs the RocksDB state store (`STATE_STORE`).

Solutions that come when their problem is done begin it anew. Null problems are one problem, a null verdict counts as not valid.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
_STATE = "n long, chosen long, rejected long"


class _Pairs(StatefulProcessor):
    """One problem: counts its solutions, and keeps the first of each kind."""

    def __init__(self, n: int, wait_ms: int):
        self.n, self.wait_ms = n, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", _STATE)

    def _pair(self, key, chosen: int | None, rejected: int | None) -> Iterator[pd.DataFrame]:
        if chosen is not None and rejected is not None:
            yield pd.DataFrame({"problem_id": [key[0]], "chosen": [chosen], "rejected": [rejected]})

    def _done(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.seen.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, chosen, rejected = self.seen.get() if self.seen.exists() else (0, None, None)
        for batch in rows:
            for pos, valid in sorted(zip(batch["sol_pos"].tolist(), batch["good"].tolist(), strict=True)):
                n += 1
                if valid:
                    chosen = pos if chosen is None else min(chosen, pos)
                else:
                    rejected = pos if rejected is None else min(rejected, pos)
                if n >= self.n:
                    yield from self._pair(key, chosen, rejected)
                    self._done()
                    n, chosen, rejected = 0, None, None
        if n:
            self.seen.update((n, chosen, rejected))
            if not list(self.handle.listTimers()):
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.seen.exists():
            _, chosen, rejected = self.seen.get()
            yield from self._pair(key, chosen, rejected)
            self.seen.clear()

    def close(self) -> None:
        pass


def solution_pairs(solutions: DataFrame, n: int, wait_seconds: float = 3600.0) -> DataFrame:
    """problem_id, chosen, rejected of problems with n solutions, or with fewer after some time: as `preference.validity_pairs` of the same solutions."""
    rows = solutions.select("problem_id", F.col("sol_pos").cast("long").alias("sol_pos"), F.coalesce("is_valid", F.lit(False)).alias("good"))
    return rows.groupBy("problem_id").transformWithStateInPandas(_Pairs(n, int(wait_seconds * 1000)), "problem_id string, chosen long, rejected long", "Append", "ProcessingTime")


def written_to(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch: each batch is a folder of its own, written whole."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
